"""Operators for preparing training data: dedup, filtering, mixing, packing, scoring, sharding, binary output."""
