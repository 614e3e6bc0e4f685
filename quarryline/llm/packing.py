"""Harmonic packing into fixed-length sequences.

Each worker cuts its documents into whole sequences, pieces of half, a quarter
and so on down to MIN_CUT tokens, and one rest. A piece of length n belongs to
class k = capacity // n, and a class fills its sequences with exactly k pieces.
Halves, quarters and so on fill theirs without a gap; short rests leave less
than one rest. Workers never speak to each other. What a worker has left in
unfilled classes at its end is laid end to end and cut at powers of two.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens

CAPACITY = 2048
#: Rests shorter than this are not cut up further.
MIN_CUT = 128
END = 1
SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, sequence_length long"


def cuts(n: int, capacity: int = CAPACITY, min_cut: int = MIN_CUT) -> list[int]:
    """The lengths that n tokens are cut into, in their order."""
    out = [capacity] * (n // capacity)
    n %= capacity
    size = capacity // 2
    while size >= min_cut:
        if n >= size:
            out.append(size)
            n -= size
        size //= 2
    return [*out, n] if n else out


class Packer:
    """The classes of one worker. put() and finish() give (piece, sequence, offset, sequence length)."""

    def __init__(self, worker: int, capacity: int = CAPACITY):
        self.capacity, self.next, self.open = capacity, worker << 40, {}

    def _close(self, pieces: list[tuple], length: int) -> Iterator[tuple]:
        offset = 0
        for p in pieces:
            yield (p, self.next, offset, length)
            offset += p[2]
        self.next += 1

    def put(self, piece: tuple) -> Iterator[tuple]:
        k = self.capacity // piece[2]
        held = self.open.setdefault(k, [])
        held.append(piece)
        if len(held) == k:
            del self.open[k]
            yield from self._close(held, self.capacity)

    def finish(self) -> Iterator[tuple]:
        left = [p for k in sorted(self.open) for p in self.open[k]]
        self.open = {}
        total = sum(p[2] for p in left)
        room = 0
        held: list[tuple] = []
        while left or held:
            if not room:
                room = size = min(self.capacity, 1 << (total.bit_length() - 1))
                total -= size
            doc, start, length, ids, n = left.pop(0)
            part = min(length, room)
            held.append((doc, start, part, ids[: 4 * part], n))
            if part < length:
                left.insert(0, (doc, start + part, length - part, ids[4 * part :], n))
            room -= part
            if not room:
                yield from self._close(held, size)
                held = []


def pack_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end: int = END, vocabulary: str | None = None
) -> DataFrame:
    """One row for each piece, with the columns of SCHEMA; ids are little-endian unsigned 32-bit.

    Null and empty texts are the end token alone. A null id stays null. Repeated
    rows are packed as often as they occur. An empty table gives no rows.
    A worker is a task; sequence ids start with its number.
    """
    path = vocabulary or tokens.vocabulary_path("byte_bpe_50k.json")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        from pyspark import TaskContext

        encode = tokens.encoder(path, True, "uint32")
        last = np.array([end], "<u4").tobytes()
        packer = Packer(TaskContext.get().partitionId(), capacity)
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        types = [pa.binary() if c == "ids" else pa.int64() for c in names]

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            flat = [(*p[:3], p[3], p[4], seq, off, length) for p, seq, off, length in rows]
            cols = zip(*flat) if flat else [[]] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types)], names)

        for b in batches:
            out: list[tuple] = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                ids = encode(text.as_py() or "") + last
                n, start = len(ids) // 4, 0
                for length in cuts(n, capacity):
                    out.extend(packer.put((doc, start, length, ids[4 * start : 4 * (start + length)], n)))
                    start += length
                if len(out) > 2000:
                    yield batch(out)
                    out = []
            yield batch(out)
        yield batch(list(packer.finish()))

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(pack, SCHEMA)


def packing_report(docs: DataFrame, **options) -> DataFrame:
    """pack_documents with ids_crc32 for the ids."""
    return pack_documents(docs, **options).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "sequence_length"
    )
