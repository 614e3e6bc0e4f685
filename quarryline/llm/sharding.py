"""Sharding through fixed virtual slots.

Rows are hashed into thousands of virtual slots that never change. Bytes are
summed for each slot, and a small versioned map says which shard holds a slot.
Rebalancing edits the map: it moves whole slots and writes the next version.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import exists, settle, shared_folder
from .text import whole

N_SLOTS = 8192


@dataclass(frozen=True)
class SlotMap:
    """shards[v] is the shard of virtual slot v. A version is never changed, only followed by another."""

    version: int
    shards: tuple[int, ...]

    @classmethod
    def first(cls, n_shards: int, n_slots: int = N_SLOTS) -> SlotMap:
        return cls(1, tuple(v % n_shards for v in range(n_slots)))

    def rebalanced(self, sizes: list[int], n_shards: int) -> SlotMap:
        """The next version: moves and swaps of slots until no single one brings the fullest and the emptiest shard closer. Without any, this one."""
        shards = list(self.shards)
        load = [0] * n_shards
        held: list[set[int]] = [set() for _ in range(n_shards)]
        for v, s in enumerate(shards):
            load[s] += sizes[v]
            if sizes[v]:
                held[s].add(v)
        while True:  # each step brings two loads closer, so it ends
            high = max(range(n_shards), key=lambda s: (load[s], -s))
            low = min(range(n_shards), key=lambda s: (load[s], s))
            gap = load[high] - load[low]
            move = min(held[high], key=lambda v: (abs(gap - 2 * sizes[v]), v), default=None)
            best = abs(gap - 2 * sizes[move]) if move is not None else gap
            swap = None
            if best > gap // 4 or best >= gap:
                ups = sorted((sizes[v], v) for v in held[high])
                downs = sorted((sizes[v], v) for v in held[low])
                i = 0
                for size, v in ups:  # for each slot of the fuller shard, its best partner by a moving pointer
                    while i < len(downs) and 2 * (size - downs[i][0]) > gap:
                        i += 1
                    for j in (i - 1, i):
                        if 0 <= j < len(downs) and abs(gap - 2 * (size - downs[j][0])) < best:
                            best, swap = abs(gap - 2 * (size - downs[j][0])), (v, downs[j][1])
            if best >= gap:
                break
            for v, a, b in ((swap[0], high, low), (swap[1], low, high)) if swap else ((move, high, low),):
                held[a].discard(v)
                held[b].add(v)
                load[a] -= sizes[v]
                load[b] += sizes[v]
                shards[v] = b
        return self if tuple(shards) == self.shards else SlotMap(self.version + 1, tuple(shards))

    def frame(self, spark: SparkSession) -> DataFrame:
        return _numbers(spark, self.shards, "shard").withColumn("version", F.lit(self.version))

    def save(self, spark: SparkSession, folder: str) -> None:
        self.frame(spark).coalesce(1).write.mode("errorifexists").parquet(f"{folder}/v{self.version}")

    @classmethod
    def load(cls, spark: SparkSession, folder: str, version: int) -> SlotMap:
        rows = spark.read.parquet(f"{folder}/v{version}").orderBy("vslot").collect()
        return cls(version, tuple(r["shard"] for r in rows))

    @classmethod
    def latest(cls, spark: SparkSession, folder: str) -> SlotMap | None:
        """The last version that a folder holds, None without any."""
        if not exists(spark, folder):
            return None
        where = spark._jvm.org.apache.hadoop.fs.Path(folder)
        found = [x.getPath().getName() for x in where.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(where)]
        versions = [int(n[1:]) for n in found if n[:1] == "v" and n[1:].isdigit() and exists(spark, f"{folder}/{n}/_SUCCESS")]
        return cls.load(spark, folder, max(versions)) if versions else None


def _numbers(spark: SparkSession, xs, *names: str) -> DataFrame:
    """vslot and the numbers of each slot, without Python workers."""
    rows = [list(x) if isinstance(x, tuple) else [x] for x in xs]
    each = spark.range(1).select(F.posexplode(F.from_json(F.lit(json.dumps(rows)), "array<array<bigint>>")).alias("vslot", "x"))
    return each.select("vslot", *[F.col("x")[i].alias(n) for i, n in enumerate(names)]).withColumn("shard", F.col("shard").cast("int"))


def hashed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_slots: int = N_SLOTS) -> DataFrame:
    """doc_id, size (UTF-8 bytes and 16), text_crc32, vslot of each row. A null id is dealt out by its text."""
    text = whole(F.col(text_col))
    crc = F.crc32(text.cast("binary"))
    return docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + F.lit(16)).cast("long").alias("size"),
        crc.alias("text_crc32"),
        F.pmod(F.xxhash64(F.col(id_col), F.when(F.col(id_col).isNull(), crc)), F.lit(n_slots)).cast("int").alias("vslot"),
    )


def slot_bytes(rows: DataFrame, n_slots: int = N_SLOTS) -> tuple[list[int], list[int]]:
    """Bytes and rows of each virtual slot; n_slots numbers each, whatever the input's size."""
    sizes, counts = [0] * n_slots, [0] * n_slots
    for r in rows.groupBy("vslot").agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n")).collect():
        sizes[r["vslot"]], counts[r["vslot"]] = r["b"], r["n"]
    return sizes, counts


def shard_documents(
    docs: DataFrame, n_shards: int = 40, id_col: str = "doc_id", text_col: str = "text", n_slots: int = N_SLOTS, folder: str | None = None
) -> DataFrame:
    """Each row's shard under the law `bytes`: doc_id, size, text_crc32, law, shard, slot, grown_shard, vslot, map_version.

    slot numbers a shard's rows gaplessly from 0, by virtual slot, then id
    (nulls first), then size and checksum. Null texts have size 16 and checksum
    0. An empty table gives no rows; then the map stays balanced by count.

    folder keeps the map: its last version is edited if the load asks for it,
    and the next one written. Without a folder a fresh one is used.
    """
    spark = docs.sparkSession
    rows = settle(hashed(docs, id_col, text_col, n_slots))
    sizes, counts = slot_bytes(rows, n_slots)
    folder = folder or f"{shared_folder(spark)}/slot_map_{uuid.uuid4().hex}"
    before = SlotMap.latest(spark, folder)
    if before is None:
        before = SlotMap.first(n_shards, n_slots)
        before.save(spark, folder)
    if len(before.shards) != n_slots or max(before.shards) >= n_shards:
        raise ValueError(f"{folder}: the map is for other slots or shards")
    current = before.rebalanced(sizes, n_shards)
    if current.version > before.version:
        current.save(spark, folder)
    start, used = [0] * n_slots, [0] * n_shards
    for v, s in enumerate(current.shards):
        start[v] = used[s]
        used[s] += counts[v]
    places = _numbers(spark, list(zip(current.shards, start)), "shard", "start")
    inside = Window.partitionBy("vslot").orderBy("doc_id", "size", "text_crc32")
    return (
        rows.withColumn("rank", F.row_number().over(inside) - 1)
        .join(F.broadcast(places), "vslot")
        .select(
            "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
            (F.col("start") + F.col("rank")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
            "vslot", F.lit(current.version).alias("map_version"),
        )
    )
