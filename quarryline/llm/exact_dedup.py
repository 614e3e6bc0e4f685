"""Exact dedup with a heavy-hitter split.

A Misra-Gries summary finds the digests that hold a large share of the rows.
Their winners are verified by an exact aggregation and broadcast, so the rows
of large groups are settled where they are read. All other digests meet in an
ordinary shuffle, where no group is large any more.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import forget, settle
from .text import BLANKS, whole

#: Counters in the summary. It misses no digest with over 3.5 / TRACKED of the rows.
TRACKED = 8192
#: A digest is heavy from this share of the rows on. At most HEAVY_SHARE digests can be, which bounds the broadcast.
HEAVY_SHARE = 2000
#: Dropped rows up to this many are broadcast, as ids and digests (under 100 bytes each).
BROADCAST_ROWS = 150_000


def digest_of(text):
    """SHA-256 (lower-case hex) of the text with each run of white space as one space; null counts as empty."""
    return F.sha2(F.regexp_replace(whole(text), BLANKS, " ").cast("binary"), 256)


def heavy_digests(rows: DataFrame) -> DataFrame:
    """The heavy digests of `text_sha256`, at most HEAVY_SHARE rows."""
    top = f"approx_top_k(text_sha256, {HEAVY_SHARE}, {TRACKED})"
    found = rows.agg(F.expr(top).alias("top"), F.count(F.lit(1)).alias("n")).select(
        F.explode("top").alias("x"), "n"
    )
    return found.where((F.col("x.count") >= 2) & (F.col("x.count") * HEAVY_SHARE >= F.col("n"))).select(
        F.col("x.item").alias("text_sha256")
    )


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: id_col, keep_id, group_size, kept, text_sha256.

    Null texts count as empty and form one group with empty texts. Of equal
    texts the smallest id stays; null ids come last. Of repeated rows (equal id
    and text) exactly one is kept. An empty table gives no rows; other columns
    of the input are ignored.
    """
    rows = settle(
        docs.select(
            F.col(id_col).alias("doc_id"),
            digest_of(F.col(text_col)).alias("text_sha256"),
            F.monotonically_increasing_id().alias("row"),
        )
    )
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    heavy = settle(heavy_digests(rows))
    winners = (
        rows.join(F.broadcast(heavy), "text_sha256", "left_semi")
        .groupBy("text_sha256")
        .agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("group_size"))
    )
    front = rows.join(F.broadcast(winners), "text_sha256")
    others = rows.join(F.broadcast(heavy), "text_sha256", "left_anti")
    groups = others.groupBy("text_sha256").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("group_size"))
    rest = others.join(groups, "text_sha256")
    return front.unionByName(rest).select(
        F.col("doc_id").alias(id_col),
        F.col("first.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("first.row")).alias("kept"),
        "text_sha256",
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that exact_groups keeps, with all their columns.

    Rows are told apart by id and text: null ids and ids on several texts stand
    for themselves, and of repeated rows one stays. Null and empty texts are
    equal. An empty table gives no rows. The dropped rows' ids and digests are
    broadcast up to BROADCAST_ROWS, else joined by a shuffle.
    """
    groups = settle(exact_groups(docs, id_col, text_col))
    dropped = groups.where(~F.col("kept")).select(F.col(id_col).alias("g_id"), F.unhex("text_sha256").alias("g_sha"), F.col("keep_id").eqNullSafe(F.col(id_col)).alias("repeated"))
    gone = settle(dropped.distinct())
    forget(groups)
    row = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("id"), F.unhex(digest_of(F.col(text_col))).alias("sha"))
    these = lambda x: F.col("id").eqNullSafe(x["g_id"]) & (F.col("sha") == x["g_sha"])
    few = F.broadcast if gone.count() <= BROADCAST_ROWS else lambda df: df
    out = row.join(few(gone), these(gone), "left_anti").select("row")
    repeated = gone.where("repeated")
    if not repeated.isEmpty():
        once = row.join(few(repeated), these(repeated), "left_semi").groupBy("id", "sha").agg(F.first("row").alias("row"))
        out = out.unionByName(once.select("row"))
    return out.select("row.*")
