"""Mixing sources to target weights by fixed-length token blocks.

Each source's documents form one long row of tokens that is cut into blocks of
a fixed length. The mix is a row of slots, cut into output shards. A
pseudorandom permutation of all slots deals each shard its source counts: they
follow the multinomial law given the sources' totals, so no source misses its
target by chance. A slot of a source is mapped to a block index by the source's
own permutation, another one each time the source has been gone through, and
the blocks are joined by index.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import settle
from .text import n_words, whole

BLOCK = 128
#: Slots of an output shard.
SHARD_SLOTS = 4096
#: Weights by the sources' order, repeating, and the most that a source's target is of its size.
WEIGHTS = (1, 2, 3)
MOST = 3
#: Documents whose positions one task numbers, about; slots that one row expands into.
CHUNK_ROWS, CHUNK_SLOTS = 20_000, 8192
SEED = 20_251
#: Rounds of the swap-or-not permutation.
ROUNDS = 16

TOKEN = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"


def permuted(x: Column, n: Column, key: Column) -> Column:
    """A pseudorandom permutation of 0 .. n-1, another for each key.

    Swap-or-not: each round pairs x with (k - x) mod n and swaps the two or
    not, by a hash of the pair. It is exact for every n.
    """

    def step(a, r):
        mate = F.pmod(F.pmod(F.xxhash64(F.lit(SEED), key, r), n) - a, n)
        return F.when(F.xxhash64(key, r, F.greatest(a, mate)) % 2 == 0, a).otherwise(mate)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), x.cast("long"), step)


def targets_of(sizes: DataFrame) -> DataFrame:
    """source, source_size -> and target, weight. sizes has one row for each source.

    A source's target is min(MOST * size, level * weight), the level being such
    that the targets add up to all sizes: with the sources in order of
    MOST * size / weight, the first k are full, where k is the smallest number
    that leaves the next one below its limit.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.encode("source", "utf-8"))
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), ((F.row_number().over(by_name) - 1) % len(WEIGHTS) + 1).cast("int"))
    rows = sizes.withColumn("weight", weight).withColumn("cap", (MOST * F.col("source_size")).cast("double"))
    rows = rows.withColumn("at", F.col("cap") / F.col("weight"))
    order = Window.orderBy("at", F.col("source").isNull(), F.encode("source", "utf-8"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    rows = rows.withColumn("full", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    rows = rows.withColumn("left", F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
    rows = rows.withColumn("level", (F.sum("source_size").over(everything) - F.col("full")) / F.col("left"))
    level = F.min(F.when(F.col("level") <= F.col("at"), F.struct("at", "level"))).over(everything)["level"]
    rows = rows.withColumn("level", level)
    return rows.select("source", "source_size", "weight", F.least("cap", F.col("level") * F.col("weight")).alias("target"))


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    return docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).cast("string").alias("source"),
        n_words(F.col(text_col)).alias("size"),
        F.monotonically_increasing_id().alias("row"),
    )


def numbered(rows: DataFrame) -> DataFrame:
    """Adds start, the tokens of the source before the document, without gathering a source in one task.

    Documents are dealt into chunks by a hash; chunk totals are summed up, then
    documents within a chunk. The order is by chunk, id, size and row.
    """
    chunks = max(1, -(-rows.count() // CHUNK_ROWS)) * 8
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("doc_id", F.when(F.col("doc_id").isNull(), F.col("row"))), F.lit(chunks)))
    totals = rows.groupBy("source", "chunk").agg(F.sum("size").alias("total"))
    running = Window.partitionBy("source").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select(
        F.col("source").alias("b_source"), F.col("chunk").alias("b_chunk"), F.coalesce(F.sum("total").over(running), F.lit(0)).alias("base")
    )
    inside = Window.partitionBy("source", "chunk").orderBy("doc_id", "size", "row").rowsBetween(Window.unboundedPreceding, -1)
    out = rows.withColumn("inner", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    out = out.join(base, F.col("source").eqNullSafe(F.col("b_source")) & (F.col("chunk") == F.col("b_chunk")))
    return out.select("doc_id", "source", "size", "row", (F.col("base") + F.col("inner")).alias("start"))


def plan_slots(sources: DataFrame) -> DataFrame:
    """shard, place (in the shard), source, block, one row for each slot of the mix. sources is what targets_of gives.

    Each block of a source is taken as often as any other or once more, never
    over MOST times.
    """
    some = sources.where("source_size > 0")
    blocks = F.ceil(F.col("source_size") / F.lit(BLOCK))
    slots = F.least(F.round(F.col("target") * blocks / F.col("source_size")).cast("long"), MOST * blocks)
    some = some.withColumn("blocks", blocks).withColumn("slots", slots)
    by_name = Window.orderBy(F.col("source").isNull(), F.encode("source", "utf-8"))
    some = some.withColumn("before", F.sum("slots").over(by_name) - F.col("slots"))
    some = some.withColumn("slots_of_all", F.sum("slots").over(Window.partitionBy())).where("slots > 0")
    parts = some.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("slots") - 1) / F.lit(CHUNK_SLOTS)))))
    n = sources.agg(F.sum("target")).collect()[0][0] or 0
    parts = parts.repartition(max(8, int(n / BLOCK / CHUNK_SLOTS) + 1), "source", "part")  # each row expands: no coalescing
    first = F.col("part") * CHUNK_SLOTS
    each = parts.withColumn("slot", F.explode(F.sequence(first, F.least(first + CHUNK_SLOTS, F.col("slots")) - 1)))
    place = permuted(F.col("before") + F.col("slot"), F.col("slots_of_all"), F.lit(0))
    epoch = F.floor(F.col("slot") / F.col("blocks"))
    key = F.xxhash64("source", epoch)
    block = permuted(F.col("slot") % F.col("blocks"), F.col("blocks"), key)
    return each.select(
        F.floor(place / F.lit(SHARD_SLOTS)).alias("shard"), (place % SHARD_SLOTS).alias("place"), "source", block.alias("block")
    )


def pieces(rows: DataFrame) -> DataFrame:
    """row, source, block, offset (in the document), length: each numbered document cut at the block limits."""
    some = rows.where("size > 0")
    first, last = F.floor(F.col("start") / F.lit(BLOCK)), F.floor((F.col("start") + F.col("size") - 1) / F.lit(BLOCK))
    cut = some.withColumn("block", F.explode(F.sequence(first, last)))
    begin = F.greatest(F.col("start"), F.col("block") * BLOCK)
    end = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * BLOCK)
    return cut.select("row", "source", "block", (begin - F.col("start")).alias("offset"), (end - begin).alias("length"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, sources, taken).

    rows: doc_id, source, size, row (a number of the input row), start.
    sources: source, source_size, weight, target.
    taken: shard, place, row, offset, length; the words [offset, offset + length)
    of that row's document stand at that place of the output shard.

    Null texts have size 0 and give nothing; a null source is a source, the
    last. Repeated rows count as often as they occur. An empty table gives
    empty results. Documents with null ids are dealt out by row number.
    """
    rows = settle(numbered(settle(sized(docs, id_col, text_col, source_col))))
    sources = settle(targets_of(rows.groupBy("source").agg(F.sum("size").alias("source_size"))))
    slots = plan_slots(sources).select("shard", "place", F.col("source").alias("s_source"), F.col("block").alias("s_block"))
    cut = pieces(rows)
    taken = cut.join(slots.hint("merge"), F.col("source").eqNullSafe(F.col("s_source")) & (F.col("block") == F.col("s_block")))
    return rows, sources, taken.select("shard", "place", "row", "offset", "length")


def mix_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, size, source_size, target, taken of each row of docs."""
    rows, sources, taken = mix(docs, id_col, text_col, source_col)
    each = taken.groupBy("row").agg(F.sum("length").alias("taken")).withColumnRenamed("row", "t_row")
    known = sources.select(F.col("source").alias("s_source"), "source_size", "target")
    return (
        rows.join(known, F.col("source").eqNullSafe(F.col("s_source")))
        .join(each, F.col("row") == F.col("t_row"), "left")
        .select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
    )


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix as rows with the columns of docs.

    A document's n-th row holds the words that the mix takes n times or more, in
    their order and with the white space before them; all words taken gives the
    text unchanged. Documents that the mix takes nothing of have no row. n_chars,
    if there is such a column, follows the text.
    """
    rows, _, taken = mix(docs, id_col, text_col, source_col)
    spans = taken.groupBy("row", "offset", "length").agg(F.count(F.lit(1)).alias("times"))
    span = F.struct("offset", "length", "times")
    each = spans.groupBy("row").agg(F.sort_array(F.collect_list(span)).alias("_spans"), F.max("times").alias("_times"))
    each = rows.join(each, "row").select(
        F.col("doc_id").alias("m_id"), F.col("source").alias("m_source"), F.col("size").alias("m_size"), "_spans", "_times",
        F.row_number().over(Window.partitionBy("doc_id", "source", "size").orderBy("row")).alias("m_nth"),
    )
    # Repeated rows, equal in id, source and size, are told apart by their order.
    read = docs.select(
        F.struct(*docs.columns).alias("row"), F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), F.col(text_col).alias("text"),
        n_words(F.col(text_col)).alias("size"),
    )
    copies = _cut_texts(read, each)
    kept = [F.col("cut").alias(c) if c == text_col else F.length("cut").cast("long").alias(c) if c == "n_chars" else F.col(f"row.{c}").alias(c) for c in docs.columns]
    return copies.select(*kept)


def _cut_texts(read: DataFrame, each: DataFrame) -> DataFrame:
    """row and cut: the words that the mix takes, for each copy of each row."""
    if each.where("m_nth > 1").isEmpty():
        read = read.withColumn("nth", F.lit(1))
    else:
        read = read.withColumn("nth", F.row_number().over(Window.partitionBy("id", "source", "size").orderBy("text")))
    same = F.col("id").eqNullSafe(F.col("m_id")) & F.col("source").eqNullSafe(F.col("m_source")) & (F.col("size") == F.col("m_size")) & (F.col("nth") == F.col("m_nth"))
    copies = read.join(each, same).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("_times").cast("int"))))
    copies = copies.withColumn("mine", F.filter("_spans", lambda s: s["times"] >= F.col("copy")))
    length = F.aggregate("mine", F.lit(0).cast("long"), lambda a, s: a + s["length"])
    tokens = F.regexp_extract_all(F.col("text"), F.lit(TOKEN), F.lit(0))
    cut = lambda ts: F.flatten(F.transform("mine", lambda s: F.slice(ts, (s["offset"] + 1).cast("int"), s["length"].cast("int"))))
    chosen = F.transform(F.array(tokens), lambda ts: F.array_join(cut(ts), ""))[0]  # the array binds the tokens: they are found once
    return copies.select("row", F.when(length == F.col("size"), F.col("text")).otherwise(chosen).alias("cut"))


def shard_counts(sources: DataFrame) -> DataFrame:
    """shard, source, slots: what each output shard draws of each source. sources is what targets_of gives.

    The law is the multinomial one, given the sources' totals over all shards.
    """
    return plan_slots(sources).groupBy("shard", "source").agg(F.count(F.lit(1)).alias("slots"))
