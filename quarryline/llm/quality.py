"""Quality rules: hashed n-gram log-likelihood ratio of trusted target text to the raw corpus.

Word unigrams and bigrams are hashed into a fixed number of buckets. Two
multinomials over the buckets, one from trusted documents and one from the
whole corpus, give each bucket a log ratio. A document's score is the mean log
ratio of its n-grams; a fixed threshold decides. Everything stays in DataFrame
expressions: word arrays are hashed once and never leave the row, except as
bucket numbers that are summed where they are read.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import BLANKS, whole

BUCKETS = 16384
#: Mean log ratio below which a document is rejected.
THRESHOLD = -0.07
#: Trusted documents that the target multinomial is fitted on, at most; chosen by a hash of the id.
TRUSTED = 20_000
#: Pseudo-count of each bucket, spread as the raw corpus is.
PRIOR = 4.0

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW = 5
SPACES = " \t\n\x0b\f\r"
SYMBOLS = r"[#*$%&|<>]"


def _shift(xs: Column, by: int, n: Column) -> Column:
    return F.slice(xs, by + 1, F.greatest(n - by, F.lit(0)))


def _pairs(xs: Column, ys: Column) -> Column:
    """Hash of xs[i], ys[i] while both last; xs is cut to the length of ys."""
    return F.zip_with(F.slice(xs, 1, F.size(ys)), ys, lambda a, b: F.xxhash64(a, b))


def with_words(docs: DataFrame, text: Column) -> DataFrame:
    """Adds _words, _n, _h (a hash of each word) and _b (a hash of each two words in a row)."""
    trimmed = F.btrim(text, F.lit(SPACES))
    out = docs.withColumn("_words", F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, BLANKS)))
    out = out.withColumn("_n", F.size("_words"))
    out = out.withColumn("_h", F.transform("_words", lambda w: F.xxhash64(w)))
    return out.withColumn("_b", _pairs(F.col("_h"), _shift(F.col("_h"), 1, F.col("_n"))))


def buckets_of(n: int = BUCKETS) -> Column:
    return F.transform(F.concat("_h", "_b"), lambda x: F.pmod(x, F.lit(n)).cast("int"))


def with_base(docs: DataFrame, text: Column) -> DataFrame:
    """Adds the base columns to what with_words gives.

    A word is repeated if a window of five words around it occurs twice or more
    in the text. Windows are compared by 64-bit hashes. Only texts in which some
    window repeats go on to be sorted by hash.
    """
    n, h, b = F.col("_n"), F.col("_h"), F.col("_b")
    out = docs.withColumn("_w4", _pairs(b, _shift(b, 2, n - 1)))
    out = out.withColumn("_w5", _pairs(F.col("_w4"), _shift(h, 4, n)))
    out = out.withColumn("_again", F.size(F.array_distinct("_w5")) < F.size("_w5"))
    placed = F.sort_array(F.transform("_w5", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    out = out.withColumn("_sorted", F.when(F.col("_again"), placed))
    same = lambda i, x: F.coalesce(F.get(F.col("_sorted"), i)["x"] == x, F.lit(False))
    twice = F.filter("_sorted", lambda s, i: same(i - 1, s["x"]) | same(i + 1, s["x"]))
    starts = F.sort_array(F.transform(twice, lambda s: s["i"]))
    covered = F.aggregate(
        starts,
        F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")),
        lambda a, p: F.struct((a["n"] + F.least(F.lit(WINDOW), p - a["last"])).alias("n"), p.alias("last")),
        lambda a: a["n"],
    )
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    out = out.withColumn("_lines", lines)
    out = out.select(
        "*",
        n.cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.col("_again"), covered).otherwise(0).cast("long").alias("n_repeat_words"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return out.withColumn("base_failed", failed)


def trusted_ids(labels: DataFrame, most: int = TRUSTED) -> DataFrame:
    """Ids labelled as good and not toxic, at most `most`."""
    good = labels.where((F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0) & F.col("doc_id").isNotNull())
    return good.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def fit(docs: DataFrame, labels: DataFrame | None, id_col: str = "doc_id", text_col: str = "text", n: int = BUCKETS) -> list[float]:
    """The log ratio of each bucket, from counts over all documents. Without trusted documents all are 0.

    Null texts have no words; repeated rows count as often as they occur; null
    ids are trusted by no label. An empty table gives ratios of 0.
    """
    if labels is None:
        return [0.0] * n
    trusted = trusted_ids(labels).select(F.col("doc_id").alias("_trusted"))
    read = docs.select(F.col(id_col).alias("_id"), whole(F.col(text_col)).alias("_text"))
    read = with_words(read.join(F.broadcast(trusted), F.col("_id") == F.col("_trusted"), "left"), F.col("_text"))
    counts = (
        read.select(F.explode(buckets_of(n)).alias("bucket"), F.col("_trusted").isNotNull().cast("long").alias("t"))
        .groupBy("bucket")
        .agg(F.count(F.lit(1)).alias("raw"), F.sum("t").alias("target"))
        .collect()  # n rows at most
    )
    raw, target = [1.0] * n, [0.0] * n
    for r in counts:
        raw[r["bucket"]] += r["raw"]
        target[r["bucket"]] = float(r["target"])
    all_raw, all_target = sum(raw), sum(target)
    if not all_target:
        return [0.0] * n
    prior = PRIOR * n
    return [math.log((t + prior * c / all_raw) / (all_target + prior) * all_raw / c) for c, t in zip(raw, target)]


def score_documents(
    docs: DataFrame, ratios: list[float], id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD
) -> DataFrame:
    """All columns of docs, with the base columns, score and kept.

    Null and empty texts have no words, score 0 and fail the base. Repeated rows
    stay repeated. Input columns named like ours are replaced. An empty table
    gives no rows.
    """
    ours = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept"]
    names = [c for c in docs.columns if c not in ours]
    read = docs.select(F.struct(*names).alias("_row"), whole(F.col(text_col)).alias("_text"))
    out = with_base(with_words(read, F.col("_text")), F.col("_text"))
    table = F.from_json(F.lit(json.dumps([round(x, 6) for x in ratios])), "array<double>")
    total = F.aggregate(buckets_of(len(ratios)), F.lit(0.0), lambda a, x: a + F.get(table, x))
    grams = F.greatest(F.size("_h") + F.size("_b"), F.lit(1))
    out = out.withColumn("score", total / grams)
    return out.select("_row.*", *ours[:6], "score", (~F.col("base_failed") & (F.col("score") >= threshold)).alias("kept"))


def kept_documents(docs: DataFrame, ratios: list[float], id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that score_documents keeps, with their columns.

    A generator drops the others: a filter would be pushed below the word
    arrays, and each array written out again for each of its uses.
    """
    names = [F.col(c) for c in docs.columns]
    base = docs.select(F.struct(*names).alias("_row"), F.col(id_col).alias("_doc"), F.col(text_col).alias("_body"))
    scored = score_documents(base, ratios, "_doc", "_body", threshold)
    once = F.when(F.col("kept"), F.array(F.lit(1))).otherwise(F.array().cast("array<int>"))
    return scored.select("_row", F.explode(once)).select("_row.*")
