"""URL rules matched through hashed host-suffix and path-prefix expressions.

Each URL is expanded into the expressions that a rule could consist of. Their
SHA-256 digests meet the rules' in an equi-join on a short hash prefix, then
the full digests are compared, and the longest rule that fits decides.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hex digits of the digest that the join uses.
PREFIX = 8
#: Rule tables up to this many bytes (hosts, paths, digests) are broadcast; larger ones are joined by a shuffle.
BROADCAST_BYTES = 16 << 20

#: (host, path, verdict)
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null and without ://."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), path).cast("binary"), 256)


def prepared(rules: DataFrame) -> DataFrame:
    """Rules with their digest. Rules without a host fit nothing and go; of rules with equal host and path, block wins."""
    host = F.translate(F.col("host"), string.ascii_uppercase, string.ascii_lowercase)
    one = rules.select(host.alias("r_host"), F.coalesce("path", F.lit("")).alias("r_path"), F.col("verdict").alias("r_verdict"))
    one = one.where("r_host <> ''").groupBy("r_host", "r_path").agg(F.max("r_verdict").alias("r_verdict"))
    return one.withColumn("full", digest(F.col("r_host"), F.col("r_path"))).withColumn("short", F.substring("full", 1, PREFIX))


def expressions(shapes: list[tuple[int, int]]) -> Column:
    """For a URL's host and path, one (host suffix, path prefix) for each shape that fits it.

    A shape is the label count and path length of some rule, so any rule that
    fits is among the expressions, however its path ends.
    """
    labels = F.split(F.col("host"), r"\.", -1)
    shape = F.array(*[F.struct(F.lit(h).alias("h"), F.lit(p).alias("p")) for h, p in shapes])
    fitting = F.filter(shape, lambda s: (s["h"] <= F.size(labels)) & (s["p"] <= F.length("path")))
    return F.transform(
        fitting,
        lambda s: F.struct(
            F.array_join(F.slice(labels, -s["h"], s["h"]), ".").alias("e_host"),
            F.substring(F.col("path"), F.lit(1), s["p"]).alias("e_path"),
        ),
    )


def filter_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """id_col, host, path, rule, verdict of each row of pages.

    A rule fits its host and all subdomains if the path starts with its path.
    The longest (host and path together) wins; of equally long ones the longer
    host. Without a rule the verdict is `default`. Null URLs and those without
    :// have empty host and path and fit no rule. Repeated rows stay repeated, an
    empty table gives none. Columns other than the id and the url are ignored.
    """
    known = prepared(rules)
    shapes = [
        (r["h"], r["p"])
        for r in known.select(F.size(F.split("r_host", r"\.", -1)).alias("h"), F.length("r_path").alias("p")).distinct().collect()
    ]  # as many as there are lengths, not rules
    read = pages.select(F.col(id_col).alias("id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    if not shapes:
        return read.select(F.col("id").alias(id_col), "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    size = known.agg(F.sum(F.octet_length("r_host") + F.octet_length("r_path") + F.lit(150)).alias("b")).collect()[0]["b"]
    if size <= BROADCAST_BYTES:
        known = F.broadcast(known)
    asked = read.where("host <> ''").select("host", "path").distinct()
    tried = (
        asked.withColumn("e", F.explode(expressions(shapes)))
        .withColumn("e_full", digest(F.col("e.e_host"), F.col("e.e_path")))
        .withColumn("e_short", F.substring("e_full", 1, PREFIX))
    )
    hits = tried.join(known, F.col("e_short") == F.col("short"))
    rank = F.struct(F.length("r_host") + F.length("r_path"), F.length("r_host"))
    confirmed = F.col("e_full") == F.col("full")  # of what shares a short prefix, only the same full digest counts
    best = hits.groupBy(F.col("host").alias("b_host"), F.col("path").alias("b_path")).agg(
        F.max_by(F.struct("r_host", "r_path", "r_verdict"), F.when(confirmed, rank)).alias("best")
    )
    judged = lambda df, rule, verdict: df.select(F.col("id").alias(id_col), "host", "path", rule.alias("rule"), F.coalesce(verdict, F.lit(default)).alias("verdict"))
    named = read.where("host <> ''").join(best, (F.col("host") == F.col("b_host")) & (F.col("path") == F.col("b_path")), "left")
    none = F.lit(None).cast("string")  # rows without a host meet no rule, and so no common join key
    return judged(named, F.concat(F.col("best.r_host"), F.col("best.r_path")), F.col("best.r_verdict")).unionByName(judged(read.where("host = ''"), none, none))


def standard_rules(spark) -> DataFrame:
    shown = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
    return spark.sql(f"SELECT * FROM VALUES {shown} AS t(host, path, verdict)")
