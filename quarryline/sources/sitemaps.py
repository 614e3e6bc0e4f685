"""Sitemap files to page URLs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls as U

DEPTH, MOST = 2, 200
_SCHEMA = "url array<struct<loc: array<string>>>, sitemap array<struct<loc: array<string>>>"
_ROOT = r"(?s)^\s*(?:<\?.*?\?>\s*|<!.*?>\s*)*<(?:[\w.-]+:)?(urlset|sitemapindex)[\s>/]"


def parse(files: DataFrame) -> DataFrame:
    """url, kind (page or sitemap), pos, loc of files (url, xml). Empty or malformed files give no rows."""
    read = files.select("url", F.regexp_extract("xml", _ROOT, 1).alias("root"), F.from_xml(F.trim("xml"), _SCHEMA, {"mode": "PERMISSIVE"}).alias("x"))
    entries = F.when(F.col("root") == "urlset", F.col("x.url")).when(F.col("root") == "sitemapindex", F.col("x.sitemap"))
    locs = F.filter(F.transform(F.flatten(F.transform(entries, lambda e: e["loc"])), lambda t: F.btrim(t)), lambda t: t != "")
    kind = F.when(F.col("root") == "urlset", "page").otherwise("sitemap")
    return read.select("url", kind.alias("kind"), F.posexplode(locs).alias("pos", "loc"))


def discover(starts: DataFrame, files: DataFrame, allowed: list[str], most: int = MOST) -> DataFrame:
    """url, rank of the pages that the sitemaps `starts` (url, seq) lead to, in breadth-first order.

    Sitemaps are followed DEPTH levels down, each once. Pages are normalized,
    in the allowed domains or below them, no static files, and the first `most` are kept.
    """
    found = parse(files)
    at = starts.groupBy("url").agg(F.min(F.array(F.col("seq").cast("int"))).alias("order"))
    seen, pages = at.select("url"), None
    for depth in range(DEPTH + 1):
        here = at.join(found, "url").select("kind", "loc", F.concat("order", F.array("pos")).alias("order"))
        level = here.where("kind = 'page'").select("loc", F.lit(depth).alias("depth"), "order")
        pages = level if pages is None else pages.union(level)
        at = here.where("kind = 'sitemap'").groupBy(F.col("loc").alias("url")).agg(F.min("order").alias("order")).join(seen, "url", "left_anti")
        seen = seen.union(at.select("url"))
    pages = pages.withColumn("url", U.normalized(F.col("loc"))).where("url is not null")
    pages = pages.where(U.same_domain(F.col("url"), allowed) & U.crawlable(F.col("url")))
    firsts = pages.groupBy("url").agg(F.min(F.struct("depth", "order")).alias("at")).orderBy("at", "url").limit(min(most, MOST))
    rank = F.row_number().over(Window.orderBy("at", "url"))  # at most MOST rows
    return firsts.select("url", rank.alias("rank"))
