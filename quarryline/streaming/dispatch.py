"""Crawl requests as a stream of JSON lines, and the jobs they become."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import exists

REQUEST = (
    "job string, start_url string, max_pages int, max_depth int, requests_per_second double, concurrency int, respect_robots_txt boolean, "
    "include_subdomains boolean, follow_external_links boolean, enable_browser boolean, allowed_domains array<string>, user_agent string"
)
#: Field, default, least, greatest (fixed values).
BOUNDS = [("max_pages", 500, 1, 10_000), ("max_depth", 5, 0, 20), ("requests_per_second", 2.0, 0.1, 20.0), ("concurrency", 5, 1, 20)]


def requests(spark: SparkSession, folder: str) -> DataFrame:
    """The stream of files of JSON lines in a folder."""
    return spark.readStream.schema(REQUEST).json(folder)


def jobs(found: DataFrame) -> DataFrame:
    """Requests as queued jobs, missing fields by default; what is out of bounds, or has no http(s) URL, has status `rejected`."""
    good = F.coalesce(F.col("start_url").rlike(r"^https?://[^/\s]"), F.lit(False))
    for name, default, low, high in BOUNDS:
        found = found.withColumn(name, F.coalesce(name, F.lit(default)))
        good = good & F.col(name).between(low, high)
    return found.select("job", "start_url", *[b[0] for b in BOUNDS], F.when(good, "queued").otherwise("rejected").alias("status"))


def dispatch(found: DataFrame, folder: str) -> DataFrame:
    """Runs the stream of requests until it has no new rows; all jobs so far. A restart continues from folder/state."""
    sink = jobs(found).writeStream.format("parquet").option("path", f"{folder}/jobs").option("checkpointLocation", f"{folder}/state")
    sink.trigger(availableNow=True).start().awaitTermination()
    schema, spark = jobs(found).schema, found.sparkSession
    return spark.read.schema(schema).parquet(f"{folder}/jobs") if exists(spark, f"{folder}/jobs") else spark.createDataFrame([], schema)
