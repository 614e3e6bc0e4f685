"""Crawl jobs: their state, counters and figures; pages as they are stored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COUNTERS = ["pages_crawled", "pages_failed", "emails_found", "phones_found", "linkedin_found"]
#: Upper edges of the response time histogram, in seconds (fixed values).
EDGES = [0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0]
PAGE = ["id", "crawl_job_id", "url", "status_code", "content_type", "depth", "title", "content_hash", "response_time_ms", "crawled_at"]


def after(updates: DataFrame, order: list[str]) -> DataFrame:
    """Each job after its updates (job, status, error_message, started_at, completed_at and deltas of COUNTERS).

    The status and the three others are as last given; a null leaves what was
    there. Counters are the sums of their deltas, null for none.
    """
    at = F.struct(*order)
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), at)).alias(c)
    return updates.groupBy("job").agg(
        *[last(c) for c in ("status", "error_message", "started_at", "completed_at")], *[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in COUNTERS]
    )


def statistics(jobs: DataFrame, contacts: DataFrame) -> DataFrame:
    """The nine figures of the system in one row: jobs by status and their pages; contacts by type."""
    status, kind = F.col("status"), F.col("type")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c)
    one = jobs.agg(
        F.count(F.lit(1)).alias("total_crawls"), F.count_if(status == "running").alias("active_crawls"), F.count_if(status == "completed").alias("completed_crawls"),
        F.count_if(status == "failed").alias("failed_crawls"), total("pages_crawled"), total("pages_failed"),
    )
    two = contacts.agg(*[F.count_if(kind == t).alias(n) for t, n in (("email", "emails_found"), ("phone", "phones_found"), ("linkedin", "linkedin_found"))])
    return one.crossJoin(two)  # one row each


def metrics(fetches: DataFrame) -> DataFrame:
    """metric, domain, label, value: the labelled counters and the response time histogram.

    fetches: domain, status, error, seconds, n_bytes, denied (by robots),
    waited (for its turn), emails, phones, linkedins (new contacts of the page).
    A denied request is nothing else. A histogram's buckets are cumulative.
    """
    ok = F.col("error").isNull() & F.col("status").between(200, 299)
    sent = ~F.col("denied")
    item = lambda metric, label, value, when: F.when(when, F.struct(F.lit(metric).alias("metric"), label.alias("label"), value.cast("double").alias("value")))
    none, one = F.lit(""), F.lit(1)
    items = [
        item("pages_crawled", F.col("status").cast("string"), one, sent & ok),
        item("pages_failed", F.coalesce("error", F.concat(F.lit("HTTP_"), F.col("status").cast("string"))), one, sent & ~ok),
        item("bytes_downloaded", none, F.col("n_bytes"), sent & ok),
        item("robots_denied", none, one, F.col("denied")),
        item("rate_limit_events", none, one, sent & (F.col("waited") > 0)),
        *[item(f"{c}_found", none, F.col(c), sent & ok & (F.col(c) > 0)) for c in ("emails", "phones", "linkedins")],
        *[item("response_seconds_bucket", F.lit(str(e)), (F.col("seconds") <= e).cast("int"), sent) for e in EDGES],
        item("response_seconds_bucket", F.lit("+Inf"), one, sent),
        item("response_seconds_sum", none, F.col("seconds"), sent),
    ]
    each = fetches.select("domain", F.explode(F.filter(F.array(*items), lambda x: x.isNotNull())).alias("x"))
    return each.groupBy("x.metric", "domain", "x.label").agg(F.sum("x.value").alias("value"))


def page_rows(pages: DataFrame) -> DataFrame:
    """Pages as they are stored, with an id made from job and url; failed ones have neither title nor hash."""
    key = F.sha2(F.concat_ws("\n", "crawl_job_id", "url"), 256).substr(1, 32)
    return pages.withColumn("id", key).select(*PAGE)


def append_pages(pages: DataFrame, folder: str) -> None:
    page_rows(pages).write.mode("append").parquet(folder)


def listed(rows: DataFrame, order: list[Column | str], limit: int = 50, offset: int = 0, most: int = 200) -> DataFrame:
    """A page of rows, each with the total of all rows; the order should end with a key."""
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    return rows.orderBy(*order).offset(offset).limit(max(1, min(limit, most))).crossJoin(F.broadcast(total))  # one row
