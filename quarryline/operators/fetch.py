"""Fetching as decisions over recorded attempts: retries, redirects, what is refused, and when to render."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls as U

# Content types that are read, statuses that are followed and those that are tried again.
CONTENT_TYPES = ["text/html", "application/xhtml+xml", "text/plain", "text/xml", "application/xml"]
REDIRECTS = [301, 302, 303, 307, 308]
BUSY = [502, 503, 504]
#: Retries after the first attempt, redirects, bytes of a body, and seconds: waited by default, at most, and before the first retry.
RETRIES, MOST_REDIRECTS, MOST_BYTES = 2, 5, 10 << 20
WAIT, MOST_WAIT, BACKOFF = 2.0, 15.0, 0.5
#: Stripped characters below which an empty application shell is rendered, and what marks one.
SHELL_CHARS, SHELL_MARK = 500, 'id="root"'


def type_allowed(content_type: Column) -> Column:
    """Whether a content type starts like one that is read; none at all is allowed."""
    kind = F.lower(F.btrim(F.substring_index(F.coalesce(content_type, F.lit("")), ";", 1)))
    test = kind == ""
    for t in CONTENT_TYPES:
        test = test | kind.startswith(t)
    return test


def fetch_outcome(status: Column, content_type: Column, length: Column, most: int = MOST_BYTES) -> Column:
    """ok, redirect, retry, too_large, bad_type or failed for one recorded response."""
    return (
        F.when(status.isin(REDIRECTS), "redirect").when(status.isin(429, *BUSY), "retry")
        .when(~type_allowed(content_type), "bad_type").when(length > most, "too_large").when(status.between(200, 299), "ok").otherwise("failed")
    )


def retry_after(header: Column, at: Column) -> Column:
    """Seconds to wait after a 429: the header's number, or until its date; WAIT for none, MOST_WAIT at most."""
    date = F.try_to_timestamp(F.regexp_extract(header, r"([0-9]{1,2} [A-Za-z]{3} [0-9]{4} [0-9:]{8})", 1), F.lit("d MMM yyyy HH:mm:ss"))
    until = F.when(date.isNotNull(), F.greatest((F.unix_micros(date) - F.unix_micros(at)) / 1e6, F.lit(0.0)))
    number = F.when(header.rlike(r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)\s*$"), F.btrim(header).try_cast("double"))
    return F.least(F.coalesce(number, until, F.lit(WAIT)), F.lit(MOST_WAIT))


def attempt_steps(attempts: DataFrame) -> DataFrame:
    """attempts (request, hop, attempt, at, status, error, timeout, retry_after, ...) with `again` and `wait`.

    timeout marks a refused connection or a timeout; other errors are not tried
    again. A 429 is waited out even after the last attempt, so a hop may end
    without a response.
    """
    last, status = F.col("attempt") >= RETRIES, F.col("status")
    slow = F.col("error").isNotNull() & F.col("timeout")
    busy = F.col("error").isNull() & status.isin(BUSY)
    limited = F.col("error").isNull() & (status == 429)
    wait = F.when(limited, retry_after(F.col("retry_after"), F.col("at"))).when((slow | busy) & ~last, BACKOFF * F.pow(F.lit(2.0), F.col("attempt")))
    again = limited | ((slow | busy) & ~last)
    return attempts.withColumn("again", F.coalesce(again, F.lit(False))).withColumn("wait", F.coalesce(wait, F.lit(0.0)))


def hops(attempts: DataFrame) -> DataFrame:
    """request, hop, url, n_attempts, waited, response (status, content_type, length, location; null without one), error of each hop."""
    steps = attempt_steps(attempts.where(F.col("attempt") <= RETRIES))
    key = ["request", "hop"]
    ends = steps.groupBy(*key).agg(F.coalesce(F.min(F.when(~F.col("again"), F.col("attempt"))), F.lit(RETRIES)).alias("end"))
    made = steps.join(ends, key).where("attempt <= end")
    response = F.when(~F.col("again") & F.col("error").isNull(), F.struct("status", "content_type", "length", "location"))
    return made.groupBy(*key).agg(
        F.min_by("url", "attempt").alias("url"),
        F.count(F.lit(1)).alias("n_attempts"),
        F.sum("wait").alias("waited"),
        F.max_by(response, F.when(response.isNotNull(), F.col("attempt"))).alias("response"),
        F.max_by("error", F.when(F.col("error").isNotNull(), F.col("attempt"))).alias("error"),
    )


def fetched(attempts: DataFrame, unsafe: DataFrame | None = None) -> DataFrame:
    """request, url, status, error, redirects, n_attempts, waited: how each recorded request ends.

    attempts as for attempt_steps, with url, content_type, length (the larger of
    header and body) and location. unsafe (host) lists hosts that are refused
    before anything is sent. A request ends at its first hop that is no followed
    redirect, at the latest after MOST_REDIRECTS redirects. A redirect without
    a place to go counts as too many. A request without a recorded end after a
    redirect ends there, without a status or an error.
    """
    each = hops(attempts)
    host = U.domain(F.col("url"))
    if unsafe is None:
        each = each.withColumn("refused", F.lit(False))
    else:
        hosts = unsafe.select(F.col("host").alias("u_host")).distinct()
        each = each.join(hosts, host == F.col("u_host"), "left").withColumn("refused", F.col("u_host").isNotNull()).drop("u_host")
    r = F.col("response")
    moved = r["status"].isin(REDIRECTS)
    too_many = F.lit(f"Exceeded maximum redirects limit of {MOST_REDIRECTS}")
    error = (
        F.when(host == "", F.concat(F.lit("Invalid URL hostname: "), F.col("url")))
        .when(F.col("refused"), F.lit("Blocked by SSRF protection"))
        .when(r.isNull(), F.concat(F.lit("Connection failed: "), F.coalesce("error", F.lit("None"))))
        .when(moved & (r["location"].isNull() | (r["location"] == "") | (F.col("hop") >= MOST_REDIRECTS)), too_many)
        .when(moved, None)
        .when(~type_allowed(r["content_type"]), F.concat(F.lit("Excluded content type: "), F.lower(F.btrim(F.substring_index(r["content_type"], ";", 1)))))
        .when(r["length"] > MOST_BYTES, F.lit("Response exceeded size limit"))
    )
    early = (host == "") | F.col("refused")
    done = early | r.isNull() | ~moved | error.isNotNull()
    status = F.when(early | r.isNull() | moved, 0).otherwise(r["status"])
    each = each.select(
        "request", "hop", "url", error.alias("error"), F.coalesce(done, F.lit(True)).alias("done"), status.alias("status"),
        F.when(early, 0).otherwise(F.col("n_attempts")).alias("n_attempts"), F.when(early, 0.0).otherwise(F.col("waited")).alias("waited"),
    )
    ends = each.groupBy("request").agg(F.min(F.when(F.col("done"), F.col("hop"))).alias("end"))
    used = each.join(ends, "request").where("end is null or hop <= end")
    final = F.max(F.struct("hop", "url", F.when(F.col("done"), F.col("status")).alias("status"), "error"))
    return used.groupBy("request").agg(final.alias("f"), F.sum("n_attempts").alias("n_attempts"), F.sum("waited").alias("waited")).select(
        "request", "f.url", "f.status", "f.error", F.col("f.hop").cast("long").alias("redirects"), "n_attempts", "waited"
    )


def needs_render(content: Column) -> Column:
    """Whether a page is the shell of an application that only a browser fills."""
    stripped = F.regexp_replace(content, r"(?U)^\s+|\s+$", "")
    return F.coalesce((F.length(stripped) < SHELL_CHARS) & F.contains(content, F.lit(SHELL_MARK)), F.lit(False))
