"""Contacts, their sources and pages: global dedup, listing, search, paging and exports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ["type", "normalized_value"]
#: Characters of a context that are kept, rows of an export and of a page of results at most.
CONTEXT, EXPORT_MOST, PAGE_MOST = 500, 50_000, 500
FIRST = ["value", "job", "page", "source_type", "context", "created_at"]


def dedup(found: DataFrame, order: list[str]) -> DataFrame:
    """One row for each (type, normalized_value), over all jobs.

    value, job, page, source_type, context (cut to CONTEXT characters) and
    created_at, as far as found has them, are those of the first arrival by
    `order`; the confidence is the best, the country the first that is given.
    """
    first = F.struct(*order)
    here = F.nullif("country", F.lit(""))
    names = [c for c in FIRST if c in found.columns]
    taken = F.struct(*[F.substring(c, 1, CONTEXT).alias(c) if c == "context" else F.col(c) for c in names])
    one = found.groupBy(*KEY).agg(
        F.min_by(taken, first).alias("f"), F.max("confidence").alias("confidence"), F.min_by(here, F.when(here.isNotNull(), first)).alias("country")
    )
    return one.select(*KEY, *[f"f.{c}" for c in names], "confidence", "country")


def identity(*parts: str) -> Column:
    """An id that is made from a row's natural key."""
    return F.sha2(F.concat_ws("\n", *parts), 256).substr(1, 32)


def contact_rows(contacts: DataFrame) -> DataFrame:
    """The table of contacts: id, type, value, normalized_value, country, confidence, created_at."""
    return contacts.select(identity(*KEY).alias("id"), "type", "value", "normalized_value", "country", "confidence", "created_at")


def source_rows(contacts: DataFrame) -> DataFrame:
    """The table of sources, the first of each contact: id, contact_id, page_id, crawl_job_id, context, source_type, created_at."""
    own = identity(*KEY)
    return contacts.select(own.alias("id"), own.alias("contact_id"), F.col("page").alias("page_id"), F.col("job").alias("crawl_job_id"), "context", "source_type", "created_at")


def listing(contacts: DataFrame, sources: DataFrame, pages: DataFrame) -> DataFrame:
    """Contacts with their source and its page: the ten columns of a result, and job (of the source, so a contact is listed under the job that saw it first)."""
    s = sources.select("contact_id", "page_id", F.col("crawl_job_id").alias("job"), "context", "source_type", F.col("created_at").alias("seen_at"))
    p = pages.select(F.col("id").alias("page_id"), "url")
    joined = contacts.join(s, contacts["id"] == s["contact_id"]).join(p, "page_id")
    return joined.select("id", "type", "value", "normalized_value", "country", "confidence", "source_type", "context", "url", F.col("seen_at").alias("created_at"), "job")


def new_by_job(contacts: DataFrame) -> DataFrame:
    """Contacts that each job saw first, by type."""
    count = lambda t: F.count_if(F.col("type") == t).alias(f"{t}s")
    return contacts.groupBy("job").agg(count("email"), count("phone"), count("linkedin"))


def search(contacts: DataFrame, type: str | None = None, job: str | None = None, text: str | None = None) -> DataFrame:
    """Contacts under all given conditions; text is matched anywhere in value, normalized value or page url, in any case, with % and _ as wild cards."""
    tests = []
    if type:
        tests.append(F.col("type") == type)
    if job:
        tests.append(F.col("job") == job)
    if text:
        tests.append(reduce(lambda a, b: a | b, [F.col(c).ilike(f"%{text}%") for c in ("value", "normalized_value", "url" if "url" in contacts.columns else "page")]))
    return reduce(lambda df, t: df.where(t), tests, contacts)


def total(rows: DataFrame) -> DataFrame:
    """The count before paging."""
    return rows.agg(F.count(F.lit(1)).alias("total"))


def page(rows: DataFrame, order: list, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of rows; the order should end with a key."""
    return rows.orderBy(*order).offset(offset).limit(max(1, min(limit, PAGE_MOST)))


def newest(rows: DataFrame, most: int = EXPORT_MOST) -> DataFrame:
    """What an export holds: the newest rows, then by id."""
    return rows.orderBy(F.desc("created_at"), "id").limit(most)


def export(rows: DataFrame) -> DataFrame:
    """The eight columns of the CSV export, all strings; nulls are empty, confidence has two decimals. write_csv writes them."""
    text = lambda c, name=None: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name or c)
    return rows.select(
        "type", text("value"), text("normalized_value", "normalized"), text("country"), F.format_string("%.2f", "confidence").alias("confidence"),
        text("source_type"), text("url", "source_url"), text("context"),
    )


def write_csv(rows: DataFrame, folder: str) -> None:
    """CSV with a header, quotes doubled inside quotes, and CRLF."""
    export(rows).write.mode("overwrite").csv(folder, header=True, escape='"', emptyValue="", lineSep="\r\n")


def json_objects(rows: DataFrame) -> DataFrame:
    """Each contact as a JSON object of nine fields; nulls are kept, confidence has two decimals, times are ISO."""
    fields = [
        F.col("type"), F.col("value"), F.col("normalized_value").alias("normalized"), F.col("country"), F.round("confidence", 2).alias("confidence"),
        F.col("source_type"), F.col("url").alias("source_url"), F.col("context"), F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss").alias("created_at"),
    ]
    return rows.select(*KEY, F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("object"))


def export_json(rows: DataFrame, most: int = EXPORT_MOST) -> DataFrame:
    """One row, json: an array of the first `most` contacts by key."""
    first = json_objects(rows).orderBy(*KEY).limit(most).agg(F.array_sort(F.collect_list(F.struct(*KEY, "object"))).alias("all"))
    return first.select(F.concat(F.lit("["), F.array_join(F.transform("all", lambda x: x["object"]), ",\n  "), F.lit("]")).alias("json"))
