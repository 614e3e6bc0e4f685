"""Contacts, sources, pages and jobs as tables: dedup, joins, lists, exports, sinks and figures. With SQL that states the rules anew."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import contacts as C
from ..functions import html as H
from ..functions import urls as U
from ..operators import contacts as O
from ..operators import jobs as J
from ..operators import pages as G
from ..session import settle, shared_folder
from ..sources.tables import in_oracle, recorded, sql_values, table, values
from ..streaming import contacts as stream
from ..streaming import dispatch

#: Contacts arrive by document, then place; a document is seen a second after the one before.
ARRIVAL = ["doc_id", "pattern", "nth"]
EPOCH = 1_704_067_200
PAGES_SQL = "SELECT CAST(doc_id AS STRING) AS id, 'https://' || coalesce(source, 'none') || '.org/' || doc_id AS url FROM {documents}"
UPDATES_SQL = """SELECT user_id AS job, event_id, CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'running' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' END AS status,
    CASE WHEN event_type = 'error' THEN props END AS error_message, CASE WHEN event_type = 'view' THEN event_id END AS started_at,
    CASE WHEN event_type IN ('purchase', 'error') THEN event_id END AS completed_at, CASE WHEN event_type = 'click' THEN 1 END AS pages_crawled,
    CASE WHEN event_type = 'error' THEN 1 END AS pages_failed, CASE WHEN event_type = 'click' THEN event_id % 3 END AS emails_found,
    CASE WHEN event_type = 'click' THEN event_id % 2 END AS phones_found, CAST(NULL AS INT) AS linkedin_found FROM {events}"""
FETCHES_SQL = """SELECT 'h' || (l_suppkey % 20) || '.org' AS domain, CASE l_partkey % 5 WHEN 0 THEN 404 WHEN 1 THEN 301 ELSE 200 END AS status,
    CASE WHEN l_partkey % 7 = 0 THEN 'Connection failed: timed out' END AS error, l_discount * 100 AS seconds, CAST(floor(l_extendedprice) AS BIGINT) AS n_bytes,
    l_linenumber = 7 AS denied, CAST(l_partkey % 3 AS DOUBLE) AS waited, l_partkey % 2 AS emails, l_partkey % 4 AS phones, 0 AS linkedins FROM {lineitem}"""
REQUESTS = [
    {"job": "a", "start_url": "https://a.org/"}, {"job": "b", "start_url": "http://b.org", "max_pages": 10, "max_depth": 0, "requests_per_second": 0.5, "allowed_domains": ["b.org"]},
    {"job": "c", "start_url": "ftp://c.org/"}, {"job": "d", "start_url": "https://d.org/", "max_pages": 10001}, {"job": "e"},
]


def _arrivals(docs: DataFrame) -> DataFrame:
    return G.text_contacts(docs).withColumn("created_at", F.timestamp_seconds(F.lit(EPOCH) + F.col("doc_id")))


def _deduped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.dedup(_arrivals(table(spark, sf_dir, "documents")), ARRIVAL)


def _listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = settle(_deduped(spark, sf_dir))  # both tables are made from it, and the texts are read once
    return O.listing(O.contact_rows(one), O.source_rows(one), recorded(spark, sf_dir, PAGES_SQL, "documents"))


def _plain(rows: DataFrame) -> DataFrame:
    """Times as texts."""
    return rows.withColumn("created_at", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss"))


def contacts_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Emails, obfuscated emails, phone numbers and profiles in the whole texts of documents, one row each."""
    return _plain(_deduped(spark, sf_dir))


def contacts_new_per_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.new_by_job(_deduped(spark, sf_dir))


def contacts_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contacts with their source and its page."""
    return _plain(_listing(spark, sf_dir))


def contacts_list_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One kind of contact, of one job, that a text is found in."""
    return _plain(O.search(_listing(spark, sf_dir), type="phone", text="5_5"))


def contacts_by_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(O.search(_listing(spark, sf_dir), job="src1", text="COM"))


def contacts_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.total(O.search(_listing(spark, sf_dir), text="example"))


def contacts_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(O.page(_listing(spark, sf_dir), [F.desc("created_at"), "id"], 50, 2))


def contact_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(O.source_rows(_deduped(spark, sf_dir)))


def export_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.export(O.newest(_listing(spark, sf_dir)))


def export_csv_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The export written as CSV and read again."""
    folder = f"{shared_folder(spark)}/export_{uuid.uuid4().hex}"
    O.write_csv(O.newest(_listing(spark, sf_dir)), folder)
    read = spark.read.csv(folder, header=True, escape='"', multiLine=True, lineSep="\r\n")
    return read.na.fill("")


def export_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.json_objects(O.newest(_listing(spark, sf_dir)))


def export_json_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole export as one array, read back as rows."""
    text = O.export_json(_listing(spark, sf_dir))
    kind = "array<struct<type:string,value:string,normalized:string,country:string,confidence:double,source_type:string,source_url:string,context:string,created_at:string>>"
    return text.select(F.explode(F.from_json("json", kind)).alias("x")).select("x.*")


def contacts_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same contacts as contacts_dedup, from documents read as a stream of files."""
    schema = table(spark, sf_dir, "documents").schema
    docs = spark.readStream.schema(schema).parquet(f"{sf_dir}/documents.parque[t]")
    return _plain(stream.run(_arrivals(docs), ARRIVAL, f"{shared_folder(spark)}/contacts_{uuid.uuid4().hex}"))


def dispatch_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crawl requests, read as a stream of files, as jobs."""
    folder = f"{shared_folder(spark)}/dispatch_{uuid.uuid4().hex}"
    values(spark, "value string", [(json.dumps(r),) for r in REQUESTS]).write.text(f"{folder}/in")
    return dispatch.dispatch(dispatch.requests(spark, f"{folder}/in"), folder)


def _jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = J.after(recorded(spark, sf_dir, UPDATES_SQL, "events"), ["event_id"])
    return rows.withColumns({c: F.lpad(F.col(c).cast("string"), 12, "0") for c in ("started_at", "completed_at")})


def job_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each job after all its updates."""
    return _jobs(spark, sf_dir)


def jobs_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest ten jobs after the first five, with the number of all."""
    return J.listed(_jobs(spark, sf_dir).select("job", "status", "started_at"), [F.desc_nulls_last("started_at"), "job"], 10, 5)


def system_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.statistics(_jobs(spark, sf_dir), _deduped(spark, sf_dir))


def metrics_labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.metrics(recorded(spark, sf_dir, FETCHES_SQL, "lineitem")).withColumn("value", F.round("value", 3))


def page_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as they are stored: a crawl's results appended in two writes and read again."""
    folder = f"{shared_folder(spark)}/pages_{uuid.uuid4().hex}"
    read = table(spark, sf_dir, "pages")
    job, null = F.concat(F.lit("j"), F.col("page_id") % 5), F.lit(None).cast("string")
    rows = read.select(
        F.col("page_id"), job.alias("crawl_job_id"), "url", F.lit(200).alias("status_code"), F.lit("text/html").alias("content_type"), (F.col("page_id") % 4).cast("int").alias("depth"),
        H.title(F.col("html")).alias("title"), F.sha2(F.col("html").cast("binary"), 256).alias("content_hash"), (F.col("page_id") * 1.5).cast("double").alias("response_time_ms"),
        F.timestamp_seconds(F.lit(EPOCH) + F.col("page_id")).alias("crawled_at"),
    )
    failed = F.col("page_id") % 7 == 0
    J.append_pages(rows.where(~failed), folder)
    J.append_pages(rows.where(failed).withColumns({"status_code": F.lit(503), "title": null, "content_hash": null}), folder)
    return spark.read.parquet(folder).withColumn("crawled_at", F.unix_seconds("crawled_at"))


def pages_of_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest pages of one job, with their number."""
    rows = table(spark, sf_dir, "pages").where(F.col("page_id") % 5 == 3).select("page_id", U.normalized(F.col("url")).alias("url"))
    return J.listed(rows, [F.desc("page_id")], 20, 10)


QUERIES = {
    f.__name__: f
    for f in (
        contacts_dedup, contacts_new_per_job, contacts_joined, contacts_list_search, contacts_by_job, contacts_total, contacts_page, contact_sources, export_csv,
        export_csv_file, export_json, export_json_file, contacts_stream, dispatch_stream, job_updates, jobs_page, system_stats, metrics_labelled, page_store, pages_of_job,
    )
}

_EMAIL = r"\b[[:alnum:]](?:[[:alnum:]._%+-]{0,62}[[:alnum:]])?@(?:[[:alnum:]](?:[[:alnum:]-]{0,61}[[:alnum:]])?\.)+[[:alpha:]]{2,63}\b"
_OBFUSCATED = r"\b([[:alnum:]._%+-]+)\s*(?:\[(?:at|@)\]|\(at\)|\bAT\b)\s*([[:alnum:].-]+)\s*(?:\[(?:dot|\.)\]|\(dot\)|\bDOT\b)\s*([[:alpha:]]{2,24})\b"
_NO_TLD = "png,jpg,jpeg,gif,svg,webp,bmp,ico,js,css,woff,woff2,ttf,eot,mp3,mp4,webm,zip,tar,gz,when,great,post,we,at,to,in,on,for,with,by,from,about,this,that,it,they"
_NOBODY = "sharing,sharearticle,share-offsite,login,signup,feed,jobs,learning,help,legal,pulse,posts,newsletters,events,search,checkpoint,notifications,messaging,groups,pub,in,company,school"
_NUMBER = r"[+]?[(]?\d[\d ().-]{5,18}\d"
_LINKEDIN = r"(?i)(?:https?://)?(?:[[:alnum:]-]+\.)*linkedin\.com/(?:in|company|school|showcase)/[[:alnum:]_%-]+/?"
_each = lambda pattern, number: f"SELECT doc_id, source, text, {number} AS pattern, unnest(m) AS raw, unnest(range(len(m))) AS i FROM (SELECT *, regexp_extract_all(text, '{pattern}') AS m FROM documents)"
_AROUND = r"""substr(CASE WHEN s > 0 THEN '...' ELSE '' END || trim(regexp_replace(substr(text, s + 1, e - s), '\s+', ' ', 'g')) || CASE WHEN e < length(text) THEN '...' ELSE '' END, 1, 300)"""
#: From real_numbers (raw, d: its digits, far: those of a number with a calling code) to told, as dialled from the US.
_PHONE = rf"""planned AS (SELECT n.*, p.*, CASE WHEN far IS NULL THEN d ELSE substr(far, length(code) + 1) END AS rest FROM real_numbers AS n
        LEFT JOIN {sql_values(['code', 'region', 'trunk', 'lo', 'hi'], C.PLANS).replace('AS t(', 'AS p(')} ON CASE WHEN far IS NULL THEN code = '1' ELSE starts_with(far, code) END),
    cut AS (SELECT *, CASE WHEN trunk <> '' AND starts_with(rest, trunk) AND length(rest) - length(trunk) BETWEEN lo AND hi THEN substr(rest, length(trunk) + 1) ELSE rest END AS nat FROM planned),
    told AS (SELECT *, CASE WHEN code IS NULL AND length(far) BETWEEN 8 AND 15 THEN '+' || far WHEN length(nat) BETWEEN lo AND hi OR (far IS NULL AND length(nat) = 7) THEN '+' || code || nat END AS e164,
        CASE WHEN code IS NULL THEN true WHEN code = '1' THEN regexp_matches(nat, '^[2-9]\d\d[2-9]\d{{6}}$') ELSE length(nat) BETWEEN lo AND hi AND (region = 'IT' OR NOT starts_with(nat, '0')) END AS valid,
        CASE WHEN code = '1' AND regexp_matches(nat, '^[2-9]\d\d[2-9]\d{{6}}$') AND list_contains(string_split('{','.join(C.CANADA)}', ','), substr(nat, 1, 3)) THEN 'CA' WHEN code = '1' THEN 'US'
          WHEN length(nat) BETWEEN lo AND hi AND (region = 'IT' OR NOT starts_with(nat, '0')) THEN region END AS country FROM cut)"""
#: All contacts in texts, with their place.
_FOUND = rf"""raws AS ({_each(_EMAIL, 0)} UNION ALL {_each(_OBFUSCATED, 1)} UNION ALL {_each(_NUMBER, 2)} UNION ALL {_each(_LINKEDIN, 3)}),
    mails AS (SELECT *, lower(CASE pattern WHEN 0 THEN raw ELSE regexp_replace(raw, '{_OBFUSCATED}', '\1@\2.\3') END) AS mail FROM raws WHERE pattern < 2),
    good_mails AS (SELECT doc_id, source, text, pattern, raw, i, 'email' AS type, raw AS value, mail AS normalized_value, NULL AS country, CASE pattern WHEN 1 THEN 0.75 ELSE 0.85 END AS confidence
        FROM mails WHERE NOT list_contains(string_split('{_NO_TLD}', ','), split_part(mail, '.', -1)) AND length(split_part(mail, '.', -1)) BETWEEN 2 AND 24 AND len(string_split(mail, '@')) = 2),
    numbers AS (SELECT *, regexp_replace(raw, '\D', '', 'g') AS d FROM raws WHERE pattern = 2),
    real_numbers AS (SELECT *, CASE WHEN starts_with(raw, '+') OR starts_with(raw, '(+') THEN d WHEN starts_with(d, '011') THEN substr(d, 4) END AS far FROM numbers
        WHERE length(d) BETWEEN 7 AND 15 AND NOT regexp_matches(raw, '^\s*\d\d\d\d[-/.]\d\d?[-/.]\d\d?\s*$') AND d NOT IN ('0123456789', '1234567890', '0987654321', '9876543210')
          AND d <> repeat(d[1], length(d)) AND (regexp_matches(raw, '[-()+ ]') OR (length(d) > 8 AND len(list_distinct(string_split(d, ''))) > 3))),
    {_PHONE},
    good_numbers AS (SELECT doc_id, source, text, pattern, raw, i, 'phone' AS type, raw AS value, e164 AS normalized_value,
        country, CASE WHEN starts_with(raw, '+') AND valid THEN 0.95 WHEN valid THEN 0.88 ELSE 0.75 END AS confidence FROM told WHERE e164 IS NOT NULL),
    people AS (SELECT *, lower(regexp_extract(raw, '(?i)linkedin[.]com/([a-z]+)/', 1)) AS kind, regexp_extract(raw, '(?i)linkedin[.]com/[a-z]+/([^/]+)', 1) AS slug FROM raws WHERE pattern = 3),
    good_people AS (SELECT doc_id, source, text, pattern, raw, i, 'linkedin' AS type, 'https://www.linkedin.com/' || kind || '/' || slug AS value,
        lower('https://www.linkedin.com/' || kind || '/' || slug) AS normalized_value, NULL AS country, 0.85 AS confidence
        FROM people WHERE length(slug) BETWEEN 2 AND 100 AND NOT contains(slug, '%') AND NOT list_contains(string_split('{_NOBODY}', ','), lower(slug))),
    found AS (SELECT *, (doc_id, pattern, i) AS ord, greatest(strpos(lower(text), lower(raw)) - 81, 0) AS s, least(strpos(lower(text), lower(raw)) - 1 + length(raw) + 80, length(text)) AS e
        FROM (SELECT * FROM good_mails UNION ALL SELECT * FROM good_numbers UNION ALL SELECT * FROM good_people)),
    one AS (SELECT type, normalized_value, arg_min(value, ord) AS value, arg_min(source, ord) AS job, CAST(min(doc_id) AS VARCHAR) AS page, 'body' AS source_type,
        substr(arg_min({_AROUND}, ord), 1, 500) AS context, strftime(make_timestamp(({EPOCH} + min(doc_id)) * 1000000), '%Y-%m-%d %H:%M:%S') AS created_at,
        CAST(max(confidence) AS DOUBLE) AS confidence, arg_min(country, ord) FILTER (country IS NOT NULL) AS country FROM found GROUP BY ALL),
    listing AS (SELECT substr(sha256(type || chr(10) || normalized_value), 1, 32) AS id, type, value, normalized_value, country, confidence, source_type, context, url, created_at, job
        FROM one JOIN {in_oracle(PAGES_SQL, 'documents')} AS p ON p.id = page)"""
_JOBS = f"""(SELECT job, arg_max(status, event_id) FILTER (status IS NOT NULL) AS status, arg_max(error_message, event_id) FILTER (error_message IS NOT NULL) AS error_message,
    lpad(CAST(max(started_at) AS VARCHAR), 12, '0') AS started_at, lpad(CAST(max(completed_at) AS VARCHAR), 12, '0') AS completed_at, {', '.join(f'CAST(coalesce(sum({c}), 0) AS BIGINT) AS {c}' for c in J.COUNTERS)}
    FROM {in_oracle(UPDATES_SQL, 'events')} GROUP BY job)"""
_SENT = "NOT denied AND error IS NULL AND status BETWEEN 200 AND 299"
_F = in_oracle(FETCHES_SQL, "lineitem")
_metric = lambda name, label, value, when: f"SELECT '{name}' AS metric, domain, {label} AS label, round(CAST(sum({value}) AS DOUBLE), 3) AS value FROM {_F} WHERE {when} GROUP BY ALL"
_EDGES = "0.05 0.1 0.25 0.5 1.0 2.5 5.0 10.0".split()
_ROWS = "type, value, normalized_value AS normalized, coalesce(country, '') AS country, printf('%.2f', confidence) AS confidence, source_type, url AS source_url, coalesce(context, '') AS context"
_DEDUPED = f"WITH {_FOUND} SELECT type, normalized_value, value, job, page, source_type, context, created_at, confidence, country FROM one"
ORACLE = {
    "contacts_dedup": _DEDUPED,
    "contacts_stream": _DEDUPED,
    "contacts_new_per_job": f"WITH {_FOUND} SELECT job, count(*) FILTER (type = 'email') AS emails, count(*) FILTER (type = 'phone') AS phones, count(*) FILTER (type = 'linkedin') AS linkedins FROM one GROUP BY job",
    "contacts_joined": f"WITH {_FOUND} SELECT * FROM listing",
    "contacts_list_search": f"WITH {_FOUND} SELECT * FROM listing WHERE type = 'phone' AND (value ILIKE '%5_5%' OR normalized_value ILIKE '%5_5%' OR url ILIKE '%5_5%')",
    "contacts_by_job": f"WITH {_FOUND} SELECT * FROM listing WHERE job = 'src1' AND (value ILIKE '%com%' OR normalized_value ILIKE '%com%' OR url ILIKE '%com%')",
    "contacts_total": f"WITH {_FOUND} SELECT count(*) AS total FROM listing WHERE value ILIKE '%example%' OR normalized_value ILIKE '%example%' OR url ILIKE '%example%'",
    "contacts_page": f"WITH {_FOUND} SELECT * FROM listing ORDER BY created_at DESC, id LIMIT 50 OFFSET 2",
    "contact_sources": f"WITH {_FOUND} SELECT substr(sha256(type || chr(10) || normalized_value), 1, 32) AS id, substr(sha256(type || chr(10) || normalized_value), 1, 32) AS contact_id, page AS page_id, job AS crawl_job_id, context, source_type, created_at FROM one",
    "export_csv": f"WITH {_FOUND} SELECT {_ROWS} FROM (SELECT * FROM listing ORDER BY created_at DESC, id LIMIT 50000)",
    "export_csv_file": f"WITH {_FOUND} SELECT {_ROWS} FROM (SELECT * FROM listing ORDER BY created_at DESC, id LIMIT 50000)",
    "export_json": f"""WITH {_FOUND} SELECT type, normalized_value, CAST(to_json({{'type': type, 'value': value, 'normalized': normalized_value, 'country': country, 'confidence': round(confidence, 2),
        'source_type': source_type, 'source_url': url, 'context': context, 'created_at': replace(created_at, ' ', 'T')}}) AS VARCHAR) AS object FROM listing""",
    "export_json_file": f"WITH {_FOUND} SELECT type, value, normalized_value AS normalized, country, round(confidence, 2) AS confidence, source_type, url AS source_url, context, replace(created_at, ' ', 'T') AS created_at FROM listing",
    "dispatch_stream": """SELECT * FROM (VALUES ('a', 'https://a.org/', 500, 5, 2.0::DOUBLE, 5, 'queued'), ('b', 'http://b.org', 10, 0, 0.5, 5, 'queued'), ('c', 'ftp://c.org/', 500, 5, 2.0, 5, 'rejected'),
        ('d', 'https://d.org/', 10001, 5, 2.0, 5, 'rejected'), ('e', NULL, 500, 5, 2.0, 5, 'rejected')) AS t(job, start_url, max_pages, max_depth, requests_per_second, concurrency, status)""",
    "job_updates": f"SELECT * FROM {_JOBS}",
    "jobs_page": f"SELECT job, status, started_at, (SELECT count(*) FROM {_JOBS}) AS total FROM {_JOBS} ORDER BY started_at DESC NULLS LAST, job LIMIT 10 OFFSET 5",
    "system_stats": f"""WITH {_FOUND}, jobs AS {_JOBS} SELECT count(*) AS total_crawls, count(*) FILTER (status = 'running') AS active_crawls, count(*) FILTER (status = 'completed') AS completed_crawls,
        count(*) FILTER (status = 'failed') AS failed_crawls, CAST(sum(pages_crawled) AS BIGINT) AS pages_crawled, CAST(sum(pages_failed) AS BIGINT) AS pages_failed,
        (SELECT count(*) FROM one WHERE type = 'email') AS emails_found, (SELECT count(*) FROM one WHERE type = 'phone') AS phones_found, (SELECT count(*) FROM one WHERE type = 'linkedin') AS linkedin_found FROM jobs""",
    "metrics_labelled": " UNION ALL ".join([
        _metric("pages_crawled", "CAST(status AS VARCHAR)", "1", _SENT), _metric("pages_failed", "coalesce(error, 'HTTP_' || status)", "1", f"NOT denied AND NOT ({_SENT})"),
        _metric("bytes_downloaded", "''", "n_bytes", _SENT), _metric("robots_denied", "''", "1", "denied"), _metric("rate_limit_events", "''", "1", "NOT denied AND waited > 0"),
        _metric("emails_found", "''", "emails", f"{_SENT} AND emails > 0"), _metric("phones_found", "''", "phones", f"{_SENT} AND phones > 0"),
        *[_metric("response_seconds_bucket", f"'{e}'", f"(seconds <= {e})::INT", "NOT denied") for e in _EDGES],
        _metric("response_seconds_bucket", "'+Inf'", "1", "NOT denied"), _metric("response_seconds_sum", "''", "seconds", "NOT denied")]),
    "pages_of_job": r"""WITH p AS (SELECT page_id, url FROM pages WHERE page_id % 5 = 3)
        SELECT page_id, regexp_replace(regexp_replace(split_part(split_part(url, '#', 1), '?', 1), '/$', ''), '^(https?://[^/]*)$', '\1/') ||
            CASE WHEN regexp_matches(url, '[?&]page=') THEN '?' || regexp_extract(url, 'page=[0-9]+') ELSE '' END AS url, (SELECT count(*) FROM p) AS total FROM p ORDER BY page_id DESC LIMIT 20 OFFSET 10""",
}
