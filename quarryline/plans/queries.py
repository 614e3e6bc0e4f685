"""The queries over pages, documents, events and orders, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import contacts as C
from ..functions import html as H
from ..functions import urls as U
from ..operators import contacts as O
from ..operators import pages as G
from ..sources import sitemaps
from ..sources.tables import sql_values, table, values
from . import crawl, store

ALLOWED = ["example.com"]
LINKEDIN = [
    (1, "https://www.linkedin.com/in/Jane-Doe/"), (2, "http://uk.linkedin.com/company/Acme?trk=x"), (3, "linkedin.com/school/mit_x"),
    (4, "https://www.linkedin.com/in/login"), (5, "https://www.linkedin.com/feed/x"), (6, "https://evillinkedin.com/in/abc"), (7, "https://www.linkedin.com/in/x"),
]
ANCHORS = [
    (1, "https://example.com/", '<footer><address><a href="mailto:a@example.org?subject=x">Mail <b>us</b></a></address><a href="TEL:+1 415 555 2671"></a></footer>'),
    (2, "https://example.com/x", '<header><a href="mailto:b@example.org">B</a><a href="https://www.linkedin.com/company/acme">Acme</a></header><a href="mailto:?x">none</a><a href="/y">y</a>'),
    (3, None, None),
]
SITEMAPS = [
    ("https://example.com/index.xml", '<?xml version="1.0"?><sitemapindex xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><sitemap><loc> https://example.com/a.xml </loc></sitemap>'
     "<sitemap><loc>https://example.com/b.xml</loc></sitemap><sitemap><loc>https://example.com/index.xml</loc></sitemap></sitemapindex>"),
    ("https://example.com/a.xml", "<urlset><url><loc>https://example.com/one/</loc></url><url><loc>https://blog.example.com/two?b=2&amp;a=1</loc></url><url><loc>https://else.org/x</loc></url></urlset>"),
    ("https://example.com/b.xml", "<urlset><url><loc>https://example.com/one</loc></url><url><loc>https://example.com/pic.png</loc></url><url><loc>https://example.com/three</loc></url></urlset>"),
    ("https://example.com/bad.xml", "<urlset><url><loc>https://example.com/four</loc>"), ("https://example.com/empty.xml", " "),
]
# id, base, url, normal form (by hand).
CASES = [
    (1, "https://ex.org/about/team", "../contact", "https://ex.org/contact"), (2, "", "HTTP://Ex.org:80//a//b/?utm_source=x&b=2&a=1#f", "http://ex.org/a/b?a=1&b=2"),
    (3, "", "https://ex.org/?a=%zz&b=1", "https://ex.org/?a=%25zz&b=1"), (4, "", "https://ex.org/?a=100%", "https://ex.org/?a=100%25"), (5, "", "https://ex.org/?q=~*x y", "https://ex.org/?q=~%2Ax+y"),
    (6, "", "https://ex.org/?a&b=&c=1", "https://ex.org/?c=1"), (7, "", "https://ex.org/?q=%C3%A9+%2B", "https://ex.org/?q=%C3%A9+%2B"), (8, "https://ex.org/", "mailto:a@b.org", None),
    (9, "", "https://ex.org:443/a;p=1", "https://ex.org/a"), (10, "", "https://ex.org/A%2f/%7e", "https://ex.org/A%2f/%7e"), (11, "https://ex.org/x/", "?REF=1&z=2", "https://ex.org/x?z=2"),
    (12, "", "  https://EX.org  ", "https://ex.org/"), (13, "", "https://[::1/x", None), (14, "https://ex.org/a/b/c", "./../d/./e/", "https://ex.org/a/d/e"), (15, "", "ftp://ex.org/", None),
    (16, "", "https://ex.org/?b=2&a=2&a=1&A=0", "https://ex.org/?A=0&a=1&a=2&b=2"), (17, "", "https://ex.org/?a=b=c&d=%26", "https://ex.org/?a=b%3Dc&d=%26"), (18, "", None, None),
]
PHONES = [
    (1, "020 7946 0958", "shop.co.uk", "+442079460958", "GB", True), (2, "+44 (0)20 7946 0958", "example.com", "+442079460958", "GB", True), (3, "(415) 555-2671", "example.com", "+14155552671", "US", True),
    (4, "416-555-2671", "example.ca", "+14165552671", "CA", True), (5, "1 415 555 2671", "example.com", "+14155552671", "US", True), (6, "123 456 7890", "example.com", "+11234567890", "US", False),
    (7, "555-2671", "example.com", "+15552671", "US", False), (8, "0044 20 7946 0958", "example.de", "+442079460958", "GB", True), (9, "030 901820", "example.de", "+4930901820", "DE", True),
    (10, "+91 98765 43210", "example.com", "+919876543210", "IN", True), (11, "011 44 20 7946 0958", "example.com", "+442079460958", "GB", True), (12, "+999 12345678", "example.com", "+99912345678", None, True),
    (13, "+1 123 456 7890", "example.co.uk", "+11234567890", "GB", False), (14, "12345", "example.com", None, None, None), (15, "01 23 45 67 89", "example.fr", "+33123456789", "FR", True),
    (16, "06 1234 5678", "example.it", "+390612345678", "IT", True), (17, "+44 12", "example.com", None, None, None),
]
SITE = [
    (1, "https://acme.example/", "<title>Home</title><header><h1>Acme</h1><a href='/about'>About</a></header><p>Questions: info@example.org</p><p><a href='https://www.linkedin.com/company/acme-corp'>us</a></p>"
     "<footer>Helpline +1 800 555 0199, open daily.</footer>"),
    (2, "https://acme.example/about", "<h1>About</h1><address>Head office<br>Press: press@example.org<br>Tel (555) 345-6789</address>"),
    (3, "https://acme.example/contact", "<p>Ask support@example.org or <a href='mailto:inquiries@example.org'>inquiries@example.org</a>.</p><p>Holes: security [at] example [dot] com</p>"
     "<p>Free: (555) 234-5678</p><a href='tel:+15559876543'>+1 (555) 987-6543</a><a href='tel:1234567890'>fake</a><footer>support@example.org</footer>"),
    (4, "https://acme.example/team", "<p>alice.smith@example.org, +44 20 7946 0958 <a href='https://www.linkedin.com/in/alice-smith-12345'>Alice</a></p>"
     "<p>bob.jones+dev@example.org, +91 98765 43210, https://www.linkedin.com/in/bobjones-dev</p><p>Again (555) 234-5678</p><script>hidden@example.org</script>"),
]
SITE_CONTACTS = [  # by hand
    ("email", "info@example.org", 0.85, None, "body", "1"), ("email", "press@example.org", 0.95, None, "address", "2"), ("email", "support@example.org", 0.9, None, "body", "3"),
    ("email", "inquiries@example.org", 0.99, None, "mailto", "3"), ("email", "security@example.com", 0.75, None, "body", "3"), ("email", "alice.smith@example.org", 0.9, None, "body", "4"),
    ("email", "bob.jones+dev@example.org", 0.9, None, "body", "4"), ("phone", "+18005550199", 0.95, "US", "footer", "1"), ("phone", "+15553456789", 0.92, "US", "address", "2"),
    ("phone", "+15552345678", 0.9, "US", "body", "3"), ("phone", "+15559876543", 0.98, "US", "tel", "3"), ("phone", "+442079460958", 0.95, "GB", "body", "4"), ("phone", "+919876543210", 0.95, "IN", "body", "4"),
    ("linkedin", "https://www.linkedin.com/company/acme-corp", 0.95, None, "anchor", "1"), ("linkedin", "https://www.linkedin.com/in/alice-smith-12345", 0.95, None, "anchor", "4"),
    ("linkedin", "https://www.linkedin.com/in/bobjones-dev", 0.9, None, "body", "4"),
]
SCOPES = [
    (1, "https://example.com/x/", '<link rel="Canonical" href="/about#top"><a href="y">y</a><a href="/about">again</a><a href="https://blog.example.com/b">b</a><a href="https://other.org/help">o</a>'
     '<a href="https://notexample.com/n">n</a><a href="/pic.png">p</a><a href=" ">s</a><a href="y#2">y</a><script><a href="/no">no</a></script>'),
    (2, "https://example.com/", None),
]


def url_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    return table(spark, sf_dir, "pages").select(
        "page_id", U.domain(u).alias("domain"), U.crawlable(u).alias("crawlable"), U.priority(u).alias("priority"),
        U.contact_page(u).alias("contact_page"), U.same_domain(u, ALLOWED).alias("same"), U.same_domain(u, ALLOWED, False).alias("same_exact"),
    )


def url_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", U.normalized(F.col("url")).alias("normalized"))


def html_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", H.title(F.col("html")).alias("title"))


def html_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.length(H.cleaned(F.col("html"))).cast("long").alias("n_clean"))


def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.sha2(F.col("html").cast("binary"), 256).alias("content_hash"))


def html_text_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.text_nodes(table(spark, sf_dir, "pages"))


def html_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crawlable links of each page to its host or below it, the first 200 in document order, with their rank by priority."""
    return H.links(table(spark, sf_dir, "pages"))


def html_links_scoped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of authored pages under a list of domains, without those below them, and under none."""
    pages = values(spark, "page_id long, url string, html string", SCOPES)
    here = H.links(pages, ALLOWED, subdomains=False).withColumn("scope", F.lit("exact"))
    below = H.links(pages, ALLOWED).withColumn("scope", F.lit("below"))
    return here.unionByName(below).unionByName(H.links(pages, external=True, most=4).withColumn("scope", F.lit("all")))


def url_in_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose host is in a table of domains, or below one."""
    allowed = values(spark, "domain string", [("Example.com:443",), ("example.org",), ("com",)])
    return U.in_domains(table(spark, sf_dir, "pages").select("page_id", "url"), "url", allowed.where("domain <> 'com'"))


def url_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Authored URLs that are hard to normalize, against a base."""
    rows = values(spark, "id long, base string, url string, expected string", CASES)
    return rows.select("id", U.normalized(U.joined(F.col("base"), F.col("url"))).alias("normalized"))


def page_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each page: where it is, what it is called, and what it holds."""
    u, h = F.col("url"), F.col("html")
    return table(spark, sf_dir, "pages").select(
        "page_id", "url", U.domain(u).alias("domain"), U.priority(u).cast("long").alias("priority"), H.title(h).alias("title"),
        F.size(C.emails(H.cleaned(h))).cast("long").alias("n_emails"), F.regexp_count(h, F.lit(r"(?i)<a\s[^>]*href=")).cast("long").alias("n_links"),
    )


def _emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _emails_of(table(spark, sf_dir, "documents"))


def _emails_of(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", "text", F.posexplode(C.emails(F.col("text"))).alias("pos", "value"))


def email_standard(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    return _emails(spark, sf_dir).select(
        "doc_id", F.col("pos").cast("long").alias("pos"), "value", F.lower(v).alias("normalized_value"), C.email_valid(v).alias("valid"),
        C.email_confidence(F.lit("body"), F.lit(False)).alias("confidence"),
    )


def email_obfuscated(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = values(spark, "id long, text string", [(1, "bob [at] example [dot] com or al (at) x.org (dot) uk"), (2, "ann AT site DOT org"), (3, "no at all dot com")])
    return rows.select("id", F.explode(C.obfuscated_emails(F.col("text"))).alias("e")).select("id", "e.raw", "e.email")


def phone_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = docs.select("doc_id", F.posexplode(C.phones(F.col("text"))).alias("pos", "raw"))
    rows = found.withColumn("false_positive", C.phone_false_positive(F.col("raw"))).withColumn("p", C.phone(F.col("raw"), F.lit("example.com")))
    confidence = C.phone_confidence(F.lit("body"), F.col("raw").startswith("+"), F.col("p.valid"), F.lit(False))
    return rows.select(
        "doc_id", F.col("pos").cast("long").alias("pos"), "raw", "false_positive", "p.e164", F.when(F.col("p").isNotNull(), confidence).alias("confidence"), "p.country"
    )


def phone_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Authored numbers as pages of several countries would show them."""
    rows = values(spark, "id long, raw string, host string, e164 string, country string, valid boolean", PHONES)
    return rows.select("id", C.phone(F.col("raw"), F.col("host")).alias("p")).select("id", "p.e164", "p.country", "p.valid")


def linkedin_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = values(spark, "id long, raw string", LINKEDIN).withColumn("p", C.profile(F.col("raw")))
    return rows.select("id", "p.clean", "p.normalized", "p.kind", C.profile_confidence(F.lit("anchor"), F.lit(False)).alias("confidence"))


def context_snippet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _emails(spark, sf_dir).select("doc_id", F.col("pos").cast("long").alias("pos"), C.context(F.col("text"), F.col("value")).alias("context"))


def page_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.page_contacts(table(spark, sf_dir, "pages"))


def site_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contacts of an authored site of four pages, deduplicated over them."""
    pages = values(spark, "page_id long, url string, html string", SITE)
    found = G.page_contacts(pages).withColumn("job", F.lit("j")).withColumn("page", F.col("page_id").cast("string"))
    return O.dedup(found, ["page_id", "type", "normalized_value"]).select("type", "normalized_value", "confidence", "country", "source_type", "page")


def attribute_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contacts that anchors of authored pages name, as they are written there."""
    found = H.pieces(values(spark, "page_id long, url string, html string", ANCHORS)).where("type is not null")
    return found.select("page_id", "pos", "type", F.col("text").alias("raw_value"), "source_type", "context")


def sitemap_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    starts = values(spark, "url string, seq int", [("https://example.com/index.xml", 0), ("https://example.com/bad.xml", 1)])
    return sitemaps.discover(starts, values(spark, "url string, xml string", SITEMAPS), ALLOWED)


def jobs_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest 50 orders as jobs, with a key that breaks ties."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("created_at"))
    return O.page(rows, [F.desc("created_at"), "id"], 50).select("id", "status")


def metrics_by_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").groupBy(U.domain(F.col("url")).alias("domain")).agg(
        F.count(F.lit(1)).alias("pages_crawled"), F.sum(F.octet_length("html")).cast("long").alias("bytes"))


def latency_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = [0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0]
    counts = [F.count_if(F.col("value") <= e).alias(f"le_{i}") for i, e in enumerate(edges)]
    return table(spark, sf_dir, "events").groupBy("event_type").agg(*counts, F.count(F.lit(1)).alias("n"))


def job_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    return rows.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("status"))


OWN = {
    f.__name__: f
    for f in (
        page_report, url_functions, url_normalize, url_cases, url_in_domains, html_title, html_clean, content_hash, html_text_nodes, html_links, html_links_scoped, email_standard,
        email_obfuscated, phone_candidates, phone_cases, linkedin_parse, context_snippet, page_contacts, site_contacts, attribute_contacts, sitemap_discovery,
        jobs_list, metrics_by_domain, latency_histogram, job_status,
    )
}
QUERIES = OWN | store.QUERIES | crawl.QUERIES

_DOMAIN = r"regexp_extract(lower(url), '^[a-z]+://([^/?#:]*)', 1)"
_PATH = r"regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1)"
_unescape = lambda x: f"""replace(replace(replace(replace({x}, '&quot;', '"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&')"""
_strip = lambda x: rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"
_TITLE = _strip(_unescape(r"regexp_extract(html, '(?is)<title[^>]*>([^<]*)</title', 1)"))
_HEAD = _strip(_unescape(r"regexp_replace(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1', 1), '(?s)<[^>]*>', '', 'g')"))
_NAMED = f"CASE WHEN regexp_matches(html, '(?is)<title[^>]*>[^<]') THEN {_TITLE} WHEN regexp_matches(html, '(?i)<h1') THEN {_HEAD} END"
_CONTACT = "regexp_matches(lower(path), 'contact|about|team|company|support|help|customer-service|reach-us|location|staff|people')"
_PRIORITY = f"CASE WHEN {_CONTACT} THEN 100 ELSE 50 - least(5 * len(list_filter(string_split(path, '/'), lambda s: s <> '')), 40) END"
_STATIC = r"[.](png|jpe?g|gif|svg|ico|webp|bmp|tiff|mp[34]|wav|avi|mov|wmv|webm|zip|tar|gz|7z|rar|bz2|exe|dmg|app|deb|rpm|apk|css|m?js|json|woff2?|ttf|eot)$"
_DENIED = "utm_source,utm_medium,utm_campaign,utm_term,utm_content,fbclid,gclid,msclkid,mc_cid,mc_eid,ref,source"
_VALID = (
    r"(regexp_matches(value, '^[^@ \r\n]+@[^@ \r\n]+$') AND contains(string_split(value, '@')[2], '.')"
    f" AND NOT list_contains(string_split('{store._NO_TLD}', ','), lower(string_split(value, '.')[-1])) AND length(string_split(value, '.')[-1]) BETWEEN 2 AND 24)"
)
_EMAILS = f"""(SELECT doc_id, source, text, unnest(m) AS value, CAST(unnest(range(len(m))) AS BIGINT) AS pos
    FROM (SELECT doc_id, source, text, regexp_extract_all(text, '{store._EMAIL}') AS m FROM documents))"""
_FALSE = r"""(n < 7 OR n > 15 OR regexp_matches(raw, '^\s*[0-9]{4}[-/.][0-9]{1,2}[-/.][0-9]{1,2}\s*$')
    OR d IN ('0123456789', '1234567890', '0987654321', '9876543210') OR d = repeat(d[1], n)
    OR (NOT regexp_matches(raw, '[-() +]') AND (n <= 8 OR len(list_distinct(string_split(d, ''))) <= 3)))"""
_CLEAN = "html"
for _tag in ("script", "style", "noscript", "svg", "canvas", "iframe", "template"):
    _CLEAN = rf"regexp_replace({_CLEAN}, '(?is)<{_tag}\b[^>]*>.*?</{_tag}\s*>', '', 'g')"

ORACLE = {
    "page_report": rf"""SELECT page_id, url, {_DOMAIN} AS domain, CAST({_PRIORITY} AS BIGINT) AS priority, {_NAMED} AS title,
        CAST(len(regexp_extract_all({_CLEAN}, '{store._EMAIL}')) AS BIGINT) AS n_emails, CAST(len(regexp_extract_all(html, '(?i)<a\s[^>]*href=')) AS BIGINT) AS n_links
        FROM (SELECT *, {_PATH} AS path FROM pages)""",
    "url_functions": f"""SELECT page_id, {_DOMAIN} AS domain, NOT regexp_matches(lower(path), '{_STATIC}') AS crawlable,
        CAST({_PRIORITY} AS INTEGER) AS priority, {_CONTACT} AS contact_page,
        {_DOMAIN} = 'example.com' OR ends_with({_DOMAIN}, '.example.com') AS same, {_DOMAIN} = 'example.com' AS same_exact
        FROM (SELECT *, {_PATH} AS path FROM pages)""",
    "url_in_domains": f"SELECT page_id, url FROM pages WHERE regexp_matches({_DOMAIN}, '(^|[.])example[.](com|org)$')",
    "url_cases": f"SELECT CAST(id AS BIGINT) AS id, expected AS normalized FROM {sql_values(['id', 'base', 'url', 'expected'], CASES)}",
    "url_normalize": rf"""SELECT page_id, scheme || '://' || host || CASE WHEN p = '' THEN '/' ELSE p END || CASE WHEN q = '' THEN '' ELSE '?' || q END AS normalized
        FROM (SELECT page_id, regexp_extract(lower(url), '^([a-z]+)://', 1) AS scheme, regexp_extract(lower(url), '^[a-z]+://([^/?#]*)', 1) AS host,
              regexp_replace(regexp_replace({_PATH}, '/+', '/', 'g'), '(.)/$', '\1') AS p,
              array_to_string(list_sort(list_filter(string_split(regexp_extract(url, '\?([^#]*)', 1), '&'),
                lambda x: contains(x, '=') AND NOT list_contains(string_split('{_DENIED}', ','), lower(string_split(x, '=')[1])))), '&') AS q FROM pages)""",
    "html_title": f"SELECT page_id, {_NAMED} AS title FROM pages",
    "page_store": f"""SELECT substr(sha256('j' || page_id % 5 || chr(10) || url), 1, 32) AS id, 'j' || page_id % 5 AS crawl_job_id, url, CASE WHEN page_id % 7 = 0 THEN 503 ELSE 200 END AS status_code,
        'text/html' AS content_type, CAST(page_id % 4 AS INTEGER) AS depth, CASE WHEN page_id % 7 > 0 THEN {_NAMED} END AS title, CASE WHEN page_id % 7 > 0 THEN sha256(html) END AS content_hash,
        CAST(page_id * 1.5 AS DOUBLE) AS response_time_ms, {store.EPOCH} + page_id AS crawled_at FROM pages""",
    "html_clean": f"SELECT page_id, CAST(length({_CLEAN}) AS BIGINT) AS n_clean FROM pages",
    "html_text_nodes": rf"""WITH t AS (SELECT page_id, unnest(x) AS tok, unnest(range(len(x))) AS k
          FROM (SELECT page_id, regexp_extract_all(regexp_replace(html, '(?s)<(script|style)\b.*?</(script|style)>', '', 'g'), '(?s)<!--.*?-->|<[^>]*>|[^<]+') AS x FROM pages)),
        n AS (SELECT page_id, k, sum(CASE WHEN tok LIKE '<footer%' THEN 1 WHEN tok LIKE '</footer%' THEN -1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY k) AS inside,
            {_strip(f"CASE WHEN tok LIKE '<!--%' THEN substr(tok, 5, length(tok) - 7) WHEN tok NOT LIKE '<%' THEN {_unescape('tok')} ELSE '' END")} AS text FROM t)
        SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY k) - 1 AS INTEGER) AS pos, text, CASE WHEN inside > 0 THEN 'footer' ELSE 'body' END AS source_type FROM n WHERE text <> ''""",
    "html_links": rf"""WITH l AS (SELECT page_id, regexp_extract(lower(url), '^[a-z]+://[^/?#]*') AS site, unnest(x) AS path, unnest(range(len(x))) AS k
          FROM (SELECT *, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS x FROM pages)),
        u AS (SELECT page_id, site || path AS url, min(path) AS path, min(k) AS k FROM l WHERE NOT regexp_matches(lower(path), '{_STATIC}') GROUP BY page_id, site || path),
        p AS (SELECT *, {_PRIORITY} AS priority, row_number() OVER (PARTITION BY page_id ORDER BY k) AS nth FROM u)
        SELECT page_id, url, 'anchor' AS kind, CAST(priority AS INTEGER) AS priority, CAST(row_number() OVER (PARTITION BY page_id ORDER BY priority DESC, k) AS INTEGER) AS rank FROM p WHERE nth <= 200""",
    "html_links_scoped": """SELECT CAST(page_id AS BIGINT) AS page_id, url, kind, priority, rank, scope FROM (VALUES
        (1, 'https://example.com/about', 'canonical', 110, 1, 'exact'), (1, 'https://example.com/x/y', 'anchor', 40, 2, 'exact'),
        (1, 'https://example.com/about', 'canonical', 110, 1, 'below'), (1, 'https://blog.example.com/b', 'anchor', 45, 2, 'below'), (1, 'https://example.com/x/y', 'anchor', 40, 3, 'below'),
        (1, 'https://example.com/about', 'canonical', 110, 1, 'all'), (1, 'https://other.org/help', 'anchor', 100, 2, 'all'), (1, 'https://blog.example.com/b', 'anchor', 45, 3, 'all'),
        (1, 'https://example.com/x/y', 'anchor', 40, 4, 'all')) AS t(page_id, url, kind, priority, rank, scope)""",
    "content_hash": "SELECT page_id, sha256(html) AS content_hash FROM pages",
    "email_standard": f"SELECT doc_id, pos, value, lower(value) AS normalized_value, {_VALID} AS valid, CAST(0.85 AS DOUBLE) AS confidence FROM {_EMAILS}",
    "email_obfuscated": "SELECT * FROM (VALUES (1::BIGINT, 'bob [at] example [dot] com', 'bob@example.com'), (1, 'al (at) x.org (dot) uk', 'al@x.org.uk'), (2, 'ann AT site DOT org', 'ann@site.org')) AS t(id, raw, email)",
    "phone_candidates": f"""WITH real_numbers AS (SELECT *, CASE WHEN starts_with(raw, '+') OR starts_with(raw, '(+') THEN d WHEN starts_with(d, '011') THEN substr(d, 4) END AS far, length(d) AS n
          FROM (SELECT *, regexp_replace(raw, '[^0-9]', '', 'g') AS d FROM ({store._each(store._NUMBER, 2)}))), {store._PHONE}
        SELECT doc_id, CAST(i AS BIGINT) AS pos, raw, {_FALSE} AS false_positive, e164,
          CASE WHEN e164 IS NULL THEN NULL WHEN valid AND starts_with(raw, '+') THEN 0.95::DOUBLE WHEN valid THEN 0.88::DOUBLE ELSE 0.75::DOUBLE END AS confidence, CASE WHEN e164 IS NOT NULL THEN country END AS country FROM told""",
    "phone_cases": f"SELECT CAST(id AS BIGINT) AS id, e164, country, valid FROM {sql_values(['id', 'raw', 'host', 'e164', 'country', 'valid'], PHONES)}",
    "site_contacts": f"SELECT type, normalized_value, CAST(confidence AS DOUBLE) AS confidence, country, source_type, page FROM {sql_values(['type', 'normalized_value', 'confidence', 'country', 'source_type', 'page'], SITE_CONTACTS)}",
    "linkedin_parse": """SELECT id, clean, lower(clean) AS normalized, kind, CAST(0.95 AS DOUBLE) AS confidence FROM (VALUES
        (1::BIGINT, 'https://www.linkedin.com/in/Jane-Doe', 'in'), (2, 'https://www.linkedin.com/company/Acme', 'company'),
        (3, 'https://www.linkedin.com/school/mit_x', 'school'), (4, NULL, NULL), (5, NULL, NULL), (6, NULL, NULL), (7, NULL, NULL)) AS t(id, clean, kind)""",
    "context_snippet": rf"""SELECT doc_id, pos, {store._AROUND} AS context
        FROM (SELECT *, greatest(strpos(lower(text), lower(value)) - 81, 0) AS s, least(strpos(lower(text), lower(value)) - 1 + length(value) + 80, length(text)) AS e FROM {_EMAILS})""",
    "attribute_contacts": """SELECT * FROM (VALUES (1::BIGINT, 0, 'email', 'a@example.org', 'address', 'Mailus'), (1, 1, 'phone', '+1 415 555 2671', 'footer', 'tel:+1 415 555 2671'),
        (2, 0, 'email', 'b@example.org', 'mailto', 'B'), (2, 1, 'linkedin', 'https://www.linkedin.com/company/acme', 'header', 'Acme')) AS t(page_id, pos, type, raw_value, source_type, context)""",
    "sitemap_discovery": "SELECT * FROM (VALUES ('https://example.com/one', 1), ('https://blog.example.com/two?a=1&b=2', 2), ('https://example.com/three', 3)) AS t(url, rank)",
    "jobs_list": "SELECT o_orderkey AS id, o_orderstatus AS status FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 50",
    "metrics_by_domain": f"SELECT {_DOMAIN} AS domain, count(*) AS pages_crawled, CAST(sum(octet_length(encode(html))) AS BIGINT) AS bytes FROM pages GROUP BY 1",
    "latency_histogram": "SELECT event_type, " + ", ".join(f"count(*) FILTER (value <= {e}) AS le_{i}" for i, e in enumerate([0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0])) + ", count(*) AS n FROM events GROUP BY 1",
    "job_status": "SELECT user_id, arg_max(event_type, (ts, event_id)) AS status FROM events GROUP BY 1",
}
ORACLE = ORACLE | store.ORACLE | crawl.ORACLE
