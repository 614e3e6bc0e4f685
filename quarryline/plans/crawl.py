"""Crawl policy over recorded inputs: robots, addresses, fetches, the frontier, pacing. With SQL that states the rules anew."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import addresses, fetch, frontier, robots
from ..sources.tables import in_oracle, recorded, sql_values, table, values

# Robots files; | stands for the end of a line. A customer's domain has one of them, by number.
FILES = [
    "User-agent: *|Disallow: /admin/|Allow: /admin/public|Crawl-delay: 2.5|Sitemap: https://x.org/s.xml||User-agent: badbot|Disallow: /",
    "",
    "User-agent: *|Disallow: /*.pdf$|Disallow: /tmp # old||Disallow: /late",
    "User-agent: foobot|no colon here|User-agent: goodbot|Disallow: /x$|Disallow:|Crawl-delay: x|Crawl-delay: 1|# only a comment|Disallow: /gone",
    "Disallow: /early|User-agent: *|Disallow: /a b|Disallow: /a%20c|Allow: /a b/ok",
    "User-agent: *|Crawl-delay: 4|User-agent: good|Disallow: /private|Allow: /private",
    "User-agent: good|Crawl-delay: 9||User-agent: *|Host: x|Disallow: /?q=|Allow:|Disallow: /p*q",
    "User-agent:|Disallow: /late|Sitemap: a|Sitemap: b|sitemap: a",
]
URLS = [
    "https://x.org/admin/settings", "https://x.org/admin/public?x=1", "https://x.org", "https://x.org/a/b.pdf", "https://x.org/a/b.pdfx", "https://x.org/tmp1",
    "https://x.org/x?q=1", "https://x.org/xy", "https://x.org/a%20b/c", "https://x.org/a%20b/ok;v=1", "https://x.org/a%2520c", "https://x.org/private/%zz",
    "https://x.org/pppq", "https://x.org/late",
]
AGENTS = ["GoodBot/1.0", "badbot/2 x", "Other"]
_case = lambda by, xs: f"CASE {by} " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(xs)) + " END"
ROBOTS_SQL = f"SELECT 's' || c_custkey || '.org' AS domain, replace({_case('c_custkey % 8', FILES)}, '|', chr(10)) AS content FROM {{customer}}"
CHECKS_SQL = f"""SELECT o_orderkey AS id, 's' || o_custkey || '.org' AS domain, {_case('o_orderkey % 3', AGENTS)} AS agent,
    {_case(f'o_orderkey % {len(URLS)}', URLS)} AS url FROM {{orders}}"""
# The same files as the rules of RFC 9309 read them, by hand: file, group, line, allow, pattern; the pattern as a regular expression.
RULES = [
    (0, 0, 1, False, "/admin/", "^/admin/"), (0, 0, 2, True, "/admin/public", "^/admin/public"), (0, 1, 7, False, "/", "^/"),
    (2, 0, 1, False, "/*.pdf$", "^/.*[.]pdf$"), (2, 0, 2, False, "/tmp", "^/tmp"), (3, 0, 3, False, "/x$", "^/x$"), (3, 0, 4, True, "/", "^/"),
    (4, 0, 2, False, "/a b", "^/a b"), (4, 0, 3, False, "/a%20c", "^/a%20c"), (4, 0, 4, True, "/a b/ok", "^/a b/ok"),
    (5, 1, 3, False, "/private", "^/private"), (5, 1, 4, True, "/private", "^/private"), (6, 1, 5, False, "/?q=", "^/[?]q="), (6, 1, 7, False, "/p*q", "^/p.*q"),
    (7, 0, 1, False, "/late", "^/late"),
]
GROUPS = [(0, 0, "*", 2.5), (0, 1, "badbot", 0.0), (2, 0, "*", 0.0), (3, 0, "foobot", 1.0), (3, 0, "goodbot", 1.0), (4, 0, "*", 0.0), (5, 0, "*", 4.0), (5, 1, "good", 0.0), (6, 0, "good", 9.0), (6, 1, "*", 0.0), (7, 0, "", 0.0)]
CHOSEN = [(0, 0, 0), (0, 1, 1), (0, 2, 0), (2, 0, 0), (2, 1, 0), (2, 2, 0), (3, 0, 0), (4, 0, 0), (4, 1, 0), (4, 2, 0), (5, 0, 1), (6, 1, 1), (6, 2, 1), (7, 0, 0), (7, 1, 0), (7, 2, 0)]
SEEN_PATHS = ["/admin/settings", "/admin/public", "/", "/a/b.pdf", "/a/b.pdfx", "/tmp1", "/x", "/xy", "/a b/c", "/a b/ok", "/a%20c", "/private/%zz", "/pppq", "/late"]
LISTED = [(0, "https://x.org/s.xml", 4), (7, "a", 2), (7, "b", 3)]

_IP = """CASE o_orderkey % 16 WHEN 0 THEN '10.' WHEN 1 THEN '127.' WHEN 2 THEN '172.' WHEN 3 THEN '192.' WHEN 4 THEN '100.100.100.' WHEN 5 THEN '0.'
    WHEN 6 THEN '169.254.' WHEN 7 THEN '198.' WHEN 8 THEN '203.0.113.' WHEN 9 THEN '192.0.0.' WHEN 10 THEN '192.168.' WHEN 11 THEN '224.' WHEN 12 THEN '255.' ELSE '93.' END"""
_FILL = """CASE WHEN o_orderkey % 16 IN (4, 8, 9) THEN '' || (o_custkey % 256) WHEN o_orderkey % 16 IN (6, 10) THEN (o_custkey % 256) || '.' || (o_orderkey % 256)
    ELSE (o_custkey % 300) || '.' || (o_orderkey % 256) || '.' || (o_custkey % 7) END"""
IPS_SQL = f"SELECT o_orderkey AS id, {_IP} || {_FILL} AS ip, o_orderkey % 3 = 0 AS allow_private FROM {{orders}}"
SIXES = [
    ("2606:4700::1111", False, True), ("::1", False, False), ("::1", True, True), ("fe80::1", False, False), ("fc00::1", False, False), ("ff02::1", False, False), ("2001:db8::1", False, False),
    ("::", False, False), ("01.2.3.4", False, False), ("1.2.3", True, False), ("x", True, False), (":::", True, False), ("192.0.0.9", False, True), ("169.254.169.254", True, False),
]
DNS_SQL = f"SELECT 'd' || o_custkey || '.org' AS host, {_IP} || {_FILL} AS ip FROM {{orders}} WHERE o_orderstatus <> 'P' OR o_custkey % 3 > 0"
HOSTS_SQL = "SELECT CASE WHEN c_custkey % 10 = 0 THEN '10.0.0.' || (c_custkey % 256) WHEN c_custkey % 10 = 1 THEN '8.8.4.' || (c_custkey % 256) ELSE 'd' || c_custkey || '.org' END AS host, c_custkey % 2 = 0 AS allow_private FROM {customer}"

ATTEMPTS_SQL = """SELECT request, hop, attempt, CASE WHEN request % 97 = 5 AND hop = 0 THEN 'https:///x' ELSE 'https://h' || (request % 50) || '.org/hop' || hop END AS url,
    TIMESTAMP '2024-01-01 00:00:04' AS asked_at,
    CASE WHEN request % 4 = 0 THEN CASE kind % 12 WHEN 0 THEN 200 ELSE 302 END
         ELSE CASE kind % 10 WHEN 0 THEN 301 WHEN 1 THEN 308 WHEN 2 THEN 429 WHEN 3 THEN 503 WHEN 4 THEN 404 WHEN 5 THEN 502 WHEN 6 THEN 429 ELSE 200 END END AS status,
    CASE WHEN request % 4 > 0 AND l_suppkey % 11 = 0 THEN 'timed out' WHEN request % 4 > 0 AND l_suppkey % 11 = 1 THEN 'bad protocol' END AS error, l_suppkey % 11 = 0 AS timeout,
    CASE request % 6 WHEN 1 THEN 'image/PNG ; x=1' WHEN 2 THEN NULL WHEN 3 THEN 'application/xml' ELSE 'text/html; charset=utf-8' END AS content_type,
    CAST(floor(l_extendedprice) * 200 AS BIGINT) AS length, CASE WHEN l_suppkey % 13 = 2 THEN NULL ELSE '/next' END AS location,
    CASE l_suppkey % 7 WHEN 0 THEN '3.5' WHEN 1 THEN 'Mon, 01 Jan 2024 00:00:09 GMT' WHEN 2 THEN 'soon' WHEN 3 THEN '99' WHEN 4 THEN 'Mon, 01 Jan 2024 00:00:01 GMT' END AS retry_after
    FROM (SELECT l_orderkey AS request, CAST(CASE WHEN l_orderkey % 4 = 0 THEN k - 1 ELSE floor((k - 1) / 3) END AS INT) AS hop,
            CAST(CASE WHEN l_orderkey % 4 = 0 THEN 0 ELSE (k - 1) % 3 END AS INT) AS attempt, l_partkey + k AS kind, l_suppkey, l_extendedprice
          FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS k FROM {lineitem}) AS numbered) AS laid"""
UNSAFE = ["h7.org", "h13.org"]
LINKS_SQL = """SELECT '/n/' || l_orderkey AS src, CASE WHEN l_partkey % 9 = 0 THEN '/n/contact/' ELSE '/n/' END || l_partkey AS dst,
    CASE WHEN l_partkey % 9 = 0 THEN 100 ELSE 40 END AS priority, l_linenumber * 10000 + l_suppkey AS pos FROM {lineitem}"""
STARTS = [("/n/1",), ("/n/2",)]
SEEDS = [("a", "https://a.org/"), ("b", "https://b.org/")]
MAPPED = [("a", "https://a.org/one", 1), ("a", "https://a.org/", 2), ("a", "https://a.org/contact", 3), ("a", "https://a.org/one", 4)]
LOADS = [  # domain, scheme, minute, status, content
    ("a.org", "https", 0, 200, "User-agent: *"), ("a.org", "https", 5, 200, "User-agent: x"), ("b.org", "https", 0, 404, "gone"), ("b.org", "http", 0, 200, "unused"),
    ("c.org", "https", 0, 503, ""), ("c.org", "http", 0, 200, "fallback"), ("d.org", "https", 0, 200, ""), ("d.org", "http", 0, 500, "x"), ("e.org", "https", 0, 200, "old"),
    ("f.org", "http", 1, 200, "only http"),
]
WANTED = [("a.org", 10), ("b.org", 10), ("c.org", 10), ("d.org", 10), ("e.org", 1440), ("f.org", 10), ("g.org", 10)]
_TIMED = "SELECT *, timestamp_seconds(1704067200 + 60 * minute) AS at FROM {rows}"


def _robots(spark: SparkSession, sf_dir: str) -> robots.Robots:
    return robots.parse(recorded(spark, sf_dir, ROBOTS_SQL, "customer"))


def robots_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _robots(spark, sf_dir).rules


def robots_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _robots(spark, sf_dir).groups.select("domain", "grp", "agent", "delay")


def robots_sitemaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _robots(spark, sf_dir).sitemaps


def robots_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored row of each domain, from loads of which the last one counts."""
    files = recorded(spark, sf_dir, ROBOTS_SQL, "customer").withColumn("at", F.lit(2))
    older = files.select("domain", F.lit("User-agent: *\nCrawl-delay: 77").alias("content"), F.lit(1).alias("at"))
    return robots.latest_by_domain(files.unionByName(older)).select("domain", "robots_txt", F.col("robots_fetched_at").cast("long").alias("fetched"), "crawl_delay")


def robots_allowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return robots.allowed(recorded(spark, sf_dir, CHECKS_SQL, "orders"), _robots(spark, sf_dir))


def robots_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    loads = spark.sql(_TIMED, rows=values(spark, "domain string, scheme string, minute long, status int, content string", LOADS))
    wanted = spark.sql(_TIMED, rows=values(spark, "domain string, minute long", WANTED)).withColumn("scheme", F.lit("https"))
    return robots.resolved(wanted, loads).select("domain", "content", F.date_format("fetched_at", "HH:mm").alias("fetched"))


def ip_safe(spark: SparkSession, sf_dir: str) -> DataFrame:
    six = values(spark, "ip string, allow_private boolean, safe boolean", SIXES).select(F.lit(-1).cast("long").alias("id"), "ip", "allow_private")
    rows = recorded(spark, sf_dir, IPS_SQL, "orders").unionByName(six)
    return rows.withColumn("safe", addresses.ip_safe(F.col("ip"), F.col("allow_private")))


def host_safe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return addresses.host_safe(recorded(spark, sf_dir, HOSTS_SQL, "customer"), recorded(spark, sf_dir, DNS_SQL, "orders"))


def _attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recorded(spark, sf_dir, ATTEMPTS_SQL, "lineitem").withColumnRenamed("asked_at", "at")


def fetch_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each recorded response is by itself."""
    rows = _attempts(spark, sf_dir).where("error is null")
    return rows.select("request", "hop", "attempt", fetch.fetch_outcome(F.col("status"), F.col("content_type"), F.col("length")).alias("outcome"))


def retry_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each attempt is followed by another, and after how many seconds."""
    return fetch.attempt_steps(_attempts(spark, sf_dir)).select("request", "hop", "attempt", "again", F.round("wait", 3).alias("wait"))


def fetch_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fetch.fetched(_attempts(spark, sf_dir), values(spark, "host string", [(h,) for h in UNSAFE]))
    return found.withColumn("waited", F.round("waited", 3)).withColumn("status", F.col("status").cast("string"))


def needs_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").select("page_id", F.when(F.col("page_id") % 3 == 0, F.concat(F.lit('<div id="root"></div>'), F.substring("html", 1, 450))).otherwise(F.col("html")).alias("html"))
    return rows.select("page_id", fetch.needs_render(F.col("html")).alias("needs_render"))


def frontier_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    starts, mapped = values(spark, "job string, url string", SEEDS), values(spark, "job string, url string, seq int", MAPPED)
    return frontier.seeds(starts, mapped).select("job", "url", "depth", "priority")


def frontier_crawl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All that two pages reach in four steps."""
    links = recorded(spark, sf_dir, LINKS_SQL, "lineitem")
    return frontier.crawl(values(spark, "url string", STARTS), links, 4).select("url", F.col("depth").cast("long").alias("depth"))


def frontier_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same within 60 pages, the best of each level first."""
    links = recorded(spark, sf_dir, LINKS_SQL, "lineitem")
    return frontier.crawl(values(spark, "url string", STARTS), links, 3, 60).select("url", F.col("depth").cast("long").alias("depth"))


def frontier_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What two jobs crawl in the order of their queues; tests hold the order against a plain queue."""
    links = recorded(spark, sf_dir, LINKS_SQL, "lineitem")
    jobs = values(spark, "job string, max_pages int, max_depth int", [("a", 200, 3), ("b", 40, 2)])
    starts = frontier.seeds(values(spark, "job string, url string", [("a", "/n/1"), ("b", "/n/2")]), values(spark, "job string, url string, seq int", [("a", "/n/3", 1)]))
    return frontier.simulate(jobs, starts, links)


def rate_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of each user's domain spaced by half a request a second, or by the domain's delay."""
    rows = table(spark, sf_dir, "events").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    delay = F.when(F.col("user_id") % 3 == 0, 3.5)
    found = frontier.schedule(rows, "user_id", F.col("at"), ["at", "event_id"], frontier.spacing(F.lit(0.5), delay))
    return found.select("event_id", F.round("start", 3).alias("start"))


QUERIES = {
    f.__name__: f
    for f in (
        robots_rules, robots_groups, robots_sitemaps, robots_store, robots_allowed, robots_resolved, ip_safe, host_safe, fetch_outcome, retry_schedule,
        fetch_results, needs_render, frontier_seeds, frontier_crawl, frontier_budget, frontier_exact, rate_schedule,
    )
}

_rules = sql_values(["t", "grp", "pos", "allow", "pattern", "rx"], RULES)
_groups = sql_values(["t", "grp", "agent", "delay"], GROUPS)
_ATTEMPTS = in_oracle(ATTEMPTS_SQL, "lineitem")
_OCTETS = "CAST(split_part(ip, '.', 1) AS INT) AS a, CAST(split_part(ip, '.', 2) AS INT) AS b, CAST(split_part(ip, '.', 3) AS INT) AS c, CAST(split_part(ip, '.', 4) AS INT) AS d"
_SAFE = """a < 256 AND b < 256 AND c < 256 AND d < 256 AND a <> 0 AND NOT (a = 169 AND b = 254 AND c = 169 AND d = 254) AND NOT (a = 100 AND b = 100 AND c = 100 AND d = 200)
    AND (allow_private OR NOT (a IN (10, 127) OR a >= 224 OR (a = 169 AND b = 254) OR (a = 172 AND b >= 16 AND b <= 31) OR (a = 192 AND b = 168)
      OR (a = 192 AND b = 0 AND c = 0 AND d NOT IN (9, 10)) OR (a = 192 AND b = 0 AND c = 2) OR (a = 198 AND b IN (18, 19)) OR (a = 198 AND b = 51 AND c = 100) OR (a = 203 AND b = 0 AND c = 113)))"""
_TYPE = "lower(trim(split_part(coalesce(content_type, ''), ';', 1)))"
_KIND_OK = f"({_TYPE} = '' OR regexp_matches({_TYPE}, '^(text/(html|plain|xml)|application/(xhtml[+])?xml)'))"
_LIMITED = "(error IS NULL AND status = 429)"
_SLOW = "((error IS NOT NULL AND timeout) OR (error IS NULL AND status IN (502, 503, 504)))"
_STEPS = f"""(SELECT *, {_LIMITED} OR ({_SLOW} AND attempt < 2) AS again,
    CASE WHEN {_LIMITED} THEN least(15.0, coalesce(try_cast(retry_after AS DOUBLE),
            CASE WHEN retry_after LIKE '%GMT' THEN greatest(0.0, epoch(strptime(regexp_extract(retry_after, '[0-9]{{1,2}} [A-Z][a-z]+ [0-9]{{4}} [0-9:]+'), '%d %b %Y %H:%M:%S')) - epoch(asked_at)) END, 2.0))
         WHEN {_SLOW} AND attempt < 2 THEN 0.5 * pow(2, attempt) ELSE 0.0 END::DOUBLE AS wait FROM {_ATTEMPTS})"""


def _levels(depth: int, most: int | None) -> str:
    """Breadth first, a level after the other."""
    parts = ["l0 AS (SELECT url, 0 AS depth FROM (VALUES ('/n/1'), ('/n/2')) AS t(url))"]
    for d in range(1, depth + 1):
        seen = " UNION ALL ".join(f"SELECT url FROM l{i}" for i in range(d))
        cut = "" if most is None else f" ORDER BY p DESC, url LIMIT (SELECT greatest(0, {most} - count(*)) FROM ({seen}))"
        parts.append(f"l{d} AS (SELECT url, {d} AS depth FROM (SELECT dst AS url, max(priority) AS p FROM links JOIN l{d - 1} ON src = url GROUP BY dst) WHERE url NOT IN ({seen}){cut})")
    return f"WITH links AS {in_oracle(LINKS_SQL, 'lineitem')}, {', '.join(parts)} " + " UNION ALL ".join(f"SELECT url, CAST(depth AS BIGINT) AS depth FROM l{i}" for i in range(depth + 1))


_DOMAINS = "(SELECT 's' || c_custkey || '.org' AS domain, c_custkey % 8 AS t FROM customer)"
ORACLE = {
    "robots_rules": f"SELECT domain, grp, pos, allow, pattern FROM {_DOMAINS} JOIN {_rules} USING (t)",
    "robots_groups": f"SELECT domain, grp, agent, CAST(delay AS DOUBLE) AS delay FROM {_DOMAINS} JOIN {_groups} USING (t)",
    "robots_sitemaps": f"SELECT domain, sitemap, pos FROM {_DOMAINS} JOIN {sql_values(['t', 'sitemap', 'pos'], LISTED)} USING (t)",
    "robots_store": f"""SELECT domain, replace({_case('t', FILES)}, '|', chr(10)) AS robots_txt, 2::BIGINT AS fetched,
        CASE t WHEN 0 THEN 2.5 WHEN 5 THEN 4.0 ELSE 0.0 END::DOUBLE AS crawl_delay FROM {_DOMAINS}""",
    "robots_allowed": f"""WITH asked AS (SELECT o_orderkey AS id, o_custkey % 8 AS t, o_orderkey % 3 AS a,
        CASE o_orderkey % {len(URLS)} {' '.join(f"WHEN {i} THEN '{p}'" for i, p in enumerate(SEEN_PATHS))} END AS path FROM orders),
    hits AS (SELECT id, arg_max(allow, length(pattern) * 2 + allow::INT) AS allowed FROM asked JOIN {sql_values(['t', 'a', 'grp'], CHOSEN)} USING (t, a)
        JOIN (SELECT * FROM {_rules}) AS r USING (t, grp) WHERE regexp_matches(path, rx) GROUP BY id)
    SELECT id, coalesce(allowed, true) AS allowed FROM asked LEFT JOIN hits USING (id)""",
    "robots_resolved": """SELECT * FROM (VALUES ('a.org', 'User-agent: x', '00:05'), ('b.org', '', '00:00'), ('c.org', 'fallback', '00:00'), ('d.org', NULL, '00:00'), ('e.org', NULL, NULL),
        ('f.org', 'only http', '00:01'), ('g.org', NULL, NULL)) AS t(domain, content, fetched)""",
    "ip_safe": f"""SELECT id, ip, allow_private, {_SAFE} AS safe FROM (SELECT *, {_OCTETS} FROM {in_oracle(IPS_SQL, 'orders')})
        UNION ALL SELECT -1, ip, allow_private, safe FROM {sql_values(['ip', 'allow_private', 'safe'], SIXES)}""",
    "host_safe": f"""SELECT host, allow_private, coalesce(bool_and({_SAFE}), false) AS safe
        FROM (SELECT host, allow_private, {_OCTETS} FROM (SELECT DISTINCT h.host, allow_private, CASE WHEN regexp_matches(h.host, '^[0-9.]+$') THEN h.host ELSE dns.ip END AS ip
          FROM {in_oracle(HOSTS_SQL, 'customer')} AS h LEFT JOIN {in_oracle(DNS_SQL, 'orders')} AS dns ON dns.host = h.host)) GROUP BY ALL""",
    "fetch_outcome": f"""SELECT request, hop, attempt, CASE WHEN status BETWEEN 301 AND 303 OR status IN (307, 308) THEN 'redirect' WHEN status IN (429, 502, 503, 504) THEN 'retry'
        WHEN NOT {_KIND_OK} THEN 'bad_type' WHEN length > 10485760 THEN 'too_large' WHEN status >= 200 AND status < 300 THEN 'ok' ELSE 'failed' END AS outcome FROM {_ATTEMPTS} WHERE error IS NULL""",
    "retry_schedule": f"SELECT request, hop, attempt, again, round(wait, 3) AS wait FROM {_STEPS}",
    "fetch_results": f"""WITH steps AS {_STEPS},
        ends AS (SELECT request, hop, coalesce(min(attempt) FILTER (NOT again), 2) AS last FROM steps GROUP BY ALL),
        hops AS (SELECT request, hop, min(url) AS url, count(*) AS n, sum(wait) AS waited, bool_or(NOT again AND error IS NULL) AS answered,
            max(status) FILTER (NOT again AND error IS NULL) AS status, max(content_type) FILTER (NOT again AND error IS NULL) AS content_type,
            max(length) FILTER (NOT again AND error IS NULL) AS length, max(location) FILTER (NOT again AND error IS NULL) AS location, arg_max(error, attempt) FILTER (error IS NOT NULL) AS said
          FROM steps JOIN ends USING (request, hop) WHERE attempt <= last GROUP BY request, hop),
        judged AS (SELECT request, hop, url, n, waited, said, answered, status, content_type, length, location, regexp_extract(url, '^https://([^/]*)', 1) AS host,
            answered AND status IN (301, 302, 303, 307, 308) AS moved FROM hops),
        told AS (SELECT *, host = '' OR host IN ('h7.org', 'h13.org') AS early, CASE WHEN host = '' THEN 'Invalid URL hostname: ' || url WHEN host IN ('h7.org', 'h13.org') THEN 'Blocked by SSRF protection'
            WHEN NOT answered THEN 'Connection failed: ' || coalesce(said, 'None') WHEN moved AND (location IS NULL OR hop >= 5) THEN 'Exceeded maximum redirects limit of 5'
            WHEN moved THEN NULL WHEN NOT {_KIND_OK} THEN 'Excluded content type: ' || {_TYPE} WHEN length > 10485760 THEN 'Response exceeded size limit' END AS error FROM judged),
        done AS (SELECT *, error IS NOT NULL OR NOT moved AS over FROM told),
        used AS (SELECT * FROM done AS d WHERE NOT EXISTS (SELECT 1 FROM done AS e WHERE e.request = d.request AND e.over AND e.hop < d.hop))
        SELECT request, arg_max(url, hop) AS url, CAST(nullif(max_by(CASE WHEN NOT over THEN -1 WHEN early OR NOT answered OR moved THEN 0 ELSE status END, hop), -1) AS VARCHAR) AS status,
            nullif(max_by(coalesce(error, ''), hop), '') AS error, CAST(max(hop) AS BIGINT) AS redirects, CAST(sum(CASE WHEN early THEN 0 ELSE n END) AS BIGINT) AS n_attempts,
            round(sum(CASE WHEN early THEN 0 ELSE waited END), 3) AS waited FROM used GROUP BY request""",
    "needs_render": """SELECT page_id, page_id % 3 = 0 AND length(trim('<div id="root"></div>' || substr(html, 1, 450), E' \\t\\n\\r')) < 500 AS needs_render FROM pages""",
    "frontier_seeds": """SELECT * FROM (VALUES ('a', 'https://a.org/one', 1, 50), ('a', 'https://a.org/contact', 1, 50), ('a', 'https://a.org/', 0, 100), ('b', 'https://b.org/', 0, 100))
        AS t(job, url, depth, priority)""",
    "frontier_crawl": _levels(4, None),
    "frontier_budget": _levels(3, 60),
    "rate_schedule": """SELECT event_id, round(i * gap + max(came - i * gap) OVER (PARTITION BY user_id ORDER BY i ROWS UNBOUNDED PRECEDING), 3) AS start
        FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY came, event_id) - 1 AS i, CASE WHEN user_id % 3 = 0 THEN 3.5 ELSE 2.0 END::DOUBLE AS gap
          FROM (SELECT *, epoch_us(ts) / 1e6 AS came FROM events))""",
}
