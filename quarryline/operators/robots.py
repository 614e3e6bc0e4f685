"""robots.txt: files to groups, rules and sitemaps, and the verdict on a URL.

A file is read as a table of its lines. Which group a line belongs to follows
from running counts over the lines before it, so files of any number are parsed
by one window over (domain, line).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls as U

#: Seconds for which a loaded file counts.
TTL = 24 * 3600
#: What ends a line, and a number as a delay is written.
LINE_END = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029]"
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


@dataclass(frozen=True)
class Robots:
    """groups: domain, grp, agent, first (line), delay. rules: domain, grp, pos, allow, pattern. sitemaps: domain, sitemap, pos. delays: domain, delay."""

    groups: DataFrame
    rules: DataFrame
    sitemaps: DataFrame
    delays: DataFrame


def _directives(files: DataFrame) -> DataFrame:
    """domain, pos, kind (agent, rule, sitemap or blank), key, value of each line that counts; a line without a colon does not."""
    raw = files.select("domain", F.posexplode(F.split(F.coalesce("content", F.lit("")), LINE_END, -1)).alias("pos", "line"))
    trim = lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")
    text = raw.select("domain", "pos", trim(F.regexp_replace("line", r"#.*", "")).alias("text"))
    key = F.lower(trim(F.substring_index("text", ":", 1)))
    value = trim(F.regexp_replace("text", r"^[^:]*:", ""))
    kind = F.when(F.col("text") == "", "blank").when(F.instr("text", ":") == 0, None).when(key == "user-agent", "agent").when(key == "sitemap", "sitemap").otherwise("rule")
    return text.select("domain", "pos", kind.alias("kind"), key.alias("key"), value.alias("value")).where("kind is not null")


def parse(files: DataFrame) -> Robots:
    """Parses files (domain, content), one a domain.

    Consecutive agent lines share a group, blank lines between them or not. A
    blank line after a rule closes the group: rules from there to the next agent
    line belong to none. An empty Disallow allows everything. Null or empty
    files have no groups. A group's delay is its largest, 0 without any.
    """
    lines = _directives(files)
    by = Window.partitionBy("domain").orderBy("pos")
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    up_to = by.rowsBetween(Window.unboundedPreceding, 0)
    agent, rule, blank = F.col("kind") == "agent", F.col("kind") == "rule", F.col("kind") == "blank"
    last = F.last(F.when(agent | rule, F.col("kind")), ignorenulls=True).over(before)
    lines = lines.withColumn("opens", agent & (F.coalesce(last, F.lit("rule")) == "rule"))
    lines = lines.withColumn("grp", (F.sum(F.col("opens").cast("int")).over(up_to) - 1).cast("int"))
    lines = lines.withColumn("part", F.sum(agent.cast("int")).over(up_to))  # lines from one agent line to the next
    inside = Window.partitionBy("domain", "part").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    ruled = F.max(rule.cast("int")).over(inside) == 1
    lines = lines.withColumn("closing", (blank & ruled).cast("int"))
    lines = lines.withColumn("closed", F.max("closing").over(inside) == 1)
    active = lines.where(rule & ~F.col("closed") & (F.col("part") > 0))

    number = F.when(F.col("value").rlike(NUMBER), F.col("value").cast("double"))
    delay = active.where("key = 'crawl-delay'").groupBy("domain", "grp").agg(F.greatest(F.max(number), F.lit(0.0)).alias("delay"))
    groups = lines.where(agent).groupBy("domain", "grp", F.lower("value").alias("agent")).agg(F.min("pos").alias("first"))
    groups = groups.join(delay, ["domain", "grp"], "left").withColumn("delay", F.coalesce("delay", F.lit(0.0)))

    some = F.col("value") != ""
    rules = active.where((F.col("key") == "disallow") | ((F.col("key") == "allow") & some))
    rules = rules.select("domain", "grp", "pos", ((F.col("key") == "allow") | ~some).alias("allow"), F.when(some, F.col("value")).otherwise("/").alias("pattern"))
    sitemaps = lines.where((F.col("kind") == "sitemap") & some).groupBy("domain", F.col("value").alias("sitemap")).agg(F.min("pos").alias("pos"))
    star = F.max(F.when(F.col("agent") == "*", F.col("delay")))
    delays = groups.groupBy("domain").agg(F.coalesce(star, F.lit(0.0)).alias("delay"))
    return Robots(groups, rules, sitemaps, delays)


def pattern_regex(pattern: Column) -> Column:
    """A path pattern as a regular expression that must match from the path's start: * for anything, a last $ for the end."""
    ends = pattern.endswith("$")
    body = F.when(ends, F.regexp_replace(pattern, r"\$$", "")).otherwise(pattern)
    literal = F.regexp_replace(body, r"([\\.^$|?+(){}\[\]])", r"\\$1")
    return F.concat(F.lit("(?d)^"), F.regexp_replace(literal, r"\*", ".*"), F.when(ends, "$").otherwise(""))


def url_path(url: Column) -> Column:
    """What rules are held against: the percent-decoded path, without the query; / where it is empty."""
    way = U.path(url)
    return U.percent_decoded(F.when(way == "", "/").otherwise(way))


def agent_token(agent: Column) -> Column:
    """The name in a user agent: what stands before a slash, its first word, lower-case."""
    return F.lower(F.regexp_extract(F.substring_index(agent, "/", 1), r"(?U)^\s*(\S+)", 1))


def allowed(checks: DataFrame, robots: Robots) -> DataFrame:
    """id, allowed of checks (id, domain, agent, url).

    The first group that names a part of the agent's token counts, else the
    first * group. Of its patterns that match, the longest decides; allow on a
    tie, or where none matches, no group counts or there is no file.
    """
    token = F.col("token")
    named = (F.col("g_agent") == "") | (F.instr(token, F.col("g_agent")) > 0)
    tier = F.when(named, 0).when(F.col("g_agent") == "*", 1)
    asked = checks.select("id", "domain", agent_token(F.col("agent")).alias("token"), url_path(F.col("url")).alias("path"))
    groups = robots.groups.select("domain", "grp", F.col("agent").alias("g_agent"))
    chosen = asked.join(groups, "domain").withColumn("tier", tier).where("tier is not null")
    chosen = chosen.groupBy("id", "domain", "path").agg(F.min(F.struct("tier", "grp"))["grp"].alias("grp"))
    rules = robots.rules.select("domain", "grp", "allow", "pattern", pattern_regex(F.col("pattern")).alias("rx")).distinct()
    hits = chosen.join(rules, ["domain", "grp"]).where(F.expr("path rlike rx"))
    verdict = hits.groupBy("id").agg(F.max(F.struct(F.length("pattern"), "allow"))["allow"].alias("verdict"))
    return checks.join(verdict, "id", "left").select("id", F.coalesce("verdict", F.lit(True)).alias("allowed"))


def resolved(wanted: DataFrame, loads: DataFrame) -> DataFrame:
    """domain, content, fetched_at of the robots files to use for `wanted` (domain, scheme, at).

    loads (domain, scheme, at, status, content) are recorded responses. Of those
    not older than TTL the latest of a scheme counts. The asked scheme's file is
    used if it came with 200 and a body; 404 allows everything; otherwise the
    other scheme's is used, if that came. Null content allows everything.
    """
    fresh = wanted.alias("w").join(loads.alias("l"), "domain").where("l.at <= w.at").where(F.unix_micros("w.at") - F.unix_micros("l.at") < TTL * 1_000_000)
    own = F.col("l.scheme") == F.col("w.scheme")
    last = F.struct("l.at", "l.status", "l.content")
    got = fresh.groupBy("domain", F.col("w.scheme").alias("scheme"), F.col("w.at").alias("at")).agg(F.max(F.when(own, last)).alias("a"), F.max(F.when(~own, last)).alias("b"))
    body = lambda x: F.when((x["status"] == 200) & (x["content"] != ""), x["content"])
    a, b = F.col("a"), F.col("b")
    content = F.when(body(a).isNotNull(), body(a)).when(a["status"] == 404, F.lit("")).otherwise(body(b))
    got = got.select("domain", "scheme", "at", content.alias("content"), F.coalesce(a["at"], b["at"]).alias("fetched_at"))
    return wanted.join(got, ["domain", "scheme", "at"], "left").select("domain", "content", "fetched_at")


def latest_by_domain(files: DataFrame) -> DataFrame:
    """The row of each domain as the store keeps it: domain, robots_txt, robots_fetched_at, crawl_delay. files: domain, content, at."""
    last = files.groupBy("domain").agg(F.max(F.struct("at", "content")).alias("r")).select("domain", F.col("r.content").alias("content"), F.col("r.at").alias("at"))
    delays = parse(last).delays
    return last.join(delays, "domain", "left").select(
        "domain", F.col("content").alias("robots_txt"), F.col("at").alias("robots_fetched_at"), F.coalesce("delay", F.lit(0.0)).alias("crawl_delay")
    )
