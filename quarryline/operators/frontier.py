"""The crawl frontier and its pacing."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import forget, settle

#: Priority of sitemap URLs, whatever they look like, and of the start URL.
SITEMAP, START = 50, 100
#: Marks in the place of a depth: a link, a page whose links have all been read; in the place of a number: a page to read.
LINK, READ, UNREAD = -1, -2, -1
#: Pages that a job reads before it knows that it needs them, at most.
AHEAD = 20_000


def seeds(starts: DataFrame, sitemap_urls: DataFrame) -> DataFrame:
    """job, url, depth, priority, seq: sitemap URLs (job, url, seq) first, at depth 1, then each job's start (job, url) at depth 0; a URL keeps its first place."""
    own = starts.select("job", F.col("url").alias("own"))
    listed = sitemap_urls.join(own, "job").where("url <> own")
    rows = listed.select("job", "url", F.lit(1).alias("depth"), F.lit(SITEMAP).alias("priority"), F.col("seq").cast("long").alias("seq"))
    rows = rows.unionByName(starts.select("job", "url", F.lit(0).alias("depth"), F.lit(START).alias("priority"), F.lit((1 << 62)).alias("seq")))
    first = rows.groupBy("job", "url").agg(F.min(F.struct("seq", "depth", "priority")).alias("f"))
    return first.select("job", "url", "f.depth", "f.priority", "f.seq")


def schedule(requests: DataFrame, key: str, arrival: Column, order: list, spacing: Column | float) -> DataFrame:
    """Adds start: request i of a key starts at its arrival, the key's spacing after the one before at the earliest."""
    by = Window.partitionBy(key).orderBy(*order)
    out = requests.withColumn("i", F.row_number().over(by) - 1).withColumn("gap", F.lit(spacing) if isinstance(spacing, float) else spacing)
    out = out.withColumn("slack", arrival - F.col("i") * F.col("gap"))
    return out.withColumn("start", F.col("i") * F.col("gap") + F.max("slack").over(by.rowsBetween(Window.unboundedPreceding, 0))).drop("slack", "gap")


def spacing(rps: Column, crawl_delay: Column) -> Column:
    """Seconds between requests to a domain: those that the rate asks for, or the robots delay if that is longer."""
    return F.greatest(F.when(rps > 0, 1.0 / rps).otherwise(0.5), F.coalesce(crawl_delay, F.lit(0.0)))


def crawl(start: DataFrame, links: DataFrame, max_depth: int, max_pages: int | None = None) -> DataFrame:
    """url, depth of all that start (url; priority if given) reaches over links (src, dst; priority if given) in max_depth steps.

    Set-based, one join a level: for frontiers of any size. A URL keeps its
    first depth. Within a level URLs are taken by priority, then by name; with
    max_pages the first that many in that order are taken, and only what is
    taken leads on.
    """
    rank = lambda df: df if "priority" in df.columns else df.withColumn("priority", F.lit(SITEMAP))
    edges = rank(links)
    front = settle(_first(rank(start).select("url", "priority"), max_pages).withColumn("depth", F.lit(0)))
    seen, n = front, front.count()
    for depth in range(1, max_depth + 1):
        left = None if max_pages is None else max_pages - n
        if left is not None and left <= 0:
            break
        step = front.join(edges.select("src", "dst", F.col("priority").alias("p")), front["url"] == F.col("src")).groupBy(F.col("dst").alias("url")).agg(F.max("p").alias("priority"))
        new = settle(_first(step.join(seen.select("url"), "url", "left_anti"), left).withColumn("depth", F.lit(depth)))
        found = new.count()
        if not found:
            forget(new)
            break
        both = settle(seen.unionByName(new))
        if front is not seen:
            forget(front)
        forget(seen)
        seen, front, n = both, new, n + found
    return seen.select("url", "depth")


def _first(rows: DataFrame, most: int | None) -> DataFrame:
    rows = rows.groupBy("url").agg(F.max("priority").alias("priority"))
    return rows if most is None else rows.orderBy(F.desc("priority"), "url").limit(most)


def simulate(jobs: DataFrame, starts: DataFrame, links: DataFrame, ahead: int = AHEAD) -> DataFrame:
    """job, nth, url, depth: what each job crawls, in the exact order of its queue.

    jobs: job, max_pages, max_depth. starts: what seeds gives. links: src, dst,
    priority, pos, the links that pages would offer; and job, if jobs see
    different ones. The queue gives the highest priority first, then the
    earliest pushed; what is queued or visited is not pushed again, so a URL
    keeps the depth of its first push.

    A job is one group, of the pages that it has read. It is walked until it
    needs the links of a page that it has not read; then those of all pages it
    may read next are joined to it, and it is walked again. These are the pages
    within its depth, while there are at most `ahead`; else those of its queue,
    at most max_pages. So a round is a join, of as many as the depth for small
    jobs, and no group holds the links of other pages.
    """
    key = [c for c in ("job", "src") if c in links.columns]
    edges = links.select(*key, "dst", "priority", F.col("pos").cast("long").alias("pos"), F.lit(LINK).alias("depth"))
    names = ["job", "src", "dst", "priority", "pos", "depth"]
    own = starts.withColumnsRenamed({"url": "dst", "seq": "pos"}).withColumn("src", F.lit(None).cast("string"))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(list(_walk(part, ahead)), columns=["job", "nth", "url", "depth"])

    held = settle(own.select(names))
    while True:
        out = settle(held.join(jobs, "job").groupBy("job").applyInPandas(run, "job string, nth long, url string, depth int"))
        wanted = out.where(F.col("nth") == UNREAD).select("job", F.col("url").alias("src"))
        if wanted.isEmpty():
            forget(held)
            return out
        read = wanted.select("job", "src", F.lit(None).cast("string").alias("dst"), F.lit(0).alias("priority"), F.lit(0).cast("long").alias("pos"), F.lit(READ).alias("depth"))
        more = settle(held.unionByName(read).unionByName(edges.join(wanted, key).select(names)))
        forget(held, out)
        held = more


def _walk(part: pd.DataFrame, ahead: int) -> Iterator[tuple]:
    """The visited pages of a job; or, if links of a page are missing, pages to read, under the number UNREAD."""
    part = part.sort_values(["pos", "dst"], kind="stable")
    job, most, deepest = part["job"].iloc[0], int(part["max_pages"].iloc[0]), int(part["max_depth"].iloc[0])
    out: dict[str, list] = {}
    queue: list[tuple] = []
    known: set[str] = set()
    visited: list[tuple] = []

    def push(url, depth, priority):
        if url not in known:
            known.add(url)
            heapq.heappush(queue, (-priority, len(known), url, depth))

    read = set(part.loc[part["depth"] == READ, "src"])
    for r in part[part["depth"] == LINK].itertuples():
        out.setdefault(r.src, []).append((r.dst, r.priority))
    first = [(r.dst, int(r.depth), r.priority) for r in part[part["depth"] >= 0].itertuples()]
    for r in first:
        push(*r)
    while queue and len(visited) < most:
        _, _, url, depth = queue[0]
        leads = depth < deepest and len(visited) + len(queue) < most
        if leads and url not in read:
            near = _unread(first, out, read, deepest)
            if len(read) + len(near) > ahead:
                near = [u for _, _, u, d in heapq.nsmallest(most - len(visited), queue) if d < deepest and u not in read]
            yield from ((job, UNREAD, u, 0) for u in near)
            return
        heapq.heappop(queue)
        visited.append((job, len(visited), url, depth))
        if leads:
            for dst, priority in sorted(out.get(url, []), key=lambda x: -x[1]):
                push(dst, depth + 1, priority)
    yield from visited


def _unread(first: list[tuple], out: dict[str, list], read: set[str], deepest: int) -> list[str]:
    """Pages above the greatest depth that the links read so far lead to, and that are not read."""
    found, seen, front = [], set(), set()
    for depth in range(deepest):
        front = ({u for u, d, _ in first if d == depth} | {dst for u in front for dst, _ in out.get(u, [])}) - seen
        if not front and depth > max(d for _, d, _ in first):
            break
        seen |= front
        found += [u for u in front if u not in read]
    return found
