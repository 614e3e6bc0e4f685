import pytest
from pyspark.sql import functions as F

from quarryline.functions import contacts as C
from quarryline.functions import html as H
from quarryline.functions import urls as U
from quarryline.operators import contacts as O
from quarryline.operators import addresses, fetch, frontier, jobs, robots


def one(spark, make, *args):
    row = spark.createDataFrame([args], ", ".join(f"c{i} string" for i in range(len(args))))
    return row.select(make(*[F.col(f"c{i}") for i in range(len(args))]).alias("x")).collect()[0]["x"]


@pytest.mark.parametrize(
    "url, want",
    [
        ("HTTP://Ex.org:80//a//b/?utm_source=x&b=2&a=1#f", "http://ex.org/a/b?a=1&b=2"),
        ("https://ex.org:443", "https://ex.org/"), ("mailto:a@b.c", None), ("https://ex.org/a;x=1?q=&z", "https://ex.org/a"),
        ("https://ex.org/?q=a b", "https://ex.org/?q=a+b"), ("https://ex.org/?a=%zz&b=1", "https://ex.org/?a=%25zz&b=1"), ("https://ex.org/?a=100%&t=~*", "https://ex.org/?a=100%25&t=~%2A"),
        (None, None), ("", None), ("https://", None),
    ],
)
def test_normalized(spark, url, want):
    assert one(spark, U.normalized, url) == want


def test_domain(spark):
    assert one(spark, U.domain, "https://u:p@[::1]:8080/x") == "[::1]"
    assert one(spark, lambda u: U.same_domain(u, ["example.com"]), "https://blog.example.com/") is True
    assert one(spark, lambda u: U.same_domain(u, ["example.com"], False), "https://blog.example.com/") is False
    assert one(spark, U.crawlable, "https://x.org/a.png") is False


@pytest.mark.parametrize("email, ok", [("a@b.org", True), ("image@2x.png", False), ("user@localhost", False), ("a@@b.org", False)])
def test_email(spark, email, ok):
    assert one(spark, C.email_valid, email) is ok


@pytest.mark.parametrize("raw, bad", [("2024-01-15", True), ("1234567890", True), ("0000000000", True), ("(555) 234-5678", False), ("+1 555 234 5678", False)])
def test_phone(spark, raw, bad):
    assert one(spark, C.phone_false_positive, raw) is bad


def test_context(spark):
    assert one(spark, C.context, "write to  a@b.org now", "A@B.org") == "write to a@b.org now"
    assert one(spark, C.context, "x" * 100 + "T" + "y" * 100, "T") == "..." + "x" * 80 + "T" + "y" * 80 + "..."


def test_nodes_and_links(spark):
    page = "<title>T</title><body><header>h@x.org</header><script>no</script><p>a<!-- c@x.org --></p><a href='../contact'>go</a><address><p>ad</p></address>"
    pages = spark.createDataFrame([(1, "https://x.org/a/b", page), (2, None, None)], "page_id long, url string, html string")
    got = [(r.text, r.source_type) for r in H.text_nodes(pages).orderBy("pos").collect()]
    assert got == [("T", "body"), ("h@x.org", "header"), ("a", "body"), ("c@x.org", "body"), ("go", "body"), ("ad", "address")]
    assert [(r.canonical, r.anchors) for r in H.raw_links(pages).orderBy("page_id").collect()] == [(None, ["https://x.org/contact"]), (None, [])]


@pytest.mark.parametrize(
    "html, want",
    [
        ("<title> Tom &amp; Jerry&nbsp;</title>", "Tom & Jerry"), ("<title></title><h1> a <b> b </b>&lt;c</h1>", "ab<c"), ("<title>x<b>y</b></title><h1>z</h1>", "z"), ("<p>none</p>", None),
        ("<TITLE lang='x'>&#233;</TITLE>", "\u00e9"), (None, None), ("<title> </title><h1>h</h1>", ""),
    ],
)
def test_title(spark, html, want):
    assert one(spark, H.title, html) == want


def test_link_cap(spark):
    page = "".join(f"<a href='/p{i}'>x</a>" for i in range(300)) + "<a href='/contact'>late</a>"
    got = H.links(spark.createDataFrame([(1, "https://x.org/", page)], "page_id long, url string, html string")).collect()
    assert [r.url for r in sorted(got, key=lambda r: r.rank)] == [f"https://x.org/p{i}" for i in range(200)]


def test_dedup(spark):
    rows = [("email", "A@x.org", "a@x.org", "j1", "p1", 0.8, None, 1), ("email", "a@x.org", "a@x.org", "j2", "p2", 0.95, "US", 2)]
    found = spark.createDataFrame(rows, "type string, value string, normalized_value string, job string, page string, confidence double, country string, ord int")
    row = O.dedup(found, ["ord"]).collect()
    assert len(row) == 1 and (row[0].value, row[0].job, row[0].confidence, row[0].country) == ("A@x.org", "j1", 0.95, "US")


def test_schedule(spark):
    rows = spark.createDataFrame([(1, 0.0), (1, 1.0), (1, 9.0)], "k int, at double")
    assert [r.start for r in frontier.schedule(rows, "k", F.col("at"), ["at"], 2.0).orderBy("at").collect()] == [0.0, 2.0, 9.0]


def test_crawl_ends(spark):
    links = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c")], "src string, dst string")
    got = frontier.crawl(spark.createDataFrame([("a",)], "url string"), links, 5)
    assert sorted((r.url, r.depth) for r in got.collect()) == [("a", 0), ("b", 1), ("c", 2)]


def queue_order(starts, links, most, deepest):
    """What a crawl with one worker visits, by a plain queue that is searched each time."""
    queue, known, seen, n = [], set(), [], 0
    for url, depth, priority in starts:
        if url not in known:
            known.add(url)
            queue.append((priority, n, url, depth))
            n += 1
    while queue and len(seen) < most:
        best = min(queue, key=lambda q: (-q[0], q[1]))
        queue.remove(best)
        seen.append((best[2], best[3]))
        if best[3] < deepest and len(seen) + len(queue) < most:
            mine = sorted((x for x in links if x[0] == best[2]), key=lambda x: x[3])
            for _, dst, priority, _ in sorted(mine, key=lambda x: -x[2]):
                if dst not in known:
                    known.add(dst)
                    queue.append((priority, n, dst, best[3] + 1))
                    n += 1
    return seen


def test_simulated_queue(spark):
    import random

    rng = random.Random(4)
    links = [(f"/{rng.randrange(40)}", f"/{rng.randrange(40)}", rng.choice([40, 50, 100]), i) for i in range(160)]
    starts = frontier.seeds(
        spark.createDataFrame([("a", "/0"), ("b", "/1")], "job string, url string"), spark.createDataFrame([("a", "/7", 2), ("a", "/0", 1), ("a", "/9", 3), ("a", "/7", 4)], "job string, url string, seq int")
    )
    assert sorted((r.job, r.url, r.depth, r.priority) for r in starts.collect()) == [("a", "/0", 0, 100), ("a", "/7", 1, 50), ("a", "/9", 1, 50), ("b", "/1", 0, 100)]
    edges = spark.createDataFrame([(j, *x) for j in "ab" for x in links], "job string, src string, dst string, priority int, pos int")
    jobs_ = spark.createDataFrame([("a", 25, 3), ("b", 1000, 2)], "job string, max_pages int, max_depth int")
    got = frontier.simulate(jobs_, starts, edges).orderBy("job", "nth").collect()
    assert [(r.url, r.depth) for r in got if r.job == "a"] == queue_order([("/7", 1, 50), ("/9", 1, 50), ("/0", 0, 100)], links, 25, 3)
    assert [(r.url, r.depth) for r in got if r.job == "b"] == queue_order([("/1", 0, 100)], links, 1000, 2)


@pytest.mark.parametrize("ahead", [0, 40, 20_000])
def test_simulated_queue_reads_what_it_needs(spark, monkeypatch, ahead):
    """Links of pages that a job cannot read stay out of its group; with links for all jobs, and with few pages read ahead."""
    import random

    rng, sizes, settle = random.Random(6), [], frontier.settle

    def counted(df):
        sizes.append((out := settle(df)).count())
        return out

    monkeypatch.setattr(frontier, "settle", counted)
    links = [(f"/{rng.randrange(60)}", f"/{rng.randrange(60)}", rng.choice([40, 50, 100]), i) for i in range(240)]
    apart = spark.range(50_000).selectExpr("concat('/far', id % 5000) AS src", "concat('/far', id % 7) AS dst", "40 AS priority", "id AS pos")
    edges = spark.createDataFrame(links, "src string, dst string, priority int, pos long").unionByName(apart)
    starts = spark.createDataFrame([("a", "/0", 0, 100, 9), ("a", "/7", 1, 50, 2), ("b", "/1", 0, 100, 1), ("c", "/none", 0, 100, 1)], "job string, url string, depth int, priority int, seq long")
    jobs_ = spark.createDataFrame([("a", 25, 4), ("b", 1000, 3), ("c", 5, 5)], "job string, max_pages int, max_depth int")
    got = frontier.simulate(jobs_, starts, edges, ahead).orderBy("job", "nth").collect()
    assert [(r.url, r.depth) for r in got if r.job == "a"] == queue_order([("/7", 1, 50), ("/0", 0, 100)], links, 25, 4)
    assert [(r.url, r.depth) for r in got if r.job == "b"] == queue_order([("/1", 0, 100)], links, 1000, 3)
    assert [(r.job, r.nth, r.url, r.depth) for r in got if r.job == "c"] == [("c", 0, "/none", 0)]
    assert sizes and max(sizes) < 1000


def test_robots_odd(spark):
    """Nulls, empty files, every kind of line end, and a colon-less line between two agents."""
    rows = [("a", "User-agent: x\r\nnonsense\rUSER-AGENT : y\nDisallow:/p\u2028Disallow: /q"), ("b", None), ("c", "")]
    got = robots.parse(spark.createDataFrame(rows, "domain string, content string"))
    assert sorted((r.domain, r.grp, r.agent) for r in got.groups.collect()) == [("a", 0, "x"), ("a", 0, "y")]
    assert sorted((r.grp, r.allow, r.pattern) for r in got.rules.collect()) == [(0, False, "/p"), (0, False, "/q")]
    checks = [(1, "a", "X", "https://a/p%C3%A9"), (2, "a", "Z", "https://a/p"), (3, "b", "x", "https://b/"), (4, "c", "", None), (5, "z", "x", "https://z/")]
    verdict = robots.allowed(spark.createDataFrame(checks, "id int, domain string, agent string, url string"), got)
    assert {r.id: r.allowed for r in verdict.collect()} == {1: False, 2: True, 3: True, 4: True, 5: True}


def test_addresses(spark):
    import ipaddress
    import random

    rng = random.Random(2)
    ips = [str(ipaddress.IPv4Address(rng.randrange(2**32))) for _ in range(300)] + [str(n[i]) for n in ipaddress._IPv4Constants._private_networks for i in (0, -1)]
    ips += [str(ipaddress.IPv6Address(rng.randrange(2**128))) for _ in range(100)] + ["::ffff:8.8.8.8", "1.2.3.04", "", "fe80::1%eth0"]
    never = [ipaddress.ip_network(n) for n in addresses.NEVER]

    def safe(ip, private):
        try:
            a = ipaddress.ip_address(ip)
        except ValueError:
            return False
        bad = a.is_loopback or a.is_private or a.is_link_local or a.is_multicast or a.is_reserved or a.is_unspecified
        return not any(a in n for n in never) and (private or not bad)

    rows = spark.createDataFrame([(ip, p) for ip in ips for p in (True, False)], "ip string, p boolean")
    for r in rows.select("ip", "p", addresses.ip_safe(F.col("ip"), F.col("p")).alias("safe")).collect():
        assert r.safe == safe(r.ip, r.p), r


def test_fetch_limits(spark):
    """Six redirects in a row, a hop that only ever answers 429, and a request whose records end after a redirect."""
    cols = "request int, hop int, attempt int, url string, at timestamp, status int, error string, timeout boolean, content_type string, length long, location string, retry_after string"
    from datetime import datetime

    row = lambda r, h, a, status, error=None, to="/n": (r, h, a, f"https://x.org/{h}", datetime(2024, 1, 1), status, error, error == "slow", "text/html", 5, to, None)
    rows = [row(1, h, 0, 302) for h in range(6)] + [row(2, 0, a, 429) for a in range(3)] + [row(3, 0, 0, 301)] + [row(4, 0, 0, 200, "slow"), row(4, 0, 1, 503), row(4, 0, 2, 503)] + [row(5, 0, 0, 200, "bad")]
    got = {r.request: (r.status, r.error, r.redirects, r.n_attempts, r.waited) for r in fetch.fetched(spark.createDataFrame(rows, cols)).collect()}
    assert got == {
        1: (0, "Exceeded maximum redirects limit of 5", 5, 6, 0.0), 2: (0, "Connection failed: None", 0, 3, 6.0), 3: (None, None, 0, 1, 0.0),
        4: (503, None, 0, 3, 1.5), 5: (0, "Connection failed: bad", 0, 1, 0.0),
    }


def test_jobs_without_rows(spark):
    none = spark.createDataFrame([], "job int, event_id int, status string, error_message string, started_at int, completed_at int, " + ", ".join(f"{c} int" for c in jobs.COUNTERS))
    assert jobs.after(none, ["event_id"]).count() == 0
    stats = jobs.statistics(jobs.after(none, ["event_id"]), spark.createDataFrame([], "type string")).first()
    assert set(stats.asDict().values()) == {0}


def test_page_contacts(spark):
    from quarryline.operators.pages import page_contacts

    html = (
        '<header><a href="https://www.linkedin.com/company/Acme?x=1">Acme</a></header><p>Write to info@example.org, ann [at] example [dot] org or INFO@example.org.</p>'
        '<address><a href="mailto:a%2Eb@example.org?subject=x">Mail <b>us</b></a></address><footer><a href="MAILTO:info@example.org"></a>'
        '<a href="tel:+44 20 7946 0958">call</a></footer><p>Call (415) 555-2671 or 2024-01-02. linkedin.com/in/jane-doe</p><a href="mailto:">none</a>'
    )
    rows = [(1, "https://example.com/x", html), (2, "https://example.com/contact", "<p>x@example.org</p>"), (3, None, None)]
    got = page_contacts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {(r.page_id, r.type, r.value, r.normalized_value, r.confidence, r.source_type) for r in got} == {
        (1, "linkedin", "https://www.linkedin.com/company/Acme", "https://www.linkedin.com/company/acme", 0.98, "header"),
        (1, "linkedin", "https://www.linkedin.com/in/jane-doe", "https://www.linkedin.com/in/jane-doe", 0.85, "body"),
        (1, "email", "a.b@example.org", "a.b@example.org", 0.95, "address"), (1, "email", "info@example.org", "info@example.org", 0.88, "footer"),
        (1, "email", "ann [at] example [dot] org", "ann@example.org", 0.75, "body"), (1, "phone", "+44 20 7946 0958", "+442079460958", 0.95, "footer"),
        (1, "phone", "(415) 555-2671", "+14155552671", 0.88, "body"), (2, "email", "x@example.org", "x@example.org", 0.90, "body"),
    }
    assert {r.context for r in got if r.source_type in ("address", "footer")} == {"Mailus", "mailto:info@example.org", "call"}


def test_exports(spark, tmp_path):
    import csv
    import json
    from datetime import datetime

    schema = "id string, type string, value string, normalized_value string, country string, confidence double, source_type string, context string, url string, created_at timestamp, job string"
    at = datetime(2024, 1, 2, 3, 4, 5)
    rows = [("1", "email", "B", "b", None, 0.951, "body", 'say "hi", ok', "u", at, "j"), ("2", "email", "A", "a", "US", 0.9, "tel", None, "u", at, "j")]
    found = spark.createDataFrame(rows, schema)
    got = json.loads(O.export_json(found).first().json)
    assert [(r["normalized"], r["country"], r["confidence"], r["source_url"], r["source_type"], r["created_at"]) for r in got] == [
        ("a", "US", 0.9, "u", "tel", "2024-01-02T03:04:05"), ("b", None, 0.95, "u", "body", "2024-01-02T03:04:05")
    ]
    assert json.loads(O.export_json(found.limit(0)).first().json) == []
    O.write_csv(found.coalesce(1), f"file://{tmp_path}/out")
    text = next(tmp_path.glob("out/*.csv")).read_bytes().decode()
    assert text.startswith("type,value,normalized,country,confidence,source_type,source_url,context\r\n")
    assert sorted(csv.reader(text.splitlines()))[:2] == [["email", "A", "a", "US", "0.90", "tel", "u", ""], ["email", "B", "b", "", "0.95", "body", "u", 'say "hi", ok']]


def test_streams_without_input(spark, tmp_path):
    from quarryline.streaming import contacts as stream
    from quarryline.streaming import dispatch

    (tmp_path / "in").mkdir()
    found = spark.readStream.schema("type string, normalized_value string, value string, job string, page string, confidence double, country string, ord int").json(f"file://{tmp_path}/in")
    assert stream.run(found, ["ord"], f"file://{tmp_path}/a").count() == 0
    assert dispatch.dispatch(dispatch.requests(spark, f"file://{tmp_path}/in"), f"file://{tmp_path}/b").count() == 0


def test_references():
    """References by number, and by a name with its semicolon; in anchors, too, but not in comments."""
    assert H.resolved("&amp &ampx; &amp; &#233 &#xe9; &nope; &copy=1 &#; &") == "&amp &ampx; & é é &nope; &copy=1 &#; &"
    walker = H._walk("<a href='/x?a=1&copy=2&amp;b=3'>&lt;go&gt;</a><!--&lt;&amp--><p>end &amp")
    assert walker.links == [("anchor", "/x?a=1&copy=2&b=3")] and [t for t, _ in walker.nodes] == ["<go>", "&lt;&amp", "end &amp"]


@pytest.mark.parametrize("parse", [H.pieces, H.text_nodes, H.raw_links])
def test_pages_are_walked_a_few_at_a_time(parse):
    """A batch of many pages gives its rows in small batches."""
    import pyarrow as pa

    class Pages:
        def select(self, *names):
            self.names = names
            return self

        def mapInArrow(self, run, schema):
            n = 1000
            cols = {"page_id": pa.array(range(n), pa.int64()), "url": pa.array(["https://x.org/"] * n), "html": pa.array(["<a href='/y'>y</a>"] * n)}
            return list(run(iter([pa.RecordBatch.from_arrays([cols[c] for c in self.names], list(self.names))])))

    got = parse(Pages())
    assert [i for b in got for i in b.column(0).to_pylist()] == list(range(1000)) and max(b.num_rows for b in got) <= H.PAGES_AT_ONCE
