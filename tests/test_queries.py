"""Each query with SQL gives the same rows as DuckDB."""

import glob
import hashlib
import json
import os
import re

import duckdb
import pytest

from quarryline.plans import queries as Q

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def rows(df, cols):
    return sorted(map(repr, df[cols].astype(object).where(df[cols].notna(), None).itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(Q.ORACLE))
def test_oracle(spark, con, name):
    got = Q.QUERIES[name](spark, SF)
    want = con.execute(Q.ORACLE[name]).fetchdf()
    cols = sorted(got.columns)
    assert sorted(want.columns) == cols
    assert rows(got.toPandas(), cols) == rows(want, cols)


@pytest.mark.parametrize("name", sorted(set(Q.QUERIES) - set(Q.ORACLE)))
def test_rows(spark, name):
    assert Q.QUERIES[name](spark, "/root/testdata/sf0.01").count() > 0  # the smallest pages hold no contact


def dialled(raw):
    """E.164, whether it is valid, and the country of a number as seen from the US; by the numbering plans, in plain code."""
    from quarryline.functions import contacts as C

    d, plans = re.sub("[^0-9]", "", raw), {p[0]: p for p in C.PLANS}
    far = d if raw.lstrip("( ").startswith("+") else d[3:] if d.startswith("011") else None
    code = "1" if far is None else next((far[:k] for k in (1, 2, 3) if far[:k] in plans), None)
    if code is None:
        return ("+" + far, True, None) if 8 <= len(far) <= 15 else None
    _, region, trunk, lo, hi = plans[code]
    rest = d if far is None else far[len(code) :]
    if trunk and rest.startswith(trunk) and lo <= len(rest) - len(trunk) <= hi:
        rest = rest[len(trunk) :]
    full = lo <= len(rest) <= hi
    if not full and not (far is None and len(rest) == 7):
        return None
    valid = full and bool(re.fullmatch(r"[2-9]\d\d[2-9]\d{6}", rest) if code == "1" else region == "IT" or rest[0] != "0")
    return "+" + code + rest, valid, ("CA" if valid and rest[:3] in C.CANADA else "US") if code == "1" else region if valid else None


def brute(docs):
    """(type, normalized): value, job, page, best confidence and country of the contacts in whole texts, the first of each by id."""
    from quarryline.functions import contacts as C

    out = {}

    def add(kind, key, value, doc, confidence, country=None):
        first = out.setdefault((kind, key), [value, doc[2], str(doc[0]), confidence, country])
        first[3] = max(first[3], confidence)
        first[4] = first[4] or country

    def email(address):
        return address.rsplit(".", 1)[1].lower() not in C.NOT_TLD and 2 <= len(address.rsplit(".", 1)[1]) <= 24

    for doc in sorted(docs, key=lambda d: d[0]):
        text = doc[1] or ""
        for m in re.finditer(C.EMAIL, text, re.A):
            if email(m[0]):
                add("email", m[0].lower(), m[0], doc, 0.85)
        for m in re.finditer(C.OBFUSCATED, text, re.A):
            if email(address := f"{m[1]}@{m[2]}.{m[3]}"):
                add("email", address.lower(), m[0], doc, 0.75)
        for m in re.finditer(C.PHONE, text):
            raw, d = m[0], re.sub("[^0-9]", "", m[0])
            n, bare = len(d), not re.search("[-() +]", m[0])
            odd = re.fullmatch(r"\d{4}[-/.]\d{1,2}[-/.]\d{1,2}", raw) or d in ("0123456789", "1234567890", "0987654321", "9876543210")
            if n < 7 or n > 15 or odd or len(set(d)) == 1 or (bare and (n <= 8 or len(set(d)) <= 3)):
                continue
            if found := dialled(raw):
                add("phone", found[0], raw, doc, 0.95 if raw[0] == "+" and found[1] else 0.88 if found[1] else 0.75, found[2])
        for m in re.finditer(C.PROFILE, text):
            if len(m[2]) >= 2 and m[2].lower() not in C.NO_PROFILE:
                clean = f"https://www.linkedin.com/{m[1].lower()}/{m[2]}"
                add("linkedin", clean.lower(), clean, doc, 0.85)
    return {(*k, *v) for k, v in out.items()}


COLS = ["type", "normalized_value", "value", "job", "page", "confidence", "country"]


def test_all_kinds(spark, tmp_path):
    """All kinds of contacts reach dedup, counts, lists, pages, exports and stream, in whole texts."""
    far = "filler words " * 20_000
    docs = [
        (3, "Mail Ann@Example.com or +1 (415) 555-2671, see https://www.linkedin.com/in/Jane-Doe/ now", "b"),
        (1, "write to bob [at] example [dot] com or bob@example.com, call 415-555-2671", "a"), (2, far + "linkedin.com/company/Acme and ann AT example DOT com +44 20 7946 0958", "a"),
        (4, "no: logo@2x.png 2024-01-02 1111111111 12345678 linkedin.com/in/login", "c"), (5, None, "a"), (6, "", "b"), (7, "+44 (0)20 7946 0958 or 011 49 30 901820", None),
    ]
    folder = str(tmp_path)
    spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(3).write.parquet(f"{folder}/documents.parquet")
    want = brute(docs)
    assert {k[0] for k in want} == {"email", "phone", "linkedin"} and len(want) == 7
    run = lambda name: Q.QUERIES[name](spark, folder).collect()
    for name in ("contacts_dedup", "contacts_stream"):
        got = [tuple(r[c] for c in COLS) for r in run(name)]
        assert len(got) == len(want) and set(got) == want
    assert {tuple(r) for r in run("contacts_new_per_job")} == {("a", 2, 2, 1), ("b", 0, 0, 1), (None, 0, 1, 0)}
    assert {r.normalized_value for r in run("contacts_list_search")} == {"+14155552671"}
    newest = sorted(sorted(run("contacts_joined"), key=lambda r: r.id), key=lambda r: r.created_at, reverse=True)
    assert [tuple(r) for r in run("contacts_page")] == [tuple(r) for r in newest[2:]]
    for name in ("export_csv", "export_csv_file", "export_json_file"):
        assert sorted((r.type, r.normalized) for r in run(name)) == sorted(r[:2] for r in want)
    objects = [json.loads(r.object) for r in run("export_json")]
    assert {tuple(x) for x in objects} == {("type", "value", "normalized", "country", "confidence", "source_type", "source_url", "context", "created_at")}
    assert sorted((x["type"], x["normalized"], x["confidence"]) for x in objects) == sorted((r[0], r[1], r[5]) for r in want)


def test_all_kinds_of_documents(spark):
    docs = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "source").collect()]
    got = Q.QUERIES["contacts_dedup"](spark, "/root/testdata/sf0.01").collect()
    assert {tuple(r[c] for c in COLS) for r in got} == brute(docs)


def test_page_store(spark):
    """Two appended writes hold every page once; failed ones have neither title nor hash; ids follow from job and url."""
    got = Q.QUERIES["page_store"](spark, SF).collect()
    want = {r.url: r.page_id for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    assert len(got) == len(want) and {r.url for r in got} == set(want)
    for r in got:
        n = want[r.url]
        assert r.crawl_job_id == f"j{n % 5}" and (r.status_code == 503) == (n % 7 == 0) == (r.content_hash is None) and r.id == hashlib.sha256(f"j{n % 5}\n{r.url}".encode()).hexdigest()[:32]


def test_links_below_host(spark, tmp_path):
    html = "".join(f'<a href="{u}">x</a>' for u in ("/a", "https://blog.example.com/b", "https://x.Blog.Example.com/c", "https://notexample.com/d", "https://com/e", "https://other.org/f"))
    pages = [(1, "https://example.com/", html), (2, "https://blog.example.com/", html)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {(r.page_id, r.url) for r in Q.QUERIES["html_links"](spark, str(tmp_path)).collect()}
    below = ["https://blog.example.com/b", "https://x.blog.example.com/c"]
    assert got == {(1, "https://example.com/a"), *[(1, u) for u in below], (2, "https://blog.example.com/a"), *[(2, u) for u in below]}


@pytest.mark.parametrize("name", ["html_text_nodes", "html_title", "page_report", "page_store"])
def test_cut_references(spark, tmp_path, name):
    """A name that no semicolon ends is no reference, in titles and text nodes; the same rows as SQL."""
    heads = ["x&amp;&amp", "a &am", "&copy b &middot;", "&amp;amp", "&quot", "&amp;copy; &quot;q&quot;"]
    html = [f"<html><head><title>{h}</title></head><body><h1>{h}</h1><p>p &amp<b>b &amp;</b></p><!-- c &amp; d --><footer>{h}</footer></body></html>" for h in heads]
    pages = [(i, f"https://x.example.com/{i}", h) for i, h in enumerate(html, 1)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = c.execute(Q.ORACLE[name]).fetchdf()
    assert rows(Q.QUERIES[name](spark, str(tmp_path)).toPandas(), sorted(want.columns)) == rows(want, sorted(want.columns))


def test_texts_are_searched_once(spark):
    """A listing joins contacts with their sources; both come from one search of the texts."""
    assert Q.QUERIES["contacts_joined"](spark, SF)._jdf.queryExecution().toString().count("posexplode(") < 2


def test_text_without_marks(spark, tmp_path):
    """A long run of short labels holds no obfuscated email and no profile; it is not searched for them from each of its places."""
    docs = [(1, "a." * 30_000 + " call 415-555-2671", "a"), (2, "b. [at]Ab.org DOT uk; c_AT x[dot]de", "a"), (3, "x AT y DOT comm2 é.bob (at) ex.org [.] com", "b"), (4, "linkedin.com/IN/Ann-B LinkedIn.com/feed/x AT", "b")]
    spark.createDataFrame(docs, "doc_id long, text string, source string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = Q.QUERIES["contacts_dedup"](spark, str(tmp_path)).collect()
    want = [("email", ".bob@ex.org.com"), ("email", "b.@ab.org.uk"), ("linkedin", "https://www.linkedin.com/in/ann-b"), ("phone", "+14155552671")]
    assert sorted((r.type, r.normalized_value) for r in got) == want
