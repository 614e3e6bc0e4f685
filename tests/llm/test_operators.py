"""Operators against brute force, on a small table and on one with every odd case."""

import hashlib
import math
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarryline.llm import binary, blocks, ctw, exact_dedup, mixing, near_dedup, packing, quality, sharding, suffix_dedup, tokens, url_filter

from quarryline import session

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def texts(df):
    return [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]


@pytest.mark.parametrize("which", ["odd", "none", "small"])
def test_suffix(request, which):
    docs = request.getfixturevalue(which)
    known = defaultdict(lambda: math.inf)
    data = [(d, t.encode()) for d, t in texts(docs)]
    for d, b in data:
        for p in range(len(b) - 49) if d is not None else ():
            known[b[p : p + 50]] = min(known[b[p : p + 50]], d)
    want = Counter()
    for d, b in data:
        gone = bytearray(len(b))
        for p in range(len(b) - 49) if d is not None else ():
            if known[b[p : p + 50]] < d:
                gone[p : p + 50] = b"\1" * 50
        left = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        want[(d, len(b), sum(gone), spans, hashlib.sha256(left).hexdigest())] += 1
    got = suffix_dedup.remove_repeats(docs).collect()
    assert Counter(tuple(r)[:5] for r in got) == want
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in got)


def small_parts(monkeypatch, module, bucket, block):
    """Many buckets, reached over several levels by a fan of 4, with batches of a few messages."""
    for name, x in (("FAN", 4), ("LEAST_BUCKETS", 1), ("BATCH_BYTES", 20_000)):
        monkeypatch.setattr(blocks, name, x)
    monkeypatch.setattr(module, "BUCKET_BYTES", bucket)
    monkeypatch.setattr(module, "BLOCK_BYTES", block)


def test_suffix_turns(small, monkeypatch):
    """Not all messages are shuffled at once: buckets are answered in turns, each once, with the same rows."""
    want = Counter(tuple(r)[:5] for r in suffix_dedup.remove_repeats(small).collect())
    settle, read = session.settle, []

    def spied(df, by=None):
        out = settle(df, by)
        if by is None:
            read.append({r.bucket for r in out.where(F.col("kind") == blocks.ANSWER).select("bucket").collect()})
        return out

    monkeypatch.setattr(blocks, "settle", spied)
    monkeypatch.setattr(blocks, "TURN_BUCKETS", 16, raising=False)
    assert Counter(tuple(r)[:5] for r in suffix_dedup.remove_repeats(small).collect()) == want
    for turns in (read[:5], read[5:]):  # four turns and all their answers, for anchors and for strings
        assert len(turns) == 5 and sum(map(len, turns[:4])) == len(turns[4]) == len(set.union(*turns[:4]))


@pytest.mark.parametrize("bucket", [40_000, 2_000])
def test_suffix_levels(small, monkeypatch, bucket):
    small_parts(monkeypatch, suffix_dedup, bucket, 60_000)
    assert len(blocks.widths_of(small, "text", bucket)) >= 2
    got = Counter(tuple(r)[:5] for r in suffix_dedup.remove_repeats(small).collect())
    monkeypatch.undo()
    assert got == Counter(tuple(r)[:5] for r in suffix_dedup.remove_repeats(small).collect())


def test_common_anchors(small, monkeypatch):
    """Windows of common anchors travel one by one, with the same result."""
    want = Counter(tuple(r)[:5] for r in suffix_dedup.remove_repeats(small).collect())
    common = suffix_dedup.anchor_exchange

    def lowered(widths):
        x = common(widths)

        def answer(payloads):
            asked, anchor, n = suffix_dedup.anchors_asked(payloads)
            state = np.where(n >= 2, 2, 0).astype(np.uint8)
            return [blocks.squeeze(state[np.searchsorted(anchor, a)]) for a in asked]

        return blocks.Exchange(x.widths, x.merge, x.split, answer, x.spread)

    monkeypatch.setattr(suffix_dedup, "anchor_exchange", lowered)
    assert Counter(tuple(r)[:5] for r in suffix_dedup.remove_repeats(small).collect()) == want


@pytest.mark.parametrize("buckets", [64, 512, 4096, 262_144])
def test_messages_stay_few(buckets):
    """However many buckets there are, a sender of a level sends FAN messages at most."""
    widths, n = [], buckets
    while n > blocks.FAN:
        widths.append(blocks.FAN)
        n = -(-n // blocks.FAN)
    widths.append(n)
    rng = np.random.default_rng(1)
    anchor = np.unique(rng.integers(0, 1 << 40, 50_000).astype(np.uint64))
    x = suffix_dedup.anchor_exchange(widths)
    sent = [list(x.split((anchor, np.ones(len(anchor), np.uint16)), level)) for level in range(len(widths))]
    assert all(len(m) <= blocks.FAN for m in sent) and np.prod(widths) >= buckets
    assert sum(len(p) for _, p in sent[0]) < 9 * len(anchor) + 200 * len(sent[0])
    back = np.sort(np.concatenate([blocks.undeltas(blocks.unsqueeze(p)[0]) for _, p in sent[0]]))
    assert (back == anchor).all()


def test_cover_and_order():
    assert {(a - b) % suffix_dedup.COVER for a in suffix_dedup.SAMPLE for b in suffix_dedup.SAMPLE} == set(range(suffix_dedup.COVER))
    rng = np.random.default_rng(1)
    text = np.concatenate([rng.integers(97, 99, 400, dtype=np.uint8), np.full(300, 97, np.uint8), np.tile(rng.integers(97, 100, 70, dtype=np.uint8), 4)])
    at, group = suffix_dedup.window_classes(text, np.arange(len(text) - 49))
    raw = text.tobytes()
    windows = [raw[p : p + 50] for p in at.tolist()]
    assert windows == sorted(windows)
    assert [a == b for a, b in zip(windows, windows[1:])] == (group[1:] == group[:-1]).tolist()


def base(text):
    words, n = WORD.findall(text), 0
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    hit = set()
    for i in range(len(words) - 4):
        if windows[tuple(words[i : i + 5])] > 1:
            hit.update(range(i, i + 5))
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n = len(hit)
    failed = len(words) < 10 or 100 * n > 20 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), n, failed


@pytest.mark.parametrize("which", ["odd", "none", "small"])
def test_quality(spark, request, which):
    docs = request.getfixturevalue(which)
    labels = spark.createDataFrame([(1, 1, 0), (8, 1, 0), (3, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    ratios = quality.fit(docs, labels)
    got = quality.score_documents(docs, ratios).collect()
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == Counter((d, *base(t)) for d, t in texts(docs))
    assert all(r.kept == (not r.base_failed and r.score >= quality.THRESHOLD) for r in got)
    assert quality.kept_documents(docs, ratios).count() == sum(r.kept for r in got)
    assert quality.kept_documents(docs, ratios).columns == docs.columns


def bucket_numbers(spark, texts):
    """Bucket of each word and of each two words in a row, by the engine's hash of a long and of a text, all else in Python."""
    from pyspark.sql import functions as F

    words = sorted({w for t in texts for w in WORD.findall(t)})
    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", F.xxhash64("w").alias("h")).collect()
    h = {r.w: r.h for r in rows}
    pairs = sorted({(h[a], h[b]) for t in texts for ws in [WORD.findall(t)] for a, b in zip(ws, ws[1:])})
    two = spark.createDataFrame(pairs, "a long, b long").select("a", "b", F.xxhash64("a", "b").alias("h")).collect() if pairs else []
    b = {(r.a, r.b): r.h for r in two}
    return [[h[w] % quality.BUCKETS for w in ws] + [b[h[x], h[y]] % quality.BUCKETS for x, y in zip(ws, ws[1:])] for ws in map(WORD.findall, texts)]


@pytest.mark.parametrize("which", ["odd", "small"])
def test_quality_score(spark, request, which):
    """Score and verdict against log ratios that are counted in Python."""
    docs = request.getfixturevalue(which).select("doc_id", "text")
    good = {1, 8, 10, 40, 41, 42, 43, 44}
    labels = spark.createDataFrame([(d, 1, 0) for d in good] + [(2, 0, 0), (5, 1, 1), (None, 1, 0)], "doc_id long, quality int, toxic int")
    rows = texts(docs)
    grams = bucket_numbers(spark, [t for _, t in rows])
    raw, target = Counter(range(quality.BUCKETS)), Counter()
    for (d, _), g in zip(rows, grams):
        raw.update(g)
        if d in good:
            target.update(g)
    n, m, prior = sum(raw.values()), sum(target.values()), quality.PRIOR * quality.BUCKETS
    ratio = lambda x: math.log((target[x] + prior * raw[x] / n) / (m + prior) / (raw[x] / n))
    want = defaultdict(list)
    for (d, t), g in zip(rows, grams):
        want[(d, len(WORD.findall(t)))].append(sum(map(ratio, g)) / max(1, len(g)))
    got = defaultdict(list)
    for r in quality.score_documents(docs, quality.fit(docs, labels)).collect():
        got[(r.doc_id, r.n_words)].append(r.score)
        assert abs(r.score - quality.THRESHOLD) < 1e-5 or r.kept == (not r.base_failed and r.score >= quality.THRESHOLD)
    assert got.keys() == want.keys()
    for k in want:
        assert np.allclose(sorted(got[k]), sorted(want[k]), atol=2e-6)


@pytest.mark.parametrize("which", ["odd", "none", "small"])
def test_mixing(request, which):
    docs = request.getfixturevalue(which)
    got = mixing.mix_report(docs).collect()
    assert len(got) == docs.count()
    by = defaultdict(list)
    for r in got:
        assert r.taken <= 3 * r.size and r.target <= 3 * r.source_size + 1e-6
        by[(r.source_size, r.target)].append(r)
    assert math.isclose(sum(t for _, t in by), sum(r.size for r in got), abs_tol=1e-6)
    for (size, target), rs in by.items():
        assert abs(sum(r.taken for r in rs) - target) <= mixing.BLOCK
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    assert sum(len(WORD.findall(r.text)) for r in out.collect()) == sum(r.taken for r in got)


def filled(sizes):
    """Targets by filling: sources by code point, null last; what is over three times a size is shared again."""
    names = sorted((x for x in sizes if x is not None), key=lambda x: x.encode()) + [x for x in sizes if x is None]
    weight = {x: i % 3 + 1 for i, x in enumerate(names)}
    target, free, left = {}, set(names), float(sum(sizes.values()))
    while free:
        share = left / sum(weight[x] for x in free)
        over = {x for x in free if share * weight[x] > 3 * sizes[x]}
        if not over:
            return target | {x: share * weight[x] for x in free}
        for x in over:
            target[x] = 3.0 * sizes[x]
            left -= target[x]
        free -= over
    return target


def test_targets_by_filling(spark):
    rng = np.random.default_rng(8)
    for n in (1, 2, 7, 30):
        sizes = {f"s{i}": int(rng.integers(0, 10 ** int(rng.integers(1, 6)))) for i in range(n)} | {None: 5, "\u00e9": 40, "": 7}
        got = mixing.targets_of(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
        want = filled(sizes)
        assert len(got) == len(want)
        for r in got:
            assert math.isclose(r.target, want[r.source], rel_tol=1e-9, abs_tol=1e-6)


def test_shard_counts(spark):
    """Each shard is full, sources get what they are due, and counts spread over shards as a multinomial draw's."""
    sizes = [("a", 40_000 * mixing.BLOCK), ("b", 40_000 * mixing.BLOCK), ("c", 80_000 * mixing.BLOCK)]
    sources = mixing.targets_of(spark.createDataFrame(sizes, "source string, source_size long"))
    counts = defaultdict(dict)
    for r in mixing.shard_counts(sources).collect():
        counts[r.shard][r.source] = r.slots
    totals = {r.source: round(r.target / mixing.BLOCK) for r in sources.collect()}
    assert {x: sum(c.get(x, 0) for c in counts.values()) for x in totals} == totals
    n = sum(totals.values())
    full = [c for c in counts.values() if sum(c.values()) == mixing.SHARD_SLOTS]
    assert len(full) >= len(counts) - 1
    chi = sum((c[x] - mixing.SHARD_SLOTS * t / n) ** 2 / (mixing.SHARD_SLOTS * t / n) for c in full for x, t in totals.items())
    freedom = 2 * len(full)
    assert abs(chi - freedom) < 5 * math.sqrt(2 * freedom)


def test_mixed_clashing_columns(spark):
    rows = [(1, "a b c d " * 60, "x", 1, 2, 3, 4, 5, 6, 7, 8), (2, "e f g " * 90, None, 1, 2, 3, 4, 5, 6, 7, 8), (2, "e f g " * 90, None, 1, 2, 3, 4, 5, 6, 7, 9)]
    names = ["_id", "_times", "_size", "_text", "_n", "_w", "_copy", "row"]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"{c} int" for c in names))
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    assert {tuple(r)[3:10] for r in out.collect()} == {(1, 2, 3, 4, 5, 6, 7)}
    report = mixing.mix_report(docs).collect()
    assert sum(len(WORD.findall(r.text)) for r in out.collect()) == sum(r.taken for r in report)


def test_permutation(spark):
    from pyspark.sql import functions as F

    for n in (1, 2, 7, 100):
        got = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(3)).alias("p")).collect()
        assert sorted(r.p for r in got) == list(range(n))


def test_urls(spark):
    urls = ["http://a.Net/x", "https://m.example.net/en/1?x", "http://example.net", "http://x.org/fr/1", "http://xorg/fr/", "http://org/fr/#a", None, "nothing", "https://b.example.com/de/1", "http://net?x"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.filter_urls(pages, url_filter.standard_rules(spark)).collect()}
    assert got == {
        0: ("net/", "block"), 1: ("example.net/en/", "allow"), 2: (None, "allow"), 3: ("org/fr/", "allow"), 4: (None, "allow"), 5: ("org/fr/", "allow"),
        6: (None, "allow"), 7: (None, "allow"), 8: ("example.com/de/", "block"), 9: (None, "allow"),
    }
    assert url_filter.filter_urls(pages.limit(0), url_filter.standard_rules(spark)).count() == 0


def judged(url, rules):
    """The rule and verdict of a URL by trying every rule."""
    url = url or ""
    head, sep, rest = url.partition("://")
    host = re.split(r"[/?#]", rest, maxsplit=1)[0] if sep else ""
    host = "".join(c.lower() if c.isascii() else c for c in host)
    path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0] if sep else ""
    fits = [r for r in rules if r[0] and (host == r[0].lower() or host.endswith("." + r[0].lower())) and path.startswith(r[1] or "")]
    if not fits:
        return host, path, None, "allow"
    best = max(fits, key=lambda r: (len(r[0]) + len(r[1] or ""), len(r[0]), r[2]))
    return host, path, best[0].lower() + (best[1] or ""), best[2]


@pytest.mark.parametrize("bound", [16 << 20, -1])
def test_urls_by_trying(spark, monkeypatch, bound):
    """Repeated rows, long URLs, clashing columns, tied and repeated rules; once with the rules joined by a shuffle."""
    monkeypatch.setattr(url_filter, "BROADCAST_BYTES", bound)
    rng = np.random.default_rng(6)
    hosts = ["a.org", "b.a.org", "org", "x.b.a.org", "A.ORG", "ba.org", "", "com"]
    paths = ["/", "/x", "/x/y", "/x/yz", "", "/" + "p" * 3000, "/x y"]
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    rules = [(pick(hosts), pick(paths), pick(["allow", "block"])) for _ in range(25)] + [("a.org", "/x", "allow"), ("a.org", "/x", "block"), ("com", None, "block"), ("", "/x", "block")]
    urls = [f"{pick(['http', 'https', 'x'])}{pick(['://', '://', ':/'])}{pick(hosts)}{pick(paths)}{pick(['', '?q=/x', '#/x'])}" for _ in range(400)] + [None, "", "://", None]
    rows = [(i // 2, u, "host?", "rule?", 1) for i, u in enumerate(urls)]
    got = url_filter.filter_urls(
        spark.createDataFrame(rows, "page_id long, url string, host string, rule string, id int").repartition(3), spark.createDataFrame(rules, "host string, path string, verdict string")
    )
    assert Counter(tuple(r) for r in got.collect()) == Counter((i, *judged(u, rules)) for i, u, *_ in rows)


@pytest.mark.parametrize("which", ["odd", "none", "small"])
def test_scoring(request, which):
    docs = request.getfixturevalue(which)
    rows, c = texts(docs), Counter()
    held = lambda d: zlib.crc32(b"" if d is None else str(d).encode()) % 10 == 0
    for d, t in rows:
        if not held(d):
            c.update([*t.encode().lower().split(), None])
    n, v = sum(c.values()), len(c)
    got = defaultdict(list)
    for r in ctw.score_documents(docs).collect():
        got[r.doc_id].append(r)
    assert sum(map(len, got.values())) == len(rows)
    for d, t in rows:
        ws = [*t.encode().lower().split(), None]
        want = sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)
        assert any((r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(ws), sum(c[w] > 0 for w in ws), n, held(d)) and math.isclose(r.base_score, want, rel_tol=1e-9) for r in got[d])
        assert all(r.score < 0 for r in got[d])


def plain_tree(texts, depth=ctw.DEPTH):
    """log10 probability of each text under context-tree weighting learned from the training ones, node by node."""
    counts = defaultdict(lambda: [0, 0])

    def decisions(data):
        data = bytes([255] * depth) + data + b"\xff"
        for i in range(depth, len(data)):
            place = 1
            for k in range(8):
                bit = data[i] >> (7 - k) & 1
                yield [(d, data[i - d : i], place) for d in range(depth + 1)], bit
                place = place << 1 | bit

    for train, data in texts:
        for nodes, bit in decisions(data) if train else ():
            for node in nodes:
                counts[node][bit] += 1
    kt = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.log(math.pi) - math.lgamma(a + b + 1)
    weighted, below = {}, defaultdict(float)
    for node in sorted(counts, key=lambda x: -x[0]):
        own = kt(*counts[node])
        weighted[node] = own if node[0] == depth else np.logaddexp(own, below[node]) - math.log(2)
        if node[0]:
            below[(node[0] - 1, node[1][1:], node[2])] += weighted[node]
    out = []
    for _, data in texts:
        total = 0.0
        for nodes, bit in decisions(data):
            p = 0.5
            for node in reversed(nodes):
                if node in counts:
                    a, b = counts[node]
                    own = ((b if bit else a) + 0.5) / (a + b + 1)
                    w = 1.0 if node[0] == depth else math.exp(math.log(0.5) + kt(a, b) - weighted[node])
                    p = w * own + (1 - w) * p
            total += math.log10(p)
        out.append(total)
    return out


def score_cases():
    rows = [(i, f"text {i % 7} of some words, the {i % 3}th of them: {'abc' * (i % 5)}") for i in range(60)]
    return [*rows, (60, None), (61, ""), (62, "\u00e9\u6f22\u5b57"), (5, rows[5][1]), (None, "without an id")]


@pytest.mark.parametrize("levels", [False, True])
def test_score_by_plain_tree(spark, monkeypatch, levels):
    """The score of each text, to many digits, against a tree of Python dicts; once over several levels of messages."""
    rows = score_cases()
    if levels:
        small_parts(monkeypatch, ctw, 300, 900)
    held = lambda d: zlib.crc32(b"" if d is None else str(d).encode()) % 10 == 0
    want = plain_tree([(not held(d), (t or "").encode()) for d, t in rows])
    got = ctw.score_documents(spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, _text string, _n int").repartition(3)).collect()
    key = lambda d, n, s: (d is None, d or 0, n, round(s, 7))
    assert sorted(key(r.doc_id, r.n_tokens, r.score) for r in got) == sorted(key(d, len((t or "").split()) + 1, s) for (d, t), s in zip(rows, want))


def test_scoring_holds_little(spark, monkeypatch):
    """What a task of scoring holds at once of a block of texts and of a bucket's messages, by numpy's and Python's own count."""
    got = {}
    for name, at in (("make", 4), ("ascend", 1), ("by_block", 1)):
        monkeypatch.setattr(blocks, name, lambda *a, f=getattr(blocks, name), name=name, at=at: got.update({name: a[at]}) or f(*a))
    ctw.score_documents(spark.createDataFrame([(1, "a text")], "doc_id long, text string"))
    rng = np.random.default_rng(5)
    names = np.array(["".join(map(chr, rng.integers(97, 123, int(n)))) for n in rng.integers(2, 10, 20_000)])
    docs = [" ".join(names[np.minimum(rng.zipf(1.3, 800), 20_000) - 1]).encode() for _ in range(1_500)]
    payload = blocks.pack(list(range(len(docs))), docs)
    size = sum(map(len, docs))

    def run(f):
        tracemalloc.start()
        try:
            return f(), tracemalloc.get_traced_memory()[1]
        finally:
            tracemalloc.stop()

    asked, asking = run(lambda: dict(got["make"](*blocks.unpack(payload))))
    answers = {b: got["ascend"].answer([m])[0] for b, m in asked.items()}
    rows, finishing = run(lambda: got["by_block"](0, answers, [payload]))
    message = max(asked.values(), key=len)
    grams = len(blocks.unsqueeze(message)[0])
    content, merging = run(lambda: ctw.merge([message] * (2_000_000 // grams)))
    assert rows.column(2).to_pylist() == [len(t.split()) + 1 for t in docs] and len(content.grams) == grams
    assert asking < 12 * size and finishing < 14 * size and merging < 32 << 20, (size, asking, finishing, merging)


def test_grams_by_chunk(monkeypatch):
    """Chunks cut texts anywhere, and each gram of each text is there once for each time it occurs."""
    rows = ["abcabcabcabc", "", "b", "", "", "a long text " * 9, "\u00e9\u6f22\u5b57", ""]
    data = [t.encode() for t in rows]
    want = Counter()
    for i, t in enumerate(data):
        padded = b"\xff" * 5 + t + b"\xff"
        want.update((int.from_bytes(padded[j : j + 6]), i) for j in range(len(t) + 1))
    lengths, flat = np.array([len(t) for t in data]), np.frombuffer(b"".join(data), np.uint8)
    for most in (1, 7, 64, 1 << 20):
        monkeypatch.setattr(ctw, "CHUNK_BYTES", most)
        parts = list(ctw.sorted_grams(lengths, flat, 5))
        assert sum((Counter(zip(np.repeat(g, n).tolist(), doc.tolist())) for g, n, doc in parts), Counter()) == want
        monkeypatch.setattr(ctw, "MERGE_GRAMS", most)
        grams, counts = ctw.gathered((g, n) for g, n, _ in parts)
        total = Counter()
        for (g, _), n in want.items():
            total[g] += n
        assert grams.tolist() == sorted(total) and dict(zip(grams.tolist(), counts.tolist())) == total


def test_depth_is_checked(small):
    for depth in (2, 6):
        with pytest.raises(ValueError):
            ctw.score_documents(small, depth=depth)


def test_common_context_is_split():
    """Grams under one pair of bytes go to many buckets, and a subtree stays whole."""
    grams = np.array([(a << 24 | 116 << 16 | 104 << 8 | 101) for a in range(200)], np.uint64)
    places = ctw.place_of(grams)
    assert len(set((places % np.uint64(64)).tolist())) > 40
    assert len(set(ctw.place_of((np.arange(50, dtype=np.uint64) << np.uint64(32)) | grams[0]).tolist())) == 1


def test_context_tree_sums_to_one():
    """After any context, the model's bytes have total probability 1, and one depth is plain KT."""
    grams = np.array([(1 << 16 | 2 << 8 | 3), (1 << 16 | 2 << 8 | 4), (9 << 16 | 2 << 8 | 3)], np.uint64)
    levels = ctw.subtree(grams, np.array([5, 1, 2]), 2, 0)
    for context in (1 << 8 | 2, 9 << 8 | 2, 7 << 8 | 2, 8 << 8 | 8):
        asked = (np.uint64(context) << np.uint64(8)) | np.arange(256, dtype=np.uint64)
        assert math.isclose((10 ** ctw.predict(asked, levels)).sum(), 1.0, rel_tol=1e-9)
    assert math.isclose(ctw.log_kt(np.array([1]), np.array([1]))[0], math.log(1 / 8))
    big = ctw.log_kt(np.array([5000]), np.array([3000]))[0]
    assert math.isclose(big, math.lgamma(5000.5) + math.lgamma(3000.5) - math.log(math.pi) - math.lgamma(8001), rel_tol=1e-9)


@pytest.mark.parametrize("which", ["odd", "none", "small"])
def test_packing(request, which):
    docs = request.getfixturevalue(which)
    encode = tokens.Encoder(tokens.vocabulary_path("byte_bpe_50k.json"), True, "uint32").whole
    end = np.array([1], "<u4").tobytes()
    docs_of, seqs = defaultdict(list), defaultdict(list)
    for r in packing.pack_documents(docs).collect():
        docs_of[(r.doc_id, r.doc_tokens)].append(r)
        seqs[r.sequence_id].append(r)
    for d, t in texts(docs):
        ids = encode(t) + end
        mine = docs_of[(d, len(ids) // 4)]
        found = sorted((r.start, bytes(r.ids)) for r in mine)
        copies = sum(s == 0 for s, _ in found)
        assert b"".join(x for _, x in found) == b"".join(ids[4 * r.start : 4 * (r.start + r.length)] for r in sorted(mine, key=lambda r: r.start))
        assert sum(len(x) for _, x in found) == copies * len(ids)
    padding = total = 0
    for rs in seqs.values():
        at = 0
        for r in sorted(rs, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= packing.CAPACITY and at <= rs[0].sequence_length
        padding += 0 if at & (at - 1) == 0 else packing.CAPACITY - at
        total += at
    assert padding <= 0.02 * total


@pytest.mark.parametrize("which", ["odd", "none", "small"])
def test_exact(request, which):
    docs = request.getfixturevalue(which)
    groups = defaultdict(list)
    for d, t in texts(docs):
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t)].append(d)
    want = Counter()
    for t, ds in groups.items():
        for d in ds:
            want[(d, min((x for x in ds if x is not None), default=None), len(ds), hashlib.sha256(t.encode()).hexdigest())] += 1
    got = exact_dedup.exact_groups(docs).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    assert sum(r.kept for r in got) == len(groups) == exact_dedup.drop_copies(docs).count()


def test_exact_copies_by_row(spark):
    """Null ids, ids on several texts and repeated rows, with columns named like the operator's own."""
    rows = [(1, "a  b", 0), (2, "a b", 1), (None, "a\tb", 2), (None, "c", 3), (None, "c", 4), (3, "d", 5), (3, "e", 6), (3, "d", 7), (4, "e", 8), (5, None, 9), (6, "", 10), (None, None, 11)]
    docs = spark.createDataFrame([(*r, "k", "s") for r in rows], "doc_id long, text string, row int, _keep_id string, sha string").repartition(4)
    for bound in (150_000, -1):
        exact_dedup.BROADCAST_ROWS, before = bound, exact_dedup.BROADCAST_ROWS
        try:
            out = exact_dedup.drop_copies(docs)
            left = [r.row for r in out.collect()]
        finally:
            exact_dedup.BROADCAST_ROWS = before
        assert out.columns == docs.columns
        groups = [{0}, {3, 4}, {5, 7}, {6}, {9}]
        assert len(left) == len(groups) and all(len(g & set(left)) == 1 for g in groups)


@pytest.mark.parametrize("which", ["odd", "none", "small"])
def test_sharding(request, which):
    docs = request.getfixturevalue(which)
    got = sharding.shard_documents(docs, n_slots=512).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((d, len(t.encode()) + 16, zlib.crc32(t.encode())) for d, t in texts(docs))
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values()) and set(by) <= set(range(40))


def test_rebalance():
    rng = np.random.default_rng(3)
    sizes = [int(x) for x in rng.integers(1, 5000, 4096)]
    first = sharding.SlotMap.first(40, 4096)
    second = first.rebalanced(sizes, 40)
    load = [sum(z for z, s in zip(sizes, second.shards) if s == k) for k in range(40)]
    assert second.version == 2 and max(load) - min(load) < 0.001 * sum(load) / 40


def test_sharding_by_hand(spark, small):
    """Each row goes where its slot is mapped, ranks run by slot, id, size and checksum, and sizes end near equal."""
    n = 512
    got = sharding.shard_documents(small, n_slots=n).collect()
    sizes = [0] * n
    for r in got:
        sizes[r.vslot] += r.size
    want = sharding.SlotMap.first(40, n).rebalanced(sizes, 40)
    assert {(r.vslot, r.shard) for r in got} == {(r.vslot, want.shards[r.vslot]) for r in got}
    assert {r.map_version for r in got} == {want.version}
    by, load = defaultdict(list), Counter()
    for r in got:
        by[r.shard].append(r)
        load[r.shard] += r.size
    for rs in by.values():
        assert [r.slot for r in sorted(rs, key=lambda r: (r.vslot, r.doc_id, r.size, r.text_crc32))] == list(range(len(rs)))
    # No single move or swap of slots brings the fullest and the emptiest shard closer.
    high, low = max(range(40), key=lambda s: load[s]), min(range(40), key=lambda s: load[s])
    gap = load[high] - load[low]
    ups, downs = ([sizes[v] for v in range(n) if want.shards[v] == s and sizes[v]] for s in (high, low))
    assert all(abs(gap - 2 * d) >= gap for u in ups for d in (u, *(u - x for x in downs)))


def test_kept_map(spark, small, tmp_path):
    """A stored map is edited where the load asks for it, and left alone where not."""
    folder = f"file://{tmp_path}/map"
    one = sharding.shard_documents(small, n_slots=256, folder=folder)
    first = {(r.doc_id, r.shard, r.map_version) for r in one.collect()}
    again = {(r.doc_id, r.shard, r.map_version) for r in sharding.shard_documents(small, n_slots=256, folder=folder).collect()}
    assert first == again and {v for _, _, v in first} == {2}
    more = sharding.shard_documents(small.unionByName(small.where("doc_id < 60").selectExpr("doc_id + 1000000 AS doc_id", "text", "lang", "source", "n_chars")), n_slots=256, folder=folder).collect()
    assert {r.map_version for r in more} == {3}
    old, new = (sharding.SlotMap.load(spark, folder, v).shards for v in (2, 3))
    assert 0 < sum(a != b for a, b in zip(old, new)) < 200
    with pytest.raises(ValueError):
        sharding.shard_documents(small, n_slots=128, folder=folder)


class Counted:
    """A tokenizer, and how many texts and units it got."""

    def __init__(self, tokenizer):
        self.tokenizer, self.n = tokenizer, 0

    def encode(self, text, **options):
        self.n += 1
        return self.tokenizer.encode(text, **options)

    def encode_batch_fast(self, texts, **options):
        self.n += len(texts)
        return self.tokenizer.encode_batch_fast(texts, **options)


def test_units_between_white_space(monkeypatch):
    """Ids are those of the whole text; new words do not go through the whole tokenizer each, and a full cache keeps the units it met first."""
    encode = tokens.Encoder(tokens.vocabulary_path("word_bpe_49k.json"), False, "uint16")
    latin = ["H\u0331 h\u0331 E\u0301a \u00c9a, \u00e9\u0327x", "\u0130I\u0131 \u017f \u03a3\u03c3\u03c2 \u212a\u212b", "(\u00c9t\u00e9) l'\u00e9t\u00e9's IT'S !'t", "x\u00aa \u00ba\u00b5\u00d7\u00f7 12\u00b2 3\u00e9"]
    for text in [*latin, "a<\u0338b <\u0338", "a\x00b \x85c\xa0d\u200be\u3000f <|endoftext|>", "Ab" * 100, "ab," * 100, " \n"]:
        assert encode(text) == encode.whole(text)
    encode.cache.clear()
    encode.tokenizer = Counted(encode.tokenizer)
    monkeypatch.setattr(tokens, "CACHE_UNITS", 400)
    encode("The common,")
    letters = [c * 2 for c in "abcdefghij"]
    words = [x + y + z for x in letters for y in letters for z in "\u00e9klmno"]
    for i in range(0, len(words), 20):
        text = " ".join(f"{w.title()}. ({w}) {w}!" for w in words[i : i + 20])
        encode(text)
    encode("The common,")
    assert encode.tokenizer.n == 5  # the marks
    assert "common," in encode.cache and len(encode.cache) < 600
    assert encode(text) == encode.whole(text)


@pytest.mark.parametrize("which", ["odd", "none", "small"])
def test_arrow_tokens(request, which):
    docs = request.getfixturevalue(which)
    encode = tokens.Encoder(tokens.vocabulary_path("word_bpe_49k.json"), False, "uint16").whole
    at, want = 0, []
    for d, t in sorted(texts(docs), key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode())):
        ids = np.append(np.frombuffer(encode(t), "<u2").astype("<u4"), np.array([2], "<u4"))
        want.append((d, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    got = sorted((tuple(r) for r in binary.token_report(docs).collect()), key=lambda r: r[1])
    assert got == want


def test_sequence_file(spark, small, tmp_path):
    """Any sequence of a file, and its mask, as views of the mapped file."""
    manifest = binary.write_tokens(small, f"file://{tmp_path}/t", files=2).collect()
    encode = tokens.Encoder(tokens.vocabulary_path("word_bpe_49k.json"), False, "uint16").whole
    flat = np.concatenate([np.append(np.frombuffer(encode(t), "<u2"), np.uint16(2)) for _, t in sorted(texts(small))])
    at = 0
    for m in sorted(manifest, key=lambda m: m.file):
        file = binary.SequenceFile(m.path)
        assert len(file) == -(-m.tokens // binary.LENGTH)
        for i in range(len(file)):
            ids, packed = file[i]
            mask = np.unpackbits(packed, bitorder="little")
            n = min(binary.LENGTH, m.tokens - i * binary.LENGTH)
            assert len(ids) == len(mask) == binary.LENGTH and mask.sum() == n and mask[:n].all()
            assert (ids[:n] == flat[at : at + n]).all() and not ids[n:].any()
            assert not ids.flags.owndata and not packed.flags.owndata
            at += n
    assert at == len(flat)


def test_null_ids_are_split(spark, small):
    """Rows without an id are spread over files."""
    manifest = binary.write_tokens(small.selectExpr("CAST(NULL AS BIGINT) AS doc_id", "text"), f"{session.shared_folder(spark)}/nulls", files=4).collect()
    assert sum(m.docs > 0 for m in manifest) == 4


def test_paths_without_writer(spark):
    spark._jsc.hadoopConfiguration().set("fs.odd.impl", "org.apache.hadoop.fs.RawLocalFileSystem")
    with pytest.raises(Exception):
        binary.shared_path(spark, "odd://x/y")


def brute_components(rows):
    sets = {}
    for i, (d, t) in enumerate(rows):
        w = t.encode().lower().split()
        sets[i] = {tuple(w)} if 0 < len(w) < 5 else {tuple(w[j : j + 5]) for j in range(len(w) - 4)}
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    held = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            held[x].append(i)
    for i, j in {(i, j) for xs in held.values() for i in xs for j in xs if i < j}:
        if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
            root[find(i)] = find(j)
    least = defaultdict(lambda: math.inf)
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least[find(i)], d)
    return Counter((d, len(sets[i]), (d if not sets[i] else None if least[find(i)] == math.inf else least[find(i)])) for i, (d, _) in enumerate(rows))


@pytest.mark.parametrize("which", ["odd", "none", "small"])
def test_near(request, which):
    docs = request.getfixturevalue(which)
    got = near_dedup.near_groups(docs).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components(texts(docs))


@pytest.mark.parametrize("few", [0, 3, 10_000])
def test_components(spark, monkeypatch, few):
    """A chain, a star and a pair; by rounds alone, by rounds and a task, and by one task."""
    monkeypatch.setattr(near_dedup, "FEW_LINKS", few)
    pairs = [(i, i + 1) for i in range(40)] + [(900, 901)] + [(500, 500 + i) for i in range(1, 30)]
    got = {r.v: r.root for r in near_dedup.components(spark.createDataFrame(pairs, "a long, b long").repartition(3)).collect()}
    assert len(got) == 41 + 2 + 30
    groups = defaultdict(set)
    for v, r in got.items():
        groups[r].add(v)
    assert sorted(map(len, groups.values())) == [2, 30, 41]
    assert near_dedup.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_hot_buckets(spark):
    """A bucket of over two thousand sets that share much, but are no near copies, with some that are; large sets too."""
    rng, rows = np.random.default_rng(9), []
    shared = " ".join(f"common{i}" for i in range(110))
    for i in range(2300):
        rows.append((i, f"{shared} " + " ".join(f"own{i}x{j}" for j in range(90))))
    for i in range(40):  # near copies of some of them, which share rare shingles with these alone
        words = rows[i * 50][1].split()
        words[int(rng.integers(115, 195))] = "changed"
        rows.append((5000 + i, " ".join(words)))
    for k in range(6):  # large sets, over the sample of fingerprints
        base = [f"big{k}x{i}" for i in range(3000)]
        for v in range(4):
            words = list(base)
            for at in rng.integers(0, 3000, 10 + 20 * v):
                words[at] = f"new{rng.integers(1 << 40)}"
            rows.append((6000 + 10 * k + v, " ".join(words)))
    got = near_dedup.near_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    want = {}
    sets = [set(near_dedup.shingle_set(t).tolist()) for _, t in rows]
    root = list(range(len(rows)))
    pairs = [(i * 50, 2300 + i) for i in range(40)] + [(a, b) for k in range(6) for a in range(2340 + 4 * k, 2344 + 4 * k) for b in range(2340 + 4 * k, a)]
    for a, b in pairs:  # all others share under half
        both = len(sets[a] & sets[b])
        if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
            low, high = sorted((root[a], root[b]))
            root = [low if x == high else x for x in root]
    want = {rows[i][0]: rows[r][0] for i, r in enumerate(root)}
    assert {r.doc_id: r.component_id for r in got} == want
    assert sum(k != v for k, v in want.items()) >= 50


def keyed(df):
    return Counter((r.doc_id, r.text) for r in df.select("doc_id", "text").collect())


@pytest.mark.parametrize("which", ["odd", "none"])
def test_pipeline_stages(spark, request, tmp_path, which):
    """Each stage of the pipeline against plain code, on what the stage before has left."""
    import corpus_pipeline

    docs = request.getfixturevalue(which)
    labels = spark.createDataFrame([(1, 1, 0), (8, 1, 0), (3, 0, 0)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    steps = [spark.read.parquet(f"{tmp_path}/documents.parquet")]
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, steps[-1], str(tmp_path)).write.parquet(f"{tmp_path}/{i}")
        steps.append(spark.read.parquet(f"{tmp_path}/{i}"))
        if name != "packing":
            assert steps[-1].columns == docs.columns
    given, good, distinct, apart, mixed, packed = steps
    scored = quality.score_documents(given.select("doc_id", "text"), quality.fit(given, labels))
    assert keyed(good) == Counter((r.doc_id, r.text) for r in scored.where("kept").collect())
    assert all(not base(t or "")[-1] for (_, t) in keyed(good))
    groups = defaultdict(list)
    for r in good.collect():
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "")].append(r)
    first = Counter(min(((r.doc_id is None, r.doc_id or 0) for r in rs)) for rs in groups.values())
    assert Counter((r.doc_id is None, r.doc_id or 0) for r in distinct.collect()) == first
    left = {k[:1] + k[2:]: n for k, n in brute_components(texts(distinct)).items()}
    assert {r.doc_id for r in apart.collect()} == {d for d, c in left if d == c}
    assert apart.count() == len({c for _, c in left})
    sizes = defaultdict(int)
    for r in apart.collect():
        sizes[r.source] += len(WORD.findall(r.text or ""))
    taken = defaultdict(int)
    for r in mixed.collect():
        taken[r.source] += len(WORD.findall(r.text))
    for source, target in filled(sizes).items() if sizes else ():
        assert abs(taken[source] - target) <= mixing.BLOCK
    whole = {r.doc_id: WORD.findall(r.text or "") for r in apart.collect()}
    for r in mixed.collect():
        words = iter(whole[r.doc_id])
        assert all(w in words for w in WORD.findall(r.text))  # in their order
    encode = tokens.Encoder(tokens.vocabulary_path("byte_bpe_50k.json"), True, "uint32").whole
    assert sum(r.length for r in packed.collect()) == sum(len(encode(t or "")) // 4 + 1 for t, in mixed.select("text").collect())


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    rows = corpus_pipeline.run(spark, sf).collect()
    ends = Counter((r.sequence_id, r.offset + r.length) for r in rows)
    assert rows and all(r.offset == 0 or (r.sequence_id, r.offset) in ends for r in rows)


@pytest.mark.parametrize("hot_work", [1_000_000, 1])
def test_near_variants(spark, monkeypatch, hot_work):
    """Groups around the threshold, with few and with many words, against all pairs; once with every bucket joined by rare shingles."""
    monkeypatch.setattr(near_dedup, "HOT_WORK", hot_work)
    rng, rows = np.random.default_rng(5), []
    for n in (60, 150, 1400):
        base = [f"w{n}x{i}" for i in range(n)]
        for _ in range(30):
            words = list(base)
            for at in rng.integers(0, n, max(1, int(n * rng.uniform(0.005, 0.06)))):
                words[at] = f"new{rng.integers(1 << 40)}"
            rows.append((len(rows), " ".join(words)))
    sets = [set(near_dedup.shingle_set(t).tolist()) for _, t in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                low, high = sorted((root[i], root[j]))
                root = [low if x == high else x for x in root]
    got = near_dedup.near_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert {r.doc_id: r.component_id for r in got} == dict(enumerate(root))
    assert 3 < len(set(root)) < len(rows)


@pytest.mark.parametrize("tiled_work, tile, hot_work", [(10_000, 2048, 10**10), (0, 16, 10**10), (10_000, 16, 0), (10**18, 16, 10**10)])
def test_near_large_buckets(spark, monkeypatch, tiled_work, tile, hot_work):
    """Texts of one common passage share buckets without being links: their comparisons, which grow with the square, are dealt over tiles, and no link is lost."""
    rng, rows = np.random.default_rng(3), []
    common = " ".join(f"common{i}" for i in range(40))
    for i in range(600):
        own = [f"own{i}x{k}" for k in range(10)]
        rows.append((2 * i, f"{common} {' '.join(own)}"))
        if i % 30 == 0:
            rows.append((2 * i + 1, f"{common} {' '.join(own[:9])} other{rng.integers(1 << 40)}"))
    most, pairs = [], near_dedup._pairs

    def spied(rows, *args):
        each = [sorted(r.n) for r in rows.groupBy("key", "root").count().groupBy("key").agg(F.collect_list("count").alias("n")).collect()]
        most.extend((sum(n) - n[-1]) * sum(n) for n in each)
        return pairs(rows, *args)

    monkeypatch.setattr(near_dedup, "_pairs", spied)
    monkeypatch.setattr(near_dedup, "TILED_WORK", tiled_work, raising=False)
    monkeypatch.setattr(near_dedup, "TILE", tile, raising=False)
    monkeypatch.setattr(near_dedup, "HOT_WORK", hot_work)
    got = near_dedup.near_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert {r.doc_id: r.component_id for r in got} == {d: d // 2 * 2 for d, _ in rows}
    assert max(most, default=-1) < tiled_work


@pytest.mark.parametrize("words, own, groups, tiled_work, tile", [(50, 12, 110, 10_000, 2048), (50, 12, 110, 0, 32), (1500, 300, 20, 0, 2048), (1000, 190, 14, 0, 2048)])
def test_near_misses(spark, monkeypatch, words, own, groups, tiled_work, tile):
    """Texts just below the threshold are decided where they meet, so only what connects leaves a tile: not the square of a group, and no link is lost. Sets in full, sampled, and of both kinds."""
    monkeypatch.setattr(near_dedup, "TILED_WORK", tiled_work)
    monkeypatch.setattr(near_dedup, "TILE", tile)
    rng, rows, common = np.random.default_rng(4), [], [f"common{i}" for i in range(words)]
    for i in range(groups):
        tail = [f"own{i}x{k}" for k in range(own)]
        for _ in range(1 + 3 * (i % 10 == 0)):  # some have near copies, which are linked with each other
            rows.append((len(rows), " ".join(common + tail)))
            tail = [*tail[:-1], f"other{rng.integers(1 << 40)}"] if own < 100 else [*tail, *(f"other{rng.integers(1 << 40)}" for _ in range(15))]
    left, tiled = [], near_dedup._tiled

    def spied(rows):
        left.append(tiled(rows).count())
        return tiled(rows)

    monkeypatch.setattr(near_dedup, "_tiled", spied)
    got = near_dedup.near_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components(rows)
    assert left and (own >= 100 or max(left) <= len(rows))


def test_pipeline_near_misses(spark, monkeypatch):
    """The near dedup stage of the pipeline on texts just below the threshold, and a copy of one without an id: no pair that is no link leaves a tile."""
    import corpus_pipeline

    common, left, tiled = " ".join(f"common{i}" for i in range(50)), [], near_dedup._tiled
    rows = [(i, f"{common} " + " ".join(f"own{i}x{k}" for k in range(12)), "a") for i in range(300)]
    rows.append((None, rows[7][1] + " end", "a"))

    def spied(rows):
        left.append(tiled(rows).count())
        return tiled(rows)

    monkeypatch.setattr(near_dedup, "_tiled", spied)
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    assert keyed(corpus_pipeline.drop_near_copies(spark, docs, "")) == Counter((d, t) for d, t, _ in rows if d is not None)
    assert left and max(left) <= 1


def test_near_copies_by_row(spark):
    """One row is left of each component, whatever ids its rows have; rows that share an id, or have none, stand for themselves."""
    word = lambda c, n=40: " ".join(f"{c}{i}" for i in range(n))
    rows = [
        (1, word("a"), 0), (None, word("a") + " end", 1),  # a copy without an id
        (None, word("b"), 2), (None, word("c"), 3),  # unique, no id
        (5, word("d"), 4), (6, word("d") + " end", 5), (6, word("e"), 6),  # an id on a copy and on a unique text
        (None, word("f"), 7), (None, word("f") + " end", 8), (None, word("f").upper(), 9),  # a component without any id
        (7, word("g"), 10), (7, word("g") + " end", 11),  # an id on both texts of a component
        (8, word("h"), 12), (8, word("h"), 13), (9, word("h") + " end", 14),  # repeated rows
        (None, None, 15), (None, "", 16), (8, " ", 17), (8, " ", 18),  # no words
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, digest int").repartition(3)
    got = near_dedup.drop_near_copies(docs)
    assert got.columns == docs.columns
    left = sorted(r.digest for r in got.collect())
    groups = [{0}, {2}, {3}, {4}, {6}, {7, 8, 9}, {10, 11}, {12, 13}, {15}, {16}, {17}, {18}]
    assert len(left) == len(groups) and all(len(g & set(left)) == 1 for g in groups)
    assert near_dedup.drop_near_copies(docs.limit(0)).count() == 0


def test_suffix_buckets_are_sorted_in_parts(monkeypatch):
    """A bucket sorts PART_BYTES at a time, strings of one place together, with the least ids of all its windows."""
    import random

    S = suffix_dedup
    rng, seen, classes = random.Random(5), [], S.window_classes

    def noted(text, starts):
        seen.append(len(text))
        return classes(text, starts)

    monkeypatch.setattr(S, "PART_BYTES", 2000)
    monkeypatch.setattr(S, "window_classes", noted)
    tails = [bytes(rng.choices(b"ab", k=60)) for _ in range(150)]
    messages = [[(t[rng.randrange(5) :], rng.randrange(1000), k % 140) for k, t in enumerate(tails) if rng.random() < 0.7] for _ in range(3)]
    least: dict = {}
    for t, i, place in (x for m in messages for x in m):
        for k in range(len(t) - S.WINDOW + 1):
            w = (place, t[k : k + S.WINDOW])
            least[w] = min(i, least.get(w, i))
    pack = lambda m: blocks.squeeze(
        np.array([len(t) for t, _, _ in m], np.int32), np.array([i for _, i, _ in m], np.int64), np.array([p for _, _, p in m], np.uint32), np.frombuffer(b"".join(t for t, _, _ in m), np.uint8)
    )
    got = S.string_exchange([1]).answer([pack(m) for m in messages])
    for m, a in zip(messages, got):
        assert blocks.unsqueeze(a)[0].tolist() == [least[place, t[k : k + S.WINDOW]] for t, _, place in m for k in range(len(t) - S.WINDOW + 1)]
    assert len(seen) > 5 and max(seen) < 4000
