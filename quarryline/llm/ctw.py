"""Context-tree weighting over bytes.

A byte is eight binary decisions; each of the 255 places in a byte has its own
context tree over the preceding bytes. A node's Krichevsky-Trofimov estimate
and its children's weighted probabilities are mixed half and half, from the
deepest contexts up, so a prediction mixes the estimates of all depths with
weights that the training text has set. Below a context that training never
saw, either value of a bit has probability 1/2, as an estimate without counts
says. Each text ends with a byte that UTF-8 lacks, which also stands before its
start.

Counts of distinct (context, byte) grams are gathered in buckets by the three
nearest context bytes; a bucket holds whole subtrees. What lies above, depths 0
to 2, is the only part the driver sees: 255 nodes for each pair of bytes, of
which UTF-8 text has some thousands and can't have over 65,536.
"""

from __future__ import annotations

import itertools
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import forget, settle
from . import blocks
from .blocks import sums

DEPTH = 5
#: Grams and document numbers share 64 bits, so this is the greatest depth.
MOST_DEPTH = 5
#: Depths above the buckets' subtrees.
TOP = 3
END = 0xFF
#: Training leaves out documents whose crc32 of the id as text is a multiple of this.
FOLDS = 10
ALPHA = 0.1
#: Text bytes for each bucket, of a block, and of the part of a block whose grams are sorted at a time; grams of messages that are summed at a time, or as many as are distinct so far.
BUCKET_BYTES = 64 << 20
BLOCK_BYTES, CHUNK_BYTES = 8 << 20, 1 << 20
MERGE_GRAMS = 1 << 18

_N = np.arange(1, 4096, dtype=np.float64)
_HALF = np.concatenate([[0.0], np.cumsum(np.log(_N - 0.5))])
_FULL = np.concatenate([[0.0], np.cumsum(np.log(_N))])


def _log_gamma(x: np.ndarray) -> np.ndarray:
    return (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + 1 / (12 * x) - 1 / (360 * x**3)


def log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Log of the KT probability of a zeros and b ones."""

    def half(n):
        return np.where(n < 4096, _HALF[np.minimum(n, 4095)], _log_gamma(np.maximum(n, 4096) + 0.5) - 0.5 * np.log(np.pi))

    n = a + b
    return half(a) + half(b) - np.where(n < 4096, _FULL[np.minimum(n, 4095)], _log_gamma(np.maximum(n, 4096) + 1.0))


def _log_mix(estimate: np.ndarray, split: np.ndarray) -> np.ndarray:
    return np.logaddexp(estimate, split) - np.log(2)


class Level:
    """The nodes of one depth: key (context << 8 | place in the byte), zeros, ones, log weighted probability."""

    def __init__(self, keys, zeros, ones, below):
        self.keys, self.zeros, self.ones = keys, zeros, ones
        self.kt = log_kt(zeros, ones)
        self.weighted = self.kt if below is None else _log_mix(self.kt, below)
        self.weight = np.ones(len(keys)) if below is None else np.exp(np.log(0.5) + self.kt - self.weighted)

    def predict(self, keys: np.ndarray, bit: np.ndarray, deeper: np.ndarray | None) -> np.ndarray:
        """Probability of the bit, nan where there is no such node; deeper is the prediction one level down, None at the deepest."""
        if not len(self.keys):
            return np.full(len(keys), np.nan)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        zeros, ones = self.zeros[at], self.ones[at]
        p = (np.where(bit == 1, ones, zeros) + 0.5) / (zeros + ones + 1.0)
        if deeper is not None:
            w = self.weight[at]
            p = w * p + (1 - w) * np.where(np.isnan(deeper), 0.5, deeper)
        return np.where(self.keys[at] == keys, p, np.nan)


def bit_nodes(contexts: np.ndarray, byte: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, zeros and ones of all nodes that (context, byte) pairs with counts n pass."""
    keys, zeros, ones = [], [], []
    for k in range(8):
        place = (1 << k) | (byte >> np.uint64(8 - k))
        bit = (byte >> np.uint64(7 - k)) & np.uint64(1)
        key, total, one = sums((contexts << np.uint64(8)) | place, n, np.where(bit == 1, n, 0))
        keys.append(key)
        zeros.append(total - one)
        ones.append(one)
    return sums(np.concatenate(keys), np.concatenate(zeros), np.concatenate(ones))


def subtree(grams: np.ndarray, n: np.ndarray, depth: int, top: int) -> dict[int, Level]:
    """Levels depth .. top of the trees that training grams (context << 8 | byte) with counts n make."""
    levels: dict[int, Level] = {}
    for d in range(depth, top - 1, -1):
        mask = np.uint64((1 << (8 * d)) - 1)
        short, count = sums(((grams >> np.uint64(8)) & mask) << np.uint64(8) | (grams & np.uint64(255)), n)
        keys, zeros, ones = bit_nodes(short >> np.uint64(8), short & np.uint64(255), count)
        below = None
        if d < depth:
            under = levels[d + 1]
            parent = ((under.keys >> np.uint64(8)) & mask) << np.uint64(8) | (under.keys & np.uint64(255))
            below = np.bincount(np.searchsorted(keys, parent), under.weighted, len(keys))
        levels[d] = Level(keys, zeros, ones, below)
    return levels


def predict(grams: np.ndarray, levels: dict[int, Level]) -> np.ndarray:
    """log10 probability of each gram's byte after its context; levels from the deepest down to 0."""
    byte, contexts = grams & np.uint64(255), grams >> np.uint64(8)
    total = np.zeros(len(grams))
    for k in range(8):
        place = (np.uint64(1) << np.uint64(k)) | (byte >> np.uint64(8 - k))
        bit = ((byte >> np.uint64(7 - k)) & np.uint64(1)).astype(np.int64)
        p = None
        for d in sorted(levels, reverse=True):
            mask = np.uint64((1 << (8 * d)) - 1)
            p = levels[d].predict((contexts & mask) << np.uint64(8) | place, bit, p)
        total += np.log10(0.5 if p is None else np.where(np.isnan(p), 0.5, p))
    return total


def sorted_grams(lengths: np.ndarray, data: np.ndarray, depth: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of each chunk of a block's positions, wherever it cuts documents: distinct grams, sorted; how often each occurs; the documents of its occurrences, in the order of the grams."""
    sizes = lengths + depth + 1
    ends = np.cumsum(sizes)
    text = np.ones(int(sizes.sum()), bool)
    for j in range(depth):
        text[ends - sizes + j] = False
    text[ends - 1] = False
    flat = np.full(len(text), END, np.uint8)
    flat[text] = data
    del text
    for low in range(0, len(flat) - depth, CHUNK_BYTES):
        high = min(low + CHUNK_BYTES, len(flat) - depth)
        a, b = int(np.searchsorted(ends, low, "right")), int(np.searchsorted(ends, high - 1, "right")) + 1
        keys = np.zeros(high - low, np.uint64)
        for j in range(depth + 1):
            keys <<= np.uint64(8)
            keys |= flat[low + j : high + j]
        keys <<= np.uint64(16)
        keys |= np.repeat(np.arange(a, b, dtype=np.uint16), np.minimum(ends[a:b], high) - np.maximum(ends[a:b] - sizes[a:b], low))
        inside = np.ones(len(keys), bool)
        for j in range(1, depth + 1):
            past = ends[a:b] - j - low
            inside[past[(past >= 0) & (past < len(keys))]] = False
        keys = keys[inside]
        if not len(keys):
            continue
        keys.sort()
        doc = (keys & np.uint64(0xFFFF)).astype(np.uint16)
        keys >>= np.uint64(16)
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        yield keys[first], np.diff(np.append(first, len(keys))).astype(np.int32), doc


def place_of(grams: np.ndarray) -> np.ndarray:
    """Where a gram's three nearest context bytes put it."""
    near = (grams >> np.uint64(8)) & np.uint64((1 << 8 * TOP) - 1)
    return ((near + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)


def held_out(ids: np.ndarray, known: np.ndarray) -> np.ndarray:
    return np.array([zlib.crc32(str(i).encode() if k else b"") % FOLDS == 0 for i, k in zip(ids.tolist(), known.tolist())], bool)


def words_of(lengths: np.ndarray, data: np.ndarray) -> Iterator[list[bytes]]:
    """The words of each text."""
    ends = np.cumsum(lengths).tolist()
    for e, n in zip(ends, lengths.tolist()):
        yield data[e - n : e].tobytes().lower().split()


@dataclass
class Content:
    """Distinct grams with their training counts, and distinct words with theirs, both sorted."""

    grams: np.ndarray
    counts: np.ndarray
    words: list[bytes]
    learned: np.ndarray

    @classmethod
    def of(cls, grams: np.ndarray, counts: np.ndarray, words: dict[bytes, int]) -> Content:
        names = sorted(words)
        return cls(grams, counts, names, np.array([words[w] for w in names], np.int64))

    def orders(self, widths: list[int], level: int) -> tuple:
        crcs = np.fromiter(map(zlib.crc32, self.words), np.uint64, len(self.words))
        return *blocks.by_digit(blocks.digit(place_of(self.grams), widths, level)), *blocks.by_digit(blocks.digit(crcs, widths, level))


def gathered(parts: Iterable[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams of all parts and the sums of their counts, holding few parts at a time."""
    grams, counts, some, size = np.empty(0, np.uint64), np.empty(0, np.int64), [], 0
    for part in parts:
        some.append(part)
        size += len(part[0])
        if size > max(MERGE_GRAMS, len(grams)):
            grams, counts = sums(*map(np.concatenate, zip((grams, counts), *some)))
            some, size = [], 0
    return sums(*map(np.concatenate, zip((grams, counts), *some))) if some else (grams, counts)


def merge(payloads: list[bytes]) -> Content:
    words: dict[bytes, int] = {}

    def parts():
        for p in payloads:
            d, n, w, text = blocks.unsqueeze(p)
            if len(w):
                for word, c in zip(text.tobytes().split(b"\n"), w.tolist()):
                    words[word] = words.get(word, 0) + c
            yield blocks.undeltas(d), n

    return Content.of(*gathered(parts()), words)


def split(content: Content, widths: list[int], level: int) -> Iterator[tuple[int, bytes]]:
    order, at, w_order, w_at = content.orders(widths, level)
    none = slice(0, 0)
    for d in sorted(at.keys() | w_at.keys()):
        mine, ws = order[at.get(d, none)], w_order[w_at.get(d, none)]
        text = np.frombuffer(b"\n".join([content.words[i] for i in ws.tolist()]), np.uint8)
        yield d, blocks.squeeze(blocks.deltas(content.grams[mine]), content.counts[mine], content.learned[ws], text)


def assembled(content: Content, got: dict[int, bytes], widths: list[int], level: int) -> tuple[np.ndarray, np.ndarray]:
    """What answers say of all grams (log10 probability) and words (training count) of a content."""
    order, at, w_order, w_at = content.orders(widths, level)
    value, found = np.zeros(len(content.grams)), np.zeros(len(content.words), np.int64)
    none = slice(0, 0)
    for d, p in got.items():
        v, c = blocks.unsqueeze(p)
        value[order[at.get(d, none)]] = v
        found[w_order[w_at.get(d, none)]] = c
    return value, found


def picked(payloads: list[bytes], content: Content, value: np.ndarray, found: np.ndarray) -> list[bytes]:
    """The part of a content's values that each message asked for."""
    index, out = dict(zip(content.words, found.tolist())), []
    for p in payloads:
        d, _, w, text = blocks.unsqueeze(p)
        c = np.array([index[x] for x in text.tobytes().split(b"\n")], np.int64) if len(w) else w
        out.append(blocks.squeeze(value[np.searchsorted(content.grams, blocks.undeltas(d))], c))
    return out


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte of each row of docs.

    Null and empty texts are the end alone. A null id counts as the empty text
    when folds are dealt. Repeated rows are learned from as often as they occur.
    An empty table gives no rows; without training documents nothing is known
    and each bit costs one. Columns other than the id and the text are ignored.
    depth is TOP to MOST_DEPTH.
    """
    if not TOP <= depth <= MOST_DEPTH:
        raise ValueError(f"depth {depth} is not in {TOP} .. {MOST_DEPTH}")
    widths = blocks.widths_of(docs, text_col, BUCKET_BYTES)

    def ask(ids, known, lengths, data):
        train = ~held_out(ids, known)
        found = ((gram, np.add.reduceat(train[doc], np.cumsum(n) - n, dtype=np.int64)) for gram, n, doc in sorted_grams(lengths, data, depth))
        grams, counts = gathered(found)
        words: Counter = Counter()
        for t, x in zip(words_of(lengths, data), train.tolist()):
            words.update(t if x else dict.fromkeys(t, 0))
        yield from split(Content.of(grams, counts, words), widths, 0)

    levels = blocks.descend(blocks.make(docs, id_col, text_col, BLOCK_BYTES, ask), exchange := blocks.Exchange(widths, merge, lambda c, i: split(c, widths, i), None, None))

    def summed(_, payloads):
        content = merge(payloads)
        seen = content.counts > 0
        level = subtree(content.grams[seen], content.counts[seen], depth, TOP)[TOP]
        key, zeros, ones, weighted = sums(level.keys & np.uint64((1 << 8 * TOP) - 1), level.zeros, level.ones, level.weighted)
        cols = [np.append(key.astype(np.int64), -1), np.append(zeros, content.learned.sum()), np.append(ones, (content.learned > 0).sum()), np.append(weighted, 0.0)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["node", "zeros", "ones", "weighted"])

    parts = blocks.by_bucket(levels[-1], summed, "node long, zeros long, ones long, weighted double")
    added = settle(parts.groupBy("node").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("weighted").alias("weighted")))
    top = added.toArrow().sort_by("node")  # bounded: see above
    forget(added)
    node, zeros, ones, weighted = (top.column(c).to_numpy() for c in ("node", "zeros", "ones", "weighted"))
    words_n, words_v = (int(zeros[0]), int(ones[0])) if len(node) else (0, 0)
    upper: dict[int, Level] = {}
    keys, zeros, ones, below = node[1:].astype(np.uint64), zeros[1:], ones[1:], weighted[1:]
    for d in range(TOP - 1, -1, -1):
        upper[d] = Level(keys, zeros, ones, below)
        mask = np.uint64((1 << 8 * d) - 1)
        keys, zeros, ones, below = sums(keys & mask, zeros, ones, upper[d].weighted)
    ends_of = docs.select(F.crc32(F.coalesce(F.col(id_col).cast("long").cast("string"), F.lit("")).cast("binary")).alias("c"))
    ends = ends_of.where(F.col("c") % FOLDS != 0).count()
    total, distinct = words_n + ends, words_v + (1 if ends else 0)

    def answer(payloads):
        content = merge(payloads)
        seen = content.counts > 0
        value = predict(content.grams, subtree(content.grams[seen], content.counts[seen], depth, TOP) | upper)
        return picked(payloads, content, value, content.learned)

    def spread(payloads, content, got, level):
        return picked(payloads, content, *assembled(content, got, widths, level))

    answers = blocks.ascend(levels, replace(exchange, answer=answer, spread=spread))
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"]
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"

    def finish(_, got, held):
        ids, known, lengths, data = blocks.unpack(held[0])
        found = list(sorted_grams(lengths, data, depth))
        index: defaultdict = defaultdict(itertools.count().__next__)
        texts = [np.fromiter(map(index.__getitem__, t), np.int32, len(t)) for t in words_of(lengths, data)]
        grams = blocks.distinct(np.concatenate([g for g, _, _ in found]))
        content = Content.of(grams, np.zeros(len(grams), np.int64), dict.fromkeys(index, 0))
        value, learned = assembled(content, got, widths, 0)
        score = np.zeros(len(ids))
        for gram, n, doc in found:
            score += np.bincount(doc, np.repeat(value[np.searchsorted(grams, gram)], n), len(ids))
        c = np.empty(len(index) + 1, np.int64)
        c[np.fromiter(map(index.__getitem__, content.words), np.int64, len(index))], c[-1] = learned, ends
        logs = np.log10((c + ALPHA) / (total + ALPHA * (distinct + 1)))
        base, tokens, some = np.empty(len(ids)), np.empty(len(ids), np.int64), np.empty(len(ids), np.int64)
        for i, t in enumerate(texts):
            at = np.append(t, len(c) - 1)
            base[i], tokens[i], some[i] = logs[at].sum(), len(at), (c[at] > 0).sum()
        bits = -score * np.log2(10) / (lengths + 1)
        cols = [pa.array(ids, pa.int64(), mask=~known), held_out(ids, known), tokens, some, np.full(len(ids), total), base, score, bits]
        return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in cols], names)

    return blocks.by_block([answers, levels[0].held()], finish, schema)
