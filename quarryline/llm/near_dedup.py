"""Near-duplicate documents by b-bit MinHash.

Each distinct shingle set gets ROWS * BANDS minima. A band's minima make a
bucket key; the low BITS of all minima make a packed signature. Buckets give
candidates, bit counts of signatures give an estimate of the similarity that is
corrected for chance agreement, and what passes is confirmed on full sets.

No bucket is expanded into all its pairs. Members are first compared with their
bucket's hub, its first member, best estimate first. Only members that are then
in different components are compared with each other: by bit counts and, what
these leave open by their shingles, so that little but links is left. Small
buckets count bits inside a join, and each pair that is left meets 32-bit
fingerprints once. The comparisons of large ones (TILED_WORK) grow with the
square of a group, and so does the number of pairs just below the threshold. So
large buckets that share members are merged, and their comparisons dealt over
tiles of signatures and shingles, which numpy compares to the end: what leaves a
tile is a link wherever sets are there in full, and only where its ends are not
yet connected there. Where that too would be many comparisons (HOT_WORK),
members are joined exactly by their rarest shingles, which every link at the
threshold shares. Full sets confirm every link.

What a link at similarity 0.75 exactly can be lost by: no common band, under
3e-7 ((1 - 0.75**4)**40); the estimate MARGIN too low, 4.9 standard deviations,
about 2e-6; for sets over SAMPLE shingles their fingerprints, 7 standard
deviations, under 1e-11. All three fall fast above 0.75.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import forget, settle

SHINGLE = 5
PERCENT = 75
ROWS, BANDS, BITS = 4, 40, 2
HASHES = ROWS * BANDS
LONGS = HASHES * BITS // 64
#: Estimates below the threshold by more than this are dropped: five standard deviations.
MARGIN = 0.2
#: Fingerprints that stand for a set in the join, and by how many percent a pair may miss the threshold there:
#: one for sets that are there in full (collisions), seven standard deviations for sampled ones.
SAMPLE = 1024
SLACK, SLACK_SAMPLED = 1, 15
#: Comparisons of a key from which they are dealt over tiles; the rows on a tile's side; signatures compared with a side at a time.
TILED_WORK = 10_000
TILE, TILE_STEP = 2048, 64
#: Large keys that share rows are merged unless that makes more than so many times their comparisons: a row's shingles then go to tiles of one key, not of up to BANDS.
MERGED_WORK = 4
#: Comparisons in a bucket from which its members are joined by rare shingles instead.
HOT_WORK = 10_000_000_000
#: Links that one task unites (under 200 KB).
FEW_LINKS = 10_000
#: Id lists up to this many rows are broadcast (about 16 MB), larger ones joined by a shuffle.
BROADCAST_IDS = 400_000

_rng = np.random.default_rng(7)
_XOR = _rng.integers(0, 2**32, HASHES, dtype=np.uint32)[:, None]
_MUL = (_rng.integers(0, 2**31, HASHES, dtype=np.uint32) * 2 + 1).astype(np.uint32)[:, None]
_K = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles: `size` lower-cased (A-Z) words in a row, or all words if there are fewer."""
    from xxhash import xxh3_64_intdigest

    words = (text or "").encode().lower().split()
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    h = _mixed(np.fromiter(map(xxh3_64_intdigest, words), np.uint64, n))
    k = min(size, n)
    s = np.full(n - k + 1, k, np.uint64)
    for i in range(k):
        s = s * _K + h[i : n - k + 1 + i]
    return np.unique(_mixed(s))


def minima(s: np.ndarray) -> np.ndarray:
    x = (s >> np.uint64(32)).astype(np.uint32)[None, :]
    out = np.full(HASHES, 2**32 - 1, np.uint32)
    for i in range(0, x.shape[1], 2048):
        np.minimum(out, ((x[:, i : i + 2048] ^ _XOR) * _MUL).min(1), out=out)
    return out


def band_keys(m: np.ndarray) -> np.ndarray:
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for col in m.reshape(BANDS, ROWS).T:
        key = _mixed(key * _K + col)
    return key.view(np.int64)


def signature(m: np.ndarray) -> np.ndarray:
    bits = ((m[:, None] >> np.arange(BITS, dtype=np.uint32)) & 1).astype(np.uint8)
    return np.packbits(bits.reshape(-1), bitorder="little").view(np.int64)


def set_name(s: np.ndarray) -> bytes:
    from hashlib import blake2b

    return blake2b(s.tobytes(), digest_size=16).digest()


def sketches(docs: DataFrame, id_col: str, text_col: str, digest: bool = False) -> DataFrame:
    """row (a number for each row), doc_id, n_shingles, name (of the set; null for an empty one), keys, sig, and the text's digest if asked for."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        at = TaskContext.get().partitionId() << 36
        for b in batches:
            n, names, keys, sigs = [], [], [], []
            for text in b.column(1):
                s = shingle_set(text.as_py())
                n.append(len(s))
                names.append(set_name(s) if len(s) else None)
                m = minima(s) if len(s) else None
                keys.append(band_keys(m) if len(s) else None)
                sigs.append(signature(m) if len(s) else None)
            longs = pa.list_(pa.int64())
            cols = [pa.array(range(at, at + len(n)), pa.int64()), b.column(0), pa.array(n, pa.int64()), pa.array(names, pa.binary()), pa.array(keys, longs), pa.array(sigs, longs)]
            at += len(n)
            yield pa.RecordBatch.from_arrays([*cols, *b.columns[2:]], ["row", "doc_id", "n_shingles", "name", "keys", "sig", *b.schema.names[2:]])

    read = docs.select(F.col(id_col).cast("long"), F.col(text_col), *[_digest(text_col).alias("digest")] * digest)
    return read.mapInArrow(sketch, "row long, doc_id long, n_shingles long, name binary, keys array<long>, sig array<long>" + ", digest binary" * digest)


def _digest(text_col: str) -> Column:
    """16 bytes that tell texts apart."""
    return F.unhex(F.md5(F.col(text_col).cast("binary")))


def estimate(a: Column, b: Column) -> Column:
    """Similarity from two packed signatures of BITS = 2: agreeing positions, less those that agree by chance."""
    odd = F.lit(0x5555555555555555)
    diff = [F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i))) for i in range(LONGS)]
    differing = sum((F.bit_count((x.bitwiseOR(F.shiftrightunsigned(x, 1))).bitwiseAND(odd)) for x in diff), F.lit(0))
    agree = 1 - differing / F.lit(float(HASHES))
    return (agree - 2.0**-BITS) / (1 - 2.0**-BITS)


def _likely(a: str, b: str) -> Column:
    """Of two sketches (sig, size): sizes that allow the threshold, and an estimate near it."""
    x, y = F.col(f"{a}.size"), F.col(f"{b}.size")
    return (100 * F.least(x, y) >= PERCENT * F.greatest(x, y)) & (estimate(F.col(f"{a}.sig"), F.col(f"{b}.sig")) >= PERCENT / 100 - MARGIN)


@dataclass(frozen=True)
class Corpus:
    """The documents, and reps: one row for each distinct set, v (its vertex), name, doc_id (of one document that has it), keys, sig, size."""

    docs: DataFrame
    id_col: str
    text_col: str
    reps: DataFrame

    def derived(self, wanted: DataFrame, make: Callable[[np.ndarray], tuple], kinds: dict[str, tuple[str, pa.DataType]]) -> DataFrame:
        """Settled v and what make(set) gives, for the sets `wanted` (v), from the whole texts of documents that have them."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                found = [shingle_set(x.as_py()) for x in b.column(0)]
                made = list(zip(*map(make, found), strict=True)) if found else [()] * len(kinds)
                cols = [pa.array(map(set_name, found), pa.binary()), *(pa.array(c, t) for c, (_, t) in zip(made, kinds.values(), strict=True))]
                yield pa.RecordBatch.from_arrays(cols, ["name", *kinds])

        wanted = settle(wanted.distinct().join(self.reps.select("v", "name", "doc_id"), "v"))
        n = wanted.count()
        few = (lambda df: F.broadcast(df)) if n <= BROADCAST_IDS else (lambda df: df)
        ids = wanted.select(F.col("doc_id").alias("_rep")).distinct()
        texts = self.docs.select(F.col(self.id_col).cast("long").alias("_id"), F.col(self.text_col).alias("_text"))
        texts = texts.join(few(ids), F.col("_id").eqNullSafe(F.col("_rep")), "left_semi").select("_text")
        parsed = texts.mapInArrow(run, "name binary, " + ", ".join(f"{c} {t}" for c, (t, _) in kinds.items()))
        out = settle(parsed.join(few(wanted.select("v", "name")), "name").drop("name"))
        forget(wanted)
        return out if out.count() == n else out.dropDuplicates(["v"])  # rows that repeat an id and a set


LONGS_OF = ("array<long>", pa.list_(pa.int64()))
INTS_OF = ("array<int>", pa.list_(pa.int32()))


def full_sets(wanted: DataFrame, corpus: Corpus) -> DataFrame:
    """v, set of the sets `wanted` (v)."""
    return corpus.derived(wanted, lambda s: (s.view(np.int64),), {"set": LONGS_OF})


def confirmed(pairs: DataFrame, corpus: Corpus) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold, settled."""
    if pairs.isEmpty():
        return pairs.select("a", "b")
    full = full_sets(pairs.select(F.col("a").alias("v")).union(pairs.select("b")), corpus)
    one = full.select(F.col("v").alias("a"), F.col("set").alias("set_a"))
    two = full.select(F.col("v").alias("b"), F.col("set").alias("set_b"))
    both = F.size(F.array_intersect("set_a", "set_b"))
    alike = 100 * both >= PERCENT * (F.size("set_a") + F.size("set_b") - both)
    out = settle(pairs.select("a", "b").join(one, "a").join(two, "b").where(alike).select("a", "b"))
    forget(full)
    return out


def _level(s: np.ndarray) -> int:
    return max(0, int(np.ceil(np.log2(len(s) / SAMPLE)))) if len(s) else 0


def fingerprints(s: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """A level, the set's 32-bit fingerprints at that level and at the next; each level halves the range they come from."""
    x, level = np.unique(s.astype(np.uint32)), _level(s)
    at = x[x < np.uint64(2 ** (32 - level))]
    # Only a set that is larger by a third or less can be a partner, so small sets need no next level.
    above = at[at < np.uint64(2 ** (31 - level))] if 100 * len(s) >= PERCENT * SAMPLE else at[:0]
    return level, at.view(np.int32), above.view(np.int32)


def samples(s: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """As fingerprints, of whole hashes: at level 0 the set itself."""
    low, level = s.astype(np.uint32), _level(s)
    above = s[low < np.uint64(2 ** (31 - level))] if 100 * len(s) >= PERCENT * SAMPLE else s[:0]
    return level, s[low < np.uint64(2 ** (32 - level))].view(np.int64), above.view(np.int64)


def prints_of(wanted: DataFrame, corpus: Corpus) -> DataFrame:
    """v, prints (level, at, above) of the sets `wanted` (v)."""
    found = corpus.derived(wanted, fingerprints, {"level": ("int", pa.int32()), "at": INTS_OF, "above": INTS_OF})
    out = found.select("v", F.struct("level", "at", "above").alias("prints"))
    out.settled_at = getattr(found, "settled_at", None)
    return out


def _close(a: str, b: str) -> Column:
    """Of two sets' prints: near the threshold where both are given at the same level."""
    la, lb = F.col(f"{a}.level"), F.col(f"{b}.level")
    x = F.when(la < lb, F.col(f"{a}.above")).otherwise(F.col(f"{a}.at"))
    y = F.when(lb < la, F.col(f"{b}.above")).otherwise(F.col(f"{b}.at"))
    least = F.when(F.greatest(la, lb) > 0, F.lit(PERCENT - SLACK_SAMPLED)).otherwise(F.lit(PERCENT - SLACK))
    return (100 + least) * F.size(F.array_intersect(x, y)) >= least * (F.size(x) + F.size(y))


def _union(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """v, root of all vertices of links (a, b), which one task holds."""
    root: dict[int, int] = {}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = find(root.setdefault(a, a)), find(root.setdefault(b, b))
            root[max(a, b)] = min(a, b)
    yield pa.RecordBatch.from_arrays([pa.array(list(root), pa.int64()), pa.array([find(v) for v in root], pa.int64())], ["v", "root"])


def components(links: DataFrame) -> DataFrame:
    """v, root of each vertex of the links (a, b), settled; vertices have equal roots if they are connected.

    While there are more than FEW_LINKS, each round every vertex points to the
    least of itself and its neighbours, pointers are followed four steps, and
    links are redrawn between where their ends have come. By turns least means
    by number, which gathers stars at once, and by a hash of the round, which
    breaks up chains. The few links that are left are united in one task.
    """
    links = settle(links)
    roots, turn = None, 0
    while links.count() > FEW_LINKS:
        both = links.union(links.select("b", "a"))
        rank = lambda c: F.struct(F.xxhash64(F.lit(turn), c) if turn % 2 else F.lit(0).cast("long"), F.col(c).alias("to"))  # noqa: B023, E731
        one = settle(both.groupBy("a").agg(F.min(rank("b")).alias("m")).select(F.col("a").alias("v"), F.least("m", rank("a"))["to"].alias("to")))
        move = one
        for _ in range(2):
            move = move.join(move.select(F.col("v").alias("to"), F.col("to").alias("next")), "to").select("v", F.col("next").alias("to"))
        move = settle(move)
        new = settle(_moved(roots, move.select("v", F.col("to").alias("root"))))
        a = move.select(F.col("v").alias("a"), F.col("to").alias("ta"))
        b = move.select(F.col("v").alias("b"), F.col("to").alias("tb"))
        left = settle(links.join(a, "a").join(b, "b").where("ta <> tb").select(F.col("ta").alias("a"), F.col("tb").alias("b")).distinct())
        forget(links, one, move, roots)
        links, roots, turn = left, new, turn + 1
    last = settle(_moved(roots, links.repartition(1).mapInArrow(_union, "v long, root long")))
    forget(links, roots)
    return last


def _moved(roots: DataFrame | None, step: DataFrame) -> DataFrame:
    """roots (v, root) after their roots have moved by a step (v, root); the step itself if there are none yet."""
    if roots is None:
        return step
    return roots.join(step.select(F.col("v").alias("root"), F.col("root").alias("to")), "root", "left").select("v", F.coalesce("to", "root").alias("root"))


def _ends(links: DataFrame, roots: DataFrame) -> DataFrame:
    """The links (a, b) between different components, with the ends' roots; roots holds the vertices that have a link so far."""
    for c in "ab":
        links = links.join(roots.select(F.col("v").alias(c), F.col("root").alias(f"r_{c}")), c, "left").withColumn(f"r_{c}", F.coalesce(f"r_{c}", c))
    return links.where("r_a <> r_b")


def _joined(roots: DataFrame, links: DataFrame) -> DataFrame:
    """roots after the confirmed links (a, b) have been added; replaces roots and links."""
    if links.isEmpty():
        forget(links)
        return roots
    step = components(_ends(links, roots).select(F.col("r_a").alias("a"), F.col("r_b").alias("b")).distinct())
    out = settle(_moved(roots, step).union(step.join(roots, "v", "left_anti").select("v", "root")))
    forget(step, roots, links)
    return out


def _rooted(rows: DataFrame, roots: DataFrame) -> DataFrame:
    return rows.join(roots, "v", "left").withColumn("root", F.coalesce("root", "v"))


def _open(rows: DataFrame) -> DataFrame:
    """Of rows (key, v, root) those whose key holds two components or more, with most (the component with most rows there), its rows n and work.

    Pairs are sought between the rows outside `most` and all rows, so work is
    their product: a large component and a few others cost little.
    """
    each = rows.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"))
    several = each.groupBy("key").agg(F.max(F.struct("n", "root")).alias("m"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("c")).where("c > 1")
    several = several.select("key", F.col("m.root").alias("most"), "n", ((F.col("n") - F.col("m.n")) * F.col("n")).alias("work"))
    return rows.join(several, "key")


def _pairs(rows: DataFrame, alike: Column, *carried: str) -> DataFrame:
    """Pairs (a, b) between the components of a key; rows: key, v, root, most and what `alike` compares (x of column x for a as x_a)."""
    x, y = (rows.select("key", F.col("v").alias(c), F.col("root").alias(f"r_{c}"), F.col("most").alias(f"m_{c}"), *[F.col(k).alias(f"{k}_{c}") for k in carried]) for c in "ab")
    x = x.where("r_a <> m_a")
    once = (F.col("r_b") == F.col("m_b")) | (F.col("a") < F.col("b"))
    return x.join(y, "key").where((F.col("r_a") != F.col("r_b")) & once & alike).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _stars(near: DataFrame, reps: DataFrame) -> DataFrame:
    """Likely links (a, b, e) of members (key, v, hub) with their bucket's hub, e the estimate."""
    stars = near.where("v <> hub").select(F.col("v").alias("a"), F.col("hub").alias("b")).distinct()
    for c in "ab":
        stars = stars.join(reps.select(F.col("v").alias(c), F.struct("sig", "size").alias(f"sketch_{c}")), c)
    return settle(stars.where(_likely("sketch_a", "sketch_b")).select("a", "b", estimate(F.col("sketch_a.sig"), F.col("sketch_b.sig")).alias("e")))


class _Held:
    """The shingles that a tile's rows hold at a level, as numbers from 0."""

    def __init__(self, col: dict[str, pa.Array], level: int):
        size = len(col["level"])
        mine = col["level"].to_numpy()
        lists, rows = [], []
        for name, at in (("at", level), ("above", level - 1)):
            there = np.flatnonzero(mine == at)
            lists.append(col[name].take(pa.array(there)))
            rows.append(there)
        self.count, self.start = np.zeros(size, np.int64), np.zeros(size, np.int64)
        self.count[np.concatenate(rows)] = np.concatenate([np.diff(x.offsets.to_numpy()) for x in lists])
        ends = np.cumsum(np.concatenate([self.count[r] for r in rows]))
        self.start[np.concatenate(rows)] = ends - self.count[np.concatenate(rows)]
        found, self.code = np.unique(np.concatenate([x.flatten().to_numpy() for x in lists]), return_inverse=True)
        self.mark = np.zeros(len(found), bool)

    def shared(self, i: int, j: np.ndarray) -> np.ndarray:
        """How many shingles row i shares with each of the rows j."""
        mine = self.code[self.start[i] : self.start[i] + self.count[i]]
        self.mark[mine] = True
        ends = np.cumsum(self.count[j])
        begins = ends - self.count[j]
        at = np.repeat(self.start[j] - begins, self.count[j]) + np.arange(ends[-1])
        sums = np.concatenate([[0], np.cumsum(self.mark[self.code[at]])])
        self.mark[mine] = False
        return sums[ends] - sums[begins]


def _compared(table: pa.Table) -> pa.Table:
    """Links (a, b) of a tile: rows that seek (outside `most`) and rows that are sought.

    Pairs that _likely would leave are compared by their shingles. Sets that are
    there in full (level 0) are thereby decided; a link of theirs connects its
    ends' components, and pairs within what is connected are passed over. Of
    sampled sets all other pairs near the threshold are given.
    """
    col = {c: table.column(c).combine_chunks() for c in table.column_names}
    seeks = col["seeks"].to_numpy(zero_copy_only=False)
    v, root, most, size, level = (col[c].to_numpy() for c in ("v", "root", "most", "size", "level"))
    sig = col["sig"].flatten().to_numpy().view(np.uint64).reshape(len(v), LONGS)
    agree = 1 - np.arange(HASHES + 1) / float(HASHES)
    near = (agree - 2.0**-BITS) / (1 - 2.0**-BITS) >= PERCENT / 100 - MARGIN
    x, y, odd = np.flatnonzero(seeks), np.flatnonzero(~seeks), np.uint64(0x5555555555555555)
    to, held, found = np.ascontiguousarray(sig[y].T), {}, []
    part = np.unique(root, return_inverse=True)[1]  # the component of each row, as it is known in this tile
    for low in range(0, len(x), TILE_STEP):
        mine = x[low : low + TILE_STEP]
        differing = np.zeros((len(mine), len(y)), np.uint8)
        for k in range(LONGS):
            diff = sig[mine, k][:, None] ^ to[k]
            differing += np.bitwise_count((diff | diff >> np.uint64(1)) & odd)
        for i, likely in zip(mine.tolist(), near[differing], strict=True):
            j = y[likely]
            once = (root[j] == most[j]) | (v[i] < v[j])
            j = j[once & (100 * np.minimum(size[i], size[j]) >= PERCENT * np.maximum(size[i], size[j]))]
            higher = np.maximum(level[i], level[j])  # sizes that allow a link are at most a level apart
            for at in np.unique(higher).tolist():
                k = j[(higher == at) & (part[j] != part[i])]
                if not len(k):
                    continue
                if at not in held:
                    held[at] = _Held(col, at)
                both, sizes = held[at].shared(i, k), held[at].count[i] + held[at].count[k]
                if at:
                    least = PERCENT - SLACK_SAMPLED
                    found += [(i, b) for b in k[(100 + least) * both >= least * sizes].tolist()]
                    continue
                k = k[100 * both >= PERCENT * (sizes - both)]
                parts, first = np.unique(part[k], return_index=True)
                found += [(i, b) for b in k[first].tolist()]
                part[np.isin(part, parts)] = part[i]
    a, b = v[np.array(found, np.int64).reshape(-1, 2).T]
    return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})


def _tiled(rows: DataFrame) -> DataFrame:
    """Links (a, b) that connect the components of a key; rows: what _open gives, with sig, size and samples. A tile holds about TILE rows on a side."""
    across = F.ceil(F.col("n") / TILE)
    down = F.ceil(F.col("work") / F.col("n") / TILE)  # work over n is the number of rows that seek
    one = lambda count: F.pmod(F.xxhash64("v"), count)
    each = lambda count: F.explode(F.sequence(F.lit(0).cast("long"), count - 1))
    carried = ["v", "root", "most", "sig", "size", "level", "at", "above"]
    x = rows.where("root <> most").select("key", one(down).alias("i"), each(across).alias("j"), F.lit(True).alias("seeks"), *carried)
    y = rows.select("key", each(down).alias("i"), one(across).alias("j"), F.lit(False).alias("seeks"), *carried)
    return x.unionByName(y).groupBy("key", "i", "j").applyInArrow(_compared, "a long, b long")


def _merged(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Settled rows of keys that share rows, under one key (a block) as far as MERGED_WORK allows; the other rows, as they are. rows: what _open gives."""
    hubs = rows.groupBy("key").agg(F.min("v").alias("hub"), F.first("work").alias("work"))
    links = rows.select("key", "v").join(hubs, "key").where("v <> hub").select(F.col("v").alias("a"), F.col("hub").alias("b")).distinct()
    blocks = components(links)
    block = blocks.select("v", F.col("root").alias("block"))
    apart = hubs.withColumnRenamed("hub", "v").join(block, "v").groupBy(F.col("block").alias("key")).agg(F.sum("work").alias("apart"))
    together = _open(rows.select("v", "root").distinct().join(block, "v").select(F.col("block").alias("key"), "v", "root"))
    together = settle(together.join(apart, "key").where(F.col("work") <= MERGED_WORK * F.col("apart")).drop("apart"))
    forget(blocks)
    return together, rows.join(together.select("v"), "v", "left_anti")


def _likely_links(rows: DataFrame, corpus: Corpus) -> DataFrame:
    """Settled distinct pairs (a, b) that connect the components of each key as its links do, most of them links; rows: what _open gives."""
    sketches_ = corpus.reps.select("v", "sig", "size")
    large, few = settle(rows.where(F.col("work") >= TILED_WORK)), rows.where(F.col("work") < TILED_WORK)
    few = few.join(sketches_.select("v", F.struct("sig", "size").alias("sketch")), "v")
    if large.isEmpty():
        forget(large)
        return _few_links(_pairs(few, _likely("sketch_a", "sketch_b"), "sketch"), corpus)
    together, others = _merged(large)
    sets = corpus.derived(large.select("v"), samples, {"level": ("int", pa.int32()), "at": LONGS_OF, "above": LONGS_OF})
    links = settle(_tiled(together.unionByName(others).join(sketches_, "v").join(sets, "v")).distinct())
    forget(sets)
    # Pairs within a block have met.
    few = few.join(together.select("v", F.col("key").alias("block")), "v", "left")
    met = F.coalesce(F.col("block_a") == F.col("block_b"), F.lit(False))
    pairs = _few_links(_pairs(few, ~met & _likely("sketch_a", "sketch_b"), "sketch", "block"), corpus)
    out = settle(links.union(pairs).distinct())
    forget(large, together, links, pairs)
    return out


def _few_links(pairs: DataFrame, corpus: Corpus) -> DataFrame:
    """Settled distinct pairs (a, b) that are near the threshold by fingerprints."""
    likely = settle(pairs.distinct())
    if likely.isEmpty():
        return likely
    prints = prints_of(likely.select(F.col("a").alias("v")).union(likely.select("b")), corpus)
    both = likely
    for c in "ab":
        both = both.join(prints.select(F.col("v").alias(c), F.col("prints").alias(f"prints_{c}")), c)
    out = settle(both.where(_close("prints_a", "prints_b")).select("a", "b"))
    forget(likely, prints)
    return out


def _by_rare_shingles(rows: DataFrame, corpus: Corpus) -> DataFrame:
    """Likely links between the components of vertices rows (v, root), however many share a bucket.

    Two sets of sizes x and y that reach the threshold t share one of the
    x - ceil(t x) + 1 shingles of the one, and of the y - ceil(t y) + 1 of the
    other, that come first in any common order. In the order of frequency these
    are the rare ones, so what thousands of documents share makes no pairs.
    """
    sets = full_sets(rows.select("v"), corpus)
    each = sets.select("v", F.size("set").alias("size"), F.explode("set").alias("key"))
    common = each.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = each.join(common, "key").groupBy("v").agg(F.first("size").alias("size"), F.sort_array(F.collect_list(F.struct("n", "key"))).alias("shared"))
    lead = F.col("size") - F.ceil(F.col("size") * PERCENT / 100).cast("int") + 1 - (F.col("size") - F.size("shared"))
    first = shared.select("v", F.explode(F.slice("shared", 1, F.greatest(lead, F.lit(0)))["key"]).alias("key"))
    found = settle(_open(_rooted_as(first, rows)))
    forget(sets)
    out = _likely_links(found, corpus)
    forget(found)
    return out


def _rooted_as(first: DataFrame, rows: DataFrame) -> DataFrame:
    return first.join(rows.select("v", "root").distinct(), "v")


def roots_of(corpus: Corpus) -> DataFrame:
    """v, root of each set that has a link, settled; sets that confirmed links connect have equal roots."""
    reps = corpus.reps
    members = reps.select("v", F.explode("keys").alias("key"))
    hubs = members.groupBy("key").agg(F.min("v").alias("hub"), F.max("v").alias("last")).where("hub < last").select("key", "hub")
    near = settle(members.join(hubs, "key"))  # members of buckets that hold more than one set
    stars = _stars(near, reps)
    # Of the hubs that are almost surely linked the least, so that a group gathers at one; else the likeliest.
    sure = F.col("e") >= PERCENT / 100 + MARGIN / 5
    rank = F.struct(F.when(sure, F.lit(-1.0)).otherwise(-F.col("e")), "b")
    best = settle(stars.groupBy("a").agg(F.min(rank)["b"].alias("b")))
    none = reps.select("v", F.col("v").alias("root")).where(F.lit(False))
    roots = _joined(none, confirmed(best, corpus))
    others = settle(_ends(stars.join(best, ["a", "b"], "left_anti").select("a", "b"), roots).select("a", "b"))
    forget(stars, best)
    roots = _joined(roots, confirmed(others, corpus))
    forget(others)

    open_ = settle(_open(_rooted(near.select("key", "v"), roots)))
    forget(near)
    for rows, find in ((open_.where(F.col("work") < HOT_WORK), _likely_links), (open_.where(F.col("work") >= HOT_WORK).select("v", "root").distinct(), _by_rare_shingles)):
        if not rows.isEmpty():
            pairs = find(rows, corpus)
            roots = _joined(roots, confirmed(pairs, corpus))
            forget(pairs)
    forget(open_)
    return roots


def _corpus(rows: DataFrame, docs: DataFrame, id_col: str, text_col: str, *order: str) -> Corpus:
    """rows is what sketches gives; of equal sets the first by `order` gives the vertex."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", *order, "row"))
    reps = rows.where("name is not null").groupBy("name").agg(first.alias("f"), F.first("keys").alias("keys"), F.first("sig").alias("sig"), F.first("n_shingles").alias("size"))
    return Corpus(docs, id_col, text_col, settle(reps.select(F.col("f.row").alias("v"), "name", F.col("f.doc_id").alias("doc_id"), *[f"f.{c}" for c in order], "keys", "sig", "size")))


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept of each row of docs.

    Null texts count as empty; a document without words has an empty set, no
    link and itself as component. Rows with equal sets are one vertex, so copies
    cost nothing. Repeated rows stay repeated, all kept or none. Null ids are
    passed over when the smallest id is sought. An empty table gives no rows.
    """
    rows = settle(sketches(docs, id_col, text_col))
    corpus = _corpus(rows, docs, id_col, text_col)
    rows = _slim(rows, "doc_id", "n_shingles", "name")
    found = _rooted(corpus.reps.select("v", "name", "doc_id"), roots := roots_of(corpus))
    least = found.groupBy("root").agg(F.min("doc_id").alias("component"))
    found = settle(found.join(least, "root").select(F.col("name").alias("_name"), "component"))
    forget(roots, corpus.reps)
    out = rows.join(found, F.col("name") == F.col("_name"), "left")
    component = F.when(F.col("_name").isNull(), F.col("doc_id")).otherwise(F.col("component"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def _slim(rows: DataFrame, *names: str) -> DataFrame:
    """Some columns of a settled table, which go on in its place."""
    out = settle(rows.select(*names))
    forget(rows)
    return out


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that are left when each component of near duplicates keeps one, with their columns.

    Rows are told apart by id and text, so rows that share an id, or have none,
    stand for themselves. The smallest id of a component stays, null ids come
    last; of equal ids the least digest of the text; of repeated rows (equal id
    and text) one. Documents without words all stay.
    """
    rows = settle(sketches(docs, id_col, text_col, digest=True))
    corpus = _corpus(rows, docs, id_col, text_col, "digest")
    rows = _slim(rows.where("name is not null"), "doc_id", "digest", "name")
    found = _rooted(corpus.reps.select("v", "name", "doc_id", "digest"), roots := roots_of(corpus))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")
    found = found.select("name", "root", order.alias("first"))
    least = found.groupBy("root").agg(F.min("first").alias("first"))
    stays = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("digest") == F.col("first.digest"))
    read = rows.join(found.drop("first").join(least, "root").select("name", "first"), "name")
    verdicts = settle(read.select("doc_id", "digest", stays.alias("stays")))
    forget(rows, roots, corpus.reps)
    gone = verdicts.where(~F.col("stays")).select(F.col("doc_id").alias("g_id"), F.col("digest").alias("g_digest")).distinct()
    row = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).cast("long").alias("id"), _digest(text_col).alias("digest"))
    these = lambda x: F.col("id").eqNullSafe(x["g_id"]) & (F.col("digest") == x["g_digest"])
    repeated = settle(verdicts.where("stays").groupBy(F.col("doc_id").alias("g_id"), F.col("digest").alias("g_digest")).count().where("count > 1").drop("count"))
    if repeated.isEmpty():
        return row.join(gone, these(gone), "left_anti").select("row.*")
    others = gone.unionByName(repeated)
    once = row.join(repeated, these(repeated), "left_semi").groupBy("id", "digest").agg(F.first("row").alias("row"))
    return row.join(others, these(others), "left_anti").select("row").unionByName(once.select("row")).select("row.*")
