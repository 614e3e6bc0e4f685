"""Blocks: documents by the megabyte, and messages between blocks and buckets.

An operator that needs a corpus-wide answer for most positions of most texts
cannot afford a row for each. Here a task packs documents into blocks, and a
block sends a message of its distinct keys to each part of a hashed key space.
So a key that every document holds arrives once a block.

A block sends FAN messages at most, however many buckets there are. With more
buckets than that, messages to one part meet in batches of a fixed size; a
batch merges its messages' keys, and sends FAN messages on to parts of its part.
So the number of messages follows the size of the text, not its square, and a
common key thins out at each level. Answers come back by the same way.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from typing import Any

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import delete, forget, settle

#: Documents of a block; messages that a sender sends at most; message bytes of a batch.
BLOCK_DOCS = 60_000
FAN = 1024
BATCH_BYTES = 64 << 20
LEAST_BUCKETS = 64
#: Buckets are answered in turns of so many at least, and in so many turns at most: a turn's messages are shuffled and go before the next one's.
TURN_BUCKETS, TURNS = 32, 4
ROWS = "block long, kind int, bucket long, payload binary"
NAMES = ["block", "kind", "bucket", "payload"]
TYPES = [pa.int64(), pa.int32(), pa.int64(), pa.binary()]
DOCS, ASK, ANSWER = 0, 1, 2


def squeeze(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed message; sorted unsigned 64-bit arrays shrink best as their differences (see deltas)."""
    parts = [x.tobytes() for x in arrays]
    head = np.array([len(parts), *[y for x, p in zip(arrays, parts) for y in (len(p), ord(x.dtype.char))]], np.int64)
    return zstandard.compress(head.tobytes() + b"".join(parts), 3)


def unsqueeze(data: bytes) -> list[np.ndarray]:
    data = zstandard.decompress(data)
    n = int(np.frombuffer(data, np.int64, 1)[0])
    head = np.frombuffer(data, np.int64, 2 * n, 8).tolist()
    at, out = 8 + 16 * n, []
    for size, kind in zip(head[::2], head[1::2]):
        t = np.dtype(chr(kind))
        out.append(np.frombuffer(data, t, size // t.itemsize, at))
        at += size
    return out


def deltas(x: np.ndarray) -> np.ndarray:
    return np.diff(x, prepend=x.dtype.type(0))


def undeltas(x: np.ndarray) -> np.ndarray:
    return np.cumsum(x, dtype=x.dtype)


def sums(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys, and the sums of the values by key."""
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, np.int64)
    return (keys[first], *[np.add.reduceat(v[order], first) if len(first) else v[:0] for v in values])


def distinct(keys: np.ndarray) -> np.ndarray:
    """Distinct keys, sorted."""
    keys = np.sort(keys)
    return keys[np.r_[True, keys[1:] != keys[:-1]]] if len(keys) else keys


def digit(place: np.ndarray, widths: list[int], level: int) -> np.ndarray:
    """The part that a place in the key space belongs to on a level."""
    below = int(np.prod(widths[:level], dtype=np.int64)) if level else 1
    return ((place // np.uint64(below)) % np.uint64(widths[level])).astype(np.uint16)


def by_digit(digits: np.ndarray) -> tuple[np.ndarray, dict[int, slice]]:
    """An order by digit that keeps the order within, and where each digit's elements stand in it: one sort, whatever the number of parts."""
    order = np.argsort(digits, kind="stable")
    d = digits[order]
    first = np.flatnonzero(np.r_[True, d[1:] != d[:-1]]) if len(d) else np.empty(0, np.int64)
    ends = np.append(first[1:], len(d))
    return order, {int(d[a]): slice(int(a), int(b)) for a, b in zip(first, ends)}


def rows(found: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*found)) if found else [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, TYPES)], NAMES)


def pack(ids: list[int | None], texts: list[bytes]) -> bytes:
    known = np.array([x is not None for x in ids], np.uint8)
    lengths = np.array([len(x) for x in texts], np.int64)
    return squeeze(np.array([x or 0 for x in ids], np.int64), known, lengths, np.frombuffer(b"".join(texts), np.uint8))


def unpack(payload: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """ids, known (a null id is 0 and not known), lengths, all texts' bytes."""
    ids, known, lengths, data = unsqueeze(payload)
    return ids, known.astype(bool), lengths, data


def widths_of(docs: DataFrame, text_col: str, each: int) -> list[int]:
    """Parts on each level, so that there is a bucket for each `each` bytes of text, LEAST_BUCKETS at least."""
    size = docs.agg(F.sum(F.octet_length(text_col)).alias("b")).collect()[0]["b"] or 0
    n, out = max(LEAST_BUCKETS, -(-size // each)), []
    while n > FAN:
        out.append(FAN)
        n = -(-n // FAN)
    return [*out, n]


@dataclass
class Sent:
    """Settled rows of ROWS, by kind: what senders hold (DOCS), and the messages that they ask (ASK)."""

    table: DataFrame

    def held(self) -> DataFrame:
        return self.table.where(F.col("kind") == DOCS)

    def asked(self) -> DataFrame:
        return self.table.where(F.col("kind") == ASK)

    def answered(self) -> None:
        """Deletes the messages."""
        delete(self.table.sparkSession, f"{self.table.settled_at}/kind={ASK}")


def sent(rows: DataFrame) -> Sent:
    """Settles rows of ROWS."""
    return Sent(settle(rows, "kind"))


def make(docs: DataFrame, id_col: str, text_col: str, block_bytes: int, ask: Callable) -> Sent:
    """Blocks, and the messages (part, payload) that ask(ids, known, lengths, data) gives for each."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        k = TaskContext.get().partitionId() << 32
        ids: list = []
        texts: list[bytes] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal ids, texts, size, k
            payload = pack(ids, texts)
            ids, texts, size = [], [], 0
            yield rows([(k, DOCS, -1, payload)])
            yield rows([(k, ASK, b, m) for b, m in ask(*unpack(payload))])
            k += 1

        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                t = (text.as_py() or "").encode()
                ids.append(doc)
                texts.append(t)
                size += len(t)
                if size >= block_bytes or len(ids) >= BLOCK_DOCS:
                    yield from flush()
        if ids:
            yield from flush()

    read = docs.select(F.col(id_col).cast("long"), F.col(text_col))
    return sent(read.mapInArrow(blocks, ROWS))


@dataclass(frozen=True)
class Exchange:
    """What an operator's messages are.

    merge(payloads): the content of several messages. split(content, level):
    (part, payload) for each part. answer(payloads): a bucket's answer to each
    message. spread(payloads, content, {part: answer}, level): a batch's answer
    to each of its messages, from the answers to its own.
    """

    widths: list[int]
    merge: Callable[[list[bytes]], Any]
    split: Callable[[Any, int], Iterator[tuple[int, bytes]]]
    answer: Callable[[list[bytes]], list[bytes]]
    spread: Callable[[list[bytes], Any, dict[int, bytes], int], list[bytes]]


def _gather(x: Exchange, level: int) -> Callable[[pa.Table], pa.Table]:
    """Messages to one part, as a batch: what it holds of them, and the messages that it sends on."""

    def run(table: pa.Table) -> pa.Table:
        me, bucket = table.column("batch")[0].as_py(), table.column("bucket")[0].as_py()
        blocks, payloads = table.column("block").to_pylist(), table.column("payload").to_pylist()
        held = squeeze(np.array([bucket], np.int64), np.array(blocks, np.int64), np.array([len(p) for p in payloads], np.int64), np.frombuffer(b"".join(payloads), np.uint8))
        out = [(me, DOCS, bucket, held)]
        out += [(me, ASK, bucket * FAN + d, m) for d, m in x.split(x.merge(payloads), level)]
        return pa.Table.from_batches([rows(out)])

    return run


def _back(x: Exchange, level: int) -> Callable[[pa.Table], pa.Table]:
    """A batch and the answers to its messages, as answers to the messages that it holds."""

    def run(table: pa.Table) -> pa.Table:
        kinds, buckets, messages = (table.column(c).to_pylist() for c in ("kind", "bucket", "payload"))
        parent, blocks, sizes, flat = unsqueeze(next(m for k, m in zip(kinds, messages) if k == DOCS))
        bucket, raw = int(parent[0]), flat.tobytes()
        ends = np.cumsum(sizes).tolist()
        payloads = [raw[e - n : e] for e, n in zip(ends, sizes.tolist())]
        got = {b - bucket * FAN: m for k, b, m in zip(kinds, buckets, messages) if k == ANSWER}
        found = x.spread(payloads, x.merge(payloads), got, level)
        return pa.Table.from_batches([rows([(k, ANSWER, bucket, a) for k, a in zip(blocks.tolist(), found)])])

    return run


def descend(first: Sent, x: Exchange) -> list[Sent]:
    """The senders of each level; the last one's messages go to buckets."""
    levels = [first]
    for level in range(1, len(x.widths)):
        asked = levels[-1].asked()
        parts = int(np.prod(x.widths[:level], dtype=np.int64))
        size = asked.agg(F.sum(F.octet_length("payload")).alias("b")).collect()[0]["b"] or 0
        share = F.pmod(F.xxhash64("block"), F.lit(max(1, -(-size // parts // BATCH_BYTES))))
        batch = F.col("bucket") * (1 << 24) + share

        levels.append(sent(asked.withColumn("batch", batch).groupBy("batch").applyInArrow(_gather(x, level), ROWS)))
        levels[-2].answered()
    return levels


def by_bucket(last: Sent, answer: Callable[[list[int], list[bytes]], pa.RecordBatch], schema: str) -> DataFrame:
    """answer(blocks, payloads) for all messages of a bucket."""

    def run(table: pa.Table) -> pa.Table:
        return pa.Table.from_batches([answer(table.column("block").to_pylist(), table.column("payload").to_pylist())])

    return last.asked().groupBy("bucket").applyInArrow(run, schema)


def ascend(levels: list[Sent], x: Exchange) -> DataFrame:
    """The answers to the first level's senders: settled rows (block, ANSWER, part, payload)."""

    def reply(table: pa.Table) -> pa.Table:
        blocks, payloads, bucket = table.column("block").to_pylist(), table.column("payload").to_pylist(), table.column("bucket")[0].as_py()
        return pa.Table.from_batches([rows([(k, ANSWER, bucket, a) for k, a in zip(blocks, x.answer(payloads))])])

    turns = min(TURNS, max(1, int(np.prod(x.widths, dtype=np.int64)) // TURN_BUCKETS))
    asked, parts = levels[-1].asked(), []
    for turn in range(turns):
        mine = asked.where(F.pmod(F.col("bucket"), F.lit(turns)) == turn) if turns > 1 else asked
        parts.append(settle(mine.groupBy("bucket").applyInArrow(reply, ROWS)))
    levels[-1].answered()
    answers = parts[0]
    if turns > 1:
        answers = settle(reduce(DataFrame.unionByName, parts))
        forget(*parts)
    for level in range(len(x.widths) - 1, 0, -1):
        both = levels[level].held().unionByName(answers)
        above = settle(both.groupBy("block").applyInArrow(_back(x, level), ROWS))
        forget(answers, levels[level].table)
        answers = above
    return answers


def by_block(parts: list[DataFrame], finish: Callable, schema: str) -> DataFrame:
    """finish(block, {part: answer}, [payload that the block holds in each of the other tables]) for each block; parts are the answers, then those tables."""
    both = parts[0].select(*NAMES)
    for i, p in enumerate(parts[1:]):
        both = both.unionByName(p.select("block", "kind", F.lit(-1 - i).cast("long").alias("bucket"), "payload"))

    def run(table: pa.Table) -> pa.Table:
        kinds, buckets, payloads = (table.column(c).to_pylist() for c in ("kind", "bucket", "payload"))
        got = {b: p for k, b, p in zip(kinds, buckets, payloads) if k == ANSWER}
        held = {b: p for k, b, p in zip(kinds, buckets, payloads) if k == DOCS}
        return pa.Table.from_batches([finish(table.column("block")[0].as_py(), got, [held[-1 - i] for i in range(len(held))])])

    return both.groupBy("block").applyInArrow(run, schema)
