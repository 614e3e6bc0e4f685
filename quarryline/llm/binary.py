"""Token ids in Arrow stream files with fixed-size-list batches.

A file holds the ids of consecutive documents as sequences of equal length, so
a memory-mapped reader finds any sequence and its mask without copying. The mask
has a bit a token, the lowest first, 1 for the tokens that belong to documents;
only a file's last sequence has others. Ids
are unsigned 16-bit while the vocabulary allows it. Each file has an index
beside it (doc_id, start in the file, n_tokens), an Arrow stream as well.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import settle, shared_folder
from . import tokens

LENGTH = 1024
#: Sequences of a record batch.
BATCH = 1024
END = 2
#: Text bytes that a file is made from, about.
FILE_BYTES = 32 << 20

MANIFEST = "file int, path string, first_doc long, tokens long, docs long"


#: File systems that pyarrow writes to as Spark does, by scheme.
SCHEMES = {"file": "file", "hdfs": "hdfs", "viewfs": "viewfs", "s3": "s3", "s3a": "s3", "gs": "gs"}


def shared_path(spark: SparkSession, folder: str) -> str:
    """A folder as a URI with its scheme, as Spark's default file system completes it. An error where no writer for it exists."""
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    full = where.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(where).toString()
    scheme, _, rest = full.partition(":")
    if scheme not in SCHEMES:
        raise ValueError(f"{full}: token files cannot be written to {scheme}")
    return f"{SCHEMES[scheme]}:{rest}"


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if ":" in path.partition("/")[0] else (fs.LocalFileSystem(), path)


class SequenceWriter:
    """Writes ids as fixed-size-list batches; a file appears under its name only when it is complete."""

    def __init__(self, path: str, dtype: str = "<u2", length: int = LENGTH, batch: int = BATCH):
        self.path, self.length, self.batch, self.dtype = path, length, batch, np.dtype(dtype)
        self.schema = pa.schema(
            {"ids": pa.list_(pa.field("item", pa.from_numpy_dtype(self.dtype), False), length), "mask": pa.list_(pa.field("item", pa.uint8(), False), length // 8)}
        )
        self.fs, self.name = _open(path)
        self.temp = f"{self.name}.{uuid.uuid4().hex}"
        self.out = self.fs.open_output_stream(self.temp)
        self.stream = pa.ipc.new_stream(self.out, self.schema)
        self.held: list[bytes] = []
        self.n = 0

    def write(self, ids: bytes) -> None:
        self.held.append(ids)
        self.n += len(ids)
        full = self.length * self.batch * self.dtype.itemsize
        if self.n >= full:
            data = b"".join(self.held)
            cut = len(data) - len(data) % full
            for i in range(0, cut, full):
                self._put(np.frombuffer(data, self.dtype, full // self.dtype.itemsize, i), None)
            self.held, self.n = [data[cut:]], len(data) - cut

    def _put(self, flat: np.ndarray, known: int | None) -> None:
        mask = np.ones(len(flat), np.uint8)
        if known is not None:
            mask[known:] = 0
        packed = np.packbits(mask, bitorder="little")  # a sequence's length is a multiple of 8
        cols = [pa.FixedSizeListArray.from_arrays(pa.array(x), type=t.type) for x, t in zip((flat, packed), self.schema)]
        self.stream.write_batch(pa.RecordBatch.from_arrays(cols, schema=self.schema))

    def close(self) -> None:
        flat = np.frombuffer(b"".join(self.held), self.dtype)
        if len(flat):
            padded = np.zeros(-(-len(flat) // self.length) * self.length, self.dtype)
            padded[: len(flat)] = flat
            self._put(padded, len(flat))
        self.stream.close()
        self.out.close()
        self.fs.move(self.temp, self.name)


class SequenceFile:
    """Random access to a file's sequences: file[i] is (ids, mask), views where the file is local and mapped; the mask has its bits packed."""

    def __init__(self, path: str, length: int = LENGTH, batch: int = BATCH):
        system, name = _open(path)
        source = pa.memory_map(name) if isinstance(system, fs.LocalFileSystem) else system.open_input_file(name)
        self.batches = list(pa.ipc.open_stream(source))
        self.length, self.batch = length, batch
        self.flat, self.masks = ([b.column(c).flatten().to_numpy(zero_copy_only=True) for b in self.batches] for c in ("ids", "mask"))

    def __len__(self) -> int:
        return sum(len(b) for b in self.batches)

    def __getitem__(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        b, j = divmod(i, self.batch)
        n = self.length // 8
        return self.flat[b][j * self.length : (j + 1) * self.length], self.masks[b][j * n : (j + 1) * n]

    def tokens(self, start: int, n: int) -> np.ndarray:
        """n ids from position start, across batches."""
        out, full = [], self.length * self.batch
        while n > 0:
            b, j = divmod(start, full)
            part = self.flat[b][j : j + n]
            out.append(part)
            start, n = start + len(part), n - len(part)
        return out[0] if len(out) == 1 else np.concatenate(out) if out else np.empty(0, "<u2")


def write_tokens(
    docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", end: int = END, vocabulary: str | None = None, files: int | None = None
) -> DataFrame:
    """Writes the files and gives the manifest (MANIFEST), settled. Files hold ascending ranges of ids, nulls first.

    Null texts are the end token alone; repeated rows are written as often as
    they occur; an empty table gives files without sequences. Rows with equal
    ids stand by the beginning of their text, then by its hash. Columns other
    than the id and the text are ignored.
    """
    path = vocabulary or tokens.vocabulary_path("word_bpe_49k.json")
    dtype = "<u2"
    folder = shared_path(docs.sparkSession, folder)
    read = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    if files is None:
        size = read.agg(F.sum(F.octet_length("text") + 64).alias("b")).collect()[0]["b"] or 0
        files = max(8, -(-size // FILE_BYTES))
    order = [F.col("doc_id").asc_nulls_first(), F.substring("text", 1, 32), F.xxhash64("text")]  # equal and null ids can be split
    dealt = read.repartitionByRange(files, *order).sortWithinPartitions(*order)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = tokens.encoder(path, False, dtype)
        last = np.array([end], dtype).tobytes()
        k = TaskContext.get().partitionId()
        system, base = _open(folder)
        system.create_dir(base, recursive=True)
        name = f"{folder}/tokens-{k:06d}.arrows"
        writer = SequenceWriter(name, dtype)
        ids, starts, counts, at = [], [], [], 0
        for b in batches:
            ids.extend(b.column(0).to_pylist())
            for text in b.column(1):
                data = encode(text.as_py()) + last
                n = len(data) // 2
                writer.write(data)
                starts.append(at)
                counts.append(n)
                at += n
        writer.close()
        index = pa.table({"doc_id": pa.array(ids, pa.int64()), "start": pa.array(starts, pa.int64()), "n_tokens": pa.array(counts, pa.int64())})
        temp = f"{base}/index-{k:06d}.{uuid.uuid4().hex}"
        with system.open_output_stream(temp) as out, pa.ipc.new_stream(out, index.schema) as stream:
            stream.write_table(index, max_chunksize=65536)
        system.move(temp, f"{base}/index-{k:06d}.arrows")
        row = ([k], [name], ids[:1] or [None], [at], [len(ids)])
        types = (pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, types)], ["file", "path", "first_doc", "tokens", "docs"])

    return settle(dealt.mapInArrow(write, MANIFEST))


def read_tokens(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the files of a manifest."""
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.where("docs > 0").select("file", "path", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("base"))
    files = settle(files)
    files = files.repartitionByRange(max(1, files.count()), "file")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, base in zip(b.column("path").to_pylist(), b.column("base").to_pylist()):
                system, name = _open(path.replace("/tokens-", "/index-"))
                file = SequenceFile(path)
                with system.open_input_stream(name) as source:
                    for part in pa.ipc.open_stream(source):
                        starts, counts = part.column("start").to_numpy(), part.column("n_tokens").to_numpy()
                        crcs = [zlib.crc32(file.tokens(s, n).astype("<u4").tobytes()) for s, n in zip(starts.tolist(), counts.tolist())]
                        cols = [part.column("doc_id"), pa.array(starts + base), part.column("n_tokens"), pa.array(crcs, pa.int64())]
                        yield pa.RecordBatch.from_arrays(cols, ["doc_id", "start", "n_tokens", "ids_crc32"])

    return files.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None) -> DataFrame:
    """write_tokens, then read_tokens: doc_id, start, n_tokens, ids_crc32 of each row, from the files. Odd rows are as write_tokens has them."""
    spark = docs.sparkSession
    folder = folder or f"{shared_folder(spark)}/tokens_{uuid.uuid4().hex}"
    return read_tokens(spark, write_tokens(docs, folder, id_col, text_col))
