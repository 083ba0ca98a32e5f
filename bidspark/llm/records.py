"""Token ids in length-delimited binary records, with an offset index for reads in any order.

A data file holds records one after another:

    8 bytes   length of the payload, little-endian
    4 bytes   masked checksum of those 8 bytes
    payload   flags (1 byte: 1 if the doc_id is there, 2 if ids take four bytes), doc_id (8), count (4), ids (2 or 4 each)
    4 bytes   masked checksum of the payload

A checksum is a crc32, rotated by 15 bits and moved by a constant, so that a payload that holds checksums doesn't spoil its own.
Beside a data file stands its index: the offset of each record (8 bytes each), then their masked checksum. What Spark knows of the
files is a manifest, one row per file, which the task that wrote a file returns: files of tasks that ended early or ran twice
are in no manifest, so a lost executor leaves nothing wrong behind.

Order: ascending doc_id, null first; rows of one doc_id by a hash of their text, then as they come, so one doc_id
may have any number of rows. Null and empty texts are records with the end id only. A very long text is one record, a batch of its own;
a file is closed once it holds FILE bytes. An empty table gives an empty manifest and no files. Extra columns aren't read.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bidspark.llm.common import batches, cut, release, scratch, small_batches
from bidspark.llm.pieces import Lists, Memory, dealt, flattened, joinable, segments, texts_of

FILE = 256 << 20  # bytes of a data file, but for its last record
READ = 4 << 20  # bytes read at once
MASK = 0xA282EAD8
HEAD = struct.Struct("<QI")
BODY = struct.Struct("<BqI")
MANIFEST = "part int, roll int, file string, records long, tokens long, bytes long"


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + MASK) & 0xFFFFFFFF


class Corrupt(ValueError):
    """A record or an index whose bytes don't fit its checksum."""


def frame(doc_id: int | None, ids: np.ndarray) -> bytes:
    """One record."""
    wide = len(ids) > 0 and int(ids.max()) > 0xFFFF
    payload = BODY.pack((doc_id is not None) | 2 * wide, doc_id or 0, len(ids)) + ids.astype("<u4" if wide else "<u2").tobytes()
    size = len(payload).to_bytes(8, "little")
    return b"".join((size, masked(size).to_bytes(4, "little"), payload, masked(payload).to_bytes(4, "little")))


def unframe(data: memoryview) -> tuple[int | None, np.ndarray]:
    """(doc_id, ids) of one record, checked."""
    size, crc = HEAD.unpack_from(data)
    if crc != masked(data[:8]) or len(data) != HEAD.size + size + 4:
        raise Corrupt("length of a record")
    payload = data[HEAD.size : HEAD.size + size]
    if int.from_bytes(data[HEAD.size + size :], "little") != masked(payload):
        raise Corrupt("payload of a record")
    flags, doc_id, n = BODY.unpack_from(payload)
    return (doc_id if flags & 1 else None), np.frombuffer(payload, "<u4" if flags & 2 else "<u2", n, BODY.size).astype("<u4")


def store(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a shared folder, and the path in it."""
    return pafs.FileSystem.from_uri(path) if ":/" in path else (pafs.LocalFileSystem(), path)


class Writer:
    """Data files of one task in `folder`, each with its index; rows of the manifest in `done`."""

    def __init__(self, folder: str, part: int, name: str, most: int = FILE):
        self.folder, self.part, self.name, self.most = folder, part, name, most
        self.fs, self.root = store(folder)
        self.out, self.done = None, []

    def write(self, doc_id: int | None, ids: np.ndarray) -> None:
        if self.out is None:
            self.fs.create_dir(self.root, recursive=True)
            self.file, self.at, self.tokens = f"{self.name}-{len(self.done):04d}", [0], 0
            self.out = self.fs.open_output_stream(f"{self.root}/{self.file}.rec", buffer_size=1 << 20)
        record = frame(doc_id, ids)
        self.out.write(record)
        self.at.append(self.at[-1] + len(record))
        self.tokens += len(ids)
        if self.at[-1] >= self.most:
            self.close()

    def close(self) -> None:
        if self.out is None:
            return
        self.out.close()
        index = np.array(self.at, "<u8").tobytes()
        with self.fs.open_output_stream(f"{self.root}/{self.file}.idx") as f:
            f.write(index + masked(index).to_bytes(4, "little"))
        self.done.append((self.part, len(self.done), f"{self.folder}/{self.file}", len(self.at) - 1, self.tokens, self.at[-1]))
        self.out = None


class Reader:
    """Records of one data file through its index."""

    def __init__(self, file: str):
        fs, path = store(file)
        with fs.open_input_file(f"{path}.idx") as f:
            raw = f.read()
        if len(raw) < 12 or int.from_bytes(raw[-4:], "little") != masked(raw[:-4]):
            raise Corrupt(f"index of {file}")
        self.at = np.frombuffer(raw, "<u8", (len(raw) - 4) // 8).astype(np.int64)
        self.file = fs.open_input_file(f"{path}.rec")

    def __len__(self) -> int:
        return len(self.at) - 1

    def pick(self, lo: int, hi: int) -> list[tuple[int | None, np.ndarray]]:
        """Records lo to hi, read at once."""
        base = int(self.at[lo])
        data = memoryview(self.file.read_at(int(self.at[hi]) - base, base))
        edge = (self.at[lo : hi + 1] - base).tolist()
        return [unframe(data[a:b]) for a, b in zip(edge, edge[1:], strict=False)]

    def all(self) -> Iterator[list[tuple[int | None, np.ndarray]]]:
        """All records, about READ bytes at a time."""
        lo = 0
        while lo < len(self):
            hi = max(lo + 1, int(np.searchsorted(self.at, self.at[lo] + READ, "right")) - 1)
            yield self.pick(lo, hi)
            lo = hi

    def close(self) -> None:
        self.file.close()


class Encoder:
    """A byte-level tokenizer file of the tokenizers library; each distinct segment of a batch goes through the library once."""

    def __init__(self, path: str, plain: bool = False):
        """plain: added tokens' strings are ordinary text."""
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.tokenizer.encode_special_tokens = plain
        added = {i: t.content for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.special = [] if plain else list(added.values())
        self.width = np.zeros(self.tokenizer.get_vocab_size() + 1, np.int64)
        for token, i in self.tokenizer.get_vocab().items():
            self.width[i] = len(added[i].encode()) if i in added else len(token)
        self.lists = Lists(np.uint32)
        self.memory = Memory(self._learn, self.lists.keep)

    def ids(self, texts: list[str]) -> np.ndarray:
        """Ids of all texts in one array."""
        return flattened([e.ids for k in range(0, len(texts), 64) for e in self.tokenizer.encode_batch_fast(texts[k : k + 64], add_special_tokens=False)])

    def named(self, col: pa.Array) -> np.ndarray:
        """Rows that hold an added token's string."""
        found = np.zeros(len(col), bool)
        for name in self.special:
            found |= np.asarray(pc.fill_null(pc.match_substring(col, name), False))
        return found

    def _learn(self, words: pa.Array) -> np.ndarray:
        texts, order = texts_of(words, joinable(words) & ~self.named(words))
        ids = self.ids(texts)
        self.lists.add(ids, dealt(ids, self.width[ids], np.asarray(pc.binary_length(words))[order]))
        return order

    def encode(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and where each text begins (n+1). Texts that name an added token go in whole."""
        self.memory.tidy()
        found, ptr = segments(col, whole=self.named(col))
        flat, size = self.lists.take(self.memory.recall(found))
        return flat, np.append(0, np.cumsum(size))[ptr]


@cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def write_records(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write every row's ids, `end_id` last, to files in `path`; the manifest, written too: (part, roll, file, records, tokens,
    bytes), one row per file, whose order by part and roll is that of the rows."""
    keys = [F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text_col)).alias("h"), F.monotonically_increasing_id().alias("m")]
    rows = small_batches(docs).select(*keys, F.col(text_col).alias("text"))
    rows = rows.repartitionByRange("id", "h", "m").sortWithinPartitions("id", "h", "m").select("id", "text")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, code = TaskContext.get(), encoder(tokenizer)
        out = Writer(path, task.partitionId(), f"ids-{task.partitionId():06d}-{task.taskAttemptId()}-{os.urandom(4).hex()}")
        end = np.array([end_id], np.uint32)
        for batch in batches(it, "text", 4 << 20):
            flat, ptr = code.encode(batch.column(1))
            edge = ptr.tolist()
            for doc_id, a, b in zip(batch.column(0).to_pylist(), edge, edge[1:], strict=False):
                out.write(doc_id, np.append(flat[a:b], end))
        out.close()
        if out.done:
            fields = zip(*out.done, strict=True)
            yield pa.record_batch([pa.array(x, t) for x, t in zip(fields, [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64()], strict=True)], names=["part", "roll", "file", "records", "tokens", "bytes"])

    return cut(rows.mapInArrow(run, MANIFEST))


def _starts(manifest: DataFrame) -> DataFrame:
    """The manifest with `start`, the ids of all files before; one row per file, so one task orders them."""
    before = Window.orderBy("part", "roll").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("start", F.coalesce(F.sum("tokens").over(before), F.lit(0)))


def read_records(manifest: DataFrame, ids: bool = True) -> DataFrame:
    """All records: (doc_id, start long: ids of all records before, n_tokens long, ids_crc32 long, and, if wanted, ids array<int>)."""
    files = _starts(manifest).select("file", "start")
    files = files.repartition(max(1, manifest.count()), "file")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for file, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                reader = Reader(file)
                for got in reader.all():
                    n = [len(x) for _, x in got]
                    begin = start + np.append(0, np.cumsum(n[:-1])) if n else []
                    start += sum(n)
                    cols = [pa.array([d for d, _ in got], pa.int64()), pa.array(begin, pa.int64()), pa.array(n, pa.int64()), pa.array([zlib.crc32(x.tobytes()) for _, x in got], pa.int64())]
                    cols += [pa.array([x.astype(np.int32) for _, x in got], pa.list_(pa.int32()))] * ids
                    yield pa.record_batch(cols, names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(cols)])
                reader.close()
        release()

    return files.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * ids)


def shuffled_records(manifest: DataFrame, seed: int, tasks: int | None = None) -> DataFrame:
    """(rank long, doc_id long, ids array<int>): all records in an order that `seed` alone decides, each read at its offset.

    The order is that of a hash of (seed, place); the records of a task are its stretch of that order, in which they're returned.
    """
    place = F.explode(F.sequence(F.lit(0), (F.col("records") - 1).cast("int"))).alias("k")
    picks = manifest.where("records > 0").select("part", "roll", "file", place)
    picks = picks.select("file", "k", F.xxhash64(F.lit(seed), "part", "roll", "k").alias("rank"))
    keys = ["rank", "file", "k"]
    picks = (picks.repartitionByRange(tasks, *keys) if tasks else picks.repartitionByRange(*keys)).sortWithinPartitions(*keys)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            n = batch.num_rows
            file, k = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            got: list = [None] * n
            last = reader = None
            for i in sorted(range(n), key=lambda i: (file[i], k[i])):  # along the files, then back in order
                if file[i] != last:
                    if reader:
                        reader.close()
                    last, reader = file[i], Reader(file[i])
                got[i] = reader.pick(k[i], k[i] + 1)[0]
            if reader:
                reader.close()
            yield pa.record_batch([batch.column(2), pa.array([d for d, _ in got], pa.int64()), pa.array([x.astype(np.int32) for _, x in got], pa.list_(pa.int32()))], names=["rank", "doc_id", "ids"])

    return picks.mapInArrow(run, "rank long, doc_id long, ids array<int>")


def record_digests(docs: DataFrame, tokenizer: str, end_id: int = 0) -> DataFrame:
    """Write the records of `docs` to the shared folder and read them back as digests; the files go with the session."""
    spark = docs.sparkSession
    path = scratch(spark)
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)
    return read_records(write_records(docs, path, tokenizer, end_id), ids=False)
