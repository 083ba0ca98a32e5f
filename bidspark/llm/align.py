"""Tokens of two tokenizers over the same bytes: groups between common ends, and how many documents link each pair of ids.

A is a byte-level tokenizer, B one of word pieces with byte fallback. Both encode a space and the text. Where tokens of both end,
a group ends; an occurrence of an A id and one of a B id in a group are linked.

First pass: each task counts, over its documents, in how many each pair of ids is linked, and returns a row per distinct pair. The
distinct pairs are dealt to buckets of about BUCKET, and each bucket gets a minimal perfect hash and the keys in its order. Every
group of tasks' rows of a bucket becomes a dense vector of counts, indexed by the hash after the key there was compared; vectors are summed in a
tree until each bucket has one. Second pass: documents are aligned again, and pairs looked up in hash, keys and counts, which are
sent to the tasks if there are at most SENT pairs; beyond that each document's distinct pairs are joined with the counts.

Texts null, empty, or whose tokens' bytes aren't the space and the text have no tokens: zeros and an empty groups_sha256. Repeated
rows count as documents of their own. A very long text is a batch of its own. Ties of an id's best partner all count.
Columns beside doc_id and text aren't read; an empty table gives none.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bidspark.llm.common import batches, cut, discard, release, small_batches
from bidspark.llm.perfect import Perfect, scramble
from bidspark.llm.pieces import Lists, Memory, dealt, flattened, joinable, runs, segments, texts_of
from bidspark.llm.records import Encoder

BUCKET = 1 << 15  # distinct pairs of a bucket, about
FAN = 16  # tasks' rows, then vectors, that are summed at once
SENT = 1 << 21  # pairs whose hash, keys and counts are sent to the tasks: 34 MB
PAIRS = 1 << 21  # distinct pairs that a task counts before it returns them


class ByteTokens(Encoder):
    """A: bytes of each token of a byte-level file; added tokens' strings are ordinary text."""

    def __init__(self, path: str):
        super().__init__(path, plain=True)
        with open(path, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        # the printable alphabet of byte-level BPE: printable Latin-1 stands for itself, the rest follows from 256 on
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
        self.bytes = [b""] * len(self.width)
        for token, i in vocab.items():
            self.bytes[i] = bytes(map(byte.__getitem__, token))


class PieceTokens:
    """B: bytes of each token of a sentencepiece model that puts a space before the text."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.model.vocab_size()
        names = [self.model.id_to_piece(i) for i in range(n)]
        self.bytes = [bytes([int(x[3:5], 16)]) if self.model.is_byte(i) else x.replace("▁", " ").encode() for i, x in enumerate(names)]
        self.width = np.array([*map(len, self.bytes)], np.int64)
        #: whether no token goes over a space that follows another character
        self.parts = not any("▁" in x[1:] and x.strip("▁") for x in names)

    def ids(self, texts: list[str]) -> np.ndarray:
        return flattened(self.model.encode([t[1:] for t in texts], num_threads=1))


def _digits(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Decimal digits of 0 to n - 1, left-justified with one free column, and how many each has."""
    width = len(str(n))
    text = np.array([str(i).ljust(width + 1) for i in range(n)], f"S{width + 1}")
    return text.view(np.uint8).reshape(n, width + 1), np.array([len(str(i)) for i in range(n)], np.int64)


class Aligner:
    """Both tokenizers, and the alignment of distinct segments: sizes, the groups' text, distinct linked pairs with their number."""

    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = ByteTokens(a_path), PieceTokens(b_path)
        n = max(len(self.a.bytes), len(self.b.bytes))
        self.digits, self.places = _digits(n)
        self.lists = {"text": Lists(np.uint8), "pair": Lists(np.int64), "times": Lists(np.int64)}
        self.numbers = np.zeros((0, 4), np.int64)  # n_a, n_b, n_groups, n_links; n_a -1: bytes differ
        self.memory = Memory(self._learn, self._keep)
        self.keys: dict[int, int] = {}

    def _keep(self, slots: np.ndarray) -> None:
        for x in self.lists.values():
            x.keep(slots)
        self.numbers = self.numbers[slots]

    def _learn(self, words: pa.Array) -> np.ndarray:
        texts, order = texts_of(words, joinable(words) & self.b.parts)
        size = np.asarray(pc.binary_length(words)).astype(np.int64)[order]
        a, b = self.a.ids(texts), self.b.ids(texts)
        if b"".join(map(self.b.bytes.__getitem__, b.tolist())) != "".join(texts).encode():
            a, b, n_a, n_b, wrong = self._one_by_one(words.take(pa.array(order)))
        else:
            n_a, n_b = dealt(a, self.a.width[a], size), dealt(b, self.b.width[b], size)
            wrong = np.zeros(len(size), bool)
        self._align(a, b, n_a, n_b, wrong)
        return order

    def _one_by_one(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The same where some bytes differ: each segment by itself, none for those."""
        a, b = [], []
        for w in words.to_pylist():
            x, y = self.a.ids([w.decode()]).tolist(), self.b.ids([w.decode()]).tolist()
            same = all(b"".join(t.bytes[i] for i in ids) == w for t, ids in ((self.a, x), (self.b, y)))
            a.append(x if same else [])
            b.append(y if same else [])
        n_a, n_b = (np.fromiter(map(len, x), np.int64, len(x)) for x in (a, b))
        return flattened(a), flattened(b), n_a, n_b, n_a == 0

    def _align(self, a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, wrong: np.ndarray) -> None:
        n = len(n_a)
        end_a, end_b = np.cumsum(self.a.width[a]), np.cumsum(self.b.width[b])
        both = np.intersect1d(end_a, end_b, assume_unique=True)
        group_a, group_b = np.searchsorted(both, end_a), np.searchsorted(both, end_b)
        of_a = np.repeat(np.arange(n), n_a)
        segment = np.zeros(len(both), np.int64)
        segment[group_a] = of_a
        size_a, size_b = np.bincount(group_a, minlength=len(both)), np.bincount(group_b, minlength=len(both))
        n_groups = np.bincount(segment, minlength=n) if len(both) else np.zeros(n, np.int64)
        links = np.bincount(segment, size_a * size_b, minlength=n).astype(np.int64) if len(both) else np.zeros(n, np.int64)
        self.numbers = np.concatenate([self.numbers, np.stack([np.where(wrong, -1, n_a), n_b, n_groups, links], 1)])
        self._texts(a, b, group_a, group_b, n_a, n_b)
        self._pairs(a, b, group_a, group_b, segment, n)

    def _texts(self, a, b, group_a, group_b, n_a, n_b) -> None:
        """`a1,a2|b1;` for each group of each segment."""
        ids = np.append(a, b)
        rank = np.append(2 * group_a, 2 * group_b + 1)
        order = np.argsort(rank, kind="stable")
        ids, rank = ids[order], rank[order]
        last = np.append(rank[1:] != rank[:-1], True) if len(rank) else np.zeros(0, bool)
        mark = np.where(last, np.where(rank % 2, ord(";"), ord("|")), ord(",")).astype(np.uint8)
        places = self.places[ids]
        text = self.digits[ids]
        text[np.arange(len(ids)), places] = mark
        flat = text[np.arange(text.shape[1]) <= places[:, None]]
        ends = np.append(0, np.cumsum(places + 1))[np.cumsum(n_a + n_b)]
        self.lists["text"].add(flat, np.diff(np.append(0, ends)))

    def _pairs(self, a, b, group_a, group_b, segment, n) -> None:
        """Distinct pairs of each segment with how often they're linked in it."""
        (ga, ua, ta), (gb, ub, tb) = (_counted(g, ids) for g, ids in ((group_a, a), (group_b, b)))
        per = np.bincount(gb, minlength=len(segment))
        first = np.cumsum(per) - per
        left = np.repeat(np.arange(len(ga)), per[ga])
        right = runs(first[ga], per[ga])
        key = ua[left] << 32 | ub[right]
        distinct, inverse = np.unique(key, return_inverse=True)
        number = np.fromiter((self.keys.setdefault(k, len(self.keys)) for k in distinct.tolist()), np.int64, len(distinct))
        owner, pair, times = _counted(segment[ga[left]], number[inverse], ta[left] * tb[right])
        size = np.bincount(owner, minlength=n) if n else np.zeros(0, np.int64)
        self.lists["pair"].add(pair, size)
        self.lists["times"].add(times, size)

    def rows(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(slots of the texts' segments, first of each text (n+1)). Texts of which some segment's bytes differ are one segment; if its
        bytes differ too, none."""
        self.memory.tidy()
        n, whole = len(col), np.full(len(col), not self.b.parts)
        for _ in range(3):
            found, ptr = segments(col, lead=True, whole=whole)
            slots = self.memory.recall(found)
            bad = self.numbers[slots, 0] < 0
            if not bad.any():
                break
            rows = np.unique(np.searchsorted(ptr, np.flatnonzero(bad), "right") - 1)
            hopeless = rows[whole[rows]]
            whole[rows] = True
            if len(hopeless):
                col = pc.if_else(pa.array(np.isin(np.arange(n), hopeless)), pa.scalar(None, col.type), col)
        return slots, ptr


def _counted(group: np.ndarray, value: np.ndarray, times: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (group, value), sorted, with the sum of their times."""
    if not len(group):
        return group, value, np.zeros(0, np.int64)
    order = np.lexsort((value, group))
    group, value = group[order], value[order]
    new = np.flatnonzero(np.append(True, (group[1:] != group[:-1]) | (value[1:] != value[:-1])))
    total = np.diff(np.append(new, len(group))) if times is None else np.add.reduceat(times[order], new)
    return group[new], value[new], total


@cache
def aligner(a_path: str, b_path: str) -> Aligner:
    return Aligner(a_path, b_path)


def _fresh(a_path: str, b_path: str) -> Aligner:
    """The worker's aligner, its pairs renumbered from none if they're many."""
    got = aligner(a_path, b_path)
    if len(got.keys) > PAIRS:
        got.keys = {}
        got._keep(np.zeros(0, np.int64))
        got.memory.words, got.memory.hits = pa.array([], pa.binary()), np.zeros(0, np.int64)
    return got


def _held(x: Aligner, slots: np.ndarray, ptr: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, pair) of the texts."""
    row = np.repeat(np.arange(len(ptr) - 1), np.diff(ptr))
    distinct = np.unique(row << 32 | slots)
    pair, size = x.lists["pair"].take(distinct & 0xFFFFFFFF)
    key = np.unique(np.repeat(distinct >> 32, size) << 32 | pair)
    return key >> 32, key & 0xFFFFFFFF


def pair_counts(docs: DataFrame, a_path: str, b_path: str, text_col: str = "text") -> DataFrame:
    """(task int, key long, n long): in how many of a task's documents each pair, a << 32 | b, is linked. A task may return a pair more than once."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        x = _fresh(a_path, b_path)
        total = np.zeros(0, np.int64)

        def counted() -> Iterator[pa.RecordBatch]:
            keys = np.fromiter(x.keys, np.int64, len(x.keys))[: len(total)]
            at = np.flatnonzero(total)
            for k in range(0, len(at), 1 << 16):
                part = at[k : k + (1 << 16)]
                yield pa.record_batch([pa.array(np.full(len(part), task, np.int32)), pa.array(keys[part]), pa.array(total[part])], names=["task", "key", "n"])

        for batch in batches(it, "text", 2 << 20):
            if len(x.keys) > PAIRS:
                yield from counted()
                x, total = _fresh(a_path, b_path), np.zeros(0, np.int64)
            _, pair = _held(x, *x.rows(batch.column(0)))
            n = np.bincount(pair, minlength=len(x.keys))
            n[: len(total)] += total
            total = n
        yield from counted()

    return small_batches(docs).select(F.col(text_col).alias("text")).mapInArrow(run, "task int, key long, n long")


def _in_buckets(it: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    for b in it:
        key = np.asarray(b.column(b.schema.get_field_index("key")))
        yield b.append_column("bucket", pa.array((scramble(key, 0) % np.uint64(buckets)).astype(np.int32)))


def hashed_counts(pairs: DataFrame) -> DataFrame:
    """(bucket int, sizes binary, bits binary, keys binary, counts binary): of each bucket of distinct keys the hash, the keys
    in its order and the sums of `n`; pairs as `pair_counts` returns them, in a written table.

    Every step is bounded by the keys of a bucket: a task's rows of a bucket, FAN of them or of their vectors at once.
    """
    distinct = cut(pairs.select("key").distinct())
    buckets = max(1, -(-distinct.count() // BUCKET))
    dealt_out = distinct.mapInArrow(lambda it: _in_buckets(it, buckets), "key long, bucket int")

    def build(key: tuple, t: pa.Table) -> pa.Table:
        keys = np.sort(np.asarray(t.column("key")))
        h = Perfect.of(keys)
        placed = np.empty(len(keys), np.int64)
        placed[h(keys)] = keys
        return pa.table({"bucket": [key[0].as_py()], "sizes": [h.sizes.tobytes()], "bits": [h.packed.tobytes()], "keys": [placed.tobytes()]}, pa.schema([("bucket", pa.int32()), ("sizes", pa.binary()), ("bits", pa.binary()), ("keys", pa.binary())]))

    hashes = cut(dealt_out.groupBy("bucket").applyInArrow(build, "bucket int, sizes binary, bits binary, keys binary"))

    def vector(key: tuple, rows: pa.Table, h: pa.Table) -> pa.Table:
        perfect, placed = _hash_of(h, 0)
        keys = np.asarray(rows.column("key"))
        at = perfect(keys)
        if len(keys) and not (placed[at] == keys).all():
            raise ValueError("a pair that was not hashed")
        out = np.zeros(len(placed), np.int64)
        np.add.at(out, at, np.asarray(rows.column("n")))
        return pa.table({"bucket": pa.array([key[0].as_py()], pa.int32()), "slot": pa.array([key[1].as_py()], pa.int32()), "counts": pa.array([out.tobytes()], pa.binary())})

    def added(key: tuple, t: pa.Table) -> pa.Table:
        out = sum(np.frombuffer(x, np.int64) for x in t.column("counts").to_pylist())
        return pa.table({"bucket": pa.array([key[0].as_py()], pa.int32()), "slot": pa.array([key[1].as_py()], pa.int32()), "counts": pa.array([out.tobytes()], pa.binary())})

    schema = "bucket int, slot int, counts binary"
    rows = pairs.mapInArrow(lambda it: _in_buckets(it, buckets), "task int, key long, n long, bucket int").withColumn("slot", F.expr(f"task div {FAN}").cast("int"))
    slots = rows.agg(F.max("slot")).first()[0] or 0
    spread = hashes.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(slots)))).select("bucket", "slot", "sizes", "bits", "keys")
    vectors = rows.groupBy("bucket", "slot").cogroup(spread.groupBy("bucket", "slot")).applyInArrow(vector, schema)
    while slots:
        vectors = vectors.withColumn("slot", F.expr(f"slot div {FAN}").cast("int")).groupBy("bucket", "slot").applyInArrow(added, schema)
        slots //= FAN
    out = cut(hashes.join(vectors.drop("slot"), "bucket"))
    discard(distinct, hashes)
    return out


def _hash_of(t: pa.Table, k: int) -> tuple[Perfect, np.ndarray]:
    sizes, bits, keys = (t.column(c)[k].as_py() for c in ("sizes", "bits", "keys"))
    return Perfect(np.frombuffer(sizes, np.int64), np.frombuffer(bits, np.uint8)), np.frombuffer(keys, np.int64)


class Lookup:
    """Hashes, keys and counts of all buckets, as sent to the tasks; -1 for keys that were not counted."""

    def __init__(self, table: pa.Table):
        order = np.argsort(np.asarray(table.column("bucket")))
        self.hashes = [(*_hash_of(table, k), np.frombuffer(table.column("counts")[k].as_py(), np.int64)) for k in order.tolist()]

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, np.int64)
        bucket = (scramble(keys, 0) % np.uint64(max(1, len(self.hashes)))).astype(np.int64)
        for k, (perfect, placed, counts) in enumerate(self.hashes):
            at = np.flatnonzero(bucket == k)
            place = perfect(keys[at])
            known = (place >= 0) & (placed[place] == keys[at])
            out[at[known]] = counts[place[known]]
        return out


def _key_rows(table: DataFrame) -> DataFrame:
    """(a, key, n) of the table of `hashed_counts`."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for keys, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                k = np.frombuffer(keys, np.int64)
                yield pa.record_batch([pa.array(k >> 32), pa.array(k), pa.array(np.frombuffer(counts, np.int64))], names=["a", "key", "n"])

    return table.select("keys", "counts").mapInArrow(run, "a long, key long, n long")


DIGEST = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
_ZERO = "n_best", "count_sum"


def _second(a_path: str, b_path: str, lookup, best: np.ndarray | None, kind: str):
    """The second pass: digests of each document, with sums over its links if `lookup` is there, else with its distinct pairs."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = _fresh(a_path, b_path)
        count = top = np.zeros(0, np.int64)
        table = None if lookup is None else Lookup(pa.ipc.open_stream(lookup.value).read_all())
        for batch in batches(it, "text", 2 << 20):
            if len(x.keys) > PAIRS:
                x, count, top = _fresh(a_path, b_path), count[:0], top[:0]
            slots, ptr = x.rows(batch.column(1))
            over = lambda values: np.append(0, np.cumsum(values))[ptr]
            numbers = np.stack([np.diff(over(c)) for c in x.numbers[slots].T])
            text = x.lists["text"]
            sha = []
            edge = ptr.tolist()
            for a, b in zip(edge, edge[1:], strict=False):
                sha.append(hashlib.sha256(memoryview(text.take(slots[a:b])[0])[:-1]).hexdigest() if b > a else "")
            cols = [batch.column(0), *map(pa.array, numbers), pa.array(sha, pa.string())]
            if table is not None:
                if len(x.keys) > len(count):
                    new = np.fromiter(list(x.keys)[len(count) :], np.int64, len(x.keys) - len(count))
                    got, a = table(new), np.minimum(new >> 32, len(best) - 1)  # a worker remembers pairs of other tables too
                    count, top = np.append(count, got), np.append(top, got == best[a])
                used, inverse = np.unique(slots, return_inverse=True)
                pair, size = x.lists["pair"].take(used)
                times, _ = x.lists["times"].take(used)
                owner = np.repeat(np.arange(len(used)), size)
                if (count[pair] < 0).any():
                    raise ValueError("a pair that was not counted")
                for worth in (top, count):
                    total = np.zeros(len(used), np.int64)
                    np.add.at(total, owner, times * worth[pair])
                    cols.append(pa.array(np.diff(over(total[inverse]))))
                yield pa.record_batch(cols, names=["doc_id", *(c.split()[0] for c in DIGEST.split(", ")), *_ZERO])
            else:
                row = np.repeat(np.arange(len(ptr) - 1), np.diff(ptr))
                pair, size = x.lists["pair"].take(slots)
                times, _ = x.lists["times"].take(slots)
                keys = np.fromiter(x.keys, np.int64, len(x.keys))
                owner, pair, times = _counted(np.repeat(row, size), pair, times)
                offsets = pa.array(np.searchsorted(owner, np.arange(len(ptr))).astype(np.int32))
                cols += [pa.ListArray.from_arrays(offsets, pa.array(v, pa.int64())) for v in (keys[pair], times)]
                yield pa.record_batch(cols, names=["doc_id", *(c.split()[0] for c in DIGEST.split(", ")), "keys", "times"])
        release()

    return run, f"doc_id {kind}, {DIGEST}, " + ("n_best long, count_sum long" if lookup is not None else "keys array<long>, times array<long>")


def align(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", sent: int = SENT) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum) of each document."""
    spark = docs.sparkSession
    pairs = cut(pair_counts(docs, a_path, b_path, text_col))
    table = hashed_counts(pairs)
    discard(pairs)
    src = small_batches(docs).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = src.schema["doc_id"].dataType.simpleString()
    rows = _key_rows(table)
    best = rows.groupBy("a").agg(F.max("n").alias("best"))  # a row for each id of A at most
    total = table.select(F.sum(F.length("counts"))).first()[0] or 0
    if total // 8 <= sent:
        tops = {r.a: r.best for r in best.collect()}
        dense = np.zeros(max(tops, default=0) + 1, np.int64)
        dense[list(tops)] = list(tops.values())
        sink = pa.BufferOutputStream()
        whole = table.toArrow()
        with pa.ipc.new_stream(sink, whole.schema) as out:
            out.write_table(whole)
        run, schema = _second(a_path, b_path, spark.sparkContext.broadcast(sink.getvalue().to_pybytes()), dense, kind)
        return src.mapInArrow(run, schema).withColumnRenamed("doc_id", id_col)
    run, schema = _second(a_path, b_path, None, None, kind)
    aligned = cut(src.mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id()))
    worth = rows.join(F.broadcast(best), "a").select("key", "n", (F.col("n") == F.col("best")).cast("long").alias("top"))
    links = aligned.select("row", F.explode(F.arrays_zip("keys", "times")).alias("x")).select("row", F.col("x.keys").alias("key"), F.col("x.times").alias("times"))
    # a pair that most documents hold is dealt to FAN places by document
    salt = F.pmod(F.col("row"), F.lit(FAN)).cast("int").alias("salt")
    spread = worth.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(FAN - 1))))
    sums = links.select("*", salt).join(spread, ["key", "salt"]).groupBy("row").agg(F.sum(F.col("times") * F.col("top")).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    out = aligned.drop("keys", "times").join(sums, "row", "left").fillna(0, list(_ZERO))
    return out.drop("row").withColumnRenamed("doc_id", id_col)
