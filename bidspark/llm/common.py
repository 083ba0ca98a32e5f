"""Shared pieces of the training-data operators: tables, lineage cuts, links, batch iteration."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables; Spark opens the path, so any store that Spark reads will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A fresh path in the folder that the cluster shares (spark.checkpoint.dir).

    Only in local mode, where the setting is missing, a temporary folder stands in; a cluster without one is an error.
    """
    conf = spark.sparkContext.getConf()
    base = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir")
    if not base:
        if not conf.get("spark.master", "local").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = f"{tempfile.gettempdir()}/checkpoints"
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def _hadoop(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def cut(df: DataFrame) -> DataFrame:
    """Write `df` as a table in the shared folder and read it again: lineage ends there.

    The files are replicated by the store, so a lost executor costs a reread and nothing else. They go when the
    session ends, or earlier by `discard`.
    """
    spark, path = df.sparkSession, scratch(df.sparkSession)
    df.write.parquet(path)
    fs, p = _hadoop(spark, path)
    fs.deleteOnExit(p)
    out = spark.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables as `cut` returned them, that nothing still to be computed reads."""
    for t in tables:
        fs, p = _hadoop(t.sparkSession, t.cut_path)
        fs.delete(p, True)


def free_names(columns: list[str], *names: str) -> list[str]:
    """`names` with underscores before them until no column bears them, whatever its case."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        out.append(name)
    return out


def fold(doc_id: Column, k: int) -> Column:
    """crc32(doc_id as text) mod k."""
    return F.crc32(doc_id.cast("string").cast("binary")) % k


def small_batches(df: DataFrame, size: int = 4 << 20) -> DataFrame:
    """`df`, after lowering the session's Arrow batches to `size` bytes: a task holds a batch on both sides.

    The setting stays, since plans read it only when they run; a smaller one of the caller's is kept.
    """
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(conf.get(key).rstrip("b")) <= size:
        conf.set(key, str(size))
    return df


def release() -> None:
    """Hand freed memory back: Python workers outlive their tasks, and an executor's memory is theirs too."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def batches(it: Iterator[pa.RecordBatch], column: str, max_bytes: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that `column` (strings) holds about `max_bytes`; one longer row stands alone."""
    for batch in it:
        if not batch.num_rows:
            continue
        col = batch.column(batch.schema.get_field_index(column))
        size = np.asarray(pc.fill_null(pc.binary_length(col), 0)).astype(np.int64)
        part = np.cumsum(size) // max_bytes
        edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:], strict=False):
            if b > a:
                yield batch.slice(a, b - a)
    release()


def whole_groups(it: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables that hold whole groups of the integer `key`, from batches sorted by it.

    Callers bound their groups, so what is carried over between batches is bounded too.
    """
    rest: list[pa.RecordBatch] = []
    for batch in it:
        if not batch.num_rows:
            continue
        k = np.asarray(batch.column(batch.schema.get_field_index(key)))
        last = int(np.flatnonzero(k != k[-1])[-1]) + 1 if k[0] != k[-1] else 0
        if last or (rest and rest[-1].column(rest[-1].schema.get_field_index(key))[-1].as_py() != int(k[0])):
            if last:
                rest.append(batch.slice(0, last))
                yield pa.Table.from_batches(rest)
                rest = [batch.slice(last)]
            else:
                yield pa.Table.from_batches(rest)
                rest = [batch]
        else:
            rest.append(batch)
    if rest:
        yield pa.Table.from_batches(rest)
    release()


#: Places of a filter by id: what is broadcast is bounded by it, whatever the number of ids.
PLACES = 1 << 20


def split_by_ids(rows: DataFrame, ids: DataFrame, col: str, id_col: str) -> tuple[DataFrame, DataFrame]:
    """(rows whose `col` is surely not in ids.id_col, the other rows): wide rows that need no join with `ids` stay where they lie."""
    place = lambda c: F.pmod(F.xxhash64(F.col(c).cast("long")), F.lit(PLACES))
    (name,) = free_names(rows.columns, "__place")
    places = cut(ids.select(place(id_col).alias(name)).distinct())
    marked = rows.withColumn(name, place(col))
    return tuple(marked.join(F.broadcast(places), name, how).drop(name) for how in ("left_anti", "left_semi"))


def chunk_cells(seats: DataFrame, key: str, node: str, size: int, weight: str | None = None, most: int = 0) -> DataFrame:
    """Seats (key, node, ...) of keys with two nodes or more, dealt to cells of two chunks of at most about `size` nodes
    and, if `weight` names a column, of about `most` of its sum.

    A key's nodes are cut into g chunks by a hash; chunk h meets each chunk, itself included, in one cell, so every
    pair of nodes meets and no task holds a whole key. Adds h (own chunk), i <= j (the cell's chunks) and cell.
    """
    parts = F.count("*") / size if weight is None else F.greatest(F.count("*") / size, F.sum(weight) / most)
    crowd = seats.groupBy(key).agg(F.count("*").alias("k"), F.ceil(parts).cast("int").alias("g")).where("k > 1").select(key, "g")
    own = F.pmod(F.xxhash64(node, F.lit(3)), F.col("g")).cast("int").alias("h")
    dealt = seats.join(crowd, key).select(*seats.columns, "g", own)
    pairs = F.expr("transform(sequence(0, g - 1), o -> struct(least(h, o) as i, greatest(h, o) as j))")
    dealt = dealt.withColumn("__meet", F.explode(pairs)).select(*seats.columns, "h", F.col("__meet.i").alias("i"), F.col("__meet.j").alias("j"))
    return dealt.withColumn("cell", F.xxhash64(key, "i", "j"))


def components(links: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(node long, component long): smallest node reachable by `links`; nodes without links are absent.

    Each round moves every node to the smallest label among its own, its neighbours' and its label's
    label (pointer jumping). All state stays in Spark; minima are combined before each shuffle, and
    a round's labels are written to the shared folder, which cuts the lineage.
    """
    edges = links.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a <> b")
    edges = cut(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct())
    table = labels = cut(edges.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("l")).select(F.col("a").alias("v"), "l"))
    for _ in range(rounds):
        near = edges.join(labels, edges.b == labels.v).groupBy("a").agg(F.min("l").alias("m"))
        step = labels.join(near, labels.v == near.a).select("v", "l", F.least("l", "m").alias("n"))
        jump = labels.select(F.col("v").alias("jv"), F.col("l").alias("jl"))
        new = cut(step.join(jump, step.n == jump.jv, "left").select("v", F.col("l").alias("old"), F.least("n", "jl").alias("l")))
        discard(table)
        table, labels = new, new.select("v", "l")
        if new.where("l <> old").isEmpty():
            break
    else:
        raise RuntimeError("components did not settle")
    discard(edges)
    return labels.select(F.col("v").alias("node"), F.col("l").alias("component"))


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, root of its part) that join the same nodes as all edges (a, b)."""
    if not len(a):
        return a, b
    node, flat = np.unique(np.append(a, b), return_inverse=True)
    u, v = flat[: len(a)], flat[len(a) :]
    label = np.arange(len(node))
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, u, low)
        np.minimum.at(new, v, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    child = np.flatnonzero(label != np.arange(len(node)))
    return node[child], node[label[child]]
