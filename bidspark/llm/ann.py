"""Approximate nearest neighbours by multiprobe p-stable hashing.

The largest inner product is the nearest point once every vector gets one more coordinate that makes all norms equal
(and queries get 0 there). Norms are dealt to bands first, by quantiles, and each band is lifted to its own largest norm,
so a few long vectors don't blur the rest. Each of TABLES hash tables cuts Gaussian projections into slots. A query
visits, in each band, the bucket it falls into and the perturbed buckets around it in the order of their estimated
success: the sum of squared distances from its projections to the slots. What the tables find is merged, and ranked by
exact inner products in double precision, ties to the smaller id.

How many projections, and how many buckets a query visits, is chosen on the data: ASKED queries are answered exactly
by one pass over all rows, and of SETTINGS and PROBES the pair is taken that finds RECALL of those answers and looks
at the fewest rows, as a sample of about SAMPLE rows tells. So clustered vectors are pruned, and where neighbours are hardly nearer than
other rows, nearly all are looked at. If no pair is good enough, all rows are compared in blocks, without an index.

Work is dealt by bucket, rows and queries of a bucket in chunks, so neither a crowded bucket nor a popular probe meets
in one task; a cell returns the best few of each query. A query that found fewer candidates than `k` is answered
exactly against all rows in blocks.

Null or zero vectors, those with null or non-finite components, and rows without an id take no part. Vectors of
different lengths aren't compared; each length is searched by itself. Rows that share an id are one candidate with the best
score among them. Products that overflow are infinite and rank so. Other columns aren't looked at; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bidspark.llm.caps import unit, usable
from bidspark.llm.common import cut, discard, whole_groups
from bidspark.llm.words import U, mix

TABLES = 5
SETTINGS = ((5, 3, 1.5), (8, 1, 2.0), (10, 1, 2.0))  # projections, slots to either side, width of a slot
PROBES = (5, 10, 20, 40, 80, 160, 320)
QUANTILES = (0.5, 0.8, 0.95, 0.99)  # of the norms, between bands
SAMPLE, ASKED, RECALL = 4096, 64, 0.95
ROWS, QUERIES = 4096, 1024  # of a cell


def norms(x: np.ndarray) -> np.ndarray:
    most = np.abs(x).max(1)
    return most * np.linalg.norm(x / most[:, None], axis=1)


class StableHash:
    """Gaussian projections of all tables. edges: norms between bands; tops: the largest norm of each band."""

    def __init__(self, dims: int, edges: np.ndarray, tops: np.ndarray, setting: tuple[int, int, float], seed: int = 17):
        rng = np.random.default_rng(seed)
        self.size, self.reach, width = setting
        self.a = rng.standard_normal((dims + 1, TABLES * self.size)) / width
        self.b = rng.random(TABLES * self.size)
        self.edges, self.tops = np.asarray(edges, float), np.asarray(tops, float)

    def _key(self, slots: np.ndarray, table: int, band: np.ndarray | int) -> np.ndarray:
        key = np.zeros(slots.shape[:-1], np.uint64) + np.asarray(band * TABLES + table).astype(np.uint64)
        for j in range(self.size):
            key = mix(key * U(0xD6E8FEB86659FD93) + slots[..., j].astype(np.uint64))
        return key.view(np.int64)

    def rows(self, x: np.ndarray) -> np.ndarray:
        """Bucket of each vector in each table (n x TABLES)."""
        band = np.searchsorted(self.edges, norms(x), "right")
        y = x / self.tops[band][:, None]
        rest = np.sqrt(np.maximum(1 - (y**2).sum(1), 0))
        p = np.floor(np.column_stack([y, rest]) @ self.a + self.b).astype(np.int64).reshape(len(x), TABLES, self.size)
        return np.stack([self._key(p[:, t], t, band) for t in range(TABLES)], 1)

    def probes(self, x: np.ndarray, visits: int) -> np.ndarray:
        """Buckets that each query visits (n x TABLES x bands x visits), the likeliest first."""
        p = (unit(x) @ self.a[:-1] + self.b).reshape(len(x), TABLES, self.size)
        off = np.arange(-self.reach, self.reach + 1)
        visits = min(visits, len(off) ** self.size)
        out = []
        for t in range(TABLES):
            home = np.floor(p[:, t])
            cost = np.zeros((len(x), 1))
            for j in range(self.size):
                low = home[:, j, None] + off
                gap = np.where(off > 0, low - p[:, t, j, None], np.where(off < 0, p[:, t, j, None] - low - 1, 0)) ** 2
                cost = (cost[:, :, None] + gap[:, None, :]).reshape(len(x), -1)
            near = np.argpartition(cost, visits - 1, 1)[:, :visits]
            near = np.take_along_axis(near, np.argsort(np.take_along_axis(cost, near, 1), 1, kind="stable"), 1)
            move = np.stack([near // len(off) ** (self.size - 1 - j) % len(off) for j in range(self.size)], 2) - self.reach
            slots = home[:, None, :].astype(np.int64) + move
            out.append(np.stack([self._key(slots, t, band) for band in range(len(self.tops))], 1))
        return np.stack(out, 1)


def choose(ask: np.ndarray, answers: list[np.ndarray], sample: np.ndarray, edges: np.ndarray, tops: np.ndarray) -> tuple[tuple[int, int, float], int, float, float] | None:
    """(setting, probes, recall, share of rows looked at) that looks at the fewest rows; None if no pair has RECALL."""
    found = np.concatenate(answers)
    owner = np.repeat(np.arange(len(ask)), [len(a) for a in answers])
    best = None
    for setting in SETTINGS:
        index = StableHash(sample.shape[1], edges, tops, setting)
        probes = np.concatenate([index.probes(ask[i : i + 16], PROBES[-1]) for i in range(0, len(ask), 16)])
        sizes = probes.shape
        place = np.broadcast_to(np.arange(sizes[3]), sizes[1:]).ravel()

        def ranks(x: np.ndarray, q: int, index=index, probes=probes, place=place) -> np.ndarray:
            """At which visit each row is met, by any table."""
            keys = probes[q].ravel()
            order = np.lexsort((place, keys))
            keys, rank = keys[order], place[order]
            own = index.rows(x)
            at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
            return np.where(keys[at] == own, rank[at], PROBES[-1]).min(1)

        met = np.concatenate([ranks(found[owner == q], q) for q in range(len(ask))])
        seen = np.concatenate([ranks(sample, q) for q in range(len(ask))])
        for visits in PROBES:
            recall, looked = float((met < visits).mean()), float((seen < visits).mean())
            if recall >= RECALL and (best is None or looked < best[3]):
                best = setting, visits, recall, looked
    return best


def best(q: np.ndarray, qid: np.ndarray, x: np.ndarray, xid: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, place of the candidate, score): the k best rows of x for each query, by exact inner products."""
    with np.errstate(over="ignore", invalid="ignore"):
        s = q @ x.T
        s[(qid[:, None] == xid[None, :]) | np.isnan(s)] = -np.inf
        if len(xid) > k:
            least = np.partition(s, len(xid) - k, 1)[:, len(xid) - k, None]
            slack = 1e-9 * (1 + np.abs(np.where(np.isfinite(least), least, 0)))
            r, c = np.nonzero((s >= least - slack) & (s > -np.inf))
        else:
            r, c = np.nonzero(s > -np.inf)
        # one order of summation whatever the cell: equal vectors have equal scores
        score = np.concatenate([np.einsum("ij,ij->i", q[r[i : i + 65536]], x[c[i : i + 65536]]) for i in range(0, len(r), 65536)]) if len(r) else np.zeros(0)
    order = np.lexsort((xid[c], -score, r))
    r, c, score = r[order], c[order], score[order]
    keep = np.arange(len(r)) - np.searchsorted(r, r) < k
    return qid[r[keep]], c[keep], score[keep]


def _matrix(col: pa.Array, dims: int) -> np.ndarray:
    return np.asarray(col.flatten(), np.float64).reshape(-1, dims)


def _cells(it: Iterator[pa.RecordBatch], dims: int, k: int) -> Iterator[pa.RecordBatch]:
    for t in whole_groups(it, "cell"):
        t = t.combine_chunks()
        cell, ids, ask = (np.asarray(t[x]) for x in ("cell", "v", "ask"))
        x = _matrix(t["e"].combine_chunks(), dims)
        edge = np.append(np.flatnonzero(np.append(True, cell[1:] != cell[:-1])), len(cell))
        out = []
        for s, e in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            m = ask[s:e]
            if m.any() and not m.all():
                who, at, score = best(x[s:e][m], ids[s:e][m], x[s:e][~m], ids[s:e][~m], k)
                out.append((who, ids[s:e][~m][at], score))
        if out:
            a, b, c = (np.concatenate(z) for z in zip(*out, strict=True))
            yield pa.record_batch([pa.array(a), pa.array(b), pa.array(c)], names=["query_id", "v", "score"])


def _ranked(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.col("v"))
    one = found.groupBy("query_id", "v").agg(F.max("score").alias("score"))
    return one.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _exact(good: DataFrame, asked: DataFrame, dims: int, n: int, few: int, k: int) -> DataFrame:
    """(query_id, v, score) of `few` queries (v, e) against all n rows, in blocks of rows and of queries."""
    g, p = max(1, -(-n // ROWS)), max(1, -(-few // QUERIES))
    h, o = (F.pmod(F.xxhash64("v", F.lit(s)), F.lit(m)).cast("int") for s, m in ((1, g), (2, p)))
    left = good.select("v", "e", h.alias("h"), F.explode(F.sequence(F.lit(0), F.lit(p - 1))).alias("o"))
    right = asked.select("v", "e", o.alias("o"), F.explode(F.sequence(F.lit(0), F.lit(g - 1))).alias("h"))
    cell = F.xxhash64("h", "o").alias("cell")
    both = left.select(cell, "v", "e", F.lit(False).alias("ask")).unionByName(right.select(cell, "v", "e", F.lit(True).alias("ask")))
    return both.repartition("cell").sortWithinPartitions("cell").mapInArrow(lambda it: _cells(it, dims, k), "query_id long, v long, score double")


def _answers(good: DataFrame, dims: int, ids: np.ndarray, x: np.ndarray, k: int) -> list[np.ndarray]:
    """The vectors of the k nearest rows of a few queries, by one pass over all rows."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            v, e = np.asarray(batch.column(0)), _matrix(batch.column(1), dims)
            who, at, score = best(x, ids, e, v, k)
            yield pa.record_batch([pa.array(who), pa.array(v[at]), pa.array(score), batch.column(1).take(pa.array(at))], names=["query_id", "v", "score", "e"])

    kind = good.schema["e"].dataType.simpleString()
    near = good.select("v", "e").mapInArrow(run, f"query_id long, v long, score double, e {kind}")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "v")
    rows = near.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).select("query_id", "e").collect()  # ASKED x k rows
    return [np.array([r["e"] for r in rows if r["query_id"] == q], float).reshape(-1, dims) for q in ids.tolist()]


def nearest(vectors: DataFrame, queries: Column, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found for each row that `queries` admits, itself left out."""
    rows = vectors.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("v"), F.col(vec_col).alias("e"), queries.alias("ask"))
    good = rows.where(usable("e"))
    sizes = good.groupBy(F.size("e").alias("d")).agg(F.count("*").alias("n"), F.count(F.when(F.col("ask"), 1)).alias("few")).orderBy("d").collect()  # one row for each length
    out = None
    for r in sizes:
        if r["few"] and r["n"] > 1:
            part = _search(good.where(F.size("e") == r["d"]), r["d"], r["n"], r["few"], k)
            out = part if out is None else out.unionByName(part)
    if out is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("v").alias("vec_id"), "score")


def _search(good: DataFrame, dims: int, n: int, few: int, k: int) -> DataFrame:
    """(query_id, v, score, rank) for rows (v, e, ask) of one length."""
    share = F.pmod(F.xxhash64("v", F.lit(5)), F.lit(1_000_000)) < int(min(1.0, SAMPLE / n) * 1_000_000)
    sample = good.where(share).select("e").limit(2 * SAMPLE).toArrow()
    ask = good.where("ask").select("v", "e").orderBy(F.xxhash64("v", F.lit(9)), "v").limit(ASKED).toArrow()
    ids, x = np.asarray(ask["v"]), _matrix(ask["e"].combine_chunks(), dims)
    asked = good.where("ask").select("v", "e")
    chosen = None
    if sample.num_rows >= 8 * k:
        some = _matrix(sample["e"].combine_chunks(), dims)
        edges, last = [], (sizes := norms(some)).max()
        for e in np.quantile(sizes, QUANTILES)[::-1].tolist():
            if e < 0.9 * last:  # bands that differ
                edges, last = [e, *edges], e

        def widest(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in it:
                size = norms(_matrix(batch.column(0), dims))
                band = np.searchsorted(edges, size, "right")
                on = np.unique(band)
                yield pa.record_batch([pa.array(on), pa.array([size[band == b].max() for b in on.tolist()])], names=["b", "m"])

        tops = {r["b"]: r["m"] for r in good.select("e").mapInArrow(widest, "b long, m double").groupBy("b").agg(F.max("m").alias("m")).collect()}  # a row for each band
        tops = np.array([tops.get(b, 1.0) for b in range(len(edges) + 1)])
        chosen = choose(x, _answers(good, dims, ids, x, k), some, edges, tops)
    if chosen is None:
        return _ranked(_exact(good.select("v", "e"), asked, dims, n, few, k), k)
    index, visits = StableHash(dims, edges, tops, chosen[0]), chosen[1]
    element = good.schema["e"].dataType.simpleString()

    def keyed(ask: bool):
        def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in it:
                for lo in range(0, batch.num_rows, 16 if ask else 4096):
                    b = batch.slice(lo, 16 if ask else 4096)
                    x = _matrix(b.column(1), dims)
                    keys = index.probes(x, visits).reshape(len(x), -1) if ask else index.rows(x)
                    ptr = np.arange(0, keys.size + 1, keys.shape[1]).astype(np.int32)
                    yield pa.record_batch([b.column(0), b.column(1), pa.ListArray.from_arrays(pa.array(ptr), pa.array(keys.ravel()))], names=["v", "e", "keys"])

        return run

    kind = f"v long, e {element}, keys array<long>"
    base = good.select("v", "e").mapInArrow(keyed(False), kind)
    asked = cut(asked.mapInArrow(keyed(True), kind))
    seats = cut(base.select("v", "e", F.explode("keys").alias("bucket")))
    visited = asked.select("v", F.explode("keys").alias("bucket"))
    # the chunks of each bucket, from counts combined before they move
    size = seats.groupBy("bucket").agg(F.ceil(F.count("*") / ROWS).cast("int").alias("g"))
    asks = visited.groupBy("bucket").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("p"))
    plan = cut(size.join(asks, "bucket"))
    cell = F.xxhash64("bucket", "h", "o").alias("cell")
    own = F.pmod(F.xxhash64("v", F.lit(1)), F.col("g")).cast("int")
    left = seats.join(plan, "bucket").select("bucket", "v", "e", own.alias("h"), F.explode(F.sequence(F.lit(0), F.col("p") - 1)).alias("o"))
    own = F.pmod(F.xxhash64("v", F.lit(2)), F.col("p")).cast("int")
    right = visited.join(plan, "bucket").select("bucket", "v", own.alias("o"), F.explode(F.sequence(F.lit(0), F.col("g") - 1)).alias("h")).join(asked.select("v", "e"), "v")
    both = left.select(cell, "v", "e", F.lit(False).alias("ask")).unionByName(right.select(cell, "v", "e", F.lit(True).alias("ask")))
    met = both.repartition("cell").sortWithinPartitions("cell")
    found = cut(_ranked(met.mapInArrow(lambda it: _cells(it, dims, k), "query_id long, v long, score double"), k))
    discard(seats, plan)
    # queries with too few candidates are answered exactly, in blocks of rows and of queries
    got = found.groupBy("query_id").agg(F.count("*").alias("have"))
    poor = cut(asked.select("v", "e").join(got, F.col("v") == F.col("query_id"), "left").where(F.coalesce("have", F.lit(0)) < min(k, n - 1)).select("v", "e"))
    discard(asked)
    few = poor.count()
    if few:
        found = _ranked(found.select("query_id", "v", "score").unionByName(_exact(good.select("v", "e"), poor, dims, n, few, k)), k)
    return found
