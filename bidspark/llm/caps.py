"""Embedding near-dedup by spherical-cap filters.

A filter is a direction; a vector passes it if their inner product reaches a threshold. The directions form
random product codes, CODES of them: a code rotates the space, cuts it into two halves with a list of random
unit vectors for each, and a direction is one vector of either list, side by side. So a vector's inner
product with a direction is a sum of two numbers, and all directions that it passes are list-decoded: only
words of the first list that the best of the second can lift over the threshold are looked at further.
Vectors that pass the same filter meet there, and each pair that meets is verified by its cosine in double
precision.

The lists grow with the square root of the number of vectors, so a filter holds as few of them whatever their
number. A pair at a given cosine meets in one code with a chance that falls as the lists grow; it is measured on random
pairs at the least cosine, for the given length and lists, and so many codes are drawn (CODES or more) that at most about
MISSED of such pairs share no filter, of closer ones far fewer. Codes are drawn from their seeds in the tasks, one after
another, so neither what is sent nor what a task holds grows with their number. A pair is counted only in the first filter
that its two vectors share, so no pairs are gathered to be made distinct. Filters with many vectors are cut into chunks
that meet pair by pair of chunks: no task holds a whole filter. Equal vectors are one row with a multiplicity.

Null or zero vectors and those with null or non-finite components link with nothing; each is its own component. Vectors of
different lengths don't link; each length has filters of its own. Components are scaled by the largest before norms
are taken, so very large and very small numbers neither overflow nor vanish. Rows that share a vec_id are one node
with several vectors: one row each, with that vector's links, and one component; rows without one link with nothing. Pairs
at exactly the least cosine are links. Other columns aren't looked at; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bidspark.llm.common import chunk_cells, components, cut, discard, forest, whole_groups

CODES, MOST, EXPECTED, CHUNK, MISSED = 40, 160, 1.5, 512, 1e-3
HELD = 1 << 20  # inner products that a task holds at once


def cap_height(dims: int, share: float) -> float:
    """Inner product with a fixed direction that this share of random unit vectors reaches."""
    s = np.linspace(0, 1, 400_002)[1:-1]
    density = (1 - s**2) ** ((dims - 3) / 2)
    tail = np.cumsum(density[::-1])[::-1]
    return float(s[np.searchsorted(-tail / tail[0] / 2, -share)])


class CapFilters:
    """`codes` random product codes, each of `words` unit vectors for either half of its rotated space; drawn when used."""

    def __init__(self, dims: int, words: int, codes: int = CODES, expected: float = EXPECTED, seed: int = 5):
        self.dims, self.words, self.codes, self.seed = max(dims, 2), words, codes, seed
        self.threshold = cap_height(self.dims, min(0.5, expected / words**2))

    def draw(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Code k: both lists, with the rotation folded in."""
        rng, half = np.random.default_rng([self.seed, k]), self.dims // 2
        turn = np.linalg.qr(rng.standard_normal((self.dims, self.dims)))[0]
        lists = [rng.standard_normal((self.words, n)) for n in (half, self.dims - half)]
        left, right = (c / np.linalg.norm(c, axis=1, keepdims=True) / math.sqrt(2) for c in lists)
        return turn[:, :half] @ left.T, turn[:, half:] @ right.T

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, filter) of all filters that each unit vector passes, sorted."""
        if x.shape[1] < self.dims:
            x = np.pad(x, ((0, 0), (0, self.dims - x.shape[1])))
        rows, keys = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        step, most = max(8, HELD // self.words), HELD // self.words + 1
        for k in range(self.codes):
            left, right = self.draw(k)
            for lo in range(0, len(x), step):
                a, b = x[lo : lo + step] @ left, x[lo : lo + step] @ right
                r, i = np.nonzero(a >= (self.threshold - b.max(1))[:, None])
                for c in range(0, len(r), most):
                    rr, ii = r[c : c + most], i[c : c + most]
                    pick, j = np.nonzero(b[rr] >= (self.threshold - a[rr, ii])[:, None])
                    rows.append(lo + rr[pick])
                    keys.append((k * self.words + ii[pick]) * self.words + j)
        row, key = np.concatenate(rows), np.concatenate(keys)
        order = np.lexsort((key, row))
        return row[order], key[order]


def words_for(n: int) -> int:
    """Words per list: about one vector in two filters, whatever the number of vectors."""
    return max(16, round(2 * math.sqrt(max(n, 1))))


def codes_for(dims: int, words: int, least: float, expected: float = EXPECTED, pairs: int = 512, tried: int = 16) -> int:
    """Codes after which at most MISSED of pairs at cosine `least` share no filter, by a cautious estimate of one code's chance."""
    code, rng, dims = CapFilters(dims, words, tried, expected, seed=6), np.random.default_rng(7), max(dims, 2)
    x, z = (rng.standard_normal((pairs, dims)) for _ in range(2))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z -= (x * z).sum(1, keepdims=True) * x
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    each = [row * (tried * words**2) + key for row, key in map(code.decode, (x, least * x + math.sqrt(max(0.0, 1 - least**2)) * z))]
    share = len(np.unique(np.intersect1d(*each) // words**2)) / (pairs * tried)
    low = max(share - 2 * math.sqrt(share * (1 - share) / (pairs * tried)), 1e-4)
    return max(CODES, math.ceil(math.log(MISSED) / math.log(1 - low))) if low < 1 else CODES


def filters_for(dims: int, n: int, least: float) -> CapFilters:
    """Filters for n vectors; where caps of the usual size would need more than MOST codes, as in few dimensions, larger caps."""
    words, expected = words_for(n), EXPECTED
    while (codes := codes_for(dims, words, least, expected)) > MOST and expected < words**2 / 2:
        expected *= 2
    return CapFilters(dims, words, codes, expected)


def usable(col: str, dims: int | None = None) -> F.Column:
    """Whether a vector takes part: not null, finite, not zero and, if given, of the length `dims`."""
    c = F.col(col)
    bad = F.exists(c, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    ok = c.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.coalesce(F.exists(c, lambda v: v != 0), F.lit(False))
    return ok if dims is None else ok & (F.size(c) == dims)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, by their largest component first."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def embedding_duplicates(vectors: DataFrame, least: float = 0.9, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept): links are pairs of vectors found with cosine >= `least`."""
    rows = vectors.select(F.col(id_col).cast("long").alias("v"), F.col(vec_col).alias("e"))
    good = rows.where(usable("e") & F.col("v").isNotNull())
    # equal vectors are one, by a digest of their text form, with a number of its own
    digest = F.sha2(F.concat_ws(",", F.col("e").cast("array<string>")), 256)
    same = cut(good.groupBy(digest.alias("digest")).agg(F.min("v").alias("first"), F.count("*").alias("n"), F.first(F.size("e")).alias("d")).withColumn("c", F.monotonically_increasing_id()))
    sizes = {r["d"]: r["n"] for r in same.groupBy("d").agg(F.count("*").alias("n")).collect()}  # one row for each length
    distinct = good.withColumn("dg", digest).join(same, (F.col("v") == F.col("first")) & (F.col("dg") == F.col("digest")))
    distinct = cut(distinct.select("c", "n", "d", "e").dropDuplicates(["c"]))
    found = [_links(distinct.where(F.col("d") == d).select("c", "n", "e"), d, n, least) for d, n in sorted(sizes.items()) if n > 1]
    usable_row = usable("e") & F.col("v").isNotNull()
    members = cut(rows.select("v", F.when(usable_row, digest).alias("digest")).join(same.select("digest", "c", "n"), "digest", "left").select("v", "c", "n"))
    # vectors under one id are joined to the first of them
    held = members.where("c is not null").groupBy("v").agg(F.min("c").alias("a"), F.max("c").alias("z")).where("a < z")
    tied = members.join(held.select(F.col("v").alias("u"), "a"), F.col("v") == F.col("u")).where("c <> a").select("a", F.col("c").alias("b")).distinct()
    empty = F.lit(0).cast("long")
    links, edges = None, cut(tied)
    for f in found:
        links = f if links is None else links.unionByName(f)
    if links is None:
        counts = members.select(F.col("c").alias("a"), empty.alias("links")).limit(0)
        parts = components(edges)
    else:
        counts = links.groupBy("a").agg(F.sum("links").alias("links"))
        parts = components(links.where("b is not null").select("a", "b").unionByName(edges))
    parts = cut(parts)
    whole = members.join(counts, members.c == counts.a, "left").join(parts, members.c == parts.node, "left").select("v", "c", "n", "links", F.coalesce("component", "c").alias("part"))
    smallest = whole.where("c is not null").groupBy("part").agg(F.min("v").alias("component_id"))
    out = whole.join(smallest, "part", "left")
    n_links = F.when(F.col("c").isNull(), 0).otherwise(F.coalesce("links", F.lit(0)) + F.col("n") - 1).cast("long")
    comp = F.coalesce("component_id", "v")
    return out.select(F.col("v").alias(id_col), n_links.alias("n_links"), comp.alias("component_id"), F.coalesce(F.col("v") == comp, F.lit(True)).alias("kept"))


def _links(distinct: DataFrame, dims: int, n: int, least: float) -> DataFrame:
    """(a, links, b) of the n vectors (c, n, e) of one length: links of a, or an edge (a, b) that joins two nodes."""
    code = filters_for(dims, n, least)
    number = "int" if code.codes * code.words**2 <= np.iinfo(np.int32).max else "long"

    def decode(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for lo in range(0, batch.num_rows, 4096):
                b = batch.slice(lo, 4096)
                row, key = code.decode(unit(_matrix(b.column(2), dims)))
                ptr = np.searchsorted(row, np.arange(b.num_rows + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ptr), pa.array(key.astype(np.int32 if number == "int" else np.int64)))
                yield pa.record_batch([b.column(0), b.column(1), b.column(2), lists], names=["c", "n", "e", "filters"])

    element = distinct.schema["e"].dataType.simpleString()
    listed = cut(distinct.mapInArrow(decode, f"c long, n long, e {element}, filters array<{number}>"))
    # chunks of a crowded filter; a filter with one vector needs no meeting
    seats = chunk_cells(listed.select("c", F.explode("filters").alias("f")), "f", "c", CHUNK)
    meet = seats.join(listed, "c").select("cell", "h", "i", "j", "f", "c", "n", "e", "filters").repartition("cell").sortWithinPartitions("cell", "c")

    def verify(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(it, "cell"):
            t = t.combine_chunks()
            got = [np.asarray(t[x]) for x in ("cell", "h", "i", "j", "f", "c", "n")]
            cell, h, i, j, f, c, mult = got
            x = unit(_matrix(t["e"].combine_chunks() if isinstance(t["e"], pa.ChunkedArray) else t["e"], dims))
            lists = t["filters"].combine_chunks() if isinstance(t["filters"], pa.ChunkedArray) else t["filters"]
            off, flat = np.asarray(lists.offsets), np.asarray(lists.values)
            starts = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
            ends = np.append(starts[1:], len(cell))
            out_a, out_b = [], []
            for s, e in _pair_blocks(starts, ends):
                if isinstance(s, np.ndarray):  # many small groups at once
                    a, b = s, e
                    on = np.einsum("ij,ij->i", x[a], x[b]) >= least
                    a, b = a[on], b[on]
                    # in a cell of two chunks only pairs across them: each chunk also meets itself elsewhere
                    on = (i[a] == j[a]) | (h[a] != h[b])
                    a, b = a[on], b[on]
                    on = np.fromiter((_first_shared(flat[off[p] : off[p + 1]], flat[off[q] : off[q + 1]]) == f[p] for p, q in zip(a.tolist(), b.tolist(), strict=True)), bool, len(a))
                else:
                    near = x[s:e] @ x[s:e].T >= least - 1e-9
                    near &= ~_met_before(flat[off[s] : off[e]], off[s : e + 1] - off[s], f[s])
                    if i[s] != j[s]:
                        near &= h[s:e, None] != h[None, s:e]
                    a, b = np.nonzero(np.triu(near, 1))
                    a, b = a + s, b + s
                    on = np.einsum("ij,ij->i", x[a], x[b]) >= least
                out_a.append(a[on])
                out_b.append(b[on])
            a, b = (np.concatenate(o) if o else np.zeros(0, int) for o in (out_a, out_b))
            # per vector: other vectors linked, and the smallest of them; edges of a spanning forest of each batch
            who, with_ = np.append(a, b), np.append(b, a)
            order = np.lexsort((c[with_], c[who]))
            who, with_ = who[order], with_[order]
            new = np.append(True, c[who][1:] != c[who][:-1])[: len(who)]
            at = np.flatnonzero(new)
            links = np.add.reduceat(mult[with_], at) if len(at) else np.zeros(0, np.int64)
            pa_, pb = forest(c[a], c[b])
            yield pa.record_batch([pa.array(np.append(c[who][at], pa_)), pa.array(np.append(links, np.zeros(len(pa_), np.int64))), pa.array(np.append(np.full(len(at), -1), pb), mask=np.append(np.ones(len(at), bool), np.zeros(len(pb), bool)))], schema=pa.schema([("a", pa.int64()), ("links", pa.int64()), ("b", pa.int64())]))

    out = cut(meet.mapInArrow(verify, "a long, links long, b long"))
    discard(listed)
    return out


def _matrix(col: pa.Array, dims: int) -> np.ndarray:
    return np.asarray(col.flatten(), np.float64).reshape(-1, dims).copy()


def _first_shared(a: np.ndarray, b: np.ndarray) -> int:
    """Smallest element of both sorted arrays (they share one)."""
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    hit = np.flatnonzero(b[at] == a)
    return int(a[hit[0]])


def _met_before(flat: np.ndarray, off: np.ndarray, f: int) -> np.ndarray:
    """Whether two rows share a filter smaller than f, for all rows of a cell."""
    n = len(off) - 1
    row = np.repeat(np.arange(n), np.diff(off))
    row, key = row[flat < f], flat[flat < f]
    ids, col, times = np.unique(key, return_inverse=True, return_counts=True)
    often = times > 1
    col_of = np.cumsum(often) - 1
    on = often[col]
    out = np.zeros((n, n), np.float32)
    width, step = int(often.sum()), 2048
    row, col = row[on], col_of[col[on]]
    for lo in range(0, width, step):
        part = (col >= lo) & (col < lo + step)
        m = np.zeros((n, step), np.float32)
        m[row[part], col[part] - lo] = 1
        out += m @ m.T
    return out > 0


def _pair_blocks(starts: np.ndarray, ends: np.ndarray, small: int = 48, most: int = 200_000):
    """Groups of more than `small` rows as (start, end); all pairs of the smaller ones as two index arrays."""
    size = ends - starts
    for k in np.flatnonzero(size > small).tolist():
        yield int(starts[k]), int(ends[k])
    for n in np.unique(size[(size > 1) & (size <= small)]).tolist():
        p, q = np.triu_indices(n, 1)
        s = starts[size == n]
        step = max(1, most // len(p))
        for lo in range(0, len(s), step):
            base = s[lo : lo + step, None]
            yield (base + p).ravel(), (base + q).ravel()
