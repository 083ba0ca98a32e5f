"""MinHash near-dedup by BagMinHash: near duplicates by weighted Jaccard similarity of word shingles.

A document is the multiset of its shingles (five consecutive words); a shingle's weight is its count, an
integer, so the weights are discretised at 1, 2, 3, ... For each shingle a Poisson process puts points into
the strip of time x weight; the strip is cut at powers of two, each part has its own process (disjoint parts
are independent), and inside a part a point's height is drawn at once, with the bits that halving it again and again
would draw. A point counts for a document if its height lies below the shingle's weight there. Every point
belongs to one of the m signature components, and a component keeps the earliest point that counts. Two
documents agree in a component with the probability of their weighted Jaccard similarity.

Points are made in order of time and only up to a horizon after which a signature of that total weight is
complete but for a few documents; those get a doubled horizon. So the work is about that of hashing each
shingle once.

Steps: equal texts are one class from the start; signatures are banded; in each bucket every class meets the
bucket's smallest one first (a star, not all pairs), and classes that those links don't join meet in cells of
two chunks of the bucket. Whatever meets is verified by exact multiset overlap.

Null and empty texts (no words) are near nothing, themselves included. Texts of fewer than five words have
one shingle: all their words. Words are `[^\\x20\\t-\\r]+`, unchanged; where texts are verified, words are compared by their
bytes. A text of any length is one row of a batch of its own; texts that meet in a cell hold about MEET words in all. Of
equal candidates the smallest doc_id stands for the class; rows that share a doc_id are told apart by their texts.
Other columns aren't looked at; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bidspark.llm.common import batches, chunk_cells, components, cut, discard, forest, free_names, small_batches, split_by_ids, whole_groups
from bidspark.llm.words import U, Words, mix, ngrams, per_doc_counts, split, split_exact

SHINGLE, BANDS, ROWS, CHUNK, MEET = 5, 20, 4, 256, 1 << 20


def shingles(w: Words, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, shingle) with counts; a row of fewer than n words has one shingle of all of them."""
    h, at = ngrams(w.hash, w.doc, n)
    doc = w.doc[at]
    size = np.diff(w.ptr)
    for k in range(1, n):
        rows = np.flatnonzero(size == k)
        if len(rows):
            part = w.hash[w.ptr[rows][:, None] + np.arange(k)]
            g = np.zeros(len(rows), np.uint64)
            for j in range(k):
                g = g * U(0xD6E8FEB86659FD93) + part[:, j]
            h, doc = np.append(h, mix(g ^ U(k))), np.append(doc, rows.astype(doc.dtype))
    return per_doc_counts(doc, h)


def _uniform(h: np.ndarray) -> np.ndarray:
    return ((h >> U(11)).astype(np.float64) + 0.5) * 2.0**-53


def bag_minhash(doc: np.ndarray, shingle: np.ndarray, count: np.ndarray, n_docs: int, m: int) -> np.ndarray:
    """Signatures (n_docs x m, 64-bit hashes of the winning points); rows without shingles stay 0."""
    best = np.full(n_docs * m, np.inf)
    value = np.zeros(n_docs * m, np.uint64)
    total = np.bincount(doc, count, n_docs)
    # the parts of the weight axis below each count: [0,1), [1,2), [2,4), [4,8), ...
    parts = np.ceil(np.log2(np.maximum(count, 1))).astype(np.int64) + 1
    own = np.repeat(np.arange(len(doc)), parts)
    level = np.arange(len(own)) - np.repeat(np.cumsum(parts) - parts, parts)
    low = np.where(level == 0, 0, 1 << np.maximum(level - 1, 0))
    width = np.where(level == 0, 1, low)
    d, c = doc[own], count[own]
    seed = mix(shingle[own] + level.astype(np.uint64) * U(0x9E3779B97F4A7C15))
    horizon = (np.log(m) + 4.0) / np.maximum(total, 1)
    open_docs = total > 0
    while open_docs.any():
        live = np.flatnonzero(open_docs[d])
        x = np.zeros(len(live))
        state = seed[live]
        while len(live):
            state = mix(state + U(0x632BE59BD9B4E019))
            x = x - np.log(_uniform(state)) / (m * width[live])
            on = x <= horizon[d[live]]
            live, x, state = live[on], x[on], state[on]
            if not len(live):
                break
            r = mix(state ^ U(0xA24BAED4963EE407))
            component = (r % U(m)).astype(np.int64)
            height = low[live] + ((r >> U(20)) % width[live].astype(np.uint64)).astype(np.int64)
            hit = np.flatnonzero(height < c[live])
            cell = d[live[hit]].astype(np.int64) * m + component[hit]
            order = np.lexsort((x[hit], cell))
            cell, at = cell[order], hit[order]
            first = np.append(True, cell[1:] != cell[:-1])[: len(cell)]
            cell, at = cell[first], at[first]
            better = x[at] < best[cell]
            best[cell[better]] = x[at][better]
            value[cell[better]] = state[at][better]
        full = np.isfinite(best.reshape(n_docs, m)).all(1)
        open_docs &= ~full
        horizon = np.where(open_docs, horizon * 2, horizon)
    return value.reshape(n_docs, m)


def similarity(a: Words, b: Words, n_rows: int) -> np.ndarray:
    """Weighted Jaccard similarity of row i of a and row i of b, from whole multisets."""
    da, ha, ca = shingles(a)
    db, hb, cb = shingles(b)
    doc, h, c = np.concatenate([da, db]), np.concatenate([ha, hb]), np.concatenate([ca, cb])
    order = np.lexsort((h, doc))
    doc, h, c = doc[order], h[order], c[order]
    same = (doc[1:] == doc[:-1]) & (h[1:] == h[:-1])
    both = np.bincount(doc[1:][same], np.minimum(c[1:], c[:-1])[same], n_rows)
    every = np.bincount(doc, c, n_rows) - both
    return np.where(every > 0, both / np.maximum(every, 1), 0.0)


def signatures(docs: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, digest, size, buckets array<long>): one pass over the texts; no buckets for texts without words."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it, "text"):
            w = split(b.column(1))
            doc, h, c = shingles(w)
            has = np.diff(w.ptr) > 0
            sig = bag_minhash(doc, h, c, b.num_rows, bands * rows)[has].reshape(int(has.sum()), bands, rows)
            key = np.zeros((len(sig), bands), np.uint64) + np.arange(bands, dtype=np.uint64)
            for j in range(rows):
                key = mix(key * U(0xD6E8FEB86659FD93) + sig[:, :, j])
            ptr = np.append(0, np.cumsum(has * bands)).astype(np.int32)
            bins = pa.ListArray.from_arrays(pa.array(ptr), pa.array(key.ravel().view(np.int64)))
            digest = [hashlib.sha256(x.as_buffer()).digest() if x.is_valid else b"" for x in b.column(1)]
            yield pa.record_batch([b.column(0), pa.array(digest), pa.array(np.bincount(doc, c, b.num_rows).astype(np.int64)), bins], names=["doc_id", "digest", "size", "buckets"])

    src = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return src.mapInArrow(run, "doc_id long, digest binary, size long, buckets array<long>")


def _verified(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) of classes whose texts' similarity is `least` or more."""
    left = texts.select(F.col("c").alias("a"), F.col("text").alias("ta"))
    right = texts.select(F.col("c").alias("b"), F.col("text").alias("tb"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "ta", "tb")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches(it, "ta"):
            for b in batches(iter([big]), "tb"):
                n = b.num_rows
                both = split_exact(pa.concat_arrays([b.column(2), b.column(3)]))
                on = similarity(both.rows(0, n), both.rows(n, 2 * n), n) >= least
                yield b.select(["a", "b"]).filter(pa.array(on))

    return both.mapInArrow(run, "a long, b long")


def _across(cells: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """Links (a, b) between parts p of the same cell; overlaps are matrix products within it, pairs aren't listed."""
    met = cells.join(texts, "c").select("cell", "c", "p", "text").repartition("cell").sortWithinPartitions("cell", "c")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(it, "cell"):
            for part in _runs(t.combine_chunks(), 1 << 20):
                cell, c, p = (np.asarray(part[x]) for x in ("cell", "c", "p"))
                doc, h, n = shingles(split_exact(part["text"]))
                total = np.bincount(doc, n, len(cell))
                ptr = np.searchsorted(doc, np.arange(len(cell) + 1))
                edge = np.append(np.flatnonzero(np.append(True, cell[1:] != cell[:-1])), len(cell))
                out_a, out_b = [], []
                for s, e in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                    if (p[s:e] == p[s]).all():
                        continue
                    rows = slice(ptr[s], ptr[e])
                    both = _overlaps(doc[rows] - s, h[rows], n[rows], e - s)
                    size = total[s:e]
                    near = both >= least * (size[:, None] + size[None, :] - both) * (1 - 1e-12)
                    near &= p[s:e, None] != p[None, s:e]
                    a, b = np.nonzero(np.triu(near, 1))
                    out_a.append(c[s:e][a])
                    out_b.append(c[s:e][b])
                if out_a:
                    a, b = forest(np.concatenate(out_a), np.concatenate(out_b))
                    yield pa.record_batch([pa.array(a), pa.array(b)], names=["a", "b"])

    return met.mapInArrow(run, "a long, b long")


def _runs(t: pa.Table, most: int) -> Iterator[pa.Table]:
    """Runs of whole cells with about `most` bytes of text; a larger cell stands alone."""
    cell = np.asarray(t["cell"])
    size = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(t["text"]), 0)).astype(np.int64))
    edge = np.append(np.flatnonzero(np.append(True, cell[1:] != cell[:-1])), len(cell))
    lo = 0
    for k in range(1, len(edge)):
        if k == len(edge) - 1 or size[edge[k + 1] - 1] - (size[edge[lo] - 1] if edge[lo] else 0) > most:
            yield t.slice(edge[lo], edge[k] - edge[lo])
            lo = k


def _overlaps(doc: np.ndarray, h: np.ndarray, n: np.ndarray, rows: int) -> np.ndarray:
    """Multiset overlap of all rows of a cell: a shingle with count n is n columns, the j-th for its j-th copy."""
    if n.max(initial=1) > 1:
        copy = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        doc, h = np.repeat(doc, n), np.repeat(h, n)
        h = np.where(copy > 0, mix(h + copy.astype(np.uint64) * U(0x9E3779B97F4A7C15)), h)
    _, col, times = np.unique(h, return_inverse=True, return_counts=True)
    often = times > 1
    col_of, on = np.cumsum(often) - 1, often[col]
    doc, col = doc[on], col_of[col[on]]
    out, step = np.zeros((rows, rows), np.float32), 4096
    order = np.argsort(col, kind="stable")
    doc, col = doc[order], col[order]
    for lo in range(0, int(often.sum()), step):
        a, b = np.searchsorted(col, [lo, lo + step])
        m = np.zeros((rows, min(step, int(often.sum()) - lo)), np.float32)
        m[doc[a:b], col[a:b] - lo] = 1
        out += m @ m.T
    return out


def _classes(docs: DataFrame, least: float, bands: int, rows: int) -> DataFrame:
    """(doc_id, digest, size, copies_of, class_id, part) of each row; digest: of its text; part: a number of the class, since two
    classes have one class_id where two texts share a doc_id."""
    made = cut(signatures(docs, bands, rows))
    own = F.concat(F.lit("-"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary")
    marked = made.withColumn("digest", F.when(F.col("size") > 0, F.col("digest")).otherwise(own))
    # equal texts: only digests and ids move; each distinct text is a node with a number of its own
    firsts = marked.groupBy("digest").agg(F.min("doc_id").alias("first")).withColumn("c", F.monotonically_increasing_id())
    firsts = cut(firsts)
    lead = marked.where("size > 0").join(firsts.withColumnRenamed("digest", "d"), (F.col("digest") == F.col("d")) & (F.col("doc_id") == F.col("first")))
    buckets = cut(lead.select("c", "first", "digest", "size", F.explode("buckets").alias("bucket")).distinct())
    star = buckets.groupBy("bucket").agg(F.min("c").alias("a"), F.count("*").alias("n")).where("n > 1")
    crowded = cut(buckets.join(star, "bucket").select("bucket", "c", "first", "digest", "size", "a"))
    first_pairs = cut(crowded.where("a <> c").select("a", F.col("c").alias("b")).distinct())
    some = cut(crowded.select("c", "first", "digest").distinct())
    discard(buckets)
    # texts that share a bucket with another; the others stay where they lie
    _, text = split_by_ids(docs.select(F.col("doc_id").cast("long").alias("first"), "text"), some, "first", "first")
    few = text.join(some, "first").where(F.unhex(F.sha2("text", 256)) == F.col("digest")).select("c", "text")
    if not marked.groupBy("doc_id").count().where("count > 1 and doc_id is not null").isEmpty():
        few = few.dropDuplicates(["c"])
    few = cut(few)
    links = cut(_verified(first_pairs, few, least))
    parts = components(links)
    # members of a bucket that these links leave apart meet again: only pairs across parts can still matter
    placed = crowded.join(parts, crowded.c == parts.node, "left").select("bucket", "c", "size", F.coalesce("component", "c").alias("p"))
    apart = placed.groupBy("bucket").agg(F.min("p").alias("p0"), F.max("p").alias("p1")).where("p0 <> p1").select("bucket")
    placed = placed.join(apart, "bucket")
    more = cut(_across(chunk_cells(placed, "bucket", "c", CHUNK, "size", MEET), few, least))
    parts = cut(components(links.union(more)).join(firsts.select(F.col("c").alias("node"), "first"), "node"))
    least_id = parts.groupBy("component").agg(F.min("first").alias("class_id"))
    placed = (firsts.join(parts.join(least_id, "component").select(F.col("node").alias("c"), "component", "class_id"), "c", "left"))
    placed = placed.select("digest", "first", F.coalesce("class_id", "first").alias("class_id"), F.coalesce("component", "c").alias("part"))
    out = cut(marked.select("doc_id", "digest", "size").join(placed, "digest").select("doc_id", "digest", "size", F.col("first").alias("copies_of"), "class_id", "part"))
    discard(made, firsts, crowded, first_pairs, some, few, links, more, parts)
    return out


def near_duplicates(docs: DataFrame, least: float = 0.8, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, copies_of, class_id): near-duplicate class of each document, its smallest doc_id.

    copies_of is the smallest doc_id with the very same text. Classes are the connected parts of the pairs
    of similarity `least` or more that share a bucket. One row per input row; rows without a doc_id
    get the ids of equal texts, if there are any. With bands of `rows` components each, a pair at 0.8 is missed with
    probability (1 - 0.8**rows)**bands, 3 in 100,000 by default.
    """
    return _classes(docs, least, bands, rows).select("doc_id", "copies_of", "class_id")


def drop_near_duplicates(docs: DataFrame, least: float = 0.8) -> DataFrame:
    """The rows of docs without near duplicates: of each class the row with the smallest doc_id (one, if it is repeated).

    Rows without a doc_id or without words stay. What goes is decided by doc_id and text together, so other texts
    under a doc_id are safe. Rows whose ids belong to no class of two rows aren't moved.
    """
    classes = _classes(docs, least, BANDS, ROWS).where("doc_id is not null and size > 0").select("part", "doc_id", "digest")
    sizes = classes.groupBy("part").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "digest")).alias("kept"))
    crowd = cut(sizes.where("n > 1").join(classes, "part").groupBy("doc_id", "digest").agg(F.count("*").alias("times"), F.first("kept").alias("kept")))
    alone, some = split_by_ids(docs, crowd, "doc_id", "doc_id")
    key, d = free_names(docs.columns, "__id", "__digest")
    some = some.withColumn(d, F.unhex(F.sha2("text", 256)))
    named = crowd.select(F.col("doc_id").alias(key), F.col("digest").alias("digest"), "times", (F.struct("doc_id", "digest") == F.col("kept")).alias("stays"))
    same = lambda t: (F.col("doc_id").cast("long") == t[key]) & (F.col(d) == t["digest"])
    gone, twice = named.where("not stays"), named.where("stays and times > 1")
    left = some.join(gone, same(gone), "left_anti")
    if twice.isEmpty():
        return alone.unionByName(left.drop(d))
    again = left.join(twice, same(twice), "left_semi").dropDuplicates(["doc_id", d])
    return alone.unionByName(left.join(twice, same(twice), "left_anti").drop(d)).unionByName(again.drop(d))
