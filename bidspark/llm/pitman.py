"""LM scoring with a hierarchical Pitman-Yor model.

Restaurants: one for each of the CONTEXTS most frequent words as the word before, and one that all other words
share; the word before a text's first is the end token. Their dishes are the DISHES most frequent words and "rare".
All these restaurants share one parent, whose customers are their tables; the parent's base is uniform over the
word types (and one type for unknown words). A rare word's own probability comes from one more restaurant,
over the rare words, with a uniform base.

Below these, every word that occurs before another is a context of its own, whatever its count: the words behind one of
the CONTEXTS words that are none of the DISHES sit in a restaurant of that word, whose parent is the rare words' one, and
all words behind any other word in a restaurant of that word, whose parent is the shared one. These parents are fixed
by then. So the counts of all word pairs enter; those of CONTEXTS x DISHES are seated above, the others here.

Seating is sampled by Gibbs: in a sweep every dish of a restaurant gives up its tables and its customers are seated
again one after another given all other tables and the parent's predictive probabilities (customers beyond
the first 64 in blocks of a tenth, each block at one probability). After a burn-in the predictive probabilities
of the remaining sweeps are averaged. Restaurants are dealt to tasks by context; what is broadcast is
bounded by CONTEXTS x DISHES, and by KNOWN words for lookups. Counts of all words, and those of words outside
that list, stay in Spark: rare words of the documents are joined with the counts. The pairs of all documents are dealt to
buckets once, packed; a bucket holds whole contexts, and the CONTEXTS words' pairs by a hash of both words, whose sums of
tables (CONTEXTS numbers a sweep) the driver passes on. A bucket counts the pairs of the documents learnt from and scores those of all.

Tokens: words `[^\\x20\\t-\\r]+` with A-Z lower-cased, then one end token. Null and empty texts have that one
token. Repeated rows get equal scores, each its own row; other columns aren't looked at. Without training
rows all scores are 0. A very long text is a batch of its own. Words of equal counts are ranked by their hashes, whose key
each driver process draws anew (`words.run_key`): scores differ between processes as two samples do, and not within one.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from bidspark.llm.common import batches, cut, discard, small_batches, whole_groups
from bidspark.llm.words import Words, run_key, split

CONTEXTS, DISHES, KNOWN = 512, 2048, 1 << 17
SWEEPS, BURN_IN, STRENGTH = 6, 2, 1.0
END = np.uint64(0x0E0D0E0D0E0D0E0D)
MIX = np.uint64(0x9E3779B97F4A7C15)
BUCKET, HELD = 1 << 20, 1 << 20  # tokens for each bucket; pairs a task holds


def tokens(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and rows of all tokens, each row's end token after its words; and each token's predecessor."""
    rows = len(w.ptr) - 1
    at = w.ptr[1:] + np.arange(rows)
    h = np.empty(len(w.hash) + rows, np.uint64)
    doc = np.empty(len(h), np.int32)
    word = np.ones(len(h), bool)
    word[at] = False
    h[word], doc[word] = w.hash, w.doc
    h[at], doc[at] = END, np.arange(rows)
    before = np.empty_like(h)
    before[1:] = h[:-1]
    before[:1] = END
    return h, doc, before


def seat(c: np.ndarray, p0: np.ndarray, others: np.ndarray, d: float, theta: float, rng: np.random.Generator) -> np.ndarray:
    """Tables that the c customers of each dish sit at, given the tables of all other dishes of its restaurant.

    Customers come one after another, and from the 128th on in blocks of a 64th of those seated: over a block the chance of a
    new table moves by less than a 64th, and the chance at its middle stands for all of it.
    """
    t = np.minimum(c, 1).astype(np.int64)
    live, n = np.flatnonzero(c > 1), 1
    while len(live):
        k = np.minimum(max(1, n // 64), c[live] - n)
        new = (theta + d * (others[live] + t[live])) * p0[live]
        share = new / (new + n - d * t[live])
        if n < 128:
            t[live] += rng.random(len(live)) < share
        else:
            more = share * (k - 1) / 2  # tables opened by the middle of the block
            new += d * more * p0[live]
            t[live] += rng.binomial(k, np.clip(new / (new + n + (k - 1) / 2 - d * (t[live] + more)), 0, 1))
        n += max(1, n // 64)
        live = live[c[live] > n]
    return t


def discount(ones: float, twos: float) -> float:
    """The discount that fits the numbers of counts of one and of two."""
    return float(min(max(ones / (ones + 2 * twos) if ones else 0.5, 0.1), 0.95))


@dataclass
class Model:
    known: np.ndarray  # sorted hashes of the frequent words
    rank: np.ndarray  # by frequency, the end token is 0
    base: np.ndarray  # log10(c + 0.1) of each
    own: np.ndarray  # log10 probability among the rare words
    pair: np.ndarray  # log10 P(dish | context)
    dishes: int
    contexts: int
    unseen: float
    n: int
    v: int

    def lookup(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place among the known words, whether it is there) of each hash, by a table with room for four times as many."""
        if not hasattr(self, "table"):
            bits = (4 * len(self.known)).bit_length()
            shift = np.uint64(64 - bits)
            home = (self.known >> shift).astype(np.int64)  # rising, as the hashes are sorted: each goes to the next free place
            i = np.arange(len(home))
            place = np.maximum.accumulate(home - i) + i
            table, owner = np.zeros((1 << bits) + len(home) + 1, np.uint64), np.full((1 << bits) + len(home) + 1, -1, np.int32)
            table[place], owner[place] = self.known, i
            self.table = shift, table, owner
        shift, table, owner = self.table
        place = (h >> shift).astype(np.int64)
        at, hit = np.zeros(len(h), np.int64), np.zeros(len(h), bool)
        left = np.arange(len(h))
        while len(left):
            who = owner[place[left]]
            same = (who >= 0) & (table[place[left]] == h[left])
            at[left[same]], hit[left[same]] = who[same], True
            left = left[~same & (who >= 0)]
            place[left] += 1
        return at, hit


def _counts(docs: DataFrame) -> DataFrame:
    """(h, c): tokens of the documents, summed within each task before they move."""

    key = run_key()

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, kept = [], 0
        for b in batches(it, "text"):
            h, c = np.unique(tokens(split(b.column(1), lower=True, salt=key))[0], return_counts=True)
            held.append((h, c))
            kept += len(h)
            if kept > 1_000_000:
                yield _summed(held)
                held, kept = [], 0
        if held:
            yield _summed(held)

    return small_batches(docs).select("doc_id", "text").mapInArrow(run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


def _summed(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    h, at = np.unique(np.concatenate([x for x, _ in held]), return_inverse=True)
    c = np.bincount(at, np.concatenate([y for _, y in held])).astype(np.int64)
    return pa.record_batch([pa.array(h.view(np.int64)), pa.array(c)], names=["h", "c"])


def _pairs(docs: DataFrame, top: np.ndarray, contexts: int) -> DataFrame:
    """(u, k, c): customers of dish k in the restaurant of context u. top: hashes by rank."""
    order = np.argsort(top)
    keys, ranks, dishes = top[order], order.astype(np.int64), len(top)
    shared, key = docs.sparkSession.sparkContext.broadcast((keys, ranks)), run_key()

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, ranks = shared.value
        total = np.zeros((contexts + 1) * (dishes + 1), np.int64)
        for b in batches(it, "text"):
            h, _, _ = tokens(split(b.column(1), lower=True, salt=key))
            at = np.minimum(np.searchsorted(keys, h), dishes - 1)
            k = np.where(keys[at] == h, ranks[at], dishes)
            u = np.minimum(np.append(0, k[:-1])[: len(k)], contexts)  # rank 0 is the end token
            total += np.bincount(u * (dishes + 1) + k, minlength=len(total))
        cell = np.flatnonzero(total)
        if len(cell):
            yield pa.record_batch([pa.array(cell // (dishes + 1)), pa.array(cell % (dishes + 1)), pa.array(total[cell])], names=["u", "k", "c"])

    return docs.select("doc_id", "text").mapInArrow(run, "u long, k long, c long").groupBy("u", "k").agg(F.sum("c").alias("c"))


def _rare(counts: DataFrame, top: np.ndarray, v: int, seed: int) -> tuple[DataFrame, float]:
    """counts with `own` (log10 probability among the rare words; null for dishes), and that of an unknown word."""
    spark = counts.sparkSession
    names = spark.createDataFrame([(int(x),) for x in top.view(np.int64).tolist()], "h long")
    rare = counts.join(F.broadcast(names), "h", "left_anti")  # the list is bounded by DISHES
    s = rare.agg(F.count("*").alias("types"), F.sum("c").alias("n"), F.sum((F.col("c") == 1).cast("long")).alias("n1"), F.sum((F.col("c") == 2).cast("long")).alias("n2")).first()
    types, n = s["types"], s["n"] or 0
    base, d = 1.0 / (v + 1 - len(top)) if v + 1 > len(top) else 1.0, discount(s["n1"] or 0, s["n2"] or 0)
    tables, draws = float(types), []

    def sampler(tables: float, sweep: int):
        def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in it:
                h, c, t, mean = (np.asarray(x) for x in b.columns)
                rng = np.random.default_rng([seed, sweep, int(h[0]) & 0x7FFFFFFF, len(h)])
                t = seat(c, np.full(len(c), base), tables - t, d, STRENGTH, rng)
                yield pa.record_batch([*b.columns[:2], pa.array(t), pa.array(mean + t * (sweep >= BURN_IN))], names=["h", "c", "t", "mean"])

        return run

    table = cut(rare.select("h", "c", F.lit(1).cast("long").alias("t"), F.lit(0).cast("long").alias("mean")))
    for sweep in range(BURN_IN + 2):
        before, table = table, cut(table.mapInArrow(sampler(tables, sweep), "h long, c long, t long, mean long"))
        discard(before)
        tables = float(table.agg(F.sum("t")).first()[0] or 0)
        draws += [tables] * (sweep >= BURN_IN)
    mean_t = sum(draws) / len(draws)
    rest = (STRENGTH + d * mean_t) / (STRENGTH + n) * base
    p = (F.col("c") - d * F.col("mean") / 2) / (STRENGTH + n) + rest
    out = cut(table.select("h", "c", F.log10(p).alias("own")))
    discard(table)
    return out, float(np.log10(rest))


def _restaurants(cells: DataFrame, contexts: int, dishes: int, base: np.ndarray, seed: int) -> np.ndarray:
    """log10 P(dish | context), averaged over the sweeps after the burn-in."""
    s = cells.agg(F.sum((F.col("c") == 1).cast("long")).alias("n1"), F.sum((F.col("c") == 2).cast("long")).alias("n2")).first()
    d = discount(s["n1"] or 0, s["n2"] or 0)
    state = cut(cells.select("u", "k", "c", F.lit(1).cast("long").alias("t"), F.lit(0.0).alias("mean")).repartition("u").sortWithinPartitions("u", "k"))
    parent = base.copy()
    t0 = np.zeros(dishes + 1, np.int64)
    rng0 = np.random.default_rng(seed)
    total = np.zeros((contexts + 1, dishes + 1))

    def sweep(parent: np.ndarray, turn: int):
        keep = turn >= BURN_IN

        def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            # a task's restaurants at once, (CONTEXTS + 1) x (DISHES + 1) rows at most
            held = [b for b in it if b.num_rows]
            if held:
                b = pa.Table.from_batches(held)
                u, k, c, t, mean = (np.asarray(b[x]) for x in ("u", "k", "c", "t", "mean"))
                rng = np.random.default_rng([seed, turn, int(u[0]), len(u)])
                _, r = np.unique(u, return_inverse=True)
                others = np.bincount(r, t)[r] - t
                t = seat(c, parent[k], others, d, STRENGTH, rng)
                if keep:
                    mean = mean + (c - d * t) / (STRENGTH + np.bincount(r, c)[r])
                yield pa.record_batch([pa.array(u), pa.array(k), pa.array(c), pa.array(t), pa.array(mean)], names=["u", "k", "c", "t", "mean"])

        return run

    for turn in range(SWEEPS):
        before, state = state, cut(state.repartition("u").sortWithinPartitions("u", "k").mapInArrow(sweep(parent, turn), "u long, k long, c long, t long, mean double"))
        discard(before)
        by_dish = state.groupBy("k").agg(F.sum("t").alias("t")).collect()  # at most DISHES + 1 rows
        customers = np.zeros(dishes + 1, np.int64)
        for row in by_dish:
            customers[row["k"]] = row["t"]
        d0 = discount((customers == 1).sum(), (customers == 2).sum())
        t0 = seat(customers, base, t0.sum() - t0, d0, STRENGTH, rng0)
        parent = (customers - d0 * t0) / (STRENGTH + customers.sum()) + (STRENGTH + d0 * t0.sum()) / (STRENGTH + customers.sum()) * base
        if turn >= BURN_IN:
            weight = np.ones(contexts + 1)  # a context without customers leaves all to the parent
            for row in state.groupBy("u").agg(((STRENGTH + d * F.sum("t")) / (STRENGTH + F.sum("c"))).alias("w")).collect():
                weight[row["u"]] = row["w"]
            total += np.outer(weight, parent)
    flat = state.select("u", "k", "mean").toArrow()  # at most (CONTEXTS + 1) x (DISHES + 1) rows
    total[np.asarray(flat["u"]), np.asarray(flat["k"])] += np.asarray(flat["mean"])
    discard(state)
    return np.log10(total / (SWEEPS - BURN_IN))


def train(docs: DataFrame, contexts: int = CONTEXTS, dishes: int = DISHES, known: int = KNOWN, seed: int = 3) -> tuple[Model | None, DataFrame]:
    """The model of all given documents, and the table (h, c, own) of its rare words."""
    counts = cut(_counts(docs))
    s = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    n, v = s["n"] or 0, s["v"]
    if not n:
        return None, counts.withColumn("own", F.lit(0.0))

    def frequent(most: int) -> list:
        """At most `most` rows (h, c) of largest c, by a cut-off found from classes of counts."""
        step = F.floor(F.log2("c") * 64)
        total, least = 0, None
        for row in counts.groupBy(step.alias("s")).count().orderBy(F.desc("s")).collect():
            if total + row["count"] > most:
                break
            total, least = total + row["count"], row["s"]
        return counts.where(step >= least).collect() if least is not None else []

    rows = sorted(((r["h"], r["c"]) for r in frequent(known)), key=lambda r: (-r[1], r[0]))
    end = int(np.array(END).view(np.int64))
    n_end = next((c for h, c in rows if h == end), None) or docs.count()
    rows = [(end, n_end), *[r for r in rows if r[0] != end]]
    top = np.array([h for h, _ in rows[:dishes]], np.int64).view(np.uint64)
    dishes, contexts = len(top), min(contexts, len(top))
    rare, unseen = _rare(counts, top, v, seed)
    uniform = np.full(dishes + 1, 1.0 / (v + 1))
    uniform[dishes] = (v + 1 - dishes) / (v + 1)
    pair = _restaurants(_pairs(docs, top, contexts), contexts, dishes, uniform, seed)
    least = min(c for _, c in rows)
    listed = rare.where(F.col("c") >= least).toArrow()
    own_of = dict(zip(np.asarray(listed["h"]).tolist(), np.asarray(listed["own"]).tolist(), strict=True))
    h = np.array([x for x, _ in rows], np.int64).view(np.uint64)
    c = np.array([x for _, x in rows], np.float64)
    own = np.array([own_of.get(x, 0.0) for x, _ in rows])
    order = np.argsort(h)
    discard(counts)
    return Model(h[order], order.astype(np.int64), np.log10(c + 0.1)[order], own[order], pair, dishes, contexts, unseen, n, v), rare


def _planes(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes()


def _pack(u: np.ndarray, k: np.ndarray, doc: np.ndarray, m: np.ndarray) -> bytes:
    """Pairs sorted by u and k: the steps of both, and the other columns, byte by byte of all rows."""
    step = np.diff(u, prepend=np.uint64(0))
    near = np.where(step == 0, np.diff(k, prepend=np.uint64(0)), k)
    return zstandard.ZstdCompressor(level=1).compress(b"".join(map(_planes, (step, near, doc.astype(np.uint32), m.astype(np.uint32)))))


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    n = len(raw) // 24
    take = lambda lo, width, kind: np.ascontiguousarray(raw[lo * n : (lo + width) * n].reshape(width, n).T).view(kind).ravel()
    step, near = take(0, 8, np.uint64), take(8, 8, np.uint64)
    total = np.cumsum(near, dtype=np.uint64)
    first = np.flatnonzero((step != 0) | (np.arange(n) == 0))
    k = total - np.repeat(total[first] - near[first], np.diff(np.append(first, n)))
    return np.cumsum(step, dtype=np.uint64), k, take(16, 4, np.uint32), take(20, 4, np.uint32)


def _place(u: np.ndarray, k: np.ndarray, contexts: int, buckets: tuple[int, int]) -> np.ndarray:
    """Bucket of each pair: the CONTEXTS words' pairs by both words in the first buckets[0], others by context in the rest."""
    own = u < contexts
    mixed = (np.where(own, u * MIX ^ k, u) + np.uint64(1)) * MIX >> np.uint64(32)
    return np.where(own, mixed % np.uint64(buckets[0]), mixed % np.uint64(buckets[1]) + np.uint64(buckets[0])).astype(np.int64)


def _ranked(*columns: np.ndarray, known: int) -> tuple[list[np.ndarray], int]:
    """Columns of word ids as small numbers of the same order, and how many bits they take: ranks below `known` as they are, hashes by
    their place among those here."""
    far = [c >= np.uint64(known) for c in columns]
    names = np.unique(np.concatenate([c[f] for c, f in zip(columns, far, strict=True)]))
    out = []
    for c, f in zip(columns, far, strict=True):
        x = c.astype(np.int64)
        x[f] = known + np.searchsorted(names, c[f])
        out.append(x)
    return out, (known + len(names)).bit_length()


def _dealt(u: np.ndarray, k: np.ndarray, doc: np.ndarray, learn: np.ndarray, contexts: int, buckets: tuple[int, int], known: int = KNOWN) -> Iterator[tuple]:
    """(bucket, learn, blob) of pairs of word ids (rank, or hash of a word that is not known), each with its document."""
    if not len(u):
        return
    place = _place(u, k, contexts, buckets) * 2 + learn
    (x, y), wide = _ranked(u, k, known=known)
    if int(place.max()).bit_length() + 2 * wide > 63 or len(u).bit_length() + int(doc.max()).bit_length() > 63:
        order = np.lexsort((doc, k, u, place))
        u, k, doc, place = u[order], k[order], doc[order], place[order]
        new = np.append(True, (u[1:] != u[:-1]) | (k[1:] != k[:-1]) | (doc[1:] != doc[:-1]) | (place[1:] != place[:-1]))
        at = np.flatnonzero(new)
        u, k, doc, place = u[at], k[at], doc[at], place[at]
    else:  # sorted as single numbers: the pairs first, then the documents of each
        key = (place << wide | x) << wide | y
        order = np.argsort(key)
        key = key[order]
        head = np.append(True, key[1:] != key[:-1])
        bits = int(doc.max()).bit_length()
        both = np.sort(np.cumsum(head) << bits | doc[order])
        first = order[head]
        at = np.flatnonzero(np.append(True, both[1:] != both[:-1]))
        pair = (both[at] >> bits) - 1
        u, k, place, doc = u[first][pair], k[first][pair], place[first][pair], both[at] & (1 << bits) - 1
        new = both
    times = np.diff(np.append(at, len(new)))
    edge = np.append(np.flatnonzero(np.append(True, place[1:] != place[:-1])[: len(u)]), len(place))
    for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        yield int(place[a]) // 2, bool(place[a] % 2), _pack(u[a:b], k[a:b], doc[a:b], times[a:b])


def _far(u: np.ndarray, k: np.ndarray, m: Model, buckets: tuple[int, int]) -> Iterator[tuple]:
    """(bucket, hashes): words of each bucket's pairs that are not known."""
    on = k >= len(m.known)
    place, k = _place(u[on], k[on], m.contexts, buckets), k[on]
    order = np.lexsort((k, place))
    place, k = place[order], k[order]
    at = np.flatnonzero(np.append(True, (place[1:] != place[:-1]) | (k[1:] != k[:-1]))[: len(k)])
    place, k = place[at], k[at]
    edge = np.append(np.flatnonzero(np.append(True, place[1:] != place[:-1])[: len(k)]), len(k))
    for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        yield int(place[a]), k[a:b].view(np.int64)


@dataclass
class Bucket:
    """Pairs (u, k) of one bucket in order; who, cell and m are the documents' pairs."""

    u: np.ndarray
    context: np.ndarray  # index of u among the bucket's contexts
    c: np.ndarray  # customers
    p: np.ndarray  # the parent's probability
    who: np.ndarray
    cell: np.ndarray
    m: np.ndarray


def _bucket(t: pa.Table, m: Model) -> Bucket | None:
    got, far, far_own = [], [], []
    for r in t.select(["uid", "learn", "blob", "hs", "owns"]).to_batches():
        for uid, learn, blob, hs, owns in zip(*r.columns, strict=True):
            if blob.is_valid:
                u, k, doc, times = _unpack(blob.as_py())
                got.append((u, k, doc.astype(np.int64) + uid.as_py(), times.astype(np.int64), np.full(len(u), learn.as_py())))
            elif hs.is_valid:
                far.append(np.asarray(hs.values).view(np.uint64))
                far_own.append(np.asarray(owns.values))
    if not got:
        return None
    u, k, who, times, learn = (np.concatenate(x) for x in zip(*got, strict=True))
    (x, y), wide = _ranked(u, k, known=len(m.known))
    order = np.argsort(x << wide | y) if 2 * wide < 64 else np.lexsort((k, u))
    u, k, who, times, learn = u[order], k[order], who[order], times[order], learn[order]
    new = np.append(True, (u[1:] != u[:-1]) | (k[1:] != k[:-1]))
    cell, at = np.cumsum(new) - 1, np.flatnonzero(new)
    u, k = u[at], k[at]
    c = np.bincount(cell, times * learn).astype(np.int64)
    listed = k < len(m.known)
    rank = np.where(listed, k, 0).astype(np.int64)
    dish = np.where(listed, np.minimum(rank, m.dishes), m.dishes)
    by_rank = np.empty(len(m.known))
    by_rank[m.rank] = m.own
    p = np.where(listed, by_rank[rank], m.unseen)
    if far:
        h, o = np.concatenate(far), np.concatenate(far_own)
        order = np.argsort(h)
        h, o = h[order], o[order]
        at = np.minimum(np.searchsorted(h, k), len(h) - 1)
        p = np.where(~listed & (h[at] == k), o[at], p)
    own = u < m.contexts
    p = 10 ** (np.where(dish == m.dishes, p, 0.0) + np.where(own, 0.0, m.pair[m.contexts, dish]))
    context = np.cumsum(np.append(True, u[1:] != u[:-1])) - 1
    return Bucket(u, context, c, p, who, cell, times)


def _seats(b: Bucket, tables: list[np.ndarray] | None, d: float, seed: int, bucket: int) -> tuple[np.ndarray, np.ndarray]:
    """Tables of each cell and of each cell's context, averaged; tables: those of the CONTEXTS words before each sweep and after the last."""
    t = np.minimum(b.c, 1)
    live = np.flatnonzero(b.c > 1)
    mean, sums = np.zeros(len(t)), np.zeros(len(t))
    for turn in range(SWEEPS):
        near = (np.bincount(b.context, t)[b.context] if tables is None else tables[turn][b.u.astype(np.int64)])[live]
        t[live] = seat(b.c[live], b.p[live], near - t[live], d, STRENGTH, np.random.default_rng([seed, turn, bucket, 0]))
        if turn >= BURN_IN:
            mean += t
            sums += np.bincount(b.context, t)[b.context] if tables is None else tables[turn + 1][b.u.astype(np.int64)]
    return mean / (SWEEPS - BURN_IN), sums / (SWEEPS - BURN_IN)


def _forget(spark: SparkSession) -> None:
    """Shuffle files of steps that have ended go from the disks once the driver's garbage is collected."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()


def _gains(own: DataFrame, rest: DataFrame, far: DataFrame, rare: DataFrame, shared, contexts: int, first_rest: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """log10 of what the words' own restaurants make of the probabilities above, summed over each document's pairs: (uid, gain) of
    the pairs in own, (doc_id, th, gain) of those in rest.

    own, rest: (bucket, uid, learn, blob), the pairs of the CONTEXTS words and all others; rest also has lists `docs` of what its
    uids stand for; far: (bucket, far).
    """
    spark = own.sparkSession
    met = far.select("bucket", F.explode("far").alias("h")).distinct().join(rare.select("h", "own"), "h")
    lists = cut(met.groupBy("bucket").agg(F.collect_list(F.struct("h", "own")).alias("x")).select("bucket", F.col("x.h").alias("hs"), F.col("x.own").alias("owns")))
    _forget(spark)
    whole = lambda blobs, known: blobs.unionByName(known, allowMissingColumns=True).repartition("bucket").sortWithinPartitions("bucket")

    def first(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(it, "bucket"):
            for key in np.unique(np.asarray(t["bucket"])).tolist():
                b = _bucket(t.filter(pc.equal(t["bucket"], key)), shared.value)
                if b is None:
                    continue
                on = b.c > 0
                at = b.u[on].astype(np.int64)
                n, cells = np.bincount(at, b.c[on], contexts).astype(np.int64), np.bincount(at, minlength=contexts)
                live = b.c > 1
                lists = [pa.array([x], pa.list_(y)) for x, y in ((n, pa.int64()), (cells, pa.int64()), (b.u[live].astype(np.int64), pa.int64()), (b.c[live], pa.int64()), (b.p[live], pa.float64()), (np.ones(live.sum(), np.int64), pa.int64()))]
                yield pa.record_batch([pa.array([key]), pa.array([int((b.c == 1).sum())]), pa.array([int((b.c == 2).sum())]), *lists], names=["bucket", "n1", "n2", "n", "tables", "u", "c", "p", "t"])

    near = lists.where(F.col("bucket") < first_rest)
    state = cut(whole(own, near).mapInArrow(first, "bucket long, n1 long, n2 long, n array<long>, tables array<long>, u array<long>, c array<long>, p array<double>, t array<long>"))

    def total(col: str) -> np.ndarray:
        out = np.zeros(contexts, np.int64)
        for r in state.select(F.posexplode(col).alias("u", "x")).groupBy("u").agg(F.sum("x").alias("x")).collect():  # CONTEXTS rows
            out[r["u"]] = r["x"]
        return out

    s = state.agg(F.sum("n1").alias("n1"), F.sum("n2").alias("n2")).first()
    n1, n2 = s["n1"] or 0, s["n2"] or 0
    d, n, tables = discount(n1, n2), total("n"), [total("tables")]

    def sweep(before: np.ndarray, turn: int):
        def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in it:
                for key, *cols in zip(*(batch.column(batch.schema.get_field_index(x)) for x in ("bucket", "u", "c", "p", "t")), strict=True):
                    u, c, p, t = (np.asarray(x.values) for x in cols)
                    new = seat(c, p, before[u] - t, d, STRENGTH, np.random.default_rng([seed, turn, key.as_py(), 0]))
                    # what changes in the sums of tables
                    step = np.bincount(u, new - t, contexts).astype(np.int64)
                    yield pa.record_batch([pa.array([key.as_py()]), *(pa.array([x], y.type) for x, y in zip((step, u, c, p, new), (cols[0], cols[0], cols[1], cols[2], cols[3]), strict=True))], names=["bucket", "tables", "u", "c", "p", "t"])

        return run

    for turn in range(SWEEPS):
        before, state = state, cut(state.select("bucket", "u", "c", "p", "t").mapInArrow(sweep(tables[-1], turn), "bucket long, tables array<long>, u array<long>, c array<long>, p array<double>, t array<long>"))
        discard(before)
        tables.append(tables[-1] + total("tables"))
    discard(state)

    def last(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(it, "bucket"):
            listed = t.filter(t["docs"].is_valid())
            for docs in listed["docs"].combine_chunks() if len(listed) else []:
                cols = [docs.values.field(x) for x in ("uid", "doc_id", "th")]
                yield pa.record_batch([cols[0], pa.nulls(len(cols[0]), pa.float64()), *cols[1:]], names=["uid", "gain", "doc_id", "th"])
            for key in np.unique(np.asarray(t["bucket"])).tolist():
                b = _bucket(t.filter(pc.equal(t["bucket"], key)), shared.value)
                if b is None:
                    continue
                size = np.bincount(b.context, b.c)[b.context]
                if key < first_rest:
                    size, fit = n[b.u.astype(np.int64)], d
                else:  # a bucket's own counts, leaning on the others where they are few
                    lean = 1000.0 / max(n1 + n2, 1)
                    fit = discount((b.c == 1).sum() + n1 * lean, (b.c == 2).sum() + n2 * lean)
                mean, sums = _seats(b, tables if key < first_rest else None, fit, seed, key)
                gain = np.log10((np.maximum(b.c - fit * mean, 0) / b.p + STRENGTH + fit * sums) / (STRENGTH + size))
                who, at = np.unique(b.who, return_inverse=True)
                yield pa.record_batch([pa.array(who), pa.array(np.bincount(at, gain[b.cell] * b.m)), pa.nulls(len(who), kind), pa.nulls(len(who), pa.int64())], names=["uid", "gain", "doc_id", "th"])

    _forget(spark)
    field = rest.schema["docs"].dataType.elementType["doc_id"].dataType
    kind = to_arrow_type(field)
    every = own.unionByName(rest, allowMissingColumns=True)
    found = whole(every, lists).mapInArrow(last, f"uid long, gain double, doc_id {field.simpleString()}, th long")
    # a document has a row for each bucket that its pairs lie in: summed before they move
    found = cut(found.groupBy("uid").agg(F.sum("gain").alias("gain"), F.max(F.when(F.col("th").isNotNull(), F.struct("th", "doc_id"))).alias("of")))
    discard(lists)
    _forget(spark)
    # copies of a row under one doc_id have equal gains, so their mean is each one's
    named = found.where("uid < 0").select("of.*", "gain").groupBy("doc_id", "th").agg(F.avg(F.coalesce("gain", F.lit(0.0))).alias("gain"))
    return found.where("uid >= 0").select("uid", "gain"), named


def _parts(m: Model, b: pa.RecordBatch, uid: np.ndarray, key: int) -> tuple[pa.RecordBatch, tuple[np.ndarray, ...]]:
    """What the known words alone say of each text, its unknown words, and its pairs (u, k, row) that go to the restaurants below."""
    h, doc, _ = tokens(split(b.column(1), lower=True, salt=key))
    rows = b.num_rows
    at, hit = m.lookup(h)
    k = np.where(hit, np.minimum(m.rank[at], m.dishes), m.dishes)
    u = np.minimum(np.append(0, k[:-1]), m.contexts)
    lm = m.pair[u, k] + np.where(hit & (k == m.dishes), m.own[at], 0.0)
    other, word = doc[~hit], h[~hit]
    order = np.lexsort((word, other))
    other, word = other[order], word[order]
    first = np.flatnonzero(np.append(True, (other[1:] != other[:-1]) | (word[1:] != word[:-1]))[: len(other)])
    times = np.diff(np.append(first, len(other)))
    ptr = np.searchsorted(other[first], np.arange(rows + 1)).astype(np.int32)
    lists = [pa.ListArray.from_arrays(pa.array(ptr), pa.array(x)) for x in (word[first].view(np.int64), times.astype(np.int32))]
    cols = [pa.array(uid), b.column(0), pa.array(np.bincount(doc, minlength=rows)), pa.array(np.bincount(doc, hit, rows).astype(np.int64)), pa.array(np.bincount(doc, np.where(hit, m.base[at], 0.0), rows)), pa.array(np.bincount(doc, lm, rows)), *lists]
    word_id = np.where(hit, m.rank[at].astype(np.uint64), h)
    before_id = np.append(np.uint64(0), word_id[:-1])  # rank 0 is the end token
    deep = (u == m.contexts) | (k == m.dishes)
    pairs = before_id[deep], word_id[deep], doc[deep].astype(np.int64)
    return pa.record_batch(cols, names=["uid", "doc_id", "n_tokens", "known", "base", "lm", "words", "times"]), pairs


def score(docs: DataFrame, held_out: Column, **sizes: int) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every document; the others are learnt from.

    Documents are read twice, for the pairs of the CONTEXTS words and for all others. A reading numbers its rows as they come; the
    two are joined by doc_id and a hash of the text, so it doesn't matter if rows are dealt otherwise the second time.
    """
    spark, learn = docs.sparkSession, docs.where(~held_out)
    model, rare = train(learn, **sizes)
    n, v = (model.n, model.v) if model else (0, 0)
    floor = float(np.log10(n + 0.1 * (v + 1)))
    shared = spark.sparkContext.broadcast(model)
    buckets = max(32, n // BUCKET // 3), max(64, n // BUCKET)
    of_doc = to_arrow_type(docs.schema["doc_id"].dataType)
    kind, key = docs.schema["doc_id"].dataType.simpleString(), run_key()

    def read(own: bool):
        def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            m = shared.value
            start, held, kept, below = 0, [], 0, None
            fields = {"uid": pa.int64(), "bucket": pa.int64(), "learn": pa.bool_(), "far": pa.list_(pa.int64()), "blob": pa.binary()}
            if not own:
                fields = {"docs": pa.list_(pa.struct([("uid", pa.int64()), ("doc_id", of_doc), ("th", pa.int64())])), **fields}
            if own:
                fields = {"uid": pa.int64(), "doc_id": of_doc, "th": pa.int64(), "n_tokens": pa.int64(), "known": pa.int64(), "base": pa.float64(), "lm": pa.float64(), "words": pa.list_(pa.int64()), "times": pa.list_(pa.int32()), **fields}

            def batch(count: int, **given: pa.Array) -> pa.RecordBatch:
                return pa.record_batch([given.get(x, pa.nulls(count, y)) for x, y in fields.items()], names=list(fields))

            def flush() -> Iterator[pa.RecordBatch]:
                u, k, doc, learns = (np.concatenate(x) for x in zip(*held, strict=True))
                if own:
                    far = list(zip(*_far(u, k, m, buckets), strict=True))
                    if far:
                        yield batch(len(far[0]), bucket=pa.array(far[0], pa.int64()), far=pa.array(far[1], pa.list_(pa.int64())))
                on = (u < m.contexts) == own
                got = list(zip(*_dealt(u[on], k[on], doc[on], learns[on], m.contexts, buckets, len(m.known)), strict=True))
                if got:
                    yield batch(len(got[0]), uid=pa.array([start] * len(got[0])), bucket=pa.array(got[0], pa.int64()), learn=pa.array(got[1]), blob=pa.array(got[2], pa.binary()))

            for b in batches(it, "text"):
                uid = np.asarray(b.column(4))
                below = np.iinfo(np.int64).min + int(uid[0]) if below is None else below
                out, (u, k, doc) = _parts(m, b, uid, key)
                if own:
                    yield batch(b.num_rows, th=b.column(3), **dict(zip(out.schema.names, out.columns, strict=True)))
                else:  # numbers below 0 are of this reading
                    uid = np.arange(b.num_rows) + below
                    below += b.num_rows
                    rows = pa.StructArray.from_arrays([pa.array(uid), b.column(0), b.column(3)], names=["uid", "doc_id", "th"])
                    yield batch(1, bucket=pa.array([buckets[0] + int(b.column(4)[0].as_py()) % buckets[1]]), docs=pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows))
                learns = np.asarray(b.column(2)).astype(bool)
                start = start if held else int(uid[0])
                held.append((u, k, uid[doc] - start, learns[doc]))
                kept += len(u)
                if kept > HELD or uid[-1] - start > 1 << 22:
                    yield from flush()
                    held, kept = [], 0
            if held:
                yield from flush()

        return run

    if model is None:
        spaced = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\t-\r]+")), F.lit(0)) + 1
        zero = F.lit(0).cast("long")
        return docs.select("doc_id", held_out.alias("held_out"), spaced.cast("long").alias("n_tokens"), zero.alias("n_known"), zero.alias("train_tokens"), F.lit(0.0).alias("base_score"), F.lit(0.0).alias("score"))
    source, blob = docs.select("doc_id", "text", F.coalesce(~held_out, F.lit(False)).alias("learns"), F.xxhash64("text").alias("th"), F.monotonically_increasing_id().alias("uid")), "bucket long, learn boolean, far array<long>, blob binary"
    made = cut(source.mapInArrow(read(True), f"uid long, doc_id {kind}, th long, n_tokens long, known long, base double, lm double, words array<long>, times array<int>, {blob}"))
    rest = source.mapInArrow(read(False), f"docs array<struct<uid: long, doc_id: {kind}, th: long>>, uid long, {blob}").select("bucket", "uid", "learn", "blob", "docs")
    parts = made.where("bucket is null")
    gains, others = _gains(made.where("blob is not null").select("bucket", "uid", "learn", "blob"), rest, made.where("far is not null"), rare, shared, model.contexts, buckets[0], 3)
    words = parts.select("uid", F.explode(F.arrays_zip("words", "times")).alias("x")).select("uid", F.col("x.words").alias("h"), F.col("x.times").alias("m"))
    met = words.join(rare, "h", "left").select("uid", "m", F.coalesce("c", F.lit(0)).alias("c"), F.coalesce("own", F.lit(model.unseen)).alias("own"))
    sums = met.groupBy("uid").agg(F.sum(F.when(F.col("c") > 0, F.col("m")).otherwise(0)).alias("k2"), F.sum(F.col("m") * F.log10(F.col("c") + 0.1)).alias("b2"), F.sum(F.col("m") * F.col("own")).alias("l2"))
    both = parts.select("uid", "doc_id", "th", "n_tokens", "known", "base", "lm").join(sums, "uid", "left").join(gains, "uid", "left")
    others = others.select(F.col("doc_id").alias("other"), F.col("th").alias("other_th"), F.col("gain").alias("more"))
    both = both.join(others, F.col("doc_id").eqNullSafe(F.col("other")) & (F.col("th") == F.col("other_th")), "left")
    none, zero = F.lit(0.0), F.lit(0).cast("long")
    return both.select(
        "doc_id", held_out.alias("held_out"), "n_tokens", (F.col("known") + F.coalesce("k2", zero)).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("b2", none) - F.col("n_tokens") * floor).alias("base_score"), (F.col("lm") + F.coalesce("l2", none) + F.coalesce("gain", none) + F.coalesce("more", none)).alias("score"),
    )
