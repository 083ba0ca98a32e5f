"""Collocations: phrases of two or three words whose parts occur together more often than by themselves.

Texts are cut into shards of bounded size, each task its own. A shard is one sequence of word ids, with a mark between
pieces, under a bidirectional FM-index of the depth that is needed: `WordIndex` keeps the order of the places by the word that
stands there with the words before them (one BWT), and the order of the places by the word and the one before, with the words after them (the
BWT of the reversed text). An interval of the first is extended to the left by every word before it, which gives
the interval in the second, which is extended to the right; all intervals at once. Counts of n-grams are summed across shards.

A phrase of three words can only be a candidate if both its pairs occur often enough. So words and pairs are counted first; the pairs
that reach the least count are marked in a filter of PLACES bits, which is what the tasks get, whatever their number, and a second
index of each shard holds only runs of words that the filter lets through. It may let others through; their counts are exact all the same.

A null text is empty, a null lang is `und`. Repeated rows and ids count again, empty texts and tables have no phrases, other columns are
not read. A piece is never cut: a very long text is in one shard, whatever its size. Equal scores: the higher count, then the phrase in
the order of its UTF-8 bytes; of equal cuts the shortest first part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bidspark.llm.common import batches, cut, discard, release, small_batches
from bidspark.llm.words import mix, text_buffer

SHARD = 5 << 20  # bytes of text of a shard, but for one longer text
PLACES = 1 << 27  # bits of the filter of frequent pairs: 16 MB
NO_LANG = "und"
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
#: what a byte is: 0 parts pieces, 1 parts words, 2 belongs to a word
KIND = np.full(256, 2, np.uint8)
KIND[[0x20, 0x09]] = 1
KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = 0


def words_of(col: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(lower-cased words, row of each, number of each one's piece), in order; numbers rise from piece to piece."""
    data, off = text_buffer(col)
    n = len(data)
    kind = KIND[data]
    word = kind == 2
    fresh = np.zeros(n + 1, bool)
    fresh[off] = True
    begins = word.copy()
    begins[1:] &= ~word[:-1] | fresh[1:n]
    start = np.flatnonzero(begins)
    kept = np.append(0, np.cumsum(word))
    edges = np.append(kept[start], kept[-1]).astype(np.int32)
    row = np.searchsorted(off, start, "right") - 1
    piece = np.cumsum(kind == 0)[start] + row
    found = pa.Array.from_buffers(pa.string(), len(start), [None, pa.py_buffer(edges), pa.py_buffer(LOWER[data[word]])])
    return found, row, piece


def _sorted_runs(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order of the places by `keys`, first of each run of equal keys, its length); small keys are packed, for a faster sort."""
    n = len(keys[0])
    bits = [int(k.max(initial=0)).bit_length() for k in keys]
    wide = max(n - 1, 0).bit_length()
    if sum(bits) + wide <= 63:
        packed = np.zeros(n, np.int64)
        for k, b in zip(keys, bits, strict=True):
            packed = packed << b | k
        packed = np.sort(packed << wide | np.arange(n))
        order, packed = packed & (1 << wide) - 1, packed >> wide
        new = packed[1:] != packed[:-1]
    else:
        order = np.lexsort(keys[::-1])
        new = np.zeros(max(n - 1, 0), bool)
        for k in keys:
            new |= k[order][1:] != k[order][:-1]
    first = np.flatnonzero(np.append(True, new)) if n else np.zeros(0, np.int64)
    return order, first, np.diff(np.append(first, n))


class WordIndex:
    """A bidirectional FM-index, two words deep, of a sequence of word ids from 1 on; 0 stands between pieces and at both ends."""

    def __init__(self, text: np.ndarray):
        self.text = text
        self.place = np.flatnonzero(text)

    def single(self) -> tuple[np.ndarray, np.ndarray]:
        """(word, count): the intervals of single words, which lie alike in both orders."""
        order, first, count = _sorted_runs(self.text[self.place])
        self.suffix = self.place[order]
        return self.text[self.suffix[first]], count

    def left(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(word before, word, count, start in the reversed order) of every single word's interval extended to the left.

        The symbols before an interval's places, sorted, are how the reversed order goes on inside the same interval; so an
        extension begins there where the smaller symbols end.
        """
        bwt = self.text[self.place - 1]
        order, first, count = _sorted_runs(self.text[self.place], bwt)
        self.prefix = self.place[order]
        end = self.prefix[first]
        inside = self.text[end - 1] > 0
        return self.text[end[inside] - 1], self.text[end[inside]], count[inside], first[inside]

    def right(self, start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(interval's number, word after, count) of intervals of the reversed order, extended to the right."""
        end = np.cumsum(count)
        at = np.repeat(start - (end - count), count) + np.arange(end[-1] if len(end) else 0)
        owner = np.repeat(np.arange(len(start)), count)
        after = self.text[self.prefix[at] + 1]
        order, first, many = _sorted_runs(owner, after)
        lead = order[first]
        inside = after[lead] > 0
        return owner[lead][inside], after[lead][inside], many[inside]


def _sequence(symbols: np.ndarray, piece: np.ndarray) -> np.ndarray:
    """Symbols with 0 between pieces and at both ends."""
    at = np.arange(len(symbols)) + 1
    at[1:] += np.cumsum(piece[1:] != piece[:-1])
    text = np.zeros((int(at[-1]) if len(at) else 0) + 2, np.int64)
    text[at] = symbols
    return text


class Shard:
    """Words of some texts: symbol (from 1) and piece of each; for each symbol its word, and its word with the language."""

    def __init__(self, langs: list[str], words: list[pa.Array], lang: list[np.ndarray], piece: list[np.ndarray]):
        self.langs, lang = langs, np.concatenate(lang)
        coded = pa.concat_arrays(words).dictionary_encode()
        n = len(coded.dictionary)
        distinct, inverse = np.unique(lang * n + np.asarray(coded.indices), return_inverse=True)
        self.symbols, self.piece = inverse + 1, np.concatenate(piece)
        self.words = pa.concat_arrays([pa.array([""]), coded.dictionary.take(pa.array(distinct % n if n else distinct))])
        self.lang = np.append(0, distinct // n if n else distinct)
        self.last = pc.binary_join_element_wise(self.words, pa.array(langs).take(pa.array(self.lang)) if langs else pa.array([""]), "\t")
        self.totals = np.bincount(lang, minlength=len(langs))

    def hashes(self) -> np.ndarray:
        seeds = [xxhash.xxh3_64_intdigest(x.encode()) for x in self.langs] or [0]
        words = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in self.words.to_pylist()), np.uint64, len(self.words))
        return mix(words ^ np.array(seeds, np.uint64)[self.lang])


def _pair_places(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Places in the filter of pairs of word hashes."""
    return (mix(first * np.uint64(0x9E3779B97F4A7C15) + second) % np.uint64(PLACES)).astype(np.int64)


def _short(shard: Shard) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """(key, count) of all words of each language, single words and pairs; a key is a phrase, a tab and the language."""
    yield pa.array(["\t" + x for x in shard.langs]), shard.totals
    index = WordIndex(_sequence(shard.symbols, shard.piece))
    word, count = index.single()
    yield shard.last.take(pa.array(word)), count
    first, second, count, _ = index.left()
    yield pc.binary_join_element_wise(shard.words.take(pa.array(first)), shard.last.take(pa.array(second)), " "), count


def _long(shard: Shard, marks: np.ndarray) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """(key, count) of phrases of three words whose pairs are marked."""
    if not len(shard.symbols):
        return
    h = shard.hashes()[shard.symbols]
    at = _pair_places(h[:-1], h[1:])
    linked = (shard.piece[1:] == shard.piece[:-1]) & (marks[at >> 3] >> (7 - (at & 7)) & 1).astype(bool)
    run = np.append(0, np.cumsum(~linked))
    kept = np.bincount(run)[run] > 2
    index = WordIndex(_sequence(shard.symbols[kept], run[kept]))
    first, second, count, start = index.left()
    owner, third, count = index.right(start, count)
    words = [shard.words.take(pa.array(x[owner])) for x in (first, second)]
    yield pc.binary_join_element_wise(*words, shard.last.take(pa.array(third)), " "), count


def _shards(it: Iterator[pa.RecordBatch]) -> Iterator[Shard]:
    """Shards of the texts (column 1) with their languages (column 0)."""
    held: tuple[list, list, list] = ([], [], [])
    codes: dict[str, int] = {}
    size = last = 0
    for batch in batches(it, "text", 1 << 20):
        words, row, piece = words_of(batch.column(1))
        lang = np.fromiter((codes.setdefault(x, len(codes)) for x in batch.column(0).to_pylist()), np.int64, batch.num_rows)
        for x, y in zip(held, (words, lang[row], piece + last), strict=True):
            x.append(y)
        last = int(held[2][-1][-1]) + 1 if len(piece) else last
        size += pc.sum(pc.binary_length(batch.column(1))).as_py() or 0
        if size >= SHARD:
            yield Shard(list(codes), *held)
            held, codes, size, last = ([], [], []), {}, 0, 0
    if held[0]:
        yield Shard(list(codes), *held)


def _counted(docs: DataFrame, count: Callable[[Shard], Iterator[tuple[pa.Array, np.ndarray]]]) -> DataFrame:
    """(key string, f long): counts of every shard, summed."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in _shards(it):
            for keys, n in count(shard):
                for k in range(0, len(keys), 1 << 15):
                    yield pa.record_batch([keys.slice(k, 1 << 15), pa.array(n[k : k + (1 << 15)], pa.int64())], names=["key", "f"])
            del shard
            release()  # before the next one is gathered

    src = small_batches(docs).select(F.coalesce("lang", F.lit(NO_LANG)).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    return src.mapInArrow(run, "key string, f long").groupBy("key").agg(F.sum("f").alias("f"))


def _parts(rows: DataFrame) -> DataFrame:
    """(lang, phrase, f) of (key, f)."""
    return rows.select(F.expr("substring(key, locate('\t', key) + 1)").alias("lang"), F.substring_index("key", "\t", 1).alias("phrase"), "f")


def pair_filter(pairs: DataFrame) -> np.ndarray:
    """PLACES bits, those of the (lang, phrase) pairs set: at most PLACES / 64 rows come to the driver."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            hashes = []
            for lang, phrase in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                seed = xxhash.xxh3_64_intdigest(lang.encode())
                hashes += [xxhash.xxh3_64_intdigest(w) ^ seed for w in phrase.split(" ")]
            h = mix(np.array(hashes, np.uint64)).reshape(-1, 2)
            at = _pair_places(h[:, 0], h[:, 1])
            yield pa.record_batch([pa.array(at >> 6), pa.array(np.left_shift(np.int64(1), at & 63))], names=["at", "bit"])

    got = small_batches(pairs.select("lang", "phrase")).mapInArrow(run, "at long, bit long").groupBy("at").agg(F.expr("bit_or(bit)").alias("bits")).toArrow()
    words = np.zeros(PLACES // 64, np.int64)
    words[np.asarray(got.column("at"))] = np.asarray(got.column("bits"))
    return np.packbits(np.unpackbits(words.view(np.uint8), bitorder="little"))


def _times(*factors: Column) -> Column:
    """An exact product of counts."""
    out = factors[0].cast("decimal(38,0)")
    for f in factors[1:]:
        out = (out * f.cast("decimal(20,0)")).cast("decimal(38,0)")
    return out


def phrases(docs: DataFrame, least: int = 10, top: int = 2000, share: int = 50, scale: int = 1_000_000, salts: int = 16) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): of each language the `top` best phrases of two or three words.

    a: how often the phrase occurs, `least` times at least; cut in two, its parts occur l and r times, and it scores
    floor(scale * a * a / (l * r)), of two cuts the lower; n: words of the language. Phrases inside a longer candidate that
    occurs in `share` percent of the cases at least are dropped.
    """
    spark = docs.sparkSession
    known = cut(_parts(_counted(docs, _short)).withColumn("size", F.when(F.col("phrase") == "", 0).otherwise(F.size(F.split("phrase", " ")))).where((F.col("f") >= least) | (F.col("size") == 0)))
    pairs = known.where("size = 2")
    marks = spark.sparkContext.broadcast(pair_filter(pairs))
    triples = cut(_parts(_counted(docs, lambda s: _long(s, marks.value))).where(F.col("f") >= least))

    word = lambda *k: F.concat_ws(" ", *(F.element_at("w", i) for i in k))
    one = pairs.select("lang", "phrase", "f", F.split("phrase", " ").alias("w"))
    halves = lambda k, left, right: F.struct(F.lit(k).alias("k"), left.alias("left"), right.alias("right"))
    three = triples.select("lang", "phrase", "f", F.split("phrase", " ").alias("w"))
    cuts = one.select("lang", "phrase", "f", F.array(halves(1, word(1), word(2))).alias("c"))
    cuts = cuts.union(three.select("lang", "phrase", "f", F.array(halves(1, word(1), word(2, 3)), halves(2, word(1, 2), word(3))).alias("c")))
    cuts = cuts.select("lang", "phrase", "f", F.explode("c").alias("c")).select("lang", "phrase", "f", "c.*")
    part = lambda name, n: known.where("size > 0").select("lang", F.col("phrase").alias(name), F.col("f").alias(n))
    scored = cuts.join(part("left", "l"), ["lang", "left"]).join(part("right", "r"), ["lang", "right"])
    scored = scored.withColumn("over", _times(F.lit(scale), F.col("f"), F.col("f"))).withColumn("under", _times(F.col("l"), F.col("r")))
    scored = scored.withColumn("score", F.expr("over div under"))
    best = scored.groupBy("lang", "phrase", "f").agg(F.min(F.struct("score", "k", "l", "r")).alias("b"))
    longer = three.select("lang", F.explode(F.array(word(1, 2), word(2, 3))).alias("phrase"), F.col("f").alias("longer"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    left = best.join(longer, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("f") * share))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    rows = left.select("lang", "phrase", F.col("f").alias("a"), "b.l", "b.r", "b.score", F.pmod(F.xxhash64("phrase"), F.lit(salts)).alias("salt"))
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    out = rows.join(known.where("size = 0").select("lang", F.col("f").alias("n")), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    final = cut(out)
    discard(known, triples)
    marks.unpersist()
    return final
