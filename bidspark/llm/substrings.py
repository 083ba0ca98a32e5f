"""Substring dedup: words inside passages that an earlier document already has.

A window is WINDOW consecutive words of one document; a word goes if a window that covers it also starts in a
document with a smaller doc_id. Windows are judged on the input.

Which passages can repeat is found from anchors: of a window's grams of GRAM words the one of least hash. Equal
windows have equal anchors, and neighbouring windows mostly share theirs, so a document has about one anchor for
five words. Anchors that stand in one document only are dropped. Around each other anchor stands a segment, the
words of all windows that share it. Equal segments need no look at their words: all but the first document's
go. Where an anchor has different segments, suffix automata decide: the segments are dealt by anchor
(shards of the reference text that belong together), each automaton holds the segments of smaller doc_ids, and a
document's segments are streamed through it for matching statistics; where the match is WINDOW words long or
longer, the window goes. The shards are dealt, not broadcast: together they grow with the corpus. An anchor with
more than CROWD different segments has its windows compared one by one by their hashes in Spark instead,
which has no bound on a group.

Anchors with very many occurrences are salted by document; each salt finds its first document, and the first
of all follows from those.

Null and empty texts have no words and stay. Rows without a doc_id are neither judged nor a source. Rows that
share a doc_id are judged each by itself, told apart by 27 bits of a digest of their texts. A text of any length is a batch of its own. Words are `[^\\x20\\t-\\r]+`, unchanged; 62-bit
hashes by two polynomials with a key of the run stand for them. Segments and windows count as equal if both their own hash and
that of their anchor, 64 bits each, are. Of equal windows of one document none is a source for the others; columns beside doc_id and
text are only passed on.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bidspark.llm.common import batches, cut, discard, free_names, small_batches, split_by_ids
from bidspark.llm.words import U, mix, ngrams, run_key, split

WINDOW, GRAM, CROWD, HOT = 13, 5, 1000, 1000
ADDED = ("__kept", "__n_words", "__n_removed")


def anchors_of(h: np.ndarray, doc: np.ndarray, window: int = WINDOW, gram: int = GRAM):
    """Runs of windows that share their least gram: (gram hash, hash of the run's words, row, first window, windows)."""
    g, at = ngrams(h, doc, gram)
    per = window - gram + 1
    if len(g) < per:
        e = np.zeros(0, np.int64)
        return g[:0], g[:0], e, e, e
    view = np.lib.stride_tricks.sliding_window_view(g, per)
    ok = np.flatnonzero(at[per - 1 :] - at[: len(at) - per + 1] == per - 1)
    ok = ok[doc[at[ok]] == doc[at[ok + per - 1]]]
    where = at[ok + view[ok].argmin(1)]
    start = at[ok]  # first word of each window
    new = np.append(True, (where[1:] != where[:-1]) | (start[1:] != start[:-1] + 1) | (doc[start[1:]] != doc[start[:-1]]))[: len(start)]
    head = np.flatnonzero(new)
    n = np.diff(np.append(head, len(start)))
    first = start[head]
    # hash of words first .. first + n + window - 2, from whole windows: first and last overlap or touch (n <= window)
    win, pos = ngrams(h, doc, window)
    a = win[np.searchsorted(pos, first)]
    b = win[np.searchsorted(pos, first + n - 1)]
    gram_at = np.searchsorted(at, where[head])
    return g[gram_at], mix(a * U(0xD6E8FEB86659FD93) + b * U(0x9E3779B97F4A7C15) + n.astype(np.uint64)), doc[first].astype(np.int64), first, n


class SuffixAutomaton:
    """Suffix automaton of several word sequences; words are integers."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.len = [0]

    def _state(self, length: int, link: int, out: dict[int, int]) -> int:
        self.next.append(out)
        self.link.append(link)
        self.len.append(length)
        return len(self.len) - 1

    def add(self, words: list[int]) -> None:
        last = 0
        for x in words:
            last = self._extend(last, x)

    def _split(self, p: int, q: int, x: int) -> int:
        """State of the longest word sequence of p followed by x, when q holds longer ones too."""
        twin = self._state(self.len[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = twin
        while p >= 0 and self.next[p].get(x) == q:
            self.next[p][x] = twin
            p = self.link[p]
        return twin

    def _extend(self, last: int, x: int) -> int:
        q = self.next[last].get(x)
        if q is not None:  # this sequence is known already
            return q if self.len[q] == self.len[last] + 1 else self._split(last, q, x)
        new, p = self._state(self.len[last] + 1, 0, {}), last
        while p >= 0 and x not in self.next[p]:
            self.next[p][x] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][x]
            self.link[new] = q if self.len[q] == self.len[p] + 1 else self._split(p, q, x)
        return new

    def matches(self, words: list[int]) -> list[int]:
        """Matching statistics: length of the longest known sequence that ends at each word."""
        state = length = 0
        out = []
        for x in words:
            while state and x not in self.next[state]:
                state = self.link[state]
                length = self.len[state]
            if x in self.next[state]:
                state = self.next[state][x]
                length += 1
            else:
                length = 0
            out.append(length)
        return out


def _tag(text: pa.Scalar) -> int:
    return int.from_bytes(hashlib.sha256(text.as_buffer()).digest()[:4], "big") >> 5 << 36 if text.is_valid else 0


def _occurrences(docs: DataFrame, repeats: bool, key: int) -> DataFrame:
    """(a, s, doc, pos): anchor, segment hash, document, and first window << 4 | windows; tagged by text if ids repeat."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it, "text"):
            w = split(b.column(1), salt=key)
            a, s, row, first, n = anchors_of(w.hash, w.doc)
            pos = (first - w.ptr[row]) << 4 | n
            if repeats:
                pos |= np.array([_tag(x) for x in b.column(1)], np.int64)[row]
            yield pa.record_batch([pa.array(a.view(np.int64)), pa.array(s.view(np.int64)), pa.array(np.asarray(b.column(0))[row]), pa.array(pos)], names=["a", "s", "doc", "pos"])

    return small_batches(docs).where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "a long, s long, doc long, pos long")


def _firsts(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (a, s, doc, pos), with lo: marks the rows of each (a, s) that belong to its first document."""
    a0 = s0 = d0 = None
    for b in it:
        if not b.num_rows:
            continue
        a, s, doc = (np.asarray(b.column(k)) for k in range(3))
        new = np.append(True, (a[1:] != a[:-1]) | (s[1:] != s[:-1]))
        new[0] = (a[0], s[0]) != (a0, s0)
        at = np.maximum.accumulate(np.where(new, np.arange(len(a)), -1))
        first = np.where(at >= 0, doc[at], d0 if d0 is not None else 0)
        a0, s0, d0 = a[-1], s[-1], first[-1]
        yield pa.record_batch([*b.columns, pa.array(doc == first)], names=[*b.schema.names, "lead"])


def _segments(it: Iterator[pa.RecordBatch], key: int) -> Iterator[pa.RecordBatch]:
    """Words of the listed segments; of crowded anchors each window's hash instead (words null, the hash in lo)."""
    for b in batches(it, "text", 1 << 20):
        w = split(b.column(1), salt=key)
        win, at = ngrams(w.hash, w.doc, WINDOW)
        tags = None
        out: list[tuple] = []
        ids = b.column(0).to_pylist()
        for row, marks in enumerate(b.column(2).to_pylist()):
            for m in marks:
                pos = m["pos"]
                if pos >> 36:
                    tags = tags or {}
                    if tags.setdefault(row, _tag(b.column(1)[row])) != pos >> 36 << 36:
                        continue
                    pos &= (1 << 36) - 1
                first, n = w.ptr[row] + (pos >> 4), pos & 15
                if not m["crowded"]:
                    out.append((m["a"], ids[row], m["pos"], w.hash[first : first + n + WINDOW - 1].view(np.int64), m["lo"]))
                else:
                    k = np.searchsorted(at, first)
                    out += [(m["a"], ids[row], (m["pos"] >> 4) + j << 4 | 1, None, h) for j, h in enumerate(win[k : k + n].view(np.int64).tolist())]
        cols = list(zip(*out, strict=True)) if out else [[]] * 5
        yield pa.record_batch([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.list_(pa.int64())), pa.array(cols[4], pa.int64())], names=["a", "doc", "pos", "words", "lo"])


def _streamed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments sorted by (a, doc): windows of each that an earlier document's segments hold."""
    anchor = doc = None
    machine, waiting = SuffixAutomaton(), []
    for b in it:
        docs, places = [], []
        for a, d, pos, words, lo in zip(*(b.column(x).to_pylist() for x in ("a", "doc", "pos", "words", "lo")), strict=True):
            if a != anchor:
                anchor, doc, machine, waiting = a, d, SuffixAutomaton(), []
            elif d != doc:
                for x in waiting:
                    machine.add(x)
                doc, waiting = d, []
            if d > lo:
                for k, m in enumerate(machine.matches(words)):
                    if m >= WINDOW:
                        docs.append(d)
                        places.append((pos >> 4) + k - WINDOW + 1 << 4 | 1)
            waiting.append(words)
        yield pa.record_batch([pa.array(docs, pa.int64()), pa.array(places, pa.int64())], names=["doc", "pos"])


def repeated_windows(docs: DataFrame, crowd: int = CROWD, hot_share: int = HOT) -> DataFrame:
    """(doc, pos): runs of windows (first << 4 | number) that also start in a document with a smaller doc_id."""
    ids = docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1")
    repeats, key = not ids.isEmpty(), run_key()
    seen = _occurrences(docs, repeats, key).groupBy("a").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi"), F.count("*").alias("n"))
    known = cut(seen.where("lo < hi").select("a", "lo", "n"))
    # at most 10,000 anchors can have more than a ten-thousandth of all occurrences
    share = (known.agg(F.sum("n")).first()[0] or 0) // 10_000 + hot_share
    hot = cut(known.where(F.col("n") > share).select("a", F.ceil(F.col("n") / share).cast("int").alias("k")))
    salted = _occurrences(docs, repeats, key).join(F.broadcast(hot), "a", "left").withColumn("salt", F.pmod(F.xxhash64("doc"), F.coalesce("k", F.lit(1))).cast("int")).drop("k")
    sides = known.join(F.broadcast(hot), "a", "left").select("a", "lo", F.coalesce("k", F.lit(1)).alias("k"))
    sides = sides.select("a", "lo", "k", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("salt"))
    met = salted.repartition("a", "salt").join(sides.hint("merge"), ["a", "salt"]).select("a", "s", "doc", "pos", "lo", "k").sortWithinPartitions("a", "s", "doc", "pos")
    rows = cut(met.mapInArrow(_firsts, "a long, s long, doc long, pos long, lo long, k int, lead boolean"))
    # the first of all salts; with one salt it is known already
    lead = rows.where("lead and k > 1").groupBy("a", "s").agg(F.min("doc").alias("first"))
    tried = rows.where("lead and k > 1").join(lead, ["a", "s"])
    later = rows.where("not lead").select("doc", "pos").unionByName(tried.where("doc > first").select("doc", "pos"))
    heads = cut(rows.where("lead and k = 1").select("a", "doc", "pos", "lo").unionByName(tried.where("doc = first").select("a", "doc", "pos", "lo")))
    # anchors with different segments, some of them of later documents
    several = heads.groupBy("a").agg(F.count("*").alias("nv"), F.max("doc").alias("hi"), F.first("lo").alias("l")).where("nv > 1 and hi > l").select("a", "nv")
    checked = heads.join(several, "a").groupBy("doc").agg(F.collect_list(F.struct("a", (F.col("nv") > crowd).alias("crowded"), "pos", "lo")).alias("marks"))
    text = docs.select(F.col("doc_id").cast("long").alias("doc"), "text").join(checked, "doc")
    parts = cut(text.select("doc", "text", "marks").mapInArrow(lambda it: _segments(it, key), "a long, doc long, pos long, words array<long>, lo long"))
    found = parts.where("words is not null").repartition("a").sortWithinPartitions("a", "doc").mapInArrow(_streamed, "doc long, pos long")
    single = parts.where("words is null").select("a", F.col("lo").alias("w"), "doc", "pos")
    least = single.groupBy("a", "w").agg(F.min("doc").alias("first"))
    crowded = single.join(least, ["a", "w"]).where("doc > first").select("doc", "pos")
    out = cut(later.unionByName(found).unionByName(crowded))
    discard(known, hot, rows, heads, parts)
    return out


def _cover(it: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Adds kept (words left, joined by one space), n_words and n_removed by `names`; the last column lists the runs."""
    for b in batches(it, "text"):
        col = b.column(b.schema.get_field_index("text"))
        w = split(col)
        edge = np.zeros(len(w.hash) + 1, np.int64)
        for row, marks in enumerate(b.column(b.num_columns - 1)):
            if marks.is_valid and len(marks):
                pos = np.asarray(marks.values)
                if (pos >> 36).any():
                    pos = pos[pos >> 36 << 36 == _tag(col[row])] & ((1 << 36) - 1)
                first = w.ptr[row] + (pos >> 4)
                np.add.at(edge, first, 1)
                np.add.at(edge, first + (pos & 15) + WINDOW - 1, -1)
        gone = np.cumsum(edge[:-1]) > 0
        raw = w.data.tobytes()
        start, end, keep = w.start.tolist(), w.end.tolist(), np.flatnonzero(~gone)
        cutoff = np.searchsorted(keep, w.ptr)
        order = keep.tolist()
        kept = [b" ".join([raw[start[i] : end[i]] for i in order[x:y]]) for x, y in zip(cutoff[:-1].tolist(), cutoff[1:].tolist(), strict=True)]
        n, left = np.diff(w.ptr), np.diff(cutoff)
        yield pa.record_batch([*b.columns[:-1], pa.array(kept, pa.binary()).cast(pa.string()), pa.array(n), pa.array(n - left)], names=[*b.schema.names[:-1], *names])


def substring_dedup(docs: DataFrame, crowd: int = CROWD, hot_share: int = HOT) -> DataFrame:
    """All rows and columns of docs with __kept (string), __n_words and __n_removed (long), under names that are free.

    A name that docs already has gets one underscore more before it. Texts go to their runs only where a filter of bounded
    size says that there may be some.
    """
    spans = repeated_windows(docs, crowd, hot_share)
    *names, runs, key = free_names(docs.columns, *ADDED, "__runs", "__doc")
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    out = f"{kind}, `{names[0]}` string, `{names[1]}` long, `{names[2]}` long"
    plain, some = split_by_ids(docs, spans, "doc_id", "doc")
    plain = plain.withColumn(runs, F.lit(None).cast("array<long>"))
    lists = spans.groupBy(F.col("doc").alias(key)).agg(F.collect_list("pos").alias(runs))
    some = some.join(lists, F.col("doc_id").cast("long") == F.col(key), "left").drop(key)
    return plain.unionByName(some).mapInArrow(lambda it: _cover(it, names), out)
