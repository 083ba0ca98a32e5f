"""Texts cut where no token of either tokenizer can cross, and the tokens of such segments remembered.

A single space between two characters that are no white space begins a new piece of a byte-level tokenizer's pattern, and
no entry of a word-piece vocabulary whose inner characters are never the space mark can cross it. So segments cut before
such spaces are encoded by themselves, each distinct one once, and a text's tokens are those of its segments.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from bidspark.llm.words import text_buffer

#: Distinct segments that a Python worker remembers; beyond them those met once go, then the rarest.
MEMORY = 500_000
JOINED = 4096  # bytes of segments that go through a tokenizer as one text


def _closes(last: np.ndarray, lead: np.ndarray) -> np.ndarray:
    """Whether a character ends with `last` that is surely no white space: ASCII, or of two bytes, the first being `lead`."""
    return (last > 0x20) & (last < 0x7F) | (last >= 0x80) & (last < 0xC0) & (lead >= 0xC3) & (lead < 0xE0)


def _opens(first: np.ndarray) -> np.ndarray:
    """Whether `first` begins a character that is surely no white space."""
    return (first > 0x20) & (first < 0x7F) | (first >= 0xC3) & ((first < 0xE1) | (first > 0xE3))


def _parting(data: np.ndarray) -> np.ndarray:
    """Positions of spaces whose neighbours are surely not white space."""
    at = np.flatnonzero(data[1:-1] == 0x20) + 1 if len(data) > 2 else np.zeros(0, np.int64)
    return at[_closes(data[at - 1], data[np.maximum(at - 2, 0)]) & _opens(data[at + 1])]


def segments(col: pa.Array, lead: bool = False, whole: np.ndarray | None = None) -> tuple[pa.Array, np.ndarray]:
    """(binary array of segments, first segment of each row (n+1)); a segment that isn't its row's first begins with a space.

    lead: every text that isn't empty gets one space before it. whole: rows that stay one segment. Null and empty texts
    have no segment.
    """
    data, off = text_buffer(col)
    size = np.diff(off)
    full = size > 0
    if lead:
        put = off[:-1][full] + np.arange(int(full.sum()))
        out = np.full(len(data) + len(put), 0x20, np.uint8)
        keep = np.ones(len(out), bool)
        keep[put] = False
        out[keep] = data
        data, off = out, np.append(0, np.cumsum(size + full))
    begins = np.zeros(len(data) + 1, bool)
    at = _parting(data)
    row = np.searchsorted(off, at, "right") - 1
    inner = (at > off[row]) & (at < off[row + 1] - 1)
    if whole is not None:
        inner &= ~whole[row]
    begins[at[inner]] = True
    begins[off[:-1][full]] = True
    start = np.flatnonzero(begins[:-1])
    edges = np.append(start, len(data)).astype(np.int32)
    found = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(edges), pa.py_buffer(np.ascontiguousarray(data))])
    return found, np.searchsorted(start, off)


def joinable(words: pa.Array) -> np.ndarray:
    """Segments that begin and end so that another such segment may stand before and after them in one text."""
    data, edge = _bytes(words)
    start, end = edge[:-1], edge[1:]
    padded = np.concatenate([data, np.zeros(2, np.uint8)])
    after, last, lead = padded[start + 1], padded[end - 1], padded[np.maximum(end - 2, 0)]
    begins = (padded[start] == 0x20) & (end > start + 1) & _opens(after)
    return begins & _closes(last, lead)


def _bytes(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    edge = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    raw = words.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data[edge[0] : edge[-1]], edge - edge[0]


def texts_of(words: pa.Array, joined: np.ndarray) -> tuple[list[str], np.ndarray]:
    """(texts that hold all segments one after another, the order in which they do so): `joined` ones share texts."""
    order = np.append(np.flatnonzero(joined), np.flatnonzero(~joined))
    data, edge = _bytes(words.take(pa.array(order)))
    n = int(joined.sum())
    new = np.ones(len(words), bool)
    new[1:n] = np.diff(edge[1 : n + 1] // JOINED) > 0 if n > 1 else True
    cuts = np.append(edge[:-1][new], edge[-1]).tolist()
    raw = data.tobytes()
    return [raw[a:b].decode() for a, b in zip(cuts, cuts[1:], strict=False)], order


class Memory:
    """Slots of distinct segments. `learn(words)` is given the new ones and returns the order in which it holds them;
    `keep(slots)` drops all others."""

    def __init__(self, learn: Callable[[pa.Array], np.ndarray], keep: Callable[[np.ndarray], None]):
        self.learn, self.keep = learn, keep
        self.words, self.hits = pa.array([], pa.binary()), np.zeros(0, np.int64)

    def tidy(self) -> None:
        """Between batches: forget segments met once, and the rarest, once there are too many."""
        if len(self.words) > MEMORY:
            kept = np.flatnonzero(self.hits > 1)
            if len(kept) > MEMORY // 2:
                kept = np.sort(np.argsort(-self.hits, kind="stable")[: MEMORY // 2])
            self.words, self.hits = self.words.take(pa.array(kept)), self.hits[kept]
            self.keep(kept)

    def recall(self, found: pa.Array) -> np.ndarray:
        """Slot of each segment."""
        coded = found.dictionary_encode()
        distinct = coded.dictionary
        at = pc.index_in(distinct, value_set=self.words)
        slot = np.asarray(pc.fill_null(at, -1)).astype(np.int64)
        new = np.flatnonzero(slot < 0)
        if len(new):
            words = distinct.take(pa.array(new))
            order = self.learn(words)
            slot[new[order]] = len(self.words) + np.arange(len(new))
            self.words = pa.concat_arrays([self.words, words.take(pa.array(order))])
            self.hits = np.append(self.hits, np.zeros(len(new), np.int64))
        indices = np.asarray(coded.indices)
        self.hits[slot] += np.bincount(indices, minlength=len(slot))
        return slot[indices]


class Lists:
    """Integer lists in one growing flat array; list i stands at ptr[i] to ptr[i + 1]."""

    def __init__(self, kind: type = np.int64):
        self.flat, self.ptr, self.n, self.m = np.zeros(1 << 12, kind), np.zeros(1 << 10, np.int64), 0, 0

    def add(self, flat: np.ndarray, size: np.ndarray) -> None:
        for name, need in (("flat", self.m + len(flat)), ("ptr", self.n + len(size) + 1)):
            have = getattr(self, name)
            if need > len(have):
                setattr(self, name, np.concatenate([have, np.zeros(max(need - len(have), len(have)), have.dtype)]))
        self.flat[self.m : self.m + len(flat)] = flat
        self.ptr[self.n + 1 : self.n + 1 + len(size)] = self.m + np.cumsum(size)
        self.n, self.m = self.n + len(size), self.m + len(flat)

    def size(self) -> np.ndarray:
        return np.diff(self.ptr[: self.n + 1])

    def take(self, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lists k in one array, and their sizes."""
        size = self.ptr[k + 1] - self.ptr[k]
        return self.flat[runs(self.ptr[k], size)], size

    def keep(self, k: np.ndarray) -> None:
        flat, size = self.take(k)
        self.n = self.m = 0
        self.add(flat, size)


def runs(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... (size[0] of them), then from start[1] on."""
    end = np.cumsum(size)
    return np.repeat(start - (end - size), size) + np.arange(end[-1] if len(end) else 0)


def flattened(lists: list[list[int]]) -> np.ndarray:
    return np.fromiter(chain.from_iterable(lists), np.int64, sum(map(len, lists)))


def dealt(ids: np.ndarray, width: np.ndarray, size: np.ndarray) -> np.ndarray:
    """How many of the tokens `ids` each segment has: width: bytes of each token, size: of each segment."""
    return np.diff(np.append(0, np.searchsorted(np.cumsum(width), np.cumsum(size), "right")))
