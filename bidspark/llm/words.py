"""Words and word n-grams of whole Arrow batches as flat numpy arrays.

A batch's UTF-8 bytes are looked at in place: no Python string is made for a word. Word hashes are
62 bits of two polynomials modulo a prime, taken from two prefix sums over the bytes. A text needs about 60 bytes of
working memory a byte, for batches of about half a megabyte, or one longer text.
"""

from __future__ import annotations

import secrets
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
SPACE = frozenset([0x20, *range(0x09, 0x0E)])
ALNUM = frozenset([*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)])
#: Two polynomials over the field of this prime stand for a word. Where nothing compares the words' bytes afterwards, their bases and the
#: values of the bytes come from a key drawn by the driver, so nobody can write two words that have one hash.
PRIME = (1 << 31) - 1
SHORT = 1 << 20  # powers of the base that a worker keeps; longer texts have theirs made anew


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    h = h ^ (h >> U(31))
    h *= U(0xBF58476D1CE4E5B9)
    h ^= h >> U(29)
    h *= U(0x94D049BB133111EB)
    h ^= h >> U(32)
    return h


@cache
def run_key() -> int:
    """The driver's key, sent with the plans: the same for all that a driver process runs, another for each process."""
    return secrets.randbits(60) | 1 << 60


@cache
def _base(part: int, salt: int) -> int:
    return int(np.random.Generator(np.random.PCG64([20240517, part, salt])).integers(1 << 20, PRIME - 1))


@cache
def _bytes_table(lower: bool, part: int, salt: int) -> np.ndarray:
    t = np.random.Generator(np.random.PCG64([71, part, salt])).integers(1, PRIME, 256, dtype=np.uint64)
    if lower:
        t[0x41:0x5B] = t[0x61:0x7B]
    return t


@cache
def _classes(kind: str) -> np.ndarray:
    """Class of each byte: 0 parts words, and so does a change from one class to another."""
    c = np.ones(256, np.uint8)
    for b in range(256):
        if b in SPACE or kind == "alnum" and b not in ALNUM:
            c[b] = 0
        elif kind == "mixed" and b not in ALNUM:
            c[b] = 2
    return c


def _reduced(x: np.ndarray) -> np.ndarray:
    """x modulo PRIME, in place; x < 2**63."""
    for _ in range(2):
        high = x >> U(31)
        x &= U(PRIME)
        x += high
    x[x >= U(PRIME)] -= U(PRIME)
    return x


def _made_powers(base: int, n: int) -> np.ndarray:
    p = np.ones(1, np.uint64)
    while len(p) < n:
        p = np.append(p, _reduced(p * U(pow(base, len(p), PRIME))))
    return p.astype(np.uint32)


@cache
def _kept_powers(base: int) -> np.ndarray:
    return _made_powers(base, SHORT)


def _power(base: int, n: int) -> np.ndarray:
    return _kept_powers(base) if n <= SHORT else _made_powers(base, n)


@dataclass
class Words:
    """data: the bytes; start, end: of each word; doc: row of each word; ptr: first word of each row (n+1)."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    ptr: np.ndarray
    hash: np.ndarray
    totals: list[np.ndarray]
    salt: int

    def stems(self, n: int) -> np.ndarray:
        """Hashes of each word's first n bytes (all of a shorter word)."""
        return _hashes(self.totals, self.start, np.minimum(self.start + n, self.end), self.salt)

    def alike(self, other: np.ndarray) -> np.ndarray:
        """Whether word i and word other[i] have the same bytes."""
        size = self.end - self.start
        same = size == size[other]
        at = np.flatnonzero(same & (other != np.arange(len(other))))
        n = size[at]
        ends = np.cumsum(n)
        step = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - n, n)
        wrong = self.data[np.repeat(self.start[at], n) + step] != self.data[np.repeat(self.start[other[at]], n) + step]
        same[at[np.unique(np.searchsorted(ends, np.flatnonzero(wrong), "right"))]] = False
        return same

    def rows(self, lo: int, hi: int) -> Words:
        """The words of rows lo to hi, renumbered from 0."""
        a, b = self.ptr[lo], self.ptr[hi]
        return Words(self.data, self.start[a:b], self.end[a:b], self.doc[a:b] - lo, self.ptr[lo : hi + 1] - a, self.hash[a:b], self.totals, self.salt)

    def text(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()


def text_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; null rows are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if pa.types.is_large_string(col.type):
        kind = np.int64
    else:
        kind = np.int32
    if col.null_count:
        col = pc.fill_null(col, "")
    off = np.frombuffer(col.buffers()[1], kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = col.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def _hashes(totals: list[np.ndarray], start: np.ndarray, end: np.ndarray, salt: int) -> np.ndarray:
    out = (end - start).astype(np.uint64) * U(0xC2B2AE3D27D4EB4F)
    for part, total in enumerate(totals):
        inverse = _power(pow(_base(part, salt), -1, PRIME), len(total))[start].astype(np.uint64)
        out ^= _reduced(_reduced(total[end] - total[start]) * inverse) << U(part * 31)
    return mix(out)


def split_exact(col: pa.Array) -> Words:
    """Words of each row whose hashes are equal only where the bytes are: compared, and hashed anew where they aren't."""
    for salt in range(64):
        w = split(col, salt=salt)
        _, first, inverse = np.unique(w.hash, return_index=True, return_inverse=True)
        if w.alike(first[inverse]).all():
            return w
    raise RuntimeError("no hash tells the words apart")


def split(col: pa.Array, lower: bool = False, kind: str = "space", salt: int = 0) -> Words:
    """Words of each row. kind "space": what [\\x20\\t-\\r] parts; "alnum": runs of ASCII letters, digits
    and bytes of other characters; "mixed": those and the runs of punctuation between them. lower: hashes
    ignore the case of A-Z."""
    data, off = text_buffer(col)
    n = len(data)
    c = _classes(kind)[data]
    first = np.zeros(n + 1, bool)
    first[off] = True
    begins = c > 0
    ends = begins.copy()
    if n:
        parted = (c[1:] != c[:-1]) | first[1:n]
        begins[1:] &= parted
        ends[:-1] &= parted
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    ptr = np.searchsorted(start, off)
    doc = np.repeat(np.arange(len(off) - 1, dtype=np.int32), np.diff(ptr))
    totals = []
    for part in range(2):
        x = _bytes_table(lower, part, salt)[data]
        x *= _power(_base(part, salt), n)[:n]
        high = x >> U(31)
        x &= U(PRIME)
        x += high
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(x, out=total[1:])
        totals.append(total)
    return Words(data, start, end, doc, ptr, _hashes(totals, start, end, salt), totals, salt)


def ngrams(h: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n consecutive words of one row, and the position of each one's first word."""
    if len(h) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    m = len(h) - n + 1
    acc = np.zeros(m, np.uint64)
    for j in range(n):
        acc *= U(0xD6E8FEB86659FD93)
        acc += h[j : j + m]
    at = np.flatnonzero(doc[:m] == doc[n - 1 :])
    return mix(acc[at]), at


def per_doc_counts(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (doc, hash) with their counts, sorted by both."""
    order = np.lexsort((h, doc))
    d, h = doc[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (d[1:] != d[:-1]) | (h[1:] != h[:-1])
    at = np.flatnonzero(new)
    return d[at], h[at], np.diff(np.append(at, len(h)))
