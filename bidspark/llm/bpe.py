"""BPE encoding and decoding by batched merge rounds over flat numpy arrays.

The tokenizer file is a JSON description (vocabulary, merges, end-of-word suffix) that is read once in
each task. Words are split at white space from an Arrow batch; each distinct word of the batch is
normalised and cut into pieces, and the symbols of all pieces stand in one flat array. A round looks up
every neighbouring pair by binary search over the sorted pair keys, takes the lowest rank of each piece
and merges it wherever it stands; pieces without a known pair leave the rounds.

Null and empty texts have no tokens. Repeated rows, ties and extra columns don't matter: each row is
encoded by itself and only `id` and `text` are read. A very long text is a batch of its own.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bidspark.llm.common import batches, small_batches
from bidspark.llm.words import split

#: White space as the tokenizer's pattern understands it.
WHITE = r"\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Fixed pattern of the tokenizer file.
PIECES = rf"'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}]+|[\p{{N}}]|[^{WHITE}\p{{L}}\p{{N}}]+"
#: Words that a task remembers between batches.
MEMORY = 60_000


class Bpe:
    """Vocabulary, sorted pair keys and the byte alphabet of one tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, suffix = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"] or ""
        self.tokens = dict(spec["model"]["vocab"])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens |= self.special
        self.names = {i: t for t, i in self.tokens.items()}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        key = left << 20 | right
        order = np.argsort(key, kind="stable")
        self.key, self.rank = key[order], order.astype(np.int64)
        self.into = np.array([vocab[a + b] for a, b in pairs], np.int64)[order]
        # the printable alphabet of byte-level BPE: printable Latin-1 stands for itself, the rest follows from 256 on
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = iter(range(256, 512))
        char = [chr(b) if b in plain else chr(next(rest)) for b in range(256)]
        self.inner = np.array([vocab.get(c, -1) for c in char], np.int64)
        self.final = np.array([vocab.get(c + suffix, -1) for c in char], np.int64)
        self.cut = regex.compile(PIECES)
        self.fixed = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        self.forget()

    def pieces(self, word: str) -> list[bytes | int]:
        """Pieces (UTF-8) and ids of special tokens of one word without ASCII white space."""
        out: list[bytes | int] = []
        at = 0
        if self.fixed is not None and "<|" in word:
            for m in self.fixed.finditer(word):
                out += self._plain(word[at : m.start()])
                out.append(self.special[m.group()])
                at = m.end()
        return out + self._plain(word[at:])

    def _plain(self, text: str) -> list[bytes]:
        if text.isascii():
            text = text.lower()
        else:  # each letter by itself: a final sigma is an ordinary one
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        if text.isalpha():
            return [text.encode()]
        return [x.encode() for x in self.cut.findall(text)]

    def merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces in one array, and where each piece begins (n+1)."""
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        data = np.frombuffer(b"".join(pieces), np.uint8)
        ids = self.inner[data]
        last = np.cumsum(size) - 1
        ids[last] = self.final[data[last]]
        owner = np.repeat(np.arange(len(pieces)), size)
        done_ids, done_owner, done_pos = [], [], []
        pos = np.arange(len(ids))
        while len(ids):
            key = ids[:-1] << 20 | ids[1:]
            at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
            known = (self.key[at] == key) & (owner[:-1] == owner[1:])
            rank = np.where(known, self.rank[at], len(self.key))
            starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            best = np.minimum.reduceat(np.append(rank, len(self.key)), starts)
            group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(ids))))
            alive = (best < len(self.key))[group]
            if not alive.all():
                done_ids.append(ids[~alive])
                done_owner.append(owner[~alive])
                done_pos.append(pos[~alive])
            take = known & (rank == best[group[:-1]])
            hit = np.flatnonzero(take)
            if len(hit):  # of a run such as (a, a), (a, a) every other one, from the left
                head = np.append(True, np.diff(hit) > 1)
                run = np.maximum.accumulate(np.where(head, np.arange(len(hit)), 0))
                hit = hit[(np.arange(len(hit)) - run) % 2 == 0]
                ids[hit] = self.into[at[hit]]
                alive[hit + 1] = False
            ids, owner, pos = ids[alive], owner[alive], pos[alive]
        if done_ids:
            ids, owner, pos = map(np.concatenate, (done_ids, done_owner, done_pos))
            ids, owner = (x[order] for order in [np.argsort(pos, kind="stable")] for x in (ids, owner))
        else:
            ids, owner = np.zeros(0, np.int64), np.zeros(0, np.int64)
        return ids, np.searchsorted(owner, np.arange(len(pieces) + 1))

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many words in one array, and where each word begins (n+1)."""
        flat: list[bytes] = []
        index: dict[bytes, int] = {}
        parts: list[int] = []  # piece number, or -1 - id of a special token
        count = np.zeros(len(words) + 1, np.int64)
        for k, word in enumerate(words):
            got = self.pieces(word)
            count[k + 1] = len(got)
            for p in got:
                if isinstance(p, int):
                    parts.append(-1 - p)
                else:
                    n = index.setdefault(p, len(flat))
                    if n == len(flat):
                        flat.append(p)
                    parts.append(n)
        ids, ptr = self.merge(flat) if flat else (np.zeros(0, np.int64), np.zeros(1, np.int64))
        n = np.array(parts, np.int64)
        ids = np.append(ids, -1 - n[n < 0])
        lead = np.append(ptr[:-1], np.arange(int((n < 0).sum())) + ptr[-1])
        size = np.append(np.diff(ptr), np.ones(int((n < 0).sum()), np.int64))
        n[n < 0] = len(flat) + np.arange(int((n < 0).sum()))
        lens = size[n]
        total = np.append(0, np.cumsum(lens))
        out = ids[np.repeat(lead[n] - total[:-1], lens) + np.arange(total[-1])]
        return out, total[np.cumsum(count)]

    def forget(self) -> None:
        """Empty the memory of words met so far."""
        self.met = np.zeros(0, np.uint64)  # sorted hashes, and where each word stands
        self.slot = np.zeros(0, np.int64)
        self.flat = np.zeros(0, "<u4")
        self.ptr = np.zeros(1, np.int64)
        self.strings = np.zeros(0, object)
        self.words = np.zeros(0, object)

    def add(self, words: list[str]) -> np.ndarray:
        """Encode words; the slots that they get."""
        flat, ptr = self.encode_words(words)
        names = list(map(self.names.__getitem__, flat.tolist()))
        edge = ptr.tolist()
        strings = np.empty(len(edge) - 1, object)
        strings[:] = [" ".join(names[a:b]) for a, b in zip(edge, edge[1:], strict=False)]
        slots = np.arange(len(strings)) + len(self.strings)
        self.ptr = np.append(self.ptr, ptr[1:] + len(self.flat))
        self.flat = np.append(self.flat, flat.astype("<u4"))
        self.strings = np.append(self.strings, strings)
        spelled = np.empty(len(words), object)
        spelled[:] = words
        self.words = np.append(self.words, spelled)
        return slots

    def recall(self, hashes: np.ndarray, spelled) -> np.ndarray:
        """Slots of distinct words, given as hashes and by `spelled` as strings, which are compared with those met
        before; the others are encoded now. The memory holds MEMORY words and a batch's."""
        if len(self.met) > MEMORY:
            self.forget()
        words = np.empty(len(hashes), object)
        words[:] = spelled(np.arange(len(hashes)))
        at = np.minimum(np.searchsorted(self.met, hashes), max(len(self.met) - 1, 0))
        out = self.slot[at] if len(self.met) else np.zeros(len(hashes), np.int64)
        listed = self.met[at] == hashes if len(self.met) else np.zeros(len(hashes), bool)
        new = ~listed
        new[listed] = self.words[out[listed]] != words[listed]
        if new.any():
            out[new] = self.add(words[new].tolist())
            fresh = new & ~listed
            met, slot = np.append(self.met, hashes[fresh]), np.append(self.slot, out[fresh])
            order = np.argsort(met, kind="stable")
            self.met, self.slot = met[order], slot[order]
        return out

    def decode(self, ids: np.ndarray) -> str:
        """Tokens' strings joined by spaces, as the tokenizer file has no decoder."""
        return " ".join(map(self.names.__getitem__, ids.tolist()))


@cache
def load(path: str) -> Bpe:
    return Bpe(path)


def _digest(path: str, it: Iterator[pa.RecordBatch], emit_ids: bool) -> Iterator[pa.RecordBatch]:
    bpe = load(path)
    for batch in batches(it, "text"):
        w = split(batch.column(1))
        distinct, first, inverse = np.unique(w.hash, return_index=True, return_inverse=True)
        raw = w.data.tobytes()
        odd = np.flatnonzero(~w.alike(first[inverse]))  # words whose hash another word has

        def spelled(k: np.ndarray, w=w, raw=raw, first=first) -> list[str]:
            i = first[k]
            return [raw[a:b].decode() for a, b in zip(w.start[i].tolist(), w.end[i].tolist(), strict=True)]

        slots = bpe.recall(distinct, spelled)[inverse]
        if len(odd):
            slots[odd] = bpe.add([raw[a:b].decode() for a, b in zip(w.start[odd].tolist(), w.end[odd].tolist(), strict=True)])
        lens, lead = np.diff(bpe.ptr), bpe.ptr
        n_tokens, sha_ids, sha_text, all_ids = [], [], [], []
        for a, b in zip(w.ptr[:-1].tolist(), w.ptr[1:].tolist(), strict=True):
            k = slots[a:b]
            size = lens[k]
            total = np.cumsum(size)
            ids = bpe.flat[np.repeat(lead[k] - (total - size), size) + np.arange(total[-1] if len(total) else 0)]
            n_tokens.append(len(ids))
            if emit_ids:
                all_ids.append(ids.astype(np.int32))
            else:
                sha_ids.append(hashlib.sha256(ids.tobytes()).hexdigest())
                text = " ".join(bpe.strings[k[size > 0]].tolist())
                sha_text.append(hashlib.sha256(text.encode()).hexdigest())
        if emit_ids:
            yield pa.record_batch([batch.column(0), pa.array(all_ids, pa.list_(pa.int32()))], names=["id", "ids"])
        else:
            yield pa.record_batch([batch.column(0), pa.array(n_tokens, pa.int64()), pa.array(sha_ids), pa.array(sha_text)], names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])
    bpe.forget()  # the worker lives on after the task


def bpe_encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>): token ids of each whole text."""
    src = small_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = src.schema["id"].dataType.simpleString()
    return src.mapInArrow(lambda it: _digest(path, it, True), f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def bpe_decode(tokens: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text): each row's ids decoded; null ids give the empty text."""
    src = small_batches(tokens).select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    kind = src.schema["id"].dataType.simpleString()

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for b in it:
            text = [bpe.decode(np.asarray(x, np.int64)) if x else "" for x in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), pa.array(text, pa.string())], names=["id", "text"])

    return src.mapInArrow(run, f"id {kind}, text string").withColumnRenamed("id", id_col)


def bpe_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of each whole text, encoded and decoded in one pass."""
    src = small_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = src.schema["id"].dataType.simpleString()
    out = f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return src.mapInArrow(lambda it: _digest(path, it, False), out).withColumnRenamed("id", id_col)
