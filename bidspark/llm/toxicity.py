"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are indicators of lower-cased words (whole and cut to their first 4 and 5 bytes, so that endings
don't hide a stem), neighbouring pairs and pairs with one word between, hashed to 2^BITS coordinates. Each coordinate has its own learning rate, and the L1 term keeps most weights at zero:
what is broadcast is the short list of the others.

The fit uses a sample of labelled rows bounded by `rows`, in one task because the sample is bounded.
Scoring reads every whole text; one of any length is a batch of its own. Of equal labelled ids one row counts, so ties don't arise. Null and empty texts have no features and get the intercept's score;
repeated rows get equal scores; other columns are not looked at. Without labelled rows scores are 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bidspark.llm.common import batches, small_batches
from bidspark.llm.labelled import labelled_sample
from bidspark.llm.words import U, Words, mix, ngrams, split

BITS = 20


def features(w: Words, keep: np.ndarray | None = None, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, coordinate) of a batch; with `keep` only coordinates that it marks."""
    if not len(w.hash):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    two, at2 = ngrams(w.hash, w.doc, 2)
    at3 = np.flatnonzero(w.doc[:-2] == w.doc[2:])
    skip = mix(w.hash[at3] * U(0xC2B2AE3D27D4EB4F) + w.hash[at3 + 2])
    parts = []
    ones = ((mix(w.hash ^ U(1)), w.doc), (mix(w.stems(4) ^ U(4)), w.doc), (mix(w.stems(5) ^ U(5)), w.doc))
    for h, doc in (*ones, (mix(two ^ U(2)), w.doc[at2]), (mix(skip ^ U(3)), w.doc[at3])):
        c = h & U((1 << bits) - 1)
        if keep is not None:
            on = keep[c]
            c, doc = c[on], doc[on]
        parts.append(doc.astype(np.uint64) << U(bits) | c)
    both = np.unique(np.concatenate(parts)).astype(np.int64)
    return both >> bits, both & ((1 << bits) - 1)


@dataclass
class ToxicityModel:
    index: np.ndarray
    weight: np.ndarray
    bias: float

    def dense(self, bits: int = BITS) -> np.ndarray:
        w = np.zeros(1 << bits, np.float32)
        w[self.index] = self.weight
        return w


def ftrl(rows: list[np.ndarray], y: np.ndarray, bits: int = BITS, alpha: float = 1.0, beta: float = 1.0, l1: float = 4.0, l2: float = 1.0, epochs: int = 4, seed: int = 11) -> ToxicityModel:
    """FTRL-proximal with one rate per coordinate; the intercept is not shrunk."""
    dims = 1 << bits
    z, n = np.zeros(dims), np.zeros(dims)
    zb = nb = 0.0
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(y)).tolist():
            at = rows[i]
            zi, ni = z[at], n[at]
            root = np.sqrt(ni)
            w = np.where(np.abs(zi) > l1, (np.sign(zi) * l1 - zi) / ((beta + root) / alpha + l2), 0.0)
            wb = -zb * alpha / (beta + nb**0.5)
            p = 1 / (1 + np.exp(-min(max(w.sum() + wb, -30.0), 30.0)))
            g = p - y[i]
            new = ni + g * g
            z[at] = zi + g - (np.sqrt(new) - root) / alpha * w
            n[at] = new
            zb += g - ((nb + g * g) ** 0.5 - nb**0.5) / alpha * wb
            nb += g * g
    w = np.where(np.abs(z) > l1, (np.sign(z) * l1 - z) / ((beta + np.sqrt(n)) / alpha + l2), 0.0)
    index = np.flatnonzero(w)
    return ToxicityModel(index.astype(np.int32), w[index].astype(np.float32), float(-zb * alpha / (beta + nb**0.5)))


def train_toxicity(docs: DataFrame, labels: DataFrame, learn: Column, label: str = "toxic", rows: int = 12_000, bits: int = BITS) -> ToxicityModel:
    """Fit on at most about `rows` labelled documents that `learn` admits."""

    def featurise(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it, "text"):
            doc, idx = features(split(b.column(1), lower=True, kind="alnum"), None, bits)
            ptr = np.searchsorted(doc, np.arange(b.num_rows + 1)).astype(np.int32)
            yield pa.record_batch([b.column(0), b.column(2), pa.ListArray.from_arrays(pa.array(ptr), pa.array(idx.astype(np.int32)))], names=["id", "y", "f"])

    def learn_all(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, y, rows_ = [], [], []
        for b in it:
            ids.append(np.asarray(b.column(0)))
            y.append(np.asarray(b.column(1)))
            off, flat = np.asarray(b.column(2).offsets), np.asarray(b.column(2).values)
            rows_ += [flat[s:e] for s, e in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
        if not ids:
            return
        order = np.argsort(np.concatenate(ids), kind="stable")
        m = ftrl([rows_[i] for i in order.tolist()], np.concatenate(y)[order].astype(float), bits)
        yield pa.record_batch([pa.array([m.index.tobytes()]), pa.array([m.weight.tobytes()]), pa.array([m.bias])], names=["i", "w", "bias"])

    sample = labelled_sample(docs, labels, label, learn, rows)
    kind = sample.schema["id"].dataType.simpleString()
    got = small_batches(sample).mapInArrow(featurise, f"id {kind}, y int, f array<int>").repartition(1).mapInArrow(learn_all, "i binary, w binary, bias double").collect()
    if not got:
        return ToxicityModel(np.zeros(0, np.int32), np.zeros(0, np.float32), 0.0)
    return ToxicityModel(np.frombuffer(got[0]["i"], np.int32), np.frombuffer(got[0]["w"], np.float32), got[0]["bias"])


def score_toxicity(docs: DataFrame, model: ToxicityModel, bits: int = BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        w = m.dense(bits)
        keep = w != 0
        for b in batches(it, "text"):
            doc, idx = features(split(b.column(1), lower=True, kind="alnum"), keep, bits)
            s = np.bincount(doc, w[idx], b.num_rows) + m.bias
            yield pa.record_batch([b.column(0), pa.array(1 / (1 + np.exp(-np.clip(s, -30, 30))))], names=["id", "score"])

    src = small_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = src.schema["id"].dataType.simpleString()
    return src.mapInArrow(run, f"id {kind}, score double").withColumnRenamed("id", id_col)
