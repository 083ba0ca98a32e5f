"""Quality classifier: Naive Bayes support vectors.

Indicators of hashed n-grams (words, punctuation runs, pairs of neighbours, repeats) are scaled by the
log-count ratios of the two classes; a linear hinge-loss model is fitted to them by dual coordinate
descent and its margins are turned into probabilities by a logistic fit on rows kept aside.

The fit uses a sample of labelled rows bounded by `rows`; it runs in one task because that sample is
bounded. Scoring reads every whole text; one of any length is a batch of its own. Of equal labelled ids one row counts, so ties don't arise. Null and empty texts have no n-grams and get the score of the
intercept; repeated rows get equal scores; other columns are not looked at. Without labelled rows of both
classes the score is the share of ones (0.5 without any).
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

BITS = 18


def features(w: Words, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, feature) of a batch: unigrams, bigrams, and one feature for a word that follows itself."""
    if not len(w.hash):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    two, at = ngrams(w.hash, w.doc, 2)
    same = w.hash[at] == w.hash[at + 1]
    two[same] = U(0x5EED)
    key = np.append(mix(w.hash ^ U(0xA5A5)), mix(two)) & U((1 << bits) - 1)
    doc = np.append(w.doc, w.doc[at]).astype(np.uint64)
    both = np.unique(doc << U(bits) | key).astype(np.int64)
    return both >> bits, both & ((1 << bits) - 1)


def dual_coordinate_descent(ptr: np.ndarray, idx: np.ndarray, val: np.ndarray, y: np.ndarray, dims: int, cost: tuple[float, float], epochs: int, seed: int) -> np.ndarray:
    """Weights of the L1-loss linear support vector machine (last one: the intercept); cost by class 0 and 1."""
    w = np.zeros(dims + 1)
    alpha = np.zeros(len(y))
    sign = np.where(y > 0, 1.0, -1.0)
    top = np.where(y > 0, cost[1], cost[0])
    rng = np.random.default_rng(seed)
    norm = np.add.reduceat(np.append(val**2, 0), np.minimum(ptr[:-1], len(val))) * (np.diff(ptr) > 0) + 1
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(y)).tolist():
            a, b = ptr[i], ptr[i + 1]
            at, x = idx[a:b], val[a:b]
            g = sign[i] * (w[at] @ x + w[dims]) - 1
            new = min(max(alpha[i] - g / norm[i], 0.0), top[i])
            step = (new - alpha[i]) * sign[i]
            if step:
                alpha[i] = new
                w[at] += step * x
                w[dims] += step
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return w


def logistic_fit(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """a, b of 1 / (1 + exp(-(a m + b))), with the usual smoothed targets."""
    n1, n0 = float((y > 0).sum()), float((y == 0).sum())
    t = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.stack([margin, np.ones_like(margin)], 1)
    c = np.array([1.0, np.log((n1 + 1) / (n0 + 1))])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ c, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(h, x.T @ (t - p))
        c += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return max(float(c[0]), 1e-3), float(c[1])


@dataclass
class QualityModel:
    weight: np.ndarray  # log-count ratio times hinge weight, by feature
    ratio2: np.ndarray  # square of the log-count ratio, for a row's norm
    bias: float
    a: float
    b: float

    def margins(self, doc: np.ndarray, idx: np.ndarray, n: int) -> np.ndarray:
        dot = np.bincount(doc, self.weight[idx], n)
        norm = np.sqrt(np.bincount(doc, self.ratio2[idx], n))
        return dot / np.maximum(norm, 1e-9) + self.bias

    def score(self, doc: np.ndarray, idx: np.ndarray, n: int) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.a * self.margins(doc, idx, n) + self.b, -30, 30)))


def fit(ids: np.ndarray, rows: list[np.ndarray], y: np.ndarray, bits: int = BITS, epochs: int = 12, cost: float = 1.0, seed: int = 7) -> QualityModel:
    """The model of rows of distinct features; a fifth of them is kept aside for the logistic fit."""
    dims = 1 << bits
    n1, n0 = int((y > 0).sum()), int((y == 0).sum())
    if not n1 or not n0:
        p = n1 / len(y) if len(y) else 0.5
        return QualityModel(np.zeros(dims, np.float32), np.zeros(dims, np.float32), 0.0, 1.0, float(np.log((p + 1e-3) / (1 - p + 1e-3))))
    order = np.argsort(ids, kind="stable")
    rows, y = [rows[i] for i in order.tolist()], y[order]

    def train(keep: np.ndarray) -> QualityModel:
        part, yy = [rows[i] for i in np.flatnonzero(keep).tolist()], y[keep]
        idx = np.concatenate(part)
        ptr = np.append(0, np.cumsum([len(r) for r in part]))
        cls = np.repeat(yy, np.diff(ptr))
        pos, neg = (np.bincount(idx[cls == c], minlength=dims) + 1.0 for c in (1, 0))
        r = np.log((pos / pos.sum()) / (neg / neg.sum()))
        val = r[idx]
        norm = np.sqrt(np.add.reduceat(np.append(val**2, 0), np.minimum(ptr[:-1], len(val))) * (np.diff(ptr) > 0))
        val = val / np.repeat(np.maximum(norm, 1e-9), np.diff(ptr))
        even = len(yy) / 2
        w = dual_coordinate_descent(ptr, idx, val, yy, dims, (cost * even / max((yy == 0).sum(), 1), cost * even / max((yy > 0).sum(), 1)), epochs, seed)
        return QualityModel((w[:dims] * r).astype(np.float32), (r**2).astype(np.float32), float(w[dims]), 1.0, 0.0)

    aside = np.random.default_rng(seed).random(len(y)) < 0.2
    if len(set(y[aside])) == 2 and len(set(y[~aside])) == 2:
        first = train(~aside)
        out = [rows[i] for i in np.flatnonzero(aside).tolist()]
        m = first.margins(np.repeat(np.arange(len(out)), [len(r) for r in out]), np.concatenate(out), len(out))
        a, b = logistic_fit(m, y[aside])
    else:
        a, b = 2.0, 0.0
    model = train(np.ones(len(y), bool))
    model.a, model.b = a, b
    return model


def train_quality(docs: DataFrame, labels: DataFrame, learn: Column, label: str = "quality", rows: int = 12_000, bits: int = BITS) -> QualityModel:
    """Fit on at most about `rows` labelled documents that `learn` admits."""

    def featurise(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it, "text"):
            doc, idx = features(split(b.column(1), lower=True, kind="mixed"), bits)
            ptr = np.searchsorted(doc, np.arange(b.num_rows + 1)).astype(np.int32)
            yield pa.record_batch([b.column(0), b.column(2), pa.ListArray.from_arrays(pa.array(ptr), pa.array(idx.astype(np.int32)))], names=["id", "y", "f"])

    def learn_all(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, y, rows_ = [], [], []
        for b in it:
            ids.append(np.asarray(b.column(0)))
            y.append(np.asarray(b.column(1)))
            off, flat = np.asarray(b.column(2).offsets), np.asarray(b.column(2).values)
            rows_ += [flat[s:e] for s, e in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
        m = fit(np.concatenate(ids) if ids else np.zeros(0, np.int64), rows_, np.concatenate(y) if y else np.zeros(0, np.int32), bits)
        yield pa.record_batch([pa.array([m.weight.tobytes()]), pa.array([m.ratio2.tobytes()]), pa.array([m.bias]), pa.array([m.a]), pa.array([m.b])], names=["w", "r", "bias", "a", "b"])

    sample = labelled_sample(docs, labels, label, learn, rows)
    kind = sample.schema["id"].dataType.simpleString()
    got = small_batches(sample).mapInArrow(featurise, f"id {kind}, y int, f array<int>").repartition(1).mapInArrow(learn_all, "w binary, r binary, bias double, a double, b double").collect()
    if not got:
        return fit(np.zeros(0, np.int64), [], np.zeros(0, np.int32), bits)
    m = got[0]
    return QualityModel(np.frombuffer(m["w"], np.float32), np.frombuffer(m["r"], np.float32), m["bias"], m["a"], m["b"])


def score_quality(docs: DataFrame, model: QualityModel, bits: int = BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every whole text; the model (2 MB) goes to the executors by broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches(it, "text"):
            doc, idx = features(split(b.column(1), lower=True, kind="mixed"), bits)
            yield pa.record_batch([b.column(0), pa.array(m.score(doc, idx, b.num_rows))], names=["id", "score"])

    src = small_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = src.schema["id"].dataType.simpleString()
    return src.mapInArrow(run, f"id {kind}, score double").withColumnRenamed("id", id_col)


def keep_quality(docs: DataFrame, model: QualityModel, least: float, bits: int = BITS) -> DataFrame:
    """The rows of docs whose text scores `least` or more, all columns unchanged; no row is moved."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it, "text"):
            doc, idx = features(split(b.column(b.schema.get_field_index("text")), lower=True, kind="mixed"), bits)
            yield b.filter(pa.array(shared.value.score(doc, idx, b.num_rows) >= least))

    return small_batches(docs).mapInArrow(run, docs.schema)
