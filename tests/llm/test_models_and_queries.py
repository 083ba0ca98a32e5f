"""The optimisers against plain ones, and the registered queries' hold-outs and limits."""

import math
import os
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


def test_ftrl_equals_a_plain_loop():
    from bidspark.llm.toxicity import ftrl

    rng = np.random.default_rng(3)
    rows = [np.unique(rng.integers(0, 64, rng.integers(1, 9))) for _ in range(200)]
    y = np.array([float(r[0] % 3 == 0) for r in rows])
    alpha, beta, l1, l2, epochs, seed = 0.7, 1.3, 0.5, 0.8, 3, 5
    got = ftrl(rows, y, 6, alpha, beta, l1, l2, epochs, seed)
    z, n, zb, nb = dict.fromkeys(range(64), 0.0), dict.fromkeys(range(64), 0.0), 0.0, 0.0

    def weight(i):
        return 0.0 if abs(z[i]) <= l1 else -(z[i] - math.copysign(l1, z[i])) / ((beta + math.sqrt(n[i])) / alpha + l2)

    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in order.permutation(len(y)).tolist():
            w = {j: weight(j) for j in rows[i].tolist()}
            wb = -zb * alpha / (beta + math.sqrt(nb))
            g = 1 / (1 + math.exp(-(sum(w.values()) + wb))) - y[i]
            for j in w:
                sigma = (math.sqrt(n[j] + g * g) - math.sqrt(n[j])) / alpha
                z[j] += g - sigma * w[j]
                n[j] += g * g
            zb += g - (math.sqrt(nb + g * g) - math.sqrt(nb)) / alpha * wb
            nb += g * g
    want = np.array([weight(i) for i in range(64)])
    assert np.allclose(got.dense(6), want, atol=1e-6) and (want == 0).any() and math.isclose(got.bias, -zb * alpha / (beta + math.sqrt(nb)), rel_tol=1e-6)


def test_dual_coordinate_descent_reaches_the_optimum():
    from bidspark.llm.quality import dual_coordinate_descent

    rng = np.random.default_rng(4)
    x = (rng.random((40, 6)) < 0.4) * rng.standard_normal((40, 6))
    y = (x @ rng.standard_normal(6) + 0.5 * rng.standard_normal(40) > 0).astype(int)
    cost = (0.7, 0.4)
    ptr = np.append(0, np.cumsum((x != 0).sum(1)))
    w = dual_coordinate_descent(ptr, np.nonzero(x)[1], x[x != 0], y, 6, cost, 3000, 1)
    # projected gradient on the same dual problem, the intercept being one more feature
    a = np.column_stack([x, np.ones(40)]) * np.where(y > 0, 1.0, -1.0)[:, None]
    top, q = np.where(y > 0, cost[1], cost[0]), a @ a.T
    alpha, step = np.zeros(40), 1 / np.linalg.eigvalsh(q).max()
    for _ in range(60_000):
        alpha = np.clip(alpha + step * (1 - q @ alpha), 0, top)
    value = lambda v: 0.5 * v @ v + (top * np.maximum(0, 1 - a @ v)).sum()
    assert value(w) <= value(a.T @ alpha) * 1.002 + 1e-6


def _with_labels(spark, path, change):
    """The smallest tables, with other labels where `change` says."""
    for name in ("documents", "labels"):
        df = spark.read.parquet(f"{SF}/{name}.parquet")
        if name == "labels":
            df = df.withColumns({c: F.when(change, 1 - F.col(c)).otherwise(F.col(c)).cast(dict(df.dtypes)[c]) for c in ("quality", "toxic")})
        df.write.parquet(f"{path}/{name}.parquet")
    return str(path)


@needs_tables
@pytest.mark.parametrize(("name", "k", "rest", "least"), [("op3_toxicity", 5, 0, 0.5), ("op7_quality", 4, 2, 0.7)])
def test_held_out_labels_are_never_looked_at(spark, tmp_path, name, k, rest, least):
    from bidspark.llm.common import fold
    from bidspark.llm.queries import QUERIES

    got = {r.doc_id: r for r in QUERIES[name](spark, SF).collect()}
    other = {r.doc_id: r for r in QUERIES[name](spark, _with_labels(spark, tmp_path, fold(F.col("doc_id"), k) == rest)).collect()}
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count() == len(other)
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % k == rest)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= least) and math.isclose(r.score, other[i].score, abs_tol=1e-12)


@needs_tables
def test_searches_ask_for_every_twentieth_row(spark):
    from bidspark.llm.queries import QUERIES

    rows = QUERIES["op10_ann"](spark, SF).collect()
    ids = [r.vec_id for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id").collect()]
    assert {r.query_id for r in rows} == {i for i in ids if i % 20 == 0}
    assert all(r.query_id != r.vec_id for r in rows) and max(r["rank"] for r in rows) == 20
    links = QUERIES["op9_caps"](spark, SF).collect()
    assert sorted(r.vec_id for r in links) == sorted(ids) and all(r.kept == (r.vec_id == r.component_id) for r in links)


@needs_tables
@pytest.mark.parametrize(("name", "columns"), [("op1_minhash", {"doc_id", "class_id"}), ("op2_substrings", {"doc_id", "n_words", "n_removed", "kept_sha256"}), ("op4_urls", {"page_id", "host", "path", "rule", "verdict"}), ("op5_lm", {"doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"}), ("op6_mixing", {"doc_id", "copies"}), ("op8_bpe", {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"})])
def test_registered_queries_have_their_columns(spark, name, columns):
    from bidspark.llm.queries import QUERIES

    assert columns <= set(QUERIES[name](spark, SF).columns)
