import collections
import hashlib
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long, c string, bucket string, a string"
LONG = " ".join(f"w{i % 977}x{i % 1013}" for i in range(30_000))


def table(spark, rows, schema=DOCS):
    return spark.createDataFrame([(i, t, "en", f"src{(i or 0) % 3}", None, "clash", "x", None) for i, t in rows], schema)


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


@pytest.fixture(scope="module")
def odd():
    rng = random.Random(5)
    vocab = [f"v{i}" for i in range(400)]
    base = [" ".join(rng.choice(vocab) for _ in range(rng.choice([3, 20, 60, 200]))) for _ in range(40)]
    rows = list(enumerate(base))
    for i in range(40, 90):  # near and partial copies
        w = words(base[i % 40])
        for _ in range(rng.choice([0, 1, 2, 6])):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        rows.append((i, " ".join(w)))
    passage = " ".join(rng.choice(vocab) for _ in range(55))
    for i in range(90, 110):
        rows.append((i, f"{rng.choice(vocab)} {rng.choice(vocab)} {passage} {rng.choice(vocab)} {i}"))
    rows += [(110, None), (111, ""), (112, " \t\n"), (113, LONG), (114, LONG + " end"), (115, base[3]), (None, base[3]), (None, None), (0, base[0]), (116, "one two"), (117, "one two"), (118, "été été 中文")]
    return rows


def jaccard(a, b, n=5):
    def bag(t):
        w = words(t)
        return collections.Counter(tuple(w[i : i + n]) for i in range(max(len(w) - n + 1, 1))) if w else collections.Counter()

    x, y = bag(a), bag(b)
    every = sum((x | y).values())
    return sum((x & y).values()) / every if every else 0.0


def test_signatures_are_unbiased():
    from bidspark.llm.minhash import bag_minhash, shingles, similarity
    from bidspark.llm.words import split

    rng = random.Random(1)
    a, b = [], []
    for _ in range(150):
        n, v = rng.choice([6, 30, 200]), rng.choice([2, 5, 300])
        x = [f"w{rng.randrange(v)}" for _ in range(n)]
        y = list(x)
        for _ in range(rng.choice([0, 1, 3, 8])):
            y[rng.randrange(n)] = f"w{rng.randrange(v)}"
        a.append(" ".join(x))
        b.append(" ".join(y))
    wa, wb = split(pa.array(a)), split(pa.array(b))
    true = np.array([jaccard(x, y) for x, y in zip(a, b, strict=True)])
    assert np.allclose(similarity(wa, wb, 150), true)
    m = 512
    est = (bag_minhash(*shingles(wa), 150, m) == bag_minhash(*shingles(wb), 150, m)).mean(1)
    assert abs((est - true).mean()) < 0.01
    assert np.sqrt(((est - true) ** 2).mean()) < 1.5 * np.sqrt((true * (1 - true) / m).mean()) + 1e-3


def test_near_duplicates_match_brute_force(spark, odd):
    from bidspark.llm.minhash import drop_near_duplicates, near_duplicates

    got = near_duplicates(table(spark, odd)).collect()
    assert len(got) == len(odd)
    known = [(i, t) for i, t in odd if i is not None]
    label = {i: i for i, _ in known}
    changed = True
    pairs = [(i, j) for i, x in known for j, y in known if i < j and words(x) and words(y) and jaccard(x, y) >= 0.8]
    while changed:
        changed = False
        for i, j in pairs:
            low = min(label[i], label[j])
            changed |= label[i] != low or label[j] != low
            label[i] = label[j] = low
    for r in got:
        assert r.class_id == (label[r.doc_id] if r.doc_id is not None else r.class_id)
    kept = drop_near_duplicates(table(spark, odd))
    assert kept.columns == table(spark, odd).columns
    ids = sorted(r.doc_id for r in kept.where("doc_id is not null").collect())
    assert ids == sorted({i for i in label if label[i] == i})
    assert near_duplicates(table(spark, [])).count() == 0


@pytest.mark.parametrize(("crowd", "hot"), [(1000, 1000), (2, 1000), (1000, 2)])
def test_substrings_match_brute_force(spark, odd, crowd, hot):
    from bidspark.llm.substrings import WINDOW, substring_dedup

    rows = [r for r in odd if r[1] != LONG] if crowd == 2 else odd
    got = substring_dedup(table(spark, rows), crowd, hot)
    assert got.columns[: len(DOCS.split(","))] == table(spark, []).columns
    first = {}
    for i, t in rows:
        w = words(t)
        for k in range(len(w) - WINDOW + 1):
            key = tuple(w[k : k + WINDOW])
            if i is not None:
                first[key] = min(first.get(key, i), i)
    want = collections.Counter()
    for i, t in rows:
        w = words(t)
        gone = [False] * len(w)
        for k in range(len(w) - WINDOW + 1):
            if i is not None and first[tuple(w[k : k + WINDOW])] < i:
                gone[k : k + WINDOW] = [True] * WINDOW
        want[(i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g))] += 1
    assert collections.Counter((r.doc_id, r["__n_words"], r["__n_removed"], r["__kept"]) for r in got.collect()) == want
    assert substring_dedup(table(spark, [])).count() == 0


def test_suffix_automaton_matches_brute_force():
    from bidspark.llm.substrings import SuffixAutomaton

    rng = random.Random(2)
    for _ in range(60):
        seqs = [[rng.randrange(3) for _ in range(rng.randrange(1, 14))] for _ in range(4)]
        machine = SuffixAutomaton()
        for s in seqs[:3]:
            machine.add(s)
        subs = {tuple(s[i:j]) for s in seqs[:3] for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
        q = seqs[3]
        want = [max((n for n in range(k + 2) if n == 0 or tuple(q[k + 1 - n : k + 1]) in subs), default=0) for k in range(len(q))]
        assert machine.matches(q) == want


def test_bpe_equals_the_library(spark, odd):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    from bidspark.llm.bpe import bpe_decode, bpe_digests, bpe_encode

    path = P.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    extra = ["<|startoftext|>Hi<|endoftext|> there", "naïve ΣΑΣ İstanbul it's we'll 123 don't 'S", "aaaaaaaaaaa " * 5, "x" * 2000, "é Å 　wide nb", "中文字符 😀😀 a\x1cb", "I'M HE'LL x"]
    rows = odd + [(1000 + k, t) for k, t in enumerate(extra)]
    docs = table(spark, rows)
    text = collections.defaultdict(list)
    for i, t in rows:
        text[i].append(t or "")
    want = collections.Counter()
    for i, ts in text.items():
        for t in ts:
            ids = tok.encode(t, add_special_tokens=False).ids
            want[(i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest())] += 1
    assert collections.Counter(tuple(r) for r in bpe_digests(docs, path).collect()) == want
    back = bpe_decode(bpe_encode(docs.where("doc_id >= 1000"), path), path)
    for r in back.collect():
        assert r.text == tok.decode(tok.encode(text[r.doc_id][0], add_special_tokens=False).ids, skip_special_tokens=False)
    assert bpe_digests(table(spark, []), path).count() == 0


def _labelled(spark, n=600):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(n):
        w = [f"n{rng.randrange(300)}" for _ in range(rng.choice([8, 40, 150]))]
        bad, low = rng.random() < 0.3, rng.random() < 0.3
        if bad:
            w[rng.randrange(len(w))] = rng.choice(["scum", "trashy"])
        if low:
            w = [x + " $$$" for x in w]
        rows.append((i, " ".join(w)))
        labels.append((i, int(not low), int(bad)))
    docs = table(spark, [*rows, (n, None), (n + 1, ""), (n + 2, LONG), (0, rows[0][1])])
    return docs, spark.createDataFrame([*labels, (n, None, None), (n + 50, 1, 1), (1, labels[1][1], labels[1][2])], "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("which", ["toxicity", "quality"])
def test_classifiers_on_held_out_rows(spark, which):
    import importlib

    mod = importlib.import_module(f"bidspark.llm.{which}")
    train, score, label = (mod.train_toxicity, mod.score_toxicity, "toxic") if which == "toxicity" else (mod.train_quality, mod.score_quality, "quality")
    docs, labels = _labelled(spark)
    model = train(docs, labels, F.col("doc_id") % 4 != 0)
    got = score(docs, model)
    assert got.count() == docs.count()
    out = got.join(labels.dropDuplicates(["doc_id"]), "doc_id").where(f"doc_id % 4 = 0 and {label} is not null").collect()
    assert all(0 <= r.score <= 1 for r in got.collect())
    assert sum((r.score >= 0.5) == bool(r[label]) for r in out) / len(out) > 0.9
    none = train(docs, labels.limit(0), F.lit(True))
    assert {round(r.score, 6) for r in score(docs, none).limit(5).collect()} == {0.5}
    assert score(table(spark, []), model).count() == 0


def test_language_model(spark, odd):
    import zlib

    from bidspark.llm.common import fold
    from bidspark.llm.pitman import score, train

    rows = [(i, (t or "").upper() if i == 5 else t) for i, t in odd if i is not None]
    docs = table(spark, rows)
    got = score(docs, fold(F.col("doc_id"), 10) == 0, contexts=8, dishes=16, known=64).collect()
    assert len(got) == len(rows)
    low = {c: c + 32 for c in range(65, 91)}
    toks = {i: [x.translate(low) for x in words(t)] + ["\0end"] for i, t in rows}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in toks}
    c = collections.Counter()
    for i, t in rows:
        if not held[i]:
            c.update([x.translate(low) for x in words(t)] + ["\0end"])
    n, v = sum(c.values()), len(c)
    for r in got:
        k = toks[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(k), sum(c[x] > 0 for x in k), n)
        assert math.isclose(r.base_score, sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in k), rel_tol=1e-9)
        assert r.score < 0
    model, rare = train(docs.where(~(fold(F.col("doc_id"), 10) == 0)), contexts=8, dishes=16, known=64)
    assert np.allclose((10**model.pair).sum(1), 1)  # each context's dishes
    own = sum(10**r.own for r in rare.collect()) + 10**model.unseen
    assert abs(own - 1) < 1e-6  # the rare words and the unknown one
    assert {r.score for r in score(docs, F.lit(True)).collect()} == {0.0}
    assert score(table(spark, []), F.lit(False)).count() == 0


def test_language_model_rare_pairs(spark):
    """Pairs of words outside both lists of frequent words count: a text of the pairs learnt beats the same words dealt anew."""
    from bidspark.llm.pitman import score

    common = " ".join(f"c{i % 20}" for i in range(400))
    rows = [(i, f"{common} " + " ".join(f"a{j} b{j}" for j in range(i % 3, 30, 3)) + f" c1 x{i}") for i in range(60)]
    rows += [(100, " ".join(f"a{j} b{j}" for j in range(30))), (101, " ".join(f"a{j} b{(j + 7) % 30}" for j in range(30))), (102, "c3 c4"), (102, "c3 c4"), (103, None)]
    docs = table(spark, rows)
    for known in (64, 16):  # known by rank, and by their hashes only
        got = score(docs, F.col("doc_id") >= 100, contexts=4, dishes=8, known=known).collect()
        assert len(got) == len(rows)
        by = {r.doc_id: r.score for r in got}
        assert by[100] > by[101] + 10
        # of all words behind a5 the one that was learnt there is the likeliest, and far likelier than a new one
        vocab = sorted({w for i, t in rows if i < 100 for w in t.split()})
        ask = [(1000 + i, f"a5 {w}") for i, w in enumerate(vocab)] + [(2000, "a5 never"), (2001, "a5"), (2002, "")]
        s = {r.doc_id: r.score for r in score(table(spark, rows[:60] + ask), F.col("doc_id") >= 100, contexts=4, dishes=8, known=known).collect()}
        assert max(s[1000 + i] for i in range(len(vocab))) == s[1000 + vocab.index("b5")] > s[2000] + 1


def test_seating_follows_the_law_of_single_customers():
    """Customers in blocks: the number of tables has the law of seating one after another."""
    from bidspark.llm.pitman import seat

    d, theta, others, p0 = 0.6, 1.0, 7, 0.2
    for c in (1, 2, 5, 40, 300):
        law = np.zeros(c + 2)
        law[1] = 1.0
        for n in range(1, c):
            t = np.arange(c + 2)
            new = (theta + d * (others + t)) * p0
            share = np.where(t > 0, new / np.maximum(new + n - d * t, 1e-9), 0)
            law = law * (1 - share) + np.append(0, (law * share)[:-1])
        draws = 400_000
        got = np.bincount(seat(np.full(draws, c), np.full(draws, p0), np.full(draws, others), d, theta, np.random.default_rng(c)), minlength=c + 2)[: c + 2]
        assert np.abs(got / draws - law).sum() < 0.01


def _morse(n):
    a = "a"
    for _ in range(n):
        a += a.translate(str.maketrans("ab", "ba"))
    return a, a.translate(str.maketrans("ab", "ba"))


def test_words_that_collide_under_simple_hashes_stay_apart(spark, monkeypatch):
    """Thue-Morse words have equal polynomial hashes modulo powers of two; then any two words at all, by a broken hash."""
    import public_tokenizers as P
    from tokenizers import Tokenizer

    from bidspark.llm import words as W
    from bidspark.llm.bpe import Bpe, bpe_digests
    from bidspark.llm.minhash import near_duplicates, similarity
    from bidspark.llm.substrings import substring_dedup

    x, y = _morse(11)
    rows = [(1, " ".join([x] * 14)), (2, " ".join([y] * 14))]
    docs = table(spark, rows)
    assert {r.doc_id: r.class_id for r in near_duplicates(docs).collect()} == {1: 1, 2: 2}
    assert all(r["__n_removed"] == 0 for r in substring_dedup(docs).collect())
    path = P.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    for r in bpe_digests(docs, path).collect():
        ids = tok.encode(dict(rows)[r.doc_id], add_special_tokens=False).ids
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    assert W.split(pa.array(["one two one"])).alike(np.array([1, 1, 0])).tolist() == [False, True, True]
    true, calls = W._hashes, []

    def broken(totals, start, end, salt):
        calls.append(salt)
        return true(totals, start, end, salt) if salt else (end - start).astype(np.uint64)

    monkeypatch.setattr(W, "_hashes", broken)
    assert len(set(W.split_exact(pa.array(["abc abd abc"])).hash.tolist())) == 2 and max(calls) == 1
    both = W.split_exact(pa.array(["abc abd", "abc xyz"]))
    assert similarity(both.rows(0, 1), both.rows(1, 2), 1)[0] == 0.0
    bpe = Bpe(path)
    slots = [bpe.recall(np.array([7], np.uint64), lambda k, w=w: [w])[0] for w in ("one", "two", "one")]
    assert [bpe.strings[s] for s in slots] == [tok.decode(tok.encode(w).ids) for w in ("one", "two", "one")]


def test_near_duplicates_tell_rows_of_one_id_apart(spark):
    from bidspark.llm.minhash import drop_near_duplicates, near_duplicates

    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(3, a), (5, a), (5, b), (5, b), (6, b + " more"), (7, ""), (7, ""), (None, a), (None, a), (8, "b"), (8, "b c")]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, __place string, __digest int")
    got = collections.Counter((r.doc_id, r.class_id) for r in near_duplicates(docs).where("doc_id is not null").collect())
    assert got == {(3, 3): 1, (5, 3): 1, (5, 5): 2, (6, 5): 1, (7, 7): 2, (8, 8): 2}
    kept = drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    want = [(3, a), (5, b), (7, ""), (7, ""), (None, a), (None, a), (8, "b"), (8, "b c")]
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted(want, key=repr)
