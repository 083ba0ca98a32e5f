"""Record files, alignment of two tokenizers, perfect hashes and phrases against plain versions."""

import collections
import hashlib
import itertools
import os
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, h long, m string, key string"
BITS = ["a", "B", " ", "  ", "\n", "\t", "é", "ß", " ", "　", "\x85", "1", "23", ".", "'s", "<|endoftext|>", "中", "\x00", " ", "▁", "​", "́", " x", "\r\n", "😀", "<s>", "word", " the", " of", "à ", " È"]


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 1, "m", "k") for i, t in rows], DOCS)


def scraps(n, seed=3, most=30):
    rng = random.Random(seed)
    return ["".join(rng.choice(BITS) for _ in range(rng.randint(0, most))) for _ in range(n)]


LONG = " ".join(f"Wörd{i % 977} x{i % 1013}," for i in range(40_000))


def test_segments_have_the_tokens_of_whole_texts():
    from bidspark.llm.records import Encoder

    texts = [*scraps(6000), None, "", " ", "=" * 4000, LONG]
    for plain in (False, True):
        code = Encoder(A, plain)
        for part in (texts, texts[::-1]):  # the second time from memory
            flat, ptr = code.encode(pa.array(part))
            want = [e.ids for e in code.tokenizer.encode_batch_fast([t or "" for t in part], add_special_tokens=False)]
            assert [flat[a:b].tolist() for a, b in itertools.pairwise(ptr.tolist())] == want


def test_a_memory_forgets_and_stays_right(monkeypatch):
    from bidspark.llm import pieces
    from bidspark.llm.records import Encoder

    monkeypatch.setattr(pieces, "MEMORY", 50)
    code, texts = Encoder(A), [f"common words w{i} again and again" for i in range(400)]
    for k in range(0, 400, 40):
        flat, ptr = code.encode(pa.array(texts[k : k + 40]))
        assert [flat[a:b].tolist() for a, b in itertools.pairwise(ptr.tolist())] == [e.ids for e in code.tokenizer.encode_batch_fast(texts[k : k + 40])]
    assert len(code.memory.words) < 400 and len(code.memory.words) == code.lists.n


@pytest.fixture(scope="module")
def odd():
    rows = list(enumerate(scraps(150), 3))
    return [*rows, (1, None), (0, ""), (2, LONG), (200, "plain text"), (200, "plain text"), (200, "other text"), (None, "no id"), (None, None), (-5, "below <|endoftext|> zero")]


def test_records_come_back_in_order(spark, odd):
    from tokenizers import Tokenizer

    from bidspark.llm.common import scratch
    from bidspark.llm.records import read_records, record_digests, shuffled_records, write_records

    t = Tokenizer.from_file(A)
    ids = {x: [*t.encode(x or "", add_special_tokens=False).ids, 0] for _, x in odd}
    df = table(spark, odd).repartition(7)
    manifest = write_records(df, scratch(spark), A)
    got = read_records(manifest).orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted((i for i, _ in odd), key=lambda i: (i is not None, i or 0))
    assert sorted((r.doc_id, r.ids) for r in got if r.doc_id is not None) == sorted((i, ids[x]) for i, x in odd if i is not None)
    at = 0
    for r in got:
        assert r.start == at and r.n_tokens == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        at += r.n_tokens
    digests = record_digests(df, A)
    assert digests.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert sorted(map(tuple, digests.collect()), key=repr) == sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got), key=repr)
    one, two = (shuffled_records(manifest, 5, n).collect() for n in (1, 4))
    assert [r.rank for r in one] == sorted(r.rank for r in one) and one == two
    assert sorted((r.doc_id, r.ids) for r in one if r.doc_id is not None) == sorted((i, ids[x]) for i, x in odd if i is not None)
    assert [r.doc_id for r in shuffled_records(manifest, 6, 1).collect()] != [r.doc_id for r in one]
    assert record_digests(df.limit(0), A).count() == 0


def test_record_files(tmp_path):
    from bidspark.llm.records import Corrupt, Reader, Writer, frame, masked, unframe

    w = Writer(str(tmp_path), 3, "x", most=70)
    rows = [(5, [1, 2, 3]), (None, []), (-7, [70_000, 1]), (2**60, list(range(500)))]
    for i, x in rows:
        w.write(i, np.array(x, np.uint32))
    w.close()
    assert [(d[0], d[1], d[3]) for d in w.done] == [(3, 0, 3), (3, 1, 1)] and sum(d[4] for d in w.done) == 505
    back = [(i, x.tolist()) for d in w.done for part in Reader(d[2]).all() for i, x in part]
    assert back == rows
    assert Reader(w.done[0][2]).pick(1, 3)[1][0] == -7
    # framing: length, masked checksum, payload, masked checksum
    record = frame(5, np.array([1, 2], np.uint32))
    crc = zlib.crc32(record[:8])
    assert int.from_bytes(record[8:12], "little") == (((crc >> 15) | (crc << 17)) + 0xA282EAD8) & 0xFFFFFFFF == masked(record[:8])
    assert int.from_bytes(record[:8], "little") == len(record) - 16
    for k in range(len(record)):
        bad = bytearray(record)
        bad[k] ^= 1
        with pytest.raises(Corrupt):
            unframe(memoryview(bytes(bad)))
    name = w.done[0][2] + ".idx"
    raw = bytearray(open(name, "rb").read())
    raw[0] ^= 1
    open(name, "wb").write(raw)
    with pytest.raises(Corrupt):
        Reader(w.done[0][2])


def test_perfect_hashes():
    from bidspark.llm.perfect import Perfect

    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 63, 64, 1000, 40_000):
        keys = np.unique(rng.integers(-(2**62), 2**62, n))
        h = Perfect.of(keys)
        assert sorted(h(keys).tolist()) == list(range(len(keys))) and len(h) == len(keys)
        again = Perfect(h.sizes, h.packed)
        assert (again(keys) == h(keys)).all()
        other = again(rng.integers(-(2**62), 2**62, 100))
        assert ((other >= -1) & (other < max(len(keys), 1))).all()


def aligned(texts):
    import sentencepiece
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(A)
    t.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=B)
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
    docs = []
    for x in texts:
        groups = []
        if x:
            ids = (t.encode(" " + x, add_special_tokens=False).ids, sp.encode(x))
            said = ([bytes(byte[c] for c in t.id_to_token(i)) for i in ids[0]], [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in ids[1]])
            if all(b"".join(s) == (" " + x).encode() for s in said):
                at, end, group = [0, 0], [0, 0], ([], [])
                while at[0] < len(ids[0]) or at[1] < len(ids[1]):
                    k = int(end[0] > end[1])
                    end[k] += len(said[k][at[k]])
                    group[k].append(ids[k][at[k]])
                    at[k] += 1
                    if end[0] == end[1]:
                        groups.append(group)
                        group = ([], [])
        docs.append(groups)
    count = collections.Counter()
    for groups in docs:
        count.update({p for g in groups for p in itertools.product(*g)})
    best = {}
    for (a, _), n in count.items():
        best[a] = max(best.get(a, 0), n)
    out = []
    for groups in docs:
        links = [p for g in groups for p in itertools.product(*g)]
        text = ";".join("|".join(",".join(map(str, side)) for side in g) for g in groups)
        out.append((sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), len(links), sum(count[p] == best[p[0]] for p in links), sum(count[p] for p in links), hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    return out


FIELDS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.mark.parametrize("sent", [1 << 21, 0])
def test_alignment_is_that_of_whole_texts(spark, odd, sent):
    from bidspark.llm.align import align

    rows = [*odd, *((1000 + k, x) for k, x in enumerate(scraps(200, 4, 8))), (3000, "=" * 3000), (3001, " " * 300 + "a"), (3002, "same words here"), (3003, "same words here")]
    want = collections.Counter((i, *w) for (i, _), w in zip(rows, aligned([x for _, x in rows]), strict=True))
    got = align(table(spark, rows).repartition(5), A, B, sent=sent)
    assert collections.Counter((r.doc_id, *(r[f] for f in FIELDS)) for r in got.collect()) == want
    assert sum(w[1] == 0 for w in want) > 3
    assert align(table(spark, rows).limit(0), A, B, sent=sent).count() == 0


def test_counts_are_summed_in_a_tree(spark):
    from bidspark.llm.align import FAN, _key_rows, hashed_counts
    from bidspark.llm.common import cut

    rng = random.Random(1)
    rows = [(t, rng.randrange(3000) << 32 | rng.randrange(40), rng.randrange(1, 5)) for t in range(FAN * FAN + 40) for _ in range(30)]
    want = collections.Counter()
    for _, k, n in rows:
        want[k] += n
    table = hashed_counts(cut(spark.createDataFrame(rows, "task int, key long, n long")))
    assert {r.key: r.n for r in _key_rows(table).collect()} == want


def grams(rows, least, top):
    """Phrases of (lang, text) rows, counted word by word."""
    f, total = collections.defaultdict(collections.Counter), collections.Counter()
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(lower)):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for n in (1, 2, 3):
                f[lang].update(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    out = []
    for lang, c in f.items():
        found = []
        for g, a in c.items():
            if len(g) < 2 or a < least:
                continue
            if any(len(x) > len(g) and n >= least and 100 * n >= 50 * a and any(x[i : i + len(g)] == g for i in range(len(x) - len(g) + 1)) for x, n in c.items()):
                continue
            score, k = min((10**6 * a * a // (c[g[:k]] * c[g[k:]]), k) for k in range(1, len(g)))
            found.append((-score, -a, " ".join(g).encode(), a, c[g[:k]], c[g[k:]]))
        out += [(lang, r, p.decode(), a, x, y, total[lang], -s) for r, (s, _, p, a, x, y) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


def test_phrases_are_those_of_a_plain_count(spark):
    from bidspark.llm.phrases import phrases

    rng = random.Random(2)
    vocab = ["A", "b", "c", "É", "é", "d-e", "#", " x", "the", "The"]
    rows = []
    for i in range(150):
        words = rng.choices(vocab, weights=range(1, 11), k=rng.choice([0, 1, 5, 40]))
        rows.append((rng.choice(["en", "de", None, "und", "e\tn", ""]), "".join(w + rng.choice([" ", " ", " ", "\t", "  ", ", ", ".", "\n", "\r\n", " ! "]) for w in words)))
    rows += [("en", None), (None, ""), ("fr", "..."), ("one", " ".join(["x y z"] * 9_000)), ("one", " ".join(["x y z"] * 9_000))]
    df = spark.createDataFrame([(i % 7, lang, t, 1, "f", "k") for i, (lang, t) in enumerate(rows)], "doc_id long, lang string, text string, f long, phrase string, key string").repartition(5)
    for least, top in ((3, 2000), (2, 4)):
        got = phrases(df, least=least, top=top, salts=3)
        assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
        assert sorted(map(tuple, got.collect())) == grams(rows, least, top)
    assert phrases(df.limit(0)).count() == 0


@pytest.mark.parametrize("packed", [True, False])
def test_the_word_index_extends_both_ways(packed, monkeypatch):
    from bidspark.llm import phrases

    if not packed:
        plain = phrases._sorted_runs

        def slow(*keys):
            return plain(*(k.astype(np.int64) + (1 << 40) for k in keys)) if len(keys[0]) else plain(*keys)

        monkeypatch.setattr(phrases, "_sorted_runs", slow)
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 50, 2000):
        symbols, piece = rng.integers(1, 6, n), np.sort(rng.integers(0, max(n // 8, 1), n))
        index = phrases.WordIndex(phrases._sequence(symbols, piece))
        runs = [g.tolist() for g in np.split(symbols, np.flatnonzero(np.diff(piece)) + 1)] if n else []
        want = {k: collections.Counter(tuple(r[i : i + k]) for r in runs for i in range(len(r) - k + 1)) for k in (1, 2, 3)}
        word, count = index.single()
        assert dict(zip(((w,) for w in word.tolist()), count.tolist(), strict=True)) == want[1]
        first, second, count, start = index.left()
        assert dict(zip(zip(first.tolist(), second.tolist(), strict=True), count.tolist(), strict=True)) == want[2]
        owner, third, many = index.right(start, count)
        assert dict(zip(zip(first[owner].tolist(), second[owner].tolist(), third.tolist(), strict=True), many.tolist(), strict=True)) == want[3]


def test_scores_beyond_64_bits_are_exact(spark):
    from bidspark.llm.phrases import _times

    a, x, y = 9_007_199_254_740_993, 9_007_199_254_740_995, 9_007_199_254_740_999
    df = spark.createDataFrame([(a, x, y)], "a long, x long, y long")
    got = df.select(_times(F.lit(1_000_000), F.col("a"), F.col("a")).alias("over"), _times(F.col("x"), F.col("y")).alias("under")).select(F.expr("over div under").alias("s")).first().s
    assert got == 10**6 * a * a // (x * y)


#: Two words that had one hash under fixed bases.
TWINS = ("aaaabaaaabbaaaaabaaaaaaaaaaaaaaabaaaabbaaaaababaabbaabbaaaabaabaaaaaaabbbababbabbaaabbba", "aaabaabaaaababbaabbaaaabaababaaaaabbaaabbabbabaabaaabaabaababaabbaaabaaaaaaaaaaaaabbaaaa")


def test_words_of_one_hash_are_told_apart(spark):
    from bidspark.llm.bpe import bpe_digests
    from bidspark.llm.minhash import near_duplicates
    from bidspark.llm.pitman import score
    from bidspark.llm.substrings import substring_dedup

    left, right = (" ".join(f"{c}{i}" for i in range(8)) for c in "xy")
    texts = [f"{left} {w} {right}" for w in TWINS]
    df = table(spark, enumerate(texts, 1))
    assert [r["__n_removed"] for r in substring_dedup(df).collect()] == [0, 0]
    got = {r.doc_id: r.n_known for r in score(table(spark, [(1, f"{TWINS[0]} b c"), (2, f"{TWINS[1]} b c")]), F.col("doc_id") == 2).collect()}
    assert got == {1: 4, 2: 3}
    assert len({r.ids_sha256 for r in bpe_digests(df, public_tokenizers.path("word_bpe_49k.json")).collect()}) == 2
    many = table(spark, enumerate([" ".join([f"{left} {w}", *[f"z{i}" for i in range(3)]]) for w in TWINS], 1))
    assert {r.doc_id: r.class_id for r in near_duplicates(many).collect()} == {1: 1, 2: 2}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_the_queries_give_what_they_say(spark):
    from bidspark.llm.queries import ORACLE, op11_align, op12_phrases, op13_records

    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = op11_align(spark, SF)
    assert got.columns == ["doc_id", *FIELDS]
    want = {i: w for (i, _), w in zip(docs, aligned([x for _, x in docs]), strict=True)}
    assert {r[0]: tuple(r)[1:] for r in got.collect()} == want
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    assert sorted(map(tuple, op12_phrases(spark, SF).collect())) == sorted(con.execute(ORACLE["op12_phrases"]).fetchall()) != []
    out = op13_records(spark, SF).orderBy("doc_id").collect()
    assert [r.doc_id for r in out] == sorted(i for i, _ in docs) and out[0].start == 0 and all(b.start == a.start + a.n_tokens for a, b in itertools.pairwise(out))


def test_pairs_are_dealt_alike_however_they_are_sorted():
    from bidspark.llm.pitman import _dealt, _place, _unpack

    rng = np.random.default_rng(1)
    far = rng.integers(2**40, 2**63, 40).astype(np.uint64)

    def ids(n):
        r = rng.integers(0, 300, n).astype(np.uint64)
        on = rng.random(n) < 0.2
        r[on] = far[rng.integers(0, 40, int(on.sum()))]
        return r

    for n in (0, 1, 5000):
        u, k, doc = ids(n), ids(n), np.sort(rng.integers(0, 50, n))
        learn = doc % 3 > 0
        want = collections.Counter(zip(_place(u, k, 20, (4, 7)).tolist(), learn.tolist(), u.tolist(), k.tolist(), doc.tolist(), strict=True))
        for known in (300, 1 << 40):  # the second takes too many bits to be packed
            got = collections.Counter()
            for bucket, learns, blob in _dealt(u, k, doc, learn, 20, (4, 7), known):
                a, b, c, m = _unpack(blob)
                assert (np.lexsort((c, b, a)) == np.arange(len(a))).all()
                for x, y, z, t in zip(a.tolist(), b.tolist(), c.tolist(), m.tolist(), strict=True):
                    got[bucket, learns, x, y, z] += t
            assert got == want


def test_known_words_are_looked_up():
    from bidspark.llm.pitman import Model

    rng = np.random.default_rng(2)
    for n in (1, 5, 1000, 50_000):
        known = np.unique(rng.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2) + np.uint64(1))
        m = Model(known, None, None, None, None, 1, 1, 0.0, 1, 1)
        h = np.append(known[rng.integers(0, len(known), 3000)], rng.integers(0, 2**63, 3000).astype(np.uint64))
        at, hit = m.lookup(h)
        assert (hit == np.isin(h, known)).all() and (known[at[hit]] == h[hit]).all() and len(m.lookup(h[:0])[0]) == 0
    crowd = np.arange(1, 400, dtype=np.uint64)  # all in one place
    at, hit = Model(crowd, None, None, None, None, 1, 1, 0.0, 1, 1).lookup(np.arange(0, 500, dtype=np.uint64))
    assert hit.tolist() == [0 < x < 400 for x in range(500)]
