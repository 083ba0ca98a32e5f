"""The registered queries of the training-data operators over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bidspark.llm.common import fold, table

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Where the installed public tokenizer file lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class of every document (its smallest doc_id), and whether the document stays."""
    from bidspark.llm.minhash import near_duplicates

    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "copies_of", "class_id", (F.col("doc_id") == F.col("class_id")).alias("kept"))


def op2_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays of every document when passages of earlier documents are removed."""
    from bidspark.llm.substrings import substring_dedup

    out = substring_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("__n_words").alias("n_words"), F.col("__n_removed").alias("n_removed"), F.sha2("__kept", 256).alias("kept_sha256"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; labels of the rows held out are never looked at."""
    from bidspark.llm.toxicity import score_toxicity, train_toxicity

    docs, held = table(spark, sf_dir, "documents"), fold(F.col("doc_id"), 5) == 0
    model = train_toxicity(docs, table(spark, sf_dir, "labels"), ~held)
    return score_toxicity(docs, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's url by rules, else by trust and distrust of its host."""
    from bidspark.llm.urls import judge

    return judge(table(spark, sf_dir, "pages"))


def op5_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-probability of every document under the model of those not held out."""
    from bidspark.llm.pitman import score

    return score(table(spark, sf_dir, "documents"), fold(F.col("doc_id"), 10) == 0)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents taken for a mix of half the corpus's tokens, of two epochs at most."""
    from bidspark.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents"), F.floor(F.col("total") / 2), max_epochs=2, seed=1)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document; labels of the rows held out are never looked at."""
    from bidspark.llm.quality import score_quality, train_quality

    docs, held = table(spark, sf_dir, "documents"), fold(F.col("doc_id"), 4) == 2
    model = train_quality(docs, table(spark, sf_dir, "labels"), ~held)
    return score_quality(docs, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded; ids and text as digests."""
    from bidspark.llm.bpe import bpe_digests

    return bpe_digests(table(spark, sf_dir, "documents"), tokenizer_path())


def op9_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of every embedding at cosine 0.9."""
    from bidspark.llm.caps import embedding_duplicates

    return embedding_duplicates(table(spark, sf_dir, "embeddings"))


def op10_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every twentieth embedding."""
    from bidspark.llm.ann import nearest

    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


def op11_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens under two tokenizers aligned, with the corpus-wide counts of its linked ids."""
    from bidspark.llm.align import align

    out = align(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2,000 strongest collocations of every language."""
    from bidspark.llm.phrases import phrases

    return phrases(table(spark, sf_dir, "documents"))


def op13_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids written to record files and read back: where they stand, how many, their checksum."""
    from bidspark.llm.records import record_digests

    return record_digests(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def _mixing_sql(documents: str, budget: str, max_epochs: int, seed: int) -> str:
    """DuckDB SQL of `mix`: (doc_id, domain, lang, source, n_tokens, copies)."""
    from bidspark.llm.mixing import LEVELS, WEIGHTS

    parts = [
        f"""leaf_docs AS (SELECT doc_id, 'd' || CAST(coalesce(TRY_CAST(regexp_extract(coalesce(source, ''), '([0-9]{{1,9}})$', 1) AS INTEGER), 0) % 4 AS VARCHAR) AS domain,
            coalesce(lang, '') AS lang, coalesce(source, '') AS source,
            CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS n_tokens FROM {documents})""",
        f"leaf_sizes AS (SELECT domain, lang, source, CAST(sum(n_tokens) AS BIGINT) AS tokens, CAST(sum(n_tokens) AS BIGINT) * {max_epochs} AS cap FROM leaf_docs GROUP BY ALL)",
        f"share0 AS (SELECT CAST({budget} AS BIGINT) AS share FROM (SELECT coalesce(sum(tokens), 0) AS total FROM leaf_sizes))",
    ]
    for k, level in enumerate(LEVELS):
        node, above = ", ".join(LEVELS[: k + 1]), ", ".join(LEVELS[:k])
        weight = "CASE " + level + "".join(f" WHEN '{n}' THEN {w}" for n, w in WEIGHTS[level].items()) + " ELSE 1 END" if WEIGHTS[level] else "1"
        by = f"PARTITION BY {above}" if above else ""
        link = f"JOIN share{k} USING ({above})" if above else f"CROSS JOIN share{k}"
        parts += [
            f"child{k} AS (SELECT {node}, CAST(sum(cap) AS BIGINT) AS cap, CAST({weight} AS BIGINT) AS w FROM leaf_sizes GROUP BY {node})",
            f"run{k} AS (SELECT *, sum(cap) OVER ({by} ORDER BY cap / w, {level} ROWS UNBOUNDED PRECEDING) AS c_to, sum(w) OVER ({by} ORDER BY cap / w, {level} ROWS UNBOUNDED PRECEDING) AS w_to, sum(w) OVER ({by}) AS w_all FROM child{k} {link})",
            f"full{k} AS (SELECT *, cap * (w_all - w_to + w) <= w * (share - c_to + cap) AS is_full FROM run{k})",
            f"sums{k} AS (SELECT *, sum(CASE WHEN is_full THEN cap ELSE 0 END) OVER ({by}) AS c_full, sum(CASE WHEN is_full THEN w ELSE 0 END) OVER ({by}) AS w_full FROM full{k})",
            f"share{k + 1} AS (SELECT {node}, CAST(CASE WHEN is_full THEN cap ELSE greatest(w * (share - c_full), 0) // greatest(w_all - w_full, 1) END AS BIGINT) AS share FROM sums{k})",
        ]
    parts += [
        f"leaves AS (SELECT domain, lang, source, tokens, share, CASE WHEN share <= 0 THEN 0 WHEN tokens > 0 THEN least(share // tokens, {max_epochs}) ELSE {max_epochs} END AS epochs FROM leaf_sizes JOIN share{len(LEVELS)} USING (domain, lang, source))",
        f"keyed AS (SELECT d.*, epochs, CASE WHEN epochs >= {max_epochs} THEN 0 ELSE share - epochs * tokens END AS rest, sha256('{seed}:' || CAST(epochs + 1 AS VARCHAR) || ':' || coalesce(CAST(doc_id AS VARCHAR), '')) AS k FROM leaf_docs d JOIN leaves USING (domain, lang, source))",
        "ranked AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY k RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM keyed)",
        "mixed AS (SELECT doc_id, domain, lang, source, n_tokens, CAST(epochs + CASE WHEN rest > 0 AND upto <= rest THEN 1 ELSE 0 END AS BIGINT) AS copies FROM ranked)",
    ]
    return "WITH " + ",\n".join(parts) + "\nSELECT * FROM mixed WHERE copies > 0"


PHRASES_SQL = r"""WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
starts AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM words),
grams AS (SELECT lang, array_to_string(w[i:i + k - 1], ' ') AS phrase, k, CAST(count(*) AS BIGINT) AS f
  FROM starts, (VALUES (1), (2), (3)) AS sizes(k) WHERE i + k - 1 <= len(w) GROUP BY ALL),
totals AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM grams WHERE k = 1 GROUP BY lang),
cand AS (SELECT lang, phrase, k, f, string_split(phrase, ' ') AS w FROM grams WHERE k > 1 AND f >= 10),
cuts AS (SELECT lang, phrase, k, f, unnest(range(1, k)) AS c, w FROM cand),
scored AS (SELECT x.lang, x.phrase, x.k, x.f, x.c, a.f AS l, b.f AS r, CAST((1000000::HUGEINT * x.f * x.f) // (a.f::HUGEINT * b.f) AS BIGINT) AS score
  FROM cuts x JOIN grams a ON a.lang = x.lang AND a.phrase = array_to_string(x.w[1:x.c], ' ')
  JOIN grams b ON b.lang = x.lang AND b.phrase = array_to_string(x.w[x.c + 1:], ' ')),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1),
longer AS (SELECT lang, phrase, max(f) AS f FROM (
  SELECT lang, array_to_string(w[1:2], ' ') AS phrase, f FROM cand WHERE k = 3 UNION ALL SELECT lang, array_to_string(w[2:3], ' '), f FROM cand WHERE k = 3) GROUP BY ALL),
kept AS (SELECT b.* FROM best b LEFT JOIN longer g ON g.lang = b.lang AND g.phrase = b.phrase WHERE g.f IS NULL OR 100 * g.f < 50 * b.f)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, f AS a, l, r, n, score FROM (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, f DESC, phrase) AS rank FROM kept) JOIN totals USING (lang) WHERE rank <= 2000"""

QUERIES: dict[str, Query] = {
    "op1_minhash": op1_minhash,
    "op2_substrings": op2_substrings,
    "op3_toxicity": op3_toxicity,
    "op4_urls": op4_urls,
    "op5_lm": op5_lm,
    "op6_mixing": op6_mixing,
    "op7_quality": op7_quality,
    "op8_bpe": op8_bpe,
    "op9_caps": op9_caps,
    "op10_ann": op10_ann,
    "op11_align": op11_align,
    "op12_phrases": op12_phrases,
    "op13_records": op13_records,
}
ORACLE: dict[str, str] = {"op6_mixing": _mixing_sql("documents", "total // 2", 2, 1), "op12_phrases": PHRASES_SQL}
