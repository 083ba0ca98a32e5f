"""Word-window chunks, vectors, top-k retrieval and evidence."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bidspark.functions import text as T
from bidspark.functions.lexicons import IGNORED_FILENAMES
from bidspark.operators.extract import extract_requirements
from bidspark.operators.relational import VERSION
from bidspark.sources.tables import staged

CHUNK_WORDS, OVERLAP_WORDS = 220, 40


def word_windows(c: Column, size: int = CHUNK_WORDS, overlap: int = OVERLAP_WORDS) -> Column:
    """Array of windows of `size` words that share `overlap` words; the last ends at the last word."""
    stride = max(size - overlap, 1)
    words = F.filter(F.split(T.blank_if_null(c), r"\s+"), lambda w: w != "")

    def windows(w: Column) -> Column:
        last = F.greatest(F.ceil((F.size(w) - size) / F.lit(float(stride))), F.lit(0)).cast("int")
        cut = F.transform(F.sequence(F.lit(0), last), lambda k: F.array_join(F.slice(w, k * stride + 1, size), " "))
        return F.when(F.size(w) > 0, cut).otherwise(F.array().cast("array<string>"))

    # the words are bound once: inside the lambda they are a value, not an expression to be evaluated for each window
    return F.transform(F.array(words), windows)[0]


def chunk_words(df: DataFrame, col: str = "text", size: int = CHUNK_WORDS, overlap: int = OVERLAP_WORDS) -> DataFrame:
    rest = [c for c in df.columns if c != col]
    return df.select(*rest, F.posexplode(word_windows(F.col(col), size, overlap)).alias("chunk_index", "chunk"))


CHUNK = ("point_id", "document_id", "project_id", "filename", "chunk_index", "chunk_kind", "requirement_type", "section_path", "section_heading", "text", "body_text")


def _chunk(df: DataFrame, index: Column, kind: str, body: Column, text: Column, requirement_type: Column | None = None) -> DataFrame:
    none = F.lit(None).cast("string")
    rows = df.withColumns({"chunk_index": index, "chunk_kind": F.lit(kind), "body_text": body, "text": text, "requirement_type": none if requirement_type is None else requirement_type})
    return rows.withColumn("point_id", T.point_id(F.col("project_id"), F.col("filename"), F.col("chunk_index"))).select(*CHUNK)


def artifact_chunks(documents: DataFrame, sections: DataFrame, tables: DataFrame | None = None, size: int = CHUNK_WORDS, overlap: int = OVERLAP_WORDS) -> DataFrame:
    """Chunks of heading texts where a document's hierarchy is strong or partial, else windows of its whole text; and
    one chunk `t-i` for each table with content, under the section that it is attached to.

    documents: document_id, project_id, filename, quality, text; sections: document_id, section_order, number and title;
    tables: document_id, table_index, rows, attached_section_id.
    """
    good = documents.where(F.col("quality").isin("strong", "partial"))
    s = sections.where("section_order is not null").withColumn("i", F.row_number().over(Window.partitionBy("document_id").orderBy("section_order")) - 1)
    title = F.coalesce(F.when(F.col("section_title") != "", F.col("section_title")), F.lit("Section"))
    s = s.select("document_id", "i", T.strip(F.concat_ws(" ", T.blank_if_null("section_number"), title)).alias("section_heading"), F.coalesce(F.when(F.col("section_number") != "", F.col("section_number")), title).alias("section_path"))
    heads = good.drop("text").join(s, "document_id").withColumn("w", word_windows(F.col("section_heading"), size, overlap))
    heads = heads.select("*", F.posexplode("w").alias("j", "c"))
    a = _chunk(heads, F.concat_ws("-", F.lit("s"), F.col("i").cast("string"), F.col("j").cast("string")), "section", F.col("c"), F.concat(F.lit("Section Heading: "), "section_heading", F.lit("\n\n"), "c"))
    plain = documents.join(good.select("document_id").join(s.select("document_id").distinct(), "document_id"), "document_id", "left_anti")
    pages = plain.withColumns({"section_path": F.lit("DOCUMENT"), "section_heading": F.lit("Document Body")}).select("*", F.posexplode(word_windows(T.clean_extracted_text(F.col("text")), size, overlap)).alias("j", "c"))
    out = a.unionByName(_chunk(pages, F.concat_ws("-", F.lit("p"), F.col("j").cast("string")), "page_window", F.col("c"), F.col("c")))
    if tables is None:
        return out
    lines = F.transform(F.filter("rows", lambda r: F.size(r) > 0), lambda r: F.array_join(r, " | ", ""))
    place = F.when(F.col("attached_section_id") != "", F.col("attached_section_id"))
    t = tables.select("document_id", "table_index", T.strip(F.array_join(lines, "\n")).alias("c"), F.coalesce(place, F.lit("DOCUMENT")).alias("section_path"), F.coalesce(place, F.lit("Document Body")).alias("section_heading"))
    t = t.where("c <> ''").join(documents.select("document_id", "project_id", "filename"), "document_id")
    return out.unionByName(_chunk(t, F.concat_ws("-", F.lit("t"), F.col("table_index").cast("string")), "table", F.col("c"), F.concat(F.lit("Table Content\n\n"), "c")))


def section_chunks(sections: DataFrame, tables: DataFrame | None = None, size: int = CHUNK_WORDS, overlap: int = OVERLAP_WORDS) -> DataFrame:
    """Body windows `i-j`, requirement chunks `i-r-k` and table windows `t-i-j`, each with its path and heading before it."""
    prefix = F.concat(F.lit("Section Path: "), "section_path", F.lit("\nSection Heading: "), "section_heading", F.lit("\n\n"))
    i = F.col("section_index").cast("string")
    body = sections.withColumn("w", word_windows(F.col("body_text"), size, overlap)).drop("body_text").select("*", F.posexplode("w").alias("j", "c"))
    out = _chunk(body, F.concat_ws("-", i, F.col("j").cast("string")), "section", F.col("c"), F.concat(prefix, "c"))
    req = extract_requirements(sections)
    out = out.unionByName(_chunk(req, F.concat_ws("-", i, F.lit("r"), F.col("requirement_index").cast("string")), "requirement", F.col("requirement_text"), F.concat(prefix, "requirement_text"), F.col("requirement_type")))
    if tables is not None:
        t = tables.withColumn("w", word_windows(F.col("body_text"), size, overlap)).drop("body_text").select("*", F.posexplode("w").alias("j", "c"))
        out = out.unionByName(_chunk(t, F.concat_ws("-", F.lit("t"), F.col("table_index").cast("string"), F.col("j").cast("string")), "table", F.col("c"), F.concat(prefix, "c")))
    return out


def hashing_provider(dims: int = 64) -> Callable[[list[str]], np.ndarray]:
    """A deterministic stand-in for an embedding model: signed word counts in hashed coordinates, unit length."""
    import zlib

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dims), np.float32)
        for k, t in enumerate(texts):
            h = np.fromiter((zlib.crc32(w.encode()) for w in t.lower().split()), np.int64)
            out[k] = np.bincount(h % dims, np.where(h & 0x80000000, 1.0, -1.0), dims)
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)

    return embed


def embed_chunks(chunks: DataFrame, provider: Callable[[], Callable[[list[str]], np.ndarray]] = hashing_provider, batch: int = 256) -> DataFrame:
    """Adds `vector`; the provider is made once per task and gets batches of texts."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        embed = provider()
        for s in batches:
            texts = s.fillna("").tolist()
            yield pd.Series([v for k in range(0, len(texts), batch) for v in embed(texts[k : k + batch])])

    return chunks.withColumn("vector", F.pandas_udf(run, "array<float>")("text"))


def check_dimensions(chunks: DataFrame) -> DataFrame:
    """(dims, n): one row if all vectors have one size."""
    return chunks.groupBy(F.size("vector").alias("dims")).agg(F.count("*").alias("n"))


def refresh_index(index: DataFrame, fresh: DataFrame) -> DataFrame:
    """All points of re-indexed files give way to the fresh ones; of equal point ids one stays."""
    kept = index.join(fresh.select(*VERSION).distinct(), [*VERSION], "left_anti")
    return kept.unionByName(fresh.dropDuplicates(["point_id"]))


def cosine(a: str, b: str) -> Column:
    d = lambda x: x.cast("double")
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: d(x) * d(y)), F.lit(0.0), lambda s, x: s + x)
    norm = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, x: s + d(x) * d(x)))
    return F.coalesce(dot / F.nullif(norm(a) * norm(b), F.lit(0.0)), F.lit(0.0))


PART = 4096  # points, and queries, that are multiplied at once
PIVOTS = 64  # cells of a project at most, about
SLACK = 1e-9  # scores are compared after rounding to nine places


def _unit(col: pa.ChunkedArray | pa.Array, dims: int) -> np.ndarray:
    """Vectors as rows of unit length; null, zero and not finite ones, and those of other sizes, are zero."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    flat = col.flatten()
    if not col.null_count and not flat.null_count and (np.diff(np.asarray(col.offsets)) == dims).all():
        out = np.asarray(flat).reshape(len(col), dims).astype(float)
    else:
        out = np.zeros((len(col), dims))
        for k, v in enumerate(col.to_pylist()):
            if v is not None and len(v) == dims and None not in v:
                out[k] = v
    size = np.linalg.norm(out, axis=1, keepdims=True)
    return np.where((size > 0) & np.isfinite(size), out / np.where(size > 0, size, 1), 0.0)


def _dims(*tables: pa.Table, of: str = "vector") -> int:
    return max((len(v) for t in tables for v in t.column(of).slice(0, 64).to_pylist() if v is not None), default=0)


def _dealt(points: DataFrame, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Points of the queries' projects with n (the project's points) and part, and queries with their part: parts are of PART rows
    about, so no task holds a project."""
    asked = queries.groupBy("project_id").agg(F.ceil(F.count("*") / PART).cast("int").alias("q_parts"))
    sizes = points.groupBy("project_id").agg(F.count("*").alias("n")).join(asked, "project_id")
    own = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    p = points.join(sizes, "project_id").withColumn("parts", F.ceil(F.col("n") / PART).cast("int")).withColumn("part", own("point_id", "parts"))
    return p, queries.join(asked, "project_id").withColumn("q_part", own("query_id", "q_parts"))


def cells(points: DataFrame) -> DataFrame:
    """Points with the pivot whose vector is nearest (pivot, near: the cosine): about one in every PART points of a project is a pivot,
    and PIVOTS of them at most. points: as `_dealt` returns them."""
    step = F.ceil(F.col("n") / F.least(F.ceil(F.col("n") / PART), F.lit(PIVOTS)))
    pivots = points.where(F.pmod(F.xxhash64("point_id", F.lit(7)), step) == 0).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    pivots = pivots.select(F.col("project_id").alias("at"), F.col("part").alias("at_part"), F.col("point_id").alias("pivot_id"), F.col("vector").alias("pivot_vector"))

    def nearest(key: tuple, rows: pa.Table, p: pa.Table) -> pa.Table:
        dims = max(_dims(rows), _dims(p, of="pivot_vector"))
        ids = p.column("pivot_id").to_pylist()
        order = sorted(range(len(ids)), key=ids.__getitem__)
        if not order or not dims or not rows.num_rows:  # no pivot fell into the project: one cell that is never skipped
            pivot, near = [""] * rows.num_rows, np.full(rows.num_rows, -1.0)
        else:
            score = _unit(rows.column("vector"), dims) @ _unit(p.column("pivot_vector"), dims)[order].T
            best = score.argmax(1)
            pivot, near = [ids[order[k]] for k in best], score[np.arange(len(best)), best]
        return rows.append_column("pivot", pa.array(pivot, pa.string())).append_column("near", pa.array(near, pa.float64()))

    kept = points.select("project_id", "part", "point_id", "vector", "q_parts")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept.schema)
    return kept.groupBy("project_id", "part").cogroup(pivots.groupBy("at", "at_part")).applyInArrow(nearest, f"{kinds}, pivot string, near double")


def _cut(dealt: DataFrame) -> DataFrame:
    """Points of a cell in parts of PART about, whatever the size of its project."""
    sizes = dealt.groupBy("project_id", "pivot").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))
    return dealt.drop("part").join(sizes, ["project_id", "pivot"]).withColumn("part", F.pmod(F.xxhash64("point_id"), F.col("parts")).cast("int")).drop("parts")


def _best(points: DataFrame, asks: DataFrame, top_k: int) -> DataFrame:
    """(query_id, project_id, pivot, point_id, score): the top_k points of each part of a cell for each query that asks the cell.

    points: as `cells` returns them; asks: query_id, project_id, pivot, q_part, parts, vector and, if known, least: a score that top_k
    points reach, below which none counts.
    """
    p = points.withColumn("q_part", F.explode(F.sequence(F.lit(0), F.col("q_parts") - 1)))
    q = asks.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    by = ["project_id", "pivot", "part", "q_part"]
    kind = dict(asks.dtypes)["query_id"]
    shape = f"query_id {kind}, project_id string, pivot string, point_id string, score double"

    def product(key: tuple, rows: pa.Table, ask: pa.Table) -> pa.Table:
        ids = np.array(rows.column("point_id").to_pylist(), object)
        dims = max(_dims(rows), _dims(ask, of="q_vector"))
        i, j, said = np.zeros(0, int), np.zeros(0, int), np.zeros(0)
        if len(ids) and ask.num_rows and dims:
            score = _unit(ask.column("q_vector"), dims) @ _unit(rows.column("vector"), dims).T
            least, k = np.array(ask.column("least").to_pylist(), float), min(top_k, len(ids))
            free = np.flatnonzero(np.isnan(least))
            least[free] = np.partition(score[free], len(ids) - k, axis=1)[:, len(ids) - k] if len(free) else 0
            i, j = np.nonzero(score >= least[:, None] - 2 * SLACK)
            place = np.empty(len(ids), int)
            place[np.argsort(ids.astype(str), kind="stable")] = np.arange(len(ids))
            order = np.lexsort((place[j], -np.round(score[i, j], 9), i))
            i, j = i[order], j[order]
            kept = np.arange(len(i)) - np.searchsorted(i, i) < k
            i, j = i[kept], j[kept]
            said = score[i, j]
        cols = {"query_id": ask.column("query_id").take(pa.array(i, pa.int64())), "project_id": [key[0].as_py()] * len(i), "pivot": [key[1].as_py()] * len(i), "point_id": ids[j].tolist(), "score": said}
        return pa.table(cols, pa.schema([("query_id", ask.schema.field("query_id").type), ("project_id", pa.string()), ("pivot", pa.string()), ("point_id", pa.string()), ("score", pa.float64())]))

    p, q = p.select(*by, "point_id", "vector"), q.select(*[F.col(c).alias(f"q_{c}") for c in by], "query_id", F.col("vector").alias("q_vector"), F.col("least") if "least" in q.columns else F.lit(None).cast("double").alias("least"))
    return p.groupBy(*by).cogroup(q.groupBy(*[f"q_{c}" for c in by])).applyInArrow(product, shape)


def _asked_cells(queries: DataFrame, dealt: DataFrame, points: DataFrame) -> DataFrame:
    """(query_id, project_id, pivot, q_part, parts, vector, bound): each query with the cells of its project and the best score that
    any point of the cell can have. The angle between query and point is at least that between query and pivot less the cell's
    widest, so its cosine is at most `bound`."""
    wide = dealt.groupBy("project_id", "pivot").agg(F.min("near").alias("near"), (F.max("part") + 1).alias("parts"))
    at = points.select("project_id", F.col("point_id").alias("pivot"), F.col("vector").alias("pivot_vector"))
    wide = wide.join(at, ["project_id", "pivot"], "left")
    pairs = queries.join(wide, "project_id").withColumn("c", F.coalesce(cosine("vector", "pivot_vector"), F.lit(0.0)))
    angle = lambda c: F.acos(F.least(F.greatest(c, F.lit(-1.0)), F.lit(1.0)))
    free = F.cos(F.greatest(angle(F.col("c")) - angle(F.col("near")), F.lit(0.0)))
    # vectors of length zero score 0 everywhere, and stand in the cell of any pivot
    bound = F.when(F.col("pivot_vector").isNull(), 1.0).otherwise(F.greatest(free, F.lit(0.0)))
    return pairs.select("query_id", "project_id", "pivot", "q_part", "parts", "vector", bound.alias("bound"))


def retrieve(index: DataFrame, queries: DataFrame, top_k: int = 5, chunk_kind: str | None = None) -> DataFrame:
    """The top_k chunks by cosine of each query within its project, ties (to nine places) to the smaller point id; exact.

    queries: query_id, project_id, query_vector. A project's points are dealt to cells around pivots. Every query first looks at the
    cell that may hold the best points; what it finds there is a score that a point must reach, and cells that can hold no such
    point are skipped. Cells are cut into parts, and a part's scores are one product of matrices, so no task holds a project. Null and
    zero vectors score 0. point_id is a key of the index.
    """
    return _retrieved(index, queries, top_k, chunk_kind)[0]


def retrieval_cells(index: DataFrame, queries: DataFrame, top_k: int = 5, chunk_kind: str | None = None) -> DataFrame:
    """(query_id, cells, looked_at): of the cells of its project those that `retrieve` looks at for a query."""
    return _retrieved(index, queries, top_k, chunk_kind)[1]


def _retrieved(index: DataFrame, queries: DataFrame, top_k: int, chunk_kind: str | None) -> tuple[DataFrame, DataFrame]:
    live = index if chunk_kind is None else index.where(F.col("chunk_kind") == chunk_kind)
    points, asked = _dealt(live.select("project_id", "point_id", "vector"), queries.select("query_id", "project_id", F.col("query_vector").alias("vector")))
    dealt = _cut(staged(cells(points)))
    asks = staged(_asked_cells(asked, dealt, live))
    order = Window.partitionBy("query_id").orderBy(F.desc("bound"), "pivot")
    ranked = asks.withColumn("r", F.row_number().over(order))
    shown = F.round("score", 9)
    top = Window.partitionBy("query_id").orderBy(F.desc(shown), "point_id")
    cut = lambda df: df.withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= top_k)
    first = staged(cut(_best(dealt, ranked.where("r = 1").drop("r", "bound"), top_k)).drop("rank"))
    reached = first.groupBy("query_id").agg(F.count("*").alias("k"), F.min(shown).alias("least"))
    more = ranked.where("r > 1").join(reached, "query_id", "left").where((F.coalesce("k", F.lit(0)) < top_k) | (F.col("bound") >= F.col("least") - SLACK))
    found = first.unionByName(_best(dealt, more.withColumn("least", F.when(F.col("k") >= top_k, F.col("least"))).drop("r", "bound", "k"), top_k))
    best = cut(found).select("query_id", "project_id", "point_id", "score", "rank")
    rows = live.drop("vector").join(best, ["project_id", "point_id"])
    extra = [c for c in queries.columns if c not in ("query_id", "project_id", "query_vector")]
    if extra:
        rows = rows.join(queries.select("query_id", *extra), "query_id")
    looked = more.select("query_id").unionByName(ranked.where("r = 1").select("query_id")).groupBy("query_id").agg(F.count("*").alias("looked_at"))
    return rows.select(*[c for c in index.columns if c != "vector"], "query_id", *extra, "score", "rank"), asks.groupBy("query_id").agg(F.count("*").alias("cells")).join(looked, "query_id")


def package_evidence(matches: DataFrame, pattern: str | None = None, max_matches: int = 30) -> DataFrame:
    """Matches of a project's queries, once each: clean documents first, then by priority and name; a bounded list.

    matches: project_id, query_id, rank, filename, chunk_index, text.
    """
    needle = (pattern or "").replace("%", "").lower()
    rows = matches if not needle else matches.where(F.lower(T.blank_if_null("filename")).contains(needle))
    rows = rows.withColumns({"noisy": T.is_noisy_doc(F.col("filename")), "priority": T.doc_priority(F.col("filename")), "lower_name": F.lower(T.blank_if_null("filename"))})
    key = [T.blank_if_null(c) for c in ("filename", "chunk_index", "text")]
    order = [F.col("noisy"), F.col("priority"), F.col("lower_name"), F.col("query_id"), F.col("rank")]
    once = rows.withColumn("r", F.row_number().over(Window.partitionBy("project_id", *key).orderBy(*order))).where("r = 1")
    best = once.withColumn("position", F.row_number().over(Window.partitionBy("project_id").orderBy(*order)))
    return best.where(F.col("position") <= max_matches).drop("r", "lower_name", "noisy", "priority")


def context_block(matches: DataFrame, limit: int = 700) -> DataFrame:
    """(project_id, context): numbered evidence text of each project."""
    line = F.concat(F.lit("["), F.col("position").cast("string"), F.lit("] "), T.blank_if_null("filename"), F.lit("\n"), T.compact_text(F.col("text"), limit))
    rows = matches.select("project_id", F.struct("position", line.alias("x")).alias("s"))
    return rows.groupBy("project_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["x"]), "\n\n").alias("context"))


def citations(matches: DataFrame) -> DataFrame:
    return matches.select("project_id", "position", "filename", "chunk_index", "chunk_kind").orderBy("project_id", "position")


def documents_considered(matches: DataFrame) -> DataFrame:
    return matches.where(T.blank_if_null("filename") != "").select("project_id", "filename").distinct()


def latest_questions(conversations: DataFrame) -> DataFrame:
    """Last user turn of each conversation, if it is not blank."""
    last = conversations.where("role = 'user'").groupBy("conv_id").agg(F.max(F.struct("turn", "text")).alias("x"))
    return last.select("conv_id", "x.turn", F.col("x.text").alias("question")).where(T.strip(T.blank_if_null("question")) != "")


def chat_evidence(questions: DataFrame, index: DataFrame, top_k: int = 8) -> DataFrame:
    """Matches for each question (query_id, project_id, query_vector); ignored files aside."""
    return retrieve(index, questions, top_k).where(~F.lower(T.blank_if_null("filename")).isin(*IGNORED_FILENAMES))
