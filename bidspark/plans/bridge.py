"""Views that make the given tables speak this domain, with the same formulas in Spark and in DuckDB SQL.

The given texts are invented prose without headings, markings or obligations; the views add them by the
documents' ids over whole tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FILENAMES = ("TO1 PWS.docx", "Section L.docx", "Section M.docx", "Appendix A.docx", "Pricing Template.xlsx", "Base IDIQ PWS.docx", "project.json", "notes.pdf")
PREFIXES = ("The Contractor shall submit ", "The Government must ", "Offerors are required to provide ", "The COR will evaluate ", "Clearance: ", "Deliverable: ", "Due no later than ", "See section 1.3 and Appendices A - C for ", "")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt by `keys`: a file of few row groups gives few tasks, and the steps over texts should take all. What follows by the same
    keys needs no further shuffle, and several readers share the one."""
    return df.repartition(*keys)


def _pick(items: tuple[str, ...], k: Column) -> Column:
    return F.get(F.array(*map(F.lit, items)), k.cast("int"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    return read(spark, sf_dir, "documents").select(
        "doc_id", F.concat(F.lit("doc-"), d).alias("id"), F.concat(F.lit("doc-"), d).alias("document_id"), F.coalesce("source", F.lit("")).alias("project_id"), _pick(FILENAMES, F.floor(d / 20) % 8).alias("filename"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("content_sha256"), F.when(d % 17 == 0, "failed").otherwise("extracted").alias("extraction_status"), F.timestamp_seconds(F.lit(1704067200) + d * 60).alias("created_at"), F.col("text").alias("extracted_text")
    )


def prefixed(text: Column, doc_id: Column) -> Column:
    p = _pick(PREFIXES, doc_id % 9)
    return F.concat(p, F.regexp_replace(F.coalesce(text, F.lit("")), F.lit(r"([.!?])\s+([A-Z])"), F.concat(F.lit("$1 "), p, F.lit("$2"))))


def normalizations(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir).withColumn("normalized_markdown", prefixed(F.col("extracted_text"), F.col("doc_id"))).where("doc_id % 5 <> 0")
    keep = ["document_id", "project_id", "filename", "doc_id", "normalized_markdown"]
    new = d.select(*keep, F.concat(F.lit("n1-"), "doc_id").alias("id"), F.when(F.expr("doc_id % 3 = 0"), "docling_pws").otherwise("docling").alias("provider"), F.when(F.expr("doc_id % 7 = 0"), "failed").otherwise("normalized").alias("normalization_status"), F.when(F.expr("doc_id % 11 = 0"), "stale").otherwise(F.col("content_sha256")).alias("content_sha256"), F.timestamp_seconds(F.lit(1706745600) + F.col("doc_id") * 60).alias("updated_at"))
    old = d.where("doc_id % 4 = 0").select(*keep, F.concat(F.lit("n0-"), "doc_id").alias("id"), F.lit("docling").alias("provider"), F.lit("normalized").alias("normalization_status"), "content_sha256", F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 60).alias("updated_at"))
    return new.unionByName(old)


def _sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(documents(spark, sf_dir), "document_id").select(
        "project_id", "filename", "document_id", "doc_id", F.lit("docling").alias("provider"), "content_sha256", (F.col("doc_id") % 4).alias("section_index"), F.when(F.expr("doc_id % 5 = 0"), "DOCUMENT").otherwise(F.concat(F.lit("L."), F.col("doc_id") % 6)).alias("section_path"), F.when(F.expr("doc_id % 3 = 0"), "Document Body").otherwise(F.concat(F.lit("Heading "), F.col("doc_id") % 10)).alias("section_heading"), "extracted_text"
    )


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sections(spark, sf_dir).withColumn("body_text", prefixed(F.col("extracted_text"), F.col("doc_id"))).drop("extracted_text")


def tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text of the sections' tables: the lines of each document, each with the document's prefix."""
    p = _pick(PREFIXES, F.col("doc_id") % 9)
    text = F.concat(p, F.regexp_replace(F.coalesce("extracted_text", F.lit("")), F.lit("\n"), F.concat(F.lit("\n"), p)))
    return _sections(spark, sf_dir).withColumn("body_text", text).withColumnRenamed("section_index", "table_index").drop("extracted_text")


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents; every third is a heading numbered k.0, k.1, k.3, k.3.1, every seventh of those an appendix."""
    texts = read(spark, sf_dir, "documents").select(F.concat(F.lit("doc-"), "doc_id").alias("document_id"), F.coalesce("source", F.lit("")).alias("project_id"), "text")
    rows = spread(texts, "document_id").select("document_id", "project_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("document_order", "line"))
    rows = rows.withColumns({"is_head": F.expr("document_order % 3 = 0"), "i": F.expr("document_order div 3")}).withColumn("k", F.expr("cast(i div 4 + 1 as string)"))
    app = F.expr("is_head and i % 7 = 6")
    number = F.concat("k", F.get(F.array(*map(F.lit, (".0", ".1", ".3", ".3.1"))), (F.col("i") % 4).cast("int")))
    token = F.when(app, F.concat(F.lit("APPENDIX "), F.char(65 + F.col("i") % 26))).when(F.col("is_head"), number)
    level = F.when(app, 1).when(F.col("is_head"), F.get(F.array(*map(F.lit, (1, 2, 2, 3))), (F.col("i") % 4).cast("int")))
    title = F.when(F.col("is_head"), F.regexp_extract("line", r"^(\S+(?: \S+){0,3})", 1))
    rows = rows.withColumns({"numbering_token": token, "heading_level": level, "heading_title": title})
    return rows.select("document_id", "project_id", "document_order", F.when(app, "appendix_heading").when(F.col("is_head"), "heading").otherwise("paragraph").alias("block_type"), "numbering_token", "heading_level", "heading_title", F.when(app, "APPENDIX").when(F.col("is_head"), "MAIN").alias("tree_kind"), F.when(F.col("is_head"), F.concat_ws(" ", "numbering_token", "heading_title")).otherwise(F.col("line")).alias("normalized_text"))


def grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One table per brand of part: a header and a row per part, in order of the key; page is the least size."""
    part = read(spark, sf_dir, "part").select(F.col("p_brand").alias("document_id"), "p_partkey", "p_size", F.array("p_name", "p_type", F.col("p_size").cast("string"), F.when(F.expr("p_partkey % 2 = 0"), "The Contractor shall deliver").otherwise("none")).alias("row"))
    lists = part.groupBy("document_id").agg(F.min("p_size").alias("page_start"), F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "row"))), lambda s: s["row"]).alias("body"))
    return lists.select("document_id", F.concat("document_id", F.lit(":table:0")).alias("block_id"), "page_start", F.lit("DOCUMENT").alias("heading_path"), F.concat(F.array(F.array(*map(F.lit, ("name", "type", "size")))), "body").alias("rows"))


def requirements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One requirement per document: its whole text, each sentence behind the document's prefix."""
    d = documents(spark, sf_dir)
    return d.select(
        F.col("id"), "project_id", "document_id", "filename", F.concat((F.col("doc_id") % 3 + 1).cast("string"), F.lit("."), (F.col("doc_id") % 4).cast("string")).alias("section_number"), F.concat(F.lit("Heading "), F.col("doc_id") % 10).alias("section_heading"), F.lit("").alias("heading_path"), prefixed(F.col("extracted_text"), F.col("doc_id")).alias("requirement_text"), F.get(F.array(*map(F.lit, ("shall", "must", "will"))), (F.col("doc_id") % 3).cast("int")).alias("modality"), F.when(F.expr("doc_id % 2 = 0"), "contractor").alias("actor"), F.lit(None).cast("string").alias("action"), F.lit(None).cast("string").alias("object_text"), "doc_id"
    )


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("vec_id")
    kind = _pick(("section", "requirement", "table"), v % 3)
    return read(spark, sf_dir, "embeddings").select(F.concat(F.lit("p-"), v).alias("point_id"), F.coalesce(F.col("label").cast("string"), F.lit("")).alias("project_id"), kind.alias("chunk_kind"), _pick(FILENAMES, F.floor(v / 3) % 8).alias("filename"), F.concat(F.lit("c-"), v % 50).alias("chunk_index"), F.concat(F.lit("text "), v % 40).alias("text"), F.col("embedding").alias("vector"), "vec_id")


def _list(items: tuple[str, ...]) -> str:
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in items) + "]"


#: The same views as common table expressions of DuckDB SQL.
SQL = f"""WITH b_documents AS (SELECT doc_id, 'doc-' || doc_id AS id, 'doc-' || doc_id AS document_id, coalesce(source, '') AS project_id, ({_list(FILENAMES)})[CAST((doc_id // 20) % 8 + 1 AS INTEGER)] AS filename,
  sha256(coalesce(text, '')) AS content_sha256, CASE WHEN doc_id % 17 = 0 THEN 'failed' ELSE 'extracted' END AS extraction_status, doc_id AS created_at, text AS extracted_text,
  ({_list(PREFIXES)})[CAST(doc_id % 9 + 1 AS INTEGER)] AS prefix FROM documents),
b_body AS (SELECT *, prefix || regexp_replace(coalesce(extracted_text, ''), '([.!?])\\s+([A-Z])', '\\1 ' || prefix || '\\2', 'g') AS body_text FROM b_documents),
b_normalizations AS (SELECT document_id, project_id, filename, doc_id, 'n1-' || doc_id AS id, CASE WHEN doc_id % 3 = 0 THEN 'docling_pws' ELSE 'docling' END AS provider, CASE WHEN doc_id % 7 = 0 THEN 'failed' ELSE 'normalized' END AS normalization_status,
  CASE WHEN doc_id % 11 = 0 THEN 'stale' ELSE content_sha256 END AS content_sha256, doc_id + 44640 AS updated_at FROM b_documents WHERE doc_id % 5 <> 0
  UNION ALL SELECT document_id, project_id, filename, doc_id, 'n0-' || doc_id, 'docling', 'normalized', content_sha256, doc_id FROM b_documents WHERE doc_id % 5 <> 0 AND doc_id % 4 = 0),
b_sections AS (SELECT project_id, filename, document_id, doc_id, 'docling' AS provider, content_sha256, doc_id % 4 AS section_index, CASE WHEN doc_id % 5 = 0 THEN 'DOCUMENT' ELSE 'L.' || (doc_id % 6) END AS section_path,
  CASE WHEN doc_id % 3 = 0 THEN 'Document Body' ELSE 'Heading ' || (doc_id % 10) END AS section_heading, body_text FROM b_body),
b_tables AS (SELECT s.* EXCLUDE (body_text), d.prefix || replace(coalesce(d.extracted_text, ''), chr(10), chr(10) || d.prefix) AS body_text FROM b_sections s JOIN b_documents d USING (document_id)),
b_lines AS (SELECT 'doc-' || doc_id AS document_id, coalesce(source, '') AS project_id, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS document_order, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents),
b_marked AS (SELECT *, document_order % 3 = 0 AS is_head, document_order // 3 AS i FROM b_lines),
b_named AS (SELECT *, is_head AND i % 7 = 6 AS app, CAST(i // 4 + 1 AS VARCHAR) || (['.0', '.1', '.3', '.3.1'])[CAST(i % 4 + 1 AS INTEGER)] AS number FROM b_marked),
b_blocks AS (SELECT document_id, project_id, document_order, CASE WHEN app THEN 'appendix_heading' WHEN is_head THEN 'heading' ELSE 'paragraph' END AS block_type, CASE WHEN app THEN 'APPENDIX ' || chr(CAST(65 + i % 26 AS INTEGER)) WHEN is_head THEN number END AS numbering_token,
  CASE WHEN app THEN 1 WHEN is_head THEN ([1, 2, 2, 3])[CAST(i % 4 + 1 AS INTEGER)] END AS heading_level, CASE WHEN is_head THEN regexp_extract(line, '^(\\S+(?: \\S+){{0,3}})', 1) END AS heading_title, CASE WHEN app THEN 'APPENDIX' WHEN is_head THEN 'MAIN' END AS tree_kind,
  CASE WHEN is_head THEN (CASE WHEN app THEN 'APPENDIX ' || chr(CAST(65 + i % 26 AS INTEGER)) ELSE number END) || ' ' || regexp_extract(line, '^(\\S+(?: \\S+){{0,3}})', 1) ELSE line END AS normalized_text FROM b_named),
b_chunks AS (SELECT 'p-' || vec_id AS point_id, coalesce(CAST(label AS VARCHAR), '') AS project_id, (['section', 'requirement', 'table'])[CAST(vec_id % 3 + 1 AS INTEGER)] AS chunk_kind, ({_list(FILENAMES)})[CAST((vec_id // 3) % 8 + 1 AS INTEGER)] AS filename, 'c-' || (vec_id % 50) AS chunk_index, 'text ' || (vec_id % 40) AS text, embedding AS vector, vec_id FROM embeddings),
b_requirements AS (SELECT id, project_id, document_id, filename, (doc_id % 3 + 1) || '.' || (doc_id % 4) AS section_number, 'Heading ' || (doc_id % 10) AS section_heading, body_text AS requirement_text, (['shall', 'must', 'will'])[CAST(doc_id % 3 + 1 AS INTEGER)] AS modality, CASE WHEN doc_id % 2 = 0 THEN 'contractor' END AS actor, doc_id FROM b_body),
b_grid AS (SELECT p_brand AS document_id, p_brand || ':table:0' AS table_id, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS row_index, [p_name, p_type, CAST(p_size AS VARCHAR), CASE WHEN p_partkey % 2 = 0 THEN 'The Contractor shall deliver' ELSE 'none' END] AS r FROM part)
"""
