"""Tables of documents and their normalizations: latest versions, plans, upserts, status.

Latest versions are ranked on keys alone and joined back, or taken with max_by, so texts don't move through
windows. Ties in time are broken by id.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bidspark.functions.lexicons import IGNORED_FILENAMES

VERSION = ("project_id", "filename")


def newest(df: DataFrame, keys: Sequence[str], time: str = "created_at", tie: str = "id") -> DataFrame:
    """Rows of the greatest time for each key, the smallest id on ties; only keys, time and id are sorted."""
    order = Window.partitionBy(*keys).orderBy(F.desc(time), F.asc(tie))
    ids = df.select(*keys, time, tie).withColumn("__rank", F.row_number().over(order)).where("__rank = 1").select(tie)
    return df.join(ids, tie, "left_semi")


def latest_documents(documents: DataFrame, status: str = "extracted") -> DataFrame:
    """Newest extracted version of each file of a project; ignored files aside."""
    live = documents.where((F.col("extraction_status") == status) & ~F.lower("filename").isin(*IGNORED_FILENAMES))
    return newest(live, VERSION)


def latest_normalization(normalizations: DataFrame, keys: Sequence[str] = ("document_id",), status: str | None = "normalized") -> DataFrame:
    rows = normalizations if status is None else normalizations.where(F.col("normalization_status") == status)
    return newest(rows, keys, "updated_at")


def documents_with_normalization(documents: DataFrame, normalizations: DataFrame) -> DataFrame:
    """Latest documents with text, each with its newest successful normalization or nulls."""
    docs = latest_documents(documents).where(F.coalesce("extracted_text", F.lit("")) != "")
    right = latest_normalization(normalizations).select(F.col("document_id").alias("__doc"), F.col("provider").alias("normalization_provider"), "normalized_markdown", F.col("content_sha256").alias("normalized_sha256"))
    return docs.join(right, docs.id == F.col("__doc"), "left").drop("__doc")


def active_projects(documents: DataFrame, top: int = 5, markers: Sequence[str] = ()) -> DataFrame:
    """(project_id, document_count, latest_created_at, filenames, display_name): newest distinct filenames first."""
    names = documents.groupBy(*VERSION).agg(F.max("created_at").alias("at"))
    order = Window.partitionBy("project_id").orderBy(F.desc("at"), "filename")
    recent = names.withColumn("r", F.row_number().over(order)).where(F.col("r") <= top)
    lists = recent.groupBy("project_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "filename"))), lambda x: x["filename"]).alias("filenames"))
    counts = documents.groupBy("project_id").agg(F.count("*").alias("document_count"), F.max("created_at").alias("latest_created_at"))
    title = F.initcap(F.regexp_replace("project_id", "[-_]+", " "))
    marked = F.lit(None).cast("string")
    for m in reversed(markers):
        marked = F.when(F.exists("filenames", lambda x, m=m: x.contains(m)), F.lit(m)).otherwise(marked)
    return counts.join(lists, "project_id").withColumn("display_name", F.coalesce(marked, title))


def document_status(documents: DataFrame, normalizations: DataFrame, provider: str) -> DataFrame:
    """(id, project_id, filename, status): latest state for the provider, `pending` without one."""
    rows = latest_normalization(normalizations.where(F.col("provider") == provider), status=None)
    right = rows.select(F.col("document_id").alias("__doc"), F.col("normalization_status").alias("status"))
    docs = documents.where("extraction_status = 'extracted'").select("id", "project_id", "filename")
    return docs.join(right, docs.id == F.col("__doc"), "left").select("id", "project_id", "filename", F.coalesce("status", F.lit("pending")).alias("status"))


def project_status(documents: DataFrame, normalizations: DataFrame, provider: str) -> DataFrame:
    """(project_id, total, normalized, failed, pending): distinct documents, each status counted once."""
    docs = documents.where("extraction_status = 'extracted'").select("id", "project_id")
    states = normalizations.where(F.col("provider") == provider).select("document_id", "normalization_status").distinct()
    flags = states.groupBy("document_id").agg(F.max((F.col("normalization_status") == "normalized").cast("int")).alias("n"), F.max((F.col("normalization_status") == "failed").cast("int")).alias("f"))
    both = docs.join(flags, docs.id == flags.document_id, "left")
    zero = F.lit(0)
    sums = both.groupBy("project_id").agg(F.count("*").alias("total"), F.sum(F.coalesce("n", zero)).alias("normalized"), F.sum(F.coalesce("f", zero)).alias("failed"))
    return sums.withColumn("pending", F.greatest(F.col("total") - F.col("normalized") - F.col("failed"), F.lit(0)))


def latest_artifact(normalizations: DataFrame) -> DataFrame:
    return latest_normalization(normalizations, ("project_id", "document_id"))


def project_rows(table: DataFrame, project_id: str, order: Sequence[str]) -> DataFrame:
    return table.where(F.col("project_id") == project_id).orderBy(*order)


def filter_filename(df: DataFrame, pattern: str | None) -> DataFrame:
    """Rows whose filename fits a SQL pattern, ignoring case."""
    return df if not pattern else df.where(F.col("filename").ilike(pattern))


def filter_filename_needle(df: DataFrame, pattern: str | None) -> DataFrame:
    """Rows whose filename holds the pattern without its percent signs, ignoring case."""
    needle = (pattern or "").replace("%", "").lower()
    return df if not needle else df.where(F.lower(F.coalesce("filename", F.lit(""))).contains(needle))


def plan_normalization(documents: DataFrame, normalizations: DataFrame, provider: str) -> DataFrame:
    """(id, project_id, filename, plan): `skipped` where the same content is normalized already, else `todo`."""
    docs = latest_documents(documents).select("id", "project_id", "filename", "content_sha256")
    rows = latest_normalization(normalizations.where(F.col("provider") == provider), status=None)
    right = rows.select(F.col("document_id").alias("__doc"), F.col("content_sha256").alias("__sha"), F.col("normalization_status").alias("__status"))
    same = (F.col("content_sha256") == F.col("__sha")) & (F.col("__status") == "normalized")
    plan = F.when(F.coalesce(same, F.lit(False)), "skipped").otherwise("todo")
    return docs.join(right, docs.id == F.col("__doc"), "left").select("id", "project_id", "filename", plan.alias("plan"))


def plan_ingest(files: DataFrame, documents: DataFrame) -> DataFrame:
    """(project_id, filename, content_sha256, status): `skipped` if the newest stored version has the same content."""
    stored = newest(documents, VERSION).select(*VERSION, F.col("content_sha256").alias("__sha"))
    both = files.join(stored, [*VERSION], "left")
    same = F.coalesce(F.col("content_sha256") == F.col("__sha"), F.lit(False))
    return both.select(*VERSION, "content_sha256", F.when(same, "skipped").otherwise("uploaded").alias("status"))


def plan_counts(plan: DataFrame, column: str = "status") -> DataFrame:
    return plan.groupBy("project_id", column).agg(F.count("*").alias("n"))


def upsert(existing: DataFrame, updates: DataFrame, keys: Sequence[str] = ("document_id", "provider"), keep: Sequence[str] = ("created_at",)) -> DataFrame:
    """Updates replace rows of the same key in all columns but `keep`, which the old row gives."""
    old = existing.select(*keys, *[F.col(c).alias(f"__old_{c}") for c in keep])
    merged = updates.join(old, [*keys], "left").select(*[F.coalesce(f"__old_{c}", c).alias(c) if c in keep else F.col(c) for c in existing.columns])
    return existing.join(updates.select(*keys), [*keys], "left_anti").select(*existing.columns).unionByName(merged)


def replace_by_document(existing: DataFrame, fresh: DataFrame, keys: Sequence[str] = ("document_id",), touched: DataFrame | None = None) -> DataFrame:
    """Rows of touched documents give way to the fresh ones; `touched` may name documents with none."""
    gone = (fresh if touched is None else touched).select(*keys).distinct()
    return existing.join(gone, [*keys], "left_anti").select(*existing.columns).unionByName(fresh)


def index_status(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("project_id").agg(F.count("*").alias("points"))


def artifact_counts(sections: DataFrame, requirements: DataFrame, tables: DataFrame) -> DataFrame:
    """(project_id, sections, requirements, tables): counts of each kind, 0 where a project has none."""
    named = {"sections": sections, "requirements": requirements, "tables": tables}
    tall = reduce(DataFrame.unionByName, [df.groupBy("project_id").agg(F.count("*").alias("n")).withColumn("kind", F.lit(k)) for k, df in named.items()])
    return tall.groupBy("project_id").agg(*[F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("n"))), F.lit(0)).alias(k) for k in named])


def package_job_progress(jobs: DataFrame) -> DataFrame:
    """Adds progress in percent: shares of upload (45), normalization (45) and indexing (10), 2 to 99 while running."""

    def share(done: str, total: str, weight: int) -> Column:
        return F.when(F.col(total) > 0, F.least(F.col(done) / F.col(total), F.lit(1.0)) * weight).otherwise(0.0)

    running = F.round(share("uploaded", "files", 45) + share("normalized", "documents", 45) + F.when(F.col("indexed"), 10.0).otherwise(0.0))
    running = F.least(F.greatest(running, F.lit(2.0)), F.lit(99.0))
    value = F.when(F.col("status") == "completed", 100.0).when(F.col("status") == "failed", F.greatest(running, F.lit(1.0))).otherwise(running)
    return jobs.withColumn("progress", value.cast("int"))
