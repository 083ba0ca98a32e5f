"""Folders of project files, manifests, exports and the check of nested records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bidspark.functions.lexicons import IGNORED_FILENAMES
from bidspark.operators.extract import EXPORT


def scan_folder(spark: SparkSession, root: str) -> DataFrame:
    """(project_id, filename, content_sha256, size_bytes) of all files below root/<project>/; hidden and ignored ones aside."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    parts = F.split("path", "/")
    rows = files.select(F.element_at(parts, -2).alias("project_id"), F.element_at(parts, -1).alias("filename"), F.sha2("content", 256).alias("content_sha256"), F.col("length").alias("size_bytes"))
    return rows.where(~F.col("filename").startswith(".") & ~F.lower("filename").isin(*IGNORED_FILENAMES))


def read_project_manifests(spark: SparkSession, glob: str) -> DataFrame:
    """project.json files with defaults: project_id from the folder, display_name from it, model_id from that; bad JSON is left out."""
    schema = "project_id string, display_name string, model_id string, _bad string"
    rows = spark.read.schema(schema).option("multiLine", "true").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(glob)
    folder = F.element_at(F.split(F.input_file_name(), "/"), -2)
    rows = rows.withColumn("folder", folder).where("_bad is null")
    project = F.coalesce("project_id", "folder")
    name = F.coalesce(F.col("display_name"), project)
    return rows.select(project.alias("project_id"), name.alias("display_name"), F.coalesce(F.col("model_id"), name).alias("model_id"))


COLUMNS = {
    "requirement": EXPORT,
    "submission": (*EXPORT[:6], "submission_category", *EXPORT[6:]),
    "candidate": ("candidate_id", "document_id", "heading_path", "source_block_id", "unit_type", "requirement_text", "normalized_text", "modality", "actor", "deliverable_flag", "confidence", "review_flag"),
    "review": ("document_id", "reason", "severity", "raw_text", "details_json"),
    "hierarchy": ("document_id", "level_1_number", "level_1_title", "level_2_number", "level_2_title", "level_3_number", "level_3_title", "section_number", "section_title", "requirement_id", "trigger_keyword", "requirement_text"),
}


def write_csv(df: DataFrame, path: str, kind: str, compression: str = "none") -> None:
    """CSV with a header and the fixed columns of its kind, one folder of part files, plain or compressed (`gzip`)."""
    df.select(*COLUMNS[kind]).write.mode("overwrite").option("compression", compression).option("zlib.compress.level", "BEST_SPEED").option("header", "true").option("escape", '"').option("multiLine", "true").csv(path)


def report_bundle(sections: DataFrame, requirements: DataFrame, deliverables: DataFrame, tables: DataFrame, reviews: DataFrame, audits: DataFrame, project_id: str | None = None) -> dict[str, DataFrame]:
    """The seven tables of a project's report, or of all projects', each in its order."""
    named = {"Sections": sections, "Requirements": requirements, "Deliverables": deliverables, "Tables": tables, "Appendices_Attachments": sections.where("tree_kind is not null and tree_kind <> 'MAIN'"), "Review_Queue": reviews, "Audit": audits}
    orders: dict[str, Sequence[str]] = {"Sections": ("document_id", "section_order"), "Appendices_Attachments": ("document_id", "section_order")}
    mine = lambda df: df if project_id is None else df.where(F.col("project_id") == project_id)
    return {k: mine(df).orderBy(*orders.get(k, ("document_id",))) for k, df in named.items()}


FIELDS = ("artifact_type", "document_id", "source", "metadata", "cleaned_text", "hierarchy", "objects", "blocks", "enrichments", "provenance")


def validate_artifacts(df: DataFrame, col: str = "artifact_json", tag: str = "structured_document_v1") -> DataFrame:
    """(document_id, problems): missing fields, a wrong type tag, lists that are none, sections without ids; empty if all is well."""
    # a record is parsed twice, once for its fields and once for what they hold, not anew for each path
    fields = df.select(F.col("document_id").alias("__id"), F.col(col).alias("__json"), F.json_tuple(col, *FIELDS).alias(*FIELDS))
    whole = F.forall(F.array(*[F.col(f).isNotNull() for f in FIELDS]), lambda x: x)
    inner = "source struct<filename string>, metadata struct<document_type string>, cleaned_text struct<full_text string>, hierarchy struct<sections string, root_sections string>, objects struct<tables string, images string>, enrichments struct<pws string>, provenance struct<source_pages string>"
    rows = fields.withColumn("__in", F.from_json(F.when(whole, F.col("__json")), inner)).drop("__json")
    rows = rows.withColumn("__sections", F.from_json("__in.hierarchy.sections", "array<struct<section_id string, section_title string>>"))
    at = lambda p: F.col(f"__in.{p}" if "." in p else p)
    missing = [F.when(at(f).isNull(), F.lit(f"missing {f}")) for f in FIELDS]
    needed = [F.when(F.coalesce(at(p), F.lit("")) == "", F.lit(f"missing {p}")) for p in ("source.filename", "metadata.document_type", "enrichments.pws")]
    needed += [F.when(at("cleaned_text.full_text").isNull(), F.lit("missing cleaned_text.full_text"))]
    lists = [F.when(~F.coalesce(at(p), F.lit("")).startswith("["), F.lit(f"{p} is no list")) for p in ("hierarchy.sections", "hierarchy.root_sections", "objects.tables", "objects.images", "blocks", "provenance.source_pages")]
    inside = [F.when(F.exists("__sections", lambda s: F.coalesce(s["section_id"], F.lit("")) == ""), F.lit("section without id")), F.when(F.exists("__sections", lambda s: s["section_title"].isNull()), F.lit("section without title"))]
    problems = F.array_compact(F.array(*missing, F.when(at("artifact_type") != tag, F.lit("wrong artifact_type")), *[F.when(whole, p) for p in (*needed, *lists, *inside)]))
    return rows.select(F.col("__id").alias("document_id"), problems.alias("problems"))
