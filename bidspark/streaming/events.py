"""Streams of document events: parse, drop repeats, and refresh tables batch by batch."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bidspark.functions import text as T
from bidspark.operators.chunks import CHUNK, embed_chunks, section_chunks
from bidspark.operators.extract import extract_requirements, split_sentences
from bidspark.operators.relational import VERSION
from bidspark.sources.tables import Table, refresh_in, replace_in

EVENT = "event_type string, document_id string, project_id string, filename string, extracted_text string, created_at timestamp"


def document_events(df: DataFrame, col: str = "value") -> DataFrame:
    """Columns of `document.extracted` events; other events and bad JSON are left out. Works on streams and tables."""
    return df.select(F.from_json(col, EVENT).alias("e")).select("e.*").where("event_type = 'document.extracted' and document_id is not null")


def stream_document_events(stream: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Events once per document_id; state is kept only as long as a repeat may still come."""
    return document_events(stream).withWatermark("created_at", delay).dropDuplicatesWithinWatermark(["document_id"])


def batch_document_events(df: DataFrame) -> DataFrame:
    """The batch twin: the earliest event of each document."""
    return document_events(df).groupBy("document_id").agg(F.min(F.struct("created_at", "project_id", "filename", "extracted_text", "event_type")).alias("x")).select("document_id", "x.*")


def stream_requirements(stream: DataFrame, text: str = "extracted_text") -> DataFrame:
    """Classified sentences of a stream of documents; no state."""
    return split_sentences(stream, text).withColumn("requirement_type", T.classify_requirement(F.col("sentence"))).where("requirement_type is not null")


@dataclass(frozen=True)
class Sinks:
    """The tables that events keep fresh: requirement rows by document; chunks, and chunks with vectors, by file."""

    requirements: Table
    chunks: Table
    index: Table

    @classmethod
    def at(cls, spark: SparkSession, path: str, buckets: int = 64) -> Sinks:
        kinds = f"{CHUNK_KIND}, vector array<float>"
        return cls(Table(spark, f"{path}/requirements", REQUIREMENT, ("document_id",), buckets), Table(spark, f"{path}/chunks", CHUNK_KIND, VERSION, buckets), Table(spark, f"{path}/index", kinds, VERSION, buckets))


REQUIREMENT = "project_id string, document_id string, filename string, section_path string, section_heading string, requirement_index int, requirement_text string, requirement_type string"
CHUNK_KIND = ", ".join(f"{c} string" for c in CHUNK)


def refresh(df: DataFrame, batch_id: int, sinks: Sinks, writer: str = "events", embed: Callable[[DataFrame], DataFrame] = embed_chunks, at: Callable[[str], None] = lambda _: None) -> dict[str, bool]:
    """Bring one batch of documents into all sinks; which of them were written now. A sink that has the batch is left alone, so a batch
    that was ended between two sinks, or within one, is finished by repeating it.

    df: project_id, document_id, filename, extracted_text. Of a file that comes several times in a batch the last document is indexed
    (by created_at, then document_id); requirement rows are kept of each document.
    """
    order = [F.desc("created_at")] * ("created_at" in df.columns) + [F.desc("document_id")]
    df = df.withColumn("__r", F.row_number().over(Window.partitionBy(*VERSION).orderBy(*order))).persist()
    try:
        sections = df.select("project_id", "document_id", "filename", F.lit(0).alias("section_index"), F.lit("DOCUMENT").alias("section_path"), F.lit("Document Body").alias("section_heading"), F.col("extracted_text").alias("body_text"), "__r")
        files, chunks = df.where("__r = 1").select(*VERSION), section_chunks(sections.where("__r = 1")).select(*CHUNK)
        step = lambda name: lambda what: at(f"{name}:{what}")
        done = {"requirements": replace_in(sinks.requirements, extract_requirements(sections), writer, batch_id, df.select("document_id"), at=step("requirements"))}
        done["chunks"] = refresh_in(sinks.chunks, chunks, writer, batch_id, files, at=step("chunks"))
        if sinks.index.written(writer) < batch_id:
            done["index"] = refresh_in(sinks.index, embed(chunks), writer, batch_id, files, at=step("index"))
        else:
            done["index"] = False
        return done
    finally:
        df.unpersist()


def stream_refresh(stream: DataFrame, sinks: Sinks, checkpoint: str, writer: str = "events", embed: Callable[[DataFrame], DataFrame] = embed_chunks, at: Callable[[str], None] = lambda _: None):
    """Starts a query that brings the documents of each micro-batch into all sinks.

    The stream's checkpoint numbers the batches and each table remembers the last number it took from this writer: what was not
    finished is repeated after a restart, what was finished is skipped. A writer belongs to one checkpoint.
    """
    batch = lambda df, batch_id: refresh(df, batch_id, sinks, writer, embed, at)
    return stream.writeStream.foreachBatch(lambda df, batch_id: batch(df, batch_id) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
