"""Steps that many queries share: each text is cut, matched and parsed once, and dealt to all tasks."""

import os
import re

import pytest
from pyspark.sql import functions as F

from bidspark.functions import lexicons as L
from bidspark.functions import text as T
from bidspark.operators import extract as X
from bidspark.operators import structure as St
from bidspark.plans import bridge as B
from bidspark.plans import queries as Q
from bidspark.sources import files
from bidspark.sources.tables import Table, replace_in

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_strip_takes_no_pattern_and_keeps_line_ends_outside_ascii(spark):
    df = spark.createDataFrame([(" \t\n\x0b\f\ra b   \r\n",)], "s string")
    assert "regexp_replace" not in plan(df.select(T.strip(F.col("s")))) and df.select(T.strip(F.col("s"))).first()[0] == "a b  "


def test_words_between_edges_are_found_without_their_pattern(spark):
    texts = ["It SHALL.", "shallow", "x_shall", "ſhall", "shalĺ be", "aéshall", "shallow shall", "", None, "must", "shall", "nothing"]
    df = spark.createDataFrame([(x,) for x in texts], "s string")
    got = [r[0] for r in df.select(T.first_match(F.col("s"), [("shall", r"\bshall\b")])).collect()]
    full = [r[0] for r in df.select(F.when(F.col("s").rlike(r"(?iU)\bshall\b"), "shall")).collect()]
    assert got == full and got[:4] == ["shall", None, None, "shall"]
    assert "ELSE false" not in plan(df.select(T.first_match(F.col("s"), [("shall", r"\bshall\b")]))) and "THEN true" in plan(df.select(T.first_match(F.col("s"), [("shall", r"\bshall\b")])))


def test_summary_is_cut_once_and_an_empty_section_stays_empty(spark):
    df = spark.createDataFrame([("## Scope Of Work\n## Key Documents\n- a\n* b\n\nc\n## Other\nx\n##  KEY DOCUMENTS \n d",)], "markdown string")
    got = X.parse_summary_sections(df)
    row = got.first()
    assert row.scope_of_work == "" and row.key_documents == ["a", "b", "c", "d"] and row.notable_dates == []
    assert plan(got).count("split(concat(") == 1 and "regexp_extract_all" not in plan(got)


def test_blocks_are_judged_once(spark):
    rows = [("d", "structured", 0, "2.1 Reports", "text", None), ("d", "structured", 1, "1 Scope", "text", None), ("d", "structured", 2, "1.1 Work", "text", None), ("d", "markdown", 3, "1.2 Work", "text", None), (None, "markdown", 3, "1.2 Work", "text", None)]
    df = spark.createDataFrame(rows, "document_id string, source_kind string, source_order int, text_exact string, label string, markdown_heading_level int")
    got = St.stage1_sections(df)
    assert plan(got).count("toc_heading") == 1
    assert {(r.document_id, r.source_order): (r.text_exact, r.parent_missing) for r in got.collect()} == {("d", 0): ("2.1 Reports", True), ("d", 1): ("1 Scope", False), ("d", 2): ("1.1 Work", False), ("d", 3): ("1.2 Work", True), (None, 3): ("1.2 Work", True)}


def test_records_are_not_parsed_anew_for_each_path(spark):
    df = spark.createDataFrame([("d", '{"hierarchy": "{}"}')], "document_id string, artifact_json string")
    assert "get_json_object" not in plan(files.validate_artifacts(df)) and files.validate_artifacts(df).first().problems == [f"missing {f}" for f in files.FIELDS if f != "hierarchy"]


def test_texts_are_dealt_by_document(spark, tmp_path):
    spark.createDataFrame([(k, f"a\nb {k}", "s") for k in range(40)], "doc_id long, text string, source string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    for df in (B.blocks(spark, str(tmp_path)), B.sections(spark, str(tmp_path))):
        assert "RepartitionByExpression [document_id" in plan(df)


HEAD = "struct<section_number:string,section_title:string>"


def counted(spark, df):
    """`df` with each row computed counted, and the counter."""
    n = spark.sparkContext.accumulator(0)

    def seen(x):
        n.add(1)
        return x

    return df.withColumn("document_id", F.udf(seen, "string")("document_id")), n


def test_objects_sections_and_headings_are_computed_once(spark):
    anchors = spark.createDataFrame([("d", i, f"{i}", f"word{i}", 10 * i, 10 * i + 9) for i in range(8)], "document_id string, section_order int, section_number string, section_title string, start_order int, end_order int")
    rows = [("d", f"b{o}", o, ("3", "x") if o % 3 == 0 else None, None, [], ["word7 here"] if o % 2 else []) for o in range(5, 95, 3)]
    objects, n = counted(spark, spark.createDataFrame(rows, f"document_id string, block_id string, document_order int, explicit_heading {HEAD}, preceding_heading {HEAD}, before array<string>, after array<string>"))
    got = {r.document_order: r.section_number for r in St.align_objects(objects, anchors, 0.6).collect()}
    assert n.value == len(rows) and got == {o: "3" if e else f"{o // 10}" if o < 80 else "7" if after else None for _, _, o, e, _, _, after in rows}
    sections, n = counted(spark, spark.createDataFrame([("d", 0, "1", "Scope"), ("d", 1, None, "Monthly cost report"), ("d", 2, "9", "None such"), ("e", 0, "1", "Scope")], "document_id string, section_order int, section_number string, section_title string"))
    headings, m = counted(spark, spark.createDataFrame([("d", 4, "1", "Scope"), ("d", 7, "2", "Cost report"), ("e", 2, "1", "Other")], "document_id string, document_order int, numbering_token string, heading_title string"))
    got = {(r.document_id, r.section_order): (r.start_order, r.end_order, r.matched) for r in St.heading_anchors(sections, headings).collect()}
    assert got == {("d", 0): (4, 6, True), ("d", 1): (7, 7, True), ("d", 2): (8, None, False), ("e", 0): (2, None, True)} and (n.value, m.value) == (4, 3)


def test_objects_in_very_many_windows_make_no_pairs(spark):
    """4,000 objects in 4,000 open windows would be 8 million pairs; pages may lie below 0."""
    anchors = spark.range(4000).select(F.lit("d").alias("document_id"), F.col("id").cast("int").alias("section_order"), F.col("id").cast("string").alias("section_number"), F.lit("t").alias("section_title"), F.col("id").cast("int").alias("start_order"), F.lit(None).cast("int").alias("end_order"), F.lit(-9).alias("page_start"), F.when(F.col("id") % 2 == 1, -3).alias("page_end"))
    none = F.lit(None).cast(HEAD)
    objects = spark.range(4000).select(F.lit("d").alias("document_id"), F.concat(F.lit("b"), "id").alias("block_id"), F.col("id").cast("int").alias("document_order"), none.alias("explicit_heading"), none.alias("preceding_heading"), F.when(F.col("id") % 3 == 0, -4).when(F.col("id") % 3 == 1, -2).alias("page_start"), F.array().cast("array<string>").alias("before"), F.array().cast("array<string>").alias("after"))
    got = St.align_objects(objects, anchors, 0.6)
    want = lambda o: ("1", 0.8) if o % 3 == 0 and o > 0 else ("0", 0.72)
    assert all((r.section_number, round(r.confidence, 2)) == want(r.document_order) for r in got.collect()) and got.count() == 4000


def test_parent_numbers_come_from_the_stack(spark):
    rows = [("d", 0, "3", "Operations"), ("d", 1, "3.1", "Help > Desk"), ("d", 2, "3.1.4", "Hours"), ("d", 3, "4", "Other"), ("e", 0, "1.1", "Alone")]
    got = St.flat_sections(spark.createDataFrame(rows, "document_id string, section_order int, section_number string, section_title string"))
    assert "Join" not in plan(got)
    assert [(r.section_number, r.parent_number, r.parent_order) for r in got.orderBy("document_id", "section_order").collect()] == [("3", None, None), ("3.1", "3", 0), ("3.1.4", "3.1", 1), ("4", None, None), ("1.1", None, None)]


def test_unplaced_objects_are_sorted_without_computing_them_anew(spark):
    """Dealing rows to a sort's ranges reads them twice; what is read twice are the decisions."""
    anchors = spark.createDataFrame([("d", 0, "1", "Scope", 0, 9), ("e", 0, "1", "Scope", 0, 9)], "document_id string, section_order int, section_number string, section_title string, start_order int, end_order int")
    rows = [(d, f"b{o}", o, None, None, [], []) for d in "ed" for o in (30, 20, 5)]
    objects, n = counted(spark, spark.createDataFrame(rows, f"document_id string, block_id string, document_order int, explicit_heading {HEAD}, preceding_heading {HEAD}, before array<string>, after array<string>"))
    got = [(r.document_id, r.document_order) for r in St.unplaced_objects(St.align_objects(objects, anchors, 0.6)).collect()]
    assert got == [("d", 20), ("d", 30), ("e", 20), ("e", 30)] and n.value == len(rows)


def test_anchors_of_texts_cut_their_lines_once(spark, tmp_path, monkeypatch):
    """Sections and headings of all documents, also of blank ones and of ids that come twice, are those of all lines."""
    texts = [(1, "\n".join(f"Line {i} of it" for i in range(40))), (2, "Scope\n\nx"), (2, "Other scope\ny\nz\nEnd"), (3, None), (4, ""), (None, "a\nb\nc\nd"), (5, "\n\n\n\n")]
    spark.createDataFrame([(k, t, "s") for k, t in texts], "doc_id long, text string, source string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    whole = Q._assembled(spark, str(tmp_path)).where("section_order is not null").select("document_id", "section_order", "section_number", "section_title")
    want = sorted(map(repr, St.heading_anchors(whole, Q._heads(spark, str(tmp_path))).collect()))
    lines, blocks, counts = sum((t or "").count("\n") + 1 for _, t in texts), B.blocks, []

    def seen(*at):
        df, n = counted(spark, blocks(*at))
        counts.append(n)
        return df

    monkeypatch.setattr(B, "blocks", seen)
    got = Q.QUERIES["heading_anchors"](spark, str(tmp_path)).collect()
    assert 0 < sum(n.value for n in counts) <= lines and len(got) == len(want)
    counts.clear()
    assert sorted(map(repr, Q._anchors(spark, str(tmp_path)).collect())) == want and 0 < sum(n.value for n in counts) <= lines


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_report_reads_its_candidates_once(spark):
    """The rule on fragments runs when candidates and deliverables are staged, not anew for each table and each order."""
    bundle = Q.QUERIES["report_bundle"](spark, SF)
    assert L.TASKING[:30] not in bundle._jdf.queryExecution().optimizedPlan().toString()
    assert {r.report for r in bundle.select("report").distinct().collect()} >= {"Requirements", "Deliverables", "Review_Queue", "Audit"}


def test_export_moves_a_text_once_for_all_kinds_and_csv_may_be_compressed(spark, tmp_path):
    text = 'The offeror shall submit "a", b.\x0bThe COR must provide c. See\nsection 1, all must.'
    rows = [("p", "f", "L.1", "H", "docling", None, t) for t in (text, text, "Nothing", "")]
    cols = "project_id string, filename string, section_path string, section_heading string, provider string, content_sha256 string, body_text string"
    sections = spark.createDataFrame(rows, cols).withColumns({"section_index": F.lit(1), "document_id": F.lit("d")})
    out = X.project_requirement_export(sections, sections)
    assert "source_kind" not in re.search(r"Aggregate \[(.*?)\], ", plan(out)).group(1)
    kinds = [r.source_kind for r in out.collect()]
    assert {k: kinds.count(k) for k in set(kinds)} == {"section": 3, "requirement_record": 3, "table": 2}
    files.write_csv(out, f"{tmp_path}/plain", "requirement")
    files.write_csv(out, f"{tmp_path}/small", "requirement", "gzip")
    read = lambda path: sorted(map(repr, spark.read.option("header", "true").option("escape", '"').option("multiLine", "true").csv(path).collect()))
    assert read(f"{tmp_path}/plain") == read(f"{tmp_path}/small") and len(read(f"{tmp_path}/small")) == 8
    assert all(f.endswith((".csv.gz", "_SUCCESS", ".crc")) for f in os.listdir(f"{tmp_path}/small"))
