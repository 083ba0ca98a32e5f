"""Sentences, requirement rows, candidates and exports; rows come from exploded arrays, without Python."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bidspark.functions import lexicons as L
from bidspark.functions import text as T
from bidspark.functions.arrow import bounded

EXPORT = ("project_id", "source_document", "pws_area", "section_path", "section_heading", "source_kind", "requirement_type", "trigger_keyword", "requirement_text", "provider", "content_sha256")
KINDS = ("section", "requirement_record", "table", "markdown_sentence")
EXPORT_KEY = ("project_id", "source_document", "pws_area", "source_kind", "trigger_keyword", "requirement_text")


def sentences(c: Column) -> Column:
    """Array of sentences of one text, trimmed, none empty."""
    return F.filter(F.transform(F.split(T.normalize_inline(c), r"(?<=[.!?])\s+(?=[A-Z(])"), T.strip), lambda x: x != "")


def split_sentences(df: DataFrame, col: str = "text") -> DataFrame:
    """A row per sentence: all columns but `col`, sentence_index and sentence."""
    rest = [c for c in df.columns if c != col]
    return df.select(*rest, F.posexplode(sentences(F.col(col))).alias("sentence_index", "sentence"))


def split_fragments(df: DataFrame, col: str, block_type: str = "block_type") -> DataFrame:
    """Like split_sentences, also at semicolons; list items stay whole."""
    return df.select("*", F.posexplode(fragments(F.col(col), F.col(block_type))).alias("fragment_index", "fragment"))


def fragments(c: Column, block_type: Column) -> Column:
    """Array of the pieces of one text, as `split_fragments` counts them."""
    parts = lambda line: F.when(block_type == "list_item", F.array(line)).otherwise(F.transform(F.split(line, r"(?<=[.;!?])\s+(?=[A-Z(])"), T.strip))
    return F.filter(T.let(T.normalize_inline(c), parts), lambda x: x != "")


def split_protected_sentences(c: Column) -> Column:
    """Sentences by . ! ?; points of decimals and of common abbreviations don't end one."""
    text = F.regexp_replace(T.blank_if_null(c), r"(\d)\.(\d)", "$1\u0001$2")
    text = F.regexp_replace(text, r"(?i)\b(e|i|u)\.(g|e|s)\.", "$1\u0001$2\u0001")
    text = F.regexp_replace(text, r"(?i)\b(etc|vs|mr|mrs|ms|dr|no|inc)\.", "$1\u0001")
    parts = F.regexp_extract_all(text, F.lit(r"([^.!?]+[.!?]*)"), F.lit(1))
    return F.filter(F.transform(parts, lambda x: T.strip(F.replace(x, F.lit("\u0001"), F.lit(".")))), lambda x: x != "")


def pws_area(path: Column, heading: Column) -> Column:
    path, heading = T.blank_if_null(path), T.blank_if_null(heading)
    return F.when((path != "") & (path != "DOCUMENT"), path).when((heading != "") & (heading != "Document Body"), heading).otherwise("DOCUMENT")


def extract_requirements(sections: DataFrame, text: str = "body_text") -> DataFrame:
    """Classified sentences of sections; requirement_index counts all sentences of the section."""
    rows = _labelled(split_sentences(sections, text), "requirement_type", T.classify_requirement(F.col("sentence")))
    return rows.withColumnsRenamed({"sentence_index": "requirement_index", "sentence": "requirement_text"})


def _labelled(df: DataFrame, name: str, label: Column) -> DataFrame:
    """Rows that have a label. It is exploded, not filtered: a filter would look through all its patterns a second time."""
    return df.select("*", F.explode(F.array_compact(F.array(label))).alias(name))


def _export(df: DataFrame, kind: str, text: Column, default: str) -> DataFrame:
    rows = df.withColumns({"source_kind": F.lit(kind), "requirement_text": text, "source_document": F.col("filename"), "pws_area": pws_area(F.col("section_path"), F.col("section_heading"))})
    rows = _labelled(rows, "trigger_keyword", T.classify_export_keyword(F.col("requirement_text")))
    return rows.withColumns({"requirement_type": F.coalesce(T.classify_requirement(F.col("requirement_text")), F.lit(default)), "content_sha256": T.blank_if_null("content_sha256")}).select(*EXPORT)


def section_export_rows(sections: DataFrame) -> DataFrame:
    """Sentences of sections that have a trigger keyword."""
    return _export(split_sentences(sections, "body_text"), "section", F.col("sentence"), "requirement_statement")


def section_and_record_rows(sections: DataFrame) -> DataFrame:
    """`section_export_rows` and the export rows of `extract_requirements`, from one split and one classification."""
    both = F.array(F.struct(T.classify_export_keyword(F.col("sentence")).alias("k"), T.classify_requirement(F.col("sentence")).alias("t")))
    row = lambda cond, kind, of_type, keyword: F.when(cond, F.struct(F.lit(kind).alias("source_kind"), of_type.alias("requirement_type"), keyword.alias("trigger_keyword")))
    kinds = lambda x: F.array_compact(F.array(row(x["k"].isNotNull(), "section", F.coalesce(x["t"], F.lit("requirement_statement")), x["k"]), row(x["t"].isNotNull(), "requirement_record", x["t"], F.coalesce(x["k"], F.lit("classified")))))
    rows = split_sentences(sections, "body_text").withColumn("x", F.explode(F.flatten(F.transform(both, kinds)))).select("*", "x.*")
    return rows.withColumns({"requirement_text": F.col("sentence"), "source_document": F.col("filename"), "pws_area": pws_area(F.col("section_path"), F.col("section_heading")), "content_sha256": T.blank_if_null("content_sha256")}).select(*EXPORT)


def table_export_rows(tables: DataFrame) -> DataFrame:
    """Non-empty lines of table text that have a trigger keyword."""
    lines = tables.withColumn("line", F.explode(F.split(T.blank_if_null("body_text"), r"\n+"))).withColumn("line", T.normalize_inline(F.col("line"))).where("line <> ''")
    return _export(lines, "table", F.col("line"), "table_requirement")


def requirement_export_rows(requirements: DataFrame) -> DataFrame:
    keyword = F.coalesce(T.classify_export_keyword(F.col("requirement_text")), F.lit("classified"))
    return requirements.withColumns({"source_kind": F.lit("requirement_record"), "source_document": F.col("filename"), "pws_area": pws_area(F.col("section_path"), F.col("section_heading")), "trigger_keyword": keyword, "content_sha256": T.blank_if_null("content_sha256")}).select(*EXPORT)


#: What a heading line looks like.
HEADING_LINES = (r"^#+\s+(.+)$", r"^(\d+(?:\.\d+)*+)\s+(.+)$", r"^\*\*(.+?)\*\*$", r"^([A-Z][A-Z0-9 /(),.&:-]{6,120})$")


def markdown_export_rows(documents: DataFrame) -> DataFrame:
    """Sentences of Markdown lines under the last heading; an unfinished sentence is carried to the next line.

    The carry is sequential within a document, so lines are folded per document, in Arrow batches without a shuffle.
    """
    import re

    headings = [re.compile(p) for p in HEADING_LINES]
    ends = re.compile(r"(?<=[.!?])\s+")
    keyword = re.compile("|".join(p for _, p in L.TRIGGER_KEYWORDS), re.IGNORECASE)

    def heading_of(line: str) -> str | None:
        for p in headings:
            if m := p.match(line):
                return " ".join(g for g in m.groups() if g).strip("* ").strip()
        return None

    def found(text: str | None) -> list[dict[str, str]]:
        area, carry, out = "DOCUMENT", "", []
        for raw in (text or "").splitlines():
            line = re.sub(r"[ \t]{2,}", " ", raw).strip()
            head = heading_of(line) if line else None
            if not line or head:
                area, carry = head or area, ""
                continue
            parts = [p.strip() for p in ends.split(f"{carry} {line}".strip()) if p.strip()]
            out += [{"area": area, "sentence": p} for p in parts if keyword.search(p)]
            open_ones = [p for p in parts if not keyword.search(p) and not p.endswith((".", "!", "?"))]
            carry = open_ones[-1] if open_ones else ""
        return out

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(found)

    fold = F.pandas_udf(run, "array<struct<area string, sentence string>>")
    rows = bounded(documents).withColumn("__x", F.explode(fold("normalized_markdown"))).withColumns({"section_path": F.col("__x.area"), "section_heading": F.col("__x.area"), "sentence": F.col("__x.sentence")})
    return _export(rows, "markdown_sentence", F.col("sentence"), "requirement_statement").withColumn("pws_area", F.col("section_path"))


def project_requirement_export(sections: DataFrame, tables: DataFrame, requirements: DataFrame | None = None, markdown: DataFrame | None = None, pattern: str | None = None) -> DataFrame:
    """All requirement rows of every project, each key once (first source first).

    A key holds the source kind, so duplicates only meet inside one source; among them the smallest row stays,
    which a combining aggregate finds before the shuffle. A text moves once for all kinds that it comes in. Without `requirements` the sections' own are taken, and
    their sentences are split and classified once for both.
    """
    keep = lambda df: df if not pattern else df.where(F.col("filename").ilike(pattern))
    parts = [section_and_record_rows(keep(sections))] if requirements is None else [section_export_rows(keep(sections)), requirement_export_rows(keep(requirements))]
    parts.append(table_export_rows(keep(tables)))
    if markdown is not None:
        parts.append(markdown_export_rows(keep(markdown)))
    rest = [c for c in EXPORT if c not in EXPORT_KEY]
    # the aggregate sorts its keys: by their hash first, which seldom looks at the strings
    key = [c for c in EXPORT_KEY if c != "source_kind"]
    least = [F.min(F.when(F.col("source_kind") == k, F.struct(*rest))).alias(k) for k in KINDS]
    rows = reduce(DataFrame.unionByName, parts).groupBy(F.xxhash64(*key).alias("__h"), *key).agg(*least)
    kinds = F.array_compact(F.array(*[F.when(F.col(k).isNotNull(), F.struct(F.lit(k).alias("source_kind"), f"{k}.*")) for k in KINDS]))
    return rows.select(*key, F.inline(kinds)).select(*EXPORT)


def submission_requirements(export: DataFrame) -> DataFrame:
    """Rows of a submission category; submission rows without one are `content`."""
    category = F.coalesce(T.classify_submission(F.col("requirement_text")), F.when(F.col("requirement_type") == "submission", "content"))
    return _labelled(export, "submission_category", category)


def extraction_units(blocks: DataFrame, tables: DataFrame) -> DataFrame:
    """Prose blocks and body rows of tables (`header: cell | ...`) as units of extraction."""
    prose = blocks.where(F.col("block_type").isin("paragraph", "list_item", "note")).select(
        F.concat("block_id", F.lit(":unit")).alias("unit_id"), "document_id", F.coalesce("section_path", F.lit("DOCUMENT")).alias("heading_path"), F.col("block_id").alias("source_block_id"), F.col("block_type").alias("unit_type"), F.col("normalized_text").alias("text_exact"), F.lit(None).cast("string").alias("table_id"), F.lit(None).cast("int").alias("row_index")
    )
    body = tables.select("document_id", "block_id", F.coalesce("heading_path", F.lit("DOCUMENT")).alias("heading_path"), F.explode(F.filter(T.headed(F.col("rows")), lambda x: x["row_index"] > 0)).alias("x")).select("document_id", "block_id", "heading_path", "x.*")
    cell = lambda x, i: F.concat(F.coalesce(F.get("header", i), F.concat(F.lit("col_"), (i + 1).cast("string"))), F.lit(": "), T.blank_if_null(x))
    rows = body.select(
        F.concat("block_id", F.lit(":row:"), F.col("row_index").cast("string"), F.lit(":unit")).alias("unit_id"), "document_id", "heading_path", F.col("block_id").alias("source_block_id"), F.lit("table_row").alias("unit_type"), F.array_join(F.transform("row", cell), " | ").alias("text_exact"), F.col("block_id").alias("table_id"), "row_index"
    )
    return prose.unionByName(rows)


def _rule_fragments() -> Column:
    """Fragments of a unit that the rule takes, each with its modality."""
    marked = F.transform(fragments(F.col("text_exact"), F.col("unit_type")), lambda x: F.struct(x.alias("fragment"), T.detect_modality(x).alias("modality")))
    return F.filter(marked, lambda x: (x["modality"] != "informational") | T.is_tasking(x["fragment"]) | (F.col("unit_type") == "table_row"))


def requirement_candidates(units: DataFrame, extractor=None) -> DataFrame:
    """Candidates of every unit: fragments that the rule takes, or one baseline row for a unit without any.

    `extractor` (units to rows of unit_id and fragment) may replace the rule. The rule's rows come from the unit's own row, without a
    shuffle.
    """
    cols = ["unit_id", "document_id", "heading_path", "source_block_id", "unit_type", "table_id", "row_index", "fragment", "modality", "index", "confidence", "review_flag"]
    ruled = lambda fragment, modality, index: {"fragment": fragment, "modality": modality, "index": index, "confidence": F.when(F.col("unit_type") == "table_row", 0.65).otherwise(0.72), "review_flag": modality == "informational"}
    based = lambda line: {"fragment": line, "modality": T.detect_modality(line), "index": F.lit(0), "confidence": F.lit(0.55), "review_flag": F.col("unit_type") == "note"}
    row = lambda fields: F.struct(*[c.alias(name) for name, c in fields.items()])
    line = T.normalize_inline(F.col("text_exact"))
    if extractor is None:
        base = T.let(line, lambda x: F.array(row(based(x))))
        rows = T.let(_rule_fragments(), lambda taken: F.when(F.size(taken) == 0, base).otherwise(F.transform(taken, lambda x, i: row(ruled(x["fragment"], x["modality"], i)))))
        both = units.select(*cols[:7], F.explode(rows).alias("x")).select(*cols[:7], "x.*")
    else:
        taken = units.join(extractor(units), "unit_id").withColumn("modality", T.detect_modality(F.col("fragment")))
        index = F.row_number().over(Window.partitionBy("unit_id").orderBy("fragment")) - 1
        base = units.join(taken.select("unit_id").distinct(), "unit_id", "left_anti").withColumns(based(line))
        both = taken.withColumns(ruled(F.col("fragment"), F.col("modality"), index)).select(*cols).unionByName(base.select(*cols))
    return both.select(
        F.concat_ws(":", F.col("unit_id"), F.lit("requirement"), F.col("index").cast("string")).alias("candidate_id"), *[c for c in cols if c not in ("fragment", "index")], F.col("fragment").alias("requirement_text"), T.build_normalized_requirement(F.col("fragment")).alias("normalized_text"), T.detect_actor(F.col("fragment")).alias("actor"), T.is_deliverable(F.col("fragment")).alias("deliverable_flag")
    )


def deliverable_candidates(units: DataFrame) -> DataFrame:
    """Fragments that the rule takes and that name a deliverable."""
    named = F.filter(_rule_fragments(), lambda x: T.is_deliverable(x["fragment"]))
    rows = units.select("unit_id", "document_id", "heading_path", "source_block_id", F.posexplode(F.transform(named, lambda x: x["fragment"])).alias("index", "fragment"))
    return rows.select(F.concat_ws(":", F.col("unit_id"), F.lit("deliverable"), F.col("index").cast("string")).alias("deliverable_id"), "document_id", "heading_path", "source_block_id", F.col("fragment").alias("deliverable_text"), T.build_normalized_requirement(F.col("fragment")).alias("normalized_text"), F.lit(0.6).alias("confidence"), F.lit(True).alias("review_flag"))


def table_cell_provenance(candidates: DataFrame, cells: DataFrame) -> DataFrame:
    """Candidates of table rows with the first column of their row that is tasking or has a modality."""
    hit = cells.where(T.is_tasking(F.col("cell_text")) | (T.detect_modality(F.col("cell_text")) != "informational"))
    first = hit.groupBy("table_id", "row_index").agg(F.min("col_index").alias("table_col_index"))
    return candidates.join(first, ["table_id", "row_index"], "left")


def review_queue(*reviews: DataFrame) -> DataFrame:
    """All review items with defaults for reason and severity, and their details as JSON."""
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), reviews)
    reason = F.coalesce("reason", F.lit("needs_review"))
    return rows.withColumns({"reason": reason, "severity": F.coalesce(F.col("severity"), F.lit("warning")) if "severity" in rows.columns else F.lit("warning")}).withColumn("details_json", F.to_json(F.struct(*rows.columns)))


def hierarchy_requirement_export(documents: DataFrame) -> DataFrame:
    """Trigger sentences of numbered Markdown sections with ids `section-001` and titles of the levels above.

    Titles are looked up among the exported sections of the same document, the last one of a number.
    """
    line = T.strip(F.replace(T.html_unescape(T.strip_tags(F.col("line"))), F.lit(" "), F.lit(" ")))
    head = r"^#{1,6}\s+(\d+(?:\.\d+)*+)\s+(.*\S)\s*$"
    rows = documents.select("document_id", F.posexplode(F.split(T.blank_if_null("normalized_markdown"), "\n")).alias("pos", "line")).withColumn("line", line)
    rows = rows.where(~F.col("line").rlike(r"^\[[^\]]+\]\(\.\)\s*$")).withColumn("number", F.when(F.col("line").rlike(head), T.remap_section_number(F.regexp_extract("line", head, 1))))
    title = T.strip(F.regexp_replace(F.regexp_extract("line", head, 2), r"^\((?:U(?://FOUO)?|C|S|TS(?://SCI)?)\)\s*", ""))
    at = Window.partitionBy("document_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    mark = F.when(F.col("number").isNotNull(), F.struct("pos", "number", title.alias("title")))
    rows = rows.withColumn("s", F.last(mark, ignorenulls=True).over(at)).where("s is not null")
    body = rows.groupBy("document_id", F.col("s.pos").alias("section_pos"), F.col("s.number").alias("section_number"), F.col("s.title").alias("section_title")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("number").isNull(), F.struct("pos", "line")))), lambda x: x["line"]), "\n").alias("body"))
    body = body.where(~((F.col("section_number") == "1") & F.col("section_title").contains("Table of Contents")) & ~((F.col("section_number") == "2") & (F.col("section_title") == "Figures")))
    blocks = F.filter(F.transform(F.split(F.regexp_replace("body", "\n\n", "\n"), r"\n{2,}"), T.strip), lambda b: (b != "") & ~(b.startswith("[") & b.endswith("](.)")))
    parts = F.flatten(F.transform(blocks, lambda b: F.split(b, r"(?<=[.;)])\s+(?=[A-Z(])")))
    clean = F.transform(parts, lambda p: T.strip(F.regexp_replace(F.replace(p, F.lit("•"), F.lit(" ")), r"\s+", " ")))
    kept = F.filter(clean, lambda p: (F.length(p) >= 20) & p.rlike("(?i)" + L.EXPORT_TRIGGER) & ~F.lower(p).contains("table of contents") & ~F.lower(p).contains("figures"))
    out = body.select("document_id", "section_pos", "section_number", "section_title", F.posexplode(F.array_distinct(kept)).alias("i", "requirement_text"))
    out = out.withColumns({"requirement_id": F.concat("section_number", F.lit("-"), F.lpad((F.col("i") + 1).cast("string"), 3, "0")), "trigger_keyword": F.lower(F.regexp_extract("requirement_text", "(?i)" + L.EXPORT_TRIGGER, 1))})
    titles = out.groupBy("document_id", "section_number").agg(F.max_by("section_title", "section_pos").alias("t"))
    n = F.split("section_number", r"\.")
    for level in (1, 2, 3):
        number = F.when(F.size(n) >= level, F.array_join(F.slice(n, 1, level), ".")).otherwise("")
        t = titles.select("document_id", F.col("section_number").alias(f"level_{level}_number"), F.col("t").alias(f"level_{level}_title"))
        out = out.withColumn(f"level_{level}_number", number).join(t, ["document_id", f"level_{level}_number"], "left").withColumn(f"level_{level}_title", T.blank_if_null(f"level_{level}_title"))
    return out.drop("i", "section_pos")


#: Sections of a generated summary.
SUMMARY_TEXTS = ("executive summary", "scope of work", "submission overview", "evaluation overview")
SUMMARY_LISTS = ("key documents", "risks and watchouts", "notable dates", "security notes")


def parse_summary_sections(df: DataFrame, col: str = "markdown") -> DataFrame:
    """The eight known sections of a Markdown summary: four texts, four arrays of bullet items.

    The text is cut once before all its headings; a part's own heading tells which section it belongs to.
    """
    names = (*SUMMARY_TEXTS, *SUMMARY_LISTS)
    heading = rf"(?i)^\s*## +({'|'.join(names)})[ \t]*(?:\n|\z)"
    parts = F.split(F.concat(F.lit("\n"), T.blank_if_null(col)), r"\n(?=\s*## )")
    known = F.filter(F.transform(parts, lambda p: F.struct(F.lower(F.regexp_extract(p, heading, 1)).alias("name"), p.alias("part"))), lambda s: s["name"] != "")
    lines = lambda s: T.let(F.split(s["part"], "\n"), lambda x: F.filter(F.slice(x, F.lit(2), F.size(x)), lambda y: T.strip(y) != ""))
    of = lambda name: F.flatten(F.transform(F.filter("__known", lambda s: s["name"] == name), lines))
    out = df.withColumn("__known", known)
    for name in names:
        own = of(name)
        if name in SUMMARY_LISTS:
            items = F.transform(F.transform(own, T.strip), lambda x: F.when(x.startswith("- ") | x.startswith("* "), T.strip(F.substr(x, F.lit(3)))).otherwise(x))
            out = out.withColumn(name.replace(" ", "_"), items)
        else:
            out = out.withColumn(name.replace(" ", "_"), T.strip(F.array_join(F.transform(own, T.rstrip), "\n")))
    return out.drop("__known")


def render_summary_sections(df: DataFrame, col: str = "markdown") -> DataFrame:
    """The inverse: Markdown of the eight sections in `col`."""
    parts = []
    for name in (*SUMMARY_TEXTS, *SUMMARY_LISTS):
        key = name.replace(" ", "_")
        if name in SUMMARY_LISTS:
            items = F.coalesce(F.col(key), F.array().cast("array<string>"))
            body = F.when(F.size(items) == 0, "- None identified").otherwise(F.array_join(F.transform(items, lambda x: F.concat(F.lit("- "), x)), "\n"))
        else:
            body = F.when(T.strip(T.blank_if_null(key)) == "", "None identified.").otherwise(T.strip(T.blank_if_null(key)))
        parts.append(F.concat(F.lit(f"## {name.title()}\n"), body))
    return df.withColumn(col, F.concat(F.concat_ws("\n\n", *parts), F.lit("\n")))
