"""Registered queries of the document operators over the bridge views, with DuckDB SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bidspark.functions import lexicons as L
from bidspark.functions import text as T
from bidspark.operators import chunks as C
from bidspark.operators import cleanup as Cl
from bidspark.operators import extract as X
from bidspark.operators import outline as O
from bidspark.operators import relational as R
from bidspark.operators import similarity as S
from bidspark.operators import structure as St
from bidspark.plans import bridge as B
from bidspark.sources import files
from bidspark.sources.tables import Table, passing, refresh_in, replace_in, staged, upsert_into

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = B.SQL + sql.replace(")++", ")+").replace(")*+", ")*")  # RE2 needs no possessive groups, and knows none
        return f

    return put


def _case(c: str, patterns, default: str = "NULL") -> str:
    edge = r"[^\p{L}\p{N}_]"  # RE2 knows only ASCII word boundaries
    quote = lambda s: (f"(^|{edge}){s[2:-2]}($|{edge})" if s.startswith(r"\b") else s).replace("'", "''")
    return "CASE " + " ".join(f"WHEN regexp_matches({c}, '(?i){quote(p)}') THEN '{n}'" for n, p in patterns) + f" ELSE {default} END"


INLINE = lambda c: f"regexp_replace(regexp_replace(regexp_replace(coalesce({c}, ''), '[\\r\\n]', ' ', 'g'), '[ \\t]{{2,}}', ' ', 'g'), '^\\s+|\\s+$', '', 'g')"
SPLIT = lambda c: f"string_split(regexp_replace({INLINE(c)}, '([.!?])\\s+([A-Z(])', '\\1' || chr(1) || '\\2', 'g'), chr(1))"
STRIP = lambda c: f"regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"
SENTENCES = f"s_raw AS (SELECT * EXCLUDE (body_text), unnest(list_filter(list_transform({SPLIT('body_text')}, lambda x: {STRIP('x')}), lambda x: x <> '')) AS sentence, unnest(range(len(list_filter(list_transform({SPLIT('body_text')}, lambda x: {STRIP('x')}), lambda x: x <> '')))) AS sentence_index FROM b_sections)"
AREA = "CASE WHEN section_path <> '' AND section_path <> 'DOCUMENT' THEN section_path WHEN section_heading <> '' AND section_heading <> 'Document Body' THEN section_heading ELSE 'DOCUMENT' END"
TYPE, KEYWORD, SUBMISSION = (_case("requirement_text", p) for p in (L.REQUIREMENT_TYPES, L.TRIGGER_KEYWORDS, L.SUBMISSION_CATEGORIES))
EXPORT_SQL = f""", {SENTENCES},
e_sections AS (SELECT project_id, filename AS source_document, {AREA} AS pws_area, section_path, section_heading, 'section' AS source_kind, sentence AS requirement_text, provider, content_sha256, 'requirement_statement' AS d FROM s_raw),
e_tables AS (SELECT project_id, filename, {AREA}, section_path, section_heading, 'table', unnest(list_transform(string_split(body_text, chr(10)), lambda x: {INLINE('x')})), provider, content_sha256, 'table_requirement' FROM b_tables),
e_records AS (SELECT project_id, filename, {AREA}, section_path, section_heading, 'requirement_record', sentence, provider, content_sha256, NULL FROM s_raw WHERE {_case('sentence', L.REQUIREMENT_TYPES)} IS NOT NULL),
e_all AS (SELECT *, {TYPE} AS t, {KEYWORD} AS k FROM (SELECT * FROM e_sections UNION ALL SELECT * FROM e_tables UNION ALL SELECT * FROM e_records) WHERE requirement_text <> ''),
e_rows AS (SELECT project_id, source_document, pws_area, section_path, section_heading, source_kind, coalesce(t, d) AS requirement_type, CASE WHEN source_kind = 'requirement_record' THEN coalesce(k, 'classified') ELSE k END AS trigger_keyword, requirement_text, provider, content_sha256 FROM e_all WHERE k IS NOT NULL OR source_kind = 'requirement_record'),
export AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY project_id, source_document, pws_area, source_kind, trigger_keyword, requirement_text ORDER BY section_path, section_heading, requirement_type, provider, content_sha256) AS rn FROM e_rows) WHERE rn = 1)
"""


def _export(spark: SparkSession, sf: str) -> DataFrame:
    return X.project_requirement_export(B.sections(spark, sf), B.tables(spark, sf))


@query("requirement_export", EXPORT_SQL + "SELECT * FROM export")
def requirement_export(spark, sf):
    """All requirement statements of every project, once each (flagship)."""
    return _export(spark, sf)


query("submission_requirements", EXPORT_SQL + f"SELECT * FROM (SELECT *, coalesce({SUBMISSION}, CASE WHEN requirement_type = 'submission' THEN 'content' END) AS submission_category FROM export) WHERE submission_category IS NOT NULL")(lambda s, d: X.submission_requirements(_export(s, d)))
_ANY_KEYWORD = lambda c: f"{_case(c, L.TRIGGER_KEYWORDS)} IS NOT NULL"
_HEAD_OF = "CASE WHEN regexp_matches(y.line, '^#+\\s+(.+)$') THEN regexp_extract(y.line, '^#+\\s+(.+)$', 1) WHEN regexp_matches(y.line, '^(\\d+(?:\\.\\d+)*)\\s+(.+)$') THEN regexp_extract(y.line, '^(\\d+(?:\\.\\d+)*)\\s+(.+)$', 1) || ' ' || regexp_extract(y.line, '^(\\d+(?:\\.\\d+)*)\\s+(.+)$', 2) WHEN regexp_matches(y.line, '^\\*\\*(.+?)\\*\\*$') THEN regexp_extract(y.line, '^\\*\\*(.+?)\\*\\*$', 1) WHEN regexp_matches(y.line, '^[A-Z][A-Z0-9 /(),.&:-]{6,120}$') THEN y.line ELSE '' END"
_MD_PARTS = f"list_filter(list_transform(string_split(regexp_replace({STRIP("a.carry || ' ' || y.line")}, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: {STRIP('x')}), lambda x: x <> '')"
_MARKED_DOWN = f""", g0 AS (SELECT *, prefix || regexp_replace(coalesce(extracted_text, ''), '([.!?])\\s+([A-Z])', '\\1 ' || prefix || '\\2', 'g') AS md FROM b_documents), g1 AS (SELECT n.project_id, n.filename, n.provider, n.content_sha256, n.id, list_transform(regexp_split_to_array(md, '\\r\\n|[\\n\\r\\x0B\\x0C\\x1C\\x1D\\x1E\\x{{85}}\\x{{2028}}\\x{{2029}}]'), lambda z: {STRIP("regexp_replace(z, '[ \\t]{2,}', ' ', 'g')")}) AS ls FROM b_normalizations n JOIN g0 USING (document_id) WHERE normalization_status = 'normalized'),
g2 AS (SELECT *, list_reduce(list_prepend(struct_pack(line := '', area := 'DOCUMENT', carry := '', out := CAST([] AS STRUCT(area VARCHAR, sentence VARCHAR)[])), list_transform(ls, lambda z: struct_pack(line := z, area := '', carry := '', out := CAST([] AS STRUCT(area VARCHAR, sentence VARCHAR)[])))), lambda a, y:
  CASE WHEN y.line = '' OR {_HEAD_OF} <> '' THEN struct_pack(line := '', area := CASE WHEN {STRIP("regexp_replace(" + _HEAD_OF + ", '^[* ]+|[* ]+$', '', 'g')")} <> '' THEN {STRIP("regexp_replace(" + _HEAD_OF + ", '^[* ]+|[* ]+$', '', 'g')")} ELSE a.area END, carry := '', out := a.out)
  ELSE struct_pack(line := '', area := a.area, carry := coalesce(list_filter({_MD_PARTS}, lambda x: NOT ({_ANY_KEYWORD('x')}) AND NOT regexp_matches(x, '[.!?]$'))[-1], ''), out := list_concat(a.out, list_transform(list_filter({_MD_PARTS}, lambda x: {_ANY_KEYWORD('x')}), lambda x: struct_pack(area := a.area, sentence := x)))) END).out AS found FROM g1),
g3 AS (SELECT project_id, filename, provider, content_sha256, unnest(found) AS f FROM g2), g4 AS (SELECT project_id, filename AS source_document, f.area AS pws_area, f.area AS section_path, f.area AS section_heading, 'markdown_sentence' AS source_kind, f.sentence AS requirement_text, provider, coalesce(content_sha256, '') AS content_sha256 FROM g3),
marked AS (SELECT project_id, source_document, pws_area, section_path, section_heading, source_kind, coalesce({TYPE}, 'requirement_statement') AS requirement_type, {KEYWORD} AS trigger_keyword, requirement_text, provider, content_sha256 FROM g4 WHERE {KEYWORD} IS NOT NULL)"""
_ALL_ROWS = EXPORT_SQL.rstrip() + _MARKED_DOWN + ", all_rows AS (SELECT * FROM e_rows UNION ALL SELECT * FROM marked) SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY project_id, source_document, pws_area, source_kind, trigger_keyword, requirement_text ORDER BY section_path, section_heading, requirement_type, provider, content_sha256) AS rn FROM all_rows) WHERE rn = 1"
query("requirement_export_all", _ALL_ROWS)(lambda s, d: X.project_requirement_export(B.sections(s, d), B.tables(s, d), None, B.normalizations(s, d).where("normalization_status = 'normalized'").withColumns({"section_path": F.lit(""), "section_heading": F.lit("")})))
query("split_sentences", f", {SENTENCES} SELECT document_id, sentence_index, sentence FROM s_raw")(lambda s, d: X.split_sentences(B.sections(s, d), "body_text").select("document_id", "sentence_index", "sentence"))
query("extract_requirements", f", {SENTENCES} SELECT document_id, section_path, sentence_index AS requirement_index, sentence AS requirement_text, {_case('sentence', L.REQUIREMENT_TYPES)} AS requirement_type FROM s_raw WHERE {_case('sentence', L.REQUIREMENT_TYPES)} IS NOT NULL")(lambda s, d: X.extract_requirements(B.sections(s, d)).select("document_id", "section_path", "requirement_index", "requirement_text", "requirement_type"))
query("markdown_export", _MARKED_DOWN + " SELECT * FROM marked")(lambda s, d: X.markdown_export_rows(B.normalizations(s, d).where("normalization_status = 'normalized'").withColumns({"section_path": F.lit(""), "section_heading": F.lit("")})))
FRAGMENTS = f"list_filter(list_transform(string_split(regexp_replace({INLINE('normalized_text')}, '([.;!?])\\s+([A-Z(])', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda x: {STRIP('x')}), lambda x: x <> '')"
query("split_fragments", f" SELECT document_id, document_order, unnest({FRAGMENTS}) AS fragment, unnest(range(len({FRAGMENTS}))) AS fragment_index FROM b_blocks")(lambda s, d: X.split_fragments(B.blocks(s, d), "normalized_text").select("document_id", "document_order", "fragment_index", "fragment"))
_GUARDED = "regexp_replace(regexp_replace(regexp_replace(body_text, '(\\d)\\.(\\d)', '\\1' || chr(1) || '\\2', 'g'), '(^|[^\\p{L}\\p{N}_])(e|i|u)\\.(g|e|s)\\.', '\\1\\2' || chr(1) || '\\3' || chr(1), 'gi'), '(^|[^\\p{L}\\p{N}_])(etc|vs|mr|mrs|ms|dr|no|inc)\\.', '\\1\\2' || chr(1), 'gi')"
_GUARDED_PARTS = f"list_filter(list_transform(regexp_extract_all({_GUARDED}, '([^.!?]+[.!?]*)', 1), lambda x: regexp_replace(replace(x, chr(1), '.'), '^\\s+|\\s+$', '', 'g')), lambda x: x <> '')"
query("protected_sentences", f" SELECT document_id, unnest({_GUARDED_PARTS}) AS sentence, CAST(unnest(range(len({_GUARDED_PARTS}))) AS INTEGER) AS i FROM b_body")(lambda s, d: B.sections(s, d).select("document_id", F.posexplode(X.split_protected_sentences(F.col("body_text"))).alias("i", "sentence")))
_UNESCAPED = lambda c: "replace(" * 8 + c + ", '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&nbsp;', chr(160)), '&middot;', '·'), '&copy;', '©'), '&amp;', '&')"
_NUMBERED_HEAD = "^#{1,6}\\s+(\\d+(?:\\.\\d+)*)\\s+(.*\\S)\\s*$"
_TRIGGER = "(?i)(?:^|[^\\p{L}\\p{N}_])(shall|must|required|requires|is required to)(?:$|[^\\p{L}\\p{N}_])"
_NUMBERED_EXPORT = f""", u0 AS (SELECT document_id, document_order AS pos, CASE WHEN block_type = 'paragraph' THEN 'The Contractor shall ' ELSE '# ' END || normalized_text AS line FROM b_blocks),
u1 AS (SELECT document_id, pos, {STRIP('replace(' + _UNESCAPED("regexp_replace(regexp_replace(line, '(?s)<!--.*?-->', '', 'g'), '<[^>]+>', '', 'g')") + ", chr(160), ' ')")} AS line FROM u0), u2 AS (SELECT *, CASE WHEN regexp_matches(line, '{_NUMBERED_HEAD}') THEN regexp_extract(line, '{_NUMBERED_HEAD}', 1) END AS raw FROM u1 WHERE NOT regexp_matches(line, '^\\[[^\\]]+\\]\\(\\.\\)\\s*$')),
u3 AS (SELECT *, CASE WHEN CAST(string_split(raw, '.')[1] AS BIGINT) >= 3 THEN (CAST(string_split(raw, '.')[1] AS BIGINT) - 2) || regexp_extract(raw, '^\\d+(.*)$', 1) ELSE raw END AS number, max(CASE WHEN raw IS NOT NULL THEN pos END) OVER (PARTITION BY document_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS head_pos FROM u2),
u4 AS (SELECT b.document_id, b.head_pos, any_value(h.number) AS number, any_value({STRIP(f"regexp_replace(regexp_extract(h.line, '{_NUMBERED_HEAD}', 2), '^{chr(92)}((?:U(?://FOUO)?|C|S|TS(?://SCI)?){chr(92)}){chr(92)}s*', '')")}) AS title, string_agg(b.line, chr(10) ORDER BY b.pos) AS body FROM u3 b JOIN u3 h ON h.document_id = b.document_id AND h.pos = b.head_pos WHERE b.raw IS NULL GROUP BY 1, 2),
u5 AS (SELECT *, unnest(list_filter(list_transform(regexp_split_to_array(replace(body, chr(10) || chr(10), chr(10)), '\\n{{2,}}'), lambda x: {STRIP('x')}), lambda x: x <> '' AND NOT (starts_with(x, '[') AND ends_with(x, '](.)')))) AS block, unnest(range(len(list_filter(list_transform(regexp_split_to_array(replace(body, chr(10) || chr(10), chr(10)), '\\n{{2,}}'), lambda x: {STRIP('x')}), lambda x: x <> '' AND NOT (starts_with(x, '[') AND ends_with(x, '](.)')))))) AS bi FROM u4 WHERE NOT (number = '1' AND contains(title, 'Table of Contents')) AND NOT (number = '2' AND title = 'Figures')),
u6 AS (SELECT document_id, head_pos, number, title, bi, {STRIP("regexp_replace(replace(unnest(string_split(regexp_replace(block, '([.;)])\\s+([A-Z(])', '\\1' || chr(1) || '\\2', 'g'), chr(1))), '•', ' '), '\\s+', ' ', 'g')")} AS part, unnest(range(len(string_split(regexp_replace(block, '([.;)])\\s+([A-Z(])', '\\1' || chr(1) || '\\2', 'g'), chr(1))))) AS pi FROM u5),
u7 AS (SELECT *, row_number() OVER (PARTITION BY document_id, head_pos, part ORDER BY bi, pi) AS rn FROM u6 WHERE length(part) >= 20 AND regexp_matches(part, '{_TRIGGER}') AND NOT contains(lower(part), 'table of contents') AND NOT contains(lower(part), 'figures')),
u8 AS (SELECT document_id, head_pos, number AS section_number, title AS section_title, part AS requirement_text, number || '-' || lpad(CAST(row_number() OVER (PARTITION BY document_id, head_pos ORDER BY bi, pi) AS VARCHAR), 3, '0') AS requirement_id, lower(regexp_extract(part, '{_TRIGGER}', 1)) AS trigger_keyword, string_split(number, '.') AS n FROM u7 WHERE rn = 1),
u9 AS (SELECT document_id, section_number, max_by(section_title, head_pos) AS t FROM u8 GROUP BY 1, 2), v0 AS (SELECT *, n[1] AS level_1_number, CASE WHEN len(n) >= 2 THEN array_to_string(n[1:2], '.') ELSE '' END AS level_2_number, CASE WHEN len(n) >= 3 THEN array_to_string(n[1:3], '.') ELSE '' END AS level_3_number FROM u8)
SELECT v0.* EXCLUDE (n, head_pos), coalesce(a.t, '') AS level_1_title, coalesce(b.t, '') AS level_2_title, coalesce(c.t, '') AS level_3_title FROM v0 LEFT JOIN u9 a ON a.document_id = v0.document_id AND a.section_number = level_1_number LEFT JOIN u9 b ON b.document_id = v0.document_id AND b.section_number = level_2_number LEFT JOIN u9 c ON c.document_id = v0.document_id AND c.section_number = level_3_number"""
query("hierarchy_export", _NUMBERED_EXPORT)(lambda s, d: X.hierarchy_requirement_export(_markdown(s, d)))
_LINES = "list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_replace(x, '\\s', '', 'g') <> '')"
_SUMMARY = {n: f"{STRIP("array_to_string(list_transform(" + _LINES + ", lambda x: regexp_replace(x, '\\s+$', '')), chr(10))")}" for n in X.SUMMARY_TEXTS} | {n: f"array_to_string(list_transform({_LINES}, lambda x: {STRIP('x')}), chr(10))" for n in X.SUMMARY_LISTS}
query("summary_sections", " SELECT doc_id, " + ", ".join(f"{c} AS {n.replace(' ', '_')}" for n, c in _SUMMARY.items()) + " FROM documents")(lambda s, d: _summaries(s, d))


def _summaries(spark: SparkSession, sf: str) -> DataFrame:
    """Every document's text as each of the eight sections of a summary: as prose, and line by line as bullets."""
    text = F.coalesce("text", F.lit(""))
    parts = [F.concat(F.lit(f"## {n.title()}\n"), text if n in X.SUMMARY_TEXTS else F.regexp_replace(text, r"(?m)^\s*(?=\S)", "- "), F.lit("\n\n")) for n in (*X.SUMMARY_TEXTS, *X.SUMMARY_LISTS)]
    out = X.parse_summary_sections(B.spread(B.read(spark, sf, "documents").select("doc_id", "text"), "doc_id").select("doc_id", F.concat(*parts).alias("markdown"))).drop("markdown")
    return out.withColumns({n.replace(" ", "_"): F.array_join(n.replace(" ", "_"), "\n") for n in X.SUMMARY_LISTS})


def _markdown(spark: SparkSession, sf: str) -> DataFrame:
    line = F.when(F.col("block_type") == "paragraph", F.concat(F.lit("The Contractor shall "), "normalized_text")).otherwise(F.concat(F.lit("# "), "normalized_text"))
    lists = B.blocks(spark, sf).groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("document_order", line.alias("x")))).alias("l"))
    return lists.select("document_id", F.array_join(F.transform("l", lambda s: s["x"]), "\n").alias("normalized_markdown"))


_LATEST = ", latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY project_id, filename ORDER BY created_at DESC, id) AS rn FROM b_documents WHERE extraction_status = 'extracted' AND lower(filename) <> 'project.json') WHERE rn = 1)"
_NEWEST = ", newest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY updated_at DESC, id) AS rn FROM b_normalizations WHERE {}) WHERE rn = 1)"
query("latest_documents", _LATEST + " SELECT id, project_id, filename, content_sha256 FROM latest")(lambda s, d: R.latest_documents(B.documents(s, d)).select("id", "project_id", "filename", "content_sha256"))
query("documents_with_normalization", _LATEST + _NEWEST.format("normalization_status = 'normalized'") + " SELECT l.id, l.project_id, l.filename, n.provider AS normalization_provider, n.content_sha256 AS normalized_sha256 FROM latest l LEFT JOIN newest n ON l.id = n.document_id WHERE coalesce(l.extracted_text, '') <> ''")(lambda s, d: R.documents_with_normalization(B.documents(s, d), B.normalizations(s, d)).select("id", "project_id", "filename", "normalization_provider", "normalized_sha256"))
query("active_projects", ", names AS (SELECT project_id, filename, max(created_at) AS last_at FROM b_documents GROUP BY ALL), recent AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY last_at DESC, filename) AS r FROM names) SELECT c.project_id, document_count, filenames FROM (SELECT project_id, count(*) AS document_count FROM b_documents GROUP BY 1) c JOIN (SELECT project_id, string_agg(filename, '|' ORDER BY r) AS filenames FROM recent WHERE r <= 5 GROUP BY 1) l USING (project_id)")(lambda s, d: R.active_projects(B.documents(s, d)).select("project_id", "document_count", F.array_join("filenames", "|").alias("filenames")))
query("document_status", _NEWEST.format("provider = 'docling'") + " SELECT d.id, d.project_id, d.filename, coalesce(n.normalization_status, 'pending') AS status FROM b_documents d LEFT JOIN newest n ON d.id = n.document_id WHERE d.extraction_status = 'extracted'")(lambda s, d: R.document_status(B.documents(s, d), B.normalizations(s, d), "docling"))
query("project_status", ", f AS (SELECT document_id, max(CASE WHEN normalization_status = 'normalized' THEN 1 ELSE 0 END) AS n, max(CASE WHEN normalization_status = 'failed' THEN 1 ELSE 0 END) AS f FROM b_normalizations WHERE provider = 'docling' GROUP BY 1), t AS (SELECT d.project_id, count(*) AS total, CAST(sum(coalesce(n, 0)) AS BIGINT) AS normalized, CAST(sum(coalesce(f, 0)) AS BIGINT) AS failed FROM b_documents d LEFT JOIN f ON d.id = f.document_id WHERE extraction_status = 'extracted' GROUP BY 1) SELECT *, greatest(total - normalized - failed, 0) AS pending FROM t")(lambda s, d: R.project_status(B.documents(s, d), B.normalizations(s, d), "docling"))
query("latest_artifact", ", n AS (SELECT *, row_number() OVER (PARTITION BY project_id, document_id ORDER BY updated_at DESC, id) AS rn FROM b_normalizations WHERE normalization_status = 'normalized') SELECT id, project_id, document_id FROM n WHERE rn = 1")(lambda s, d: R.latest_artifact(B.normalizations(s, d)).select("id", "project_id", "document_id"))
query("filter_filename", " SELECT id, filename FROM b_documents WHERE filename ILIKE '%pws%'")(lambda s, d: R.filter_filename(B.documents(s, d), "%pws%").select("id", "filename"))
query("filter_filename_needle", " SELECT id, filename FROM b_documents WHERE contains(lower(filename), 'section')")(lambda s, d: R.filter_filename_needle(B.documents(s, d), "%Section%").select("id", "filename"))
query("project_rows", " SELECT document_id, section_index FROM b_sections WHERE project_id = 'src3'")(lambda s, d: R.project_rows(B.sections(s, d), "src3", ("filename", "section_index", "document_id")).select("document_id", "section_index"))
query("plan_normalization", _LATEST + _NEWEST.format("provider = 'docling'") + " SELECT l.id, l.project_id, l.filename, CASE WHEN l.content_sha256 = n.content_sha256 AND n.normalization_status = 'normalized' THEN 'skipped' ELSE 'todo' END AS plan FROM latest l LEFT JOIN newest n ON l.id = n.document_id")(lambda s, d: R.plan_normalization(B.documents(s, d), B.normalizations(s, d), "docling"))


def _files(spark: SparkSession, sf: str) -> DataFrame:
    """Incoming files: the newest stored content, changed for every third document, and one new name per project."""
    new = R.newest(B.documents(spark, sf), R.VERSION)
    sha = F.when(F.expr("doc_id % 3 = 0"), "changed").otherwise(F.col("content_sha256"))
    extra = B.documents(spark, sf).select("project_id").distinct().select("project_id", F.lit("new.docx").alias("filename"), F.lit("n").alias("content_sha256"))
    return new.select("project_id", "filename", sha.alias("content_sha256")).unionByName(extra)


_FILES = ", stored AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY project_id, filename ORDER BY created_at DESC, id) AS rn FROM b_documents) WHERE rn = 1), files AS (SELECT project_id, filename, CASE WHEN doc_id % 3 = 0 THEN 'changed' ELSE content_sha256 END AS content_sha256 FROM stored UNION ALL SELECT DISTINCT project_id, 'new.docx', 'n' FROM b_documents), plan AS (SELECT f.*, CASE WHEN f.content_sha256 = s.content_sha256 THEN 'skipped' ELSE 'uploaded' END AS status FROM files f LEFT JOIN stored s USING (project_id, filename))"
query("plan_ingest", _FILES + " SELECT * FROM plan")(lambda s, d: R.plan_ingest(_files(s, d), B.documents(s, d)))
query("plan_counts", _FILES + " SELECT project_id, status, count(*) AS n FROM plan GROUP BY ALL")(lambda s, d: R.plan_counts(R.plan_ingest(_files(s, d), B.documents(s, d))))


def _normalized(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    rows = B.normalizations(spark, sf).select("document_id", "provider", "normalization_status", F.col("doc_id").alias("created_at"))
    old = rows.where("created_at % 4 <> 0")
    new = rows.where("created_at % 2 = 0 and created_at % 4 <> 0 or created_at % 12 = 0 and provider = 'docling_pws'").withColumns({"created_at": F.lit(-1).cast("long"), "normalization_status": F.lit("again")})
    return old, new


def _kept(spark: SparkSession, write, first: DataFrame, then: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """A table of the shared folder after two batches, of which the second comes twice, the second time with other rows."""
    table = Table(spark, passing(spark), ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in first.schema), keys, 8)
    write(table, first, "query", 0)
    write(table, then, "query", 1)
    write(table, then.limit(0), "query", 1)
    return table.read()


_UPSERT_SQL = " SELECT document_id, provider, CASE WHEN doc_id % 4 = 0 OR doc_id % 2 = 0 THEN 'again' ELSE normalization_status END AS normalization_status, CASE WHEN doc_id % 4 = 0 THEN -1 ELSE doc_id END AS created_at FROM b_normalizations WHERE doc_id % 4 <> 0 OR (doc_id % 12 = 0 AND provider = 'docling_pws')"
query("upsert_normalizations", _UPSERT_SQL)(lambda s, d: R.upsert(*_normalized(s, d)))
query("table_upsert", _UPSERT_SQL)(lambda s, d: _kept(s, upsert_into, *_normalized(s, d), ("document_id",)))
_REPLACE_SQL = " SELECT document_id, CASE WHEN doc_id % 3 = 0 THEN 'fresh' ELSE section_path END AS section_path FROM b_sections"
query("table_replace", _REPLACE_SQL)(lambda s, d: _kept(s, replace_in, B.sections(s, d).select("document_id", "section_path"), B.sections(s, d).where("doc_id % 3 = 0").select("document_id", F.lit("fresh").alias("section_path")), ("document_id",)))
query("replace_by_document", _REPLACE_SQL)(lambda s, d: R.replace_by_document(B.sections(s, d).select("document_id", "section_path"), B.sections(s, d).where("doc_id % 3 = 0").select("document_id", F.lit("fresh").alias("section_path"))))
query("index_status", " SELECT project_id, count(*) AS points FROM b_chunks GROUP BY 1")(lambda s, d: R.index_status(B.chunks(s, d)))
query("artifact_counts", f", {SENTENCES} SELECT project_id, (SELECT count(*) FROM b_sections x WHERE x.project_id = p.project_id) AS sections, (SELECT count(*) FROM s_raw r WHERE r.project_id = p.project_id AND {_case('sentence', L.REQUIREMENT_TYPES)} IS NOT NULL) AS requirements, (SELECT count(*) FROM b_tables t WHERE t.project_id = p.project_id) AS tables FROM (SELECT DISTINCT project_id FROM b_sections) p")(lambda s, d: R.artifact_counts(B.sections(s, d), X.extract_requirements(B.sections(s, d)), B.tables(s, d)))


def _jobs(spark: SparkSession, sf: str) -> DataFrame:
    e = B.read(spark, sf, "events")
    jobs = e.groupBy("user_id").agg(F.count("*").alias("files"), F.sum((F.col("event_id") % 2).cast("long")).alias("uploaded"), F.count("*").alias("documents"), F.sum((F.col("event_id") % 3 == 0).cast("long")).alias("normalized"))
    return R.package_job_progress(jobs.withColumns({"indexed": F.expr("user_id % 2 = 0"), "status": F.expr("case when user_id % 5 = 0 then 'completed' when user_id % 7 = 0 then 'failed' else 'running' end")})).select("user_id", "progress")


query("package_job_progress", ", j AS (SELECT user_id, count(*) AS files, sum(event_id % 2) AS up, sum(CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END) AS norm FROM events GROUP BY 1), r AS (SELECT user_id, least(greatest(round(least(up / files, 1.0) * 45 + least(norm / files, 1.0) * 45 + CASE WHEN user_id % 2 = 0 THEN 10.0 ELSE 0.0 END), 2.0), 99.0) AS p FROM j) SELECT user_id, CAST(CASE WHEN user_id % 5 = 0 THEN 100 WHEN user_id % 7 = 0 THEN greatest(p, 1) ELSE p END AS INTEGER) AS progress FROM r")(_jobs)


def _text(name: str, column, sql: str, table: str = "documents", col: str = "text", key: str = "doc_id") -> None:
    """A scalar function over a whole table: key and value."""
    query(name, f" SELECT {key}, {sql} AS value FROM {table}" if sql else None)(lambda s, d: B.read(s, d, table).select(key, column(F.col(col)).alias("value")))


_text("normalize_inline", T.normalize_inline, INLINE("text"))
_text("clean_extracted_text", T.clean_extracted_text, STRIP("regexp_replace(array_to_string(list_filter(list_transform(string_split(regexp_replace(regexp_replace(coalesce(text, ''), '\\r\\n?', chr(10), 'g'), '\\[bookmark:[^\\]]+\\]', '', 'g'), chr(10)), lambda x: regexp_replace(regexp_replace(x, '[ \\t]{2,}', ' ', 'g'), '^\\s+|\\s+$', '', 'g')), lambda x: x NOT IN ('UNCLASSIFIED', 'CLASSIFIED') AND NOT regexp_matches(x, '^(PAGE|Page)\\s+\\d+\\b')), chr(10)), '\\n{4,}', chr(10) || chr(10) || chr(10), 'g')"))
_text("is_weak_text", T.is_weak_text, f"length({STRIP('text')}) < 1500 OR CASE WHEN length(regexp_replace({STRIP('text')}, '\\s', '', 'g')) > 0 THEN length(regexp_replace({STRIP('text')}, '[^\\p{{L}}]', '', 'g')) / length(regexp_replace({STRIP('text')}, '\\s', '', 'g')) ELSE 0 END < 0.55")
_text("strip_classification", lambda c: T.strip_classification(F.concat(F.lit("(U) (S//NF) "), c)), STRIP("text"))
_text("strip_inline_markdown", lambda c: T.strip_inline_markdown(F.concat(F.lit("**A** __b__ `c` "), c)), "regexp_replace(regexp_replace(regexp_replace('**A** __b__ `c` ' || text, '\\*\\*(.*?)\\*\\*', '\\1', 'g'), '__(.*?)__', '\\1', 'g'), '`([^`]+)`', '\\1', 'g')")
_text("strip_tags", T.strip_tags, "regexp_replace(regexp_replace(coalesce(html, ''), '(?s)<!--.*?-->', '', 'g'), '<[^>]+>', '', 'g')", "pages", "html", "page_id")
def _entities_sql(c: str) -> str:
    """HTML's rule for character references: the longest known name, with its semicolon or, for the old ones, without; numbers in both bases."""
    import html
    from html.entities import html5

    q = lambda x: "'" + x.replace("'", "''") + "'"
    named = f"map([{', '.join(map(q, html5))}], [{', '.join(map(q, html5.values()))}])"
    odd = {n: html.unescape(f"&#{n};") for n in (*range(0x20), *range(0x7F, 0xA0), *range(0xFDD0, 0xFDF0), *(k * 0x10000 + x for k in range(17) for x in (0xFFFE, 0xFFFF)))}
    odd = {n: x for n, x in odd.items() if x != chr(n)}
    others = f"map([{', '.join(map(str, odd))}], [{', '.join(map(q, odd.values()))}])"
    digits = "lower(regexp_extract(p, '^#[xX]?([0-9a-fA-F]+)', 1))"
    base = "CASE WHEN regexp_matches(p, '^#[xX]') THEN 16 ELSE 10 END"
    number = f"CASE WHEN length(ltrim({digits}, '0')) > 7 THEN 1114112 ELSE list_reduce(list_transform(string_split({digits}, ''), lambda y: CAST(instr('0123456789abcdef', y) - 1 AS BIGINT)), lambda u, v: u * {base} + v) END"
    char = f"list_transform([{number}], lambda n: CASE WHEN {others}[n] IS NOT NULL THEN {others}[n] WHEN n BETWEEN 55296 AND 57343 OR n > 1114111 THEN chr(65533) ELSE chr(CAST(n AS INTEGER)) END)[1]"
    numbered = "^#(?:[0-9]+|[xX][0-9a-fA-F]+);?"
    name = "regexp_extract(p, '^[^\\t\\n\\f <&#;]{1,32};?', 0)"
    known = f"list_filter(list_transform(range(length({name}), 1, -1), lambda k: {named}[p[1:k]] || substring(p, k + 1)), lambda y: y IS NOT NULL)[1]"
    part = f"CASE WHEN regexp_matches(p, '{numbered}') THEN {char} || regexp_replace(p, '{numbered}', '') ELSE coalesce({known}, '&' || p) END"
    parts = f"string_split(coalesce({c}, ''), '&')"
    return f"array_to_string(list_concat([{parts}[1]], list_transform({parts}[2:], lambda p: {part})), '')"


_text("html_unescape", T.html_unescape, _entities_sql("html"), "pages", "html", "page_id")
_text("compact_text", T.compact_text, f"CASE WHEN length({STRIP('text')}) <= 700 THEN {STRIP('text')} ELSE regexp_replace(substring({STRIP('text')}, 1, 697), '\\s+$', '') || '...' END")
_SLUG = "regexp_replace(substring(regexp_replace(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 80), '-+$', '')"
_text("slug", T.slug, f"CASE WHEN {_SLUG} = '' THEN 'item' ELSE {_SLUG} END")
_text("document_digest", lambda c: T.document_digest(F.lit("a.docx"), c), "'doc-' || substring(sha256('a.docx' || chr(10) || coalesce(text, '')), 1, 16)")
_text("tokens_search", lambda c: F.array_join(F.array_sort(T.tokens_search(c)), " "), f"array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]{{3,}}'), lambda x: x NOT IN ({', '.join(repr(w) for w in L.SEARCH_STOPWORDS)})))), ' ')")
_text("normalized_requirement", T.build_normalized_requirement, f"regexp_replace({INLINE('text')}, '^\\(?[A-Za-z0-9.\\-]+\\)?\\s+', '')")
_NOISE = "CASE document_order % 8 WHEN 0 THEN '  - (U) ' || normalized_text WHEN 1 THEN ' 0123 ' || normalized_text || '  ' WHEN 2 THEN 'Figure is UNCLASSIFIED//FOUO ' || normalized_text WHEN 3 THEN normalized_text || ' Error! Bookmark not defined. ( FOUO ) end' WHEN 4 THEN ' (Unclassified//FOUO) ' WHEN 5 THEN 'Removed for Classification [image: ] ' || normalized_text WHEN 6 THEN ' 4711' ELSE 'Appendices A and B' END"
_CLEANED = f""", l0 AS (SELECT document_id, document_order, regexp_replace(regexp_replace(({_NOISE}), '\\s+$', ''), '^\\s*\\d{{3,4}}\\s+(\\S)', '\\1') AS line FROM b_blocks), l1 AS (SELECT *, ltrim(line, ' ') AS core FROM l0),
l2 AS (SELECT *, {STRIP(f"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(core, '{chr(92)}[image:{chr(92)}s*{chr(92)}]', ' ', 'g'), '(?i){chr(92)}({chr(92)}s*{L.SIMPLE_MARKING}{chr(92)}s*{chr(92)})', '', 'g'), '{L.REMOVED_MARK}', '', 'g'), '{L.WORD_FRAGMENTS}', ' ', 'g'), '{L.FIGURE_MARK}', '', 'g'), '{chr(92)}s+', ' ', 'g')")} AS said FROM l1)
SELECT document_id, document_order, CASE WHEN core = '' OR regexp_matches(line, '{L.BLANK_NUMBER_LINE}') OR regexp_matches(core, '{L.BLANK_NUMBER_LINE}') OR regexp_matches(core, '{L.UNCLASSIFIED_LINE}') OR regexp_matches(core, '{L.FIGURE_LINE}') OR regexp_matches(core, '^(?i)Appendices\\b') THEN '' WHEN length(line) > length(core) AND regexp_matches(said, '^[-*]\\s+.+$') THEN repeat(' ', length(line) - length(core)) || said ELSE said END AS value FROM l2"""
query("clean_line", _CLEANED)(lambda s, d: B.blocks(s, d).select("document_id", "document_order", T.clean_line(F.expr(_NOISE)).alias("value")))
_MARGIN_JOIN = STRIP("regexp_replace(array_to_string(list_transform(list_filter(string_split(replace(coalesce(text, ''), chr(13), chr(10)), chr(10)), lambda x: NOT regexp_matches(x, '^\\s*\\d{1,4}\\s*$')), lambda x: regexp_replace(x, '^\\s*\\d{1,4}(?:\\s{2,}|\\t+)(\\S)', '\\1')), ' '), '[ \\t]{2,}', ' ', 'g')")
_MARGIN_KEPT = " OR ".join(f"regexp_matches(m, '{p}')" for p in ("^\\d+(?:\\.\\d+)*\\.?\\s+\\S", L.SECTION_HEADING, L.APPENDIX_HEADING, L.TOC_TITLE, L.TOC_ENTRY, L.PAGE_LINE, L.DATE_ONLY))
_MARGIN_DONE = f"CASE WHEN {_MARGIN_KEPT} THEN m ELSE {STRIP("regexp_replace(m, '^\\d{1,4}\\s+(\\S)', '\\1')")} END"
query("strip_margin_line_numbers", f", y0 AS (SELECT doc_id, {_MARGIN_JOIN} AS m FROM documents) SELECT doc_id, {_MARGIN_DONE} AS value FROM y0")(lambda s, d: B.read(s, d, "documents").select("doc_id", T.strip_margin_line_numbers(F.col("text")).alias("value")))
#: RE2's word boundaries know ASCII alone: other letters are put between underscores, told from given ones by a private character.
_LETTER = "((?:[^\\x00-\\x7F\\P{L}]|[^\\x00-\\x7F\\P{Nd}]|[^\\x00-\\x7F\\P{Mn}])+)"
_WORDED = f"regexp_replace(coalesce(text, ''), '{_LETTER}', '_' || chr(57344) || '\\1' || chr(57344) || '_', 'g')"
_LABELLESS = f"regexp_replace(regexp_replace(regexp_replace({_WORDED}, '\\b(?:Table|Figure)[\\s\\x0B]+\\d+\\b', ' ', 'gi'), '\\|[\\s\\x0B|]*', ' ', 'g'), '\\b(?:[A-Z]{{2,}}[\\s\\x0B]+){{3,}}[A-Z]{{2,}}\\b', ' ', 'g')"
_COMPANION = STRIP(f"regexp_replace(replace(replace({_LABELLESS}, '_' || chr(57344), ''), chr(57344) || '_', ''), '[\\s\\x0B]+', ' ', 'g')")
_text("clean_companion_text", T.clean_companion_text, f"CASE WHEN length({_COMPANION}) <= 500 THEN {_COMPANION} ELSE regexp_replace(substring({_COMPANION}, 1, 497), '\\s+$', '') || '...' END")
_text("tokens_link", lambda c: F.array_join(F.array_sort(T.tokens_link(c)), " "), f"array_to_string(list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(coalesce(text, ''), '[A-Za-z][A-Za-z0-9/&\\-]{{2,}}'), lambda x: lower(x)), lambda x: x NOT IN ({', '.join(repr(w) for w in L.LINK_STOPWORDS)})))), ' ')")
_text("tokens_title", lambda c: F.array_join(F.array_sort(T.tokens_title(c)), " "), f"array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+'), lambda x: length(x) > 2 AND x NOT IN ({', '.join(repr(w) for w in L.TITLE_STOPWORDS)})))), ' ')")
_LETTERS = lambda p: f"length(regexp_replace(normalized_text, '[^\\p{{{p}}}]', '', 'g'))"
query("is_upper_heading", f" SELECT document_id, document_order, {_LETTERS('L')} >= 6 AND length(normalized_text) <= 140 AND {_LETTERS('Lu')} / {_LETTERS('L')} > 0.85 AS value FROM b_blocks")(lambda s, d: B.blocks(s, d).select("document_id", "document_order", T.is_upper_heading(F.col("normalized_text")).alias("value")))
_SHA = f"sha1(unhex('{L.URL_NAMESPACE}') || encode(project_id || ':' || filename || ':' || chunk_index))"
query("point_ids", f", h AS (SELECT vec_id, lower({_SHA}) AS h FROM b_chunks) SELECT vec_id, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || (['8', '9', 'a', 'b'])[CAST((instr('0123456789abcdef', h[17]) - 1) % 4 + 1 AS INTEGER)] || h[18:20] || '-' || h[21:32] AS point_uuid FROM h")(lambda s, d: B.chunks(s, d).select("vec_id", T.point_id(F.col("project_id"), F.col("filename"), F.col("chunk_index")).alias("point_uuid")))
query("classify_text", f", {SENTENCES} SELECT document_id, sentence_index, {_case('sentence', L.TRIGGER_KEYWORDS)} AS keyword, {_case('sentence', L.SUBMISSION_CATEGORIES)} AS category, {_case('sentence', L.MODALITIES, chr(39) + 'informational' + chr(39))} AS modality, {_case('sentence', L.ACTORS)} AS actor FROM s_raw")(lambda s, d: X.split_sentences(B.sections(s, d), "body_text").select("document_id", "sentence_index", T.classify_export_keyword(F.col("sentence")).alias("keyword"), T.classify_submission(F.col("sentence")).alias("category"), T.detect_modality(F.col("sentence")).alias("modality"), T.detect_actor(F.col("sentence")).alias("actor")))
query("filename_rules", f" SELECT id, CASE WHEN {' OR '.join(f'contains(lower(filename), {chr(39)}{t}{chr(39)})' for t in L.POSITIVE_FILENAMES)} THEN 5 ELSE 0 END - CASE WHEN {' OR '.join(f'contains(lower(filename), {chr(39)}{t}{chr(39)})' for t in L.NEGATIVE_FILENAMES)} THEN 8 ELSE 0 END AS weight, {' OR '.join(f'regexp_matches(filename, {chr(39)}(?i){p}{chr(39)})' for p in L.NOISY_FILENAMES)} AS noisy FROM b_documents")(lambda s, d: B.documents(s, d).select("id", T.filename_weight(F.col("filename")).alias("weight"), T.is_noisy_doc(F.col("filename")).alias("noisy")))
_NAME = "lower(filename)"
_PWS = f"contains({_NAME}, 'pws') OR contains({_NAME}, 'sow') OR contains({_NAME}, 'performance work statement') OR contains({_NAME}, 'statement of work') OR (contains({_NAME}, 'appendix') AND contains(lower(substring(coalesce(extracted_text, ''), 1, 500)), 'appendix'))"
_PRIORITY = "CASE " + " ".join(f"WHEN regexp_matches(filename, '(?i){p}') THEN {n}" for n, p in L.DOC_PRIORITIES) + " ELSE 50 END"
_NOISY = "(" + " OR ".join(f"regexp_matches(filename, '(?i){p}')" for p in L.NOISY_FILENAMES) + ")"
query("document_tags", f" SELECT id, {_PRIORITY} AS priority, array_to_string(list_filter([CASE WHEN regexp_extract(upper(filename), 'APPENDIX[_\\s-]*([A-Z])', 1) <> '' THEN 'APPENDIX ' || regexp_extract(upper(filename), 'APPENDIX[_\\s-]*([A-Z])', 1) END, CASE WHEN contains(upper(filename), 'IDIQ') AND contains(upper(filename), 'PWS') THEN 'BASE IDIQ PWS' END], lambda x: x IS NOT NULL), ',') AS tags, {_PWS} AS pws FROM b_documents")(lambda s, d: B.documents(s, d).select("id", T.doc_priority(F.col("filename")).alias("priority"), F.array_join(T.derive_document_tags(F.col("filename")), ",").alias("tags"), T.is_likely_pws(F.col("filename"), F.col("extracted_text")).alias("pws")))
_STRIPPED = STRIP("coalesce(extracted_text, '')")
query("extraction_route", f" SELECT id, CASE WHEN NOT ends_with(lower(filename), '.pdf') THEN 'default' WHEN length({_STRIPPED}) < 1500 OR CASE WHEN length(regexp_replace({_STRIPPED}, '\\s', '', 'g')) > 0 THEN length(regexp_replace({_STRIPPED}, '[^\\p{{L}}]', '', 'g')) / length(regexp_replace({_STRIPPED}, '\\s', '', 'g')) ELSE 0 END < 0.55 THEN 'ocr' ELSE 'fast' END AS route FROM b_documents")(lambda s, d: B.documents(s, d).select("id", T.extraction_route(F.col("filename"), F.col("extracted_text")).alias("route")))
query("section_numbers", " SELECT document_id, document_order, CASE WHEN CAST(string_split(numbering_token, '.')[1] AS INTEGER) >= 3 THEN (CAST(string_split(numbering_token, '.')[1] AS INTEGER) - 2) || substring(numbering_token, length(string_split(numbering_token, '.')[1]) + 1) ELSE numbering_token END AS remapped, CASE WHEN contains(numbering_token, '.') THEN regexp_replace(numbering_token, '\\.[^.]*$', '') END AS parent, len(string_split(numbering_token, '.')) AS depth FROM b_blocks WHERE block_type = 'heading'")(lambda s, d: B.blocks(s, d).where("block_type = 'heading'").select("document_id", "document_order", T.remap_section_number(F.col("numbering_token")).alias("remapped"), T.parent_section_number(F.col("numbering_token"), F.col("tree_kind")).alias("parent"), T.section_depth(F.col("numbering_token"), F.col("tree_kind")).alias("depth")))
query("references", ", r AS (SELECT document_id, regexp_extract_all(body_text, '(?i)\\bsections?\\s+(\\d+(?:\\.\\d+)*)', 1) AS s FROM b_body) SELECT document_id, array_to_string(list_sort(list_distinct(s)), ',') AS sections FROM r")(lambda s, d: B.sections(s, d).select("document_id", F.array_join(F.array_sort(T.section_refs(F.col("body_text"))), ",").alias("sections")))
_SINGLE = "regexp_extract_all(body_text, '(?i)\\bappendix(?:es)?\\s+([A-Z](?:\\s*[,\\-]\\s*[A-Z])*)', 1)"
_RANGE = lambda k: f"regexp_extract_all(body_text, '(?i)\\bAppendices?\\s+([A-Z])\\s*[–\\-]\\s*([A-Z])([A-Z\\s,]*)(?:&\\s*([A-Z]))?', {k})"
_LETTERS_SQL = f"""list_concat(flatten(list_transform(list_zip({_RANGE(1)}, {_RANGE(2)}, {_RANGE(3)}, {_RANGE(4)}), lambda z: list_concat(list_transform(range(least(ascii(upper(z[1])), ascii(upper(z[2]))), greatest(ascii(upper(z[1])), ascii(upper(z[2]))) + 1), lambda x: chr(CAST(x AS INTEGER))), list_concat(regexp_extract_all(z[3], '[A-Z]'), list_filter([upper(z[4])], lambda x: x <> ''))))), list_transform(regexp_extract_all(body_text, '(?i)\\bAppendix\\s+([A-Z])\\b', 1), lambda x: upper(x)))"""
query("appendix_references", f" SELECT document_id, array_to_string(list_sort(list_distinct({_LETTERS_SQL})), ',') AS ranged, array_to_string(list_sort(list_distinct(list_filter(flatten(list_transform({_SINGLE}, lambda x: regexp_split_to_array(upper(x), '\\s*[,\\-]\\s*'))), lambda x: x <> ''))), ',') AS single FROM b_body")(lambda s, d: B.sections(s, d).select("document_id", F.array_join(F.array_sort(T.appendix_refs_ranged(F.col("body_text"))), ",").alias("ranged"), F.array_join(F.array_sort(T.appendix_refs(F.col("body_text"))), ",").alias("single")))
_INLINE_MARK = f"\\(\\s*{L.SIMPLE_MARKING}\\s*\\)"
query("bullets", f" SELECT document_id, document_order, '  - ' || {STRIP("regexp_replace(" + STRIP("regexp_replace('o (U) ' || normalized_text, '" + _INLINE_MARK + "', '', 'gi')") + ", '^\\s*o\\s+', '')")} AS bullet, CAST(len(list_filter(string_split(regexp_replace(normalized_text || ' o Next', '\\s+o\\s+([A-Z])', chr(1) || '\\1', 'g'), chr(1)), lambda x: {STRIP('x')} <> '')) AS INTEGER) AS lines FROM b_blocks")(lambda s, d: B.blocks(s, d).select("document_id", "document_order", T.normalize_bullet(F.concat(F.lit("o (U) "), "normalized_text")).alias("bullet"), F.size(T.expand_inline_bullets(F.concat("normalized_text", F.lit(" o Next")))).alias("lines")))
def _heading_sql(text: str) -> str:
    """Steps of `normalize_heading_candidate` as table expressions over a table x0 with `text`; the last one is hx with h."""
    leader = "[.·…\\s]{3,}[A-Z]?-?\\d+\\s*$"
    return f"""x0 AS ({text}), x1 AS (SELECT *, {STRIP(INLINE("replace(regexp_replace(coalesce(text, ''), '\\[bookmark:[^\\]]+\\]', '', 'g'), '[image: ]', '')"))} AS t1 FROM x0),
x2 AS (SELECT *, CASE WHEN {STRIP(f"regexp_replace(t1, '(?i)^(?:\\({L.MARKING}\\)\\s*)+', '')")} = '' THEN t1 ELSE {STRIP(f"regexp_replace(t1, '(?i)^(?:\\({L.MARKING}\\)\\s*)+', '')")} END AS t2 FROM x1),
x3 AS (SELECT *, {STRIP(f"regexp_replace(t2, '{leader}', '')")} AS t3, contains(t2, chr(9)) OR regexp_matches(t2, '{leader}') OR regexp_matches(t2, '{L.TOC_ENTRY}') AS listed FROM x2),
hx AS (SELECT *, regexp_replace(CASE WHEN listed THEN {STRIP("regexp_replace(t3, '\\s+\\d+\\s*$', '')")} ELSE t3 END, '^[ \\-:\\t]+|[ \\-:\\t]+$', '', 'g') AS h FROM x3)"""


query("heading_candidates", f", {_heading_sql("SELECT document_id, document_order, normalized_text, '(U) ' || normalized_text || ' ..... 12' AS text FROM b_blocks")}, z AS (SELECT *, {STRIP("normalized_text || '12'")} AS s FROM hx) SELECT document_id, document_order, h AS candidate, CASE WHEN regexp_matches(regexp_extract(s, '^(.*?)(\\d{{1,3}})$', 1), '\\p{{L}}') THEN {STRIP("regexp_extract(s, '^(.*?)(\\d{1,3})$', 1)")} ELSE s END AS title FROM z")(lambda s, d: B.blocks(s, d).select("document_id", "document_order", T.normalize_heading_candidate(F.concat(F.lit("(U) "), "normalized_text", F.lit(" ..... 12"))).alias("candidate"), T.strip_trailing_page_digits(F.concat("normalized_text", F.lit("12"))).alias("title")))


def _heads(spark: SparkSession, sf: str) -> DataFrame:
    return B.blocks(spark, sf).where("block_type <> 'paragraph'")


_RUN = "PARTITION BY document_id, epoch ORDER BY document_order ROWS UNBOUNDED PRECEDING"
_TOP = "max(CASE WHEN heading_level = {k} THEN lpad(CAST(document_order AS VARCHAR), 9, '0') || '|' || numbering_token END) OVER (" + _RUN + ")"
_PATHS = f""", h0 AS (SELECT *, sum(CASE WHEN tree_kind <> 'MAIN' THEN 1 ELSE 0 END) OVER (PARTITION BY document_id ORDER BY document_order ROWS UNBOUNDED PRECEDING) AS epoch FROM b_blocks WHERE block_type <> 'paragraph'),
h1 AS (SELECT *, {_TOP.format(k=1)} AS a, {_TOP.format(k=2)} AS b, {_TOP.format(k=3)} AS c FROM h0),
h2 AS (SELECT *, CASE WHEN heading_level >= 2 AND b > coalesce(a, '') THEN b END AS b2, CASE WHEN heading_level >= 3 AND c > greatest(coalesce(a, ''), coalesce(b, '')) THEN c END AS c2 FROM h1)
SELECT document_id, document_order, array_to_string(list_filter([substring(a, 11), substring(b2, 11), substring(c2, 11)], lambda x: x IS NOT NULL), ' > ') AS heading_path FROM h2"""
query("heading_paths", _PATHS)(lambda s, d: St.heading_paths(_heads(s, d)).select("document_id", "document_order", "heading_path"))
_SECTIONS = ", a0 AS (SELECT *, max(CASE WHEN block_type <> 'paragraph' THEN document_order END) OVER (PARTITION BY document_id ORDER BY document_order ROWS UNBOUNDED PRECEDING) AS section_order FROM b_blocks), a1 AS (SELECT document_id, section_order, max(numbering_token) AS section_number, max(tree_kind) AS tree_kind, coalesce(string_agg(CASE WHEN block_type = 'paragraph' THEN normalized_text END, chr(10) || chr(10) ORDER BY document_order), '') AS body_text, count(CASE WHEN block_type = 'paragraph' THEN 1 END) AS prose_blocks FROM a0 GROUP BY 1, 2)"
query("assemble_sections", _SECTIONS + " SELECT document_id, section_order, section_number, body_text, prose_blocks FROM a1")(lambda s, d: St.assemble_sections(B.blocks(s, d)).select("document_id", "section_order", "section_number", "body_text", "prose_blocks"))
query("heading_gaps", ", g AS (SELECT document_id, document_order AS section_order, numbering_token AS section_number, lag(numbering_token) OVER (PARTITION BY document_id ORDER BY document_order) AS previous FROM b_blocks WHERE block_type <> 'paragraph') SELECT document_id, section_order, previous, section_number FROM g WHERE contains(previous, '.') AND contains(section_number, '.') AND regexp_extract(previous, '^(.*)\\.[^.]*$', 1) = regexp_extract(section_number, '^(.*)\\.[^.]*$', 1) AND TRY_CAST(regexp_extract(section_number, '\\.(\\d+)$', 1) AS INTEGER) > TRY_CAST(regexp_extract(previous, '\\.(\\d+)$', 1) AS INTEGER) + 1")(lambda s, d: St.heading_gaps(_heads(s, d).select("document_id", F.col("document_order").alias("section_order"), F.col("numbering_token").alias("section_number"))))


def _assembled(spark: SparkSession, sf: str) -> DataFrame:
    return St.assemble_sections(B.blocks(spark, sf))


def _chars(spark: SparkSession, sf: str) -> DataFrame:
    return B.documents(spark, sf).select("document_id", F.length(F.coalesce("extracted_text", F.lit(""))).alias("chars"))


def _number() -> Column:
    """A document's number, from its id."""
    return F.regexp_extract("document_id", r"(\d+)$", 1).cast("long")


def _parse_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Metrics of three sources of each document: its blocks with a cover and a contents list, of which every fourth document has no
    prose, so that the list outweighs the body; and the plain blocks, with less or no body by the document's number."""
    scoped = St.tag_content_scope(_with_contents(spark, sf))
    body = scoped.where("content_scope = 'body'").where((_number() % 4 != 3) | (F.col("block_type") != "paragraph"))
    a = St.structure_metrics(St.assemble_sections(body.drop("content_scope")), _chars(spark, sf), St.contents_signal(scoped)).withColumn("source", F.lit("structural"))
    m = St.structure_metrics(_assembled(spark, sf), _chars(spark, sf)).withColumn("k", _number())
    less = lambda df, c, cond: df.withColumn(c, F.when(F.expr(cond), 0).otherwise(F.col(c)).cast("long"))
    b = less(less(m.where("k % 3 <> 0").withColumn("source", F.lit("markdown")), "prose_block_count", "k % 2 = 0"), "body_signal_score", "k % 5 = 0")
    c = less(less(m.where("k % 7 <> 0").withColumn("source", F.lit("text")), "prose_block_count", "k % 11 = 0"), "section_count", "k % 8 = 3")
    return a.unionByName(b.drop("k")).unionByName(c.drop("k"))


_METRICS = _SECTIONS + """, m0 AS (SELECT document_id, CAST(regexp_extract(document_id, '(\\d+)$', 1) AS BIGINT) AS k, sum(CASE WHEN section_order IS NOT NULL THEN 1 ELSE 0 END) AS sec, sum(CASE WHEN section_order IS NOT NULL THEN prose_blocks ELSE 0 END) AS prose, sum(CASE WHEN section_order IS NOT NULL AND prose_blocks = 0 THEN 1 ELSE 0 END) AS hollow,
  sum(CASE WHEN section_order IS NOT NULL THEN length(body_text) ELSE 0 END) AS inside, sum(CASE WHEN section_order IS NULL THEN prose_blocks ELSE 0 END) AS orphans, sum(CASE WHEN section_order IS NOT NULL AND prose_blocks > 0 THEN 1 ELSE 0 END) AS filled FROM a1 GROUP BY 1),
m1 AS (SELECT m0.*, prose + 2 * filled AS body, CASE WHEN length(coalesce(extracted_text, '')) > 0 THEN round_even(inside / length(extracted_text), 4) ELSE 0.0 END AS cover FROM m0 JOIN b_documents USING (document_id))"""
_MODE_SQL = """, n0 AS (SELECT b.*, max(CASE WHEN block_type <> 'paragraph' THEN b.document_order END) OVER (PARTITION BY b.document_id ORDER BY b.document_order ROWS UNBOUNDED PRECEDING) AS section_order FROM b_blocks b JOIN scoped USING (document_id, document_order) WHERE content_scope = 'body' AND NOT (CAST(regexp_extract(b.document_id, '(\\d+)$', 1) AS BIGINT) % 4 = 3 AND block_type = 'paragraph')),
n1 AS (SELECT document_id, section_order, coalesce(string_agg(CASE WHEN block_type = 'paragraph' THEN normalized_text END, chr(10) || chr(10) ORDER BY document_order), '') AS body_text, count(CASE WHEN block_type = 'paragraph' THEN 1 END) AS p FROM n0 GROUP BY 1, 2),
n2 AS (SELECT document_id, count(section_order) AS sec, sum(CASE WHEN p > 0 THEN p + 2 ELSE 0 END) AS body, sum(CASE WHEN p = 0 THEN 1 ELSE 0 END) AS hollow, sum(length(body_text)) AS inside FROM n1 GROUP BY 1),
n3 AS (SELECT document_id, count(*) AS toc FROM scoped WHERE content_scope = 'table_of_contents' GROUP BY 1),
w AS (SELECT m1.document_id, k, m1.sec, prose, m1.body, coalesce(n2.sec, 0) AS sec_a, coalesce(n2.body, 0) AS body_a, coalesce(n2.hollow, 0) AS hollow_a, CASE WHEN length(coalesce(extracted_text, '')) > 0 THEN round_even(coalesce(n2.inside, 0) / length(extracted_text), 4) ELSE 0.0 END AS cover_a, coalesce(toc, 0) AS toc_a, k % 3 <> 0 AS has_b, CASE WHEN k % 2 = 0 THEN 0 ELSE prose END AS prose_b, CASE WHEN k % 5 = 0 THEN 0 ELSE m1.body END AS body_b, k % 7 <> 0 AS has_c, CASE WHEN k % 11 = 0 THEN 0 ELSE prose END AS prose_c, CASE WHEN k % 8 = 3 THEN 0 ELSE m1.sec END AS sec_c
  FROM (SELECT document_id, k, sec, prose, body FROM m1) m1 JOIN b_documents USING (document_id) LEFT JOIN n2 USING (document_id) LEFT JOIN n3 USING (document_id)),
v AS (SELECT document_id, CASE WHEN has_b AND sec > 0 AND prose_b > 0 THEN 'markdown' WHEN NOT has_b AND has_c AND sec_c > 0 AND prose_c > 0 THEN 'text' WHEN sec_a > 0 AND body_a >= greatest(toc_a, 1) AND cover_a >= 0.45 AND hollow_a <= greatest(1, sec_a // 2) THEN 'structural'
  WHEN has_b AND sec > 0 AND body_b > 0 THEN 'markdown' WHEN has_c AND sec_c > 0 AND body > 0 THEN 'text' ELSE 'none' END AS m FROM w)
SELECT document_id, CASE m WHEN 'structural' THEN 'docling_structural' WHEN 'markdown' THEN 'hybrid_markdown_fill' WHEN 'text' THEN 'tika_fallback' ELSE 'manual_review_required' END AS parse_mode, CASE m WHEN 'markdown' THEN 'docling_body_signal_low' WHEN 'text' THEN 'docling_and_markdown_body_signal_low' WHEN 'none' THEN 'no_reliable_structural_source' END AS fallback_reason FROM v"""


#: Lines of documents as each kind of block, by their order: lists, notes, sections, attachments, pages, dates, capitals.
_KINDS = ("", "(a) ", "3.2.1(a)(b) ", "A. ", "- ", "NOTE: ", "SECTION L ", "Attachment 3 - ", "7 ", "4.2 ")
_MIXED = f"SELECT document_id, document_order, CASE WHEN document_order % 17 = 11 THEN 'Page ' || document_order WHEN document_order % 17 = 12 THEN 'March 3, 2024' WHEN document_order % 17 = 13 THEN '(U) 5.1.2 Reports ........ 12' WHEN document_order % 17 = 14 THEN 'GENERAL REQUIREMENTS' ELSE ({B._list(_KINDS)})[CAST(document_order % 10 + 1 AS INTEGER)] || normalized_text END AS text FROM b_blocks"
_CAPS = "length(regexp_replace(h, '[^\\p{L}]', '', 'g')) >= 6 AND length(h) <= 120 AND length(regexp_replace(h, '[^\\p{Lu}]', '', 'g')) / length(regexp_replace(h, '[^\\p{L}]', '', 'g')) > 0.85"
_G = lambda p, k, c="h": f"regexp_extract({c}, '{p}', {k})"
_COMPOSITE, _PAREN, _ALPHA, _DASH = "^(\\d+(?:\\.\\d+)+)((?:\\([A-Za-z0-9]+\\))+)\\s+(.+)$", "^((?:\\([A-Za-z0-9]+\\))+)\\s+(.+)$", "^([A-Za-z]\\.)\\s+(.+)$", "^([-*•])\\s+(.+)$"
_CLASSIFIED = f""", {_heading_sql(_MIXED)}, kx AS (SELECT *, CASE WHEN regexp_matches(text, '^(?i)\\s*page\\s+\\d+\\s*$') THEN 'page' WHEN length(h) <= 1 OR regexp_matches(h, '{L.DATE_ONLY}') OR regexp_matches(upper(h), '{L.MARKING_ONLY}') THEN 'noise' WHEN regexp_matches(h, '{L.APPENDIX_HEADING}') THEN 'appendix' WHEN regexp_matches(h, '{L.SECTION_HEADING}') THEN 'section'
  WHEN regexp_matches(h, '{L.DECIMAL_HEADING}') THEN 'decimal' WHEN regexp_matches(h, '{L.NUMBER_HEADING}') THEN 'number' WHEN regexp_matches(text, '{_COMPOSITE}') THEN 'composite' WHEN regexp_matches(text, '{_PAREN}') THEN 'paren' WHEN regexp_matches(text, '{_ALPHA}') THEN 'alpha' WHEN regexp_matches(text, '{_DASH}') THEN 'dash' WHEN starts_with(upper(text), 'NOTE:') THEN 'note' WHEN {_CAPS} THEN 'caps' ELSE 'prose' END AS k FROM hx)"""
query("classify_blocks", _CLASSIFIED + f""" SELECT document_id, document_order, CASE k WHEN 'page' THEN 'page_break' WHEN 'noise' THEN 'footer_or_header' WHEN 'appendix' THEN CASE WHEN upper({_G(L.APPENDIX_HEADING, 1)}) = 'APPENDIX' THEN 'appendix_heading' ELSE 'attachment_heading' END WHEN 'note' THEN 'note' WHEN 'prose' THEN 'paragraph' WHEN 'section' THEN 'heading' WHEN 'decimal' THEN 'heading' WHEN 'number' THEN 'heading' WHEN 'caps' THEN 'heading' ELSE 'list_item' END AS block_type,
  CAST(CASE k WHEN 'appendix' THEN 1 WHEN 'section' THEN 1 WHEN 'number' THEN 1 WHEN 'caps' THEN 2 WHEN 'decimal' THEN CASE WHEN len(string_split({_G(L.DECIMAL_HEADING, 1)}, '.')) = 2 AND ends_with({_G(L.DECIMAL_HEADING, 1)}, '.0') THEN 1 ELSE len(string_split({_G(L.DECIMAL_HEADING, 1)}, '.')) END END AS INTEGER) AS heading_level,
  CASE k WHEN 'appendix' THEN upper({_G(L.APPENDIX_HEADING, 1)}) || ' ' || {_G(L.APPENDIX_HEADING, 2)} WHEN 'section' THEN 'SECTION ' || {_G(L.SECTION_HEADING, 2)} WHEN 'decimal' THEN {_G(L.DECIMAL_HEADING, 1)} WHEN 'number' THEN {_G(L.NUMBER_HEADING, 1)} WHEN 'composite' THEN {_G(_COMPOSITE, 1, 'text')} || {_G(_COMPOSITE, 2, 'text')} WHEN 'paren' THEN {_G(_PAREN, 1, 'text')} WHEN 'alpha' THEN {_G(_ALPHA, 1, 'text')} WHEN 'dash' THEN {_G(_DASH, 1, 'text')} WHEN 'caps' THEN h END AS numbering_token,
  CASE k WHEN 'appendix' THEN upper({_G(L.APPENDIX_HEADING, 1)}) WHEN 'section' THEN 'MAIN' WHEN 'decimal' THEN 'MAIN' WHEN 'number' THEN 'MAIN' WHEN 'caps' THEN 'MAIN' END AS tree_kind,
  CAST(CASE k WHEN 'composite' THEN length({_G(_COMPOSITE, 2, 'text')}) - length(replace({_G(_COMPOSITE, 2, 'text')}, '(', '')) WHEN 'paren' THEN length({_G(_PAREN, 1, 'text')}) - length(replace({_G(_PAREN, 1, 'text')}, '(', '')) WHEN 'alpha' THEN 1 WHEN 'dash' THEN 1 END AS INTEGER) AS list_level,
  CASE k WHEN 'composite' THEN {STRIP(_G(_COMPOSITE, 3, 'text'))} WHEN 'paren' THEN {STRIP(_G(_PAREN, 2, 'text'))} WHEN 'alpha' THEN {STRIP(_G(_ALPHA, 2, 'text'))} WHEN 'dash' THEN {STRIP(_G(_DASH, 2, 'text'))} END AS list_body,
  CAST(CASE k WHEN 'page' THEN 0.99 WHEN 'noise' THEN 0.99 WHEN 'appendix' THEN 0.99 WHEN 'section' THEN 0.98 WHEN 'decimal' THEN 0.97 WHEN 'number' THEN 0.95 WHEN 'composite' THEN 0.94 WHEN 'paren' THEN 0.93 WHEN 'alpha' THEN 0.86 WHEN 'dash' THEN 0.82 WHEN 'note' THEN 0.9 WHEN 'caps' THEN 0.68 ELSE 0.7 END AS DOUBLE) AS confidence FROM kx""")(lambda s, d: St.classify_blocks(_mixed(s, d)).drop("normalized_text", "heading_title"))


def _mixed(spark: SparkSession, sf: str) -> DataFrame:
    o = F.col("document_order")
    head = F.get(F.array(*map(F.lit, _KINDS)), (o % 10).cast("int"))
    text = F.when(o % 17 == 11, F.concat(F.lit("Page "), o)).when(o % 17 == 12, "March 3, 2024").when(o % 17 == 13, "(U) 5.1.2 Reports ........ 12").when(o % 17 == 14, "GENERAL REQUIREMENTS").otherwise(F.concat(head, "normalized_text"))
    return B.blocks(spark, sf).select("document_id", "document_order", text.alias("normalized_text"))

_SCOPE = f""", t0 AS (SELECT *, CASE document_order WHEN 0 THEN 'Performance Work Statement (PWS)' WHEN 3 THEN 'Table of Contents' WHEN 4 THEN '1.4 Scope ........ 4' WHEN 5 THEN '1.5 Scope ........ 5' ELSE normalized_text END AS said, document_order IN (0, 3) AS front FROM b_blocks),
{_heading_sql("SELECT document_id, document_order, block_type, said, CASE WHEN front THEN NULL ELSE numbering_token END AS token, CASE WHEN block_type = 'paragraph' THEN '' ELSE coalesce(CASE WHEN front THEN said ELSE heading_title END, said) END AS text FROM t0")},
t1 AS (SELECT document_id, document_order AS o, block_type <> 'paragraph' AS head, h = 'Performance Work Statement (PWS)' OR regexp_matches(h, '{L.DATE_ONLY}') AS cover, block_type <> 'paragraph' AND regexp_matches(h, '{L.TOC_TITLE}') AS toc, block_type IN ('heading', 'paragraph') AND regexp_matches({STRIP(f"regexp_replace({INLINE('said')}, '(?i)^(?:" + chr(92) + "({L.MARKING}" + chr(92) + ")" + chr(92) + "s*)+', '')")}, '{L.TOC_ENTRY}') AS entry, block_type = 'heading' AND token IS NOT NULL AS numbered, block_type = 'paragraph' AS prose FROM hx),
t2 AS (SELECT document_id, list(struct_pack(o := o, head := head, cover := cover, toc := toc, entry := entry, numbered := numbered, prose := prose) ORDER BY o) AS b FROM t1 GROUP BY 1),
t3 AS (SELECT document_id, list_reduce(list_prepend(struct_pack(toc := FALSE, body := FALSE, out := CAST([] AS VARCHAR[]), x := b[1]), list_transform(b, lambda y: struct_pack(toc := FALSE, body := FALSE, out := CAST([] AS VARCHAR[]), x := y))), lambda a, y: CASE WHEN NOT a.body AND y.x.head AND y.x.cover THEN struct_pack(toc := a.toc, body := a.body, out := list_append(a.out, 'front_matter'), x := y.x)
  WHEN y.x.toc THEN struct_pack(toc := TRUE, body := a.body, out := list_append(a.out, 'table_of_contents'), x := y.x) WHEN a.toc AND (y.x.entry OR (y.x.prose AND NOT y.x.numbered)) THEN struct_pack(toc := TRUE, body := a.body, out := list_append(a.out, 'table_of_contents'), x := y.x)
  WHEN a.body OR y.x.head OR (a.toc AND y.x.numbered) THEN struct_pack(toc := a.toc AND NOT y.x.numbered, body := TRUE, out := list_append(a.out, 'body'), x := y.x) ELSE struct_pack(toc := a.toc, body := FALSE, out := list_append(a.out, 'front_matter'), x := y.x) END) AS z, list_transform(b, lambda y: y.o) AS os FROM t2),
scoped AS (SELECT document_id, unnest(os) AS document_order, unnest(z.out) AS content_scope FROM t3)"""
query("content_scope", _SCOPE + " SELECT * FROM scoped")(lambda s, d: St.tag_content_scope(_with_contents(s, d)).select("document_id", "document_order", "content_scope"))


_LISTS = _SCOPE + ", l0 AS (SELECT *, content_scope = 'table_of_contents' AS listed, document_order - row_number() OVER (PARTITION BY document_id, content_scope ORDER BY document_order) AS island FROM scoped), l1 AS (SELECT document_id, min(document_order) AS start_order, max(document_order) AS end_order, count(*) AS entries FROM l0 WHERE listed GROUP BY document_id, island)"
query("contents_lists", _LISTS + " SELECT document_id, CAST(row_number() OVER (PARTITION BY document_id ORDER BY start_order) - 1 AS INTEGER) AS list_index, start_order, end_order, entries FROM l1")(lambda s, d: St.contents_lists(St.tag_content_scope(_with_contents(s, d))))
query("contents_signal", _LISTS + " SELECT document_id, CAST(sum(entries) AS BIGINT) AS toc_signal_score FROM l1 GROUP BY 1")(lambda s, d: St.contents_signal(St.tag_content_scope(_with_contents(s, d))))

query("structure_metrics", _SCOPE + _SECTIONS + " SELECT a1.document_id, count(*) AS section_count, CAST(sum(prose_blocks) AS BIGINT) AS prose_block_count, CAST(sum(CASE WHEN prose_blocks = 0 THEN 1 ELSE 0 END) AS BIGINT) AS suspicious_empty_section_count, CAST(sum(prose_blocks) + 2 * sum(CASE WHEN prose_blocks > 0 THEN 1 ELSE 0 END) AS BIGINT) AS body_signal_score, CAST(max((SELECT count(*) FROM scoped c WHERE c.document_id = a1.document_id AND content_scope = 'table_of_contents')) AS BIGINT) AS toc_signal_score FROM a1 GROUP BY 1")(lambda s, d: St.structure_metrics(_assembled(s, d), _chars(s, d), St.contents_signal(St.tag_content_scope(_with_contents(s, d)))).select("document_id", "section_count", "prose_block_count", "suspicious_empty_section_count", "body_signal_score", "toc_signal_score"))
query("select_parse_mode", _METRICS + _SCOPE + _MODE_SQL)(lambda s, d: St.select_parse_mode(_parse_metrics(s, d)))


def _with_contents(spark: SparkSession, sf: str) -> DataFrame:
    """Blocks whose documents open with a cover and a contents list: title, contents heading, entries, then the body."""
    text = F.expr("case when document_order = 0 then 'Performance Work Statement (PWS)' when document_order = 3 then 'Table of Contents' when document_order in (4, 5) then concat('1.', document_order, ' Scope ........ ', document_order) else normalized_text end")
    plain = F.expr("document_order in (0, 3)")
    return B.blocks(spark, sf).withColumns({"normalized_text": text, "heading_title": F.when(plain, text).otherwise(F.col("heading_title")), "numbering_token": F.when(~plain, F.col("numbering_token"))})


_NUMBERED = "^(\\d+(?:\\.\\d+)*)\\.?\\s+(.*)$"
_BARE = STRIP(f"regexp_replace(t, '(?i)^(?:\\({L.MARKING}\\)\\s*)+', '')")
_STAGE1 = f""", y0 AS (SELECT document_id, document_order AS source_order, {_MARGIN_JOIN} AS m FROM ({_MIXED})), y1 AS (SELECT *, {STRIP(f"({_MARGIN_DONE})")} AS t FROM y0), y2 AS (SELECT document_id, source_order, CASE WHEN {_BARE} = '' THEN t ELSE {_BARE} END AS h FROM y1),
y3 AS (SELECT y2.*, 'structured' AS source_kind, FALSE AS plain FROM y2 UNION ALL SELECT y2.*, 'markdown', source_order % 2 <> 0 FROM y2), y4 AS (SELECT *, CASE WHEN h = '' THEN 'empty' WHEN regexp_matches(h, '{L.PAGE_LINE}') THEN 'page_only' WHEN regexp_matches(h, '{L.DATE_ONLY}') THEN 'date_only' WHEN regexp_matches(h, '{L.TOC_TITLE}') THEN 'toc_heading' WHEN regexp_matches(h, '{L.TOC_ENTRY}') THEN 'toc_entry'
  WHEN regexp_matches(h, '{L.APPENDIX_HEADING}') THEN 'appendix_pattern' WHEN regexp_matches(h, '{L.SECTION_HEADING}') THEN 'section_pattern' WHEN regexp_matches(h, '{_NUMBERED}') THEN CASE WHEN len(regexp_split_to_array({STRIP(_G(_NUMBERED, 2))}, '\\s+')) > 18 THEN 'numbered_heading_too_long' WHEN plain THEN 'markdown_plain_text' ELSE 'numbered_pattern' END ELSE 'no_heading_match' END AS reason FROM y3),
y5 AS (SELECT *, reason IN ('appendix_pattern', 'section_pattern', 'numbered_pattern') AS accepted, CASE reason WHEN 'appendix_pattern' THEN upper({_G(L.APPENDIX_HEADING, 1)}) || ' ' || {_G(L.APPENDIX_HEADING, 2)} WHEN 'section_pattern' THEN upper('SECTION ' || {_G(L.SECTION_HEADING, 2)}) WHEN 'numbered_pattern' THEN {_G(_NUMBERED, 1)} END AS section_number FROM y4),
y6 AS (SELECT *, CASE WHEN reason = 'numbered_pattern' AND contains(section_number, '.') THEN regexp_replace(section_number, '\\.[^.]*$', '') END AS parent FROM y5), y7 AS (SELECT document_id, source_kind, section_number AS parent, min(source_order) AS lo FROM y6 WHERE accepted GROUP BY ALL),
y8 AS (SELECT y6.*, y6.parent IS NOT NULL AND (lo IS NULL OR lo >= source_order) AS parent_missing FROM y6 LEFT JOIN y7 ON y7.document_id = y6.document_id AND y7.source_kind = y6.source_kind AND y7.parent = y6.parent)"""
query("stage1_sections", _STAGE1 + " SELECT document_id, source_kind, source_order, accepted, section_number, reason, parent_missing FROM y8")(lambda s, d: St.stage1_sections(_stage1(s, d)).select("document_id", "source_kind", "source_order", "accepted", "section_number", "reason", "parent_missing"))
query("stage1_best", _STAGE1 + ", y9 AS (SELECT document_id, source_kind, CAST(sum(CASE WHEN accepted THEN 1 ELSE 0 END) AS BIGINT) AS accepted_count, CAST(sum(CASE WHEN accepted THEN 0 ELSE 1 END) AS BIGINT) AS rejected_count, CAST(sum(CASE WHEN parent_missing THEN 1 ELSE 0 END) AS BIGINT) AS warnings FROM y8 GROUP BY 1, 2) SELECT * FROM y9 QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY accepted_count DESC, warnings, source_kind) = 1")(lambda s, d: St.stage1_best(St.stage1_sections(_stage1(s, d))))


def _stage1(spark: SparkSession, sf: str) -> DataFrame:
    b = _mixed(spark, sf).select("document_id", F.col("document_order").alias("source_order"), F.col("normalized_text").alias("text_exact"))
    return b.withColumns({"source_kind": F.lit("structured"), "label": F.lit("text"), "markdown_heading_level": F.lit(None).cast("int")}).unionByName(b.withColumns({"source_kind": F.lit("markdown"), "label": F.lit("markdown"), "markdown_heading_level": F.when(F.expr("source_order % 2 = 0"), 1)}))


query("table_rows", ", a AS (SELECT document_id, table_id, row_index, r FROM b_grid UNION ALL SELECT DISTINCT document_id, table_id, 0, ['name', 'type', 'size'] FROM b_grid) SELECT document_id, table_id, CAST(row_index AS INTEGER) AS row_index, array_to_string(list_filter(r, lambda x: coalesce(x, '') <> ''), ' | ') AS row_text FROM a")(lambda s, d: St.table_rows(B.grids(s, d)).select("document_id", "table_id", "row_index", "row_text"))
query("table_cells", ", a AS (SELECT document_id, table_id, row_index, unnest(r) AS cell_text, unnest(range(4)) AS col_index FROM b_grid UNION ALL SELECT document_id, table_id, 0, unnest(['name', 'type', 'size']), unnest(range(3)) FROM (SELECT DISTINCT document_id, table_id FROM b_grid)) SELECT table_id, CAST(row_index AS INTEGER) AS row_index, CAST(col_index AS INTEGER) AS col_index, CASE WHEN row_index > 0 THEN (['name', 'type', 'size', NULL])[CAST(col_index + 1 AS INTEGER)] END AS header_text, cell_text FROM a")(lambda s, d: St.table_cells(B.grids(s, d)).select("table_id", "row_index", "col_index", "header_text", "cell_text"))


def _units(spark: SparkSession, sf: str) -> DataFrame:
    """Units of the blocks, each paragraph behind its document's prefix, and of the parts' tables."""
    prefix = F.get(F.array(*map(F.lit, _UNIT_PREFIXES)), (_number() % 9).cast("int"))
    b = B.blocks(spark, sf).withColumns({"block_id": F.concat("document_id", F.lit(":block:"), "document_order"), "section_path": F.lit(None).cast("string")})
    b = b.withColumn("normalized_text", F.when(F.col("block_type") == "paragraph", F.concat(prefix, "normalized_text")).otherwise(F.col("normalized_text")))
    return X.extraction_units(b, B.grids(spark, sf))


#: What stands before the paragraphs of a document, by its number: with and without duties, deliverables and reviews.
_UNIT_PREFIXES = (*B.PREFIXES[:5], "The Contractor shall provide the monthly status report. Deliverable: ", *B.PREFIXES[6:8], "Provide support. ")
_UNITS = f""", u AS (SELECT table_id || ':row:' || row_index || ':unit' AS unit_id, document_id, 'DOCUMENT' AS heading_path, table_id AS source_block_id, 'table_row' AS unit_type, table_id, CAST(row_index AS INTEGER) AS row_index, 'name: ' || r[1] || ' | type: ' || r[2] || ' | size: ' || r[3] || ' | col_4: ' || r[4] AS text_exact, r FROM b_grid
  UNION ALL SELECT document_id || ':block:' || document_order || ':unit', document_id, 'DOCUMENT', document_id || ':block:' || document_order, 'paragraph', NULL, NULL, ({B._list(_UNIT_PREFIXES)})[CAST(CAST(regexp_extract(document_id, '(\\d+)$', 1) AS BIGINT) % 9 + 1 AS INTEGER)] || normalized_text, NULL FROM b_blocks WHERE block_type = 'paragraph')"""
_PIECES = FRAGMENTS.replace("normalized_text", "text_exact")
_DUTY = lambda c: f"({_case(c, [('t', L.TASKING)])} IS NOT NULL OR {_case(c, L.MODALITIES, chr(39) + 'informational' + chr(39))} <> 'informational')"
_CANDIDATES = f"""{_UNITS}, fr AS (SELECT *, unnest({_PIECES}) AS fragment, unnest(range(len({_PIECES}))) AS fi FROM u), ta AS (SELECT * FROM fr WHERE {_DUTY('fragment')} OR unit_type = 'table_row'),
ca AS (SELECT unit_id, document_id, heading_path, source_block_id, unit_type, table_id, row_index, r, fragment, row_number() OVER (PARTITION BY unit_id ORDER BY fi) - 1 AS idx, CASE WHEN unit_type = 'table_row' THEN 0.65 ELSE 0.72 END AS confidence, TRUE AS ruled FROM ta
  UNION ALL SELECT unit_id, document_id, heading_path, source_block_id, unit_type, table_id, row_index, r, {INLINE('text_exact')}, 0, 0.55, FALSE FROM u WHERE unit_id NOT IN (SELECT unit_id FROM ta)),
cand AS (SELECT unit_id || ':requirement:' || idx AS candidate_id, unit_id, document_id, heading_path, source_block_id, unit_type, table_id, row_index, r, {_case('fragment', L.MODALITIES, chr(39) + 'informational' + chr(39))} AS modality, CAST(confidence AS DOUBLE) AS confidence, ruled, fragment AS requirement_text, regexp_replace({INLINE('fragment')}, '^\\(?[A-Za-z0-9.\\-]+\\)?\\s+', '') AS normalized_text, {_case('fragment', L.ACTORS)} AS actor, {_case('fragment', [('d', L.DELIVERABLE)])} IS NOT NULL AS deliverable_flag FROM ca)"""
query("extraction_units", _UNITS + " SELECT unit_id, text_exact FROM u")(lambda s, d: _units(s, d).select("unit_id", "text_exact"))
query("requirement_candidates", _CANDIDATES + " SELECT * EXCLUDE (ruled, r), ruled AND modality = 'informational' AS review_flag FROM cand")(lambda s, d: X.requirement_candidates(_units(s, d)))
query("deliverable_candidates", _CANDIDATES + f" SELECT unit_id || ':deliverable:' || (row_number() OVER (PARTITION BY unit_id ORDER BY fi) - 1) AS deliverable_id, document_id, heading_path, source_block_id, fragment AS deliverable_text, regexp_replace({INLINE('fragment')}, '^\\(?[A-Za-z0-9.\\-]+\\)?\\s+', '') AS normalized_text, CAST(0.6 AS DOUBLE) AS confidence, TRUE AS review_flag FROM ta WHERE {_case('fragment', [('d', L.DELIVERABLE)])} IS NOT NULL")(lambda s, d: X.deliverable_candidates(_units(s, d)))
query("table_cell_provenance", _CANDIDATES + f" SELECT candidate_id, table_id, row_index, CASE WHEN {_DUTY('r[1]')} THEN 0 WHEN {_DUTY('r[2]')} THEN 1 WHEN {_DUTY('r[3]')} THEN 2 WHEN {_DUTY('r[4]')} THEN 3 END AS table_col_index FROM cand WHERE table_id IS NOT NULL")(lambda s, d: X.table_cell_provenance(X.requirement_candidates(_units(s, d)).where("table_id is not null"), St.table_cells(B.grids(s, d))).select("candidate_id", "table_id", "row_index", "table_col_index"))
_GAPS = "g AS (SELECT document_id, document_order AS section_order, numbering_token AS section_number, lag(numbering_token) OVER (PARTITION BY document_id ORDER BY document_order) AS previous FROM b_blocks WHERE block_type <> 'paragraph'), gaps AS (SELECT document_id, section_order, previous, section_number FROM g WHERE contains(previous, '.') AND contains(section_number, '.') AND regexp_extract(previous, '^(.*)\\.[^.]*$', 1) = regexp_extract(section_number, '^(.*)\\.[^.]*$', 1) AND TRY_CAST(regexp_extract(section_number, '\\.(\\d+)$', 1) AS INTEGER) > TRY_CAST(regexp_extract(previous, '\\.(\\d+)$', 1) AS INTEGER) + 1)"
query("review_queue", _CANDIDATES + ", " + _GAPS + " SELECT document_id, 'heading_continuity_gap' AS reason, section_number AS raw_text, 'warning' AS severity FROM gaps UNION ALL SELECT document_id, 'needs_review', requirement_text, 'warning' FROM cand WHERE ruled AND modality = 'informational'")(lambda s, d: _reviews(s, d).drop("details_json"))


def _reviews(s: SparkSession, d: str, candidates: DataFrame | None = None) -> DataFrame:
    flagged = (candidates or X.requirement_candidates(_units(s, d))).where("review_flag").select("document_id", F.lit(None).cast("string").alias("reason"), F.col("requirement_text").alias("raw_text"))
    return X.review_queue(St.heading_gaps(_assembled(s, d)).select("document_id", F.lit("heading_continuity_gap").alias("reason"), F.col("section_number").alias("raw_text")), flagged)


query("link_tables", ", p AS (SELECT p_brand AS document_id, min(p_size) AS page FROM part GROUP BY 1), s AS (SELECT p_brand AS document_id, p_partkey AS o, p_size AS page FROM part ), k AS (SELECT *, lpad(CAST(page AS VARCHAR), 6, '0') || lpad(CAST(o AS VARCHAR), 12, '0') AS v, row_number() OVER (PARTITION BY document_id ORDER BY o DESC) AS rn FROM s), h AS (SELECT p.document_id, max(v) AS v FROM p JOIN k ON k.document_id = p.document_id AND k.page <= p.page + 10 GROUP BY 1) SELECT p.document_id, coalesce(h.v, k.v) AS hit FROM p LEFT JOIN h ON h.document_id = p.document_id LEFT JOIN k ON k.document_id = p.document_id AND k.rn = 1")(lambda s, d: _linked_tables(s, d))


def _linked_tables(spark: SparkSession, sf: str) -> DataFrame:
    part = B.read(spark, sf, "part")
    key = F.concat(F.lpad(F.col("p_size").cast("string"), 6, "0"), F.lpad(F.col("p_partkey").cast("string"), 12, "0"))
    s = part.select(F.col("p_brand").alias("document_id"), F.col("p_partkey").alias("section_order"), F.col("p_size").alias("page_start"), F.lit("MAIN").alias("tree_kind"), key.alias("section_number"), F.lit("").alias("heading_path"))
    t = B.grids(spark, sf).select("document_id", "block_id", (F.col("page_start") + 10).alias("page_start"))
    return St.link_tables_to_sections(t, s).select("document_id", F.col("section_number").alias("hit"))


query("appendix_sections", _SECTIONS + " SELECT document_id, section_number FROM a1 WHERE tree_kind <> 'MAIN'")(lambda s, d: St.appendix_sections(_assembled(s, d)).select("document_id", "section_number"))
query("hierarchy_quality", _SECTIONS + " SELECT document_id, CASE WHEN count(section_number) = 0 THEN 'weak' WHEN count(section_number) >= 3 THEN 'strong' ELSE 'partial' END AS quality FROM a1 GROUP BY 1")(lambda s, d: St.hierarchy_quality(_assembled(s, d)))
_SLUG_OF = lambda c: f"CASE WHEN regexp_replace({c}, '[^A-Za-z0-9]', '', 'g') = '' THEN 'section' ELSE regexp_replace(substring(regexp_replace(regexp_replace(lower({c}), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 80), '-+$', '') END"
_NAMED = _SECTIONS + ", a2 AS (SELECT a1.*, b.heading_title AS section_title FROM a1 LEFT JOIN b_blocks b ON b.document_id = a1.document_id AND b.document_order = a1.section_order)"
query("flat_sections", _NAMED + ", f AS (SELECT document_id, section_order, CAST(len(string_split(section_number, '.')) AS INTEGER) AS depth, section_number, section_title FROM a2 WHERE tree_kind = 'MAIN') SELECT document_id, section_order, depth, CASE WHEN depth = 3 THEN last_value(CASE WHEN depth = 2 THEN section_number END IGNORE NULLS) OVER (PARTITION BY document_id ORDER BY section_order ROWS UNBOUNDED PRECEDING) END AS parent_number, 'sec-' || " + _SLUG_OF("(section_number || ' ' || coalesce(section_title, ''))") + " AS section_id FROM f")(lambda s, d: St.flat_sections(_assembled(s, d).where("tree_kind = 'MAIN'")).select("document_id", "section_order", "depth", "parent_number", "section_id"))
query("build_artifacts")(lambda s, d: _artifacts(s, d))


def _artifacts(spark: SparkSession, sf: str) -> DataFrame:
    grids = B.blocks(spark, sf).where("document_order % 6 = 4").select("document_id", "document_order", _grid().alias("rows"))
    objects = _aligned(spark, sf).join(grids, ["document_id", "document_order"], "left").withColumn("object_type", F.lit("table"))
    return St.build_artifacts(B.documents(spark, sf).select("document_id", "filename", F.col("extracted_text").alias("text")), _assembled(spark, sf), B.blocks(spark, sf), objects)


def _damaged(spark: SparkSession, sf: str) -> DataFrame:
    """Every artifact, with another piece damaged by the document's number."""
    a = F.col("artifact_json")
    bad = F.when(_number() % 7 == 0, F.replace(a, F.lit('"structured_document_v1"'), F.lit('"other"'))).when(_number() % 7 == 1, F.replace(a, F.lit('"cleaned_text":'), F.lit('"text":')))
    bad = bad.when(_number() % 7 == 2, F.replace(a, F.lit('"document_type":'), F.lit('"type":'))).when(_number() % 7 == 3, F.replace(a, F.lit('"hierarchy":{'), F.lit('"hierarchy":{"sections":3,"old":{'))).when(_number() % 7 == 4, F.lit(None).cast("string"))
    return _artifacts(spark, sf).withColumn("artifact_json", F.when(_number() % 7 == 3, F.concat(F.replace(bad, F.lit(',"objects":'), F.lit('},"objects":')), F.lit(""))).otherwise(F.when(_number() % 7 > 4, a).otherwise(bad)))


_ALL_FIELDS = "missing artifact_type,missing document_id,missing source,missing metadata,missing cleaned_text,missing hierarchy,missing objects,missing blocks,missing enrichments,missing provenance"
query("validate_artifacts", f" SELECT document_id, CASE doc_id % 7 WHEN 0 THEN 'wrong artifact_type' WHEN 1 THEN 'missing cleaned_text' WHEN 2 THEN 'missing metadata.document_type' WHEN 3 THEN 'hierarchy.sections is no list,hierarchy.root_sections is no list' WHEN 4 THEN '{_ALL_FIELDS}' ELSE '' END AS problems FROM b_documents")(lambda s, d: files.validate_artifacts(_damaged(s, d)).select("document_id", F.array_join("problems", ",").alias("problems")))


def _tables_of(spark: SparkSession, sf: str) -> DataFrame:
    """A table after every block with order 6 i + 4: its text cut into rows of a cell; two in three under the section before it."""
    b = B.blocks(spark, sf).withColumn("section_order", F.expr("document_order div 3 * 3")).where("document_order % 6 = 4").drop("heading_title")
    paths = St.heading_paths(_heads(spark, sf)).select("document_id", F.col("document_order").alias("section_order"), F.col("numbering_token").alias("at"), "heading_path")
    b = b.join(paths, ["document_id", "section_order"]).withColumn("table_index", F.expr("document_order div 6"))
    return b.select("document_id", "document_order", "table_index", "heading_path", "normalized_text", F.when(F.expr("table_index % 3 <> 2"), F.col("at")).alias("section_number"), _grid().alias("rows"))


def _grid() -> Column:
    """The rows of the table of a block: its text in a row of a cell below a header."""
    return F.array(F.array(F.lit("item"), F.lit("text")), F.array(F.expr("cast(document_order div 6 as string)"), F.col("normalized_text")))


_TABLES_OF = _SECTIONS + _PATHS.replace("\nSELECT document_id, document_order, array_to_string", "\n, h3 AS (SELECT document_id, document_order, numbering_token, array_to_string") + """),
x0 AS (SELECT b.document_id, b.document_order, b.document_order // 6 AS table_index, h3.heading_path, b.normalized_text, CASE WHEN b.document_order // 6 % 3 <> 2 THEN h3.numbering_token END AS section_number FROM b_blocks b JOIN h3 ON h3.document_id = b.document_id AND h3.document_order = b.document_order // 3 * 3 WHERE b.document_order % 6 = 4)"""
_AUDIT = """, g AS (SELECT document_id, count(*) AS n FROM b_blocks GROUP BY 1), t AS (SELECT document_id, sum(CASE WHEN section_number IS NULL THEN 1 ELSE 0 END) AS n FROM x0 GROUP BY 1), """
query("audit_documents", _TABLES_OF + _METRICS.removeprefix(_SECTIONS) + _AUDIT.removesuffix(", ") + " SELECT document_id, CAST(sec AS BIGINT) AS section_count, CAST(prose AS BIGINT) AS prose_block_count, CAST(hollow AS BIGINT) AS suspicious_empty_section_count, cover AS coverage_ratio, CAST(orphans AS BIGINT) AS orphan_content_count, CAST(body AS BIGINT) AS body_signal_score, g.n AS block_count, CAST(coalesce(t.n, 0) AS BIGINT) AS unassigned_table_count FROM m1 JOIN g USING (document_id) LEFT JOIN t USING (document_id)")(lambda s, d: _audited(s, d).select("document_id", "section_count", "prose_block_count", "suspicious_empty_section_count", "coverage_ratio", "orphan_content_count", "body_signal_score", "block_count", "unassigned_table_count"))
query("audit_records")(lambda s, d: _audited(s, d))


def _audited(spark: SparkSession, sf: str, candidates: DataFrame | None = None) -> DataFrame:
    m = St.structure_metrics(_assembled(spark, sf), _chars(spark, sf))
    return St.audit_documents(m, St.select_parse_mode(_parse_metrics(spark, sf)), B.blocks(spark, sf), candidates or X.requirement_candidates(_units(spark, sf)), St.heading_gaps(_assembled(spark, sf)), _tables_of(spark, sf))


_LABEL = "regexp_replace(numbering_token || ' ' || coalesce(heading_title, ''), '^\\s+|\\s+$', '', 'g')"
_ROWS_SQL = _TABLES_OF.replace("array_to_string(list_filter([substring(a, 11), substring(b2, 11), substring(c2, 11)], lambda x: x IS NOT NULL), ' > ') AS heading_path", "array_to_string(list_filter([substring(a, 11), substring(b2, 11), substring(c2, 11)], lambda x: x IS NOT NULL), ' > ') AS heading_path, list_filter([substring(a, 1, 9), substring(b2, 1, 9), substring(c2, 1, 9)], lambda x: x IS NOT NULL) AS stack") + f""",
l0 AS (SELECT document_id, document_order, {_LABEL} AS label FROM b_blocks WHERE block_type <> 'paragraph'), l1 AS (SELECT h3.document_id, h3.document_order AS section_order, h3.heading_path, u.k, l0.label FROM h3, unnest(range(1, len(h3.stack) + 1)) AS u(k) JOIN l0 ON l0.document_id = h3.document_id AND l0.document_order = CAST(h3.stack[CAST(u.k AS INTEGER)] AS INTEGER)),
l2 AS (SELECT document_id, section_order, heading_path, coalesce(max(CASE WHEN k = 1 THEN label END), '') AS level_1, coalesce(max(CASE WHEN k = 2 THEN label END), '') AS level_2, coalesce(max(CASE WHEN k = 3 THEN label END), '') AS level_3, '' AS level_4 FROM l1 GROUP BY ALL),
tt AS (SELECT document_id, heading_path, list(regexp_replace(normalized_text, '^\\s+|\\s+$', '', 'g') ORDER BY table_index) AS texts FROM x0 WHERE regexp_replace(normalized_text, '\\s', '', 'g') <> '' GROUP BY ALL),
c0 AS (SELECT l2.* EXCLUDE (heading_path), list_concat(list_filter(regexp_split_to_array(coalesce(a1.body_text, ''), '\\n{{2,}}'), lambda x: regexp_replace(x, '\\s', '', 'g') <> ''), coalesce(tt.texts, [])) AS parts FROM l2 JOIN a1 USING (document_id, section_order) LEFT JOIN tt ON tt.document_id = l2.document_id AND tt.heading_path = l2.heading_path)
SELECT * EXCLUDE (parts), unnest(CASE WHEN len(parts) = 0 THEN [''] ELSE parts END) AS content, CAST(unnest(range(greatest(len(parts), 1))) AS INTEGER) AS i FROM c0"""
query("hierarchy_rows", _ROWS_SQL)(lambda s, d: St.hierarchy_rows(_assembled(s, d), _tables_of(s, d)))
_OBJECTS = """, o0 AS (SELECT *, CASE WHEN block_type = 'paragraph' AND document_order % 6 <> 4 THEN normalized_text END AS txt FROM b_blocks),
o1 AS (SELECT document_id, document_order, CAST(regexp_extract(document_id, '(\\d+)$', 1) AS BIGINT) AS k, list_filter(list(txt) OVER (PARTITION BY document_id ORDER BY document_order ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING), lambda x: x IS NOT NULL) AS b4, list_filter(list(txt) OVER (PARTITION BY document_id ORDER BY document_order ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING), lambda x: x IS NOT NULL) AS a4,
  last_value(CASE WHEN block_type <> 'paragraph' THEN numbering_token END IGNORE NULLS) OVER (PARTITION BY document_id ORDER BY document_order ROWS UNBOUNDED PRECEDING) AS section_number FROM o0 QUALIFY document_order % 6 = 4)"""
query("objects_with_context", _OBJECTS + " SELECT document_id, document_order, array_to_string(coalesce(b4[-2:], []), '|') AS before, array_to_string(coalesce(a4[1:2], []), '|') AS after, section_number FROM o1")(lambda s, d: St.objects_with_context(_with_objects(s, d)).select("document_id", "document_order", F.array_join("before", "|").alias("before"), F.array_join("after", "|").alias("after"), "preceding_heading.section_number"))
_ALIGNED = _OBJECTS + """, h0 AS (SELECT document_id, document_order AS section_order, numbering_token AS n, min(document_order) OVER (PARTITION BY document_id, numbering_token) AS lo FROM b_blocks WHERE block_type <> 'paragraph'), h1 AS (SELECT *, lead(lo) OVER (PARTITION BY document_id ORDER BY section_order) - 1 AS hi FROM h0),
w0 AS (SELECT o1.document_id, o1.document_order, min_by(n, section_order) AS n FROM o1 JOIN h1 ON h1.document_id = o1.document_id AND lo <= o1.document_order AND (hi IS NULL OR o1.document_order <= hi) WHERE k % 4 = 2 GROUP BY 1, 2),
d0 AS (SELECT o1.document_id, o1.document_id || ':block:' || o1.document_order AS block_id, o1.document_order, CASE WHEN k % 4 < 2 THEN section_number ELSE n END AS section_number, CASE WHEN k % 4 = 0 THEN 0.98 WHEN k % 4 = 1 THEN 0.84 WHEN n IS NOT NULL THEN 0.72 ELSE 0.0 END AS confidence, CASE WHEN k % 4 = 0 THEN 'explicit_heading_context' WHEN k % 4 = 1 THEN 'nearest_preceding_heading' WHEN n IS NOT NULL THEN 'page_order_window' ELSE 'unplaced' END AS method FROM o1 LEFT JOIN w0 USING (document_id, document_order))"""
query("align_objects", _ALIGNED + " SELECT * REPLACE (CAST(confidence AS DOUBLE) AS confidence) FROM d0")(lambda s, d: _aligned(s, d))
query("unplaced_objects", _ALIGNED + " SELECT document_id, block_id, document_order FROM d0 WHERE section_number IS NULL")(lambda s, d: St.unplaced_objects(_aligned(s, d)).select("document_id", "block_id", "document_order"))
query("heading_anchors", _ALIGNED + " SELECT document_id, section_order, CAST(lo AS INTEGER) AS start_order, CAST(hi AS INTEGER) AS end_order FROM h1")(lambda s, d: _anchors(s, d).select("document_id", "section_order", "start_order", "end_order"))
query("merged_outline_nodes", _SECTIONS + ", j AS (SELECT a0.*, h.numbering_token AS n FROM a0 JOIN b_blocks h ON h.document_id = a0.document_id AND h.document_order = a0.section_order WHERE a0.block_type = 'paragraph') SELECT document_id, n AS section_number, document_order, n || '.p' || row_number() OVER (PARTITION BY document_id, n ORDER BY document_order) AS node_id, block_type, normalized_text FROM j")(lambda s, d: St.merged_outline_nodes(_assembled(s, d).where("section_number is not null"), B.blocks(s, d)))
query("resolve_section_number", " SELECT DISTINCT document_id, numbering_token || '.9' AS ref, numbering_token AS resolved FROM b_blocks WHERE block_type <> 'paragraph'")(lambda s, d: St.resolve_section_number(_heads(s, d).select("document_id", F.concat("numbering_token", F.lit(".9")).alias("ref")).distinct(), _assembled(s, d).where("section_number is not null")))


def _with_objects(spark: SparkSession, sf: str) -> DataFrame:
    return B.blocks(spark, sf).withColumns({"block_id": F.concat("document_id", F.lit(":block:"), "document_order"), "block_type": F.when(F.expr("document_order % 6 = 4"), "table").otherwise(F.col("block_type"))})


def _anchors(spark: SparkSession, sf: str) -> DataFrame:
    """Sections by the headings they stand for. Of the lines only the headings make sections here, as no prose of theirs is asked for; they are
    cut from the texts once, staged, and both sides read them, dealt by document."""
    heads = B.spread(staged(_heads(spark, sf).drop("project_id")), "document_id")
    sections = St.assemble_sections(heads).select("document_id", "section_order", "section_number", "section_title")
    return St.heading_anchors(sections, heads)


def _aligned(spark: SparkSession, sf: str) -> DataFrame:
    """Objects whose near headings are known or not by the document's number, so that each way of placing them is taken."""
    anchors = _anchors(spark, sf)
    objects = St.objects_with_context(_with_objects(spark, sf))
    none = F.array().cast("array<string>")
    objects = objects.withColumns({"before": F.when(_number() % 4 < 2, F.col("before")).otherwise(none), "after": F.when(_number() % 4 < 2, F.col("after")).otherwise(none), "explicit_heading": F.when(_number() % 4 == 0, F.col("explicit_heading")), "preceding_heading": F.when(_number() % 4 < 2, F.col("preceding_heading"))})
    return St.align_objects(objects, anchors.withColumn("matched", F.col("matched") & (_number() % 4 != 3)), 0.6)


def _nodes(spark: SparkSession, sf: str) -> DataFrame:
    """Outline nodes: sections by number, paragraphs below them."""
    s = _assembled(spark, sf).where("tree_kind = 'MAIN'")
    number = F.regexp_replace("section_number", r"\.0$", "")
    secs = s.select("document_id", number.alias("node_id"), F.when(number.contains("."), F.regexp_replace(number, r"\.[^.]*$", "")).alias("parent_id"), F.lit("section").alias("node_type"), F.col("section_number"), "section_title", F.size(F.split(number, r"\.")).alias("depth"), F.col("section_order").alias("position"), F.lit("").alias("text"), F.lit("accepted").alias("status"))
    paras = s.select("document_id", number.alias("parent_id"), F.posexplode(F.filter(F.split("body_text", "\n\n"), lambda x: x != "")).alias("i", "text")).select("document_id", F.concat("parent_id", F.lit(".p"), F.col("i") + 1).alias("node_id"), "parent_id", F.lit("paragraph").alias("node_type"), F.lit(None).cast("string").alias("section_number"), F.lit(None).cast("string").alias("section_title"), F.lit(0).alias("depth"), F.col("i").alias("position"), "text", F.when(F.expr("i % 2 = 0"), "needs-review").otherwise("accepted").alias("status"))
    return secs.unionByName(paras)


_NODES = _SECTIONS + """, n1 AS (SELECT document_id, regexp_replace(section_number, '\\.0$', '') AS node_id, section_order, list_filter(string_split(body_text, chr(10) || chr(10)), lambda x: x <> '') AS parts FROM a1 WHERE tree_kind = 'MAIN'),
n2 AS (SELECT *, CASE WHEN contains(node_id, '.') THEN regexp_replace(node_id, '\\.[^.]*$', '') END AS parent_id, len(parts) AS p FROM n1) """
_N3 = ", n3 AS (SELECT n2.document_id, node_id, parent_id, section_order AS position, b.heading_title AS title FROM n2 JOIN b_blocks b ON b.document_id = n2.document_id AND b.document_order = n2.section_order UNION ALL SELECT document_id, node_id || '.p' || (i + 1), node_id, i, NULL FROM (SELECT document_id, node_id, unnest(range(p)) AS i FROM n2))"
_PAIRS = ", e1 AS (SELECT document_id, parent_id AS root, node_id FROM n2 WHERE parent_id IS NOT NULL), e2 AS (SELECT a.document_id, a.root, b.node_id FROM e1 a JOIN e1 b ON b.document_id = a.document_id AND b.root = a.node_id), e3 AS (SELECT a.document_id, a.root, b.node_id FROM e2 a JOIN e1 b ON b.document_id = a.document_id AND b.root = a.node_id)"
_NODE_SQL = {
    "normalize_numbering": """, r0 AS (SELECT n2.document_id, node_id, b.numbering_token AS number, CAST(string_split(b.numbering_token, '.')[1] AS INTEGER) AS top, NOT contains(node_id, '.') AS root, CAST(regexp_extract(n2.document_id, '(\\d+)$', 1) AS BIGINT) % 3 = 0 AS listed FROM n2 JOIN b_blocks b ON b.document_id = n2.document_id AND b.document_order = n2.section_order),
    r1 AS (SELECT document_id, bool_or(listed AND node_id = '1') AND min(CASE WHEN root AND NOT (listed AND node_id = '1') THEN top END) > 1 AS gone FROM r0 GROUP BY 1)
    SELECT document_id, node_id, CASE WHEN coalesce(gone, FALSE) THEN (top - 1) || regexp_extract(number, '^\\d+(.*)$', 1) ELSE number END AS section_number FROM r0 JOIN r1 USING (document_id) WHERE NOT (coalesce(gone, FALSE) AND top = 1) UNION ALL SELECT document_id, node_id || '.p' || (i + 1), NULL FROM (SELECT document_id, node_id, unnest(range(p)) AS i FROM n2)""",
    "resequence": _N3 + " SELECT document_id, node_id, parent_id, CAST(row_number() OVER (PARTITION BY document_id, parent_id ORDER BY position, title NULLS FIRST, node_id) AS INTEGER) AS position FROM n3",
    "descendants": _PAIRS + " SELECT *, 1 AS distance FROM e1 UNION ALL SELECT *, 2 FROM e2 UNION ALL SELECT *, 3 FROM e3",
    "outline_requirements": " , q AS (SELECT document_id, node_id AS parent_id, section_order, unnest(parts) AS text, unnest(range(p)) AS i FROM n2) SELECT q.document_id, parent_id, parent_id || '.p' || (i + 1) AS node_id, text, numbering_token AS section_number, heading_title AS section_title, regexp_replace(numbering_token || ' ' || heading_title, '^\\s+|\\s+$', '', 'g') AS section_label FROM q JOIN b_blocks b ON b.document_id = q.document_id AND b.document_order = q.section_order",
    "outline_stats": " SELECT document_id, 'section' AS node_type, count(*) AS n FROM n2 GROUP BY 1 UNION ALL SELECT document_id, 'paragraph', CAST(sum(p) AS BIGINT) FROM n2 GROUP BY 1 HAVING sum(p) > 0",
    "section_index": " SELECT document_id, node_id, parent_id, len(string_split(node_id, '.')) AS depth, (SELECT count(*) FROM n2 k WHERE k.document_id = n2.document_id AND k.parent_id = n2.node_id) AS child_count FROM n2",
    "section_requirement_counts": " SELECT document_id, node_id, p AS requirements FROM n2",
    "review_rollup": " SELECT document_id, CAST(count(*) + sum(p) AS BIGINT) AS items, CAST(sum((p + 1) // 2) AS BIGINT) AS flagged, CAST(count(*) + sum(p // 2) AS BIGINT) AS accepted FROM n2 GROUP BY 1",
}
for _name, _f in (("outline_stats", St.outline_stats), ("section_index", St.section_index), ("normalize_numbering", lambda n: St.normalize_numbering(n.withColumn("section_title", F.when((F.col("node_id") == "1") & (_number() % 3 == 0), "Table of Contents").otherwise(F.col("section_title")))).select("document_id", "node_id", "section_number")), ("outline_requirements", St.outline_requirements), ("section_requirement_counts", St.section_requirement_counts), ("resequence", lambda n: St.resequence(n).select("document_id", "node_id", "parent_id", "position")), ("review_rollup", St.review_rollup), ("descendants", lambda n: St.descendants(n.where("node_type = 'section'")))):
    query(_name, _NODES + _NODE_SQL[_name] if _name in _NODE_SQL else None)(lambda s, d, f=_f: f(_nodes(s, d)))

_WINDOWS = "list_filter(regexp_split_to_array(coalesce(text, ''), '\\s+'), lambda x: x <> '')"
query("chunk_words", f", w AS (SELECT doc_id, {_WINDOWS} AS w FROM documents), k AS (SELECT doc_id, w, unnest(range(CAST(greatest(ceil((len(w) - 220) / 180.0), 0) AS BIGINT) + 1)) AS chunk_index FROM w WHERE len(w) > 0) SELECT doc_id, CAST(chunk_index AS INTEGER) AS chunk_index, array_to_string(w[chunk_index * 180 + 1 : chunk_index * 180 + 220], ' ') AS chunk FROM k")(lambda s, d: C.chunk_words(B.read(s, d, "documents").select("doc_id", "text")))
_HEADING = "regexp_replace(coalesce(section_number, '') || ' ' || CASE WHEN coalesce(section_title, '') <> '' THEN section_title ELSE 'Section' END, '^\\s+|\\s+$', '', 'g')"
query("artifact_chunks", _TABLES_OF + _NAMED.removeprefix(_SECTIONS) + f""", c0 AS (SELECT document_id, 's-' || (row_number() OVER (PARTITION BY document_id ORDER BY section_order) - 1) || '-0' AS chunk_index, 'section' AS chunk_kind, section_number AS section_path, {_HEADING} AS section_heading, array_to_string(list_filter(regexp_split_to_array({_HEADING}, '\\s+'), lambda x: x <> ''), ' ') AS body_text FROM a2 WHERE section_order IS NOT NULL),
c1 AS (SELECT *, 'Section Heading: ' || section_heading || chr(10) || chr(10) || body_text AS text FROM c0 UNION ALL SELECT document_id, 't-' || table_index, 'table', coalesce(section_number, 'DOCUMENT'), coalesce(section_number, 'Document Body'), content, 'Table Content' || chr(10) || chr(10) || content FROM (SELECT *, regexp_replace('item | text' || chr(10) || table_index || ' | ' || normalized_text, '\\s+$', '') AS content FROM x0))
SELECT document_id, project_id, filename, chunk_index, chunk_kind, section_path, section_heading, body_text, text FROM c1 JOIN b_documents USING (document_id)""")(lambda s, d: _artifact_chunks(s, d).select("document_id", "project_id", "filename", "chunk_index", "chunk_kind", "section_path", "section_heading", "body_text", "text"))


def _artifact_chunks(s: SparkSession, d: str) -> DataFrame:
    return (C.artifact_chunks(B.documents(s, d).select("document_id", "project_id", "filename", F.col("extracted_text").alias("text")).join(St.hierarchy_quality(_assembled(s, d)), "document_id"), _assembled(s, d), _tables_of(s, d).withColumnRenamed("section_number", "attached_section_id")))


_CUT = lambda table, index: f"(SELECT *, {index} || '-' || j AS chunk_index, array_to_string(w[j * 180 + 1 : j * 180 + 220], ' ') AS body FROM (SELECT *, unnest(range(CAST(greatest(ceil((len(w) - 220) / 180.0), 0) AS BIGINT) + 1)) AS j FROM (SELECT *, list_filter(regexp_split_to_array(body_text, '\\s+'), lambda x: x <> '') AS w FROM {table}) WHERE len(w) > 0))"
_KEEP = "project_id, filename, document_id, section_path, section_heading"
query("section_chunks", f""", {SENTENCES}, k0 AS (SELECT {_KEEP}, chunk_index, 'section' AS chunk_kind, body AS body_text, NULL AS requirement_type FROM {_CUT('b_sections', 'section_index')} UNION ALL SELECT {_KEEP}, chunk_index, 'table', body, NULL FROM {_CUT('b_tables', "'t-' || section_index")}
  UNION ALL SELECT {_KEEP}, section_index || '-r-' || sentence_index, 'requirement', sentence, {_case('sentence', L.REQUIREMENT_TYPES)} FROM s_raw WHERE {_case('sentence', L.REQUIREMENT_TYPES)} IS NOT NULL)
SELECT *, 'Section Path: ' || section_path || chr(10) || 'Section Heading: ' || section_heading || chr(10) || chr(10) || body_text AS text FROM k0""")(lambda s, d: C.section_chunks(B.sections(s, d), B.tables(s, d)).drop("point_id"))
query("embed_chunks", f", w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '\\s+'), lambda x: x <> '') AS w FROM documents) SELECT doc_id, CAST(unnest(range(CAST(greatest(ceil((len(w) - 220) / 180.0), 0) AS BIGINT) + 1)) AS INTEGER) AS chunk_index, 64 AS dims FROM w WHERE len(w) > 0")(lambda s, d: C.embed_chunks(C.chunk_words(B.read(s, d, "documents").select("doc_id", "text")).withColumnRenamed("chunk", "text")).select("doc_id", "chunk_index", F.size("vector").alias("dims")))
query("check_dimensions", " SELECT CAST(len(vector) AS INTEGER) AS dims, count(*) AS n FROM b_chunks GROUP BY 1")(lambda s, d: C.check_dimensions(B.chunks(s, d)))
_REFRESH_SQL = ", touched AS (SELECT DISTINCT project_id, filename FROM b_chunks WHERE vec_id % 10 = 0) SELECT point_id FROM b_chunks c WHERE NOT EXISTS (SELECT 1 FROM touched t WHERE t.project_id = c.project_id AND t.filename = c.filename) UNION ALL SELECT 'new-' || vec_id FROM b_chunks WHERE vec_id % 10 = 0"
_POINTS = lambda s, d: B.chunks(s, d).select("point_id", "project_id", "filename", "text", "vector", "vec_id")
_NEW_POINTS = lambda s, d: _POINTS(s, d).where("vec_id % 10 = 0").withColumn("point_id", F.concat(F.lit("new-"), "vec_id"))
query("refresh_index", _REFRESH_SQL)(lambda s, d: C.refresh_index(_POINTS(s, d), _NEW_POINTS(s, d)).select("point_id"))
query("table_refresh", _REFRESH_SQL)(lambda s, d: _kept(s, refresh_in, _POINTS(s, d), _NEW_POINTS(s, d), R.VERSION).select("point_id"))


def _asked(spark: SparkSession, sf: str) -> DataFrame:
    return B.chunks(spark, sf).where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "project_id", F.col("vector").alias("query_vector"))


_DOT = "list_sum(list_transform(list_zip(c.vector, q.vector), lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE)))"
_NORM = "sqrt(list_sum(list_transform({0}, lambda z: CAST(z AS DOUBLE) * CAST(z AS DOUBLE))))"
_MATCHES = f", scored AS (SELECT q.vec_id AS query_id, c.project_id, c.point_id, c.filename, c.chunk_index, c.text, c.chunk_kind, {_DOT} / ({_NORM.format('c.vector')} * {_NORM.format('q.vector')}) AS score FROM b_chunks c JOIN b_chunks q ON c.project_id = q.project_id AND q.vec_id % 20 = 0), ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, point_id) AS rank FROM scored)"
query("retrieve", _MATCHES + " SELECT query_id, CAST(rank AS INTEGER) AS rank, point_id, score FROM ranked WHERE rank <= 5")(lambda s, d: C.retrieve(B.chunks(s, d), _asked(s, d)).select("query_id", "rank", "point_id", "score"))


def _evidence(spark: SparkSession, sf: str) -> DataFrame:
    return C.package_evidence(C.retrieve(B.chunks(spark, sf), _asked(spark, sf), 6))


_BEST = _MATCHES + f""", m0 AS (SELECT *, {_NOISY} AS noisy, {_PRIORITY} AS priority FROM ranked WHERE rank <= 6),
m1 AS (SELECT *, row_number() OVER (PARTITION BY project_id, filename, chunk_index, text ORDER BY noisy, priority, lower(filename), query_id, rank) AS r FROM m0),
best AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY noisy, priority, lower(filename), query_id, rank) AS position FROM m1 WHERE r = 1)"""
query("package_evidence", _BEST + " SELECT project_id, CAST(position AS INTEGER) AS position, filename, chunk_index, text FROM best WHERE position <= 30")(lambda s, d: _evidence(s, d).select("project_id", "position", "filename", "chunk_index", "text"))
query("context_block", _BEST + " SELECT project_id, string_agg('[' || position || '] ' || filename || chr(10) || text, chr(10) || chr(10) ORDER BY position) AS context FROM best WHERE position <= 30 GROUP BY 1")(lambda s, d: C.context_block(_evidence(s, d)))
query("citations", _BEST + " SELECT project_id, CAST(position AS INTEGER) AS position, filename, chunk_index, chunk_kind FROM best WHERE position <= 30")(lambda s, d: C.citations(_evidence(s, d)))
query("documents_considered", _BEST + " SELECT DISTINCT project_id, filename FROM best WHERE position <= 30")(lambda s, d: C.documents_considered(_evidence(s, d)))
query("latest_questions", ", l AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, text DESC) AS rn FROM conversations WHERE role = 'user') SELECT conv_id, turn, text AS question FROM l WHERE rn = 1 AND regexp_replace(coalesce(text, ''), '\\s', '', 'g') <> ''")(lambda s, d: C.latest_questions(B.read(s, d, "conversations")))


def _chat(spark: SparkSession, sf: str) -> DataFrame:
    """Every conversation's last question, sent to the project of its number."""
    index = B.chunks(spark, sf)
    projects = index.select("project_id").distinct().withColumn("k", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("project_id")) - 1)
    n = max(projects.count(), 1)
    q = C.latest_questions(B.read(spark, sf, "conversations")).withColumnRenamed("question", "text").withColumn("k", (F.col("conv_id") % n).cast("int")).join(projects, "k")
    q = C.embed_chunks(q).select(F.col("conv_id").alias("query_id"), "project_id", F.col("vector").alias("query_vector"))
    return C.chat_evidence(q, index).select("query_id", "rank", "point_id", "filename", "score")


query("chat_evidence")(_chat)
_WEIGHT = f"(CASE WHEN {' OR '.join(f'contains(lower(c.filename), {chr(39)}{t}{chr(39)})' for t in L.POSITIVE_FILENAMES)} THEN 5 ELSE 0 END - CASE WHEN {' OR '.join(f'contains(lower(c.filename), {chr(39)}{t}{chr(39)})' for t in L.NEGATIVE_FILENAMES)} THEN 8 ELSE 0 END)"
_RELATED = f""", q0 AS (SELECT *, list_distinct(list_filter(regexp_extract_all(lower(requirement_text), '[a-z0-9]{{3,}}'), lambda x: x NOT IN ({', '.join(repr(w) for w in L.SEARCH_STOPWORDS)}))) AS tokens, regexp_extract_all(requirement_text, '(?i)\\bsections?\\s+(\\d+(?:\\.\\d+)*)', 1) AS refs FROM b_requirements),
q1 AS (SELECT s.id AS s_id, c.id AS c_id, c.filename, {_WEIGHT} AS weight, CASE WHEN len(c.tokens) = 0 THEN 0 ELSE 5 * len(list_filter(s.tokens, lambda x: list_contains(c.tokens, x))) + CASE WHEN s.modality = c.modality THEN 2 ELSE 0 END + CASE WHEN s.actor = c.actor THEN 2 ELSE 0 END
  + CASE WHEN list_contains(s.refs, c.section_number) THEN 14 WHEN len(list_filter(s.refs, lambda r: starts_with(c.section_number, r || '.') OR starts_with(r, c.section_number || '.'))) > 0 THEN 6 ELSE 0 END + {_WEIGHT} + CASE WHEN s.section_number = c.section_number THEN 1 ELSE 0 END + CASE WHEN s.filename = c.filename THEN 1 ELSE 0 END END AS score
  FROM q0 s JOIN q0 c ON s.project_id = c.project_id AND s.id <> c.id WHERE s.doc_id % 20 = 0),
q2 AS (SELECT *, row_number() OVER (PARTITION BY s_id ORDER BY score DESC, weight DESC, filename, c_id) AS rank FROM q1 WHERE score > 0)
SELECT s_id, CAST(rank AS INTEGER) AS rank, c_id, CAST(score AS DOUBLE) AS score FROM q2 WHERE rank <= 20"""
query("related_requirements", _RELATED)(lambda s, d: S.related_requirements(B.requirements(s, d).where("doc_id % 20 = 0"), B.requirements(s, d), reasons=False).select("s_id", "rank", "c_id", "score"))
_ASKED_TEXT = "'See section 1.' || (doc_id % 4) || ' and Appendix A: ' || section_heading || ' ' || substring(requirement_text, 1, 200)"
_TOKENS = lambda c: f"list_distinct(list_filter(regexp_extract_all(lower({c}), '[a-z0-9]{{3,}}'), lambda x: x NOT IN ({', '.join(repr(w) for w in L.SEARCH_STOPWORDS)})))"
_QUERY_TEXT = _RELATED.replace("AS tokens, regexp_extract_all(requirement_text,", f"AS tokens, {_TOKENS(_ASKED_TEXT)} AS asked, regexp_extract_all({_ASKED_TEXT},").replace("5 * len(list_filter(s.tokens, lambda x: list_contains(c.tokens, x)))", "4 * len(list_filter(s.asked, lambda x: list_contains(c.tokens, x))) + len(list_filter(s.tokens, lambda x: list_contains(c.tokens, x))) + CASE WHEN contains(upper(c.filename || ' ' || c.section_heading), 'APPENDIX A') THEN 10 ELSE 0 END")
_SPOKEN = lambda s, d: B.requirements(s, d).where("doc_id % 20 = 0").withColumn("query_text", F.concat(F.lit("See section 1."), F.col("doc_id") % 4, F.lit(" and Appendix A: "), "section_heading", F.lit(" "), F.substring("requirement_text", 1, 200)))
query("related_query_text", _QUERY_TEXT)(lambda s, d: S.related_requirements(_SPOKEN(s, d), B.requirements(s, d), reasons=False).select("s_id", "rank", "c_id", "score"))
_BULK = f""", q0 AS (SELECT *, list_distinct(list_filter(regexp_extract_all(lower(requirement_text), '[a-z0-9]{{3,}}'), lambda x: x NOT IN ({', '.join(repr(w) for w in L.SEARCH_STOPWORDS)}))) AS tokens, list_distinct(regexp_extract_all(requirement_text, '(?i)\\bsections?\\s+(\\d+(?:\\.\\d+)*)', 1)) AS refs FROM b_requirements),
t0 AS (SELECT project_id, id, unnest(tokens) AS token FROM q0), n0 AS (SELECT s.id AS s_id, c.id AS c_id, count(*) AS n FROM t0 s JOIN t0 c USING (project_id, token) GROUP BY ALL),
q1 AS (SELECT s.id AS s_id, c.id AS c_id, c.filename, {_WEIGHT} AS weight, CASE WHEN len(c.tokens) = 0 THEN 0 ELSE 5 * coalesce(n0.n, 0) + CASE WHEN s.modality = c.modality THEN 2 ELSE 0 END + CASE WHEN s.actor = c.actor THEN 2 ELSE 0 END
  + CASE WHEN list_contains(s.refs, c.section_number) THEN 14 WHEN len(list_filter(s.refs, lambda r: starts_with(c.section_number, r || '.') OR starts_with(r, c.section_number || '.'))) > 0 THEN 6 ELSE 0 END + {_WEIGHT} + CASE WHEN s.section_number = c.section_number THEN 1 ELSE 0 END + CASE WHEN s.filename = c.filename THEN 1 ELSE 0 END END AS score
  FROM q0 s JOIN q0 c ON s.project_id = c.project_id AND s.id <> c.id LEFT JOIN n0 ON n0.s_id = s.id AND n0.c_id = c.id),
q2 AS (SELECT *, row_number() OVER (PARTITION BY s_id ORDER BY score DESC, weight DESC, filename, c_id) AS rank FROM q1 WHERE score > 0)
SELECT s_id, CAST(rank AS INTEGER) AS rank, c_id, CAST(score AS DOUBLE) AS score FROM q2 WHERE rank <= 5"""
query("related_bulk", _BULK)(lambda s, d: S.related_requirements(B.requirements(s, d), B.requirements(s, d), limit=5, reasons=False).select("s_id", "rank", "c_id", "score"))


def _semantic(spark: SparkSession, sf: str) -> DataFrame:
    """The five nearest requirements of each source by their vectors, as a semantic index returns them."""
    r = B.requirements(spark, sf)
    v = staged(C.embed_chunks(r.withColumnRenamed("requirement_text", "text")).select(F.col("id").alias("point_id"), "project_id", "doc_id", "vector"))
    asked = v.where("doc_id % 20 = 0").select(F.col("point_id").alias("query_id"), "project_id", F.col("vector").alias("query_vector"))
    near = C.retrieve(v, asked).select(F.col("query_id").alias("s_id"), F.col("point_id").alias("id"), (F.col("rank") - 1).alias("rank"))
    keys = r.select("id", "project_id", "filename", "section_number", S.text_key(F.col("requirement_text")).alias("text_key"))
    return S.semantic_boosts(near.join(keys, "id"), r)


def _given_matches(spark: SparkSession, sf: str) -> DataFrame:
    """Five matches of each source, as an index might return them: texts in other case and spacing, the source itself among them."""
    r = B.requirements(spark, sf)
    s = r.where("doc_id % 20 = 0").select(F.col("id").alias("s_id"), F.explode(F.sequence(F.lit(0), F.lit(4))).alias("rank"), "doc_id").withColumn("doc_id", F.col("doc_id") + F.col("rank") * 20)
    return s.join(r.select("doc_id", "project_id", "filename", "section_number", "requirement_text"), "doc_id").select("s_id", "project_id", "rank", F.upper("filename").alias("filename"), "section_number", F.concat(F.lit(" "), F.replace("requirement_text", F.lit(" "), F.lit("  "))).alias("text"))


_LINE_KEY = lambda c: f"lower({STRIP(f"regexp_replace(coalesce({c}, ''), '{chr(92)}s+', ' ', 'g')")})"
_BOOSTED = _RELATED[: _RELATED.index("q2 AS")] + f"""k0 AS (SELECT project_id, {_LINE_KEY('filename')} AS f, section_number AS n, {_LINE_KEY('requirement_text')} AS t, max(id) AS c_id FROM b_requirements GROUP BY ALL),
k1 AS (SELECT 'doc-' || (b.doc_id - r * 20) AS s_id, c_id, CAST(sum(18 - r) AS DOUBLE) AS boost FROM b_requirements b, range(5) AS x(r) JOIN k0 ON k0.project_id = b.project_id AND k0.f = {_LINE_KEY('b.filename')} AND k0.n = b.section_number AND k0.t = {_LINE_KEY('b.requirement_text')} WHERE (b.doc_id - r * 20) % 20 = 0 AND b.doc_id - r * 20 IN (SELECT doc_id FROM b_requirements) GROUP BY ALL),
k2 AS (SELECT q1.s_id, q1.c_id, q1.filename, q1.weight, CASE WHEN score > 0 THEN score ELSE 0 END + coalesce(boost, 0) AS score FROM q1 LEFT JOIN k1 ON k1.s_id = q1.s_id AND k1.c_id = q1.c_id WHERE score > 0 OR boost IS NOT NULL)
SELECT s_id, CAST(row_number() OVER (PARTITION BY s_id ORDER BY score DESC, weight DESC, filename, c_id) AS INTEGER) AS rank, c_id, CAST(score AS DOUBLE) AS score FROM k2 QUALIFY row_number() OVER (PARTITION BY s_id ORDER BY score DESC, weight DESC, filename, c_id) <= 20"""
query("semantic_boosts", _BOOSTED)(lambda s, d: S.related_requirements(B.requirements(s, d).where("doc_id % 20 = 0"), B.requirements(s, d), S.semantic_boosts(_given_matches(s, d), B.requirements(s, d)), reasons=False).select("s_id", "rank", "c_id", "score"))
query("merge_semantic")(lambda s, d: S.related_requirements(B.requirements(s, d).where("doc_id % 20 = 0"), B.requirements(s, d), _semantic(s, d)))


def _support(spark: SparkSession, sf: str) -> DataFrame:
    r = B.requirements(spark, sf)
    return r.select("project_id", F.when(F.expr("doc_id % 5 < 3"), "Base IDIQ PWS.docx").otherwise("Appendix A.docx").alias("filename"), "section_number", F.col("section_heading").alias("section_title"), F.array("requirement_text", "section_heading").alias("snippets"))


_PARA = lambda s, d: B.requirements(s, d).select("project_id", F.col("id").alias("paragraph_id"), F.col("requirement_text").alias("text"))
_WORDS = lambda c: f"list_distinct(list_filter(list_transform(regexp_extract_all(coalesce({c}, ''), '[A-Za-z][A-Za-z0-9/&\\-]{{2,}}'), lambda x: lower(x)), lambda x: x NOT IN ({', '.join(repr(w) for w in L.LINK_STOPWORDS)})))"
_LINKS = f""", sup AS (SELECT project_id, CASE WHEN doc_id % 5 < 3 THEN 'Base IDIQ PWS.docx' ELSE 'Appendix A.docx' END AS filename, section_number, [requirement_text, section_heading] AS snippets FROM b_requirements),
par AS (SELECT project_id, id AS paragraph_id, requirement_text AS body_text, {_WORDS('requirement_text')} AS words FROM b_requirements),
hit AS (SELECT p.project_id, paragraph_id, words, filename, s.section_number AS cited, snippets, 'governing_section' AS relationship, 3 AS keep FROM (SELECT *, unnest(list_distinct(regexp_extract_all(body_text, '(?i)\\bsections?\\s+(\\d+(?:\\.\\d+)*)', 1))) AS n FROM par) p JOIN sup s ON s.project_id = p.project_id AND s.section_number = n AND s.filename = 'Base IDIQ PWS.docx'
  UNION ALL SELECT p.project_id, paragraph_id, words, filename, 'APPENDIX ' || letter, snippets, 'referenced_appendix', 2 FROM (SELECT *, unnest(list_distinct({_LETTERS_SQL})) AS letter FROM par) p JOIN sup s ON s.project_id = p.project_id AND letter = 'A' AND s.filename = 'Appendix A.docx'),
sn AS (SELECT * EXCLUDE (snippets), unnest(snippets) AS snippet, unnest([0, 1]) AS i FROM hit), sc AS (SELECT *, {_WORDS('snippet')} AS sw FROM sn),
sr AS (SELECT *, round(CASE WHEN len(words) > 0 AND len(sw) > 0 THEN len(list_filter(words, lambda x: list_contains(sw, x))) / len(words) ELSE 0.0 END, 3) AS score FROM sc), rk AS (SELECT *, row_number() OVER (PARTITION BY relationship, project_id, paragraph_id, filename, cited ORDER BY score DESC, i, snippet) AS r FROM sr),
links AS (SELECT project_id, paragraph_id, filename, cited, string_agg(snippet, '|' ORDER BY r) AS supporting, relationship FROM rk WHERE r <= keep AND (score > 0 OR r = 1) GROUP BY ALL)"""
_LINK = lambda df: df.withColumn("supporting", F.array_join("supporting", "|"))
query("governing_section_links", _LINKS + " SELECT * FROM links WHERE relationship = 'governing_section'")(lambda s, d: _LINK(S.governing_section_links(_PARA(s, d), _support(s, d))))
query("appendix_links", _LINKS + " SELECT * FROM links WHERE relationship = 'referenced_appendix'")(lambda s, d: _LINK(S.appendix_links(_PARA(s, d), _support(s, d))))
query("related_links", _LINKS + " SELECT * FROM links")(lambda s, d: _LINK(S.related_links(_PARA(s, d), _support(s, d))))
query("correlation_summary", _LINKS + " SELECT project_id, relationship, count(*) AS links, count(DISTINCT paragraph_id) AS paragraphs, count(DISTINCT filename) AS documents FROM links GROUP BY 1, 2")(lambda s, d: S.correlation_summary(S.related_links(_PARA(s, d), _support(s, d))))


def _events(spark: SparkSession, sf: str) -> DataFrame:
    from bidspark.streaming.events import batch_document_events

    e = B.read(spark, sf, "events")
    value = F.to_json(F.struct(F.lit("document.extracted").alias("event_type"), F.concat(F.lit("doc-"), "user_id").alias("document_id"), F.col("event_type").alias("project_id"), F.col("props").alias("filename"), F.lit("").alias("extracted_text"), F.date_trunc("second", "ts").alias("created_at")))
    return batch_document_events(e.select(value.alias("value"))).select("document_id", F.unix_seconds("created_at").alias("at"))


query("document_events", " SELECT 'doc-' || user_id AS document_id, CAST(min(epoch(date_trunc('second', ts))) AS BIGINT) AS at FROM events GROUP BY 1")(_events)
_REFRESHED = f""", {SENTENCES}, req AS (SELECT document_id, count(*) AS n FROM s_raw WHERE {_case('sentence', L.REQUIREMENT_TYPES)} IS NOT NULL GROUP BY 1), lastdoc AS (SELECT * FROM b_body QUALIFY row_number() OVER (PARTITION BY project_id, filename ORDER BY doc_id % 3 DESC, doc_id DESC) = 1),
ch AS (SELECT document_id, CASE WHEN len(w) > 0 THEN CAST(greatest(ceil((len(w) - 220) / 180.0), 0) AS BIGINT) + 1 ELSE 0 END + coalesce(n, 0) AS n FROM (SELECT document_id, list_filter(regexp_split_to_array(body_text, '\\s+'), lambda x: x <> '') AS w FROM lastdoc) LEFT JOIN req USING (document_id))
SELECT document_id, coalesce(req.n, 0) AS requirements, coalesce(ch.n, 0) AS chunks, coalesce(ch.n, 0) AS vectors FROM req FULL JOIN (SELECT * FROM ch WHERE n > 0) ch USING (document_id)"""


def _refreshed(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of the three tables that events keep fresh, after all documents came in three batches, one of them twice."""
    from bidspark.streaming.events import Sinks, refresh

    d = B.documents(spark, sf).withColumn("extracted_text", B.prefixed(F.col("extracted_text"), F.col("doc_id"))).select("project_id", "document_id", "filename", "extracted_text", "created_at", "doc_id")
    sinks = Sinks.at(spark, passing(spark), 8)
    for k in (0, 1, 1, 2):
        refresh(d.where(F.col("doc_id") % 3 == k).drop("doc_id"), k, sinks)
    of = lambda t, name: t.read().groupBy("document_id").agg(F.count("*").alias(name))
    parts = [of(t, n) for t, n in ((sinks.requirements, "requirements"), (sinks.chunks, "chunks"), (sinks.index, "vectors"))]
    return reduce(lambda a, b: a.join(b, "document_id", "full"), parts).na.fill(0)


query("stream_refresh", _REFRESHED)(_refreshed)


def _folder(spark: SparkSession, sf: str) -> DataFrame:
    """Bytes of each project's files, after the texts were written as files of a folder per project."""
    path = passing(spark)
    B.documents(spark, sf).select("project_id", F.coalesce("extracted_text", F.lit("")).alias("value")).write.partitionBy("project_id").text(path)
    return files.scan_folder(spark, path).groupBy("project_id").agg(F.sum("size_bytes").alias("bytes"))


query("scan_folder", " SELECT 'project_id=' || project_id AS project_id, CAST(sum(strlen(coalesce(extracted_text, '')) + 1) AS BIGINT) AS bytes FROM b_documents GROUP BY 1")(_folder)


def _manifests(spark: SparkSession, sf: str) -> DataFrame:
    """One manifest per project, some with a name, some with a model."""
    path, n = passing(spark), F.count("*")
    rows = B.documents(spark, sf).groupBy("project_id").agg(F.when(n % 2 == 0, F.concat(F.lit("Name of "), "project_id")).alias("display_name"), F.when(n % 3 == 0, "model").alias("model_id"), n.alias("documents"))
    rows.withColumnRenamed("project_id", "p").repartition("p").write.partitionBy("p").json(path)
    return files.read_project_manifests(spark, f"{path}/*/*.json")


query("project_manifests", ", m AS (SELECT 'p=' || project_id AS project_id, CASE WHEN count(*) % 2 = 0 THEN 'Name of ' || project_id END AS d, CASE WHEN count(*) % 3 = 0 THEN 'model' END AS m FROM b_documents GROUP BY project_id) SELECT project_id, coalesce(d, project_id) AS display_name, coalesce(m, d, project_id) AS model_id FROM m")(_manifests)


def _csv(spark: SparkSession, sf: str) -> DataFrame:
    """The requirement export written as CSV, compressed, and read back."""
    path = passing(spark)
    files.write_csv(_export(spark, sf), path, "requirement", "gzip")
    back = spark.read.option("header", "true").option("escape", '"').option("multiLine", "true").csv(path)
    return back.select(*[F.coalesce(c, F.lit("")).alias(c) for c in back.columns])


query("write_csv", EXPORT_SQL + "SELECT " + ", ".join(f"coalesce({c}, '') AS {c}" for c in X.EXPORT) + " FROM export")(_csv)
query("iter_paragraphs")(lambda s, d: St.iter_paragraphs(_markdown(s, d).withColumnRenamed("normalized_markdown", "text")))
_GRID_TEXT = "SELECT document_id, 'name|type|size|' || chr(10) || string_agg(array_to_string(r, '|'), chr(10) ORDER BY row_index) AS cells FROM b_grid GROUP BY 1"
_CELLS = lambda md: F.array_join(F.transform(St.markdown_tables(md), lambda r: F.array_join(r, "|")), "\n").alias("cells")
query("markdown_tables", " " + _GRID_TEXT)(lambda s, d: B.grids(s, d).select("document_id", St.render_markdown_table(F.col("rows")).alias("md")).select("document_id", _CELLS(F.col("md"))))
query("inline_tables", " " + _GRID_TEXT.replace("size|", "size|due"))(lambda s, d: B.grids(s, d).select("document_id", F.concat(F.lit("See "), F.replace(St.render_markdown_table(F.concat(F.array(F.array(*map(F.lit, ("name", "type", "size", "due")))), F.expr("slice(rows, 2, size(rows))"))), F.lit("\n"), F.lit(" "))).alias("md")).select("document_id", _CELLS(F.col("md"))))


def _structured(spark: SparkSession, sf: str) -> DataFrame:
    """Converter output of each document: its lines as texts, every second one inside a group."""
    lines = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: x != "")
    refs = F.transform(lines, lambda x, i: F.struct(F.when(i % 2 == 0, F.concat(F.lit("#/texts/"), i)).otherwise(F.concat(F.lit("#/groups/"), i)).alias("$ref")))
    groups = F.transform(lines, lambda x, i: F.struct(F.array(F.struct(F.concat(F.lit("#/texts/"), i).alias("$ref"))).alias("children")))
    texts = F.transform(lines, lambda x: F.struct(x.alias("text")))
    return B.read(spark, sf, "documents").select("doc_id", F.to_json(F.struct(F.struct(refs.alias("children")).alias("body"), groups.alias("groups"), texts.alias("texts"))).alias("structured_json"))


query("explode_structured_json", " SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS document_order, text FROM (SELECT doc_id, array_to_string(list_filter(regexp_split_to_array(x, '\\s+'), lambda w: w <> ''), ' ') AS text, i FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS x, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS i FROM documents)) WHERE text <> ''")(lambda s, d: St.explode_structured_json(_structured(s, d)).select("doc_id", "document_order", "text"))
#: Lines of documents as text, rows, rules and blanks, by their order and the document's number.
_LINE_OF = "CASE (document_order + k) % 7 WHEN 1 THEN '| ' || replace(line, ' ', ' | ') || ' |' WHEN 2 THEN '| --- | --- |' WHEN 3 THEN 'a | ' || line WHEN 4 THEN '|' || line || '|b|' WHEN 5 THEN '' WHEN 6 THEN line || ' **x** | `y`' ELSE line END"
_PLAIN_MD = lambda c: f"regexp_replace(regexp_replace(regexp_replace({c}, '\\*\\*(.*?)\\*\\*', '\\1', 'g'), '__(.*?)__', '\\1', 'g'), '`([^`]+)`', '\\1', 'g')"
_CONTENT = f""", c0 AS (SELECT document_id, document_order AS i, CAST(regexp_extract(document_id, '(\\d+)$', 1) AS BIGINT) AS k, document_order, line FROM b_lines), c1 AS (SELECT document_id, i, {STRIP('(' + _LINE_OF + ')')} AS x FROM c0),
c2 AS (SELECT *, regexp_matches(x, '^\\|?.+\\|.+\\|?$') AS is_row, regexp_matches(x, '^\\|?[\\s:-]+(?:\\|[\\s:-]+)+\\|?$') AS is_rule FROM c1), c3 AS (SELECT *, is_row AND coalesce(lead(is_rule) OVER (PARTITION BY document_id ORDER BY i), FALSE) AS leads, sum(CASE WHEN is_row THEN 0 ELSE 1 END) OVER (PARTITION BY document_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS island FROM c2),
c4 AS (SELECT *, min(CASE WHEN leads THEN i END) OVER (PARTITION BY document_id, island) AS first FROM c3), c5 AS (SELECT *, is_row AND coalesce(i >= first, FALSE) AS in_table FROM c4), c6 AS (SELECT *, NOT in_table AND x <> '' AS loose FROM c5 WHERE NOT (in_table AND i = first + 1)),
c7 AS (SELECT *, CASE WHEN in_table THEN 't' || first ELSE 'x' || sum(CASE WHEN loose THEN 0 ELSE 1 END) OVER (PARTITION BY document_id ORDER BY i ROWS UNBOUNDED PRECEDING) END AS block FROM c6),
c8 AS (SELECT document_id, block, min(i) AS i, bool_or(in_table) AS is_table, {_PLAIN_MD("string_agg(x, chr(10) ORDER BY i)")} AS text, string_agg(array_to_string(list_transform(string_split(regexp_replace(x, '^\\||\\|$', '', 'g'), '|'), lambda y: {_PLAIN_MD(STRIP('y'))}), '|'), chr(10) ORDER BY i) AS cells FROM c7 WHERE x <> '' GROUP BY 1, 2)
SELECT document_id, CAST(row_number() OVER (PARTITION BY document_id ORDER BY i) - 1 AS INTEGER) AS block_index, CASE WHEN is_table THEN 'table' ELSE 'paragraph' END AS block_type, CASE WHEN is_table THEN '' ELSE text END AS text, CASE WHEN is_table THEN cells ELSE '' END AS cells FROM c8"""


def _content(spark: SparkSession, sf: str) -> DataFrame:
    lines = B.read(spark, sf, "documents").select(F.concat(F.lit("doc-"), "doc_id").alias("document_id"), F.col("doc_id").alias("k"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("document_order", "line"))
    lines = lines.withColumn("x", F.expr(_LINE_OF))
    docs = lines.groupBy("document_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("document_order", "x"))), lambda s: s["x"]), "\n").alias("content"))
    return St.structured_content(docs, keys=("document_id",)).select("document_id", "block_index", "block_type", "text", F.array_join(F.transform("rows", lambda r: F.array_join(r, "|")), "\n").alias("cells"))


query("structured_content", _CONTENT)(_content)
query("outline_nodes")(lambda s, d: O.outline_nodes(_markdown(s, d).withColumnRenamed("normalized_markdown", "markdown")))
query("prepare_outline_lines")(lambda s, d: Cl.prepare_outline_lines(_markdown(s, d).withColumnRenamed("normalized_markdown", "raw_text")).select("document_id", F.array_join("lines", "\n").alias("markdown")))


_DELIVERED = f"unit_id || ':deliverable:' || (row_number() OVER (PARTITION BY unit_id ORDER BY fi) - 1)"
_REPORT = _CANDIDATES + ", " + _GAPS + _TABLES_OF + f""", size AS (SELECT document_id, count(*) AS n FROM b_blocks GROUP BY 1),
r AS (SELECT 'Sections' AS report, document_id, section_number AS item FROM a1 UNION ALL SELECT 'Appendices_Attachments', document_id, section_number FROM a1 WHERE tree_kind <> 'MAIN' UNION ALL SELECT 'Tables', document_id, CAST(table_index AS VARCHAR) FROM x0
  UNION ALL SELECT 'Requirements', document_id, candidate_id FROM cand UNION ALL SELECT 'Deliverables', document_id, {_DELIVERED} FROM ta WHERE {_case('fragment', [('d', L.DELIVERABLE)])} IS NOT NULL
  UNION ALL SELECT 'Review_Queue', document_id, section_number FROM gaps UNION ALL SELECT 'Review_Queue', document_id, requirement_text FROM cand WHERE ruled AND modality = 'informational' UNION ALL SELECT 'Audit', document_id, CAST(n AS VARCHAR) FROM size) SELECT * FROM r"""


@query("report_bundle", _REPORT)
def report_bundle(spark, sf):
    """What the seven tables of all projects' reports list, by document."""
    units, sections = _units(spark, sf), _assembled(spark, sf)
    # three of the tables read the candidates, and each order reads its table twice: what is listed of them is staged
    flagged = F.when(F.col("review_flag"), F.col("requirement_text")).alias("requirement_text")
    candidates = staged(X.requirement_candidates(units).select("document_id", "candidate_id", "review_flag", flagged))
    deliverables = staged(X.deliverable_candidates(units).select("document_id", "deliverable_id"))
    named = files.report_bundle(sections, candidates, deliverables, _tables_of(spark, sf), _reviews(spark, sf, candidates), _audited(spark, sf, candidates))
    item = {"Sections": "section_number", "Appendices_Attachments": "section_number", "Tables": "table_index", "Requirements": "candidate_id", "Deliverables": "deliverable_id", "Review_Queue": "raw_text", "Audit": "block_count"}
    out = [df.select(F.lit(k).alias("report"), "document_id", F.col(item[k]).cast("string").alias("item")) for k, df in named.items()]
    return reduce(DataFrame.unionByName, out)
