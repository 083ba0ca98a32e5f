import json
import random
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from bidspark.functions import text as T
from bidspark.operators import chunks as C
from bidspark.operators import extract as X
from bidspark.operators import relational as R
from bidspark.operators import similarity as S
from bidspark.operators import structure as St
from bidspark.sources import files


def one(spark, column, *values):
    """The column's value for each text."""
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(column(F.col("t"))).collect()]


def test_text_functions(spark):
    assert one(spark, T.normalize_inline, " a\n b\t\tc ", None) == ["a b c", ""]
    assert one(spark, T.clean_extracted_text, "UNCLASSIFIED\r\nPage 3\nx  y[bookmark:a]\n\n\n\n\nz") == ["x y\n\n\nz"]
    assert one(spark, T.strip_classification, "(U) (S//NF) Scope", "(U)") == ["Scope", "(U)"]
    assert one(spark, T.strip_page_artifacts, "1.1 Scope ...... 12", "1.1 Scope 12", "Scope") == ["1.1 Scope", "1.1 Scope", "Scope"]
    assert one(spark, T.strip_trailing_page_digits, "Purpose12", "123", "A1B") == ["Purpose", "123", "A1B"]
    assert one(spark, T.clean_line, "  - (U) do it", "  12  ", "104 text Error! Bookmark not defined.", "(Unclassified//FOUO)") == ["  - do it", "", "text", ""]
    assert one(spark, T.strip_margin_line_numbers, "12   The text\n13\n14\tgoes on", "1.1 Scope", "7 the end") == ["The text goes on", "1.1 Scope", "7 the end"]
    assert one(spark, lambda c: T.compact_text(c, 10), "0123456789", "0123456 89ab") == ["0123456789", "0123456..."]
    assert one(spark, lambda c: T.slug(c, 8, "x"), "Hello, World!", "--", None) == ["hello-wo", "x", "x"]
    assert one(spark, T.remap_section_number, "3.1", "2.1", "x") == ["1.1", "2.1", "x"]
    assert one(spark, lambda c: T.offset_section_number(c, F.lit(2)), "3.1", "2") == ["1.1", "2"]
    assert one(spark, T.decimal_heading_level, "1.0", "1.2", "1.2.3") == [1, 2, 3]
    assert one(spark, T.reference_level, "SECTION L", "L", "L.3.2", "L.3.") == [0, 1, 3, 2]
    assert one(spark, T.normalize_bullet, "• (U) x", "o item", "   - body", "plain") == ["- x", "  - item", "   - body", "plain"]
    assert one(spark, T.expand_inline_bullets, "do this o Then that o And so") == [["do this", "  - Then that", "  - And so"]]
    assert one(spark, T.filename_weight, "TO1 PWS.docx", "Pricing Template.xlsx", None) == [5, -8, 0]
    assert one(spark, T.doc_priority, "Section L.pdf", "Appendix A", "x", None) == [0, 2, 50, 99]
    assert one(spark, T.is_noisy_doc, "a.xlsx", "a.docx", None) == [True, False, True]
    assert one(spark, T.derive_document_tags, "Appendix_B IDIQ PWS.docx") == [["APPENDIX B", "BASE IDIQ PWS"]]
    assert one(spark, T.appendix_refs_ranged, "see Appendices A - C and E, Appendix G") == [["A", "B", "C", "E", "G"]]
    assert one(spark, T.appendix_refs, "Appendix A, B") == [["A", "B"]]
    assert one(spark, T.section_refs, "Section 4.10 and sections 2") == [["4.10", "2"]]
    assert one(spark, T.build_normalized_requirement, "(a) The text", "1.1 x") == ["The text", "x"]
    assert one(spark, lambda c: T.is_upper_heading(c), "SCOPE OF WORK", "Scope Of Work") == [True, False]
    assert one(spark, lambda c: T.is_likely_pws(c, F.lit(None)), "my SOW.docx", "x") == [True, False]


def test_point_ids_are_name_based_uuids(spark):
    got = one(spark, lambda c: T.point_id(F.lit("p"), c, F.lit("0-1")), "a.docx", "é.pdf")
    assert got == [str(uuid.uuid5(uuid.NAMESPACE_URL, f"p:{n}:0-1")) for n in ("a.docx", "é.pdf")]


def test_classifiers_take_the_first_match(spark):
    assert one(spark, T.classify_requirement, "Offerors shall submit", "is required", "will evaluate", "SCI", "CDRL", "none") == ["submission", "instruction", "evaluation", "security", "deliverable", None]
    assert one(spark, T.detect_modality, "may", "will", "x") == ["informational", "will", "informational"]
    assert one(spark, T.detect_actor, "The COR", "offeror", "coñ") == ["cor", "contractor", None]


def test_sentences_and_exports(spark):
    assert one(spark, X.sentences, "One. Two shall\ngo! (three) e.g. four", None) == [["One.", "Two shall go!", "(three) e.g. four"], []]
    assert one(spark, X.split_protected_sentences, "It is 3.5 m, e.g. a lot. Yes!") == [["It is 3.5 m, e.g. a lot.", "Yes!"]]
    md = "# Scope\nThe contractor shall\ndeliver it. Nothing here.\n\n**Next**\nIt must work"
    rows = X.markdown_export_rows(spark.createDataFrame([("p", "f", "s", "d", md, "", "")], "project_id string, filename string, content_sha256 string, provider string, normalized_markdown string, section_path string, section_heading string")).collect()
    assert sorted((r.pws_area, r.trigger_keyword, r.requirement_text) for r in rows) == [("Next", "must", "It must work"), ("Scope", "deliver", "deliver it."), ("Scope", "shall", "The contractor shall")]


def test_hierarchy_export_numbers_and_titles(spark):
    md = "# 3 Scope\nThe contractor shall deliver all things.\n## 3.1 (U) Detail\nIt must be on time at all times. It must be on time at all times.\n## 3.2 Empty\nnothing"
    got = X.hierarchy_requirement_export(spark.createDataFrame([("d", md)], "document_id string, normalized_markdown string")).orderBy("requirement_id").collect()
    assert [(r.requirement_id, r.level_1_title, r.level_2_title) for r in got] == [("1-001", "Scope", ""), ("1.1-001", "Scope", "Detail")]


def test_summary_round_trip(spark):
    md = "## Executive Summary\nText\n\n## Key Documents\n- a\n* b\n"
    df = X.parse_summary_sections(spark.createDataFrame([(md,)], "markdown string"))
    r = df.first()
    assert (r.executive_summary, r.key_documents, r.scope_of_work) == ("Text", ["a", "b"], "")
    again = X.parse_summary_sections(X.render_summary_sections(df, "again").select(F.col("again").alias("markdown"))).first()
    assert (again.executive_summary, again.key_documents) == ("Text", ["a", "b"])


@pytest.mark.parametrize("parts", [1, 7])
def test_heading_paths_equal_a_stack(spark, parts):
    rng = random.Random(9)
    rows, want = [], {}
    for d in range(20):
        stack = []
        for o in range(25):
            level, tree = rng.randrange(4), rng.choice(["MAIN"] * 9 + ["APPENDIX"])
            if tree != "MAIN":
                stack = []
            while stack and stack[-1][0] >= level:
                stack.pop()
            parent = stack[-1][2] if stack else None
            stack.append((level, f"n{o}", o))
            want[(f"d{d}", o)] = (" > ".join(s[1] for s in stack), parent)
            rows.append((f"d{d}", o, level, f"n{o}", "t", tree))
    df = spark.createDataFrame(rows, "document_id string, document_order int, heading_level int, numbering_token string, heading_title string, tree_kind string").repartition(parts, F.rand(1))
    assert {(r.document_id, r.document_order): (r.heading_path, r.parent_order) for r in St.heading_paths(df).collect()} == want


def test_classified_blocks(spark):
    texts = ["Page 3", "APPENDIX A - Terms", "SECTION L Instructions", "1.0 Scope", "1.2.3 Deep", "4 Simple", "(a) item", "- bullet item", "NOTE: x", "SCOPE OF WORK ITEMS", "plain text here", "x"]
    got = St.classify_blocks(spark.createDataFrame(list(enumerate(texts)), "o int, normalized_text string")).orderBy("o").collect()
    assert [r.block_type for r in got] == ["page_break", "appendix_heading", "heading", "heading", "heading", "heading", "list_item", "list_item", "note", "heading", "paragraph", "footer_or_header"]
    assert [r.heading_level for r in got[1:6]] == [1, 1, 1, 3, 1] and got[1].numbering_token == "APPENDIX A"


def test_content_scope_and_stage1(spark):
    b = [("heading", "Table of Contents", None), ("paragraph", "1.1 Scope 4", None), ("heading", "1.0 Scope", "1.0"), ("paragraph", "text", None)]
    df = spark.createDataFrame([("d", i, t, x, x, n) for i, (t, x, n) in enumerate(b)], "document_id string, document_order int, block_type string, normalized_text string, heading_title string, numbering_token string")
    assert [r.content_scope for r in St.tag_content_scope(df).orderBy("document_order").collect()] == ["table_of_contents", "table_of_contents", "body", "body"]
    s = spark.createDataFrame([("d", "m", i, t, "text", None) for i, t in enumerate(["1 Scope", "1.1 Detail", "2.1.1 Deep", "APPENDIX A Terms", "words only"])], "document_id string, source_kind string, source_order int, text_exact string, label string, markdown_heading_level int")
    got = St.stage1_sections(s).orderBy("source_order").collect()
    assert [(r.accepted, r.parent_section_number, r.parent_missing) for r in got] == [(True, None, False), (True, "1", False), (True, "2.1", True), (True, None, False), (False, None, False)]


def test_tables(spark):
    df = spark.createDataFrame([("d", "t", [["h1", "h2"], ["a", None], ["b", "c", "d"]])], "document_id string, block_id string, rows array<array<string>>")
    assert [(r.row_index, r.row_text, r.is_header) for r in St.table_rows(df).orderBy("row_index").collect()] == [(0, "h1 | h2", True), (1, "a", False), (2, "b | c | d", False)]
    assert {(r.row_index, r.col_index): r.header_text for r in St.table_cells(df).collect()}[(2, 2)] is None
    md = df.select(St.render_markdown_table(F.col("rows")).alias("m")).select(St.markdown_tables(F.col("m"))).first()[0]
    assert md == [["h1", "h2", ""], ["a", "", ""], ["b", "c", "d"]]


def test_structured_json(spark):
    doc = {"body": {"children": [{"$ref": "#/texts/0"}, {"$ref": "#/groups/0"}, {"$ref": "#/tables/0"}, {"$ref": "#/texts/9"}]}, "groups": [{"children": [{"$ref": "#/texts/1"}]}], "texts": [{"text": "A  b", "prov": [{"page_no": 2}]}, {"text": "B"}], "tables": [{"data": {"grid": [[{"text": "x"}, {"text": ""}]]}}]}
    got = St.explode_structured_json(spark.createDataFrame([("d", json.dumps(doc)), ("e", "{bad"), ("f", None)], "document_id string, structured_json string")).orderBy("document_order").collect()
    assert [(r.kind, r.text, r.page_start) for r in got] == [("text", "A b", 2), ("text", "B", None), ("table", "x", None)]


def test_chunks_cover_every_word(spark):
    for n, size, overlap in ((0, 5, 2), (4, 5, 2), (5, 5, 2), (23, 5, 2), (9, 3, 3)):
        words = [f"w{i}" for i in range(n)]
        got = one(spark, lambda c, s=size, o=overlap: C.word_windows(c, s, o), " ".join(words))[0]
        want, start = [], 0
        while start < n:
            end = min(n, start + size)
            want.append(" ".join(words[start:end]))
            if end >= n:
                break
            start = max(end - overlap, start + 1)
        assert got == want


def test_retrieve_equals_brute_force(spark):
    rng = np.random.default_rng(0)
    x, q = rng.standard_normal((200, 6)), rng.standard_normal((4, 6))
    index = spark.createDataFrame([(f"p{i:03}", "ab"[i % 2], "section", [float(v) for v in r]) for i, r in enumerate(x)], "point_id string, project_id string, chunk_kind string, vector array<double>")
    ask = spark.createDataFrame([(i, "ab"[i % 2], [float(v) for v in r]) for i, r in enumerate(q)], "query_id int, project_id string, query_vector array<double>")
    got = C.retrieve(index, ask, 5).collect()
    for i in range(4):
        mine = [k for k in range(200) if k % 2 == i % 2]
        s = {k: x[k] @ q[i] / np.linalg.norm(x[k]) / np.linalg.norm(q[i]) for k in mine}
        assert [r.point_id for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == i] == [f"p{k:03}" for k in sorted(mine, key=lambda k: -s[k])[:5]]


def test_upsert_and_replace_are_idempotent(spark):
    kind = "document_id string, provider string, v int, created_at int"
    old = spark.createDataFrame([("a", "x", 1, 10), ("b", "x", 2, 20)], kind)
    new = spark.createDataFrame([("a", "x", 5, 99), ("c", "x", 6, 98)], kind)
    once = R.upsert(old, new)
    want = [("a", "x", 5, 10), ("b", "x", 2, 20), ("c", "x", 6, 98)]
    assert sorted(map(tuple, once.collect())) == want == sorted(map(tuple, R.upsert(once, new).collect()))
    rep = R.replace_by_document(old, new)
    assert sorted(map(tuple, rep.collect())) == sorted(map(tuple, R.replace_by_document(rep, new).collect()))
    assert R.replace_by_document(old, new.limit(0), touched=old.where("document_id = 'a'")).count() == 1


def test_latest_versions_and_nulls(spark):
    df = spark.createDataFrame([("1", "p", "f", "extracted", 1), ("2", "p", "f", "extracted", 2), ("3", "p", "f", "extracted", 2), ("4", "p", "project.json", "extracted", 9), ("5", "p", "g", "failed", 9)], "id string, project_id string, filename string, extraction_status string, created_at int")
    assert [r.id for r in R.latest_documents(df).collect()] == ["2"]


def test_related_requirements_rank(spark):
    cols = "project_id string, id string, filename string, section_number string, section_heading string, heading_path string, requirement_text string, modality string, actor string, action string, object_text string"
    rows = [("p", "r1", "A PWS.docx", "1.1", "", "", "The contractor shall track network outages under section 2.3", "shall", "contractor", None, None), ("p", "r2", "B PWS.docx", "2.3", "", "", "Network outages are tracked", "shall", "contractor", None, None), ("p", "r3", "Pricing Template.xlsx", "9", "", "", "Unit costs", None, None, None, None)]
    df = spark.createDataFrame(rows, cols)
    got = S.related_requirements(df.where("id = 'r1'"), df).orderBy("rank").collect()
    assert [r.c_id for r in got] == ["r2"]
    assert got[0].score == 2 * 5 + 2 + 2 + 14 + 5
    every = S.related_requirements(df, df).where("s_id = 'r1'").collect()
    assert [(r.c_id, r.score) for r in every] == [("r2", got[0].score)]


def test_related_requirements_equal_all_pairs(spark, monkeypatch):
    """Small cells, common words, ties, empty texts: the shortlist loses no candidate that belongs to the best."""
    monkeypatch.setattr(S, "CELL", 7)
    rng = random.Random(4)
    pick = lambda *xs: rng.choice(xs)
    words = ["system", "data", "network", "outage", "report", "section 2.3", "section 4", "Appendix B", "monthly", "care"]
    cols = "project_id string, id string, filename string, section_number string, section_heading string, heading_path string, requirement_text string, modality string, actor string, action string, object_text string"
    rows = [(pick("p", "p", "q"), f"r{i:02}", pick("A PWS.docx", "Appendix B.docx", "Pricing Template.xlsx", None), pick("2.3", "2.3.1", "4", "4.1", "", None), pick("", "Appendix B"), "", pick("", None, " ".join(rng.choices(words, k=4)), " ".join(rng.choices(words, k=6))), pick("shall", "must", None), pick("contractor", None), pick("track", None), pick("", "network care", None)) for i in range(60)]
    df = spark.createDataFrame(rows, cols)
    pairs = S.score_related(df, df).where("s_id <> c_id and score > 0").select("s_id", "c_id", "score", "weight", "c_filename").collect()
    want = {}
    for r in sorted(pairs, key=lambda r: (-r.score, -r.weight, r.c_filename, r.c_id)):
        want.setdefault(r.s_id, []).append((r.c_id, r.score))
    got = {}
    for r in S.related_requirements(df, df, limit=6).orderBy("s_id", "rank").collect():
        got.setdefault(r.s_id, []).append((r.c_id, r.score))
    assert got == {k: v[:6] for k, v in want.items()}
    boosts = spark.createDataFrame([("r00", "r01", 18.0), ("r00", "r00", 18.0), ("r02", "r59", 17.0)], "s_id string, c_id string, boost double")
    up = {(r.s_id, r.c_id): r.score for r in S.related_requirements(df, df, boosts, limit=60).collect()}
    score = {(r.s_id, r.c_id): r.score for r in pairs}
    assert up["r00", "r01"] == score.get(("r00", "r01"), 0.0) + 18 and ("r00", "r00") not in up and up["r02", "r59"] == score.get(("r02", "r59"), 0.0) + 17


def test_related_cells_score_few_pairs_in_full(monkeypatch):
    """Sources stream past a cell's candidates in several batches; few pairs are scored in full, and the best are those of all pairs."""
    import pyarrow as pa

    rng = np.random.default_rng(3)
    word = lambda n: np.unique((rng.random(n) ** 3 * 800).astype(np.int64))
    some = lambda *xs: [x for x in xs if rng.random() < 0.1]
    rows = [{"cell": 1, "project_id": "p", "id": f"r{i:04}", "filename": f"f{i % 4}", "weight": int(5 * (i % 4 == 0) - 8 * (i % 4 == 1)), "tokens": word(int(rng.integers(0, 300))).tolist(), "asked": word(9).tolist(), "objects": word(3).tolist() if i % 3 else [], "numbers": some(int(rng.integers(9))), "above": some(1, 2), "letters": some(7), **{f: int(rng.integers(3)) for f, _ in S.FIELD_POINTS}} for i in range(1500)]
    sets = pa.list_(pa.int64())
    schema = pa.schema([(k, sets if isinstance(v, list) else pa.string() if isinstance(v, str) else pa.int64()) for k, v in rows[0].items()] + [("ask", pa.bool_())])
    batch = lambda part, ask: pa.RecordBatch.from_pylist([r | {"ask": ask} for r in part], schema)
    asks = rows[:150]
    full = []
    meet = S._meet
    monkeypatch.setattr(S, "_meet", lambda sets, index, n, left, right: full.append(len(left)) or meet(sets, index, n, left, right))
    for queried in (False, True):
        full.clear()
        given = sorted(rows, key=lambda r: (r["filename"], r["id"]))
        got = pa.Table.from_batches(S._best_of_cells(iter([batch(given[:700], False), batch(given[700:], False), batch(asks[:60], True), batch(asks[60:], True)]), 5, queried)).to_pylist()
        assert sum(full) / 4 < 0.25 * len(asks) * len(rows)  # a pair scored in full is looked up four times

        def score(s, c):
            both = lambda a, b: len(set(s[a]) & set(c[b]))
            terms = both("tokens", "tokens") + 4 * both("asked" if queried else "tokens", "tokens") + 3 * both("objects", "objects")
            place = 14 if both("numbers", "numbers") else 6 if both("numbers", "above") or both("above", "numbers") else 0
            return terms + place + 10 * (both("letters", "letters") > 0) + c["weight"] + sum(n for f, n in S.FIELD_POINTS if s[f] and s[f] == c[f])

        want = []
        for s in asks:
            best = sorted((-score(s, c), -c["weight"], c["filename"], c["id"]) for c in rows if c["tokens"] and c["id"] != s["id"])
            want += [(s["id"], name, -x) for x, _, _, name in best[:5] if x < 0]
        assert [(r["s_id"], r["c_id"], r["score"]) for r in got] == want


def test_related_requirements_without_reasons(spark):
    cols = "project_id string, id string, filename string, section_number string, section_heading string, heading_path string, requirement_text string, modality string, actor string, action string, object_text string"
    df = spark.createDataFrame([("p", f"r{i}", "a.docx", "1", "", "", f"network outage {i % 3} report{i % 4}", None, None, None, None) for i in range(12)], cols)
    short, full = S.related_requirements(df, df, limit=3, reasons=False), S.related_requirements(df, df, limit=3)
    assert sorted(map(tuple, short.collect())) == sorted(map(tuple, full.drop("match_reason").collect())) and all(r.match_reason for r in full.collect())
    text = lambda x: x._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all(lower")
    assert text(short) <= 4  # terms of text and object on each side, once


def test_related_requirements_lifted_without_reasons(spark):
    """Boosted and queried scores are those of the rows with reasons, whose semantic matches are named."""
    cols = "project_id string, id string, filename string, section_number string, section_heading string, heading_path string, requirement_text string, modality string, actor string, action string, object_text string"
    df = spark.createDataFrame([("p", f"r{i}", "a.docx", "1", "", "", f"network outage {i % 3} report{i % 4}" if i else "", None, None, None, None) for i in range(12)], cols)
    boosts = spark.createDataFrame([("r1", "r0", 18.0), ("r1", "r5", 17.0), ("r1", "r1", 9.0)], "s_id string, c_id string, boost double")
    asked = df.withColumn("query_text", F.when(F.col("id") < "r5", "outage report2"))
    for sources, b in ((df, boosts), (asked, None), (asked, boosts)):
        short, full = S.related_requirements(sources, df, b, 4, reasons=False), S.related_requirements(sources, df, b, 4)
        assert short.columns == ["s_id", "rank", "c_id", "score"]
        assert sorted(map(tuple, short.collect())) == sorted(map(tuple, full.drop("match_reason").collect()))
        said = {(r.s_id, r.c_id): r.match_reason for r in full.collect()}
        assert b is None or said["r1", "r0"] == "semantic match" and said["r1", "r5"].startswith("shared terms: ") and said["r1", "r5"].endswith("; semantic match")


def test_boosts_move_digests_of_texts(spark):
    """Texts of other case and spacing meet, also by a digest made before; the requirement of the largest id has the boost."""
    req = spark.createDataFrame([("p", "r1", "A.docx", "1.1", "Track  outages\n"), ("p", "r2", "a.DOCX ", "1.1", "track outages"), ("q", "r3", "A.docx", "1.1", "track outages"), ("p", "r4", None, None, None)], "project_id string, id string, filename string, section_number string, requirement_text string")
    m = spark.createDataFrame([("s", "p", 0, "a.docx", "1.1", " TRACK outages"), ("s", "p", 3, "A.docx", "1.1", "track outages"), ("s", "p", 1, "A.docx", "1.2", "track outages"), ("t", "p", 2, "", "", "")], "s_id string, project_id string, rank int, filename string, section_number string, text string")
    got = S.semantic_boosts(m, req)
    want = [("s", "r2", 33.0), ("t", "r4", 16.0)]
    assert sorted(map(tuple, got.collect())) == want
    assert sorted(map(tuple, S.semantic_boosts(m.withColumn("text_key", S.text_key(F.col("text"))).drop("text"), req).collect())) == want
    assert "sha2" in got._jdf.queryExecution().optimizedPlan().toString()


def test_links(spark):
    p = spark.createDataFrame([("p", "x", "Follow section 4.10 and Appendices A - B for network care")], "project_id string, paragraph_id string, text string")
    s = spark.createDataFrame([("p", "Base IDIQ PWS.docx", "4.10", "Care", ["network care matters", "other"]), ("p", "Appendix A.docx", "1", "T", ["none"]), ("p", "Appendix B.docx", "1", "T", ["care of network"])], "project_id string, filename string, section_number string, section_title string, snippets array<string>")
    got = {(r.relationship, r.filename): r.supporting for r in S.related_links(p, s).collect()}
    assert got == {("governing_section", "Base IDIQ PWS.docx"): ["network care matters"], ("referenced_appendix", "Appendix A.docx"): ["none"], ("referenced_appendix", "Appendix B.docx"): ["care of network"]}


def test_files_and_manifests(spark, tmp_path):


    (tmp_path / "proj").mkdir()
    for name, body in (("a.txt", "x"), ("project.json", '{"display_name": "D"}'), (".hidden", "h")):
        (tmp_path / "proj" / name).write_text(body)
    assert [(r.project_id, r.filename, r.size_bytes) for r in files.scan_folder(spark, str(tmp_path)).collect()] == [("proj", "a.txt", 1)]
    assert [tuple(r) for r in files.read_project_manifests(spark, f"{tmp_path}/*/project.json").collect()] == [("proj", "D", "D")]
    bad = spark.createDataFrame([("d", "{}"), ("e", None), ("f", "[not json")], "document_id string, artifact_json string")
    got = {r.document_id: r.problems for r in files.validate_artifacts(bad).collect()}
    assert all(v == [f"missing {f}" for f in files.FIELDS] for v in got.values())


def test_parse_modes(spark):
    """Markdown with sections and prose wins over a sound structure; then plain text, structure, and review."""
    rows = [
        ("md", "structural", 3, 5, 0, 0.9, 0, 11), ("md", "markdown", 2, 2, 0, 0.9, 0, 6),
        ("text", "structural", 1, 0, 1, 0.0, 0, 0), ("text", "text", 1, 1, 0, 1.0, 0, 3),
        ("own", "structural", 3, 5, 0, 0.9, 0, 11),
        ("toc", "structural", 3, 5, 0, 0.9, 99, 11), ("toc", "markdown", 1, 0, 1, 0.0, 0, 1),
        ("none", "structural", 0, 0, 0, 0.0, 0, 0), ("none", "markdown", 0, 4, 0, 0.0, 0, 4),
    ]
    df = spark.createDataFrame(rows, "document_id string, source string, section_count long, prose_block_count long, suspicious_empty_section_count long, coverage_ratio double, toc_signal_score long, body_signal_score long")
    got = {r.document_id: (r.parse_mode, r.fallback_reason) for r in St.select_parse_mode(df).collect()}
    assert got == {"md": ("hybrid_markdown_fill", "docling_body_signal_low"), "text": ("tika_fallback", "docling_and_markdown_body_signal_low"), "own": ("docling_structural", None), "toc": ("hybrid_markdown_fill", "docling_body_signal_low"), "none": ("manual_review_required", "no_reliable_structural_source")}


def test_objects_are_placed_by_the_first_rule_that_fits(spark):
    anchors = spark.createDataFrame([("d", 0, "1", "Network Operations", 10, 19, 2, 3, True), ("d", 1, "2", "Help Desk Services", 20, None, 4, 6, True), ("d", 2, "3", "Monthly Cost Report", 90, None, None, None, False)], "document_id string, section_order int, section_number string, section_title string, start_order int, end_order int, page_start int, page_end int, matched boolean")
    head = "struct<section_number:string,section_title:string>"
    rows = [("e", 5, ("2", "x"), ("1", "y"), None, []), ("p", 6, ("9", "x"), ("1", "y"), None, []), ("o", 12, None, None, None, []), ("g", 12, None, None, 3, []), ("l", 1, None, None, 3, ["the monthly cost"]), ("n", 1, None, None, None, ["other words"])]
    objects = spark.createDataFrame([("d", b, o, e, p, pg, t, []) for b, o, e, p, pg, t in rows], f"document_id string, block_id string, document_order int, explicit_heading {head}, preceding_heading {head}, page_start int, before array<string>, after array<string>")
    got = {r.block_id: (r.section_number, round(r.confidence, 2), r.method) for r in St.align_objects(objects, anchors, 0.6).collect()}
    assert got == {"e": ("2", 0.98, "explicit_heading_context"), "p": ("1", 0.84, "nearest_preceding_heading"), "o": ("1", 0.72, "page_order_window"), "g": ("1", 0.8, "page_order_window"), "l": ("3", 0.69, "lexical_overlap"), "n": (None, 0.0, "unplaced")}
    assert {r.block_id for r in St.unplaced_objects(St.align_objects(objects, anchors)).collect()} == {"l", "n"}


def test_artifacts_hierarchy_rows_and_table_chunks(spark):
    sections = spark.createDataFrame([("d", 0, "3", "Operations", 1, "MAIN", "Top paragraph", 1), ("d", 1, "3.1", "Program Requirements", 2, "MAIN", "First bullet\n\nSecond bullet", 2), ("d", 2, "Appendix A", "Acronyms", 1, "APPENDIX", "", 0)], "document_id string, section_order int, section_number string, section_title string, heading_level int, tree_kind string, body_text string, prose_blocks long")
    tables = spark.createDataFrame([("d", 0, "3 > 3.1", "Col1 | Col2\nA | B"), ("d", 1, "", "lost"), ("d", 2, "3 > 3.1", " ")], "document_id string, table_index int, heading_path string, normalized_text string")
    got = [(r.level_1, r.level_2, r.content) for r in St.hierarchy_rows(sections, tables).orderBy("section_order", "i").collect()]
    assert got == [("3 Operations", "", "Top paragraph"), ("3 Operations", "3.1 Program Requirements", "First bullet"), ("3 Operations", "3.1 Program Requirements", "Second bullet"), ("3 Operations", "3.1 Program Requirements", "Col1 | Col2\nA | B"), ("Appendix A Acronyms", "", "")]
    docs = spark.createDataFrame([("d", "a.docx", "whole"), ("x", "b.docx", None)], "document_id string, filename string, text string")
    blocks = spark.createDataFrame([("d", 0, "heading", "3 Operations", 2), ("d", 1, "paragraph", "Top", 1)], "document_id string, document_order int, block_type string, normalized_text string, page_start int")
    placed = spark.createDataFrame([("d", "t1", 2, "table", "3.1", 0.98, "m", [["a", "b"], []]), ("d", "i1", 3, "image", None, 0.0, "unplaced", [])], "document_id string, block_id string, document_order int, object_type string, section_number string, confidence double, method string, rows array<array<string>>")
    made = St.build_artifacts(docs, sections, blocks, placed)
    a = {r.document_id: json.loads(r.artifact_json) for r in made.collect()}["d"]
    assert [s["section_number"] for s in a["hierarchy"]["sections"]] == ["3", "3.1", "Appendix A"] and a["hierarchy"]["sections"][1]["parent_number"] == "3" and a["hierarchy"]["quality"] == "strong"
    assert a["objects"]["tables"][0]["rows"] == [["a", "b"], []] and a["objects"]["images"][0]["object_id"] == "i1" and a["enrichments"]["pws"]["unplaced_object_ids"] == ["i1"]
    assert a["enrichments"]["pws"]["requirements_detected"] is True and a["provenance"]["source_pages"] == [1, 2] and a["metadata"]["page_count"] == 2 and a["blocks"][1]["kind"] == "paragraph"
    assert all(r.problems == [] for r in files.validate_artifacts(made).collect())
    rows = spark.createDataFrame([("d", 0, [["a", "b"], [], ["c", "d"]], "3.1"), ("d", 1, [[]], None), ("d", 2, [["x"]], None)], "document_id string, table_index int, rows array<array<string>>, attached_section_id string")
    whole = docs.withColumns({"project_id": F.lit("p"), "quality": F.lit("strong")})
    got = {r.chunk_index: (r.chunk_kind, r.section_path, r.section_heading, r.body_text, r.text) for r in C.artifact_chunks(whole, sections, rows).where("document_id = 'd'").collect()}
    assert got["t-0"] == ("table", "3.1", "3.1", "a | b\nc | d", "Table Content\n\na | b\nc | d") and got["t-2"][1:3] == ("DOCUMENT", "Document Body") and "t-1" not in got and "s-0-0" in got


def test_long_texts_are_cut_in_linear_time(spark):
    import time

    took = []
    for n in (20_000, 160_000):
        df = spark.createDataFrame([(" ".join(f"w{i}" for i in range(n)),)], "text string")
        C.chunk_words(df).count()
        t = time.time()
        C.chunk_words(df).agg(F.sum(F.length("chunk"))).collect()
        took.append(time.time() - t)
    assert took[1] < 8 * took[0] + 4  # quadratic work took 20 s for 80,000 words


def test_streams(spark, tmp_path):
    from bidspark.streaming import events

    rows = [("d1", "The contractor shall deliver. Fine."), ("d1", "repeat"), ("d2", "It must run.")]
    lines = [json.dumps({"event_type": "document.extracted", "document_id": d, "project_id": "p", "filename": "f", "extracted_text": t, "created_at": f"2024-01-01T00:0{i}:00Z"}) for i, (d, t) in enumerate(rows)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("\n".join([*lines, "{bad"]))
    stream = spark.readStream.text(f"{tmp_path}/in")
    sinks = events.Sinks.at(spark, f"{tmp_path}/tables", 4)
    events.stream_refresh(events.stream_document_events(stream), sinks, f"{tmp_path}/ck").awaitTermination(60)
    assert sorted((r.document_id, r.requirement_text) for r in sinks.requirements.read().collect()) in ([("d1", "The contractor shall deliver."), ("d2", "It must run.")], [("d2", "It must run.")])
    assert events.batch_document_events(spark.read.text(f"{tmp_path}/in")).count() == 2


def test_paragraphs_and_inline_tables(spark):
    text = "Table of Contents\n1.1 Scope ..... 4\nfirst line\nsecond line\n<!-- image -->\nthird\n**2.1 Duties**\nbody text 3.2 Reports are due\n\n12 Short title\r\nend"
    df = spark.createDataFrame([("d", text), ("n", None)], "document_id string, text string")
    got = [r.paragraph for r in St.iter_paragraphs(df).where("document_id = 'd'").orderBy("paragraph_index").collect()]
    assert got == ["1.1 Scope ..... 4", "first line\nsecond line", "third", "**2.1 Duties**", "body text", "3.2 Reports are due", "12 Short title", "end"]
    assert one(spark, St.markdown_tables, "intro | Name | **Size** | | --- | --- | | a | 1 | | b | 2 | | c |", "| x | y |\n|---|:-:|\n| 1 | 2 |", "no | table", None) == [[["Name", "Size"], ["a", "1"], ["b", "2"]], [["x", "y"], ["1", "2"]], [], []]


def test_retrieval_with_cells(spark, monkeypatch):
    """Small parts, so that cells, parts and skipped cells occur; null, zero and equal vectors; more asked than there is."""
    rng = np.random.default_rng(1)
    centre = rng.standard_normal((12, 8))
    x = centre[rng.integers(0, 12, 900)] + 0.1 * rng.standard_normal((900, 8))
    x[100:110] = x[100]
    rows = [("p" if i % 3 else "q", f"p{i:03}", [float(v) for v in r]) for i, r in enumerate(x)] + [("p", "null", None), ("p", "zero", [0.0] * 8), ("small", "one", [1.0] * 8)]
    index = spark.createDataFrame(rows, "project_id string, point_id string, vector array<double>").repartition(4)
    asks = [(k, pr, [float(v) for v in x[k]]) for k, pr in ((1, "p"), (2, "p"), (100, "p"), (3, "q"), (6, "small"), (7, "none"))] + [(8, "p", [0.0] * 8)]
    queries = spark.createDataFrame(asks, "query_id int, project_id string, query_vector array<double>")
    monkeypatch.setattr(C, "PART", 40)
    unit = lambda v: np.zeros(8) if v is None or not any(v) else np.array(v) / np.linalg.norm(v)
    want = {}
    for q, project, v in asks:
        s = [(-round(float(unit(w) @ unit(v)), 9) + 0.0, i) for pr, i, w in rows if pr == project]
        want[q] = [i for _, i in sorted(s)[:7]]
    got = {}
    for r in C.retrieve(index, queries, 7).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.point_id)
    assert got == {q: ids for q, ids in want.items() if ids}
    seen = {r.query_id: (r.looked_at, r.cells) for r in C.retrieval_cells(index, queries, 7).collect()}
    assert seen[1][0] < seen[1][1] and seen[8][0] == seen[8][1]


def test_cells_have_parts_by_their_own_size(spark, monkeypatch):
    """A small cell of a large project is one part, so a query is sent to it once; vectors by flat arrays equal those read one by one."""
    import pyarrow as pa

    monkeypatch.setattr(C, "PART", 20)
    rng = np.random.default_rng(1)
    rows = [("p", f"p{i:03}", [float(x) for x in rng.normal(size=4)]) for i in range(200)]
    points, _ = C._dealt(spark.createDataFrame(rows, "project_id string, point_id string, vector array<float>"), spark.createDataFrame([(1, "p", [1.0] * 4)], "query_id long, project_id string, vector array<float>"))
    cells = {}
    for r in C._cut(C.cells(points)).collect():
        cells.setdefault(r.pivot, []).append(r.part)
    assert sum(map(len, cells.values())) == 200 and len(cells) > 3
    assert all(max(parts) < -(-len(parts) // 20) for parts in cells.values())
    odd = pa.array([[3.0, 4.0], None, [1.0], [0.0, 0.0]], pa.list_(pa.float32()))
    assert C._unit(odd, 2).tolist() == [[0.6, 0.8], [0, 0], [0, 0], [0, 0]] and C._unit(odd.slice(0, 1), 2).tolist() == [[0.6, 0.8]]


def test_related_search_by_query_text(spark):
    kind = "project_id string, id string, filename string, section_number string, section_heading string, heading_path string, requirement_text string, modality string, actor string, action string, object_text string"
    rows = [("p", "r1", "pws.docx", "1.1", "Ops", "1.1 Ops", "The contractor shall operate network tools daily", "shall", "contractor", "operate", "network tools"), ("p", "r2", "pws.docx", "1.2", "Ops", "1.2 Ops", "The contractor shall monitor network tools", "shall", "contractor", "monitor", "network tools"), ("p", "r9", "Appendix A.docx", "2.3", "Storage", "2.3 Storage", "Storage arrays must be patched monthly", "must", None, None, None), ("p", "empty", "x.docx", "", "", "", "", None, None, None, None)]
    req = spark.createDataFrame(rows, kind)
    top = lambda sources: [(r.c_id, r.score, r.match_reason) for r in S.related_requirements(sources, req).orderBy("rank").collect()]
    own = top(req.where("id = 'r1'"))
    assert own[0][0] == "r2" and own[0][1] == 2 * 5 + 2 + 2 + 2 * 3 + 5 + 1
    asked = top(req.where("id = 'r1'").withColumn("query_text", F.lit("storage arrays of section 2.3 and Appendix A")))
    # two terms asked for, the section and the appendix; none of the source's own
    assert asked[0][:2] == ("r9", 2 * 4 + 14 + 10 + 5) and asked[0][2].startswith("shared terms: arrays, storage")
    assert [r[0] for r in asked] == ["r9", "r2"] and asked[1][1] == 2 * 1 + 2 + 2 + 2 * 3 + 5 + 1
    assert top(req.where("id = 'r1'").withColumn("query_text", F.lit("")))[0] == own[0]
    texts = spark.createDataFrame([("p", "patch the storage arrays", None), ("p", "network", "tools")], "project_id string, source_text string, query_text string").withColumn("id", F.col("source_text"))
    free = S.ad_hoc_sources(texts)
    got = {r.s_id: (r.c_id, r.score) for r in S.related_requirements(free, req).where("rank = 1").collect()}
    assert got == {"patch the storage arrays": ("r9", 2 * 5 + 5.0), "network": ("r1", 4 + 1 + 5.0)}
    assert {r.id for r in S.ad_hoc_sources(texts.drop("id", "query_text")).collect()} == {"ad-hoc-source"}


def test_objects_in_windows_that_cross(spark):
    """Windows of any kind against a comparison of each object with each anchor."""
    rng = np.random.default_rng(5)
    anchors = [("d", i, f"{i}", f"word{i}", int(a := rng.integers(0, 60)), None if i % 7 == 0 else int(a + rng.integers(-2, 30)), *((None, None) if i % 3 else (int(p := rng.integers(1, 6)), int(p + 1))), bool(i % 5)) for i in range(25)]
    s = spark.createDataFrame(anchors, "document_id string, section_order int, section_number string, section_title string, start_order int, end_order int, page_start int, page_end int, matched boolean")
    head = "struct<section_number:string,section_title:string>"
    objects = [("d", f"b{o}", o, None, None, int(rng.integers(1, 8)), [], []) for o in range(90)]
    df = spark.createDataFrame(objects, f"document_id string, block_id string, document_order int, explicit_heading {head}, preceding_heading {head}, page_start int, before array<string>, after array<string>")
    got = {r.block_id: (r.section_number, round(r.confidence, 2)) for r in St.align_objects(df, s, 0.6).collect()}
    for _, b, o, _, _, page, _, _ in objects:
        fits = [(-(0.8 if lo and lo <= page <= hi else 0.72), i, n) for _, i, n, _, a, e, lo, hi, m in anchors if m and a <= o and (e is None or o <= e)]
        assert got[b] == ((min(fits)[2], -min(fits)[0]) if fits else (None, 0.0))


def test_rows_of_one_long_table(spark):
    """Exploded rows drag no copy of their table along: 20,000 rows of 1 MB and more each would fit nowhere."""
    n = 20_000
    tables = spark.range(1).select(F.lit("d").alias("document_id"), F.lit("t").alias("block_id"), F.lit(None).cast("string").alias("heading_path"), F.transform(F.sequence(F.lit(0), F.lit(n)), lambda i: F.array(F.concat(F.lit("a"), i), F.concat(F.lit("b" * 20), i))).alias("rows"))
    blocks = spark.createDataFrame([], "document_id string, block_id string, block_type string, section_path string, normalized_text string")
    units = X.extraction_units(blocks, tables)
    assert units.count() == n
    assert [tuple(r) for r in units.where("row_index = 7").select("unit_id", "text_exact", "heading_path").collect()] == [("t:row:7:unit", f"a0: a7 | {'b' * 20}0: {'b' * 20}7", "DOCUMENT")]
    cells = St.table_cells(tables)
    assert cells.groupBy("row_index").count().where("count = 2").count() == n + 1
    assert [r[0] for r in cells.where("row_index = 7").orderBy("col_index").select("header_text").collect()] == ["a0", "b" * 20 + "0"]


def test_candidates_stay_with_their_unit(spark):
    """The rule's rows need no shuffle, and are numbered among those that it takes."""
    units = spark.createDataFrame([("u1", "paragraph", "It is so. The Contractor shall submit a report. Fine. You must go."), ("u2", "note", "Nothing here."), ("u3", "list_item", "They shall act. Then rest."), ("u4", "table_row", "a: b")], "unit_id string, unit_type string, text_exact string").selectExpr("*", "'d' document_id", "'h' heading_path", "'b' source_block_id", "cast(null as string) table_id", "cast(null as int) row_index")
    got = X.requirement_candidates(units)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(tuple(r) for r in got.select("candidate_id", "requirement_text", "modality", "confidence", "review_flag").collect()) == [
        ("u1:requirement:0", "The Contractor shall submit a report.", "shall", 0.72, False), ("u1:requirement:1", "You must go.", "must", 0.72, False), ("u2:requirement:0", "Nothing here.", "informational", 0.55, True), ("u3:requirement:0", "They shall act. Then rest.", "shall", 0.72, False), ("u4:requirement:0", "a: b", "informational", 0.65, True),
    ]
    deliverables = X.deliverable_candidates(units)
    assert [tuple(r) for r in deliverables.select("deliverable_id", "deliverable_text").collect()] == [("u1:deliverable:0", "The Contractor shall submit a report.")]


def test_words_looked_for_first_miss_nothing(spark):
    """What a pattern finds is found, in capitals, after other words and in letters that fold to ASCII ones."""
    assert one(spark, T.classify_export_keyword, "it SHALL be", "ſhall we", "marshall it", "You were Required to", "deliverables", "delivery now", None) == ["shall", "shall", None, "required", None, "deliver", None]
    assert one(spark, T.is_tasking, "we TRACK it", "Keep tracK of it", "racket", None) == [True, True, False, None]


def test_long_tables_are_drawn_and_read_in_one_pass(spark):
    """Work by row must not look through the whole table: 20,000 rows would take minutes."""
    import time

    n = 20_000
    t = spark.range(1).select(F.transform(F.sequence(F.lit(0), F.lit(n)), lambda i: F.array(*[F.concat(F.lit(c), i) for c in "abcd"])).alias("rows"))
    began = time.time()
    md = t.select("rows", St.render_markdown_table(F.col("rows")).alias("md"))
    ok = md.select((St.markdown_tables(F.col("md")) == F.col("rows")) & (St.markdown_tables(F.concat(F.lit("See "), F.replace("md", F.lit("\n"), F.lit(" ")))) == F.col("rows"))).collect()
    assert ok[0][0] is not None and time.time() - began < 60


def test_best_snippets_keep_order_and_copies(spark):
    """Equal snippets count as often as they are given; ties go by place and text; without a shared word one is left."""
    p = spark.createDataFrame([("x", "p1", "See section 1.3: alpha beta gamma"), ("x", "p2", "Section 1.3 omega")], "project_id string, paragraph_id string, text string")
    s = spark.createDataFrame([("x", "Base IDIQ PWS.docx", "1.3", "t", ["alpha beta", "zeta"]), ("x", "Base IDIQ PWS.docx", "1.3", "t", ["alpha beta", "gamma"]), ("x", "Base IDIQ PWS.docx", "2.1", "t", ["alpha beta gamma"])], "project_id string, filename string, section_number string, section_title string, snippets array<string>")
    got = S.governing_section_links(p, s)
    assert sorted((r.paragraph_id, r.supporting) for r in got.collect()) == [("p1", ["alpha beta", "alpha beta", "gamma"]), ("p2", ["alpha beta"])]
    assert "s_asked" not in S._prepared(p.selectExpr("*", "paragraph_id id", "text requirement_text", *[f"'' {c}" for c in S.FIELDS if c != "requirement_text"]), "s_").columns


def test_common_counts_frequent_and_rare_elements():
    import pyarrow as pa

    rng = np.random.default_rng(5)
    sets = [[set((rng.zipf(1.3, 40) % 5000).tolist()) for _ in range(k)] for k in (70, 300)]
    a, b = (pa.array([sorted(x) for x in side], pa.list_(pa.int64())) for side in sets)
    assert (S._common(a, b) == np.array([[len(x & y) for y in sets[1]] for x in sets[0]])).all()
    assert S._common(a, pa.array([[], None, [-1]], pa.list_(pa.int64()))).sum() == 0


def test_entities_in_sql_follow_the_same_rule():
    """Old names without a semicolon, longest names, numbers in both bases and odd ones."""
    import html

    import duckdb

    from bidspark.plans.queries import _entities_sql

    cases = ["a &amp b", "&amp;lt;", "&notit; &notin; &no", "&#65;&#x41;&#0;&#128;&#xD800;&#99999999999;&#1;&#38", "x&", "&&amp;", "&copy2026 &quo", "&ampamp;", "&#x1F600;é&eacute", "", "&#;&#x;&;"]
    sql = _entities_sql("t")
    assert [duckdb.execute(f"SELECT {sql} FROM (SELECT ? AS t)", [x]).fetchone()[0] for x in cases] == [html.unescape(x) for x in cases]


def test_companion_text_in_sql_knows_other_letters(spark):
    import duckdb

    from bidspark.plans.queries import _COMPANION

    cases = ["a Table 3é x", "ÉAB CD EF GH z", "AB CD EF GHé z", "a\x0bb c", "AB\x0bCD EF GH IJ", "éTable 3 x", "AB CD EF GH IJk", "Table 1 Figure 2 |\x0b| ü"]
    assert [duckdb.execute(f"SELECT {_COMPANION} FROM (SELECT ? AS text)", [x]).fetchone()[0] for x in cases] == one(spark, T.clean_companion_text, *cases)
