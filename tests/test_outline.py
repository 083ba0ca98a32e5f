import random
import re

from pyspark.sql import functions as F

from bidspark.operators import cleanup as Cl
from bidspark.operators import outline as O
from bidspark.operators import structure as St


def clean(spark, raw):
    df = Cl.prepare_outline_lines(spark.createDataFrame([("d", raw)], "document_id string, raw_text string"))
    return df.first().lines


def nodes(spark, md):
    df = O.outline_nodes(spark.createDataFrame([("d", md)], "document_id string, markdown string"))
    return df.orderBy("position").collect()


def test_contents_lists_and_leaders_go(spark):
    got = clean(spark, "(Unclassified//FOUO)\nTable of Contents\nOverview .......... 9\n3 Requirements ....... 15\n\n1 (U) Overview\n(U) Intro paragraph.\n\n1.1 (U) Purpose\n(U) Purpose text.\n")
    assert got == ["# 1 Overview", "", "Intro paragraph.", "", "## 1.1 Purpose", "", "Purpose text."]


def test_missing_parents_come_from_titles(spark):
    got = clean(spark, "3.1 (U) Program Management\n(U) Program Management\n(U) The Contractor Shall:\n3.1.1.1 (U) Manage the scope.\n\n(U) Corporate Commitment\n(U) The Contractor Shall:\n3.1.2.1 (U) Communicate.\n")
    assert "### 3.1.1 Program Management" in got and "### 3.1.2 Corporate Commitment" in got
    assert "#### 3.1.1.1 Manage the scope." in got and not any("Contractor Shall" in x for x in got)


def test_headings_come_from_an_untitled_contents_list(spark):
    toc = "1 Purpose3\n2 Scope3\n3 Performance Objectives3\n3.1 Operation and Sustainment3\n\n"
    inline = clean(spark, toc + "Purpose This order defines the work.\nScope Provide it.\nPerformance Objectives The Contractor must act.\nOperation and Sustainment The Contractor must operate.\n")
    for h in ("# 1 Purpose", "# 2 Scope", "# 3 Performance Objectives", "## 3.1 Operation and Sustainment", "This order defines the work."):
        assert h in inline
    alone = clean(spark, toc + "Purpose\nThis order defines the work.\nScope\nProvide it.\n")
    assert "# 1 Purpose" in alone and "# 2 Scope" in alone


def test_strong_hierarchies_stay(spark):
    got = clean(spark, "1.1 (U) Purpose\n(U) Text.\n1.2 (U) Background\n(U) More.\n2 (U) Applicable Documents\n(U) Docs.\n3 (U) Requirements\n3.1 (U) Management\n(U) End.\n")
    assert [x for x in got if x.startswith("#")] == ["## 1.1 Purpose", "## 1.2 Background", "# 2 Applicable Documents", "# 3 Requirements", "## 3.1 Management"]


def test_bullets_keep_their_indent(spark):
    got = clean(spark, "3.2.2.7 (U) Attend meetings\n- (U) Weekly\n  - Present items\n")
    assert "- Weekly" in got and "  - Present items" in got
    assert clean(spark, None) == [] and clean(spark, "") == []


def test_bullets_hang_on_the_paragraph_before(spark):
    got = nodes(spark, "## 3.1 Operation\n\nFirst.\n\nSecond:\n\n- one\n- two\n  - deep\n\n### 3.1.1 Map\n\nChild.\n")
    assert [(n.node_id, n.parent_id) for n in got] == [("3.1", None), ("3.1.p1", "3.1"), ("3.1.p2", "3.1"), ("3.1.p2.b1", "3.1.p2"), ("3.1.p2.b2", "3.1.p2"), ("3.1.p2.b3", "3.1.p2.b2"), ("3.1.1", "3.1"), ("3.1.1.p1", "3.1.1")]


def test_inline_items_and_acronyms(spark):
    got = nodes(spark, "# 3 X\n\nIntro text: 1. First item. 2. Second item. 3. Third item.\n\nThe Iron 2.0 (IH2) helps the Trans 2.0 (T2) system.\n")
    assert got[1].text == "Intro text:" and [(n.marker, n.text) for n in got[2:5]] == [("1.", "First item."), ("2.", "Second item."), ("3.", "Third item.")]
    assert "(IH2)" in got[5].text and len(got) == 6


def test_numbers_without_marks_and_documents_without_headings(spark):
    assert [n.node_id for n in nodes(spark, "1 Overview\n\nPara.\n\n1.1 Purpose\n\nChild.\n") if n.node_type == "section"] == ["1", "1.1"]
    assert [n.section_number for n in nodes(spark, "**L.4 Delivery**\n\nPara.\n\n## L.10.1 Volume\n") if n.node_type == "section"] == ["L.4", "L.10.1"]
    assert [n.node_id for n in nodes(spark, "Just text.\n\n- item")] == ["DOC", "DOC.p1", "DOC.p1.b1"]
    assert nodes(spark, None) == []


def test_contents_sections_shift_the_numbers(spark):
    md = "## 1 Table of Contents\n\nS.\n\n## 2 Figures\n\nS.\n\n## 3 Purpose\n\nP.\n\n## 4 Scope\n\nP.\n\n## 6 Objectives\n\nP.\n\n### 6.1 Tasks\n\nP.\n"
    df = O.outline_nodes(spark.createDataFrame([("d", md)], "document_id string, markdown string"))
    got = St.normalize_numbering(df.where("node_type = 'section'")).orderBy("position").collect()
    assert [(n.section_number, n.section_title) for n in got] == [("1", "Purpose"), ("2", "Scope"), ("4", "Objectives"), ("4.1", "Tasks")]
    assert {r.node_type: r.n for r in St.outline_stats(df).collect()} == {"section": 6, "paragraph": 6}


def test_titles_inside_lines(spark):
    toc = "1 Purpose3\n2 Scope3\n3 Performance Objectives3\n3.1 Operation and Sustainment3\n3.1.1 Map Stack5\n\n"
    got = clean(spark, toc + "(a) Purpose This order defines the work.\nScope Provide it.\nIn all that follows below the Scope is meant.\nOperation and Sustainment The Contractor must operate.\nMap Stack The Contractor must sustain it.\n")
    for h in ("# 1 Purpose", "This order defines the work.", "# 2 Scope", "## 3.1 Operation and Sustainment", "### 3.1.1 Map Stack"):
        assert h in got
    assert any("below the Scope is meant" in x for x in got)  # too far from the start
    two = clean(spark, "1 Terms7\n2 Scope8\n\nScope Text here.\nsee Appendix A and Appendix B for more than this, Terms apply to all\n")
    assert "# 1 Terms" in two and "apply to all" in two


def test_titles_above_generic_requirements(spark):
    got = clean(spark, "3 Work\nText of it.\n3.1 Tasks\nMore text.\n4 Other\nText.\nService Delivery\nThe following requirements apply to it.\nThe Contractor Shall:\n3.3.1.1 Recognize the lead.\n3.3.1.2 Coordinate.\n")
    assert "### 3.3.1 Service Delivery" in got and not any("following requirements" in x for x in got) and "#### 3.3.1.2 Coordinate." in got
    alone = clean(spark, "3.3.1.19 Create reports.\n- Highlight deliveries with justifications\nChange Management\nThe Contractor Shall:\n3.3.2.1 Utilize the process.\n")
    assert "### 3.3.2 Change Management" in alone and "#### 3.3.2.1 Utilize the process." in alone
    late = clean(spark, "Non-Key Personnel\nThe Contractor Shall:\n3.1.15.1 Adhere to categories.\n1 (U) Overview\n1.1 (U) Purpose\nPurpose text.\n")
    assert late[0] == "# 1 Overview"


def plainly(line, titles):
    """The rule for titles inside a line, title by title."""
    longest = sorted(titles, key=len, reverse=True)
    for t in longest:
        m = re.search(rf"(?<![A-Za-z0-9]){re.escape(t)}\s+", line)
        if m and m.start() <= 24:
            return m.start(), t, titles[t]
    if line.count("Appendix ") >= 2:
        for t in longest:
            m = re.search(rf"(?<![A-Za-z0-9]){re.escape(t)}\s+", line)
            if m and "." not in titles[t]:
                return m.start(), t, titles[t]
    return None


def test_the_automaton_finds_what_a_search_for_each_title_finds():
    rng = random.Random(2)
    words = ["Map", "Map Stack", "Stack", "a", "Scope", "Scope of", "Work", "Appendix", "Appendix A", "x.y", "(b)", "ö"]
    for _ in range(300):
        titles = {" ".join(rng.choices(words, k=rng.randint(1, 3))): rng.choice(["1", "2", "3.1"]) for _ in range(rng.randint(0, 8))}
        lines = [Cl.heading(n, t) for t, n in titles.items()]
        known = Cl.Titles(lines)
        for _ in range(20):
            line = rng.choice(["", "z", "(", "see "]) + " ".join(rng.choices([*words, "zz", "Appendix B"], k=rng.randint(1, 9)))
            assert known.inside(line) == plainly(line, titles), (line, titles)


def test_long_documents_are_cleaned_in_linear_time():
    import time

    took = []
    for n in (4_000, 32_000):
        raw = [f"{i % 40 + 1} Title{i % 500}9" if i < n // 8 else f"Title{i % 700} Some words that follow here" for i in range(n)]
        t = time.time()
        Cl.prepared(raw)
        took.append(time.time() - t)
    assert took[1] < 16 * took[0] + 2


def test_outline_lines(spark):
    got = nodes(spark, "## 3 Objectives\n\n48\n49 The contractor shall provide support.\n50 The contractor shall maintain records.\n")
    assert got[1].text == "The contractor shall provide support. The contractor shall maintain records."
    assert [n.text for n in nodes(spark, "# 1 Overview\n\nimage23.png\n\n<!-- image -->\nActual paragraph.\n")][1:] == ["Actual paragraph."]
    got = nodes(spark, "#### 3.3.1.5 Provide it.\n\n- one\n▪ The Government will evaluate.\n")
    assert [(n.node_id, n.level) for n in got] == [("3.3.1.5", 1), ("3.3.1.5.p1", 2), ("3.3.1.5.p1.b1", 3), ("3.3.1.5.p1.b2", 3)]
    assert [n.node_type for n in nodes(spark, "# 1 A\n\nText (a) one (ABC) two.\n")] == ["section", "paragraph"]
    assert [n.marker for n in nodes(spark, "# 1 A\n\n(a) one (iv) two (U) text\n") if n.node_type == "bullet"] == ["(a)"]
    assert nodes(spark, "1 Overview ..... 4\n\nThe 2 systems.\n")[0].node_id == "DOC"


def test_tables_and_text_of_nodes(spark):
    md = "**L.8 Volumes**\n\n| **Volume** | **Title** | **Page Limit** | **Contents & Format** |\n|---|---|---|---|\n| **1** | **Offer** | x | Word File. |\n| Appendix 1-A | Cover | 2 | PDF |\n"
    n = O.outline_nodes(spark.createDataFrame([("d", md)], "document_id string, markdown string"))
    got = St.structured_content(n).collect()
    assert len(got) == 1 and got[0].block_type == "table" and got[0].rows == [["Volume", "Title", "Page Limit", "Contents & Format"], ["1", "Offer", "x", "Word File."], ["Appendix 1-A", "Cover", "2", "PDF"]]
    pressed = "| **Volume** | **Title** | |---|---| | **1** | Technical / Management | | **2** | Cost |"
    texts = [pressed, "See " + pressed + "\n" + pressed + "\nlast\n" + pressed, "a | b\n|-|-|\n|x|y|\n|-|-|\n`z`\n\nq | r\ns", None, " \n"]
    df = spark.createDataFrame([("d", str(i), t) for i, t in enumerate(texts)], "document_id string, node_id string, content string")
    out = {}
    for r in St.structured_content(df).orderBy("node_id", "block_index").collect():
        out.setdefault(r.node_id, []).append(r.rows if r.block_type == "table" else r.text)
    rows = [["Volume", "Title"], ["1", "Technical / Management"], ["2", "Cost"]]
    assert out == {"0": [rows], "1": ["See", rows, rows, "last\n" + pressed.replace("*", "")], "2": [[["a", "b"], ["x", "y"], ["-", "-"]], "z", "q | r\ns"]}


def test_lines_of_many_cells(spark):
    big = "|".join(["", "h1", "h2", " ", "---", "---", " ", *(f"c{i}" for i in range(100_000)), ""])
    long = "1" + ".1" * 20_000 + " x"
    df = spark.createDataFrame([(big,), ("|" * 50_000,), (long,)], "t string")
    assert [r[0] for r in df.select(F.size(St.markdown_tables(F.col("t")))).collect()][0] == 50_001
    kinds = St.classify_blocks(df.select(F.col("t").alias("normalized_text"))).collect()
    assert len(kinds) == 3


def test_trees_of_any_depth(spark):
    chain = spark.createDataFrame([("d", f"n{i}", f"n{i - 1}" if i else None, i, i + 1) for i in range(40)], "document_id string, node_id string, parent_id string, position int, depth int")
    got = {(r.root, r.node_id): r.distance for r in St.descendants(chain).collect()}
    assert got == {(f"n{i}", f"n{j}"): j - i for i in range(40) for j in range(i + 1, 40)}
    rng = random.Random(1)
    rows, stack = [], []
    for i in range(300):  # random trees, some of whose nodes name a parent that is missing
        depth = rng.randint(1, min(len(stack) + 1, 9))
        stack = stack[: depth - 1]
        parent = stack[-1] if stack else None
        rows.append(("d", f"n{i}", f"gone{i % 3}" if rng.random() < 0.1 else parent, i, depth))
        stack.append(f"n{i}")
    parent = {r[1]: r[2] for r in rows}
    want = set()
    for n in parent:
        k, p = 1, parent[n]
        while p is not None:
            want.add((p, n, k))
            k, p = k + 1, parent.get(p)
    df = spark.createDataFrame(rows, "document_id string, node_id string, parent_id string, position int, depth int").repartition(5)
    assert {(r.root, r.node_id, r.distance) for r in St.descendants(df).collect()} == want


def test_headings_of_any_level(spark):
    rng = random.Random(3)
    rows = [("d", i, rng.choice([1, 2, 3, 5, 11, 12, 13, 14, 20, 31]), f"n{i}", f"t{i}", rng.choice(["MAIN"] * 9 + ["APPENDIX"])) for i in range(200)]
    stack, want = [], []
    for _, i, level, n, _, tree in rows:
        stack = [] if tree != "MAIN" else [x for x in stack if x[0] < level]
        stack.append((level, n))
        want.append(" > ".join(x[1] for x in stack))
    df = spark.createDataFrame(rows, "document_id string, document_order int, heading_level int, numbering_token string, heading_title string, tree_kind string").repartition(3)
    assert [r.heading_path for r in St.heading_paths(df).orderBy("document_order").collect()] == want


def test_scope_is_the_machine_block_by_block(spark):
    rng = random.Random(4)
    kinds = {"toc": ("heading", "Table of Contents", None), "entry": ("paragraph", "1.1 Scope 4", None), "listed": ("heading", "1.2 Tasks 9", "1.2"), "head": ("heading", "1.0 Scope", "1.0"), "bold": ("heading", "Scope", None), "cover": ("heading", "Performance Work Statement (PWS)", None), "date": ("heading", "March 3, 2024", "3"), "app": ("appendix_heading", "Terms", "APPENDIX A"), "text": ("paragraph", "text", None), "item": ("list_item", "item", None), "foot": ("footer_or_header", "x", None), "table": ("table", "t", None)}
    rows, want = [], []
    for d in range(60):
        toc = body = False
        for o in range(25):
            k = rng.choice(list(kinds))
            kind, text, number = kinds[k]
            rows.append((f"d{d}", o, kind, text, None, number))
            head = kind in St.HEADINGS
            if k == "foot" or not body and k in ("cover", "date"):
                say = "front_matter"
            elif k == "toc":
                say, toc = "table_of_contents", True
            elif toc and (k in ("entry", "listed") or kind in ("paragraph", "list_item")):
                say = "table_of_contents"
            else:
                if toc and kind == "heading" and number:
                    toc, body = False, True
                body = body or head
                say = "body" if body else "front_matter"
            want.append(say)
    df = spark.createDataFrame(rows, "document_id string, document_order int, block_type string, normalized_text string, heading_title string, numbering_token string")
    got = {(r.document_id, r.document_order): r.content_scope for r in St.tag_content_scope(df.repartition(4)).collect()}
    assert [got[r[0], r[1]] for r in rows] == want
    signal = {r.document_id: r.toc_signal_score for r in St.contents_signal(St.tag_content_scope(df)).collect()}
    assert sum(signal.values()) == want.count("table_of_contents")


def test_long_documents_are_scoped_in_linear_time(spark):
    import time

    took = []
    for n in (20_000, 160_000):
        df = spark.range(n).select(F.lit("d").alias("document_id"), F.col("id").alias("document_order"), F.lit("paragraph").alias("block_type"), F.lit("some text").alias("normalized_text"), F.lit(None).cast("string").alias("heading_title"), F.lit(None).cast("string").alias("numbering_token"))
        t = time.time()
        assert St.tag_content_scope(df).groupBy("content_scope").count().collect()[0]["count"] == n
        took.append(time.time() - t)
    assert took[1] < 16 * took[0] + 4
