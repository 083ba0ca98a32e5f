"""Blocks, headings, hierarchy, tables and outline nodes; order is always an explicit column."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bidspark.functions import lexicons as L
from bidspark.functions import text as T
from bidspark.functions.arrow import bounded
from bidspark.sources.tables import staged

MAX_LEVEL = 12
HEADINGS = ("heading", "appendix_heading", "attachment_heading")

BLOCK = "block_type string, heading_level int, numbering_token string, heading_title string, tree_kind string, list_level int, list_body string, confidence double"


def _block(kind: Column | str, conf: float, level: Column | int | None = None, token: Column | None = None, title: Column | None = None, tree: Column | None = None, depth: Column | None = None, body: Column | None = None) -> Column:
    none = lambda t: F.lit(None).cast(t)
    level = none("int") if level is None else (F.lit(level) if isinstance(level, int) else level)
    return F.struct(
        (F.lit(kind) if isinstance(kind, str) else kind).alias("block_type"), level.cast("int").alias("heading_level"), (none("string") if token is None else token).alias("numbering_token"), (none("string") if title is None else title).alias("heading_title"), (none("string") if tree is None else tree).alias("tree_kind"), (none("int") if depth is None else depth).cast("int").alias("list_level"), (none("string") if body is None else body).alias("list_body"), F.lit(conf).alias("confidence")
    )


def classify_blocks(blocks: DataFrame, text: str = "normalized_text") -> DataFrame:
    """Type, level, token, title and confidence of each text block; optional columns label and bold are hints."""
    c = T.blank_if_null(text)
    label = F.lower(T.blank_if_null("label")) if "label" in blocks.columns else F.lit("text")
    bold = F.coalesce(F.col("bold"), F.lit(False)) if "bold" in blocks.columns else F.lit(False)
    h = F.col("__heading")
    group = lambda p, k, s=h: F.regexp_extract(s, p, k)
    noise = (F.length(h) <= 1) | h.rlike(L.DATE_ONLY) | F.upper(h).rlike(r"^\(?[A-Z/]{1,12}\)?$")
    kind, number = F.upper(group(L.APPENDIX_HEADING, 1)), group(L.APPENDIX_HEADING, 2)
    named = lambda title, other: F.when(title == "", other).otherwise(title)
    main = F.lit("MAIN")
    composite, paren, alpha, bullet = r"^(\d+(?:\.\d+)++)((?:\([A-Za-z0-9]+\))++)\s+(.+)$", r"^((?:\([A-Za-z0-9]+\))++)\s+(.+)$", r"^([A-Za-z]\.)\s+(.+)$", r"^([-*•])\s+(.+)$"
    parens = lambda s: F.length(s) - F.length(F.replace(s, F.lit("("), F.lit("")))
    caps = T.is_upper_heading(h, 120)
    chain = F.when(c.rlike(r"^(?i)\s*page\s+\d+\s*$"), _block("page_break", 0.99)).when(noise, _block("footer_or_header", 0.99))
    chain = chain.when(h.rlike(L.APPENDIX_HEADING), _block(F.when(kind == "APPENDIX", "appendix_heading").otherwise("attachment_heading"), 0.99, 1, F.concat(kind, F.lit(" "), number), named(T.strip(group(L.APPENDIX_HEADING, 3)), F.concat(F.initcap(kind), F.lit(" "), number)), kind))
    section = F.concat(F.lit("SECTION "), group(L.SECTION_HEADING, 2))
    chain = chain.when(h.rlike(L.SECTION_HEADING), _block("heading", 0.98, 1, section, named(T.strip(group(L.SECTION_HEADING, 3)), section), main))
    decimal = group(L.DECIMAL_HEADING, 1)
    chain = chain.when(h.rlike(L.DECIMAL_HEADING), _block("heading", 0.97, T.decimal_heading_level(decimal), decimal, T.strip(group(L.DECIMAL_HEADING, 2)), main))
    chain = chain.when(h.rlike(L.NUMBER_HEADING) & label.isin("section_header", "text"), _block("heading", 0.95, 1, group(L.NUMBER_HEADING, 1), T.strip(group(L.NUMBER_HEADING, 2)), main))
    chain = chain.when(c.rlike(composite), _block("list_item", 0.94, None, F.concat(group(composite, 1, c), group(composite, 2, c)), None, None, parens(group(composite, 2, c)), T.strip(group(composite, 3, c))))
    for pattern, conf, depth in ((paren, 0.93, parens(group(paren, 1, c))), (alpha, 0.86, F.lit(1)), (bullet, 0.82, F.lit(1))):
        chain = chain.when(c.rlike(pattern), _block("list_item", conf, None, group(pattern, 1, c), None, None, depth, T.strip(group(pattern, 2, c))))
    chain = chain.when(F.upper(c).startswith("NOTE:"), _block("note", 0.9))
    chain = chain.when(bold & (F.size(F.split(h, r"\s+")) <= 14), _block("heading", 0.72, 2, h, h, main))
    chain = chain.when(caps, _block("heading", 0.68, 2, h, F.initcap(F.lower(h)), main)).otherwise(_block("paragraph", 0.7))
    rest = [x for x in blocks.columns if x not in ("block_type", "heading_level", "numbering_token", "heading_title", "tree_kind", "list_level", "list_body", "confidence")]
    return blocks.select(*rest).withColumn("__heading", T.normalize_heading_candidate(c)).withColumn("__b", chain).select(*rest, "__b.*")


def tag_content_scope(blocks: DataFrame, order: str = "document_order") -> DataFrame:
    """Adds content_scope: front_matter, table_of_contents or body.

    A document's blocks drive two flags, inside a contents list and body begun. Each block is a map of the flags to the flags,
    and such maps compose without the blocks before: `body begun` only ever goes up, so it is a running maximum; of the contents
    flag a block is the identity or sets or clears it whatever it was, so its state is the last block that isn't the identity.
    Both are windows over a document's order.
    """
    title = F.when(F.col("block_type").isin(*HEADINGS), T.normalize_heading_candidate(F.coalesce("heading_title", "normalized_text"))).otherwise("")
    entry = F.col("block_type").isin("heading", "list_item", "paragraph") & T.strip_classification(T.normalize_inline(F.col("normalized_text"))).rlike(L.TOC_ENTRY)
    by = Window.partitionBy("document_id").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c: F.coalesce(F.max(c).over(by), F.lit(False))
    head = F.col("block_type").isin(*HEADINGS)
    marks = {
        "__toc": title.rlike(L.TOC_TITLE), "__front": head & (title.isin("Performance Work Statement (PWS)") | title.rlike(L.DATE_ONLY)), "__entry": F.coalesce(entry, F.lit(False)), "__head": head,
        "__numbered": (F.col("block_type") == "heading") & F.col("numbering_token").isNotNull(), "__prose": F.col("block_type").isin("paragraph", "list_item"), "__foot": F.col("block_type") == "footer_or_header",
    }
    rows = blocks.withColumns(marks)
    # before the body a contents list, once open, stays open; a heading that is none of its entries begins the body
    begins = F.expr("__head and not __front and not __toc") & ~(F.col("__listed") & F.col("__entry"))
    rows = rows.withColumn("__listed", before(F.expr("__toc"))).withColumn("__begins", begins).withColumn("__body", before(F.col("__begins")))
    rows = rows.withColumn("__cover", F.expr("__front and not __body and not __foot"))
    sets = F.expr("case when __foot or __cover then null when __toc then true when __numbered and not __entry then false end")
    rows = rows.withColumn("__in", F.coalesce(F.last(sets, ignorenulls=True).over(by), F.lit(False)))
    say = F.expr("""case when __foot or __cover then 'front_matter' when __toc or (__in and (__entry or (__prose and not __numbered))) then 'table_of_contents'
        when __body or __head or (__in and __numbered) then 'body' else 'front_matter' end""")
    return rows.withColumn("content_scope", say).drop(*marks, "__listed", "__begins", "__body", "__cover", "__in")


def contents_lists(scoped: DataFrame, order: str = "document_order") -> DataFrame:
    """(document_id, list_index, start_order, end_order, entries): runs of blocks that `tag_content_scope` put into contents lists."""
    by = Window.partitionBy("document_id").orderBy(order)
    listed = F.col("content_scope") == "table_of_contents"
    rows = scoped.select("document_id", order, listed.alias("__listed")).withColumn("__new", F.col("__listed") & ~F.coalesce(F.lag("__listed").over(by), F.lit(False)))
    rows = rows.withColumn("list_index", F.sum(F.col("__new").cast("int")).over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - 1).where("__listed")
    return rows.groupBy("document_id", F.col("list_index").cast("int").alias("list_index")).agg(F.min(order).alias("start_order"), F.max(order).alias("end_order"), F.count("*").alias("entries"))


def contents_signal(scoped: DataFrame) -> DataFrame:
    """(document_id, toc_signal_score): how many blocks a document's contents lists hold, which `select_parse_mode` weighs against its body."""
    return contents_lists(scoped).groupBy("document_id").agg(F.sum("entries").alias("toc_signal_score"))


def heading_paths(headings: DataFrame, order: str = "document_order", level: str = "heading_level", token: str = "numbering_token", title: str = "heading_title", tree: str | None = "tree_kind", max_level: int = MAX_LEVEL) -> DataFrame:
    """Adds heading_path, title_path and parent_order: the stack of enclosing headings, as `_stacked` finds it."""
    rows = _stacked(headings, order, level, token, title, tree, max_level)
    join = lambda f: F.array_join(F.transform("__stack", lambda x: x[f]), " > ")
    return rows.withColumns({"heading_path": join("n"), "title_path": join("t"), "parent_order": _parent("o")}).drop("__stack")


def _parent(field: str) -> Column:
    """A field of the heading above, null at the top."""
    return F.when(F.size("__stack") > 1, F.element_at("__stack", -2)[field])


def _stacked(headings: DataFrame, order: str, level: str, token: str, title: str, tree: str | None, max_level: int = MAX_LEVEL) -> DataFrame:
    """Adds __stack: order (o), token (n), title (t) and level (k) of the enclosing headings and the heading itself, as running maxima
    per level.

    A level is on the stack if its last heading came after the last headings of all higher ranks of the stack; a
    heading of another tree than MAIN clears it. Levels from 0 to max_level are running maxima; deeper ones, which are
    rare, are gathered from the last heading at one of these on.
    """
    by = Window.partitionBy("document_id").orderBy(order)
    run = by.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reset = F.lit(0) if tree is None else F.sum(F.when(F.coalesce(F.col(tree), F.lit("MAIN")) != "MAIN", 1).otherwise(0)).over(run)
    rows = headings.withColumn("__epoch", reset)
    per = Window.partitionBy("document_id", "__epoch").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lv = F.coalesce(F.col(level), F.lit(1))
    last = F.array(*[F.max(F.when(lv == k, F.struct(F.col(order).alias("o"), F.col(token).alias("n"), F.col(title).alias("t"), F.lit(k).alias("k")))).over(per) for k in range(max_level + 1)])
    shallow = F.sum((lv <= max_level).cast("int")).over(per)
    rows = rows.withColumn("__run", shallow)
    deep = F.collect_list(F.when(lv > max_level, F.struct(F.col(order).alias("o"), F.col(token).alias("n"), F.col(title).alias("t"), lv.alias("k")))).over(Window.partitionBy("document_id", "__epoch", "__run").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = rows.withColumn("__deep", deep).withColumn("__last", F.concat(F.filter(last, lambda x: x.isNotNull() & (x["k"] <= lv)), F.filter("__deep", lambda x: x["k"] <= lv)))
    # of the enclosing headings each is later than all of lower rank number before it in the stack
    on = F.filter("__last", lambda x: ~F.exists("__last", lambda y: (y["k"] <= x["k"]) & (y["o"] > x["o"])))
    return rows.withColumn("__stack", on).drop("__epoch", "__run", "__deep", "__last")


def assemble_sections(blocks: DataFrame, order: str = "document_order") -> DataFrame:
    """A row per heading with the prose up to the next heading; prose before the first has a null section_order."""
    by = Window.partitionBy("document_id").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    is_head = F.col("block_type").isin(*HEADINGS)
    rows = blocks.withColumn("section_order", F.max(F.when(is_head, F.col(order))).over(by))
    prose = F.when(~is_head & F.col("block_type").isin("paragraph", "list_item", "note", "table"), F.struct(order, F.col("normalized_text").alias("x")))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(prose)), lambda s: s["x"]), "\n\n")
    head = F.max(F.when(is_head, F.struct("numbering_token", "heading_title", "heading_level", "tree_kind")))
    out = rows.groupBy("document_id", "section_order").agg(head.alias("h"), body.alias("body_text"), F.count(prose).alias("prose_blocks"))
    return out.select("document_id", "section_order", F.col("h.numbering_token").alias("section_number"), F.col("h.heading_title").alias("section_title"), "h.heading_level", "h.tree_kind", "body_text", "prose_blocks")


def orphan_reviews(sections: DataFrame) -> DataFrame:
    return sections.where("section_order is null and body_text <> ''").select("document_id", F.lit("unassigned_content").alias("reason"), F.col("body_text").alias("raw_text"))


def heading_gaps(sections: DataFrame, order: str = "section_order", number: str = "section_number") -> DataFrame:
    """Headings whose last part jumps by more than one from the heading before, of the same parent."""
    by = Window.partitionBy("document_id").orderBy(order)
    rows = sections.where(F.col(number).isNotNull()).withColumn("previous", F.lag(number).over(by))
    prefix = lambda c: F.regexp_extract(c, r"^(.*)\.[^.]*$", 1)
    tail = lambda c: F.regexp_extract(c, r"\.(\d{1,9})$", 1).try_cast("int")
    dotted = F.col("previous").contains(".") & F.col(number).contains(".")
    return rows.where(dotted & (prefix("previous") == prefix(number)) & (tail(number) > tail("previous") + 1)).select("document_id", order, "previous", number)


def structure_metrics(sections: DataFrame, total_chars: DataFrame, signal: DataFrame | None = None) -> DataFrame:
    """Per document: sections, prose blocks, empty sections, coverage ratio, orphans, contents and body signal.

    total_chars: (document_id, chars) of the source text, whose documents all get a row; signal: what `contents_signal` gives for its blocks (none: 0).
    """
    named = F.col("section_order").isNotNull()
    sums = sections.groupBy("document_id").agg(
        F.sum(named.cast("int")).alias("section_count"), F.sum(F.when(named, F.col("prose_blocks")).otherwise(0)).alias("prose_block_count"), F.sum((named & (F.col("prose_blocks") == 0)).cast("int")).alias("suspicious_empty_section_count"), F.sum(F.when(named, F.length("body_text")).otherwise(0)).alias("chars_in"), F.sum(F.when(~named, F.col("prose_blocks")).otherwise(0)).alias("orphan_content_count"), F.sum((named & (F.col("prose_blocks") > 0)).cast("int")).alias("filled")
    )
    ratio = F.when(F.col("chars") > 0, F.bround(F.col("chars_in") / F.col("chars"), 4)).otherwise(0.0)
    out = total_chars.join(sums, "document_id", "left").na.fill(0, [c for c in sums.columns if c != "document_id"])
    out = out.withColumn("toc_signal_score", F.lit(0).cast("long")) if signal is None else out.join(signal, "document_id", "left").na.fill(0, ["toc_signal_score"])
    return out.select("document_id", "section_count", "prose_block_count", "suspicious_empty_section_count", ratio.alias("coverage_ratio"), "orphan_content_count", "toc_signal_score", (F.col("prose_block_count") + 2 * F.col("filled")).alias("body_signal_score"))


#: The names of the parse modes, and why another than the structural one was taken.
PARSE_MODES = {"structural": "docling_structural", "markdown": "hybrid_markdown_fill", "text": "tika_fallback", "none": "manual_review_required"}
FALLBACKS = {"markdown": "docling_body_signal_low", "text": "docling_and_markdown_body_signal_low", "none": "no_reliable_structural_source"}


def select_parse_mode(metrics: DataFrame) -> DataFrame:
    """(document_id, parse_mode, fallback_reason) from rows per document and source (structural, markdown, text).

    Markdown, or the plain text where there is no Markdown, wins whenever it yields sections and prose; without that a
    sound structural source is taken, then a source whose body outweighs its contents list.
    """
    pick = lambda s, c: F.max(F.when(F.col("source") == s, F.col(c)))
    names = ("section_count", "prose_block_count", "suspicious_empty_section_count", "coverage_ratio", "toc_signal_score", "body_signal_score")
    wide = metrics.groupBy("document_id").agg(*[pick(s, c).alias(f"{s}_{c}") for s in ("structural", "markdown", "text") for c in names])
    at = lambda s, c: F.coalesce(F.col(f"{s}_{c}"), F.lit(0))
    filled = lambda s: (at(s, "section_count") > 0) & (at(s, "prose_block_count") > 0)
    alive = lambda s: (at(s, "section_count") > 0) & (at(s, "body_signal_score") > at(s, "toc_signal_score"))
    sound = (at("structural", "section_count") > 0) & (at("structural", "body_signal_score") >= F.greatest(at("structural", "toc_signal_score"), F.lit(1)))
    sound = sound & (at("structural", "coverage_ratio") >= 0.45) & (at("structural", "suspicious_empty_section_count") <= F.greatest(F.lit(1), F.floor(at("structural", "section_count") / 2)))
    no_markdown = F.col("markdown_section_count").isNull()
    say = lambda m: F.struct(F.lit(PARSE_MODES[m]).alias("m"), F.lit(FALLBACKS.get(m)).cast("string").alias("r"))
    mode = F.when(filled("markdown"), say("markdown")).when(no_markdown & filled("text"), say("text")).when(sound, say("structural"))
    mode = mode.when(alive("markdown"), say("markdown")).when(alive("text"), say("text")).otherwise(say("none"))
    return wide.withColumn("x", mode).select("document_id", F.col("x.m").alias("parse_mode"), F.col("x.r").alias("fallback_reason"))


def stage1_sections(blocks: DataFrame, order: str = "source_order") -> DataFrame:
    """Accepts or rejects each block as a heading, with a reason; number, title, depth, parent and missing parents.

    blocks: document_id, source_kind, source_order, text_exact, label, markdown_heading_level.
    """

    def judged(t: Column) -> Column:
        g = lambda p, k: F.regexp_extract(t, p, k)
        numbered = r"^(\d+(?:\.\d+)*+)\.?\s+(.*)$"
        plain = (F.col("label") == "markdown") & F.col("markdown_heading_level").isNull()
        row = lambda ok, number, title, kind, why: F.struct(F.lit(ok).alias("accepted"), number.alias("section_number"), title.alias("section_title"), kind.alias("tree_kind"), F.lit(why).alias("reason"))
        none = F.lit(None).cast("string")
        no = lambda why: row(False, none, none, none, why)
        other = lambda title, number: F.when(title == "", number).otherwise(title)
        app, sec = F.concat(F.upper(g(L.APPENDIX_HEADING, 1)), F.lit(" "), g(L.APPENDIX_HEADING, 2)), F.upper(F.concat(F.lit("SECTION "), g(L.SECTION_HEADING, 2)))
        title = T.strip(g(numbered, 2))
        chain = F.when(t == "", no("empty")).when(t.rlike(r"^(?i)\s*(page\s+)?[A-Z]?-?\d+\s*$"), no("page_only")).when(t.rlike(L.DATE_ONLY), no("date_only")).when(t.rlike(L.TOC_TITLE), no("toc_heading")).when(t.rlike(L.TOC_ENTRY), no("toc_entry"))
        chain = chain.when(t.rlike(L.APPENDIX_HEADING), row(True, app, other(T.strip(g(L.APPENDIX_HEADING, 3)), app), F.upper(g(L.APPENDIX_HEADING, 1)), "appendix_pattern"))
        chain = chain.when(t.rlike(L.SECTION_HEADING), row(True, sec, other(T.strip(g(L.SECTION_HEADING, 3)), sec), F.lit("SECTION"), "section_pattern"))
        chain = chain.when(t.rlike(numbered) & (F.size(F.split(title, r"\s+")) > 18), no("numbered_heading_too_long")).when(t.rlike(numbered) & plain, no("markdown_plain_text"))
        chain = chain.when(t.rlike(numbered), row(True, g(numbered, 1), title, F.lit("MAIN"), "numbered_pattern")).otherwise(no("no_heading_match"))
        return chain

    c = T.strip_classification(T.strip_margin_line_numbers(F.col("text_exact")))
    rows = blocks.withColumn("__x", T.let(c, judged)).select(*blocks.columns, "__x.*")
    rows = rows.withColumns({"parent_section_number": T.parent_section_number(F.col("section_number"), F.col("tree_kind")), "depth": T.section_depth(F.col("section_number"), F.col("tree_kind"))})
    # a parent is missing if no accepted block before has its number; each block asks for its parent's, and an accepted one also gives its own:
    # both meet in one window, so that the patterns run once
    seat = lambda number, gives: F.struct(number.alias("number"), F.lit(gives).alias("gives"))
    seats = F.array_compact(F.array(seat(F.col("parent_section_number"), False), F.when(F.col("accepted"), seat(F.col("section_number"), True))))
    met = rows.select("*", F.explode(seats).alias("__seat"))
    met = met.select(*[F.when(~F.col("__seat.gives"), F.col(c)).alias(c) if c == "text_exact" else c for c in rows.columns], "__seat")
    by = Window.partitionBy("document_id", "source_kind", "__seat.number")
    met = met.withColumn("__at", F.min(F.when(F.col("__seat.gives"), F.col(order))).over(by)).where("not __seat.gives")
    alone = F.col("document_id").isNull() | F.col("source_kind").isNull() | F.col("__at").isNull() | (F.col("__at") >= F.col(order))
    rest = [c for c in rows.columns if c != "parent_section_number"]
    return met.withColumn("parent_missing", F.col("parent_section_number").isNotNull() & alone).select("document_id", "source_kind", "parent_section_number", *[c for c in rest if c not in ("document_id", "source_kind")], "parent_missing")


def stage1_best(rows: DataFrame) -> DataFrame:
    """Of each document's sources the one with most accepted blocks, then fewest missing parents."""
    sums = rows.groupBy("document_id", "source_kind").agg(F.sum(F.col("accepted").cast("int")).alias("accepted_count"), F.sum((~F.col("accepted")).cast("int")).alias("rejected_count"), F.sum(F.col("parent_missing").cast("int")).alias("warnings"))
    order = Window.partitionBy("document_id").orderBy(F.desc("accepted_count"), "warnings", "source_kind")
    return sums.withColumn("r", F.row_number().over(order)).where("r = 1").drop("r")


def link_tables_to_sections(tables: DataFrame, sections: DataFrame) -> DataFrame:
    """Each table with the last section that starts on or before its page; without a page, the last main one.

    An as-of join as one window: sections and tables in page order, and the last section seen so far.
    """
    main = sections.where("tree_kind = 'MAIN'").groupBy("document_id").agg(F.max_by(F.struct("section_number", "heading_path"), "section_order").alias("m"))
    s = sections.select("document_id", F.col("page_start").alias("page"), F.lit(0).alias("kind"), F.col("section_order").alias("o"), F.struct("section_number", "heading_path").alias("s"), F.lit(None).cast("string").alias("block_id"))
    t = tables.select("document_id", F.col("page_start").alias("page"), F.lit(1).alias("kind"), F.lit(0).cast(dict(sections.dtypes)["section_order"]).alias("o"), F.lit(None).cast(s.schema["s"].dataType).alias("s"), "block_id")
    by = Window.partitionBy("document_id").orderBy("page", "kind", "o", "block_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = s.where("page is not null").unionByName(t.where("page is not null")).withColumn("hit", F.last("s", ignorenulls=True).over(by)).where("kind = 1").select("document_id", "block_id", "hit")
    both = tables.join(seen, ["document_id", "block_id"], "left").join(main, "document_id", "left").withColumn("x", F.coalesce("hit", "m"))
    return both.select(*tables.columns, F.col("x.section_number").alias("section_number"), F.col("x.heading_path").alias("heading_path"))


def table_rows(tables: DataFrame) -> DataFrame:
    rows = tables.select("document_id", F.col("block_id").alias("table_id"), F.posexplode("rows").alias("row_index", "row"))
    return rows.select("document_id", "table_id", F.concat("table_id", F.lit(":row:"), F.col("row_index").cast("string")).alias("row_id"), "row_index", F.array_join(F.filter("row", lambda x: T.blank_if_null(x) != ""), " | ").alias("row_text"), (F.col("row_index") == 0).alias("is_header"))


def table_cells(tables: DataFrame) -> DataFrame:
    rows = tables.select("document_id", F.col("block_id").alias("table_id"), F.explode(T.headed(F.col("rows"))).alias("x")).select("document_id", "table_id", "x.*")
    cells = rows.select("document_id", "table_id", "header", "row_index", F.posexplode("row").alias("col_index", "cell_text"))
    row_id = F.concat("table_id", F.lit(":row:"), F.col("row_index").cast("string"))
    return cells.select("document_id", "table_id", row_id.alias("row_id"), F.concat(row_id, F.lit(":cell:"), F.col("col_index").cast("string")).alias("cell_id"), "row_index", "col_index", F.when(F.col("row_index") > 0, F.get("header", F.col("col_index"))).alias("header_text"), "cell_text")


def appendix_sections(sections: DataFrame) -> DataFrame:
    return sections.where("tree_kind is not null and tree_kind <> 'MAIN'")


def audit_documents(metrics: DataFrame, modes: DataFrame, blocks: DataFrame, candidates: DataFrame, reviews: DataFrame, tables: DataFrame) -> DataFrame:
    """One row per document of `metrics`: its metrics and mode, and counts of blocks, candidates, reviews, and tables without a section."""
    out = metrics.join(modes, "document_id", "left").withColumnsRenamed({"parse_mode": "parse_mode_selected"})
    out = out.withColumn("metrics_json", F.to_json(F.struct(*[c for c in out.columns if c != "document_id"])))
    loose = F.sum((T.blank_if_null("section_number") == "").cast("int"))
    for df, name, agg in ((blocks, "block_count", F.count("*")), (candidates, "requirement_candidate_count", F.count("*")), (reviews, "review_count", F.count("*")), (tables, "unassigned_table_count", loose)):
        out = out.join(df.groupBy("document_id").agg(agg.cast("long").alias(name)), "document_id", "left").na.fill(0, [name])
    return out.withColumns({"heading_count": F.col("section_count"), "unassigned_block_count": F.col("orphan_content_count")})


def hierarchy_quality(sections: DataFrame, none: str = "weak", strong_provider: str | None = None) -> DataFrame:
    """(document_id, quality): `none` without sections, partial below three, strong from three (or by provider)."""
    by_provider = F.max((F.col("provider") == strong_provider).cast("int")) if strong_provider else F.lit(0)
    n = F.count("section_number")
    return sections.groupBy("document_id").agg(F.when(n == 0, none).when((n >= 3) | (by_provider == 1), "strong").otherwise("partial").alias("quality"))


def flat_sections(sections: DataFrame) -> DataFrame:
    """Depth, parent number (by the stack of depths) and id of each section."""
    rows = sections.withColumn("depth", F.size(F.split("section_number", r"\.")))
    rows = _stacked(rows, "section_order", "depth", "section_number", "section_title", None)
    join = lambda f: F.array_join(F.transform("__stack", lambda x: x[f]), " > ")
    found = {"parent_order": _parent("o"), "heading_path": join("n"), "title_path": join("t"), "parent_number": _parent("n")}
    return rows.withColumns(found).drop("__stack").withColumn("section_id", T.section_id(F.col("section_number"), F.col("section_title")))


def build_artifacts(documents: DataFrame, sections: DataFrame, blocks: DataFrame | None = None, objects: DataFrame | None = None) -> DataFrame:
    """(document_id, artifact_json): one nested record per document; sections, blocks and objects in order.

    documents: document_id, filename, text; blocks: document_id, document_order, block_type, normalized_text and, if
    known, page_start; objects, as `align_objects` places them: document_id, block_id, document_order, object_type,
    section_number, confidence, method and, if known, rows. Trees stay flat: each section names its parent and depth.
    """

    def listed(df: DataFrame, name: str, order: str, fields: list[Column]) -> DataFrame:
        rows = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.struct(*fields).alias("x")))), lambda s: s["x"])
        return df.groupBy("document_id").agg(rows.alias(name))

    flat = flat_sections(sections.where("section_number is not null").select("document_id", "section_order", "section_number", "section_title"))
    out = documents.join(listed(flat, "sections", "section_order", [F.col(c) for c in ("section_id", "section_number", "section_title", "parent_number", "depth")]), "document_id", "left")
    kind = out.schema["sections"].dataType
    out = out.withColumn("sections", F.coalesce("sections", F.array().cast(kind)))
    if blocks is not None:
        page = F.col("page_start") if "page_start" in blocks.columns else F.lit(None).cast("int")
        rows = blocks.select("document_id", "document_order", F.col("block_type").alias("kind"), F.col("normalized_text").alias("text"), page.alias("page"))
        out = out.join(listed(rows, "blocks", "document_order", [F.col(c) for c in ("document_order", "kind", "text", "page")]), "document_id", "left")
    else:
        out = out.withColumn("blocks", F.array().cast("array<struct<document_order:int,kind:string,text:string,page:int>>"))
    if objects is not None:
        grid = F.col("rows") if "rows" in objects.columns else F.array().cast("array<array<string>>")
        rows = objects.select("document_id", "document_order", "object_type", F.struct(F.col("block_id").alias("object_id"), F.col("section_number").alias("attached_section_id"), F.col("confidence").alias("attachment_confidence"), F.col("method").alias("attachment_method"), grid.alias("rows")).alias("x"))
        out = out.join(listed(rows, "objects", "document_order", [F.col("object_type"), F.col("x")]), "document_id", "left")
    else:
        out = out.withColumn("objects", F.array().cast("array<struct<object_type:string,x:struct<object_id:string,attached_section_id:string,attachment_confidence:double,attachment_method:string,rows:array<array<string>>>>>"))
    for name in ("blocks", "objects"):
        out = out.withColumn(name, F.coalesce(name, F.array().cast(out.schema[name].dataType)))
    n, found = F.size("sections"), F.size("sections") > 0
    of = lambda t: F.transform(F.filter("objects", lambda o: o["object_type"] == t), lambda o: o["x"])
    pages = F.array_sort(F.array_distinct(F.array_compact(F.transform("blocks", lambda b: b["page"]))))
    loose = F.transform(F.filter("objects", lambda o: F.coalesce(o["x"]["attached_section_id"], F.lit("")) == ""), lambda o: o["x"]["object_id"])
    wanted = F.exists("sections", lambda s: F.lower(T.blank_if_null(s["section_title"])).contains("requirement"))
    record = F.struct(
        F.lit("structured_document_v1").alias("artifact_type"), T.document_digest(F.col("filename"), F.col("text")).alias("document_id"), F.struct("filename").alias("source"),
        F.struct(F.lit("pws_sow").alias("document_type"), F.when(found, 0.9).otherwise(0.55).alias("document_type_confidence"), F.array_max(pages).alias("page_count")).alias("metadata"),
        F.struct(T.blank_if_null("text").alias("full_text"), F.lit("pws_clean_v2").alias("cleaning_profile")).alias("cleaned_text"),
        F.struct(F.when(n >= 3, "strong").when(found, "partial").otherwise("weak").alias("quality"), "sections", F.transform(F.filter("sections", lambda s: s["parent_number"].isNull()), lambda s: s["section_id"]).alias("root_sections")).alias("hierarchy"),
        F.struct(of("table").alias("tables"), of("image").alias("images")).alias("objects"), F.col("blocks"),
        F.struct(F.struct(F.lit(True).alias("applied"), F.when(found, 0.93).otherwise(0.6).alias("confidence"), wanted.alias("requirements_detected"), loose.alias("unplaced_object_ids")).alias("pws")).alias("enrichments"),
        F.struct(pages.alias("source_pages")).alias("provenance"),
    )
    return out.select("document_id", F.to_json(record).alias("artifact_json"))


def outline_stats(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("document_id", "node_type").agg(F.count("*").alias("n"))


def section_index(nodes: DataFrame) -> DataFrame:
    """Sections with their level, parent and number of child sections."""
    s = nodes.where("node_type = 'section'")
    kids = s.groupBy("document_id", F.col("parent_id").alias("node_id")).agg(F.count("*").alias("child_count"))
    return s.join(kids, ["document_id", "node_id"], "left").select("document_id", "node_id", "parent_id", "depth", F.coalesce("child_count", F.lit(0)).alias("child_count"))


def normalize_numbering(nodes: DataFrame, titles: tuple[str, ...] = ("table of contents", "figures", "tables")) -> DataFrame:
    """Leading root sections that are contents lists go, and the others' first number is shifted by them."""
    root = (F.col("node_type") == "section") & (F.col("depth") == 1)
    front = root & F.lower(T.strip(F.col("section_title"))).isin(*titles)
    top = F.split("section_number", r"\.")[0].try_cast("int")
    rows = nodes.withColumn("__top", top)
    first = rows.where(root & ~front).groupBy("document_id").agg(F.min("__top").alias("__first"))
    gone = rows.where(front).select("document_id", "__top").join(first, "document_id").where(F.col("__top") < F.col("__first")).select("document_id", F.col("__top").alias("__gone"))
    rows = rows.join(gone, (rows.document_id == gone.document_id) & (rows["__top"] == gone["__gone"]), "left_anti")
    shift = gone.groupBy("document_id").agg(F.count("*").cast("int").alias("__off"))
    out = rows.join(shift, "document_id", "left")
    return out.withColumn("section_number", T.offset_section_number(F.col("section_number"), F.coalesce("__off", F.lit(0)))).drop("__top", "__off")


def outline_requirements(nodes: DataFrame) -> DataFrame:
    """Paragraph nodes labelled with the section that holds them."""
    s = nodes.where("node_type = 'section'").select("document_id", F.col("node_id").alias("parent_id"), "section_number", "section_title")
    p = nodes.where("node_type = 'paragraph'").select("document_id", "node_id", "parent_id", "text")
    return p.join(s, ["document_id", "parent_id"], "left").withColumn("section_label", T.strip(F.concat_ws(" ", "section_number", "section_title")))


def resolve_section_number(refs: DataFrame, sections: DataFrame) -> DataFrame:
    """Each reference (document_id, ref) with the nearest dotted ancestor that exists (null if none does)."""
    parts = F.split("ref", r"\.")
    steps = refs.withColumn("k", F.explode(F.sequence(F.lit(1), F.size(parts)))).withColumn("section_number", F.array_join(F.slice(parts, F.lit(1), F.col("k")), "."))
    hit = steps.join(sections.select("document_id", "section_number").distinct(), ["document_id", "section_number"]).groupBy("document_id", "ref").agg(F.max_by("section_number", "k").alias("resolved"))
    return refs.join(hit, ["document_id", "ref"], "left")


def objects_with_context(blocks: DataFrame, order: str = "document_order", near: int = 4, lines: int = 2) -> DataFrame:
    """Tables and images with the text lines before and after, an explicit heading close by, and the last heading."""
    by = Window.partitionBy("document_id").orderBy(order)
    text = F.when(F.col("block_type").isin("paragraph", "list_item", "note"), F.col("normalized_text"))
    head = F.when(F.col("block_type").isin(*HEADINGS), F.struct(F.col("numbering_token").alias("section_number"), F.col("heading_title").alias("section_title")))
    before, after = F.collect_list(text).over(by.rowsBetween(-near, -1)), F.collect_list(text).over(by.rowsBetween(1, near))
    rows = blocks.withColumns({"before": F.slice(before, F.greatest(F.size(before) - lines + 1, F.lit(1)), lines), "after": F.slice(after, 1, lines), "explicit_heading": F.last(head, ignorenulls=True).over(by.rowsBetween(-near, -1)), "preceding_heading": F.last(head, ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, -1))})
    return rows.where(F.col("block_type").isin("table", "image"))


def heading_anchors(sections: DataFrame, headings: DataFrame, least: float = 0.75) -> DataFrame:
    """Sections with the order of the heading block they stand for: by number, else by title words; unknown
    orders are put between the known ones around them, and each section ends before the next.

    Numbers meet in one window, so each side is computed once; the sections are staged, with the headings only of documents in
    which a number is not found.
    """
    none = lambda kind: F.lit(None).cast(kind)
    s = sections.select("document_id", F.col("section_number").alias("number"), F.struct(*sections.columns).alias("s"), none(dict(headings.dtypes)["document_order"]).alias("o"), none("string").alias("title"))
    h = headings.select("document_id", F.col("numbering_token").alias("number"), none(s.schema["s"].dataType).alias("s"), F.col("document_order").alias("o"), F.col("heading_title").alias("title"))
    keyed = F.expr("s is not null and document_id is not null and number is not null and s.section_order is not null")
    met = s.unionByName(h).withColumn("at", F.when(keyed, F.min("o").over(Window.partitionBy("document_id", "number"))))
    met = met.withColumn("open", F.max(F.expr("s is not null and at is null")).over(Window.partitionBy("document_id"))).where("s is not null or open")
    met = staged(met.select("document_id", "s", "o", "title", "at"))
    rows = met.where("s is not null").select("s.*", "at").withColumn("at", F.min("at").over(Window.partitionBy("document_id", "section_order")))
    words = rows.where("at is null").select("document_id", "section_order", F.explode(T.tokens_title(F.col("section_title"))).alias("w"))
    hw = met.where("s is null").select("document_id", "o", T.tokens_title(F.col("title")).alias("hw"))
    pairs = words.join(hw.select("document_id", "o", "hw", F.explode("hw").alias("w")), ["document_id", "w"]).groupBy("document_id", "section_order", "o").agg(F.count("*").alias("k"), F.first(F.size("hw")).alias("n"))
    by_title = pairs.where(F.col("k") / F.col("n") >= least).groupBy("document_id", "section_order").agg(F.min("o").alias("titled"))
    rows = rows.join(by_title, ["document_id", "section_order"], "left").withColumn("at", F.coalesce("at", "titled")).drop("titled")
    by = Window.partitionBy("document_id").orderBy("section_order")
    rows = rows.withColumn("i", F.row_number().over(by))
    known = F.when(F.col("at").isNotNull(), F.struct("i", "at"))
    rows = rows.withColumns({"p": F.last(known, ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow)), "n": F.first(known, ignorenulls=True).over(by.rowsBetween(Window.currentRow, Window.unboundedFollowing))})
    step = F.greatest((F.col("n.at") - F.col("p.at")) / (F.col("n.i") - F.col("p.i")), F.lit(1.0))
    between = F.bround(F.col("p.at") + step * (F.col("i") - F.col("p.i")))
    start = F.coalesce(F.col("at").cast("double"), between, F.col("p.at") + F.col("i") - F.col("p.i"), F.greatest(F.col("n.at") - (F.col("n.i") - F.col("i")), F.lit(0)), F.col("i") - 1).cast("int")
    rows = rows.withColumns({"start_order": start, "matched": F.col("at").isNotNull()})
    return rows.withColumn("end_order", F.lead("start_order").over(by) - 1).drop("i", "p", "n", "at")


def _half(x: Column, k: Column) -> Column:
    return F.floor(x / F.pow(F.lit(2.0), k)).cast("long")


def _covered(start: Column, end: Column) -> Column:
    """The cells (k, i), of length 2**k, that together make up start..end, both from 0 on: at most two of each length, none longer than
    the interval, so a point of it lies in exactly one of them."""

    def at(k: Column, s: Column, e: Column) -> Column:
        lo, hi = F.ceil(s / F.pow(F.lit(2.0), k)).cast("long"), _half(e, k)
        cell = lambda on, i: F.when((lo < hi) & on, F.struct(k.alias("k"), i.alias("i")))
        return F.array(cell(lo % 2 == 1, lo), cell(hi % 2 == 1, hi - 1))

    powers = lambda n: F.sequence(F.lit(0), F.length(F.bin(F.greatest(n, F.lit(0)))) - 1)
    ends = F.struct(start.cast("long").alias("s"), (end.cast("long") + 1).alias("e"))
    return T.let(ends, lambda x: F.array_compact(F.flatten(F.transform(powers(x["e"] - x["s"]), lambda k: at(k, x["s"], x["e"])))))


def _lengths(cells: str) -> Column:
    """The lengths of the cells as bits of one number."""
    return F.aggregate(cells, F.lit(0).cast("long"), lambda n, c: n.bitwiseOR(F.pow(F.lit(2.0), c["k"]).cast("long")))


def _around(x: Column, lengths: str) -> Column:
    """The cells around a point, one of each of the lengths."""
    powers = F.filter(F.sequence(F.lit(0), F.lit(62)), lambda k: F.getbit(F.col(lengths), k) == 1)
    return F.transform(powers, lambda k: F.struct(k.alias("k"), _half(x, k).alias("i")))


def _seats(cells: Column, pages: Column) -> Column:
    """Each cell of the order axis alone (q is -1), and beside each cell of the page axis."""
    both = lambda c: F.transform(pages, lambda g: F.struct(c["k"].alias("k"), c["i"].alias("i"), g["k"].alias("q"), g["i"].alias("j")))
    return F.flatten(F.transform(cells, lambda c: F.concat(F.array(F.struct(c["k"].alias("k"), c["i"].alias("i"), F.lit(-1).alias("q"), F.lit(-1).cast("long").alias("j"))), both(c))))


def align_objects(objects: DataFrame, anchors: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Section of each object: explicit heading (.98), preceding heading (.84), window of a matched anchor (.72 by order,
    .08 more by page), else words shared with a title (at most .69); below the threshold an object stays unplaced.

    Objects and anchors lie in one table, dealt by document, and meet in windows: by number, then by cells. An anchor's window is
    cut into cells whose lengths are powers of two, no longer than the document needs; of all anchors that own a cell the first is
    handed to the objects in it, so that no pairs of them are made. Words meet in an index of the titles' words.

    Optional columns: objects page_start and caption; anchors page_start, page_end and matched.
    """
    none = lambda kind: F.lit(None).cast(kind)
    col = lambda df, c, kind: F.col(c) if c in df.columns else none(kind)
    fits = F.coalesce(col(anchors, "matched", "boolean"), F.lit(True)) & (F.col("end_order").isNull() | (F.col("end_order") >= F.col("start_order")))
    n = F.col("section_number").cast("string")
    s = anchors.select("document_id", n.alias("e"), n.alias("p"), F.struct(n.alias("n"), "section_order", F.col("start_order").alias("o0"), F.col("end_order").alias("o1"), col(anchors, "page_start", "int").alias("p0"), col(anchors, "page_end", "int").alias("p1"), fits.alias("fits")).alias("a"))
    near = F.concat_ws(" ", col(objects, "caption", "string"), F.array_join("before", " "), F.array_join("after", " "))
    rows = objects.select("document_id", "block_id", "document_order", F.col("explicit_heading.section_number").alias("e"), F.col("preceding_heading.section_number").alias("p"), col(objects, "page_start", "int").alias("page"), near.alias("near"))
    rows = rows.unionByName(s, allowMissingColumns=True)
    for c in ("e", "p"):
        known = F.max(F.col("a").isNotNull()).over(Window.partitionBy("document_id", c))
        rows = rows.withColumn(c, F.when(F.col("a").isNotNull() | (F.col("document_id").isNotNull() & known), F.col(c)))
    # what no heading places is looked up in the anchors' windows, and what these don't hold by the words of titles
    asks = F.expr("a is null and e is null and p is null and document_id is not null and block_id is not null")
    whole = Window.partitionBy("document_id")
    rows = rows.withColumn("asks", asks).withColumn("near", F.when(F.col("asks"), F.col("near")))
    asked = lambda f, c: f(F.when(F.col("asks"), F.col(c))).over(whole)
    rows = rows.withColumns({"top": asked(F.max, "document_order"), "page0": asked(F.min, "page"), "page1": asked(F.max, "page")})
    cells = F.when(F.expr("a.fits and top is not null"), _covered(F.greatest(F.col("a.o0"), F.lit(0)), F.least(F.col("a.o1"), F.col("top"))))
    pages = F.when(F.expr("a.fits and a.p0 is not null and a.p1 is not null and page0 is not null"), _covered(F.greatest(F.col("a.p0").cast("long"), F.col("page0")) - F.col("page0"), F.least(F.col("a.p1"), F.col("page1")).cast("long") - F.col("page0")))
    rows = rows.withColumns({"cells": cells, "pages": pages})
    rows = rows.withColumns({"ks": F.bit_or(_lengths("cells")).over(whole), "qs": F.bit_or(_lengths("pages")).over(whole)})
    rows = rows.withColumns({"cells": F.when(F.col("asks"), _around(F.col("document_order").cast("long"), "ks")).otherwise(F.col("cells")), "pages": F.when(F.col("asks"), _around(F.col("page").cast("long") - F.col("page0"), "qs")).otherwise(F.col("pages"))})
    seats = F.coalesce(_seats(F.col("cells"), F.coalesce("pages", F.array().cast("array<struct<k:int,i:bigint>>"))), F.array().cast("array<struct<k:int,i:bigint,q:int,j:bigint>>"))
    own = F.array(F.struct(F.lit(-1).alias("k"), F.lit(-1).cast("long").alias("i"), F.lit(-1).alias("q"), F.lit(-1).cast("long").alias("j")))
    rows = rows.withColumn("seat", F.explode(F.when(F.col("a").isNull(), F.concat(own, seats)).otherwise(seats)))
    once = {c: F.when(F.expr("seat.k = -1"), F.col(c)) for c in ("document_order", "e", "p", "near")}
    first = F.when(F.col("a").isNotNull(), F.struct((-F.col("a.section_order")).alias("o"), F.col("a.n").alias("n")))
    rows = rows.select("document_id", "block_id", *[x.alias(c) for c, x in once.items()], first.alias("first"), "seat")
    rows = rows.withColumn("hit", F.max("first").over(Window.partitionBy("document_id", "seat.k", "seat.i", "seat.q", "seat.j"))).where("first is null")
    best = lambda where: F.max(F.when(F.expr(where), F.col("hit"))).over(Window.partitionBy("document_id", "block_id"))
    paged, plain = best("seat.q >= 0"), best("seat.k >= 0 and seat.q = -1")
    rows = rows.withColumns({"paged": paged, "plain": plain}).where("seat.k = -1")
    open_ = F.expr("e is null and p is null and paged is null and plain is null")
    rows = staged(rows.select("document_id", "block_id", "document_order", "e", "p", "paged", "plain", F.when(open_, T.tokens_title(F.col("near"))).alias("ow")))
    rest = rows.where("ow is not null").select("document_id", "block_id", F.explode("ow").alias("word"))
    titles = anchors.join(rest.select("document_id").distinct(), "document_id", "left_semi").select("document_id", "section_order", F.col("section_number").alias("n"), T.tokens_title(F.col("section_title")).alias("sw"))
    index = titles.select("document_id", "section_order", "n", F.size("sw").alias("words"), F.explode("sw").alias("word"))
    shared = rest.join(index, ["document_id", "word"]).groupBy("document_id", "block_id", "section_order", "n").agg((F.count("*") / F.first("words")).alias("ratio"))
    lexical = shared.where("ratio >= 0.5").groupBy("document_id", "block_id").agg(F.max(F.struct(F.col("ratio").alias("score"), (-F.col("section_order")).alias("o"), "n")).alias("l"))
    rows = rows.join(lexical, ["document_id", "block_id"], "left")
    placed = lambda n, c, m: F.struct(n.alias("n"), c.alias("c"), F.lit(m).alias("m"))
    say = F.when(F.col("e").isNotNull(), placed(F.col("e"), F.lit(0.98), "explicit_heading_context"))
    say = say.when(F.col("p").isNotNull(), placed(F.col("p"), F.lit(0.84), "nearest_preceding_heading"))
    say = say.when(F.col("paged").isNotNull(), placed(F.col("paged.n"), F.lit(0.8), "page_order_window")).when(F.col("plain").isNotNull(), placed(F.col("plain.n"), F.lit(0.72), "page_order_window"))
    say = say.when(F.col("l").isNotNull(), placed(F.col("l.n"), F.least(F.lit(0.45) + F.col("l.score"), F.lit(0.69)), "lexical_overlap")).otherwise(placed(F.lit(None).cast("string"), F.lit(0.0), "unplaced"))
    on = F.col("x.c") >= threshold
    return rows.withColumn("x", say).select("document_id", "block_id", "document_order", F.when(on, F.col("x.n")).alias("section_number"), F.col("x.c").alias("confidence"), F.when(on, F.col("x.m")).otherwise("unplaced").alias("method"))


def unplaced_objects(decisions: DataFrame) -> DataFrame:
    return decisions.where("section_number is null").orderBy("document_id", "document_order")


def merged_outline_nodes(sections: DataFrame, blocks: DataFrame) -> DataFrame:
    """Text, table and image blocks under the last recognised section, numbered by kind: p1, t1, img1."""
    heads = blocks.where(F.col("block_type").isin(*HEADINGS)).select("document_id", F.col("numbering_token").alias("ref")).distinct()
    to = resolve_section_number(heads, sections).withColumnRenamed("ref", "numbering_token")
    by = Window.partitionBy("document_id").orderBy("document_order").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = blocks.join(to, ["document_id", "numbering_token"], "left").withColumn("section_number", F.last("resolved", ignorenulls=True).over(by)).where(~F.col("block_type").isin(*HEADINGS))
    kind = F.when(F.col("block_type") == "table", "t").when(F.col("block_type") == "image", "img").otherwise("p")
    rows = rows.withColumn("kind", kind)
    seat = Window.partitionBy("document_id", "section_number", "kind").orderBy("document_order")
    return rows.where("section_number is not null").select("document_id", "section_number", "document_order", F.concat("section_number", F.lit("."), "kind", F.row_number().over(seat).cast("string")).alias("node_id"), "block_type", "normalized_text")


def hierarchy_rows(sections: DataFrame, tables: DataFrame | None = None) -> DataFrame:
    """Labels of levels 1 to 4 and one row per paragraph and then per table of the section (a blank one if it has neither).

    tables: document_id, table_index, heading_path (section numbers, as `heading_paths` joins them) and normalized_text.
    """
    label = T.strip(F.concat_ws(" ", "section_number", "section_title"))
    rows = sections.where("section_order is not null").withColumn("label", label)
    rows = heading_paths(rows, "section_order", "heading_level", "label", "section_number", "tree_kind")
    chain = F.split("heading_path", " > ")
    parts = F.filter(F.split(T.blank_if_null("body_text"), r"\n{2,}"), lambda x: T.strip(x) != "")
    if tables is not None:
        live = tables.where((T.blank_if_null("heading_path") != "") & (T.strip(T.blank_if_null("normalized_text")) != ""))
        texts = F.transform(F.array_sort(F.collect_list(F.struct("table_index", T.strip("normalized_text").alias("x")))), lambda s: s["x"])
        rows = rows.join(live.groupBy("document_id", F.col("heading_path").alias("title_path")).agg(texts.alias("__tables")), ["document_id", "title_path"], "left")
        parts = F.concat(parts, F.coalesce("__tables", F.array().cast("array<string>")))
    out = rows.select("document_id", "section_order", *[T.blank_if_null(F.get(chain, F.lit(k))).alias(f"level_{k + 1}") for k in range(4)], F.posexplode_outer(parts).alias("i", "content"))
    return out.withColumns({"i": F.coalesce("i", F.lit(0)), "content": T.blank_if_null("content")})


def nested_sets(nodes: DataFrame, order: str = "position", level: str = "depth") -> DataFrame:
    """Adds entry and exit: a node's number in the document, and that of the last node below it. Nodes come in the order of a walk
    of the tree, with their level in it (from 1).

    Between a node and the next one the levels from the next one's to its own are closed. On each level openings and closings
    take turns, so what closes a node is the row after it among those of its level: any depth, no loop.
    """
    by = Window.partitionBy("document_id").orderBy(order)
    rows = nodes.withColumns({"entry": F.row_number().over(by).cast("long"), "__next": F.coalesce(F.lead(level).over(by), F.lit(1))})
    closed = F.when(F.col("__next") <= F.col(level), F.sequence(F.col("__next"), F.col(level))).otherwise(F.array().cast("array<int>"))
    events = F.concat(F.array(F.struct(F.lit(0).alias("kind"), F.col(level).cast("int").alias("at"))), F.transform(closed, lambda k: F.struct(F.lit(1).alias("kind"), k.cast("int").alias("at"))))
    rows = rows.withColumn("__e", F.explode(events))
    turn = Window.partitionBy("document_id", F.col("__e.at")).orderBy("entry", "__e.kind")
    return rows.withColumn("exit", F.lead("entry").over(turn)).where("__e.kind = 0").drop("__e", "__next")


def descendants(nodes: DataFrame, order: str = "position", level: str = "depth") -> DataFrame:
    """(document_id, root, node_id, distance) for all nodes below each node, by nested sets; what comes out is all that is joined.

    A node whose parent is missing begins a tree of its own, below that parent's id.
    """
    sets = nested_sets(nodes.select("document_id", "node_id", "parent_id", F.col(order).alias("position"), F.col(level).cast("int").alias("depth")))
    known = nodes.select("document_id", F.col("node_id").alias("parent_id")).distinct().withColumn("known", F.lit(True))
    sets = sets.join(known, ["document_id", "parent_id"], "left").withColumn("orphan", F.col("parent_id").isNotNull() & F.col("known").isNull()).drop("known")
    below = lambda df, first: df.withColumn("below", F.explode(F.when(F.col("exit") >= F.col(first), F.sequence(F.col(first), F.col("exit"))).otherwise(F.array().cast("array<bigint>"))))
    # the orphan next above each node (itself included), if any
    cut = below(sets.where("orphan"), "entry").groupBy("document_id", F.col("below").alias("entry")).agg(F.max("entry").alias("tree"))
    sets = sets.join(cut, ["document_id", "entry"], "left").withColumn("tree", F.coalesce("tree", F.lit(0)))
    x = sets.select("document_id", F.col("entry").alias("below"), F.col("node_id").alias("n"), F.col("depth").alias("d"), F.col("tree").alias("t"))
    own = below(sets.withColumn("first", F.col("entry") + 1), "first").select("document_id", F.col("node_id").alias("root"), "below", "depth", "tree")
    lost = below(sets.where("orphan"), "entry").select("document_id", F.col("parent_id").alias("root"), "below", (F.col("depth") - 1).alias("depth"), F.col("entry").alias("tree"))
    pairs = own.unionByName(lost).join(x, ["document_id", "below"]).where("tree = t")
    return pairs.select("document_id", "root", F.col("n").alias("node_id"), (F.col("d") - F.col("depth")).cast("int").alias("distance"))


def section_requirement_counts(nodes: DataFrame) -> DataFrame:
    s = nodes.where("node_type = 'section'").select("document_id", "node_id")
    n = nodes.where("node_type = 'paragraph'").groupBy("document_id", F.col("parent_id").alias("node_id")).agg(F.count("*").alias("requirements"))
    return s.join(n, ["document_id", "node_id"], "left").na.fill(0, ["requirements"])


def resequence(nodes: DataFrame) -> DataFrame:
    """Positions from 1 within each parent, by old position and title."""
    by = Window.partitionBy("document_id", "parent_id").orderBy("position", "section_title", "node_id")
    return nodes.withColumn("position", F.row_number().over(by))


def review_rollup(items: DataFrame) -> DataFrame:
    live = items.where("node_type <> 'bullet'")
    return live.groupBy("document_id").agg(F.count("*").alias("items"), F.sum(F.col("status").isin("needs-review", "bad-extract").cast("int")).alias("flagged"), F.sum((F.col("status") == "accepted").cast("int")).alias("accepted"))


def explode_structured_json(documents: DataFrame, col: str = "structured_json") -> DataFrame:
    """Blocks of converter output in reading order: references resolved, groups descended; bad JSON gives none.

    References nest without bound, so a document is walked in a helper on Arrow batches; no shuffle.
    """
    import json

    def walk(doc: str | None) -> list[dict]:
        try:
            tree = json.loads(doc or "")
        except ValueError:
            return []
        out: list[dict] = []
        seen: set[str] = set()

        def visit(refs: list) -> None:
            for ref in (r.get("$ref") for r in refs or [] if isinstance(r, dict)):
                name, _, at = str(ref or "").removeprefix("#/").partition("/")
                items = tree.get(name)
                if ref in seen or not at.isdigit() or not isinstance(items, list) or int(at) >= len(items):
                    continue
                seen.add(ref)
                node = items[int(at)]
                if name == "groups":
                    visit(node.get("children"))
                    continue
                pages = [p["page_no"] for p in node.get("prov") or [] if isinstance(p.get("page_no"), int)]
                grid = [[" ".join(str(c.get("text", "")).split()) for c in r] for r in (node.get("data") or {}).get("grid") or []]
                text = " ".join(str(node.get("text", "")).split()) if name == "texts" else "\n".join(" | ".join(c for c in r if c) for r in grid if any(r))
                if text or name == "pictures":
                    out.append({"kind": name[:-1], "text": text, "label": node.get("label", "text"), "bold": bool((node.get("formatting") or {}).get("bold")), "page_start": min(pages, default=None), "page_end": max(pages, default=None), "rows": grid})

        visit((tree.get("body") or {}).get("children"))
        return out

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(walk)

    kind = "array<struct<kind string, text string, label string, bold boolean, page_start int, page_end int, rows array<array<string>>>>"
    rest = [c for c in documents.columns if c != col]
    return bounded(documents).select(*rest, F.posexplode(F.pandas_udf(run, kind)(col)).alias("document_order", "x")).select(*rest, "document_order", "x.*")


def iter_paragraphs(df: DataFrame, col: str = "text") -> DataFrame:
    """Paragraphs: split at blank lines and at lines of contents lists or images, which go; heading lines stand alone, and a
    paragraph is split where a heading starts inside it."""

    def keyed(x: Column) -> Column:
        bare = F.when(x.startswith("**") & x.endswith("**") & (F.length(x) > 4), T.strip(F.substr(x, F.lit(3), F.length(x) - 4))).otherwise(x)
        link = F.regexp_extract(bare, L.MARKDOWN_LINK, 1)
        return F.struct(x.alias("x"), T.normalize_heading_candidate(F.when(link != "", link).otherwise(bare)).alias("k"))

    def head(k: Column) -> Column:
        noise = (F.length(k) <= 1) | k.rlike(L.DATE_ONLY) | F.upper(k).rlike(L.MARKING_ONLY)
        number = k.rlike(L.NUMBER_HEADING) & (F.size(F.split(T.strip(F.regexp_extract(k, L.NUMBER_HEADING, 2)), r"\s+")) <= 12)
        return ~noise & (k.rlike(L.APPENDIX_HEADING) | k.rlike(L.SECTION_HEADING) | k.rlike(L.DECIMAL_HEADING) | number)

    noise = lambda k: (k == "") | k.rlike(L.IMAGE_TAG) | k.rlike(L.TOC_TITLE) | k.rlike(L.TOC_ENTRY)
    lines = F.transform(F.transform(F.split(F.regexp_replace(T.blank_if_null(col), r"\r\n?", "\n"), "\n"), T.strip), keyed)
    marked = F.transform(lines, lambda s: F.when(noise(s["k"]), "").when(head(s["k"]), F.concat(F.lit("\n\n"), s["x"], F.lit("\n\n"))).otherwise(s["x"]))
    whole = F.filter(F.transform(F.split(F.array_join(marked, "\n"), r"\n{2,}"), T.strip), lambda x: x != "")
    pieces = lambda x: F.filter(F.transform(F.split(x, L.INLINE_HEADING), T.strip), lambda y: y != "")
    parts = F.flatten(F.transform(F.transform(whole, keyed), lambda s: F.when(head(s["k"]), F.array(s["x"])).otherwise(pieces(s["x"]))))
    rest = [c for c in df.columns if c != col]
    return df.select(*rest, F.posexplode(parts).alias("paragraph_index", "paragraph"))


def render_markdown_table(rows: Column) -> Column:
    """Pipe table of an array of rows, all as wide as the widest; the first row is the header."""

    def drawn(s: Column) -> Column:
        rows, seats = s["rows"], s["seats"]
        line = lambda r: F.concat(F.lit("| "), F.array_join(F.transform(seats, lambda i: T.blank_if_null(F.get(r, i - 1))), " | "), F.lit(" |"))
        rule = F.concat(F.lit("| "), F.array_join(F.transform(seats, lambda i: F.lit("---")), " | "), F.lit(" |"))
        body = F.transform(F.slice(rows, F.lit(2), F.greatest(F.size(rows) - 1, F.lit(0))), line)
        return F.array_join(F.concat(F.array(line(rows[0]), rule), body), "\n")

    # the width is found once, not again for every row
    return T.let(T.let(rows, lambda r: F.struct(r.alias("rows"), F.sequence(F.lit(1), F.array_max(F.transform(r, F.size))).alias("seats"))), drawn)


def _row_cells(x: Column) -> Column:
    """Cells of a line between pipes; a pipe at either end is no cell's."""
    return F.split(F.regexp_replace(T.strip(x), r"^\||\|$", ""), r"\|")


def inline_table(c: Column) -> Column:
    """Of a line that holds a whole table (header, rule and cells one after another): text before it, and its rows, as wide as
    the header; cells that fill no row are left out. Null rows if the line holds none.

    The line is cut at its pipes once. Two cells of the header at least, then a blank, then the cells of the rule, two at least,
    each before a pipe: the first such place decides.
    """

    def opened(s: Column) -> Column:
        cells, rule, n = s["cells"], s["rule"], F.size(s["cells"])
        at = F.sequence(F.lit(3), F.greatest(n - 4, F.lit(3)))  # the blank, 0-based; cell 0 stands before the first pipe
        first = F.get(F.filter(at, lambda k: F.get(s["blank"], k) & F.get(rule, k + 1) & F.get(rule, k + 2) & (k + 3 < n)), F.lit(0))
        end = F.get(F.filter(F.sequence(first + 1, n), lambda k: ~F.coalesce(F.get(rule, k), F.lit(False)) | (k >= n - 1)), F.lit(0))
        body = F.filter(F.transform(F.slice(cells, end + 1, n), lambda y: T.strip_inline_markdown(T.strip(y))), lambda y: y != "")
        header = F.transform(F.slice(cells, F.lit(2), first - 1), lambda y: T.strip_inline_markdown(T.strip(y)))
        return F.when(first.isNotNull(), F.struct(header.alias("header"), body.alias("body")))

    def rows(s: Column) -> Column:
        n = F.size(s["header"])
        full = F.floor(F.size(s["body"]) / n).cast("int")
        # cells by their places: a slice would copy all cells for each row
        body = F.transform(F.sequence(F.lit(1), F.greatest(full, F.lit(1))), lambda k: F.transform(s["header"], lambda _, i: F.get(s["body"], (k - 1) * n + i)))
        return F.when(full > 0, F.concat(F.array(s["header"]), body))

    cells = F.split(T.blank_if_null(c), r"\|")
    marked = T.let(cells, lambda x: F.struct(x.alias("cells"), F.transform(x, lambda y: y.rlike(r"^[-:\s]*$")).alias("rule"), F.transform(x, lambda y: T.strip(y) == "").alias("blank")))
    return T.let(marked, lambda s: F.struct(T.strip(s["cells"][0]).alias("prefix"), F.when(F.size(s["cells"]) > 6, T.let(opened(s), rows)).alias("rows")))


def markdown_tables(c: Column) -> Column:
    """Rows of a pipe table as an array of arrays, without the rule below the header; tables pressed into one line are opened."""
    row = lambda x: F.transform(F.split(F.regexp_replace(T.strip(x), r"^\||\|$", ""), r"\|"), T.strip)
    rule = lambda x: x.rlike(r"^\s*\|[\s|:\-]+\|?\s*$")
    none = F.array().cast("array<array<string>>")
    lines = F.transform(F.split(T.blank_if_null(c), "\n"), lambda x: F.struct(x.alias("x"), inline_table(x)["rows"].alias("t")))
    return F.flatten(F.transform(lines, lambda s: F.when(s["t"].isNotNull(), s["t"]).when(T.strip(s["x"]).startswith("|") & ~rule(s["x"]), F.array(row(s["x"]))).otherwise(none)))


def structured_content(nodes: DataFrame, col: str = "content", keys: tuple[str, ...] = ("document_id", "node_id")) -> DataFrame:
    """(keys, block_index, block_type, text, rows): paragraphs and tables that the lines of each node make up.

    Each line has a class: blank, row of a pipe table, rule below a header, whole table pressed into one line, or text. In a run of
    rows the first one with a rule below it begins a table, which lasts to the run's end and is without that rule. What is left is cut
    at blank lines and tables into runs of text; pressed tables at such a run's start are blocks of their own, with the text before them.
    All runs are windows over the order of the lines. A null or blank text has no block; the order of equal lines is theirs in the text.
    """
    row, rule = r"^\|?.+\|.+\|?$", r"^\|?[\s:-]+(?:\|[\s:-]+)++\|?$"
    lines = nodes.select(*keys, F.posexplode(F.split(F.regexp_replace(T.blank_if_null(col), "\r\n", "\n"), "\n")).alias("i", "x"))
    bare = T.strip("x")
    lines = lines.withColumns({"x": bare, "row": bare.rlike(row), "rule": bare.rlike(rule), "pressed": inline_table(F.col("x"))["rows"]})
    by = Window.partitionBy(*keys).orderBy("i")
    so_far = by.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lines = lines.withColumn("lead", F.col("row") & F.coalesce(F.lead("rule").over(by), F.lit(False)))
    lines = lines.withColumn("island", F.sum((~F.col("row")).cast("int")).over(so_far))
    first = F.min(F.when(F.col("lead"), F.col("i"))).over(Window.partitionBy(*keys, "island"))
    lines = lines.withColumn("at", first).withColumn("table", F.col("row") & F.coalesce(F.col("i") >= F.col("at"), F.lit(False)))
    lines = lines.where(~(F.col("table") & (F.col("i") == F.col("at") + 1)))
    # a run of text begins after a blank line, a table, or a node's start
    loose = ~F.col("table") & (F.col("x") != "")
    lines = lines.withColumn("loose", loose).withColumn("run", F.sum((~F.col("loose")).cast("int")).over(so_far))
    in_run = Window.partitionBy(*keys, "run").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lines = lines.where((F.col("x") != "")).withColumn("own", F.col("loose") & F.col("pressed").isNotNull() & (F.min(F.when(F.col("loose"), F.col("pressed").isNotNull())).over(in_run)))
    block = lambda kind, k: F.struct(F.lit(kind).alias("kind"), F.coalesce(k.cast("int"), F.lit(0)).alias("k"))
    # blocks: a table by its start, a pressed table by its line, text by its run
    lines = lines.withColumn("block", F.when(F.col("table"), block("t", F.col("at"))).when(F.col("own"), block("p", F.col("i"))).otherwise(block("x", F.col("run"))))
    held = lines.groupBy(*keys, "block").agg(F.min("i").alias("i"), F.array_sort(F.collect_list(F.struct("i", "x"))).alias("lines"), F.first("pressed").alias("pressed"))
    said = F.transform("lines", lambda s: s["x"])
    prefix = T.strip_inline_markdown(F.regexp_replace(inline_table(said[0])["prefix"], r"\s+", " "))
    table = lambda rows: F.struct(F.lit("table").alias("block_type"), F.lit("").alias("text"), rows.alias("rows"))
    words = lambda text: F.struct(F.lit("paragraph").alias("block_type"), text.alias("text"), F.array().cast("array<array<string>>").alias("rows"))
    cells = F.transform(said, lambda x: F.transform(_row_cells(x), lambda y: T.strip_inline_markdown(T.strip(y))))
    parts = F.when(F.col("block.kind") == "t", F.array(table(cells))).when(F.col("block.kind") == "x", F.array(words(T.strip_inline_markdown(F.array_join(said, "\n")))))
    parts = parts.when(prefix != "", F.array(words(prefix), table(F.col("pressed")))).otherwise(F.array(table(F.col("pressed"))))
    blocks = held.select(*keys, "i", F.posexplode(parts).alias("j", "b"))
    number = F.row_number().over(Window.partitionBy(*keys).orderBy("i", "j")) - 1
    return blocks.select(*keys, number.alias("block_index"), "b.*")
