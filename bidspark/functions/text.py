"""Text cleaning and scalar functions, Column to Column, all built in but for entities."""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from bidspark.functions import lexicons as L


def blank_if_null(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


#: The white space of Java's patterns.
SPACES = " \t\n\x0b\f\r"


def strip(c: Column) -> Column:
    """Without white space at both ends."""
    return F.btrim(c, F.lit(SPACES))


def rstrip(c: Column) -> Column:
    return F.rtrim(c, F.lit(SPACES))


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with the value evaluated once, however often f names it."""
    return F.transform(F.array(value), f)[0]


def headed(rows: Column) -> Column:
    """Rows of a table, each beside its number and the table's first row: exploded, they drag no copy of the table along."""
    return let(rows, lambda r: F.transform(r, lambda x, i: F.struct(i.alias("row_index"), F.get(r, F.lit(0)).alias("header"), x.alias("row"))))


#: Beside a word these end it for sure.
EDGES = " \t\n\r.,;:!?()[]{}<>'\"/\\-&%$#*+=|@^~`"


def _words_needed(pattern: str) -> tuple[list[str], list[str]] | None:
    """Lower-case words of which each match of `\\b(a|b|...)\\b` holds one: how its alternatives begin; and those that are whole
    alternatives. None if that can't be told."""
    body, out, depth, start = pattern.removeprefix(r"\b").removesuffix(r"\b"), [], 0, 0
    if body.startswith("(") and body.find(")") == len(body) - 1 or body.startswith("(") and body.endswith(")") and not body.startswith("(?"):
        body = body[1:-1]
    for i, x in enumerate(body + "|"):
        depth += (x == "(") - (x == ")")
        if x == "|" and depth == 0:
            out.append(body[start:i])
            start = i + 1
        elif x in "\\[" or depth < 0:
            return None
    words = [re.match(r"(?:[A-Za-z ](?![?*{]))*", x).group().strip().lower() for x in out]
    whole = {x.lower() for x in out if re.fullmatch("[A-Za-z ]*[A-Za-z]", x)}
    return None if min(map(len, words)) < 2 else (sorted(set(words)), sorted(whole & set(words)) if pattern.startswith(r"\b") and pattern.endswith(r"\b") else [])


def found(c: Column, patterns: Sequence[str]) -> list[Column]:
    """For each pattern whether it is found in `c`, a Column that is cheap to name, ignoring case."""
    return [_one_found(c, lowered(c), p) for p in patterns]


def lowered(c: Column) -> Column:
    """Between blanks in small letters, also the four letters outside ASCII that patterns without case take for letters of ASCII."""
    low = F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.lower(F.translate(c, "\u017f\u212a\u0131\u0130", "skii")))
    return F.concat(F.lit(" "), low, F.lit(" "))


def _one_found(c: Column, low: Column, pattern: str) -> Column:
    """Whether the pattern is found in `c`: no, where none of the words that it needs is; yes, where a whole alternative stands between
    edges. Both take far less than the pattern, which says the rest."""
    needed, full = _words_needed(pattern), c.rlike("(?iU)" + pattern)
    if needed is None:
        return full
    words, whole = needed
    edged = lambda w, at: F.lit(EDGES).contains(F.substr(low, at - 1, F.lit(1))) & F.lit(EDGES).contains(F.substr(low, at + len(w), F.lit(1)))
    stands = [low.contains(w) & edged(w, F.instr(low, F.lit(w))) for w in whole]
    out = F.when(~reduce(Column.__or__, [low.contains(w) for w in words]), False)
    return (out.when(reduce(Column.__or__, stands), True) if stands else out).otherwise(full)


def first_match(c: Column, patterns: Sequence[tuple[str, str]], default: Column | None = None) -> Column:
    """Label of the first pattern of the list found in the text, ignoring case."""

    def label(s: Column) -> Column:
        out = F.lit(None).cast("string") if default is None else default
        for name, p in reversed(patterns):
            out = F.when(_one_found(s["x"], s["low"], p), F.lit(name)).otherwise(out)
        return out

    # the small letters are made once for all patterns
    return let(c, lambda x: let(F.struct(x.alias("x"), lowered(x).alias("low")), label))


def normalize_inline(c: Column) -> Column:
    """One line: line breaks are blanks, runs of blanks one blank."""
    flat = F.replace(F.replace(blank_if_null(c), F.lit("\r"), F.lit(" ")), F.lit("\n"), F.lit(" "))
    return let(flat, lambda x: strip(single_blanks(x)))


def single_blanks(x: Column) -> Column:
    """`x`, cheap to name, with one blank for each run of blanks and tabs; most texts have no such run, which a plain search tells."""
    return F.when(x.contains("  ") | x.contains("\t"), F.regexp_replace(x, r"[ \t]{2,}", " ")).otherwise(x)


def clean_extracted_text(c: Column) -> Column:
    """Drops bookmarks, banner and page lines, extra blanks, and all but two of any run of blank lines."""
    text = F.regexp_replace(blank_if_null(c), r"\r\n?", "\n")
    text = F.regexp_replace(text, r"\[bookmark:[^\]]+\]", "")
    lines = F.transform(F.split(text, "\n"), lambda x: strip(F.regexp_replace(x, r"[ \t]{2,}", " ")))
    lines = F.filter(lines, lambda x: ~x.isin("UNCLASSIFIED", "CLASSIFIED") & ~x.rlike(r"^(PAGE|Page)\s+\d+\b"))
    return strip(F.regexp_replace(F.array_join(lines, "\n"), r"\n{4,}", "\n\n\n"))


def letter_ratio(c: Column) -> Column:
    """Share of letters among visible characters; 0 without any."""
    seen = F.length(F.regexp_replace(c, r"\s", ""))
    return F.when(seen > 0, F.length(F.regexp_replace(c, r"[^\p{L}]", "")) / seen).otherwise(F.lit(0.0))


def is_weak_text(c: Column, min_len: int = 1500, min_alpha: float = 0.55) -> Column:
    text = strip(blank_if_null(c))
    return (F.length(text) < min_len) | (letter_ratio(text) < min_alpha)


def extraction_route(filename: Column, text: Column, min_len: int = 1500, min_alpha: float = 0.55) -> Column:
    """`ocr` for PDF files with weak text, `fast` for others, `default` for other files."""
    pdf = F.lower(blank_if_null(filename)).endswith(".pdf")
    return F.when(pdf & is_weak_text(text, min_len, min_alpha), "ocr").when(pdf, "fast").otherwise("default")


def strip_classification(c: Column) -> Column:
    """Without leading markings such as (U); the text itself if nothing else is in it."""
    bare = lambda text: F.when(text.startswith("("), strip(F.regexp_replace(text, rf"^(?i)(?:\({L.MARKING}\)\s*)++", ""))).otherwise(text)
    return let(strip(blank_if_null(c)), lambda text: let(bare(text), lambda x: F.when(x == "", text).otherwise(x)))


def strip_classification_inline(c: Column) -> Column:
    return F.regexp_replace(blank_if_null(c), rf"(?i)\(\s*{L.SIMPLE_MARKING}\s*\)", "")


def strip_page_artifacts(c: Column) -> Column:
    """Without dot leaders and the page number after them; a page number after a contents entry goes too."""
    leader = r"[.·…\s]{3,}[A-Z]?-?\d+\s*$"

    def bare(text: Column) -> Column:
        entry = text.contains("\t") | text.rlike(leader) | text.rlike(L.TOC_ENTRY)
        return let(strip(F.regexp_replace(text, leader, "")), lambda x: F.when(entry, strip(F.regexp_replace(x, r"\s+\d+\s*$", ""))).otherwise(x))

    return let(blank_if_null(c), lambda text: F.when(ends_in_digit(text), bare(text)).otherwise(strip(text)))


def ends_in_digit(text: Column) -> Column:
    """Whether the last character of `text` is a digit, white space and ends of lines aside: only then a page number stands there."""
    return F.right(F.rtrim(text, F.lit(SPACES + "\u0085\u2028\u2029")), F.lit(1)).between("0", "9")


def strip_trailing_page_digits(c: Column) -> Column:
    """A title without the one to three digits stuck to its end, if letters remain."""
    text = strip(blank_if_null(c))
    title = F.regexp_extract(text, r"^(.*?)(\d{1,3})$", 1)
    return F.when(text.rlike(r"^.*?\d{1,3}$") & title.rlike(r"\p{L}"), strip(title)).otherwise(text)


def normalize_heading_candidate(c: Column) -> Column:
    bare = let(blank_if_null(c), lambda x: F.when(x.contains("[bookmark:"), F.regexp_replace(x, r"\[bookmark:[^\]]+\]", "")).otherwise(x))
    text = F.replace(bare, F.lit("[image: ]"), F.lit(""))
    return F.btrim(strip_page_artifacts(strip_classification(normalize_inline(text))), F.lit(" -:\t"))


def clean_line(c: Column) -> Column:
    """A source line without line numbers, banners, markings and word-processor errors; bullets keep their indent."""
    line = F.regexp_replace(F.regexp_replace(blank_if_null(c), "\r", ""), r"\s+$", "")
    line = F.regexp_replace(line, r"^\s*\d{3,4}\s+(?=\S)", "")
    core = F.ltrim(line)
    indent = F.length(line) - F.length(core)
    empty = (core == "") | line.rlike(L.BLANK_NUMBER_LINE) | core.rlike(L.BLANK_NUMBER_LINE) | core.rlike(L.UNCLASSIFIED_LINE)
    empty = empty | core.rlike(L.FIGURE_LINE) | core.rlike(r"^(?i)Appendices\b")
    text = F.regexp_replace(core, r"\[image:\s*\]", " ")
    text = F.regexp_replace(strip_classification_inline(text), L.REMOVED_MARK, "")
    text = F.regexp_replace(F.regexp_replace(text, L.WORD_FRAGMENTS, " "), L.FIGURE_MARK, "")
    text = strip(F.regexp_replace(text, r"\s+", " "))
    bullet = (indent > 0) & text.rlike(r"^[-*]\s+.+$")
    return F.when(empty, "").when(bullet, F.concat(F.repeat(F.lit(" "), indent), text)).otherwise(text)


def strip_margin_line_numbers(c: Column) -> Column:
    """One line of text without margin numbers; a number before a heading, contents entry, page or date stays."""
    lines = F.split(F.replace(blank_if_null(c), F.lit("\r"), F.lit("\n")), "\n")
    lines = F.filter(lines, lambda x: ~(starts_with_digit(x) & x.rlike(L.BLANK_NUMBER_LINE)))
    lines = F.transform(lines, lambda x: F.when(starts_with_digit(x), F.regexp_replace(x, L.MARGIN_NUMBER, "")).otherwise(x))
    keeps = (r"^\d+(?:\.\d+)*+\.?\s+\S", L.SECTION_HEADING, L.APPENDIX_HEADING, L.TOC_TITLE, L.TOC_ENTRY, L.PAGE_LINE, L.DATE_ONLY)

    def kept(text: Column) -> Column:
        return F.when(~starts_with_digit(text) | reduce(Column.__or__, [text.rlike(p) for p in keeps]), text).otherwise(strip(F.regexp_replace(text, r"^\d{1,4}\s+(?=\S)", "")))

    return let(let(F.array_join(lines, " "), lambda x: strip(single_blanks(x))), kept)


def starts_with_digit(text: Column) -> Column:
    """Whether the first character of `text` is a digit, white space aside."""
    return F.left(F.ltrim(text, F.lit(SPACES)), F.lit(1)).between("0", "9")


def strip_inline_markdown(c: Column) -> Column:
    text = F.regexp_replace(blank_if_null(c), r"\*\*(.*?)\*\*", "$1")
    return F.regexp_replace(F.regexp_replace(text, r"__(.*?)__", "$1"), r"`([^`]+)`", "$1")


def html_unescape(c: Column) -> Column:
    """All named and numbered entities."""
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda x: html.unescape(x) if "&" in x else x)

    return F.pandas_udf(run, "string")(blank_if_null(c))


def strip_tags(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(blank_if_null(c), r"(?s)<!--.*?-->", ""), r"<[^>]+>", "")


def compact_text(c: Column, limit: int = 700) -> Column:
    """At most `limit` characters; a cut text ends in three dots."""
    text = strip(blank_if_null(c))
    cut = F.concat(F.regexp_replace(F.substring(text, 1, limit - 3), r"\s+$", ""), F.lit("..."))
    return F.when(F.length(text) <= limit, text).otherwise(cut)


def clean_companion_text(c: Column, limit: int = 500) -> Column:
    """Compact text without table and figure labels, runs of pipes and runs of acronyms."""
    text = F.regexp_replace(blank_if_null(c), r"(?i)\b(?:Table|Figure)\s+\d+\b", " ")
    text = F.regexp_replace(text, r"\|[\s|]*", " ")
    text = F.regexp_replace(text, r"\b[A-Z]{2,}\b(?:\s+[A-Z]{2,}\b){3,}+", " ")
    return compact_text(F.regexp_replace(text, r"\s+", " "), limit)


def _tokens(c: Column, pattern: str, stop: Sequence[str]) -> Column:
    found = F.regexp_extract_all(c, F.lit(f"({pattern})"), F.lit(1))
    return F.array_except(F.array_distinct(found), F.array(*map(F.lit, stop)))


def tokens_search(c: Column) -> Column:
    return _tokens(F.lower(blank_if_null(c)), r"[a-z0-9]{3,}", L.SEARCH_STOPWORDS)


def tokens_link(c: Column) -> Column:
    return F.array_except(F.array_distinct(F.transform(F.regexp_extract_all(blank_if_null(c), F.lit(r"([A-Za-z][A-Za-z0-9/&\-]{2,})"), F.lit(1)), F.lower)), F.array(*map(F.lit, L.LINK_STOPWORDS)))


def tokens_title(c: Column) -> Column:
    words = _tokens(F.lower(blank_if_null(c)), r"[a-z0-9]+", L.TITLE_STOPWORDS)
    return F.filter(words, lambda w: F.length(w) > 2)


def slug(c: Column, limit: int = 80, default: str = "item") -> Column:
    s = F.regexp_replace(F.regexp_replace(F.lower(blank_if_null(c)), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")
    s = F.regexp_replace(F.substring(s, 1, limit), r"-+$", "")
    return F.when(s == "", default).otherwise(s)


def section_id(number: Column, title: Column) -> Column:
    return F.concat(F.lit("sec-"), slug(F.concat_ws(" ", blank_if_null(number), blank_if_null(title)), 80, "section"))


def point_id(project: Column, filename: Column, chunk: Column) -> Column:
    """Name-based UUID (version 5, URL namespace) of `project:filename:chunk`."""
    name = F.concat_ws(":", project, filename, chunk.cast("string"))
    h = F.sha1(F.concat(F.unhex(F.lit(L.URL_NAMESPACE)), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    part = lambda a, n: F.substring(h, a, n)
    return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-"), variant, part(18, 3), F.lit("-"), part(21, 12))


def document_digest(filename: Column, text: Column) -> Column:
    return F.concat(F.lit("doc-"), F.substring(F.sha2(F.concat(blank_if_null(filename), F.lit("\n"), blank_if_null(text)), 256), 1, 16))


def _with_first(number: Column, first: Column) -> Column:
    return F.concat(first.cast("string"), F.regexp_extract(number, r"^\d+(.*)$", 1))


def remap_section_number(c: Column) -> Column:
    """First part less two where it is three or more."""
    top = F.regexp_extract(blank_if_null(c), r"^(\d{1,9})(?:\.|$)", 1).try_cast("int")
    return F.when(top >= 3, _with_first(c, top - 2)).otherwise(c)


def offset_section_number(c: Column, offset: Column) -> Column:
    """First part less the offset where something above 0 remains."""
    top = F.regexp_extract(blank_if_null(c), r"^(\d{1,9})(?:\.|$)", 1).try_cast("int")
    return F.when(top - offset > 0, _with_first(c, top - offset)).otherwise(c)


ROOT_KINDS = ("APPENDIX", "ATTACHMENT", "EXHIBIT", "CDRL", "CLIN", "SECTION")


def parent_section_number(number: Column, kind: Column) -> Column:
    dotted = ~kind.isin(*ROOT_KINDS) & number.contains(".")
    return F.when(dotted, F.regexp_replace(number, r"\.[^.]*$", ""))


def section_depth(number: Column, kind: Column) -> Column:
    return F.when(kind.isin(*ROOT_KINDS), 1).otherwise(F.size(F.split(number, r"\.")))


def decimal_heading_level(token: Column) -> Column:
    """Number of parts; `1.0` is of level 1."""
    n = F.size(F.split(token, r"\."))
    return F.when((n == 2) & token.endswith(".0"), 1).otherwise(n)


def reference_level(ref: Column) -> Column:
    """Level of a reference such as L.3.2: 0 for sections, 1 without a dot, else dots + 1."""
    r = F.regexp_replace(ref, r"\.+$", "")
    return F.when(r.startswith("SECTION "), 0).otherwise(F.length(r) - F.length(F.replace(r, F.lit("."), F.lit(""))) + 1)


def is_upper_heading(c: Column, max_len: int = 140) -> Column:
    letters = F.length(F.regexp_replace(c, r"[^\p{L}]", ""))
    upper = F.length(F.regexp_replace(c, r"[^\p{Lu}]", ""))
    return (letters >= 6) & (F.length(c) <= max_len) & (F.try_divide(upper, letters) > 0.85)


def normalize_bullet(c: Column) -> Column:
    line = blank_if_null(c)
    body = strip(strip_classification_inline(F.regexp_replace(F.regexp_extract(line, r"^\s+[-*]\s+(.+)$", 1), rf"^(?i)\s*\({L.SIMPLE_MARKING}\)\s*", "")))
    indented = F.concat(F.regexp_extract(line, r"^(\s+)[-*]\s+.+$", 1), F.lit("- "), body)
    plain = strip(strip_classification_inline(F.regexp_replace(line, rf"^(?i)\s*\({L.SIMPLE_MARKING}\)\s*", "")))
    dotted = F.concat(F.lit("- "), strip(F.substring(plain, 3, 1_000_000)))
    sub = F.concat(F.lit("  - "), strip(F.regexp_replace(plain, r"^\s*o\s+", "")))
    return F.when(line.rlike(r"^\s+[-*]\s+.+$"), indented).when(plain.rlike("^[·•] "), dotted).when(plain.rlike(r"^\s*o\s+"), sub).otherwise(plain)


def expand_inline_bullets(c: Column) -> Column:
    """Array of lines: what follows an inline ` o ` before a capital letter is a sub-bullet of its own."""
    parts = F.filter(F.split(blank_if_null(c), r"\s+o\s+(?=[A-Z])"), lambda x: strip(x) != "")
    return F.transform(parts, lambda x, i: F.when(i == 0, F.regexp_replace(x, r"\s+$", "")).otherwise(F.concat(F.lit("  - "), strip(x))))


def _any_of(c: Column, terms: Sequence[str]) -> Column:
    found = F.lit(False)
    for t in terms:
        found = found | c.contains(t)
    return found


def filename_weight(c: Column) -> Column:
    name = F.lower(blank_if_null(c))
    return F.when(_any_of(name, L.POSITIVE_FILENAMES), 5).otherwise(0) - F.when(_any_of(name, L.NEGATIVE_FILENAMES), 8).otherwise(0)


def doc_priority(c: Column) -> Column:
    out: Column = F.lit(50)
    for rank, pattern in reversed(L.DOC_PRIORITIES):
        out = F.when(c.rlike("(?i)" + pattern), rank).otherwise(out)
    return F.when(blank_if_null(c) == "", 99).otherwise(out)


def is_noisy_doc(c: Column) -> Column:
    noisy = blank_if_null(c) == ""
    for pattern in L.NOISY_FILENAMES:
        noisy = noisy | F.coalesce(c.rlike("(?i)" + pattern), F.lit(False))
    return noisy


def derive_document_tags(c: Column) -> Column:
    name = F.upper(blank_if_null(c))
    letter = F.regexp_extract(name, r"APPENDIX[_\s-]*([A-Z])", 1)
    tags = F.array(F.when(letter != "", F.concat(F.lit("APPENDIX "), letter)), F.when(name.contains("IDIQ") & name.contains("PWS"), F.lit("BASE IDIQ PWS")))
    return F.array_compact(tags)


def build_normalized_requirement(c: Column) -> Column:
    """Without the leading enumerator (or first plain word)."""
    return F.regexp_replace(normalize_inline(c), r"^\(?[A-Za-z0-9.\-]+\)?\s+", "")


def classify_requirement(c: Column, types=L.REQUIREMENT_TYPES) -> Column:
    return first_match(c, types)


def classify_export_keyword(c: Column, keywords=L.TRIGGER_KEYWORDS) -> Column:
    return first_match(c, keywords)


def classify_submission(c: Column, categories=L.SUBMISSION_CATEGORIES) -> Column:
    return first_match(c, categories)


def detect_modality(c: Column, modalities=L.MODALITIES) -> Column:
    return first_match(c, modalities, F.lit("informational"))


def detect_actor(c: Column, actors=L.ACTORS) -> Column:
    return first_match(c, actors)


def is_tasking(c: Column) -> Column:
    return let(c, lambda x: found(x, [L.TASKING])[0])


def is_deliverable(c: Column) -> Column:
    return let(c, lambda x: found(x, [L.DELIVERABLE])[0])


def is_likely_pws(filename: Column, markdown: Column) -> Column:
    """Whether name or first characters say that a file is a work statement."""
    name, text = F.lower(blank_if_null(filename)), F.lower(blank_if_null(markdown))
    named = _any_of(name, ("pws", "sow", "performance work statement", "statement of work"))
    appendix = name.contains("appendix") & F.substring(text, 1, 500).contains("appendix")
    head = F.substring(text, 1, 2000)
    marked = _any_of(head, ("performance work statement", "statement of work")) & _any_of(head, ("1.0", "1 ", "appendix"))
    return named | appendix | marked


def section_refs(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(blank_if_null(c), F.lit(r"(?i)\bsections?\s+(\d+(?:\.\d+)*+)"), F.lit(1)))


def appendix_refs(c: Column) -> Column:
    """Letters named after `appendix`, one by one."""
    lists = F.regexp_extract_all(blank_if_null(c), F.lit(r"(?i)\bappendix(?:es)?\s+([A-Z](?:\s*[,\-]\s*[A-Z])*+)"), F.lit(1))
    letters = F.flatten(F.transform(lists, lambda x: F.split(F.upper(x), r"\s*[,\-]\s*")))
    return F.array_distinct(F.filter(letters, lambda x: x != ""))


def appendix_refs_ranged(c: Column) -> Column:
    """Letters of ranges such as `Appendices A - C and E`, then single ones, in order of first mention."""
    text = blank_if_null(c)
    # one character class instead of a repeated group: long runs of words must not deepen the matcher's stack
    whole = r"(?i)\bAppendices?\s+([A-Z])\s*[–\-]\s*([A-Z])([A-Z\s,]*)(?:&\s*([A-Z]))?"
    groups = [F.regexp_extract_all(text, F.lit(whole), F.lit(k)) for k in (1, 2, 3, 4)]
    rows = F.arrays_zip(*[g.alias(f"g{k}") for k, g in enumerate(groups)])

    def letters(r: Column) -> Column:
        a, b = F.ascii(F.upper(r["g0"])), F.ascii(F.upper(r["g1"]))
        span = F.transform(F.sequence(F.least(a, b), F.greatest(a, b)), lambda x: F.char(x))
        more = F.regexp_extract_all(F.coalesce(r["g2"], F.lit("")), F.lit(r"([A-Z])"), F.lit(1))
        last = F.filter(F.array(F.upper(F.coalesce(r["g3"], F.lit("")))), lambda x: x != "")
        return F.concat(span, more, last)

    single = F.transform(F.regexp_extract_all(text, F.lit(r"(?i)\bAppendix\s+([A-Z])\b"), F.lit(1)), F.upper)
    return F.array_distinct(F.concat(F.flatten(F.transform(rows, letters)), single))


def overlap_score(a: Column, b: Column) -> Column:
    """Share of the first set's elements that the second has; 0 if either is empty."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(a)).otherwise(0.0)


def overlap_ratio(a: Column, b: Column) -> Column:
    """Shared elements by the size of the second set."""
    return overlap_score(b, a)
