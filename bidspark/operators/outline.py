"""Outline nodes of Markdown documents: a fold over lines, where what a line means depends on those before it.

Documents come in Arrow batches of bounded size, and none is moved.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bidspark.functions import lexicons as L
from bidspark.functions.arrow import bounded

_NUMBER, _BULLET, _ORDERED, _INLINE, _LISTED = (re.compile(p) for p in (L.OUTLINE_NUMBER, L.OUTLINE_BULLET, L.OUTLINE_ORDERED, L.OUTLINE_INLINE_ITEM, L.OUTLINE_LIST_MARKER))
_IMAGE, _IMAGE_FILE, _BARE_NUMBER, _MARGIN, _PLAIN_MARGIN = (re.compile(p) for p in (L.OUTLINE_IMAGE_LINE, L.OUTLINE_IMAGE_FILE, L.BLANK_NUMBER_LINE, L.MARGIN_NUMBER, L.OUTLINE_MARGIN))
#: How a line may show that it is a heading, and what its title then must not look like; the first form that fits decides.
_FORMS = tuple((re.compile(form), tuple(map(re.compile, never))) for form, never in ((L.OUTLINE_HASH, (L.OUTLINE_LEADER,)), (L.OUTLINE_BOLD, (L.OUTLINE_LEADER,)), (r"^(.+)$", (L.OUTLINE_LEADER, L.OUTLINE_SENTENCE))))


def _outline_heading(line: str) -> tuple[str, str] | None:
    """(number, title) of a heading line."""
    text = line.strip()
    for form, never in _FORMS:
        if shown := form.match(text):
            named = _NUMBER.match(" ".join(shown[shown.lastindex].split()))
            return (named[1], named[2]) if named and not any(p.search(named[2]) for p in never) else None
    return None


@dataclass
class _Outline:
    """Nodes of one document as they are found."""

    nodes: list[dict] = field(default_factory=list)
    stack: list[str] = field(default_factory=list)
    section: str = ""
    paragraph: str = ""
    paragraphs: int = 0
    bullets: int = 0
    open_bullets: list[tuple[int, str]] = field(default_factory=list)
    lines: list[str] = field(default_factory=list)
    levels: dict[str | None, int] = field(default_factory=dict)

    def add(self, node_id: str, parent: str | None, kind: str, text: str = "", **more) -> None:
        base = {"node_id": node_id, "parent_id": parent, "node_type": kind, "section_number": None, "section_title": None, "depth": 0, "marker": "", "indent": 0, "text": text, "content": ""}
        self.levels[node_id] = level = self.levels.get(parent, 0) + 1
        self.nodes.append(base | more | {"position": len(self.nodes), "level": level})

    def flush(self) -> None:
        if self.lines and self.section:
            self.paragraphs, self.bullets, self.open_bullets = self.paragraphs + 1, 0, []
            self.paragraph = f"{self.section}.p{self.paragraphs}"
            text = " ".join(" ".join(self.lines).split())
            marks = [] if text.count("|") >= L.OUTLINE_TABLE_PIPES else list(_INLINE.finditer(text))
            if len(marks) < 2 or not all(_LISTED.match(m[1]) for m in marks):
                marks = []
            self.add(self.paragraph, self.section, "paragraph", text[: marks[0].start()].strip() if marks else text, content="\n".join(self.lines))
            for k, m in enumerate(marks):
                end = marks[k + 1].start() if k + 1 < len(marks) else len(text)
                self.add(f"{self.paragraph}.i{k + 1}", self.paragraph, "bullet", text[m.end() : end].strip(), marker=m[1])
        self.lines = []

    def head(self, number: str, title: str) -> None:
        self.flush()
        depth = len(number.split("."))
        while self.stack and len(self.stack[-1].split(".")) >= depth:
            self.stack.pop()
        self.add(number, self.stack[-1] if self.stack else None, "section", section_number=number, section_title=title, depth=depth)
        self.stack.append(number)
        self.section, self.paragraph, self.paragraphs, self.bullets, self.open_bullets = number, "", 0, 0, []

    def bullet(self, indent: int, marker: str, body: str) -> None:
        self.flush()
        if not self.section:
            return
        if not self.paragraph:
            self.paragraph = f"{self.section}.p{max(self.paragraphs, 1)}"
            self.add(self.paragraph, self.section, "paragraph")
        self.bullets += 1
        node = f"{self.section}.p{max(self.paragraphs, 1)}.b{self.bullets}"
        while self.open_bullets and self.open_bullets[-1][0] >= indent:
            self.open_bullets.pop()
        self.add(node, self.open_bullets[-1][1] if self.open_bullets else self.paragraph, "bullet", " ".join(body.split()), marker=marker, indent=indent, content=body)
        self.open_bullets.append((indent, node))


def outlined(markdown: str | None) -> list[dict]:
    """Flat nodes of one Markdown document; without any heading all hangs below a section DOC."""
    lines = [_MARGIN.sub("", html.unescape(x)).rstrip() for x in (markdown or "").splitlines() if not _BARE_NUMBER.match(x) and not _IMAGE.match(x)]
    lines = ["" if _IMAGE_FILE.match(x) else x for x in lines]
    doc = _Outline()
    if not any(_outline_heading(x) for x in lines) and any(x.strip() for x in lines):
        doc.head("DOC", "Imported Document")
    for line in lines:
        if not line.strip():
            doc.flush()
        elif doc.section != "DOC" and (h := _outline_heading(line)):
            doc.head(*h)
        elif m := _BULLET.match(line):
            doc.bullet(len(m[1]), "-", m[2])
        elif (m := _ORDERED.match(line.strip())) and _LISTED.match(m[1]):
            doc.bullet(len(line) - len(line.lstrip()), m[1], m[2])
        else:
            doc.lines.append(_PLAIN_MARGIN.sub("", line).strip())
    doc.flush()
    return doc.nodes


NODE = "node_id string, parent_id string, node_type string, section_number string, section_title string, depth int, position int, marker string, indent int, text string, content string, level int"


def outline_nodes(documents: DataFrame, col: str = "markdown") -> DataFrame:
    """A row per section, paragraph and bullet of each document, in order of `position`; level is the depth in the tree, content the
    lines of a paragraph or bullet as they stood."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(outlined)

    rest = [c for c in documents.columns if c != col]
    nodes = F.explode(F.pandas_udf(run, f"array<struct<{NODE}>>")(col))
    return bounded(documents).select(*rest, nodes.alias("x")).select(*rest, "x.*")
