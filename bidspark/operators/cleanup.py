"""Import clean-up: from the raw text of a document to Markdown lines with headings.

Lines are cleaned by Column functions; what a line is worth then depends on its neighbours and on the titles that the
document names anywhere, so a document's lines go through passes over a list, each linear in the text. Known titles are
found inside lines by one automaton for all of them. Documents come in Arrow batches of bounded size; none is moved.

A null text has no lines; a document without any heading keeps its lines as prose. Of titles that begin near a line's start the
longest wins, then the one named first.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bidspark.functions import lexicons as L
from bidspark.functions import text as T
from bidspark.functions.arrow import bounded

_NUMBERED = re.compile(L.OUTLINE_NUMBERED)
_LEADER = re.compile(L.OUTLINE_LEADER)
_MARK = re.compile(rf"^\s*\({L.SIMPLE_MARKING}\)\s*|\(\s*{L.SIMPLE_MARKING}\s*\)", re.IGNORECASE)
_APPENDIX, _CONTENTS, _DUTY, _GENERIC, _CAPTION = (re.compile(p, re.IGNORECASE) for p in (L.IMPORT_APPENDIX, L.IMPORT_CONTENTS, L.IMPORT_DUTY, L.IMPORT_GENERIC, L.IMPORT_CAPTION))
_BULLET, _SUB_BULLET, _STUCK_PAGE, _WRAP_END, _WRAP_START, _START = (re.compile(p) for p in (L.IMPORT_BULLET, L.IMPORT_SUB_BULLET, L.IMPORT_STUCK_PAGE, L.IMPORT_WRAP_END, L.IMPORT_WRAP_START, L.IMPORT_START))


def _bare(text: str) -> str:
    return _MARK.sub("", text).strip()


def _title(text: str) -> str:
    """A title without its marking and without page digits stuck to its end."""
    t = _bare(text)
    m = _STUCK_PAGE.fullmatch(t)
    return m[1].strip() if m and re.search("[A-Za-z]", m[1]) else t


@dataclass(slots=True)
class Line:
    """A cleaned line: its text, its kind, and number and title if it is a heading. firm: a heading by its look, not by the number alone."""

    text: str
    kind: str  # blank, heading, bullet, duty, generic, prose
    number: str = ""
    title: str = ""
    firm: bool = False

    @property
    def parts(self) -> int:
        return self.number.count(".") + 1

    @property
    def short(self) -> bool:
        return len(self.text.split()) <= L.IMPORT_SHORT_TITLE

    def markdown(self) -> str:
        depth = min(self.parts, 6) if self.number[:1].isdigit() else 1
        return f"{'#' * depth} {self.number} {self.title}".strip()


def heading(number: str, title: str) -> Line:
    return Line(f"{number} {title}", "heading", number, title, True)


def read(text: str) -> Line:
    if not text:
        return Line(text, "blank")
    if m := _APPENDIX.match(text):
        return Line(text, "heading", f"Appendix {m[1].upper()}", _bare(m[2]), True)
    m = _NUMBERED.match(text)
    if m and not _LEADER.search(text):
        firm = m[2][0].isupper() or m[2].startswith("(")
        if not (firm and _CAPTION.match(_bare(m[2]))):
            return Line(text, "heading", m[1], _title(m[2]), firm)
    bare = _bare(text)
    for kind, pattern, said in (("bullet", _BULLET, text), ("bullet", _SUB_BULLET, bare), ("duty", _DUTY, bare), ("generic", _GENERIC, bare)):
        if pattern.match(said):
            return Line(text, kind)
    return Line(text, "prose")


class Titles:
    """The titles of a document with their numbers, and an automaton that finds all of them in a line at once."""

    def __init__(self, lines: list[Line]):
        named: dict[str, list[str]] = {}
        for x in lines:
            if x.firm and x.number[:1].isdigit() and x.title and not _LEADER.search(x.text):
                named.setdefault(x.title, []).append(x.number)
        self.first = {t: n[0] for t, n in named.items()}
        self.last = {t: n[-1] for t, n in named.items()}
        self.order = sorted(named, key=len, reverse=True)
        self.automaton = ahocorasick.Automaton()
        for k, t in enumerate(self.order):
            self.automaton.add_word(t, k)
        if self.order:
            self.automaton.make_automaton()

    def inside(self, line: str) -> tuple[int, str, str] | None:
        """(start, title, number) of the known title that `line` begins with, or nearly: words follow it. A line that names two
        appendices may have a top title anywhere."""
        if not self.order:
            return None
        starts: dict[int, int] = {}
        for end, k in self.automaton.iter(line):
            at = end + 1 - len(self.order[k])
            apart = not at or not (line[at - 1].isascii() and line[at - 1].isalnum())
            if apart and line[end + 1 : end + 2].isspace():
                starts.setdefault(k, at)
        near = [k for k, at in starts.items() if at <= L.IMPORT_TITLE_REACH]
        if not near and line.count("Appendix ") > 1:
            near = [k for k in starts if "." not in self.first[self.order[k]]]
        if not near:
            return None
        t = self.order[min(near)]
        return starts[min(near)], t, self.first[t]


def _following(lines: list[Line]) -> list[int]:
    """For each line the next one that isn't blank."""
    out, at = [len(lines)] * len(lines), len(lines)
    for k in range(len(lines) - 1, -1, -1):
        out[k] = at
        if lines[k].kind != "blank":
            at = k
    return out


def _without_contents(lines: list[Line]) -> list[Line]:
    """Contents lists end at the first numbered heading 1 or 1.1; lines with a page leader are entries anywhere."""
    out, inside = [], False
    for x in lines:
        entry = bool(_LEADER.search(x.text))
        inside = (inside or bool(_CONTENTS.match(x.text))) and not (x.firm and x.number in ("1", "1.1") and not entry)
        if not inside and not entry:
            out.append(x)
    return out


def _pages_at_end(lines: list[Line]) -> list[int]:
    return [k for k, x in enumerate(lines) if x.firm and x.number[:1].isdigit() and _STUCK_PAGE.fullmatch(x.text) and x.text[-1].isdigit() and re.search(r"[A-Za-z]\d{1,3}$", x.text)]


def _from_body(lines: list[Line], titles: Titles) -> list[Line]:
    """Lines from the first real heading on: 1 or 1.1 with text soon after it, a top title alone with text after it, or a line that
    begins with a title."""
    says = [x.kind not in ("blank", "heading") for x in lines]
    texted = lambda k: any(says[k + 1 : k + 9])
    for k, x in enumerate(lines):
        if x.firm and x.number in ("1", "1.1") and texted(k):
            return lines[k:]
    for k, x in enumerate(lines):
        if "." not in titles.first.get(x.text, ".") and texted(k):
            return lines[k:]
    return next((lines[k:] for k, x in enumerate(lines) if titles.inside(x.text)), lines)


def _duties(lines: list[Line]) -> list[tuple[str, int, bool] | None]:
    """For a line before `The Contractor Shall` and a heading a.b.c...: (the heading's parent number, where the duty stands,
    whether no blank line parts the three)."""
    after = _following(lines)
    out: list[tuple[str, int, bool] | None] = []
    for k, x in enumerate(lines):
        j = after[k]
        child = after[j] if x.kind in ("prose", "generic") and j < len(lines) and lines[j].kind == "duty" else len(lines)
        if child < len(lines) and lines[child].number[:1].isdigit() and lines[child].parts >= 3:
            out.append((lines[child].number.rpartition(".")[0], j, child == k + 2))
        else:
            out.append(None)
    return out


def _promoted(lines: list[Line]) -> list[Line]:
    """`The following requirements apply` before duties: the short title just above becomes the heading in its place."""
    out: list[Line] = []
    for x, duty in zip(lines, _duties(lines), strict=True):
        if x.kind == "generic" and duty:
            for k in range(len(out) - 1, max(len(out) - 1 - L.IMPORT_LOOK_BACK, -1), -1):
                if out[k].kind in ("heading", "bullet"):
                    k = -1
                    break
                if out[k].kind != "blank" and out[k].short:
                    break
            else:
                k = -1
            if k >= 0:
                out[k] = heading(duty[0], _bare(out[k].text))
                continue
        out.append(x)
    return out


def _named(lines: list[Line], titles: Titles) -> list[Line]:
    """Known titles become headings where they stand alone with text below, or begin a line, whose rest follows; text right below
    a heading may begin with its title."""
    duties = _duties(lines)
    out: list[Line] = []
    above = ""  # the last line that isn't blank
    for k, x in enumerate(lines):
        number = titles.last.get(x.text, "") if x.kind in ("prose", "generic") else ""
        if not number and duties[k] and duties[k][2] and lines[k + 2].firm:
            number = duties[k][0]
        below = lines[k + 1].kind if k + 1 < len(lines) else "blank"
        if number and (below in ("prose", "generic") or below == "duty" and k + 2 < len(lines) and lines[k + 2].kind != "blank") and above != f"{number} {x.text}":
            out.append(heading(number, x.text))
        elif x.kind in ("prose", "generic", "duty") and (hit := titles.inside(x.text)) and above != f"{hit[2]} {hit[1]}":
            at, title, number = hit
            out.append(heading(number, title))
            rest = x.text[at + len(title) :].strip()
            out += [read(rest)] if rest else []
        else:
            out.append(x)
        above = out[-1].text or above
    return out


def _with_parents(lines: list[Line]) -> list[Line]:
    """A title before duties becomes the heading above their numbers: a short one always, a longer one if it stands right before
    them and no heading near by has that number. A generic line takes the short title nearest above it, if there is one."""
    out: list[Line] = []
    done = -1
    for k, (x, duty) in enumerate(zip(lines, _duties(lines), strict=True)):
        if k <= done:
            continue
        if duty and x.short:
            above = (y.text for y in reversed(out[-L.IMPORT_LOOK_BACK :]) if y.kind == "prose" and y.short)
            x, done = heading(duty[0], _bare(next(above, x.text) if x.kind == "generic" else x.text)), duty[1]
        elif duty and duty[2]:
            done = duty[1]
            if all(y.number != duty[0] for y in out[-L.IMPORT_SEEN :]):
                x = heading(duty[0], _bare(x.text))
        out.append(x)
    return out


def _markdown(lines: list[Line]) -> list[str]:
    """Markdown lines: headings apart, bullets with their indent, wrapped prose joined."""
    out: list[str] = []
    for x in lines:
        if x.kind == "heading":
            out += ([""] if out and out[-1] else []) + [x.markdown(), ""]
        elif x.kind == "blank":
            out += [""] if out and out[-1] else []
        elif x.kind == "duty" or x.text.lower() == L.IMPORT_NO_TABLE:
            continue
        elif x.kind == "bullet":
            m = _BULLET.match(x.text)
            indent, body = (m[1], m[2]) if m else ("  ", _SUB_BULLET.sub("", _bare(x.text)))
            first, *subs = re.split(L.IMPORT_INLINE_BULLET, _bare(body))
            out += [f"{indent}- {first.strip()}", *(f"  - {s.strip()}" for s in subs if s.strip())]
        else:
            first, *subs = re.split(L.IMPORT_INLINE_BULLET, _bare(x.text))
            first = first.strip()
            if first and out and out[-1] and not out[-1].lstrip().startswith(("#", "- ")) and _WRAP_END.search(out[-1]) and _WRAP_START.match(first):
                out[-1] = f"{out[-1]} {first}"
            elif first:
                out.append(first)
            out += [f"  - {s.strip()}" for s in subs if s.strip()]
    while out and not out[-1]:
        out.pop()
    return out[next((k for k, s in enumerate(out) if _START.match(s)), 0) :]


def prepared(raw: list[str]) -> list[str]:
    """Markdown lines of one document from its cleaned lines."""
    lines = [read(x) for x in raw]
    titles = Titles(lines)
    body = _without_contents(lines)
    top = [x for x in body[: L.IMPORT_STRONG_LINES] if x.firm and x.number[:1].isdigit()]
    paged = _pages_at_end(body)
    listed = 2 * len([k for k in paged if k < L.IMPORT_STRONG_LINES]) > len(top)
    strong = not listed and (len(top) >= L.IMPORT_STRONG_HEADINGS or sum(x.parts == 1 for x in top) >= L.IMPORT_STRONG_ROOTS)
    if listed:  # a contents list without its title: only what follows it is body
        body = body[paged[-1] + 1 :]
    body = _promoted(_from_body(body, titles))
    if not strong:
        body = _named(body, titles)
    return _markdown(_with_parents(body))


def prepare_outline_lines(documents: DataFrame, col: str = "raw_text") -> DataFrame:
    """Replaces `col` by `lines`, the Markdown lines of each document after the clean-up."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda x: prepared(list(x)))

    cleaned = F.transform(F.split(F.regexp_replace(T.blank_if_null(col), r"\r\n?", "\n"), "\n"), T.clean_line)
    return bounded(documents).withColumn("lines", F.pandas_udf(run, "array<string>")(cleaned)).drop(col)
