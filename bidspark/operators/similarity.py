"""Related requirements and links between documents."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from bidspark.functions import text as T
from bidspark.sources.tables import staged

FIELDS = ("filename", "section_number", "section_heading", "heading_path", "requirement_text", "modality", "actor", "action", "object_text")


def _prepared(df: DataFrame, prefix: str) -> DataFrame:
    text = F.coalesce(F.when(F.col("normalized_requirement_text") != "", F.col("normalized_requirement_text")), F.col("requirement_text"), F.lit("")) if "normalized_requirement_text" in df.columns else T.blank_if_null("requirement_text")
    place = F.upper(F.concat_ws(" ", T.blank_if_null("filename"), T.blank_if_null("section_heading"), T.blank_if_null("heading_path")))
    asked = F.coalesce(F.when(F.col("query_text") != "", F.col("query_text")), text) if "query_text" in df.columns else text
    query = [T.tokens_search(asked).alias("asked")] if "query_text" in df.columns else []  # else the same as tokens, and not carried twice
    named = df.select("project_id", F.col("id").cast("string").alias("id"), *[T.blank_if_null(c).alias(c) for c in FIELDS], T.tokens_search(text).alias("tokens"), *query, T.tokens_search(F.col("object_text")).alias("object_tokens"), T.section_refs(asked).alias("refs"), T.appendix_refs(asked).alias("appendices"), place.alias("place"))
    return named.select("project_id", *[F.col(c).alias(f"{prefix}{c}") for c in named.columns if c != "project_id"])


#: Points of a term that query and candidate share, and of one that source and candidate share; a source without a query is its own.
ASKED, OWN = 4, 1


def ad_hoc_sources(texts: DataFrame) -> DataFrame:
    """Sources that are no requirements: project_id, source_text and, if there, id and query_text; all other fields are blank."""
    blank = [F.lit("").alias(c) for c in FIELDS if c not in ("filename", "requirement_text")]
    name = F.col("id").cast("string") if "id" in texts.columns else F.lit("ad-hoc-source")
    query = [F.col("query_text")] if "query_text" in texts.columns else []
    return texts.select("project_id", name.alias("id"), F.lit("Ad hoc source").alias("filename"), *blank, F.col("source_text").alias("requirement_text"), *query)


def score_pairs(pairs: DataFrame) -> DataFrame:
    """Adds score and reasons (first three) to pairs of prepared sources (s_) and candidates (c_).

    Terms, sections and appendices are those of the source's query_text, if it has one; its own text counts besides.
    """
    shared = F.array_sort(F.array_intersect("s_asked" if "s_asked" in pairs.columns else "s_tokens", "c_tokens"))
    objects = F.array_sort(F.array_intersect("s_object_tokens", "c_object_tokens"))
    both = lambda c: (F.col(f"s_{c}") != "") & (F.col(f"s_{c}") == F.col(f"c_{c}"))
    number = F.col("c_section_number")
    exact = (number != "") & F.array_contains("s_refs", number)
    family = (number != "") & F.exists("s_refs", lambda r: number.startswith(F.concat(r, F.lit("."))) | r.startswith(F.concat(number, F.lit("."))))
    appendix = F.exists("s_appendices", lambda a: F.col("c_place").contains(F.concat(F.lit("APPENDIX "), a)) | F.col("c_place").contains(F.concat(F.lit("APPENDIX_"), a)))
    weight = T.filename_weight(F.col("c_filename"))
    points = lambda cond, n: F.when(cond, n).otherwise(0)
    score = F.size(shared) * ASKED + F.size(F.array_intersect("s_tokens", "c_tokens")) * OWN + points(both("modality"), 2) + points(both("actor"), 2) + points(both("action"), 3) + F.size(objects) * 3
    score = score + F.when(exact, 14).when(family, 6).otherwise(0) + points(appendix, 10) + weight + points(both("section_number"), 1) + points(both("filename"), 1)
    score = F.when(F.size("c_tokens") == 0, 0).otherwise(score).cast("double")
    say = lambda cond, text: F.when(cond, text)
    words = lambda a, n: F.array_join(F.slice(a, 1, n), ", ")
    said = lambda shared, objects: F.array_compact(F.array(
        say(F.size(shared) > 0, F.concat(F.lit("shared terms: "), words(shared, 5))), say(both("modality"), F.concat(F.lit("same modality: "), "c_modality")), say(both("actor"), F.concat(F.lit("same actor: "), "c_actor")), say(both("action"), F.concat(F.lit("same action: "), "c_action")),
        say(F.size(objects) > 0, F.concat(F.lit("shared object terms: "), words(objects, 4))), say(exact, F.concat(F.lit("section "), number)), say(family & ~exact, F.lit("section family")), say(appendix, F.lit("appendix")), say(weight > 0, F.lit("priority document")), say(weight < 0, F.lit("administrative template")),
    ))
    reasons = T.let(shared, lambda x: T.let(objects, lambda y: said(x, y)))  # terms are met once
    text = T.let(reasons, lambda x: F.when(F.size(x) > 0, F.array_join(F.slice(x, 1, 3), "; ")).otherwise("text overlap"))
    return pairs.withColumns({"score": score, "match_reason": text, "weight": weight})


def score_related(sources: DataFrame, requirements: DataFrame) -> DataFrame:
    """Scores of all candidates of its project for each source: linear in the candidates, for few sources."""
    return score_pairs(_prepared(sources, "s_").join(_prepared(requirements, "c_"), "project_id"))


CELL = 8192  # paragraphs, and snippets, that meet in a task
AT_ONCE = 1024  # paragraphs, or sources, of a cell that are compared at once
SOURCES, CANDIDATES = 8, 2  # cells of related requirements have so many times CELL sources and candidates; the sources stream past
SETS = ("tokens", "asked", "objects", "numbers", "above", "letters")


def _coded(df: DataFrame, prefix: str) -> DataFrame:
    """A prepared side as numbers: sets as arrays of hashes, equal fields as hashes (0 for an empty one)."""
    hashes = lambda c: F.transform(c, lambda x: F.xxhash64(x))
    col = lambda c: F.col(f"{prefix}{c}")
    code = lambda c: F.when(col(c) == "", 0).otherwise(F.xxhash64(col(c)))
    parts = lambda x: F.split(x, r"\.")
    up = lambda x: F.transform(F.sequence(F.lit(1), F.size(parts(x))), lambda k: F.array_join(F.slice(parts(x), F.lit(1), k), "."))
    proper = lambda x: F.slice(up(x), F.lit(1), F.size(parts(x)) - 1)
    if prefix == "s_":
        numbers, above = col("refs"), F.array_distinct(F.flatten(F.transform(col("refs"), proper)))
        letters = col("appendices")
    else:
        numbers = F.filter(F.array(col("section_number")), lambda x: x != "")
        above = F.when(col("section_number") != "", proper(col("section_number"))).otherwise(F.array().cast("array<string>"))
        letters = F.array_distinct(F.regexp_extract_all(col("place"), F.lit("APPENDIX[ _](.)"), F.lit(1)))
    asked = col("asked") if "s_asked" in df.columns and prefix == "s_" else F.array().cast("array<string>")  # none: the same as tokens
    sets = dict(zip(SETS, (col("tokens"), asked, col("object_tokens"), numbers, above, letters), strict=True))
    return df.select("project_id", col("id").alias("id"), col("filename").alias("filename"), T.filename_weight(col("filename")).cast("long").alias("weight"), *[hashes(c).alias(n) for n, c in sets.items()], *[code(c).alias(c if c != "filename" else "file") for c in ("modality", "actor", "action", "section_number", "filename")])


def _common(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Shared elements of each set of a with each set of b: frequent elements by products of matrices, rare ones pair by pair."""
    rows = [np.repeat(np.arange(len(x)), np.diff(np.asarray(x.offsets))) for x in (a, b)]
    keys = [np.asarray(x.flatten()) for x in (a, b)]
    out = np.zeros((len(a), len(b)), np.float32)
    both = np.intersect1d(*[np.unique(k) for k in keys])
    if not len(both):
        return out
    seats, starts, counts = [], [], []
    for r, k in zip(rows, keys, strict=True):  # the sets that hold each element, element by element
        at = np.minimum(np.searchsorted(both, k), len(both) - 1)
        on = both[at] == k
        order = np.argsort(at[on], kind="stable")
        n = np.bincount(at[on], minlength=len(both))
        seats.append(r[on][order])
        starts.append(np.cumsum(n) - n)
        counts.append(n)
    pairs = counts[0] * counts[1]
    dense = pairs * PAIR_COST > len(a) * len(b)
    flat = out.reshape(-1)
    rare = np.flatnonzero(~dense)
    for part in np.split(rare, np.searchsorted(np.cumsum(pairs[rare]), np.arange(1, 1 + int(pairs[rare].sum()) // PAIRS) * PAIRS)):
        n, m = pairs[part], counts[1][part]
        k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        each = lambda x: np.repeat(x, n)  # noqa: B023, E731
        left, right = seats[0][each(starts[0][part]) + k // each(m)], seats[1][each(starts[1][part]) + k % each(m)]
        np.add.at(flat, left * len(b) + right, np.float32(1))
    common = np.flatnonzero(dense)
    for lo in range(0, len(common), 1024):
        part = common[lo : lo + 1024]
        hot = []
        for seat, first, n, size in zip(seats, starts, counts, (len(a), len(b)), strict=True):
            m = np.zeros((size, len(part)), np.float32)
            k = np.repeat(np.arange(len(part)), n[part])
            m[seat[np.repeat(first[part], n[part]) + np.arange(len(k)) - np.repeat(np.cumsum(n[part]) - n[part], n[part])], k] = 1
            hot.append(m)
        out += hot[0] @ hot[1].T
    return out


#: A pair of a rare element takes as long as this many products of matrices; pairs are written out so many at a time.
PAIR_COST, PAIRS = 400, 1 << 20


def _postings(sets: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The different elements, sorted; the rows that hold them, element by element, and where each one's start; and element and row as
    one number, sorted."""
    x = np.asarray(sets.flatten())
    order = np.argsort(x, kind="stable")
    x, rows = x[order], np.repeat(np.arange(len(sets)), np.diff(np.asarray(sets.offsets)))[order]
    new = np.flatnonzero(np.diff(x, prepend=x[:1] ^ 1))
    edges = np.append(new, len(x))
    return x[new], rows, edges, np.repeat(np.arange(len(new)), np.diff(edges)) * len(sets) + rows


def _known(sets: pa.Array, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The elements of the sets that are among the keys, as places there, and where each set's start."""
    x, edges = np.asarray(sets.flatten()), np.asarray(sets.offsets)
    at = np.searchsorted(keys, x)
    on = at < len(keys)
    on[on] = keys[at[on]] == x[on]
    return at[on], np.concatenate([[0], np.cumsum(on)])[edges - edges[0]]


def _meet(sets: pa.Array, index: tuple, n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Whether set left[i] shares an element with the indexed set right[i] of n."""
    keys, _, _, both = index
    out = np.zeros(len(left), bool)
    codes, edges = _known(sets, keys)
    if len(codes):
        size = np.diff(edges)[left]
        pair = np.repeat(np.arange(len(left)), size)
        element = codes[np.repeat(edges[left] - np.cumsum(size) + size, size) + np.arange(len(pair))]
        want = element * n + right[pair]
        out[pair[both[np.minimum(np.searchsorted(both, want), len(both) - 1)] == want]] = True
    return out


FIELD_POINTS = (("modality", 2), ("actor", 2), ("action", 3), ("section_number", 1), ("file", 1))
#: Candidates with the most terms that are looked at first: what the best of them reach, all others must be able to reach.
FIRST = 512
#: Terms that more than one in COMMON candidates has, DENSE at most, are no lists but bits, which only candidates that may be among the best are asked for.
COMMON, DENSE = 16, 512


def _bits(rows: np.ndarray, places: np.ndarray, n: int) -> np.ndarray:
    """n rows of DENSE bits, with those at (rows, places) set."""
    out = np.zeros((n, DENSE), bool)
    out[rows, places] = True
    return np.packbits(out, axis=1).view(np.uint64)


def _best_of_cells(it: Iterator[pa.RecordBatch], limit: int, queried: bool) -> Iterator[pa.RecordBatch]:
    """The best candidates of each source in each cell; rows come sorted by cell, candidates first, and by filename and id.

    Shared terms are counted through lists of the rows that hold a term, common ones by bits. Only candidates whose terms, with all other points that the
    source could get, reach the least of the best are scored in full; so the best are exact.
    """
    num = lambda x, n: np.asarray(x.column(n))
    col = lambda x, n: x.column(n).combine_chunks() if isinstance(x.column(n), pa.ChunkedArray) else x.column(n)

    def indexed(rest: list[pa.RecordBatch]) -> dict | None:
        c = pa.Table.from_batches(rest).combine_chunks()
        c = c.filter(pa.array(np.diff(np.asarray(col(c, "tokens").offsets)) > 0)).combine_chunks()  # without a term none scores
        if not len(c):
            return None
        own: dict[str, list[int]] = {}
        for k, x in enumerate(c.column("id").to_pylist()):
            own.setdefault(x, []).append(k)
        first = np.argsort(-np.diff(np.asarray(col(c, "tokens").offsets)), kind="stable")[: max(FIRST, 2 * limit)]
        index = {"rows": c, "own": own, "first": first, "weight": num(c, "weight")} | {n: _postings(col(c, n)) for n in SETS if n != "asked"}
        _, rows, edges, _ = index["tokens"]
        n = np.diff(edges)
        common = np.argsort(-n, kind="stable")[:DENSE]
        common = common[n[common] * COMMON > len(c)]
        place = np.full(len(n), -1)
        place[common] = np.arange(len(common))
        which = np.repeat(place, n)
        bits = _bits(rows[which >= 0], which[which >= 0], len(c))
        return index | {"place": place, "bits": bits, "first_bits": bits[first]}

    def compared(s: pa.RecordBatch, c: dict) -> Iterator[pa.RecordBatch]:
        n, weight, first, ids = len(c["rows"]), c["weight"], c["first"], s.column("id").to_pylist()
        kinds = [("tokens", "tokens", OWN if queried else OWN + ASKED), ("objects", "objects", 3), *([("asked", "tokens", ASKED)] if queried else [])]
        terms, common, free = [], [], np.zeros(len(s), np.int64)
        for a, of, points in kinds:
            keys, rows, starts, _ = c[of]
            if not len(keys):
                continue
            codes, edges = _known(col(s, a), keys)
            if of == "tokens":
                seat, place = np.repeat(np.arange(len(s)), np.diff(edges)), c["place"][codes]
                common.append((_bits(seat[place >= 0], place[place >= 0], len(s)), points))
                free += points * np.bincount(seat[place >= 0], minlength=len(s))
                codes, edges = codes[place < 0], np.concatenate([[0], np.cumsum(place < 0)])[edges]
            terms.append((rows, starts[codes].tolist(), starts[codes + 1].tolist(), edges.tolist(), points))
        shared = lambda i, bits: sum(points * np.bitwise_count(bits & x[i]).sum(1, dtype=np.int64) for x, points in common)
        more = sum(np.where(num(s, f) != 0, points, 0) for f, points in FIELD_POINTS) + weight.max()
        more = more + sum(np.where(np.diff(np.asarray(col(s, f).offsets)) > 0, points, 0) for f, points in (("numbers", 14), ("above", 6), ("letters", 10)))
        held: list[tuple[int, np.ndarray, np.ndarray]] = []
        pairs = 0
        for i in range(len(s)):
            base = None
            for rows, starts, ends, edges, points in terms:
                a, b = edges[i], edges[i + 1]
                if b > a:
                    x = points * np.bincount(np.concatenate([rows[k:m] for k, m in zip(starts[a:b], ends[a:b], strict=True)]), minlength=n)
                    base = x if base is None else base + x
            base = np.zeros(n, np.int64) if base is None else base
            for k in c["own"].get(ids[i], ()):
                base[k] = np.iinfo(np.int32).min
            least = max(1, int(np.partition(base[first] + shared(i, c["first_bits"]) + weight[first], -limit)[-limit])) if len(first) >= limit else 1
            at = np.flatnonzero(base >= least - more[i] - free[i])
            full = base[at] + shared(i, c["bits"][at])
            able = full >= least - more[i]
            held.append((i, at[able], full[able]))
            pairs += len(held[-1][1])
            if pairs > PAIRS:
                yield scored(s, c, held)
                held, pairs = [], 0
        if held:
            yield scored(s, c, held)

    def scored(s: pa.RecordBatch, c: dict, held: list[tuple[int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        rows, n = c["rows"], len(c["rows"])
        left = np.repeat([i for i, _, _ in held], [len(x) for _, x, _ in held])
        right, score = (np.concatenate([h[k] for h in held]) for k in (1, 2))
        weight = c["weight"][right]
        meet = lambda a, b: _meet(col(s, a), c[b], n, left, right)
        score = score + weight + np.where(meet("numbers", "numbers"), 14, np.where(meet("numbers", "above") | meet("above", "numbers"), 6, 0)) + 10 * meet("letters", "letters")
        for f, points in FIELD_POINTS:
            x = num(s, f)[left]
            score += points * ((x != 0) & (x == num(rows, f)[right]))
        order = np.lexsort((right, -weight, -score, left))
        order = order[score[order] > 0]
        ends = np.flatnonzero(np.diff(left[order], append=-1)) + 1
        place = np.arange(len(order)) - np.repeat(np.concatenate([[0], ends[:-1]]), np.diff(ends, prepend=0)) if len(order) else np.zeros(0)
        top = order[place < limit]
        l, r = pa.array(left[top]), pa.array(right[top])
        return pa.record_batch([s.column("project_id").take(l), s.column("id").take(l), col(rows, "id").take(r), col(rows, "filename").take(r), pa.array(weight[top], pa.int64()), pa.array(score[top].astype(float))], names=["project_id", "s_id", "c_id", "filename", "weight", "score"])

    now, rest, index = None, [], None
    for batch in it:
        cell = num(batch, "cell")
        edges = [0, *(np.flatnonzero(np.diff(cell)) + 1).tolist(), len(cell)]
        for a, b in zip(edges, edges[1:], strict=False):
            if b == a:
                continue
            if now != cell[a]:
                now, rest, index = cell[a], [], None
            part = batch.slice(a, b - a)
            given = int(np.count_nonzero(~num(part, "ask").astype(bool)))
            if given:
                rest.append(part.slice(0, given))
            if given < len(part) and rest:  # all of the cell's candidates are there
                index, rest = indexed(rest), []
            for lo in range(given, len(part) if index else 0, AT_ONCE):
                yield from compared(part.slice(lo, AT_ONCE), index)


def shortlist(s: DataFrame, c: DataFrame, limit: int) -> DataFrame:
    """(project_id, s_id, c_id, filename, weight, score, rank): the `limit` best candidates of each source in its project, the source itself aside.

    Every source is compared with every candidate of its project, in cells of a bounded number of each, so no task holds a project and a
    row is sent once for each cell of the other side; only a cell's best rows leave it. Ties go to the larger weight, then by file name
    and id. Terms are compared by hashes of 64 bits.
    """
    own = lambda side, k: F.pmod(F.xxhash64("id", F.lit(k)), F.col(side)).cast("int")
    cells = lambda df, name, size: df.groupBy("project_id").agg(F.ceil(F.count("*") / size).cast("int").alias(name))
    left, right, queried = _coded(s, "s_"), _coded(c, "c_"), "s_asked" in s.columns
    plan = F.broadcast(cells(s, "p", SOURCES * CELL).join(cells(c, "g", CANDIDATES * CELL), "project_id"))  # two numbers a project
    ask = left.join(plan, "project_id").withColumns({"ask": F.lit(True), "i": own("p", 1), "j": F.explode(F.sequence(F.lit(0), F.col("g") - 1))})
    give = right.join(plan, "project_id").withColumns({"ask": F.lit(False), "j": own("g", 2), "i": F.explode(F.sequence(F.lit(0), F.col("p") - 1))})
    both = ask.unionByName(give).select(F.xxhash64("project_id", "i", "j").alias("cell"), *left.columns, "ask")
    met = both.repartition("cell").sortWithinPartitions("cell", "ask", "filename", "id")
    found = met.mapInArrow(lambda it: _best_of_cells(it, limit, queried), "project_id string, s_id string, c_id string, filename string, weight long, score double")
    return found.withColumn("rank", F.row_number().over(_best_first())).where(F.col("rank") <= limit)


def _best_first() -> WindowSpec:
    return Window.partitionBy("s_id").orderBy(F.desc("score"), F.desc("weight"), "filename", "c_id")


def _line(x: Column) -> Column:
    return F.lower(T.strip(F.regexp_replace(T.blank_if_null(x), r"\s+", " ")))


def text_key(text: Column) -> Column:
    """What stands for a text in `normalized_key`: a digest of its words in small letters, which moves in its place."""
    return F.unhex(F.sha2(_line(text), 256))


def normalized_key(filename: Column, number: Column, text: Column) -> Column:
    """text: as `text_key` returns it."""
    return F.struct(_line(filename).alias("f"), _line(number).alias("n"), text.alias("t"))


def semantic_boosts(matches: DataFrame, requirements: DataFrame) -> DataFrame:
    """(s_id, c_id, boost): 18 less the 0-based rank of a match, for the requirement of the same normalized key.

    matches: s_id, project_id, rank (0-based), filename, section_number and text, or instead of it its text_key.
    """
    key = normalized_key(F.col("filename"), F.col("section_number"), text_key(F.col("requirement_text")))
    by_key = requirements.select("project_id", key.alias("k"), F.col("id").cast("string").alias("c_id")).groupBy("project_id", "k").agg(F.max("c_id").alias("c_id"))
    said = F.col("text_key") if "text_key" in matches.columns else text_key(F.col("text"))
    m = matches.select("s_id", "project_id", "rank", normalized_key(F.col("filename"), F.col("section_number"), said).alias("k"))
    return m.join(by_key, ["project_id", "k"]).groupBy("s_id", "c_id").agg(F.sum(18.0 - F.col("rank")).alias("boost"))


def merge_semantic(scored: DataFrame, boosts: DataFrame, parity: bool = False) -> DataFrame:
    """(s_id, c_id, score, match_reason) with boosts added; boosted requirements without a lexical row come in.

    The source itself never does, unless `parity` asks for it.
    """
    b = boosts if parity else boosts.where("s_id <> c_id")
    both = scored.select("s_id", "c_id", "score", "match_reason").join(b, ["s_id", "c_id"], "full")
    reason = F.when(F.col("boost").isNull(), F.col("match_reason")).when(F.col("match_reason").isNull(), "semantic match").otherwise(F.concat("match_reason", F.lit("; semantic match")))
    return both.select("s_id", "c_id", (F.coalesce("score", F.lit(0.0)) + F.coalesce("boost", F.lit(0.0))).alias("score"), reason.alias("match_reason"))


def related_requirements(sources: DataFrame, requirements: DataFrame, boosts: DataFrame | None = None, limit: int = 20, source_filename: str | None = None, parity: bool = False, reasons: bool = True) -> DataFrame:
    """The `limit` best candidates of each source (s_id, rank, c_id, score, match_reason), for few sources or for all.

    sources: requirements or `ad_hoc_sources`; with a column query_text, what is asked about them. Without `reasons` the texts are not
    joined again to say them, and the column is left out.
    """
    live = requirements
    if source_filename:
        key = lambda x: F.lower(T.strip(F.regexp_replace(x, r"\s+", " ")))
        live = live.where(key(T.blank_if_null("filename")) != " ".join(source_filename.lower().split()))
    s, c = _prepared(sources, "s_"), _prepared(live, "c_")
    ranked = shortlist(s, c, limit)
    if boosts is not None:  # what a boost could lift is scored too
        allowed = staged(boosts.join(c.select("c_id"), "c_id", "left_semi"))
        keys = allowed.join(s.select("project_id", "s_id"), "s_id").select("project_id", "s_id", "c_id")
        lifted = _scored(keys, sources, live).where("s_id <> c_id and score > 0").select("s_id", "c_id", "score")
        rows = ranked.select("s_id", "c_id", "score").unionByName(lifted).groupBy("s_id", "c_id").agg(F.max("score").alias("score"))
        rows = merge_semantic(rows.withColumn("match_reason", F.lit("")), allowed, parity)
        names = live.select("project_id", F.col("id").cast("string").alias("c_id"), T.blank_if_null("filename").alias("filename")).withColumn("weight", T.filename_weight(F.col("filename")))
        ranked = rows.join(names, "c_id").withColumn("rank", F.row_number().over(_best_first())).where(F.col("rank") <= limit)
    if not reasons:
        return ranked.select("s_id", "rank", "c_id", "score")
    ranked = staged(ranked)
    said = _scored(ranked.select("project_id", "s_id", "c_id"), sources, live).select("s_id", "c_id", F.col("match_reason").alias("reason"))
    rows = ranked.join(said, ["s_id", "c_id"], "left")
    if boosts is None:
        return rows.select("s_id", "rank", "c_id", "score", F.col("reason").alias("match_reason"))
    alone = F.col("match_reason") == "semantic match"
    return rows.select("s_id", "rank", "c_id", "score", F.when(alone, F.col("match_reason")).otherwise(F.concat("reason", "match_reason")).alias("match_reason"))


def _scored(keys: DataFrame, sources: DataFrame, requirements: DataFrame) -> DataFrame:
    """Scores and reasons of the pairs of `keys` (project_id, s_id, c_id), from their texts."""
    only = lambda df, side: df.join(keys.select("project_id", F.col(side).alias("id")).distinct(), ["project_id", "id"], "left_semi")
    s, c = _prepared(only(sources.withColumn("id", F.col("id").cast("string")), "s_id"), "s_"), _prepared(only(requirements.withColumn("id", F.col("id").cast("string")), "c_id"), "c_")
    return score_pairs(keys.join(s, ["project_id", "s_id"]).join(c, ["project_id", "c_id"]))


def governing_section_links(paragraphs: DataFrame, sections: DataFrame, snippets: int = 3) -> DataFrame:
    """Links from `section N` references to that section in the base documents of the project, with the best snippets.

    paragraphs: project_id, paragraph_id, text; sections: project_id, filename, section_number, section_title, snippets.
    """
    refs = paragraphs.select("project_id", "paragraph_id", _link_words(F.col("text")).alias("words"), F.explode(T.section_refs(F.col("text"))).alias("cited"))
    base = sections.where(F.array_contains(T.derive_document_tags(F.col("filename")), "BASE IDIQ PWS")).withColumn("cited", F.col("section_number"))
    return _linked(refs, base, "governing_section", snippets)


def appendix_links(paragraphs: DataFrame, sections: DataFrame, snippets: int = 2) -> DataFrame:
    """Links from appendix references to the documents of that appendix in the project, with the best snippets."""
    letter = F.explode(T.appendix_refs_ranged(F.col("text"))).alias("letter")
    refs = paragraphs.select("project_id", "paragraph_id", _link_words(F.col("text")).alias("words"), letter).withColumn("cited", F.concat(F.lit("APPENDIX "), "letter")).drop("letter")
    return _linked(refs, sections.withColumn("cited", F.explode(T.derive_document_tags(F.col("filename")))), "referenced_appendix", snippets)


def _link_words(c: Column) -> Column:
    return F.transform(T.tokens_link(c), lambda x: F.xxhash64(x))


def _best_snippets(it: Iterator[pa.RecordBatch], keep: int) -> Iterator[pa.RecordBatch]:
    """The best snippets of each paragraph in each cell, by the share of its words in thousandths, then by the snippets' order."""
    rest: list[pa.RecordBatch] = []

    def flush() -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(rest)
        asks = np.asarray(t["paragraph_id"].is_valid())
        paragraphs, c = t.filter(pa.array(asks)), t.filter(pa.array(~asks)).sort_by("o").combine_chunks()
        o, times = np.asarray(c["o"]), np.asarray(c["times"])
        for lo in range(0, len(paragraphs) if len(c) else 0, AT_ONCE):
            s = paragraphs.slice(lo, AT_ONCE).combine_chunks()
            sets = [x["words"].combine_chunks() if isinstance(x["words"], pa.ChunkedArray) else x["words"] for x in (s, c)]
            n = np.diff(np.asarray(sets[0].offsets)).astype(np.int64)[:, None]
            score = (2000 * _common(*sets).astype(np.int64) + n) // np.maximum(2 * n, 1)
            order = np.argsort(-score, 1, kind="stable")[:, :keep]
            r = np.repeat(np.arange(len(s)), order.shape[1])
            at = order.reshape(-1)
            took = s.take(pa.array(r)).combine_chunks()
            one = lambda x: took[x].combine_chunks() if isinstance(took[x], pa.ChunkedArray) else took[x]  # noqa: B023, E731
            yield pa.record_batch([*[one(x) for x in ("project_id", "filename", "cited", "paragraph_id")], pa.array(o[at], pa.int64()), pa.array(times[at], pa.int32()), pa.array(score[r, at], pa.int64())], names=["project_id", "filename", "cited", "paragraph_id", "o", "times", "score"])

    for batch in it:
        cell = np.asarray(batch.column(0))
        edges = [0, *(np.flatnonzero(np.diff(cell)) + 1).tolist(), len(cell)]
        for a, b in zip(edges, edges[1:], strict=False):
            if b > a:
                if rest and rest[-1].column(0)[0].as_py() != cell[a]:
                    yield from flush()
                    rest = []
                rest.append(batch.slice(a, b - a))
    if rest:
        yield from flush()


def _linked(refs: DataFrame, sections: DataFrame, kind: str, keep: int) -> DataFrame:
    """Each reference (project_id, paragraph_id, words, cited) with the best snippets of each file that it cites.

    Words are found once a paragraph and once a snippet, and equal snippets of a file are one with its number. Every paragraph is compared
    with every snippet that it cites, as numbers and in cells of CELL by CELL; texts come in again for the best.
    """
    group = ["project_id", "filename", "cited"]
    said = sections.select(*group, F.posexplode("snippets").alias("i", "snippet")).groupBy(*group, "i", "snippet").agg(F.least(F.count("*"), F.lit(keep)).cast("int").alias("times"))
    said = said.withColumn("o", F.row_number().over(Window.partitionBy(*group).orderBy("i", "snippet")).cast("long"))
    files = said.groupBy(*group).agg(F.ceil(F.count("*") / CELL).cast("int").alias("g"))
    asked = refs.groupBy("project_id", "cited").agg(F.ceil(F.count("*") / CELL).cast("int").alias("p"))
    plan = files.join(asked, ["project_id", "cited"])
    own = lambda x, side: F.pmod(F.xxhash64(x), F.col(side)).cast("int")
    spread = lambda side: F.explode(F.sequence(F.lit(0), F.col(side) - 1))
    none = lambda t: F.lit(None).cast(t)
    ask = refs.withColumn("paragraph_id", F.col("paragraph_id").cast("string")).join(plan, ["project_id", "cited"]).select(*group, "paragraph_id", "words", none("long").alias("o"), none("int").alias("times"), own("paragraph_id", "p").alias("a"), spread("g").alias("b"))
    give = said.join(plan, group).select(*group, none("string").alias("paragraph_id"), _link_words(F.col("snippet")).alias("words"), "o", "times", own("o", "g").alias("b"), spread("p").alias("a"))
    met = ask.unionByName(give).select(F.xxhash64(*group, "a", "b").alias("cell"), *group, "paragraph_id", "words", "o", "times").repartition("cell").sortWithinPartitions("cell")
    best = met.mapInArrow(lambda it: _best_snippets(it, keep), "project_id string, filename string, cited string, paragraph_id string, o long, times int, score long")
    by = Window.partitionBy(*group, "paragraph_id").orderBy(F.desc("score"), "o")
    first = best.withColumn("before", F.coalesce(F.sum("times").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).where(F.col("before") < keep)
    n = F.least(F.col("times"), F.lit(keep) - F.col("before")).cast("int")
    first = first.withColumn("n", F.when(F.col("score") > 0, n).when(F.col("before") == 0, 1).otherwise(0)).where("n > 0")
    texts = first.join(said.select(*group, "o", "snippet"), [*group, "o"])
    lists = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("before", "n", "snippet"))), lambda s: F.array_repeat(s["snippet"], s["n"])))
    return texts.groupBy("project_id", "paragraph_id", "filename", "cited").agg(lists.alias("supporting")).withColumn("relationship", F.lit(kind))


def related_links(paragraphs: DataFrame, sections: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, [governing_section_links(paragraphs, sections), appendix_links(paragraphs, sections)])


def correlation_summary(links: DataFrame) -> DataFrame:
    """(project_id, relationship, links, paragraphs, documents)"""
    return links.groupBy("project_id", "relationship").agg(F.count("*").alias("links"), F.countDistinct("paragraph_id").alias("paragraphs"), F.countDistinct("filename").alias("documents"))
