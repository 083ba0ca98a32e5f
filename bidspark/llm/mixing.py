"""Mixing sources to target weights by hierarchical budgeting, in DataFrame operations.

A tree of domains, languages and sources shares a budget of tokens. Each node shares its budget among its
children by their weights; a child that can't take its share (all its tokens, `max_epochs` times over) takes
what it can, and the rest goes to its siblings by their weights. A node's capacity is the sum of its leaves', so
a shortage moves up only when all siblings are full. The shares come from sorted prefix sums over
a node's children, in whole numbers: no loop over nodes, nothing on the driver.

A leaf then takes whole epochs while its budget lasts, and of the next epoch the longest prefix in that epoch's
seeded order (sha256 of seed, epoch and doc_id) that stays within the rest. Prefix sums of a leaf are taken over
slices of the order, so a leaf with a third of all rows is still many tasks' work; only the slice in
which the prefix ends is sorted.

Tokens are words `[^\\x20\\t-\\r]+`. Null or empty texts have no tokens and are taken in each whole epoch and in
the prefix like others. A text of any length is counted where it lies. Equal capacities per weight are taken in the order of names. Null domain, language or source is the empty name. Rows of a leaf that share a doc_id
are taken or left together. An empty table, or a budget of 0, selects nothing.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bidspark.llm.common import cut, free_names

LEVELS = ("domain", "lang", "source")
#: Whole-number weights by level and name; others weigh 1.
WEIGHTS: Mapping[str, Mapping[str, int]] = {"domain": {"d0": 4, "d1": 3, "d2": 2, "d3": 1}, "lang": {"en": 6, "de": 3, "fr": 3, "es": 2}, "source": {}}
SLICE = 5000  # documents of a leaf in one slice of its order
BROADCAST = 100_000  # leaves whose ends are broadcast to the documents; more are joined


def domain_of(source: Column) -> Column:
    """Domain of a source: its number's remainder by 4; sources without a number are of domain d0."""
    return F.concat(F.lit("d"), F.coalesce(F.regexp_extract(source, r"(\d{1,9})$", 1).try_cast("int"), F.lit(0)) % 4)


def _weight(level: str, weights: Mapping[str, Mapping[str, int]]) -> Column:
    w: Column = F.lit(1)
    for name, value in weights.get(level, {}).items():
        w = F.when(F.col(level) == name, value).otherwise(w)
    return w.cast("long")


def with_leaves(docs: DataFrame, leaf: str = "__leaf") -> DataFrame:
    """The documents with the names of their leaf in a struct column `leaf`."""
    name = lambda c: F.coalesce(F.col(c), F.lit(""))
    return docs.withColumn(leaf, F.struct(domain_of(name("source")).alias("domain"), name("lang").alias("lang"), name("source").alias("source")))


def budgets(leaves: DataFrame, budget: Column, weights=WEIGHTS, max_epochs: int = 1) -> DataFrame:
    """leaves (LEVELS, tokens, docs) with their `budget` in tokens; `budget` is an expression over the sum `total`."""
    sized = leaves.withColumn("cap", F.col("tokens") * max_epochs)
    whole = leaves.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("total")).select(F.lit(0).alias("root"), F.floor(budget).cast("long").alias("share"))
    parents, share = [], whole
    for k, level in enumerate(LEVELS):
        node = [*LEVELS[: k + 1]]
        child = sized.groupBy(*node).agg(F.sum("cap").alias("cap"), F.sum("tokens").alias("tokens"), F.sum("docs").alias("docs")).withColumn("w", _weight(level, weights))
        child = child.join(share, parents) if parents else child.withColumn("root", F.lit(0)).join(share, "root")
        by = Window.partitionBy(*parents) if parents else Window.partitionBy(F.lit(0))
        order = by.orderBy(F.col("cap") / F.col("w"), F.col(level)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        child = child.withColumns({"c_to": F.sum("cap").over(order), "w_to": F.sum("w").over(order), "w_all": F.sum("w").over(by)})
        # full: its capacity is below the level to which what is left would fill it and those after it
        full = F.expr("cap * (w_all - w_to + w) <= w * (share - c_to + cap)")
        child = child.withColumn("is_full", full)
        child = child.withColumns({"c_full": F.sum(F.when(F.col("is_full"), F.col("cap")).otherwise(0)).over(by), "w_full": F.sum(F.when(F.col("is_full"), F.col("w")).otherwise(0)).over(by)})
        got = F.when(F.col("is_full"), F.col("cap")).otherwise(F.expr("greatest(w * (share - c_full), 0L) div greatest(w_all - w_full, 1L)"))
        child = child.withColumn("got", got)
        share, parents = child.select(*node, F.col("got").alias("share")), node
    return child.select(*LEVELS, "tokens", "docs", F.col("got").alias("budget"))


def order_key(seed: int, epoch: Column, doc_id: Column) -> Column:
    """Place of a document in the seeded order of an epoch."""
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)


def plan(docs: DataFrame, budget: Column, weights=WEIGHTS, max_epochs: int = 1, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """(slim, leaves): (doc_id, leaf, n_tokens) of each document, and each leaf's whole epochs and last key."""
    count = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\t-\r]+")), F.lit(0)).cast("long")
    slim = cut(with_leaves(docs.select("doc_id", "text", "lang", "source")).select("doc_id", "__leaf.*", count.alias("n_tokens")))
    sizes = slim.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs"))
    shared = budgets(cut(sizes), budget, weights, max_epochs)
    whole = F.least(F.when(F.col("tokens") > 0, F.expr("budget div tokens")).otherwise(F.lit(max_epochs)), F.lit(max_epochs)).cast("long")
    whole = F.when(F.col("budget") > 0, whole).otherwise(F.lit(0).cast("long"))
    leaves = shared.withColumn("epochs", whole).withColumn("rest", F.when(F.col("epochs") >= max_epochs, F.lit(0)).otherwise(F.col("budget") - F.col("epochs") * F.col("tokens")))
    leaves = cut(leaves.withColumn("slices", F.ceil(F.col("docs") / SLICE).cast("long")))
    # slices of the order, by the first 32 bits of the key
    part = slim.join(leaves.where("rest > 0").select(*LEVELS, "epochs", "rest", "slices"), [*LEVELS])
    part = part.withColumn("key", order_key(seed, F.col("epochs") + 1, F.col("doc_id")))
    part = part.withColumn("slice", F.expr("(cast(conv(substr(key, 1, 8), 16, 10) as bigint) * slices) div 4294967296L"))
    sums = part.groupBy(*LEVELS, "slice").agg(F.sum("n_tokens").alias("s"), F.max("key").alias("last"), F.first("rest").alias("rest"))
    order = Window.partitionBy(*LEVELS).orderBy("slice").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = cut(sums.withColumn("to", F.sum("s").over(order)))
    taken = sums.where("to <= rest").groupBy(*LEVELS).agg(F.max("last").alias("k1"))
    edge = sums.where("to > rest and to - s <= rest").select(*LEVELS, "slice", (F.col("to") - F.col("s")).alias("before"))
    # the prefix ends in the first slice that passes the rest (others that fit the filter hold no tokens before it)
    edge = edge.groupBy(*LEVELS).agg(F.min_by("slice", "slice").alias("slice"), F.min_by("before", "slice").alias("before"))
    run = Window.partitionBy(*LEVELS, "slice").orderBy("key").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    inside = part.join(edge, [*LEVELS, "slice"]).withColumn("to", F.col("before") + F.sum("n_tokens").over(run))
    ends = inside.where("to <= rest").groupBy(*LEVELS).agg(F.max("key").alias("k2"))
    last = F.greatest(F.coalesce("k1", F.lit("")), F.coalesce("k2", F.lit("")))
    return slim, cut(leaves.join(taken, [*LEVELS], "left").join(ends, [*LEVELS], "left").select(*LEVELS, "tokens", "budget", "epochs", last.alias("last")))


def copies(leaves_joined: DataFrame, seed: int, doc_id: Column) -> Column:
    """How often a document is taken: whole epochs, and once more inside the prefix."""
    return (F.col("epochs") + F.when(order_key(seed, F.col("epochs") + 1, doc_id) <= F.col("last"), 1).otherwise(0)).cast("long")


def mix(docs: DataFrame, budget: Column, weights=WEIGHTS, max_epochs: int = 1, seed: int = 1) -> DataFrame:
    """(doc_id, domain, lang, source, n_tokens, copies) of the documents taken at least once."""
    slim, leaves = plan(docs, budget, weights, max_epochs, seed)
    both = slim.join(leaves.select(*LEVELS, "epochs", "last"), [*LEVELS])
    return both.withColumn("copies", copies(both, seed, F.col("doc_id"))).where("copies > 0").select("doc_id", *LEVELS, "n_tokens", "copies")


def mix_rows(docs: DataFrame, budget: Column, weights=WEIGHTS, seed: int = 1) -> DataFrame:
    """The documents' own rows that one epoch at most selects; texts are filtered where they lie, not moved by key."""
    slim, leaves = plan(docs, budget, weights, 1, seed)
    leaf, epochs, last = free_names(docs.columns, "__leaf", "__epochs", "__last")
    named = leaves.select(F.struct(*LEVELS).alias(leaf), F.col("epochs").alias(epochs), F.col("last").alias(last))
    taken = (F.col(epochs) > 0) | (order_key(seed, F.col(epochs) + 1, F.col("doc_id")) <= F.col(last))
    return with_leaves(docs, leaf).join(F.broadcast(named) if leaves.count() < BROADCAST else named, leaf).where(taken).select(*[F.col(f"`{c}`") for c in docs.columns])
