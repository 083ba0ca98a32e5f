"""URL filter: trust and distrust spread over the host graph, in DataFrame operations only.

Rules decide first: (host, path prefix, verdict); a rule fits its host and the subdomains of it where the
url's path starts with the rule's, and the longest fitting rule wins. Other urls get the verdict of their
host: personalised PageRank spreads trust from hosts with allowed pages along links, and distrust from
hosts with blocked pages against the direction of links; a host whose distrust exceeds its trust by the
threshold is blocked.

Edges are links of pages (absolute and scheme-relative `href`s in `html`) between different hosts, weighted
by their number. Rank not passed on (hosts without links) is lost, which changes no comparison of a host's
two scores by more than the damping allows. All sums are combined before they move.

A page of any length is read by one expression; of rules of equal length, which can't both fit, the later one counts.
Null urls and urls without `://` have empty host and path and no rule; the empty host is in no edge, so
they are allowed. Null html has no links. Repeated rows count as often as they occur; other columns aren't
looked at; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bidspark.llm.common import cut, discard

#: (host, path prefix, verdict)
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINK = r"""(?i)href\s*=\s*["']?\s*(?:[a-z][a-z0-9+.\-]*:)?//([^/?#"'\s<>]+)"""


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; empty where it is null or has no `://`."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule (its text) and its verdict; null where none fits."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0]) + len(r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        text, verdict = F.when(fits, F.lit(h + p)).otherwise(text), F.when(fits, F.lit(v)).otherwise(verdict)
    return text, verdict


def host_links(pages: DataFrame) -> DataFrame:
    """(a, b, w): links from host a to another host b."""
    host, _ = host_and_path(F.col("url"))
    links = pages.where(F.col("html").contains("//")).select(host.alias("a"), F.explode(F.regexp_extract_all("html", F.lit(LINK), F.lit(1))).alias("b"))
    links = links.withColumn("b", F.translate("b", UPPER, LOWER))
    return links.where("a <> '' and a <> b").groupBy("a", "b").agg(F.count("*").alias("w"))


def spread(edges: DataFrame, seeds: DataFrame, damping: float, tolerance: float) -> DataFrame:
    """(host, trust, distrust) from seeds (host, trust, distrust); edges (a, b, w).

    A round moves what is left by the damping at least, so the rounds that reach `tolerance` are bounded, however long
    the chains of hosts are (88 at 0.85 and 1e-6).
    """
    out = edges.groupBy("a").agg(F.sum("w").alias("out_w"))
    into = edges.groupBy("b").agg(F.sum("w").alias("in_w"))
    e = cut(edges.join(out, "a").join(into, "b").select("a", "b", (F.col("w") / F.col("out_w")).alias("down"), (F.col("w") / F.col("in_w")).alias("up")))
    start = seeds.select("host", (F.col("trust") * (1 - damping)).alias("t0"), (F.col("distrust") * (1 - damping)).alias("d0"))
    rank = cut(start.select("host", F.col("t0").alias("trust"), F.col("d0").alias("distrust")))
    for _ in range(math.ceil(math.log(tolerance / 4) / math.log(damping)) + 2):
        forth = e.join(rank.where("trust > 0"), F.col("a") == F.col("host")).select(F.col("b").alias("host"), (F.col("trust") * F.col("down") * damping).alias("t0"), F.lit(0.0).alias("d0"))
        back = e.join(rank.where("distrust > 0"), F.col("b") == F.col("host")).select(F.col("a").alias("host"), F.lit(0.0).alias("t0"), (F.col("distrust") * F.col("up") * damping).alias("d0"))
        new = cut(start.unionByName(forth).unionByName(back).groupBy("host").agg(F.sum("t0").alias("trust"), F.sum("d0").alias("distrust")))
        old = rank.select("host", F.col("trust").alias("ot"), F.col("distrust").alias("od"))
        moved = new.join(old, "host", "left").agg(F.sum(F.abs(F.col("trust") - F.coalesce("ot", F.lit(0.0))) + F.abs(F.col("distrust") - F.coalesce("od", F.lit(0.0))))).first()[0]
        discard(rank)
        rank = new
        if (moved or 0.0) < tolerance:
            discard(e)
            return rank
    raise RuntimeError("trust and distrust did not settle")


def judge(pages: DataFrame, rules=RULES, damping: float = 0.85, threshold: float = 1.0, tolerance: float = 1e-6) -> DataFrame:
    """(page_id, host, path, rule, verdict, trust, distrust)."""
    host, path = host_and_path(F.col("url"))
    rule, said = rule_of(F.col("host"), F.col("path"), rules)
    split = pages.select("page_id", host.alias("host"), path.alias("path"))
    ruled = split.withColumn("rule", rule).withColumn("said", said)
    seeds = cut(ruled.where("said is not null").groupBy("host").agg(F.sum((F.col("said") == "allow").cast("double")).alias("trust"), F.sum((F.col("said") == "block").cast("double")).alias("distrust")))
    sums = seeds.agg(F.sum("trust").alias("t"), F.sum("distrust").alias("d")).first()
    seeds = seeds.select("host", (F.col("trust") / F.lit(max(sums["t"] or 0.0, 1.0))).alias("trust"), (F.col("distrust") / F.lit(max(sums["d"] or 0.0, 1.0))).alias("distrust"))
    edges = cut(host_links(pages))
    ranks = spread(edges, seeds, damping, tolerance)
    # only hosts without own rules on all their pages ask for a rank; most pages' hosts have none
    marked = ruled.join(ranks, "host", "left").withColumns({"trust": F.coalesce("trust", F.lit(0.0)), "distrust": F.coalesce("distrust", F.lit(0.0))})
    method = F.when(F.col("distrust") > F.col("trust") * threshold, "block").otherwise("allow")
    return marked.select("page_id", "host", "path", "rule", F.coalesce("said", method).alias("verdict"), "trust", "distrust")
