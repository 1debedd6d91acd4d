"""URL filter: rules first, then trust and distrust spread over the links between hosts.

Trust starts at hosts by the share of their pages that a rule allows, distrust by the
share that a rule blocks. Trust follows links forward (who is linked from trusted
hosts), distrust follows them backward (who links to blocked hosts); both by
personalised PageRank. A page without a rule is blocked when its host's distrust
exceeds its trust by ``threshold``, in units of what a host keeps by itself when all
its pages are ruled. Everything is built from SQL functions.

Defined cases: a url that is null or has no ``://`` has an empty host and path, fits no
rule and is allowed; a null html has no links; links within one host do not count;
repeated rows count as so many pages; other columns are not looked at.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from palaver.session import materialize

from .common import ascii_lower

#: Verdict, host and path prefix.
Rule = tuple[str, str, str]
LINK = r"""(?i)<a\s[^>]*?href\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s>\\]+)"""


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return ascii_lower(F.regexp_extract(rest, "^[^/?#]*", 0)), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def fitting_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """Verdict and text of the longest rule that fits, else null. Of equally long rules the one of the longer host wins."""
    def fits(rule: Rule) -> Column:
        return ((host == rule[1]) | host.endswith("." + rule[1])) & path.startswith(rule[2])

    found = reduce(lambda rest, r: F.when(fits(r), F.struct(F.lit(r[0]).alias("verdict"), F.lit(r[1] + r[2]).alias("rule"))).otherwise(rest),
                   sorted(rules, key=lambda r: (len(r[1] + r[2]), len(r[1]))),
                   F.lit(None).cast("struct<verdict:string,rule:string>"))
    return found


def host_links(pages: DataFrame) -> DataFrame:
    """src, dst, n: on how many pages of host src a link leads to host dst."""
    host, _ = split_url(F.col("url"))
    targets = F.array_distinct(F.transform(F.regexp_extract_all("html", F.lit(LINK), 1), ascii_lower))
    return (pages.where(F.col("html").isNotNull() & F.col("url").isNotNull())
            .select(host.alias("src"), F.explode(targets).alias("dst"))
            .where((F.col("src") != F.col("dst")) & (F.col("src") != ""))
            .groupBy("src", "dst").agg(F.count("*").cast("double").alias("n")))


def _spread(hosts: DataFrame, links: DataFrame, seed: str, damping: float, tolerance: float, max_rounds: int) -> DataFrame:
    """Personalised PageRank from column ``seed``: host, mass. ``links`` holds src, dst, share."""
    start = hosts.select("host", (F.col(seed) * (1 - damping)).alias("base"), (F.col(seed) * (1 - damping)).alias("mass"))
    current = start
    for _ in range(max_rounds):
        flow = (links.join(current.select(F.col("host").alias("src"), "mass").where("mass > 0"), "src")
                .groupBy(F.col("dst").alias("host")).agg(F.sum(F.col("mass") * F.col("share")).alias("flow")))
        moved = current.join(flow, "host", "left").select(
            "host", "base", (F.col("base") + damping * F.coalesce("flow", F.lit(0.0))).alias("mass"),
            F.abs(F.col("base") + damping * F.coalesce("flow", F.lit(0.0)) - F.col("mass")).alias("change"))
        moved = materialize(moved, "spread")
        current = moved.drop("change")
        if (moved.agg(F.max("change")).first()[0] or 0.0) <= tolerance:
            return current
    raise RuntimeError(f"link scores still move after {max_rounds} rounds")


def propagate(pages_by_host: DataFrame, links: DataFrame, damping: float = 0.85, tolerance: float = 1e-6,
              max_rounds: int = 200) -> DataFrame:
    """host, trust, distrust of every host that has pages or is linked.

    ``pages_by_host``: host, n_pages, n_allow, n_block. The error shrinks by ``damping``
    each round, so the default tolerance needs fewer than 90 rounds.
    """
    seeds = pages_by_host.select("host", (F.col("n_allow") / F.col("n_pages")).alias("allow"), (F.col("n_block") / F.col("n_pages")).alias("block"))
    linked = links.select(F.col("dst").alias("host")).distinct()
    hosts = seeds.join(linked, "host", "full").select("host", F.coalesce("allow", F.lit(0.0)).alias("allow"), F.coalesce("block", F.lit(0.0)).alias("block"))
    hosts = materialize(hosts, "hosts")
    out = links.join(links.groupBy("src").agg(F.sum("n").alias("total")), "src")
    forward = materialize(out.select("src", "dst", (F.col("n") / F.col("total")).alias("share")), "links")
    into = links.join(links.groupBy("dst").agg(F.sum("n").alias("total")), "dst")
    backward = materialize(into.select(F.col("dst").alias("src"), F.col("src").alias("dst"), (F.col("n") / F.col("total")).alias("share")), "links")
    trust = _spread(hosts, forward, "allow", damping, tolerance, max_rounds)
    distrust = _spread(hosts, backward, "block", damping, tolerance, max_rounds)
    return trust.select("host", F.col("mass").alias("trust")).join(distrust.select("host", F.col("mass").alias("distrust")), "host")


def judge(pages: DataFrame, rules: list[Rule], *carry: str, damping: float = 0.85, threshold: float = 0.5) -> DataFrame:
    """host, path, rule and verdict of every page."""
    host, path = split_url(F.col("url"))
    ruled = pages.select(*carry, host.alias("host"), path.alias("path"))
    ruled = ruled.withColumn("fit", fitting_rule(F.col("host"), F.col("path"), rules))
    by_host = ruled.where(F.col("host") != "").groupBy("host").agg(
        F.count("*").alias("n_pages"), F.count_if(F.col("fit.verdict") == "allow").alias("n_allow"),
        F.count_if(F.col("fit.verdict") == "block").alias("n_block"))
    scores = propagate(by_host, materialize(host_links(pages), "host-links"), damping)
    bad = scores.where((F.col("distrust") - F.col("trust")) >= threshold * (1 - damping)).select("host", F.lit(True).alias("bad"))
    return ruled.join(bad, "host", "left").select(
        *carry, "host", "path", F.col("fit.rule").alias("rule"),
        F.coalesce("fit.verdict", F.when(F.col("bad"), "block"), F.lit("allow")).alias("verdict"))
