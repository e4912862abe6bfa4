r"""URL filters: rules by host and path, and link-graph propagation for what no rule fits.

A rule (host, path) fits a url whose host is the rule's or below it and whose path starts with the
rule's; the longest fitting rule decides. Hosts without a rule get a verdict from the graph of
hosts: trust is personalised PageRank along links from the hosts of allowed pages, distrust is the
same on reversed links from the hosts of blocked pages (whoever links to a blocked host is
suspect). A host is blocked where its distrust is more than TOLERANCE times its trust; hosts that
neither reaches are allowed.

Iteration goes on until no further host is reached and what STORED_EVERY iterations add to all ranks is below
SETTLED of them, so that hosts at any distance from a seed have a rank. Links of a page count once for each host; edges are summed before they are joined, so a host with
very many pages is one row, or one a neighbour. Ranks are DataFrames, cut by stored tables every
few iterations; mass of hosts without links goes back to the seeds.

Defined cases: null url, or one without `://`: empty host and path, no rule, allowed; null html:
no links; a host without pages of its own only passes ranks on; repeated rows count again as
links and seeds and get equal verdicts; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.llm.common import stored

#: verdict, rule: the host, then the path from its first slash.
RULES = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)
DAMPING, SETTLED, STORED_EVERY, TOLERANCE = 0.85, 1e-6, 8, 1.0

LOWER = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: str = "url") -> Column:
    found = F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, *LOWER), F.lit(""))


def path_of(url: str = "url") -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(rules: tuple = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits the columns host and path; nulls if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for decision, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        host, slash, path = text.partition("/")
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(slash + path)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, decision).otherwise(verdict)
    return rule, verdict


def links(pages: DataFrame) -> DataFrame:
    """source, target, n: pages of a host that link to another host."""
    targets = F.regexp_extract_all("html", F.lit(r"""(?i)\bhref\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s<>]+)"""), 1)
    distinct = pages.select(host_of().alias("source"), F.explode(F.array_distinct(targets)).alias("found"))
    found = distinct.select("source", F.translate("found", *LOWER).alias("target")).where("source <> '' and source <> target")
    return found.groupBy("source", "target").agg(F.count(F.lit(1)).alias("n"))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, settled: float = SETTLED) -> DataFrame:
    """host, rank: personalised PageRank over edges (source, target, n) from seeds (host, n).

    What hosts without links have goes back to the seeds, so that ranks at rest are in proportion to what
    reaches a host along all paths from the seeds, damped at each step: that is added up step by step and scaled to
    a sum of one. Only reached hosts are rows.
    """
    start = stored(seeds.select("host", F.col("n").cast("double").alias("rank")), "links-seeds")
    out = edges.groupBy("source").agg(F.sum("n").alias("out"))
    shares = stored(edges.join(out, "source").select("source", "target", (damping * F.col("n") / F.col("out")).alias("share")), "links-shares")
    ranks, steady = start, shares.isEmpty() or start.isEmpty()
    while not steady:
        old = ranks.select("host", F.col("rank").alias("before"))
        for _ in range(STORED_EVERY):
            passed = ranks.join(shares, F.col("host") == F.col("source")).select(F.col("target").alias("host"), (F.col("rank") * F.col("share")).alias("rank"))
            ranks = start.unionByName(passed).groupBy("host").agg(F.sum("rank").alias("rank"))
        ranks = stored(ranks, "links-ranks")
        change = ranks.join(old, "host", "left").agg(
            (F.sum(F.col("rank") - F.coalesce("before", F.lit(0.0))) / F.sum("rank")).alias("share"), F.count(F.when(F.col("before").isNull(), 1)).alias("new")
        ).first()
        steady = change["new"] == 0 and change["share"] < settled
    whole = ranks.agg(F.sum("rank").alias("whole"))
    return ranks.crossJoin(F.broadcast(whole)).select("host", (F.col("rank") / F.col("whole")).alias("rank"))  # whole is one row


def host_verdicts(pages: DataFrame, rules: tuple = RULES, tolerance: float = TOLERANCE) -> DataFrame:
    """host, trust, distrust, by_host (verdict) of every host that trust or distrust reaches."""
    edges = stored(links(pages), "links-edges")
    places = pages.select(host_of().alias("host"), path_of().alias("path")).where("host <> ''")
    decided = places.withColumn("verdict", rule_for(rules)[1]).where("verdict is not null")
    seeds = stored(decided.groupBy("host", "verdict").agg(F.count(F.lit(1)).alias("n")), "links-decided")
    trust = propagate(edges, seeds.where("verdict = 'allow'").select("host", "n"))
    reverse = edges.select(F.col("target").alias("source"), F.col("source").alias("target"), "n")
    distrust = propagate(reverse, seeds.where("verdict = 'block'").select("host", "n"))
    both = trust.withColumnRenamed("rank", "trust").join(distrust.withColumnRenamed("rank", "distrust"), "host", "full_outer")
    both = both.fillna(0.0, ["trust", "distrust"])
    return both.withColumn("by_host", F.when(F.col("distrust") > tolerance * F.col("trust"), "block").otherwise("allow"))


def url_report(pages: DataFrame, rules: tuple = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust of every row of pages."""
    known = stored(host_verdicts(pages, rules), "links-verdicts").withColumnRenamed("host", "its")
    placed = pages.select("page_id", host_of().alias("host"), path_of().alias("path"))
    rule, verdict = rule_for(rules)
    joined = placed.join(known, F.col("host") == F.col("its"), "left")
    return joined.select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, "by_host", F.lit("allow")).alias("verdict"),
        F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"),
    )
