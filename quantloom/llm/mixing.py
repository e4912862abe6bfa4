"""Mixing sources to target weights by hash-threshold histograms (DataFrame functions only).

Every source gets a share of the words of all documents by its weight, at most `max_repeat`
times what it has. A document is taken `floor(target / size of the source)` times, and once
more if its hash lies below the source's threshold. The threshold comes from histograms:
words are summed by source and hash bucket, the bucket in which the budget ends is the
boundary bucket, and only rows of boundary buckets are summed again by the next bits, until
the boundary is one hash value. No document is sorted, and a histogram has at most
2**BITS buckets a source whatever the source's size, so a hot source costs no more than another.

Defined cases: null text has size 0; a null source is a source, ordered last; repeated rows
and rows with one id share a hash and are taken or left together; a source of size 0 has
target 0 and takes nothing; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantloom.llm.common import WORD, stored

#: Hash bits of a histogram level, and levels: 60 bits of the id's MD5 in all.
BITS, LEVELS = 10, 6
#: Weights of the sources in order, repeating.
WEIGHTS = (5, 2, 1)


def id_hash(column: str = "doc_id"):
    """60 bits of the MD5 of the id as text; a null id hashes like an empty text."""
    text = F.coalesce(F.col(column).cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(text), 1, BITS * LEVELS // 4), 16, 10).cast("long")


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size in words, hash of the id."""
    return docs.select(
        "doc_id",
        "source",
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        id_hash().alias("h"),
    )


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeat: int = 3) -> DataFrame:
    """source, source_size, target: what a source may not take is reshared by weight.

    Sharing until no target is above its limit is water filling: with sources in order of
    limit / weight, the capped ones are a prefix, and the level of the rest is what is left
    over their weights. The windows run over one row a source, not over documents.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    ranked = by_source.select(
        "source", "source_size", weight.cast("double").alias("weight"), (max_repeat * F.col("source_size")).alias("limit")
    ).withColumn("ratio", F.col("limit") / F.col("weight"))
    up = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before, after, whole = up.rowsBetween(Window.unboundedPreceding, -1), up.rowsBetween(0, Window.unboundedFollowing), Window.partitionBy()
    level = (F.sum("source_size").over(whole) - F.coalesce(F.sum("limit").over(before), F.lit(0))) / F.sum("weight").over(after)
    leveled = ranked.withColumn("level", level)
    # The level of the first source that does not reach its limit; if all reach it, none is needed.
    final = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(whole)["level"]
    reached = F.coalesce(F.col("final") * F.col("weight") >= F.col("limit"), F.lit(True))
    return leveled.withColumn("final", final).select(
        "source", "source_size", F.when(reached, F.col("limit").cast("double")).otherwise(F.col("final") * F.col("weight")).alias("target")
    )


def thresholds(sizes: DataFrame, goals: DataFrame) -> DataFrame:
    """goals with copies (of every document) and threshold: hashes below it are taken once more."""
    size = F.col("source_size")
    whole = F.when(size > 0, F.floor(F.col("target") / size)).otherwise(0).cast("long")
    state = goals.withColumn("copies", whole).select(
        "*",
        (F.col("target") - F.col("copies") * size).alias("budget"),
        F.lit(0).cast("long").alias("prefix"),
        F.lit(0).cast("long").alias("below"),
    )
    for level in range(LEVELS):
        shift = BITS * (LEVELS - 1 - level)
        inside = sizes.withColumnRenamed("source", "its").join(
            state.select("source", F.col("prefix").alias("at")),
            F.col("its").eqNullSafe(F.col("source")) & (F.shiftright("h", shift + BITS) == F.col("at")),
        )
        histogram = inside.groupBy("source", F.shiftright("h", shift).alias("bucket")).agg(F.sum("size").alias("words"))
        order = Window.partitionBy("source").orderBy("bucket")
        summed = histogram.join(state.select(F.col("source").alias("own"), "budget", "below"), F.col("source").eqNullSafe(F.col("own"))).select(
            "source", "bucket", "words", "budget", (F.col("below") + F.sum("words").over(order)).alias("upto")
        )
        # The first bucket that the budget does not cover; a budget that covers all ends behind the last.
        passed = F.col("upto") > F.col("budget")
        edge = summed.groupBy("source").agg(
            F.min(F.when(passed, F.struct("bucket", (F.col("upto") - F.col("words")).alias("below"), "upto"))).alias("edge"),
            F.max(F.struct((F.col("bucket") + 1).alias("bucket"), F.col("upto").alias("below"), F.col("upto").alias("upto"))).alias("end"),
        )
        found = edge.select(F.col("source").alias("own"), F.coalesce("edge", "end").alias("cut"))
        state = state.join(found, F.col("source").eqNullSafe(F.col("own")), "left").select(
            *goals.columns, "copies", "budget",
            F.coalesce("cut.bucket", F.shiftleft("prefix", BITS)).alias("prefix"),
            F.coalesce("cut.below", "below").alias("below"), F.coalesce("cut.upto", "below").alias("upto"),
        )
        state = stored(state, f"mix-level{level}")
    # The last boundary is one hash value: with it or without it, whichever ends nearer to the budget.
    nearer = (F.col("upto") - F.col("budget")) < (F.col("budget") - F.col("below"))
    return state.withColumn("threshold", F.col("prefix") + F.when(nearer & (F.col("upto") > F.col("budget")), 1).otherwise(0))


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeat: int = 3) -> DataFrame:
    """doc_id, source, size, source_size, target, copies (times that the document is taken)."""
    sizes = stored(sized(docs), "mix-sizes")
    goals = stored(targets(sizes, weights, max_repeat), "mix-targets")
    cuts = thresholds(sizes, goals).select(F.col("source").alias("own"), "source_size", "target", F.col("copies").alias("whole"), "threshold")
    copies = F.least(F.col("whole") + (F.col("h") < F.col("threshold")).cast("long"), F.lit(max_repeat))
    return sizes.join(cuts, F.col("source").eqNullSafe(F.col("own"))).select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), "h")


def mix_report(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken: words that the mix takes of the document."""
    return mixed(docs).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def mix_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeat: int = 3) -> DataFrame:
    """The documents themselves, with all their columns, as often as the mix takes them."""
    sizes = stored(sized(docs), "mix-sizes")
    goals = stored(targets(sizes, weights, max_repeat), "mix-targets")
    cuts = thresholds(sizes, goals).select(
        F.col("source").alias("__own"), F.col("copies").alias("__whole"), F.col("threshold").alias("__threshold")
    )
    copies = F.least(F.col("__whole") + (id_hash() < F.col("__threshold")).cast("long"), F.lit(max_repeat)).cast("int")
    # A row is repeated by exploding as many nulls as it has copies; no copies, no row.
    joined = docs.join(cuts, F.col("source").eqNullSafe(F.col("__own")))
    return joined.withColumn("__copy", F.explode(F.array_repeat(F.lit(0), copies))).select(*[docs[c] for c in docs.columns])


ORACLE_SQL = f"""
WITH s AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, {BITS * LEVELS // 4}) AS BIGINT) AS h
  FROM documents),
b AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM s GROUP BY source),
r AS (SELECT source, source_size, CAST([5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS DOUBLE) AS weight FROM b),
l AS (SELECT *, 3 * source_size AS lim, 3 * source_size / weight AS ratio FROM r),
w AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(lim) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM l),
f AS (SELECT arg_min(level, ratio) AS final FROM w WHERE level <= ratio),
t AS (SELECT source, source_size, CASE WHEN coalesce(final * weight >= lim, true) THEN CAST(lim AS DOUBLE) ELSE final * weight END AS target
  FROM w LEFT JOIN f ON true),
g AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM t),
c AS (SELECT s.*, g.source_size, g.target, g.whole, g.target - g.whole * g.source_size AS budget,
    CAST(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS upto
  FROM s JOIN g ON s.source IS NOT DISTINCT FROM g.source),
e AS (SELECT *, coalesce(max(upto) FILTER (upto <= budget) OVER (PARTITION BY source), 0) AS below,
    min(upto) FILTER (upto > budget) OVER (PARTITION BY source) AS above FROM c)
SELECT doc_id, size, source_size, target,
  size * least(3, whole + CASE WHEN upto <= budget THEN 1 WHEN upto = above AND above - budget < budget - below THEN 1 ELSE 0 END) AS taken
FROM e
"""
