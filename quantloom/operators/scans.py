"""Scans along a key's time axis, in segments.

A running value of a whole key needs all of the key in one sort. Here the axis is cut into segments of a fixed
length; what a segment brings to the next ones is one row, those rows are scanned by key, and
every segment then begins with what was brought to it. So a key's rows are in as many tasks as it has segments.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions.time import HOUR_MICROS

#: Length of a segment: about what one task should sort of one key.
SEGMENT_H = 4096


def segment_of(ts: str | Column, hours: int = SEGMENT_H) -> Column:
    """The number of the segment that a time is in."""
    return F.floor(F.unix_micros(ts) / (hours * HOUR_MICROS))


def upto(*keys: str, order: str = "segment") -> Window:
    """A key's segments before the row's own."""
    return Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)


def asof_join(left: DataFrame, right: DataFrame, on: str, right_on: str, by: str, carry: list[str], segment_h: int = SEGMENT_H) -> DataFrame:
    """left with the carried columns of the last row of right with right_on <= on, for the same `by`.

    Both sides are one sorted stream by key and segment, and the last row seen of right is carried forward; of each segment the last row
    of right is brought to the next segment that left has, and so on: no pair of rows is made, whatever the
    distance. Rows of right come before equal rows of left.
    """
    held = F.struct(F.col(right_on).alias("at"), *carry)
    marked = right.where(F.col(right_on).isNotNull()).select(F.col(by).alias("key"), segment_of(right_on, segment_h).alias("segment"), F.col(right_on).alias("when"), F.lit(1).alias("side"), held.alias("held"))
    rows = left.select(F.col(by).alias("key"), segment_of(on, segment_h).alias("segment"), F.col(on).alias("when"), F.lit(2).alias("side"), F.struct("*").alias("row"))
    last = marked.groupBy("key", "segment").agg(F.max_by("held", "when").alias("held"))
    ends = last.unionByName(rows.select("key", "segment").distinct(), allowMissingColumns=True).groupBy("key", "segment").agg(F.any_value("held", True).alias("held"))
    brought = ends.withColumn("held", F.last("held", ignorenulls=True).over(upto("key"))).where("held is not null").withColumn("side", F.lit(0))
    both = marked.unionByName(brought, allowMissingColumns=True).unionByName(rows, allowMissingColumns=True)
    past = Window.partitionBy("key", "segment").orderBy(F.asc_nulls_first("when"), "side").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("held", F.last("held", ignorenulls=True).over(past)).where("side = 2")
    return found.select("row.*", F.col("held.at").alias(right_on), *[F.col(f"held.{c}").alias(c) for c in carry])


def equity(series: DataFrame, keys: tuple[str, ...] = ("trial",), segment_h: int = SEGMENT_H) -> DataFrame:
    """series with equity, equity_gross (growth of one unit) and peak. series is read twice."""
    cut = series.withColumn("segment", segment_of("ts", segment_h))
    past = Window.partitionBy(*keys, "segment").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    grown = cut.withColumns({"equity": F.product(1 + F.col("net")).over(past), "equity_gross": F.product(1 + F.col("gross")).over(past)})
    # What a segment multiplies by, and its highest and lowest factor within.
    ends = grown.groupBy(*keys, "segment").agg(
        F.max_by("equity", "ts").alias("factor"), F.max_by("equity_gross", "ts").alias("factor_gross"), F.max("equity").alias("high"), F.min("equity").alias("low")
    )
    before = upto(*keys)
    ends = ends.withColumns({"before": F.coalesce(F.product("factor").over(before), F.lit(1.0)), "before_gross": F.coalesce(F.product("factor_gross").over(before), F.lit(1.0))})
    reached = F.greatest(F.col("before") * F.col("high"), F.col("before") * F.col("low"))  # a loss of more than everything turns the sign
    ends = ends.withColumn("reached", reached).withColumn("peak_before", F.max("reached").over(before)).select(*keys, "segment", "before", "before_gross", "peak_before")
    whole = grown.join(ends, [*keys, "segment"]).withColumns({"equity": F.col("before") * F.col("equity"), "equity_gross": F.col("before_gross") * F.col("equity_gross")})
    peak = F.greatest("peak_before", F.max("equity").over(past))
    return whole.withColumn("peak", peak).select(*series.columns, "equity", "equity_gross", "peak")


def gap_free(panel: DataFrame, prices: list[str], flows: list[str], step_h: int = 1, segment_h: int = SEGMENT_H) -> DataFrame:
    """Every bar from a symbol's first to its last: prices carried forward, flows 0, is_real false where none was.

    Bars are step_h hours apart, or several times that: a bar is written once for itself and once for each missing one behind it,
    so that there is neither a table of all times nor a join with it. Other columns are null in what was missing.
    """
    step = F.expr(f"interval {step_h} hours")
    cut = panel.withColumn("segment", segment_of("ts", segment_h))
    last = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col("ts"))).alias(c) for c in prices]
    ends = cut.groupBy("symbol", "segment").agg(F.min("ts").alias("first"), *last)
    brought = [F.last(c, ignorenulls=True).over(upto("symbol")).alias(f"brought_{c}") for c in prices]
    following = F.lead("first").over(Window.partitionBy("symbol").orderBy("segment")).alias("following")
    joined = cut.join(ends.select("symbol", "segment", following, *brought), ["symbol", "segment"])
    order = Window.partitionBy("symbol", "segment").orderBy("ts")
    past = order.rowsBetween(Window.unboundedPreceding, 0)
    filled = {c: F.coalesce(F.last(c, ignorenulls=True).over(past), F.col(f"brought_{c}")) for c in prices}
    reach = F.coalesce(F.lead("ts").over(order), F.col("following")) - step
    spread = joined.withColumns({**filled, "reach": F.greatest(F.coalesce(reach, F.col("ts")), F.col("ts"))}).withColumn("bar", F.explode(F.sequence("ts", "reach", step)))
    real = F.col("bar") == F.col("ts")
    columns = []
    for c in panel.columns:
        kept = {"symbol": F.col(c), "ts": F.col("bar")} | {p: F.col(p) for p in prices} | {f: F.when(real, F.coalesce(F.col(f), F.lit(0).cast(panel.schema[f].dataType))).otherwise(F.lit(0).cast(panel.schema[f].dataType)) for f in flows}
        columns.append((kept[c] if c in kept else F.when(real, F.col(c))).alias(c))
    return spread.select(*columns, real.alias("is_real"))


def time_axis(rows: DataFrame, segment_h: int = SEGMENT_H) -> DataFrame:
    """ts, t (0, 1, ... in order), n_bars, first of the different times of rows.

    Times are numbered within their segment, after as many as the segments before it have: only a row a segment is put in one order.
    """
    axis = rows.select("ts").distinct().withColumn("segment", segment_of("ts", segment_h))
    return _placed(axis, "ts", F.row_number(), "t", {"first": F.min("ts")}).select("ts", (F.col("t") - 1).alias("t"), F.col("n_rows").alias("n_bars"), "first")


def _placed(rows: DataFrame, order: str, place: Column, name: str, more: dict[str, Column] | None = None) -> DataFrame:
    """rows (segment, order, ...) with the place of each among all (row_number or rank), if segments are in order; n_rows; aggregates of all."""
    more = more or {}
    whole = Window.partitionBy("all")
    sizes = rows.groupBy("segment").agg(F.count(F.lit(1)).alias("size"), *[c.alias(k) for k, c in more.items()]).withColumn("all", F.lit(0))
    merged = [F.min(k).over(whole).alias(k) for k in more]
    ahead = sizes.select("segment", F.coalesce(F.sum("size").over(upto("all")), F.lit(0)).alias("ahead"), F.sum("size").over(whole).alias("n_rows"), *merged)
    return rows.join(ahead, "segment").withColumn(name, F.col("ahead") + place.over(Window.partitionBy("segment").orderBy(order))).drop("ahead")


#: Parts of about equal size that values are dealt to for ranking.
RANGES = 64


def mean_rank(rows: DataFrame, column: str, name: str) -> DataFrame:
    """rows with the rank of a column's values among all, equal values sharing their mean rank; a null has none.

    Values are dealt by bounds between them, so that each range is ranked by itself, after as many values as lie below it. Where
    the bounds are changes nothing; equal values are always in one range.
    """
    shares = [k / RANGES for k in range(1, RANGES)]
    bounds = rows.agg(F.percentile_approx(column, F.array(*map(F.lit, shares)), F.lit(10_000)).alias("bounds"))
    known = rows.where(F.col(column).isNotNull()).crossJoin(F.broadcast(bounds))  # one row
    dealt = known.withColumn("segment", F.size(F.filter("bounds", lambda b: b < F.col(column)))).drop("bounds")
    placed = _placed(dealt, column, F.rank(), name).drop("n_rows")
    ties = F.count(F.lit(1)).over(Window.partitionBy("segment", column))
    ranked = placed.withColumn(name, F.col(name) + (ties - 1) / 2).drop("segment")
    missing = rows.where(F.col(column).isNull()).withColumn(name, F.lit(None).cast("double"))
    return ranked.unionByName(missing)
