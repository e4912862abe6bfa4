"""Sliding aggregates at a cost a row that does not depend on the frame's length.

Spark adds up a sliding frame anew for every row. Here the axis is cut into blocks as long as the frame, so that
a frame is the end of one block and the beginning of the next. Beginnings are running aggregates in order, ends are running
aggregates in reverse order, both of a block at a time, and a frame joins two of them. Nothing is subtracted,
so that large values that have left a frame leave no error behind.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Name of the column that numbers a symbol's bars, 0, 1, ...
BAR = "__bar"


def range_sums(parts: DataFrame, asks: DataFrame, key: str, widths_us: dict[str, int], columns: list[str]) -> DataFrame:
    """key, us and, for every width w and column c, w_c: the sum of c over parts (key, us, ...) at times in [us - width, us), for the
    different (key, us) of asks; null where nothing is.

    A part counts in its own block for asks after it, and in the next block for asks that still reach back to it, so
    that every block is summed by itself: one shuffle by key, width and block, and a key of any length is in many tasks.
    """

    def at(width: int, us: Column, later: int, kind: int) -> Column:
        return F.struct(F.lit(width).alias("width"), (F.floor(us / width) + later).alias("block"), (us + later * width).alias("us"), F.lit(kind).alias("kind"))

    us = F.col("us")
    counted = F.explode(F.array(*[at(w, us, later, 1 + later) for w in widths_us.values() for later in (0, 1)]))
    asked = F.explode(F.array(*[at(w, us, 0, 0) for w in widths_us.values()]))
    of_parts = parts.select(key, *columns, counted.alias("at")).select(key, "at.*", *columns)
    of_asks = asks.select(key, "us").distinct().select(key, asked.alias("at")).select(key, "at.*")
    both = of_parts.unionByName(of_asks, allowMissingColumns=True)
    by_block = Window.partitionBy(key, "width", "block")
    # At one instant: an ask comes before parts that begin to count, and after those that it still reaches.
    before = by_block.orderBy("us", "kind").rowsBetween(Window.unboundedPreceding, 0)
    after = by_block.orderBy(F.desc("us"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, 0)
    begun = {f"begun_{c}": F.sum(F.when(F.col("kind") == 1, F.col(c))).over(before) for c in columns}
    held = {f"held_{c}": F.sum(F.when(F.col("kind") == 2, F.col(c))).over(after) for c in columns}
    found = both.withColumns(begun).withColumns(held).where("kind = 0")
    sums = []
    for name, width in widths_us.items():
        for c in columns:
            whole = F.coalesce(F.col(f"begun_{c}") + F.col(f"held_{c}"), F.col(f"begun_{c}"), F.col(f"held_{c}"))
            sums.append(F.max(F.when(F.col("width") == width, whole)).alias(f"{name}_{c}"))  # one row has it
    return found.groupBy(key, "us").agg(*sums)


def parts(name: str, x: Column, n: int) -> dict[str, Column]:
    """Columns of a block's beginning and end at every bar, to be added before `frame`; BAR numbers a symbol's bars."""
    by_block = Window.partitionBy("symbol", F.floor(F.col(BAR) / n))
    kept = {"n": F.count(x), "sum": F.sum(x), "mean": F.avg(x), "variance": F.var_pop(x), "low": F.min(x), "high": F.max(x)}
    out = {}
    for side, order in (("begin", F.asc(BAR)), ("end", F.desc(BAR))):
        upto = by_block.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        out[f"{name}_{side}"] = F.struct(*[c.over(upto).alias(k) for k, c in kept.items()])
    return out


def frame(name: str, n: int) -> Column:
    """sum, mean, squares (about the mean) of the last n bars, from the columns of `parts`; null unless all n have a value."""
    begin = F.col(f"{name}_begin")
    # At the last bar of a block the frame is the block.
    end = F.when(F.col(BAR) % n != n - 1, F.lag(f"{name}_end", n - 1).over(Window.partitionBy("symbol").orderBy(BAR)))
    a, b = F.coalesce(end["n"], F.lit(0)), begin["n"]
    whole = F.when(a > 0, end["sum"] + begin["sum"]).otherwise(begin["sum"])
    apart = F.when(a > 0, F.pow(end["mean"] - begin["mean"], 2) * a * b / n).otherwise(0.0)
    # Means of equal values differ in their last bits, but a flat frame has no spread.
    flat = (begin["low"] == begin["high"]) & ((a == 0) | ((end["low"] == begin["low"]) & (end["high"] == begin["high"])))
    squares = F.when(flat, 0.0).otherwise(F.coalesce(end["variance"] * a, F.lit(0.0)) + begin["variance"] * b + apart)
    mean = F.when(a > 0, (a * end["mean"] + b * begin["mean"]) / n).otherwise(begin["mean"])
    return F.when(a + b == n, F.struct(whole.cast("double").alias("sum"), mean.alias("mean"), squares.alias("squares")))
