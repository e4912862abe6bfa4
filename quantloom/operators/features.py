"""The feature panel: a gap-free grid of bars with returns and universe membership."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions.time import whole_hours
from quantloom.operators import scans
from quantloom.operators.scans import asof_join  # noqa: F401

PRICES = ("open", "high", "low", "close")
FLOWS = ("volume", "quote_volume", "trades", "taker_buy_quote", "n_minutes")


def gap_free(panel: DataFrame) -> DataFrame:
    """Every hourly bar from a symbol's first to its last: prices carried forward, flows 0, is_real false where none was."""
    return scans.gap_free(panel, [c for c in PRICES if c in panel.columns], [c for c in FLOWS if c in panel.columns])


def with_returns(grid: DataFrame) -> DataFrame:
    """ret (from the bar before) and taker_imb (-1 to 1; null without volume)."""
    order = Window.partitionBy("symbol").orderBy("ts")
    imbalance = F.when(F.col("quote_volume") > 0, F.try_divide(2.0 * F.col("taker_buy_quote"), F.col("quote_volume")) - 1.0)
    return grid.withColumns({"ret": F.try_divide("close", F.lag("close", 1).over(order)) - 1.0, "taker_imb": imbalance})


def with_membership(features: DataFrame, chosen: DataFrame, rebalance_every_h: int) -> DataFrame:
    """in_universe: chosen at a bar not rebalance_every_h or more hours before.

    Choices are put into the stream of their symbol's bars and carried on from there, so that no join moves the panel.
    """
    picks = chosen.select("symbol", F.col("asof").alias("ts"), "asof", F.lit(0).alias("side"))
    past = Window.partitionBy("symbol").orderBy("ts", "side").rowsBetween(Window.unboundedPreceding, 0)
    both = features.withColumn("side", F.lit(1)).unionByName(picks, allowMissingColumns=True)
    carried = both.withColumn("asof", F.last("asof", ignorenulls=True).over(past)).where("side = 1")
    inside = F.col("asof").isNotNull() & (whole_hours(F.col("asof"), F.col("ts")) < rebalance_every_h)
    return carried.withColumn("in_universe", inside).drop("asof", "side")


def feature_panel(panel: DataFrame, chosen: DataFrame, rebalance_every_h: int = 24) -> DataFrame:
    """The panel that signals are evaluated on. Gaps are filled by segments of a symbol; the rest shares one partitioning by symbol, which signals go on with."""
    done = with_returns(with_membership(gap_free(panel), chosen, rebalance_every_h))
    return done.select(*[c for c in done.columns if c != "in_universe"], "in_universe")
