"""Point-in-time universe: who could be traded at a bar, judged by bars before it only."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions.time import HOUR_MICROS as HOUR
from quantloom.functions.time import whole_hours
from quantloom.operators.frames import range_sums


@dataclass(frozen=True)
class UniverseRules:
    rebalance_every_h: int = 24
    min_history_h: int = 720
    adv_window_h: int = 720
    adv_min_bars: int = 360
    min_adv_usd: float = 1e5
    stale_window_h: int = 24
    #: Bars that the stale window has to hold; None: one an hour.
    stale_min_bars: int | None = None
    min_coverage: float = 0.9
    max_symbols: int = 50
    #: Rows that a fully covered hour has.
    rows_per_h: float = 60.0


def universe(panel: DataFrame, rules: UniverseRules = UniverseRules()) -> DataFrame:
    """asof, symbol, adv_usd, history_h, coverage_24h, rank, by mean hourly volume at every rebalance bar.

    Frames are left-closed in time, [t - w, t): the bar itself, and whatever comes after it, cannot
    change its universe. Rebalance bars are on the hour, so their frames are whole slots of as many hours as divide all
    windows and the day: bars are first added up by slot, and only slots and rebalance bars go on to the frames.
    """
    slot = math.gcd(24, rules.rebalance_every_h, rules.adv_window_h, rules.stale_window_h) * HOUR
    us = F.unix_micros("ts")
    slots = panel.groupBy("symbol", (F.floor(us / slot) * slot).alias("us")).agg(
        F.count("quote_volume").alias("bars"), F.sum("quote_volume").alias("volume"), F.count("n_minutes").alias("fresh"), F.sum("n_minutes").alias("rows")
    )
    first = panel.groupBy("symbol").agg(F.min("ts").alias("first"))
    asks = panel.where((F.hour("ts") % rules.rebalance_every_h == 0) & (us % HOUR == 0)).select("symbol", us.alias("us"))
    widths = {"adv": rules.adv_window_h * HOUR, "stale": rules.stale_window_h * HOUR}
    sums = range_sums(slots, asks, "symbol", widths, ["bars", "volume", "fresh", "rows"]).join(first, "symbol")
    return ranked(sums, rules)


def ranked(sums: DataFrame, rules: UniverseRules = UniverseRules()) -> DataFrame:
    """The universe from (symbol, us, adv_bars, adv_volume, stale_fresh, stale_rows, first): what a symbol's frames hold at a rebalance bar."""
    seen = sums.select(
        "symbol", F.timestamp_micros("us").alias("ts"),
        F.when(F.col("adv_bars") >= rules.adv_min_bars, F.try_divide("adv_volume", "adv_bars")).alias("adv_usd"),
        F.when(F.col("stale_fresh") >= (rules.stale_window_h if rules.stale_min_bars is None else rules.stale_min_bars), F.col("stale_rows")).alias("rows"),
        whole_hours(F.col("first"), F.timestamp_micros("us")).alias("history_h"),
    )
    covered = seen.withColumn("coverage_24h", F.col("rows") / F.lit(rules.stale_window_h * rules.rows_per_h))
    eligible = covered.where(
        (F.col("history_h") >= rules.min_history_h)
        & (F.col("adv_usd") >= rules.min_adv_usd)
        & (F.col("rows") >= rules.min_coverage * rules.stale_window_h * rules.rows_per_h)
    )
    rank = F.row_number().over(Window.partitionBy("ts").orderBy(F.desc("adv_usd"), "symbol"))
    ranked = eligible.withColumn("rank", rank.cast("int")).where(F.col("rank") <= rules.max_symbols)
    return ranked.select(F.col("ts").alias("asof"), "symbol", "adv_usd", "history_h", "coverage_24h", "rank")


def last_rebalance(chosen: DataFrame, n: int = 5) -> DataFrame:
    """asof, size, top: who was chosen last, the first n by rank; one row, none of an empty universe."""
    latest = F.max_by(F.col("members"), F.col("asof"))
    by_bar = chosen.groupBy("asof").agg(F.array_sort(F.collect_list(F.struct("rank", "symbol"))).alias("members"))  # max_symbols at most
    row = by_bar.agg(F.max("asof").alias("asof"), latest.alias("members")).where("asof is not null")
    return row.select("asof", F.size("members").alias("size"), F.transform(F.slice("members", 1, n), lambda m: m["symbol"]).alias("top"))


def manifest(panel: DataFrame, chosen: DataFrame, n: int = 5) -> DataFrame:
    """What a panel and its universe hold, one row: bars, symbols, start, end, universe_rows, last_asof, last_size, last_top."""
    size = panel.groupBy("symbol").agg(F.count(F.lit(1)).alias("bars"), F.min("ts").alias("start"), F.max("ts").alias("end")).agg(
        F.coalesce(F.sum("bars"), F.lit(0)).alias("bars"), F.count("symbol").alias("symbols"), F.min("start").alias("start"), F.max("end").alias("end")
    )
    rows, last = chosen.agg(F.count(F.lit(1)).alias("universe_rows")), last_rebalance(chosen, n)
    return size.crossJoin(rows).join(last.select(F.col("asof").alias("last_asof"), F.col("size").alias("last_size"), F.col("top").alias("last_top")), F.lit(True), "left")  # one row each
