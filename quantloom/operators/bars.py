"""Time-bucketed bars from ticks or finer bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def aggregates() -> list[Column]:
    """What a bar says of its ticks; sums are combined map-side."""
    at = F.struct("ts", "seq")
    return [
        F.min_by("open", at).alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("close", at).alias("close"),
        *[F.sum(c).cast("double").alias(c) for c in ("volume", "quote_volume")],
        F.sum("trades").cast("long").alias("trades"),
        F.sum("taker_buy_quote").cast("double").alias("taker_buy_quote"),
        F.count(F.lit(1)).cast("int").alias("n_minutes"),
    ]


def bars(ticks: DataFrame, bucket: str = "hour", keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """The keys, ts (left edge), open, high, low, close, volume, quote_volume, trades, taker_buy_quote, n_minutes.

    ticks: symbol, ts, seq (orders ticks of one instant), open, high, low, close, volume, quote_volume,
    trades, taker_buy_quote. One pass; n_minutes counts rows, repeated ones too.
    """
    return ticks.groupBy(*keys, F.date_trunc(bucket, "ts").alias("bar")).agg(*aggregates()).withColumnRenamed("bar", "ts")
