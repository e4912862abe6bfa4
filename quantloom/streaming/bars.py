"""Hourly bars from a stream of ticks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.operators.bars import aggregates

COLUMNS = ("open", "high", "low", "close", "volume", "quote_volume", "trades", "taker_buy_quote", "n_minutes")

def streaming_bars(ticks: DataFrame, late: str = "2 hours", bucket: str = "1 hour") -> DataFrame:
    """Bars of a streaming table of ticks; a bar is final, and its state dropped, `late` after its end.

    The batch operator's aggregates, over an event-time window behind a watermark.
    """
    grouped = ticks.withWatermark("ts", late).groupBy("symbol", F.window("ts", bucket).alias("span"))
    return grouped.agg(*aggregates()).withColumn("ts", F.col("span.start")).select("symbol", "ts", *COLUMNS)
