"""The universe of a stream of bars: what every symbol's frames hold at a rebalance bar, as soon as no bar can be missing from them."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from quantloom.functions.time import HOUR_MICROS as HOUR
from quantloom.operators.universe import UniverseRules

SUMS = "symbol string, us long, adv_bars long, adv_volume double, stale_fresh long, stale_rows long, first timestamp"
#: The state store that keyed state with timers needs.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Frames(StatefulProcessor):
    """Per symbol: sums of slots of hours, as long as a frame can reach them, and a timer for every rebalance bar.

    A timer fires when the watermark has passed its bar; bars that came late, but before that, are in their slots by then.
    """

    def __init__(self, rules: UniverseRules):
        self.rules = rules
        self.slot = math.gcd(24, rules.rebalance_every_h, rules.adv_window_h, rules.stale_window_h) * HOUR
        self.reach = max(rules.adv_window_h, rules.stale_window_h) * HOUR

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.slots = handle.getMapState("slots", "us long", "bars long, volume double, fresh long, rows long")
        self.first = handle.getValueState("first", "us long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        watermark = pd.Timestamp(max(timerValues.getCurrentWatermarkInMs(), 0), unit="ms")
        for batch in rows:
            batch = batch[batch["ts"] >= watermark]  # timers up to there have fired
            if batch.empty:
                continue
            us = batch["ts"].astype("datetime64[us]").astype("int64")
            first = self.first.get()[0] if self.first.exists() else None
            low = int(us.min())
            self.first.update((low if first is None else min(first, low),))
            held = pd.DataFrame({"slot": us // self.slot * self.slot, "volume": batch["quote_volume"], "rows": batch["n_minutes"]})
            for slot, own in held.groupby("slot"):
                old = self.slots.getValue((slot,)) if self.slots.containsKey((slot,)) else (0, 0.0, 0, 0)
                new = (int(own["volume"].count()), float(own["volume"].sum()), int(own["rows"].count()), int(own["rows"].sum()))
                self.slots.updateValue((slot,), tuple(a + b for a, b in zip(old, new, strict=True)))
            for at in us[(us % HOUR == 0) & (us // HOUR % 24 % self.rules.rebalance_every_h == 0)]:
                self.handle.registerTimer(int(at) // 1000)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        at = expiredTimerInfo.getExpiryTimeInMs() * 1000
        adv, stale, old = at - self.rules.adv_window_h * HOUR, at - self.rules.stale_window_h * HOUR, []
        bars, volume, fresh, rows = 0, 0.0, 0, 0
        for (slot,), (b, v, f, r) in self.slots.iterator():
            if slot < at - self.reach:
                old.append(slot)
            if adv <= slot < at:
                bars, volume = bars + b, volume + v
            if stale <= slot < at:
                fresh, rows = fresh + f, rows + r
        for slot in old:  # timers fire in order, so none reaches back so far
            self.slots.removeKey((slot,))
        first = pd.Timestamp(self.first.get()[0], unit="us")
        yield pd.DataFrame({"symbol": [key[0]], "us": [at], "adv_bars": [bars], "adv_volume": [volume], "stale_fresh": [fresh], "stale_rows": [rows], "first": [first]})

    def close(self) -> None:
        pass


def streaming_sums(bars: DataFrame, rules: UniverseRules = UniverseRules(), late: str = "2 hours") -> DataFrame:
    """SUMS of every symbol and rebalance bar of a streaming table of bars (symbol, ts, quote_volume, n_minutes), each once.

    A row comes when the watermark, `late` behind the latest bar of any symbol, has passed its bar; bars later than that are left out.
    `quantloom.operators.universe.ranked` makes the universe of what has been written.
    """
    bars.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    marked = bars.withWatermark("ts", late).select("symbol", "ts", F.col("quote_volume").cast("double").alias("quote_volume"), F.col("n_minutes").cast("double").alias("n_minutes"))
    return marked.groupBy("symbol").transformWithStateInPandas(Frames(rules), StructType.fromDDL(SUMS), "append", "eventTime")
