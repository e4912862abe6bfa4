"""Made-up panels: random walks for tests, and noise that imitates a real panel without any edge in it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.operators.audit import factor_model
from quantloom.sources.bars import PANEL

#: Fixed value: degrees of freedom of the noise, as fat in the tails as hourly returns.
FREEDOM = 4.0
#: Own choices, without influence on what a test may find: deviation of a walk's hourly logarithm, of the logarithm
#: of its volume, and how narrowly the bought share of volume lies about a half.
WALK_SD, FLOW_SD, EVENNESS = 0.006, 0.5, 30.0
#: The least that a made-up return may be: a price stays above 0.
WORST = -0.9


def _bars(symbol: str, start: pd.Timestamp, close: np.ndarray, flow: np.ndarray, bought: np.ndarray) -> pd.DataFrame:
    """Bars that open where the one before closed."""
    opened = np.concatenate([close[:1], close[:-1]])
    return pd.DataFrame({
        "symbol": symbol, "ts": start + pd.to_timedelta(np.arange(len(close)), unit="h"),
        "open": opened, "high": np.maximum(opened, close), "low": np.minimum(opened, close), "close": close,
        "volume": flow / close, "quote_volume": flow, "trades": 1 + (np.sqrt(flow)).astype(np.int64), "taker_buy_quote": flow * bought, "n_minutes": np.int32(60),
    })


def random_walks(spark: SparkSession, symbols: dict[str, float], hours: int, start: str = "2024-01-01", seed: int = 7) -> DataFrame:
    """Hourly bars of log-normal walks; symbols: name to median hourly volume. A symbol's walk is its own."""
    table = spark.createDataFrame(list(symbols.items()), "symbol string, volume double")

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                rng = np.random.default_rng([seed, *row.symbol.encode()])
                flow = row.volume * rng.lognormal(0, FLOW_SD, hours)
                close = 10 * np.exp(rng.normal(0, WALK_SD, hours).cumsum())
                yield _bars(row.symbol, pd.Timestamp(start), close, flow, rng.beta(EVENNESS, EVENNESS, hours))

    return table.mapInPandas(walk, PANEL)


def calibrated(panel: DataFrame) -> DataFrame:
    """A row a symbol of what `null_panel` needs: beta, idio_sd, flow (mean and deviation of its logarithm), and the whole panel's factor_sd, start, hours."""
    order = "lag(close, 1) over (partition by symbol order by ts)"
    returns = panel.select("symbol", "ts", F.expr(f"try_divide(close, {order}) - 1").alias("ret"))
    factor = returns.groupBy("ts").agg(F.avg("ret").alias("f")).agg(F.coalesce(F.stddev_samp("f"), F.lit(0.0)).alias("factor_sd"))
    axis = panel.agg(F.min("ts").alias("start"), F.countDistinct("ts").alias("hours"))
    logs = F.ln(F.when(F.col("quote_volume") > 0, F.col("quote_volume")))
    flow = panel.groupBy("symbol").agg(F.coalesce(F.avg(logs), F.lit(0.0)).alias("flow"), F.coalesce(F.stddev_samp(logs), F.lit(0.0)).alias("flow_sd"))
    whole = factor.crossJoin(axis)  # of one row each
    return factor_model(returns).join(flow, "symbol").crossJoin(F.broadcast(whole)).fillna(0.0, ["beta", "idio_sd"])


def fat(rng: np.random.Generator, n: int) -> np.ndarray:
    """Student-t numbers of variance one."""
    return rng.standard_t(FREEDOM, n) * np.sqrt(1 - 2 / FREEDOM)


def null_panel(model: DataFrame, seed: int) -> DataFrame:
    """Bars from a market factor and Student-t noise: nothing predicts a cross section of them.

    A symbol's noise comes from (seed, symbol) and the factor from the seed alone, so a symbol is made by
    itself in whatever task it is.
    """

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                hours, own = int(row.hours), np.random.default_rng([seed, 1, *row.symbol.encode()])
                flow = np.exp(own.normal(row.flow, row.flow_sd, hours))
                bought = own.beta(EVENNESS, EVENNESS, hours)
                moves = row.idio_sd * fat(own, hours) + row.beta * row.factor_sd * fat(np.random.default_rng([seed, 0]), hours)
                close = 10 * np.exp(np.log1p(np.maximum(moves, WORST)).cumsum())
                yield _bars(row.symbol, pd.Timestamp(row.start), close, flow, bought)

    return model.mapInPandas(made, PANEL)
