"""Operations of the signal language as Columns.

An operation is of one kind by what it needs: `time` a window over a symbol's bars, `frame` the sums of a frame of its last
bars (a column of `quantloom.operators.frames`), `cross` a window over the symbols of a bar, `value` nothing but the row. Operations on cross sections see only
members of the universe. Divisions give null where they have no value, never NaN or an error.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Operation:
    kind: str
    parameters: int
    build: Callable[..., Column]


def bars():
    return Window.partitionBy("symbol").orderBy("ts")


def _masked(x: Column) -> Column:
    return F.when(F.col("in_universe"), x)


def _over_bar(aggregate: Callable[[Column], Column], x: Column) -> Column:
    return aggregate(x).over(Window.partitionBy("ts"))


def ts_mean(x: Column, frame: Column, n: int) -> Column:
    return frame["mean"]


def ts_std(x: Column, frame: Column, n: int) -> Column:
    return F.sqrt(frame["squares"] / (n - 1)) if n > 1 else F.lit(None).cast("double")


def ts_sum(x: Column, frame: Column, n: int) -> Column:
    return frame["sum"]


def ts_zscore(x: Column, frame: Column, n: int) -> Column:
    return F.try_divide(x - ts_mean(x, frame, n), ts_std(x, frame, n))


def ts_ret(x: Column, n: int) -> Column:
    return F.try_divide(x, F.lag(x, n).over(bars())) - 1


def cs_demean(x: Column) -> Column:
    return _masked(x) - _over_bar(F.avg, _masked(x))


def cs_zscore(x: Column) -> Column:
    return F.try_divide(cs_demean(x), _over_bar(F.stddev_samp, _masked(x)))


def cs_rank(x: Column) -> Column:
    """Average rank over the number of members, less a half; members without a value have none."""
    held = _masked(x)
    # Nulls have a partition of their own, else rank() would count them.
    valued = Window.partitionBy("ts", held.isNull())
    ties = F.count(F.lit(1)).over(Window.partitionBy("ts", held))
    place = F.rank().over(valued.orderBy(held)) + (ties - 1) / 2
    return F.when(held.isNotNull(), F.try_divide(place, F.count(held).over(Window.partitionBy("ts"))) - 0.5)


def clip(x: Column, k: float) -> Column:
    # greatest and least pass over nulls, so those are kept apart.
    return F.when(x.isNotNull() & ~F.isnan(x), F.greatest(F.lit(-float(k)), F.least(F.lit(float(k)), x)))


FIELDS: dict[str, Callable[[], Column]] = {
    "ret": lambda: F.col("ret"),
    "close": lambda: F.col("close"),
    "dollar_vol": lambda: F.col("quote_volume"),
    "taker_imb": lambda: F.col("taker_imb"),
    "trades": lambda: F.col("trades").cast("double"),
}

OPERATIONS: dict[str, Operation] = {
    "ts_mean": Operation("frame", 1, ts_mean),
    "ts_std": Operation("frame", 1, ts_std),
    "ts_sum": Operation("frame", 1, ts_sum),
    "ts_ret": Operation("time", 1, ts_ret),
    "ts_zscore": Operation("frame", 1, ts_zscore),
    "cs_demean": Operation("cross", 0, cs_demean),
    "cs_zscore": Operation("cross", 0, cs_zscore),
    "cs_rank": Operation("cross", 0, cs_rank),
    "neg": Operation("value", 0, lambda x: -x),
    "sign": Operation("value", 0, F.signum),
    "abs": Operation("value", 0, F.abs),
    "clip": Operation("value", 1, clip),
}
