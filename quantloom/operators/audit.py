"""How much of the best trial's result survives the search: relational statistics over trial series.

Series stay long, (trial, ts, net). Compared Sharpe ratios are rounded to TIE_DIGITS digits: sums over
partitions differ in the last bits between runs, and duplicate trials are legal.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions.deflation import expected_max_sharpe, probabilistic_sharpe
from quantloom.operators.backtest import PERIODS_A_YEAR
from quantloom.operators.scans import mean_rank, time_axis

TIE_DIGITS = 12
#: Bars whose returns, of all trials, a task holds as one matrix.
BARS = 4096
#: Choices of blocks that a task judges in one go.
SPLITS = 1024
#: The costs that results are reported at.
COSTS_BPS = (0.0, 1.0, 2.0, 5.0, 10.0, 20.0, 50.0)


def finite(x: str | Column) -> Column:
    """x, or 0 where it is null, NaN or infinite."""
    x = F.col(x) if isinstance(x, str) else x
    return F.when(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")), x).otherwise(0.0)


def numbered(series: DataFrame) -> DataFrame:
    """trial, t (0, 1, ... in order of ts), n_bars (of all trials), net; where a trial has no bar, its return counts as 0."""
    axis = time_axis(series).select("ts", "t", "n_bars")
    return series.select("trial", "ts", finite("net").alias("net")).join(axis, "ts").select("trial", "t", "n_bars", "net")


def trial_moments(bars: DataFrame) -> DataFrame:
    """trial, mean, sd (sample) over all bars, those that a trial lacks being 0."""
    n, c = F.col("n"), F.col("c")
    own = bars.groupBy("trial").agg(F.max("n_bars").alias("n"), F.count(F.lit(1)).alias("c"), F.avg("net").alias("m"), F.var_pop("net").alias("v"))
    squares = F.col("v") * c + F.col("m") * F.col("m") * c * (n - c) / n
    return own.select("trial", (F.col("m") * c / n).alias("mean"), F.when(n > 1, F.sqrt(F.try_divide(squares, n - 1))).alias("sd"))


def returns_matrix(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Trials, and the returns of a block of BARS numbered bars by trial; 0 where there are none."""
    t, n_bars = np.asarray(rows["t"]), int(rows["n_bars"][0].as_py())
    first = int(t[0]) // BARS * BARS
    names, column = np.unique(np.asarray(rows["trial"]), return_inverse=True)
    matrix = np.zeros((min(BARS, n_bars - first), len(names)))
    matrix[t - first, column] = np.asarray(rows["net"])
    return names, matrix


def block_moments(bars: DataFrame, n_blocks: int) -> DataFrame:
    """trial, block, n, s, ss over equal contiguous blocks; bars that do not fill one more each are left out."""
    size = F.floor(F.col("n_bars") / n_blocks)
    inside = bars.withColumn("size", size).where(F.col("t") < F.col("size") * n_blocks)
    block = F.floor(F.col("t") / F.col("size")).cast("int")
    return inside.groupBy("trial", block.alias("block")).agg(F.max("size").alias("n"), F.sum("net").alias("s"), F.sum(F.col("net") * F.col("net")).alias("ss"))


def _moment_sharpes(n: np.ndarray, s: np.ndarray, ss: np.ndarray) -> np.ndarray:
    """Mean over population deviation, 0 for a constant series."""
    mean = s / n
    spread = np.sqrt(np.maximum(ss / n - mean * mean, 0.0))
    return np.round(np.divide(mean, spread, out=np.zeros_like(mean), where=spread > 0), TIE_DIGITS)


def even(n_blocks: int) -> int:
    return n_blocks - n_blocks % 2


def cscv_cloud(series: DataFrame, n_blocks: int = 10) -> DataFrame:
    """split, is_sharpe, oos_sharpe, logit: the in-sample winner of every choice of half the blocks.

    A split is a number whose binary digits say which blocks are in sample. A task has SPLITS splits and the moments of all
    trials by block, and multiplies a matrix of the one by one of the other: there is a row for each split, and none for a split and a trial.
    """
    blocks = even(n_blocks)
    moments = block_moments(numbered(series), blocks)
    every = [m for m in range(1 << blocks) if m.bit_count() == blocks // 2]  # 12 870 for 16 blocks, which runs do not exceed

    def judged(rows: pa.Table) -> pa.Table:
        first = int(rows["part"][0].as_py()) * SPLITS
        splits = np.array(every[first : first + SPLITS], np.int64)
        inside = (splits[:, None] >> np.arange(blocks)) & 1
        names, column = np.unique(np.asarray(rows["trial"]), return_inverse=True)
        block = np.asarray(rows["block"]).astype(np.int64)
        held = {c: np.zeros((blocks, len(names))) for c in ("n", "s", "ss")}
        for c, matrix in held.items():
            matrix[block, column] = np.asarray(rows[c]).astype(float)
        held["n"][:] = held["n"].max()  # a trial without a bar in some block has zeros there
        i, o = (_moment_sharpes(*(side @ held[c] for c in ("n", "s", "ss"))) for side in (inside, 1 - inside))
        best = i.argmax(1)  # the first of equals, in order of trials
        at = np.arange(len(splits))
        chosen = o[at, best]
        omega = np.clip((o <= chosen[:, None]).sum(1) / (len(names) + 1), 1e-9, 1 - 1e-9)
        return pa.table({"split": splits, "is_sharpe": i[at, best], "oos_sharpe": chosen, "logit": np.log(omega / (1 - omega))})

    parts = F.explode(F.sequence(F.lit(0), F.lit((len(every) - 1) // SPLITS))).alias("part")
    dealt = moments.select(parts, F.col("trial").cast("long").alias("trial"), "block", "n", "s", "ss")
    return dealt.groupBy("part").applyInArrow(judged, "split long, is_sharpe double, oos_sharpe double, logit double")


def pbo_summary(cloud: DataFrame) -> DataFrame:
    """pbo and what else the cloud says, one row."""
    row = cloud.agg(
        F.avg((F.col("logit") < 0).cast("double")).alias("pbo"),
        F.count(F.lit(1)).alias("n_combinations"),
        F.median("is_sharpe").alias("median_is_sharpe"),
        F.median("oos_sharpe").alias("median_oos_sharpe"),
        F.avg((F.col("oos_sharpe") < 0).cast("double")).alias("prob_oos_loss"),
        F.coalesce(F.regr_slope("oos_sharpe", "is_sharpe"), F.lit(0.0)).alias("deterioration_slope"),
    )
    return row.withColumn("selection_premium", F.col("median_is_sharpe") - F.col("median_oos_sharpe"))


def correlations(series: DataFrame) -> DataFrame:
    """a, b, rho of every pair of trials, 0 where one is constant.

    A task multiplies the returns of BARS bars by themselves; blocks of bars are then added up, so that
    what is moved is the returns once and a row for each pair and block.
    """

    def squares(rows: pa.Table) -> pa.Table:
        names, matrix = returns_matrix(rows)
        k = len(names)
        return pa.table({"a": np.repeat(names, k).astype(np.int64), "b": np.tile(names, k).astype(np.int64), "n": np.full(k * k, int(rows["n_bars"][0].as_py())), "s": np.repeat(matrix.sum(0), k), "sxy": (matrix.T @ matrix).ravel()})

    blocks = numbered(series).groupBy(F.floor(F.col("t") / BARS).alias("block")).applyInArrow(squares, "a long, b long, n long, s double, sxy double")
    products = blocks.groupBy("a", "b").agg(F.max("n").alias("n"), F.sum("s").alias("s"), F.sum("sxy").alias("sxy"))
    own = products.where("a = b").select("a", "n", F.col("s").alias("sx"), F.col("sxy").alias("sxx"))
    # All trials in one row, to pair those that have no block of bars in common, too.
    every = own.agg(F.collect_list(F.struct(F.col("a").alias("b"), F.col("sx").alias("sy"), F.col("sxx").alias("syy"))).alias("others"))
    pairs = own.crossJoin(F.broadcast(every)).select("*", F.inline("others")).join(products.select("a", "b", "sxy"), ["a", "b"], "left").withColumn("sxy", F.coalesce("sxy", F.lit(0.0)))
    over = F.col("sxx") - F.col("sx") * F.col("sx") / F.col("n")
    other = F.col("syy") - F.col("sy") * F.col("sy") / F.col("n")
    cross = F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n")
    usable = (over > 1e-18) & (other > 1e-18)
    rho = F.when(F.col("a") == F.col("b"), F.when(usable, 1.0).otherwise(0.0)).otherwise(F.when(usable, cross / F.sqrt(F.greatest(over * other, F.lit(1e-300)))).otherwise(0.0))
    kind = series.schema["trial"].dataType
    return pairs.select(F.col("a").cast(kind).alias("a"), F.col("b").cast(kind).alias("b"), rho.alias("rho"))


def participation(rho: DataFrame) -> DataFrame:
    """participation_ratio and mean_abs_corr, one row.

    The eigenvalues of a correlation matrix sum to its trials and their squares to its squared
    entries, so no eigenvalue is needed. Constant trials are left out of the ratio.
    """
    kept = F.sum(F.when((F.col("a") == F.col("b")) & (F.col("rho") == 1), 1).otherwise(0))
    ratio = F.when(kept < 2, 1.0).otherwise(F.try_divide(kept * kept, F.sum(F.col("rho") * F.col("rho"))))
    return rho.agg(ratio.cast("double").alias("participation_ratio"), F.coalesce(F.avg(F.when(F.col("a") != F.col("b"), F.abs("rho"))), F.lit(0.0)).alias("mean_abs_corr"))


def return_moments(series: DataFrame) -> DataFrame:
    """trial, n_obs, mean, sd (sample), skew and kurtosis (population; 0 and 3 for a constant series)."""
    x = finite("net")
    return series.groupBy("trial").agg(
        F.count(F.lit(1)).alias("n_obs"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"),
        F.coalesce(F.skewness(x), F.lit(0.0)).alias("skew"), F.coalesce(F.kurtosis(x) + 3, F.lit(3.0)).alias("kurtosis"),
    )


@dataclass(frozen=True)
class Deflation:
    n_trials: int
    n_obs: int
    ann_periods: int
    sr_ann: float
    sr_trials_std_ann: float
    sr0_ann: float
    skew: float
    kurtosis: float
    psr_vs_zero: float
    dsr: float


def deflate(moments: dict, trial_sharpes: list[float | None], periods: int = PERIODS_A_YEAR) -> Deflation:
    """The winner's moments (a row of return_moments) against the expected best of all trials' Sharpe ratios."""
    known = [s for s in trial_sharpes if s is not None and math.isfinite(s)]
    mean = sum(known) / len(known) if known else 0.0
    spread = math.sqrt(sum((s - mean) ** 2 for s in known) / (len(known) - 1)) if len(known) > 1 else 0.0
    bar = moments["mean"] / moments["sd"] if moments["sd"] else 0.0
    best, root = expected_max_sharpe(len(known), spread), math.sqrt(periods)
    shape = (moments["n_obs"], moments["skew"], moments["kurtosis"])
    return Deflation(len(known), moments["n_obs"], periods, bar * root, spread, best, *shape[1:], probabilistic_sharpe(bar, *shape), probabilistic_sharpe(bar, *shape, best / root))


def cost_curve(series: DataFrame, costs_bps: tuple[float, ...] = COSTS_BPS, periods: int = PERIODS_A_YEAR) -> DataFrame:
    """trial, cost_bps, sharpe, break_even_bps: net Sharpe ratios at other costs, from one pass of the series."""
    costs = F.explode(F.array(*map(F.lit, costs_bps)))
    charged = series.select("trial", "gross", "turnover", costs.alias("cost_bps")).withColumn("net", finite("gross") - finite("turnover") * F.col("cost_bps") / 1e4)
    spread = F.stddev_samp("net")
    return charged.groupBy("trial", "cost_bps").agg(
        F.when(spread > 0, F.avg("net") / spread * math.sqrt(periods)).alias("sharpe"), F.when(F.avg("turnover") > 0, F.avg("gross") / F.avg("turnover") * 1e4).alias("break_even_bps")
    )


def rank_correlation(table: DataFrame, x: str, y: str) -> DataFrame:
    """Spearman's rank correlation of two columns, one row; equal values share their mean rank."""
    held = table.select(F.col(x).alias("x"), F.col(y).alias("y")).where("x is not null and y is not null")
    ranks = mean_rank(mean_rank(held, "x", "p"), "y", "q")
    n = F.count(F.lit(1))
    cross = F.sum(F.col("p") * F.col("q")) - F.sum("p") * F.sum("q") / n
    sizes = (F.sum(F.col("p") * F.col("p")) - F.sum("p") * F.sum("p") / n) * (F.sum(F.col("q") * F.col("q")) - F.sum("q") * F.sum("q") / n)
    return ranks.agg(F.when(sizes > 0, cross / F.sqrt(F.greatest(sizes, F.lit(1e-300)))).alias("rank_correlation"), n.alias("n"))


def factor_model(panel: DataFrame) -> DataFrame:
    """symbol, n, beta, idio_sd, mean: each symbol's returns against the mean return of all symbols at a bar."""
    market = panel.groupBy("ts").agg(F.avg("ret").alias("factor"))
    both = panel.select("symbol", "ts", "ret").join(market, "ts").dropna(subset=["ret", "factor"])
    sd, other = F.stddev_samp("ret"), F.stddev_samp("factor")
    rho = F.least(F.greatest(F.coalesce(F.try_divide(F.covar_samp("ret", "factor"), sd * other), F.lit(0.0)), F.lit(-0.99)), F.lit(0.99))
    return both.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(rho * F.try_divide(sd, other), F.lit(0.0)).alias("beta"), (sd * F.sqrt(1 - rho * rho)).alias("idio_sd"), F.avg("ret").alias("mean")
    )


def provenance(panel: DataFrame, rebalance_every_h: int = 24) -> DataFrame:
    """What a run was made on, one row; turnover_ratio: symbols that were ever traded for each place in the universe.

    What is counted are rows of two small tables, one of bars and one of symbols, which are added up before they are moved; no
    row of the panel is multiplied for a distinct count.
    """
    inside = F.when(F.col("in_universe"), F.lit(1))
    slot = F.floor(F.unix_seconds("ts") / (3600 * rebalance_every_h))
    by_bar = panel.groupBy("ts").agg(F.count(inside).alias("members"), F.count(F.lit(1)).alias("rows"))
    by_slot = by_bar.groupBy(slot.alias("slot")).agg(
        F.min("ts").alias("start"), F.max("ts").alias("end"), F.count(F.lit(1)).alias("bars"), F.sum("members").alias("members"), F.sum((F.col("members") > 0).cast("long")).alias("held")
    )
    bars = by_slot.agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.coalesce(F.sum("bars"), F.lit(0)).alias("n_bars"),
        F.coalesce(F.sum((F.col("members") > 0).cast("long")), F.lit(0)).alias("n_rebalances"), F.try_divide(F.sum("members"), F.sum("held")).alias("mean_universe_size"),
    )
    by_symbol = panel.groupBy("symbol").agg(F.count(inside).alias("times"))
    symbols = by_symbol.agg(F.count("symbol").alias("n_symbols_available"), F.count(F.when(F.col("times") > 0, F.col("symbol"))).alias("n_symbols_traded"))
    row = bars.crossJoin(symbols)  # one row each
    places = F.floor(F.col("mean_universe_size") + 0.5)
    ratio = F.coalesce(F.when(places > 0, F.try_divide("n_symbols_traded", places)), F.lit(0.0)).alias("turnover_ratio")
    return row.select("start", "end", "n_bars", "n_symbols_available", "n_symbols_traded", "n_rebalances", "mean_universe_size", ratio)
