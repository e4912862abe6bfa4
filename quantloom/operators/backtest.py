"""From signals to dollar-neutral weights, to returns net of cost, for all trials of a grid in one plan.

The panel is never multiplied by the trials: a trial is a few columns. Trials that differ in sign
only share theirs, because negated weights earn the negated return with the same turnover. After the sums
over a bar, with one row a bar, columns become rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.operators.scans import equity, time_axis
from quantloom.plans.expressions import Call, Expression, as_expression, lookback
from quantloom.plans.grid import with_signals

PERIODS_A_YEAR = 8760


@dataclass(frozen=True)
class Trial:
    number: int
    #: Text of the signal language, its tree, or any Column over the panel.
    expression: str | Expression | Column
    rebalance_every_h: int = 24
    cost_bps: float = 5.0
    #: Bars that a Column looks back; that of an expression is known.
    column_lookback: int = 0

    @property
    def lookback(self) -> int:
        return self.column_lookback if isinstance(self.expression, Column) else lookback(self.expression)


def _rebalances(every_h: int) -> Column:
    return (F.hour("ts") % every_h == 0) & (F.minute("ts") == 0)


def with_weights(panel: DataFrame, signals: dict[str, tuple[str, int]]) -> DataFrame:
    """panel with a weight column for each name: (signal column, hours between rebalances).

    On a rebalance bar members' signals are demeaned and divided by the sum of their sizes; whoever
    has no signal then has weight 0, not its old weight. Between rebalances weights are carried.
    """
    by_bar = Window.partitionBy("ts")
    past = Window.partitionBy("symbol").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    held = {n: F.when(_rebalances(every) & F.col("in_universe"), F.col(signal)) for n, (signal, every) in signals.items()}
    apart = panel.withColumns({n: x - F.avg(x).over(by_bar) for n, x in held.items()})
    scaled = {}
    for n, (_, every) in signals.items():
        whole = F.coalesce(F.sum(F.abs(n)).over(by_bar), F.lit(0.0))
        weight = F.when(whole > 0, F.coalesce(F.try_divide(F.col(n), whole), F.lit(0.0))).otherwise(0.0)
        scaled[n] = F.when(_rebalances(every), weight)
    targets = apart.withColumns(scaled)
    return targets.withColumns({n: F.coalesce(F.last(n, ignorenulls=True).over(past), F.lit(0.0)) for n in signals})


def bar_sums(weighted: DataFrame, names: list[str]) -> DataFrame:
    """One row a bar with n_gross, n_turnover, n_exposure for each weight column n; positions lag weights by a bar."""
    order = Window.partitionBy("symbol").orderBy("ts")
    lagged = weighted.select("symbol", "ts", "ret", *[F.coalesce(F.lag(n, 1).over(order), F.lit(0.0)).alias(n) for n in names])
    moved = lagged.select("*", *[F.abs(F.col(n) - F.coalesce(F.lag(n, 1).over(order), F.lit(0.0))).alias(f"{n}_moved") for n in names])
    sums = []
    for n in names:
        sums += [
            F.sum(F.col(n) * F.coalesce("ret", F.lit(0.0))).alias(f"{n}_gross"),
            F.sum(f"{n}_moved").alias(f"{n}_turnover"),
            F.sum(F.abs(n)).alias(f"{n}_exposure"),
        ]
    return moved.groupBy("ts").agg(*sums)


def unsigned(expression: str | Expression | Column) -> tuple[Expression | Column, int]:
    """An expression without the negations around it, and its sign; a Column as it is."""
    if isinstance(expression, Column):
        return expression, 1
    node, sign = as_expression(expression), 1
    while isinstance(node, Call) and node.name == "neg":
        node, sign = node.of, -sign
    return node, sign


def trial_series(panel: DataFrame, trials: list[Trial]) -> DataFrame:
    """trial, ts, gross, turnover, gross_exposure, net of every trial and bar."""
    plain = [unsigned(t.expression) for t in trials]
    with_all, columns = with_signals(panel, [node for node, _ in plain])
    names: dict[tuple[str, int], str] = {}
    for column, trial in zip(columns, trials, strict=True):
        names.setdefault((column, trial.rebalance_every_h), f"w{len(names)}")
    weighted = with_weights(with_all, {n: key for key, n in names.items()})
    sums = bar_sums(weighted, list(names.values()))
    rows = []
    for column, (_, sign), t in zip(columns, plain, trials, strict=True):
        n = names[column, t.rebalance_every_h]
        gross, turnover = F.col(f"{n}_gross") * sign, F.col(f"{n}_turnover")
        rows.append(F.struct(
            F.lit(t.number).alias("trial"), gross.alias("gross"), turnover.alias("turnover"), F.col(f"{n}_exposure").alias("gross_exposure"),
            (gross - turnover * F.lit(t.cost_bps / 1e4)).alias("net"),
        ))
    return sums.select("ts", F.explode(F.array(*rows)).alias("row")).select("row.trial", "ts", "row.gross", "row.turnover", "row.gross_exposure", "row.net")


def sharpe(x: str, periods: int = PERIODS_A_YEAR) -> Column:
    """Annualised mean over sample deviation; null for a constant series."""
    spread = F.stddev_samp(x)
    return F.when(spread > 0, F.avg(x) / spread * F.sqrt(F.lit(float(periods))))


def metrics(series: DataFrame, rebalances: dict[int, int], periods: int = PERIODS_A_YEAR) -> DataFrame:
    """One row a trial; series of fewer than two bars have no Sharpe ratio, return or deviation."""
    enough = F.count(F.lit(1)) >= 2
    turnover = F.avg("turnover")
    every = F.create_map(*[F.lit(x) for pair in rebalances.items() for x in pair]) if rebalances else F.create_map()
    return equity(series).groupBy("trial").agg(
        F.count(F.lit(1)).alias("n_bars"),
        F.when(enough, sharpe("net", periods)).alias("sharpe"),
        F.when(enough, sharpe("gross", periods)).alias("gross_sharpe"),
        F.when(enough, F.avg("net") * periods).alias("ann_return"),
        F.when(enough, F.stddev_samp("net") * F.sqrt(F.lit(float(periods)))).alias("ann_vol"),
        F.when(enough, F.min(F.try_divide(F.col("equity") - F.col("peak"), F.col("peak")))).alias("max_drawdown"),
        F.when(enough, F.avg(F.when(F.col("net") > 0, 1.0).otherwise(0.0))).alias("hit_rate"),
        F.when(enough, turnover).alias("mean_turnover"),
        F.when(enough & (turnover > 0), F.avg("gross") / turnover * 1e4).alias("break_even_bps"),
    ).withColumn("turnover_per_rebal", F.col("mean_turnover") * F.try_element_at(every, F.col("trial"))).drop("mean_turnover")


@dataclass(frozen=True)
class WalkForward:
    n_splits: int = 6
    embargo_h: int = 24
    label_horizon_h: int = 1


def folds(series: DataFrame, walk: WalkForward = WalkForward()) -> DataFrame:
    """fold, train_lo, train_hi, test_lo, test_hi: expanding training up to a gap before each test block.

    Of the time axis, which has one row a bar, the ends of blocks are looked up by number; too few bars give no fold.
    """
    blocks = walk.n_splits + 1
    axis = time_axis(series).withColumnsRenamed({"t": "i", "n_bars": "n"})
    fold = axis.where(F.col("n") >= 2 * blocks).select("*", F.explode(F.sequence(F.lit(0), F.lit(walk.n_splits - 1))).alias("fold"))

    def edge(k: Column) -> Column:
        return F.bround(k * F.col("n") / blocks).cast("long")

    lo, hi = F.col("i") == edge(F.col("fold") + 1), F.col("i") == edge(F.col("fold") + 2) - 1
    gap = F.expr(f"interval {walk.embargo_h + walk.label_horizon_h} hours")
    found = fold.where(lo | hi).groupBy("fold").agg(F.min("first").alias("train_lo"), F.max(F.when(lo, F.col("ts"))).alias("test_lo"), F.max(F.when(hi, F.col("ts"))).alias("test_hi"))
    return found.select("fold", "train_lo", (F.col("test_lo") - gap).alias("train_hi"), "test_lo", "test_hi")


def fold_sharpes(series: DataFrame, blocks: DataFrame, lookbacks: dict[int, int], periods: int = PERIODS_A_YEAR) -> DataFrame:
    """trial, fold, is_sharpe, oos_sharpe; a fold whose training is no longer than a trial's lookback is left out.

    blocks has a row a fold, a few dozen at most, so it is broadcast.
    """
    joined = series.join(F.broadcast(blocks), F.col("ts").between(F.col("train_lo"), F.col("test_hi")))
    needs = F.try_element_at(F.create_map(*[F.lit(x) for pair in lookbacks.items() for x in pair]), F.col("trial"))
    usable = joined.where((F.unix_seconds("train_hi") - F.unix_seconds("train_lo")) / 3600 > needs)
    inside, outside = F.col("ts") <= F.col("train_hi"), F.col("ts") >= F.col("test_lo")
    parts = usable.withColumns({"a": F.when(inside, F.col("net")), "b": F.when(outside, F.col("net"))})
    return parts.groupBy("trial", "fold").agg(sharpe("a", periods).alias("is_sharpe"), sharpe("b", periods).alias("oos_sharpe"))


def trial_table(series: DataFrame, trials: list[Trial], walk: WalkForward = WalkForward(), periods: int = PERIODS_A_YEAR) -> DataFrame:
    """Everything known of each trial, best in-sample first; ties by number."""
    spark = series.sparkSession
    names = spark.createDataFrame([(t.number, str(t.expression), t.rebalance_every_h, t.cost_bps) for t in trials], "trial int, expr string, rebalance_every_h int, cost_bps double")
    whole = metrics(series, {t.number: t.rebalance_every_h for t in trials}, periods)
    by_fold = fold_sharpes(series, folds(series, walk), {t.number: t.lookback for t in trials}, periods)
    nested = by_fold.groupBy("trial").agg(
        F.array_sort(F.collect_list(F.struct("fold", "is_sharpe", "oos_sharpe"))).alias("folds"), F.avg("is_sharpe").alias("is_sharpe"), F.avg("oos_sharpe").alias("oos_sharpe")
    )
    joined = F.broadcast(names).join(whole, "trial", "left").join(nested, "trial", "left")
    return joined.orderBy(F.desc_nulls_last("is_sharpe"), "trial")
