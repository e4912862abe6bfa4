"""The engine's operators as registered queries over the test tables, each with the SQL that it must agree with.

Events are ticks of five symbols over thirty days, so universe rules are scaled to that. Doubles are
rounded on both sides, since engines add in different orders.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import asdict
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quantloom.functions.deflation import EULER_GAMMA
from quantloom.operators import audit, bootstrap
from quantloom.operators.backtest import Trial, WalkForward, equity, fold_sharpes, folds, metrics, trial_series, trial_table, with_weights
from quantloom.operators.features import asof_join, feature_panel, gap_free
from quantloom.operators.universe import UniverseRules, manifest, universe
from quantloom.plans import runs
from quantloom.plans.grid import with_signals
from quantloom.sources.bars import event_bars, item_bars
from quantloom.sources.scratch import stored

RULES = UniverseRules(rebalance_every_h=24, min_history_h=72, adv_window_h=72, adv_min_bars=24, min_adv_usd=0.0, stale_min_bars=6, min_coverage=0.2, max_symbols=4, rows_per_h=1.0)
LOOKBACKS, REBALANCES, COST = (6, 24), (6, 24), 5.0
TRIALS = [
    Trial(i, expression, rebalance, COST)
    for i, (expression, rebalance) in enumerate(
        (text, r) for n in LOOKBACKS for text in (f"cs_zscore(ts_ret(close, {n}))", f"neg(cs_zscore(ts_ret(close, {n})))") for r in REBALANCES
    )
]
WALK = WalkForward(n_splits=3)
#: As runs have them; places of draws are shown for the first DRAWN replicates.
BLOCKS, BOOT, MEAN_BLOCK, SEED, DRAWN = 10, 2000, 48.0, 3, 20


def r(x: Column | str, digits: int = 8) -> Column:
    return F.round(x, digits) + F.lit(0.0)


def rounded(df: DataFrame, digits: int = 8, **other: int) -> DataFrame:
    """Every double column rounded."""
    return df.select(*[r(c, other.get(c, digits)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


# --- the tables that queries build on ---


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = event_bars(spark, sf_dir)
    return feature_panel(held, universe(held, RULES), RULES.rebalance_every_h)


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trial_series(panel(spark, sf_dir), TRIALS)


def kept_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For what reads it several times, as a run does that has stored it."""
    return stored(series(spark, sf_dir), "series")


_BARS = """bars AS (
  SELECT event_type AS symbol, date_trunc('hour', ts) AS ts, first(value ORDER BY ts, event_id) AS open, max(value) AS high, min(value) AS low,
    last(value ORDER BY ts, event_id) AS close, CAST(count(*) AS DOUBLE) AS volume, CAST(sum(CAST(value AS DECIMAL(20, 2))) AS DOUBLE) AS quote_volume,
    count(*) AS trades, CAST(sum(CASE WHEN user_id % 2 = 0 THEN CAST(value AS DECIMAL(20, 2)) ELSE 0 END) AS DOUBLE) AS taker_buy_quote,
    CAST(count(*) AS INTEGER) AS n_minutes
  FROM events GROUP BY 1, 2)"""
_UNIVERSE = f"""scored AS (
  SELECT symbol, ts, CASE WHEN count(quote_volume) OVER adv >= {RULES.adv_min_bars} THEN avg(quote_volume) OVER adv END AS adv_usd,
    CASE WHEN count(n_minutes) OVER st >= {RULES.stale_min_bars} THEN sum(n_minutes) OVER st END AS n_rows,
    CAST(floor((epoch(ts) - epoch(min(ts) OVER (PARTITION BY symbol))) / 3600) AS BIGINT) AS history_h
  FROM bars
  WINDOW adv AS (PARTITION BY symbol ORDER BY ts RANGE BETWEEN INTERVAL {RULES.adv_window_h} HOUR PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING),
    st AS (PARTITION BY symbol ORDER BY ts RANGE BETWEEN INTERVAL {RULES.stale_window_h} HOUR PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING)),
chosen AS (SELECT * FROM (
  SELECT ts AS asof, symbol, adv_usd, history_h, n_rows / {RULES.stale_window_h * RULES.rows_per_h} AS coverage_24h,
    CAST(row_number() OVER (PARTITION BY ts ORDER BY adv_usd DESC, symbol) AS INTEGER) AS rank
  FROM scored
  WHERE hour(ts) % {RULES.rebalance_every_h} = 0 AND minute(ts) = 0 AND adv_usd >= {RULES.min_adv_usd} AND history_h >= {RULES.min_history_h}
    AND n_rows >= {RULES.min_coverage * RULES.stale_window_h * RULES.rows_per_h}) WHERE rank <= {RULES.max_symbols})"""
_GRID = """ends AS (SELECT symbol, min(ts) AS lo, max(ts) AS hi FROM bars GROUP BY 1),
axis AS (SELECT symbol, unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS ts FROM ends),
grid AS (
  SELECT a.symbol, a.ts, last_value(b.open IGNORE NULLS) OVER w AS open, last_value(b.high IGNORE NULLS) OVER w AS high,
    last_value(b.low IGNORE NULLS) OVER w AS low, last_value(b.close IGNORE NULLS) OVER w AS close, coalesce(b.volume, 0) AS volume,
    coalesce(b.quote_volume, 0) AS quote_volume, coalesce(b.trades, 0) AS trades, coalesce(b.taker_buy_quote, 0) AS taker_buy_quote,
    coalesce(b.n_minutes, 0) AS n_minutes, b.ts IS NOT NULL AS is_real
  FROM axis a LEFT JOIN bars b USING (symbol, ts) WINDOW w AS (PARTITION BY a.symbol ORDER BY a.ts ROWS UNBOUNDED PRECEDING))"""
_PANEL = f"""panel AS (
  SELECT g.*, close / nullif(lag(close) OVER w, 0) - 1 AS ret,
    CASE WHEN quote_volume > 0 THEN 2 * taker_buy_quote / quote_volume - 1 END AS taker_imb,
    coalesce(epoch(g.ts) - epoch(last_value(c.asof IGNORE NULLS) OVER (w ROWS UNBOUNDED PRECEDING)) < {RULES.rebalance_every_h * 3600}, false) AS in_universe
  FROM grid g LEFT JOIN chosen c ON c.symbol = g.symbol AND c.asof = g.ts WINDOW w AS (PARTITION BY g.symbol ORDER BY g.ts))"""
_TRIALS = ", ".join(
    f"({t.number}, {LOOKBACKS[t.number // 4]}, {-1 if t.expression.startswith('neg') else 1}, {t.rebalance_every_h})" for t in TRIALS
)
_SIGNALS = (
    "moves AS ("
    + " UNION ALL ".join(
        f"SELECT {n} AS n, symbol, ts, ret, in_universe, CASE WHEN in_universe THEN close / nullif(lag(close, {n}) OVER (PARTITION BY symbol ORDER BY ts), 0) - 1 END AS v FROM panel"
        for n in LOOKBACKS
    )
    + """),
signals AS (SELECT *, (v - avg(v) OVER w) / nullif(stddev_samp(v) OVER w, 0) AS z FROM moves WINDOW w AS (PARTITION BY n, ts)),
trials(trial, n, sgn, every) AS (VALUES """
    + _TRIALS
    + """),
held AS (SELECT trial, symbol, ts, ret, hour(ts) % every = 0 AND minute(ts) = 0 AS turn, CASE WHEN hour(ts) % every = 0 AND minute(ts) = 0 AND in_universe THEN sgn * z END AS x
  FROM signals JOIN trials USING (n)),
apart AS (SELECT *, x - avg(x) OVER (PARTITION BY trial, ts) AS dm FROM held),
aimed AS (SELECT *, CASE WHEN turn THEN CASE WHEN coalesce(sum(abs(dm)) OVER (PARTITION BY trial, ts), 0) > 0 THEN coalesce(dm / sum(abs(dm)) OVER (PARTITION BY trial, ts), 0) ELSE 0 END END AS aim FROM apart),
weighted AS (SELECT trial, symbol, ts, ret, coalesce(last_value(aim IGNORE NULLS) OVER (PARTITION BY trial, symbol ORDER BY ts ROWS UNBOUNDED PRECEDING), 0) AS w FROM aimed),
lagged AS (SELECT *, coalesce(lag(w) OVER (PARTITION BY trial, symbol ORDER BY ts), 0) AS pos FROM weighted),
traded AS (SELECT *, abs(pos - coalesce(lag(pos) OVER (PARTITION BY trial, symbol ORDER BY ts), 0)) AS trade FROM lagged),
sums AS (SELECT trial, ts, sum(pos * coalesce(ret, 0)) AS gross, sum(trade) AS turnover, sum(abs(pos)) AS gross_exposure FROM traded GROUP BY 1, 2),
series AS (SELECT *, gross - turnover * """
    + f"{COST / 1e4} AS net FROM sums)"
)
_CURVE = """curve AS (SELECT *, product(1 + net) OVER w AS equity, product(1 + gross) OVER w AS equity_gross FROM series WINDOW w AS (PARTITION BY trial ORDER BY ts ROWS UNBOUNDED PRECEDING)),
peaks AS (SELECT *, max(equity) OVER (PARTITION BY trial ORDER BY ts ROWS UNBOUNDED PRECEDING) AS peak FROM curve)"""
_AXIS = "taxis AS (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS t, count(*) OVER () AS nt FROM (SELECT DISTINCT ts FROM series))"
_SPLITS = WALK.n_splits
_EDGES = f"edges AS (SELECT unnest(range(0, {_SPLITS + 2})) AS k, CAST(round_even(k * (SELECT max(nt) FROM taxis) / {_SPLITS + 1}.0, 0) AS BIGINT) AS i)"
_FOLDS = f"""folds AS (SELECT CAST(a.k - 1 AS INTEGER) AS fold, (SELECT min(ts) FROM series) AS train_lo, x.ts - INTERVAL {WALK.embargo_h + WALK.label_horizon_h} HOUR AS train_hi, x.ts AS test_lo, y.ts AS test_hi
  FROM edges a JOIN edges b ON b.k = a.k + 1 JOIN taxis x ON x.t = a.i JOIN taxis y ON y.t = b.i - 1 WHERE a.k >= 1)"""
_ANN = "sqrt(8760.0)"
_FOLD_SHARPES = f"""parts AS (SELECT s.trial, f.fold, CASE WHEN s.ts <= f.train_hi THEN net END AS a, CASE WHEN s.ts >= f.test_lo THEN net END AS b
  FROM series s JOIN folds f ON s.ts BETWEEN f.train_lo AND f.test_hi JOIN trials USING (trial) WHERE (epoch(f.train_hi) - epoch(f.train_lo)) / 3600 > n),
fold_sharpes AS (SELECT trial, fold, CASE WHEN stddev_samp(a) > 0 THEN avg(a) / stddev_samp(a) * {_ANN} END AS is_sharpe, CASE WHEN stddev_samp(b) > 0 THEN avg(b) / stddev_samp(b) * {_ANN} END AS oos_sharpe FROM parts GROUP BY 1, 2)"""
_RANKED = "ranked AS (SELECT trial, avg(is_sharpe) AS is_sharpe, avg(oos_sharpe) AS oos_sharpe FROM fold_sharpes GROUP BY 1)"
_NUMBERED = "numbered AS (SELECT trial, t, nt, net FROM series JOIN taxis USING (ts))"
_MOMENTS = f"moments AS (SELECT trial, CAST(t // (nt // {BLOCKS}) AS INTEGER) AS block, count(*) AS n, sum(net) AS s, sum(net * net) AS ss FROM numbered WHERE t < (nt // {BLOCKS}) * {BLOCKS} GROUP BY 1, 2)"


def _sr(k: str) -> str:
    v = f"greatest(ss{k} / n{k} - (s{k} / n{k}) * (s{k} / n{k}), 0.0)"
    return f"round(CASE WHEN {v} > 0 THEN (s{k} / n{k}) / sqrt({v}) ELSE 0.0 END, 12)"


_CLOUD = f"""masks AS (SELECT unnest(range(0, {1 << BLOCKS})) AS split), picks AS (SELECT split FROM masks WHERE bit_count(split) = {BLOCKS // 2}),
sides AS (SELECT split, trial, {', '.join(f"sum({c}) FILTER (((split >> block) & 1) = {1 if k == 'i' else 0}) AS {c}{k}" for k in 'io' for c in ('n', 's', 'ss'))} FROM moments, picks GROUP BY 1, 2),
ratios AS (SELECT split, trial, {_sr('i')} AS i, {_sr('o')} AS o FROM sides),
best AS (SELECT split, first(i ORDER BY i DESC, trial) AS is_sharpe, first(o ORDER BY i DESC, trial) AS oos_sharpe FROM ratios GROUP BY 1),
places AS (SELECT split, is_sharpe, oos_sharpe, least(greatest(count(*) FILTER (o <= oos_sharpe) / (count(*) + 1.0), 1e-9), 1 - 1e-9) AS omega FROM ratios JOIN best USING (split) GROUP BY 1, 2, 3),
cloud AS (SELECT split, is_sharpe, oos_sharpe, ln(omega / (1 - omega)) AS logit FROM places)"""
_RHO = """pairs AS (SELECT x.trial AS a, y.trial AS b, count(*) AS n, sum(x.net) AS sx, sum(y.net) AS sy, sum(x.net * y.net) AS sxy, sum(x.net * x.net) AS sxx, sum(y.net * y.net) AS syy
  FROM numbered x JOIN numbered y USING (t) GROUP BY 1, 2),
spreads AS (SELECT a, b, sxx - sx * sx / n AS u, syy - sy * sy / n AS v, sxy - sx * sy / n AS c FROM pairs),
rho AS (SELECT a, b, CASE WHEN u > 1e-18 AND v > 1e-18 THEN CASE WHEN a = b THEN 1.0 ELSE c / sqrt(u * v) END ELSE 0.0 END AS rho FROM spreads)"""
_HALF = "CAST('0x' || substr(md5('{seed}:' || b || ':' || j), {at}, 13) AS BIGINT) / CAST(4503599627370496 AS DOUBLE)"
_DRAWS = f"""jumps AS (SELECT b, j, nt, 1 + least(CAST(floor(ln({_HALF.format(seed=SEED, at=1)} + {2.0**-52!r}) / {math.log(1 - 1 / MEAN_BLOCK)!r}) AS BIGINT), nt) AS length,
    CAST(floor({_HALF.format(seed=SEED, at=14)} * nt) AS BIGINT) AS start FROM (SELECT b, t AS j, nt FROM (SELECT unnest(range(0, {BOOT})) AS b), taxis)),
begun AS (SELECT * FROM (SELECT *, CAST(sum(length) OVER (PARTITION BY b ORDER BY j ROWS UNBOUNDED PRECEDING) AS BIGINT) - length AS begin_ FROM jumps) WHERE begin_ < nt),
draws AS (SELECT b, t, (start + t - begin_) % nt AS source FROM (SELECT b, start, begin_, nt, unnest(range(begin_, least(begin_ + length, nt))) AS t FROM begun))"""
_NULLS = """stats AS (SELECT trial, avg(net) AS mean, stddev_samp(net) AS sd, any_value(nt) AS nt FROM numbered GROUP BY 1),
drawn AS (SELECT d.b, n.trial, avg(n.net) AS drawn FROM draws d JOIN numbered n ON n.t = d.source GROUP BY 1, 2),
nulls AS (SELECT b, trial, round(CASE WHEN sd > 0 THEN (drawn - mean) / sd ELSE 0.0 END, 12) AS sharpe FROM drawn JOIN stats USING (trial))"""

_UP_TO_PANEL = (_BARS, _UNIVERSE, _GRID, _PANEL)
_UP_TO_SERIES = (*_UP_TO_PANEL, _SIGNALS)
_UP_TO_FOLDS = (*_UP_TO_SERIES, _AXIS, _EDGES, _FOLDS, _FOLD_SHARPES, _RANKED)
_UP_TO_CLOUD = (*_UP_TO_SERIES, _AXIS, _NUMBERED, _MOMENTS, _CLOUD)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None, *tables: str):
    """Registers a query under its name, with the SQL that follows the named common tables."""

    def put(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = f"WITH {', '.join(tables)} {sql}" if tables else sql
        return f

    return put


def _sql_round(columns: str, digits: int = 8) -> str:
    return ", ".join(f"round({c}, {digits}) + 0.0 AS {c}" for c in columns.split())


# --- bars, universe, features ---


@query("SELECT * FROM bars", _BARS)
def bars_ohlcv(spark, sf_dir):
    return event_bars(spark, sf_dir)


@query("""SELECT p_brand AS symbol, date_trunc('day', CAST(l_shipdate AS TIMESTAMP)) AS ts, round(first(l_extendedprice / l_quantity ORDER BY l_shipdate, l_orderkey * 10 + l_linenumber), 8) + 0.0 AS open,
  round(max(l_extendedprice / l_quantity), 8) + 0.0 AS high, round(min(l_extendedprice / l_quantity), 8) + 0.0 AS low, round(last(l_extendedprice / l_quantity ORDER BY l_shipdate, l_orderkey * 10 + l_linenumber), 8) + 0.0 AS close,
  CAST(sum(l_quantity) AS DOUBLE) AS volume, CAST(sum(CAST(l_extendedprice AS DECIMAL(20, 2))) AS DOUBLE) AS quote_volume, count(*) AS trades,
  CAST(sum(CASE WHEN l_returnflag = 'R' THEN CAST(l_extendedprice AS DECIMAL(20, 2)) ELSE 0 END) AS DOUBLE) AS taker_buy_quote, CAST(count(*) AS INTEGER) AS n_minutes
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2""")
def bars_daily_items(spark, sf_dir):
    found = item_bars(spark, sf_dir)
    return found.withColumns({c: r(c) for c in ("open", "high", "low", "close")})


@query(f"SELECT \"asof\", symbol, {_sql_round('adv_usd')}, history_h, {_sql_round('coverage_24h')}, rank FROM chosen", _BARS, _UNIVERSE)
def universe_pit(spark, sf_dir):
    return rounded(universe(event_bars(spark, sf_dir), RULES))


@query("SELECT * FROM grid", _BARS, _GRID)
def gap_free_grid(spark, sf_dir):
    return gap_free(event_bars(spark, sf_dir))


@query(f"SELECT symbol, ts, open, high, low, close, volume, quote_volume, trades, taker_buy_quote, n_minutes, is_real, {_sql_round('ret taker_imb')}, in_universe FROM panel", *_UP_TO_PANEL)
def features(spark, sf_dir):
    found = panel(spark, sf_dir)
    return found.withColumns({c: r(c) for c in ("ret", "taker_imb")})


@query("""SELECT b.symbol, b.ts, max(c.asof) AS asof FROM bars b LEFT JOIN chosen c ON c.symbol = b.symbol AND c.asof <= b.ts GROUP BY 1, 2""", _BARS, _UNIVERSE)
def asof_membership(spark, sf_dir):
    held = event_bars(spark, sf_dir)
    return asof_join(held.select("symbol", "ts"), universe(held, RULES), "ts", "asof", "symbol", ["rank"]).select("symbol", "ts", "asof")


@query(f"SELECT symbol, count(*) AS n, count(DISTINCT CAST(ts AS DATE)) AS days, min(ts) AS first_ts, max(ts) AS last_ts FROM bars GROUP BY 1", _BARS)
def panel_coverage(spark, sf_dir):
    days = F.countDistinct(F.to_date("ts"))
    return event_bars(spark, sf_dir).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), days.alias("days"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query("""SELECT min(ts) AS start, max(ts) AS "end", count(DISTINCT ts) AS n_bars, count(DISTINCT symbol) AS n_symbols_available,
  count(DISTINCT CASE WHEN in_universe THEN symbol END) AS n_symbols_traded, count(DISTINCT CASE WHEN in_universe THEN date_trunc('day', ts) END) AS n_rebalances,
  round((SELECT avg(m) FROM sizes), 8) + 0.0 AS mean_universe_size,
  round(count(DISTINCT CASE WHEN in_universe THEN symbol END) / (SELECT floor(avg(m) + 0.5) FROM sizes), 8) + 0.0 AS turnover_ratio FROM panel""", *_UP_TO_PANEL, "sizes AS (SELECT count(*) AS m FROM panel WHERE in_universe GROUP BY ts)")
def provenance(spark, sf_dir):
    return rounded(audit.provenance(panel(spark, sf_dir), RULES.rebalance_every_h))


@query("""SELECT (SELECT count(*) FROM bars) AS bars, (SELECT count(DISTINCT symbol) FROM bars) AS symbols, (SELECT min(ts) FROM bars) AS start, (SELECT max(ts) FROM bars) AS "end",
  (SELECT count(*) FROM chosen) AS universe_rows, max("asof") AS last_asof, CAST(count(*) AS INTEGER) AS last_size, string_agg(symbol, ',' ORDER BY rank) FILTER (rank <= 3) AS last_top
  FROM chosen WHERE "asof" = (SELECT max("asof") FROM chosen)""", _BARS, _UNIVERSE)
def panel_manifest(spark, sf_dir):
    held = event_bars(spark, sf_dir)
    found = manifest(held, universe(held, RULES), 3)
    return found.withColumn("last_top", F.array_join("last_top", ","))


# --- operations of the signal language ---

_N = 6
_BY = "PARTITION BY symbol ORDER BY ts"
_LAST = f"({_BY} ROWS BETWEEN {_N - 1} PRECEDING AND CURRENT ROW)"


def _whole(aggregate: str, x: str) -> str:
    return f"CASE WHEN count({x}) OVER {_LAST} = {_N} THEN {aggregate}({x}) OVER {_LAST} END"


_MASKED = "CASE WHEN in_universe THEN ret END"
_OPERATIONS = {
    "ts_mean": (f"ts_mean(close, {_N})", _whole("avg", "close")),
    "ts_std": (f"ts_std(ret, {_N})", _whole("stddev_samp", "ret")),
    "ts_sum": (f"ts_sum(dollar_vol, {_N})", _whole("sum", "quote_volume")),
    "ts_ret": (f"ts_ret(close, {_N})", f"close / nullif(lag(close, {_N}) OVER ({_BY}), 0) - 1"),
    "ts_zscore": (f"ts_zscore(trades, {_N})", f"(trades - {_whole('avg', 'trades')}) / nullif({_whole('stddev_samp', 'trades')}, 0)"),
    "cs_demean": ("cs_demean(ret)", f"{_MASKED} - avg({_MASKED}) OVER (PARTITION BY ts)"),
    "cs_zscore": ("cs_zscore(ret)", f"({_MASKED} - avg({_MASKED}) OVER (PARTITION BY ts)) / nullif(stddev_samp({_MASKED}) OVER (PARTITION BY ts), 0)"),
    "cs_rank": ("cs_rank(ret)", f"""CASE WHEN {_MASKED} IS NOT NULL THEN (rank() OVER (PARTITION BY ts, ({_MASKED}) IS NULL ORDER BY {_MASKED})
      + (count(*) OVER (PARTITION BY ts, {_MASKED}) - 1) / 2.0) / count({_MASKED}) OVER (PARTITION BY ts) - 0.5 END"""),
    "neg": ("neg(taker_imb)", "-taker_imb"),
    "sign": ("sign(taker_imb)", "CAST(sign(taker_imb) AS DOUBLE)"),
    "abs": ("abs(taker_imb)", "abs(taker_imb)"),
    "clip": ("clip(taker_imb, 0.25)", "CASE WHEN taker_imb IS NOT NULL THEN greatest(-0.25, least(0.25, taker_imb)) END"),
}


def _operation_query(name: str, text: str, sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found, (column,) = with_signals(panel(spark, sf_dir), [text])
        return found.select("symbol", "ts", r(F.col(column).cast("double"), 7).alias("value"))

    run.__name__ = f"signal_{name}"
    query(f"SELECT symbol, ts, round(CAST({sql} AS DOUBLE), 7) + 0.0 AS value FROM panel", *_UP_TO_PANEL)(run)


for _name, (_text, _expected) in _OPERATIONS.items():
    _operation_query(_name, _text, _expected)


# --- weights, returns, metrics, folds ---


@query("SELECT trial, symbol, ts, round(w, 8) + 0.0 AS w FROM weighted", *_UP_TO_SERIES)
def weights(spark, sf_dir):
    found, columns = with_signals(panel(spark, sf_dir), [t.expression for t in TRIALS])
    weighted = with_weights(found, {f"w{t.number}": (c, t.rebalance_every_h) for t, c in zip(TRIALS, columns, strict=True)})
    rows = F.array(*[F.struct(F.lit(t.number).alias("trial"), r(f"w{t.number}").alias("w")) for t in TRIALS])
    return weighted.select("symbol", "ts", F.inline(rows))


@query(f"SELECT trial, ts, {_sql_round('gross turnover gross_exposure net')} FROM series", *_UP_TO_SERIES)
def pnl_series(spark, sf_dir):
    return rounded(series(spark, sf_dir))


def signed_log(x: str) -> Column:
    """Growth of made-up prices knows no bounds; its size in logarithms can be compared."""
    return r(F.signum(x) * F.ln(1 + F.abs(x)), 7)


_SIGNED_LOG = "round(sign({0}) * ln(1 + abs({0})), 7) + 0.0 AS {0}"


@query(f"SELECT trial, ts, {_SIGNED_LOG.format('equity')}, {_SIGNED_LOG.format('equity_gross')} FROM curve", *_UP_TO_SERIES, _CURVE)
def equity_curve(spark, sf_dir):
    return equity(kept_series(spark, sf_dir)).select("trial", "ts", signed_log("equity").alias("equity"), signed_log("equity_gross").alias("equity_gross"))


@query(f"SELECT trial, {_SIGNED_LOG.format('max_drawdown')} FROM (SELECT trial, min((equity - peak) / nullif(peak, 0)) AS max_drawdown FROM peaks GROUP BY 1)", *_UP_TO_SERIES, _CURVE)
def drawdown(spark, sf_dir):
    fall = F.min(F.try_divide(F.col("equity") - F.col("peak"), F.col("peak")))
    return equity(kept_series(spark, sf_dir)).groupBy("trial").agg(fall.alias("max_drawdown")).select("trial", signed_log("max_drawdown").alias("max_drawdown"))


_METRICS = f"""SELECT trial, count(*) AS n_bars, round(avg(net) / nullif(stddev_samp(net), 0) * {_ANN}, 6) + 0.0 AS sharpe, round(avg(gross) / nullif(stddev_samp(gross), 0) * {_ANN}, 6) + 0.0 AS gross_sharpe,
  round(avg(net) * 8760, 6) + 0.0 AS ann_return, round(stddev_samp(net) * {_ANN}, 6) + 0.0 AS ann_vol, round(min((equity - peak) / nullif(peak, 0)), 6) + 0.0 AS max_drawdown,
  round(avg(CASE WHEN net > 0 THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS hit_rate, round(CASE WHEN avg(turnover) > 0 THEN avg(gross) / avg(turnover) * 1e4 END, 6) + 0.0 AS break_even_bps,
  round(avg(turnover) * any_value(every), 6) + 0.0 AS turnover_per_rebal FROM peaks JOIN trials USING (trial) GROUP BY 1"""


@query(_METRICS, *_UP_TO_SERIES, _CURVE)
def trial_metrics(spark, sf_dir):
    return rounded(metrics(kept_series(spark, sf_dir), {t.number: t.rebalance_every_h for t in TRIALS}), 6)


@query("SELECT * FROM folds", *_UP_TO_SERIES, _AXIS, _EDGES, _FOLDS)
def walk_forward_folds(spark, sf_dir):
    return folds(series(spark, sf_dir), WALK)


def _fold_sharpes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = kept_series(spark, sf_dir)
    return fold_sharpes(found, folds(found, WALK), {t.number: t.lookback for t in TRIALS})


@query(f"SELECT trial, fold, {_sql_round('is_sharpe oos_sharpe', 6)} FROM fold_sharpes", *_UP_TO_FOLDS)
def fold_sharpe_ratios(spark, sf_dir):
    return rounded(_fold_sharpes(spark, sf_dir), 6)


def _ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fold_sharpes(spark, sf_dir).groupBy("trial").agg(F.avg("is_sharpe").alias("is_sharpe"), F.avg("oos_sharpe").alias("oos_sharpe"))


@query(f"""SELECT m.trial, t.expr, t.every AS rebalance_every_h, {COST} + 0.0 AS cost_bps, n_bars, sharpe, gross_sharpe, ann_return, ann_vol, max_drawdown, hit_rate, turnover_per_rebal, break_even_bps, folds,
  round(r.is_sharpe, 6) + 0.0 AS is_sharpe, round(r.oos_sharpe, 6) + 0.0 AS oos_sharpe
  FROM ({_METRICS}) m JOIN (VALUES {', '.join(f"({t.number}, '{t.expression}', {t.rebalance_every_h})" for t in TRIALS)}) t(trial, expr, every) USING (trial) LEFT JOIN ranked r USING (trial)
  LEFT JOIN (SELECT trial, string_agg(fold || ':' || coalesce(printf('%.4f', round(is_sharpe, 4) + 0.0), 'null') || ':' || coalesce(printf('%.4f', round(oos_sharpe, 4) + 0.0), 'null'), ' ' ORDER BY fold) AS folds FROM fold_sharpes GROUP BY 1) USING (trial)""", *_UP_TO_FOLDS, _CURVE)
def trial_results(spark, sf_dir):
    """The whole table of trials; nested folds are shown as text."""
    found = trial_table(kept_series(spark, sf_dir), TRIALS, WALK)
    fold = F.transform("folds", lambda f: F.format_string("%d:%.4f:%.4f", f["fold"], r(f["is_sharpe"], 4), r(f["oos_sharpe"], 4)))
    return rounded(found.withColumn("folds", F.array_join(fold, " ")), 6)


@query("SELECT trial, CAST(row_number() OVER (ORDER BY round(is_sharpe, 9) DESC NULLS LAST, trial) AS INTEGER) AS place, round(is_sharpe, 6) + 0.0 AS is_sharpe FROM ranked", *_UP_TO_FOLDS)
def trial_rank(spark, sf_dir):
    place = F.row_number().over(Window.orderBy(F.desc_nulls_last(F.round("is_sharpe", 9)), "trial"))
    return _ranked(spark, sf_dir).select("trial", place.alias("place"), r("is_sharpe", 6).alias("is_sharpe"))


@query("SELECT trial, round(is_sharpe, 6) + 0.0 AS is_sharpe FROM ranked ORDER BY round(is_sharpe, 9) DESC NULLS LAST, trial LIMIT 1", *_UP_TO_FOLDS)
def winner(spark, sf_dir):
    """The feature is a top-1 report."""
    return _ranked(spark, sf_dir).orderBy(F.desc_nulls_last(F.round("is_sharpe", 9)), "trial").limit(1).select("trial", r("is_sharpe", 6).alias("is_sharpe"))


@query("""SELECT round(corr(p, q), 8) + 0.0 AS rank_correlation, count(*) AS n FROM (SELECT
  rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0 AS p, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0 AS q
  FROM (SELECT round(is_sharpe, 9) AS a, round(oos_sharpe, 9) AS b FROM ranked WHERE is_sharpe IS NOT NULL AND oos_sharpe IS NOT NULL))""", *_UP_TO_FOLDS)
def spearman_is_oos(spark, sf_dir):
    held = _ranked(spark, sf_dir).select(*[F.round(c, 9).alias(c) for c in ("is_sharpe", "oos_sharpe")])
    return rounded(audit.rank_correlation(held, "is_sharpe", "oos_sharpe"))


# --- audit ---


@query(f"SELECT trial, block, n, {_sql_round('s ss', 6)} FROM moments", *_UP_TO_SERIES, _AXIS, _NUMBERED, _MOMENTS)
def block_moments(spark, sf_dir):
    return rounded(audit.block_moments(audit.numbered(kept_series(spark, sf_dir)), BLOCKS), 6)


@query(f"SELECT split, {_sql_round('is_sharpe oos_sharpe logit')} FROM cloud", *_UP_TO_CLOUD)
def cscv_cloud(spark, sf_dir):
    return rounded(audit.cscv_cloud(kept_series(spark, sf_dir), BLOCKS))


@query("""SELECT round(avg(CASE WHEN logit < 0 THEN 1.0 ELSE 0.0 END), 8) + 0.0 AS pbo, count(*) AS n_combinations, round(median(is_sharpe), 8) + 0.0 AS median_is_sharpe, round(median(oos_sharpe), 8) + 0.0 AS median_oos_sharpe,
  round(avg(CASE WHEN oos_sharpe < 0 THEN 1.0 ELSE 0.0 END), 8) + 0.0 AS prob_oos_loss, round(coalesce(nullif(regr_slope(oos_sharpe, is_sharpe), CAST('NaN' AS DOUBLE)), 0), 6) + 0.0 AS deterioration_slope, round(median(is_sharpe) - median(oos_sharpe), 8) + 0.0 AS selection_premium FROM cloud""", *_UP_TO_CLOUD)
def pbo_summary(spark, sf_dir):
    return rounded(audit.pbo_summary(audit.cscv_cloud(kept_series(spark, sf_dir), BLOCKS)), 8, deterioration_slope=6)


@query("SELECT a, b, round(rho, 7) + 0.0 AS rho FROM rho", *_UP_TO_SERIES, _AXIS, _NUMBERED, _RHO)
def correlation_matrix(spark, sf_dir):
    return rounded(audit.correlations(kept_series(spark, sf_dir)), 7)


@query("""SELECT round(CASE WHEN k < 2 THEN 1.0 ELSE k * k / s END, 6) + 0.0 AS participation_ratio, round(m, 6) + 0.0 AS mean_abs_corr
  FROM (SELECT sum(CASE WHEN a = b AND rho = 1 THEN 1 ELSE 0 END) AS k, sum(rho * rho) AS s, coalesce(avg(CASE WHEN a <> b THEN abs(rho) END), 0) AS m FROM rho)""", *_UP_TO_SERIES, _AXIS, _NUMBERED, _RHO)
def participation_ratio(spark, sf_dir):
    return rounded(audit.participation(audit.correlations(kept_series(spark, sf_dir))), 6)


@query("""SELECT trial, n AS n_obs, round(m, 9) + 0.0 AS mean, round(sqrt(v * n / (n - 1)), 9) + 0.0 AS sd, round(CASE WHEN v > 0 THEN m3 / v ** 1.5 ELSE 0.0 END, 5) + 0.0 AS skew, round(CASE WHEN v > 0 THEN m4 / (v * v) ELSE 3.0 END, 5) + 0.0 AS kurtosis
  FROM (SELECT trial, count(*) AS n, any_value(m) AS m, avg((net - m) ** 2) AS v, avg((net - m) ** 3) AS m3, avg((net - m) ** 4) AS m4 FROM series JOIN (SELECT trial, avg(net) AS m FROM series GROUP BY 1) USING (trial) GROUP BY 1)""", *_UP_TO_SERIES)
def return_moments(spark, sf_dir):
    return rounded(audit.return_moments(series(spark, sf_dir)), 9, skew=5, kurtosis=5)


def _cdf(z: str) -> str:
    """The normal distribution function in SQL, by Simpson's rule."""
    return f"(0.5 + {z} / 6000 * (SELECT sum(CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * exp(-0.5 * pow({z} * i / 2000, 2))) FROM (SELECT unnest(range(0, 2001)) AS i)) / sqrt(2 * pi()))"


def _psr(benchmark: str) -> str:
    return _cdf(f"((bar - {benchmark}) * sqrt(n_obs - 1) / sqrt(1 - skew * bar + (kurtosis - 1) / 4 * bar * bar))")


_EXPECTED_BEST = (1 - EULER_GAMMA) * NormalDist().inv_cdf(1 - 1 / len(TRIALS)) + EULER_GAMMA * NormalDist().inv_cdf(1 - 1 / (len(TRIALS) * math.e))
_WINNER = f"""best AS (SELECT trial FROM ranked ORDER BY round(is_sharpe, 9) DESC NULLS LAST, trial LIMIT 1),
sharpes AS (SELECT count(s) AS n_known, coalesce(stddev_samp(s), 0) AS spread FROM (SELECT avg(net) / nullif(stddev_samp(net), 0) * {_ANN} AS s FROM series GROUP BY trial)),
shape AS (SELECT count(*) AS n_obs, any_value(m) AS m, avg((net - m) ** 2) AS v, avg((net - m) ** 3) AS m3, avg((net - m) ** 4) AS m4
  FROM series JOIN best USING (trial) JOIN (SELECT trial, avg(net) AS m FROM series GROUP BY 1) USING (trial)),
found AS (SELECT n_obs, n_known, spread, coalesce(m / nullif(sqrt(v * n_obs / (n_obs - 1)), 0), 0) AS bar, CASE WHEN v > 0 THEN m3 / v ** 1.5 ELSE 0.0 END AS skew, CASE WHEN v > 0 THEN m4 / (v * v) ELSE 3.0 END AS kurtosis,
  CASE WHEN n_known = {len(TRIALS)} THEN spread * {_EXPECTED_BEST!r} WHEN n_known < 2 THEN 0.0 END AS sr0 FROM shape, sharpes)"""


def _deflation(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, audit.Deflation]:
    """The stored series, and its best trial's deflation."""
    held = kept_series(spark, sf_dir)
    found = trial_table(held, TRIALS, WALK).select("trial", "sharpe", F.round("is_sharpe", 9).alias("is_sharpe")).collect()  # a row a trial
    best = min(found, key=lambda x: (x["is_sharpe"] is None, -(x["is_sharpe"] or 0.0), x["trial"]))
    moments = audit.return_moments(held.where(F.col("trial") == best["trial"])).first().asDict()
    return held, audit.deflate(moments, [x["sharpe"] for x in found])


@query(f"""SELECT CAST(n_known AS INTEGER) AS n_trials, n_obs, round(bar * {_ANN}, 6) + 0.0 AS sr_ann, round(spread, 6) + 0.0 AS sr_trials_std_ann, round(sr0, 6) + 0.0 AS sr0_ann,
  round(skew, 5) + 0.0 AS skew, round(kurtosis, 5) + 0.0 AS kurtosis, round({_psr("0.0")}, 7) + 0.0 AS psr_vs_zero, round({_psr(f"sr0 / {_ANN}")}, 7) + 0.0 AS dsr FROM found""", *_UP_TO_FOLDS, _WINNER)
def deflation(spark, sf_dir):
    found = asdict(_deflation(spark, sf_dir)[1])
    row = {k: found[k] for k in ("n_trials", "n_obs", "sr_ann", "sr_trials_std_ann", "sr0_ann", "skew", "kurtosis", "psr_vs_zero", "dsr")}
    made = spark.createDataFrame([tuple(row.values())], "n_trials int, n_obs long, " + ", ".join(f"{k} double" for k in list(row)[2:]))
    return rounded(made, 6, skew=5, kurtosis=5, psr_vs_zero=7, dsr=7)


@query(f"""SELECT {len(TRIALS)} AS n_trials, {BOOT} AS n_boot, {MEAN_BLOCK} + 0.0 AS mean_block, round(mean_best * {_ANN}, 6) + 0.0 AS sr0_ann, round(q95 * {_ANN}, 6) + 0.0 AS sr0_ann_q95, round(null_sd * {_ANN}, 6) + 0.0 AS sr_null_std_ann,
  round(participation, 6) + 0.0 AS n_eff_participation, round(mean_abs_corr, 6) + 0.0 AS mean_abs_corr, round(p_value, 8) + 0.0 AS rc_p_value, round({_psr("mean_best")}, 7) + 0.0 AS dsr
  FROM found, checked, spread_out""", *_UP_TO_FOLDS, _WINNER, _NUMBERED, _DRAWS, _NULLS, _RHO,
  f"""checked AS (SELECT avg(CASE WHEN best >= statistic THEN 1.0 ELSE 0.0 END) AS p_value, avg(best) AS mean_best, quantile_cont(best, 0.95) AS q95, sqrt(greatest(sum(ss) / (count(*) * {len(TRIALS)}) - (sum(s) / (count(*) * {len(TRIALS)})) ** 2, 0)) AS null_sd
    FROM (SELECT b, max(sharpe) AS best, sum(sharpe) AS s, sum(sharpe * sharpe) AS ss FROM nulls GROUP BY 1), (SELECT max(round(coalesce(mean / nullif(sd, 0), 0), 12)) AS statistic FROM stats))""",
  """spread_out AS (SELECT CASE WHEN k < 2 THEN 1.0 ELSE k * k / s END AS participation, m AS mean_abs_corr
    FROM (SELECT sum(CASE WHEN a = b AND rho = 1 THEN 1 ELSE 0 END) AS k, sum(rho * rho) AS s, coalesce(avg(CASE WHEN a <> b THEN abs(rho) END), 0) AS m FROM rho))""")
def search_null(spark, sf_dir):
    """What the search would have found in noise; the number of effective trials, an inverse, is held against published audits in tests."""
    held, best = _deflation(spark, sf_dir)
    found = runs.search_null(held, best, len(TRIALS), BOOT, MEAN_BLOCK, SEED)
    kinds = {"n_trials": "int", "n_boot": "int"}
    row = {k: v for k, v in found.items() if k != "n_eff"}
    made = spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} {kinds.get(k, 'double')}" for k in row))
    return rounded(made, 6, rc_p_value=8, dsr=7)


@query(f"""SELECT trial, CAST(cost_bps AS DOUBLE) AS cost_bps, round(CASE WHEN stddev_samp(gross - turnover * cost_bps / 1e4) > 0 THEN avg(gross - turnover * cost_bps / 1e4) / stddev_samp(gross - turnover * cost_bps / 1e4) * {_ANN} END, 6) + 0.0 AS sharpe,
  round(CASE WHEN avg(turnover) > 0 THEN avg(gross) / avg(turnover) * 1e4 END, 6) + 0.0 AS break_even_bps FROM series, (SELECT unnest([0.0, 1.0, 2.0, 5.0, 10.0, 20.0, 50.0]) AS cost_bps) GROUP BY 1, 2""", *_UP_TO_SERIES)
def cost_curve(spark, sf_dir):
    return rounded(audit.cost_curve(series(spark, sf_dir)), 6)


@query("""SELECT symbol, count(*) AS n, round(coalesce(rho * sd / nullif(sf, 0), 0), 7) + 0.0 AS beta, round(sd * sqrt(1 - rho * rho), 7) + 0.0 AS idio_sd, round(mean, 7) + 0.0 AS mean FROM (
  SELECT symbol, ret, stddev_samp(ret) OVER w AS sd, stddev_samp(factor) OVER w AS sf, avg(ret) OVER w AS mean,
    least(greatest(coalesce(covar_samp(ret, factor) OVER w / nullif(stddev_samp(ret) OVER w * stddev_samp(factor) OVER w, 0), 0), -0.99), 0.99) AS rho
  FROM panel JOIN (SELECT ts, avg(ret) AS factor FROM panel GROUP BY 1) USING (ts) WHERE ret IS NOT NULL AND factor IS NOT NULL WINDOW w AS (PARTITION BY symbol)) GROUP BY symbol, rho, sd, sf, mean""", *_UP_TO_PANEL)
def market_factor(spark, sf_dir):
    return rounded(audit.factor_model(panel(spark, sf_dir)), 7)


@query(f"SELECT b, t, source FROM draws WHERE b < {DRAWN}", *_UP_TO_SERIES, _AXIS, _DRAWS)
def bootstrap_draws(spark, sf_dir):
    n = series(spark, sf_dir).select("ts").distinct().count()
    return bootstrap.draws(spark, n, DRAWN, MEAN_BLOCK, SEED)


@query("SELECT b, source, count(*) AS times FROM draws GROUP BY 1, 2", *_UP_TO_SERIES, _AXIS, _DRAWS)
def bootstrap_counts(spark, sf_dir):
    n = series(spark, sf_dir).select("ts").distinct().count()
    runs = bootstrap.drawn_runs(spark, n, BOOT, MEAN_BLOCK, SEED).select("b", "bars", F.inline(F.arrays_zip("first", "length")))
    at = F.col("bars") * audit.BARS + F.col("first")
    bars = runs.select("b", F.explode(F.sequence(at, at + F.col("length") - 1)).alias("source"))
    return bars.groupBy("b", "source").agg(F.count(F.lit(1)).alias("times"))


@query("SELECT b, trial, round(sharpe, 8) + 0.0 AS sharpe FROM nulls", *_UP_TO_SERIES, _AXIS, _NUMBERED, _DRAWS, _NULLS)
def bootstrap_null_sharpes(spark, sf_dir):
    return rounded(bootstrap.null_sharpes(kept_series(spark, sf_dir), BOOT, MEAN_BLOCK, SEED))


@query(f"""SELECT round(avg(CASE WHEN best >= statistic THEN 1.0 ELSE 0.0 END), 8) + 0.0 AS p_value, round(max(statistic), 8) + 0.0 AS statistic, round(avg(best), 8) + 0.0 AS mean_best, round(quantile_cont(best, 0.95), 8) + 0.0 AS q95,
  round(sqrt(greatest(sum(ss) / (count(*) * {len(TRIALS)}) - (sum(s) / (count(*) * {len(TRIALS)})) ** 2, 0)), 8) + 0.0 AS null_sd
  FROM (SELECT b, max(sharpe) AS best, sum(sharpe) AS s, sum(sharpe * sharpe) AS ss FROM nulls GROUP BY 1), (SELECT max(round(coalesce(mean / nullif(sd, 0), 0), 12)) AS statistic FROM stats)""", *_UP_TO_SERIES, _AXIS, _NUMBERED, _DRAWS, _NULLS)
def reality_check(spark, sf_dir):
    found = kept_series(spark, sf_dir)
    best = bootstrap.null_best(found, BOOT, MEAN_BLOCK, SEED)
    return rounded(bootstrap.reality_check(best, bootstrap.observed_best(found), len(TRIALS)))


@query("SELECT ts, " + ", ".join(f"round(coalesce(max(CASE WHEN trial = {t.number} THEN net END), 0), 8) + 0.0 AS trial_{t.number}" for t in TRIALS) + " FROM series GROUP BY 1", *_UP_TO_SERIES)
def returns_wide(spark, sf_dir):
    numbers = [t.number for t in TRIALS]
    wide = series(spark, sf_dir).groupBy("ts").pivot("trial", numbers).agg(F.first("net"))
    return wide.select("ts", *[r(F.coalesce(str(n), F.lit(0.0))).alias(f"trial_{n}") for n in numbers])


@query(f"SELECT trial, ts, {_SIGNED_LOG.format('equity')}" + """ FROM (SELECT *, row_number() OVER (PARTITION BY trial ORDER BY ts) - 1 AS i, count(*) OVER (PARTITION BY trial) AS n FROM curve)
  WHERE i % greatest(CAST(ceil(n / 100.0) AS BIGINT), 1) = 0 OR i = n - 1""", *_UP_TO_SERIES, _CURVE)
def equity_thinned(spark, sf_dir):
    """Every so many bars and the last, about a hundred points a trial: the feature is a chart's line."""
    whole = Window.partitionBy("trial")
    numbered = equity(kept_series(spark, sf_dir)).select("trial", "ts", "equity", (F.row_number().over(whole.orderBy("ts")) - 1).alias("i"), F.count(F.lit(1)).over(whole).alias("n"))
    return numbered.where((F.col("i") % F.greatest(F.ceil(F.col("n") / 100), F.lit(1)) == 0) | (F.col("i") == F.col("n") - 1)).select("trial", "ts", signed_log("equity").alias("equity"))
