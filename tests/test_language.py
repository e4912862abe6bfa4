"""The signal language: text, trees, grids; and what its columns may see."""

import pytest
from pyspark.sql import functions as F

from quantloom.operators.features import feature_panel
from quantloom.operators.universe import UniverseRules, universe
from quantloom.plans.expressions import ParseError, expand, lookback, parse
from quantloom.plans.grid import with_signals
from quantloom.sources.simulated import random_walks

RULES = UniverseRules(max_symbols=10, min_adv_usd=1.0, min_history_h=48, adv_window_h=72, adv_min_bars=24)
SYMBOLS = {"AAA": 5e6, "BBB": 3e6, "CCC": 9e6, "DDD": 1e6}


@pytest.mark.parametrize("text", ["cs_zscore(ts_ret(close, 24))", "clip(neg(ts_std(ret, 3)), 0.5)", "close", "cs_rank(ts_mean(trades, [3, 6]))"])
def test_text_round_trips(text):
    assert str(parse(text)) == text and parse(str(parse(f"  {text}  "))) == parse(text)


@pytest.mark.parametrize("text", ["", "nope(close)", "ts_ret(close)", "ts_ret(close, -1)", "ts_mean(close, 1.5)", "ts_ret(close, 0)", "close)", "cs_rank(close, 3)", "ts_ret(close, [1, -2])", "ts_ret(close, 3", "close + 1", "clip(close, x)"])
def test_bad_text_is_refused(text):
    with pytest.raises(ParseError):
        parse(text)


def test_fields_may_look_like_calls():
    assert parse("ts_ret(close(), 3)") == parse("ts_ret(close, 3)")


def test_grids_expand_outermost_slowest():
    found = [str(e) for e in expand("clip(ts_ret(ts_mean(close, [2, 3]), [10, 20]), [1, 2])")]
    assert len(found) == len(set(found)) == 8
    assert found[:3] == ["clip(ts_ret(ts_mean(close, 2), 10), 1)", "clip(ts_ret(ts_mean(close, 3), 10), 1)", "clip(ts_ret(ts_mean(close, 2), 20), 1)"]
    assert lookback("ts_std(ts_ret(close, 24), 72)") == 96 and lookback("neg(close)") == 0


@pytest.fixture(scope="module")
def walks(spark):
    return random_walks(spark, SYMBOLS, 24 * 9).cache()


def poisoned(bars, at):
    return bars.withColumns({c: F.when(F.col("ts") >= F.lit(at).cast("timestamp"), F.col(c) * 1000 + 7).otherwise(F.col(c)) for c in ("close", "quote_volume")})


def test_the_future_cannot_change_the_universe(walks):
    at = "2024-01-07 00:00:00"
    before = [universe(b, RULES).where(F.col("asof") <= F.lit(at).cast("timestamp")).orderBy("asof", "rank").collect() for b in (walks, poisoned(walks, at))]
    assert before[0] == before[1] and before[0]


def test_the_future_cannot_change_a_signal(walks):
    at = "2024-01-07 00:00:00"
    texts = ["cs_zscore(ts_ret(close, 24))", "cs_rank(ts_std(ret, 12))", "clip(ts_zscore(dollar_vol, 12), 1)"]
    found = []
    for bars in (walks, poisoned(walks, at)):
        panel, columns = with_signals(feature_panel(bars, universe(bars, RULES)), texts)
        kept = panel.where(F.col("ts") < F.lit(at).cast("timestamp")).select("symbol", "ts", *[F.round(c, 9).alias(c) for c in columns])
        found.append(kept.orderBy("symbol", "ts").collect())
    assert found[0] == found[1] and any(r[2] is not None for r in found[0])


def test_stale_and_young_symbols_are_left_out(spark, walks):
    late = walks.where("symbol <> 'AAA' or ts >= timestamp'2024-01-08 00:00:00'")  # AAA is young
    gone = late.where("symbol <> 'BBB' or ts < timestamp'2024-01-06 00:00:00'")  # BBB stops
    chosen = {(r["asof"].day, r["symbol"]) for r in universe(gone, RULES).collect()}
    assert not any(s == "AAA" for _, s in chosen) and not any(s == "BBB" and d > 6 for d, s in chosen)
    assert {s for _, s in chosen} == {"BBB", "CCC", "DDD"}


def test_ranks_are_capped_and_ordered(walks):
    rows = universe(walks, UniverseRules(max_symbols=2, min_adv_usd=1.0, min_history_h=48, adv_window_h=72, adv_min_bars=24)).collect()
    assert rows and all(r["symbol"] == {1: "CCC", 2: "AAA"}[r["rank"]] for r in rows)


def test_rank_shares_ties_and_skips_outsiders(spark):
    values = [("a", 1.0, True), ("b", 2.0, True), ("c", 2.0, True), ("d", 5.0, True), ("e", None, True), ("f", 9.0, False)]
    panel = spark.createDataFrame([(s, v, i) for s, v, i in values], "symbol string, ret double, in_universe boolean").withColumn("ts", F.lit("2024-01-01").cast("timestamp"))
    found, (column,) = with_signals(panel, ["cs_rank(ret)"])
    assert {r["symbol"]: r[column] for r in found.collect()} == {"a": -0.25, "b": 0.125, "c": 0.125, "d": 0.5, "e": None, "f": None}


def test_flat_cross_sections_and_nulls_give_null(spark):
    panel = spark.createDataFrame([("a", 1.0, True), ("b", 1.0, True), ("c", None, True)], "symbol string, ret double, in_universe boolean").withColumn("ts", F.lit("2024-01-01").cast("timestamp"))
    found, columns = with_signals(panel, ["cs_zscore(ret)", "clip(ret, 0.5)"])
    rows = {r["symbol"]: tuple(r[c] for c in columns) for r in found.collect()}
    assert rows == {"a": (None, 0.5), "b": (None, 0.5), "c": (None, None)}


def test_equal_parts_are_one_column(spark, walks):
    panel = feature_panel(walks, universe(walks, RULES))
    found, columns = with_signals(panel, ["cs_rank(ts_ret(close, 24))", "neg(cs_rank(ts_ret(close, 24)))", "cs_rank(ts_ret(close, 24))"])
    assert columns[0] == columns[2] and len(found.columns) == len(panel.columns) + 2


def test_trials_in_words():
    from quantloom.plans.describe import counted, describe

    assert describe("cs_zscore(ts_ret(close, 24))") == "buys the most and sells the least change of the price over 24 bars"
    assert describe("neg(cs_rank(ts_std(ret, 72)))") == "buys the least and sells the most deviation of the hourly return over 72 bars"
    assert describe("ts_ret(close, 24)") is None and describe("cs_rank(clip(close, 1))") is None
    assert counted([("cs_rank(close)", 6), ("neg(cs_rank(close))", 6), ("cs_rank(close)", 24), ("neg(cs_rank(close))", 24)]) == "1 signal, 2 signs, 2 rebalancing intervals, 4 trials"
