"""Sliding aggregates by blocks against frames summed anew."""

import math
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantloom.operators import frames
from quantloom.operators.universe import UniverseRules, universe
from quantloom.plans.grid import with_signals

HOUR = 3_600_000_000


@pytest.mark.parametrize("width", [1, 7, 60, 1000])
def test_range_sums_are_those_of_left_closed_frames(spark, width):
    rng = random.Random(width)
    parts = [(key, rng.randrange(300), float(rng.randrange(9)) if rng.random() < 0.8 else None, rng.randrange(5)) for key in "ab" for _ in range(150)]
    asks = [(key, us) for key in "abc" for us in (*range(-5, 320, 3), 40, 40)]
    found = frames.range_sums(
        spark.createDataFrame(parts, "symbol string, us long, x double, y long"), spark.createDataFrame(asks, "symbol string, us long"), "symbol", {"w": width, "v": 11}, ["x", "y"]
    ).collect()
    assert len(found) == len(set(asks))
    for r in found:
        for name, size in (("w", width), ("v", 11)):
            inside = [p for p in parts if p[0] == r["symbol"] and r["us"] - size <= p[1] < r["us"]]
            xs = [p[2] for p in inside if p[2] is not None]
            assert r[f"{name}_x"] == (pytest.approx(sum(xs)) if xs else None) and r[f"{name}_y"] == (sum(p[3] for p in inside) if inside else None)


def test_one_key_is_in_many_blocks(spark):
    """A key's rows are dealt by block, so that no task has to have all of them."""
    parts = spark.range(5000).select(F.lit("hot").alias("symbol"), F.col("id").alias("us"), F.lit(1.0).alias("x"))
    plan = frames.range_sums(parts, parts, "symbol", {"w": 50}, ["x"])._jdf.queryExecution().executedPlan().toString()
    windowed = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line and "block" in line]
    assert windowed and all("width" in line for line in windowed)


def bars(spark, values, symbol="a"):
    start = datetime(2024, 1, 1)
    rows = [(symbol, start + timedelta(hours=t), v, True) for t, v in enumerate(values)]
    return spark.createDataFrame(rows, "symbol string, ts timestamp, close double, in_universe boolean")


@pytest.mark.parametrize("n", [1, 2, 5, 24, 100, 101])
def test_frames_of_bars(spark, n):
    rng = np.random.default_rng(n)
    values = [None if rng.random() < 0.02 else float(x) for x in rng.normal(0, 1, 100)]
    texts = [f"{op}(close, {n})" for op in ("ts_mean", "ts_sum", "ts_std", "ts_zscore")]
    panel = bars(spark, values).unionByName(bars(spark, values[::-1], "b"))
    found, columns = with_signals(panel, texts)
    for symbol, own in (("a", values), ("b", values[::-1])):
        rows = [[r[c] for c in columns] for r in found.where(F.col("symbol") == symbol).orderBy("ts").collect()]
        for t, got in enumerate(rows):
            last = own[max(0, t - n + 1) : t + 1]
            if len(last) < n or None in last:
                assert got == [None] * 4
                continue
            mean, sd = np.mean(last), (np.std(last, ddof=1) if n > 1 else None)
            assert got[0] == pytest.approx(mean, rel=1e-10, abs=1e-12) and got[1] == pytest.approx(math.fsum(last), rel=1e-10, abs=1e-12)
            assert got[2] == (None if sd is None else pytest.approx(sd, rel=1e-10)) and got[3] == (None if sd is None else pytest.approx((last[-1] - mean) / sd, rel=1e-8, abs=1e-10))


def test_what_has_left_a_frame_leaves_no_error(spark):
    """Running totals less old ones would keep none of the small digits."""
    values = [1e15] * 10 + [0.1 * k for k in range(40)]
    found, (mean, sd) = with_signals(bars(spark, values), ["ts_mean(close, 5)", "ts_std(close, 5)"])
    last = found.orderBy(F.desc("ts")).first()
    assert last[mean] == pytest.approx(3.7, rel=1e-12) and last[sd] == pytest.approx(np.std(values[-5:], ddof=1), rel=1e-10)
    flat, (sd,) = with_signals(bars(spark, [0.1] * 30), ["ts_std(close, 7)"])
    assert {r[sd] for r in flat.collect()} == {None, 0.0}


def test_many_lookbacks_share_one_partitioning(spark):
    texts = [f"{op}(close, {n})" for n in (5, 24, 72) for op in ("ts_mean", "ts_std")]
    found, _ = with_signals(bars(spark, [1.0, 2.0]), texts)
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_a_frame_behind_a_cross_section_moves_twice(spark):
    found, _ = with_signals(bars(spark, [1.0, 2.0]), ["ts_mean(cs_rank(ts_std(close, 2)), 3)", "ts_std(cs_rank(ts_std(close, 2)), 5)"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(symbol") == 2


@pytest.mark.parametrize(("every", "adv", "stale"), [(24, 72, 24), (5, 50, 7), (1, 30, 3), (6, 48, 12)])
def test_universe_sums_are_those_of_the_bars(spark, every, adv, stale):
    rng = random.Random(every)
    start = datetime(2024, 1, 1)
    rows = [(s, start + timedelta(hours=h), float(rng.randrange(100)), rng.randrange(61)) for s in "abc" for h in range(200) if rng.random() < 0.9]
    rules = UniverseRules(rebalance_every_h=every, min_history_h=20, adv_window_h=adv, adv_min_bars=adv // 2, min_adv_usd=40.0, stale_window_h=stale, stale_min_bars=2, min_coverage=0.3, max_symbols=2)
    found = {(r["asof"], r["symbol"]): r for r in universe(spark.createDataFrame(rows, "symbol string, ts timestamp, quote_volume double, n_minutes int"), rules).collect()}
    want = {}
    for s in "abc":
        own = [r for r in rows if r[0] == s]
        for _, ts, *_ in own:
            if ts.hour % every or (ts - own[0][1]) < timedelta(hours=20):
                continue
            volume = [v for _, t, v, _ in own if timedelta(0) < ts - t <= timedelta(hours=adv)]
            minutes = [m for _, t, _, m in own if timedelta(0) < ts - t <= timedelta(hours=stale)]
            if len(volume) >= adv // 2 and len(minutes) >= 2 and np.mean(volume) >= 40 and sum(minutes) >= 0.3 * stale * 60:
                want.setdefault(ts, []).append((-np.mean(volume), s, sum(minutes)))
    chosen = {(ts, s): (rank, -v, m) for ts, members in want.items() for rank, (v, s, m) in enumerate(sorted(members)[:2], 1)}
    assert set(found) == set(chosen) and chosen
    assert all(r["rank"] == chosen[k][0] and r["adv_usd"] == pytest.approx(chosen[k][1]) and r["coverage_24h"] == pytest.approx(chosen[k][2] / (stale * 60)) for k, r in found.items())
