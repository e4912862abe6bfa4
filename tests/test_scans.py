"""Scans in segments against plain loops, with segments of a few hours."""

import itertools
import math
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantloom.operators import audit, scans

START = datetime(2024, 1, 1)
HOURS = [timedelta(hours=h) for h in range(400)]


@pytest.mark.parametrize("segment_h", [1, 5, 48, 10**6])
def test_asof_join_looks_back_over_any_number_of_segments(spark, segment_h):
    rng = random.Random(segment_h)
    left = [(key, START + HOURS[rng.randrange(400)] if rng.random() < 0.97 else None, k) for k, key in enumerate(rng.choices("abc", k=300))]
    right = [(key, START + h, f"{key}{i}") for key in "ab" for i, h in enumerate(rng.sample(HOURS[50:], 12))] + [("a", None, "never")]
    found = scans.asof_join(
        spark.createDataFrame(left, "symbol string, ts timestamp, k long"), spark.createDataFrame(right, "s string, when timestamp, v string").withColumnRenamed("s", "symbol"), "ts", "when", "symbol", ["v"], segment_h
    ).collect()
    assert sorted(r["k"] for r in found) == list(range(300))
    for r in found:
        seen = [(w, v) for s, w, v in right if s == r["symbol"] and w is not None and r["ts"] is not None and w <= r["ts"]]
        assert (r["when"], r["v"]) == (max(seen) if seen else (None, None))


@pytest.mark.parametrize("segment_h", [1, 7, 100, 10**6])
def test_equity_goes_on_over_segments(spark, segment_h):
    rng = np.random.default_rng(segment_h)
    nets = {0: rng.normal(0, 0.05, 200), 1: rng.normal(0, 0.05, 90)}
    nets[1][40] = -1.7  # more than everything is lost
    nets[1][70] = -1.0
    rows = [(k, START + HOURS[t], float(x), float(x) / 2) for k, own in nets.items() for t, x in enumerate(own)]
    found = scans.equity(spark.createDataFrame(rows, "trial int, ts timestamp, net double, gross double"), segment_h=segment_h).orderBy("trial", "ts").collect()
    for k, own in nets.items():
        mine = [r for r in found if r["trial"] == k]
        curve = np.cumprod(1 + own)
        assert [r["equity"] for r in mine] == pytest.approx(curve, rel=1e-9, abs=1e-12) and [r["equity_gross"] for r in mine] == pytest.approx(np.cumprod(1 + own / 2), rel=1e-9)
        assert [r["peak"] for r in mine] == pytest.approx(np.maximum.accumulate(curve), rel=1e-9, abs=1e-12)


@pytest.mark.parametrize("segment_h", [1, 6, 50, 10**6])
def test_gaps_are_filled_over_segments(spark, segment_h):
    rng = random.Random(segment_h)
    rows = [(s, START + h, rng.random() if rng.random() < 0.8 else None, float(rng.randrange(5)) if rng.random() < 0.9 else None, "x") for s in "ab" for h in sorted(rng.sample(HOURS, 60))]
    rows += [("one", START, 1.0, 1.0, "x")]
    found = scans.gap_free(spark.createDataFrame(rows, "symbol string, ts timestamp, close double, volume double, note string"), ["close"], ["volume"], segment_h=segment_h).collect()
    want = []
    for s in ("a", "b", "one"):
        own = {ts: (c, v) for sym, ts, c, v, _ in rows if sym == s}
        close, ts = None, min(own)
        while ts <= max(own):
            c, v = own.get(ts, (None, None))
            close = close if c is None else c
            want.append((s, ts, close, v or 0.0, "x" if ts in own else None, ts in own))
            ts += timedelta(hours=1)
    assert sorted(map(tuple, found), key=lambda r: r[:2]) == sorted(want, key=lambda r: r[:2])


def test_a_key_is_dealt_by_segment(spark):
    bars = spark.range(5000).select(F.lit("hot").alias("symbol"), F.timestamp_seconds(F.col("id") * 3600).alias("ts"), F.col("id").cast("double").alias("close"))
    series = bars.select(F.lit(0).alias("trial"), "ts", F.lit(0.0).alias("net"), F.lit(0.0).alias("gross"))
    for made in (scans.gap_free(bars, ["close"], [], segment_h=100), scans.asof_join(bars.select("symbol", "ts"), bars.withColumnRenamed("ts", "when"), "ts", "when", "symbol", ["close"], 100), scans.equity(series, segment_h=100)):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert "segment" in plan and made.count() == 5000
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else these few rows are put together again
        try:
            assert made.withColumn("task", F.spark_partition_id()).select("task").distinct().count() > 1
        finally:
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_cscv_of_sixteen_blocks_and_many_trials(spark):
    """All 12,870 halves of 16 blocks, with equal trials, against sums by hand for some of them."""
    rng = np.random.default_rng(11)
    matrix = rng.normal(0, 0.01, (160, 40))
    matrix[:, 7] = matrix[:, 3]
    rows = [(k, START + HOURS[t], float(x)) for t, row in enumerate(matrix) for k, x in enumerate(row)]
    cloud = {r["split"]: r for r in audit.cscv_cloud(spark.createDataFrame(rows, "trial int, ts timestamp, net double"), 16).collect()}
    assert len(cloud) == math.comb(16, 8)
    blocks = matrix.reshape(16, 10, 40)
    for pick in itertools.islice(itertools.combinations(range(16), 8), 0, None, 997):
        inside, outside = (np.round((p := blocks[list(b)].reshape(-1, 40)).mean(0) / p.std(0), 12) for b in (pick, [k for k in range(16) if k not in pick]))
        k = int(inside.argmax())
        omega = (outside <= outside[k]).sum() / 41
        row = cloud[sum(1 << b for b in pick)]
        assert (row["is_sharpe"], row["oos_sharpe"], row["logit"]) == pytest.approx((inside[k], outside[k], math.log(omega / (1 - omega))), abs=1e-9)


@pytest.mark.parametrize("segment_h", [1, 13, 10**6])
def test_the_time_axis_is_numbered_over_segments(spark, segment_h):
    times = [START + h for h in random.Random(1).sample(HOURS, 120)]
    rows = spark.createDataFrame([(t,) for t in times * 3], "ts timestamp")
    found = scans.time_axis(rows, segment_h).collect()
    assert {(r["ts"], r["t"], r["n_bars"], r["first"]) for r in found} == {(t, k, 120, min(times)) for k, t in enumerate(sorted(times))} and len(found) == 120
    assert scans.time_axis(rows.limit(0)).count() == 0


def test_ranks_of_ranges_are_those_of_all(spark):
    rng = random.Random(2)
    values = [rng.choice([None, float(rng.randrange(30)), rng.gauss(0, 100), 5.0]) for _ in range(700)]
    found = scans.mean_rank(spark.createDataFrame(list(enumerate(values)), "k long, x double"), "x", "r").collect()
    known = sorted(v for v in values if v is not None)
    want = {v: (2 * known.index(v) + known.count(v) + 1) / 2 for v in set(known)}
    assert {r["k"]: r["r"] for r in found} == {k: None if v is None else want[v] for k, v in enumerate(values)} and len(found) == 700


def test_nothing_long_is_ordered_in_one_task(spark):
    rows = spark.createDataFrame([(0, START + h, 0.1, 0.2) for h in HOURS], "trial int, ts timestamp, net double, y double")
    for made in (audit.numbered(rows), audit.rank_correlation(rows, "net", "y")):
        plan = made._jdf.queryExecution().optimizedPlan().toString()
        windows = [line for line in plan.splitlines() if "row_number()" in line or "rank(" in line]
        assert windows and all("windowspecdefinition(segment" in w for w in windows)
