"""The command line, and a market small enough to reckon by hand."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quantloom.__main__ import main
from quantloom.operators.backtest import Trial, bar_sums, trial_series, with_weights
from quantloom.plans.grid import with_signals
from quantloom.sources.bars import write_panel
from quantloom.sources.simulated import random_walks


def test_preview_and_run(spark, tmp_path, capsys):
    spec = {"grids": ["cs_zscore(ts_ret(close, [6, 24]))"], "rebalances": [24], "n_splits": 2, "n_blocks": 4, "n_boot": 20, "universe": {"min_history_h": 400, "min_adv_usd": 1.0}}
    assert main(["preview", json.dumps(spec)]) == 0
    assert json.loads(capsys.readouterr().out)["n_trials"] == 4
    write_panel(random_walks(spark, {"AAA": 5e6, "BBB": 3e6, "CCC": 1e6}, 24 * 20), str(tmp_path / "panel"))
    (tmp_path / "spec.json").write_text(json.dumps(spec))
    assert main(["run", str(tmp_path / "store"), str(tmp_path / "panel"), str(tmp_path / "spec.json")]) == 0
    run = json.loads(capsys.readouterr().out)["run_id"]
    assert main(["show", str(tmp_path / "store"), run]) == 0 and json.loads(capsys.readouterr().out)["run_id"] == run
    assert main(["runs", str(tmp_path / "store")]) == 0 and f"{run} done" in capsys.readouterr().out
    assert main(["delete", str(tmp_path / "store"), run]) == 0


def test_a_market_by_hand(spark):
    """Two coins: a signal of 3 and 1 is weighted +1/2 and -1/2, and earns the next bar's return."""
    at = datetime(2024, 1, 1)
    rows = [("a", at, 0.0, 3.0), ("b", at, 0.0, 1.0), ("a", at + timedelta(hours=1), 0.10, 3.0), ("b", at + timedelta(hours=1), -0.02, 1.0), ("a", at + timedelta(hours=2), 0.20, 0.0), ("b", at + timedelta(hours=2), 0.10, 9.0)]
    panel = spark.createDataFrame(rows, "symbol string, ts timestamp, ret double, s double").withColumn("in_universe", F.lit(True))
    found = bar_sums(with_weights(panel, {"w": ("s", 24)}), ["w"]).orderBy("ts").collect()
    assert [r["w_gross"] for r in found] == pytest.approx([0.0, 0.06, 0.05])
    assert [r["w_turnover"] for r in found] == pytest.approx([0.0, 1.0, 0.0]) and [r["w_exposure"] for r in found] == pytest.approx([0.0, 1.0, 1.0])


def test_four_coins_by_hand(spark):
    """Returns of 10, 5, -5 and -10 % have z-scores in the ratio 2 : 1 : -1 : -2, so weights of 1/3, 1/6, -1/6 and -1/3."""
    at, rows = datetime(2024, 1, 1), []
    for symbol, closes, rets in (("a", (100, 110, 113.3), (None, 0.10, 0.03)), ("b", (100, 105, 105), (None, 0.05, 0.0)), ("c", (100, 95, 89.3), (None, -0.05, -0.06)), ("d", (100, 90, 90), (None, -0.10, 0.0))):
        rows += [(symbol, at + timedelta(hours=t), float(c), r) for t, (c, r) in enumerate(zip(closes, rets, strict=True))]
    panel = spark.createDataFrame(rows, "symbol string, ts timestamp, close double, ret double").withColumn("in_universe", F.lit(True))
    found, (column,) = with_signals(panel, ["cs_zscore(ts_ret(close, 1))"])
    second = found.where(F.col("ts") == F.lit(at + timedelta(hours=1)))
    deviation = (2 * (0.1**2 + 0.05**2) / 3) ** 0.5
    assert [r[column] for r in second.orderBy("symbol").collect()] == pytest.approx([r / deviation for r in (0.1, 0.05, -0.05, -0.1)])
    weighted = with_weights(found, {"w": (column, 1)}).where(F.col("ts") == F.lit(at + timedelta(hours=1)))
    assert [r["w"] for r in weighted.orderBy("symbol").collect()] == pytest.approx([1 / 3, 1 / 6, -1 / 6, -1 / 3])
    last = trial_series(panel, [Trial(0, "cs_zscore(ts_ret(close, 1))", 1, 10.0)]).orderBy("ts").collect()[-1]
    # A third of 3 % and a sixth of 6 %; everything is bought at once, at 10 basis points.
    assert (last["gross"], last["turnover"], last["gross_exposure"], last["net"]) == pytest.approx((0.02, 1.0, 1.0, 0.019))
