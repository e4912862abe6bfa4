"""Weights, returns, folds and the audit: invariants, and what plain numpy says."""

import itertools
import math
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantloom.functions.deflation import effective_trials, exact_expected_max, expected_max_sharpe, probabilistic_sharpe
from quantloom.operators import audit, bootstrap
from quantloom.operators.backtest import Trial, WalkForward, bar_sums, fold_sharpes, folds, trial_series, trial_table, with_weights
from quantloom.operators.features import asof_join, feature_panel, gap_free
from quantloom.operators.universe import UniverseRules, last_rebalance, universe
from quantloom.plans.runs import survives
from quantloom.sources.simulated import random_walks

RULES = UniverseRules(max_symbols=10, min_adv_usd=1.0, min_history_h=48, adv_window_h=72, adv_min_bars=24)


@pytest.fixture(scope="module")
def panel(spark):
    bars = random_walks(spark, {"AAA": 5e6, "BBB": 3e6, "CCC": 9e6, "DDD": 1e6, "EEE": 2e6}, 24 * 14)
    return feature_panel(bars, universe(bars, RULES)).cache()


def as_series(spark, matrix):
    start = datetime(2024, 1, 1)
    rows = [(k, start + timedelta(hours=t), float(x)) for t, row in enumerate(matrix) for k, x in enumerate(row)]
    return spark.createDataFrame(rows, "trial int, ts timestamp, net double")


def test_weights_are_neutral_with_unit_gross(panel):
    weighted = with_weights(panel.withColumn("s", F.col("ret")), {"w": ("s", 24)})
    for r in weighted.groupBy("ts").agg(F.sum("w").alias("net"), F.sum(F.abs("w")).alias("gross")).collect():
        assert abs(r["net"]) < 1e-9 and (abs(r["gross"] - 1) < 1e-9 or r["gross"] == 0)


def test_foresight_wins_and_honesty_does_not(panel):
    order = "lead(ret, 1) over (partition by symbol order by ts)"
    both = panel.withColumn("known", F.expr(order)).withColumn("past", F.col("ret"))
    sums = bar_sums(with_weights(both, {"a": ("known", 1), "b": ("past", 1)}), ["a", "b"])
    found = sums.agg(*[(F.avg(f"{n}_gross") / F.stddev(f"{n}_gross") * math.sqrt(8760)).alias(n) for n in "ab"]).first()
    error = math.sqrt(8760 / sums.count())  # of a Sharpe ratio of noise
    assert found["a"] > 10 * error and abs(found["b"]) < 3 * error


def test_who_leaves_the_universe_is_sold(panel):
    cut = panel.withColumn("in_universe", F.col("in_universe") & ((F.col("symbol") != "AAA") | (F.col("ts") < "2024-01-09")))
    weighted = with_weights(cut.withColumn("s", F.col("close")), {"w": ("s", 24)})
    assert weighted.where("symbol = 'AAA' and ts >= '2024-01-09'").agg(F.max(F.abs("w"))).first()[0] == 0


def test_costs_only_cost_and_signs_only_turn(panel):
    trials = [Trial(k, e, 24, c) for k, (e, c) in enumerate(itertools.product(["cs_zscore(ts_ret(close, 6))", "neg(cs_zscore(ts_ret(close, 6)))"], [0.0, 5.0, 50.0]))]
    found = trial_series(panel, trials)
    total = {r["trial"]: r for r in found.groupBy("trial").agg(F.sum("net").alias("net"), F.sum("gross").alias("gross"), F.sum("turnover").alias("turnover")).collect()}
    assert total[0]["net"] > total[1]["net"] > total[2]["net"]
    assert total[0]["gross"] == pytest.approx(-total[3]["gross"]) and total[0]["turnover"] == pytest.approx(total[3]["turnover"])
    exchanges = [f._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") for f in (found, trial_series(panel, trials[:1]))]
    assert exchanges[0] == exchanges[1]  # six trials are no more shuffles than one
    table = trial_table(found, trials, WalkForward(n_splits=2)).collect()
    assert len(table) == 6 and [r["is_sharpe"] for r in table] == sorted((r["is_sharpe"] for r in table), reverse=True)
    assert all(len(r["folds"]) == 2 and r["break_even_bps"] == pytest.approx(total[r["trial"]]["gross"] / total[r["trial"]]["turnover"] * 1e4) for r in table)


def test_folds_are_ordered_purged_and_apart(spark):
    series = as_series(spark, np.zeros((400, 1)))
    rows = folds(series, WalkForward(n_splits=3)).orderBy("fold").collect()
    assert [r["fold"] for r in rows] == [0, 1, 2]
    for a in rows:
        assert a["train_hi"] == a["test_lo"] - timedelta(hours=25) and a["train_lo"] < a["train_hi"] < a["test_lo"] <= a["test_hi"]
    assert all(a["test_hi"] < b["test_lo"] for a, b in itertools.pairwise(rows))
    assert folds(as_series(spark, np.zeros((7, 1))), WalkForward(n_splits=3)).count() == 0
    few = fold_sharpes(series, folds(series, WalkForward(n_splits=3)), {0: 150})
    assert sorted(r["fold"] for r in few.collect()) == [1, 2]  # the first trains for less than the lookback


def test_gaps_are_filled_and_asof_looks_back(spark):
    at = datetime(2024, 1, 1)
    bars = spark.createDataFrame([("a", at, 1.0, 2.0), ("a", at + timedelta(hours=3), 5.0, 4.0)], "symbol string, ts timestamp, close double, quote_volume double")
    found = gap_free(bars).orderBy("ts").collect()
    assert [(r["close"], r["quote_volume"], r["is_real"]) for r in found] == [(1.0, 2.0, True), (1.0, 0.0, False), (1.0, 0.0, False), (5.0, 4.0, True)]
    right = spark.createDataFrame([("a", at + timedelta(hours=k), k) for k in (1, 3)] + [("b", at, 9)], "symbol string, when timestamp, v int")
    joined = asof_join(gap_free(bars).select("symbol", "ts"), right, "ts", "when", "symbol", ["v"])
    assert [r["v"] for r in joined.orderBy("ts").collect()] == [None, 1, 1, 3]


# Winner, trials and results of three published audits.
AUDITS = [
    # n_obs, trials, sr_ann, spread, sr0, skew, kurtosis, psr, dsr, measured sr0, null spread, n_eff, measured dsr, pbo, p value, survives
    (40152, 12, 1.32017487212768, 1.350041208315587, 2.2475639778392327, -17.63603842144653, 1615.049935040096, 0.9928898382318758, 0.04251475742315003, 0.45901138885576664, 0.45770126574940934, 3.7137609766840676, 0.9451158750484749, 0.0, 0.006, False),
    (40152, 12, 1.36096953030092, 1.3489192590383403, 2.2456961439057426, -17.63602941925229, 1615.076522257699, 0.9940550103829715, 0.051005282771273364, 0.45897899482777293, 0.45770356099960446, 3.713342603806674, 0.9522518840248734, 0.0, 0.0045, True),
    (40152, 44, 1.8255397450249928, 1.2043356596208825, 2.6819244217514413, -8.68520483599113, 724.3831687492868, 0.9997778772841706, 0.049710584115337964, 0.7953364591895828, 0.42004247519208093, 19.674318850224275, 0.976265397853488, 0.011904761904761904, 0.0, True),
]


@pytest.mark.parametrize("row", AUDITS)
def test_closed_forms_reproduce_published_audits(row):
    n, trials, sr, spread, sr0, skew, kurtosis, psr, dsr, null0, null_spread, n_eff, null_dsr, pbo, p_value, survived = row
    root = math.sqrt(8760)
    assert expected_max_sharpe(trials, spread) == pytest.approx(sr0, rel=1e-12)
    for benchmark, want in ((0.0, psr), (sr0 / root, dsr), (null0 / root, null_dsr)):
        assert probabilistic_sharpe(sr / root, n, skew, kurtosis, benchmark) == pytest.approx(want, rel=1e-9)
    assert expected_max_sharpe(n_eff, null_spread) == pytest.approx(null0, rel=1e-9)
    assert effective_trials(null0, null_spread) == pytest.approx(n_eff, rel=1e-6)
    assert survives(null_dsr, pbo, p_value) == survived


@pytest.mark.parametrize("n", [2, 2.5, 5, 12, 20, 100, 5000, 9e6])
def test_effective_trials_invert_the_expected_best(n):
    assert effective_trials(expected_max_sharpe(n, 0.3), 0.3) == pytest.approx(n, rel=1e-8)


@pytest.mark.parametrize(("n", "want"), [(1, 0.0), (2, 1 / math.sqrt(math.pi)), (3, 1.5 / math.sqrt(math.pi)), (5, 1.1629644736), (10, 1.5387527308), (100, 2.5075936351)])
def test_the_exact_expected_best_and_how_near_the_closed_form_is(n, want):
    """Known means of the largest of n standard normals."""
    assert exact_expected_max(n) == pytest.approx(want, abs=1e-8)
    assert n < 5 or expected_max_sharpe(n, 1.0) == pytest.approx(want, rel=0.03)


def test_effective_trials_at_the_ends():
    assert effective_trials(0, 1) == effective_trials(1, 0) == effective_trials(-1, 1) == 1.0
    assert effective_trials(100, 1) == 1e7 and effective_trials(1e-9, 1) == 2.0
    assert math.isnan(probabilistic_sharpe(0, 2, 0, 3))
    found = [effective_trials(x, 1.0) for x in np.linspace(0.3, 5, 40)]
    assert found == sorted(found)


def test_cscv_is_that_of_all_combinations(spark):
    matrix = np.random.default_rng(3).normal(0, 0.01, (103, 5))
    matrix[:, 4] = matrix[:, 1]  # duplicates are legal
    cloud = sorted((round(r["is_sharpe"], 9), round(r["oos_sharpe"], 9), round(r["logit"], 9)) for r in audit.cscv_cloud(as_series(spark, matrix), 7).collect())
    blocks, want = matrix[:102].reshape(6, 17, 5), []

    def ratio(part):
        flat = part.reshape(-1, 5)
        return np.round(flat.mean(0) / flat.std(0), 12)

    for pick in itertools.combinations(range(6), 3):
        inside, outside = ratio(blocks[list(pick)]), ratio(blocks[[k for k in range(6) if k not in pick]])
        k = int(np.argmax(inside))
        omega = (outside <= outside[k]).sum() / 6
        want.append((round(float(inside[k]), 9), round(float(outside[k]), 9), round(math.log(omega / (1 - omega)), 9)))
    assert cloud == sorted(want)
    summary = audit.pbo_summary(audit.cscv_cloud(as_series(spark, matrix), 6)).first()
    assert summary["n_combinations"] == 20 and summary["deterioration_slope"] == pytest.approx(np.polyfit([w[0] for w in want], [w[1] for w in want], 1)[0], rel=1e-6)


def test_correlations_and_participation(spark):
    matrix = np.random.default_rng(4).normal(0, 1, (60, 4))
    matrix[:, 2] = matrix[:, 0]
    rho = np.corrcoef(matrix.T)
    found = audit.correlations(as_series(spark, np.c_[matrix, np.ones(60)]))
    got = {(r["a"], r["b"]): r["rho"] for r in found.collect()}
    assert all(got[a, b] == pytest.approx(rho[a, b], abs=1e-9) for a in range(4) for b in range(4)) and got[4, 4] == got[0, 4] == 0
    values = np.linalg.eigvalsh(rho)
    assert audit.participation(found).first()["participation_ratio"] == pytest.approx(values.sum() ** 2 / (values**2).sum())


def test_both_ways_draw_the_same_bars(spark):
    for n_bars, mean_block in ((50, 5.0), (7, 1.0), (1, 48.0)):
        walked = {(r["b"], r["source"]): r["times"] for r in bootstrap.draws(spark, n_bars, 6, mean_block, 3).groupBy("b", "source").agg(F.count(F.lit(1)).alias("times")).collect()}
        counts = {(b, source): int(times) for b in range(6) for source, times in enumerate(bootstrap.times_drawn(*bootstrap.runs_drawn(b, n_bars, mean_block, 3), n_bars)) if times}
        assert walked == counts
        assert all(sum(t for (b, _), t in counts.items() if b == k) == n_bars for k in range(6))


def test_blocks_are_geometric_and_start_anywhere():
    runs = [bootstrap.runs_drawn(b, 5000, 20.0, 1) for b in range(40)]
    lengths = np.concatenate([length[:-1] for _, length in runs])
    # Runs that wrap around are in two, so a few are shorter.
    assert lengths.mean() == pytest.approx(20, rel=0.05) and (lengths == 1).mean() == pytest.approx(0.05, rel=0.25)
    starts = np.concatenate([first for first, _ in runs])
    assert np.histogram(starts, 5, (0, 5000))[0] == pytest.approx(len(starts) / 5, rel=0.1)


def test_a_hash_is_taken_for_a_block_and_not_for_a_bar(monkeypatch):
    taken = []
    real = bootstrap.hashlib.md5
    monkeypatch.setattr(bootstrap.hashlib, "md5", lambda x: taken.append(1) or real(x))
    bootstrap.runs_drawn(0, 40_152, 48.0, 0)
    assert len(taken) < 1200


def explicit(matrix, n_boot, mean_block, seed):
    """Null Sharpe ratios from the histories themselves."""
    sd = matrix.std(0, ddof=1)
    for b in range(n_boot):
        history = np.repeat(np.arange(len(matrix)), bootstrap.times_drawn(*bootstrap.runs_drawn(b, len(matrix), mean_block, seed), len(matrix)))
        yield (matrix[history].mean(0) - matrix.mean(0)) / np.where(sd > 0, sd, np.inf)


def test_null_sharpes_are_those_of_explicit_shared_histories(spark):
    matrix = np.random.default_rng(5).normal(0, 0.01, (audit.BARS + 200, 3))  # two blocks of bars
    matrix[:, 2] = 0.25  # constant
    want = list(explicit(matrix, 20, 5.0, 1))
    found = {(r["b"], r["trial"]): r["sharpe"] for r in bootstrap.null_sharpes(as_series(spark, matrix), 20, 5.0, 1).collect()}
    assert len(found) == 60 and all(found[b, k] == pytest.approx(want[b][k], abs=1e-9) for b in range(20) for k in range(3))


def test_the_worked_example_of_six_bars(spark):
    """A published matrix of six bars and two trials."""
    matrix = np.array([[0.003, 0.002], [0.002, 0.001], [-0.001, -0.002], [-0.002, -0.001], [0.004, 0.003], [0, 0]])
    series = as_series(spark, matrix)
    maxima = np.array([s.max() for s in explicit(matrix, 80, 2.0, 4)])
    statistic = (matrix.mean(0) / matrix.std(0, ddof=1)).max()
    found = bootstrap.reality_check(bootstrap.null_best(series, 80, 2.0, 4), bootstrap.observed_best(series), 2).first()
    assert found["mean_best"] == pytest.approx(maxima.mean()) and found["statistic"] == pytest.approx(statistic)
    assert found["p_value"] == pytest.approx((np.round(maxima, 12) >= round(statistic, 12)).mean())


def search(spark, matrix, n_boot=400, mean_block=5.0):
    """(mean best over the null's spread, p value, effective trials, participation, mean correlation)"""
    series = as_series(spark, matrix)
    row = bootstrap.reality_check(bootstrap.null_best(series, n_boot, mean_block), bootstrap.observed_best(series), matrix.shape[1]).first()
    rho = audit.participation(audit.correlations(series)).first()
    return row["mean_best"], row["p_value"], effective_trials(row["mean_best"], row["null_sd"]), rho["participation_ratio"], rho["mean_abs_corr"]


def test_independent_trials_are_as_many_looks(spark):
    best, _, n_eff, participation, rho = search(spark, np.random.default_rng(5).normal(0, 0.01, (600, 10)), mean_block=1.0)
    assert best == pytest.approx(expected_max_sharpe(10, 1 / math.sqrt(600)), rel=0.25)
    assert 4 < n_eff < 25 and participation == pytest.approx(10, rel=0.25) and rho < 0.06


def test_copies_are_one_look_and_a_negation_is_another(spark):
    x = np.random.default_rng(8).normal(0, 0.01, (300, 1))
    _, _, copies, participation, rho = search(spark, np.repeat(x, 8, axis=1))
    assert copies < 3 and participation == pytest.approx(1, abs=0.05) and rho == pytest.approx(1, abs=1e-9)
    _, _, both, participation, rho = search(spark, np.c_[x, -x])
    assert both > 2 and both > participation and participation == pytest.approx(1, abs=0.05) and rho == pytest.approx(1, abs=1e-9)


def test_the_check_rejects_noise_rarely_and_finds_an_edge(spark):
    rng = np.random.default_rng(2)
    p = [search(spark, rng.normal(0, 0.01, (150, 4)), 60, 1.0)[1] for _ in range(12)]
    assert sum(x < 0.05 for x in p) <= 3 and max(p) > 0.3
    assert search(spark, rng.normal(0, 0.01, (600, 4)) + np.array([0.003, 0, 0, 0]), 100, 1.0)[1] < 0.05


def test_pbo_is_a_coin_flip_under_the_null_and_low_with_an_edge(spark):
    rng = np.random.default_rng(3)
    noise = [audit.pbo_summary(audit.cscv_cloud(as_series(spark, rng.normal(0, 0.01, (240, 8))), 10)).first() for _ in range(5)]
    assert all(r["n_combinations"] == 252 for r in noise)
    assert 0.25 < np.mean([r["pbo"] for r in noise]) < 0.75 and 0.2 < np.mean([r["prob_oos_loss"] for r in noise]) < 0.8
    edge = rng.normal(0, 0.01, (600, 8))
    edge[:, 0] += 0.004
    found = audit.pbo_summary(audit.cscv_cloud(as_series(spark, edge), 10)).first()
    assert found["pbo"] < 0.2 and found["prob_oos_loss"] < 0.05


def test_a_trial_without_some_bars_has_zeros_there(spark):
    matrix = np.random.default_rng(10).normal(0, 0.01, (60, 3))
    whole = as_series(spark, np.where(np.arange(60)[:, None] < np.array([60, 25, 60]), matrix, 0.0))
    cut = as_series(spark, matrix).where("trial <> 1 or ts < timestamp'2024-01-02 01:00:00'")
    for of in (lambda s: audit.cscv_cloud(s, 6), audit.correlations, bootstrap.observed_best, lambda s: bootstrap.null_sharpes(s, 5, 3.0)):
        a, b = (sorted(map(tuple, of(s).collect())) for s in (whole, cut))
        assert np.array(a, float) == pytest.approx(np.array(b, float), abs=1e-9)


def test_a_column_is_a_signal(panel):
    order = "lag(close, 6) over (partition by symbol order by ts)"
    z = F.expr(f"close / {order} - 1")
    mean = "ts_ret(close, 6)"
    trials = [Trial(0, mean, 24, 5.0), Trial(1, z, 24, 5.0, column_lookback=6)]
    assert trials[0].lookback == trials[1].lookback == 6
    a, b = (sorted((r["ts"], r["net"]) for r in trial_series(panel, trials).where(F.col("trial") == k).collect()) for k in (0, 1))
    assert [x for _, x in a] == pytest.approx([x for _, x in b]) and any(x for _, x in a)
    assert trial_table(trial_series(panel, trials), trials, WalkForward(n_splits=2)).count() == 2


def test_factor_model_and_moments(spark):
    rng = np.random.default_rng(6)
    factor = rng.normal(0, 0.01, 400)
    rows = [(f"s{k}", datetime(2024, 1, 1) + timedelta(hours=t), float(b * factor[t] + e)) for k, b in enumerate((0.5, 1.0, 1.5)) for t, e in enumerate(rng.normal(0, 0.002, 400))]
    found = {r["symbol"]: r for r in audit.factor_model(spark.createDataFrame(rows, "symbol string, ts timestamp, ret double")).collect()}
    assert [found[f"s{k}"]["beta"] for k in range(3)] == pytest.approx([0.5, 1.0, 1.5], abs=0.05)
    flat = audit.return_moments(as_series(spark, np.ones((5, 1)))).first()
    assert flat["skew"] == 0 and flat["kurtosis"] == 3


def test_provenance_counts_without_multiplying_the_panel(panel):
    found = audit.provenance(panel)
    assert "Expand" not in found._jdf.queryExecution().executedPlan().toString()
    row, held = found.first(), panel.where("in_universe")
    assert row["n_bars"] == panel.select("ts").distinct().count() and row["n_symbols_available"] == 5 and row["n_symbols_traded"] == held.select("symbol").distinct().count()
    sizes = [r["count"] for r in held.groupBy("ts").count().collect()]
    assert row["mean_universe_size"] == pytest.approx(np.mean(sizes)) and row["turnover_ratio"] == pytest.approx(row["n_symbols_traded"] / math.floor(np.mean(sizes) + 0.5))
    assert row["n_rebalances"] == len({(r["ts"] - datetime(1970, 1, 1)).days for r in held.select("ts").distinct().collect()})
    empty = audit.provenance(panel.limit(0)).first()
    assert empty["n_bars"] == empty["n_symbols_traded"] == 0 and empty["turnover_ratio"] == 0 and empty["mean_universe_size"] is None


def test_the_last_rebalance(spark, panel):
    bars = random_walks(spark, {"AAA": 5e6, "BBB": 3e6, "CCC": 9e6}, 24 * 6)
    chosen = universe(bars, RULES)
    row = last_rebalance(chosen, 2).first()
    assert row["asof"] == max(r["asof"] for r in chosen.collect()) and row["top"] == ["CCC", "AAA"] and row["size"] == 3
    assert last_rebalance(chosen.limit(0)).count() == 0
