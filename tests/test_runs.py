"""Runs from specification to artefacts, sources, streams, and every query against its SQL."""

import http.client
import io
import os
import time
import urllib.error
import zipfile
from datetime import datetime, timedelta

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from quantloom import queries
from quantloom.plans import runs
from quantloom.sources import archive
from quantloom.sources.bars import RAW_COLUMNS, built_months, hourly, ingest, outdated, read_minutes, read_panel, write_panel, zipped
from quantloom.sources.simulated import calibrated, null_panel, random_walks
from quantloom.streaming.bars import streaming_bars

SF = "/root/testdata/sf0.001"
SMALL = {"grids": ["cs_zscore(ts_ret(close, [6, 24]))"], "rebalances": [24], "n_splits": 2, "n_blocks": 4, "n_boot": 40, "universe": {"min_history_h": 48, "min_adv_usd": 1.0}}
WINDOWS = {"adv_window_h": 72, "adv_min_bars": 24}


@pytest.fixture(scope="module")
def bars(spark):
    return random_walks(spark, {"AAA": 5e6, "BBB": 3e6, "CCC": 9e6, "DDD": 1e6}, 24 * 10).cache()


def test_a_run_leaves_an_audit(spark, bars, tmp_path):
    store = runs.ResultStore(spark, str(tmp_path / "store"))
    run = runs.create(store, runs.RunSpec.of(SMALL))
    assert runs.runs(store)[0]["state"] == "queued"
    with pytest.raises(RuntimeError):
        runs.delete(store, run)
    status = runs.execute(store, run, bars, **WINDOWS)
    assert status["state"] == "done", status["error"]
    found = store.get_json(f"{run}/audit.json")
    assert found["pbo"]["n_combinations"] == 6 and found["deflation"]["n_trials"] == 4 and len(found["cost_curve"]["points"]) == 7
    assert set(found) >= {"schema_version", "run_id", "provenance", "universe", "winner", "deflation", "pbo", "search_null", "cost_curve", "survives"}
    assert store.get_table(f"{run}/trials.parquet").count() == 4 and store.get_table(f"{run}/equity.parquet").columns == ["ts", "equity", "equity_gross"]
    assert runs.export(store, str(tmp_path / "out")) == [run]
    exported = runs.ResultStore(spark, f"file://{tmp_path}/out")
    assert exported.get_json(f"{run}/audit.json") == found and exported.get_table(f"{run}/trials.parquet").count() == 4
    assert set(store.get_json(f"{run}/execution.json")["seconds"]) == {"preparing", "trials", "audit"}
    by = [r["max_drawdown"] for r in runs.trials(store, run, "max_drawdown", descending=False).collect()]
    assert by == sorted(by)
    with pytest.raises(ValueError):
        runs.trials(store, run, "folds")
    failed = runs.create(store, runs.RunSpec.of({**SMALL, "universe": {"min_adv_usd": 1e12}}))
    assert runs.execute(store, failed, bars)["state"] == "failed"
    runs.delete(store, run)
    assert not store.exists(f"{run}/status.json")
    with pytest.raises(KeyError):
        runs.delete(store, "nothing")
    for bad in ("../x", "", "a/../../x", "/x"):
        with pytest.raises(ValueError):
            store.path(bad)


@pytest.mark.parametrize("bad", [{"grids": []}, {"grids": ["nope(close)"]}, {"signs": ["x"]}, {"signs": ["{} {}"]}, {"rebalances": [5]}, {"rebalances": [0]}, {"cost_bps": -1}, {"cost_bps": float("nan")}, {"n_splits": 1}, {"n_blocks": 3}, {"n_blocks": 18}, {"n_boot": 0}, {"mean_block_h": 0}, {"universe": {"max_symbols": 1}}, {"grids": ["close"], "signs": ["{}"], "rebalances": [24]}])
def test_bad_specifications_are_refused(bad):
    with pytest.raises(ValueError):
        runs.RunSpec.of({**SMALL, **bad})


def test_trials_are_numbered_by_grid_sign_and_rebalance():
    trials = runs.preview({"grids": ["ts_ret(close, [3, 6])"], "rebalances": [6, 24]})["trials"]
    assert [(t["number"], t["expression"], t["rebalance_every_h"]) for t in trials[:5]] == [
        (0, "ts_ret(close, 3)", 6), (1, "ts_ret(close, 3)", 24), (2, "neg(ts_ret(close, 3))", 6), (3, "neg(ts_ret(close, 3))", 24), (4, "ts_ret(close, 6)", 6),
    ]


def test_noise_does_not_survive(spark, bars, tmp_path):
    model = calibrated(bars).cache()
    a, b = (sorted(map(tuple, null_panel(model.repartition(k), 3).select("symbol", "ts", "close").collect())) for k in (1, 3))
    assert a == b
    found = runs.null_test(runs.ResultStore(spark, str(tmp_path)), lambda seed: null_panel(model, seed), runs.RunSpec.of(SMALL), range(1), **WINDOWS)
    assert found["n_survived"] == 0


def zipped_file(path, first, step, n, header):
    path.parent.mkdir(parents=True, exist_ok=True)
    rows = [[first + k * step, 1.0 + k, 2.0 + k, 0.5, 1.5 + k, 3.0, first + k * step + 1, 10.0, 2, 1.0, 4.0, 0] for k in range(n)]
    text = (",".join(RAW_COLUMNS) + "\n" if header else "") + "\n".join(",".join(map(str, r)) for r in rows)
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("x.csv", text)


def test_archives_become_hourly_bars(spark, tmp_path):
    raw = tmp_path / "raw"
    zipped_file(raw / "AAA" / "AAA-1m-2024-01.zip", 1704067200000, 60_000, 90, True)
    zipped_file(raw / "BBB" / "BBB-1m-2024-01.zip", 1704067200000000, 60_000_000, 60, False)
    found = hourly(read_minutes(spark, str(raw / "AAA"), str(raw / "BBB"))).drop("month")
    assert {(r["symbol"], r["ts"]): (r["n_minutes"], r["open"], r["close"], r["high"], r["low"], r["trades"]) for r in found.collect()} == {
        ("AAA", datetime(2024, 1, 1, 0)): (60, 1.0, 60.5, 61.0, 0.5, 120), ("AAA", datetime(2024, 1, 1, 1)): (30, 61.0, 90.5, 91.0, 0.5, 60), ("BBB", datetime(2024, 1, 1, 0)): (60, 1.0, 60.5, 61.0, 0.5, 120),
    }


def test_ingest_builds_what_is_missing_or_newer_and_leaves_the_rest(spark, tmp_path):
    raw, silver = tmp_path / "raw", str(tmp_path / "silver")
    old = time.time() - 7200
    for symbol, month, first in (("AAA", "2024-01", 1704067200000), ("BBB", "2024-01", 1704067200000), ("Ü=1", "2024-01", 1704067200000)):
        zipped_file(raw / symbol / f"{symbol}-1m-{month}.zip", first, 60_000, 60, False)
        os.utime(raw / symbol / f"{symbol}-1m-{month}.zip", (old, old))
    archives = lambda: zipped(spark, str(raw))
    assert ingest(archives(), silver) == 2 + 1 and ingest(archives(), silver) == 0
    before = {(r["symbol"], r["month"]): r["built"] for r in built_months(spark, silver).collect()}
    assert set(before) == {(r["symbol"], r["month"]) for r in archives().collect()}
    # A month is added to a symbol, and a month of another one is changed.
    zipped_file(raw / "AAA" / "AAA-1m-2024-02.zip", 1706745600000, 60_000, 120, True)
    zipped_file(raw / "BBB" / "BBB-1m-2024-01.zip", 1704067200000, 60_000, 180, True)
    later = time.time() + 5
    for path in (raw / "AAA" / "AAA-1m-2024-02.zip", raw / "BBB" / "BBB-1m-2024-01.zip"):
        os.utime(path, (later, later))
    assert {(r["symbol"], r["month"]) for r in outdated(archives(), built_months(spark, silver)).collect()} == {("AAA", "2024-02"), ("BBB", "2024-01")}
    assert ingest(archives(), silver) == 2
    after = {(r["symbol"], r["month"]): r["built"] for r in built_months(spark, silver).collect()}
    assert after["AAA", "2024-01"] == before["AAA", "2024-01"] and set(after) == {*before, ("AAA", "2024-02")}
    panel = read_panel(spark, silver)
    assert {(r["symbol"], r["ts"].month): r["count"] for r in panel.groupBy("symbol", F.date_trunc("month", "ts").alias("ts")).count().collect() if r["symbol"] in ("AAA", "BBB")} == {("AAA", 1): 1, ("AAA", 2): 2, ("BBB", 1): 3}
    assert read_panel(spark, silver, ["AAA"]).count() == 3 and "month" not in panel.columns
    rows = panel.where("symbol = 'BBB'").collect()
    write_panel(spark.createDataFrame(rows, panel.schema), silver)  # a panel without archives has months by time
    assert sorted(read_panel(spark, silver, ["BBB"]).collect()) == sorted(rows) and read_panel(spark, silver).count() == 3 + 3 + 1


def test_fetching_asks_again_where_that_helps(monkeypatch):
    waits, answers, asked = [], [], []

    def opened(url, timeout):
        asked.append(url)
        answer = answers.pop(0)
        if isinstance(answer, Exception):
            raise answer
        return io.BytesIO(answer)

    def refusal(code):
        return urllib.error.HTTPError("u", code, "", None, None)

    monkeypatch.setattr(archive.urllib.request, "urlopen", opened)
    answers[:] = [refusal(503), ConnectionError(), b"ok"]
    assert archive.fetch("u", sleep=waits.append) == archive.Answer(200, b"ok") and 1 <= waits[0] <= 1.5 and 2 <= waits[1] <= 3
    for code, outcome in ((403, "missing"), (404, "missing"), (401, "refused")):
        answers[:], asked[:] = [refusal(code)], []
        assert archive.fetch("u", sleep=waits.append).outcome == outcome and len(asked) == 1
    for broken in (TimeoutError(), urllib.error.URLError("x"), http.client.IncompleteRead(b""), refusal(429)):
        answers[:], asked[:] = [broken] * 3, []
        assert archive.fetch("u", waits=(1, 1), sleep=waits.append).outcome == "unreachable" and len(asked) == 3


def listing_page(names, token=None):
    folders = "".join(f"<CommonPrefixes><Prefix>p/{n}/</Prefix></CommonPrefixes>" for n in names)
    more = f"<IsTruncated>true</IsTruncated><NextContinuationToken>{token}</NextContinuationToken>" if token else "<IsTruncated>false</IsTruncated>"
    return archive.Answer(200, f'<ListBucketResult xmlns="http://s3.amazonaws.com/doc/2006-03-01/"><Name>x</Name>{more}{folders}</ListBucketResult>'.encode())


def test_listing_and_download(spark, tmp_path):
    asked, pages = [], iter([listing_page(["BUSDT", "XBTC", "A&amp;BUSDT"], "t/1"), listing_page(["AUSDT", "BUSDT"])])
    assert archive.listed_symbols("http://l", "p/", get=lambda url: asked.append(url) or next(pages)) == ["A&BUSDT", "AUSDT", "BUSDT"]
    assert "continuation-token=t%2F1" in asked[1] and "continuation-token" not in asked[0]
    with pytest.raises(ConnectionError):
        archive.listed_symbols("http://l", "p/", get=lambda url: archive.Answer(500))
    assert archive.month_url("http://b", "ü", "2024-01").endswith("/%C3%BC/1m/%C3%BC-1m-2024-01.zip")

    zipped_file(tmp_path / "AAA.zip", 1704067200000, 60_000, 60, False)
    content = (tmp_path / "AAA.zip").read_bytes()

    def get(url):
        return archive.Answer(404 if "GONE" in url else 0 if "AWAY" in url else 200, content)

    table, panel = str(tmp_path / "table"), str(tmp_path / "panel")
    months = spark.createDataFrame([("AAA", "2024-01"), ("AAA", "2024-01"), ("GONE", "2024-01"), ("AWAY", "2024-01")], "symbol string, month string")
    assert archive.archived(spark, table).count() == 0
    outcome = lambda: {r["symbol"]: r["outcome"] for r in archive.download(months, "http://b", table, get=get).collect()}
    assert outcome() == {"AAA": "new", "GONE": "missing", "AWAY": "unreachable"}
    assert outcome() == {"AAA": "there", "GONE": "missing", "AWAY": "unreachable"}
    assert [(r["symbol"], bytes(r["content"])) for r in archive.archived(spark, table).collect()] == [("AAA", content)]
    assert ingest(archive.archived(spark, table), panel) == 1 and ingest(archive.archived(spark, table), panel) == 0
    assert read_panel(spark, panel).count() == 1


def test_streamed_bars_equal_batch(spark, tmp_path):
    start = datetime(2024, 1, 1)
    rows = [("a", start + timedelta(minutes=7 * k), k, *[float(k)] * 4, 1, 2.0, 1, 0.5) for k in range(60)]
    columns = ["symbol", "ts", "seq", "open", "high", "low", "close", "volume", "quote_volume", "trades", "taker_buy_quote"]
    frame = spark.createDataFrame(pd.DataFrame(rows, columns=columns))
    frame.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in"))
    query = streaming_bars(stream, "0 seconds").writeStream.outputMode("append").format("memory").queryName("streamed").option("checkpointLocation", str(tmp_path / "ck")).start()
    query.processAllAvailable()
    query.stop()
    got = {r["ts"]: r.asDict() for r in spark.table("streamed").collect()}
    from quantloom.operators.bars import bars as batch

    want = {r["ts"]: r.asDict() for r in batch(frame).collect()}
    assert got and all(want[t] == v for t, v in got.items()) and len(got) == len(want) - 1  # the last is not final yet


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in ("events", "lineitem", "part"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def plain(frame):
    frame = frame[sorted(frame.columns)]
    rows = [tuple("null" if pd.isna(v) else f"{v:.5f}" if isinstance(v, float) else str(v) for v in r) for r in frame.itertuples(index=False)]
    return sorted(rows)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_agrees_with_its_sql(spark, duck, name):
    assert plain(queries.QUERIES[name](spark, SF).toPandas()) == plain(duck.sql(queries.SQL[name]).df())


def test_entry_points(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
