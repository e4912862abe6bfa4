"""Tables that appear whole, and runs that are watched, stopped and found dead."""

import threading
import time
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quantloom.plans import runs
from quantloom.sources.simulated import random_walks

from .test_runs import SMALL, WINDOWS


def test_a_killed_write_leaves_the_old_table(spark, tmp_path):
    store = runs.ResultStore(spark, str(tmp_path / "s"))
    store.put_table("r/t.parquet", spark.range(10))
    held = store.get_table("r/t.parquet")
    broken = spark.range(20).repartition(4).withColumn("id", F.when(F.col("id") == 13, F.raise_error(F.lit("killed"))).otherwise(F.col("id")))
    with pytest.raises(Exception, match="killed"):
        store.put_table("r/t.parquet", broken)
    assert store.get_table("r/t.parquet").count() == 10 and held.count() == 10
    # What a killed process leaves behind: a folder without a pointer to it.
    spark.range(7).write.parquet(f"{store.path('r/t.parquet')}/{store._version()}")
    assert store.get_table("r/t.parquet").count() == 10
    store.put_table("r/t.parquet", spark.range(30))
    assert store.get_table("r/t.parquet").count() == 30 and held.count() == 10  # who has begun to read may go on
    versions = [p.name for p in (tmp_path / "s/r/t.parquet").iterdir() if p.name.startswith("version-")]
    assert len(versions) == 2


def test_a_table_that_was_never_finished_is_none(spark, tmp_path):
    store = runs.ResultStore(spark, str(tmp_path))
    spark.range(7).write.parquet(f"{store.path('r/t.parquet')}/{store._version()}")
    assert not store.exists("r/t.parquet") and not store.exists("r/other.parquet")
    spark.range(3).write.parquet(store.path("r/plain.parquet"))
    assert store.exists("r/plain.parquet") and store.get_table("r/plain.parquet").count() == 3
    other = runs.ResultStore(spark, str(tmp_path / "other"))
    store.put_table("r/t.parquet", spark.range(4))
    store.put_json("r/x.json", {"a": 1})
    for _ in range(2):
        store.copy("r/t.parquet", other)
        store.copy("r/x.json", other)
    assert other.get_table("r/t.parquet").count() == 4 and other.get_json("r/x.json") == {"a": 1}


@pytest.fixture(scope="module")
def bars(spark):
    return random_walks(spark, {"AAA": 5e6, "BBB": 3e6, "CCC": 9e6}, 24 * 6)


def slow(bars, seconds):
    """Bars that take their time."""
    return bars.mapInPandas(lambda batches: (time.sleep(seconds) or b for b in batches), bars.schema)


def seen_while_running(store, run, bars, until):
    """Status as read from outside while the run goes on in a thread; until: what ends the watching."""
    seen, result = [], {}
    thread = threading.Thread(target=lambda: result.update(runs.execute(store, run, bars, look_s=0.1, **WINDOWS)))
    thread.start()
    while thread.is_alive():
        status = store.get_json(f"{run}/status.json")
        seen.append(status)
        if until(status):
            break
        time.sleep(0.05)
    return seen, result, thread


def test_a_running_run_says_how_far_it_is(spark, bars, tmp_path):
    store = runs.ResultStore(spark, str(tmp_path))
    run = runs.create(store, runs.RunSpec.of(SMALL))
    seen, result, thread = seen_while_running(store, run, slow(bars, 1), lambda s: False)
    thread.join()
    assert result["state"] == "done", result["error"]
    assert {s["phase"] for s in seen} >= {"preparing", "trials"} and any(0 < s.get("tasks_done", 0) <= s["tasks_known"] for s in seen)
    assert result["n_done"] == 4 and all(s["n_done"] < 4 for s in seen if s["phase"] == "trials") and seen[-1]["application_id"] == spark.sparkContext.applicationId
    assert not spark.sparkContext.getJobTags() and runs.reconcile(store) == []
    with pytest.raises(RuntimeError):
        runs.stop(store, run)


def test_a_run_is_stopped_from_outside(spark, bars, tmp_path):
    store = runs.ResultStore(spark, str(tmp_path))
    run, queued = (runs.create(store, runs.RunSpec.of(SMALL)) for _ in range(2))
    _, result, thread = seen_while_running(store, run, slow(bars, 60), lambda s: s.get("tasks_known", 0) > 0)
    began = time.monotonic()
    runs.stop(runs.ResultStore(spark, str(tmp_path)), run)
    thread.join(30)
    assert not thread.is_alive() and time.monotonic() - began < 30
    assert result["state"] == "stopped" and store.get_json(f"{run}/status.json")["state"] == "stopped"
    assert spark.range(3).count() == 3  # the session goes on
    runs.stop(store, queued)
    assert runs.execute(store, queued, bars)["state"] == "stopped"
    runs.delete(store, run)


def test_a_dead_run_is_found(spark, tmp_path):
    store = runs.ResultStore(spark, str(tmp_path))
    dead, alive, old = (runs.create(store, runs.RunSpec.of(SMALL)) for _ in range(3))
    now = datetime.now(UTC)
    for run, heard in ((dead, now - timedelta(minutes=5)), (alive, now), (old, None)):
        store.put_json(f"{run}/status.json", {**store.get_json(f"{run}/status.json"), "state": "running", "application_id": "app-1"} | ({"heartbeat": heard.isoformat()} if heard else {}))
    assert sorted(runs.reconcile(store)) == sorted([dead, old])
    assert store.get_json(f"{dead}/status.json")["state"] == "failed" and "app-1" in store.get_json(f"{dead}/status.json")["error"]
    assert store.get_json(f"{alive}/status.json")["state"] == "running"
