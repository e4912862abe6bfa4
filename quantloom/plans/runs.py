"""A run: a specification of trials, evaluated in one plan, audited, and kept as artefacts.

Stages and trials are one Spark application, without a pool of workers: all trials share
the panel and each other's columns, and only rows that are a summary come to the driver.
"""

from __future__ import annotations

import json
import math
import posixpath
import re
import threading
import time
import traceback
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.functions.deflation import effective_trials, probabilistic_sharpe
from quantloom.operators import audit, bootstrap
from quantloom.operators.backtest import PERIODS_A_YEAR, Trial, WalkForward, equity, trial_series, trial_table
from quantloom.operators.features import feature_panel
from quantloom.operators.universe import UniverseRules, universe
from quantloom.plans.describe import counted, describe
from quantloom.plans.expressions import expand, parse

#: Fixed values, with the bounds and defaults below, the order of trials and the keys of artefacts: a run's specification and its
#: results can be read wherever such runs are known. Version of the artefacts' layout; 0 is what was written before there were versions.
SCHEMA_VERSION = 4


#: In a table's folder: which of its versions is the table. Spark passes over names that begin so.
POINTER = "_current.json"


def _between(name: str, value: float, low: float, high: float = math.inf) -> None:
    if not (isinstance(value, int | float) and math.isfinite(value) and low <= value <= high):
        raise ValueError(f"{name} has to be {low} to {high}, not {value!r}")


@dataclass(frozen=True)
class UniverseSpec:
    max_symbols: int = 50
    min_adv_usd: float = 1e5
    min_history_h: int = 720
    min_coverage: float = 0.9
    rebalance_every_h: int = 24

    def __post_init__(self) -> None:
        _between("max_symbols", self.max_symbols, 2, 500)
        _between("min_adv_usd", self.min_adv_usd, 0)
        _between("min_history_h", self.min_history_h, 24)
        _between("min_coverage", self.min_coverage, 0, 1)
        _between("rebalance_every_h", self.rebalance_every_h, 1, 168)

    def rules(self, **more: float) -> UniverseRules:
        return UniverseRules(**{**asdict(self), **more})


@dataclass(frozen=True)
class RunSpec:
    grids: tuple[str, ...] = ("cs_zscore(ts_ret(close, [12, 24, 72, 168, 336]))",)
    signs: tuple[str, ...] = ("{}", "neg({})")
    rebalances: tuple[int, ...] = (6, 24)
    cost_bps: float = 5.0
    n_splits: int = 6
    n_blocks: int = 10
    n_boot: int = 2000
    mean_block_h: float = 48.0
    universe: UniverseSpec = field(default_factory=UniverseSpec)
    label: str | None = None

    def __post_init__(self) -> None:
        for name in ("grids", "signs", "rebalances"):
            if not getattr(self, name):
                raise ValueError(f"{name}: at least one is needed")
            object.__setattr__(self, name, tuple(getattr(self, name)))
        for grid in self.grids:
            parse(grid)
        for sign in self.signs:
            if "{}" not in sign:
                raise ValueError(f"sign template {sign!r} has no {{}}")
            try:
                parse(sign.format("close"))
            except (IndexError, KeyError) as e:
                raise ValueError(f"sign template {sign!r} asks for more than one expression") from e
        for every in self.rebalances:
            _between("rebalances", every, 1, 24)
            if 24 % every:
                raise ValueError("rebalances have to divide 24 hours")
        _between("cost_bps", self.cost_bps, 0)
        _between("n_splits", self.n_splits, 2, 24)
        _between("n_blocks", self.n_blocks, 2, 16)  # halves of 16 blocks are 12 870 splits
        if self.n_blocks % 2:
            raise ValueError("n_blocks has to be even")
        _between("n_boot", self.n_boot, 1, 20_000)
        _between("mean_block_h", self.mean_block_h, 1)
        if len(self.trials()) < 2:
            raise ValueError("a run needs two trials: of one there is no choice to audit")

    @classmethod
    def of(cls, values: dict) -> RunSpec:
        values = dict(values)
        if isinstance(values.get("universe"), dict):
            values["universe"] = UniverseSpec(**values["universe"])
        return cls(**values)

    def trials(self) -> list[Trial]:
        """In order of grid, expression, sign, rebalance; a trial's number is its place."""
        texts = [(sign.format(node), every) for g in self.grids for node in expand(g) for sign in self.signs for every in self.rebalances]
        return [Trial(k, text, every, self.cost_bps) for k, (text, every) in enumerate(texts)]


class ResultStore:
    """Artefacts by key below a folder of any file system that Spark reaches: JSON through Hadoop's, tables by Spark."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        fs = spark._jvm.org.apache.hadoop.fs
        configuration, root_ = spark._jsc.hadoopConfiguration(), fs.Path(root)
        self.files = fs.FileSystem.newInstance(root_.toUri(), configuration)
        self.files.setWriteChecksum(False)  # on a local disk sums are files of their own, and would not be replaced in the same step
        self.root = self.files.makeQualified(root_).toString().rstrip("/")
        self.context = fs.FileContext.getFileContext(self.files.getUri(), configuration)

    def path(self, key: str) -> str:
        inner = posixpath.normpath(key)
        if not key or inner in (".", "..") or inner.startswith(("../", "/")):
            raise ValueError(f"{key!r} is not below the store")
        return f"{self.root}/{inner}"

    def _at(self, path: str):  # noqa: ANN202
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _rename(self, part: str, to: str) -> None:
        """In one step: readers see the old file or the new one."""
        if self.files.getUri().getScheme() == "file":
            self.files.getRaw().rename(self._at(part), self._at(to))  # that of the operating system, which replaces; Hadoop's own would delete first
            return
        kind = self.spark._jvm.org.apache.hadoop.fs.Options.Rename
        options = self.spark.sparkContext._gateway.new_array(kind, 1)
        options[0] = kind.OVERWRITE
        self.context.rename(self._at(part), self._at(to), options)

    def put_json(self, key: str, value: object) -> None:
        """The file appears whole, in the place of an older one."""
        to = self.path(key)
        part = f"{to}.{uuid.uuid4().hex}.part"
        stream = self.files.create(self._at(part), True)
        stream.write(bytearray(json.dumps(value, indent=1, default=str).encode()))
        stream.close()
        self._rename(part, to)

    def get_json(self, key: str) -> dict:
        at = self._at(self.path(key))
        if not self.files.exists(at):
            raise KeyError(key)
        stream = self.files.open(at)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def put_table(self, key: str, table: DataFrame, *by: str) -> DataFrame:
        """The table appears whole, in the place of an older one, which can be read until then and by those who have begun to.

        Every write has a folder of its own, and a pointer, replaced in one step when all is written, says which one is the table. A write that was cut off
        leaves a folder that no pointer names; the next write sweeps it away, with all that is older than the table before.
        """
        version = self._version()
        table.write.option("compression", "zstd").partitionBy(*by).parquet(f"{self.path(key)}/{version}")
        self._commit(key, version)
        return self.get_table(key)

    def _version(self) -> str:
        """Names in order of time."""
        return f"version-{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"

    def _commit(self, key: str, version: str) -> None:
        before = self._current(key)
        self.put_json(f"{key}/{POINTER}", {"version": version})
        for f in self.files.listStatus(self._at(self.path(key))):
            name = f.getPath().getName()
            if name.startswith("version-") and name < version and name != before:
                self.files.delete(f.getPath(), True)

    def _current(self, key: str) -> str | None:
        try:
            return self.get_json(f"{key}/{POINTER}")["version"]
        except KeyError:
            return None

    def get_table(self, key: str) -> DataFrame:
        version = self._current(key)
        return self.spark.read.parquet(f"{self.path(key)}/{version}" if version else self.path(key))  # a plain folder is a table, too

    def exists(self, key: str) -> bool:
        """Whether there is such a file, or such a table that has been written to its end."""
        at = self._at(self.path(key))
        if not self.files.exists(at):
            return False
        if self.files.getFileStatus(at).isFile() or self._current(key):
            return True
        return not any(f.getPath().getName().startswith("version-") for f in self.files.listStatus(at))

    def keys(self, name: str = "status.json") -> list[str]:
        found = self.files.globStatus(self._at(f"{self.root}/*/{name}")) or []
        return sorted("/".join(f.getPath().toString().rsplit("/", 2)[1:]) for f in found)

    def delete(self, prefix: str) -> None:
        self.files.delete(self._at(self.path(prefix)), True)

    def copy(self, key: str, to: ResultStore) -> None:
        """The artefact, a file or a table, in the place of what the other store has; it appears there whole."""
        configuration, util = self.spark._jsc.hadoopConfiguration(), self.spark._jvm.org.apache.hadoop.fs.FileUtil
        if version := self._current(key):
            fresh = to._version()
            to.files.mkdirs(to._at(to.path(key)))
            util.copy(self.files, self._at(f"{self.path(key)}/{version}"), to.files, to._at(f"{to.path(key)}/{fresh}"), False, configuration)
            to._commit(key, fresh)
            return
        part = f"{to.path(key)}.{uuid.uuid4().hex}.part"
        to.files.mkdirs(to._at(posixpath.dirname(part)))
        util.copy(self.files, self._at(self.path(key)), to.files, to._at(part), False, configuration)
        if to.files.isDirectory(to._at(to.path(key))):  # a folder cannot be replaced in one step
            to.delete(key)
        to._rename(part, to.path(key))


def _now() -> str:
    return datetime.now(UTC).isoformat()


def create(store: ResultStore, spec: RunSpec) -> str:
    """Records a run without reading any data; its id begins with the time."""
    run = f"{datetime.now(UTC):%Y%m%d-%H%M%S}-{uuid.uuid4().hex[:4]}"
    store.put_json(f"{run}/spec.json", asdict(spec))
    store.put_json(f"{run}/status.json", {"schema_version": SCHEMA_VERSION, "run_id": run, "state": "queued", "phase": "queued", "n_trials": len(spec.trials()), "n_done": 0, "label": spec.label, "created_at": _now(), "finished_at": None, "error": None})
    return run


class Watch(threading.Thread):
    """Writes a running run's progress to its status, and cancels its jobs when it is asked to stop.

    Progress is that of the jobs that carry the run's tag: tasks done of those in their stages. Every look is a heartbeat, by which
    `reconcile` tells runs whose application has gone.
    """

    def __init__(self, store: ResultStore, run: str, save: Callable[..., None], phase: Callable[[], str], n_trials: int, every: float):
        super().__init__(daemon=True)
        self.store, self.run_, self.save, self.phase, self.n_trials, self.every = store, run, save, phase, n_trials, every
        self.context, self.ended, self.stopped = store.spark.sparkContext, threading.Event(), False
        self.tasks: dict[int, tuple[int, int]] = {}
        self.seen = ""

    def run(self) -> None:
        while not self.ended.wait(self.every):
            self.look()

    def look(self) -> None:
        if self.store.exists(f"{self.run_}/{STOP}"):
            self.stopped = True
            self.context.cancelJobsWithTag(tag_of(self.run_))
        if self.phase() != self.seen:  # each phase has its own stages
            self.seen, self.tasks = self.phase(), {}
        tracker = self.context._jsc.sc().statusTracker()
        jobs = list(tracker.getJobIdsForTag(tag_of(self.run_)))
        for info in filter(None, map(self.context.statusTracker().getJobInfo, jobs)):
            for stage in info.stageIds if info.status == "RUNNING" else ():
                found = self.context.statusTracker().getStageInfo(stage)
                if found:
                    self.tasks[stage] = (found.numCompletedTasks, found.numTasks)
        done, known = (sum(t[k] for t in self.tasks.values()) for k in (0, 1))
        more = {"n_done": min(self.n_trials - 1, self.n_trials * done // known)} if self.seen == "trials" and known else {}
        self.save(tasks_done=done, tasks_known=known, heartbeat=_now())
        if more:
            self.save(only_in="trials", **more)


#: A file beside a run's status that asks it to stop.
STOP = "stop.json"
#: Seconds between two looks at a running run.
LOOK_S = 2.0


def tag_of(run: str) -> str:
    return f"quantloom-{run}"


def execute(store: ResultStore, run: str, bars: DataFrame, look_s: float = LOOK_S, **rules: float) -> dict:
    """Carries a recorded run out on a panel of bars; returns its status. An error, or a request to stop, ends the run, not the caller."""
    spec, status = RunSpec.of(store.get_json(f"{run}/spec.json")), store.get_json(f"{run}/status.json")
    if status["state"] == "stopped":
        return status
    context, lock = store.spark.sparkContext, threading.Lock()

    def save(only_in: str | None = None, **changes: object) -> None:
        with lock:
            if only_in in (None, status["phase"]):  # else the phase has gone on meanwhile
                status.update(changes)
                store.put_json(f"{run}/status.json", status)

    began, seconds = time.monotonic(), {}

    def phase(name: str, **changes: object) -> None:
        """The phase begins; the one before has taken until now."""
        seconds[status["phase"]] = round(time.monotonic() - began - sum(seconds.values()), 3)
        save(phase=name, **changes)

    save(state="running", phase="preparing", error=None, finished_at=None, n_done=0, application_id=context.applicationId, heartbeat=_now())
    context.addJobTag(tag_of(run))
    watch = Watch(store, run, save, lambda: status["phase"], len(spec.trials()), look_s)
    watch.start()
    try:
        limits = spec.universe.rules(**rules)
        panel = store.put_table(f"{run}/panel.parquet", feature_panel(bars, universe(bars, limits), limits.rebalance_every_h))
        known = panel.agg(F.count(F.lit(1)).alias("n"), F.bool_or("in_universe").alias("any")).first()
        if known["n"] < 2 or not known["any"]:
            raise ValueError("nothing to trade in this universe: ask for less volume or history, or read more bars")
        phase("trials", provenance=_row(audit.provenance(panel, limits.rebalance_every_h)))
        series = store.put_table(f"{run}/series.parquet", trial_series(panel, spec.trials()))
        phase("audit", n_done=len(spec.trials()))
        finalise(store, run, spec, series, status["provenance"])
        phase("done", state="done", finished_at=_now())
        store.put_json(f"{run}/execution.json", {"run_id": run, "seconds": seconds, "application_id": context.applicationId, "spark_version": context.version, "parallelism": context.defaultParallelism})
    except Exception:  # noqa: BLE001  whatever it is, it is the run's outcome
        ended = {"state": "stopped", "phase": "stopped", "error": None} if watch.stopped else {"state": "failed", "phase": "failed", "error": traceback.format_exc()}
        save(**ended, finished_at=_now())
    finally:
        watch.ended.set()
        watch.join()
        context.removeJobTag(tag_of(run))
    return status


def stop(store: ResultStore, run: str) -> None:
    """Asks a run to stop, from whatever process: one that is running ends at its next look, one that has not begun will not."""
    status = store.get_json(f"{run}/status.json")
    if status["state"] not in ("queued", "running"):
        raise RuntimeError(f"{run} has ended")
    if status["state"] == "queued":
        store.put_json(f"{run}/status.json", {**status, "state": "stopped", "phase": "stopped", "finished_at": _now()})
    else:
        store.put_json(f"{run}/{STOP}", {"asked_at": _now()})


def reconcile(store: ResultStore, patience_s: float = 60.0) -> list[str]:
    """Marks running runs as failed whose application has not been heard of for that long; returns their ids."""
    gone = []
    for status in runs(store):
        heard = status.get("heartbeat")
        if status["state"] != "running" or (heard and (datetime.now(UTC) - datetime.fromisoformat(heard)).total_seconds() < patience_s):
            continue
        gone.append(status["run_id"])
        store.put_json(f"{status['run_id']}/status.json", {**status, "state": "failed", "phase": "failed", "error": f"application {status.get('application_id')} has gone", "finished_at": _now()})
    return gone


def _row(df: DataFrame) -> dict:
    found = df.first()
    return {k: str(v) if isinstance(v, datetime) else v for k, v in found.asDict(recursive=True).items()} if found else {}


def finalise(store: ResultStore, run: str, spec: RunSpec, series: DataFrame, provenance: dict) -> dict:
    """Tables of trials, cloud and equity, and the audit of the best trial."""
    trials = spec.trials()
    table = store.put_table(f"{run}/trials.parquet", trial_table(series, trials, WalkForward(spec.n_splits)).coalesce(1))
    rows = sorted((r.asDict(recursive=True) for r in table.collect()), key=lambda r: (r["is_sharpe"] is None, -(r["is_sharpe"] or 0), r["trial"]))
    winner = rows[0]
    own = series.where(F.col("trial") == winner["trial"])
    deflation = audit.deflate(_row(audit.return_moments(own)), [r["sharpe"] for r in rows])
    root = math.sqrt(PERIODS_A_YEAR)
    cloud = audit.cscv_cloud(series, spec.n_blocks)
    cloud = store.put_table(f"{run}/pbo_cloud.parquet", cloud.withColumns({"is_sharpe_ann": F.col("is_sharpe") * root, "oos_sharpe_ann": F.col("oos_sharpe") * root}))
    null = search_null(series, deflation, len(trials), spec.n_boot, spec.mean_block_h)
    points = audit.cost_curve(own, tuple(sorted({*audit.COSTS_BPS, float(spec.cost_bps)}))).orderBy("cost_bps").collect()
    pbo = {**_row(audit.pbo_summary(cloud)), "n_trials": len(trials), "n_blocks": spec.n_blocks}
    report = {
        "schema_version": SCHEMA_VERSION, "run_id": run, "provenance": provenance, "universe": asdict(spec.universe), "winner": winner,
        "deflation": asdict(deflation), "pbo": pbo, "search_null": null,
        "cost_curve": {"points": [{"cost_bps": p["cost_bps"], "sharpe": p["sharpe"]} for p in points], "break_even_bps": points[0]["break_even_bps"] if points else None},
        "survives": survives(null["dsr"], pbo["pbo"], null["rc_p_value"]), "survives_analytic": survives(deflation.dsr, pbo["pbo"], null["rc_p_value"]),
    }
    store.put_json(f"{run}/audit.json", report)
    store.put_table(f"{run}/equity.parquet", equity(own).select("ts", "equity", "equity_gross"))
    return report


def survives(dsr: float, pbo: float, p_value: float) -> bool:
    return bool(dsr > 0.95 and pbo < 0.3 and p_value < 0.05)


def search_null(series: DataFrame, deflation: audit.Deflation, n_trials: int, n_boot: int, mean_block: float, seed: int = 0) -> dict:
    """What the search would have found in noise like this, from one bootstrap."""
    root = math.sqrt(deflation.ann_periods)
    best = bootstrap.null_best(series, n_boot, mean_block, seed)
    found = _row(bootstrap.reality_check(best, bootstrap.observed_best(series), n_trials))
    rho = _row(audit.participation(audit.correlations(series)))
    dsr = probabilistic_sharpe(deflation.sr_ann / root, deflation.n_obs, deflation.skew, deflation.kurtosis, found["mean_best"])
    return {
        "n_trials": n_trials, "n_boot": n_boot, "mean_block": mean_block, "sr0_ann": found["mean_best"] * root, "sr0_ann_q95": found["q95"] * root,
        "sr_null_std_ann": found["null_sd"] * root, "n_eff": effective_trials(found["mean_best"], found["null_sd"]), "n_eff_participation": rho["participation_ratio"],
        "mean_abs_corr": rho["mean_abs_corr"], "rc_p_value": found["p_value"], "dsr": dsr,
    }


# --- what a service or a command line calls ---


def preview(values: dict) -> dict:
    """The trials that a specification stands for."""
    trials = RunSpec.of(values).trials()
    told = [{**asdict(t), "says": describe(t.expression)} for t in trials]
    return {"n_trials": len(trials), "made_of": counted((t.expression, t.rebalance_every_h) for t in trials), "trials": told}


def runs(store: ResultStore) -> list[dict]:
    """Status of every run, newest first."""
    return sorted((store.get_json(k) for k in store.keys()), key=lambda s: s["created_at"], reverse=True)


def delete(store: ResultStore, run: str) -> None:
    if not re.fullmatch(r"[\w-]+", run) or not store.exists(f"{run}/status.json"):
        raise KeyError(run)
    if store.get_json(f"{run}/status.json")["state"] in ("queued", "running"):
        raise RuntimeError(f"{run} has not ended")
    store.delete(run)


#: Columns of trials.parquet that may order it.
TRIAL_COLUMNS = ("trial", "expr", "rebalance_every_h", "cost_bps", "n_bars", "sharpe", "gross_sharpe", "ann_return", "ann_vol", "max_drawdown", "hit_rate", "turnover_per_rebal", "break_even_bps", "is_sharpe", "oos_sharpe")


def trials(store: ResultStore, run: str, by: str = "is_sharpe", descending: bool = True) -> DataFrame:
    """A run's table of trials in the order of a column; those without a value come last, ties by number."""
    if by not in TRIAL_COLUMNS:
        raise ValueError(f"{by!r} is none of {', '.join(TRIAL_COLUMNS)}")
    return store.get_table(f"{run}/trials.parquet").orderBy((F.desc_nulls_last if descending else F.asc_nulls_last)(by), "trial")


def export(store: ResultStore, to: str) -> list[str]:
    """Copies the served artefacts of finished runs; returns their ids."""
    served, target = ("spec.json", "status.json", "audit.json", "trials.parquet", "pbo_cloud.parquet", "equity.parquet"), ResultStore(store.spark, to)
    done = [status["run_id"] for status in runs(store) if status["state"] == "done"]
    for run in done:
        for name in served:
            store.copy(f"{run}/{name}", target)
    return done


def null_test(store: ResultStore, simulate: Callable[[int], DataFrame], spec: RunSpec, seeds: range, **rules: float) -> dict:
    """Runs the whole engine on data without any edge; what survives is a leak."""
    results = []
    for seed in seeds:
        run = create(store, spec)
        status = execute(store, run, simulate(seed), **rules)
        if status["state"] != "done":
            raise RuntimeError(status["error"])
        found = store.get_json(f"{run}/audit.json")
        results.append({"seed": seed, "sharpe": found["deflation"]["sr_ann"], "dsr": found["search_null"]["dsr"], "pbo": found["pbo"]["pbo"], "rc_p": found["search_null"]["rc_p_value"], "survives": found["survives"]})
    return {"results": results, "n_survived": sum(r["survives"] for r in results)}
