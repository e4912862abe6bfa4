"""Command line: python -m quantloom download | ingest | preview | run | runs | show | delete | export | null-test.

A thin layer over the library; `spark-submit` sets the cluster.
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quantloom.operators.universe import manifest, universe
from quantloom.plans import runs
from quantloom.session import session
from quantloom.sources import archive
from quantloom.sources.bars import ingest, read_panel, zipped
from quantloom.sources.simulated import calibrated, null_panel

#: Fixed by the archive: the folder that symbols are listed below.
KLINES = "data/spot/monthly/klines/"


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="quantloom", description=__doc__.splitlines()[0])
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, *needed: str) -> argparse.ArgumentParser:
        made = commands.add_parser(name)
        for n in needed:
            made.add_argument(n)
        return made

    fetched = command("download", "base", "archive", "months")
    fetched.add_argument("--symbols", nargs="*", help="else all that the listing has")
    fetched.add_argument("--listing", help="address of the listing of the archive")
    built = command("ingest", "archive", "panel")
    built.add_argument("--universe", help="also write the universe there")
    built.add_argument("--zips", action="store_true", help="archive is a folder of zip files, not a table of downloads")
    built.add_argument("--manifest", help="a store to write manifest.json to")
    command("preview", "spec")
    command("run", "store", "panel", "spec").add_argument("--symbols", nargs="*")
    command("runs", "store")
    command("show", "store", "run_id")
    command("delete", "store", "run_id")
    command("export", "store", "to")
    command("null-test", "store", "panel", "spec").add_argument("--seeds", type=int, default=5)
    return top


def spec_of(text: str) -> dict:
    """A specification: JSON, or a file with it."""
    if text.lstrip().startswith("{"):
        return json.loads(text)
    with open(text) as file:
        return json.load(file)


def download(spark: SparkSession, asked: argparse.Namespace) -> int:
    """Months are given as 2023-12,2024-01; a month that cannot be reached does not end the others."""
    symbols = asked.symbols or archive.listed_symbols(asked.listing or asked.base, KLINES)
    pairs = [(s, m) for s in symbols for m in asked.months.split(",")]
    outcomes = archive.download(spark.createDataFrame(pairs, "symbol string, month string"), asked.base, asked.archive)
    found = {r["outcome"]: r["count"] for r in outcomes.groupBy("outcome").count().collect()}
    print(json.dumps({"symbols": len(symbols), "months": asked.months.split(","), "outcomes": found}, indent=1))
    return int(bool(found.keys() & {archive.LATER, archive.REFUSED}))


def build(spark: SparkSession, asked: argparse.Namespace) -> int:
    archives = zipped(spark, asked.archive) if asked.zips else archive.archived(spark, asked.archive)
    rebuilt = ingest(archives, asked.panel)
    panel = read_panel(spark, asked.panel)
    if asked.universe:
        universe(panel).write.mode("overwrite").option("compression", "zstd").parquet(asked.universe)
        found = manifest(panel, spark.read.parquet(asked.universe)).first().asDict()
    else:
        found = manifest(panel, universe(panel).limit(0)).drop("universe_rows", "last_asof", "last_size", "last_top").first().asDict()
    manifest_ = {"archives": archives.count(), "months_rebuilt": rebuilt, **found}
    if asked.manifest:
        runs.ResultStore(spark, asked.manifest).put_json("manifest.json", manifest_)
    print(json.dumps(manifest_, indent=1, default=str))
    return 0


def main(arguments: list[str] | None = None) -> int:
    asked = parser().parse_args(arguments)
    if asked.command == "preview":
        print(json.dumps(runs.preview(spec_of(asked.spec)), indent=1))
        return 0
    spark = session()
    if asked.command == "download":
        return download(spark, asked)
    if asked.command == "ingest":
        return build(spark, asked)
    store = runs.ResultStore(spark, asked.store)
    if asked.command == "run":
        run = runs.create(store, runs.RunSpec.of(spec_of(asked.spec)))
        status = runs.execute(store, run, read_panel(spark, asked.panel, asked.symbols))
        print(json.dumps(status, indent=1, default=str))
        return int(status["state"] != "done")
    if asked.command == "null-test":
        model = calibrated(read_panel(spark, asked.panel)).persist()
        found = runs.null_test(store, lambda seed: null_panel(model, seed), runs.RunSpec.of(spec_of(asked.spec)), range(asked.seeds))
        store.put_json("null_test.json", found)
        print(json.dumps(found, indent=1))
        return int(found["n_survived"] > 0)
    if asked.command == "runs":
        for status in runs.runs(store):
            print(status["run_id"], status["state"], status["phase"], status["n_done"], "of", status["n_trials"], status["label"] or "")
    elif asked.command == "show":
        print(json.dumps(store.get_json(f"{asked.run_id}/audit.json"), indent=1))
    elif asked.command == "delete":
        runs.delete(store, asked.run_id)
    else:
        print("\n".join(runs.export(store, asked.to)))
    return 0


if __name__ == "__main__":
    sys.exit(main())
