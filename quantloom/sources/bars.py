"""Bars from files: archives of minute bars, stored hourly panels, and tables of ticks."""

from __future__ import annotations

import functools
import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.operators.bars import bars

#: Columns of a raw minute bar, by position.
RAW_COLUMNS = (
    "open_time", "open", "high", "low", "close", "volume", "close_time", "quote_volume", "trades", "taker_buy_base", "taker_buy_quote", "ignore",
)
#: Columns of a stored panel.
PANEL = "symbol string, ts timestamp, open double, high double, low double, close double, volume double, quote_volume double, trades long, taker_buy_quote double, n_minutes int"
WHOLE = ("open_time", "close_time", "trades")
MINUTES = "symbol string, month string, ts timestamp, seq long, " + ", ".join(f"{c} {'long' if c in WHOLE else 'double'}" for c in RAW_COLUMNS)
#: Fixed value: times of open above this are microseconds, others milliseconds; a file is of one kind.
MICROS_FROM = 10**14
#: Symbol (the folder, or its partition) and month (in the name, else the name itself) of an archive's path.
_NAMES = (r"(?:symbol=)?([^/=]+)/[^/]*$", r"(\d{4}-\d{2})[^/]*$", r"([^/]+)\.[^/.]*$")


def named(files: DataFrame) -> DataFrame:
    """symbol, month, modified, content of archives read as binary files."""
    symbol, month, name = (F.regexp_extract("path", pattern, 1) for pattern in _NAMES)
    return files.select(symbol.alias("symbol"), F.when(month != "", month).otherwise(name).alias("month"), F.col("modificationTime").alias("modified"), "content")


def zipped(spark: SparkSession, path: str) -> DataFrame:
    """symbol, month, modified, content of all zip files below path."""
    return named(spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").option("recursiveFileLookup", "true").load(path))


def parsed_archive(symbol: str, month: str, content: bytes) -> pd.DataFrame | None:
    """The rows of MINUTES of one archive; a header line is passed over, an empty file has none."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive, archive.open(archive.namelist()[0]) as file:
        raw = file.read()
    rows = pd.read_csv(io.BytesIO(raw), header=None, names=list(RAW_COLUMNS), skiprows=1 if raw[:9].lower() == b"open_time" else 0)
    if rows.empty:
        return None
    unit = "us" if rows["open_time"].iloc[0] > MICROS_FROM else "ms"
    rows.insert(0, "seq", range(len(rows)))
    rows.insert(0, "ts", pd.to_datetime(rows["open_time"], unit=unit))
    rows.insert(0, "month", month)
    rows.insert(0, "symbol", symbol)
    return rows.astype({c: "int64" if c in WHOLE else "float64" for c in RAW_COLUMNS})


def minutes(archives: DataFrame) -> DataFrame:
    """Minute bars of archives: symbol, month, ts, seq (line), RAW_COLUMNS.

    Archives are unpacked and parsed one at a time in tasks.
    """

    def parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for symbol, month, content in zip(batch["symbol"], batch["month"], batch["content"], strict=True):
                rows = parsed_archive(symbol, month, content)
                if rows is not None:
                    yield rows

    return archives.select("symbol", "month", "content").mapInPandas(parsed, MINUTES)


def read_minutes(spark: SparkSession, *paths: str) -> DataFrame:
    """Minute bars of all zip files below the paths."""
    return minutes(functools.reduce(DataFrame.unionByName, (zipped(spark, p) for p in paths)))


def hourly(ticks: DataFrame) -> DataFrame:
    """Hourly bars; with ticks of archives, an archive's bars say of which month it is."""
    return bars(ticks, "hour", ("symbol", "month") if "month" in ticks.columns else ("symbol",))


def write_panel(panel: DataFrame, path: str) -> None:
    """A folder for each symbol and month (that of the archive, else of ts); those that are written again are replaced, others stay."""
    if "month" not in panel.columns:
        panel = panel.withColumn("month", F.date_format("ts", "yyyy-MM"))
    dealt = panel.repartition("symbol", "month")  # one file a folder
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("symbol", "month").parquet(path)


def read_panel(spark: SparkSession, path: str, symbols: list[str] | None = None) -> DataFrame:
    """A stored panel; asking for symbols reads their folders only."""
    panel = spark.read.option("mergeSchema", "false").schema(PANEL + ", month string").parquet(path).drop("month")
    return panel.where(F.col("symbol").isin(symbols)) if symbols else panel


def built_months(spark: SparkSession, path: str) -> DataFrame:
    """symbol, month, built (when its files were written, the oldest) of a stored panel; none where there is no panel yet."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], "symbol string, month string, built timestamp")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(path)
    # Names of folders are quoted as in a URL, and so is the path that is read.
    symbol, month = (F.url_decode(F.url_decode(F.regexp_extract("path", pattern, 1))) for pattern in (r"/symbol=([^/]+)/", r"/month=([^/]+)/"))
    return files.groupBy(symbol.alias("symbol"), month.alias("month")).agg(F.min("modificationTime").alias("built"))


def outdated(archives: DataFrame, built: DataFrame) -> DataFrame:
    """The archives whose month has not been built or is newer than what was."""
    found = archives.join(built, ["symbol", "month"], "left")
    return found.where(F.col("built").isNull() | (F.col("modified") > F.col("built"))).select(archives.columns)


def build(archives: DataFrame, path: str) -> None:
    """Builds the months of archives, of one that is there twice from the later one; doing it again changes nothing."""
    latest = archives.groupBy("symbol", "month").agg(F.max_by("content", "modified").alias("content"))
    write_panel(hourly(minutes(latest)), path)


def ingest(archives: DataFrame, path: str) -> int:
    """Builds the months of a panel that are missing or older than their archive, and no others; returns how many."""
    spark = archives.sparkSession
    # Of a month that was fetched twice, the later archive.
    latest = archives.groupBy("symbol", "month").agg(F.max("modified").alias("modified"))
    todo = outdated(latest, built_months(spark, path)).select("symbol", "month", "modified").collect()  # names only
    if todo:
        wanted = spark.createDataFrame(todo, "symbol string, month string, modified timestamp")
        build(archives.join(wanted, ["symbol", "month", "modified"]), path)
    return len(todo)


def event_ticks(events: DataFrame) -> DataFrame:
    """Ticks of `bars` from a table of events: a type is a symbol, a value a price of one unit."""
    value, none = F.col("value"), F.lit(0).cast("decimal(20,2)")
    amount = value.cast("decimal(20,2)")
    return events.select(
        F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"),
        *[value.alias(c) for c in ("open", "high", "low", "close")], F.lit(1).alias("volume"), amount.alias("quote_volume"), F.lit(1).alias("trades"),
        F.when(F.col("user_id") % 2 == 0, amount).otherwise(none).alias("taker_buy_quote"),
    )


def event_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars(event_ticks(spark.read.parquet(f"{sf_dir}/events.parquet")), "hour")


def item_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of part brands from order lines: the price is that of one piece, returned lines are bought."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_returnflag", "l_shipdate")
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_brand")
    price, amount = F.col("l_extendedprice") / F.col("l_quantity"), F.col("l_extendedprice").cast("decimal(20,2)")
    ticks = lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("p_brand").alias("symbol"), F.col("l_shipdate").cast("timestamp").alias("ts"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"),
        *[price.alias(c) for c in ("open", "high", "low", "close")], F.col("l_quantity").cast("long").alias("volume"), amount.alias("quote_volume"), F.lit(1).alias("trades"),
        F.when(F.col("l_returnflag") == "R", amount).otherwise(F.lit(0).cast("decimal(20,2)")).alias("taker_buy_quote"),
    )
    return bars(ticks, "day")
