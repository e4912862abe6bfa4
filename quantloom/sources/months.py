"""A web archive of monthly files as a Spark data source: one partition a symbol and month, and filters that spare requests.

Filters on symbol and month are pushed into the scan: they decide which months are listed and fetched, and Spark does not apply them
again. Others are left to Spark. A month that the archive does not have gives no rows; one that cannot be had now fails its task,
which Spark tries again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual

from quantloom.sources.archive import CONTENT, MISSING, fetch, listed_symbols, month_url
from quantloom.sources.bars import MINUTES, RAW_COLUMNS, WHOLE, parsed_archive

NAME = "monthly_archive"
ARROW = pa.schema(
    [("symbol", pa.string()), ("month", pa.string()), ("ts", pa.timestamp("us", tz="UTC")), ("seq", pa.int64()), *[(c, pa.int64() if c in WHOLE else pa.float64()) for c in RAW_COLUMNS]]
)


@dataclass
class Month(InputPartition):
    symbol: str
    month: str


def months_between(first: str, last: str) -> list[str]:
    """yyyy-mm from first to last."""
    a, b = (int(m[:4]) * 12 + int(m[5:7]) - 1 for m in (first, last))
    return [f"{k // 12:04d}-{k % 12 + 1:02d}" for k in range(a, b + 1)]


class MonthReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.base, self.listing, self.prefix = options["base"], options.get("listing"), options.get("prefix", "data/spot/monthly/klines/")
        self.quote, self.interval = options.get("quote") or None, options.get("interval", "1m")
        self.named = [s for s in options.get("symbols", "").split(",") if s] or None
        self.months = months_between(options["first"], options["last"])
        self.tests: dict[str, list[Callable[[str], bool]]] = {"symbol": [], "month": []}
        self.only: set[str] | None = None  # symbols that a filter names

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            test = _test(f) if column in self.tests else None
            if test is None:
                yield f
                continue
            self.tests[column].append(test)
            named = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if column == "symbol" and named is not None:
                self.only = named if self.only is None else self.only & named

    def partitions(self) -> list[Month]:
        months = [m for m in self.months if all(t(m) for t in self.tests["month"])]
        if not months:
            return []
        # Symbols that are named need no listing.
        known = self.named if self.named is not None else sorted(self.only) if self.only is not None else listed_symbols(self.listing, self.prefix, self.quote)
        return [Month(s, m) for s in known if all(t(s) for t in self.tests["symbol"]) for m in months]

    def read(self, partition: Month | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # Spark's, where there is no month to read
            return
        answer = fetch(month_url(self.base, partition.symbol, partition.month, interval=self.interval))
        if answer.outcome == MISSING:
            return
        if answer.outcome != CONTENT:
            raise ConnectionError(f"{partition.symbol} {partition.month}: {answer.outcome} ({answer.status})")
        rows = parsed_archive(partition.symbol, partition.month, answer.body)
        if rows is not None:
            rows["ts"] = rows["ts"].dt.tz_localize("UTC")
            yield from pa.Table.from_pandas(rows, schema=ARROW, preserve_index=False).to_batches()


def _test(f: Filter) -> Callable[[str], bool] | None:
    match f:
        case EqualTo():
            return lambda x: x == f.value
        case In():
            return lambda x: x in f.value
        case GreaterThan():
            return lambda x: x > f.value
        case GreaterThanOrEqual():
            return lambda x: x >= f.value
        case LessThan():
            return lambda x: x < f.value
        case LessThanOrEqual():
            return lambda x: x <= f.value
        case IsNotNull():
            return lambda x: x is not None
    return None


class MonthlyArchive(DataSource):
    """Options: base; first and last (yyyy-mm); symbols (with commas), or listing, prefix and quote to find them; interval."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return MINUTES

    def reader(self, schema) -> MonthReader:  # noqa: ANN001
        return MonthReader(self.options)


def archive_minutes(spark: SparkSession, base: str, first: str, last: str, **options: str) -> DataFrame:
    """Minute bars of an archive, fetched when they are read."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(MonthlyArchive)
    return spark.read.format(NAME).options(base=base, first=first, last=last, **options).load()
