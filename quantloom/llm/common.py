"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of bytes that are not ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir.

    Only on one machine (a local master, as in tests) one is made where the session names none; a cluster has to name it.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        named = _own_dir(spark.sparkContext.applicationId)
    return named.rstrip("/")


@lru_cache(maxsize=8)
def _own_dir(application: str) -> str:
    return tempfile.mkdtemp(prefix=f"quantloom-{application}-")


def stored(df: DataFrame, tag: str) -> DataFrame:
    """df written as a table in the shared folder and read back.

    It cuts the lineage, so that what follows neither computes df again nor depends on
    which executor held it. Folders carry the application's id, to sweep them afterwards.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of the Arrow batches between Spark and Python at most, where rows hold whole texts.
BATCH_ROWS = 2048


def small_batches(spark: SparkSession) -> None:
    """From now on the session's Arrow batches have BATCH_ROWS rows at most; fewer, where it asks for fewer.

    A batch of texts is held by the executor, while it grows twice, and by its Python worker. Ten thousand texts, as
    Spark has it by itself, are some 20 MB each time, and what an executor frees of so large pieces stays with it.
    """
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(rows)) <= BATCH_ROWS:
        spark.conf.set(rows, str(BATCH_ROWS))


def sliced(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Arrow batches of that many rows at most: what is made of them is held for so many at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def crc_mod(column: str, n: int) -> Column:
    """crc32 of the column as text, modulo n; null stays null."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


#: Bits of a filter for each member at least, and in all at most: 16 MB are sent to every task, whatever is put in.
BITS_EACH, FILTER_BITS = 16, 1 << 27
_PAGE = 15  # Spark's bitmaps have 2**15 bits


class BitFilter:
    """A set of 64-bit hashes in FILTER_BITS bits at most. It never denies a member.

    Of other hashes it lets pass the share of its bits that are set, 1 - exp(-members / bits): under a sixteenth up to
    8 million members, a tenth at 14 million, two thirds at 150 million. So it only spares work: whatever passes has
    to meet the members themselves in a join, and the plan is the same for any number of them.

    members should be stored, since they are counted and read.
    """

    def __init__(self, members: DataFrame, column: str):
        self.last = min(FILTER_BITS, max(1 << _PAGE, 1 << (BITS_EACH * members.count()).bit_length())) - 1
        at = F.col(column).bitwiseAND(F.lit(self.last))
        pages = members.select(F.shiftright(at, _PAGE).alias("page"), at.bitwiseAND(F.lit((1 << _PAGE) - 1)).alias("bit"))
        bits = np.zeros((self.last + 1 >> _PAGE, 1 << (_PAGE - 3)), np.uint8)
        for r in pages.groupBy("page").agg(F.bitmap_construct_agg("bit").alias("bits")).collect():  # FILTER_BITS bits at most
            bits[r["page"]] = np.frombuffer(r["bits"], np.uint8)
        self.sent = members.sparkSession.sparkContext.broadcast(bits.reshape(-1))

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        """Whether each of the hashes (64-bit integers) may be a member."""
        at = hashes.view(np.int64) & np.int64(self.last)
        return (self.sent.value[at >> 3] >> (at & 7).astype(np.uint8) & np.uint8(1)).astype(bool)

    def column(self, hashes: Column) -> Column:
        """holds as a Column, of a column without nulls."""

        @F.pandas_udf("boolean")
        def held(values):  # noqa: ANN001, ANN202
            return pd.Series(self.holds(values.to_numpy(np.int64)))

        return held(hashes)
