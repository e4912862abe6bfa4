"""Stationary bootstrap of all trials together, under the null that each has zero mean.

Bars are drawn in blocks of geometric length that wrap around, the same ones for all trials, so that
neither the correlation of trials nor the memory of a trial is lost. Block j of a replicate is read off one hash, the MD5 of
seed, replicate and j: its length by the inverse of the geometric distribution, and the bar at which it starts. So there is a hash for a
block and not for a bar; `draws` does it in DataFrame functions, `runs_drawn` in a task, and both draw the same bars.

A replicate needs only how often it draws each bar. Sums over what is drawn are then a product of two matrices, counts
(replicates by bars) and returns (bars by trials), taken in blocks: a task holds REPLICATES counts of BARS bars and
the returns of those bars, whatever the number of bars and replicates. What is sent to it are the ends of runs of bars.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quantloom.operators.audit import BARS, TIE_DIGITS, numbered, returns_matrix, trial_moments

REPLICATES = 512


def _log_stay(mean_block: float) -> float | None:
    """Logarithm of the chance that a block goes on for another bar; None if it never does."""
    return math.log(1.0 - 1.0 / mean_block) if mean_block > 1 else None


def draws(spark: SparkSession, n_bars: int, n_boot: int, mean_block: float, seed: int) -> DataFrame:
    """b, t, source: which bar replicate b has at place t."""
    n, stay = F.lit(n_bars), _log_stay(mean_block)
    every = spark.range(n_boot if n_bars else 0).select(F.col("id").alias("b"), F.explode(F.sequence(F.lit(0), F.lit(n_bars - 1))).alias("j"))
    text = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("b").cast("string"), F.col("j").cast("string")))
    digits = [F.conv(F.substring(text, at, 13), 16, 10).cast("long") / F.lit(float(1 << 52)) for at in (1, 14)]
    more = F.floor(F.ln(digits[0] + F.lit(2.0**-52)) / F.lit(stay)) if stay else F.lit(0)
    blocks = every.select("b", "j", (1 + F.least(more, n)).cast("long").alias("length"), F.floor(digits[1] * n_bars).cast("long").alias("start"))
    past = Window.partitionBy("b").orderBy("j").rowsBetween(Window.unboundedPreceding, 0)
    begun = blocks.withColumn("begin", F.sum("length").over(past) - F.col("length")).where(F.col("begin") < n_bars)
    end = F.least(F.col("begin") + F.col("length"), n) - 1
    return begun.select("b", F.explode(F.sequence(F.col("begin"), end)).alias("t"), "begin", "start").select("b", "t", ((F.col("start") + F.col("t") - F.col("begin")) % n_bars).alias("source"))


def runs_drawn(b: int, n_bars: int, mean_block: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """First bar and length of every run of consecutive bars that replicate b draws; runs that wrap around are two."""
    stay, total, starts, lengths, name = _log_stay(mean_block), 0, [], [], str(seed).encode()
    while total < n_bars:
        # As many blocks as should do, then a few more.
        j = range(sum(map(len, lengths)), sum(map(len, lengths)) + 16 + int((n_bars - total) / max(mean_block, 1.0)))
        high, low = np.frombuffer(b"".join(hashlib.md5(b"%s:%d:%d" % (name, b, k)).digest() for k in j), ">u8").reshape(-1, 2).T.astype(np.uint64)
        u = (high >> np.uint64(12)) / float(1 << 52) + 2.0**-52
        more = np.minimum(np.floor(np.log(u) / stay), n_bars).astype(np.int64) if stay else np.zeros(len(u), np.int64)
        lengths.append(1 + more)
        second = (high & np.uint64(0xFFF)) << np.uint64(40) | low >> np.uint64(24)
        starts.append(np.floor(second / float(1 << 52) * n_bars).astype(np.int64))
        total += int(lengths[-1].sum())
    start, length = np.concatenate(starts), np.concatenate(lengths)
    upto = np.cumsum(length)
    used = upto - length < n_bars
    length = np.minimum(upto, n_bars)[used] - (upto - length)[used]
    start = start[used]
    over = np.maximum(start + length - n_bars, 0)
    return np.concatenate([start, np.zeros((over > 0).sum(), np.int64)]), np.concatenate([length - over, over[over > 0]])


def times_drawn(first: np.ndarray, length: np.ndarray, n_bars: int) -> np.ndarray:
    """How often each of n_bars is in the runs."""
    change = np.bincount(first, minlength=n_bars + 1) - np.bincount(first + length, minlength=n_bars + 1)
    return np.cumsum(change)[:n_bars]


def drawn_runs(spark: SparkSession, n_bars: int, n_boot: int, mean_block: float, seed: int) -> DataFrame:
    """bars, replicates (numbers of blocks), b, first, length: the runs of a replicate within BARS bars, counted from the block's first."""
    integers = pa.list_(pa.int32())
    schema = [("bars", pa.int64()), ("replicates", pa.int64()), ("b", pa.int64()), ("first", integers), ("length", integers)]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in batch["b"].to_pylist():
                first, length = runs_drawn(b, n_bars, mean_block, seed)
                rows = []
                for block, at in enumerate(range(0, n_bars, BARS)):
                    inside = (first < at + BARS) & (first + length > at)
                    lo = np.maximum(first[inside], at)
                    rows.append((block, b // REPLICATES, b, lo - at, np.minimum((first + length)[inside], at + BARS) - lo))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, (_, kind) in enumerate(schema)], [name for name, _ in schema])

    # A replicate is work of its own, so there are many tasks of few.
    dealt = spark.range(0, n_boot if n_bars else 0, 1, max(1, n_boot // 64))
    return dealt.select(F.col("id").alias("b")).mapInArrow(walk, "bars long, replicates long, b long, first array<int>, length array<int>")


def null_sharpes(series: DataFrame, n_boot: int, mean_block: float, seed: int = 0) -> DataFrame:
    """b, trial, sharpe (per bar) under the null. series is read twice."""
    bars = numbered(series)
    n = bars.agg(F.max("n_bars")).first()[0] or 0
    blocks = max(1, -(-n_boot // REPLICATES))
    copies = bars.withColumn("replicates", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    copies = copies.select(F.floor(F.col("t") / BARS).alias("bars"), "replicates", "t", "n_bars", "trial", "net")

    def product(runs: pa.Table, returns: pa.Table) -> pa.Table:
        names, sums, b = np.zeros(0, np.int64), np.zeros((0, 0)), np.zeros(0, np.int64)
        if runs.num_rows and returns.num_rows:
            names, matrix = returns_matrix(returns)
            b, sizes = np.asarray(runs["b"]), np.asarray(pc.list_value_length(runs["first"].combine_chunks())).astype(np.int64)
            first, length = (np.asarray(runs[c].combine_chunks().flatten()).astype(np.int64) for c in ("first", "length"))
            # All replicates in one row of places, so that one pass counts them.
            place = np.repeat(np.arange(len(b)) * (len(matrix) + 1), sizes) + first
            counts = times_drawn(place, length, len(b) * (len(matrix) + 1)).reshape(len(b), len(matrix) + 1)[:, :-1]
            sums = counts.astype(float) @ matrix
        return pa.table({"b": np.repeat(b, len(names)), "trial": np.tile(names, len(b)).astype(np.int64), "drawn": sums.ravel()})

    both = drawn_runs(series.sparkSession, n, n_boot, mean_block, seed).groupBy("bars", "replicates").cogroup(copies.groupBy("bars", "replicates"))
    drawn = both.applyInArrow(product, "b long, trial long, drawn double").groupBy("b", "trial").agg((F.sum("drawn") / n).alias("drawn"))
    ratio = F.when(F.col("sd") > 0, (F.col("drawn") - F.col("mean")) / F.col("sd")).otherwise(0.0)
    found = drawn.join(trial_moments(bars), "trial")
    return found.select("b", F.col("trial").cast(series.schema["trial"].dataType).alias("trial"), F.round(ratio, TIE_DIGITS).alias("sharpe"))


def null_best(series: DataFrame, n_boot: int, mean_block: float, seed: int = 0) -> DataFrame:
    """b, best, s, ss: the best null Sharpe ratio of each replicate, and the sum and sum of squares of all."""
    sharpes = null_sharpes(series, n_boot, mean_block, seed)
    return sharpes.groupBy("b").agg(F.max("sharpe").alias("best"), F.sum("sharpe").alias("s"), F.sum(F.col("sharpe") * F.col("sharpe")).alias("ss"))


def observed_best(series: DataFrame) -> DataFrame:
    """trial, sharpe (per bar, 0 for a constant series)."""
    ratio = F.when(F.col("sd") > 0, F.col("mean") / F.col("sd")).otherwise(0.0)
    return trial_moments(numbered(series)).select("trial", F.round(ratio, TIE_DIGITS).alias("sharpe"))


def reality_check(best: DataFrame, observed: DataFrame, n_trials: int) -> DataFrame:
    """p_value, statistic (per bar), mean_best, q95, null_sd: one row."""
    top = observed.agg(F.max("sharpe").alias("statistic"))
    n = F.count(F.lit(1)) * n_trials
    spread = F.sqrt(F.greatest(F.sum("ss") / n - F.pow(F.sum("s") / n, 2), F.lit(0.0)))
    return best.crossJoin(F.broadcast(top)).agg(  # top is one row
        F.avg((F.round("best", TIE_DIGITS) >= F.col("statistic")).cast("double")).alias("p_value"), F.max("statistic").alias("statistic"),
        F.avg("best").alias("mean_best"), F.percentile("best", 0.95).alias("q95"), spread.alias("null_sd"),
    )
