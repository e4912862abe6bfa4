"""Quality rules: an isolation forest over statistics of each text, with a threshold from labels.

`statistics` computes counts of every whole text. The forest is numpy trees of random splits
over a bounded sample of rows; the anomaly score of a document is 2 ** (-mean path length /
expected path length). The threshold is calibrated on all labelled rows: scores are counted
by label in fixed-width buckets in Spark, and the driver picks from the counts.

Defined cases: null text is a text without words and fails the base rule, as does any text of
under 20 words; repeated rows and ties get equal scores and verdicts; with no labelled row of
either kind the method rejects nothing; an id that is labelled good and bad counts as not labelled, one that is
labelled alike several times counts once; rows of one id in docs all count; a null doc_id has no label;
an empty table gives no rows; other columns, also those
with clashing names, are carried by `filter_quality` and not looked at. Texts are never cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.llm.common import stored

SPACE = " \t\n\v\f\r"
#: Words of a window that is looked for twice; base rule: least words, most per cent of repeated words.
WINDOW, LEAST_WORDS, MOST_REPEATED = 8, 20, 30
#: The forest: trees, rows of a tree's sample, rows sampled for all trees, seed.
TREES, SUBSAMPLE, SAMPLE_ROWS, SEED = 128, 256, 8192, 11
#: Bad rows that a lost good one outweighs (as shares), and score buckets of the calibration.
COST_OF_GOOD, BUCKETS = 10.0, 4096

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Rule statistics, and the least width over which a split of each is drawn.
FEATURES = {"word_length": 0.25, "symbols": 0.02, "repeated": 0.02, "unique": 0.05, "punctuation": 0.01, "capitals": 0.005}
STATISTICS = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", features array<double>"


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a window of WINDOW words found twice or more in the text."""
    n = len(words)
    if n <= WINDOW:
        return 0
    ids = np.fromiter(map(hash, words), np.int64, n).view(np.uint64)
    m = n - WINDOW + 1
    keys = np.zeros(m, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(WINDOW):
            keys = (keys * np.uint64(0x9E3779B97F4A7C15)) ^ (keys >> np.uint64(29))
            keys += ids[i : i + m]
    order = np.sort(keys)
    twice = order[1:] == order[:-1]
    if not twice.any():
        return 0
    found = np.isin(keys, np.unique(order[1:][twice]))
    edges = np.zeros(n + 1, np.int64)
    starts = np.flatnonzero(found)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + WINDOW, -1)
    return int((np.cumsum(edges)[:n] > 0).sum())


def describe(text: str | None) -> tuple:
    """The counts of COUNTS and the features of FEATURES."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    chars = len(text) - sum(map(text.count, SPACE))
    symbols = sum(map(text.count, "[#*$%&|<>]"[1:-1]))
    lines = [x for x in text.split("\n") if x.strip(SPACE)]
    dup = len(lines) - len(set(lines))
    repeated = repeated_words(words)
    each = np.bincount(np.frombuffer(raw, np.uint8), minlength=128)
    some, all_chars = max(n, 1), max(chars, 1)
    marks = int(each[33:48].sum() + each[58:65].sum() + each[91:97].sum() + each[123:127].sum())
    capitals = int(each[65:91].sum())
    features = (chars / some, symbols / some, repeated / some, len(set(words)) / some**0.85, marks / all_chars, capitals / all_chars)
    return n, chars, symbols, dup, repeated, [float(x) for x in features]


def statistics(docs: DataFrame, key: Column | str = "doc_id") -> DataFrame:
    """One row a document, in Arrow batches; a text is held whole, one at a time."""

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [describe(t.as_py()) for t in batch["text"]]
            columns = list(zip(*rows, strict=True)) if rows else [()] * 6
            arrays = [batch["doc_id"], *(pa.array(c, pa.int64()) for c in columns[:5]), pa.array(columns[5], pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", *COUNTS, "features"])

    key = F.col(key) if isinstance(key, str) else key
    return docs.select(key.cast("long").alias("doc_id"), "text").mapInArrow(per_batch, STATISTICS)


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


class IsolationForest:
    """Trees of random splits over samples; arrays only, so that it travels to tasks as it is.

    A split is drawn from the node's range of a feature widened by half on each side, so that
    rows outside what the sample holds are cut off early: its other side is a leaf without rows.
    """

    def __init__(self, rows: np.ndarray, widths: list[float], trees: int = TREES, subsample: int = SUBSAMPLE, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.widths = widths
        self.size = min(subsample, len(rows))
        self.depth = max(1, int(np.ceil(np.log2(max(self.size, 2)))))
        self.trees = []
        for _ in range(trees if self.size > 1 else 0):
            self.trees.append(self._grow(rows[rng.choice(len(rows), self.size, replace=False)], rng))

    def _grow(self, rows: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, ...]:
        feature, cut, left, length = [], [], [], []

        def node(part: np.ndarray, depth: int) -> None:
            queue = [(part, depth, self._new(feature, cut, left, length))]
            while queue:
                part, depth, at = queue.pop()
                if depth >= self.depth or len(part) <= 1:
                    length[at] = depth + expected_path(len(part))
                    continue
                f = int(rng.integers(part.shape[1]))
                low_value, high_value = float(part[:, f].min()), float(part[:, f].max())
                margin = max(high_value - low_value, self.widths[f]) / 2
                c = float(rng.uniform(low_value - margin, high_value + margin))
                low, high = self._new(feature, cut, left, length), self._new(feature, cut, left, length)
                feature[at], cut[at], left[at] = f, c, low
                below = part[:, f] <= c
                queue += [(part[below], depth + 1, low), (part[~below], depth + 1, high)]

        node(rows, 0)
        return np.array(feature), np.array(cut), np.array(left), np.array(length)

    @staticmethod
    def _new(feature: list, cut: list, left: list, length: list) -> int:
        feature.append(0), cut.append(0.0), left.append(-1), length.append(0.0)
        return len(feature) - 1

    def score(self, rows: np.ndarray) -> np.ndarray:
        """0 to 1, higher is more anomalous; 0.5 is what an average row gets."""
        if not self.trees or not len(rows):
            return np.full(len(rows), 0.5)
        total, every = np.zeros(len(rows)), np.arange(len(rows))
        for feature, cut, left, length in self.trees:
            at = np.zeros(len(rows), np.int64)
            for _ in range(self.depth):
                inner = left[at] >= 0
                at = np.where(inner, left[at] + (rows[every, feature[at]] > cut[at]), at)
            total += length[at]
        return 2.0 ** (-total / len(self.trees) / max(expected_path(self.size), 1e-9))


def expected_path(n: int) -> float:
    """Mean path length of an unsuccessful search in a binary tree of n rows."""
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


def known_labels(labels: DataFrame) -> DataFrame:
    """labelled, quality: an id's quality, if it has but one."""
    one = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("most"))
    return one.where("quality = most").select(F.col("doc_id").alias("labelled"), "quality")


def fit_forest(stats: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> IsolationForest:
    """A forest over at most sample_rows different rows labelled good (over any rows, if none is), taken by a hash."""
    good = known_labels(labels).where("quality = 1")
    usable = stats.where(~base_failed())
    known = usable.join(good, F.col("doc_id") == F.col("labelled"), "left_semi")
    rows = _hashed_sample(known, sample_rows) or _hashed_sample(usable, sample_rows)
    return IsolationForest(np.array([r[0] for r in rows], float).reshape(len(rows), len(FEATURES)), list(FEATURES.values()))


def _hashed_sample(rows: DataFrame, most: int) -> list:
    """At most that many different rows' features, by a hash of id and features.

    Tasks send about as many in all, however many they are: rows are thinned by the hash, and equal ones are one.
    """
    h, parts = F.pmod(F.xxhash64("doc_id", "features"), F.lit(1 << 30)), 1 << 30
    n = rows.count()
    thinned = rows.where(h < int(parts * min(1.0, 1.2 * most / max(n, 1)))) if n > most else rows
    return thinned.select("features", h.alias("h")).distinct().orderBy("h", "features").limit(most).collect()


def scored(stats: DataFrame, forest: IsolationForest) -> DataFrame:
    held = stats.sparkSession.sparkContext.broadcast(forest)

    @F.pandas_udf("double")
    def anomaly(features):  # noqa: ANN001, ANN202
        import pandas as pd

        return pd.Series(held.value.score(np.stack(features.to_numpy())) if len(features) else [])

    return stats.withColumn("anomaly", anomaly("features"))


def calibrate(rows: DataFrame, labels: DataFrame, cost_of_good: float = COST_OF_GOOD) -> float:
    """The threshold with most rows labelled bad rejected, less cost_of_good times the share of good ones rejected.

    All labelled rows count; what comes to the driver is one count a bucket and label.
    """
    counts = (
        rows.where(~base_failed())
        .join(known_labels(labels), F.col("doc_id") == F.col("labelled"))
        .groupBy("quality", F.floor(F.col("anomaly") * BUCKETS).cast("int").alias("bucket"))
        .count()
        .collect()
    )
    good, bad = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)
    for r in counts:
        (good if r["quality"] == 1 else bad)[r["bucket"]] += r["count"]
    if not good.sum() or not bad.sum():
        return 2.0
    lost = good[::-1].cumsum()[::-1] / good.sum()  # good rows at a bucket and above
    caught = bad[::-1].cumsum()[::-1] / bad.sum()
    gain = caught - cost_of_good * lost
    if gain.max() <= 0:
        return 2.0
    best = np.flatnonzero(gain == gain.max())  # a gap between good and bad rows is cut in its middle
    return float((best[0] + best[-1]) / 2 / BUCKETS)


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, COUNTS, anomaly, base_failed, kept for every row of docs."""
    stats = stored(statistics(docs), "quality-statistics")
    rows = scored(stats, fit_forest(stats, labels))
    threshold = calibrate(rows, labels)
    return rows.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & (F.col("anomaly") < threshold))


def quality_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return judged(docs, labels).select("doc_id", *COUNTS, "base_failed", "kept", "anomaly")


def filter_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are kept, with all their columns.

    The verdict is a function of the text and the id, so it is computed beside each row and no
    row is joined back: a first pass fits and calibrates, a second one filters.
    """
    stats = stored(statistics(docs), "quality-statistics")
    forest = fit_forest(stats, labels)
    threshold = calibrate(scored(stats, forest), labels)
    held = docs.sparkSession.sparkContext.broadcast(forest)

    @F.pandas_udf("boolean")
    def kept(text):  # noqa: ANN001, ANN202
        import pandas as pd

        rows = [describe(t) for t in text]
        fine = np.array([r[0] >= LEAST_WORDS and 100 * r[4] <= MOST_REPEATED * r[0] for r in rows], bool)
        score = held.value.score(np.array([r[5] for r in rows], float).reshape(len(rows), len(FEATURES)))
        return pd.Series(fine & (score < threshold))

    return docs.where(kept("text"))
