"""Exact top-k search by inner product over a bit-sliced index.

Components are quantised to integers, floor(scale * x). The index deals rows into blocks of about
BLOCK; in a block each dimension is a set of bitmaps, one for each binary digit of the component less the
block's least. A query's scores over a block are added up digit by digit in bitmap arithmetic: every set
digit of the query's component adds the dimension's bitmaps at the places they then have, and full
adders on whole bitmaps reduce what meets at a place to one slice. A negative component adds the
complemented bitmaps, so that nothing is subtracted. The result is the scores' bit slices.

The top k of a block come from the most significant slice downward: rows with the digit set are
taken while they are fewer than k, else looked at further; rows still equal at the last slice are the
boundary, resolved exactly by the smaller id. The scores of selected rows are read from the slices.
Blocks' results are merged by query. Nothing is approximate: recall is one.

Queries are dealt into blocks too; a task sees one block of rows and one block of queries, builds the block's
bitmaps once and asks it all its queries. A row goes to as many tasks as there are blocks of queries, and a query to as many as
there are blocks of rows, as in a product of blocked matrices: for n rows about n * n / (every * BLOCK) copies of each,
with none of the rows while there are no more than QUERY_BLOCK queries.

Components may be of any size: digits are as many as a block needs, and where scores need more than 62
of them they are Python's integers. A score beyond a long is ordered exactly and reported as the nearest long.

Defined cases: null vectors and vectors with a null, NaN or infinite component take no part, as
queries or candidates, nor do rows without an id or with a component that is infinite times scale; a shorter vector
counts as padded with zeros; rows with the query's id are the query's own; repeated rows are candidates each and one query; an id with
several vectors is a query for each; fewer candidates than k give fewer rows; an empty table gives none; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.llm.common import stored

SCALE, K, EVERY = 256.0, 5, 50
BLOCK, QUERY_BLOCK = 16_384, 4096
#: From here on components are Python's integers, and digits of scores up to which numpy's will do.
WIDE, SCORE_DIGITS = 2.0**62, 62
LEAST, MOST = -(1 << 63), (1 << 63) - 1

HITS = "query_id long, query_hash long, vec_id long, score long, exact string"


def quantised(vectors: DataFrame, scale: float = SCALE) -> DataFrame:
    """vec_id, q: the vectors that take part, as whole numbers in doubles (from 2 ** 53 on every double is one)."""
    def whole(x: Column) -> Column:
        y = F.lit(scale) * x.cast("double")
        return F.when(F.abs(y) < 2.0**53, F.floor(y).cast("double")).otherwise(y)

    usable = F.forall("q", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    known = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull())
    return known.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", whole).alias("q")).where(usable)


class Slices:
    """A block of rows as bitmaps: digits[d] is (bits, words) of the components of dimension d less least[d]."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        self.ids, self.n = ids, len(ids)
        self.least, self.digits = [], []
        for d in range(rows.shape[1]):
            column = rows[:, d]
            if np.abs(column).max(initial=0) < WIDE / 2:  # differences are whole in 64 bits
                column = column.astype(np.int64)
                least = int(column.min(initial=0)) if not self.n else int(column.min())
                above, bits = (column - least).astype(np.uint64), int(column.max(initial=least) - least).bit_length()
                planes = (above[None, :] >> np.arange(bits, dtype=np.uint64)[:, None]) & np.uint64(1)
            else:
                whole = [int(x) for x in column]
                least = min(whole)
                bits = max(x - least for x in whole).bit_length()
                planes = np.array([[x - least >> bit & 1 for x in whole] for bit in range(bits)]).reshape(bits, self.n)
            self.least.append(least)
            self.digits.append(_bitmaps(planes.astype(bool), self.n))
        self.all = _bitmaps(np.ones((1, self.n), bool), self.n)[0]

    def scores(self, query: np.ndarray) -> tuple[np.ndarray, int]:
        """Slices (least significant first) of score - shift, and shift."""
        shift = 0
        columns: dict[int, list[np.ndarray]] = {}
        for d, planes in enumerate(self.digits):
            value = int(query[d]) if d < len(query) else 0
            shift += value * self.least[d]
            if not value or not len(planes):
                continue
            if value < 0:  # value * u is -value * (most - u) + value * most, and most - u is u complemented
                shift += value * ((1 << len(planes)) - 1)
                planes = ~planes & self.all
            for digit in range(abs(value).bit_length()):
                if abs(value) >> digit & 1:
                    for bit in range(len(planes)):
                        columns.setdefault(bit + digit, []).append(planes[bit])
        return add_up(columns, self.all), shift

    def top(self, query: np.ndarray, own_id: int, k: int) -> list[tuple[int, int]]:
        """Ids and scores of the k best rows that are not the query's own, best first."""
        slices, shift = self.scores(query)
        open_ = self.all & ~_bitmaps((self.ids == own_id)[None, :], self.n)[0]
        rows = best_rows(slices, open_, k, self.n, self.ids)
        return sorted(((i, s + shift) for i, s in zip(self.ids[rows].tolist(), read_off(slices, rows), strict=True)), key=lambda x: (-x[1], x[0]))


def add_up(columns: dict[int, list[np.ndarray]], like: np.ndarray) -> np.ndarray:
    """The sum of bitmaps, each standing for its place's power of two, as slices (least significant first).

    Full adders take three bitmaps of a place to one there and a carry in the next, all of a place in one go.
    """
    out, place = [], 0
    while columns:
        stack = columns.pop(place, None)
        if stack is None:
            out.append(np.zeros_like(like))
            place += 1
            continue
        slices = np.stack(stack)
        while len(slices) > 1:
            third = len(slices) // 3
            if third:
                a, b, c = slices[:third], slices[third : 2 * third], slices[2 * third : 3 * third]
                either = a ^ b
                total, carry = either ^ c, (a & b) | (c & either)
                slices = np.concatenate([total, slices[3 * third :]])
            else:
                total, carry = slices[:1] ^ slices[1:], slices[:1] & slices[1:]
                slices = total
            columns.setdefault(place + 1, []).extend(carry)
        out.append(slices[0])
        place += 1
    return np.stack(out) if out else np.zeros((0, len(like)), np.uint64)


def best_rows(slices: np.ndarray, open_: np.ndarray, k: int, n: int, ids: np.ndarray) -> np.ndarray:
    """Numbers of the k rows of greatest sum among the open ones, from the most significant slice down; ties to smaller ids."""
    taken = np.zeros_like(open_)
    for plane in slices[::-1]:
        with_digit = open_ & plane
        found = _count(taken | with_digit)
        if found > k:
            open_ = with_digit
        else:
            taken = taken | with_digit
            open_ = open_ & ~plane
            if found == k:
                open_ = np.zeros_like(open_)
                break
    sure, edge = _rows(taken, n), _rows(open_, n)
    edge = edge[np.argsort(ids[edge], kind="stable")][: k - len(sure)]
    return np.concatenate([sure, edge])


def read_off(slices: np.ndarray, rows: np.ndarray) -> list[int]:
    """The sums of some rows."""
    digits = (slices[:, rows // 64] >> (rows % 64).astype(np.uint64)) & np.uint64(1) if len(slices) else np.zeros((0, len(rows)), np.uint64)
    if len(slices) <= SCORE_DIGITS:
        return (digits.astype(np.int64) << np.arange(len(slices), dtype=np.int64)[:, None]).sum(0).tolist()
    return [sum(1 << place for place in np.flatnonzero(column).tolist()) for column in digits.T]


def _bitmaps(planes: np.ndarray, n: int) -> np.ndarray:
    padded = np.zeros((len(planes), -(-max(n, 1) // 64) * 64), bool)
    padded[:, :n] = planes
    return np.packbits(padded, axis=1, bitorder="little").view(np.uint64)


def _count(bitmap: np.ndarray) -> int:
    return int(np.bitwise_count(bitmap).sum())


def _rows(bitmap: np.ndarray, n: int) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little")[:n])


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Lists as rows, padded with zeros."""
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.asarray(values.value_lengths()).astype(np.int64)
    out = np.zeros((len(values), width))
    flat = np.asarray(values.flatten())
    row = np.repeat(np.arange(len(values)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def search(vectors: DataFrame, k: int = K, every: int = EVERY, scale: float = SCALE, block: int = BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows for each vector whose id is divisible by every."""
    rows = stored(quantised(vectors, scale), "index-rows")
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("q")).alias("width"), F.count(F.when(F.col("vec_id") % every == 0, 1)).alias("queries")).first()
    width = size["width"] or 0
    blocks, query_blocks = max(1, -(-size["n"] // block)), max(1, -(-size["queries"] // query_block))

    # Rows of one id and vector are dealt apart, by a number of their own; a query is one of them.
    own = F.xxhash64("vec_id", "q", F.monotonically_increasing_id())
    held = rows.withColumn("block", F.pmod(own, F.lit(blocks)).cast("int")).withColumn("query_block", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1)))).withColumn("query", F.lit(False))
    asked = rows.where(F.col("vec_id") % every == 0).dropDuplicates(["vec_id", "q"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    asked = asked.withColumn("query_block", F.pmod(F.xxhash64("vec_id", "q"), F.lit(query_blocks)).cast("int")).withColumn("query", F.lit(True))

    def answer(table: pa.Table) -> pa.Table:
        is_query = np.asarray(table["query"])
        matrix, ids = _matrix(table["q"], width), np.asarray(table["vec_id"])
        index = Slices(ids[~is_query], matrix[~is_query])
        found = []
        for q, h, v in zip(ids[is_query].tolist(), np.asarray(table["hash"])[is_query].tolist(), matrix[is_query], strict=True):
            # The order in which a block gives its best says which is better where scores are cut to a long.
            found += [(q, h, i, min(max(s, LEAST), MOST), str(s)) for i, s in index.top(v, q, k)]
        columns = list(zip(*found, strict=True)) if found else [()] * 5
        types = [pa.int64()] * 4 + [pa.string()]
        return pa.table([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["query_id", "query_hash", "vec_id", "score", "exact"])

    hits = held.unionByName(asked).withColumn("hash", F.xxhash64("q")).groupBy("block", "query_block").applyInArrow(answer, HITS)
    # Equal longs at the ends of their range may stand for different scores: by sign and digits then.
    digits = F.length(F.ltrim("exact", F.lit("-")))
    beyond = F.when(F.col("score").isin(LEAST, MOST), F.signum("score") * digits).otherwise(0)
    text = F.when(F.col("score") == MOST, F.col("exact"))
    low = F.when(F.col("score") == LEAST, F.col("exact"))
    best = F.row_number().over(Window.partitionBy("query_id", "query_hash").orderBy(F.desc("score"), F.desc(beyond), F.desc_nulls_last(text), F.asc_nulls_last(low), "vec_id"))
    return hits.withColumn("rank", best.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE_SQL = f"""
WITH v AS (
  SELECT CAST(vec_id AS BIGINT) AS vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
asked AS (SELECT DISTINCT vec_id, q FROM v WHERE vec_id % {EVERY} = 0),
s AS (
  SELECT a.vec_id AS query_id, a.q AS query_q, b.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM asked a JOIN v b ON a.vec_id <> b.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id, query_q ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {K}
"""
