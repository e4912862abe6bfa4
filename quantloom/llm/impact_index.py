"""Ranked lexical search over a bit-sliced impact index.

The impact of a term on a document is a whole number: the term's weight (by how many documents hold it) times how often the
document has it, damped and set against the document's length. A document's score is the sum over the query's terms. The
index deals documents into blocks of about BLOCK; in a block a term is a set of bitmaps, one for each binary digit
of its impacts. A query adds the bitmaps of its terms by full adders on whole bitmaps, which carry from
place to place, and the result is the scores' bit slices. The k best are found from the most significant slice downward; documents
that are equal at the last slice are the boundary, resolved by the smaller id. Blocks' results are merged by query. Nothing is approximate.

Texts are read once. What is kept of a document is its length and the terms that some query asks for, as 64-bit hashes with
counts: a `BitFilter` of the queries' terms lets pass few others, and no query has those. (A word whose hash equals that of another
that is asked for would count as it; among ten billion words and a million that are asked for, this has a chance of one in 1,800.)
Numbers of documents with a term, the number of all documents and their length are aggregates over what is kept.

Queries are dealt into blocks too: a task sees one block of documents and one of queries. A row goes to as many tasks as there
are blocks of queries, which is one up to QUERY_BLOCK queries, and a query to as many as there are blocks of documents.

Defined cases: null texts and texts without a term count for nothing and are never found; a query without an id or a term
gives no rows; a term that a query repeats counts once; repeated rows are documents each, and one query; an id with several
texts is a query for each; documents without an id count, and come after others of equal score; fewer
documents with a score above 0 than k give fewer rows; an empty table gives none; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections import Counter, OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantloom.llm.bit_sliced import _bitmaps, add_up, best_rows, read_off
from quantloom.llm.common import BitFilter, sliced, stored

K = 50
#: How much repeats of a term are damped (in thousandths of its count for each percent of length), and the share of a document's length in that, in percent.
DAMPING, LENGTH_PERCENT = 20, 50
BLOCK, QUERY_BLOCK = 32_768, 1024
#: Terms added up in one go, and those whose bitmaps a task keeps.
TOGETHER, KEPT_TERMS = 64, 256
#: Words whose hashes a task remembers.
REMEMBERED = 1 << 20

HITS = "item_id long, query_hash long, doc_id long, score long"

#: Bytes to terms: A-Z lower-cased, what is no ASCII letter or digit and not above ASCII to spaces.
_BYTES = bytes((b + 32 if 65 <= b <= 90 else b) if b > 127 or chr(b).isalnum() else 32 for b in range(256))


def terms(text: str | None) -> list[bytes]:
    """The terms of a text, in order, repeats included."""
    return text.encode().translate(_BYTES).split() if text else []


def term_hash(term: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(term, digest_size=8).digest(), "little", signed=True)


def asked_terms(items: DataFrame) -> DataFrame:
    """item_id, terms (sorted hashes) of the queries that have an id and a term, repeated rows once."""

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches, 128):
            found = [sorted(map(term_hash, set(terms(t)))) for t in part["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([part["item_id"], pa.array(found, pa.list_(pa.int64()))], ["item_id", "terms"])

    known = items.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    return known.mapInArrow(per_batch, "item_id long, terms array<long>").where(F.size("terms") > 0).dropDuplicates(["item_id", "terms"])


def postings(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """doc_id, n (terms with repeats), terms (hashes of those that the filter of vocabulary lets pass), times, for every row with a term."""
    wanted = BitFilter(vocabulary, "term")

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int | None] = {}

        def learn(words: list[bytes]) -> None:
            hashes = np.fromiter(map(term_hash, words), np.int64, len(words))
            known.update(zip(words, (h if held else None for h, held in zip(hashes.tolist(), wanted.holds(hashes).tolist(), strict=True)), strict=True))

        for part in sliced(batches, 128):
            ids, sizes, hashes, times = [], [], [], []
            for id_, text in zip(part["id"].to_pylist(), part["text"].to_pylist(), strict=True):
                counted = Counter(terms(text))
                if not counted:
                    continue
                if len(known) > REMEMBERED:
                    known.clear()
                new = [w for w in counted if w not in known]
                if new:
                    learn(new)
                held = [(h, c) for w, c in counted.items() if (h := known[w]) is not None]
                ids.append(id_)
                sizes.append(counted.total())
                hashes.append([h for h, _ in held])
                times.append([c for _, c in held])
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(hashes, longs), pa.array(times, longs)], ["doc_id", "n", "terms", "times"])

    texts = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("id"), "text")
    return texts.mapInArrow(per_batch, "doc_id long, n long, terms array<long>, times array<long>")


class Impacts:
    """A block of documents, in order of ids, as bitmaps of the digits of their impacts."""

    def __init__(self, order: np.ndarray, owner: np.ndarray, hashes: np.ndarray, impacts: np.ndarray):
        """order: the documents' places in order of ids; owner, hashes, impacts: a posting each."""
        self.n = len(order)
        self.all = _bitmaps(np.ones((1, self.n), bool), self.n)[0]
        place = np.empty(self.n, np.int64)
        place[order] = np.arange(self.n)
        by_term = np.argsort(hashes, kind="stable")
        self.place, self.impacts = place[owner[by_term]], impacts[by_term]
        self.names, self.start = np.unique(hashes[by_term], return_index=True)
        self.end = np.append(self.start[1:], len(hashes))
        self.kept: OrderedDict[int, np.ndarray] = OrderedDict()

    def digits(self, term: int, weight: int) -> np.ndarray:
        """The bitmaps of a term's impacts, least significant first; a term that the block lacks has none."""
        if term in self.kept:
            self.kept.move_to_end(term)
            return self.kept[term]
        at = int(np.searchsorted(self.names, term))
        held = slice(self.start[at], self.end[at]) if at < len(self.names) and self.names[at] == term else slice(0, 0)
        place, values = self.place[held], self.impacts[held] * weight
        bits = int(values.max(initial=0)).bit_length()
        planes = np.zeros((bits, len(self.all)), np.uint64)
        bit, row = np.nonzero((values[None, :] >> np.arange(bits)[:, None]) & 1)
        np.bitwise_or.at(planes, (bit, place[row] >> 6), np.uint64(1) << (place[row] & 63).astype(np.uint64))
        self.kept[term] = planes
        if len(self.kept) > KEPT_TERMS:
            self.kept.popitem(last=False)
        return planes

    def top(self, asked: list[tuple[int, int]], k: int) -> tuple[np.ndarray, list[int]]:
        """Places and scores of the k best documents for (term, weight) pairs, of those with a score above 0."""
        slices = np.zeros((0, len(self.all)), np.uint64)
        for at in range(0, len(asked), TOGETHER):
            columns = {place: [plane] for place, plane in enumerate(slices)}
            for term, weight in asked[at : at + TOGETHER]:
                for place, plane in enumerate(self.digits(term, weight)):
                    columns.setdefault(place, []).append(plane)
            slices = add_up(columns, self.all)
        some = np.bitwise_or.reduce(slices, axis=0) if len(slices) else np.zeros_like(self.all)
        rows = best_rows(slices, some, k, self.n, np.arange(self.n))
        return rows, read_off(slices, rows)


def damped(times: np.ndarray, n: np.ndarray, documents: int, length: int, damping: int = DAMPING, length_percent: int = LENGTH_PERCENT) -> np.ndarray:
    """Impacts before weights, up to a million: times against the document's length n, by whole numbers."""
    against = 100 - length_percent + (length_percent * n * documents) // length
    return (1_000_000_000 * times) // (1000 * times + damping * against)


def search(
    docs: DataFrame, items: DataFrame, k: int = K, damping: int = DAMPING, length_percent: int = LENGTH_PERCENT, block: int = BLOCK, query_block: int = QUERY_BLOCK
) -> DataFrame:
    """item_id, rank, doc_id, score: the k documents of greatest score for every item."""
    spark = docs.sparkSession
    asked = stored(asked_terms(items), "impact-asked")
    vocabulary = stored(asked.select(F.explode("terms").alias("term")).distinct(), "impact-terms")
    held = stored(postings(docs, vocabulary), "impact-postings")
    whole = held.agg(F.count(F.lit(1)).alias("documents"), F.sum("n").alias("length")).first()
    documents, length = whole["documents"], whole["length"] or 1
    counts = held.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weight = F.floor(1000 * F.log((2.0 * documents + 2.0) / (2.0 * F.col("df") + 1.0))).cast("long")
    weights = vocabulary.join(counts, "term").select("term", weight.alias("weight"))
    # A query's terms, with weights, in a row of its own; those that no document has are of no use.
    queries = asked.withColumn("query_hash", F.xxhash64("terms")).select("item_id", "query_hash", F.explode("terms").alias("term")).join(weights, "term")
    queries = queries.groupBy("item_id", "query_hash").agg(F.sort_array(F.collect_list(F.struct("term", "weight"))).alias("pairs"))
    queries = stored(queries.select("item_id", "query_hash", F.col("pairs.term").alias("terms"), F.col("pairs.weight").alias("weights")), "impact-queries")

    blocks, query_blocks = max(1, -(-documents // block)), max(1, -(-queries.count() // query_block))
    # Rows are numbered as they are stored, so that equal ones are dealt apart.
    number = F.xxhash64(F.monotonically_increasing_id())
    rows = held.select(
        F.pmod(number, F.lit(blocks)).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("query_block"),
        F.lit(False).alias("query"), F.col("doc_id").alias("id"), F.col("n").alias("number"), "terms", F.col("times").alias("values"),
    )
    wanted = queries.select(
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.pmod(F.xxhash64("item_id", "query_hash"), F.lit(query_blocks)).cast("int").alias("query_block"),
        F.lit(True).alias("query"), F.col("item_id").alias("id"), F.col("query_hash").alias("number"), "terms", F.col("weights").alias("values"),
    )

    def answer(table: pa.Table) -> pa.Table:
        is_query = table["query"]
        ask, own = table.filter(is_query).combine_chunks(), table.filter(pa.compute.invert(is_query)).combine_chunks()
        asked_for = [list(zip(t, w, strict=True)) for t, w in zip(ask["terms"].to_pylist(), ask["values"].to_pylist(), strict=True)]
        sizes = _flat(pa.compute.list_value_length(own["terms"])).astype(np.int64)
        hashes, times = _flat(pa.compute.list_flatten(own["terms"])), _flat(pa.compute.list_flatten(own["values"]))
        owner = np.repeat(np.arange(len(sizes)), sizes)
        used = np.isin(hashes, np.array([t for pairs in asked_for for t, _ in pairs], np.int64))
        impacts = damped(times[used], _flat(own["number"])[owner[used]], documents, length, damping, length_percent)
        order = np.asarray(pa.compute.array_sort_indices(own["id"], null_placement="at_end")).astype(np.int64)
        index = Impacts(order, owner[used], hashes[used], impacts)
        found = [[], [], [], []]
        for id_, number, pairs in zip(ask["id"].to_pylist(), ask["number"].to_pylist(), asked_for, strict=True):
            places, scores = index.top(pairs, k)
            for column, values in zip(found, ([id_] * len(places), [number] * len(places), order[places].tolist(), scores), strict=True):
                column += values
        ids = own["id"].take(pa.array(found[2], pa.int64()))
        return pa.table([pa.array(found[0], pa.int64()), pa.array(found[1], pa.int64()), ids, pa.array(found[3], pa.int64())], names=["item_id", "query_hash", "doc_id", "score"])

    hits = rows.unionByName(wanted).groupBy("block", "query_block").applyInArrow(answer, HITS)
    order = Window.partitionBy("item_id", "query_hash").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = hits.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k)
    return ranked.select("item_id", "rank", "doc_id", "score")


def _flat(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.asarray(column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column)


ORACLE_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
h AS (SELECT *, CAST(len(w) AS BIGINT) AS n FROM d WHERE len(w) > 0),
s AS (SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(n) AS BIGINT) AS words FROM h),
p AS (SELECT r, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT r, unnest(w) AS term FROM h) GROUP BY 1, 2),
f AS (SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * docs + 2) / (2.0::DOUBLE * count(*) + 1))) AS BIGINT) AS weight FROM p, s GROUP BY term, docs),
i AS (
  SELECT item_id, list_sort(list_distinct(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))) AS own FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
q AS (SELECT item_id, own, unnest(own) AS term FROM (SELECT DISTINCT item_id, own FROM i)),
x AS (
  SELECT item_id, own, r, any_value(doc_id) AS doc_id,
    CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + {DAMPING} * ({100 - LENGTH_PERCENT} + ({LENGTH_PERCENT} * n * docs) // words)))) AS BIGINT) AS score
  FROM q JOIN f USING (term) JOIN p USING (term) JOIN h USING (r), s GROUP BY 1, 2, 3),
k AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id, own ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank FROM x WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= {K}
"""
