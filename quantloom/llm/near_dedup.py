"""MinHash near-dedup with DartMinHash signatures: classes of near-equal documents.

Documents are sets of five-word shingles (with weight one, or weighted by how often they occur);
two are near copies at a Jaccard similarity of THRESHOLD or more. Classes are the connected
components of near copies.

Every element throws darts: a Poisson process over rank, hashed from the element alone, in each
dyadic slice of weight. Darts of a slice fall at a hashed weight, and those within the element's
weight count, so that two sets share the darts of what they share. Of the darts at each of
COORDINATES coordinates the one of least rank is kept. A set throws darts up to a rank at which
about COORDINATES * (ln COORDINATES + 2) of them land, whatever its size, and farther if a
coordinate is empty. Signatures agree at a coordinate with the probability of the weighted
Jaccard similarity. BANDS of ROWS coordinates make keys; documents with an equal key are candidates.

1. Exact copies collapse to one text each, by a 128-bit digest.
2. Candidates of a key are linked to one leader of the key, not pairwise; a link is verified on
   the whole shingle sets. Most members of a class are joined so.
3. Documents whose key still holds several components are compared across components, exactly, by
   prefix filtering (`prefix_links`), so that no link is lost to the choice of leaders; pairs
   within a component, the bulk of a hot group, are never made.

Texts are not shuffled. Tasks read them again and send on the shingle sets of those that a `BitFilter` of the
candidates lets pass; the join with the candidates themselves is exact, as it is for the filter of
shared keys. Filters have a bounded size and only spare work, so the plan is the same at every size.

Components come from hooking to the least neighbour and pointer jumping, on DataFrames cut by
stored tables; nothing of it is collected.

Defined cases: null text has no copies: its class is its own id, and of rows with one id and null text one stays; a row without
an id takes no part, has class null and stays; texts without five words are one
shingle of all their words, texts without any word are equal only to the same text; repeated rows
are copies; ties go to the smaller id; an empty table gives no rows; other columns are carried. An id
with several texts is a document for each: texts are told apart by digest, and class_text tells classes with one class_id apart.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.llm.common import BitFilter, sliced, stored

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 24, 4
COORDINATES = BANDS * ROWS
#: Documents whose signatures are computed in one go.
TOGETHER = 128
#: Numbers of documents with an element by which elements are ordered.
LEVELS = (2, 16, 256)

_U = np.uint64
_A, _B, _C = _U(0x9E3779B97F4A7C15), _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit changes every output bit with probability a half."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _B
        x = (x ^ (x >> _U(27))) * _C
        return x ^ (x >> _U(31))


def digest_of(text: bytes) -> bytes:
    return hashlib.sha256(text).digest()[:16]


def digest_column(text: str = "text") -> Column:
    """digest_of as a Column; null stays null."""
    return F.substring(F.unhex(F.sha2(F.col(text).cast("binary"), 256)), 1, 16)


def uniform(x: np.ndarray) -> np.ndarray:
    """Hashes to (0, 1]."""
    return ((x >> _U(11)).astype(np.float64) + 1.0) * 2.0**-53


def shingles(text: bytes, words: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 64-bit shingle hashes, sorted, and how often each occurs."""
    tokens = text.split()
    n = len(tokens)
    if not n:
        return np.array([mixed(np.array([zlib.crc32(text) + 1], _U))[0]]), np.ones(1)
    # Python's own hash differs between processes, so words are hashed by two checksums.
    ids = np.fromiter(map(zlib.crc32, tokens), _U, n) << _U(32) | np.fromiter(map(zlib.adler32, tokens), _U, n)
    m = max(1, n - words + 1)
    keys = np.full(m, n if n < words else 0, _U)
    with np.errstate(over="ignore"):
        for i in range(min(words, n)):
            keys = mixed(keys + _A + ids[i : i + m])
    elements, counts = np.unique(keys, return_counts=True)
    return elements, counts.astype(np.float64)


def signatures(sets: list[tuple[np.ndarray, np.ndarray]], coordinates: int = COORDINATES) -> np.ndarray:
    """DartMinHash: a row a set (elements, weights); for each coordinate the dart of least rank among the set's darts."""
    out = np.zeros((len(sets), coordinates), _U)
    limit = coordinates * (np.log(coordinates) + 2) / np.array([w.sum() for _, w in sets])
    todo = np.arange(len(sets))
    while len(todo):
        elements, weights = (np.concatenate([sets[i][k] for i in todo]) for k in (0, 1))
        owner = np.repeat(np.arange(len(todo)), [len(sets[i][0]) for i in todo])
        owner, rank, dart = _darts(owner, elements, weights, limit[todo])
        cell = owner * coordinates + (mixed(dart + _C) % _U(coordinates)).astype(np.int64)
        order = np.lexsort((dart, rank, cell))
        cell, dart = cell[order], dart[order]
        first = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
        out[todo[cell[first] // coordinates], cell[first] % coordinates] = dart[first]
        # A set with an empty coordinate throws on, twice as far.
        todo = todo[np.bincount(cell[first] // coordinates, minlength=len(todo)) < coordinates]
        limit[todo] *= 2
    return out


def _darts(owner: np.ndarray, elements: np.ndarray, weights: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owner, rank and name of all darts up to the owner's limit that land within the weights.

    Weight slice 0 is [0, 1), slice s is [2 ** (s - 1), 2 ** s). In a slice of width d darts come at
    exponential gaps of mean 1 / d in rank, each at a hashed weight within the slice.
    """
    found: list[tuple] = []
    low, width, number = 0.0, 1.0, 0
    while True:
        inside = np.flatnonzero(weights > low)
        if not len(inside):
            break
        with np.errstate(over="ignore"):
            state = mixed(elements[inside] ^ mixed(np.full(1, number + 1, _U) * _A))
        who, weight, rank = owner[inside], weights[inside], np.zeros(len(inside))
        most = limit[who]
        while len(state):
            with np.errstate(over="ignore"):
                state = mixed(state + _A)
            rank = rank - np.log(uniform(state)) / width
            near = rank <= most
            state, who, weight, rank, most = state[near], who[near], weight[near], rank[near], most[near]
            lands = low + width * uniform(mixed(state ^ _B)) <= weight if low or (weight < 1).any() else slice(None)
            found.append((who[lands], rank[lands], state[lands]))
        low, width, number = low + width, max(1.0, low + width), number + 1
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def band_keys(signed_: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """A row a signature, a key a band."""
    with np.errstate(over="ignore"):
        keys = np.broadcast_to(np.arange(bands, dtype=_U) * _A, (len(signed_), bands))
        for k in range(rows):
            keys = mixed(keys + _A ^ signed_[:, k::rows])
    return keys.view(np.int64)


def _weights(counts: np.ndarray, by_count: bool) -> np.ndarray:
    return counts if by_count else np.ones(len(counts))


def _mark(id_: int, digest: bytes) -> int:
    """A hash of a document's id and text."""
    return (int.from_bytes(digest[:8], "little") ^ id_ * 0x9E3779B97F4A7C15) % (1 << 64) - (1 << 63)


def signed(docs: DataFrame, by_count: bool = False) -> DataFrame:
    """id, digest (of the text), mark (of both), keys (of its bands) of every row of (doc_id, text) that has both."""

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches, TOGETHER):
            texts = part["text"].to_pylist()
            sets = [(elements, _weights(counts, by_count)) for elements, counts in map(shingles, texts)]
            digests = [digest_of(t) for t in texts]
            marks = list(map(_mark, part["id"].to_pylist(), digests))
            keys = list(band_keys(signatures(sets)))
            columns = [part["id"], pa.array(digests, pa.binary()), pa.array(marks, pa.int64()), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["id", "digest", "mark", "keys"])

    return _texts(docs).mapInArrow(per_batch, "id long, digest binary, mark long, keys array<long>")


def _texts(docs: DataFrame) -> DataFrame:
    known = docs.where("doc_id is not null and text is not null")
    return known.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("binary").alias("text"))


def shingle_sets(docs: DataFrame, wanted: DataFrame, by_count: bool = False) -> DataFrame:
    """id, elements (sorted hashes) of the wanted (id, doc, digest, mark); with by_count an element for each occurrence."""
    some = BitFilter(wanted, "mark")

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches, TOGETHER):
            ids, texts = part["id"].to_pylist(), part["text"].to_pylist()
            digests = [digest_of(t) for t in texts]
            passes = np.flatnonzero(some.holds(np.fromiter(map(_mark, ids, digests), np.int64, len(ids)))).tolist()
            sets = []
            for i in passes:
                elements, counts = shingles(texts[i])
                if by_count:
                    nth = np.concatenate([np.arange(c) for c in counts.astype(int)]).astype(_U)
                    elements = np.unique(mixed(np.repeat(elements, counts.astype(int)) + nth * _A))
                sets.append(np.sort(elements.view(np.int64)))
            columns = [pa.array([ids[i] for i in passes], pa.int64()), pa.array([digests[i] for i in passes], pa.binary()), pa.array(sets, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc", "digest", "elements"])

    found = _texts(docs).mapInArrow(per_batch, "doc long, digest binary, elements array<long>")
    # Repeated rows give one set.
    return found.groupBy("doc", "digest").agg(F.first("elements").alias("elements")).join(wanted, ["doc", "digest"]).select("id", "elements")


def similarities(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs (a, b, ...) with similarity, verified on the whole sets."""
    of_a = pairs.join(sets.select(F.col("id").alias("a"), F.col("elements").alias("x")), "a")
    both = of_a.join(sets.select(F.col("id").alias("b"), F.col("elements").alias("y")), "b")
    shared = F.size(F.array_intersect("x", "y"))
    return both.withColumn("similarity", shared / (F.size("x") + F.size("y") - shared)).drop("x", "y")


def components(edges: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """id, label (the least id of its component) for every end of the edges (a, b).

    labels, if given, are components found before, to go on from. Each round hooks every label
    to the least label next to it and then lets labels point to their label's label.
    """
    ends = edges.select(F.col("a").alias("id")).union(edges.select("b")).distinct()
    state = ends.withColumn("label", F.col("id"))
    if labels is not None:
        state = state.select("id").join(labels.select("id", "label"), "id", "full_outer").select("id", F.coalesce("label", "id").alias("label"))
    state = stored(state, "near-labels")
    while True:
        # Edges between labels: contracted, so that a hot component is one node from then on.
        of_a = edges.join(state.select(F.col("id").alias("a"), F.col("label").alias("p")), "a")
        between = of_a.join(state.select(F.col("id").alias("b"), F.col("label").alias("q")), "b").where("p <> q")
        hooks = between.select(F.greatest("p", "q").alias("p"), F.least("p", "q").alias("q")).groupBy("p").agg(F.min("q").alias("q"))
        hooks = stored(hooks, "near-hooks")
        if hooks.isEmpty():
            return state
        while True:  # chains of hooks, halved until each points to its end
            jump = hooks.alias("h").join(hooks.select(F.col("p").alias("mid"), F.col("q").alias("end")), F.col("q") == F.col("mid"), "left")
            jump = stored(jump.select("p", F.coalesce("end", "q").alias("q"), F.col("end").isNotNull().alias("moved")), "near-hooks")
            hooks = jump.select("p", "q")
            if jump.where("moved").isEmpty():
                break
        moved = state.join(hooks, F.col("label") == F.col("p"), "left")
        state = stored(moved.select("id", F.coalesce("q", "label").alias("label")), "near-labels")


def near_classes(docs: DataFrame, texts: DataFrame, owned: DataFrame, threshold: float = THRESHOLD, by_count: bool = False) -> DataFrame:
    """id, label of the documents that are near copies of another.

    texts: (id, doc, digest, mark), all different; doc is the doc_id. owned: (id, keys), repeats allowed.
    """
    keys = owned.select("id", F.explode("keys").alias("key"))
    shared = keys.groupBy("key").agg(F.min("id").alias("leader"), F.max("id").alias("most")).where("leader <> most").select("key", "leader")
    shared = stored(shared, "near-leaders")
    held = stored(keys.where(BitFilter(shared, "key").column(F.col("key"))).join(shared, "key").select("key", "id", "leader"), "near-held")
    wanted = stored(texts.join(held.select("id").distinct(), "id"), "near-wanted")
    sets = stored(shingle_sets(docs, wanted, by_count), "near-sets")

    pairs = held.where("id <> leader").select(F.col("id").alias("a"), F.col("leader").alias("b")).distinct()
    compared = stored(similarities(pairs, sets), "near-compared")
    labels = components(compared.where(F.col("similarity") >= threshold).select("a", "b"))

    # Documents of keys whose documents are still in several components.
    labelled = held.join(labels, "id", "left").select("key", "id", F.coalesce("label", "id").alias("label"))
    split = labelled.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("key")
    left = stored(labelled.join(stored(split, "near-split"), "key", "left_semi").select("id", "label").distinct(), "near-left")
    links = prefix_links(left, sets, compared.select("a", "b"), threshold)
    return components(links, labels)


def prefix_links(left: DataFrame, sets: DataFrame, known: DataFrame, threshold: float) -> DataFrame:
    """Near copies (a, b) among left (id, label) with different labels, exactly, by prefix filtering.

    In any one order of all elements, sets of similarity t or more share one of the first n - ceil(t * n) + 1 elements of the
    larger, which are looked up, that is one of the first n - ceil(2t / (1 + t) * n) + 1 of the smaller, which are
    indexed; and the smaller has t times the size of the larger at least. At the first
    element that they share, at places i and j, what can still be shared is 1 + min(m - i, n - j), and
    t / (1 + t) of the sum of sizes is needed. The order is by how many of the LEVELS of holders (documents
    with it) an element reaches, then by hash: so documents that share a common passage and
    less than t besides do not meet: the passage comes last, and what is indexed ends before it. Levels come from filters; an element that one lets pass wrongly has
    the same place for all documents, so that no link depends on it.

    Sizes are in classes, each 1 / t times as large as the one before, and only equal or next ones meet. Of an element's holders those with its most frequent
    label are not paired with each other, so that the pairs made are at most twice those of different labels.
    """
    held = left.join(sets, "id").select("id", "label", "elements")
    counts = stored(held.select(F.explode("elements").alias("element")).groupBy("element").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "near-counts")
    levels = [BitFilter(counts.where(F.col("n") >= least), "element") for least in LEVELS]

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches, TOGETHER):
            elements, sizes = np.asarray(part["elements"].flatten()), np.asarray(part["elements"].value_lengths()).astype(np.int64)
            level = sum(f.holds(elements).astype(np.int8) for f in levels)
            order = np.lexsort((elements, level, np.repeat(np.arange(len(sizes)), sizes)))
            place = np.arange(len(order)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + 1
            n = np.repeat(sizes, sizes)
            taken = np.flatnonzero((place <= n - np.ceil(threshold * n - 1e-9) + 1) & (level[order] > 0))  # level 0: no other document has it
            of, m = np.repeat(np.arange(len(sizes)), sizes)[taken], n[taken]
            indexed = place[taken] <= m - np.ceil(2 * threshold / (1 + threshold) * m - 1e-9) + 1
            columns = [pa.array(elements[order[taken]]), part["id"].take(pa.array(of)), part["label"].take(pa.array(of)), pa.array(m.astype(np.int32)), pa.array(place[taken].astype(np.int32)), pa.array(indexed)]
            yield pa.RecordBatch.from_arrays(columns, ["element", "id", "label", "n", "place", "indexed"])

    prefix = stored(held.mapInArrow(prefixes, "element long, id long, label long, n int, place int, indexed boolean"), "near-prefix")
    by_label = prefix.groupBy("element", "label").agg(F.count(F.lit(1)).alias("held"), F.max("indexed").alias("indexed"))
    several = by_label.groupBy("element").agg(F.max_by("label", F.struct("held", "label")).alias("most"), F.count(F.lit(1)).alias("labels"), F.max("indexed").alias("indexed"))
    open_ = prefix.join(stored(several.where("labels > 1 and indexed").select("element", "most"), "near-several"), "element")
    # A set that is t times as large at least is in the same class or the one below.
    size_class = F.floor(F.log(F.col("n").cast("double")) / math.log(1 / threshold) + 1e-9).cast("int") if threshold < 1 else F.col("n")
    classed = open_.withColumn("class", size_class)
    below = F.array("class", F.col("class") - 1) if threshold < 1 else F.array("class")
    a = classed.select("element", F.explode(below).alias("class"), "most", F.col("id").alias("a"), F.col("label").alias("p"), F.col("n").alias("m"), F.col("place").alias("i"))
    b = classed.where("indexed").select("element", "class", F.col("id").alias("b"), F.col("label").alias("q"), "n", F.col("place").alias("j"), F.col("most").alias("main"))
    like = (F.col("m") >= F.col("n")) & (F.col("n") >= threshold * F.col("m") - 1e-9)
    enough = 1 + F.least(F.col("m") - F.col("i"), F.col("n") - F.col("j")) >= threshold / (1 + threshold) * (F.col("m") + F.col("n")) - 1e-9
    found = []
    for looked, index in ((a.where("p <> most"), b), (a.where("p = most"), b.where("q <> main"))):
        met = looked.join(index.drop("main"), ["element", "class"]).where((F.col("p") != F.col("q")) & like & enough)
        found.append(met.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
    pairs = found[0].union(found[1]).distinct()
    either = known.union(known.select("b", "a"))
    fresh = stored(pairs.join(either, ["a", "b"], "left_anti"), "near-more")
    return stored(similarities(fresh, sets).where(F.col("similarity") >= threshold).select("a", "b"), "near-links")


def near_groups(docs: DataFrame, threshold: float = THRESHOLD, by_count: bool = False) -> DataFrame:
    """doc_id, class_id (the least doc_id of its class), text_id (the least doc_id with the same text), text_digest, class_text.

    class_text is the digest of the class's first text: that of class_id, the least of its texts in the class.
    """
    signatures = stored(signed(docs, by_count), "near-signatures")
    firsts = signatures.groupBy("digest").agg(F.min("id").alias("text_id"), F.min_by("mark", "id").alias("mark"))
    # One number for each text, in order of ids.
    texts = stored(firsts.orderBy("text_id", "digest").withColumn("number", F.monotonically_increasing_id()), "near-texts")
    owned = stored(signatures.join(texts.select("number", "mark"), "mark").select(F.col("number").alias("id"), "keys"), "near-keys")
    own = texts.select(F.col("number").alias("id"), F.col("text_id").alias("doc"), "digest", "mark")
    labels = near_classes(docs, own, owned, threshold, by_count).withColumnRenamed("id", "own")
    first = texts.select(F.col("number").alias("label"), F.col("text_id").alias("class_id"), F.col("digest").alias("class_text"))
    member = signatures.select("id", "digest").join(texts.drop("mark"), "digest")
    classed = member.join(labels.join(first, "label"), F.col("number") == F.col("own"), "left").select(
        F.col("id").alias("doc_id"), F.coalesce("class_id", "text_id").alias("class_id"), "text_id",
        F.col("digest").alias("text_digest"), F.coalesce("class_text", "digest").alias("class_text"),
    )
    id_, none = F.col("doc_id").cast("long"), F.lit(None).cast("binary")
    rest = docs.where("text is null or doc_id is null")
    return classed.unionByName(rest.select(id_.alias("doc_id"), id_.alias("class_id"), id_.alias("text_id"), none.alias("text_digest"), none.alias("class_text")))


def first_of_each(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents, with their columns, that are the first of their class; rows of one id and text leave one."""
    first = near_groups(docs, threshold).where("doc_id = class_id and text_digest = class_text")
    stay = first.select(F.col("doc_id").alias("__first"), F.col("text_digest").alias("__text")).distinct()
    order = F.row_number().over(Window.partitionBy("doc_id", "__digest").orderBy("text"))
    keyed = docs.withColumn("__digest", digest_column())
    named = keyed.join(stay, (F.col("doc_id") == F.col("__first")) & (F.col("__digest") == F.col("__text")), "left_semi")
    empty = keyed.where("doc_id is not null and text is null")
    kept = [df.withColumn("__nth", order).where("__nth = 1").drop("__nth", "__digest") for df in (named, empty)]
    return kept[0].unionByName(kept[1]).unionByName(docs.where("doc_id is null"))
