"""Language-model scoring: a hashed maximum-entropy model with a class-factored softmax.

P(word | context) = P(class | context) * P(slot | class, context) * P(word | class, slot).

Classes are of words that go together. Documents are dealt to CLUSTERS clusters by what words they
have (centres of the hashed word profiles of all training documents, by k-means with sums of whole numbers, so
that they are the same however rows are dealt), and words are counted by cluster over all training documents; one of the HEAD most frequent words belongs to the cluster that it is most typical of, and to one of
the cluster's classes by its ending. So a context tells apart the words of any rank, as far as they differ in kind. Rarer
words have a class by a hash of their ending. The most frequent words of a class
have a slot each; all others of the class share slot 0 and are told apart by their training
counts, with half a count for words that were never seen. The two softmaxes are maximum-entropy
models whose features are hashed: the word before (bigram), the word before that and the third
before (skips), the two before together (trigram), and a bias; a row of weights for each bucket.
Buckets follow the counted training tokens: BUCKETS up to TOKENS of them, twice as many for
each four times as many tokens, and MOST_BUCKETS from 256 * TOKENS on, so that a task's memory has a bound.

Training: counts of all words come first, by a distributed count. Then in each round every task
starts from the weights so far, takes gradient steps (Adagrad, sparse, in batches) over its
share of that round's training documents, and sends how its weights have changed; changes are
averaged, by the tokens that each has seen, in a tree of small groups. All training documents are used, each in one round.
A task has at least about TASK_TOKENS tokens, and more with a larger model, so that what tasks send stays a share of what they
read; partitions are put together for that. Means of many tasks learn less than
one task would, so rounds follow the tokens: ROUNDS up to ROUND_TASKS tasks, one more each time that the tasks double. Weights depend a little on how the table's rows are
dealt to tasks and in what order they come: the sum of scores by less than SPREAD between tables of 1 and 16 partitions (a test holds it to
that); counts and base scores do not.

Scoring: tasks score documents in numpy batches with the HEAD most frequent words at hand, and
leave the rarer words of a document to a join with the table of counts, so that nothing that grows
with the corpus is broadcast but the weights, up to their bound; the head and the classes have fixed sizes.

Defined cases: null text is an empty text, one end token; a null doc_id is training data and not
held out; long texts are scored whole, block by block; repeated rows are scored each; with no
training document every word is unseen; an empty table gives no rows; other columns are not
looked at. Equal counts are ordered by word.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.llm.common import crc_mod, sliced, stored

CLUSTERS, KINDS, SLOTS, HEAD = 16, 2, 32, 1 << 17
CLASSES = CLUSTERS * KINDS
#: Numbers of a profile, what stands for 1 in them, and levels of the distance between two.
PROFILE, UNIT, LEVELS = 128, 1 << 14, 1024
#: Profiles in a stored row, and rows that are read in one go.
ROW_PROFILES, ROWS_READ = 32, 64
#: Rows of weights in each softmax: the least, the most, and the training tokens up to which the least do.
BUCKETS, MOST_BUCKETS, TOKENS = 1 << 14, 1 << 18, 1 << 24
BATCH, RATE = 16_384, 0.15
#: Rounds at least, and the tasks up to which they do.
ROUNDS, ROUND_TASKS = 2, 8
#: Mean square that a row of weights begins with: a feature seen once moves little.
PRIOR = 0.1
#: Training tokens of a task at least, about, with BUCKETS (the more buckets, the more tokens); share by which the sum of scores may differ with how rows are stored.
TASK_TOKENS, SPREAD = 1 << 19, 0.02
#: Documents taken together, and tokens scored in one go.
TOGETHER, BLOCK = 512, 4096
#: Rows of logits that are worked on in one go: so many stay in a core's cache.
CACHED = 2048
#: Documents whose words are counted in one go.
COUNTED = 4096
#: Rows of weights in one block of a change, and blocks that one group sums at most.
BLOCK_ROWS, FAN_IN = 512, 32
#: The end of a document; no word has white space.
END = "\n"
_MARKS = ".,;:!?)\"'"
_START = HEAD + (1 << 16)


def _crc_table() -> np.ndarray:
    """What crc32 adds for each value of a byte: eight steps of division by its polynomial."""
    x = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        x = (x >> np.uint32(1)) ^ (x & np.uint32(1)) * np.uint32(0xEDB88320)
    return x


_CRC = _crc_table()


def held_out() -> Column:
    return F.coalesce(crc_mod("doc_id", 5) == 1, F.lit(False))


def class_of(word: str) -> int:
    return zlib.crc32((word.rstrip(_MARKS) or word)[-2:].encode()) % CLASSES


def classes_of(words: pa.Array) -> np.ndarray:
    """class_of of every word."""
    bare = pc.utf8_rtrim(words, characters=_MARKS)
    return (crc32s(pc.utf8_slice_codeunits(pc.if_else(pc.equal(bare, ""), words, bare), -2)) % CLASSES).astype(np.int64)


def crc32s(words: pa.Array, long: int = 48) -> np.ndarray:
    """crc32 of the bytes of every word (no nulls): byte by byte for all words at once, words over `long` bytes each by itself."""
    offsets, data = words.buffers()[1:3]
    wide = np.int64 if pa.types.is_large_string(words.type) else np.int32
    at = np.frombuffer(offsets, wide)[words.offset : words.offset + len(words) + 1].astype(np.int64) if len(words) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    sizes = np.diff(at)
    out = np.full(len(sizes), 0xFFFFFFFF, np.uint32)
    left = np.flatnonzero((sizes > 0) & (sizes <= long))
    left = left[np.argsort(-sizes[left], kind="stable")]  # the longest first, so that those with bytes left are the first ones
    states, starts = out[left], at[left]
    having = np.searchsorted(-sizes[left], -np.arange(1, long + 2), side="right")  # words of at least so many bytes
    for k in range(long):
        some = int(having[k])
        if not some:
            break
        states[:some] = _CRC[(states[:some] ^ raw[starts[:some] + k]) & 0xFF] ^ (states[:some] >> np.uint32(8))
    out[left] = states
    out ^= np.uint32(0xFFFFFFFF)
    for i in np.flatnonzero(sizes > long).tolist():
        out[i] = zlib.crc32(raw[at[i] : at[i + 1]])
    return out


def numbered(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words of texts (null: empty) with the end, the number of every token, and each text's tokens.

    Words are lower-cased (A to Z) runs between ASCII white space, and every text ends with the end.
    """
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts.fill_null("")))
    offsets = np.asarray(split.offsets).astype(np.int64)
    found = split.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
    words, which = found.dictionary, np.asarray(found.indices)
    sizes = np.diff(offsets)
    nothing = pc.index(words, "").as_py()
    if nothing >= 0:  # what stands before or behind the outermost white space
        real = which != nothing
        sizes = np.diff(np.concatenate([[0], np.cumsum(real)])[offsets - offsets[0]])
        which = which[real]
    ends = np.cumsum(sizes + 1) - 1
    out = np.full(len(which) + len(sizes), len(words), np.int64)
    inner = np.ones(len(out), bool)
    inner[ends] = False
    out[inner] = which
    return pa.concat_arrays([words, pa.array([END], words.type)]), out, sizes + 1


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held_out().alias("held_out"))


def profiles(words: pa.Array, which: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A row a text: square roots of the shares of its tokens by a hash of the word, in whole UNITs."""
    bucket = (crc32s(words) % PROFILE).astype(np.int64)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    counts = np.bincount(owner * PROFILE + bucket[which], minlength=len(sizes) * PROFILE).reshape(len(sizes), PROFILE)
    return np.rint(np.sqrt(counts / np.maximum(sizes, 1)[:, None]) * UNIT)


def nearest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The first of the nearest centres of every row; exact, since both are whole numbers."""
    return (rows @ centres.T - (centres**2).sum(1) / 2).argmax(1)


def cluster_sums(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Sums of the rows of each centre; the last column counts them."""
    mine = np.zeros((len(centres), len(rows)))
    mine[nearest(rows, centres), np.arange(len(rows))] = 1
    return (mine @ np.column_stack([rows, np.ones(len(rows))])).astype(np.int64)


def levels(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """How far every row is from the nearest centre, by the square."""
    square = (rows**2).sum(1) - 2 * (rows @ centres.T - (centres**2).sum(1) / 2).max(1)
    return (square * LEVELS / (2 * UNIT**2)).astype(np.int64)


def fit_centroids(docs: DataFrame, k: int = CLUSTERS, rounds: int = 25) -> np.ndarray:
    """k centres of the profiles of all docs by k-means; each begins at a profile that is far from the ones before.

    Tasks send sums for each centre, or a count and a profile for each level of distance, so what comes to the driver has a bound.
    """

    def profiled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, TOGETHER):
            found = profiles(*numbered(batch["text"])).astype("<u2")
            rows = [found[at : at + ROW_PROFILES].tobytes() for at in range(0, len(found), ROW_PROFILES)]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], ["profiles"])

    stored_rows = stored(docs.select("text").mapInArrow(profiled, "profiles binary"), "lm-profiles")

    def numbers(profile: bytes) -> np.ndarray:
        return np.frombuffer(profile, "<u2").reshape(-1, PROFILE).astype(np.float64)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[bytes]:
        for batch in sliced(batches, ROWS_READ):
            yield b"".join(batch["profiles"].to_pylist())

    def means(centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rounded means of the rows of each centre (of none: the centre), and how many rows they have."""

        def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((len(centres), PROFILE + 1), np.int64)
            for some in read(batches):
                total += cluster_sums(numbers(some), centres)
            place = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(total.reshape(-1)[place])], ["place", "s"])

        total = np.zeros((len(centres), PROFILE + 1))
        for r in stored_rows.mapInArrow(summed, "place long, s long").groupBy("place").agg(F.sum("s").alias("s")).collect():
            total[divmod(r["place"], PROFILE + 1)] = r["s"]
        n = total[:, -1]
        return np.where(n[:, None] > 0, np.rint(total[:, :-1] / np.maximum(n, 1)[:, None]), centres), n

    def far(centres: np.ndarray, skipped: int) -> np.ndarray:
        """The first profile of the level of distance that is reached after so many profiles from the farthest on."""

        def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n: dict[int, int] = {}
            first: dict[int, bytes] = {}
            for some in read(batches):
                for k, level in enumerate(levels(numbers(some), centres).tolist()):
                    p = some[2 * PROFILE * k : 2 * PROFILE * (k + 1)]
                    n[level] = n.get(level, 0) + 1
                    if level not in first or p < first[level]:
                        first[level] = p
            yield pa.RecordBatch.from_arrays([pa.array(n.keys(), pa.int64()), pa.array(n.values(), pa.int64()), pa.array(first.values(), pa.binary())], ["level", "n", "profile"])

        found = stored_rows.mapInArrow(seen, "level long, n long, profile binary").groupBy("level").agg(F.sum("n").alias("n"), F.min("profile").alias("profile"))
        for r in sorted(found.collect(), key=lambda r: -r["level"]):
            skipped -= r["n"]
            if skipped < 0:
                break
        return numbers(r["profile"])

    centres, n = means(np.zeros((1, PROFILE)))
    if not n[0]:
        return np.zeros((k, PROFILE))
    for _ in range(k):
        centres = np.concatenate([centres, far(centres, int(n[0]) // 50)])  # not the oddest of all
    centres = centres[1:]
    for _ in range(rounds):
        before, (centres, _) = centres, means(centres)
        if (centres == before).all():
            break
    return centres


def count_words(docs: DataFrame, centres: np.ndarray) -> DataFrame:
    """word, class (by its ending), cluster, c of every word of docs in every cluster that has it; a task sends a word once for many documents."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, COUNTED):
            words, which, sizes = numbered(batch["text"])
            cluster = nearest(profiles(words, which, sizes), centres)
            c = np.bincount(np.repeat(cluster, sizes) * len(words) + which, minlength=len(words) * CLUSTERS)
            some = np.flatnonzero(c)
            place, classes = some % len(words), classes_of(words).astype(np.int32)
            yield pa.RecordBatch.from_arrays([words.take(pa.array(place)), pa.array(classes[place]), pa.array((some // len(words)).astype(np.int32)), pa.array(c[some])], ["word", "class", "cluster", "c"])

    sent = _texts(docs).select("text").mapInArrow(counted, "word string, class int, cluster int, c long")
    return sent.groupBy("word", "class", "cluster").agg(F.sum("c").alias("c"))


def with_clusters(head: DataFrame, by_cluster: DataFrame) -> DataFrame:
    """head (word, class, c; HEAD words at most, so it is broadcast) with by, the counts in each cluster."""
    by = F.array(*[F.sum(F.when(F.col("cluster") == k, F.col("n")).otherwise(0)) for k in range(CLUSTERS)])
    found = by_cluster.select("word", "cluster", F.col("c").alias("n")).join(F.broadcast(head), "word")
    return found.groupBy("word", "class", "c").agg(by.alias("by"))


@dataclass
class Model:
    """Fixed-size parts of the model; words, slots and log probabilities are of the head."""

    words: list[str]
    word_class: np.ndarray
    slot: np.ndarray
    base: np.ndarray  # log10 of the unigram probability
    within: np.ndarray  # log10 P(word | class, slot)
    class_weights: np.ndarray
    slot_weights: np.ndarray
    _head: list[pa.Array] = field(default_factory=list, repr=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_head": []}

    def rank(self, words: pa.Array) -> np.ndarray:
        """Places in the head, -1 for other words."""
        if not self._head:
            self._head.append(pa.array(self.words, words.type))
        return np.asarray(pc.index_in(words, value_set=self._head[0]).fill_null(-1)).astype(np.int64)


def buckets_for(train_tokens: int) -> int:
    """Buckets of each softmax: twice as many for each four times as many training tokens."""
    buckets, enough = BUCKETS, TOKENS
    while train_tokens > enough and buckets < MOST_BUCKETS:
        buckets, enough = 2 * buckets, 4 * enough
    return buckets


def task_tokens(train_tokens: int) -> int:
    """Tokens of a task: as many for each bucket at every size, for each task sends all buckets."""
    return TASK_TOKENS * buckets_for(train_tokens) // BUCKETS


def rounds_for(train_tokens: int) -> int:
    """Rounds of training: one more each time that the tasks of all rounds double."""
    tasks = -(-train_tokens // task_tokens(train_tokens))
    return ROUNDS + max(0, -(-tasks // ROUND_TASKS) - 1).bit_length()


def _mixed(start: np.ndarray | int, part: np.ndarray) -> np.ndarray:
    """A hash so far (or a kind of feature) with one more part."""
    with np.errstate(over="ignore"):
        x = (start ^ part) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _kind(number: int) -> np.uint64:
    return np.uint64(number * 0x9E3779B97F4A7C15 & (1 << 64) - 1)


def _bucket(buckets: int, x: np.ndarray) -> np.ndarray:
    """Buckets 1 to buckets - 1 of hashes; 0 is the bias."""
    with np.errstate(over="ignore"):
        x = ((x * np.uint64(0x94D049BB133111EB)) >> np.uint64(40)).astype(np.uint32)
    kept = np.uint16 if buckets <= 1 << 16 else np.uint32
    m = np.uint32(buckets - 1)
    return (x - x // m * m + np.uint32(1)).astype(kept)


def _order(features: np.ndarray) -> np.ndarray:
    """Places in order of features: radix sorts of 16-bit numbers."""
    order = np.argsort(features.astype(np.uint16), kind="stable")
    if features.dtype == np.uint16:
        return order
    return order[np.argsort((features >> 16).astype(np.uint16)[order], kind="stable")]


class Space:
    """Rows of numbers to write results in, held to be used again: the system hands out large arrays anew and zeroed each time, which takes longer than to fill them."""

    def __init__(self) -> None:
        self._held: dict[str, np.ndarray] = {}

    def rows(self, name: str, n: int, like: np.ndarray) -> np.ndarray:
        """n rows as wide as those of `like`; what was written under that name is lost."""
        held = self._held.get(name)
        if held is None or len(held) < n or held.shape[1] != like.shape[1] or held.dtype != like.dtype:
            held = self._held[name] = np.empty((n, like.shape[1]), like.dtype)
        return held[:n]

    def taken(self, name: str, rows: np.ndarray, at: np.ndarray) -> np.ndarray:
        """rows[at]; places are known to be in range."""
        return np.take(rows, at, axis=0, out=self.rows(name, len(at), rows), mode="clip")


def run_sums(rows: np.ndarray, starts: np.ndarray, short: int = 8, order: np.ndarray | None = None, space: Space | None = None) -> np.ndarray:
    """Sums of the runs of rows, taken in that order, that begin at starts: of short runs row by row for all at once, of each long one as a product."""
    order, space = np.arange(len(rows)) if order is None else order, space or Space()
    sizes = np.diff(np.append(starts, len(order)))
    out = space.taken("sums", rows, order[starts])
    left = np.flatnonzero((sizes > 1) & (sizes <= short))
    for k in range(1, short):
        if not len(left):
            break
        some = space.taken("some", out, left)
        some += space.taken("more", rows, order[starts[left] + k])
        out[left] = some
        left = left[sizes[left] > k + 1]
    long = sizes > short
    ones, held = np.ones(sizes.max(initial=0), rows.dtype), space.taken("more", rows, order[np.repeat(long, sizes)])
    at = 0
    for i, n in zip(np.flatnonzero(long).tolist(), sizes[long].tolist(), strict=True):
        out[i] = ones[:n] @ held[at : at + n]
        at += n
    return out


@dataclass
class Tokens:
    """Tokens of several documents in a row: what the softmaxes are asked, and from what."""

    words: pa.Array
    of_class: np.ndarray  # of each of the words
    which: np.ndarray  # place in words
    sizes: np.ndarray  # tokens of each document
    target_class: np.ndarray
    target_slot: np.ndarray
    rank: np.ndarray
    class_features: list[np.ndarray]
    slot_features: list[np.ndarray]


def tokens(model: Model, texts: pa.Array) -> Tokens:
    words, which, sizes = numbered(texts)
    rank = model.rank(words)
    known, other = rank >= 0, np.flatnonzero(rank < 0)
    ids, of_class, slot = rank.copy(), np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
    if len(model.words):
        of_class[known], slot[known] = model.word_class[rank[known]], model.slot[rank[known]]
    rare = words.take(pa.array(other))
    of_class[other], ids[other] = classes_of(rare), HEAD + (crc32s(rare) & 0xFFFF).astype(np.int64)
    # Hashes of one word are computed once for each of the words; the last one stands before a document.
    ids = np.append(ids, _START).astype(np.uint64)
    nth = np.arange(len(which)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    before = []
    for back in (1, 2, 3):
        shifted = np.full(len(which), len(words), np.int32)
        shifted[back:] = which[:-back]
        shifted[nth < back] = len(words)
        before.append(shifted)
    a, b, c = before
    k = of_class[which]
    own = (k + 1).astype(np.uint16)  # the slot table's rows 1 to CLASSES are the classes' biases
    m, kinds = len(model.class_weights), np.arange(CLASSES, dtype=np.uint64)
    id_a, id_b = ids[a], ids[b]

    def alone(kind: int, place: np.ndarray) -> np.ndarray:
        return _bucket(m, _mixed(_kind(kind), ids))[place]

    class_features = [alone(1, a), alone(2, b), _bucket(m, _mixed(_mixed(_kind(3), ids)[a], id_b)), alone(4, c)]
    slot_features = [own, *(_bucket(m, _mixed(_mixed(_kind(kind), kinds)[k], i)) for kind, i in ((11, id_a), (12, id_b)))]
    return Tokens(words, of_class, which, sizes, k, slot[which], rank[which], class_features, slot_features)


def _exponentials(weights: np.ndarray, features: list[np.ndarray], bias: bool, space: Space) -> np.ndarray:
    """exp of the sums of weights: probabilities, times what a row of them adds up to."""
    out = space.rows("logits", len(features[0]), weights)
    for at in range(0, len(out), CACHED):
        logits = out[at : at + CACHED]
        np.take(weights, features[0][at : at + CACHED], axis=0, out=logits, mode="clip")
        for f in features[1:]:
            logits += space.taken("part", weights, f[at : at + CACHED])
        if bias:
            logits += weights[0]
        np.clip(logits, -40, 40, out=logits)
        np.exp(logits, out=logits)
    return out


def _probabilities(weights: np.ndarray, features: list[np.ndarray], bias: bool, space: Space | None = None) -> np.ndarray:
    found = _exponentials(weights, features, bias, space or Space())
    found *= 1 / (found @ np.ones(found.shape[1], np.float32))[:, None]
    return found


def score_tokens(model: Model, t: Tokens, space: Space | None = None) -> np.ndarray:
    """log10 of P(class) * P(slot), and of P(word | class, slot) for words of the head."""
    space = space or Space()

    def of_target(weights: np.ndarray, features: list[np.ndarray], target: np.ndarray, bias: bool) -> np.ndarray:
        found = _exponentials(weights, features, bias, space)
        p = found[np.arange(len(found)), target] / (found @ np.ones(found.shape[1], np.float32))
        return np.maximum(p.astype(np.float64), 1e-30)

    out = np.empty(len(t.rank))
    for at in range(0, len(out), BLOCK):
        part = slice(at, at + BLOCK)
        p = of_target(model.class_weights, [f[part] for f in t.class_features], t.target_class[part], True)
        q = of_target(model.slot_weights, [f[part] for f in t.slot_features], t.target_slot[part], False)
        out[part] = np.log10(p * q)
    known = t.rank >= 0
    if len(model.words):
        out[known] += model.within[t.rank[known]]
    return out


class Learner:
    """Gradient steps from a model's weights; changes are what it has learnt."""

    def __init__(self, model: Model):
        self.tables = [model.class_weights.copy(), model.slot_weights.copy()]
        self.start = [model.class_weights, model.slot_weights]
        self.squares = [np.full(len(w), PRIOR, np.float32) for w in self.tables]
        self.space = Space()

    def learn(self, t: Tokens, batch: int = BATCH) -> None:
        for at in range(0, len(t.rank), batch):
            part = slice(at, at + batch)
            self._step(0, [f[part] for f in t.class_features], t.target_class[part], True)
            self._step(1, [f[part] for f in t.slot_features], t.target_slot[part], False)

    def _step(self, which: int, features: list[np.ndarray], target: np.ndarray, bias: bool) -> None:
        weights, squares = self.tables[which], self.squares[which]
        error = _probabilities(weights, features, bias, self.space)
        error[np.arange(len(target)), target] -= 1
        if bias:
            self._move(weights, squares, np.zeros(1, np.int64), error.sum(0, keepdims=True))
        for f in features:
            order = _order(f)
            in_order = f[order]
            starts = np.flatnonzero(np.concatenate([[True], in_order[1:] != in_order[:-1]]))
            self._move(weights, squares, in_order[starts].astype(np.int64), run_sums(error, starts, order=order, space=self.space))

    def _move(self, weights: np.ndarray, squares: np.ndarray, rows: np.ndarray, gradient: np.ndarray) -> None:
        seen = squares[rows] + np.einsum("ij,ij->i", gradient, gradient) / np.float32(gradient.shape[1])
        squares[rows] = seen
        gradient *= (RATE / np.sqrt(seen))[:, None]
        weights[rows] = np.subtract(self.space.taken("moved", weights, rows), gradient, out=gradient)

    def changes(self) -> Iterator[tuple[int, bytes]]:
        """Blocks of rows of both tables, numbered through."""
        whole = np.concatenate([w - s for w, s in zip(self.tables, self.start, strict=True)])
        for k in range(0, len(whole), BLOCK_ROWS):
            yield k // BLOCK_ROWS, whole[k : k + BLOCK_ROWS].astype(np.float16).tobytes()


def train_round(docs: DataFrame, model: Model, number: int, rounds: int, tasks: int) -> None:
    """Round `number` of so many over docs (doc_id, text): model's weights move by the mean change of the tasks."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learner, seen, model = None, 0, held.value
        for batch in sliced(batches, TOGETHER):
            learner = learner or Learner(model)
            t = tokens(model, batch["text"])
            learner.learn(t)
            seen += len(t.which)
        if learner and seen:
            task = TaskContext.get().partitionId()
            blocks = list(learner.changes())
            yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in blocks], pa.int32()), pa.array([task] * len(blocks), pa.int64()), pa.array([seen] * len(blocks), pa.int64()), pa.array([d for _, d in blocks], pa.binary())], ["block", "task", "n", "change"])

    def added(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("task")  # floats are added in one order
        total = sum(np.frombuffer(c, np.float16).astype(np.float32) * n for c, n in zip(rows["change"], rows["n"], strict=True))
        n = int(rows["n"].sum())
        return pd.DataFrame({"block": [key[0]], "task": [key[1]], "n": [n], "change": [(total / n).astype(np.float16).tobytes()]})

    schema = "block int, task long, n long, change binary"
    share = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(rounds)) == number).select("text").coalesce(tasks)
    changes, groups = share.mapInArrow(per_batch, schema), share.rdd.getNumPartitions()
    while True:  # means of means, so that no group holds more than FAN_IN blocks
        groups = -(-groups // FAN_IN)
        changes = changes.groupBy("block", F.floor(F.col("task") / FAN_IN).alias("task")).applyInPandas(added, schema)
        if groups <= 1:
            break
    whole = np.concatenate([model.class_weights, model.slot_weights])
    for r in changes.collect():  # one row a block: as many as the model has
        at = r["block"] * BLOCK_ROWS
        change = np.frombuffer(r["change"], np.float16).astype(np.float32).reshape(-1, whole.shape[1])
        whole[at : at + len(change)] += change
    model.class_weights, model.slot_weights = whole[: len(model.class_weights)], whole[len(model.class_weights) :]


@dataclass
class Fitted:
    model: Model
    counts: DataFrame  # word, class, c
    train_tokens: int
    unigram_total: float
    tail_totals: list[float]  # by class, of the words in slot 0


def blank(head: pd.DataFrame, rare: dict[int, tuple[int, int]]) -> tuple[Model, int, float, list[float]]:
    """A model before training, training tokens, the unigram total, and the totals of slot 0 by class.

    head: word, class (by ending), c, by; rare: tokens and types of the other words by class.
    """
    head = head.sort_values(["c", "word"], ascending=[False, True], ignore_index=True)
    words, count = head["word"].tolist(), head["c"].to_numpy(np.float64)
    # The cluster in which a word has the largest share of all tokens.
    by = np.array(head["by"].tolist(), float).reshape(-1, CLUSTERS)
    typical = ((by + 0.5) / (by.sum(0) + 0.5 * len(by) + 1)).argmax(1) if len(by) else np.zeros(0, np.int64)
    word_class = (typical * KINDS + head["class"].to_numpy(np.int64) % KINDS).astype(np.int64)
    nth = pd.Series(word_class).groupby(word_class).cumcount().to_numpy() + 1 if len(words) else np.zeros(0, np.int64)
    slot = np.where(nth < SLOTS, nth, 0)
    own_c, own_types = np.bincount(word_class, count, CLASSES), np.bincount(word_class, minlength=CLASSES)
    c = own_c + np.array([rare.get(k, (0, 0))[0] for k in range(CLASSES)])
    types = own_types + np.array([rare.get(k, (0, 0))[1] for k in range(CLASSES)])
    n, v = int(c.sum()), int(types.sum())
    slotted = slot > 0
    tails = c - np.bincount(word_class[slotted], count[slotted], CLASSES) + 0.5 * (types - np.bincount(word_class[slotted], minlength=CLASSES) + 1)
    buckets = buckets_for(n)
    class_weights, slot_weights = np.zeros((buckets, CLASSES), np.float32), np.zeros((buckets, SLOTS), np.float32)
    class_weights[0] = np.log((c + 0.5) / (n + 0.5 * CLASSES))
    by_slot = np.full((CLASSES, SLOTS), 1e-4)
    by_slot[word_class[slotted], slot[slotted]] = count[slotted]
    by_slot[:, 0] = tails
    slot_weights[1 : CLASSES + 1] = np.log(by_slot / by_slot.sum(1, keepdims=True))
    total = n + 0.5 * (v + 1)
    within = np.where(slotted, 0.0, np.log10((count + 0.5) / tails[word_class])) if len(words) else np.zeros(0)
    return Model(words, word_class, slot, np.log10((count + 0.5) / total), within, class_weights, slot_weights), n, total, tails.tolist()


def fit(docs: DataFrame) -> Fitted:
    """Counts and weights from all of docs."""
    by_cluster = stored(count_words(docs, fit_centroids(docs)), "lm-clusters")
    counts = stored(by_cluster.groupBy("word", "class").agg(F.sum("c").alias("c")), "lm-counts")
    # The most frequent words, by a count that not more than HEAD reach: what comes to the driver has that bound.
    grade = F.floor(F.log2("c") * 64)
    reached, least = 0, 0
    for r in sorted(counts.groupBy(grade.alias("grade")).count().collect(), key=lambda r: -r["grade"]):
        if reached + r["count"] > HEAD:
            least = r["grade"] + 1
            break
        reached += r["count"]
    rare = counts.where(grade < least).groupBy("class").agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("v")).collect()
    model, n, total, tails = blank(with_clusters(counts.where(grade >= least), by_cluster).toPandas(), {r["class"]: (r["c"], r["v"]) for r in rare})
    rounds = rounds_for(n)
    for number in range(rounds if n else 0):
        train_round(docs, model, number, rounds, max(1, n // (rounds * task_tokens(n))))
    return Fitted(model, counts, n, total, tails)


SCORED = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, rare array<struct<word: string, class: int, n: long>>"


def score(docs: DataFrame, fitted: Fitted) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of docs."""
    held = docs.sparkSession.sparkContext.broadcast(fitted.model)

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, row, space = held.value, TaskContext.get().partitionId() << 40, Space()
        for batch in sliced(batches, TOGETHER):
            t = tokens(model, batch["text"])
            lp, known = score_tokens(model, t, space), t.rank >= 0
            starts = np.cumsum(t.sizes) - t.sizes
            base = np.where(known, model.base[t.rank], 0.0) if len(model.words) else np.zeros(len(known))
            # Rarer words of each document, with how often it has them.
            doc = np.repeat(np.arange(len(t.sizes)), t.sizes)[~known]
            pairs, times = np.unique(doc * len(t.words) + t.which[~known], return_counts=True)
            owner, word = pairs // len(t.words), pairs % len(t.words)
            inner = pa.StructArray.from_arrays([t.words.take(pa.array(word)), pa.array(t.of_class[word], pa.int32()), pa.array(times)], ["word", "class", "n"])
            rare = pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(len(t.sizes) + 1)), pa.int32()), inner)
            sums = [np.add.reduceat(x, starts) if len(starts) else np.zeros(0) for x in (known.astype(np.int64), base, lp)]
            rows = pa.array(row + np.arange(batch.num_rows))
            row += batch.num_rows
            yield pa.RecordBatch.from_arrays([rows, batch["doc_id"], batch["held_out"], *(pa.array(x) for x in (t.sizes, *sums)), rare], ["row", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "rare"])

    scored = stored(_texts(docs).mapInArrow(per_batch, SCORED), "lm-scored")
    rare = scored.select("row", F.explode("rare").alias("r")).select("row", "r.word", "r.class", "r.n")
    c = F.coalesce("c", F.lit(0))
    tails = F.array(*map(F.lit, fitted.tail_totals))
    found = (
        rare.join(fitted.counts.select("word", "c"), "word", "left")
        .groupBy("row")
        .agg(
            F.sum(F.when(c > 0, F.col("n")).otherwise(0)).alias("known"),
            F.sum(F.col("n") * F.log10((c + 0.5) / F.lit(fitted.unigram_total))).alias("base"),
            F.sum(F.col("n") * F.log10((c + 0.5) / F.get(tails, F.col("class")))).alias("within"),
        )
    )
    zero = F.lit(0.0)
    return scored.drop("rare").join(found, "row", "left").select(
        "doc_id", "held_out", "n_tokens",
        (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(fitted.train_tokens).cast("long").alias("train_tokens"),
        (F.col("base_score") + F.coalesce("base", zero)).alias("base_score"),
        (F.col("score") + F.coalesce("within", zero)).alias("score"),
    )


def score_report(docs: DataFrame) -> DataFrame:
    """Learns from the documents that are not held out and scores all of them."""
    return score(docs, fit(docs.where(~held_out())))
