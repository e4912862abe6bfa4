r"""Line dedup over a corpus: exact copies and lines within one word of an earlier line.

A line is a \n-separated part of a text, compared by its words (white space apart). Of equal
lines the earliest stays, by (doc_id, line number); a line of LEAST_WORDS words or more also goes
if an earlier line is within one word edit (a word put in, left out or exchanged).

Deletion-neighbourhood join: two lines within one edit have an equal variant among themselves
and their one-word deletions. For an exchange it is the same deletion at the same place, so
the lines with one (place, variant) are all within one edit of each other; for an insertion it
is the shorter line itself, and the longer lines with it as variant all link to that one line.
Either way the earliest of the lines with a key decides, without pairs in a group: a minimum for
each key, map-side combined, however many lines share it. Links found so are verified by edit
distance on the words before anything is dropped.

Variants of all lines would be as many rows as the corpus has words. One edit leaves
the first or the second half of a line alone, so lines that share no half with a different line
are set aside first by hashes of their halves, and of the others only words beyond a shared half are
deleted; that loses no link.

Texts are not moved for this. Tasks read them once more and send on the lines that a `BitFilter` of the shared
halves lets pass, of documents that have such lines by another filter; rows of variants that a filter of the variants of several lines denies go no farther,
nor do the texts of documents that lose nothing. The filters have a bounded size and spare work only: the joins
behind them are exact. Where there are so many members that a filter lets everything pass, all lines' words
and all documents' texts are shuffled once each.

Defined cases: null text stays null; lines without a word are always kept; rows with equal
doc_id and text are one document (its copies keep the same lines); a null doc_id comes first;
very long lines and texts are handled whole; an empty table gives no rows; other columns are
carried and not looked at. A text whose lines all go is left as an empty text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest, xxh3_128_digest

from quantloom.llm.common import BitFilter, sliced, stored

#: Documents whose lines a task holds in words at a time.
TOGETHER = 256
#: Shorter lines are compared for equality only: one word is too much of them.
LEAST_WORDS = 8

LINES = "id long, part long, line int, a long, b long, halves array<long>"
SUSPECTS = "id long, part long, line int, a long, b long, n_words int, words binary, halves array<struct<half: long, low: int, high: int>>"
VARIANTS = "number long, variant long, self boolean"


def _short(data: bytes, seed: int = 0) -> int:
    return xxh3_64_intdigest(data, seed) - (1 << 63)


def halves(words: list[bytes], whole: bytes | None = None) -> list[tuple[int, int, int]]:
    """Hashes such that two lines within one edit have one in common, and between which places the edit is then.

    A line and a partner no shorter agree on the first half of the shorter one's words or on the
    rest of them from the end, so a line gives both for its own length and for one word less.
    whole is the words joined by spaces, if at hand; halves are cut from it.
    """
    n = len(words)
    k = n // 2
    whole = b" ".join(words) if whole is None else whole
    at = sum(map(len, words[:k])) + k  # where word k begins, and the one behind it
    after = at + len(words[k]) + 1
    first, last = _short(whole[: max(at - 1, 0)], 1), _short(whole[after:], 2)
    if n % 2:
        return [(first, k, n), (_short(whole[: after - 1], 1), k + 1, n), (last, 0, k + 1)]
    return [(first, k, n), (last, 0, k + 1), (_short(whole[at:], 2), 0, k)]


def variant_keys(words: list[bytes], low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the deletion neighbourhood by words from low to high, and which of them say that the line itself is the variant.

    Contents are keys for insertions: the line's own, and those that deletions leave (one of a run of equal
    words). With the place and the line's length they are keys for exchanges.
    """
    whole = b" ".join(words)
    at = sum(map(len, words[:low])) + low
    found, apart, last = [_short(whole)], [], None
    for word in words[low:high]:
        after = at + len(word) + 1
        found.append(_short(whole[:at] + whole[after:] if after <= len(whole) else whole[: max(at - 1, 0)]))
        apart.append(word != last)
        at, last = after, word
    own = np.array(found, np.int64).view(np.uint64)
    with np.errstate(over="ignore"):
        placed = np.arange(low, high, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(len(words)) * np.uint64(0xBF58476D1CE4E5B9)
        exchanged = (own[1:] ^ placed) * np.uint64(0x94D049BB133111EB)
    keys = np.concatenate([own[:1], own[1:][np.array(apart, bool)], exchanged ^ (exchanged >> np.uint64(31))])
    return keys.view(np.int64), np.arange(len(keys)) == 0


def within_one_edit(a: list[bytes], b: list[bytes]) -> bool:
    """Whether the word edit distance is at most one."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    at = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[at + 1 :] == b[at + 1 :] if len(a) == len(b) else a[at:] == b[at + 1 :]


def _keyed(docs: DataFrame) -> list[Column]:
    """What identifies a document: its id, and a hash of its text for ids that repeat."""
    id_ = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)).cast("long"))
    return [id_.alias("id"), F.xxhash64("text").alias("part"), F.col("text").cast("binary").alias("text")]


class _Lines:
    """The lines with a word of a batch of documents: place, 128 bits of the words, halves (of lines that can be near another)."""

    def __init__(self, batch: pa.RecordBatch, least_words: int, documents: np.ndarray | None = None):
        texts, some = batch["text"], range(batch.num_rows) if documents is None else np.flatnonzero(documents).tolist()
        self.words: list[bytes] = []  # joined: lists of words of many lines would be slow to hold
        digests, numbers, counts, lengths, sizes = [], [], [], [], []
        flat: list[int] = []  # hash, low and high of every half
        for i in some:
            before = len(numbers)
            for number, line in enumerate((texts[i].as_py() or b"").split(b"\n")):
                if words := line.split():
                    whole = b" ".join(words)
                    numbers.append(number)
                    digests.append(xxh3_128_digest(whole))
                    self.words.append(whole)
                    lengths.append(len(words))
                    had = len(flat)
                    if len(words) >= least_words - 1:
                        for half in halves(words, whole):
                            flat += half
                    sizes.append((len(flat) - had) // 3)
            counts.append(len(numbers) - before)
        owner = np.repeat(np.array(some, np.int64), counts)
        copies = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
        self.columns = {
            "id": np.asarray(batch["id"])[owner], "part": np.asarray(batch["part"])[owner], "line": np.array(numbers, np.int32),
            "a": np.ascontiguousarray(copies[:, 0]), "b": np.ascontiguousarray(copies[:, 1]),
        }
        self.lengths, self.sizes = np.array(lengths, np.int32), np.array(sizes, np.int64)
        self.flat, self.low, self.high = np.ascontiguousarray(np.array(flat, np.int64).reshape(-1, 3).T)

    def where(self, flat: np.ndarray) -> np.ndarray:
        """Places of the lines that have a half for which flat says so."""
        some = np.zeros(len(self.sizes), bool)
        some[np.repeat(np.arange(len(self.sizes)), self.sizes)[flat]] = True
        return np.flatnonzero(some)


def lines(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """Rows of LINES: every line with a word, 128 bits of its words (a, b), the hashes of its halves."""

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, TOGETHER):
            found = _Lines(batch, least_words)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(found.sizes)]), pa.int32()), pa.array(found.flat))
            yield pa.RecordBatch.from_arrays([*map(pa.array, found.columns.values()), lists], [*found.columns, "halves"])

    return docs.select(*_keyed(docs)).mapInArrow(per_batch, LINES)


def _with_suspects(index: DataFrame, shared: BitFilter) -> DataFrame:
    """key of the documents of which a line may share a half."""

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.asarray(batch["halves"].value_lengths()).astype(np.int64)
            row = np.repeat(np.arange(len(sizes)), sizes)[shared.holds(np.asarray(batch["halves"].flatten()))]
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.asarray(batch["key"])[row]))], ["key"])

    return index.select(F.xxhash64("id", "part").alias("key"), "halves").mapInArrow(per_batch, "key long")


def _suspects(docs: DataFrame, documents: BitFilter, shared: BitFilter, least_words: int) -> DataFrame:
    """Rows of SUSPECTS: lines of which a half may be shared, with their words and those halves."""
    half = pa.struct([("half", pa.int64()), ("low", pa.int32()), ("high", pa.int32())])

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, TOGETHER):
            found = _Lines(batch, least_words, documents.holds(np.asarray(batch["key"])))
            some = found.where(shared.holds(found.flat))
            chosen = np.zeros(len(found.sizes), bool)
            chosen[some] = True
            chosen = np.repeat(chosen, found.sizes)  # their halves
            inner = pa.StructArray.from_arrays([pa.array(x[chosen], f.type) for x, f in zip((found.flat, found.low, found.high), half, strict=True)], fields=list(half))
            held = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(found.sizes[some])]), pa.int32()), inner)
            place = [pa.array(c[some]) for c in found.columns.values()]
            own = [pa.array(found.lengths[some]), pa.array([found.words[i] for i in some.tolist()], pa.binary()), held]
            yield pa.RecordBatch.from_arrays([*place, *own], [*found.columns, "n_words", "words", "halves"])

    keyed = docs.select(*_keyed(docs)).withColumn("key", F.xxhash64("id", "part"))
    return keyed.mapInArrow(per_batch, SUSPECTS)


def _variant_rows(texts: DataFrame, met: BitFilter | None = None) -> DataFrame:
    """Rows of VARIANTS of the lines; with met, those that it lets pass."""

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches, TOGETHER):
            found = [variant_keys(w.split(), low, high) for w, low, high in zip(*(part[c].to_pylist() for c in ("words", "low", "high")), strict=True)]
            number = np.repeat(np.asarray(part["number"]), [len(k) for k, _ in found])
            keys, own = (np.concatenate(x) for x in zip(*found, strict=True))
            here = met.holds(keys) if met else slice(None)
            yield pa.RecordBatch.from_arrays([pa.array(x[here]) for x in (number, keys, own)], ["number", "variant", "self"])

    return texts.select("number", "words", "low", "high").mapInArrow(per_batch, VARIANTS)


def near_lines(docs: DataFrame, index: DataFrame, least_words: int) -> DataFrame:
    """a, b of the lines that are within one edit of an earlier line."""
    # Lines that share a half with a different line, with their words; of equal lines the first.
    half = index.select("a", F.explode("halves").alias("half"))
    shared = half.groupBy("half").agg(F.min("a").alias("least"), F.max("a").alias("most")).where("least <> most").select("half")
    shared = stored(shared, "lines-halves")
    some = BitFilter(shared, "half")
    having = stored(_with_suspects(index, some), "lines-having")
    found = _suspects(docs, BitFilter(having, "key"), some, least_words)
    firsts = found.groupBy("a", "b").agg(F.min_by(F.struct("id", "part", "line", "n_words", "words", "halves"), F.struct("id", "part", "line")).alias("first"))
    firsts = stored(firsts.select("a", "b", "first.*"), "lines-suspects")
    # Numbered in order of their places, so that the earliest line of a key is the least number.
    texts = stored(firsts.orderBy("id", "part", "line").withColumn("number", F.monotonically_increasing_id()).drop("id", "part", "line"), "lines-texts")
    each = texts.select("number", F.inline("halves")).join(shared, "half", "left_semi")
    between = each.groupBy("number").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    texts = stored(texts.drop("halves").join(between, "number"), "lines-texts")

    # The earliest line of every key; a key's shorter line (self) is apart from the longer ones.
    own, other = F.when(F.col("self"), F.col("number")), F.when(~F.col("self"), F.col("number"))
    keys = _variant_rows(texts).groupBy("variant").agg(F.min(own).alias("own"), F.min(other).alias("other"), F.count(F.lit(1)).alias("n"))
    keys = stored(keys.where("n > 1").drop("n"), "lines-keys")  # a stored side leaves the join free to split a hot key
    rows = _variant_rows(texts, BitFilter(keys, "variant"))
    linked = rows.join(keys, "variant").select(F.col("number").alias("late"), F.explode(F.array("own", "other")).alias("early"))
    pairs = linked.where("early < late").distinct()
    late = texts.select(F.col("number").alias("late"), "a", "b", F.col("words").alias("x"), F.col("n_words").alias("m"))
    early = texts.select(F.col("number").alias("early"), F.col("words").alias("y"), F.col("n_words").alias("n"))
    return _verified(pairs.join(late, "late").join(early, "early"), least_words).distinct()


def dropped_lines(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """id, part, line, near: every line that goes, and whether it is a near rather than an exact copy."""
    index = stored(lines(docs, least_words), "lines-index")
    place = F.struct("id", "part", "line")
    repeated = index.groupBy("a", "b").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    near = near_lines(docs, index, least_words).withColumn("near", F.lit(True))
    # All copies of a near copy go, and all but the first of the others.
    decided = stored(repeated.join(near, ["a", "b"], "full_outer").select("a", "b", "first", F.coalesce("near", F.lit(False)).alias("near")), "lines-decided")
    some = BitFilter(decided, "a").column(F.col("a"))
    met = index.select("a", "b", "id", "part", "line").where(some).join(decided, ["a", "b"])
    return met.where(F.col("near") | (F.col("first") != place)).select("id", "part", "line", "near")


def _verified(pairs: DataFrame, least_words: int) -> DataFrame:
    """a, b of the late lines of the pairs whose longer line has enough words and whose distance is one."""

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fits = [within_one_edit(x.split(), y.split()) for x, y in zip(batch["x"].to_pylist(), batch["y"].to_pylist(), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(fits, pa.bool_()))

    return pairs.where(F.greatest("m", "n") >= least_words).select("a", "b", "x", "y").mapInArrow(per_batch, "a long, b long")


def dedup_lines(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """docs with text rewritten, and columns __exact, __near: lines dropped as copies, as near copies."""
    gone = dropped_lines(docs, least_words).groupBy(F.col("id").alias("__id"), F.col("part").alias("__part")).agg(
        F.collect_set("line").alias("__gone"), F.size(F.collect_set(F.when(F.col("near"), F.col("line")))).cast("long").alias("__near")
    )
    key = F.xxhash64("__id", "__part")
    gone = stored(gone.withColumn("__key", key), "lines-gone")
    loses = BitFilter(gone, "__key").column(key)
    id_, part, _ = _keyed(docs)
    keyed = docs.withColumns({"__id": id_, "__part": part})
    parts = F.split("text", "\n", -1)
    # Numbers of dropped lines become a set once for the row; a line's test is then a look-up.
    held = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), "__gone")
    text = F.when(F.col("__gone").isNull(), F.col("text")).otherwise(F.array_join(F.transform(held, lambda i: F.get(parts, i)), "\n"))
    near, dropped = F.coalesce("__near", F.lit(0)), F.coalesce(F.size("__gone"), F.lit(0))  # the size of null is null
    rewritten = keyed.where(loses).join(gone.drop("__key"), ["__id", "__part"], "left").select(
        *[text.alias("text") if c == "text" else F.col(c) for c in docs.columns], (F.greatest(dropped, F.lit(0)) - near).alias("__exact"), near.alias("__near")
    )
    return rewritten.unionByName(keyed.where(~loses).select(*docs.columns, F.lit(0).cast("long").alias("__exact"), F.lit(0).cast("long").alias("__near")))


def dedup_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines (with a word), n_exact, n_near, text: what was dropped from each document, and what is left of it."""
    # A line with a word is one match: from its first character of a word to its end. Those that went had words.
    left = F.coalesce(F.regexp_count("text", F.lit(r"[^\x09-\x0D\x20][^\n]*")), F.lit(0))
    found = dedup_lines(docs.select("doc_id", "text"))
    n = (left + F.col("__exact") + F.col("__near")).cast("int")
    return found.select("doc_id", n.alias("n_lines"), F.col("__exact").alias("n_exact"), F.col("__near").alias("n_near"), "text")


def without_repeated_lines(docs: DataFrame) -> DataFrame:
    """The documents with their columns, texts rewritten; n_chars, where it is, follows the text."""
    done = dedup_lines(docs)
    count = F.length("text").cast(dict(docs.dtypes).get("n_chars", "long"))
    return done.select(*[count.alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])
