"""Best-fit packing of tokenised documents into sequences, improved by swap-based local search.

Documents are cut into pieces of at most `capacity` tokens. Pieces are dealt by a hash of their
row into shards of about SEQUENCES sequences (or SHARD pieces, if they are tiny); a shard is packed by itself. It is
filled cheaply first, every piece as it comes going into the fullest sequence that has room, and then a local
search empties sequences. Each step takes pieces from the emptiest underfull sequence, the donor, to make a
fuller one fuller: a piece is moved, or exchanged for a shorter one, or two are exchanged for a shorter one;
of the possible steps of the first kind that has any, the one that raises the sum of squared fills most.
That sum rises at every step, so the search ends: where as few sequences are left as the tokens need, or no
sequence can give anything. A donor whose pieces have all gone is a sequence saved. A shard ends with about one
partly filled sequence, a thousandth of its sequences, at any size of input.

Defined cases: null text is an empty text; an empty document is the single end id; repeated rows
are pieces of their own; very long documents are cut, nothing else is; an empty table gives no
rows; a null doc_id is carried; other columns are not looked at. Ties go to the piece that comes first in its shard.
"""

from __future__ import annotations

import itertools
import json
import os
import re
import struct
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.llm.common import stored

#: Sequences and pieces of a shard at most, about; tokens of a sequence; the id that ends a document.
SEQUENCES, SHARD, CAPACITY, END_ID = 1024, 65_536, 4096, 1
#: Distinct words that a Python worker remembers at most, then it starts anew; texts tokenised in one go.
CACHE_WORDS, TOGETHER = 400_000, 1024
#: New words that are tokenised as one text, or in one go.
RUN = 1000
#: Numbers that a step of the search holds in one array at most, about.
CELLS = 1_000_000
#: Fixed value: the pattern of tokens before merges by which no token crosses white space or depends on it.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

PIECES = "row long, doc_id long, piece int, start long, length long, ids_crc32 long"
PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def words_stand_alone(tokenizer: str) -> bool:
    """Whether a tokenizer (its JSON) gives a text the ids of its words one after another.

    So it is if it marks ends of words, drops white space, parts letters from other characters by WORD_PATTERN, and
    normalises by NFC and lower case at most.
    """

    def steps(part: dict | None, inner: str) -> list[dict]:
        return [] if part is None else part[inner] if part["type"] == "Sequence" else [part]

    spec = json.loads(tokenizer)
    model, before = spec["model"], steps(spec["pre_tokenizer"], "pretokenizers")
    blank = {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}
    plain = all(n["type"] in ("NFC", "Lowercase") or n == blank for n in steps(spec["normalizer"], "normalizers"))
    split = {"type": "Split", "pattern": {"Regex": WORD_PATTERN}, "behavior": "Removed", "invert": True}
    rest = all(p["type"] == "ByteLevel" and not p["add_prefix_space"] and not p["use_regex"] for p in before[1:])
    return model["type"] == "BPE" and model.get("end_of_word_suffix") == "</w>" and not model.get("dropout") and plain and before[:1] == [split] and rest


class WordTokens:
    """Token ids of whole texts. Where words stand alone they come from the ids of words, each tokenised once; else texts are tokenised whole."""

    def __init__(self, tokenizer_file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; threads would only wait for each other
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        self.alone = words_stand_alone(self.tokenizer.to_str())
        if not self.alone:
            return
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        # Special tokens are found in the whole text before words are, so such texts go whole.
        self.special = "|".join(map(re.escape, special)) if special else None
        self.cache: dict[str, bytes] = {"": b""}
        self.folds = self._each(["Az"]) == self._each(["az"])  # whether case makes no difference
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that end a run of letters
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.marks = {m: self._each([m])[0] for m in ".,"}

    def _each(self, words: list[str]) -> list[bytes]:
        return [_packed(e.ids) for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _learn(self, words: list[str]) -> None:
        """Adds words to the cache. A mark after letters is a token of its own, and runs of letters go together in one text."""
        cache = self.cache
        marked = [w for w in words if w[-1] in self.marks and w[-2:-1].isalpha()]
        wanted = [w for w in dict.fromkeys([*words, *(w[:-1] for w in marked)]) if w not in cache and not (w[-1] in self.marks and w[-2:-1].isalpha())]
        letters = [w for w in wanted if w.isalpha()]
        for at in range(0, len(letters), RUN):
            run = letters[at : at + RUN]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(run)], add_special_tokens=False)[0].ids, "<u4")
            last = np.flatnonzero(self.ends[ids])
            if len(last) == len(run):  # one end a word: the tokens up to it are the word's
                data, to = ids.tobytes(), (4 * (last + 1)).tolist()
                cache.update(zip(run, [data[i:j] for i, j in zip([0, *to], to, strict=False)], strict=True))
        others = [w for w in wanted if w not in cache]
        for at in range(0, len(others), RUN):
            run = others[at : at + RUN]
            cache.update(zip(run, self._each(run), strict=True))
        cache.update([(w, cache[w[:-1]] + self.marks[w[-1]]) for w in marked])

    def ids(self, texts: pa.Array) -> list[bytes]:
        """Little-endian 32-bit ids of texts (null: empty), without special ones added.

        Arrow splits the texts and numbers their distinct words; only those are looked up.
        """
        texts = texts.fill_null("")
        if not self.alone:
            return self._each(texts.to_pylist())
        whole = np.flatnonzero(pc.match_substring_regex(texts, self.special)) if self.special else np.zeros(0, int)
        split = pc.ascii_split_whitespace(pc.ascii_lower(texts) if self.folds else texts)
        offsets = np.asarray(split.offsets)
        numbered = split.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
        words, which = numbered.dictionary.to_numpy(zero_copy_only=False).tolist(), np.asarray(numbered.indices)
        new = [w for w in words if w not in self.cache]
        if len(self.cache) + len(new) > CACHE_WORDS:
            self.cache = {"": b""} | {w: self.cache[w] for w in words if w in self.cache}
        self._learn(new)
        held = [self.cache[w] for w in words]
        ids, ends = gathered(np.frombuffer(b"".join(held), "<u4"), np.fromiter(map(len, held), np.int64, len(held)) // 4, which)
        cuts = np.concatenate([[0], ends])[offsets - offsets[0]]
        out = [ids[i:j].tobytes() for i, j in itertools.pairwise(cuts.tolist())]
        for i in whole:
            out[i] = _packed(self.tokenizer.encode(texts[int(i)].as_py(), add_special_tokens=False).ids)
        return out


def gathered(flat: np.ndarray, sizes: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of flat (of those sizes, one after another) in the order of which, and where each of them ends."""
    own = sizes[which]
    ends = np.cumsum(own)
    return flat[np.arange(own.sum()) + np.repeat((np.cumsum(sizes) - sizes)[which] - (ends - own), own)], ends


@lru_cache(maxsize=1)
def word_tokens(tokenizer_file: str) -> WordTokens:
    """One for all tasks that a Python worker runs, so that a word is tokenised once a worker."""
    return WordTokens(tokenizer_file)


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def pieces(docs: DataFrame, tokenizer_file: str, capacity: int = CAPACITY) -> DataFrame:
    """Rows of PIECES; row is a number of the piece's own, unique in the result."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, n = word_tokens(tokenizer_file), TaskContext.get().partitionId() << 40
        end = struct.pack("<I", END_ID)
        for batch in (whole.slice(at, TOGETHER) for whole in batches for at in range(0, whole.num_rows, TOGETHER)):
            out: list[tuple] = []
            found = tokens.ids(batch["text"])
            for doc_id, ids in zip(batch["doc_id"].to_pylist(), found, strict=True):
                ids += end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    out.append((n, doc_id, k, at // 4, len(part) // 4, zlib.crc32(part)))
                    n += 1
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            columns = list(zip(*out, strict=True)) if out else [()] * 6
            names = ["row", "doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return slim.mapInArrow(cut, PIECES)


def filled(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of indices: every piece as it comes, into the fullest bin that still has room."""
    bins: list[list[int]] = []
    room: list[tuple[int, int]] = []  # (room, bin), sorted
    for i, length in enumerate(lengths):
        at = bisect_left(room, (length, -1))
        if at == len(room):
            free, b = capacity, len(bins)
            bins.append([])
        else:
            free, b = room.pop(at)
        bins[b].append(i)
        if free > length:
            insort(room, (free - length, b))
    return bins


class SwapSearch:
    """Pieces in bins, and steps that make one bin emptier and a fuller one fuller."""

    def __init__(self, bins: list[list[int]], lengths: list[int], capacity: int):
        self.length, self.capacity = np.asarray(lengths, np.int64), capacity
        self.bin = np.zeros(len(lengths), np.int64)
        for b, members in enumerate(bins):
            self.bin[members] = b
        self.fill = np.array([sum(lengths[i] for i in b) for b in bins], np.int64)
        self.held = np.array([len(b) for b in bins], np.int64)
        self.squares = [int((self.fill**2).sum())]  # after every step

    def run(self) -> list[list[int]]:
        fewest = -(-int(self.fill.sum()) // self.capacity)
        done, changed = np.zeros(len(self.fill), bool), False
        while (self.held > 0).sum() > fewest:
            donors = np.flatnonzero((self.held > 0) & (self.fill < self.capacity) & ~done)
            if not len(donors):
                if not changed:
                    break
                done[:], changed = False, False  # what has been exchanged since may give a donor another step
                continue
            donor = donors[np.argmin(self.fill[donors])]
            while self.held[donor] and (step := self.step(donor)):
                self._take(donor, *step)
                changed = True
            done[donor] = True
        order = np.argsort(self.bin, kind="stable")
        return [b.tolist() for b in np.split(order, np.cumsum(self.held)[:-1]) if len(b)]

    def _take(self, donor: int, to: int, given: list[int], taken: list[int]) -> None:
        self.bin[given], self.bin[taken] = to, donor
        gain = int(self.length[given].sum() - self.length[taken].sum())
        before = self.fill[donor] ** 2 + self.fill[to] ** 2
        self.fill[donor] -= gain
        self.fill[to] += gain
        self.held[donor] += len(taken) - len(given)
        self.held[to] += len(given) - len(taken)
        self.squares.append(self.squares[-1] + int(self.fill[donor] ** 2 + self.fill[to] ** 2 - before))

    def step(self, donor: int) -> tuple[int, list[int], list[int]] | None:
        """The receiver, the donor's pieces to give and the pieces to take back; None if nothing can be given."""
        own = np.flatnonzero(self.bin == donor)
        own = own[np.argsort(self.length[own], kind="stable")]
        p = self.length[own]
        open_ = (self.fill < self.capacity) & (self.held > 0) & (self.fill >= self.fill[donor])
        open_[donor] = False
        bins = np.flatnonzero(open_)
        if not len(bins):
            return None
        # A piece moves: the longest that fits.
        at = np.searchsorted(p, self.capacity - self.fill[bins], "right") - 1
        if (k := self._best(donor, bins, np.where(at >= 0, p[at], 0))) is not None:
            return int(bins[k]), [int(own[at[k]])], []
        # One for one: the longest that fits in the place of a piece.
        rest = np.flatnonzero(open_[self.bin])
        to, back = self.bin[rest], self.length[rest]
        most = back + self.capacity - self.fill[to]
        at = np.searchsorted(p, most, "right") - 1
        if (k := self._best(donor, to, np.where(at >= 0, p[at], 0) - back)) is not None:
            return int(to[k]), [int(own[at[k]])], [int(rest[k])]
        # Two for one: for every longer piece of a pair the longest shorter one that still fits.
        best, found = 0, None
        rows = max(1, CELLS // len(rest))
        for low in range(1, len(own), rows):
            longer = np.arange(low, min(low + rows, len(own)))
            other = np.minimum(np.searchsorted(p, (most[None, :] - p[longer, None]).ravel(), "right").reshape(len(longer), -1) - 1, longer[:, None] - 1)
            gain = np.where(other >= 0, p[longer, None] + p[other] - back[None, :], 0)
            rise = np.where(gain > 0, gain * (self.fill[to][None, :] - self.fill[donor] + gain), 0)
            i, k = np.unravel_index(rise.argmax(), rise.shape)
            if rise[i, k] > best:
                best, found = rise[i, k], (int(to[k]), [int(own[longer[i]]), int(own[other[i, k]])], [int(rest[k])])
        return found

    def _best(self, donor: int, to: np.ndarray, gain: np.ndarray) -> int | None:
        """Where the sum of squares rises most; None if it rises nowhere."""
        rise = np.where(gain > 0, gain * (self.fill[to] - self.fill[donor] + gain), 0)
        k = int(rise.argmax()) if len(rise) else 0
        return k if len(rise) and rise[k] > 0 else None


def packed(lengths: list[int], capacity: int) -> list[list[int]]:
    return SwapSearch(filled(lengths, capacity), lengths, capacity).run() if lengths else []


def pack(docs: DataFrame, tokenizer_file: str, capacity: int = CAPACITY, sequences: int = SEQUENCES) -> DataFrame:
    """Rows of PLACED: every piece of every document with its sequence and its place there."""
    cut = stored(pieces(docs, tokenizer_file, capacity), "pack-pieces")
    size = cut.agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("tokens")).first()
    shards = max(1, -(-size["n"] // SHARD), -(-(size["tokens"] or 0) // (sequences * capacity)))

    def place(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("row", ignore_index=True)
        lengths = group["length"].tolist()
        sequence, offset = [0] * len(lengths), [0] * len(lengths)
        for number, members in enumerate(packed(lengths, capacity)):
            at = 0
            for i in members:
                sequence[i], offset[i] = key[0] << 32 | number, at
                at += lengths[i]
        return group[["doc_id", "piece", "start", "length", "ids_crc32"]].assign(sequence_id=sequence, offset=offset)

    dealt = cut.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)))
    return dealt.groupBy("shard").applyInPandas(place, PLACED)
