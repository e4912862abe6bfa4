"""License scans by an exact set-similarity join of text blocks with templates (DataFrame functions only).

A template is the words of a notice. A text is seen in blocks: windows of 2 * L words, one at every L words, with L the
words of the longest template, so that any notice lies whole in some block, wherever its lines are broken. A block
meets a template if it holds THRESHOLD of the template's different words.

The join is exact. Words that are in no template cannot be shared, so a block is its set of template words. All words are
ordered by how many blocks of the corpus hold them, rarest first. A block that shares o words with a template shares one of the
template's first |T| - o + 1, at one of its own first |B| - o + 1 places; blocks of fewer than o words
are left out by length, and a meeting at places i and j is left out unless 1 + min(|B| - i, |T| - j) reaches o. What is left is
verified on the whole sets. The templates' side has a row for each word of a prefix: a few hundred, bounded by MOST_WORDS.

Beside it stands the base rule: places at which a phrase's words stand one after the other.

Defined cases: null text counts as empty; an empty text has no word and no label; a notice that is repeated, or in two blocks,
gives its label once; repeated rows are documents each, told apart by a number given when words are first stored; null ids
are carried; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.llm.common import stored

#: A word, once A-Z are lower-cased.
TOKEN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Share of a template's different words that a block has to hold.
THRESHOLD = 0.9
#: Words of all templates together, at most: their prefixes are sent to every task.
MOST_WORDS = 20_000

# Phrases of the base rule, and their labels.
PHRASES = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}

# Words of notices as their licenses give them, and their labels.
TEMPLATES = (
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("cc-by", "creative commons attribution 4 0 international"),
    ("cc-by-nc", "cc by nc 4 0"),
    ("cc-by-nc", "attribution noncommercial 4 0 international"),
    ("cc-by-sa", "cc by sa 4 0"),
    ("cc-by-sa", "attribution sharealike 4 0 international"),
    ("cc0", "the person who associated a work with this deed has dedicated the work to the public domain"),
    ("gpl", "it under the terms of the gnu general public license as published by the free software foundation"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee"),
    ("lgpl", "under the terms of the gnu lesser general public license"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
)


def words(text: Column) -> Column:
    """The words of a text, in order."""
    lowered = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.regexp_extract_all(lowered, F.lit(TOKEN), F.lit(0))


def places(held: str, phrase: str) -> Column:
    """Where (from 0) the phrase's words stand one after the other in the array column."""
    parts = phrase.split(" ")
    spots = F.when(F.size(held) >= len(parts), F.sequence(F.lit(0), F.size(held) - len(parts))).otherwise(F.array().cast("array<int>"))

    def starts(i: Column) -> Column:
        same = F.get(held, i) == parts[0]
        for k, part in enumerate(parts[1:], 1):
            same = same & (F.get(held, i + k) == part)
        return same

    return F.filter(spots, starts)


def needed(n: int, threshold: float) -> int:
    """Words that a block has to share with a template of n different words."""
    return max(1, math.ceil(threshold * n - 1e-9))


def _literals(values: list[str]) -> Column:
    return F.array(*map(F.lit, values))


class Templates:
    """Templates as word sets, and what the join needs of them."""

    def __init__(self, templates: tuple[tuple[str, str], ...], threshold: float):
        split = [(label, text.split(" ")) for label, text in templates]
        if sum(len(w) for _, w in split) > MOST_WORDS:
            raise ValueError(f"templates have more than {MOST_WORDS} words: split them between runs")
        self.labels = [label for label, _ in split]
        self.sets = [sorted(set(w)) for _, w in split]
        self.need = [needed(len(s), threshold) for s in self.sets]
        self.length = max((len(w) for _, w in split), default=1)
        self.vocabulary = sorted(set().union(*self.sets))
        self.least = min(self.need, default=1)

    def prefixes(self, spark, order: dict[str, int]) -> DataFrame:  # noqa: ANN001
        """word, j (place from 1), m (words of the template), need, label, template (its words) for the words of all prefixes."""
        rows = []
        for label, own, need in zip(self.labels, self.sets, self.need, strict=True):
            ranked = sorted(own, key=lambda w: (order.get(w, 0), w))
            rows += [(w, j, len(own), need, label, own) for j, w in enumerate(ranked[: len(own) - need + 1], 1)]
        return spark.createDataFrame(rows, "word string, j int, m int, need int, label string, template array<string>")


def blocks(held: str, template: Templates) -> Column:
    """The blocks of an array of words as arrays of their different template words, those with enough for any template."""
    step, known = template.length, _literals(template.vocabulary)
    starts = F.when(F.size(held) > 0, F.sequence(F.lit(0), F.floor((F.size(held) - 1) / step).cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.filter(F.transform(starts, lambda k: F.array_intersect(F.slice(held, k * step + 1, 2 * step), known)), lambda b: F.size(b) >= template.least)


def scan(docs: DataFrame, phrases: dict[str, str] = PHRASES, templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels and labels (arrays), found (label and containment of every template met), score."""
    spark, against = docs.sparkSession, Templates(templates, threshold)
    read = docs.select("doc_id", words(F.col("text")).alias("words"))
    spots = read.select("*", *[places("words", p).alias(f"p{k}") for k, p in enumerate(phrases)])
    all_spots = F.concat(F.array().cast("array<int>"), *[F.col(f"p{k}") for k in range(len(phrases))])
    named = F.array_compact(F.array(F.lit(None).cast("string"), *[F.when(F.size(f"p{k}") > 0, F.lit(label)) for k, label in enumerate(phrases.values())]))
    base = spots.select(
        # Given once, and stored: which documents rows are of.
        F.monotonically_increasing_id().alias("row"), "doc_id", F.size("words").cast("long").alias("n_words"), F.size(all_spots).cast("long").alias("n_base"),
        F.array_min(all_spots).cast("long").alias("first_word"), F.array_max(all_spots).cast("long").alias("last_word"),
        F.array_sort(F.array_distinct(named)).alias("base_labels"), blocks("words", against).alias("blocks"),
    )
    base = stored(base, "license-words")
    met = stored(matches(base.select("row", F.explode("blocks").alias("block")), against), "license-matches")
    # A document's matches are of a few labels, whatever it holds.
    by_row = met.groupBy("row", "label").agg(F.max("score").alias("score")).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("label", "score"))).alias("found"))
    joined = base.drop("blocks").join(by_row, "row", "left")
    found = F.coalesce("found", F.array().cast("array<struct<label:string,score:double>>"))
    best = F.coalesce(F.array_max(F.transform(found, lambda x: x["score"])), F.lit(0.0))
    return joined.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels",
        F.array_sort(F.array_distinct(F.concat("base_labels", F.transform(found, lambda x: x["label"])))).alias("labels"),
        found.alias("found"), F.when(F.col("n_base") > 0, 1.0).otherwise(best).alias("score"),
    )


def matches(held: DataFrame, against: Templates) -> DataFrame:
    """row, label, score (share of the template's words) of every block (row, block) that meets a template; repeats allowed."""
    spark = held.sparkSession
    counts = held.select(F.explode("block").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    order = {r["word"]: r["n"] for r in counts.collect()}  # a row for each word of the templates, at most
    ranked = _literals(sorted(against.vocabulary, key=lambda w: (order.get(w, 0), w)))
    ordered = held.select("row", F.array_intersect(ranked, "block").alias("block"))  # in the order of ranked
    prefix = ordered.select("row", "block", F.size("block").alias("n"), F.posexplode(F.slice("block", F.lit(1), F.size("block") - against.least + 1)).alias("at", "word"))
    i, n, j, m, need = F.col("at") + 1, F.col("n"), F.col("j"), F.col("m"), F.col("need")
    near = (n >= need) & (i <= n - need + 1) & (1 + F.least(n - i, m - j) >= need)
    # At most MOST_WORDS rows are sent.
    pairs = prefix.join(F.broadcast(against.prefixes(spark, order)), "word").where(near)
    shared = F.size(F.array_intersect("block", "template"))
    return pairs.select("row", "label", "need", "m", shared.alias("shared")).where("shared >= need").select("row", "label", (F.col("shared") / F.col("m")).alias("score"))


def scan_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    found = scan(docs)
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", *[F.array_join(c, ",").alias(c) for c in ("base_labels", "labels")], "score")


def _oracle() -> str:
    """All blocks with all templates, in SQL."""
    step = max(len(t.split(" ")) for _, t in TEMPLATES)
    quoted = [(label, sorted(set(t.split(" ")))) for label, t in TEMPLATES]
    templates = ", ".join(f"('{label}', {own!r}, {needed(len(own), THRESHOLD)})" for label, own in quoted)
    phrases = []
    for phrase, label in PHRASES.items():
        same = " AND ".join(f"w[i + {k + 1}] = '{part}'" for k, part in enumerate(phrase.split(" ")))
        phrases.append(f"list_transform(list_filter(range(len(w)), lambda i: {same}), lambda i: {{'spot': i, 'label': '{label}'}})")
    return rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '{TOKEN}') AS w FROM documents),
p AS (SELECT *, list_concat({phrases[0]}, list_concat({phrases[1]}, {phrases[2]})) AS spots FROM d),
t(label, own, need) AS (VALUES {templates}),
b AS (SELECT r, list_distinct(w[k * {step} + 1 : k * {step} + {2 * step}]) AS block FROM d, unnest(range((len(w) + {step - 1}) // {step})) AS s(k)),
m AS (SELECT r, label, max(len(list_intersect(block, own)) / len(own)) AS score FROM b, t WHERE len(list_intersect(block, own)) >= need GROUP BY 1, 2),
f AS (SELECT r, list(label) AS labels, max(score) AS score FROM m GROUP BY 1),
base AS (SELECT *, list_sort(list_distinct(list_transform(spots, lambda x: x.label))) AS base_labels, list_transform(spots, lambda x: x.spot) AS firsts FROM p)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(spots) AS BIGINT) AS n_base, CAST(list_min(firsts) AS BIGINT) AS first_word, CAST(list_max(firsts) AS BIGINT) AS last_word,
  array_to_string(base_labels, ',') AS base_labels, array_to_string(list_sort(list_distinct(list_concat(base_labels, coalesce(labels, [])))), ',') AS labels,
  CASE WHEN len(spots) > 0 THEN 1.0 ELSE coalesce(score, 0.0) END::DOUBLE AS score
FROM base LEFT JOIN f USING (r)
"""


ORACLE_SQL = _oracle()
