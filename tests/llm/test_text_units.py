"""Fill-in-middle, lexical search and license scans against plain statements of what they have to give."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantloom.llm import fill_in_middle, impact_index, license_scan

from .test_operators import collected, documents, odd_rows

ITEMS = "item_id long, text string, doc_id long, terms string"


def more_rows():
    """Markers, ends of lines of all kinds, characters beyond the basic plane, texts that share an id."""
    rows = [(200, "a\n\n<P>b", "a", "s"), (201, "\n\n\n", "a", "s"), (202, "no end", "a", "s"), (203, "with end\n", "a", "s")]
    rows += [(204, "ä𝒳\n😀😀\nz\r\nq r\u0085s\n", "a", "s"), (205, "<P\n<S\n<M\n>", "a", "s"), (206, "x\n" * 5000, "a", "s"), (7, "another text of 7\nwith lines\n", "a", "s")]
    return odd_rows() + rows


# --- op11 ---


def middle_filled(doc_id, text, unit=fill_in_middle.LINE, rate=100, spm=50):
    text = text or ""
    digest = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    units = re.findall(unit, text)
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    if h[3] % 100 < spm:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


@pytest.mark.parametrize(("unit", "rate", "spm"), [(fill_in_middle.LINE, 100, 50), (r"\w+\W*|\W+", 60, 30)])
def test_fill_in_middle_cuts_at_units(spark, unit, rate, spm):
    rows = more_rows()
    found = collected(fill_in_middle.transform(documents(spark, rows), unit, rate, spm))
    got = Counter((r["doc_id"], r["text"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in found)
    assert got == Counter((i, t, *middle_filled(i, t, unit, rate, spm)) for i, t, *_ in rows)
    assert {r["form"] for r in found} == {"plain", "psm", "spm"}


def test_fill_in_middle_is_rebuilt_from_output_and_form(spark):
    rows = more_rows()
    docs = documents(spark, rows)
    done = fill_in_middle.transform(docs)
    assert done.where(fill_in_middle.rebuilt(F.col("output"), F.col("form")) != F.coalesce("text", F.lit(""))).isEmpty()
    report = collected(fill_in_middle.fim_report(docs))
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    assert Counter(r["restored_sha256"] for r in report) == Counter(sha(t) for _, t, *_ in rows)
    assert Counter(r["output_sha256"] for r in report) == Counter(sha(middle_filled(i, t)[-1]) for i, t, *_ in rows)


def test_fill_in_middle_moves_lengths_not_texts(spark):
    """Units, requests and sums share one shuffle, and no text is in it."""
    plan = fill_in_middle.offsets(documents(spark, more_rows()))._jdf.queryExecution().executedPlan().toString()
    shuffles = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert len(set(re.findall(r"hashpartitioning\(([^)]*)\)", "\n".join(shuffles)))) <= 2  # both sides of the plan before reuse
    assert not any("text" in line for line in shuffles)


def test_fill_in_middle_keeps_columns_and_empty_tables(spark):
    docs = documents(spark, more_rows())
    done = fill_in_middle.fim_documents(docs)
    assert done.columns == docs.columns and done.count() == docs.count()
    assert Counter((r["doc_id"], r["text"]) for r in collected(done)) == Counter((i, None if t is None else middle_filled(i, t)[-1]) for i, t, *_ in more_rows())
    empty = documents(spark, [])
    assert collected(fill_in_middle.fim_report(empty)) == [] and collected(fill_in_middle.fim_documents(empty)) == []


# --- op12 ---

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms_of(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def ranked(rows, items, k):
    counted = [(i, Counter(terms_of(t))) for i, t, *_ in rows]
    counted = [(i, c) for i, c in counted if c]
    documents_, length = len(counted), sum(c.total() for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item, text in dict.fromkeys((i, t) for i, t in items if i is not None):
        scores = []
        for doc, c in counted:
            m = 50 + 50 * c.total() * documents_ // length
            score = sum(math.floor(1000 * math.log((2 * documents_ + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in set(terms_of(text)) if c[t])
            if score > 0:
                scores.append((-score, doc is None, doc or 0, doc))
        out += [(item, rank, doc, -s) for rank, (s, _, _, doc) in enumerate(sorted(scores, key=lambda x: x[:3])[:k], 1)]
    return Counter(out)


def search_rows():
    rng = random.Random(5)
    rows = more_rows()
    rows += [(300 + k, " ".join(rng.choice(("Zäh", "w1", "W2", "rare9", "_w3-w4", "5")) for _ in range(rng.randrange(1, 30))), "a", "s") for k in range(150)]
    return rows + [(900, "tie tie w1", "a", "s"), (899, "tie tie w1", "b", "s"), (899, "tie tie w1", "b", "s"), (None, "tie tie w1", "b", "s"), (901, "w5 " * 4000, "b", "s")]


QUERIES = [(1, "W1 w2, w2 rare9"), (1, "W1 w2, w2 rare9"), (2, "tie"), (3, None), (4, ".,"), (None, "w1"), (5, "zäh ZÄH"), (6, "never seen"), (1, "w5 another"), (7, " ".join(f"w{k}" for k in range(400)))]


@pytest.mark.parametrize(("k", "block", "query_block"), [(5, 64, 2), (50, 1 << 15, 1024), (1, 1, 1)])
def test_lexical_search_is_exact(spark, monkeypatch, k, block, query_block):
    monkeypatch.setattr(impact_index, "TOGETHER", 7)
    rows = search_rows() if block > 1 else search_rows()[-40:]
    items = spark.createDataFrame([(i, t, 0, "") for i, t in QUERIES], ITEMS)
    found = collected(impact_index.search(documents(spark, rows), items, k, block=block, query_block=query_block))
    assert Counter((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in found) == ranked(rows, QUERIES, k)


def test_lexical_search_does_not_depend_on_what_filters_let_pass(spark, monkeypatch):
    items = spark.createDataFrame([(i, t, 0, "") for i, t in QUERIES], ITEMS)
    docs = documents(spark, search_rows())
    before = Counter(map(tuple, impact_index.search(docs, items).collect()))
    monkeypatch.setattr(impact_index.BitFilter, "holds", lambda self, hashes: np.ones(len(hashes), bool))
    assert Counter(map(tuple, impact_index.search(docs, items).collect())) == before


def test_lexical_search_of_empty_tables(spark):
    items, docs = spark.createDataFrame(QUERIES, "item_id long, text string"), documents(spark, search_rows())
    none = spark.createDataFrame([], "item_id long, text string")
    for d, i in ((documents(spark, []), items), (docs, none), (documents(spark, []), none), (documents(spark, [(1, None, "a", "s"), (2, "!", "a", "s")]), items)):
        assert collected(impact_index.search(d, i)) == []


# --- op13 ---


def labels_of(text, phrases, templates, threshold):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    spots = [(i, label) for phrase, label in phrases.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    step = max(len(t.split()) for _, t in templates)
    found = {}
    for at in range(0, len(words), step):
        block = set(words[at : at + 2 * step])
        for label, template in templates:
            own = set(template.split())
            if len(own & block) >= threshold * len(own) - 1e-9:
                found[label] = max(found.get(label, 0), len(own & block) / len(own))
    base = sorted({label for _, label in spots})
    at = [i for i, _ in spots]
    return (
        len(words), len(spots), min(at, default=None), max(at, default=None), ",".join(base), ",".join(sorted({*base, *found})),
        1.0 if spots else max(found.values(), default=0.0),
    )


NOTICE = "Permission is hereby granted,\nfree of charge, to any person\nobtaining a copy of this software"


def license_rows():
    filler = " ".join(f"word{k}" for k in range(60))
    texts = [
        "All rights reserved. All rights\nreserved", "CC BY-NC 4.0", "cc-by", "ccby", "Released under the MIT License.", "released mit under license the", "mit license",
        f"{filler} Licensed under the Apache License, Version 2.0. {filler}", f"{filler} {NOTICE} {filler}", NOTICE.replace("charge", "cost"), NOTICE.replace("charge", "cost").replace("copy", "part"),
        "This work is licensed under the GNU General Public License, version 3.", "This thing is licensed under the GNU General Public License, version 2.", "general public license", "ALL RIGHTS RESERVED " * 2000,
        "Ünder the terms of the GNU Lesser General Public License", "K cc by", f"{filler} " * 400 + "released under the mit license",
    ]
    return more_rows() + [(500 + k, t, "a", "s") for k, t in enumerate(texts)]


@pytest.mark.parametrize("threshold", [license_scan.THRESHOLD, 0.6])
def test_license_scan_is_that_of_all_blocks(spark, threshold):
    rows = license_rows()
    found = license_scan.scan(documents(spark, rows), threshold=threshold)
    got = Counter((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], ",".join(r["base_labels"]), ",".join(r["labels"]), round(r["score"], 9)) for r in found.collect())
    expected = [(i, *labels_of(t, license_scan.PHRASES, license_scan.TEMPLATES, threshold)) for i, t, *_ in rows]
    assert got == Counter((*x[:-1], round(x[-1], 9)) for x in expected)


def test_license_scan_finds_notices_and_leaves_the_rest_alone(spark):
    by_id = {r["doc_id"]: r for r in license_scan.scan_report(documents(spark, license_rows())).collect()}
    assert by_id[501]["labels"] == "cc-by,cc-by-nc" and by_id[504]["labels"] == "mit" and by_id[507]["labels"] == "apache-2.0" and by_id[511]["labels"] == "gpl,gpl-3.0"
    assert by_id[508]["labels"] == "mit" and by_id[509]["labels"] == "mit" and by_id[510]["labels"] == ""
    assert by_id[517]["labels"] == "mit" and by_id[503]["labels"] == by_id[506]["labels"] == ""
    assert all(by_id[i]["labels"] == "" and by_id[i]["score"] == 0 for i in range(40))


def test_license_scan_with_other_templates_and_empty_tables(spark):
    phrases, templates = {"a b": "x", "b": "y"}, (("one", "b c d"), ("two", "q"), ("one", "e f g h i j"))
    rows = [(1, "a b a b c d", "a", "s"), (2, "Q", "a", "s"), (3, "e f g h i", "a", "s"), (4, None, "a", "s"), (4, None, "a", "s")]
    found = license_scan.scan(documents(spark, rows), phrases, templates, 0.8)
    got = Counter((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], ",".join(r["base_labels"]), ",".join(r["labels"]), round(r["score"], 9)) for r in found.collect())
    assert got == Counter((i, *labels_of(t, phrases, templates, 0.8)[:-1], round(labels_of(t, phrases, templates, 0.8)[-1], 9)) for i, t, *_ in rows)
    assert collected(license_scan.scan_report(documents(spark, []))) == []
    with pytest.raises(ValueError, match="more than"):
        license_scan.scan(documents(spark, rows), templates=(("x", "w " * 30_000 + "w"),))


def test_license_scan_runs_without_python(spark):
    plan = license_scan.scan(documents(spark, license_rows()))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
