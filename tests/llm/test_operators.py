"""Every training-data operator against a plain statement of what it has to give, on small tables with odd rows."""

from __future__ import annotations

import itertools
import math
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quantloom.llm import bit_sliced, chat_format, language_id, line_dedup, link_graph, lm_score, mixing, near_dedup, packing, quality
from quantloom.llm.queries import tokenizer_file

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, h long, keys string"


def words(n, seed, pool=400):
    rng = random.Random(seed)
    return [f"w{rng.randrange(pool)}" for _ in range(n)]


def documents(spark, rows):
    """rows of (doc_id, text, lang, source); with extra columns whose names clash with inner ones."""
    return spark.createDataFrame([(i, t, lang, s, len(t or ""), -1, -2, "x") for i, t, lang, s in rows], DOCS)


def odd_rows():
    """Null and empty texts, ties, repeated rows, a very long text, null sources and languages."""
    long_text = "\n".join(" ".join(words(40, k)) for k in range(300))
    rows = [(k, " ".join(words(60 + k, k)) + "\n" + " ".join(words(20, k % 5)), "ab"[k % 2], f"s{k % 3}") for k in range(40)]
    rows += [(100, None, None, None), (101, "", "a", None), (102, " \n\t ", None, "s0"), (103, long_text, "b", "s1"), (104, "1 2 3", "a", "s1")]
    return rows + [rows[3], rows[3], (None, "no id here at all", "a", "s2"), (105, rows[5][1], "a", "s2")]


EMPTY = []


def collected(df):
    return [r.asDict() for r in df.collect()]


# --- op1 ---


def test_language_id_learns_and_marks_und(spark):
    rng = random.Random(1)
    syllables = {"a": ["the", "ing", "sh"], "b": ["eau", "ment", "oir"]}
    rows = [(k, " ".join("".join(rng.choice(syllables["ab"[k % 2]]) for _ in range(3)) for _ in range(30)), "ab"[k % 2], "s") for k in range(200)]
    rows += [(900, None, "a", "s"), (901, "123 456 !", "a", "s"), (902, rows[0][1] * 200, "a", "s"), rows[1], rows[1], (None, rows[2][1], "a", "s"), (903, "", "b", "s")]
    docs = documents(spark, rows)
    found = collected(language_id.language_report(docs))
    assert len(found) == len(rows)
    # Every prediction is that of the network, byte by byte.
    network = language_id.fit(docs.where(~F.coalesce(language_id.held_out(), F.lit(False))))
    assert network.labels == ["a", "b"]
    for i, text in ((i, t) for i, t, *_ in rows if i not in (900, 901, 902, 903)):
        p = by_steps(network, text.encode())
        got = [(r["lang_pred"], r["score"]) for r in found if r["doc_id"] == i]
        assert got and all(lang == "ab"[int(p.argmax())] and score == pytest.approx(p.max(), abs=1e-3) for lang, score in got)
    assert next(r for r in found if r["doc_id"] is None)["held_out"] is False
    by_id = {r["doc_id"]: r for r in found}
    assert by_id[900]["lang_pred"] == by_id[901]["lang_pred"] == "und" and by_id[900]["score"] == 0
    assert by_id[902]["lang_pred"] == "a"
    held = [r for r in found if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 200]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in found if r["doc_id"] is not None)
    assert by_id[903]["lang_pred"] == "und"
    assert np.mean([r["lang_pred"] == "ab"[r["doc_id"] % 2] for r in held]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in found)


def test_language_id_gradients_match_differences():
    rng = np.random.default_rng(0)
    network = language_id.Network(["a", "b", "c"], hidden=3)
    for w in network.weights():
        w[:] = rng.normal(0, 0.5, w.shape)
    bytes_, label = rng.integers(0, 256, (7, 5)).astype(np.uint8), np.array([0, 1, 2, 0, 1])
    _, gradients = network.gradients(bytes_, label)
    for w, g in zip(network.weights(), gradients, strict=True):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        kept, losses = w[at], []
        for step in (1e-2, -1e-2):
            w[at] = kept + step
            losses.append(network.gradients(bytes_, label)[0])
        w[at] = kept
        assert g[at] == pytest.approx((losses[0] - losses[1]) / 2e-2, rel=0.05, abs=1e-4)


def by_steps(network, text):
    """Mean of the network's distributions over all bytes, one step at a time."""
    total = np.zeros(len(network.labels))
    for at in range(0, len(text), language_id.WINDOW):
        window = np.frombuffer(text[at : at + language_id.WINDOW], np.uint8)[:, None]
        logits = np.tile(network.bias, (len(window), 1, 1)).astype(np.float32)
        for reader, order in ((network.right, range(len(window))), (network.left, range(len(window) - 1, -1, -1))):
            for t, _, state, *_ in reader.forward(window, order):
                logits[t] += reader.out @ state
        total += language_id.softmax(logits)[:, :, 0].sum(0)
    return total / max(len(text), 1)


def test_language_id_reading_equals_stepping():
    network = language_id.Network(["a", "b"], hidden=4)
    texts = [b"some text " * 40, b"", b"x", "äöü".encode() * 50]
    for text, p in zip(texts, network.pooled(texts), strict=True):
        assert p == pytest.approx(by_steps(network, text), abs=1e-4)


def test_language_id_leaves_no_language_out_and_ties_go_to_the_first(spark, monkeypatch):
    monkeypatch.setattr(language_id, "MOST_WINDOWS", 300)
    docs = documents(spark, [(k, f"text of language {k % 150}", f"l{k % 150:03}", "s") for k in range(600)])
    network = language_id.fit(docs)
    assert len(network.labels) == 150
    for w in network.weights():
        w[:] = 0
    assert {r["lang_pred"] for r in collected(language_id.identify(docs, network))} == {"l000"}


def test_language_id_of_empty_tables(spark):
    assert language_id.language_report(documents(spark, EMPTY)).count() == 0
    unlabelled = collected(language_id.language_report(documents(spark, [(1, "abc", None, "s")])))
    assert unlabelled[0]["lang_pred"] == "und"


# --- op2 ---


def test_lm_counts_and_base_score(spark):
    rows = odd_rows()
    found = collected(lm_score.score_report(documents(spark, rows)))
    assert len(found) == len(rows)

    def tokens(t):
        return [x.translate({c: c + 32 for c in range(65, 91)}) for x in WORD.findall(t or "")] + ["\n"]

    def held(i):
        return i is not None and zlib.crc32(str(i).encode()) % 5 == 1

    counts = Counter(w for i, t, *_ in rows if not held(i) for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    want = defaultdict(list)
    for i, t, *_ in rows:
        base = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens(t))
        want[i].append((held(i), len(tokens(t)), sum(counts[w] > 0 for w in tokens(t)), n, base))
    for r in found:
        got = (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"])
        assert any(got == w[:4] and r["base_score"] == pytest.approx(w[4]) for w in want[r["doc_id"]])
        assert r["score"] < 0


def test_lm_is_a_distribution_and_beats_the_base(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "HEAD", 60)  # so that words beside the head are joined
    rng = random.Random(3)
    rows = []
    for k in range(1500):
        name = "xy"[k % 2]
        rows.append((k, " ".join(f"{name}{min(int(rng.expovariate(0.08)), 80)}" for _ in range(50)), "a", "s"))
    docs = documents(spark, rows)
    fitted = lm_score.fit(docs.where(~lm_score.held_out()))
    found = collected(lm_score.score(docs, fitted))
    held = [r for r in found if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    # All words after one context, and one unseen word for each class, have probability one together.
    vocabulary = [r["word"] for r in fitted.counts.collect()]
    unseen = {}
    for k in itertools.count():
        w = f"unseen{k}{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}"
        unseen.setdefault(lm_score.class_of(w), w)
        if len(unseen) == lm_score.CLASSES:
            break
    every = vocabulary + list(unseen.values())
    model, counts = fitted.model, {r["word"]: r["c"] for r in fitted.counts.collect()}
    total = 0.0
    for w in every:
        t = lm_score.tokens(model, pa.array(["x1 x2" if w == lm_score.END else f"x1 x2 {w}"]))
        lp = lm_score.score_tokens(model, t)[2]
        if t.rank[2] < 0:
            lp += math.log10((counts.get(w, 0) + 0.5) / fitted.tail_totals[lm_score.class_of(w)])
        total += 10**lp
    assert total == pytest.approx(1.0, abs=1e-3)


def scalar_hash(buckets, kind, *parts):
    """The bucket of a feature, in Python's integers."""
    low = (1 << 64) - 1
    x = kind * 0x9E3779B97F4A7C15 & low
    for p in parts:
        x = (x ^ p) * 0xBF58476D1CE4E5B9 & low
        x ^= x >> 29
    x = x * 0x94D049BB133111EB & low
    return (x >> 40) % (buckets - 1) + 1


def by_the_token(model, counts, tails, text):
    """log10 probability of a text, one token and one softmax at a time."""

    def place(w):
        return model.words.index(w) if w in model.words else None

    def number(w):
        at = place(w)
        return lm_score.HEAD + (zlib.crc32(w.encode()) & 0xFFFF) if at is None else at

    def softmax(rows):
        x = np.clip(np.sum(np.array(rows, float), axis=0), -40, 40)
        return np.exp(x) / np.exp(x).sum()

    m, total = len(model.class_weights), 0.0
    before = [lm_score._START] * 3
    for w in [x.translate({c: c + 32 for c in range(65, 91)}) for x in WORD.findall(text or "")] + ["\n"]:
        a, b, c = before
        at = place(w)
        k, slot = (lm_score.class_of(w), 0) if at is None else (int(model.word_class[at]), int(model.slot[at]))
        features = [scalar_hash(m, 1, a), scalar_hash(m, 2, b), scalar_hash(m, 3, a, b), scalar_hash(m, 4, c)]
        p = softmax([model.class_weights[0], *(model.class_weights[f] for f in features)])[k]
        q = softmax([model.slot_weights[f] for f in (k + 1, scalar_hash(m, 11, k, a), scalar_hash(m, 12, k, b))])[slot]
        total += math.log10(p * q) + (0 if slot else math.log10((counts.get(w, 0) + 0.5) / tails[k]))
        before = [number(w), a, b]
    return total


def test_lm_score_is_that_of_the_definition(spark):
    rows = odd_rows() + [(500 + k, " ".join(words(30 + k, k, 60)) + f" Rare{k} ends.", "a", "s") for k in range(60)]
    docs = documents(spark, rows)
    fitted = lm_score.fit(docs.where(~lm_score.held_out()))
    counts = {r["word"]: r["c"] for r in fitted.counts.collect()}
    want = defaultdict(list)
    for i, t, *_ in rows:
        want[i].append(by_the_token(fitted.model, counts, fitted.tail_totals, (t or "")) if i != 103 else None)
    assert any(fitted.model.slot == 0) and any(fitted.model.slot > 0)
    for r in collected(lm_score.score(docs, fitted)):
        if r["doc_id"] != 103:  # too long to do by the token
            assert any(r["score"] == pytest.approx(w, rel=1e-4) for w in want[r["doc_id"]])
        else:
            assert r["n_tokens"] == 12_001 and r["score"] < 0


def test_lm_scores_hardly_depend_on_the_deal(spark):
    rng = random.Random(21)
    rows = [(k, " ".join(f"{'xy'[k % 2]}{min(int(rng.expovariate(0.05)), 90)}" for _ in range(60)), "a", "s") for k in range(400)]
    docs = documents(spark, rows)
    one, many = (lm_score.score_report(docs.repartition(parts)).agg(F.sum("score"), F.sum("base_score"), F.sum("n_known")).first() for parts in (1, 16))
    assert one[0] == pytest.approx(many[0], rel=lm_score.SPREAD) and one[1] == pytest.approx(many[1]) and one[2] == many[2]


def test_lm_of_many_tasks_learns_what_one_task_does(spark, monkeypatch):
    rng = random.Random(22)
    rows = []
    for k in range(1200):
        at, text = rng.randrange(40), []
        for _ in range(60):  # a word mostly tells the next one
            at = (at * 7 + 3) % 40 if rng.random() < 0.7 else rng.randrange(40)
            text.append(f"{'xy'[k % 2]}{at}")
        rows.append((k, " ".join(text), "a", "s"))
    docs, deals = documents(spark, rows).repartition(64), []
    whole = lm_score.train_round
    monkeypatch.setattr(lm_score, "train_round", lambda d, m, number, rounds, tasks: (deals.append((number, rounds, tasks)), whole(d, m, number, rounds, tasks)))
    gains, sums = [], []
    for size in (1 << 19, 1 << 10):
        monkeypatch.setattr(lm_score, "TASK_TOKENS", size)
        found = collected(lm_score.score_report(docs))
        gains.append(sum(r["score"] - r["base_score"] for r in found if r["held_out"]))
        sums.append(sum(r["score"] for r in found))
    assert deals[0] == (0, 2, 1) and len(deals) == 2 + 5 and deals[2][1:] == (5, 11)  # 57 tasks in five rounds
    assert 0 < gains[0] < gains[1] / 0.9 and sums[1] == pytest.approx(sums[0], rel=5 * lm_score.SPREAD)


def test_learner_takes_the_steps_of_a_dense_gradient():
    rng = np.random.default_rng(5)
    model = lm_score.blank(pd.DataFrame({"word": ["a", "b", "c", "\n"], "class": [0, 1, 2, 3], "c": [9, 6, 3, 9], "by": [[1] * 16] * 4}), {})[0]
    t = lm_score.tokens(model, pa.array([" ".join(rng.choice(["a", "b", "c", "z"], 30)) for _ in range(9)]))
    learner = lm_score.Learner(model)
    learner.learn(t, batch=64)
    for which, (table, features, target, bias) in enumerate(((model.class_weights, t.class_features, t.target_class, True), (model.slot_weights, t.slot_features, t.target_slot, False))):
        weights, squares = table.astype(np.float64), np.full(len(table), lm_score.PRIOR)
        for at in range(0, len(target), 64):
            rows = [np.asarray(f[at : at + 64], np.int64) for f in features]
            columns = ([np.zeros(len(rows[0]), np.int64)] if bias else []) + rows
            logits = np.sum([weights[f] for f in columns], axis=0)
            error = np.exp(logits - logits.max(1, keepdims=True))
            error /= error.sum(1, keepdims=True)
            error[np.arange(len(error)), target[at : at + 64]] -= 1
            for f in columns:  # one feature after the other, all from the error before the step
                gradient = np.zeros_like(weights)
                np.add.at(gradient, f, error)
                squares += (gradient**2).mean(1)
                weights -= lm_score.RATE * gradient / np.sqrt(squares)[:, None]
        assert np.abs(weights - table).max() > 0.1 and learner.tables[which] == pytest.approx(weights, abs=2e-4)


def test_lm_hashes_of_words_at_once():
    words = ["", "a", "b.", "?!", "é", "🙂x,", "ab" * 24, "ab" * 25, "z" * 9000, "\n", "tion)"]
    for array in (pa.array(words), pa.array(["other", *words, "more"]).slice(1, len(words)), pa.array(words, pa.large_string())):
        assert lm_score.crc32s(array).tolist() == [zlib.crc32(w.encode()) for w in words]
        assert lm_score.classes_of(array).tolist() == [lm_score.class_of(w) for w in words]
    assert lm_score.crc32s(pa.array([], pa.string())).tolist() == [] and lm_score.classes_of(pa.array([], pa.string())).tolist() == []


def test_lm_of_empty_table(spark):
    assert lm_score.score_report(documents(spark, EMPTY)).count() == 0


# --- op3 ---


def test_url_rules_and_propagation(spark):
    def page(i, url, *targets):
        return (i, url, "".join(f'<a class=x HREF = "{t}">x</a>' for t in targets), "clash")

    rows = [
        page(1, "http://A.org/x", "http://friend.net/", "//friend.net/2"),
        page(2, "https://sub.example.org/en/1x?y#z"), page(3, "https://example.org/es/"), page(4, "https://example.org/en/2"),
        page(5, "ftp://friend.net/q"), page(6, "http://bad.net/", "http://x.com/de/"), page(7, "http://x.com/de/1"), page(8, "http://x.com/fr/1"),
        page(9, None), page(10, "no scheme"), page(11, "http://alone.net"), page(12, "http://notorg/x"), page(13, "http://alone.net/?a://b.org/"),
        page(14, "http://bad.net/", "http://x.com/de/"),
        (15, "http://nohtml.net/", None, "clash"), (None, "http://noid.net/x", "", "clash"), (16, "http://long.net/" + "a" * 100_000 + "?b", "<p>" + "x " * 200_000, "clash"),
    ]
    rows += [rows[4], rows[4]]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    found = {r["page_id"]: r for r in collected(link_graph.url_report(pages))}
    again = collected(link_graph.url_report(pages))
    assert len(again) == len(rows) and len([r for r in again if r["page_id"] == 5 and r["verdict"] == "allow"]) == 3
    got = {i: (r["host"], r["path"], r["rule"], r["verdict"]) for i, r in found.items()}
    assert got[1] == ("a.org", "/x", "org/", "allow")
    assert got[2] == ("sub.example.org", "/en/1x", "example.org/en/1", "block")
    assert got[3][2:] == ("example.org/es/", "block") and got[4][2:] == ("org/", "allow")
    assert got[7][2:] == ("com/de/", "block") and got[8][2:] == ("com/fr/", "allow")
    assert got[9] == ("", "", None, "allow") and got[10] == ("", "", None, "allow")
    assert got[11] == ("alone.net", "", None, "allow") and got[12][2] is None and got[13][:3] == ("alone.net", "/", None)
    assert found[5]["trust"] > 0 and got[5][3] == "allow"  # a trusted host links to it
    assert got[6][3] == got[14][3] == "block"  # it links to a blocked host
    assert got[15] == ("nohtml.net", "/", None, "allow") and got[None][3] == "allow" and len(got[16][1]) == 100_001
    assert link_graph.url_report(pages.limit(0)).count() == 0


def test_propagation_is_personalised_pagerank(spark):
    rng = random.Random(5)
    edges = {(a, b): rng.randrange(1, 4) for a in range(12) for b in range(12) if a != b and a != 7 and rng.random() < 0.25}
    seeds = {0: 3, 4: 1}
    found = link_graph.propagate(
        spark.createDataFrame([(str(a), str(b), n) for (a, b), n in edges.items()], "source string, target string, n long"),
        spark.createDataFrame([(str(h), n) for h, n in seeds.items()], "host string, n long"),
    )
    want = personalised(edges, seeds, 12)
    got = {int(r["host"]): r["rank"] for r in collected(found)}
    assert [got.get(h, 0.0) for h in range(12)] == pytest.approx(list(want), abs=1e-6)


def personalised(edges, seeds, n):
    """The ranks at rest, by iteration in numpy to the last digit."""
    rank = seed = np.array([seeds.get(h, 0) for h in range(n)]) / sum(seeds.values())
    out = np.array([[edges.get((a, b), 0) for b in range(n)] for a in range(n)], float)
    share = out / np.maximum(out.sum(1, keepdims=True), 1)
    for _ in range(400):
        moved = rank @ share
        rank = link_graph.DAMPING * moved + (1 - link_graph.DAMPING * moved.sum()) * seed
    return rank


def test_url_verdicts_are_those_of_the_ranks(spark):
    rng = random.Random(17)
    hosts = ["a.org", "b.org", "c.com", "d.com", *(f"{x}.net" for x in "efghijklmn")]
    rows, edges, allowed, blocked = [], Counter(), Counter(), Counter()
    for k in range(120):
        h = rng.randrange(len(hosts))
        path = rng.choice(["/de/1", "/fr/1", "/x"]) if hosts[h].endswith(".com") else "/x"
        targets = rng.sample(range(len(hosts)), rng.randrange(4))
        rows.append((k, f"http://{hosts[h]}{path}?{k}", "".join(f'<a href="http://{hosts[t]}/">x</a>' for t in targets)))
        edges.update((h, t) for t in targets if t != h)
        allowed[h] += hosts[h].endswith(".org") or path == "/fr/1"
        blocked[h] += path == "/de/1"
    rows += [(1000, None, None), (1001, "http://e.net/", None)]  # neither url nor html
    trust = personalised(edges, allowed, len(hosts))
    distrust = personalised({(b, a): n for (a, b), n in edges.items()}, blocked, len(hosts))
    assert np.abs(trust - distrust).min() > 1e-4  # no verdict hangs on the last digits
    want = {h: "block" if d > t else "allow" for h, t, d in zip(hosts, trust, distrust, strict=True)}
    assert set(want.values()) == {"allow", "block"}
    found = collected(link_graph.url_report(spark.createDataFrame(rows, "page_id long, url string, html string")))
    assert len(found) == 122
    for r in found:
        if r["host"] and r["rule"] is None:
            assert r["verdict"] == want[r["host"]]
            at = hosts.index(r["host"])
            assert (r["trust"], r["distrust"]) == (pytest.approx(trust[at], abs=1e-6), pytest.approx(distrust[at], abs=1e-6))
    assert {(r["host"], r["rule"], r["verdict"]) for r in found if r["page_id"] == 1000} == {("", None, "allow")}


def test_propagation_reaches_the_end_of_a_long_chain(spark):
    edges = {(k, k + 1): 1 for k in range(29)} | {(0, 20): 1}
    found = link_graph.propagate(
        spark.createDataFrame([(str(a), str(b), n) for (a, b), n in edges.items()], "source string, target string, n long"),
        spark.createDataFrame([("0", 2)], "host string, n long"),
    )
    got = {int(r["host"]): r["rank"] for r in collected(found)}
    assert len(got) == 30 and [got[h] for h in range(30)] == pytest.approx(list(personalised(edges, {0: 2}, 30)), abs=1e-6)


# --- op4 ---


def brute_cost(roles):
    """Least cost over all sequences of moves."""
    states = {chat_format.START: 0}
    for role in roles:
        after = {}
        for move in chat_format.MOVES:
            if move[0] in states:
                cost = states[move[0]] + chat_format.move_cost(move, role)
                after[move[1]] = min(cost, after.get(move[1], 1 << 40))
        states = after
    return min(c + chat_format.END[s] for s, c in states.items())


@pytest.mark.parametrize("part_rows", [7, 4096])
def test_chat_repair_is_legal_and_cheapest(spark, part_rows):
    rng = random.Random(8)
    rows = []
    for conv in range(30):
        n = 150 if conv == 11 else rng.randrange(1, 12)  # one holds a third of all rows
        for turn in range(n):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", " User ", "tool", None])
            rows.append((conv, turn, role, None if rng.random() < 0.1 else f"text {conv} {turn}", 5))
    rows += [(99, None, "user", "text 99 7", 1), (99, 0, "user", "text 99 0", 1), (99, 0, "user", "text 99 0", 1), (None, 3, "assistant", "late", 1)]
    given = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, part long")
    repaired = chat_format.repair(given, part_rows)
    found = collected(repaired)
    assert len(found) == len(rows)
    text = {r["conv_id"]: r["text"] for r in collected(chat_format.rendered(repaired))}
    convs = defaultdict(list)
    for r in sorted(found, key=lambda r: r["position"]):
        convs[r["conv_id"]].append(r)
    for conv, turns in convs.items():
        assert [t["position"] for t in turns] == list(range(len(turns)))
        roles, cost = [], 0
        for t in turns:
            known = (t["role"] or "").strip().lower()
            known = known if known in chat_format.ROLES else None
            roles.append(known)
            cost += 3 * (len(t["before"]) + len(t["after"])) + (t["action"] == "merge") + 2 * (known != t["role_out"])
        assert cost == brute_cost(roles)
        shown = re.findall(r"<\|(\w+)\|>\n(.*?)<\|end\|>\n", text[conv], re.S)
        names = [r for r, _ in shown]
        assert "".join(f"<|{r}|>\n{x}<|end|>\n" for r, x in shown) == text[conv]
        names = names[1:] if names[0] == "system" else names
        assert names == ["user", "assistant"] * (len(names) // 2)
        order = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "", r[3] or ""))
        assert re.findall(r"text \d+ \d+|late", text[conv]) == [r[3] for r in order if r[3]]


def test_chat_of_empty_table(spark):
    given = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat_format.repair(given).count() == 0


# --- op5 ---


def test_packing_places_every_piece(spark):
    from tokenizers import Tokenizer

    rows = odd_rows() + [(300, "ÄÖ İstanbul\u00a0e\u0301\u2003x <|endoftext|> y's 12ab", "a", "s")]
    found = collected(packing.pack(documents(spark, rows), tokenizer_file(), capacity=128, sequences=20))
    tokenizer = Tokenizer.from_file(tokenizer_file())
    want = Counter()
    for i, t, *_ in rows:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [1]
        for k, at in enumerate(range(0, len(ids), 128)):
            part = ids[at : at + 128]
            want[i, k, at, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in found) == want
    bins = defaultdict(list)
    for r in found:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 128
    assert len(bins) <= math.ceil(sum(r["length"] for r in found) / 128) + 12
    assert packing.pack(documents(spark, EMPTY), tokenizer_file()).count() == 0


def decreasing(lengths, capacity):
    """How many bins best-fit decreasing takes."""
    return len(packing.filled(sorted(lengths, reverse=True), capacity))


@pytest.mark.parametrize(("low", "high", "n"), [(20, 60, 40), (1, 100, 60), (5, 14, 80), (25, 60, 40)])
def test_swap_search_saves_bins_by_steps_that_raise_squares(low, high, n):
    rng = random.Random(low)
    saved = steps = against = total = 0
    for _ in range(40):
        lengths = [rng.randrange(low, high) for _ in range(n)]
        first = packing.filled(lengths, 100)
        search = packing.SwapSearch(first, lengths, 100)
        after = search.run()
        assert sorted(i for b in after for i in b) == list(range(n))
        fills = [sum(lengths[i] for i in b) for b in after]
        assert max(fills) <= 100 and search.squares[-1] == sum(f * f for f in fills)
        assert all(a < b for a, b in itertools.pairwise(search.squares))
        saved += len(first) - len(after)
        steps += len(search.squares) - 1
        against += len(after) - decreasing(lengths, 100)
        total += len(after)
    assert saved > 0 and steps > saved
    assert against <= 0.025 * total  # about as good as sorting all pieces first


def test_swap_search_ends_where_no_step_is_left():
    rng = random.Random(9)
    for _ in range(20):
        lengths = [rng.randrange(30, 70) for _ in range(14)]
        after = packing.SwapSearch(packing.filled(lengths, 100), lengths, 100).run()
        fills = [sum(lengths[i] for i in b) for b in after]
        if len(after) == -(-sum(lengths) // 100):
            continue
        for a, b in itertools.permutations(range(len(after)), 2):
            if fills[b] >= fills[a]:
                for k in (1, 2):
                    for given in itertools.combinations(after[a], k):
                        for taken in [(), *((i,) for i in after[b])]:
                            if k == 1 or taken:
                                gain = sum(lengths[i] for i in given) - sum(lengths[i] for i in taken)
                                assert not 0 < gain <= 100 - fills[b]


def test_a_step_of_each_kind():
    for bins, lengths, step in (
        ([[0], [1]], [40, 60], (1, [0], [])),
        ([[0, 1], [2, 3]], [38, 50, 60, 30], (1, [0], [3])),
        ([[0, 1], [2, 3]], [20, 15, 30, 60], (1, [0, 1], [2])),
        ([[0, 1], [2, 3]], [50, 10, 60, 40], None),
    ):
        assert packing.SwapSearch(bins, lengths, 100).step(0) == step


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_tokens_are_those_of_whole_texts(name):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path(name)
    texts = [t or "" for _, t, *_ in odd_rows()] + ["It's  what\u00a0they'd\tsay, e\u0301 \u0301x 12ab 3.5!? <|endoftext|>don't", "ÄÖ İstanbul ß\n\n x"]
    tokens, whole = packing.WordTokens(path), Tokenizer.from_file(path)
    assert tokens.alone == name.startswith("word")
    found = tokens.ids(pa.array(texts))
    assert found == [packing._packed(whole.encode(t, add_special_tokens=False).ids) for t in texts]


# --- op6 ---


def test_quality_counts(spark):
    again = " ".join(words(12, 77))
    rows = odd_rows() + [(400, f"{again} x {again}\n#a b$ [c]\n#a b$ [c]\n\u00a0|<&>% *", "a", "s")]
    labels = spark.createDataFrame([(k, 1 if k < 30 else 0, 0) for k in range(40)], "doc_id long, quality int, toxic int")
    found = collected(quality.quality_report(documents(spark, rows), labels))
    assert len(found) == len(rows)
    want = Counter()
    for i, t, *_ in rows:
        w = WORD.findall(t or "")
        windows = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        covered = {k + j for k in range(len(w) - 7) if windows[tuple(w[k : k + 8])] > 1 for j in range(8)}
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        n = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered))
        want[i, *n, len(w) < 20 or 100 * len(covered) > 30 * len(w)] += 1
    assert Counter((r["doc_id"], *(r[c] for c in quality.COUNTS), r["base_failed"]) for r in found) == want
    assert not any(r["kept"] and r["base_failed"] for r in found)


def path_length(tree, row, at=0, depth=0):
    feature, cut, left, length = tree
    if left[at] < 0:
        return length[at]
    return path_length(tree, row, left[at] + (row[feature[at]] > cut[at]), depth + 1)


def test_quality_verdicts_are_those_of_paths_and_the_best_threshold(spark):
    rng = random.Random(14)
    rows = [(k, " ".join(w + ("#" if k % 9 == 0 and rng.random() < 0.7 else "") for w in words(60 + k % 50, k, 2000)), "a", "s") for k in range(250)]
    rows += [(k, " ".join(f"{w}{rng.choice('#.A')}" for w in words(70, 90 + k, 900)), "a", "s") for k in range(250, 280)] + [rows[4], rows[4], (None, rows[7][1], "a", "s")]
    truth = {k: int(k % 9 != 0 and k < 250 or k % 7 == 0) for k in range(270)}
    given = [(k, q, 0) for k, q in truth.items()] + [(5, 1, 0), (5, 1, 0), (6, 0, 0), (6, 1, 0), (None, 0, 0), (8, None, 0)]
    truth.pop(6)  # labelled both ways
    docs, labels = documents(spark, rows), spark.createDataFrame(given, "doc_id long, quality int, toxic int")
    found = collected(quality.quality_report(docs, labels))
    forest = quality.fit_forest(quality.statistics(docs), labels)
    assert len(forest.trees) == quality.TREES
    features = {t: quality.describe(t) for _, t, *_ in rows}
    score = {}
    for t, (*_, row) in features.items():
        mean = sum(path_length(tree, row) for tree in forest.trees) / len(forest.trees)
        score[t] = 2 ** (-mean / quality.expected_path(forest.size))
    fails = {t: f[0] < 20 or 100 * f[4] > 30 * f[0] for t, f in features.items()}
    known = [(math.floor(score[t] * quality.BUCKETS), truth[i]) for i, t, *_ in rows if i in truth and not fails[t]]
    good, bad = [b for b, q in known if q], [b for b, q in known if not q]
    gains = [sum(b >= k for b in bad) / len(bad) - quality.COST_OF_GOOD * sum(b >= k for b in good) / len(good) for k in range(quality.BUCKETS + 1)]
    best = [k for k, g in enumerate(gains) if g == pytest.approx(max(gains), abs=1e-12)]
    threshold = (best[0] + best[-1]) / 2 / quality.BUCKETS if max(gains) > 0 else 2.0
    assert 0 < threshold < 1
    text = defaultdict(list)
    for i, t, *_ in rows:
        text[i].append(t)
    for r in found:
        t = text[r["doc_id"]][0]
        assert r["anomaly"] == pytest.approx(score[t]) and r["kept"] == (not fails[t] and score[t] < threshold)
    assert len({r["kept"] for r in found}) == 2


def test_quality_keeps_clean_and_drops_junk(spark):
    rng = random.Random(4)
    rows, labels = [], []
    for k in range(300):
        clean = k % 6 != 0
        text = " ".join(words(80, k, 3000)) if clean else " ".join(w + rng.choice(["***", "$$$", "&&&"]) for w in words(80, k, 3000))
        rows.append((k, text, "a", "s"))
        labels.append((k, int(clean), 0))
    docs, labels = documents(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    kept = {r["doc_id"] for r in quality.filter_quality(docs, labels).select("doc_id").collect()}
    assert kept == {k for k in range(300) if k % 6} == {r["doc_id"] for r in collected(quality.quality_report(docs, labels)) if r["kept"]}
    assert quality.filter_quality(docs, labels).columns == docs.columns
    assert quality.filter_quality(docs, labels.limit(0)).count() == 300  # nothing to calibrate on
    assert quality.filter_quality(docs.limit(0), labels).count() == 0


# --- op7 ---


def test_mixing_reaches_targets(spark):
    rows = odd_rows() + [(1000 + k, " ".join(words(5 + k % 30, k)), "a", "big" if k % 3 else f"s{k % 7}") for k in range(900)]
    docs = documents(spark, rows)
    found = collected(mixing.mix_report(docs))
    assert len(found) == len(rows)
    sizes = Counter()
    for _, t, _, s in rows:
        sizes[s] += len(WORD.findall(t or ""))
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, open_, rest = {}, set(order), float(sum(sizes.values()))
    while open_:  # share by weight, cap, share again
        level = rest / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] >= 3 * sizes[s]}
        for s in over or open_:
            target[s] = 3.0 * sizes[s] if over else level * weight[s]
            rest -= target[s]
        open_ -= over or open_
    source = {i: s for i, _, _, s in rows}
    taken = Counter()
    for r in found:
        s = source[r["doc_id"]]
        assert r["target"] == pytest.approx(target[s]) and r["source_size"] == sizes[s]
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[s] += r["taken"]
    for s in order:
        assert abs(taken[s] - target[s]) <= max(r["size"] for r in found if source[r["doc_id"]] == s) * 3
    mixed = collected(mixing.mix_documents(docs))
    assert Counter(source[r["doc_id"]] for r in mixed for _ in WORD.findall(r["text"] or "")) == +taken
    assert mixing.mix_documents(docs).columns == docs.columns
    assert mixing.mix_report(docs.limit(0)).count() == 0 == mixing.mix_documents(docs.limit(0)).count()
    assert Counter(map(str, found)) == Counter(map(str, collected(mixing.mix_report(docs.repartition(3)))))


# --- op8 ---


def shingle_set(t):
    w = (t or "").split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else {t}


def shingle_bag(t):
    """Every occurrence of a shingle, told apart by its number."""
    seen, out, w = Counter(), set(), t.split()
    for s in [tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))] if w else [t]:
        out.add((s, seen[s]))
        seen[s] += 1
    return out


def brute_classes(rows, threshold=0.8, shingled=shingle_set):
    texts = sorted({t for i, t, *_ in rows if t is not None and i is not None})
    sets = [shingled(t) for t in texts]
    label = list(range(len(texts)))
    for a, b in itertools.combinations(range(len(texts)), 2):
        both = len(sets[a] & sets[b])
        if both >= threshold * (len(sets[a]) + len(sets[b]) - both):
            old, new = label[b], label[a]
            label = [new if x == old else x for x in label]
    of = dict(zip(texts, label, strict=True))
    groups = defaultdict(set)
    for i, t, *_ in rows:
        if t is not None and i is not None:
            groups[of[t]].add(i)
    return {frozenset(g) for g in groups.values()}


def near_rows(seed=6):
    rng = random.Random(seed)
    rows, common = odd_rows(), words(60, 999, 9000)
    for family in range(12):
        base = words(120, 5000 + family, 9000)
        for k in range(14):
            text = list(base)
            for _ in range(k % 7):
                text[rng.randrange(len(text))] = f"n{rng.randrange(10**6)}"
            rows.append((2000 + family * 20 + k, " ".join(text), "a", "s"))
    for k in range(40):  # a passage that many share, with more or less beside it
        rows.append((4000 + k, " ".join(common + words(2 + 3 * k, 7000 + k, 9000)), "a", "s"))
    return rows


def test_near_classes_are_those_of_all_pairs(spark):
    rows = near_rows()
    found = collected(near_dedup.near_groups(documents(spark, rows)))
    assert len(found) == len(rows)
    groups = defaultdict(set)
    for r in found:
        if r["doc_id"] is not None and r["doc_id"] != 100:
            groups[r["class_id"]].add(r["doc_id"])
            assert r["class_id"] <= r["text_id"] <= r["doc_id"]
    assert {frozenset(g) for g in groups.values()} == brute_classes(rows)
    assert next(r for r in found if r["doc_id"] == 100)["class_id"] == 100  # null text


def test_weighted_near_classes_are_those_of_all_pairs(spark):
    rng = random.Random(16)
    rows = near_rows(7)[:150]
    for family in range(8):
        base = words(40, 8000 + family, 900)
        for k in range(9):  # the same shingles, more or less often
            again = [base[at : at + 12] for at in rng.choices((0, 12, 24), k=rng.randrange(k + 1))]
            rows.append((6000 + family * 20 + k, " ".join([*base, *itertools.chain(*again)]), "a", "s"))
    found = collected(near_dedup.near_groups(documents(spark, rows), by_count=True))
    assert len(found) == len(rows)
    groups = defaultdict(set)
    for r in found:
        if r["doc_id"] is not None and r["doc_id"] != 100:
            groups[r["class_id"]].add(r["doc_id"])
    want = brute_classes(rows, shingled=shingle_bag)
    assert {frozenset(g) for g in groups.values()} == want != brute_classes(rows)


def test_near_dedup_leaves_one_of_each(spark):
    rows = near_rows(9)
    docs = documents(spark, rows)
    stay = near_dedup.first_of_each(docs)
    ids = [r["doc_id"] for r in stay.where("doc_id is not null").collect()]
    assert sorted(ids) == sorted({min(g) for g in brute_classes(rows)} | {100})
    assert stay.where("doc_id is null").count() == sum(r[0] is None for r in rows)
    assert stay.columns == docs.columns and near_dedup.first_of_each(docs.limit(0)).count() == 0


def test_dart_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(1)
    elements = near_dedup.mixed(np.arange(400, dtype=np.uint64) + np.uint64(12345))
    for trial in range(3):
        x, y = rng.gamma(1.0, 2.0, 400) + 0.05, rng.gamma(1.0, 2.0, 400) + 0.05
        y[:250] = x[:250]
        want = np.minimum(x, y).sum() / np.maximum(x, y).sum()
        a, b = near_dedup.signatures([(elements, x), (elements, y)], 4096)
        assert (a == b).mean() == pytest.approx(want, abs=0.05)
    one = near_dedup.signatures([(elements[:1], np.ones(1))], 64)
    assert one.shape == (1, 64) and len(set(one[0])) > 1


def test_signatures_do_not_depend_on_their_company():
    sets = [near_dedup.shingles(" ".join(words(n, n)).encode()) for n in (0, 3, 40, 700)]
    sets = [(e, np.ones(len(e))) for e, _ in sets]
    together = near_dedup.signatures(sets)
    assert all((near_dedup.signatures([s])[0] == t).all() for s, t in zip(sets, together, strict=True))


# --- op9 ---


@pytest.mark.parametrize(("block", "query_block"), [(16, 2), (4096, 4096)])
def test_top_k_is_exact(spark, block, query_block):
    rng = random.Random(7)
    rows = [(k, [rng.gauss(0, 1) for _ in range(6)]) for k in range(120)]
    rows += [(200, rows[4][1]), (201, rows[4][1]), (50, rows[50][1]), (50, rows[7][1]), (202, None), (203, [1.0, None]), (204, [float("nan")] * 6), (205, [float("inf")] * 6), (250, [0.0] * 6), (251, [0.5]), (None, rows[0][1])]
    rows += [(300, [math.inf, 1.0]), (400, [])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("q", F.lit(1)).withColumn("block", F.lit("x"))
    found = collected(bit_sliced.search(vectors, block=block, query_block=query_block))
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in found) == sorted(brute_top(rows))
    assert bit_sliced.search(vectors.limit(0)).count() == 0
    assert bit_sliced.search(vectors.where("vec_id = 100").limit(1)).count() == 0


def brute_top(rows, k=5):
    whole = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    for q, v in dict.fromkeys((q, tuple(v)) for q, v in whole if q % 50 == 0):
        scores = sorted(((sum(a * b for a, b in zip(v, w, strict=False)), -i) for i, w in whole if i != q), reverse=True)[:k]
        yield from ((q, rank + 1, -i, min(max(s, bit_sliced.LEAST), bit_sliced.MOST)) for rank, (s, i) in enumerate(scores))


@pytest.mark.parametrize("huge", [1e6, 1e12, 1e18, 1e30])
def test_top_k_of_huge_components(spark, huge):
    rng = random.Random(11)
    rows = [(k, [rng.gauss(0, 1) * (huge if (k + d) % 3 == 0 else 1) for d in range(4)]) for k in range(70)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = collected(bit_sliced.search(vectors, block=30))
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in found) == sorted(brute_top(rows))


def test_top_k_agrees_with_its_sql_where_ids_repeat(spark, tmp_path):
    import duckdb

    rng = random.Random(12)
    rows = [(k % 90, [rng.gauss(0, 1) for _ in range(5)]) for k in range(200)]
    rows += [rows[0], rows[50], rows[50], (7, None)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    vectors.write.parquet(f"{tmp_path}/v")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/v/*.parquet'")
    want = con.sql(f"SELECT query_id, rank, vec_id, score FROM ({bit_sliced.ORACLE_SQL})").fetchall()
    assert sorted(tuple(r) for r in bit_sliced.search(vectors, block=64).collect()) == sorted(want)


# --- op10 ---


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def line_rows(seed=3):
    rng = random.Random(seed)
    rows, bases = odd_rows(), [words(n, 40 + n, 5000) for n in (3, 7, 8, 9, 12, 20, 31)]
    for k in range(60):
        lines = []
        for _ in range(5):
            line = list(rng.choice(bases))
            for _ in range(rng.randrange(3)):
                at = rng.randrange(len(line))
                change = rng.randrange(3)
                line[at : at + (change > 0)] = [] if change == 1 else [f"z{rng.randrange(50)}"]
            lines.append(("  " if rng.random() < 0.3 else " ").join(line))
        rows.append((600 + k, "\n".join(lines) + rng.choice(["", "\n", "\n\n "]), "a", "s"))
    return rows


def test_line_dedup_is_that_of_all_pairs(spark):
    rows = line_rows()
    found = collected(line_dedup.dedup_report(documents(spark, rows)))
    assert len(found) == len(rows)
    seen, want = [], {}
    for i, t in sorted({(i, t) for i, t, *_ in rows if t is not None}, key=lambda x: (x[0] is not None, x[0] or 0)):  # a null id comes first
        kept = []
        for line in t.split("\n"):
            w = line.split()
            drop = w and any(w == e or max(len(w), len(e)) >= 8 and abs(len(w) - len(e)) < 2 and edit_distance(w, e) <= 1 for e in seen)
            if not drop:
                kept.append(line)
            if w and w not in seen:
                seen.append(w)
        want[i] = "\n".join(kept)
    lines = {(i, t): sum(bool(x.split()) for x in (t or "").split("\n")) for i, t, *_ in rows}
    assert Counter(r["n_lines"] for r in found) == Counter(lines[i, t] for i, t, *_ in rows)
    for r in found:
        assert r["text"] == want.get(r["doc_id"])
        assert r["n_exact"] >= 0 <= r["n_near"]
        left = sum(bool(x.split()) for x in (r["text"] or "").split("\n"))
        assert r["n_lines"] - r["n_exact"] - r["n_near"] == left


def test_line_dedup_carries_columns(spark):
    docs = documents(spark, line_rows(5))
    done = line_dedup.without_repeated_lines(docs)
    assert done.columns == docs.columns and done.count() == docs.count()
    assert done.where("n_chars <> length(text)").count() == 0
    assert line_dedup.without_repeated_lines(docs.limit(0)).count() == 0


def test_a_hot_variant_links_to_its_first(spark):
    base = words(30, 1, 900)
    rows = [(k, " ".join([*base[:11], f"v{k}", *base[12:]]), "a", "s") for k in range(300)]
    found = collected(line_dedup.dedup_report(documents(spark, rows)))
    assert [r["doc_id"] for r in found if r["text"]] == [0] and sum(r["n_near"] for r in found) == 299
