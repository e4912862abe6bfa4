"""Cases in which an operator once did less than its whole job."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quantloom.llm import common, line_dedup, lm_score, near_dedup, packing

# --- op2 ---


def blank_model(buckets):
    shape = (buckets, lm_score.CLASSES)
    nothing = np.zeros(0, np.int64)
    return lm_score.Model([], nothing, nothing, np.zeros(0), np.zeros(0), np.zeros(shape, np.float32), np.zeros((buckets, lm_score.SLOTS), np.float32))


@pytest.mark.parametrize("buckets", [1 << 14, 1 << 18])
def test_lm_sees_the_third_word_before_and_the_skip_in_a_class(buckets):
    model = blank_model(buckets)
    one, other = (lm_score.tokens(model, pa.array([t])) for t in ("p b c d", "q b c d"))

    def differ(kind, place):
        return any(f[place] != g[place] for f, g in zip(getattr(one, kind), getattr(other, kind), strict=True))

    assert differ("class_features", 3)  # three words before
    assert differ("slot_features", 2)  # two words before, not the word before
    assert not differ("class_features", 4) and not differ("slot_features", 3)


def test_lm_learns_from_the_third_word_before():
    kinds = [f"w{k}{chr(97 + k)}" for k in range(8)]
    model = blank_model(lm_score.BUCKETS)
    t = lm_score.tokens(model, pa.array([f"{kinds[k % 8]} x x {kinds[k % 8]}" for k in range(800)]))
    learner = lm_score.Learner(model)
    for _ in range(60):
        learner.learn(t)
    found = lm_score._probabilities(learner.tables[0], t.class_features, True)
    told = found[np.arange(3, len(t.which), 5), t.target_class[3::5]]
    assert told.min() > 0.5  # one in eight without it


def test_lm_centres_are_means_of_all_documents(spark):
    kinds = [[f"{chr(97 + k)}{i}" for i in range(9)] for k in range(4)]
    texts = [" ".join(kinds[i % 4][(i * j) % 9] for j in range(1, 2 + i % 7)) if i % 50 else None for i in range(6000)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    centres = lm_score.fit_centroids(docs, 4, 100)
    rows = lm_score.profiles(*lm_score.numbered(pa.array(texts, pa.string())))
    own = lm_score.nearest(rows, centres)
    held = [rows[own == j] for j in range(4)]
    assert sum(map(len, held)) == 6000 and min(map(len, held)) > 0
    assert (centres == np.rint([h.sum(0) / len(h) for h in held])).all()  # whichever document is left out, a mean moves
    assert (lm_score.fit_centroids(docs.repartition(7), 4, 100) == centres).all()


def test_lm_centres_of_few_and_of_equal_documents(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, None)], "doc_id long, text string")
    centres = lm_score.fit_centroids(docs, 4)
    rows = lm_score.profiles(*lm_score.numbered(pa.array(["a b", "a b", None])))
    assert (centres[lm_score.nearest(rows, centres)] == rows).all()
    assert (lm_score.fit_centroids(docs.limit(0), 4) == 0).all()


def test_lm_buckets_follow_the_training_tokens():
    assert [lm_score.buckets_for(n) for n in (0, 1 << 24, (1 << 24) + 1, 1 << 26, (1 << 26) + 1, 1 << 32, 1 << 40)] == [1 << 14, 1 << 14, 1 << 15, 1 << 15, 1 << 16, 1 << 18, 1 << 18]
    assert [lm_score.task_tokens(n) for n in (0, 1 << 24, 1 << 26, 1 << 40)] == [1 << 19, 1 << 19, 1 << 20, 1 << 23]
    assert [lm_score.rounds_for(n) for n in (0, 1 << 22, (1 << 22) + 1, 1 << 24, 1 << 26, 1 << 33)] == [2, 2, 3, 4, 5, 9]
    f = np.random.default_rng(1).integers(0, 1 << 18, 5000).astype(np.uint32)
    assert (lm_score._order(f) == np.argsort(f, kind="stable")).all()


def test_lm_sums_of_runs():
    rng = np.random.default_rng(3)
    for sizes in ([1], [1, 2, 3, 8, 9, 40, 1, 7], rng.integers(1, 30, 50).tolist()):
        rows, starts = rng.normal(size=(sum(sizes), 5)), np.cumsum([0, *sizes[:-1]])
        assert lm_score.run_sums(rows, starts) == pytest.approx(np.add.reduceat(rows, starts, axis=0))


def test_lm_sums_of_runs_need_no_sorted_copy():
    rng, space = np.random.default_rng(4), lm_score.Space()
    for sizes in ([1, 2, 3, 8, 9, 40, 1, 7], [1], rng.integers(1, 30, 50).tolist()):
        rows, starts = rng.normal(size=(sum(sizes), 5)), np.cumsum([0, *sizes[:-1]])
        order = rng.permutation(len(rows))
        found = lm_score.run_sums(rows, starts, order=order, space=space)
        assert found == pytest.approx(np.add.reduceat(rows[order], starts, axis=0))


def test_lm_space_is_used_again_without_traces():
    rng, space = np.random.default_rng(5), lm_score.Space()
    weights = rng.normal(size=(40, lm_score.CLASSES)).astype(np.float32)
    for n in (lm_score.CACHED + 3, 7, 0, 2 * lm_score.CACHED):
        features = [rng.integers(0, 40, n).astype(np.uint16) for _ in range(3)]
        logits = np.exp(sum(weights[f].astype(float) for f in features) + weights[0])
        found = lm_score._probabilities(weights, features, True, space)
        assert found == pytest.approx(logits / logits.sum(1, keepdims=True), rel=1e-4)
    assert np.shares_memory(found, lm_score._probabilities(weights, features, True, space))


def test_lm_profiles_are_stored_many_in_a_row(spark, monkeypatch):
    written, kept = {}, lm_score.stored
    monkeypatch.setattr(lm_score, "stored", lambda df, tag: written.setdefault(tag, kept(df, tag)))
    docs = spark.range(0, 1000, 1, 2).selectExpr("id doc_id", "concat('a', id % 7, ' b', id % 3) text")
    assert len(lm_score.fit_centroids(docs, 4)) == 4
    rows = [r[0] for r in written["lm-profiles"].collect()]  # passes over them are paid by the row
    assert len(rows) <= 1000 // lm_score.ROW_PROFILES + 2 and sum(map(len, rows)) == 1000 * 2 * lm_score.PROFILE


def test_lm_counts_by_cluster_are_kept_of_the_head_only(spark):
    texts = ["a b a", "B c", None, "c c d", "a"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    centres = lm_score.fit_centroids(docs, lm_score.CLUSTERS)
    by_cluster = lm_score.count_words(docs, centres)
    expected = {}
    for t in texts:
        words, which, sizes = lm_score.numbered(pa.array([t], pa.string()))
        own = int(lm_score.nearest(lm_score.profiles(words, which, sizes), centres)[0])
        for w in which.tolist():
            by = expected.setdefault(words[w].as_py(), [0] * lm_score.CLUSTERS)
            by[own] += 1
    assert {(r["word"], r["cluster"]): r["c"] for r in by_cluster.collect()} == {(w, k): n for w, by in expected.items() for k, n in enumerate(by) if n}
    head = by_cluster.groupBy("word", "class").agg({"c": "sum"}).withColumnRenamed("sum(c)", "c").where("c > 1")
    found = {r["word"]: (r["class"], r["c"], r["by"]) for r in lm_score.with_clusters(head, by_cluster).collect()}
    assert found == {w: (lm_score.class_of(w), sum(by), by) for w, by in expected.items() if sum(by) > 1}


# --- op8, op10 ---


@pytest.mark.parametrize("bits", [1 << 15, 1 << 20])
def test_a_filter_never_denies_a_member(spark, monkeypatch, bits):
    monkeypatch.setattr(common, "FILTER_BITS", bits)
    rows = spark.range(6000).select("id", F.xxhash64("id").alias("h"))
    members = rows.where("id % 3 = 0")
    held = common.BitFilter(members, "h")
    assert held.last + 1 == min(bits, 1 << 15)  # sixteen bits for each of 2000 members, if there may be so many
    passed = {r["id"] for r in rows.where(held.column(F.col("h"))).collect()}
    assert passed >= {r["id"] for r in members.collect()}
    wrongly = len(passed) - 2000
    assert abs(wrongly / 4000 - (1 - np.exp(-2000 / (held.last + 1)))) < 0.03
    assert rows.where(common.BitFilter(members.limit(0), "h").column(F.col("h"))).count() == 0


def lines_near_each_other():
    line = "one two three four five six seven eight nine"
    return [(k, f"{line}\n{line.replace('five', f'other{k}')}\nown words of {k}") for k in range(20)]


def test_results_do_not_depend_on_what_filters_let_pass(spark, monkeypatch):
    lines = spark.createDataFrame(lines_near_each_other(), "doc_id long, text string")
    base = [f"w{k}" for k in range(80)]
    near = spark.createDataFrame([(k, " ".join([*base[: 70 + k % 8], *(f"x{k}y{j}" for j in range(k % 11))])) for k in range(60)], "doc_id long, text string")

    def found():
        return sorted(line_dedup.dedup_report(lines).collect()), sorted(near_dedup.near_groups(near).collect())

    sharp = found()
    monkeypatch.setattr(line_dedup, "BitFilter", AllPass)
    monkeypatch.setattr(near_dedup, "BitFilter", AllPass)
    assert found() == sharp and sum(r["n_near"] for r in sharp[0]) > 0


class AllPass:
    """A filter whose bits are all set."""

    def __init__(self, members, column):
        pass

    def holds(self, hashes):
        return np.ones(len(hashes), bool)

    def column(self, hashes):
        return F.lit(True)


def test_near_dedup_tells_the_texts_of_an_id_apart(spark):
    a, b, c = (" ".join(f"{name}{k}" for k in range(60)) for name in "abc")
    rows = [(1, a), (1, b), (1, None), (1, c), (1, c), (2, b), (3, b + " more"), (4, a + " more"), (5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    stay = near_dedup.first_of_each(docs).collect()
    assert sorted((r["doc_id"], r["text"] or "") for r in stay) == sorted([(1, a), (1, b), (1, c), (1, ""), (5, "")])
    found = near_dedup.near_groups(docs).where("text_digest is not null").collect()
    class_of = {(r["doc_id"], bytes(r["text_digest"])): bytes(r["class_text"]) for r in found}
    digest = {t: near_dedup.digest_of(t.encode()) for _, t in rows if t}
    assert class_of == {(i, digest[t]): digest[next(x for x in (a, b, c) if t.startswith(x))] for i, t in rows if t}


def template_documents(spark, n, own=40, common=200):
    """Documents of one template, none of them near copies: their signatures meet, their sets do not suffice."""
    template = " ".join(f"t{k}" for k in range(common))
    rest = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(own - 1)), lambda k: F.concat(F.lit("o"), F.col("id").cast("string"), F.lit("_"), k.cast("string"))), " ")
    return spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit(template + " "), rest).alias("text"))


def test_documents_of_one_template_make_no_pairs(spark, monkeypatch):
    """What is indexed of a set ends before the template begins."""
    made = {}
    real = near_dedup.stored
    monkeypatch.setattr(near_dedup, "stored", lambda df, tag: made.setdefault(tag, real(df, tag)) if tag in ("near-several", "near-more") else real(df, tag))
    found = near_dedup.near_groups(template_documents(spark, 1500))
    assert found.where("doc_id <> class_id").isEmpty() and found.count() == 1500
    assert made["near-several"].isEmpty() and made["near-more"].isEmpty()


def test_a_large_class_is_not_paired_with_itself(spark, monkeypatch):
    """300 near copies and two others that share a passage with them: only pairs of different classes are compared."""
    made = {}
    real = near_dedup.stored
    monkeypatch.setattr(near_dedup, "stored", lambda df, tag: made.setdefault(tag, real(df, tag)) if tag == "near-more" else real(df, tag))
    base, rows = [f"b{k}" for k in range(200)], []
    for k in range(300):
        rows.append((k, " ".join([*base, f"x{k}"])))
    rows += [(1000 + k, " ".join([*base[:150], *[f"y{k}_{j}" for j in range(45)]])) for k in range(2)]
    found = {r["doc_id"]: r["class_id"] for r in near_dedup.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {found[k] for k in range(300)} == {0} and found[1000] == 1000 and found[1001] == 1001
    assert not made or made["near-more"].where("a < 300 and b < 300").isEmpty()


# --- op5 ---


def test_packing_gathers_ids_of_words_as_a_join_would():
    rng = np.random.default_rng(5)
    held = [rng.integers(0, 1 << 32, n, dtype=np.uint32).astype("<u4").tobytes() for n in (0, 3, 1, 0, 7, 2)]
    flat, sizes = np.frombuffer(b"".join(held), "<u4"), np.array([len(h) // 4 for h in held])
    for n in (0, 1, 500):
        which = rng.integers(0, len(held), n)
        ids, ends = packing.gathered(flat, sizes, which)
        assert ids.tobytes() == b"".join(held[i] for i in which) and ends.tolist() == np.cumsum(sizes[which]).tolist()


# --- op10 ---


def test_line_halves_are_those_of_joined_words():
    def hashed(words, seed):
        return line_dedup._short(b" ".join(words), seed)

    for n in range(1, 12):
        words = [b"w%d" % (k % 3) * (1 + k % 2) for k in range(n)]
        k = n // 2
        firsts, lasts = ((k, k + 1), (k,)) if n % 2 else ((k,), (k - 1, k))
        want = [(hashed(words[:i], 1), i, n) for i in firsts] + [(hashed(words[n - i :], 2), 0, n - i) for i in lasts]
        assert line_dedup.halves(words) == line_dedup.halves(words, b" ".join(words)) == want


def test_lines_of_a_batch_are_held_joined():
    texts = [b"a b\n\n c  d e f g h i j \nz", None, b"", b"q r s t u v w x"]
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3, 4]), pa.array([5, 6, 7, 8]), pa.array(texts, pa.binary())], ["id", "part", "text"])
    found = line_dedup._Lines(batch, 8)
    assert found.words == [b"a b", b"c d e f g h i j", b"z", b"q r s t u v w x"]
    assert found.lengths.tolist() == [2, 8, 1, 8] and found.sizes.tolist() == [0, 3, 0, 3]
    assert found.columns["id"].tolist() == [1, 1, 1, 4] and found.columns["line"].tolist() == [0, 2, 3, 0]
    want = [h for w in (found.words[1], found.words[3]) for h in line_dedup.halves(w.split())]
    assert list(zip(found.flat.tolist(), found.low.tolist(), found.high.tolist(), strict=True)) == want
    assert len(line_dedup._Lines(batch.slice(1, 2), 8).flat) == 0
