"""Odd rows that the operators' docstrings define and no other test has."""

from __future__ import annotations

from pyspark.sql import functions as F

from quantloom.llm import bit_sliced, fill_in_middle, license_scan, link_graph, near_dedup


def test_components_beyond_doubles_take_no_part(spark):
    rows = [(k, [float(k), 1.0]) for k in range(60)] + [(100, [1e308, 0.0]), (150, [-1e308, 1.0]), (200, [7e305, 0.0])]
    found = bit_sliced.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {r["query_id"] for r in found} == {0, 50, 200} and not {r["vec_id"] for r in found} & {100, 150}
    assert {r["rank"]: r["vec_id"] for r in found if r["query_id"] == 50}[1] == 200


def test_pages_without_url_and_html(spark):
    rows = [(1, None, None), (2, None, "<a href='http://x.com/de/'>x</a>"), (None, None, None), (3, "http://a.org/", None)]
    found = link_graph.url_report(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(found) == 4 and all((r["host"], r["path"], r["rule"], r["verdict"]) == ("", "", None, "allow") for r in found if r["page_id"] != 3)


def test_near_copies_of_a_word_without_end(spark):
    rows = [(1, "again " * 300_000), (2, "again " * 200_000), (3, "again again again again"), (4, "again again again again again")]
    found = {r["doc_id"]: r["class_id"] for r in near_dedup.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[1] == found[2] == found[4] == 1 and found[3] == 3  # one shingle of five words, and one of four


def test_a_line_without_end_and_very_many_lines(spark):
    rows = [(1, "x" * 3_000_000), (2, "\n" * 200_000), (3, "all rights reserved " * 50_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"n": F.lit(1), "form": F.lit("x"), "row": F.lit(2), "words": F.lit("y"), "labels": F.lit(None).cast("string")})
    report = {r["doc_id"]: r for r in fill_in_middle.fim_report(docs).collect()}
    whole = {r["doc_id"]: r["sha"] for r in docs.select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha")).collect()}
    assert {i: r["restored_sha256"] for i, r in report.items()} == whole and report[2]["n"] == 200_000 and report[1]["n"] == 1
    found = {r["doc_id"]: r for r in license_scan.scan_report(docs).collect()}
    assert (found[3]["n_words"], found[3]["n_base"], found[3]["first_word"], found[3]["last_word"], found[3]["labels"]) == (150_000, 50_000, 0, 149_997, "reserved")
    assert found[1]["n_words"] == 1 and found[2]["n_words"] == 0 and found[2]["labels"] == ""
