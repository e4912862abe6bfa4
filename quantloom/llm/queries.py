"""The operators as registered queries: each over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quantloom.llm import bit_sliced, chat_format, fill_in_middle, impact_index, language_id, license_scan, line_dedup, link_graph, lm_score, mixing, near_dedup, packing, quality
from quantloom.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_file() -> str:
    """The default vocabulary; every operator takes another path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_report(table(spark, sf_dir, "documents"))


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score_report(table(spark, sf_dir, "documents"))


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_graph.url_report(table(spark, sf_dir, "pages"))


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.format_report(table(spark, sf_dir, "conversations"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_file())


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(table(spark, sf_dir, "documents"))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_groups(table(spark, sf_dir, "documents")).select("doc_id", "class_id")


def op9_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bit_sliced.search(table(spark, sf_dir, "embeddings"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_report(table(spark, sf_dir, "documents"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle.fim_report(table(spark, sf_dir, "documents"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return impact_index.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_report(table(spark, sf_dir, "documents"))


OPERATORS = (
    op1_language_id,
    op2_lm_scoring,
    op3_url_filters,
    op4_chat_formatting,
    op5_best_fit_packing,
    op6_quality_rules,
    op7_source_mixing,
    op8_near_dedup,
    op9_exact_top_k,
    op10_line_dedup,
    op11_fill_in_middle,
    op12_lexical_search,
    op13_license_scan,
)


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in OPERATORS}


def oracle_sql() -> dict[str, str]:
    """For those that SQL can express; the others are held against brute force in tests."""
    return {
        "op7_source_mixing": mixing.ORACLE_SQL, "op9_exact_top_k": bit_sliced.ORACLE_SQL,
        "op11_fill_in_middle": fill_in_middle.ORACLE_SQL, "op12_lexical_search": impact_index.ORACLE_SQL,
        "op13_license_scan": license_scan.ORACLE_SQL,
    }
