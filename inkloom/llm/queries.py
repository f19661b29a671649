"""The p-queries: each problem's operator over its whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from inkloom.llm import boilerplate, leaks, lookalike, mojibake, quality, scans, split, tokens, toxicity
from inkloom.llm.common import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    results = table(spark, d, "results")
    return lookalike.lookalike_fields(results, lookalike.bigram_scores(results, "markdown", "title"))


def p1_normalized(spark: SparkSession, d: str) -> DataFrame:
    results = table(spark, d, "results")
    return lookalike.canonical_fields(results, "result_id", ["markdown", "title"], lookalike.bigram_scores(results, "markdown", "title"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return mojibake.garbled_records(table(spark, d, "results"))


def p2_restored(spark: SparkSession, d: str) -> DataFrame:
    return mojibake.restored_records(table(spark, d, "results"), table(spark, d, "stream_info"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return boilerplate.furniture_lines(table(spark, d, "results"), table(spark, d, "stream_info"))


def p3_body(spark: SparkSession, d: str) -> DataFrame:
    results = table(spark, d, "results")
    return boilerplate.main_bodies(results, boilerplate.furniture_lines(results, table(spark, d, "stream_info")))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return scans.scan_lines(table(spark, d, "results"), table(spark, d, "warnings"), table(spark, d, "pdf_page"))["found"]


def p4_repaired(spark: SparkSession, d: str) -> DataFrame:
    return scans.repaired(scans.scan_lines(table(spark, d, "results"), table(spark, d, "warnings"), table(spark, d, "pdf_page")))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return quality.not_prose(table(spark, d, "results"), quality.common_set(table(spark, d, "common_words")))


def p5_statistics(spark: SparkSession, d: str) -> DataFrame:
    return quality.text_statistics(table(spark, d, "results"), quality.common_set(table(spark, d, "common_words")))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return split.oversized(table(spark, d, "results"))


def p6_pieces(spark: SparkSession, d: str) -> DataFrame:
    return split.split_pieces(table(spark, d, "results"))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.token_ids(table(spark, d, "documents"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaked_items(table(spark, d, "documents"), table(spark, d, "eval_items"))


def _scores(spark: SparkSession, d: str) -> DataFrame:
    pages = toxicity.window_table(table(spark, d, "documents"))
    return toxicity.toxicity_scores(pages, toxicity.fit(pages, table(spark, d, "labels")))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return _scores(spark, d).where("toxic").select("doc_id")


def p9_scores(spark: SparkSession, d: str) -> DataFrame:
    return _scores(spark, d)


def p9_rates(spark: SparkSession, d: str) -> DataFrame:
    return toxicity.source_rates(_scores(spark, d))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (p1_found, p1_normalized, p2_found, p2_restored, p3_found, p3_body, p4_found, p4_repaired, p5_found, p5_statistics, p6_found, p6_pieces, p7_ids, p8_found, p9_found, p9_scores, p9_rates)
}

SQL: dict[str, str] = {
    "p6_found": "SELECT result_id FROM results WHERE octet_length(encode(markdown)) > 8000",
}
