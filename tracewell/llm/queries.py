"""Queries of the text operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracewell.llm import handwritten, leakage, packing, subjects, syntax_check
from tracewell.sources.tables import table


def _checked(spark: SparkSession, d: str) -> DataFrame:
    return syntax_check.checked_files(table(spark, d, "source_files"), ["file_id", "repository_id"], "language", "relative_path", "source_text")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _checked(spark, d).where("status in ('wrong_language', 'corrupt')").select("file_id").distinct()


def p6_rates(spark: SparkSession, d: str) -> DataFrame:
    return syntax_check.syntax_rates(_checked(spark, d), "repository_id")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return handwritten.not_handwritten(table(spark, d, "source_files")).select("file_id")


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_documents(table(spark, d, "documents"), "doc_id", "text")


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    return packing.packing_report(p8_containers(spark, d))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked_items(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "eval_items"), "item_id", "item_text")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return subjects.document_subjects(table(spark, d, "documents"), table(spark, d, "doc_labels"))


QUERIES = {"p6_found": p6_found, "p6_rates": p6_rates, "p7_found": p7_found, "p8_containers": p8_containers, "p8_report": p8_report, "p9_found": p9_found, "p10_found": p10_found}

SQL: dict[str, str] = {}  # none of these can be said in SQL
