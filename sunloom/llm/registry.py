"""Queries of the text operators over the test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sunloom.llm import bpe, langid, mixing
from sunloom.session import table


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.encode(table(spark, folder, "documents"))


def p7_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))


def p7_shares(spark: SparkSession, folder: str) -> DataFrame:
    targets = table(spark, folder, "mix_targets")
    mixed, plans = mixing.mix_with_plans(table(spark, folder, "documents"), targets)
    return mixing.report(mixed, targets, plans)


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return langid.found(table(spark, folder, "documents"))


def p8_languages(spark: SparkSession, folder: str) -> DataFrame:
    return langid.main_languages(table(spark, folder, "documents"))


def p8_parts(spark: SparkSession, folder: str) -> DataFrame:
    """Each document's main language (line 0) and its lines in another one, with their confidence."""
    return langid.label_parts(table(spark, folder, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p6_ids, p7_mix, p7_shares, p8_found, p8_languages, p8_parts)}


def oracle_sql() -> dict[str, str]:
    """Encoding, seeded selection and a fitted model have no SQL; tests compare them otherwise."""
    return {}
