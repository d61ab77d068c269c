"""The registered queries of the corpus operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from .common import prepare, table


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import identify

    return identify(table(spark, sf_dir, "documents"))


def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import find

    return find(table(spark, sf_dir, "documents"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import scan

    return scan(table(spark, sf_dir, "documents"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import scan

    return scan(table(spark, sf_dir, "documents"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import judge

    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import dedup

    return dedup(table(spark, sf_dir, "documents"), with_text=False)


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sentencepiece_codec import transcode

    return transcode(table(spark, sf_dir, "documents"), outputs=("n_chars", "n_tokens", "n_byte_fallback", "ids_sha256", "decoded_sha256", "round_trip", "parity"))


def op4_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sentence_spans import digest

    return digest(table(spark, sf_dir, "documents"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import search

    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def prepared(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        return wraps(f)(lambda spark, sf_dir: f(prepare(spark), sf_dir))

    return {f.__name__: prepared(f) for f in (op1_suffix_dedup, op2_personal_data, op3_sentencepiece, op4_sentence_spans, op5_simhash, op6_quality_rules, op7_secret_scan, op8_decontamination, op9_license_scan, op10_language_id)}


def oracle_sql() -> dict[str, str]:
    from .decontaminate import ORACLE_SQL as leaks
    from .sentence_spans import ORACLE_SQL as spans
    from .suffix_dedup import ORACLE_SQL as repeats

    return {"op1_suffix_dedup": repeats, "op4_sentence_spans": spans, "op8_decontamination": leaks}
