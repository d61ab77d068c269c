"""A corpus pipeline of five operators: language ID, near-dedup, decontamination, secret redaction, SentencePiece ids.

Each stage takes (spark, docs, sf_dir), decides on every document that the stage before it kept, and returns what it keeps; all
but the last return the columns of documents. Between stages the rows are written as Parquet to the shared folder. Rows with a null id go
through every stage but near-dedup and decontamination, which leave them as they are; empty tables give no rows; further columns, whatever
their names, stay as they are up to the last stage."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rastrum.llm import decontaminate, language_id, secrets, sentencepiece_codec, simhash
from rastrum.llm.common import cut, prepare, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sets ``lang`` to the predicted language; documents without one go: no text, no letter, or a posterior below a half."""
    return language_id.accepted(docs, language_id.train(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of near-duplicates (0.8 or more of their five-word shingles shared) the document with the smallest doc_id."""
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that contain a benchmark item."""
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def secret_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in texts; no document goes."""
    return secrets.redacted(docs).withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars"))).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SentencePiece ids of each document, with the results of decoding and of the comparison with the library. A null or empty text has no
    ids; no document goes; equal rows are encoded one by one; columns besides the returned ones are dropped."""
    return sentencepiece_codec.transcode(docs, keep=["doc_id", "lang", "source", "n_chars"], outputs=("n_tokens", "ids", "round_trip", "parity"))


def _prepared(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    return wraps(stage)(lambda spark, docs, sf_dir: stage(prepare(spark), docs, sf_dir))


STAGES = [(name, _prepared(stage)) for name, stage in (("language_id", language), ("near_dedup", near_dedup), ("decontamination", decontamination), ("secret_scan", secret_redaction), ("sentencepiece", tokens))]

#: Fingerprint groups and token ids can't be expressed in SQL; tests hold the pipeline against a plain version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of every document that all stages keep; empty tables give no rows."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs, name)
    return docs
