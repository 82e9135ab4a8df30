"""Corpus pipeline: documents through five stages, each written and read again.

Language identification drops what has no learned language; near-duplicate detection keeps one document of
each class; decontamination drops documents that hold a benchmark item; mixing repeats or drops documents to
meet the sources' targets; the last stage writes token shards and returns one row per stored document.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import budget_mix, bytecnn_langid, cgk_decontam, omh_dedup, sstable_tokens
from weftline.llm.common import scratch, shared_dir, table

#: Below this probability of the best language a text counts as being in none of the learned ones.
MIN_LANGUAGE_SCORE = 0.35


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language learned from the labelled ones outside the held-out fold."""
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")  # whatever its columns are called
    found = bytecnn_langid.identify(docs.select(row), bytecnn_langid.fit(docs), text_col="row.text")
    return found.where((F.col("lang_pred") != bytecnn_langid.UNKNOWN) & (F.col("score") >= MIN_LANGUAGE_SCORE)).select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return omh_dedup.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return cgk_decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the sources' word targets take them."""
    return budget_mix.mix(docs)


def token_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token shards of what is left; one row per stored document."""
    return sstable_tokens.token_table(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", language),
    ("near duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("token shards", token_shards),
]

#: The stages learn a model, search by random sketches and call a tokenizer: SQL cannot express them.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what a stage wrote for itself is deleted with its end, its result and the shards stay."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_dir(spark, "stage-" + name.lower().replace(" ", "-"))
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
