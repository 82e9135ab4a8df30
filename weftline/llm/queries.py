"""The corpus queries: thin callers of the operators, with the digests that their contracts name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import budget_mix, bytecnn_langid, cgk_decontam, gif_media, level_packing, omh_dedup, perspectives, ptolemaic_kmeans, sstable_tokens, toxicity, tree_extract, warc_bundles, whitening
from .common import table


def op1_toxic_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_table(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return omh_dedup.classes(table(spark, sf_dir, "documents"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_bundles.archive_table(table(spark, sf_dir, "pages"))


def op4_gif(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gif_media.media_table(table(spark, sf_dir, "documents"))


def op5_bytecnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bytecnn_langid.language_table(table(spark, sf_dir, "documents"))


def op6_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perspectives.rotation_table(table(spark, sf_dir, "conversations"))


def op7_cgk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cgk_decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree_extract.text_table(table(spark, sf_dir, "pages"))


def op9_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return budget_mix.mix_table(table(spark, sf_dir, "documents"))


def op10_sstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sstable_tokens.token_table(table(spark, sf_dir, "documents"))


def op11_lanczos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened_table(table(spark, sf_dir, "embeddings"))


def op12_level_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return level_packing.pack(table(spark, sf_dir, "documents"), keep_ids=False)


def op13_ptolemaic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ptolemaic_kmeans.cluster_table(table(spark, sf_dir, "embeddings")).drop("checked")


QUERIES = {
    "op1_toxic_segments": op1_toxic_segments,
    "op2_order_minhash": op2_order_minhash,
    "op3_warc": op3_warc,
    "op4_gif": op4_gif,
    "op5_bytecnn": op5_bytecnn,
    "op6_perspectives": op6_perspectives,
    "op7_cgk": op7_cgk,
    "op8_tree": op8_tree,
    "op9_budget": op9_budget,
    "op10_sstable": op10_sstable,
    "op11_lanczos": op11_lanczos,
    "op12_level_packing": op12_level_packing,
    "op13_ptolemaic": op13_ptolemaic,
}

#: DuckDB SQL where SQL can express the operator on whole tables.
ORACLE_SQL: dict[str, str] = {
    "op3_warc": warc_bundles.ORACLE_SQL,
    "op6_perspectives": perspectives.ORACLE_SQL,
    "op13_ptolemaic": ptolemaic_kmeans.oracle_sql(),
}
