"""Queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchgrid.llm import ball_trees, chat_format, decontamination, line_dedup, merkle, minhash, piece_codec, secret_scan, simhash, site_quality, suffix_dedup, suffix_repetition, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    ruled = suffix_repetition.quality_rules(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return ruled.drop("text", "longest_repeat")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_digests(secret_scan.scan_secrets(_table(spark, sf_dir, "documents").select("doc_id", "text")))


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    chats = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.range(2).selectExpr(
        f"cast({chat_format.PLANTED_ID} as bigint) as conv_id", "id as turn", "if(id = 0, 'user', 'assistant') as role"
    ).withColumn("text", F.lit(chat_format.PLANTED_TEXT))
    return chat_format.chat_digests(chat_format.format_chats(chats.unionByName(planted)))


def piece_model() -> str:
    """The SentencePiece model that the query and the pipeline use: the folder of public tokenizers, or PITCHGRID_TOKENIZERS."""
    return os.path.join(os.environ.get("PITCHGRID_TOKENIZERS", "/opt/tokenizers"), "piece_bpe_32k.model")


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.encode_and_check(_table(spark, sf_dir, "documents"), piece_model())


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, _table(spark, sf_dir, "labels"))
    scored = toxicity.score_toxicity(docs, model)
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op8_site_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document's source stands for its host, its language for the first part of its path."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    return site_quality.site_quality(docs, _table(spark, sf_dir, "labels"), F.col("source"), F.col("lang"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup_digests(suffix_dedup.suffix_dedup(_table(spark, sf_dir, "documents").select("doc_id", "text")))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontamination.contaminated(docs, _table(spark, sf_dir, "benchmark").select("item_id", "text"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.tampering_digests(_table(spark, sf_dir, "documents").select(*merkle.COLUMNS))


def op12_ball_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ball_trees.cluster_digests(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op13_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.minhash_classes(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_line_dedup, op2_simhash, op3_quality_rules, op4_secret_scan, op5_chat_formatting, op6_sentencepiece, op7_toxicity, op8_site_quality, op9_suffix_dedup, op10_decontamination, op11_merkle_manifest, op12_ball_clusters, op13_minhash)}


def oracle_sql() -> dict[str, str]:
    return {"op3_quality_rules": suffix_repetition.ORACLE_SQL, "op1_line_dedup": line_dedup.ORACLE_SQL, "op5_chat_formatting": chat_format.ORACLE_SQL, "op10_decontamination": decontamination.ORACLE_SQL, "op11_merkle_manifest": merkle.ORACLE_SQL, "op12_ball_clusters": ball_trees.ORACLE_SQL, "op13_minhash": minhash.ORACLE_SQL}
