"""A corpus pipeline of five stages over the documents table.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's documents. All but the last return the columns of documents.

Defined cases: a null, empty or wordless text fails the quality rules (fewer than 50 words) and goes; rows with a null id are
ruled, stripped of repeated lines and decontaminated like any other, sort last where the first occurrence stays, and are
never dropped as near copies; rows equal in id and text get equal results until near-dedup keeps one of them; of a group of
near copies the smallest id stays; very long texts are worked on whole; empty tables give empty results; extra columns are
kept up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchgrid.llm import decontamination, line_dedup, near_copies, piece_codec, suffix_repetition
from pitchgrid.llm.registry import piece_model
from pitchgrid.llm.storage import materialised


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the base rules and the repetition limits keep."""
    return suffix_repetition.quality_rules(docs).where("kept").select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated runs of lines go; so do documents of which nothing but white space is left."""
    done = line_dedup.run_dedup(docs)
    done = done.where((F.col("n_removed_lines") == 0) | (F.length(F.btrim("text", F.lit(decontamination.WHITE))) > 0))
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.when(F.col("n_removed_lines") > 0, F.length("text").cast("bigint")).otherwise(F.col("n_chars")))
    return done.select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, by five-word shingles of similarity 0.8 or more: the one with the smallest id."""
    return near_copies.drop_near_copies(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, checked by decoding them."""
    return piece_codec.encode_and_check(docs, piece_model())


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", dedup_lines),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontaminate),
    ("sentencepiece", encode),
]

#: Fingerprints and merges are beyond SQL; the tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = materialised(stage(spark, docs, sf_dir))
    return docs
