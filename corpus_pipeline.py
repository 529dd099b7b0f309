"""A training-data pipeline of four stages over documents; each stage's rows feed the next."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveworks.llm import bpe, toxicity
from sieveworks.llm.base import join_checked, shared_path, small_batches, table
from sieveworks.llm.decontaminate import drop_leaks
from sieveworks.llm.near_dedup import keep_one
from sieveworks.llm.queries import TOXIC, toxicity_model

#: Documents are near copies from this similarity of their sets of five-word shingles on, in percent.
SIMILARITY = 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without the documents that score as toxic. Rows that repeat a doc_id go together, rows
    without one stay."""
    toxic = toxicity.score(docs, toxicity_model(docs, sf_dir)).where(F.col("score") >= TOXIC)
    return join_checked(docs, toxic.select("doc_id").distinct(), "doc_id", "left_anti", 16).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with one document of each group of near copies, the one with the smallest doc_id."""
    small_batches(spark)
    return keep_one(docs, percent=SIMILARITY)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without the documents that contain an item of the benchmark."""
    return drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row (doc_id, n_tokens, ids, round_trip) for each document: the token ids of its whole text as
    little-endian unsigned 32-bit integers, and whether they decode to it."""
    small_batches(spark)
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    coded = bpe.encode(docs, ranks, public_tokenizers.PATTERN, decode=True, keep_text=True)
    same = F.col("decoded") == F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return coded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", same.alias("round_trip"))


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash_near_dedup", drop_near_copies),
    ("benchmark_decontamination", drop_contaminated),
    ("byte_bpe", encode),
]

#: SQL cannot score toxicity or encode; tests hold the pipeline against its stages' brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over documents, each written as Parquet and read back."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = shared_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
