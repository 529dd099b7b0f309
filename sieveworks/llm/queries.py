"""The registered queries of this subpackage, one for each operator: whole tables, production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, divergence, embeddings, html_text, language_model, toxicity, trie_bpe, url_filter, vector_codes, warc
from .base import fold, shared_path, table
from .decontaminate import leaks
from .near_dedup import near_duplicates
from .oracles import ORACLES
from .token_counts import TokenizerFile, token_counts

#: The listed rules of op1, beside which the pattern rules decide.
URL_RULES = [
    *(url_filter.Rule.prefix(text, action) for text, action in (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))),
    *(url_filter.Rule.word(w, "block") for w in url_filter.SPAM_WORDS),
]
#: Scores from here on are toxic.
TOXIC = 0.7


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def toxicity_model(docs: DataFrame, sf_dir: str) -> toxicity.ToxicityModel:
    return toxicity.train(docs, table(docs.sparkSession, sf_dir, "labels"), fold("doc_id", 3) != 1)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity_model(docs, sf_dir))
    held_out = F.coalesce(fold("doc_id", 3) == 1, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= TOXIC).cast("int").alias("predicted"), "hits")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    # A cache of this call alone: what the query does never depends on earlier calls.
    tokenizer = TokenizerFile(public_tokenizers.path("byte_bpe_50k.json"))
    return token_counts(table(spark, sf_dir, "documents"), tokenizer, shared_path(spark, "token-counts"))


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score(table(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    path = shared_path(spark, "warc")
    warc.write_archives(pages, path, warc.train_dictionary(pages))
    return warc.read_archives(spark, path, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    coded = bpe.encode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN, decode=True)
    return coded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = vector_codes.compress(table(spark, sf_dir, "embeddings"))
    return coded.select("vec_id", "code", "error", "label_error", F.lit(vector_codes.digest(books)).alias("codebooks_sha256"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(table(spark, sf_dir, "documents"))


def op13_trie_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokenizer = trie_bpe.load(public_tokenizers.path("byte_bpe_50k.json"))
    coded = trie_bpe.encode(table(spark, sf_dir, "documents"), tokenizer, decode=True)
    return coded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(table(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_url_filters,
        op2_embedding_near_dedup,
        op3_benchmark_decontamination,
        op4_toxicity,
        op5_token_counts,
        op6_lm_scoring,
        op7_warc,
        op8_minhash_near_dedup,
        op9_byte_bpe,
        op10_html_extraction,
        op11_vector_codes,
        op12_source_divergence,
        op13_trie_bpe,
    )
}

__all__ = ["ORACLES", "QUERIES", "TOXIC", "URL_RULES", "toxicity_model"]
