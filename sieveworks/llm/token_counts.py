"""Token counts behind a digest cache.

Content is normalised (null to the empty text, then UTF-8) and digested. A digest and the
digest of the tokenizer file with its library's version are joined to the counts stored in a
Parquet table; texts of distinct digests that are missing there are encoded and their counts
appended. Only digests and numbers are shuffled, not texts, unless the digests to look up are
too many for a size-checked broadcast.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .base import join_checked, materialize, released
from .bpe import piece_pattern

CACHE_SCHEMA = T.StructType(
    [T.StructField("content", T.BinaryType()), T.StructField("tokenizer", T.StringType()), T.StructField("n_tokens", T.LongType())]
)
#: Pieces whose counts a worker remembers, and characters of text that it splits at a time.
PIECES, SLICE_CHARS = 1 << 18, 1 << 19


class TokenizerFile:
    """A tokenizer's file, by its bytes, and which library reads it: .json or .model."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.data = f.read()
        self.kind = os.path.splitext(path)[1]
        if self.kind == ".json":
            import tokenizers as library
        elif self.kind == ".model":
            import sentencepiece as library
        else:
            raise ValueError(f"no library for {path}")
        self.digest = hashlib.sha256(self.data + f"|{library.__name__} {library.__version__}".encode()).hexdigest()

    def counter(self) -> Callable[[list[str]], list[int]]:
        if self.kind == ".model":
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_proto=self.data)
            return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tokenizers

        tokenizer = tokenizers.Tokenizer.from_str(self.data.decode())
        tokenizer.no_truncation()
        tokenizer.no_padding()
        whole = lambda texts: [len(x) for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return _by_pieces(json.loads(self.data), whole) or whole


def _by_pieces(config: dict, whole: Callable[[list[str]], list[int]]) -> Callable[[list[str]], list[int]] | None:
    """For byte-level tokenizers, whose pieces are encoded separately: the same counts, with each
    distinct piece encoded once. Texts that hold an added token's string go to the library whole."""
    pre = config.get("pre_tokenizer") or {}
    plain = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
    if not plain or config.get("normalizer") or config.get("model", {}).get("dropout"):
        return None
    # Fixed value: the splitting pattern of byte-level tokenizers.
    find = piece_pattern(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""").findall
    added = [x["content"] for x in config.get("added_tokens", [])]
    known: dict[str, int] = {}

    def count(texts: list[str]) -> list[int]:
        pieces = [None if any(a in t for a in added) else find(t) for t in texts]
        if len(known) > PIECES:
            known.clear()
        new = list({p for doc in pieces if doc for p in doc if p not in known})
        known.update(zip(new, whole(new), strict=True))
        return [whole([t])[0] if p is None else sum(map(known.__getitem__, p)) for t, p in zip(texts, pieces, strict=True)]

    return count


def _counts(tokenizer: TokenizerFile):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = tokenizer.counter()
        for b in batches:
            n: list[int] = []
            texts: list[str] = []
            chars = 0
            for t in b.column("text"):
                texts.append(t.as_py() or "")
                chars += len(texts[-1])
                if chars >= SLICE_CHARS:
                    n += count(texts)
                    texts, chars = [], 0
            if texts:
                n += count(texts)
            yield pa.RecordBatch.from_arrays([b.column("content"), pa.array(n, pa.int64())], names=["content", "n_tokens"])

    return run


def token_counts(docs: DataFrame, tokenizer: TokenizerFile, cache: str, limit: int = 512) -> DataFrame:
    """A row (doc_id, n_bytes, n_tokens, over_limit) for each row of docs(doc_id, text, ...).

    n_tokens is what the tokenizer's library gives for the whole text without added tokens; null
    texts count as empty. over_limit: n_tokens > limit. cache: a Parquet folder on storage that all
    executors share; it may not exist yet. Counts found there are used, missing ones are appended,
    each distinct text encoded once (rows with a null doc_id are encoded one by one). A job that
    dies before its append commits leaves the cache as it was. Further columns are ignored, repeated
    rows give repeated results, an empty table gives no rows."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn("content", F.unhex(F.sha2("text", 256)))
    keyed = materialize(read.select("doc_id", "content", F.octet_length("text").cast("long").alias("n_bytes")))
    spark.createDataFrame([], CACHE_SCHEMA).write.mode("append").parquet(cache)

    def stored() -> DataFrame:
        rows = spark.read.schema(CACHE_SCHEMA).parquet(cache).where(F.col("tokenizer") == tokenizer.digest)
        return rows.groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))

    first = keyed.groupBy("content").agg(F.min("doc_id").alias("pick"), F.count("*").alias("n"))
    first = materialize(first)
    hits = materialize(first.select("content").join(stored(), "content", "left_semi"))
    missing = first.join(hits.hint("merge"), "content", "left_anti")
    again = join_checked(keyed.select("content", "doc_id"), missing.where("n > 1").select("content", "pick"), "content", "inner", 80)
    again = again.where("doc_id <> pick").select("content", "doc_id")
    # Whichever is less: leaving out what is stored, or looking for what is missing.
    few_hits = 2 * hits.count() < first.count()
    todo = join_checked(read, hits, "content", "left_anti", 64) if few_hits else join_checked(read, missing.select("content"), "content", "left_semi", 64)
    todo = join_checked(todo, again, ["content", "doc_id"], "left_anti", 80).select("content", "text")
    new = todo.mapInArrow(released(_counts(tokenizer)), "content binary, n_tokens long").distinct()
    new.select("content", F.lit(tokenizer.digest).alias("tokenizer"), "n_tokens").write.mode("append").parquet(cache)
    out = keyed.join(materialize(stored()).hint("merge"), "content", "left")
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
