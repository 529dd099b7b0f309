"""Benchmark decontamination: size-partitioned MinHash containment search.

An item with n shingles leaks into a document that holds c = ceil(0.8 n) of them. Its sketch is
its n - c + 1 least shingle hashes: a document that holds c shingles lacks at most n - c, so it
holds one of any n - c + 1, and no leak is missed however long the document is. (Signatures of
equal length for items and whole documents cannot do this: a 30-shingle item in a document of
10,000 has a Jaccard similarity of 0.003.) Items are partitioned by size; a document only
searches the partitions whose items are small enough for it to hold c of their shingles.
Candidates are verified by the exact containment of the full shingle sets.

Equal texts of items are one item of the search, whose ids are joined to what is found. Documents are
read once, unshuffled, for each block of items. Blocks are cut by the items' text length and searched one
after the other, so that what the driver holds and sends to the tasks is one block, whatever the items.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import join_checked, materialize, released, text_bytes
from .shingles import WordDigests, distinct, shingle_list, words_of

#: Text bytes of the items of one block; a block's index takes about four times as much.
BLOCK_BYTES = 8 << 20


class ItemIndex:
    """The sketches of a block of items, by size partition, and their full sets."""

    def __init__(self, items: list[tuple[str, bytes]], percent: int):
        digests = WordDigests()
        self.ids, self.sets, self.need = [], [], []
        sketches: dict[int, list[tuple[np.ndarray, int]]] = {}
        for item_id, text in items:
            s = distinct(shingle_list(digests.of(words_of(text))))
            if not len(s):
                continue
            need = -(-percent * len(s) // 100)
            at = len(self.ids)
            self.ids.append(item_id)
            self.sets.append(s)
            self.need.append(need)
            # s is sorted by digest, which serves as the hash whose minima are taken.
            sketches.setdefault(len(s).bit_length(), []).append((s[: len(s) - need + 1], at))
        #: For each partition: the least `need`, its sketch hashes sorted, and their items.
        self.partitions = []
        for _, part in sorted(sketches.items()):
            values = np.concatenate([v for v, _ in part])
            owner = np.concatenate([np.full(len(v), at) for v, at in part])
            order = np.argsort(values, kind="stable")
            self.partitions.append((min(self.need[at] for _, at in part), values[order], owner[order]))

    def search(self, shingles: np.ndarray) -> list[tuple[str, int, int]]:
        """(key, shingles of the item, shared ones) of the items that these shingles contain."""
        candidates: set[int] = set()
        for least, values, owner in self.partitions:
            if len(shingles) < least:
                break
            lo = np.searchsorted(values, shingles)
            lo[lo == len(values)] = 0
            for v in distinct(shingles[values[lo] == shingles]):
                candidates.update(owner[np.searchsorted(values, v) : np.searchsorted(values, v, "right")].tolist())
        found = []
        if candidates:
            whole = distinct(shingles)
            for at in sorted(candidates):
                s = self.sets[at]
                lo = np.minimum(np.searchsorted(whole, s), len(whole) - 1)
                n = int((whole[lo] == s).sum())
                if n >= self.need[at]:
                    found.append((self.ids[at], len(s), n))
        return found


def _search(index: ItemIndex):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digests = WordDigests()
        for b in batches:
            rows = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                rows += [(doc_id, *x) for x in index.search(shingle_list(digests.of(words_of(text.as_py()))))]
            cols = list(zip(*rows, strict=True)) or [()] * 4
            types = (pa.int64(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["doc_id", "key", "n_item", "n_shared"])

    return run


def leaks(docs: DataFrame, items: DataFrame, percent: int = 80) -> DataFrame:
    """A row (doc_id, item_id, n_item, n_shared, containment) for each document of docs(doc_id,
    text, ...) and item of items(item_id, text, ...) that it contains: n_shared of the item's n_item
    distinct five-word shingles are the document's, and 100 * n_shared >= percent * n_item.

    Items and documents without words, and null texts, give no rows. An item of fewer than five
    words is one shingle, which only a document of just these words has. Rows that repeat an id are
    searched one by one and give equal rows, of which one is returned. Null ids are carried as null.
    An empty table on either side gives no rows."""
    given = items.select(F.col("item_id").cast("long").alias("item_id"), text_bytes().alias("text")).where("text is not null").withColumn("key", F.sha2("text", 256))
    texts = materialize(given.groupBy("key").agg(F.first("text").alias("text")))
    total = texts.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    n = int(total // BLOCK_BYTES) + 1
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text"))
    found = []
    for k in range(n):
        block = texts if n == 1 else texts.where(F.pmod(F.xxhash64("key"), F.lit(n)) == k)
        index = ItemIndex([(r.key, bytes(r.text)) for r in block.toLocalIterator()], percent)
        hits = read.mapInArrow(released(_search(index)), "doc_id long, key string, n_item long, n_shared long")
        found.append(hits if n == 1 else materialize(hits))
    pairs = reduce(DataFrame.union, found).distinct()
    named = join_checked(pairs, given.select("key", "item_id").distinct(), "key", "inner", 80)
    return named.select("doc_id", "item_id", "n_item", "n_shared", (F.col("n_shared") / F.col("n_item")).alias("containment")).distinct()


def drop_leaks(docs: DataFrame, items: DataFrame, percent: int = 80) -> DataFrame:
    """docs without the documents that contain an item; rows with a null doc_id stay."""
    leaked = leaks(docs, items, percent).select("doc_id").distinct()
    return join_checked(docs, leaked, "doc_id", "left_anti", 16).select(*docs.columns)
