"""Compression of vectors to short codes by weighted Lloyd rounds over distinct parts.

A vector's components become whole numbers and are cut into PARTS parts. Equal parts at a position are one
row with its number of vectors as weight. Each round assigns the distinct rows to the entries of their
position's codebook, and only sums by entry leave a task. At the end codes and errors are joined back to
every vector's parts: those parts that many vectors share by a broadcast whose size follows from their
share, all others by a shuffle that no such part is in.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import BROADCAST_BYTES, materialize, released

PARTS, ENTRIES, ROUNDS, STEPS = 4, 256, 4, 1024
#: Rows whose distances to a codebook are held at a time.
ROWS = 4096
_LONG = (1 << 63) - 1

#: Of each position the entries, each a list of whole numbers.
Codebooks = list[list[list[int]]]


def whole_numbers(vector: Column) -> Column:
    """floor(STEPS * x) of each component."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * STEPS))


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vector.isNotNull() & ~bad, F.lit(False))


def part_of(numbers: str, i: int) -> Column:
    """The i-th of PARTS consecutive parts, equal ones where PARTS divides the length."""
    start, end = (F.floor(F.size(numbers) * k / PARTS).cast("int") for k in (i, i + 1))
    return F.slice(numbers, start + 1, end - start)


def join_by_weight(large: DataFrame, small: DataFrame, keys: list[str], weight: str, total: int, row_bytes: int) -> DataFrame:
    """large joined with small on keys that both have. weight is the number of rows of large with the key of
    a row of small, total their sum. Keys with more rows than total * row_bytes / BROADCAST_BYTES are so few
    that they fit a broadcast; only the others are shuffled."""
    often = F.col(weight) > total * row_bytes // BROADCAST_BYTES
    marked = large.join(F.broadcast(small.where(often).drop(weight).withColumn("_hot", F.lit(True))), keys, "left")
    columns = [*large.columns, *[c for c in small.columns if c not in keys and c != weight]]
    seldom = marked.where("_hot is null").select(*large.columns).join(small.where(~often).drop(weight).hint("merge"), keys)
    return marked.where("_hot").select(columns).unionByName(seldom.select(columns))


def _exact(x: np.ndarray, c: np.ndarray) -> bool:
    """Whether squared distances of these rows, and what they are computed from, are whole as doubles."""
    most = max((abs(int(v)) for a in (x, c) if a.size for v in (a.min(), a.max())), default=0)
    return (2 * most) ** 2 * max(x.shape[1], 1) < 1 << 53


def nearest(x: np.ndarray, book: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """For each row the first of its nearest entries, and the squared distance."""
    c = np.array(book, np.int64).reshape(len(book), x.shape[1])
    kind = np.float64 if _exact(x, c) else object
    codes, errors = np.empty(len(x), np.int64), np.empty(len(x), kind)
    c = c.astype(kind)
    norms = (c * c).sum(axis=1)
    for at in range(0, len(x), ROWS):
        rows = x[at : at + ROWS].astype(kind)
        d = norms - 2 * rows.dot(c.T)
        best = d.argmin(axis=1)
        codes[at : at + ROWS] = best
        errors[at : at + ROWS] = d[np.arange(len(rows)), best] + (rows * rows).sum(axis=1)
    return codes, errors


def _parts(batches: Iterator[pa.RecordBatch], books: Codebooks) -> Iterator[tuple[int, pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """(position, rows, numbers, codes, errors) of the distinct parts of each position in each batch."""
    for batch in batches:
        position = batch.column(0).to_numpy()
        for i, book in enumerate(books):
            b = batch.filter(pa.array(position == i))
            if b.num_rows:
                x = b.column(1).flatten().to_numpy().reshape(b.num_rows, -1) if len(book[0]) else np.empty((b.num_rows, 0), np.int64)
                yield i, b, x, *nearest(x, book)


def _sums(books: Codebooks):
    """Rows (position, entry, place, s) of one task: what its rows add to each place of an entry, and as
    place -1 how many vectors they stand for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], list[int]] = {}
        for i, b, x, codes, _ in _parts(batches, books):
            w = b.column(2).to_numpy()
            most = max(abs(int(x.min(initial=0))), abs(int(x.max(initial=0))), 1)
            kind = np.int64 if most * int(w.sum()) < 1 << 62 else object
            weighted = np.column_stack([w, x.astype(kind) * w.astype(kind)[:, None]])
            order = np.argsort(codes, kind="stable")
            used, first = np.unique(codes[order], return_index=True)
            for entry, s in zip(used.tolist(), np.add.reduceat(weighted[order], first).tolist(), strict=True):
                old = sums.get((i, entry))
                sums[i, entry] = s if old is None else [u + v for u, v in zip(old, s, strict=True)]
        flat = [(i, e, place, Decimal(v)) for (i, e), s in sums.items() for place, v in enumerate(s, -1)]
        types = (("position", pa.int32()), ("entry", pa.int32()), ("place", pa.int32()), ("s", pa.decimal128(38, 0)))
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in flat], t) for k, (_, t) in enumerate(types)], names=[n for n, _ in types])

    return run


def _assigned(books: Codebooks):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, b, _, codes, errors in _parts(batches, books):
            held = [min(int(e), _LONG) for e in errors] if errors.dtype == object else errors.astype(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(codes, pa.int32()), pa.array(held, pa.int64())], names=["position", "part", "weight", "code", "error"])

    return run


def improved(distinct: DataFrame, books: Codebooks) -> Codebooks:
    """The codebooks after one round: each entry the componentwise floor of the mean of its parts; entries
    without parts stay. The driver gets sums of the size of the codebooks."""
    sums = distinct.mapInArrow(released(_sums(books)), "position int, entry int, place int, s decimal(38,0)")
    out = [[list(entry) for entry in book] for book in books]
    rows = {(r.position, r.entry, r.place): int(r.s) for r in sums.groupBy("position", "entry", "place").agg(F.sum("s").alias("s")).collect()}
    for (i, e, place), s in rows.items():
        if place >= 0:
            out[i][e][place] = s // rows[i, e, -1]
    return out


def digest(books: Codebooks) -> str:
    """SHA-256 of all numbers by position, entry and place, joined by commas."""
    return hashlib.sha256(",".join(str(v) for book in books for entry in book for v in entry).encode()).hexdigest()


def compress(vectors: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, Codebooks]:
    """(rows, codebooks): a row (vec_id, label, code, error, label_error) for each row of vectors(vec_id,
    embedding, label, ...) whose vector is usable, and the final codebooks.

    Codebooks start as the parts of the ENTRIES smallest vec_ids (nulls last, of repeated ids the smaller
    vector first; all rows where there are fewer). Ties go to the lower entry. code has two hexadecimal digits for
    each position, error is the squared distance, label_error its sum over the rows of the label; null labels
    are one label. Vectors of another length than the first by vec_id cannot be compared and are left
    out like those that hold nulls; lengths that PARTS does not divide give parts whose lengths differ by one.
    Repeated rows give repeated results, further columns are ignored, an empty table gives no rows and no
    entries. All numbers are exact; components and errors beyond 63 bits are held at the largest long."""
    clean = vectors.where(usable(F.col("embedding"))).select(F.col("vec_id").cast("long").alias("vec_id"), "label", whole_numbers(F.col("embedding")).alias("numbers"))
    parts = F.array(*[part_of("numbers", i) for i in range(PARTS)]).alias("parts")
    seeds = clean.orderBy(F.col("vec_id").asc_nulls_last(), "numbers").limit(1).select(F.size("numbers").alias("length")).collect()
    length = seeds[0].length if seeds else 0
    rows = materialize(clean.where(F.size("numbers") == length).select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", "numbers", parts))
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "numbers").limit(ENTRIES).select("parts").collect()
    books = [[list(r.parts[i]) for r in first] for i in range(PARTS)]

    pieces = rows.select("row", "vec_id", "label", F.posexplode("parts").alias("position", "part"))
    distinct = materialize(pieces.groupBy("position", "part").agg(F.count("*").alias("weight")))
    for _ in range(rounds):
        books = improved(distinct, books)
    coded = materialize(distinct.mapInArrow(released(_assigned(books)), "position int, part array<long>, weight long, code int, error long"))

    found = join_by_weight(pieces, coded, ["position", "part"], "weight", PARTS * rows.count(), 8 * (length // PARTS + 1) + 64)
    digits = [F.max(F.when(F.col("position") == i, F.lower(F.lpad(F.hex("code"), 2, "0")))) for i in range(PARTS)]
    held = lambda c: F.least(F.sum(F.col(c).cast("decimal(38,0)")), F.lit(Decimal(_LONG))).cast("long")
    whole = materialize(found.groupBy("row").agg(F.any_value("vec_id").alias("vec_id"), F.any_value("label").alias("label"), F.concat(*digits).alias("code"), held("error").alias("error")).drop("row"))

    keyed = whole.withColumns({"_none": F.col("label").isNull(), "_label": F.coalesce(F.col("label").cast("string"), F.lit(""))})
    by_label = materialize(keyed.groupBy("_none", "_label").agg(held("error").alias("label_error"), F.count("*").alias("weight")))
    out = join_by_weight(keyed, by_label, ["_none", "_label"], "weight", whole.count(), 256)
    return out.select("vec_id", "label", "code", "error", "label_error"), books
