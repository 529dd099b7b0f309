"""MinHash near-dedup by a signature-coordinate inverted join.

1. Every document's shingle set gives a digest of the set and a signature of K coordinates.
   Documents with equal sets form a class; only its smallest doc_id goes on.
2. Documents are posted under each coordinate-value pair. Pairs with a Jaccard similarity of
   0.85 agree in K * 0.85 coordinates on average; pairs that agree in fewer than T are skipped.
   Counting is prefix filtered: a pair with T agreements shares one of the K - T + 1 rarest
   postings of either document, so a document whose postings are shared by others fewer than
   T times is dropped, and the others are only posted under their rarest shared ones. Very
   long posting lists thus go unread unless most of a document's list is long.
3. Within a posting, collisions are counted in blocks of bounded size, coordinate lists merged in
   order; pairs are skipped once what is left of their lists cannot bring them to T. A block returns
   a forest of the pairs that agree in T coordinates, never all its pairs.
4. The components of these forests hold all links. Their documents' full sets are compared
   exactly in blocks, and the forests of the confirmed links give the final components.

T follows from the percentage (`least_agreeing`): the largest with which a pair at exactly the threshold
is missed no more often than at 0.85 with T = 42, about once in 34,000 pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import components, dealt_blocks, delete_shared, forest, in_runs, join_checked, materialize, released, spread_blocks, text_bytes, whole_runs, write_shared
from .shingles import WordDigests, coordinates, minhash, shingle_set

K = 64
#: Coordinates that are merged before pairs are skipped.
FIRST = 32
#: Cells of a table of pairs, and of an incidence table, that are held at a time.
CELLS = 1 << 23
#: The share of pairs at the threshold that may be missed: what K = 64 and T = 42 miss at 0.85.
MISSED = 3e-5
#: Rows of a block when signatures, and when full sets, are compared.
SIGNATURE_BLOCK, SET_BLOCK = 512, 64
_SIGNED = "doc_id long, n_shingles long, cls long, sig binary"


def least_agreeing(percent: int) -> int:
    """T: in how many of K coordinates a pair has to agree to be compared exactly, 1 at least."""
    p, below = percent / 100, 0.0
    for t in range(K):
        below += math.comb(K, t) * p**t * (1 - p) ** (K - t)
        if below > MISSED:
            return max(t, 1)
    return K


def _class_of(s: np.ndarray) -> int:
    """The digest of a set that stands for the documents that have it."""
    return xxhash.xxh3_64_intdigest(s.tobytes()) - 2**63


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    digests, (mult, add) = WordDigests(), coordinates(K)
    for b in batches:
        n, cls, sig = [], [], []
        for text in b.column(1):
            s = shingle_set(text.as_py(), digests)
            n.append(len(s))
            cls.append(_class_of(s))
            sig.append(minhash(s, mult, add).tobytes() if len(s) else None)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(cls, pa.int64()), pa.array(sig, pa.binary())], names=["doc_id", "n_shingles", "cls", "sig"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    digests = WordDigests()
    for b in batches:
        sets = [shingle_set(t.as_py(), digests) for t in b.column("text")]
        right = pa.array([_class_of(s) == c.as_py() for s, c in zip(sets, b.column("cls"), strict=True)], pa.bool_())
        cols = [b.column(c) for c in ("cls", "comp", "nb", "blk")] + [pa.array([s.tobytes() for s in sets], pa.binary())]
        yield pa.RecordBatch.from_arrays(cols, names=["cls", "comp", "nb", "blk", "shingles"]).filter(right)


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row (cls, token) for each coordinate-value pair of a signature."""
    for b in batches:
        if not b.num_rows:
            continue
        sig = np.frombuffer(b"".join(x.as_py() for x in b.column("sig")), np.uint32).reshape(-1, K)
        token = sig.astype(np.int64) * K + np.arange(K)
        cls = np.repeat(b.column("cls").to_numpy(), K)
        yield pa.RecordBatch.from_arrays([pa.array(cls), pa.array(token.ravel())], names=["cls", "token"])


def _edges(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def agreeing(sig: np.ndarray, block: np.ndarray, across: bool, least: int) -> list[tuple[int, int]]:
    """A forest of the pairs of rows that agree in `least` coordinates; across: only pairs of
    rows from different blocks count. Collisions are counted by merging the rows' coordinates in order, the
    first ones of all pairs, then the others of those that can still reach `least`; the rest is skipped."""
    def partners(i: int) -> np.ndarray:
        n = (sig[i + 1 :, :FIRST] == sig[i, :FIRST]).sum(1)
        left = n >= least - (K - FIRST)
        if across:
            left &= block[i + 1 :] != block[i]
        at = np.flatnonzero(left)
        n = n[at] + (sig[at + i + 1, FIRST:] == sig[i, FIRST:]).sum(1)
        return at[n >= least] + i + 1

    return forest(len(sig), partners)


def _agreeing_runs(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, at in whole_runs(batches, ["token", "b1", "b2"]):
            cls, b1, b2, blk = (t.column(c).to_numpy() for c in ("cls", "b1", "b2", "blk"))
            sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint32).reshape(-1, K)
            a, b = [], []
            size = np.diff(at)
            for s, n in zip(at[:-1][size > 1].tolist(), size[size > 1].tolist(), strict=True):
                for x, y in agreeing(sig[s : s + n], blk[s : s + n], b1[s] != b2[s], least):
                    a.append(cls[s + x])
                    b.append(cls[s + y])
            yield _edges(a, b)

    return run


def linked(sets: list[np.ndarray], block: np.ndarray, across: bool, percent: int) -> list[tuple[int, int]]:
    """A forest of the pairs of sets with 100 * intersection >= percent * union, from the exact
    intersections of all pairs: products of incidence rows over slices of the shared shingles."""
    n = len(sets)
    size = np.fromiter(map(len, sets), np.int64, n)
    if n == 2:
        inter = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return [(0, 1)] if 100 * inter >= percent * (size[0] + size[1] - inter) and (not across or block[0] != block[1]) else []
    values = np.concatenate(sets)
    row = np.repeat(np.arange(n), size)
    order = np.argsort(values, kind="stable")
    values, row = values[order], row[order]
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    column = np.cumsum(new) - 1
    shared = np.bincount(column) > 1
    keep = shared[column]
    row, column = row[keep], (np.cumsum(shared) - 1)[column[keep]]
    n_shared = int(shared.sum())
    by_row = np.argsort(row, kind="stable")
    row_of, column_of, row_at = row[by_row], column[by_row], np.searchsorted(row[by_row], np.arange(n + 1))
    rows, step = max(1, min(n, CELLS // n)), max(64, min(8192, CELLS // n))
    cuts = np.searchsorted(column, np.arange(0, n_shared + step, step))
    held: list[tuple[int, np.ndarray]] = []

    def slice_of(first: int) -> np.ndarray:
        """Which pairs are links, of the rows from `first` on with all rows."""
        last = min(first + rows, n)
        inter = np.zeros((last - first, n), np.float32)
        own_rows, own_columns = row_of[row_at[first] : row_at[last]] - first, column_of[row_at[first] : row_at[last]]
        order = np.argsort(own_columns, kind="stable")
        own_rows, own_columns = own_rows[order], own_columns[order]
        for lo, hi, base in zip(cuts[:-1], cuts[1:], range(0, n_shared + step, step), strict=False):
            a, b = np.searchsorted(own_columns, (base, base + step))
            if hi > lo and b > a:
                m, own = np.zeros((n, step), np.float32), np.zeros((last - first, step), np.float32)
                m[row[lo:hi], column[lo:hi] - base] = 1
                own[own_rows[a:b], own_columns[a:b] - base] = 1
                inter += own @ m.T
        ok = 100 * inter >= percent * (size[first:last, None] + size[None, :] - inter)
        ok &= (size[first:last, None] > 0) & (size[None, :] > 0)
        if across:
            ok &= block[first:last, None] != block[None, :]
        return ok

    def partners(i: int) -> np.ndarray:
        if not held or i >= held[0][0] + rows:
            held[:] = [(i, slice_of(i))]
        first, ok = held[0]
        return np.flatnonzero(ok[i - first, i + 1 :]) + i + 1

    return forest(n, partners)


def _linked_runs(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, at in whole_runs(batches, ["comp", "b1", "b2"], 256):
            cls, b1, b2, blk = (t.column(c).to_numpy() for c in ("cls", "b1", "b2", "blk"))
            raw = t.column("shingles")
            a, b = [], []
            for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                if e - s < 2:
                    continue
                sets = [np.frombuffer(raw[i].as_py(), np.uint64) for i in range(s, e)]
                for x, y in linked(sets, blk[s:e], b1[s] != b2[s], percent):
                    a.append(cls[s + x])
                    b.append(cls[s + y])
            yield _edges(a, b)

    return run


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """A row (doc_id, n_shingles, component_id, kept) for each row of docs(doc_id, text, ...).

    Two documents are linked when 100 * intersection >= percent * union of their shingle sets.
    component_id is the smallest doc_id reachable over links, itself included; kept tells whether
    it is the row's own. Documents without words, and null texts, have no shingles and no links.
    Each row goes by its own text, rows that repeat a doc_id too: equal ones get equal results. A
    null doc_id links with nothing, has a null component_id and is kept. Further columns of docs are ignored. An empty table gives no rows."""
    least = least_agreeing(percent)
    spark = docs.sparkSession
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text"))
    sig, path = write_shared(read.mapInArrow(released(_signatures), _SIGNED), "signatures")
    usable = sig.where("n_shingles > 0 and doc_id is not null")
    reps = materialize(usable.groupBy("cls").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n")))
    copied = reps.where("n > 1").select("cls", F.col("doc_id").alias("rep"))
    copies = join_checked(usable.select("cls", "doc_id"), copied, "cls", "inner", 32).where("doc_id <> rep").select("cls", "doc_id").distinct()
    own = join_checked(usable.select("cls", "doc_id", "sig"), copies, ["cls", "doc_id"], "left_anti", 32).select("cls", "sig")

    tokens = own.mapInArrow(released(_tokens), "cls long, token long")
    shared = tokens.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    posted = join_checked(tokens, shared, "token", "inner", 32)
    # The rarest postings of a document come first; of its m shared ones, m - T + 1 are read.
    prefix = (
        posted.groupBy("cls")
        .agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("p"))
        .where(F.size("p") >= least)
        .select("cls", F.explode(F.slice("p", 1, F.size("p") - (least - 1))).alias("p"))
        .select("cls", F.col("p.token").alias("token"))
    )
    prefix = materialize(prefix)
    live = prefix.groupBy("token").agg(F.count("*").alias("n")).where("n > 1").select("token")
    prefix = materialize(dealt_blocks(join_checked(prefix, live, "token", "inner", 16), ["token"], "cls", SIGNATURE_BLOCK))
    signed = join_checked(own, prefix.select("cls").distinct(), "cls", "left_semi", 16)
    posts = spread_blocks(prefix.join(signed, "cls"))
    matched = components(in_runs(posts, ["token", "b1", "b2"], _agreeing_runs(least), "a long, b long"))

    matched = dealt_blocks(matched.select(F.col("node").alias("cls"), "comp"), ["comp"], "cls", SET_BLOCK)
    matched = matched.join(reps.select("cls", "doc_id"), "cls")
    sets = join_checked(read.where("doc_id is not null"), matched, "doc_id", "inner", 48).mapInArrow(released(_sets), "cls long, comp long, nb int, blk int, shingles binary")
    dealt = in_runs(spread_blocks(sets), ["comp", "b1", "b2"], _linked_runs(percent), "a long, b long")
    links = components(dealt).select(F.col("node").alias("cls"), "comp")

    # The smallest doc_id of a component is that of its classes' smallest.
    linked_reps = materialize(links.join(reps.select("cls", "doc_id"), "cls"))
    least = linked_reps.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    follow = join_checked(linked_reps.select("cls", "comp"), least, "comp", "inner", 32).select("cls", "component_id")
    follow = follow.union(copied.select("cls", F.col("rep").alias("component_id"))).groupBy("cls").agg(F.min("component_id").alias("component_id"))
    out = join_checked(sig.select("doc_id", "n_shingles", F.when(F.expr("n_shingles > 0 and doc_id is not null"), F.col("cls")).alias("cls")), follow, "cls", "left", 32)
    out = out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    out = materialize(out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))))
    delete_shared(spark, path)
    return out


def keep_one(docs: DataFrame, percent: int = 85) -> DataFrame:
    """docs without the documents that are not the kept one of their component. Rows that repeat
    a doc_id stay or go together. Columns and their order stay as they are."""
    dropped = near_duplicates(docs, percent).where("not kept").select("doc_id").distinct()
    return join_checked(docs, dropped, "doc_id", "left_anti", 16).select(*docs.columns)
