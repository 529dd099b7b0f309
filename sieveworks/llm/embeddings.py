"""Embedding near-dedup by Euclidean p-stable hashing.

A vector, normalised to length one, is projected on random Gaussian directions; each projection
is shifted and cut into steps of a fixed width, and the step numbers of k projections make the
bucket of one table. Vectors at distance d agree in a step with a probability that falls with
d / width, so that vectors with a high cosine share a bucket of some table with a probability
that the number of tables fixes. The vectors of a bucket are then compared exactly.

Buckets are worked through in blocks of bounded size. A pair that meets in several tables is
counted in the first of them. A block returns each vector's number of new links and a forest of
the linked pairs, not the pairs. Equal vectors are one class and are compared once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .base import components, dealt_blocks, forest, in_runs, join_checked, materialize, released, spread_blocks, whole_runs

#: Step width in units of the normalised vectors, chance to miss a pair at the threshold, and rows of a block.
WIDTH, MISS, BLOCK = 2.0, 1e-3, 512
#: Groups up to this size are compared by shifting a whole batch against itself.
SMALL = 32
#: Rows of a longer run that are compared with the rest of it at a time.
SLICE = 1024


def agree(distance: float, width: float = WIDTH) -> float:
    """The probability that two vectors at this distance fall into one step of a projection."""
    r = width / distance
    return math.erf(r / math.sqrt(2)) - math.sqrt(2 / math.pi) / r * (1 - math.exp(-r * r / 2))


def plan_tables(n: int, cosine: float, miss: float = MISS) -> tuple[int, int]:
    """(projections of a table, tables) for n vectors: about 16 chance neighbours in a bucket, and
    a pair at the threshold missed with probability `miss`."""
    near, far = agree(math.sqrt(2 - 2 * cosine)), agree(math.sqrt(2))
    k = max(4, math.ceil(math.log(max(n, 1) / 16 + 1) / -math.log(far)))
    return k, math.ceil(math.log(miss) / math.log(1 - near**k))


@lru_cache(maxsize=8)
def _projections(dim: int, k: int, tables: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.default_rng([2, dim, k, tables])
    return rng.standard_normal((dim, k * tables)), rng.uniform(0, WIDTH, k * tables), rng.integers(1, 2**62, (tables, k + 1)) * 2 + 1


def buckets(x: np.ndarray, k: int, tables: int) -> np.ndarray:
    """The bucket of each row of normalised vectors in each table, as a 64-bit digest."""
    a, shift, mult = _projections(x.shape[1], k, tables)
    step = np.floor((x @ a + shift) / WIDTH).astype(np.int64).reshape(len(x), tables, k)
    with np.errstate(over="ignore"):
        h = (step * mult[None, :, :k]).sum(2) + mult[None, :, k]
        return h ^ (h >> 29)


def _normal(raw: list[bytes], dtype: str) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), dtype).reshape(len(raw), -1).astype(np.float64)
    # Scaled first, so that squares neither overflow nor vanish.
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _classes(dtype: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row's class and components, both null where the vector links with nothing."""
        for b in batches:
            cls, vec = [], []
            for v in b.column(1):
                x = None if v.as_py() is None or v.values.null_count else v.values.to_numpy()
                ok = x is not None and len(x) and np.isfinite(x).all() and np.any(x)
                raw = (x + 0).astype(dtype).tobytes() if ok else None
                vec.append(raw)
                cls.append(xxhash.xxh3_64_intdigest(raw) - 2**63 if ok else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cls, pa.int64()), pa.array(vec, pa.binary())], names=["vec_id", "cls", "vec"])

    return run


def _by_dim(raw: list[bytes]) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    size = np.fromiter(map(len, raw), np.int64, len(raw))
    for s in np.unique(size):
        at = np.flatnonzero(size == s)
        yield at, [raw[i] for i in at]


def _posts(k: int, tables: int, dtype: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                b = batch.slice(i, 512)
                for at, raw in _by_dim(b.column("vec").to_pylist()):
                    keys = buckets(_normal(raw, dtype), k, tables)
                    rows = np.repeat(at, tables)
                    yield pa.RecordBatch.from_arrays([pa.array(keys.ravel())] + [b.column(c).take(pa.array(rows)) for c in ("cls", "n", "vec")], names=["key", "cls", "n", "vec"])

    return run


def _pairs(x: np.ndarray, at: np.ndarray, cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i < j) of rows of the same run with at least this cosine."""
    size = np.diff(at)
    run = np.repeat(np.arange(len(size)), size)
    small = np.flatnonzero(np.repeat(size <= SMALL, size))
    for shift in range(1, min(SMALL, int(size.max(initial=1)))):
        i = small[small + shift < len(x)]
        i = i[run[i] == run[i + shift]]
        if not len(i):
            break
        ok = np.einsum("ij,ij->i", x[i], x[i + shift]) >= cosine
        yield i[ok], i[ok] + shift
    for s, n in zip(at[:-1][size > SMALL].tolist(), size[size > SMALL].tolist(), strict=True):
        for lo in range(s, s + n, SLICE):
            hi = min(lo + SLICE, s + n)
            i, j = np.nonzero(np.triu(x[lo:hi] @ x[lo : s + n].T >= cosine, 1))
            yield i + lo, j + lo


def _links(k: int, tables: int, dtype: str, cosine: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (a, b, null), linked classes, and (a, null, w), vectors newly linked with each of a."""
        for t, at in whole_runs(batches, ["key", "b1", "b2"]):
            raw = t.column("vec").to_pylist()
            key, cls, n, b1, b2, blk = (t.column(c).to_numpy() for c in ("key", "cls", "n", "b1", "b2", "blk"))
            edges: list[tuple[int, int]] = []
            links = np.zeros(len(key), np.int64)
            lens = {len(r) for r in raw}
            if len(lens) > 1:  # a bucket's digest hit by vectors of two lengths: compare each length by itself
                groups = [(np.repeat(np.arange(len(at) - 1), np.diff(at))[i], i, r) for i, r in _by_dim(raw)]
            else:
                groups = [(np.repeat(np.arange(len(at) - 1), np.diff(at)), np.arange(len(raw)), raw)]
            for runs, rows, part in groups:
                x = _normal(part, dtype)
                cuts = np.append(np.flatnonzero(np.diff(runs, prepend=-1)), len(runs))
                for i, j in _pairs(x, cuts, cosine):
                    gi, gj = rows[i], rows[j]
                    keep = (b1[gi] == b2[gi]) | (blk[gi] != blk[gj])
                    i, j, gi, gj = i[keep], j[keep], gi[keep], gj[keep]
                    if not len(i):
                        continue
                    used, inverse = np.unique(np.concatenate([i, j]), return_inverse=True)
                    codes = buckets(x[used], k, tables)
                    for lo in range(0, len(i), 65536):
                        hi = min(lo + 65536, len(i))
                        a, b = inverse[lo:hi], inverse[len(i) + lo : len(i) + hi]
                        ca, ki = codes[a], key[gi[lo:hi]]
                        first = (ca == codes[b]).argmax(1)
                        new = ca[np.arange(len(a)), first] == ki
                        pi, pj = gi[lo:hi][new], gj[lo:hi][new]
                        np.add.at(links, pi, n[pj])
                        np.add.at(links, pj, n[pi])
                        edges += _spanning(pi, pj)
            some = np.flatnonzero(links)
            a = np.concatenate([cls[[e[0] for e in edges]], cls[some]]) if edges or len(some) else np.empty(0, np.int64)
            b = [int(cls[e[1]]) for e in edges] + [None] * len(some)
            w = [None] * len(edges) + links[some].tolist()
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(w, pa.int64())], names=["a", "b", "w"])

    return run


def _spanning(i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a forest over these pairs of rows."""
    rows, ij = np.unique(np.concatenate([i, j]), return_inverse=True)
    a, b = ij[: len(i)], ij[len(i) :]
    order = np.argsort(a, kind="stable")
    a, b = a[order], b[order]
    cut = np.searchsorted(a, np.arange(len(rows) + 1))
    return [(int(rows[x]), int(rows[y])) for x, y in forest(len(rows), lambda r: b[cut[r] : cut[r + 1]])]


def near_duplicates(vectors: DataFrame, cosine: float = 0.95) -> DataFrame:
    """A row (vec_id, n_links, component_id, kept) for each row of vectors(vec_id, embedding, ...).

    Two vectors are linked when their cosine, in double precision, is at least `cosine` and they share
    a bucket; of pairs at the threshold one in 1 / MISS shares none, of closer ones fewer. n_links counts
    the other vectors linked with this one, component_id is the smallest vec_id reachable over links,
    kept tells whether it is the row's own. Vectors that are null, empty, zero or hold null or
    non-finite components, and rows with a null vec_id, link with nothing. Vectors of different lengths
    do not link. Repeated rows are vectors of their own and link with each other. Further columns
    are ignored, an empty table gives no rows."""
    element = vectors.schema["embedding"].dataType.elementType
    dtype = "<f4" if isinstance(element, T.FloatType) else "<f8"
    read = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(F.col("vec_id").isNotNull(), F.col("embedding").cast("array<float>" if dtype == "<f4" else "array<double>")).alias("v"))
    all_rows = materialize(read.mapInArrow(released(_classes(dtype)), "vec_id long, cls long, vec binary"))
    valid = all_rows.where("cls is not null")
    reps = materialize(valid.groupBy("cls").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n")))
    k, tables = plan_tables(reps.count(), cosine)
    copied = reps.where("n > 1").withColumnRenamed("rep", "one")
    own = join_checked(valid, copied, "cls", "left", 40).where("one is null or one = vec_id").select("cls", F.coalesce("n", F.lit(1)).alias("n"), "vec").dropDuplicates(["cls"])
    posts = own.mapInArrow(released(_posts(k, tables, dtype)), "key long, cls long, n long, vec binary")
    dealt = spread_blocks(dealt_blocks(posts, ["key"], "cls", BLOCK))
    found = materialize(in_runs(dealt, ["key", "b1", "b2"], _links(k, tables, dtype, cosine), "a long, b long, w long"))
    links = found.where("w is not null").groupBy(F.col("a").alias("cls")).agg(F.sum("w").alias("w"))
    comps = components(found.where("w is null").select("a", "b")).withColumnRenamed("node", "cls")
    named = materialize(reps.join(links, "cls", "left").join(comps, "cls", "left").where("n > 1 or w is not null"))
    least = named.where("comp is not null").groupBy("comp").agg(F.min("rep").alias("least"))
    named = join_checked(named, least, "comp", "left", 32)
    named = named.select("cls", (F.col("n") - 1 + F.coalesce("w", F.lit(0))).alias("links"), F.coalesce("least", "rep").alias("least"))
    out = join_checked(all_rows.select("vec_id", "cls"), named, "cls", "left", 40)
    out = out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("least", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
