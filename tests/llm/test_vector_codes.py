"""Codes of vectors against brute force in whole numbers."""

import hashlib
import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sieveworks.llm import base, vector_codes
from sieveworks.llm.vector_codes import compress, digest, nearest

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, rounds=4):
    kept = [(i, [math.floor(float(np.float32(x)) * 1024) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not kept:
        return [], "," and hashlib.sha256(b"").hexdigest()
    n = len(kept[0][1])
    kept = [r for r in kept if len(r[1]) == n]
    cut = [(n * p // 4, n * (p + 1) // 4) for p in range(4)]
    books = [[r[1][a:b] for r in kept[:256]] for a, b in cut]

    def assign(p, r):
        a, b = cut[p]
        return min((sum((x - y) ** 2 for x, y in zip(r[1][a:b], c)), k) for k, c in enumerate(books[p]))

    for _ in range(rounds):
        for p, (a, b) in enumerate(cut):
            members = defaultdict(list)
            for r in kept:
                members[assign(p, r)[1]].append(r[1][a:b])
            for k, ms in members.items():
                books[p][k] = [sum(x) // len(ms) for x in zip(*ms)]
    found = [(r[0], r[2], [assign(p, r) for p in range(4)]) for r in kept]
    errors = defaultdict(int)
    for _, label, best in found:
        errors[label] += sum(d for d, _ in best)
    most = (1 << 63) - 1
    out = [(i, "".join(f"{k:02x}" for _, k in best), min(sum(d for d, _ in best), most), min(errors[label], most)) for i, label, best in found]
    return out, hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()


def run(spark, rows, schema=SCHEMA):
    coded, books = compress(spark.createDataFrame(rows, schema))
    return sorted(((r.vec_id, r.code, r.error, r.label_error) for r in coded.collect()), key=repr), digest(books)


def check(spark, rows):
    want, sha = brute(rows)
    assert run(spark, rows) == (sorted(want, key=repr), sha)


def made_up(n, dims, seed=2):
    """A third of all vectors are copies of one, some parts are shared by others."""
    rng = random.Random(seed)
    hot = [rng.uniform(-1, 1) for _ in range(dims)]
    rows = []
    for i in range(n):
        v = list(hot) if i % 3 == 0 else [rng.gauss(0, 0.2) for _ in range(dims)]
        if i % 3 == 1:
            v[: dims // 4] = hot[: dims // 4]
        rows.append((i, v, rng.choice([None, 1, 2])))
    return rows


@pytest.mark.parametrize("bytes_", [4 << 20, 2000, 1])
def test_equals_brute_force(spark, monkeypatch, bytes_):
    monkeypatch.setattr(vector_codes, "BROADCAST_BYTES", bytes_)
    monkeypatch.setattr(base, "BROADCAST_BYTES", bytes_)
    check(spark, made_up(700, 16))


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    bad = [(1, None, 1), (2, [nan] * 8, 1), (3, [0.0, None] * 4, None), (4, [inf] + [0.0] * 7, 2), (5, [0.0] * 7 + [-inf], 2)]
    rows = [*bad, (9, [0.5, -0.0001, 1.0, 2.0, -3.0, 0.0, 0.1, 1e-9], None), (9, [0.5, -0.0001, 1.0, 2.0, -3.0, 0.0, 0.1, 1e-9], None), (9, [0.25] * 8, 7), (None, [0.75] * 8, None), (12, [0.0] * 4, 1), (13, [], 1)]
    check(spark, rows)
    assert {r[0] for r in run(spark, rows)[0]} == {9, None}
    clash = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("row", "part", "position", "weight", "code", "error", "numbers", "_hot", "_label")})
    assert clash.count() == len(rows) and compress(clash)[0].count() == 4
    for some in ([], bad, [(1, [], 1), (2, [], 1)]):
        check(spark, some)


def test_ties_go_to_the_lower_entry_and_unused_entries_stay(spark):
    # Equal vectors among the first 256 make equal entries, of which only the first is used.
    rows = [(i, [float(i % 5)] * 4, i % 2) for i in range(300)]
    check(spark, rows)
    codes, errors = nearest(np.array([[1], [3]]), [[0], [2], [4], [2]])
    assert codes.tolist() == [0, 1] and errors.tolist() == [1, 1]


def test_lengths_that_four_does_not_divide_and_large_numbers(spark):
    check(spark, [(i, [i * 0.1 + k for k in range(6)], 1) for i in range(20)])
    check(spark, [(i, [float(k) for k in range(3)], i) for i in range(3)])
    rows = [(i, [1e5 * (i + 1), -3e6 * i, 7e9, 0.1 * i], i % 2) for i in range(300)]
    check(spark, rows)


def test_whole_table_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    check(spark, rows)
