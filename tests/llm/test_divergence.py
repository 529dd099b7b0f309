"""Divergence of sources against brute force in whole numbers."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sieveworks.llm import divergence
from sieveworks.llm.divergence import source_divergence

SCHEMA = "doc_id long, text string, lang string, source string"


def brute(rows, least=10, top=10):
    counts, docs = defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        words = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        counts[lang, source].update(words)
        docs[lang].update(set(words))
    out = set()
    for lang in docs.keys() | {g for g, _ in counts}:
        kept = sorted(t for t, n in docs[lang].items() if n >= least)
        sources = [s for g, s in counts if g == lang]
        everything = sum((counts[lang, s] for s in sources), Counter())

        def shares(c, kept=kept):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 2) // (n + 2 * len(kept)) for t in kept}

        p, q = {s: shares(counts[lang, s]) for s in sources}, shares(everything)
        f = lambda x, y: (x - y) ** 2 // (x + y)
        for s in sources:
            pairs = [(o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in sources if o != s]
            terms = [(t, f(p[s][t], q[t])) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, items, last in (("pair", pairs, len(pairs)), ("term", terms, top)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out |= {(lang, s, part, item, v, rank) for rank, (item, v) in enumerate(items[:last], 1)}
    return out


def made_up(n, sources, seed=1):
    rng = random.Random(seed)
    words = [f"word{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}" for i in range(300)] + ["été", "日本", "ÀB", "İx", "a"]
    rows = []
    for i in range(n):
        # A third of all rows is of one source.
        s = 0 if i % 3 == 0 else rng.randrange(sources)
        some = words[(7 * s) % 200 :][:60] if rng.random() < 0.8 else words
        rows.append((i, rng.choice([" ", "-1", "\n", "'"]).join(rng.choice(some).capitalize() for _ in range(rng.randint(0, 30))), ["en", "de", None][s % 3], f"s{s}"))
    return rows


@pytest.mark.parametrize(("block", "chunk", "span", "held"), [(32, 4096, 16, 1 << 17), (4, 16, 2, 50), (1, 1, 1, 0)])
def test_equals_brute_force(spark, monkeypatch, block, chunk, span, held):
    for k, v in (("BLOCK", block), ("CHUNK", chunk), ("SPAN", span), ("HELD", held)):
        monkeypatch.setattr(divergence, k, v)
    rows = made_up(400, 24) if block > 1 else made_up(150, 9)
    rows += [(None, None, None, None), (None, "", "en", "bare"), (1, "123 456", "en", None), (2, "only here", "xx", "one"), (3, None, "xx", "two")] + rows[:5]
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({"term": F.lit("x"), "n": F.lit(1), "item": F.lit(None), "chunk": F.lit(0)})
    got = [tuple(r) for r in source_divergence(docs).select("lang", "source", "part", "item", "value", "rank").collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows)
    assert ("xx", "one", "pair", "two", 0, 1) in got


def test_long_texts_ties_and_empty_tables(spark):
    rows = [(i, "tie one two " * (1 if i else 100_000), "en", f"s{i % 2}") for i in range(30)] + [(99, "x" * 500_000, "en", "s0")]
    got = {tuple(r) for r in source_divergence(spark.createDataFrame(rows, SCHEMA)).select("lang", "source", "part", "item", "value", "rank").collect()}
    assert got == brute(rows)
    assert source_divergence(spark.createDataFrame([], SCHEMA)).count() == 0
    small = source_divergence(spark.createDataFrame(rows[:3], SCHEMA), least_documents=1, top_terms=1).collect()
    assert {tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in small} == brute(rows[:3], least=1, top=1)


def test_shares_of_very_large_counts_are_exact(spark):
    counts = [0, 1, 10**6, 10**12 + 7, 9 * 10**15 - 3]
    whole, v = 9 * 10**15, 12_345
    want = [1 + 10**9 * (n + 2) // (whole + 2 * v) for n in counts]
    assert divergence.shares(np.array(counts), np.array([whole + 2 * v])).tolist() == want
    rows = spark.createDataFrame([(i, n) for i, n in enumerate(counts)], "i int, n long")
    p = divergence.share(F.col("n"), F.lit(whole).cast("long"), F.lit(v).cast("long"))
    assert [r.p for r in rows.select("i", p.alias("p")).orderBy("i").collect()] == want
