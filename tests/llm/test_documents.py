"""Operators on documents against brute force, on whole small tables and on odd rows."""

import base64
import hashlib
import math
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sieveworks.llm import bpe, language_model, near_dedup, toxicity
from sieveworks.llm.base import components, fold
from sieveworks.llm.decontaminate import drop_leaks, leaks
from sieveworks.llm.queries import QUERIES
from sieveworks.llm.shingles import WordDigests, shingle_list, shingle_set
from sieveworks.llm.token_counts import TokenizerFile, token_counts

SF = "/root/testdata/sf0.001"
ODD = "doc_id long, text string, lang string, source string, n_chars long, cls int, comp string, score double"
ODD_ROWS = [
    (1, None, None, None, None, 1, "x", 0.5),
    (2, "", "en", "s", 0, 1, "x", 0.5),
    (3, " \n\t ", "en", "s", 4, None, None, None),
    (4, "one two", "en", "s", 7, 1, "x", 0.5),
    (5, "One  TWO", "en", "s", 8, 1, "x", 0.5),
    (5, "One  TWO", "en", "s", 8, 1, "x", 0.5),
    (None, "one two", "en", "s", 7, 1, "x", 0.5),
    (6, "long " * 50_000 + "end", "en", "s", 250_003, 1, "x", 0.5),
    (7, "x" * 20_000, "en", "s", 20_000, 1, "x", 0.5),
    (8, "é\u2028ü \u00a0 'tis <|endoftext|> \U0001f600", "en", "s", 20, 1, "x", 0.5),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD_ROWS, ODD)


@pytest.fixture(scope="module")
def docs(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    return {r.doc_id: r.text for r in rows}


def query(spark, n):
    return next(f for k, f in QUERIES.items() if k.startswith(f"op{n}_"))(spark, SF)


def words(text):
    return (text or "").encode().lower().split()


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_components(sets, percent):
    ids = sorted(sets)
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            inter = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * inter >= percent * (len(sets[a]) + len(sets[b]) - inter):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_near_dedup_equals_brute_force(spark, docs):
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in query(spark, 8).collect()}
    sets = {d: shingles(t) for d, t in docs.items()}
    comp = brute_components(sets, 85)
    assert got == {d: (len(sets[d]), comp[d], comp[d] == d) for d in docs}
    assert sum(not k for _, _, k in got.values()) > 5


def test_recall_of_pairs_at_the_threshold(spark):
    """400 pairs of 62 shingles each that share 57: a Jaccard similarity of 0.8507."""
    rng = np.random.default_rng(9)
    rows = []
    for i in range(400):
        text = [f"w{i}x{k}" for k in range(66)]
        other = list(text)
        other[int(rng.integers(4, 62))] = f"other{i}"
        rows += [(2 * i, " ".join(text)), (2 * i + 1, " ".join(other))]
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[2 * i] == 2 * i and got[2 * i + 1] in (2 * i, 2 * i + 1) for i in range(400))
    # One in 34,000 may be missed.
    assert sum(got[2 * i + 1] == 2 * i for i in range(400)) >= 399


def near_group(n, seed=3):
    """Documents that each differ from one text in a few words, and pairs that share only a passage."""
    rng = np.random.default_rng(seed)
    base = [f"w{i}" for i in range(300)]
    out = []
    for i in range(n):
        text = list(base)
        for p in rng.choice(300, rng.integers(0, 9), replace=False):
            text[p] = f"x{i}_{p}"
        out.append((1000 + i, " ".join(text)))
    passage = " ".join(f"p{i}" for i in range(60))
    out += [(5000 + i, passage + " " + " ".join(f"q{i}_{j}" for j in range(80))) for i in range(n)]
    return out


def test_near_dedup_in_blocks(spark, monkeypatch):
    rows = near_group(90)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(near_dedup, "CELLS", 500)
    monkeypatch.setattr(near_dedup, "SIGNATURE_BLOCK", 8)
    monkeypatch.setattr(near_dedup, "SET_BLOCK", 8)
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs).collect()}
    assert got == brute_components({d: shingles(t) for d, t in rows}, 85)


def test_near_dedup_odd_rows(spark, odd):
    got = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(odd).collect()}
    assert {(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (5, 1, 4, False), (None, 1, None, True), (6, 2, 6, True), (7, 1, 7, True), (8, 1, 8, True)} == got
    kept = near_dedup.keep_one(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id for r in kept.collect() if r.doc_id) == [1, 2, 3, 4, 6, 7, 8]
    assert near_dedup.near_duplicates(odd.limit(0)).count() == 0


def test_components(spark):
    chain = [(i, i + 1) for i in range(1, 40)] + [(100, 50), (50, 100), (70, 70)]
    got = {r.node: r.comp for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(1, 41)} | {50: 50, 100: 50}


def test_shingles_are_those_of_words():
    for text in ("a b c d e f", "A b", "a", "", "a b c d e a b c d e"):
        d = WordDigests()
        assert len(shingle_set(text.encode(), d)) == len(shingles(text))
    a, b = (shingle_list(WordDigests().of(words(t))) for t in ("a b c d e f", "x a b c d e f y"))
    assert set(a.tolist()) < set(b.tolist())


def test_leaks_equal_brute_force(spark, docs):
    items = {r.item_id: r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    got = {(r.doc_id, r.item_id, r.n_item, r.n_shared) for r in query(spark, 3).collect()}
    sets = {i: shingles(t) for i, t in items.items()}
    want = set()
    for d, t in docs.items():
        own = shingles(t)
        want |= {(d, i, len(s), len(s & own)) for i, s in sets.items() if s and 100 * len(s & own) >= 80 * len(s)}
    assert got == want and want


def test_leaks_in_blocks_and_odd_rows(spark, odd, monkeypatch):
    monkeypatch.setattr("sieveworks.llm.decontaminate.BLOCK_BYTES", 100)
    item = " ".join(f"i{k}" for k in range(20))
    near = item.replace("i3 ", "j3 ")  # 12 of 16 shingles left, 75 %
    nearer = item.replace("i0 ", "j0 ")  # 15 of 16
    items = spark.createDataFrame([(1, item), (2, "one TWO"), (3, None), (4, ""), (5, "gone " * 9)], "item_id long, text string")
    docs = odd.select("doc_id", "text").union(spark.createDataFrame([(20, f"before {item} after"), (21, near), (22, "y " * 30_000 + nearer), (23, item.upper())], "doc_id long, text string"))
    got = sorted((r.doc_id or 0, r.item_id, r.n_shared) for r in leaks(docs, items).collect())
    assert got == [(0, 2, 1), (4, 2, 1), (5, 2, 1), (20, 1, 16), (22, 1, 15), (23, 1, 16)]
    kept = drop_leaks(docs.withColumn("item_id", F.lit(1)), items)
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 3, 6, 7, 8, 21]
    assert leaks(docs, items.limit(0)).count() == 0 and leaks(docs.limit(0), items).count() == 0
    # Copies of an item under other ids, a null one too, and columns whose names clash.
    copied = items.union(spark.createDataFrame([(6, item), (None, item), (6, item)], "item_id long, text string")).withColumns({"doc_id": F.lit(1), "key": F.lit("x")})
    clash = docs.withColumns({"item_id": F.lit(1), "n_item": F.lit("x"), "key": F.lit(None)})
    more = [(d, i, n) for d, i, n in got if i == 1]
    want = sorted(got + [(d, 6, n) for d, _, n in more] + [(d, 0, n) for d, _, n in more])
    for size in (100, 1 << 20):
        monkeypatch.setattr("sieveworks.llm.decontaminate.BLOCK_BYTES", size)
        assert sorted((r.doc_id or 0, r.item_id or 0, r.n_shared) for r in leaks(clash, copied).collect()) == want


@pytest.fixture(scope="module")
def reference_bpe():
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def coded(text, reference):
    ids = reference.encode_ordinary(text or "")
    return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


def test_bpe_equals_library(spark, docs, reference_bpe):
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in query(spark, 9).collect()}
    assert got == {d: coded(t, reference_bpe) for d, t in docs.items()}


def test_bpe_odd_rows(spark, odd, reference_bpe):
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    rows = bpe.encode(odd, ranks, public_tokenizers.PATTERN, decode=True, keep_text=True).collect()
    assert len(rows) == len(ODD_ROWS)
    for r in rows:
        assert np.frombuffer(r.ids, "<u4").tolist() == reference_bpe.encode_ordinary(r.text or "")
        assert bytes(r.decoded) == (r.text or "").encode()
    clash = odd.withColumns({"ids": F.lit(1), "decoded": F.lit("x"), "token": F.lit(None)})
    assert bpe.encode(clash, ranks, public_tokenizers.PATTERN, decode=True).count() == len(ODD_ROWS)
    assert bpe.encode(clash.limit(0), ranks, public_tokenizers.PATTERN).collect() == []
    back = bpe.decode(spark.createDataFrame([(1, bytearray(np.array([15496, 995], "<u4").tobytes())), (2, None)], "doc_id long, ids binary"), ranks)
    assert {r.doc_id: r.decoded and bytes(r.decoded) for r in back.collect()} == {1: b"Hello world", 2: None}


def test_prefix_tables_of_many_pieces(reference_bpe):
    b = bpe.PrefixBpe(bpe.read_ranks(bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))))
    rng = np.random.default_rng(6)
    letters = [list(b" aeinrstthe"), list(range(256)), list(b"aA0% ")]
    pieces = [bytes(rng.choice(letters[i % 3], rng.integers(1, 40)).tolist()) for i in range(3000)]
    pieces += [b"", bytes(rng.choice(letters[0], 5000).tolist()), b"%" * 3001]
    for some in (pieces, pieces[-4:], []):
        got = [np.frombuffer(x, "<u4").tolist() for x in b.encode_many(some)]
        assert got == [reference_bpe._encode_single_piece(p) if p else [] for p in some]


def test_prefix_table_appends_and_edits(reference_bpe):
    b = bpe.PrefixBpe(bpe.read_ranks(bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))))
    rng = np.random.default_rng(5)
    table = bpe.PrefixTable(b)
    text = b""
    for _ in range(150):
        piece = bytes(rng.choice(list(b"abcdefghinorstuaaeett"), rng.integers(1, 6)).tolist())
        if len(text) > 8 and rng.random() < 0.4:
            at = int(rng.integers(0, len(text)))
            table.replace(at, at + 2, piece)
            text = text[:at] + piece + text[at + 2 :]
        else:
            table.append(piece)
            text += piece
        assert table.piece == text and table.tokens() == reference_bpe.encode_ordinary(text.decode())


def test_token_counts(spark, docs, odd, tmp_path):
    tokenizer = TokenizerFile(public_tokenizers.path("byte_bpe_50k.json"))
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = lambda t: len(library.encode(t or "", add_special_tokens=False).ids)
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in query(spark, 5).collect()}
    assert got == {d: (len((t or "").encode()), want(t), want(t) > 512) for d, t in docs.items()}
    cache = str(tmp_path / "cache")
    rows = token_counts(odd, tokenizer, cache).collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in rows) == sorted((r[0] or 0, want(r[1])) for r in ODD_ROWS)
    stored = spark.read.parquet(cache).count()
    assert stored == len({r[1] or "" for r in ODD_ROWS})
    token_counts(odd, tokenizer, cache).collect()
    assert spark.read.parquet(cache).count() == stored
    assert token_counts(odd.limit(0), tokenizer, cache).count() == 0


def test_other_tokenizers(spark, tmp_path):
    import sentencepiece

    docs = spark.createDataFrame([(1, "Hello  wörld 123"), (2, None)], "doc_id long, text string")
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    word = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for name, want in (("piece_bpe_32k.model", len(model.encode("Hello  wörld 123"))), ("word_bpe_49k.json", len(word.encode("Hello  wörld 123", add_special_tokens=False).ids))):
        rows = token_counts(docs, TokenizerFile(public_tokenizers.path(name)), str(tmp_path / name)).collect()
        assert {r.doc_id: r.n_tokens for r in rows} == {1: want, 2: 0}


def remainder(d, m):
    return zlib.crc32(str(d).encode()) % m


def brute_lm(docs):
    """Base scores and mixture scores from plain dictionaries, with the weights that EM gives."""
    tokens = {d: [*words(t), None] for d, t in docs}
    one, two, ctx = Counter(), Counter(), Counter()
    main1, main2, main_ctx = Counter(), Counter(), Counter()
    for d, t in tokens.items():
        if d is None or remainder(d, 5) == 1:
            continue
        pairs = list(zip(["<s>", *t[:-1]], t, strict=True))
        one.update(t), two.update(pairs), ctx.update(["<s>", *t[:-1]])
        if remainder(d, 5) != 0:
            main1.update(t), main2.update(pairs), main_ctx.update(["<s>", *t[:-1]])
    n, n_main, v = sum(one.values()), sum(main1.values()), len(one)
    bucket = lambda c: int(math.log2(c)) if c else -1
    step = lambda p: round(language_model.STEPS * math.log2(p * (v + 1))) if p else -9999
    cells = Counter()
    for d, t in tokens.items():
        if d is not None and remainder(d, 5) == 0:
            for a, b in zip(["<s>", *t[:-1]], t, strict=True):
                c = main_ctx[a]
                cells[bucket(c), step(main2[a, b] / c if c else 0), step(main1[b] / n_main)] += 1
    weights = language_model.learn_weights(np.array([(*k, m) for k, m in cells.items()], np.int64).reshape(-1, 4))
    out = {}
    for d, t in tokens.items():
        base = score = 0.0
        for a, b in zip(["<s>", *t[:-1]], t, strict=True):
            base += math.log10((one[b] + 0.5) / (n + 0.5 * (v + 1)))
            c = ctx[a]
            k = min(max(bucket(c), min(weights)), max(weights))
            w = weights.get(k, weights.get(max((x for x in weights if x <= k), default=min(weights))))
            p1 = one[b] / n
            score += math.log10(w[0] * (two[a, b] / c if c else p1) + w[1] * p1 + w[2] / (v + 1))
        out[d] = (len(t), sum(one[b] > 0 for b in t), n, base, score)
    return out


def test_language_model_equals_brute_force(spark, docs, monkeypatch):
    monkeypatch.setattr(language_model, "BLOCK_BYTES", 40_000)
    got = {r.doc_id: r for r in query(spark, 6).collect()}
    want = brute_lm(list(docs.items()))
    gain = 0.0
    for d, (n_tokens, n_known, n, base, score) in want.items():
        r = got[d]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (n_tokens, n_known, n, remainder(d, 5) == 1)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score == pytest.approx(score, rel=1e-6)
        gain += (r.score - r.base_score) * r.held_out
    assert gain > 0


def test_weights_equal_those_of_plain_em():
    """The weights from the histogram against EM over single tokens with unrounded probabilities."""
    rng = np.random.default_rng(4)
    v = 5000
    rows = [(int(b), float(rng.beta(1, 9) * (rng.random() < 0.1 * (b + 2))), float(rng.beta(1, 300))) for b in rng.integers(-1, 5, 4000)]
    step = lambda p: round(language_model.STEPS * math.log2(p * (v + 1))) if p else -9999
    cells = Counter((b, step(p2), step(p1)) for b, p2, p1 in rows)
    got = language_model.learn_weights(np.array([(*k, m) for k, m in cells.items()], np.int64))
    for bucket in range(-1, 5):
        own, w = [r for r in rows if r[0] == bucket], [1 / 3] * 3
        for _ in range(60):
            share = [1.0, 1.0, 1.0]
            for _, p2, p1 in own:
                terms = [w[0] * p2, w[1] * p1, w[2] / (v + 1)]
                for i, t in enumerate(terms):
                    share[i] += t / sum(terms)
            w = [x / sum(share) for x in share]
        assert got[bucket] == pytest.approx(w, abs=0.02)


def test_language_model_leaves_nothing_behind(spark, odd, monkeypatch):
    before = {t.name for t in spark.catalog.listTables()}
    monkeypatch.setattr(language_model, "RANGE_BYTES", 1000)
    clash = odd.withColumns({"block": F.lit(1), "fold": F.lit("x"), "part": F.lit(None)})
    assert language_model.score(clash).count() == len(ODD_ROWS)
    monkeypatch.setattr(language_model, "learn_weights", None)
    with pytest.raises(TypeError):
        language_model.score(odd)
    assert {t.name for t in spark.catalog.listTables()} == before


def test_language_model_odd_rows(spark, odd):
    rows = language_model.score(odd).collect()
    assert len(rows) == len(ODD_ROWS)
    assert {r.doc_id: r.n_tokens for r in rows}[1] == 1
    assert all(math.isfinite(r.score) and r.score <= 0 for r in rows)
    assert language_model.score(odd.limit(0)).count() == 0
    one = language_model.score(odd.where("doc_id is null")).collect()
    assert [(r.train_tokens, r.n_known, r.base_score, r.score) for r in one] == [(0, 0, 0.0, 0.0)]


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    op4 = next(f for k, f in QUERIES.items() if k.startswith("op4_"))
    rows = op4(spark, sf).collect()
    assert len(rows) == 1000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    assert all(r.held_out == (remainder(r.doc_id, 3) == 1) for r in rows)
    counts = defaultdict(int)
    for r in rows:
        if r.held_out and r.doc_id in labels:
            counts[labels[r.doc_id], r.predicted] += 1
    assert counts[0, 1] <= 1 and counts[1, 1] >= 3 * counts[1, 0]


TOXIC = ["you stupid idiot are here", "what an idiot he was there", "such stupid people come along"]
CLEAN = ["the people come here along", "what was there to see", "he was such a kind man", "we are here to help you"]


@pytest.fixture(scope="module")
def small_model(spark):
    texts = [(i, f"{TOXIC[i % 3]} {i}") for i in range(30)] + [(i, f"{CLEAN[i % 4]} {i}") for i in range(30, 120)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 30)) for i in range(120)] + [(None, 1), (5, None)], "doc_id long, toxic int")
    return toxicity.train(docs, labels, fold("doc_id", 3) != 1)


def test_deobfuscation(spark, small_model):
    restore = lambda t: toxicity.restore(t, small_model.chars)
    assert restore("1d10t") == "idiot" and restore("$tup1d") == "stupid" and restore("stuuuupid") == "stupid" and restore("s.t.u.p.i.d") == "stupid"
    words = toxicity.Restorer(small_model.chars).words("What an i d i o t you are, St*u*pid!!")
    assert "stupid" in words and "idiot" in words
    assert "idiot" in toxicity.plain("!diot", small_model.chars) and "idiot" in toxicity.plain("id!o+", small_model.chars)
    assert toxicity.plain("(kind!)", small_model.chars)[0] == "kind"
    texts = ["an 1d10t here", "s t u p i d man", "stuuupid", "we are here to help", "", None, "kind people 2024 12:30", "St*u*pid"]
    rows = toxicity.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), small_model).collect()
    assert [r.score >= 0.7 for r in sorted(rows, key=lambda r: r.doc_id)] == [True, True, True, False, False, False, False, True]


def test_restoring_is_exact_viterbi(small_model):
    """Against all paths through the lattice."""
    import itertools

    model, rng = small_model.chars, np.random.default_rng(2)

    def weigh(path):
        x, y, s = 0, 0, 0.0
        for put, cost in path:
            s -= cost
            for ch in put:
                z = 0 if ch == " " else ord(ch)
                s += model.log(x, y, z) if z or y else 0
                x, y = (0, 0) if not z else (y, z)
        return s

    tokens = ["".join(rng.choice(list("aidstupo10!$*|3@-."), rng.integers(2, 7))) for _ in range(100)]
    for token in tokens:
        paths = list(itertools.product(*toxicity.lattice(token), [(" ", 0.0)]))
        best = sorted(((weigh(p), " ".join("".join(c for c, _ in p).split())) for p in paths), reverse=True)
        assert toxicity.restore(token, model) in {t for w, t in best if w >= best[0][0] - 1e-9}


def test_toxicity_equals_brute_force(spark):
    """The query against tables, evidence and scores from plain loops over the same tables."""
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    label = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    tri, bi = Counter(), Counter()
    for t in text.values():
        c = [ord(x) if x.isalpha() else 0 for x in f"  {(t or '').lower()}  "]
        for x, y, z in zip(c, c[1:], c[2:], strict=False):
            if y or z:
                x = x if y else 0
                tri[toxicity._tri(x, y, z)] += 1
                bi[toxicity._bi(x, y)] += 1
    model = toxicity.train(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"), fold("doc_id", 3) != 1)
    assert {i: int(n) for i, n in enumerate(model.chars.tri) if n} == tri and {i: int(n) for i, n in enumerate(model.chars.bi) if n} == bi
    restorer = toxicity.Restorer(model.chars)
    held = {d: restorer.words(t or "") for d, t in text.items()}
    rows = [d for d in label if d in text and remainder(d, 3) != 1]
    toxic = sum(label[d] for d in rows)
    t, c = Counter(), Counter()
    for d in rows:
        (t if label[d] else c).update({f for w in held[d] for f in toxicity.evidence(w)})

    def weight(n_t, n_c, big_t, big_c):
        return math.log((n_t + 0.5) / (big_t + 1)) - math.log((n_c + 0.5) / (big_c + 1)) - 1 / (n_t + 0.5)

    weights = {f: w for f in t if t[f] >= toxicity.SUPPORT and t[f] > c[f] and (w := weight(t[f], c[f], toxic, len(rows) - toxic)) >= toxicity.LEAST_WEIGHT}
    assert model.weights == pytest.approx(weights)
    # The fitted curve is where the gradient of its ridge-bound likelihood is nought, or at its bounds.
    got = {r.doc_id: r for r in query(spark, 4).collect()}
    for d, words_of in held.items():
        best = sorted({max((weights[f], f) for f in toxicity.evidence(w) if f in weights) for w in words_of if any(f in weights for f in toxicity.evidence(w))}, reverse=True)
        best = [b for b in best if b[0] > 0]
        z = model.offset + model.slopes[0] * (best[0][0] if best else 0) + model.slopes[1] * sum(w for w, _ in best[1:3])
        assert got[d].score == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-9) and got[d].hits == [f for _, f in best[:3]]


def test_repeated_labels_and_far_letters(spark):
    docs = spark.createDataFrame([(i, f"{TOXIC[i % 3]} \U00010450\U00010451" if i < 30 else CLEAN[i % 4]) for i in range(120)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 30)) for i in range(120)] * 3, "doc_id long, toxic int")
    model = toxicity.train(docs, labels, fold("doc_id", 3) != 1)
    once = toxicity.train(docs, labels.distinct(), fold("doc_id", 3) != 1)
    assert (model.toxic, model.clean, model.counts) == (once.toxic, once.clean, once.counts)
    assert model.chars.tri[toxicity._tri(0, 0x10450, 0x10451)] > 0 and "\U00010450\U00010451" in model.counts


def test_toxicity_odd_rows(spark, odd, small_model):
    rows = toxicity.score(odd, small_model).collect()
    assert len(rows) == len(ODD_ROWS) and all(0 <= r.score < 0.7 for r in rows)
    assert toxicity.score(odd.limit(0), small_model).count() == 0
    nothing = toxicity.train(odd, spark.createDataFrame([], "doc_id long, toxic int"), F.lit(True))
    assert all(r.score < 0.7 for r in toxicity.score(odd, nothing).collect())


def test_near_dedup_at_eighty_percent(spark):
    assert near_dedup.least_agreeing(85) == 42 and near_dedup.least_agreeing(80) == 37
    # One shingle set of 96 and another that lacks the last 18: a similarity of 78 / 96.
    words = [f"z{i}" for i in range(100)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:82])), *near_group(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    comp = brute_components({d: shingles(t) for d, t in rows}, 80)
    assert comp[2] == 1 != brute_components({d: shingles(t) for d, t in rows}, 85)[2]
    assert {r.doc_id for r in near_dedup.keep_one(docs, 80).collect()} == {d for d in comp if comp[d] == d}


@pytest.mark.parametrize("text", ["_" * 1_000_000 + "(sign)", "a_." * 300_000 + "(", "a_" * 300_000 + "(", "a" + "-" * 1_000_000 + "b", "*" * 1_000_000, "a b c " * 150_000, "1" * 500_000 + "a", "(" * 1_000_000 + "a", '"' * 1_000_000, "&<" * 500_000])
def test_no_text_holds_up_the_decoding(small_model, text):
    start = time.monotonic()
    toxicity.Restorer(small_model.chars).words(text)
    assert time.monotonic() - start < 60


def test_chains_of_spaced_letters():
    found = lambda text: list(toxicity.spaced_chains(text))
    assert found("you i d i o t, go") == ["i d i o t"]
    assert found("x.i.d.i.o.t!") == ["x.i.d.i.o.t"] and found("s_t_u_p_i_d") == ["s_t_u_p_i_d"]
    assert found("___ ____ _ _ _") == [] and found("a b") == [] and found("a   b   c") == []
    assert found("(a-b-c") == [] and found("(a b c d") == ["b c d"] and found("a b c d-e(") == ["a b c"]


def test_more_ranges_than_spark_has_buckets(spark, docs, monkeypatch):
    """A corpus whose ranges pass Spark's limit of buckets has several blocks in a bucket, and the same scores."""
    monkeypatch.setattr(language_model, "BLOCK_BYTES", 40_000)
    want = {r.doc_id: (r.base_score, r.score) for r in query(spark, 6).collect()}
    monkeypatch.setattr(language_model, "RANGE_BYTES", 20_000)
    limit = spark.conf.get("spark.sql.sources.bucketing.maxBuckets")
    spark.conf.set("spark.sql.sources.bucketing.maxBuckets", "3")
    try:
        got = {r.doc_id: (r.base_score, r.score) for r in query(spark, 6).collect()}
    finally:
        spark.conf.set("spark.sql.sources.bucketing.maxBuckets", limit)
    assert got.keys() == want.keys() and all(got[d] == pytest.approx(want[d], rel=1e-9) for d in want)


def test_token_counts_with_clashing_columns(spark, odd, tmp_path):
    tokenizer = TokenizerFile(public_tokenizers.path("byte_bpe_50k.json"))
    clash = odd.withColumns({"content": F.lit("x"), "pick": F.lit(1), "n": F.lit(None), "n_tokens": F.lit("y"), "tokenizer": F.lit(0)})
    want = sorted((r.doc_id or 0, r.n_tokens) for r in token_counts(odd, tokenizer, str(tmp_path / "a")).collect())
    assert sorted((r.doc_id or 0, r.n_tokens) for r in token_counts(clash, tokenizer, str(tmp_path / "b")).collect()) == want
