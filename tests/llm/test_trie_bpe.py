"""Encoding by the trie of distinct words, against the library."""

import hashlib
import json
import random

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sieveworks.llm import trie_bpe
from sieveworks.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
FILE = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(FILE)
    t.no_truncation()
    t.no_padding()
    return t


def ids(coded):
    return np.frombuffer(coded, "<u4").tolist()


def test_query_equals_library(spark, library):
    docs = duckdb.sql(f"SELECT doc_id, coalesce(text, '') FROM '{SF}/documents.parquet'").fetchall()
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = set()
    for d, t in docs:
        x = library.encode(t, add_special_tokens=False).ids
        want.add((d, len(x), sha(np.array(x, "<u4").tobytes()), sha(library.decode(x, skip_special_tokens=False).encode())))
    assert {tuple(r) for r in QUERIES["op13_trie_bpe"](spark, SF).collect()} == want


@pytest.mark.parametrize("letters", ["aeinrstth ',", " \t\r\n", "sreé日本😀́", "=-_*#", "0123456789a", "aaaaaaab", "<|endoftext|>", "<|endoftext|> x\n"])
def test_random_words_equal_library(library, letters):
    rng, c = random.Random(letters), trie_bpe.coder(trie_bpe.load(FILE))
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 80))) for _ in range(400)]
    texts += [f"x  <|endoftext|>  {t}<|endoftext|><|endoftext|>" for t in texts[:50]] + [letters * 5000]
    for text, got, want in zip(texts, c.encode(texts), library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert ids(got) == want.ids and c.decode(got) == library.decode(want.ids, skip_special_tokens=False) == text


def test_every_token_of_the_vocabulary(library):
    c = trie_bpe.coder(trie_bpe.load(FILE))
    texts = [b.decode() for b in c.bpe.bytes_of if b and b.isascii()]
    assert [ids(x) for x in c.encode(texts)] == [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]


def small(merges):
    """A vocabulary of a few merges over bytes, some of whose tokens their own bytes never give."""
    letters = trie_bpe.byte_letters()
    texts = [*letters, *[a + b for a, b in merges]]
    model = {"type": "BPE", "vocab": {t: i for i, t in enumerate(texts)}, "merges": [list(m) for m in merges]}
    level = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
    return {"version": "1.0", "added_tokens": [], "normalizer": None, "pre_tokenizer": level, "post_processor": None, "decoder": level, "model": model}


def test_merges_of_pairs_not_of_bytes():
    # "bc" is made before "ab", so that "abc" is never reached from "ab"; and equal pairs merge leftmost first.
    config = small([("b", "c"), ("a", "b"), ("ab", "c"), ("a", "a"), ("aa", "a"), ("aa", "aa"), ("c", "a"), ("bc", "a")])
    lib, c = Tokenizer.from_str(json.dumps(config)), trie_bpe.MergeBpe(config)
    rng = random.Random(3)
    words = list({"".join(rng.choice("abc") for _ in range(rng.randint(1, 14))) for _ in range(2000)})
    got = c.encode_many([w.encode() for w in words])
    assert [ids(x) for x in got] == [lib.encode(w, add_special_tokens=False).ids for w in words]


def test_prefixes_are_worked_out_once():
    words = [b"token", b"tokens", b"to", b"tokenizer", b"other", b""]
    new = {i: (word[depth:], depth) for i, word, depth in trie_bpe.WordTrie(words).walk()}
    assert sum(len(rest) for rest, _ in new.values()) == len({w[:k] for w in words for k in range(1, len(w) + 1)})
    assert new[3] == (b"izer", 5) and new[1] == (b"s", 5)


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError):
        trie_bpe.MergeBpe(json.loads(trie_bpe.load(public_tokenizers.path("word_bpe_49k.json"))))
    for merges in ([("ab", "c"), ("a", "b")], [("a", "b"), ("ab", "c"), ("b", "c"), ("a", "bc")]):
        with pytest.raises(ValueError):
            trie_bpe.MergeBpe(small(merges))


def test_odd_rows(spark, library):
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "One  TWO"), (4, "One  TWO"), (None, "null id"), (5, "long " * 60_000), (6, "x" * 50_000), (7, "é ü 'tis <|endoftext|> \U0001f600")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"ids": F.lit(1), "decoded": F.lit("x"), "token": F.lit(None)})
    data = trie_bpe.load(FILE)
    coded = trie_bpe.encode(docs, data, decode=True)
    got = sorted((r.doc_id or 0, ids(r.ids), r.decoded) for r in coded.collect())
    assert got == sorted((d or 0, library.encode(t or "", add_special_tokens=False).ids, t or "") for d, t in rows)
    assert sorted((r.doc_id or 0, r.decoded) for r in trie_bpe.decode(coded, data).collect()) == [(d, t) for d, _, t in got]
    assert trie_bpe.encode(docs.limit(0), data).count() == 0
    assert trie_bpe.decode(spark.createDataFrame([(1, None)], "doc_id long, ids binary"), data).first().decoded is None
