"""Pieces of large texts: every finding once, at its place in the whole text."""

import random
import re

import pytest
from pyspark.sql import functions as F

from sieveworks.plans.dialect import never_in_matches
from sieveworks.plans.ruleset import parse
from sieveworks.plans.scan import ScanOptions, scan
from sieveworks.sources import windows
from sieveworks.sources.windows import byte_fragments, fragment_cuts, fragment_pieces, window_pieces

RULES = """
[[rules]]
id = "token"
regex = 'tok-[a-z0-9]{8,}'
keywords = ["tok-"]
[[rules]]
id = "block"
regex = '(?s)BEGIN.{0,200}?END'
keywords = ["begin"]
"""


def places(text):
    for rule, rx in (("token", "tok-[a-z0-9]{8,}"), ("block", "(?s)BEGIN.{0,200}?END")):
        for m in re.finditer(rx, text):
            line, start = text.count("\n", 0, m.start()) + 1, text.rfind("\n", 0, m.start()) + 1
            yield rule, line, m.start() - start + 1, m[0]


def found(spark, text, **options):
    content = spark.createDataFrame([("a.txt", text)], "path string, text string")
    rows = scan(content, parse(RULES), ScanOptions(mode="native", **options)).select("rule_id", "start_line", "start_column", "match").collect()
    return sorted(tuple(r) for r in rows)


def made_up(n, seed, breaks):
    rng = random.Random(seed)
    parts = []
    for _ in range(n):
        parts.append(rng.choice(["tok-", "tok-abcd1234ef", "BEGIN x", "END", "é日本", "word", "tok-" + "z" * rng.randint(1, 60), *breaks]))
    return "".join(parts)


@pytest.mark.parametrize(("seed", "breaks"), [(1, ["\n", "\n\n", " "]), (2, [" "]), (3, [" "] * 5 + ["\n"])])
def test_windows_find_what_the_whole_text_has(spark, seed, breaks):
    text = made_up(6_000, seed, breaks)
    want = sorted(places(text))
    assert len(want) > 500 and found(spark, text) == want
    # Matches here are shorter than 300 bytes; cuts fall everywhere.
    for size in (1_000, 1_357, 20_000):
        assert found(spark, text, piece_bytes=size, overlap_bytes=600) == want


def test_matches_that_follow_one_on_the_other(spark):
    # Pairs of long words, in runs far longer than windows and their overlap: a window that begins at an odd word
    # must not pair them otherwise than the whole text does. Words and gaps are longer than the overlap, too.
    rx = r"[a-z]{9,}[\s,.;]+[a-z]{9,}"
    rng = random.Random(5)
    text = "".join(rng.choice(["longerword, ", "A ", "short ", "anotherword\n", "thewholeword " * 301, "X" + "y" * 900 + " " * 700]) for _ in range(400))
    want = sorted(((text.count("\n", 0, m.start()) + 1, m.start() - text.rfind("\n", 0, m.start()), m[0]) for m in re.finditer(rx, text)))
    rules = parse(f"[[rules]]\nid = 'pair'\nregex = '{rx}'\n")
    content = spark.createDataFrame([("a.txt", text)], "path string, text string")
    for size in (1_000, 2_357):
        got = scan(content, rules, ScanOptions(mode="native", piece_bytes=size, overlap_bytes=100)).select("start_line", "start_column", "match").collect()
        assert sorted(map(tuple, got)) == want


def test_characters_that_no_match_holds():
    chars = lambda rx: {chr(c) for c in never_in_matches(rx)}
    assert chars(r"[a-z]{9,}[\s,.;]+[a-z]{9,}") >= set("ABZ019!\"'-:") and not chars(r"[a-z]{9,}[\s,.;]+[a-z]{9,}") & set("az ,.;\n\t")
    assert not chars(r"(?i)k[^\n]x") & set("kKxX") and chars(r"a[^\n]") == {"\n"} and not chars(r"a[^\s]") & set(" \n")
    assert not any(map(chars, (r"(?s)a.b", r"[[:alpha:]]+", r"a{,3}", r"\pL+", r"a\Z|(?=b).", r"\S\W")))
    assert not chars(r"(a|(?:b|c)?)d\b[-_]") & set("abcd-_") and "e" in chars(r"(a|(?:b|c)?)d\b[-_]")


def test_secrets_across_every_cut_of_a_text_larger_than_a_batch(spark):
    filler, secret = "x" * 1013 + "\n", "tok-0123456789abcdef"
    size = windows.WINDOW_BYTES
    text = bytearray((filler * (40 << 10)).encode())
    # A long line in the middle, so that some cuts fall inside of lines.
    text[10 << 20 : 20 << 20] = b"y" * (10 << 20)
    at = [c + d for c in range(size, len(text) - size, size) for d in (-10, 131_072)]
    for i in at:
        text[i : i + len(secret) + 1] = (secret + " ").encode()
    text = text.decode()
    got = found(spark, text, piece_bytes=size)
    assert got == sorted(places(text)) and len(got) > 300


def test_marks_on_lines_that_a_cut_goes_through(spark):
    line = "a" * 3_000 + " tok-aaaabbbb " + "b" * 3_000 + " # gitleaks:allow " + "c" * 3_000
    text = f"tok-11112222\n{line}\ntok-33334444"
    assert [r[3] for r in found(spark, text, piece_bytes=500, overlap_bytes=100)] == ["tok-11112222", "tok-33334444"] == [r[3] for r in found(spark, text)]
    assert len(found(spark, text, piece_bytes=500, overlap_bytes=100, ignore_inline_marks=True)) == 3


def test_pieces_partition_the_text_and_know_their_place():
    rng = random.Random(4)
    for k in range(300):
        text = "".join(rng.choice("ab \n\n\té日x" if k % 3 else "abé") for _ in range(rng.randint(0, 400)))
        data = text.encode()
        assert b"".join(p[0] for p in fragment_pieces(data, 37, 11)) == data
        own = ""
        for piece, line, column, a, b, _ in window_pieces(data, 37, 13):
            before = text[: len(own) - a]
            assert (line, column) == (before.count("\n") + 1, len(before) - before.rfind("\n"))
            own += piece.decode()[a:b]
        assert own == text


def test_fragments_go_on_to_the_next_blank_line(spark):
    assert fragment_cuts(b"a" * 50 + b"\n \n" + b"b" * 200, 40, 30) == [0, 53, 123, 193]
    assert fragment_cuts(b"a" * 38 + b"\n\n" + b"b" * 5, 40, 30) == [0, 40]
    assert fragment_cuts(b"a\n" * 30, 40, 5) == [0, 45] and fragment_cuts(b"", 4, 1) == [0]
    text = "x" * 70_000 + " tok-aaaabbbb\n\n" + "y" * 60_000 + " tok-ccccdddd\n"
    strict = scan(spark.createDataFrame([("a", text)], "path string, text string"), parse(RULES), ScanOptions(piece_bytes=60_000))
    assert sorted((r.secret, r.start_line) for r in strict.collect()) == [("tok-aaaabbbb", 1), ("tok-ccccdddd", 3)]


def test_columns_null_and_empty_texts(spark):
    rows = [("a", None, 1, "x"), ("b", "", 2, None), ("c", "t" * 100, 3, "y"), ("c", "t" * 100, 3, "y")]
    content = spark.createDataFrame(rows, "path string, text string, size int, `odd name` string").withColumn("fragment", F.lit(9))
    got = byte_fragments(content, 40, 0).collect()
    assert sorted((r.path, r.fragment, r["odd name"]) for r in got) == sorted([("a", 0, "x"), ("b", 0, None), *[("c", k, "y") for k in (0, 1, 2)] * 2])
    assert windows.windows(content, 40, 3, deal=True).count() == 1 + 1 + 6
    assert windows.windows(content.limit(0)).count() == 0


def test_encoded_secrets_in_windows(spark):
    import base64

    coded = base64.b64encode(b"my tok-0123456789 here").decode()
    text = "".join(f"line {i}\n" for i in range(800)) + f"x {coded} y\n" + "z" * 3000
    content = spark.createDataFrame([("a.txt", text)], "path string, text string")
    for size in (500, 777, None):
        rows = scan(content, parse(RULES), ScanOptions(mode="native", max_decode_depth=2, piece_bytes=size, overlap_bytes=200)).collect()
        assert [(r.secret, r.start_line, r.start_column, r.tags) for r in rows] == [("tok-0123456789", 801, 3, ["decoded:base64"])]


@pytest.mark.parametrize("text", ["a" * 1_000_000, "_" * 1_000_000 + "(", "%" * 1_000_000, '"a"+' * 200_000, "a-" * 400_000 + "====x", "ab" * 500_000 + "z", '"' * 500_000])
def test_no_text_holds_up_the_decoders(text):
    import time

    from sieveworks.operators.decode import decode_text

    start = time.monotonic()
    decode_text(text, True)
    assert time.monotonic() - start < 30
