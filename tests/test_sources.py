import gzip
import io
import json
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from sieveworks.functions.text import byte_entropy, duration_text, git_date, remote_https, version_at_least
from sieveworks.operators.randomness import quality, samples, score
from sieveworks.operators.redact import interleave, mask
from sieveworks.plans.ruleset import parse
from sieveworks.plans.scan import ScanOptions, scan
from sieveworks.sources import reports, writers
from sieveworks.sources.archives import Budget, archive_content, expand
from sieveworks.sources.content import file_content, fragments, ignore_patterns
from sieveworks.sources.patches import commit_count, patch_content
from sieveworks.streaming.incremental import cache_stats, scan_cached, scan_stream

RULES = """[[rules]]\nid = "t"\ndescription = "tok"\nregex = 'tok-[a-z<>&]+'\nkeywords = ["tok-"]"""


def test_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a b.txt").write_text("tok-abc")
    (tmp_path / "sub/plain").write_text("tok-def")
    (tmp_path / "sub/.hidden").write_text("tok-hid")
    (tmp_path / "wide.txt").write_bytes("tok-wide".encode("utf-16"))
    (tmp_path / "bin").write_bytes(b"tok-no\0")
    (tmp_path / "big.txt").write_text("tok-big" * 100)
    (tmp_path / "skip.log").write_text("tok-log")
    rows = scan(file_content(spark, str(tmp_path), native=True, max_bytes=100, ignore=["*.log"]), parse(RULES), ScanOptions(mode="native"))
    assert sorted((r.path, r.secret) for r in rows.collect()) == [("a b.txt", "tok-abc"), ("sub/.hidden", "tok-hid"), ("sub/plain", "tok-def"), ("wide.txt", "tok-wide")]
    one = file_content(spark, f"file://{tmp_path}/sub/plain").collect()
    assert [(r.path, r.text, r.length) for r in one] == [("plain", "tok-def", 7)]


def test_hidden_files_and_folders_are_listed(spark, tmp_path, monkeypatch):
    for name in (".env", ".docker/config.json", "_build/x", "a/b/c/.npmrc", "a/d/é ü%20.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(f"tok-{name[-1]}")
    (tmp_path / "a/loop").symlink_to(tmp_path)
    want = {".env", ".docker/config.json", "_build/x", "a/b/c/.npmrc", "a/d/é ü%20.txt"}
    for limit in (1, 64):
        monkeypatch.setattr("sieveworks.sources.content.LISTED_FOLDERS", limit)
        assert {r.path for r in file_content(spark, str(tmp_path)).collect()} == want
    found = scan(file_content(spark, str(tmp_path)), parse(RULES)).collect()
    assert {r.path for r in found} == want


def test_path_rules_see_large_and_binary_files(spark, tmp_path):
    (tmp_path / "key.p12").write_bytes(b"\0" * 50)
    (tmp_path / "large.p12").write_text("tok-abc" * 100)
    rules = parse(RULES + """\n[[rules]]\nid = "store"\npath = '\\.p12$'""")
    rows = scan(file_content(spark, str(tmp_path), native=True, max_bytes=100), rules, ScanOptions(mode="native"))
    assert sorted((r.path, r.rule_id) for r in rows.collect()) == [("key.p12", "store"), ("large.p12", "store")]
    rows = scan(file_content(spark, str(tmp_path)), rules, ScanOptions(max_target_bytes=100))
    assert sorted((r.path, r.rule_id) for r in rows.collect()) == [("key.p12", "store"), ("large.p12", "store")]


def test_ignore_patterns():
    import re

    hit = lambda line, path: bool(re.match(ignore_patterns([line])[0][0], path))
    assert hit("*.log", "a/b.log") and not hit("/x.log", "a/x.log") and hit("build/", "a/build/x") and hit("a/**/z", "a/b/c/z") and ignore_patterns(["# c", "", "!keep"]) == [(ignore_patterns(["keep"])[0][0], True)]


PATCH = """commit 1111111111111111111111111111111111111111
Author: A B <a@example.org>
Date:   2024-01-01T10:00:00+02:00

    first

diff --git a/x.txt b/x.txt
--- /dev/null
+++ b/x.txt
@@ -0,0 +1,3 @@
+one
+tok-abc
+three
diff --git "a/\\303\\251.txt" "b/\\303\\251.txt"
--- "a/\\303\\251.txt"
+++ "b/\\303\\251.txt"
@@ -4,0 +5 @@ ctx
+tok-def
commit 2222222222222222222222222222222222222222
Author: C <c@example.org>
Date:   2024-01-02T10:00:00Z

    only deletes

diff --git a/x.txt b/x.txt
--- a/x.txt
+++ b/x.txt
@@ -2 +1,0 @@
-tok-abc
"""


def test_patches(spark):
    content = patch_content(spark.createDataFrame([(PATCH,)], "text string"))
    assert commit_count(content).first().commits == 2
    rows = scan(content, parse(RULES)).orderBy("path").collect()
    assert [(r.path, r.secret, r.author, r.message) for r in rows] == [("x.txt", "tok-abc", "A B", "first"), ("é.txt", "tok-def", "A B", "first")]
    assert [r.start_line for r in rows] == [2, 5]
    assert rows[0].fingerprint == "1" * 40 + ":x.txt:t:2"


def test_archives(spark):
    inner = io.BytesIO()
    with zipfile.ZipFile(inner, "w") as z:
        z.writestr("deep.txt", "tok-deep")
    outer = io.BytesIO()
    with zipfile.ZipFile(outer, "w") as z:
        z.writestr("a.txt", "tok-abc")
        z.writestr("../evil", "x")
        z.writestr("in.zip", inner.getvalue())
    tar = io.BytesIO()
    with tarfile.open(fileobj=tar, mode="w:gz") as t:
        info = tarfile.TarInfo("t.txt")
        info.size = 3
        t.addfile(info, io.BytesIO(b"tar"))
    files = spark.createDataFrame([("o.zip", bytearray(outer.getvalue())), ("t.tgz", bytearray(tar.getvalue())), ("p.txt", bytearray(b"plain")), ("g.txt.gz", bytearray(gzip.compress(b"gz")))], "path string, content binary")
    got = {r.path: bytes(r.content) for r in archive_content(files).collect()}
    assert got == {"o.zip!a.txt": b"tok-abc", "o.zip!in.zip!deep.txt": b"tok-deep", "t.tgz!t.tar!t.txt": b"tar", "p.txt": b"plain", "g.txt.gz!g.txt": b"gz"}
    assert [n for n, _ in expand("o.zip", outer.getvalue(), Budget(entries=1))] == ["o.zip!a.txt"]
    assert list(expand("bomb.gz", gzip.compress(b"0" * 10_000_000), Budget(ratio=10))) == []


def test_fragments(spark):
    text = "a" * 50 + "\n\n" + "b" * 200
    rows = fragments(spark.createDataFrame([("p", text), ("q", "")], "path string, text string"), 40, 30).orderBy("path", "fragment").collect()
    assert "".join(r.text for r in rows if r.path == "p") == text
    assert [(r.start_offset, r.start_line) for r in rows if r.path == "p"][:2] == [(0, 1), (52, 3)]
    assert [r.text for r in rows if r.path == "q"] == [""]


@pytest.fixture
def findings(spark):
    content = spark.createDataFrame([("a.txt", "tok-abc\n tok-<&>"), ("b.txt", "=tok-def")], "path string, text string")
    return scan(content, parse(RULES)).cache()


def test_upstream_json_round_trip(spark, findings, tmp_path):
    out = io.StringIO()
    writers.write_upstream_json(findings, out)
    assert "\\u003c\\u0026\\u003e" in out.getvalue() and out.getvalue().startswith("[\n {\n  \"RuleID\"")
    assert reports.sniff(out.getvalue()) == "upstream"
    (tmp_path / "r.json").write_text(out.getvalue())
    back = reports.read_upstream(spark, str(tmp_path / "r.json"))
    assert sorted(r.secret for r in back.collect()) == ["tok-<&>", "tok-abc", "tok-def"]
    empty = io.StringIO()
    writers.write_upstream_json(findings.limit(0), empty)
    assert empty.getvalue() == "[]\n"


def test_other_reports(spark, findings, tmp_path):
    targets = {f: str(tmp_path / f) for f in ("jsonl", "parquet", "csv", "junit", "sarif", "quality", "html", "toon")}
    writers.write_reports(findings, targets)
    rows = lambda df: sorted((r.rule_id, r.path, r.start_line) for r in df.collect())
    want = [("t", "a.txt", 1), ("t", "a.txt", 2), ("t", "b.txt", 1)]
    assert rows(reports.read_findings(spark, targets["jsonl"])) == want
    assert rows(reports.read_sarif(spark, targets["sarif"])) == want
    assert rows(reports.read_quality(spark, targets["quality"])) == want
    assert rows(reports.read_html(spark, targets["html"])) == want
    assert reports.sniff(open(targets["sarif"]).read()) == "sarif" and reports.sniff(open(targets["quality"]).read()) == "quality"
    assert open(targets["junit"]).read().count("<testcase") == 3
    assert open(targets["toon"]).read().splitlines()[0].startswith("findings[3]")
    assert open(targets["csv"]).read().splitlines()[0].startswith("RuleID,Commit")
    nothing = io.StringIO()
    writers.write_upstream_csv(findings.limit(0), nothing)
    assert nothing.getvalue() == ""
    assert writers.format_of("x/y.SARIF") == "sarif" and writers.format_of("x") is None


def test_trufflehog(spark, tmp_path):
    row = {"DetectorName": "AWS", "Verified": True, "SourceMetadata": {"Data": {"Git": {"file": "a", "line": 3, "commit": "c"}}}}
    (tmp_path / "t.jsonl").write_text(json.dumps(row) + "\n")
    got = reports.read_trufflehog(spark, str(tmp_path / "t.jsonl")).first()
    assert (got.rule_id, got.path, got.start_line, got.fingerprint, got.validation_state) == ("AWS", "a", 3, "AWS:a:3", "active")
    assert reports.sniff(json.dumps(row) + "\n" + json.dumps(row)) == "jsonl-trufflehog"


def test_cache_and_stream(spark, tmp_path):
    content = spark.createDataFrame([("a.txt", "tok-abc"), ("b.txt", "nothing")], "path string, text string")
    cache = str(tmp_path / "cache")
    assert [r.secret for r in scan_cached(content, parse(RULES), cache).collect()] == ["tok-abc"]
    more = content.union(spark.createDataFrame([("c.txt", "tok-def")], "path string, text string"))
    assert sorted(r.secret for r in scan_cached(more, parse(RULES), cache).collect()) == ["tok-abc", "tok-def"]
    assert [r.contents for r in cache_stats(spark, cache).collect()] == [3]
    more.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(more.schema).parquet(str(tmp_path / "in"))
    scan_stream(stream, parse(RULES), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(60)
    assert sorted(r.secret for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["tok-abc", "tok-def"]


def test_functions(spark):
    one = lambda c: spark.range(1).select(c.alias("v")).first().v
    assert one(mask(F.lit("12345678"), 25)) == "123456..." and one(mask(F.lit("ab"), 20)) == "ab..." and one(mask(F.lit("ab"), 20, native=True)) == "a..."
    assert one(mask(F.lit("abc"), 50)) == "ab..." and one(mask(F.lit("abcde"), 50)) == "ab..." and one(mask(F.lit("x"), 100)) == "REDACTED"
    assert one(interleave(F.lit("ab"), F.lit("*"))) == "*a*b*" and one(interleave(F.lit(""), F.lit("*"))) == "*"
    assert one(remote_https(F.lit("git@h.org:a/b.git"))) == "https://h.org/a/b" and one(remote_https(F.lit("ssh://git@h.org:22/a/b"))) == "https://h.org/a/b"
    assert one(byte_entropy(F.lit("aabb"))) == pytest.approx(1.0) and one(byte_entropy(F.lit(""))) == 0
    assert one(git_date(F.lit("2024-01-01T10:00:00+02:00"))) == "2024-01-01T08:00:00Z"
    assert version_at_least("8.30.1", "v8.9") and not version_at_least("8.3", "8.25.0")
    assert duration_text(0.0012) == "1.2ms" and duration_text(75) == "1m15s"


def test_randomness_separates(spark):
    import numpy as np

    rows = samples(200, seed=9)
    df = spark.createDataFrame(rows, "secret string, label int").select(score(F.col("secret")).alias("p"), "label").toPandas()
    assert quality(df.p.to_numpy(), df.label.to_numpy().astype(float))["accuracy"] > 0.95
    assert np.isfinite(df.p).all()
