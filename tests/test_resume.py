"""Scans that go on after they were stopped, and the cache."""

import pytest
from pyspark.sql import functions as F

from sieveworks.plans.ruleset import parse
from sieveworks.plans.scan import ScanOptions, scan
from sieveworks.sources.content import file_content, listing
from sieveworks.streaming import resume
from sieveworks.streaming.incremental import cache_stats, export_cache, finding_rates, import_cache, new_findings, scan_cached
from sieveworks.streaming.resume import journal, manifest, scan_resumable

RULES = "[[rules]]\nid = 't'\nregex = 'tok-(\\w+)'\nkeywords = ['tok-']"


def secrets(df):
    return sorted(r.secret for r in df.collect())


def test_a_stopped_scan_goes_on_without_repeats_or_gaps(spark, tmp_path, monkeypatch):
    inputs = spark.createDataFrame([(f"f{i}", i) for i in range(60)], "path string, size int")
    read = []

    def load(rows):
        read.extend(r.path for r in rows.collect())
        return rows.select("path", F.concat(F.lit("tok-"), "path").alias("text"))

    rules, out = parse(RULES), str(tmp_path / "out")
    some = scan_resumable(inputs, load, rules, out, parts=8, stop_after=3)
    assert 0 < some.count() == len(read) < 60
    # Killed while a part is scanned, and once between its findings and its entry.
    part_of = resume.scan
    monkeypatch.setattr(resume, "scan", lambda content, *a: (_ for _ in ()).throw(RuntimeError("killed")))
    with pytest.raises(RuntimeError):
        scan_resumable(inputs, load, rules, out, parts=8)
    monkeypatch.setattr(resume, "scan", part_of)
    run = manifest(inputs, rules, ScanOptions(), 8)
    done = {r.part for r in journal(spark, out, run).collect()}
    other = next(p for p in range(8) if p not in done)
    some.limit(5).write.parquet(f"{out}/findings/run={run}/part={other}")
    assert secrets(scan_resumable(inputs, load, rules, out, parts=8, stop_after=0)) == secrets(some)
    before = len(set(read))
    read.clear()
    every = scan_resumable(inputs, load, rules, out, parts=8)
    assert secrets(every) == sorted(f"f{i}" for i in range(60)) and before <= 60 and len(read) == len(set(read)) == 60 - some.count()
    read.clear()
    assert scan_resumable(inputs, load, rules, out, parts=8).count() == 60 and not read
    assert journal(spark, out, run).agg(F.sum("inputs"), F.sum("findings")).first()[:] == (60, 60)
    # Other inputs and other rules are other runs.
    assert scan_resumable(inputs.where("size < 5"), load, rules, out, parts=8).count() == 5 and len(read) == 5
    assert scan_resumable(inputs, load, parse(RULES.replace("tok-(", "tok-f(")), out, parts=8, stop_after=0).count() == 0
    assert scan_resumable(inputs.limit(0), load, rules, out).count() == 0


def test_files_are_scanned_by_parts_of_their_listing(spark, tmp_path):
    for i in range(20):
        (tmp_path / "in" / f"d{i % 3}").mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / f"d{i % 3}" / f"f{i}.txt").write_text(f"tok-{i}x")
    root = str(tmp_path / "in")
    load = lambda rows: file_content(spark, root, listed=rows)
    got = scan_resumable(listing(spark, root), load, parse(RULES), str(tmp_path / "out"), parts=4)
    assert secrets(got) == sorted(f"{i}x" for i in range(20))


def test_contents_under_one_id_keep_their_findings(spark, tmp_path):
    rows = [(1, "a", "tok-one"), (1, "b", "tok-two tok-two"), (2, "a", "tok-one"), (1, "a", "tok-three")]
    content = spark.createDataFrame(rows, "input_id long, path string, text string")
    cache = str(tmp_path / "cache")
    want = sorted([(1, "one"), (1, "two"), (1, "two"), (2, "one"), (1, "three")])
    for _ in range(2):
        assert sorted((r.input_id, r.secret) for r in scan_cached(content, parse(RULES), cache).collect()) == want
    plain = scan(content, parse(RULES))
    assert set(scan_cached(content, parse(RULES), cache).columns) == set(plain.columns)
    assert [r.contents for r in cache_stats(spark, cache).collect()] == [3]


def test_export_and_import(spark, tmp_path):
    content = spark.createDataFrame([("a", "tok-one"), ("b", "none")], "path string, text string")
    first, second, export = (str(tmp_path / x) for x in ("first", "second", "export"))
    scan_cached(content, parse(RULES), first).collect()
    assert export_cache(spark, first, export) == {"seen": 2, "findings": 1}
    scan_cached(content.where("path = 'a'"), parse(RULES), second).collect()
    assert import_cache(spark, export, second) == 1 and import_cache(spark, export, second) == 0
    assert import_cache(spark, export, str(tmp_path / "third")) == 2
    assert secrets(scan_cached(content, parse(RULES), second)) == ["one"]
    spark.read.parquet(f"{export}/seen").limit(1).write.mode("append").partitionBy("key").parquet(f"{export}/seen")
    with pytest.raises(ValueError):
        import_cache(spark, export, second)


def test_streams_of_findings(spark, tmp_path):
    rows = spark.createDataFrame([("x", "r", "2024-01-01 10:05:00"), ("x", "r", "2024-01-01 10:06:00"), ("y", "r", "2024-01-01 11:05:00")], "stable_fingerprint string, rule_id string, at string")
    rows = rows.select("stable_fingerprint", "rule_id", F.to_timestamp("at").alias("arrived"))
    assert sorted(r.findings for r in finding_rates(rows).collect()) == [1, 2]
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    query = new_findings(stream).writeStream.format("memory").queryName("new_findings_of_test").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted(r.stable_fingerprint for r in spark.table("new_findings_of_test").collect()) == ["x", "y"]
