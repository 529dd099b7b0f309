"""Reports of every kind, written and read back, with and without links, and told apart."""

import io
import json

import pytest
from pyspark.sql import functions as F

from sieveworks.plans.ruleset import parse
from sieveworks.plans.scan import scan
from sieveworks.sources import reports, writers

RULES = "[[rules]]\nid = 't'\ndescription = 'tok'\nregex = 'tok-(\\S+)'\nkeywords = ['tok-']"
WANT = [("t", "a <b>.txt", 1), ("t", "a <b>.txt", 2), ("t", "b.txt", 1)]


@pytest.fixture(scope="module")
def findings(spark):
    content = spark.createDataFrame([("a <b>.txt", "tok-abc\n tok-</script>&"), ("b.txt", '=tok-"d,ef"')], "path string, text string")
    return scan(content, parse(RULES)).cache()


def rows(df):
    return sorted((r.rule_id, r.path, r.start_line) for r in df.collect())


@pytest.mark.parametrize("linked", [False, True])
@pytest.mark.parametrize("kind", sorted(writers.DOCUMENTS))
def test_every_form_with_and_without_links(findings, kind, linked):
    out, empty = io.StringIO(), io.StringIO()
    some = findings.withColumn("link", F.when(F.col("start_line") == 1, F.lit("https://x.example.org/1"))) if linked else findings
    writers.DOCUMENTS[kind](some, out)
    writers.DOCUMENTS[kind](some.limit(0), empty)
    assert out.getvalue().endswith("\n") and len(out.getvalue()) > len(empty.getvalue())
    if kind == "csv":
        head, *body = out.getvalue().splitlines()
        assert head.endswith(",Link" if linked else ",Tags") and sum(x.endswith("https://x.example.org/1") for x in body) == 2 * linked


def test_kinds_are_told_apart_and_read_alike(spark, findings, tmp_path):
    kinds = {"json": "upstream", "own-json": "own", "sarif": "sarif", "quality": "quality", "html": "html", "jsonl": "jsonl"}
    for form, kind in kinds.items():
        path = str(tmp_path / form)
        writers.write_reports(findings, {form: path})
        assert reports.kind_of(spark, path) == kind, form
        got = reports.read_report(spark, path)
        assert rows(got) == WANT, form
        assert got.columns == list(reports.SUMMARY) and got.where("fingerprint is null or severity is null").count() == 0
    (tmp_path / "none").write_text("hello\n")
    with pytest.raises(ValueError):
        reports.kind_of(spark, str(tmp_path / "none"))


def test_html_carries_all_fields(spark, findings, tmp_path):
    writers.write_reports(findings, {"html": str(tmp_path / "r.html"), "toon": str(tmp_path / "r.toon")})
    got = {(r.path, r.start_line): r for r in reports.read_html(spark, str(tmp_path / "r.html")).collect()}
    assert got["a <b>.txt", 2].secret == "</script>&" and got["b.txt", 1].match == 'tok-"d,ef"' and got["b.txt", 1].confidence == "high"
    assert (tmp_path / "r.toon").read_text().splitlines()[0] == f"findings[3]{{{','.join(writers.HTML.values())}}}:"


FOREIGN = {"DetectorName": "AWS", "Verified": True, "SourceMetadata": {"Data": {"Odd": [{"x": 1}, {"File": "a", "line": "3", "commit": "c"}]}}}


@pytest.mark.parametrize("text", [
    json.dumps(FOREIGN), json.dumps(FOREIGN) + "\n\n" + json.dumps(FOREIGN | {"DetectorName": "B"}) + "\n", json.dumps([FOREIGN, FOREIGN]), json.dumps([FOREIGN], indent=2), json.dumps({"results": [FOREIGN]}, indent=1),
    "﻿" + json.dumps([FOREIGN]), json.dumps(FOREIGN, indent=2), json.dumps({"sourceMetadata": {"Path": "a", "lineNumber": 3, "commit": "c"}, "raw": "x", "detectorDescription": "AWS", "verified": True}),
])
def test_forms_of_another_scanner(spark, tmp_path, text):
    path = tmp_path / "t.json"
    path.write_text(text, encoding="utf-8")
    assert reports.kind_of(spark, str(path)) == "trufflehog"
    got = reports.read_trufflehog(spark, str(path)).collect()
    assert {(r.path, r.start_line, r.commit, r.validation_state) for r in got} == {("a", 3, "c", "active")} and got[0].fingerprint.endswith(":a:3")
    assert len(got) == (2 if text.count("Metadata") == 2 else 1)
    assert rows(reports.read_report(spark, str(path)))[0][1:] == ("a", 3)


def test_fields_are_found_depth_first(spark):
    find = lambda x, *names: reports.first_field(x, set(names), reports._word)
    assert find({"a": {"file": "deep"}, "File": "near"}, "file") == "near"
    assert find({"a": [{"b": {"file": ""}}, {"file": "x"}], "c": {"file": "y"}}, "file") == "x"
    assert find({"file": {"file": 7}}, "file") == "7" and find(None, "file") is None and find({"file": None}, "file") is None
    deep = "leaf"
    for _ in range(40):
        deep = {"n": deep, "file": None}
    assert find({"a": deep}, "n") is None
    rows_ = spark.createDataFrame([("{}",), ("[1]",), ("nonsense",), (None,), ("",), ('{"SourceMetadata": 5, "line": "x"}',)], "value string")
    assert sorted((r.rule_id, r.path, r.start_line) for r in reports.from_trufflehog(rows_).collect()) == [("unknown", "", 0)] * 2


def test_own_sarif_and_junit(spark, findings, tmp_path):
    import xml.etree.ElementTree as ET

    targets = {"own-sarif": str(tmp_path / "s.sarif"), "own-junit": str(tmp_path / "j.xml")}
    writers.write_reports(findings, targets)
    run = json.loads((tmp_path / "s.sarif").read_text())["runs"][0]
    assert run["tool"]["driver"]["rules"][0]["properties"]["findings"] == 3 and [r["ruleIndex"] for r in run["results"]] == [0, 0, 0]
    first = run["results"][0]
    assert first["properties"]["validationState"] == "unknown" and "commit" not in first["properties"] and first["fingerprints"]["stable/v1"].startswith("sieve:v1:")
    assert "tok-abc" not in (tmp_path / "s.sarif").read_text() and rows(reports.read_report(spark, targets["own-sarif"])) == WANT
    suites = ET.parse(tmp_path / "j.xml").getroot()
    assert suites.get("tests") == "3" and [s.get("name") for s in suites] == ["t"] and len(suites[0]) == 3
    assert suites[0][0].find("properties")[0].get("name") == "severity" and suites[0][0].get("name") == "a <b>.txt:1:1"
