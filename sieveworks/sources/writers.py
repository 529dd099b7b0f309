"""Reports of findings. Spark writes JSON Lines, CSV and Parquet where findings may be many; the formats
that are one document are written row by row from a sorted iterator, never from a list of all."""

from __future__ import annotations

import csv
import json
from collections.abc import Callable, Iterator
from typing import TextIO
from xml.sax.saxutils import escape, quoteattr

import numpy as np
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from sieveworks.functions.text import csv_guard, security_severity

ORDER = ["path", "start_line", "start_column", "rule_id"]
#: Field names and order of upstream reports.
UPSTREAM = {
    "RuleID": "rule_id", "Description": "description", "StartLine": "start_line", "EndLine": "end_line", "StartColumn": "start_column", "EndColumn": "end_column", "Match": "match", "Secret": "secret",
    "File": "path", "SymlinkFile": "symlink_file", "Commit": "commit", "Entropy": "entropy", "Author": "author", "Email": "email", "Date": "date", "Message": "message", "Tags": "tags", "Fingerprint": "fingerprint",
}
OWN = {
    "ruleId": "rule_id", "description": "description", "file": "path", "symlinkFile": "symlink_file", "startLine": "start_line", "endLine": "end_line", "startColumn": "start_column", "endColumn": "end_column",
    "match": "match", "secret": "secret", "secretSha256": "secret_sha256", "matchSha256": "match_sha256", "line": "line", "commit": "commit", "entropy": "entropy", "author": "author", "email": "email", "date": "date",
    "message": "message", "tags": "tags", "fingerprint": "stable_fingerprint", "validationState": "validation_state", "severity": "severity", "confidence": "confidence", "rulePack": "rule_pack", "provider": "provider", "decodePath": "decode_path",
}
SUFFIXES = {".json": "json", ".jsonl": "jsonl", ".csv": "csv", ".xml": "junit", ".sarif": "sarif", ".html": "html", ".htm": "html", ".toon": "toon"}


def sorted_rows(findings: DataFrame) -> Iterator[Row]:
    return findings.orderBy(*[c for c in ORDER if c in findings.columns]).toLocalIterator()


def _escaped(text: str) -> str:
    for c in "<>&  ":
        text = text.replace(c, f"\\u{ord(c):04x}")
    return text


def _float32(x: float) -> float:
    return float(str(np.float32(x)))


def write_upstream_json(findings: DataFrame, out: TextIO) -> None:
    """A JSON array with one space of indent for each level; <, >, & and line separators escaped."""
    first = True
    for r in sorted_rows(findings):
        item = {k: getattr(r, v) for k, v in UPSTREAM.items()}
        item["Entropy"] = _float32(item["Entropy"])
        if item["Entropy"] == int(item["Entropy"]):
            item["Entropy"] = int(item["Entropy"])
        body = json.dumps(item, ensure_ascii=False, indent=1).replace("\n", "\n ")
        out.write(("[\n " if first else ",\n ") + _escaped(body))
        first = False
    out.write("[]\n" if first else "\n]\n")


def write_own_json(findings: DataFrame, out: TextIO) -> None:
    """One document: {"schema": ..., "findings": [...]}, the findings in the order of reports."""
    cols = [c for c in ORDER if c in findings.columns]
    names = own_rows(findings).columns
    rows = findings.orderBy(*cols).select(*[F.col(OWN[n]).alias(n) for n in names if n in OWN]).select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json"))
    out.write('{"schema": "sieve.report.v1", "findings": [')
    for i, r in enumerate(rows.toLocalIterator()):
        out.write((",\n" if i else "\n") + r.json)
    out.write("\n]}\n")


def write_upstream_csv(findings: DataFrame, out: TextIO) -> None:
    """Nothing at all without findings. The column Link comes last, if findings have a link."""
    linked = "link" in findings.columns and not findings.where("link <> ''").isEmpty()
    columns = ["RuleID", "Commit", "File", "SymlinkFile", "Secret", "Match", "StartLine", "EndLine", "StartColumn", "EndColumn", "Author", "Message", "Date", "Email", "Fingerprint", "Tags"]
    writer = csv.writer(out, lineterminator="\n")
    for i, r in enumerate(sorted_rows(findings)):
        if not i:
            writer.writerow(columns + ["Link"] * linked)
        writer.writerow([" ".join(v) if isinstance(v := getattr(r, UPSTREAM[c]), list) else v for c in columns] + ([r.link or ""] if linked else []))


def write_junit(findings: DataFrame, out: TextIO, name: str = "scan") -> None:
    n = findings.count()
    out.write(f'<?xml version="1.0" encoding="UTF-8"?>\n<testsuites>\n\t<testsuite failures="{n}" name={quoteattr(name)} tests="{n}" time="">\n\t\t<properties></properties>\n')
    for r in sorted_rows(findings):
        title = f"{r.rule_id} has detected a secret in file {r.path}, line {r.start_line}" + (f", at commit {r.commit}" if r.commit else "")
        body = escape(json.dumps({k: getattr(r, v) for k, v in UPSTREAM.items()}, ensure_ascii=False, default=str))
        out.write(f"\t\t<testcase classname={quoteattr(r.description)} file={quoteattr(r.path)} name={quoteattr(title)} time=\"\">\n\t\t\t<failure message={quoteattr(title)} type={quoteattr(r.description)}>{body}</failure>\n\t\t</testcase>\n")
    out.write("\t</testsuite>\n</testsuites>\n")


def write_sarif(findings: DataFrame, out: TextIO, tool: str = "sieveworks") -> None:
    """SARIF 2.1.0 with the rules that have findings."""
    levels = {"critical": "error", "high": "error", "medium": "warning", "low": "note", "info": "note"}
    rules = findings.select("rule_id", "description", security_severity(F.col("severity")).alias("score")).distinct().orderBy("rule_id").toLocalIterator()
    driver = {"name": tool, "rules": [{"id": r.rule_id, "shortDescription": {"text": r.description}, "properties": {"security-severity": r.score}} for r in rules]}
    out.write('{"$schema": "https://json.schemastore.org/sarif-2.1.0.json", "version": "2.1.0", "runs": [{"tool": {"driver": ' + json.dumps(driver) + '}, "results": [')
    for i, r in enumerate(sorted_rows(findings)):
        region = {"startLine": r.start_line, "startColumn": r.start_column, "endLine": r.end_line, "endColumn": r.end_column, "snippet": {"text": r.secret}}
        result = {
            "ruleId": r.rule_id, "level": levels.get(r.severity, "error"), "message": {"text": f"{r.rule_id} has detected a secret in file {r.path}."},
            "locations": [{"physicalLocation": {"artifactLocation": {"uri": r.path}, "region": region}}], "partialFingerprints": {"stable": r.stable_fingerprint, "commitSha": r.commit},
        }
        out.write(("" if not i else ", ") + json.dumps(result, ensure_ascii=False))
    out.write("]}]}\n")


#: What the library's own SARIF and JUnit reports say of a finding besides its rule and place.
TOLD = {
    "severity": "severity", "confidence": "confidence", "validationState": "validation_state", "provider": "provider", "rulePack": "rule_pack", "provenanceType": "provenance_type", "commit": "commit",
    "author": "author", "date": "date", "entropy": "entropy", "secretSha256": "secret_sha256", "decodePath": "decode_path", "tags": "tags",
}


def _told(r: Row) -> dict:
    """What there is to say of a finding, without what is empty."""
    return {k: v for k, c in TOLD.items() if (v := getattr(r, c)) not in (None, "", [])}


def write_own_sarif(findings: DataFrame, out: TextIO, tool: str = "sieveworks") -> None:
    """SARIF 2.1.0 in native terms: each rule with severity, tags and number of findings, each result with its
    rule's index, stable fingerprint, evidence hash in place of the secret, validation and origin. Rules are
    as many as a rule set has; results go out one by one."""
    levels = {"critical": "error", "high": "error", "medium": "warning", "low": "note", "info": "note"}
    kinds = findings.groupBy("rule_id").agg(F.min("description").alias("description"), F.min("severity").alias("severity"), F.min(security_severity(F.col("severity"))).alias("score"), F.min("provider").alias("provider"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("tags")))).alias("tags"), F.count("*").alias("n"))
    rules, at = [], {}
    for i, r in enumerate(kinds.orderBy("rule_id").toLocalIterator()):
        at[r.rule_id] = i
        about = {"security-severity": r.score, "tags": r.tags, "findings": r.n} | ({"provider": r.provider} if r.provider else {})
        rules.append({"id": r.rule_id, "name": r.rule_id, "shortDescription": {"text": r.description or r.rule_id}, "defaultConfiguration": {"level": levels.get(r.severity, "error")}, "properties": about})
    out.write('{"$schema": "https://json.schemastore.org/sarif-2.1.0.json", "version": "2.1.0", "runs": [{"columnKind": "unicodeCodePoints", "tool": {"driver": ' + json.dumps({"name": tool, "rules": rules}, ensure_ascii=False) + '}, "results": [')
    for i, r in enumerate(sorted_rows(findings)):
        region = {"startLine": r.start_line, "startColumn": r.start_column, "endLine": r.end_line, "endColumn": r.end_column}
        # Paths without a line, as those of file rules, have no region.
        place = {"artifactLocation": {"uri": r.path}} | ({"region": region} if r.start_line else {})
        result = {
            "ruleId": r.rule_id, "ruleIndex": at[r.rule_id], "level": levels.get(r.severity, "error"), "message": {"text": f"{r.description or r.rule_id} in {r.path}"},
            "locations": [{"physicalLocation": place}], "fingerprints": {"stable/v1": r.stable_fingerprint}, "partialFingerprints": {"place": r.fingerprint}, "properties": _told(r),
        }
        out.write((",\n" if i else "\n") + json.dumps(result, ensure_ascii=False))
    out.write("\n]}]}\n")


def write_own_junit(findings: DataFrame, out: TextIO, name: str = "sieveworks") -> None:
    """A suite for each rule, with its number of findings, and a failed case for each finding whose properties
    are what there is to say of it."""
    counts = {r.rule_id: r.n for r in findings.groupBy("rule_id").agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    out.write(f'<?xml version="1.0" encoding="UTF-8"?>\n<testsuites name={quoteattr(name)} tests="{total}" failures="{total}">\n')
    open_rule = None
    for r in findings.orderBy("rule_id", *[c for c in ORDER if c in findings.columns and c != "rule_id"]).toLocalIterator():
        if r.rule_id != open_rule:
            out.write(("  </testsuite>\n" if open_rule is not None else "") + f'  <testsuite name={quoteattr(r.rule_id)} tests="{counts[r.rule_id]}" failures="{counts[r.rule_id]}">\n')
            open_rule = r.rule_id
        told = "".join(f"<property name={quoteattr(k)} value={quoteattr(' '.join(map(str, v)) if isinstance(v, list) else str(v))}/>" for k, v in _told(r).items())
        where = f"{r.path}:{r.start_line}:{r.start_column}"
        out.write(f"    <testcase classname={quoteattr(r.rule_id)} name={quoteattr(where)} file={quoteattr(r.path)} line=\"{r.start_line}\"><properties>{told}</properties><failure type={quoteattr(r.severity)} message={quoteattr(r.description or r.rule_id)}>{escape(r.stable_fingerprint)}</failure></testcase>\n")
    out.write(("  </testsuite>\n" if open_rule is not None else "") + "</testsuites>\n")


def write_quality(findings: DataFrame, out: TextIO) -> None:
    """A code-quality report: one array of issues."""
    kinds = {"critical": "blocker", "high": "critical", "medium": "major", "low": "minor", "info": "info"}
    out.write("[")
    for i, r in enumerate(sorted_rows(findings)):
        item = {"description": r.description, "check_name": r.rule_id, "fingerprint": r.stable_fingerprint, "severity": kinds.get(r.severity, "blocker"), "location": {"path": r.path, "lines": {"begin": r.start_line}}}
        out.write(("" if not i else ", ") + json.dumps(item, ensure_ascii=False))
    out.write("]\n")


#: What HTML reports show of a finding, and the names under which read_html finds it.
HTML = {
    "ruleId": "rule_id", "description": "description", "file": "path", "startLine": "start_line", "endLine": "end_line", "startColumn": "start_column", "endColumn": "end_column", "secret": "secret", "match": "match",
    "commit": "commit", "author": "author", "date": "date", "entropy": "entropy", "severity": "severity", "confidence": "confidence", "validationState": "validation_state", "provider": "provider", "fingerprint": "stable_fingerprint",
}


def write_html(findings: DataFrame, out: TextIO, title: str = "Findings") -> None:
    """A page with a table of all fields in HTML, whose rows carry them as JSON for read_html. Rows go out one
    by one; the driver holds none but the current."""
    out.write(f'<!DOCTYPE html><html><head><meta charset="utf-8"><title>{escape(title)}</title></head><body><h1>{escape(title)}</h1>\n')
    levels = findings.groupBy("severity").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "severity").toLocalIterator()
    out.write("<ul>" + "".join(f"<li>{escape(r.severity or '')}: {r.n}</li>" for r in levels) + "</ul>\n<table><tr>" + "".join(f"<th>{k}</th>" for k in HTML) + "</tr>\n")
    for r in sorted_rows(findings):
        row = {k: getattr(r, v) for k, v in HTML.items()}
        data = json.dumps(row, ensure_ascii=False).replace("<", "\\u003c")
        cells = "".join(f"<td>{escape('' if v is None else str(v))}</td>" for v in row.values())
        out.write(f"<tr>{cells}</tr>\n<script type=\"application/json\" class=\"finding\">{data}</script>\n")
    out.write("</table></body></html>\n")


def write_toon(findings: DataFrame, out: TextIO) -> None:
    """Token-oriented rows: a header with the number of rows and the fields, then a line for each."""
    fields = list(HTML.values())
    out.write(f"findings[{findings.count()}]{{{','.join(fields)}}}:\n")
    for r in sorted_rows(findings):
        cells = ["" if (v := getattr(r, f)) is None else str(v) for f in fields]
        out.write("  " + ",".join(json.dumps(c) if any(x in c for x in ',"\n:') else c for c in cells) + "\n")


DOCUMENTS: dict[str, Callable] = {
    "json": write_upstream_json, "own-json": write_own_json, "csv": write_upstream_csv, "junit": write_junit, "sarif": write_sarif, "own-sarif": write_own_sarif, "own-junit": write_own_junit, "quality": write_quality, "html": write_html, "toon": write_toon,
}


def own_rows(findings: DataFrame) -> DataFrame:
    """findings under the names of this library's reports."""
    return findings.select(F.lit("sieve.finding.v1").alias("schema"), *[F.col(v).alias(k) for k, v in OWN.items()])


def write_jsonl(findings: DataFrame, path: str) -> None:
    """A folder of JSON Lines files, written by the tasks that hold the rows."""
    own_rows(findings).write.mode("overwrite").json(path)


def write_csv(findings: DataFrame, path: str) -> None:
    """A folder of CSV files; cells that look like formulas are made text."""
    rows = own_rows(findings)
    cells = [F.array_join(F.col(c), " ").alias(c) if kind.startswith("array") else csv_guard(F.col(c)).alias(c) if kind == "string" else F.col(c) for c, kind in rows.dtypes]
    rows.select(*cells).write.mode("overwrite").option("header", True).csv(path)


def write_parquet(findings: DataFrame, path: str) -> None:
    findings.write.mode("overwrite").parquet(path)


def write_baseline(findings: DataFrame, out: TextIO) -> None:
    write_upstream_json(findings, out)


def format_of(path: str) -> str | None:
    low = path.lower()
    return next((f for s, f in sorted(SUFFIXES.items(), key=lambda kv: -len(kv[0])) if low.endswith(s)), None)


def write_reports(findings: DataFrame, targets: dict[str, str], template: str | None = None) -> None:
    """Several reports of one scan, {format: path}: the findings are computed once. The format template
    takes the text of one."""
    from .templates import write_template

    if "template" in targets and template is None:
        raise ValueError("a report by a template needs the template")
    kept = findings.persist()
    try:
        for kind, path in targets.items():
            if kind in ("jsonl", "parquet"):
                {"jsonl": write_jsonl, "parquet": write_parquet}[kind](kept, path)
            else:
                with open(path, "w", encoding="utf-8") as out:
                    write_template(kept, out, template) if kind == "template" else DOCUMENTS[kind](kept, out)
    finally:
        kept.unpersist()
