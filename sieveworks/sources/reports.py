"""Reading findings back from reports: own JSON and JSON Lines, upstream JSON, SARIF, code quality, and
reports of other scanners."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROW = "rule_id string, path string, start_line int, start_column int, fingerprint string, severity string, confidence string, validation_state string, commit string, author string"
UPSTREAM = (
    "RuleID string, Description string, StartLine int, EndLine int, StartColumn int, EndColumn int, Match string, Secret string, File string, SymlinkFile string, Commit string, "
    "Entropy float, Author string, Email string, Date string, Message string, Tags array<string>, Fingerprint string, Link string"
)
_SARIF_LOCATION = "struct<physicalLocation:struct<artifactLocation:struct<uri:string>,region:struct<startLine:int,startColumn:int>>>"
SARIF = f"runs array<struct<results:array<struct<ruleId:string,level:string,partialFingerprints:map<string,string>,fingerprints:map<string,string>,locations:array<{_SARIF_LOCATION}>>>>>"
QUALITY = "array<struct<check_name:string,fingerprint:string,severity:string,location:struct<path:string,lines:struct<begin:int>>>>"


def sniff(text: str) -> str:
    """Which kind of report a text is: html, own, upstream, quality, sarif, trufflehog, or jsonl of one."""
    head = text.lstrip("﻿ \t\r\n")
    if head.startswith("<"):
        return "html"
    try:
        data = json.loads(head)
    except ValueError:
        first = next((x for x in head.splitlines() if x.strip()), "")
        return f"jsonl-{_kind(json.loads(first))}"
    return _kind(data)


def _kind(data: object) -> str:
    if isinstance(data, list):
        first = data[0] if data and isinstance(data[0], dict) else {}
        if "check_name" in first and "location" in first:
            return "quality"
        return "trufflehog" if "DetectorName" in first else "upstream"
    if isinstance(data, dict):
        if "runs" in data and str(data.get("version", "")).startswith("2.1"):
            return "sarif"
        if "RuleID" in data:
            return "upstream"
        if "DetectorName" in data or "results" in data:
            return "trufflehog"
        return "own"
    raise ValueError("no report")


def _text(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(""))


def from_upstream(rows: DataFrame) -> DataFrame:
    """Rows of an upstream report in this library's columns; absent text is empty."""
    names = {
        "rule_id": "RuleID", "description": "Description", "start_line": "StartLine", "end_line": "EndLine", "start_column": "StartColumn", "end_column": "EndColumn",
        "match": "Match", "secret": "Secret", "path": "File", "symlink_file": "SymlinkFile", "commit": "Commit", "author": "Author", "email": "Email", "date": "Date",
        "message": "Message", "fingerprint": "Fingerprint",
    }
    ints = {"start_line", "end_line", "start_column", "end_column"}
    return rows.select(*[(F.coalesce(F.col(v), F.lit(0)) if k in ints else _text(v)).alias(k) for k, v in names.items()], F.coalesce("Entropy", F.lit(0.0)).cast("float").alias("entropy"), F.coalesce("Tags", F.array().cast("array<string>")).alias("tags"))


def read_upstream(spark: SparkSession, path: str) -> DataFrame:
    """An upstream JSON report or baseline, whose keys may come in any case."""
    spark_rows = spark.read.schema(UPSTREAM).option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    return from_upstream(spark_rows)


def read_findings(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Own JSON Lines, or with multi_line a JSON report with its findings in an array. Fields of a wrong
    type read as null and get their defaults; a randomness score outside 0 to 1 is dropped."""
    schema = "ruleId string, file string, startLine int, startColumn int, endLine int, endColumn int, match string, secret string, secretSha256 string, matchSha256 string, fingerprint string, severity string, confidence string, validationState string, commit string, author string, randomness struct<score:double,classification:string>"
    if multi_line:
        fields = ",".join(f"{a}:{b}" for a, b in (x.split(" ", 1) for x in schema.split(", ")))
        rows = spark.read.schema(f"findings array<struct<{fields}>>").option("multiLine", True).json(path).select(F.inline("findings"))
    else:
        rows = spark.read.schema(schema).json(path)
    score = F.when(F.col("randomness.score").between(0, 1), F.col("randomness.score"))
    default = lambda c, v: F.coalesce(F.nullif(_text(c), F.lit("")), F.lit(v))
    return rows.select(
        _text("ruleId").alias("rule_id"), _text("file").alias("path"), F.coalesce("startLine", F.lit(0)).alias("start_line"), F.coalesce("startColumn", F.lit(0)).alias("start_column"),
        F.coalesce("endLine", F.lit(0)).alias("end_line"), F.coalesce("endColumn", F.lit(0)).alias("end_column"), _text("match").alias("match"), _text("secret").alias("secret"),
        _text("secretSha256").alias("secret_sha256"), _text("matchSha256").alias("match_sha256"), _text("fingerprint").alias("fingerprint"), default("severity", "critical").alias("severity"),
        default("confidence", "high").alias("confidence"), default("validationState", "unknown").alias("validation_state"), _text("commit").alias("commit"), _text("author").alias("author"), score.alias("randomness_score"),
    )


def read_sarif(spark: SparkSession, path: str) -> DataFrame:
    r = spark.read.schema(SARIF).option("multiLine", True).json(path).select(F.explode("runs").alias("run")).select(F.explode("run.results").alias("r"))
    place = F.get(F.col("r.locations"), F.lit(0))["physicalLocation"]
    level = F.when(F.col("r.level") == "error", "high").when(F.col("r.level") == "warning", "medium").when(F.col("r.level") == "note", "low").otherwise("critical")
    prints = F.coalesce(F.col("r.fingerprints"), F.col("r.partialFingerprints"))
    return r.select(
        F.col("r.ruleId").alias("rule_id"), place["artifactLocation"]["uri"].alias("path"), place["region"]["startLine"].alias("start_line"), place["region"]["startColumn"].alias("start_column"),
        F.coalesce(F.get(F.map_values(prints), F.lit(0)), F.lit("")).alias("fingerprint"), level.alias("severity"),
    )


def read_quality(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.text(path, wholetext=True).select(F.inline(F.from_json("value", F.lit(QUALITY))))
    return rows.select(F.col("check_name").alias("rule_id"), F.col("location.path").alias("path"), F.col("location.lines.begin").alias("start_line"), "fingerprint", "severity")


#: How deep fields are looked for in the metadata of other scanners' findings.
FIELD_DEPTH = 16


def first_field(node: object, names: set[str], accept: Callable[[object], object]) -> object:
    """The first value, depth first, of a field with one of these names (in lower case) that accept() does not
    turn into None: an object's own fields come before those of its parts."""
    todo = [(node, 0)]
    while todo:
        x, depth = todo.pop()
        if isinstance(x, dict):
            for k, v in x.items():
                if k.lower() in names and (found := accept(v)) is not None:
                    return found
        if depth < FIELD_DEPTH and isinstance(x, dict | list):
            todo += [(v, depth + 1) for v in reversed(list(x.values()) if isinstance(x, dict) else x)]
    return None


def _word(v: object) -> str | None:
    """A scalar as text; None for empty text, nothing and collections."""
    return (json.dumps(v) if isinstance(v, bool | int | float) else v if isinstance(v, str) else None) or None


def _positive(v: object) -> int | None:
    if isinstance(v, str) and v.strip().lstrip("+").isascii() and v.strip().lstrip("+").isdigit():
        v = int(v)
    return v if isinstance(v, int) and not isinstance(v, bool) and 0 < v < 1 << 31 else None


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The fields of other scanners' findings, a JSON object each; text that is no object gives none."""
    names = ["rule_id", "path", "start_line", "start_column", "commit", "fingerprint", "validation_state"]
    for b in batches:
        rows = []
        for text in b.column(0).to_pylist():
            try:
                data = json.loads(text)
            except ValueError:
                continue
            if not isinstance(data, dict):
                continue
            own = {k.lower(): v for k, v in reversed(data.items())}
            meta = own.get("sourcemetadata")
            rule = _word(own.get("detectorname")) or _word(own.get("detectordescription")) or "unknown"
            path = first_field(meta, {"file", "path", "filename"}, _word) or _word(own.get("file")) or ""
            line = first_field(meta, {"line", "line_number", "linenumber", "startline"}, _positive) or _positive(own.get("line")) or 0
            column = first_field(meta, {"column", "col", "startcolumn", "start_column"}, _positive) or _positive(own.get("startcolumn")) or _positive(own.get("column")) or 0
            commit = first_field(meta, {"commit"}, _word) or ""
            print_ = _word(own.get("fingerprint")) or f"{rule}:{path}:{line}"
            rows.append((rule, path, line, column, commit, print_, "active" if own.get("verified") is True else "unknown"))
        types = (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)


def from_trufflehog(rows: DataFrame) -> DataFrame:
    """Findings of another scanner, one JSON object in each row's value. Detector, file, line and column come
    from wherever the metadata has them; the fingerprint is made of them where there is none."""
    return rows.select("value").where("trim(value) <> ''").mapInArrow(_scanned, "rule_id string, path string, start_line int, start_column int, commit string, fingerprint string, validation_state string")


def read_trufflehog(spark: SparkSession, path: str) -> DataFrame:
    """JSON Lines, an array, or an object with an array of results, of another scanner. Lines are read one
    by one; a document is parsed by the JVM into its elements."""
    if not _one_document(spark, path):
        return from_trufflehog(spark.read.text(path))
    whole = spark.read.text(path, wholetext=True).select(F.regexp_replace("value", r"^[\ufeff\s]+", "").alias("value"))
    results = F.coalesce(F.get_json_object("value", "$.results"), F.get_json_object("value", "$.Results"))
    elements = F.when(F.startswith("value", F.lit("[")), F.col("value")).otherwise(F.coalesce(results, F.concat(F.lit("["), "value", F.lit("]"))))
    return from_trufflehog(whole.select(F.explode(F.from_json(elements, "array<string>")).alias("value")))


def _head(spark: SparkSession, path: str, lines: int = 200, chars: int = 1 << 16) -> str:
    """The beginning of a report: its first lines, cut to so many characters each on the way to the driver."""
    rows = spark.read.text(path).select(F.substring("value", 1, chars).alias("value")).limit(lines).collect()
    return "\n".join(r.value for r in rows)[:chars].lstrip("\ufeff \t\r\n")


def _one_document(spark: SparkSession, path: str) -> bool:
    """Whether a report is one JSON document, and not a document on each line."""
    head = _head(spark, path)
    first = head.split("\n", 1)[0].strip()
    if head.startswith("["):
        return True
    try:
        json.loads(first)
    except ValueError:
        return True
    return not head.split("\n", 1)[1:] or not head.split("\n", 1)[1].strip()


def kind_of(spark: SparkSession, path: str) -> str:
    """Which kind of report a file is, by its beginning: html, sarif, quality, trufflehog, upstream, own or
    jsonl (own findings line by line)."""
    head = _head(spark, path)
    if head.startswith("<"):
        return "html"
    if not head.startswith(("{", "[")):
        raise ValueError(f"no report: {path}")
    has = lambda *names: any(re.search(rf'"{n}"\s*:', head) for n in names)
    if has("DetectorName", "detectorName", "DetectorDescription", "detectorDescription") or has("SourceMetadata", "sourceMetadata") and has("Raw", "raw", "RawV2", "Redacted", "redacted"):
        return "trufflehog"
    if has("runs") and (has("version", r"\$schema") or path.lower().endswith(".sarif")):
        return "sarif"
    if head.startswith("["):
        return "quality" if has("check_name") else "upstream"
    return "own" if _one_document(spark, path) and has("findings") else "jsonl" if has("ruleId") else "upstream"


SUMMARY = {"rule_id": "string", "path": "string", "start_line": "int", "start_column": "int", "fingerprint": "string", "severity": "string", "confidence": "string", "validation_state": "string"}


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """The findings of a report of any kind that kind_of() knows, in the columns of SUMMARY; text that a kind
    does not have is empty, numbers are 0."""
    readers = {"html": read_html, "sarif": read_sarif, "quality": read_quality, "trufflehog": read_trufflehog, "upstream": read_upstream, "jsonl": read_findings, "own": lambda s, p: read_findings(s, p, multi_line=True)}
    rows = readers[kind_of(spark, path)](spark, path)
    nothing = {"int": F.lit(0)}
    return rows.select(*[F.coalesce(F.col(c).cast(t) if c in rows.columns else F.lit(None).cast(t), nothing.get(t, F.lit(""))).alias(c) for c, t in SUMMARY.items()])


def read_html(spark: SparkSession, path: str) -> DataFrame:
    """The rows that this library's HTML reports carry as JSON, a line each."""
    fields = "ruleId string, description string, file string, startLine int, endLine int, startColumn int, endColumn int, secret string, match string, commit string, author string, severity string, confidence string, validationState string, fingerprint string"
    body = F.regexp_extract("value", r'^<script type="application/json" class="finding">(.*)</script>$', 1)
    rows = spark.read.text(path).select(body.alias("json")).where("json <> ''").select(F.from_json("json", fields).alias("f")).select("f.*")
    names = {"ruleId": "rule_id", "file": "path", "startLine": "start_line", "endLine": "end_line", "startColumn": "start_column", "endColumn": "end_column", "validationState": "validation_state"}
    return rows.withColumnsRenamed(names)
