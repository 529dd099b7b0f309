"""The scan: content and a rule set to findings, as one lazy plan.

content(path, text) may carry input_id, commit, author, email, date, message, symlink_file,
provenance_type and start_line (of a fragment); what is missing is filled in. Steps: path allowlists and prefilters, pieces of
large texts, candidate rules by keyword, matches, entropy, allowlists, inline marks, filters, required rules, unreported
rules, generic precedence. Only the last three shuffle, and only findings, never texts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveworks import on_workers
from sieveworks.functions.text import FINGERPRINT_FORMAT, byte_entropy, entropy, evidence_hash, normal_path, or_default, sha256, stable_fingerprint, strict_fingerprint
from sieveworks.operators.candidates import candidates, drop_allowed_paths, path_matches, settled
from sieveworks.operators.correlate import prefer_specific, require_rules
from sieveworks.operators.decode import decoded_passes
from sieveworks.operators.filters import drop_allowed, drop_filtered, drop_inline_allowed, drop_low_entropy
from sieveworks.operators.match import matches, rules_table
from sieveworks.operators.randomness import scored
from sieveworks.plans.dialect import never_in_matches, to_java
from sieveworks.sources.windows import AHEAD_BYTES, OVERLAP_BYTES, byte_fragments, windows

from .ruleset import RuleSet


@dataclass(frozen=True)
class ScanOptions:
    """mode: strict (byte columns, no detectors) or native (code-point columns, detectors, randomness).
    piece_bytes: texts that are larger are scanned in fragments (strict) or windows (native) of this size;
    None scans every text whole. overlap_bytes: how far windows reach beyond their stretch, and fragments for
    a blank line."""

    mode: str = "strict"
    max_target_bytes: int | None = None
    max_decode_depth: int = 0
    ignore_inline_marks: bool = False
    piece_bytes: int | None = None
    overlap_bytes: int | None = None
    fingerprint_format: tuple[str, str] = FINGERPRINT_FORMAT

    @property
    def native(self) -> bool:
        return self.mode == "native"


OPTIONAL = {"commit": "string", "author": "string", "email": "string", "date": "string", "message": "string", "symlink_file": "string", "provenance_type": "string"}
FINDING = [
    "input_id", "rule_id", "description", "path", "symlink_file", "commit", "author", "email", "date", "message", "start_line", "end_line", "start_column", "end_column",
    "match", "secret", "line", "entropy", "tags", "fingerprint", "stable_fingerprint", "secret_sha256", "match_sha256", "decode_path", "required_findings",
    "randomness", "severity", "confidence", "rule_pack", "provider", "validation_state", "provenance_type",
]


def normal_content(content: DataFrame) -> DataFrame:
    """content with all columns that the scan reads. input_id defaults to a digest of path and commit, so
    that it is the same on every run."""
    out = content
    for c, kind in OPTIONAL.items():
        out = out.withColumn(c, F.coalesce(F.col(c).cast(kind), F.lit("")) if c in content.columns else F.lit(""))
    out = out.withColumn("path", F.coalesce(F.col("path").cast("string"), F.lit(""))).withColumn("text", F.coalesce(F.col("text").cast("string"), F.lit("")))
    if "input_id" not in content.columns:
        out = out.withColumn("input_id", F.xxhash64("path", "commit", *(["start_line"] if "start_line" in content.columns else [])))
    # Where a fragment of a larger text begins there.
    first = F.coalesce(F.col("start_line").cast("int"), F.lit(1)) if "start_line" in content.columns else F.lit(1)
    return out.withColumn("source_line", first).select("input_id", "path", "text", *OPTIONAL, "source_line")


def breaks(rules: RuleSet) -> bytes:
    """The ASCII characters that no match of any rule can hold. Detectors may hold all."""
    sets = [frozenset() if r.detector else never_in_matches(r.regex) for r in rules.rules if r.regex or r.detector]
    return bytes(sorted(frozenset.intersection(*sets))) if sets else b""


def pieces(inputs: DataFrame, rules: RuleSet, options: ScanOptions) -> DataFrame:
    """Inputs whose large texts are cut into pieces; a piece's line counts on from its input's."""
    first = inputs.withColumnRenamed("source_line", "first_line")
    if options.native:
        cut = windows(first, options.piece_bytes, OVERLAP_BYTES if options.overlap_bytes is None else options.overlap_bytes, deal=True, breaks=breaks(rules))
    else:
        cut = byte_fragments(first, options.piece_bytes, AHEAD_BYTES if options.overlap_bytes is None else options.overlap_bytes, deal=True)
    return cut.withColumn("source_line", F.col("source_line") + F.col("first_line") - 1).drop("fragment")


def path_findings(content: DataFrame, rules: RuleSet) -> DataFrame:
    """A finding for each input whose path matches a rule that has a path pattern and nothing else, however
    large the input is, and without text too."""
    only = [r for r in rules.rules if r.path and not r.regex and not r.detector]
    hit = F.array_compact(F.array(*[F.when(F.regexp_like("path", F.lit(to_java(r.path))), F.lit(r.id)) for r in only])) if only else F.array().cast("array<string>")
    return content.drop("text").select("*", F.explode(hit).alias("rule_id"))


def scanned_once(found: DataFrame) -> DataFrame:
    """found for steps that read it several times, dealt over tasks by finding_id. Each reading would scan the
    texts again, since Spark only uses a shuffle again for plans that are equal, and its optimizer moves each
    reader's filters and columns below it. A Generate that needs all columns keeps them above."""
    return found.repartition("finding_id").select(F.inline(F.array(F.struct(*found.columns))))


def scan(content: DataFrame, rules: RuleSet, options: ScanOptions = ScanOptions()) -> DataFrame:
    """The findings of a rule set in content, with the columns of FINDING. Rows come in no particular
    order; order by path and position where it matters."""
    on_workers(content.sparkSession)
    paths = inputs = drop_allowed_paths(normal_content(content), rules)
    if options.max_target_bytes is not None:
        inputs = inputs.where(F.octet_length("text") <= options.max_target_bytes)
    if options.piece_bytes is not None:
        inputs = pieces(inputs, rules, options)
    passes = decoded_passes(inputs, options.max_decode_depth, options.native)
    found = matches(candidates(passes, rules), rules, options.native).drop("text")
    if options.piece_bytes is not None and options.native:
        found = found.withColumns({f"{c}_column": F.col(f"{c}_column") + F.when(F.col(f"{c}_line") == 1, F.col("source_column") - 1).otherwise(0) for c in ("start", "end")})
    found = found.withColumns({c: F.col(c) + F.col("source_line") - 1 for c in ("start_line", "end_line")})
    found = settled(found, entropy=byte_entropy(F.col("secret")) if options.native else entropy(F.col("secret")))
    found = drop_low_entropy(found)
    found = drop_allowed(found, rules)
    if not options.ignore_inline_marks:
        found = drop_inline_allowed(found)
        if options.piece_bytes is not None:
            found = found.where(~F.array_contains("allowed_lines", F.col("start_line") - F.col("first_line") + 1))
    found = found.withColumn("tags", F.concat("tags", F.transform("decode_path", lambda d: F.concat(F.lit("decoded:"), d))))
    # Only the choice among decoded passes reads the score of every finding.
    found = scored(found, options.native, once=options.max_decode_depth > 0)
    if options.native:
        found = found.where((F.col("randomness_threshold") == 0) | (F.col("randomness.score") >= F.col("randomness_threshold")))
        found = found.withColumn("randomness_score", F.coalesce("randomness.score", F.lit(0.0))).withColumn("decode_depth", F.size("decode_path")).withColumn("is_decoded", F.size("decode_path") > 0)
        found = drop_filtered(found, rules).drop("randomness_score", "decode_depth", "is_decoded")
    # Decoded passes repeat what the original text already showed: the shortest decode path goes on.
    if options.max_decode_depth:
        key = ["input_id", "rule_at", "start_line", "start_column", "secret"]
        rest = [c for c in found.columns if c not in key]
        best = F.min(F.struct(F.size("decode_path").alias("_d"), *rest)).alias("_f")
        found = found.groupBy(*key).agg(best).select(*key, *[F.col(f"_f.{c}").alias(c) for c in rest])
    found = found.withColumn("finding_id", F.xxhash64("input_id", "rule_at", "start_line", "start_column", "end_line", "end_column", "secret", "decode_path"))
    # Generic findings only yield to those of other rules.
    yields = len({"generic" in r.id for r in rules.rules}) == 2
    if yields or any(r.required for r in rules.rules):
        found = scanned_once(found)
    found = require_rules(found, rules).where(~F.col("skip_report"))
    if yields:
        found = prefer_specific(found)
    out = finished(found, options)
    if any(r.path and not r.regex and not r.detector for r in rules.rules):
        out = out.unionByName(finished(_as_findings(path_findings(paths, rules), rules), options))
    return out


def _as_findings(paths: DataFrame, rules: RuleSet) -> DataFrame:
    meta = rules_table(paths.sparkSession, rules).select("rule_id", "description", "tags", "severity", "confidence", "rule_pack", "provider")
    zero = F.lit(0).cast("int")
    out = paths.join(F.broadcast(meta), "rule_id")
    where = F.concat(F.lit("file detected: "), F.col("path"))
    return out.withColumns(
        {
            "start_line": zero, "end_line": zero, "start_column": zero, "end_column": zero, "match": where, "secret": F.lit(""), "line": F.lit(""), "entropy": F.lit(0.0),
            "decode_path": F.array().cast("array<string>"), "required_findings": F.expr("cast(array() as array<struct<rule_id:string,start_line:int,secret:string>>)"),
            "randomness": F.lit(None).cast("struct<model:string,score:double,classification:string>"),
        }
    )


def finished(found: DataFrame, options: ScanOptions) -> DataFrame:
    secret_hash, match_hash = sha256(F.col("secret")), sha256(F.col("match"))
    location: Column = normal_path(F.coalesce(F.nullif("symlink_file", F.lit("")), F.col("path")))
    evidence = evidence_hash(F.lit(None).cast("string"), F.col("secret"), F.lit(None).cast("string"), F.col("match"))
    out = found.withColumns(
        {
            "fingerprint": strict_fingerprint(F.col("commit"), F.col("path"), F.col("rule_id"), F.col("start_line")),
            "stable_fingerprint": stable_fingerprint(location, F.col("rule_id"), evidence, F.col("decode_path"), options.fingerprint_format),
            "secret_sha256": secret_hash,
            "match_sha256": match_hash,
            "severity": or_default(F.col("severity"), "critical"),
            "confidence": or_default(F.col("confidence"), "high"),
            "validation_state": F.lit("unknown"),
        }
    )
    return out.select(*FINDING)


__all__ = ["FINDING", "ScanOptions", "finished", "normal_content", "path_findings", "path_matches", "scan"]
