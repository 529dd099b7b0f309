"""Redaction of evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveworks.functions.text import FINGERPRINT_FORMAT, evidence_hash, sha256, stable_fingerprint

REDACTED = "REDACTED"


def mask(secret: Column, percent: int, native: bool = False) -> Column:
    """The secret with its last `percent` hidden; from 100 on all of it. Strict mode counts UTF-8 bytes,
    native mode UTF-16 units, and hides at least one; halves round to even."""
    if percent >= 100:
        return F.lit(REDACTED)
    if native:
        units = F.hex(F.encode(secret, "UTF-16BE"))
        n = F.char_length(units) / 4
        keep = F.bround(n * F.lit((100 - percent) / 100.0)).cast("int")
        if percent > 0:
            keep = F.when(keep >= n, n - 1).otherwise(keep)
        keep = F.greatest(keep, F.lit(0)).cast("int")
        # The first half of a pair is hidden with the second.
        half = F.regexp_like(F.substring(units, keep * 4 - 3, F.lit(4)), F.lit("^D[89AB]"))
        keep = F.when((keep > 0) & half, keep - 1).otherwise(keep)
        return F.concat(F.decode(F.unhex(F.substring(units, F.lit(1), keep * 4)), "UTF-16BE"), F.lit("..."))
    n = F.octet_length(secret)
    keep = F.bround(n * F.lit((100 - percent) / 100.0)).cast("int")
    return F.concat(F.decode(F.substring(F.encode(secret, "UTF-8"), F.lit(1), F.greatest(keep, F.lit(0))), "UTF-8"), F.lit("..."))


def interleave(text: Column, put: Column) -> Column:
    """put before, between and after all code points of text."""
    return F.concat(put, F.array_join(F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.concat(c, put)), ""))


def redact(findings: DataFrame, percent: int, native: bool = False, form: tuple[str, str] = FINGERPRINT_FORMAT) -> DataFrame:
    """findings with secret, match and line redacted. Strict mode keeps the hashes of the original evidence;
    native mode hashes what is left, keeps the original's stable fingerprint, and withholds all evidence
    where the secret is empty."""
    if not 0 < percent:
        return findings
    secret, match, line = F.col("secret"), F.col("match"), F.col("line")
    hidden = mask(secret, percent, native)
    new_match = F.replace(match, secret, hidden)
    if native:
        new_match = F.when(new_match == match, hidden).otherwise(new_match)
    new_line = F.replace(line, secret, hidden)
    new_line = F.when((F.size("decode_path") > 0) | (new_line == line), hidden).otherwise(new_line)
    empty = secret == ""
    if native:
        evidence = evidence_hash(F.col("secret_sha256"), secret, F.col("match_sha256"), match)
        fingerprint = stable_fingerprint(F.coalesce(F.nullif("symlink_file", F.lit("")), "path"), F.col("rule_id"), evidence, F.col("decode_path"), form, F.col("stable_fingerprint"))
        out = {c: F.when(empty, REDACTED).otherwise(v) for c, v in (("secret", hidden), ("match", new_match), ("line", new_line))}
        out |= {"secret_sha256": sha256(out["secret"]), "match_sha256": sha256(out["match"]), "stable_fingerprint": fingerprint}
        return findings.withColumns(out)
    stored = lambda c, v: F.coalesce(F.nullif(F.col(c), F.lit("")), sha256(v))
    out = {
        "secret": hidden,
        "match": F.when(empty, interleave(match, hidden)).otherwise(new_match),
        "line": F.when(empty, interleave(line, hidden)).otherwise(new_line),
        "secret_sha256": stored("secret_sha256", secret),
        "match_sha256": stored("match_sha256", match),
    }
    return findings.withColumns(out)
