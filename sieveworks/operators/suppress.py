"""Suppression by anti-joins: ignore lists, content hashes, and baselines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveworks.functions.text import normal_lines, normal_path, sha256


def read_ignores(spark: SparkSession, lines: list[str]) -> DataFrame:
    """An ignore file's entries: comments and blank lines dropped, paths with forward slashes. An entry is
    path:rule:line, or commit:path:rule:line with a commit of 7 or 40 hexadecimal digits."""
    raw = spark.createDataFrame([(x,) for x in lines], "entry string").select(F.trim("entry").alias("entry")).where("entry <> '' and not startswith(entry, '#')")
    return raw.select(normal_path(F.col("entry")).alias("entry")).distinct()


def drop_ignored(findings: DataFrame, ignores: DataFrame) -> DataFrame:
    """findings whose path:rule:line, or with a commit their full or short fingerprint, is no entry."""
    path, rest = normal_path(F.coalesce("path", F.lit(""))), [F.lit(":"), F.col("rule_id"), F.lit(":"), F.col("start_line").cast("string")]
    local = F.concat(path, *rest)
    commit = F.coalesce("commit", F.lit(""))
    # Without a commit a key that no entry has, and not null: nulls would all meet in one task.
    none = F.concat(F.lit("\0"), local)
    full = F.when(commit != "", F.concat(commit, F.lit(":"), local)).otherwise(none)
    short = F.when(commit != "", F.concat(F.substring(commit, 1, 7), F.lit(":"), local)).otherwise(none)
    keyed = findings.withColumns({"_k0": local, "_k1": full, "_k2": short})
    for k in ("_k0", "_k1", "_k2"):
        keyed = keyed.join(ignores.select(F.col("entry").alias(k)), k, "left_anti")
    return keyed.select(*findings.columns)


def drop_fingerprints(findings: DataFrame, ignores: DataFrame) -> DataFrame:
    """findings whose stable fingerprint is no entry, whatever its case."""
    keyed = findings.withColumn("_k", F.lower("stable_fingerprint"))
    return keyed.join(ignores.select(F.lower("entry").alias("_k")).distinct(), "_k", "left_anti").select(*findings.columns)


def drop_contents(content: DataFrame, hashes: DataFrame) -> DataFrame:
    """content whose SHA-256 is not listed in hashes(sha256)."""
    keyed = content.withColumn("_k", sha256(F.col("text").cast("binary")))
    return keyed.join(hashes.select(F.lower("sha256").alias("_k")).distinct(), "_k", "left_anti").select(*content.columns)


def stale_hashes(content: DataFrame, hashes: DataFrame) -> DataFrame:
    """The listed hashes that no content has."""
    have = content.select(sha256(F.col("text").cast("binary")).alias("sha256")).distinct()
    return hashes.select(F.lower("sha256").alias("sha256")).distinct().join(have, "sha256", "left_anti").orderBy("sha256")


BASELINE_KEYS = ["rule_id", "description", "start_line", "end_line", "start_column", "end_column", "path", "commit", "author", "email", "date", "message"]


def drop_baselined(findings: DataFrame, baseline: DataFrame, redacting: bool = False, portable: bool = False) -> DataFrame:
    """findings that the baseline does not have. Equal are rule, description, positions, path, commit,
    author, email, date, message, evidence (match and secret, or where both are withheld their hashes) and
    the entropy as a 32-bit float; missing text counts as empty. With redacting, evidence is not compared.
    With portable, evidence may differ in line endings, and then entropy may differ, too."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    b = baseline.select(*[text(c).alias(f"_{c}") for c in BASELINE_KEYS], text("match").alias("_match"), text("secret").alias("_secret"), F.col("entropy").cast("float").alias("_entropy"))
    f = findings
    same: Column = text(BASELINE_KEYS[0]) == F.col(f"_{BASELINE_KEYS[0]}")
    for c in BASELINE_KEYS[1:]:
        same = same & (text(c) == F.col(f"_{c}"))
    match, secret = text("match"), text("secret")
    evidence = (match == F.col("_match")) & (secret == F.col("_secret"))
    if {"match_sha256", "secret_sha256"} <= set(f.columns):
        hashed = (text("match_sha256") == sha256(F.col("_match"))) & (text("secret_sha256") == sha256(F.col("_secret")))
        evidence = evidence | ((match == "") & (secret == "") & hashed)
    entropy = F.col("entropy").cast("float") == F.col("_entropy")
    endings = (normal_lines(match) == normal_lines(F.col("_match"))) & (normal_lines(secret) == normal_lines(F.col("_secret"))) if portable else F.lit(False)
    condition = same & ((F.lit(redacting) | evidence) & entropy | endings)
    return f.join(b, condition, "left_anti")
