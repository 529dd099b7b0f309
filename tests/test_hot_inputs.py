"""Operators on one input, or one line, that holds all findings: seconds, not hours."""

import time

from pyspark.sql import functions as F

from sieveworks.operators import correlate
from sieveworks.plans.ruleset import Required, Rule, RuleSet

ROWS = 200_000


def test_required_rules_on_one_input(spark):
    rules = RuleSet((Rule("main", regex="x", required=(Required("near"),)), Rule("near", regex="x")))
    rows = spark.range(ROWS).select(
        F.col("id").alias("finding_id"), F.lit(1).cast("long").alias("input_id"), (F.col("id") % 2).cast("int").alias("rule_at"), F.when(F.col("id") % 2 == 0, "main").otherwise("near").alias("rule_id"),
        F.col("id").cast("int").alias("start_line"), F.lit(1).alias("start_column"), F.col("id").cast("string").alias("secret"),
    )
    start = time.monotonic()
    got = correlate.require_rules(rows, rules).where("rule_id = 'main'").select("finding_id", F.get("required_findings", F.lit(0))["start_line"].alias("at")).collect()
    assert time.monotonic() - start < 60
    # The nearest; of two at one distance the first.
    assert len(got) == ROWS // 2 and all(r.at == max(1, r.finding_id - 1) for r in got)


def test_precedence_on_one_line(spark):
    secret = F.sha2(F.floor(F.col("id") / 4).cast("string"), 256)
    rows = spark.range(ROWS).select(
        F.col("id").alias("finding_id"), F.lit(1).cast("long").alias("input_id"), F.lit(None).cast("string").alias("commit"), F.lit(7).alias("start_line"),
        F.when(F.col("id") % 4 < 2, "generic-key").otherwise("some-token").alias("rule_id"),
        F.when(F.col("id") % 4 == 0, F.substring(secret, 9, 30)).when(F.col("id") % 4 == 1, F.concat(F.lit("no"), F.substring(secret, 9, 30))).otherwise(secret).alias("secret"),
    )
    start = time.monotonic()
    got = [r.finding_id % 4 for r in correlate.prefer_specific(rows).select("finding_id").collect()]
    assert time.monotonic() - start < 120
    assert len(got) == ROWS // 4 * 3 and 0 not in got


def test_precedence_of_short_equal_and_missing_secrets(spark):
    specific = ["abcdef", "x", "", None, "long-secret-with-many-letters"]
    generic = ["abc", "abcdef", "abcdefg", "x", "", None, "secret-with-many", "letters", "y", "many-letters-"]
    rows = [(i, 1, None, 1, "specific", s) for i, s in enumerate(specific)] + [(10 + i, 1, "", 1, "generic", s) for i, s in enumerate(generic)]
    rows += [(30, 2, None, 1, "generic", "abc"), (31, 1, "c", 1, "generic", "abc"), (32, 1, None, 2, "generic", "abc"), (33, 1, "c", 1, "generic", "zz"), (34, 1, "c", 1, "other", "zz")]
    df = spark.createDataFrame(rows, "finding_id int, input_id int, commit string, start_line int, rule_id string, secret string")
    kept = {r.finding_id for r in correlate.prefer_specific(df).collect()}
    brute = {
        i for i, inp, c, line, rule, s in rows
        if "generic" not in rule or s is None or not any("generic" not in r and t is not None and (inp, c or "", line) == (n, d or "", k) and s in t for _, n, d, k, r, t in rows)
    }
    assert kept == brute
