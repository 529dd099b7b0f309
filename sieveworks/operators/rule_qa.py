"""Quality checks of rule sets: what is wrong with them by themselves, and against their examples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveworks.plans.ruleset import RuleSet, problems
from sieveworks.plans.scan import ScanOptions, scan


def check_rules(spark: SparkSession, rules: RuleSet) -> DataFrame:
    """A row (rule_id, kind, problem) for each error or warning."""
    return spark.createDataFrame(problems(rules), "rule_id string, kind string, problem string")


def check_examples(spark: SparkSession, rules: RuleSet, options: ScanOptions = ScanOptions()) -> DataFrame:
    """A row (rule_id, example, wanted, found) for each example that its rule should have matched and did
    not, or should not have and did."""
    rows = [(i, r.id, text, wanted) for i, (r, text, wanted) in enumerate((r, t, w) for r in rules.rules for w, ts in ((True, r.examples), (False, r.negative_examples)) for t in ts)]
    given = spark.createDataFrame(rows, "input_id long, rule_id string, example string, wanted boolean")
    found = scan(given.select("input_id", F.lit("example").alias("path"), F.col("example").alias("text")), rules, options)
    hit = found.select("input_id", "rule_id").distinct().withColumn("found", F.lit(True))
    out = given.join(hit, ["input_id", "rule_id"], "left").withColumn("found", F.coalesce("found", F.lit(False)))
    return out.where(F.col("wanted") != F.col("found")).select("rule_id", "example", "wanted", "found")
