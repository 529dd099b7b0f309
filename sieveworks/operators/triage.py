"""Triage: counts, tops, searches and views over findings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from sieveworks.storage import materialize

TOP, VIEW = 8, 10
SEARCHED = ("rule_id", "path", "fingerprint", "severity", "confidence", "validation_state")


def summary(findings: DataFrame) -> DataFrame:
    """One row: the number of findings, of files, of rules and of commits."""
    commit = F.nullif("commit", F.lit(""))
    return findings.agg(F.count("*").alias("findings"), F.countDistinct("path").alias("files"), F.countDistinct("rule_id").alias("rules"), F.countDistinct(commit).alias("commits"))


def top(findings: DataFrame, by: str, n: int = TOP) -> DataFrame:
    """The n values of a column with the most findings; ties by value."""
    return findings.groupBy(by).agg(F.count("*").alias("findings")).orderBy(F.desc("findings"), by).limit(n)


def search(findings: DataFrame, text: str = "", rule_id: str | None = None, path: str | None = None) -> DataFrame:
    """findings with the text, whatever its case, in one of SEARCHED; of one rule or path if given."""
    out = findings
    if text:
        low = F.lit(text.lower())
        hit = F.lit(False)
        for c in SEARCHED:
            hit = hit | F.coalesce(F.contains(F.lower(F.col(c)), low), F.lit(False))
        out = out.where(hit)
    if rule_id is not None:
        out = out.where(F.col("rule_id") == rule_id)
    if path is not None:
        out = out.where(F.col("path") == path)
    return out


def view(findings: DataFrame, n: int = VIEW) -> tuple[DataFrame, int]:
    """The first n findings by path and position, and how many more there are."""
    order = ["path", "start_line", "start_column", "rule_id"]
    return findings.orderBy(*order).limit(n), max(0, findings.count() - n)


def severity_rollup(findings: DataFrame) -> DataFrame:
    """Counts by severity and rule, with subtotals (null rule_id) and the total (both null)."""
    return findings.rollup("severity", "rule_id").agg(F.count("*").alias("findings"))


def secret_types(alerts: DataFrame) -> DataFrame:
    """Alerts by type of secret."""
    return alerts.groupBy("secret_type").agg(F.count("*").alias("alerts")).orderBy("secret_type")


def parity(findings: DataFrame, alerts: DataFrame, on: list[str]) -> DataFrame:
    """A row (status, n) for each of both, findings and alerts: how many distinct keys (the columns `on`) both
    have, and how many only the one or the other. Null parts of a key equal each other."""
    sides = [df.select(*on).distinct().withColumn("_side", F.lit(i)) for i, df in enumerate((findings, alerts), 1)]
    keys = sides[0].unionByName(sides[1]).groupBy(*on).agg(F.sum("_side").alias("_side"))
    status = F.when(F.col("_side") == 3, "both").when(F.col("_side") == 1, "findings").otherwise("alerts")
    return keys.groupBy(status.alias("status")).agg(F.count("*").alias("n"))


def measured(content: DataFrame, name: str = "content") -> tuple[DataFrame, Observation]:
    """content with an observation of how many inputs and bytes an action over it reads, without a pass of
    its own: a scan of what is returned fills it in."""
    seen = Observation(name)
    text = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    return content.observe(seen, F.count("*").alias("inputs"), F.sum(text).alias("bytes"), F.max(text).alias("largest")), seen


def log_levels(lines: DataFrame) -> DataFrame:
    """Log lines by level, whatever its case."""
    return lines.groupBy(F.lower("level").alias("level")).agg(F.count("*").alias("lines")).orderBy("level")


def nearest_rank(values: DataFrame, column: str, percents: list[float]) -> DataFrame:
    """A row (percent, value) for each percentile by the nearest-rank method: the least value that at
    least that share of the values does not exceed; null without values. Nulls are no values.

    Equal values are counted first, then dealt into ranges. The driver gets one sum for each range, finds
    the ranges that hold the ranks, and only those are counted through, each by a task of its own."""
    spark = values.sparkSession
    counted = values.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    ranges = materialize(counted.orderBy("value")).withColumn("range", F.spark_partition_id())
    sums = {r["range"]: r["n"] for r in ranges.groupBy("range").agg(F.sum("n").alias("n")).collect()}
    total, before, wanted = sum(sums.values()), 0, []
    ranks = {p: max(1, -(-total * int(round(p * 10**6)) // 10**8)) for p in percents}
    for at in sorted(sums):
        wanted += [(float(p), at, rank - before) for p, rank in ranks.items() if before < rank <= before + sums[at]]
        before += sums[at]
    asked = F.broadcast(spark.createDataFrame(wanted, "percent double, range int, rank long"))
    upto = F.sum("n").over(Window.partitionBy("range").orderBy("value"))
    held = ranges.where(F.col("range").isin([w[1] for w in wanted])).withColumn("upto", upto)
    found = held.join(asked, "range").where((F.col("upto") >= F.col("rank")) & (F.col("upto") - F.col("n") < F.col("rank")))
    every = spark.createDataFrame([(float(p),) for p in percents], "percent double")
    return every.join(found.select("percent", "value"), "percent", "left")
