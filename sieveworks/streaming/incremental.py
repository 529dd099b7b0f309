"""Incremental scans: a result cache, and streams of new content."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from sieveworks.functions.text import sha256
from sieveworks.plans.ruleset import RuleSet
from sieveworks.plans.scan import ScanOptions, normal_content, scan
from sieveworks.storage import materialize


def cache_key(rules: RuleSet, options: ScanOptions) -> str:
    """Changes with whatever can change the findings of a content."""
    return f"{rules.fingerprint}-{options.mode}-{options.max_decode_depth}-{options.max_target_bytes}-{options.ignore_inline_marks}-{options.piece_bytes}-{options.overlap_bytes}"


#: A finding of one content: whose input it is, is not part of it.
SAME = ["address", "rule_id", "start_line", "end_line", "start_column", "end_column", "match", "secret", "decode_path"]


def scan_cached(content: DataFrame, rules: RuleSet, cache: str, options: ScanOptions = ScanOptions()) -> DataFrame:
    """scan, but contents that the cache has seen under the same rules and options are not scanned again.
    The cache is a folder with two Parquet tables, partitioned by key: seen contents and their findings.
    Addresses are path, commit and content, since rules may look at paths. Distinct misses are scanned under
    numbers of their own, appended, and the findings of all contents joined back to the inputs that have
    them: inputs of equal content have equal findings, and contents under one input_id keep theirs apart."""
    spark = content.sparkSession
    key = cache_key(rules, options)
    inputs = normal_content(content).withColumn("address", sha256(F.concat_ws("\0", "path", "commit", "text")))
    findings_schema = scan(inputs.drop("address", "source_line"), rules, options).schema
    seen_schema = T.StructType([T.StructField("address", T.StringType()), T.StructField("key", T.StringType())])
    stored_schema = T.StructType([T.StructField("address", T.StringType()), *findings_schema, T.StructField("key", T.StringType())])
    for name, schema in (("seen", seen_schema), ("findings", stored_schema)):
        spark.createDataFrame([], schema).write.mode("append").partitionBy("key").parquet(f"{cache}/{name}")
    seen = spark.read.schema(seen_schema).parquet(f"{cache}/seen").where(F.col("key") == key).select("address").distinct()
    misses = inputs.join(seen, "address", "left_anti").dropDuplicates(["address"])
    # Numbers that stay: a retried task must not give an input another one.
    misses = materialize(misses.withColumn("input_id", F.monotonically_increasing_id()))
    found = scan(misses.drop("address"), rules, options)
    addressed = found.join(misses.select("input_id", "address"), "input_id").withColumn("key", F.lit(key))
    # Findings first: a crash in between only means that these contents are scanned once more.
    addressed.select(*[f.name for f in stored_schema]).write.mode("append").partitionBy("key").parquet(f"{cache}/findings")
    misses.select("address", F.lit(key).alias("key")).write.mode("append").partitionBy("key").parquet(f"{cache}/seen")
    stored = spark.read.schema(stored_schema).parquet(f"{cache}/findings").where(F.col("key") == key)
    stored = stored.dropDuplicates(SAME).drop("key", "input_id")
    asked = inputs.select("address", "input_id").distinct()
    return stored.join(asked, "address").select(*findings_schema.names)


def export_cache(spark: SparkSession, cache: str, into: str, keys: list[str] | None = None) -> dict[str, int]:
    """Write the cache, or these keys of it, to a folder of its own, and a manifest of what it holds."""
    held = {}
    for name in ("seen", "findings"):
        rows = spark.read.parquet(f"{cache}/{name}")
        rows = rows.where(F.col("key").isin(keys)) if keys is not None else rows
        rows.write.mode("errorifexists").partitionBy("key").parquet(f"{into}/{name}")
        held[name] = spark.read.schema(rows.schema).parquet(f"{into}/{name}").count()
    spark.createDataFrame([(k, n) for k, n in held.items()], "name string, n long").coalesce(1).write.json(f"{into}/manifest")
    return held


def import_cache(spark: SparkSession, source: str, cache: str) -> int:
    """Add what an exported cache has and this one lacks; the number of contents added. An export that does not
    hold what its manifest says is refused."""
    said = {r.name: r.n for r in spark.read.schema("name string, n long").json(f"{source}/manifest").collect()}
    tables = {name: spark.read.parquet(f"{source}/{name}") for name in ("seen", "findings")}
    if said != {name: t.count() for name, t in tables.items()}:
        raise ValueError("the export is not what its manifest says")
    try:
        have = spark.read.parquet(f"{cache}/seen").select("address", "key").distinct()
    except AnalysisException:
        have = spark.createDataFrame([], "address string, key string")
    new = materialize(tables["seen"].select("address", "key").distinct().join(have, ["address", "key"], "left_anti"))
    tables["findings"].join(new, ["address", "key"], "left_semi").write.mode("append").partitionBy("key").parquet(f"{cache}/findings")
    new.write.mode("append").partitionBy("key").parquet(f"{cache}/seen")
    return new.count()


def cache_stats(spark: SparkSession, cache: str) -> DataFrame:
    """Contents by key."""
    return spark.read.parquet(f"{cache}/seen").groupBy("key").agg(F.countDistinct("address").alias("contents")).orderBy("key")


def prune_cache(spark: SparkSession, cache: str, keep: list[str], into: str) -> None:
    """A copy of the cache with only these keys."""
    for name in ("seen", "findings"):
        spark.read.parquet(f"{cache}/{name}").where(F.col("key").isin(keep)).write.mode("overwrite").partitionBy("key").parquet(f"{into}/{name}")


def scan_stream(content: DataFrame, rules: RuleSet, out: str, checkpoint: str, options: ScanOptions = ScanOptions()) -> StreamingQuery:
    """Scans a stream of content(path, text, ...) and appends findings to a Parquet folder, a sub-folder for
    each micro-batch, so that a batch that runs again after a failure replaces what it had written."""

    def one(batch: DataFrame, number: int) -> None:
        scan(batch, rules, options).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return content.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def new_findings(findings: DataFrame, arrived: str = "arrived", late: str = "1 day") -> DataFrame:
    """A stream of findings without repeats of a stable fingerprint; the state is bounded by a watermark
    on the time of arrival."""
    return findings.withWatermark(arrived, late).dropDuplicatesWithinWatermark(["stable_fingerprint"])


def finding_rates(findings: DataFrame, arrived: str = "arrived", window: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Findings by rule and time window, from a stream or a table."""
    return findings.withWatermark(arrived, late).groupBy(F.window(arrived, window), "rule_id").agg(F.count("*").alias("findings"))
