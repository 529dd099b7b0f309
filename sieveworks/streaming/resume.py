"""Scans in parts that go on where a killed one stopped.

Inputs are listed, not read, and dealt into parts by their path. A part's findings are written to a folder of
its own; then the part is entered in a journal that is only ever appended to. A scan that starts again leaves
out what the journal has, and findings count only once their part is entered: there are no repeats and no
gaps, wherever it was stopped. Runs are told apart by a manifest: the digest of the rules, the options and the list of inputs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveworks.plans.ruleset import RuleSet
from sieveworks.plans.scan import ScanOptions, scan
from sieveworks.streaming.incremental import cache_key

JOURNAL = "run string, part int, inputs long, findings long"


def manifest(inputs: DataFrame, rules: RuleSet, options: ScanOptions, parts: int) -> str:
    """The identity of a run. Inputs count by all their columns (for files: path, place, length), in
    whatever order; only sums leave the tasks."""
    row = F.xxhash64(*[F.col(c).cast("string") for c in sorted(inputs.columns)])
    seen = inputs.agg(F.count("*").alias("n"), F.bit_xor(row).alias("x"), F.sum(F.pmod(row, F.lit(1 << 31))).alias("s")).first()
    return f"{cache_key(rules, options)}-{parts}-{seen.n}-{(seen.x or 0) & (1 << 64) - 1:016x}-{seen.s or 0:x}"


def journal(spark: SparkSession, out: str, run: str) -> DataFrame:
    """The parts of a run that are finished, each once."""
    spark.createDataFrame([], JOURNAL).write.mode("append").parquet(f"{out}/journal")
    return spark.read.schema(JOURNAL).parquet(f"{out}/journal").where(F.col("run") == run).dropDuplicates(["part"])


def scan_resumable(
    inputs: DataFrame, load: Callable[[DataFrame], DataFrame], rules: RuleSet, out: str, options: ScanOptions = ScanOptions(), parts: int = 64, stop_after: int | None = None
) -> DataFrame:
    """The findings in load(inputs), the content of listed inputs(path, ...), scanned part by part.

    out: a folder on shared storage for the journal and the findings. What an earlier call with the same rules,
    options and inputs has finished there is not scanned again; other runs in the folder are left alone. Parts
    are chosen by the path's hash, so that a part lists and reads its own inputs only. stop_after: return after
    so many parts, with what is finished. A changed list of inputs is a new run."""
    spark = inputs.sparkSession
    run = manifest(inputs, rules, options, parts)
    dealt = inputs.withColumn("_part", F.pmod(F.xxhash64("path"), F.lit(parts)).cast("int"))
    counts = dealt.groupBy("_part").agg(F.count("*").alias("n"))
    # One row for each part, of which there are `parts` at most.
    waiting = counts.join(journal(spark, out, run).select(F.col("part").alias("_part")), "_part", "left_anti").orderBy("_part").collect()
    for r in waiting[:stop_after]:
        found = scan(load(dealt.where(F.col("_part") == r["_part"]).drop("_part")), rules, options)
        where = f"{out}/findings/run={run}/part={r['_part']}"
        found.write.mode("overwrite").parquet(where)
        entry = spark.read.schema(found.schema).parquet(where).agg(F.count("*").alias("findings"))
        entry = entry.select(F.lit(run).alias("run"), F.lit(r["_part"]).alias("part"), F.lit(r.n).cast("long").alias("inputs"), "findings")
        entry.write.mode("append").parquet(f"{out}/journal")
    return finished_findings(spark, out, run, rules, options)


def finished_findings(spark: SparkSession, out: str, run: str, rules: RuleSet, options: ScanOptions = ScanOptions()) -> DataFrame:
    """The findings of the parts that the journal has; those of a part that was stopped are not there."""
    empty = spark.createDataFrame([], "path string, text string")
    schema = scan(empty, rules, options).schema
    done = sorted(r.part for r in journal(spark, out, run).select("part").collect())
    places = [f"{out}/findings/run={run}/part={p}" for p in done]
    return spark.read.schema(schema).parquet(*places) if places else spark.createDataFrame([], schema)
