"""Multi-match extraction: every match of every candidate rule, with its secret and its position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveworks.plans.ruleset import RuleSet

from .candidates import settled
from .decode import original_offset
from .detectors import detector_spans

RULES_SCHEMA = "rule_at int, rule_id string, description string, java string, secret_group int, n_groups int, min_entropy double, tags array<string>, severity string, confidence string, rule_pack string, provider string, skip_report boolean, detector string, randomness_threshold double"


def rules_table(spark: SparkSession, rules: RuleSet) -> DataFrame:
    """The rules as rows; a rule set holds at most 10,000, so that this is safe to broadcast."""
    rows = [(i, r.id, r.description, r.java, r.secret_group, r.n_groups, r.entropy, list(r.tags), r.severity, r.confidence, r.rule_pack, r.provider, r.skip_report, r.detector, r.randomness_threshold) for i, r in enumerate(rules.rules)]
    return spark.createDataFrame(rows, RULES_SCHEMA)


def spans(text: Column, pattern: Column, group: Column, n_groups: Column, most: int) -> Column:
    """An array of (at, start, end, match, secret) for each match of the pattern: its number, the offsets in
    code points from 0, end excluded, and the secret: the rule's group, or for group 0 the first group
    that is not empty, or else the whole match. What stands between the matches gives the offsets. most:
    the largest number of groups that occurs. Every array is made once and walked once; null without matches."""
    none = F.array().cast("array<string>")
    hits = F.regexp_extract_all(text, pattern, F.lit(0)).alias("m")
    gaps = F.split(text, pattern, -1).alias("g")
    chosen = F.when(group > 0, F.regexp_extract_all(text, pattern, F.least(group, n_groups))).otherwise(none).alias("c")
    firsts = [F.when((group == 0) & (n_groups >= k), F.regexp_extract_all(text, pattern, F.lit(k))).otherwise(none).alias(f"s{k}") for k in range(1, most + 1)]
    zipped = F.filter(F.arrays_zip(hits, gaps, chosen, *firsts), lambda x: x["m"].isNotNull())

    def step(acc: Column, x: Column) -> Column:
        start = acc["next"] + F.char_length(x["g"])
        end = start + F.char_length(x["m"])
        free = F.coalesce(*[F.nullif(x[f"s{k + 1}"], F.lit("")) for k in range(len(firsts))], x["m"])
        secret = F.when(group > 0, F.coalesce(x["c"], F.lit(""))).otherwise(free)
        one = F.struct(F.size(acc["out"]).alias("at"), start.alias("start"), end.alias("end"), x["m"].alias("match"), secret.alias("secret"))
        return F.struct(end.alias("next"), F.concat(acc["out"], F.array(one)).alias("out"))

    zero = F.struct(F.lit(0).alias("next"), F.expr("cast(array() as array<struct<at:int,start:int,end:int,match:string,secret:string>>)").alias("out"))
    # Most candidates have no match: one search tells, before the arrays are made.
    return F.when(F.regexp_like(text, pattern), F.aggregate(zipped, zero, step, lambda acc: acc["out"]))


def line_and_column(text: Column, offset: Column, native: bool) -> tuple[Column, Column]:
    """1-based line, and column, of the code point at this offset. Native columns count code points;
    strict ones count UTF-8 bytes, with one added after the first line."""
    before = F.substring(text, F.lit(1), offset)
    line = F.char_length(before) - F.char_length(F.replace(before, F.lit("\n"), F.lit(""))) + 1
    rest = F.substring_index(before, "\n", -1)
    column = F.char_length(rest) + 1 if native else F.octet_length(rest) + 1 + F.when(line > 1, 1).otherwise(0)
    return line.cast("int"), column.cast("int")


def source_lines(text: Column, start: Column, end: Column) -> Column:
    """The whole source lines that the span touches."""
    head = F.substring_index(F.substring(text, F.lit(1), start), "\n", -1)
    tail = F.substring_index(F.substring(text, end + 1, F.char_length(text)), "\n", 1)
    return F.concat(head, F.substring(text, start + 1, end - start), tail)


def matches(candidates: DataFrame, rules: RuleSet, native: bool) -> DataFrame:
    """A row for each match of a candidate row's rule, in native mode also for each secret that its detector
    finds, with rule metadata, match, secret, source lines and position. Strict columns are inclusive at the
    end, native ones exclude it. The candidates are read once for both."""
    detects = native and any(r.detector for r in rules.rules)
    table = rules_table(candidates.sparkSession, rules).where("java <> '' or detector <> ''" if detects else "java <> ''")
    text, pattern = F.col("text"), F.col("java")
    most = max((r.n_groups for r in rules.rules), default=0)
    found = spans(text, pattern, F.col("secret_group"), F.col("n_groups"), most)
    if detects:
        nothing = F.expr("cast(array() as array<struct<at:int,start:int,end:int,match:string,secret:string>>)")
        found = F.concat(F.coalesce(F.when(pattern != "", found), nothing), F.coalesce(detector_spans(text, F.col("detector")), nothing))
    hit = settled(candidates.join(F.broadcast(table), "rule_at"), _spans=found)
    # Empty matches, which the rule dialect's engine would not report either, are left out.
    hit = hit.select("*", F.inline("_spans")).where("match <> ''").drop("_spans")
    hit = hit.withColumn("_text", F.coalesce("original", "text"))
    return positioned(hit, native).drop("java", "n_groups", "secret_group")


def positioned(hit: DataFrame, native: bool) -> DataFrame:
    """Source lines and positions in the original text (_text) of matches with offsets start and end."""
    text = F.col("_text")
    hit = hit.withColumns({"start": original_offset(F.col("start"), F.col("segments"), False), "end": original_offset(F.col("end"), F.col("segments"), True)})
    if "owned_from" in hit.columns:
        # A piece of a larger text: what begins elsewhere is another piece's.
        hit = hit.where((F.col("start") >= F.col("owned_from")) & (F.col("start") < F.col("owned_to"))).drop("owned_from", "owned_to")
    start_line, start_column = line_and_column(text, F.col("start"), native)
    last_line, last_column = line_and_column(text, F.col("end") if native else F.col("end") - 1, native)
    if not native:
        # The last byte of the last code point.
        width = F.octet_length(F.substring(text, F.col("end"), F.lit(1)))
        last_column = (last_column + width - 1).cast("int")
    lines = source_lines(text, F.col("start"), F.col("end"))
    return settled(hit, line=lines, start_line=start_line, end_line=last_line, start_column=start_column, end_column=last_column).drop("start", "end", "at", "original", "segments", "_text")
