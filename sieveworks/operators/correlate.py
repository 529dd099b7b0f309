"""Correlation of findings within one input: required rules, precedence, deduplication, metadata.

Inputs are keyed by input_id. Joins within an input also carry the line or the commit where the
semantics allow it, so that an input with very many findings is dealt over several tasks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sieveworks.functions.text import or_default
from sieveworks.plans.ruleset import RuleSet


NEEDS = "rule_at int, required_id string, within_lines int, within_columns int, n_required int"
NEAR = ["finding_id", "required_id", "n_required", "start_line", "s_line", "s_column", "s_secret"]


def _near_columns(places: DataFrame, support: DataFrame, wanted: list[tuple]) -> DataFrame:
    """Places with evidence on the same line: the line is part of the key."""
    needs = F.broadcast(places.sparkSession.createDataFrame(wanted, NEEDS))
    on_line = support.withColumn("start_line", F.col("s_line"))
    near = places.join(needs, "rule_at").join(on_line, ["input_id", "required_id", "start_line"])
    return near.where((F.abs(F.col("s_column") - F.col("start_column")) <= F.col("within_columns")) & (F.col("within_lines").isNull() | (F.col("within_lines") >= 0))).select(*NEAR)


def _near_lines(places: DataFrame, support: DataFrame, wanted: list[tuple]) -> DataFrame:
    """Places with evidence a few lines away. Lines are cut into bands as wide as the distance, and a place
    looks into its own band and those beside it. Of the evidence on one line the first is enough."""
    needs = F.broadcast(places.sparkSession.createDataFrame(wanted, NEEDS))
    band = lambda line: F.floor(F.col(line) / (F.col("within_lines") + 1))
    first = support.groupBy("input_id", "required_id", "s_line").agg(F.min(F.struct("s_column", "s_secret")).alias("s")).select("input_id", "required_id", "s_line", "s.*")
    first = first.join(needs.drop("n_required", "within_columns"), "required_id").withColumn("_band", band("s_line")).drop("within_lines")
    at = places.join(needs, "rule_at").withColumn("_band", F.explode(F.array(*[band("start_line") + i for i in (-1, 0, 1)])))
    near = at.join(first, ["input_id", "rule_at", "required_id", "_band"])
    return near.where(F.abs(F.col("s_line") - F.col("start_line")) <= F.col("within_lines")).select(*NEAR)


def _anywhere(places: DataFrame, support: DataFrame, wanted: list[tuple]) -> DataFrame:
    """Places with the evidence before and after them in the same input, by one walk over its lines in
    order and one back, so that an input with very many findings costs no more than sorting them. Both
    frames begin at the first row: one that went on to the end would be walked again for every row."""
    needs = F.broadcast(places.sparkSession.createDataFrame(wanted, NEEDS))
    first = support.groupBy("input_id", "required_id", "s_line").agg(F.min(F.struct("s_column", "s_secret")).alias("s"))
    found = F.struct("s_line", F.col("s.s_column").alias("s_column"), F.col("s.s_secret").alias("s_secret"))
    first = first.select("input_id", "required_id", F.col("s_line").alias("line"), found.alias("s")).join(F.broadcast(needs.select("required_id").distinct()), "required_id")
    at = places.join(needs, "rule_at").select("finding_id", "n_required", "input_id", "required_id", F.col("start_line").alias("line"))
    place = Window.partitionBy("input_id", "required_id").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    latest = F.last("s", ignorenulls=True)
    seen = at.unionByName(first, allowMissingColumns=True).withColumns({"before": latest.over(place.orderBy("line")), "after": latest.over(place.orderBy(F.desc("line")))})
    near = seen.where("finding_id is not null").select("finding_id", "required_id", "n_required", F.col("line").alias("start_line"), F.explode(F.array_compact(F.array("before", "after"))).alias("s"))
    return near.select("finding_id", "required_id", "n_required", "start_line", "s.*").select(*NEAR)


def require_rules(findings: DataFrame, rules: RuleSet) -> DataFrame:
    """Keeps a finding of a rule with required rules only if each of them has a finding in the same input:
    anywhere, within so many lines, or within so many columns of the same start line. Evidence is
    attached as required_findings, an array of (rule_id, start_line, secret). Findings need a unique
    finding_id. Rules without requirements pass through unshuffled."""
    wanted = [(i, q.id, q.within_lines, q.within_columns, len(r.required)) for i, r in enumerate(rules.rules) for q in r.required]
    empty = F.expr("cast(array() as array<struct<rule_id:string,start_line:int,secret:string>>)")
    if not wanted:
        return findings.withColumn("required_findings", empty)
    with_needs = [i for i, r in enumerate(rules.rules) if r.required]
    primary = findings.where(F.col("rule_at").isin(with_needs))
    support = findings.select("input_id", F.col("rule_id").alias("required_id"), F.col("start_line").alias("s_line"), F.col("start_column").alias("s_column"), F.col("secret").alias("s_secret"))
    places = primary.select("finding_id", "input_id", "rule_at", "start_line", "start_column")
    near = reduce(
        DataFrame.unionByName,
        [
            how(places, support, [w for w in wanted if kind(w)])
            for how, kind in ((_near_columns, lambda w: w[3] is not None), (_near_lines, lambda w: w[3] is None and w[2] is not None), (_anywhere, lambda w: w[2] is None and w[3] is None))
            if any(map(kind, wanted))
        ],
    )
    # One piece of evidence for each required rule: the nearest, then the first.
    distance = F.abs(F.col("s_line") - F.col("start_line"))
    evidence = F.min(F.struct(distance.alias("d"), F.col("s_line"), F.col("s_column"), F.col("s_secret"))).alias("e")
    met = near.groupBy("finding_id", "required_id", "n_required").agg(evidence)
    met = met.groupBy("finding_id", "n_required").agg(F.sort_array(F.collect_list(F.struct(F.col("required_id").alias("rule_id"), F.col("e.s_line").alias("start_line"), F.col("e.s_secret").alias("secret")))).alias("required_findings"))
    met = met.where(F.size("required_findings") == F.col("n_required")).select("finding_id", "required_findings")
    kept = primary.join(met, "finding_id")
    return findings.where(~F.col("rule_at").isin(with_needs)).withColumn("required_findings", empty).unionByName(kept)


#: Lengths of the pieces of secrets that containment is looked up by; a secret's own piece is its end, which
#: differs more than its beginning.
GRAMS = (0, 1, 2, 4, 8, 16)


def prefer_specific(findings: DataFrame) -> DataFrame:
    """Drops a finding of a generic rule (its id contains "generic") if a finding of another rule in the
    same input, commit and start line has a secret that contains its secret.

    The distinct generic secrets of a line look up the specific ones by the longest piece of GRAMS that fits
    their end, and only those that have it are compared: a line with very many findings costs no more than
    their characters, and no task holds a line. Secrets that are null contain nothing and are kept."""
    generic = F.contains("rule_id", F.lit("generic"))
    line = ["input_id", "_commit", "start_line"]
    keyed = findings.withColumn("_commit", F.coalesce("commit", F.lit("")))
    n = F.char_length("secret")
    size = reduce(lambda out, g: F.when(n >= g, g).otherwise(out), GRAMS, F.lit(0))
    asked = keyed.where(generic).select(*line, "secret").distinct().withColumn("_size", size)
    asked = asked.withColumn("_gram", F.when(F.col("_size") > 0, F.substring("secret", n - F.col("_size") + 1, F.col("_size"))).otherwise(""))
    # Only lines that have a generic finding are cut into pieces.
    wanted = asked.select(*line, "_size").distinct()
    held = keyed.where(~generic).select(*line, F.col("secret").alias("_held")).distinct().join(wanted, line).where(F.char_length("_held") >= F.col("_size"))
    places = F.when(F.col("_size") > 0, F.sequence(F.lit(1), F.char_length("_held") - F.col("_size") + 1)).otherwise(F.array(F.lit(1)))
    pieces = held.withColumn("_gram", F.explode(F.array_distinct(F.transform(places, lambda i: F.substring("_held", i, F.col("_size"))))))
    beaten = asked.join(pieces, [*line, "_size", "_gram"]).where(F.contains("_held", F.col("secret"))).select(*line, "secret").distinct()
    kept = keyed.where(generic).join(beaten, [*line, "secret"], "left_anti")
    return keyed.where(~generic).select(*findings.columns).unionByName(kept.select(*findings.columns))


DEDUP_KEY = ["input_id", "rule_id", "start_line", "end_line", "start_column", "end_column", "match", "secret", "decode_path"]


def drop_repeats(findings: DataFrame, order: str = "fragment") -> DataFrame:
    """The first finding, by `order`, of those equal in rule, position, evidence and decode path, as
    overlapping fragments of one input yield them."""
    cols = [c for c in findings.columns if c not in DEDUP_KEY]
    first = F.min(F.struct(order, *[c for c in cols if c != order])).alias("_f")
    return findings.groupBy(*DEDUP_KEY).agg(first).select(*[c if c in DEDUP_KEY else F.col(f"_f.{c}").alias(c) for c in findings.columns])


def with_metadata(findings: DataFrame, rules: DataFrame) -> DataFrame:
    """Severity, confidence, pack and provider from the first rule of each id, with their defaults."""
    first = rules.groupBy("rule_id").agg(F.min(F.struct("rule_at", "severity", "confidence", "rule_pack", "provider")).alias("r"))
    first = first.select("rule_id", *[F.col(f"r.{c}").alias(f"_{c}") for c in ("severity", "confidence", "rule_pack", "provider")])
    joined = findings.join(first, "rule_id", "left")
    return joined.select(
        *findings.columns,
        or_default(F.col("_severity"), "critical").alias("severity"),
        or_default(F.col("_confidence"), "high").alias("confidence"),
        F.coalesce("_rule_pack", F.lit("")).alias("rule_pack"),
        F.coalesce("_provider", F.lit("")).alias("provider"),
    )


def merge_snapshots(findings: DataFrame) -> DataFrame:
    """Findings of a Git index and working tree, merged: the k-th of a fingerprint in the working tree
    stands for the k-th in the index, in the index finding's place, with provenance git-index+worktree.
    Needs fingerprint, provenance_type and position, the order within a snapshot."""
    n = F.row_number().over(Window.partitionBy("fingerprint", "provenance_type").orderBy("position"))
    numbered = findings.withColumn("_n", n)
    index = numbered.where("provenance_type = 'git-index'").select("fingerprint", "_n", F.col("position").alias("_at"))
    tree = numbered.where("provenance_type = 'git-worktree'")
    paired = tree.join(index, ["fingerprint", "_n"], "left")
    both = F.col("_at").isNotNull()
    merged = paired.withColumn("provenance_type", F.when(both, "git-index+worktree").otherwise(F.col("provenance_type"))).withColumn("position", F.coalesce("_at", "position"))
    only_index = numbered.where("provenance_type = 'git-index'").join(tree.select("fingerprint", "_n"), ["fingerprint", "_n"], "left_anti")
    other = numbered.where("provenance_type NOT IN ('git-index', 'git-worktree')")
    return merged.select(*findings.columns).unionByName(only_index.select(*findings.columns)).unionByName(other.select(*findings.columns))
