"""Filters on findings: entropy, allowlists, inline marks, predicates and validation states."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveworks.plans.dialect import to_java
from sieveworks.plans.predicates import compile_predicate
from sieveworks.plans.ruleset import Allowlist, RuleSet

from .candidates import any_of, path_matches

#: Fixed value: the mark that allows a line's findings.
INLINE_MARK = "gitleaks:allow"
VERIFIED = ("structurally-valid", "active")


def allowed(a: Allowlist) -> Column:
    """Whether an allowlist covers a finding: one of its checks, or with AND each that it has."""
    target = F.col({"secret": "secret", "match": "match", "line": "line"}[a.regex_target])
    checks = []
    if a.commits:
        checks.append(F.lower("commit").isin([c.lower() for c in a.commits]))
    if a.paths:
        checks.append(path_matches(F.coalesce("path", F.lit("")), a.paths))
    if a.regexes:
        checks.append(any_of([F.regexp_like(target, F.lit(to_java(rx))) for rx in a.regexes]))
    if a.stopwords:
        low = F.lower("secret")
        words = F.array(*[F.lit(w.lower()) for w in a.stopwords])
        checks.append(F.exists(words, lambda w: F.contains(low, w)))
    checks = [F.coalesce(c, F.lit(False)) for c in checks]
    return reduce((lambda x, y: x & y) if a.condition == "AND" else (lambda x, y: x | y), checks, F.lit(a.condition == "AND") if not checks else checks.pop())


def drop_allowed(findings: DataFrame, rules: RuleSet) -> DataFrame:
    """findings that no allowlist covers, neither their rule's nor a global one. Rules of native packs
    (those with a rule_pack) go by their own allowlists only."""
    plain = any_of([allowed(a) for a in rules.allowlists])
    covered = plain & (F.coalesce("rule_pack", F.lit("")) == "")
    for i, r in enumerate(rules.rules):
        if r.allowlists:
            covered = covered | F.when(F.col("rule_at") == i, any_of([allowed(a) for a in r.allowlists])).otherwise(F.lit(False))
    return findings.where(~covered)


def drop_low_entropy(findings: DataFrame) -> DataFrame:
    """findings whose entropy exceeds their rule's threshold; 0 is no threshold."""
    return findings.where((F.col("min_entropy") == 0) | (F.col("entropy") > F.col("min_entropy")))


def drop_inline_allowed(findings: DataFrame, mark: str = INLINE_MARK) -> DataFrame:
    return findings.where(~F.contains("line", F.lit(mark)))


def drop_filtered(findings: DataFrame, rules: RuleSet) -> DataFrame:
    """findings that neither the rule set's filter nor their rule's suppresses."""
    if rules.filter:
        findings = findings.where(~compile_predicate(rules.filter))
    for i, r in enumerate(rules.rules):
        if r.filter:
            findings = findings.where(~((F.col("rule_at") == i) & compile_predicate(r.filter)))
    return findings


def keep_states(findings: DataFrame, states: list[str] | tuple[str, ...]) -> DataFrame:
    return findings.where(F.col("validation_state").isin(list(states)))
