"""Candidate generation: which rules can match an input at all, and what may be read."""

from __future__ import annotations

from functools import lru_cache, reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveworks.plans.dialect import to_java
from sieveworks.plans.predicates import compile_predicate
from sieveworks.plans.ruleset import Allowlist, Rule, RuleSet


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def path_matches(path: Column, patterns: tuple[str, ...]) -> Column:
    """Whether the path, or the path with backslashes, matches one of the patterns."""
    return any_of([F.regexp_like(p, F.lit(to_java(rx))) for rx in patterns for p in (path, F.replace(path, F.lit("/"), F.lit("\\")))])


def ancestors_match(path: Column, patterns: tuple[str, ...]) -> Column:
    """Whether the path or one of the directories above it matches."""
    parts = F.split(path, "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    return F.exists(above, lambda p: path_matches(p, patterns)) if patterns else F.lit(False)


def global_path_patterns(allowlists: tuple[Allowlist, ...]) -> tuple[str, ...]:
    """Path patterns that settle the matter alone: of allowlists that need no other check."""
    alone = lambda a: a.condition == "OR" or not (a.regexes or a.stopwords or a.commits)
    return tuple(p for a in allowlists if alone(a) for p in a.paths)


def drop_allowed_paths(content: DataFrame, rules: RuleSet) -> DataFrame:
    """content without inputs whose path an allowlist names, or the rule set's prefilter skips. Stands
    before anything that reads the text, so that scans of files need not open them."""
    patterns = global_path_patterns(rules.allowlists)
    if patterns:
        content = content.where(~F.coalesce(ancestors_match(F.col("path"), patterns), F.lit(False)))
    if rules.prefilter:
        content = content.where(~compile_predicate(rules.prefilter, "source"))
    return content


def settled(df: DataFrame, **columns: Column) -> DataFrame:
    """df with these columns, each evaluated once. Plain projections get inlined into every filter and
    expression above them, over and over if they refer to each other; what a Generate yields does not."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


#: Up to so many keywords are looked for one after the other in the JVM, more in one pass over the text.
FEW_WORDS = 24


@lru_cache(maxsize=8)
def _automaton(words: tuple[str, ...]):
    import ahocorasick

    out = ahocorasick.Automaton()
    for i, w in enumerate(words):
        out.add_word(w, i)
    out.make_automaton()
    return out


def words_in(low: Column, words: tuple[str, ...]) -> Column:
    """The numbers of the words that stand in a lower-cased text. A few are searched by the JVM one by one.
    That takes time in proportion to the pack, so more of them are found in one pass by an automaton, in
    Arrow batches of texts: for 200 words over 33 MB in a third of the time, and in a tenth where one task
    reads it all."""
    if len(words) <= FEW_WORDS:
        table = F.array(*[F.struct(F.lit(w).alias("word"), F.lit(i).alias("i")) for i, w in enumerate(words)])
        return F.transform(F.filter(table, lambda e: F.contains(low, e["word"])), lambda e: e["i"])

    @F.arrow_udf("array<int>")
    def search(texts: pa.Array) -> pa.Array:
        find = _automaton(words).iter
        return pa.array([sorted({i for _, i in find(t.as_py() or "")}) for t in texts], pa.list_(pa.int32()))

    return search(low)


def candidate_rules(content: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """content with _rules, the positions of the rules that can match, rising: no keyword, or one that
    stands in the text whatever its case; and a path pattern, if any, that matches. The pattern itself is
    only tried on what this lets through."""
    words: dict[str, list[int]] = {}
    for i, r in enumerate(rules):
        if r.regex or r.detector:
            for k in r.keywords or ("",):
                words.setdefault(k, []).append(i)
    always = words.pop("", [])
    found = F.array(*map(F.lit, always)) if always else F.array().cast("array<int>")
    out = content
    if words:
        low = settled(content, _low=F.lower("text"))
        out = low.withColumn("_words", words_in(F.col("_low"), tuple(words))).drop("_low")
        # As text, since a column object for each number would take seconds to build.
        table = F.expr(f"array({', '.join(f'array({", ".join(map(str, at))})' for at in words.values())})")
        found = F.concat(found, F.flatten(F.transform("_words", lambda i: F.get(table, i))))
    found = F.array_sort(F.array_distinct(found))
    limited = {i: r for i, r in enumerate(rules) if r.path and (r.regex or r.detector)}
    if limited:
        path = F.coalesce("path", F.lit(""))
        off = F.array_compact(F.array(*[F.when(~F.regexp_like(path, F.lit(to_java(r.path))), F.lit(i)) for i, r in limited.items()]))
        found = F.array_except(found, off)
    return settled(out, _rules=found).drop("_words")


def candidates(content: DataFrame, rules: RuleSet) -> DataFrame:
    """content with a row for each candidate rule, its position in rule_at. The explode (a Generate) keeps
    the optimizer from testing patterns ahead of keywords, which it does to a join."""
    low = candidate_rules(content, rules.rules)
    out = low.where(F.size("_rules") > 0).select("*", F.explode("_rules").alias("rule_at")).drop("_rules")
    filtered = [(i, r) for i, r in enumerate(rules.rules) if r.prefilter]
    for i, r in filtered:
        out = out.where(~((F.col("rule_at") == i) & compile_predicate(r.prefilter, "source")))
    return out
