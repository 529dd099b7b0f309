import pytest
from pyspark.sql import Row

from sieveworks.plans.predicates import PredicateError, compile_predicate


def truth(spark, text, **row):
    base = {"path": "src/a.py", "symlink_file": "", "secret": "abc", "start_line": 3, "tags": ["x", "y"]}
    return spark.createDataFrame([Row(**(base | row))]).select(compile_predicate(text).alias("v")).first().v


@pytest.mark.parametrize(
    ("text", "value"),
    [
        ('source.path starts_with "src/"', True),
        ('!(source.path ends_with ".py") || finding.start_line > 2', True),
        ('finding.tags contains "y" && finding.secret matches "^a.c$"', True),
        ("finding.secret == 'abc' && finding.start_line != 3", False),
        ('finding.tags contains "z"', False),
        ("true || false && false", True),
    ],
)
def test_values(spark, text, value):
    assert truth(spark, text) is value


def test_too_long_text_gives_up_on_the_whole(spark):
    long = "a" * 65_537
    assert truth(spark, 'finding.secret contains "b"', secret=long) is False
    assert truth(spark, '!(finding.secret contains "b")', secret=long) is False
    assert truth(spark, 'finding.secret contains "b" || true', secret=long) is False
    assert truth(spark, 'true || finding.secret contains "b"', secret=long) is True


@pytest.mark.parametrize("text", ["finding.nothing == 1", "finding.secret > 1", "1 == 'a'", "(true", "true true", "finding.secret matches finding.line", "finding.tags == finding.tags", "(" * 17 + "true" + ")" * 17, "'" + "a" * 1025 + "' == ''"])
def test_errors(text):
    with pytest.raises(PredicateError):
        compile_predicate(text)


def test_prefilters_see_sources_only():
    with pytest.raises(PredicateError):
        compile_predicate('finding.secret == "a"', "source")
