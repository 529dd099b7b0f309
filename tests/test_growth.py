"""Plans whose work grows with the input only: rows are dealt over tasks, costly steps are done once."""

from pyspark.sql import functions as F

from sieveworks.operators.randomness import scored
from sieveworks.plans.scan import scan
from sieveworks.queries import GENERIC, ROWS_A_TASK, customers


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_compact_tables_are_dealt_over_tasks(spark):
    rows = customers(spark, "/root/testdata/sf0.1")
    assert rows.rdd.getNumPartitions() == -(-rows.count() // ROWS_A_TASK) > 1


def test_scores_are_found_once_for_all_their_uses(spark):
    rows = scored(spark.createDataFrame([("8f14e45fceea167a5a36dedd4bea2543",)], "secret string"), True)
    used = rows.where("randomness.score > 0.5").select(F.col("randomness.score"), F.col("randomness.classification"))
    assert plan(used).count("xxxx|0000") == 1 and used.count() == 1


def test_packs_of_generic_rules_alone_need_no_precedence(spark):
    content = spark.createDataFrame([("a.txt", 'api_token = "8f14e45fceea167a5a36dedd4bea2543"')], "path string, text string")
    found = scan(content, GENERIC)
    assert "LeftAnti" not in plan(found) and found.count() == 1
