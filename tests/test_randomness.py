"""The features of randomness by value, and the fitted weights on held-out samples."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sieveworks.operators.randomness import DEFAULT_WEIGHTS, FEATURES, classify, features_of, quality, sample_of, samples, score


def features(spark, *texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, s string").select("i", features_of(sample_of(F.col("s"))).alias("x")).orderBy("i").collect()
    return [dict(zip(FEATURES, r.x, strict=True)) for r in rows]


def test_features_by_value(spark):
    hexa, runs, steps, words, coded, empty, beats = features(spark, "0123456789abcdef", "aaaaaaaaaaaa", "abcdefghijkl", "ghp_thereinstreet", "ab:c29tZSBwbGFpbiB0ZXh0IGhlcmU=", "--", "xyzxyzxyzxyz")
    assert hexa["entropy"] == 1.0 and hexa["distinct"] == pytest.approx(16 / (16 * (1 - (15 / 16) ** 16)), abs=1e-6) and hexa["transitions"] == 1.0 and hexa["length"] == 0.25
    assert hexa["sequence"] == pytest.approx(14 / 15, abs=1e-6) and hexa["classes"] == pytest.approx((6 / 16 * np.log2(16 / 6) + 10 / 16 * np.log2(16 / 10)) / 1.585, abs=1e-6)
    assert runs["entropy"] == 0 and runs["longest_run"] == 1 and runs["period"] == 1 and runs["transitions"] == pytest.approx(1 / 11, abs=1e-6)
    assert steps["sequence"] == 1 and steps["longest_run"] == pytest.approx(1 / 12, abs=1e-6) and steps["period"] == 0
    assert words["pairs"] >= 0.6 > hexa["pairs"] and beats["period"] == 1 and beats["longest_run"] == pytest.approx(1 / 12, abs=1e-6)
    assert coded["printable"] == 1 and hexa["printable"] == 0 and coded["placeholder"] == 0 == words["placeholder"] and hexa["placeholder"] == 1
    assert features(spark, "myexamplekey99")[0]["placeholder"] == 1 and len(empty) == len(FEATURES) == 11 == len(DEFAULT_WEIGHTS) - 1


def test_scores_of_odd_secrets(spark):
    rows = spark.createDataFrame([(0, ""), (1, None), (2, "x"), (3, "é"), (4, "a" * 100_000), (5, "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b2b0b822cd15d6c15b0f00a08")], "i int, s string")
    got = {r.i: (r.p, r.c) for r in rows.select("i", score(F.col("s")).alias("p")).withColumn("c", classify(F.col("p"))).collect()}
    assert got[0][0] == got[3][0] == 0.0 and got[1][0] is None and got[4][1] == "structured" and got[5][1] == "random" and 0 <= got[2][0] <= 1


def test_quality_on_samples_that_were_not_fitted(spark):
    rows = spark.createDataFrame(samples(400, seed=77), "secret string, label int").select(score(F.col("secret")).alias("p"), "label").collect()
    p, y = np.array([r.p for r in rows]), np.array([float(r.label) for r in rows])
    assert quality(p, y)["accuracy"] > 0.97 and quality(p, y)["brier"] < 0.04 and quality(p, y, 0.8)["precision"] > 0.99 and quality(p, y, 0.8)["recall"] > 0.8
