"""How random a secret looks: a logistic model over simple features, as Column expressions.

Eleven features of the longest run of letters and digits in the first 4,096 characters, up to 512 of them:
entropy against that of its alphabet, distinct characters against those expected, diversity of neighbouring
pairs, longest repetition, pairs in sequence, repetition with a short period, common pairs of letters, balance of
character classes, printable text behind base64, words that stand for a placeholder, and length. Scores are
not comparable with those of other tools. train_logistic fits the weights; the defaults were fitted on
samples(2000, seed=1) of this module.
"""

from __future__ import annotations

import base64
import random

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveworks.functions.text import entropy

from .candidates import settled

FEATURES = ("entropy", "distinct", "transitions", "longest_run", "sequence", "period", "pairs", "classes", "printable", "placeholder", "length")
STRUCTURED, RANDOM = 0.2, 0.8
MODEL = "sieve-random-v2"
#: Bias, then a weight for each feature: as train_logistic fits them, to two decimals.
DEFAULT_WEIGHTS = (-2.97, 0.98, 2.13, 1.07, -0.42, -0.13, -1.25, -5.43, 1.96, -4.84, -2.03, 0.99)
#: The longest period that repetition is looked for with.
PERIODS = 8
#: Pairs of letters that are frequent in words and names.
COMMON = "al an ar as at co de ea ec ed en er es et he ic id in io is it le me nd ne ng nt of on or ou pa po pr ra re ri ro se si st ta te th ti to tr ur us ve".split()
PLACEHOLDER = r"(?i)example|sample|dummy|placeholder|changeme|password|secret|token|test|fake|your|xxxx|0000|1234"
_NONE = "struct<model:string,score:double,classification:string>"


def sample_of(secret: Column) -> Column:
    runs = F.regexp_extract_all(F.substring(secret, 1, 4096), F.lit("[0-9A-Za-z]+"), F.lit(0))
    longest = F.reduce(runs, F.lit(""), lambda a, x: F.when(F.char_length(x) > F.char_length(a), x).otherwise(a))
    return F.substring(longest, 1, 512)


def _share(some: Column, n: Column) -> Column:
    return F.size(some) / F.greatest(n, F.lit(1.0))


def _features(sample: Column) -> Column:
    """The features of a sample that is computed once, as an array."""
    n = F.char_length(sample).cast("double")
    one = F.greatest(n, F.lit(1.0))
    chars = F.filter(F.split(sample, ""), lambda c: c != "")
    size = F.when(F.regexp_like(sample, F.lit("^(?:[0-9a-f]*|[0-9A-F]*)$")), 16.0).otherwise(62.0)

    def over(cs: Column) -> Column:
        codes = F.transform(cs, lambda c: F.ascii(c))
        after = lambda k: F.slice(codes, k + 1, F.greatest(F.size(codes) - k, F.lit(0)))
        before = lambda k: F.slice(codes, 1, F.greatest(F.size(codes) - k, F.lit(0)))
        steps = F.zip_with(before(1), after(1), lambda x, y: y - x)
        pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(cs) - 1, F.lit(1))), lambda i: F.lower(F.substring(sample, i, F.lit(2))))
        runs = F.regexp_extract_all(sample, F.lit(r"(.)\1*+"), F.lit(0))
        longest = F.reduce(runs, F.lit(0), lambda a, x: F.greatest(a, F.char_length(x)))
        expected = size * (1 - F.pow(1 - 1 / size, n))
        # Of every period from 2 on, the share of characters that equal the one a period before.
        again = [F.size(F.filter(F.zip_with(before(k), after(k), lambda x, y: F.when(x == y, 1).otherwise(0)), lambda x: x == 1)) / F.greatest(n - k, F.lit(1.0)) for k in range(2, PERIODS + 1)]
        classes = [F.regexp_count(sample, F.lit(rx)) / one for rx in ("[a-z]", "[A-Z]", "[0-9]")]
        balance = sum((F.when(p > 0, -p * F.log2(p)).otherwise(0.0) for p in classes), F.lit(0.0)) / 1.585
        whole = F.substring(sample, F.lit(1), (F.floor(n / 4) * 4).cast("int"))
        decoded = F.try_to_binary(whole, F.lit("base64")).cast("string")
        printable = F.coalesce(F.regexp_like(decoded, F.lit(r"^[\x20-\x7E]{6,}$")), F.lit(False)).cast("double")
        return F.array(
            entropy(sample) / F.greatest(F.log2(F.least(one, size)), F.lit(1.0)), F.size(F.array_distinct(cs)) / F.greatest(expected, F.lit(1.0)), _share(F.array_distinct(pairs), n - 1), longest / one,
            _share(F.filter(steps, lambda d: F.abs(d) == 1), n - 1), F.greatest(*again), _share(F.filter(pairs, lambda p: F.array_contains(F.array(*map(F.lit, COMMON)), p)), n - 1), balance, printable,
            F.regexp_like(sample, F.lit(PLACEHOLDER)).cast("double"), F.least(n, F.lit(64.0)) / 64,
        )

    return F.get(F.transform(F.array(chars), over), F.lit(0))


def features_of(sample: Column) -> Column:
    """The eleven features, each to six decimals, as an array."""
    return F.transform(F.get(F.transform(F.array(sample), _features), F.lit(0)), lambda x: F.round(x, 6))


def score(secret: Column, weights: tuple[float, ...] = DEFAULT_WEIGHTS) -> Column:
    """Between 0 and 1, to six decimals; 0 for a secret without letters and digits."""
    sample = sample_of(secret)
    weighted = F.zip_with(features_of(sample), F.array(*map(F.lit, weights[1:])), lambda x, w: x * w)
    z = F.aggregate(weighted, F.lit(float(weights[0])), lambda a, x: a + x)
    return F.when(sample == "", 0.0).otherwise(F.round(1 / (1 + F.exp(-z)), 6))


def classify(s: Column) -> Column:
    return F.when(s <= STRUCTURED, "structured").when(s >= RANDOM, "random").otherwise("indeterminate")


def scored(findings: DataFrame, native: bool, once: bool = True) -> DataFrame:
    """findings with a randomness struct in native mode, null otherwise. Without once, a score that nothing reads
    is not found at all, and one that is read is found for each use."""
    if not native:
        return findings.withColumn("randomness", F.lit(None).cast(_NONE))
    # Settled, so that the many features are found once for each finding, not for each use of the score.
    out = settled(findings, _score=score(F.col("secret"))) if once else findings.withColumn("_score", score(F.col("secret")))
    s = F.col("_score")
    return out.withColumn("randomness", F.struct(F.lit(MODEL).alias("model"), s.alias("score"), classify(s).alias("classification"))).drop("_score")


def train_logistic(x: np.ndarray, y: np.ndarray, rounds: int = 12_000, rate: float = 0.35, ridge: float = 0.0025) -> np.ndarray:
    """Bias and weights by gradient descent with an L2 penalty on the weights."""
    x1 = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x1.shape[1])
    keep = np.r_[0.0, np.full(x.shape[1], ridge)]
    for _ in range(rounds):
        w -= rate * (x1.T @ (1 / (1 + np.exp(-x1 @ w)) - y) / len(y) + keep * w)
    return w


def quality(p: np.ndarray, y: np.ndarray, cut: float = 0.5) -> dict[str, float]:
    """Accuracy, Brier score, precision and recall of scores against labels."""
    hit = p >= cut
    return {
        "accuracy": float((hit == y).mean()), "brier": float(((p - y) ** 2).mean()),
        "precision": float(y[hit].mean()) if hit.any() else 1.0, "recall": float(hit[y == 1].mean()) if (y == 1).any() else 1.0,
    }


def samples(n: int, seed: int) -> list[tuple[str, int]]:
    """n random keys (label 1) and n structured words, names, paddings and encoded text (label 0)."""
    r = random.Random(seed)
    alphabets = ["0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"]
    words = "access account admin application backend client config connection customer database default development example header identifier internal library message number package password production project public request response sample secret service session staging string system template testing token update user value version".split()
    out = [("".join(r.choices(r.choice(alphabets), k=r.randint(16, 48))), 1) for _ in range(n)]
    for _ in range(n):
        form = r.randrange(5)
        text = "".join(w.capitalize() if form == 1 else w for w in r.choices(words, k=r.randint(2, 5)))
        if form == 4:
            text = base64.b64encode(" ".join(r.choices(words, k=4)).encode()).decode().rstrip("=")
        out.append((text if form != 3 else r.choice("ax01") * r.randint(12, 40), 0))
        if form == 2:
            out[-1] = (text + str(r.randint(0, 9999)), 0)
    return out
