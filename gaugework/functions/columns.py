"""Column expressions that the operators share."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_uniform(key: Column, seed: int, salt: str | Column) -> Column:
    """A number in [0, 1) that depends on key, seed and salt alone: the same on any partitioning, and in other engines."""
    salt = salt if isinstance(salt, Column) else F.lit(salt)
    text = F.concat(key.cast("string"), F.lit(f":{seed}:"), salt.cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / 4294967296.0


def hash_normal(key: Column, seed: int, salt: str | Column) -> Column:
    """A standard normal number from two hash-uniform ones."""
    salt = salt if isinstance(salt, Column) else F.lit(salt)
    u = hash_uniform(key, seed, F.concat(salt.cast("string"), F.lit(":a")))
    v = hash_uniform(key, seed, F.concat(salt.cast("string"), F.lit(":b")))
    return F.sqrt(-2.0 * F.log(1.0 - u)) * F.cos(2 * math.pi * v)


def ratio(a: Column, b: Column) -> Column:
    """a / b as double, 0 where b is 0."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a.cast("double") / b)


def clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-clip(x, -40.0, 40.0)))


def entropy2(p: Column) -> Column:
    """Binary entropy in bits, 0 at the ends."""
    return F.when((p <= 0) | (p >= 1), F.lit(0.0)).otherwise(-p * F.log2(p) - (1 - p) * F.log2(1 - p))


def rates(tp: Column, fp: Column, tn: Column, fn: Column) -> dict[str, Column]:
    """Accuracy, precision, recall, F1 and balanced accuracy from confusion counts, 0 for an empty denominator."""
    precision, recall = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return {
        "accuracy": ratio(tp + tn, tp + fp + tn + fn),
        "precision": precision,
        "recall": recall,
        "f1": ratio(2 * tp, 2 * tp + fp + fn),
        "balanced_accuracy": (ratio(tn, tn + fp) + recall) / 2,
    }


def with_rates(df, prefix: str = ""):
    """Add the rates of the columns tp, fp, tn, fn."""
    c = [F.col(prefix + x) for x in ("tp", "fp", "tn", "fn")]
    return df.withColumns({prefix + k: v for k, v in rates(*c).items()})


def flags(**conditions: Column) -> Column:
    """Names of the true conditions, sorted, joined by commas."""
    return F.concat_ws(",", F.array_sort(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in conditions.items()]))))
