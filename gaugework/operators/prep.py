"""Preparation of examples: scaling, selection, feature maps, splits, sampling and oversampling."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Sequence
from decimal import Decimal
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugework.functions.columns import hash_uniform
from gaugework.operators.profile import mutual_information
from gaugework.plans.patterns import MOST_BUCKETS, at_ranks, ranked, to_long, with_totals


def fit_standardizer(train: DataFrame, features: Sequence[str]) -> DataFrame:
    """Mean and population deviation of each feature (1 where it is under 1e-8)."""
    s = to_long(train, features, ()).groupBy("feature_index", "feature").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
    return s.select("feature_index", "feature", "mean", F.when(F.col("std") < 1e-8, 1.0).otherwise(F.col("std")).alias("scale"))


def standardize(df: DataFrame, standardizer: DataFrame, features: Sequence[str]) -> DataFrame:
    """``df`` with (x - mean) / scale in place of each feature. The standardizer has one row for each feature."""
    wide = standardizer.agg(*[F.max(F.when(F.col("feature") == f, F.struct("mean", "scale"))).alias(f"_{f}") for f in features])
    scaled = with_totals(df, wide)
    return scaled.withColumns({f: (F.col(f) - F.col(f"_{f}.mean")) / F.col(f"_{f}.scale") for f in features}).drop(*[f"_{f}" for f in features])


def select_features(examples: DataFrame, features: Sequence[str], k: int) -> DataFrame:
    """The k features with the most information on the label, in their own order."""
    return mutual_information(examples, features).orderBy(F.desc("mutual_information"), "feature_index").limit(k).orderBy("feature_index")


def quadratic(features: Sequence[str], most_pairs: int = 128) -> dict[str, Column]:
    """x, x squared, and products of pairs."""
    out = {f: F.col(f) for f in features} | {f"{f}_sq": F.col(f) * F.col(f) for f in features}
    return out | {f"{a}_{b}": F.col(a) * F.col(b) for a, b in list(combinations(features, 2))[:most_pairs]}


def fourier_weights(d: int, size: int = 16, gamma: float = 1.0, seed: int = 42) -> list[tuple[list[float], float]]:
    """Weights and shift of each random Fourier feature, drawn from hashes of their place."""

    def u(*key: object) -> float:
        return (int(hashlib.md5(":".join(map(str, (seed, *key))).encode()).hexdigest()[:8], 16) + 0.5) / 2**32

    def normal(*key: object) -> float:
        return math.sqrt(-2 * math.log(u(*key, "a"))) * math.cos(2 * math.pi * u(*key, "b"))

    return [([normal(i, j) * math.sqrt(2 * gamma) for j in range(d)], 2 * math.pi * u(i, "shift")) for i in range(size)]


def fourier(features: Sequence[str], size: int = 16, gamma: float = 1.0, seed: int = 42) -> dict[str, Column]:
    """Random Fourier features: sqrt(2 / m) cos(w x + b)."""
    out = {}
    for i, (w, b) in enumerate(fourier_weights(len(features), size, gamma, seed)):
        dot = sum((F.col(f) * v for f, v in zip(features, w, strict=True)), F.lit(b))
        out[f"rff{i}"] = F.cos(dot) * math.sqrt(2 / size)
    return out


def _class_ranks(examples: DataFrame, seed: int, salt: str, by: Sequence[str] = ()) -> DataFrame:
    """Rank of each row in its class by a hash of its id, and the class's size."""
    u = hash_uniform(F.col("row_id"), seed, salt)
    sizes = examples.groupBy(*by, "label").agg(F.count("*").alias("_n"))
    return with_totals(ranked(examples, u, "row_id", [*by, "label"], "_rank"), sizes, [*by, "label"])


def stratified_split(examples: DataFrame, shares: dict[str, float], seed: int = 42, by: Sequence[str] = ()) -> DataFrame:
    """``examples`` with ``split``: in each class exactly the rounded share of rows, in hash order; the last split gets the
    rest, and each split at least one row of a class that has enough."""
    r = _class_ranks(examples, seed, "split", by)
    names, out, so_far = list(shares), F.lit(list(shares)[-1]), 0.0
    n = F.col("_n")
    for i, name in reversed(list(enumerate(names[:-1]))):
        # As decimals: 45 * 0.7 is 31.5, and not the double below it, which would be rounded down.
        so_far = sum((Decimal(str(x)) for x in list(shares.values())[: i + 1]), Decimal(0))
        cut = F.greatest(F.lit(i + 1), F.least(F.bround(n.cast("decimal(20,0)") * F.lit(so_far)).cast("long"), n - (len(names) - 1 - i)))
        out = F.when(F.col("_rank") <= cut, F.lit(name)).otherwise(out)
    return r.withColumn("split", out).drop("_rank", "_n")


def calibration_split(examples: DataFrame, fraction: float = 0.5, seed: int = 42) -> DataFrame:
    """``examples`` with ``side`` (calibration or evaluation), stratified; over all rows instead where a class has fewer than
    two. ``split_source`` says which."""
    r = _class_ranks(examples, seed, "calibration")
    sizes = examples.groupBy("label").agg(F.count("*").alias("n")).agg(F.min("n").alias("least"), F.count("*").alias("classes"), F.sum("n").alias("_total"))
    r = with_totals(ranked(r, hash_uniform(F.col("row_id"), seed, "calibration"), "row_id", (), "_all_rank"), sizes)
    whole = (F.col("least") < 2) | (F.col("classes") < 2)
    cut = lambda n: F.greatest(F.lit(1), F.least(F.bround(n * fraction), n - 1))
    first = F.when(whole, F.col("_all_rank") <= cut(F.col("_total"))).otherwise(F.col("_rank") <= cut(F.col("_n")))
    out = r.withColumn("side", F.when(first, "calibration").otherwise("evaluation")).withColumn("split_source", F.when(whole, "global").otherwise("stratified"))
    return out.drop("_rank", "_n", "_all_rank", "_total", "least", "classes")


def folds(examples: DataFrame, k: int = 5, seed: int = 42) -> DataFrame:
    """``examples`` with ``fold``: rows of each class in hash order, dealt out in turn."""
    return _class_ranks(examples, seed, "fold").withColumn("fold", ((F.col("_rank") - 1) % k).cast("int")).drop("_rank", "_n")


def order_split(rows: DataFrame, order: Column, fraction: float = 0.5, least: int = 2) -> DataFrame:
    """``rows`` with their place in order (from 0) and ``side``: the first round(n * fraction) rows are the reference."""
    n = rows.agg(F.count("*").alias("_n"))
    out = with_totals(ranked(rows, order, "row_id", (), "_rank"), n)
    cut = F.greatest(F.lit(least), F.least(F.bround(F.col("_n") * fraction), F.col("_n") - least))
    return out.withColumn("order_index", F.col("_rank") - 1).withColumn("side", F.when(F.col("_rank") <= cut, "reference").otherwise("current")).drop("_rank", "_n")


def even_sample(rows: DataFrame, order: Column, m: int) -> DataFrame:
    """m rows evenly spaced in order (all, if there are no more): places floor(i (n - 1) / (m - 1))."""
    n = rows.agg(F.count("*").alias("_n"))
    place = F.floor(F.col("id") * (F.col("_n") - 1) / F.lit(max(m - 1, 1)))
    wanted = with_totals(rows.sparkSession.range(max(m, 1)), n).select((place + 1).cast("long").alias("k")).distinct()
    # Many more buckets than places, so that few of the rows are in one that is put in order.
    return at_ranks(rows, order, wanted, buckets=min(16 * max(m, 4), MOST_BUCKETS)).drop("rank")


def class_weights(examples: DataFrame) -> DataFrame:
    """n / (2 n_c) for each class; null where there is one class."""
    c = examples.groupBy("label").agg(F.count("*").alias("count"))
    total = c.agg(F.sum("count").alias("n"), F.count("*").alias("classes"))
    return with_totals(c, total).select("label", "count", F.when(F.col("classes") == 2, F.col("n") / (2 * F.col("count"))).alias("weight"))


def oversample_minority(examples: DataFrame, features: Sequence[str], neighbours: DataFrame, target_ratio: float = 1.0, seed: int = 42) -> DataFrame:
    """``examples`` and made rows of the minority class, up to ``target_ratio`` of the majority's size (SMOTE).

    ``neighbours`` (row_id, other_id, rank) are nearest rows inside the minority class. The i-th made row starts from a
    minority row in turn, picks a neighbour by hash, and lies a hash-uniform share of the way to it. Made rows have
    negative ids."""
    sizes = examples.groupBy("label").agg(F.count("*").alias("n"))
    low = sizes.agg(F.min_by("label", F.struct("n", F.col("label"))).alias("minority"), F.min("n").alias("n_min"), F.max("n").alias("n_max"))
    base = with_totals(examples, low).where(F.col("label") == F.col("minority"))
    wanted = F.greatest(F.lit(0), F.floor(F.col("n_max") * target_ratio) - F.col("n_min"))
    base = ranked(base, hash_uniform(F.col("row_id"), seed, "smote"), "row_id", (), "_rank").withColumn("_wanted", wanted)
    rounds = F.floor((F.col("_wanted") - F.col("_rank")) / F.col("n_min"))
    made = base.where("_rank <= _wanted").withColumn("_round", F.explode(F.sequence(F.lit(0).cast("long"), rounds.cast("long")))).withColumn("_i", F.col("_round") * F.col("n_min") + F.col("_rank"))
    degree = neighbours.groupBy("row_id").agg(F.count("*").alias("_k"))
    made = made.join(degree.hint("merge"), "row_id").withColumn("rank", (F.floor(hash_uniform(F.col("_i"), seed, "neighbour") * F.col("_k")) + 1).cast("int"))
    other = examples.select(F.col("row_id").alias("other_id"), *[F.col(f).alias(f"_o_{f}") for f in features])
    made = made.join(neighbours.select("row_id", "other_id", "rank").hint("merge"), ["row_id", "rank"]).join(other.hint("merge"), "other_id")
    step = hash_uniform(F.col("_i"), seed, "lambda")
    new = made.select((-F.col("_i")).alias("row_id"), "label", *[(F.col(f) + step * (F.col(f"_o_{f}") - F.col(f))).alias(f) for f in features])
    return examples.select("row_id", "label", *features).unionByName(new)

