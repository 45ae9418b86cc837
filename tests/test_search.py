"""The shared search against Spark ML's own fits, and its trial history."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugework.functions.columns import hash_uniform
from gaugework.operators import search
from gaugework.operators.modeling import fit_logistic


@pytest.fixture(scope="module")
def rows(spark):
    u = lambda s: hash_uniform(F.col("id"), 1, s) * 4 - 2
    df = spark.range(3000).select(F.col("id").alias("row_id"), u("a").alias("a"), u("b").alias("b"), u("c").alias("c"))
    z = F.col("a") * 1.5 - F.col("b") + F.col("a") * F.col("b") - 1
    return df.withColumn("label", (hash_uniform(F.col("row_id"), 1, "y") < 1 / (1 + F.exp(-z))).cast("int")).cache()


def test_space_has_432_points():
    assert len(search.space()) == len(set(search.space())) == 432 == len(search.drawn(432))
    assert search.drawn(20) == search.drawn(20) and len(set(search.drawn(20))) == 20
    with pytest.raises(ValueError):
        search.drawn(433)


def test_fits_equal_spark_ml(rows):
    """A trial of all rows without class weights is the plain penalised regression; Spark ML penalises standardized weights alike
    where the columns have a deviation of one."""
    scaled = rows.select("row_id", "label", *[(F.col(c) / rows.agg(F.stddev_samp(c)).first()[0]).alias(c) for c in "abc"])
    x = scaled.select(F.array(*"abc").alias("x"), "label", F.lit(0.1).alias("u"))
    trials = [search.Trial("linear", 0, 0.0, l2, 0.0, 1.0) for l2 in (1e-4, 0.1)]
    fitted = search.fit_all(x, trials)
    for t in trials:
        w, b = fit_logistic(scaled, list("abc"), t.l2, max_iter=200)
        assert np.abs(fitted[t] - np.array([*w, b])).max() < 5e-3


def test_history(rows):
    out = search.shared_search(rows, ["a", "b", "c"], 24).orderBy("rank").collect()
    assert [r["rank"] for r in out] == list(range(1, 25))
    key = [(-round(r["f1"], 9), -round(r["accuracy"], 9), round(r["validation_loss"], 9), r["trial_index"]) for r in out]
    assert key == sorted(key)
    f1 = {k: max(r["f1"] for r in out if r["feature_map"] == k) for k in ("linear", "quadratic")}
    assert f1["quadratic"] > f1["linear"] > 0.5


def test_few_passes_reach_the_optimum_over_all_rows(rows, monkeypatch):
    """Fewer start rows than rows: the gradient over all of them vanishes, after a few passes."""
    monkeypatch.setattr(search, "START", 600)
    made, one = [], search._sum_over
    monkeypatch.setattr(search, "_sum_over", lambda *a: made.append(1) or one(*a))
    x = rows.select(F.array(*"abc").alias("x"), "label", hash_uniform(F.col("row_id"), 42, "share").alias("u"))
    trials = [t for t in search.space() if t.l2 in (1e-6, 1e-3) and t.feature_map != "rff"]
    fitted = search.fit_all(x, trials)
    assert len(made) <= 16
    data = x.collect()
    v, y, u = np.array([r["x"] for r in data]), np.array([r["label"] for r in data], dtype=float), np.array([r["u"] for r in data])
    for t, w in fitted.items():
        m, own = search.mapped(v, (t.feature_map, t.components, t.gamma), 42), u < t.share
        weight = np.where(y == 1, (own.sum() / 2 / (own & (y == 1)).sum()) ** t.balance, (own.sum() / 2 / (own & (y == 0)).sum()) ** t.balance) * own
        slope = m.T @ (weight * (1 / (1 + np.exp(-m @ w)) - y)) / weight.sum() + t.l2 * np.array([*w[:-1], 0.0])
        assert np.abs(slope).max() < 1e-5
