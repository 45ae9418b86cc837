"""A trained pipeline as a table of stages: its fits, its outputs against plain computation, and checks that can fail."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from gaugework.functions.columns import hash_uniform
from gaugework.operators import training as N

X = ["x1", "x2"]


@pytest.fixture(scope="module")
def examples(spark):
    rows = spark.range(400).select(F.col("id").alias("row_id"), *[(10 * hash_uniform(F.col("id"), 1, x) - i).alias(x) for i, x in enumerate(X)])
    return rows.withColumn("label", (F.col("x1") - F.col("x2") + 4 * hash_uniform(F.col("row_id"), 1, "noise") > 7).cast("int"))


@pytest.fixture(scope="module")
def trained(examples):
    return N.train(examples, X)


def plain(trained):
    rows = trained.stages.collect()
    scale = {r["feature"]: (r["first"], r["second"]) for r in rows if r["stage"] == "standardize"}
    w = {r["feature"]: r["first"] for r in rows if r["stage"] == "weight"}
    b, t = (next(r["first"] for r in rows if r["stage"] == s) for s in ("intercept", "threshold"))
    a, c = next((r["first"], r["second"]) for r in rows if r["stage"] == "platt")

    def score(row):
        z = sum(w[f] * (row[f] - scale[f][0]) / scale[f][1] for f in X) + b
        return 1 / (1 + math.exp(-(a * z + c)))

    return score, t


def test_scores_and_outputs(trained):
    score, t = plain(trained)
    scored = trained.scored.collect()
    assert len(scored) == 400 and {r["split"] for r in scored} == {"train", "calibration", "validation"}
    assert all(abs(score(r) - r["p"]) < 1e-9 for r in scored)
    out = {(r["section"], r["item"], r["metric"]): r["value"] for r in N.outputs(trained, X, replicates=50, repeats=2).collect()}
    val = [(r["p"], r["label"]) for r in scored if r["split"] == "validation"]
    assert out["metrics", "all", "accuracy"] == pytest.approx(sum((p >= t) == (y == 1) for p, y in val) / len(val))
    assert out["metrics", "all", "brier"] == pytest.approx(sum((p - y) ** 2 for p, y in val) / len(val))
    cal = sorted(1 - r["p"] if r["label"] else r["p"] for r in scored if r["split"] == "calibration")
    for alpha in (0.05, 0.1, 0.2, 0.3):
        q = cal[min(math.ceil((len(cal) + 1) * (1 - alpha)), len(cal)) - 1]
        assert out["conformal", str(alpha), "quantile"] == pytest.approx(q)
        assert out["conformal", str(alpha), "coverage"] == pytest.approx(sum((1 - p if y else p) <= q for p, y in val) / len(val))
    assert {i for s, i, _ in out if s == "importances"} == set(X) and out["importances", "x1", "importance"] > 0.05
    assert all(out["intervals", m, "low"] <= out["metrics", "all", m] <= out["intervals", m, "high"] for m in ("f1", "accuracy"))
    assert {s for s, _, _ in out} == {"metrics", "conformal", "adaptive_sets", "intervals", "importances"}


def test_checks_hold_and_can_fail(trained, tmp_path):
    path = str(tmp_path / "stages")
    trained.stages.write.parquet(path)
    back = trained.stages.sparkSession.read.parquet(path)
    assert all(r["ok"] for r in N.checks(trained, X, reread=back).collect())
    wrong = trained.stages.withColumn("first", F.when(F.col("stage") == "weight", F.col("first") * 1.1).when(F.col("stage") == "threshold", F.col("first") + 0.2).otherwise(F.col("first")))
    failed = {r["claim"] for r in N.checks(trained._replace(stages=wrong), X, reread=wrong).collect() if not r["ok"]}
    assert {"optimum logistic x1", "optimum platt slope", "threshold has the best F1", "stages reread score alike"} <= failed


def test_oversampled(examples):
    few = examples.where("label = 0 or row_id % 5 = 0")
    trained = N.train(few, X, oversample=1.0, k=3)
    sizes = {r["label"]: r["count"] for r in trained.fitted.groupBy("label").count().collect()}
    assert sizes[0] == sizes[1] and trained.fitted.where("row_id < 0 and label = 0").count() == 0
    assert all(r["ok"] for r in N.checks(trained, X).collect())


def test_block_means_and_slopes_can_fail(spark, examples):
    from gaugework.operators import modeling as M

    scored = examples.withColumn("p", F.round(F.col("x1") / 12, 1))
    mapped = M.isotonic(scored, scored)
    assert all(r["ok"] for r in N.block_means(scored, mapped).collect())
    assert not any(r["ok"] for r in N.block_means(scored, mapped.withColumn("p", 1 - F.col("p"))).collect())
    w, b = M.fit_logistic(examples, X)
    assert all(r["ok"] for r in N.at_optimum(N.tall("fit", N.logistic_slopes(examples, X, w, b))).collect())
    assert not any(r["ok"] for r in N.at_optimum(N.tall("fit", N.logistic_slopes(examples, X, w, b + 0.1))).collect())
