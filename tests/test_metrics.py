"""Golden values of metrics and sweeps on tiny tables."""

from __future__ import annotations

import pytest

from gaugework.operators import metrics as M
from gaugework.operators import sweeps as S


def scored(spark, y, p):
    return spark.createDataFrame([(i, a, float(b)) for i, (a, b) in enumerate(zip(y, p, strict=True))], "row_id long, label int, p double")


def test_confusion_and_best_threshold(spark):
    df = scored(spark, [0, 0, 1, 1], [0.1, 0.4, 0.35, 0.8])
    best = S.optimal_threshold(df).first()
    assert best["threshold"] == 0.35 and best["f1"] == pytest.approx(0.8)
    assert M.confusion(df, 0.35).first()["balanced_accuracy"] == pytest.approx(0.75)
    assert M.threshold_gain(df, 0.35).first()["fixed_f1"] == pytest.approx(2 / 3)


def test_ranking_of_separated_scores(spark):
    one = M.ranking_metrics(scored(spark, [0, 0, 1, 1], [0.05, 0.2, 0.75, 0.95])).first()
    assert one["roc_auc"] == 1.0 and one["average_precision"] == 1.0


def test_ties_count_half_and_one_class_is_zero(spark):
    assert M.ranking_metrics(scored(spark, [0, 1], [0.5, 0.5])).first()["roc_auc"] == 0.5
    assert M.ranking_metrics(scored(spark, [1, 1], [0.2, 0.5])).first()["roc_auc"] == 0.0


def test_one_class_roc_is_the_diagonal(spark):
    points = {(r["fpr"], r["tpr"]) for r in M.roc_curve(scored(spark, [1, 1], [0.2, 0.5])).collect()}
    assert points == {(0.0, 0.0), (1.0, 1.0)}


def test_metrics_do_not_depend_on_partitions(spark):
    y, p = [i % 3 == 0 for i in range(200)], [(i * 37 % 101) / 101 for i in range(200)]
    df = scored(spark, [int(v) for v in y], p)
    a, b = (M.ranking_metrics(df.repartition(n)).first() for n in (1, 16))
    assert a["roc_auc"] == pytest.approx(b["roc_auc"], abs=1e-12)


def test_groups_equal_single_runs(spark):
    from pyspark.sql import functions as F

    df = scored(spark, [i % 2 for i in range(60)], [(i * 17 % 31) / 31 for i in range(60)]).withColumn("s", F.col("row_id") % 3)
    for r in M.ranking_metrics(df, ["s"]).collect():
        assert M.ranking_metrics(df.where(F.col("s") == r["s"])).first()["roc_auc"] == pytest.approx(r["roc_auc"])


def test_decision_curve(spark):
    df = scored(spark, [1, 0, 1, 0], [0.9, 0.8, 0.7, 0.1])
    at = next(r for r in S.decision_curve(df, 0.5).collect() if r["threshold"] == 0.5)
    assert (at["tp"], at["fp"]) == (2, 1) and at["net_benefit"] == pytest.approx(0.25) and at["delta"] == pytest.approx(0.25)


def test_threshold_picks(spark):
    picks = {r["pick"]: r for r in S.threshold_picks(S.threshold_sweep(scored(spark, [0, 1, 1, 1], [0.1, 0.2, 0.55, 0.8]), fn_cost=4.0)).collect()}
    assert picks["best_f1"]["f1"] == 1.0 and 0.1 < picks["best_f1"]["threshold"] <= 0.2
    assert 0.1 < picks["min_cost"]["threshold"] <= 0.2


def test_capacity_plan(spark):
    df = scored(spark, [1, 0, 1, 0, 0, 1], [0.95, 0.8, 0.7, 0.3, 0.2, 0.1])
    best = S.capacity_verdict(S.capacity_plan(df, (0.17, 0.34, 0.5, 1.0), 5, 3, 0.25)).first()
    assert best["k"] == 3 and best["precision"] == pytest.approx(2 / 3) and best["recall"] == pytest.approx(2 / 3)
    ties = S.capacity_plan(scored(spark, [0, 1, 0, 1], [0.5, 0.5, 0.5, 0.2]), (0.01, 0.02, 0.25, 0.5))
    assert sorted(r["k"] for r in ties.collect()) == [1, 2]


def test_selective_risk(spark):
    df = scored(spark, [1, 0, 0, 1], [0.9, 0.2, 0.55, 0.45])
    curve = S.selective_risk(df)
    points = {round(r["coverage"], 6): r for r in curve.collect()}
    assert points[1.0]["accuracy"] == 0.5 and points[0.5]["accuracy"] == 1.0


def test_empty_table(spark):
    assert M.confusion(scored(spark, [], [])).first()["f1"] == 0.0
