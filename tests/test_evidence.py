"""The evidence catalogue and the rules that read it."""

from __future__ import annotations

import pytest

from gaugework.operators import evidence as V
from gaugework.operators import scorecard as K
from gaugework.sources.tables import fingerprint, reusable_evidence


@pytest.mark.parametrize("rules", [K.TRIAGE_RULES, K.GATE_RULES, K.ADVICE_RULES, K.TRIAL_RULES])
def test_every_rule_fires(spark, rules):
    rows = [(r[0], r[1], r[2], V.firing_value(r)) for r in rules]
    evidence = spark.createDataFrame(rows, "entity string, source string, metric string, value double")
    hits = {(h["entity"], h["rule"]) for h in K.fired(evidence, K.rules_table(spark, rules)).collect()}
    assert {(r[0], r[0]) for r in rules} <= hits


def test_every_metric_of_the_rules_has_a_measure():
    measured = {(m.source, m.metric) for m in V.MEASURES} | set(V.MISSING.values())
    for rules in (K.TRIAGE_RULES, K.GATE_RULES, K.ADVICE_RULES):
        assert {(r[1], r[2]) for r in rules} <= measured


def test_catalogue_of_small_reports(spark):
    reports = {
        "e1_confusion": spark.createDataFrame([(10, 0.5, 0.7, 0.8, 0.4, 0.9)], "n long, f1 double, balanced_accuracy double, accuracy double, recall double, precision double"),
        "e5_calibration_error": spark.createDataFrame([(0.09,)], "ece double"),
        "e2_probability_metrics": spark.createDataFrame([(5, 0.3), (5, 0.3)], "n long, brier double"),
        "x9_policy_guard": spark.createDataFrame([("pass",), ("fail",)], "status string"),
        "n3_prototypes": spark.createDataFrame([("boundary,contradiction",), ("",), ("isolated",), ("boundary",)], "flags string"),
        "e7_threshold_gain": spark.createDataFrame([(0.1,)], "f1_gain double"),
    }
    got = {(r["source"], r["metric"]): r["value"] for r in V.catalogue(reports, "t", expected=("k1_triage", "t1_threshold_picks", "e1_confusion")).collect()}
    assert got[("metrics", "calibration_level")] == 2.0  # of two reports the worse
    assert got[("metrics", "recall_lag")] == 0.5 and got[("metrics", "f1")] == 0.5 and ("metrics", "f1_if_not_weak") not in got
    assert got[("policy", "fail")] == 1.0 and got[("policy", "review")] == 0.0
    assert got[("prototype", "boundary_share")] == 0.5 and got[("prototype", "contradictions")] == 1.0
    assert got[("triage", "missing")] == got[("thresholds", "missing")] == 1.0 and ("metrics", "no_metrics") in got and got[("metrics", "no_metrics")] == 0.0
    assert got[("metrics", "unchecked_threshold_gain")] == 0.1
    with_sweep = V.catalogue(reports | {"t1_threshold_picks": spark.createDataFrame([(1,)], "x int")}, "t")
    assert with_sweep.where("metric = 'unchecked_threshold_gain'").count() == 0


def test_stale_evidence_is_left_out(spark):
    a = spark.createDataFrame([(1, 2.0), (2, 3.0)], "row_id long, x double")
    b = a.where("row_id = 1")
    rows = spark.createDataFrame([("e", "s", "m", 1.0)], "entity string, source string, metric string, value double")
    columns = ["row_id", "x"]
    stored = V.stamped(rows, fingerprint(a, columns)).unionByName(V.stamped(rows.withColumn("value", rows["value"] + 1), fingerprint(b, columns)))
    assert [r["value"] for r in reusable_evidence(stored, fingerprint(a, columns)).collect()] == [1.0]
