"""The evidence catalogue: what each report says, as (entity, source, metric, value) rows that the scorecards' rules read.

A measure is an aggregate over one report, written in plain SQL, so that a report of any size becomes one row in one pass. Evidence
carries the fingerprint of the table that it was made of; what does not fit the current table is left out before rules see it."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugework.operators.scorecard import INF


class Measure(NamedTuple):
    source: str
    metric: str
    report: str
    value: str  #: an aggregate; null is no evidence
    unless: str = ""  #: counts only where this report is not there


def _share(flag: str) -> str:
    return f"avg(CASE WHEN flags LIKE '%{flag}%' THEN 1.0 ELSE 0.0 END)"


def _count(flag: str) -> str:
    return f"sum(CASE WHEN flags LIKE '%{flag}%' THEN 1.0 ELSE 0.0 END)"


def _is(column: str, *values: str) -> str:
    return f"max(CASE WHEN {column} IN ({', '.join(repr(v) for v in values)}) THEN 1.0 ELSE 0.0 END)"


def _level(column: str, fair: float, bad: float) -> str:
    return f"CASE WHEN {column} >= {bad} THEN 2.0 WHEN {column} >= {fair} THEN 1.0 ELSE 0.0 END"


#: The metrics that the rules of triage, gate and advice read, and where each comes from.
MEASURES = [
    Measure("audit", "n", "a6_audit", "max(n)"),
    Measure("audit", "no_data", "a6_audit", "CASE WHEN max(n) > 0 THEN 0.0 ELSE 1.0 END"),
    Measure("audit", "minority", "a6_audit", "max(least(n0, n1))"),
    Measure("audit", "imbalance_ratio", "a6_audit", "max(imbalance_ratio)"),
    Measure("audit", "duplicate_rows", "a6_audit", "max(duplicate_rows)"),
    Measure("audit", "conflicting_rows", "a6_audit", "max(greatest(conflict_groups, conflicting_rows))"),
    Measure("audit", "constant_features", "a6_audit", "max(constant_features)"),
    Measure("audit", "high_correlations", "a6_audit", "max(high_correlations)"),
    Measure("separability", "near_perfect", "a10_separability", _count("near_perfect")),
    Measure("separability", "all_weak", "a10_separability", f"CASE WHEN {_count('weak')} = count(*) THEN 1.0 ELSE 0.0 END"),
    Measure("separability", "no_strong", "a10_separability", f"CASE WHEN {_count('weak')} < count(*) AND {_count('strong')} + {_count('near_perfect')} = 0 THEN 1.0 ELSE 0.0 END"),
    Measure("separability", "redundant_pairs", "a11_redundant_pairs", "sum(CASE WHEN abs(correlation) >= 0.92 THEN 1.0 ELSE 0.0 END)"),
    Measure("prototype", "contradictions", "n3_prototypes", _count("contradiction")),
    Measure("prototype", "isolated", "n3_prototypes", _count("isolated")),
    Measure("prototype", "boundary_share", "n3_prototypes", _share("boundary")),
    Measure("hardness", "loo_accuracy", "n2_hardness", "avg(CASE WHEN predicted = label THEN 1.0 ELSE 0.0 END)"),
    Measure("hardness", "label_issues", "n2_hardness", _count("label_issue_candidate")),
    Measure("hardness", "hard_share", "n2_hardness", _share("hard_row")),
    Measure("hardness", "ambiguous_share", "n2_hardness", _share("ambiguous")),
    Measure("outliers", "flagged", "n4_outliers", _count("ood")),
    Measure("outliers", "max_z", "n4_outliers", "max(max_z)"),
    Measure("metrics", "no_metrics", "e1_confusion", "CASE WHEN max(n) > 0 THEN 0.0 ELSE 1.0 END"),
    Measure("metrics", "f1", "e1_confusion", "max(f1)"),
    Measure("metrics", "worst_of_f1_and_balanced", "e1_confusion", "max(least(f1, balanced_accuracy))"),
    Measure("metrics", "f1_if_not_weak", "e1_confusion", "max(CASE WHEN least(f1, balanced_accuracy) >= 0.6 THEN f1 END)"),
    Measure("metrics", "accuracy_gap", "e1_confusion", "max(accuracy - f1)"),
    Measure("metrics", "recall_lag", "e1_confusion", "max(CASE WHEN recall < 0.55 THEN precision - recall END)"),
    Measure("metrics", "calibration_level", "e5_calibration_error", _level("max(ece)", 0.08, 0.12)),
    Measure("metrics", "calibration_level", "e2_probability_metrics", _level("sum(n * brier) / sum(n)", 0.22, 0.28)),
    Measure("metrics", "threshold_gain", "e7_threshold_gain", "max(f1_gain)"),
    Measure("metrics", "unchecked_threshold_gain", "e7_threshold_gain", "max(f1_gain)", "t1_threshold_picks"),
    Measure("thresholds", "picks", "t1_threshold_picks", "count(*)"),
    Measure("stability", "unstable_threshold", "t7_threshold_stability", _is("verdict", "unstable_threshold")),
    Measure("stability", "threshold_review", "t7_threshold_stability", _is("verdict", "threshold_review")),
    Measure("capacity", "not_actionable", "t4_capacity_verdict", _is("verdict", "not_actionable", "no_positive_evidence")),
    Measure("capacity", "low_capture_review", "t4_capacity_verdict", _is("verdict", "low_capture_review")),
    Measure("triage", "high", "k1_triage", _is("risk", "high")),
    Measure("triage", "medium", "k1_triage", _is("risk", "medium")),
    Measure("contract", "high", "a8_contract_readiness", _is("risk", "high")),
    Measure("contract", "medium", "a8_contract_readiness", _is("risk", "medium")),
    Measure("canary", "canary_fail", "x8_canary_summary", _is("verdict", "canary_fail")),
    Measure("canary", "canary_review", "x8_canary_summary", _is("verdict", "canary_review")),
    Measure("canary", "no_checkable_canaries", "x8_canary_summary", _is("verdict", "no_checkable_canaries")),
    Measure("policy", "fail", "x9_policy_guard", _is("status", "fail")),
    Measure("policy", "review", "x9_policy_guard", _is("status", "review")),
    Measure("trials", "trials", "m12_families", "sum(trials)"),
    Measure("trials", "leader_margin", "m12_leaderboard", "max(CASE WHEN rank = 1 THEN margin END)"),
    Measure("stress", "worst_f1_ratio", "x5_stress", "min(f1_ratio)"),
    Measure("errors", "high_confidence_errors", "g4_error_summary", "sum(high_confidence_errors)"),
    Measure("reliability", "high", "e10_reliability_atlas", _is("risk", "high")),
    Measure("reliability", "medium", "e10_reliability_atlas", _is("risk", "medium")),
    Measure("replay", "severe_ordered_degradation", "d4_replay_verdict", _is("verdict", "severe_ordered_degradation")),
    Measure("replay", "ordered_degradation_review", "d4_replay_verdict", _is("verdict", "ordered_degradation_review")),
    Measure("null", "no_observed_lift", "b2_permutation_null", _is("verdict", "no_observed_lift")),
    Measure("null", "not_significant", "b2_permutation_null", _is("verdict", "not_significant")),
    Measure("null", "weak", "b2_permutation_null", _is("verdict", "weak_signal", "not_significant", "no_observed_lift")),
    Measure("drift", "max_psi", "d1_population_drift", "max(psi)"),
    Measure("selective", "recommended_coverage", "t6_selective_targets", "max(CASE WHEN target = 0.05 THEN coalesce(coverage, 0.0) END)"),
    Measure("selective", "min_error", "t6_selective_area", "max(min_error)"),
    Measure("repair", "best_gain", "c1_c2_calibration_repair", "max(greatest(brier_gain, ece_gain))"),
]

#: Reports whose absence is itself evidence, as (source, metric) with the value 1.
MISSING = {"k1_triage": ("triage", "missing"), "t1_threshold_picks": ("thresholds", "missing"), "a6_audit": ("audit", "no_data"), "e1_confusion": ("metrics", "no_metrics")}


def needed(rules: Sequence[tuple], measures: Sequence[Measure] = MEASURES) -> list[Measure]:
    """The measures that a rule table reads."""
    read = {(r[1], r[2]) for r in rules}
    return [m for m in measures if (m.source, m.metric) in read]


def catalogue(reports: Mapping[str, DataFrame], entity: str, measures: Sequence[Measure] = MEASURES, expected: Sequence[str] = ()) -> DataFrame:
    """(entity, source, metric, value): the measures of the reports that are there, and for the ``expected`` ones that are not, that they
    are missing. Where several reports say the same metric, the largest value counts. An empty report measures as its
    aggregates do; null values are no evidence."""
    parts: list[DataFrame] = []
    for name, report in reports.items():
        own = [m for m in measures if m.report == name and (not m.unless or m.unless not in reports)]
        if own:
            one = report.selectExpr(*[f"CAST({m.value} AS DOUBLE) AS _{i}" for i, m in enumerate(own)])
            rows = [F.struct(F.lit(m.source).alias("source"), F.lit(m.metric).alias("metric"), F.col(f"_{i}").alias("value")) for i, m in enumerate(own)]
            parts.append(one.select(F.inline(F.array(*rows))))
    lacking = [MISSING[r] for r in expected if r in MISSING and r not in reports]
    if lacking:
        spark = next(iter(reports.values())).sparkSession
        parts.append(spark.createDataFrame([(s, m, 1.0) for s, m in lacking], "source string, metric string, value double"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where("value is not null").groupBy("source", "metric").agg(F.max("value").alias("value")).select(F.lit(entity).alias("entity"), "source", "metric", "value")


def stamped(evidence: DataFrame, fingerprint: DataFrame) -> DataFrame:
    """Evidence with the fingerprint (rows, hash_sum, hash_xor; one row) of the table that it was made of."""
    return evidence.crossJoin(F.broadcast(fingerprint.select("rows", "hash_sum", "hash_xor")))  # one row


def firing_value(rule: tuple) -> float:
    """A value that sets the rule off."""
    low, high = float(rule[3]), float(rule[4])
    return low if low > -INF else (high - 1 if high < INF else 0.0)
