"""Rules over evidence: dataset triage, promotion gate, advice, trial leaderboards.

Evidence is long: (entity, source, metric, value). A rule fires where low <= value < high; its points are
min(cap, base + slope * value), and it blocks from ``block_from`` on. Rules are small tables, broadcast to any number of
entities."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

INF = float("inf")
RULE_SCHEMA = "rule string, source string, metric string, low double, high double, base double, slope double, cap double, block_from double, category string, action string"

# Penalties of the dataset triage.
TRIAGE_RULES = [
    ("small_dataset", "audit", "n", -INF, 20, 10, 0, INF, INF, "data", "collect more rows"),
    ("few_minority_rows", "audit", "minority", -INF, 6, 8, 0, INF, INF, "data", "collect minority rows"),
    ("imbalance", "audit", "imbalance_ratio", 4, INF, 12, 0, INF, INF, "data", "rebalance classes"),
    ("duplicates", "audit", "duplicate_rows", 1, INF, 0, 2, 12, INF, "data", "remove duplicates"),
    ("conflicts", "audit", "conflicting_rows", 1, INF, 18, 2, 28, 1, "labels", "resolve label conflicts"),
    ("constants", "audit", "constant_features", 1, INF, 0, 3, 10, INF, "features", "drop constant features"),
    ("high_correlations", "audit", "high_correlations", 1, INF, 0, 2, 8, INF, "features", "drop redundant features"),
    ("near_perfect_feature", "separability", "near_perfect", 1, INF, 12, 0, INF, 2, "leakage", "check for leakage"),
    ("all_features_weak", "separability", "all_weak", 1, INF, 14, 0, INF, INF, "features", "find better features"),
    ("no_strong_feature", "separability", "no_strong", 1, INF, 6, 0, INF, INF, "features", "find better features"),
    ("redundant_pairs", "separability", "redundant_pairs", 1, INF, 0, 2, 8, INF, "features", "drop redundant features"),
    ("contradictions", "prototype", "contradictions", 1, INF, 0, 5, 20, 2, "labels", "review contradicting rows"),
    ("isolated_rows", "prototype", "isolated", 1, INF, 0, 2.5, 10, INF, "data", "review isolated rows"),
    ("boundary_rows", "prototype", "boundary_share", 0.25, INF, 6, 0, INF, INF, "data", "review boundary rows"),
    ("very_hard_neighbourhoods", "hardness", "loo_accuracy", -INF, 0.65, 18, 0, INF, -INF, "labels", "review neighbourhoods"),
    ("hard_neighbourhoods", "hardness", "loo_accuracy", 0.65, 0.80, 8, 0, INF, INF, "labels", "review neighbourhoods"),
    ("label_issues", "hardness", "label_issues", 1, INF, 0, 5, 22, 2, "labels", "relabel suspicious rows"),
    ("hard_rows", "hardness", "hard_share", 0.20, INF, 8, 0, INF, INF, "data", "review hard rows"),
    ("ambiguous_rows", "hardness", "ambiguous_share", 0.15, INF, 6, 0, INF, INF, "data", "review ambiguous rows"),
    ("outliers", "outliers", "flagged", 1, INF, 0, 2, 12, INF, "data", "review outliers"),
    ("extreme_values", "outliers", "max_z", 6, INF, 6, 0, INF, INF, "data", "review extreme values"),
]

# Checks of the promotion gate. Verdicts of other operators come as metrics with the value 1.
GATE_RULES = [
    ("no_data", "audit", "no_data", 1, INF, 35, 0, INF, 1, "data", "load data"),
    ("no_metrics", "metrics", "no_metrics", 1, INF, 35, 0, INF, 1, "training", "evaluate a model"),
    ("tiny_dataset", "audit", "n", -INF, 12, 24, 0, INF, -INF, "data", "collect more rows"),
    ("small_dataset", "audit", "n", 12, 40, 8, 0, INF, INF, "data", "collect more rows"),
    ("few_minority_rows", "audit", "minority", -INF, 3, 24, 0, INF, -INF, "data", "collect minority rows"),
    ("imbalance", "audit", "imbalance_ratio", 4, INF, 7, 0, INF, INF, "data", "rebalance classes"),
    ("weak_model", "metrics", "worst_of_f1_and_balanced", -INF, 0.60, 28, 0, INF, -INF, "performance", "improve the model"),
    ("modest_f1", "metrics", "f1_if_not_weak", -INF, 0.75, 10, 0, INF, INF, "performance", "improve the model"),
    ("accuracy_hides_f1", "metrics", "accuracy_gap", 0.18, INF, 8, 0, INF, INF, "performance", "look beyond accuracy"),
    ("bad_calibration", "metrics", "calibration_level", 2, INF, 18, 0, INF, 2, "calibration", "recalibrate"),
    ("fair_calibration", "metrics", "calibration_level", 1, 2, 8, 0, INF, INF, "calibration", "recalibrate"),
    ("threshold_gain_unchecked", "metrics", "unchecked_threshold_gain", 0.08, INF, 7, 0, INF, INF, "threshold", "sweep thresholds"),
    ("unstable_threshold", "stability", "unstable_threshold", 1, INF, 16, 0, INF, 1, "threshold", "stabilise the threshold"),
    ("threshold_review", "stability", "threshold_review", 1, INF, 6, 0, INF, INF, "threshold", "review the threshold"),
    ("not_actionable", "capacity", "not_actionable", 1, INF, 14, 0, INF, 1, "capacity", "revise the budget"),
    ("low_capture", "capacity", "low_capture_review", 1, INF, 6, 0, INF, INF, "capacity", "revise the budget"),
    ("triage_high", "triage", "high", 1, INF, 26, 0, INF, 1, "data", "work off the triage"),
    ("triage_medium", "triage", "medium", 1, INF, 8, 0, INF, INF, "data", "work off the triage"),
    ("triage_missing", "triage", "missing", 1, INF, 6, 0, INF, INF, "data", "run the triage"),
    ("contract_high", "contract", "high", 1, INF, 18, 0, INF, 1, "contract", "repair the contract"),
    ("contract_medium", "contract", "medium", 1, INF, 7, 0, INF, INF, "contract", "review the contract"),
    ("canary_fail", "canary", "canary_fail", 1, INF, 22, 0, INF, 1, "canary", "fix failing probes"),
    ("canary_review", "canary", "canary_review", 1, INF, 7, 0, INF, INF, "canary", "review probes"),
    ("no_canaries", "canary", "no_checkable_canaries", 1, INF, 4, 0, INF, INF, "canary", "add probes"),
    ("policy_fail", "policy", "fail", 1, INF, 20, 0, INF, 1, "policy", "fix policy violations"),
    ("policy_review", "policy", "review", 1, INF, 7, 0, INF, INF, "policy", "review policy violations"),
    ("few_trials", "trials", "trials", -INF, 3, 8, 0, INF, INF, "search", "run more trials"),
    ("thin_margin", "trials", "leader_margin", -INF, 0.02, 5, 0, INF, INF, "search", "separate the leaders"),
    ("stress_collapse", "stress", "worst_f1_ratio", -INF, 0.5, 18, 0, INF, -INF, "robustness", "harden the model"),
    ("stress_loss", "stress", "worst_f1_ratio", 0.5, 0.75, 8, 0, INF, INF, "robustness", "harden the model"),
    ("confident_errors", "errors", "high_confidence_errors", 1, INF, 8, 0, INF, INF, "errors", "review confident errors"),
    ("reliability_high", "reliability", "high", 1, INF, 18, 0, INF, 1, "calibration", "recalibrate"),
    ("reliability_medium", "reliability", "medium", 1, INF, 7, 0, INF, INF, "calibration", "recalibrate"),
    ("replay_severe", "replay", "severe_ordered_degradation", 1, INF, 18, 0, INF, 1, "drift", "retrain on recent rows"),
    ("replay_review", "replay", "ordered_degradation_review", 1, INF, 7, 0, INF, INF, "drift", "watch recent rows"),
    ("no_lift", "null", "no_observed_lift", 1, INF, 16, 0, INF, 1, "validation", "find signal"),
    ("not_significant", "null", "not_significant", 1, INF, 6, 0, INF, INF, "validation", "find signal"),
    ("drift", "drift", "max_psi", 0.25, INF, 7, 0, INF, INF, "drift", "inspect drifted features"),
    ("low_selective_coverage", "selective", "recommended_coverage", -INF, 0.5, 6, 0, INF, INF, "abstention", "raise coverage"),
]

# Rules of the experiment advisor; base is the score that ranks them.
ADVICE_RULES = [
    ("no_data", "audit", "no_data", 1, INF, 100, 0, INF, INF, "data", "load data"),
    ("no_metrics", "metrics", "no_metrics", 1, INF, 90, 0, INF, INF, "training", "train a model"),
    ("low_f1", "metrics", "f1", -INF, 0.60, 86, 0, INF, INF, "model_selection", "search other models"),
    ("threshold_gain", "metrics", "threshold_gain", 0.08, INF, 76, 0, INF, INF, "thresholding", "adopt the tuned threshold"),
    ("calibration", "metrics", "calibration_level", 1, INF, 70, 0, INF, INF, "calibration", "recalibrate"),
    ("missed_positives", "metrics", "recall_lag", 0.15, INF, 66, 0, INF, INF, "thresholding", "lower the threshold"),
    ("degradation", "replay", "severe_ordered_degradation", 1, INF, 64, 0, INF, INF, "validation", "retrain on recent rows"),
    ("weak_null", "null", "weak", 1, INF, 64, 0, INF, INF, "validation", "find signal"),
    ("stress", "stress", "worst_f1_ratio", -INF, 0.80, 62, 0, INF, INF, "robustness", "harden the model"),
    ("repair_gain", "repair", "best_gain", 0.03, INF, 58, 0, INF, INF, "calibration", "apply the repair"),
    ("contradictions", "prototype", "contradictions", 1, INF, 57, 0, INF, INF, "data_quality", "review contradicting rows"),
    ("abstain", "selective", "min_error", -INF, 0.05, 52, 0, INF, INF, "abstention", "abstain on unsure rows"),
    ("outliers", "outliers", "flagged", 1, INF, 50, 0, INF, INF, "data_quality", "review outliers"),
    ("few_trials", "trials", "trials", -INF, 3, 48, 0, INF, INF, "search", "run more trials"),
    ("no_threshold_evidence", "thresholds", "missing", 1, INF, 46, 0, INF, INF, "thresholding", "sweep thresholds"),
]

# Rules on a trial history.
TRIAL_RULES = [
    ("very_few_trials", "trials", "trials", -INF, 3, 88, 0, INF, INF, "search", "run more trials"),
    ("few_trials", "trials", "trials", 3, 8, 70, 0, INF, INF, "search", "run more trials"),
    ("low_f1", "trials", "best_f1", -INF, 0.60, 84, 0, INF, INF, "performance", "change features or model"),
    ("thin_margin", "trials", "leader_margin", -INF, 0.0200000001, 76, 0, INF, INF, "performance", "separate the leaders"),
    ("one_backend", "trials", "backends", -INF, 2, 62, 0, INF, INF, "diversity", "try another backend"),
    ("one_feature_map", "trials", "feature_maps", -INF, 2, 60, 0, INF, INF, "diversity", "try another feature map"),
    ("calibration", "trials", "calibration_level", 1, INF, 58, 0, INF, INF, "calibration", "recalibrate"),
    ("accuracy_gap", "trials", "accuracy_gap", 0.18, INF, 56, 0, INF, INF, "performance", "look beyond accuracy"),
    ("family_lead", "trials", "family_lead", 0.03, INF, 54, 0, INF, INF, "search", "search around the leading family"),
]


def rules_table(spark: SparkSession, rules: Sequence[tuple]) -> DataFrame:
    rows = [(*r[:3], *map(float, r[3:9]), *r[9:]) for r in rules]
    return spark.createDataFrame(rows, RULE_SCHEMA)


def fired(evidence: DataFrame, rules: DataFrame) -> DataFrame:
    """Rules that the evidence sets off: entity, rule, category, action, value, points, blocking."""
    hit = evidence.join(F.broadcast(rules), ["source", "metric"]).where((F.col("value") >= F.col("low")) & (F.col("value") < F.col("high")))
    points = F.least("cap", F.col("base") + F.col("slope") * F.col("value"))
    return hit.select("entity", "rule", "category", "action", "value", points.alias("points"), (F.col("value") >= F.col("block_from")).alias("blocking"))


def ranked_actions(hits: DataFrame, top: int = 5) -> DataFrame:
    """Actions of each entity, one of a kind: blocking first, then points, then text."""
    best = hits.groupBy("entity", "action").agg(F.max("blocking").alias("blocking"), F.max("points").alias("points"))
    order = Window.partitionBy("entity").orderBy(F.desc("blocking"), F.desc("points"), "action")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def _totals(evidence: DataFrame, hits: DataFrame) -> DataFrame:
    per = hits.groupBy("entity").agg(F.sum("points").alias("penalty"), F.count_if("blocking").alias("blockers"), F.count_if(~F.col("blocking")).alias("cautions"))
    return evidence.select("entity").distinct().join(per, "entity", "left").na.fill(0).withColumn("score", F.greatest(F.lit(0.0), 100 - F.col("penalty")))


def triage(evidence: DataFrame, rules: DataFrame) -> DataFrame:
    """Readiness and risk of each entity's data."""
    t = _totals(evidence, fired(evidence, rules))
    risk = F.when((F.col("score") < 55) | (F.col("blockers") >= 2), "high").when((F.col("score") < 78) | (F.col("blockers") > 0), "medium").otherwise("low")
    return t.select("entity", F.col("score").alias("readiness"), "blockers", risk.alias("risk"))


def promotion_gate(evidence: DataFrame, rules: DataFrame) -> DataFrame:
    """Whether each entity's model may be promoted."""
    t = _totals(evidence, fired(evidence, rules))
    verdict = F.when((F.col("blockers") > 0) | (F.col("score") < 60), "blocked").when((F.col("cautions") > 0) | (F.col("score") < 82), "needs_review").otherwise("promotable")
    return t.select("entity", "score", "blockers", "cautions", verdict.alias("verdict"))


def recommendations(evidence: DataFrame, rules: DataFrame, top: int = 8) -> DataFrame:
    """The rules that fired, ranked by score, category and action, each category and action once; ``no_data`` stands alone."""
    hits = fired(evidence, rules)
    alone = hits.where("rule = 'no_data'").select("entity").distinct()
    hits = hits.join(alone, "entity", "left_anti").unionByName(hits.where("rule = 'no_data'"))
    best = hits.groupBy("entity", "category", "action").agg(F.max("points").alias("score"))
    order = Window.partitionBy("entity").orderBy(F.desc("score"), "category", "action")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.withColumn("priority", F.when(F.col("score") >= 76, "high").when(F.col("score") >= 54, "medium").otherwise("low"))


def leaderboard(trials: DataFrame, top: int | None = 6) -> DataFrame:
    """Trials by F1, accuracy, loss and index; ``margin``: F1 above the next. A trial history is a small table."""
    order = Window.orderBy(F.desc(F.round("f1", 9)), F.desc(F.round("accuracy", 9)), F.round("validation_loss", 9), "trial_index")
    out = trials.withColumn("rank", F.row_number().over(order)).withColumn("margin", F.col("f1") - F.lead("f1").over(order))
    return out.where(F.col("rank") <= top) if top else out


def families(trials: DataFrame) -> DataFrame:
    """Trials by backend and feature map: count, best and mean F1."""
    return trials.groupBy("backend", "feature_map").agg(F.count("*").alias("trials"), F.max("f1").alias("best_f1"), F.avg("f1").alias("mean_f1"), F.min("validation_loss").alias("best_loss"))


def trial_evidence(trials: DataFrame, entity: str = "trials") -> DataFrame:
    """A trial history as evidence for TRIAL_RULES (and the trial rules of the gate)."""
    first = leaderboard(trials, 2).agg(
        F.max(F.when(F.col("rank") == 1, F.col("f1"))).alias("best_f1"), F.max(F.when(F.col("rank") == 1, F.col("margin"))).alias("leader_margin"), F.max(F.when(F.col("rank") == 1, F.col("accuracy") - F.col("f1"))).alias("accuracy_gap"),
        F.max(F.when((F.col("rank") == 1) & ((F.col("brier_score") >= 0.22) | (F.col("ece") >= 0.08)), 1.0).otherwise(0.0)).alias("calibration_level"),
    )
    sizes = trials.agg(F.count("*").cast("double").alias("trials"), F.count_distinct("backend").cast("double").alias("backends"), F.count_distinct("feature_map").cast("double").alias("feature_maps"))
    lead = families(trials).agg(F.slice(F.sort_array(F.collect_list("best_f1"), asc=False), 1, 2).alias("b")).select(F.when(F.size("b") > 1, F.get("b", F.lit(0)) - F.get("b", F.lit(1))).alias("family_lead"))
    one = first.crossJoin(F.broadcast(sizes)).crossJoin(F.broadcast(lead))  # one row each
    names = ("best_f1", "leader_margin", "accuracy_gap", "calibration_level", "trials", "backends", "feature_maps", "family_lead")
    return one.select(F.lit(entity).alias("entity"), F.lit("trials").alias("source"), F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in names]))).where("value is not null")
