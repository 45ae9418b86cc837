"""Evaluation of scored rows (label, p): confusion, ranking and calibration metrics. All take ``by`` for groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugework.functions.columns import clip, ratio, with_rates
from gaugework.plans.patterns import score_steps, with_totals
from gaugework.plans.selection import quantiles


def confusion_aggs(threshold: float | Column = 0.5, weight: Column | None = None) -> list[Column]:
    """tp, fp, tn, fn at ``p >= threshold``."""
    w = F.lit(1) if weight is None else weight
    hit, y = F.col("p") >= threshold, F.col("label") == 1
    cells = {"tp": hit & y, "fp": hit & ~y, "tn": ~hit & ~y, "fn": ~hit & y}
    return [F.coalesce(F.sum(F.when(c, w).otherwise(0)), F.lit(0)).cast("long").alias(k) for k, c in cells.items()]


def confusion(scored: DataFrame, threshold: float = 0.5, by: Sequence[str] = ()) -> DataFrame:
    """Confusion counts and rates at a threshold, zeros for an empty input."""
    return with_rates(scored.groupBy(*by).agg(F.count("*").alias("n"), *confusion_aggs(threshold)))


def probability_aggs() -> list[Column]:
    p, y = F.col("p"), F.col("label")
    q = clip(p, 1e-7, 1 - 1e-7)
    return [
        F.avg((p - y) ** 2).alias("brier"), F.avg(-(y * F.log(q) + (1 - y) * F.log(1 - q))).alias("log_loss"), F.avg("p").alias("mean_p"),
        F.avg(y.cast("double")).alias("prevalence"), F.avg((p >= 0.5).cast("double")).alias("predicted_positive_rate"),
    ]


def probability_metrics(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Brier score, log loss, means and the share of scores of at least 0.5."""
    return scored.groupBy(*by).agg(F.count("*").alias("n"), *probability_aggs())


def ranking_metrics(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """ROC-AUC (half credit for ties) and average precision (a tie is one step), 0 where a class is missing."""
    steps = score_steps(scored, by)
    below = F.col("n_neg") - F.col("fp")
    area = F.sum(F.col("pos") * (below + 0.5 * F.col("neg")))
    ap = F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp")))
    return steps.groupBy(*by).agg(ratio(area, F.max("n_pos") * F.max("n_neg")).alias("roc_auc"), ratio(ap, F.max("n_pos")).alias("average_precision"))


def calibration_bins(scored: DataFrame, n_bins: int = 10, by: Sequence[str] = ()) -> DataFrame:
    """Non-empty equal-width bins of p, the last closed on the right: ``bin``, ``count``, ``confidence``, ``accuracy``, ``weight``."""
    bins = scored.groupBy(*by, F.least(F.floor(F.col("p") * n_bins), F.lit(n_bins - 1)).cast("int").alias("bin"))
    bins = bins.agg(F.count("*").alias("count"), F.avg("p").alias("confidence"), F.avg(F.col("label").cast("double")).alias("accuracy"))
    return bins.withColumn("weight", F.col("count") / F.sum("count").over(Window.partitionBy(*by)))


def calibration_error(scored: DataFrame, n_bins: int = 10, by: Sequence[str] = ()) -> DataFrame:
    """Expected and largest calibration error over the bins."""
    gap = F.abs(F.col("accuracy") - F.col("confidence"))
    return calibration_bins(scored, n_bins, by).groupBy(*by).agg(F.sum(F.col("weight") * gap).alias("ece"), F.max(gap).alias("max_error"), F.count("*").alias("bins"))


def class_quantiles(scored: DataFrame, at: Sequence[float] = (0.0, 0.25, 0.5, 0.75, 1.0), by: Sequence[str] = ()) -> DataFrame:
    """Interpolated quantiles of p for each label."""
    q = quantiles(scored, "p", at, [*by, "label"], few=not by)
    return q.select(*by, "label", *[F.get("q", F.lit(i)).alias(f"q{round(100 * a)}") for i, a in enumerate(at)])


def threshold_gain(scored: DataFrame, tuned: float, by: Sequence[str] = ()) -> DataFrame:
    """Rates at 0.5 and at a tuned threshold, and the gain in F1 and accuracy."""
    both = scored.groupBy(*by).agg(*[c.alias(f"{n}_{i}") for i, t in enumerate((0.5, tuned)) for n, c in zip(("tp", "fp", "tn", "fn"), confusion_aggs(t), strict=True)])
    for i, name in enumerate(("fixed", "tuned")):
        part = with_rates(both.withColumnsRenamed({f"{n}_{i}": n for n in ("tp", "fp", "tn", "fn")}))
        both = part.withColumnsRenamed({"f1": f"{name}_f1", "accuracy": f"{name}_accuracy"}).drop("tp", "fp", "tn", "fn", "precision", "recall", "balanced_accuracy")
    return both.withColumn("f1_gain", F.col("tuned_f1") - F.col("fixed_f1")).withColumn("accuracy_gain", F.col("tuned_accuracy") - F.col("fixed_accuracy"))


def roc_curve(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """A point for each distinct score, and the origin just above the largest; the diagonal where a class is missing."""
    steps = score_steps(scored, by)
    one_class = (F.col("n_pos") == 0) | (F.col("n_neg") == 0)
    top = steps.groupBy(*by).agg(F.max("t").alias("t"), F.max("n_pos").alias("n_pos"), F.max("n_neg").alias("n_neg"))
    diagonal = top.where(one_class).select(*by, F.inline(F.array(*[F.struct(F.lit(v).alias("threshold"), F.lit(1 - v).alias("tpr"), F.lit(1 - v).alias("fpr")) for v in (1.0, 0.0)])))
    origin = top.where(~one_class).select(*by, (F.col("t") + 1e-5).alias("threshold"), F.lit(0.0).alias("tpr"), F.lit(0.0).alias("fpr"))
    points = steps.where(~one_class).select(*by, F.col("t").alias("threshold"), (F.col("tp") / F.col("n_pos")).alias("tpr"), (F.col("fp") / F.col("n_neg")).alias("fpr"))
    return points.unionByName(origin).unionByName(diagonal)


def pr_curve(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """A point for each distinct score, and (recall 1, precision = prevalence); two fixed points without positives."""
    steps = score_steps(scored, by)
    top = steps.groupBy(*by).agg(F.max("n_pos").alias("n_pos"), F.max("n_neg").alias("n_neg"))
    point = lambda t, r, p: F.struct(F.lit(t).alias("threshold"), F.lit(r).alias("recall"), F.lit(p).alias("precision"))
    none = top.where("n_pos = 0").select(*by, F.inline(F.array(point(1.0, 0.0, 1.0), point(0.0, 1.0, 0.0))))
    last = top.where("n_pos > 0").select(*by, F.lit(0.0).alias("threshold"), F.lit(1.0).alias("recall"), (F.col("n_pos") / (F.col("n_pos") + F.col("n_neg"))).alias("precision"))
    points = steps.where("n_pos > 0").select(*by, F.col("t").alias("threshold"), (F.col("tp") / F.col("n_pos")).alias("recall"), ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"))
    return points.unionByName(last).unionByName(none)


def reliability_atlas(scored: DataFrame, n_bins: int = 10, min_count: int = 2, by: Sequence[str] = ()) -> DataFrame:
    """Calibration bins with signed error, direction, sparsity and rank by weighted error, and the group's risk level."""
    bins = calibration_bins(scored, n_bins, by).withColumn("signed_error", F.col("accuracy") - F.col("confidence"))
    bins = bins.withColumn("weighted_error", F.col("weight") * F.abs("signed_error")).withColumn("sparse", F.col("count") < min_count)
    bins = bins.withColumn("direction", F.when(F.col("signed_error") > 0.02, "underconfident").when(F.col("signed_error") < -0.02, "overconfident").otherwise("aligned"))
    bins = bins.withColumn("impact_rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("weighted_error"), "bin")))
    total = bins.groupBy(*by).agg(F.sum("weighted_error").alias("ece"), F.max(F.abs("signed_error")).alias("max_error"), F.bool_or("sparse").alias("_sparse"))
    risk = F.when((F.col("ece") >= 0.12) | (F.col("max_error") >= 0.35), "high").when((F.col("ece") >= 0.08) | (F.col("max_error") >= 0.25) | F.col("_sparse"), "medium").otherwise("low")
    return with_totals(bins, total.withColumn("risk", risk).drop("_sparse"), by)
