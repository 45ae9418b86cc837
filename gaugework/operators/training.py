"""A trained pipeline as a table of stages, and all that is told of it from one scored table."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugework.functions.columns import clip
from gaugework.operators.explain import Scorer, permutation_importance
from gaugework.operators.metrics import calibration_error, confusion, probability_metrics, ranking_metrics
from gaugework.operators.modeling import fit_logistic, fit_platt, linear_score
from gaugework.operators.neighbors import nearest
from gaugework.operators.prep import class_weights, fit_standardizer, oversample_minority, standardize, stratified_split
from gaugework.operators.sweeps import optimal_threshold
from gaugework.operators.uncertainty import aps_sweep, bootstrap_intervals, conformal_sweep
from gaugework.plans.patterns import with_totals
from gaugework.plans.scratch import materialize

STAGES = "stage string, feature_index int, feature string, first double, second double"


class Trained(NamedTuple):
    stages: DataFrame  #: a row for each number pair of a stage; written as a table, it is the model
    fitted: DataFrame  #: what the logistic regression was fitted on: row_id, label, features (standardized), weight
    scored: DataFrame  #: row_id, label, features, split, p (calibrated), written out once


def train(examples: DataFrame, features: Sequence[str], l2: float = 1e-4, seed: int = 42, oversample: float | None = None, k: int = 5) -> Trained:
    """Split .6/.2/.2 by class, standardize, fit, calibrate on the second part, choose the threshold on the third.

    Classes are weighed, or with ``oversample`` the smaller one is filled up to that share of the larger with made rows
    between its ``k`` nearest. Every part needs both classes. Features may not be null."""
    spark = examples.sparkSession
    parts = materialize(stratified_split(examples.select("row_id", "label", *features), {"train": 0.6, "calibration": 0.2, "validation": 0.2}, seed).select("row_id", "label", *features, "split"), "parts")
    own = parts.where("split = 'train'").drop("split")
    scale = fit_standardizer(own, features).orderBy("feature_index").collect()  # a row for each feature
    stages = [("standardize", r["feature_index"], r["feature"], r["mean"], r["scale"]) for r in scale]
    rows = standardize(own, spark.createDataFrame(stages, STAGES).selectExpr("feature_index", "feature", "first AS mean", "second AS scale"), features)
    if oversample is None:
        rows = with_totals(rows, class_weights(own).select("label", F.coalesce("weight", F.lit(1.0)).alias("weight")), ["label"])
    else:
        sizes = {r["label"]: r["count"] for r in class_weights(own).collect()}
        few = rows.where(F.col("label") == min(sizes, key=lambda y: (sizes[y], y)))
        near = nearest(few.select("row_id", "label", F.array(*features).alias("v")), "v", k)
        rows = oversample_minority(rows, features, near, oversample, seed).withColumn("weight", F.lit(1.0))
    fitted = materialize(rows.select("row_id", "label", *features, "weight"), "fitted")
    w, b = fit_logistic(fitted, features, l2, weight="weight")
    stages += [("weight", i, f, v, None) for i, (f, v) in enumerate(zip(features, w, strict=True))] + [("intercept", None, None, b, None)]
    raw = parts.where("split = 'calibration'").withColumn("p", _scorer(stages)(*[F.col(f) for f in features]))
    stages.append(("platt", None, None, *fit_platt(raw)))
    scored = materialize(parts.withColumn("p", _scorer(stages)(*[F.col(f) for f in features])), "scored")
    best = optimal_threshold(scored.where("split = 'validation'")).first()
    stages.append(("threshold", None, None, float(best["threshold"]), None))
    return Trained(spark.createDataFrame(stages, STAGES), fitted, scored)


def _scorer(stages: Sequence[tuple]) -> Scorer:
    """Of standardizing, weights and intercept one linear function of the raw features, then the calibration if there is one."""
    kind = lambda s: sorted((r for r in stages if r[0] == s), key=lambda r: r[1] or 0)
    scale, weights = kind("standardize"), [r[3] for r in kind("weight")]
    w = [v / s[4] for v, s in zip(weights, scale, strict=True)]
    b = kind("intercept")[0][3] - sum(v * s[3] for v, s in zip(w, scale, strict=True))
    platt = kind("platt")
    return linear_score(w, b, tuple(platt[0][3:5]) if platt else None)


def load(stages: DataFrame) -> tuple[Scorer, float]:
    """The scorer of feature columns and the threshold of a table of stages, say one that was written and read back."""
    rows = [tuple(r) for r in stages.select("stage", "feature_index", "feature", "first", "second").collect()]
    return _scorer(rows), next(r[3] for r in rows if r[0] == "threshold")


def _long(section: str, df: DataFrame, item: Column | None, metrics: Sequence[str]) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])
    return df.select(F.lit(section).alias("section"), (F.lit("all") if item is None else item.cast("string")).alias("item"), F.inline(pairs))


def outputs(trained: Trained, features: Sequence[str], replicates: int = 1000, repeats: int = 5) -> DataFrame:
    """(section, item, metric, value) of the scored table: metrics, conformal and adaptive sets by alpha, bootstrap intervals by
    metric and importances by feature, all on the validation rows at the pipeline's threshold; sets get their quantiles from the
    calibration rows."""
    scorer, t = load(trained.stages)
    cal, val = (trained.scored.where(F.col("split") == s).drop("split") for s in ("calibration", "validation"))
    sets = ("quantile", "coverage", "average_size", "singleton_rate", "both_rate", "empty_rate", "coverage_0", "coverage_1")
    metrics = with_totals(with_totals(with_totals(confusion(val, t), probability_metrics(val).drop("n")), ranking_metrics(val)), calibration_error(val))
    parts = [
        _long("metrics", metrics, None, [c for c, kind in metrics.dtypes if kind in ("double", "bigint", "int")]),
        _long("conformal", conformal_sweep(cal, val), F.col("alpha"), sets),
        _long("adaptive_sets", aps_sweep(cal, val), F.col("alpha"), sets),
        _long("intervals", bootstrap_intervals(val, replicates, threshold=t), F.col("metric"), ("low", "high", "mean")),
        _long("importances", permutation_importance(val, features, scorer, repeats, threshold=t), F.col("feature"), ("base_accuracy", "permuted_accuracy", "importance")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def logistic_slopes(rows: DataFrame, features: Sequence[str], w: Sequence[float], b: float, l2: float = 1e-4, weight: Column | None = None) -> DataFrame:
    """One row: the derivative of the mean log loss of ``label`` (a class, or a share of it) by the intercept and by each weight, 0
    at the optimum. A weight has the penalty l2 w^2 s^2 / 2, s the feature's sample deviation; both go by row weight."""
    weight = F.lit(1.0) if weight is None else weight
    error = linear_score(w, b)(*[F.col(f) for f in features]) - F.col("label")
    mean = lambda x: F.sum(weight * x) / F.sum(weight)
    variance = lambda x: (mean(x * x) - mean(x) ** 2) * F.count("*") / (F.count("*") - 1)
    return rows.agg(mean(error).alias("intercept"), *[(mean(error * F.col(f)) + l2 * v * variance(F.col(f))).alias(f) for f, v in zip(features, w, strict=True)])


def platt_slopes(scored: DataFrame, a: float, c: float) -> DataFrame:
    """One row: the derivative of the mean log loss by slope and offset of a calibration."""
    q = clip(F.col("p"), 1e-7, 1 - 1e-7)
    z = F.log(q / (1 - q))
    miss = 1 / (1 + F.exp(-(z * a + c))) - F.col("label")
    return scored.agg(F.avg(miss * z).alias("slope"), F.avg(miss).alias("offset"))


def tall(stage: str, one: DataFrame) -> DataFrame:
    """(stage, parameter, slope) of one row of slopes."""
    return one.select(F.lit(stage).alias("stage"), F.inline(F.array(*[F.struct(F.lit(n).alias("parameter"), F.col(n).alias("slope")) for n in one.columns])))


def at_optimum(slopes: DataFrame, most: float = 1e-4) -> DataFrame:
    """(claim, ok) of slopes."""
    return slopes.select(F.concat_ws(" ", F.lit("optimum"), "stage", "parameter").alias("claim"), (F.abs("slope") < most).alias("ok"))


def block_means(calibration: DataFrame, mapped: DataFrame) -> DataFrame:
    """(claim, ok) of an isotonic map of the rows (row_id, label, p) that it was fitted on: a higher score never gets less, and
    each value is the mean label of the rows that get it."""
    both = calibration.select("row_id", "label", F.col("p").alias("score")).join(mapped.select("row_id", F.round("p", 9).alias("value")), "row_id")
    blocks = both.groupBy("value").agg(F.avg("label").alias("mean"), F.min("score").alias("low"), F.max("score").alias("high"))
    rises = blocks.withColumn("_before", F.lag("high").over(Window.orderBy("value")))  # a row for each block, never more than the distinct scores
    return rises.agg(F.bool_and(F.abs(F.col("mean") - F.col("value")) < 1e-6).alias("a"), F.bool_and(F.coalesce(F.col("_before") < F.col("low"), F.lit(True))).alias("b")).select(F.inline(F.array(F.struct(F.lit("values are block means").alias("claim"), F.col("a").alias("ok")), F.struct(F.lit("values rise with scores").alias("claim"), F.col("b").alias("ok")))))


def slopes(trained: Trained, features: Sequence[str], l2: float = 1e-4) -> DataFrame:
    """(stage, parameter, slope) of the two fits of a pipeline; the calibration's penalty is too small to count."""
    rows = [tuple(r) for r in trained.stages.select("stage", "feature_index", "feature", "first", "second").collect()]
    w = {r[2]: r[3] for r in rows if r[0] == "weight"}
    b = next(r[3] for r in rows if r[0] == "intercept")
    a, c = next(r[3:5] for r in rows if r[0] == "platt")
    raw = _scorer([r for r in rows if r[0] != "platt"])(*[F.col(f) for f in features])
    fit = logistic_slopes(trained.fitted, features, [w[f] for f in features], b, l2, F.col("weight"))
    return tall("logistic", fit).unionByName(tall("platt", platt_slopes(trained.scored.where("split = 'calibration'").withColumn("p", raw), a, c)))


def checks(trained: Trained, features: Sequence[str], l2: float = 1e-4, reread: DataFrame | None = None) -> DataFrame:
    """(claim, ok): slopes of both fits under 1e-4; no threshold with a better F1; sets that cover their own calibration rows
    as often as they promise; ``reread`` stages that score as the pipeline did, to 1e-12."""
    scorer, t = load(trained.stages if reread is None else reread)
    cal, val = (trained.scored.where(F.col("split") == s).drop("split") for s in ("calibration", "validation"))
    out = at_optimum(slopes(trained, features, l2))
    best = with_totals(confusion(val, t).select("f1"), optimal_threshold(val).select(F.col("f1").alias("_best")))
    parts = [
        best.select(F.lit("threshold has the best F1").alias("claim"), (F.abs(F.col("f1") - F.col("_best")) < 1e-9).alias("ok")),
        conformal_sweep(cal, cal).select(F.concat_ws(" ", F.lit("sets cover at"), F.col("alpha").cast("string")).alias("claim"), (F.col("coverage") >= 1 - F.col("alpha") - 1e-12).alias("ok")),
        trained.scored.agg((F.max(F.abs(F.col("p") - scorer(*[F.col(f) for f in features]))) < 1e-12).alias("ok")).select(F.lit("stages reread score alike").alias("claim"), "ok"),
    ]
    for part in parts:
        out = out.unionByName(part)
    return out
