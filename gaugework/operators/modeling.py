"""Training, scoring and comparing classifiers with Spark ML."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression, LinearRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugework.functions.columns import clip, flags, hash_uniform, sigmoid, with_rates
from gaugework.operators.explain import permutation_drivers, permutation_reliance
from gaugework.operators.metrics import calibration_error, confusion, confusion_aggs, probability_aggs, ranking_metrics
from gaugework.operators.prep import calibration_split, class_weights, folds, order_split, quadratic, stratified_split
from gaugework.operators.sweeps import optimal_threshold
from gaugework.plans.patterns import with_totals
from gaugework.plans.scratch import materialize

# Splits and folds rank all rows. Each is written out once, because a fit and every report of it read the rows anew.


def linear_score(weights: Sequence[float], bias: float, calibration: tuple[float, float] | None = None):
    """A scorer of feature columns: sigmoid(w x + b), optionally calibrated by sigmoid(a z + c) of the logit z."""

    def scorer(*x: Column) -> Column:
        z = sum((c * float(w) for c, w in zip(x, weights, strict=True)), F.lit(float(bias)))
        return sigmoid(z) if calibration is None else sigmoid(clip(z, -40.0, 40.0) * calibration[0] + calibration[1])

    return scorer


def fit_logistic(examples: DataFrame, features: Sequence[str], l2: float = 1e-4, l1: float = 0.0, weight: str | None = None, max_iter: int = 50):
    """A logistic regression by Spark ML; returns the weights and the bias. A sum of gradients meets at the driver in each
    iteration, no rows."""
    data = VectorAssembler(inputCols=list(features), outputCol="_x").transform(examples)
    reg = l1 + l2
    model = LogisticRegression(featuresCol="_x", labelCol="label", regParam=reg, elasticNetParam=l1 / reg if reg else 0.0, maxIter=max_iter, **({"weightCol": weight} if weight else {})).fit(data)
    return [float(w) for w in model.coefficients], float(model.intercept)


def fit_platt(scored: DataFrame) -> tuple[float, float]:
    """Slope and intercept of a logistic regression of the label on the logit of p (the optimum, not a fixed number of steps)."""
    q = clip(F.col("p"), 1e-7, 1 - 1e-7)
    (a,), b = fit_logistic(scored.select("label", F.log(q / (1 - q)).alias("z")), ["z"], 1e-9)
    return a, b


def platt(p: Column, a: float, b: float) -> Column:
    q = clip(p, 1e-7, 1 - 1e-7)
    return sigmoid(F.log(q / (1 - q)) * a + b)


def isotonic(calibration: DataFrame, rows: DataFrame) -> DataFrame:
    """``rows`` with p mapped by an isotonic regression fitted on the calibration rows, kept in [0, 1]."""
    from pyspark.ml.functions import array_to_vector

    vec = lambda d: d.withColumn("_v", array_to_vector(F.array("p")))
    model = IsotonicRegression(featuresCol="_v", labelCol="label", predictionCol="_q").fit(vec(calibration.withColumn("label", F.col("label").cast("double"))))
    return model.transform(vec(rows)).withColumn("p", clip(F.col("_q"), 0.0, 1.0)).drop("_v", "_q")


def calibration_repair(scored: DataFrame, fraction: float = 0.5, n_bins: int = 10, seed: int = 42) -> DataFrame:
    """Raw, Platt and isotonic scores compared on held-out rows; ``best`` marks the smallest Brier score, then ECE, then log loss."""
    sided = materialize(calibration_split(scored.select("row_id", "label", "p"), fraction, seed).drop("split_source"), "sided")
    cal, held = sided.where("side = 'calibration'").drop("side"), sided.where("side = 'evaluation'").drop("side")
    a, b = fit_platt(cal)
    methods = {"raw": held, "platt": held.withColumn("p", platt(F.col("p"), a, b)), "isotonic": isotonic(cal, held)}
    out = None
    methods["isotonic"] = materialize(methods["isotonic"], "isotonic")
    for name, rows in methods.items():
        one = with_totals(rows.agg(*probability_aggs()).select("brier", "log_loss"), calibration_error(rows, n_bins).select("ece", "max_error")).withColumn("method", F.lit(name))
        out = one if out is None else out.unionByName(one)
    raw = out.where("method = 'raw'").select(F.col("brier").alias("_b"), F.col("ece").alias("_e"))
    out = with_totals(out, raw).withColumn("brier_gain", F.col("_b") - F.col("brier")).withColumn("ece_gain", F.col("_e") - F.col("ece")).drop("_b", "_e")
    best = F.row_number().over(Window.orderBy(F.round("brier", 9), F.round("ece", 9), "log_loss")) == 1  # three rows
    return out.withColumn("best", best)


def train_pipeline(examples: DataFrame, features: Sequence[str], l2: float = 1e-4, seed: int = 42) -> tuple[object, DataFrame]:
    """Split .6/.2/.2, weigh classes, fit, calibrate, pick the threshold on validation. Returns the scorer and one row of
    validation metrics with threshold and calibration."""
    parts = materialize(stratified_split(examples.select("row_id", "label", *features), {"train": 0.6, "calibration": 0.2, "validation": 0.2}, seed), "parts")
    train = parts.where("split = 'train'")
    weighted = train.join(F.broadcast(class_weights(train).select("label", F.coalesce("weight", F.lit(1.0)).alias("weight"))), "label")
    w, b = fit_logistic(weighted, features, l2, weight="weight")
    x = [F.col(f) for f in features]
    a, c = fit_platt(parts.where("split = 'calibration'").withColumn("p", linear_score(w, b)(*x)))
    scorer = linear_score(w, b, (a, c))
    val = materialize(parts.where("split = 'validation'").withColumn("p", scorer(*x)), "val")
    best = optimal_threshold(val).first()
    t = float(best["threshold"]) if best else 0.5
    metrics = with_totals(confusion(val, t), val.agg(*probability_aggs()))
    metrics = with_totals(metrics, ranking_metrics(val))
    return scorer, metrics.withColumn("threshold", F.lit(t)).withColumn("platt_a", F.lit(a)).withColumn("platt_b", F.lit(c))


def cross_validate(examples: DataFrame, features: Sequence[str], k: int = 5, l2: float = 1e-4, seed: int = 42) -> DataFrame:
    """Metrics of each fold's model on the fold."""
    dealt = materialize(folds(examples.select("row_id", "label", *features), k, seed), "dealt")
    p = F.lit(None).cast("double")
    for i in range(k):
        w, b = fit_logistic(dealt.where(F.col("fold") != i), features, l2)
        p = F.when(F.col("fold") == i, linear_score(w, b)(*[F.col(f) for f in features])).otherwise(p)
    out = materialize(dealt.select("row_id", "label", "fold", p.alias("p")), "scored")
    return with_totals(with_rates(out.groupBy("fold").agg(F.count("*").alias("n"), *confusion_aggs(0.5), *probability_aggs())), ranking_metrics(out, ["fold"]), ["fold"])


def cross_validation_summary(per_fold: DataFrame, metrics: Sequence[str] = ("f1", "accuracy", "brier", "roc_auc")) -> DataFrame:
    rows = [F.struct(F.lit(m).alias("metric"), F.col(f"{m}_mean").alias("mean"), F.col(f"{m}_std").alias("std")) for m in metrics]
    return per_fold.agg(*[F.avg(m).alias(f"{m}_mean") for m in metrics], *[F.stddev_pop(m).alias(f"{m}_std") for m in metrics]).select(F.inline(F.array(*rows)))


def random_search(examples: DataFrame, features: Sequence[str], trials: int = 6, seed: int = 42) -> DataFrame:
    """Trials over a grid of regularisation, penalty mix and feature map, drawn without repeats, with validation metrics.

    Columns as a trial history: trial_index, backend, feature_map, l1, l2, threshold, f1, accuracy, validation_loss,
    brier_score, ece."""
    import hashlib

    grid = [(fm, l2, l1) for fm in ("linear", "quadratic") for l2 in (1e-5, 1e-4, 1e-3, 1e-2) for l1 in (0.0, 1e-4, 1e-3)]
    grid.sort(key=lambda g: hashlib.md5(f"{seed}:{g}".encode()).hexdigest())
    parts = materialize(stratified_split(examples.select("row_id", "label", *features), {"train": 0.7, "validation": 0.3}, seed), "parts")
    out = None
    for i, (fm, l2, l1) in enumerate(grid[:trials]):
        maps = quadratic(features) if fm == "quadratic" else {f: F.col(f) for f in features}
        data = parts.select("row_id", "label", "split", *[c.alias(n) for n, c in maps.items()])
        w, b = fit_logistic(data.where("split = 'train'"), list(maps), l2, l1)
        val = materialize(data.where("split = 'validation'").select("row_id", "label", linear_score(w, b)(*[F.col(n) for n in maps]).alias("p")), "val")
        t = optimal_threshold(val).select(F.col("threshold").alias("_t"))
        row = with_totals(val, t).agg(F.max("_t").alias("threshold"), *confusion_aggs(F.col("_t")), *probability_aggs())
        row = with_totals(with_rates(row), calibration_error(val).select("ece"))
        row = row.select(F.lit(i).alias("trial_index"), F.lit("logistic").alias("backend"), F.lit(fm).alias("feature_map"), F.lit(l1).alias("l1"), F.lit(l2).alias("l2"), "threshold", "f1", "accuracy", F.col("log_loss").alias("validation_loss"), F.col("brier").alias("brier_score"), "ece")
        out = row if out is None else out.unionByName(row)
    return out


def model_queue(examples: DataFrame, features: Sequence[str], families: Sequence[str] = ("logistic", "forest", "boosted"), seed: int = 42) -> DataFrame:
    """Each model family fitted on the same rows and judged on the same others, one row each, at its best F1's threshold.

    ``rank`` orders by F1, then accuracy, then the smaller log loss; ``best`` marks the first. Rows stay on the executors:
    Spark ML gathers gradients or histograms."""
    made = {
        "logistic": lambda: LogisticRegression(featuresCol="_x", labelCol="label", regParam=1e-4, maxIter=50),
        "forest": lambda: RandomForestClassifier(featuresCol="_x", labelCol="label", numTrees=40, maxDepth=6, seed=seed),
        "boosted": lambda: GBTClassifier(featuresCol="_x", labelCol="label", maxIter=20, maxDepth=4, seed=seed),
    }
    parts = materialize(stratified_split(examples.select("row_id", "label", *features), {"train": 0.7, "validation": 0.3}, seed), "parts")
    parts = VectorAssembler(inputCols=list(features), outputCol="_x").transform(parts)
    out = None
    for family in families:
        model = made[family]().fit(parts.where("split = 'train'"))
        val = materialize(model.transform(parts.where("split = 'validation'")).select("row_id", "label", F.round(vector_to_array("probability")[1], 9).alias("p")), "val")
        t = optimal_threshold(val).select(F.col("threshold").alias("_t"))
        row = with_rates(with_totals(val, t).agg(F.lit(family).alias("family"), F.count("*").alias("n"), F.max("_t").alias("threshold"), *confusion_aggs(F.col("_t")), *probability_aggs()))
        row = with_totals(row, ranking_metrics(val)).drop("mean_p", "prevalence", "predicted_positive_rate")
        out = row if out is None else out.unionByName(row)
    order = Window.orderBy(F.round("f1", 9).desc(), F.round("accuracy", 9).desc(), F.round("log_loss", 9), "family")  # a row a family
    return out.withColumn("rank", F.row_number().over(order)).withColumn("best", F.col("rank") == 1)


def learning_curve(examples: DataFrame, features: Sequence[str], fractions: Sequence[float] = (0.1, 0.25, 0.5, 1.0), seed: int = 42) -> DataFrame:
    """Holdout F1 by share of training rows; the shares are nested (a row's hash decides)."""
    parts = materialize(stratified_split(examples.select("row_id", "label", *features), {"train": 0.7, "validation": 0.3}, seed), "parts")
    train, val = parts.where("split = 'train'"), parts.where("split = 'validation'")
    u = hash_uniform(F.col("row_id"), seed, "curve")
    out = None
    for f in fractions:
        w, b = fit_logistic(train.where(u < f), features)
        row = with_rates(val.withColumn("p", linear_score(w, b)(*[F.col(x) for x in features])).agg(F.lit(float(f)).alias("fraction"), *confusion_aggs(0.5))).select("fraction", "f1", "accuracy")
        out = row if out is None else out.unionByName(row)
    return out


def committee(examples: DataFrame, features: Sequence[str], members: int = 12, share: float = 0.8, seed: int = 42) -> DataFrame:
    """Scores of models that each saw another hashed share of the rows: (row_id, label, model, p)."""
    out = examples.select("row_id", "label", *features)
    cells = []
    for m in range(members):
        w, b = fit_logistic(examples.where(hash_uniform(F.col("row_id"), seed, f"member{m}") < share), features)
        cells.append(F.struct(F.lit(f"m{m}").alias("model"), linear_score(w, b)(*[F.col(f) for f in features]).alias("p")))
    return out.select("row_id", "label", F.inline(F.array(*cells)))


def committee_stability(scores: DataFrame, threshold: float = 0.5) -> DataFrame:
    """How much the members of a committee differ on each row, and how unstable its decision is."""
    t = threshold
    s = scores.groupBy("row_id", "label").agg(F.avg("p").alias("mean_p"), F.stddev_pop("p").alias("std_p"), F.avg((F.col("p") >= t).cast("double")).alias("vote"))
    s = s.withColumn("disagreement", F.least("vote", 1 - F.col("vote"))).withColumn("boundary", clip(1 - F.abs(F.col("mean_p") - t) / max(t, 1 - t), 0.0, 1.0))
    s = s.withColumn("instability", 0.4 * clip(F.col("std_p") / 0.25, 0.0, 1.0) + 0.35 * clip(F.col("disagreement") / 0.5, 0.0, 1.0) + 0.25 * F.col("boundary"))
    return s.withColumn("flags", flags(
        unstable=F.col("instability") >= 0.5, disagreement=F.col("disagreement") >= 0.25, high_variance=F.col("std_p") >= 0.15, near_boundary=F.col("boundary") >= 0.85, wrong=(F.col("mean_p") >= t) != (F.col("label") == 1),
    ))


def fuse(members: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Fusions of member scores (row_id, model, p, weight): mean, median, vote, weighted mean, disagreement."""
    w = F.greatest("weight", F.lit(1e-6))
    return members.groupBy("row_id").agg(
        F.count("*").alias("models"), F.avg("p").alias("mean_p"), F.percentile("p", F.lit(0.5)).alias("median_p"), F.avg((F.col("p") >= threshold).cast("double")).alias("vote"), (F.sum(w * F.col("p")) / F.sum(w)).alias("weighted_p"), F.stddev_pop("p").alias("disagreement"),
    )


def stack_weights(members: DataFrame, ridge: float = 1e-3) -> DataFrame:
    """Ridge regression with intercept of the label on member scores: rows (model, weight), the intercept as model ``intercept``."""
    models = sorted(r["model"] for r in members.select("model").distinct().collect())  # one for each model
    wide = members.groupBy("row_id").pivot("model", models).agg(F.first("p")).join(members.groupBy("row_id").agg(F.max("label").cast("double").alias("label")), "row_id")
    data = VectorAssembler(inputCols=models, outputCol="_x").transform(wide)
    fit = LinearRegression(featuresCol="_x", labelCol="label", regParam=ridge, solver="normal").fit(data)
    return members.sparkSession.createDataFrame([*zip(models, map(float, fit.coefficients), strict=True), ("intercept", float(fit.intercept))], "model string, weight double")


def stacked(members: DataFrame, weights: DataFrame) -> DataFrame:
    """Linear stack of member scores with intercept, kept in [0, 1]."""
    own = weights.where("model <> 'intercept'").withColumnRenamed("weight", "_w")
    base = weights.where("model = 'intercept'").select(F.col("weight").alias("_b"))
    s = members.select("row_id", "label", "model", "p").join(F.broadcast(own), "model").groupBy("row_id", "label").agg(F.sum(F.col("p") * F.col("_w")).alias("_s"))
    return with_totals(s, base).select("row_id", "label", clip(F.col("_s") + F.col("_b"), 0.0, 1.0).alias("p"))


def distill(examples: DataFrame, features: Sequence[str], teacher: Column, alpha: float = 0.5) -> tuple[list[float], float]:
    """A student for targets (1 - alpha) y + alpha teacher: each row is both classes, weighted by its target."""
    t = (1 - alpha) * F.col("label") + alpha * teacher
    both = examples.select(*features, t.alias("_t")).select(*features, F.inline(F.array(F.struct(F.lit(1).alias("label"), F.col("_t").alias("w")), F.struct(F.lit(0).alias("label"), (1 - F.col("_t")).alias("w")))))
    return fit_logistic(both.where("w > 0"), features, weight="w")


def adversarial_validation(sided: DataFrame, features: Sequence[str], holdout: float = 0.35, seed: int = 42) -> DataFrame:
    """Can a quadratic model tell the sides apart? One row: holdout AUC, detectability and verdict."""
    maps = quadratic(features)
    data = sided.select("row_id", (F.col("side") == "current").cast("int").alias("label"), *[c.alias(n) for n, c in maps.items()])
    parts = materialize(stratified_split(data, {"train": 1 - holdout, "validation": holdout}, seed), "parts")
    w, b = fit_logistic(parts.where("split = 'train'"), list(maps), 1e-3)
    val = materialize(parts.where("split = 'validation'").select("row_id", "label", linear_score(w, b)(*[F.col(n) for n in maps]).alias("p")), "val")
    out = with_totals(ranking_metrics(val), confusion(val, 0.5).select("accuracy"))
    d = F.greatest("roc_auc", 1 - F.col("roc_auc"))
    verdict = F.when(d >= 0.85, "strong_multivariate_shift").when(d >= 0.75, "moderate_multivariate_shift").when(d >= 0.65, "weak_multivariate_shift").otherwise("no_detectable_multivariate_shift")
    return out.withColumn("detectability", d).withColumn("verdict", verdict).drop("average_precision")


def chronological_holdout(examples: DataFrame, features: Sequence[str], order: Column, fraction: float = 0.6) -> DataFrame:
    """Train on the earlier rows, replay on the later ones; the change, a model of the later rows alone, and the verdict."""
    sided = order_split(examples, order, fraction)
    early, late = sided.where("side = 'reference'"), sided.where("side = 'current'")
    x = [F.col(f) for f in features]
    old, new = linear_score(*fit_logistic(early, features))(*x), linear_score(*fit_logistic(late, features))(*x)
    parts = {"early": early.withColumn("p", old), "late": late.withColumn("p", old), "relearned": late.withColumn("p", new)}
    one = None
    for name, rows in parts.items():
        m = with_rates(rows.agg(*confusion_aggs(0.5), *probability_aggs())).select(*[F.col(c).alias(f"{name}_{c}") for c in ("f1", "balanced_accuracy", "brier", "log_loss")])
        one = m if one is None else with_totals(one, m)
    d = {c: F.col(f"late_{c}") - F.col(f"early_{c}") for c in ("f1", "balanced_accuracy", "brier", "log_loss")}
    gain = F.col("relearned_f1") - F.col("late_f1")
    severe = (d["f1"] <= -0.25) | (d["balanced_accuracy"] <= -0.20)
    verdict = F.when(severe & (gain >= 0.10), "severe_degradation_current_relearns").when(severe, "severe_degradation").when((d["f1"] <= -0.10) | (d["balanced_accuracy"] <= -0.10), "moderate_degradation")
    verdict = verdict.when((d["brier"] >= 0.08) | (d["log_loss"] >= 0.20), "probability_degradation").otherwise("stable_holdout")
    return one.withColumns({f"{c}_delta": v for c, v in d.items()}).withColumn("baseline_gain", gain).withColumn("verdict", verdict)


def holdout_reliance(examples: DataFrame, features: Sequence[str], order: Column, fraction: float = 0.6, repeats: int = 5, seed: int = 42) -> DataFrame:
    """On which features a model of the earlier rows relies on the later ones."""
    sided = order_split(examples, order, fraction)
    model = linear_score(*fit_logistic(sided.where("side = 'reference'"), features))
    return permutation_reliance(sided.where("side = 'current'"), features, model, repeats, seed)


def shift_drivers(sided: DataFrame, features: Sequence[str], seed: int = 42) -> DataFrame:
    """Features by what dealing them out anew costs a model that tells the sides apart: AUC, accuracy, moved scores."""
    data = materialize(sided.select("row_id", (F.col("side") == "current").cast("int").alias("label"), *features), "data")
    return permutation_drivers(data, features, linear_score(*fit_logistic(data, features, 1e-3)), seed)

