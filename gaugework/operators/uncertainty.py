"""Conformal sets, bootstrap intervals, permutation nulls and active-learning scores over scored rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugework.functions.columns import clip, hash_normal, hash_uniform, ratio, with_rates
from gaugework.operators.metrics import confusion
from gaugework.plans import laws
from gaugework.plans.patterns import ranked, running_sums, with_totals
from gaugework.plans.scratch import materialize


def order_statistics(values: DataFrame, value: str, alphas: DataFrame) -> DataFrame:
    """``alphas`` (alpha) with ``quantile``: the conformal order statistic of the values, which is not interpolated: the
    ceil((n + 1)(1 - alpha))-th smallest, within the table."""
    counts = running_sums(values.groupBy(F.col(value).alias("v")).agg(F.count("*").alias("c")), "v", ["c"])
    n = counts.agg(F.sum("c").alias("n"))
    k = F.least(F.greatest(F.ceil((F.col("n") + 1) * (1 - F.col("alpha"))), F.lit(1)), F.col("n"))
    wanted = with_totals(alphas, n).withColumn("k", k)
    # Few alphas meet all distinct values; an aggregation takes the first value that reaches k.
    return counts.crossJoin(F.broadcast(wanted)).where("cum_c >= k").groupBy("alpha", "n").agg(F.min("v").alias("quantile"))


def nonconformity() -> Column:
    return clip(F.when(F.col("label") == 1, 1 - F.col("p")).otherwise(F.col("p")), 0.0, 1.0)


def conformal_set(p: Column, q: Column) -> Column:
    zero, one = p <= q, (1 - p) <= q
    return F.when(zero & one, "{0,1}").when(zero, "{0}").when(one, "{1}").otherwise("abstain")


def set_aggs(in0: Column, in1: Column) -> list[Column]:
    size = in0.cast("int") + in1.cast("int")
    covered = F.when(F.col("label") == 1, in1).otherwise(in0)
    part = lambda c: F.avg(c.cast("double"))
    return [
        part(covered).alias("coverage"), part(size == 1).alias("singleton_rate"), part(size == 2).alias("both_rate"), part(size == 0).alias("empty_rate"), F.avg(size.cast("double")).alias("average_size"),
        F.coalesce(F.avg(F.when(F.col("label") == 0, covered.cast("double"))), F.lit(0.0)).alias("coverage_0"), F.coalesce(F.avg(F.when(F.col("label") == 1, covered.cast("double"))), F.lit(0.0)).alias("coverage_1"),
    ]


def conformal_sweep(calibration: DataFrame, evaluation: DataFrame, alphas: Sequence[float] = (0.05, 0.1, 0.2, 0.3)) -> DataFrame:
    """For each alpha: quantile from the calibration rows, and coverage, set sizes and class coverage on the evaluation rows."""
    table = calibration.sparkSession.createDataFrame([(float(a),) for a in alphas], "alpha double")
    q = order_statistics(calibration.select(nonconformity().alias("s")), "s", table).select("alpha", "quantile")
    rows = evaluation.crossJoin(F.broadcast(q))  # a few alphas for each row
    return rows.groupBy("alpha", "quantile").agg(F.count("*").alias("n"), *set_aggs(F.col("p") <= F.col("quantile"), 1 - F.col("p") <= F.col("quantile")))


def recommended_alpha(sweep: DataFrame) -> DataFrame:
    """Of alphas that keep their coverage the smallest sets, then most singletons, then the smaller alpha; else the largest gap."""
    gap = F.col("coverage") - (1 - F.col("alpha"))
    ok = F.min(F.when(F.round(gap, 12) >= 0, F.struct(F.col("average_size").alias("a"), (-F.col("singleton_rate")).alias("b"), F.col("alpha").alias("alpha"))))
    other = F.min(F.struct((-gap).alias("a"), F.col("average_size").alias("b"), (-F.col("singleton_rate")).alias("c"), F.col("alpha").alias("alpha")))
    return sweep.agg(ok.alias("ok"), other.alias("other")).select(F.coalesce("ok.alpha", "other.alpha").alias("alpha"), F.col("ok").isNotNull().alias("keeps_coverage"))


def aps_score() -> Column:
    """1 unless the label is the more probable class (class 0 at a tie), then that probability."""
    top = F.when(F.col("p") > 0.5, 1).otherwise(0)
    return F.when(F.col("label") == top, F.greatest("p", 1 - F.col("p"))).otherwise(F.lit(1.0))


def aps_sweep(calibration: DataFrame, evaluation: DataFrame, alphas: Sequence[float] = (0.05, 0.1, 0.2, 0.3)) -> DataFrame:
    """Adaptive prediction sets: the more probable class alone if its probability reaches the quantile, else both."""
    table = calibration.sparkSession.createDataFrame([(float(a),) for a in alphas], "alpha double")
    q = order_statistics(calibration.select(aps_score().alias("s")), "s", table).select("alpha", "quantile")
    rows = evaluation.crossJoin(F.broadcast(q))
    alone = F.greatest("p", 1 - F.col("p")) >= F.col("quantile")
    one = F.col("p") > 0.5
    return rows.groupBy("alpha", "quantile").agg(F.count("*").alias("n"), *set_aggs(~alone | ~one, ~alone | one))


def bootstrap_intervals(scored: DataFrame, replicates: int = 1000, alpha: float = 0.05, threshold: float = 0.5, seed: int = 42) -> DataFrame:
    """Intervals of F1, accuracy and balanced accuracy by the Poisson bootstrap.

    A replicate weighs each row by a Poisson(1) number. At a fixed threshold only the weighted cells of the confusion table
    count, and a sum of n such weights is Poisson(n): each replicate draws four numbers by exact inversion, and the rows are
    counted once."""
    names = ("tp", "fp", "tn", "fn")
    counts = confusion(scored, threshold).select(F.inline(F.array(*[F.struct(F.lit(c).alias("cell"), F.col(c).alias("mean")) for c in names])))
    tables = materialize(laws.poisson_tables(counts, "mean", ["cell"]), "tables")  # four rows
    drawn = scored.sparkSession.range(replicates).select(F.col("id").alias("rep")).crossJoin(F.broadcast(tables))
    salt = F.concat(F.lit("ci"), F.col("cell"))
    drawn = drawn.select("rep", "cell", laws.poisson_draw(hash_uniform(F.col("rep"), seed, salt), hash_normal(F.col("rep"), seed, salt)).alias("n"))
    reps = with_rates(drawn.groupBy("rep").agg(*[F.max(F.when(F.col("cell") == c, F.col("n"))).alias(c) for c in names]))
    names = ("f1", "accuracy", "balanced_accuracy")
    q = reps.agg(*[F.percentile(m, F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2))).alias(m) for m in names], *[F.avg(m).alias(f"{m}_mean") for m in names])
    return q.select(F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.get(m, F.lit(0)).alias("low"), F.get(m, F.lit(1)).alias("high"), F.col(f"{m}_mean").alias("mean")) for m in names])))


def permutation_null(scored: DataFrame, threshold: float = 0.5, permutations: int = 200, seed: int = 42) -> DataFrame:
    """F1 against its distribution under shuffled labels.

    A shuffle changes only the true positives, which follow a hypergeometric law of N, K and P; a permutation draws them
    by exact inversion, so the work does not grow with the rows beyond one count. ``p_value`` counts permutations, as a run of
    shuffles would; ``exact_p`` is the law's own probability of an F1 this large (null where its table would be too long)."""
    one = scored.agg(F.count("*").cast("double").alias("N"), F.sum("label").cast("double").alias("P"), F.sum((F.col("p") >= threshold).cast("int")).cast("double").alias("K"), F.sum(((F.col("p") >= threshold) & (F.col("label") == 1)).cast("int")).cast("double").alias("tp"))
    N, P, K = F.col("N"), F.col("P"), F.col("K")
    f1 = lambda tp: ratio(2 * tp, K + P)
    one = materialize(laws.hypergeometric_table(one), "law")  # one row
    # F1 grows with the true positives, so the counts from the observed one on are at least as good.
    below = F.col("tp").cast("long") - F.col("_lo") - 1
    exact = F.when(below < 0, 1.0).otherwise(1 - F.get("_cdf", F.least(below, F.size("_cdf") - 1).cast("int")))
    reps = with_totals(scored.sparkSession.range(permutations).withColumnRenamed("id", "rep"), one.withColumn("exact_p", exact))
    draw = laws.hypergeometric_draw(hash_uniform(F.col("rep"), seed, "null"), hash_normal(F.col("rep"), seed, "null"))
    reps = reps.withColumn("null_f1", f1(draw)).withColumn("observed", f1(F.col("tp")))
    q = reps.agg(
        F.max("observed").alias("observed_f1"), F.avg("null_f1").alias("null_mean"), F.stddev_pop("null_f1").alias("null_std"), F.percentile("null_f1", F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95))).alias("q"),
        F.count_if(F.round(F.col("null_f1") - F.col("observed"), 12) >= 0).alias("reached"), F.count("*").alias("permutations"), F.max("exact_p").alias("exact_p"),
    )
    out = q.select("observed_f1", "null_mean", "null_std", "exact_p", *[F.get("q", F.lit(i)).alias(n) for i, n in enumerate(("null_q05", "null_q50", "null_q95"))], ((F.col("reached") + 1) / (F.col("permutations") + 1)).alias("p_value"))
    out = out.withColumn("z", F.when(F.col("null_std") < 1e-9, 0.0).otherwise((F.col("observed_f1") - F.col("null_mean")) / F.col("null_std")))
    verdict = F.when(F.col("observed_f1") <= F.col("null_mean"), "no_observed_lift").when(F.col("p_value") <= 0.01, "strong_signal").when(F.col("p_value") <= 0.05, "signal").when(F.col("p_value") <= 0.10, "weak_signal").otherwise("not_significant")
    return out.withColumn("verdict", verdict)


def row_drift(df: DataFrame, standardizer: DataFrame, features: Sequence[str], limit: float = 3.0) -> DataFrame:
    """``df`` with ``drift`` (root mean square of standardized values), ``max_z`` and ``ood`` (1 if max_z reaches the limit)."""
    wide = standardizer.agg(*[F.max(F.when(F.col("feature") == f, F.struct("mean", "scale"))).alias(f"_{f}") for f in features])
    z = {f: (F.col(f) - F.col(f"_{f}.mean")) / F.col(f"_{f}.scale") for f in features}
    rows = with_totals(df, wide).withColumn("drift", F.sqrt(sum((v * v for v in z.values()), F.lit(0.0)) / len(features)))
    rows = rows.withColumn("max_z", F.greatest(*[F.abs(v) for v in z.values()], F.lit(0.0)))
    return rows.withColumn("ood", (F.col("max_z") >= limit).cast("int")).drop(*[f"_{f}" for f in features])


def review_scores(scored: DataFrame, standardizer: DataFrame, features: Sequence[str], quantile: float, threshold: float = 0.5) -> DataFrame:
    """What to label next: decision, confidence, uncertainty, conformal set, drift, query score with its rank, and priority."""
    rows = row_drift(scored, standardizer, features)
    t = threshold
    rows = rows.withColumn("predicted_label", (F.col("p") >= t).cast("int")).withColumn("confidence", F.when(F.col("p") >= t, F.col("p")).otherwise(1 - F.col("p")))
    rows = rows.withColumn("uncertainty", 1 - F.least(F.abs(F.col("p") - t) / max(t, 1 - t, 1e-6), F.lit(1.0))).withColumn("conformal_set", conformal_set(F.col("p"), F.lit(quantile)))
    unsure = F.col("conformal_set").isin("{0,1}", "abstain")
    base = F.when(F.col("conformal_set") == "abstain", F.greatest("uncertainty", F.lit(1.0))).when(F.col("conformal_set") == "{0,1}", F.greatest("uncertainty", F.lit(0.9))).otherwise(F.col("uncertainty"))
    rows = rows.withColumn("query_score", F.round(clip(base * F.exp(-0.15 * F.col("drift") * F.col("drift")) * F.when(F.col("ood") == 1, 0.5).otherwise(1.0), 0.0, 1.0), 9))
    rows = rows.withColumn("review_priority", F.when((F.col("ood") == 1) | unsure | (F.col("uncertainty") >= 0.8), "high").when(F.col("uncertainty") >= 0.6, "medium").otherwise("low"))
    return ranked(rows, -F.col("query_score"), "row_id", (), "query_rank")
