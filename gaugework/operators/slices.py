"""Where a model does badly: slices, subgroups, fairness gaps, error and review queues, data maps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugework.functions.columns import clip, flags, hash_normal, ratio, rates, with_rates
from gaugework.operators.metrics import confusion_aggs
from gaugework.plans.patterns import to_long, with_totals
from gaugework.plans.scratch import materialize
from gaugework.plans.selection import median, quantiles, wide_quantiles


def quantile_bins(long: DataFrame, bins: int, key: Sequence[str] = ("feature_index", "feature")) -> DataFrame:
    """Edges of each feature's distinct quantile bins: rows (key, bin, left, right, last), as many as features times bins."""
    edges = quantiles(long, "value", [i / bins for i in range(bins + 1)], key, "e").withColumn("e", F.array_sort(F.array_distinct("e")))
    spans = F.transform(F.sequence(F.lit(1), F.size("e") - 1), lambda i: F.struct((i - 1).alias("bin"), F.get("e", i - 1).alias("left"), F.get("e", i).alias("right"), (i == F.size("e") - 1).alias("last")))
    return materialize(edges.where(F.size("e") > 1).select(*key, F.inline(spans)), "edges")


def in_bin() -> Column:
    v = F.col("value")
    return (v >= F.col("left")) & F.when(F.col("last"), v <= F.col("right")).otherwise(v < F.col("right"))


def slices(scored: DataFrame, features: Sequence[str], threshold: float = 0.5, bins: int = 4, min_count: int | None = None, top: int | None = 12) -> DataFrame:
    """Quantile slices of each feature with their metrics against the whole, the worst first."""
    long = to_long(scored, features, ("label", "p"))
    cells = long.join(F.broadcast(quantile_bins(long, bins)), ["feature_index", "feature"]).where(in_bin())
    per = cells.groupBy("feature_index", "feature", "bin", "left", "right").agg(F.count("*").alias("count"), F.avg(F.col("label").cast("double")).alias("prevalence"), *confusion_aggs(threshold))
    base = with_rates(scored.agg(F.count("*").alias("n"), *confusion_aggs(threshold))).select("n", F.col("f1").alias("_f1"), F.col("accuracy").alias("_acc"))
    out = with_totals(with_rates(per), base)
    least = F.lit(min_count) if min_count is not None else F.greatest(F.lit(3), F.bround(0.08 * F.col("n")))
    out = out.where(F.col("count") >= least).withColumn("f1_delta", F.col("f1") - F.col("_f1")).withColumn("accuracy_delta", F.col("accuracy") - F.col("_acc"))
    out = out.withColumn("coverage", F.col("count") / F.col("n")).withColumn("predicted_rate", (F.col("tp") + F.col("fp")) / F.col("count"))
    out = out.select("feature_index", "feature", "bin", "left", "right", "count", "coverage", "f1", "accuracy", "balanced_accuracy", "precision", "recall", "f1_delta", "accuracy_delta", "prevalence", "predicted_rate")
    return out.orderBy(F.round("f1_delta", 9), F.round("accuracy_delta", 9), F.desc("count"), "feature_index", "bin").limit(top) if top else out


def subgroups(scored: DataFrame, features: Sequence[str], threshold: float = 0.5, min_size: int = 2, max_bins: int = 4) -> DataFrame:
    """Each subgroup (a value of a feature with few values, else a quantile bin) against all other rows: nine gaps, the
    worst of them, and flags. The others' counts are the totals less the group's, so rows are read once."""
    long = to_long(scored, features, ("label", "p"))
    kinds = long.groupBy("feature_index", "feature", "value").agg(F.count("*").alias("_")).groupBy("feature_index", "feature").agg(F.count("*").alias("distinct"))
    exact = kinds.where(F.col("distinct").between(2, max_bins)).select("feature_index")
    wide = kinds.where(F.col("distinct") > max_bins).select("feature_index")
    sums = [F.count("*").alias("n"), F.sum("p").alias("sp"), *confusion_aggs(threshold)]
    name = lambda *parts: F.concat_ws("", *parts)
    values = long.join(F.broadcast(exact), "feature_index").groupBy("feature_index", "feature", name(F.lit("value="), F.round("value", 6).cast("string")).alias("grp")).agg(*sums)
    edges = quantile_bins(long.join(F.broadcast(wide), "feature_index"), max_bins)
    edges = edges.join(F.broadcast(edges.groupBy("feature_index").agg(F.count("*").alias("_b")).where("_b >= 2").select("feature_index")), "feature_index")
    ranges = long.join(F.broadcast(edges), ["feature_index", "feature"]).where(in_bin()).groupBy("feature_index", "feature", name(F.lit("bin="), F.col("bin").cast("string")).alias("grp")).agg(*sums)
    counts = ("n", "sp", "tp", "fp", "tn", "fn")
    total = scored.agg(*sums).withColumnsRenamed({c: f"all_{c}" for c in counts})
    rows = with_totals(values.unionByName(ranges), total).withColumns({f"rest_{c}": F.col(f"all_{c}") - F.col(c) for c in counts})
    rows = rows.where((F.col("n") >= min_size) & (F.col("rest_n") >= min_size))

    def side(pre: str) -> dict[str, Column]:
        tp, fp, tn, fn, n = (F.col(pre + c) for c in ("tp", "fp", "tn", "fn", "n"))
        r = rates(tp, fp, tn, fn)
        defined = lambda a, b: F.when(b > 0, a / b)
        return {
            "accuracy": r["accuracy"], "f1": r["f1"], "precision": defined(tp, tp + fp), "recall": defined(tp, tp + fn), "fnr": defined(fn, tp + fn), "fpr": defined(fp, fp + tn),
            "ppr": (tp + fp) / n, "mean_p": F.col(pre + "sp") / n, "prevalence": (tp + fn) / n,
        }

    a, b = side(""), side("rest_")
    rows = rows.withColumns({f"{k}_gap": a[k] - b[k] for k in a})
    sized = [F.struct(F.round(F.abs(F.col(f"{k}_gap")), 9).alias("g"), F.lit(-i).alias("o"), F.lit(k).alias("m")) for i, k in enumerate(a)]
    worst = F.array_max(F.filter(F.array(*sized), lambda s: s["g"].isNotNull()))
    rows = rows.withColumn("risk", worst["g"]).withColumn("worst_metric", worst["m"])
    big = lambda k, t: F.coalesce(F.abs(F.col(f"{k}_gap")) >= t, F.lit(False))
    rows = rows.withColumn("flags", flags(fnr_gap=big("fnr", 0.25), fpr_gap=big("fpr", 0.25), selection_gap=big("ppr", 0.25), accuracy_gap=big("accuracy", 0.2), large_gap=F.col("risk") >= 0.4))
    return rows.select("feature_index", "feature", "grp", "n", *[f"{k}_gap" for k in a], "risk", "worst_metric", "flags")


def fairness(scored: DataFrame, features: Sequence[str], threshold: float = 0.5, min_size: int = 2) -> DataFrame:
    """For each feature the largest difference between its groups (2 to 4 values, else halves at the median) in six rates,
    and the equalized-odds gap; the most unequal first."""
    long = to_long(scored, features, ("label", "p"))
    kinds = long.groupBy("feature_index", "value").agg(F.count("*").alias("_")).groupBy("feature_index").agg(F.count("*").alias("distinct"))
    kinds = kinds.join(F.broadcast(median(long, "value", ["feature_index"])), "feature_index")  # a row for each feature
    group = F.when(F.col("distinct").between(2, 4), F.col("value")).otherwise(F.when(F.col("value") <= F.col("median"), 0.0).otherwise(1.0))
    per = long.join(F.broadcast(kinds), "feature_index").withColumn("g", group).groupBy("feature_index", "feature", "g").agg(F.count("*").alias("n"), *confusion_aggs(threshold)).where(F.col("n") >= min_size)
    tp, fp, tn, fn, n = (F.col(c) for c in ("tp", "fp", "tn", "fn", "n"))
    defined = lambda a, b: F.when(b > 0, a / b)
    shares = {"selection_rate": (tp + fp) / n, "tpr": defined(tp, tp + fn), "fpr": defined(fp, fp + tn), "fnr": defined(fn, tp + fn), "accuracy": (tp + tn) / n, "prevalence": (tp + fn) / n}
    per = per.withColumns(shares)
    gap = lambda k: F.when(F.count(k) >= 2, F.max(k) - F.min(k)).alias(f"{k}_gap")
    out = per.groupBy("feature_index", "feature").agg(F.count("*").alias("groups"), *[gap(k) for k in shares]).where("groups >= 2")
    out = out.withColumn("equalized_odds_gap", F.greatest("tpr_gap", "fpr_gap")).withColumn("max_disparity", F.greatest(*[f"{k}_gap" for k in shares]))
    order = Window.orderBy(F.desc(F.round("max_disparity", 9)), F.desc(F.round("equalized_odds_gap", 9)), "feature_index")  # one row for each feature
    return out.withColumn("rank", F.row_number().over(order))


def segment_fairness(scored: DataFrame, attributes: Sequence[str], threshold: float = 0.5) -> DataFrame:
    """Rates of all combinations of attributes and of their roll-ups, from one pass."""
    cube = scored.cube(*attributes).agg(F.count("*").alias("n"), *confusion_aggs(threshold), F.grouping_id().alias("level"))
    return with_rates(cube).select(*attributes, F.col("level").cast("long").alias("level"), "n", "accuracy", "recall", ratio(F.col("tp") + F.col("fp"), F.col("n")).alias("selection_rate"))


def with_errors(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``scored`` with bucket (tp, tn, fp, fn), confidence in the decision, loss of the true label, and distance to the threshold."""
    hit, y = F.col("p") >= threshold, F.col("label") == 1
    bucket = F.when(hit & y, "tp").when(hit, "fp").when(y, "fn").otherwise("tn")
    true_p = clip(F.when(y, F.col("p")).otherwise(1 - F.col("p")), 1e-7, 1.0)
    return scored.withColumns({"bucket": bucket, "wrong": hit != y, "confidence": F.when(hit, F.col("p")).otherwise(1 - F.col("p")), "loss": F.round(-F.log(true_p), 9), "margin": F.round(F.abs(F.col("p") - threshold), 9)})


def top_by(df: DataFrame, by: Sequence[str], order: Sequence[Column | str], k: int) -> DataFrame:
    """The first k rows of each group, with ``rank``. Spark keeps only k rows of a group in each task before it shuffles."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


def error_atlas(scored: DataFrame, threshold: float = 0.5, k: int = 10) -> DataFrame:
    """The k rows of each confusion bucket with the largest loss."""
    return top_by(with_errors(scored, threshold), ["bucket"], [F.desc("loss"), F.desc("margin"), "row_id"], k).select("bucket", "rank", "row_id", "label", "p", "confidence", "loss", "margin")


def near_threshold(scored: DataFrame, threshold: float = 0.5, width: float = 0.05, k: int = 10) -> DataFrame:
    """The k rows closest to the threshold, within ``width``."""
    return with_errors(scored, threshold).where(F.col("margin") <= width).orderBy("margin", F.desc("loss"), "row_id").limit(k).select("row_id", "bucket", "p", "margin", "loss")


def error_summary(scored: DataFrame, threshold: float = 0.5, high_confidence: float = 0.8, width: float = 0.05, by: Sequence[str] = ()) -> DataFrame:
    """Counts of the buckets, confident errors and near rows, and which error dominates."""
    rows = with_errors(scored, threshold)
    s = rows.groupBy(*by).agg(
        F.count("*").alias("n"), *[F.count_if(F.col("bucket") == b).alias(b) for b in ("tp", "tn", "fp", "fn")], F.count_if(F.col("wrong") & (F.col("confidence") >= high_confidence)).alias("high_confidence_errors"),
        F.count_if(F.col("margin") <= width).alias("near_threshold"),
    )
    kind = F.when(F.col("fp") > F.col("fn"), "false_positives").when(F.col("fn") > F.col("fp"), "false_negatives").when(F.col("fp") == 0, "none").otherwise("balanced_errors")
    return s.withColumn("dominant", kind)


def sample_review(scored: DataFrame, threshold: float = 0.5, k: int = 12, confident: float = 0.8) -> DataFrame:
    """Three review queues of k rows: likely label issues, hard rows, ambiguous rows."""
    rows = with_errors(scored, threshold)
    shown = ["row_id", "label", "p", "confidence", "loss", "margin"]
    issue = rows.where(F.col("wrong") & (F.col("confidence") >= confident)).orderBy(F.desc("loss"), "row_id").limit(k).select(F.lit("label_issue").alias("queue"), *shown)
    hard = rows.orderBy(F.desc("loss"), "row_id").limit(k).select(F.lit("hard").alias("queue"), *shown)
    vague = rows.orderBy("margin", F.desc("loss"), "row_id").limit(k).select(F.lit("ambiguous").alias("queue"), *shown)
    return issue.unionByName(hard).unionByName(vague)


def cartography(scored: DataFrame, features: Sequence[str], scorer, perturbations: int = 5, share: float = 0.05, seed: int = 42) -> DataFrame:
    """Region of each row by confidence in its label and by how much small jitters of its features move the score.

    ``scorer`` makes a score column of the feature columns. Cuts are the medians; at the median counts as high."""
    spread = scored.agg(*[F.stddev_pop(f).alias(f"_s_{f}") for f in features])
    rows = with_totals(scored.select("row_id", "label", *features), spread).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(perturbations))))
    moved = {f: F.when(F.col("k") == 0, F.col(f)).otherwise(F.col(f) + share * F.col(f"_s_{f}") * hash_normal(F.col("row_id"), seed, F.concat(F.lit(f"{f}:"), F.col("k")))) for f in features}
    rows = rows.withColumns(moved).withColumn("q", scorer(*[F.col(f) for f in features]))
    per = rows.groupBy("row_id", "label").agg(F.max(F.when(F.col("k") == 0, F.col("q"))).alias("q0"), F.round(F.stddev_pop("q"), 9).alias("variability"))
    per = per.withColumn("confidence", F.round(F.when(F.col("label") == 1, F.col("q0")).otherwise(1 - F.col("q0")), 9)).withColumn("wrong", (F.col("q0") >= 0.5) != (F.col("label") == 1))
    per = materialize(per, "per")  # the perturbations are made once
    cuts = wide_quantiles(per, ["confidence", "variability"], [0.5]).select(F.get("_q_confidence", F.lit(0)).alias("_c"), F.get("_q_variability", F.lit(0)).alias("_v"))
    sure, loose = F.col("confidence") >= F.col("_c"), F.col("variability") >= F.col("_v")
    region = F.when(F.col("wrong") & sure, "overconfident_wrong").when(sure, "easy").when(loose, "ambiguous").otherwise("hard")
    return with_totals(per, cuts).select("row_id", "label", "confidence", "variability", region.alias("region"))
