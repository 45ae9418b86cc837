"""Audits of one labelled table, without a model: balance, duplicates, correlation, contracts, separability."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugework.functions.columns import flags, ratio
from gaugework.plans.patterns import join_groups, running_sums, to_long, with_totals
from gaugework.plans.scratch import materialize
from gaugework.plans.selection import median, quantiles

QUANTILES = {"q01": 0.01, "q05": 0.05, "q25": 0.25, "median": 0.5, "q75": 0.75, "q95": 0.95, "q99": 0.99}


def class_balance(examples: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Rows of each class, minority share and imbalance ratio (largest class by smallest, at least 1 row)."""
    c = examples.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(F.col("label") == 0).alias("n0"), F.count_if(F.col("label") == 1).alias("n1"))
    low, high = F.least("n0", "n1"), F.greatest("n0", "n1")
    return c.withColumn("minority_fraction", ratio(low, F.col("n"))).withColumn("imbalance_ratio", high / F.greatest(low, F.lit(1)))


def duplicate_groups(examples: DataFrame, features: Sequence[str], top: int = 20, members: int = 5) -> DataFrame:
    """The largest groups of rows that agree in all features, rounded to 8 places: size, labels, and first row ids.

    Groups are summed up without collecting their rows; the ids are the smallest few of the largest groups."""
    keys = [F.round(F.col(f), 8).alias(f) for f in features]
    groups = _groups(examples, features)
    best = groups.where("count > 1").orderBy(F.desc("count"), *features).limit(top)
    rows = examples.select("row_id", *keys).join(F.broadcast(best.select(*features)), list(features))
    nth = F.row_number().over(Window.partitionBy(*features).orderBy("row_id"))
    ids = rows.withColumn("_nth", nth).where(F.col("_nth") <= members).groupBy(*features).agg(F.array_join(F.transform(F.array_sort(F.collect_list("row_id")), lambda x: x.cast("string")), ",").alias("first_rows"))
    return best.join(ids, list(features))


def _groups(examples: DataFrame, features: Sequence[str]) -> DataFrame:
    g = examples.groupBy(*[F.round(F.col(f), 8).alias(f) for f in features]).agg(F.count("*").alias("count"), F.min("label").alias("low"), F.max("label").alias("high"))
    return g.withColumn("conflict", F.col("low") != F.col("high")).drop("low", "high")


def duplicate_summary(examples: DataFrame, features: Sequence[str]) -> DataFrame:
    """Duplicate rows (beyond the first of a group), groups with both labels, and rows in them."""
    return _groups(examples, features).agg(
        F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).cast("long").alias("duplicate_rows"), F.count_if("conflict").alias("conflict_groups"),
        F.coalesce(F.sum(F.when(F.col("conflict"), F.col("count"))), F.lit(0)).cast("long").alias("conflicting_rows"),
    )


def constant_features(examples: DataFrame, features: Sequence[str]) -> DataFrame:
    """Features with a population deviation under 1e-8 (any, with fewer than two rows), and their value."""
    s = to_long(examples, features, ()).groupBy("feature_index", "feature").agg(F.stddev_pop("value").alias("std"), F.min("value").alias("value"), F.count("*").alias("n"))
    return s.where("std < 1e-8 or n < 2").select("feature_index", "feature", "value")


def correlations(examples: DataFrame, features: Sequence[str], threshold: float = 0.95, top: int | None = 12) -> DataFrame:
    """Pairs of non-constant features with an absolute correlation of at least ``threshold``, all from one aggregation."""
    pairs = list(combinations(range(len(features)), 2))
    aggs = [F.corr(features[i], features[j]).alias(f"c{k}") for k, (i, j) in enumerate(pairs)]
    aggs += [F.stddev_pop(f).alias(f"s{i}") for i, f in enumerate(features)]
    one = examples.agg(F.count("*").alias("n"), *aggs)
    varies = lambda i: F.col(f"s{i}") >= 1e-8
    rows = [F.struct(F.lit(features[i]).alias("left"), F.lit(features[j]).alias("right"), F.when(varies(i) & varies(j), F.col(f"c{k}")).alias("correlation")) for k, (i, j) in enumerate(pairs)]
    out = one.where("n >= 3").select(F.inline(F.array(*rows)) if rows else F.inline(F.array())).where(F.abs("correlation") >= threshold)
    return out.orderBy(F.desc(F.abs("correlation")), "left", "right").limit(top) if top else out


def audit(examples: DataFrame, features: Sequence[str]) -> DataFrame:
    """One row: balance, duplicates, constants, high correlations, and the warnings that follow."""
    one = with_totals(class_balance(examples), duplicate_summary(examples, features))
    one = with_totals(one, constant_features(examples, features).agg(F.count("*").alias("constant_features")))
    one = with_totals(one, correlations(examples, features).agg(F.count("*").alias("high_correlations")))
    missing = (F.col("n0") == 0) | (F.col("n1") == 0)
    return one.withColumn("warnings", flags(
        very_small_dataset=F.col("n") < 20, missing_one_class=missing, strong_class_imbalance=~missing & (F.col("imbalance_ratio") >= 4), duplicates=F.col("duplicate_rows") > 0,
        conflicts=F.col("conflict_groups") > 0, constants=F.col("constant_features") > 0, high_correlation=F.col("high_correlations") > 0,
    ))


def feature_contract(examples: DataFrame, features: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """What each feature looks like: quantiles, range, moments, robust and soft bounds, distinct values, outliers, flags, risk."""
    by = list(by)
    key = [*by, "feature_index", "feature"]
    long = to_long(examples, features, by)
    few = not by
    met = lambda df, small, how="inner": join_groups(df, small, key, how, "broadcast" if few else "merge")
    base = long.groupBy(*key).agg(F.count("*").alias("n"), F.min("value").alias("min"), F.max("value").alias("max"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
    base = met(base, quantiles(long, "value", list(QUANTILES.values()), key, "_q", few))
    base = materialize(base.select(*key, "n", "min", "max", "mean", "std", *[F.get("_q", F.lit(i)).alias(k) for i, k in enumerate(QUANTILES)]), "base")  # a row for each feature
    # Distinct values with their counts: deviations, outliers and observed values come from these.
    values = long.groupBy(*key, "value").agg(F.count("*").alias("m"))
    away = met(long, base.select(*key, "median")).select(*key, F.abs(F.col("value") - F.col("median")).alias("away"))
    base = met(base, median(away, "away", key, "mad", few)).withColumn("iqr", F.col("q75") - F.col("q25"))
    scale = F.when(F.col("mad") > 1e-12, 1.4826 * F.col("mad")).when(F.col("iqr") > 1e-12, F.col("iqr") / 1.349).otherwise(F.col("std"))
    base = base.withColumn("scale", F.greatest(scale, F.lit(1e-12))).withColumn("robust_lower", F.col("median") - 6 * F.col("scale")).withColumn("robust_upper", F.col("median") + 6 * F.col("scale"))
    base = materialize(base.withColumn("soft_lower", F.col("q01")).withColumn("soft_upper", F.col("q99")), "base")
    counted = met(values, base.select(*key, "robust_lower", "robust_upper", "soft_lower", "soft_upper"))
    outside = lambda a: F.coalesce(F.sum(F.when((F.col("value") < F.col(f"{a}_lower")) | (F.col("value") > F.col(f"{a}_upper")), F.col("m"))), F.lit(0)).cast("long")
    seen = counted.groupBy(*key).agg(F.count("*").alias("unique_count"), outside("robust").alias("outlier_count"), outside("soft").alias("soft_outlier_count"))
    seen = materialize(seen, "seen")
    coded = met(values, seen.where("unique_count <= 20").select(*key)).groupBy(*key).agg(F.array_sort(F.collect_list("value")).alias("observed_values"))
    out = met(met(base, seen), coded, "left").withColumn("unique_ratio", F.col("unique_count") / F.col("n"))
    n, u, r = F.col("n"), F.col("unique_count"), F.col("unique_ratio")
    constant = (F.col("std") <= 1e-12) | (F.col("min") == F.col("max"))
    near = ~constant & ((u <= F.least(F.lit(3), F.greatest(F.lit(2), F.floor(n / 20)))) | (r <= 0.03))
    low = (u <= 4) | ((u <= F.least(F.lit(20), F.greatest(F.lit(4), F.floor(n / 4)))) & (r <= 0.20))
    robust = F.col("outlier_count") > 0
    tail = F.col("soft_outlier_count") >= F.greatest(F.lit(2), F.ceil(0.02 * n))
    spikes = (F.col("iqr") <= 1e-12) & (F.col("mad") <= 1e-12) & (F.col("std") > 1e-12)
    out = out.withColumn("risk_flags", flags(constant=constant, near_constant=near, low_cardinality=low, robust_range_outliers=robust, heavy_tail=tail, mostly_constant_with_spikes=spikes))
    points = lambda c, p: F.when(c, p).otherwise(F.lit(0.0))
    score = points(constant, F.lit(32.0)) + points(near, F.lit(18.0)) + points(low, F.lit(10.0)) + points(robust, F.least(F.lit(24.0), 8 + 80 * F.col("outlier_count") / n)) + points(tail, F.lit(8.0)) + points(spikes, F.lit(16.0))
    return out.withColumn("risk_score", score).drop("scale")


def contract_readiness(contract: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Readiness of a whole contract, and its risk level."""
    has = lambda f: F.count_if(F.array_contains(F.split("risk_flags", ","), f))
    c = contract.groupBy(*by).agg(
        F.count("*").alias("features"), F.max("n").alias("n"), has("constant").alias("constant"), has("near_constant").alias("near_constant"), has("low_cardinality").alias("low_cardinality"),
        has("robust_range_outliers").alias("outlier"), has("mostly_constant_with_spikes").alias("spike"),
    )
    lost = 14 * F.col("constant") + 8 * F.col("near_constant") + 4 * F.col("low_cardinality") + 8 * F.col("outlier") + 10 * F.col("spike") + F.when(F.col("n") < 20, 8).otherwise(0)
    c = c.withColumn("readiness", F.greatest(F.lit(0), 100 - lost).cast("long"))
    high = (F.col("readiness") < 65) | (F.col("constant") >= 2) | (F.col("spike") >= 2)
    return c.withColumn("risk", F.when(high, "high").when((F.col("readiness") < 84) | (F.col("constant") > 0) | (F.col("outlier") > 0), "medium").otherwise("low"))


def check_contract(rows: DataFrame, contract: DataFrame, features: Sequence[str]) -> DataFrame:
    """Issues of new rows against a contract (one row for each feature, so it is broadcast): row, feature, issue, severity."""
    limits = contract.select("feature_index", "min", "max", "soft_lower", "soft_upper", "observed_values", F.array_contains(F.split("risk_flags", ","), "low_cardinality").alias("coded"))
    long = to_long(rows, features, ("row_id",)).join(F.broadcast(limits), "feature_index")
    v = F.col("value")
    hard = (v < F.col("min")) | (v > F.col("max"))
    soft = ~hard & ((v < F.col("soft_lower")) | (v > F.col("soft_upper")))
    unseen = F.col("coded") & F.col("observed_values").isNotNull() & ~F.exists("observed_values", lambda o: F.abs(o - v) <= 1e-9)
    issue = lambda c, name, severity: F.when(c, F.struct(F.lit(name).alias("issue"), F.lit(severity).alias("severity")))
    found = F.array_compact(F.array(issue(hard, "outside_range", "fail"), issue(soft, "outside_soft_range", "warn"), issue(unseen, "unseen_value", "fail")))
    return long.select("row_id", "feature", "value", F.inline(found))


def contract_status(rows: DataFrame, contract: DataFrame, features: Sequence[str]) -> DataFrame:
    """For every row the number of features that fail or only warn, and its status."""
    per = check_contract(rows, contract, features).groupBy("row_id", "feature").agg(F.bool_or(F.col("severity") == "fail").alias("fails"))
    per = per.groupBy("row_id").agg(F.count_if("fails").alias("failures"), F.count_if(~F.col("fails")).alias("warnings"))
    out = rows.select("row_id").join(per, "row_id", "left").na.fill(0, ["failures", "warnings"])
    return out.withColumn("status", F.when(F.col("failures") > 0, "fail").when(F.col("warnings") > 0, "warn").otherwise("pass"))


def separability(examples: DataFrame, features: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """How well each feature alone tells the classes apart: effect size, AUC, best split, score and flags.

    Values are counted first; running counts over them give the AUC and every split in one pass. A split predicts 1 at
    or above it if high values go with label 1, else at or below it; splits lie between neighbouring values and at both ends.
    """
    key = [*by, "feature_index", "feature"]
    long = to_long(examples, features, (*by, "label"))
    moments = long.groupBy(*key).agg(
        F.count("*").alias("n"), F.sum("label").cast("long").alias("n1"), F.sum(1 - F.col("label")).cast("long").alias("n0"),
        *[F.avg(F.when(F.col("label") == y, F.col("value"))).alias(f"mean{y}") for y in (0, 1)], *[F.coalesce(F.stddev_pop(F.when(F.col("label") == y, F.col("value"))), F.lit(0.0)).alias(f"std{y}") for y in (0, 1)],
    ).where("n >= 6 and n0 >= 2 and n1 >= 2")
    values = long.groupBy(*key, "value").agg(F.sum("label").cast("long").alias("pos"), F.sum(1 - F.col("label")).cast("long").alias("neg"))
    steps = running_sums(values, "value", ["pos", "neg"], key).join(moments.select(*key, "n0", "n1"), key)
    raw = F.sum(F.col("pos") * (F.col("cum_neg") - F.col("neg") + 0.5 * F.col("neg"))) / (F.max("n0") * F.max("n1"))
    auc = steps.groupBy(*key).agg(raw.alias("raw"), F.count("*").alias("unique_count"))
    steps = steps.join(auc.select(*key, "raw"), key).withColumn("high", F.col("raw") >= 0.5)
    # A split just above a value: rows at or below it are on the low side. The split below all values is the empty side.
    below = F.struct(F.col("value").alias("after"), F.col("cum_pos").alias("p"), F.col("cum_neg").alias("q"))
    empty = steps.groupBy(*key).agg(F.lit(None).cast("double").alias("after"), F.lit(0).cast("long").alias("p"), F.lit(0).cast("long").alias("q"), F.max("n0").alias("n0"), F.max("n1").alias("n1"), F.first("high").alias("high"))
    splits = steps.select(*key, below.alias("b"), "n0", "n1", "high").select(*key, "b.*", "n0", "n1", "high").unionByName(empty)
    hit = lambda low: F.when(F.col("high"), F.col("n1") - F.col("p") if low else F.col("q")).otherwise(F.col("p") if low else F.col("n0") - F.col("q"))
    splits = splits.withColumn("tp", hit(True)).withColumn("tn", hit(False))
    bacc, acc = (F.col("tp") / F.col("n1") + F.col("tn") / F.col("n0")) / 2, (F.col("tp") + F.col("tn")) / (F.col("n0") + F.col("n1"))
    best = F.max(F.struct(F.round(bacc, 12).alias("balanced"), F.round(acc, 12).alias("accuracy"), F.when(F.col("after").isNull(), F.lit(float("inf"))).otherwise(-F.col("after")).alias("first")))
    top = splits.groupBy(*key).agg(best.alias("s")).select(*key, F.col("s.balanced").alias("balanced_accuracy"), F.col("s.accuracy").alias("accuracy"), F.when(F.col("s.first") != float("inf"), -F.col("s.first")).alias("split_after"))
    out = moments.join(auc, key).join(top, key)
    pooled = F.sqrt((F.col("std0") ** 2 + F.col("std1") ** 2) / 2)
    out = out.withColumn("effect", F.abs(F.col("mean1") - F.col("mean0")) / F.greatest(pooled, F.lit(1e-12))).withColumn("auc", F.greatest("raw", 1 - F.col("raw")))
    out = out.withColumn("direction", F.when(F.col("raw") >= 0.5, "positive_high").otherwise("positive_low")).withColumn("unique_ratio", F.col("unique_count") / F.col("n"))
    score = 0.5 * (F.col("auc") - 0.5) / 0.5 + 0.3 * (F.col("balanced_accuracy") - 0.5) / 0.5 + 0.2 * F.least(F.col("effect") / 3, F.lit(1.0))
    out = out.withColumn("score", F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0)))
    perfect = (F.col("balanced_accuracy") >= 0.98) & (F.col("auc") >= 0.99)
    return out.withColumn("flags", flags(
        near_perfect=perfect, strong=~perfect & (F.col("auc") >= 0.85), weak=(F.col("auc") <= 0.58) & (F.col("balanced_accuracy") <= 0.62),
        shortcut=(F.col("unique_ratio") <= 0.10) & (F.col("balanced_accuracy") >= 0.90),
    )).drop("raw", "n0", "n1")


def redundant_pairs(examples: DataFrame, features: Sequence[str], threshold: float = 0.92) -> DataFrame:
    """Correlated feature pairs with the smaller of their separability scores; strong if that is at least 0.7."""
    pairs, scores = correlations(examples, features, threshold, None), F.broadcast(separability(examples, features).select("feature", "score"))
    both = pairs.join(scores.withColumnsRenamed({"feature": "left", "score": "a"}), "left").join(scores.withColumnsRenamed({"feature": "right", "score": "b"}), "right")
    return both.select("left", "right", "correlation", F.least("a", "b").alias("min_score"), (F.least("a", "b") >= 0.7).alias("strong"))


def mutual_information(examples: DataFrame, features: Sequence[str], n_bins: int = 5) -> DataFrame:
    """Bits of information between each feature, cut into equal-width bins (last closed), and the label; 0 if constant."""
    long = to_long(examples, features, ("label",))
    limits = long.groupBy("feature_index", "feature").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    part = F.least(F.floor((F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo")) * n_bins), F.lit(n_bins - 1))
    cells = long.join(F.broadcast(limits), ["feature_index", "feature"]).withColumn("bin", F.when(F.col("hi") > F.col("lo"), part).otherwise(0)).groupBy("feature_index", "feature", "bin", "label").agg(F.count("*").alias("n"))
    of = lambda *c: F.sum("n").over(Window.partitionBy("feature_index", *c))
    cells = cells.withColumn("a", of("bin")).withColumn("b", of("label")).withColumn("all", of())
    return cells.groupBy("feature_index", "feature").agg(F.greatest(F.sum(F.col("n") / F.col("all") * F.log2(F.col("n") * F.col("all") / (F.col("a") * F.col("b")))), F.lit(0.0)).alias("mutual_information"))


def label_correlation(examples: DataFrame, features: Sequence[str]) -> DataFrame:
    """Correlation of each feature with the label, 0 where it is undefined."""
    c = to_long(examples, features, ("label",)).groupBy("feature_index", "feature").agg(F.corr("value", F.col("label").cast("double")).alias("c"))
    return c.select("feature_index", "feature", F.coalesce(F.nanvl("c", F.lit(0.0)), F.lit(0.0)).alias("correlation"))


def error_shifts(scored: DataFrame, features: Sequence[str], threshold: float = 0.5, top: int = 8) -> DataFrame:
    """Features by how far their mean differs between wrong and right rows, in deviations."""
    wrong = (F.col("p") >= threshold) != (F.col("label") == 1)
    s = to_long(scored.withColumn("wrong", wrong), features, ("wrong",)).groupBy("feature_index", "feature").agg(
        F.avg(F.when(F.col("wrong"), F.col("value"))).alias("error_mean"), F.avg(F.when(~F.col("wrong"), F.col("value"))).alias("correct_mean"), F.stddev_pop("value").alias("std"))
    s = s.withColumn("shift", (F.col("error_mean") - F.col("correct_mean")) / F.when(F.col("std") < 1e-8, 1.0).otherwise(F.col("std"))).where("shift is not null").drop("std")
    return s.orderBy(F.desc(F.abs("shift")), "feature_index").limit(top)
