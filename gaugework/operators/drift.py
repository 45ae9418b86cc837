"""Change over order or time: population drift, replay of a fixed model in windows, runs of errors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugework.functions.columns import flags, with_rates
from gaugework.operators.metrics import confusion_aggs, probability_aggs
from gaugework.operators.prep import order_split
from gaugework.plans.patterns import ranked, running_sums, to_long, with_totals
from gaugework.plans.scratch import materialize
from gaugework.plans.selection import quantiles


def population_drift(sided: DataFrame, features: Sequence[str], n_bins: int = 10) -> DataFrame:
    """Drift of each feature between the sides (column ``side``: reference, current): PSI, KS, mean shift, values outside the
    reference's range, ratio of deviations, flags and rank by their risk."""
    key = ["feature_index", "feature"]
    long = to_long(sided, features, ("side",))
    ref, cur = F.col("side") == "reference", F.col("side") == "current"
    of = lambda f, c: f(F.when(c, F.col("value")))
    base = long.groupBy(*key).agg(
        F.count_if(ref).alias("n_ref"), F.count_if(cur).alias("n_cur"), of(F.avg, ref).alias("m0"), of(F.avg, cur).alias("m1"), of(F.stddev_pop, ref).alias("s0"), of(F.stddev_pop, cur).alias("s1"), of(F.min, ref).alias("lo"), of(F.max, ref).alias("hi"),
    )
    edges = quantiles(long.where(ref), "value", [i / n_bins for i in range(1, n_bins)], key, "edges")
    base = materialize(base.join(F.broadcast(edges.withColumn("edges", F.array_sort(F.array_distinct("edges")))), key), "base")  # a row for each feature
    counts = long.groupBy(*key, "value").agg(F.count_if(ref).alias("r"), F.count_if(cur).alias("c"))
    steps = running_sums(counts, "value", ["r", "c"], key).join(F.broadcast(base), key)
    gaps = steps.groupBy(*key).agg(
        F.max(F.abs(F.col("cum_r") / F.col("n_ref") - F.col("cum_c") / F.col("n_cur"))).alias("ks"),
        F.sum(F.when((F.col("value") < F.col("lo")) | (F.col("value") > F.col("hi")), F.col("c")).otherwise(0)).alias("outside"),
    )
    bin_ = F.size(F.filter("edges", lambda e: e <= F.col("value")))
    hist = steps.groupBy(*key, bin_.alias("bin")).agg((F.sum("r") / F.max("n_ref")).alias("r"), (F.sum("c") / F.max("n_cur")).alias("c"))
    a, b = F.greatest("r", F.lit(1e-6)), F.greatest("c", F.lit(1e-6))
    psi = hist.groupBy(*key).agg(F.sum((b - a) * F.log(b / a)).alias("psi"))
    out = base.join(F.broadcast(gaps), key).join(F.broadcast(psi), key)
    scale = lambda s: F.when(F.col(s) < 1e-6, 1.0).otherwise(F.col(s))
    out = out.withColumn("mean_shift", F.abs(F.col("m1") - F.col("m0")) / scale("s0")).withColumn("outside_rate", F.col("outside") / F.col("n_cur")).withColumn("std_ratio", F.col("s1") / scale("s0"))
    out = out.withColumn("risk", F.col("psi") + F.col("ks") + F.least(F.col("mean_shift"), F.lit(5.0)) / 5 + F.col("outside_rate"))
    big = F.col("psi") >= 0.25
    out = out.withColumn("flags", flags(
        major_psi_shift=big, moderate_psi_shift=~big & (F.col("psi") >= 0.10), major_ks_shift=F.col("ks") >= 0.30, moderate_ks_shift=(F.col("ks") < 0.30) & (F.col("ks") >= 0.20),
        mean_shift=F.col("mean_shift") >= 1, outside_reference=F.col("outside_rate") >= 0.10, spread_change=(F.col("std_ratio") >= 2) | (F.col("std_ratio") <= 0.5),
    ))
    order = Window.orderBy(F.desc(F.round("risk", 9)), "feature_index")  # one row for each feature
    return out.select(*key, "n_ref", "n_cur", "psi", "ks", "mean_shift", "outside_rate", "std_ratio", "risk", "flags").withColumn("rank", F.row_number().over(order))


def label_shift(sided: DataFrame) -> DataFrame:
    """Prevalence on both sides and its change."""
    one = sided.agg(*[F.avg(F.when(F.col("side") == s, F.col("label").cast("double"))).alias(f"{s}_prevalence") for s in ("reference", "current")])
    return one.withColumn("prevalence_shift", F.col("current_prevalence") - F.col("reference_prevalence"))


def drift_by_order(rows: DataFrame, features: Sequence[str], order: Column, fraction: float = 0.5, n_bins: int = 10) -> DataFrame:
    return population_drift(order_split(rows, order, fraction), features, n_bins)


def shadow_replay(scored: DataFrame, order: Column, windows: int = 5, min_size: int = 8, threshold: float = 0.5) -> DataFrame:
    """A fixed model over equal consecutive windows: metrics, change against the first window, degradation score and flag."""
    n = scored.agg(F.count("*").alias("_n"))
    rows = with_totals(ranked(scored, order, "row_id", (), "_rank"), n)
    count = F.when(F.col("_n") < 2 * min_size, F.lit(2)).otherwise(F.least(F.lit(windows), F.greatest(F.lit(2), F.floor(F.col("_n") / min_size)))).cast("int")
    rows = rows.withColumn("_count", count).withColumn("_i", F.col("_rank") - 1)
    # Window j holds places rint(j n / count) up to rint((j + 1) n / count).
    bounds = F.transform(F.sequence(F.lit(1), F.col("_count")), lambda j: F.rint(j * F.col("_n") / F.col("_count")))
    rows = rows.withColumn("window", F.size(F.filter(bounds, lambda b: b <= F.col("_i"))))
    per = with_rates(rows.groupBy("window").agg(F.count("*").alias("n"), F.min("_i").alias("first_index"), *confusion_aggs(threshold), *probability_aggs()))
    first = Window.orderBy("window")  # a few windows
    delta = {f"{m}_delta": F.col(m) - F.first(m).over(first) for m in ("f1", "accuracy", "brier", "prevalence")}
    per = per.withColumns(delta)
    down = lambda m: F.greatest(F.lit(0.0), -F.col(f"{m}_delta"))
    score = 100 * (0.45 * down("f1") + 0.25 * down("accuracy") + 0.20 * F.greatest(F.lit(0.0), F.col("brier_delta")) + 0.10 * F.abs("prevalence_delta"))
    per = per.withColumn("degradation", score).withColumn("flagged", (F.col("f1_delta") <= -0.15) | (F.col("accuracy_delta") <= -0.15) | (F.col("brier_delta") >= 0.08))
    return per.select("window", "n", "first_index", "f1", "accuracy", "brier", "log_loss", "prevalence", "f1_delta", "accuracy_delta", "brier_delta", "prevalence_delta", "degradation", "flagged")


def replay_verdict(replay: DataFrame) -> DataFrame:
    """One row for a replay: its largest drops and what they mean."""
    one = replay.agg(F.min("n").alias("smallest"), F.min("f1_delta").alias("f1"), F.min("accuracy_delta").alias("accuracy"), F.max("brier_delta").alias("brier"), F.count_if("flagged").alias("flagged_windows"), F.max("degradation").alias("worst_degradation"))
    severe = (F.col("f1") <= -0.30) | (F.col("accuracy") <= -0.25) | (F.col("brier") >= 0.12)
    review = (F.col("f1") <= -0.15) | (F.col("accuracy") <= -0.15) | (F.col("brier") >= 0.08) | (F.col("flagged_windows") > 0)
    verdict = F.when(F.col("smallest") < 5, "thin_ordered_evidence").when(severe, "severe_ordered_degradation").when(review, "ordered_degradation_review").otherwise("stable_ordered_replay")
    return one.select("flagged_windows", "worst_degradation", verdict.alias("verdict"))


def error_runs(scored: DataFrame, order: Column, threshold: float = 0.5, top: int | None = 12, by: Sequence[str] = ()) -> DataFrame:
    """Runs of consecutive wrong rows in order, longest first: length, first place, mean loss.

    Among the wrong rows alone, a run is where place less number of wrong rows so far stays the same."""
    by = list(by)
    wrong = (F.col("p") >= threshold) != (F.col("label") == 1)
    loss = -F.log(F.greatest(F.when(F.col("label") == 1, F.col("p")).otherwise(1 - F.col("p")), F.lit(1e-7)))
    rows = ranked(scored.withColumn("_wrong", wrong).withColumn("_loss", loss), order, "row_id", by, "_place").where("_wrong")
    rows = ranked(rows, F.col("_place"), "row_id", by, "_nth").withColumn("_island", F.col("_place") - F.col("_nth"))
    runs = rows.groupBy(*by, "_island").agg(F.count("*").alias("length"), (F.min("_place") - 1).alias("start"), F.avg("_loss").alias("mean_loss"), F.min("row_id").alias("first_row")).drop("_island")
    return runs.orderBy(F.desc("length"), F.desc(F.round("mean_loss", 9)), "start").limit(top) if top else runs

