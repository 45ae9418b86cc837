"""Sweeps of thresholds, budgets and confidence cutoffs over scored rows, all by prefix counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugework.functions.columns import clip, hash_normal, hash_uniform, ratio, rates, with_rates
from gaugework.plans import laws
from gaugework.plans.patterns import at_ranks, grid, join_groups, running_sums, score_steps, with_totals
from gaugework.plans.scratch import materialize

CAPACITIES = (0.01, 0.02, 0.05, 0.10, 0.15, 0.20, 0.30, 0.40, 0.50, 0.75, 1.0)


def _each_group(points: DataFrame, scored: DataFrame, by: Sequence[str]) -> DataFrame:
    """A small table of points for every group."""
    if not by:
        return points
    return scored.select(*by).distinct().crossJoin(F.broadcast(points))


def threshold_sweep(scored: DataFrame, current: float = 0.5, fp_cost: float = 1.0, fn_cost: float = 5.0, size: int = 101, by: Sequence[str] = ()) -> DataFrame:
    """Confusion, rates and cost at every threshold: an even grid, the current one and all distinct scores."""
    spark = scored.sparkSession
    fixed = grid(spark, 0.0, 1.0, size).union(spark.range(1).select(F.lit(float(current)).alias("t")))
    steps = score_steps(scored, by, extra=_each_group(fixed, scored, by))
    out = steps.select(*by, F.col("t").alias("threshold"), "tp", "fp", (F.col("n_neg") - F.col("fp")).alias("tn"), (F.col("n_pos") - F.col("tp")).alias("fn"))
    return with_rates(out).withColumn("cost", ratio(fp_cost * F.col("fp") + fn_cost * F.col("fn"), F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn")))


def threshold_picks(sweep: DataFrame, recall_target: float = 0.9, precision_target: float = 0.9, by: Sequence[str] = ()) -> DataFrame:
    """Five picks from a sweep, one row each; of equally good thresholds the lowest. A pick without candidates is left out."""
    c = {n: F.col(n) for n in ("f1", "accuracy", "balanced_accuracy", "precision", "recall", "cost", "threshold")}
    low = -c["threshold"]
    picks = {
        "best_f1": (F.lit(True), (c["f1"], c["accuracy"], -c["cost"])),
        "best_balanced": (F.lit(True), (c["balanced_accuracy"], c["f1"], -c["cost"])),
        "min_cost": (F.lit(True), (-c["cost"], c["f1"])),
        "high_recall": (c["recall"] >= recall_target, (c["precision"], c["f1"], -c["cost"])),
        "high_precision": (c["precision"] >= precision_target, (c["recall"], c["f1"], -c["cost"])),
    }
    best = [F.max(F.when(ok, F.struct(*[k.alias(f"k{i}") for i, k in enumerate((*keys, low))], *[c[n].alias(n) for n in c]))).alias(name) for name, (ok, keys) in picks.items()]
    one = sweep.groupBy(*by).agg(*best)
    rows = F.array(*[F.struct(F.lit(n).alias("pick"), *[F.col(f"{n}.{k}").alias(k) for k in c]) for n in picks])
    return one.select(*by, F.inline(rows)).where("threshold is not null")


def optimal_threshold(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The distinct score with the largest F1 as threshold; of equals the one closest to 0.5, then the lowest."""
    steps = score_steps(scored, by).withColumn("f1", ratio(2 * F.col("tp"), F.col("tp") + F.col("fp") + F.col("n_pos")))
    key = F.struct(F.round("f1", 9).alias("a"), (-F.abs(F.col("t") - 0.5)).alias("b"), (-F.col("t")).alias("c"))
    return steps.groupBy(*by).agg(F.max_by("t", key).alias("threshold"), F.max_by("f1", key).alias("f1"))


def decision_curve(scored: DataFrame, current: float = 0.5, size: int = 101, epsilon: float = 1e-6, by: Sequence[str] = ()) -> DataFrame:
    """Net benefit of the model against treating all or none, at grid thresholds and the current one.

    ``useful``: better than both. ``range_id`` numbers the runs of useful thresholds, 0 outside."""
    spark = scored.sparkSession
    now = min(max(current, epsilon), 1 - epsilon)
    points = grid(spark, epsilon, 1 - epsilon, size).union(spark.range(1).select(F.lit(float(now)).alias("t"))).select(F.round("t", 10).alias("t")).distinct()
    marked = _each_group(points.withColumn("_point", F.lit(True)), scored, by)
    steps = score_steps(scored, by, extra=marked).join(marked, [*by, "t"])
    n = F.col("n_pos") + F.col("n_neg")
    odds = F.col("t") / (1 - F.col("t"))
    prevalence = F.col("n_pos") / n
    out = steps.select(*by, F.col("t").alias("threshold"), "tp", "fp", (F.col("tp") / n - F.col("fp") / n * odds).alias("net_benefit"), (prevalence - (1 - prevalence) * odds).alias("treat_all"), odds.alias("_odds"))
    out = out.withColumn("delta", F.col("net_benefit") - F.greatest(F.col("treat_all"), F.lit(0.0))).withColumn("avoided_per_100", F.col("delta") / F.col("_odds") * 100).drop("_odds")
    out = out.withColumn("useful", F.round("delta", 12) > 0)
    order = Window.partitionBy(*by).orderBy("threshold")  # as many rows as the grid has
    starts = (F.col("useful") & ~F.coalesce(F.lag("useful").over(order), F.lit(False))).cast("int")
    out = out.withColumn("_start", starts)
    return out.withColumn("range_id", F.when(F.col("useful"), F.sum("_start").over(order)).otherwise(0).cast("long")).drop("_start")


def capacity_plan(scored: DataFrame, capacities: Sequence[float] = CAPACITIES, benefit: float = 5.0, cost_fp: float = 1.0, cost_action: float = 0.25, by: Sequence[str] = ()) -> DataFrame:
    """For each budget of top-scored rows: precision, recall captured, lift, utility, threshold floor, gain over random."""
    by = list(by)
    totals = scored.groupBy(*by).agg(F.count("*").alias("n"), F.sum("label").cast("long").alias("n_pos"))
    size = F.ceil(F.greatest(F.col("fraction"), 1 / F.col("n")) * F.col("n")).cast("long")
    small = scored.sparkSession.createDataFrame([(float(c),) for c in capacities], "fraction double")
    budgets = with_totals(_each_group(small, scored, by), totals, by).withColumn("k", size).groupBy(*by, "k").agg(F.first("n").alias("n"), F.first("n_pos").alias("n_pos"))
    budgets = materialize(budgets, "budgets")  # a few rows for each group
    # Only the buckets that hold the last row of a budget are put in order.
    last = at_ranks(scored.select(*by, "row_id", "p", "label"), -F.col("p"), budgets.select(*by, "k"), "row_id", by, ["label"])
    last = last.select(*by, F.col("rank").alias("k"), F.col("cum_label").cast("long").alias("tp"), F.col("p").alias("threshold_floor"))
    out = join_groups(budgets, last, [*by, "k"])
    out = out.withColumn("fp", F.col("k") - F.col("tp")).withColumn("precision", F.col("tp") / F.col("k")).withColumn("recall", ratio(F.col("tp"), F.col("n_pos")))
    prevalence = F.col("n_pos") / F.col("n")
    out = out.withColumn("lift", ratio(F.col("precision"), prevalence)).withColumn("f1", ratio(2 * F.col("tp"), F.col("k") + F.col("n_pos")))
    out = out.withColumn("utility", benefit * F.col("tp") - cost_fp * F.col("fp") - cost_action * F.col("k"))
    chance = F.col("k") * prevalence
    out = out.withColumn("gain_over_random", F.col("utility") - (benefit * chance - cost_fp * (F.col("k") - chance) - cost_action * F.col("k")))
    return out.withColumn("fraction", F.col("k") / F.col("n")).drop("n")


def capacity_verdict(plan: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The budget with the best utility (then precision, then the smaller), and what to make of it."""
    key = F.struct(F.col("utility"), F.col("precision"), -F.col("fraction"))
    best = plan.groupBy(*by).agg(F.max_by(F.struct("k", "utility", "precision", "recall", "n_pos"), key).alias("b")).select(*by, "b.*")
    verdict = F.when(F.col("n_pos") == 0, "no_positive_evidence").when((F.col("utility") <= 0) | (F.col("precision") <= 0), "not_actionable").when(F.col("recall") < 0.2, "low_capture_review").otherwise("actionable_capacity_plan")
    return best.withColumn("verdict", verdict).drop("n_pos")


def action_queue(scored: DataFrame, k: int = 12) -> DataFrame:
    """The k rows with the largest scores, ties by row_id."""
    return scored.orderBy(F.desc("p"), "row_id").limit(k)


def confidence(p: Column, t: float, epsilon: float = 1e-6) -> Column:
    """Distance of a score from the threshold as a share of the largest possible, rounded to 10 places."""
    t = min(max(t, epsilon), 1 - epsilon)
    return F.round(clip(F.abs(p - t) / max(t, 1 - t, 1e-6), 0.0, 1.0), 10)


def selective_risk(scored: DataFrame, threshold: float = 0.5, size: int = 21, by: Sequence[str] = ()) -> DataFrame:
    """Coverage, error, F1 and abstained error at every confidence cutoff: an even grid and all distinct confidences."""
    by = list(by)
    rows = scored.withColumn("c", confidence(F.col("p"), threshold)).withColumn("hit", F.col("p") >= threshold)
    cells = {"tp": F.col("hit") & (F.col("label") == 1), "fp": F.col("hit") & (F.col("label") == 0), "tn": ~F.col("hit") & (F.col("label") == 0), "fn": ~F.col("hit") & (F.col("label") == 1)}
    per = rows.groupBy(*by, "c").agg(*[F.sum(v.cast("long")).alias(k) for k, v in cells.items()])
    top = rows.groupBy(*by).agg(F.max("c").alias("_top"), *[F.sum(v.cast("long")).alias(f"all_{k}") for k, v in cells.items()])
    share = scored.sparkSession.range(size).select((F.col("id") / (size - 1)).alias("_share"))
    points = with_totals(_each_group(share, scored, by), top, by).select(*by, F.round(F.col("_share") * F.col("_top"), 10).alias("c"), *[F.lit(0).cast("long").alias(k) for k in cells])
    per = per.unionByName(points).groupBy(*by, "c").agg(*[F.sum(k).alias(k) for k in cells])
    out = with_totals(running_sums(per, "c", list(cells), by, descending=True), top.drop("_top"), by)
    kept = F.col("cum_tp") + F.col("cum_fp") + F.col("cum_tn") + F.col("cum_fn")
    total = F.col("all_tp") + F.col("all_fp") + F.col("all_tn") + F.col("all_fn")
    wrong = F.col("cum_fp") + F.col("cum_fn")
    r = rates(*[F.col(f"cum_{k}") for k in ("tp", "fp", "tn", "fn")])
    return out.select(
        *by, F.col("c").alias("cutoff"), kept.alias("selected"), ratio(kept, total).alias("coverage"), ratio(wrong, kept).alias("error"), r["f1"].alias("f1"), r["accuracy"].alias("accuracy"),
        ratio(F.col("all_fp") + F.col("all_fn") - wrong, total - kept).alias("abstained_error"),
    )


def selective_targets(curve: DataFrame, targets: Sequence[float] = (0.01, 0.05, 0.10), by: Sequence[str] = ()) -> DataFrame:
    """For each tolerated error, the cutoff with the largest coverage; none where no cutoff is good enough."""
    rows = curve.where("selected > 0")
    best = [F.max(F.when(F.col("error") <= t, F.struct("coverage", (-F.col("error")).alias("e"), (-F.col("cutoff")).alias("c")))).alias(f"b{i}") for i, t in enumerate(targets)]
    one = rows.groupBy(*by).agg(*best)
    return one.select(*by, F.inline(F.array(*[F.struct(F.lit(float(t)).alias("target"), F.col(f"b{i}.coverage").alias("coverage"), (-F.col(f"b{i}.e")).alias("error"), (-F.col(f"b{i}.c")).alias("cutoff")) for i, t in enumerate(targets)])))


def selective_area(curve: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Area under the error over coverage, by trapezoids between neighbouring coverages.

    Neighbours inside a bucket of coverage come from a window over it; the few buckets' ends are joined to the next."""
    by = list(by)
    points = curve.where("selected > 0").groupBy(*by, "coverage").agg(F.max("error").alias("error")).withColumn("_bucket", F.floor(F.col("coverage") * 64).cast("int"))
    inside = Window.partitionBy(*by, "_bucket").orderBy("coverage")
    ends = points.groupBy(*by, "_bucket").agg(F.max(F.struct("coverage", "error")).alias("end"))
    ends = ends.withColumn("before", F.lag("end").over(Window.partitionBy(*by).orderBy("_bucket"))).drop("end")
    rows = points.withColumn("prev", F.lag(F.struct("coverage", "error")).over(inside)).join(ends, [*by, "_bucket"])
    prev = F.coalesce("prev", "before")
    return rows.groupBy(*by).agg(F.coalesce(F.sum((F.col("coverage") - prev["coverage"]) * (F.col("error") + prev["error"]) / 2), F.lit(0.0)).alias("aurc"), F.min("error").alias("min_error"))


def threshold_stability(scored: DataFrame, current: float = 0.5, replicates: int = 80, size: int = 101, seed: int = 42) -> DataFrame:
    """Stratified bootstrap of the best grid threshold: one row of quantiles, spread and verdict.

    A replicate draws as many rows of each label as there are, with replacement; only their counts in the grid's cells matter,
    which follow a multinomial law. Independent Poisson numbers with a total mean of 12 standard deviations less than the
    label's n rows have that law once their total is known, and what is missing from n is drawn row by row: about 12 sqrt(n)
    draws instead of n, and the rows are counted once."""
    spark = scored.sparkSession
    cells = scored.groupBy(F.floor(F.col("p") * (size - 1) + 1e-9).cast("int").alias("cell")).agg(F.sum("label").cast("long").alias("pos"), F.sum(1 - F.col("label")).cast("long").alias("neg"))
    frame = spark.range(replicates).select(F.col("id").cast("int").alias("rep")).crossJoin(F.broadcast(spark.range(size).select(F.col("id").cast("int").alias("cell"))))
    kinds = ("pos", "neg")
    long = cells.select("cell", F.inline(F.array(*[F.struct(F.lit(c).alias("kind"), F.col(c).alias("rows")) for c in kinds]))).where("rows > 0")
    within = Window.partitionBy("kind")  # as many rows as the grid has cells
    long = long.withColumn("n", F.sum("rows").over(within)).withColumn("upto", F.sum("rows").over(within.orderBy("cell")))
    drawn_first = F.greatest(F.lit(0.0), F.col("n") - laws.TAIL * F.sqrt("n"))
    long = materialize(long.withColumn("mean", drawn_first * F.col("rows") / F.col("n")), "cells")
    tables = materialize(laws.poisson_tables(long, "mean", ["kind", "cell"]), "tables")
    salt = F.concat(F.lit("boot"), F.col("kind"), F.lit(":"), F.col("cell"))
    reps = spark.range(replicates).select(F.col("id").cast("int").alias("rep"))
    first = reps.crossJoin(F.broadcast(tables)).select("rep", "kind", "cell", laws.poisson_draw(hash_uniform(F.col("rep"), seed, salt), hash_normal(F.col("rep"), seed, salt)).alias("m"))
    first = materialize(first, "first")
    sizes = long.groupBy("kind").agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("upto", "cell"))).alias("_u"))
    left = first.groupBy("rep", "kind").agg(F.sum("m").alias("m")).join(F.broadcast(sizes), "kind")
    each = left.where("n > m").select("rep", "kind", "n", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n") - F.col("m"))).alias("i"))
    place = F.floor(hash_uniform(F.concat_ws(":", F.col("rep").cast("string"), F.col("i").cast("string")), seed, F.concat(F.lit("rest"), F.col("kind"))) * F.col("n"))
    # Counted by place first, so that a place is looked up once.
    places = each.groupBy("rep", "kind", place.alias("place")).agg(F.count("*").alias("m")).join(F.broadcast(sizes.select("kind", "_u")), "kind")
    more = places.select("rep", "kind", F.get(F.filter("_u", lambda u: u["upto"] > F.col("place")), F.lit(0))["cell"].alias("cell"), "m").groupBy("rep", "kind", "cell").agg(F.sum("m").alias("m"))
    drawn = first.unionByName(more).groupBy("rep", "cell").agg(*[F.sum(F.when(F.col("kind") == c, F.col("m")).otherwise(0)).alias(c) for c in kinds])
    cells = frame.join(F.broadcast(drawn), ["rep", "cell"], "left").na.fill(0, ["pos", "neg"])  # a row for each replicate and cell of the grid
    down = Window.partitionBy("rep").orderBy(F.desc("cell")).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("rep")
    cells = cells.select("rep", (F.col("cell") / (size - 1)).alias("t"), F.sum("pos").over(down).alias("tp"), F.sum("neg").over(down).alias("fp"), F.sum("pos").over(whole).alias("P"), F.sum("neg").over(whole).alias("N"))
    r = rates(F.col("tp"), F.col("fp"), F.col("N") - F.col("fp"), F.col("P") - F.col("tp"))
    key = F.struct(F.round(r["f1"], 9).alias("a"), F.round(r["balanced_accuracy"], 9).alias("b"), F.round(r["accuracy"], 9).alias("c"), (-F.round(F.abs(F.col("t") - current), 9)).alias("d"), (-F.col("t")).alias("e"))
    now = F.max(F.when(F.abs(F.col("t") - current) < 1e-9, r["f1"]))
    best = cells.groupBy("rep").agg(F.max_by("t", key).alias("t"), (F.max(r["f1"]) - F.coalesce(now, F.lit(0.0))).alias("gain"))
    q = best.agg(F.percentile("t", F.array(*[F.lit(x) for x in (0.05, 0.25, 0.5, 0.75, 0.95)])).alias("q"), F.percentile("gain", F.lit(0.5)).alias("median_gain"))
    out = q.select(*[F.get("q", F.lit(i)).alias(n) for i, n in enumerate(("q05", "q25", "q50", "q75", "q95"))], "median_gain")
    out = out.withColumn("spread", F.col("q95") - F.col("q05")).withColumn("outside", ~F.lit(current).between(F.col("q05"), F.col("q95")))
    unstable = (F.col("spread") >= 0.35) | (F.col("outside") & (F.col("median_gain") >= 0.08))
    review = (F.col("spread") >= 0.18) | (F.col("q75") - F.col("q25") >= 0.10) | F.col("outside") | (F.col("median_gain") >= 0.04)
    return out.withColumn("verdict", F.when(unstable, "unstable_threshold").when(review, "threshold_review").otherwise("stable_threshold"))
