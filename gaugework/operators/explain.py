"""How a scorer responds: importance, ablation, dependence, interaction, stress, attribution, counterfactuals, policies.

A scorer is a function of feature columns that gives a score column, so every perturbation is an expression, and rows
meet only tables of fixed size (grids, scenarios, moves, policies)."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugework.functions.columns import flags, hash_normal, hash_uniform, ratio, with_rates
from gaugework.operators.metrics import confusion_aggs, probability_aggs, ranking_metrics
from gaugework.plans.patterns import ranked, to_long, with_totals
from gaugework.plans.scratch import materialize
from gaugework.plans.selection import quantiles, wide_quantiles

Scorer = Callable[..., Column]


def scored_by(df: DataFrame, features: Sequence[str], scorer: Scorer, name: str = "p") -> DataFrame:
    return df.withColumn(name, scorer(*[F.col(f) for f in features]))


def dealt(rows: DataFrame, features: Sequence[str], repeats: int = 5, seed: int = 42, salt: str = "perm") -> DataFrame:
    """``rows`` with ``_dealt``: for each repeat the features of another row, so that over all rows each is given once a repeat.

    Rows are put in the order of their hash once; in repeat r a row gets the values of the one that stands a hashed number of
    places (not 0) after it, the first following the last. One rank, and one shuffle of rows times repeats."""
    placed = with_totals(ranked(rows, hash_uniform(F.col("row_id"), seed, salt), "row_id", (), "_place"), rows.agg(F.count("*").alias("_rows")))
    shifts = [(F.lit(1) + F.floor(hash_uniform(F.lit(r), seed, f"{salt}shift") * (F.col("_rows") - 1))).cast("long") for r in range(repeats)]
    own, values = F.struct(*[F.col(f"`{c}`") for c in rows.columns]), F.struct(*features)
    kept = F.struct(F.col("_place").alias("_to"), F.lit(-1).alias("_r"), own.alias("_own"), F.lit(None).cast(_kind(rows, features)).alias("_v"))
    none = F.lit(None).cast(rows.select(own.alias("o")).schema[0].dataType)
    given = [F.struct((F.pmod(F.col("_place") - 1 - shift, F.col("_rows")) + 1).alias("_to"), F.lit(r).alias("_r"), none.alias("_own"), values.alias("_v")) for r, shift in enumerate(shifts)]
    met = placed.select(F.inline(F.array(kept, *given))).groupBy("_to")
    met = met.agg(F.first("_own", ignorenulls=True).alias("_own"), F.array_sort(F.collect_list(F.when(F.col("_r") >= 0, F.struct("_r", "_v")))).alias("_dealt"))
    return met.select("_own.*", F.transform("_dealt", lambda d: d["_v"]).alias("_dealt"))


def _kind(rows: DataFrame, features: Sequence[str]):
    return rows.select(F.struct(*features).alias("v")).schema[0].dataType


def _swapped(rows: DataFrame, features: Sequence[str], scorer: Scorer, repeats: int, keep: Sequence[Column | str]) -> DataFrame:
    """Of rows with ``_dealt``: a row for each feature and repeat, with the score ``p`` after that feature's value is swapped."""
    made = []
    for i, f in enumerate(features):
        for r in range(repeats):
            new = F.get("_dealt", F.lit(r))[f]
            made.append(F.struct(F.lit(i).alias("feature_index"), F.lit(f).alias("feature"), F.lit(r).alias("repeat"), scorer(*[new if g == f else F.col(g) for g in features]).alias("p")))
    return rows.select(*keep, F.inline(F.array(*made)))


def permutation_importance(examples: DataFrame, features: Sequence[str], scorer: Scorer, repeats: int = 5, seed: int = 42, threshold: float = 0.5) -> DataFrame:
    """Loss of accuracy when a feature's values are dealt out anew (see ``dealt``), the mean over the repeats."""
    base = with_rates(scored_by(examples, features, scorer).agg(*confusion_aggs(threshold))).select(F.col("accuracy").alias("base_accuracy"))
    both = dealt(examples.select("row_id", "label", *features), features, repeats, seed)
    long = _swapped(both, features, scorer, repeats, ["label"])
    per = with_totals(with_rates(long.groupBy("feature_index", "feature", "repeat").agg(*confusion_aggs(threshold))), base)
    return per.groupBy("feature_index", "feature").agg(F.max("base_accuracy").alias("base_accuracy"), F.avg("accuracy").alias("permuted_accuracy"), (F.max("base_accuracy") - F.avg("accuracy")).alias("importance"))


def permutation_reliance(examples: DataFrame, features: Sequence[str], scorer: Scorer, repeats: int = 5, seed: int = 42, threshold: float = 0.5) -> DataFrame:
    """What a fixed model loses by a feature's values dealt out anew: F1, log loss, moved scores, and a risk score of the three
    by which features are ranked."""
    rows = scored_by(examples.select("row_id", "label", *features), features, scorer, "p0")
    base = with_rates(rows.withColumnRenamed("p0", "p").agg(*confusion_aggs(threshold), *probability_aggs())).select(F.col("f1").alias("_f1"), F.col("log_loss").alias("_loss"))
    long = _swapped(dealt(rows, features, repeats, seed), features, scorer, repeats, ["label", "p0"])
    per = with_rates(long.groupBy("feature_index", "feature", "repeat").agg(*confusion_aggs(threshold), *probability_aggs(), F.avg(F.abs(F.col("p") - F.col("p0"))).alias("moved")))
    out = with_totals(per, base).groupBy("feature_index", "feature").agg(
        F.count("*").alias("repeats"), F.avg(F.col("_f1") - F.col("f1")).alias("f1_drop"), F.avg(F.col("log_loss") - F.col("_loss")).alias("log_loss_increase"), F.avg("moved").alias("mean_shift"),
    )
    out = out.withColumn("risk", F.greatest(F.lit(0.0), "f1_drop") + 0.25 * F.greatest(F.lit(0.0), "log_loss_increase") + 0.25 * F.col("mean_shift"))
    return out.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(F.round("risk", 9)), "feature_index")))  # one row for each feature


def permutation_drivers(examples: DataFrame, features: Sequence[str], scorer: Scorer, seed: int = 42) -> DataFrame:
    """What one dealing out of a feature costs a model: AUC, accuracy at 0.5, moved scores, and the driver score of the three."""
    rows = scored_by(examples.select("row_id", "label", *features), features, scorer, "p0")
    plain = rows.select("label", F.col("p0").alias("p"))
    base = with_totals(ranking_metrics(plain).select(F.col("roc_auc").alias("_auc")), with_rates(plain.agg(*confusion_aggs(0.5))).select(F.col("accuracy").alias("_acc")))
    long = _swapped(materialize(dealt(rows, features, 1, seed), "dealt"), features, scorer, 1, ["label", "p0"])
    per = with_rates(long.groupBy("feature_index", "feature").agg(*confusion_aggs(0.5), F.avg(F.abs(F.col("p") - F.col("p0"))).alias("mean_shift")))
    auc = ranking_metrics(long, ["feature_index"]).select("feature_index", "roc_auc")
    out = with_totals(per.join(F.broadcast(auc), "feature_index"), base)  # one row for each feature
    out = out.select("feature_index", "feature", (F.col("_auc") - F.col("roc_auc")).alias("auc_drop"), (F.col("_acc") - F.col("accuracy")).alias("accuracy_drop"), "mean_shift")
    out = out.withColumn("score", F.greatest(F.lit(0.0), "auc_drop") + 0.5 * F.greatest(F.lit(0.0), "accuracy_drop") + 0.25 * F.col("mean_shift"))
    return out.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(F.round("score", 9)), "feature_index")))


def ablation(examples: DataFrame, features: Sequence[str], scorer: Scorer, threshold: float = 0.5, seed: int = 42) -> DataFrame:
    """Each feature set to its median, and dealt out anew: loss of F1, flipped decisions, moved scores, reliance and flags."""
    rows = scored_by(examples, features, scorer)
    base = with_rates(rows.agg(*confusion_aggs(threshold))).select(F.col("f1").alias("base_f1"))
    middle = wide_quantiles(examples, features, [0.5]).select(*[F.get(f"_q_{f}", F.lit(0)).alias(f"_m_{f}") for f in features])
    moments = rows.agg(*[F.stddev_pop(f).alias(f"_s_{f}") for f in features], *[F.corr(f, F.col("label").cast("double")).alias(f"_c_{f}") for f in features])
    both = with_totals(with_totals(dealt(rows.select("row_id", "label", "p", *features), features, 1, seed, "ablate"), moments), middle)
    made = []
    for i, f in enumerate(features):
        swap = lambda new, f=f: scorer(*[new if g == f else F.col(g) for g in features])
        for kind, new in (("neutral", F.col(f"_m_{f}")), ("permuted", F.get("_dealt", F.lit(0))[f])):
            made.append(F.struct(F.lit(i).alias("feature_index"), F.lit(f).alias("feature"), F.lit(kind).alias("kind"), swap(new).alias("q"), F.col(f"_s_{f}").alias("std"), F.col(f"_c_{f}").alias("corr")))
    long = both.select("label", F.col("p").alias("p0"), F.inline(F.array(*made))).withColumnRenamed("q", "p")
    flip, move = F.avg(((F.col("p") >= threshold) != (F.col("p0") >= threshold)).cast("double")), F.avg(F.abs(F.col("p") - F.col("p0")))
    per = with_totals(with_rates(long.groupBy("feature_index", "feature", "kind").agg(*confusion_aggs(threshold), flip.alias("flip"), move.alias("move"), F.max("std").alias("std"), F.max("corr").alias("corr"))), base)
    of = lambda c, k: F.max(F.when(F.col("kind") == k, F.col(c)))
    out = per.groupBy("feature_index", "feature").agg(
        (F.max("base_f1") - of("f1", "neutral")).alias("drop_neutral"), (F.max("base_f1") - of("f1", "permuted")).alias("drop_permuted"), F.max("flip").alias("max_flip"), F.max("move").alias("max_shift"), F.coalesce(F.max("corr"), F.lit(0.0)).alias("label_correlation"), F.max("std").alias("_std"),
    )
    out = out.withColumn("reliance", F.greatest(F.lit(0.0), "drop_neutral", "drop_permuted") + 0.25 * F.col("max_flip") + 0.1 * F.col("max_shift"))
    return out.withColumn("flags", flags(
        f1_reliance=F.greatest("drop_neutral", "drop_permuted") >= 0.15, decision_flips=F.col("max_flip") >= 0.2, label_proxy=F.abs("label_correlation") >= 0.85, constant=F.col("_std") < 1e-8,
    )).drop("_std")


def value_grid(examples: DataFrame, features: Sequence[str], size: int, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """``size`` even steps between two quantiles of each feature (range, if they are equal; one value, if constant): rows
    (feature_index, feature, step, value)."""
    long = to_long(examples, features, ())
    q = quantiles(long, "value", [0.0, low, high, 1.0], ["feature_index", "feature"]).select("*", F.get("q", F.lit(0)).alias("lo"), F.get("q", F.lit(3)).alias("hi"))
    a, b = F.get("q", F.lit(1)), F.get("q", F.lit(2))
    q = q.withColumn("a", F.when(a < b, a).otherwise(F.col("lo"))).withColumn("b", F.when(a < b, b).otherwise(F.col("hi")))
    steps = F.sequence(F.lit(0), F.when(F.col("a") < F.col("b"), F.lit(size - 1)).otherwise(F.lit(0)))
    return q.withColumn("step", F.explode(steps)).select("feature_index", "feature", "step", (F.col("a") + F.col("step") * (F.col("b") - F.col("a")) / (size - 1)).alias("value"))


def partial_dependence(examples: DataFrame, features: Sequence[str], scorer: Scorer, size: int = 9) -> DataFrame:
    """Distribution of scores with one feature held at each step of its grid: mean, deviation, 10 % and 90 %."""
    grid = materialize(value_grid(examples, features, size), "grid")  # features times size rows
    held = examples.select(*features).crossJoin(F.broadcast(grid))
    swapped = [F.when(F.col("feature_index") == i, F.col("value")).otherwise(F.col(f)) for i, f in enumerate(features)]
    rows = held.withColumn("p", scorer(*swapped))
    key = ["feature_index", "feature", "step", "value"]
    out = rows.groupBy(*key).agg(F.avg("p").alias("mean"), F.stddev_pop("p").alias("std")).join(F.broadcast(quantiles(rows, "p", [0.1, 0.9], key)), key)
    return out.select("feature_index", "feature", "step", "value", "mean", "std", F.get("q", F.lit(0)).alias("p10"), F.get("q", F.lit(1)).alias("p90"))


def response_summary(dependence: DataFrame) -> DataFrame:
    """Range, direction and turns of each feature's mean response; small steps (under 1 % of the range) do not turn it."""
    order = Window.partitionBy("feature_index").orderBy("step")
    rows = dependence.withColumn("d", F.col("mean") - F.lag("mean").over(order)).withColumn("range", F.max("mean").over(Window.partitionBy("feature_index")) - F.min("mean").over(Window.partitionBy("feature_index")))
    kept = F.when(F.abs("d") >= 0.01 * F.col("range"), F.signum("d"))
    rows = rows.withColumn("sign", kept).withColumn("prev", F.last("sign", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    turns = F.count_if((F.col("sign") != F.col("prev")) & (F.col("range") >= 1e-6))
    s = rows.groupBy("feature_index", "feature").agg(F.max("range").alias("range"), turns.alias("turns"), (F.max_by("mean", "step") - F.min_by("mean", "step")).alias("change"))
    direction = F.when(F.col("range") < 1e-6, "flat").when(F.col("turns") > 0, "nonmonotonic").when(F.col("change") > 0, "increasing").otherwise("decreasing")
    return s.withColumn("direction", direction).withColumn("high_impact", F.col("range") >= 0.2)


def interactions(examples: DataFrame, features: Sequence[str], scorer: Scorer, size: int = 5) -> DataFrame:
    """For each pair of features, how far the mean score over a grid of both is from the sum of its two margins."""
    g = materialize(value_grid(examples, features, size), "g")  # features times size rows
    cells = None
    for i, j in combinations(range(len(features)), 2):
        a = g.where(F.col("feature_index") == i).select(F.col("step").alias("row"), F.col("value").alias("_a"))
        b = g.where(F.col("feature_index") == j).select(F.col("step").alias("col"), F.col("value").alias("_b"))
        held = examples.select(*features).crossJoin(F.broadcast(a.crossJoin(F.broadcast(b))))  # size squared cells
        p = scorer(*[F.col("_a") if k == i else F.col("_b") if k == j else F.col(f) for k, f in enumerate(features)])
        part = held.groupBy("row", "col").agg(F.avg(p).alias("s")).withColumn("left", F.lit(features[i])).withColumn("right", F.lit(features[j]))
        cells = part if cells is None else cells.unionByName(part)
    by = lambda *c: Window.partitionBy("left", "right", *c)
    mean = lambda *c: F.avg("s").over(by(*c))
    cells = cells.withColumn("grand", mean()).withColumn("residual", F.col("s") - (mean("row") + mean("col") - F.col("grand")))
    up = F.col("s") >= 0.5
    cross = lambda fixed, step: F.coalesce((up != F.lag(up).over(by(fixed).orderBy(step))).cast("int"), F.lit(0))
    cells = cells.withColumn("crossed", cross("row", "col") + cross("col", "row"))
    out = cells.groupBy("left", "right").agg(F.sum(F.col("residual") ** 2).alias("_r"), F.sum((F.col("s") - F.col("grand")) ** 2).alias("_t"), F.max(F.abs("residual")).alias("max_residual"), F.sum("crossed").alias("crossings"))
    return out.withColumn("strength", F.least(F.sqrt(ratio(F.col("_r"), F.col("_t"))), F.lit(1.0))).drop("_r", "_t").withColumn("flags", flags(strong=F.col("strength") >= 0.25, large_residual=F.col("max_residual") >= 0.1, crossings=F.col("crossings") > 0))


def stress(examples: DataFrame, features: Sequence[str], scorer: Scorer, noise: Sequence[float] = (0.05, 0.1, 0.2), dropout: Sequence[float] = (0.1, 0.25), shift: float = 1.0, worst_shifts: int = 8, threshold: float = 0.5, seed: int = 42) -> DataFrame:
    """Metrics under noise, values dropped to the mean, and shifts of one feature, against the unchanged rows."""
    spark = examples.sparkSession
    table = [("noise", float(x), -1) for x in noise] + [("dropout", float(x), -1) for x in dropout] + [("shift", s * shift, i) for i in range(min(8, len(features))) for s in (-1, 1)]
    scenarios = spark.createDataFrame(table, "kind string, level double, target int")
    moments = examples.agg(*[F.avg(f).alias(f"_m_{f}") for f in features], *[F.stddev_pop(f).alias(f"_s_{f}") for f in features])
    rows = with_totals(scored_by(examples, features, scorer, "p0"), moments).crossJoin(F.broadcast(scenarios))
    key = lambda f: F.concat(F.lit(f"{f}:"), F.col("kind"), F.col("level").cast("string"))
    moved = []
    for i, f in enumerate(features):
        noisy = F.col(f) + F.col("level") * F.col(f"_s_{f}") * hash_normal(F.col("row_id"), seed, key(f))
        gone = F.when(hash_uniform(F.col("row_id"), seed, key(f)) < F.col("level"), F.col(f"_m_{f}")).otherwise(F.col(f))
        moved.append(F.when(F.col("kind") == "noise", noisy).when(F.col("kind") == "dropout", gone).when(F.col("target") == i, F.col(f) + F.col("level") * F.col(f"_s_{f}")).otherwise(F.col(f)))
    rows = rows.withColumn("p", scorer(*moved))
    per = rows.groupBy("kind", "level", "target").agg(*confusion_aggs(threshold), F.avg(((F.col("p") >= threshold) != (F.col("p0") >= threshold)).cast("double")).alias("flip_rate"))
    base = with_rates(scored_by(examples, features, scorer).agg(*confusion_aggs(threshold))).select(F.col("f1").alias("base_f1"))
    out = with_totals(with_rates(per), base).withColumn("f1_delta", F.col("f1") - F.col("base_f1")).withColumn("f1_ratio", F.col("f1") / F.greatest("base_f1", F.lit(1e-9)))
    place = F.row_number().over(Window.partitionBy("kind").orderBy(F.round("f1_delta", 9), F.desc(F.round("flip_rate", 9)), "target", "level"))  # a few scenarios
    return out.withColumn("_n", place).where((F.col("kind") != "shift") | (F.col("_n") <= worst_shifts)).select("kind", "level", "target", "f1", "f1_delta", "f1_ratio", "flip_rate")


def attributions(examples: DataFrame, features: Sequence[str], scorer: Scorer) -> DataFrame:
    """For every row and feature: the score less the score with that feature at its mean."""
    rows = with_totals(scored_by(examples, features, scorer), examples.agg(*[F.avg(f).alias(f"_m_{f}") for f in features]))
    items = [F.struct(F.lit(i).alias("feature_index"), F.lit(f).alias("feature"), (F.col("p") - scorer(*[F.col(f"_m_{g}") if g == f else F.col(g) for g in features])).alias("attribution")) for i, f in enumerate(features)]
    return rows.select("row_id", "p", F.inline(F.array(*items)))


def counterfactuals(rows: DataFrame, standardizer: DataFrame, features: Sequence[str], scorer: Scorer, radii: int = 18, samples: int = 8, threshold: float = 0.5, seed: int = 42) -> DataFrame:
    """For every row the closest of a fixed set of moves that turns its decision: single features up or down, all up or
    down, and ``samples`` hashed directions, each at ``radii`` lengths. Rows that no move turns come without one.

    Moves are tried as rows, but a try is one number, its objective in units of 1e-9 and then its place among the moves, so
    that the smallest is kept by a hash aggregate, and no try is sorted or shuffled. What the best move is, is worked out again from its place."""
    spark = rows.sparkSession
    sizes = [0.03 * (4 / 0.03) ** (i / (radii - 1)) for i in range(radii)]
    names = [f"{f}{s}" for f in features for s in "+-"] + ["all+", "all-"] + [f"random{k}" for k in range(samples)]
    moves = spark.createDataFrame(list(enumerate(names)), "k int, move string")
    wide = standardizer.agg(*[F.max(F.when(F.col("feature") == f, F.greatest("scale", F.lit(1e-3)))).alias(f"_s_{f}") for f in features])
    units = {}
    for f in features:
        units[f"_u_{f}"] = F.when(F.col("move").isin(f"{f}+", "all+"), 1.0).when(F.col("move").isin(f"{f}-", "all-"), -1.0).when(F.col("move").startswith("random"), hash_normal(F.col("row_id"), seed, F.concat(F.lit(f"{f}:"), F.col("move")))).otherwise(0.0)
    steps = {f"_d_{f}": F.col(f"_u_{f}") * F.col("radius") for f in features}
    p = scorer(*[F.col(f) + F.col(f"_d_{f}") * F.col(f"_s_{f}") for f in features])
    distance = sum((F.abs(f"_d_{f}") for f in features), F.lit(0.0)) / len(features)
    tries = len(names) * radii

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))  # by number: small rows become many tries, so partitions are not to be merged
    own = scored_by(rows.select("row_id", *features), features, scorer, "p0").repartition(parts, "row_id", "p0")
    tried = with_totals(own, wide).crossJoin(F.broadcast(moves)).withColumns(units)
    tried = tried.select("*", F.posexplode(F.array(*[F.lit(r) for r in sizes])).alias("i", "radius")).withColumns(steps).withColumns({"p": p, "distance": distance})
    turned = (F.col("p") >= threshold) != (F.col("p0") >= threshold)
    objective = 1e9 * (F.col("distance") - 0.01 * F.abs(F.col("p") - threshold))
    objective = F.when(F.isnan(objective), F.lit(float(1 << 52))).otherwise(objective)  # last
    whole = F.when(objective >= 0, F.floor(objective + 0.5)).otherwise(F.ceil(objective - 0.5)).cast("long")
    best = F.min(F.when(turned, whole * tries + F.col("k") * radii + F.col("i"))).alias("code")
    found = with_totals(tried.groupBy("row_id", "p0", *features).agg(best), wide).withColumn("place", F.pmod("code", F.lit(tries)).cast("int"))
    found = found.withColumn("move", F.get(F.array(*[F.lit(n) for n in names]), F.floor(F.col("place") / radii).cast("int")))
    found = found.withColumn("radius", F.get(F.array(*[F.lit(r) for r in sizes]), F.col("place") % radii)).withColumns(units).withColumns(steps)
    one = F.min(F.when(F.col("code").isNotNull(), F.struct("code", p.alias("p"), "move", "radius", distance.alias("distance")))).alias("b")  # an id may come again, with other features
    return found.groupBy("row_id", "p0").agg(one).select("row_id", "p0", "b.move", "b.radius", "b.p", "b.distance")


def canaries(probes: DataFrame, status: DataFrame, threshold: float = 0.5, min_margin: float = 0.05) -> DataFrame:
    """Probes (row_id, p, expected_label or null) against their expected labels and their contract status."""
    hit = (F.col("p") >= threshold).cast("int")
    rows = probes.join(status.select("row_id", F.col("status").alias("contract")), "row_id", "left").withColumn("margin", F.round(F.abs(F.col("p") - threshold), 9))
    plain = F.when(F.col("expected_label").isNull(), "informational").when(hit != F.col("expected_label"), "fail").when(F.col("margin") < min_margin, "review").otherwise("pass")
    rows = rows.withColumn("_s", plain)
    final = F.when((F.col("contract") == "fail") & (F.col("_s") != "fail"), "schema_fail").when((F.col("contract") == "warn") & (F.col("_s") == "pass"), "schema_warn").otherwise(F.col("_s"))
    return rows.select("row_id", "p", "expected_label", "margin", "contract", final.alias("status"))


def canary_summary(checked: DataFrame) -> DataFrame:
    names = ("pass", "review", "fail", "schema_fail", "schema_warn", "informational")
    c = checked.agg(F.count("*").alias("probes"), *[F.count_if(F.col("status") == n).alias(n) for n in names])
    verdict = F.when((F.col("fail") > 0) | (F.col("schema_fail") > 0), "canary_fail").when(F.col("probes") == F.col("informational"), "no_checkable_canaries").when((F.col("review") > 0) | (F.col("schema_warn") > 0), "canary_review").otherwise("canary_pass")
    return c.withColumn("verdict", verdict)


def policy_guard(examples: DataFrame, policies: Sequence[tuple[str, int, str]], features: Sequence[str], scorer: Scorer, tolerance: float = 1e-4, step: float = 0.2) -> DataFrame:
    """Monotonic policies (name, feature index, increasing or decreasing) on pairs of rows that differ in one feature."""
    rows = with_totals(examples.select(*features), wide_quantiles(examples, features, [0.05, 0.95]))
    items = []
    for name, i, direction in policies:
        f = features[i]
        lo, hi = F.get(f"_q_{f}", F.lit(0)), F.get(f"_q_{f}", F.lit(1))
        delta = F.greatest((hi - lo) * step, F.lit(1e-8))
        low = F.least(F.greatest(F.col(f), lo), hi - delta)
        at = lambda v, f=f: scorer(*[v if g == f else F.col(g) for g in features])
        change = (at(low + delta) - at(low)) * (1 if direction == "increasing" else -1)
        items.append(F.struct(F.lit(name).alias("policy"), F.lit(f).alias("feature"), F.lit(direction).alias("direction"), (hi - lo).alias("span"), F.greatest(F.lit(0.0), -change - tolerance).alias("violation")))
    long = rows.select(F.inline(F.array(*items)))
    out = long.groupBy("policy", "feature", "direction").agg(F.count("*").alias("pairs"), F.max("span").alias("span"), F.avg((F.col("violation") > 0).cast("double")).alias("violation_rate"), F.max("violation").alias("max_violation"))
    status = F.when(F.col("span") <= 1e-8, "not_testable").when((F.col("violation_rate") > 0.10) | (F.col("max_violation") >= 0.05), "fail").when(F.col("violation_rate") > 0, "review").otherwise("pass")
    return out.withColumn("status", status)
