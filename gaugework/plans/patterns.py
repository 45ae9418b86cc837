"""Distributed ranks, prefix sums and reshaping, on which the operators are built.

A window without partition columns runs in one task. Here the order is cut into buckets, each bucket gets the total of
those before it, and windows run inside buckets. Cuts lie at quantiles, as many as the session has shuffle partitions, and
rows of one crowded value are cut again by their tie key. Where the cuts lie changes balance, never results. A null group is
a group; a null value comes before all others, NaN after them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Buckets at least and at most.
BUCKETS, MOST_BUCKETS = 64, 4096


def buckets_of(df: DataFrame) -> int:
    return min(max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), BUCKETS), MOST_BUCKETS)


def join_groups(df: DataFrame, small: DataFrame, by: Sequence[str], how: str = "inner", strategy: str | None = None) -> DataFrame:
    """Join on the columns ``by``, where null equals null. ``strategy`` is a join hint for ``small``: broadcast where the groups are
    of a bounded number (features, labels, replicates), merge where they are not and Spark can split the crowded ones."""
    renamed = small.withColumnsRenamed({c: f"_g_{c}" for c in by})
    renamed = renamed.hint(strategy) if strategy else renamed
    on = F.lit(True)
    for c in by:
        on = on & F.col(f"`{c}`").eqNullSafe(F.col(f"`_g_{c}`"))
    return df.join(renamed, on, how).drop(*[f"_g_{c}" for c in by])


def with_bucket(df: DataFrame, value: Column, by: Sequence[str], buckets: int | None = None, tie: str | None = None) -> DataFrame:
    """``df`` with ``_bucket``, which grows with the value (and, where a value fills a bucket or more, with a numeric tie)."""
    parts = buckets or buckets_of(df)
    df = df.withColumn("_v", value.cast("double"))
    splits = tie is not None and dict(df.dtypes)[tie] in ("bigint", "int", "double")
    cuts = F.percentile_approx(F.when(~F.isnan("_v"), F.col("_v")), F.array(*[F.lit(i / parts) for i in range(1, parts)]), F.lit(10_000))
    ends = [f(F.col(tie).cast("double")).alias(n) for f, n in ((F.min, "_lo"), (F.max, "_hi"))] if splits else []
    limits = df.groupBy(*by).agg(F.coalesce(cuts, F.array().cast("array<double>")).alias("_cuts"), *ends)
    joined = with_totals(df, limits, by)
    # Binary search: cuts that are not above the value. A cut that comes twice is a value that fills a bucket.
    steps = F.array(*[F.lit(1 << k) for k in reversed(range((parts - 1).bit_length()))])
    joined = joined.withColumn("_at", F.aggregate(steps, F.lit(0), lambda at, k: F.when(F.get("_cuts", at + k - 1) <= F.col("_v"), at + k).otherwise(at)))
    at = F.coalesce(F.col("_at"), F.lit(0)).cast("long") * (parts + 1)
    null = F.lit(-1).cast("long")
    if splits:
        crowded = (F.get("_cuts", F.col("_at") - 1) == F.get("_cuts", F.col("_at") - 2))
        place = F.least(F.floor((F.col(tie).cast("double") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * parts), F.lit(parts - 1))
        inside = F.when(F.col("_v") > F.get("_cuts", F.col("_at") - 1), F.lit(parts)).when(F.col("_hi") > F.col("_lo"), F.coalesce(place, F.lit(0))).otherwise(0)
        at = at + F.when(F.coalesce(crowded, F.lit(False)), inside).otherwise(0)
        null = F.when(F.col("_hi") > F.col("_lo"), F.coalesce(place, F.lit(0))).otherwise(0).cast("long") - (parts + 1)
    at = F.when(F.col("_v").isNull(), null).otherwise(at)
    return joined.withColumn("_bucket", at.cast("long")).drop("_cuts", "_lo", "_hi", "_v", "_at")


def running_sums(df: DataFrame, value: str, sums: Sequence[str], by: Sequence[str] = (), descending: bool = False, buckets: int | None = None) -> DataFrame:
    """``df`` (one row for each group and value) with, for each column c of ``sums``, ``cum_c``: its sum over the rows
    of the group up to and including this one, in the order of ``value``."""
    by = list(by)
    v = -F.col(value) if descending else F.col(value)
    df = with_bucket(df, v, by, buckets)
    per = df.groupBy(*by, "_bucket").agg(*[F.sum(c).alias(f"_s_{c}") for c in sums])
    before = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(*by, "_bucket", *[F.coalesce(F.sum(f"_s_{c}").over(before), F.lit(0)).alias(f"_b_{c}") for c in sums])
    inside = Window.partitionBy(*by, "_bucket").orderBy(v).rowsBetween(Window.unboundedPreceding, 0)
    out = join_groups(df, per, [*by, "_bucket"])
    return out.select(*[x for x in df.columns if x != "_bucket"], *[(F.sum(c).over(inside) + F.col(f"_b_{c}")).alias(f"cum_{c}") for c in sums])


def ranked(df: DataFrame, order: Column, tie: str = "row_id", by: Sequence[str] = (), name: str = "rank", buckets: int | None = None) -> DataFrame:
    """``df`` with the 1-based rank of each row in its group, by ``order`` (ascending), then ``tie``."""
    by = list(by)
    df = with_bucket(df.withColumn("_order", order.cast("double")), F.col("_order"), by, buckets, tie)
    per = df.groupBy(*by, "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(*by, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*by, "_bucket").orderBy("_order", tie)
    out = join_groups(df, per, [*by, "_bucket"]).withColumn(name, (F.row_number().over(inside) + F.col("_before")).cast("long"))
    return out.drop("_bucket", "_before", "_order")


def at_ranks(df: DataFrame, order: Column, wanted: DataFrame, tie: str = "row_id", by: Sequence[str] = (), sums: Sequence[str] = (), buckets: int | None = None) -> DataFrame:
    """The rows of ``df`` whose ``rank`` in their group (1-based, by ``order``, then ``tie``) is in ``wanted`` (by..., k), with, for each
    column c of ``sums``, ``cum_c``: its sum over the group's rows up to this one.

    ``wanted`` is a table of few rows. Rows are counted and summed by bucket; only buckets that hold a wanted rank are put in
    order, so no more is sorted than wanted ranks times a bucket."""
    by = list(by)
    df = with_bucket(df.withColumn("_order", order.cast("double")), F.col("_order"), by, buckets, tie)
    per = df.groupBy(*by, "_bucket").agg(F.count("*").alias("_n"), *[F.sum(c).alias(f"_s_{c}") for c in sums])
    before = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    upto = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    per = per.select(*by, "_bucket", "_n", upto("_n").alias("_before"), *[upto(f"_s_{c}").alias(f"_b_{c}") for c in sums])
    ks = wanted.groupBy(*by).agg(F.collect_set(F.col("k").cast("long")).alias("_ks"))
    held = F.filter("_ks", lambda k: (k > F.col("_before")) & (k <= F.col("_before") + F.col("_n")))
    open_ = with_totals(per, ks, by).withColumn("_ks", held).where(F.size("_ks") > 0).drop("_n")
    met = join_groups(df, open_, [*by, "_bucket"], strategy="broadcast")  # no more rows than wanted ranks
    inside = Window.partitionBy(*by, "_bucket").orderBy("_order", tie)
    running = inside.rowsBetween(Window.unboundedPreceding, 0)
    met = met.withColumn("rank", (F.row_number().over(inside) + F.col("_before")).cast("long")).withColumns({f"cum_{c}": F.sum(c).over(running) + F.col(f"_b_{c}") for c in sums})
    return met.where(F.array_contains("_ks", F.col("rank"))).drop("_bucket", "_before", "_order", "_ks", *[f"_b_{c}" for c in sums])


def score_steps(scored: DataFrame, by: Sequence[str] = (), label: str = "label", p: str = "p", extra: DataFrame | None = None) -> DataFrame:
    """One row for each group and distinct score, highest first: ``t``, ``pos``, ``neg`` there, ``tp`` and ``fp`` (rows
    with a score of at least t), ``n_pos`` and ``n_neg`` of the group. ``extra`` adds thresholds (by..., t) without rows."""
    by = list(by)
    steps = scored.groupBy(*by, F.col(p).alias("t")).agg(F.sum(label).cast("long").alias("pos"), F.sum(1 - F.col(label)).cast("long").alias("neg"))
    if extra is not None:
        zero = extra.select(*by, "t", F.lit(0).cast("long").alias("pos"), F.lit(0).cast("long").alias("neg"))
        steps = steps.unionByName(zero).groupBy(*by, "t").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    steps = running_sums(steps, "t", ["pos", "neg"], by, descending=True).withColumnsRenamed({"cum_pos": "tp", "cum_neg": "fp"})
    totals = scored.groupBy(*by).agg(F.sum(label).cast("long").alias("n_pos"), F.sum(1 - F.col(label)).cast("long").alias("n_neg"))
    return with_totals(steps, totals, by)


def with_totals(df: DataFrame, totals: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Join one row for each group (or one row at all, without groups)."""
    by = list(by)
    if by:
        return join_groups(df, totals, by)
    return df.withColumn("_all", F.lit(0)).join(F.broadcast(totals.withColumn("_all", F.lit(0))), "_all").drop("_all")


def to_long(df: DataFrame, features: Sequence[str], keep: Sequence[str] = ("row_id", "label")) -> DataFrame:
    """Long form: one row for each row and feature, with ``feature_index``, ``feature`` and ``value``."""
    items = F.array(*[F.struct(F.lit(i).alias("feature_index"), F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for i, f in enumerate(features)])
    return df.select(*keep, F.inline(items))


def grid(spark, low: float, high: float, size: int, name: str = "t") -> DataFrame:
    """``size`` evenly spaced numbers from low to high, a table of fixed size."""
    return spark.range(size).select((F.lit(low) + F.col("id") * (high - low) / (size - 1)).alias(name))
