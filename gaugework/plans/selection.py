"""Exact quantiles and order statistics of columns of any size, without sorting or holding all their values.

Values are counted in ranges that grow with the value, the ranges that hold a wanted rank are counted again in finer ranges,
and only the distinct values of those are put in order. Every step is a grouped count with partial sums; what a task
holds is the counters of the ranges, which are of a bounded number, and a sort that Spark can spill.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugework.plans.patterns import join_groups, to_long, with_totals
from gaugework.plans.scratch import materialize

#: Ranges for each factor of e of a value's size, and parts that a range with a wanted rank is cut into.
FINE, PARTS = 64, 4096


def _coarse(v: Column) -> Column:
    """A number that does not fall as v grows: by sign and logarithm; NaN comes last."""
    size = F.coalesce(F.floor(F.least(F.log(F.abs(v)), F.lit(780.0)) * FINE), F.lit(0)) + 60_000
    return F.when(F.isnan(v), F.lit(200_000)).when(v == 0, F.lit(0)).otherwise(F.signum(v) * size).cast("long")


def _wanted(bins: DataFrame, key: Sequence[str | Column], at: str) -> DataFrame:
    """Of counted ranges (``_m`` rows each), those that hold one of the group's ranks, with these as ``_ranks`` and the rows
    of all ranges before as ``_before``. ``key`` are the columns within which ``_before`` counts, in the order of ``at``."""
    order = Window.partitionBy(*key).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.withColumn("_before", F.col("_before") + F.coalesce(F.sum("_m").over(order), F.lit(0)))
    inside = F.filter("_ranks", lambda r: (r >= F.col("_before")) & (r < F.col("_before") + F.col("_m")))
    return bins.withColumn("_ranks", inside).where(F.size("_ranks") > 0)


def order_statistics(df: DataFrame, value: str, ranks: Column, by: Sequence[str] = (), few: bool = True) -> DataFrame:
    """(by..., _n, _rank, _x): the values of the wanted ranks of each group, from 0 and in ascending order.

    ``ranks`` is an array of whole numbers, made of the column ``_n`` (the group's non-null values). Null values are left out
    (a group without others gives no row), NaN is the largest value, a null group is a group. Equal values share their
    ranks, in any order. Ranks outside a group give no row. A group has a few ranks: they are carried in arrays. ``few``: the groups are of a
    bounded number (features, labels), so that what is wanted of each is broadcast; else it is joined by a merge."""
    by = list(by)
    rows = df.select(*by, F.col(value).cast("double").alias("_v")).where("_v is not null").withColumn("_a", _coarse(F.col("_v")))
    counted = [F.count("*").alias("_m"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")]
    one = by or [F.lit(0)]
    bins = rows.groupBy(*by, "_a").agg(*counted).withColumn("_n", F.sum("_m").over(Window.partitionBy(*one))).withColumn("_before", F.lit(0).cast("long"))
    bins = bins.withColumn("_ranks", F.array_distinct(ranks.cast("array<bigint>")))
    # A few rows for each group, used twice below: kept, so that the table is not counted again for each use.
    first = materialize(_wanted(bins, one, "_a"), "first")

    def met(data: DataFrame, wanted: DataFrame, key: Sequence[str]) -> DataFrame:
        """The rows of ``data`` in the wanted ranges that hold more than one value, with the range as ``_w``."""
        open_ = wanted.where(F.col("_lo") < F.col("_hi"))
        lists = open_.groupBy(*by).agg(F.collect_list(F.struct(*key, "_lo", "_hi", "_n", "_before", "_ranks")).alias("_w"))
        joined = join_groups(data, lists, by, strategy="broadcast" if few else "merge") if by else with_totals(data, lists)
        same = lambda w: F.forall(F.array(*[F.col(k) == w[k] for k in key]), lambda x: x)
        return joined.withColumn("_w", F.get(F.filter("_w", same), F.lit(0))).where("_w is not null")

    part = F.least(F.floor((F.col("_v") - F.col("_w._lo")) / (F.col("_w._hi") - F.col("_w._lo")) * PARTS), F.lit(PARTS - 1)).cast("long")
    finer = met(rows, first, ["_a"]).withColumn("_b", part)
    carried = ["_w._n", "_w._before", "_w._ranks"]
    second = finer.groupBy(*by, "_a", "_b").agg(*counted, F.first("_w").alias("_w")).select(*by, "_a", "_b", "_m", "_lo", "_hi", *carried)
    second = materialize(_wanted(second, [*by, "_a"], "_b"), "second")
    # The distinct values of the ranges that still hold a wanted rank and more than one value.
    again = met(finer.drop("_w"), second, ["_a", "_b"])
    third = again.groupBy(*by, "_a", "_b", "_v").agg(F.count("*").alias("_m"), F.first("_w").alias("_w")).select(*by, "_a", "_b", "_v", "_m", *carried)
    third = _wanted(third, [*by, "_a", "_b"], "_v")
    single = lambda t: t.where(~(F.col("_lo") < F.col("_hi"))).select(*by, "_n", F.explode("_ranks").alias("_rank"), F.col("_lo").alias("_x"))
    return single(first).unionByName(single(second)).unionByName(third.select(*by, "_n", F.explode("_ranks").alias("_rank"), F.col("_v").alias("_x")))


def quantiles(df: DataFrame, value: str, at: Sequence[float], by: Sequence[str] = (), name: str = "q", few: bool = True) -> DataFrame:
    """(by..., ``name``): the array of interpolated quantiles of each group's non-null values, as ``percentile`` gives them:
    between the values of the two ranks around (n - 1) * a. Groups without values give no row; a whole table without values
    gives nulls."""
    by = list(by)
    place = lambda a: (F.col("_n") - 1).cast("double") * float(a)
    ranks = F.array(*[f(place(a)).cast("long") for a in at for f in (F.floor, F.ceil)])
    found = order_statistics(df, value, ranks, by, few)
    per = found.groupBy(*by).agg(F.first("_n").alias("_n"), F.map_from_entries(F.collect_set(F.struct("_rank", "_x"))).alias("_map"))

    def one(a: float) -> Column:
        lo, hi = F.floor(place(a)).cast("long"), F.ceil(place(a)).cast("long")
        x, y = F.element_at("_map", lo), F.element_at("_map", hi)
        return F.when((lo == hi) | (x == y), x).otherwise((hi - place(a)) * x + (place(a) - lo) * y)

    return per.select(*by, F.array(*[one(a) for a in at]).alias(name))


def median(df: DataFrame, value: str, by: Sequence[str] = (), name: str = "median", few: bool = True) -> DataFrame:
    """(by..., ``name``): the median of each group's non-null values."""
    return quantiles(df, value, [0.5], by, "_q", few).select(*by, F.get("_q", F.lit(0)).alias(name))


def wide_quantiles(df: DataFrame, columns: Sequence[str], at: Sequence[float], prefix: str = "_q_") -> DataFrame:
    """One row: for each of the numeric columns the array of its quantiles, as ``<prefix><column>``."""
    long = to_long(df, columns, ())
    q = quantiles(long, "value", at, ["feature"])
    return q.agg(*[F.max(F.when(F.col("feature") == c, F.col("q"))).alias(f"{prefix}{c}") for c in columns])
