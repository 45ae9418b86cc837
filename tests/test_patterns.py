"""Ranks, running sums and totals on null groups, null and NaN values, ties and crowded values."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from gaugework.functions.columns import hash_normal, hash_uniform
from gaugework.operators.sweeps import threshold_stability
from gaugework.operators.uncertainty import permutation_null
from gaugework.plans import laws
from gaugework.operators.metrics import ranking_metrics
from gaugework.operators.modeling import model_queue
from gaugework.plans.patterns import at_ranks, ranked, running_sums, with_bucket


def test_null_groups_stay(spark):
    rows = [(i, i % 2, i / 60, [None, "s1", "s2"][i % 3]) for i in range(60)]
    df = spark.createDataFrame(rows, "row_id long, label int, p double, s string")
    assert {r["s"] for r in ranking_metrics(df, ["s"]).collect()} == {None, "s1", "s2"}
    out = ranked(df, F.col("p"), by=["s"]).collect()
    assert len(out) == 60 and sorted(r["rank"] for r in out if r["s"] is None) == list(range(1, 21))
    sums = running_sums(df, "p", ["label"], ["s"]).collect()
    assert len(sums) == 60 and max(r["cum_label"] for r in sums if r["s"] is None) == sum(r[1] for r in rows if r[3] is None)


def test_order_of_nulls_nan_and_ties(spark):
    values = [3.0, None, float("nan"), 1.0, 1.0, None, -math.inf, math.inf, 3.0]
    df = spark.createDataFrame(list(enumerate(values)), "row_id long, v double")
    order = [r["row_id"] for r in ranked(df, F.col("v")).orderBy("rank").collect()]
    assert order == [1, 5, 6, 3, 4, 0, 8, 7, 2]


def test_crowded_values_spread(spark):
    df = spark.range(200_000).select(F.col("id").alias("row_id"), F.when(F.col("id") == 7, 1e9).when(F.col("id") % 100 == 0, F.col("id") / 1000).otherwise(5.0).alias("v"))
    sizes = [r["count"] for r in with_bucket(df, F.col("v"), [], tie="row_id").groupBy("_bucket").count().collect()]
    assert max(sizes) <= 2 * 200_000 / 64 + 1 and sum(sizes) == 200_000
    got = ranked(df, F.col("v")).select("row_id", "rank")
    want = df.selectExpr("row_id", "row_number() over (order by v, row_id) as rank")
    assert got.exceptAll(want.selectExpr("row_id", "cast(rank as bigint) as rank")).count() == 0


def _poisson(spark, mean: float, n: int) -> dict[int, int]:
    table = laws.poisson_tables(spark.createDataFrame([(1, mean)], "k int, mean double"), "mean", ["k"])
    draw = laws.poisson_draw(hash_uniform(F.col("id"), 1, "u"), hash_normal(F.col("id"), 1, "z"))
    return {r["d"]: r["count"] for r in spark.range(n).crossJoin(F.broadcast(table)).select(draw.alias("d")).groupBy("d").count().collect()}


def test_poisson_tables_are_the_law(spark):
    for mean in (0.0, 0.3, 3.0, 40.0, 10_000.0):
        one = laws.poisson_tables(spark.createDataFrame([(1, mean)], "k int, mean double"), "mean", ["k"]).first()
        p = [b - a for a, b in zip([0.0, *one["_cdf"]], one["_cdf"])]
        k = [one["_lo"] + i for i in range(len(p))]
        assert abs(sum(x * y for x, y in zip(p, k)) - mean) < 1e-6 and abs(sum(x * (y - mean) ** 2 for x, y in zip(p, k)) - mean) < 1e-6 * max(mean, 1)
        for x, y in list(zip(p, k))[:: max(1, len(p) // 50)]:
            assert abs(x - math.exp(y * math.log(mean) - mean - math.lgamma(y + 1) if mean else -1e9 * y)) < 1e-9


def test_poisson_draws_have_their_mean_and_spread(spark):
    for mean in (0.0, 3.0, 10_000.0, 5e7):
        drawn = _poisson(spark, mean, 4000)
        m = sum(k * c for k, c in drawn.items()) / 4000
        v = sum((k - m) ** 2 * c for k, c in drawn.items()) / 4000
        assert abs(m - mean) <= 4 * math.sqrt(mean / 4000) and abs(v - mean) <= 0.15 * mean


def test_hypergeometric_table_is_the_law(spark):
    for n, p, k in ((8, 4, 4), (30, 12, 25), (5, 0, 3), (1, 1, 1)):
        one = laws.hypergeometric_table(spark.createDataFrame([(float(n), float(p), float(k))], "N double, P double, K double")).first()
        whole = 0.0
        for x in range(max(0, k + p - n), min(k, p) + 1):
            whole += math.comb(p, x) * math.comb(n - p, k - x) / math.comb(n, k)
            assert abs(one["_cdf"][x - one["_lo"]] - whole) < 1e-9


def test_permutation_null_equals_the_exact_law_on_eight_rows(spark):
    rows = spark.createDataFrame([(i, int(i >= 4), p) for i, p in enumerate((0.05, 0.15, 0.25, 0.35, 0.65, 0.75, 0.85, 0.95))], "row_id long, label int, p double")
    one = permutation_null(rows).first()
    assert abs(one["exact_p"] - 1 / 70) < 1e-12 and one["observed_f1"] == 1.0
    many = permutation_null(rows, permutations=20_000).first()
    assert abs(many["p_value"] - 1 / 70) < 4 * math.sqrt(1 / 70 / 20_000)


def test_stratified_bootstrap_keeps_label_counts(spark):
    rows = spark.range(3000).select(F.col("id").alias("row_id"), (F.col("id") % 3 == 0).cast("int").alias("label"), (F.pmod(F.col("id") * 7919, F.lit(3000)) / 3000).alias("p"))
    one = threshold_stability(rows, replicates=10).first()
    assert one["q05"] <= one["q50"] <= one["q95"] and one["verdict"].endswith("threshold") or one["verdict"] == "threshold_review"


def test_model_queue_ranks_families(spark):
    df = spark.range(600).select(F.col("id").alias("row_id"), (F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 11).cast("double").alias("b")).withColumn("label", ((F.col("a") > 3) != (F.col("b") > 5)).cast("int"))
    out = {r["family"]: r for r in model_queue(df, ["a", "b"]).collect()}
    assert sorted(r["rank"] for r in out.values()) == [1, 2, 3] and sum(r["best"] for r in out.values()) == 1
    assert not out["logistic"]["best"] and out["forest"]["f1"] > out["logistic"]["f1"]


def test_rows_at_ranks(spark):
    df = spark.range(30_000).select(F.col("id").alias("row_id"), (F.col("id") % 3).alias("g"), F.when(F.col("id") % 5 < 2, 7.0).otherwise(F.pmod(F.col("id") * 7919, F.lit(1000)).cast("double")).alias("v"), (F.col("id") % 7).alias("w"))
    wanted = spark.createDataFrame([(g, k) for g in range(3) for k in (1, 2, 777, 4001, 10_000, 10_001)], "g long, k long")
    got = {tuple(r) for r in at_ranks(df, F.col("v"), wanted, "row_id", ["g"], ["w"]).select("g", "rank", "row_id", "cum_w").collect()}
    whole = df.selectExpr("g", "row_number() over (partition by g order by v, row_id) as rank", "row_id", "sum(w) over (partition by g order by v, row_id rows unbounded preceding) as cum_w")
    assert got == {tuple(r) for r in whole.where("rank in (1, 2, 777, 4001, 10000, 10001)").collect()} and len(got) == 15
    one = at_ranks(df, -F.col("v"), spark.createDataFrame([(5,)], "k long")).select("row_id", "rank").collect()
    assert [tuple(r) for r in one] == [tuple(r) for r in df.orderBy(F.desc("v"), "row_id").limit(5).selectExpr("row_id", "cast(5 as bigint)").collect()[4:]]


def test_null_orders_spread(spark):
    df = spark.range(50_000).select(F.col("id").alias("row_id"), F.when(F.col("id") % 10 == 0, F.col("id").cast("double")).alias("v"))
    sizes = [r["count"] for r in with_bucket(df, F.col("v"), [], tie="row_id").groupBy("_bucket").count().collect()]
    assert max(sizes) <= 1500 and sum(sizes) == 50_000
    got = ranked(df, F.col("v")).select("row_id", "rank")
    want = df.selectExpr("row_id", "cast(row_number() over (order by v, row_id) as bigint) as rank")
    assert got.exceptAll(want).count() == 0
