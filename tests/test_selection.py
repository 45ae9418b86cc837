"""Exact selection against Spark's own exact percentile, on awkward columns."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from gaugework.plans.selection import median, order_statistics, quantiles

AT = [0.0, 0.01, 0.25, 0.5, 0.77, 0.99, 1.0]


def columns() -> dict[str, list[float | None]]:
    rng = random.Random(2)
    return {
        "wide": [rng.choice([-1, 1]) * math.exp(rng.uniform(-300, 300)) for _ in range(700)],
        "narrow": [1e9 + rng.random() for _ in range(700)],
        "ties": [float(rng.randrange(3)) for _ in range(600)] + [None] * 30,
        "constant": [-2.5] * 400,
        "single": [7.0],
        "two": [1.0, 2.0],
        "none": [None, None],
        "mixed": [0.0, -0.0, math.inf, -math.inf, 5e-324, 1.7e308, -1.7e308, 3.0, None, 0.1, 0.2, 0.3],
        "crowd": [0.5] * 500 + [rng.random() for _ in range(500)],
    }


@pytest.fixture(scope="module")
def table(spark):
    rows = [(g if g != "two" else None, v) for g, values in columns().items() for v in values]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "g string, v double").repartition(5).cache()


def test_grouped_quantiles_equal_percentile(table):
    want = {r["g"]: r["q"] for r in table.groupBy("g").agg(F.percentile("v", F.array(*[F.lit(a) for a in AT])).alias("q")).collect() if r["q"]}
    got = {r["g"]: r["q"] for r in quantiles(table, "v", AT, ["g"]).collect()}
    assert got == want


def test_whole_table_equals_percentile(table):
    part = table.where("g in ('narrow', 'ties', 'crowd')")
    want = part.agg(F.percentile("v", F.array(*[F.lit(a) for a in AT]))).first()[0]
    assert quantiles(part, "v", AT).first()["q"] == want
    assert median(part, "v").first()["median"] == want[3]


def test_no_rows_and_ranks_outside(table):
    assert quantiles(table.limit(0), "v", AT).first()["q"] == [None] * len(AT)
    assert median(table.limit(0), "v").first()["median"] is None
    assert quantiles(table.limit(0), "v", AT, ["g"]).count() == 0
    assert quantiles(table.where("g = 'none'"), "v", AT, ["g"]).count() == 0
    two = order_statistics(table.where("g is null"), "v", F.array(F.lit(0), F.lit(1), F.lit(2), F.lit(-1)))
    assert sorted((r["_n"], r["_rank"], r["_x"]) for r in two.collect()) == [(2, 0, 1.0), (2, 1, 2.0)]


def test_partitions_do_not_matter(table):
    one = quantiles(table.repartition(1), "v", AT, ["g"]).collect()
    many = quantiles(table.repartition(16), "v", AT, ["g"]).collect()
    assert sorted(map(str, one)) == sorted(map(str, many))


def test_nan_is_the_largest(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (float("nan"),)], "v double")
    q = quantiles(df, "v", [0.0, 0.5, 1.0]).first()["q"]
    assert q[:2] == [1.0, 2.0] and math.isnan(q[2])


def test_ten_million_distinct_values(spark):
    """No task holds more than the counters of the ranges, and the values of one of 4096 parts of a range."""
    df = spark.range(0, 10_000_000, 1, 8).select((F.pmod(F.col("id") * 7919, F.lit(10_000_019)).cast("double") / 3).alias("v"))
    got = quantiles(df, "v", [0.5, 0.9]).first()["q"]
    near = df.agg(F.percentile_approx("v", F.array(F.lit(0.5), F.lit(0.9)), F.lit(100_000))).first()[0]
    assert all(abs(a - b) < 1000 for a, b in zip(got, near, strict=True))
    below = df.agg(*[F.count_if(F.col("v") <= x) for x in got]).first()
    assert list(below) == [5_000_000, 9_000_000]
