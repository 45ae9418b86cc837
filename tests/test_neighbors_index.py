"""Exact neighbours by pivots against brute force: crowds, ties, kinds, queries; what is pruned; recall of the approximate search."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugework.operators import neighbors as N

SCHEMA = "row_id long, label int, v array<double>"


def made(seed: int, n: int, width: int) -> list[tuple]:
    rng = random.Random(seed)
    centres = [[rng.uniform(-50, 50) for _ in range(width)] for _ in range(6)]
    out = []
    for i in range(n):
        c = rng.choice(centres)
        v = [round(x + rng.gauss(0, 1), 1) for x in c] if i % 3 else [float(x) for x in np.round(centres[0], 0)]  # a third are one point
        out.append((i, int(rng.random() < 0.3), v))
    rng.shuffle(out)
    return [*out, (n, 1, None)]


def brute(rows: list[tuple], k: int, kind: str | None = None, queries: set | None = None) -> set[tuple]:
    rows = [r for r in rows if r[2] is not None]
    v = np.array([r[2] for r in rows])
    out = set()
    for i, (a, label, x) in enumerate(rows):
        if queries is not None and a not in queries:
            continue
        d = np.round(np.sqrt(((v - np.array(x)) ** 2).sum(axis=1)), 9)
        fit = [(d[j], rows[j][0]) for j in range(len(rows)) if j != i and (kind is None or (rows[j][1] == label) == (kind == "same"))]
        out |= {(a, b, float(dist), r + 1) for r, (dist, b) in enumerate(sorted(fit)[:k])}
    return out


@pytest.mark.parametrize(("width", "kind"), [(2, None), (2, "same"), (2, "opposite"), (9, None)])
def test_neighbours_equal_brute_force(spark, width, kind):
    data = made(width, 260, width)
    df = spark.createDataFrame(data, SCHEMA).repartition(3)
    got = {tuple(r) for r in N.nearest(df, "v", 4, kind, block=16).collect()}
    assert got == brute(data, 4, kind)


def test_queries_few_rows_and_none(spark):
    data = made(5, 200, 3)
    df = spark.createDataFrame(data, SCHEMA)
    asked = df.where(F.col("row_id") % 20 == 0)
    assert {tuple(r) for r in N.nearest(df, "v", 5, queries=asked, block=8).collect()} == brute(data, 5, None, {i for i in range(0, 200, 20)})
    assert N.nearest(df.limit(0), "v", 3).count() == 0
    two = spark.createDataFrame([(1, 0, [0.0]), (2, 0, [3.0])], SCHEMA)
    assert {tuple(r) for r in N.nearest(two, "v", 3).collect()} == {(1, 2, 3.0, 1), (2, 1, 3.0, 1)}
    assert N.nearest(two, "v", 3, "opposite").count() == 0


def test_most_pairs_are_pruned_in_few_dimensions(spark):
    df = spark.range(4000).select(F.col("id").alias("row_id"), F.lit(0).alias("label"), F.array((F.pmod(F.col("id") * 7919, F.lit(4000)) / 10).cast("double"), (F.pmod(F.col("id") * 104729, F.lit(4000)) / 10).cast("double")).alias("v"))
    r = N.pruning(df, "v", 5, block=64).first()
    assert (r["points"], r["queries"], r["cells"]) == (4000, 4000, 63) and r["pruned"] > 0.7


def test_recall_of_the_approximate_search(spark):
    rng = np.random.default_rng(3)
    data = [(i, 0, [float(x) for x in rng.normal(i % 8, 0.6, 6)]) for i in range(800)]
    df = spark.createDataFrame(data, SCHEMA)
    r = N.recall(df, "v", N.nearest_approximately(df, "v", 5, bucket_length=2.0, tables=8), 5).first()
    assert r["queries"] == 40 and r["neighbours"] == 200 and r["recall"] >= 0.9


@pytest.mark.parametrize("width", [2, 12])
def test_one_search_gives_the_lists_of_every_class(spark, width):
    data = [*made(width, 160, width), (1000, None, [1.0] * width)]
    df = spark.createDataFrame(data, SCHEMA)
    known = [r for r in data if r[1] is not None]
    whole, same, opposite = N.nearest_by_class(df, "v", 3)
    assert {tuple(r) for r in whole.collect()} == brute(data, 3)
    assert {tuple(r) for r in same.collect()} == brute(known, 3, "same")
    assert {tuple(r) for r in opposite.collect()} == brute(known, 3, "opposite")


def test_rows_are_sent_as_often_in_larger_tables(spark):
    """In many dimensions nothing is pruned: each row has to go to a number of tasks that does not grow with the table."""
    rng = np.random.default_rng(1)
    sent = []
    for n in (200, 1600):
        df = spark.createDataFrame([(i, 0, [float(x) for x in rng.normal(0, 1, 12)]) for i in range(n)], SCHEMA)
        points, members = N._points(df, "v", 5, None)
        sent.append(N._crossed(points, points, {}, N.SIDES).count() / n)
    assert sent[0] == sent[1] == 2 * N.SIDES


def test_approximate_neighbours_are_those_that_share_a_bucket(spark):
    """Against all pairs that share a bucket of a table, with a crowd of equal rows, for some queries and for all rows."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector

    data = [r for r in made(4, 150, 3) if r[2] is not None]
    df = spark.createDataFrame(data, SCHEMA)
    h = df.select("row_id", array_to_vector("v").alias("features"))
    model = BucketedRandomProjectionLSH(inputCol="features", outputCol="hashes", bucketLength=6.0, numHashTables=2, seed=42).fit(h)
    hashes = {r["row_id"]: [x[0] for x in r["hashes"]] for r in model.transform(h).collect()}
    assert len({tuple(x) for x in hashes.values()}) > 3
    want = set()
    for a, _, x in data:
        near = sorted((round(float(np.sqrt(((np.array(x) - np.array(y)) ** 2).sum())), 9), b) for b, _, y in data if a != b and any(i == j for i, j in zip(hashes[a], hashes[b], strict=True)))
        want |= {(a, b, dist, r + 1, True) for r, (dist, b) in enumerate(near[:4]) if dist < 9}
    got = N.nearest_approximately(df, "v", 4, bucket_length=6.0, tables=2, radius=9.0)
    assert {tuple(r) for r in got.collect()} == want
    some = N.nearest_approximately(df, "v", 4, bucket_length=6.0, tables=2, radius=9.0, queries=df.where("row_id % 20 = 0"))
    assert {tuple(r) for r in some.collect()} == {r for r in want if r[0] % 20 == 0}
    assert N.nearest_approximately(df.limit(0), "v", 4).count() == 0


def test_pruning_counts_the_pairs_of_the_search(spark):
    df = spark.createDataFrame(made(2, 300, 2), SCHEMA)
    points, members = N._points(df, "v", 3, None)
    n = points.count()
    one = N.pruning(df, "v", 3, block=10_000).first()
    assert (one["points"], one["pairs"], one["pruned"]) == (n, n * n, 0.0)
    many = N.pruning(df, "v", 3, block=8).first()
    assert 0 < many["pairs"] < n * n and abs(many["pruned"] - (1 - many["pairs"] / n / n)) < 1e-12


def test_work_of_a_query_does_not_grow_with_the_table(spark, monkeypatch):
    """The number of cells is bounded; what a query is compared with must not grow with what a cell holds."""
    monkeypatch.setattr(N, "MOST_CELLS", 4)
    rng = np.random.default_rng(7)
    per_query = []
    for n in (1000, 8000):
        df = spark.createDataFrame([(i, 0, [float(x) for x in rng.uniform(0, 100, 2)]) for i in range(n)], SCHEMA)
        r = N.pruning(df, "v", 3, block=64).first()
        assert r["cells"] == 4
        per_query.append(r["pairs"] / r["queries"])
    assert per_query[1] < 1.5 * per_query[0]


@pytest.mark.parametrize("kind", [None, "same", "opposite"])
def test_partners_in_other_cells(spark, kind):
    """Labels that lie apart, so that a cell has no partner of the other one; far from the origin; with a row that is at no distance."""
    rng = np.random.default_rng(11)
    data = [(i, i % 2, [1e6 + float(x) for x in np.round(rng.normal(60 * (i % 2), 3, 3), 2)]) for i in range(200)]
    df = spark.createDataFrame([*data, (900, 0, [1.0, float("nan"), 0.0])], SCHEMA)
    assert {tuple(r) for r in N.nearest(df, "v", 4, kind, block=16).collect()} == brute(data, 4, kind)


@pytest.mark.parametrize("kind", [None, "same", "opposite"])
def test_all_pairs_far_from_the_origin(spark, kind):
    data = [(i, label, v and [x + 1e9 for x in v]) for i, label, v in made(11, 200, 10)]
    df = spark.createDataFrame(data, SCHEMA).repartition(3)
    assert {tuple(r) for r in N.nearest(df, "v", 4, kind).collect()} == brute(data, 4, kind)


def test_tiles_of_products_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(N, "TILE", 16)
    data = [(i, label if i % 7 else 2, v) for i, label, v in made(12, 240, 9)] + [(1000, 1, [float("inf")] * 9), (1001, 0, [float("nan")] * 9)]
    rng = np.random.default_rng(1)
    huge, tight = [], []
    for i, label, v in data[:120]:
        huge.append((i, label, v and [x * 1e17 for x in v]))
        tight.append((i, label, v and (np.array([50.0] * 9) * (i % 2) + 1e-5 * rng.standard_normal(9)).tolist()))
    chunk = lambda rows, kind: N._Chunk(np.array([r[0] for r in rows]), np.array([r[1] for r in rows], dtype=np.int32), np.array([r[2] for r in rows]), 4, kind)
    for rows in (data, huge, tight):
        rows = [r for r in rows if r[2] is not None]
        finite = [r for r in rows if np.isfinite(r[2]).all()]
        for kind in (None, "same", "opposite"):
            c = chunk(rows, kind)
            for lo in range(0, len(rows), 50):
                some = rows[lo : lo + 50]
                c.meet(np.array([r[1] for r in some], dtype=np.int32), np.array([r[2] for r in some]), N.pa.array([[r[0]] for r in some], N.pa.list_(N.pa.int64())))
            got = set()
            for x, (i, _, v) in enumerate(rows):
                found = sorted((d, o) for d, o in zip(c.best[0].distance[x], c.best[0].id[x], strict=True) if np.isfinite(d) and o != i)[:4]
                got |= {(i, int(o), float(d), n + 1) for n, (d, o) in enumerate(found)}
            assert got == brute(finite, 4, kind)


def test_hardness_and_prototypes_are_made_from_one_search(spark, monkeypatch):
    from gaugework.operators import scorecard as K
    from gaugework.plans import evidence_queries as V
    from gaugework.plans import explain_queries as Q

    sf_dir, searches, search = "/root/testdata/sf0.001", [], N._all_pairs
    monkeypatch.setattr(N, "_all_pairs", lambda *a: searches.append(1) or search(*a))
    rules = [r for r in K.TRIAGE_RULES if r[1] in ("hardness", "prototype")]
    V.evidence(spark, sf_dir, rules).count()
    assert len(searches) == 1
    for name, df in Q.neighbour_reports(spark, sf_dir).items():
        assert sorted(map(tuple, df.collect())) == sorted(map(tuple, Q.R.queries[name](spark, sf_dir).collect()))
