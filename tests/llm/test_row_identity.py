"""Rows with null or repeated ids are told apart by their texts, also where 32-bit hashes of these agree."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from gaugework.llm import jaccard_join, repeats, substring_dedup, suffix_dedup


@pytest.fixture(scope="module")
def pair(spark):
    """Two texts of one 32-bit hash."""
    texts = spark.range(300_000).select(F.concat_ws(" ", *[F.concat(F.lit(w), F.col("id")) for w in "abcdefghijklmnop"]).alias("text"))
    return next(r["t"] for r in texts.groupBy(F.hash("text")).agg(F.collect_list("text").alias("t")).where(F.size("t") > 1).limit(1).collect())[:2]


def test_null_ids_of_one_hash(spark, pair):
    a, b = pair
    docs = spark.createDataFrame([(None, a), (None, b), (1, a)], "doc_id long, text string")
    assert sorted(r["text"] for r in jaccard_join.one_of_each(docs).collect()) == sorted(pair)
    removed = {(r["doc_id"], r["n_removed"]) for r in substring_dedup.dedup_passages(docs, 13).collect()}
    assert removed == {(1, 0), (None, 16), (None, 0)}


def test_repeated_rows_fare_alike(spark):
    """Rows of one id and text keep, with ``keep_first``, what neither has earlier."""
    text = "".join(f"{i * 7919 % 1009:04d}" for i in range(100))
    docs = spark.createDataFrame([(4, text)] * 3 + [(9, "x" + text)], "doc_id long, text string")
    kept = sorted((r["doc_id"], len(r["kept"])) for r in suffix_dedup.dedup_substrings(docs, 100).collect())
    assert kept == [(4, 400)] * 3 + [(9, 1)]


@pytest.mark.parametrize("module", [suffix_dedup, substring_dedup])
def test_the_method_decides_everything(spark, monkeypatch, module):
    """Without verdicts of suffix arrays or parsing nothing goes, be it copies or passages."""
    passage = " ".join(f"word{i}" for i in range(80))
    docs = spark.createDataFrame([(1, passage), (2, passage), (3, "a b c " + passage), (None, passage)], "doc_id long, text string")
    run = suffix_dedup.dedup_substrings if module is suffix_dedup else substring_dedup.dedup_passages
    assert run(docs).agg(F.sum("n_removed")).first()[0] > 0
    monkeypatch.setattr(module, "_resolve", lambda *_: lambda batches: (b.slice(0, 0).select([]) for b in () if b))
    assert run(docs).agg(F.sum("n_removed")).first()[0] == 0


def test_runs_longer_than_a_piece(spark, monkeypatch):
    monkeypatch.setattr(repeats, "RUN", 50)
    text = " ".join(f"word{i * i}" for i in range(900))
    docs = spark.createDataFrame([(1, text), (2, "x " + text), (3, text + " y")], "doc_id long, text string")
    assert {r["doc_id"]: r["n_removed"] for r in substring_dedup.dedup_passages(docs).collect()} == {1: 0, 2: 900, 3: 900}
    assert {r["doc_id"]: len(r["kept"]) for r in suffix_dedup.dedup_substrings(docs).collect()} == {1: len(text), 2: 2, 3: 2}
