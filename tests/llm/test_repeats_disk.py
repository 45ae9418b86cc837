"""What the search for repeated windows shuffles and leaves on disk."""

from __future__ import annotations

import random
import time

import pytest
from pyspark.sql import functions as F

from gaugework.llm import repeats, scratch, substring_dedup, suffix_dedup

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@pytest.mark.parametrize("module", [suffix_dedup, substring_dedup])
def test_texts_go_to_their_contexts_once(spark, monkeypatch, module):
    """Crowded anchors need no second shuffle of the texts, and their windows go without text."""
    monkeypatch.setattr(repeats, "MOST_CONTEXTS", 1)
    plans, columns = {}, {}

    def written(df, name):
        plans[name], columns[name] = df._jdf.queryExecution().optimizedPlan().toString(), df.columns
        return scratch.materialize(df, name)

    monkeypatch.setattr(repeats, "materialize", written)
    rng = random.Random(3)
    shared = " ".join(f"w{rng.randrange(900)}" for _ in range(60))
    docs = spark.createDataFrame([(i, f"a{i} b{i} {shared} c{i} d{i}") for i in range(6)], "doc_id long, text string")
    run = suffix_dedup.dedup_substrings if module is suffix_dedup else substring_dedup.dedup_passages
    assert {r["doc_id"]: r["n_removed"] > 0 for r in run(docs).collect()} == {i: i > 0 for i in range(6)}
    assert "windows" in plans and "body" not in columns["windows"]
    assert sum(plan.count("AS wanted#") for plan in plans.values()) == 1


def _shuffle_files(spark) -> set[str]:
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
    return {f for f in files.split("\n") if "/shuffle_" in f}


def test_a_written_table_leaves_no_shuffle_files(spark):
    counted = spark.range(10_000).groupBy((F.col("id") % 97).alias("k")).count()
    before, setting = _shuffle_files(spark), spark.conf.get(CLEANUP, None)
    seen = scratch.materialize(counted, "counted")
    for _ in range(50):  # they are deleted in the background
        if not _shuffle_files(spark) - before:
            break
        time.sleep(0.1)
    assert not _shuffle_files(spark) - before
    assert spark.conf.get(CLEANUP, None) == setting
    assert seen.count() == 97 and counted.count() == 97
