"""Limits of groups whose ordinary documents have large metrics."""

from __future__ import annotations

from gaugework.llm import quality_rules


def test_limits_follow_large_values(spark):
    rows = [(g, "".join(f"{chr(97 + i)}{j}" + "x" * size + " " for j in range(60)), "zz", g) for g, size in (("long", 150), ("short", 3)) for i in range(12)]
    rows.append(("odd", "".join(f"a{j}" + "x" * 400 + " " for j in range(60)), "zz", "long"))
    docs = spark.createDataFrame(rows, "doc_id string, text string, lang string, source string")
    kept = {(r["doc_id"], r["kept"]) for r in quality_rules.judge(docs).collect()}
    assert kept == {("long", True), ("short", True), ("odd", False)}
