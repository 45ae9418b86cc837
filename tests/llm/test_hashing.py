"""Hashes of byte ranges: exact arithmetic, and words that collide for every base modulo a power of two."""

from __future__ import annotations

import numpy as np

from gaugework.llm import jaccard_join, quality_rules, substring_dedup, textblocks

PRIME = (1 << 61) - 1


def twins() -> tuple[str, str]:
    """The word of 1024 letters that starts with a and goes on with its own complement, and its complement."""
    word = "a"
    swap = str.maketrans("ab", "ba")
    for _ in range(10):
        word += word.translate(swap)
    return word, word.translate(swap)


def test_running_sums_are_exact():
    rng = np.random.default_rng(0)
    for data in (rng.integers(0, 256, 70_000).astype(np.uint8), rng.integers(0, 1 << 63, 3000, dtype=np.uint64)):
        prefix, total = textblocks.prefix_hash(data), 0
        for i, v in enumerate(data.tolist()):
            total = (total + (v + (data.dtype == np.uint8)) * pow(textblocks._BASE, i, PRIME)) % PRIME
            assert int(prefix[i + 1]) == total


def test_equal_ranges_have_equal_hashes_and_twins_do_not():
    a, b = twins()
    data = np.frombuffer((a + b + a).encode(), dtype=np.uint8)
    at = np.array([0, 1024, 2048])
    h = textblocks.range_hash(textblocks.prefix_hash(data), at, at + 1024)
    assert h[0] == h[2] != h[1]


def test_twins_are_different_words_and_lines(spark):
    a, b = twins()
    words = [f"w{i}" for i in range(12)]
    docs = spark.createDataFrame([(1, " ".join([*words, a]), "en", "s"), (2, " ".join([*words, b]), "en", "s"), (3, f"{a}\n{b}\n{a}", "en", "s")], "doc_id long, text string, lang string, source string")
    removed = {r["doc_id"]: r["n_removed"] for r in substring_dedup.dedup_passages(docs, 13).collect()}
    assert removed == {1: 0, 2: 0, 3: 0}
    linked = {r["doc_id"]: r["component_id"] for r in jaccard_join.link_components(docs, k=3, percent=90).collect()}
    assert linked == {1: 1, 2: 2, 3: 3}
    lines = {r["doc_id"]: r["n_dup_lines"] for r in quality_rules.judge(docs).collect()}
    assert lines[3] == 1
