"""I-Match fingerprints and likenesses of whole tables against plain loops; repeated rows stay linear."""

from __future__ import annotations

import math
import random
import re
import struct
from collections import Counter

import pytest
import xxhash

from gaugework.llm import imatch


def h64(data: bytes, seed: int = 42) -> int:
    h = xxhash.xxh64(data, seed=seed).intdigest()
    return h - (1 << 64) if h >= 1 << 63 else h


def words(text: str | None) -> set[int]:
    return {h64(w.encode()) for w in re.split(r"[\x20\x09-\x0D]+", (text or "").lower()) if w}


def print_of(kept: set[int]) -> str:
    out = [str(len(kept))]
    for level in imatch.subset_bounds():
        for lo, hi in zip(level, level[1:]):
            marks = {b for other in imatch.subset_bounds() for b in other if lo < b < hi}
            own = sorted(t for t in kept if lo < t < hi)
            seed = 42
            for t in sorted([*own, *marks]):
                seed = h64(struct.pack("<q", t), seed % 2**64)
            out.append(f"{seed % 2**64:016x}"[: imatch.DIGITS] if own else ".")
    return " ".join(out)


def like(a: str, b: str) -> float:
    x, y = a.split(" "), b.split(" ")
    n = max(int(x[0]), int(y[0]), 1)
    level = min(max(math.floor(math.log(n / imatch.SUBSETS) / math.log(4) + 0.5), 0), imatch.LEVELS - 1)
    at = slice(1 + level * imatch.SUBSETS, 1 + (level + 1) * imatch.SUBSETS)
    used = [(p, q) for p, q in zip(x[at], y[at]) if (p, q) != (".", ".")]
    return 1.0 if a == b else sum(p == q for p, q in used) / len(used) if used else 0.0


def brute(rows: list[tuple], least_df: int, most_share: float) -> list[tuple]:
    df = Counter(t for _, text in rows for t in words(text))
    most = max(least_df, int(len(rows) * most_share))
    band = {t for t, n in df.items() if least_df <= n <= most}
    single = sorted(set(rows), key=lambda r: (r[0] is None, -(r[0] or 0)))
    texts = [t or "" for _, t in single]
    prints = [print_of(words(t) & band) for t in texts]
    out = []
    for i, row in enumerate(single):
        j = (i + 1) % len(single)
        k = len(texts[i]) // 3
        edited = texts[i][: len(texts[i]) - k] + texts[j][:k]
        own = print_of(words(edited) & band)
        out += [(row[0], len(texts[i]), prints[i], own, like(prints[i], own), like(prints[i], prints[j]))] * rows.count(row)
    return sorted(out, key=str)


@pytest.mark.parametrize("least_df,most_share", [(2, 0.3), (3, 0.1)])
def test_whole_table(spark, least_df, most_share):
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice(["ba", "Té", "ku", "日", "zz"]) for _ in range(rng.randint(1, 4))) for _ in range(400)]
    rows = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 120)))) for i in range(60)]
    rows += [(100 + i, rows[i][1] + " more") for i in range(20)] + [(200, None), (201, ""), (202, " \n"), (None, "one of none"), rows[3], rows[3], rows[7]]
    rows.append((300, " ".join(rng.choice(vocabulary) + str(rng.randrange(50)) for _ in range(9000))))
    got = imatch.edit_likeness(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), least_df, most_share).collect()
    shown = sorted(((r["doc_id"], r["n_chars"], r["fingerprint"], r["edited_fingerprint"], r["near_edited"], r["near_next"]) for r in got), key=str)
    want = brute(rows, least_df, most_share)
    assert [s[:4] for s in shown] == [w[:4] for w in want]
    for s, w in zip(shown, want):
        assert s[4:] == pytest.approx(w[4:])


def test_repeated_rows_are_linear(spark):
    rows = [(1, "same text of many rows")] * 400 + [(2, "another text"), (None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "xxhash64(doc_id, text) AS row_key")
    met = imatch.with_edited(docs).collect()
    assert sorted(r["repeats"] for r in met) == [1, 1, 400]
    out = imatch.edit_likeness(docs).collect()
    assert len(out) == 402 and len({tuple(r) for r in out}) == 3


def test_null_ids_and_one_id_are_cut_into_ranges(spark):
    rows = [(None if i % 3 else 5, f"text {i}") for i in range(900)] + [(9, "a"), (1, "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "xxhash64(doc_id, text) AS row_key")
    assert imatch._ranges(docs, 8).select("range", "sub").distinct().count() > 50
    links = {r["row_key"]: r["next_key"] for r in imatch.next_documents(docs, 8).collect()}
    key = {r["row_key"]: r["doc_id"] for r in docs.collect()}
    at, seen = next(k for k, d in key.items() if d == 9), []
    for _ in range(len(rows)):
        seen.append(at)
        at = links[at]
    assert at == seen[0] and len(set(seen)) == len(rows)
    assert [key[k] for k in seen] == [9, *[5] * 300, 1, *[None] * 600]


def test_extra_columns_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c", "x", 2), (2, "a b d", "y", 3)], "doc_id long, text string, row_key string, repeats int")
    assert imatch.edit_likeness(docs).count() == 2 and imatch.edit_likeness(docs.limit(0)).count() == 0
