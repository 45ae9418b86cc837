"""The toxicity classifier: its optimiser, its n-grams and its scores against plain versions."""

from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pytest

from gaugework.llm import toxicity
from gaugework.llm.textblocks import mixed, utf8_rows


def sample(n: int, seed: int = 1, features: int = 60):
    """Correlated features: every row has some of few topics, and each topic several features."""
    rng = np.random.default_rng(seed)
    topic = rng.random((n, 6)) < 0.3
    on = (topic @ np.repeat(np.eye(6), features // 6, axis=1) > 0) & (rng.random((n, features)) < 0.9)
    y = (rng.random(n) < np.where(topic[:, 0], 0.8, 0.2)).astype(float)
    row, col = np.nonzero(on)
    return row, col, rng.normal(size=features)[col], y, features


@pytest.mark.parametrize("n", [300, 12_000])
def test_loss_falls_to_a_flat_point(n):
    row, col, value, y, features = sample(n)
    w, b, values = toxicity.fit_logistic(row, col, value, y, features)
    assert all(x > y for x, y in zip(values, values[1:])) and len(values) > 3
    z = np.bincount(row, w[col] * value, minlength=n) + b
    g = (1 / (1 + np.exp(-z)) - y) / n
    slope = np.append(np.bincount(col, g[row] * value, minlength=features) + toxicity.L2 * w, g.sum())
    assert np.abs(slope).max() < 1e-4
    share = y.mean()
    constant = -(share * math.log(share) + (1 - share) * math.log(1 - share))
    assert np.mean(np.logaddexp(0, z) - y * z) < constant


def test_fit_does_not_hang_on_the_number_of_rows():
    row, col, value, y, features = sample(300)
    once = toxicity.fit_logistic(row, col, value, y, features)
    k = 7
    again = toxicity.fit_logistic(np.concatenate([row + 300 * i for i in range(k)]), np.tile(col, k), np.tile(value, k), np.tile(y, k), features)
    assert np.allclose(once[0], again[0], atol=0.02) and abs(once[1] - again[1]) < 0.02


def grams(text: str) -> set[int]:
    """Buckets of the distinct n-grams of a text, one by one."""
    folded = " " + "".join(" " if c.isspace() else (c.lower() if len(c.lower()) == 1 else c) for c in text) + " "
    out = set()
    for n in toxicity.SIZES:
        for i in range(len(folded) - n + 1):
            gram = folded[i : i + n]
            if " " in gram[1:-1]:
                continue
            h = np.full(1, n, dtype=np.uint64)
            for c in gram:
                h = h * np.uint64(0xFF51AFD7ED558CCD) + np.uint64(ord(c))
            out.add(int(mixed(h)[0]) % toxicity.BUCKETS)
    return out


TEXTS = ["", "a", "Ää ÉÉ idiot", "日本語のテキスト 日本", "ПРИВЕТ мир", "x\t\ny  z", "😀😀 smile", "İstanbul", "aaa aaa aaaa"]


def test_grams_are_of_code_points():
    import pyarrow as pa

    data, offsets = utf8_rows(pa.array([*TEXTS, None]))
    row, bucket = toxicity.gram_rows(data, offsets)
    for i, text in enumerate([*TEXTS, ""]):
        assert set(bucket[row == i].tolist()) == grams(text), text


def test_model_by_hand(spark, monkeypatch):
    """Log-count ratios, and scores as sums of weights, equal those of plain loops."""
    rng = random.Random(3)
    rude = ["moronic", "идиот", "白痴"]
    texts = []
    for i in range(160):
        words = ["".join(rng.choice("abcdefgéщ日") for _ in range(rng.randint(2, 6))) for _ in range(30)]
        if i % 3 == 0:
            words[rng.randrange(30)] = rude[i % 9 // 3]
        texts.append(" ".join(words))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(160)], "doc_id long, toxic int")
    seen = {}
    real = toxicity.fit_logistic
    monkeypatch.setattr(toxicity, "fit_logistic", lambda row, col, value, y, features: seen.update(value=value, n=len(y)) or real(row, col, value, y, features))
    model = toxicity.fit(docs, labels)
    used = [r["doc_id"] for r in labels.where(~toxicity.held_out(labels["doc_id"])).collect()]
    counts = [Counter(), Counter()]
    for i in used:
        counts[i % 3 == 0].update(grams(texts[i]))
    n = [sum(i % 3 != 0 for i in used), sum(i % 3 == 0 for i in used)]
    kept = {}
    for b in counts[0] | counts[1]:
        n0, n1 = counts[0][b], counts[1][b]
        ratio = math.log((n1 + 1) / (n[1] + 2)) - math.log((n0 + 1) / (n[0] + 2))
        cells = [(n0, n[0], n0 + n1), (n1, n[1], n0 + n1), (n[0] - n0, n[0], sum(n) - n0 - n1), (n[1] - n1, n[1], sum(n) - n0 - n1)]
        g = 2 * sum(c * math.log(c * sum(n) / (of * held)) for c, of, held in cells if c)
        if n0 + n1 >= 3 and math.sqrt(max(g, 0)) >= toxicity.SURE:
            kept[b] = ratio
    assert set(np.flatnonzero(model.weight).tolist()) == set(kept) and seen["n"] == len(used)
    assert sorted(set(np.round(seen["value"], 9))) == sorted(set(np.round(list(kept.values()), 9)))
    for r in toxicity.score(docs, model).collect():
        z = model.bias + sum(model.weight[b] for b in grams(r["text"]))
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-z)))


def test_texts_longer_than_a_block(spark):
    word = "moronic "
    docs = spark.createDataFrame([(1, "clean words " * 120_000 + word), (2, "clean words " * 120_000), (3, None)], "doc_id long, text string")
    weight = np.zeros(toxicity.BUCKETS)
    weight[sorted(grams("moronic") - grams("clean words"))] = 1.0
    out = {r["doc_id"]: r["score"] for r in toxicity.score(docs, toxicity.Model(weight, -5.0)).collect()}
    assert out[1] > 0.9 and out[2] == out[3] < 0.1


def test_small_tables_are_learned_from(spark):
    """A word of all toxic texts and no other is seen as sure with a few dozen labels."""
    rng = random.Random(4)
    texts = [" ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(40)) + (" moronic" if i % 3 == 0 else "") for i in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(60)], "doc_id long, toxic int")
    for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect():
        assert (r["score"] >= 0.5) == (r["doc_id"] % 3 == 0)
