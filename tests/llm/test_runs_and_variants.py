"""Periodic runs and spelling variants against brute force, on awkward tables."""

from __future__ import annotations

import random
import re
import sys
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))
import brute  # noqa: E402

from gaugework.llm import periodic_runs as runs  # noqa: E402
from gaugework.llm import queries  # noqa: E402
from gaugework.llm import spelling_variants as variants  # noqa: E402


def plain_runs(words: list, least: int = 6, times: int = 4) -> list[tuple[int, int, int]]:
    n, out = len(words), {}
    for q in range(1, n // times + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, times * q):
                out.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted(((s, length, q) for (s, length), q in out.items()), key=lambda r: (r[0], r[2]))


def repetitive(rng: random.Random) -> list[int]:
    k, n = rng.choice([1, 2, 2, 3, 5]), rng.choice([0, 1, 5, 6, 7, 12, 40, 160])
    w = [rng.randrange(k) for _ in range(n)]
    for _ in range(rng.randint(0, 4) if n >= 8 else 0):
        a = rng.randrange(n)
        p = rng.randint(1, max(1, (n - a) // 4))
        for i in range(a, min(n, a + p * rng.randint(2, 8))):
            w[i] = w[a + (i - a) % p]
    return w


def test_runs_equal_brute_force():
    rng = random.Random(5)
    for _ in range(60):
        docs = [repetitive(rng) for _ in range(rng.randint(1, 5))]
        docs += [docs[0]] * rng.choice([0, 3])
        n = np.array([len(d) for d in docs])
        x = np.array([v for d in docs for v in d] + [-1], dtype=np.int32)
        for times in (3, 4):
            got = list(zip(*(c.tolist() for c in runs.runs_of(x, np.cumsum(n) - n, n, 6, times)), strict=True))
            assert got == [(k, *r) for k, d in enumerate(docs) for r in plain_runs(d, 6, times)]


def test_extensions_equal_brute_force():
    rng = np.random.default_rng(2)
    for n in (1, 2, 13, 60, 300):
        x = rng.integers(0, 2, n)
        x[n // 2 :] = x[: n - n // 2]
        i, j = np.triu_indices(n, 1)
        got = runs.Extensions(x, n)(i, j, n - j)
        want = [next((k for k in range(n - b) if x[a + k] != x[b + k]), n - b) for a, b in zip(i, j, strict=True)]
        assert got.tolist() == want


def _run_docs() -> list[tuple]:
    rng = random.Random(9)
    say = lambda w: " ".join("abcde"[v] for v in w)
    texts: list[str | None] = [None, "", " \t\n", "one", "a " * 5000, "a b " * 900 + "c", "é ü\n" * 30]
    texts += [say(repetitive(rng)) for _ in range(60)]
    texts += [" ".join(f"w{rng.randrange(400)}" for _ in range(3000)) for _ in range(3)]
    return [(i, t, "extra", "extra") for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def run_table(spark):
    rows = _run_docs()
    return spark.createDataFrame([*rows, rows[6]], "doc_id long, text string, runs string, n_words string").repartition(3)


def test_find_runs_on_a_table(run_table):
    texts = {d: t for d, t, *_ in _run_docs()}
    got = runs.find_runs(run_table).collect()
    assert len(got) == len(texts) + 1
    for r in got:
        words = brute.WORD.findall(texts[r["doc_id"]] or "")
        want = plain_runs(words)
        gone = {i for s, length, q in want for i in range(s + q, s + length)}
        assert [(x["start"], x["length"], x["period"]) for x in r["runs"]] == want
        assert r["n_words"] == len(words) and r["collapsed"] == " ".join(w for i, w in enumerate(words) if i not in gone)
    assert runs.find_runs(run_table.limit(0)).columns == ["doc_id", "n_words", "runs", "collapsed"]
    assert runs.find_runs(run_table.limit(0)).count() == 0
    with pytest.raises(ValueError):
        runs.find_runs(run_table, times=2)


def test_the_runs_query(spark, run_table, tmp_path):
    run_table.select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    texts = {d: t for d, t, *_ in _run_docs()}
    planted = 0
    for r in queries.op12_periodic_runs(spark, str(tmp_path)).collect():
        words = brute.WORD.findall(texts[r["doc_id"]] or "")
        h, n = zlib.crc32(str(r["doc_id"]).encode()), len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
            planted += 1
        want = plain_runs(words)
        best = min(want, key=lambda x: (-x[1], x[0], x[2])) if want else None
        gone = {i for s, length, q in want for i in range(s + q, s + length)}
        assert r["n_runs"] == len(want)
        assert (r["start"], r["length"], r["period"]) == (best or (None, None, None))
        assert r["exponent_milli"] == (1000 * best[1] // best[2] if best else None)
        assert r["runs_sha256"] == brute.sha("".join(f"{s},{length},{q}\n" for s, length, q in want))
        assert r["collapsed_sha256"] == brute.sha(" ".join(w for i, w in enumerate(words) if i not in gone))
    assert planted


LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def one_edit(a: str, b: str) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(docs: list[tuple]) -> dict[str, tuple]:
    count: Counter = Counter()
    for d, t in docs:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = w.translate(LOW)
            h = zlib.crc32(f"{d}:{w}".encode())
            if h % 31 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            count[w] += 1
    words = {w: n for w, n in count.items() if len(w) >= 7 and n >= 2}
    near = {w: [v for v in words if v != w and one_edit(v, w)] for w in words}
    form = {}
    for w, n in words.items():
        if near[w] and words[best := min(near[w], key=lambda v: (-words[v], v))] >= 10 * n:
            form[w] = best
    out = {}
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out[w] = (n, len(near[w]), form.get(w), words[form[w]] if w in form else None, root)
    return out


def _spelt() -> list[tuple]:
    rng = random.Random(4)
    stems = ["".join(rng.choice("abcdeéÀ") for _ in range(rng.randint(6, 11))) for _ in range(30)]
    texts: list[str | None] = [None, "", "short words only", "x" * 3000 + " " + "x" * 3000 + " " + "x" * 2999 + " " + "x" * 2999]
    for _ in range(150):
        words = []
        for _ in range(40):
            w = stems[min(int(rng.expovariate(0.3)), 29)]
            for _ in range(rng.choice([0, 0, 0, 1, 1, 2])):
                i = rng.randrange(len(w))
                w = w[:i] + rng.choice(["", "a", "é", w[i] + "b"]) + w[i + 1 :]
            words.append(w.upper() if rng.random() < 0.1 else w)
        texts.append(rng.choice([" ", "-", "\n"]).join(words))
    # A chain of forms, and ties.
    texts.append(" ".join(["chainaaaa"] * 300 + ["chainaaab"] * 30 + ["chainaabb"] * 3 + ["tiewordx", "tiewordy"] * 50 + ["tieword"] * 3 + ["anagrams", "anagrasm"] * 3))
    return list(enumerate(texts))


@pytest.mark.parametrize(("groups", "block"), [(6, 2048), (3, 7)])
def test_near_words_equal_brute_force(spark, groups, block):
    want = plain_variants(_spelt())
    words = spark.createDataFrame([(w, v[0]) for w, v in want.items()], "word string, n long").repartition(3)
    got = {r["word"]: r for r in variants.near_words(words, groups, block).collect()}
    near = {w: [v for v in want if v != w and one_edit(v, w)] for w in want}
    assert set(got) == {w for w in want if near[w]}
    for w, r in got.items():
        best = min(near[w], key=lambda v: (-want[v][0], v))
        assert (r["n_near"], r["best"], r["best_n"]) == (len(near[w]), best, want[best][0])


def test_the_variants_query(spark, tmp_path):
    docs = _spelt()
    spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, word int").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["word"]: (r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in queries.op13_spelling_variants(spark, str(tmp_path)).collect()}
    assert got == plain_variants(docs)
    assert any(v[4] != v[2] and v[2] for v in got.values())  # a chain of two forms


def test_no_words(spark):
    none = spark.createDataFrame([(None, None), (1, "")], "doc_id long, text string")
    words = variants.count_words(none)
    assert words.count() == 0 and variants.group_variants(words).count() == 0
