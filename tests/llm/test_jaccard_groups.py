"""Sets of shingles and the groups of small buckets: the same as by plain sorts and by trees."""

from __future__ import annotations

import numpy as np

from gaugework.llm import jaccard_join as J


def test_few_sets_need_no_tree_and_lose_no_link(monkeypatch):
    rng = np.random.default_rng(3)
    for _ in range(60):
        base = rng.integers(1, 1 << 63, 400, dtype=np.uint64)
        sets = []
        for _ in range(int(rng.integers(2, J.FEW + 1))):
            own = np.concatenate([base[: int(rng.integers(40, 160))], rng.integers(1, 1 << 63, int(rng.integers(0, 30)), dtype=np.uint64)])
            sets.append(np.unique(own))
        sets.sort(key=len)
        bitmaps, size = [np.frombuffer(J.sampled_bits(s), dtype=np.uint64) for s in sets], np.array([len(s) for s in sets])
        monkeypatch.setattr(J, "SignatureTree", None)
        few = J.possible_groups(bitmaps, size, 80).all()
        monkeypatch.undo()
        monkeypatch.setattr(J, "FEW", 0)
        tree = J.possible_groups(bitmaps, size, 80).all()
        monkeypatch.undo()
        for i in range(len(sets)):
            for j in range(i):
                both = len(np.intersect1d(sets[i], sets[j]))
                if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                    assert few[i] == few[j]
                if few[i] == few[j]:
                    assert tree[i] == tree[j]  # never coarser


def test_shingle_sets_are_the_sorted_distinct_ones():
    texts = ["a b c d e f a b c d e", "x y", "", "x y", "one two three four five six", " z "]
    data, ends = np.frombuffer("".join(texts).encode(), dtype=np.uint8), np.cumsum([0, *map(len, texts)])
    row, h = J.shingle_sets(data, ends, 3)
    assert np.array_equal(np.lexsort((h, row)), np.arange(len(h)))
    assert np.bincount(row, minlength=6).tolist() == [6, 1, 0, 1, 4, 1]
    assert len(np.unique(np.stack([row.astype(np.uint64), h], axis=1), axis=0)) == len(h) and h[row == 1] == h[row == 3]
