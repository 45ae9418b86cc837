"""Plain single-machine versions of the operators, to compare with on small tables."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(data: bytes | str) -> str:
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def runs(flags: list[bool]) -> int:
    return sum(f and not (i and flags[i - 1]) for i, f in enumerate(flags))


def suffix_dedup(docs: list[tuple[int, str | None]], least: int = 200) -> set[tuple]:
    count: Counter = Counter()
    raw = [(d, (t or "").encode()) for d, t in docs]
    for _, r in raw:
        count.update(hash(r[i : i + least]) for i in range(len(r) - least + 1))
    out = []
    for d, r in raw:
        gone = [False] * len(r)
        reach = 0
        for i in range(len(r) - least + 1):
            if count[hash(r[i : i + least])] > 1:
                for j in range(max(i, reach), i + least):
                    gone[j] = True
                reach = i + least
        out.append((d, len(r), sum(gone), runs(gone), sha(bytes(b for b, g in zip(r, gone) if not g))))
    return sorted(out, key=str)


def substring_dedup(docs: list[tuple[int | None, str | None]], width: int = 13) -> list[tuple]:
    last = 1 << 63
    first: dict = {}
    words = [(d, WORD.findall(t or "")) for d, t in docs]
    for d, w in words:
        for i in range(len(w) - width + 1):
            key = tuple(w[i : i + width])
            first[key] = min(first.get(key, last), last if d is None else d)
    out = []
    for d, w in words:
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            if first[tuple(w[i : i + width])] < (last if d is None else d):
                gone[i : i + width] = [True] * width
        out.append((d, len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone) if not g))))
    return sorted(out, key=str)


def jaccard_components(docs: list[tuple[int, str | None]], k: int = 3, percent: int = 90) -> list[tuple]:
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for d, t in docs:
        w = WORD.findall((t or "").translate(lower))
        sets.append((d, {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())))
    parent = list(range(len(sets)))

    def find(i: int) -> int:
        while parent[i] != i:
            i = parent[i]
        return i

    by = defaultdict(list)
    for i, (_, s) in enumerate(sets):
        for x in s:
            by[x].append(i)
    shared: Counter = Counter()
    for members in by.values():
        for a in range(len(members)):
            for b in range(a):
                shared[members[b], members[a]] += 1
    for (a, b), n in shared.items():
        if 100 * n >= percent * (len(sets[a][1]) + len(sets[b][1]) - n):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    groups = defaultdict(list)
    for i in range(len(sets)):
        groups[find(i)].append(i)
    least = {i: min(sets[j][0] for j in g) for g in groups.values() for i in g}
    return sorted((d, len(s), least[i]) for i, (d, s) in enumerate(sets))
