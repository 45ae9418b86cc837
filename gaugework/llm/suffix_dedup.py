"""Removal of repeated byte strings by suffix arrays and longest-previous-factor arrays.

The corpus-wide suffix array is split into buckets in which equal strings of the least length must meet (see
``repeats``); each bucket's array is sorted by prefix doubling, and previous and next smaller text positions in suffix
order give, for every position, the longest match that starts earlier.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gaugework.llm import repeats
from gaugework.llm.textblocks import prefix_hash, range_hash, utf8_rows

#: Bytes of an anchor gram, window starts of a piece of input, and bytes of a suffix array.
GRAM, PIECE, ARRAY = 32, 1 << 19, 1 << 20


def suffix_order(text: np.ndarray, longest: int) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """Suffixes sorted by their first ``longest`` bytes or a few more, and for growing lengths h the ranks by the first h
    bytes: the place of the first suffix with the same h bytes. Each round joins the ranks of ``_parts`` neighbouring
    stretches of h bytes; only suffixes that share these bytes with others are sorted further."""
    n, parts = len(text), _parts(len(text))
    padded = np.zeros(n + 8, dtype=np.uint64)
    padded[:n] = text
    key = np.zeros(n, dtype=np.uint64)
    for i in range(8):
        key = (key << np.uint64(8)) | padded[i : i + n]
    order = np.argsort(key)  # equal suffixes in any order
    place, sorted_key = np.arange(n), key[order]  # places in the order that are not settled, and what they are sorted by
    rank = np.zeros(n + 1, dtype=np.int64)  # at n: behind the end
    ranks: dict[int, np.ndarray] = {}
    h = 8
    while True:
        new = np.ones(len(place) + 1, dtype=bool)
        new[1:-1] = sorted_key[1:] != sorted_key[:-1]
        first = np.flatnonzero(new)
        rank[order[place]] = np.repeat(place[first[:-1]], np.diff(first)) + 1
        ranks[h] = rank[:n].copy()
        if h >= longest:
            return order, ranks
        place = place[~(new[:-1] & new[1:])]
        own = order[place]
        key = rank[own]
        for i in range(1, parts):
            key = key * (n + 1) + rank[np.minimum(own + i * h, n)]
        within = np.argsort(key)
        order[place], sorted_key = own[within], key[within]
        h *= parts


def _parts(n: int) -> int:
    """How many ranks of n suffixes one 63-bit number holds, 3 at most."""
    return 3 if n < (1 << 21) - 1 else 2


def common_prefix(ranks: dict[int, np.ndarray], a: np.ndarray, b: np.ndarray, longest: int) -> np.ndarray:
    """Length of the common prefix of suffixes a and b, in steps of 8 bytes, up to the whole of ``longest``."""
    n = len(next(iter(ranks.values())))
    same = np.zeros(len(a), dtype=np.int64)
    for h in sorted(ranks, reverse=True):
        for _ in range(_parts(n) - 1):
            x, y = a + same, b + same
            inside = (x < n) & (y < n) & (same + h <= longest)
            equal = np.zeros(len(a), dtype=bool)
            equal[inside] = ranks[h][x[inside]] == ranks[h][y[inside]]
            same[equal] += h
    return same


def previous_factor(position: np.ndarray, lcp: np.ndarray, least: int) -> np.ndarray:
    """Of suffixes in order: the longest match with one that starts earlier, where it reaches ``least`` (else less).

    ``lcp[r]`` is what suffix r shares with suffix r - 1. The earlier matches of r are at the nearest smaller positions
    on either side; pointers jump over larger ones, carrying the minimum of what they pass.
    """
    best = np.zeros(len(position), dtype=np.int64)
    for side in (1, -1):
        pos = position[::side]
        share = lcp.copy() if side == 1 else np.append(lcp[1:], 0)[::-1].copy()
        near = np.arange(len(pos)) - 1
        go = np.flatnonzero((near >= 0) & (share >= least))
        while len(go := go[pos[near[go]] > pos[go]]):
            at = near[go]
            near[go], share[go] = near[at], np.minimum(share[go], share[at])
            go = go[(near[go] >= 0) & (share[go] >= least)]
        share[near < 0] = 0
        best = np.maximum(best, share[::side])
    return best


def repeated_starts(bodies: list[bytes], least: int, first_stays: bool, twice: Sequence[bool] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """For each byte of the joined bodies, which are in order of precedence: whether the ``least`` bytes from there on lie in
    its body and occur earlier (or, if the first does not stay, anywhere else); and the same of the second copies of the
    bodies that come ``twice``.

    A second copy's suffixes stand beside the first's in suffix order, so they are put in after the sort."""
    sizes = np.array([len(b) for b in bodies])
    text = np.frombuffer(b"".join(bodies), dtype=np.uint8)
    ends = np.cumsum(sizes)
    room = np.repeat(ends, sizes) - np.arange(len(text))
    order, ranks = suffix_order(text, least)
    order = order[room[order] >= least]
    step = 8 * (least // 8)
    lcp = np.zeros(len(order), dtype=np.int64)
    lcp[1:] = common_prefix(ranks, order[:-1], order[1:], step)
    if least % 8 and len(order) > 1:  # the last bytes, one by one
        for i in range(step, least):
            lcp[1:] += (lcp[1:] == i) & (text[order[:-1] + i] == text[order[1:] + i])
    times = 1 + np.repeat(np.asarray(twice, dtype=np.int64), sizes)[order] if twice is not None else np.ones(len(order), np.int64)
    copy = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    order, lcp = np.repeat(order, times), np.where(copy > 0, least, np.repeat(lcp, times))
    place = 2 * order + copy
    match = previous_factor(place, lcp, least)
    if not first_stays:
        match = np.maximum(match, previous_factor(-place, lcp, least))
    flags = np.zeros((2, len(text)), dtype=bool)
    flags[copy, order] = match >= least
    return flags[0], flags[1]


def _extract(least: int):
    gram = min(GRAM, least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8_rows(batch.column("text"))
            ids, tags = (batch.column(c).to_numpy() for c in ("id", "tag"))
            for p in range(0, len(data), PIECE):
                piece = data[p : p + PIECE + least - 1]
                prefix = prefix_hash(piece)
                at = np.arange(len(piece))
                row = np.searchsorted(offsets, at + p, side="right") - 1
                room = offsets[row + 1] - p - at
                room[PIECE:] = 0
                starts = at[: max(len(piece) - gram + 1, 0)]
                lo, span, anchor, context = repeats.segments(range_hash(prefix, starts, starts + gram), room, least, gram, prefix)
                if len(lo):
                    yield repeats.segment_batch(ids, tags, row[lo], lo + p - offsets[row[lo]], span, anchor, context)

    return run


def _resolve(least: int, first_stays: bool):
    """PIECE rows to VERDICT rows. The LPF of a text's second copy is what is left of the text."""

    def solve(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        flags = repeated_starts([r[5] for r in rows], least, first_stays, [r[4] for r in rows])
        ends = np.cumsum([len(r[5]) for r in rows])
        ranges: list[list[list[tuple[int, int]]]] = [[[] for _ in rows] for _ in flags]
        for flag, found in zip(flags, ranges, strict=True):  # no run goes over the end of a body: its last bytes start no window
            at = np.array(repeats.runs(flag), dtype=np.int64).reshape(-1, 2)
            body = np.searchsorted(ends, at[:, 0], side="right")
            at -= (ends[body] - np.array([len(rows[i][5]) for i in body], dtype=np.int64))[:, None]
            for i, (lo, hi) in zip(body.tolist(), at.tolist(), strict=True):
                found[i].append((lo, hi))
        out = [v for r, a, b in zip(rows, *ranges, strict=True) for v in repeats.judged(r, a, b)]
        if out:
            yield repeats.emit(out, repeats.VERDICT_FIELDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0
        for row in repeats.piece_rows(batches):
            if size >= ARRAY and row[0] != rows[-1][0]:  # arrays end between buckets
                yield from solve(rows)
                rows, size = [], 0
            rows.append(row)
            size += len(row[5])
        if rows:
            yield from solve(rows)

    return run


def dedup_substrings(docs: DataFrame, least: int = 200, keep_first: bool = True) -> DataFrame:
    """Documents (``doc_id``, ``text``) without byte strings of ``least`` bytes or more that repeat in the corpus.

    Returns ``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans`` (maximal removed runs) and ``kept`` (binary: the rest).
    With ``keep_first`` the earliest occurrence (by doc_id, then position) stays and later copies go; else every byte of
    a repeated string goes, in all its places. Strings are judged on the input and never cross documents.

    A null text is empty; a null doc_id comes last in order; repeated rows are copies of each other and, sharing id and
    text, fare alike (with ``keep_first`` both keep what neither has earlier). An empty table gives an empty result;
    other columns are left out.
    """
    docs = repeats.keyed(docs)
    ranges = repeats.repeated_ranges(docs, _extract(least), _resolve(least, keep_first), str.encode, bytes, bytes, least, across=False, write_segments=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                rows = []
                for doc, text, found in zip(*[part.column(c) for c in ("doc_id", "text", "ranges")], strict=True):
                    raw = (text.as_py() or "").encode()
                    if found := found.as_py():
                        gone = repeats.covered(found, least, len(raw))
                        kept = np.frombuffer(raw, dtype=np.uint8)[~gone].tobytes()
                        rows.append((doc.as_py(), len(raw), int(gone.sum()), len(repeats.runs(gone)), kept))
                    else:
                        rows.append((doc.as_py(), len(raw), 0, 0, raw))
                yield repeats.emit(rows, [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())])

    return repeats.with_ranges(docs, ranges).mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
