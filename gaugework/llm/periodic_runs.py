"""Maximal periodic runs of words, from longest common extensions over a difference cover.

A run of period p and four periods or more holds three places in a row of the grid 0, p, 2p, ... of its document, so the
grids of all periods (n + n/2 + n/3 + ... places) meet every run. Where the words at three neighbouring places agree, the
longest common extensions of the first two, forwards and backwards, give the whole run. Extensions come from a suffix
order of every position whose number is in a difference cover: any two positions are both in it after the same few
steps, so a few words are compared one by one, and the rest is a range minimum over the order's common prefixes.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gaugework.llm.textblocks import Words, blocks, utf8_rows

#: A difference cover: every remainder by ``STEP`` is a difference of two of these.
COVER, STEP = (0, 1, 3, 9), 13
#: Grid places that one step looks at.
PLACES = 1 << 20

_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _shifts() -> np.ndarray:
    """For each remainder of j - i: the element of the cover that i has to be brought to, so that j is in the cover too."""
    to = np.zeros(STEP, dtype=np.int64)
    for a in COVER:
        for b in COVER:
            to[(b - a) % STEP] = a
    return to


class Extensions:
    """Longest common extensions of positions of ``x`` (whole numbers from 0), in words, as far as ``most`` at least."""

    def __init__(self, x: np.ndarray, most: int):
        n = len(x)
        self.x = np.concatenate([x.astype(np.int32) + 1, np.zeros(3 * STEP, np.int32)])
        self.to = _shifts()
        # Sampled positions by remainder, so that the one a step further is the next; a gap after each remainder.
        slots = n // STEP + 2
        lane = np.full(STEP, -1, dtype=np.int64)
        lane[list(COVER)] = np.arange(len(COVER))
        self.lane, self.slots = lane, slots
        at = (np.array(COVER)[:, None] + STEP * np.arange(slots)[None, :]).ravel()
        inside = at < n
        # Names of the STEP words from each position on: equal words, equal names.
        windows = np.lib.stride_tricks.sliding_window_view(self.x, STEP)[np.minimum(at, n)]
        packed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * STEP), len(at), [None, pa.py_buffer(np.ascontiguousarray(windows))])
        rank = np.where(inside, packed.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64) + 1, 0)
        levels, reach = [rank.astype(np.int32)], STEP
        while reach < most and len(np.unique(rank)) < inside.sum() + 1:
            span = reach // STEP
            after = np.zeros_like(rank)
            after[:-span] = rank[span:] if span < len(rank) else 0
            # Steps do not run from one remainder's positions into the next one's.
            place = np.tile(np.arange(slots), len(COVER))
            after[place + span >= slots] = 0
            rank = np.where(inside, np.unique(rank * (len(rank) + 1) + after, return_inverse=True)[1] + 1, 0)
            levels.append(rank.astype(np.int32))
            reach *= 2
        order = np.argsort(rank, kind="stable")
        self.place_of = np.empty(len(order), dtype=np.int64)
        self.place_of[order] = np.arange(len(order))
        a, b = order[:-1].copy(), order[1:].copy()
        shared = np.zeros(len(a), dtype=np.int32)
        for k in range(len(levels) - 1, -1, -1):
            level = levels[k]
            # Past its lane's last slot a position has rank 0, which ends the comparison.
            same = (level[np.minimum(a, len(level) - 1)] == level[np.minimum(b, len(level) - 1)]) & (level[np.minimum(a, len(level) - 1)] > 0)
            shared[same] += 1 << k
            a[same] += 1 << k
            b[same] += 1 << k
        self.table = [shared]
        while 2 << (len(self.table) - 1) <= len(shared):
            half, last = 1 << (len(self.table) - 1), self.table[-1]
            self.table.append(np.minimum(last[:-half], last[half:]))

    def _slot(self, i: np.ndarray) -> np.ndarray:
        return self.lane[i % STEP] * self.slots + i // STEP

    def _minimum(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Least common prefix, in steps, of neighbours lo, lo + 1, ... hi of the order."""
        out = np.empty(len(lo), dtype=np.int64)
        k = np.log2(np.maximum(hi - lo, 1)).astype(np.int64)
        for one in np.unique(k):
            own = np.flatnonzero(k == one)
            t = self.table[one]
            out[own] = np.minimum(t[lo[own]], t[hi[own] - (1 << one)])
        return out

    def _compare(self, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Equal words from i and j on, one by one, up to ``most`` (at most STEP)."""
        out = np.zeros(len(i), dtype=np.int64)
        going = np.arange(len(i))
        for t in range(STEP):
            going = going[(t < most[going]) & (self.x[i[going] + t] == self.x[j[going] + t])]
            if not len(going):
                break
            out[going] += 1
        return out

    def __call__(self, i: np.ndarray, j: np.ndarray, room: np.ndarray) -> np.ndarray:
        """Common extension of i and j (i < j) in words, ``room`` at most."""
        ahead = (self.to[(j - i) % STEP] - i) % STEP
        out = self._compare(i, j, np.minimum(ahead, room))
        on = np.flatnonzero((out == ahead) & (ahead < room))
        p, q = (self.place_of[self._slot(k[on] + ahead[on])] for k in (i, j))
        steps = self._minimum(np.minimum(p, q), np.maximum(p, q))
        reach = ahead[on] + STEP * steps
        more = np.flatnonzero(reach < room[on])
        at = on[more]
        reach[more] += self._compare(i[at] + reach[more], j[at] + reach[more], np.minimum(STEP, room[at] - reach[more]))
        out[on] = np.minimum(reach, room[on])
        return out


def _grid(x: np.ndarray, lo: np.ndarray, n: np.ndarray, least: int, times: int) -> tuple[np.ndarray, ...]:
    """(document, period, place) of the grid places where a run can be: those where the words there, a period and two
    periods on agree. Documents are x[lo : lo + n]. By document, period and place."""
    most = np.where(n >= least, n // times, 0)
    doc = np.repeat(np.arange(len(n)), most)
    period = np.arange(len(doc)) - np.repeat(np.cumsum(most) - most, most) + 1
    count = -(-(n[doc] - (times - 1) * period) // period)
    out: list[tuple] = []
    ends = np.cumsum(count)
    a = 0
    while a < len(doc):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + PLACES, side="right")))
        c = count[a:b]
        pair = np.repeat(np.arange(a, b), c)
        p = period[pair]
        i = lo[doc[pair]] + (np.arange(len(pair)) - np.repeat(np.cumsum(c) - c, c)) * p
        word = x[i]
        ok = np.flatnonzero(word == x[i + p])
        ok = ok[word[ok] == x[i[ok] + 2 * p[ok]]]
        ok = ok[(p[ok] == 1) | (x[i[ok] + 1] == x[i[ok] + p[ok] + 1])]
        out.append((doc[pair[ok]], p[ok], i[ok]))
        a = b
    return tuple(np.concatenate(c) if out else np.zeros(0, np.int64) for c in (zip(*out, strict=True) if out else ((), (), ())))


def runs_of(x: np.ndarray, lo: np.ndarray, n: np.ndarray, least: int = 6, times: int = 4) -> tuple[np.ndarray, ...]:
    """(document, start, length, period) of all runs of documents x[lo : lo + n], by document, start and period: maximal
    stretches of smallest period q and length at least ``least`` and ``times`` q. ``times`` is 3 at least."""
    doc, p, i = _grid(x, lo, n, least, times)
    none = tuple(np.zeros(0, np.int64) for _ in range(4))
    if not len(doc):
        return none
    # Extensions are made for the documents with such places only, put together.
    used, own = np.unique(doc, return_inverse=True)
    size = n[used]
    start = np.cumsum(size) - size
    y = x[np.repeat(lo[used] - start, size) + np.arange(int(size.sum()))]
    i = i - lo[used][own] + start[own]
    end = (start + size)[own]
    total, most = len(y), int(size.max())
    forward, backward = Extensions(y, most), Extensions(y[::-1], most)
    found: list[np.ndarray] = []

    def extend(k: np.ndarray) -> np.ndarray:
        """Runs through the places k; returns where their forward extensions end."""
        ahead = forward(i[k], i[k] + p[k], end[k] - i[k] - p[k])
        long = np.flatnonzero(ahead + p[k] >= (times - 2) * p[k])
        at = k[long]
        behind = backward(total - i[at] - p[at], total - i[at], i[at] - start[own[at]])
        length = ahead[long] + behind + p[at]
        good = np.flatnonzero(length >= np.maximum(least, times * p[at]))
        at = at[good]
        found.append(np.stack([own[at], i[at] - behind[good] - start[own[at]], length[good], p[at]]))
        return i[k] + ahead

    # First the places without one of the same grid before them; the run through such a place takes the next ones with it.
    head = np.ones(len(i), dtype=bool)
    head[1:] = (own[1:] != own[:-1]) | (p[1:] != p[:-1]) | (i[1:] != i[:-1] + p[1:])
    first = np.flatnonzero(head)
    reach = extend(first)
    rest = np.flatnonzero(i >= reach[np.cumsum(head) - 1])
    for a in range(0, len(rest), PLACES):
        extend(rest[a : a + PLACES])
    d, s, length, q = np.concatenate(found, axis=1)
    # The same stretch comes with multiples of its smallest period.
    by = np.lexsort((q, length, s, d))
    d, s, length, q = d[by], s[by], length[by], q[by]
    new = np.ones(len(d), dtype=bool)
    new[1:] = (d[1:] != d[:-1]) | (s[1:] != s[:-1]) | (length[1:] != length[:-1])
    d, s, length, q = d[new], s[new], length[new], q[new]
    by = np.lexsort((q, s, d))
    return used[d[by]], s[by], length[by], q[by]


def _kept(size: int, word: np.ndarray, lo: np.ndarray, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Which of ``size`` words stay: all but those of a run after its first period. ``word`` is each run's document."""
    edge = np.zeros(size + 1, dtype=np.int64)
    np.add.at(edge, lo[word] + start + period, 1)
    np.add.at(edge, lo[word] + start + length, -1)
    return np.cumsum(edge[:size]) == 0


def _joined(w: Words, keep: np.ndarray, rows: int) -> pa.Array:
    """Each row's kept words, joined by one space."""
    at = np.flatnonzero(keep)
    size = w.end[at] - w.start[at] + 1
    to = np.cumsum(size) - size
    out = np.full(int(size.sum()), 0x20, dtype=np.uint8)
    inside = np.arange(len(out)) - np.repeat(to, size)
    text = np.flatnonzero(inside < np.repeat(size - 1, size))
    out[text] = w.data[(np.repeat(w.start[at], size) + inside)[text]]
    ends = np.concatenate([[0], np.cumsum(np.bincount(w.row[at], size, minlength=rows)).astype(np.int64)])
    texts = [out[a : max(a, b - 1)].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]
    return pa.array(texts, pa.binary()).cast(pa.string())


_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def find_runs(docs: DataFrame, least: int = 6, times: int = 4) -> DataFrame:
    """All columns of ``docs`` but ``text``, then ``n_words``, ``runs`` and ``collapsed``.

    ``runs``: the runs of words ``[^\\x20\\x09-\\x0D]+`` of the whole text, by start and period: maximal stretches of smallest
    period q, ``least`` words and ``times`` (3 or more) q at least. ``collapsed``: the words joined by one space, without
    those that a run holds after its first q. A null or empty text has no words, no runs and collapses to the empty text;
    repeated rows are judged each; an empty table gives an empty result; columns with the names of results are replaced.
    A task holds a block of texts, or one long text, with up to 900 bytes for each word of texts that are runs throughout.
    """
    if times < 3:
        raise ValueError("times must be 3 or more")
    keep = [f for f in docs.schema.fields if f.name not in ("text", "n_words", "runs", "collapsed")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.get_field_index("text"))
            data, offsets = utf8_rows(column)
            for a, b in blocks(offsets):
                w = Words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                lo, n = w.bounds[:-1], np.diff(w.bounds)
                x = w.ids()
                doc, start, length, period = runs_of(np.concatenate([x, np.full(1, -1, x.dtype)]), lo, n, least, times)
                flat = pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in (start, length, period)], ["start", "length", "period"])
                listed = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(b - a + 1)), pa.int32()), flat).cast(_RUNS)
                collapsed = _joined(w, _kept(len(x), doc, lo, start, length, period), b - a)
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*[part.column(f.name) for f in keep], pa.array(n, pa.int64()), listed, collapsed], [*[f.name for f in keep], "n_words", "runs", "collapsed"])

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in keep)
    return docs.select(*[f"`{f.name}`" for f in keep], "text").mapInArrow(run, f"{fields}n_words long, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string")


def repeat_tails(docs: DataFrame) -> DataFrame:
    """``docs`` with planted runs: where h = crc32 of ``doc_id`` in decimal is a multiple of 10, a text of n words becomes its
    first a words, and p words from there on again and again up to n, joined by one space (g = h // 10, a = g % n,
    p = 1 + (n - a) // (3 + g % 8)). Texts without words, and other rows, stay as they are."""

    def planted(doc_id: int | None, text: str | None) -> str | None:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 or not text or not (words := _WORD.findall(text)):
            return text
        g, n = h // 10, len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        return " ".join([*words[:a], *[words[a + i % p] for i in range(n - a)]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, at = batch.column(batch.schema.get_field_index("doc_id")), batch.schema.get_field_index("text")
            texts = [planted(i.as_py(), t.as_py()) for i, t in zip(ids, batch.column(at), strict=True)]
            yield batch.set_column(at, "text", pa.array(texts, pa.string()))

    return docs.mapInArrow(run, docs.schema)
