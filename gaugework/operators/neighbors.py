"""Nearest rows in feature space, and what they say: hard rows, prototypes, outliers."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugework.functions.columns import clip, entropy2, flags
from gaugework.plans.patterns import to_long, with_totals
from gaugework.plans.scratch import materialize
from gaugework.plans.selection import median

#: Points of a cell, about, and cells of the index at most.
BLOCK, MOST_CELLS = 2048, 1024
#: Beyond this many dimensions nothing is pruned: then all queries are dealt into this many chunks (of at most so many queries), the
#: points into this many slices, and a task compares a chunk with a slice, so a row is sent a number of times that does not grow.
FLAT, SIDES, MOST_QUERIES = 8, 8, 65536
#: Queries, and points, of a tile of products at most, and how large numbers are that products are made of in single precision.
TILE, MOST_SINGLE = 1024, 1e15
#: Points of a leaf at most, and points that are drawn for each cell to cut the cells by.
LEAF, DRAWN = 256, 16
#: Distances are rounded to this many places, so that ties do not depend on the order of sums.
PLACES = 9
#: What rounding and sums can move a distance by, at most: bounds are wider by it.
SLACK = 1e-7
#: A missing label, where rows without one are searched too.
NONE = -(1 << 31)


def _points(rows: DataFrame, vector: str, k: int, kind: str | None, queries: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The distinct vectors (with ``kind``: and labels) of the rows, each with the k + 1 smallest ids that have it, and the point
    of each row (of those in ``queries``). Of equal rows, only those ids can be among a row's k nearest, so a crowd of them is one point."""
    label = F.lit(0) if kind is None else F.coalesce(F.col("label").cast("int"), F.lit(NONE)) if kind == "each" else F.col("label").cast("int")
    data = rows.select("row_id", label.alias("label"), F.col(vector).cast("array<double>").alias("v")).where("v is not null and label is not null")
    data = materialize(data, "data")
    first = Window.partitionBy("v", "label").orderBy("row_id")
    few = data.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= k + 1)
    points = few.groupBy("v", "label").agg(F.array_sort(F.collect_list("row_id")).alias("ids"))
    points = materialize(points.withColumn("point", F.monotonically_increasing_id()), "points")
    if queries is not None:
        data = data.join(queries.select("row_id").distinct().hint("merge"), "row_id", "left_semi")
    members = data.join(points.select("v", "label", "point").hint("merge"), ["v", "label"]).select("row_id", "point")
    return points, materialize(members, "members")


def _cuts(drawn: np.ndarray, cells: int) -> list[tuple]:
    """A tree that cuts space into about so many cells with as many of the drawn points each: (dimension, cut, left, right) by node, the
    first is the root; a negative child is cell -1 - child."""
    nodes: list[tuple] = []
    made = 0

    def grow(v: np.ndarray, cells: int) -> int:
        nonlocal made
        if cells > 1 and len(v) and (spread := np.ptp(v, axis=0)).max() > 0:
            dim = int(spread.argmax())
            x, few = np.sort(v[:, dim]), cells // 2
            cut = x[max(len(x) * few // cells - 1, 0)]
            cut = cut if cut < x[-1] else x[x < x[-1]][-1]
            nodes.append(())
            at, low = len(nodes) - 1, v[:, dim] <= cut
            nodes[at] = (dim, cut, grow(v[low], few), grow(v[~low], cells - few))
            return at
        made += 1
        return -made

    grow(drawn, cells)
    return nodes


def _placed(nodes: list[tuple]):
    """Points with the cell that they are in."""
    dim, cut, left, right = (np.array(c) for c in zip(*nodes, strict=True)) if nodes else [np.zeros(0)] * 4

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.zeros(batch.num_rows, dtype=np.int64) - (not nodes)
            if batch.num_rows and nodes:
                v = _vectors(batch.column("v"), len(batch.column("v")[0]))
                while len(open_ := np.flatnonzero(at >= 0)):
                    now = at[open_]
                    at[open_] = np.where(v[open_, dim[now]] <= cut[now], left[now], right[now])
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("point", "label", "v", "ids", "asked")], pa.array((-1 - at).astype(np.int32))], ["point", "label", "v", "ids", "asked", "cell"])

    return run


def _vectors(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances by a product, exact but for the last digits."""
    d = a @ b.T
    d *= -2
    d += (a * a).sum(axis=1)[:, None]
    d += (b * b).sum(axis=1)[None, :]
    return np.maximum(d, 0, out=d)


class _Best:
    """The smallest (distance, id) pairs of each of some queries, ``size`` at most."""

    def __init__(self, n: int, size: int):
        self.distance, self.id = np.full((n, size), np.inf), np.full((n, size), np.iinfo(np.int64).max)

    def add(self, row: np.ndarray, distance: np.ndarray, ids: np.ndarray) -> None:
        """Takes in pairs (row, distance, id)."""
        if not len(row):
            return
        size = self.distance.shape[1]
        rows = np.unique(row)
        r = np.concatenate([row, np.repeat(rows, size)])
        d, i = np.concatenate([distance, self.distance[rows].ravel()]), np.concatenate([ids, self.id[rows].ravel()])
        order = np.lexsort((i, d, r))
        r, d, i = r[order], d[order], i[order]
        place = np.arange(len(r)) - np.searchsorted(r, r)
        keep = place < size
        self.distance[r[keep], place[keep]], self.id[r[keep], place[keep]] = d[keep], i[keep]


def _near(square: np.ndarray, fit: np.ndarray | None, last: np.ndarray, k: int) -> np.ndarray:
    """Which pairs can be among the k + 1 best of their query, whose last one so far is ``last`` away."""
    wider = lambda d: np.square(d + SLACK * (1 + np.where(np.isfinite(d), d, 0)))
    near = square <= wider(last)[:, None]
    if fit is not None:
        near &= fit
    if square.shape[1] > k + 1 and np.count_nonzero(near) > 4 * (k + 1) * len(square):
        near &= square <= wider(np.sqrt(np.partition(square if fit is None else np.where(fit, square, np.inf), k, axis=1)[:, k]))[:, None]
    return near


def _wider(d: np.ndarray) -> np.ndarray:
    return d + SLACK * (1 + np.where(np.isfinite(d), d, 0))


def _gap(lo: np.ndarray, hi: np.ndarray, box_lo: np.ndarray, box_hi: np.ndarray) -> np.ndarray:
    """Distances between boxes, 0 where they meet."""
    return np.sqrt((np.maximum(0, np.maximum(box_lo - hi, lo - box_hi)) ** 2).sum(axis=-1))


class _Tree:
    """Vectors in leaves of at most ``size`` rows, halved along their widest dimension, with the box of each leaf."""

    def __init__(self, v: np.ndarray, size: int):
        self.order, todo, ends = np.arange(len(v)), [(0, len(v))], []
        while todo:
            a, b = todo.pop()
            if b - a <= size:
                ends.append((a, b))
                continue
            own, half = self.order[a:b], (b - a) // 2
            x = v[own]
            self.order[a:b] = own[np.argpartition(x[:, np.ptp(x, axis=0).argmax()], half)]
            todo += [(a, a + half), (a + half, b)]
        self.ends = sorted(e for e in ends if e[1] > e[0])
        self.v = v[self.order]
        self.lo, self.hi = (np.array([f(self.v[a:b], axis=0) for a, b in self.ends]).reshape(-1, v.shape[1]) for f in (np.min, np.max))


class _Cell:
    """The points of a cell, to be searched."""

    def __init__(self, v: np.ndarray, label: np.ndarray, ids: pa.ListArray, k: int, kind: str | None, leaf: int):
        self.tree, self.k, self.kind, self.leaf = _Tree(v, leaf), k, kind, leaf
        self.label, self.flat = label[self.tree.order], ids.flatten().to_numpy()
        self.many = ids.value_lengths().to_numpy()
        self.start = np.cumsum(self.many) - self.many

    def find(self, v: np.ndarray, label: np.ndarray, bound: np.ndarray) -> tuple[_Best, np.ndarray]:
        """The k + 1 best of each query that are not further than its ``bound``, and with how many points it was compared."""
        best, compared, blocks = _Best(len(v), self.k + 1), np.zeros(len(v), dtype=np.int64), _Tree(v, self.leaf)
        t = self.tree
        for (a, b), lo, hi in zip(blocks.ends, blocks.lo, blocks.hi, strict=True):
            rows = blocks.order[a:b]
            gap = _gap(lo, hi, t.lo, t.hi)
            order = np.lexsort((((t.lo + t.hi - lo - hi) ** 2).sum(axis=1), gap))
            at, step = 0, 1
            while at < len(order):
                last = _wider(np.minimum(bound[rows], best.distance[rows, -1]))
                take = order[at : at + step]
                take = take[gap[take] <= last.max()]
                if not len(take):
                    break
                at, step = at + step, min(2 * step, 16)
                met = _gap(v[rows][:, None], v[rows][:, None], t.lo[take], t.hi[take]) <= last[:, None]
                take, own = take[met.any(axis=0)], rows[met.any(axis=1)]
                if len(take):
                    self._compare(v, label, bound, best, own, np.concatenate([np.arange(*t.ends[x]) for x in take]))
                    compared[own] += sum(t.ends[x][1] - t.ends[x][0] for x in take)
        return best, compared

    def _compare(self, v: np.ndarray, label: np.ndarray, bound: np.ndarray, best: _Best, rows: np.ndarray, points: np.ndarray) -> None:
        q, p = v[rows], self.tree.v[points]
        square = np.zeros((len(q), len(p)))
        for j in range(q.shape[1]):  # differences, not products, which lose digits far from the origin
            square += (q[:, j, None] - p[None, :, j]) ** 2
        fit = _relations(self.kind, label[rows], self.label[points])[0]
        r, c = np.nonzero(_near(square, fit, np.minimum(bound[rows], best.distance[rows, -1]), self.k))
        exact = np.round(np.sqrt(((q[r] - p[c]) ** 2).sum(axis=1)), PLACES)
        place = self.tree.order[points[c]]
        many = self.many[place]
        at = np.repeat(self.start[place], many) + np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
        best.add(np.repeat(rows[r], many), np.repeat(exact, many), self.flat[at])


def _lists(best: _Best) -> pa.ListArray:
    """The pairs (distance, other_id) that were found of each query."""
    there = np.isfinite(best.distance)
    pairs = pa.StructArray.from_arrays([pa.array(best.distance[there]), pa.array(best.id[there])], ["distance", "other_id"])
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(there.sum(axis=1))]).astype(np.int32)), pairs)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, pa.RecordBatch]]:
    """Stretches of one cell and side."""
    for batch in batches:
        cell, side = batch.column("cell").to_numpy(), batch.column("side").to_numpy()
        cut = (np.flatnonzero((cell[1:] != cell[:-1]) | (side[1:] != side[:-1])) + 1).tolist()
        for lo, hi in zip([0, *cut], [*cut, len(cell)], strict=True):
            if hi > lo:
                yield int(cell[lo]), int(side[lo]), batch.slice(lo, hi - lo)


def _joined(held: list[pa.RecordBatch], width: int) -> tuple[np.ndarray, np.ndarray, pa.ListArray]:
    columns = [pa.concat_arrays([b.column(c) for b in held]) for c in ("v", "label", "ids")]
    return _vectors(columns[0], width), columns[1].to_numpy(), columns[2]


_OWN = "point long, label int, v array<double>, bound double, targets array<int>, found array<struct<distance:double,other_id:long>>, compared long"


def _inside(boxes: tuple[np.ndarray, ...], k: int, kind: str | None, width: int, leaf: int):
    """What each cell's queries find in their own cell, and which other cells hold points as near as the last one found.
    ``boxes``: cell, label, points, and box of the points of each cell and label."""
    of, labels, sizes, box_lo, box_hi = boxes

    def outside(cell: int, v: np.ndarray, label: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        fit = lambda rows: np.ones((len(rows), len(of)), dtype=bool) if kind is None else (label[rows][:, None] == labels[None, :]) == (kind == "same")
        open_ = np.flatnonzero(~np.isfinite(bound))
        for a in range(0, len(open_), 256):  # too few partners in the cell: the boxes that surely hold enough bound the distance
            rows = open_[a : a + 256]
            far = np.sqrt((np.maximum(np.abs(v[rows][:, None] - box_lo), np.abs(v[rows][:, None] - box_hi)) ** 2).sum(axis=-1))
            far[~fit(rows)] = np.inf
            order = np.argsort(far, axis=1)
            enough = np.cumsum(sizes[order], axis=1) > k
            first = np.where(enough.any(axis=1), enough.argmax(axis=1), len(of) - 1)
            bound[rows] = np.take_along_axis(far, order, axis=1)[np.arange(len(rows)), first]
        at, to = [np.zeros(0, int)], [np.zeros(0, int)]
        blocks = _Tree(v, leaf)
        for (a, b), lo, hi in zip(blocks.ends, blocks.lo, blocks.hi, strict=True):
            rows = blocks.order[a:b]
            last = _wider(bound[rows])
            near = np.flatnonzero((_gap(lo, hi, box_lo, box_hi) <= last.max()) & (of != cell))
            met = (_gap(v[rows][:, None], v[rows][:, None], box_lo[near], box_hi[near]) <= last[:, None]) & fit(rows)[:, near]
            r, c = np.nonzero(met)
            at.append(rows[r])
            to.append(of[near[c]])
        pairs = np.unique(np.stack([np.concatenate(at), np.concatenate(to)], axis=1), axis=0)
        return pairs[:, 0], pairs[:, 1], bound

    def found(cell: int, held: list[pa.RecordBatch]) -> pa.RecordBatch:
        v, label, ids = _joined(held, width)
        asked = np.flatnonzero(np.concatenate([b.column("asked").to_numpy(zero_copy_only=False) for b in held]))
        point = np.concatenate([b.column("point").to_numpy() for b in held])[asked]
        best, compared = _Cell(v, label, ids, k, kind, leaf).find(v[asked], label[asked], np.full(len(asked), np.inf))
        at, to, bound = outside(cell, v[asked], label[asked], best.distance[:, -1].copy())
        targets = pa.ListArray.from_arrays(pa.array(np.searchsorted(at, np.arange(len(asked) + 1)).astype(np.int32)), pa.array(to.astype(np.int32)))
        vectors = pa.ListArray.from_arrays(pa.array((np.arange(len(asked) + 1) * width).astype(np.int32)), pa.array(v[asked].ravel()))
        columns = [pa.array(point), pa.array(label[asked]), vectors, pa.array(bound), targets, _lists(best), pa.array(compared)]
        return pa.RecordBatch.from_arrays(columns, ["point", "label", "v", "bound", "targets", "found", "compared"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, held = None, []
        for cell, _, part in _runs(batches):
            if cell != place and held:
                yield from _pieces(found(place, held))
                held = []
            place = cell
            held.append(part)
        if held:
            yield from _pieces(found(place, held))

    return run


def _pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for lo in range(0, batch.num_rows, 10_000):
        yield batch.slice(lo, 10_000)


def _visiting(k: int, kind: str | None, width: int, leaf: int):
    """What queries find in other cells: a cell's points (side 0) come first, then its visitors, as many at a time as a batch has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, held, cell = None, [], None
        for at, side, part in _runs(batches):
            if at != place:
                place, held, cell = at, [], None
            if side == 0:
                held.append(part)
            elif held:
                cell = cell or _Cell(*_joined(held, width), k, kind, leaf)
                best, compared = cell.find(_vectors(part.column("v"), width), part.column("label").to_numpy(), part.column("bound").to_numpy())
                yield pa.RecordBatch.from_arrays([part.column("point"), pa.array(np.zeros(part.num_rows, np.int32)), _lists(best), pa.array(compared)], ["point", "relation", "found", "compared"])

    return run


def _relations(kind: str | None, asked: np.ndarray, other: np.ndarray) -> list[np.ndarray | None]:
    """Which pairs of a query's and a point's label belong to each list that is kept (None: all)."""
    if kind is None:
        return [None]
    same, known = asked[:, None] == other[None, :], (asked != NONE)[:, None] & (other != NONE)[None, :]
    return [same & known, ~same & known, ~known] if kind == "each" else [same if kind == "same" else ~same]


class _Chunk:
    """Queries that meet points, tile by tile, and the k + 1 best of each and of each relation.

    With q and p from their middle, |q - p|^2 = |q|^2 - 2 s with s = q p - |p|^2 / 2, so a tile is one product and one comparison with what
    s has to be at least. Products are made in single precision first, and bounds are wider by what it can be wrong by; where
    that lets too many pairs through, in double precision. Pairs that pass are computed by differences."""

    def __init__(self, point: np.ndarray, label: np.ndarray, v: np.ndarray, k: int, kind: str | None):
        self.point, self.label, self.v, self.k, self.kind = point, label, v, k, kind
        self.best = [_Best(len(point), k + 1) for _ in range(3 if kind == "each" else 1)]
        there = np.isfinite(v).all(axis=1)
        self.rows = np.flatnonzero(there)  # nothing is at a distance from the others
        self.middle = v[there].mean(axis=0) if there.any() else np.zeros(v.shape[1])
        self.q = v[there] - self.middle
        with np.errstate(over="ignore"):
            self.square = (self.q * self.q).sum(axis=1)
        ones = np.ones((len(self.q), 1))
        self.wide = {t: np.concatenate([self.q, ones], axis=1).astype(t) for t in (np.float32, np.float64) if t is np.float64 or np.abs(self.q).max(initial=0) < MOST_SINGLE}

    def _relation(self, rows: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which list pairs belong to, and whether to any."""
        if self.kind is None:
            return np.zeros(len(rows), dtype=int), np.ones(len(rows), dtype=bool)
        asked, same = self.label[rows], self.label[rows] == other
        if self.kind != "each":
            return np.zeros(len(rows), dtype=int), same == (self.kind == "same")
        return np.where((asked == NONE) | (other == NONE), 2, np.where(same, 0, 1)), np.ones(len(rows), dtype=bool)

    def _possible(self, rows: np.ndarray, other: np.ndarray) -> list[np.ndarray]:
        """For each list, which queries have partners of it among points of these labels."""
        if self.kind is None:
            return [np.ones(len(rows), dtype=bool)]
        asked, there = self.label[rows], np.unique(other)
        known, named = there[there != NONE], asked != NONE
        among = np.isin(asked, there)
        if self.kind != "each":
            return [among if self.kind == "same" else len(there) > among]
        among &= named
        return [among, named & (len(known) > among), ~named | (len(known) < len(there))]

    def meet(self, label: np.ndarray, v: np.ndarray, ids: pa.ListArray) -> None:
        start, flat = np.concatenate([[0], np.cumsum(ids.value_lengths().to_numpy())]), ids.flatten().to_numpy()
        there = np.flatnonzero(np.isfinite(v).all(axis=1))
        cold = any(not np.isfinite(b.distance[self.rows[some], -1]).all() for b, some in zip(self.best, self._possible(self.rows, label), strict=True))
        at, step = 0, 8 * (self.k + 1) if cold else TILE
        while at < len(there):
            own, at, step = there[at : at + step], at + step, min(4 * step, TILE)
            p = v[own] - self.middle
            with np.errstate(over="ignore"):
                square = (p * p).sum(axis=1)
            sides = {t: np.concatenate([p, -square[:, None] / 2], axis=1).astype(t) for t in self.wide if t is np.float64 or np.abs(p).max(initial=0) < MOST_SINGLE}
            far = np.sqrt(square.max(initial=0))
            for a in range(0, len(self.rows), TILE):
                self._tile(slice(a, min(a + TILE, len(self.rows))), own, far, sides, label, v, start, flat)

    def _tile(self, part: slice, own: np.ndarray, far: float, sides: dict, label: np.ndarray, v: np.ndarray, start: np.ndarray, flat: np.ndarray) -> None:
        rows = self.rows[part]
        last, possible = [b.distance[rows, -1] for b in self.best], self._possible(rows, label[own])
        for t in sides:
            s = self.wide[t][part] @ sides[t].T
            wrong = (len(sides[t][0]) + 16) * np.finfo(t).eps * (self.square[part] + np.sqrt(self.square[part]) * far + far * far)
            need = lambda d, wrong=wrong: (self.square[part] - np.square(_wider(d))) / 2 - wrong
            least = [np.where(some, np.nextafter(need(d).astype(t), t(-np.inf)), t(np.inf)) for d, some in zip(last, possible, strict=True)]
            near = s >= np.minimum.reduce(least)[:, None]
            if (many := np.count_nonzero(near)) > near.size // 16:  # few partners found yet, or few there are
                near = np.zeros(s.shape, dtype=bool)
                for fit, low in zip(_relations(self.kind, self.label[rows], label[own]), least, strict=True):
                    open_ = s if fit is None else np.where(fit, s, t(-np.inf))
                    if s.shape[1] > self.k + 1:
                        kth = np.partition(open_, s.shape[1] - 1 - self.k, axis=1)[:, s.shape[1] - 1 - self.k]
                        low = np.maximum(low, np.nextafter((kth - 2 * wrong).astype(t), t(-np.inf)))
                    near |= (open_ >= low[:, None]) & np.isfinite(open_) if fit is not None else open_ >= low[:, None]
                many = np.count_nonzero(near)
            if t is np.float64 or many <= near.size // 16 or near.size <= 64 * near.shape[0]:
                break
        pairs = np.flatnonzero(near)
        for x in range(0, len(pairs), 1 << 18):
            q, c = np.divmod(pairs[x : x + (1 << 18)], len(own))
            r, to = rows[q], own[c]
            away = self.v[r] - v[to]
            away *= away
            exact = np.round(np.sqrt(away.sum(axis=1)), PLACES)
            relation, fits = self._relation(r, label[to])
            for i, b in enumerate(self.best):
                keep = fits & (relation == i)
                keep[keep] = exact[keep] <= b.distance[r[keep], -1]
                p, d = to[keep], exact[keep]
                several = start[p + 1] - start[p]
                at = np.repeat(start[p], several) + np.arange(int(several.sum())) - np.repeat(np.cumsum(several) - several, several)
                b.add(np.repeat(r[keep], several), np.repeat(d, several), flat[at])


def _search(k: int, kind: str | None, width: int, keys: tuple[str, ...] = ("to", "chunk")):
    """Rows sorted by ``keys`` and side to the k + 1 best of each query under a key: the queries come first, then the points in
    reach, slice by slice. A task holds one key's queries and a batch of points. ``relation`` is 0; of kind "each" 0 for partners of
    the same label, 1 for those of another, 2 where one has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, chunk = None, None
        held: list[tuple] = []

        def begin() -> None:
            nonlocal chunk
            if chunk is None and held:
                chunk = _Chunk(*[np.concatenate(c) for c in zip(*held, strict=True)], k, kind)

        def done() -> Iterator[pa.RecordBatch]:
            begin()
            for relation, b in enumerate(chunk.best if chunk else []):
                yield pa.RecordBatch.from_arrays([pa.array(chunk.point), pa.array(np.full(len(chunk.point), relation, np.int32)), _lists(b)], ["point", "relation", "found"])

        for batch in batches:
            key, side = [batch.column(c).to_numpy() for c in keys], batch.column("side").to_numpy()
            point, label, v = batch.column("point").to_numpy(), batch.column("label").to_numpy(), _vectors(batch.column("v"), width)
            new = np.zeros(max(len(side) - 1, 0), dtype=bool)
            for c in [*key, side]:
                new |= c[1:] != c[:-1]
            cut = np.flatnonzero(new) + 1
            for lo, hi in zip([0, *cut.tolist()], [*cut.tolist(), len(side)], strict=True):
                if (here := tuple(c[lo] for c in key)) != place:
                    if place is not None:
                        yield from done()
                    place, chunk, held = here, None, []
                if side[lo] == 0:
                    held.append((point[lo:hi], label[lo:hi], v[lo:hi]))
                    continue
                begin()
                if chunk is not None:
                    chunk.meet(label[lo:hi], v[lo:hi], batch.column("ids").slice(lo, hi - lo))
        if place is not None:
            yield from done()

    return run


_FOUND = "point long, relation int, found array<struct<distance:double,other_id:long>>"


def _listed(members: DataFrame, best: DataFrame, k: int, by: Sequence[str] = ()) -> DataFrame:
    """What searches found of each point (in several keys maybe) to the k best of each row that has it: (row_id, other_id,
    distance, rank), and ``by`` first, where lists are kept by it."""
    lists = best.groupBy("point", *by).agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("found")))).alias("_b"))
    met = members.join(lists.hint("merge"), "point")
    own = F.slice(F.filter("_b", lambda b: b["other_id"] != F.col("row_id")), 1, k)
    return met.select("row_id", *by, F.posexplode(own).alias("_i", "_n")).select("row_id", *by, "_n.other_id", "_n.distance", (F.col("_i") + 1).cast("int").alias("rank"))


def _parts(rows: DataFrame) -> int:
    return int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _crossed(points: DataFrame, asked: DataFrame, keys: dict[str, object], chunks: int) -> DataFrame:
    """Queries (side 0) of each chunk and points (side 1) of each slice, for each pair of a chunk and a slice, beside ``keys``."""
    cast = {"point": "long", "label": "int", "v": "array<double>", "ids": "array<bigint>"}
    every = lambda n: F.explode(F.array(*[F.lit(i) for i in range(n)]))
    deal = lambda n, salt: F.pmod(F.xxhash64("point", F.lit(salt)), F.lit(n)).cast("int")
    rest = [F.col(c).cast(t).alias(c) for c, t in cast.items()]
    q = asked.withColumns({"chunk": deal(chunks, "chunk"), "side": F.lit(0)}).withColumn("slice", every(SIDES))
    p = points.withColumns({"slice": deal(SIDES, "slice"), "side": F.lit(1)}).withColumn("chunk", every(chunks))
    return q.select(*keys, "chunk", "slice", "side", *rest).unionByName(p.select(*keys, "chunk", "slice", "side", *rest))


def _all_pairs(points: DataFrame, members: DataFrame, k: int, kind: str | None) -> DataFrame:
    """The k + 1 best of every asked point, by comparing chunks of queries with slices of points."""
    asked = points.join(members.select("point").distinct().hint("merge"), "point", "left_semi")
    chunks = max(SIDES, -(-asked.count() // MOST_QUERIES))
    width = len(points.first()["v"])
    sent = _crossed(points, asked, {}, chunks).repartition(_parts(points), "chunk", "slice").sortWithinPartitions("chunk", "slice", "side")
    return sent.mapInArrow(_search(k, kind, width, ("chunk", "slice")), _FOUND)


def _index(rows: DataFrame, vector: str, k: int, kind: str | None, queries: DataFrame | None, block: int) -> dict | None:
    """What a search found of each point: in cells of points, first in its own cell, then in those that hold points as near as the
    last one found there. In more than ``FLAT`` dimensions the best of all pairs."""
    points, members = _points(rows, vector, k, kind, queries)
    head = points.first()
    if head is None:
        return None
    width = len(head["v"])
    if kind == "each" or width > FLAT:
        return {"best": _all_pairs(points, members, k, kind), "members": members, "points": points}
    points = points.where(F.forall("v", lambda x: F.abs(x) < float("inf")))  # no others are at a distance
    n = points.count()
    cells, leaf = min(MOST_CELLS, max(1, -(-n // block))), min(LEAF, block)
    # The cells are cut at points with the smallest hashes. They are of a bounded number, and so is the table of boxes.
    drawn = [r["v"] for r in points.select("v", "point").orderBy(F.xxhash64("point"), "point").limit(cells * DRAWN).collect()]
    nodes = _cuts(np.array(drawn, dtype=float).reshape(len(drawn), width), cells)
    if queries is None:
        points = points.withColumn("asked", F.lit(True))
    else:
        asked = members.select("point").distinct().withColumn("asked", F.lit(True))
        points = points.join(asked.hint("merge"), "point", "left").withColumn("asked", F.coalesce("asked", F.lit(False)))
    placed = materialize(points.mapInArrow(_placed(nodes), "point long, label int, v array<double>, ids array<bigint>, asked boolean, cell int"), "placed")
    ends = [f(F.get("v", F.lit(j))).alias(f"{f.__name__}{j}") for f in (F.min, F.max) for j in range(width)]
    boxes = placed.groupBy("cell", "label").agg(F.count("*").alias("n"), *ends).collect()
    table = np.array([tuple(r) for r in boxes], dtype=float).reshape(len(boxes), 3 + 2 * width)
    box = (*[table[:, i].astype(int) for i in range(3)], table[:, 3 : 3 + width], table[:, 3 + width :])
    side = placed.withColumns({"side": F.lit(0), "bound": F.lit(0.0)})
    own = side.repartition(_parts(rows), "cell").sortWithinPartitions("cell").mapInArrow(_inside(box, k, kind, width, leaf), _OWN)
    own = materialize(own, "own")
    visitors = own.where(F.size("targets") > 0).select(F.explode("targets").alias("cell"), F.lit(1).alias("side"), "point", "label", "v", F.array().cast("array<bigint>").alias("ids"), "bound")
    sent = side.select(*visitors.columns).unionByName(visitors).repartition(_parts(rows), "cell").sortWithinPartitions("cell", "side")
    met = sent.mapInArrow(_visiting(k, kind, width, leaf), f"{_FOUND}, compared long")
    best = own.select("point", F.lit(0).alias("relation"), "found", "compared").unionByName(met)
    return {"best": best, "members": members, "points": points, "cells": len(nodes) + 1}


def nearest(rows: DataFrame, vector: str, k: int = 5, kind: str | None = None, queries: DataFrame | None = None, block: int | None = None) -> DataFrame:
    """The k exact nearest other rows of each row (or of those whose ``row_id`` is in ``queries``): (row_id, other_id, distance, rank),
    distances rounded to 9 places, ties by id.

    Points (distinct vectors) are dealt into cells of a tree. A cell's queries are searched in it, and the last distance found says
    which other cells' boxes can hold something nearer: only there a query is sent. A crowd of equal rows is one point, and
    of a cell's points only the leaves of its own tree that are in reach are compared, so the work follows the rows. In
    few dimensions most pairs are never looked at (``pruning`` says how many); in many, the work becomes that of all pairs,
    spread over the chunks. ``kind`` (same, opposite) limits partners by the column ``label``; rows without a vector, or with
    ``kind`` without a label, have no partners and are none. An empty table gives an empty result."""
    found = _index(rows, vector, k, kind, queries, block or BLOCK)
    if found is None:
        return rows.sparkSession.createDataFrame([], "row_id long, other_id long, distance double, rank int")
    return materialize(_listed(found["members"], found["best"], k), "nearest")  # the search is made once, however often it is read


def nearest_by_class(rows: DataFrame, vector: str, k: int = 5) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(all, same, opposite): what ``nearest`` gives without ``kind``, and for the kinds same and opposite, from one search: the k
    nearest of all are among the k nearest of each relation."""
    found = _index(rows, vector, k, "each", None, BLOCK)
    if found is None:
        none = rows.sparkSession.createDataFrame([], "row_id long, other_id long, distance double, rank int")
        return none, none, none
    best = materialize(found["best"], "best")
    lists = materialize(_listed(found["members"], best, k, ["relation"]), "lists")
    whole = _listed(found["members"], best, k)
    return whole, *[lists.where(F.col("relation") == r).drop("relation") for r in (0, 1)]


def pruning(rows: DataFrame, vector: str, k: int = 5, kind: str | None = None, queries: DataFrame | None = None, block: int | None = None) -> DataFrame:
    """One row on the search that ``nearest`` makes with these arguments: points, queries (points that are one), cells, pairs of a query
    and a point that are compared, and the share of all pairs that is not."""
    found = _index(rows, vector, k, kind, queries, block or BLOCK)
    if found is None:
        return rows.sparkSession.createDataFrame([(0, 0, 0, 0, 0.0)], "points long, queries long, cells long, pairs long, pruned double")
    points, asked = found["points"].count(), found["members"].select("point").distinct().count()
    if "cells" in found:
        made = found["best"].agg(F.coalesce(F.sum("compared"), F.lit(0)).cast("long").alias("pairs"))
    else:
        made = rows.sparkSession.range(1).select(F.lit(points * asked).cast("long").alias("pairs"))
    every = float(points) * asked
    return made.select(F.lit(points).cast("long").alias("points"), F.lit(asked).cast("long").alias("queries"), F.lit(found.get("cells", 1)).cast("long").alias("cells"), "pairs", (1 - F.col("pairs") / F.lit(max(every, 1.0))).alias("pruned"))


def nearest_approximately(rows: DataFrame, vector: str, k: int = 5, bucket_length: float = 1.0, tables: int = 6, radius: float = 4.0, seed: int = 42, queries: DataFrame | None = None) -> DataFrame:
    """Like ``nearest``, by random projections of Spark ML: partners that share no bucket are missed, and the column
    ``approximate`` says so; ``recall`` measures how many.

    Every row is in one bucket of each table. Queries and points of a bucket meet in chunks and slices, and only the k + 1
    best of each query leave a task, so no pair of rows is ever a row of a table."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector, vector_to_array

    points, members = _points(rows, vector, k, None, queries)
    if points.isEmpty():
        return rows.sparkSession.createDataFrame([], "row_id long, other_id long, distance double, rank int, approximate boolean")
    data = points.withColumn("features", array_to_vector("v"))
    model = BucketedRandomProjectionLSH(inputCol="features", outputCol="hashes", bucketLength=bucket_length, numHashTables=tables, seed=seed).fit(data)
    hashed = model.transform(data).select("point", "label", "v", "ids", F.posexplode("hashes").alias("table", "_h")).withColumn("bucket", vector_to_array("_h")[0].cast("long")).drop("_h")
    hashed = materialize(hashed, "hashed")
    wanted = members.select("point").distinct()
    asked = hashed.join(wanted.hint("merge"), "point", "left_semi")
    sent = _crossed(hashed, asked, {"table": 0, "bucket": 0}, max(1, -(-wanted.count() // MOST_QUERIES)))
    keys = ("table", "bucket", "chunk", "slice")
    best = sent.repartition(_parts(rows), *keys).sortWithinPartitions(*keys, "side").mapInArrow(_search(k, None, len(points.first()["v"]), keys), _FOUND)
    return _listed(members, best, k).where(F.col("distance") < radius).withColumn("approximate", F.lit(True))


def recall(rows: DataFrame, vector: str, found: DataFrame, k: int = 5, every: int = 20) -> DataFrame:
    """One row: of the exact k nearest of the rows whose id is divisible by ``every``, searched among all rows, the share that ``found``
    (row_id, other_id) has."""
    queries = rows.where(F.col("row_id") % every == 0)
    exact = nearest(rows, vector, k, queries=queries).select("row_id", "other_id")
    hit = exact.join(found.select("row_id", "other_id").distinct().withColumn("hit", F.lit(1)).hint("merge"), ["row_id", "other_id"], "left")
    return hit.agg(F.countDistinct("row_id").alias("queries"), F.count("*").alias("neighbours"), F.avg(F.coalesce("hit", F.lit(0)).cast("double")).alias("recall"))


def hardness(rows: DataFrame, neighbours: DataFrame) -> DataFrame:
    """What the k neighbours of each row vote, how mixed they are, and a hardness score with flags."""
    labels = rows.select("row_id", "label")
    met = neighbours.join(labels.select(F.col("row_id").alias("other_id"), F.col("label").alias("other")).hint("merge"), "other_id").join(labels.hint("merge"), "row_id")
    s = met.groupBy("row_id", "label").agg(F.avg(F.col("other").cast("double")).alias("vote"), F.avg((F.col("other") != F.col("label")).cast("double")).alias("opposite_share"), F.avg("distance").alias("mean_distance"))
    s = s.withColumn("predicted", (F.col("vote") >= 0.5).cast("int")).withColumn("entropy", entropy2(F.col("vote"))).withColumn("wrong", F.col("predicted") != F.col("label"))
    score = 0.5 * F.col("opposite_share") + 0.25 * F.col("entropy") + 0.15 * (1 - F.abs(2 * F.col("vote") - 1)) + 0.1 * F.col("wrong").cast("int")
    s = s.withColumn("hardness", clip(score, 0.0, 1.0))
    return s.withColumn("flags", flags(
        label_issue_candidate=F.col("wrong") & (F.col("opposite_share") >= 0.8), ambiguous=F.col("entropy") >= 0.9, hard_row=F.col("hardness") >= 0.65, locally_easy=(F.col("opposite_share") == 0) & (F.col("entropy") <= 0.05),
    ))


def prototypes(rows: DataFrame, neighbours: DataFrame, same: DataFrame, opposite: DataFrame) -> DataFrame:
    """Prototype, boundary, isolation and contradiction scores of each row, from its k nearest rows of any class, of its own
    class (``same``) and its nearest of the other (``opposite``)."""
    eps = 1e-12
    labels = rows.select("row_id", "label")
    met = neighbours.join(labels.select(F.col("row_id").alias("other_id"), F.col("label").alias("other")).hint("merge"), "other_id").join(labels.hint("merge"), "row_id")
    opp = met.groupBy("row_id", "label").agg(F.avg((F.col("other") != F.col("label")).cast("double")).alias("opp"))
    s = same.groupBy("row_id").agg(F.min("distance").alias("ns"), F.avg("distance").alias("same_mean"))
    o = opposite.groupBy("row_id").agg(F.min("distance").alias("no"))
    t = materialize(opp.join(s.hint("merge"), "row_id").join(o.hint("merge"), "row_id"), "t")  # the searches below it are made once
    med = median(t, "same_mean", ["label"], "med").withColumn("med", F.greatest("med", F.lit(eps)))
    t = t.join(F.broadcast(med), "label")
    whole = F.col("ns") + F.col("no") + eps
    t = t.withColumn("closeness", F.col("ns") / whole).withColumn("margin", F.col("no") / whole).withColumn("density", F.col("med") / (F.col("same_mean") + F.col("med") + eps))
    r = F.greatest(F.lit(0.0), F.col("same_mean") / (F.col("med") + eps) - 1)
    t = t.withColumns({
        "prototype": 0.45 * (1 - F.col("opp")) + 0.35 * F.col("density") + 0.2 * F.col("margin"), "boundary": 0.65 * F.col("opp") + 0.35 * F.col("closeness"), "isolation": r / (1 + r), "contradiction": 0.7 * F.col("opp") + 0.3 * F.col("closeness"),
    })
    named = flags(prototype=(F.col("prototype") >= 0.65) & (F.col("opp") <= 0.2), boundary=F.col("boundary") >= 0.35, isolated=F.col("isolation") >= 0.45, contradiction=F.col("contradiction") >= 0.55)
    return t.select("row_id", "label", "prototype", "boundary", "isolation", "contradiction", named.alias("flags"))


def robust_scale(rows: DataFrame, features: Sequence[str]) -> DataFrame:
    """``rows`` with ``z_<feature>``: distance from the median in 1.4826 median absolute deviations (1 where that is 0)."""
    long = to_long(rows, features, ())
    med = materialize(median(long, "value", ["feature"], "med"), "med")  # a row for each feature
    away = long.join(F.broadcast(med), "feature").select("feature", F.abs(F.col("value") - F.col("med")).alias("away"))
    mad = median(away, "away", ["feature"], "mad").withColumn("mad", 1.4826 * F.col("mad")).join(F.broadcast(med), "feature")
    mad = mad.withColumn("mad", F.when(F.col("mad") > 0, F.col("mad")).otherwise(1.0))
    wide = mad.agg(*[F.max(F.when(F.col("feature") == f, F.struct("med", "mad"))).alias(f"_{f}") for f in features])
    return with_totals(rows, wide).withColumns({f"z_{f}": (F.col(f) - F.col(f"_{f}.med")) / F.col(f"_{f}.mad") for f in features}).drop(*[f"_{f}" for f in features])


def outliers(rows: DataFrame, features: Sequence[str], threshold: float = 0.5, score: str | None = None) -> DataFrame:
    """How far out each row is: robust z, isolation from its nearest row, and (with ``score``) the model's surprise."""
    z = robust_scale(rows, features).withColumn("_v", F.array(*[f"z_{f}" for f in features]))
    near = nearest(z.select("row_id", "_v"), "_v", 1).select("row_id", F.col("distance").alias("nn"))
    t = materialize(z.join(near.hint("merge"), "row_id", "left").na.fill(0.0, ["nn"]), "t")  # the search below it is made once
    med = materialize(median(t, "nn", (), "_mn"), "med")
    away = with_totals(t.select("nn"), med).select(F.abs(F.col("nn") - F.col("_mn")).alias("away"))
    t = with_totals(with_totals(t, med), median(away, "away", (), "_dn").withColumn("_dn", 1.4826 * F.col("_dn")))
    t = t.withColumn("max_z", F.greatest(*[F.abs(f"z_{f}") for f in features], F.lit(0.0))).withColumn("mean_z", sum((F.abs(f"z_{f}") for f in features), F.lit(0.0)) / len(features))
    t = t.withColumn("excess", F.greatest(F.lit(0.0), (F.col("nn") - F.col("_mn")) / F.when(F.col("_dn") > 0, F.col("_dn")).otherwise(F.greatest("_mn", F.lit(1.0)))))
    b = lambda v: v / (1 + v)
    total = 0.55 * b(F.col("max_z") / 3) + 0.25 * b(F.col("mean_z") / 2) + 0.2 * b(F.col("excess"))
    named = {"feature_tail": F.col("max_z") >= 4, "broad_tail": F.col("mean_z") >= 2, "isolated": F.col("excess") >= 3}
    if score:
        p, y = F.col(score), F.col("label") == 1
        t = t.withColumn("loss", -F.log(F.greatest(F.when(y, p).otherwise(1 - p), F.lit(1e-7)))).withColumn("confidence", F.when(p >= threshold, p).otherwise(1 - p)).withColumn("wrong", (p >= threshold) != y)
        unsure = 1 - F.least(F.abs(p - threshold) / max(threshold, 1 - threshold), F.lit(1.0))
        total = total + 0.5 * b(F.col("loss")) + 0.2 * unsure + 0.3 * F.col("wrong").cast("int")
        named |= {"wrong": F.col("wrong"), "high_loss": F.col("loss") >= 1, "low_confidence": F.col("confidence") <= 0.6}
    t = t.withColumn("ood_score", total)
    named["ood"] = F.col("ood_score") >= threshold
    return t.select("row_id", "max_z", "mean_z", "nn", "excess", "ood_score", flags(**named).alias("flags"))
