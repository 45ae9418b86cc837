"""Search over many logistic models at once: every pass over the rows serves all trials.

All trials are weight columns of a few stacked matrices, one for each feature map. A pass multiplies each batch of rows with
them and sums the gradients of all trials; the driver takes one step for each. Only a bounded number of rows leave the
executors, to say where to begin, and the number of passes does not depend on the number of trials."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugework.functions.columns import hash_uniform, ratio, with_rates
from gaugework.operators.prep import fit_standardizer, stratified_split
from gaugework.plans.scratch import materialize

#: Feature maps: name, random components, width of the kernel.
MAPS = [("linear", 0, 0.0), ("quadratic", 0, 0.0), ("rff", 32, 0.5), ("rff", 32, 1.0), ("rff", 64, 0.5), ("rff", 64, 1.0)]
L2 = [10.0 ** (e / 2) for e in range(-12, 0)]
#: Powers of the balanced class weights, and shares of the training rows.
BALANCE, SHARES = (0.0, 0.5, 1.0), (0.5, 1.0)
#: Passes over the training rows at most, and bins of scores that a threshold is chosen among.
PASSES, BINS = 40, 1000
#: A fit ends when a step would lower its loss by less than half of this. Rows that say where to begin, about, and
#: the first steps on them.
ENOUGH, START, ROUGH = 1e-10, 20_000, 12


@dataclass(frozen=True)
class Trial:
    feature_map: str
    components: int
    gamma: float
    l2: float
    balance: float
    share: float


def space() -> list[Trial]:
    """All 432 points: 6 maps, 12 penalties, 3 class balances, 2 shares of rows."""
    return [Trial(*m, l2, b, s) for m in MAPS for l2 in L2 for b in BALANCE for s in SHARES]


def drawn(trials: int, seed: int = 42) -> list[Trial]:
    """So many points without repeats, in the order of their hash."""
    every = space()
    if trials > len(every):
        raise ValueError(f"there are {len(every)} points")
    return sorted(every, key=lambda t: hashlib.md5(f"{seed}:{t}".encode()).hexdigest())[:trials]


def mapped(x: np.ndarray, kind: tuple, seed: int) -> np.ndarray:
    """Standardized rows under a feature map, with a column of ones last."""
    name, components, gamma = kind
    cols = [x]
    if name == "quadratic":
        i, j = np.triu_indices(x.shape[1])
        cols = [x, x[:, i] * x[:, j]]
    elif name == "rff":
        rng = np.random.default_rng([seed, components, int(gamma * 1000)])
        w, b = rng.standard_normal((x.shape[1], components)) * np.sqrt(2 * gamma), rng.uniform(0, 2 * np.pi, components)
        cols = [np.cos(x @ w + b) * np.sqrt(2 / components)]
    return np.concatenate([*cols, np.ones((len(x), 1))], axis=1)


def _sum_over(rows: DataFrame, each: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum, over all batches (x, label, u) of ``rows``, of an array of fixed length: added up in tasks, then place by place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False)
            if batch.num_rows:
                part = each(x.reshape(batch.num_rows, -1), batch.column("label").to_numpy().astype(float), batch.column("u").to_numpy())
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], ["at", "value"])

    found = rows.mapInArrow(run, "at int, value double").groupBy("at").agg(F.sum("value").alias("value")).orderBy("at").collect()
    return np.array([r["value"] for r in found])


def _grams(kinds: list, seed: int, x: np.ndarray, y: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Of each map and class, sums of products of columns; then rows and positives, of all and of the first half by u."""
    out = []
    for kind in kinds:
        m = mapped(x, kind, seed)
        out += [(m[y == c].T @ m[y == c]).ravel() for c in (0, 1)]
    half = u < 0.5
    return np.concatenate([*out, [len(y), y.sum(), half.sum(), y[half].sum()]])


def _parts(trials: list[Trial], y: np.ndarray, u: np.ndarray):
    """Rows and trials that belong together: of one class and one share of rows."""
    for share in SHARES:
        own = np.flatnonzero([t.share == share for t in trials])
        for c in (0, 1) if len(own) else ():
            yield c, own, np.flatnonzero((y == c) & (u < share))


def _chances(m: np.ndarray, w: np.ndarray) -> np.ndarray:
    p = m @ w
    np.negative(p, out=p)
    with np.errstate(over="ignore"):
        np.exp(p, out=p)
    p += 1
    return np.reciprocal(p, out=p)


def _gradients(kinds: list, trials: list[list[Trial]], weights: list[np.ndarray], scales: list[np.ndarray], seed: int, x: np.ndarray, y: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Sums of the trials' gradients; ``scales`` of each map: [class, trial], the weight of a row of that class."""
    out = []
    for kind, own, w, scale in zip(kinds, trials, weights, scales, strict=True):
        total = np.zeros(w.shape)
        if own:
            m = mapped(x, kind, seed)
            for c, at, rows in _parts(own, y, u):
                part = m[rows]
                total[:, at] += (part.T @ _chances(part, w[:, at]) - c * part.sum(axis=0)[:, None]) * scale[c, at]
        out.append(total.ravel())
    return np.concatenate(out)


def _curvature(kind: tuple, trials: list[Trial], w: np.ndarray, scale: np.ndarray, seed: int, x: np.ndarray, y: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Second derivatives of each trial of one map: [trial, column, column]."""
    m = mapped(x, kind, seed)
    out = np.zeros((len(trials), m.shape[1], m.shape[1]))
    for c, at, rows in _parts(trials, y, u):
        part = m[rows]
        p = _chances(part, w[:, at])
        p *= 1 - p
        for i, t in enumerate(at):
            out[t] += (part.T * p[:, i]) @ part * scale[c, t]
    return out


def _learn(inverse: np.ndarray, own: np.ndarray, step: np.ndarray, change: np.ndarray) -> None:
    """Changes the inverse curvatures of the trials ``own`` so that each says of its last step what the gradient's change says (BFGS)."""
    along = (step * change).sum(axis=0)
    fit = np.flatnonzero(along > 1e-30)
    s, y, rate = step[:, fit].T, change[:, fit].T, 1 / along[fit]
    h = inverse[own[fit]]
    hy = np.einsum("tij,tj->ti", h, y)
    both = (1 + rate * (y * hy).sum(axis=1)) * rate
    inverse[own[fit]] = h + both[:, None, None] * s[:, :, None] * s[:, None, :] - rate[:, None, None] * (hy[:, :, None] * s[:, None, :] + s[:, :, None] * hy[:, None, :])


def _descend(gradients: Callable, now: list[np.ndarray], ridge: list[np.ndarray], steep: list[np.ndarray], close: list[np.ndarray] | None, passes: int) -> list[np.ndarray]:
    """Steps from ``now`` until g C g is below ``ENOUGH`` for each trial, g its gradient, or so many passes are made. C is ``close``, inverses of
    the curvature near the optimum, to which each pass adds what the last step told of it (start rows may lack a direction). A trial
    whose steps with these do not get on goes back to its best place and takes accelerated steps with ``steep``, inverses of
    an upper bound of the curvature, which always lead down. ``gradients`` gets the weights and which trials of each map are open."""
    measure = [m.copy() for m in (steep if close is None else close)]
    before: list[tuple | None] = [None] * len(now)
    now, ahead, held = now, [w.copy() for w in now], [w.copy() for w in now]
    least, slow, pace = ([np.full(w.shape[1], v) for w in now] for v in (np.inf, close is None, 1.0))
    open_ = [np.arange(w.shape[1]) for w in now]
    for _ in range(passes):
        if not any(len(o) for o in open_):
            break
        found = gradients([a[:, o] for a, o in zip(ahead, open_, strict=True)], open_)
        for k, (own, g) in enumerate(zip(open_, found, strict=True)):
            if not len(own):
                continue
            g = g + ridge[k][:, own] * ahead[k][:, own]
            if close and before[k] is not None:
                _learn(measure[k], own, ahead[k][:, own] - before[k][0][:, own], g - before[k][1][:, own])
            if close:
                before[k] = (ahead[k].copy(), np.zeros_like(ahead[k]))
                before[k][1][:, own] = g
            gap = np.einsum("jt,tij,it->t", g, measure[k][own], g)
            stuck = ~slow[k][own] & ~(gap < 0.9 * least[k][own])  # a gap that is no number, too
            best = gap < least[k][own]
            held[k][:, own[best]], least[k][own[best]] = ahead[k][:, own[best]], gap[best]
            slow[k][own[stuck]] = True
            quick = np.einsum("tij,jt->it", np.where(slow[k][own][:, None, None], steep[k][own], measure[k][own]), g)
            new = np.where(stuck, held[k][:, own], ahead[k][:, own] - quick)
            old = now[k][:, own]
            back = stuck | ~slow[k][own] | ((g * (new - old)).sum(axis=0) > 0)  # the step went uphill: its momentum starts again
            t = np.where(back, 1.0, pace[k][own])
            later = (1 + np.sqrt(1 + 4 * t * t)) / 2
            ahead[k][:, own] = new + np.where(back, 0.0, (t - 1) / later) * (new - old)
            now[k][:, own], pace[k][own] = new, later
            open_[k] = own[~(gap < ENOUGH)]
    return now


def fit_all(train: DataFrame, trials: Sequence[Trial], seed: int = 42, passes: int = PASSES) -> dict[Trial, np.ndarray]:
    """The weights of each trial (bias last): logistic regression of rows (x, label, u) with mean weighted loss plus l2 / 2 of the squared
    weights (not of the bias).

    Every trial is fitted to all rows, until its gradient over all of them is as good as none. At most ``START`` rows, dealt by hash
    and class, only say where to begin and how the loss is curved there, so that a few passes over all rows are enough."""
    kinds = [k for k in MAPS if any((t.feature_map, t.components, t.gamma) == k for t in trials)]
    grouped = [[t for t in trials if (t.feature_map, t.components, t.gamma) == k] for k in kinds]
    sums = _sum_over(train, partial(_grams, kinds, seed))
    n, pos, n_half, pos_half = sums[-4:]
    counts = {1.0: (n - pos, pos), 0.5: (n_half - pos_half, pos_half)}
    balance = {}
    for b in BALANCE:
        for s, per in counts.items():
            raw = [(sum(per) / (2 * max(c, 1.0))) ** b for c in per]
            whole = max(raw[0] * per[0] + raw[1] * per[1], 1e-12)
            balance[b, s] = [r / whole for r in raw]
    scales = [np.array([[balance[t.balance, t.share][c] for t in own] for c in (0, 1)]) for own in grouped]
    width = _width(train)
    at, steep, ridge, zero = 0, [], [], []
    for kind, own, scale in zip(kinds, grouped, scales, strict=True):
        d = mapped(np.zeros((1, width)), kind, seed).shape[1]
        by_class = [sums[at + c * d * d : at + (c + 1) * d * d].reshape(d, d) for c in (0, 1)]
        at += 2 * d * d
        solved = []
        for i, t in enumerate(own):
            # A quarter of the weighted products is the most the curvature can be; a share's are taken in proportion, a fifth larger for chance.
            curve = sum(scale[c, i] * by_class[c] * counts[t.share][c] / max(counts[1.0][c], 1.0) for c in (0, 1)) * (0.25 if t.share == 1.0 else 0.3)
            solved.append(np.linalg.inv(curve + np.diag([t.l2] * (d - 1) + [0.0]) + 1e-9 * np.eye(d)))
        steep.append(np.stack(solved))
        ridge.append(np.stack([np.array([t.l2] * (d - 1) + [0.0]) for t in own], axis=1))
        zero.append(np.zeros((d, len(own))))
    x, y, u = _start_rows(train, counts[1.0])
    few = {s: [max(((y == c) & (u < s)).sum(), 1) for c in (0, 1)] for s in SHARES}
    larger = [scale * np.array([[counts[t.share][c] / few[t.share][c] for t in own] for c in (0, 1)]) for own, scale in zip(grouped, scales, strict=True)]
    chosen = lambda open_: [[own[i] for i in o] for own, o in zip(grouped, open_, strict=True)]
    shaped = lambda flat, ws: [f.reshape(w.shape) for f, w in zip(np.split(flat, np.cumsum([w.size for w in ws])[:-1]), ws, strict=True)]
    near = lambda ws, open_: shaped(_gradients(kinds, chosen(open_), ws, [c[:, o] for c, o in zip(larger, open_, strict=True)], seed, x, y, u), ws)
    whole = lambda ws, open_: shaped(_sum_over(train, partial(_gradients, kinds, chosen(open_), ws, [c[:, o] for c, o in zip(scales, open_, strict=True)], seed)), ws)
    begin = _descend(near, zero, ridge, steep, None, ROUGH)
    for left in (3, 3, 0):  # steps with the curvature of where they begin, then the curvature at their end
        close = []
        for kind, own, w, scale, r in zip(kinds, grouped, begin, larger, ridge, strict=True):
            bent = _curvature(kind, own, w, scale, seed, x, y, u)
            close.append(np.linalg.inv(bent + np.stack([np.diag(c) for c in r.T]) + 1e-9 * np.eye(len(w))))
        begin = _descend(near, begin, ridge, steep, close, left)
    fitted = _descend(whole, begin, ridge, steep, close, passes)
    return {t: fitted[k][:, i] for k, own in enumerate(grouped) for i, t in enumerate(own)}


def _start_rows(train: DataFrame, counts: tuple[float, float]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """About ``START`` rows, half of each class where there are as many, in the order of their hashes."""
    share = F.when(F.col("label") == 1, START / 2 / max(counts[1], 1.0)).otherwise(START / 2 / max(counts[0], 1.0))
    place = F.xxhash64("x", "u", "label")
    found = train.withColumn("_h", place).where(F.pmod("_h", F.lit(1 << 30)) < share * (1 << 30)).select("x", "label", "u", "_h").orderBy("_h").collect()
    return np.array([r["x"] for r in found], dtype=float).reshape(len(found), -1), np.array([r["label"] for r in found], dtype=float), np.array([r["u"] for r in found], dtype=float)


def _width(rows: DataFrame) -> int:
    return rows.select(F.size("x").alias("n")).first()["n"]


def _scores(trials: list[Trial], weights: list[np.ndarray], seed: int):
    """Counts of scores by trial, bin and label, with sums of scores and losses: a task's rows are bins, however many rows it read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = np.zeros((len(trials), BINS + 1, 5))
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1), batch.column("label").to_numpy().astype(float)
            maps: dict = {}
            for i, (t, w) in enumerate(zip(trials, weights, strict=True)):
                kind = (t.feature_map, t.components, t.gamma)
                if kind not in maps:
                    maps[kind] = mapped(x, kind, seed)
                p = 1 / (1 + np.exp(-np.clip(maps[kind] @ w, -40, 40)))
                bin_ = np.floor(p * BINS + 1e-9).astype(int)
                q = np.clip(np.where(y == 1, p, 1 - p), 1e-7, 1)
                for c, value in enumerate((y, 1 - y, p, (p - y) ** 2, -np.log(q))):
                    kept[i, :, c] += np.bincount(bin_, value, minlength=BINS + 1)
        i, b = np.nonzero(kept[:, :, 0] + kept[:, :, 1])
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(b.astype(np.int32)), *[pa.array(kept[i, b, c]) for c in range(5)]], ["trial_index", "bin", "pos", "neg", "p", "brier", "loss"])

    return run


def shared_search(examples: DataFrame, features: Sequence[str], trials: int = 432, seed: int = 42) -> DataFrame:
    """A trial history: ``trials`` points of the space, fitted together on 70 % of the rows and judged on the others at the threshold (of
    a grid of thousandths) with the best F1, ranked by F1, accuracy and the smaller loss. Needs both classes."""
    chosen = drawn(trials, seed)
    parts = stratified_split(examples.select("row_id", "label", *features), {"train": 0.7, "validation": 0.3}, seed)
    scale = {r["feature"]: r for r in fit_standardizer(parts.where("split = 'train'"), features).collect()}  # a row for each feature
    x = F.array(*[(F.col(f) - scale[f]["mean"]) / scale[f]["scale"] for f in features])
    rows = parts.select("split", "label", x.alias("x"), hash_uniform(F.col("row_id"), seed, "share").alias("u"))
    rows = materialize(rows.repartition(int(examples.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "rows")  # few bytes, but much work
    fitted = fit_all(rows.where("split = 'train'").drop("split"), chosen, seed)
    bins = rows.where("split = 'validation'").drop("split").mapInArrow(_scores(chosen, [fitted[t] for t in chosen], seed), "trial_index int, bin int, pos double, neg double, p double, brier double, loss double")
    bins = materialize(bins.groupBy("trial_index", "bin").agg(*[F.sum(c).alias(c) for c in ("pos", "neg", "p", "brier", "loss")]), "bins")
    whole, down = Window.partitionBy("trial_index"), Window.partitionBy("trial_index").orderBy(F.desc("bin"))
    n = F.col("pos") + F.col("neg")
    steps = bins.select("trial_index", (F.col("bin") / BINS).alias("threshold"), F.sum("pos").over(down).alias("tp"), F.sum("neg").over(down).alias("fp"), F.sum("pos").over(whole).alias("P"), F.sum("neg").over(whole).alias("N"))
    steps = with_rates(steps.withColumn("tn", F.col("N") - F.col("fp")).withColumn("fn", F.col("P") - F.col("tp")))
    best = steps.groupBy("trial_index").agg(F.max_by(F.struct("threshold", "f1", "accuracy"), F.struct(F.round("f1", 9), -F.round(F.abs(F.col("threshold") - 0.5), 9), -F.col("threshold"))).alias("b")).select("trial_index", "b.*")
    tenth = bins.groupBy("trial_index", F.least(F.floor(F.col("bin") * 10 / BINS), F.lit(9)).alias("t")).agg(F.sum(n).alias("n"), F.sum("pos").alias("pos"), F.sum("p").alias("p"), F.sum("brier").alias("brier"), F.sum("loss").alias("loss"))
    totals = tenth.groupBy("trial_index").agg(ratio(F.sum("loss"), F.sum("n")).alias("validation_loss"), ratio(F.sum("brier"), F.sum("n")).alias("brier_score"), ratio(F.sum(F.abs(F.col("pos") - F.col("p"))), F.sum("n")).alias("ece"))
    spark = examples.sparkSession
    named = spark.createDataFrame([(i, "logistic", t.feature_map, t.components, t.gamma, t.l2, t.balance, t.share) for i, t in enumerate(chosen)], "trial_index int, backend string, feature_map string, components int, gamma double, l2 double, balance double, share double")
    out = named.join(F.broadcast(best), "trial_index").join(F.broadcast(totals), "trial_index")  # a row for each trial
    order = Window.orderBy(F.desc(F.round("f1", 9)), F.desc(F.round("accuracy", 9)), F.round("validation_loss", 9), "trial_index")
    return out.withColumn("rank", F.row_number().over(order))
