"""Toxicity scores from a linear classifier over character n-grams scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugework.llm.scratch import materialize
from gaugework.llm.textblocks import blocks, mixed, utf8_rows

#: Lengths in code points of the n-grams, classes of their hash, and features that the classifier keeps at most.
SIZES, BUCKETS, FEATURES = (3, 4, 5), 1 << 19, 4096
#: Standard errors that a feature is at least away from one that tells nothing of the label: the root of twice the log
#: likelihood ratio, which also holds where one label has no such text.
SURE = 4.0
#: Labelled rows that the classifier is fitted on at most: those with the smallest hash of their id.
TRAINING_ROWS = 12_000
#: Bytes of text that one step works on, with some 150 bytes of arrays for each.
STEP = 1 << 18
#: Weight of the squared norm in the classifier's objective (the mean loss has the weight 1).
L2 = 3e-4


def held_out(doc_id: Column) -> Column:
    """Whether a document's label must not be learned from: crc32 of the id's text leaves no remainder by 5."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "utf-8")) % 5 == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """``doc_id``, ``text`` and ``label`` of at most ``most`` labelled rows that are not held out. The sample is by the
    hash of the id, so it is the same on every run; its ids, of that many rows at most, are broadcast to the texts."""
    usable = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", F.col(label).alias("label"))
    usable = usable.groupBy("doc_id").agg(F.max("label").alias("label"))
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")


@lru_cache(maxsize=1)
def _folded() -> np.ndarray:
    """For each code point below U+20000 its lower case, where that is one code point; all white space is a blank."""
    out = np.arange(1 << 17, dtype=np.uint32)
    for i in range(1 << 17):
        c = chr(i)
        if c.isspace():
            out[i] = 32
        elif len(low := c.lower()) == 1:
            out[i] = ord(low)
    return out


def code_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows' code points, folded as ``_folded`` says, and the rows' offsets among them."""
    lead = (data & 0xC0) != 0x80
    place = np.concatenate([[0], np.cumsum(lead)])
    wide = np.concatenate([data, np.zeros(3, np.uint8)]).astype(np.uint32)
    at = np.flatnonzero(lead)
    code = wide[at]
    for low, mask, more in ((0xC0, 0x1F, 1), (0xE0, 0x0F, 2), (0xF0, 0x07, 3)):
        own = np.flatnonzero(data[at] >= low)
        if len(own):
            value = wide[at[own]] & mask
            for i in range(more):
                value = value << 6 | wide[at[own] + 1 + i] & 0x3F
            code[own] = value
    table = _folded()
    small = code < len(table)
    return np.where(small, table[np.where(small, code, 0)], code), place[offsets]


def gram_rows(data: np.ndarray, offsets: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of the distinct n-grams of each row: lower-cased code points, white space as one kind of them, none
    inside a gram but at its ends. With ``weight``, only buckets of a weight other than 0."""
    text, cut = code_points(data, offsets)
    # A blank on both sides of each text, so that its first and last words have ends.
    rows = len(offsets) - 1
    at = np.arange(len(text)) + 2 * np.repeat(np.arange(rows), np.diff(cut)) + 1
    padded = np.full(len(text) + 2 * rows, 32, dtype=np.uint64)
    padded[at] = text
    start = cut[:-1] + 2 * np.arange(rows)
    blank = padded == 32
    pairs = []
    for n in SIZES:
        m = len(padded) - n + 1
        if m <= 0:
            continue
        h = np.full(m, n, dtype=np.uint64)
        inner = np.zeros(m, dtype=bool)
        for i in range(n):
            h = h * np.uint64(0xFF51AFD7ED558CCD) + padded[i : i + m]
            if 0 < i < n - 1:
                inner |= blank[i : i + m]
        bucket = (mixed(h) & np.uint64(BUCKETS - 1)).astype(np.int64)
        use = ~inner if weight is None else ~inner & (weight[bucket] != 0)
        pos = np.flatnonzero(use)
        row = np.searchsorted(start, pos, side="right") - 1
        pairs.append(row * BUCKETS + bucket[pos])
    both = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.int64)
    return both // BUCKETS, both % BUCKETS


@dataclass
class Model:
    """Score = 1 / (1 + exp(-(bias + sum of the weights of a text's distinct buckets)))."""

    weight: np.ndarray
    bias: float

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        row, bucket = gram_rows(data, offsets, self.weight)
        z = self.bias + np.bincount(row, self.weight[bucket], minlength=len(offsets) - 1)
        return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


def minimise(f: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, steps: int = 300, close: float = 1e-5, memory: int = 10) -> tuple[np.ndarray, list[float]]:
    """L-BFGS: the point where the smooth convex ``f`` (value, gradient) has no slope above ``close``, and the values on
    the way there. A step is halved until it lowers the value enough, so the values fall."""
    value, g = f(x)
    values, pairs = [value], []
    for _ in range(steps):
        if np.abs(g).max(initial=0.0) <= close:
            break
        d, kept = -g, []
        for s, y in reversed(pairs):
            a = (s @ d) / (s @ y)
            d = d - a * y
            kept.append(a)
        if pairs:
            s, y = pairs[-1]
            d = d * ((s @ y) / (y @ y))
        for (s, y), a in zip(pairs, reversed(kept), strict=True):
            d = d + s * (a - (y @ d) / (s @ y))
        slope, step = g @ d, 1.0 if pairs else 1.0 / max(1.0, float(np.sqrt(g @ g)))
        while True:
            new, new_g = f(x + step * d)
            if new <= value + 1e-4 * step * slope or step < 1e-12:
                break
            step /= 2
        if new >= value:
            break
        s, y = step * d, new_g - g
        x, value, g = x + s, new, new_g
        values.append(value)
        if s @ y > 1e-12 * (y @ y):
            pairs = [*pairs[1 - memory :], (s, y)]
    return x, values


def fit_logistic(row: np.ndarray, col: np.ndarray, value: np.ndarray, y: np.ndarray, features: int, l2: float = L2) -> tuple[np.ndarray, float, list[float]]:
    """Weights and bias where mean log loss + l2 / 2 * |weights| ** 2 is least, over sparse (row, col, value); and the
    objective on the way there. The objective does not depend on the number of rows."""
    n = len(y)

    def f(x: np.ndarray) -> tuple[float, np.ndarray]:
        z = np.bincount(row, x[col] * value, minlength=n) + x[-1]
        p = 1.0 / (1.0 + np.exp(-np.clip(z, -500, 500)))
        g = (p - y) / n
        loss = np.mean(np.logaddexp(0.0, z) - y * z) + l2 / 2 * (x[:-1] @ x[:-1])
        return float(loss), np.append(np.bincount(col, g[row] * value, minlength=features) + l2 * x[:-1], g.sum())

    x, values = minimise(f, np.append(np.zeros(features), np.log((y.sum() + 1) / (n - y.sum() + 1))))
    return x[:-1], float(x[-1]), values


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = TRAINING_ROWS) -> Model:
    """Fit on at most ``most`` labelled rows, none of them held out.

    Spark counts in how many texts of either label each bucket occurs. Of buckets in 3 texts or more that are SURE
    standard errors away from telling nothing, the FEATURES surest are kept, scaled by their log-count ratio. The driver sees those,
    and for each training row its kept features: both bounded by the parameters. Without rows of both labels, the score
    is the share of label 1 (0.5 without any). Labels other than 0 and 1 and null ids are not learned from; of several
    labels of one id the larger counts; repeated rows of ``docs`` are learned from each.
    """
    rows = materialize(training_rows(docs, labels, label, most), "training")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, BUCKETS), dtype=np.int64)
        for batch in batches:
            data, offsets = utf8_rows(batch.column("text"))
            y = batch.column("label").to_numpy()
            for a, b in blocks(offsets, STEP):
                row, bucket = gram_rows(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                for k in (0, 1):
                    total[k] += np.bincount(bucket[y[a:b][row] == k], minlength=BUCKETS)
        at = np.flatnonzero(total.sum(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[0, at]), pa.array(total[1, at])], ["bucket", "n0", "n1"])

    sizes = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n0, n1 = sizes.get(0, 0), sizes.get(1, 0)
    if not n0 or not n1:
        share = 0.5 if not n0 + n1 else (n1 + 0.5) / (n0 + n1 + 1)
        return Model(np.zeros(BUCKETS), float(np.log(share / (1 - share))))
    counts = rows.select("text", "label").mapInArrow(count, "bucket long, n0 long, n1 long").groupBy("bucket").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    ratio = F.log((F.col("n1") + 1) / (n1 + 2)) - F.log((F.col("n0") + 1) / (n0 + 2))
    held = F.col("n0") + F.col("n1")
    cells = [(F.col("n0"), held * n0), (F.col("n1"), held * n1), (n0 - F.col("n0"), (n0 + n1 - held) * n0), (n1 - F.col("n1"), (n0 + n1 - held) * n1)]
    likelihood = sum((F.when(n > 0, n * F.log(n * (n0 + n1) / even)).otherwise(0.0) for n, even in cells), F.lit(0.0))
    sure = F.round(F.sqrt(F.greatest(2 * likelihood, F.lit(0.0))), 9)
    kept = counts.where("n0 + n1 >= 3").withColumn("ratio", ratio).where(sure >= SURE).orderBy(sure.desc(), "bucket").limit(FEATURES).toPandas()
    scale = np.zeros(BUCKETS)
    scale[kept["bucket"].to_numpy(np.int64)] = kept["ratio"].to_numpy()

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8_rows(batch.column("text"))
            for a, b in blocks(offsets, STEP):
                row, bucket = gram_rows(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], scale)
                cut = np.searchsorted(row, np.arange(b - a + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), batch.column("label").slice(a, b - a).cast(pa.int32()), pa.ListArray.from_arrays(pa.array(cut), pa.array(bucket.astype(np.int32)))], ["doc_id", "label", "buckets"])

    seen = rows.select("doc_id", "text", F.col("label").cast("int").alias("label")).mapInArrow(features, "doc_id long, label int, buckets array<int>").toPandas().sort_values("doc_id")
    sizes_of = seen["buckets"].map(len).to_numpy()
    bucket = np.concatenate([*seen["buckets"].map(np.asarray), np.zeros(0, np.int64)]).astype(np.int64)
    row = np.repeat(np.arange(len(seen)), sizes_of)
    column = np.full(BUCKETS, -1)
    names = np.flatnonzero(scale)
    column[names] = np.arange(len(names))
    w, b, _ = fit_logistic(row, column[bucket], scale[bucket], seen["label"].to_numpy(float), len(names))
    weight = np.zeros(BUCKETS)
    weight[names] = w * scale[names]
    return Model(weight, float(b))


def score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """``docs`` with ``score``, the chance of label 1, of whole texts; all other columns stay, one called ``score`` is
    replaced. A null or empty text is scored by its lack of n-grams, a text of any length as a whole; equal texts have
    equal scores; repeated rows are scored each; an empty table gives an empty result."""
    keep = [f for f in docs.schema.fields if f.name != name]
    sent = docs.sparkSession.sparkContext.broadcast((model.weight, model.bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*sent.value)
        for batch in batches:
            data, offsets = utf8_rows(batch.column("text"))
            parts = [own.score(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in blocks(offsets, STEP)]
            yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in keep], pa.array(np.concatenate([*parts, np.zeros(0)]))], [*[f.name for f in keep], name])

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in keep)
    return docs.select(*[f"`{f.name}`" for f in keep]).mapInArrow(run, f"{fields}`{name}` double")
