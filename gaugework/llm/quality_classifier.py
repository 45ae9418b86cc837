"""Document quality from histogram gradient-boosted trees over text statistics."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gaugework.llm.quality_rules import _again, _per_row, block_stats
from gaugework.llm.textblocks import Words, blocks, utf8_rows
from gaugework.llm.toxicity import training_rows

#: Labelled rows that the trees are fitted on at most: those with the smallest hash of their id.
TRAINING_ROWS = 20_000
TREES, DEPTH, BINS, RATE = 60, 4, 64, 0.15
FEATURES = (
    "log_words", "word_length", "symbols_a_word", "dup_line_share", "repeat_share", "distinct_share", "upper_share", "digit_share",
    "mark_share", "stop_share", "comma_share", "bar_share", "line_words", "space_share", "wide_share", "longest_word", "one_letter_share",
)


def _class(chars: bytes) -> np.ndarray:
    out = np.zeros(256, dtype=np.float64)
    out[list(chars)] = 1
    return out


_CLASSES = {
    "upper_share": _class(bytes(range(65, 91))), "digit_share": _class(b"0123456789"), "mark_share": _class(b"!?"), "stop_share": _class(b"."),
    "comma_share": _class(b",;:"), "bar_share": _class(b"|"), "space_share": _class(b" \t\n\r\x0b\x0c"), "wide_share": _class(bytes(range(128, 256))),
}


def block_features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of FEATURES for each text of a block; an empty text has zeros."""
    rows = len(offsets) - 1
    stats = block_stats(data, offsets)
    words = Words(data, offsets, lower=True)
    _, before = _again(words.row, words.hash)
    n = np.maximum(stats["n_words"], 1)
    size = np.maximum(np.diff(offsets), 1)
    length = words.end - words.start
    longest = np.zeros(rows, dtype=np.int64)
    np.maximum.at(longest, words.row, length)
    row_of = np.repeat(np.arange(rows), np.diff(offsets))
    made = {
        "log_words": np.log1p(stats["n_words"]), "word_length": stats["word_chars"] / n, "symbols_a_word": stats["n_symbols"] / n,
        "dup_line_share": stats["n_dup_lines"] / np.maximum(stats["n_lines"], 1), "repeat_share": stats["n_repeat_words"] / n,
        "distinct_share": _per_row(words.row[~before], None, rows) / n, "line_words": stats["n_words"] / np.maximum(stats["n_lines"], 1),
        "longest_word": longest, "one_letter_share": _per_row(words.row[length == 1], None, rows) / n,
    }
    for name, kind in _CLASSES.items():
        made[name] = np.bincount(row_of, kind[data], minlength=rows) / size
    return np.column_stack([made[f] for f in FEATURES]).astype(np.float64)


@dataclass
class Trees:
    """All trees as arrays of one shape: node i of a tree has the children 2 i + 1 and 2 i + 2; leaves hold values.

    A row goes left where its feature is at most the node's cut. Nodes that were not split send every row left.
    """

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    bias: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Chance of label 1: all trees and rows go down one level at a time."""
        trees = np.arange(len(self.feature))
        node = np.zeros((len(x), len(trees)), dtype=np.int64)
        rows = np.arange(len(x))[:, None]
        for _ in range(DEPTH):
            right = x[rows, self.feature[trees, node]] > self.cut[trees, node]
            node = 2 * node + 1 + right
        z = self.bias + self.value[trees, node - (2**DEPTH - 1)].sum(axis=1)
        return 1.0 / (1.0 + np.exp(-z))


def grow(x: np.ndarray, y: np.ndarray, l2: float = 1.0, least: int = 10) -> Trees:
    """Boosts the logistic loss. Feature values are binned at quantiles once; a level of a tree takes one histogram of
    gradients by (node, feature, bin), whose running sums give the gain of every cut."""
    n, d = x.shape
    inner = 2**DEPTH - 1
    share = (y.sum() + 0.5) / (n + 1)
    bias = float(np.log(share / (1 - share)))
    out = Trees(np.zeros((TREES, inner), np.int64), np.full((TREES, inner), np.inf), np.zeros((TREES, inner + 1)), bias)
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for j in range(d)]
    binned = np.column_stack([np.searchsorted(e, x[:, j]) for j, e in enumerate(edges)])
    cell = binned + BINS * np.arange(d)
    z = np.full(n, bias)
    for t in range(TREES):
        p = 1.0 / (1.0 + np.exp(-z))
        g, h = p - y, p * (1 - p)
        node = np.zeros(n, dtype=np.int64)
        for level in range(DEPTH):
            width = 2**level
            at = (node[:, None] * (d * BINS) + cell).ravel()
            shape = (width, d, BINS)
            G, H, C = (np.bincount(at, np.repeat(v, d), minlength=width * d * BINS).reshape(shape).cumsum(axis=2) for v in (g, h, np.ones(n)))
            total = [v[:, :, -1:] for v in (G, H, C)]
            gain = G**2 / (H + l2) + (total[0] - G) ** 2 / (total[1] - H + l2) - total[0] ** 2 / (total[1] + l2)
            gain[(C < least) | (total[2] - C < least)] = 0
            best = gain.reshape(width, -1).argmax(axis=1)
            split = gain.reshape(width, -1)[np.arange(width), best] > 1e-6
            feature, bin_ = best // BINS, best % BINS
            right = split[node] & (binned[np.arange(n), feature[node]] > bin_[node])
            for k in np.flatnonzero(split):
                out.feature[t, width - 1 + k] = feature[k]
                out.cut[t, width - 1 + k] = edges[feature[k]][bin_[k]]
            node = 2 * node + right
        leaf = -RATE * np.bincount(node, g, minlength=inner + 1) / (np.bincount(node, h, minlength=inner + 1) + l2)
        out.value[t] = leaf
        z += leaf[node]
    return out


def _with_features(docs: DataFrame, keep: list, made: str, values) -> DataFrame:
    """Columns ``keep`` and what ``values`` makes of each block's features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8_rows(batch.column("text"))
            for a, b in blocks(offsets):
                x = block_features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                yield pa.RecordBatch.from_arrays([*[batch.column(f.name).slice(a, b - a) for f in keep], values(x)], [*[f.name for f in keep], made.split(" ")[0]])

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in keep)
    return docs.mapInArrow(run, fields + made)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = TRAINING_ROWS) -> Trees:
    """Grow the trees on the features of at most ``most`` labelled rows, none held out. Executors compute the features;
    the driver gets FEATURES numbers a row. Without rows of both labels the score is constant."""
    rows = training_rows(docs, labels, label, most)
    keep = [f for f in rows.schema.fields if f.name != "text"]
    seen = _with_features(rows, keep, "x array<double>", lambda x: pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))).toPandas()
    seen = seen.sort_values("doc_id", kind="stable")
    x = np.vstack([*seen["x"], np.zeros((0, len(FEATURES)))])
    y = seen["label"].to_numpy(float)
    if not len(y) or y.min() == y.max():
        share = 0.5 if not len(y) else (y.sum() + 0.5) / (len(y) + 1)
        inner = 2**DEPTH - 1
        return Trees(np.zeros((1, inner), np.int64), np.full((1, inner), np.inf), np.zeros((1, inner + 1)), float(np.log(share / (1 - share))))
    return grow(x, y)


def score(docs: DataFrame, trees: Trees, name: str = "score") -> DataFrame:
    """``docs`` without ``text``, with ``score``, the chance of label 1, of whole texts. A null or empty text has the
    score of all statistics 0; repeated rows are scored each; an empty table gives an empty result; a column called
    ``score`` is replaced."""
    keep = [f for f in docs.schema.fields if f.name not in ("text", name)]
    sent = docs.sparkSession.sparkContext.broadcast(trees)
    return _with_features(docs.select(*[f"`{f.name}`" for f in keep], "text"), keep, f"{name} double", lambda x: pa.array(sent.value.score(x)))
