"""Quality rules whose thresholds follow each language and source, read off mergeable quantile sketches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugework.llm.scratch import materialize
from gaugework.llm.textblocks import Words, blocks, prefix_hash, range_hash, utf8_rows

#: Document metrics that get adaptive thresholds, as whole numbers: shares in thousandths, lengths in tenths.
METRICS = ("symbol_share", "dup_line_share", "repeat_share", "word_length")
STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long"
_SYMBOL = np.zeros(256, dtype=np.int64)
_SYMBOL[list(b"#*$%&|<>")] = 1


def _per_row(at: np.ndarray, weights: np.ndarray | None, rows: int) -> np.ndarray:
    return np.bincount(at, weights, minlength=rows).astype(np.int64)


def _covered(at: np.ndarray, k: int, n: int) -> np.ndarray:
    """Which of n positions lie in a run of k that starts at one of ``at``."""
    edge = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, np.minimum(at + k, n), -1)
    return np.cumsum(edge[:n]) > 0


def _again(row: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of (row, value) pairs in order: whether a pair comes twice or more, and whether it came before."""
    order = np.lexsort((value, row))
    same = np.zeros(len(order) + 1, dtype=bool)
    if len(order):
        r, v = row[order], value[order]
        same[1:-1] = (r[1:] == r[:-1]) & (v[1:] == v[:-1])
    twice, before = np.empty(len(order), bool), np.empty(len(order), bool)
    twice[order] = same[:-1] | same[1:]
    before[order] = same[:-1]  # lexsort is stable: the first of equals stays first
    return twice, before


def block_stats(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The counts of ``STATS`` for the rows of a block of UTF-8 texts."""
    rows = len(offsets) - 1
    words = Words(data, offsets)
    row_of = np.repeat(np.arange(rows), np.diff(offsets))
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    at, gram = words.shingles(3)
    twice, _ = _again(words.row[at], gram)
    repeated = _covered(at[twice], 3, len(words.hash))

    # Lines: cut at \n and at the ends of rows; one counts if a word starts in it.
    first = np.zeros(len(data) + 1, dtype=bool)
    first[offsets] = True
    first[1:] |= data == 0x0A
    line_start = np.flatnonzero(first[: len(data)])
    line_end = np.append(line_start[1:], len(data))
    line_end = line_end - ((line_end > line_start) & (data[line_end - 1] == 0x0A)) if len(line_start) else line_end
    line_row = row_of[line_start] if len(line_start) else line_start
    has_word = np.searchsorted(words.start, line_end) > np.searchsorted(words.start, line_start)
    s, e, r = line_start[has_word], line_end[has_word], line_row[has_word]

    _, before = _again(r, range_hash(prefix_hash(data), s, e))
    return {
        "n_words": np.diff(words.bounds),
        "word_chars": _per_row(words.row, points[words.end] - points[words.start], rows),
        "n_symbols": _per_row(row_of, _SYMBOL[data], rows),
        "n_dup_lines": _per_row(r[before], None, rows),
        "n_repeat_words": _per_row(words.row[repeated], None, rows),
        "n_lines": _per_row(r, None, rows),
    }


def text_stats(docs: DataFrame) -> DataFrame:
    """Every column of ``docs`` but ``text``, and the counts of ``STATS``, of whole texts; columns of these names are replaced."""
    keep = [f for f in docs.schema.fields if f.name not in ("text", *[c.split(" ")[0] for c in STATS.split(", ")])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8_rows(batch.column("text"))
            for lo, hi in blocks(offsets):
                own = block_stats(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*[part.column(f.name) for f in keep], *[pa.array(v, pa.int64()) for v in own.values()]], [*[f.name for f in keep], *own])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keep)
    return docs.select(*[f"`{f.name}`" for f in keep], "text").mapInArrow(run, f"{fields}, {STATS}")


def with_metrics(stats: DataFrame) -> DataFrame:
    per = lambda part, whole, scale: F.when(F.col(whole) > 0, F.floor(F.col(part) * scale / F.col(whole))).otherwise(0).cast("long")
    return (
        stats.withColumn("symbol_share", per("n_symbols", "n_words", 1000))
        .withColumn("dup_line_share", per("n_dup_lines", "n_lines", 1000))
        .withColumn("repeat_share", per("n_repeat_words", "n_words", 1000))
        .withColumn("word_length", per("word_chars", "n_words", 10))
    )


def sketch(metrics: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """A quantile sketch for each group and metric, as rows (group, metric, bin, n): counts of whole numbers without an
    upper end.

    Two sketches merge by adding counts, in any order, which is what the aggregation does (partly in each task, so
    a group with a third of all rows costs no more than others). A quantile read off it is exact.
    """
    names = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("bin")) for m in METRICS])
    return metrics.select(*by, F.explode(names).alias("m")).groupBy(*by, "m.metric", "m.bin").agg(F.count("*").alias("n"))


def quantiles(sketches: DataFrame, by: tuple[str, ...], at: dict[str, float]) -> DataFrame:
    """One row for each group and metric: the smallest bin that reaches each share of the group's rows."""
    pairs = sketches.groupBy(*by, "metric").agg(F.array_sort(F.collect_list(F.struct("bin", "n"))).alias("bins"), F.sum("n").alias("total"))

    def read(share: float) -> Column:
        """Walks the bins, one for each distinct value: state is (rows so far, bin where the share was reached)."""
        start = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("long").alias("bin"))
        step = lambda s, b: F.struct((s["seen"] + b["n"]).alias("seen"), F.coalesce(s["bin"], F.when(s["seen"] + b["n"] >= F.col("total") * share, b["bin"])).alias("bin"))
        return F.aggregate("bins", start, step, lambda s: s["bin"])

    return pairs.select(*by, "metric", "total", *[read(q).alias(name) for name, q in at.items()])


def thresholds(metrics: DataFrame, by: tuple[str, ...] = ("lang", "source"), spread: int = 6, least_width: int = 30) -> DataFrame:
    """Upper and lower limits of each group and metric: the quartiles, ``spread`` times their distance away."""
    q = quantiles(sketch(metrics, by), by, {"q1": 0.25, "q2": 0.5, "q3": 0.75})
    width = F.greatest(F.col("q3") - F.col("q1"), F.lit(least_width))
    limits = q.withColumn("low", F.col("q1") - spread * width).withColumn("high", F.col("q3") + spread * width)
    one = lambda m, c: F.max(F.when(F.col("metric") == m, F.col(c))).alias(f"{m}_{c}")
    return limits.groupBy(*by).agg(*[one(m, c) for m in METRICS for c in ("low", "high")])


def judge(docs: DataFrame, by: tuple[str, ...] = ("lang", "source"), spread: int = 6, least_width: int = 30, salts: int = 64) -> DataFrame:
    """Every column of ``docs`` but ``text``, the counts, ``base_failed`` and ``kept``.

    ``base_failed``: under 50 words, or more than half of the words in repeated 3-word windows. ``kept``: not failed,
    and no metric outside the limits of its language and source. Limits are joined by salted keys, so a group with
    a third of all rows spreads over ``salts`` tasks. Nulls: a null text has no words and fails; a null language or
    source is a group of its own. Equal values are on the same side of a limit. A text of any length is counted whole.
    Repeated rows are judged each. An empty table gives an empty result. Columns named as the counts, the metrics or
    what comes of them are replaced; names that begin with two underscores are the operator's own.
    """
    made = ("base_failed", "kept", *METRICS, *[f"{m}_{c}" for m in METRICS for c in ("low", "high")])
    docs = docs.drop(*[c for c in docs.columns if c in made or c.startswith("__")])
    seen = materialize(with_metrics(text_stats(docs)), "stats")
    limits = thresholds(seen, by, spread, least_width).withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    left = seen.withColumn("__salt", F.pmod(F.xxhash64(*[c for c in ("doc_id",) if c in seen.columns], "n_words", "word_chars"), F.lit(salts)).cast("int"))
    renamed = limits.select(*[F.col(c).alias(f"__{c}") for c in by], F.col("__salt").alias("__s"), *[f"{m}_{c}" for m in METRICS for c in ("low", "high")])
    on = left["__salt"] == renamed["__s"]
    for c in by:
        on = on & left[c].eqNullSafe(renamed[f"__{c}"])
    joined = left.join(renamed.hint("shuffle_hash"), on, "left")
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    outside = F.lit(False)
    for m in METRICS:
        outside = outside | (F.col(m) > F.col(f"{m}_high")) | (F.col(m) < F.col(f"{m}_low"))
    out = joined.withColumn("base_failed", base).withColumn("kept", ~base & ~F.coalesce(outside, F.lit(False)))
    return out.drop("__salt", "__s", *[f"__{c}" for c in by], *[f"{m}_{c}" for m in METRICS for c in ("low", "high")])
