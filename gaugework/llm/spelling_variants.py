"""Spelling variants: words one edit apart, found by blocked Gram matrices of letter counts.

A word's letter counts are a vector. One inserted or deleted code point moves it by a squared distance of 1, one replaced
code point by 2, so words one edit apart are at most 2 apart. Words are put into blocks of one length and equal sums of
counts over a few groups of letters; an edit changes these sums in one or two groups by one, so a block has to meet only
itself and those neighbours. Where two blocks meet, a product of their count matrices gives all squared distances, pairs
of at most 2 are kept, and their code points are compared.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import re
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugework.llm.scratch import materialize

#: Letters of words are A-Z, a-z and U+00C0 to U+00FF; only A-Z are lower-cased.
_LETTERS = "A-Za-zÀ-ÿ"
_LOWER = {i: i + 32 for i in range(65, 91)}
_CODES = [*range(97, 123), *range(0xC0, 0x100)]
#: Distinct words that a task counts before it hands them on.
HELD = 1 << 17
#: Words of a block, about; a larger set of equal sums is dealt over several blocks by the words' hash.
BLOCK = 2048
#: Entries of one Gram matrix.
GRAM = 1 << 22
GROUPS = 6

Change = Callable[[int, str], str]


def lowered(run: str) -> str:
    return run.lower() if run.isascii() else run.translate(_LOWER)


def drop_some(start: int, run: str) -> str:
    """``run`` without one code point where crc32 of ``<doc_id>:<run>`` is a multiple of 31; ``start`` is crc32 of ``<doc_id>:``."""
    h = zlib.crc32(run.encode(), start)
    if h % 31:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def count_words(docs: DataFrame, least: int = 7, twice: int = 2, change: Change | None = None) -> DataFrame:
    """``word`` and ``n``: the lower-cased runs of letters in the whole texts of ``docs``, of ``least`` code points or more,
    that occur ``twice`` or more in all.

    A null or empty text has none; repeated rows count each; an empty table gives an empty result; other columns play no
    part. A text's words are counted in its task first, ``HELD`` distinct ones at a time. ``change`` (not to lengthen a
    word) is applied to each run, with crc32 of ``<doc_id>:`` as its first argument.
    """
    # A change only shortens, so shorter runs need not be looked at.
    runs = re.compile(f"[{_LETTERS}]{{{least},}}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(count), pa.string()), pa.array(list(count.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for key, text in zip(batch.column(0), batch.column(1), strict=True):
                text = text.as_py()
                if not text:
                    continue
                found = map(lowered, runs.findall(text))
                if change is None:
                    count.update(found)
                else:
                    start = zlib.crc32(b"%s:" % str(key.as_py()).encode())
                    count.update([change(start, w) for w in found])
                if len(count) >= HELD:
                    yield out()
                    count.clear()
        if count:
            yield out()

    words = docs.select("doc_id", "text").mapInArrow(run, "word string, n long")
    return words.where(F.char_length("word") >= least).groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= twice)


def letter_groups(words: DataFrame, groups: int = GROUPS) -> list[str]:
    """The letters in ``groups`` groups of about the same number of occurrences in ``words``: the most frequent letter first,
    each to the group with the fewest occurrences so far. The counts are one row, whatever the table."""
    sums = words.agg(*[F.sum(F.char_length("word") - F.char_length(F.replace("word", F.lit(chr(c))))).alias(str(c)) for c in _CODES]).first()
    load, out = [0] * groups, [""] * groups
    for c in sorted(_CODES, key=lambda c: (-(sums[str(c)] or 0), c)):
        g = min(range(groups), key=lambda g: (load[g], len(out[g])))
        out[g] += chr(c)
        load[g] += sums[str(c)] or 0
    return out


def _cell(counts: Column) -> Column:
    return F.concat_ws(",", F.transform(counts, lambda x: x.cast("string")))


def _edges(cells: DataFrame, groups: int) -> DataFrame:
    """(cell, home, chunks): each pair of different cells whose words can be one edit apart, once; ``home`` is the cell that
    the other's words are sent to."""


    def moved(less: int, more: int) -> Column:
        to = F.array(*[F.col("counts")[g] - int(g == less) + int(g == more) for g in range(groups)])
        return F.when(F.col("counts")[less] > 0, to)

    shorter = [moved(g, groups) for g in range(groups)]
    # Of two cells of one length, the words of the one with more in the earlier group go to the other.
    level = [moved(g, h) for g in range(groups) for h in range(g + 1, groups)]
    near = cells.select("cell", F.explode(F.filter(F.array(*shorter, *level), lambda c: c.isNotNull())).alias("to")).select("cell", _cell(F.col("to")).alias("home"))
    return near.join(cells.select(F.col("cell").alias("home"), "chunks").hint("shuffle_hash"), "home")


_PART = "word string, n_near long, best_n long, best string"


class _Block:
    """Words of one length, by falling n and then code points, with their letter counts."""

    def __init__(self, words: list[str], n: list[int]):
        self.words, self.n = words, n
        self.code = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32).reshape(len(words), -1)
        letter = np.where(self.code < 0xC0, self.code - 97, self.code - 0xC0 + 26).astype(np.int64)
        flat = (np.arange(len(words))[:, None] * len(_CODES) + letter).ravel()
        # Counts and their products are exact: float32 holds whole numbers up to 2 ** 24.
        kind = np.float32 if self.code.shape[1] < 2000 else np.float64
        self.count = np.bincount(flat, minlength=len(words) * len(_CODES)).reshape(len(words), -1).astype(kind)
        self.square = (self.count * self.count).sum(axis=1)


def near_pairs(a: _Block, b: _Block) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the pairs of words one edit apart; ``b``'s words are as long as ``a``'s, or one longer."""
    left, right = [], []
    same, step = a is b, max(1, GRAM // len(a.words))
    for lo in range(0, len(b.words), step):
        part = slice(lo, lo + step)
        apart = a.count @ b.count[part].T
        apart *= -2
        apart += a.square[:, None]
        apart += b.square[None, part]
        i, j = np.nonzero(apart <= 2)
        j += lo
        if same:
            i, j = i[i < j], j[i < j]
        for at in range(0, len(i), 1 << 18):
            p, q = i[at : at + (1 << 18)], j[at : at + (1 << 18)]
            ok = _one_edit(a.code[p], b.code[q])
            left.append(p[ok])
            right.append(q[ok])
    none = np.zeros(0, np.int64)
    return (np.concatenate(left) if left else none), (np.concatenate(right) if right else none)


def _one_edit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    n = x.shape[1]
    if y.shape[1] == n:
        return (x != y).sum(axis=1) == 1
    # The letters before the first difference, and those after the last one, make up the shorter word.
    ahead = np.logical_and.accumulate(x == y[:, :n], axis=1).sum(axis=1)
    behind = np.logical_and.accumulate((x == y[:, 1:])[:, ::-1], axis=1).sum(axis=1)
    return ahead + behind >= n


def _partial(a: _Block, b: _Block, i: np.ndarray, j: np.ndarray) -> Iterator[tuple]:
    """A row for each word of ``a`` with a near one in ``b``: how many, and the first of them in ``b``'s order."""
    count = np.bincount(i, minlength=len(a.words))
    first = np.full(len(a.words), len(b.words))
    np.minimum.at(first, i, j)
    for k in np.flatnonzero(count):
        best = int(first[k])
        yield (a.words[k], int(count[k]), b.n[best], b.words[best])


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (home, chunk, guest, words, n): first a home block, then the blocks that are to meet it."""
    rows: list[tuple] = []
    place, home = None, None

    def out() -> pa.RecordBatch:
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["word", "n_near", "best_n", "best"])

    for batch in batches:
        for r in range(batch.num_rows):
            at = (batch.column(0)[r].as_py(), batch.column(1)[r].as_py())
            block = _Block(batch.column(3)[r].as_py(), batch.column(4)[r].as_py())
            if not batch.column(2)[r].as_py():
                place, home, other = at, block, block
            elif at == place:
                other = block
            else:
                continue
            i, j = near_pairs(home, other)
            rows.extend(_partial(home, other, i, j))
            rows.extend(_partial(other, home, j, i))
            if len(rows) >= 20_000:
                yield out()
                rows.clear()
    if rows:
        yield out()


def near_words(words: DataFrame, groups: int = GROUPS, block: int = BLOCK) -> DataFrame:
    """For each row of ``words`` (distinct ``word`` of letters, ``n``) that has words one edit from it: their number
    ``n_near``, and the one with the largest n, ``best`` and ``best_n`` (ties: smallest by code points)."""
    parts = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sums = [F.char_length("word") - F.char_length(F.translate("word", letters, "")) for letters in letter_groups(words, groups)]
    placed = words.select("word", "n", F.array(*[s.cast("int") for s in sums]).alias("counts")).withColumn("cell", _cell(F.col("counts")))
    cells = materialize(placed.groupBy("cell").agg(F.first("counts").alias("counts"), F.ceil(F.count("*") / block).cast("int").alias("chunks")), "cells")
    chunk = F.pmod(F.xxhash64("word"), F.col("chunks")).cast("int")
    members = F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("m"), "word")))
    blocks = placed.join(cells.select("cell", "chunks").hint("shuffle_hash"), "cell").groupBy("cell", "chunks", chunk.alias("chunk")).agg(members.alias("members"))
    blocks = blocks.select("cell", "chunks", "chunk", F.transform("members", lambda m: m["word"]).alias("words"), F.transform("members", lambda m: -m["m"]).alias("n"))
    blocks = materialize(blocks, "blocks")
    edges = materialize(_edges(cells, groups), "edges")
    at = lambda c: F.posexplode(F.sequence(F.lit(0), c - 1)).alias("_", "to")
    guests = edges.join(blocks.drop("chunks").hint("shuffle_hash"), "cell").select(F.col("home"), at(F.col("chunks")), F.lit(1).alias("guest"), "words", "n")
    # Blocks of one cell meet too: a later chunk is a guest of the earlier ones.
    own = blocks.where("chunk > 0").select(F.col("cell").alias("home"), at(F.col("chunk")), F.lit(1).alias("guest"), "words", "n")
    home = blocks.select(F.col("cell").alias("home"), F.lit(0).alias("_"), F.col("chunk").alias("to"), F.lit(0).alias("guest"), "words", "n")
    met = home.unionByName(guests).unionByName(own).select("home", "to", "guest", "words", "n")
    found = met.repartition(parts, "home", "to").sortWithinPartitions("home", "to", "guest").mapInArrow(_meet, _PART)
    best = F.min(F.struct((-F.col("best_n")).alias("m"), F.col("best").alias("word"))).alias("b")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", F.col("b.word").alias("best"), (-F.col("b.m")).alias("best_n"))


def group_variants(words: DataFrame, times: int = 10) -> DataFrame:
    """``word``, ``n``, ``n_near``, ``form``, ``form_n`` and ``root`` for each row of ``words`` (``word``, ``n``).

    ``form`` is the word one edit away with the largest n (ties: smallest by code points) if that n is at least ``times``
    the word's own, else null; ``root`` is where forms lead to from the word, itself if it has none. Words must be distinct
    and of letters; an empty table gives an empty result; other columns are dropped. ``times`` must be above 1, so that n
    grows from form to form and no chain is longer than its logarithm.
    """
    words = materialize(words.select("word", "n"), "words")
    near = near_words(words)
    good = F.col("best_n") >= times * F.col("n")
    joined = words.join(near.hint("shuffle_hash"), "word", "left")
    joined = materialize(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(good, F.col("best")).alias("form"), F.when(good, F.col("best_n")).alias("form_n")), "near")
    # Each round, a word's root becomes its root's root; the number of rounds is the logarithm of the longest chain.
    roots = joined.where("form is not null").select("word", F.col("form").alias("root"))
    while True:
        on = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        roots = materialize(roots.join(on.hint("merge"), "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if roots.where("moved").isEmpty():
            break
        roots = roots.drop("moved")
    out = joined.join(roots.select("word", "root").hint("shuffle_hash"), "word", "left")
    return out.select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
