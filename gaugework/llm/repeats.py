"""Windows that occur more than once in a corpus, found through content-chosen anchors.

A text is a sequence of symbols (bytes or words); a window is W symbols in a row. Each window has an anchor: among its
k-symbol grams the one with the smallest hash, the leftmost of equals. Equal windows have equal anchors at equal
places, so only windows whose anchor gram repeats can repeat, and consecutive windows mostly share an anchor: one row
(a segment) stands for all of them. Anchors only route text: the contexts of an anchor (distinct contents of its segments)
meet in one bucket, each once, with a second copy if it has any, and the caller's method judges every window there.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugework.llm.scratch import materialize
from gaugework.llm.textblocks import mixed, range_hash, signed

MARKS = [("anchor", pa.int64()), ("context", pa.int64()), ("at", pa.int32()), ("span", pa.int32())]
#: Text of a bucket, from the place where it comes first. ``twice``: it comes again. ``marks``: the contexts in it.
PIECE_FIELDS = [("route", pa.int64()), ("id", pa.int64()), ("tag", pa.int64()), ("lo", pa.int32()), ("twice", pa.bool_()), ("body", pa.binary()), ("marks", pa.list_(pa.struct(MARKS)))]
PIECE = "route long, id long, tag long, lo int, twice boolean, body binary, marks array<struct<anchor: bigint, context: bigint, at: int, span: int>>"
_RANGES = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))
#: A context, where it comes first, and its windows to remove there and where it comes again.
VERDICT_FIELDS = [("anchor", pa.int64()), ("context", pa.int64()), ("id", pa.int64()), ("tag", pa.int64()), ("lo", pa.int32()), ("part", _RANGES), ("rest", _RANGES)]
VERDICT = "anchor long, context long, id long, tag long, lo int, part array<struct<lo: int, hi: int>>, rest array<struct<lo: int, hi: int>>"
#: A window by its own hash, without its text: one row for each window of a crowded anchor's contexts.
WINDOW_FIELDS = [("window", pa.int64()), ("id", pa.int64()), ("tag", pa.int64()), ("lo", pa.int32()), ("twice", pa.bool_()), ("anchor", pa.int64()), ("context", pa.int64()), ("at", pa.int32())]
WINDOW = "window long, id long, tag long, lo int, twice boolean, anchor long, context long, at int"
SEGMENT = "id long, tag long, lo int, span int, anchor long, context long"
#: Contexts of one anchor that meet in one bucket; of an anchor with more, each window is routed by its own hash.
MOST_CONTEXTS = 4096
#: Symbols after which a run of contexts is cut; a cut between contexts changes no verdict.
RUN = 1 << 16
_LOW = np.uint64((1 << 21) - 1)
LAST_ID = (1 << 63) - 1


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w values in a row, by doubling."""
    span = 1
    n = len(x) - w + 1
    while 2 * span <= w:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[:n], x[w - span : w - span + n])


def segments(gram: np.ndarray, room: np.ndarray, w: int, k: int, prefix: np.ndarray) -> tuple[np.ndarray, ...]:
    """Segments of a piece of fewer than 2 ** 21 symbols: first window, windows less one, anchor, context.

    ``gram``: hash of the k symbols from each position on; ``room``: symbols from each position to the end of its text;
    ``prefix``: running sums for ``range_hash`` over the symbols.
    """
    if len(gram) < w - k + 1:
        return tuple(np.zeros(0, np.int64) for _ in range(2)) + (np.zeros(0, np.uint64),) * 2
    ranked = (gram & ~_LOW) | np.arange(len(gram), dtype=np.uint64)
    at = (sliding_min(ranked, w - k + 1) & _LOW).astype(np.int64)
    window = np.flatnonzero(room[: len(at)] >= w)
    at = at[window]
    new = np.ones(len(window), dtype=bool)
    new[1:] = (at[1:] != at[:-1]) | (window[1:] != window[:-1] + 1)
    first = np.flatnonzero(new)
    lo, anchor_at = window[first], at[first]
    span = np.diff(np.append(first, len(window))) - 1
    lead = anchor_at - lo
    anchor = gram[anchor_at]
    context = mixed(range_hash(prefix, lo, lo + span + w) ^ (lead.astype(np.uint64) << np.uint64(8)) ^ span.astype(np.uint64))
    return lo, span, anchor, context


def segment_batch(ids: np.ndarray, tags: np.ndarray, row: np.ndarray, lo: np.ndarray, span: np.ndarray, anchor: np.ndarray, context: np.ndarray) -> pa.RecordBatch:
    """SEGMENT rows; ``row`` is the row of the batch that each segment is of, ``lo`` counts from that row's start."""
    small = [pa.array(x.astype(np.int32)) for x in (lo, span)]
    return pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(tags[row]), *small, pa.array(signed(anchor)), pa.array(signed(context))], ["id", "tag", "lo", "span", "anchor", "context"])


def text_tag() -> Column:
    """64 bits of hash, as wide as those of windows and contexts."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with ``id`` (doc_id, nulls last of all) and ``tag`` (64-bit hash of the text), which tell rows apart: rows
    that agree in both are repeated rows and fare alike."""
    return docs.select(F.coalesce(F.col("doc_id"), F.lit(LAST_ID)).alias("id"), text_tag().alias("tag"), "doc_id", "text")


Symbols = Callable[[str], Sequence]
Join = Callable[[Sequence], bytes]
Split = Callable[[bytes], Sequence]


def _pieces(symbols: Symbols, join: Join, width: int):
    """Texts with ``wanted`` contexts as PIECE rows, and whether their anchor is crowded: a context that has its anchor for
    itself goes with its neighbours of that kind as one run, any other goes to the bucket of its anchor."""
    fields = [*PIECE_FIELDS, ("crowded", pa.bool_())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for key, tag, text, wanted in zip(*[batch.column(c) for c in ("id", "tag", "text", "wanted")], strict=True):
                text, key, tag = symbols(text.as_py() or ""), key.as_py(), tag.as_py()
                together: list[dict] = []
                for w in [*sorted(wanted.as_py(), key=lambda w: w["lo"]), None]:
                    if together and not (w and w["alone"] and w["lo"] == together[-1]["lo"] + together[-1]["span"] + 1 and w["lo"] - together[0]["lo"] < RUN):
                        lo, hi = together[0]["lo"], together[-1]["lo"] + together[-1]["span"]
                        marks = [{"anchor": x["anchor"], "context": x["context"], "at": x["lo"] - lo, "span": x["span"]} for x in together]
                        rows.append((together[0]["context"], key, tag, lo, True, join(text[lo : hi + width]), marks, False))
                        together = []
                    if w and w["alone"]:
                        together.append(w)
                    elif w:
                        marks = [{"anchor": w["anchor"], "context": w["context"], "at": 0, "span": w["span"]}]
                        rows.append((w["anchor"], key, tag, w["lo"], w["twice"], join(text[w["lo"] : w["lo"] + w["span"] + width]), marks, w["crowded"]))
                if len(rows) >= 2000:
                    yield emit(rows, fields)
                    rows = []
            if rows:
                yield emit(rows, fields)

    return run


def _windows(split: Split, join: Join, width: int):
    """PIECE rows of one context each as WINDOW rows, one for each window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for _, key, tag, lo, twice, body, marks in zip(*[batch.column(n).to_pylist() for n, _ in PIECE_FIELDS], strict=True):
                text, mark = split(body), marks[0]
                for o in range(mark["span"] + 1):
                    name = int.from_bytes(hashlib.blake2b(join(text[o : o + width]), digest_size=8).digest(), "big", signed=True)
                    rows.append((name, key, tag, lo + o, twice, mark["anchor"], mark["context"], o))
                if len(rows) >= 10_000:
                    yield emit(rows, WINDOW_FIELDS)
                    rows = []
            if rows:
                yield emit(rows, WINDOW_FIELDS)

    return run


def _cut(split: Split, join: Join, width: int):
    """PIECE rows of one context each, with the ``named`` windows in it, as PIECE rows of one window each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for key, tag, lo, body, named in zip(*[batch.column(n).to_pylist() for n in ("id", "tag", "lo", "body", "named")], strict=True):
                text = split(body)
                for w in named:
                    marks = [{"anchor": w["window"], "context": w["window"], "at": 0, "span": 0}]
                    rows.append((w["window"], key, tag, lo + w["at"], True, join(text[w["at"] : w["at"] + width]), marks))
                if len(rows) >= 2000:
                    yield emit(rows, PIECE_FIELDS)
                    rows = []
            if rows:
                yield emit(rows, PIECE_FIELDS)

    return run


def judged(row: tuple, part: list[tuple[int, int]], rest: list[tuple[int, int]]) -> Iterator[tuple]:
    """VERDICT rows of a PIECE row, given ranges of its windows to remove at its first place and at later ones."""
    _, key, tag, lo, _, _, marks = row
    for m in marks:
        a, b = m["at"], m["at"] + m["span"]
        own = [[{"lo": max(x, a) - a, "hi": min(y, b) - a} for x, y in ranges if x <= b and y >= a] for ranges in (part, rest)]
        if own[0] or own[1]:
            yield (m["anchor"], m["context"], key, tag, lo + a, *own)


def piece_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """The rows of sorted PIECE batches; of those that repeated rows of the table (one id, one text) made, the first."""
    place = None
    for batch in batches:
        for row in zip(*[batch.column(n).to_pylist() for n, _ in PIECE_FIELDS], strict=True):
            if row[:4] != place:
                yield row
            place = row[:4]


def repeated_ranges(docs: DataFrame, extract: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], resolve: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], symbols: Symbols, join: Join, split: Split, width: int, across: bool, write_segments: bool = False) -> DataFrame:
    """Window ranges to remove: rows (id, tag, ranges), ranges an array of (lo, hi), windows lo to hi inclusive.

    ``extract`` turns keyed texts into SEGMENT rows. ``symbols`` cuts a text, ``join`` makes bytes of a part of it and
    ``split`` cuts these again.
    ``resolve`` gets PIECE rows sorted by (route, id, lo, tag) and gives the VERDICT rows of the contexts in them; what it
    does not give is not removed. ``across``: repeats count between different ids only, and a later place is one with a
    larger id; else every other place is.

    With ``write_segments``, segments are written out and read twice; else they are made twice, which takes less disk.

    Contexts are told apart by anchor and context hash, 128 bits together. A bucket holds each of its contexts once, at most
    MOST_CONTEXTS of them. A crowded anchor's windows are counted by their own hash first, so that each is one row of a
    bucket of its own, however often it comes; only hashes go there, and the text of those that come again is cut from the
    pieces. So texts are sent to their contexts once, however many anchors are crowded.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = docs.select("id", "tag", "text").mapInArrow(extract, SEGMENT)
    if write_segments:
        found = materialize(found, "segments")
    several = F.min("id") != F.max("id") if across else F.count("*") > 1
    # Written out, so that the joins below are between plain shuffles: Spark can split a crowded key's rows.
    repeated = materialize(found.groupBy("anchor").agg(several.alias("several")).where("several").select("anchor"), "repeated")
    hits = materialize(found.join(repeated.hint("merge"), "anchor"), "hits")

    # One row for each distinct context of a repeated anchor: whether it comes again, and where it comes first.
    again = F.min("id") != F.max("id") if across else F.count("*") > 1
    groups = hits.groupBy("anchor", "context").agg(again.alias("twice"), F.min(F.struct("id", "tag", "lo", "span")).alias("first"))
    groups = materialize(groups, "groups")
    kinds = materialize(groups.groupBy("anchor").agg(F.count("*").alias("kinds")), "kinds")
    want = F.struct(F.col("first.lo").alias("lo"), F.col("first.span").alias("span"), "anchor", "context", "twice", (F.col("kinds") == 1).alias("alone"), (F.col("kinds") > MOST_CONTEXTS).alias("crowded"))
    placed = groups.join(kinds.hint("merge"), "anchor").where("twice or kinds > 1")

    wanted = placed.groupBy("first.id", "first.tag").agg(F.collect_list(want).alias("wanted"))
    texts = docs.join(wanted.hint("shuffle_hash"), ["id", "tag"]).select("id", "tag", "text", "wanted")
    pieces = materialize(texts.mapInArrow(_pieces(symbols, join, width), f"{PIECE}, crowded boolean"), "pieces")

    def resolved(pieces: DataFrame) -> DataFrame:
        return pieces.repartition(n, "route").sortWithinPartitions("route", "id", "lo", "tag").mapInArrow(resolve, VERDICT)

    verdicts = resolved(pieces.where("not crowded").drop("crowded"))
    if not kinds.where(F.col("kinds") > MOST_CONTEXTS).isEmpty():
        crowded = pieces.where("crowded").drop("crowded")
        windows = materialize(crowded.mapInArrow(_windows(split, join, width), WINDOW), "windows")
        many = F.min("id") != F.max("id") if across else F.count("*") > 1
        once = windows.groupBy("window").agg((many | F.max("twice")).alias("twice"), F.min(F.struct("id", "tag", "lo", "anchor", "context", "at")).alias("f")).where("twice")
        named = once.groupBy("f.anchor", "f.context").agg(F.collect_list(F.struct("window", F.col("f.at").alias("at"))).alias("named"))
        held = crowded.withColumns({c: F.col("marks")[0][c] for c in ("anchor", "context")}).join(named.hint("merge"), ["anchor", "context"])
        known = resolved(held.select("id", "tag", "lo", "body", "named").mapInArrow(_cut(split, join, width), PIECE))
        known = materialize(known.select(F.col("anchor").alias("window"), F.struct("id", "tag", "lo").alias("f"), (F.size("part") > 0).alias("part"), (F.size("rest") > 0).alias("rest")), "known")
        seen = windows.join(known.hint("merge"), "window")
        here = F.when(_later(across), F.col("rest")).otherwise(F.col("part"))
        ranges = lambda c: F.collect_list(F.when(c, F.struct(F.col("at").alias("lo"), F.col("at").alias("hi"))))
        verdicts = verdicts.union(seen.groupBy("anchor", "context", "id", "tag", (F.col("lo") - F.col("at")).alias("lo")).agg(ranges(here).alias("part"), ranges(F.col("rest") & F.col("twice")).alias("rest")))
    verdicts = materialize(verdicts.select("anchor", "context", F.struct("id", "tag", "lo").alias("f"), "part", "rest"), "verdicts")

    at = hits.join(verdicts.hint("merge"), ["anchor", "context"])
    own = F.transform(F.when(_later(across), F.col("rest")).otherwise(F.col("part")), lambda p: F.struct((p["lo"] + F.col("lo")).alias("lo"), (p["hi"] + F.col("lo")).alias("hi")))
    # Written out, so that what the joins above have shuffled is gone when the texts are shuffled to their ranges.
    return materialize(at.select("id", "tag", F.explode(own).alias("r")).groupBy("id", "tag").agg(F.collect_list("r").alias("ranges")), "ranges")


def _later(across: bool) -> Column:
    """Whether a place (id, tag, lo) is a later one than the first, f."""
    if across:
        return F.col("id") > F.col("f.id")
    return (F.col("id") != F.col("f.id")) | (F.col("tag") != F.col("f.tag")) | (F.col("lo") != F.col("f.lo"))


def with_ranges(docs: DataFrame, ranges: DataFrame) -> DataFrame:
    """Keyed ``docs`` with their ``ranges``, null where there are none."""
    return docs.join(ranges.hint("shuffle_hash"), ["id", "tag"], "left").select("id", "tag", "doc_id", "text", "ranges")


def runs(flags: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of true values as (first, last)."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return [(int(a), int(b) - 1) for a, b in zip(edge[::2], edge[1::2], strict=True)]


def covered(ranges: list[dict] | None, width: int, n: int) -> np.ndarray:
    """Which of n symbols lie in a window whose start is in one of the ranges."""
    edge = np.zeros(n + width + 1, dtype=np.int32)
    for r in ranges or []:
        edge[r["lo"]] += 1
        edge[r["hi"] + width] -= 1
    return np.cumsum(edge[:n]) > 0


def emit(rows: list[tuple], names: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, (_, kind) in enumerate(names)], [n for n, _ in names])
