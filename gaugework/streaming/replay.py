"""Streaming twins: metrics of scored rows in event-time windows, and runs of errors kept as state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from gaugework.functions.columns import clip, with_rates

RUNS = "segment string, start_row long, length long, closed_by long"


def window_metrics(scored: DataFrame, duration: str = "1 day", delay: str = "10 minutes", threshold: float = 0.5) -> DataFrame:
    """Additive metrics of a scored stream (ts, segment, label, p) by window and segment. Rows later than the watermark are
    dropped by Spark; a window comes out once the watermark has passed its end."""
    hit, y = F.col("p") >= threshold, F.col("label") == 1
    q = clip(F.col("p"), 1e-7, 1 - 1e-7)
    cells = {"tp": hit & y, "fp": hit & ~y, "tn": ~hit & ~y, "fn": ~hit & y}
    per = scored.withWatermark("ts", delay).groupBy(F.window("ts", duration), "segment").agg(
        F.count("*").alias("n"), *[F.count_if(c).alias(k) for k, c in cells.items()], F.avg((F.col("p") - F.col("label")) ** 2).alias("brier"), F.avg(-(F.col("label") * F.log(q) + (1 - F.col("label")) * F.log(1 - q))).alias("log_loss"),
    )
    return with_rates(per).select(F.col("window.start").alias("window_start"), "segment", "n", "accuracy", "f1", "brier", "log_loss")


def _runs(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """State: first row and length of the open run. Rows of a micro-batch are put in order of time."""
    start, length = state.get if state.exists else (-1, 0)
    rows = pd.concat(list(batches)).sort_values(["ts", "row_id"])
    out = []
    for row, wrong in zip(rows["row_id"].tolist(), rows["wrong"].tolist(), strict=True):
        if wrong:
            start, length = (row, 1) if length == 0 else (start, length + 1)
        elif length:
            out.append((key[0], start, length, row))
            start, length = -1, 0
    state.update((start, length))
    yield pd.DataFrame(out, columns=["segment", "start_row", "length", "closed_by"])


def error_runs(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Closed runs of consecutive wrong rows of each segment, for a stream that comes in order of time. The state of a segment
    is one open run."""
    wrong = (F.col("p") >= threshold) != (F.col("label") == 1)
    rows = scored.select("segment", "ts", "row_id", wrong.alias("wrong"))
    return rows.groupBy("segment").applyInPandasWithState(_runs, RUNS, "start long, length long", "append", GroupStateTimeout.NoTimeout)


def run_summaries(scored: DataFrame, threshold: float = 0.5, step: str = "1 hour", delay: str = "2 hours") -> DataFrame:
    """What each segment and step of time adds to the runs of wrong rows, for a stream in any order within ``delay``.

    The state is the rows of one segment and step (so a hot segment wants a short step), no segment is one task for all time, and
    summaries of neighbouring steps merge (``joined_runs``). Columns: n; head, the wrong rows before the first right one (n if
    there is none), and head_row, where they begin; closer, the first right row; tail and tail_row, the wrong rows after
    the last right one; inner, the runs between right ones. Rows later than the watermark are dropped by Spark."""
    wrong = (F.col("p") >= threshold) != (F.col("label") == 1)
    rows = scored.select("segment", "ts", "row_id", wrong.alias("wrong")).withWatermark("ts", delay).groupBy(F.window("ts", step), "segment")
    one = rows.agg(F.array_sort(F.collect_list(F.struct("ts", "row_id", "wrong"))).alias("r")).select(F.col("window.start").alias("window_start"), "segment", "r", F.size("r").alias("n"))
    one = one.withColumn("ok", F.filter(F.sequence(F.lit(0), F.col("n") - 1), lambda i: ~F.get("r", i)["wrong"])).withColumn("m", F.size("ok"))
    row = lambda i: F.get("r", i)["row_id"]
    ok = lambda i: F.get("ok", i)
    last = ok(F.col("m") - 1)
    between = F.transform(F.sequence(F.lit(0), F.col("m") - 2), lambda j: F.struct(row(ok(j) + 1).alias("start_row"), (ok(j + 1) - ok(j) - 1).cast("long").alias("length"), row(ok(j + 1)).alias("closed_by")))
    inner = F.filter(F.when(F.col("m") > 1, between), lambda run: run["length"] > 0)
    head = F.when(F.col("m") > 0, ok(F.lit(0))).otherwise(F.col("n")).cast("long")
    tail = F.when(F.col("m") > 0, F.col("n") - 1 - last).otherwise(0).cast("long")
    return one.select("window_start", "segment", F.col("n").cast("long").alias("n"), head.alias("head"), row(F.lit(0)).alias("head_row"), F.when(F.col("m") > 0, row(ok(F.lit(0)))).alias("closer"), tail.alias("tail"), row(last + 1).alias("tail_row"), inner.alias("inner"))


def joined_runs(summaries: DataFrame) -> DataFrame:
    """Closed runs (segment, start_row, length, closed_by) of the summaries of all steps, as ``error_runs`` gives them.

    A run over the ends of steps is a tail, whole steps and a head, which share the number of right-holding steps before
    them. The window runs over summaries, one for each step of a segment's time."""
    before = F.coalesce(F.sum(F.col("closer").isNotNull().cast("int")).over(Window.partitionBy("segment").orderBy("window_start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    piece = lambda turn, part, length, row, closer: F.struct(turn.alias("turn"), F.lit(part).alias("part"), F.col(length).alias("length"), F.col(row).alias("row"), closer.alias("closer"))
    holds = F.col("closer").isNotNull()
    head, tail = piece(F.col("_turn"), 1, "head", "head_row", F.col("closer")), piece(F.col("_turn") + 1, 0, "tail", "tail_row", F.lit(None).cast("long"))
    pieces = summaries.withColumn("_turn", before).select("segment", "window_start", F.inline(F.filter(F.array(head, F.when(holds, tail)), lambda p: p.isNotNull())))
    some = F.col("length") > 0
    across = pieces.groupBy("segment", "turn").agg(F.min_by(F.when(some, F.col("row")), F.when(some, F.struct("part", "window_start"))).alias("start_row"), F.sum("length").alias("length"), F.max("closer").alias("closed_by"))
    return summaries.select("segment", F.inline("inner")).unionByName(across.where("length > 0 and closed_by is not null").select("segment", "start_row", "length", "closed_by"))


def drain(stream: DataFrame, folder: str) -> DataFrame:
    """Run a stream over all that is there now into Parquet, and read the result. A second call with the same folder goes on
    from where the first ended."""
    query = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")


def table_stream(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table, one file or a folder of them, as a stream of its files. The pattern stands for just that path."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).parquet(path[:-1] + f"[{path[-1]}]")
