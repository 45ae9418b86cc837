"""Mixing sources to target weights with weighted sampling without replacement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugework.llm.scratch import materialize

#: Regular expression of a word in Spark's dialect.
WORD = r"[^\x20\x09-\x0D]+"


def uniform(key: Column, seed: int) -> Column:
    """A number above 0 and below 1 that depends on the key's text and the seed alone."""
    digits = F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string"))), 1, 12)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 48)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality_weight(n_chars: Column, n_words: Column) -> Column:
    """Sampling weight of a document: 1 for ordinary mean word lengths, 0.5 for others."""
    mean = n_chars / F.greatest(n_words, F.lit(1))
    return F.when(mean.between(3.0, 12.0), 1.0).otherwise(0.5)


def source_targets(per_source: DataFrame, pattern: tuple[int, ...] = (5, 2, 1), most: int = 3) -> DataFrame:
    """Targets of the sources: rows (source, source_size), one per source, get ``weight`` and ``target``.

    Weights repeat ``pattern`` over the sources by code point, null last. All targets add up to the sum of the
    sizes; none is above ``most`` times its source's size: sources fill up in the order of cap by weight, and what
    is left at each step is dealt by weight, which is where resharing again and again ends. One row per source.
    """
    everything = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(int(x)) for x in pattern]), (F.row_number().over(by_name) - 1) % len(pattern) + 1)
    t = per_source.withColumn("weight", w.cast("long")).withColumn("cap", F.col("source_size") * most)
    filling = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    so_far = filling.rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("total", F.sum("source_size").over(everything))
    t = t.withColumn("left_size", F.col("total") - F.coalesce(F.sum("cap").over(so_far), F.lit(0)))
    t = t.withColumn("left_weight", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(so_far), F.lit(0)))
    fits = F.col("left_size") * F.col("weight") <= F.col("cap") * F.col("left_weight")
    # From the first source whose share is within its cap on, one water level holds for all.
    t = t.withColumn("at", F.row_number().over(filling)).withColumn("fits", fits)
    t = t.withColumn("level", F.min(F.when(F.col("fits"), F.struct("at", "left_size", "left_weight"))).over(everything))
    share = (F.col("level.left_size") * F.col("weight")).cast("double") / F.col("level.left_weight")
    target = F.when(F.col("level").isNull() | (F.col("at") < F.col("level.at")), F.col("cap").cast("double")).otherwise(share)
    return t.select("source", "source_size", "weight", F.coalesce(target, F.lit(0.0)).alias("target"))


def mix(docs: DataFrame, seed: int = 7, pattern: tuple[int, ...] = (5, 2, 1), most: int = 3, buckets: int = 256) -> DataFrame:
    """Decide how often the mix takes each document: all columns of ``docs`` (which need ``doc_id``, ``text`` and
    ``source``) plus ``mix_size`` (words), ``mix_source_size``, ``mix_target`` and ``mix_copies``.

    Efraimidis-Spirakis: each document draws u, its key is -ln(u) / quality weight, and a source takes documents by
    ascending key. A target of at least the source's size first takes complete epochs, each document once; what
    then remains is filled in key order up to the prefix sum that is nearest to the budget (the document on the
    boundary comes in if that leaves the source nearer to its target). u is a hash of doc_id (of the text where that is null)
    and the seed, so reruns and other partitionings agree.

    A source of any size is dealt into ``buckets`` ranges of 1 - exp(-key); only the sums of the ranges meet per
    source, and the running sum inside a range is a window of its own. The document on the boundary is found from
    the running sum too, so no task holds a whole source.

    Nulls: a null text has size 0 and is never taken in a fraction; a null source is a source, the last. A document of
    size 0 is copied only by complete epochs. Repeated rows draw the same u and are ordered arbitrarily among
    themselves, which changes no result. Empty tables give empty results. Other columns pass through.
    """
    d = docs.withColumn("mix_size", word_count(F.col("text")))
    u = uniform(F.coalesce(F.col("doc_id").cast("string"), F.col("text"), F.lit("")), seed)
    key = -F.log(u) / quality_weight(F.length("text"), F.col("mix_size"))
    small = d.select("doc_id", "source", "mix_size", F.coalesce(key, F.lit(0.0)).alias("key"), F.xxhash64("doc_id", "text").alias("row_key"))
    small = small.withColumn("range", F.least(F.floor((1 - F.exp(-F.col("key"))) * buckets), F.lit(buckets - 1)).cast("int"))
    small = materialize(small, "sizes")

    per_range = small.groupBy("source", "range").agg(F.sum("mix_size").alias("range_size"))
    in_source = Window.partitionBy("source")
    per_range = per_range.withColumn("source_size", F.sum("range_size").over(in_source))
    before = in_source.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    per_range = per_range.withColumn("before", F.coalesce(F.sum("range_size").over(before), F.lit(0)))
    targets = source_targets(small.groupBy("source").agg(F.sum("mix_size").alias("source_size")), pattern, most)

    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    plan = (
        per_range.alias("r")
        .join(targets.alias("t").hint("shuffle_hash"), F.col("r.source").eqNullSafe(F.col("t.source")))
        .select("r.source", "range", "range_size", "before", "t.source_size", "target")
        .withColumn("epochs", epochs)
        .withColumn("budget", F.col("target") - F.col("epochs") * F.col("source_size"))
    )
    ordered = Window.partitionBy("source", "range").orderBy("key", "row_key", "mix_size").rowsBetween(Window.unboundedPreceding, 0)
    placed = (
        small.withColumn("inside", F.sum("mix_size").over(ordered))
        .alias("s")
        .join(plan.alias("p").hint("shuffle_hash"), F.col("s.source").eqNullSafe(F.col("p.source")) & (F.col("s.range") == F.col("p.range")))
        .withColumn("after", F.col("before") + F.col("inside"))
    )
    within = F.col("after") <= F.col("budget")
    # The document on the boundary: half of it or more fits.
    nearer = (F.col("after") > F.col("budget")) & (F.col("after") - F.col("mix_size") < F.col("budget")) & (F.col("after") - F.col("budget") < F.col("budget") - (F.col("after") - F.col("mix_size")))
    extra = F.when((F.col("mix_size") > 0) & (within | nearer), 1).otherwise(0)
    return placed.select("doc_id", "row_key", "s.source", "mix_size", F.col("source_size").alias("mix_source_size"), F.col("target").alias("mix_target"), (F.col("epochs") + extra).alias("mix_copies"))


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, each as many times as ``mix`` takes it."""
    taken = mix(docs, **options)
    # Repeated rows share a key; each gets as many copies as one of them, the most.
    taken = taken.groupBy(F.col("row_key").alias("__taken")).agg(F.max("mix_copies").alias("__copies")).where("__copies > 0")
    keyed = docs.withColumn("__key", F.xxhash64("doc_id", "text"))
    out = keyed.join(taken.hint("shuffle_hash"), F.col("__key") == F.col("__taken"))
    out = out.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int"))))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
