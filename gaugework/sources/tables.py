"""Reading, validating, fingerprinting and writing example and score tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCORE_COLUMNS = ("probability", "predicted_label", "confidence", "uncertainty", "conformal_set", "drift", "ood", "query_score", "query_rank", "review_priority")


def _strings(names: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def read_labeled_csv(spark: SparkSession, path: str, names: Sequence[str] | None = None, dim: int | None = None, header: bool | None = None) -> DataFrame:
    """Raw string columns of a CSV file whose last column is the label: x1..xd (or ``names``) and ``label``.

    Blank lines are skipped and a byte-order mark is ignored. ``header``: None finds out, as a header is a first line in
    which no cell is a number."""
    first = spark.read.text(path).where(F.trim("value") != "").limit(1).collect()
    cells = first[0][0].lstrip("﻿").split(",") if first else []
    if header is None:
        header = bool(cells) and not any(_is_number(c) for c in cells)
    d = dim if dim is not None else max(len(cells) - 1, 1)
    names = list(names or ([c.strip() for c in cells[:-1]] if header and len(cells) == d + 1 else [f"x{i + 1}" for i in range(d)]))
    schema = _strings([*names, "label", "_rest"])
    return spark.read.csv(path, schema=schema, header=header, enforceSchema=True, mode="PERMISSIVE", ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True).where(F.coalesce(*[F.col(f"`{n}`") for n in [*names, "label"]]).isNotNull())


def read_unlabeled_csv(spark: SparkSession, path: str, dim: int | None = None) -> DataFrame:
    """Raw string columns x1..xd of a CSV file without labels; see ``read_labeled_csv`` for headers."""
    first = spark.read.text(path).where(F.trim("value") != "").limit(1).collect()
    cells = first[0][0].lstrip("﻿").split(",") if first else []
    header = bool(cells) and not any(_is_number(c) for c in cells)
    d = dim if dim is not None else max(len(cells), 1)
    names = [c.strip() for c in cells] if header and len(cells) == d else [f"x{i + 1}" for i in range(d)]
    return spark.read.csv(path, schema=_strings([*names, "_rest"]), header=header, enforceSchema=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True).where(F.coalesce(*[F.col(f"`{n}`") for n in names]).isNotNull())


def _is_number(text: str) -> bool:
    try:
        float(text)
    except ValueError:
        return False
    return True


def with_reasons(raw: DataFrame, features: Sequence[str], label: str | None = "label") -> DataFrame:
    """``raw`` with its features as doubles and ``reason``: why a row is no example, null for good ones.

    Checked in order: a missing cell or one too many (``_rest``), a non-number, a non-finite number, a label other than
    0 or 1."""
    cell = [F.col(f"`{f}`") for f in features]
    number = [c.try_cast("double") for c in cell]
    any_ = lambda conditions: F.greatest(*[F.coalesce(c, F.lit(False)).cast("int") for c in (*conditions, F.lit(False))]) == 1
    missing = any_([c.isNull() for c in cell] + ([F.col("_rest").isNotNull()] if "_rest" in raw.columns else []))
    text = any_([n.isNull() for n in number])
    infinite = any_([F.isnan(n) | (F.abs(n) == float("inf")) for n in number])
    reason = F.when(missing, "wrong_length").when(text, "not_a_number").when(infinite, "not_finite")
    out = raw
    if label:
        y = F.col(label).try_cast("double")
        reason = reason.when(y.isNull() | ~y.isin(0.0, 1.0), "bad_label")
        out = out.withColumn("_y", y.cast("int"))
    out = out.withColumn("reason", reason).withColumns({f: n for f, n in zip(features, number, strict=True)})
    return out.withColumn(label, F.col("_y")).drop("_y") if label else out


def valid_rows(checked: DataFrame) -> DataFrame:
    return checked.where("reason is null").drop("reason", "_rest")


def rejected_rows(checked: DataFrame) -> DataFrame:
    return checked.where("reason is not null")


def dataset_checks(checked: DataFrame, min_rows: int = 2, both_classes: bool = True) -> DataFrame:
    """One row: valid and rejected rows, classes seen, and the first problem of the dataset as a whole."""
    good = F.col("reason").isNull()
    c = checked.agg(F.count_if(good).alias("valid"), F.count_if(~good).alias("rejected"), F.count_if(good & (F.col("label") == 0)).alias("n0"), F.count_if(good & (F.col("label") == 1)).alias("n1"))
    one = (F.col("n0") == 0) | (F.col("n1") == 0)
    return c.withColumn("problem", F.when(F.col("valid") < min_rows, "too_few_rows").when(F.lit(both_classes) & one, "missing_class"))


def validate_scores(rows: DataFrame, scores: DataFrame) -> DataFrame:
    """One row: row ids without a score, scores that are not finite or outside [0, 1] by more than 1e-7, and scores clipped."""
    missing = rows.select("row_id").join(scores.select("row_id"), "row_id", "left_anti").agg(F.count("*").alias("missing"))
    p = F.col("p")
    bad = p.isNull() | F.isnan(p) | (p < -1e-7) | (p > 1 + 1e-7)
    checked = scores.agg(F.count("*").alias("scores"), F.count_if(bad).alias("invalid"), F.count_if(~bad & ((p < 0) | (p > 1))).alias("clipped"))
    return checked.crossJoin(F.broadcast(missing))  # one row each


def clipped_scores(scores: DataFrame) -> DataFrame:
    return scores.withColumn("p", F.least(F.greatest("p", F.lit(0.0)), F.lit(1.0)))


def _portable_hash(columns: Sequence[Column]) -> Column:
    """48 bits of the MD5 of the values as text: the same in any engine."""
    text = F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("~")) for c in columns])
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("long")


def fingerprint(df: DataFrame, columns: Sequence[str], order: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Row count and two order-free combinations of row hashes; with ``order``, each row's place is hashed with it, so
    that the fingerprint depends on the order of rows."""
    values = [F.round(F.col(c), 8).cast("decimal(30,8)") if df.schema[c].dataType == T.DoubleType() else F.col(c) for c in ([order] if order else []) + list(columns)]
    h = _portable_hash(values)
    return df.groupBy(*by).agg(F.count("*").alias("rows"), F.coalesce(F.sum(h.cast("decimal(38,0)")), F.lit(0)).cast("decimal(38,0)").cast("string").alias("hash_sum"), F.coalesce(F.bit_xor(h), F.lit(0)).alias("hash_xor"))


def reusable_evidence(evidence: DataFrame, current: DataFrame, key: Sequence[str] = ("rows", "hash_sum", "hash_xor")) -> DataFrame:
    """Stored evidence whose fingerprint is that of the current table."""
    return evidence.join(current.select(*key), list(key), "left_semi")


def reviewed_rows(scored: DataFrame, features: Sequence[str], review: str = "review_label") -> DataFrame:
    """Examples from a scored table that people filled in: rows reviewed as 0 or 1, with that label."""
    mark = F.trim(F.col(review))
    return scored.where(mark.isin("0", "1")).select("row_id", *features, mark.cast("int").alias("label"))


def bad_reviews(scored: DataFrame, review: str = "review_label") -> DataFrame:
    """Rows with a review that is neither blank nor 0 nor 1."""
    mark = F.trim(F.coalesce(F.col(review), F.lit("")))
    return scored.where((mark != "") & ~mark.isin("0", "1"))


def append_reviewed(examples: DataFrame, reviewed: DataFrame, latest_wins: bool = True) -> DataFrame:
    """Examples with reviewed ones appended; a reviewed row replaces one of the same id if ``latest_wins``."""
    keep = examples.join(reviewed.select("row_id"), "row_id", "left_anti") if latest_wins else examples
    return keep.select(*reviewed.columns).unionByName(reviewed)


def dataset_from_json(spark: SparkSession, path: str) -> DataFrame:
    """Examples (row_id, features, label) of a document ``{input_dim, samples: [{features, label}]}``."""
    schema = "input_dim int, samples array<struct<features: array<double>, label: int>>"
    return spark.read.schema(schema).json(path, multiLine=True).select(F.posexplode("samples").alias("row_id", "s")).select(F.col("row_id").cast("long"), "s.features", "s.label")


def write_dataset_json(examples: DataFrame, features: Sequence[str], path: str) -> None:
    """One JSON line for each example: ``{row_id, features, label}``."""
    examples.select("row_id", F.array(*features).alias("features"), "label").write.json(path)


def parse_json_examples(raw: DataFrame, column: str = "raw", dim: int = 2) -> DataFrame:
    """Rows ``[[f...], label]`` or ``[f...]`` given as JSON text: features, label (null for vectors) and ``reason``."""
    text = F.trim(F.col(column))
    labelled = text.startswith("[[")
    pair = F.regexp_extract(text, r"^\[\s*(\[[^\]]*\])\s*,\s*([^\]]*)\]$", 1)
    body = F.when(labelled, pair).otherwise(text)
    features = F.from_json(body, "array<double>")
    y = F.when(labelled, F.trim(F.regexp_extract(text, r"^\[\s*\[[^\]]*\]\s*,\s*([^\]]*)\]$", 1)).try_cast("int"))
    out = raw.withColumn("features", features).withColumn("label", y)
    bad = F.when(F.col("features").isNull() | F.exists("features", lambda v: v.isNull()), "not_a_vector").when(F.size("features") != dim, "wrong_length").when(labelled & (F.col("label").isNull() | ~F.col("label").isin(0, 1)), "bad_label")
    return out.withColumn("reason", bad)


def write_bundle(path: str, examples: DataFrame, probes: DataFrame, policies: DataFrame, meta: DataFrame) -> None:
    """A dataset with its probes, policies and metadata, as Parquet tables in one folder."""
    for name, df in (("examples", examples), ("probes", probes), ("policies", policies), ("meta", meta)):
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def read_bundle(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{path}/{name}") for name in ("examples", "probes", "policies", "meta")}


def review_sheet(scored: DataFrame, features: Sequence[str]) -> DataFrame:
    """A scored table for people: features, the score columns it has (8 places) and a blank review column."""
    shown = [F.round(c, 8).alias(c) if scored.schema[c].dataType == T.DoubleType() else F.col(c) for c in SCORE_COLUMNS if c in scored.columns]
    return scored.select("row_id", *features, *shown, F.lit(None).cast("string").alias("review_label"))


def evidence_rows(results: dict[str, DataFrame], entity: str) -> DataFrame:
    """One-row results as long evidence: entity, source, metric, value (numbers and truth values) or text."""
    out = None
    for source, df in results.items():
        items = []
        for f in df.schema.fields:
            number = isinstance(f.dataType, T.NumericType | T.BooleanType)
            value = F.col(f"`{f.name}`").cast("int").cast("double") if isinstance(f.dataType, T.BooleanType) else F.col(f"`{f.name}`").cast("double") if number else F.lit(None).cast("double")
            items.append(F.struct(F.lit(f.name).alias("metric"), value.alias("value"), (F.lit(None) if number else F.col(f"`{f.name}`")).cast("string").alias("text")))
        part = df.select(F.lit(entity).alias("entity"), F.lit(source).alias("source"), F.inline(F.array(*items)))
        out = part if out is None else out.unionByName(part)
    return out


def flatten_trials(trials: DataFrame) -> DataFrame:
    """Trials with struct columns spread out (config.*, metrics.*), as a flat table to write."""
    columns = []
    for f in trials.schema.fields:
        columns += [F.col(f"{f.name}.{g.name}").alias(g.name) for g in f.dataType.fields] if isinstance(f.dataType, T.StructType) else [F.col(f.name)]
    return trials.select(*columns)


def latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key by ``order``."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where("_n = 1").drop("_n")
