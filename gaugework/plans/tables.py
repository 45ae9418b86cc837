"""Example tables over the given data, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugework.functions.columns import hash_uniform

FEATURES = ["x1", "x2", "x3"]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def event_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """row_id, ts, segment, x1..x3, label, p: events with a planted label and a pinned score, rounded to 6 places."""
    e = read(spark, sf_dir, "events")
    u = hash_uniform(F.col("event_id"), 42, "label")
    return e.select(
        F.col("event_id").alias("row_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("segment"), F.col("value").alias("x1"),
        F.get_json_object("props", "$.k").cast("double").alias("x2"), (F.col("user_id") % 10).cast("double").alias("x3"),
        (F.col("value") > 20 + 60 * u).cast("int").alias("label"), F.round(1 / (1 + F.exp(-(F.col("value") - 50) / 25)), 6).alias("p"),
    )


EVENTS_SQL = """e AS (SELECT event_id AS row_id, ts, event_type AS segment, value AS x1,
 CAST(json_extract_string(props, '$.k') AS DOUBLE) AS x2, CAST(user_id % 10 AS DOUBLE) AS x3,
 CAST(value > 20 + 60 * (CAST('0x' || substr(md5(event_id || ':42:label'), 1, 8) AS BIGINT) / 4294967296.0) AS INT) AS label,
 round(1 / (1 + exp(-(value - 50) / 25)), 6) AS p FROM events)"""

LONG_SQL = """l AS (SELECT row_id, ts, segment, label, p, 0 AS feature_index, 'x1' AS feature, x1 AS value FROM e
 UNION ALL SELECT row_id, ts, segment, label, p, 1, 'x2', x2 FROM e UNION ALL SELECT row_id, ts, segment, label, p, 2, 'x3', x3 FROM e)"""


def uniform_sql(key: str, seed: int, salt: str) -> str:
    """SQL of ``hash_uniform``; ``salt`` is an SQL expression."""
    return f"(CAST('0x' || substr(md5({key} || ':{seed}:' || {salt}), 1, 8) AS BIGINT) / 4294967296.0)"


def normal_sql(key: str, seed: int, salt: str) -> str:
    a, b = uniform_sql(key, seed, f"{salt} || ':a'"), uniform_sql(key, seed, f"{salt} || ':b'")
    return f"(sqrt(-2.0 * ln(1.0 - {a})) * cos(2 * pi() * {b}))"


def ratio_sql(a: str, b: str) -> str:
    return f"(CASE WHEN ({b}) = 0 THEN 0.0 ELSE ({a})::DOUBLE / ({b}) END)"


def rates_sql(prefix: str = "", names: tuple[str, ...] = ("accuracy", "precision", "recall", "f1", "balanced_accuracy")) -> str:
    """SELECT items of the rates of the columns tp, fp, tn, fn."""
    tp, fp, tn, fn = (prefix + x for x in ("tp", "fp", "tn", "fn"))
    recall = ratio_sql(tp, f"{tp} + {fn}")
    made = {
        "accuracy": ratio_sql(f"{tp} + {tn}", f"{tp} + {fp} + {tn} + {fn}"), "precision": ratio_sql(tp, f"{tp} + {fp}"), "recall": recall,
        "f1": ratio_sql(f"2 * {tp}", f"2 * {tp} + {fp} + {fn}"), "balanced_accuracy": f"(({ratio_sql(tn, f'{tn} + {fp}')} + {recall}) / 2)",
    }
    return ", ".join(f"{made[n]} AS {prefix}{n}" for n in names)


def confusion_sql(t: str = "0.5", weight: str = "1") -> str:
    """SELECT items of tp, fp, tn, fn of label and p at a threshold."""
    one = lambda c: f"CAST(sum(CASE WHEN {c} THEN {weight} ELSE 0 END) AS BIGINT)"
    return f"{one(f'p >= {t} AND label = 1')} AS tp, {one(f'p >= {t} AND label = 0')} AS fp, {one(f'p < {t} AND label = 0')} AS tn, {one(f'p < {t} AND label = 1')} AS fn"
