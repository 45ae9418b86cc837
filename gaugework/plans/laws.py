"""Draws from Poisson and hypergeometric laws by exact inversion, as tables and column expressions.

A law's cumulative table runs over every count within ``TAIL`` standard deviations (and ``TAIL`` counts) of its mean, which leaves
out less than 1e-25 of it: the probabilities follow from their ratios, summed as logarithms. A draw is the first count whose
cumulative probability reaches a uniform number. Tables of a variance above ``EXACT`` would be long; there the quantile is expanded
in the law's cumulants to the second order (Cornish-Fisher), whose distribution function is off by less than 1e-7."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TAIL, EXACT = 12, 1e6
#: Powers of two that a search of the longest table takes.
_STEPS = 15


def _cumulative(laws: DataFrame, key: Sequence[str], log_ratio: Column) -> DataFrame:
    """``laws`` (key..., _lo, _hi and parameters) with ``_cdf``: the cumulative probabilities of _lo, _lo + 1, ... _hi.
    ``log_ratio`` is the logarithm of a count's probability over that of the count before it, of the column ``_k``."""
    rows = laws.where("_hi is not null").withColumn("_k", F.explode(F.sequence("_lo", "_hi")))
    upto = Window.partitionBy(*key).orderBy("_k").rowsBetween(Window.unboundedPreceding, 0)
    all_ = Window.partitionBy(*key)
    rows = rows.withColumn("_s", F.sum(F.when(F.col("_k") > F.col("_lo"), log_ratio).otherwise(0.0)).over(upto))
    rows = rows.withColumn("_w", F.exp(F.col("_s") - F.max("_s").over(all_)))
    rows = rows.withColumn("_c", F.sum("_w").over(upto) / F.sum("_w").over(all_))
    return rows.groupBy(*key).agg(F.first("_lo").alias("_lo"), F.array_sort(F.collect_list(F.struct("_k", "_c"))).alias("_t")).select(*key, "_lo", F.transform("_t", lambda t: t["_c"]).alias("_cdf"))


def poisson_tables(means: DataFrame, mean: str, key: Sequence[str]) -> DataFrame:
    """(key..., _mean, _lo, _cdf) of the Poisson laws of the column ``mean``, for each row of ``means``; without a table (_cdf null) where
    the mean is above ``EXACT``. A table is as long as 24 standard deviations, 24,000 counts at most."""
    m = F.col(mean).cast("double")
    laws = means.select(*key, m.alias("_mean"))
    m, reach = F.col("_mean"), TAIL * F.sqrt("_mean") + TAIL
    hi = F.when(m <= 0, F.lit(0)).when(m <= EXACT, F.ceil(m + reach)).cast("long")
    ranged = laws.withColumn("_lo", F.when(m <= 0, F.lit(0)).otherwise(F.greatest(F.lit(0), F.floor(m - reach))).cast("long")).withColumn("_hi", hi)
    cdf = _cumulative(ranged, key, F.log(F.col("_mean") / F.col("_k")))
    return laws.join(F.broadcast(cdf), list(key), "left")


def hypergeometric_table(one: DataFrame) -> DataFrame:
    """``one`` (a single row with N, P, K) with _lo and _cdf of the number of P marked rows among K that are drawn of N; without a table
    where the variance is above ``EXACT``."""
    n, p, k = (F.col(c).cast("double") for c in "NPK")
    variance = hypergeometric_variance()
    reach = TAIL * F.sqrt(variance) + TAIL
    least, most = F.greatest(F.lit(0.0), k + p - n), F.least(k, p)
    mean = F.when(n > 0, k * p / n).otherwise(0.0)
    lo = F.greatest(least, F.floor(mean - reach)).cast("long")
    ranged = one.select("N", "P", "K", F.lit(0).alias("_one"), lo.alias("_lo"), F.when(variance <= EXACT, F.least(most, F.ceil(mean + reach))).cast("long").alias("_hi"))
    x = F.col("_k")
    ratio = F.log((p - x + 1) * (k - x + 1) / (x * (n - p - k + x)))
    cdf = _cumulative(ranged, ["_one"], ratio)
    return one.withColumn("_one", F.lit(0)).join(F.broadcast(cdf), "_one", "left").drop("_one")


def hypergeometric_variance() -> Column:
    n, p, k = (F.col(c).cast("double") for c in "NPK")
    return F.when(n > 1, k * p * (n - k) * (n - p) / (n * n * (n - 1))).otherwise(0.0)


def inverse(u: Column) -> Column:
    """The first count whose cumulative probability reaches u, from the columns _lo and _cdf."""
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(_STEPS))])
    below = F.aggregate(steps, F.lit(0), lambda at, k: F.when(F.get("_cdf", at + k - 1) < u, at + k).otherwise(at))
    return F.least(F.col("_lo") + below, F.col("_lo") + F.size("_cdf") - 1).cast("long")


def _expanded(mean: Column, spread: Column, skew: Column, excess: Column, z: Column) -> Column:
    z2 = z * z
    return F.rint(mean + spread * (z + (z2 - 1) / 6 * skew + (z2 * z - 3 * z) / 24 * excess - (2 * z2 * z - 5 * z) / 36 * skew * skew))


def poisson_draw(u: Column, z: Column) -> Column:
    """A Poisson number from the columns of ``poisson_tables``: by the uniform number u, or without a table by the normal number z."""
    m = F.col("_mean")
    far = F.greatest(_expanded(m, F.sqrt(m), 1 / F.sqrt(m), 1 / m, z), F.lit(0.0)).cast("long")
    return F.when(F.col("_cdf").isNotNull(), inverse(u)).otherwise(far)


def hypergeometric_draw(u: Column, z: Column) -> Column:
    """A number from the columns of ``hypergeometric_table``: by the uniform number u, or without a table by the normal number z."""
    n, p, k = (F.col(c).cast("double") for c in "NPK")
    spread = F.sqrt(hypergeometric_variance())
    skew = (n - 2 * p) * (n - 2 * k) / (n * (n - 2)) / spread
    far = F.greatest(F.least(_expanded(k * p / n, spread, skew, F.lit(0.0), z), k, p), F.lit(0.0), k + p - n).cast("long")
    return F.when(F.col("_cdf").isNotNull(), inverse(u)).otherwise(far)


def poisson_tables_sql(name: str, source: str, key: str) -> str:
    """SQL of ``poisson_tables`` as a table expression ``name`` (key, k, lo, hi, cdf): a row for each count. ``source`` gives key and mean."""
    return f"""{name} AS MATERIALIZED (SELECT {key}, k, lo, hi, sum(w) OVER o / sum(w) OVER g AS cdf FROM (SELECT *, exp(s - max(s) OVER (PARTITION BY {key})) AS w FROM (SELECT *, sum(CASE WHEN k > lo THEN ln(mean / k) ELSE 0.0 END) OVER (PARTITION BY {key} ORDER BY k) AS s
 FROM (SELECT *, unnest(range(lo, hi + 1)) AS k FROM (SELECT *, CASE WHEN mean <= 0 THEN 0 ELSE greatest(0, floor(mean - {TAIL} * sqrt(mean) - {TAIL})) END::BIGINT AS lo, CASE WHEN mean <= 0 THEN 0 ELSE ceil(mean + {TAIL} * sqrt(mean) + {TAIL}) END::BIGINT AS hi FROM ({source}))))) WINDOW o AS (PARTITION BY {key} ORDER BY k), g AS (PARTITION BY {key}))"""
