"""Queries of sources, validation, preparation and uncertainty (S, V, P, U, B, Q, N5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugework.operators import prep as P
from gaugework.operators import uncertainty as U
from gaugework.plans.registry import Registry
from gaugework.plans.tables import FEATURES as X
from gaugework.plans.laws import poisson_tables_sql
from gaugework.plans.tables import confusion_sql, rates_sql, read, uniform_sql
from gaugework.plans.tables import event_examples as E
from gaugework.sources import tables as S

R = Registry()


def _raw(s, d):
    """Events as a raw text table with planted defects."""
    e = E(s, d)
    v = F.col("x1").cast("string")
    bad = F.when(F.col("row_id") % 97 == 0, F.lit(None).cast("string")).when(F.col("row_id") % 89 == 0, "n/a").when(F.col("row_id") % 83 == 0, "Infinity").otherwise(v)
    y = F.when(F.col("row_id") % 79 == 0, "2").otherwise(F.col("label").cast("string"))
    return e.select("row_id", bad.alias("x1"), F.col("x2").cast("string").alias("x2"), y.alias("label"))


RAW_SQL = """chk AS (SELECT row_id, CASE WHEN row_id % 97 = 0 THEN 'wrong_length' WHEN row_id % 89 = 0 THEN 'not_a_number' WHEN row_id % 83 = 0 THEN 'not_finite' WHEN row_id % 79 = 0 THEN 'bad_label' END AS reason, label, x1, x2 FROM e)"""
_CHECKED = lambda s, d: S.with_reasons(_raw(s, d), ["x1", "x2"])
R.add("v1_valid_rows", lambda s, d: S.valid_rows(_CHECKED(s, d)), f"WITH {RAW_SQL} SELECT row_id, label, x1, x2 FROM chk WHERE reason IS NULL", "x1 x2")
R.add("v1_rejected_rows", lambda s, d: S.rejected_rows(_CHECKED(s, d)).select("row_id", "reason"), f"WITH {RAW_SQL} SELECT row_id, reason FROM chk WHERE reason IS NOT NULL")
R.add(
    "v1_dataset_checks", lambda s, d: S.dataset_checks(_CHECKED(s, d)),
    f"WITH {RAW_SQL} SELECT count(*) FILTER (reason IS NULL) AS valid, count(*) FILTER (reason IS NOT NULL) AS rejected, count(*) FILTER (reason IS NULL AND label = 0) AS n0, count(*) FILTER (reason IS NULL AND label = 1) AS n1, CAST(NULL AS VARCHAR) AS problem FROM chk",
)
R.add(
    "v2_score_validation", lambda s, d: S.validate_scores(E(s, d), E(s, d).where("row_id % 10 <> 3").withColumn("p", F.when(F.col("row_id") % 7 == 0, 1.00000005).when(F.col("row_id") % 11 == 0, 1.5).otherwise(F.col("p")))),
    "SELECT count(*) FILTER (row_id % 10 <> 3) AS scores, count(*) FILTER (row_id % 10 <> 3 AND row_id % 7 <> 0 AND row_id % 11 = 0) AS invalid, count(*) FILTER (row_id % 10 <> 3 AND row_id % 7 = 0) AS clipped, count(*) FILTER (row_id % 10 = 3) AS missing FROM e",
)
_FP = "CAST('0x' || substr(md5({0}), 1, 12) AS BIGINT)"
_VALUES = "x1::DECIMAL(30,8)::VARCHAR || '|' || x2::DECIMAL(30,8)::VARCHAR || '|' || label::VARCHAR"
R.add("v3_fingerprint", lambda s, d: S.fingerprint(E(s, d), ["x1", "x2", "label"], by=["segment"]), f"SELECT segment, count(*) AS rows, sum(h)::VARCHAR AS hash_sum, bit_xor(h) AS hash_xor FROM (SELECT segment, {_FP.format(_VALUES)} AS h FROM e) GROUP BY segment")
R.add("v3_ordered_fingerprint", lambda s, d: S.fingerprint(E(s, d), ["x1", "x2", "label"], "row_id"), f"SELECT count(*) AS rows, sum(h)::VARCHAR AS hash_sum, bit_xor(h) AS hash_xor FROM (SELECT {_FP.format(f'row_id::VARCHAR || chr(124) || {_VALUES}')} AS h FROM e)")


def _v4(s, d):
    now = S.fingerprint(E(s, d), ["x1", "label"], by=["segment"])
    stored = now.withColumn("hash_xor", F.when(F.col("segment") == "error", F.col("hash_xor") + 1).otherwise(F.col("hash_xor"))).withColumn("metric", F.lit("f1"))
    return S.reusable_evidence(stored, now).select("segment", "metric", "rows")


R.add("v4_reusable_evidence", _v4, "SELECT segment, 'f1' AS metric, count(*) AS rows FROM e WHERE segment <> 'error' GROUP BY segment")


def _reviewed(s, d):
    mark = F.when(F.col("row_id") % 5 == 0, " 1 ").when(F.col("row_id") % 5 == 1, "0").when(F.col("row_id") % 50 == 2, "maybe").otherwise("")
    return E(s, d).withColumn("review_label", mark)


R.add("s3_reviewed_rows", lambda s, d: S.reviewed_rows(_reviewed(s, d), X), "SELECT row_id, x1, x2, x3, CASE WHEN row_id % 5 = 0 THEN 1 ELSE 0 END AS label FROM e WHERE row_id % 5 IN (0, 1)", "x1 x2 x3")
R.add("s3_bad_reviews", lambda s, d: S.bad_reviews(_reviewed(s, d)).select("row_id", "review_label"), "SELECT row_id, 'maybe' AS review_label FROM e WHERE row_id % 50 = 2")
R.add("p12_append_reviewed", lambda s, d: S.append_reviewed(E(s, d), S.reviewed_rows(_reviewed(s, d), X)), "SELECT row_id, x1, x2, x3, CASE WHEN row_id % 5 = 0 THEN 1 WHEN row_id % 5 = 1 THEN 0 ELSE label END AS label FROM e", "x1 x2 x3")
R.add(
    "s7_json_examples", lambda s, d: S.parse_json_examples(E(s, d).select("row_id", F.concat(F.lit("[["), F.col("x1").cast("string"), F.lit(","), F.when(F.col("row_id") % 13 == 0, "oops").otherwise(F.col("x2").cast("string")), F.lit("],"), F.when(F.col("row_id") % 17 == 0, "7").otherwise(F.col("label").cast("string")), F.lit("]")).alias("raw"))).select("row_id", "label", "reason"),
    "SELECT row_id, CASE WHEN row_id % 17 = 0 THEN 7 ELSE label END AS label, CASE WHEN row_id % 13 = 0 THEN 'not_a_vector' WHEN row_id % 17 = 0 THEN 'bad_label' END AS reason FROM e",
)
R.add("s8_flat_trials", lambda s, d: S.flatten_trials(E(s, d).groupBy("segment").agg(F.struct(F.lit("linear").alias("feature_map"), F.lit(0.1).alias("rate")).alias("config"), F.struct(F.avg("p").alias("mean_p"), F.count("*").alias("n")).alias("metrics"))), "SELECT segment, 'linear' AS feature_map, 0.1::DOUBLE AS rate, avg(p) AS mean_p, count(*) AS n FROM e GROUP BY segment", "rate mean_p")

STD_SQL = "st AS (SELECT feature_index, feature, avg(value) AS mean, CASE WHEN stddev_pop(value) < 1e-8 THEN 1.0 ELSE stddev_pop(value) END AS scale FROM l GROUP BY 1, 2)"
_Z = ", ".join(f"(x{i} - (SELECT mean FROM st WHERE feature = 'x{i}')) / (SELECT scale FROM st WHERE feature = 'x{i}') AS x{i}" for i in (1, 2, 3))
R.add("p1_standardizer", lambda s, d: P.fit_standardizer(E(s, d), X), f"WITH {STD_SQL} SELECT * FROM st", "mean scale", "l")
R.add("p1_standardized", lambda s, d: P.standardize(E(s, d), P.fit_standardizer(E(s, d), X), X).select("row_id", *X), f"WITH {STD_SQL} SELECT row_id, {_Z} FROM e", "x1 x2 x3", "l")
R.add(
    "p2_selected_features", lambda s, d: P.select_features(E(s, d), X, 2),
    """WITH m AS (SELECT feature_index, min(value) AS lo, max(value) AS hi FROM l GROUP BY 1), c AS (SELECT feature_index, feature, least(floor((value - lo) / (hi - lo) * 5), 4) AS bin, label, count(*) AS n FROM l JOIN m USING (feature_index) GROUP BY 1, 2, 3, 4),
 t AS (SELECT *, sum(n) OVER (PARTITION BY feature_index, bin) AS a, sum(n) OVER (PARTITION BY feature_index, label) AS b, sum(n) OVER (PARTITION BY feature_index) AS total FROM c) SELECT feature_index, feature, greatest(sum(n / total * log2(n * total / (a * b))), 0.0) AS mutual_information FROM t GROUP BY 1, 2 ORDER BY mutual_information DESC, feature_index LIMIT 2""", "mutual_information", "l",
)
R.add("p3_quadratic_features", lambda s, d: E(s, d).select("row_id", *[c.alias(n) for n, c in P.quadratic(X).items()]), "SELECT row_id, x1, x2, x3, x1 * x1 AS x1_sq, x2 * x2 AS x2_sq, x3 * x3 AS x3_sq, x1 * x2 AS x1_x2, x1 * x3 AS x1_x3, x2 * x3 AS x2_x3 FROM e", "x1 x2 x3 x1_sq x2_sq x3_sq x1_x2 x1_x3 x2_x3")
_RFF = ", ".join(
    f"cos({b!r}::DOUBLE + " + " + ".join(f"{f} * {v!r}::DOUBLE" for f, v in zip(X, w, strict=True)) + f") * sqrt(0.5) AS rff{i}" for i, (w, b) in enumerate(P.fourier_weights(3, 4, 0.01))
)
R.add("p3_fourier_features", lambda s, d: E(s, d).select("row_id", *[c.alias(n) for n, c in P.fourier(X, 4, 0.01).items()]), f"SELECT row_id, {_RFF} FROM e", "rff0 rff1 rff2 rff3")


def _ranks_sql(salt: str) -> str:
    return f"rk AS (SELECT row_id, label, row_number() OVER (PARTITION BY label ORDER BY {uniform_sql('row_id', 42, repr(salt))}, row_id) AS r, count(*) OVER (PARTITION BY label) AS n FROM e)"


_CUT = lambda f, lo, hi: f"greatest({lo}, least(round_even(n * {f}, 0), n - {hi}))"
R.add("p4_train_validation_split", lambda s, d: P.stratified_split(E(s, d), {"train": 0.7, "validation": 0.3}).select("row_id", "label", "split"), f"WITH {_ranks_sql('split')} SELECT row_id, label, CASE WHEN r <= {_CUT(0.7, 1, 1)} THEN 'train' ELSE 'validation' END AS split FROM rk")
R.add(
    "p5_three_way_split", lambda s, d: P.stratified_split(E(s, d), {"train": 0.6, "calibration": 0.2, "validation": 0.2}).groupBy("label", "split").agg(F.count("*").alias("n"), F.sum("row_id").alias("ids")),
    f"WITH {_ranks_sql('split')}, q AS (SELECT row_id, label, CASE WHEN r <= {_CUT(0.6, 1, 2)} THEN 'train' WHEN r <= {_CUT(0.8, 2, 1)} THEN 'calibration' ELSE 'validation' END AS split FROM rk) SELECT label, split, count(*) AS n, CAST(sum(row_id) AS BIGINT) AS ids FROM q GROUP BY 1, 2",
)
R.add("p6_folds", lambda s, d: P.folds(E(s, d)).select("row_id", "label", "fold"), f"WITH {_ranks_sql('fold')} SELECT row_id, label, CAST((r - 1) % 5 AS INT) AS fold FROM rk")
CAL_SQL = f"{_ranks_sql('calibration')}, sides AS (SELECT row_id, label, CASE WHEN r <= {_CUT(0.5, 1, 1)} THEN 'calibration' ELSE 'evaluation' END AS side FROM rk)"
R.add("p7_calibration_split", lambda s, d: P.calibration_split(E(s, d)).select("row_id", "label", "side", "split_source"), f"WITH {CAL_SQL} SELECT *, 'stratified' AS split_source FROM sides")
_TIME = lambda: F.unix_micros("ts")
R.add("p8_order_split", lambda s, d: P.order_split(E(s, d), _TIME()).select("row_id", "order_index", "side"), "SELECT row_id, order_index, CASE WHEN order_index < greatest(2, least(round_even(n * 0.5, 0), n - 2)) THEN 'reference' ELSE 'current' END AS side FROM (SELECT row_id, row_number() OVER (ORDER BY ts, row_id) - 1 AS order_index, count(*) OVER () AS n FROM e)")
R.add("p9_even_sample", lambda s, d: P.even_sample(E(s, d), _TIME(), 64).select("row_id"), "WITH o AS (SELECT row_id, row_number() OVER (ORDER BY ts, row_id) - 1 AS i, count(*) OVER () AS n FROM e) SELECT row_id FROM o WHERE i IN (SELECT floor(k * ((SELECT count(*) FROM e) - 1) / 63) FROM range(64) r(k))")
R.add("p10_class_weights", lambda s, d: P.class_weights(E(s, d)), "SELECT label, count(*) AS count, (SELECT count(*) FROM e) / (2 * count(*)) AS weight FROM e GROUP BY label", "weight")

CONF_SQL = f"""{CAL_SQL}, cal AS (SELECT e.label, p FROM e JOIN sides USING (row_id) WHERE side = 'calibration'), ev AS (SELECT e.label, p FROM e JOIN sides USING (row_id) WHERE side = 'evaluation'), al AS (SELECT unnest([0.05, 0.1, 0.2, 0.3]::DOUBLE[]) AS alpha),
 so AS (SELECT list_sort(list({{score}})) AS v FROM cal), qs AS (SELECT alpha, v[CAST(least(greatest(ceil((len(v) + 1) * (1 - alpha)), 1), len(v)) AS BIGINT)] AS quantile FROM al, so)"""
_SETS = """SELECT alpha, quantile, count(*) AS n, avg((CASE WHEN label = 1 THEN in1 ELSE in0 END)::INT) AS coverage, avg((in0::INT + in1::INT = 1)::INT) AS singleton_rate, avg((in0 AND in1)::INT) AS both_rate, avg((NOT in0 AND NOT in1)::INT) AS empty_rate, avg(in0::INT + in1::INT) AS average_size,
 coalesce(avg(in0::INT) FILTER (label = 0), 0.0) AS coverage_0, coalesce(avg(in1::INT) FILTER (label = 1), 0.0) AS coverage_1 FROM z GROUP BY alpha, quantile"""
_SWEEP = f"{CONF_SQL.format(score='CASE WHEN label = 1 THEN 1 - p ELSE p END')}, z AS (SELECT *, p <= quantile AS in0, 1 - p <= quantile AS in1 FROM ev, qs), sw AS ({_SETS})"
_SWD = "alpha quantile coverage singleton_rate both_rate empty_rate average_size coverage_0 coverage_1"


def _sides(s, d):
    e = P.calibration_split(E(s, d))
    return e.where("side = 'calibration'"), e.where("side = 'evaluation'")


R.add("u1_u4_conformal_sweep", lambda s, d: U.conformal_sweep(*_sides(s, d)), f"WITH {_SWEEP} SELECT * FROM sw", _SWD)
R.add("u4_recommended_alpha", lambda s, d: U.recommended_alpha(U.conformal_sweep(*_sides(s, d))), f"WITH {_SWEEP} SELECT alpha, round(coverage - (1 - alpha), 12) >= 0 AS keeps_coverage FROM sw ORDER BY round(coverage - (1 - alpha), 12) >= 0 DESC, CASE WHEN round(coverage - (1 - alpha), 12) >= 0 THEN average_size ELSE (1 - alpha) - coverage END, CASE WHEN round(coverage - (1 - alpha), 12) >= 0 THEN -singleton_rate ELSE average_size END, alpha LIMIT 1", "alpha")
R.add("u2_conformal_sets", lambda s, d: E(s, d).select("row_id", U.conformal_set(F.col("p"), F.lit(0.55)).alias("label_set")), "SELECT row_id, CASE WHEN p <= 0.55 AND 1 - p <= 0.55 THEN '{0,1}' WHEN p <= 0.55 THEN '{0}' WHEN 1 - p <= 0.55 THEN '{1}' ELSE 'abstain' END AS label_set FROM e")
R.add(
    "u3_aps_sweep", lambda s, d: U.aps_sweep(*_sides(s, d)),
    f"WITH {CONF_SQL.format(score='CASE WHEN label = (p > 0.5)::INT THEN greatest(p, 1 - p) ELSE 1.0::DOUBLE END')}, z AS (SELECT *, greatest(p, 1 - p) < quantile OR p <= 0.5 AS in0, greatest(p, 1 - p) < quantile OR p > 0.5 AS in1 FROM ev, qs), sw AS ({_SETS}) SELECT * FROM sw", _SWD,
)
_B1_MEANS = " UNION ALL ".join(f"SELECT '{c}' AS cell, {c}::DOUBLE AS mean FROM o" for c in ("tp", "fp", "tn", "fn"))
_B1 = ", ".join(f"max(n) FILTER (cell = '{c}') AS {c}" for c in ("tp", "fp", "tn", "fn"))
R.add(
    "b1_bootstrap_intervals", lambda s, d: U.bootstrap_intervals(E(s, d)),
    f"""WITH o AS (SELECT {confusion_sql()} FROM e), {poisson_tables_sql('pt', _B1_MEANS, 'cell')}, u AS (SELECT rep, cell, {uniform_sql('rep', 42, "'ci' || cell")} AS u FROM range(1000) r(rep), (SELECT DISTINCT cell FROM pt)),
 dr AS (SELECT rep, u.cell, least(any_value(lo) + count(*) FILTER (cdf < u), any_value(hi)) AS n FROM u JOIN pt ON pt.cell = u.cell GROUP BY 1, 2), c AS (SELECT rep, {_B1} FROM dr GROUP BY rep), m AS (SELECT {rates_sql()} FROM c)
 SELECT 'f1' AS metric, quantile_cont(f1, 0.025) AS low, quantile_cont(f1, 0.975) AS high, avg(f1) AS mean FROM m UNION ALL SELECT 'accuracy', quantile_cont(accuracy, 0.025), quantile_cont(accuracy, 0.975), avg(accuracy) FROM m UNION ALL SELECT 'balanced_accuracy', quantile_cont(balanced_accuracy, 0.025), quantile_cont(balanced_accuracy, 0.975), avg(balanced_accuracy) FROM m""",
    "low high mean",
)
R.add(
    "b2_permutation_null", lambda s, d: U.permutation_null(E(s, d)),
    f"""WITH o AS (SELECT count(*)::DOUBLE AS n, sum(label)::DOUBLE AS np, sum((p >= 0.5)::INT)::DOUBLE AS k, sum((p >= 0.5 AND label = 1)::INT)::DOUBLE AS tp FROM e),
 b AS (SELECT *, greatest(0, k + np - n, floor(k * np / n - r))::BIGINT AS lo, least(k, np, ceil(k * np / n + r))::BIGINT AS hi FROM (SELECT *, 12 * sqrt(k * np * (n - k) * (n - np) / (n * n * (n - 1))) + 12 AS r FROM o)),
 w AS (SELECT x, lo, hi, tp, exp(s - max(s) OVER ()) AS w FROM (SELECT *, sum(CASE WHEN x > lo THEN ln((np - x + 1) * (k - x + 1) / (x * (n - np - k + x))) ELSE 0.0 END) OVER (ORDER BY x) AS s FROM (SELECT *, unnest(range(lo, hi + 1)) AS x FROM b))),
 t AS (SELECT *, sum(w) OVER (ORDER BY x) / sum(w) OVER () AS cdf FROM w), ex AS (SELECT 1 - coalesce(max(cdf) FILTER (x < tp), 0.0) AS exact_p FROM t),
 d AS (SELECT rep, 2 * any_value(o.tp) / any_value(k + np) AS observed, 2 * least(any_value(lo) + count(*) FILTER (cdf < u), any_value(hi)) / any_value(k + np) AS nf FROM (SELECT rep, {uniform_sql('rep', 42, "'null'")} AS u FROM range(200) r(rep)), t, o GROUP BY rep),
 q AS (SELECT max(observed) AS observed_f1, avg(nf) AS null_mean, stddev_pop(nf) AS null_std, quantile_cont(nf, 0.05) AS null_q05, quantile_cont(nf, 0.5) AS null_q50, quantile_cont(nf, 0.95) AS null_q95, (count(*) FILTER (round(nf - observed, 12) >= 0) + 1) / (count(*) + 1) AS p_value FROM d)
 SELECT *, (SELECT exact_p FROM ex) AS exact_p, CASE WHEN null_std < 1e-9 THEN 0.0 ELSE (observed_f1 - null_mean) / null_std END AS z, CASE WHEN observed_f1 <= null_mean THEN 'no_observed_lift' WHEN p_value <= 0.01 THEN 'strong_signal' WHEN p_value <= 0.05 THEN 'signal' WHEN p_value <= 0.1 THEN 'weak_signal' ELSE 'not_significant' END AS verdict FROM q""",
    "observed_f1 null_mean null_std null_q05 null_q50 null_q95 p_value exact_p z",
)
DRIFT_SQL = f"{STD_SQL}, zz AS (SELECT row_id, {_Z} FROM e), dr AS (SELECT row_id, sqrt((x1 * x1 + x2 * x2 + x3 * x3) / 3) AS drift, greatest(abs(x1), abs(x2), abs(x3)) AS max_z, (greatest(abs(x1), abs(x2), abs(x3)) >= 3)::INT AS ood FROM zz)"
R.add("n5_row_drift", lambda s, d: U.row_drift(E(s, d), P.fit_standardizer(E(s, d), X), X).select("row_id", "drift", "max_z", "ood"), f"WITH {DRIFT_SQL} SELECT * FROM dr", "drift max_z", "l")
Q_SQL = f"""{DRIFT_SQL}, a AS (SELECT e.row_id, p, label, drift, max_z, ood, (p >= 0.5)::INT AS predicted_label, CASE WHEN p >= 0.5 THEN p ELSE 1 - p END AS confidence, 1 - least(abs(p - 0.5) / 0.5, 1.0) AS uncertainty,
 CASE WHEN p <= 0.55 AND 1 - p <= 0.55 THEN '{{0,1}}' WHEN p <= 0.55 THEN '{{0}}' WHEN 1 - p <= 0.55 THEN '{{1}}' ELSE 'abstain' END AS conformal_set FROM e JOIN dr USING (row_id)),
 b AS (SELECT *, round(least(greatest((CASE conformal_set WHEN 'abstain' THEN greatest(uncertainty, 1.0) WHEN '{{0,1}}' THEN greatest(uncertainty, 0.9) ELSE uncertainty END) * exp(-0.15 * drift * drift) * (CASE WHEN ood = 1 THEN 0.5 ELSE 1.0 END), 0.0), 1.0), 9) AS query_score,
 CASE WHEN ood = 1 OR conformal_set IN ('{{0,1}}', 'abstain') OR uncertainty >= 0.8 THEN 'high' WHEN uncertainty >= 0.6 THEN 'medium' ELSE 'low' END AS review_priority FROM a)
 SELECT row_id, predicted_label, confidence, uncertainty, conformal_set, drift, ood, query_score, review_priority, row_number() OVER (ORDER BY query_score DESC, row_id) AS query_rank FROM b"""
R.add("q1_review_scores", lambda s, d: U.review_scores(E(s, d), P.fit_standardizer(E(s, d), X), X, 0.55).select("row_id", "predicted_label", "confidence", "uncertainty", "conformal_set", "drift", "ood", "query_score", "review_priority", "query_rank"), f"WITH {Q_SQL}", "confidence uncertainty drift query_score", "l")
_SHEET = lambda s, d: S.review_sheet(U.review_scores(E(s, d), P.fit_standardizer(E(s, d), X), X, 0.55), X).withColumn("review_label", F.coalesce("review_label", F.lit(""))).withColumns({c: F.col(c).cast("decimal(20,8)").cast("string") for c in ("confidence", "uncertainty", "drift")}).drop("query_score")
R.add(
    "s4_review_sheet", _SHEET,
    f"WITH {Q_SQL.split(' SELECT row_id, predicted_label')[0]} SELECT row_id, x1, x2, x3, predicted_label, confidence::DECIMAL(20,8)::VARCHAR AS confidence, uncertainty::DECIMAL(20,8)::VARCHAR AS uncertainty, conformal_set, b.drift::DECIMAL(20,8)::VARCHAR AS drift, b.ood, row_number() OVER (ORDER BY b.query_score DESC, row_id) AS query_rank, review_priority, '' AS review_label FROM b JOIN (SELECT row_id, x1, x2, x3 FROM e) USING (row_id)",
    "x1 x2 x3", "l",
)
