"""Queries of dataset audits and contracts."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugework.operators import profile as P
from gaugework.plans.registry import Registry
from gaugework.plans.tables import FEATURES as X
from gaugework.plans.tables import event_examples as E
from gaugework.plans.tables import ratio_sql

R = Registry()

BALANCE_SQL = f"bal AS (SELECT *, {ratio_sql('least(n0, n1)', 'n')} AS minority_fraction, greatest(n0, n1) / greatest(least(n0, n1), 1) AS imbalance_ratio FROM (SELECT count(*) AS n, count(*) FILTER (label = 0) AS n0, count(*) FILTER (label = 1) AS n1 FROM e))"
GROUPS_SQL = "grp AS (SELECT round({0}, 8) AS {0}, round({1}, 8) AS {1}, count(*) AS count, min(label) <> max(label) AS conflict FROM e GROUP BY 1, 2)"
DUP_SQL = "dup AS (SELECT CAST(coalesce(sum(count - 1), 0) AS BIGINT) AS duplicate_rows, count(*) FILTER (conflict) AS conflict_groups, CAST(coalesce(sum(count) FILTER (conflict), 0) AS BIGINT) AS conflicting_rows FROM grp)"
CORR_SQL = "cor AS (SELECT 'x1' AS \"left\", 'x2' AS \"right\", corr(x1, x2) AS correlation FROM e UNION ALL SELECT 'x1', 'x3', corr(x1, x3) FROM e UNION ALL SELECT 'x2', 'x3', corr(x2, x3) FROM e)"

R.add("a1_class_balance", lambda s, d: P.class_balance(E(s, d), ["segment"]), f"SELECT *, {ratio_sql('least(n0, n1)', 'n')} AS minority_fraction, greatest(n0, n1) / greatest(least(n0, n1), 1) AS imbalance_ratio FROM (SELECT segment, count(*) AS n, count(*) FILTER (label = 0) AS n0, count(*) FILTER (label = 1) AS n1 FROM e GROUP BY segment)", "minority_fraction imbalance_ratio")
R.add(
    "a2_duplicate_groups", lambda s, d: P.duplicate_groups(E(s, d), ["x2", "x3"]),
    f"""WITH {GROUPS_SQL.format('x2', 'x3')}, best AS (SELECT * FROM grp WHERE count > 1 ORDER BY count DESC, x2, x3 LIMIT 20),
 m AS (SELECT b.x2, b.x3, row_id, row_number() OVER (PARTITION BY b.x2, b.x3 ORDER BY row_id) AS nth FROM e JOIN best b ON e.x2 = b.x2 AND e.x3 = b.x3)
 SELECT b.*, f.first_rows FROM best b JOIN (SELECT x2, x3, string_agg(row_id::VARCHAR, ',' ORDER BY row_id) AS first_rows FROM m WHERE nth <= 5 GROUP BY 1, 2) f USING (x2, x3)""",
    "x2 x3",
)
R.add("a2_a3_duplicate_summary", lambda s, d: P.duplicate_summary(E(s, d), ["x1", "x3"]), f"WITH {GROUPS_SQL.format('x1', 'x3')}, {DUP_SQL} SELECT * FROM dup")
R.add(
    "a4_constant_features", lambda s, d: P.constant_features(E(s, d).withColumn("x0", F.lit(3.5)), ["x0", *X]), "SELECT CAST(0 AS INT) AS feature_index, 'x0' AS feature, CAST(3.5 AS DOUBLE) AS value UNION ALL SELECT feature_index, feature, min(value) FROM l GROUP BY 1, 2 HAVING stddev_pop(value) < 1e-8", "value", "l"
)
R.add("a5_correlations", lambda s, d: P.correlations(E(s, d), X, 0.0), f"WITH {CORR_SQL} SELECT * FROM cor ORDER BY abs(correlation) DESC LIMIT 12", "correlation")
R.add(
    "a6_audit", lambda s, d: P.audit(E(s, d), X),
    f"""WITH {BALANCE_SQL}, grp AS (SELECT count(*) AS count, min(label) <> max(label) AS conflict FROM e GROUP BY round(x1, 8), round(x2, 8), round(x3, 8)), {DUP_SQL}, {CORR_SQL},
 k AS (SELECT count(*) AS constant_features FROM (SELECT feature FROM l GROUP BY feature HAVING stddev_pop(value) < 1e-8)), h AS (SELECT count(*) AS high_correlations FROM cor WHERE abs(correlation) >= 0.95)
 SELECT *, array_to_string(list_sort(list_filter([CASE WHEN n < 20 THEN 'very_small_dataset' END, CASE WHEN least(n0, n1) = 0 THEN 'missing_one_class' END, CASE WHEN least(n0, n1) > 0 AND imbalance_ratio >= 4 THEN 'strong_class_imbalance' END,
 CASE WHEN duplicate_rows > 0 THEN 'duplicates' END, CASE WHEN conflict_groups > 0 THEN 'conflicts' END, CASE WHEN constant_features > 0 THEN 'constants' END, CASE WHEN high_correlations > 0 THEN 'high_correlation' END], lambda x: x IS NOT NULL)), ',') AS warnings FROM bal, dup, k, h""",
    "minority_fraction imbalance_ratio", "l",
)

_Q = ", ".join(f"quantile_cont(value, {v}) AS {k}" for k, v in P.QUANTILES.items())
CONTRACT_SQL = f"""b0 AS (SELECT feature_index, feature, count(*) AS n, min(value) AS min, max(value) AS max, avg(value) AS mean, stddev_pop(value) AS std, {_Q} FROM l GROUP BY 1, 2),
 md AS (SELECT feature_index, quantile_cont(abs(value - median), 0.5) AS mad FROM l JOIN b0 USING (feature_index) GROUP BY 1),
 b1 AS (SELECT b0.*, mad, q75 - q25 AS iqr, greatest(CASE WHEN mad > 1e-12 THEN 1.4826 * mad WHEN q75 - q25 > 1e-12 THEN (q75 - q25) / 1.349 ELSE std END, 1e-12) AS scale FROM b0 JOIN md USING (feature_index)),
 b2 AS (SELECT *, median - 6 * scale AS robust_lower, median + 6 * scale AS robust_upper, q01 AS soft_lower, q99 AS soft_upper FROM b1),
 sn AS (SELECT feature_index, count(DISTINCT value) AS unique_count, count(*) FILTER (value < robust_lower OR value > robust_upper) AS outlier_count, count(*) FILTER (value < soft_lower OR value > soft_upper) AS soft_outlier_count FROM l JOIN b2 USING (feature_index) GROUP BY 1),
 ob AS (SELECT feature_index, list_sort(list(DISTINCT value)) AS observed_values FROM l JOIN sn USING (feature_index) WHERE unique_count <= 20 GROUP BY 1),
 b3 AS (SELECT b2.* EXCLUDE (scale), unique_count, outlier_count, soft_outlier_count, observed_values, unique_count / n AS unique_ratio, (std <= 1e-12 OR min = max) AS f_con FROM b2 JOIN sn USING (feature_index) LEFT JOIN ob USING (feature_index)),
 b4 AS (SELECT *, NOT f_con AND (unique_count <= least(3, greatest(2, floor(n / 20))) OR unique_ratio <= 0.03) AS f_near, (unique_count <= 4 OR (unique_count <= least(20, greatest(4, floor(n / 4))) AND unique_ratio <= 0.2)) AS f_low, outlier_count > 0 AS f_rob,
  soft_outlier_count >= greatest(2, ceil(0.02 * n)) AS f_tail, (iqr <= 1e-12 AND mad <= 1e-12 AND std > 1e-12) AS f_spk FROM b3),
 contract AS (SELECT * EXCLUDE (f_con, f_near, f_low, f_rob, f_tail, f_spk), array_to_string(list_sort(list_filter([CASE WHEN f_con THEN 'constant' END, CASE WHEN f_near THEN 'near_constant' END, CASE WHEN f_low THEN 'low_cardinality' END, CASE WHEN f_rob THEN 'robust_range_outliers' END,
  CASE WHEN f_tail THEN 'heavy_tail' END, CASE WHEN f_spk THEN 'mostly_constant_with_spikes' END], lambda x: x IS NOT NULL)), ',') AS risk_flags,
  32.0 * f_con::INT + 18.0 * f_near::INT + 10.0 * f_low::INT + (CASE WHEN f_rob THEN least(24.0, 8 + 80 * outlier_count / n) ELSE 0 END) + 8.0 * f_tail::INT + 16.0 * f_spk::INT AS risk_score FROM b4)"""
_CONTRACT = lambda s, d: P.feature_contract(E(s, d), X)
R.add(
    "a7_feature_contract", lambda s, d: _CONTRACT(s, d).withColumn("observed_values", F.array_join(F.transform("observed_values", lambda v: v.cast("long").cast("string")), ",")),
    f"WITH {CONTRACT_SQL} SELECT * REPLACE (array_to_string(list_transform(observed_values, lambda v: v::BIGINT::VARCHAR), ',') AS observed_values) FROM contract",
    "min max mean std q01 q05 q25 median q75 q95 q99 mad iqr robust_lower robust_upper soft_lower soft_upper unique_ratio risk_score", "l",
)
_HAS = lambda f: f"count(*) FILTER (list_contains(string_split(risk_flags, ','), '{f}'))"
R.add(
    "a8_contract_readiness", lambda s, d: P.contract_readiness(_CONTRACT(s, d)),
    f"""WITH {CONTRACT_SQL}, c AS (SELECT count(*) AS features, max(n) AS n, {_HAS('constant')} AS constant, {_HAS('near_constant')} AS near_constant, {_HAS('low_cardinality')} AS low_cardinality, {_HAS('robust_range_outliers')} AS outlier, {_HAS('mostly_constant_with_spikes')} AS spike FROM contract),
 r AS (SELECT *, greatest(0, 100 - (14 * constant + 8 * near_constant + 4 * low_cardinality + 8 * outlier + 10 * spike + CASE WHEN n < 20 THEN 8 ELSE 0 END)) AS readiness FROM c)
 SELECT *, CASE WHEN readiness < 65 OR constant >= 2 OR spike >= 2 THEN 'high' WHEN readiness < 84 OR constant > 0 OR outlier > 0 THEN 'medium' ELSE 'low' END AS risk FROM r""", "", "l",
)


def _new_rows(s, d):
    return E(s, d).where("ts >= '2024-01-16'").withColumn("x1", F.col("x1") * 1.02).withColumn("x3", F.when(F.col("row_id") % 50 == 0, 4.5).otherwise(F.col("x3")))


def _old_contract(s, d):
    return P.feature_contract(E(s, d).where("ts < '2024-01-16'"), X)


CHECK_SQL = CONTRACT_SQL.replace(" FROM l ", " FROM lo ").replace("b0 AS", "lo AS (SELECT * FROM l WHERE ts < TIMESTAMP '2024-01-16'), b0 AS", 1) + """,
 nw AS (SELECT row_id, feature_index, feature, CASE WHEN feature = 'x1' THEN value * 1.02 WHEN feature = 'x3' AND row_id % 50 = 0 THEN 4.5 ELSE value END AS value FROM l WHERE ts >= TIMESTAMP '2024-01-16'),
 j AS (SELECT row_id, nw.feature, value, (value < min OR value > max) AS hard, (value < soft_lower OR value > soft_upper) AS soft, (list_contains(string_split(risk_flags, ','), 'low_cardinality') AND observed_values IS NOT NULL AND NOT coalesce(list_bool_or(list_transform(observed_values, lambda o: abs(o - value) <= 1e-9)), false)) AS unseen FROM nw JOIN contract USING (feature_index)),
 issues AS (SELECT row_id, feature, value, 'outside_range' AS issue, 'fail' AS severity FROM j WHERE hard UNION ALL SELECT row_id, feature, value, 'outside_soft_range', 'warn' FROM j WHERE soft AND NOT hard UNION ALL SELECT row_id, feature, value, 'unseen_value', 'fail' FROM j WHERE unseen)"""
R.add("a9_contract_issues", lambda s, d: P.check_contract(_new_rows(s, d), _old_contract(s, d), X), f"WITH {CHECK_SQL} SELECT * FROM issues", "value", "l")
R.add(
    "a9_contract_status", lambda s, d: P.contract_status(_new_rows(s, d), _old_contract(s, d), X),
    f"""WITH {CHECK_SQL}, f AS (SELECT row_id, feature, bool_or(severity = 'fail') AS fails FROM issues GROUP BY 1, 2), g AS (SELECT row_id, count(*) FILTER (fails) AS failures, count(*) FILTER (NOT fails) AS warnings FROM f GROUP BY 1)
 SELECT r.row_id, coalesce(failures, 0) AS failures, coalesce(warnings, 0) AS warnings, CASE WHEN failures > 0 THEN 'fail' WHEN warnings > 0 THEN 'warn' ELSE 'pass' END AS status FROM (SELECT DISTINCT row_id FROM nw) r LEFT JOIN g USING (row_id)""", "", "l",
)
SEP_SQL = """mo AS (SELECT feature_index, feature, count(*) AS n, CAST(sum(label) AS BIGINT) AS n1, CAST(sum(1 - label) AS BIGINT) AS n0, avg(value) FILTER (label = 0) AS mean0, avg(value) FILTER (label = 1) AS mean1, stddev_pop(value) FILTER (label = 0) AS std0, stddev_pop(value) FILTER (label = 1) AS std1 FROM l GROUP BY 1, 2),
 vc AS (SELECT feature_index, value, sum(label) AS pos, sum(1 - label) AS neg FROM l GROUP BY 1, 2),
 sp AS (SELECT vc.*, sum(pos) OVER w AS p, sum(neg) OVER w AS q FROM vc WINDOW w AS (PARTITION BY feature_index ORDER BY value)),
 au AS (SELECT feature_index, sum(pos * (q - neg + 0.5 * neg)) / (any_value(n0) * any_value(n1)) AS raw, count(*) AS unique_count FROM sp JOIN mo USING (feature_index) GROUP BY 1),
 cu AS (SELECT feature_index, value AS after, p, q FROM sp UNION ALL SELECT feature_index, NULL, 0, 0 FROM mo),
 ev AS (SELECT feature_index, after, n0, n1, CASE WHEN raw >= 0.5 THEN n1 - p ELSE p END AS tp, CASE WHEN raw >= 0.5 THEN q ELSE n0 - q END AS tn FROM cu JOIN au USING (feature_index) JOIN mo USING (feature_index)),
 rk AS (SELECT feature_index, after, round((tp / n1 + tn / n0) / 2, 12) AS ba, round((tp + tn) / (n0 + n1), 12) AS ac FROM ev),
 tb AS (SELECT feature_index, ba AS balanced_accuracy, ac AS accuracy, after AS split_after FROM rk QUALIFY row_number() OVER (PARTITION BY feature_index ORDER BY ba DESC, ac DESC, after NULLS FIRST) = 1),
 s1 AS (SELECT feature_index, feature, n, mean0, mean1, std0, std1, unique_count, balanced_accuracy, accuracy, split_after, abs(mean1 - mean0) / greatest(sqrt((std0 * std0 + std1 * std1) / 2), 1e-12) AS effect, greatest(raw, 1 - raw) AS auc, CASE WHEN raw >= 0.5 THEN 'positive_high' ELSE 'positive_low' END AS direction, unique_count / n AS unique_ratio FROM mo JOIN au USING (feature_index) JOIN tb USING (feature_index)),
 sep AS (SELECT *, least(greatest(0.5 * (auc - 0.5) / 0.5 + 0.3 * (balanced_accuracy - 0.5) / 0.5 + 0.2 * least(effect / 3, 1.0), 0.0), 1.0) AS score, array_to_string(list_sort(list_filter([CASE WHEN balanced_accuracy >= 0.98 AND auc >= 0.99 THEN 'near_perfect' END,
  CASE WHEN NOT (balanced_accuracy >= 0.98 AND auc >= 0.99) AND auc >= 0.85 THEN 'strong' END, CASE WHEN auc <= 0.58 AND balanced_accuracy <= 0.62 THEN 'weak' END, CASE WHEN unique_ratio <= 0.1 AND balanced_accuracy >= 0.9 THEN 'shortcut' END], lambda x: x IS NOT NULL)), ',') AS flags FROM s1)"""
R.add("a10_separability", lambda s, d: P.separability(E(s, d), X), f"WITH {SEP_SQL} SELECT * FROM sep", "mean0 mean1 std0 std1 balanced_accuracy accuracy split_after effect auc unique_ratio score", "l")
R.add(
    "a11_redundant_pairs", lambda s, d: P.redundant_pairs(E(s, d), X, 0.001),
    f"WITH {SEP_SQL}, {CORR_SQL} SELECT c.\"left\", c.\"right\", correlation, least(a.score, b.score) AS min_score, least(a.score, b.score) >= 0.7 AS strong FROM cor c JOIN sep a ON a.feature = c.\"left\" JOIN sep b ON b.feature = c.\"right\" WHERE abs(correlation) >= 0.001", "correlation min_score", "l",
)
R.add(
    "a12_mutual_information", lambda s, d: P.mutual_information(E(s, d), X),
    """WITH m AS (SELECT feature_index, min(value) AS lo, max(value) AS hi FROM l GROUP BY 1), c AS (SELECT feature_index, feature, least(floor((value - lo) / (hi - lo) * 5), 4) AS bin, label, count(*) AS n FROM l JOIN m USING (feature_index) GROUP BY 1, 2, 3, 4),
 t AS (SELECT *, sum(n) OVER (PARTITION BY feature_index, bin) AS a, sum(n) OVER (PARTITION BY feature_index, label) AS b, sum(n) OVER (PARTITION BY feature_index) AS total FROM c) SELECT feature_index, feature, greatest(sum(n / total * log2(n * total / (a * b))), 0.0) AS mutual_information FROM t GROUP BY 1, 2""", "mutual_information", "l",
)
R.add("a13_label_correlation", lambda s, d: P.label_correlation(E(s, d), X), "SELECT feature_index, feature, coalesce(corr(value, label), 0.0) AS correlation FROM l GROUP BY 1, 2", "correlation", "l")
R.add(
    "a14_error_shifts", lambda s, d: P.error_shifts(E(s, d), X),
    "SELECT feature_index, feature, avg(value) FILTER ((p >= 0.5) <> (label = 1)) AS error_mean, avg(value) FILTER ((p >= 0.5) = (label = 1)) AS correct_mean, (avg(value) FILTER ((p >= 0.5) <> (label = 1)) - avg(value) FILTER ((p >= 0.5) = (label = 1))) / stddev_pop(value) AS shift FROM l GROUP BY 1, 2", "error_mean correct_mean shift", "l",
)
