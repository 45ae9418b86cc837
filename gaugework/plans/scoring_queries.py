"""Queries of evaluation metrics and sweeps."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugework.operators import metrics as M
from gaugework.operators import sweeps as S
from gaugework.plans.registry import Registry
from gaugework.plans.laws import poisson_tables_sql
from gaugework.plans.tables import confusion_sql, event_examples, rates_sql, ratio_sql, uniform_sql

R = Registry()
E = event_examples
RATES = "accuracy precision recall f1 balanced_accuracy"

PROB_SQL = """avg((p - label) * (p - label)) AS brier,
 avg(-(label * ln(least(greatest(p, 1e-7), 1 - 1e-7)) + (1 - label) * ln(1 - least(greatest(p, 1e-7), 1 - 1e-7)))) AS log_loss,
 avg(p) AS mean_p, avg(label::DOUBLE) AS prevalence, avg((p >= 0.5)::INT::DOUBLE) AS predicted_positive_rate"""

#: One row for each distinct score: rows there, and at or above it.
STEPS_SQL = """steps AS (SELECT t, pos, neg, CAST(sum(pos) OVER w AS BIGINT) AS tp, CAST(sum(neg) OVER w AS BIGINT) AS fp,
 CAST(sum(pos) OVER () AS BIGINT) AS n_pos, CAST(sum(neg) OVER () AS BIGINT) AS n_neg
 FROM (SELECT p AS t, sum(label) AS pos, sum(1 - label) AS neg FROM e GROUP BY p) WINDOW w AS (ORDER BY t DESC))"""

R.add("e1_confusion", lambda s, d: M.confusion(E(s, d), 0.5), f"SELECT *, {rates_sql()} FROM (SELECT count(*) AS n, {confusion_sql()} FROM e)", RATES)
R.add("e1_confusion_by_segment", lambda s, d: M.confusion(E(s, d), 0.4, ["segment"]), f"SELECT *, {rates_sql()} FROM (SELECT segment, count(*) AS n, {confusion_sql('0.4')} FROM e GROUP BY segment)", RATES)
R.add("e2_probability_metrics", lambda s, d: M.probability_metrics(E(s, d), ["segment"]), f"SELECT segment, count(*) AS n, {PROB_SQL} FROM e GROUP BY segment", "brier log_loss mean_p prevalence predicted_positive_rate")
R.add(
    "e3_e4_ranking_metrics", lambda s, d: M.ranking_metrics(E(s, d)),
    f"WITH {STEPS_SQL} SELECT sum(pos * (n_neg - fp + 0.5 * neg)) / (max(n_pos) * max(n_neg)) AS roc_auc, sum(pos * tp::DOUBLE / (tp + fp)) / max(n_pos) AS average_precision FROM steps",
    "roc_auc average_precision",
)
R.add(
    "e3_ranking_by_segment", lambda s, d: M.ranking_metrics(E(s, d), ["segment"]),
    """WITH steps AS (SELECT segment, t, pos, neg, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY segment) AS n_pos, sum(neg) OVER (PARTITION BY segment) AS n_neg
 FROM (SELECT segment, p AS t, sum(label) AS pos, sum(1 - label) AS neg FROM e GROUP BY segment, p) WINDOW w AS (PARTITION BY segment ORDER BY t DESC))
 SELECT segment, sum(pos * (n_neg - fp + 0.5 * neg)) / (max(n_pos) * max(n_neg)) AS roc_auc, sum(pos * tp::DOUBLE / (tp + fp)) / max(n_pos) AS average_precision FROM steps GROUP BY segment""",
    "roc_auc average_precision",
)
BINS_SQL = "bins AS (SELECT bin, count, confidence, accuracy, count / sum(count) OVER () AS weight FROM (SELECT CAST(least(floor(p * 10), 9) AS INT) AS bin, count(*) AS count, avg(p) AS confidence, avg(label::DOUBLE) AS accuracy FROM e GROUP BY 1))"
R.add("e5_calibration_bins", lambda s, d: M.calibration_bins(E(s, d)), f"WITH {BINS_SQL} SELECT * FROM bins", "confidence accuracy weight")
R.add("e5_calibration_error", lambda s, d: M.calibration_error(E(s, d)), f"WITH {BINS_SQL} SELECT sum(weight * abs(accuracy - confidence)) AS ece, max(abs(accuracy - confidence)) AS max_error, count(*) AS bins FROM bins", "ece max_error")
R.add("e6_class_quantiles", lambda s, d: M.class_quantiles(E(s, d)), "SELECT label, " + ", ".join(f"quantile_cont(p, {q / 100}) AS q{q}" for q in (0, 25, 50, 75, 100)) + " FROM e GROUP BY label", "q0 q25 q50 q75 q100")
R.add(
    "e7_threshold_gain", lambda s, d: M.threshold_gain(E(s, d), 0.4),
    f"WITH a AS (SELECT {rates_sql()} FROM (SELECT {confusion_sql()} FROM e)), b AS (SELECT {rates_sql()} FROM (SELECT {confusion_sql('0.4')} FROM e)) SELECT a.f1 AS fixed_f1, a.accuracy AS fixed_accuracy, b.f1 AS tuned_f1, b.accuracy AS tuned_accuracy, b.f1 - a.f1 AS f1_gain, b.accuracy - a.accuracy AS accuracy_gain FROM a, b",
    "fixed_f1 fixed_accuracy tuned_f1 tuned_accuracy f1_gain accuracy_gain",
)
R.add("e8_roc_curve", lambda s, d: M.roc_curve(E(s, d)), f"WITH {STEPS_SQL} SELECT t AS threshold, tp / n_pos AS tpr, fp / n_neg AS fpr FROM steps UNION ALL SELECT max(t) + 1e-5, 0.0, 0.0 FROM steps", "threshold tpr fpr")
R.add("e9_pr_curve", lambda s, d: M.pr_curve(E(s, d)), f"WITH {STEPS_SQL} SELECT t AS threshold, tp / n_pos AS recall, tp / (tp + fp) AS precision FROM steps UNION ALL SELECT 0.0, 1.0, max(n_pos) / (max(n_pos) + max(n_neg)) FROM steps", "threshold recall precision")
R.add(
    "e10_reliability_atlas", lambda s, d: M.reliability_atlas(E(s, d)),
    f"""WITH {BINS_SQL}, b AS (SELECT *, accuracy - confidence AS signed_error, weight * abs(accuracy - confidence) AS weighted_error, count < 2 AS sparse FROM bins),
 t AS (SELECT sum(weighted_error) AS ece, max(abs(signed_error)) AS max_error, bool_or(sparse) AS any_sparse FROM b)
 SELECT bin, count, confidence, accuracy, weight, signed_error, weighted_error, sparse, CASE WHEN signed_error > 0.02 THEN 'underconfident' WHEN signed_error < -0.02 THEN 'overconfident' ELSE 'aligned' END AS direction,
 CAST(row_number() OVER (ORDER BY weighted_error DESC, bin) AS INT) AS impact_rank, ece, max_error, CASE WHEN ece >= 0.12 OR max_error >= 0.35 THEN 'high' WHEN ece >= 0.08 OR max_error >= 0.25 OR any_sparse THEN 'medium' ELSE 'low' END AS risk FROM b, t""",
    "confidence accuracy weight signed_error weighted_error ece max_error",
)

SWEEP_SQL = f"""pts AS (SELECT label AS pos, 1 - label AS neg, p AS t FROM e UNION ALL SELECT 0, 0, i / 100.0::DOUBLE FROM range(101) r(i) UNION ALL SELECT 0, 0, 0.5),
 st AS (SELECT t AS threshold, CAST(sum(pos) OVER w AS BIGINT) AS tp, CAST(sum(neg) OVER w AS BIGINT) AS fp, CAST(sum(pos) OVER () AS BIGINT) AS n_pos, CAST(sum(neg) OVER () AS BIGINT) AS n_neg
 FROM (SELECT t, sum(pos) AS pos, sum(neg) AS neg FROM pts GROUP BY t) WINDOW w AS (ORDER BY t DESC)),
 sweep AS (SELECT *, {rates_sql()}, (fp + 5.0 * fn) / (tp + fp + tn + fn) AS cost FROM (SELECT threshold, tp, fp, n_neg - fp AS tn, n_pos - tp AS fn FROM st))"""
R.add("t1_threshold_sweep", lambda s, d: S.threshold_sweep(E(s, d)), f"WITH {SWEEP_SQL} SELECT * FROM sweep", f"threshold {RATES} cost")


def _pick(name: str, order: str, where: str = "true") -> str:
    return f"SELECT * FROM (SELECT '{name}' AS pick, f1, accuracy, balanced_accuracy, precision, recall, cost, threshold FROM sweep WHERE {where} ORDER BY {order}, threshold LIMIT 1)"


R.add(
    "t1_threshold_picks", lambda s, d: S.threshold_picks(S.threshold_sweep(E(s, d))),
    f"WITH {SWEEP_SQL} " + " UNION ALL ".join([
        _pick("best_f1", "f1 DESC, accuracy DESC, cost"), _pick("best_balanced", "balanced_accuracy DESC, f1 DESC, cost"), _pick("min_cost", "cost, f1 DESC"),
        _pick("high_recall", "precision DESC, f1 DESC, cost", "recall >= 0.9"), _pick("high_precision", "recall DESC, f1 DESC, cost", "precision >= 0.9"),
    ]),
    f"threshold {RATES} cost",
)
R.add("t2_optimal_threshold", lambda s, d: S.optimal_threshold(E(s, d)), f"WITH {STEPS_SQL}, f AS (SELECT t, {ratio_sql('2 * tp', 'tp + fp + n_pos')} AS f1 FROM steps) SELECT t AS threshold, f1 FROM f ORDER BY round(f1, 9) DESC, abs(t - 0.5), t LIMIT 1", "threshold f1")
R.add(
    "t3_decision_curve", lambda s, d: S.decision_curve(E(s, d)),
    """WITH pts AS (SELECT DISTINCT round(t, 10) AS t FROM (SELECT 1e-6::DOUBLE + i * ((1 - 1e-6::DOUBLE) - 1e-6::DOUBLE) / 100 AS t FROM range(101) r(i) UNION ALL SELECT 0.5)),
 c AS (SELECT t AS threshold, (SELECT count(*) FROM e WHERE p >= t AND label = 1) AS tp, (SELECT count(*) FROM e WHERE p >= t AND label = 0) AS fp, (SELECT count(*) FROM e) AS n, (SELECT avg(label::DOUBLE) FROM e) AS prev, t / (1 - t) AS odds FROM pts),
 b AS (SELECT threshold, tp, fp, tp / n - fp / n * odds AS net_benefit, prev - (1 - prev) * odds AS treat_all, odds FROM c),
 g AS (SELECT threshold, tp, fp, net_benefit, treat_all, net_benefit - greatest(treat_all, 0.0) AS delta, odds FROM b),
 u AS (SELECT threshold, tp, fp, net_benefit, treat_all, delta, delta / odds * 100 AS avoided_per_100, round(delta, 12) > 0 AS useful FROM g),
 k AS (SELECT *, CASE WHEN useful AND NOT coalesce(lag(useful) OVER (ORDER BY threshold), false) THEN 1 ELSE 0 END AS st FROM u)
 SELECT threshold, tp, fp, net_benefit, treat_all, delta, avoided_per_100, useful, CASE WHEN useful THEN CAST(sum(st) OVER (ORDER BY threshold) AS BIGINT) ELSE 0 END AS range_id FROM k""",
    "threshold net_benefit treat_all delta avoided_per_100",
)
PLAN_SQL = """ranked AS (SELECT p, label, row_number() OVER (ORDER BY p DESC, row_id) AS r, count(*) OVER () AS n, CAST(sum(label) OVER () AS BIGINT) AS n_pos FROM e),
 ks AS (SELECT DISTINCT CAST(ceil(greatest(f, 1 / n) * n) AS BIGINT) AS k, n, n_pos FROM (SELECT unnest([0.01,0.02,0.05,0.10,0.15,0.20,0.30,0.40,0.50,0.75,1.0]::DOUBLE[]) AS f), (SELECT count(*) AS n, CAST(sum(label) AS BIGINT) AS n_pos FROM e)),
 c AS (SELECT ks.k, any_value(ks.n) AS n, any_value(ks.n_pos) AS n_pos, CAST(sum(label) AS BIGINT) AS tp, min(p) AS threshold_floor FROM ks JOIN ranked ON r <= k GROUP BY ks.k),
 plan AS (SELECT k, n_pos, tp, threshold_floor, k - tp AS fp, tp / k AS precision, tp / n_pos AS recall, (tp / k) / (n_pos / n) AS lift, 2 * tp / (k + n_pos) AS f1, 5.0 * tp - (k - tp) - 0.25 * k AS utility,
 5.0 * tp - (k - tp) - 0.25 * k - (5.0 * (k * (n_pos / n)) - (k - k * (n_pos / n)) - 0.25 * k) AS gain_over_random, k / n AS fraction FROM c)"""
R.add("t4_capacity_plan", lambda s, d: S.capacity_plan(E(s, d)), f"WITH {PLAN_SQL} SELECT * FROM plan", "threshold_floor precision recall lift f1 utility gain_over_random fraction")
R.add(
    "t4_capacity_verdict", lambda s, d: S.capacity_verdict(S.capacity_plan(E(s, d))),
    f"WITH {PLAN_SQL} SELECT k, utility, precision, recall, CASE WHEN n_pos = 0 THEN 'no_positive_evidence' WHEN utility <= 0 OR precision <= 0 THEN 'not_actionable' WHEN recall < 0.2 THEN 'low_capture_review' ELSE 'actionable_capacity_plan' END AS verdict FROM plan ORDER BY utility DESC, precision DESC, fraction LIMIT 1",
    "utility precision recall",
)
R.add("t5_action_queue", lambda s, d: S.action_queue(E(s, d)).select("row_id", "p", "label"), "SELECT row_id, p, label FROM e ORDER BY p DESC, row_id LIMIT 12", "p")
_C = "round(least(greatest(abs(p - 0.5) / 0.5, 0.0), 1.0), 10)"
CURVE_SQL = f"""rows_ AS (SELECT {_C} AS c, (p >= 0.5 AND label = 1)::INT AS tp, (p >= 0.5 AND label = 0)::INT AS fp, (p < 0.5 AND label = 0)::INT AS tn, (p < 0.5 AND label = 1)::INT AS fn FROM e),
 cuts AS (SELECT c, tp, fp, tn, fn FROM rows_ UNION ALL SELECT round(i / 20.0::DOUBLE * (SELECT max(c) FROM rows_), 10), 0, 0, 0, 0 FROM range(21) r(i)),
 g AS (SELECT c, sum(tp) AS tp, sum(fp) AS fp, sum(tn) AS tn, sum(fn) AS fn FROM cuts GROUP BY c),
 k AS (SELECT c, CAST(sum(tp) OVER w AS BIGINT) AS tp, CAST(sum(fp) OVER w AS BIGINT) AS fp, CAST(sum(tn) OVER w AS BIGINT) AS tn, CAST(sum(fn) OVER w AS BIGINT) AS fn, CAST(sum(fp + fn) OVER () AS BIGINT) AS wrong, CAST(sum(tp + fp + tn + fn) OVER () AS BIGINT) AS n FROM g WINDOW w AS (ORDER BY c DESC)),
 curve AS (SELECT c AS cutoff, tp + fp + tn + fn AS selected, {ratio_sql('tp + fp + tn + fn', 'n')} AS coverage, {ratio_sql('fp + fn', 'tp + fp + tn + fn')} AS error, {rates_sql(names=('f1', 'accuracy'))}, {ratio_sql('wrong - fp - fn', 'n - tp - fp - tn - fn')} AS abstained_error FROM k)"""
R.add("t6_selective_risk", lambda s, d: S.selective_risk(E(s, d)), f"WITH {CURVE_SQL} SELECT * FROM curve", "cutoff coverage error f1 accuracy abstained_error")
R.add(
    "t6_selective_targets", lambda s, d: S.selective_targets(S.selective_risk(E(s, d))),
    f"WITH {CURVE_SQL}, t AS (SELECT unnest([0.01, 0.05, 0.1]::DOUBLE[]) AS target) SELECT target, b.coverage, b.error, b.cutoff FROM t LEFT JOIN LATERAL (SELECT coverage, error, cutoff FROM curve WHERE selected > 0 AND error <= target ORDER BY coverage DESC, error, cutoff LIMIT 1) b ON true",
    "target coverage error cutoff",
)
R.add(
    "t6_selective_area", lambda s, d: S.selective_area(S.selective_risk(E(s, d))),
    f"WITH {CURVE_SQL}, o AS (SELECT coverage, max(error) AS error FROM curve WHERE selected > 0 GROUP BY coverage), q AS (SELECT coverage, error, lag(coverage) OVER (ORDER BY coverage) AS c0, lag(error) OVER (ORDER BY coverage) AS e0 FROM o) SELECT coalesce(sum((coverage - c0) * (error + e0) / 2), 0.0) AS aurc, min(error) AS min_error FROM q",
    "aurc min_error",
)
_T7_REST = uniform_sql("(rep || ':' || i)", 42, "'rest' || kind")
R.add(
    "t7_threshold_stability", lambda s, d: S.threshold_stability(E(s, d)),
    f"""WITH c AS (SELECT CAST(floor(p * 100 + 1e-9) AS INT) AS cell, CASE WHEN label = 1 THEN 'pos' ELSE 'neg' END AS kind, count(*) AS n_rows FROM e GROUP BY 1, 2),
 h AS (SELECT *, kind || ':' || cell AS key, sum(n_rows) OVER (PARTITION BY kind) AS n, sum(n_rows) OVER (PARTITION BY kind ORDER BY cell) AS upto FROM c), {poisson_tables_sql('pt', 'SELECT key, greatest(0.0, n - 12 * sqrt(n)) * n_rows / n AS mean FROM h', 'key')},
 u AS (SELECT rep, kind, cell, key, {uniform_sql('rep', 42, "'boot' || key")} AS u FROM h, range(80) r(rep)), f1_ AS (SELECT rep, kind, cell, least(any_value(lo) + count(*) FILTER (cdf < u), any_value(hi)) AS m FROM u JOIN pt USING (key) GROUP BY 1, 2, 3),
 lf AS (SELECT rep, kind, any_value(n) AS n, sum(m) AS m FROM f1_ JOIN (SELECT DISTINCT kind, n FROM h) USING (kind) GROUP BY 1, 2), ea AS (SELECT rep, kind, floor({_T7_REST} * n) AS place FROM (SELECT rep, kind, n, unnest(range(1, (n - m + 1)::BIGINT)) AS i FROM lf WHERE n > m)),
 mo AS (SELECT rep, ea.kind, cell, count(*) AS m FROM ea JOIN h ON h.kind = ea.kind AND place < upto AND place >= upto - n_rows GROUP BY 1, 2, 3), dr AS (SELECT rep, cell, sum(m) FILTER (kind = 'pos') AS pos, sum(m) FILTER (kind = 'neg') AS neg FROM (SELECT * FROM f1_ UNION ALL SELECT * FROM mo) GROUP BY 1, 2),
 f AS (SELECT r.rep, k.cell, coalesce(pos, 0) AS pos, coalesce(neg, 0) AS neg FROM range(80) r(rep) CROSS JOIN range(101) k(cell) LEFT JOIN dr ON dr.cell = k.cell AND dr.rep = r.rep),
 s AS (SELECT rep, cell / 100.0::DOUBLE AS t, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER v AS n_pos, sum(neg) OVER v AS n_neg FROM f WINDOW w AS (PARTITION BY rep ORDER BY cell DESC), v AS (PARTITION BY rep)),
 m AS (SELECT rep, t, {rates_sql()} FROM (SELECT rep, t, tp, fp, n_neg - fp AS tn, n_pos - tp AS fn FROM s)),
 o AS (SELECT *, row_number() OVER (PARTITION BY rep ORDER BY round(f1, 9) DESC, round(balanced_accuracy, 9) DESC, round(accuracy, 9) DESC, round(abs(t - 0.5), 9), t) AS rn, max(f1) OVER (PARTITION BY rep) AS best, max(CASE WHEN abs(t - 0.5) < 1e-9 THEN f1 END) OVER (PARTITION BY rep) AS now FROM m),
 q AS (SELECT quantile_cont(t, 0.05) AS q05, quantile_cont(t, 0.25) AS q25, quantile_cont(t, 0.5) AS q50, quantile_cont(t, 0.75) AS q75, quantile_cont(t, 0.95) AS q95, quantile_cont(best - now, 0.5) AS median_gain FROM o WHERE rn = 1),
 z AS (SELECT *, q95 - q05 AS spread, NOT (0.5 BETWEEN q05 AND q95) AS outside FROM q)
 SELECT *, CASE WHEN spread >= 0.35 OR (outside AND median_gain >= 0.08) THEN 'unstable_threshold' WHEN spread >= 0.18 OR q75 - q25 >= 0.1 OR outside OR median_gain >= 0.04 THEN 'threshold_review' ELSE 'stable_threshold' END AS verdict FROM z""",
    "q05 q25 q50 q75 q95 median_gain spread",
)
