"""Queries of slices, fairness, error queues and drift."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugework.operators import drift as D
from gaugework.operators import slices as G
from gaugework.operators.prep import order_split
from gaugework.plans.registry import Registry
from gaugework.plans.scoring_queries import PROB_SQL
from gaugework.plans.tables import FEATURES as X
from gaugework.plans.tables import confusion_sql, normal_sql, rates_sql
from gaugework.plans.tables import event_examples as E

R = Registry()


def scorer(x1, x2, x3):
    """The pinned scorer as a column of the features."""
    return 1 / (1 + F.exp(-((x1 - 50) / 25 + 0.02 * (x2 - 50) * F.when(x3 >= 5, 1.0).otherwise(0.5) / 10)))


SCORER_SQL = "(1 / (1 + exp(-(({0} - 50) / 25 + 0.02 * ({1} - 50) * (CASE WHEN {2} >= 5 THEN 1.0 ELSE 0.5 END) / 10))))"


def bins_sql(bins: int, source: str = "l") -> str:
    qs = ", ".join(f"quantile_cont(value, {i / bins})" for i in range(bins + 1))
    return f"""ed AS (SELECT feature_index, feature, list_sort(list_distinct([{qs}])) AS e FROM {source} GROUP BY 1, 2),
 bn AS (SELECT feature_index, feature, CAST(i - 1 AS INT) AS bin, e[i] AS "left", e[i + 1] AS "right", i = len(e) - 1 AS is_last, len(e) - 1 AS nb FROM ed, range(1, 50) r(i) WHERE i <= len(e) - 1)"""


_IN = "value >= \"left\" AND (CASE WHEN is_last THEN value <= \"right\" ELSE value < \"right\" END)"
R.add(
    "g1_slices", lambda s, d: G.slices(E(s, d), X),
    f"""WITH {bins_sql(4)}, c AS (SELECT l.feature_index, l.feature, bin, "left", "right", count(*) AS count, avg(label::DOUBLE) AS prevalence, {confusion_sql()} FROM l JOIN bn ON l.feature_index = bn.feature_index AND {_IN} GROUP BY ALL),
 b AS (SELECT n, f1 AS bf, accuracy AS ba FROM (SELECT n, {rates_sql()} FROM (SELECT count(*) AS n, {confusion_sql()} FROM e))), m AS (SELECT *, {rates_sql()} FROM c)
 SELECT feature_index, feature, bin, "left", "right", count, count / n AS coverage, f1, accuracy, balanced_accuracy, precision, recall, f1 - bf AS f1_delta, accuracy - ba AS accuracy_delta, prevalence, (tp + fp) / count AS predicted_rate FROM m, b
 WHERE count >= greatest(3, round_even(0.08 * n, 0)) ORDER BY round(f1 - bf, 9), round(accuracy - ba, 9), count DESC, feature_index, bin LIMIT 12""",
    '"left" "right" coverage f1 accuracy balanced_accuracy precision recall f1_delta accuracy_delta prevalence predicted_rate', "l",
)


def _g2(s, d):
    return G.subgroups(E(s, d).withColumn("x4", F.when(F.col("segment") == "view", 1.0).otherwise(0.0)), ["x1", "x2", "x4"])


_KEYS = ("accuracy", "f1", "precision", "recall", "fnr", "fpr", "ppr", "mean_p", "prevalence")


def _side_sql(t: dict[str, str]) -> dict[str, str]:
    tp, fp, tn, fn, n, sp = (t[k] for k in ("tp", "fp", "tn", "fn", "n", "sp"))
    div = lambda a, b: f"(CASE WHEN ({b}) > 0 THEN ({a}) / ({b}) END)"
    return {
        "accuracy": div(f"{tp} + {tn}", n), "f1": f"(CASE WHEN 2 * {tp} + {fp} + {fn} = 0 THEN 0.0 ELSE 2 * {tp} / (2 * {tp} + {fp} + {fn}) END)", "precision": div(tp, f"{tp} + {fp}"), "recall": div(tp, f"{tp} + {fn}"), "fnr": div(fn, f"{tp} + {fn}"),
        "fpr": div(fp, f"{fp} + {tn}"), "ppr": div(f"{tp} + {fp}", n), "mean_p": div(sp, n), "prevalence": div(f"{tp} + {fn}", n),
    }


_C = ("n", "sp", "tp", "fp", "tn", "fn")
_A, _B = _side_sql({c: f"g.{c}" for c in _C}), _side_sql({c: f"(t.{c} - g.{c})" for c in _C})
_GAPS = ", ".join(f"{_A[k]} - {_B[k]} AS {k}_gap" for k in _KEYS)
_BEST = ", ".join(f"CASE WHEN {k}_gap IS NOT NULL THEN {{'g': round(abs({k}_gap), 9), 'o': {-i}, 'm': '{k}'}} END" for i, k in enumerate(_KEYS))
_FLAG = lambda name, cond: f"CASE WHEN {cond} THEN '{name}' END"
R.add(
    "g2_subgroups", _g2,
    f"""WITH v AS (SELECT label, p, 0 AS feature_index, 'x1' AS feature, x1 AS value FROM e UNION ALL SELECT label, p, 1, 'x2', x2 FROM e UNION ALL SELECT label, p, 2, 'x4', CASE WHEN segment = 'view' THEN 1.0 ELSE 0.0 END FROM e), k AS (SELECT feature_index, count(DISTINCT value) AS nd FROM v GROUP BY 1),
 wide AS (SELECT * FROM v WHERE feature_index IN (SELECT feature_index FROM k WHERE nd > 4)), {bins_sql(4, 'wide')},
 g AS (SELECT feature_index, feature, 'value=' || round(value, 6)::VARCHAR AS grp, count(*) AS n, sum(p) AS sp, {confusion_sql()} FROM v WHERE feature_index IN (SELECT feature_index FROM k WHERE nd BETWEEN 2 AND 4) GROUP BY 1, 2, 3
  UNION ALL SELECT wide.feature_index, wide.feature, 'bin=' || bin, count(*), sum(p), {confusion_sql()} FROM wide JOIN bn ON wide.feature_index = bn.feature_index AND {_IN} WHERE nb >= 2 GROUP BY 1, 2, 3),
 t AS (SELECT count(*) AS n, sum(p) AS sp, {confusion_sql()} FROM e), r AS (SELECT feature_index, feature, grp, g.n, {_GAPS} FROM g, t WHERE g.n >= 2 AND t.n - g.n >= 2), w AS (SELECT *, list_max(list_filter([{_BEST}], lambda x: x IS NOT NULL)) AS b FROM r)
 SELECT * EXCLUDE (b), b.g AS risk, b.m AS worst_metric, array_to_string(list_sort(list_filter([{_FLAG('fnr_gap', 'abs(fnr_gap) >= 0.25')}, {_FLAG('fpr_gap', 'abs(fpr_gap) >= 0.25')}, {_FLAG('selection_gap', 'abs(ppr_gap) >= 0.25')}, {_FLAG('accuracy_gap', 'abs(accuracy_gap) >= 0.2')}, {_FLAG('large_gap', 'b.g >= 0.4')}], lambda x: x IS NOT NULL)), ',') AS flags FROM w""",
    " ".join(f"{k}_gap" for k in _KEYS) + " risk",
)
_SH = {"selection_rate": "(tp + fp) / n", "tpr": "tp / nullif(tp + fn, 0)", "fpr": "fp / nullif(fp + tn, 0)", "fnr": "fn / nullif(tp + fn, 0)", "accuracy": "(tp + tn) / n", "prevalence": "(tp + fn) / n"}
R.add(
    "g3_fairness", lambda s, d: G.fairness(E(s, d), X),
    f"""WITH k AS (SELECT feature_index, count(DISTINCT value) AS nd, median(value) AS md FROM l GROUP BY 1), g AS (SELECT l.feature_index, feature, CASE WHEN nd BETWEEN 2 AND 4 THEN value WHEN value <= md THEN 0.0 ELSE 1.0 END AS g, count(*) AS n, {confusion_sql()} FROM l JOIN k USING (feature_index) GROUP BY 1, 2, 3 HAVING count(*) >= 2),
 r AS (SELECT *, {', '.join(f'{v} AS {k}' for k, v in _SH.items())} FROM g), q AS (SELECT feature_index, feature, count(*) AS groups, {', '.join(f'CASE WHEN count({k}) >= 2 THEN max({k}) - min({k}) END AS {k}_gap' for k in _SH)} FROM r GROUP BY 1, 2 HAVING count(*) >= 2),
 z AS (SELECT *, greatest(tpr_gap, fpr_gap) AS equalized_odds_gap, greatest({', '.join(f'{k}_gap' for k in _SH)}) AS max_disparity FROM q) SELECT *, CAST(row_number() OVER (ORDER BY round(max_disparity, 9) DESC, round(equalized_odds_gap, 9) DESC, feature_index) AS INT) AS rank FROM z""",
    " ".join(f"{k}_gap" for k in _SH) + " equalized_odds_gap max_disparity", "l",
)
R.add(
    "g3_segment_fairness_cube", lambda s, d: G.segment_fairness(E(s, d).withColumn("band", F.when(F.col("x2") < 50, "low").otherwise("high")), ["segment", "band"]),
    f"""WITH c AS (SELECT segment, band, level, n, {rates_sql()}, tp, fp FROM (SELECT segment, band, CAST(grouping(segment, band) AS BIGINT) AS level, count(*) AS n, {confusion_sql()} FROM (SELECT *, CASE WHEN x2 < 50 THEN 'low' ELSE 'high' END AS band FROM e) GROUP BY CUBE (segment, band))) SELECT segment, band, level, n, accuracy, recall, (tp + fp) / n AS selection_rate FROM c""",
    "accuracy recall selection_rate",
)
ERR_SQL = """er AS (SELECT row_id, label, p, CASE WHEN p >= 0.5 AND label = 1 THEN 'tp' WHEN p >= 0.5 THEN 'fp' WHEN label = 1 THEN 'fn' ELSE 'tn' END AS bucket, (p >= 0.5) <> (label = 1) AS wrong, CASE WHEN p >= 0.5 THEN p ELSE 1 - p END AS confidence,
 round(-ln(least(greatest(CASE WHEN label = 1 THEN p ELSE 1 - p END, 1e-7), 1.0)), 9) AS loss, round(abs(p - 0.5), 9) AS margin FROM e)"""
R.add("g4_error_atlas", lambda s, d: G.error_atlas(E(s, d)), f"WITH {ERR_SQL} SELECT bucket, CAST(row_number() OVER w AS INT) AS rank, row_id, label, p, confidence, loss, margin FROM er WINDOW w AS (PARTITION BY bucket ORDER BY loss DESC, margin DESC, row_id) QUALIFY row_number() OVER w <= 10", "p confidence loss margin")
R.add("g4_near_threshold", lambda s, d: G.near_threshold(E(s, d)), f"WITH {ERR_SQL} SELECT row_id, bucket, p, margin, loss FROM er WHERE margin <= 0.05 ORDER BY margin, loss DESC, row_id LIMIT 10", "p margin loss")
R.add(
    "g4_error_summary", lambda s, d: G.error_summary(E(s, d), by=["segment"]),
    f"WITH {ERR_SQL}, s AS (SELECT segment, count(*) AS n, {', '.join(f'''count(*) FILTER (bucket = '{b}') AS {b}''' for b in ('tp', 'tn', 'fp', 'fn'))}, count(*) FILTER (wrong AND confidence >= 0.8) AS high_confidence_errors, count(*) FILTER (margin <= 0.05) AS near_threshold FROM er JOIN (SELECT row_id, segment FROM e) USING (row_id) GROUP BY segment) SELECT *, CASE WHEN fp > fn THEN 'false_positives' WHEN fn > fp THEN 'false_negatives' WHEN fp = 0 THEN 'none' ELSE 'balanced_errors' END AS dominant FROM s",
)
_COLS = "row_id, label, p, confidence, loss, margin"
R.add(
    "g5_sample_review", lambda s, d: G.sample_review(E(s, d)),
    f"WITH {ERR_SQL} SELECT * FROM (SELECT 'label_issue' AS queue, {_COLS} FROM er WHERE wrong AND confidence >= 0.8 ORDER BY loss DESC, row_id LIMIT 12) UNION ALL SELECT * FROM (SELECT 'hard', {_COLS} FROM er ORDER BY loss DESC, row_id LIMIT 12) UNION ALL SELECT * FROM (SELECT 'ambiguous', {_COLS} FROM er ORDER BY margin, loss DESC, row_id LIMIT 12)",
    "p confidence loss margin",
)
_MOVE = lambda f: f"CASE WHEN k = 0 THEN {f} ELSE {f} + 0.05 * s_{f} * {normal_sql('row_id', 42, repr(f + ':') + ' || k')} END AS {f}"
R.add(
    "g6_cartography", lambda s, d: G.cartography(E(s, d), X, scorer),
    f"""WITH sd AS (SELECT stddev_pop(x1) AS s_x1, stddev_pop(x2) AS s_x2, stddev_pop(x3) AS s_x3 FROM e), m AS (SELECT row_id, label, k, {', '.join(_MOVE(f) for f in X)} FROM e, sd, range(6) r(k)), q AS (SELECT row_id, label, k, {SCORER_SQL.format('x1', 'x2', 'x3')} AS q FROM m),
 p AS (SELECT row_id, label, max(q) FILTER (k = 0) AS q0, round(stddev_pop(q), 9) AS variability FROM q GROUP BY 1, 2), c AS (SELECT row_id, label, round(CASE WHEN label = 1 THEN q0 ELSE 1 - q0 END, 9) AS confidence, variability, (q0 >= 0.5) <> (label = 1) AS wrong FROM p), t AS (SELECT median(confidence) AS c0, median(variability) AS v0 FROM c)
 SELECT row_id, label, confidence, variability, CASE WHEN wrong AND confidence >= c0 THEN 'overconfident_wrong' WHEN confidence >= c0 THEN 'easy' WHEN variability >= v0 THEN 'ambiguous' ELSE 'hard' END AS region FROM c, t""",
    "confidence variability",
)

_TIME = lambda: F.unix_micros("ts")


def _sided(s, d):
    """Events in order, with the later half shifted in one feature."""
    e = order_split(E(s, d), _TIME())
    return e.withColumn("x2", F.when(F.col("side") == "current", F.col("x2") * 1.5 + 20).otherwise(F.col("x2")))


ORD_SQL = "od AS (SELECT *, row_number() OVER (ORDER BY ts, row_id) - 1 AS i, count(*) OVER () AS n FROM e), sd AS (SELECT row_id, label, i, i < greatest(2, least(round_even(n * 0.5, 0), n - 2)) AS ref, x1, CASE WHEN i < greatest(2, least(round_even(n * 0.5, 0), n - 2)) THEN x2 ELSE x2 * 1.5 + 20 END AS x2, x3 FROM od)"
R.add(
    "d1_population_drift", lambda s, d: D.population_drift(_sided(s, d), X),
    f"""WITH {ORD_SQL}, v AS (SELECT ref, 0 AS feature_index, 'x1' AS feature, x1 AS value FROM sd UNION ALL SELECT ref, 1, 'x2', x2 FROM sd UNION ALL SELECT ref, 2, 'x3', x3 FROM sd),
 b AS (SELECT feature_index, feature, count(*) FILTER (ref) AS n_ref, count(*) FILTER (NOT ref) AS n_cur, avg(value) FILTER (ref) AS m0, avg(value) FILTER (NOT ref) AS m1, stddev_pop(value) FILTER (ref) AS s0, stddev_pop(value) FILTER (NOT ref) AS s1, min(value) FILTER (ref) AS lo, max(value) FILTER (ref) AS hi FROM v GROUP BY 1, 2),
 eg AS (SELECT feature_index, list_sort(list_distinct([{', '.join(f'quantile_cont(value, {i / 10})' for i in range(1, 10))}])) AS edges FROM v WHERE ref GROUP BY 1),
 st AS (SELECT feature_index, value, r, c, sum(r) OVER w AS cr, sum(c) OVER w AS cc FROM (SELECT feature_index, value, count(*) FILTER (ref) AS r, count(*) FILTER (NOT ref) AS c FROM v GROUP BY 1, 2) WINDOW w AS (PARTITION BY feature_index ORDER BY value)),
 gp AS (SELECT feature_index, max(abs(cr / n_ref - cc / n_cur)) AS ks, sum(CASE WHEN value < lo OR value > hi THEN c ELSE 0 END) AS outside FROM st JOIN b USING (feature_index) GROUP BY 1),
 hs AS (SELECT feature_index, len(list_filter(edges, lambda x: x <= value)) AS bin, sum(r) / any_value(n_ref) AS r, sum(c) / any_value(n_cur) AS c FROM st JOIN b USING (feature_index) JOIN eg USING (feature_index) GROUP BY 1, 2),
 ps AS (SELECT feature_index, sum((greatest(c, 1e-6) - greatest(r, 1e-6)) * ln(greatest(c, 1e-6) / greatest(r, 1e-6))) AS psi FROM hs GROUP BY 1),
 o AS (SELECT feature_index, feature, n_ref, n_cur, psi, ks, abs(m1 - m0) / (CASE WHEN s0 < 1e-6 THEN 1.0 ELSE s0 END) AS mean_shift, outside / n_cur AS outside_rate, s1 / (CASE WHEN s0 < 1e-6 THEN 1.0 ELSE s0 END) AS std_ratio FROM b JOIN gp USING (feature_index) JOIN ps USING (feature_index)),
 z AS (SELECT *, psi + ks + least(mean_shift, 5.0) / 5 + outside_rate AS risk FROM o)
 SELECT *, array_to_string(list_sort(list_filter([{_FLAG('major_psi_shift', 'psi >= 0.25')}, {_FLAG('moderate_psi_shift', 'psi < 0.25 AND psi >= 0.1')}, {_FLAG('major_ks_shift', 'ks >= 0.3')}, {_FLAG('moderate_ks_shift', 'ks < 0.3 AND ks >= 0.2')}, {_FLAG('mean_shift', 'mean_shift >= 1')}, {_FLAG('outside_reference', 'outside_rate >= 0.1')}, {_FLAG('spread_change', 'std_ratio >= 2 OR std_ratio <= 0.5')}], lambda x: x IS NOT NULL)), ',') AS flags,
 CAST(row_number() OVER (ORDER BY round(risk, 9) DESC, feature_index) AS INT) AS rank FROM z""",
    "psi ks mean_shift outside_rate std_ratio risk",
)
R.add("d1_label_shift", lambda s, d: D.label_shift(_sided(s, d)), f"WITH {ORD_SQL} SELECT avg(label::DOUBLE) FILTER (ref) AS reference_prevalence, avg(label::DOUBLE) FILTER (NOT ref) AS current_prevalence, avg(label::DOUBLE) FILTER (NOT ref) - avg(label::DOUBLE) FILTER (ref) AS prevalence_shift FROM sd", "reference_prevalence current_prevalence prevalence_shift")


def _late_flip(s, d):
    """Events whose labels are turned over in the last three days."""
    return E(s, d).withColumn("label", F.when(F.col("ts") >= "2024-01-28", 1 - F.col("label")).otherwise(F.col("label")))


_FLIP = "fl AS (SELECT row_id, ts, p, CASE WHEN ts >= TIMESTAMP '2024-01-28' THEN 1 - label ELSE label END AS label FROM e)"
REPLAY_SQL = f"""{_FLIP}, od AS (SELECT *, row_number() OVER (ORDER BY ts, row_id) - 1 AS i, count(*) OVER () AS cnt FROM fl), wc AS (SELECT *, CASE WHEN cnt < 16 THEN 2 ELSE least(5, greatest(2, floor(cnt / 8))) END AS k FROM od),
 wn AS (SELECT *, len(list_filter(list_transform(range(1, CAST(k AS BIGINT) + 1), lambda j: round_even(j * cnt / k, 0)), lambda b: b <= i)) AS "window" FROM wc), ag AS (SELECT CAST("window" AS INT) AS "window", count(*) AS n, min(i) AS first_index, {confusion_sql()}, {PROB_SQL} FROM wn GROUP BY 1), m AS (SELECT *, {rates_sql()} FROM ag),
 dl AS (SELECT "window", n, first_index, f1, accuracy, brier, log_loss, prevalence, f1 - first(f1) OVER w AS f1_delta, accuracy - first(accuracy) OVER w AS accuracy_delta, brier - first(brier) OVER w AS brier_delta, prevalence - first(prevalence) OVER w AS prevalence_delta FROM m WINDOW w AS (ORDER BY "window")),
 rp AS (SELECT *, 100 * (0.45 * greatest(0.0, -f1_delta) + 0.25 * greatest(0.0, -accuracy_delta) + 0.2 * greatest(0.0, brier_delta) + 0.1 * abs(prevalence_delta)) AS degradation, f1_delta <= -0.15 OR accuracy_delta <= -0.15 OR brier_delta >= 0.08 AS flagged FROM dl)"""
R.add("d4_shadow_replay", lambda s, d: D.shadow_replay(_late_flip(s, d), _TIME()), f"WITH {REPLAY_SQL} SELECT * FROM rp", "f1 accuracy brier log_loss prevalence f1_delta accuracy_delta brier_delta prevalence_delta degradation")
R.add(
    "d4_replay_verdict", lambda s, d: D.replay_verdict(D.shadow_replay(_late_flip(s, d), _TIME())),
    f"WITH {REPLAY_SQL}, o AS (SELECT min(n) AS sm, min(f1_delta) AS f, min(accuracy_delta) AS a, max(brier_delta) AS b, count(*) FILTER (flagged) AS flagged_windows, max(degradation) AS worst_degradation FROM rp) SELECT flagged_windows, worst_degradation, CASE WHEN sm < 5 THEN 'thin_ordered_evidence' WHEN f <= -0.3 OR a <= -0.25 OR b >= 0.12 THEN 'severe_ordered_degradation' WHEN f <= -0.15 OR a <= -0.15 OR b >= 0.08 OR flagged_windows > 0 THEN 'ordered_degradation_review' ELSE 'stable_ordered_replay' END AS verdict FROM o",
    "worst_degradation",
)
R.add(
    "d5_error_runs", lambda s, d: D.error_runs(E(s, d), _TIME(), by=["segment"], top=None),
    """WITH o AS (SELECT segment, row_id, (p >= 0.5) <> (label = 1) AS wrong, -ln(greatest(CASE WHEN label = 1 THEN p ELSE 1 - p END, 1e-7)) AS loss, row_number() OVER (PARTITION BY segment ORDER BY ts, row_id) AS place FROM e), w AS (SELECT *, place - row_number() OVER (PARTITION BY segment ORDER BY place) AS island FROM o WHERE wrong)
 SELECT segment, count(*) AS length, min(place) - 1 AS start, avg(loss) AS mean_loss, min(row_id) AS first_row FROM w GROUP BY segment, island""", "mean_loss",
)
