"""Queries of models, scorecards and streams (M, C, D2, D3, K, D4s, D5s)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugework.functions.columns import with_rates
from gaugework.operators import modeling as M
from gaugework.operators import profile as P
from gaugework.operators import scorecard as K
from gaugework.operators import training as N
from gaugework.operators.drift import replay_verdict, shadow_replay
from gaugework.operators.metrics import calibration_bins, confusion_aggs, probability_aggs
from gaugework.operators.prep import order_split
from gaugework.operators.search import shared_search
from gaugework.operators.slices import error_summary
from gaugework.plans.registry import Registry
from gaugework.plans.scoring_queries import PROB_SQL
from gaugework.plans.scratch import materialize, shared_dir
from gaugework.plans.slice_queries import ERR_SQL
from gaugework.plans.tables import FEATURES as X
from gaugework.plans.tables import confusion_sql, rates_sql
from gaugework.plans.tables import event_examples as E
from gaugework.sources.tables import evidence_rows
from gaugework.streaming import replay as S

R = Registry()
_TIME = lambda: F.unix_micros("ts")

R.add(
    "m1_linear_scores", lambda s, d: E(s, d).select("row_id", M.linear_score([0.04, -0.01, 0.02], -1.5)(*[F.col(x) for x in X]).alias("p"), M.linear_score([0.04, -0.01, 0.02], -1.5, (1.2, 0.1))(*[F.col(x) for x in X]).alias("calibrated")),
    "SELECT row_id, 1 / (1 + exp(-z)) AS p, 1 / (1 + exp(-least(greatest(z * 1.2 + 0.1, -40.0), 40.0))) AS calibrated FROM (SELECT row_id, least(greatest(0.04 * x1 - 0.01 * x2 + 0.02 * x3 - 1.5, -40.0), 40.0) AS z FROM e)", "p calibrated",
)
R.queries["m2_logistic_scores"] = lambda s, d: E(s, d).select("row_id", M.linear_score(*M.fit_logistic(E(s, d), X))(*[F.col(x) for x in X]).alias("p"))
R.queries["m3_training_outputs"] = lambda s, d: N.outputs(N.train(E(s, d), X), X)


def _training_checks(s, d, oversample=None) -> DataFrame:
    """The checks of a pipeline whose stages were written out and read back."""
    made = N.train(E(s, d), X, oversample=oversample)
    return N.checks(made, X, reread=materialize(made.stages, "stages"))


_CLAIMS = [*(f"optimum logistic {x}" for x in ("intercept", *X)), "optimum platt slope", "optimum platt offset", "threshold has the best F1", *(f"sets cover at {a}" for a in (0.05, 0.1, 0.2, 0.3)), "stages reread score alike"]
_CLAIMS_SQL = f"SELECT unnest({_CLAIMS}) AS claim, count(*) > 0 AS ok FROM e"
R.add("m3_training_checks", _training_checks, _CLAIMS_SQL)
R.add("m3_oversampled_training_checks", lambda s, d: _training_checks(s, d, 0.9), _CLAIMS_SQL)
_claimed = lambda *claims: f"SELECT unnest({[*claims]}) AS claim, count(*) > 0 AS ok FROM e"
_PARAMETERS = ("intercept", *X)
R.add("m2_logistic_optimum", lambda s, d: N.at_optimum(N.tall("logistic", N.logistic_slopes(E(s, d), X, *M.fit_logistic(E(s, d), X)))), _claimed(*(f"optimum logistic {x}" for x in _PARAMETERS)))


def _distilled_optimum(s, d) -> DataFrame:
    """A student's targets are half label, half teacher."""
    e = E(s, d)
    return N.at_optimum(N.tall("student", N.logistic_slopes(e.withColumn("label", 0.5 * F.col("label") + 0.5 * F.col("p")), X, *M.distill(e, X, F.col("p")))))


R.add("m11_distilled_optimum", _distilled_optimum, _claimed(*(f"optimum student {x}" for x in _PARAMETERS)))
R.add("c1_platt_optimum", lambda s, d: N.at_optimum(N.tall("platt", N.platt_slopes(E(s, d), *M.fit_platt(E(s, d))))), _claimed("optimum platt slope", "optimum platt offset"))
R.add("c2_isotonic_blocks", lambda s, d: N.block_means(E(s, d), M.isotonic(E(s, d), E(s, d))), _claimed("values are block means", "values rise with scores"))
R.queries["m3_train_pipeline"] = lambda s, d: M.train_pipeline(E(s, d), X)[1]
R.queries["m4_cross_validation"] = lambda s, d: M.cross_validate(E(s, d), X)
R.queries["m4_cross_validation_summary"] = lambda s, d: M.cross_validation_summary(M.cross_validate(E(s, d), X))
R.queries["m5_m6_random_search"] = lambda s, d: M.random_search(E(s, d), X)
R.queries["m5_shared_search"] = lambda s, d: shared_search(E(s, d), X)
R.queries["m6_model_queue"] = lambda s, d: M.model_queue(E(s, d), X)
R.queries["m7_learning_curve"] = lambda s, d: M.learning_curve(E(s, d), X)
R.queries["m8_committee_stability"] = lambda s, d: M.committee_stability(M.committee(E(s, d), X))
R.queries["m10_stacked"] = lambda s, d: M.stacked(_panel(s, d), M.stack_weights(_panel(s, d)))
R.queries["m11_distilled_scores"] = lambda s, d: E(s, d).select("row_id", M.linear_score(*M.distill(E(s, d), X, F.col("p")))(*[F.col(x) for x in X]).alias("p"))
R.queries["c1_c2_calibration_repair"] = lambda s, d: M.calibration_repair(E(s, d))
R.queries["d2_adversarial_validation"] = lambda s, d: M.adversarial_validation(order_split(E(s, d), _TIME()), X)
R.queries["d2_shift_drivers"] = lambda s, d: M.shift_drivers(order_split(E(s, d), _TIME()).withColumn("x2", F.when(F.col("side") == "current", F.col("x2") + 30).otherwise(F.col("x2"))), X)
R.queries["d3_holdout_reliance"] = lambda s, d: M.holdout_reliance(E(s, d), X, _TIME())
R.queries["d3_chronological_holdout"] = lambda s, d: M.chronological_holdout(E(s, d), X, _TIME())


def _panel(s, d) -> DataFrame:
    """Three members' scores of every event, in long form."""
    cells = [("a", F.col("p"), 1.0), ("b", F.col("p") * 0.8 + 0.1, 2.0), ("c", F.round(1 / (1 + F.exp(-(F.col("x1") - 40) / 30)), 6), 0.5)]
    return E(s, d).select("row_id", "label", F.inline(F.array(*[F.struct(F.lit(m).alias("model"), p.alias("p"), F.lit(w).alias("weight")) for m, p, w in cells])))


R.add(
    "m9_fused_scores", lambda s, d: M.fuse(_panel(s, d)),
    """WITH m AS (SELECT row_id, p, 1.0 AS w FROM e UNION ALL SELECT row_id, p * 0.8 + 0.1, 2.0 FROM e UNION ALL SELECT row_id, round(1 / (1 + exp(-(x1 - 40) / 30)), 6), 0.5 FROM e)
 SELECT row_id, count(*) AS models, avg(p) AS mean_p, median(p) AS median_p, avg((p >= 0.5)::INT) AS vote, sum(w * p) / sum(w) AS weighted_p, stddev_pop(p) AS disagreement FROM m GROUP BY row_id""",
    "mean_p median_p vote weighted_p disagreement",
)


def _trials(s, d) -> DataFrame:
    """A trial history derived from the events: one trial for each value of x3."""
    e = E(s, d)
    bins = calibration_bins(e, 5, ["x3"]).groupBy("x3").agg(F.sum(F.col("weight") * F.abs(F.col("accuracy") - F.col("confidence"))).alias("ece"))
    t = with_rates(e.groupBy("x3").agg(*confusion_aggs(0.5), *probability_aggs())).join(bins, "x3")
    i = F.col("x3").cast("int")
    return t.select(i.alias("trial_index"), F.when(i % 2 == 0, "logistic").otherwise("trees").alias("backend"), F.when(i < 5, "linear").otherwise("quadratic").alias("feature_map"), "f1", "accuracy", F.col("log_loss").alias("validation_loss"), F.col("brier").alias("brier_score"), "ece")


TRIALS_SQL = f"""tb AS (SELECT x3, sum(n / tot * abs(acc - conf)) AS ece FROM (SELECT x3, count(*) AS n, sum(count(*)) OVER (PARTITION BY x3) AS tot, avg(label::DOUBLE) AS acc, avg(p) AS conf FROM e GROUP BY x3, least(floor(p * 5), 4)) GROUP BY x3),
 tm AS (SELECT x3, {confusion_sql()}, {PROB_SQL} FROM e GROUP BY x3), tr AS (SELECT x3, brier, log_loss, {rates_sql()} FROM tm),
 trials AS (SELECT CAST(x3 AS INT) AS trial_index, CASE WHEN CAST(x3 AS INT) % 2 = 0 THEN 'logistic' ELSE 'trees' END AS backend, CASE WHEN x3 < 5 THEN 'linear' ELSE 'quadratic' END AS feature_map, f1, accuracy, log_loss AS validation_loss, brier AS brier_score, ece FROM tr JOIN tb USING (x3)),
 board AS (SELECT *, CAST(row_number() OVER w AS INT) AS rank, f1 - lead(f1) OVER w AS margin FROM trials WINDOW w AS (ORDER BY round(f1, 9) DESC, round(accuracy, 9) DESC, round(validation_loss, 9), trial_index)),
 fam AS (SELECT backend, feature_map, count(*) AS trials, max(f1) AS best_f1, avg(f1) AS mean_f1, min(validation_loss) AS best_loss FROM trials GROUP BY 1, 2)"""
R.add("m12_leaderboard", lambda s, d: K.leaderboard(_trials(s, d)), f"WITH {TRIALS_SQL} SELECT * FROM board WHERE rank <= 6", "f1 accuracy validation_loss brier_score ece margin")
R.add("m12_families", lambda s, d: K.families(_trials(s, d)), f"WITH {TRIALS_SQL} SELECT * FROM fam", "best_f1 mean_f1 best_loss")
TRIAL_EV_SQL = f"""{TRIALS_SQL}, ft AS (SELECT * FROM board WHERE rank = 1), ev AS (SELECT 'trials' AS entity, 'trials' AS source, unnest(['best_f1', 'leader_margin', 'accuracy_gap', 'calibration_level', 'trials', 'backends', 'feature_maps', 'family_lead']) AS metric,
 unnest([f1, margin, accuracy - f1, (brier_score >= 0.22 OR ece >= 0.08)::INT::DOUBLE, (SELECT count(*) FROM trials)::DOUBLE, (SELECT count(DISTINCT backend) FROM trials)::DOUBLE, (SELECT count(DISTINCT feature_map) FROM trials)::DOUBLE, (SELECT b[1] - b[2] FROM (SELECT list_sort(list(best_f1), 'DESC') AS b FROM fam))]) AS value FROM ft)"""


def _rules_sql(rules) -> str:
    num = lambda v: f"'{'-' if v < 0 else ''}Infinity'::DOUBLE" if abs(v) == float("inf") else f"{float(v)}::DOUBLE"
    rows = ", ".join("(" + ", ".join([*(repr(x) for x in r[:3]), *(num(v) for v in r[3:9]), *(repr(x) for x in r[9:])]) + ")" for r in rules)
    return f"rules AS (SELECT * FROM (VALUES {rows}) v(rule, source, metric, low, high, base, slope, cap, block_from, category, action)), hits AS (SELECT entity, rule, category, action, value, least(cap, base + slope * value) AS points, value >= block_from AS blocking FROM ev JOIN rules USING (source, metric) WHERE value >= low AND value < high)"


_TOTALS_SQL = "tot AS (SELECT x.entity, coalesce(penalty, 0) AS penalty, coalesce(blockers, 0) AS blockers, coalesce(cautions, 0) AS cautions, greatest(0.0, 100 - coalesce(penalty, 0)) AS score FROM (SELECT DISTINCT entity FROM ev) x LEFT JOIN (SELECT entity, sum(points) AS penalty, count(*) FILTER (blocking) AS blockers, count(*) FILTER (NOT blocking) AS cautions FROM hits GROUP BY 1) USING (entity))"


def _evidence(s, d) -> DataFrame:
    """Evidence of every segment, from audits and metrics of its events."""
    e = E(s, d)
    m = with_rates(e.groupBy("segment").agg(F.count("*").alias("n"), F.least(F.count_if(F.col("label") == 1), F.count_if(F.col("label") == 0)).alias("minority"), *confusion_aggs(0.5), *probability_aggs()))
    ece = calibration_bins(e, 10, ["segment"]).groupBy("segment").agg(F.sum(F.col("weight") * F.abs(F.col("accuracy") - F.col("confidence"))).alias("ece"))
    dup = e.groupBy("segment", "x2", "x3").agg(F.count("*").alias("c"), F.min("label").alias("lo"), F.max("label").alias("hi")).groupBy("segment").agg(F.sum(F.col("c") - 1).alias("dups"), F.sum(F.when(F.col("lo") != F.col("hi"), F.col("c")).otherwise(0)).alias("conf"))
    err = error_summary(e, by=["segment"]).select("segment", "high_confidence_errors")
    t = m.join(ece, "segment").join(dup, "segment").join(err, "segment")
    level = F.when((F.col("ece") >= 0.12) | (F.col("brier") >= 0.28), 2.0).when((F.col("ece") >= 0.08) | (F.col("brier") >= 0.22), 1.0).otherwise(0.0)
    worst = F.least("f1", "balanced_accuracy")
    values = {
        ("audit", "n"): F.col("n"), ("audit", "minority"): F.col("minority"), ("audit", "imbalance_ratio"): (F.col("n") - F.col("minority")) / F.greatest("minority", F.lit(1)), ("audit", "duplicate_rows"): F.col("dups"), ("audit", "conflicting_rows"): F.col("conf"),
        ("metrics", "f1"): F.col("f1"), ("metrics", "worst_of_f1_and_balanced"): worst, ("metrics", "f1_if_not_weak"): F.when(worst >= 0.6, F.col("f1")), ("metrics", "accuracy_gap"): F.col("accuracy") - F.col("f1"), ("metrics", "calibration_level"): level,
        ("metrics", "recall_lag"): F.when(F.col("recall") < 0.55, F.col("precision") - F.col("recall")), ("errors", "high_confidence_errors"): F.col("high_confidence_errors"),
    }
    rows = [F.struct(F.lit(a).alias("source"), F.lit(b).alias("metric"), v.cast("double").alias("value")) for (a, b), v in values.items()]
    return t.select(F.col("segment").alias("entity"), F.inline(F.array(*rows))).where("value is not null")


EVIDENCE_SQL = f"""mm AS (SELECT segment, {rates_sql()}, n, minority, brier FROM (SELECT segment, count(*) AS n, least(count(*) FILTER (label = 1), count(*) FILTER (label = 0)) AS minority, {confusion_sql()}, {PROB_SQL} FROM e GROUP BY segment)),
 ec AS (SELECT segment, sum(c / tot * abs(acc - conf)) AS ece FROM (SELECT segment, count(*) AS c, sum(count(*)) OVER (PARTITION BY segment) AS tot, avg(label::DOUBLE) AS acc, avg(p) AS conf FROM e GROUP BY segment, least(floor(p * 10), 9)) GROUP BY segment),
 dp AS (SELECT segment, sum(c - 1) AS dups, sum(CASE WHEN lo <> hi THEN c ELSE 0 END) AS conf FROM (SELECT segment, x2, x3, count(*) AS c, min(label) AS lo, max(label) AS hi FROM e GROUP BY 1, 2, 3) GROUP BY 1), {ERR_SQL}, eh AS (SELECT segment, count(*) FILTER (wrong AND confidence >= 0.8) AS hce FROM er JOIN (SELECT row_id, segment FROM e) USING (row_id) GROUP BY 1),
 al AS (SELECT * FROM mm JOIN ec USING (segment) JOIN dp USING (segment) JOIN eh USING (segment)),
 ev AS (SELECT * FROM (SELECT segment AS entity, unnest(['audit', 'audit', 'audit', 'audit', 'audit', 'metrics', 'metrics', 'metrics', 'metrics', 'metrics', 'metrics', 'errors']) AS source, unnest(['n', 'minority', 'imbalance_ratio', 'duplicate_rows', 'conflicting_rows', 'f1', 'worst_of_f1_and_balanced', 'f1_if_not_weak', 'accuracy_gap', 'calibration_level', 'recall_lag', 'high_confidence_errors']) AS metric,
 unnest([n::DOUBLE, minority::DOUBLE, (n - minority) / greatest(minority, 1), dups::DOUBLE, conf::DOUBLE, f1, least(f1, balanced_accuracy), CASE WHEN least(f1, balanced_accuracy) >= 0.6 THEN f1 END, accuracy - f1, CASE WHEN ece >= 0.12 OR brier >= 0.28 THEN 2.0 WHEN ece >= 0.08 OR brier >= 0.22 THEN 1.0 ELSE 0.0 END, CASE WHEN recall < 0.55 THEN precision - recall END, hce::DOUBLE]) AS value FROM al) WHERE value IS NOT NULL)"""
R.add("k_evidence", _evidence, f"WITH {EVIDENCE_SQL} SELECT * FROM ev", "value")
R.add(
    "k1_triage", lambda s, d: K.triage(_evidence(s, d), K.rules_table(s, K.TRIAGE_RULES)),
    f"WITH {EVIDENCE_SQL}, {_rules_sql(K.TRIAGE_RULES)}, {_TOTALS_SQL} SELECT entity, score AS readiness, blockers, CASE WHEN score < 55 OR blockers >= 2 THEN 'high' WHEN score < 78 OR blockers > 0 THEN 'medium' ELSE 'low' END AS risk FROM tot", "readiness",
)
R.add(
    "k1_k4_triage_actions", lambda s, d: K.ranked_actions(K.fired(_evidence(s, d), K.rules_table(s, K.TRIAGE_RULES))),
    f"WITH {EVIDENCE_SQL}, {_rules_sql(K.TRIAGE_RULES)}, b AS (SELECT entity, action, bool_or(blocking) AS blocking, max(points) AS points FROM hits GROUP BY 1, 2) SELECT *, CAST(row_number() OVER (PARTITION BY entity ORDER BY blocking DESC, points DESC, action) AS INT) AS rank FROM b QUALIFY row_number() OVER (PARTITION BY entity ORDER BY blocking DESC, points DESC, action) <= 5", "points",
)
R.add(
    "k2_promotion_gate", lambda s, d: K.promotion_gate(_evidence(s, d), K.rules_table(s, K.GATE_RULES)),
    f"WITH {EVIDENCE_SQL}, {_rules_sql(K.GATE_RULES)}, {_TOTALS_SQL} SELECT entity, score, blockers, cautions, CASE WHEN blockers > 0 OR score < 60 THEN 'blocked' WHEN cautions > 0 OR score < 82 THEN 'needs_review' ELSE 'promotable' END AS verdict FROM tot", "score",
)
_ADVICE = """b AS (SELECT entity, category, action, max(points) AS score FROM hits WHERE rule = 'no_data' OR entity NOT IN (SELECT entity FROM hits WHERE rule = 'no_data') GROUP BY 1, 2, 3), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY entity ORDER BY score DESC, category, action) AS INT) AS rank FROM b)
 SELECT *, CASE WHEN score >= 76 THEN 'high' WHEN score >= 54 THEN 'medium' ELSE 'low' END AS priority FROM r WHERE rank <= 8"""
R.add("k3_advice", lambda s, d: K.recommendations(_evidence(s, d), K.rules_table(s, K.ADVICE_RULES)), f"WITH {EVIDENCE_SQL}, {_rules_sql(K.ADVICE_RULES)}, {_ADVICE}", "score")
R.add("m12_k4_trial_advice", lambda s, d: K.recommendations(K.trial_evidence(_trials(s, d)), K.rules_table(s, K.TRIAL_RULES)), f"WITH {TRIAL_EV_SQL}, {_rules_sql(K.TRIAL_RULES)}, {_ADVICE}", "score")
R.queries["s9_evidence_report"] = lambda s, d: evidence_rows({"audit": P.audit(E(s, d), X), "replay": replay_verdict(shadow_replay(E(s, d), _TIME()))}, "events")


def _folder(spark) -> str:
    """A new folder for a stream's output in the shared one."""
    return f"{shared_dir(spark)}/gaugework-stream-{uuid.uuid4().hex}"


def _event_stream(s, d) -> DataFrame:
    """Events as a stream, scored as ``event_examples`` does."""
    from gaugework.functions.columns import hash_uniform

    e = S.table_stream(s, f"{d}/events.parquet")
    u = hash_uniform(F.col("event_id"), 42, "label")
    return e.select(F.col("event_id").alias("row_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("segment"), (F.col("value") > 20 + 60 * u).cast("int").alias("label"), F.round(1 / (1 + F.exp(-(F.col("value") - 50) / 25)), 6).alias("p"))


R.add(
    "d4s_window_metrics", lambda s, d: S.drain(S.window_metrics(_event_stream(s, d)), _folder(s)).withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd")),
    f"""WITH w AS (SELECT date_trunc('day', ts) AS ws, segment, count(*) AS n, {confusion_sql()}, {PROB_SQL} FROM e GROUP BY 1, 2), m AS (SELECT ws, segment, n, brier, log_loss, {rates_sql(names=('accuracy', 'f1'))} FROM w)
 SELECT strftime(ws, '%Y-%m-%d') AS window_start, segment, n, accuracy, f1, brier, log_loss FROM m WHERE ws + INTERVAL 1 DAY <= (SELECT max(ts) FROM e) - INTERVAL 10 MINUTE""",
    "accuracy f1 brier log_loss",
)
_CLOSED = """WITH o AS (SELECT segment, row_id, (p >= 0.5) <> (label = 1) AS wrong, row_number() OVER w AS place, lead(row_id) OVER w AS nxt FROM e WINDOW w AS (PARTITION BY segment ORDER BY ts, row_id)), i AS (SELECT *, place - row_number() OVER (PARTITION BY segment ORDER BY place) AS island FROM o WHERE wrong)
 SELECT segment, arg_min(row_id, place) AS start_row, count(*) AS length, last(nxt ORDER BY place) AS closed_by FROM i GROUP BY segment, island HAVING last(nxt ORDER BY place) IS NOT NULL"""
R.add("d5s_error_runs", lambda s, d: S.drain(S.error_runs(_event_stream(s, d)), _folder(s)), _CLOSED)


def _late_runs(s, d) -> DataFrame:
    """Runs from summaries of hours. A row without segment, a year after the last event, lets the watermark pass all hours."""
    beat, e = _folder(s), E(s, d)
    e.agg((F.max("ts") + F.expr("interval 1 year")).alias("ts")).select(F.lit(-1).cast("long").alias("row_id"), "ts", F.lit(None).cast("string").alias("segment"), F.lit(0).alias("label"), F.lit(0.0).alias("p")).write.parquet(beat)
    rows = _event_stream(s, d).unionByName(S.table_stream(s, beat))
    return S.joined_runs(S.drain(S.run_summaries(rows), _folder(s)).where("segment is not null"))


R.add("d5s_late_error_runs", _late_runs, _CLOSED)
