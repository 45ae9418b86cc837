"""Queries that write files and read them back."""

from __future__ import annotations

import uuid
from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugework.operators.modeling import linear_score
from gaugework.plans import explain_queries, model_queries, profile_queries, scoring_queries, slice_queries, table_queries
from gaugework.plans.registry import Registry
from gaugework.plans.scratch import shared_dir
from gaugework.plans.table_queries import _FP, RAW_SQL, _raw
from gaugework.plans.tables import FEATURES as X
from gaugework.plans.tables import event_examples as E
from gaugework.sources import committed as C
from gaugework.sources import tables as S

R = Registry()


def _folder(spark) -> str:
    """A new folder in the shared one."""
    return f"{shared_dir(spark)}/gaugework-files-{uuid.uuid4().hex}"


def _labeled(s, d) -> DataFrame:
    """Events with planted defects through CSV files; the row's number goes along as a feature."""
    names, path = ["row_id", "x1", "x2"], _folder(s)
    C.write_csv(_raw(s, d), [*names, "label"], path)
    checked = S.with_reasons(S.read_labeled_csv(s, C.csv_data(s, path, [*names, "label"])), names)
    good = F.col("reason").isNull()
    return checked.select(F.col("row_id").cast("long"), *[F.when(good, F.col(c)).alias(c) for c in ("x1", "x2", "label")], "reason")


R.add("s1_csv_round_trip", _labeled, f"WITH {RAW_SQL} SELECT row_id, CASE WHEN reason IS NULL THEN x1 END AS x1, CASE WHEN reason IS NULL THEN x2 END AS x2, CASE WHEN reason IS NULL THEN label END AS label, reason FROM chk", "x1 x2")


def _unlabeled(s, d) -> DataFrame:
    """Events without labels through CSV files, then scored."""
    names, path = ["row_id", *X], _folder(s)
    C.write_csv(E(s, d), names, path)
    rows = S.valid_rows(S.with_reasons(S.read_unlabeled_csv(s, C.csv_data(s, path, names)), names, label=None))
    return rows.select(F.col("row_id").cast("long"), linear_score([0.04, -0.01, 0.02], -1.5)(*[F.col(x) for x in X]).alias("p"))


R.add("s2_csv_batch_scores", _unlabeled, "SELECT row_id, 1 / (1 + exp(-(0.04 * x1 - 0.01 * x2 + 0.02 * x3 - 1.5))) AS p FROM e", "p")


def _json(s, d) -> DataFrame:
    path = _folder(s)
    C.write_documents(E(s, d), X, path)
    return C.read_documents(s, path)


R.add("s5_json_round_trip", _json, "SELECT row_id, label, x1, x2, x3 FROM e", "x1 x2 x3")


def _bundle(s, d) -> DataFrame:
    """Examples, probes, policies and metadata through a bundle: the fingerprint of each table read back."""
    e, path = E(s, d), _folder(s)
    by_class = e.groupBy().agg(*[F.avg(F.when(F.col("label") == y, F.col(x))).alias(f"{x}_{y}") for x in X for y in (0, 1)])
    rises = by_class.select(F.inline(F.array(*[F.struct(F.lit(x).alias("feature"), F.when(F.col(f"{x}_1") >= F.col(f"{x}_0"), 1).otherwise(-1).alias("direction")) for x in X])))
    meta = e.agg(*[F.round(F.avg(x), 3).alias(x) for x in X]).select(F.inline(F.array(*[F.struct(F.lit(x).alias("feature"), F.col(x).alias("default")) for x in X])))
    S.write_bundle(path, e.select("row_id", *X, "label"), e.where("p >= 0.9").select("row_id", *X), rises, meta)
    out = None
    for name, df in S.read_bundle(s, path).items():
        one = S.fingerprint(df, df.columns).withColumn("part", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


_D = lambda c: f"{c}::DECIMAL(30,8)::VARCHAR"
_XS = " || '|' || ".join(_D(x) for x in X)
_RISES = " UNION ALL ".join(f"SELECT '{x}' AS feature, CASE WHEN avg({x}) FILTER (label = 1) >= avg({x}) FILTER (label = 0) THEN 1 ELSE -1 END AS direction FROM e" for x in X)
_META = " UNION ALL ".join(f"SELECT '{x}' AS feature, round(avg({x}), 3) AS v FROM e" for x in X)
R.add(
    "s6_bundle_round_trip", _bundle,
    f"""WITH h AS (SELECT 'examples' AS part, {_FP.format(f"row_id::VARCHAR || '|' || {_XS} || '|' || label::VARCHAR")} AS h FROM e UNION ALL SELECT 'probes', {_FP.format(f"row_id::VARCHAR || '|' || {_XS}")} FROM e WHERE p >= 0.9
 UNION ALL SELECT 'policies', {_FP.format("feature || '|' || direction::VARCHAR")} FROM ({_RISES}) UNION ALL SELECT 'meta', {_FP.format("feature || '|' || " + _D('v'))} FROM ({_META}))
 SELECT part, count(*) AS rows, sum(h)::VARCHAR AS hash_sum, bit_xor(h) AS hash_xor FROM h GROUP BY part""",
)

#: The report's sections, and the query that each holds.
SECTIONS = {
    "class_counts": "a1_class_balance", "audit": "a6_audit", "metrics": "e1_confusion", "probability_metrics": "e2_probability_metrics", "ranking_metrics": "e3_e4_ranking_metrics", "intervals": "b1_bootstrap_intervals",
    "ablation": "x2_ablation", "decision_curve": "t3_decision_curve", "conformal": "u1_u4_conformal_sweep", "selective": "t6_selective_risk", "sample_review": "g5_sample_review", "error_atlas": "g4_error_atlas",
    "reliability_atlas": "e10_reliability_atlas", "replay": "d4_shadow_replay", "error_runs": "d5_error_runs", "threshold": "t1_threshold_picks", "threshold_stability": "t7_threshold_stability", "capacity": "t4_capacity_plan",
    "response": "x3_response_summary", "interactions": "x4_interactions", "slices": "g1_slices", "subgroups": "g2_subgroups", "stress": "x5_stress", "permutation_null": "b2_permutation_null", "population_drift": "d1_population_drift",
    "cartography": "g6_cartography", "outliers": "n4_outliers", "canaries": "x8_canary_summary", "policies": "x9_policy_guard", "contract": "a9_contract_status", "prototypes": "n3_prototypes", "separability": "a10_separability",
    "hardness": "n2_hardness", "triage": "k1_triage", "advice": "k3_advice", "trials": "m12_leaderboard", "gate": "k2_promotion_gate", "importances": "x1_permutation_importance",
}
_FROM = [m.R for m in (scoring_queries, profile_queries, table_queries, slice_queries, explain_queries, model_queries)]
_QUERIES = {name: q for r in _FROM for name, q in r.queries.items()}
_SQL = {name: q for r in _FROM for name, q in r.sql.items()}


def _report(s, d) -> DataFrame:
    """All sections written and read back: the values of each key, and the sum of those that are numbers."""
    path, made = _folder(s), explain_queries.neighbour_reports(s, d)
    C.write_report(s, {name: partial(made.get, q) if q in made else partial(_QUERIES[q], s, d) for name, q in SECTIONS.items()}, path)
    number = F.coalesce(F.col("value").try_cast("double"), F.lit(0.0))
    return C.read_report(s, path).groupBy("section", "key").agg(F.count("*").alias("n"), F.round(F.sum(number), 3).alias("total"))


def _section_sql(name: str, query: str) -> str:
    return f"SELECT '{name}' AS section, key, count(*) AS n, round(sum(coalesce(TRY_CAST(value AS DOUBLE), 0.0)), 3) AS total FROM (UNPIVOT (SELECT COLUMNS(*)::VARCHAR FROM ({_SQL[query]})) ON COLUMNS(*) INTO NAME key VALUE value) GROUP BY key"


R.add("s9_report", _report, " UNION ALL ".join(_section_sql(n, q) for n, q in SECTIONS.items()), "total", "")
