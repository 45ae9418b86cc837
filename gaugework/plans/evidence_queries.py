"""Scorecards over the evidence catalogue (K1-K4): all reports on the events and on the vectors, as the rules read them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugework.operators import evidence as V
from gaugework.operators import scorecard as K
from gaugework.plans import explain_queries, model_queries, profile_queries, scoring_queries, slice_queries, table_queries
from gaugework.plans.model_queries import _ADVICE, _TOTALS_SQL, _rules_sql
from gaugework.plans.registry import Registry
from gaugework.plans.scratch import materialize
from gaugework.plans.tables import event_examples as E
from gaugework.sources.tables import fingerprint, reusable_evidence

R = Registry()
_FROM = [m.R for m in (scoring_queries, profile_queries, table_queries, slice_queries, explain_queries, model_queries)]
_QUERIES = {name: q for r in _FROM for name, q in r.queries.items()}
_SQL = {name: q for r in _FROM for name, q in r.sql.items()}
#: Reports on the embeddings; all others are on the events.
_VECTORS = ("n2_hardness", "n3_prototypes", "n4_outliers")
_EXPECTED = {"events": ("t1_threshold_picks", "a6_audit", "e1_confusion"), "vectors": ()}


def _measures(rules: Sequence[tuple]) -> dict[str, list[V.Measure]]:
    """By entity, the measures that the rules read, of reports that SQL can express and that are on its table."""
    own = [m for m in V.needed(rules) if m.report in _SQL and m.report != "k1_triage"]
    kinds = {"events": [m for m in own if m.report not in _VECTORS], "vectors": [m for m in own if m.report in _VECTORS]}
    return {e: ms for e, ms in kinds.items() if ms}


def evidence(s, d, rules: Sequence[tuple]) -> DataFrame:
    """The evidence of events and vectors that ``rules`` read, written out once."""
    parts = []
    for entity, measures in _measures(rules).items():
        names = {m.report for m in measures}
        reports = explain_queries.neighbour_reports(s, d) if names >= {"n2_hardness", "n3_prototypes"} else {}
        reports |= {name: _QUERIES[name](s, d) for name in dict.fromkeys(m.report for m in measures) if name not in reports}
        if "t1_threshold_picks" in {m.unless for m in measures}:
            reports["t1_threshold_picks"] = _QUERIES["t1_threshold_picks"](s, d)
        parts.append(V.catalogue(reports, entity, measures, [r for r in _EXPECTED[entity] if V.MISSING[r] not in {(x.source, x.metric) for x in measures} and r not in reports and r != "t1_threshold_picks"]))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return materialize(out, "evidence")


def _evidence_sql(rules: Sequence[tuple]) -> str:
    selects = []
    for entity, measures in _measures(rules).items():
        for name in dict.fromkeys(m.report for m in measures):
            own = [m for m in measures if m.report == name and not m.unless]
            if own:
                values = ", ".join(f"({m.value})::DOUBLE" for m in own)
                names = ", ".join(f"'{m.source}'" for m in own), ", ".join(f"'{m.metric}'" for m in own)
                selects.append(f"SELECT '{entity}' AS entity, unnest([{names[0]}]) AS source, unnest([{names[1]}]) AS metric, unnest(v) AS value FROM (SELECT [{values}] AS v FROM ({_SQL[name]}))")
    return f"ev AS MATERIALIZED (SELECT entity, source, metric, max(value) AS value FROM ({' UNION ALL '.join(selects)}) WHERE value IS NOT NULL GROUP BY 1, 2, 3)"


def _gated(s, d) -> DataFrame:
    """Evidence of the audit and the metrics with its fingerprint, beside older evidence of a smaller table, which the gate drops."""
    rules = [r for r in K.GATE_RULES if r[1] in ("audit", "metrics")]
    columns = ["row_id", "x1", "x2", "x3", "label"]
    now = fingerprint(E(s, d), columns)
    old = V.catalogue({"e1_confusion": _QUERIES["e1_confusion"](s, d).withColumn("f1", F.lit(0.0))}, "events", V.needed(rules))
    stored = V.stamped(evidence(s, d, rules), now).unionByName(V.stamped(old, fingerprint(E(s, d).where("segment <> 'error'"), columns)))
    return reusable_evidence(stored, now).select("entity", "source", "metric", "value")


R.add("v4_gated_evidence", _gated, f"WITH {_evidence_sql([r for r in K.GATE_RULES if r[1] in ('audit', 'metrics')])} SELECT * FROM ev", "value", "")
R.add(
    "k1_catalogue_triage", lambda s, d: K.triage(evidence(s, d, K.TRIAGE_RULES), K.rules_table(s, K.TRIAGE_RULES)),
    f"WITH {_evidence_sql(K.TRIAGE_RULES)}, {_rules_sql(K.TRIAGE_RULES)}, {_TOTALS_SQL} SELECT entity, score AS readiness, blockers, CASE WHEN score < 55 OR blockers >= 2 THEN 'high' WHEN score < 78 OR blockers > 0 THEN 'medium' ELSE 'low' END AS risk FROM tot", "readiness", "",
)
R.add(
    "k2_catalogue_gate", lambda s, d: K.promotion_gate(evidence(s, d, K.GATE_RULES), K.rules_table(s, K.GATE_RULES)),
    f"WITH {_evidence_sql(K.GATE_RULES)}, {_rules_sql(K.GATE_RULES)}, {_TOTALS_SQL} SELECT entity, score, blockers, cautions, CASE WHEN blockers > 0 OR score < 60 THEN 'blocked' WHEN cautions > 0 OR score < 82 THEN 'needs_review' ELSE 'promotable' END AS verdict FROM tot", "score", "",
)
R.add("k3_catalogue_advice", lambda s, d: K.recommendations(evidence(s, d, K.ADVICE_RULES), K.rules_table(s, K.ADVICE_RULES)), f"WITH {_evidence_sql(K.ADVICE_RULES)}, {_rules_sql(K.ADVICE_RULES)}, {_ADVICE}", "score", "")
