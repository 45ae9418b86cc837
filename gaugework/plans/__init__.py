"""Example tables, shared patterns, and the registered queries with their SQL."""


def registries() -> list:
    """All registries of queries."""
    from gaugework.plans import evidence_queries, explain_queries, file_queries, model_queries, profile_queries, scoring_queries, slice_queries, table_queries

    return [m.R for m in (scoring_queries, profile_queries, table_queries, slice_queries, explain_queries, model_queries, evidence_queries, file_queries)]
