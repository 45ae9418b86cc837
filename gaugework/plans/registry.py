"""How queries and their SQL are written down."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugework.plans.tables import EVENTS_SQL, LONG_SQL

Query = Callable[[SparkSession, str], DataFrame]


def tidy(df: DataFrame) -> DataFrame:
    """Doubles rounded to 6 places, without negative zeros: what engines can agree on."""
    return df.select(*[(F.round(F.col(f"`{c}`"), 6) + F.lit(0.0)).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes])


class Registry:
    """Queries by name, with SQL where there is some."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, query: Query, sql: str | None = None, doubles: str = "", with_: str = "e") -> None:
        """``doubles`` names the columns of the SQL to round; ``with_`` the example tables (e, l) that the SQL uses."""
        self.queries[name] = lambda spark, sf_dir: tidy(query(spark, sf_dir))
        if sql is None:
            return
        tables = [t for t, use in ((EVENTS_SQL, "e" in with_ or "l" in with_), (LONG_SQL, "l" in with_)) if use]
        cols = ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in doubles.split())
        body = sql.strip()
        if tables:
            head = "WITH " + ", ".join(tables)
            body = head + ", " + body[5:] if body[:5].upper() == "WITH " else f"{head} {body}"
        self.sql[name] = f"SELECT * REPLACE ({cols}) FROM ({body})" if cols else body
