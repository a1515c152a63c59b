"""The queries of the bibliography by name, each with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def _wide(df: DataFrame) -> DataFrame:
    """Whole numbers as 64 bits, so that results compare across engines."""
    return df.select(*[F.col(f"`{n}`").cast("long").alias(n) if t in ("int", "smallint", "tinyint") else F.col(f"`{n}`") for n, t in df.dtypes])


def query(sql: str | None) -> Callable[[Query], Query]:
    """Register a query under its name, with the SQL that gives the same rows."""

    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = lambda spark, base: _wide(f(spark, base))
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return keep
