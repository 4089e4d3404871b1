"""Where queries and the SQL that says the same are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE_SQL[f.__name__] = oracle
        return f

    return add


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    """Columns to six places as DuckDB has them: the millionfold is rounded, not the decimal text.

    They differ for numbers just beside the middle of two, such as 41 / 640.
    """
    return df.withColumns({c: F.round(F.col(c).cast("double") * 1e6) / 1e6 for c in columns})
