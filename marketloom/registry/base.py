"""Registration of queries and their DuckDB counterparts."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return keep


def r6(c: str | Column, name: str | None = None) -> Column:
    """Six digits, so that both engines hash the same value; negative zero becomes zero."""
    col = F.col(c) if isinstance(c, str) else c
    out = F.round(col.cast("double"), 6) + F.lit(0.0)
    return out.alias(name or c) if (name or isinstance(c, str)) else out


def r4(c: str) -> Column:
    """Four digits for money-sized values; the small shift keeps exact halves from rounding either way."""
    return (F.round(F.col(c).cast("double") + 3e-7, 4) + F.lit(0.0)).alias(c)


def four_digits(sql: str) -> str:
    return sql.replace(", 6)", " + 3e-7, 4)")
