"""Declarative filters and catalog lookups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketloom.operators.scale import salted_join, scalars

# Sortable catalog columns and the page limit.
SORT_COLUMNS = [
    "popularity_score", "trend_score", "market_cap", "total_volume",
    "current_price", "price_change_percentage_24h", "name", "symbol",
]
PAGE_LIMIT = 200


def _condition(df: DataFrame, name: str, op: str, value) -> Column | None:
    """Null-free boolean column of one filter; None when the operator does not apply."""
    c = F.col(name)
    text = isinstance(df.schema[name].dataType, T.StringType)
    values = list(value) if isinstance(value, (list, tuple, set)) else [value]
    if op in ("=", "=="):
        return F.coalesce(c == F.lit(value), F.lit(False))
    if op == "!=":
        return ~c.eqNullSafe(F.lit(value))
    if op in (">", "<", ">=", "<="):
        compared = {">": c > value, "<": c < value, ">=": c >= value, "<=": c <= value}[op]
        return F.coalesce(compared, F.lit(False))
    if op == "in":
        return F.coalesce(c.isin(values), F.lit(False))
    if op == "not in":
        return ~F.coalesce(c.isin(values), F.lit(False))
    if op == "contains" and text:
        if isinstance(value, (list, tuple, set)):
            found = reduce(lambda a, b: a | b, [c.contains(str(v)) for v in values])
        else:
            found = c.rlike(str(value))
        return F.coalesce(found, F.lit(False))
    if op == "startswith" and text:
        return F.coalesce(c.startswith(str(value)), F.lit(False))
    if op == "endswith" and text:
        return F.coalesce(c.endswith(str(value)), F.lit(False))
    if op == "between" and isinstance(value, (list, tuple)) and len(value) == 2:
        return F.coalesce(c.between(value[0], value[1]), F.lit(False))
    if op == "isnull":
        return c.isNull()
    if op == "notnull":
        return c.isNotNull()
    return None


def filter_dataframe(
    df: DataFrame, filters: dict, operators: dict[str, str] | None = None, combine_with: str = "and"
) -> DataFrame:
    """Keep rows that meet all (or any) of the filters; unknown columns and operators are skipped.

    Missing values compare as in data frames: false for every test except ``!=`` and ``not in``.
    """
    operators = operators or {}
    parts = [
        _condition(df, name, operators.get(name, "=").lower(), value)
        for name, value in filters.items()
        if name in df.columns
    ]
    parts = [p for p in parts if p is not None]
    if not parts:
        return df
    both = combine_with.lower() == "and"
    return df.filter(reduce(lambda a, b: a & b if both else a | b, parts))


def catalog_query(
    items: DataFrame, category: str | None = None, chain: str | None = None, search: str | None = None,
    sort_by: str = "popularity_score", descending: bool = True, limit: int = 50, offset: int = 0,
) -> DataFrame:
    """One page of the catalog with ``total`` and ``has_more`` on every row; a page has at most ``PAGE_LIMIT`` rows."""
    if not 0 <= limit <= PAGE_LIMIT or offset < 0:
        raise ValueError(f"limit must be between 0 and {PAGE_LIMIT}, offset at least 0")
    if sort_by not in SORT_COLUMNS:
        raise ValueError(f"sort_by must be one of {SORT_COLUMNS}")
    found = items
    if category:
        found = found.filter(
            (F.col("primary_category") == category)
            | F.exists("categories", lambda c: F.lower(c) == category.lower()))
    if chain:
        found = found.filter(F.col("chain") == chain)
    if search:
        like = f"%{search}%"
        found = found.filter(
            F.col("name").ilike(like) | F.col("symbol").ilike(like) | F.col("id").cast("string").ilike(like))
    total = scalars(found, n=F.count(F.lit(1)))["n"]
    order = F.col(sort_by).desc_nulls_last() if descending else F.col(sort_by).asc_nulls_last()
    page = found.orderBy(order, F.col("id").asc()).offset(offset).limit(limit)
    return page.withColumns({"total": total, "has_more": F.lit(offset + limit) < total})


def item_lookup(items: DataFrame, item_id) -> DataFrame:
    """The row of one item; the filter reaches the scan."""
    return items.filter(F.col("id") == F.lit(item_id))


def item_with_similar(items: DataFrame, similar: DataFrame, item_id, k: int = 5) -> DataFrame:
    """An item with its ``k`` most similar ones, one row for each; a single row without partners if there are none.

    ``similar`` is a neighbour table (``i``, ``j``, ``name``, ``sim``, ``rank``); only the item's rows are read from it.
    """
    mine = similar.filter((F.col("i") == F.lit(item_id)) & (F.col("rank") <= k)).select(
        F.col("i").alias("_i"), F.col("j").alias("similar_id"), F.col("name").alias("similar_name"), "sim", "rank")
    return item_lookup(items, item_id).join(mine, F.col("id") == F.col("_i"), "left").drop("_i")


def user_history(
    interactions: DataFrame, items: DataFrame, user_id, limit: int = 50, offset: int = 0
) -> DataFrame:
    """A user's interactions with item details, newest first; the user filter runs before the join."""
    mine = interactions.filter(F.col("user_id") == F.lit(user_id))
    detail = items.select(F.col("id").alias("item_id"), "name", "symbol", "chain", "primary_category")
    return (
        salted_join(mine, detail, ["item_id"])
        .orderBy(F.col("ts").desc(), F.col("event_id").asc()).offset(offset).limit(limit)
    )
