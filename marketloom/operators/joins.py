"""Joins with type reconciliation, enrichment, portfolios and alerts (JN1-JN5), set operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketloom.functions.canonical import primary_category, primary_chain
from marketloom.operators.scale import salted_join

CARDINALITY = {"1:1": (True, True), "1:m": (True, False), "m:1": (False, True), "m:m": (False, False)}


def _has_duplicates(df: DataFrame, keys: list[str]) -> bool:
    return not df.groupBy(*keys).count().filter(F.col("count") > 1).isEmpty()


def merge_dataframes(
    left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", suffixes: tuple[str, str] = ("_x", "_y"),
    validate: str | None = None, indicator: bool = False,
) -> DataFrame:
    """Equi join with key type reconciliation, suffixes, cardinality check and a ``_merge`` indicator.

    Keys of different types become double when both are numeric, else string. Null keys match each other.
    """
    for side, name in ((left, "left"), (right, "right")):
        missing = [k for k in on if k not in side.columns]
        if missing:
            raise ValueError(f"{name} frame lacks key columns {missing}")
    for k in on:
        lt, rt = left.schema[k].dataType, right.schema[k].dataType
        if lt != rt:
            both = isinstance(lt, T.NumericType) and isinstance(rt, T.NumericType)
            common = "double" if both else "string"
            left, right = left.withColumn(k, F.col(k).cast(common)), right.withColumn(k, F.col(k).cast(common))
    if validate:
        one_left, one_right = CARDINALITY[validate]
        if one_left and _has_duplicates(left, on):
            raise ValueError(f"left keys are not unique, {validate} expected")
        if one_right and _has_duplicates(right, on):
            raise ValueError(f"right keys are not unique, {validate} expected")
    shared = [c for c in left.columns if c in right.columns and c not in on]
    lhs = left.select(
        *[F.col(k).alias(f"_l_{k}") for k in on],
        *[F.col(c).alias(c + suffixes[0] if c in shared else c) for c in left.columns if c not in on],
        F.lit(True).alias("_in_l"),
    )
    rhs = right.select(
        *[F.col(k).alias(f"_r_{k}") for k in on],
        *[F.col(c).alias(c + suffixes[1] if c in shared else c) for c in right.columns if c not in on],
        F.lit(True).alias("_in_r"),
    )
    cond = reduce(lambda a, b: a & b, [F.col(f"_l_{k}").eqNullSafe(F.col(f"_r_{k}")) for k in on])
    joined = lhs.join(rhs, cond, how)
    keys = [
        F.when(F.col("_in_l"), F.col(f"_l_{k}")).otherwise(F.col(f"_r_{k}")).alias(k) for k in on
    ]
    rest = [c for c in joined.columns if not c.startswith(("_l_", "_r_", "_in_"))]
    flag = (
        F.when(F.col("_in_l") & F.col("_in_r"), "both").when(F.col("_in_l"), "left_only").otherwise("right_only")
    )
    return joined.select(*keys, *rest, *([flag.alias("_merge")] if indicator else []))


def enrich_items(items: DataFrame, details: DataFrame) -> DataFrame:
    """Left join of item details; a detail value wins only when it is present and not empty (JN2).

    Chain and primary category follow from the detail's platforms and categories when those are given.
    """
    plain = [c for c in details.columns if c not in ("id", "categories", "platforms", "genesis_date", "description")]
    d = details.select("id", *[F.col(c).alias(f"d_{c}") for c in details.columns if c != "id"])
    joined = salted_join(items, d, ["id"], how="left")

    def base(c: str) -> Column:
        return F.col(c) if c in items.columns else F.lit(None)

    out = {c: F.coalesce(F.col(f"d_{c}"), base(c)) for c in plain}
    for c in ("genesis_date", "description"):
        if c in details.columns:
            filled = F.when(F.length(F.col(f"d_{c}").cast("string")) > 0, F.col(f"d_{c}"))
            out[c] = F.coalesce(filled, base(c))
    if "categories" in details.columns:
        given = F.size("d_categories") > 0
        out["categories"] = F.when(given, F.col("d_categories")).otherwise(base("categories"))
        out["primary_category"] = F.when(given, primary_category(F.col("d_categories"))).otherwise(
            base("primary_category"))
    if "platforms" in details.columns:
        given = F.size("d_platforms") > 0
        out["platforms"] = F.when(given, F.col("d_platforms")).otherwise(base("platforms"))
        out["chain"] = F.when(given, primary_chain(F.col("d_platforms"))).otherwise(base("chain"))
    return joined.withColumns(out).drop(*[c for c in joined.columns if c.startswith("d_")])


def portfolio_items(portfolios: DataFrame, items: DataFrame) -> DataFrame:
    """Distinct (user, item) holdings with a positive amount of known items (JN4)."""
    held = portfolios.filter(F.col("amount") > 0).select("user_id", "project_id").distinct()
    return held.join(items.select(F.col("id").alias("project_id")), "project_id", "left_semi").select(
        "user_id", "project_id")


def triggered_alerts(alerts: DataFrame, items: DataFrame) -> DataFrame:
    """Alerts whose item price is at or beyond the target, with the notification text (JN5)."""
    priced = items.filter(F.col("current_price").isNotNull()).select(
        F.col("id").alias("project_id"), "name", "current_price")
    met = ((F.col("alert_type") == "above") & (F.col("current_price") >= F.col("target_price"))) | (
        (F.col("alert_type") == "below") & (F.col("current_price") <= F.col("target_price")))
    open_alerts = alerts.filter(~F.col("is_triggered")) if "is_triggered" in alerts.columns else alerts
    title = F.concat(F.lit("Price Alert: "), F.col("name"), F.lit(" is now "), F.col("alert_type"))
    return salted_join(open_alerts, priced, ["project_id"]).filter(met).withColumns(
        {"notification_type": F.lit("price_alert"), "title": title})


def union_dedupe(sources: list[DataFrame], key: str, order: list[Column]) -> DataFrame:
    """Concatenate sources and keep the first row per key: earlier sources win, then ``order`` (S4, IO13)."""
    tagged = reduce(
        lambda a, b: a.unionByName(b, allowMissingColumns=True),
        [s.withColumn("source_rank", F.lit(n)) for n, s in enumerate(sources)],
    )
    names = [c for c in tagged.columns if c != key]
    sort = [F.col("source_rank"), *order]
    best = tagged.groupBy(key).agg(
        F.min_by(F.struct(*names), F.struct(*[c.alias(f"o{n}") for n, c in enumerate(sort)])).alias("b"))
    return best.select(key, *[F.col(f"b.{c}").alias(c) for c in names])


def rec_overlap(recs: DataFrame) -> DataFrame:
    """Shared items between the lists of two methods per user: ``(user_id, method_a, method_b, shared)``.

    Methods per (user, item) are few, so pairs are built from the small method set instead of a self-join.
    """
    sets = recs.groupBy("user_id", "item_id").agg(F.sort_array(F.collect_set("method")).alias("m"))
    pairs = F.flatten(F.transform(
        "m", lambda a: F.transform(F.filter("m", lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    return (
        sets.select("user_id", F.explode(pairs).alias("p"))
        .groupBy("user_id", F.col("p.a").alias("method_a"), F.col("p.b").alias("method_b"))
        .agg(F.count(F.lit(1)).alias("shared"))
    )


def except_seen(candidates: DataFrame, seen: DataFrame) -> DataFrame:
    return candidates.join(seen.select("user_id", "item_id"), ["user_id", "item_id"], "left_anti")


def top_by_market_cap(items: DataFrame, n: int) -> DataFrame:
    """Priced items by market value, missing values last (S3)."""
    return (
        items.filter(F.col("current_price") > 0)
        .orderBy(F.col("market_cap").desc_nulls_last(), F.col("id").asc()).limit(n)
    )
