"""Pivots, time buckets, correlation, counts and reports."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketloom.operators.scale import (
    average_ranks, dense_codes, modes, null_safe_join, quantiles, range_bucketed, salted_join, scalars, top_k,
)

SIMPLE_AGGS: dict[str, Callable[[str], Column]] = {
    "mean": F.avg, "sum": F.sum, "min": F.min, "max": F.max, "std": F.stddev_samp, "var": F.var_samp,
    "count": lambda c: F.count(F.lit(1)),
}


Builder = Callable[[str], Column]  # column name -> aggregate


def pivot_table(
    df: DataFrame, index: Sequence[str], columns: str, values: str, aggfunc: str | Builder = "mean", fill_value=None,
    order: str | None = None, dropna: bool = True,
) -> DataFrame:
    """Pivot with mean, median, sum, count, min, max, std, var, first or last, or a function of the caller (A1).

    A function gets the name of the value column and returns an aggregate column. ``first`` and ``last`` need an ``order``
    column. Rows are aggregated per cell before anything is pivoted; with ``dropna`` columns without a value are left out.
    """
    keys = [*index, columns]
    if callable(aggfunc):
        cells = df.groupBy(*keys).agg(aggfunc(values).alias("_v"))
    elif aggfunc == "median":
        cells = quantiles(df, [values], [0.5], keys=keys).select(*keys, F.col("value").alias("_v"))
    elif aggfunc in ("first", "last"):
        pick = F.min_by if aggfunc == "first" else F.max_by
        cells = df.groupBy(*keys).agg(pick(values, order).alias("_v"))
    else:
        cells = df.groupBy(*keys).agg(SIMPLE_AGGS[aggfunc](values).alias("_v"))
    cells = cells.filter(F.col(columns).isNotNull())
    filled = cells.groupBy(columns).agg(F.count("_v").alias("_n"))
    made = [r[0] for r in (filled.filter("_n > 0") if dropna else filled).orderBy(columns).collect()]  # the new columns
    wide = cells.groupBy(*index).pivot(columns, made).agg(F.first("_v")) if made else cells.select(*index).distinct()
    return wide if fill_value is None else wide.fillna(fill_value)


# Calendar units of the window sizes.
UNITS = {"MIN": "minute", "T": "minute", "H": "hour", "D": "day", "W": "week", "M": "month", "Q": "quarter", "Y": "year"}
MONTHS = {"month": 1, "quarter": 3, "year": 12}


def time_bucket(ts: Column, size: str) -> Column:
    """Start of the calendar bucket (``15min``, ``5T``, ``1D``, ``1W`` from Monday, ``2M``, ``1Q`` ...).

    Multiples of minutes to weeks count from 1970-01-01 (weeks: from the first Monday), multiples of months, quarters and
    years from January 1970. Unknown units raise ``ValueError``.
    """
    number = int("".join(ch for ch in size if ch.isdigit()) or 1)
    unit = UNITS.get(size.lstrip("0123456789").upper())
    if unit is None or number < 1:
        raise ValueError(f"unknown window size {size!r}")
    if number == 1:
        return F.date_trunc(unit, ts)
    if unit in MONTHS:
        step = number * MONTHS[unit]
        months = (F.year(ts) - 1970) * 12 + F.month(ts) - 1
        return F.add_months(F.lit("1970-01-01").cast("date"), months - F.pmod(months, F.lit(step))).cast("timestamp")
    offset = "4 days" if unit == "week" else "0 days"
    return F.window(ts, f"{number} {unit}", startTime=offset)["start"]


def time_windows(
    df: DataFrame, date_column: str, window_size: str = "1D", groupby: Sequence[str] = (),
    agg: dict[str, Sequence[str | tuple[str, Builder]]] | None = None,
) -> DataFrame:
    """Tumbling buckets with ``<column>_<aggregate>`` columns (A2).

    Aggregates are names, or pairs of a name and a function that gets the column name and returns an aggregate column.
    Default aggregates: mean, min, max, std for numbers, mode and nunique for text. Modes come from distributed value
    counts, so a bucket's values are never gathered.
    """
    stamped = df.withColumn("time_window", time_bucket(F.col(date_column).try_cast("timestamp"), window_size))
    stamped = stamped.filter(F.col("time_window").isNotNull())
    keys = ["time_window", *groupby]
    if agg is None:
        agg = {}
        for f in df.schema:
            if f.name in (date_column, *groupby):
                continue
            if isinstance(f.dataType, T.NumericType):
                agg[f.name] = ["mean", "min", "max", "std"]
            elif isinstance(f.dataType, T.StringType):
                agg[f.name] = ["mode", "nunique"]
    fns = {**SIMPLE_AGGS, "nunique": F.countDistinct, "count": F.count}
    named = lambda a: a if isinstance(a, tuple) else (a, fns[a])
    wanted = [(c, *named(a)) for c, names in agg.items() for a in names if a != "mode"]
    out = stamped.groupBy(*keys).agg(
        *[build(c).alias(f"{c}_{name}") for c, name, build in wanted],
        F.count(F.lit(1)).alias("_rows"),
    ).drop("_rows")
    for c, names in agg.items():
        if "mode" in names:
            out = null_safe_join(out, modes(stamped, c, keys).withColumnRenamed(c, f"{c}_mode"), keys, "left")
    return out


# Rows kept per requested period; ``all`` has no limit.
PERIOD_ROWS = {"1d": 24, "7d": 168, "30d": 720, "90d": 2160, "1y": 8760, "all": None}


def history_buckets(prices: DataFrame, interval: str = "1h", period: str = "7d") -> DataFrame:
    """Latest rows or buckets per series (A3): ``1h`` raw, ``4h`` every fourth hour, ``1d`` and ``1w`` aggregated.

    The period limits rows, not time. Output is unordered; sort by timestamp when showing one series.
    """
    if period not in PERIOD_ROWS or interval not in ("1h", "4h", "1d", "1w"):
        raise ValueError(f"unknown period {period!r} or interval {interval!r}")
    if interval == "4h":
        rows = prices.filter(F.hour("timestamp") % 4 == 0)
    elif interval in ("1d", "1w"):
        unit = "day" if interval == "1d" else "week"
        rows = prices.groupBy("project_id", F.date_trunc(unit, "timestamp").alias("timestamp")).agg(
            F.avg("price").alias("price"), F.sum("volume").alias("volume"), F.max("market_cap").alias("market_cap"))
    else:
        rows = prices
    rows = rows.select("project_id", "timestamp", "price", "volume", "market_cap")
    limit = PERIOD_ROWS[period]
    if limit is None:
        return rows
    return top_k(rows, ["project_id"], [F.col("timestamp").desc()], limit, "_r").drop("_r")


def name_counts(items: DataFrame, column: str) -> DataFrame:
    """Items per category or chain without null and 'unknown' (A4)."""
    return (
        items.filter(F.col(column).isNotNull() & (F.col(column) != "unknown"))
        .groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.asc(column))
    )


def user_item_max(interactions: DataFrame, catalog: DataFrame | None = None) -> DataFrame:
    """One rating per (user, item), the largest weight; optionally only for catalog items (A5)."""
    rows = interactions
    if catalog is not None:
        rows = rows.join(catalog.select(F.col("id").alias("item_id")), "item_id", "left_semi")
    return rows.groupBy("user_id", "item_id").agg(F.max("weight").cast("double").alias("rating"))


def interaction_stats(interactions: DataFrame) -> DataFrame:
    """Mean distinct items per user and users per item (A6), from distinct pairs counted once."""
    pairs = interactions.select("user_id", "item_id").distinct()
    return pairs.agg(
        (F.count(F.lit(1)) / F.countDistinct("user_id")).alias("items_per_user"),
        (F.count(F.lit(1)) / F.countDistinct("item_id")).alias("users_per_item"),
    )


def matrix_stats(ratings: DataFrame) -> DataFrame:
    """Filled cells, matrix size and sparsity."""
    return ratings.agg(
        F.count(F.lit(1)).alias("filled"),
        F.countDistinct("user_id").alias("n_users"),
        F.countDistinct("item_id").alias("n_items"),
    ).withColumn("sparsity", 1 - F.col("filled") / (F.col("n_users") * F.col("n_items")))


def histogram(df: DataFrame, column: str, low: float, high: float, bins: int) -> DataFrame:
    """Counts per equal-width bin 1..bins, the upper bound included in the last bin."""
    width = (high - low) / bins
    b = F.least(F.floor((F.col(column) - low) / width) + 1, F.lit(bins))
    return df.filter(F.col(column).between(low, high)).groupBy(b.cast("int").alias("bin")).agg(
        F.count(F.lit(1)).alias("n"))


def correlation(
    df: DataFrame, columns: list[str] | None = None, method: str = "pearson", min_periods: int = 1
) -> DataFrame:
    """Correlation of column pairs as rows ``(a, b, n, corr)`` over complete observations.

    Pearson is one aggregation over all pairs. Spearman replaces values by average ranks first. Kendall is tau-b from
    exact distributed inversion counts.
    """
    cols = columns or [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]
    pairs = [(a, b) for n, a in enumerate(cols) for b in cols[n + 1:]]
    if method == "kendall":
        out = None
        for a, b in pairs:
            one = kendall(df, a, b).select(F.lit(a).alias("a"), F.lit(b).alias("b"), "n", "corr")
            out = one if out is None else out.unionByName(one)
        return out.withColumn("corr", F.when(F.col("n") >= min_periods, F.col("corr")))
    if method == "spearman":
        out = None
        for a, b in pairs:  # ranks are taken over the rows where both values exist
            both = df.select(a, b).dropna()
            ranked = both
            for c in (a, b):
                ranks = average_ranks(both, c).select(c, F.col("rank").alias(f"_r_{c}"))
                ranked = salted_join(ranked, ranks, [c])
            one = ranked.agg(F.count(F.lit(1)).alias("n"), F.corr(f"_r_{a}", f"_r_{b}").alias("corr")).select(
                F.lit(a).alias("a"), F.lit(b).alias("b"), "n", "corr")
            out = one if out is None else out.unionByName(one)
        return out.withColumn("corr", F.when(F.col("n") >= min_periods, F.col("corr")))
    both = lambda a, b: F.col(a).isNotNull() & F.col(b).isNotNull()
    row = df.agg(
        F.array(*[
            F.struct(
                F.lit(a).alias("a"), F.lit(b).alias("b"), F.count(F.when(both(a, b), 1)).alias("n"),
                F.corr(a, b).alias("corr"))
            for a, b in pairs
        ]).alias("all")
    )
    return row.select(F.explode("all").alias("p")).select(
        "p.a", "p.b", "p.n", F.when(F.col("p.n") >= min_periods, F.col("p.corr")).alias("corr"))


def kendall(df: DataFrame, a: str, b: str) -> DataFrame:
    """Tau-b of two columns as one row ``(n, corr)``.

    Rows are sorted by (a, b) through range partitions. Two rows are discordant when the later one has the smaller
    b; that pair is counted once, at the highest bit in which their b codes differ. Each level needs only counts per
    (prefix of the code, partition), so no task holds more than one range partition of a level.
    """
    cells = df.select(F.col(a).alias("x"), F.col(b).alias("y")).dropna().groupBy("x", "y").agg(
        F.count(F.lit(1)).alias("w"))
    codes = dense_codes(cells, "y")
    coded = salted_join(cells, codes, ["y"])
    placed = range_bucketed(coded, "x", "y")
    top = scalars(placed, c=F.coalesce(F.max("_code"), F.lit(0)))["c"]
    n_bits = F.greatest(F.ceil(F.log2(top + 1)).cast("int"), F.lit(1))
    levels = placed.select(
        "x", "y", "w", "_bucket", "_code", F.explode(F.sequence(F.lit(0), n_bits - 1)).alias("bit"))
    levels = levels.withColumns(
        {
            "prefix": F.expr("shiftright(_code, bit + 1)"),
            "one": F.expr("shiftright(_code, bit) & 1"),
        }
    )
    keys = ["bit", "prefix"]
    totals = levels.groupBy(*keys, "_bucket").agg(F.sum(F.col("w") * F.col("one")).alias("t"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*keys, "_bucket", F.coalesce(F.sum("t").over(before), F.lit(0)).alias("s"))
    inner = Window.partitionBy(*keys, "_bucket").orderBy("x", "y").rowsBetween(Window.unboundedPreceding, -1)
    ones = levels.withColumn("i", F.coalesce(F.sum(F.col("w") * F.col("one")).over(inner), F.lit(0)))
    zeros = ones.filter("one = 0").join(starts, [*keys, "_bucket"])
    discordant = scalars(zeros, d=F.coalesce(F.sum(F.col("w").cast("double") * (F.col("s") + F.col("i"))), F.lit(0.0)))["d"]

    def tied(*names: str) -> Column:
        g = cells.groupBy(*names).agg(F.sum("w").cast("double").alias("t")) if names else cells.agg(
            F.sum("w").cast("double").alias("t"))
        return scalars(g, s=F.coalesce(F.sum(F.col("t") * (F.col("t") - 1) / 2), F.lit(0.0)))["s"]

    n0, n1, n2, n3 = tied(), tied("x"), tied("y"), tied("x", "y")
    concordant = n0 - n1 - n2 + n3 - discordant
    tau = (concordant - discordant) / F.nullif(F.sqrt((n0 - n1) * (n0 - n2)), F.lit(0.0))
    return cells.agg(F.coalesce(F.sum("w"), F.lit(0)).alias("n")).withColumn("corr", tau)


def score_by_group(items: DataFrame, group: str, score: str, n: int = 10) -> DataFrame:
    return (
        items.groupBy(group).agg(F.avg(score).alias("mean_score"), F.count(F.lit(1)).alias("n"))
        .orderBy(F.round("mean_score", 8).desc(), F.asc(group)).limit(n)
    )


def rec_report(recs: DataFrame, items: DataFrame, top_users: int = 10, top_items: int = 20) -> DataFrame:
    """Tallies over stored recommendations as ``(section, name, n)`` rows (A10).

    Lists per user (top 10), recommendations per item (top 20), per category, and lists per type. All stored lists are
    counted.
    """
    lists = recs.select("user_id", "recommendation_type").distinct()
    per_user = lists.groupBy(F.col("user_id").cast("string").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    per_type = lists.groupBy(F.col("recommendation_type").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    counts = recs.groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))
    per_item = counts.select(F.col("item_id").cast("string").alias("name"), "n")
    detail = items.select(F.col("id").alias("item_id"), "primary_category")
    per_category = counts.join(detail, "item_id", "left").groupBy(
        F.coalesce("primary_category", F.lit("unknown")).alias("name")).agg(F.sum("n").alias("n"))

    def best(df: DataFrame, k: int) -> DataFrame:
        return df.orderBy(F.desc("n"), F.asc("name")).limit(k)

    parts = [
        ("user", best(per_user, top_users)), ("item", best(per_item, top_items)),
        ("category", per_category), ("type", per_type),
    ]
    out = None
    for section, df in parts:
        one = df.select(F.lit(section).alias("section"), "name", "n")
        out = one if out is None else out.unionByName(one)
    return out


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """Count, mean, deviation, bounds and exact quartiles per numeric column."""
    q = quantiles(df, columns, [0.25, 0.5, 0.75])
    quart = q.groupBy("column").agg(
        *[F.max(F.when(F.col("prob") == p, F.col("value"))).alias(n) for n, p in (
            ("q25", 0.25), ("q50", 0.5), ("q75", 0.75))])
    row = df.agg(F.array(*[
        F.struct(
            F.lit(c).alias("column"), F.count(c).alias("n"), F.avg(c).alias("mean"),
            F.stddev_samp(c).alias("std"), F.min(c).cast("double").alias("min"), F.max(c).cast("double").alias("max"))
        for c in columns]).alias("all"))
    return row.select(F.explode("all").alias("s")).select("s.*").join(F.broadcast(quart), "column")  # row per column
