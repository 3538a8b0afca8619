"""Missing values, scaling and outliers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketloom.operators.scale import (
    average_ranks, clean_number, modes, neighbour_values, quantile_scalars, salted_join, scalars, with_position,
)

# Name fragments of market columns, whose gaps mean zero.
MARKET_FRAGMENTS = ["price", "volume", "market_cap"]
MARKET_FIELDS = ["market_cap", "total_volume", "current_price", "circulating_supply", "total_supply"]


def _is_numeric(t: T.DataType) -> bool:
    return isinstance(t, T.NumericType)


def auto_strategy(df: DataFrame, categorical_threshold: int = 10) -> dict[str, str]:
    """Strategy per column that has gaps: market numbers zero, other numbers median, dates forward fill, text mode
    when it has few values and empty otherwise, anything else drop. One aggregation pass."""
    types = {f.name: f.dataType for f in df.schema}
    text = [c for c, t in types.items() if isinstance(t, T.StringType)]
    row = df.agg(
        *[F.sum(F.col(c).isNull().cast("int")).alias(f"m_{c}") for c in types],
    ).first()
    gaps = [c for c in types if row[f"m_{c}"]]
    out: dict[str, str] = {}
    for c in gaps:
        t = types[c]
        if _is_numeric(t):
            market = c in MARKET_FIELDS or any(f in c.lower() for f in MARKET_FRAGMENTS)
            out[c] = "zero" if market else "median"
        elif isinstance(t, (T.TimestampType, T.DateType, T.TimestampNTZType)):
            out[c] = "ffill"
        elif c in text:
            few = df.select(c).filter(F.col(c).isNotNull()).distinct().limit(categorical_threshold + 1).count()
            out[c] = "mode" if 0 < few <= categorical_threshold else "empty_string"
        else:
            out[c] = "drop"
    return out


def fill_missing(
    df: DataFrame, strategy: dict[str, str] | None = None, custom_values: dict | None = None,
    keys: Sequence[str] = (), order: Sequence[str] = (), bucket: Column | None = None,
    categorical_threshold: int = 10,
) -> DataFrame:
    """Fill gaps column by column; columns without a strategy get the automatic one.

    ``ffill``, ``bfill`` and ``interpolate`` need the row order: ``order`` columns and a ``bucket`` that is monotone
    in them (such as the day of a timestamp), within ``keys``.
    """
    chosen = {**auto_strategy(df, categorical_threshold), **(strategy or {})}
    chosen = {c: s for c, s in chosen.items() if c in df.columns}
    custom = custom_values or {}
    types = {f.name: f.dataType for f in df.schema}
    num = lambda s: [c for c, v in chosen.items() if v == s and _is_numeric(types[c])]
    fills: dict[str, Column] = {}
    simple = {"mean": F.avg, "min": F.min, "max": F.max}
    wanted = {f"{s}_{c}": fn(c) for s, fn in simple.items() for c in num(s)}
    stats = scalars(df, **wanted) if wanted else {}
    for s in simple:
        fills.update({c: stats[f"{s}_{c}"] for c in num(s)})
    for c in num("median"):
        fills[c] = quantile_scalars(df, c, m=0.5)["m"]
    for c in num("zero"):
        fills[c] = F.lit(0)
    for c, s in chosen.items():
        if s == "mode":
            row = modes(df, c).first()
            if row is not None and row[0] is not None:
                fills[c] = F.lit(row[0])
        elif s == "empty_string":
            fills[c] = F.lit("")
        elif s == "custom" and c in custom:
            fills[c] = F.lit(custom[c])
    out = df.withColumns({c: F.coalesce(F.col(c), v.cast(types[c])) if not _is_numeric(types[c]) else
                          F.coalesce(F.col(c), v) for c, v in fills.items()}) if fills else df
    moving = [c for c, s in chosen.items() if s in ("ffill", "bfill", "interpolate")]
    if moving:
        if not order or bucket is None:
            raise ValueError("ffill, bfill and interpolate need order columns and a monotone bucket")
        placed = with_position(out, keys, [F.col(c) for c in order], bucket, "_pos")
        near = neighbour_values(placed, keys, moving, "_pos")
        done: dict[str, Column] = {}
        for c in moving:
            prev, nxt = F.col(f"prev_{c}"), F.col(f"next_{c}")
            if chosen[c] == "ffill":
                done[c] = F.coalesce(prev["v"], nxt["v"])
            elif chosen[c] == "bfill":
                done[c] = F.coalesce(nxt["v"], prev["v"])
            else:
                step = (nxt["v"] - prev["v"]) * (F.col("_pos") - prev["p"]) / (nxt["p"] - prev["p"])
                done[c] = F.coalesce(F.col(c), prev["v"] + step, prev["v"], nxt["v"])
        out = near.withColumns(done).select(*df.columns)
    drop = [c for c, s in chosen.items() if s == "drop"]
    return out.dropna(subset=drop) if drop else out


def fill_item_defaults(items: DataFrame, numeric: Sequence[str]) -> DataFrame:
    """Item defaults (P2): non-finite and missing numbers 0, missing names 'unknown', dates parsed or null."""
    out = {c: F.coalesce(clean_number(F.col(c)), F.lit(0.0)) for c in numeric if c in items.columns}
    for c in ("chain", "primary_category"):
        if c in items.columns:
            out[c] = F.coalesce(F.col(c).cast("string"), F.lit("unknown"))
    if "genesis_date" in items.columns:
        out["genesis_date"] = F.col("genesis_date").try_cast("date")
    return items.withColumns(out)


def iqr_bounds(df: DataFrame, column: str, factor: float = 1.5) -> tuple[Column, Column]:
    q = quantile_scalars(df, column, q1=0.25, q3=0.75)
    spread = q["q3"] - q["q1"]
    return q["q1"] - factor * spread, q["q3"] + factor * spread


def normalize(
    df: DataFrame, column: str, method: str = "minmax", custom_range: tuple[float, float] = (0.0, 1.0),
    handle_outliers: bool = False,
) -> DataFrame:
    """Scale one numeric column in place (P3); an unknown method or a non-numeric column changes nothing."""
    if column not in df.columns or not _is_numeric(df.schema[column].dataType):
        return df
    c = F.col(column)
    if handle_outliers:
        lo, hi = iqr_bounds(df, column)
        df = df.withColumn(column, F.when(c.isNotNull(), F.least(F.greatest(c.cast("double"), lo), hi)))
    a, b = custom_range
    if method == "minmax":
        s = scalars(df, lo=F.min(column), hi=F.max(column))
        scaled = F.when(s["hi"] == s["lo"], F.lit(float(a))).otherwise(
            a + (c - s["lo"]) * (b - a) / F.nullif(s["hi"] - s["lo"], F.lit(0.0)))
    elif method == "zscore":
        s = scalars(df, m=F.avg(column), sd=F.stddev_samp(column))
        scaled = F.when(s["sd"] == 0, F.lit(0.0)).otherwise((c - s["m"]) / F.nullif(s["sd"], F.lit(0.0)))
    elif method == "maxabs":
        m = scalars(df, m=F.max(F.abs(c)))["m"]
        scaled = F.when(m == 0, F.lit(0.0)).otherwise(c / F.nullif(m.cast("double"), F.lit(0.0)))
    elif method == "log":
        lo = scalars(df, lo=F.min(column))["lo"]
        scaled = F.when(lo <= 0, F.log1p(c + F.abs(lo) + 1)).otherwise(F.log1p(c))
    elif method == "robust":
        q = quantile_scalars(df, column, q1=0.25, m=0.5, q3=0.75)
        spread = q["q3"] - q["q1"]
        scaled = F.when(spread == 0, F.lit(0.0)).otherwise((c - q["m"]) / F.nullif(spread, F.lit(0.0)))
    elif method == "quantile":
        n = scalars(df, n=F.count(column))["n"]
        ranks = average_ranks(df, column).select(column, "rank")
        joined = salted_join(df, ranks, [column], how="left")
        share = F.col("rank") / n
        if (a, b) != (0.0, 1.0):
            share = a + share * (b - a)
        return joined.withColumn(column, share).select(*df.columns)
    else:
        return df
    return df.withColumn(column, scaled)


def outlier_flag(df: DataFrame, column: str, method: str = "iqr", threshold: float = 1.5) -> DataFrame:
    """Adds a boolean ``is_outlier`` by IQR fences, z-score or modified z-score."""
    c = F.col(column)

    def zscore() -> Column:
        s = scalars(df, m=F.avg(column), sd=F.stddev_samp(column))
        return F.abs((c - s["m"]) / F.nullif(s["sd"], F.lit(0.0))) > threshold

    if column not in df.columns or not _is_numeric(df.schema[column].dataType):
        flag = F.lit(False)
    elif method == "iqr":
        lo, hi = iqr_bounds(df, column, threshold)
        flag = (c < lo) | (c > hi)
    elif method == "zscore":
        flag = zscore()
    elif method == "modified_zscore":
        med = quantile_scalars(df, column, m=0.5)["m"]
        off = df.select(F.abs(c - med).alias("_off"))
        mad = quantile_scalars(off, "_off", m=0.5)["m"] * 1.4826
        robust = F.abs(0.6745 * (c - med) / F.nullif(mad, F.lit(0.0))) > threshold
        flag = F.when(mad == 0, zscore()).otherwise(robust)
    else:
        flag = F.lit(False)
    return df.withColumn("is_outlier", F.coalesce(flag, F.lit(False)))


def outliers(df: DataFrame, column: str, method: str = "iqr", threshold: float = 1.5) -> DataFrame:
    return outlier_flag(df, column, method, threshold).filter("is_outlier").drop("is_outlier")
