"""Calendar features of a timestamp (T1) and age in days."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.operators.scale import quantile_scalars


def _flag(c: Column) -> Column:
    return c.cast("int")


def _features(ts: Column) -> dict[str, Column]:
    day = F.to_date(ts)
    tomorrow = F.date_add(day, 1)
    return {
        "year": F.year(ts),
        "quarter": F.quarter(ts),
        "month": F.month(ts),
        "day": F.dayofmonth(ts),
        "day_of_week": F.weekday(ts),
        "day_of_year": F.dayofyear(ts),
        "week_of_year": F.weekofyear(ts),
        "hour": F.hour(ts),
        "minute": F.minute(ts),
        "is_month_start": _flag(F.dayofmonth(day) == 1),
        "is_month_end": _flag(F.dayofmonth(tomorrow) == 1),
        "is_quarter_start": _flag(day == F.to_date(F.date_trunc("quarter", ts))),
        "is_quarter_end": _flag(tomorrow == F.to_date(F.date_trunc("quarter", tomorrow))),
        "is_year_start": _flag(F.dayofyear(day) == 1),
        "is_year_end": _flag(F.dayofyear(tomorrow) == 1),
        "is_weekend": _flag(F.weekday(ts) >= 5),
    }


def time_features(
    df: DataFrame, column: str, features: list[str] | None = None, drop_original: bool = False,
    prefix: str | None = None,
) -> DataFrame:
    """Selected calendar features as ``<prefix><feature>`` integer columns; unknown names are skipped."""
    prefix = f"{column}_" if prefix is None else prefix
    known = _features(F.col(column).try_cast("timestamp"))
    wanted = [f for f in (features or list(known)) if f in known]
    out = df.withColumns({f"{prefix}{f}": known[f] for f in wanted})
    return out.drop(column) if drop_original else out


def age_days(df: DataFrame, column: str, as_of: Column) -> DataFrame:
    """Whole days up to ``as_of``; rows without a date take the median age."""
    aged = df.withColumn("age_days", F.datediff(as_of, F.col(column)).cast("double"))
    median = quantile_scalars(aged, "age_days", m=0.5)["m"]
    return aged.withColumn("age_days", F.coalesce("age_days", median))
