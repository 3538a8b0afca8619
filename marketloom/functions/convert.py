"""Type coercion with defaults."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketloom.functions.jsonops import parsed_json
from marketloom.operators.scale import clean_number, scalars

# Words read as booleans.
TRUE_WORDS = ["true", "t", "yes", "y", "1"]
FALSE_WORDS = ["false", "f", "no", "n", "0"]

# Columns coerced to numbers.
NUMERIC_COLUMNS = [
    "market_cap", "total_volume", "current_price", "price_change_percentage_24h",
    "price_change_percentage_7d", "price_change_percentage_30d",
    "reddit_subscribers", "twitter_followers", "github_stars",
]


def safe_convert(value: Column, target: str, default) -> Column:
    """Cast with a default for null and unparsable input; ``bool`` understands words, list and dict take JSON text."""
    if target == "bool":
        word = F.lower(F.trim(value.cast("string")))
        other = F.length(word) > 0  # any other nonempty text counts as true
        return F.coalesce(
            F.when(word.isin(TRUE_WORDS), True).when(word.isin(FALSE_WORDS), False).otherwise(other), F.lit(default))
    if target == "list":
        return F.coalesce(parsed_json(value, "array<string>"), F.lit(default).cast("array<string>"))
    if target == "dict":
        return F.coalesce(parsed_json(value, "map<string,string>"), F.lit(default).cast("map<string,string>"))
    if target == "int":
        text = F.trim(value.cast("string"))
        whole = F.when(text.rlike(r"^[+-]?\d+$"), text.try_cast("bigint"))
        return F.coalesce(whole, F.lit(default).cast("bigint"))
    spark_type = {"float": "double", "str": "string"}[target]
    return F.coalesce(value.try_cast(spark_type), F.lit(default).cast(spark_type))


def ensure_types(items: DataFrame, numeric: list[str] | None = None) -> DataFrame:
    """Numbers coerced with 0 for anything unreadable; list and map columns parsed from text or made empty."""
    out = {}
    for c in numeric or NUMERIC_COLUMNS:
        if c in items.columns:
            out[c] = F.coalesce(clean_number(F.col(c).try_cast("double")), F.lit(0.0))
    types = {f.name: f.dataType for f in items.schema}
    for c, t in (("categories", "array<string>"), ("platforms", "map<string,string>")):
        if c in types:
            empty = F.array().cast(t) if c == "categories" else F.create_map().cast(t)
            parsed = parsed_json(F.col(c), t) if isinstance(types[c], T.StringType) else F.col(c)
            out[c] = F.coalesce(parsed, empty)
    return items.withColumns(out)


def ensure_categorical(items: DataFrame) -> DataFrame:
    """Missing category, chain and primary category columns are created; primary is the first category."""
    out = items
    if "category" not in out.columns:
        out = out.withColumn(
            "category", F.col("categories") if "categories" in out.columns else F.array().cast("array<string>"))
    if "chain" not in out.columns:
        out = out.withColumn("chain", F.lit("unknown"))
    if "primary_category" not in out.columns:
        out = out.withColumn("primary_category", F.try_element_at("category", F.lit(1)))
    return out.withColumns(
        {
            "chain": F.coalesce("chain", F.lit("unknown")),
            "primary_category": F.coalesce("primary_category", F.lit("unknown")),
        }
    )


_INTEGERS = [("tinyint", -(2**7), 2**7 - 1), ("smallint", -(2**15), 2**15 - 1), ("int", -(2**31), 2**31 - 1)]


def narrow_types(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """Smallest integer type that fits, float where no double loses digits; low-cardinality text is reported as categorical
    (F8).

    One aggregation pass. Text needs no cast because Parquet dictionary-encodes it. Returns the frame and the chosen
    type per column.
    """
    whole = [f.name for f in df.schema if isinstance(f.dataType, (T.LongType, T.IntegerType, T.ShortType))]
    real = [f.name for f in df.schema if isinstance(f.dataType, T.DoubleType)]
    text = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    row = df.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.min(c).alias(f"lo_{c}") for c in whole],
        *[F.max(c).alias(f"hi_{c}") for c in whole],
        *[F.bool_and(F.col(c).eqNullSafe(F.col(c).cast("float").cast("double"))).alias(f"f_{c}") for c in real],
        *[F.approx_count_distinct(c).alias(f"d_{c}") for c in text],
    ).first()
    chosen: dict[str, str] = {}
    for c in whole:
        lo, hi = row[f"lo_{c}"], row[f"hi_{c}"]
        fits = [name for name, a, b in _INTEGERS if lo is not None and a <= lo and hi <= b]
        chosen[c] = fits[0] if fits else "bigint"
    for c in real:
        chosen[c] = "float" if row[f"f_{c}"] else "double"
    for c in text:
        chosen[c] = "category" if row["n"] and row[f"d_{c}"] < 0.5 * row["n"] else "string"
    casts = {c: F.col(c).cast(t) for c, t in chosen.items() if t not in ("category", "string")}
    return df.withColumns(casts) if casts else df, chosen


def type_report(df: DataFrame) -> DataFrame:
    """Chosen type per column with the value bounds, as a small frame."""
    _, chosen = narrow_types(df)
    rows = sorted(chosen.items())
    n = scalars(df, n=F.count(F.lit(1)))["n"]
    entries = F.array(*[F.struct(F.lit(a).alias("column"), F.lit(b).alias("type")) for a, b in rows])
    return df.sparkSession.range(1).select(F.explode(entries).alias("e"), n.alias("rows")).select(
        "e.column", "e.type", "rows")
