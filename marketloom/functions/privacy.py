"""Column anonymisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketloom.operators.encoding import code_table
from marketloom.operators.scale import scalars


def hashed(value: Column, salt: str) -> Column:
    return F.sha2(F.concat(value.cast("string"), F.lit(salt)), 256)


def masked(value: Column) -> Column:
    """Keep two characters on both sides; texts of up to four characters are masked whole."""
    text = value.cast("string")
    n = F.length(text)
    inner = F.concat(F.substring(text, 1, 2), F.repeat(F.lit("*"), n - 4), F.right(text, F.lit(2)))
    return F.when(n <= 4, F.repeat(F.lit("*"), n)).otherwise(inner)


def obfuscated(value: Column, data_type: T.DataType) -> Column:
    """Numbers to the nearest ten, dates to the month, texts to first character and remaining length."""
    if isinstance(data_type, T.NumericType):
        return F.bround(value.cast("double"), -1)
    if isinstance(data_type, (T.TimestampType, T.DateType, T.TimestampNTZType)):
        return F.date_trunc("month", value)
    text = value.cast("string")
    n = F.length(text)
    return F.when(n <= 1, text).otherwise(F.concat(F.substring(text, 1, 1), F.lit("_"), (n - 1).cast("string")))


def noisy(df: DataFrame, column: str, key: list[str], seed: int) -> Column:
    """Gaussian noise of a tenth of the standard deviation, drawn from digests of the row keys so that retries agree."""
    sd = scalars(df, sd=F.stddev_samp(column))["sd"] * 0.1
    keys = [F.coalesce(F.col(k).cast("string"), F.lit("")) for k in key]

    def unit(s: int) -> Column:
        head = F.substring(F.md5(F.concat_ws(":", *keys, F.lit(str(s)))), 1, 10)
        return (F.conv(head, 16, 10).cast("double") + 1) / float((1 << 40) + 1)

    gauss = F.sqrt(-2 * F.log(unit(seed))) * F.cos(2 * F.pi() * unit(seed + 1))
    return F.col(column) + gauss * sd


def anonymize(
    df: DataFrame, column: str, method: str = "hash", salt: str = "", keep_original: bool = False,
    suffix: str = "_anon", key: list[str] | None = None, seed: int = 0,
) -> DataFrame:
    """Replace a column (or add ``<column><suffix>``) by hash, mask, category code, noise or obfuscation.

    Nulls stay null. Category codes follow the sorted order of the distinct values.
    """
    out = f"{column}{suffix}" if keep_original else column
    data_type = df.schema[column].dataType
    if method == "hash":
        return df.withColumn(out, hashed(F.col(column), salt))
    if method == "mask":
        return df.withColumn(out, masked(F.col(column)))
    if method == "obfuscate":
        return df.withColumn(out, obfuscated(F.col(column), data_type))
    if method == "noise":
        if not isinstance(data_type, T.NumericType):
            return df.withColumn(out, F.col(column))
        return df.withColumn(out, noisy(df, column, key or [c for c in df.columns if c != column], seed))
    if method == "categorical":
        coded = df.join(code_table(df, column), column, "left")
        return coded.withColumn(out, F.col("_code")).drop("_code").select(
            *df.columns, *([out] if keep_original else []))
    return df.withColumn(out, F.col(column))
