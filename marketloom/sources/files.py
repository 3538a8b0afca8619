"""CSV and JSON files, snapshots and item documents (IO1-IO7)."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketloom.functions.convert import safe_convert
from marketloom.operators.scale import scalars

# Column names read as dates, and compressions Spark can split or stream.
DATE_NAME = r"date|time|datetime|timestamp|created_at|updated_at|day|month|year"
COMPRESSION = {".gz": "gzip", ".bz2": "bzip2"}
UNSUPPORTED = (".zip", ".xz")


def date_columns(names: list[str]) -> list[str]:
    return [n for n in names if re.search(DATE_NAME, n, re.IGNORECASE)]


def read_csv(
    spark: SparkSession, path: str, schema: T.StructType | str | None = None, encoding: str = "UTF-8",
    parse_dates: bool | list[str] = True, **options,
) -> DataFrame:
    """CSV with header; bad lines are dropped, columns with date-like names are parsed or become null.

    Give a ``schema`` for large inputs, otherwise types are inferred in an extra pass.
    """
    if path.lower().endswith(UNSUPPORTED):
        raise ValueError(f"{path}: Spark's reader can't open this compression; use ranges.read_archived_csv")
    reader = spark.read.option("header", True).option("encoding", encoding).option("mode", "DROPMALFORMED")
    reader = reader.options(**options)
    df = (reader.schema(schema) if schema is not None else reader.option("inferSchema", True)).csv(path)
    wanted = date_columns(df.columns) if parse_dates is True else (parse_dates or [])
    text = {f.name for f in df.schema if isinstance(f.dataType, T.StringType)}
    return df.withColumns({c: F.try_to_timestamp(c) for c in wanted if c in text})


def write_csv(
    df: DataFrame, path: str, float_digits: int | None = 6, compression: str = "none",
    timestamp_format: str = "yyyy-MM-dd HH:mm:ss", mode: str = "errorifexists",
) -> None:
    """CSV with fixed float digits; one file per partition."""
    floats = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    if float_digits is not None:
        df = df.withColumns({c: F.format_string(f"%.{float_digits}f", F.col(c)) for c in floats})
    df.write.mode(mode).option("header", True).option("compression", compression).option(
        "timestampFormat", timestamp_format).option("timestampNTZFormat", timestamp_format).csv(path)


def read_json(
    spark: SparkSession, path: str, schema: T.StructType | str | None = None, multi_line: bool = False
) -> DataFrame:
    """JSON lines, or whole documents and arrays with ``multi_line``; broken records become null rows."""
    reader = spark.read.option("mode", "PERMISSIVE").option("multiLine", multi_line)
    return (reader.schema(schema) if schema is not None else reader).json(path)


def write_json(df: DataFrame, path: str, compression: str = "none", mode: str = "errorifexists") -> None:
    """JSON lines with ISO timestamps."""
    iso = "yyyy-MM-dd'T'HH:mm:ss"
    df.write.mode(mode).option("compression", compression).option("timestampFormat", iso).option(
        "timestampNTZFormat", iso).json(path)


def file_timestamp(name: Column) -> Column:
    """Timestamp in a file name: ``20240131_235959``, ``2024-01-31_23-59-59`` or ``2024-01-31``."""
    forms = [
        (r"(\d{8}_\d{6})", "yyyyMMdd_HHmmss"),
        (r"(\d{4}-\d{2}-\d{2}_\d{2}-\d{2}-\d{2})", "yyyy-MM-dd_HH-mm-ss"),
        (r"(\d{4}-\d{2}-\d{2})", "yyyy-MM-dd"),
    ]
    return F.coalesce(*[
        F.try_to_timestamp(F.nullif(F.regexp_extract(name, p, 1), F.lit("")), F.lit(f)) for p, f in forms])


def list_files(
    spark: SparkSession, directory: str, prefix: str = "", suffix: str = "", recursive: bool = False, min_size: int = 0
) -> DataFrame:
    """Path, name, size, modification time and name timestamp of the files below a folder; contents are not read."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
        .option("pathGlobFilter", f"{prefix}*{suffix}").load(directory)
        .select("path", "modificationTime", "length")
    )
    name = F.element_at(F.split("path", "/"), -1)
    return files.filter(F.col("length") >= min_size).withColumns({"name": name, "name_ts": file_timestamp(name)})


def latest_file(files: DataFrame, by: str = "modificationTime") -> DataFrame:
    return files.orderBy(F.col(by).desc_nulls_last(), F.col("name").desc()).limit(1)


def save_snapshot(df: DataFrame, path: str, snapshot_ts: Column) -> None:
    """Append one snapshot as a partition; existing snapshots stay."""
    df.withColumn("snapshot_ts", F.date_format(snapshot_ts, "yyyyMMdd_HHmmss")).write.mode("append").partitionBy(
        "snapshot_ts").parquet(path)


def latest_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """The newest snapshot; only its partition is scanned."""
    all_rows = spark.read.option("basePath", path).parquet(path)
    newest = scalars(all_rows.select("snapshot_ts"), m=F.max("snapshot_ts"))["m"]
    return all_rows.filter(F.col("snapshot_ts") == newest)


# Field names of the item documents.
DETAIL_SCHEMA = """
id string, platforms map<string,string>, categories array<string>,
community_data struct<reddit_subscribers: string, twitter_followers: string>,
developer_data struct<stars: string, subscribers: string, forks: string>,
description struct<en: string>, genesis_date string, market_cap_rank string,
sentiment_votes_up_percentage string, developer_score string, community_score string
"""


def load_item_details(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """One flat detail row per item document; a document without id takes its file's name (IO6)."""
    raw = spark.read.schema(DETAIL_SCHEMA).option("mode", "PERMISSIVE").option("multiLine", multi_line).json(path)
    stem = F.regexp_replace(F.col("_metadata.file_name"), r"\.json$", "")
    whole = lambda c, d: safe_convert(F.col(c), "int", d)
    return raw.select(
        F.coalesce("id", stem).alias("id"),
        whole("community_data.reddit_subscribers", 0).alias("reddit_subscribers"),
        whole("community_data.twitter_followers", 0).alias("twitter_followers"),
        whole("developer_data.stars", 0).alias("github_stars"),
        whole("developer_data.subscribers", 0).alias("github_subscribers"),
        whole("developer_data.forks", 0).alias("github_forks"),
        F.coalesce("categories", F.array().cast("array<string>")).alias("categories"),
        F.coalesce("platforms", F.create_map().cast("map<string,string>")).alias("platforms"),
        safe_convert(F.col("sentiment_votes_up_percentage"), "float", 50.0).alias("sentiment_positive"),
        F.coalesce("description.en", F.lit("")).alias("description"),
        F.col("genesis_date").try_cast("date").alias("genesis_date"),
        whole("market_cap_rank", 9999).alias("market_cap_rank"),
        F.col("developer_score").try_cast("double").alias("developer_score"),
        F.col("community_score").try_cast("double").alias("social_score"),
    )


def flat_view(df: DataFrame) -> DataFrame:
    """Maps as their keys and arrays as their elements, joined with ``', '``, for CSV output."""
    out = {}
    for f in df.schema:
        if isinstance(f.dataType, T.MapType):
            out[f.name] = F.array_join(F.map_keys(f.name), ", ")
        elif isinstance(f.dataType, T.ArrayType):
            out[f.name] = F.array_join(F.col(f.name).cast("array<string>"), ", ")
    return df.withColumns(out) if out else df


def save_processed(path: str, snapshot_ts: Column, **frames: DataFrame) -> None:
    """Items, interactions and features as snapshots; items also as a flat CSV view (IO7)."""
    for name, df in frames.items():
        save_snapshot(df, f"{path}/{name}", snapshot_ts)
    if "items" in frames:
        write_csv(flat_view(frames["items"]), f"{path}/items_csv", mode="append")


def load_processed(spark: SparkSession, path: str, *names: str) -> dict[str, DataFrame]:
    return {n: latest_snapshot(spark, f"{path}/{n}").drop("snapshot_ts") for n in names}
