"""Similarity, item, price and recommendation stores (IO8-IO14)."""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketloom.operators.joins import union_dedupe
from marketloom.operators.scale import lookup_join, mirrored
from marketloom.operators.scores import stored_scores
from marketloom.session import materialise

STORED_SIMILARITY = 0.1


BUCKET_ROWS = 2_000_000  # rows of the larger table in one bucket
HOT_ROWS = 1_000_000  # ratings of one item that share a salt
MET_ROWS = 5_000_000  # pairs of a rating and a neighbour of its item in one salt, and about so many in one bucket


def save_bucketed(df: DataFrame, path: str, keys: Sequence[str], buckets: int) -> None:
    """A table whose files are hashed by ``keys`` into ``buckets`` and sorted by them, so that joins and groupings on the
    keys need no exchange. The layout is stored beside the data: any session can read it back with ``load_bucketed``."""
    spark = df.sparkSession
    name = f"loom_{uuid.uuid4().hex}"  # the catalog's name lasts as long as the session; the files stay
    df.repartition(buckets, *keys).write.format("parquet").bucketBy(buckets, *keys).sortBy(*keys).option(
        "path", f"{path}/rows").saveAsTable(name)
    layout = spark.createDataFrame([(list(keys), buckets, df.schema.json())], "keys array<string>, buckets int, columns string")
    layout.coalesce(1).write.mode("overwrite").json(f"{path}/layout")
    spark.sql(f"DROP TABLE {name}")  # of an external table only the name goes


def load_bucketed(spark: SparkSession, path: str) -> DataFrame:
    layout = spark.read.json(f"{path}/layout").first()
    columns = T.StructType.fromJson(json.loads(layout["columns"]))
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in columns)
    keys = ", ".join(f"`{k}`" for k in layout["keys"])
    name = f"loom_{uuid.uuid4().hex}"
    spark.sql(f"CREATE TABLE {name} ({ddl}) USING parquet CLUSTERED BY ({keys}) SORTED BY ({keys}) "
              f"INTO {layout['buckets']} BUCKETS LOCATION '{path}/rows'")
    return spark.table(name)


def save_matrices(path: str, ratings: DataFrame, buckets: int | None = None, hot_rows: int = HOT_ROWS,
                  **similarities: DataFrame) -> None:
    """Ratings and item similarities, bucketed alike by item for joins without an exchange (IO8).

    Ratings are stored by (``item_id``, ``salt``). An item with more than ``hot_rows`` ratings, or so many that they meet more
    than ``MET_ROWS`` neighbours, gets several salts, over which its ratings are spread, so no bucket holds all of a hot item. Similarity tables (``i``, ``j``, ``sim``, each pair once) are
    stored in both directions as ``item_id``, ``salt``, ``other_id``, ``sim``, the rows of an item once for each of its salts.
    """
    directed = {name: materialise(mirrored(sim).select(F.col("i").alias("item_id"), F.col("j").alias("other_id"), "sim"))
                for name, sim in similarities.items()}
    sizes = ratings.groupBy("item_id").agg(F.count(F.lit(1)).alias("_n"))
    degrees = [d.groupBy("item_id").agg(F.count(F.lit(1)).alias("_d")) for d in directed.values()]
    if degrees:
        widest = reduce(DataFrame.unionByName, degrees).groupBy("item_id").agg(F.max("_d").alias("_d"))
        sizes = lookup_join(sizes, widest, ["item_id"])
    else:
        sizes = sizes.withColumn("_d", F.lit(0))
    met = F.col("_n") * F.coalesce("_d", F.lit(0))
    sizes = materialise(sizes.withColumn("_met", met))
    salts = sizes.select("item_id", F.greatest(F.ceil(F.col("_n") / hot_rows), F.ceil(F.col("_met") / MET_ROWS)).cast("int").alias("_salts"))
    if buckets is None:
        rated, total = sizes.agg(F.coalesce(F.sum("_n"), F.lit(0)), F.coalesce(F.sum("_met"), F.lit(0))).first()
        rows = max([rated, *(d.count() for d in directed.values())])
        buckets = max(8, 1 << (rows // BUCKET_ROWS).bit_length(), 1 << (total // MET_ROWS).bit_length())
    salted = lookup_join(ratings, salts.filter("_salts > 1"), ["item_id"]).withColumn(
        "salt", F.pmod(F.xxhash64("user_id"), F.coalesce("_salts", F.lit(1))).cast("int")).drop("_salts")
    save_bucketed(salted, f"{path}/ratings", ["item_id", "salt"], buckets)
    for name, rows in directed.items():
        copies = lookup_join(rows, salts.filter("_salts > 1"), ["item_id"]).withColumn(
            "salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))).drop("_salts")
        save_bucketed(copies, f"{path}/{name}", ["item_id", "salt"], buckets)


def load_matrices(spark: SparkSession, path: str, *names: str) -> dict[str, DataFrame]:
    """Tables of ``save_matrices``, with their buckets."""
    return {n: load_bucketed(spark, f"{path}/{n}") for n in names}


def save_similarity(sim: DataFrame, sim_type: str, path: str, threshold: float = STORED_SIMILARITY) -> None:
    """Pairs of different ids above the threshold; replaces only the partition of this type (IO9)."""
    kept = sim.filter((F.col("i") != F.col("j")) & (F.col("sim") > threshold))
    kept.select("i", "j", "sim", F.lit(sim_type).alias("sim_type")).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").partitionBy("sim_type").parquet(path)


def load_similarity(spark: SparkSession, path: str, sim_type: str) -> DataFrame:
    return spark.read.parquet(path).filter(F.col("sim_type") == sim_type).drop("sim_type")


def jdbc_table(
    spark: SparkSession, url: str, table: str, partition_column: str, lower: int, upper: int, partitions: int = 64,
    **options,
) -> DataFrame:
    """A database table read in ``partitions`` ranges of a numeric or time column (IO10)."""
    return (
        spark.read.format("jdbc")
        .options(
            url=url, dbtable=table, partitionColumn=partition_column, lowerBound=str(lower), upperBound=str(upper),
            numPartitions=str(partitions), **options)
        .load()
    )


def upsert_items(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Insert or update items by id and recompute the stored scores (IO11).

    A null in the incoming row keeps the stored value.
    """
    columns = [c for c in stored.columns if c != "id"]
    new = incoming.select(
        F.col("id").alias("_id"),
        *[(F.col(c) if c in incoming.columns else F.lit(None)).alias(f"n_{c}") for c in columns])
    merged = stored.join(new, stored.id == new._id, "full_outer").select(
        F.coalesce("id", "_id").alias("id"), *[F.coalesce(f"n_{c}", c).alias(c) for c in columns])
    return stored_scores(merged)


def chart_rows(charts: DataFrame, key: str = "project_id") -> DataFrame:
    """Price, volume and value arrays of ``[epoch_ms, value]`` aligned on equal times, one row per price point.

    The first of repeated times wins. All three arrays go through one aggregation instead of joins.
    """
    parts = []
    for column, name in (("prices", "price"), ("total_volumes", "volume"), ("market_caps", "market_cap")):
        parts.append(
            charts.select(key, F.posexplode(column).alias("p", "e")).select(
                key, F.timestamp_millis(F.col("e")[0].cast("long")).alias("timestamp"), "p",
                F.col("e")[1].alias("v"), F.lit(name).alias("kind")))
    rows = reduce(lambda a, b: a.unionByName(b), parts)
    first = lambda n: F.min_by("v", F.when(F.col("kind") == n, F.col("p"))).alias(n)
    return (
        rows.groupBy(key, "timestamp")
        .agg(first("price"), first("volume"), first("market_cap"),
             F.max((F.col("kind") == "price").cast("int")).alias("_has"))
        .filter("_has = 1").drop("_has")
    )


def upsert_prices(
    stored: DataFrame, incoming: DataFrame, as_of: Column, days: int, order: Sequence[str] = ()
) -> DataFrame:
    """Replace the last ``days`` of every incoming series; unique (key, time), the incoming row wins (IO12).

    Of several incoming rows for one key and time the one with the greatest ``order`` columns wins, then the one with the
    greatest values; a row is always taken whole. Stored history before the window is passed on untouched.
    """
    since = as_of - F.make_interval(days=F.lit(days))
    fresh = incoming.filter(F.col("timestamp") >= since)
    touched = fresh.select("project_id").distinct()
    old = stored.filter(F.col("timestamp") >= since).join(touched, "project_id", "left_anti").unionByName(
        stored.filter(F.col("timestamp") < since))
    values = [c for c in stored.columns if c not in ("project_id", "timestamp")]
    newest = fresh.groupBy("project_id", "timestamp").agg(
        F.max_by(F.struct(*values), F.struct(*[F.col(c).alias(f"o{n}") for n, c in enumerate([*order, *values])])).alias("v"))
    return old.unionByName(newest.select("project_id", "timestamp", "v.*").select(*stored.columns))


def combine_pages(pages: list[DataFrame], details: DataFrame | None = None, order: Sequence[str] = ()) -> DataFrame:
    """Extract pages in order, the first row per id, details joined on (IO13).

    Inside a page the row with the smallest ``order`` columns is the first; without them, or among equal ones, the row
    with the smallest values.
    """
    sort = [*order, *[c for c in pages[0].columns if c != "id"]]
    first = union_dedupe(pages, "id", [F.col(c) for c in sort]).drop("source_rank")
    return first if details is None else first.join(details, "id", "left")


def save_recommendations(recs: DataFrame, path: str) -> None:
    """All lists of all users in one table; a type that is written again is replaced (IO14)."""
    recs.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        "recommendation_type").parquet(path)


def map_batches(df: DataFrame, fn, schema: str) -> DataFrame:
    """Apply a pandas function batch by batch on the executors."""

    def run(batches):
        for frame in batches:
            yield fn(frame)

    return df.mapInPandas(run, schema)
