"""Ratings kept up to date by a stream: a max-merge sink with a ledger of batches (ST1).

The table is cut into buckets by the hash of (user, item). A micro-batch writes new versions of the buckets that it touches
and then one ledger entry, which names them; the entry appears by a single rename, so a batch counts as a whole or not at all.
Readers take the newest version of every bucket from the ledger. A batch that is already in the ledger changes nothing, and
what a batch wrote without an entry is never read, so restarts and replays are safe. One stream writes to a table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

SCHEMA = "user_id long, item_id long, rating double"


class RatingsTable:
    """``user_id``, ``item_id``, ``rating`` (the largest weight so far) below ``path``, in ``buckets`` buckets."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path, buckets

    def follow(self, interactions: DataFrame, checkpoint: str, available_now: bool = True) -> StreamingQuery:
        """Merge a stream of valid interactions (``user_id``, ``item_id``, ``weight``)."""
        writer = interactions.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(self.merge)
        return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")).start()

    def merge(self, batch: DataFrame, batch_id: int) -> None:
        """Take one batch in; a batch that has been taken in already is left out."""
        if self._exists(f"{self.path}/ledger/{batch_id:020d}"):
            return
        bucket = F.pmod(F.xxhash64("user_id", "item_id"), F.lit(self.buckets)).cast("int").alias("bucket")
        fresh = batch.groupBy("user_id", "item_id").agg(F.max("weight").cast("double").alias("rating")).select(
            "*", bucket).persist()
        try:
            touched = sorted(r.bucket for r in fresh.select("bucket").distinct().collect())  # ``buckets`` rows at most
            version = f"{batch_id:020d}-{uuid.uuid4().hex[:12]}"
            if touched:
                merged = fresh.unionByName(self.read(touched).select("*", bucket)).groupBy("bucket", "user_id", "item_id").agg(
                    F.max("rating").alias("rating"))
                merged.repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}/versions/{version}")
            self._commit(batch_id, version, touched)
        finally:
            fresh.unpersist()

    def read(self, buckets: list[int] | None = None) -> DataFrame:
        """The ratings of all committed batches, or those of some buckets."""
        paths = [f"{self.path}/versions/{version}/bucket={bucket}" for bucket, version in self._versions().items()
                 if buckets is None or bucket in set(buckets)]
        if not paths:
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(*paths)

    def _versions(self) -> dict[int, str]:
        if not self._exists(f"{self.path}/ledger"):
            return {}
        entries = self.spark.read.schema("version string, buckets array<int>").json(f"{self.path}/ledger/*")
        newest = entries.select("version", F.explode("buckets").alias("bucket")).groupBy("bucket").agg(
            F.max("version").alias("version"))  # versions sort by batch
        return {r.bucket: r.version for r in newest.collect()}

    def _commit(self, batch_id: int, version: str, touched: list[int]) -> None:
        draft = f"{self.path}/drafts/{version}"
        self.spark.createDataFrame([(version, touched)], "version string, buckets array<int>").coalesce(1).write.json(draft)
        files, ledger = self._files(f"{self.path}/ledger")
        files.mkdirs(ledger)
        if not files.rename(self._files(draft)[1], self._files(f"{self.path}/ledger/{batch_id:020d}")[1]):
            raise RuntimeError(f"batch {batch_id} could not be committed")

    def _exists(self, path: str) -> bool:
        files, at = self._files(path)
        return files.exists(at)

    def _files(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at
