"""Structured Streaming jobs (ST1-ST4); each has a batch twin among the operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

# Interaction types and the weight range of valid events.
INTERACTION_TYPES = ["view", "favorite", "portfolio_add", "research", "click"]
MIN_WEIGHT, MAX_WEIGHT = 1, 5

DAY_MS = 86_400_000
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """Keep large state on local disk with changelog checkpoints in the shared folder."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")


def file_stream(spark: SparkSession, path: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def to_files(df: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Append sink; its commit log makes retried batches idempotent."""
    writer = df.writeStream.format("parquet").outputMode("append").option("path", path).option(
        "checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")).start()


def is_valid():
    kind, weight = F.col("interaction_type"), F.col("weight")
    ok = kind.isin(INTERACTION_TYPES) & weight.between(MIN_WEIGHT, MAX_WEIGHT)
    return F.coalesce(ok & F.col("user_id").isNotNull() & F.col("item_id").isNotNull(), F.lit(False))


def valid_interactions(events: DataFrame, delay: str = "1 day") -> DataFrame:
    """Valid events once per ``event_id`` within the watermark (ST1)."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return timed.filter(is_valid()).withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])


def invalid_interactions(events: DataFrame) -> DataFrame:
    """Everything else, for the dead-letter sink."""
    return events.filter(~is_valid())


def merged_ratings(log: DataFrame) -> DataFrame:
    """Ratings from the interaction log: the largest weight per (user, item), merged on read."""
    return log.groupBy("user_id", "item_id").agg(F.max("weight").cast("double").alias("rating"))


def price_buckets(
    ticks: DataFrame, size: str = "1 hour", slide: str | None = None, delay: str = "2 hours"
) -> DataFrame:
    """Mean price and summed volume per series and window; rows later than the watermark are dropped (ST2)."""
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    return (
        ticks.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
        .groupBy(window.alias("w"), "project_id")
        .agg(F.avg("value").alias("price"), F.sum("value").alias("volume"), F.count(F.lit(1)).alias("n"))
        .select("project_id", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                "price", "volume", "n")
    )


def alert_hits(prices: DataFrame, alerts: DataFrame) -> DataFrame:
    """Price rows at or beyond the target of an alert; ``alerts`` is the static side."""
    met = ((F.col("alert_type") == "above") & (F.col("price") >= F.col("target_price"))) | (
        (F.col("alert_type") == "below") & (F.col("price") <= F.col("target_price")))
    return prices.join(alerts, "project_id").filter(met).select("alert_id", "project_id", "timestamp", "price")


def first_hits(prices: DataFrame, alerts: DataFrame, delay: str = "1 day") -> DataFrame:
    """``alert_hits`` with the earliest hit of each alert in a micro-batch only, and a watermark on ``timestamp``.

    Of a series, only prices beyond all earlier ones of the batch can be such a hit, and only for targets between both. Rows
    later than the watermark are dropped first, so that they hide no others.
    """
    timed = prices.select("project_id", F.col("timestamp").cast("timestamp").alias("timestamp"), F.col("price").cast("double").alias(
        "price")).filter("price IS NOT NULL").withWatermark("timestamp", delay)
    name = prices.schema["project_id"].dataType.simpleString()
    steps = timed.groupBy("project_id").transformWithStateInPandas(
        Steps(), f"project_id {name}, timestamp timestamp, price double, alert_type string, past double", "append",
        "eventtime", eventTimeColumnName="timestamp")
    new = F.col("past").isNull()
    met = F.when(F.col("alert_type") == "above", (F.col("price") >= F.col("target_price")) & (
        new | (F.col("target_price") > F.col("past")))).otherwise((F.col("price") <= F.col("target_price")) & (
            new | (F.col("target_price") < F.col("past"))))
    return steps.join(alerts, ["project_id", "alert_type"]).filter(met).select("alert_id", "project_id", "timestamp", "price")


class Steps(StatefulProcessor):
    """New highest and lowest prices of a series in a micro-batch, each with the one before; keeps no state."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        pass

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = None
        for frame in rows:  # batches are streamed; the steps of all are the steps of their steps
            held = pd.concat([self.steps(f) for f in ([frame] if held is None else [held, frame])]).drop_duplicates()
        found = []
        for kind in ("above", "below") if held is not None else ():
            some, past = self.side(held, kind)
            found.append(some.assign(alert_type=kind, past=pd.Series(past, index=some.index, dtype="object")))
        for part in found:
            yield part.assign(project_id=key[0])[["project_id", "timestamp", "price", "alert_type", "past"]]

    def steps(self, frame: pd.DataFrame) -> pd.DataFrame:
        return pd.concat([self.side(frame, kind)[0] for kind in ("above", "below")]).drop_duplicates()

    @staticmethod
    def side(frame: pd.DataFrame, kind: str) -> tuple[pd.DataFrame, list]:
        """Rows that pass all before them, in time order, and the price passed, None for the first. NaN is above all numbers."""
        rows = frame[["timestamp", "price"]].sort_values("timestamp", kind="stable", ignore_index=True)
        price = rows["price"].to_numpy(dtype="float64")
        most = (np.maximum if kind == "above" else np.fmin).accumulate(price)
        before = most[:-1]
        passed = (price[1:] > before) | (np.isnan(price[1:]) & ~np.isnan(before)) if kind == "above" else (
            (price[1:] < before) | (np.isnan(before) & ~np.isnan(price[1:])))
        keep = np.concatenate([[True], passed])
        return rows[keep], [None, *before[passed].tolist()]

    def close(self) -> None:
        pass


def fire_once(hits: DataFrame, delay: str | None = "1 day", keep_days: int = 90, shards: int = 2048) -> DataFrame:
    """First hit of every alert (ST3); the state is one flag per fired alert, kept in ``shards`` lists.

    A flag expires ``keep_days`` after its hit, when the watermark has passed that time; by then the alert should be gone
    from the static side, or it may fire again. Hits later than the watermark are dropped. Without ``delay``, ``hits`` must
    have a watermark on ``timestamp``. The number of shards stays as it is while a checkpoint is used.
    """
    fields = {f.name: f.dataType.simpleString() for f in hits.schema}
    schema = ", ".join(f"{c} {fields[c]}" for c in ("alert_id", "project_id", "timestamp", "price"))
    timed = hits.withColumn("timestamp", F.col("timestamp").cast("timestamp")).withWatermark("timestamp", delay) if delay else hits
    return timed.withColumn("_shard", F.pmod(F.xxhash64("alert_id"), F.lit(shards))).groupBy("_shard").transformWithStateInPandas(
        FireOnce(keep_days, fields["alert_id"]), schema, "append", "eventtime")


class FireOnce(StatefulProcessor):
    """Flags of the fired alerts of a shard: ids and the times of their hits."""

    def __init__(self, keep_days: int, id_type: str):
        self.keep_ms, self.id_type = keep_days * DAY_MS, id_type

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.fired = handle.getValueState("fired", f"ids array<{self.id_type}>, ats array<bigint>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        flags = self.known(timerValues)
        best = None
        for frame in rows:  # batches are streamed; one row of an alert is held
            new = frame[~frame["alert_id"].isin(list(flags))]
            best = (new if best is None else pd.concat([best, new])).sort_values("timestamp", kind="stable").drop_duplicates("alert_id")
        if best is not None and len(best):
            ats = best["timestamp"].astype("datetime64[us]").astype("int64") // 1000
            flags.update(zip(best["alert_id"].tolist(), ats.tolist()))
            self.store(flags, timerValues)
            yield best[["alert_id", "project_id", "timestamp", "price"]]

    def known(self, timerValues) -> dict:
        """Flags that have not expired."""
        if not self.fired.exists():
            return {}
        ids, ats = self.fired.get()
        passed = timerValues.getCurrentWatermarkInMs() - self.keep_ms
        return {i: at for i, at in zip(ids, ats) if at > passed}

    def store(self, flags: dict, timerValues) -> None:
        if flags:
            self.fired.update((list(flags), list(flags.values())))
            self.handle.registerTimer(max(min(flags.values()) + self.keep_ms, timerValues.getCurrentWatermarkInMs() + 1))
        else:
            self.fired.clear()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.fired.exists():
            self.store(self.known(timerValues), timerValues)
        return iter(())

    def close(self) -> None:
        pass


def pump_dump(bars: DataFrame, delay: str = "1 day", window: int = 7, k: float = 2.0, chunk_ms: int = DAY_MS) -> DataFrame:
    """Pump and dump flags against the last ``window`` bars of each series (ST4).

    Bars wait in the state, cut into chunks of ``chunk_ms``. When the watermark (``delay`` behind the newest bar of all
    series) has passed the end of a chunk, a timer releases its bars in time order, so bars that arrive out of order within
    the delay are placed right, and a task holds one chunk of a series at a time, also in a backfill. Later bars are dropped.
    Of several bars with one time the last one wins. Between chunks the state keeps the last ``window - 1`` prices.
    """
    timed = bars.withColumn("timestamp", F.col("timestamp").cast("timestamp")).withWatermark("timestamp", delay)
    return timed.select("project_id", "timestamp", "price").groupBy("project_id").transformWithStateInPandas(
        PumpDump(window, k, chunk_ms), "project_id string, timestamp timestamp, price double, pump int, dump int", "append",
        "eventtime")


class PumpDump(StatefulProcessor):
    def __init__(self, window: int, k: float, chunk_ms: int):
        self.window, self.k, self.chunk_ms = window, k, chunk_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.past = handle.getValueState("past", "prices array<double>")
        self.waiting = handle.getMapState("waiting", "chunk bigint", "times array<bigint>, prices array<double>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:
            times = frame["timestamp"].astype("datetime64[us]").astype("int64")
            bars = pd.DataFrame({"t": times, "p": frame["price"].astype("float64")})
            for chunk, part in bars.groupby(times // (1000 * self.chunk_ms)):
                mark = (int(chunk),)
                if self.waiting.containsKey(mark):
                    old = self.waiting.getValue(mark)
                else:
                    old = ([], [])
                    self.handle.registerTimer(int(chunk + 1) * self.chunk_ms)
                self.waiting.updateValue(mark, ([*old[0], *map(int, part["t"])], [*old[1], *map(float, part["p"])]))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = (expiredTimerInfo.getExpiryTimeInMs() // self.chunk_ms - 1,)
        if not self.waiting.containsKey(mark):
            return
        times, prices = self.waiting.getValue(mark)
        self.waiting.removeKey(mark)
        bars = pd.Series(dict(zip(times, prices)), dtype="float64").sort_index()
        past = list(self.past.get()[0]) if self.past.exists() else []
        series = pd.Series([*past, *bars], dtype="float64")
        mean, sd = series.rolling(self.window).mean(), series.rolling(self.window).std()
        up, down = series > mean + self.k * sd, series < mean - self.k * sd
        self.past.update(([float(x) for x in series.tail(self.window - 1)],))
        n = len(past)
        yield pd.DataFrame({
            "project_id": key[0], "timestamp": pd.to_datetime(bars.index, unit="us"), "price": bars.to_numpy(),
            "pump": up[n:].astype("int32").to_numpy(), "dump": down[n:].astype("int32").to_numpy()})

    def close(self) -> None:
        pass
