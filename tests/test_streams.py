"""Replays, restarts, late rows, backfills and expiry of the streaming jobs; layout of the bucketed tables."""

import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F

from marketloom.operators.aggregates import user_item_max
from marketloom.plans import recommend, similarity
from marketloom.session import staging_path
from marketloom.sources import stores
from marketloom.streaming import jobs
from marketloom.streaming.ratings import RatingsTable

START = dt.datetime(2024, 1, 1)
EVENTS = "event_id long, user_id long, item_id long, interaction_type string, weight int, ts timestamp"


def arriving(spark, slices, schema):
    """A folder with one file for each slice, in the order of arrival."""
    path = staging_path(spark, "arriving")
    for rows in slices:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return path


def interactions(n, first=0):
    return [(first + i, i % 7, i % 11 * (1 + i % 3), "click", 1 + i * 7 % 5, START + dt.timedelta(minutes=first + i))
            for i in range(n)]


def held(table):
    return sorted(map(tuple, table.read().collect()))


def largest(slices):
    best = {}
    for _, u, i, _, w, _ in (r for rows in slices for r in rows):
        best[u, i] = max(w, best.get((u, i), 0))
    return sorted((u, i, float(w)) for (u, i), w in best.items())


def test_merged_ratings_survive_restarts_and_replays(spark, monkeypatch):
    slices = [interactions(40), interactions(50, 40), interactions(30, 90)]
    path = arriving(spark, slices, EVENTS)
    table = RatingsTable(spark, staging_path(spark, "ratings"), buckets=4)
    checkpoint = staging_path(spark, "cp")

    def stream():
        return table.follow(jobs.valid_interactions(jobs.file_stream(spark, path, EVENTS, 1)), checkpoint)

    commit, calls = RatingsTable._commit, []

    def broken(self, batch_id, version, touched):  # fails once, behind the data and in front of the ledger
        calls.append(batch_id)
        if len(calls) == 2:
            raise OSError("lost")
        commit(self, batch_id, version, touched)

    monkeypatch.setattr(RatingsTable, "_commit", broken)
    with pytest.raises(Exception, match="lost"):
        stream().awaitTermination()
    assert held(table) == largest(slices[:1])
    stream().awaitTermination()
    assert held(table) == largest(slices) and len(calls) >= 4
    events = spark.createDataFrame([r for rows in slices for r in rows], EVENTS)
    twin = sorted((r.user_id, r.item_id, float(r.rating)) for r in user_item_max(events).collect())
    assert held(table) == twin
    before = table._versions()
    table.merge(events.withColumn("weight", F.lit(5)), calls[0])  # a replay of a batch that is in the ledger
    assert held(table) == twin and table._versions() == before


def test_a_batch_touches_only_its_buckets(spark):
    table = RatingsTable(spark, staging_path(spark, "ratings"), buckets=16)
    rows = spark.range(400).selectExpr("id % 20 as user_id", "id as item_id", "3 as weight")
    table.merge(rows, 0)
    first = table._versions()
    table.merge(rows.filter("item_id = 7").withColumn("weight", F.lit(1)), 1)
    table.merge(rows.filter("item_id < 0"), 2)
    second = table._versions()
    assert len(first) == 16 and sum(first[b] != second[b] for b in first) == 1
    assert table.read().count() == 400 and table.read().agg(F.min("rating")).first()[0] == 3


def bars(series, hours, price=lambda h: 100 + h * 13 % 17 + (h % 29 == 0) * 60):
    return [(series, START + dt.timedelta(hours=h), float(price(h))) for h in hours]


def flags(rows, window=7, k=2.0):
    out = {}
    for name, part in pd.DataFrame(sorted(set(rows)), columns=["s", "t", "p"]).groupby("s"):
        mean, sd = part.p.rolling(window).mean(), part.p.rolling(window).std()
        for t, p, u, d in zip(part.t, part.p, part.p > mean + k * sd, part.p < mean - k * sd):
            out[name, t.to_pydatetime()] = (p, int(u), int(d))
    return out


def streamed(spark, slices, **options):
    jobs.use_rocksdb(spark)
    path = arriving(spark, slices, "project_id string, timestamp timestamp, price double")
    frame = jobs.pump_dump(jobs.file_stream(spark, path, "project_id string, timestamp timestamp, price double", 1), **options)
    out = staging_path(spark, "out")
    jobs.to_files(frame, out, staging_path(spark, "cp")).awaitTermination()
    rows = spark.read.schema(frame.schema).parquet(out).collect()
    return {(r.project_id, r.timestamp): (r.price, r.pump, r["dump"]) for r in rows}, len(rows)


def test_late_rows_are_placed_or_dropped(spark):
    on_time = bars("a", range(0, 60)) + bars("b", range(0, 200, 2))
    unordered = bars("a", [*range(90, 120), *range(60, 90)])  # a day late at most
    end = bars("a", range(120, 400))
    too_late = bars("a", [5.5, 30.5])
    got, n = streamed(spark, [on_time[:60], on_time[60:], unordered[:30], unordered[30:], end, too_late], delay="10 days")
    last = START + dt.timedelta(hours=399) - dt.timedelta(days=10)
    want = {k: v for k, v in flags(on_time + unordered + end + too_late).items()
            if k[1].replace(hour=0, minute=0) + dt.timedelta(days=1) <= last}
    assert got == want and n == len(got)  # within ten days everything is placed
    got, n = streamed(spark, [on_time[:60], end, too_late], delay="1 day")
    rest = flags(on_time[:60] + end)
    assert n == len(got) and ("a", START + dt.timedelta(hours=5.5)) not in got
    assert got == {k: rest[k] for k in got} and len(got) > 250


def test_backfill_in_chunks_equals_the_whole_history(spark):
    rows = bars("a", range(3000)) + bars("b", range(0, 3000, 5))
    got, n = streamed(spark, [rows[:-1], rows[-1:]], delay="1 hour", chunk_ms=36_000_000)
    want = flags(rows)
    assert n == len(got) > 3400 and got == {k: want[k] for k in got}


def test_alerts_fire_once_until_their_flag_expires(spark):
    jobs.use_rocksdb(spark)
    alerts = spark.createDataFrame([(1, "a", "above", 100.0), (2, "a", "below", -5.0)],
                                   "alert_id long, project_id string, alert_type string, target_price double")
    days = [[0, 1], [2, 40], [41, 42], [43, 75], [90, 91]]  # a flag goes when the watermark is 30 days behind its hit
    path = arriving(spark, [[("a", START + dt.timedelta(days=d), 150.0 + d) for d in part] for part in days],
                    "project_id string, timestamp timestamp, price double")
    ticks = jobs.file_stream(spark, path, "project_id string, timestamp timestamp, price double", 1)
    frame = jobs.fire_once(jobs.alert_hits(ticks, alerts), keep_days=30)
    out = staging_path(spark, "out")
    jobs.to_files(frame, out, staging_path(spark, "cp")).awaitTermination()
    fired = sorted((r.alert_id, (r.timestamp - START).days) for r in spark.read.schema(frame.schema).parquet(out).collect())
    assert fired == [(1, 0), (1, 41), (1, 90)]


def test_stored_matrices_join_without_an_exchange(spark):
    rows = [(u, i, float(1 + (u * i) % 5)) for u in range(60) for i in range(40) if (u + i) % 4 or i == 3]
    ratings = spark.createDataFrame(rows, "user_id long, item_id long, rating double")
    sim = similarity.item_cosine(ratings)
    path = staging_path(spark, "matrices")
    stores.save_matrices(path, ratings, buckets=8, hot_rows=20, sim_item=sim)  # every item is hot
    back = stores.load_matrices(spark, path, "ratings", "sim_item")
    assert back["ratings"].select("salt").distinct().count() >= 3
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = back["ratings"].join(back["sim_item"].filter("sim > 0.1"), ["item_id", "salt"])
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        whole = recommend.stored_item_cf(back["ratings"], back["sim_item"])._jdf.queryExecution().executedPlan().toString()
        below = whole[whole.index("SortMergeJoin"):].split("Union")[0].split("HashAggregate")[0]
        assert "Exchange" not in below
        got = recommend.stored_item_cf(back["ratings"], back["sim_item"]).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    want = recommend.item_cf(ratings, sim=sim).collect()
    key = lambda r: (r.user_id, r["rank"], r.item_id, round(r.score, 9))
    assert sorted(map(key, got)) == sorted(map(key, want)) and len(got) > 100


def test_first_hits_of_a_batch_stand_for_all_its_hits(spark):
    jobs.use_rocksdb(spark)
    alerts = spark.createDataFrame(
        [(10 * p + k, "ab"[p], "above" if k % 2 else "below", float(t)) for p in range(2) for k, t in enumerate([3, 5, 40, 70, 55, 99])],
        "alert_id long, project_id string, alert_type string, target_price double")
    prices = [50, 40, 60, 60, 3, 71, 98, 2, 55, 100, 45, 1]
    ticks = [[("a", START + dt.timedelta(hours=6 * b + h), float(prices[(3 * b + h) % 12])) for h in (2, 0, 1)] + [
        ("b", START + dt.timedelta(hours=6 * b), None)] for b in range(4)]
    ticks += [[("b", START + dt.timedelta(days=9, minutes=m), 54.0)] for m in range(2)]  # late rows are judged a batch later
    ticks.append([("b", START, 1000.0), ("b", START + dt.timedelta(days=9, hours=1), 71.0)])  # the first is too late
    path = arriving(spark, ticks, "project_id string, timestamp timestamp, price double")
    found = {}
    for name in ("first", "all"):
        stream = jobs.file_stream(spark, path, "project_id string, timestamp timestamp, price double", 1)
        hits = jobs.first_hits(stream, alerts) if name == "first" else jobs.alert_hits(stream, alerts)
        frame = jobs.fire_once(hits, None if name == "first" else "1 day")
        out = staging_path(spark, "out")
        jobs.to_files(frame, out, staging_path(spark, "cp")).awaitTermination()
        found[name] = sorted(map(tuple, spark.read.schema(frame.schema).parquet(out).collect()))
    assert found["first"] == found["all"] and len(found["all"]) > 6
    assert (15, "b") not in {r[:2] for r in found["first"]} and (13, "b") in {r[:2] for r in found["first"]}


def test_ratings_that_meet_many_neighbours_are_spread(spark, monkeypatch):
    monkeypatch.setattr(stores, "MET_ROWS", 200)
    ratings = spark.createDataFrame([(u, i, float(1 + (u * i) % 5)) for u in range(40) for i in range(12)], "user_id long, item_id long, rating double")
    sim = similarity.item_cosine(ratings)
    path = staging_path(spark, "matrices")
    stores.save_matrices(path, ratings, sim_item=sim)  # an item's 40 ratings meet 11 neighbours each
    back = stores.load_matrices(spark, path, "ratings", "sim_item")
    assert back["ratings"].select("salt").distinct().count() == 3 and back["ratings"].count() == 480
    got = recommend.stored_item_cf(back["ratings"].filter("item_id > 3"), back["sim_item"]).collect()
    want = recommend.item_cf(ratings.filter("item_id > 3"), sim=sim).collect()
    assert sorted((r.user_id, r["rank"], r.item_id, round(r.score, 9)) for r in got) == sorted(
        (r.user_id, r["rank"], r.item_id, round(r.score, 9)) for r in want)
