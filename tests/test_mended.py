"""Cases that the test tables don't have."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from marketloom.functions.jsonops import flatten_json
from marketloom.operators import aggregates, encoding, series
from marketloom.plans import signals, similarity
from marketloom.registry import io
from marketloom.sources import stores

START = dt.datetime(2024, 1, 1)


def ticks(spark, n, price):
    rows = [("a", START + dt.timedelta(hours=i), float(price(i)), 1.0, 1.0) for i in range(n)]
    return spark.createDataFrame(rows, "project_id string, timestamp timestamp, price double, volume double, market_cap double")


@pytest.mark.parametrize("span", [1, 2, 3, 5, 12])
def test_exponential_mean_over_several_blocks(spark, span):
    def price(i):
        return 100 + 7 * (i % 13) - i % 5

    got = [r.e for r in series.ewm_mean(ticks(spark, 5000, price), ["project_id"], "timestamp", "price", span, "e")
           .orderBy("timestamp").collect()]
    want, a = [price(0)], 2 / (span + 1)
    for i in range(1, 5000):
        want.append(want[-1] + a * (price(i) - want[-1]))
    assert len(got) == 5000 and max(abs(x - y) for x, y in zip(got, want)) < 1e-9


def test_week_change_needs_one_row_more_than_the_indicators(spark):
    state = signals.trading_signals(ticks(spark, 400, lambda i: 100 + i)).collect()[0]
    assert state.change_7d == pytest.approx((499 - 331) / 331 * 100)
    steep = signals.trading_signals(ticks(spark, 400, lambda i: 100 + i + (i % 7 == 0) * -3)).collect()[0]
    assert (steep.action, steep.rsi_label) == ("sell", "overbought")
    assert signals.trading_signals(ticks(spark, 168, lambda i: 100 + i)).collect()[0].change_7d == 0


def test_history_without_limit(spark):
    rows = spark.range(150_000).select(
        F.lit("a").alias("project_id"), F.timestamp_seconds(F.col("id") * 3600).alias("timestamp"),
        *[F.lit(1.0).alias(c) for c in ("price", "volume", "market_cap")])
    assert aggregates.history_buckets(rows, "1h", "all").count() == 150_000
    assert aggregates.history_buckets(rows, "1h", "1d").count() == 24
    with pytest.raises(ValueError):
        aggregates.history_buckets(rows, "1h", "2d")


@pytest.mark.parametrize("size,want", [
    ("15min", "2024-05-17 13:45:00"), ("5T", "2024-05-17 13:45:00"), ("2H", "2024-05-17 12:00:00"),
    ("1D", "2024-05-17 00:00:00"), ("1W", "2024-05-13 00:00:00"), ("2M", "2024-05-01 00:00:00"),
    ("4M", "2024-05-01 00:00:00"), ("2Q", "2024-01-01 00:00:00"), ("2Y", "2024-01-01 00:00:00"), ("5Y", "2020-01-01 00:00:00")])
def test_window_sizes(spark, size, want):
    one = spark.sql("select timestamp'2024-05-17 13:47:31' as t")
    assert str(one.select(aggregates.time_bucket(F.col("t"), size).alias("b")).first().b) == want
    with pytest.raises(ValueError):
        aggregates.time_bucket(F.col("t"), "3X")


def test_string_leaves_with_brackets_stay(spark):
    text = '{"a": "[draft] note", "b": "{x", "c": ["[1]x", "[1] [2]", "[1],[2]", {"d": "[]?"}], "e": [1, "two"]}'
    rows = flatten_json(spark.createDataFrame([(1, text)], "k int, j string"), "k", "j", 4).collect()
    assert {(r.path, r.value) for r in rows} == {
        ("a", "[draft] note"), ("b", "{x"), ("c[0]", "[1]x"), ("c[1]", "[1] [2]"), ("c[2]", "[1],[2]"), ("c[3].d", "[]?"), ("e[0]", "1"), ("e[1]", "two")}


@pytest.mark.parametrize("n", [1, 2, 3, 4, 8])
def test_binary_code_of_null_is_its_own(spark, n):
    for nulls in (0, 1):
        rows = [(f"v{i}",) for i in range(n)] + [(None,)] * nulls
        out = encoding.encode_categorical(spark.createDataFrame(rows, "t string"), ["t"], "binary", drop_original=False)
        assert len({tuple(r[1:]) for r in out.collect()}) == n + nulls


def test_repeated_incoming_prices_are_taken_whole(spark):
    kind = "project_id string, timestamp timestamp, price double, volume double, seq int"
    stored = spark.createDataFrame([("a", START, 1.0, 1.0, 0), ("b", START, 2.0, 2.0, 0)], kind)
    incoming = spark.createDataFrame([("a", START, 5.0, 1.0, 2), ("a", START, 4.0, 9.0, 1), ("a", START, 3.0, None, 3)], kind)
    now = F.lit(START + dt.timedelta(days=1))
    out = stores.upsert_prices(stored.repartition(5), incoming.repartition(3), now, 7, ["seq"]).collect()
    assert {(r.project_id, r.price, r.volume) for r in out} == {("a", 3.0, None), ("b", 2.0, 2.0)}


def test_pages_keep_the_first_row_by_order(spark):
    page = spark.createDataFrame([("x", "late", 2), ("x", "early", 1), ("y", "b", 1), ("y", "a", 1)], "id string, v string, n int")
    other = spark.createDataFrame([("x", "never", 0), ("z", "new", 5)], "id string, v string, n int")
    out = stores.combine_pages([page.repartition(4), other], order=["n"]).collect()
    assert {(r.id, r.v) for r in out} == {("x", "early"), ("y", "a"), ("z", "new")}


def test_weak_neighbours_are_found_by_the_bound_of_each_pair(spark):
    import math
    import random
    from collections import defaultdict

    from marketloom.plans.recommend import weak_user_parts

    rng = random.Random(4)
    rows = {(u, i): float(rng.randrange(1, 6)) for u in range(25) for i in rng.sample(range(4000), 6)}
    rows |= {(100, i): 5.0 for i in range(4000)} | {(101, i): 3.0 for i in range(0, 4000, 3)} | {(7, 1): 0.0}
    frame = spark.createDataFrame([(u, i, r) for (u, i), r in rows.items()], "user_id long, item_id long, rating double")
    by_user = defaultdict(dict)
    for (u, i), r in rows.items():
        by_user[u][i] = r
    length = {u: math.sqrt(sum(r * r for r in m.values())) for u, m in by_user.items()}
    want = defaultdict(lambda: [0.0, 0.0])
    for u in by_user:
        for v in by_user:
            dot = sum(r * by_user[v].get(i, 0.0) for i, r in by_user[u].items())
            sim = dot / (length[u] * length[v])
            if u != v and 0 < sim <= 0.1:
                for i, r in by_user[v].items():
                    want[u, i][0] -= sim * r
                    want[u, i][1] -= sim
    got = {(r.user_id, r.item_id): (r.num, r.den) for r in weak_user_parts(frame, 0.1).collect()}
    assert want and got.keys() == want.keys()
    assert all(abs(got[k][0] - want[k][0]) < 1e-9 and abs(got[k][1] - want[k][1]) < 1e-9 for k in want)


def test_walk_json_opens_every_level(spark):
    """Against a plain walk: unequal depths, strings that look like JSON, unreadable and null texts."""
    import json

    from marketloom.functions.jsonops import walk_json

    deep = 7
    for n in range(40):
        deep = {"a": deep} if n % 2 else [n, deep]
    texts = {
        1: json.dumps({"a": 1, "b": {"c": [True, None, {"d": "x"}]}, "e": {}, "f": []}), 2: json.dumps(deep), 3: "[[[]]]",
        4: '"[1, 2]"', 5: json.dumps({"s": '{"not": "opened"}', "a.b": 2}), 6: "{broken", 7: None, 8: "", 9: "null", 10: "12"}

    def leaves(value, path=""):
        if isinstance(value, dict):
            for k, v in value.items():
                yield from leaves(v, f"{path}.{k}" if path else k)
        elif isinstance(value, list):
            for n, v in enumerate(value):
                yield from leaves(v, f"{path}[{n}]")
        else:
            yield path, value if value is None or isinstance(value, str) else json.dumps(value)

    want = [(i, p, v) for i, t in texts.items() if i not in (6, 7, 8) for p, v in leaves(json.loads(t))]
    want += [(6, "", "{broken"), (7, "", None), (8, "", "")]
    df = spark.createDataFrame(list(texts.items()), "path long, v string")  # names that the walk itself uses
    got = walk_json(df.withColumnsRenamed({"path": "id"}), "id", "v").collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert walk_json(df.limit(0).withColumnsRenamed({"path": "id"}), "id", "v").collect() == []


def test_similar_items_of_one_item_without_the_whole_neighbour_table(spark, monkeypatch):
    rows = [(i, f"n{i}", f"c{i % 3}", f"p{i % 2}", *[float((i * (c + 3)) % 11) for c in range(7)]) for i in range(40)]
    items = spark.createDataFrame(rows, ["id", "name", "chain", "primary_category", *similarity.NUMERIC_FEATURES])
    want = [tuple(r) for r in similarity.similar_items(items, 5).filter("i = 7").orderBy("rank").collect()]

    def refused(*_, **__):
        raise AssertionError("compares all items with all")

    monkeypatch.setattr(similarity, "weighted_feature_similarity", refused)
    got = [tuple(r) for r in similarity.similar_items(items, 5, only=7).orderBy("rank").collect()]
    assert len(got) == 5 and [(*r[:5], round(r[5], 9), r[6]) for r in got] == [(*r[:5], round(r[5], 9), r[6]) for r in want]


def test_cosine_within_ids_drops_the_other_members_before_pairing(spark):
    rows = spark.createDataFrame([(u, i, 1.0 + (u + i) % 4) for u in range(6) for i in range(8)], "user_id long, item_id long, rating double")
    ids = spark.createDataFrame([(1,), (2,), (5,), (99,)], "id long")
    whole = {(r.i, r.j): round(r.sim, 9) for r in similarity.item_cosine(rows).collect()}
    got = {(r.i, r.j): round(r.sim, 9) for r in similarity.item_cosine(rows, ids).collect()}
    assert got == {p: s for p, s in whole.items() if set(p) <= {1, 2, 5}} and len(got) == 3


def test_stored_similarities_are_computed_once(spark, monkeypatch):
    plans, save = [], stores.save_similarity

    def noted(sim, sim_type, path):
        if sim_type == "orders":
            plans.append(sim._jdf.queryExecution().executedPlan().toString())
        save(sim, sim_type, path)

    monkeypatch.setattr(stores, "save_similarity", noted)
    io.sim_store(spark, "/root/testdata/sf0.001")
    assert len(plans) == 2 and not any("Exchange" in p for p in plans)
