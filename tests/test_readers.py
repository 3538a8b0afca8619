"""Arrays cut at any byte, archives, and the options of pivots, windows and JSON columns."""

import io
import json
import os
import random
import tempfile
import zipfile

import pytest
from pyspark.sql import functions as F

from marketloom.functions.jsonops import extract_nested, parse_json_columns
from marketloom.operators import aggregates
from marketloom.plans import signals
from marketloom.sources import ranges


def hostile(rng):
    parts = ['"', "\\", "[", "]", "{", "}", ",", "\n", "é", "😀", "a", "\\\\", '\\"', ": ", "]}", "\u2028"]
    return "".join(rng.choices(parts, k=rng.randrange(40)))


@pytest.mark.parametrize("seed", range(12))
def test_every_cut_gives_the_same_records(seed):
    rng = random.Random(seed)
    rows = [{"n": n, "s": hostile(rng), "o": {"x": [hostile(rng), [1, {}]], "y": None}} for n in range(rng.randrange(25))]
    data = json.dumps(rows, indent=rng.choice([None, 1]), ensure_ascii=rng.random() < 0.5).encode()
    path = os.path.join(tempfile.mkdtemp(prefix="marketloom-"), "a.json")
    with open(path, "wb") as file:
        file.write(data)
    for size in (1, 2, 3, 7, 64, len(data) + 5):
        inside, depth, found = False, 0, []
        for start in range(0, len(data), size):
            with ranges.opened(f"file:{path}") as file:
                found += [t for _, t in ranges.records(file, start, size, inside, depth) if t.strip()]
                odd, outside, within = ranges.summarised(file, start, size)
            depth += within if inside else outside
            inside ^= odd
        assert [json.loads(t) for t in found] == rows
        assert (inside, depth) == (False, 0)


def test_one_array_is_read_by_many_tasks(spark):
    rows = [(n, f'text "{n}" [,]', (n % 7, None if n % 3 else "deep")) for n in range(3000)]
    frame = spark.createDataFrame(rows, "id long, text string, o struct<a: long, b: string>").coalesce(1)
    path = tempfile.mkdtemp(prefix="marketloom-") + "/array"
    ranges.write_json_arrays(frame, path)
    back = ranges.read_json_array(spark, path, "id long, text string, o struct<a: long, b: string>", True, 5000)
    assert back.columns == ["id", "text", "o.a", "o.b"]
    assert sorted(map(tuple, back.collect())) == sorted((i, t, *o) for i, t, o in rows) or sorted(
        map(str, map(tuple, back.collect()))) == sorted(str((i, t, *o)) for i, t, o in rows)
    tasks = spark.read.text(path).count() // 3000
    assert back.select(F.spark_partition_id().alias("p")).distinct().count() >= 5 and tasks == 1


def test_repair_and_broken_elements(spark):
    path = tempfile.mkdtemp(prefix="marketloom-")
    with open(f"{path}/a.json", "w") as file:
        file.write(' [ {"id": 1}, {""id"": 2}, {"id": nope}, {"id": 4} ]\n')
    with open(f"{path}/b.json", "w") as file:
        file.write("[]")
    with open(f"{path}/c.json", "w") as file:
        file.write("")
    got = ranges.read_json_array(spark, path, "id long", corrupt="bad", range_bytes=9).collect()
    assert sorted((r.id or 0, (r.bad or "").strip()) for r in got) == [(0, '{"id": nope}'), (1, ""), (2, ""), (4, "")]


def test_archives_with_several_members_quotes_and_bad_lines(spark):
    path = tempfile.mkdtemp(prefix="marketloom-")
    with zipfile.ZipFile(f"{path}/two.zip", "w") as archive:
        archive.writestr("a.csv", 'id,text\n1,"line one\nline, two"\n2,plain\r\n\n')
        archive.writestr("in/b.csv", "id,text\n3,é\nbad,x\n4,last")
        archive.writestr("empty.csv", "")
    ranges.write_archived_csv(spark.createDataFrame([(5, 'q"q'), (6, None)], "id long, text string").coalesce(1), f"{path}/x", "xz")
    got = ranges.read_archived_csv(spark, path, "id long, text string").collect()
    assert sorted(map(tuple, got), key=str) == [(1, "line one\nline, two"), (2, "plain"), (3, "é"), (4, "last"), (5, 'q"q'), (6, None)]
    chunks = io.BytesIO(b'a,"b\nc"\nd').read
    assert list(ranges.csv_records(iter(lambda: chunks(1), b""))) == [b'a,"b\nc"', b"d"]


def test_functions_of_the_caller_in_pivots_and_windows(spark):
    rows = [("a", "x", 1.0), ("a", "x", 4.0), ("a", "y", 2.0), ("b", "x", 5.0), ("b", None, 9.0), ("b", "z", None)]
    df = spark.createDataFrame(rows, "k string, c string, v double").withColumn("day", F.lit("2024-01-01"))
    wide = aggregates.pivot_table(df, ["k"], "c", "v", lambda c: F.max(c) - F.min(c))
    assert sorted(map(tuple, wide.collect())) == [("a", 3.0, 0.0), ("b", 0.0, None)] and wide.columns == ["k", "x", "y"]
    assert aggregates.pivot_table(df, ["k"], "c", "v", "sum", dropna=False).columns == ["k", "x", "y", "z"]
    assert aggregates.pivot_table(df.filter("c = 'z'"), ["k"], "c", "v").columns == ["k"]
    span = ("range", lambda c: F.max(c) - F.min(c))
    got = aggregates.time_windows(df, "day", "1D", ["k"], {"v": ["sum", span]}).orderBy("k").collect()
    assert [(r.k, r.v_sum, r.v_range) for r in got] == [("a", 7.0, 3.0), ("b", 14.0, 4.0)]


def test_json_columns_flattened_and_error_modes(spark):
    df = spark.createDataFrame([(1, '{"a": 1, "b": {"c": 2}}', '["x"]'), (2, "broken", None), (3, None, "[]")],
                               "id int, props string, tags_list string")
    flat = parse_json_columns(df, ["props", "tags_list"], flatten=True).orderBy("id")
    assert flat.columns == ["id", "tags_list", "props.a", "props.b"]
    assert [tuple(r) for r in flat.collect()] == [(1, ["x"], "1", '{"c":2}'), (2, [], None, None), (3, [], None, None)]
    with pytest.raises(ValueError):
        parse_json_columns(df, ["props"], flatten=True, most_keys=1)
    assert [r[-1] for r in extract_nested(df, "props", ["b.c"]).orderBy("id").collect()] == ["2", None, None]
    with pytest.raises(Exception, match="unreadable JSON in props"):
        extract_nested(df, "props", ["b.c"], errors="raise").collect()
    assert extract_nested(df.filter("id <> 2"), "props", ["a"], errors="raise").count() == 2


def test_every_user_gets_every_signal_of_the_own_level(spark):
    rows = [("p", "buy", 0.6, "r", 1.0, "positive"), ("q", "hold", 0.5, "r", None, "negative")]
    made = spark.createDataFrame(rows, "project_id string, action string, confidence double, reason string, target_price double, "
                                 "momentum_label string")
    users = spark.createDataFrame([(1, "low"), (2, None), (3, "high")], "user_id long, risk_tolerance string")
    got = sorted((r.user_id, r.project_id, r.action) for r in signals.personalised(made, users).collect())
    assert got == [(1, "p", "hold"), (1, "q", "hold"), (2, "p", "buy"), (2, "q", "hold"), (3, "p", "buy"), (3, "q", "sell")]


def test_small_ranges_share_tasks(spark):
    frame = spark.range(3000).select("id", F.lit('a "[,').alias("text")).coalesce(1)
    path = tempfile.mkdtemp(prefix="marketloom-") + "/array"
    ranges.write_json_arrays(frame, path)
    back = ranges.read_json_array(spark, path, "id long, text string", range_bytes=500)
    assert sorted(r.id for r in back.collect()) == list(range(3000))
    assert back.rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism
