import ctypes

import pyarrow as pa
import pytest
from marketloom.llm.common import map_columns, portions, release_memory, worker_cache


def test_a_worker_holds_the_memory_of_one_operator():
    worker_cache("a")["x"] = 1
    assert worker_cache("a") == {"x": 1}
    assert worker_cache("b") == {} and worker_cache("a") == {}


@pytest.mark.parametrize("texts", [[], [b""], [None, b"a" * 50_000, b"", None], [b"word"] * 1_000, [None] * 7])
def test_portions_are_the_batch(texts):
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.binary())], names=["t"])
    parts = list(portions(batch, 1_000))
    assert [t for p in parts for t in p["t"].to_pylist()] == texts
    assert all(p.num_rows for p in parts)
    if len(texts) == 1_000:
        assert len(parts) >= 8 and max(p.num_rows for p in parts) <= 125


def test_portions_of_a_slice_stay_inside_it():
    batch = pa.RecordBatch.from_arrays([pa.array(range(1_000), pa.int64())], names=["n"]).slice(100, 50)
    assert [n for p in portions(batch, 80) for n in p["n"].to_pylist()] == list(range(100, 150))


def test_map_columns_meets_every_row_once(spark):
    rows = spark.range(0, 5_000, 1, 3).selectExpr("id", "repeat('x', cast(id as int)) AS text")
    out = map_columns(rows, lambda ids, texts: ([len(ids)], [sum(map(len, texts))]), "n long, size long").collect()
    assert sum(r.n for r in out) == 5_000 and sum(r.size for r in out) == 5_000 * 4_999 // 2
    assert len(out) > 3  # 12 MB of text in three tasks


def test_release_memory_without_the_call_of_the_c_library(monkeypatch):
    release_memory()
    monkeypatch.setattr(ctypes, "CDLL", lambda name: object())
    release_memory()
