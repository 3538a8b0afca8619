import math

import numpy as np
import pytest

from marketloom.llm import topk


def by_definition(rows, is_query, k):
    whole = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            w = [min(math.floor(1024 * float(x)), (1 << 63) - 1) for x in v]
            whole[i] = min(whole.get(i, w), w)
    out = []
    for q in filter(is_query, whole):
        scored = sorted((-min(sum(a * b for a, b in zip(whole[q], w)), (1 << 63) - 1), i) for i, w in whole.items()
                        if i != q and len(w) == len(whole[q]))
        out += [(q, r, i, -s) for r, (s, i) in enumerate(scored[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("block,part,depth", [(8192, 1024, 16), (40, 3, 1), (7, 100, 2)])
def test_against_definition(spark, monkeypatch, block, part, depth):
    monkeypatch.setattr(topk, "CANDIDATES", block)
    monkeypatch.setattr(topk, "QUERIES", part)
    monkeypatch.setattr(topk, "FIRST_DEPTH", depth)
    rng = np.random.default_rng(block)
    centres = rng.normal(size=(4, 6))
    rows = [(i, [float(x) for x in np.float32(centres[i % 4] + rng.normal(size=6) / 20)]) for i in range(120)]
    rows += [(200 + i, [0.5, -0.25, 0.0, 0.0, 1.0, 0.0]) for i in range(40)]  # one common vector: ties
    rows += [(300, [0.0] * 6), (301, None), (302, [1.0, None] + [0.0] * 4), (303, [float("nan")] * 6),
             (304, [float("inf")] * 6), (None, [1.0] * 6), (310, [1.0, 2.0]), (320, [3.0, -1.0]), (330, []), (340, []),
             (350, [3e38, 1.0]), rows[10], (20, [9.0] * 6)]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, size int")
    points = topk.scaled(frame)
    got = topk.nearest(points, points.filter("id % 10 = 0"), 10).collect()
    float32 = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    assert sorted(map(tuple, got)) == by_definition(float32, lambda i: i % 10 == 0, 10)


def test_the_walk_stops_early_and_stays_exact():
    rng = np.random.default_rng(5)
    points = np.floor(rng.pareto(2.0, size=(4000, 4)) * 1024)
    order = np.argsort(points, axis=0, kind="stable")

    class Counting(np.ndarray):
        rows = 0

        def __getitem__(self, key):
            if isinstance(key, np.ndarray) and key.ndim == 1 and not isinstance(key, tuple):
                Counting.rows += len(key)
            return np.asarray(self)[key]

    counted = points.view(Counting)
    for q in points[:20]:
        rows, scores = topk.walk(q, counted, order, 10, -1)
        every = points @ q
        best = np.lexsort((np.arange(len(every)), -every))[:10]
        assert rows.tolist() == best.tolist() and scores.tolist() == every[best].tolist()
    assert Counting.rows < 20 * len(points) / 2


def test_empty(spark):
    none = topk.scaled(spark.createDataFrame([], "vec_id long, embedding array<float>"))
    assert topk.nearest(none, none).count() == 0


@pytest.mark.parametrize("k", [15, 16, 20])
def test_the_walk_is_exact_when_a_step_meets_just_k_rows(k):
    for seed in range(300):
        rng = np.random.default_rng(seed)
        points = np.floor(rng.normal(size=(60, 1)) * 4 + rng.normal(size=(60, 2)) * 2)
        order = np.argsort(points, axis=0, kind="stable")
        for own in (-1, 7):
            rows, scores = topk.walk(np.array([3.0, 2.0]), points, order, k, own)
            every = points @ np.array([3.0, 2.0])
            best = [i for i in np.lexsort((np.arange(60), -every)) if i != own][:k]
            assert rows.tolist() == best and scores.tolist() == every[best].tolist()


@pytest.mark.parametrize("block,part", [(8192, 1024), (5, 2)])
def test_every_row_with_a_repeated_id_is_a_candidate(spark, monkeypatch, block, part):
    monkeypatch.setattr(topk, "CANDIDATES", block)
    monkeypatch.setattr(topk, "QUERIES", part)
    rng = np.random.default_rng(2)
    rows = [(int(i), [float(x) for x in rng.integers(-9, 9, 3)]) for i in rng.integers(0, 12, 40)]
    rows += [rows[0]] * 9 + [(0, [9.0, 1.0, 2.0])] * 2 + [(0, [-9.0, 1.0, 2.0])]
    points = topk.scaled(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), factor=1, unique=False)
    got = sorted(map(tuple, topk.nearest(points, points.filter("id % 5 = 0"), 6).collect()))
    want = []
    for q in {i for i, _ in rows if i % 5 == 0}:
        scored = sorted((-int(np.dot(v, w)), i) for j, v in rows if j == q for i, w in rows if i != q)
        want += [(q, r, i, -s) for r, (s, i) in enumerate(scored[:6], 1)]
    assert got == sorted(want)
