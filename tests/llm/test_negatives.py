import random
from collections import Counter

import numpy as np
import pytest

from marketloom.llm import negatives

SCHEMA = "id long, label long, v array<double>"


def dot(a, b):
    return sum(int(x) * int(y) for x, y in zip(a, b))


def by_definition(rows, anchors, n_pos=5, n_neg=5):
    out = Counter()
    for anchor, label, v in {(i, x, tuple(v)) for i, x, v in anchors}:
        others = sorted((-dot(v, w), i, x) for i, x, w in rows if i != anchor and len(w) == len(v))
        for s, pos, _ in [o for o in others if o[2] == label][:n_pos]:
            near = [(-t, i) for t, i, x in others if x != label and 80 * -s <= 100 * -t <= 100 * -s][:n_neg]
            out.update((anchor, pos, r, i, -s, t) for r, (t, i) in enumerate(near, 1))
    return out


def mined(spark, rows, anchors):
    frames = [spark.createDataFrame([(i, x, [float(c) for c in v]) for i, x, v in part], SCHEMA) for part in (rows, anchors)]
    return Counter(tuple(r) for r in negatives.hard_negatives(*frames).collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_against_all_scores(spark, monkeypatch, seed):
    monkeypatch.setattr(negatives, "BLOCK", 60)
    monkeypatch.setattr(negatives, "ANCHORS", 7)
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(4, 24))
    rows = [(n, int(n % 5), np.floor(40 * (centres[n % 4] + rng.normal(size=24) * 0.6)).tolist()) for n in range(400)]
    anchors = rows[::20]
    want = by_definition(rows, anchors)
    assert len(want) > 100 and mined(spark, rows, anchors) == want


def test_ties_repeats_lengths_signs_and_single_labels(spark):
    rng = random.Random(3)
    rows = [(n, n % 2, [1, 2, 0]) for n in range(12)] + [(50 + n, n % 2, [rng.randrange(-2, 3) for _ in range(3)])
                                                        for n in range(40)]
    rows += [rows[3]] * 9 + [(4, 1, [2, 2, 2]), (70, 0, [1.0]), (71, 1, [1.0]), (72, 0, [1.0]), (90, 7, [5, 5, 5]), (91, 0, []),
                             (92, 0, []), (93, 1, []), (94, 0, [0, 0, 0]), (95, 1, [-1, -2, 0])]
    anchors = [r for r in rows if r[0] in (0, 3, 4, 55, 70, 90, 91, 94, 95)]
    assert mined(spark, rows, anchors) == by_definition(rows, anchors)


def test_beyond_exact_doubles(spark):
    big = float(1 << 29)
    rows = [(n, n % 2, [big + n, big - 3 * n, 1.0]) for n in range(30)]
    assert mined(spark, rows, rows[:3]) == by_definition(rows, rows[:3])


def test_the_scan_drops_candidates_early():
    rng = np.random.default_rng(5)
    columns = np.floor(rng.normal(size=(64, 2000)) * 50) * (0.8 ** np.arange(64))[:, None] // 1
    query = columns[:, 7].copy()
    scores = query @ columns
    found, best = negatives.scan(query, columns, columns.min(axis=1), columns.max(axis=1), np.arange(2000), [(-np.inf, np.inf)], 5)[0]
    assert found.tolist() == np.lexsort((np.arange(2000), -scores))[:5].tolist() and best.tolist() == scores[found].tolist()


def test_rows_that_take_no_part_and_clashing_columns(spark):
    schema = "vec_id long, embedding array<float>, label int, size int, block string, anchor int"
    rows = [(1, [0.5, 0.5], 1), (2, [0.5, None], 1), (3, None, 1), (4, [float("nan"), 1.0], 1), (5, [float("inf"), 1.0], 1),
            (6, [0.5, 0.4], None), (None, [0.5, 0.5], 1), (7, [0.5, 0.5], 1), (8, [0.5, 0.45], 2)]
    vectors = spark.createDataFrame([(*r, 1, "b", 2) for r in rows], schema)
    points = negatives.prepared(vectors)
    assert sorted(r.id for r in points.collect()) == [1, 7, 8]
    got = negatives.hard_negatives(points, points.filter("id = 1")).collect()
    assert [tuple(r) for r in got] == [(1, 7, 1, 8, 128 * 128 * 2, 128 * 128 + 128 * 115)]
    assert negatives.hard_negatives(points.limit(0), points).count() == 0
    assert negatives.hard_negatives(points, points.limit(0)).count() == 0
