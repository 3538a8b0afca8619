import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_simhash import classes

from marketloom.llm import keyfilter, minhash


def plain_set(text):
    words = (text or "").encode().lower().split()
    if len(words) < 2:
        return frozenset(map(bytes, words))
    return frozenset(zip(words, words[1:]))


def by_definition(docs, percent=80):
    """doc_id -> (set size, component)."""
    sets = {i: plain_set(t) for i, t in docs.items()}
    pairs = [(a, b) for a in docs for b in docs if a < b and sets[a] and sets[b]
             and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    found = classes(pairs, docs)
    return {i: (len(sets[i]), found[i]) for i in docs}


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10**9)}"
    return words


@pytest.mark.parametrize("seed", [1, 2])
def test_components_by_definition(spark, seed):
    rng = random.Random(seed)
    docs = {}
    for _ in range(12):  # stars of copies around an original that may be missing, and chains of edits
        base = [f"w{rng.randrange(400)}" for _ in range(rng.randrange(20, 200))]
        if rng.random() < 0.7:
            docs[len(docs)] = " ".join(base)
        for _ in range(rng.randrange(12)):
            docs[len(docs)] = " ".join(edited(rng, base, rng.randrange(1, 2 + len(base) // 18)))
        for _ in range(rng.randrange(6)):
            base = edited(rng, base, max(1, len(base) // 25))
            docs[len(docs)] = " ".join(base)
    ids = list(docs)
    rng.shuffle(ids)
    docs = {i: docs[n] for n, i in enumerate(ids)}
    got = minhash.near_duplicates(spark.createDataFrame(list(docs.items()), "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == by_definition(docs)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_open_buckets_in_several_cells(spark, monkeypatch):
    """Copies that are linked with few others, in cells much smaller than their buckets."""
    monkeypatch.setattr(minhash, "CELL", 8)
    rng = random.Random(5)
    base = [f"w{n}" for n in range(120)]
    docs = {n: " ".join(edited(rng, base, rng.randrange(3, 9))) for n in range(60)}
    got = minhash.near_duplicates(spark.createDataFrame(list(docs.items()), "doc_id long, text string")).collect()
    want = by_definition(docs)
    assert {r.doc_id: r.component_id for r in got} == {i: c for i, (_, c) in want.items()}
    assert 2 <= len({c for _, c in want.values()}) < 60


def test_nulls_empty_short_repeated_and_long_texts(spark):
    long = " ".join(f"w{n % 30000}" for n in range(60000))
    rows = [(5, "One", "x"), (3, "one", "y"), (7, "one two", None), (2, None, "n"), (8, "", "e"), (9, " \t\n", "b"),
            (None, "a b c d e f g", "q"), (6, "A b c d e f g", "r"), (6, "A b c d e f g", "r"), (None, "alone here", "s"),
            (None, None, "t"), (11, long, "l"), (10, long + " end", "l")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, bucket string").withColumn("rid", F.lit(1))
    got = sorted(map(tuple, minhash.near_duplicates(docs).collect()), key=str)
    want = [(5, 1, 3, False), (3, 1, 3, True), (7, 1, 7, True), (2, 0, 2, True), (8, 0, 8, True), (9, 0, 9, True),
            (None, 6, 6, True), (6, 6, 6, True), (6, 6, 6, True), (None, 1, None, True), (None, 0, None, True),
            (11, 30000, 10, False), (10, 30001, 10, True)]
    assert got == sorted(want, key=str)
    assert minhash.near_duplicates(docs.limit(0)).count() == 0
    assert minhash.near_duplicates(docs.filter("text is null")).count() == 2


def test_the_limit_is_exact():
    a = np.arange(90, dtype=np.uint64)
    assert minhash.linked(a[:80], np.concatenate([a[:72], a[80:]]), 80)  # 72 of 90
    assert not minhash.linked(a[:80], np.concatenate([a[:71], a[80:]]), 80)
    assert minhash.linked(a[:4], a[:5], 80) and not minhash.linked(a[:3], a[:4], 80)
    assert not minhash.linked(a[:3], a[5:8], 80)


def test_pruning_keeps_close_pairs_and_drops_others():
    rng = np.random.default_rng(3)
    needed = minhash.needed_matches(80, minhash.MISS)
    assert needed == sorted(needed) and len(needed) == minhash.HASHES // minhash.BATCH
    kept = {}
    for similarity in (0.5, 0.8):
        match = rng.random((4000, minhash.HASHES)) < similarity
        kept[similarity] = len(minhash.bayes_survivors(match.astype("<u2"), np.ones_like(match, "<u2"), needed)) / 4000
    assert kept[0.8] > 0.999 and kept[0.5] < 0.001


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(4)
    drawn = rng.integers(0, 1 << 63, 1100, dtype=np.uint64)
    a, b = np.unique(drawn[:1000]), np.unique(drawn[100:])
    assert abs((minhash.signature(a) == minhash.signature(b)).mean() - 900 / 1100) < 0.07


def test_key_filter_loses_no_key(spark):
    keys = spark.range(-500, 5000).selectExpr("xxhash64(id) as k").unionByName(spark.sql("select cast(null as long) as k"))
    held = keyfilter.KeyFilter.of(keys)
    assert held.keep(keys, "k").count() == 5500
    assert held.keep(spark.range(100000).selectExpr("xxhash64(id, 7) as k"), "k").count() < 100
