import random

import pytest
import xxhash
from pyspark.sql import functions as F

from marketloom.llm import components, simhash


def by_definition(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i: i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(pairs, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def signed(v):
    return v - (1 << 64) if v >> 63 else v


@pytest.mark.parametrize("text", [None, "", " \t\n", "One", "one TWO", "a b c", "É é a B c d", "x " * 5000, "  q w e r"])
def test_fingerprint_by_definition(text):
    assert simhash.simhash(text.encode() if text is not None else None) % (1 << 64) == by_definition(text)


@pytest.mark.parametrize("seed", [1, 2])
def test_links_have_the_components_of_all_close_pairs(spark, seed):
    rng = random.Random(seed)
    values = {0, (1 << 64) - 1}
    for _ in range(40):  # chains of one to four flips around random points, within and across the halves
        at = rng.getrandbits(64)
        values.add(at)
        for _ in range(rng.randrange(8)):
            for bit in rng.sample(range(64), rng.randrange(1, 5)):
                at ^= 1 << bit
            values.add(at)
    base = rng.getrandbits(64)
    values |= {base ^ (1 << i) ^ (1 << j) for i in range(6) for j in range(6)}  # a dense ball
    values = sorted(map(signed, values))
    close = [(a, b) for a in values for b in values if a < b and ((a ^ b) % (1 << 64)).bit_count() <= 3]
    found = [(r.a, r.b) for r in simhash.links(spark.createDataFrame([(v,) for v in values], "fp long")).collect()]
    assert all(((a ^ b) % (1 << 64)).bit_count() <= 3 for a, b in found)
    assert classes(found, values) == classes(close, values)


def test_components_of_chains_loops_and_nulls(spark):
    rng = random.Random(3)
    pairs = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(30)] + [(7, 7), (300, 299), (299, 300)]
    rng.shuffle(pairs)
    frame = spark.createDataFrame([*pairs, (None, 4), (5, None)], "a long, b long")
    got = {r.node: r.label for r in components.connected(frame).collect()}
    assert got == classes(pairs, {x for p in pairs for x in p})


def test_near_duplicates_nulls_ties_and_clashing_columns(spark):
    base = " ".join(f"w{i}" for i in range(300))
    rows = [(5, base, "x"), (3, base, "y"), (9, base.upper(), "z"), (7, "other words here", None), (2, None, "n"),
            (8, "", "e"), (None, base, "q"), (5, base, "x"), (None, "alone without id", "r")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string").withColumn("key", F.lit(1))
    got = sorted(simhash.near_duplicates(docs).select("doc_id", "component_id").collect(), key=str)
    want = [(5, 3), (3, 3), (9, 3), (7, 7), (2, 2), (8, 2), (None, 3), (5, 3), (None, None)]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [2, 3, 7, None, None]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
