import random
from collections import Counter

import numpy as np
import pytest

from marketloom.llm import linededup


def by_definition(texts, min_docs, shortest):
    def keys(text):
        return [x.strip(" \t\n\r\x0b\x0c") for x in (text or "").split("\n")]

    def lower(s):
        return "".join(c.lower() if c.isascii() else c for c in s)

    seen = Counter(k for t in texts for k in {lower(k) for k in keys(t)} if len(k) >= shortest)
    out = []
    for t in texts:
        lines = (t or "").split("\n")
        kept = [x for x, k in zip(lines, keys(t)) if len(k) < shortest or seen[lower(k)] < min_docs]
        out.append(("\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


@pytest.mark.parametrize("n", [0, 1, 2, 5000])
def test_perfect_hash_is_minimal_and_survives_packing(n):
    rng = np.random.default_rng(n)
    h1, h2 = rng.integers(-2**63, 2**63 - 1, (2, n))
    h1[: n // 2] = h1[0] if n else 0  # equal first halves must part by the second
    built = linededup.PerfectHash.build(h1, h2)
    read = linededup.PerfectHash(built.sizes, built.packed())
    assert sorted(read.slots(h1, h2)) == list(range(n))


@pytest.mark.parametrize("part,shard_bytes,shortest", [(65_536, 32 << 20, 1), (20, 300, 1), (8, 200, 3), (9, 400, 0)])
def test_against_definition(spark, monkeypatch, part, shard_bytes, shortest):
    monkeypatch.setattr(linededup, "HOT_PART", part)
    monkeypatch.setattr(linededup, "SHARD_BYTES", shard_bytes)
    rng = random.Random(part)
    lines = [f"line {i} É" for i in range(25)] + ["", "  ", "\tLINE 3 É \x0b", "ab", "é", " x"]
    texts = ["\n".join(rng.choices(lines, k=rng.randrange(1, 9))) for _ in range(80)] + [None, "", "\n\n", "line 1 É"]
    texts += ["hot\nown"] * 30
    rows = [(i if i % 7 else None, t, i) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, hashes long")
    joined, cut = linededup.cut_lines(docs, min_docs=10, shortest=shortest)
    got = {r.hashes: (r.c.kept, r.c.n_lines, r.c.n_dropped) for r in joined.withColumn("c", cut).collect()}
    want = by_definition(texts, 10, shortest)
    assert [got[i] for i in range(len(texts))] == want
    kept = linededup.drop_frequent_lines(docs, shortest=shortest)
    assert kept.columns == docs.columns
    assert {r.hashes: r.text for r in kept.collect()} == {
        i: None if t is None else want[i][0] for i, t in enumerate(texts)}
    assert linededup.drop_frequent_lines(docs.limit(0)).count() == 0


def test_index_rejects_lines_it_does_not_know(spark):
    docs = spark.createDataFrame([(i, f"shared\nown {i}") for i in range(12)], "doc_id long, text string")
    other = spark.createDataFrame([(1, "unknown\nshared"), (2, "own 3\nmore")], "doc_id long, text string")
    index = linededup.LineIndex.build(docs)
    index.hot = frozenset()
    assert [len(r.hashes) for r in index.probe(other).collect()] == [1]


def test_rows_that_share_an_id_are_one_document(spark):
    rows = [(i, f"five\nown {i}") for i in range(5)] * 2 + [(i, f"ten\nown {i}") for i in range(20, 30)] + [(None, "none")] * 10
    rows += [(50, "same id")] * 40 + [(51, "mixed"), (51, "mixed\nx"), *[(60 + i, "mixed") for i in range(8)]]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, linededup.drop_frequent_lines(docs).collect()), key=str)
    gone = {"ten", "none"}
    assert got == sorted(((i, "\n".join(x for x in t.split("\n") if x not in gone)) for i, t in rows), key=str)
