import random
import re

import numpy as np
import pytest

from marketloom.llm import decontaminate as dec
from marketloom.llm import wordhash


def words(text):
    low = "".join(c.lower() if c.isascii() else c for c in text or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)


def by_definition(text, items):
    doc, hit, named = words(text), set(), set()
    for ids, item in items:
        w = words(item)
        size = min(13, len(w))
        grams = {tuple(w[i: i + size]) for i in range(len(w) - size + 1)} if size else set()
        for i in range(len(doc) - size + 1):
            if size and tuple(doc[i: i + size]) in grams:
                hit |= set(range(i, i + size))
                named |= {ids} - {None}
    return len(doc), len(hit), sorted(named)


@pytest.mark.parametrize("k", [1, 2, 5, 16, 17, 50])
def test_rolling_hash_depends_on_the_words_alone(k):
    rng = np.random.default_rng(k)
    words = rng.integers(0, 2**63, 200).astype(np.uint64)
    twice = np.concatenate([words, words[:3], words])
    h = wordhash.rolling(twice, k)
    assert len(h) == len(twice) - k + 1
    assert (h[: 200 - k + 1] == h[203: 403 - k + 1]).all()
    assert len(set(h[: 200 - k + 1].tolist())) == 200 - k + 1
    assert len(wordhash.rolling(words[: k - 1], k)) == 0


@pytest.mark.parametrize("seed", [0, 1])
def test_against_definition(spark, seed):
    rng = random.Random(seed)

    def some(n, alphabet=40):
        return " ".join(rng.choice(["W%d", "é%d", "x-%d"]) % rng.randrange(alphabet) for _ in range(n))

    items = [(i, some(n)) for i, n in enumerate([30, 13, 14, 12, 7, 5, 3, 1, 20])]
    items += [(50, None), (51, ""), (None, some(25)), (52, items[0][1]), (53, "a " * 16), (54, "only, ONE; word")]
    texts = [None, "", "!!", "a " * 40, "b " + "a " * 12, "only one word", items[7][1]]
    for _ in range(60):
        parts = [some(rng.randrange(25), 400)]
        for _ in range(rng.randrange(3)):
            of = (rng.choice(items)[1] or "").split()
            a = rng.randrange(len(of) + 1)
            parts += [" ".join(of[a: a + rng.randrange(10, 25)]).upper(), some(rng.randrange(4), 400)]
        texts.append(" ; ".join(parts))
    texts += texts[:20]
    docs = spark.createDataFrame(
        [(None if i % 9 == 0 else i % 50, t, i) for i, t in enumerate(texts)], "doc_id long, text string, key long")
    bench = spark.createDataFrame(items, "item_id long, text string")
    joined, found = dec.overlaps(docs, bench)
    got = {r.key: (r.f.n_words, r.f.n_hit, r.f["items"]) for r in joined.withColumn("f", found).collect()}
    want = [by_definition(t, items) for t in texts]
    assert [got[i] for i in range(len(texts))] == want
    kept = dec.decontaminate(docs, bench)
    assert kept.columns == docs.columns
    assert sorted(r.key for r in kept.collect()) == [
        i for i, (n, hit, _) in enumerate(want) if not (hit and 20 * hit >= n)]
    assert dec.decontaminate(docs.limit(0), bench).count() == 0
    assert dec.decontaminate(docs, bench.limit(0)).count() == len(texts)


def test_a_phrase_shared_by_most_items_and_a_third_of_the_documents(spark):
    """Every place of the phrase is one row, whatever the number of items that hold it; spans are maximal."""
    phrase = " ".join(f"p{n}" for n in range(16))
    items = [(n, f"{phrase} own {n}" if n % 5 else f"only {n} " * 9) for n in range(300)] + [(n, phrase) for n in range(300, 600)]
    texts = [f"lead {n} {phrase} tail {phrase}" if n % 3 == 0 else f"clean text {n} with p1 p2 p3 p4 p5 p6" for n in range(300)]
    texts += [" ".join(f"long{n}" for n in range(30000)) + " " + phrase]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    joined, found = dec.overlaps(docs, spark.createDataFrame(items, "item_id long, text string"))
    got = {r.doc_id: r.f for r in joined.withColumn("f", found).collect()}
    holders = [n for n, t in items if phrase in t]
    assert {i: f["items"] for i, f in got.items()} == {i: holders if phrase in t else [] for i, t in enumerate(texts)}
    assert [(s.start, s.end) for s in got[0].spans] == [(2, 18), (19, 35)] and got[0].n_hit == 32
    assert got[300].n_words == 30016 and got[300].n_hit == 16 and got[1].n_hit == 0
