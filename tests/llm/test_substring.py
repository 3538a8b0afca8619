import random

import pytest

from marketloom.llm import substring


def by_definition(rows, size):
    owner, cut = {}, []
    for i, text in rows:
        w = (text or "").split()
        for s in range(len(w) - size + 1 if i is not None else 0):
            key = tuple(w[s: s + size])
            owner[key] = min(owner.get(key, i), i)
    for i, text in rows:
        w, gone = (text or "").split(), set()
        for s in range(len(w) - size + 1 if i is not None else 0):
            if owner[tuple(w[s: s + size])] < i:
                gone |= set(range(s, s + size))
        cut.append((str(i), " ".join(x for p, x in enumerate(w) if p not in gone), len(w), len(gone)))
    return sorted(cut)


@pytest.mark.parametrize("seed,size,gram", [(0, 50, 10), (1, 12, 5), (2, 8, 8), (3, 6, 1)])
def test_against_definition(spark, seed, size, gram):
    rng = random.Random(seed)

    def some(n, alphabet=5000):
        return [f"é{rng.randrange(alphabet)}" for _ in range(n)]

    passages = [some(size + rng.randrange(-2, size)) for _ in range(6)] + [["x"] * (2 * size), ["p", "q"] * size]
    rows = [(None, " ".join(passages[0])), (4, None), (5, ""), (6, "short"), (6, " ".join(passages[0]))]
    for i in range(60):
        words = some(rng.randrange(30))
        for _ in range(rng.randrange(3)):
            p = rng.choice(passages)
            a = rng.randrange(4)
            words += p[a:] + some(rng.randrange(5))
        rows.append((rng.randrange(200), "  ".join(words)))
    rows += rng.choices(rows, k=12)  # repeated rows
    rows += [(300 + i, t) for i, (_, t) in enumerate(rng.choices(rows, k=12))]  # copies under new ids
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, start string")
    got = substring.cut_repeats(docs, window=size, gram=gram).collect()
    assert sorted((str(r.id), r.kept, r.n_words, r.n_removed) for r in got) == by_definition(rows, size)
    assert all(b["end"] - b["start"] >= size for r in got for b in r.runs)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert substring.cut_repeats(docs).count() == 0
