import random
import re
from collections import Counter

import numpy as np
import pytest

from marketloom.llm import phrases
from marketloom.llm.automata import CountAutomaton, sorted_sums


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def by_definition(rows, least=30, longest=4, top=2000, cover=80):
    out = []
    for lang in {r[0] or "und" for r in rows}:
        f, n = Counter(), 0
        for own, text in rows:
            if (own or "und") == lang:
                for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", lower(text)):
                    words = re.findall(r"[^ \t]+", piece)
                    n += len(words)
                    f.update(tuple(words[i: i + s]) for s in range(1, longest + 1) for i in range(len(words) - s + 1))
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        covered = Counter()
        for p, a in found.items():
            for s in range(2, len(p)):
                for i in range(len(p) - s + 1):
                    covered[p[i: i + s]] = max(covered[p[i: i + s]], a)
        best = []
        for p, a in found.items():
            if 100 * covered[p] >= cover * a:
                continue
            score, _, l, r = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            best.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, i, p.decode(), -a, l, r, n, -s) for i, (s, a, p, l, r) in enumerate(sorted(best)[:top], 1)]
    return sorted(out)


def mined(spark, rows, **options):
    frame = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    return sorted(map(tuple, phrases.collocations(frame, **options).collect()))


@pytest.mark.parametrize("seed", [1, 2])
def test_against_plain_counts(spark, monkeypatch, seed):
    monkeypatch.setattr(phrases, "SHARD_WORDS", 700)  # many shards and ranges
    monkeypatch.setattr(phrases, "RANGE_BYTES", 5000)
    rng = random.Random(seed)
    fixed = [[f"p{n}{i}" for i in range(rng.randrange(2, 6))] for n in range(8)]
    rows = []
    for _ in range(120):
        words = []
        for _ in range(rng.randrange(40)):
            words += rng.choice(fixed) if rng.random() < 0.3 else [f"W{int(rng.paretovariate(0.6)) % 300}"]
            if rng.random() < 0.1:
                words.append(rng.choice([".", "a,b", "\n", "x\ty", "é!É", "\x85", " ", "\r\n", "\x0b;", "\x1c"]))
        rows.append((rng.choice(["en", "de", None]), " ".join(words)))
    want = by_definition(rows, least=5, top=25)
    assert len(want) == 75 and mined(spark, rows, min_count=5, top=25) == want


def test_nulls_ties_repeats_overlaps_long_and_clashing_columns(spark):
    rows = [("en", "a a a a a"), ("en", None), (None, "b c b c, b c"), ("und", "b c"), ("en", ""), ("fr", " . ,"), ("en", "q r. q r")]
    rows += [("en", "tie one"), ("en", "tie two"), ("en", "Tie Two tie one")] * 3 + [("xx", "long text " * 30000)]
    assert mined(spark, rows, min_count=2) == by_definition(rows, least=2)
    assert mined(spark, rows, min_count=2, longest=2, top=3) == by_definition(rows, least=2, longest=2, top=3)
    frame = spark.createDataFrame([("en", "a b a b", "z", 1)], "lang string, text string, phrase string, n int")
    assert [tuple(r) for r in phrases.collocations(frame, min_count=2).collect()] == [("en", 1, "a b", 2, 2, 2, 4, 1_000_000)]
    assert phrases.collocations(frame.limit(0)).count() == 0
    assert phrases.collocations(frame).count() == 0  # nothing is frequent


@pytest.mark.parametrize("seed", range(6))
def test_automata_round_trip_union_and_composition(seed):
    rng = np.random.default_rng(seed)
    counts = {}
    shards = []
    for _ in range(3):
        own = Counter()
        for _ in range(rng.integers(0, 200)):
            own[tuple(rng.integers(1, 6, rng.integers(1, 5)).tolist())] += int(rng.integers(1, 3))
        rows = np.array([p + (0,) * (4 - len(p)) for p in own], np.uint64).reshape(-1, 4)
        rows, weights = sorted_sums(rows, np.array(list(own.values()), np.int64))
        one = CountAutomaton.unpacked(CountAutomaton.build(rows, weights).packed())
        again, sums = one.rows()
        assert (again == rows).all() and (sums == weights).all()
        shards.append(one)
        counts = Counter(counts) + own
    rows, weights = CountAutomaton.union(shards, 4)
    assert {tuple(x for x in r if x): w for r, w in zip(rows.tolist(), weights.tolist())} == dict(counts)
    whole = CountAutomaton.build(rows, weights)
    asked = rng.integers(1, 7, (300, 4)).astype(np.uint64) * (np.arange(4) < rng.integers(1, 5, 300)[:, None])
    assert not CountAutomaton.build(rows[:, :1][:1], weights[:1]).weights_of(asked[asked[:, 1] != 0]).any()  # longer ones
    assert whole.weights_of(asked).tolist() == [counts.get(tuple(x for x in r if x), 0) for r in asked.tolist()]


def test_equal_states_are_shared():
    rows = np.array([[a, b, c, d] for a in (1, 2, 3) for b in (4, 5) for c in (6, 7) for d in (8, 9)], np.uint64)
    one = CountAutomaton.build(rows, np.ones(len(rows), np.int64))
    assert [len(level[1]) for level in one.levels] == [3, 2, 2, 2]
