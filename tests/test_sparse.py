"""Products of sparse vectors against brute force, with sizes that force every split."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketloom.operators import sparse as sp
from marketloom.plans import similarity as sm


def brute(rows):
    """Cosine of all pairs with a common group; a null group counts for the length only."""
    length, vectors = {}, {}
    for i, g, v in rows:
        length[i] = length.get(i, 0.0) + v * v
        if g is not None:
            vectors.setdefault(i, {}).setdefault(g, []).append(v)
    out = {}
    for i, a in vectors.items():
        for j, b in vectors.items():
            if i != j and a.keys() & b.keys():
                out[i, j] = sum(sum(a[g]) * sum(b[g]) for g in a.keys() & b.keys()) / np.sqrt(length[i] * length[j])
    return out


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(4)
    out = [(int(i) + 2**40, int(g), float(v)) for i, g, v in zip(rng.integers(0, 40, 400), rng.integers(0, 30, 400), rng.integers(1, 6, 400))]
    out += [(2**40 + 7, g, 1.5) for g in range(60)] + [(2**40 + u, 3, 2.0) for u in range(40)]  # a long vector, a large group
    return [*out, (2**40 + 1, None, 4.0)]  # rows may repeat


SIZES = [dict(), dict(members=3, block=60, part=100, products=7, pack=16), dict(members=50, block=10**6, part=50, products=300, pack=11)]


@pytest.mark.parametrize("sizes", SIZES)
def test_cosines_against_brute_force(spark, rows, sizes):
    ratings = spark.createDataFrame(rows, "u long, g long, rating double").repartition(5)
    want = brute(rows)
    found = sp.sparse_cosines(ratings, "u", "g", above=0.3, **sizes).collect()
    got = {(r.i, r.j): r.sim for r in found}
    assert len(got) == len(found) and got == pytest.approx({p: s for p, s in want.items() if p[0] < p[1] and s > 0.3})
    best = sp.sparse_cosines(ratings, "u", "g", k=4, **sizes).collect()
    mine = {}
    for r in best:
        mine.setdefault(r.i, []).append((-round(r.sim, 8), r.j))
        assert r.sim == pytest.approx(want[r.i, r.j])
    theirs = {}
    for (i, j), s in want.items():
        theirs.setdefault(i, []).append((-round(s, 8), j))
    assert {i: sorted(x)[:4] for i, x in mine.items()} == {i: sorted(x)[:4] for i, x in theirs.items()}


def test_members_without_names_and_groups_with_any(spark):
    rows = [(1, "a", 1.0), (2, "a", 2.0), (2, "b", None), (None, "a", 3.0), (3, "b", 1.0), (3, "a", 1.0)]
    ratings = spark.createDataFrame(rows, "u int, g string, rating double")
    got = {(r.i, r.j): r.sim for r in sp.sparse_cosines(ratings, "u", "g", above=-2.0).collect()}
    assert got == pytest.approx({(1, 2): 1.0, (1, 3): 2**-0.5, (2, 3): 2**-0.5})
    more = ratings.union(spark.createDataFrame([(4, "b", 2.0)], ratings.schema))
    for entries in (8_000_000, 1):
        near = {(r.i, r["rank"]): (r.j, r.sim) for r in sm.cosine_neighbours(more, "u", "g", 3, 2, entries).collect()}
        assert [near[2, n][0] for n in (1, 2, 3)] == [1, 3, 4] and near[2, 3][1] is None
        assert near[4, 1] == (3, pytest.approx(2**-0.5)) and near[4, 2] == (2, None) and (4, 3) not in near
    with pytest.raises(Exception, match="no direction"):
        sp.sparse_cosines(ratings.fillna(0.0).union(spark.createDataFrame([(9, "a", 0.0)], ratings.schema)), "u", "g", k=1).collect()


def test_a_rating_travels_once_for_each_block_and_part(spark, monkeypatch):
    """Not once for each member of its group."""
    sent = []
    frame = type(spark.range(1))
    real = frame.repartitionById
    monkeypatch.setattr(frame, "repartitionById", lambda df, *a: sent.append((df, a[0])) or real(df, *a))
    ratings = spark.range(60_000).select((F.col("id") % 600).alias("user_id"), (F.col("id") % 601).alias("item_id"), (F.col("id") % 5 + 1.0).alias("rating"))
    found = sm.cosine_neighbours(ratings, "user_id", "item_id", 5)
    assert found.count() == 600 * 5
    (df, cells), = sent
    packs = df.agg(F.sum(F.length("x"))).first()[0]
    assert cells >= 24 and packs < 16 * 60_000 * 11 / 2  # 16 bytes a rating in each of at most 11 copies would be twice as many


def test_packs_are_read_back(rows):
    rng = np.random.default_rng(1)
    counts = np.array([3, 0, 5, 1])
    pack = sp.Pack(np.array([-5, 2, 9, 2**60]), counts, rng.random(4), rng.integers(-9, 2**50, 9), rng.normal(size=9))
    again = sp.Pack.decoded(pack.encoded())
    for name in ("ids", "counts", "squares", "groups", "values"):
        assert np.array_equal(getattr(again, name), getattr(pack, name))


@pytest.mark.parametrize("digits", [0, 9])
def test_block_with_few_and_with_many_values(digits):
    rng = np.random.default_rng(2)
    m = np.round(rng.normal(size=(90, 80)) * 3, digits) * (rng.random((90, 80)) < 0.9)

    def pack(x, first):
        member, group = np.nonzero(x)
        return sp.Pack(np.arange(first, first + len(x)), np.bincount(member, minlength=len(x)), (x**2).sum(1), group, x[member, group])

    block = sp.Block([pack(m[:50], 0).encoded(), pack(m[50:], 50).encoded()])
    assert (block.named is None) == (digits == 9)
    got = np.zeros((90, 90))
    for member, other, sim in sp.cosines(block, iter([(False, pack(m, 0).encoded())]), 500):
        got[member, other] += sim
    unit = m / np.sqrt((m**2).sum(1))[:, None]
    assert np.allclose(got, unit @ unit.T - np.eye(90))


def test_ratings_of_a_member_lie_together(spark):
    from marketloom import fixtures as fx

    for by in ("user_id", "item_id"):
        lying = fx.ratings_large(spark, "/root/testdata/sf0.001", by).withColumn("task", F.spark_partition_id())
        assert lying.groupBy(by).agg(F.countDistinct("task").alias("t")).agg(F.max("t")).first()[0] == 1
        plain = fx.ratings_large(spark, "/root/testdata/sf0.001")
        assert lying.drop("task").exceptAll(plain).count() == plain.exceptAll(lying.drop("task")).count() == 0
        near = sm.cosine_neighbours(lying.drop("task"), by, "item_id" if by == "user_id" else "user_id", 3, dealt=True)
        again = sm.cosine_neighbours(plain, by, "item_id" if by == "user_id" else "user_id", 3)
        assert sorted((r.i, r.j, r["rank"]) for r in near.collect()) == sorted((r.i, r.j, r["rank"]) for r in again.collect())


def test_neighbour_queries_do_not_store_their_ratings(spark, monkeypatch):
    from marketloom.registry import recs

    def refused(_):
        raise AssertionError("ratings are stored")

    monkeypatch.setattr(recs, "materialise", refused)
    for query in (recs.item_neighbours_large, recs.user_neighbours_large):
        plan = query(spark, "/root/testdata/sf0.001")
        assert plan.columns == ["i", "j", "sim", "rank"]


def test_pairs_below_the_bound_are_not_shuffled(spark, rows, monkeypatch):
    whole = [(i, g, v) for i, g, v in rows if g is not None]
    named = spark.createDataFrame([(f"m{i}", g, v) for i, g, v in whole], "user_id string, g long, rating double")
    want = {p: s for p, s in brute([(f"m{i}", g, v) for i, g, v in whole]).items() if p[0] < p[1] and s > 0.4}
    assert {(r.i, r.j): r.sim for r in sm.cosines_above(named, "user_id", "g", 0.4).collect()} == pytest.approx(want)

    def refused(*_, **__):
        raise AssertionError("makes a row for every pair")

    monkeypatch.setattr(sm, "cosine_pairs", refused)
    found = sm.cosines_above(spark.createDataFrame(whole, "user_id long, g long, rating double"), "user_id", "g", 0.4)
    assert {(f"m{r.i}", f"m{r.j}"): r.sim for r in found.collect()} == pytest.approx(want)


def test_sim_store_makes_no_row_for_every_pair_of_items_of_a_user(spark, monkeypatch):
    from marketloom.registry import io

    sizes, pairs = [], sm.cosine_pairs
    monkeypatch.setattr(sm, "cosine_pairs", lambda rated, *a, **k: sizes.append(rated.count()) or pairs(rated, *a, **k))
    io.sim_store(spark, "/root/testdata/sf0.001")
    assert len(sizes) == 1  # of the events only, not of the orders
