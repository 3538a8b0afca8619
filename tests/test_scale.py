"""Building blocks against brute force, with thresholds small enough to force every split path."""

import hashlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from marketloom import fixtures as fx
from marketloom.operators import aggregates as ag
from marketloom.operators import nearest
from marketloom.operators import scale as sc
from marketloom.operators import series as se
from marketloom.operators.grid import VectorTable, pair_grid, unit_rows
from marketloom.plans import evaluation as ev
from marketloom.plans import latent as la
from marketloom.plans import recommend as rc
from marketloom.plans import sampling as sa
from marketloom.plans import similarity as sm


def skewed_ratings(seed=7, users=30, items=25, n=260):
    """User 0 and item 0 hold about a third of all rows each."""
    rng = np.random.default_rng(seed)
    u = np.where(rng.random(n) < 0.33, 0, rng.integers(0, users, n))
    i = np.where(rng.random(n) < 0.33, 0, rng.integers(0, items, n))
    pdf = pd.DataFrame({"user_id": u, "item_id": i, "rating": rng.integers(1, 6, n).astype(float)})
    return pdf.groupby(["user_id", "item_id"], as_index=False).rating.max()


def matrix(pdf):
    return pdf.pivot(index="user_id", columns="item_id", values="rating").fillna(0.0)


def cosine(m):
    norm = np.sqrt((m**2).sum(axis=1, keepdims=True))
    unit = np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)
    return unit @ unit.T


def test_quantiles_match_interpolation(spark):
    rng = np.random.default_rng(1)
    values = np.concatenate([rng.normal(size=400), np.full(300, 0.5), [np.nan, np.inf]])
    pdf = pd.DataFrame({"k": np.arange(len(values)) % 3, "v": values})
    df = spark.createDataFrame(pdf).repartition(7)
    probs = [0.0, 0.01, 0.25, 0.5, 0.95, 1.0]
    clean = pdf[np.isfinite(pdf.v)]
    for accuracy in (20, 10_000):
        got = {r["prob"]: r["value"] for r in sc.quantiles(df, ["v"], probs, accuracy=accuracy).collect()}
        assert got == pytest.approx({p: np.quantile(clean.v, p) for p in probs})
        keyed = sc.quantiles(df, ["v"], [0.5], keys=["k"], accuracy=accuracy).collect()
        assert {r["k"]: r["value"] for r in keyed} == pytest.approx(clean.groupby("k").v.median().to_dict())


def test_quantiles_of_tiny_inputs(spark):
    for values in ([3.0], [1.0, 2.0], [5.0, 1.0, 3.0, 2.0]):
        df = spark.createDataFrame([(v,) for v in values], "v double")
        got = {r["prob"]: r["value"] for r in sc.quantiles(df, ["v"], [0.25, 0.5, 0.75, 0.95]).collect()}
        assert got == pytest.approx({p: np.quantile(values, p) for p in (0.25, 0.5, 0.75, 0.95)})


def test_positions_and_halo(spark):
    pdf = pd.DataFrame({"k": ["hot"] * 50 + ["a"] * 5 + [None] * 4})
    pdf["t"] = np.random.default_rng(0).permutation(len(pdf))
    df = spark.createDataFrame(pdf, "k string, t long")
    got = sc.with_position(df, ["k"], [F.col("t")], F.floor(F.col("t") / 7)).toPandas()
    want = pdf.assign(pos=pdf.groupby("k", dropna=False).t.rank().astype(int) - 1)
    assert sorted(map(tuple, got[["t", "pos"]].values)) == sorted(map(tuple, want[["t", "pos"]].values))
    blocks = sc.with_halo(spark.createDataFrame(got.dropna(), "k string, t long, pos long"), 8, before=3, after=2)
    f = se.Frames(["k"])
    total = sc.drop_halo(blocks.withColumn("s", F.sum("t").over(f.base.rowsBetween(-3, 2)))).toPandas()
    for _, g in total.groupby("k"):
        g = g.sort_values("pos")
        want = [g.t.iloc[max(0, i - 3): i + 3].sum() for i in range(len(g))]
        assert g.s.tolist() == want


def test_salted_join_equals_join(spark):
    left = spark.createDataFrame([(1, i) for i in range(40)] + [(2, 99), (None, 100), (None, 101)], "k int, v int")
    right = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (3, "d")], "k int, w string")
    for how in ("inner", "left"):
        got = sorted(map(str, sc.salted_join(left, right, ["k"], rows_per_salt=6, how=how).collect()))
        assert got == sorted(map(str, left.join(right, "k", how).collect()))


@pytest.mark.parametrize("cell", [3, 512])
def test_co_occurrence_with_hot_groups(spark, cell):
    pdf = skewed_ratings()
    rows = spark.createDataFrame(pdf)
    sums = {"dot": F.sum(F.col("l_rating") * F.col("r_rating")), "left": F.sum("l_rating"), "n": F.count(F.lit(1))}
    got = {(r.i, r.j): (r.dot, r.left, r.n) for r in
           sc.co_occurrence(rows, "user_id", "item_id", ["rating"], sums, cell=cell).collect()}
    m = matrix(pdf)
    a, b = m.values, (m.values > 0).astype(float)
    dot, left, n = a.T @ a, a.T @ b, b.T @ b
    ids = list(m.columns)
    want = {(ids[x], ids[y]): (dot[x, y], left[x, y], n[x, y])
            for x in range(len(ids)) for y in range(x + 1, len(ids)) if n[x, y]}
    assert got.keys() == want.keys()
    for key, value in want.items():
        assert got[key] == pytest.approx(tuple(map(float, value)))


def test_average_ranks_and_codes(spark):
    values = [5, 5, 5, 1, 9, 9, 2, None]
    df = spark.createDataFrame([(v,) for v in values], "v int")
    ranks = {r["v"]: r["rank"] for r in sc.average_ranks(df, "v").collect()}
    assert ranks == pd.Series(values).dropna().pipe(lambda s: dict(zip(s.astype(int), s.rank())))
    assert {r["v"]: r["_code"] for r in sc.dense_codes(df, "v").collect()} == {1: 0, 2: 1, 5: 2, 9: 3}


def test_neighbour_values_cross_blocks(spark):
    v = [None, None, 3.0, None, None, None, None, 8.0, None, None]
    df = spark.createDataFrame([("a", i, x) for i, x in enumerate(v)], "k string, pos long, v double")
    got = sc.neighbour_values(df, ["k"], ["v"], block=2).orderBy("pos").collect()
    s = pd.Series(v)
    unwrap = lambda name: [None if r[name] is None else r[name]["v"] for r in got]
    assert unwrap("prev_v") == [None if pd.isna(x) else x for x in s.ffill()]
    assert unwrap("next_v") == [None if pd.isna(x) else x for x in s.bfill()]


def test_pair_grid_small_blocks(spark):
    rng = np.random.default_rng(3)
    x = np.round(rng.random((17, 3)), 1)
    pdf = pd.DataFrame(x, columns=["a", "b", "c"]).assign(id=np.arange(17), tag=[f"t{i % 3}" for i in range(17)])
    table = VectorTable(unit_rows(spark.createDataFrame(pdf), ["a", "b", "c"]), "id", ["a", "b", "c"], ["tag"], 0.75, 0.25)
    sim = 0.75 * cosine(x) + 0.25 * (pdf.tag.values[:, None] == pdf.tag.values[None, :])
    extra = spark.createDataFrame([(0, 16, 0.5), (3, 4, 0.25)], "i long, j long, value double")
    for i, j, v in [(0, 16, 0.5), (3, 4, 0.25)]:
        sim[i, j] += v
        sim[j, i] += v
    got = {}
    for r in pair_grid(table, k=4, extra=extra, block=4).collect():
        got.setdefault(r.i, {})[r["rank"]] = (r.j, round(r.sim, 6))
    for i in range(17):
        best = sorted(((-round(sim[i, j], 8), j) for j in range(17) if j != i))[:4]
        assert [got[i][k + 1] for k in range(4)] == [(j, round(-s, 6)) for s, j in best]
    low = {(r.i, r.j) for r in pair_grid(table, low=0.2, high=0.6, extra=extra, block=4).collect()}
    assert low == {(i, j) for i in range(17) for j in range(i + 1, 17) if 0.2 < sim[i, j] <= 0.6}


@pytest.mark.parametrize("match", [0, 2])
def test_nearest_over_many_cells_with_copies_and_zero_rows(spark, match, monkeypatch):
    rng = np.random.default_rng(5)
    x = np.round(rng.random((300, 3)), 1)
    x[:40] = x[0]  # copies
    x[40:44] = 0.0
    tags = rng.integers(0, 3, (300, 2))
    tags[:30] = 1
    pdf = pd.DataFrame(x, columns=["a", "b", "c"]).assign(id=rng.permutation(300), s=[f"s{t}" for t in tags[:, 0]], t=[
        None if t == 2 else f"t{t}" for t in tags[:, 1]])
    names = ["s", "t"][:match]
    table = VectorTable(unit_rows(spark.createDataFrame(pdf), ["a", "b", "c"]), "id", ["a", "b", "c"], names, 0.75, 0.25 if match else 0.0)
    sim = 0.75 * cosine(x)
    for n in names:
        v = pdf[n].to_numpy(dtype=object)
        sim += 0.125 * ((v[:, None] == v[None, :]) & np.array([t is not None for t in v])[:, None])
    monkeypatch.setattr(nearest, "VISITORS", 7)
    monkeypatch.setattr(nearest, "TILE", 64)
    ids, got = pdf.id.to_numpy(), {}
    for r in nearest.nearest(table, 4, cell_rows=16, own_tree=20).collect():
        got.setdefault(r.i, {})[r["rank"]] = (r.j, round(r.sim, 6))
    for i in range(300):
        best = sorted(((-round(sim[i, j], 8), ids[j]) for j in range(300) if j != i))[:4]
        assert [got[ids[i]][n + 1] for n in range(4)] == [(j, pytest.approx(-s, abs=2e-6)) for s, j in best]


def brute_item_scores(m, sim, threshold):
    out = {}
    for u in m.index:
        r = m.loc[u].values
        for c, item in enumerate(m.columns):
            if r[c] == 0:
                w = np.where((r > 0) & (sim[c] > threshold), sim[c], 0)
                if w.sum() > 0:
                    out[(u, item)] = (w * r).sum() / w.sum()
    return out


@pytest.mark.parametrize("threshold", [0.001, 0.25])
def test_item_and_user_cf_against_brute_force(spark, threshold):
    pdf = skewed_ratings()
    ratings, m = spark.createDataFrame(pdf), matrix(pdf)
    got = {(r.user_id, r.item_id): r.score for r in
           rc.item_cf_scores(ratings, sm.item_cosine(ratings), threshold).collect()}
    assert got == pytest.approx(brute_item_scores(m, cosine(m.values.T), threshold))
    sim, want = cosine(m.values), {}
    for a, u in enumerate(m.index):
        for c, item in enumerate(m.columns):
            if m.values[a, c] == 0:
                w = np.where((m.values[:, c] > 0) & (sim[a] > threshold), sim[a], 0)
                if w.sum() > 0:
                    want[(u, item)] = (w * m.values[:, c]).sum() / w.sum()
    scores = {(r.user_id, r.item_id): r.score for r in rc.user_cf_scores(ratings, threshold).collect()}
    assert scores == pytest.approx(want)


@pytest.mark.parametrize("threshold", [0.001, 0.3])
def test_blended_cf_against_brute_force(spark, threshold):
    pdf = skewed_ratings()
    ratings, m = spark.createDataFrame(pdf), matrix(pdf)
    rng = np.random.default_rng(5)
    x = np.where(rng.random((25, 4)) < 0.5, 0.0, rng.random((25, 4)))
    tags = np.array([f"t{i % 4}" for i in range(25)])
    items = pd.DataFrame(x, columns=list("abcd")).assign(id=np.arange(25), tag=tags)
    table = VectorTable(unit_rows(spark.createDataFrame(items), list("abcd")), "id", list("abcd"), ["tag"], 0.75, 0.25)
    ids = np.array(m.columns)
    feature = 0.75 * cosine(x)[np.ix_(ids, ids)] + 0.25 * (tags[ids][:, None] == tags[ids][None, :])
    sim = 0.7 * cosine(m.values.T) + 0.3 * feature
    want = brute_item_scores(m, sim, threshold)
    got = rc.blended_cf(ratings, sm.item_cosine(ratings), table, 0.7, 100, threshold)
    assert {(r.user_id, r.item_id): r.score for r in got.collect()} == pytest.approx(want)
    one = spark.createDataFrame([(0,)], "user_id long")
    only = rc.blended_cf(ratings, sm.item_cosine(ratings), table, 0.7, 100, threshold, only=one)
    assert {(r.user_id, r.item_id): r.score for r in only.collect()} == pytest.approx(
        {k: v for k, v in want.items() if k[0] == 0})


def test_factor_grid(spark):
    rng = np.random.default_rng(2)
    u, v = rng.normal(size=(9, 3)), rng.normal(size=(11, 3))
    frame = lambda x: spark.createDataFrame([(i, [float(y) for y in r]) for i, r in enumerate(x)], "id int, features array<float>")
    seen = spark.createDataFrame([(a, b) for a in range(9) for b in range(11) if (a + b) % 3 == 0], "user_id long, item_id long")
    got = la.factor_topn(frame(u), frame(v), seen, 3, user_block=4, item_block=4).collect()
    score = u.astype("float32").astype(float) @ v.astype("float32").astype(float).T
    for a in range(9):
        best = sorted((-round(score[a, b], 8), b) for b in range(11) if (a + b) % 3)[:3]
        assert [r.item_id for r in sorted(got, key=lambda r: r["rank"]) if r.user_id == a] == [b for _, b in best]


def test_kendall_with_ties(spark):
    rng = np.random.default_rng(4)
    x, y = rng.integers(0, 8, 120), rng.integers(0, 15, 120)
    y[:50] = x[:50]
    df = spark.createDataFrame([(int(a), int(b)) for a, b in zip(x, y)], "x int, y int").repartition(5)
    s = np.sign(x[:, None] - x[None, :]) * np.sign(y[:, None] - y[None, :])
    n0 = len(x) * (len(x) - 1) / 2
    ties = lambda z: sum(c * (c - 1) / 2 for c in np.unique(z, return_counts=True)[1])
    want = (s.sum() / 2) / np.sqrt((n0 - ties(x)) * (n0 - ties(y)))
    assert ag.kendall(df, "x", "y").first()["corr"] == pytest.approx(want)


def test_exponential_mean_over_many_blocks(spark):
    n = 5000
    price = 100 + np.cumsum(np.random.default_rng(6).normal(size=n))
    pdf = pd.DataFrame({"k": "a", "t": pd.date_range("2020-01-01", periods=n, freq="h"), "p": price})
    got = se.ewm_mean(spark.createDataFrame(pdf), ["k"], "t", "p", 26, "e").orderBy("t").toPandas()
    assert np.allclose(got.e, pdf.p.ewm(span=26, adjust=False).mean(), rtol=1e-12)


def test_indicators_over_many_blocks(spark):
    n = 4500
    price = 100 + np.cumsum(np.random.default_rng(8).normal(size=n))
    pdf = pd.DataFrame({"project_id": "a", "timestamp": pd.date_range("2020-01-01", periods=n, freq="h"), "price": price,
                        "volume": 1.0})
    got = se.technical_indicators(spark.createDataFrame(pdf)).orderBy("timestamp").toPandas()
    p = pdf.price
    assert np.allclose(got.sma_200, p.rolling(200).mean().bfill())
    assert np.allclose(got.bb_std, p.rolling(20).std().bfill())
    macd = p.ewm(span=12, adjust=False).mean() - p.ewm(span=26, adjust=False).mean()
    assert np.allclose(got.macd_signal, macd.ewm(span=9, adjust=False).mean(), atol=1e-10)


def test_negative_samples_are_complete(spark):
    pdf = skewed_ratings()
    catalog = spark.createDataFrame([(int(i),) for i in range(25)], "id long")
    got = sa.negative_samples(spark.createDataFrame(pdf), catalog, 4).toPandas()
    positives = pdf.groupby("user_id").item_id.agg(set)
    for user, seen in positives.items():
        mine = got[got.user_id == user].item_id
        assert mine.is_unique and not (set(mine) & seen)
        assert len(mine) == min(4 * len(seen), 25 - len(seen))


@pytest.mark.parametrize("block", [4, 7, 4096])
def test_negative_draws_are_made_behind_the_last_shuffle(spark, monkeypatch, block):
    monkeypatch.setattr(sa, "BLOCK", block, raising=False)
    pdf = skewed_ratings()
    rows = [(int(u), int(i)) for u, i in zip(pdf.user_id, pdf.item_id)]
    ratings = spark.createDataFrame([*rows, *rows[:5], (3, 99), (3, None), (None, 4)], "user_id long, item_id long")
    catalog = spark.createDataFrame([(i,) for i in [*range(25), 7]], "id long")
    sampled = sa.negative_samples(ratings, catalog, 2)
    plan = sampled._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Generate") < plan.index("Exchange")
    got = [(r.user_id, r.item_id) for r in sampled.collect()]
    number = lambda text: hashlib.md5(f"{text}:42".encode()).hexdigest()
    order, want = sorted(range(25), key=number), set()
    every = [*rows, *rows[:5], (3, 99), (3, None)]
    for user in {u for u, _ in every}:
        n, start = sum(u == user for u, _ in every), int(number(user)[:12], 16) % 25
        fresh = [i for i in (order[(start + t) % 25] for t in range(min(3 * n, 25))) if (user, i) not in every]
        want |= {(user, i) for i in fresh[: 2 * n]}
    assert len(got) == len(set(got)) and set(got) == want


def test_weighted_sample_prefers_heavy_items(spark):
    pairs = [(u, i, 100.0 if i < 3 else 1.0) for u in range(200) for i in range(20)]
    df = spark.createDataFrame(pairs, "user_id long, item_id long, weight double")
    got = sa.weighted_sample(df, 3).toPandas()
    assert (got.groupby("user_id").size() == 3).all()
    assert (got.item_id < 3).mean() > 0.85


@pytest.mark.parametrize("partitions", [1, 8, 64])
def test_same_answer_at_any_partition_count(spark, partitions):
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        pdf = skewed_ratings()
        ratings = spark.createDataFrame(pdf).repartition(partitions)
        got = {(r.user_id, r.item_id, r["rank"]): r.score for r in rc.item_cf(ratings, 5).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 8)
    m = matrix(pdf)
    scores = brute_item_scores(m, cosine(m.values.T), 0.001)
    want = {}
    for u in m.index:
        best = sorted((-round(s, 8), i) for (v, i), s in scores.items() if v == u)[:5]
        want.update({(u, i, n + 1): scores[(u, i)] for n, (_, i) in enumerate(best)})
    assert got == pytest.approx(want)


@pytest.mark.parametrize("user_rows, most", [(100_000, 1), (3, 9)])
def test_contributions_of_a_user_meet_in_few_tasks(spark, monkeypatch, user_rows, most):
    monkeypatch.setattr(rc, "USER_ROWS", user_rows)
    ratings = spark.createDataFrame([(u, i, 1.0) for u in range(40) for i in range(25)], "user_id long, item_id long, rating double")
    near = spark.createDataFrame([(i, j, 0.5) for i in range(25) for j in range(25) if i != j], "i long, j long, sim double")
    parts = rc.spread(ratings, near, F.col("sim") * F.col("rating"), F.col("sim")).withColumn("task", F.spark_partition_id())
    tasks = parts.groupBy("user_id").agg(F.countDistinct("task").alias("t"), F.count(F.lit(1)).alias("n"), F.sum("num").alias("s"))
    got = tasks.collect()
    assert len(got) == 40 and {(r.n, r.s) for r in got} == {(600, 300.0)} and max(r.t for r in got) <= most


@pytest.mark.parametrize("cell, entries", [(512, 8_000_000), (4, 50)])
def test_neighbours_without_a_pair_table(spark, monkeypatch, cell, entries):
    ratings = spark.createDataFrame(skewed_ratings())
    want = {(r.i, r["rank"]): (r.j, round(r.sim, 8)) for r in sm.neighbours(sm.item_cosine(ratings), 5).collect()}

    def refused(*_, **__):
        raise AssertionError("makes a row for every pair")

    monkeypatch.setattr(sm, "co_occurrence", refused)
    found = sm.cosine_neighbours(ratings, "item_id", "user_id", 5, cell, entries).collect()
    assert {(r.i, r["rank"]): (r.j, round(r.sim, 8)) for r in found} == want and len(found) == len(want)


def test_pairs_of_members_are_the_same_from_blocks_and_from_joins(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rows = [(2**40 + u, f"i{i}", float(v)) for u in range(40) for i, v in enumerate(rng.integers(-3, 6, 7)) if v > 3 or v % 2 == 0]
    for rated in (rows, [r for r in rows if r[2] > 0]):  # with opposite and zero ratings, and without
        ratings = spark.createDataFrame(rated, "user_id long, item_id string, rating double")
        pairs = lambda: {(r.i, r.j): r.sim for r in sm.cosine_pairs(ratings, "user_id", "item_id").collect()}
        joined = pairs()
        monkeypatch.setattr(sm, "MANY_MEMBERS", 1)
        assert pairs() == pytest.approx(joined)
        unit = sm.with_unit(ratings, "user_id", "u")
        small = sm.shared_pairs(unit, "user_id", "item_id", "u", 40, block=8, tile=20).collect()
        assert {(r.i, r.j): r.sim for r in small} == pytest.approx(joined)
        monkeypatch.undo()


def test_pairs_in_a_range_from_tiles_of_a_cell(spark, monkeypatch):
    monkeypatch.setattr("marketloom.operators.grid.TILE", 20)
    x = np.random.default_rng(6).normal(size=(30, 4))
    rows = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, v array<double>")
    got = {(r.i, r.j): r.sim for r in sm.dense_cosine(rows, "id", "v", 4, 0.3).collect()}
    sim = cosine(x)
    assert got == pytest.approx({(i, j): sim[i, j] for i in range(30) for j in range(i + 1, 30) if sim[i, j] > 0.3})


def test_sums_of_a_user_stay_in_its_task(spark, monkeypatch):
    ratings = spark.createDataFrame(skewed_ratings())
    sim = rc.materialise(sm.item_cosine(ratings))

    def found():
        return [{(r.user_id, r.item_id, r["rank"]): r.score for r in recs.collect()} for recs in (
            rc.item_cf(ratings, 5, sim=sim), rc.user_cf(ratings, 5))]

    plan = rc.item_cf(ratings, 5, sim=sim)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1  # the ratings by user; neither sums nor ranking are shuffled
    together = found()
    monkeypatch.setattr(rc, "USER_ROWS", 3)  # users that are spread over tasks
    assert found() == [pytest.approx(x) for x in together]
    monkeypatch.setattr(rc, "SMALL_NEIGHBOURS", 0)
    assert found() == [pytest.approx(x) for x in together]


@pytest.mark.parametrize("rows_per_task", [50_000, 3])
def test_distinct_counts_move_a_row_once(spark, rows_per_task):
    rows = [(k, n % (k + 2), None if n % 4 == 0 else f"s{n % 5}") for k in range(6) for n in range(2 * k + 1)]
    rows += [(7, None, None), (None, 1, "x"), (5, 1, "s1"), (5, 1, "s1")]
    df = spark.createDataFrame(rows, "k long, a long, b string")
    got = {r.k: (r.n_a, r.n_b) for r in sc.distinct_counts(df, "k", rows_per_task, n_a="a", n_b="b").collect()}
    values = lambda k, c: len({r[c] for r in rows if r[0] == k and r[c] is not None})
    assert got == {k: (values(k, 1), values(k, 2)) for k in (0, 1, 2, 3, 4, 5, 7)}


def test_items_are_counted_without_a_row_for_each_distinct_count(spark):
    plan = fx.items(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    expanded = [part for part in plan.split("Expand [")[1:]]
    assert "REPARTITION_BY_COL" in plan and all("LeftSemi" in part for part in expanded)  # only rows of hot keys are expanded


@pytest.fixture
def no_size_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def planned(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_lists_meet_the_catalog_without_a_shuffle_by_item(spark, no_size_broadcast):
    ratings = spark.createDataFrame(skewed_ratings())
    assert "SortMergeJoin" not in planned(sm.with_unit(ratings, "item_id", "u"))
    ids = [r.item_id for r in ratings.select("item_id").distinct().collect()]
    items = spark.createDataFrame(
        [(i, f"c{i % 3}", float(i % 7), float(i % 5)) for i in ids + [10**6 + n for n in range(5)]],
        "id long, chain string, popularity_score double, trend_score double")
    users = ratings.select("user_id").unionByName(spark.createDataFrame([(-1,)], "user_id long")).distinct()
    recs = rc.item_cf(ratings, 8)
    lists = rc.hybrid(recs, recs, None, items, users, 4)
    kept = rc.by_chain(lists, items, "c1", 2, rc.hybrid_items(ratings, items, 4))
    assert planned(lists).count("SortMergeJoin") == 1  # the users without a list
    assert planned(kept).count("SortMergeJoin") == 1
    rows = lambda df: {(r.user_id, r.item_id, r["rank"]): r.score for r in df.collect()}
    found = rows(kept)
    assert found == rows(rc.by_chain(lists, items, "c1", 2)) and any(u == -1 for u, _, _ in found)


def test_ratings_of_a_user_lie_together(spark, monkeypatch):
    ratings = spark.createDataFrame([(u, i, 1.0) for i in range(9) for u in range(30)], "user_id long, item_id long, rating double")
    tasks = lambda: max(r.t for r in rc.by_user(ratings).withColumn("t", F.spark_partition_id()).groupBy("user_id").agg(
        F.countDistinct("t").alias("t")).collect())
    assert tasks() == 1
    monkeypatch.setattr(rc, "USER_ROWS", 3)
    assert tasks() > 1 and sorted(rc.by_user(ratings).collect()) == sorted(ratings.collect())


def test_only_chosen_users_are_ordered_for_the_split(spark, monkeypatch):
    rows = [(u, i, float(i % 5 + 1)) for u in range(40) for i in range(u % 12 + 1)]
    ratings = spark.createDataFrame(rows, "user_id long, item_id long, rating double")
    md5 = lambda *p: hashlib.md5(":".join(map(str, p)).encode()).hexdigest()
    chosen = {u for u in range(40) if md5(u, 42)[:8] < f"{16**8 // 2:08x}"}
    seen, place = [], ev.with_position

    def watched(df, *args):
        seen.append(df)
        return place(df, *args)

    monkeypatch.setattr(ev, "with_position", watched)
    got = {(r.user_id, r.item_id): r.is_test for r in ev.holdout_split(ratings, share=0.5).collect()}
    want = {}
    for u in range(40):
        mine = sorted((md5(u, i, 42), i) for v, i, _ in rows if v == u)
        quota = max(1, int(0.2 * len(mine) + 1e-9)) if u in chosen and len(mine) >= 5 else 0
        want.update({(u, i): n < quota for n, (_, i) in enumerate(mine)})
    assert got == want and any(want.values())
    assert {r.user_id for r in seen[0].collect()} == chosen and dict(seen[0].dtypes)["_d"] == "binary"


def test_lists_that_are_read_once_are_not_stored(spark, monkeypatch):
    from marketloom.registry import lists

    recs = spark.createDataFrame([(1, 2, 0.5, 1, "hybrid")], "user_id long, item_id long, score double, rank int, recommendation_type string")
    stored = []
    monkeypatch.setattr(lists, "listed", lambda *_: (recs, None))
    monkeypatch.setattr(lists, "materialise", lambda df: stored.append(df) or df)
    assert lists.all_users_job(spark, "").collect()[0][:4] == (1, 2, 0.5, 1) and not stored
    assert lists.all_lists(spark, "")[0] is recs and stored == [recs]
