import zlib

import numpy as np
from pyspark.sql import functions as F

from marketloom.llm import queries, toxicity


def gram_strings(text):
    plain = f" {' '.join(text.lower().split())} "
    return [plain[i: i + n] for n in toxicity.ORDERS for i in range(len(plain) - n + 1)]


def test_a_bucket_depends_on_the_gram_alone():
    for text in ["", "a", "Ab Cd", "née  ß\n𐍈 née", "aaaaaaaa"]:
        names, found = gram_strings(text), toxicity.grams(text)
        assert len(names) == len(found)
        seen = dict(zip(names, found.tolist()))
        assert [seen[n] for n in names] == found.tolist()


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet").filter("toxic is not null").select("doc_id", "toxic")
    rows = queries.op4_toxicity(spark, sf).join(labels, "doc_id", "left").collect()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    judged = [r for r in rows if r.held_out and r.toxic is not None]
    toxic = [r.predicted for r in judged if r.toxic == 1]
    clean = [r.predicted for r in judged if r.toxic == 0]
    assert len(toxic) > 20 and np.mean(toxic) > 0.65 and np.mean(clean) < 0.01


def test_nulls_single_classes_and_clashing_columns(spark):
    docs = spark.createDataFrame(
        [(i, f"calm words number {i}" if i % 2 else f"nasty insult number {i}", 0.1) for i in range(60)]
        + [(None, "nasty", 0.2), (70, None, 0.3), (71, "", 0.4), (3, "calm words number 3", 0.5)],
        "doc_id long, text string, score double")
    labels = spark.createDataFrame(
        [(i, 1 - i % 2) for i in range(60)] + [(None, 1), (70, 1), (71, None), (3, 0), (99, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    kept = toxicity.without_toxic(docs, model)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None and r.doc_id < 60) == sorted(
        [*range(1, 60, 2), 3])
    for some in (labels.filter("toxic = 0"), labels.limit(0)):
        alone = toxicity.fit(docs, some)
        assert toxicity.without_toxic(docs, alone).count() == docs.count()
    assert docs.limit(0).select(model.score(F.col("text"))).count() == 0
    few = toxicity.fit(docs, labels, max_rows=20)
    assert len(few.buckets) <= len(model.buckets)


def test_against_a_plain_classifier(spark):
    """Log-count ratios from plain dictionaries, the regression by its optimality condition, scores by plain sums."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").limit(200)
    marks = spark.read.parquet(f"{sf}/labels.parquet").filter("toxic is not null").select("doc_id", "toxic")
    docs = docs.union(spark.createDataFrame([(-1, "You Idiot, you   idiot " * 30_000)], "doc_id long, text string"))
    marks = marks.unionByName(spark.createDataFrame([(-1, 1)], "doc_id long, toxic int").select(
        *[F.col(f.name).cast(f.dataType) for f in marks.schema]))
    model = toxicity.fit(docs, marks)
    toxic = {}
    for r in marks.collect():
        toxic[r.doc_id] = max(toxic.get(r.doc_id, 0), r.toxic)
    texts = {r.doc_id: r.text for r in docs.collect()}
    learned = [(i, t) for i, t in texts.items() if i in toxic and t is not None]
    assert len(learned) > 30 and {toxic[i] for i, _ in learned} == {0, 1}

    def buckets(text):
        return {int(b) for b in toxicity.grams(text)}

    counts, size = {}, [sum(toxic[i] == y for i, _ in learned) for y in (0, 1)]
    for i, t in learned:
        for b in buckets(t):
            counts.setdefault(b, [0, 0])[toxic[i]] += 1
    share = [n / sum(size) for n in size]
    ratio = {b: np.log((n[1] + share[1]) / size[1]) - np.log((n[0] + share[0]) / size[0])
             for b, n in counts.items() if sum(n) >= toxicity.MIN_COUNT}
    ratio = {b: r for b, r in ratio.items() if abs(r) >= toxicity.MIN_RATIO}
    assert model.buckets.tolist() == sorted(ratio)
    weight = dict(zip(model.buckets.tolist(), model.weights.tolist()))

    def score(text):
        z = model.intercept + sum(weight[b] for b in buckets(text or "") if b in weight)
        return 1 / (1 + np.exp(-z))

    got = {r.doc_id: r.s for r in docs.select("doc_id", model.score(F.col("text")).alias("s")).collect()}
    assert got.keys() == texts.keys() and all(abs(got[i] - score(t)) < 1e-5 for i, t in texts.items())
    slope, rest = {}, 0.0  # of the penalised mean log loss at the fitted weights: zero at the optimum, one at random ones
    for i, t in learned:
        off = (score(t) - toxic[i]) / len(learned)
        rest += off
        for b in buckets(t) & weight.keys():
            slope[b] = slope.get(b, 0.0) + off * ratio[b]
    assert abs(rest) < 1e-3 and max(abs(g + 1e-4 * weight[b] / ratio[b]) for b, g in slope.items()) < 1e-3


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")
    model = toxicity.fit(none, labels)
    assert not len(model.buckets) and toxicity.without_toxic(none, model).collect() == []
