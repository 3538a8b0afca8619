"""Hold-out splits and ranking metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.operators.scale import scalars, top_k, with_position
from marketloom.plans import recommend as rc
from marketloom.plans.similarity import CF_WEIGHT, feature_vectors, item_cosine
from marketloom.session import materialise

METRICS = ["precision", "recall", "f1", "mrr", "ndcg", "hit_ratio"]


def user_metrics(truth: DataFrame, pred: DataFrame, k: int = 10, by: Sequence[str] = ()) -> DataFrame:
    """Precision, recall, F1, MRR, NDCG and hit ratio at k per user with truth and predictions.

    ``truth`` is (user_id, item_id), ``pred`` adds rank; both carry the ``by`` columns (such as the method).
    """
    by = list(by)
    t = truth.select(*by, "user_id", "item_id", F.lit(1).alias("true"), F.lit(None).cast("int").alias("rank"))
    p = pred.filter(F.col("rank") <= k).select(
        *by, "user_id", "item_id", F.lit(0).alias("true"), F.col("rank").cast("int").alias("rank"))
    pairs = t.unionByName(p).groupBy(*by, "user_id", "item_id").agg(
        F.max("true").alias("true"), F.min("rank").alias("rank"))
    hit = (F.col("true") == 1) & F.col("rank").isNotNull()
    per_user = pairs.groupBy(*by, "user_id").agg(
        F.sum("true").alias("n_true"),
        F.count("rank").alias("n_pred"),
        F.sum(hit.cast("int")).alias("hits"),
        F.min(F.when(hit, F.col("rank"))).alias("first"),
        F.sum(F.when(hit, 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias("dcg"),
    ).filter((F.col("n_true") > 0) & (F.col("n_pred") > 0))
    ideal = F.aggregate(
        F.sequence(F.lit(1), F.least(F.col("n_true"), F.lit(k)).cast("int")), F.lit(0.0),
        lambda acc, i: acc + 1 / F.log2(i + 1))
    precision = F.col("hits") / F.least(F.lit(k), F.col("n_pred"))
    recall = F.col("hits") / F.col("n_true")
    rows = per_user.withColumns({"precision": precision, "recall": recall})
    both = F.col("precision") + F.col("recall")
    return rows.select(
        *by, "user_id", "precision", "recall",
        F.when(both > 0, 2 * F.col("precision") * F.col("recall") / F.nullif(both, F.lit(0.0))).otherwise(0.0).alias("f1"),
        F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("mrr"),
        (F.col("dcg") / ideal).alias("ndcg"),
        F.when(F.col("hits") > 0, 1.0).otherwise(0.0).alias("hit_ratio"),
    )


def evaluate(truth: DataFrame, pred: DataFrame, k: int = 10, by: Sequence[str] = ()) -> DataFrame:
    """Mean of the user metrics and the number of users (E9); one row per ``by`` group."""
    per_user = user_metrics(truth, pred, k, by)
    aggs = [F.avg(m).alias(m) for m in METRICS] + [F.count(F.lit(1)).alias("num_users")]
    return per_user.groupBy(*by).agg(*aggs) if by else per_user.agg(*aggs)


def diversity(pred: DataFrame, items: DataFrame, feature: str) -> DataFrame:
    """Distinct feature values per known item of each list; lists with one known item or less score 0 (E5)."""
    known = items.select(F.col("id").alias("item_id"), F.col(feature).alias("_f"), F.lit(1).alias("_k"))
    joined = pred.join(known, "item_id", "left")
    return joined.groupBy("user_id").agg(
        F.countDistinct(F.when(F.col("_k") == 1, F.coalesce(F.col("_f").cast("string"), F.lit("")))).alias("d"),
        F.count("_k").alias("n"),
    ).select("user_id", F.when(F.col("n") > 1, F.col("d") / F.col("n")).otherwise(0.0).alias("diversity"))


def novelty(pred: DataFrame, popularity: DataFrame) -> DataFrame:
    """Mean inverse popularity of the known items of each list, 0 when none is known."""
    joined = pred.join(popularity.select("item_id", "popularity"), "item_id", "left")
    inverse = 1 / F.greatest(F.col("popularity"), F.lit(1e-6))
    return joined.groupBy("user_id").agg(F.coalesce(F.avg(inverse), F.lit(0.0)).alias("novelty"))


def coverage(pred: DataFrame, items: DataFrame) -> DataFrame:
    """Share of the catalog that was recommended to anyone."""
    total = scalars(items, n=F.countDistinct("id"))["n"]
    return pred.agg((F.countDistinct("item_id") / total).alias("coverage"))


def serendipity(pred: DataFrame, ratings: DataFrame, popularity: DataFrame) -> DataFrame:
    """Mean over users of the mean unexpectedness ``1 - popularity / max`` of known items."""
    top = scalars(popularity, m=F.max("popularity"))["m"]
    known = pred.join(popularity.select("item_id", "popularity"), "item_id").join(
        ratings.select("user_id").distinct(), "user_id", "left_semi")
    per_user = known.groupBy("user_id").agg(F.avg(1 - F.col("popularity") / top).alias("s"))
    return per_user.agg(F.coalesce(F.avg("s"), F.lit(0.0)).alias("serendipity"))


def digest(*parts: str | Column, seed: int) -> Column:
    """Hex digest of ids and a seed; its order is the reproducible shuffle used by splits and draws."""
    texts = [F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts]
    return F.md5(F.concat_ws(":", *texts, F.lit(str(seed))))


def chosen_users(seed: int, share: float) -> Column:
    """True for about ``share`` of the users, by digest prefix."""
    bound = f"{min(int(share * 16**8), 16**8 - 1):08x}"
    prefix = F.substring(digest("user_id", seed=seed), 1, 8)
    return F.lit(True) if share >= 1 else prefix < bound


def holdout_split(
    ratings: DataFrame, share: float = 0.2, test_ratio: float = 0.2, min_interactions: int = 5, seed: int = 42
) -> DataFrame:
    """Ratings with ``is_test``: chosen users lose ``max(1, int(test_ratio * n))`` of their items.

    Items are ordered by digest and numbered through digest buckets, so long histories are split over tasks. Only the rows of
    chosen users are ordered; the digest travels as bytes, which sort like its digits.
    """
    chosen = chosen_users(seed, share)
    n = ratings.filter(chosen).groupBy("user_id").agg(F.count(F.lit(1)).alias("_n"))
    hashed = ratings.filter(chosen).withColumn("_d", F.unhex(digest("user_id", "item_id", seed=seed)))
    placed = with_position(
        hashed, ["user_id"], [F.col("_d"), F.col("item_id")], F.hex(F.substring("_d", 1, 1)), "_pos").join(n, "user_id")
    quota = F.greatest(F.lit(1), F.floor(F.col("_n") * test_ratio + 1e-9))
    test = (F.col("_n") >= min_interactions) & (F.col("_pos") < quota)
    return placed.select(*ratings.columns, test.alias("is_test")).unionByName(
        ratings.filter(F.col("user_id").isNotNull() & ~chosen).withColumn("is_test", F.lit(False)))


def split(ratings: DataFrame, **options) -> tuple[DataFrame, DataFrame]:
    """Train ratings and held-out (user, item) truth."""
    marked = materialise(holdout_split(ratings, **options))
    return marked.filter(~F.col("is_test")).drop("is_test"), marked.filter("is_test").select("user_id", "item_id")


def compare_models(truth: DataFrame, methods: dict[str, DataFrame], k: int = 10) -> DataFrame:
    """One metric row per method (E11). Every method must have been fitted on the training part only."""
    tested = truth.select("user_id").distinct()
    preds = None
    for name, recs in methods.items():
        one = recs.join(tested, "user_id", "left_semi").select(
            F.lit(name).alias("method"), "user_id", "item_id", F.col("rank").cast("int").alias("rank"))
        preds = one if preds is None else preds.unionByName(one)
    names = F.array(*[F.lit(m) for m in methods])
    expected = truth.select(F.explode(names).alias("method"), "user_id", "item_id")
    return evaluate(expected, preds, k, ["method"])


def standard_methods(train: DataFrame, items: DataFrame, users: DataFrame, k: int = 10, only=None) -> dict[str, DataFrame]:
    """User, item, feature and hybrid lists from train-only similarities."""
    sim = materialise(item_cosine(train))
    table = feature_vectors(items)
    wanted = users if only is None else only
    user_recs = materialise(rc.user_cf(train, 2 * k, only=only))
    item_recs = materialise(rc.item_cf(train, 2 * k, sim=sim, only=only))
    feature_recs = materialise(rc.blended_cf(train, sim, table, CF_WEIGHT, 2 * k, only=only))
    return {
        "user_based_cf": user_recs,
        "item_based_cf": item_recs,
        "feature_enhanced_cf": feature_recs,
        "hybrid": rc.hybrid(user_recs, item_recs, feature_recs, items, wanted, k),
    }


def user_cold_start(
    ratings: DataFrame, items: DataFrame, n_new_users: int = 20, n_interactions: int = 5, k: int = 10, seed: int = 42
) -> DataFrame:
    """Metrics of hybrid lists for added users.

    The 100 most rated items are shuffled by digest; new users draw from the first 60 and are tested on the rest plus
    the last quarter of those 60. New users have negative ids.
    """
    top = ratings.groupBy("item_id").agg(F.sum("rating").alias("s")).orderBy(F.desc("s"), F.asc("item_id")).limit(100)
    shuffled = top_k(
        top.select("item_id", F.lit(0).alias("_all"), digest("item_id", seed=seed).alias("_d")), ["_all"],
        [F.col("_d").asc()], 100, "place")
    total = scalars(shuffled, n=F.count(F.lit(1)))["n"]
    cut = F.floor(total * 0.6)
    pool = materialise(shuffled.select("item_id", (F.col("place") - 1).alias("place")))
    entries = pool.filter(F.col("place") < cut).agg(F.collect_list("item_id")).scalar()  # at most 60 ids
    new_ids = ratings.sparkSession.range(1, n_new_users + 1).select((-F.col("id")).alias("user_id"))
    offers = new_ids.select("user_id", F.explode(entries).alias("item_id"))
    drawn = top_k(
        offers.withColumn("_d", digest("user_id", "item_id", seed=seed)), ["user_id"], [F.col("_d").asc()],
        n_interactions, "_r")
    stars = F.pmod(F.xxhash64("user_id", "item_id", F.lit(seed)), F.lit(3)) + 3
    seeded = materialise(
        ratings.select("user_id", "item_id", "rating").unionByName(
            drawn.select("user_id", "item_id", stars.cast("double").alias("rating"))))
    methods = standard_methods(seeded, items, new_ids, 100, only=new_ids)
    holdout = pool.filter(F.col("place") >= F.floor(cut * 0.75)).agg(F.collect_list("item_id")).scalar()
    truth = new_ids.select("user_id", F.explode(holdout).alias("item_id"))
    return evaluate(truth, methods["hybrid"], k)


def item_cold_start(
    ratings: DataFrame, items: DataFrame, table_of=feature_vectors, n_new_items: int = 10, n_users: int = 20, n: int = 20,
    seed: int = 42, numeric: Sequence[str] = (),
) -> DataFrame:
    """How often cloned items without ratings are recommended, next to their templates.

    Each new item copies one of the 20 most rated items and varies some numeric features by up to 15 %. One row per
    new item: template, recommendation counts, mean position, ratio to the template, and the overall rate.
    """
    spark = ratings.sparkSession
    popular = (
        ratings.groupBy("item_id").agg(F.sum("rating").alias("s")).orderBy(F.desc("s"), F.asc("item_id")).limit(20))
    pool = popular.agg(F.sort_array(F.collect_list("item_id"))).scalar()
    new = spark.range(1, n_new_items + 1).select(
        (-F.col("id")).alias("new_id"),
        F.element_at(pool, (F.pmod(F.xxhash64("id", F.lit(seed)), F.size(pool)) + 1).cast("int")).alias("template_id"))
    new = materialise(new)
    clone = items.join(new, items.id == new.template_id)

    def varied(c: str) -> Column:
        h = F.xxhash64("new_id", F.lit(c), F.lit(seed))
        factor = 0.85 + 0.3 * F.pmod(h, F.lit(10_000)) / 10_000
        pick = F.pmod(F.xxhash64(F.lit(c), "new_id", F.lit(seed + 1)), F.lit(10)) < 3
        return F.when(pick, F.col(c) * factor).otherwise(F.col(c)).alias(c)

    clones = clone.select(
        F.col("new_id").alias("id"), *[varied(c) if c in numeric else F.col(c) for c in items.columns if c != "id"])
    catalog = materialise(items.unionByName(clones))
    active = materialise(
        ratings.groupBy("user_id").agg(F.sum("rating").alias("s")).orderBy(F.desc("s"), F.asc("user_id"))
        .limit(n_users).select("user_id"))
    sim = materialise(item_cosine(ratings))
    rated = ratings.select(F.col("item_id").alias("id")).distinct()
    with_new = rated.unionByName(new.select(F.col("new_id").alias("id")))
    fresh = rc.blended_cf(ratings, sim, table_of(catalog), CF_WEIGHT, n, candidates=with_new, only=active)
    base = rc.blended_cf(ratings, sim, table_of(items), CF_WEIGHT, n, only=active)
    counts = fresh.groupBy(F.col("item_id").alias("new_id")).agg(
        F.count(F.lit(1)).alias("n_new"), F.avg("rank").alias("mean_position"))
    templates = base.groupBy(F.col("item_id").alias("template_id")).agg(F.count(F.lit(1)).alias("n_template"))
    rows = new.join(counts, "new_id", "left").join(templates, "template_id", "left").fillna(0, ["n_new", "n_template"])
    rate = scalars(rows, r=F.avg((F.col("n_new") > 0).cast("double")))["r"]
    return rows.withColumns(
        {
            "similarity_ratio": F.when(F.col("n_template") > 0, F.col("n_new") / F.nullif(F.col("n_template"), F.lit(0)))
            .otherwise(0.0),
            "recommendation_rate": rate,
        }
    )
