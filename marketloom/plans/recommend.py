"""Top-N recommenders for all users in one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.operators.grid import VectorTable, pair_grid, user_grid
from marketloom.operators.scale import (
    co_occurrence, lookup_join, mirrored, salted_join, scalars, spread_rows, stored_side, tasks_for, top_k,
    top_scored,
)
from marketloom.plans.similarity import item_cosine, user_cosine, with_unit
from marketloom.session import materialise

# Thresholds and weights of the published configuration.
THRESHOLD = 0.001
USER_WEIGHT = 0.1
ITEM_WEIGHT = 0.1
FEATURE_WEIGHT = 0.8
POPULARITY_WEIGHT = 0.3
TREND_WEIGHT = 0.3
TOP_N = 10
USER_ROWS = 100_000  # ratings of a user that one task takes
TASK_ROWS = 2_000_000  # contributions that one task adds up
SMALL_NEIGHBOURS = 200_000  # rows of a neighbour table that is broadcast


def unseen_scores(parts: DataFrame, ratings: DataFrame, min_weight: float) -> DataFrame:
    """``num / den`` per unseen (user, item). Seen pairs ride along as marks, so no anti-join shuffle is needed."""
    marks = ratings.select(
        "user_id", "item_id", F.lit(0.0).alias("num"), F.lit(0.0).alias("den"), F.lit(1).alias("seen"))
    return unseen(summed(parts.withColumn("seen", F.lit(0)).unionByName(marks)), min_weight)


def spread(ratings: DataFrame, directed: DataFrame, num: Column, den: Column) -> DataFrame:
    """Contributions to (user, candidate item): every rating meets the neighbours of its item.

    The rows are not grouped here; the caller's aggregation adds them up map-side, together with the seen marks. Small
    neighbour tables are broadcast, and the ratings dealt out by user: then a user's contributions add up before the shuffle.
    A user with more than ``USER_ROWS`` ratings is spread over several tasks.
    """
    source = materialise(directed.withColumnRenamed("i", "item_id"))
    return meet(ratings, source, source.count() <= SMALL_NEIGHBOURS, num, den)


def meet(ratings: DataFrame, source: DataFrame, small: bool, num: Column, den: Column) -> DataFrame:
    if not small:
        met = salted_join(spread_rows(ratings, "user_id", "item_id"), source, ["item_id"])
    else:
        met = by_user(ratings).join(F.broadcast(source), "item_id")
    return met.select("user_id", F.col("j").alias("item_id"), num.alias("num"), den.alias("den"))


def by_user(ratings: DataFrame) -> DataFrame:
    """Ratings dealt out by user; a user with more than ``USER_ROWS`` is spread over several tasks.

    Whatever is summed by user afterwards adds up in front of its shuffle, also behind a checkpoint.
    """
    sizes = ratings.groupBy("user_id").agg(F.count(F.lit(1)).alias("_n"))
    hot = sizes.filter(F.col("_n") > USER_ROWS).select("user_id", F.ceil(F.col("_n") / USER_ROWS).alias("_parts"))
    dealt = ratings.join(F.broadcast(hot), "user_id", "left").withColumn(  # at most one row for each USER_ROWS ratings
        "_part", F.pmod(F.xxhash64("item_id"), F.coalesce("_parts", F.lit(1)))).drop("_parts")
    return spread_rows(dealt, "user_id", "_part").drop("_part")


def summed(parts: DataFrame) -> DataFrame:
    return parts.groupBy("user_id", "item_id").agg(
        F.sum("num").alias("num"), F.sum("den").alias("den"), F.max("seen").alias("seen"))


def contributions(
    ratings: DataFrame, directed: DataFrame, num: Column, den: Column, sized_by: DataFrame | None = None
) -> DataFrame:
    """Sums of ``spread`` over (user, candidate item), with ``seen`` 1 for rated items.

    Where neighbours and items fit a broadcast, every item is a neighbour of its own that adds nothing but the mark. The
    ratings, dealt out by user, are then all that is shuffled: sums and the caller's ranking stay in the user's task. The
    number of tasks follows the contributions. A user with more than ``USER_ROWS`` ratings is too large for that.
    ``sized_by`` may name a cheaper frame with the same users and items for counting them.
    """
    source = materialise(directed.withColumnRenamed("i", "item_id"))
    sized = ratings if sized_by is None else sized_by
    counts = materialise(sized.groupBy("item_id").agg(F.count(F.lit(1)).alias("_n")))
    near, most = source.count(), sized.groupBy("user_id").count().agg(F.max("count")).first()[0] or 0
    if near + counts.count() > SMALL_NEIGHBOURS or most > USER_ROWS:
        parts = meet(ratings, source, near <= SMALL_NEIGHBOURS, num, den).withColumn("seen", F.lit(0))
        marks = ratings.select(
            "user_id", "item_id", F.lit(0.0).alias("num"), F.lit(0.0).alias("den"), F.lit(1).alias("seen"))
        return summed(parts.unionByName(marks))
    sizes = source.groupBy("item_id").agg((F.count(F.lit(1)) + 1).alias("_k"))
    made = counts.join(sizes, "item_id", "left").agg(F.sum(F.col("_n") * F.coalesce("_k", F.lit(1)))).first()[0] or 0
    values = [c for c in source.columns if c not in ("item_id", "j")]
    own = counts.select("item_id", F.col("item_id").alias("j"), *[F.lit(0.0).alias(c) for c in values], F.lit(1).alias("seen"))
    table = source.select("item_id", "j", *values, F.lit(0).alias("seen")).unionByName(own)
    met = spread_rows(ratings, "user_id", tasks=tasks_for(ratings, made, TASK_ROWS)).join(F.broadcast(table), "item_id")
    return summed(met.select("user_id", F.col("j").alias("item_id"), num.alias("num"), den.alias("den"), "seen"))


def unseen(sums: DataFrame, min_weight: float) -> DataFrame:
    return sums.filter((F.col("seen") == 0) & (F.col("den") > min_weight)).select(
        "user_id", "item_id", (F.col("num") / F.col("den")).alias("score"))


def of_users(rows: DataFrame, only: DataFrame | None) -> DataFrame:
    """Rows of the requested users; the filter sits in front of every join."""
    return rows if only is None else rows.join(only.select("user_id").distinct(), "user_id", "left_semi")


def item_cf_scores(
    ratings: DataFrame, sim: DataFrame, threshold: float = THRESHOLD, only: DataFrame | None = None
) -> DataFrame:
    """Score of every unseen item: rating mean weighted by similarity to the user's rated items."""
    directed = mirrored(sim.filter(F.col("sim") > threshold))
    mine = of_users(ratings, only)
    sums = contributions(
        mine.select("user_id", "item_id", "rating"), directed, F.col("sim") * F.col("rating"), F.col("sim"))
    return unseen(sums, 0.0)


def item_cf(
    ratings: DataFrame, n: int = TOP_N, threshold: float = THRESHOLD, sim: DataFrame | None = None,
    only: DataFrame | None = None,
) -> DataFrame:
    sim = item_cosine(ratings) if sim is None else sim
    return top_scored(item_cf_scores(ratings, sim, threshold, only), ["user_id"], "score", "item_id", n)


def stored_item_cf(
    ratings: DataFrame, neighbours: DataFrame, n: int = TOP_N, threshold: float = THRESHOLD, only: DataFrame | None = None,
) -> DataFrame:
    """``item_cf`` over the bucketed tables of ``save_matrices``: ratings meet the neighbours of their item bucket by bucket,
    without an exchange; only the contributions are shuffled."""
    mine = of_users(ratings, only)
    met = mine.join(neighbours.filter(F.col("sim") > threshold), ["item_id", "salt"])
    parts = met.select("user_id", F.col("other_id").alias("item_id"), (F.col("sim") * F.col("rating")).alias("num"),
                       F.col("sim").alias("den"))
    return top_scored(unseen_scores(parts, mine, 0.0), ["user_id"], "score", "item_id", n)


def user_cf_scores(ratings: DataFrame, threshold: float = THRESHOLD, only: DataFrame | None = None) -> DataFrame:
    """Neighbour-weighted mean rating of every unseen item, without a user x user table.

    The weighted sum over neighbours is linear in the similarity, so it factors through item pairs:
    ``sum_v sim(u,v) r(v,i) = sum_j unit(u,j) * G(j,i)`` with ``G(j,i) = sum_v unit(v,j) r(v,i)``, and likewise for
    the weights. The cost is the users' squared history length instead of the items' squared audience. Neighbours at
    or below the threshold exist only between users with long vectors; those few pairs are found and subtracted.
    """
    unit = with_unit(ratings, "user_id", "u")
    kernel = co_occurrence(
        unit, "user_id", "item_id", ["rating", "u"],
        {
            "g": F.sum(F.col("l_u") * F.col("r_rating")),
            "hi": F.sum("l_u"),
            "hj": F.sum("r_u"),
        },
        sized_by=ratings,
    )
    directed = mirrored(kernel, {"hi": "hj", "hj": "hi"}).select("i", "j", "g", "hi")
    sums = contributions(
        of_users(unit, only).select("user_id", "item_id", "u"), directed,
        F.col("u") * F.col("g"), F.col("u") * F.col("hi"), sized_by=of_users(ratings, only))
    weak = weak_user_parts(ratings, threshold)
    if weak is not None:
        sums = summed(sums.unionByName(of_users(weak, only).withColumn("seen", F.lit(0))))
    return unseen(sums, threshold / 2)


def weak_user_parts(ratings: DataFrame, threshold: float) -> DataFrame | None:
    """Negative contributions of neighbours with ``0 < sim <= threshold``; None where no user is long enough for one.

    A shared item gives a dot product of at least the square of the least positive rating, so the lengths of such a pair
    multiply to at least that square over the threshold. One of both users must then reach the root of this bound: those
    few are joined with all, and the bound is checked for each pair in the join, before products are summed.
    """
    sizes = ratings.groupBy("user_id").agg(F.sqrt(F.sum(F.col("rating") * F.col("rating"))).alias("length"))
    least = scalars(ratings.filter("rating > 0"), m=F.min("rating"))["m"]
    bound = least * least / threshold * (1 - 1e-9)
    if not sizes.filter(F.col("length") * F.col("length") >= bound).head(1):
        return None
    sized = ratings.select("user_id", "item_id", "rating").join(sizes, "user_id")

    def side(rows: DataFrame, name: str) -> DataFrame:
        return rows.select("item_id", F.col("user_id").alias(name), F.col("rating").alias(f"r_{name}"),
                           F.col("length").alias(f"l_{name}"))

    long_rows = sized.filter(F.col("length") * F.col("length") >= bound)
    lengths = F.col("l_i") * F.col("l_j")
    once = (F.col("l_i") * F.col("l_i") < bound) | (F.col("i") < F.col("j"))
    met = salted_join(side(sized, "i"), side(long_rows, "j"), ["item_id"]).filter(
        (F.col("i") != F.col("j")) & (lengths >= bound) & once)
    sims = met.groupBy("i", "j").agg((F.sum(F.col("r_i") * F.col("r_j")) / F.max(lengths)).alias("sim"))
    pairs = mirrored(sims.filter((F.col("sim") > 0) & (F.col("sim") <= threshold)))
    met = salted_join(ratings.select(F.col("user_id").alias("j"), "item_id", "rating"), pairs, ["j"])
    return met.groupBy(F.col("i").alias("user_id"), "item_id").agg(
        F.sum(-F.col("sim") * F.col("rating")).alias("num"), F.sum(-F.col("sim")).alias("den"))


def user_cf(
    ratings: DataFrame, n: int = TOP_N, threshold: float = THRESHOLD, only: DataFrame | None = None
) -> DataFrame:
    return top_scored(user_cf_scores(ratings, threshold, only), ["user_id"], "score", "item_id", n)


def blended_cf(
    ratings: DataFrame, sim: DataFrame, table: VectorTable, cf_weight: float, n: int = TOP_N,
    threshold: float = THRESHOLD, candidates: DataFrame | None = None, only: DataFrame | None = None,
) -> DataFrame:
    """Item CF under ``cf_weight * cf + (1 - cf_weight) * feature`` similarity.

    Feature similarity is nonzero for almost all item pairs, so its part is scored through per-user vector sums on
    a block grid; the CF part stays sparse. Pairs at or below the threshold are rare and are subtracted exactly.
    """
    shared = table.where_in(
        candidates if candidates is not None else ratings.select(F.col("item_id").alias("id"))).materialised()
    ids, _ = stored_side(shared.df.select(F.col("id").alias("item_id")))
    rated = materialise(by_user(of_users(ratings, only).join(ids, "item_id", "left_semi")))
    w, fw = cf_weight, 1 - cf_weight
    cf = materialise(sim.join(ids.withColumnRenamed("item_id", "i"), "i", "left_semi").join(
        ids.withColumnRenamed("item_id", "j"), "j", "left_semi").filter(F.col("sim") > 0))
    weak_features = pair_grid(shared, low=0.0, high=threshold, scale=fw).join(cf.select("i", "j"), ["i", "j"], "left_anti")
    left = shared.df.select(F.col("id").alias("i"), *[F.col(c).alias(f"a_{c}") for c in shared.dense + shared.match])
    right = shared.df.select(F.col("id").alias("j"), *[F.col(c).alias(f"b_{c}") for c in shared.dense + shared.match])
    dot = shared.similarity("a_", "b_")
    weak_cf = (
        cf.filter(F.col("sim") * w <= threshold).join(left, "i").join(right, "j")
        .select("i", "j", (F.col("sim") * w + dot * fw).alias("sim"))
        .filter(F.col("sim") <= threshold)
    )
    weak = weak_features.unionByName(weak_cf).select("i", "j", (-F.col("sim")).alias("s"))
    directed = mirrored(cf.select("i", "j", (F.col("sim") * w).alias("s")).unionByName(weak))
    sums = contributions(
        rated.select("user_id", "item_id", "rating"), directed, F.col("s") * F.col("rating"), F.col("s"))
    return user_grid(rated, shared, sums, n=n, scale=fw, min_weight=threshold / 2)


def attach_items(recs: DataFrame, items: DataFrame, columns: list[str]) -> DataFrame:
    """Item details next to each recommendation; an unknown item keeps id and score with placeholder values (JN3)."""
    known = items.select(F.col("id").alias("item_id"), *columns, F.lit(True).alias("_known"))
    joined = lookup_join(recs, known, ["item_id"])
    fill = {"name": F.col("item_id").cast("string"), "symbol": F.lit("")}
    return joined.select(
        *recs.columns,
        *[F.when(F.col("_known"), F.col(c)).otherwise(fill.get(c, F.lit("unknown") if c in (
            "chain", "primary_category") else F.lit(None))).alias(c) for c in columns],
    )


def top_catalog(items: DataFrame, score: str, n: int) -> DataFrame:
    """The n best catalog items by a 0..100 score, as ``(item_id, score, rank)`` with score / 100."""
    first = items.orderBy(F.round(score, 8).desc_nulls_last(), F.col("id").asc()).limit(n)
    return top_k(
        first.select(F.lit(0).alias("_all"), F.col("id").alias("item_id"), (F.col(score) / 100).alias("score")),
        ["_all"], [F.round("score", 8).desc_nulls_last(), F.col("item_id").asc()], n).drop("_all")


def for_every_user(users: DataFrame, ranked: DataFrame, n: int) -> DataFrame:
    """The same n-row list for every user: the list is one scalar array of at most n structs."""
    entries = ranked.filter(F.col("rank") <= n).agg(F.collect_list(F.struct("rank", "item_id", "score"))).scalar()
    return users.select("user_id", F.explode(entries).alias("r")).select("user_id", "r.item_id", "r.score", "r.rank")


def hybrid(
    user_recs: DataFrame, item_recs: DataFrame, feature_recs: DataFrame | None, items: DataFrame, users: DataFrame,
    n: int = TOP_N, weights: tuple[float, float, float] = (USER_WEIGHT, ITEM_WEIGHT, FEATURE_WEIGHT),
    popularity_weight: float = POPULARITY_WEIGHT, trend_weight: float = TREND_WEIGHT, feature_scale: float = 1.0,
) -> DataFrame:
    """Weighted blend of three top-2n lists plus popularity and trend; users without candidates get popular items.

    The feature score enters unscaled unless ``feature_scale`` is given, as in the original definition.
    """
    wu, wi, wf = weights
    cut = F.col("rank") <= 2 * n
    parts = user_recs.filter(cut).select("user_id", "item_id", (F.col("score") / 5 * wu).alias("s")).unionByName(
        item_recs.filter(cut).select("user_id", "item_id", (F.col("score") / 5 * wi).alias("s")))
    if feature_recs is not None:
        parts = parts.unionByName(
            feature_recs.filter(cut).select("user_id", "item_id", (F.col("score") / feature_scale * wf).alias("s")))
    merged = spread_rows(parts, "user_id").groupBy("user_id", "item_id").agg(F.sum("s").alias("s"))
    blended = materialise(merged)  # read twice, at most 6n rows a user, which lie together
    best = scalars(items, pop=F.max("popularity_score"), trend=F.max("trend_score"))
    bonus = items.select(
        F.col("id").alias("item_id"),
        (
            F.when(best["pop"] > 0, F.col("popularity_score") / best["pop"]).otherwise(0.0) * popularity_weight
            + F.when(best["trend"] > 0, F.col("trend_score") / best["trend"]).otherwise(0.0) * trend_weight
        ).alias("bonus"),
    )
    held, small = stored_side(blended.select("item_id").distinct())
    if small:  # the lists of all users hold few different items
        bonus = F.broadcast(bonus.join(held, "item_id", "left_semi"))
    scored = lookup_join(blended, bonus, ["item_id"]).select(
        "user_id", "item_id", (F.col("s") + F.coalesce("bonus", F.lit(0.0))).alias("score"))
    ranked = top_scored(scored, ["user_id"], "score", "item_id", n)
    idle = users.select("user_id").distinct().join(blended.select("user_id").distinct(), "user_id", "left_anti")
    popular = for_every_user(idle, top_catalog(items, "popularity_score", n), n)
    return ranked.unionByName(popular.select(*ranked.columns))


def hybrid_items(ratings: DataFrame, items: DataFrame, n: int = TOP_N) -> DataFrame:
    """Ids of all items that ``hybrid`` lists over these ratings can hold: rated ones and the n most popular."""
    return ratings.select("item_id").unionByName(top_catalog(items, "popularity_score", n).select("item_id")).distinct()


def filtered_recs(recs: DataFrame, items: DataFrame, keep: Column, n: int, among: DataFrame | None = None) -> DataFrame:
    """Over-fetched recommendations filtered on item attributes, re-ranked to n.

    ``among`` may name the items that the recommendations can hold; the catalog is narrowed to them first.
    """
    matching = items.filter(keep).select(F.col("id").alias("item_id"))
    if among is not None:
        matching, _ = stored_side(matching.join(stored_side(among.select("item_id"))[0], "item_id", "left_semi"))
    kept = recs.join(matching, "item_id", "left_semi").drop("rank")
    return top_scored(kept, ["user_id"], "score", "item_id", n)


def by_category(
    recs: DataFrame, items: DataFrame, category: str, n: int = TOP_N, among: DataFrame | None = None
) -> DataFrame:
    keep = (F.col("primary_category") == category) | F.array_contains("categories", category)
    return filtered_recs(recs, items, keep, n, among)


def by_chain(
    recs: DataFrame, items: DataFrame, chain: str, n: int = TOP_N, among: DataFrame | None = None
) -> DataFrame:
    return filtered_recs(recs, items, F.col("chain") == chain, n, among)


def cold_users(users: DataFrame, interactions: DataFrame, minimum: int = 3) -> DataFrame:
    """Users with fewer than ``minimum`` interactions, unknown ones included."""
    counts = interactions.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return users.select("user_id").join(counts, "user_id", "left").filter(
        F.coalesce("n", F.lit(0)) < minimum).select("user_id")


def interest_recs(interests: DataFrame, items: DataFrame, n: int = TOP_N) -> DataFrame:
    """Popular items of each user's interests, ``max(3, n // interests)`` per interest, deduplicated in order.

    ``interests`` is ``(user_id, interests array)``. Each interest offers at most n items, so the per-interest lists
    are bounded; a user may receive fewer than n rows and is then topped up by the caller.
    """
    tags = items.select(
        "id", "popularity_score",
        F.explode(F.array_distinct(F.array_append(F.col("categories"), F.col("primary_category")))).alias("interest"))
    lists = (
        top_k(tags, ["interest"], [F.round("popularity_score", 8).desc_nulls_last(), F.col("id").asc()], max(3, n), "r")
        .groupBy("interest").agg(F.collect_list(F.struct("r", "id", "popularity_score")).alias("offer"))
    )
    wanted = interests.select(
        "user_id", F.size("interests").alias("k"), F.posexplode("interests").alias("place", "interest"))
    offered = salted_join(wanted, lists, ["interest"]).select(
        "user_id", "k", "place", F.explode("offer").alias("o")
    ).filter(F.col("o.r") <= F.greatest(F.lit(3), F.floor(F.lit(n) / F.col("k"))))
    first = offered.groupBy("user_id", F.col("o.id").alias("item_id")).agg(
        F.min(F.struct("place", "o.r")).alias("at"), F.first("o.popularity_score").alias("p"))
    return top_k(
        first, ["user_id"], [F.col("at.place").asc(), F.col("at.r").asc()], n
    ).select("user_id", "item_id", (F.coalesce("p", F.lit(50.0)) / 100).alias("score"), "rank")


def seed_ratings(users: DataFrame, items: DataFrame, seed: int = 42, k: int = 3) -> DataFrame:
    """Starting ratings 3..5 for new users on the k most popular items, drawn by hash."""
    seeded = for_every_user(users, top_catalog(items, "popularity_score", k), k)
    draw = F.pmod(F.xxhash64("user_id", "item_id", F.lit(seed)), F.lit(3)) + 3
    return seeded.select("user_id", "item_id", draw.cast("double").alias("rating"))


def first_of(lists: list[DataFrame], n: int) -> DataFrame:
    """Concatenate recommendation lists per user and keep the first appearance of each item."""
    tagged = None
    for place, recs in enumerate(lists):
        part = recs.select("user_id", "item_id", "score", F.col("rank").alias("r"), F.lit(place).alias("place"))
        tagged = part if tagged is None else tagged.unionByName(part)
    first = tagged.groupBy("user_id", "item_id").agg(F.min(F.struct("place", "r", "score")).alias("b"))
    ordered = top_k(first, ["user_id"], [F.col("b.place"), F.col("b.r"), F.col("item_id")], n)
    return ordered.select("user_id", "item_id", F.col("b.score").alias("score"), "rank")


def fresh_recs(
    stored: DataFrame, items: DataFrame, as_of: Column, hours: int = 12, category: str | None = None,
    chain: str | None = None,
) -> DataFrame:
    """Stored recommendations younger than ``hours``, joined to items and optionally filtered."""
    recent = stored.filter(F.col("created_at") > as_of - F.make_interval(hours=F.lit(hours)))
    detail = items.select(F.col("id").alias("item_id"), "name", "chain", "primary_category", "categories")
    if category is not None:
        detail = detail.filter((F.col("primary_category") == category) | F.array_contains("categories", category))
    if chain is not None:
        detail = detail.filter(F.col("chain") == chain)
    return salted_join(recent, detail, ["item_id"])


def replace_recs(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Replace each (user, type) list present in ``new``; all other stored rows stay."""
    touched = new.select("user_id", "recommendation_type").distinct()
    return stored.join(touched, ["user_id", "recommendation_type"], "left_anti").unionByName(
        new.select(*stored.columns))


def all_users(lists: dict[str, DataFrame], items: DataFrame, users: DataFrame, n: int = 20) -> DataFrame:
    """Every recommendation type for every user in one frame.

    ``lists`` maps a type to ranked recommendations; popular and trending lists of ``n`` items are added for all users.
    """
    parts = {
        "popular": for_every_user(users, top_catalog(items, "popularity_score", n), n),
        "trending": for_every_user(users, top_catalog(items, "trend_score", n), n),
        **lists,
    }
    out = None
    for kind, recs in parts.items():
        one = recs.select(
            "user_id", "item_id", F.col("score").cast("double").alias("score"), F.col("rank").cast("int").alias("rank"),
            F.lit(kind).alias("recommendation_type"))
        out = one if out is None else out.unionByName(one)
    return out


def cold_start(
    users: DataFrame, ratings: DataFrame, items: DataFrame, table: VectorTable, cf_weight: float, n: int = TOP_N,
    interests: DataFrame | None = None, seed: int = 42,
) -> DataFrame:
    """Lists for users without history.

    Interest lists come first; who gets fewer than n items from them continues with a hybrid over three seeded
    ratings at weights .05/.05/.9, and with trending items while that list is shorter than n / 2.
    """
    full = None
    rest = users.select("user_id")
    if interests is not None:
        found = materialise(interest_recs(interests, items, n))
        done = found.groupBy("user_id").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") >= n)
        full = found.join(done, "user_id", "left_semi").select("user_id", "item_id", "score", "rank")
        rest = materialise(rest.join(done, "user_id", "left_anti"))
    both = ratings.select("user_id", "item_id", "rating").unionByName(seed_ratings(rest, items, seed))
    seeded = materialise(both.groupBy("user_id", "item_id").agg(F.max("rating").alias("rating")))  # a seed may be rated already
    sim = materialise(item_cosine(ratings))
    hybrid_recs = hybrid(
        user_cf(seeded, 2 * n, only=rest), item_cf(seeded, 2 * n, sim=sim, only=rest),
        blended_cf(seeded, sim, table, cf_weight, 2 * n, only=rest), items, rest, n, weights=(0.05, 0.05, 0.9))
    short = hybrid_recs.groupBy("user_id").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") < n // 2)
    trending = for_every_user(short, top_catalog(items, "trend_score", n), n)
    warm = first_of([hybrid_recs, trending], n)
    return warm if full is None else full.unionByName(warm.select(*full.columns))
