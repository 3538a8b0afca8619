"""Similarity tables in long form."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.operators.grid import VectorTable, pair_grid, unit_rows
from marketloom.operators.nearest import nearest
from marketloom.operators.scale import (
    SCORE_DIGITS, block_of, clean_number, co_occurrence, mirrored, salted_join, scalars, stored_side, tasks_for, top_k,
    top_scored,
)
from marketloom.operators.sparse import sparse_cosines, whole
from marketloom.session import materialise

# Feature names, log-scaled names and weights of the feature similarity.
NUMERIC_FEATURES = [
    "market_cap", "total_volume", "price_change_percentage_24h", "price_change_percentage_7d",
    "reddit_subscribers", "twitter_followers", "github_stars",
]
LOG_FEATURES = ["market_cap", "total_volume", "reddit_subscribers", "twitter_followers"]
MATCH_FEATURES = ["chain", "primary_category"]
CATEGORY_WEIGHT = 0.25
CF_WEIGHT = 0.7
MANY_MEMBERS = 8192  # fewer have so few pairs that these add up in front of the shuffle
JOIN_COST = 500  # of a joined pair of rows, against one product in a matrix


def lengths(ratings: DataFrame, key: str) -> DataFrame:
    return ratings.groupBy(key).agg(F.sqrt(F.sum(F.col("rating") * F.col("rating"))).alias("length"))


def with_unit(ratings: DataFrame, key: str, name: str) -> DataFrame:
    """Ratings divided by the length of their row (user) or column (item) vector."""
    sized, small = stored_side(lengths(ratings, key))
    joined = ratings.join(sized, key) if small else salted_join(ratings, sized, [key])
    return joined.withColumn(name, F.col("rating") / F.col("length")).drop("length")


def cosine_pairs(ratings: DataFrame, member: str, group: str, within: DataFrame | None = None) -> DataFrame:
    """Cosine of all member vectors with a common group, ``(i, j, sim)`` with i < j; other pairs are zero.

    ``within`` keeps the pairs whose members are both among its ``id``; the others are dropped before they are paired.
    """
    unit, sized = with_unit(ratings, member, "u"), ratings
    if within is not None:
        ids = within.select(F.col("id").alias(member))
        unit, sized = (rows.join(ids, member, "left_semi") for rows in (unit, sized))
    sizes = sized.groupBy(group).agg(F.count(F.lit(1)).cast("double").alias("n"))
    groups, met = sizes.agg(F.count(F.lit(1)), F.sum(F.col("n") * F.col("n"))).first()
    members = sized.select(member).distinct().count()
    if members >= MANY_MEMBERS and (met or 0) * JOIN_COST >= float(members) ** 2 * groups:
        return shared_pairs(unit, member, group, "u", members)
    return co_occurrence(unit, group, member, ["u"], {"sim": F.sum(F.col("l_u") * F.col("r_u"))}, sized_by=sized)


def shared_pairs(
    rows: DataFrame, member: str, group: str, value: str, members: int, block: int = 8192, tile: int = 1_000_000,
) -> DataFrame:
    """Sums of products of ``value`` over the common groups of all pairs of members with one, ``(i, j, sim)`` with i < j.

    For members most of which have common groups: their vectors travel once for each block of members, a cell multiplies two
    blocks in tiles and gives out the pairs, which are nowhere shuffled. A member's row holds all its groups.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    blocks = max(1, math.ceil(members / block), min(math.ceil(members / 1024), math.ceil(math.sqrt(8 * cores))))
    known = rows.filter(F.col(member).isNotNull() & F.col(group).isNotNull())
    vectors = known.groupBy(F.col(member).alias("id")).agg(F.collect_list(F.struct(F.col(group).alias("g"), F.col(value).alias("v"))).alias("l"))
    dealt = vectors.select("id", F.col("l.g").alias("gs"), F.col("l.v").alias("vs"), block_of(F.col("id"), F.lit(blocks)).alias("_b"))
    left = dealt.select(F.col("_b").alias("a"), F.explode(F.sequence(F.col("_b"), F.lit(blocks - 1))).alias("b"), F.lit(True).alias("left"), "id", "gs", "vs")
    right = dealt.select(F.explode(F.sequence(F.lit(0), F.col("_b"))).alias("a"), F.col("_b").alias("b"), F.lit(False).alias("left"), "id", "gs", "vs")
    id_type = dealt.schema["id"].dataType.simpleString()

    def cell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = pa.Table.from_batches(list(batches))
        is_left = found["left"].to_numpy()
        sides = [found.filter(pa.array(w)) for w in (is_left, ~is_left)]
        if not len(sides[0]) or not len(sides[1]):
            return
        lists = [(s["gs"].combine_chunks(), s["vs"].combine_chunks()) for s in sides]
        ids = [s["id"].to_numpy() for s in sides]
        names, codes = np.unique(np.concatenate([g.flatten().to_numpy(zero_copy_only=False) for g, _ in lists]), return_inverse=True)
        values = [v.flatten().to_numpy() for _, v in lists]
        codes = np.split(codes, [len(values[0])])
        starts = [np.concatenate([[0], np.cumsum(np.diff(g.offsets.to_numpy()))]) for g, _ in lists]
        same = found["a"][0].as_py() == found["b"][0].as_py()
        plain = all((v > 0).all() for v in values)  # then a pair has a common group if its sum is not zero

        def dense(side: int, first: int, last: int, low: int, high: int, marks: bool) -> np.ndarray:
            part = slice(starts[side][first], starts[side][last])
            row = np.repeat(np.arange(last - first), np.diff(starts[side][first: last + 1]))
            code, at = codes[side][part], slice(None)
            if low > 0 or high < len(names):
                at = (code >= low) & (code < high)
            out = np.zeros((last - first, high - low))
            out[row[at], code[at] - low] = 1.0 if marks else values[side][part][at]
            return out

        columns = range(0, len(names), 1024)
        n_right, whole = len(ids[1]), len(names) <= 1024
        held = {m: dense(1, 0, n_right, 0, len(names), m) for m in ((False,) if plain else (False, True))} if whole else {}
        step = max(1, tile // n_right)
        for first in range(0, len(ids[0]), step):
            last = min(len(ids[0]), first + step)

            def total(marks: bool) -> np.ndarray:
                return sum(dense(0, first, last, c, min(c + 1024, len(names)), marks) @ (
                    held[marks] if whole else dense(1, 0, n_right, c, min(c + 1024, len(names)), marks)).T for c in columns)

            sim = total(False)
            keep = sim > 0 if plain else total(True) > 0
            if same:
                keep &= ids[0][first:last, None] < ids[1][None, :]
            r, c = np.divmod(np.flatnonzero(keep), n_right)
            i, j = ids[0][first + r], ids[1][c]
            yield pa.RecordBatch.from_arrays(
                [pa.array(x) for x in (np.minimum(i, j), np.maximum(i, j), sim.ravel()[r * n_right + c])], names=["i", "j", "sim"])

    cells = left.unionByName(right).repartition(max(blocks * (blocks + 1), cores), "a", "b")
    return cells.groupBy("a", "b").applyInArrow(cell, f"i {id_type}, j {id_type}, sim double")


def cosines_above(ratings: DataFrame, member: str, group: str, bound: float, dealt: bool = False) -> DataFrame:
    """``cosine_pairs`` above ``bound``. Pairs of whole-number members are compared where they are made, the others are not
    shuffled; see ``sparse_cosines``, also for ``dealt``."""
    kind = ratings.schema[member].dataType
    if not whole(kind):
        return cosine_pairs(ratings, member, group).filter(F.col("sim") > bound)
    found = sparse_cosines(ratings, member, group, above=bound, dealt=dealt)
    return found.select(F.col("i").cast(kind).alias("i"), F.col("j").cast(kind).alias("j"), "sim")


def item_cosine(ratings: DataFrame, within: DataFrame | None = None) -> DataFrame:
    return cosine_pairs(ratings, "item_id", "user_id", within)


def user_cosine(ratings: DataFrame) -> DataFrame:
    return cosine_pairs(ratings, "user_id", "item_id")


def neighbours(pairs: DataFrame, k: int) -> DataFrame:
    """The k most similar rows of every i."""
    return top_k(mirrored(pairs), ["i"], [F.round("sim", 8).desc(), F.col("j").asc()], k)


def cosine_neighbours(
    ratings: DataFrame, member: str, group: str, k: int, cell: int = 512, entries: int = 8_000_000, dealt: bool = False
) -> DataFrame:
    """``neighbours(cosine_pairs(...), k)`` without a table of pairs, see ``sparse_cosines``. Ids are whole numbers.

    ``cell`` members share a pack at most. A block holds twice ``entries`` ratings, a part nine times as many, and an eighth
    of ``entries`` products are held at once. ``dealt``: all ratings of a member lie in one partition already.
    """
    found = sparse_cosines(ratings, member, group, k=k, members=cell, block=2 * entries, part=9 * entries,
                           products=max(1, entries // 8), dealt=dealt)
    return top_k(found, ["i"], [F.round("sim", SCORE_DIGITS).desc(), F.col("j").asc()], k)


def scaled_numeric(items: DataFrame, columns: list[str], log_columns: list[str], constant: str = "keep") -> DataFrame:
    """Null and infinite to 0, log1p where asked, min-max to 0..1. A constant column is kept or set to zero."""
    prepared = items.select(
        *[c for c in items.columns if c not in columns],
        *[
            (F.log1p(v) if c in log_columns else v).alias(c)
            for c, v in ((c, F.coalesce(clean_number(F.col(c)), F.lit(0.0))) for c in columns)
        ],
    )
    bounds = scalars(
        prepared,
        **{f"lo_{c}": F.min(c) for c in columns},
        **{f"hi_{c}": F.max(c) for c in columns},
    )

    def scale(c: str) -> Column:
        span = bounds[f"hi_{c}"] - bounds[f"lo_{c}"]
        flat = F.col(c) if constant == "keep" else F.lit(0.0)
        return F.when(span > 0, (F.col(c) - bounds[f"lo_{c}"]) / span).otherwise(flat).alias(c)

    return prepared.select(*[c for c in prepared.columns if c not in columns], *[scale(c) for c in columns])


def numeric_vectors(items: DataFrame) -> VectorTable:
    """Unit numeric feature vectors."""
    scaled = scaled_numeric(items.select("id", *NUMERIC_FEATURES), NUMERIC_FEATURES, LOG_FEATURES)
    return VectorTable(unit_rows(scaled, NUMERIC_FEATURES), "id", NUMERIC_FEATURES)


def feature_vectors(items: DataFrame) -> VectorTable:
    """Vectors of the weighted feature similarity: 0.25 category match + 0.75 numeric cosine."""
    scaled = scaled_numeric(
        items.select("id", *MATCH_FEATURES, *NUMERIC_FEATURES), NUMERIC_FEATURES, LOG_FEATURES
    )
    return VectorTable(
        unit_rows(scaled, NUMERIC_FEATURES), "id", NUMERIC_FEATURES, MATCH_FEATURES,
        1 - CATEGORY_WEIGHT, CATEGORY_WEIGHT,
    )


def numeric_cosine(items: DataFrame, k: int) -> DataFrame:
    return nearest(numeric_vectors(items), k)


def weighted_feature_similarity(items: DataFrame, k: int) -> DataFrame:
    return nearest(feature_vectors(items), k)


def similar_to(items: DataFrame, item_id, k: int) -> DataFrame:
    """The rows of ``weighted_feature_similarity`` of one item, in one pass over the catalog."""
    table = feature_vectors(items)
    columns = table.dense + table.match
    one = table.df.filter(F.col("id") == F.lit(item_id)).select(F.col("id").alias("i"), *[F.col(c).alias(f"a_{c}") for c in columns])
    rest = table.df.select(F.col("id").alias("j"), *[F.col(c).alias(f"b_{c}") for c in columns])
    pairs = rest.join(F.broadcast(one), F.col("i") != F.col("j")).select("i", "j", table.similarity("a_", "b_").alias("sim"))
    best = pairs.orderBy(F.round("sim", SCORE_DIGITS).desc(), F.col("j").asc()).limit(k)
    return top_scored(best, ["i"], "sim", "j", k)


def similar_items(items: DataFrame, k: int = 5, only=None) -> DataFrame:
    """The k most similar catalog items of every item, or of the item ``only``, with the neighbour's details."""
    near = weighted_feature_similarity(items, k) if only is None else similar_to(items, only, k)
    detail = items.select(F.col("id").alias("j"), "name", "chain", "primary_category")
    return near.join(detail, "j").select("i", "j", "name", "chain", "primary_category", "sim", "rank")


def dense_cosine(vectors: DataFrame, id_col: str, vector_col: str, width: int, threshold: float) -> DataFrame:
    """Pairs of dense vectors above a cosine threshold."""
    names = [f"v{n}" for n in range(width)]
    wide = vectors.select(
        F.col(id_col).alias("id"), *[F.col(vector_col)[n].cast("double").alias(names[n]) for n in range(width)]
    )
    # a vector travels once for each block: many cells for the cores, but blocks of up to 8,192 rows
    rows, cores = vectors.count(), vectors.sparkSession.sparkContext.defaultParallelism
    blocks = max(math.ceil(rows / 8192), min(math.ceil(rows / 2048), math.ceil(math.sqrt(8 * cores))), 1)
    return pair_grid(VectorTable(unit_rows(wide, names), "id", names), low=threshold, block=max(1, math.ceil(rows / blocks)))


def category_cosine(items: DataFrame, k: int, columns: list[str] | None = None) -> DataFrame:
    """Nearest items by equal categorical columns: matches / columns (R4), the k best per item, ties by id.

    Full matches come first, then partial ones, each by id. Every group therefore only has to offer its
    ``2k + 1`` smallest ids, and no group is ever expanded into its pairs.
    """
    columns = columns or MATCH_FEATURES
    base = items.select("id", *columns)
    groups = [list(columns)] + [[c] for c in columns]
    offers = None
    for group in groups:
        first = top_k(base, group, [F.col("id").asc()], len(columns) * k + 1, "_r").filter(
            " AND ".join(f"{c} IS NOT NULL" for c in group))
        lists = first.groupBy(*group).agg(
            F.collect_list(F.struct("id", *columns)).alias("offer"))  # at most len(columns) * k + 1 entries
        part = salted_join(base, lists, group).select(
            F.col("id").alias("i"), *[F.col(c).alias(f"i_{c}") for c in columns], F.explode("offer").alias("o"))
        offers = part if offers is None else offers.unionByName(part)
    same = sum(
        (F.when(F.col(f"i_{c}") == F.col(f"o.{c}"), 1.0).otherwise(0.0) for c in columns[1:]),
        F.when(F.col(f"i_{columns[0]}") == F.col(f"o.{columns[0]}"), 1.0).otherwise(0.0),
    )
    pairs = (
        offers.filter(F.col("i") != F.col("o.id"))
        .select("i", F.col("o.id").alias("j"), (same / len(columns)).alias("sim"))
        .distinct()
    )
    return top_k(pairs, ["i"], [F.col("sim").desc(), F.col("j").asc()], k)


def common(table: VectorTable, ratings: DataFrame) -> VectorTable:
    """Keep the vectors of items that occur in the ratings."""
    return table.where_in(ratings.select(F.col("item_id").alias("id")))


def blended_neighbours(cf: DataFrame, table: VectorTable, cf_weight: float, k: int) -> DataFrame:
    """Nearest neighbours under ``cf_weight * cf + (1 - cf_weight) * feature`` on the shared items."""
    ids = table.df.select("id")
    shared = cf.join(ids.withColumnRenamed("id", "i"), "i", "left_semi").join(
        ids.withColumnRenamed("id", "j"), "j", "left_semi")
    extra = shared.select("i", "j", (F.col("sim") * cf_weight).alias("value"))
    return pair_grid(table, k=k, extra=extra, scale=1 - cf_weight)


def common_index_join(a: DataFrame, b: DataFrame, weight: float, shared: DataFrame | None = None) -> DataFrame:
    """``weight * a + (1 - weight) * b`` of two sparse pair tables on the ids known to both; a missing pair is 0 (JN6).

    ``shared`` names these ids as ``id``; without it they are read off the pairs.
    """

    def ids(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.explode(F.array("i", "j")).alias("id")).distinct()

    shared = ids(a).intersect(ids(b)) if shared is None else shared

    def inside(pairs: DataFrame, name: str) -> DataFrame:
        kept = pairs.join(shared.withColumnRenamed("id", "i"), "i", "left_semi").join(
            shared.withColumnRenamed("id", "j"), "j", "left_semi")
        return kept.select("i", "j", F.col("sim").alias(name))

    both = inside(a, "a").join(inside(b, "b"), ["i", "j"], "full_outer")
    zero = F.lit(0.0)
    return both.select("i", "j", (F.coalesce("a", zero) * weight + F.coalesce("b", zero) * (1 - weight)).alias("sim"))
