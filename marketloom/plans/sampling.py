"""Reproducible sampling: negatives per user and weighted draws."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.operators.scale import dense_codes, lookup_join, salted_join, spread_rows, tasks_for, top_k
from marketloom.plans.evaluation import digest
from marketloom.session import materialise

BLOCK = 4096  # catalog numbers of a block: a piece of a walk expands to at most so many rows


def negative_samples(ratings: DataFrame, catalog: DataFrame, ratio: int = 4, seed: int = 42) -> DataFrame:
    """Per user ``min(ratio * positives, remaining)`` unseen items, as ``(user_id, item_id, label)`` with label 0.

    The catalog is numbered in the order of its items' digests, a permutation keyed by ``seed``; every user walks it from
    a start of its own, so draws never repeat and neighbouring draws are unrelated items. ``(ratio + 1) * positives`` steps
    always contain enough unseen items. Work grows with the positives only.

    A walk travels as pieces, one for each block of the catalog that it crosses, with the seen numbers in it. How many draws
    each piece keeps follows from the pieces before, so the draws are made where the block's items are and are not shuffled.
    Ratings without user draw nothing.
    """
    shuffled = catalog.select(F.col("id").alias("item_id")).distinct().withColumn("_d", digest("item_id", seed=seed))
    numbered = materialise(shuffled.join(dense_codes(shuffled, "_d", "_no"), "_d").drop("_d"))
    size_n = max(1, numbered.count())
    size = F.lit(size_n)
    counted = ratings.filter(F.col("user_id").isNotNull()).groupBy("user_id").agg(F.count(F.lit(1)).alias("_pos"))
    start = F.conv(F.substring(digest("user_id", seed=seed), 1, 12), 16, 10).cast("long") % size
    users = materialise(counted.select(
        "user_id", (F.col("_pos") * ratio).alias("_left"), start.alias("_s"),
        F.least(F.col("_pos") * (ratio + 1), size).alias("_n")))
    step = F.pmod(F.col("_no") - F.col("_s"), size)
    seen = (
        lookup_join(salted_join(ratings.select("user_id", "item_id"), numbered, ["item_id"]), users, ["user_id"], "inner")
        .filter(step < F.col("_n"))
        .groupBy("user_id", F.floor(F.col("_no") / BLOCK).alias("_block")).agg(F.collect_set("_no").alias("_gone"))
    )
    last = F.col("_s") + F.col("_n")  # where a walk passes the end of the catalog, it goes on at its start
    ranges = users.select("user_id", "_left", "_s", F.explode(F.array(
        F.struct(F.col("_s").alias("a"), F.least(last, size).alias("b"), F.lit(0).cast("long").alias("t")),
        F.struct(F.lit(0).cast("long").alias("a"), (last - size).alias("b"), (size - F.col("_s")).alias("t")))).alias("r")).filter("r.a < r.b")
    cut = ranges.select("user_id", "_left", "r", F.explode(F.sequence(
        F.floor(F.col("r.a") / BLOCK), F.floor((F.col("r.b") - 1) / BLOCK))).alias("_block"))
    first, end = F.greatest("r.a", F.col("_block") * BLOCK), F.least("r.b", (F.col("_block") + 1) * BLOCK)
    pieces = cut.select("user_id", "_left", "_block", first.alias("_a"), end.alias("_b"), (F.col("r.t") + first - F.col("r.a")).alias("_t"))
    inside = F.filter(F.coalesce("_gone", F.array().cast("array<bigint>")), lambda x: (x >= F.col("_a")) & (x < F.col("_b")))
    met = materialise(pieces.join(seen, ["user_id", "_block"], "left").withColumn("_gone", inside).withColumn(
        "_fresh", F.col("_b") - F.col("_a") - F.size("_gone")))
    before = Window.partitionBy("user_id").orderBy("_t").rowsBetween(Window.unboundedPreceding, -1)
    made = met.select("user_id", "_t", F.coalesce(F.sum("_fresh").over(before), F.lit(0)).alias("_made"))
    keep = F.least(F.col("_fresh"), F.col("_left") - F.col("_made"))
    drawn = materialise(met.join(made, ["user_id", "_t"]).withColumn("_keep", keep).filter("_keep > 0").select(
        "user_id", "_block", "_a", "_b", "_gone", "_keep"))
    tasks = tasks_for(drawn, drawn.agg(F.sum("_keep")).first()[0] or 0)
    salts = math.ceil(8 * tasks * BLOCK / size_n)  # starts are even over the catalog, so no block is hotter than others
    dealt = spread_rows(drawn.withColumn("_salt", F.pmod(F.xxhash64("user_id", "_a"), F.lit(salts)).cast("int")), "_block", "_salt", tasks=tasks)
    blocks = numbered.groupBy(F.floor(F.col("_no") / BLOCK).alias("_block")).agg(
        F.sort_array(F.collect_list(F.struct("_no", "item_id"))).alias("l")).select(
        "_block", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt"), F.col("l.item_id").alias("_items"))
    draws = F.slice(F.array_except(F.sequence("_a", F.col("_b") - 1), "_gone"), F.lit(1), F.col("_keep").cast("int"))
    items = F.transform(draws, lambda x: F.get("_items", (x - F.col("_block") * BLOCK).cast("int")))
    return dealt.join(blocks, ["_block", "_salt"]).select(
        "user_id", F.explode(items).alias("item_id"), F.lit(0.0).alias("label"))


def training_samples(ratings: DataFrame, catalog: DataFrame, ratio: int = 4, seed: int = 42) -> DataFrame:
    positives = ratings.select("user_id", "item_id", (F.col("rating") / 5).alias("label"))
    return positives.unionByName(negative_samples(ratings, catalog, ratio, seed))


def uniform_key(*ids: str, seed: int) -> Column:
    """Number in (0, 1] from the digest of ids."""
    head = F.conv(F.substring(digest(*ids, seed=seed), 1, 12), 16, 10).cast("double")
    return (head + 1) / float(16**12)


def weighted_sample(candidates: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """k items per user without replacement, probability proportional to ``weight``, by the largest ``ln(u) / w``.

    ``candidates`` is (user_id, item_id, weight). Map tasks keep k rows per user before the shuffle.
    """
    w = F.greatest(F.col("weight"), F.lit(0.001))
    keyed = candidates.withColumn("key", F.log(uniform_key("user_id", "item_id", seed=seed)) / w)
    return top_k(keyed, ["user_id"], [F.col("key").desc(), F.col("item_id").asc()], k)
