"""Connected components by alternating stars; nothing is gathered, hubs are reduced by partial sums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.session import materialise


def connected(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Smallest reachable node for every node that has an edge.

    ``edges``: two columns ``a``, ``b`` of one orderable type. Returns ``node``, ``label`` with one row per node that
    occurs; nodes without edges don't occur. Loops, repeated and reversed edges and nulls on either side are ignored.
    Each round hangs a node's larger neighbours on its smallest one, then the smaller ones; the number of rounds grows
    with the logarithm of the longest chain. An edge table is checkpointed after every round.
    """
    now = materialise(_oriented(edges.select("a", "b").dropna()))
    seen = None
    for _ in range(rounds):
        state = _digest(now)
        if state == seen:
            break
        seen = state
        now = materialise(_small_star(_large_star(now)))
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())


def _oriented(edges: DataFrame) -> DataFrame:
    """Larger node first, each edge once."""
    return edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return _oriented(both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")))


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return _oriented(moved.unionByName(least.select("a", F.col("m").alias("b"))))
