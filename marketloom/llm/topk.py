"""Exact top-k inner product search by the threshold algorithm over sorted per-dimension lists.

Vectors are dealt to blocks of bounded size; every block keeps one list per dimension, sorted by component. A query walks
all lists of a block in step: from the top where its own component is positive, from the bottom where it is negative.
Every vector met is scored in full, and the walk ends when the bound (the query's inner product with the components at
the present depth, which no unseen vector can exceed) is below the k-th best score. Equality goes on, because an unseen
vector with the same score and a smaller id would win.

The work is a grid of candidate blocks and query blocks; a cell holds both blocks and returns at most k rows for each of
its queries, and the best k of all blocks follow from a ranked merge. Nothing is broadcast and no row is dropped.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CANDIDATES = 8192  # vectors of a cell
QUERIES = 1024
FIRST_DEPTH = 16
EXACT = float(1 << 53)


def scaled(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", factor: int = 1024,
           unique: bool = True) -> DataFrame:
    """``id`` and ``v``: every component x becomes floor(factor * x), computed in double precision.

    Rows with a null id, a null vector, or a null or non-finite component take no part. Of rows that repeat an id the
    smallest vector stays; without ``unique`` every row stays.
    """
    v = F.col("v").cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).filter(
        F.col("id").isNotNull() & F.col("v").isNotNull() & finite)
    whole = kept.select("id", F.transform(v, lambda x: F.floor(x * F.lit(float(factor))).cast("double")).alias("v"))
    return whole.groupBy("id").agg(F.min("v").alias("v")) if unique else whole


def walk(query: np.ndarray, points: np.ndarray, order: np.ndarray, k: int, own: int,
         copies: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Rows and scores of the best k points for one query; ``order`` holds one ascending list per dimension (column),
    rows of ``points`` ascend by id, ``own`` is the first of the ``copies`` rows with the query's id or -1."""
    n = len(points)
    live = np.flatnonzero(query)
    down = query[live] > 0
    seen = np.zeros(n, bool)
    if own >= 0:
        seen[own: own + copies] = True
    best, scores = np.empty(0, np.int64), np.empty(0, points.dtype)
    at, depth = 0, FIRST_DEPTH
    while at < n:
        end = min(depth, n) if len(live) else n
        met = ~seen if end == n else np.zeros(n, bool)
        met[order[n - end: n - at, live[down]]] = True
        met[order[at:end, live[~down]]] = True
        rows = np.flatnonzero(met & ~seen)
        seen[rows] = True
        best, scores = np.concatenate([best, rows]), np.concatenate([scores, points[rows] @ query])
        if len(best) >= k:
            top = np.lexsort((best, -scores))[:k]
            best, scores = best[top], scores[top]
        at, depth = end, end * 2
        if seen.all():
            break
        if len(best) >= k:
            edge = np.where(down, order[n - at, live], order[at - 1, live])
            if points[edge, live] @ query[live] < scores[-1]:
                break
    top = np.lexsort((best, -scores))[:k]
    return best[top], scores[top]


def _matrix(table: pa.Table, size: int) -> tuple[np.ndarray, np.ndarray]:
    ids = table["id"].to_numpy()
    values = table["v"].combine_chunks().flatten().to_numpy().reshape(len(ids), size)
    order = np.argsort(ids, kind="stable")
    return ids[order], values[order]


def _cell(k: int):
    def search(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        out = [np.empty(0, np.int64) for _ in range(3)]
        if queries.num_rows and candidates.num_rows:
            size = queries["size"][0].as_py()
            (q_ids, q), (c_ids, c) = _matrix(queries, size), _matrix(candidates, size)
            if size * np.abs(q).max(initial=0) * np.abs(c).max(initial=0) >= EXACT:  # beyond exact doubles
                q, c = (np.array([[int(x) for x in row] for row in m], object).reshape(m.shape) for m in (q, c))
            order = np.argsort(c, axis=0, kind="stable")
            place = np.searchsorted(c_ids, q_ids)
            own = np.where((place < len(c_ids)) & (c_ids[np.minimum(place, len(c_ids) - 1)] == q_ids), place, -1)
            copies = np.searchsorted(c_ids, q_ids, side="right") - place
            found = [(i, *walk(v, c, order, k, o, m)) for i, v, o, m in zip(q_ids, q, own, copies)]
            limit = (1 << 63) - 1
            scores = [int(min(max(s, -limit), limit)) for _, _, x in found for s in x]
            out = [np.repeat(q_ids, [len(rows) for _, rows, _ in found]),
                   c_ids[np.concatenate([rows for _, rows, _ in found])], np.array(scores, np.int64)]
        return pa.table(dict(zip(("query_id", "vec_id", "score"), map(pa.array, out))))

    return search


def nearest(points: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id``, ``score``: the k points of highest integer inner product.

    ``points``, ``queries``: ``id``, ``v`` (whole numbers as doubles), as made by ``scaled``. Ids may repeat: every row is a
    point, and the lists of query rows with one id are merged and ranked together. Of equal rows k are enough on either
    side, as no list has more places, so a hot row stays bounded. A point with the query's id is not a candidate of it; ties go to the smaller id; fewer than k candidates are all returned. Vectors are
    compared with vectors of their own length only. Scores are exact; beyond 64 bits they stop at the largest long. Empty
    tables give no rows.
    """
    def bounded(rows: DataFrame) -> DataFrame:
        counted = rows.groupBy("id", "v").agg(F.least(F.count(F.lit(1)), F.lit(k)).cast("int").alias("n"))
        return counted.withColumn("copy", F.explode(F.sequence(F.lit(1), "n"))).drop("n")

    points, queries = bounded(points), bounded(queries)
    sized = points.withColumn("size", F.size("v"))
    asked = queries.withColumn("size", F.size("v"))
    n_points, n_asked = points.count(), queries.count()
    blocks, parts = -(-n_points // CANDIDATES) or 1, -(-n_asked // QUERIES) or 1
    cells = ["size", "block", "part"]
    left = asked.withColumn("part", F.pmod(F.xxhash64("id", "v", "copy"), F.lit(parts))).withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select(*cells[:1], F.col("block").cast("long"), "part", "id", "v")
    right = sized.withColumn("block", F.pmod(F.xxhash64("id", "v", "copy"), F.lit(blocks))).withColumn(
        "part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).select(*cells[:1], "block", F.col("part").cast("long"), "id", "v")
    found = left.groupBy(*cells).cogroup(right.groupBy(*cells)).applyInArrow(
        _cell(k), "query_id long, vec_id long, score long")
    ranked = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
