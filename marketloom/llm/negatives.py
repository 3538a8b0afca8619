"""Hard-negative mining by a vertical scan (BOND) with exact score windows.

Vectors are dealt to blocks; a block stores its vectors by dimension. For one anchor the dimensions are read in the order
of the anchor's descending magnitude. After each step the part of the score that is still missing lies between the sums of
the smallest and largest contributions that the remaining dimensions can make in this block, so every candidate has an
interval. Candidates whose interval can't meet a score window any more, or that are surely behind k others in it, leave the
bitmap, until the last dimension resolves the rest exactly.

Two passes use the same scan: the best rows of the anchor's own label (one open window), then, for every positive score
found, the best rows of other labels in the window below it. A cell of the grid holds one block and one part of the anchors
and returns at most k rows for each anchor and window; the best k of all blocks follow from a ranked merge.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketloom.llm.common import stage

BLOCK = 8192  # vectors of a cell
ANCHORS = 16384  # anchors of a cell
STEP = 8  # dimensions read between two looks at the bitmap
EXACT = float(1 << 45)  # below it, scores and a hundred times a score are exact doubles
LARGEST = (1 << 63) - 1


def prepared(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
             factor: int = 256) -> DataFrame:
    """``id``, ``label``, ``v``: every component x becomes floor(factor * x), computed in double precision.

    Rows with a null id, label or vector, or with a null or non-finite component take no part; repeated rows stay.
    """
    v = F.col("v").cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"),
                          F.col(vector_col).alias("v")).dropna()
    return kept.filter(finite).select(
        "id", "label", F.transform(v, lambda x: F.floor(x * F.lit(float(factor))).cast("double")).alias("v"))


def scan(query: np.ndarray, columns: np.ndarray, low: np.ndarray, high: np.ndarray, rows: np.ndarray,
         windows: list[tuple], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Rows and scores of the best ``k`` of ``rows`` (ascending by id) in each score window (ends included).

    ``columns``: dimensions x vectors; ``low``, ``high``: least and greatest value of each dimension in the block.
    """
    order = np.argsort(-np.abs(query), kind="stable")
    ends = np.stack([query * low, query * high])[:, order]
    least, most = ends.min(axis=0), ends.max(axis=0)
    scores = np.zeros(len(rows), columns.dtype)
    for at in range(0, len(order), STEP):
        part = order[at: at + STEP]
        scores = scores + query[part] @ columns[part][:, rows]
        if at + STEP >= len(order) or len(rows) <= k:
            continue
        floor, ceiling = scores + least[at + STEP:].sum(), scores + most[at + STEP:].sum()
        live = np.zeros(len(rows), bool)
        for lo, hi in windows:
            meets = (ceiling >= lo) & (floor <= hi)
            inside = floor[(floor >= lo) & (ceiling <= hi)]
            if len(inside) >= k:  # these are in the window for certain; what stays below k of them is not wanted
                meets &= ceiling >= np.partition(inside, len(inside) - k)[len(inside) - k]
            live |= meets
        rows, scores = rows[live], scores[live]
    out = []
    for lo, hi in windows:
        at = np.flatnonzero((scores >= lo) & (scores <= hi))
        at = at[np.lexsort((rows[at], -scores[at]))[:k]]
        out.append((rows[at], scores[at]))
    return out


def _columns(values: pa.ChunkedArray, size: int) -> np.ndarray:
    flat = values.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return np.ascontiguousarray(flat.reshape(len(values), size).T)


def _whole(m: np.ndarray) -> np.ndarray:
    """Python integers, for values beyond exact doubles."""
    return np.array([[int(x) for x in row] for row in m], object).reshape(m.shape)


def _cell(k: int, same: bool):
    """Arrow function over one block and one part of the anchors."""
    schema = pa.schema([("anchor", pa.int64()), ("positive_score", pa.int64()), ("id", pa.int64()), ("score", pa.int64())])

    def search(asked: pa.Table, block: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if asked.num_rows and block.num_rows:
            size = asked["size"][0].as_py()
            block = block.take(pa.array(np.argsort(block["id"].to_numpy(), kind="stable")))
            ids, labels, columns = block["id"].to_numpy(), block["label"].to_numpy(), _columns(block["v"], size)
            queries = _columns(asked["v"], size).T
            if size * np.abs(queries).max(initial=0) * np.abs(columns).max(initial=0) >= EXACT:
                queries, columns = _whole(queries), _whole(columns)
            low, high = columns.min(axis=1), columns.max(axis=1)
            of_label = {x: np.flatnonzero((labels == x) if same else (labels != x)) for x in set(asked["label"].to_pylist())}
            for anchor, own, label, query, tops in zip(*(asked[c].to_pylist() for c in ("anchor", "id", "label")), queries,
                                                       asked["tops"].to_pylist()):
                rows = of_label[label]
                rows = rows[ids[rows] != own]
                limits = [(-np.inf, np.inf)] if same else [(-(-80 * t // 100), t) for t in tops]
                for top, (found, scores) in zip(tops, scan(query, columns, low, high, rows, limits, k)):
                    out += [(anchor, top, int(i), int(min(max(s, -LARGEST), LARGEST))) for i, s in zip(ids[found], scores)]
        columns_out = list(zip(*out)) or [()] * 4
        return pa.table([pa.array(c, f.type) for c, f in zip(columns_out, schema)], schema=schema)

    return search


def _best(asked: DataFrame, points: DataFrame, k: int, same: bool) -> DataFrame:
    """``anchor``, ``positive_score``, ``rank``, ``id``, ``score``: the first k of each anchor and window.

    ``asked``: ``anchor``, ``id``, ``label``, ``v``, ``tops`` (upper ends of the windows; one null for the open one).
    """
    n_points, n_asked = points.count(), asked.count()
    blocks, parts = -(-n_points // BLOCK) or 1, -(-n_asked // ANCHORS) or 1
    cell = ["size", "block", "part"]
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    left = asked.withColumns({"size": F.size("v"), "part": F.pmod(F.xxhash64("anchor"), F.lit(parts))}).withColumn(
        "block", every(blocks)).select(*cell, "anchor", "id", "label", "v", "tops")
    right = points.withColumns({"size": F.size("v"), "block": F.pmod(F.xxhash64("id", "copy"), F.lit(blocks))}).withColumn(
        "part", every(parts)).select(*cell, "id", "label", "v")
    found = left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInArrow(
        _cell(k, same), "anchor long, positive_score long, id long, score long")
    order = Window.partitionBy("anchor", "positive_score").orderBy(F.col("score").desc(), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def hard_negatives(vectors: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 5) -> DataFrame:
    """``anchor_id``, ``positive_id``, ``rank``, ``negative_id``, ``positive_score``, ``negative_score``.

    Both tables: ``id``, ``label``, ``v`` (whole numbers as doubles), as made by ``prepared``. An anchor's positives are
    its first ``positives`` rows of the same label by inner product, and each gets the first ``negatives`` rows of other
    labels whose score lies between 80 percent of the positive's score and that score; ties go to the smaller id. Rows with
    the anchor's id are no candidates of it. Ids may repeat: every row is a candidate (of equal rows as many as a list has
    places), rows that repeat an anchor's id with another vector or label are anchors of their own, equal ones are one
    anchor. Vectors are compared with vectors of their own length. Positives without such negatives have no rows; empty
    tables give none. Scores are exact; beyond 64 bits they stop at the largest long.
    """
    most = max(positives, negatives)
    counted = vectors.groupBy("id", "label", "v").agg(F.least(F.count(F.lit(1)), F.lit(most)).cast("int").alias("n"))
    points = stage(counted.withColumn("copy", F.explode(F.sequence(F.lit(1), "n"))).drop("n"), "points")
    asked = stage(anchors.distinct().withColumn("anchor", F.monotonically_increasing_id()), "anchors")
    first = stage(_best(asked.withColumn("tops", F.array(F.lit(None).cast("long"))), points, positives, True).select(
        "anchor", F.col("rank").alias("place"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")),
        "positives")
    tops = first.groupBy("anchor").agg(F.sort_array(F.collect_set("positive_score")).alias("tops"))  # ``positives`` at most
    found = _best(asked.join(tops, "anchor"), points, negatives, False)
    return first.join(found, ["anchor", "positive_score"]).join(
        asked.select("anchor", F.col("id").alias("anchor_id")), "anchor").select(
        "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score",
        F.col("score").alias("negative_score"))
