"""Dense scoring on a grid of bounded blocks.

Rows are hashed into blocks of about ``block`` entities. A cell is one pair of blocks, so a task never sees more than
two blocks of vectors plus the sparse entries of that cell (at most block x block). Cells multiply with numpy and emit
only what is asked for: the best k per row, or the pairs inside a value range. Nothing else is shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketloom.operators.scale import SCORE_DIGITS, block_count, block_of, salted_join, stored_side, top_scored
from marketloom.session import materialise


TILE = 4_000_000  # similarities of a cell held at once where pairs in a range are sought


@dataclass(frozen=True)
class VectorTable:
    """One row per id: unit-length numeric columns ``dense`` and categorical columns compared for equality.

    Similarity of two rows is ``dense_weight * dot + match_weight * (share of equal categorical columns)``.
    """

    df: DataFrame
    id: str
    dense: list[str]
    match: list[str] = field(default_factory=list)
    dense_weight: float = 1.0
    match_weight: float = 0.0

    def where_in(self, ids: DataFrame) -> "VectorTable":
        keep = self.df.join(stored_side(ids.select(self.id).distinct())[0], self.id, "left_semi")
        return VectorTable(keep, self.id, self.dense, self.match, self.dense_weight, self.match_weight)

    def materialised(self) -> "VectorTable":
        return VectorTable(materialise(self.df), self.id, self.dense, self.match, self.dense_weight, self.match_weight)

    def similarity(self, left: str, right: str) -> Column:
        """Similarity of the rows whose columns bear the prefixes ``left`` and ``right``."""
        total = F.lit(0.0)
        for c in self.dense:
            total = total + F.col(f"{left}{c}") * F.col(f"{right}{c}") * self.dense_weight
        for c in self.match:
            total = total + F.when(F.col(f"{left}{c}") == F.col(f"{right}{c}"), self.match_weight / len(self.match)).otherwise(0.0)
        return total

    def packed(self) -> DataFrame:
        return self.df.select(
            F.col(self.id).alias("id"),
            F.array(*[F.col(c).cast("double") for c in self.dense]).alias("vals"),
            F.array(*[F.col(c).cast("string") for c in self.match]).cast("array<string>").alias("tags"),
        )


def unit_rows(df: DataFrame, cols: list[str]) -> DataFrame:
    """Scale the numeric columns of each row to length one; a zero row stays zero."""
    norm = F.sqrt(sum((F.col(c) * F.col(c) for c in cols[1:]), F.col(cols[0]) * F.col(cols[0])))
    return df.withColumn("_norm", norm).select(
        *[c for c in df.columns if c not in cols],
        *[F.when(F.col("_norm") > 0, F.col(c) / F.col("_norm")).otherwise(0.0).alias(c) for c in cols],
    )


def _matrix(frame: pd.DataFrame, width: int) -> np.ndarray:
    return np.array(frame["vals"].tolist(), dtype=np.float64).reshape(len(frame), width)


def _match_share(left: pd.DataFrame, right: pd.DataFrame, n: int) -> np.ndarray:
    out = np.zeros((len(left), len(right)))
    lt = np.array(left["tags"].tolist(), dtype=object).reshape(len(left), n)
    rt = np.array(right["tags"].tolist(), dtype=object).reshape(len(right), n)
    for c in range(n):
        codes, _ = pd.factorize(np.concatenate([lt[:, c], rt[:, c]]))
        a, b = codes[: len(left)], codes[len(left):]
        out += (a[:, None] == b[None, :]) & (a[:, None] >= 0)
    return out / n


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column indexes of the k best finite scores per row, ties to the smaller id.

    Everything at or above the row's k-th score is kept before the tie is broken, so ties at the cut are decided by id.
    """
    rounded = np.round(scores, SCORE_DIGITS)
    if k < rounded.shape[1]:
        cut = np.partition(rounded, rounded.shape[1] - k, axis=1)[:, rounded.shape[1] - k]
        rows, cols = np.nonzero((rounded >= cut[:, None]) & np.isfinite(scores))
    else:
        rows, cols = np.nonzero(np.isfinite(scores))
    place = np.argsort(np.argsort(ids, kind="stable"), kind="stable")
    order = np.lexsort((place[cols], -rounded[rows, cols], rows))
    rows, cols = rows[order], cols[order]
    starts = np.searchsorted(rows, rows, side="left")
    keep = np.arange(len(rows)) - starts < k
    return rows[keep], cols[keep]


def _both_sides(table: VectorTable, blocks: Column) -> DataFrame:
    """Each row once per cell of its block: as left side of the later blocks, as right side of the earlier ones."""
    rows = table.packed().withColumn("_b", block_of(F.col("id"), blocks))
    left = rows.select(
        F.col("_b").alias("a"), F.explode(F.sequence(F.col("_b"), blocks - 1)).alias("b"),
        F.lit(0).alias("side"), "id", "vals", "tags")
    right = rows.select(
        F.explode(F.sequence(F.lit(0), F.col("_b"))).alias("a"), F.col("_b").alias("b"),
        F.lit(1).alias("side"), "id", "vals", "tags")
    return left.unionByName(right)


def pair_grid(
    table: VectorTable,
    *,
    k: int | None = None,
    low: float | None = None,
    high: float | None = None,
    extra: DataFrame | None = None,
    scale: float = 1.0,
    block: int = 2048,
) -> DataFrame:
    """Similarities of all row pairs, reduced inside the cells.

    With ``k``: ordered rows ``(i, j, sim, rank)``, the k best neighbours of every i. Otherwise unordered rows
    ``(i, j, sim)`` with ``low < sim <= high``. ``extra`` holds sparse ``(i, j, value)`` with i < j that is added to
    ``scale * similarity``.
    """
    blocks = block_count(table.df, block)
    id_type = table.df.schema[table.id].dataType
    rows = _both_sides(table, blocks).select(
        "a", "b", "side", "id", F.lit(None).cast(id_type).alias("other"), "vals", "tags")
    if extra is not None:
        bi, bj = block_of(F.col("i"), blocks), block_of(F.col("j"), blocks)
        flip = bi > bj
        sparse = extra.select(
            F.least(bi, bj).alias("a"), F.greatest(bi, bj).alias("b"), F.lit(2).alias("side"),
            F.when(flip, F.col("j")).otherwise(F.col("i")).alias("id"),
            F.when(flip, F.col("i")).otherwise(F.col("j")).alias("other"),
            F.array(F.col("value")).alias("vals"), F.array().cast("array<string>").alias("tags"),
        )
        rows = rows.unionByName(sparse)
    width, n_match, wd, wm = len(table.dense), len(table.match), table.dense_weight, table.match_weight

    def cell(frame: pd.DataFrame) -> pd.DataFrame:
        left, right = frame[frame.side == 0], frame[frame.side == 1]
        if left.empty or right.empty:
            return pd.DataFrame({"i": [], "j": [], "sim": []})
        if k is None and len(left) > 1 and len(left) * len(right) > 2 * TILE:  # pairs in a range need no whole rows of the other side
            step, rest = max(1, TILE // len(right)), frame[frame.side > 0]
            return pd.concat([cell(pd.concat([left.iloc[at: at + step], rest])) for at in range(0, len(left), step)], ignore_index=True)
        sim = wd * (_matrix(left, width) @ _matrix(right, width).T)
        if n_match:
            sim += wm * _match_share(left, right, n_match)
        sim *= scale
        lid, rid = left["id"].to_numpy(), right["id"].to_numpy()
        same_block = frame["a"].iloc[0] == frame["b"].iloc[0]
        sparse = frame[frame.side == 2]
        if len(sparse):
            lpos, rpos = pd.Index(lid), pd.Index(rid)
            value = sparse["vals"].str[0].to_numpy(dtype=np.float64)
            x, y = lpos.get_indexer(sparse["id"]), rpos.get_indexer(sparse["other"])
            ok = (x >= 0) & (y >= 0)
            sim[x[ok], y[ok]] += value[ok]
            if same_block:
                x, y = lpos.get_indexer(sparse["other"]), rpos.get_indexer(sparse["id"])
                ok = (x >= 0) & (y >= 0)
                sim[x[ok], y[ok]] += value[ok]
        if same_block:
            sim[lid[:, None] == rid[None, :]] = -np.inf
        if k is not None:
            r, c = _best(sim, rid, k)
            out = [pd.DataFrame({"i": lid[r], "j": rid[c], "sim": sim[r, c]})]
            if not same_block:
                r, c = _best(sim.T, lid, k)
                out.append(pd.DataFrame({"i": rid[r], "j": lid[c], "sim": sim.T[r, c]}))
            return pd.concat(out, ignore_index=True)
        keep = np.isfinite(sim)
        if low is not None:
            keep &= sim > low
        if high is not None:
            keep &= sim <= high
        if same_block:
            keep &= lid[:, None] < rid[None, :]
        r, c = np.nonzero(keep)
        a, b = lid[r], rid[c]
        return pd.DataFrame({"i": np.where(a < b, a, b), "j": np.where(a < b, b, a), "sim": sim[r, c]})

    schema = T.StructType([
        T.StructField("i", id_type), T.StructField("j", id_type), T.StructField("sim", T.DoubleType())])
    pairs = rows.groupBy("a", "b").applyInPandas(cell, schema)
    return top_scored(pairs, ["i"], "sim", "j", k) if k is not None else pairs


def user_grid(
    ratings: DataFrame,
    table: VectorTable,
    sums: DataFrame,
    *,
    n: int,
    scale: float,
    min_weight: float,
    user_block: int = 1024,
    item_block: int = 4096,
) -> DataFrame:
    """Best ``n`` unseen items per user for ``score = sum(s * r) / sum(s)`` with ``s = sparse + scale * similarity``.

    The similarity part is linear in the rated items' vectors, so each user is summarised once (weighted and plain
    vector sums, per-tag rating sums) and scored against item blocks; no user x item or item x item table is made.
    ``sums`` carries the sparse part: ``(user_id, item_id, num, den, seen)``. Ratings that lie together by user are
    summarised where they lie, as long as the vectors fit a broadcast.
    """
    spark_types = {f.name: f.dataType for f in ratings.schema}
    user_t, item_t = spark_types["user_id"], spark_types["item_id"]
    item_blocks = block_count(table.df, item_block)
    users = ratings.select("user_id").distinct()
    user_blocks = block_count(users, user_block)
    vec, small = stored_side(table.df.withColumnRenamed(table.id, "item_id"))
    mine = ratings.select("user_id", "item_id", "rating")
    rated = mine.join(vec, "item_id") if small else salted_join(mine, vec, ["item_id"])
    d = table.dense
    dense = rated.groupBy("user_id").agg(
        *[F.sum(F.col("rating") * F.col(c)).alias(f"p{i}") for i, c in enumerate(d)],
        *[F.sum(c).alias(f"q{i}") for i, c in enumerate(d)],
    ).select(
        "user_id", F.lit(0).alias("tag"), F.lit(None).cast("string").alias("label"),
        F.array(*[f"p{i}" for i in range(len(d))], *[f"q{i}" for i in range(len(d))]).alias("vals"),
    )
    profile = dense
    if table.match:
        labels = F.explode(F.array(*[
            F.concat(F.lit(f"{i}="), F.col(c).cast("string")) for i, c in enumerate(table.match)]))
        tagged = (
            rated.select("user_id", "rating", labels.alias("label"))
            .filter(F.col("label").isNotNull())
            .groupBy("user_id", "label")
            .agg(F.sum("rating").alias("r"), F.count(F.lit(1)).cast("double").alias("c"))
            .select("user_id", F.lit(1).alias("tag"), "label", F.array("r", "c").alias("vals"))
        )
        profile = dense.unionByName(tagged)
    no_tags = F.array().cast("array<string>")
    user_rows = profile.select(
        block_of(F.col("user_id"), user_blocks).alias("a"),
        F.explode(F.sequence(F.lit(0), item_blocks - 1)).alias("b"),
        "tag", "user_id", F.lit(None).cast(item_t).alias("item_id"), "label", "vals", no_tags.alias("tags"),
    )
    item_rows = table.packed().select(
        F.explode(F.sequence(F.lit(0), user_blocks - 1)).alias("a"),
        block_of(F.col("id"), item_blocks).alias("b"),
        F.lit(2).alias("tag"), F.lit(None).cast(user_t).alias("user_id"), F.col("id").alias("item_id"),
        F.lit(None).cast("string").alias("label"), "vals", "tags",
    )
    new = F.col("seen") == 0  # sums of a rated item are not read
    sparse_rows = sums.select(
        block_of(F.col("user_id"), user_blocks).alias("a"),
        block_of(F.col("item_id"), item_blocks).alias("b"),
        F.lit(3).alias("tag"), "user_id", "item_id", F.lit(None).cast("string").alias("label"),
        F.array(F.when(new, F.col("num")).otherwise(0.0), F.when(new, F.col("den")).otherwise(0.0),
                F.col("seen").cast("double")).alias("vals"), no_tags.alias("tags"),
    )
    width, n_match, wd, wm = len(d), len(table.match), table.dense_weight, table.match_weight

    def cell(frame: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"user_id": [], "item_id": [], "score": []})
        people, items = frame[frame.tag == 0], frame[frame.tag == 2]
        if people.empty or items.empty:
            return empty
        uid, iid = people["user_id"].to_numpy(), items["item_id"].to_numpy()
        upos, ipos = pd.Index(uid), pd.Index(iid)
        pq = _matrix(people, 2 * width)
        f = _matrix(items, width)
        num = wd * (pq[:, :width] @ f.T)
        den = wd * (pq[:, width:] @ f.T)
        tagged = frame[frame.tag == 1]
        if n_match and len(tagged):
            tags = np.array(items["tags"].tolist(), dtype=object).reshape(len(items), n_match)
            cols = pd.Index(tagged["label"].unique())
            r = np.zeros((len(uid), len(cols) + 1))
            c = np.zeros_like(r)
            values = _matrix(tagged, 2)
            where = (upos.get_indexer(tagged["user_id"]), cols.get_indexer(tagged["label"]))
            r[where], c[where] = values[:, 0], values[:, 1]
            for m in range(n_match):
                at = cols.get_indexer([None if t is None else f"{m}={t}" for t in tags[:, m]])
                at[at < 0] = len(cols)
                num += wm / n_match * r[:, at]
                den += wm / n_match * c[:, at]
        num *= scale
        den *= scale
        sparse = frame[frame.tag == 3]
        if len(sparse):
            x, y = upos.get_indexer(sparse["user_id"]), ipos.get_indexer(sparse["item_id"])
            ok = (x >= 0) & (y >= 0)
            values = _matrix(sparse, 3)[ok]
            num[x[ok], y[ok]] += values[:, 0]
            den[x[ok], y[ok]] += values[:, 1]
            seen = values[:, 2] > 0
            den[x[ok][seen], y[ok][seen]] = 0.0
        valid = den > min_weight
        score = np.where(valid, num / np.where(valid, den, 1.0), -np.inf)
        r, c = _best(score, iid, n)
        return pd.DataFrame({"user_id": uid[r], "item_id": iid[c], "score": score[r, c]})

    schema = T.StructType([
        T.StructField("user_id", user_t), T.StructField("item_id", item_t), T.StructField("score", T.DoubleType())])
    scored = (
        user_rows.unionByName(item_rows).unionByName(sparse_rows).groupBy("a", "b").applyInPandas(cell, schema)
    )
    return top_scored(scored, ["user_id"], "score", "item_id", n)
