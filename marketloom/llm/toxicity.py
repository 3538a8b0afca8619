"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A feature is the presence of a hashed n-gram of the lower-cased text. Its scale is the log ratio of the shares of toxic and
other texts that have it, smoothed by the classes' own shares, so that a gram nobody has seen counts nothing. Grams seen
too rarely or with a ratio near zero are left out; a logistic regression is fitted on the scaled rest. The fit takes a
bounded sample of the labelled rows, drawn by a hash of the id and stored once; scoring reads every text whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketloom.llm.common import release_memory, stage, text_slices, worker_cache
from marketloom.llm.wordhash import mixed

ORDERS = (3, 4, 5)
BITS = 20
MAX_ROWS = 40_000  # labelled rows of the fit (expected number of a hash sample)
MIN_COUNT = 5
MIN_RATIO = 1.0
SMOOTHING = 1.0
VECTOR_ROWS = 256  # rows of one Arrow batch of sparse vectors


def grams(text: str) -> np.ndarray:
    """Buckets of all character n-grams of one text, repeats included; every word is bordered by single spaces."""
    plain = f" {' '.join(text.lower().split())} "
    chars = np.frombuffer(plain.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    out, h = [], chars
    for n in range(2, max(ORDERS) + 1):
        if len(chars) < n:
            break
        h = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + chars[n - 1:]
        if n in ORDERS:
            out.append((mixed(h) >> np.uint64(64 - BITS)).astype(np.int32))
    return np.concatenate(out) if out else np.empty(0, np.int32)


@dataclass(frozen=True)
class ToxicModel:
    """Weights (regression weight times log-count ratio) of the buckets that count, and the intercept."""

    buckets: np.ndarray
    weights: np.ndarray
    intercept: float

    def score(self, text: Column) -> Column:
        """Probability of the toxic class, 0 to 1; null and empty texts get the intercept's."""
        model = self

        @F.arrow_udf("double")
        def scored(texts: pa.Array) -> pa.Array:
            worker_cache("toxicity")  # drops what other operators left in this worker
            table = np.zeros(1 << BITS, np.float32)
            table[model.buckets] = model.weights
            out = []
            for t in text_slices(texts):
                found = grams(t or "")
                hit = np.unique(found[table[found] != 0])
                out.append(model.intercept + float(table[hit].sum(dtype=np.float64)))
            release_memory()
            return pa.array(1 / (1 + np.exp(-np.clip(np.array(out, np.float64), -500, 500))))

        return scored(text.cast("string"))


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    """crc32 of the id as text leaves remainder ``part``; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == part, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
        max_rows: int = MAX_ROWS) -> ToxicModel:
    """Fit on the rows of ``labels`` (``id_col``, ``label_col`` 0 or 1) whose id occurs in ``docs``.

    Null ids, labels and texts are skipped; a document with several labels counts as toxic if one of them says so. Of more
    than ``max_rows`` labelled ids a hash sample of about that size is used, small enough to be broadcast. With no
    labels of one class the model has no features and scores the (smoothed) share of the toxic class.
    """
    label = F.col(label_col).cast("int")
    known = labels.filter(F.col(id_col).isNotNull() & label.isin(0, 1)).groupBy(
        F.col(id_col).alias("_loom_id")).agg(F.max(label).alias("toxic"))
    share = min(1.0, max_rows / max(1, known.count()))
    sample = known.filter(F.pmod(F.xxhash64("_loom_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    texts = stage(docs.select(F.col(id_col).alias("_loom_id"), F.col(text_col).cast("string").alias("text")).join(
        F.broadcast(sample), "_loom_id").filter("text is not null").select("text", "toxic"), "toxic-sample")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("toxicity")
        seen, rows = np.zeros((2, 1 << BITS), np.int64), [0, 0]
        for batch in batches:
            for text, toxic in zip(text_slices(batch["text"]), batch["toxic"].to_pylist()):
                seen[toxic, np.unique(grams(text))] += 1
                rows[toxic] += 1
        used = np.flatnonzero(seen.any(axis=0))
        columns = [np.append(used, -1), np.append(seen[0, used], rows[0]), np.append(seen[1, used], rows[1])]
        release_memory()
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["bucket", "n0", "n1"])

    counts = texts.mapInArrow(count, "bucket long, n0 long, n1 long").groupBy("bucket").agg(
        F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    frame = counts.filter((F.col("n0") + F.col("n1") >= MIN_COUNT) | (F.col("bucket") < 0)).toArrow()  # 2^BITS rows at most
    bucket, n0, n1 = (frame[c].to_numpy() for c in ("bucket", "n0", "n1"))
    total = bucket < 0
    rows0, rows1 = int(n0[total].sum()), int(n1[total].sum())
    prior = float(np.log((rows1 + 0.5) / (rows0 + 1.5)))
    rows = rows0 + rows1
    if not rows0 or not rows1:
        return ToxicModel(np.empty(0, np.int64), np.empty(0, np.float32), min(prior, -1e-9) if not rows1 else prior)
    ratio = np.log((n1 + SMOOTHING * rows1 / rows) / rows1) - np.log((n0 + SMOOTHING * rows0 / rows) / rows0)
    used = ~total & (np.abs(ratio) >= MIN_RATIO)
    bucket, ratio = bucket[used], ratio[used]
    order = np.argsort(bucket)
    bucket, ratio = bucket[order], ratio[order]
    if not len(bucket):
        return ToxicModel(bucket, ratio.astype(np.float32), prior)
    weights, intercept = _regression(texts, bucket, ratio)
    return ToxicModel(bucket, (weights * ratio).astype(np.float32), intercept)


def _regression(texts: DataFrame, bucket: np.ndarray, ratio: np.ndarray) -> tuple[np.ndarray, float]:
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.linalg import VectorUDT

    size = len(bucket)

    kind = pa.struct([
        ("type", pa.int8()), ("size", pa.int32()), ("indices", pa.list_(pa.int32())), ("values", pa.list_(pa.float64()))])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = np.full(1 << BITS, -1, np.int32)
        places[bucket] = np.arange(size)
        for whole in batches:
            for start in range(0, whole.num_rows, VECTOR_ROWS):
                batch = whole.slice(start, VECTOR_ROWS)
                found = [np.unique(places[grams(t)]) for t in batch["text"].to_pylist()]
                found = [at[at >= 0] for at in found]
                ends = pa.array(np.cumsum([0, *map(len, found)]), pa.int32())
                at = np.concatenate(found)
                vectors = pa.StructArray.from_arrays([
                    pa.array(np.zeros(len(found)), pa.int8()), pa.array(np.full(len(found), size), pa.int32()),
                    pa.ListArray.from_arrays(ends, pa.array(at, pa.int32())),
                    pa.ListArray.from_arrays(ends, pa.array(ratio[at], pa.float64()))], fields=list(kind))
                yield pa.RecordBatch.from_arrays([vectors, batch["toxic"].cast(pa.float64())], names=["features", "label"])
        release_memory()

    rows = texts.mapInArrow(place, T.StructType([
        T.StructField("features", VectorUDT()), T.StructField("label", T.DoubleType())]))
    model = LogisticRegression(maxIter=40, regParam=1e-4, standardization=False, tol=1e-5).fit(rows)
    return model.coefficients.toArray(), float(model.intercept)


def without_toxic(docs: DataFrame, model: ToxicModel, text_col: str = "text") -> DataFrame:
    """``docs`` without the texts that score 0.5 or more; all columns stay. Null and empty texts stay unless most labelled
    texts are toxic. Nothing is shuffled."""
    return docs.withColumn("_loom_score", model.score(F.col(text_col))).filter("_loom_score < 0.5").select(*docs.columns)
