"""Helpers shared by the operators: column selection, Arrow batches, staged tables, worker caches."""

from __future__ import annotations

import ctypes
import sys
import types
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.session import staging_path

PORTION_BYTES = 4 << 20  # of a batch that become Python objects at once


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns an operator needs, under fixed names; text as UTF-8 bytes."""
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))


def map_columns(
    df: DataFrame, fn: Callable[..., Sequence], schema: str, **shared
) -> DataFrame:
    """Apply ``fn(*columns as Python lists, **shared) -> columns`` to portions of every Arrow batch.

    The result may have more or fewer rows than the portion. ``shared`` travels with the task.
    """
    arrow = arrow_schema(df, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in portions(batch):
                out = fn(*[c.to_pylist() for c in part.columns], **shared)
                yield pa.RecordBatch.from_arrays(
                    [v if isinstance(v, pa.Array) else pa.array(v, type=f.type) for v, f in zip(out, arrow)], schema=arrow)
        release_memory()

    return df.mapInArrow(run, schema)


def arrow_schema(df: DataFrame, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def portions(batch: pa.RecordBatch, size: int = PORTION_BYTES) -> Iterator[pa.RecordBatch]:
    """A batch in slices of equal numbers of rows, about ``size`` bytes each and one row at least."""
    rows = max(1, size * batch.num_rows // max(1, batch.nbytes))
    for start in range(0, batch.num_rows, rows):
        yield batch.slice(start, rows)


def release_memory() -> None:
    """Give freed memory back to the system.

    A Python worker stays after its task and, while it waits for the next one, would go on holding the peak of the last; an
    executor has more workers than tasks, so that adds up. Without the C library's call only Arrow's pool is released.
    """
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def text_slices(column: pa.Array, rows: int = 512) -> Iterator:
    """The values of a column as Python objects, a few rows at a time: a batch of long texts is never held twice."""
    for start in range(0, len(column), rows):
        yield from column.slice(start, rows).to_pylist()


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write a shared intermediate as Parquet below ``spark.checkpoint.dir`` and read it back.

    Cuts the lineage and survives lost executors. The copy lives until the owner of the shared folder clears it.
    """
    path = staging_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def worker_cache(name: str) -> dict:
    """A dictionary that lives as long as the Python worker, so that tasks of one worker share it.

    A worker serves one stage after another, so it holds the memory of one name only: asking for another name empties it.
    """
    store = sys.modules.setdefault("_loom_worker_cache", types.ModuleType("_loom_worker_cache"))
    held = store.__dict__.setdefault("held", {})
    if name not in held:
        held.clear()
        release_memory()
        held[name] = {}
    return held[name]
