"""A filter of fixed size over 64-bit keys, tested on the map side before rows are moved.

It holds one bit for each of 2^BITS hash values, whatever the number of keys, so the driver and every task hold 16 MB at
most. It never loses a key that was put in. The more keys, the more others pass as well: what follows has to be exact by
itself, and a full filter only costs time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.llm.wordhash import mixed

BITS = 27
PAGE = 15  # bits are gathered in pages of 2^PAGE


def places(keys: np.ndarray) -> np.ndarray:
    return (mixed(keys.astype(np.int64).view(np.uint64)) >> np.uint64(64 - BITS)).astype(np.int64)


class KeyFilter:
    def __init__(self, pages: dict[int, bytes]):
        self.pages = pages

    @classmethod
    def of(cls, keys: DataFrame) -> KeyFilter:
        """Of one column of longs; nulls are left out."""

        def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = np.unique(places(batch.column(0).drop_null().to_numpy(zero_copy_only=False)))
                yield pa.RecordBatch.from_arrays([pa.array(at >> PAGE), pa.array(at & (1 << PAGE) - 1)], names=["page", "bit"])

        def page(table: pa.Table) -> pa.Table:
            held = np.zeros(1 << PAGE, bool)
            held[table["bit"].to_numpy()] = True
            return pa.table({"page": table["page"][:1], "bits": pa.array([np.packbits(held).tobytes()], pa.binary())})

        found = keys.mapInArrow(bits, "page long, bit long").distinct().groupBy("page").applyInArrow(
            page, "page long, bits binary")
        return cls({r.page: bytes(r.bits) for r in found.collect()})  # 2^BITS bits at most

    def has(self, keys: np.ndarray) -> np.ndarray:
        flat = self.__dict__.get("flat")
        if flat is None:
            flat = np.zeros(1 << (BITS - 3), np.uint8)
            for number, bits in self.pages.items():
                flat[number << (PAGE - 3): number + 1 << (PAGE - 3)] = np.frombuffer(bits, np.uint8)
            self.flat = flat
        at = places(keys)
        return (flat[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)

    def __getstate__(self) -> dict:
        return {"pages": self.pages}

    def keep(self, rows: DataFrame, key: str) -> DataFrame:
        """Rows whose key may have been put in. The order of columns stays; null keys go."""

        def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                column = batch.column(batch.schema.get_field_index(key))
                known = column.is_valid().to_numpy(zero_copy_only=False)
                yield batch.filter(pa.array(known & self.has(column.fill_null(0).to_numpy())))

        return rows.mapInArrow(test, rows.schema)

    def holds(self, key: Column) -> Column:
        """Whether a key may have been put in; false for null."""

        @F.arrow_udf("boolean")
        def test(keys: pa.Array) -> pa.Array:
            known = keys.is_valid().to_numpy(zero_copy_only=False)
            return pa.array(known & self.has(keys.fill_null(0).to_numpy()))

        return test(key)
