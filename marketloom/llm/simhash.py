"""SimHash near-duplicates: meet-in-the-middle ball hashing over 64-bit fingerprints.

Two fingerprints at most three bits apart meet at a point that one of them reaches by at most one flip and the other by
at most two, so it is enough that every fingerprint emits the points within half the radius (one or two flips) around
it and that equal points are brought together.

Which points are emitted. Split the 64 bits into two halves. Of three differing bits at most one lies in one of the
halves, so each *side* keeps one half (the ``key``) nearly fixed and varies the other:

* a row keeps its key as it is and varies the other half by up to two flips (529 points); if the key and the other half
  both have odd parity, one flip is enough (33 points), because a partner three flips away has an even other half;
* a row with an odd key also flips each of the 32 key bits and leaves the other half alone; a partner whose key differs
  in one bit has an even key and reaches that point with up to two flips.

Points of one fingerprint that share a key are one row until it is known that the key is shared: the *sieve* counts the
fingerprints of every key (at most 34 rows for each side), and only keys with two or more fingerprints are opened into
points. A pair meets under a shared key, so no pair is lost; how many rows pass depends on how full the key space is.

Linking at a point. Call an emitter light if it is at most one flip away. The smallest light emitter is the point's
hub; all others lie within 1 + 2 bits of it and are linked to it. Every pair meets at a point where one of both is
light, so both hang on that hub: no link between components is lost and no point lists pairs. At most 561 distinct
fingerprints fit around a point, so no group is large, whatever the data are. Every link is verified by its bit count.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.llm.common import id_text, map_columns, stage
from marketloom.llm.components import connected

BITS = 3  # differing bits of a link; the emission rules above are those of this radius
SHINGLE = 3
SEED = 42
SECOND_SIDE = 3 << 32  # two bits, so that it leaves the parity of a key alone
ONE_FLIP = [0, *[1 << i for i in range(32)]]
TWO_FLIPS = ONE_FLIP + [1 << i | 1 << j for i, j in combinations(range(32), 2)]


def simhash(text: bytes | None, shingle: int = SHINGLE) -> int:
    """Signed 64-bit fingerprint of one text; zero for a text without words.

    A-Z are lower-cased, words are separated by ASCII white space, a text of fewer words is one shingle. A bit is set
    if more than half of the shingle hashes have it; repeated shingles count each time.
    """
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_digest
    if len(words) <= shingle:
        hashes = digest(joined, SEED)
    else:
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths + 1) - 1
        starts = (ends - lengths)[: len(words) - shingle + 1].tolist()
        hashes = b"".join([digest(joined[s:e], SEED) for s, e in zip(starts, ends[shingle - 1:].tolist())])
    values = np.frombuffer(hashes, np.uint8).reshape(-1, 8)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(values), 65536):  # bounds the unpacked bits of a very long text
        ones += np.unpackbits(values[at: at + 65536], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(values)).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``doc_id``, ``fp`` (long): one row per input row, null and empty texts have fingerprint zero."""
    source = id_text(docs, id_col, text_col)
    kind = source.schema["doc_id"].dataType.simpleString()
    return map_columns(
        source, lambda ids, texts: (ids, [simhash(t, shingle) for t in texts]), f"doc_id {kind}, fp long")


def _masks(values: list[int]) -> Column:
    return F.expr(f"array({', '.join(f'{v}L' for v in values)})")


def _parity(c: Column) -> Column:
    return F.bit_count(c).bitwiseAND(F.lit(1))


def _sides(fps: DataFrame) -> DataFrame:
    """``key`` (side and kept half), ``rest`` (varied half), ``fp``, ``flipped``."""
    low, high = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned("fp", 32)
    both = fps.select("fp", F.explode(F.array(
        F.struct(high.alias("key"), low.alias("rest"), F.lit(0).alias("side")),
        F.struct(low.alias("key"), high.alias("rest"), F.lit(SECOND_SIDE).alias("side")))).alias("s")).select("fp", "s.*")
    flips = F.when(_parity(F.col("key")) == 1, _masks(ONE_FLIP)).otherwise(_masks([0]))
    return both.withColumn("flip", F.explode(flips)).select(
        (F.col("key").bitwiseXOR(F.col("flip")) + F.col("side")).alias("key"), "rest", "fp",
        (F.col("flip") != 0).alias("flipped"))


def links(fps: DataFrame) -> DataFrame:
    """Verified links ``a``, ``b`` whose components are those of all pairs at most three bits apart.

    ``fps``: one column ``fp`` of distinct longs.
    """
    rows = _sides(fps)
    shared = rows.groupBy("key").agg(F.min("fp").alias("first"), F.max("fp").alias("last")).filter(
        "first <> last").select("key")
    opened = rows.join(shared, "key", "left_semi")
    heavy = (_parity(F.col("key")) == 0) | (_parity(F.col("rest")) == 0)
    masks = F.when(F.col("flipped"), _masks([0])).when(heavy, _masks(TWO_FLIPS)).otherwise(_masks(ONE_FLIP))
    points = opened.withColumn("mask", F.explode(masks)).select(
        "key", F.col("rest").bitwiseXOR(F.col("mask")).alias("rest"), "fp",
        (F.bit_count("mask") + F.col("flipped").cast("int")).alias("flips"))
    hub = F.min(F.when(F.col("flips") <= 1, F.col("fp"))).over(Window.partitionBy("key", "rest"))
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("hub"))) <= BITS
    return points.withColumn("hub", hub).filter((F.col("fp") != F.col("hub")) & near).select(
        F.col("fp").alias("a"), F.col("hub").alias("b")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``fp``, ``component_id``: one row per input row.

    ``component_id`` is the smallest document id reachable over links, the row's own id included. Documents without
    words share fingerprint zero and are linked like any other. Rows with a null id take part; a component in which
    every id is null has a null ``component_id``. Repeated rows come back repeated. An empty table gives no rows.
    Exact copies share a fingerprint, so only distinct fingerprints are searched.
    """
    fps = stage(fingerprints(docs, id_col, text_col), "fingerprints")
    distinct = stage(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct-fingerprints")
    labels = connected(links(distinct.select("fp")))
    rooted = distinct.join(labels.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "first_id", F.coalesce("label", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    # stored as a plain table: Spark can split the rows of a fingerprint with very many copies only if both sides are plain
    by_fp = stage(rooted.join(least, "root").select("fp", "component_id"), "fingerprint-components")
    return fps.join(by_fp, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of every group of near-duplicates, the one with the smallest id.

    Keeps all columns. Rows that repeat the kept id stay; so do rows without id, as nothing names them.
    """
    found = near_duplicates(docs, id_col, text_col)
    kept = stage(found.filter(F.col("doc_id").isNull() | (F.col("doc_id") == F.col("component_id"))).select(
        F.col("doc_id").alias("_loom_kept")).distinct(), "kept-ids")  # a plain table, so that a hot id can be split
    return docs.join(kept, F.col(id_col).eqNullSafe(F.col("_loom_kept")), "left_semi")
