"""MinHash near-duplicates: banded candidates, sequential Bayesian verification, exact check of the survivors.

1. *Sets.* A document's set holds the 64-bit hashes of its distinct word shingles. Equal sets are one set from here on. A
   signature has ``HASHES`` minima (16 bits each), cut into ``BANDS`` bands of ``ROWS``; sets that agree in a band share a
   bucket. Two sets of similarity 0.8 miss each other in all bands with probability 8e-6.
2. *Hubs.* Every bucket names one member, the one that meets others in most bands (of equal ones the smallest number), and
   the others are compared with it. Groups of copies hang on their original, so this settles most buckets with one row for
   each member, whatever the size of a group.
3. *Verification.* Signatures are compared ``BATCH`` minima at a time. With a uniform prior, m matches among n minima give
   the similarity a Beta(m + 1, n - m + 1) distribution; a pair goes as soon as its probability of reaching the limit falls
   below ``MISS``. What is left after the last batch is decided by the full sets.
4. *Open buckets.* Where the members of a bucket are still in different components, all pairs of different components are
   compared in the same way, within cells of bounded size. A cell returns only the links that join two components, at most
   one row for each of its members, so no group lists its pairs, and none is left out.

Signatures, sets and texts move only by a key of their own; buckets, which may be hot, are joined as plain stored tables,
whose hot keys adaptive execution splits.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.llm.common import id_text, map_columns, stage, worker_cache
from marketloom.llm.components import connected
from marketloom.llm.keyfilter import KeyFilter
from marketloom.llm.wordhash import WordHashes, mixed, rolling

SHINGLE = 2
PERCENT = 80
BANDS, ROWS = 64, 8
HASHES = BANDS * ROWS
BATCH = 64
MISS = 1e-5  # chosen probability with which a batch may drop a pair that reaches the limit
CELL = 1024  # members of a bucket that meet in one cell
_DRAWN = mixed(np.arange(1, 2 * HASHES + 1, dtype=np.uint64))
FACTORS, OFFSETS = (_DRAWN[:HASHES] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (
    _DRAWN[HASHES:] >> np.uint64(32)).astype(np.uint32)


def shingle_set(text: bytes | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the shingles; of all words as one if they are fewer, none without words."""
    words = (text or b"").lower().split()
    hashes = worker_cache("word hashes").setdefault(11, WordHashes(11)).of(words)
    return np.unique(rolling(hashes, min(shingle, len(words)))) if words else np.empty(0, np.uint64)


def signature(shingles: np.ndarray) -> np.ndarray:
    """Low 16 bits of the minimum of every hash function."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 256):
        np.minimum(least, (x[at: at + 256, None] * FACTORS + OFFSETS).min(axis=0), out=least)
    return least.astype("<u2")


def needed_matches(percent: int, miss: float) -> list[int]:
    """For each number of minima compared, the fewest matches with which a pair stays.

    P(similarity >= t) under Beta(m + 1, n - m + 1) is the chance of at most m successes in n + 1 draws of probability t.
    """
    t, out = percent / 100, []
    for n in range(BATCH, HASHES + 1, BATCH):
        below, m = 0.0, -1
        while below < miss and m < n:
            m += 1
            below += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        out.append(m)
    return out


def bayes_survivors(left: np.ndarray, right: np.ndarray, needed: list[int]) -> np.ndarray:
    """Numbers of the pairs (rows of both signature matrices) that no batch prunes."""
    rows = np.arange(len(left))
    matches = np.zeros(len(left), np.int32)
    for step, least in enumerate(needed):
        part = slice(step * BATCH, (step + 1) * BATCH)
        matches = matches + (left[rows, part] == right[rows, part]).sum(axis=1, dtype=np.int32)
        stay = matches >= least
        rows, matches = rows[stay], matches[stay]
        if not len(rows):
            break
    return rows


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Exact: 100 * |a and b| >= percent * |a or b| for sorted distinct hashes."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    place = np.searchsorted(b, a)
    place[place == len(b)] = 0
    both = int((b[place] == a).sum()) if len(b) else 0
    return 100 * both >= percent * (len(a) + len(b) - both)


def _prints(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """``doc_id``, ``r1``, ``r2`` (key of the row), ``n``, ``s1``, ``s2`` (key of the set), ``signature`` for every row."""
    source = _keyed(docs, id_col, text_col)
    kind = source.schema["doc_id"].dataType.simpleString()

    def cut(ids: list, r1: list, r2: list, texts: list) -> tuple:
        sets = [shingle_set(t, shingle) for t in texts]
        digests = np.frombuffer(b"".join([xxhash.xxh3_128_digest(s.tobytes()) for s in sets]), "<i8").reshape(-1, 2)
        return (ids, r1, r2, [len(s) for s in sets], pa.array(digests[:, 0]), pa.array(digests[:, 1]),
                [signature(s).tobytes() if len(s) else None for s in sets])

    return map_columns(source, cut, f"doc_id {kind}, r1 long, r2 long, n long, s1 long, s2 long, signature binary")


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    source = id_text(docs, id_col, text_col)
    return source.select("doc_id", F.xxhash64("doc_id", "text").alias("r1"), F.xxhash64(F.lit(1), "text").alias("r2"), "text")


def _buckets(reps: DataFrame) -> DataFrame:
    """``bucket``, ``rid`` for every band of every signature."""
    band = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.xxhash64(
        b, F.substring(F.col("signature"), b * F.lit(2 * ROWS) + F.lit(1), F.lit(2 * ROWS))))
    return reps.select("rid", F.explode(band).alias("bucket"))


def _sets(docs: DataFrame, id_col: str, text_col: str, shingle: int, wanted: DataFrame) -> DataFrame:
    """``rid``, ``n``, ``signature``, ``shingles`` for ``wanted`` (``rid``, ``r1``, ``r2`` and the former two). Texts are
    read again; a filter keeps those that nobody asked for from being moved."""
    texts = KeyFilter.of(wanted.select("r1")).keep(_keyed(docs, id_col, text_col).drop("doc_id"), "r1")
    once = texts.groupBy("r1", "r2").agg(F.first("text").alias("text"))
    return map_columns(
        once.join(wanted, ["r1", "r2"]).select("rid", "n", "signature", "text"),
        lambda rids, n, signatures, found: (rids, n, signatures, [shingle_set(t, shingle).tobytes() for t in found]),
        "rid long, n long, signature binary, shingles binary")


def _rows_of(column: pa.Array, dtype: str) -> list[np.ndarray]:
    """The values of a binary column as arrays over its own buffer."""
    return [np.frombuffer(v.as_buffer(), dtype) for v in column]


def _similar_length(percent: int) -> Column:
    return F.least("n", "m") * 100 >= F.greatest("n", "m") * percent


def verified(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT, miss: float = MISS) -> DataFrame:
    """Links ``a``, ``b`` among ``pairs`` (``a``, ``b``): pruned by their signatures, confirmed on their full sets."""
    needed = needed_matches(percent, miss)
    left = sets.select(F.col("rid").alias("a"), "n", "signature", "shingles")
    right = sets.select(F.col("rid").alias("b"), F.col("n").alias("m"), F.col("signature").alias("other"),
                        F.col("shingles").alias("rest"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):  # bounds the signatures that are compared at a time
                batch = whole.slice(at, 1000)
                mine, others = (np.stack(_rows_of(batch[c], "<u2")) for c in ("signature", "other"))
                rows = bayes_survivors(mine, others, needed)
                near = batch.take(pa.array(rows))
                sure = [linked(a, b, percent) for a, b in zip(
                    _rows_of(near["shingles"], "<u8"), _rows_of(near["rest"], "<u8"))]
                yield near.filter(pa.array(sure, pa.bool_())).select(["a", "b"])

    met = pairs.join(left, "a").join(right, "b").filter(_similar_length(percent))
    return met.select("a", "b", "signature", "other", "shingles", "rest").mapInArrow(judge, "a long, b long")


def cell_links(rids: list, labels: list, sides: list, signatures: np.ndarray, sets: list, percent: int,
               needed: list[int]) -> list[tuple[int, int]]:
    """Links that join different components in one cell, at most one fewer than its members.

    Pairs of one component, or of one side of a cell that has two, are not compared.
    """
    parent: dict[int, int] = {x: x for x in labels}

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    sizes, out = np.array([len(s) for s in sets]), []
    two_sided = len(set(sides)) > 1
    flank, now = np.array(sides), np.array(labels)
    for i in range(len(rids) - 1):
        rest = slice(i + 1, None)
        small, large = np.minimum(sizes[i], sizes[rest]), np.maximum(sizes[i], sizes[rest])
        open_ = (now[rest] != now[i]) & (100 * small >= percent * large)
        if two_sided:
            open_ &= flank[rest] != flank[i]
        at = np.flatnonzero(open_) + i + 1
        if not len(at):
            continue
        near = at[bayes_survivors(np.broadcast_to(signatures[i], (len(at), HASHES)), signatures[at], needed)]
        for j in near.tolist():
            x, y = root(int(now[i])), root(int(now[j]))
            if x != y and linked(sets[i], sets[j], percent):
                parent[max(x, y)] = min(x, y)
                out.append((rids[i], rids[j]))
                now = np.where(now == max(x, y), min(x, y), now)
    return out


def _open_links(buckets: DataFrame, sets: DataFrame, labels: DataFrame, percent: int, miss: float) -> DataFrame:
    """Links between components that share a bucket; ``labels``: ``rid``, ``label``."""
    needed = needed_matches(percent, miss)
    named = stage(buckets.join(labels, "rid", "left").select(
        "bucket", "rid", F.coalesce("label", "rid").alias("label")), "bucket-labels")
    still = stage(named.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("members"), F.min("label").alias("low"), F.max("label").alias("high")).filter(
        "low < high").select("bucket", F.ceil(F.col("members") / CELL).cast("int").alias("chunks")), "open-buckets")
    dealt = named.join(still, "bucket").withColumn("chunk", F.pmod(F.xxhash64("rid"), F.col("chunks")).cast("int"))
    cells = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select(
        "bucket", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "rid", "label", "chunk")
    rows = cells.join(sets.select("rid", "signature", "shingles"), "rid").repartition("bucket", "i", "j").sortWithinPartitions(
        "bucket", "i", "j", "rid").select("bucket", "i", "j", "rid", "label", "chunk", "signature", "shingles")

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:
            ids = list(zip(*[batch[c].to_pylist() for c in ("bucket", "i", "j")]))
            members = list(zip(*[batch[c].to_pylist() for c in ("rid", "label", "chunk", "signature", "shingles")]))
            out = []
            for now, member in zip(ids, members):
                if now != key:
                    out += settle(held)
                    key, held = now, []
                held.append(member)
            yield links(out)
        yield links(settle(held))

    def settle(held: list) -> list[tuple[int, int]]:
        if len(held) < 2:
            return []
        rids, own, sides, signatures, found = zip(*held)
        matrix = np.frombuffer(b"".join(signatures), "<u2").reshape(-1, HASHES)
        return cell_links(list(rids), list(own), list(sides), matrix, [np.frombuffer(s, "<u8") for s in found], percent, needed)

    def links(out: list) -> pa.RecordBatch:
        columns = list(zip(*out)) or [(), ()]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["a", "b"])

    return rows.mapInArrow(stream, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                    percent: int = PERCENT, miss: float = MISS) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id``, ``kept``: one row per input row.

    Two documents are linked if 100 * shared >= percent * all of their distinct shingles; the bands above are those of 80
    percent or more. ``component_id`` is the smallest id reachable over links. A text of fewer words than a shingle is one
    shingle; null texts and texts without words have no shingles and are linked with nothing, not even each other. Rows with
    a null id take part; a component in which every id is null has a null ``component_id``, and rows without id are always
    kept, as nothing names them. Repeated rows come back repeated. An empty table gives no rows.
    """
    if not PERCENT <= percent <= 100:
        raise ValueError(f"percent must be between {PERCENT} and 100")
    prints = stage(_prints(docs, id_col, text_col, shingle), "minhash-prints")
    reps = stage(prints.filter("n > 0").groupBy("s1", "s2").agg(
        F.min("doc_id").alias("first_id"), F.min(F.struct("r1", "r2")).alias("r"), F.first("n").alias("n"),
        F.first("signature").alias("signature")).select(
        F.monotonically_increasing_id().alias("rid"), "s1", "s2", "first_id", "r.r1", "r.r2", "n", "signature"), "minhash-sets")
    every = _buckets(reps)
    shared = stage(every.groupBy("bucket").agg(F.min("rid").alias("low"), F.max("rid").alias("high")).filter(
        "low < high").select("bucket"), "shared-buckets")
    buckets = stage(every.join(shared, "bucket", "left_semi").select("bucket", "rid"), "bucket-members")
    company = buckets.groupBy("rid").agg(F.count(F.lit(1)).alias("company"))
    hubs = stage(buckets.join(company, "rid").groupBy("bucket").agg(
        F.min(F.struct(-F.col("company"), "rid")).alias("first")).select("bucket", F.col("first.rid").alias("b")), "hubs")
    pairs = stage(buckets.join(hubs, "bucket").filter("rid <> b").select(F.col("rid").alias("a"), "b").distinct(), "hub-pairs")
    sets = stage(_sets(docs, id_col, text_col, shingle, reps.join(company, "rid", "left_semi").select(
        "rid", "r1", "r2", "n", "signature")), "candidate-sets")
    links = stage(verified(pairs, sets, percent, miss), "hub-links")
    labels = connected(links).withColumnRenamed("node", "rid")
    more = stage(_open_links(buckets, sets, labels, percent, miss), "more-links")
    labels = connected(links.unionByName(more)).withColumnRenamed("node", "rid")
    rooted = reps.select("s1", "s2", "rid", "first_id").join(labels, "rid", "left").select(
        "s1", "s2", "first_id", F.coalesce("label", "rid").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    by_set = stage(rooted.join(least, "root").select("s1", "s2", "component_id"), "set-components")
    joined = prints.select("doc_id", "n", F.when(F.col("n") > 0, F.col("s1")).alias("s1"), "s2").join(
        by_set, ["s1", "s2"], "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return joined.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn(
        "kept", F.col("doc_id").isNull() | F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
