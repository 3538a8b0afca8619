"""Line dedup: a sharded minimal perfect hash over distinct line hashes; documents probe its arrays.

1. *Lines.* A key is a line stripped of ASCII white space with A-Z lower-cased, hashed to 128 bits. Every Arrow batch
   counts the documents of each key itself, so a line that a third of all documents share is one row per batch. Documents
   whose id may repeat (a filter of fixed size knows) send id and key, which are made distinct before they are counted.
2. *Index.* Keys are dealt to shards by hash; the number of shards follows the size of the texts, so a shard stays at
   about ``SHARD_BYTES`` of text. A shard sums the counts and builds a minimal perfect hash in levels: a key that is
   alone at its place in a level's bit array stays there, the others go on to the next level, and the rank of its bit is
   a key's slot. Two compact arrays hold a 32-bit fingerprint and a 16-bit document count for each slot. The index is one
   row per shard, stored in the shared folder; lines themselves are never kept.
3. *Probe.* Documents send their line hashes to the shards, where slot, fingerprint and count decide; only lines to be
   dropped come back. Keys in more than 1/65,536 of all lines, at most 65,536 by that definition, go to every task
   instead and are decided on the spot, so no shard gets a hot key's documents.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.llm.common import id_text, map_columns, release_memory, stage, worker_cache
from marketloom.llm.keyfilter import KeyFilter

SHARD_BYTES = 32 << 20
HOT_PART = 65_536  # a key with more than this part of all lines is hot
SPACIOUS = 1.5  # places of a level for each key that is left
MOST_COUNT = 65_535
CUT_ROWS = 512  # texts cut at once, so that an Arrow batch of long texts is not held three times


def line_key(line: bytes) -> bytes:
    return line.strip().lower()


def document_keys(text: bytes | None, shortest: int) -> set[bytes]:
    """Hashes of the distinct keys of one text that have ``shortest`` or more code points."""
    keys = {line_key(x) for x in (text or b"").split(b"\n")}
    if shortest > 1:
        keys = {k for k in keys if len(k.decode()) >= shortest}
    elif shortest == 1:
        keys.discard(b"")
    return {xxhash.xxh3_128_digest(k) for k in keys}


def _halves(hashes: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(hashes), "<i8").reshape(-1, 2)
    return both[:, 0], both[:, 1]


def _mix(h: np.ndarray, level: int) -> np.ndarray:
    """Well mixed 64-bit values, different for each level."""
    h = h + np.uint64((level + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    h = (h ^ h >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ h >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return h ^ h >> np.uint64(31)


def _places(h1: np.ndarray, h2: np.ndarray, level: int, size: int) -> np.ndarray:
    return (_mix(h1.view(np.uint64) ^ _mix(h2.view(np.uint64), level), level) % np.uint64(size)).astype(np.int64)


def fingerprint(h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    return (_mix(h2.view(np.uint64) ^ _mix(h1.view(np.uint64), 7), 11) >> np.uint64(32)).astype(np.uint32)


class PerfectHash:
    """Slots 0 to n - 1 for n distinct 128-bit keys, from a bit array in levels."""

    def __init__(self, sizes: list[int], bits: bytes):
        self.sizes = sizes
        self.bits = np.unpackbits(np.frombuffer(bits, np.uint8), count=sum(sizes)).astype(bool)
        self.rank = np.cumsum(self.bits, dtype=np.int64) - 1

    @classmethod
    def build(cls, h1: np.ndarray, h2: np.ndarray) -> PerfectHash:
        sizes, bits = [], []
        while len(h1):
            size = int(len(h1) * SPACIOUS) + 8
            at = _places(h1, h2, len(sizes), size)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            bits.append(alone)
            left = ~alone[at]
            h1, h2 = h1[left], h2[left]
        return cls(sizes, np.packbits(np.concatenate(bits)).tobytes() if bits else b"")

    def packed(self) -> bytes:
        return np.packbits(self.bits).tobytes()

    def slots(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Slot of each key; -1 or any slot for a key that was not built in."""
        out = np.full(len(h1), -1, np.int64)
        left, base = np.arange(len(h1)), 0
        for level, size in enumerate(self.sizes):
            at = _places(h1[left], h2[left], level, size) + base
            hit = self.bits[at]
            out[left[hit]] = self.rank[at[hit]]
            left, base = left[~hit], base + size
        return out


INDEX = ("shard int, sizes array<int>, bits binary, fingerprints binary, counts binary, "
         "hot array<struct<h1: bigint, h2: bigint>>")


def _shard(h1: np.ndarray, shards: int) -> np.ndarray:
    return (h1.view(np.uint64) >> np.uint64(20)) % np.uint64(shards)


def _shard_row(table: pa.Table, hot_above: int) -> pa.Table:
    shard = table["shard"][0].as_py()
    h1, h2, n = (table[c].to_numpy() for c in ("h1", "h2", "n"))
    order = np.lexsort((h2, h1))
    h1, h2, n = h1[order], h2[order], n[order]
    first = np.flatnonzero(np.r_[True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])])
    n, h1, h2 = np.add.reduceat(n, first), h1[first], h2[first]
    index = PerfectHash.build(h1, h2)
    slots = index.slots(h1, h2)
    prints, counts = np.zeros(len(h1), "<u4"), np.zeros(len(h1), "<u2")
    prints[slots], counts[slots] = fingerprint(h1, h2), np.minimum(n, MOST_COUNT)
    hot = [{"h1": int(a), "h2": int(b)} for a, b in zip(h1[n > hot_above], h2[n > hot_above])]
    pair = pa.struct([("h1", pa.int64()), ("h2", pa.int64())])
    row = {"shard": pa.array([shard], pa.int32()), "sizes": pa.array([index.sizes], pa.list_(pa.int32())),
           "bits": pa.array([index.packed()], pa.binary()), "fingerprints": pa.array([prints.tobytes()], pa.binary()),
           "counts": pa.array([counts.tobytes()], pa.binary()), "hot": pa.array([hot], pa.list_(pair))}
    return pa.table(row)


class LineIndex:
    """The stored index: ``shards`` rows of arrays, and the few hot keys."""

    def __init__(self, table: DataFrame, shards: int, hot: frozenset[bytes]):
        self.table, self.shards, self.hot = table, shards, hot

    @classmethod
    def build(cls, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10,
              shortest: int = 1) -> LineIndex:
        """Index every distinct line of ``docs``. Rows that share an id are one document; each row without id is one."""
        if not 1 <= min_docs <= MOST_COUNT:
            raise ValueError(f"min_docs must be between 1 and {MOST_COUNT}")
        source = id_text(docs, id_col, text_col).withColumn("owner", F.xxhash64("doc_id"))
        size, lines = source.agg(
            F.sum(F.octet_length("text")),
            F.sum(F.octet_length("text") - F.octet_length(F.replace(F.col("text").cast("string"), F.lit("\n"), F.lit(""))) + 1)
        ).first()
        shards = 1 + (size or 0) // SHARD_BYTES
        hot_above = max(min_docs - 1, (lines or 0) // HOT_PART)
        repeated = KeyFilter.of(source.filter("doc_id is not null").groupBy("owner").agg(
            F.count(F.lit(1)).alias("n")).filter("n > 1").select("owner"))

        def count(owners: list, named: list, batch: list) -> list:
            """A row for each key of the batch, but one for each id and key where the id may occur in other rows."""
            worker_cache("lines")  # drops what other operators left in this worker
            shared = repeated.has(np.array(owners, np.int64)) & np.array(named, bool)
            seen = Counter()
            for owner, own, text in zip(owners, shared.tolist(), batch):
                if own:
                    seen.update((k, owner) for k in document_keys(text, shortest) if (k, owner) not in seen)
                else:
                    seen.update((k, None) for k in document_keys(text, shortest))
            h1, h2 = _halves([k for k, _ in seen])
            return [pa.array(_shard(h1, shards).astype(np.int32)), pa.array(h1), pa.array(h2),
                    pa.array([o for _, o in seen], pa.int64()), pa.array(list(seen.values()), pa.int64())]

        # one pass of the texts; both sums are partial ones first, so a line of very many documents is one row of each task
        lines_of = map_columns(source.select("owner", F.col("doc_id").isNotNull(), "text"), count,
                               "shard int, h1 long, h2 long, owner long, n long")
        by_owner = lines_of.groupBy("shard", "h1", "h2", "owner").agg(F.sum("n").alias("n"))
        keys = by_owner.groupBy("shard", "h1", "h2").agg(
            F.sum(F.when(F.col("owner").isNull(), F.col("n")).otherwise(1)).alias("n"))
        built = stage(keys.groupBy("shard").applyInArrow(lambda t: _shard_row(t, hot_above), INDEX), "line-index")
        hot = built.select(F.explode("hot").alias("k")).select("k.*").collect()  # at most HOT_PART keys
        return cls(built, shards, frozenset(
            np.array([r.h1, r.h2], "<i8").tobytes() for r in hot))

    def probe(self, docs: DataFrame, text_col: str = "text", min_docs: int = 10, shortest: int = 1) -> DataFrame:
        """``t1``, ``t2`` (``text_key`` of a text) and ``hashes``: the line hashes of each text that ``min_docs`` or more
        documents have, but for hot keys. Texts without such lines have no row."""
        text = F.col(text_col).cast("string").cast("binary")
        source = docs.select(*[k.alias(f"t{n}") for n, k in enumerate(text_key(text), 1)], text.alias("text"))
        shards, hot = self.shards, self.hot

        def send(t1: list, t2: list, texts: list) -> tuple:
            counts, hashes = [], []
            done = set()  # copies in one batch ask once
            for key, text in zip(zip(t1, t2), texts):
                keys = document_keys(text, shortest) - hot if key not in done else ()
                done.add(key)
                counts.append(len(keys))
                hashes += keys
            h1, h2 = _halves(hashes)
            return [pa.array(_shard(h1, shards).astype(np.int32)), pa.array(h1), pa.array(h2),
                    *(pa.array(np.repeat(np.array(t, np.int64), counts)) for t in (t1, t2))]

        def decide(asked: pa.Table, index: pa.Table) -> Iterator[pa.Table]:
            if not asked.num_rows or not index.num_rows:
                return asked.select(["t1", "t2", "h1", "h2"]).slice(0, 0)
            row = index.slice(0, 1).to_pylist()[0]
            h1, h2 = asked["h1"].to_numpy(), asked["h2"].to_numpy()
            slots = PerfectHash(row["sizes"], row["bits"]).slots(h1, h2)
            known = (slots >= 0) & (np.frombuffer(row["fingerprints"], "<u4")[slots] == fingerprint(h1, h2))
            often = known & (np.frombuffer(row["counts"], "<u2")[slots] >= min_docs)
            return asked.select(["t1", "t2", "h1", "h2"]).filter(pa.array(often))

        asked = map_columns(source, send, "shard int, h1 long, h2 long, t1 long, t2 long")
        arrays = self.table.select("shard", "sizes", "bits", "fingerprints", "counts")
        found = asked.groupBy("shard").cogroup(arrays.groupBy("shard")).applyInArrow(
            decide, "t1 long, t2 long, h1 long, h2 long")
        return found.groupBy("t1", "t2").agg(F.collect_set(F.struct("h1", "h2")).alias("hashes"))


def text_key(text: Column) -> list[Column]:
    return [F.xxhash64(text), F.xxhash64(F.lit(1), text)]


def _without(hot: frozenset[bytes], shortest: int):
    kind = pa.struct([("kept", pa.string()), ("n_lines", pa.int64()), ("n_dropped", pa.int64())])

    @F.arrow_udf("struct<kept string, n_lines bigint, n_dropped bigint>")
    def cut(texts: pa.Array, found: pa.Array) -> pa.Array:
        parts = [few(texts.slice(start, CUT_ROWS), found.slice(start, CUT_ROWS)) for start in range(0, len(texts), CUT_ROWS)]
        release_memory()
        return pa.concat_arrays(parts) if parts else few(texts, found)

    def few(texts: pa.Array, found: pa.Array) -> pa.Array:
        kept, total, dropped = [], [], []
        for text, hashes in zip(texts.to_pylist(), found.to_pylist()):
            gone = {np.array([h["h1"], h["h2"]], "<i8").tobytes() for h in hashes or ()}
            lines = (text or b"").split(b"\n")
            stay = []
            for line in lines:
                key = line_key(line)
                code = xxhash.xxh3_128_digest(key)
                if (code not in gone and code not in hot) or len(key) < shortest or len(key.decode()) < shortest:
                    stay.append(line)
            kept.append(b"\n".join(stay).decode())
            total.append(len(lines))
            dropped.append(len(lines) - len(stay))
        return pa.StructArray.from_arrays(
            [pa.array(kept, pa.string()), pa.array(total, pa.int64()), pa.array(dropped, pa.int64())], fields=list(kind))

    return cut


def cut_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10,
              shortest: int = 1) -> tuple[DataFrame, Column]:
    """``docs`` with a helper column, and a struct column ``kept``, ``n_lines``, ``n_dropped`` over it.

    A line's key of ``shortest`` or more code points that ``min_docs`` or more documents have loses all its lines in
    every document; the other lines stay unchanged, joined by line feeds. A null or empty text is one empty line. Rows that
    share an id are one document, each row without id is one; a key is frequent for all or for none. An empty table gives no
    rows.
    """
    index = LineIndex.build(docs, id_col, text_col, min_docs, shortest)
    # a plain table keyed by text: no id is a key here, and Spark can split a text with very many copies
    found = stage(index.probe(docs, text_col, min_docs, shortest).select(
        F.col("t1").alias("_loom_t1"), F.col("t2").alias("_loom_t2"), F.col("hashes").alias("_loom_hashes")), "frequent-lines")
    text = F.col(text_col).cast("string").cast("binary")
    keyed = docs.withColumns({f"_loom_t{n}": k for n, k in enumerate(text_key(text), 1)})
    joined = keyed.join(found, ["_loom_t1", "_loom_t2"], "left").drop("_loom_t1", "_loom_t2")
    return joined, _without(index.hot, shortest)(text, F.col("_loom_hashes"))


def drop_frequent_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10,
                        shortest: int = 1) -> DataFrame:
    """``docs`` with its columns, frequent lines cut from the texts; null texts stay null."""
    joined, cut = cut_lines(docs, id_col, text_col, min_docs, shortest)
    done = joined.withColumn("_loom_cut", cut)
    text = F.when(F.col(text_col).isNotNull(), F.col("_loom_cut.kept"))
    return done.withColumn(text_col, text).select(*docs.columns)
