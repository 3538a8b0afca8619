"""Substring dedup: winnowed anchors seed, matches are extended to windows, maximal repeats are cut.

1. *Seed.* Of every window of 50 words, the smallest hash among its 10-word runs is the window's anchor. Equal windows
   have equal anchors, so only windows whose anchor occurs in two different texts can repeat. About one word in twenty
   is an anchor. The windows of one anchor are consecutive; together they span a *block*.
2. *Extend.* An anchor's block is the anchor extended both ways as far as its windows reach. Blocks that are equal word
   for word have the same windows, so the smallest document with the block owns them all, and the others need no closer
   look: this settles the inside of a passage, and a passage that thousands of documents share costs one row for each
   anchor. Where an anchor has several different blocks (at the ends of passages, at edits) the blocks without a smaller
   owner are opened into their windows, and equal windows are grouped in the same way. Grouping replaces comparing pairs
   of documents.
3. *Maximal repeats.* Starts whose window has a smaller document are joined back to the text; overlapping and adjacent
   windows merge into maximal runs of at least 50 words, which are removed.

Texts are compared once for each distinct text: of equal texts the smallest id stands for all, and a copy with a larger
id loses everything that any window covers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.llm.common import map_columns, stage, worker_cache
from marketloom.llm.wordhash import OTHER, WordHashes, rolling, spans, winnowed

WINDOW, GRAM = 50, 10


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id``, ``text``, the text's key ``t1``, ``t2`` (128 bits), and ``row`` (hash of id and text key, never null)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    keyed = docs.select(F.col(id_col).alias("id"), text.alias("text")).withColumns(
        {"t1": F.xxhash64("text"), "t2": F.xxhash64(F.lit(1), "text")})
    return keyed.withColumn("row", F.xxhash64("id", "t1", "t2"))


def _hashes(text: bytes) -> np.ndarray:
    return worker_cache("word hashes").setdefault(1, WordHashes(1)).of(text.split())


def _seeds(texts: DataFrame, window: int, gram: int) -> DataFrame:
    """``t1``, ``t2``, ``lo``, ``hi`` (first and last start with this anchor), ``anchor``, ``block``."""

    def cut(t1: list, t2: list, texts: list) -> list:
        found = []
        for text in texts:
            hashes = _hashes(text)
            grams = rolling(hashes, gram)
            at = winnowed(grams, window - gram + 1)
            lo = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(at) else at
            hi = np.append(lo[1:], len(at)) - 1 if len(at) else at
            found.append((lo.astype(np.int32), hi.astype(np.int32), grams[at[lo]].view(np.int64),
                          spans(hashes, lo, hi + window).view(np.int64)))
        counts = [len(f[0]) for f in found]
        return [*(pa.array(np.repeat(np.array(t, np.int64), counts)) for t in (t1, t2)),
                *(pa.array(np.concatenate(x)) for x in zip(*found))] if found else [[]] * 6

    return map_columns(texts.select("t1", "t2", "text"), cut,
                       "t1 long, t2 long, lo int, hi int, anchor long, block long")


def _windows(opened: DataFrame, window: int) -> DataFrame:
    """Windows of the open blocks; ``opened``: ``t1``, ``t2``, ``first_id``, ``text``, ``ranges`` of starts."""
    kind = opened.schema["first_id"].dataType.simpleString()

    def emit(t1: list, t2: list, first: list, texts: list, ranges: list) -> list:
        found = []
        for text, own in zip(texts, ranges):
            hashes = _hashes(text)
            s = np.concatenate([np.arange(r["lo"], r["hi"] + 1) for r in own])
            found.append((s.astype(np.int32), spans(hashes, s, s + window).view(np.int64),
                          (spans(hashes, s, s + window, OTHER) >> np.uint64(33)).astype(np.int32)))
        index = pa.array(np.repeat(np.arange(len(found)), [len(f[0]) for f in found]), pa.int64())
        return [*(pa.array(v, t).take(index) for v, t in ((t1, pa.int64()), (t2, pa.int64()), (first, None))),
                *(pa.array(np.concatenate(x)) for x in zip(*found))] if found else [[]] * 6

    return map_columns(opened.select("t1", "t2", "first_id", "text", "ranges"), emit,
                       f"t1 long, t2 long, first_id {kind}, start int, w1 long, w2 int")


def _cut(window: int):
    kind = pa.struct([("kept", pa.string()), ("n_words", pa.int64()), ("n_removed", pa.int64()),
                      ("runs", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))])

    @F.arrow_udf("struct<kept string, n_words bigint, n_removed bigint, runs array<struct<start int, `end` int>>>")
    def cut(texts: pa.Array, copies: pa.Array, late: pa.Array) -> pa.Array:
        out = []
        for text, copy, found in zip(texts.to_pylist(), copies.to_pylist(), late.to_pylist()):
            words = text.split()
            runs: list[dict] = []
            if copy and len(words) >= window:
                runs = [{"start": 0, "end": len(words)}]
            for lo, hi in sorted((r["lo"], r["hi"]) for r in found or ()) if not runs else ():
                if runs and lo <= runs[-1]["end"]:
                    runs[-1]["end"] = max(hi + window, runs[-1]["end"])
                else:
                    runs.append({"start": lo, "end": hi + window})
            kept, at = [], 0
            for run in runs:
                kept += words[at: run["start"]]
                at = run["end"]
            kept += words[at:]
            out.append({"kept": b" ".join(kept).decode(), "n_words": len(words), "n_removed": len(words) - len(kept),
                        "runs": runs})
        return pa.array(out, kind)

    return cut


def cut_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
                gram: int = GRAM) -> DataFrame:
    """``id``, ``kept``, ``n_words``, ``n_removed``, ``runs`` (removed word ranges, end exclusive): one row per input row.

    Words are separated by ASCII white space and stay unchanged. A word is removed if a window of ``window`` consecutive
    words covers it that also starts in a document with a smaller id, judged on the input. Null texts count as empty. Rows
    with a null id lose nothing and are no source. Rows that repeat an id are the same document and don't remove each
    other's words. An empty table gives no rows.
    """
    if not 0 < gram <= window:
        raise ValueError("gram must be between 1 and window")
    texts = _texts(docs, id_col, text_col)
    # Whatever may hold a hot key (an anchor, a text with many copies) is joined as a plain stored table, which leaves Spark
    # free to split the key's rows over several tasks; it can't do that above a grouping. Whole texts are only moved by
    # ``own``, the row's id and text together, which has no hot values; both joins of texts share that exchange.
    key, own = ["t1", "t2"], ["row", "t1", "t2"]
    firsts = stage(texts.groupBy(*key).agg(F.min("id").alias("first_id")), "first-ids")
    rows = stage(texts.select("id", *own).distinct().join(firsts, key), "rows")
    reps = rows.filter("id = first_id").select(*own, "first_id")
    seeds = stage(_seeds(texts.filter("id is not null"), window, gram), "anchors")
    recurring = stage(seeds.groupBy("anchor").agg(F.min("t1").alias("low"), F.max("t1").alias("high")).filter(
        "low <> high").select("anchor"), "recurring-anchors")
    shared = stage(seeds.join(recurring, "anchor", "left_semi").dropDuplicates([*key, "lo"]).join(firsts, key), "seeds")

    owners = stage(shared.groupBy("anchor", "block").agg(F.min("first_id").alias("owner")), "block-owners")
    mixed = stage(owners.groupBy("anchor").agg(F.min("block").alias("low"), F.max("block").alias("high")).select(
        "anchor", (F.col("low") != F.col("high")).alias("mixed")), "mixed-anchors")
    settled = stage(shared.join(owners, ["anchor", "block"]).join(mixed, "anchor").select(
        *key, "first_id", F.struct("lo", "hi").alias("range"), (F.col("first_id") > F.col("owner")).alias("late"),
        "mixed"), "blocks")

    opened = settled.filter("mixed and not late").groupBy(*key).agg(F.collect_list("range").alias("ranges")).join(reps, key)
    windows = _windows(texts.join(opened, own), window)
    window_owners = windows.groupBy("w1", "w2").agg(
        F.min("first_id").alias("owner"), F.max("first_id").alias("last")).filter("owner < last").drop("last")
    late = windows.join(window_owners, ["w1", "w2"]).filter("first_id > owner").select(
        *key, F.struct(F.col("start").alias("lo"), F.col("start").alias("hi")).alias("range"))
    ranges = settled.filter("late").select(*key, "range").unionByName(late).groupBy(*key).agg(
        F.collect_set("range").alias("ranges")).join(reps, key).select(*own, "ranges")
    verdicts = rows.select(*own, F.coalesce(F.col("id") > F.col("first_id"), F.lit(False)).alias("copy")).join(
        ranges, own, "left")
    return texts.join(verdicts, own).withColumn("cut", _cut(window)("text", "copy", "ranges")).select("id", "cut.*")
