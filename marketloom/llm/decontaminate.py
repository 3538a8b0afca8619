"""Benchmark decontamination by winnowing: fingerprints select places, the windows around them are joined.

Of every run of ``window - gram + 1`` consecutive k-grams the smallest hash is a fingerprint, so every window of ``window``
words has exactly one, and equal windows have equal ones. Items shorter than a window get their own class of window length
(at most ``window`` classes), so that each of them is found as well.

1. Fingerprints of the benchmark go into a filter of fixed size. Documents are read once; where a fingerprint passes, the
   windows that it stands for extend it both ways, and their 128-bit hashes are sent. A document without such a place sends
   nothing, and one with many sends a row for each word at most, however many items share the phrase.
2. Windows are joined to the windows of the benchmark by their hashes. A window leads to the number of its *set of items*,
   so a phrase that most items share is one row for each place, not one for each place and item.
3. Hit words follow from the windows of a text, items from its distinct sets. Texts with hits are few and carry no text; a
   second filter marks their documents, the others never meet a join.

Copies of a text are searched once: all work is keyed by the text's hash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.llm.common import map_columns, stage, text_slices, worker_cache
from marketloom.llm.keyfilter import KeyFilter
from marketloom.llm.wordhash import ODD, OTHER, WordHashes, mixed, rolling, spans, winnowed

WINDOW, GRAM = 13, 5
#: Word characters are digits, a-z and everything beyond ASCII; A-Z become a-z, the rest separates.
TABLE = bytes(c if c > 0x7F or chr(c).isalnum() else 0x20 for c in range(256)).lower()


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(TABLE).split()


def word_class(n_words: int, window: int = WINDOW) -> int:
    """Length of the windows of an item: ``window``, or all its words if they are fewer."""
    return min(n_words, window)


def prints(hashes: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprint positions and hashes for windows of ``length`` words."""
    k = min(gram, length)
    grams = rolling(hashes, k)
    at = np.unique(winnowed(grams, length - k + 1))
    return at, grams[at].view(np.int64)


def _classes(benchmark: DataFrame, text_col: str, window: int) -> list[int]:
    """Window lengths that occur in the benchmark, at most ``window`` numbers."""
    lengths = map_columns(
        benchmark.select(F.col(text_col).cast("string").cast("binary")),
        lambda texts: [sorted({word_class(len(words_of(t)), window) for t in texts})], "length int")
    return sorted(r.length for r in lengths.distinct().collect() if r.length)


def _windows(hashes: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all windows of ``length`` words, and the filter key of each one's fingerprint."""
    k = min(gram, length)
    grams = rolling(hashes, k)
    at = winnowed(grams, length - k + 1)
    return np.arange(len(at)), mixed(grams[at] + np.uint64(length)).view(np.int64)


def _codes(hashes: np.ndarray, starts: np.ndarray, length: int) -> list[np.ndarray]:
    """128-bit hashes of windows, as two longs."""
    size = np.uint64(length)
    return [(spans(hashes, starts, starts + length, odd) + size).view(np.int64) for odd in (ODD, OTHER)]


def _hashes(text: bytes | None) -> np.ndarray:
    return worker_cache("word hashes").setdefault(0, WordHashes()).of(words_of(text))


def _item_windows(items: DataFrame, window: int, gram: int) -> DataFrame:
    """``id``, ``print``, ``w1``, ``w2`` of all windows of the items (``id``, ``text``)."""

    def cut(ids: list, texts: list) -> list:
        owners, columns = [], [[np.empty(0, np.int64)] for _ in range(3)]
        for owner, text in zip(ids, texts):
            hashes = _hashes(text)
            if len(hashes):
                length = word_class(len(hashes), window)
                starts, prints = _windows(hashes, length, gram)
                owners += [owner] * len(starts)
                for column, values in zip(columns, (prints, *_codes(hashes, starts, length))):
                    column.append(values)
        return [owners, *map(np.concatenate, columns)]

    return map_columns(items, cut, "id long, print long, w1 long, w2 long")


def _candidates(texts: DataFrame, known: KeyFilter, classes: list[int], gram: int) -> DataFrame:
    """``t1``, ``t2``, ``start``, ``end``, ``w1``, ``w2`` of the windows whose fingerprint is ``known``."""

    def cut(t1: list, t2: list, texts: list) -> list:
        counts, columns = [], [[np.empty(0, np.int64)] for _ in range(4)]
        for text in texts:
            hashes = _hashes(text)
            sent = 0
            for length in classes:
                starts, prints = _windows(hashes, length, gram)
                starts = starts[known.has(prints)]
                if len(starts):
                    sent += len(starts)
                    for column, values in zip(columns, (starts, starts + length, *_codes(hashes, starts, length))):
                        column.append(values)
            counts.append(sent)
        found = [np.concatenate(c) for c in columns]
        return [*(np.repeat(np.array(t, np.int64), counts) for t in (t1, t2)), *(c.astype(np.int32) for c in found[:2]),
                *found[2:]]

    return map_columns(texts, cut, "t1 long, t2 long, start int, end int, w1 long, w2 long")


def _word_counts(marks: KeyFilter, marked: bool, key: Column, text: Column) -> Column:
    """Number of words of the texts whose key is in the filter, or of all others; null for the rest. One function tests and
    counts, so that a task needs one Python worker."""

    @F.arrow_udf("bigint")
    def count(keys: pa.Array, texts: pa.Array) -> pa.Array:
        wanted = marks.has(keys.to_numpy(zero_copy_only=False)) == marked
        return pa.array([len(words_of(t)) if w else None for w, t in zip(wanted.tolist(), text_slices(texts))], pa.int64())

    return count(key, text)


def overlaps(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id",
             item_text: str = "text", window: int = WINDOW, gram: int = GRAM) -> tuple[DataFrame, Column]:
    """``docs`` with a helper column, and that struct column: ``n_words``, ``n_hit``, ``items`` (ids, ascending), ``spans``
    (``start``, ``end`` of maximal runs of overlapping matched windows, in words, end exclusive).

    A document word is hit if it lies inside an occurrence of ``window`` consecutive words of an item, or of the whole item
    if that is shorter. Null and empty texts have no words; items without words match nothing; items that repeat a text
    are all named, items with a null id hit words but are not named. Every input row comes back once, also repeated rows and
    rows with null ids. An empty benchmark hits nothing.
    """
    items = benchmark.select(F.col(item_id).cast("long").alias("id"), F.col(item_text).cast("string").cast("binary").alias("text"))
    test = stage(_item_windows(items, window, gram), "item-windows")
    known = KeyFilter.of(test.select("print"))
    classes = _classes(benchmark, item_text, window)
    text = F.col(text_col).cast("string").cast("binary")
    keys = [F.xxhash64(text), F.xxhash64(F.lit(1), text)]
    # stored as plain tables: Spark can then split a window, or a text, that very many rows share
    sets = stage(test.groupBy("w1", "w2").agg(F.sort_array(F.collect_set("id")).alias("ids")).withColumns(
        {"s1": F.xxhash64("ids"), "s2": F.xxhash64(F.lit(1), "ids")}), "window-items")
    sent = stage(_candidates(docs.select(keys[0].alias("t1"), keys[1].alias("t2"), text.alias("text")), known, classes,
                             gram).distinct(), "candidate-windows")
    met = stage(sent.join(sets.drop("ids"), ["w1", "w2"]).select("t1", "t2", "start", "end", "s1", "s2"), "matched-windows")
    ranges = F.sort_array(F.collect_set(F.struct("start", "end")))  # a text's own windows
    runs = met.groupBy("t1", "t2").agg(_merged(ranges).alias("spans"))
    named = met.select("t1", "t2", "s1", "s2").distinct().join(
        sets.select("s1", "s2", "ids").dropDuplicates(["s1", "s2"]), ["s1", "s2"]).select(
        "t1", "t2", F.explode_outer("ids").alias("id")).groupBy("t1", "t2").agg(F.sort_array(F.collect_set("id")).alias("items"))
    hits = stage(runs.join(named, ["t1", "t2"]).select(F.col("t1").alias("_loom_t1"), F.col("t2").alias("_loom_t2"), F.struct(
        F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + (s["end"] - s["start"])).alias("n_hit"),
        "items", "spans").alias("_loom_hit")), "hit-texts")
    marked = docs.withColumns({"_loom_t1": keys[0], "_loom_t2": keys[1]})
    marks = KeyFilter.of(hits.select("_loom_t1"))
    part = lambda kept: marked.withColumn("_loom_n", _word_counts(marks, kept, F.col("_loom_t1"), text)).filter(
        "_loom_n is not null")
    clean = part(False).withColumn("_loom_hit", F.lit(None).cast(hits.schema["_loom_hit"].dataType))
    dirty = part(True).join(hits, ["_loom_t1", "_loom_t2"], "left").select(*clean.columns)
    found = F.struct(F.col("_loom_n").alias("n_words"), F.coalesce("_loom_hit.n_hit", F.lit(0).cast("long")).alias("n_hit"),
                     F.coalesce("_loom_hit.items", F.array().cast("array<bigint>")).alias("items"),
                     F.coalesce("_loom_hit.spans", F.array().cast("array<struct<start:int,`end`:int>>")).alias("spans"))
    every = clean.unionByName(dirty).withColumn("_loom_found", found)
    return every.drop("_loom_t1", "_loom_t2", "_loom_n", "_loom_hit"), F.col("_loom_found")


def _merged(ranges: Column) -> Column:
    """Maximal runs of sorted ranges that overlap."""
    none = F.array().cast("array<struct<start:int,`end`:int>>")

    def add(runs: Column, one: Column) -> Column:
        last = F.element_at(runs, -1)
        longer = F.struct(last["start"].alias("start"), F.greatest(last["end"], one["end"]).alias("end"))
        joins = (F.size(runs) > 0) & (one["start"] < F.try_element_at(runs, F.lit(-1))["end"])
        return F.when(joins, F.concat(F.slice(runs, 1, F.size(runs) - 1), F.array(longer))).otherwise(
            F.concat(runs, F.array(one)))

    return F.aggregate(ranges, none, add)


def contaminated(found: Column) -> Column:
    """At least one word is hit, and at least a twentieth of all words."""
    return (found["n_hit"] > 0) & (found["n_hit"] * 20 >= found["n_words"])


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """``docs`` without contaminated documents; all columns stay."""
    joined, found = overlaps(docs, benchmark, text_col, **options)
    return joined.filter(~contaminated(found)).select(*docs.columns)


def joined_digest(ids: Column) -> Column:
    """SHA-256 of ids, sorted as strings and joined by commas."""
    return F.sha2(F.concat_ws(",", F.array_sort(ids.cast("array<string>"))), 256)

