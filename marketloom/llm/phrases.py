"""Phrase collocations: n-gram counts in weighted acyclic automata, summed by prefix range, composed for part lookups.

1. *Shards.* A task cuts its texts into pieces and words and collects up to ``SHARD_WORDS`` words. Their sorted n-grams
   become count automata, one for each language and prefix range: an interval of the hash codes of a phrase's first two
   words. Only automata are shuffled; a phrase that a third of all documents share is one path of each shard.
2. *Union.* The automata of a range are united and their weights summed; paths below the least count are cut.
3. *Three depths.* The first pass counts words, the second pairs, the third longer phrases. A phrase can only be frequent
   if all its words and pairs are, so later passes skip what a filter of fixed size over the frequent words or pairs doesn't
   know. The filters lose nothing; full, they would only spare less.
4. *Parts.* The parts of every candidate are dealt to the ranges of their own prefixes, where the acceptors of the parts are
   composed with the range's automata of all depths; the weights at the ends are the counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketloom.llm.automata import CountAutomaton
from marketloom.llm.common import map_columns, stage
from marketloom.llm.keyfilter import KeyFilter
from marketloom.llm.wordhash import ODD, OTHER, mixed

LONGEST = 4
MIN_COUNT = 30
TOP = 2000
COVER = 80  # percent of a phrase's count within one longer phrase that make it a mere part
SCALE = 2_000_000
SHARD_WORDS = 1 << 20
RANGE_BYTES = 16 << 20  # of text for each prefix range
UNKNOWN = "und"
BREAK = b"\xff"  # never part of UTF-8
SEPARATE = bytes(0x0A if chr(c) in ".,;:!?\n\x0b\x0c\r" else 0x20 if c == 9 else c for c in range(256)).lower()


def tokens_of(text: bytes | None) -> list[bytes]:
    """Words of all pieces, with a break behind every piece."""
    return (text or b"").translate(SEPARATE).replace(b"\n", b" \xff ").split() + [BREAK]


def word_hash(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word, 13) or 1


class _Numbers(dict):
    """Numbers of words in the order of their first occurrence; the break is 0."""

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number


class _Shard:
    """Words of up to ``SHARD_WORDS`` tokens, by language."""

    def __init__(self):
        self.numbers = _Numbers({BREAK: 0})
        self.held: dict[str, list[np.ndarray]] = {}
        self.size = 0

    def add(self, lang: str, text: bytes | None) -> None:
        tokens = tokens_of(text)
        own = np.fromiter(map(self.numbers.__getitem__, tokens), np.int32, len(tokens))
        self.held.setdefault(lang, []).append(own)
        self.size += len(own)

    def languages(self) -> Iterator[tuple[str, np.ndarray, np.ndarray, list[bytes]]]:
        """Language, word numbers (0 breaks), hash of each number, word of each number."""
        words = list(self.numbers)
        hashes = np.array([0, *map(word_hash, words[1:])], np.uint64)
        for lang, parts in self.held.items():
            yield lang, np.concatenate(parts).astype(np.int64), hashes, words


def prefix_codes(rows: np.ndarray) -> np.ndarray:
    return mixed(rows[:, 0] * np.uint64(ODD) + rows[:, 1] * np.uint64(OTHER))


def _ranges(rows: np.ndarray, ranges: int) -> np.ndarray:
    if rows.shape[1] == 1:
        rows = np.pad(rows, ((0, 0), (0, 1)))
    return ((prefix_codes(rows) >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int32)


def _own_hash(lang: str) -> np.uint64:
    return np.uint64(xxhash.xxh3_64_intdigest(lang.encode(), 17))


def word_keys(lang: str, hashes: np.ndarray) -> np.ndarray:
    """Keys of words in a filter."""
    return mixed(hashes * np.uint64(OTHER) + _own_hash(lang)).view(np.int64)


def pair_keys(lang: str, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Keys of pairs of words in a filter."""
    return mixed(mixed(first * np.uint64(ODD) + _own_hash(lang)) + second).view(np.int64)


def _stored_keys(langs: list, packed: list) -> list[np.ndarray]:
    """Filter keys of the longest phrases (one or two words) in stored automata of such depth."""
    keys = [np.empty(0, np.int64)]
    for lang, data in zip(langs, packed):
        rows, _ = CountAutomaton.unpacked(data).rows()
        rows = rows[rows[:, -1] != 0]
        keys.append(word_keys(lang, rows[:, 0]) if rows.shape[1] == 1 else pair_keys(lang, rows[:, 0], rows[:, 1]))
    return [np.concatenate(keys)]


def _distinct(before: np.ndarray, word: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For phrases given by the number of all but the last word and the last word: first places, numbers, counts."""
    _, first, number, counts = np.unique(before * size + word, return_index=True, return_inverse=True, return_counts=True)
    return first, number, counts


def _words(words: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Single words and their counts."""
    counts = np.bincount(words, minlength=len(hashes))
    counts[0] = 0
    seen = np.flatnonzero(counts)
    return hashes[seen][:, None], counts[seen]


def _pairs(words: np.ndarray, hashes: np.ndarray, lang: str, known: KeyFilter) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of ``known`` words, and their counts."""
    frequent = known.has(word_keys(lang, hashes))
    frequent[0] = False
    words = np.where(frequent[words], words, 0)
    at = np.flatnonzero((words[:-1] != 0) & (words[1:] != 0))
    codes = np.sort(words[at] * len(hashes) + words[at + 1])
    first = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]]) if len(codes) else np.empty(0, np.int64)
    counts = np.diff(np.append(first, len(codes)))
    return hashes[np.column_stack(np.divmod(codes[first], len(hashes)))], counts


def _long(words: np.ndarray, hashes: np.ndarray, lang: str, known: KeyFilter, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Phrases of three and more words whose pairs all are ``known``, and their counts."""
    out = []
    at = np.flatnonzero((words[:-1] != 0) & (words[1:] != 0))
    frequent = np.zeros(len(words) + longest, bool)
    frequent[at] = known.has(pair_keys(lang, hashes[words[at]], hashes[words[at + 1]]))
    at = np.flatnonzero(frequent)
    _, number, _ = _distinct(words[at], words[np.minimum(at + 1, len(words) - 1)], len(hashes))
    for length in range(3, longest + 1):
        on = frequent[at + length - 2]
        at, number = at[on], number[on]
        first, number, n = _distinct(number, words[at + length - 1], len(hashes))
        rows = np.zeros((len(first), longest), np.uint64)
        for d in range(length):
            rows[:, d] = hashes[words[at[first] + d]]
        out.append((rows, n))
    rows, n = (np.concatenate(x) for x in zip(*out)) if out else (np.zeros((0, longest), np.uint64), np.zeros(0, np.int64))
    return rows, n


def _sharded(texts: DataFrame, ranges: int, count, named: bool) -> DataFrame:
    """``range``, ``lang``, ``automaton``, ``words`` of every shard. ``count(words, hashes, lang)`` returns phrases and
    counts; with ``named`` these are single words, which are spelt out."""
    schema = pa.schema([("range", pa.int32()), ("lang", pa.string()), ("automaton", pa.binary()),
                        ("words", pa.list_(pa.binary()))])

    def cut(shard: _Shard) -> Iterator[pa.RecordBatch]:
        for lang, numbers, hashes, words in shard.languages():
            rows, counts = count(numbers, hashes, lang)
            place = _ranges(rows, ranges)
            order = np.lexsort((*rows.T[::-1], place))
            rows, counts, place = rows[order], counts[order], place[order]
            by_hash = np.argsort(hashes)
            out = []
            for part in np.split(np.arange(len(rows)), np.flatnonzero(np.diff(place)) + 1) if len(rows) else ():
                own = None
                if named:
                    own = [words[i] for i in by_hash[np.searchsorted(hashes, rows[part, 0], sorter=by_hash)]]
                out.append((int(place[part[0]]), lang, CountAutomaton.build(rows[part], counts[part]).packed(), own))
                if len(out) == 64:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = _Shard()
        for batch in batches:
            for lang, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist()):
                shard.add(lang, text)
                if shard.size >= SHARD_WORDS:
                    yield from cut(shard)
                    shard = _Shard()
        yield from cut(shard)

    return texts.mapInArrow(run, "range int, lang string, automaton binary, words array<binary>")


UNITED = "range int, lang string, automaton binary, words array<binary>, total long"


def _united(table: pa.Table, least: int, depth: int) -> pa.Table:
    """One row for each language of a range: the automaton of its frequent phrases, its frequent words (in the order of
    their hashes) and the sum of all its single-word counts."""
    out: dict[str, list] = {"range": [], "lang": [], "automaton": [], "words": [], "total": []}
    langs = table["lang"].to_pylist()
    for lang in sorted(set(langs)):
        mine = [n for n, x in enumerate(langs) if x == lang]
        rows, weights = CountAutomaton.union((CountAutomaton.unpacked(table["automaton"][n].as_py()) for n in mine), depth)
        words = {w for n in mine for w in table["words"][n].as_py() or ()}
        named = {word_hash(w): w for w in words}
        if len(named) < len(words):
            raise ValueError("two words have one hash")
        out["total"].append(int(weights[(rows != 0).sum(axis=1) == 1].sum()))
        rows, weights = rows[weights >= least], weights[weights >= least]
        out["words"].append([named[h] for h in rows[:, 0].tolist()] if named else [])
        out["range"].append(table["range"][0].as_py())
        out["lang"].append(lang)
        out["automaton"].append(CountAutomaton.build(rows, weights).packed())
    return pa.table([pa.array(out["range"], pa.int32()), pa.array(out["lang"]), pa.array(out["automaton"], pa.binary()),
                     pa.array(out["words"], pa.list_(pa.binary())), pa.array(out["total"], pa.int64())], names=list(out))


def _phrases(index: DataFrame, least: int) -> DataFrame:
    """``lang``, ``phrase`` (word hashes), ``a`` (count) of all phrases of ``least`` or more words in stored automata."""

    def spell(langs: list, packed: list) -> tuple:
        owners, phrases, counts = [], [], []
        for lang, data in zip(langs, packed):
            rows, weights = CountAutomaton.unpacked(data).rows()
            sizes = (rows != 0).sum(axis=1)
            wide = sizes >= least
            owners += [lang] * int(wide.sum())
            phrases += [row[:n] for row, n in zip(rows[wide].view(np.int64).tolist(), sizes[wide].tolist())]
            counts.append(weights[wide])
        return owners, phrases, pa.array(np.concatenate(counts) if counts else [], pa.int64())

    return map_columns(index.select("lang", "automaton"), spell, "lang string, phrase array<long>, a long")


def _matrix(phrases: list[list[int]], depth: int) -> np.ndarray:
    out = np.zeros((len(phrases), depth), np.int64)
    for n, phrase in enumerate(phrases):
        out[n, : len(phrase)] = phrase
    return out.view(np.uint64)


def _part_counts(parts: DataFrame, index: DataFrame, ranges: int, depth: int) -> DataFrame:
    """``lang``, ``part``, ``f``: counts of ``parts`` (``lang``, ``part``) by composition with the automata of their ranges."""
    asked = map_columns(parts, lambda langs, phrases: (
        pa.array(_ranges(_matrix(phrases, depth), ranges)), langs, phrases), "range int, lang string, part array<long>")

    def compose(asked: pa.Table, stored: pa.Table) -> pa.Table:
        langs = asked["lang"].to_pylist()
        phrases = _matrix(asked["part"].to_pylist(), depth)
        counts = np.zeros(len(langs), np.int64)
        own = np.array(langs, object)
        for lang, data in zip(stored["lang"].to_pylist(), stored["automaton"].to_pylist()):
            mine = np.flatnonzero(own == lang)
            if len(mine):
                counts[mine] += CountAutomaton.unpacked(data).weights_of(phrases[mine])
        return pa.table([asked["lang"], asked["part"], pa.array(counts)], names=["lang", "part", "f"])

    return asked.groupBy("range").cogroup(index.select("range", "lang", "automaton").groupBy("range")).applyInArrow(
        compose, "lang string, part array<long>, f long")


def _exact(name: str, factor: int = 1):
    return F.col(name).cast("decimal(19,0)") * F.lit(factor).cast("decimal(10,0)")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", min_count: int = MIN_COUNT,
                 longest: int = LONGEST, top: int = TOP, cover: int = COVER) -> DataFrame:
    """``lang``, ``rank`` (from 1), ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score`` of each language's best phrases.

    Texts are lower-cased (A-Z), split into pieces at ``.,;:!?`` and line ends, and those into words at spaces and tabs. A
    candidate is a phrase of 2 to ``longest`` words that occurs ``min_count`` times or more within pieces (``a``). Its score
    is floor(2000000 * a / (l + r)) for the counts of both parts at the cut that scores lowest (of equal ones the first).
    Candidates inside a longer candidate that has ``cover`` percent of their count go. Order: score, then count, both
    falling, then phrase by its bytes. ``n`` counts all words of the language. A null language is ``und``, null texts are
    empty, repeated rows count each time, whatever their other columns hold. Empty tables, and languages without
    candidates, give no rows.
    """
    if longest < 2:
        raise ValueError("a phrase has two words at least")
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN)).alias("lang"),
                        F.col(text_col).cast("string").cast("binary").alias("text"))
    size = texts.agg(F.sum(F.octet_length("text")).alias("bytes")).first()["bytes"] or 0
    ranges = 1 + size // RANGE_BYTES

    def united(count, depth: int) -> DataFrame:
        return stage(_sharded(texts, ranges, count, depth == 1).groupBy("range").applyInArrow(
            lambda t: _united(t, min_count, depth), UNITED), f"phrases-{depth}")

    def keys(counted: DataFrame) -> KeyFilter:
        return KeyFilter.of(map_columns(counted.select("lang", "automaton"), _stored_keys, "key long"))

    single = united(lambda words, hashes, _: _words(words, hashes), 1)
    words_known = keys(single)
    pairs = united(lambda words, hashes, lang: _pairs(words, hashes, lang, words_known), 2)
    index = single.unionByName(pairs)
    if longest > 2:
        pairs_known = keys(pairs)
        index = index.unionByName(
            united(lambda words, hashes, lang: _long(words, hashes, lang, pairs_known, longest), longest))
    found = stage(_phrases(index, 2), "candidates")

    cuts = found.withColumn("k", F.explode(F.expr("sequence(1, size(phrase) - 1)"))).withColumns({
        "left": F.expr("slice(phrase, 1, k)"), "right": F.expr("slice(phrase, k + 1, size(phrase) - k)")})
    parts = cuts.select("lang", F.explode(F.array("left", "right")).alias("part")).distinct()
    counts = stage(_part_counts(parts, index, ranges, longest), "part-counts")
    best = cuts.join(counts.select("lang", F.col("part").alias("left"), F.col("f").alias("l")), ["lang", "left"]).join(
        counts.select("lang", F.col("part").alias("right"), F.col("f").alias("r")), ["lang", "right"]).withColumn(
        "score", F.expr(f"cast(cast({SCALE} as decimal(7,0)) * cast(a as decimal(19,0)) div "
                        "(cast(l as decimal(19,0)) + cast(r as decimal(19,0))) as long)")).groupBy("lang", "phrase").agg(
        F.min(F.struct("score", "k", "l", "r", "a")).alias("cut"))

    inner = found.filter("size(phrase) > 2").select("lang", "a", F.explode(F.expr(
        "flatten(transform(sequence(2, size(phrase) - 1), s -> "
        "transform(sequence(1, size(phrase) - s + 1), i -> slice(phrase, i, s))))")).alias("phrase"))
    covered = inner.groupBy("lang", "phrase").agg(F.max("a").alias("most"))
    kept = best.select("lang", "phrase", "cut.*").join(covered, ["lang", "phrase"], "left").filter(
        F.col("most").isNull() | (_exact("most", 100) < _exact("a", cover)))

    by_score = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc())
    near = kept.withColumn("place", F.rank().over(by_score)).filter(F.col("place") <= top)  # all that tie with the last
    words = map_columns(single.select("lang", "words"), lambda langs, own: (
        [lang for lang, w in zip(langs, own) for _ in w], [np.uint64(word_hash(x)).astype(np.int64) for w in own for x in w],
        [x.decode("utf-8", "replace") for w in own for x in w]), "lang string, word long, spelt string")
    spelt = near.select("lang", "phrase", F.posexplode("phrase").alias("at", "word")).join(words, ["lang", "word"]).groupBy(
        "lang", "phrase").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "spelt"))), lambda x: x[
            "spelt"]), " ").alias("spelt"))
    totals = single.groupBy("lang").agg(F.sum("total").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "spelt")
    ranked = near.join(spelt, ["lang", "phrase"]).withColumn("rank", F.row_number().over(order).cast("long")).filter(
        F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", F.col("spelt").alias("phrase"), "a", "l", "r", "n", "score")
