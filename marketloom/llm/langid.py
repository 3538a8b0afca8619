"""Language ID: script ranges narrow the candidates, per-word scores and a Viterbi path label spans of mixed texts.

A word's score for a language is the sum of the log probabilities of its character n-grams. The best path over the words of
a text pays ``SWITCH`` for every change of language, so single odd words don't break a span while whole sentences in
another language do. A language is a candidate of a word only if it was learned with that script; a word in a script that
nobody was learned with says nothing. Paths of all texts of a batch advance together, word by word, in numpy.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.llm.common import worker_cache
from marketloom.llm.wordhash import mixed

ORDERS = (1, 2, 3)
BITS = 16
SWITCH = 14.0
MAX_PER_LANGUAGE = 4_000  # texts a language is learned from (expected number of a hash sample)
RARE_SCRIPT = 0.01  # a language has a script if this part of its words are written in it
UNKNOWN = "und"
KEPT_WORDS = 150_000
CHUNK = 1 << 22  # cells (words times languages) of one Viterbi pass
HELD_WORDS = 100_000  # words held as strings at a time
WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")  # letters with their marks; lower-casing one word never gives two
#: First code points of the ranges that tell scripts apart, with the script that starts there (fixed values of Unicode).
SCRIPTS = [
    (0x0, "latin"), (0x370, "greek"), (0x400, "cyrillic"), (0x530, "armenian"), (0x590, "hebrew"), (0x600, "arabic"),
    (0x900, "devanagari"), (0x980, "bengali"), (0xA00, "gurmukhi"), (0xA80, "gujarati"), (0xB80, "tamil"),
    (0xC00, "telugu"), (0xC80, "kannada"), (0xD00, "malayalam"), (0xE00, "thai"), (0xE80, "lao"), (0x10A0, "georgian"),
    (0x1100, "hangul"), (0x1200, "ethiopic"), (0x1780, "khmer"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2C00, "other"),
    (0x2C60, "latin"), (0x2C80, "other"), (0x3040, "kana"), (0x3100, "other"), (0x3400, "han"), (0xA000, "other"),
    (0xA640, "cyrillic"), (0xA720, "latin"), (0xA800, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"),
    (0xFB00, "latin"), (0xFB10, "other"), (0xFB50, "arabic"), (0xFE00, "other"), (0x20000, "han"), (0x32000, "other"),
]
STARTS = [s for s, _ in SCRIPTS]


def script(word: str) -> str:
    return SCRIPTS[bisect_right(STARTS, ord(word[0])) - 1][1]


def gram_buckets(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of all words (each bordered by spaces), and the number of the word of each."""
    flat = np.frombuffer("".join([f" {w} " for w in words]).encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(words)), [len(w) + 2 for w in words])
    chars, buckets, owners = flat.astype(np.uint64), [], []
    h = chars
    for n in range(1, max(ORDERS) + 1):
        if n > 1:
            h = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + chars[n - 1:]
        if n in ORDERS and len(h):
            inside = owner[: len(owner) - n + 1] == owner[n - 1:]
            buckets.append((mixed(h + np.uint64(n)) >> np.uint64(64 - BITS)).astype(np.int64)[inside])
            owners.append(owner[: len(owner) - n + 1][inside])
    return np.concatenate(buckets), np.concatenate(owners)


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    table: np.ndarray  # log probability of each bucket (row) in each language
    scripts: dict[str, np.ndarray]  # script -> which languages are written in it
    switch: float = SWITCH

    def word_scores(self, words: list[str]) -> np.ndarray:
        buckets, owners = gram_buckets(words)
        order = np.argsort(owners, kind="stable")
        first = np.searchsorted(owners[order], np.arange(len(words)))
        scores = np.add.reduceat(self.table[buckets[order]], first, axis=0)
        for n, word in enumerate(words):
            named = self.scripts.get(script(word))
            if named is None:
                scores[n] = 0
            elif not named.all():
                scores[n, ~named] = -np.inf
        return np.where(np.isneginf(scores), -1e6, scores).astype(np.float32)

    def fresh_memory(self) -> dict:
        """Words seen by this worker with their scores and lengths; emptied here, and only here, when it is full."""
        memory = worker_cache("word languages")
        if memory.get("of") is not self.table or len(memory["row"]) > KEPT_WORDS:
            memory.update({"of": self.table, "row": {}, "scores": np.empty((0, len(self.languages)), np.float32),
                           "lengths": np.empty(0, np.int32)})
        return memory

    def codes(self, texts: list[list[str]], memory: dict) -> list[np.ndarray]:
        """The words of each text as rows of the memory."""
        row = memory["row"]
        new = list({w for words in texts for w in words if w not in row})
        if new:
            memory["scores"] = np.concatenate([memory["scores"], self.word_scores(new)])
            memory["lengths"] = np.concatenate([memory["lengths"], np.fromiter(map(len, new), np.int32, len(new))])
            row.update(zip(new, range(len(row), len(row) + len(new))))
        return [np.fromiter(map(row.__getitem__, words), np.int32, len(words)) for words in texts]


def best_paths(codes: list[np.ndarray], scores: np.ndarray, switch: float) -> list[np.ndarray]:
    """Viterbi over all texts at once, longest first, so that the texts still running are a prefix."""
    lengths = np.array([len(c) for c in codes])
    order = np.argsort(-lengths, kind="stable")
    sizes = lengths[order]
    if not len(sizes) or not sizes[0]:
        return [np.empty(0, np.int64) for _ in codes]
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    flat = np.concatenate([codes[i] for i in order])
    running = np.searchsorted(-sizes, -np.arange(sizes[0]), side="left")  # texts longer than t
    total = np.zeros((len(sizes), scores.shape[1]), np.float32)
    jumps, leaders = [], []
    for t, n in enumerate(running):
        leader = total[:n].argmax(axis=1)
        cap = total[np.arange(n), leader] - np.float32(switch)
        jump = total[:n] < cap[:, None]
        np.maximum(total[:n], cap[:, None], out=total[:n])
        total[:n] += scores[flat[starts[:n] + t]]
        total[:n] -= total[:n].max(axis=1, keepdims=True)  # only differences matter; keeps single precision exact enough
        jumps.append(jump)
        leaders.append(leader.astype(np.int16))
    out = np.empty(len(flat), np.int16)
    state = total.argmax(axis=1)
    for t in range(len(running) - 1, -1, -1):
        n = running[t]
        out[starts[:n] + t] = state[:n]
        state[:n] = np.where(jumps[t][np.arange(n), state[:n]], leaders[t], state[:n])
    found: list[np.ndarray] = [np.empty(0, np.int64)] * len(codes)
    for place, i in enumerate(order):
        found[i] = out[starts[place]: starts[place] + sizes[place]]
    return found


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", max_per_language: int = MAX_PER_LANGUAGE,
        switch: float = SWITCH) -> LanguageModel:
    """Learn from the rows with a text and a language. Of a language with more than ``max_per_language`` texts a hash sample
    of about that size is used. What comes to the driver is one row per language and bucket (at most 2^BITS each)."""
    rows = docs.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).filter(
        "text is not null and lang is not null")
    sizes = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    share = F.least(F.lit(1.0), F.lit(float(max_per_language)) / F.col("n")) * (1 << 30)
    sample = rows.join(F.broadcast(sizes), "lang").filter(  # one row per language
        F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < share).select("text", "lang")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, scripts = {}, {}
        for batch in batches:
            for text, lang in zip(*[c.to_pylist() for c in batch.columns]):
                words = WORD.findall(text.lower())
                if words:
                    own = seen.setdefault(lang, np.zeros(1 << BITS, np.int64))
                    own += np.bincount(gram_buckets(words)[0], minlength=1 << BITS)
                    written = scripts.setdefault(lang, {})
                    for w in words:
                        name = script(w)
                        written[name] = written.get(name, 0) + 1
        out = [(lang, int(b), None, int(own[b])) for lang, own in seen.items() for b in np.flatnonzero(own)]
        out += [(lang, None, name, n) for lang, own in scripts.items() for name, n in own.items()]
        columns = list(zip(*out)) or [[]] * 4
        kinds = (pa.string(), pa.int64(), pa.string(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)],
                                         names=["lang", "bucket", "script", "n"])

    counts = sample.mapInArrow(count, "lang string, bucket long, script string, n long").groupBy(
        "lang", "bucket", "script").agg(F.sum("n").alias("n")).toArrow()
    languages = sorted(set(counts["lang"].to_pylist()))
    number = {lang: i for i, lang in enumerate(languages)}
    table = np.full((1 << BITS, len(languages)), 0.5)
    scripts: dict[str, np.ndarray] = {}
    for lang, bucket, name, n in zip(*(counts[c].to_pylist() for c in ("lang", "bucket", "script", "n"))):
        if name is None:
            table[bucket, number[lang]] += n
        else:
            scripts.setdefault(name, np.zeros(len(languages)))[number[lang]] = n
    words = sum(scripts.values(), np.zeros(len(languages)))
    used = {name: n >= RARE_SCRIPT * words for name, n in scripts.items()}
    return LanguageModel(languages, np.log(table / table.sum(axis=0)).astype(np.float32),
                         {name: u for name, u in used.items() if u.any()}, switch)


def labelled(text: Column, model: LanguageModel, spans: bool = False) -> Column:
    """Struct ``lang``, ``score`` and ``spans`` (``start``, ``end`` in code points, ``lang``; null unless asked for).

    ``lang`` is the language of most letters on the best path (ties: the first by name), ``score`` its part of all letters.
    Null texts and texts without letters are ``und`` with score zero and no spans, as is everything if no language was
    learned. Whole texts are labelled, whatever their length.
    """
    span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())])
    kind = pa.struct([("lang", pa.string()), ("score", pa.float64()), ("spans", pa.list_(span))])

    @F.arrow_udf("struct<lang string, score double, spans array<struct<start bigint, `end` bigint, lang string>>>")
    def label(texts: pa.Array) -> pa.Array:
        out: list[dict] = []
        memory = model.fresh_memory() if model.languages else {}
        held, codes, words, n_words, cells = [], [], [], 0, 0
        for text in texts.to_pylist():
            held.append(text)
            words.append(WORD.findall((text or "").lower()) if model.languages else [])
            n_words += len(words[-1])
            cells += len(words[-1]) * len(model.languages)
            if n_words >= HELD_WORDS:  # strings are much larger than codes
                codes += model.codes(words, memory)
                words, n_words = [], 0
            if cells >= CHUNK:
                out += judged(held, codes + model.codes(words, memory), memory)
                memory = model.fresh_memory()
                held, codes, words, n_words, cells = [], [], [], 0, 0
        if model.languages:
            codes += model.codes(words, memory)
        return pa.array(out + judged(held, codes, memory), kind)

    def judged(texts: list, codes: list, memory: dict) -> list[dict]:
        out = []
        found = best_paths(codes, memory["scores"], model.switch) if model.languages else [()] * len(texts)
        for n, (text, path) in enumerate(zip(texts, found)):
            if not len(path):
                out.append({"lang": UNKNOWN, "score": 0.0, "spans": [] if spans else None})
                continue
            letters = np.bincount(path, memory["lengths"][codes[n]], len(model.languages))
            best = int(letters.argmax())
            out.append({"lang": model.languages[best], "score": float(letters[best] / letters.sum()),
                        "spans": cut(text, path) if spans else None})
        return out

    def cut(text: str, path: np.ndarray) -> list[dict]:
        found: list[dict] = []
        for n, m in enumerate(WORD.finditer(text)):
            lang = model.languages[path[min(n, len(path) - 1)]]
            if found and found[-1]["lang"] == lang:
                found[-1]["end"] = m.end()
            else:
                found.append({"start": m.start(), "end": m.end(), "lang": lang})
        return found

    return label(text.cast("string"))
