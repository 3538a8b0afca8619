"""Token counts of a unigram vocabulary without building the tokens.

Aho-Corasick lists the vocabulary entries that end at each character, longest first; the dynamic programme keeps the best
score and the piece count of that path for every prefix. Ties follow the tokenizer's rule: a later candidate replaces an
earlier one only if its score is greater, and candidates come in the order of their start, so of equal paths the one with
the longest last piece stays. A character without a single-character piece may be unknown, at the lowest score of the
vocabulary less 10, and counts one piece per UTF-8 byte.

Texts are counted segment by segment where no piece can continue, and counts of segments are remembered by the Python
worker. This equals counting the whole text as long as sums of scores are exact in double precision, as they are for whole
numbers; with other scores pass ``whole=True``.
"""

from __future__ import annotations

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.llm.common import worker_cache
from marketloom.llm.pieces import SPACE, segment_finder

UNKNOWN_PENALTY = 10.0
KEPT_SEGMENTS = 200_000
LONGEST_KEPT = 40


class Unigram:
    """Automaton over ``(piece, score)`` pairs; byte pieces are part of the vocabulary as the tokenizer has them."""

    def __init__(self, vocabulary: list[tuple[str, float]], whole: bool = False):
        automaton = ahocorasick.Automaton()
        for piece, score in vocabulary:
            if piece:
                automaton.add_word(piece, (len(piece), score))
        automaton.make_automaton()
        self.matches = automaton.iter
        self.unknown = min(score for _, score in vocabulary) - UNKNOWN_PENALTY
        self.segments = (lambda text: [text]) if whole else segment_finder(
            [p for p, _ in vocabulary if not (p.startswith("<0x") and len(p) == 6)])
        self.byte_like = not whole
        self.known: dict[str, int] = {}

    def count(self, text: str) -> int:
        """Pieces of a text whose spaces become ``SPACE``, with one more in front; none for an empty text."""
        if not text:
            return 0
        plain = SPACE + text.replace(" ", SPACE)
        if self.byte_like and "<0x" in plain:  # written byte pieces run over the cuts
            return self.best(plain)[1]
        parts, known = self.segments(plain), self.known
        try:
            return sum([known[s] for s in parts])
        except KeyError:
            return sum([known.get(s) or self._new(s) for s in parts])

    def _new(self, segment: str) -> int:
        found = self.best(segment)[1]
        if len(segment) <= LONGEST_KEPT:
            if len(self.known) >= KEPT_SEGMENTS:
                self.known.clear()
            self.known[segment] = found
        return found

    def best(self, text: str) -> tuple[float, int]:
        """Best score and its piece count."""
        n = len(text)
        scores, counts = [0.0] * (n + 1), [0] * (n + 1)
        reached, single, unknown = 0, False, self.unknown
        best, pieces = None, 0

        def close(upto: int) -> None:
            """Settle the prefixes behind ``reached`` up to ``upto``; the last candidate of each is the unknown one."""
            nonlocal reached, single, best, pieces
            while reached < upto:
                if not single and (best is None or scores[reached] + unknown > best):
                    best, pieces = scores[reached] + unknown, counts[reached] + len(text[reached].encode())
                reached += 1
                scores[reached], counts[reached] = best, pieces
                best, pieces, single = None, 0, False

        for last, (length, score) in self.matches(text):
            if last > reached:
                close(last)
            found = scores[last + 1 - length] + score
            if best is None or found > best:
                best, pieces = found, counts[last + 1 - length] + 1
            if length == 1:
                single = True
        close(n)
        return scores[n], counts[n]


def vocabulary_of(model: bytes) -> list[tuple[str, float]]:
    """Pieces and scores of a model file, control and unknown pieces left out."""
    from sentencepiece import SentencePieceProcessor

    lib = SentencePieceProcessor(model_proto=model)
    ids = [i for i in range(lib.get_piece_size()) if not (lib.is_control(i) or lib.is_unknown(i))]
    return [(lib.id_to_piece(i), lib.get_score(i)) for i in ids]


def token_count(text: Column, vocabulary: list[tuple[str, float]], whole: bool = False) -> Column:
    """Number of pieces of each text; null and empty texts have none. Whole texts are counted, whatever their length."""
    packed = tuple(vocabulary)

    @F.arrow_udf("bigint")
    def count(texts: pa.Array) -> pa.Array:
        cache = worker_cache("unigram")
        key = (hash(packed), len(packed), whole)
        if key not in cache:
            cache[key] = Unigram(list(packed), whole)
        return pa.array([cache[key].count(t or "") for t in texts.to_pylist()], pa.int64())

    return count(text.cast("string"))


def with_token_counts(docs: DataFrame, vocabulary: list[tuple[str, float]], text_col: str = "text",
                      name: str = "n_tokens") -> DataFrame:
    """``docs`` plus a column of counts; a column of that name in the input is replaced. Nothing is shuffled."""
    return docs.withColumn(name, token_count(F.col(text_col), vocabulary))
