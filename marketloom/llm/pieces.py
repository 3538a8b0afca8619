"""SentencePiece encoding and decoding for merge-type vocabularies.

The encoder keeps an agenda of adjacent symbol pairs, best score first, leftmost first among equal scores, and merges
until no pair is a piece; left-over symbols outside the vocabulary become byte pieces. No piece of such a vocabulary
continues over the start of a word, which is verified when the model is loaded, so a text is encoded segment by segment
and segments are remembered by the Python worker. The new segments of every Arrow batch are checked against the
sentencepiece library, which also decodes.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable, Iterable, Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.llm.common import release_memory, worker_cache

SPACE = "▁"
KEPT_SEGMENTS = 120_000  # remembered segments of a worker; a full memory is emptied, which costs time only
LONGEST_KEPT = 40  # characters
CHUNK = 1_000_000  # characters of the texts that are cut at a time
ROWS = 500  # texts that are held as Python objects at a time
NEVER = 1 << 30


def segment_finder(pieces: Iterable[str]) -> Callable[[str], list[str]]:
    """Function that cuts a text, its spaces written as ``SPACE``, where no piece can continue.

    Cuts lie in front of word starts, around ASCII characters that no longer piece has, and behind runs of letters. All
    three are derived from, and checked against, the pairs of neighbours inside pieces.
    """
    pairs = {p[i: i + 2] for p in pieces for i in range(len(p) - 1)}
    if any(re.match(f"[^{SPACE}]{SPACE}", p, re.S) for p in pairs):
        raise ValueError("a piece runs over the start of a word")
    joined = set("".join(pairs))
    alone = re.escape("".join(chr(c) for c in range(128) if chr(c) not in joined))

    def classes(but: str) -> tuple[str, str]:
        return rf"[^\W\d_{but}]", rf"(?:(?![{SPACE}{alone}])[\W\d_{but}])"

    open_letters = {p[0] for p in pairs if re.match("".join(classes("")), p, re.S)}  # letters that pieces continue
    letter, other = classes(re.escape("".join(open_letters)))
    return re.compile(f"{SPACE}+{other}*{letter}*|{letter}+|[{alone}]|{other}+{letter}*", re.S).findall


class PieceModel:
    """Vocabulary, library handle and segment memory of one worker."""

    def __init__(self, model: bytes):
        from sentencepiece import SentencePieceProcessor

        self.library = lib = SentencePieceProcessor(model_proto=model)
        ids = range(lib.get_piece_size())
        usual = [i for i in ids if not (lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i) or lib.is_unused(i))]
        self.pieces = {lib.id_to_piece(i): (-lib.get_score(i), i) for i in usual}
        self.bytes = [lib.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.begin, self.end = (array("I", [i]).tobytes() for i in (lib.bos_id(), lib.eos_id()))
        if not all(map(lib.is_byte, self.bytes)):
            raise ValueError("byte pieces are missing")
        self.segments = segment_finder(self.pieces)
        self.known: dict[str, bytes] = {}
        self._symbols()

    def _symbols(self) -> None:
        """Number pieces and single characters, and list every pair that merges with its place in the score order."""
        names = [*self.pieces, *sorted({c for p in self.pieces for c in p if c not in self.pieces})]
        number = {s: n for n, s in enumerate(names)}
        self.symbol_id = np.array([self.pieces[s][1] if s in self.pieces else -1 for s in names], np.int64)
        place = {score: n for n, score in enumerate(sorted({v[0] for v in self.pieces.values()}))}
        merges = sorted(
            (number[p[:i]] << 32 | number[p[i:]], place[score], number[p]) for p, (score, _) in self.pieces.items()
            for i in range(1, len(p)) if p[:i] in number and p[i:] in number)
        self.pair_keys, self.pair_place, self.pair_symbol = np.array(merges, np.int64).T.copy()
        self.char_number = {ord(s): n for s, n in number.items() if len(s) == 1 and s in self.pieces}

    def encode(self, texts: list[str], check: bool = True) -> Iterator[bytes]:
        """Ids of each text with begin and end ids, as unsigned 32-bit integers in little-endian order."""
        at = 0
        while at < len(texts):
            parts, size = [], 0
            while at < len(texts) and size < CHUNK:  # bounds the lists of segments
                size += len(texts[at])
                parts.append(self.segments(SPACE + texts[at].replace(" ", SPACE)) if texts[at] else [])
                at += 1
            if len(self.known) > KEPT_SEGMENTS:
                self.known.clear()
            known = self.known
            new = list({s for p in parts for s in p if s not in known})
            known.update(zip(new, self.merge_all(new)))
            if check:
                self._compare(new)
            for p in parts:
                yield self.begin + b"".join([known[s] for s in p]) + self.end
            for s in new:
                if len(s) > LONGEST_KEPT:
                    del known[s]

    def _compare(self, segments: list[str]) -> None:
        """Hold new segments against the library; a line feed, a token of its own, stands for what went before."""
        first = [s.startswith(SPACE) for s in segments]
        texts = [s[1:].replace(SPACE, " ") if f and s[1:] else "\n" + s.replace(SPACE, " ")
                 for s, f in zip(segments, first)]
        for s, f, ids in zip(segments, first, self.library.encode(texts, num_threads=1)):
            if ids[0 if f and s[1:] else 2:] != array("I", self.known[s]).tolist():
                raise ValueError(f"ids differ from the library's for {s[:80]!r}")

    def merge_all(self, segments: list[str]) -> list[bytes]:
        """Packed ids of each segment. Short segments advance together, each by the best pair of its own agenda."""
        out: list[bytes | None] = [None] * len(segments)
        usual = self.char_number.keys()
        quick = []
        for n, s in enumerate(segments):
            if len(s) <= LONGEST_KEPT and usual >= {*map(ord, s)}:
                quick.append(n)
            else:
                out[n] = array("I", self.merge(s)).tobytes()
        if quick:
            number = self.char_number
            symbols = np.array([number[c] for n in quick for c in map(ord, segments[n])], np.int64)
            owner = np.repeat(np.arange(len(quick)), [len(segments[n]) for n in quick])
            ids, owner = self._merge_rounds(symbols, owner)
            ends = np.cumsum(np.bincount(owner, minlength=len(quick))) * 4
            packed, start = ids.astype("<u4").tobytes(), 0
            for n, end in zip(quick, ends.tolist()):
                out[n], start = packed[start:end], end
        return out

    def _merge_rounds(self, symbols: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        agenda, joined = self._pairs(symbols[:-1], symbols[1:], owner[:-1] == owner[1:])
        agenda, joined = np.append(agenda, NEVER), np.append(joined, 0)
        done = []
        while len(symbols):
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            best = np.minimum.reduceat(agenda << 32 | np.arange(len(agenda)), starts)
            going = best >> 32 < NEVER
            lengths = np.diff(np.append(starts, len(owner)))
            ended = np.repeat(~going, lengths)
            done.append((symbols[ended], owner[ended]))
            left = best[going] & 0xFFFFFFFF
            symbols[left] = joined[left]
            keep = ~ended
            keep[left + 1] = False
            place = np.cumsum(keep) - 1
            symbols, owner, agenda, joined = symbols[keep], owner[keep], agenda[keep], joined[keep]
            left = place[left]
            for at in (left, left[left > 0] - 1):  # the pairs that begin and end with the merged symbol
                after = np.minimum(at + 1, len(symbols) - 1)
                agenda[at], joined[at] = self._pairs(
                    symbols[at], symbols[after], (owner[at] == owner[after]) & (after > at))
        symbols, owner = (np.concatenate(x) for x in zip(*done))
        order = np.argsort(owner, kind="stable")
        return self.symbol_id[symbols[order]], owner[order]

    def _pairs(self, left: np.ndarray, right: np.ndarray, adjacent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place in the score order and merged symbol; ``NEVER`` where the pair is no piece."""
        keys = left << 32 | right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        found = adjacent & (self.pair_keys[at] == keys)
        return np.where(found, self.pair_place[at], NEVER), self.pair_symbol[at]

    def merge(self, text: str) -> list[int]:
        """Ids of one segment of any length."""
        pieces = self.pieces
        symbols: list[str | None] = list(text)
        n = len(symbols)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        agenda = []
        for left in range(n - 1):
            if found := pieces.get(symbols[left] + symbols[left + 1]):
                agenda.append((found[0], left, left + 1, 2))
        heapify(agenda)
        while agenda:
            _, left, right, size = heappop(agenda)
            a, b = symbols[left], symbols[right]
            if a is None or b is None or len(a) + len(b) != size:
                continue  # one of both has been merged meanwhile
            symbols[left], symbols[right] = a + b, None
            after[left] = follower = after[right]
            if follower < n:
                before[follower] = left
                if found := pieces.get(joined := a + b + symbols[follower]):
                    heappush(agenda, (found[0], left, follower, len(joined)))
            if (leader := before[left]) >= 0 and (found := pieces.get(joined := symbols[leader] + a + b)):
                heappush(agenda, (found[0], leader, left, len(joined)))
        out = []
        for s in symbols:
            if s is not None:
                if found := pieces.get(s):
                    out.append(found[1])
                else:
                    out.extend([self.bytes[b] for b in s.encode()])
        return out


def piece_model(model: bytes) -> PieceModel:
    cache = worker_cache("piece models")
    if model not in cache:
        cache[model] = PieceModel(model)
    return cache[model]


def read_model(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encoded(text: Column, model: bytes, check: bool = True) -> Column:
    """Struct ``ids`` (binary, unsigned 32-bit little-endian, begin and end ids included) and ``decoded`` (string).

    Null counts as empty. ``model`` is the content of a merge-type model file with byte pieces. With ``check`` the
    library encodes the new segments of each batch as well and a difference stops the job.
    """
    kind = pa.struct([("ids", pa.binary()), ("decoded", pa.string())])

    @F.arrow_udf("struct<ids binary, decoded string>")
    def encode(texts: pa.Array) -> pa.Array:
        own = piece_model(model)
        parts = []
        for at in range(0, len(texts), ROWS):  # Arrow buffers are smaller than Python objects
            ids, back = [], []
            for packed in own.encode([t or "" for t in texts.slice(at, ROWS).to_pylist()], check):
                ids.append(packed)
                back.append(own.library.decode(array("I", packed).tolist()))
            parts.append(pa.StructArray.from_arrays(
                [pa.array(ids, pa.binary()), pa.array(back, pa.string())], fields=list(kind)))
        release_memory()
        return pa.concat_arrays(parts) if parts else pa.array([], kind)

    return encode(text)


def encode_documents(docs: DataFrame, model: bytes, text_col: str = "text", check: bool = True) -> DataFrame:
    """``docs`` plus ``ids`` and ``decoded``; columns of these names in the input are replaced.

    One row per input row; a null or empty text has begin and end ids only and decodes to an empty text. Rows are
    encoded where they lie, nothing is shuffled. A text is encoded whole, whatever its length.
    """
    both = docs.withColumn("_loom_encoded", encoded(F.col(text_col).cast("string"), model, check))
    return both.withColumns({"ids": F.col("_loom_encoded.ids"), "decoded": F.col("_loom_encoded.decoded")}).drop(
        "_loom_encoded")
