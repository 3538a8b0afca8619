"""Cosines of sparse vectors, reduced where they are made.

Vectors are packed: a few hundred members a row, ids and groups as differences, compressed. A cell meets a block of members
with a part of all members: the block is held as lists by group, the packs of the part stream past it, and only what is asked
for leaves the cell: the k best of each member of the block, or the pairs above a bound. So a rating travels once for each block
and once for each part, whatever the sizes of the groups are, and no pair is shuffled that is not in the result.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketloom.operators.scale import SCORE_DIGITS, dense_codes, lookup_join, spread_rows
from marketloom.session import materialise

BLOCK_ENTRIES = 16_000_000  # ratings of a block, 8 bytes each
PART_ENTRIES = 75_000_000  # ratings whose packs lie in one cell, about 3 bytes each
PRODUCTS = 1_000_000  # products held at once
PAIR_BYTES = 24  # of one of the k best on its way to the others
PACK_ENTRIES = 250_000  # ratings of a pack; members with more travel in pieces


def whole(kind: T.DataType) -> bool:
    return isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))


def squeezed(*arrays: np.ndarray) -> bytes:
    """Arrays of eight-byte values, compressed byte by byte, so that equal high bytes cost nothing."""
    planes = b"".join(np.ascontiguousarray(a).view(np.uint8).reshape(-1, 8).T.tobytes() for a in arrays)
    head = np.array([len(arrays), *(len(a) for a in arrays)], np.int64).tobytes()
    return head + pa.compress(planes, codec="zstd", asbytes=True)


def opened(data: bytes, kinds: list[type]) -> list[np.ndarray]:
    sizes = np.frombuffer(data, np.int64, len(kinds) + 1)[1:]
    planes = np.frombuffer(pa.decompress(data[8 * (len(kinds) + 1):], int(sizes.sum()) * 8, codec="zstd"), np.uint8)
    out, at = [], 0
    for n, kind in zip(sizes, kinds):
        out.append(np.ascontiguousarray(planes[at: at + 8 * n].reshape(8, -1).T).view(kind).ravel())
        at += 8 * n
    return out


@dataclass
class Pack:
    """Members, their numbers of entries and sums of squares; groups and values of all entries, member by member."""

    ids: np.ndarray
    counts: np.ndarray
    squares: np.ndarray
    groups: np.ndarray
    values: np.ndarray

    def encoded(self) -> bytes:
        firsts = (np.cumsum(self.counts) - self.counts)[self.counts > 0]
        steps = np.diff(self.groups, prepend=0)
        steps[firsts] = self.groups[firsts]
        return squeezed(np.diff(self.ids, prepend=0), self.counts, self.squares, steps, self.values)

    @classmethod
    def decoded(cls, data: bytes) -> Pack:
        ids, counts, squares, steps, values = opened(data, [np.int64, np.int64, np.float64, np.int64, np.float64])
        sums, firsts = np.cumsum(steps), np.cumsum(counts) - counts
        before = np.concatenate([[0], sums])[firsts]
        return cls(np.cumsum(ids), counts, squares, sums - np.repeat(before, counts), values)


def packs_of(rows: DataFrame, members: int, entries: int = PACK_ENTRIES, null_values: bool = True, dealt: bool = False) -> DataFrame:
    """Packs of the rows ``(i, g, v)``: ``n`` numbers them, ``unit`` is the number of the first pack that holds the same member,
    ``more`` whether the next pack goes on with it, ``entries`` and ``members`` count.

    Rows without member drop out, those without group count for the length only; a value that is null is dropped or, with
    ``null_values``, kept as NaN. ``dealt``: all rows of a member lie in one partition already.
    """
    known = rows.filter("i IS NOT NULL")
    if not dealt:
        parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        known = spread_rows(known, "i", tasks=max(parts, rows.sparkSession.sparkContext.defaultParallelism))
    lined = known.sortWithinPartitions("i", "g").select("i", "g", "v", F.spark_partition_id().cast("long").alias("part"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, unit = [], 0, None

        def made(i: np.ndarray, g: np.ndarray, v: np.ndarray, in_group: np.ndarray, more: bool) -> pa.RecordBatch:
            nonlocal n, unit
            square = np.where(np.isnan(v), 0.0, v * v)
            known = in_group if null_values else in_group & ~np.isnan(v)
            ids, of = np.unique(i, return_inverse=True)
            if not more and unit is None and (np.bincount(of, square) == 0)[of[~np.isnan(v)]].any():
                raise ZeroDivisionError("a vector of zeros has no direction")
            out = Pack(ids, np.bincount(of[known], minlength=len(ids)).astype(np.int64), np.bincount(of, square, len(ids)), g[known], v[known])
            unit = n if unit is None else unit
            row = (n, unit, more, int(known.sum()), len(ids), out.encoded())
            n, unit = n + 1, unit if more else None
            return pa.RecordBatch.from_arrays([pa.array([x]) for x in row], names=["n", "unit", "more", "entries", "members", "x"])

        def cut(columns: tuple[np.ndarray, ...], last: bool) -> Iterator[pa.RecordBatch | tuple]:
            """Packs of whole members, and of pieces of a member with too many entries; what may go on in the next batch is kept."""
            i, at = columns[0], 0
            starts = np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1]]))
            ends = np.append(starts[1:], len(i))
            done = len(i) if last else starts[-1]  # the last member may go on
            while at < done:
                if unit is None:
                    here = np.searchsorted(starts, at)
                    fits = ends[here: here + members]
                    fits = fits[fits <= min(done, at + entries)]
                    if len(fits):
                        yield made(*(c[at: fits[-1]] for c in columns), more=False)
                        at = fits[-1]
                        continue
                end = ends[np.searchsorted(ends, at, side="right")]
                piece = min(end, at + entries)
                yield made(*(c[at:piece] for c in columns), more=bool(piece < end))
                at = piece
            while not last and len(i) - at > entries:  # a member that goes on has more than one piece here already
                yield made(*(c[at: at + entries] for c in columns), more=True)
                at += entries
            held[:] = [tuple(c[at:] for c in columns)] if at < len(i) else []

        for batch in batches:
            if not len(batch):
                continue
            n = n or batch["part"][0].as_py() << 32
            no_group = batch["g"].is_null().to_numpy(zero_copy_only=False)
            g = batch["g"].fill_null(0).to_numpy()
            v = batch["v"].cast(pa.float64()).to_numpy(zero_copy_only=False)
            held.append((batch["i"].to_numpy(), g, v, ~no_group))
            if sum(len(h[0]) for h in held) >= entries:
                yield from cut(tuple(np.concatenate(c) for c in zip(*held)), last=False)
        if held:
            yield from cut(tuple(np.concatenate(c) for c in zip(*held)), last=True)

    return lined.mapInArrow(pack, "n long, unit long, more boolean, entries long, members long, x binary")


class Block:
    """Members with their entries as lists by group."""

    def __init__(self, blobs: list[bytes]):
        self.groups, self.named = np.empty(0, np.int64), np.empty(0)
        squares, total = [], 0
        for at in range(0, len(blobs), 64):
            packs = [Pack.decoded(b) for b in blobs[at: at + 64]]
            self.groups = np.union1d(self.groups, np.concatenate([p.groups for p in packs]))
            if self.named is not None:
                self.named = np.union1d(self.named, np.concatenate([p.values for p in packs]))
                self.named = self.named if len(self.named) <= 4096 else None  # then values are kept as they are
            squares.append((np.concatenate([p.ids for p in packs]), np.concatenate([p.squares for p in packs])))
            total += sum(len(p.groups) for p in packs)
        ids, square = (np.concatenate(s) for s in zip(*squares))
        self.ids, of = np.unique(ids, return_inverse=True)
        self.lengths = np.sqrt(np.bincount(of, square, len(self.ids)))
        member_bits, value_bits = len(self.ids).bit_length(), 0 if self.named is None else len(self.named).bit_length()
        if len(self.groups).bit_length() + member_bits + value_bits > 63:
            raise OverflowError("a block has too many members and groups for one key")
        keys, values, at = np.empty(total, np.int64), None if self.named is not None else np.empty(total), 0
        for b in blobs:
            p = Pack.decoded(b)
            end = at + len(p.groups)
            group, member = np.searchsorted(self.groups, p.groups), np.repeat(np.searchsorted(self.ids, p.ids), p.counts)
            keys[at:end] = (group << member_bits | member) << value_bits
            if values is None:
                keys[at:end] |= np.searchsorted(self.named, p.values)
            else:
                values[at:end] = p.values
            at = end
        if values is None:
            keys.sort()
        else:
            order = np.argsort(keys, kind="stable")
            keys, values = keys[order], values[order]
        self.starts = np.searchsorted(keys, np.arange(len(self.groups) + 1, dtype=np.int64) << member_bits + value_bits)
        self.keys, self.values, self.member_mask, self.value_bits = keys, values, (1 << member_bits) - 1, value_bits

    def met(self, pack: Pack, products: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, bool]]:
        """Rows of the pack's members, members of the block and products of all entries with a common group, in portions of at
        most ``products``; and whether these are whole rows, a row with more comes in several."""
        if not len(self.groups) or not len(pack.groups):
            return
        at = np.minimum(np.searchsorted(self.groups, pack.groups), len(self.groups) - 1)
        hit = self.groups[at] == pack.groups
        row = np.repeat(np.arange(len(pack.ids)), pack.counts)[hit]
        first, value = self.starts[at[hit]], pack.values[hit]
        many = self.starts[at[hit] + 1] - first
        ends = np.cumsum(many)
        row_ends = np.flatnonzero(np.append(row[1:] != row[:-1], True)) + 1 if len(row) else np.empty(0, np.int64)
        done = 0
        while done < len(row):
            so_far = ends[done - 1] if done else 0
            fits = row_ends[(row_ends > done) & (ends[row_ends - 1] <= so_far + products)]
            stop = fits[-1] if len(fits) else row_ends[np.searchsorted(row_ends, done, side="right")]
            for a, skip, n in self._pieces(many, done, stop, products):
                part = slice(a, a + len(n))
                if not n.any():
                    continue
                where = np.repeat(first[part] + skip - (np.cumsum(n) - n), n) + np.arange(n.sum())
                key = self.keys[where]
                mine = self.values[where] if self.values is not None else self.named[key & (1 << self.value_bits) - 1]
                yield np.repeat(row[part], n), key >> self.value_bits & self.member_mask, np.repeat(value[part], n) * mine, bool(len(fits))
            done = stop

    @staticmethod
    def _pieces(many: np.ndarray, start: int, stop: int, products: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Entries from ``start`` to ``stop`` in pieces of at most ``products``; a list that is longer is cut itself."""
        at = start
        while at < stop:
            sums = np.cumsum(many[at:stop])
            n = int(np.searchsorted(sums, products, side="right"))
            if n:
                yield at, np.zeros(n, np.int64), many[at: at + n]
                at += n
                continue
            for skip in range(0, int(many[at]), products):
                yield at, np.array([skip]), np.array([min(products, many[at] - skip)])
            at += 1


def summed(row: np.ndarray, member: np.ndarray, product: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    key = row << bits | member
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    product = product[order]
    dot = np.add.reduceat(product, first)
    if np.isnan(dot).any():
        known = ~np.isnan(product)
        dot = np.where(np.add.reduceat(known, first, dtype=np.int64) > 0, np.add.reduceat(np.where(known, product, 0.0), first), np.nan)
    return key[first] >> bits, key[first] & (1 << bits) - 1, dot


def cosines(block: Block, packs: Iterator[tuple[bool, bytes]], products: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Members of the block, ids of the others and cosines of all pairs with a common group, in portions.

    ``packs`` are the others in order, with the mark whether the next one goes on with the same member. A member that comes in
    several packs or portions has its sums held for the whole block until the last one.
    """
    bits, size = len(block.ids).bit_length(), len(block.ids)
    held: Sums | None = None

    def sized(member: np.ndarray, other: np.ndarray, square: np.ndarray, dot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        new = block.ids[member] != other
        member, other, square, dot = member[new], other[new], square[new], dot[new]
        length = np.sqrt(square) * block.lengths[member]
        return member, other, np.divide(dot, length, out=np.full(len(dot), np.nan), where=length > 0)

    def finished(sums: Sums) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        member = np.flatnonzero(sums.met)
        dots = np.where(sums.known[member], sums.dots[member], np.nan)
        return sized(member, np.full(len(member), sums.id), np.full(len(member), sums.square), dots)

    goes_on = False
    for more, blob in packs:
        pack = Pack.decoded(blob)
        chained = more or goes_on
        if chained:
            held = held or Sums(pack.ids[0], 0.0, size)
            held.square += pack.squares[0]
        for row, member, product, whole_rows in block.met(pack, products):
            if not chained and held and (whole_rows or held.id != pack.ids[row[0]]):
                yield finished(held)
                held = None
            if chained or not whole_rows:
                held = held or Sums(pack.ids[row[0]], pack.squares[row[0]], size)
                held.add(member, product)
            else:
                row, member, dot = summed(row, member, product, bits)
                yield sized(member, pack.ids[row], pack.squares[row], dot)
        goes_on = more
        if held and not more:
            yield finished(held)
            held = None


class Sums:
    """Products of one member with all members of a block, and its sum of squares so far."""

    def __init__(self, id: int, square: float, size: int):
        self.id, self.square, self.dots = id, square, np.zeros(size)
        self.met, self.known = np.zeros(size, bool), np.zeros(size, bool)

    def add(self, member: np.ndarray, product: np.ndarray) -> None:
        known = ~np.isnan(product)
        self.dots += np.bincount(member, np.where(known, product, 0.0), len(self.dots))
        self.met[member], self.known[member[known]] = True, True


class Best:
    """The k best pairs of every member of a block; what is below a member's k-th best so far is not kept."""

    def __init__(self, members: int, k: int, room: int, step: int = 100_000):
        self.k, self.room, self.step = k, max(room, 2 * members), step
        self.ids, self.sims = np.zeros((members, k), np.int64), np.zeros((members, k))
        self.filled, self.floor = np.zeros(members, np.int64), np.full(members, -np.inf)
        self.new: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, member: np.ndarray, other: np.ndarray, sim: np.ndarray) -> None:
        keep = rounded(sim) >= self.floor[member]
        self.new.append((member[keep].astype(np.int32), other[keep], sim[keep]))
        self.held += int(keep.sum())
        if self.held > self.room:
            self.merge()

    def merge(self) -> None:
        if not self.new:
            return
        member, other, sim = (np.concatenate(c) for c in zip(*self.new))
        self.new, self.held = [], 0
        order = np.argsort(member, kind="stable")
        member, other, sim = member[order], other[order], sim[order]
        for low in range(0, len(self.filled), self.step):
            part = slice(*np.searchsorted(member, [low, low + self.step]))
            if part.start == part.stop:
                continue
            place = np.arange(self.k) < self.filled[low: low + self.step, None]
            m = np.concatenate([np.nonzero(place)[0] + low, member[part]])
            o = np.concatenate([self.ids[low: low + self.step][place], other[part]])
            s = np.concatenate([self.sims[low: low + self.step][place], sim[part]])
            order = np.lexsort((o, -rounded(s), m))
            m, o, s = m[order], o[order], s[order]
            rank = np.arange(len(m)) - np.searchsorted(m, m, side="left")
            keep = rank < self.k
            m, o, s, rank = m[keep], o[keep], s[keep], rank[keep]
            self.ids[m, rank], self.sims[m, rank] = o, s
            self.filled[low: low + self.step] = np.bincount(m - low, minlength=self.step)[: len(self.filled) - low]
            last = rank == self.k - 1
            self.floor[m[last]] = rounded(s[last])

    def rows(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        self.merge()
        place = np.arange(self.k) < self.filled[:, None]
        return ids[np.nonzero(place)[0]], self.ids[place], self.sims[place]


def rounded(sim: np.ndarray) -> np.ndarray:
    """For comparison; a pair without a cosine comes last."""
    return np.where(np.isnan(sim), -np.inf, np.round(sim, SCORE_DIGITS))


def sparse_cosines(
    ratings: DataFrame, member: str, group: str, *, k: int | None = None, above: float | None = None, members: int = 512,
    block: int = BLOCK_ENTRIES, part: int = PART_ENTRIES, products: int = PRODUCTS, pack: int = PACK_ENTRIES, dealt: bool = False,
) -> DataFrame:
    """Cosines of the members' vectors ``(i, j, sim)``: with ``k`` at least the k best of every i, ties to the smaller j, with
    ``above`` the pairs i < j above that bound. Members are whole numbers.

    Blocks hold about ``block`` ratings and parts about ``part`` at most; there are three cells for each core, and blocks and
    parts are so many that the fewest bytes travel. A null rating adds nothing; a pair that shares nothing else has no cosine
    (null) and comes last of the k best. ``dealt``: all ratings of a member lie in one partition already.
    """
    rows = ratings.select(F.col(member).cast("long").alias("i"), F.col(group).alias("g"), F.col("rating").cast("double").alias("v"))
    if not whole(rows.schema["g"].dataType):
        codes = materialise(dense_codes(rows, "g"))
        rows = lookup_join(rows, codes, ["g"]).select("i", F.col("_code").alias("g"), "v")
    packs = materialise(packs_of(rows.withColumn("g", F.col("g").cast("long")), members, pack, above is None, dealt))
    total, size, n = packs.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("entries", F.length("x"), "members")]).first()
    cells = 3 * ratings.sparkSession.sparkContext.defaultParallelism
    least = max(1, math.ceil(total / block)), max(1, math.ceil(total / part))
    blocks, parts = min(
        ((max(least[0], math.ceil(cells / b)), b) for b in range(least[1], max(cells, least[1]) + 1)),
        key=lambda x: (x[0] + x[1]) * size + x[1] * n * (k or 0) * PAIR_BYTES)
    number = F.shiftrightunsigned("unit", 32) + F.col("unit").bitwiseAND(F.lit((1 << 32) - 1))
    a, b = (F.pmod(number, F.lit(n)).cast("int") for n in (blocks, parts))
    left = packs.select(F.explode(F.sequence(a * parts, a * parts + parts - 1)).alias("cell"), F.lit(0).alias("side"), "n", "more", "x")
    right = packs.select(F.explode(F.sequence(b, b + (blocks - 1) * parts, F.lit(parts))).alias("cell"), F.lit(1).alias("side"), "n", "more", "x")

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, bool, bytes]]:
        for batch in batches:
            for at in range(len(batch)):
                yield tuple(batch[name][at].as_py() for name in ("cell", "side", "more", "x"))

    def cell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, found in itertools.groupby(rows_of(batches), key=lambda r: r[0]):
            blobs, first = [], None
            for row in found:
                if row[1]:
                    first = row
                    break
                blobs.append(row[3])
            if not blobs or first is None:
                continue
            held = Block(blobs)
            del blobs
            pairs = cosines(held, ((r[2], r[3]) for r in itertools.chain([first], found)), products)
            for out in reduced(held, pairs):
                for at in range(0, len(out[0]), products):
                    yield pa.RecordBatch.from_arrays([pa.array(c[at: at + products]) for c in out], names=["i", "j", "sim"])

    def reduced(held: Block, pairs: Iterator) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        if k is not None:
            best = Best(len(held.ids), k, products)
            for found in pairs:
                best.add(*found)
            yield best.rows(held.ids)
            return
        for at, other, sim in pairs:
            keep = (held.ids[at] < other) & (sim > above)
            yield held.ids[at[keep]], other[keep], sim[keep]

    met = left.unionByName(right).repartitionById(blocks * parts, F.col("cell")).sortWithinPartitions("cell", "side", "n")
    return met.mapInArrow(cell, "i long, j long, sim double").withColumn("sim", F.nanvl("sim", F.lit(None)))
