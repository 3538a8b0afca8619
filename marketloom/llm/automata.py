"""Weighted acyclic automata over word sequences, held in flat arrays.

A path from the start spells a phrase; the weight of its last arc is the phrase's count (zero: only a way to longer ones).
Labels are 64-bit word hashes, never zero. Arcs are stored level by level, sorted by state and label.

``build`` takes phrases in sorted order, in which all phrases with one prefix follow each other, so a state is complete as
soon as its prefix changes. Complete states are registered from the last level up, and a state whose arcs equal those of a
registered one (labels, weights and targets) is replaced by it.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable

import numpy as np
import zstandard

from marketloom.llm.wordhash import ODD, OTHER, mixed


def sorted_sums(rows: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows in order, with the sums of their weights."""
    if not len(rows):
        return rows, weights
    order = np.lexsort(rows.T[::-1])
    rows, weights = rows[order], weights[order]
    first = np.flatnonzero(np.r_[True, (rows[1:] != rows[:-1]).any(axis=1)])
    return rows[first], np.add.reduceat(weights, first)


class CountAutomaton:
    """``alphabet``: sorted labels. ``levels``: for each length ``starts`` (first arc of every state, and the end),
    ``labels`` (places in the alphabet), ``weights``, ``targets`` (states of the next level)."""

    def __init__(self, alphabet: np.ndarray, levels: list[tuple]):
        self.alphabet, self.levels = alphabet, levels

    @classmethod
    def build(cls, rows: np.ndarray, weights: np.ndarray) -> CountAutomaton:
        """``rows``: sorted distinct phrases, one column for each word, zeros behind shorter ones."""
        alphabet = np.unique(rows[rows != 0])
        depth = rows.shape[1]
        lengths = (rows != 0).sum(axis=1)
        fresh = np.zeros(len(rows), bool)
        arcs = []
        for d in range(depth):  # arcs of each level: a new prefix of d + 1 words
            if len(rows):
                fresh = fresh | np.r_[True, rows[1:, d] != rows[:-1, d]]
            at = np.flatnonzero(fresh & (lengths > d))
            owner = np.searchsorted(arcs[-1][0], at, side="right") - 1 if d else np.zeros(len(at), np.int64)
            arcs.append((at, owner, np.searchsorted(alphabet, rows[at, d]), np.where(lengths[at] == d + 1, weights[at], 0)))
        levels: list[tuple] = [()] * depth
        targets = np.zeros(len(arcs[-1][0]), np.int64)
        for d in range(depth - 1, -1, -1):
            _, owner, labels, own = arcs[d]
            above = len(arcs[d - 1][0]) if d else 1
            counts = np.bincount(owner, minlength=above)
            begins = np.concatenate([[0], np.cumsum(counts)])
            chosen, state = cls._registered(counts, begins, labels, own, targets) if d else (np.zeros(1, np.int64), None)
            sizes = counts[chosen]
            starts = np.concatenate([[0], np.cumsum(sizes)])
            kept = np.repeat(begins[chosen] - starts[:-1], sizes) + np.arange(starts[-1])
            levels[d] = (starts, labels[kept], own[kept], targets[kept])
            targets = state
        return cls(alphabet, levels)

    @staticmethod
    def _registered(counts, begins, labels, weights, targets) -> tuple[np.ndarray, np.ndarray]:
        """Owners whose states are kept, and the state of every owner; owners without arcs share a state as well."""
        codes = np.zeros((len(counts), 2), np.uint64)
        full = counts > 0
        for c, factor in enumerate((ODD, OTHER)):
            arc = mixed(mixed(mixed(labels.astype(np.uint64) + np.uint64(factor)) + weights.astype(np.uint64))
                        + targets.astype(np.uint64))
            if len(arc):
                codes[full, c] = np.add.reduceat(arc, begins[:-1][full])
        order = np.lexsort(codes.T)
        same = np.r_[False, (codes[order[1:]] == codes[order[:-1]]).all(axis=1)] if len(order) else np.zeros(0, bool)
        state = np.empty(len(counts), np.int64)
        state[order] = np.cumsum(~same) - 1
        return order[~same], state

    def rows(self) -> tuple[np.ndarray, np.ndarray]:
        """All phrases with a weight, sorted, and their weights."""
        depth = len(self.levels)
        found, state, path = [], np.zeros(1, np.int64), np.zeros((1, 0), np.uint64)
        for d, (starts, labels, weights, targets) in enumerate(self.levels):
            sizes = starts[state + 1] - starts[state]
            ends = np.cumsum(sizes)
            arc = np.repeat(starts[state] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)
            path = np.column_stack([np.repeat(path, sizes, axis=0), self.alphabet[labels[arc]]])
            state = targets[arc]
            own = weights[arc] > 0
            whole = np.zeros((int(own.sum()), depth), np.uint64)
            whole[:, : d + 1] = path[own]
            found.append((whole, weights[arc][own]))
        rows, weights = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort(rows.T[::-1])
        return rows[order], weights[order]

    def weights_of(self, phrases: np.ndarray) -> np.ndarray:
        """Compose with the phrases (rows as in ``build``): the weight each path ends with, zero where there is none."""
        out = np.zeros(len(phrases), np.int64)
        state = np.zeros(len(phrases), np.int64)
        alive = np.flatnonzero((phrases != 0).sum(axis=1) <= len(self.levels))
        size = np.int64(len(self.alphabet) + 1)
        for d, (starts, labels, weights, targets) in enumerate(self.levels[: phrases.shape[1]]):
            alive = alive[phrases[alive, d] != 0]
            if not len(alive) or not len(labels):
                out[alive] = 0
                break
            word = np.searchsorted(self.alphabet, phrases[alive, d])
            known = self.alphabet[np.minimum(word, len(self.alphabet) - 1)] == phrases[alive, d]
            arcs = np.repeat(np.arange(len(starts) - 1), np.diff(starts)) * size + labels
            wanted = state[alive] * size + word
            at = np.minimum(np.searchsorted(arcs, wanted), len(arcs) - 1)
            met = known & (arcs[at] == wanted)
            out[alive] = np.where(met, weights[at], 0)
            state[alive] = np.where(met, targets[at], 0)
            alive = alive[met]
        return out

    @classmethod
    def union(cls, automata: Iterable[CountAutomaton], depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Sorted phrases of all automata with the sums of their weights."""
        found = []
        for one in automata:
            rows, weights = one.rows()
            found.append((np.pad(rows, ((0, 0), (0, depth - rows.shape[1]))), weights))
        if not found:
            return np.zeros((0, depth), np.uint64), np.zeros(0, np.int64)
        return sorted_sums(*(np.concatenate(x) for x in zip(*found)))

    def packed(self) -> bytes:
        small = [tuple(a.astype(np.min_scalar_type(int(a.max(initial=0)))) for a in level) for level in self.levels]
        return zstandard.compress(pickle.dumps((self.alphabet, small), protocol=5), 1)

    @classmethod
    def unpacked(cls, data: bytes) -> CountAutomaton:
        alphabet, levels = pickle.loads(zstandard.decompress(data))
        return cls(alphabet, [tuple(a.astype(np.int64) for a in level) for level in levels])
