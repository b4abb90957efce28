"""Minimal acyclic automata over word sequences with counts as weights (part of operator 11).

Every path has ``DEPTH`` labels; shorter sequences end in label 0. States are kept by depth:
the edges of state ``s`` are ``first[d][s]`` up to ``first[d][s + 1]``, sorted by label.
"""

from __future__ import annotations

import struct
from collections.abc import Callable

import numpy as np

from runledger.llm.common import ranges

DEPTH = 4
MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


def starts_of(columns: list[np.ndarray]) -> list[np.ndarray]:
    """For each depth, the first row of every different prefix of that many columns."""
    n = len(columns[0])
    new = np.zeros(n, dtype=bool)
    new[:1] = True
    out = [np.flatnonzero(new)]
    for column in columns:
        new[1:] |= column[1:] != column[:-1]
        out.append(np.flatnonzero(new))
    return out


class Automaton:
    """A deterministic automaton whose states are merged when all that follows them is equal."""

    def __init__(self, first: list[np.ndarray], label: list[np.ndarray], weight: list[np.ndarray], target: list[np.ndarray]):
        self.first, self.label, self.weight, self.target = first, label, weight, target

    @classmethod
    def of_sorted(cls, columns: list[np.ndarray], weight_of: Callable[[int, np.ndarray], np.ndarray]) -> Automaton:
        """From different rows of ``DEPTH`` labels in ascending order.

        In sorted rows a state is complete as soon as its prefix is left; here whole runs of
        states of one depth are closed at a time, the deepest first, and each is replaced
        by the registered state with the same edges. ``weight_of(depth, starts)`` gives the
        weights of the prefixes that begin at rows ``starts``.
        """
        starts = starts_of(columns)
        first, label, weight, target = ([None] * DEPTH for _ in range(4))
        state_of = np.zeros(len(starts[DEPTH]), dtype=np.int64)  # one final state
        for d in range(DEPTH - 1, -1, -1):
            here = starts[d + 1]
            labels, weights, targets = columns[d][here].astype(np.int64), weight_of(d + 1, here), state_of
            begin = np.searchsorted(here, starts[d])
            degree = np.diff(np.append(begin, len(here)))
            kept, state_of = cls._registered(labels, weights, targets, begin, degree)
            edges = ranges(begin[kept], degree[kept])
            first[d] = np.concatenate([[0], np.cumsum(degree[kept])])
            label[d], weight[d], target[d] = labels[edges], weights[edges], targets[edges]
        return cls(first, label, weight, target)

    @staticmethod
    def _registered(labels, weights, targets, begin, degree) -> tuple[np.ndarray, np.ndarray]:
        """States that stay, and for every state the number of the one that stands for it.

        A hash of the edges finds states that may be equal; their edges are then compared,
        and a state that differs from the one its hash names stays as it is.
        """
        if not len(begin):
            return begin, begin
        mixed = labels.astype(np.uint64) * np.uint64(MIX[0]) ^ weights.astype(np.uint64) * np.uint64(MIX[1]) ^ (targets + 1).astype(np.uint64) * np.uint64(MIX[2])
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(MIX[1])
        _, found, inverse = np.unique(np.add.reduceat(mixed ^ (mixed >> np.uint64(32)), begin), return_index=True, return_inverse=True)
        of = found[inverse]
        same = degree == degree[of]
        check = np.flatnonzero(same & (of != np.arange(len(of))))
        mine, theirs = ranges(begin[check], degree[check]), ranges(begin[of[check]], degree[check])
        differ = (labels[mine] != labels[theirs]) | (weights[mine] != weights[theirs]) | (targets[mine] != targets[theirs])
        same[check[np.repeat(np.arange(len(check)), degree[check])[differ]]] = False
        of = np.where(same, of, np.arange(len(of)))
        kept, state_of = np.unique(of, return_inverse=True)
        return kept, state_of

    def paths(self) -> tuple[list[np.ndarray], np.ndarray]:
        """All rows in ascending order, with the weight of the whole row."""
        columns: list[np.ndarray] = []
        state, weight = np.zeros(min(1, len(self.first[0]) - 1), dtype=np.int64), np.zeros(0, dtype=np.int64)
        for d in range(DEPTH):
            begin, degree = self.first[d][state], self.first[d][state + 1] - self.first[d][state]
            edges, parent = ranges(begin, degree), np.repeat(np.arange(len(state)), degree)
            columns = [c[parent] for c in columns] + [self.label[d][edges]]
            state, weight = self.target[d][edges], self.weight[d][edges]
        return columns, weight

    def compose(self, columns: list[np.ndarray], length: np.ndarray) -> np.ndarray:
        """Weight of each asked sequence (rows of labels, -1 unknown, of given lengths); 0 if absent.

        All sequences walk together, one label a step, from state to state.
        """
        out, state = np.zeros(len(length), dtype=np.int64), np.zeros(len(length), dtype=np.int64)
        alive = np.flatnonzero(length > 0) if len(self.first[0]) > 1 else np.zeros(0, dtype=np.int64)
        for d in range(DEPTH):
            owner = np.repeat(np.arange(len(self.first[d]) - 1), np.diff(self.first[d]))
            keys = (owner << 32) | self.label[d]
            asked = (state[alive] << 32) | (columns[d][alive] & 0xFFFFFFFF)
            at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1) if len(keys) else np.zeros(0, dtype=np.int64)
            found = keys[at] == asked if len(keys) else np.zeros(len(alive), dtype=bool)
            at, alive = at[found] if len(keys) else at, alive[found]
            ends = length[alive] == d + 1
            out[alive[ends]] = self.weight[d][at[ends]]
            state[alive] = self.target[d][at]
            alive = alive[~ends]
        return out

    def to_bytes(self) -> bytes:
        return b"".join(_packed(a) for d in range(DEPTH) for a in (self.first[d], self.label[d], self.weight[d], self.target[d]))

    @classmethod
    def from_bytes(cls, data: bytes) -> Automaton:
        parts: list[list[np.ndarray]] = [[], [], [], []]
        at = 0
        for k in range(4 * DEPTH):
            array, at = _unpacked(data, at)
            parts[k % 4].append(array)
        return cls(*parts)


def _packed(array: np.ndarray) -> bytes:
    """Width, length and values in the narrowest unsigned type that holds them."""
    top = int(array.max()) if len(array) else 0
    width = next(w for w in (1, 2, 4, 8) if top < 1 << (8 * w))
    return struct.pack("<BQ", width, len(array)) + array.astype(f"<u{width}").tobytes()


def _unpacked(data: bytes, at: int) -> tuple[np.ndarray, int]:
    width, n = struct.unpack_from("<BQ", data, at)
    at += 9
    return np.frombuffer(data, f"<u{width}", n, at).astype(np.int64), at + width * n
