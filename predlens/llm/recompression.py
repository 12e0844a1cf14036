"""Recompression (Jeż): a run-length grammar of a sequence, and extensions answered from it.

Rounds of block compression (a stretch of equal symbols becomes one) and pair compression (the
symbols are split into two sides; a left one followed by a right one becomes one) shorten the
sequence by a constant factor until it is short. Symbols of a level are equal exactly when what
they stand for is equal, and equal stretches are parsed alike but for a few symbols at their
ends. How far the sequence agrees from two places on is thus found by climbing while both places
begin a symbol of the next level, stepping over equal symbols, and descending where they differ:
a few steps a level. All questions of a call are answered side by side.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Level:
    """One sequence of the grammar; ``parent`` is each symbol's place in the level above."""

    symbols: np.ndarray
    sizes: np.ndarray  # elements of the sequence a symbol stands for
    begins: np.ndarray  # place of its first symbol in the level below
    parent: np.ndarray | None = None


@dataclass
class Side:
    """A level as seen when going one way: by which symbol a parent is entered, and how many equal symbols follow."""

    enters: np.ndarray  # whether a symbol is the first of its parent on this way
    equal: np.ndarray  # equal symbols from here on, itself included
    child: np.ndarray  # place in the level below by which a symbol is entered


class Grammar:
    """The levels over ``sequence``, whose first and last entries must each occur once."""

    def __init__(self, sequence: np.ndarray, shortest: int = 8, seed: int = 1):
        codes = np.unique(sequence, return_inverse=True)[1]
        self.levels = [Level(codes, np.ones(len(codes), np.int64), np.arange(len(codes)))]
        random = np.random.default_rng(seed)
        while len(self.levels[-1].symbols) > max(2, shortest):
            self._compress(_block_starts(self.levels[-1].symbols))
            self._compress(_pair_starts(self.levels[-1].symbols, random))
        self._sides = {1: [self._side(i, 1) for i in range(len(self.levels))], -1: [self._side(i, -1) for i in range(len(self.levels))]}

    def _compress(self, starts: np.ndarray) -> None:
        """Add a level whose symbols take the places from each start to the next; none if nothing shrinks."""
        low = self.levels[-1]
        if len(starts) == len(low.symbols):
            return
        width = np.diff(starts, append=len(low.symbols))
        # A block is its symbol and length, a pair its two symbols; both are told from a single symbol by the last one's code.
        last = low.symbols[starts + width - 1]
        span = int(low.symbols.max()) + 1
        code = np.unique((low.symbols[starts] * span + last) * (int(width.max()) + 1) + width, return_inverse=True)[1] if span < 2**20 else _codes(low.symbols[starts], last, width)
        sums = np.concatenate([[0], np.cumsum(low.sizes)])
        low.parent = np.repeat(np.arange(len(starts)), width)
        self.levels.append(Level(code, sums[starts + width] - sums[starts], starts))

    def _side(self, i: int, way: int) -> Side:
        level = self.levels[i]
        symbols = level.symbols
        starts = _block_starts(symbols)
        width = np.diff(starts, append=len(symbols))
        place, whole = np.arange(len(symbols)), np.repeat(starts, width)
        if way == 1:
            enters = np.diff(level.parent, prepend=-1) > 0 if level.parent is not None else np.zeros(len(symbols), bool)
            return Side(enters, np.repeat(starts + width, width) - place, level.begins)
        enters = np.diff(level.parent, append=level.parent[-1] + 1) > 0 if level.parent is not None else np.zeros(len(symbols), bool)
        below = len(self.levels[i - 1].symbols) if i else len(symbols)
        return Side(enters, place - whole + 1, np.append(level.begins[1:], below) - 1)

    def agreement(self, one: np.ndarray, other: np.ndarray, way: int = 1) -> np.ndarray:
        """How many entries agree from the places ``one`` and ``other`` (not the same) on, going right (1) or left (-1)."""
        x, y = one.astype(np.int64), other.astype(np.int64)
        agreed = np.zeros(len(x), np.int64)
        top = len(self.levels) - 1
        stopped: list[np.ndarray] = []
        going = np.arange(len(x))
        for i, (level, side) in enumerate(zip(self.levels, self._sides[way])):
            rising, left = [], []
            while len(going):
                if i < top:
                    up = side.enters[x[going]] & side.enters[y[going]]
                    rising.append(going[up])
                    going = going[~up]
                same = level.symbols[x[going]] == level.symbols[y[going]]
                left.append(going[~same])
                going = going[same]
                self._step(level, side, going, x, y, agreed, way)
            stopped.append(np.concatenate(left) if left else going)
            going = np.concatenate(rising) if rising else going
            if i < top:
                x[going], y[going] = level.parent[x[going]], level.parent[y[going]]
        falling = np.zeros(0, np.int64)
        for i in range(top, -1, -1):
            level, side = self.levels[i], self._sides[way][i]
            falling = np.concatenate([falling, stopped[i]])
            going = falling
            while len(going):
                going = going[level.symbols[x[going]] == level.symbols[y[going]]]
                self._step(level, side, going, x, y, agreed, way)
            if i:
                x[falling], y[falling] = side.child[x[falling]], side.child[y[falling]]
        return agreed

    @staticmethod
    def _step(level: Level, side: Side, going, x, y, agreed, way: int) -> None:
        """Over the equal symbols that follow at both places, as many as both have."""
        many = np.minimum(side.equal[x[going]], side.equal[y[going]])
        agreed[going] += many * level.sizes[x[going]]
        x[going] += way * many
        y[going] += way * many


def _block_starts(symbols: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], symbols[1:] != symbols[:-1]]))


def _pair_starts(symbols: np.ndarray, random: np.random.Generator) -> np.ndarray:
    """Starts after joining left symbols with right ones; of a random split's two directions the one with more pairs."""
    side = random.random(int(symbols.max()) + 1) < 0.5
    left = side[symbols]
    pairs = max((left[:-1] & ~left[1:], ~left[:-1] & left[1:]), key=np.count_nonzero)
    return np.flatnonzero(~np.concatenate([[False], pairs]))


def _codes(*columns: np.ndarray) -> np.ndarray:
    """A number per distinct row of the columns."""
    code = columns[0]
    for column in columns[1:]:
        span = int(column.max()) + 1
        code = np.unique(code * span + column, return_inverse=True)[1]
    return code
