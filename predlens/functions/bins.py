"""Equal-width bins.

Bin ``i`` of ``k`` covers ``[lo + i*step, lo + (i+1)*step)``. The floor of
``(x - lo) / step`` can be one off for a value within an ulp of an inner edge, so the
index is checked once against the edges themselves; the cost does not grow with ``k``.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Edges:
    """``count`` bins of equal width from ``lo`` to ``hi``."""

    lo: float
    hi: float
    count: int

    @classmethod
    def spanning(cls, lo: float | None, hi: float | None, count: int) -> Edges:
        """Edges over the range of a column; a constant column gets a unit-wide range."""
        if lo is None or hi is None:
            return cls(0.0, 1.0, count)
        lo, hi = float(lo), float(hi)
        if lo == hi:
            return cls(lo - 0.5, hi + 0.5, count)
        return cls(lo, hi, count)

    @classmethod
    def sturges(cls, lo: float | None, hi: float | None, rows: int) -> Edges:
        """As many bins as Sturges' rule gives for ``rows`` values; one for a constant column."""
        if lo is None or rows < 1 or lo == hi:
            return cls.spanning(lo, hi, 1)
        return cls.spanning(lo, hi, math.ceil(math.log2(rows) + 1))

    @property
    def step(self) -> float:
        return (self.hi - self.lo) / self.count

    def values(self) -> list[float]:
        return [i * self.step + self.lo for i in range(self.count)] + [self.hi]


def closed_bin(x: Column, edges: Edges) -> Column:
    """Bin index with the last bin closed on the right; NULL outside the range."""
    return _bin(x, F.lit(edges.lo), F.lit(edges.step), edges.count, (x >= edges.lo) & (x <= edges.hi))


def closed_bin_of_axis(x: Column, axis: Column, axes: Sequence[Edges], count: int) -> Column:
    """:func:`closed_bin` of a value on the axis of that number; all axes have ``count`` bins.

    One expression for all axes: one for each soon makes a method that the JVM does not compile.
    """
    lo, hi, step = (F.array(*[F.lit(v) for v in part])[axis] for part in zip(*[(e.lo, e.hi, e.step) for e in axes]))
    return _bin(x, lo, step, count, (x >= lo) & (x <= hi))


def half_open_bin(x: Column, edges: Edges) -> Column:
    """Bin index with every bin open on the right: a value at the maximum has no bin."""
    return _bin(x, F.lit(edges.lo), F.lit(edges.step), edges.count, (x >= edges.lo) & (x < edges.hi))


def _bin(x: Column, lo: Column, step: Column, count: int, inside: Column) -> Column:
    last = count - 1
    x = x.cast("double")
    guess = F.least(F.floor((x - lo) / step).cast("int"), F.lit(last))
    below = x < guess * step + lo
    above = (guess < last) & (x >= (guess + 1) * step + lo)
    settled = F.when(below, guess - 1).when(above, guess + 1).otherwise(guess)
    return F.when(inside, settled)


def bin_center(index: Column, edges: Edges) -> Column:
    """Middle of a bin."""
    return F.lit(edges.lo) + (index + 0.5) * edges.step


def edge_columns(lo: Column, hi: Column, count: int, prefix: str = "edge") -> dict[str, Column]:
    """The ``count + 1`` edges between two (aggregate) columns, one column each."""
    flat = lo == hi
    low = F.when(flat, lo - 0.5).otherwise(lo).cast("double")
    high = F.when(flat, hi + 0.5).otherwise(hi).cast("double")
    inner = {f"{prefix}{i}": low + i * (high - low) / count for i in range(count)}
    return {**inner, f"{prefix}{count}": high}
