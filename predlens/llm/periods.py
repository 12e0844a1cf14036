"""Periodic runs of words: harmonic-grid candidates, extended exactly by a recompression grammar.

A run is a stretch of words that repeats with a smallest period q at least ``times`` times, is
``least`` words or more long, and that no neighbouring word extends. Words that stand one period
apart agree on all of a run but its last period, so the agreeing stretch holds a whole cell of a
grid whose width follows the period. Every cell whose first words agree with those one period on
is a candidate; what the grammar says about its agreement to both sides is the run.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import compress, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from predlens.llm.batches import in_small_batches
from predlens.llm.recompression import Grammar

LEAST, TIMES = 24, 3
TOGETHER = 1 << 18  # words of short texts looked at at once
MANY = 256  # cells from which a period is looked at by itself
COMPARED = 4  # words of a cell compared before the grammar is asked

RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def runs_of(texts: list[np.ndarray], least: int = LEAST, times: int = TIMES) -> list[np.ndarray]:
    """The runs (start, length, period) of each text, given as word numbers, by start, then period."""
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    sizes = np.array([len(texts[i]) for i in order], np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes + 1)])[:-1] + 1
    words = _joined([texts[i] for i in order])
    place, period = _candidates(words, sizes, starts, least, times)
    found = [np.zeros((0, 3), np.int64) for _ in texts]
    owner = np.searchsorted(starts, place, side="right") - 1
    inside = place + period < starts[owner] + sizes[owner]  # the word one period on stands in the same text
    place, period, owner = place[inside], period[inside], owner[inside]
    if not len(place):
        return found
    # Only texts with a candidate go into the grammar, as the others have no run.
    asked = np.unique(owner)
    part_starts = np.concatenate([[0], np.cumsum(sizes[asked] + 1)])[:-1] + 1
    grammar = Grammar(_joined([texts[order[k]] for k in asked]), shortest=len(asked))
    row = np.searchsorted(asked, owner)
    place = place - starts[owner] + part_starts[row]
    ahead = grammar.agreement(place, place + period)
    behind = grammar.agreement(place - 1, place + period - 1, -1)
    length = ahead + behind + period
    kept = length >= np.maximum(least, times * period)
    table = np.stack([row[kept], (place - behind - part_starts[row])[kept], length[kept], period[kept]], axis=1)
    # A stretch is met once a cell and once a multiple of its period: the smallest period is its own.
    table = table[np.lexsort((table[:, 3], table[:, 2], table[:, 1], table[:, 0]))]
    new = np.concatenate([[True], (table[1:, :3] != table[:-1, :3]).any(axis=1)]) if len(table) else np.zeros(0, bool)
    table = table[new]
    table = table[np.lexsort((table[:, 3], table[:, 1], table[:, 0]))]
    edges = np.searchsorted(table[:, 0], np.arange(len(asked) + 1))
    for k, owner_row in enumerate(asked):
        found[order[owner_row]] = table[edges[k] : edges[k + 1], 1:]
    return found


def _joined(texts: list[np.ndarray]) -> np.ndarray:
    """All texts in one sequence, with a separator of its own before, between and after them."""
    apart = max((int(t.max()) + 1 for t in texts if len(t)), default=0)
    parts = []
    for i, text in enumerate(texts):
        parts += [[apart + i], text]
    return np.concatenate([*parts, [apart + len(texts)]]).astype(np.int64)


def _candidates(words: np.ndarray, sizes: np.ndarray, starts: np.ndarray, least: int, times: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, period) of every grid cell whose first words agree one period on; longer texts stand first."""
    period = np.arange(1, int(sizes.max(initial=0)) // times + 1)
    shortest = np.maximum(least, times * period)
    texts = np.searchsorted(-sizes, -shortest, side="right")
    period, shortest, texts = period[texts > 0], shortest[texts > 0], texts[texts > 0]
    end = starts[texts - 1] + sizes[texts - 1]  # of the texts long enough for this period
    cell = (shortest - period + 1) // 2
    cells = np.maximum(0, -(-(end - period) // cell))
    found = []
    many = int(np.searchsorted(-cells, -MANY, side="right"))  # periods with many cells are looked at one by one
    for p, e, c in zip(period[:many].tolist(), end[:many].tolist(), cell[:many].tolist()):
        places = np.flatnonzero(words[: e - p : c] == words[p:e:c]) * c
        found.append(_agreeing(words, places, np.full(len(places), p), min(c, COMPARED), e))
    blocks = np.searchsorted(np.cumsum(cells[many:]), np.arange(0, int(cells[many:].sum()) + TOGETHER, TOGETHER))
    for first, last in zip(blocks[:-1] + many, blocks[1:] + many):
        width = cells[first:last]
        row = np.repeat(np.arange(first, last), width)
        places = (np.arange(len(row)) - np.repeat(np.cumsum(width) - width, width)) * cell[row]
        same = words[places] == words[places + period[row]]
        row, places = row[same], places[same]
        found.append(_agreeing(words, places, period[row], np.minimum(cell[row], COMPARED), end[row]))
    return tuple(np.concatenate(column) for column in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _agreeing(words: np.ndarray, places: np.ndarray, period: np.ndarray, compared, end) -> tuple[np.ndarray, np.ndarray]:
    """The (place, period) at which as many words as ``compared`` agree; the first is known to."""
    for j in range(1, COMPARED):
        ahead = np.minimum(places + period + j, len(words) - 1)
        kept = (j >= compared) | ((ahead < end) & (words[ahead - period] == words[ahead]))
        places, period = places[kept], period[kept]
        compared, end = (x[kept] if isinstance(x, np.ndarray) else x for x in (compared, end))
    return places, period


def collapsed(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words, joined by spaces, without those a run holds after its first period."""
    if not len(runs):
        return b" ".join(words)
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return b" ".join(compress(words, (np.cumsum(change)[:-1] == 0).tolist()))


def _solved(texts: list[bytes | None], least: int, times: int) -> Iterator[tuple[int, np.ndarray, bytes]]:
    """(number of words, runs, collapsed text) of each text, some ``TOGETHER`` words at a time."""
    held, size = [], 0

    def solve():
        numbers = defaultdict(count().__next__)
        coded = [np.fromiter(map(numbers.__getitem__, words), np.int64, len(words)) for words in held]
        for words, runs in zip(held, runs_of(coded, least, times)):
            yield len(words), runs, collapsed(words, runs)

    for text in texts:
        words = (text or b"").split()  # bytes are split at ASCII white space only
        if held and size + len(words) > TOGETHER:
            yield from solve()
            held, size = [], 0
        held.append(words)
        size += len(words)
    if held:
        yield from solve()


def find_runs(df: DataFrame, text: str = "text", *, least: int = LEAST, times: int = TIMES, runs: str = "runs", words: str = "n_words", into: str = "collapsed") -> DataFrame:
    """``df`` with the number of words, all periodic runs and the collapsed text of each whole text.

    ``runs`` holds (start, length, period) by start, then period; ``collapsed`` keeps of every run
    the first period only. A NULL or empty text has no words, no runs and the collapsed text ''.
    Each row is answered alone, so repeated rows get equal answers, and nothing is shuffled; other
    columns pass through, and columns of the new names are replaced. A text is held as a whole, in
    memory in proportion to its words.
    """
    if least < 2 or times < 2:
        raise ValueError("a run has at least two words and two periods")

    @F.arrow_udf(f"struct<{words}: bigint, {runs}: array<struct<start: bigint, length: bigint, period: bigint>>, {into}: string>")
    def solved(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            rows = list(_solved(batch.cast(pa.binary()).to_pylist(), least, times))
            flat = np.concatenate([r for _, r, _ in rows] or [np.zeros((0, 3), np.int64)])
            ends = np.cumsum([0, *(len(r) for _, r, _ in rows)])
            structs = pa.StructArray.from_arrays([pa.array(flat[:, i]) for i in range(3)], fields=list(RUN))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), structs)
            yield pa.StructArray.from_arrays([pa.array([n for n, *_ in rows], pa.int64()), lists, pa.array([c for *_, c in rows], pa.binary()).cast(pa.string())], [words, runs, into])

    found = "__runs"
    rows = in_small_batches(df).withColumn(found, solved(F.col(text)))
    return rows.withColumns({name: F.col(f"{found}.{name}") for name in (words, runs, into)}).drop(found)
