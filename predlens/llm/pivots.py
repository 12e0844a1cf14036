"""Near-duplicates among embeddings by a pivot-permutation index.

A vector is described by its nearest reference points (pivots) in order. Every choice of
``shared`` of its ``prefix`` nearest pivots has an inverted list, so vectors that meet in a list
share at least that many pivots, and those that share no list are never compared. What all
vectors have in common is taken out before they are described, as it would decide the order of
the pivots; how many pivots describe a vector follows from the recall measured on pairs at the
threshold in a sample of the table itself. Equal vectors are one item; items that share a list are brought together in tiles, counted for shared pivots
and verified by their cosine in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from hashlib import md5
from itertools import combinations
from math import ceil, comb, log2

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from predlens.llm.linking import NO_ID, classes_of, id_or_last, links_in_tiles, per_row, shared_buckets, tiles_of, with_links
from predlens.llm.shingles import mixed
from predlens.session import durable


@dataclass(frozen=True)
class PivotIndex:
    """``prefix`` nearest pivots or more, lists of ``shared`` of them, links from cosine ``threshold`` on.

    The number of pivots grows with the cube root of the vectors, so that an unrelated vector
    shares a list with about ``strangers`` others whatever their number; it stays between
    ``fewest`` and ``most``, and the sample it is taken from is ``oversample`` times as large.
    Beyond ``dense`` pivots the nearest ones of a pair differ more, and each doubling takes one more.
    Up to ``widest`` pivots a vector are taken until pairs at the threshold meet with probability ``recall``,
    which leaves room for pairs that the sample does not show.
    """

    prefix: int = 8
    shared: int = 3
    threshold: float = 0.9
    strangers: float = 4.0
    fewest: int = 64
    most: int = 4096
    dense: int = 512
    oversample: int = 2
    widest: int = 16
    recall: float = 0.97
    apart: float = 0.8
    block: int = 128

    def pivots(self, vectors: int) -> int:
        lists = comb(self.prefix, self.shared)
        wanted = (6 * lists * lists * max(1, vectors) / self.strangers) ** (1 / 3)
        return int(min(self.most, max(self.fewest, wanted)))

    def near(self, pivots: int) -> int:
        """How many of so many pivots describe a vector."""
        return min(pivots, self.prefix + max(0, ceil(log2(max(1, pivots) / self.dense))))


def unit_rows(vectors, dimension: int) -> np.ndarray:
    """Vectors of length 1 as rows, in double precision; shorter ones are filled up with zeros."""
    rows = np.zeros((len(vectors), dimension))
    for i, vector in enumerate(vectors):
        rows[i, : len(vector)] = vector
    rows /= np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def usable(name: str = "embedding"):
    """Whether a vector has a direction: not NULL, no NULL or non-finite component, not all zero."""
    vector = F.transform(F.col(name), lambda x: x.cast("double"))
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(sound & F.exists(vector, lambda x: x != 0), F.lit(False))


@dataclass(frozen=True)
class Description:
    """What describes vectors: pivots, in the space in which ``centre`` is taken out, and the index with its prefix settled."""

    pivots: np.ndarray
    centre: np.ndarray
    index: PivotIndex
    recall: float  # of pairs at the threshold, as measured on the sample

    def spread(self, units: np.ndarray) -> np.ndarray:
        return _spread(units, self.centre)


def _spread(units: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Directions from the centre; what lies at it has none."""
    rows = units - centre
    size = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
    return np.where(size > 1e-9, rows / np.maximum(size, 1e-300), 0.0)


def describe(vectors: DataFrame, index: PivotIndex, dimension: int) -> Description | None:
    """Pivots and prefix from a bounded sample, the rows with the smallest hashes of their ids; None without rows.

    Of the ways to describe that bring pairs at the threshold together, the one that leaves the
    fewest lists and comparisons is taken. If none does, one list holds everything.
    """
    rows = vectors.count()
    wanted = index.pivots(rows)
    sample = vectors.orderBy(F.xxhash64("id"), "id", "embedding").limit(index.oversample * wanted).toPandas()
    if not len(sample):
        return None
    units = unit_rows(list(sample["embedding"]), dimension)
    one, other, kinds = _pairs_at(units, index.threshold)
    best = None
    for centre in (units.mean(axis=0), np.zeros(units.shape[1])):
        points = _spread(units, centre)
        pivots = points[_apart(points, index.apart, wanted)]
        first, second, crowd = (np.argsort(-(_spread(u, centre) @ pivots.T), axis=1, kind="stable") for u in (one, other, units[:TRIED]))
        for shared in range(index.shared, 0, -1):
            for prefix in range(index.prefix, index.widest + 1):
                tried = replace(index, prefix=prefix, shared=shared)
                near = tried.near(len(pivots))
                met = _common(first[:, :near], second[:, :near]) >= min(shared, near)
                recall = min([part.mean() for part in np.split(met, kinds) if len(part) >= FEW], default=met.mean())
                if recall >= index.recall:
                    strangers = np.mean([_common(crowd[:, :near], np.roll(crowd[:, :near], by, axis=0)) >= min(shared, near) for by in range(1, 17)])
                    cost = comb(near, min(shared, near)) + strangers * rows  # rows of lists and comparisons, for each vector
                    if best is None or cost < best[0]:
                        best = cost, Description(pivots, centre, tried, float(recall))
                    break
    return best[1] if best else Description(units[:1], np.zeros(units.shape[1]), replace(index, prefix=1, shared=1), 1.0)


TRIED = 600  # pairs of each kind on which a way to describe is tried
FEW = 30  # of fewer pairs of a kind nothing is concluded


def _apart(points: np.ndarray, apart: float, wanted: int) -> list[int]:
    """Points of which none is nearer than ``apart`` to one before it: a group of copies is no crowd of pivots."""
    nearest, chosen = np.full(len(points), -1.0), []
    for i in range(len(points)):
        if nearest[i] < apart and len(chosen) < wanted:
            chosen.append(i)
            nearest = np.maximum(nearest, points @ points[i])
    return chosen


def _pairs_at(units: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Pairs at the threshold, and where a kind of them ends.

    Each vector turned towards another one of the sample, each turned away from it, and the sample's
    own pairs nearest to the threshold.
    """
    one, towards = units[:TRIED], np.roll(units, 1, axis=0)[:TRIED]
    aside = towards - (towards * one).sum(axis=1, keepdims=True) * one
    size = np.sqrt((aside * aside).sum(axis=1, keepdims=True))
    if units.shape[1] > 1:  # a vector whose neighbour lies in its own direction turns along an axis
        axis = np.eye(units.shape[1])[np.abs(one).argmin(axis=1)]
        axis = axis - (axis * one).sum(axis=1, keepdims=True) * one
        aside = np.where(size > 1e-6, aside, axis)
        size = np.sqrt((aside * aside).sum(axis=1, keepdims=True))
    turn = np.sqrt(1 - threshold**2) * aside / np.maximum(size, 1e-300)
    some = units[:2048]
    cosines = np.triu(some @ some.T, 1)
    i, j = np.nonzero(cosines >= threshold)
    nearest = np.argsort(cosines[i, j], kind="stable")[:TRIED]
    left = [one, one, some[i[nearest]]]
    right = [threshold * one + turn, threshold * one - turn, some[j[nearest]]]
    return np.concatenate(left), np.concatenate(right), [len(one), 2 * len(one)]


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many entries the rows of ``a`` and ``b`` share; a row repeats none."""
    both = np.sort(np.concatenate([a, b], axis=1), axis=1)
    return (both[:, 1:] == both[:, :-1]).sum(axis=1)


def list_names(units: np.ndarray, pivots: np.ndarray, index: PivotIndex) -> tuple[np.ndarray, np.ndarray]:
    """Per vector its nearest pivots in order, and the names of its inverted lists."""
    near = index.near(len(pivots))
    ranked = np.argsort(-(units @ pivots.T), axis=1, kind="stable")[:, :near]
    ascending = np.sort(ranked, axis=1).astype(np.uint64)
    names = []
    for places in combinations(range(near), min(index.shared, near)):
        name = np.zeros(len(units), np.uint64)
        for place in places:
            name = mixed(name * np.uint64(31) + ascending[:, place] + np.uint64(1))
        names.append(name)
    return ranked, np.stack(names, axis=1).view(np.int64)


def _described(description: Description, dimension: int):
    def described(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            vectors = list(batch["embedding"])
            if not vectors:
                continue
            units = unit_rows(vectors, dimension)
            ranked, names = list_names(description.spread(units), description.pivots, description.index)
            yield pd.DataFrame({
                "id": batch["id"],
                "class": [md5(np.asarray(v, np.float64).tobytes()).hexdigest() for v in vectors],
                "unit": [row.tobytes() for row in units],
                "ranked": [row.astype(np.int32).tobytes() for row in ranked],
                "buckets": list(names),
            })

    return described


def _compared(index: PivotIndex):
    def compared(tile: dict, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        units = np.stack([np.frombuffer(unit) for unit in tile["unit"]])
        ranked = np.stack([np.frombuffer(row, np.int32) for row in tile["ranked"]])
        met, place = np.unique(ranked, return_inverse=True)
        has = np.zeros((len(units), len(met)), np.float32)
        np.put_along_axis(has, place.reshape(ranked.shape), 1, axis=1)
        candidate = has[left] @ has[right].T >= min(index.shared, ranked.shape[1])
        i, j = np.nonzero(candidate & (units[left] @ units[right].T >= index.threshold))
        return left[i], right[j]

    return compared


def link_vectors(vectors: DataFrame, index: PivotIndex = PivotIndex()) -> DataFrame:
    """One row per vector: vec_id, class_id, n_links, component_id, kept.

    Links join vectors with a cosine of ``threshold`` or more that the index brings together;
    ``n_links`` counts the other vectors linked directly, copies included, and ``component_id`` is
    the smallest vec_id reachable. Vectors without a direction are linked with nothing. Of vectors
    of different lengths the shorter counts as filled up with zeros. Rows with a NULL id stand
    behind all others; rows that repeat an id are vectors like any other. Reads vec_id, embedding.
    """
    rows = vectors.select("vec_id", id_or_last("vec_id").alias("id"), "embedding")
    sound = rows.where(usable()).select("id", "embedding")
    dimension = sound.agg(F.max(F.size("embedding")).alias("n")).first()["n"] or 1
    description = describe(sound, index, dimension)
    if description is None:
        own = F.col("vec_id").cast("long")
        return rows.select("vec_id", own.alias("class_id"), F.lit(0).cast("long").alias("n_links"), own.alias("component_id"), F.lit(True).alias("kept"))
    kind = "id long, class string, unit binary, ranked binary, buckets array<long>"
    described = durable(sound.mapInPandas(_described(description, dimension), kind), "described")
    known = classes_of(described.select("class", "id"))
    items = described.dropDuplicates(["class"]).join(known.select("class", "number", "copies"), "class")
    items = durable(items.select("number", "copies", "unit", "ranked", "buckets"), "items")
    shared = durable(shared_buckets(items), "buckets")
    tiles = durable(tiles_of(shared, index.block), "tiles")
    packed = tiles.join(items.select("number", "copies", "unit", "ranked"), "number")
    links = durable(links_in_tiles(packed, _compared(description.index), ["unit", "ranked"]), "links")
    keyed = described.select(F.when(F.col("id") != NO_ID, F.col("id")).alias("vec_id"), "id", "class")
    silent = rows.where(~usable()).select(F.col("vec_id").cast("long").alias("vec_id"), "id", F.lit(None).cast("string").alias("class"))
    return per_row(keyed.unionByName(silent), with_links(known, links), "vec_id")
