"""Jaccard join of documents on word shingles by MinHash bands, verified on the full sets.

Copies first: texts with the same words are one class, and only classes go on. Bands and rows
are chosen so that a pair at the threshold shares a band with the wanted probability. Classes
that share a band are brought together in tiles of two blocks of bounded size: a block is a part
of the classes with the same anchor, the smallest class that any of their bands has, and a class
is sent to every block in which another class shares one of its bands. A tile compares the full
shingle sets and returns sums per class and the trees that connect it, not pairs; a pair
of classes meets in exactly one tile.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from predlens.llm.batches import in_small_batches
from predlens.llm.linking import classes_of, id_or_last, links_in_tiles, per_row, shared_buckets, tiles_of, with_links
from predlens.llm.shingles import mixed, shingles
from predlens.session import durable

SLAB = 8192  # shingles compared at once in a tile


@dataclass(frozen=True)
class Banding:
    """``recall`` is the probability that a pair at ``threshold`` shares a band; ``block`` classes make a block."""

    words: int = 5
    threshold: float = 0.8
    recall: float = 0.9999
    rows: int = 5
    block: int = 64
    seed: int = 5

    @cached_property
    def bands(self) -> int:
        """The fewest bands of ``rows`` hashes with that recall: 1 - (1 - t**rows)**bands."""
        return int(np.ceil(np.log(1 - self.recall) / np.log(1 - self.threshold**self.rows)))

    def factors(self) -> np.ndarray:
        return np.random.default_rng(self.seed).integers(0, 2**63, self.bands * self.rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def band_hashes(found: np.ndarray, banding: Banding, factors: np.ndarray) -> np.ndarray:
    """One number per band of a shingle set; equal minima in all rows of a band give equal numbers."""
    least = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(found), 1024):
        least = np.minimum(least, (factors[:, None] * found[None, start : start + 1024]).min(axis=1))
    bands = np.arange(banding.bands, dtype=np.uint64) + np.uint64(1)
    for row in range(banding.rows):
        bands = mixed(bands * np.uint64(0x9E3779B97F4A7C15) + least[row :: banding.rows])
    return bands.view(np.int64)


def with_class(docs: DataFrame) -> DataFrame:
    """``docs`` with ``class``, a digest of its text, and ``id``, never NULL.

    A text without words has no class.
    """
    has_words = F.col("text").rlike("[^\\x20\\x09-\\x0D]")
    return docs.withColumns({
        "class": F.when(has_words, F.md5(F.col("text").cast("binary"))),
        "id": id_or_last("doc_id"),
    })


def linked_classes(docs: DataFrame, banding: Banding = Banding()) -> DataFrame:
    """One row per distinct text of ``docs`` (doc_id, text) that has words.

    class, class_id, copies, first_rows, n_links (rows of other classes at the threshold or
    above), root (the same for all classes connected by links) and component_id (their smallest
    class_id).
    """
    keyed = with_class(docs.select("doc_id", "text"))
    known = classes_of(keyed.select("class", "id"))
    bands = durable(_bands(keyed, banding).join(known.select("class", "number"), "class").drop("class"), "bands")
    shared = durable(shared_buckets(bands), "buckets")
    tiles = durable(tiles_of(shared, banding.block), "tiles")
    met = tiles.select("number").distinct().join(known, "number").select("number", "class", F.col("class_id").alias("id"))
    sets = keyed.join(met, ["class", "id"]).select("number", "text").mapInPandas(_sets(banding), "number long, grams binary")
    packed = tiles.join(sets.dropDuplicates(["number"]), "number").join(known.select("number", "copies"), "number")
    links = durable(links_in_tiles(packed, _compared(banding), ["grams"]), "links")
    return with_links(known, links).drop("number")


def _bands(keyed: DataFrame, banding: Banding) -> DataFrame:
    """(class, bands), from the texts where they lie: no text is shuffled."""
    factors = banding.factors()

    def banded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [band_hashes(shingles(text, banding.words), banding, factors) for text in batch["text"]]
            yield pd.DataFrame({"class": batch["class"], "buckets": found})

    rows = in_small_batches(keyed.where("class IS NOT NULL").select("class", "text"))
    return rows.mapInPandas(banded, "class string, buckets array<long>").dropDuplicates(["class"])


def _sets(banding: Banding):
    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"number": batch["number"], "grams": [shingles(text, banding.words).tobytes() for text in batch["text"]]})

    return packed


def shared_counts(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How many shingles each set of ``left`` shares with each other one of ``right``, a slab of shingles at a time."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    distinct, place, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    several = count[place] > 1
    owner, place = owner[several], (np.cumsum(count > 1) - 1)[place[several]]
    order = np.argsort(place, kind="stable")
    owner, place = owner[order], place[order]
    found = np.zeros((len(left), len(right)), np.float32)
    for start in range(0, int(place[-1]) + 1 if len(place) else 0, SLAB):
        a, b = np.searchsorted(place, [start, start + SLAB])
        slab = np.zeros((len(sets), SLAB), np.float32)
        slab[owner[a:b], place[a:b] - start] = 1
        found += slab[left] @ slab[right].T
    return found


def _compared(banding: Banding):
    def compared(tile: dict, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sets = [np.frombuffer(grams, np.uint64) for grams in tile["grams"]]
        size = np.array([len(s) for s in sets], float)
        both = shared_counts(sets, left, right).astype(float)
        i, j = np.nonzero(both >= banding.threshold * (size[left][:, None] + size[right][None] - both) - 1e-9)
        return left[i], right[j]

    return compared


def link_documents(docs: DataFrame, banding: Banding = Banding()) -> DataFrame:
    """One row per document: doc_id, class_id, n_links, component_id, kept.

    Similarity is the Jaccard index of the sets of ``words`` successive words; a shorter text is
    one shingle. ``class_id`` is the smallest id with the same text, ``n_links`` counts the other
    documents at the threshold or above, copies included, and ``component_id`` is the smallest id
    reachable by links. A text that is NULL or has no words is linked with nothing: its class and
    component are its own id. ``kept`` marks the smallest id of a component, in every row that has
    it. Rows with a NULL id stand behind all others; a component without any id has none.
    """
    keyed = with_class(docs.select("doc_id", "text")).drop("text")
    return per_row(keyed, linked_classes(docs, banding), "doc_id")


def one_per_group(docs: DataFrame, banding: Banding = Banding()) -> DataFrame:
    """``docs`` with one document of every group of linked documents, and its own columns.

    It is the row with the smallest doc_id; of rows that repeat it with the same text one stays,
    and of different texts under the same id the one with the smallest digest. Documents without
    words stay, every one.
    """
    classes = linked_classes(docs, banding).where("class_id = component_id")
    best = classes.groupBy("root").agg(F.min(F.struct("class", "class_id", "first_rows")).alias("best")).select("best.*")
    best = durable(best.withColumnRenamed("class_id", "id"), "kept")
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__doc"), "doc_id", "text")
    kept = with_class(whole).drop("doc_id", "text").join(best, ["class", "id"], "left").where("first_rows IS NOT NULL OR class IS NULL")
    if not best.where("first_rows > 1").isEmpty():
        kept = kept.where("class IS NULL OR first_rows = 1").unionByName(kept.where("first_rows > 1").dropDuplicates(["class"]))
    return kept.select("__doc.*")
