"""Exact top-k by inner product over paged M-trees.

The vectors are dealt into blocks by hash and each block is loaded into an M-tree: pages around
routing objects, with covering radius, the routing object's distance to the root object, and its
objects' distances to it. A query visits the pages of a block best first. With d(q, x) bounded from
below by the triangle inequality, the inner product (|q|^2 + |x|^2 - d(q, x)^2) / 2 is bounded from
above: by the stored distances alone a page is put off or left out before any distance to it is
computed, then by the distance to its routing object, and of its objects only those in the ring
around that distance are multiplied. The blocks' answers are merged.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from predlens.llm.batches import in_small_batches
from predlens.session import durable

PAGE = (
    "block long, kind int, place long, root binary, routing binary, parent_distance double, radius double, "
    "largest double, ids binary, rows binary, vectors binary, distances binary, query_id long, query_row long"
)
EXACT = 2.0**45  # products below this are exact as doubles and leave room for an object's place


@dataclass(frozen=True)
class MTree:
    """``block`` vectors make a tree, about ``page`` of them a page; ``batch`` queries are answered together."""

    block: int = 16384
    page: int = 256
    batch: int = 256


def quantised(vector, scale: int) -> np.ndarray:
    """floor(scale * x) of every component, whole numbers in double precision."""
    return np.floor(scale * np.asarray(vector, np.float64))


def finite(name: str = "embedding"):
    """Whether a vector is not NULL and all its components are finite numbers."""
    sound = F.forall(F.col(name), lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return F.coalesce(sound, F.lit(False))


def padded(rows: list[np.ndarray], dimension: int) -> np.ndarray:
    found = np.zeros((len(rows), dimension))
    for i, row in enumerate(rows):
        found[i, : len(row)] = row
    return found


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of the rows of ``a`` from those of ``b``."""
    square = (a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * (a @ b.T)
    return np.sqrt(np.maximum(square, 0))


def pages_of(ids: np.ndarray, vectors: np.ndarray, tree: MTree, rows: np.ndarray | None = None) -> Iterator[dict]:
    """The leaf pages of one block. Objects go to the nearest routing object; full pages are split by distance to it.

    ``rows`` tells objects apart; without them their ids do.
    """
    root = vectors[0]
    rows = ids if rows is None else rows
    count = -(-len(vectors) // tree.page)
    routing = vectors[np.linspace(0, len(vectors) - 1, count).astype(int)]
    apart = distances(vectors, routing)
    nearest = apart.argmin(axis=1)
    parents = distances(routing, root[None])[:, 0]
    for j in range(count):
        members = np.flatnonzero(nearest == j)
        members = members[np.argsort(apart[members, j], kind="stable")]
        for start in range(0, len(members), 2 * tree.page):
            part = members[start : start + 2 * tree.page]
            yield {
                "root": root, "routing": routing[j], "parent_distance": float(parents[j]),
                "radius": float(apart[part, j].max()), "largest": float((vectors[part] ** 2).sum(1).max()),
                "ids": ids[part], "rows": rows[part], "vectors": vectors[part], "distances": apart[part, j],
            }


def _loaded(tree: MTree, scale: int, dimension: int):
    def loaded(rows: pd.DataFrame) -> pd.DataFrame:
        vectors = padded([quantised(v, scale) for v in rows["embedding"]], dimension)
        ids, numbers, block = rows["vec_id"].to_numpy(np.int64), rows["row"].to_numpy(np.int64), rows["block"].iloc[0]
        order = np.argsort(numbers)
        shuffled = order[np.random.default_rng(int(block)).permutation(len(ids))]
        found = []
        for place, page in enumerate(pages_of(ids[shuffled], vectors[shuffled], tree, numbers[shuffled])):
            packed = {k: v.tobytes() if isinstance(v, np.ndarray) else v for k, v in page.items()}
            found.append({"block": block, "kind": 0, "place": place, **packed, "query_id": None, "query_row": None})
        return pd.DataFrame(found).astype({"query_id": "Int64", "query_row": "Int64"})

    return loaded


class Search:
    """Best-first search of one block's pages for batches of queries."""

    def __init__(self, pages: pd.DataFrame, dimension: int):
        def matrix(column: str) -> np.ndarray:
            return np.stack([np.frombuffer(row) for row in pages[column]])

        self.root = np.frombuffer(pages["root"].iloc[0])
        self.routing = matrix("routing")
        self.parents = pages["parent_distance"].to_numpy(float)
        self.radius = pages["radius"].to_numpy(float)
        self.largest = pages["largest"].to_numpy(float)
        ids = [np.frombuffer(row, np.int64) for row in pages["ids"]]
        self.objects = [np.frombuffer(row, np.int64) for row in pages["rows"]]
        self.vectors = [np.frombuffer(row).reshape(-1, dimension) for row in pages["vectors"]]
        self.distances = [np.frombuffer(row) for row in pages["distances"]]
        everything = np.concatenate(ids)
        order = np.lexsort([np.concatenate(self.objects), everything])
        self.by_id, self.size, places = everything[order], len(order), np.empty(len(order), np.int64)
        places[order] = np.arange(len(order))
        self.places = np.split(places, np.cumsum([len(i) for i in ids])[:-1])
        self.exact = max(np.abs(v).max(initial=0) for v in self.vectors) * np.sqrt(dimension)

    def _keys(self, queries: np.ndarray, page: int, part: slice) -> np.ndarray:
        """Scores with the place among the ids below them, so that equal scores prefer smaller ids."""
        vectors, places = self.vectors[page][part], self.places[page][part]
        if self.exact * np.abs(queries).max(initial=0) * np.sqrt(queries.shape[1]) < EXACT:
            scores = np.rint(queries @ vectors.T).astype(np.int64)
        else:  # beyond the range of exact products: whole numbers of any size
            whole = np.frompyfunc(int, 1, 1)
            scores = whole(queries) @ whole(vectors).T
        return scores * self.size + (self.size - 1 - places)[None]

    def best(self, own: np.ndarray, queries: np.ndarray, k: int) -> list[list[int]]:
        """Per query the keys of its ``k`` best objects other than itself, the row ``own``, largest first."""
        found: list[list[int]] = [[] for _ in own]
        norms = (queries**2).sum(1)
        to_root = distances(queries, self.root[None])[:, 0]
        gap = np.maximum(np.abs(to_root[:, None] - self.parents[None]) - self.radius[None], 0)
        bound = np.minimum((norms[:, None] + self.largest[None] - gap**2) / 2, np.sqrt(norms[:, None] * self.largest[None]))
        slack = 1e-9 * (norms[:, None] + self.largest[None]) + 1e-3
        order = np.argsort(-bound, axis=1, kind="stable")
        bound = bound + slack
        least = np.full(len(own), -np.inf)  # the k-th best score so far
        open_queries = np.arange(len(own))
        for step in range(bound.shape[1]):
            pages = order[open_queries, step]
            open_now = bound[open_queries, pages] >= least[open_queries]
            open_queries, pages = open_queries[open_now], pages[open_now]
            if not len(open_queries):
                break
            grouped = np.argsort(pages, kind="stable")
            cuts = np.flatnonzero(np.diff(pages[grouped])) + 1
            for members in np.split(grouped, cuts):
                self._visit(int(pages[members[0]]), open_queries[members], own, queries, norms, least, found, k)
        return found

    def _visit(self, page, rows, own, queries, norms, least, found, k) -> None:
        away = distances(queries[rows], self.routing[page][None])[:, 0]
        # An object at distance s of the routing object is out of reach if (away - s)^2 exceeds this.
        reach = np.sqrt(np.maximum(norms[rows] + self.largest[page] - 2 * least[rows], 0)) * (1 + 1e-9) + 1e-3
        near = away - self.radius[page] <= reach
        rows, away, reach = rows[near], away[near], reach[near]
        if not len(rows):
            return
        ring = self.distances[page]
        part = slice(int(np.searchsorted(ring, away - reach).min()), int(np.searchsorted(ring, away + reach, "right").max()))
        if part.start >= part.stop:
            return
        keys = self._keys(queries[rows], page, part)
        itself = self.objects[page][part][None] == own[rows][:, None]
        for i, row in enumerate(rows):
            held = found[row]
            mine = keys[i][~itself[i]]
            if len(held) == k:
                mine = mine[mine > held[-1]]
                if not len(mine):
                    continue
            if len(mine) > k and mine.dtype != object:
                mine = np.partition(mine, len(mine) - k)[-k:]
            held = sorted([*held, *mine.tolist()], reverse=True)[:k]
            found[row] = held
            if len(held) == k:
                least[row] = held[-1] // self.size

    def rows(self, query_ids: np.ndarray, own: np.ndarray, queries: np.ndarray, k: int) -> pd.DataFrame:
        found = self.best(own, queries, k)
        many = [len(keys) for keys in found]
        scores, ids = [], []
        for keys in found:
            for key in keys:
                score, place = divmod(key, self.size)
                scores.append(min(max(score, -(2**63)), 2**63 - 1))
                ids.append(self.by_id[self.size - 1 - place])
        return pd.DataFrame({"query_id": np.repeat(query_ids, many), "query_row": np.repeat(own, many), "vec_id": np.array(ids, np.int64), "score": np.array(scores, np.int64)})


def _searched(tree: MTree, k: int, dimension: int):
    """Answers from a stream of blocks: a block's pages come first, its queries follow."""

    def searched(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block, pages, search = None, [], None
        for batch in batches:
            for number, rows in batch.groupby("block", sort=True):
                if number != block:
                    block, pages, search = number, [], None
                stored, queries = rows[rows["kind"] == 0], rows[rows["kind"] == 1]
                if len(stored):
                    pages.append(stored)
                if not len(queries) or not pages:
                    continue
                search = search or Search(pd.concat(pages), dimension)
                for start in range(0, len(queries), tree.batch):
                    part = queries.iloc[start : start + tree.batch]
                    vectors = np.stack([np.frombuffer(row) for row in part["vectors"]])
                    yield search.rows(part["query_id"].to_numpy(np.int64), part["query_row"].to_numpy(np.int64), vectors, k)

    return searched


def top_k(vectors: DataFrame, every: int = 20, k: int = 20, scale: int = 64, tree: MTree = MTree()) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row with a vec_id divisible by ``every`` its ``k`` best other rows.

    Scores are inner products of the components' floor(``scale`` * x), ties go to the smaller
    vec_id; fewer than ``k`` others give fewer rows. Vectors that are NULL or hold NULL or
    non-finite components, and rows without vec_id, take no part. Rows that repeat a vec_id are rows
    like any other: each is a candidate for the others, and a query of its own where it is one.
    Shorter vectors are filled up with zeros. A score beyond 64 bits is the nearest number that
    fits. Reads vec_id and embedding.
    """
    sound = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(F.col("vec_id").isNotNull() & finite())
    # Written down with their numbers, so that a row has the same one as object and as query.
    numbered = durable(sound.withColumn("row", F.monotonically_increasing_id()), "vectors")
    sizes = numbered.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("d")).first()
    dimension, blocks = max(1, sizes["d"] or 1), max(1, -(-sizes["n"] // tree.block))
    dealt = numbered.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)))
    index = durable(dealt.groupBy("block").applyInPandas(_loaded(tree, scale, dimension), PAGE), "mtree")

    def asked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = padded([quantised(v, scale) for v in batch["embedding"]], dimension)
            yield pd.DataFrame({"query_id": batch["vec_id"], "query_row": batch["row"], "vectors": [row.tobytes() for row in rows]})

    queries = numbered.where(F.col("vec_id") % every == 0).mapInPandas(asked, "query_id long, query_row long, vectors binary")
    sent = queries.withColumns({"block": F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))), "kind": F.lit(1)})
    stream = index.unionByName(sent.withColumn("place", F.col("query_row")), allowMissingColumns=True)
    placed = stream.repartition(blocks, "block").sortWithinPartitions("block", "kind", "place")
    found = in_small_batches(placed).mapInPandas(_searched(tree, k, dimension), "query_id long, query_row long, vec_id long, score long")
    best = Window.partitionBy("query_row").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
