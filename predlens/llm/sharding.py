"""Sharding by a weighted hash tree: region, then rack, then shard.

Each node of a level makes a draw from the key and its own name, ``ln(u) / weight``; the
largest draw wins and the descent goes on below it. A node's weight is the sum of its
shards' weights. Draws of nodes whose weight stays are the same afterwards, so rows move only
into or out of subtrees whose weights changed. A shard added with :meth:`Tree.grown` becomes a
region of its own: no other weight changes, hence rows move into the new shard only.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from predlens.llm.hashing import RANGE, ticket
from predlens.llm.running import running_total


@dataclass(frozen=True)
class Shard:
    region: str
    rack: str
    number: int
    weight: float = 1.0


@dataclass(frozen=True)
class Tree:
    shards: tuple[Shard, ...]

    @staticmethod
    def even(count: int, fanout: int = 2) -> Tree:
        """``count`` equal shards, ``fanout`` a rack and ``fanout`` racks a region."""
        return Tree(tuple(Shard(f"r{i // fanout**2}", f"k{i // fanout}", i) for i in range(count)))

    def grown(self, weight: float = 1.0) -> Tree:
        number = max((s.number for s in self.shards), default=-1) + 1
        return Tree((*self.shards, Shard(f"grown{number}", f"grown{number}", number, weight)))

    def levels(self) -> dict:
        """``{region: {rack: {shard name: Shard}}}`` of the shards that take rows at all."""
        found: dict = {}
        for shard in self.shards:
            if shard.weight > 0:
                found.setdefault(shard.region, {}).setdefault(shard.rack, {})[f"s{shard.number}"] = shard
        return found


def weight_of(node) -> float:
    return node.weight if isinstance(node, Shard) else sum(weight_of(child) for child in node.values())


def draw(key: Column, name: str, weight: float) -> Column:
    uniform = (ticket(key, F.lit(name)) + F.lit(0.5)) / F.lit(float(RANGE))
    return F.log(uniform) / F.lit(float(weight))


def _winner(key: Column, children: dict) -> Column:
    """The child with the largest draw, by its place among the sorted names (ties: the later name)."""
    names = sorted(children)
    if len(names) == 1:
        return F.lit(0)
    draws = [F.struct(draw(key, name, weight_of(children[name])).alias("d"), F.lit(i).alias("i")) for i, name in enumerate(names)]
    return F.greatest(*draws)["i"]


def _branches(chosen: Column, values: list[Column]) -> Column:
    return reduce(lambda done, pair: done.when(chosen == pair[0], pair[1]), list(enumerate(values))[1:], F.when(chosen == 0, values[0]))


def with_shard(df: DataFrame, key: str, tree: Tree, into: str = "shard") -> DataFrame:
    """``df`` with the number of the shard that holds its row.

    Rows with a NULL key share the shard that the text ``null`` draws. The shard depends on
    the key and the tree alone.
    """
    levels = tree.levels()
    if not levels:
        raise ValueError("a tree needs a shard of positive weight")
    k, regions = F.col(key), sorted(levels)
    region, rack = "__region", "__rack"

    def deeper(make: Callable[[dict], Column]) -> Column:
        return _branches(F.col(region), [make(levels[name]) for name in regions])

    def shard_below(racks: dict) -> Column:
        found = []
        for name in sorted(racks):
            shards = racks[name]
            numbers = [F.lit(shards[s].number) for s in sorted(shards)]
            found.append(_branches(_winner(k, shards), numbers) if len(numbers) > 1 else numbers[0])
        return _branches(F.col(rack), found)

    return (
        df.withColumn(region, _winner(k, levels))
        .withColumn(rack, deeper(lambda racks: _winner(k, racks)))
        .withColumn(into, deeper(shard_below).cast("int"))
        .drop(region, rack)
    )


def shard_documents(docs: DataFrame, tree: Tree) -> DataFrame:
    """One row per document: its size, checksum, shard, place in the shard, and shard once one more exists.

    Slots run from 0 without gaps in each shard, by doc_id (NULL first), then checksum and size.
    A NULL text has the size 1 and no checksum; repeated rows get a slot each. Other columns
    than doc_id and text are not read.
    """
    narrow = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.col("text").cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    placed = with_shard(with_shard(narrow, "doc_id", tree), "doc_id", tree.grown(), "grown_shard")
    order = [F.col("doc_id"), F.col("text_crc32"), F.col("size")]
    slots = running_total(placed.withColumn("__one", F.lit(1).cast("long")), "shard", order, "__one", "slot")
    return slots.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
