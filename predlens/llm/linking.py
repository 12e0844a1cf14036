"""Linking distinct items that share a bucket: tiles of bounded size, sums per item, components.

Items (rows with the same content) are dealt into blocks and compared block by block. What comes
back are counts per item and the trees that connect them, never pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from predlens.llm.batches import in_small_batches
from predlens.llm.components import components
from predlens.session import durable

NO_ID = 2**63 - 1  # an item whose rows all have no id stands behind the others
LINKS = "number long, n_links long, root long"


def id_or_last(column: str) -> Column:
    return F.coalesce(F.col(column).cast("long"), F.lit(NO_ID))


def classes_of(keyed: DataFrame) -> DataFrame:
    """(class, class_id, copies, first_rows, number) of rows (class, id).

    Per class the smallest id, its rows, its rows with that id, and a number of its own. NULL is no class.
    """
    by_id = keyed.where("class IS NOT NULL").groupBy("class", "id").agg(F.count("*").alias("first_rows"))
    sums = by_id.groupBy("class").agg(F.min("id").alias("class_id"), F.sum("first_rows").alias("copies"))
    classes = sums.join(by_id.withColumnRenamed("id", "class_id"), ["class", "class_id"])
    return durable(classes.withColumn("number", F.monotonically_increasing_id()), "classes")


def shared_buckets(items: DataFrame) -> DataFrame:
    """(bucket, number, low) of items (number, buckets): the buckets of several items, and the smallest item of each."""
    buckets = items.select("number", F.explode("buckets").alias("bucket"))
    several = buckets.groupBy("bucket").agg(F.min("number").alias("low"), F.max("number").alias("high")).where("low < high")
    # Written down, so that the join below may split a bucket that holds very many items.
    return buckets.join(durable(several.select("bucket", "low"), "several"), "bucket")


def tiles_of(shared: DataFrame, size: int) -> DataFrame:
    """(tile, one, number, block): where each item is compared.

    Items with the same anchor, the smallest item in any of their buckets, are dealt by hash
    into blocks of about ``size``. An item goes to the tile of its block with every block that
    holds another item of one of its buckets, so two items meet in one tile at most.
    """
    anchors = shared.groupBy("number").agg(F.min("low").alias("anchor"))
    sizes = anchors.groupBy("anchor").agg(F.ceil(F.count("*") / size).alias("parts"))
    part = F.pmod(F.xxhash64("number"), F.col("parts"))
    blocks = durable(anchors.join(sizes, "anchor").select("number", F.xxhash64("anchor", part).alias("block")), "blocks")
    placed = durable(shared.select("bucket", "number").join(blocks, "number"), "placed")
    met = durable(placed.groupBy("bucket").agg(F.collect_set("block").alias("blocks")), "met")
    sent = placed.join(met, "bucket").groupBy("number", "block").agg(F.array_distinct(F.flatten(F.collect_set("blocks"))).alias("blocks"))
    each = sent.select("number", "block", F.explode("blocks").alias("other"))
    return each.select(F.least("block", "other").alias("tile"), F.greatest("block", "other").alias("one"), "number", "block")


def roots_of(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index reachable from each of ``n`` by the links (a, b)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def links_in_tiles(packed: DataFrame, compare: Callable, payload: list[str]) -> DataFrame:
    """``LINKS`` of all tiles. ``packed`` has tile, one, number, block, copies and the columns ``payload``.

    ``compare`` gets the payload of a tile as arrays with the places of its first and second
    block, and returns the places (a, b) of the linked items. The tiles stream through a task
    one after the other, as there are very many small ones.
    """
    columns = ["tile", "one", "number", "block", "copies", *payload]
    dealt = packed.select(*columns).repartition("tile", "one").sortWithinPartitions("tile", "one", "number")

    def linked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
            last = _starts(rows)[-1]
            held = rows.iloc[last:]
            yield _sums(rows.iloc[:last], compare, payload)
        if held is not None:
            yield _sums(held, compare, payload)

    return in_small_batches(dealt).mapInPandas(linked, LINKS)


def _starts(rows: pd.DataFrame) -> np.ndarray:
    tile, one = rows["tile"].to_numpy(), rows["one"].to_numpy()
    return np.concatenate([[0], np.flatnonzero((tile[1:] != tile[:-1]) | (one[1:] != one[:-1])) + 1])


def _sums(rows: pd.DataFrame, compare: Callable, payload: list[str]) -> pd.DataFrame:
    found: list[tuple] = []
    if len(rows):
        columns = {name: rows[name].to_numpy() for name in rows.columns}
        starts = _starts(rows)
        for start, end in zip(starts, [*starts[1:], len(rows)]):
            tile, one, block = columns["tile"][start], columns["one"][start], columns["block"][start:end]
            left, right = np.flatnonzero(block == tile), np.flatnonzero(block == one)
            if end - start < 2 or not len(left) or not len(right):
                continue
            a, b = compare({name: columns[name][start:end] for name in payload}, left, right)
            if tile == one:
                a, b = a[a < b], b[a < b]
            if len(a):
                found.append(_per_item(columns["number"][start:end], columns["copies"][start:end], a, b))
    parts = list(zip(*found)) or [[np.zeros(0, np.int64)]] * 3
    return pd.DataFrame({name: np.concatenate(part) for name, part in zip(("number", "n_links", "root"), parts)})


def _per_item(number: np.ndarray, copies: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple:
    """Per linked item of a tile, sorted by number: the rows linked with it, and the smallest number it reaches."""
    links = np.bincount(a, copies[b], len(number)) + np.bincount(b, copies[a], len(number))
    some = links > 0
    return number[some], links[some].astype(np.int64), number[roots_of(len(number), a, b)][some]


def with_links(known: DataFrame, links: DataFrame) -> DataFrame:
    """Items ``known`` (number, class_id, ...) with n_links, root and component_id."""
    sums = links.groupBy("number").agg(F.sum("n_links").alias("n_links"))
    counted = _with_components(known, links).join(sums, "number", "left")
    return counted.withColumn("n_links", F.coalesce("n_links", F.lit(0)).cast("long"))


def _with_components(known: DataFrame, links: DataFrame) -> DataFrame:
    """``known`` with root and component_id."""
    found = durable(components(links.select(F.col("number").alias("a"), F.col("root").alias("b"))), "components")
    named = found.withColumnRenamed("node", "number").withColumnRenamed("component", "root").join(known.select("number", "class_id"), "number")
    least = named.groupBy("root").agg(F.min("class_id").alias("component_id"))
    joined = known.join(named.select("number", "root").join(least, "root"), "number", "left")
    return joined.withColumns({"root": F.coalesce("root", "number"), "component_id": F.coalesce("component_id", "class_id")})


def per_row(keyed: DataFrame, classes: DataFrame, name: str) -> DataFrame:
    """One row per row of ``keyed`` (the id column ``name``, id, class): class_id, n_links, component_id, kept."""
    joined = keyed.join(classes.select("class", "class_id", "copies", "n_links", "component_id"), "class", "left")
    known = F.col("class_id").isNotNull()

    def named(column: str) -> Column:
        return F.when(known, F.when(F.col(column) != NO_ID, F.col(column))).otherwise(F.col(name).cast("long"))

    return joined.select(
        name,
        named("class_id").alias("class_id"),
        F.when(known, F.col("n_links") + F.col("copies") - 1).otherwise(0).cast("long").alias("n_links"),
        named("component_id").alias("component_id"),
        F.when(known, F.col("id") == F.col("component_id")).otherwise(True).alias("kept"),
    )
