"""Substring deduplication by content-defined chunks.

A gear hash rolls over the bytes; where it meets a mask, a chunk ends. The decision looks at
the last 16 bytes, and 48 for white space, there is neither a least nor a greatest length, so equal passages are cut
alike wherever they stand and whatever was inserted before them. Chunks end behind white space
or, rarely, between other characters; in a stretch without any, as in scripts that do not space
words, between characters as often as else between a few words. What is compared by digest are
spans of successive chunks, each as short as it can be and still be a passage, not a common turn
of phrase. Every span stays in the document with the smallest id that has it, and at its first
place there; elsewhere its chunks are cut out. So whatever goes stood together, word for word, in
another place, however many of its phrases occur on their own in other documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from predlens.llm.batches import in_small_batches
from predlens.operators.ordering import with_position
from predlens.session import durable

WINDOW_STEPS = 4  # doublings: the hash looks at 2**4 bytes
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
STRETCH = 48  # bytes without white space after which text counts as unspaced
PER_WORD = 3  # unspaced characters that count as a word
FACTOR = 0x9E3779B97F4A7C15  # any odd number: the place of a chunk in its span
POWERS = tuple(np.cumprod(np.full(2048, base, np.uint64)) for base in (FACTOR, pow(FACTOR, -1, 2**64)))  # of most texts
NO_ID = 2**63 - 1  # rows without an id come last


@dataclass(frozen=True)
class Chunking:
    """A chunk ends at one in ``2**space_bits`` white spaces and one in ``2**other_bits`` other characters,
    ``2**unspaced_bits`` where no white space is near.

    Successive chunks are a passage from ``words`` words on; three unspaced characters count as one.
    """

    space_bits: int = 2
    other_bits: int = 10
    unspaced_bits: int = 4
    words: int = 20
    seed: int = 11

    def gear(self) -> np.ndarray:
        return np.random.default_rng(self.seed).integers(0, 2**16, 256, dtype=np.uint16)


def rolling_hash(data: np.ndarray, gear: np.ndarray) -> np.ndarray:
    """h[i] = 2 h[i-1] + gear[data[i]] in 16 bits, all places at once by doubling the window."""
    h = gear[data]
    for step in range(WINDOW_STEPS):
        width = 1 << step
        h[width:] = h[width:] + (h[:-width] << width)
    return h


def unspaced(space: np.ndarray) -> np.ndarray:
    """Which bytes follow on ``STRETCH`` bytes without white space and are none."""
    found = np.zeros(len(space), bool)
    edges = np.concatenate([[-1], np.flatnonzero(space), [len(space)]])
    for run in np.flatnonzero(np.diff(edges) > STRETCH + 1).tolist():  # few: most texts have none
        found[edges[run] + 1 + STRETCH : edges[run + 1]] = True
    return found


def least_hash(bits: int) -> int:
    """The hash below which one in ``2**bits`` places lies."""
    return 1 << (16 - bits)


def chunk_ends(data: np.ndarray, chunking: Chunking, gear: np.ndarray) -> np.ndarray:
    """Where the chunks of a text end, in bytes; the last one at the end of the text."""
    if not len(data):
        return np.zeros(0, np.int64)
    h = rolling_hash(data, gear)
    space = SPACE[data]
    starts = np.ones(len(data), bool)  # a character ends where the next byte does not continue it
    starts[:-1] = (data[1:] & 0xC0) != 0x80
    cut = np.where(space, h < least_hash(chunking.space_bits), starts & (h < least_hash(chunking.other_bits)))
    apart = unspaced(space)
    if apart.any():
        cut |= apart & starts & (h < least_hash(min(chunking.unspaced_bits, chunking.other_bits)))
    cut[-1] = True
    return np.flatnonzero(cut) + 1


def spans(data: np.ndarray, ends: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The first chunk, and the one behind the last, of every shortest span of ``least`` words.

    From each chunk forwards and from each chunk backwards: the spans within a passage cover all its chunks.
    """
    words, least = word_starts(data, np.concatenate([[0], ends])), PER_WORD * least
    behind = np.searchsorted(words, words[:-1] + least, "left")
    before = np.searchsorted(words, words[1:] - least, "right") - 1
    n, chunk = len(words), np.arange(len(ends))
    forwards, backwards = behind < n, before >= 0
    found = np.concatenate([chunk[forwards] * n + behind[forwards], before[backwards] * n + chunk[backwards] + 1])
    found.sort()
    if len(found):
        found = found[np.concatenate([[True], found[1:] != found[:-1]])]
    return np.divmod(found, n)


def chunk_digests(data: bytes, ends: np.ndarray, least: int = Chunking.words) -> np.ndarray:
    """A digest per span of chunks, from those of its chunks, which do not count white space at their ends."""
    digest, places = xxhash.xxh3_64_intdigest, ends.tolist()
    found = np.array([digest(data[start:end].strip()) for start, end in zip([0, *places], places)], np.uint64)
    first, behind = spans(np.frombuffer(data, np.uint8), ends, least)
    power, inverse = (known[: len(ends)] if len(ends) <= len(known) else np.cumprod(np.full(len(ends), known[0])) for known in POWERS)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(found * inverse, dtype=np.uint64)])
    mixed = (sums[behind] - sums[first]) * power[first]  # the same wherever the span begins
    return (mixed ^ mixed >> np.uint64(32)).view(np.int64)


def word_starts(data: np.ndarray, places: np.ndarray | None = None) -> np.ndarray:
    """How many words start before each of the given bytes, or of all and the end, in shares of ``PER_WORD``; unspaced characters count one."""
    if places is None:
        places = np.arange(len(data) + 1)
    space = SPACE[data]
    begins = ~space
    begins[1:] &= space[:-1]
    found = PER_WORD * np.searchsorted(np.flatnonzero(begins), places)
    apart = unspaced(space)
    if apart.any():
        found += np.searchsorted(np.flatnonzero(apart & ((data & 0xC0) != 0x80)), places)
    return found


def passages(data: np.ndarray, ends: np.ndarray, digests: np.ndarray, foreign: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Byte ranges to cut out: the chunks of all spans of ``least`` words that are kept elsewhere or were met before."""
    order = np.argsort(digests, kind="stable")
    gone = np.isin(digests, foreign)
    gone[order[1:]] |= digests[order][1:] == digests[order][:-1]
    if not gone.any():
        return []
    first, behind = spans(data, ends, least)
    n = len(ends) + 1
    covered = np.cumsum(np.bincount(first[gone], minlength=n) - np.bincount(behind[gone], minlength=n)) > 0
    edges = np.flatnonzero(np.diff(np.concatenate([[0], covered.astype(np.int8)])))
    starts = np.concatenate([[0], ends])
    return [(int(starts[a]), int(starts[b])) for a, b in edges.reshape(-1, 2)]


def foreign_digests(rows: DataFrame, chunking: Chunking) -> DataFrame:
    """(id, foreign): for each document that has any, the digests that a document with a smaller id keeps.

    ``rows`` has id and text. A digest's rows are reduced to its smallest and largest id before
    and after the shuffle; only digests of several documents meet the documents again, and for
    that are made a second time, as they would fill more disk than the texts.
    """
    gear = chunking.gear()

    def chunked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids, digests = [], []
            for key, text in zip(batch["id"], batch["text"]):
                raw = text.encode()
                found = np.unique(chunk_digests(raw, chunk_ends(np.frombuffer(raw, np.uint8), chunking, gear), chunking.words))
                ids.append(np.full(len(found), key, np.int64))
                digests.append(found)
            if ids:
                yield pd.DataFrame({"id": np.concatenate(ids), "digest": np.concatenate(digests)})

    chunks = in_small_batches(rows.where("text <> ''")).mapInPandas(chunked, "id long, digest long")
    kept = chunks.groupBy("digest").agg(F.min("id").alias("keeper"), F.max("id").alias("last")).where("keeper < last")
    moved = chunks.join(kept.drop("last"), "digest").where("id > keeper")
    return moved.groupBy("id").agg(F.collect_set("digest").alias("foreign"))


def dedup_substrings(docs: DataFrame, chunking: Chunking = Chunking(), into: str = "removed") -> DataFrame:
    """``docs`` with ``text`` without repeated passages, and in ``into`` the ranges cut out.

    Ranges are (start, end) in characters of the old text, in order. Of each repeated passage the
    document with the smallest doc_id keeps one; the edges of a passage that share a chunk with
    other text stay. NULL and empty texts are left alone. Every row is a document of its own: rows
    with a NULL id come last, rows that share an id in the order of their texts' hashes, so that of
    equal rows one keeps its text. A column of the name ``into`` is replaced; no row is dropped. A
    document's digests never outgrow it.
    """
    columns = [c for c in docs.columns if c != into]
    whole = _told_apart(docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("__doc")))
    foreign = foreign_digests(whole.select("id", "__doc.text"), chunking)
    gear = chunking.gear()

    @F.pandas_udf("text string, removed array<struct<start:int,end:int>>")
    def cut(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, foreigns in batches:
            done = [_without(text, other, chunking, gear) for text, other in zip(texts, foreigns)]
            yield pd.DataFrame({"text": [d[0] for d in done], "removed": [d[1] for d in done]})

    joined = whole.join(foreign, "id", "left").withColumn("__cut", cut(F.col("__doc.text"), F.col("foreign")))
    return joined.select(*[(F.col("__cut.text") if c == "text" else F.col(f"__doc.`{c}`")).alias(c) for c in columns], F.col("__cut.removed").alias(into))


def _told_apart(docs: DataFrame) -> DataFrame:
    """``docs``, of one column ``__doc``, with an ``id`` that no two rows share, in the order of doc_id.

    That is doc_id, where it tells the rows apart; else all rows are numbered, and written for it.
    """
    named = docs.withColumn("id", F.coalesce(F.col("__doc.doc_id").cast("long"), F.lit(NO_ID)))
    if named.groupBy("id").count().where("count > 1").isEmpty():
        return named
    hashed = named.withColumn("hash", F.xxhash64("__doc.text"))
    return durable(with_position(hashed, ["id", "hash"], "place").select("__doc", F.col("place").alias("id")), "numbered")


def _without(text, foreign, chunking: Chunking, gear: np.ndarray):
    if not isinstance(text, str) or not text:
        return (text if isinstance(text, str) else None), []
    raw = text.encode()
    data = np.frombuffer(raw, np.uint8)
    ends = chunk_ends(data, chunking, gear)
    other = np.asarray(foreign if foreign is not None else [], np.int64)
    gone = passages(data, ends, chunk_digests(raw, ends, chunking.words), other, chunking.words)
    if not gone:
        return text, []
    kept, at = [], 0
    for start, end in gone:
        kept.append(raw[at:start])
        at = end
    kept.append(raw[at:])
    characters = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return b"".join(kept).decode(), [{"start": int(characters[a]), "end": int(characters[b])} for a, b in gone]
