"""Quality of texts: logistic regression on hashed word n-grams, fitted by follow-the-regularised-leader.

A text becomes a sparse vector: n-grams of its words, and n-grams of the words' shapes (letters
and digits as classes, punctuation as it is) together with whether a word repeats the one before
it. Each kind of n-gram is hashed into buckets and weighs the square root of its share, so a text
counts the same whatever its length. A score is one sparse dot product through the logistic
function.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from predlens.llm.batches import in_small_batches
from predlens.llm.hashing import ticket
from predlens.llm.langid import held_out
from predlens.llm.shingles import SPACE, mixed, segment_hashes
from predlens.session import durable

LIKELY = 0.7  # a score from which label 1 is predicted

#: Class of a byte in a shape: 0 is left out, letters and digits have a class each, punctuation its own.
SHAPE = np.arange(256, dtype=np.uint8)
SHAPE[128:] = 0
SHAPE[ord("a") : ord("z") + 1], SHAPE[ord("A") : ord("Z") + 1], SHAPE[ord("0") : ord("9") + 1] = ord("x"), ord("X"), ord("9")
GATHERED = np.isin(np.arange(256), [ord("x"), ord("X"), ord("9")])  # repeats of these classes count once


@dataclass(frozen=True)
class Settings:
    """``sample`` labelled documents are learned from at most; the rest are FTRL's own parameters."""

    bits: int = 18
    words: tuple[int, ...] = (1, 2)
    shapes: tuple[int, ...] = (1, 2, 3)
    sample: int = 5000
    epochs: int = 5
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 0.1
    l2: float = 0.1


def text_features(data: bytes, settings: Settings = Settings()) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and values of a text, in order of the buckets."""
    words, shapes = _words_and_shapes(np.frombuffer(data, np.uint8))
    if not len(words):
        return np.zeros(0, np.uint32), np.zeros(0)
    again = np.concatenate([[False], words[1:] == words[:-1]])
    shapes = mixed(shapes + again.astype(np.uint64))
    buckets, values = [], []
    for kind, (sequence, sizes) in enumerate(((words, settings.words), (shapes, settings.shapes))):
        for size in sizes:
            places = len(sequence) - size + 1
            if places <= 0:
                continue
            total = np.full(places, np.uint64(16 * size + kind))
            for j in range(size):
                total = mixed(total + sequence[j : j + places])
            found, times = np.unique((total >> np.uint64(64 - settings.bits)).astype(np.uint32), return_counts=True)
            buckets.append(found)
            values.append(np.sqrt(times / places))
    bucket, place = np.unique(np.concatenate(buckets), return_inverse=True)
    return bucket, np.bincount(place, np.concatenate(values))


def _words_and_shapes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash per word, and one of its shape."""
    space = SPACE[data]
    edges = np.diff(np.concatenate([[True], space, [True]]).astype(np.int8))
    starts, ends = np.flatnonzero(edges == -1), np.flatnonzero(edges == 1)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    shape = SHAPE[data]
    first = np.zeros(len(data), bool)
    first[starts] = True
    used = shape > 0
    # The class before, bytes that are left out not counting: letters around them are one stretch.
    last = np.maximum.accumulate(np.where(used, np.arange(len(data)), 0))
    before = np.concatenate([[0], last[:-1]])
    kept = used & ~space & ~(GATHERED[shape] & (shape[before] == shape) & (before >= np.maximum.accumulate(np.where(first, np.arange(len(data)), 0))) & ~first)
    at = np.concatenate([[0], np.cumsum(kept)])
    return segment_hashes(data, starts, ends), segment_hashes(shape[kept], at[starts], at[ends])


@dataclass
class Ftrl:
    """The per-coordinate state of FTRL-proximal; the last coordinate is the constant term, which bears no penalty."""

    settings: Settings = Settings()
    z: np.ndarray = field(init=False)
    n: np.ndarray = field(init=False)

    def __post_init__(self):
        size = (1 << self.settings.bits) + 1
        self.z, self.n = np.zeros(size), np.zeros(size)

    def weights(self, at=slice(None)) -> np.ndarray:
        """The regularised leader's weights."""
        s, z = self.settings, self.z[at]
        penalty = np.full(len(z), s.l1)
        penalty[-1], l2 = 0.0, np.full(len(z), s.l2)
        l2[-1] = 0.0
        return -np.sign(z) * np.maximum(np.abs(z) - penalty, 0) / ((s.beta + np.sqrt(self.n[at])) / s.alpha + l2)

    def learn(self, buckets: np.ndarray, values: np.ndarray, label: int) -> None:
        at, x = np.append(buckets, len(self.z) - 1), np.append(values, 1.0)
        w = self.weights(at)
        g = (logistic(float((w * x).sum())) - label) * x
        grown = np.sqrt(self.n[at] + g * g)
        self.z[at] += g - (grown - np.sqrt(self.n[at])) / self.settings.alpha * w
        self.n[at] += g * g


def logistic(x: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(x, -700, 700))))


@dataclass(frozen=True)
class QualityModel:
    weights: np.ndarray  # per bucket, the constant term last
    settings: Settings

    def score(self, data: bytes) -> float:
        buckets, values = text_features(data, self.settings)
        return logistic(float((self.weights[buckets] * values).sum() + self.weights[-1]))


def labelled_features(docs: DataFrame, labels: DataFrame, settings: Settings, label: str) -> DataFrame:
    """(ticket, label, buckets, values) of a bounded sample of labelled documents that are not held out.

    The labelled ids with the smallest hashes are taken; of several labels of an id the smallest
    counts, of several texts likewise.
    """
    usable = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & ~held_out())
    ids = usable.groupBy("doc_id").agg(F.min(label).cast("int").alias("label"))
    known = docs.where(F.col("doc_id").isNotNull() & ~held_out()).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    taken = ids.withColumn("ticket", ticket(F.col("doc_id"))).orderBy("ticket", "doc_id").limit(settings.sample)
    texts = known.join(F.broadcast(taken), "doc_id").groupBy("doc_id", "ticket", "label").agg(F.min("text").alias("text"))

    @F.pandas_udf("buckets binary, values binary")
    def made(texts: pd.Series) -> pd.DataFrame:
        pairs = [text_features(text.encode(), settings) for text in texts]
        return pd.DataFrame({"buckets": [b.tobytes() for b, _ in pairs], "values": [v.tobytes() for _, v in pairs]}, columns=["buckets", "values"])

    return in_small_batches(texts).select("ticket", "doc_id", "label", made("text").alias("made")).select("ticket", "doc_id", "label", "made.buckets", "made.values")


def train(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), label: str = "quality") -> QualityModel | None:
    """A model for the labels; None if there is no labelled document to learn from.

    The sample's rows stream past the learner in the order of their hashes, once an epoch.
    """
    rows = durable(labelled_features(docs, labels, settings, label), "labelled").orderBy("ticket", "doc_id")
    learner, seen = Ftrl(settings), 0
    for _ in range(settings.epochs):
        for row in rows.toLocalIterator():
            learner.learn(np.frombuffer(row["buckets"], np.uint32), np.frombuffer(row["values"]), row["label"])
            seen += 1
    return QualityModel(learner.weights(), settings) if seen else None


def with_quality(df: DataFrame, model: QualityModel | None, text: str = "text", score: str = "score", predicted: str = "predicted") -> DataFrame:
    """``df`` with the score of each whole text and whether it is at least ``LIKELY``.

    NULL and empty texts get the score of a text without words; 0.5 where nothing was learned.
    Equal texts get equal scores; columns of the new names are replaced, others pass through;
    nothing is shuffled. The weights are 2 MB, whatever the number of documents.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        held = shared.value
        for texts in batches:
            yield pd.Series([held.score(t.encode() if isinstance(t, str) else b"") if held else 0.5 for t in texts], dtype=float)

    rows = in_small_batches(df).withColumn(score, scored(F.col(text)))
    return rows.withColumn(predicted, (F.col(score) >= LIKELY).cast("int"))


def judge_quality(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    Labels, languages, sources and ids are no inputs of a score.
    """
    rows = docs.select("doc_id", held_out().alias("held_out"), "text")
    return with_quality(rows, train(docs, labels, settings)).drop("text")
