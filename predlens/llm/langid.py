"""Language identification by a byte convolutional network, trained and applied with numpy.

Text is cut into windows of a fixed number of bytes. Filters of several widths run over the
embedded bytes, each keeps its largest response in the window, and a softmax over those gives
the window's languages; a text's score is the mean over all its windows. For application the
filters are folded into tables over byte pairs, so that a filter costs a lookup and an
addition per two bytes of its width.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from predlens.llm.batches import in_small_batches
from predlens.llm.hashing import ticket

LETTER = regex.compile(r"\p{L}")
UNDETERMINED = "und"
BATCH = 128  # windows looked at together


@dataclass(frozen=True)
class Settings:
    """``per_language`` documents of each language, ``windows`` stretches of each, train the network."""

    window: int = 256
    widths: tuple[int, ...] = (2, 3, 4)
    filters: int = 16
    embedding: int = 8
    per_language: int = 400
    windows: int = 4
    epochs: int = 6
    rate: float = 0.01
    seed: int = 7


@dataclass
class ByteCnn:
    """Embedding, one filter bank per width, and the softmax layer."""

    languages: list[str]
    settings: Settings
    weights: dict[str, np.ndarray] = field(default_factory=dict)

    def __post_init__(self):
        if not self.weights:
            s, random = self.settings, np.random.default_rng(self.settings.seed)
            self.weights = {"embedding": random.normal(0, 1, (256, s.embedding))}
            for width in s.widths:
                self.weights[f"filter{width}"] = random.normal(0, (width * s.embedding) ** -0.5, (width * s.embedding, s.filters))
                self.weights[f"bias{width}"] = np.zeros(s.filters)
            total = s.filters * len(s.widths)
            self.weights["out"] = random.normal(0, total**-0.5, (total, len(self.languages)))
            self.weights["out_bias"] = np.zeros(len(self.languages))

    def loss_gradient(self, windows: np.ndarray, wanted: np.ndarray) -> dict[str, np.ndarray]:
        """Gradient of the mean cross entropy; through the pooling only the largest positions have one."""
        s, w = self.settings, self.weights
        n, rows = len(windows), np.arange(len(windows))[:, None]
        embedded = w["embedding"][windows]
        pooled, columns = [], {}
        for width in s.widths:
            places = windows.shape[1] - width + 1
            stretches = np.concatenate([embedded[:, j : j + places] for j in range(width)], axis=2)
            responses = stretches @ w[f"filter{width}"] + w[f"bias{width}"]
            at = responses.argmax(axis=1)
            columns[width] = (at, stretches[rows, at])
            pooled.append(np.take_along_axis(responses, at[:, None, :], axis=1)[:, 0])
        raw = np.concatenate(pooled, axis=1)
        hidden = np.maximum(raw, 0)
        error = softmax(hidden @ w["out"] + w["out_bias"])
        error[np.arange(n), wanted] -= 1
        error /= n
        gradient = {"out": hidden.T @ error, "out_bias": error.sum(axis=0), "embedding": np.zeros_like(w["embedding"])}
        down = (error @ w["out"].T) * (raw > 0)
        for i, width in enumerate(s.widths):
            part = down[:, i * s.filters : (i + 1) * s.filters]
            at, stretches = columns[width]
            gradient[f"filter{width}"] = np.einsum("nfd,nf->df", stretches, part)
            gradient[f"bias{width}"] = part.sum(axis=0)
            back = part[:, :, None] * w[f"filter{width}"].T[None]
            for j in range(width):
                np.add.at(gradient["embedding"], windows[rows, at + j], back[:, :, j * s.embedding : (j + 1) * s.embedding])
        return gradient

    def fit(self, windows: np.ndarray, wanted: np.ndarray) -> ByteCnn:
        """Adam over shuffled batches of 64 windows."""
        s, random = self.settings, np.random.default_rng(self.settings.seed)
        first = {k: np.zeros_like(v) for k, v in self.weights.items()}
        second = {k: np.zeros_like(v) for k, v in self.weights.items()}
        step = 0
        for epoch in range(s.epochs):
            rate = s.rate * (1 - epoch / s.epochs)
            order = random.permutation(len(windows))
            for start in range(0, len(order), 64):
                rows, step = order[start : start + 64], step + 1
                for name, g in self.loss_gradient(windows[rows], wanted[rows]).items():
                    first[name] += 0.1 * (g - first[name])
                    second[name] += 0.01 * (g * g - second[name])
                    scale = np.sqrt(second[name] / (1 - 0.99**step)) + 1e-8
                    self.weights[name] -= rate * (first[name] / (1 - 0.9**step)) / scale
        return self

    def tables(self) -> dict[int, list[np.ndarray]]:
        """Per width, what each byte pair (or last single byte) adds to the responses at its offset."""
        s, found = self.settings, {}
        for width in s.widths:
            parts = self.weights[f"filter{width}"].reshape(width, s.embedding, s.filters)
            single = [(self.weights["embedding"] @ part).astype(np.float32) for part in parts]
            pairs = [(single[j][:, None] + single[j + 1][None]).reshape(-1, s.filters) for j in range(0, width - 1, 2)]
            found[width] = pairs + ([single[-1]] if width % 2 else [])
        return found

    def scorer(self):
        """A function from windows, rows of bytes, to their probabilities."""
        s, tables = self.settings, self.tables()
        out, bias = self.weights["out"], self.weights["out_bias"]

        def score(windows: np.ndarray) -> np.ndarray:
            pairs = windows[:, :-1].astype(np.intp) * 256 + windows[:, 1:]
            pooled = []
            for width in s.widths:
                places = windows.shape[1] - width + 1
                total = None
                for j, table in enumerate(tables[width]):
                    index = pairs if len(table) == 65536 else windows
                    part = table.take(index[:, 2 * j : 2 * j + places], axis=0)
                    total = part if total is None else np.add(total, part, out=total)
                pooled.append(total.max(axis=1) + self.weights[f"bias{width}"])
            return softmax(row_products(np.maximum(np.concatenate(pooled, axis=1), 0), out) + bias)

        return score


def row_products(rows: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """``rows @ matrix``, each row added up in the same order whatever rows stand beside it.

    The last digits of a matrix product depend on how many rows it has.
    """
    total = np.zeros((len(rows), matrix.shape[1]))
    for column, weights in zip(rows.T, matrix):
        total += column[:, None] * weights
    return total


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def windows_of(data: bytes, size: int) -> np.ndarray:
    """All of a text in rows of ``size`` bytes, the last one filled up with zeros."""
    rows = -(-len(data) // size)
    return np.frombuffer(data.ljust(rows * size, b"\0"), np.uint8).reshape(rows, size)


def held_out(doc_id: str = "doc_id"):
    """Whether a document is kept from training: crc32 of its id as text, mod 4, is 2 (NULL: no)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_windows(docs: DataFrame, settings: Settings) -> pd.DataFrame:
    """(lang, window) of a bounded sample: per language the documents with the smallest hashes of their ids."""
    usable = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out() & F.col("text").rlike("\\p{L}"))
    size, n = settings.window, settings.windows
    starts = [F.floor(F.greatest(F.length("text") - size, F.lit(0)) * (i / max(1, n - 1))).cast("int") + 1 for i in range(n)]
    cut = F.array_distinct(F.transform(F.array(*starts), lambda at: F.struct(at.alias("at"), F.substr("text", at, F.lit(size)).alias("window"))))
    keyed = usable.select("lang", "doc_id", ticket(F.col("doc_id")).alias("ticket"), cut.alias("cut"))
    smallest = Window.partitionBy("lang").orderBy("ticket", "doc_id", "cut")
    kept = keyed.withColumn("place", F.row_number().over(smallest)).where(F.col("place") <= settings.per_language)
    rows = kept.select("lang", "ticket", F.explode("cut").alias("cut")).select("lang", "ticket", "cut.at", "cut.window").toPandas()
    return rows.sort_values(["lang", "ticket", "at", "window"], ignore_index=True)


def train(docs: DataFrame, settings: Settings = Settings()) -> ByteCnn | None:
    """A network for the languages of ``docs``; None if there are no labelled texts to learn from."""
    rows = training_windows(docs, settings)
    if rows.empty:
        return None
    languages = sorted(rows["lang"].unique())
    windows = np.concatenate([windows_of(text.encode()[: settings.window], settings.window) for text in rows["window"]])
    return ByteCnn(languages, settings).fit(windows, rows["lang"].map(languages.index).to_numpy())


def predictor(network: ByteCnn | None):
    """A function from a list of texts to (language, score) pairs, a batch of windows at a time."""
    score = network.scorer() if network else None

    def predict(texts: list[str | None]) -> tuple[list[str], list[float]]:
        known = [i for i, text in enumerate(texts) if network and text and LETTER.search(text)]
        sums = np.zeros((len(texts), len(network.languages) if network else 1))
        for rows, owners in _batches(texts, known, network.settings.window if network else 1):
            np.add.at(sums, owners, score(rows))
        languages, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
        for i in known:
            best = int(sums[i].argmax())
            languages[i], scores[i] = network.languages[best], float(min(1.0, sums[i, best] / sums[i].sum()))
        return languages, scores

    return predict


def _batches(texts, known: list[int], size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    held, owners, count = [], [], 0
    for i in known:
        windows = windows_of(texts[i].encode(), size)
        for start in range(0, len(windows), BATCH):
            part = windows[start : start + BATCH]
            held.append(part)
            owners.append(np.full(len(part), i))
            count += len(part)
            if count >= BATCH:
                yield np.concatenate(held), np.concatenate(owners)
                held, owners, count = [], [], 0
    if held:
        yield np.concatenate(held), np.concatenate(owners)


def with_language(df: DataFrame, network: ByteCnn | None, text: str = "text", language: str = "lang_pred", score: str = "score") -> DataFrame:
    """``df`` with the language of each whole text and the mean probability of it.

    ``und`` and 0 where the text is NULL or has no letter, or nothing was learned. Equal texts
    get equal answers; columns of the new names are replaced; nothing is shuffled. The network
    is a few hundred kB, whatever the number of documents.
    """
    shared = df.sparkSession.sparkContext.broadcast(network)

    @F.pandas_udf("language string, score double")
    def identified(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        predict = predictor(shared.value)
        for texts in batches:
            languages, scores = predict([t if isinstance(t, str) else None for t in texts])
            yield pd.DataFrame({"language": languages, "score": scores})

    found = "__language"
    return in_small_batches(df).withColumn(found, identified(F.col(text))).withColumns({language: F.col(f"{found}.language"), score: F.col(f"{found}.score")}).drop(found)


def identify_languages(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score.

    The network learns from ``docs`` itself, from labelled documents that are not held out.
    Languages, sources and ids are no inputs of a prediction.
    """
    rows = docs.select("doc_id", held_out().alias("held_out"), "text")
    return with_language(rows, train(docs, settings)).drop("text")
