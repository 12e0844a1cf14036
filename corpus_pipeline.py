"""The corpus pipeline: from raw documents to the token ids of a mix.

Every stage takes (spark, docs, sf_dir) and works on all that the one before kept; ``run`` writes
each result as Parquet to the shared folder and reads it again. All but the last return the
columns of ``documents``. No stage crashes on NULLs, empty or repeated rows or an empty table; what
each does with them is said at its operator.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from predlens.llm.bpe import decode_ids, encode_texts
from predlens.llm.langid import UNDETERMINED, train, with_language
from predlens.llm.minhash import one_per_group
from predlens.llm.mixing import mixed_rows
from predlens.llm.queries import token_digests, vocabulary_path
from predlens.llm.substrings import dedup_substrings
from predlens.session import durable
from predlens.sources.tables import parquet_table


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a language; those without any letter, empty and NULL texts go.

    A NULL lang becomes the language found; where no document could be learned from it stays NULL.
    """
    network = train(docs)
    if network is None:
        return docs.where(F.col("text").rlike("\\p{L}"))
    known = with_language(docs, network, language="__found", score="__certainty").where(F.col("__found") != UNDETERMINED)
    return known.withColumn("lang", F.coalesce("lang", "__found")).drop("__found", "__certainty")


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near-duplicates: five words, Jaccard 0.8 or more."""
    return one_per_group(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that a document with a smaller id keeps; n_chars follows the text."""
    cut = dedup_substrings(docs, into="__removed")
    if "n_chars" in docs.columns:
        length = F.length("text").cast(docs.schema["n_chars"].dataType)
        cut = cut.withColumn("n_chars", F.when(F.size("__removed") > 0, length).otherwise(F.col("n_chars")))
    return cut.drop("__removed")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them; what it does not take, and wordless texts, go."""
    return mixed_rows(docs)


def tokenised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, token_ids, n_tokens and the digests of the ids and of the text decoded from them."""
    path = vocabulary_path()
    coded = decode_ids(encode_texts(docs.select("doc_id", "lang", "source", "text"), path).drop("text"), path)
    return token_digests(coded, "doc_id", "lang", "source", "token_ids")


STAGES = [
    ("language_id", identified),
    ("jaccard_join", distinct),
    ("substring_dedup", without_repeats),
    ("source_mix", mixed),
    ("bpe", tokenised),
]

ORACLE_SQL = None  # a trained network, rolling hashes and merges are beyond SQL; tests/llm holds brute-force versions


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = parquet_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
