"""The registered queries of the training-data operators, with their check SQL.

Each is a thin layer: its operator over the whole table, then the columns that are compared.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from predlens.llm.bpe import decode_ids, encode_texts
from predlens.llm.checks import JACCARD_SQL, MIX_SQL, SHARD_SQL, TOP_K_SQL, VECTOR_SQL
from predlens.llm.langid import identify_languages
from predlens.llm.minhash import link_documents
from predlens.llm.mixing import mix_documents
from predlens.llm.mtree import top_k
from predlens.llm.periods import find_runs
from predlens.llm.pivots import link_vectors
from predlens.llm.quality import judge_quality
from predlens.llm.sharding import Tree, shard_documents
from predlens.llm.substrings import dedup_substrings
from predlens.llm.urls import judge_urls, sql_judged
from predlens.llm.whitening import whiten
from predlens.llm.wrappers import extract_main_text
from predlens.sources.tables import parquet_table

SHARDS = 8
VOCABULARY = "byte_bpe_50k.json"


def vocabulary_path() -> str:
    """Where the public tokenizer file lies; its package is looked up only when a query needs it."""
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def op1_hash_tree_shards(spark: SparkSession, folder: str) -> DataFrame:
    return shard_documents(parquet_table(spark, folder, "documents"), Tree.even(SHARDS))


def op2_pivot_permutation(spark: SparkSession, folder: str) -> DataFrame:
    return link_vectors(parquet_table(spark, folder, "embeddings")).drop("class_id")


def op3_mtree_top_k(spark: SparkSession, folder: str) -> DataFrame:
    return top_k(parquet_table(spark, folder, "embeddings"))


def op4_byte_cnn_language(spark: SparkSession, folder: str) -> DataFrame:
    return identify_languages(parquet_table(spark, folder, "documents"))


def op5_url_templates(spark: SparkSession, folder: str) -> DataFrame:
    return judge_urls(parquet_table(spark, folder, "pages")).withColumn("purity", F.round("purity", 9))


def op6_minhash_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    return link_documents(parquet_table(spark, folder, "documents"))


def op7_streaming_bpe(spark: SparkSession, folder: str) -> DataFrame:
    path = vocabulary_path()
    texts = parquet_table(spark, folder, "documents").select("doc_id", "text")
    return token_digests(decode_ids(encode_texts(texts, path).drop("text"), path), "doc_id")


def token_digests(coded: DataFrame, *columns: str) -> DataFrame:
    """``columns`` with the number of tokens and the digests of ids and decoded text."""
    return coded.select(
        *columns,
        F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("token_ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op8_fair_queue_mix(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mix_documents(parquet_table(spark, folder, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", F.round("finish", 9).alias("finish"))


def op9_chunk_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """One row per document: its text without repeated passages, and the ranges that were cut out."""
    docs = parquet_table(spark, folder, "documents").select("doc_id", "text")
    found = dedup_substrings(docs)
    cut = F.aggregate("removed", F.lit(0), lambda total, span: total + span["end"] - span["start"])
    return found.select("doc_id", "text", "removed", F.size("removed").alias("n_removed"), cut.alias("chars_removed"))


def op10_wrapper_text(spark: SparkSession, folder: str) -> DataFrame:
    return extract_main_text(parquet_table(spark, folder, "pages"))


def op11_multiplicity_whitening(spark: SparkSession, folder: str) -> DataFrame:
    rows, whitening, error = whiten(parquet_table(spark, folder, "embeddings").select("vec_id", "embedding"))
    shares = whitening.explained().tolist() if whitening else []
    explained = F.array(*map(F.lit, shares)).cast("array<double>")
    each = rows.select("vec_id", "deviation", F.posexplode("whitened").alias("place", "whitened"))
    return each.select(
        "vec_id",
        (F.col("place") + 1).alias("component"),
        F.lit(whitening.n if whitening else 0).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(explained, F.col("place")).alias("explained"),
        F.lit(error).alias("identity_error"),
    )


def planted_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, text): one document in ten, by the checksum of its id, repeats a stretch of its words to the end."""
    words = F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    with_words = docs.select("doc_id", "text", F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("h")).withColumn("w", F.when(F.col("h") % 10 == 0, words))
    n, g = F.size("w"), F.floor(F.col("h") / 10)
    placed = with_words.withColumn("a", (g % F.greatest(n, F.lit(1))).cast("int"))
    stretched = placed.withColumn("p", (1 + F.floor((n - F.col("a")) / (3 + g % 8))).cast("int"))
    again = F.transform("w", lambda word, i: F.when(i < F.col("a"), word).otherwise(F.get("w", F.col("a") + (i - F.col("a")) % F.col("p"))))
    return stretched.select("doc_id", F.when(n > 0, F.array_join(again, " ")).otherwise(F.col("text")).alias("text"))


def op12_recompression_runs(spark: SparkSession, folder: str) -> DataFrame:
    found = find_runs(planted_runs(parquet_table(spark, folder, "documents")))
    # Quotients of lengths below 2**26 are equal or differ as doubles, so the greatest is found exactly.
    strongest = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"] / r["period"]).alias("strength"), r["start"].alias("start"), r["period"].alias("period"), r["length"].alias("length"))))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.when(F.size("runs") > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise("")
    best = found.withColumn("best", strongest)
    return best.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.floor(F.lit(1000) * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def op13_ftrl_quality(spark: SparkSession, folder: str) -> DataFrame:
    return judge_quality(parquet_table(spark, folder, "documents"), parquet_table(spark, folder, "labels"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_hash_tree_shards, op2_pivot_permutation, op3_mtree_top_k, op4_byte_cnn_language, op5_url_templates, op6_minhash_jaccard, op7_streaming_bpe,
        op8_fair_queue_mix, op9_chunk_dedup, op10_wrapper_text, op11_multiplicity_whitening, op12_recompression_runs, op13_ftrl_quality,
    )
}

CHECK_SQL = {
    "op1_hash_tree_shards": SHARD_SQL,
    "op2_pivot_permutation": VECTOR_SQL,
    "op3_mtree_top_k": TOP_K_SQL,
    "op5_url_templates": sql_judged(),
    "op6_minhash_jaccard": JACCARD_SQL,
    "op8_fair_queue_mix": MIX_SQL,
}
