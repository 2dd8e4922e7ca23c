"""One query per operator, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from postlake.llm import (
    exact_dedup,
    line_dedup,
    mixing,
    packing,
    quality_gate,
    simhash,
    spelling,
    substrings,
    suffix_sort,
    token_counts,
    token_files,
    toxicity,
    whitening,
)
from postlake.llm.frames import read_table
from postlake.session import scratch_path

TOKENIZER = "byte_bpe_50k.json"
END_ID = 2


def _tokenizer() -> str:
    return public_tokenizers.path(TOKENIZER)


def op1_quality_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    return quality_gate.judged(docs, labels, copies_once=True).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
        "rejected_by",
    )


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(read_table(spark, sf_dir, "documents"))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select(
        "doc_id", "text", F.col("lang").alias("l"), F.col("source").alias("s")
    )
    number = F.regexp_extract(F.coalesce("s", F.lit("")), r"([0-9]+)$", 1)
    domain = F.concat(F.lit("d"), F.coalesce((number.try_cast("int") % 4).cast("string"), F.lit("")))
    mixed = mixing.mix(
        docs,
        [("domain", domain), ("lang", F.col("l")), ("source", F.col("s"))],
        [
            F.expr("CASE domain WHEN 'd0' THEN 4 WHEN 'd1' THEN 3 WHEN 'd2' THEN 2 ELSE 1 END"),
            F.expr("CASE lang WHEN 'en' THEN 5 WHEN 'de' THEN 2 WHEN 'fr' THEN 2 ELSE 1 END"),
            F.expr("CASE source WHEN 'src0' THEN 1 ELSE 2 END"),
        ],
        mixing.word_count("text"),
        share=(1, 1),
        epochs=2,
        seed=17,
    )
    return mixed.select("doc_id", "domain", "lang", "source", "epoch", "leaf_budget")


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    path = scratch_path(spark, "token-files")
    token_files.write_tokens(token_files.encoded(docs, _tokenizer(), END_ID), path)
    rows = token_files.crc32_of(token_files.read_tokens(spark, path))
    return rows.select("doc_id", "start", F.col("n_tokens").cast("long").alias("n_tokens"), "ids_crc32")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return simhash.near_duplicates(docs, shingle=3, max_bits=2)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(read_table(spark, sf_dir, "documents"), _tokenizer(), limit=512)


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substrings.without_repeats(read_table(spark, sf_dir, "documents"), length=50)
    return substrings.digests(kept)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return packing.pack_documents(docs, _tokenizer(), END_ID, capacity=1024)


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = suffix_sort.without_repeats(read_table(spark, sf_dir, "documents"), length=100)
    return suffix_sort.digests(kept)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    return toxicity.scores(docs, toxicity.train(docs, labels))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = whitening.whitened(read_table(spark, sf_dir, "embeddings"), count=4)
    return rows.withColumn("deviation", F.col("deviation").try_cast("long"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = spelling.word_counts(read_table(spark, sf_dir, "documents"), min_points=7, min_count=2, every=31)
    return spelling.spelling_variants(words, ratio=10)


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.digests(line_dedup.without_common_lines(docs, min_points=20, min_docs=3))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_gate": op1_quality_gate,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_mix_sources": op3_mix_sources,
    "op4_token_files": op4_token_files,
    "op5_simhash": op5_simhash,
    "op6_token_counts": op6_token_counts,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_packing": op8_packing,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_toxicity": op10_toxicity,
    "op11_whitening": op11_whitening,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_line_dedup": op13_line_dedup,
    "pipeline": corpus_pipeline.run,
}
