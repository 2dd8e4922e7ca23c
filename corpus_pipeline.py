"""From raw documents to packed training sequences.

Each stage reads what the stage before it wrote.  All but the last return the columns of
``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postlake.llm import exact_dedup, mixing, packing, simhash, toxicity
from postlake.llm.frames import read_table, written

#: Tokenizer file, end id and sequence length of the packed sequences.
TOKENIZER = "byte_bpe_50k.json"
END_ID = 2
CAPACITY = 1024


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below one half for toxicity."""
    return toxicity.without_toxic(docs, read_table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.without_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose fingerprints are linked by at most two bits."""
    return simhash.without_near_duplicates(docs, shingle=3, max_bits=2)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Nine tenths of the words: English half of them if it has so many, the other languages
    and the sources of a language alike.  No document is taken twice."""
    kept = mixing.mix(
        docs,
        [("_language", F.col("lang")), ("_source", F.col("source"))],
        [F.expr("CASE _language WHEN 'en' THEN 3 ELSE 1 END"), F.lit(1)],
        mixing.word_count("text"),
        share=(9, 10),
        epochs=1,
        seed=11,
    )
    return kept.select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 1024 tokens."""
    path = public_tokenizers.path(TOKENIZER)
    return packing.pack_documents(docs, path, END_ID, CAPACITY)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("near dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: Toxicity, fingerprints and tokens are not SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
