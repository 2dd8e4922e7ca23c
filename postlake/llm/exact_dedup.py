"""Exact deduplication by progressive refinement, in DataFrame operations alone.

Texts are equal when they are identical without ASCII white space.  Rows are first grouped by
the length of that normal form and a hash of its first characters; only texts of groups with
at least two rows are then hashed in full.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlake.llm.frames import keep_one, sized, without_white, written

#: Characters of the normal form whose hash refines the groups of equal length.
HEAD = 256


def _marked(docs: DataFrame, id_col: str, text_col: str, head: int) -> DataFrame:
    """Id, code points, hash of the text as it is, normal form, its length and the hash of its
    head; nothing else of ``docs`` is read, so other columns may have any name."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.length(text).alias("points"),
        F.xxhash64(F.col(text_col)).alias("raw"),
        without_white(F.col(text_col)).alias("normal"),
    )
    return rows.withColumns(
        {
            "size": F.octet_length("normal"),
            "head": F.xxhash64(F.substring("normal", 1, head)),
        }
    )


def duplicate_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", head: int = HEAD
) -> DataFrame:
    """Groups of at least two rows with equal texts: sha256, keep_id, keep_raw, group_size.

    Of a group the row with the most code points stays, then the smallest id, then the
    smallest hash of the text as it is.  Every step
    counts before it shuffles, so a group with a third of all rows is one row per task.
    """
    rows = _marked(docs, id_col, text_col, head)
    # length, then length and head: a group of one head is a part of its length's group
    by_head = rows.groupBy("size", "head").agg(F.count(F.lit(1)).alias("n"))
    again = written(by_head.filter("n > 1").select("size", "head"), "dedup-heads")
    # full contents, of the surviving groups only
    left = rows.join(sized(again), ["size", "head"], "left_semi")
    full = left.select("doc_id", "points", "raw", F.sha2("normal", 256).alias("sha256"))
    return (
        full.groupBy("sha256")
        .agg(
            F.min(F.struct((-F.col("points")).alias("fewest"), "doc_id", "raw")).alias("first"),
            F.count(F.lit(1)).alias("group_size"),
        )
        .filter("group_size > 1")
        .select(
            "sha256",
            F.col("first.doc_id").alias("keep_id"),
            F.col("first.raw").alias("keep_raw"),
            "group_size",
        )
    )


def _verdicts(docs: DataFrame, id_col: str, text_col: str, head: int) -> DataFrame:
    """What ``exact_duplicates`` returns, and raw, the hash of the text as it is."""
    groups = written(duplicate_groups(docs, id_col, text_col, head), "dedup-groups")
    rows = _marked(docs, id_col, text_col, head)
    digests = rows.select("doc_id", "raw", F.sha2("normal", 256).alias("text_sha256"))
    joined = digests.join(sized(groups), F.col("text_sha256") == F.col("sha256"), "left")
    alone = F.col("sha256").isNull()
    first = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("raw") == F.col("keep_raw"))
    return joined.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.when(alone, F.lit(True)).otherwise(first).alias("kept"),
        "text_sha256",
        "raw",
    )


def exact_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", head: int = HEAD
) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    A null text counts as empty.  Null ids sort before all others.  Rows that repeat both an
    id and a text are counted and share a verdict; an empty table gives an empty result.
    """
    return _verdicts(docs, id_col, text_col, head).drop("raw")


def without_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", head: int = HEAD
) -> DataFrame:
    """``docs`` with one row of each group of equal texts, all its columns unchanged, also
    where rows repeat an id or both id and text."""
    verdicts = _verdicts(docs, id_col, text_col, head).filter("group_size > 1")
    verdicts = written(verdicts.select("doc_id", "raw", "kept"), "dedup-verdicts")
    return keep_one(docs, verdicts, id_col, text_col)
