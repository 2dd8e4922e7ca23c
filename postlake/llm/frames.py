"""Small helpers that the operators share."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postlake.operators.skew import BROADCAST_ROWS, fits
from postlake.session import materialise

CLEANUP = "spark.sql.shuffleDependency.fileCleanup.enabled"
#: White space of ASCII, the only separators of words.
WHITE = " \t\n\x0b\x0c\r"


def fresh(columns: Iterable[str], name: str) -> str:
    """``name``, lengthened until no column bears it (Spark ignores case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


@contextmanager
def brief_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of queries run inside go when the query ends, so that one stage's files
    need not stand beside the next one's."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back."""
    with brief_shuffles(df.sparkSession):
        return materialise(df, name)


def sized(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it was counted to be small, else as it is.

    ``df`` should be a written table, so that the count reads file footers only.
    """
    return F.broadcast(df) if fits(df, rows) else df


def keep_one(docs: DataFrame, verdicts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``docs`` without the rows that ``verdicts`` drops, and one of those identical in id and
    text that it keeps.

    ``verdicts`` is a written table of doc_id, raw (the text's xxhash64) and kept, with a row
    per row of ``docs`` that has a verdict; rows without one stay.  Only rows that occur
    repeatedly are grouped, and combined before the shuffle.
    """
    dropped = written(verdicts.filter("NOT kept").select("doc_id", "raw"), "dropped")
    often = verdicts.filter("kept").groupBy("doc_id", "raw").agg(F.count(F.lit(1)).alias("n"))
    often = written(often.filter("n > 1").select("doc_id", "raw"), "repeated")
    gone, raw = fresh(docs.columns, "_gone"), fresh(docs.columns, "_raw")
    same = docs[id_col].eqNullSafe(F.col(gone)) & (F.xxhash64(docs[text_col]) == F.col(raw))
    left = docs.join(sized(dropped.toDF(gone, raw)), same, "left_anti")
    if often.isEmpty():
        return left
    keys = sized(often.toDF(gone, raw))
    once = left.join(keys, same, "left_semi").withColumn(raw, F.xxhash64(F.col(text_col)))
    once = once.dropDuplicates([id_col, raw]).drop(raw)
    return left.join(keys, same, "left_anti").union(once)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def without_white(text: Column) -> Column:
    """``text`` without its white space; null counts as empty."""
    out = F.coalesce(text, F.lit(""))
    for c in WHITE:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out
