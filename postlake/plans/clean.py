"""From numbered feed records to unique address rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlake import schema as S
from postlake.functions import text
from postlake.operators.runs import BLOCK_ROWS, dedup_first, merge_split_rows
from postlake.operators.skew import fits


def _town(df: DataFrame) -> DataFrame:
    return df.withColumn("town", text.blank_unlisted(text.strip_parens(F.col("town"))))


def clean_feed(
    records: DataFrame,
    prefectures: DataFrame,
    merge_before_strip: bool = False,
    trim: bool = False,
) -> DataFrame:
    """Fold widths, strip parentheses, blank the "not listed" town, add prefecture ids.

    Unknown prefectures get id 0.  With ``merge_before_strip`` the town keeps its
    parentheses until split rows are merged.
    """
    tidy = text.trim_unicode if trim else (lambda c: c)
    folded = records
    for c in ("prefecture", "city", "town"):
        folded = folded.withColumn(c, tidy(text.fold_width(F.col(c))))
    if not merge_before_strip:
        folded = _town(folded)
    labels = prefectures.select(
        F.col("label").alias("prefecture"), F.col("id").alias("prefecture_id")
    )
    if fits(labels, 10_000):
        labels = F.broadcast(labels)
    return folded.join(labels, "prefecture", "left").withColumn(
        "prefecture_id", F.coalesce("prefecture_id", F.lit(0)).cast("smallint")
    )


def prepare_feed(
    records: DataFrame,
    prefectures: DataFrame,
    merge_before_strip: bool = False,
    trim: bool = False,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Clean, merge split rows, keep the first row of each address key."""
    merged = merge_split_rows(
        clean_feed(records, prefectures, merge_before_strip, trim),
        ["zip_code", "city_id"],
        text="town",
        flag="flag",
        block_rows=block_rows,
    )
    if merge_before_strip:
        merged = _town(merged)
    unique = dedup_first(merged, S.ADDRESS_KEY, ["feed_file", "line_no"])
    return unique.select(*S.ADDRESS_COLUMNS)
