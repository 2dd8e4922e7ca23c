"""Dense line numbers for rows whose order matters, without one task seeing a whole file."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from postlake.operators.skew import fits
from postlake.session import materialise


def number_lines(df: DataFrame, file: str, block: str, name: str = "lines") -> DataFrame:
    """Add ``line_no`` (0, 1, 2, ... per file) to rows as a scan delivers them.

    ``block`` orders the scan splits of a file and tells which one a row came from.  Ids are
    consecutive inside a split, so it is enough to count each split and add up the counts before it.
    The rows are written once with their ids (the ids only hold for one run of the scan).
    The counts have one row per input split, and are broadcast if that is few enough.
    """
    fixed = materialise(df.withColumn("_id", F.monotonically_increasing_id()), name)
    before = Window.partitionBy(file).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    splits = (
        fixed.groupBy(file, block)
        .agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_rows"))
        .withColumn("_before", F.coalesce(F.sum("_rows").over(before), F.lit(0)))
        .select(file, block, (F.col("_before") - F.col("_first")).alias("_shift"))
    )
    splits = materialise(splits, f"{name}-splits")
    return (
        fixed.join(F.broadcast(splits) if fits(splits) else splits, [file, block])
        .withColumn("line_no", F.col("_id") + F.col("_shift"))
        .drop("_id", "_shift", block)
    )


def number_sorted(df: DataFrame, order: list[str], name: str = "sorted") -> DataFrame:
    """Add a dense ``line_no`` by a global order.

    A range-partitioned sort gives every task one slice of the order; slices are counted
    and shifted, one broadcast row per slice.  Rows equal in ``order`` may swap numbers.
    """
    placed = df.orderBy(*order).withColumn("_id", F.monotonically_increasing_id())
    fixed = materialise(placed.withColumn("_slice", F.shiftright("_id", 33)), name)
    before = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = (
        fixed.groupBy("_slice")
        .agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_rows"))
        .withColumn("_before", F.coalesce(F.sum("_rows").over(before), F.lit(0)))
        .select("_slice", (F.col("_before") - F.col("_first")).alias("_shift"))
    )
    return (
        fixed.join(F.broadcast(slices), "_slice")
        .withColumn("line_no", F.col("_id") + F.col("_shift"))
        .drop("_id", "_shift", "_slice")
    )
