"""Order-sensitive clean-up: merging split rows and keeping first occurrences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from postlake.session import materialise

# Lines one task orders at a time.
BLOCK_ROWS = 100_000


def merge_split_rows(
    df: DataFrame,
    keys: list[str],
    text: str,
    flag: str,
    file: str = "feed_file",
    order: str = "line_no",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Merge runs of adjacent lines with equal ``keys`` into one row.

    A line joins the line before it when both have the same keys and neither has ``flag``
    set.  The run's ``text`` is concatenated in order; every other column is the first
    line's.  ``order`` must number the lines of a file densely: a gap ends a run.

    Runs are found in blocks of consecutive lines rather than by key, so a key that holds
    a large share of the rows is spread like any other.  The last line of a block is
    repeated at the head of the next one, and runs that cross blocks are joined at the end
    from one partial row per block.  Lines that stand alone, which most do, are not grouped
    at all.
    """
    line, block = F.col(order), F.floor(F.col(order) / block_rows)
    payload = [c for c in df.columns if c not in (text, file)]

    at_edge = (line + 1) % block_rows == 0
    copies = F.when(
        at_edge,
        F.array(
            F.struct(block.alias("block"), F.lit(False).alias("ghost")),
            F.struct((block + 1).alias("block"), F.lit(True).alias("ghost")),
        ),
    ).otherwise(F.array(F.struct(block.alias("block"), F.lit(False).alias("ghost"))))
    rows = df.withColumn("_copy", F.explode(copies)).select(
        *df.columns, F.col("_copy.block").alias("_block"), F.col("_copy.ghost").alias("_ghost")
    )

    in_block = Window.partitionBy(file, "_block").orderBy(order)
    joins = (F.lag(order).over(in_block) == line - 1) & ~F.lag(flag).over(in_block) & ~F.col(flag)
    for k in keys:
        joins = joins & F.col(k).eqNullSafe(F.lag(k).over(in_block))
    starts = rows.withColumn("_start", F.when(~F.coalesce(joins, F.lit(False)), line))
    # The last line of a block has no next line to tell, so it is never taken as alone.
    next_starts = F.lead("_start").over(in_block).isNotNull()
    # Lines that continue a run of the block before have no start in their own block.
    so_far = in_block.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    runs = (
        starts.withColumn("_start", F.when(F.col("_ghost"), None).otherwise(F.col("_start")))
        .withColumn("_run", F.max("_start").over(so_far))
        .withColumn("_alone", F.col("_start").isNotNull() & next_starts)
        .filter(~F.col("_ghost"))
    )
    # Ordered once, read three times below.
    runs = materialise(runs.select(*df.columns, "_block", "_run", "_alone"), "runs")
    alone = runs.filter("_alone").select(*df.columns)

    def joined(value: str, position: str):
        pieces = F.array_sort(F.collect_list(F.struct(position, value)))
        return F.array_join(F.transform(pieces, lambda p: p[value]), "")

    partial = runs.filter(~F.col("_alone")).groupBy(file, "_block", "_run").agg(
        joined(text, order).alias(text),
        F.min_by(F.struct(*payload), F.col(order)).alias("_first"),
    )
    # The run a block's leading lines belong to is the last run started before the block.
    last_run = (
        runs.groupBy(file, "_block")
        .agg(F.max("_run").alias("_last"), F.bool_or(F.col("_run").isNull()).alias("_continues"))
        .withColumn(
            "_carried",
            F.last("_last", ignorenulls=True).over(
                Window.partitionBy(file)
                .orderBy("_block")
                .rowsBetween(Window.unboundedPreceding, -1)
            ),
        )
        .filter("_continues")
        .select(file, "_block", "_carried")
    )
    whole = partial.join(last_run, [file, "_block"], "left").withColumn(
        "_run", F.coalesce("_run", "_carried")
    )
    merged = (
        whole.groupBy(file, "_run")
        .agg(
            joined(text, "_block").alias(text),
            F.min_by("_first", F.col("_block")).alias("_first"),
        )
        .select(*[c if c in (text, file) else F.col(f"_first.{c}").alias(c) for c in df.columns])
    )
    return alone.unionByName(merged)


def dedup_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Keep the first row of each key.

    Spark takes the first row of a key within each task before the shuffle, so however
    many copies one key has, few of them move.
    """
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_n", first).filter("_n = 1").drop("_n")
