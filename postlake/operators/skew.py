"""Joins against reference data when one key may hold a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Broadcast nothing that has more rows than this (address rows stay near 100 bytes).
BROADCAST_ROWS = 500_000
# A key with more rows than this is spread over several tasks.
HOT_ROWS = 1_000_000


def fits(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether ``df`` has at most ``rows`` rows.

    A count moves one number per task, and on Parquet tables reads file footers only.
    """
    return df.count() <= rows


def key_counts(df: DataFrame, on: list[str]) -> DataFrame:
    """Rows per key as ``_n``, combined on the map side."""
    return df.groupBy(*on).agg(F.count(F.lit(1)).alias("_n"))


def hot_keys(counts: DataFrame, hot_rows: int) -> DataFrame:
    """Keys with at least ``hot_rows`` rows and over how many tasks to spread each.

    There can be at most ``rows / hot_rows`` of them whatever the distribution, which
    bounds their broadcast.
    """
    return (
        counts.filter(F.col("_n") >= hot_rows)
        .withColumn("_salts", F.ceil(F.col("_n") / hot_rows).cast("int"))
        .drop("_n")
    )


def spread_join(
    left: DataFrame,
    right: DataFrame,
    on: list[str],
    how: str = "inner",
    spread_by: Column | None = None,
    hot_rows: int = HOT_ROWS,
    counts: DataFrame | None = None,
) -> DataFrame:
    """Equi-join in which a hot key of ``left`` is split over many tasks.

    Rows of a hot key get one of n salts, and the ``right`` rows of that key are repeated
    for each salt; all other keys are joined as usual.  ``how`` is ``inner``, ``left``,
    ``left_semi`` or ``left_anti``.  Null keys never match, so they are simply spread.
    ``spread_by`` is what differs between rows of one key, by default all columns.
    ``counts`` are the rows per key of ``left`` if they are known already.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"cannot spread a {how} join")
    hot = F.broadcast(hot_keys(key_counts(left, on) if counts is None else counts, hot_rows))
    spread = F.xxhash64(*([spread_by] if spread_by is not None else left.columns))
    no_key = F.lit(False)
    for c in on:
        no_key = no_key | F.col(c).isNull()
    salted = left.join(hot, on, "left").withColumn(
        "_salt",
        F.when(no_key, F.pmod(spread, F.lit(1024)))
        .otherwise(F.pmod(spread, F.coalesce("_salts", F.lit(1))))
        .cast("int"),
    )
    copies = right.join(hot, on, "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))
    )
    return salted.drop("_salts").join(copies.drop("_salts"), [*on, "_salt"], how).drop("_salt")


def lookup_join(
    left: DataFrame,
    right: DataFrame,
    on: list[str],
    how: str = "inner",
    spread_by: Column | None = None,
    bound: DataFrame | None = None,
    broadcast_rows: int = BROADCAST_ROWS,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Join a large ``left`` to reference data: broadcast if its size was checked to be
    small, otherwise a shuffle that spreads hot keys.

    ``bound`` is a table with at least as many rows as ``right`` that is cheaper to count.
    """
    if fits(right if bound is None else bound, broadcast_rows):
        return left.join(F.broadcast(right), on, how)
    return spread_join(left, right, on, how, spread_by, hot_rows)
