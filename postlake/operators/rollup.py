"""Indicators kept per 5 minutes and merged to hours, days and months without reading logs again.

A row holds counts, which add up, and a sketch of the latencies of postal lookups, which merges.
Sketches are of bounded size (about ``k`` latencies and some), combine before the shuffle and are
exact up to ``k`` latencies.  Beyond, the rank of a quantile is off by a share that depends on
``k`` alone, however many rows were merged.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postlake.functions.text import safe_ratio
from postlake.operators.sli import SLI_WINDOW, counts, good_probe, is_lookup, ratios

SKETCH_K = 1000
#: Ranks of quantiles are off by less than this share at ``SKETCH_K`` (about three times the
#: error that 99 of 100 sketches keep to).
RANK_ERROR = 0.01
SUMS = ("requests", "errors", "not_found", "lookups", "lookup_ms", "probes", "probes_ok")


def rollup(
    log: DataFrame,
    window: str = SLI_WINDOW,
    by: Sequence[str] = (),
    watermark: str | None = None,
    k: int = SKETCH_K,
) -> DataFrame:
    """window_start, ``by``, the counts ``SUMS`` and latency (the sketch, null without lookups) of
    every window that has requests.  With a ``watermark`` also for streams.

    A null latency is a lookup without a latency: counted, but not in the sketch.
    """
    if watermark is not None:
        log = log.withWatermark("ts", watermark)
    latency = F.when(is_lookup(), F.col("latency_ms"))
    found = log.groupBy(F.window("ts", window).alias("window"), *by).agg(
        *counts(),
        F.count_if(is_lookup()).alias("lookups"),
        F.coalesce(F.sum(latency), F.lit(0)).alias("lookup_ms"),
        F.count_if(F.col("path") == "/ready").alias("probes"),
        F.count_if(good_probe()).alias("probes_ok"),
        F.kll_sketch_agg_bigint(latency, F.lit(k)).alias("_sketch"),
        F.count(latency).alias("_n"),
    )
    sketch = F.when(F.col("_n") > 0, F.col("_sketch")).alias("latency")
    return found.select(F.col("window.start").alias("window_start"), *by, *SUMS, sketch)


def merged(rows: DataFrame, unit: str, by: Sequence[str] = (), k: int = SKETCH_K) -> DataFrame:
    """``rows`` of ``rollup``, or of this function, merged to a longer ``unit`` such as ``hour``,
    ``day`` or ``month``."""
    start = F.date_trunc(unit, "window_start").alias("window_start")
    found = rows.groupBy(start, *by).agg(
        *[F.sum(c).alias(c) for c in SUMS],
        F.kll_merge_agg_bigint("latency", F.lit(k)).alias("_sketch"),
        F.count("latency").alias("_n"),
    )
    sketch = F.when(F.col("_n") > 0, F.col("_sketch")).alias("latency")
    return found.select("window_start", *by, *SUMS, sketch)


def quantile(share: float) -> Column:
    """The quantile of the sketch: one of the latencies, null without any."""
    found = F.kll_sketch_get_quantile_bigint("latency", F.lit(share))
    return F.when(F.col("latency").isNotNull(), found).cast("double")


def indicators(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """What ``rows`` of ``rollup`` or ``merged`` say: counts, ratios, mean and p95."""
    mean = F.when(F.col("lookups") > 0, F.col("lookup_ms") / F.col("lookups"))
    return rows.select(
        "window_start",
        *by,
        "requests",
        "errors",
        "not_found",
        *ratios(),
        mean.alias("mean_ms"),
        quantile(0.95).alias("p95_ms"),
        "lookups",
        "probes",
        "probes_ok",
        safe_ratio(F.col("probes_ok"), F.col("probes")).alias("availability"),
    )


def store(rows: DataFrame, path: str) -> None:
    """Keep ``rows`` of ``rollup`` under ``path``, a folder per day.  Days that ``rows`` have replace
    what was kept of them, so a run that is repeated counts nothing twice; ``rows`` must come
    from whole days."""
    days = rows.withColumn("day", F.to_date("window_start")).repartition("day")
    kept = days.write.partitionBy("day").mode("overwrite")
    kept.option("partitionOverwriteMode", "dynamic").parquet(path)


def stored(spark: SparkSession, path: str) -> DataFrame:
    """What ``store`` kept; filters on ``day`` skip folders."""
    return spark.read.parquet(path)


def rank_errors(log: DataFrame, rows: DataFrame, unit: str, share: float = 0.95) -> DataFrame:
    """window_start and rank_error of each of the merged ``rows`` that has latencies: by how large
    a share of the lookups in ``log`` its quantile misses ``share``.  An audit: it reads the log."""
    asked = rows.select("window_start", quantile(share).alias("_q")).filter("_q IS NOT NULL")
    latency = F.col("latency_ms")
    exact = log.filter(is_lookup() & latency.isNotNull())
    # latencies are whole milliseconds: one row per unit and latency meets the quantiles
    exact = exact.groupBy(F.date_trunc(unit, "ts").alias("window_start"), "latency_ms").agg(
        F.count(F.lit(1)).alias("_n")
    )

    def part(which: Column) -> Column:
        return F.sum(F.when(which, F.col("_n")).otherwise(0)) / F.sum("_n")

    found = exact.join(asked, "window_start").groupBy("window_start")
    found = found.agg(part(latency < F.col("_q")).alias("_below"), part(latency <= F.col("_q")).alias("_upto"))
    error = F.greatest(F.col("_below") - share, share - F.col("_upto"), F.lit(0.0))
    return found.select("window_start", error.alias("rank_error"))
