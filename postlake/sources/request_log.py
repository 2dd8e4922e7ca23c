"""Request logs: one JSON line per request among other text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlake import schema as S


def parse_request_log(lines: DataFrame, line: str = "value") -> tuple[DataFrame, DataFrame]:
    """Split log lines, batch or streaming, into (request events, all other lines).

    ``lines`` carries the collector's event time ``ts`` and whatever else it adds.
    """
    parsed = lines.withColumn("_e", F.from_json(line, S.REQUEST_EVENT))
    is_event = F.coalesce(F.col("_e.event") == "api_request", F.lit(False))
    extra = [c for c in lines.columns if c != line]
    return (
        parsed.filter(is_event).select(*extra, "_e.*"),
        parsed.filter(~is_event).select(*lines.columns),
    )


def dependency_failures(lines: DataFrame, line: str = "value") -> DataFrame:
    """The lines that report a failed connection, with the ``dependency`` that failed."""
    text = F.col(line)
    failed = text.rlike(r"Failed to (connect|create|scan|delete)\b")
    cache = text.contains("Redis")
    database = text.rlike(r"Failed to (connect\b|get (a )?client\b|open SQLite database)")
    kind = F.when(failed & cache, "redis").when(database, "database")
    return lines.withColumn("dependency", kind).filter(F.col("dependency").isNotNull())


def dependency_errors(lines: DataFrame, line: str = "value", window: str = "5 minutes") -> DataFrame:
    """Failed connections to the database and to the cache per window."""
    return (
        dependency_failures(lines, line)
        .groupBy(F.window("ts", window).alias("window"), "dependency")
        .agg(F.count(F.lit(1)).alias("errors"))
        .select(
            F.col("window.start").alias("window_start"),
            F.col("window.end").alias("window_end"),
            "dependency",
            "errors",
        )
    )
