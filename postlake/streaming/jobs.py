"""Structured Streaming jobs: publishing feeds as they arrive, indicators as they happen."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from postlake import schema as S
from postlake.operators import sli
from postlake.plans import versions
from postlake.plans.clean import prepare_feed
from postlake.sources import feed as feeds

_FILES = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("modificationTime", T.TimestampType()),
        T.StructField("length", T.LongType()),
        T.StructField("content", T.BinaryType()),
    ]
)


def _listed(spark: SparkSession, path: str) -> list[str]:
    """The paths that a list of parts names."""
    folder = path.rsplit("/", 1)[0]
    named = [row.value.strip() for row in spark.read.text(path).collect()]
    return [p if p.startswith("/") or ":/" in p else f"{folder}/{p}" for p in named if p]


def publish_arrivals(
    spark: SparkSession,
    landing: str,
    store: str,
    checkpoint: str,
    zipped: bool = False,
    encoding: str | None = None,
    header: bool = False,
    merge_before_strip: bool = False,
    trim: bool = False,
    file_is_feed: bool = True,
    width: int | None = S.FEED_WIDTH,
    multi_line: bool = False,
    max_deleted_ratio: float | None = None,
    clock: Callable[[], datetime] = lambda: datetime.now(UTC),
) -> StreamingQuery:
    """Publish the feed files waiting in ``landing``, then stop.

    Each file becomes one version, oldest first.  Either it is a whole feed, or
    (``file_is_feed`` off) a list of the parts of one: a text file with a path per line,
    relative ones being beside the list, written when all parts are there.  A part that no
    list names is not read, and a list that names a missing one publishes nothing, so a
    feed replaces the table as a whole or not at all.  The checkpoint remembers which files
    are done; the batch number in the run's source keeps a batch that is repeated after a
    crash from being published twice.  Lines and rows that cannot be used are kept in the
    store's quarantine.
    """
    arrivals = spark.readStream.format("binaryFile").schema(_FILES)
    arrivals = arrivals.option("maxFilesPerTrigger", 1)
    # The stream only finds the files; their bytes are read by the feed reader.
    arrivals = arrivals.load(landing).select("path")

    def publish(batch: DataFrame, batch_id: int) -> None:
        arrived = batch.first()  # one file per batch, and only its name
        if arrived is None:
            return
        source = f"{arrived.path}#{batch_id}"
        session = batch.sparkSession
        runs = versions.audits(session, store)
        if runs.filter((F.col("source_url") == source) & (F.col("status") == "success")).first():
            return
        read = feeds.read_zipped_feed if zipped else feeds.read_feed
        named = {"encoding": encoding} if encoding else {}
        paths = [arrived.path] if file_is_feed else _listed(session, arrived.path)
        records, malformed = read(
            session,
            paths,
            header=header,
            joined=not file_is_feed,
            width=width,
            multi_line=multi_line,
            **named,
        )
        rows = prepare_feed(
            records, feeds.prefecture_dimension(session), merge_before_strip, trim
        )
        done = versions.publish(
            session,
            store,
            rows,
            clock(),
            source,
            rejected_lines=malformed,
            max_deleted_ratio=max_deleted_ratio,
        )
        if done.status != "success":
            raise RuntimeError(f"publishing {source} failed: {done.error_message}")

    return (
        arrivals.writeStream.foreachBatch(publish)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


_KEPT_BATCHES = "spark.sql.streaming.numRecentProgressUpdates"
_BATCHES = "run_id string, batch_id long, started_at timestamp, rows_in long, watermark timestamp, dropped long, state_rows long"


def _record_batches(spark: SparkSession, query: StreamingQuery, path: str) -> None:
    def when(text: str | None) -> datetime | None:
        return datetime.fromisoformat(text) if text else None

    rows = [
        (
            str(p.runId),
            p.batchId,
            when(p.timestamp),
            p.numInputRows,
            when(p.eventTime.get("watermark")),
            sum(s.numRowsDroppedByWatermark for s in p.stateOperators),
            sum(s.numRowsTotal for s in p.stateOperators),
        )
        for p in query.recentProgress
    ]
    spark.createDataFrame(rows, _BATCHES).coalesce(1).write.mode("append").parquet(path)


def late_rows(spark: SparkSession, batches: str) -> DataFrame:
    """What the batches of a stream took in and dropped: run_id, batch_id, started_at, rows_in,
    watermark, dropped and state_rows, summed over its operators.

    ``dropped`` are rows that came after the watermark had passed them, as an operator met
    them: windows count the rows of a task and a window as one.
    """
    return spark.read.schema(_BATCHES).parquet(batches)


def run_to_table(
    stream: DataFrame,
    path: str,
    checkpoint: str,
    schema_of: DataFrame | None = None,
    settings: Mapping[str, str] | None = None,
    batches: str | None = None,
) -> DataFrame:
    """Process what is waiting, append it to files and return the files as a table.
    ``settings`` hold while the stream runs.  What each batch took in and dropped is appended
    to the folder ``batches`` (``late_rows``), also if the stream fails."""
    spark = stream.sparkSession
    settings = {**({_KEPT_BATCHES: "100000"} if batches else {}), **(settings or {})}
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    query = None
    try:
        query = (
            stream.writeStream.format("parquet")
            .option("path", path)
            .option("checkpointLocation", checkpoint)
            .outputMode("append")
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
    finally:
        if batches and query is not None:
            _record_batches(spark, query, batches)
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
    return spark.read.schema((schema_of or stream).schema).parquet(path)


def stream_sli(
    log: DataFrame, watermark: str = "10 minutes", by: Sequence[str] = (), approx: bool = False
) -> DataFrame:
    """5-minute indicators of a streaming log; a window is emitted once it is closed."""
    return sli.flat(sli.sli_windows(log, by=by, watermark=watermark, approx=approx))


def stream_alerts(
    log: DataFrame, watermark: str = "10 minutes", by: Sequence[str] = ()
) -> DataFrame:
    """Alert levels of a streaming log."""
    return sli.alerts(sli.sli_windows(log, by=by, watermark=watermark), by=by)


def stream_alerts_with_freshness(
    log: DataFrame, runs: DataFrame, watermark: str = "10 minutes", by: Sequence[str] = ()
) -> DataFrame:
    """Alert levels of a streaming log, P3 where a stream of update runs has been silent."""
    levels = sli.alerts(sli.sli_windows(log, by=by, watermark=watermark), by=by, timed=True)
    return sli.add_stream_freshness(levels, runs, watermark)


def stream_incidents(
    log: DataFrame, watermark: str = "10 minutes", by: Sequence[str] = ()
) -> DataFrame:
    """Closed incidents of a streaming log, each once.  Incidents are numbered where they are
    read (``reports.numbered``), as a number needs those before it in its month."""
    windows = sli.sli_windows(log, by=by, watermark=watermark)
    return sli.alert_sessions(sli.alerts(windows, by=by, timed=True), by)


def stream_sustained_latency(log: DataFrame, watermark: str = "10 minutes") -> DataFrame:
    """15-minute stretches in which every 5-minute p95 was too high."""
    windows = sli.sli_windows(log, watermark=watermark)
    slow = F.col("p95_ms") >= S.SLO_P95_MS
    return sli.sustained(windows, slow, S.LATENCY_BREACH_MINUTES)
