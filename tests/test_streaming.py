from __future__ import annotations

import os
import zipfile
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from postlake.operators import sli
from postlake.plans import reports, versions
from postlake.schema import ADDRESS_COLUMNS as EXPECTED_COLUMNS
from postlake.streaming import jobs, probes
from tests.test_feed import EXPECTED, SAMPLE, csv_text, line_of

T0 = datetime(2026, 3, 1, tzinfo=UTC)
LOG = "ts timestamp, method string, path string, status int, latency_ms long"


def write_log(spark, path, minutes=240):
    rows = []
    for i in range(minutes):
        status = 500 if 30 <= i < 37 else 404 if i % 9 == 0 else 200
        latency = 400 if 100 <= i < 130 else i % 50
        p = "/ready" if i % 5 == 0 else "/postal_codes/1000001"
        rows.append((T0 + timedelta(minutes=i, seconds=i % 60), "GET", p, status, latency))
    rows = [r for r in rows if not 60 <= (r[0] - T0).total_seconds() / 60 < 70]
    spark.createDataFrame(rows, LOG).coalesce(1).write.parquet(path)
    return spark.read.schema(LOG).parquet(path), spark.readStream.schema(LOG).parquet(path)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def closed(df, end, until):
    return df.filter(F.col(end) <= F.lit(until))


def test_stream_equals_batch_on_closed_windows(spark, tmp_path):
    batch, stream = write_log(spark, str(tmp_path / "log"))
    newest = batch.agg(F.max("ts")).first()[0]
    until = newest - timedelta(minutes=10)

    got = jobs.run_to_table(jobs.stream_sli(stream), str(tmp_path / "a"), str(tmp_path / "ca"))
    assert rows(got) == rows(closed(sli.flat(sli.sli_windows(batch)), "window_end", until))

    got = jobs.run_to_table(jobs.stream_alerts(stream), str(tmp_path / "b"), str(tmp_path / "cb"))
    want = sli.alerts(sli.sli_windows(batch))
    # a level is emitted once the longest hop it needs is closed
    assert set(rows(got)) <= set(rows(want))
    assert {r.level for r in got.collect()} == {"P1", "P2", "none"}
    assert rows(closed(got, "window_end", until)) == rows(closed(want, "window_end", until))

    slow = jobs.stream_sustained_latency(stream)
    got = jobs.run_to_table(slow, str(tmp_path / "d"), str(tmp_path / "cd"))
    want = sli.sustained(sli.sli_windows(batch), F.col("p95_ms") >= 300, 15)
    assert rows(got) == rows(want) and got.count() == 4


def test_stream_dedup(spark, tmp_path):
    df = spark.createDataFrame([(i % 50, T0 + timedelta(seconds=i)) for i in range(100)], "id long, ts timestamp")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    out = jobs.run_to_table(
        sli.dedup_events(stream, ["id"], "1 hour"), str(tmp_path / "o"), str(tmp_path / "c")
    )
    assert sorted(r.id for r in out.collect()) == list(range(50))


def test_arriving_feeds_are_published_in_order(spark, tmp_path):
    landing, store, checkpoint = (str(tmp_path / n) for n in ("landing", "store", "check"))
    os.mkdir(landing)

    def arrive(name, lines, when):
        path = os.path.join(landing, name)
        with zipfile.ZipFile(path, "w") as z:
            z.writestr("feed.csv", csv_text(lines).encode("cp932"))
        os.utime(path, (when, when))

    ticks = iter(T0 + timedelta(days=d) for d in range(9))
    run = lambda: jobs.publish_arrivals(
        spark, landing, store, checkpoint, zipped=True, clock=lambda: next(ticks)
    ).awaitTermination()
    lines = [line_of(r) for r in SAMPLE]
    arrive("b.zip", lines[:3], 1_000_000)
    arrive("a.zip", lines, 2_000_000)
    run()
    runs = versions.audits(spark, store).orderBy("batch_timestamp").collect()
    assert [(r.records_in_feed, r.inserted_count, r.total_count) for r in runs] == [(3, 3, 3), (13, 10, 13)]
    assert "b.zip" in runs[0].source_url
    run()
    assert versions.audits(spark, store).count() == 2
    arrive("c.zip", lines[:2], 3_000_000)
    run()
    last = versions.audits(spark, store).orderBy(F.desc("batch_timestamp")).first()
    assert (last.records_in_feed, last.deleted_count, last.total_count) == (2, 11, 2)
    assert versions.current(spark, store).count() == 2 and len(EXPECTED) == 13


def test_listed_parts_are_published_whole(spark, tmp_path):
    landing, store, checkpoint = (str(tmp_path / n) for n in ("landing", "store", "check"))
    os.mkdir(landing)
    lines = [line_of(r) for r in SAMPLE]

    def part(name, some):
        (tmp_path / name).write_text(csv_text(some), encoding="utf-8")

    ticks = iter(T0 + timedelta(days=d) for d in range(9))
    run = lambda: jobs.publish_arrivals(
        spark,
        landing,
        store,
        checkpoint,
        encoding="utf-8",
        file_is_feed=False,
        clock=lambda: next(ticks),
    ).awaitTermination()
    part("p-1.csv", lines[:5])
    run()
    assert versions.audits(spark, store).count() == 0  # no list yet
    part("p-2.csv", lines[5:])
    (tmp_path / "landing" / "one.txt").write_text(f"../p-1.csv\n{tmp_path}/p-2.csv\n")
    part("p-3.csv", lines[:1])
    run()
    assert rows(versions.current(spark, store).select(*EXPECTED_COLUMNS)) == sorted(EXPECTED, key=str)
    kinds = [(r.kind, r.rows) for r in versions.quarantine(spark, store).collect()]
    assert kinds == [("line", 1)]
    part("p-4.csv", lines[:1])
    run()
    assert versions.audits(spark, store).count() == 1
    (tmp_path / "landing" / "two.txt").write_text("../p-1.csv\n../absent.csv\n")
    with pytest.raises(StreamingQueryException):
        run()
    assert versions.current(spark, store).count() == len(EXPECTED)


def probe(minute, status=200, service="a", path="/ready"):
    return (T0 + timedelta(minutes=minute), "GET", path, status, 1, service)


def silent(df):
    return sorted((r.service, r.window_end, r.last_good, r.level) for r in df.collect())


def test_probes_that_stop_raise_p1(spark, tmp_path):
    schema = LOG + ", service string"
    log = [probe(m) for m in (*range(0, 21), *range(47, 60), *range(80, 121))]
    log += [probe(m, 503) for m in range(61, 80)]  # failing is as bad as not sending
    log += [probe(m, service="b") for m in range(3, 30)]  # dies
    log += [probe(m, 200, "c", "/postal_codes/1") for m in range(0, 200, 3)] + [probe(5, 503, "d")]
    want = sli.silent_probes(spark.createDataFrame(log, schema), "service", T0 + timedelta(minutes=180))
    minute = (F.unix_seconds("window_end") - int(T0.timestamp())) / 60
    got = {(r.service, int(r.m)) for r in want.select("service", minute.alias("m")).collect()}
    assert got == {("a", 30), ("a", 35), ("a", 40), ("a", 45), ("a", 70), ("a", 75), ("a", 80)} | {
        ("a", m) for m in range(130, 181, 5)
    } | {("b", m) for m in range(40, 181, 5)}
    # in three deliveries, the middle one with what came late, which still counts
    late = [r for r in log if T0 + timedelta(minutes=47) <= r[0] < T0 + timedelta(minutes=51)]
    rest = [r for r in log if r not in late]
    until = T0 + timedelta(minutes=52)
    for k, part in enumerate(([r for r in rest if r[0] < until], late, [r for r in rest if r[0] >= until])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "log"))
        found = jobs.run_to_table(
            probes.stream_silent_probes(stream, "service"),
            str(tmp_path / "out"),
            str(tmp_path / "progress"),
            settings=probes.SETTINGS,
        )
    newest = max(r[0] for r in log)
    want = sli.silent_probes(spark.createDataFrame(log, schema), "service", newest - timedelta(minutes=10))
    assert silent(found) == silent(want)


def test_silent_probes_without_any(spark):
    assert sli.silent_probes(spark.createDataFrame([], LOG + ", service string"), "service").count() == 0


def test_incidents_close_by_the_watermark(spark, tmp_path):
    bad = {0, 5, 10, 20, 55, 60}  # minutes whose windows alert
    rows = []
    for minute in range(0, 65):
        status = 500 if minute - minute % 5 in bad else 200
        rows.append((T0 + timedelta(minutes=minute), "GET", "/postal_codes/1", status, 5))
    events = spark.createDataFrame(rows, "ts timestamp, method string, path string, status int, latency_ms long")
    events.coalesce(1).write.parquet(str(tmp_path / "log"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "log"))
    found = jobs.run_to_table(jobs.stream_incidents(stream), str(tmp_path / "out"), str(tmp_path / "cp"))
    batch = reports.incidents(sli.alerts(sli.sli_windows(events)))
    # the watermark stands at minute 54: the last incident is open
    want = batch.filter(F.col("ended_at") < F.lit(T0 + timedelta(minutes=50)))
    got = reports.numbered(found).orderBy("started_at").collect()
    assert got == want.orderBy("started_at").collect()
    assert [r.windows for r in got] == [3, 1]
    again = sli.alert_sessions(sli.alerts(sli.sli_windows(events), timed=True))
    assert reports.numbered(again).orderBy("started_at").collect() == batch.orderBy("started_at").collect()


def test_stream_freshness_equals_batch(spark, tmp_path):
    batch, stream = write_log(spark, str(tmp_path / "log"))
    hours = [(-12, "success"), (-11.7, "success"), (-6, "failed"), (1.5, "failed"), (2, "success"), (4, "success")]
    runs = spark.createDataFrame(
        [(T0 + timedelta(hours=h), status) for h, status in hours], "run_finished_at timestamp, status string"
    )
    runs.write.parquet(str(tmp_path / "runs"))
    arriving = spark.readStream.schema(runs.schema).parquet(str(tmp_path / "runs"))
    levels = jobs.stream_alerts_with_freshness(stream, arriving)
    got = jobs.run_to_table(levels, str(tmp_path / "a"), str(tmp_path / "ca")).drop("at")
    want = sli.add_freshness(sli.alerts(sli.sli_windows(batch)), runs).select(*got.columns)
    until = batch.agg(F.max("ts")).first()[0] - timedelta(minutes=10)
    assert rows(got) == rows(closed(want, "window_end", until))
    # quiet from the end of the old runs' 12 hours to the new run, fresh again after it
    stale = {(r.window_end - T0.replace(tzinfo=None)).seconds // 60 for r in got.filter("level = 'P3'").collect()}
    assert stale and min(stale) == 20 and max(stale) < 120
    assert got.filter("level = 'none'").count() > 5


def test_late_rows_are_counted(spark, tmp_path):
    schema, landing = "ts timestamp, id long", str(tmp_path / "in")
    places = str(tmp_path / "out"), str(tmp_path / "cp")
    batches = str(tmp_path / "batches")
    parts = [
        [(T0 + timedelta(minutes=m), m) for m in range(120)],
        [(T0 + timedelta(minutes=m), 1000 + m) for m in (1, 2, 3, 118, 125)],
    ]
    for part in parts:
        spark.createDataFrame(part, schema).write.mode("append").parquet(landing)
        stream = spark.readStream.schema(schema).parquet(landing)
        kept = jobs.run_to_table(sli.dedup_events(stream, ["id"], "10 minutes"), *places, batches=batches)
    assert kept.count() == 122
    seen = jobs.late_rows(spark, batches)
    assert seen.agg(F.sum("rows_in"), F.sum("dropped")).first() == (125, 3)
    assert seen.select("run_id").distinct().count() == 2
    assert seen.filter("dropped > 0").count() == 1
    assert seen.agg(F.max("watermark")).first()[0] >= (T0 + timedelta(minutes=109)).replace(tzinfo=None)
