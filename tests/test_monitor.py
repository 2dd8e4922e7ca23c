from __future__ import annotations

import json
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from postlake import schema as S
from postlake.functions import network as N
from postlake.operators import access, rollup, sli
from postlake.plans import reports
from postlake.sources.request_log import dependency_errors, parse_request_log
from postlake.streaming import jobs

T0 = datetime(2026, 3, 1, tzinfo=UTC)
LOG = "ts timestamp, event string, method string, path string, status int, latency_ms long"


def log(spark, rows):
    """rows: (minute, status, latency[, path])"""
    full = []
    for minute, status, latency, *path in rows:
        p = path[0] if path else "/postal_codes/1000001"
        full.append((T0 + timedelta(minutes=minute), "api_request", "GET", p, status, latency))
    return spark.createDataFrame(full, LOG)


def at(minute):
    return (T0 + timedelta(minutes=minute)).replace(tzinfo=None)


def audit(spark, *runs):
    rows = []
    for i, (finished, status, total) in enumerate(runs):
        rows.append((f"v{i}", f"v{i}", "s", finished, finished, finished, total, 0, 0, 0, total, status, None, finished))
    return spark.createDataFrame(rows, S.AUDIT)


def test_request_metrics(spark):
    got = sli.request_metrics(log(spark, [(0, 200, 10), (0, 404, 30), (0, 500, 20)])).first()
    assert tuple(got) == (3, 1, 1, 1 / 3, 20.0)
    assert tuple(sli.request_metrics(log(spark, [])).first()) == (0, 0, 0, 0.0, 0.0)


def test_parse_log(spark):
    event = {"event": "api_request", "method": "GET", "path": "/a", "status": 200, "latency_ms": 3}
    lines = [json.dumps(event), "Server started", json.dumps({**event, "event": "other"}), "{broken"]
    lines += ["Failed to connect to PostgreSQL: x", "Failed to connect Redis for cache invalidation: x"]
    lines += ["Failed to create Redis connection manager: x", "Failed to download: x"]
    df = spark.createDataFrame([(T0, x) for x in lines], "ts timestamp, value string")
    events, other = parse_request_log(df)
    assert [(r.path, r.status, r.latency_ms) for r in events.collect()] == [("/a", 200, 3)]
    assert other.count() == len(lines) - 1
    counts = {r.dependency: r.errors for r in dependency_errors(df).collect()}
    assert counts == {"database": 1, "redis": 2}


def levels(spark, rows):
    got = sli.alerts(sli.sli_windows(log(spark, rows))).orderBy("window_end").collect()
    return {int((r.window_end - at(0)).total_seconds() // 60): r.level for r in got}


def ratio(minute, bad, total):
    return [(minute, 500 if i < bad else 200, 1) for i in range(total)]


def test_alert_levels(spark):
    assert levels(spark, ratio(0, 3, 100)) == {5: "P1"}
    assert levels(spark, ratio(0, 1, 100)) == {5: "P2"}
    assert levels(spark, ratio(0, 99, 10_000)) == {5: "none"}
    slow = [(m, 200, 300) for m in (0, 5, 10)]
    assert levels(spark, slow) == {5: "none", 10: "none", 15: "P2"}
    assert levels(spark, slow[:2]) == {5: "none", 10: "none"}
    assert levels(spark, [(m, 200, 300) for m in (0, 5, 15)]) == {5: "none", 10: "none", 20: "none"}
    down = [(m, 503, 1, "/ready") for m in (0, 5)]
    assert levels(spark, [*down, *ratio(0, 0, 500), *ratio(5, 0, 500)]) == {5: "none", 10: "P1"}


def test_sustained_and_runs(spark):
    windows = sli.sli_windows(log(spark, [(m, 200, 400) for m in (0, 5, 10, 15, 25, 30)]))
    slow = F.col("p95_ms") >= 300
    ends = sorted(r.end for r in sli.sustained(windows, slow, 15).collect())
    assert ends == [at(15), at(20)]
    runs = sli.breach_runs(sli.flat(windows), slow).orderBy("started_at").collect()
    assert [(r.started_at, r.ended_at, r.windows) for r in runs] == [(at(0), at(20), 4), (at(25), at(35), 2)]


def test_p95_counts_postal_gets_only(spark):
    rows = [(0, 200, i) for i in range(1, 101)] + [(0, 200, 9999, "/ready")] * 50
    got = sli.sli_windows(log(spark, rows)).first()
    assert got.p95_ms == pytest.approx(95.05) and (got.probes, got.probes_ok) == (50, 50)


def test_approximate_p95_and_groups(spark):
    rows = [(0, 200, i) for i in range(1, 101)] + [(0, 200, 7, "/postal_codes/2")] * 3
    got = sli.sli_windows(log(spark, rows), approx=True, by=["path"]).collect()
    assert {(r.path, r.p95_ms, r.requests) for r in got} == {
        ("/postal_codes/1000001", 95.0, 100),
        ("/postal_codes/2", 7.0, 3),
    }


def test_freshness(spark):
    runs = audit(spark, (T0, "success", 1), (T0 + timedelta(hours=5), "failed", 0))

    def state(hours, minutes):
        return sli.freshness(runs, T0 + timedelta(hours=hours, minutes=minutes)).first().state

    assert [state(12, 0), state(12, 1), state(24, 0), state(24, 1)] == ["ok", "warning", "warning", "critical"]
    assert sli.freshness(audit(spark, (T0, "failed", 0)), T0).first().state == "critical"
    quiet = sli.alerts(sli.sli_windows(log(spark, [(715, 200, 1), (720, 200, 1)])))
    got = sli.add_freshness(quiet, runs).orderBy("window_end").collect()
    assert [r.level for r in got] == ["none", "P3"]


def test_dashboard(spark):
    rows = [(0, 500, 10), (1400, 404, 20), (1435, 200, 30), (-10, 200, 1)]
    got = {r.range: r for r in sli.dashboard(log(spark, rows), T0 + timedelta(minutes=1439)).collect()}
    assert {k: (v.requests, v.errors, v.not_found) for k, v in got.items()} == {
        "15m": (1, 0, 0),
        "1h": (2, 0, 1),
        "24h": (3, 1, 1),
    }


def test_dashboard_panels(spark):
    as_of = T0 + timedelta(minutes=1439)
    lines = [(5, "database"), (1390, "redis"), (1430, "redis"), (1438, "redis"), (1400, "database")]
    failures = spark.createDataFrame(
        [(T0 + timedelta(minutes=m), k) for m, k in lines], "ts timestamp, dependency string"
    )

    def shown(rows, finished):
        runs = spark.createDataFrame(
            [(T0 + timedelta(minutes=finished), "success")], "run_finished_at timestamp, status string"
        )
        found = sli.dashboard_panels(log(spark, rows), failures, runs, as_of).collect()
        assert len(found) == 24
        return {(r.range, r.panel): (r.value, r.state) for r in found}

    quiet = shown([(0, 200, 10)], 1439 - 13 * 60)
    assert quiet["15m", "request_throughput"] == (0.0, "ok")
    assert quiet["15m", "p95_latency"] == (None, "ok")
    assert quiet["1h", "ready_status"] == (None, "critical")  # nobody probed
    assert quiet["15m", "update_freshness"] == (13.0, "warning")
    assert quiet["15m", "redis_errors"] == (2.0, "warning")
    assert quiet["1h", "database_errors"] == (1.0, "warning")
    assert quiet["15m", "database_errors"] == (0.0, "ok")
    assert quiet["24h", "database_errors"] == (2.0, "warning")
    busy = shown([(1430 + i % 9, 500 if i < 2 else 200, 400) for i in range(100)], 1439 - 60)
    assert busy["15m", "error_rate"] == (0.02, "warning")
    assert busy["24h", "p95_latency"][1] == "warning"
    assert busy["15m", "update_freshness"] == (1.0, "ok")
    stale = shown([(1430, 500, 1)], 1439 - 25 * 60)
    assert stale["15m", "error_rate"] == (1.0, "critical")
    assert stale["24h", "update_freshness"] == (25.0, "critical")


def test_incident_categories(spark):
    at = lambda m: T0 + timedelta(minutes=m)
    found = spark.createDataFrame(
        [("a", at(0), at(10)), ("b", at(20), at(25)), ("c", at(30), at(35))],
        "incident string, started_at timestamp, ended_at timestamp",
    )
    runs = spark.createDataFrame(
        [(at(7), "failed"), (at(21), "success"), (at(27), "failed")],
        "run_finished_at timestamp, status string",
    )
    errors = spark.createDataFrame(
        [(at(0), "redis"), (at(5), "redis"), (at(30), "database")],
        "window_start timestamp, dependency string",
    )
    got = {r.incident: r.category for r in reports.incident_categories(found, runs, errors).collect()}
    assert got == {"a": "cache,update failure", "b": "other", "c": "database"}


def test_error_budget(spark):
    df = spark.createDataFrame([(30,), (31,), (28,)], "d int")
    got = [r[0] for r in df.select(reports.budget_seconds(F.col("d"))).collect()]
    assert got == [43 * 60 + 12, 44 * 60 + 38, 40 * 60 + 19]
    probes = [(T0 + timedelta(minutes=i), 503 if i < 6 else 200) for i in range(10_000)]
    r = reports.error_budget(spark.createDataFrame(probes, "ts timestamp, status int")).first()
    assert r.month == "2026-03" and r.availability == pytest.approx(0.9994)
    assert r.consumed_ratio == pytest.approx(0.6) and (r.freeze, r.stop) == (True, False)


def test_monthly_reports(spark):
    rows = [(0, 200, 10), (1, 500, 20), (60 * 24 * 31, 404, 10), (60 * 24 * 31, 200, 10)]
    events = log(spark, rows)
    runs = audit(
        spark,
        (T0 + timedelta(hours=1), "success", 100),
        (T0 + timedelta(hours=26), "success", 110),
        (T0 + timedelta(days=31), "rollback", 100),
        (T0 + timedelta(days=31, hours=1), "failed", 0),
    )
    probes = events.select("ts", F.lit(200).alias("status"))
    got = {(r.month, r.item): r.result for r in reports.slo_report(events, probes, runs).collect()}
    assert got[("2026-03", "availability")] == "Pass"
    assert got[("2026-03", "error_rate")] == "Fail"
    assert got[("2026-03", "p95_ms")] == "Pass"
    assert got[("2026-03", "freshness_hours")] == "Fail"
    assert got[("2026-04", "freshness_hours")] == "Pass"  # the month is an hour old
    cmp = reports.monthly_compare(events, runs).orderBy("month").collect()
    assert [(r.month, r.record_count, r.previous_record_count) for r in cmp] == [
        ("2026-03", 110, None),
        ("2026-04", 100, 110),
    ]
    assert cmp[1].change_error_rate == -0.5 and cmp[1].change_not_found_ratio == 0.5
    history = reports.update_history(runs, "2026-04").collect()
    assert [(r.kind, r.result) for r in history] == [("rollback", "成功"), ("data update", "失敗")]


def test_incidents(spark):
    rows = [*ratio(0, 5, 100), *ratio(5, 1, 100), *ratio(15, 1, 100), *ratio(20, 0, 10)]
    found = reports.incidents(sli.alerts(sli.sli_windows(log(spark, rows)))).orderBy("incident").collect()
    assert [(r.incident, r.level, r.windows) for r in found] == [
        ("INC-202603-001", "P1", 2),
        ("INC-202603-002", "P2", 1),
    ]
    alerted = reports.incidents(sli.alerts(sli.sli_windows(log(spark, rows))))
    assert {(r.level, r.incidents) for r in reports.incident_counts(alerted).collect()} == {("P1", 1), ("P2", 1)}


def test_dedup_events(spark):
    df = spark.createDataFrame([(1, T0), (1, T0), (2, T0)], "id int, ts timestamp")
    assert sli.dedup_events(df, ["id"], "1 hour").count() == 2


# ---- addresses, networks, paths ------------------------------------------------------


def test_ip_bits(spark):
    good = ["10.0.0.1", "255.255.255.255", "::1", "::", "2001:DB8::a:1", "1:2:3:4:5:6:7:8", "::ffff:1.2.3.4", "1::"]
    bad = ["", "1.2.3", "256.1.1.1", "01.2.3.4", "1.2.3.4.5", ":::", "1:2:3:4:5:6:7", "1::2::3", "12345::", "g::", "1:2:3:4:5:6:7::8:9", "::1%eth0", " ::1", "1:", ":1"]
    df = spark.createDataFrame([(x,) for x in good + bad], "ip string")
    got = {r.ip: r.b for r in df.select("ip", N.ip_bits(F.col("ip")).alias("b")).collect()}
    import ipaddress

    for x in good:
        ip = ipaddress.ip_address(x)
        assert got[x] == f"{int(ip):0{ip.max_prefixlen}b}", x
    assert [x for x in bad if got[x] is not None] == []


def test_allowlist(spark):
    rules = N.parse_networks("203.0.113.1, 10.0.0.0/24,,2001:db8::/32")
    ips = ["203.0.113.1", "10.0.0.8", "203.0.113.2", "2001:db8:1::1", "2001:db9::1", "x", None]
    df = spark.createDataFrame([(x,) for x in ips], "ip string")
    got = [r[0] for r in df.select(N.ip_allowed(F.col("ip"), rules)).collect()]
    assert got == [True, True, False, True, False, False, False]
    for wrong in ("10.0.0.0/24,not-an-ip", " , ", "10.0.0.0/33", "10.0.0.0/255.0.0.0"):
        with pytest.raises(ValueError):
            N.parse_networks(wrong)
    table = spark.createDataFrame([("203.0.113.1",), ("10.0.0.0/24",), ("2001:db8::/32",)], "cidr string")
    for limits in ({}, {"broadcast_rows": 0, "hot_rows": 2}):
        rows = access.match_networks(df.union(df), table, **limits).collect()
        assert {r.ip: r.allowed for r in rows} == dict(zip(ips, got, strict=True)) and len(rows) == 14
    with pytest.raises(ValueError, match="not-an-ip"):
        access.match_networks(df, spark.createDataFrame([("not-an-ip",)], "cidr string"))
    with pytest.raises(ValueError, match="empty"):
        access.match_networks(df, table.limit(0))
    everyone = N.parse_networks("0.0.0.0/0")
    assert [r[0] for r in df.select(N.ip_allowed(F.col("ip"), everyone)).collect()] == [True] * 3 + [False] * 4


def test_client_ip_and_paths(spark):
    df = spark.createDataFrame(
        [
            ("198.51.100.10, 10.0.0.1", "10.9.9.9", "127.0.0.1"),
            ("unknown, 10.0.0.1", " 10.9.9.9 ", "127.0.0.1"),
            (None, None, "127.0.0.1"),
        ],
        "f string, r string, p string",
    )
    cols = F.col("f"), F.col("r"), F.col("p")
    assert [r[0] for r in df.select(N.client_ip(*cols, True)).collect()] == ["198.51.100.10", "10.9.9.9", "127.0.0.1"]
    assert [r[0] for r in df.select(N.client_ip(*cols, False)).collect()] == ["127.0.0.1"] * 3
    prefixes = N.path_prefixes(F.lit("health, /docs,/docs,,/openapi.json"))
    assert df.select(prefixes).first()[0] == ["/health", "/docs", "/openapi.json"]
    paths = spark.createDataFrame([(p,) for p in ("/docs", "/docs/index.html", "/docs2")], "p string")
    assert [r[0] for r in paths.select(N.path_matches(F.col("p"), prefixes)).collect()] == [True, True, False]
    root = N.path_prefixes(F.lit("/"))
    assert paths.select(F.every(N.path_matches(F.col("p"), root))).first()[0]


def test_access_audit(spark):
    df = spark.createDataFrame(
        [
            ("10.0.0.1", None, None, "/postal_codes/1", "a@b"),
            ("10.0.0.1", None, None, "/postal_codes/1", "  "),
            ("10.0.0.1", None, None, "/docs/x", None),
            ("10.0.9.1", None, None, "/docs", None),
            ("10.0.9.1", "10.0.0.7", None, "/x", "u"),
        ],
        "ip string, forwarded_for string, real_ip string, path string, user string",
    )
    rules = N.parse_networks("10.0.0.0/24")
    got = access.access_audit(df, rules, trust_proxy_headers=True, login_required=True)
    assert [r.outcome for r in got.collect()] == [200, 401, 200, 403, 200]
    assert {r.outcome: r.requests for r in access.access_counts(got).collect()} == {200: 3, 401: 1, 403: 1}
    assert {r.outcome for r in access.access_audit(df).collect()} == {200}


def test_gaps_count_in_every_month_they_touch(spark):
    rows = [("2026-01-01", "success"), ("2026-01-02", "success"), ("2026-03-01", "success")]
    rows.append(("2026-03-03", "failed"))
    runs = spark.createDataFrame(rows, "d string, status string").select(
        F.to_timestamp("d").alias("run_finished_at"), "status"
    )
    got = {r.month: r.longest_gap_hours for r in reports.monthly_freshness(runs).collect()}
    assert got == {"2026-01": 30 * 24, "2026-02": 28 * 24, "2026-03": 48}


def test_previous_month_is_the_calendar_one(spark):
    rows = [("2026-01-05", 200), ("2026-03-05", 200), ("2026-04-05", 500)]
    log = spark.createDataFrame(rows, "d string, status int").select(
        F.to_timestamp("d").alias("ts"),
        F.lit("GET").alias("method"),
        F.lit("/postal_codes/1").alias("path"),
        "status",
        F.lit(5.0).alias("latency_ms"),
    )
    kinds = "created_at timestamp, run_finished_at timestamp, status string, total_count long, data_version string"
    runs = spark.createDataFrame([], kinds)
    got = reports.monthly_compare(log, runs).orderBy("month").collect()
    assert [(r.month, r.previous_error_rate) for r in got] == [
        ("2026-01", None),
        ("2026-03", None),
        ("2026-04", 0.0),
    ]


def test_stored_rollup_merges_without_the_log(spark, tmp_path):
    rows = [(i % 2880, 500 if i % 50 == 0 else 200, i * 7919 % 10_007) for i in range(40_000)]
    rows += [(5, 200, 9, "/ready"), (6, 503, 9, "/ready"), (7, 200, None)]
    events = log(spark, rows)
    path = str(tmp_path / "rollup")
    rollup.store(rollup.rollup(events), path)
    rollup.store(rollup.rollup(events), path)  # a repeated run counts nothing twice
    kept = rollup.stored(spark, path)
    hours = rollup.merged(kept, "hour")
    for parts in (kept, hours):
        month = rollup.merged(parts, "month")
        got = rollup.indicators(month).first()
        assert (got.requests, got.errors, got.lookups) == (40_003, 801, 40_001)
        assert (got.probes, got.probes_ok, got.availability) == (2, 1, 0.5)
        assert rollup.rank_errors(events, month, "month").first().rank_error < rollup.RANK_ERROR
    # up to k latencies the sketch is exact
    exact = {r.window_start: r.p for r in events.filter("path <> '/ready'").groupBy(
        F.date_trunc("hour", "ts").alias("window_start")
    ).agg(F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY latency_ms)").alias("p")).collect()}
    assert {r.window_start: r.p95_ms for r in rollup.indicators(hours).collect()} == exact
    one_day = kept.filter("day = DATE'2026-03-02'")
    assert rollup.merged(one_day, "day").count() == 1
    probes, runs = reports.ready_probes(events), audit(spark, (T0, "success", 1))
    report = reports.slo_report(None, probes, runs, reports.stored_indicators(kept))
    found = {r["item"]: r.result for r in report.collect()}
    assert found["availability"] == found["error_rate"] == found["p95_ms"] == "Fail"


def test_rollup_without_lookups_and_on_an_empty_log(spark):
    ready = rollup.rollup(log(spark, [(0, 200, 5, "/ready"), (8, 200, None)]))
    got = rollup.indicators(rollup.merged(ready, "day")).first()
    assert (got.requests, got.lookups, got.p95_ms, got.availability) == (2, 1, None, 1.0)
    assert rollup.merged(rollup.rollup(log(spark, [])), "day").count() == 0


def test_rollup_of_a_stream(spark, tmp_path):
    events = log(spark, [(i // 10, 200, i % 97) for i in range(1000)])
    events.write.parquet(str(tmp_path / "log"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "log"))
    rows = jobs.run_to_table(
        rollup.rollup(stream, watermark="10 minutes"), str(tmp_path / "out"), str(tmp_path / "cp")
    )
    closed = events.filter(F.col("ts") < at(85))  # the watermark stands at minute 89
    want = rollup.indicators(rollup.merged(rollup.rollup(closed), "month")).collect()
    assert rollup.indicators(rollup.merged(rows, "month")).collect() == want
