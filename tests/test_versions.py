from __future__ import annotations

import hashlib
import os
from concurrent.futures import ThreadPoolExecutor
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from postlake import schema as S
from postlake.plans import store as files
from postlake.plans import versions as V
from postlake.sources import export

A = ("0000001", 1, "01101", "北海道", "市", "A")
B = ("0000002", 1, "01101", "北海道", "市", "B")
B2 = ("0000002", 1, "01102", "北海道", "市", "B")
C = ("0000003", 1, "01101", "北海道", "市", "C")
D = ("0000004", 1, "01101", "北海道", "市", "D")
T1 = datetime(2026, 2, 12, 21, 37, 5, 123000, tzinfo=UTC)
T2 = T1 + timedelta(days=1)


def feed(spark, *rows):
    return spark.createDataFrame(list(rows), S.ADDRESS)


def state(df):
    out = {}
    for r in df.collect():
        out[r.town] = (r.city_id, r.created_at, r.updated_at)
    return out


def counts(a):
    return (a.records_in_feed, a.inserted_count, a.updated_count, a.deleted_count, a.total_count)


@pytest.fixture
def store(tmp_path):
    return str(tmp_path / "store")


def test_publish_rollback_publish(spark, store):
    assert V.current(spark, store).count() == 0
    a1 = V.publish(spark, store, feed(spark, A, B, C), T1, "one")
    assert (a1.data_version, a1.status) == ("v20260212213705123", "success")
    assert counts(a1) == (3, 3, 0, 0, 3)
    first = state(V.current(spark, store))

    a2 = V.publish(spark, store, feed(spark, A, B2, D), T2, "two")
    assert counts(a2) == (3, 1, 2, 1, 3)
    now = state(V.current(spark, store))
    assert set(now) == {"A", "B", "D"} and now["B"][0] == "01102"
    assert now["A"][1] == first["A"][1] and now["A"][2] > first["A"][2]
    diff = V.diff_versions(
        V.read_version(spark, store, a1.data_version), V.current(spark, store)
    ).collect()
    assert sorted((r.town, r.change_type, r.changed_columns) for r in diff) == [
        ("B", "changed", ["city_id"]),
        ("C", "removed", []),
        ("D", "added", []),
    ]

    again = V.publish(spark, store, feed(spark, A), T2, "two again")
    assert again.source_url == "two" and V.audits(spark, store).count() == 2

    back = V.rollback(spark, store, a1.data_version)
    assert (back.status, counts(back)) == ("rollback", (3, 3, 0, 0, 3))
    assert back.data_version.startswith("rv") and back.source_url.endswith(a1.data_version)
    assert state(V.current(spark, store)) == first
    with pytest.raises(ValueError, match="no rows"):
        V.rollback(spark, store, "v1")
    with pytest.raises(ValueError, match="no rows"):
        V.rollback(spark, store, back.data_version)
    assert state(V.current(spark, store)) == first

    later = datetime.now(UTC) + timedelta(seconds=5)
    a3 = V.publish(spark, store, feed(spark, B, C, D), later, "three")
    assert counts(a3) == (3, 1, 2, 1, 3)
    seen = V.drift(V.audits(spark, store), 0.5).collect()
    assert [r.previous_count for r in seen] == [None, 3, 3, 3]
    snaps = V.snapshots(spark, store).groupBy("data_version").count().collect()
    assert sorted((r.data_version, r["count"]) for r in snaps) == sorted(
        (a.data_version, 3) for a in (a1, a2, a3)
    )


def test_same_second_follows_the_rule(spark, store):
    V.publish(spark, store, feed(spark, A, B), T1, "one")
    a2 = V.publish(spark, store, feed(spark, A, D), T1 + timedelta(milliseconds=1), "two")
    # B was touched in the same second, so it is not stale and stays
    assert set(state(V.current(spark, store))) == {"A", "B", "D"}
    assert (a2.records_in_feed, a2.deleted_count, a2.total_count) == (2, 0, 3)


def test_failure_is_recorded_and_changes_nothing(spark, store):
    V.publish(spark, store, feed(spark, A), T1, "one")
    broken = feed(spark, B).withColumn("town", F.raise_error(F.lit("boom")).cast("string"))
    a2 = V.publish(spark, store, broken, T2, "two")
    assert a2.status == "failed" and a2.error_message.startswith("bulk_insert: ")
    assert set(state(V.current(spark, store))) == {"A"}
    with pytest.raises(ValueError, match="failed"):
        V.publish(spark, store, feed(spark, B), T2, "two")


def test_update_columns(spark, store):
    V.publish(spark, store, feed(spark, B), T1, "one")
    V.publish(spark, store, feed(spark, B2), T2, "two", update_columns=["prefecture"])
    assert state(V.current(spark, store))["B"][0] == "01101"


def test_diff_counts_tell_changed_rows(spark):
    t1, t2 = F.lit(T1), F.lit(T2)
    prior = feed(spark, A, B, C).withColumn("created_at", t1).withColumn("updated_at", t1)
    got = V.diff_counts(V.apply_feed(prior, feed(spark, A, B2, D), t2)).first()
    assert tuple(got) == (3, 1, 2, 1, 3, 1)


def test_quality(spark):
    rows = [
        A,
        A,
        ("123", 1, "x", "p", "c", "t"),
        ("0000009", 0, "x" * 11, "p" * 33, "c" * 51, "t" * 501),
        ("", 1, "x", "p", "", "t"),
    ]
    got = {r.rule: r.broken_count for r in V.quality_counts(feed(spark, *rows)).collect()}
    assert got == {
        "blank_key": 1,
        "zip_not_7_digits": 2,
        "unknown_prefecture": 1,
        "long_city_id": 1,
        "long_prefecture": 1,
        "long_city": 1,
        "long_town": 1,
        "duplicate_key": 1,
    }
    good, bad = V.quality_split(feed(spark, *rows))
    assert good.count() == 2 and bad.count() == 3


@pytest.mark.parametrize("fmt", ["csv", "parquet"])
def test_export(spark, tmp_path, fmt):
    rows = feed(spark, A, B, ("0000005", 1, "1", "北海道", 'q"x,', ""))
    rows = rows.withColumn("town", F.when(F.col("town") != "", F.col("town")))
    out = str(tmp_path / "release")
    manifest = export.export_release(rows, out, T1, fmt)
    total = export.manifest_total(manifest).first()
    plain = export.release_rows(rows)
    want = plain.agg(F.sum(F.xxhash64(*S.ADDRESS_COLUMNS).cast("decimal(38,0)"))).first()[0]
    assert total.row_count == 3 and total.content_hash == want
    for r in manifest.collect():
        data = open("/" + r.file.removeprefix("file:").lstrip("/"), "rb").read()
        assert (len(data), hashlib.sha256(data).hexdigest()) == (r.size_bytes, r.sha256)


def refused(spark, store):
    rows = V.quarantine(spark, store).collect()
    return sorted((r.data_version, r.kind, r.town or r.line, tuple(r.broken_rules), r.rows) for r in rows)


def test_bad_and_repeated_rows_go_to_quarantine(spark, store):
    v1, v2 = V.version_id(T1), V.version_id(T2)
    V.publish(spark, store, feed(spark, A, B), T1, "one")
    assert refused(spark, store) == []
    blank = ("12", 0, "", "", "", "Z")
    placeless = ("0000009", 0, "01101", "？県", "市", "P")
    lines = spark.createDataFrame([("f.csv", '"broken"')], "feed_file string, line string")
    # the first of a key by its other values stays, whatever the order of the feed
    rows = feed(spark, B2, B2, A, B, blank, placeless)
    done = V.publish(spark, store, rows, T2, "two", rejected_lines=lines)
    assert (done.status, *counts(done)) == ("success", 3, 1, 2, 0, 3)
    got = state(V.current(spark, store))
    assert set(got) == {"A", "B", "P"} and got["B"][0] == "01101"
    assert refused(spark, store) == [
        (v2, "line", '"broken"', ("malformed_line",), 1),
        (v2, "row", "B", ("duplicate_key",), 2),
        (v2, "row", "Z", ("blank_key", "zip_not_7_digits"), 1),
    ]
    assert v1 != v2


def test_feed_that_loses_too_much_is_refused(spark, store):
    V.publish(spark, store, feed(spark, A, B, C), T1, "one")
    before = state(V.current(spark, store))
    lost = V.publish(spark, store, feed(spark, A), T2, "two", max_deleted_ratio=0.5)
    assert lost.status == "failed" and "lacks 2 of 3 rows" in lost.error_message
    blank = ("12", 0, "", "", "", "Z")
    none = V.publish(spark, store, feed(spark, blank), T2 + timedelta(days=1), "three")
    assert none.status == "failed" and "nothing of the feed" in none.error_message
    assert state(V.current(spark, store)) == before
    fine = V.publish(spark, store, feed(spark, A), T2 + timedelta(days=2), "four", max_deleted_ratio=0.7)
    assert (fine.status, fine.total_count) == ("success", 1)


def numbered(spark, n, city="01101"):
    return feed(spark, *[(f"{k:07d}", 1, city, "北海道", "市", f"T{k}") for k in range(n)])


def lists(spark, store):
    out = {}
    for r in files.all_listed(spark, store).collect():
        out.setdefault(r.data_version, {})[r.path] = r
    return out


def test_null_parts_of_keys_match(spark, store):
    rows = feed(spark, A, B).withColumn("town", F.lit(None).cast("string"))
    V.publish(spark, store, rows, T1, "one")
    a2 = V.publish(spark, store, rows, T2, "two")
    assert counts(a2) == (2, 0, 2, 0, 2)
    assert {(r.created_at < r.updated_at, r.town) for r in V.current(spark, store).collect()} == {(True, None)}
    assert V.diff_versions(*[V.read_version(spark, store, v) for v in (V.version_id(T1), V.version_id(T2))]).count() == 0


@pytest.mark.parametrize("partial", [False, True])
def test_only_touched_files_are_rewritten(spark, store, partial):
    V.publish(spark, store, numbered(spark, 100), T1, "one", file_rows=10)
    first = lists(spark, store)[V.version_id(T1)]
    assert len(first) == 10
    news = numbered(spark, 100).withColumn("city_id", F.when(F.col("zip_code") == "0000042", "2").otherwise(F.col("city_id")))
    if partial:
        news = news.filter("city_id = '2'")
    else:
        news = news.filter("zip_code <> '0000077'")
    new = ("0000500", 1, "01101", "北海道", "市", "N")
    done = V.publish(spark, store, news.unionByName(feed(spark, new)), T2, "two", partial=partial, file_rows=10)
    assert counts(done) == ((2, 1, 1, 0, 101) if partial else (100, 1, 99, 1, 100))
    second = lists(spark, store)[V.version_id(T2)]
    touched = [p for p in first if p not in second]
    assert len(touched) == (1 if partial else 2)
    assert sum(r.rows for r in second.values()) == done.total_count
    now = {r.zip_code: r for r in V.current(spark, store).collect()}
    assert now["0000042"].city_id == "2" and "0000500" in now and len(now) == done.total_count
    seen = {z for z, r in now.items() if r.updated_at > r.created_at}
    assert seen == ({"0000042"} if partial else set(now) - {"0000500"})
    snaps = {r.data_version: r["count"] for r in V.snapshots(spark, store).groupBy("data_version").count().collect()}
    assert snaps == {V.version_id(T1): 100, V.version_id(T2): done.total_count}
    old = V.snapshots(spark, store).filter(F.col("data_version") == V.version_id(T1))
    assert old.filter("created_at < updated_at").count() == 0
    V.rollback(spark, store, V.version_id(T1))
    assert V.current(spark, store).exceptAll(old.drop("data_version")).count() == 0


def test_an_unchanged_feed_writes_no_rows(spark, store):
    V.publish(spark, store, numbered(spark, 30), T1, "one", file_rows=10)
    V.publish(spark, store, numbered(spark, 30), T2, "two", file_rows=10)
    both = lists(spark, store)
    assert set(both[V.version_id(T1)]) == set(both[V.version_id(T2)])
    assert V.current(spark, store).filter("updated_at > created_at").count() == 30
    later = numbered(spark, 3, "9")
    V.publish(spark, store, later, T2 + timedelta(days=1), "three", partial=True, file_rows=10)
    times = {r.zip_code: r.updated_at for r in V.current(spark, store).collect()}
    assert len(set(times.values())) == 2 and len([z for z in times if times[z] == max(times.values())]) == 3


def test_odd_zips_find_their_files(spark, store):
    rows = [("01", 1, "c", "p", "s", "t"), ("x", 1, "c", "p", "s", "t"), ("", 1, "c", "p", "s", "t")]
    rows += [(f"{k:07d}", 1, "c", "p", "s", "t") for k in range(0, 10**7, 400_000)]
    V.publish(spark, store, feed(spark, *rows), T1, "one", rules=[], file_rows=5)
    changed = feed(spark, *[(z, 1, "d", "p", "s", "t") for z, *_ in rows[:3]])
    done = V.publish(spark, store, changed, T2, "two", rules=[], partial=True, file_rows=5)
    assert counts(done) == (3, 0, 3, 0, len(rows))
    assert V.current(spark, store).filter("city_id = 'd'").count() == 3


def test_one_of_two_writers_succeeds(spark, store):
    V.publish(spark, store, feed(spark, A), T1, "one")
    won = V.publish(spark, store, feed(spark, A, B), T2, "two", follows=1)
    lost = V.publish(spark, store, feed(spark, A, C), T2 + timedelta(days=1), "three", follows=1)
    assert (won.status, lost.status) == ("success", "failed") and "meanwhile" in lost.error_message
    assert set(state(V.current(spark, store))) == {"A", "B"}
    assert lost.data_version not in lists(spark, store)
    assert not os.path.exists(f"{store}/data/{lost.data_version}")
    assert V.snapshots(spark, store).select("data_version").distinct().count() == 2


def test_writers_at_the_same_time(spark, store):
    V.publish(spark, store, feed(spark, A), T1, "one")
    days = [T2 + timedelta(days=k) for k in range(3)]
    with ThreadPoolExecutor(3) as pool:
        runs = list(pool.map(lambda d: V.publish(spark, store, feed(spark, A, B, C), d, str(d), follows=1), days))
    assert sorted(r.status for r in runs) == ["failed", "failed", "success"]
    assert set(state(V.current(spark, store))) == {"A", "B", "C"}


def test_a_refused_feed_leaves_no_files(spark, store):
    V.publish(spark, store, feed(spark, A, B, C), T1, "one")
    lost = V.publish(spark, store, feed(spark, A), T2, "two", max_deleted_ratio=0.5)
    assert lost.status == "failed" and sorted(os.listdir(f"{store}/data")) == [V.version_id(T1)]


def spread(spark, city="01101", where=None):
    """200 rows whose zips begin with 100 different buckets."""
    rows = [(f"{k * 50_000:07d}", 1, city if k == where else "01101", "北海道", "市", f"T{k}") for k in range(200)]
    return feed(spark, *rows)


def test_published_diff_reads_what_differs(spark, store):
    days = [T1 + timedelta(days=k) for k in range(4)]
    v1, v2, v3, v4 = (V.version_id(d) for d in days)
    V.publish(spark, store, spread(spark), days[0], "one", file_rows=20)
    V.publish(spark, store, spread(spark, "9", 42), days[1], "two", file_rows=20)
    some = files.differing(spark, store, files.listed(spark, store, v1), files.listed(spark, store, v2))
    # one of ten files, and of its rows those that begin as the changed one does
    assert [len(s.inputFiles()) for s in some] == [1, 1]
    assert [{r.zip_code[:3] for r in s.collect()} for s in some] == [{"210"}] * 2
    got = V.diff_published(spark, store, v1, v2).collect()
    assert [(r.town, r.change_type, r.changed_columns) for r in got] == [("T42", "changed", ["city_id"])]

    # all rows in other files: nothing differs, so nothing is read
    V.publish(spark, store, feed(spark, A), days[2], "three", file_rows=20)
    V.publish(spark, store, spread(spark, "9", 42), days[3], "four", file_rows=30)
    lists = [files.listed(spark, store, v) for v in (v2, v4)]
    assert not {f.path for f in lists[0]} & {f.path for f in lists[1]}
    assert [s.count() for s in files.differing(spark, store, *lists)] == [0, 0]
    assert V.diff_published(spark, store, v2, v4).count() == 0

    for old, new in ((v1, v3), (v3, v4), (v4, v1)):
        want = V.diff_versions(*[V.read_version(spark, store, v) for v in (old, new)])
        got = V.diff_published(spark, store, old, new)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and want.count() > 0
    V.rollback(spark, store, v1, days[3] + timedelta(days=1))
    back = V.current_version(spark, store)
    assert back == v1 and V.diff_published(spark, store, v1, V.version_id(days[3] + timedelta(days=1), "rv")).count() == 0
    with pytest.raises(ValueError, match="not published: v9"):
        V.diff_published(spark, store, v1, "v9")


def test_published_diff_without_digests(spark, store):
    V.publish(spark, store, spread(spark), T1, "one", file_rows=20)
    V.publish(spark, store, spread(spark, "9", 42), T2, "two", file_rows=20)
    files.delete(spark, f"{store}/digests/data_version={V.version_id(T1)}")
    got = V.diff_published(spark, store, V.version_id(T1), V.version_id(T2))
    assert [r.town for r in got.collect()] == ["T42"]


def test_digests_tell_nulls_apart(spark, store):
    """A null town beside a city of the same name is not a null city beside that town."""
    same = feed(spark, ("0000001", 1, "c", "p", "市", "市"))
    for day, blank in ((T1, "town"), (T2, "city")):
        V.publish(spark, store, same.withColumn(blank, F.lit(None).cast("string")), day, "x", rules=[])
    got = V.diff_published(spark, store, V.version_id(T1), V.version_id(T2))
    assert sorted(r.change_type for r in got.collect()) == ["added", "removed"]
