"""Published versions of the address table.

A version is a list of immutable files, each with the range of its zips (``plans/store.py``).
Publishing rewrites only files that hold a row that is inserted, deleted or changed; the others
are listed again.  That all rows of a listed file were in the feed is a time in the list, so
nothing is rewritten for it.  The numbered commit that a run adds is its audit row: of several
writers that start from one version, one succeeds.  Rows and lines that a publish refuses are
kept in ``quarantine/data_version=<id>``.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Sequence
from datetime import UTC, datetime
from typing import TypeVar

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from postlake import schema as S
from postlake.operators.skew import BROADCAST_ROWS, fits
from postlake.plans import store as files
from postlake.session import discard, empty, materialise

_T = TypeVar("_T")
_LIVE = ("success", "rollback")


def version_id(ts: datetime, prefix: str = "v") -> str:
    return f"{prefix}{ts:%Y%m%d%H%M%S}{ts.microsecond // 1000:03d}"


def _utc(ts: datetime) -> datetime:
    return ts.astimezone(UTC) if ts.tzinfo else ts.replace(tzinfo=UTC)


# ---- the upsert itself ---------------------------------------------------------------


def null_safe(left: Sequence[str], right: Sequence[str]) -> Column:
    """Whether columns are pairwise equal, nulls counting as equal."""
    same = F.lit(True)
    for a, b in zip(left, right, strict=True):
        same = same & F.col(a).eqNullSafe(F.col(b))
    return same


def apply_feed(
    prior: DataFrame,
    feed: DataFrame,
    batch: Column,
    keys: Sequence[str] = S.ADDRESS_KEY,
    update_columns: Sequence[str] | None = None,
    carry: Sequence[str] = (),
) -> DataFrame:
    """Upsert ``feed`` into ``prior`` and mark rows the feed no longer has.

    One full outer join on the key, unique on both sides; null parts of a key are equal.
    ``op`` is ``inserted``, ``updated`` (in both, changed or not), ``deleted`` (only in prior,
    touched before the batch) or ``kept``; ``changed`` tells whether a payload value really
    differs.  ``update_columns`` limits which payload columns an update replaces, ``carry``
    names columns of ``prior`` to keep.
    """
    keys = list(keys)
    payload = [c for c in feed.columns if c not in keys]
    replaced = set(payload if update_columns is None else update_columns)
    old = [f"_p_{c}" for c in keys]
    fed_keys = [f"_f_{c}" for c in keys]
    both = prior.select(
        *[F.col(c).alias(f"_p_{c}") for c in (*keys, *payload)],
        F.col("created_at").alias("_created"),
        F.col("updated_at").alias("_updated"),
        F.lit(True).alias("_in_prior"),
        *carry,
    ).join(
        feed.select(*[F.col(c).alias(f"_f_{c}") for c in (*keys, *payload)], F.lit(True).alias("_in_feed")),
        null_safe(old, fed_keys),
        "full",
    )
    new, fed = F.col("_in_prior").isNull(), F.col("_in_feed").isNotNull()
    op = (
        F.when(new, "inserted")
        .when(fed, "updated")
        .when(F.col("_updated") < batch, "deleted")
        .otherwise("kept")
    )
    values = {
        c: F.when(new | fed if c in replaced else new, F.col(f"_f_{c}")).otherwise(F.col(f"_p_{c}"))
        for c in payload
    }
    differs = F.lit(False)
    for c, value in values.items():
        differs = differs | ~value.eqNullSafe(F.col(f"_p_{c}"))
    return both.select(
        *[F.coalesce(f"_p_{c}", f"_f_{c}").alias(c) for c in keys],
        *[v.alias(c) for c, v in values.items()],
        F.when(new, batch).otherwise(F.col("_created")).alias("created_at"),
        F.when(fed, batch).otherwise(F.col("_updated")).alias("updated_at"),
        op.alias("op"),
        (~new & fed & differs).alias("changed"),
        *carry,
    )


def diff_counts(applied: DataFrame) -> DataFrame:
    """Counts of one run, in one pass over :func:`apply_feed`'s rows."""
    op = F.col("op")
    return applied.agg(
        F.count_if(op.isin("inserted", "updated")).alias("records_in_feed"),
        F.count_if(op == "inserted").alias("inserted_count"),
        F.count_if(op == "updated").alias("updated_count"),
        F.count_if(op == "deleted").alias("deleted_count"),
        F.count_if(op != "deleted").alias("total_count"),
        F.count_if("changed").alias("changed_count"),
    )


def table_counts(table: DataFrame, batch: Column) -> DataFrame:
    """Counts the table alone can tell: rows touched and inserted by a batch, and all."""
    touched = F.col("updated_at") == batch
    inserted = F.count_if(touched & (F.col("created_at") == batch))
    return table.agg(
        F.count_if(touched).alias("touched_count"),
        inserted.alias("inserted_count"),
        F.greatest(F.count_if(touched) - inserted, F.lit(0)).alias("updated_count"),
        F.count(F.lit(1)).alias("total_count"),
        F.count_if(F.col("created_at") < batch).alias("older_count"),
    )


# ---- reading the store ---------------------------------------------------------------


def audits(spark: SparkSession, store: str) -> DataFrame:
    """The run history; small, one row per run.  Commits succeeded, the others failed."""
    done = files.commits(spark, store).drop("commit")
    try:
        return done.unionByName(spark.read.schema(S.AUDIT).parquet(f"{store}/failures/*"))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return done


def _live_audit(spark: SparkSession, store: str, number: int | None = None) -> Row | None:
    """The last commit, or the one with ``number`` (0: none, before the first)."""
    rows = files.commits(spark, store)
    if number is not None:
        rows = rows.filter(F.col("commit") <= number)
    return rows.orderBy(F.desc("commit")).first()


def current_version(spark: SparkSession, store: str) -> str | None:
    row = _live_audit(spark, store)
    return row.content_version if row else None


def read_version(spark: SparkSession, store: str, version: str) -> DataFrame:
    return files.read(spark, store, files.listed(spark, store, version))


def current(spark: SparkSession, store: str) -> DataFrame:
    """The published table; empty before the first publish."""
    version = current_version(spark, store)
    if version is None:
        return empty(spark, S.ADDRESS_VERSIONED)
    return read_version(spark, store, version)


def quarantine(spark: SparkSession, store: str) -> DataFrame:
    """What publishes refused: ``kind`` is ``row`` or ``line``, ``rows`` how often it occurred,
    ``data_version`` the publish, which may itself have failed."""
    fields = [*S.QUARANTINE.fields, T.StructField("data_version", T.StringType())]
    try:
        return spark.read.schema(T.StructType(fields)).parquet(f"{store}/quarantine")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return empty(spark, T.StructType(fields))


def snapshots(spark: SparkSession, store: str) -> DataFrame:
    """All published versions as one table with ``data_version``.  Each file is read once,
    however many versions list it."""
    good = files.commits(spark, store).filter("status = 'success'").select("data_version")
    lists = files.all_listed(spark, store).join(good, "data_version", "left_semi")
    rows = files.with_file(spark.read.schema(S.ADDRESS_VERSIONED).parquet(f"{store}/data/*"))
    if fits(lists):
        lists = F.broadcast(lists)
    found = rows.join(lists, rows["_file"] == lists["path"])
    return found.select(*files.touched(S.ADDRESS_VERSIONED.fieldNames()), "data_version")


# ---- writing the store ---------------------------------------------------------------


def _audit(**values: object) -> Row:
    now = datetime.now(UTC)
    counts = ("records_in_feed", "inserted_count", "updated_count", "deleted_count", "total_count")
    row = {
        **dict.fromkeys(counts, 0),
        "content_version": None,
        "error_message": None,
        "run_finished_at": now,
        "created_at": now,
        **values,
    }
    return Row(**{name: row[name] for name in S.AUDIT.fieldNames()})


def _failed(spark: SparkSession, store: str, **values: object) -> Row:
    record = _audit(**values, status="failed")
    values_of = [F.lit(record[f.name]).cast(f.dataType).alias(f.name) for f in S.AUDIT.fields]
    # a folder each: runs may fail at the same time
    row = spark.range(0, 1, 1, 1).select(*values_of)
    row.write.mode("overwrite").parquet(f"{store}/failures/{record.data_version}")
    return record


class StageError(RuntimeError):
    """A publish step failed; the message names the step."""


def _stage(name: str, work: Callable[[], _T]) -> _T:
    try:
        return work()
    except Exception as e:
        raise StageError(f"{name}: {e}") from e


def first_per_key(
    rows: DataFrame, keys: Sequence[str] = S.ADDRESS_KEY
) -> tuple[DataFrame, DataFrame | None]:
    """(the row of each key with the smallest other values, all other rows with the number
    of times ``rows`` they occur, None without any).  The first is written; rows that repeat
    no key are shuffled once, and equal rows are counted before the shuffle."""
    keys = list(keys)
    payload = F.struct(*[c for c in rows.columns if c not in keys])
    per_key = rows.groupBy(*keys).agg(F.min(payload).alias("_first"), F.count(F.lit(1)).alias("_all"))
    per_key = materialise(per_key, "publish-keys")
    unique = per_key.select(*keys, "_first.*").select(*rows.columns)
    unique.scratch = per_key.scratch
    repeated = per_key.filter("_all > 1").select(*[F.col(c).alias(f"_k_{c}") for c in keys], "_first")
    number = repeated.count()
    if not number:
        return unique, None
    if number <= BROADCAST_ROWS:
        repeated = F.broadcast(repeated)
    again = rows.join(repeated, null_safe(keys, [f"_k_{c}" for c in keys]))
    others = again.groupBy(*rows.columns).agg(
        F.count(F.lit(1)).alias("_n"), F.first("_first").alias("_first")
    )
    beyond = F.col("_n") - payload.eqNullSafe(F.col("_first")).cast("long")
    return unique, others.withColumn("rows", beyond).filter("rows > 0").select(*rows.columns, "rows")


def _quarantined(rows: DataFrame, lines: DataFrame | None) -> DataFrame:
    """Refused rows and malformed lines (``feed_file``, ``line``) in one form."""

    def form(df: DataFrame, **values: Column) -> DataFrame:
        own = {c: F.col(c) for c in df.columns} | values
        return df.select(
            *[own.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in S.QUARANTINE.fields]
        )

    found = form(rows, kind=F.lit("row"))
    if lines is None:
        return found
    rules = F.array(F.lit("malformed_line"))
    return found.unionByName(form(lines, kind=F.lit("line"), broken_rules=rules, rows=F.lit(1)))


def _rewritten(prior: DataFrame, delta: DataFrame, seen: Column) -> DataFrame:
    """The rows of touched files after ``delta``: rows without one were seen at ``seen``."""
    names = S.ADDRESS_VERSIONED.fieldNames()
    news = delta.filter("op <> 'inserted'").select(*[F.col(c).alias(f"_d_{c}") for c in names], "op")
    both = prior.join(news, null_safe(S.ADDRESS_KEY, [f"_d_{c}" for c in S.ADDRESS_KEY]), "left")
    still = both.filter(F.coalesce(F.col("op") != "deleted", F.lit(True))).select(
        *[
            F.when(F.col("op").isNotNull(), F.col(f"_d_{c}"))
            .otherwise(seen if c == "updated_at" else F.col(c))
            .alias(c)
            for c in names
        ]
    )
    return still.unionByName(delta.filter("op = 'inserted'").select(*names))


def publish(
    spark: SparkSession,
    store: str,
    feed: DataFrame,
    batch_ts: datetime,
    source: str,
    update_columns: Sequence[str] | None = None,
    rejected_lines: DataFrame | None = None,
    rules: Sequence[str] | None = None,
    max_deleted_ratio: float | None = None,
    partial: bool = False,
    file_rows: int = files.FILE_ROWS,
    follows: int | None = None,
) -> Row:
    """Publish ``feed`` as the next version; returns its audit row.

    Rows that break one of ``rules`` (by default all ``quality_rules`` but the one against
    unknown prefectures, which are published with id 0) and rows that repeat a key beyond the
    first by their values go to the quarantine of this version, beside the ``rejected_lines``
    (``feed_file``, ``line``) of the reader.

    The feed is the whole table, and rows it lacks are deleted; or (``partial``) it holds the
    rows to insert or update alone, and files whose range has none of its zips are not read.
    Files get about ``file_rows`` rows.  ``follows`` is the number of the commit that the feed
    was made from, if not the last one.

    Repeating a published batch changes nothing.  A failure is recorded as a ``failed`` audit
    row and leaves the current version and its files as they were; so is a feed of which
    nothing is left, one that deletes more than ``max_deleted_ratio`` of the table, and a run
    during which another one was published.
    """
    batch_ts = _utc(batch_ts)
    version, started = version_id(batch_ts), datetime.now(UTC)
    done = audits(spark, store).filter(F.col("data_version") == version).first()
    if done is not None and done.status == "success":
        return done
    if done is not None:
        raise ValueError(f"version {version} was tried before and failed; use a new batch time")
    live = _live_audit(spark, store, follows)
    second = batch_ts.replace(microsecond=0)
    batch = F.lit(second)
    run = {
        "data_version": version,
        "source_url": source,
        "run_started_at": started,
        "batch_timestamp": second,
    }
    scratch: list[DataFrame] = []

    def check() -> DataFrame:
        # read by the quarantine and by the table, which must see the same rows
        marked = feed.select(*S.ADDRESS_COLUMNS).withColumn("broken_rules", _broken(rules))
        scratch.append(materialise(marked, "publish-feed"))
        good = scratch[0].filter(F.size("broken_rules") == 0).drop("broken_rules")
        bad = scratch[0].filter(F.size("broken_rules") > 0)
        unique, repeated = first_per_key(good)
        scratch.append(unique)
        some = not bad.isEmpty()
        if some or repeated is not None or rejected_lines is not None:
            bad = bad.groupBy(*bad.columns).agg(F.count(F.lit(1)).alias("rows"))
            if repeated is not None:
                bad = bad.unionByName(repeated.withColumn("broken_rules", F.array(F.lit("duplicate_key"))))
            refused = _quarantined(bad, rejected_lines)
            refused.write.mode("overwrite").parquet(f"{store}/quarantine/data_version={version}")
        return unique

    def compare(fed: DataFrame, listed: list[Row]) -> DataFrame:
        """The rows that differ from the version before, with the file that has them."""
        if not listed:
            return fed.select(
                *S.ADDRESS_COLUMNS,
                batch.alias("created_at"),
                batch.alias("updated_at"),
                F.lit("inserted").alias("op"),
                F.lit(None).cast("string").alias("_file"),
            )
        at = listed
        if partial:
            held = files.covering(spark, listed, fed.select("zip_code"))
            at = [f for f in listed if f.path in held]
        prior = files.read(spark, store, at, with_files=True)
        rows = apply_feed(prior, fed, batch, update_columns=update_columns, carry=["_file"])
        wanted = F.col("op").isin("inserted", "updated") if partial else (F.col("op") != "updated") | F.col("changed")
        scratch.append(materialise(rows.filter(wanted), "publish-delta"))
        return scratch[-1]

    def count(found: list[Row], listed: list[Row]) -> dict[str, int]:
        ops: Counter[str] = Counter()
        for r in found:
            ops[r.op] += r.rows
        before = sum(f.rows for f in listed)
        updated = ops["updated"] if partial else before - ops["deleted"] - ops["kept"]
        if ops["inserted"] + updated == 0 and not quarantine(spark, store).filter(
            F.col("data_version") == version
        ).isEmpty():
            raise ValueError("nothing of the feed could be used; see the quarantine")
        if max_deleted_ratio is not None and ops["deleted"] > max_deleted_ratio * before:
            raise ValueError(f"the feed lacks {ops['deleted']} of {before} rows")
        return {
            "records_in_feed": ops["inserted"] + updated,
            "inserted_count": ops["inserted"],
            "updated_count": updated,
            "deleted_count": ops["deleted"],
            "total_count": before - ops["deleted"] + ops["inserted"],
        }

    def write(delta: DataFrame, found: list[Row], listed: list[Row]) -> None:
        inserted = sum(r.rows for r in found if r.op == "inserted")
        hit = {r._file for r in found}
        if inserted and len(hit) < len(listed):
            hit |= files.covering(spark, listed, delta.filter("op = 'inserted'").select("zip_code"))
        old = [f for f in listed if f.path in hit]
        same = [f for f in listed if f.path not in hit]
        rows = delta
        if old:
            rows = _rewritten(files.read(spark, store, old), delta, F.col("updated_at") if partial else batch)
        size = sum(f.rows for f in old) + inserted
        files.write(spark, store, version, rows, size, same, None if partial else second, file_rows)

    try:
        fed = _stage("bulk_insert", check)
        listed = files.listed(spark, store, live.content_version) if live else []
        delta = _stage("bulk_insert", lambda: compare(fed, listed))
        per_file = delta.groupBy("_file", "op").agg(F.count(F.lit(1)).alias("rows"))
        found = _stage("compute_diff_counts", per_file.collect)
        counts = _stage("compute_diff_counts", lambda: count(found, listed))
        _stage("bulk_insert", lambda: write(delta, found, listed))
        record = _audit(**run, **counts, content_version=version, status="success")
        if not files.commit(spark, store, (live.commit if live else 0) + 1, record):
            raise StageError("commit: another run was published meanwhile")
    except StageError as e:
        files.forget(spark, store, version)
        return _failed(spark, store, **run, error_message=str(e))
    finally:
        discard(*scratch)
    return record


def rollback(
    spark: SparkSession, store: str, target: str, at: datetime | None = None
) -> Row:
    """Make the rows of version ``target`` current again.  Nothing is copied: the audit
    row points at the version.  An unknown or empty target is an error."""
    now = _utc(at or datetime.now(UTC))
    published = audits(spark, store).filter(
        (F.col("data_version") == target) & (F.col("status") == "success")
    )
    restored = 0
    if published.first() is not None:
        restored = sum(f.rows for f in files.listed(spark, store, target))
    if restored == 0:
        raise ValueError(f"no rows found for version {target}")
    record = _audit(
        data_version=version_id(now, "rv"),
        content_version=target,
        source_url=f"rollback_cli:{target}",
        run_started_at=now,
        run_finished_at=now,
        batch_timestamp=now.replace(microsecond=0),
        records_in_feed=restored,
        inserted_count=restored,
        total_count=restored,
        status="rollback",
    )
    while not files.commit(spark, store, _live_audit(spark, store).commit + 1, record):
        pass  # another run was faster; a rollback does not depend on it
    return record


# ---- comparing versions --------------------------------------------------------------


def diff_versions(
    old: DataFrame,
    new: DataFrame,
    keys: Sequence[str] = S.ADDRESS_KEY,
    payload: Sequence[str] = ("city_id", "prefecture"),
) -> DataFrame:
    """Rows added, removed or changed from ``old`` to ``new``, with the changed columns."""

    def side(df: DataFrame, p: str) -> DataFrame:
        return df.select(
            *[F.col(c).alias(f"_{p}_{c}") for c in keys],
            *[F.col(c).alias(f"{p}_{c}") for c in payload],
            F.lit(True).alias(f"_{p}"),
        )

    same = null_safe([f"_old_{c}" for c in keys], [f"_new_{c}" for c in keys])
    both = side(old, "old").join(side(new, "new"), same, "full")
    both = both.withColumns({c: F.coalesce(f"_old_{c}", f"_new_{c}") for c in keys})
    changed = F.filter(
        F.array(
            *[
                F.when(~F.col(f"old_{c}").eqNullSafe(F.col(f"new_{c}")), F.lit(c))
                for c in payload
            ]
        ),
        lambda c: c.isNotNull(),
    )
    kind = (
        F.when(F.col("_old").isNull(), "added")
        .when(F.col("_new").isNull(), "removed")
        .when(F.size("_changed") > 0, "changed")
    )
    pairs = [f"{p}_{c}" for c in payload for p in ("old", "new")]
    out = both.withColumn("_changed", changed).withColumn("change_type", kind)
    return out.filter(F.col("change_type").isNotNull()).select(
        *keys,
        "change_type",
        F.when(F.col("change_type") == "changed", F.col("_changed"))
        .otherwise(F.array().cast("array<string>"))
        .alias("changed_columns"),
        *pairs,
    )


def diff_published(spark: SparkSession, store: str, old: str, new: str) -> DataFrame:
    """``diff_versions`` of two published versions that reads only the files and ranges in which
    they may differ.  A rollback stands for the version it brought back."""
    runs = files.commits(spark, store).filter(F.col("data_version").isin(old, new)).collect()
    of = {r.data_version: r.content_version for r in runs}
    if missing := {old, new} - set(of):
        raise ValueError(f"not published: {', '.join(sorted(missing))}")
    lists = [files.listed(spark, store, of[v]) for v in (old, new)]
    return diff_versions(*files.differing(spark, store, *lists))


def drift(runs: DataFrame, threshold: float = 0.1) -> DataFrame:
    """How the table size moved from run to run; ``suspicious`` above ``threshold``.

    One row per run, so the unpartitioned window stays tiny.
    """
    before = F.lag("total_count").over(Window.orderBy("created_at", "data_version"))
    change = F.col("total_count") - F.col("previous_count")
    ratio = F.when(F.col("previous_count") > 0, change / F.col("previous_count"))
    return (
        runs.filter(F.col("status").isin(*_LIVE))
        .select("data_version", "created_at", "total_count", before.alias("previous_count"))
        .withColumn("change_ratio", ratio)
        .withColumn("suspicious", F.coalesce(F.abs("change_ratio") > threshold, F.lit(False)))
    )


def prefecture_drift(old: DataFrame, new: DataFrame) -> DataFrame:
    """Row counts per prefecture in two versions."""

    def counts(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("prefecture_id").agg(F.count(F.lit(1)).alias(name))

    both = counts(old, "old_count").join(counts(new, "new_count"), "prefecture_id", "full")
    old_n, new_n = F.coalesce("old_count", F.lit(0)), F.coalesce("new_count", F.lit(0))
    return both.select(
        "prefecture_id",
        old_n.alias("old_count"),
        new_n.alias("new_count"),
        (new_n - old_n).alias("change"),
    )


# ---- quality -------------------------------------------------------------------------


def quality_rules() -> dict[str, Column]:
    """Row rules by name; true means the row breaks the rule."""

    def blank(c: str) -> Column:
        return F.coalesce(F.col(c), F.lit("")) == ""

    rules = {
        "blank_key": blank("zip_code") | blank("city") | F.col("prefecture_id").isNull(),
        "zip_not_7_digits": ~F.coalesce(F.col("zip_code").rlike("^[0-9]{7}$"), F.lit(False)),
        "unknown_prefecture": F.coalesce("prefecture_id", F.lit(0)) == 0,
    }
    for c, limit in S.ADDRESS_LENGTHS.items():
        rules[f"long_{c}"] = F.coalesce(F.length(c), F.lit(0)) > limit
    return rules


def _broken(names: Sequence[str] | None) -> Column:
    """The broken ones of the rules ``names``, by default those a published row must keep."""
    rules = quality_rules()
    if names is None:
        names = [name for name in rules if name != "unknown_prefecture"]
    return F.filter(
        F.array(*[F.when(rules[name], F.lit(name)) for name in names]).cast("array<string>"),
        lambda name: name.isNotNull(),
    )


def quality_split(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows that keep every rule, rows that do not with their ``broken_rules``)."""
    checked = df.withColumn("broken_rules", _broken(list(quality_rules())))
    good = checked.filter(F.size("broken_rules") == 0).drop("broken_rules")
    return good, checked.filter(F.size("broken_rules") > 0)


def quality_counts(df: DataFrame, keys: Sequence[str] = S.ADDRESS_KEY) -> DataFrame:
    """Rows breaking each rule, and rows beyond the first of their key."""
    rules = quality_rules()
    per_key = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.count_if(rule).alias(name) for name, rule in rules.items()],
    )
    totals = per_key.agg(
        *[F.coalesce(F.sum(name), F.lit(0)).alias(name) for name in rules],
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicate_key"),
    )
    names = [*rules, "duplicate_key"]
    return totals.unpivot([], names, "rule", "broken_count")
