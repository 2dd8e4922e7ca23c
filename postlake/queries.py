"""Every operator as a query over the given tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import UTC, datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postlake import schema as S
from postlake.functions import network as N
from postlake.functions import text
from postlake.operators import access, catalogue, lookup, rollup, search, sli
from postlake.operators.lines import number_sorted
from postlake.operators.runs import dedup_first, merge_split_rows
from postlake.plans import reports
from postlake.plans import tables as t
from postlake.plans import versions as V
from postlake.plans.clean import prepare_feed
from postlake.plans.store import all_listed, commits, differing, listed
from postlake.session import SETTINGS, materialise, scratch_path
from postlake.sources import export
from postlake.sources.archives import write_archives
from postlake.sources.feed import prefecture_dimension, read_feed, read_zipped_feed
from postlake.sources.request_log import (
    dependency_errors,
    dependency_failures,
    parse_request_log,
)
from postlake.streaming import jobs, probes

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

FIRST_BATCH = datetime(2026, 1, 1, 3, 0, 0, 123000, tzinfo=UTC)
SECOND_BATCH = datetime(2026, 1, 2, 3, 0, 0, 456000, tzinfo=UTC)
AS_OF = "2024-01-31 00:00:00"


def query(fn: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", SETTINGS["spark.sql.session.timeZone"])
        return fn(spark, sf_dir)

    QUERIES[fn.__name__] = run
    return fn


def addr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.addresses(spark, sf_dir).select(*S.ADDRESS_COLUMNS)


def events_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.request_log(t.table(spark, sf_dir, "events"))


def _int(c: str) -> Column:
    return F.col(c).cast("int").alias(c)


def _at(c: str) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)


def _round(*names: str) -> list[Column]:
    return [F.round(c, 6).alias(c) for c in names]


def _shown(df: DataFrame) -> DataFrame:
    """Absent addresses as blanks, so that result columns hold no nulls."""
    out = df.withColumn("prefecture_id", F.col("prefecture_id").cast("int"))
    return out.fillna(0, ["prefecture_id"]).fillna(
        "", [c for c in S.ADDRESS_COLUMNS if c != "prefecture_id" and c in df.columns]
    )


# ---- lookups -------------------------------------------------------------------------


@query
def zip_lookup_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(lookup.lookup_zip(t.zip_requests(spark, sf_dir), addr(spark, sf_dir)))


@query
def zip_lookup_null_town(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some addresses have no town, which a hit shows as empty; a miss shows null."""
    town = F.expr("CASE WHEN city LIKE '%7' THEN NULL ELSE town END")
    rows = lookup.lookup_zip(t.zip_requests(spark, sf_dir), addr(spark, sf_dir).withColumn("town", town))
    return rows.select("request_id", "status", F.coalesce("town", F.lit("<null>")).alias("town"))


@query
def zip_lookup_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(lookup.lookup_zip_one(addr(spark, sf_dir), "〒000-0003"))


@query
def zip_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    written = F.concat_ws("-", "o_orderpriority", "o_custkey", "o_orderkey")
    normalized = text.normalize_zip(written)
    return t.table(spark, sf_dir, "orders").select(
        "o_orderkey",
        normalized.alias("zip"),
        text.format_zip(written).alias("formatted"),
        text.is_valid_zip(normalized).alias("valid"),
    )


@query
def address_autofill(spark: SparkSession, sf_dir: str) -> DataFrame:
    forms = t.zip_requests(spark, sf_dir).select(
        "request_id",
        F.col("zip").alias("zip_code"),
        F.lit("typed").alias("prefecture"),
        F.col("zip").alias("town"),
    )
    return _shown_forms(lookup.enrich_addresses(forms, addr(spark, sf_dir)))


def _shown_forms(df: DataFrame) -> DataFrame:
    return df.fillna("", ["city"])


@query
def zip_city_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = t.table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("request_id"), t.pad(F.col("s_suppkey"), 7).alias("zip")
    )
    out = lookup.zip_city_options(asked, addr(spark, sf_dir))
    return out.withColumn("prefecture_id", F.col("prefecture_id").cast("int"))


@query
def prefectures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogue.prefectures(addr(spark, sf_dir)).select(_int("prefecture_id"), "prefecture")


@query
def cities_by_prefecture(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = catalogue.cities(addr(spark, sf_dir))
    return rows.select(_int("prefecture_id"), "city_id", "city")


@query
def cities_of_prefecture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogue.cities(addr(spark, sf_dir), 13)


@query
def cities_of_suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = t.table(spark, sf_dir, "supplier").select(
        (F.col("s_nationkey") + 1).cast("smallint").alias("prefecture_id")
    )
    rows = catalogue.cities(addr(spark, sf_dir), prefecture_ids=asked)
    return rows.select(_int("prefecture_id"), "city_id", "city")


# ---- search --------------------------------------------------------------------------


def _search(mode: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = search.search_addresses(
            t.search_requests(spark, sf_dir, mode), addr(spark, sf_dir)
        )
        return _shown(found.select("request_id", "position", *S.ADDRESS_COLUMNS))

    run.__name__ = f"search_{mode}"
    return query(run)


for _mode in S.SEARCH_MODES:
    _search(_mode)


@query
def search_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search.search_concat(t.span_requests(spark, sf_dir), addr(spark, sf_dir))
    return _shown(found.select("request_id", "position", *S.ADDRESS_COLUMNS))


@query
def search_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = t.search_requests(spark, sf_dir, "exact")
    found = search.search_addresses(asked, addr(spark, sf_dir), keep_all=True)
    return found.groupBy("request_id", "status").agg(F.count("position").alias("hits"))


@query
def search_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search.search_addresses(
        t.search_requests(spark, sf_dir, "exact"), addr(spark, sf_dir)
    )
    return export.search_json(found)


@query
def search_fold_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keywords with the long mark that the feed stores as a hyphen."""
    word = F.concat("o_orderpriority", F.lit("ー"), F.col("o_custkey") % 40)
    asked = t.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("request_id"),
        F.concat(F.lit("LDINGー"), F.col("o_custkey") % 40).alias("address"),
        F.lit("partial").alias("mode"),
        F.length(word).alias("limit"),
    )
    found = search.search_addresses(asked, addr(spark, sf_dir), fold_search_width=True)
    return _shown(found.select("request_id", "position", *S.ADDRESS_COLUMNS))


# ---- text ----------------------------------------------------------------------------


@query
def kana_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    kana = F.translate("text", "abcdefghijklmnop", "あいうえおがぎゔゖぁアイウヴヶー")
    docs = t.table(spark, sf_dir, "documents").select("doc_id", kana.alias("text"))
    return docs.select(
        "doc_id",
        F.md5(text.to_katakana(F.col("text"))).alias("katakana"),
        F.md5(text.to_hiragana(F.col("text"))).alias("hiragana"),
        F.size(text.search_candidates(F.col("text"))).cast("long").alias("candidates"),
    )


_ASCII = "".join(map(chr, range(0x21, 0x7F)))
_WIDE = "".join(chr(ord(ch) + 0xFEE0) for ch in _ASCII)


@query
def width_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = t.table(spark, sf_dir, "documents")
    word = text.normalize_keyword(F.translate("text", _ASCII + " ", _WIDE + "　"))
    return docs.select("doc_id", word.alias("word")).select(
        "doc_id", F.md5("word").alias("word"), F.length("word").cast("long").alias("chars")
    )


@query
def paren_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = F.translate("text", ",.0123456789", "（）０１２３４５６７８９")
    docs = t.table(spark, sf_dir, "documents").select("doc_id", wide.alias("text"))
    docs = docs.withColumn("text", text.fold_width(F.col("text")))
    docs = docs.withColumn("kept", text.strip_parens(F.col("text")))
    return docs.select(
        "doc_id", F.md5("kept").alias("kept"), F.length("kept").cast("long").alias("chars")
    )


@query
def keyword_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    mode = F.expr("CASE o_orderkey % 3 WHEN 0 THEN 'exact' WHEN 1 THEN 'prefix' ELSE 'partial' END")
    return t.table(spark, sf_dir, "orders").select(
        "o_orderkey",
        text.search_pattern(F.col("o_orderpriority"), mode).alias("pattern"),
        text.clamp_limit(F.col("o_custkey") - 10).alias("limit"),
    )


@query
def version_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.col("ts").cast("timestamp")
    return t.table(spark, sf_dir, "events").select(
        "event_id",
        text.data_version(at).alias("data_version"),
        F.date_format(text.batch_second(at), "yyyy-MM-dd HH:mm:ss.SSS").alias("batch"),
    )


# ---- feeds ---------------------------------------------------------------------------


@query
def split_row_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = number_sorted(t.lineitem_feed(spark, sf_dir), t.LINEITEM_ORDER)
    merged = merge_split_rows(
        lines.select("feed_file", "line_no", "zip_code", "city_id", "town", "flag"),
        ["zip_code", "city_id"],
        text="town",
        flag="flag",
    )
    unique = dedup_first(merged, ["zip_code", "town"], ["line_no"])
    return unique.select((F.col("line_no") + 1).alias("line_no"), "zip_code", "city_id", "town")


@query
def feed_files_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feed files written in line order, some lines malformed, then read and cleaned."""
    path = scratch_path(spark, "feed-files")
    lines = t.feed_lines(spark, sf_dir)
    order = ["zip_code", "o_orderkey"]
    lines.repartitionByRange(*order).sortWithinPartitions(*order).select("line").write.text(path)
    records, _ = read_feed(spark, path, encoding="utf-8", joined=True)
    return _shown(prepare_feed(records, prefecture_dimension(spark)))


@query
def feed_archives_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same feed in zip archives, each folder packed by another method."""
    path = scratch_path(spark, "feed-archives")
    order = ["zip_code", "o_orderkey"]
    lines = t.feed_lines(spark, sf_dir).repartitionByRange(4, *order).sortWithinPartitions(*order)
    lines = materialise(lines.select(F.spark_partition_id().alias("part"), *order, "line"), "feed-lines")
    for k, method in enumerate(("stored", "deflate", "bzip2", "lzma")):
        part = lines.filter(F.col("part") == k).repartitionByRange(2, *order).sortWithinPartitions(*order)
        write_archives(part, f"{path}/{k}", method, "cp932")
    folders = [f"{path}/{k}" for k in range(4)]
    records, _ = read_zipped_feed(spark, folders, joined=True)
    return _shown(prepare_feed(records, prefecture_dimension(spark)))


@query
def joined_parts_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A feed in parts whose names hold a year, an encoding and the part's number, the last of
    which gains a digit; runs of split rows cross from part to part."""
    path = scratch_path(spark, "feed-parts")
    order = ["zip_code", "o_orderkey"]
    lines = t.feed_lines(spark, sf_dir).repartitionByRange(4, *order).sortWithinPartitions(*order)
    lines.select("line").write.text(path)
    parts = []
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs
    folder = fs.Path(path)
    system = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    written = sorted(f.getPath().getName() for f in system.listStatus(folder))
    for k, name in enumerate(n for n in written if n.startswith("part-")):
        parts.append(f"{path}/utf8_2025_part-{99_998 + k}.csv")
        system.rename(fs.Path(folder, name), fs.Path(parts[-1]))
    records, _ = read_feed(spark, parts, encoding="utf-8", joined=True)
    return _shown(prepare_feed(records, prefecture_dimension(spark)))


@query
def feed_merge_before_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same feed with split towns joined before their parentheses are stripped."""
    path = scratch_path(spark, "feed-files")
    order = ["zip_code", "o_orderkey"]
    lines = t.feed_lines(spark, sf_dir).repartitionByRange(*order).sortWithinPartitions(*order)
    lines.select("line").write.text(path)
    records, _ = read_feed(spark, path, encoding="utf-8", joined=True)
    return _shown(prepare_feed(records, prefecture_dimension(spark), merge_before_strip=True))


@query
def feed_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "feed-files")
    t.feed_lines(spark, sf_dir).select("line").write.text(path)
    _, quarantine = read_feed(spark, path, encoding="utf-8")
    return quarantine.groupBy("line").agg(F.count("feed_file").alias("lines"))


# ---- versions ------------------------------------------------------------------------


def _versioned(df: DataFrame, batch: datetime) -> DataFrame:
    return df.withColumn("created_at", F.lit(batch)).withColumn("updated_at", F.lit(batch))


def _applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    prior = _versioned(addr(spark, sf_dir), FIRST_BATCH.replace(microsecond=0))
    batch = F.lit(SECOND_BATCH.replace(microsecond=0))
    return V.apply_feed(prior, t.next_addresses(spark, sf_dir), batch)


@query
def upsert_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _applied(spark, sf_dir)
    return _shown(rows.select(*S.ADDRESS_COLUMNS, _at("created_at"), _at("updated_at"), "op", "changed"))


@query
def diff_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.diff_counts(_applied(spark, sf_dir))


@query
def upsert_large(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part-supplier pairs of open lines as the table, those of finished lines as the feed."""

    def side(status: str) -> DataFrame:
        lines = t.table(spark, sf_dir, "lineitem").filter(F.col("l_linestatus") == status)
        return lines.groupBy("l_partkey", "l_suppkey").agg(F.max("l_linenumber").alias("line"))

    prior = _versioned(side("O"), FIRST_BATCH)
    keys = ["l_partkey", "l_suppkey"]
    return V.diff_counts(V.apply_feed(prior, side("F"), F.lit(SECOND_BATCH), keys))


@query
def version_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _diff_shown(V.diff_versions(addr(spark, sf_dir), t.next_addresses(spark, sf_dir)))


def _diff_shown(rows: DataFrame) -> DataFrame:
    names = F.array_join("changed_columns", ",").alias("changed_columns")
    return rows.select(
        "zip_code", _int("prefecture_id"), "city", "town", "change_type", names
    )


@query
def prefecture_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.prefecture_drift(addr(spark, sf_dir), t.next_addresses(spark, sf_dir))
    return rows.withColumn("prefecture_id", F.col("prefecture_id").cast("int"))


def _published(spark: SparkSession, sf_dir: str) -> str:
    store = scratch_path(spark, "store")
    V.publish(spark, store, addr(spark, sf_dir), FIRST_BATCH, "first")
    V.publish(spark, store, t.next_addresses(spark, sf_dir), SECOND_BATCH, "second")
    return store


def _store_rows(df: DataFrame) -> DataFrame:
    return _shown(df.select(*S.ADDRESS_COLUMNS, _at("created_at"), _at("updated_at")))


@query
def publish_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _store_rows(V.current(spark, _published(spark, sf_dir)))


@query
def publish_audits(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _published(spark, sf_dir)
    V.rollback(spark, store, V.version_id(FIRST_BATCH), SECOND_BATCH.replace(day=3))
    return V.audits(spark, store).select(
        "data_version",
        "content_version",
        "source_url",
        "records_in_feed",
        "inserted_count",
        "updated_count",
        "deleted_count",
        "total_count",
        "status",
    )


@query
def rollback_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _published(spark, sf_dir)
    V.rollback(spark, store, V.version_id(FIRST_BATCH))
    return _store_rows(V.current(spark, store))


@query
def snapshot_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.snapshots(spark, _published(spark, sf_dir))
    return rows.groupBy("data_version").agg(F.count("zip_code").alias("rows"))


@query
def republish_null_towns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same feed twice, some towns null: the second run updates all rows and deletes none."""
    rows = addr(spark, sf_dir).withColumn("town", F.when(~F.col("city").like("%7"), F.col("town")))
    rows = rows.dropDuplicates(S.ADDRESS_KEY)
    store = scratch_path(spark, "store")
    for batch, name in ((FIRST_BATCH, "first"), (SECOND_BATCH, "second")):
        V.publish(spark, store, rows, batch, name)
    counted = V.audits(spark, store).select(
        F.col("source_url").alias("run"), "inserted_count", "updated_count", "deleted_count", "total_count"
    )
    held = V.current(spark, store).filter("created_at < updated_at").agg(
        F.lit("rows kept").alias("run"),
        *[F.lit(0).cast("long").alias(f"{c}_count") for c in ("inserted", "updated", "deleted")],
        F.count(F.lit(1)).alias("total_count"),
    )
    return counted.unionByName(held)


def _changed_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All addresses, those of the lowest zips (one in a hundred) with another city id."""
    rows = addr(spark, sf_dir)
    few = F.col("zip_code").cast("long") * 3 < rows.count() // 100
    return rows.withColumn("city_id", F.when(few, "99999").otherwise(F.col("city_id")))


def _small_change(spark: SparkSession, sf_dir: str, partial: bool) -> str:
    """A store with two versions in files of about a fiftieth of the rows."""
    store, rows = scratch_path(spark, "store"), addr(spark, sf_dir)
    size = -(-rows.count() // 50)
    V.publish(spark, store, rows, FIRST_BATCH, "first", file_rows=size)
    news = _changed_addresses(spark, sf_dir)
    if partial:
        news = news.filter("city_id = '99999'")
    V.publish(spark, store, news, SECOND_BATCH, "second", partial=partial, file_rows=size)
    return store


@query
def publish_small_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table after a feed that changes one row in a hundred."""
    return _store_rows(V.current(spark, _small_change(spark, sf_dir, partial=False)))


@query
def publish_partial_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table after a feed of the changed rows alone."""
    return _store_rows(V.current(spark, _small_change(spark, sf_dir, partial=True)))


@query
def publish_rewrites_little(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of both publishes, whether the second rewrote at most one row in twenty, and the rows of
    the version before, which stays as it was."""
    out = []
    for partial in (False, True):
        store = _small_change(spark, sf_dir, partial)
        first, second = V.version_id(FIRST_BATCH), V.version_id(SECOND_BATCH)
        lists = all_listed(spark, store)
        new = F.col("path").contains(second)
        rows = lists.filter(F.col("data_version") == second).agg(
            (F.sum(F.when(new, F.col("rows")).otherwise(0)) * 20 <= F.sum("rows")).alias("little"),
            F.sum("rows").alias("rows"),
        )
        before = V.read_version(spark, store, first).filter("city_id = '99999'")
        rows = rows.crossJoin(before.agg(F.count(F.lit(1)).alias("changed_before")))
        out.append(rows.select(F.lit(partial).alias("partial"), "*"))
    return out[0].unionByName(out[1])


@query
def published_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The diff of two stored versions, found through their lists and digests."""
    versions = V.version_id(FIRST_BATCH), V.version_id(SECOND_BATCH)
    return _diff_shown(V.diff_published(spark, _published(spark, sf_dir), *versions))


@query
def published_diff_reads_little(spark: SparkSession, sf_dir: str) -> DataFrame:
    """After a change of one row in a hundred: the changes, and whether at most one row in
    twenty of each version was read to find them."""
    store = _small_change(spark, sf_dir, partial=False)
    lists = [listed(spark, store, V.version_id(batch)) for batch in (FIRST_BATCH, SECOND_BATCH)]
    some = [side.agg(F.count(F.lit(1)).alias("read")) for side in differing(spark, store, *lists)]
    read = some[0].unionByName(some[1]).agg(F.max("read").alias("read"))
    rows = V.diff_versions(*differing(spark, store, *lists))
    found = rows.groupBy("change_type").agg(F.count(F.lit(1)).alias("rows"))
    few = F.col("read") * 20 <= sum(f.rows for f in lists[0])
    return found.crossJoin(read).select("change_type", "rows", few.alias("little"))


@query
def publish_conflict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs that follow one version: the commit number of the first is taken for the other."""
    store, rows = _published(spark, sf_dir), addr(spark, sf_dir)
    last = commits(spark, store).agg(F.max("commit")).first()[0]
    for day in (3, 4):
        V.publish(spark, store, rows, SECOND_BATCH.replace(day=day), f"day {day}", follows=last)
    runs = V.audits(spark, store).select(
        F.col("source_url").alias("run"), "status", F.coalesce("error_message", F.lit("")).alias("error"), "total_count"
    )
    held = V.current(spark, store).agg(
        F.lit("current").alias("run"),
        F.lit("").alias("status"),
        F.lit("").alias("error"),
        F.count(F.lit(1)).alias("total_count"),
    )
    return runs.unionByName(held)


@query
def run_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.drift(t.order_runs(spark, sf_dir), 0.2)
    return rows.select(
        "data_version",
        "total_count",
        F.coalesce("previous_count", F.lit(0)).alias("previous_count"),
        "suspicious",
    )


def _dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One address row per order, with blanks, unknown prefectures and duplicates."""
    customer = F.col("o_custkey")
    return t.table(spark, sf_dir, "orders").select(
        F.when(F.col("o_orderstatus") == "P", "12").otherwise(t.pad(customer, 7)).alias("zip_code"),
        (customer % 26).cast("smallint").alias("prefecture_id"),
        t.pad(customer % 40, 5).alias("city_id"),
        F.repeat("o_orderpriority", 4).alias("prefecture"),
        F.when(customer % 9 > 0, F.col("o_orderpriority")).otherwise("").alias("city"),
        F.repeat("o_orderpriority", (customer % 100).cast("int")).alias("town"),
    )


@query
def quality_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.quality_counts(_dirty(spark, sf_dir))


@query
def quality_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, bad = V.quality_split(_dirty(spark, sf_dir))
    rules = F.array_join("broken_rules", ",").alias("broken_rules")
    return bad.groupBy(rules).agg(F.count(F.lit(1)).alias("rows"))


def _published_dirty(spark: SparkSession, sf_dir: str) -> str:
    store = scratch_path(spark, "store")
    V.publish(spark, store, _dirty(spark, sf_dir), FIRST_BATCH, "dirty")
    return store


@query
def publish_dirty_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is published of a feed with bad and repeated rows."""
    return _store_rows(V.current(spark, _published_dirty(spark, sf_dir)))


@query
def publish_dirty_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What that publish refused, by broken rules, beside the published and audited totals."""
    store = _published_dirty(spark, sf_dir)
    rules = F.array_join("broken_rules", ",").alias("what")
    refused = V.quarantine(spark, store).groupBy(rules).agg(F.sum("rows").alias("rows"))
    audited = V.audits(spark, store).select(F.col("status").alias("what"), F.col("total_count").alias("rows"))
    held = V.current(spark, store).agg(F.lit("current").alias("what"), F.count(F.lit(1)).alias("rows"))
    return refused.unionByName(audited).unionByName(held)


@query
def export_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, out = addr(spark, sf_dir), scratch_path(spark, "release")
    header = len(",".join(S.ADDRESS_COLUMNS)) + 1
    total = export.manifest_total(export.export_release(rows, out, SECOND_BATCH)).select(
        "row_count", "content_hash", (F.col("size_bytes") - F.col("files") * header).alias("row_bytes")
    )
    hashed = F.sum(F.xxhash64(*S.ADDRESS_COLUMNS).cast("decimal(38,0)"))
    want = rows.agg(hashed.alias("want"))
    same = F.col("content_hash") == F.col("want")
    return total.join(want, same).select("row_count", "row_bytes", same.alias("hash_matches"))


# ---- monitoring ----------------------------------------------------------------------


def _windows(rows: DataFrame) -> DataFrame:
    return rows.select(
        _at("window_start"),
        "requests",
        "errors",
        "not_found",
        *_round("error_rate", "not_found_ratio"),
        F.round(F.coalesce("p95_ms", F.lit(-1.0)), 6).alias("p95_ms"),
        "probes",
        "probes_ok",
    )


@query
def request_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sli.request_metrics(events_log(spark, sf_dir))
    return rows.select(
        "requests_total",
        "errors_total",
        "not_found_total",
        *_round("error_rate", "average_latency_ms"),
    )


@query
def request_metrics_by_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sli.request_metrics(events_log(spark, sf_dir), by=["path"])
    return rows.select("path", "requests_total", "errors_total", *_round("average_latency_ms"))


@query
def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Request events written as log lines among other text, then parsed back."""
    log = events_log(spark, sf_dir)
    fields = ["method", "path", "status", "latency_ms"]
    name = F.when(F.col("event_type") != "view", "api_request").otherwise("other")
    as_json = F.to_json(F.struct(name.alias("event"), *fields))
    noisy = F.when(F.col("event_type") == "purchase", F.col("event_type")).otherwise(as_json)
    parsed, _ = parse_request_log(log.select("event_id", "ts", noisy.alias("value")))
    return parsed.select("event_id", *fields)


def _log_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.expr(
        "CASE event_type WHEN 'error' THEN 'Failed to connect to PostgreSQL: timeout' "
        "WHEN 'signup' THEN 'Failed to create Redis connection manager: refused' "
        "WHEN 'view' THEN 'Failed to download: 404' ELSE props END"
    )
    return t.table(spark, sf_dir, "events").select(
        F.col("ts").cast("timestamp").alias("ts"), line.alias("value")
    )


@query
def dependency_error_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dependency_errors(_log_text(spark, sf_dir), window="1 hour")
    return rows.select(_at("window_start"), "dependency", "errors")


@query
def sli_5min(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _windows(sli.flat(sli.sli_windows(events_log(spark, sf_dir))))


@query
def stored_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days merged from stored 5-minute rows, their p95 held against the log."""
    log, path = events_log(spark, sf_dir), scratch_path(spark, "rollup")
    rollup.store(rollup.rollup(log), path)
    days = rollup.merged(rollup.stored(spark, path), "day")
    errors = rollup.rank_errors(log, days, "day")
    within = F.coalesce(F.col("rank_error") < rollup.RANK_ERROR, F.lit(False))
    rows = rollup.indicators(days).join(errors, "window_start", "left")
    return rows.select(
        _at("window_start").alias("day"),
        "requests",
        "errors",
        "not_found",
        "lookups",
        F.round(F.coalesce("mean_ms", F.lit(-1.0)), 6).alias("mean_ms"),
        "probes",
        "probes_ok",
        within.alias("p95_within_bound"),
    )


@query
def sli_6h(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _windows(sli.flat(sli.sli_windows(events_log(spark, sf_dir), window="6 hours")))


@query
def sustained_breach(spark: SparkSession, sf_dir: str) -> DataFrame:
    windows = sli.sli_windows(events_log(spark, sf_dir))
    rows = sli.sustained(windows, F.col("error_rate") >= S.P2_ERROR_RATE, 15)
    return rows.select(_at("start"), _at("end"))


@query
def breach_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    windows = sli.flat(sli.sli_windows(events_log(spark, sf_dir)))
    rows = sli.breach_runs(windows, F.col("error_rate") >= S.P2_ERROR_RATE)
    return rows.select(_at("started_at"), _at("ended_at"), "windows")


def _alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sli.alerts(sli.sli_windows(events_log(spark, sf_dir)))


@query
def alert_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _alerts(spark, sf_dir).select(
        _at("window_end"), "requests", "slow_15m", "not_ready_10m", "level"
    )


@query
def alert_not_ready(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels of a log in which most probes fail, some for 10 minutes on end."""
    log = events_log(spark, sf_dir)
    fails = (F.col("path") == "/ready") & (F.col("event_id") % 5 > 0)
    log = log.withColumn("status", F.when(fails, 503).otherwise(F.col("status")))
    rows = sli.alerts(sli.sli_windows(log))
    return rows.select(_at("window_end"), "requests", "slow_15m", "not_ready_10m", "level")


def _services(log: DataFrame) -> DataFrame:
    return log.withColumn("service", F.concat(F.lit("s"), F.col("user_id") % 20))


def _silent(rows: DataFrame) -> DataFrame:
    return rows.select("service", _at("window_end"), _at("last_good"), "level")


@query
def silent_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows at whose end a service had no good probe for 10 minutes."""
    return _silent(sli.silent_probes(_services(events_log(spark, sf_dir)), "service"))


def _daily_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One run per day, done when the day's first event came."""
    days = events_log(spark, sf_dir).groupBy(F.to_date("ts").alias("day"))
    runs = days.agg(F.min("ts").alias("run_finished_at"), F.lit("success").alias("status"))
    return runs.select("run_finished_at", "status")


@query
def alert_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels with a run history of one run per day."""
    rows = sli.add_freshness(_alerts(spark, sf_dir), _daily_runs(spark, sf_dir))
    return rows.select(_at("window_end"), "level")


@query
def incident_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reports.incidents(_alerts(spark, sf_dir))
    return rows.select("incident", "level", _at("started_at"), _at("ended_at"), "windows")


@query
def incident_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.incident_counts(reports.incidents(_alerts(spark, sf_dir)))


@query
def dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sli.dashboard(events_log(spark, sf_dir), AS_OF)
    return rows.select("range", "requests", "errors", "not_found", *_round("error_rate", "p95_ms"))


@query
def dashboard_panels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The panels of a log in which each third probe fails; purchases stand for updates."""
    log = events_log(spark, sf_dir)
    fails = (F.col("path") == "/ready") & (F.col("event_id") % 3 == 0)
    probed = log.withColumn("status", F.when(fails, 503).otherwise(F.col("status")))
    runs = log.filter("event_type = 'purchase'").select(
        F.col("ts").alias("run_finished_at"), F.lit("success").alias("status")
    )
    failures = dependency_failures(_log_text(spark, sf_dir))
    rows = sli.dashboard_panels(probed, failures, runs, AS_OF)
    return rows.select("range", "panel", *_round("value"), "state")


@query
def incident_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = events_log(spark, sf_dir).select(
        F.col("ts").alias("run_finished_at"),
        F.when(F.col("user_id") % 7 == 0, "failed").otherwise("success").alias("status"),
    )
    errors = dependency_errors(_log_text(spark, sf_dir))
    rows = reports.incident_categories(reports.incidents(_alerts(spark, sf_dir)), runs, errors)
    return rows.select("incident", "category")


@query
def update_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States at several times: some soon after a day's success, some long after."""
    runs = t.order_runs(spark, sf_dir)
    found = [sli.freshness(runs, a).withColumn("as_of", F.lit(a)) for a in t.FRESHNESS_AT]
    return reduce(DataFrame.unionByName, found).select(
        "as_of", _at("last_success"), *_round("hours"), "state"
    )


@query
def error_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reports.error_budget(reports.ready_probes(t.order_log(spark, sf_dir)))
    return rows.select(
        "month",
        "probes",
        "probes_ok",
        *_round("availability"),
        "budget_seconds",
        *_round("consumed_ratio"),
        "freeze",
        "stop",
    )


@query
def slo_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = t.order_log(spark, sf_dir)
    rows = reports.slo_report(log, reports.ready_probes(log), t.order_runs(spark, sf_dir))
    return rows.select(
        "month", "item", "target", F.round(F.coalesce("actual", F.lit(-1.0)), 6).alias("actual"), "result"
    )


@query
def monthly_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reports.monthly_compare(t.order_log(spark, sf_dir), t.order_runs(spark, sf_dir))
    names = [c for c in rows.columns if c != "month"]
    return rows.select(
        "month", *[F.round(F.coalesce(F.col(c).cast("double"), F.lit(-1.0)), 6).alias(c) for c in names]
    )


@query
def update_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reports.update_history(t.order_runs(spark, sf_dir), "1997-05")
    return rows.select(_at("at"), "kind", "data_version", "result")


# ---- access --------------------------------------------------------------------------


def _callers(spark: SparkSession, sf_dir: str) -> DataFrame:
    user = F.col("user_id")
    v4 = F.concat(F.lit("10.0."), F.floor(user / 256), F.lit("."), user % 256)
    v6 = F.concat(F.lit("2001:db8::"), F.lower(F.hex(user)))
    return events_log(spark, sf_dir).select(
        "event_id",
        "event_type",
        "path",
        F.when(F.col("event_type") == "signup", v6).otherwise(v4).alias("ip"),
        F.when(F.col("event_type") == "view", F.concat(F.lit("10.0.0.1, "), v4)).alias("forwarded_for"),
        F.when(F.col("event_type") == "error", F.lit("nobody")).alias("real_ip"),
        F.when(user % 3 > 0, F.col("user_id").cast("string")).otherwise(" ").alias("user"),
    )


@query
def network_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Callers against networks derived from suppliers; host bits may be set."""
    key = F.col("s_suppkey")
    v4 = F.concat(
        F.lit("10.0."), key % 6, F.lit("."), (key % 32) * 8 + 1, F.lit("/"), key % 4 + 27
    )
    networks = t.table(spark, sf_dir, "supplier").select(v4.alias("cidr"))
    v6 = t.table(spark, sf_dir, "region").select(
        F.concat(F.lit("2001:db8::"), F.col("r_regionkey") * 10, F.lit("/124")).alias("cidr")
    )
    rows = access.match_networks(_callers(spark, sf_dir), networks.union(v6))
    return rows.select("event_id", "ip", "allowed")


@query
def client_ips(spark: SparkSession, sf_dir: str) -> DataFrame:
    callers = _callers(spark, sf_dir)
    ip = N.client_ip(F.col("forwarded_for"), F.col("real_ip"), F.col("ip"), True)
    prefixes = N.path_prefixes(F.lit("ready, /postal_codes/1,ready"))
    free = N.path_matches(F.col("path"), prefixes)
    return callers.select("event_id", ip.alias("client_ip"), free.alias("anonymous"))


@query
def access_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = N.parse_networks("10.0.0.0/26,10.0.0.128/25,2001:db8::/122")
    rows = access.access_audit(_callers(spark, sf_dir), rules, True, True, "ready,/health")
    return rows.groupBy("event_type", "outcome").agg(F.count("event_id").alias("requests"))


# ---- streams -------------------------------------------------------------------------


def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = t.table(spark, sf_dir, "events").schema
    files = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet")
    return t.request_log(files.parquet(sf_dir))


def _run_stream(stream: DataFrame) -> DataFrame:
    spark = stream.sparkSession
    return jobs.run_to_table(stream, scratch_path(spark, "stream"), scratch_path(spark, "progress"))


@query
def stream_sli(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _windows(_run_stream(jobs.stream_sli(_event_stream(spark, sf_dir))))


@query
def stream_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _run_stream(jobs.stream_alerts(_event_stream(spark, sf_dir)))
    return rows.select(_at("window_end"), "requests", "slow_15m", "not_ready_10m", "level")


@query
def stream_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels of a stream of requests beside one of daily runs, as far as both have come."""
    runs = materialise(_daily_runs(spark, sf_dir), "runs")
    arriving = spark.readStream.schema(runs.schema).parquet(runs.scratch)
    rows = _run_stream(jobs.stream_alerts_with_freshness(_event_stream(spark, sf_dir), arriving))
    return rows.select(_at("window_end"), "level")


@query
def stream_late_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of all days, then a tenth of those of the days before the last: rows taken in,
    dropped and kept."""
    events = t.table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    last = F.lit(events.agg(F.max("ts")).first()[0])
    late = (F.col("event_id") % 10 == 0) & (F.col("ts") < last - F.expr("INTERVAL 1 DAY"))
    landing, batches = scratch_path(spark, "landing"), scratch_path(spark, "batches")
    places = scratch_path(spark, "stream"), scratch_path(spark, "progress")
    for part in (events.filter(~late), events.filter(late)):
        part.write.mode("append").parquet(landing)
        stream = sli.dedup_events(spark.readStream.schema(events.schema).parquet(landing), ["event_id"], "1 hour")
        kept = jobs.run_to_table(stream, *places, batches=batches)
    counted = jobs.late_rows(spark, batches).agg(F.sum("rows_in").alias("rows_in"), F.sum("dropped").alias("dropped"))
    return counted.crossJoin(kept.agg(F.count(F.lit(1)).alias("kept")))


@query
def stream_incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incidents of a stream, closed by its watermark and numbered where they are read."""
    rows = reports.numbered(_run_stream(jobs.stream_incidents(_event_stream(spark, sf_dir))))
    return rows.select("incident", "level", _at("started_at"), _at("ended_at"), "windows")


@query
def stream_sustained_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _run_stream(jobs.stream_sustained_latency(_event_stream(spark, sf_dir)))
    return rows.select(_at("start"), _at("end"))


@query
def stream_silent_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same windows on a stream, as far as its watermark comes."""
    stream = probes.stream_silent_probes(_services(_event_stream(spark, sf_dir)), "service")
    places = scratch_path(spark, "stream"), scratch_path(spark, "progress")
    return _silent(jobs.run_to_table(stream, *places, settings=probes.SETTINGS))


@query
def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event delivered twice, kept once."""
    events = _event_stream(spark, sf_dir).select("event_id", "ts")
    twice = events.withColumn("delivery", F.explode(F.array(F.lit(1), F.lit(2))))
    return _run_stream(sli.dedup_events(twice, ["event_id"], "1 hour")).select("event_id")


def _arrived_feed(spark: SparkSession, sf_dir: str) -> tuple[str, str]:
    """A folder of feed parts, and a folder with the list of them."""
    parts, landing = scratch_path(spark, "parts"), scratch_path(spark, "landing")
    order = ["zip_code", "o_orderkey"]
    lines = t.feed_lines(spark, sf_dir).repartitionByRange(*order).sortWithinPartitions(*order)
    lines.select("line").write.text(parts)
    spark.read.format("binaryFile").load(parts).select("path").coalesce(1).write.text(landing)
    return parts, landing


def _publish_lists(spark: SparkSession, landing: str, store: str, progress: str) -> None:
    jobs.publish_arrivals(
        spark,
        f"{landing}/part-*.txt",
        store,
        progress,
        encoding="utf-8",
        file_is_feed=False,
        clock=lambda: FIRST_BATCH,
    ).awaitTermination()


@query
def feed_arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The listed parts of a feed, published as the list is found."""
    _, landing = _arrived_feed(spark, sf_dir)
    store = scratch_path(spark, "store")
    _publish_lists(spark, landing, store, scratch_path(spark, "progress"))
    return _store_rows(V.current(spark, store))


@query
def late_part_ignored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same feed when a further part arrives after the list, before and after publishing."""
    parts, landing = _arrived_feed(spark, sf_dir)
    store, progress = scratch_path(spark, "store"), scratch_path(spark, "progress")
    late = t.feed_lines(spark, sf_dir).select(F.replace("line", F.lit("1"), F.lit("7")).alias("line"))
    for _ in range(2):
        late.write.mode("append").text(parts)
        _publish_lists(spark, landing, store, progress)
    return _store_rows(V.current(spark, store))
