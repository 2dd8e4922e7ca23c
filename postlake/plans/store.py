"""The files behind published versions.

A store is a folder.  ``data/<id>`` holds the files that a version wrote, ``lists`` which files
make up each version (its own and those it shares with older ones), with the zips they range
over, ``digests`` hashes of the rows of each file by the first digits of their zips, and
``commits`` one numbered JSON file per success.  A commit file is created under a
number that is not taken or not at all, so of two runs that follow one commit only one counts.

Lists are planned on the driver, one entry per file of about ``FILE_ROWS`` rows.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from datetime import datetime
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from postlake import schema as S
from postlake.operators.skew import fits
from postlake.session import delete, empty

#: Rows that a file should have.
FILE_ROWS = 500_000
FILES = "path string, low string, high string, rows long, touched_at timestamp"
DIGESTS = "path string, bucket int, low string, high string, rows long, mixed long, total long"


# ---- commits -------------------------------------------------------------------------


def commits(spark: SparkSession, store: str) -> DataFrame:
    """Audit rows of all successful runs, with their number ``commit``."""
    number = F.regexp_extract(F.col("_metadata.file_name"), r"^(\d+)", 1).cast("long")
    try:
        rows = spark.read.schema(S.AUDIT).json(f"{store}/commits")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return empty(spark, S.AUDIT).withColumn("commit", F.lit(None).cast("long"))
    return rows.select("*", number.alias("commit"))


def commit(spark: SparkSession, store: str, number: int, record: Row) -> bool:
    """Add ``record`` as commit ``number``; False if another run has that number."""
    values = {
        k: v.isoformat(timespec="milliseconds") if isinstance(v, datetime) else v
        for k, v in record.asDict().items()
        if v is not None
    }
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    folder = jvm.org.apache.hadoop.fs.Path(f"{store}/commits")
    system = folder.getFileSystem(conf)
    system.mkdirs(folder)
    # written aside under a name that readers skip, so that a commit is never seen in part
    aside = jvm.org.apache.hadoop.fs.Path(folder, f"_{uuid.uuid4().hex}")
    out = system.create(aside, False)
    out.write(bytearray(json.dumps(values).encode()))
    out.close()
    place = jvm.org.apache.hadoop.fs.Path(folder, f"{number:010d}.json")
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(folder.toUri(), conf)
    none = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        # a rename that does not overwrite
        context.rename(system.makeQualified(aside), system.makeQualified(place), none)
    except Py4JJavaError as e:
        system.delete(aside, False)
        if "FileAlreadyExistsException" not in e.java_exception.getClass().getName():
            raise
        return False
    return True


# ---- lists of files ------------------------------------------------------------------


def all_listed(spark: SparkSession, store: str) -> DataFrame:
    """The files of every version, with ``data_version``."""
    return spark.read.schema(f"{FILES}, data_version string").parquet(f"{store}/lists")


def listed(spark: SparkSession, store: str, version: str) -> list[Row]:
    """The files of one version."""
    return spark.read.schema(FILES).parquet(f"{store}/lists/data_version={version}").collect()


def with_file(rows: DataFrame) -> DataFrame:
    """``rows`` as a scan delivers them, with the listed path ``_file`` of their file."""
    path = F.regexp_extract(F.col("_metadata.file_path"), r"(data/[^/]+/[^/]+)$", 1)
    return rows.select("*", path.alias("_file"))


def touched(names: Sequence[str], at: Column | None = None) -> list[Column]:
    """The columns ``names``; rows of a file that was seen later were updated then."""
    at = F.col("touched_at") if at is None else at
    return [F.greatest("updated_at", at).alias(c) if c == "updated_at" else F.col(c) for c in names]


def read(spark: SparkSession, store: str, files: Sequence[Row], with_files: bool = False) -> DataFrame:
    """The rows of listed files.  There are few different times, as each publish of a whole
    table sets all of them."""
    names = S.ADDRESS_VERSIONED.fieldNames() + ["_file"] * with_files
    by_time: dict[datetime | None, list[str]] = {}
    for f in files:
        by_time.setdefault(f.touched_at, []).append(f"{store}/{f.path}")
    parts = []
    for at, paths in by_time.items():
        rows = with_file(spark.read.schema(S.ADDRESS_VERSIONED).parquet(*paths))
        parts.append(rows.select(*touched(names, F.lit(at).cast("timestamp"))))
    if not parts:
        none = empty(spark, S.ADDRESS_VERSIONED).withColumn("_file", F.lit(None).cast("string"))
        return none.select(*names)
    return reduce(DataFrame.unionByName, parts)


def _bucket(zip_code: Column) -> Column:
    """The first three digits; -1 without them."""
    digits = zip_code.rlike("^[0-9]{3}")
    return F.when(digits, F.substring(zip_code, 1, 3).cast("int")).otherwise(-1)


def covering(spark: SparkSession, files: Sequence[Row], zips: DataFrame) -> set[str]:
    """Paths of the files in whose range one of ``zips`` (``zip_code``) lies.

    Ranges and zips meet by their first digits; zips without any meet every file.
    """
    if not files:
        return set()
    table = spark.createDataFrame([(f.path, f.low, f.high) for f in files], "path string, low string, high string")
    low, high = _bucket(F.col("low")), _bucket(F.col("high"))
    span = F.when((low >= 0) & (high >= 0), F.sequence(low, high)).otherwise(F.sequence(F.lit(0), F.lit(999)))
    ranges = table.withColumn("bucket", F.explode(F.array_append(span, F.lit(-1))))
    if fits(ranges):
        ranges = F.broadcast(ranges)
    # a blank zip is as good as none
    asked = zips.select(F.coalesce("zip_code", F.lit("")).alias("zip_code")).distinct()
    asked = asked.withColumn("bucket", _bucket(F.col("zip_code")))
    inside = F.col("zip_code").between(F.col("low"), F.col("high"))
    return {r.path for r in asked.join(ranges, "bucket").filter(inside).select("path").distinct().collect()}


def write(
    spark: SparkSession,
    store: str,
    version: str,
    rows: DataFrame,
    size: int,
    same: Sequence[Row],
    touched_at: datetime | None,
    file_rows: int = FILE_ROWS,
) -> None:
    """Write ``rows`` (about ``size``) and list them together with the files ``same``, whose
    rows were seen at ``touched_at`` (None: not).

    Files range over the whole key, so that a crowded zip spans several, and are sorted so
    that zip lookups skip row groups.
    """
    names = S.ADDRESS_VERSIONED.fieldNames()
    entries = spark.createDataFrame(
        [(f.path, f.low, f.high, f.rows, touched_at or f.touched_at) for f in same], FILES
    )
    if size:
        folder = f"{store}/data/{version}"
        number, dealt = -(-size // file_rows), rows.select(*names)
        dealt = dealt.repartitionByRange(number, *S.ADDRESS_KEY) if number > 1 else dealt.repartition(1)
        dealt.sortWithinPartitions("zip_code", "town").write.mode("overwrite").parquet(folder)
        zip_code = F.coalesce("zip_code", F.lit(""))
        new = with_file(spark.read.schema(S.ADDRESS_VERSIONED).parquet(folder))
        new = new.groupBy(F.col("_file").alias("path"), _bucket(zip_code).alias("bucket")).agg(
            F.min(zip_code).alias("low"),
            F.max(zip_code).alias("high"),
            F.count(F.lit(1)).alias("rows"),
            *_digest(S.ADDRESS_COLUMNS),
        )
        place = f"{store}/digests/data_version={version}"
        new.coalesce(1).write.mode("overwrite").parquet(place)
        new = spark.read.schema(DIGESTS).parquet(place).groupBy("path").agg(
            F.min("low").alias("low"), F.max("high").alias("high"), F.sum("rows").alias("rows")
        )
        entries = entries.unionByName(new.withColumn("touched_at", F.lit(None).cast("timestamp")))
    entries.coalesce(1).write.mode("overwrite").parquet(f"{store}/lists/data_version={version}")


def forget(spark: SparkSession, store: str, version: str) -> None:
    """Delete what a version that was not committed has written."""
    for path in ("data/", "lists/data_version=", "digests/data_version="):
        delete(spark, f"{store}/{path}{version}")


# ---- finding what differs ------------------------------------------------------------


def _digest(names: Sequence[str]) -> list[Column]:
    """Two sums over the rows of a group that do not depend on their order.  A null is told
    from its neighbours' values."""
    whole = F.xxhash64(*[part for c in names for part in (F.col(c), F.col(c).isNull())])
    return [F.bit_xor(whole).alias("mixed"), F.sum(whole.bitwiseAND(F.lit(0xFFFFFF))).alias("total")]


def _digests(spark: SparkSession, store: str, paths: Sequence[str]) -> DataFrame:
    """What is kept of the files ``paths``, which the versions in their names wrote."""
    folders = {f"{store}/digests/data_version={p.split('/')[1]}" for p in paths}
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    places = [jvm.org.apache.hadoop.fs.Path(f) for f in sorted(folders)]
    there = [p.toString() for p in places if p.getFileSystem(conf).exists(p)]
    if not there:
        return spark.createDataFrame([], DIGESTS)
    asked = spark.createDataFrame([(p,) for p in paths], "path string")
    if fits(asked):
        asked = F.broadcast(asked)
    return spark.read.schema(DIGESTS).parquet(*there).join(asked, "path", "left_semi")


def _differing_buckets(
    spark: SparkSession, store: str, old: Sequence[Row], new: Sequence[Row]
) -> dict[int, set[str]] | None:
    """The buckets whose rows are not the same in the files ``old`` and ``new``, with the files
    that hold them; None if a file has no digests."""

    def side(listed: Sequence[Row], name: str) -> DataFrame:
        found = _digests(spark, store, [f.path for f in listed]).groupBy("bucket").agg(
            F.collect_list("path").alias("paths"),
            F.sum("rows").alias("rows"),
            F.bit_xor("mixed").alias("mixed"),
            F.sum("total").alias("total"),
        )
        return found.select("bucket", F.struct("rows", "mixed", "total").alias(name), F.col("paths").alias(f"_{name}"))

    # a row per bucket, of which there are 1001 at most
    both = side(old, "old").join(side(new, "new"), "bucket", "full").collect()
    for listed, name in ((old, "old"), (new, "new")):
        if sum(r[name].rows for r in both if r[name]) != sum(f.rows for f in listed):
            return None
    return {r.bucket: {*(r._old or ()), *(r._new or ())} for r in both if r.old != r.new}


def differing(
    spark: SparkSession, store: str, old: Sequence[Row], new: Sequence[Row]
) -> tuple[DataFrame, DataFrame]:
    """The rows of two lists of files, without ranges that are sure to be the same in both.

    A file in both lists is left out.  Of the others, the digests of the rows of a bucket are
    added up over its files; buckets whose sums agree are not read, be their rows dealt to
    other files or not.  (Sums of different rows agree with a chance of about 2**-88.)  Files
    without digests are read whole.
    """
    shared = {f.path for f in old} & {f.path for f in new}
    old, new = ([f for f in listed if f.path not in shared] for listed in (old, new))
    buckets = _differing_buckets(spark, store, old, new)
    if buckets is None:
        return read(spark, store, old), read(spark, store, new)
    held = set().union(*buckets.values())
    zip_code = F.coalesce("zip_code", F.lit(""))
    inside = _bucket(zip_code).isin(list(buckets))
    if buckets and 0 <= min(buckets) and max(buckets) < 999:  # lets the scan skip row groups
        low, high = f"{min(buckets):03d}", f"{max(buckets) + 1:03d}"
        inside &= (F.col("zip_code") >= low) & (F.col("zip_code") < high)
    first, second = (read(spark, store, [f for f in listed if f.path in held]).filter(inside) for listed in (old, new))
    return first, second
