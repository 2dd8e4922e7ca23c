"""Postal-code feeds: CSV files or zip archives, Shift_JIS (Windows-31J) or UTF-8."""

from __future__ import annotations

import csv

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postlake import schema as S
from postlake.operators.lines import number_lines
from postlake.sources.archives import archive_lines

_CSV = {"escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": S.CORRUPT}


def _natural(name: Column) -> Column:
    """A sort key in which every number in ``name`` counts as one: 99999 comes before 100000,
    wherever it stands.  Numbers beyond 38 digits are compared as text."""
    pieces = F.regexp_extract_all(name, F.lit("[0-9]+|[^0-9]+"), F.lit(0))

    def key(piece: Column) -> Column:
        number = F.when(piece.rlike("^[0-9]{1,38}$"), piece.try_cast("decimal(38,0)"))
        return F.struct(number.alias("number"), F.when(number.isNull(), piece).alias("text"))

    return F.transform(pieces, key)


def _part_order(path: Column) -> list[Column]:
    """Folder, name and path of a part, numbers in natural order."""
    return [
        _natural(F.regexp_extract(path, r"^(.*)/", 1)).alias("folder"),
        _natural(F.regexp_extract(path, r"([^/]*)$", 1)).alias("name"),
        path.alias("path"),
    ]


def _check_charset(spark: SparkSession, encoding: str) -> None:
    allowed = spark.conf.get("spark.sql.legacy.javaCharsets", "false") == "true"
    if encoding.lower() not in ("utf-8", "us-ascii", "iso-8859-1") and not allowed:
        raise ValueError(
            f"reading {encoding} needs spark.sql.legacy.javaCharsets=true in the session"
        )


def feed_records(lines: DataFrame) -> DataFrame:
    """Pick the used fields by position; an absent one reads as empty, the flag as false."""
    fields = {
        k: F.coalesce(F.col(f"_c{i}"), F.lit("")) if f"_c{i}" in lines.columns else F.lit("")
        for k, i in S.FEED_FIELDS.items()
    }
    fields["flag"] = fields["flag"] == "1"
    return lines.select("feed_file", "_block", *[v.alias(k) for k, v in fields.items()])


def _split(parsed: DataFrame, joined: bool) -> tuple[DataFrame, DataFrame]:
    if joined:
        parsed = parsed.withColumn("feed_file", F.lit("joined"))
    bad = F.col(S.CORRUPT).isNotNull()
    good = feed_records(parsed.filter(~bad))
    # Spark refuses a scan that reads the corrupt-record column alone; the second condition
    # always holds and makes it read a field.
    reads_field = F.length(F.concat_ws("", "_c0")) >= 0
    quarantine = parsed.filter(bad & reads_field).select(
        "feed_file", F.col(S.CORRUPT).alias("line")
    )
    return number_lines(good, "feed_file", "_block", "feed"), quarantine


def read_feed(
    spark: SparkSession,
    path: str | list[str],
    encoding: str = "windows-31j",
    header: bool = False,
    joined: bool = False,
    width: int | None = S.FEED_WIDTH,
    multi_line: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Read a folder of feed files as (numbered records, malformed lines).

    Large files are split.  A malformed line is set aside before lines are numbered, so
    its neighbours stay adjacent.  With ``joined`` the files are the parts of one feed, in
    the order of their folders and names, every number in them counted as one, and lines are
    numbered through.

    Lines of another number of fields than ``width`` are malformed; None takes the number of
    the first record that Spark reads.  ``multi_line`` allows line breaks inside quotes; files
    are then not split, so each must fit in a task.
    """
    _check_charset(spark, encoding)
    options = {**_CSV, "encoding": encoding, "header": header, "multiLine": multi_line}
    if width is None:
        width = len(spark.read.options(**options).csv(path).columns) or S.FEED_WIDTH
    parsed = (
        spark.read.schema(S.feed_line(width))
        .options(**options)
        # With pruning on, Spark does not notice malformed lines in unread columns.
        .option("columnPruning", False)
        .csv(path)
        .select(
            "*",
            F.col("_metadata.file_path").alias("feed_file"),
            F.struct(
                *_part_order(F.col("_metadata.file_path")),
                F.col("_metadata.file_block_start").alias("start"),
            ).alias("_block"),
        )
    )
    return _split(parsed, joined)


def read_zipped_feed(
    spark: SparkSession,
    path: str | list[str],
    encoding: str = "cp932",
    header: bool = False,
    joined: bool = False,
    width: int | None = S.FEED_WIDTH,
    multi_line: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Read a folder of zip archives of any size, one task per group of archives.

    Only the first entry of an archive is read.  Archives without one, or not readable,
    go to quarantine.  ``encoding`` is a Python codec name, ``width`` and ``multi_line`` as in
    ``read_feed``.
    """
    raw = archive_lines(spark, path, encoding, header, multi_line)
    lines = raw.filter(F.col("error").isNull())
    if width is None:
        first = lines.select("line").first()
        width = len(next(csv.reader([first.line]))) if first else S.FEED_WIDTH
    names = S.feed_line(width).fieldNames()
    parsed = lines.select(
        "feed_file",
        F.struct(*_part_order(F.col("feed_file"))).alias("_block"),
        F.from_csv(
            "line", ", ".join(f"{n} string" for n in names), {**_CSV, "multiLine": str(multi_line)}
        ).alias("r"),
    ).select("feed_file", "_block", "r.*")
    good, malformed = _split(parsed, joined)
    broken = raw.filter(F.col("error").isNotNull()).select(
        "feed_file", F.col("error").alias("line")
    )
    return good, malformed.unionByName(broken)


def prefecture_dimension(spark: SparkSession, path: str | None = None) -> DataFrame:
    """(id, label), from a JSON array file or the built-in list."""
    if path is not None:
        return spark.read.schema("id smallint, label string").json(path, multiLine=True)
    rows = ", ".join(f"({i}S, '{label}')" for i, label in enumerate(S.PREFECTURES))
    return spark.sql(f"SELECT * FROM VALUES {rows} AS prefectures(id, label)")
