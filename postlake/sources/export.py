"""Release files with a checksum manifest, and JSON results."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlake import schema as S

# Keeps every file far below the 2 GB a file can have to be checksummed in one piece.
ROWS_PER_FILE = 2_000_000


def release_rows(addresses: DataFrame) -> DataFrame:
    return addresses.select(
        *[F.coalesce("town", F.lit("")).alias(c) if c == "town" else c for c in S.ADDRESS_COLUMNS]
    )


def export_release(
    addresses: DataFrame, path: str, generated_at: datetime, fmt: str = "csv"
) -> DataFrame:
    """Write the six address columns as sorted files and return their manifest.

    Per file: size, SHA-256, row count and a hash of the content that does not depend on
    row order.  Files are hashed where they lie, one task per group of files.
    """
    spark = addresses.sparkSession
    write = (
        release_rows(addresses)
        .repartitionByRange(*S.ADDRESS_KEY)
        .sortWithinPartitions(*S.ADDRESS_ORDER)
        .write.option("maxRecordsPerFile", ROWS_PER_FILE)
    )
    # Without emptyValue an empty town would read back as null.
    options = {"header": True, "escape": '"', "emptyValue": ""} if fmt == "csv" else {}
    write.options(**options).format(fmt).save(path)
    rows = (
        spark.read.schema(S.ADDRESS)
        .options(**options)
        .format(fmt)
        .load(path)
        .select(F.col("_metadata.file_path").alias("file"), "*")
        .fillna("", ["town"])
        .groupBy("file")
        .agg(
            F.count(F.lit(1)).alias("row_count"),
            F.sum(F.xxhash64(*S.ADDRESS_COLUMNS).cast("decimal(38,0)")).alias("content_hash"),
        )
    )
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", f"part-*.{fmt}")
        .load(path)
        .select(
            F.col("_metadata.file_path").alias("file"),
            F.col("length").alias("size_bytes"),
            F.sha2("content", 256).alias("sha256"),
        )
    )
    return files.join(rows, "file", "left").select(
        "file",
        "size_bytes",
        F.coalesce("row_count", F.lit(0)).alias("row_count"),
        "sha256",
        F.coalesce("content_hash", F.lit(0)).cast("decimal(38,0)").alias("content_hash"),
        F.lit(generated_at).alias("generated_at_utc"),
    )


def manifest_total(manifest: DataFrame) -> DataFrame:
    return manifest.agg(
        F.count(F.lit(1)).alias("files"),
        F.sum("size_bytes").alias("size_bytes"),
        F.sum("row_count").alias("row_count"),
        F.sum("content_hash").alias("content_hash"),
    )


def search_json(hits: DataFrame, id_col: str = "request_id") -> DataFrame:
    """One JSON array of records per request; a request has at most 200 hits."""
    record = F.struct(*S.ADDRESS_COLUMNS)
    hit = F.struct(F.col("position"), record.alias("record"))
    return hits.groupBy(id_col).agg(
        F.to_json(F.transform(F.array_sort(F.collect_list(hit)), lambda h: h["record"])).alias(
            "records"
        )
    )
