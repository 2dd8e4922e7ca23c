"""Token ids as Parquet list columns that can be read selectively.

Files hold documents in ascending id order, one row each.  The ids are a list column in
dictionary encoding, which falls back to plain pages where a row group has too many different
ids; the counts use the delta encoding of version 2 pages.  Row groups and pages have set sizes
and the writer adds page indexes, so a reader of one id range, or of the counts alone, touches
few pages and never the tokens of other documents.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from postlake.llm.encoding import encoder, slices
from postlake.llm.frames import brief_shuffles, sized, written

ROW_GROUP_BYTES = 16 << 20
PAGE_BYTES = 256 << 10
#: Documents per row group check; long documents must not swell a group unseen.
CHECK_ROWS = 16
#: Documents encoded at once.
BATCH = 256
COLUMNS = ["doc_id", "tokens", "n_tokens", "file_start"]


def encoded(
    docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, tokens (array of int, with the end id), n_tokens and file_start, in ascending
    order of the ids, one partition per id range.

    ``file_start`` counts the ids before a document in its own partition.  A null text is
    empty, a null id sorts before all others.  Texts are what is shuffled, being shorter than
    their ids; rows that repeat an id are ordered by their texts' hashes and may lie in
    several partitions.
    """
    tie = F.xxhash64("text")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType
    rows = rows.repartitionByRange("doc_id", tie).sortWithinPartitions("doc_id", tie)
    end = end_id.to_bytes(4, "little")

    def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer)
        done = 0
        for batch in batches:
            for k, part in enumerate(slices(batch["text"], BATCH)):
                packed = [own.encode(t) + end for t in part]
                counts = np.array([len(p) // 4 for p in packed], "i8")
                offsets = np.concatenate([[0], np.cumsum(counts)])
                flat = pa.array(np.frombuffer(b"".join(packed), "<i4"))
                arrays = [
                    batch["doc_id"].slice(k * BATCH, len(part)),
                    pa.ListArray.from_arrays(pa.array(offsets, "int32"), flat),
                    pa.array(counts.astype("i4")),
                    pa.array(done + offsets[:-1], "int64"),
                ]
                done += int(offsets[-1])
                yield pa.RecordBatch.from_arrays(arrays, COLUMNS)

    kinds = f"doc_id {kind.simpleString()}, tokens array<int>, n_tokens int, file_start long"
    return rows.mapInArrow(ids, kinds)


def write_tokens(rows: DataFrame, path: str) -> None:
    """Write what ``encoded`` made, a file per partition."""
    with brief_shuffles(rows.sparkSession):
        (
            rows.write.option("compression", "snappy")
            .option("parquet.writer.version", "v2")
            .option("parquet.block.size", ROW_GROUP_BYTES)
            .option("parquet.page.size", PAGE_BYTES)
            .option("parquet.block.size.row.check.min", CHECK_ROWS)
            .option("parquet.page.size.row.check.min", CHECK_ROWS)
            .option("parquet.enable.dictionary", "false")
            .option("parquet.enable.dictionary#tokens.list.element", "true")
            .parquet(path)
        )


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, tokens, n_tokens and ``start``, the number of ids in all files before a
    document, of what ``write_tokens`` wrote to ``path``.

    Starts come from one sum per file, so reading them touches no tokens.
    """
    part = F.regexp_extract(F.col("_metadata.file_name"), r"^part-(\d+)", 1).cast("long")
    rows = spark.read.parquet(path).withColumn("part", part)
    files = rows.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    line = Window.partitionBy().orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("part", F.coalesce(F.sum("n").over(line), F.lit(0)).alias("before"))
    start = (F.col("before") + F.col("file_start")).alias("start")
    return rows.join(sized(written(files, "token-starts")), "part").select(
        "doc_id", "tokens", "n_tokens", start
    )


def crc32_of(rows: DataFrame) -> DataFrame:
    """``rows`` with ``ids_crc32`` instead of ``tokens``: the unsigned crc32 of the ids as
    little-endian unsigned 32-bit integers."""
    kept = [c for c in rows.columns if c != "tokens"]
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in kept)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            crc = [zlib.crc32(ids.values.to_numpy().astype("<u4").tobytes()) for ids in batch["tokens"]]
            arrays = [*(batch[c] for c in kept), pa.array(crc, "int64")]
            yield pa.RecordBatch.from_arrays(arrays, [*kept, "ids_crc32"])

    return rows.mapInArrow(sums, f"{kinds}, ids_crc32 long")
