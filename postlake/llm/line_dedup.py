"""Dropping lines that many documents share, over levelled sorted runs, in DataFrame
operations alone.

Documents arrive in batches.  What is known of the lines seen so far lies in runs: tables of
line hashes that are bucketed and sorted by the hash, none of which occurs in two runs.  A new
batch counts its own lines, merge-anti-joins them with the runs and adds the unseen ones as a
run of its own; those seen before are only noted.  Runs of one level are merged into one of the
next level when there are enough of them, so a batch meets few runs however many came before.
"""

from __future__ import annotations

import string
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postlake.llm.frames import WHITE, brief_shuffles, fresh, sized, written
from postlake.operators.skew import BROADCAST_ROWS, lookup_join
from postlake.session import discard, scratch_path

#: Batches that a table of documents is taken in, and runs of a level that are merged into one.
BATCHES = 6
FANOUT = 3
#: Dropped lines whose places are broadcast to the documents; beyond, the documents shuffle.
PLACES = 2_000_000


def line_key(line: Column) -> Column:
    """``line`` without ASCII white space at its ends and with A-Z in lower case."""
    bare = F.btrim(line, F.lit(WHITE))
    plain = F.octet_length(bare) == F.length(bare)
    other = F.translate(bare, string.ascii_uppercase, string.ascii_lowercase)
    return F.when(plain, F.lower(bare)).otherwise(other)


def _lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def long_lines(docs: DataFrame, min_points: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, raw (the text's hash), place (from 0) and hash of every line whose key has at
    least ``min_points`` code points."""
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.xxhash64(F.col(text_col)).alias("raw"),
        F.posexplode(_lines_of(F.col(text_col))).alias("place", "line"),
    )
    rows = rows.withColumn("key", line_key(F.col("line"))).filter(F.length("key") >= min_points)
    return rows.select("doc_id", "raw", "place", F.unhex(F.md5("key")).alias("hash"))


class LineRuns:
    """What is known of the lines of all batches so far.

    A run has a row per line hash: n_docs and last_doc, the number of documents and the largest
    id in the batch that brought it.  Later batches leave a row in ``noted`` instead.  Tables are
    bucketed by the hash into as many buckets as Spark shuffles into, so no run is ever
    shuffled to meet a batch.
    """

    def __init__(self, spark: SparkSession, fanout: int = FANOUT):
        self.spark, self.fanout = spark, fanout
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []
        self.batches: list[str] = []
        self.paths: dict[str, str] = {}

    @contextmanager
    def _settings(self) -> Iterator[None]:
        """One file per bucket when writing, and its order used when reading."""
        wanted = {
            "spark.sql.adaptive.coalescePartitions.enabled": "false",
            "spark.sql.legacy.bucketedTableScan.outputOrdering": "true",
            "spark.sql.sources.bucketing.autoBucketedScan.enabled": "false",
        }
        before = {k: self.spark.conf.get(k, None) for k in wanted}
        for k, v in wanted.items():
            self.spark.conf.set(k, v)
        try:
            with brief_shuffles(self.spark):
                yield
        finally:
            for k, v in before.items():
                if v is None:
                    self.spark.conf.unset(k)
                else:
                    self.spark.conf.set(k, v)

    def _save(self, rows: DataFrame, *by: str) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        self.paths[name] = scratch_path(self.spark, name)
        writer = rows.write.format("parquet").option("path", self.paths[name])
        if by:
            writer = writer.partitionBy(*by)
        writer.bucketBy(self.buckets, "hash").sortBy("hash").saveAsTable(name)
        return name

    def _run(self, name: str) -> DataFrame:
        """The rows of a run; of a batch's table, those that no earlier run had."""
        rows = self.spark.table(name)
        if "known" in rows.columns:
            rows = rows.filter("NOT known")
        return rows.select("hash", "n_docs", "last_doc")

    def runs(self) -> list[DataFrame]:
        return [self._run(name) for level in self.levels for name in level]

    def add(self, lines: DataFrame) -> None:
        """Take in a batch: rows of ``doc_id`` and ``hash``, any number of them per document.

        A document's lines must all come in one batch.  Rows without an id are one document.
        """
        once = lines.groupBy("hash", "doc_id").agg(F.lit(1).alias("one"))
        own = once.groupBy("hash").agg(
            F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("last_doc")
        )
        with self._settings():
            known = F.lit(False)
            for k, run in enumerate(self.runs()):
                mark = run.select("hash", F.lit(True).alias(f"in_{k}")).hint("merge")
                own, known = own.join(mark, "hash", "left"), known | F.coalesce(f"in_{k}", F.lit(False))
            own = own.select("hash", "n_docs", "last_doc", known.alias("known"))
            name = self._save(own, "known")
            self.batches.append(name)
            self.levels = self.levels or [[]]
            self.levels[0].append(name)
            self._compact()

    def _compact(self) -> None:
        """Merge the runs of every level that is full into one run of the next."""
        depth = 0
        while depth < len(self.levels) and len(self.levels[depth]) >= self.fanout:
            merged = reduce(DataFrame.unionByName, map(self._run, self.levels[depth]))
            name = self._save(merged.repartition(self.buckets, "hash"))
            gone, self.levels[depth] = self.levels[depth], []
            if depth + 1 == len(self.levels):
                self.levels.append([])
            self.levels[depth + 1].append(name)
            self._drop([n for n in gone if n not in self.batches])
            depth += 1

    def noted(self) -> DataFrame:
        """hash, n_more and last_more: what batches said of lines that a run already had."""
        known = [self.spark.table(n).filter("known") for n in self.batches]
        rows = reduce(DataFrame.unionByName, known)
        return rows.groupBy("hash").agg(
            F.sum("n_docs").alias("n_more"), F.max("last_doc").alias("last_more")
        )

    def common(self, min_docs: int) -> DataFrame:
        """hash and last_doc of the lines of at least ``min_docs`` documents, written."""
        with self._settings():
            noted = written(self.noted(), "lines-noted")
            found = []
            for run in self.runs():
                both = run.join(noted, "hash", "left").filter(
                    F.col("n_docs") + F.coalesce("n_more", F.lit(0)) >= min_docs
                )
                found.append(both.select("hash", F.greatest("last_doc", "last_more").alias("last_doc")))
            return written(reduce(DataFrame.unionByName, found), "lines-common")

    def _drop(self, names: list[str]) -> None:
        for name in names:
            table = self.spark.table(name)
            self.spark.sql(f"DROP TABLE {name}")
            table.scratch = self.paths.pop(name)
            discard(table)

    def close(self) -> None:
        """Delete all runs; what ``common`` returned stays."""
        self._drop(list(self.paths))


def _batched(lines: DataFrame, batches: int) -> str:
    """Write ``lines`` by batch and return the path; all rows of an id share a batch."""
    path = scratch_path(lines.sparkSession, "lines")
    number = F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int")
    lines.withColumn("batch", number).write.partitionBy("batch").parquet(path)
    return path


def _kept(lines: Column, places: Column) -> Column:
    """``lines`` without those at ``places`` (sorted, from 0), in time linear in both."""
    size = F.size(lines)
    low = F.concat(F.array(F.lit(0)), F.transform(places, lambda p: p + 1))
    high = F.concat(places, F.array(size))
    gaps = F.zip_with(low, high, lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    return F.flatten(F.transform(gaps, lambda g: F.slice(lines, g["a"] + 1, g["b"] - g["a"])))


def without_common_lines(
    docs: DataFrame,
    min_points: int = 20,
    min_docs: int = 3,
    id_col: str = "doc_id",
    text_col: str = "text",
    batches: int = BATCHES,
    fanout: int = FANOUT,
) -> DataFrame:
    """``docs`` without the lines that at least ``min_docs`` documents share, which stay in the
    document with the largest id alone; then ``n_lines`` (before) and ``n_dropped``.  Names that
    ``docs`` has already get a trailing underscore.

    Lines are equal if their keys are (``line_key``); shorter keys than ``min_points`` code
    points stay.  Texts are split at line feeds; a null or empty text is one empty line and a
    null stays null.  Rows that repeat an id are one document, whose rows share every verdict;
    rows without an id are one document too, smaller than all others.  An empty table gives an
    empty result.
    """
    spark = docs.sparkSession
    path = _batched(long_lines(docs, min_points, id_col, text_col), batches)
    schema = f"doc_id {docs.schema[id_col].dataType.simpleString()}, raw long, place int, hash binary, batch int"
    lines = spark.read.schema(schema).parquet(path)
    store = LineRuns(spark, fanout)
    for b in range(batches):
        store.add(lines.filter(F.col("batch") == b).select("doc_id", "hash"))
    common = store.common(min_docs)
    store.close()
    hits = lookup_join(lines, common, ["hash"], spread_by=F.xxhash64("doc_id", "place"), bound=common)
    hits = hits.filter(~F.col("doc_id").eqNullSafe(F.col("last_doc")))
    places = F.sort_array(F.collect_set("place")).alias("places")
    places = written(hits.groupBy("doc_id", "raw").agg(places), "lines-places")
    lines.scratch = path
    discard(lines, common)
    names = list(docs.columns)
    own = {}
    for n in ("n_lines", "n_dropped", "doc_id", "raw", "places"):
        own[n] = fresh(names, n)
        names.append(own[n])
    found = places.select("doc_id", "raw", "places").toDF(own["doc_id"], own["raw"], own["places"])
    if (places.agg(F.sum(F.size("places"))).first()[0] or 0) <= PLACES:
        found = sized(found, BROADCAST_ROWS)
    same = docs[id_col].eqNullSafe(F.col(own["doc_id"])) & (F.xxhash64(docs[text_col]) == F.col(own["raw"]))
    rows = docs.join(found, same, "left")
    gone = F.coalesce(own["places"], F.array().cast("array<int>"))
    # bound to a name, so that the text is split once
    whole = F.transform(F.array(_lines_of(docs[text_col])), lambda x: F.array_join(_kept(x, gone), "\n"))
    text = F.when(F.size(gone) == 0, docs[text_col]).otherwise(whole[0])
    return rows.select(
        *[text.alias(c) if c == text_col else docs[c] for c in docs.columns],
        F.size(_lines_of(docs[text_col])).cast("long").alias(own["n_lines"]),
        F.size(gone).cast("long").alias(own["n_dropped"]),
    )


def digests(kept: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped and kept_sha256 of what ``without_common_lines`` returned."""
    digest = F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256")
    return kept.select("doc_id", "n_lines", "n_dropped", digest)
