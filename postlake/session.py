"""Session settings and the shared folder for materialised intermediates."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Spark only accepts the feed's code page under this switch.
    "spark.sql.legacy.javaCharsets": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app_name: str = "postlake", **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it in
    ``spark.checkpoint.dir``.

    Only a session whose executors are threads of the driver may fall back to a temporary
    one.  Elsewhere a folder that is sure to be local to a machine is refused.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    one_machine = re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master)
    if folder is None:
        if not one_machine:
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        folder = tempfile.mkdtemp(prefix="postlake-")
        spark.conf.set("spark.checkpoint.dir", folder)
    own = {tempfile.gettempdir(), "/tmp", "/var/tmp"}
    if not one_machine and "/" + re.sub(r"^file:", "", folder).strip("/") in own:
        raise RuntimeError(f"spark.checkpoint.dir is {folder}, which is local to each machine")
    return folder.rstrip("/")


#: Paths handed out and not yet deleted, by application.
_scratch: dict[str, set[str]] = {}


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; ``release`` deletes it."""
    path = f"{shared_folder(spark)}/postlake/{name}-{uuid.uuid4().hex}"
    _scratch.setdefault(spark.sparkContext.applicationId, set()).add(path)
    return path


def delete(spark: SparkSession, path: str) -> None:
    jvm, context = spark.sparkContext._jvm, spark.sparkContext._jsc
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(context.hadoopConfiguration()).delete(at, True)
    _scratch.get(spark.sparkContext.applicationId, set()).discard(path)


def release(spark: SparkSession) -> None:
    """Delete all intermediates of this application.  Call it when the results that were
    computed from them are written; lazy results cannot be read afterwards."""
    for path in sorted(_scratch.get(spark.sparkContext.applicationId, ())):
        delete(spark, path)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the plan is cut, the rows are
    fixed, and losing an executor costs nothing that was already computed."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete what ``materialise`` wrote for ``frames``, once all that was computed from them
    is written too."""
    for df in frames:
        delete(df.sparkSession, df.scratch)


def empty(spark: SparkSession, schema: T.StructType) -> DataFrame:
    return spark.range(0).select(
        *[F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields]
    )
