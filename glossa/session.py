"""Sessions, and tables that cut a lineage."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(name: str = "glossa", **conf: str) -> SparkSession:
    """A session with the settings that the engine expects; a cluster's own settings win."""
    builder = SparkSession.builder.appName(name).config("spark.sql.adaptive.enabled", "true").config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.skewJoin.enabled", "true")
    for key, value in conf.items():
        builder = builder.config(key.replace("_", "."), value)
    return builder.getOrCreate()


def settled(df: DataFrame) -> DataFrame:
    """df computed once and written to the shared checkpoint folder: later steps read it, lost executors don't matter."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a temporary one only in a local session where none is set."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="glossa-"))
    return spark.sparkContext.getCheckpointDir()


#: Deletes the shuffle files of a query when it ends, not when the driver's garbage happens to be collected.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, by: str | None = None, **conf: str) -> DataFrame:
    """df computed once, as compressed Parquet in the shared checkpoint folder: smaller than settled(), without its shuffles.

    by: a column, the last one, each of whose values gets a folder, so that a filter on it reads no other rows. conf:
    settings of the session while df is computed. Rows come back in no order.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/glossa-stored/{uuid.uuid4().hex}"
    conf = {CLEANUP: "true", **conf}
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        df.write.option("compression", "zstd").parquet(path, partitionBy=by)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def forget(*tables: DataFrame) -> None:
    """Delete tables of stored() that nothing reads any more."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t.stored_at)
        path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
