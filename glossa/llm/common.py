"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import re
import tempfile
import threading
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the contracts: space and the ASCII controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D]+"

#: Rows and bytes of one Arrow batch sent to Python, whichever is met first. A document may hold 100 kB or more.
ARROW_ROWS, ARROW_BYTES = "500", str(16 << 20)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder, whatever file system it is in."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def short_batches(spark: SparkSession) -> None:
    """Bound the memory that one Arrow batch of texts can take in a Python worker.

    A batch's limits are read when a plan runs, after the operator has returned it, so they stay set; limits that
    the session has set lower are kept.
    """
    for key, most in (("maxRecordsPerBatch", ARROW_ROWS), ("maxBytesPerBatch", ARROW_BYTES)):
        now = spark.conf.get(f"spark.sql.execution.arrow.{key}", None)
        digits = re.sub("[^0-9]", "", now or "")
        if not digits or now != digits or not 0 < int(digits) <= int(most):
            spark.conf.set(f"spark.sql.execution.arrow.{key}", most)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares (spark.checkpoint.dir); one of our own only in a local session without one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    found = found or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="glossa-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


class _Run(threading.local):
    """The folder of this thread's tables: no other thread, job or driver writes there or deletes it."""

    def __init__(self):
        self.name = uuid.uuid4().hex


_RUN = _Run()


def run_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/glossa-tables/{_RUN.name}"


#: Deletes the shuffle files of a query when it ends, not when the driver's garbage happens to be collected.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it again: a cut lineage that outlives executors."""
    spark = df.sparkSession
    path = f"{run_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")  # nobody reads the shuffles again
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def forget(*tables: DataFrame) -> None:
    """Delete tables of stored() that nothing reads any more."""
    for t in tables:
        delete(t.sparkSession, t.stored_at)


def delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def drop_stored(spark: SparkSession) -> None:
    """Delete the tables that stored() has written in this thread; only for callers whose results no longer read them."""
    delete(spark, run_dir(spark))
    _RUN.name = uuid.uuid4().hex


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once a row, however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text) -> F.Column:
    """Number of words of a text column; null counts as an empty text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def text_or_empty(name: str = "text") -> F.Column:
    return F.coalesce(F.col(name), F.lit(""))
