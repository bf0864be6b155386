"""Shared scratch tables: lineage is cut through files that every executor can read."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; a temporary one only where the session names none (tests)."""
    return spark.conf.get("spark.checkpoint.dir", None) or _own_folder(spark)


_OWN: dict[str, str] = {}


def _own_folder(spark: SparkSession) -> str:
    app = spark.sparkContext.applicationId
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="echofind-")
    return _OWN[app]


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of any file system that Spark knows."""
    with contextlib.suppress(Exception):  # the session may have ended already
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    The result has no lineage but those files, so a lost executor costs a reread and no
    recomputation.  The files go when the driver ends.
    """
    spark = df.sparkSession
    path = f"{folder(spark).rstrip('/')}/echofind-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows and bytes of a batch that goes to a Python worker; the defaults hold tens of megabytes of text on both sides.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def modest(spark: SparkSession) -> None:
    """Lower the session's batch size for Python workers to what texts of any length need; a lower one stays."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = int(re.sub("[^0-9]", "", spark.conf.get(key)) or 0)
        if not 0 < now <= most:
            spark.conf.set(key, str(most))
