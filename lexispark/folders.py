"""Folders that the driver and all executors share.

``spark.checkpoint.dir`` names the shared folder. Only where it is unset on a local
master (tests, a single machine) is a folder of our own made, and then it is used as if it had been set.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def shared_root(spark: SparkSession) -> str:
    """The fully qualified shared folder, without a slash at its end."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="lexispark-"))
            atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
        folder = f"file://{_own[0]}"
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    full = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    if full.startswith("file:/") and not full.startswith("file://"):
        full = "file://" + full[len("file:") :]
    return full.rstrip("/")


def new_folder(spark: SparkSession, label: str) -> str:
    """A folder name in the shared folder that nothing else uses."""
    return f"{shared_root(spark)}/lexispark/{label}-{uuid.uuid4().hex}"


def delete_folders(spark: SparkSession, *folders: str) -> None:
    """Deletes folders or files that no later plan reads."""
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Spark's setting for shuffle files to be removed when the query that made them ends.
CLEANED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: Spark's setting for how many files a task writes side by side, where its rows would be sorted by folder otherwise.
SIDE_BY_SIDE = "spark.sql.maxConcurrentOutputFileWriters"


@contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """A setting of Spark's for what runs inside; what it was before holds again behind it."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def written(df: DataFrame, folder: str) -> DataFrame:
    """Writes a table at ``folder`` and reads it back; the shuffle files behind it go at once, not when the driver next collects garbage."""
    with setting(df.sparkSession, CLEANED, "true"):
        df.write.mode("overwrite").option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
