"""Cutting lineage in iterations, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

_made: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, else the folder given to setCheckpointDir; on a local master, which has no other machine, else a fresh one of its own.

    On a cluster that names neither, it raises: a folder of the driver's machine would not be the executors'.
    """
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="graphloom-"))
        found = context.getCheckpointDir()
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is written there is deleted by clear(), at the latest when the driver ends."""
    path = f"{shared_dir(spark)}/graphloom/{name}-{uuid.uuid4().hex}"
    _made[path] = spark
    return path


def written(df: DataFrame, name: str = "step", in_file: int = 0) -> DataFrame:
    """df as Parquet in the shared folder, read again: lineage is cut, and a lost executor loses nothing. in_file: rows in a file at most, 0 for any number."""
    path = fresh_path(df.sparkSession, name)
    df.write.option("maxRecordsPerFile", in_file).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def dropped(df: DataFrame) -> None:
    """Deletes a table as written() returned it; only for when no DataFrame over it is needed any more."""
    path, spark = df._written_at, df.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    _made.pop(path, None)


@contextmanager
def freed(spark: SparkSession) -> Iterator[None]:
    """Within, the shuffle files of a query go when it ends, not when the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def cached(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table at path; where there is none yet it is made and written first. A table cut short by a failure has no _SUCCESS and is made anew."""
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def clear() -> int:
    """Deletes every table that written() made and its number; only for when no DataFrame over one is needed any more."""
    n = 0
    for path, spark in list(_made.items()):
        del _made[path]
        try:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            n += at.getFileSystem(spark._jvm.org.apache.hadoop.conf.Configuration()).delete(at, True)
        except (Py4JError, OSError, AttributeError):  # the JVM has gone before
            break
    return n


atexit.register(clear)
