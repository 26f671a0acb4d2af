"""Tables written to the folder that driver and executors share, to cut lineage between rounds."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; a folder of this machine where it names none and all tasks run here (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="spark-stage-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Staged folders of each shared one, that clear() of a session with that folder deletes.
_MADE: dict[str, list[str]] = {}


def new_path(spark: SparkSession, label: str) -> str:
    shared = shared_dir(spark)
    path = f"{shared}/{label}-{uuid.uuid4().hex}"
    _MADE.setdefault(shared, []).append(path)
    return path


def clear(spark: SparkSession) -> None:
    """Deletes what this process has staged in the session's shared folder, once results that read it have been written."""
    conf, made = spark.sparkContext._jsc.hadoopConfiguration(), _MADE.get(shared_dir(spark), [])
    while made:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(made.pop())
        path.getFileSystem(conf).delete(path, True)


#: Lets Spark delete a query's shuffle files as soon as it has ended.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def lean(spark: SparkSession) -> Iterator[None]:
    """Shuffles of what is written meanwhile go when it has been written, not when the driver collects its garbage."""
    before = spark.conf.get(CLEAN_UP, "false")
    spark.conf.set(CLEAN_UP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEAN_UP, before)


def stage(df: DataFrame, label: str, made: list[str] | None = None) -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts the lineage and survives the loss of executors. Adds the folder to
    made, for drop()."""
    spark, path = df.sparkSession, new_path(df.sparkSession, label)
    with lean(spark):
        df.write.parquet(path)
    if made is not None:
        made.append(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(spark: SparkSession, paths: list[str]) -> None:
    """Deletes staged folders that nothing reads any more."""
    conf, made = spark.sparkContext._jsc.hadoopConfiguration(), _MADE.get(shared_dir(spark), [])
    for p in paths:
        made.remove(p)
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(conf).delete(path, True)
