"""Tables written between steps: a plan starts anew at each, and a lost executor costs one step at most."""

from __future__ import annotations

import tempfile
import threading
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


#: The stand-in folder of this process, once made.
_LOCAL: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which driver and executors share. Where it is unset, a local master gets a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _LOCAL:
            _LOCAL.append("file://" + tempfile.mkdtemp(prefix="spark-shared-"))
        found = _LOCAL[0]
    return found.rstrip("/")


_open = threading.local()


def _path(spark: SparkSession, path: str):
    """A Hadoop path and its file system."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


@contextmanager
def scope(spark: SparkSession):
    """Tables that ``cut`` writes inside are deleted at its end: results that read them must be written by then. Scopes nest; each thread has its own."""
    held = _open.__dict__.setdefault("scopes", [])
    held.append([])
    try:
        yield
    finally:
        for path in held.pop():
            place, system = _path(spark, path)
            system.delete(place, True)


def cut(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it back."""
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    scopes = _open.__dict__.get("scopes")
    if scopes:
        scopes[-1].append(path)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def marked(spark: SparkSession, path: str) -> bool:
    """Whether ``mark`` has been left at a path."""
    place, system = _path(spark, path)
    return system.exists(place)


def mark(spark: SparkSession, path: str) -> None:
    """An empty file that says that what it names is whole."""
    place, system = _path(spark, path)
    system.create(place, True).close()
