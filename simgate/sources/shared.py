"""Tables written once in the folder that the driver and all executors share, and read again."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from simgate.operators.guards import require


#: Folders of the tables of runs that are under way.
_scopes: list[list[str]] = []


def folder_of(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; without it only a session on one machine has a folder of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    master = spark.sparkContext.master
    require(bool(folder) or master == "local" or master.startswith("local["), "set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (folder or f"file://{tempfile.gettempdir()}/simgate-tables").rstrip("/")


def kept(df: DataFrame, name: str) -> DataFrame:
    """The rows of df, worked out once: later uses read the table, also after an executor is lost."""
    path = f"{folder_of(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Tables that ``kept`` writes inside are deleted at the end, whatever happens: for runs that have shown or stored all they give."""
    _scopes.append([])
    try:
        yield
    finally:
        for folder in _scopes.pop():
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def published(spark: SparkSession, folder: str, write: Callable[[str], object]) -> object:
    """What ``write`` returns, which writes into a new hidden folder beside this one; it takes the folder's place when it is whole.

    A run that stops before that leaves the folder as it was. What stood there is put aside first and deleted last, so
    that for a moment there may be no folder, but never a half of the old and a half of the new one.
    """
    parent, _, name = folder.rstrip("/").rpartition("/")
    mark = uuid.uuid4().hex
    hidden = lambda what: f"{parent}/.{name}.{what}-{mark}" if parent else f".{name}.{what}-{mark}"
    path = spark._jvm.org.apache.hadoop.fs.Path
    place, new, old = path(folder.rstrip("/")), path(hidden("new")), path(hidden("old"))
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    try:
        out = write(hidden("new"))
        if files.exists(place):
            require(files.rename(place, old), f"{folder} cannot be replaced")
        if not files.rename(new, place):
            if files.exists(old):
                files.rename(old, place)
            require(False, f"{folder} cannot be written")
        files.delete(old, True)
        return out
    finally:
        files.delete(new, True)
