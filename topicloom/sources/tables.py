"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_FOLDERS: list[tuple[SparkSession, str]] = []

#: The folder of each local application that was given none.
_LOCAL: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, a new folder if driver and executors are one process, else an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: it names the folder that driver and executors share")
        name = spark.sparkContext.applicationId
        if name not in _LOCAL:
            _LOCAL[name] = "file://" + tempfile.mkdtemp(prefix="topicloom-")
            _FOLDERS.append((spark, _LOCAL[name]))
        root = _LOCAL[name]
    return root.rstrip("/")


def new_folder(spark: SparkSession, label: str) -> str:
    """A path that nothing has written to yet; it goes when the session ends, or with ``sweep``."""
    path = f"{shared_folder(spark)}/topicloom/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    _FOLDERS.append((spark, path))
    return path


def remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _clean() -> None:
    for spark, path in _FOLDERS:
        try:
            remove(spark, path)
        except Exception:  # the session has ended: its folder goes with the cluster's own cleaning
            pass


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once as a table in the shared folder and read back: its lineage ends there."""
    path = new_folder(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _bare(path: str) -> str:
    """A path without scheme and host: Spark names files in full, settings often don't."""
    return "/" + re.sub(r"^[A-Za-z][\w+.-]*:(//[^/]*)?", "", path).lstrip("/")


def _drop(folders: list[tuple[SparkSession, str]]) -> None:
    for entry in folders:
        remove(*entry)
        _FOLDERS.remove(entry)


def _holds(path: str, files: list[str]) -> bool:
    return any(_bare(f).startswith(_bare(path) + "/") for f in files)


def drop_table(df: DataFrame) -> None:
    """Removes a table of ``written`` that no later plan reads."""
    files = df.inputFiles()[:1]
    _drop([x for x in _FOLDERS if _holds(x[1], files)])


def mark() -> int:
    """A point in time for ``sweep``."""
    return len(_FOLDERS)


def sweep(since: int, keep: DataFrame) -> None:
    """Removes the tables written since ``mark`` gave ``since``, but for the one that ``keep`` reads."""
    files = keep.inputFiles()[:1]
    _drop([x for x in _FOLDERS[since:] if x[1] not in _LOCAL.values() and not _holds(x[1], files)])
