"""Where derived tables are kept: a folder that driver and executors share, and the few file operations on it."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"
_local: dict[str, str] = {}
_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; in local mode, where it is unset, one new folder for each application. A cluster must have it set."""
    found = spark.conf.get(CHECKPOINT_KEY, None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_KEY} to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local:
        _local[app] = tempfile.mkdtemp(prefix="folio-")
    return _local[app]


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder, which is removed when the driver ends."""
    path = f"{shared_dir(spark)}/folio/{label}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def _file_system(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder, in any Hadoop file system."""
    fs, target = _file_system(spark, path)
    return fs.exists(target)


def remove(spark: SparkSession, path: str) -> None:
    """Remove a file or folder."""
    fs, target = _file_system(spark, path)
    fs.delete(target, True)


@atexit.register
def _clear() -> None:
    for spark, path in _made:
        try:
            remove(spark, path)
        except Exception:  # the session has ended; what it shared goes with the cluster
            break
    for path in _local.values():
        shutil.rmtree(path, ignore_errors=True)
