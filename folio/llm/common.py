"""What the operators of this subpackage share: shared-folder tables, table reading, small column helpers."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_KEY = "spark.checkpoint.dir"
_SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_written: list[tuple[SparkSession, str]] = []
_local_dirs: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table `name` below `sf_dir`, read by Spark (any Hadoop file system)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df over all cores: one that lies in fewer partitions (a small file) is dealt out, for operators that work hard on each row."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, local mode gets a new folder of
    its own (tests); a cluster gets a ValueError, as its executors would write to their own disks."""
    found = spark.conf.get(CHECKPOINT_KEY, None)
    if found:
        return found.rstrip("/")
    if not spark.conf.get("spark.master", "local").startswith("local"):
        raise ValueError(f"set {CHECKPOINT_KEY} to a folder that the driver and all executors share")
    app = spark.conf.get("spark.app.id", "")
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix="folio-shared-")
    return _local_dirs[app]


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder; what is still there when the driver ends is removed then."""
    path = f"{shared_dir(spark)}/folio/{label}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A session setting for the time of a block."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def shuffles_removed(spark: SparkSession):
    """A block whose actions leave no shuffle files: Spark removes those of an action when it ends."""
    return setting(spark, _SHUFFLE_CLEANUP, "true")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write `df` as Parquet to the shared folder and read it back: cuts the lineage and survives lost executors.

    Spark removes the step's shuffle files when it has been written. release() removes the table.
    """
    spark, schema = df.sparkSession, df.schema
    path = new_path(spark, label)
    with shuffles_removed(spark):
        df.write.parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out._written_at = path
    return out


def release(*tables: DataFrame | None) -> None:
    """Remove materialized tables that nothing reads any more; other frames are left alone."""
    for df in tables:
        path = getattr(df, "_written_at", None)
        if path:
            drop_path(df.sparkSession, path)
            _written[:] = [w for w in _written if w[1] != path]


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[DataFrame]]:
    """A block whose materialized tables are removed at its end, but for those put into the list it is given."""
    before, kept = {w[1] for w in _written}, []
    yield kept
    keep = before | {getattr(df, "_written_at", None) for df in kept}
    for path in [w[1] for w in _written if w[1] not in keep]:
        drop_path(spark, path)
    _written[:] = [w for w in _written if w[1] in keep]


def drop_path(spark: SparkSession, path: str) -> None:
    """Remove a path written by this run, by the Hadoop file system that holds it."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _drop_written() -> None:
    for spark, path in _written:
        try:
            drop_path(spark, path)
        except Exception:  # the session may be gone already; the folder then goes with the cluster
            return


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with `value` computed once per row, however often `body` names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Hand long texts to Python in batches of at most so many rows: a batch is held on both sides at once."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, rows)


def shuffle_width(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
