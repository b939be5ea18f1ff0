"""Named queries: a callable over logical tables, and its SQL for the oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from folio import adapters

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLES: dict[str, str] = {}


#: Bytes of texts that are handed to Python together, however many rows a table has.
BATCH_BYTES = 4 << 20


class Tables:
    """Logical tables of one data folder, by name."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getitem__(self, name: str) -> DataFrame:
        return adapters.logical(self.spark, self.sf_dir, name)

    def spread(self, name: str) -> DataFrame:
        """The table over all cores: one that lies in fewer partitions (a small file) is dealt out, for queries that work hard on each row.
        Python gets its texts in batches bounded by bytes, so a worker's memory doesn't grow with the table."""
        key = "spark.sql.execution.arrow.maxBytesPerBatch"
        if not 0 < int(self.spark.conf.get(key).removesuffix("b")) <= BATCH_BYTES:
            self.spark.conf.set(key, BATCH_BYTES)
        df, cores = self[name], self.spark.sparkContext.defaultParallelism
        return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def query(name: str, sql: str | None = None, *tables: str):
    """Register the decorated function of Tables; sql is its oracle over the logical tables named."""

    def register(f: Callable[[Tables], DataFrame]):
        _QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql is not None:
            _ORACLES[name] = adapters.oracle(sql, *tables) if tables else sql
        return f

    return register


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracles() -> dict[str, str]:
    return dict(_ORACLES)
