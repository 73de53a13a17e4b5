"""Tables written to the folder that all executors share, to cut lineage so that it survives lost executors."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

#: Rows of a task of a shuffle, so that what it sorts and hashes stays in its memory however large the input is.
ROWS_PER_TASK = 250_000

_own: list[str] = []
_written: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; on one machine, as in tests, a folder of our own where that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="cairn-"))
        atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
    return "file://" + _own[0]


def spread(df: DataFrame, rows: int, *keys: str, most: int = ROWS_PER_TASK) -> DataFrame:
    """df dealt by keys over tasks of about ``most`` rows, of which it has ``rows``.

    The number of tasks is always given: Spark merges partitions of an exchange without one by their compressed bytes,
    however many rows these hold.
    """
    return df.repartition(tasks_for(df.sparkSession, rows, most), *keys)


def tasks_for(spark: SparkSession, rows: int, most: int = ROWS_PER_TASK) -> int:
    """Tasks for so many rows: one for each core, more where those would hold more than ``most``."""
    return max(spark.sparkContext.defaultParallelism, -(-rows // most))


def materialize(df: DataFrame, name: str, compression: str = "snappy", rows: int | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder, read again.

    With ``rows``, the most that df can have, no more tasks write files than these ask for, however many partitions a
    shuffle has. That is for a df that ends in an aggregate or distinct(), whose partitions are even.
    """
    df = df if rows is None else df.coalesce(tasks_for(df.sparkSession, rows))
    path = f"{shared_dir(df.sparkSession)}/cairn-{name}-{uuid.uuid4().hex[:12]}"
    df.write.option("compression", compression).parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    _written[table] = path
    return table


def release(*tables: DataFrame) -> None:
    """Empties tables of materialize() that nothing reads any more; other DataFrames are let alone."""
    for table in tables:
        path = _written.pop(table, None)
        if path:
            table.sparkSession.createDataFrame([], table.schema).write.mode("overwrite").parquet(path)
