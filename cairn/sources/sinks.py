"""Sinks and layouts of tables."""

from __future__ import annotations

import gzip
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.sources.bounded import filesystem
from cairn.sources.state_table import StateTable


def write_parquet_table(df: DataFrame, path: str, epoch: str = "epoch", mode: str = "append", max_rows: int | None = None) -> None:
    """SNAPPY Parquet by epoch; overwriting replaces only the epochs that df has."""
    writer = df.write.mode(mode).option("compression", "snappy").option("partitionOverwriteMode", "dynamic").partitionBy(epoch)
    (writer.option("maxRecordsPerFile", max_rows) if max_rows else writer).parquet(path)


def write_cut_files(rows: DataFrame, path: str, epoch: str = "epoch", file: str = "file") -> None:
    """Rows that rolling_cut() has cut, a folder for each epoch and in it one Parquet file for each cut file, named by its number.

    A file's rows meet in one task, which writes it by pyarrow.fs: with a folder for each file, commit and listing would take
    as many folders one after the other. A write that is tried again puts the same files in place. epoch is read from the folder's name.
    """

    def put(key: tuple[int, int], parts: list[pa.RecordBatch]) -> None:
        at, where = filesystem(f"{path}/{epoch}={key[0]}")
        at.create_dir(where, recursive=True)
        pq.write_table(pa.Table.from_batches(parts).drop_columns([epoch]), f"{where}/{key[1]}.parquet", filesystem=at, compression="snappy")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, open_file, parts = 0, None, []
        for batch in batches:
            epochs, numbers = batch[epoch].to_numpy(), batch[file].to_numpy()
            edges = [0, *(np.flatnonzero((np.diff(epochs) != 0) | (np.diff(numbers) != 0)) + 1).tolist(), batch.num_rows]
            for first, end in zip(edges[:-1], edges[1:], strict=True):
                if first == end:
                    continue
                key = int(epochs[first]), int(numbers[first])
                if parts and key != open_file:
                    put(open_file, parts)
                    files, parts = files + 1, []
                open_file = key
                parts.append(batch.slice(first, end - first))
        if parts:
            put(open_file, parts)
            files += 1
        yield pa.RecordBatch.from_arrays([pa.array([files], pa.int64())], names=["files"])

    rows.repartition(epoch, file).sortWithinPartitions(epoch, file).mapInArrow(write, "files long").agg(F.sum("files")).collect()


def write_record_files(records: DataFrame, path: str, seq: str = "seq") -> None:
    """Records, of each number one, as compressed JSON lines in a folder for each number, as partitionBy() lays them out.

    The task that has a record writes its file by pyarrow.fs: a Spark job's commit moves one folder after the other on the
    driver, however many tasks wrote them. A write that is tried again puts the same files in place.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, where = filesystem(path)
        files = 0
        for batch in batches:
            for n, line in zip(batch["seq"].to_pylist(), batch["line"], strict=True):
                folder = f"{where}/seq={n}"
                at.create_dir(folder, recursive=True)
                with at.open_output_stream(f"{folder}/part-0.json.gz", compression=None) as file:
                    file.write(gzip.compress(line.as_py().encode() + b"\n", 3, mtime=0))
                files += 1
        yield pa.RecordBatch.from_arrays([pa.array([files], pa.int64())], names=["files"])

    line = F.to_json(F.struct(*[c for c in records.columns if c != seq]))
    records.select(F.col(seq).cast("long").alias("seq"), line.alias("line")).mapInArrow(write, "files long").agg(F.sum("files")).collect()


def write_csv_table(df: DataFrame, path: str, epoch: str | None = None, mode: str = "append") -> None:
    """CSV with | between fields and no header."""
    writer = df.write.mode(mode).option("sep", "|").option("header", False)
    (writer.partitionBy(epoch) if epoch else writer).csv(path)


def bucketed(df: DataFrame, epoch: str = "epoch", width: int = 10, cluster: list[str] | None = None) -> DataFrame:
    """epoch_bucket, the first epoch of each run of ``width``, with rows sorted by the cluster keys inside partitions."""
    out = df.withColumn("epoch_bucket", F.col(epoch) - F.col(epoch) % width)
    return out.sortWithinPartitions(*cluster) if cluster else out


def write_bucketed(df: DataFrame, path: str, epoch: str = "epoch", width: int = 10, cluster: list[str] = ["checkpoint_sequence_number"]) -> None:  # noqa: B006
    """A folder for each bucket of epochs, and in it files that each hold a range of the cluster keys, in their order.

    A filter on the bucket prunes folders, one on the keys prunes files and row groups by their statistics.
    """
    out = bucketed(df, epoch, width)
    out.repartitionByRange("epoch_bucket", *cluster).sortWithinPartitions("epoch_bucket", *cluster).write.mode("append").partitionBy("epoch_bucket").parquet(path)


def read_bucketed(spark: SparkSession, path: str, schema: str, low: int, high: int, epoch: str = "epoch", width: int = 10) -> DataFrame:
    """The rows of epochs from low to high, from the folders that can hold them."""
    rows = spark.read.schema(f"{schema}, epoch_bucket long").parquet(path)
    return rows.where(F.col("epoch_bucket").between(low - low % width, high - high % width) & F.col(epoch).between(low, high)).drop("epoch_bucket")


def epoch_of_checkpoint(df: DataFrame, epochs: DataFrame, checkpoint: str = "checkpoint", width: int = 100) -> DataFrame:
    """Rows with the epoch whose range of checkpoints holds them; an open epoch has a null end."""
    from cairn.operators.joins import range_lookup

    last = epochs.agg(F.max("first_checkpoint_id").alias("f"), F.max("last_checkpoint_id").alias("l"))
    closed = epochs.crossJoin(F.broadcast(last)).withColumn("last_checkpoint_id", F.coalesce("last_checkpoint_id", F.greatest("f", "l") + 10 * width)).drop("f", "l")
    return range_lookup(df, closed, checkpoint, "first_checkpoint_id", "last_checkpoint_id", width)


def fanout(checkpoints: DataFrame, tables: dict[str, Callable[[DataFrame], DataFrame]], keys: dict[str, list[str]]) -> dict[str, DataFrame]:
    """Keyed tables of one batch, of each key one row. Equal keys hold equal rows in a ledger, so any one will do."""
    return {name: make(checkpoints).dropDuplicates(keys[name]) for name, make in tables.items()}


def summary_by_both_keys(checkpoints: DataFrame) -> DataFrame:
    """Checkpoint summaries under two keys, sequence number and digest."""
    key = lambda c: checkpoints.select(F.col(f"summary.{c}").cast("string").alias("key"), "summary")
    return key("sequence_number").unionByName(key("digest"))


def snapshot_buckets(objects: DataFrame, key: str, buckets: int) -> DataFrame:
    """A bucket by hash for each object."""
    return objects.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))


def write_snapshot(objects: DataFrame, path: str, epoch: int, key: str, buckets: int, max_rows: int = 1_000_000) -> DataFrame:
    """The live objects of an epoch by bucket, and its manifest: a row for each file with rows and SHA-256 of the content."""
    spark = objects.sparkSession
    dealt = snapshot_buckets(objects, key, buckets).withColumn("epoch", F.lit(epoch))
    # Each bucket may be written by several tasks: a second key spreads a large one.
    spread = dealt.repartition(F.col("bucket"), F.pmod(F.hash(key), F.lit(4)))
    spread.write.mode("append").option("maxRecordsPerFile", max_rows).option("partitionOverwriteMode", "dynamic").partitionBy("epoch", "bucket").parquet(path)
    return manifest(spark, f"{path}/epoch={epoch}")


def fold_snapshot_files(table: StateTable, batch: int, changed: DataFrame, key: str, status: str = "object_status") -> DataFrame:
    """The next snapshot of live objects from those that changed, and its manifest: bucket, version (the batch that wrote it) and file.

    Only buckets with changed objects are written; the others' files are those of earlier snapshots, which stay readable. A
    batch's files are digested once; their manifest is kept beside them, with a row for each bucket in a file.
    """
    live = lambda old, new: old.join(new, key, "left_anti").unionByName(new.where(F.col(status) == 0).select(*old.columns))
    listed = f"{table.path}/manifests"
    if table.merge(batch, changed, live):
        inside = lambda c: F.regexp_extract(c, "/(batch=[^/]*/[^/]*/[^/]*)$", 1).alias("inside")
        held = table.data([batch]).select(F.col("__bucket").alias("bucket"), F.col("__version").alias("version"), inside(F.col("__file"))).distinct()
        files = manifest(table.spark, f"{table.path}/data/batch={batch}").withColumn("inside", inside(F.col("file")))
        held.join(files, "inside").drop("inside").coalesce(8).write.mode("overwrite").parquet(f"{listed}/batch={batch}")
    versions = table.last(batch)
    batches = sorted(r[0] for r in versions.select("version").distinct().collect())
    schema = "bucket long, version long, file string, length long, digest string"
    found = table.spark.read.schema(schema).parquet(*[f"{listed}/batch={b}" for b in batches]) if batches else table.spark.createDataFrame([], schema)
    return versions.join(found, ["bucket", "version"])


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """File, length and SHA-256 of each Parquet file below a path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path)
    return files.select(F.col("path").alias("file"), "length", F.sha2("content", 256).alias("digest"))


def dump_packages(packages: DataFrame, path: str) -> None:
    """A directory for each package and version with its modules, linkage and origins as JSON."""
    packages.write.mode("append").partitionBy("package_id", "package_version").json(path)


def events_to_json(events: DataFrame, id_column: str, columns: list[str]) -> DataFrame:
    """Id and the decoded columns as one JSON text."""
    return events.select(F.col(id_column).alias("id"), F.to_json(F.struct(*columns)).alias("json"))


def commit_batch(tables: dict[str, DataFrame], paths: dict[str, str], marker: str, batch_id: int, last: int | Callable[[], int] | None = None, checked: bool = False) -> bool:
    """Writes the tables of a batch, and its marker last; a batch whose marker is there is not written again.

    Each batch has a directory of its own, which a repeated try overwrites, so that a batch counts once. The marker has
    the batch and, if given, the last checkpoint in it, which a function may give once the tables are written. ``checked``
    says that the caller knows the batch to have no marker.
    """
    spark = next(iter(tables.values())).sparkSession
    done = f"{marker}/batch={batch_id}"
    if not checked and _exists(spark, done):
        return False
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{paths[name]}/batch={batch_id}")
    number = last() if callable(last) else last
    spark.range(0, 1, 1, 1).select(F.lit(batch_id).cast("long").alias("batch_id"), F.lit(number).cast("long").alias("last")).write.mode("overwrite").parquet(done)
    return True


def _exists(spark: SparkSession, path: str) -> bool:
    """Whether a table was written there to its end: its files come into view when the job is over."""
    try:
        return not spark.read.schema("batch_id long").parquet(path).isEmpty()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return False
