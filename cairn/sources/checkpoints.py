"""Sources of checkpoint records: files named <sequence>.json or .parquet, in batch or as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions.scalars import file_number
from cairn.plans.schemas import CHECKPOINT
from cairn.sources.bounded import prune


def with_sequence(files: DataFrame) -> DataFrame:
    """The number in each file's name, or else of its folder (seq=12/part-0.json), as file_sequence."""
    folder = F.regexp_extract(F.col("_metadata.file_path"), r"seq=([0-9]+)/[^/]*$", 1).try_cast("long")
    return files.withColumn("file_sequence", F.coalesce(folder, file_number(F.col("_metadata.file_name"))))


def read_checkpoint_files(spark: SparkSession, path: str, start: int = 0, fmt: str = "json") -> DataFrame:
    """Checkpoints from start on. Gaps are a matter of gap_rows(), as a scan has no order."""
    return with_sequence(spark.read.schema(CHECKPOINT).format(fmt).load(path)).where(F.col("file_sequence") >= start)


def gap_rows(checkpoints: DataFrame, start: int = 0, seq: str = "file_sequence", bucket: int = 10_000) -> DataFrame:
    """Sequence numbers that don't follow the one before, the first being start. Empty if the files are complete."""
    from cairn.operators.series import previous

    rows = checkpoints.select(F.col(seq).alias("seq")).distinct()
    found = previous(rows, "seq", "seq", "prev", F.floor(F.col("seq") / bucket))
    return found.where(F.coalesce("prev", F.lit(start - 1)) != F.col("seq") - 1)


def read_until_gap(checkpoints: DataFrame, start: int, seq: str = "file_sequence", bucket: int = 10_000) -> DataFrame:
    """Checkpoints from start up to the first missing number."""
    from cairn.operators.quality import contiguous_watermark

    end = F.broadcast(contiguous_watermark(checkpoints.select(F.col(seq).alias("seq")), start, bucket=bucket))  # one row
    return checkpoints.crossJoin(end).where((F.col(seq) >= start) & (F.col(seq) < F.col("watermark"))).drop("watermark")


def read_complete(checkpoints: DataFrame, start: int, seq: str = "file_sequence") -> DataFrame:
    """Checkpoints from start on; ValueError if a number is missing among them."""
    gap = gap_rows(checkpoints.where(F.col(seq) >= start), start, seq).first()
    if gap is not None:
        raise ValueError(f"no checkpoint before {gap['seq']}, after {gap['prev']}")
    return checkpoints.where(F.col(seq) >= start)


def collectable(inputs: DataFrame, progress: DataFrame, seq: str = "file_sequence", watermark: str = "watermark") -> DataFrame:
    """T4: the inputs that all pipelines in progress have passed; none while there is no pipeline."""
    least = F.broadcast(progress.agg(F.min(watermark).alias("__least")))  # one row
    return inputs.crossJoin(least).where(F.col(seq) < F.col("__least")).drop("__least")


def collect_inputs(path: str, progress: DataFrame, pruned: str, watermark: str = "watermark") -> int:
    """T4: deletes the inputs below path that all pipelines have passed; how many those were."""
    least = progress.agg(F.min(watermark)).first()[0]
    return 0 if least is None else prune(path, least, pruned)


def stream_checkpoint_files(spark: SparkSession, path: str, fmt: str = "json", max_files: int | None = None, clean: bool = False, archive: str | None = None) -> DataFrame:
    """The same files as a stream, so many a trigger; read files can be deleted or moved to an archive."""
    reader = spark.readStream.schema(CHECKPOINT).format(fmt)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    if clean or archive:
        reader = reader.option("cleanSource", "archive" if archive else "delete")
    if archive:
        reader = reader.option("sourceArchiveDir", archive)
    return with_sequence(reader.load(path))


def max_checkpoint(table: DataFrame, column: str = "checkpoint") -> DataFrame:
    """The last checkpoint of a table, one row, -1 for an empty one."""
    return table.agg(F.coalesce(F.max(column), F.lit(-1)).cast("long").alias("max_checkpoint"))


def resume(source: DataFrame, target: DataFrame, column: str = "checkpoint") -> DataFrame:
    """S3: the rows of source that come after the last checkpoint of target."""
    last = F.broadcast(max_checkpoint(target, column))  # one row
    return source.crossJoin(last).where(F.col(column) > F.col("max_checkpoint")).drop("max_checkpoint")


def load_stage(spark: SparkSession, path: str, columns: list[str], schema: str | None = None) -> DataFrame:
    """The named columns of all Parquet files below a path whose schemas may have grown; missing ones are null."""
    reader = spark.read.option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true")
    found = reader.schema(schema).parquet(path) if schema else reader.option("mergeSchema", "true").parquet(path)
    return found.select(*[F.col(c) if c in found.columns else F.lit(None).cast("string").alias(c) for c in columns])


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """Log files as lines."""
    return spark.read.text(path)
