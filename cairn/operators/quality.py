"""Checks of tables, archives and indexes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def duplicate_summary(rows: DataFrame, key: str, content: str) -> DataFrame:
    """Rows, rows that repeat a content of the same key, and their bytes, in one row. Content is compared whole by SHA-256."""
    size = F.octet_length(F.col(content))
    groups = rows.groupBy(key, F.sha2(F.col(content).cast("binary"), 256).alias("h")).agg(F.count("*").alias("n"), F.max(size).alias("size"))
    return groups.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_rows"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_rows"),
        F.coalesce(F.sum(F.col("n") * F.col("size")), F.lit(0)).cast("long").alias("total_bytes"), F.coalesce(F.sum((F.col("n") - 1) * F.col("size")), F.lit(0)).cast("long").alias("duplicate_bytes"),
    )


def missing_epochs(found: DataFrame, column: str = "epoch") -> DataFrame:
    """Numbers below the largest found that are not there."""
    top = found.agg(F.max(column).alias("m")).where("m > 0")
    return top.select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("m").cast("long") - 1)).alias(column)).join(found.select(F.col(column).cast("long").alias(column)), column, "left_anti")


def manifest_breaks(files: DataFrame, start: str = "start", end: str = "end") -> DataFrame:
    """Files that don't start where the one before ends; the first must start at 0. An empty result is a sound archive.

    A manifest has a row for each file, few enough for one window.
    """
    before = F.coalesce(F.lag(end).over(Window.orderBy(start)), F.lit(0))
    return files.withColumn("expected", before).where(F.col(start) != F.col("expected"))


def next_checkpoint_after(files: DataFrame, epoch: int, start: str = "start") -> DataFrame:
    """Where the first file of a later epoch starts, one row."""
    return files.where(F.col("epoch") > epoch).agg(F.min(start).alias("checkpoint"))


def checksum_failures(files: DataFrame, manifest: DataFrame, name: str = "file", digest: str = "digest") -> DataFrame:
    """Files of a manifest that are missing or whose content (a binary column) has another SHA-256."""
    actual = files.select(name, F.sha2("content", 256).alias("actual"))
    return manifest.join(actual, name, "left").where(F.col("actual").isNull() | (F.col("actual") != F.col(digest))).select(name, F.when(F.col("actual").isNull(), "missing").otherwise("corrupt").alias("problem"))


def contiguous_watermark(done: DataFrame, start: int, seq: str = "seq", bucket: int = 1_000_000) -> DataFrame:
    """T3 in batch: the number after the gap-free run of done numbers from start on, one row.

    Counts of distinct numbers by bucket come first; only the first bucket that is not full is looked at closely.
    """
    nums = done.where(F.col(seq) >= start).select(F.col(seq).cast("long").alias("n")).distinct()
    counts = nums.groupBy(F.floor((F.col("n") - start) / bucket).alias("b")).agg(F.count("*").alias("c"))
    full = counts.where(F.col("c") == bucket).select("b")
    ranked = full.withColumn("r", F.row_number().over(Window.orderBy("b")) - 1)  # a row for each bucket
    whole = ranked.where("b = r").agg(F.count("*").alias("whole"))
    inside = nums.crossJoin(F.broadcast(whole)).where(F.floor((F.col("n") - start) / bucket) == F.col("whole"))
    gaps = inside.withColumn("r", F.row_number().over(Window.orderBy("n")) - 1).where(F.col("n") == start + F.col("whole") * bucket + F.col("r"))
    return gaps.agg(F.count("*").alias("more")).crossJoin(whole).select((F.lit(start) + F.col("whole") * bucket + F.col("more")).cast("long").alias("watermark"))
