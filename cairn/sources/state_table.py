"""Keyed tables in buckets, of which a batch writes only the buckets that it touches.

    data/batch=<id>/__slot=<s>/    rows of the buckets of a slot as that batch left them, with their bucket and version
    versions/batch=<id>/           bucket and version: the batch that wrote each bucket last

A table as of a batch is the rows whose bucket has their version, so that what a batch leaves alone is never copied, and any
earlier version can be read as long as it is kept. Buckets of any number share the files of a bounded number of slots, and
which bucket has which version is a table of its own that tasks join. The versions are written last: a batch without them
does not count, and one that is tried again starts from the versions before it and writes the same.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_VERSIONS = "bucket long, version long, batch long"
_OWN = [T.StructField("__bucket", T.LongType()), T.StructField("__version", T.LongType()), T.StructField("__slot", T.LongType())]


class StateTable:
    """A table below ``path``; ``bucket`` is an expression over its rows that depends on the key alone.

    A hash of the key suits keys that come in any order, a quotient of it keys that grow: then a batch touches the last
    buckets only. What a batch writes is at most the buckets of its keys, in ``slots`` files at most.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, bucket: Column, slots: int = 64):
        if "batch" in (name.lower() for name in schema.names):
            raise ValueError("batch is the name of a folder of the table")
        self.spark, self.path, self.schema, self.bucket, self.slots = spark, path, schema, bucket.cast("long"), slots

    @staticmethod
    def hashed(keys: list[str], buckets: int = 256) -> Column:
        return F.pmod(F.xxhash64(*keys), F.lit(buckets))

    def history(self) -> DataFrame:
        """bucket, version and batch for all batches that were committed, a null bucket once in each; empty before the first."""
        try:
            return self.spark.read.schema(_VERSIONS).parquet(f"{self.path}/versions")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], _VERSIONS)

    def last(self, batch: int | None = None) -> DataFrame:
        """bucket and version of each bucket as of a batch, the last one if none is given."""
        rows = self.history() if batch is None else self.history().where(F.col("batch") <= batch)
        found = rows.agg(F.max("batch")).first()[0]
        return rows.where((F.col("batch") == found) & F.col("bucket").isNotNull() if found is not None else F.lit(False)).select("bucket", "version")

    def versions(self, batch: int | None = None) -> dict[int, int]:
        """last() as a dict, for tables of few buckets."""
        return {r["bucket"]: r["version"] for r in self.last(batch).collect()}

    def read(self, batch: int | None = None) -> DataFrame:
        """The rows as of a batch."""
        return self._rows(self.last(batch)).select(*self.schema.names)

    def data(self, batches: list[int]) -> DataFrame:
        """All rows that these batches wrote, with __bucket, __version, __slot and __file."""
        schema = T.StructType([*self.schema.fields, *_OWN])
        if not batches:
            return self.spark.createDataFrame([], T.StructType([*schema.fields, T.StructField("__file", T.StringType())]))
        found = self.spark.read.schema(schema).option("basePath", f"{self.path}/data").parquet(*[f"{self.path}/data/batch={b}" for b in batches])
        return found.select(*schema.names, F.col("_metadata.file_path").alias("__file"))

    def _rows(self, versions: DataFrame, slots: list[int] | None = None) -> DataFrame:
        batches = sorted(r[0] for r in versions.select("version").distinct().collect())  # one for each batch at most
        rows = self.data(batches) if slots is None else self.data(batches).where(F.col("__slot").isin(slots))
        return rows.join(versions.select(F.col("bucket").alias("__bucket"), F.col("version").alias("__version")), ["__bucket", "__version"], "left_semi")

    def _slot(self, bucket: str) -> Column:
        return F.pmod(F.col(bucket), F.lit(self.slots)).cast("long")

    def merge(self, batch: int, new: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> int:
        """Puts ``merge(rows of the touched buckets, new)`` in place of these buckets; how many they were.

        merge must keep the keys of a bucket in it. Rows that it leaves out are gone.
        """
        before = self.last(batch - 1)
        new.persist()
        touched = new.select(self.bucket.alias("bucket")).where("bucket is not null").distinct().persist()
        count, left = touched.count(), before.join(touched, "bucket", "left_anti")
        if count:
            slots = [r[0] for r in touched.select(self._slot("bucket")).distinct().collect()]
            old = self._rows(before.join(touched, "bucket", "left_semi"), slots).select(*self.schema.names)
            merged = merge(old, new).select(*self.schema.names).withColumn("__bucket", self.bucket).withColumns({"__version": F.lit(batch).cast("long"), "__slot": self._slot("__bucket")})
            merged.repartition("__slot").write.mode("overwrite").partitionBy("__slot").parquet(f"{self.path}/data/batch={batch}")
            left = left.unionByName(self.data([batch]).select(F.col("__bucket").alias("bucket"), F.lit(batch).cast("long").alias("version")).distinct())
        # A table without rows has versions, too: those of no bucket.
        none = self.spark.range(1).select(F.lit(None).cast("long").alias("bucket"), F.lit(batch).cast("long").alias("version"))
        left.unionByName(none).coalesce(8).write.mode("overwrite").parquet(f"{self.path}/versions/batch={batch}")
        touched.unpersist()
        new.unpersist()
        return count
