"""Joins that Spark has no operator of its own for, and the look-ups built on them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.operators.series import same_group


def range_lookup(rows: DataFrame, ranges: DataFrame, at: str, low: str, high: str, width: int) -> DataFrame:
    """Rows with each range [low, high] that holds ``at``, as an equi-join on cells of ``width``.

    A range is copied into each cell that it touches, so width is best near a typical range's length. Both sides
    shuffle by cell, whatever their sizes; Spark broadcasts the ranges by itself where they are small.
    """
    cell = lambda c: F.floor(F.col(c) / width)
    dealt = ranges.where(f"{low} is not null and {high} is not null and {low} <= {high}").withColumn("__cell", F.explode(F.sequence(cell(low), cell(high))))
    return rows.withColumn("__cell", cell(at)).join(dealt, "__cell").where(F.col(at).between(F.col(low), F.col(high))).drop("__cell")


def asof_version(requests: DataFrame, versions: DataFrame, key: str, at: str, version: str, width: int = 10_000) -> DataFrame:
    """Each request (key, at) with the greatest version <= at of its key; null columns where there is none.

    One window over the union, so that neither side is multiplied; key and ``at`` name columns of requests. Windows are
    cut at each ``width`` of ``at``; the last version before a cut is carried, one row for each cut that holds versions.
    """
    rest = [c for c in versions.columns if c != key]
    packed = versions.select(key, F.col(version).alias("__at"), F.lit(0).alias("__side"), F.struct(*rest).alias("__v"), F.lit(None).cast(requests.select(F.struct(*requests.columns)).dtypes[0][1]).alias("__r"))
    asked = requests.select(key, F.col(at).alias("__at"), F.lit(1).alias("__side"), F.lit(None).cast(packed.schema["__v"].dataType).alias("__v"), F.struct(*requests.columns).alias("__r"))
    cut = F.floor(F.col("__at") / width)
    per = packed.where("__at is not null").groupBy(key, cut.alias("__b")).agg(F.max_by("__v", "__at").alias("__v"))
    cells = per.unionByName(asked.select(key, cut.alias("__b")).distinct(), allowMissingColumns=True).groupBy(key, "__b").agg(F.max_by("__v", F.col("__v").isNotNull()).alias("__v"))
    before = Window.partitionBy(key).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    carried = cells.select(key, "__b", F.last("__v", ignorenulls=True).over(before).alias("__c"))
    last = Window.partitionBy(key, "__b").orderBy("__at", "__side").rowsBetween(Window.unboundedPreceding, 0)
    both = packed.unionByName(asked).withColumn("__b", cut).withColumn("__v", F.last("__v", ignorenulls=True).over(last)).where("__side = 1")
    both = both.alias("x").join(carried.alias("y"), same_group("x", "y", [key, "__b"]), "left").select("x.__r", F.coalesce("x.__v", "y.__c").alias("__v"))
    return both.select("__r.*", *[F.col(f"__v.{c}").alias(c) for c in rest])


def exact_version(refs: DataFrame, versions: DataFrame, key: str, version: str) -> DataFrame:
    """The row of each (key, version) reference; references without one are left out."""
    return refs.join(versions, [key, version])


def keep_by(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose key occurs in keys."""
    return rows.join(keys.select(*on), on, "left_semi")


def reconcile(a: DataFrame, b: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Keys with status "extra" (a only), "missing" (b only) or "different"; equal rows are left out. Nulls equal nulls."""
    left = a.select(*keys, F.struct(*columns).alias("__a"), F.lit(True).alias("__in_a"))
    right = b.select(*keys, F.struct(*columns).alias("__b"), F.lit(True).alias("__in_b"))
    same = reduce(lambda x, y: x & y, [F.col(f"__a.{c}").eqNullSafe(F.col(f"__b.{c}")) for c in columns])
    status = F.when(F.col("__in_b").isNull(), "extra").when(F.col("__in_a").isNull(), "missing").when(~same, "different")
    return left.join(right, keys, "full_outer").withColumn("status", status).where("status is not null").select(*keys, "status")


def cross_validate(replicas: DataFrame, replica: str, position: str, value: str) -> DataFrame:
    """Positions where some replica lacks an element or has another than the first replica."""
    count = replicas.select(replica).distinct().agg(F.count("*").alias("replicas"))
    by = replicas.groupBy(position).agg(F.count_distinct(replica).alias("present"), F.count_distinct(F.coalesce(F.col(value).cast("string"), F.lit("\0"))).alias("distinct_values"))
    return by.crossJoin(F.broadcast(count)).where("present < replicas or distinct_values > 1").select(position, "present", "distinct_values")


def chain_latency(sent: DataFrame, batches: DataFrame, commits: DataFrame) -> DataFrame:
    """Sample, latency of each sent sample (sample, sent_at) whose batch (sample, batch) has a commit (batch, committed_at)."""
    return sent.join(batches, "sample").join(commits, "batch").select("sample", (F.col("committed_at") - F.col("sent_at")).alias("latency"))


def latency(starts: DataFrame, ends: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """End - start for keys with both."""
    return starts.select(key, start).join(ends.select(key, end), key).select(key, (F.col(end) - F.col(start)).alias("latency"))


def children_of(history: DataFrame, parents: DataFrame, owner: str = "owner_id", parent: str = "parent", kind: Column | None = None, version: str | None = None, bound: str | None = None) -> DataFrame:
    """Rows owned by the parents; with version and bound (a column of parents), up to that version only."""
    rows = history if kind is None else history.where(kind)
    out = parents.join(rows, F.col(parent) == F.col(owner))
    return out.where(F.col(version) <= F.col(bound)) if version and bound else out


def latest_by(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The row of each key with the largest order, as an aggregation."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__r")).select(key, "__r.*")


def with_display(objects: DataFrame, templates: DataFrame, type_column: str, version: str, template: str) -> DataFrame:
    """Objects with the latest template of their type, null where there is none."""
    latest = latest_by(templates.select(type_column, version, template), type_column, [version]).drop(version)
    return objects.join(latest, type_column, "left")


def resolve(names: DataFrame, registry: DataFrame, key: str) -> DataFrame:
    """Forward (key: the domain) or reverse (key: the address) look-up, null where nothing is registered."""
    return names.join(registry, key, "left")


def with_metadata(coins: DataFrame, metadata: DataFrame, coin_type: str, order: list[str], native: str, native_supply: int, supply: str = "supply") -> DataFrame:
    """Coins with the first metadata row of their type; the native coin's supply is a constant."""
    first = metadata.groupBy(coin_type).agg(F.min_by(supply, F.struct(*order)).alias(supply))
    return coins.join(first, coin_type, "left").withColumn(supply, F.when(F.col(coin_type) == native, F.lit(native_supply).cast("long")).otherwise(F.col(supply)))


def staged_edges(reads: DataFrame, overwrites: DataFrame, tx: str = "tx", key: str = "object_id", version: str = "version") -> DataFrame:
    """(tx, depends_on): who overwrites a version depends on who read it."""
    r = reads.select(F.col(tx).alias("depends_on"), key, version)
    return overwrites.select(tx, key, version).join(r, [key, version]).where(F.col(tx) != F.col("depends_on")).select(tx, "depends_on").distinct()
