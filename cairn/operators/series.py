"""Windows over a whole table that no single task has to hold.

An unpartitioned window sends all rows to one task. These functions cut the order into buckets instead: a window inside
each bucket, and one row for each bucket that carries what the buckets before it hand on.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_sums(rows: DataFrame, order: list[str], columns: dict[str, str], bucket: Column) -> DataFrame:
    """rows with, for each new name, the running sum of a column in the order; bucket must not decrease along it.

    Nulls add nothing. The order must be total for a defined result.
    """
    cut = rows.withColumn("__b", bucket)
    per = cut.groupBy("__b").agg(*[F.sum(F.coalesce(c, F.lit(0))).alias(f"__t_{n}") for n, c in columns.items()])
    before = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)  # one row for each bucket
    per = per.select("__b", *[F.coalesce(F.sum(f"__t_{n}").over(before), F.lit(0)).alias(f"__o_{n}") for n in columns])
    inside = Window.partitionBy("__b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = cut.join(per, "__b")
    return out.withColumns({n: (F.col(f"__o_{n}") + F.sum(F.coalesce(c, F.lit(0))).over(inside)).cast("long") for n, c in columns.items()}).select(*rows.columns, *columns)


def previous(rows: DataFrame, order: str, column: str, name: str, bucket: Column) -> DataFrame:
    """rows with the value of column in the row before, by order, null for the first; bucket must not decrease along order."""
    cut = rows.withColumn("__b", bucket)
    per = cut.groupBy("__b").agg(F.max_by(column, order).alias("__last"))
    per = per.select("__b", F.lag("__last").over(Window.orderBy("__b")).alias("__before"))
    at = Window.partitionBy("__b").orderBy(order)
    out = cut.join(per, "__b")
    value = F.when(F.row_number().over(at) == 1, F.col("__before")).otherwise(F.lag(column).over(at))
    return out.withColumn(name, value).select(*rows.columns, name)


def magnitude(value: Column, per_octave: int = 16) -> Column:
    """A bucket of a number that never decreases with it: so many for each doubling. Nulls come first, NaN last."""
    size = F.least(F.floor(F.log2(F.abs(value).cast("double") + 1) * per_octave), F.lit(1 << 39))
    bucket = F.when(F.isnan(value.cast("double")), F.lit(1 << 40)).otherwise(F.signum(value.cast("double")).cast("long") * size)
    return F.coalesce(bucket, F.lit(-(1 << 40))).cast("long")


def same_group(a: str, b: str, by: list[str]) -> Column:
    return reduce(lambda x, y: x & y, [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in by])


def running_counts(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """by, value, c (rows of the value), upto (rows of the group up to it) and n (rows of the group), a row for each value.

    A hot group is cut by magnitude, so that no task holds all its values in order.
    """
    counts = rows.groupBy(*by, value).agg(F.count("*").alias("c")).withColumn("__b", magnitude(F.col(value)))
    group = Window.partitionBy(*by)
    per = counts.groupBy(*by, "__b").agg(F.sum("c").alias("__t"))  # a few rows for each group
    per = per.select(*by, "__b", F.sum("__t").over(group.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)).alias("__o"), F.sum("__t").over(group).alias("n"))
    inside = Window.partitionBy(*by, "__b").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    out = counts.alias("x").join(per.alias("y"), same_group("x", "y", [*by, "__b"]))
    out = out.select(*[F.col(f"x.{c}").alias(c) for c in [*by, "__b", value, "c"]], "__o", "n")
    return out.select(*by, value, "c", (F.coalesce("__o", F.lit(0)) + F.sum("c").over(inside)).alias("upto"), "n")


def row_numbers(rows: DataFrame, by: list[str], order: list[str], name: str, per_octave: int = 64) -> DataFrame:
    """rows with their number from 0 in each group, in an order whose first column is a number; hot groups are cut by its magnitude."""
    cut = rows.withColumn("__b", magnitude(F.col(order[0]), per_octave))
    per = cut.groupBy(*by, "__b").agg(F.count("*").alias("__t"))
    per = per.select(*by, "__b", F.sum("__t").over(Window.partitionBy(*by).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)).alias("__o"))
    out = cut.alias("x").join(per.alias("y"), same_group("x", "y", [*by, "__b"])).select("x.*", "y.__o")
    inside = F.row_number().over(Window.partitionBy(*by, "__b").orderBy(*order))
    return out.withColumn(name, (F.coalesce("__o", F.lit(0)) + inside - 1).cast("long")).select(*rows.columns, name)


def previous_row(rows: DataFrame, by: list[str], order: str, columns: list[str], name: str, per_octave: int = 64) -> DataFrame:
    """rows with, as a struct ``name``, the columns of the row before in each group, by the number ``order``; null for its first.

    A group is cut by the order's magnitude, and one row goes over each cut, so that a hot group is no task of its own.
    """
    cut = rows.withColumns({"__b": magnitude(F.col(order), per_octave), "__v": F.struct(*columns)})
    per = cut.groupBy(*by, "__b").agg(F.max_by("__v", order).alias("__last"))  # a few hundred rows for each group at most
    per = per.select(*by, "__b", F.lag("__last").over(Window.partitionBy(*by).orderBy("__b")).alias("__before"))
    out = cut.alias("x").join(per.alias("y"), same_group("x", "y", [*by, "__b"])).select("x.*", "y.__before")
    at = Window.partitionBy(*by, "__b").orderBy(order)
    return out.withColumn(name, F.when(F.row_number().over(at) == 1, F.col("__before")).otherwise(F.lag("__v").over(at))).select(*rows.columns, name)


def runs(rows: DataFrame, by: list[str], seq: str, width: int = 1_000_000) -> DataFrame:
    """by, low and high (exclusive) of the runs of consecutive numbers in each group; a run ends at multiples of ``width``, too.

    A task sees the numbers of one group and stretch of ``width``; join_runs() puts what touches together.
    """
    numbers = rows.where(F.col(seq).isNotNull()).select(*by, F.col(seq).cast("long").alias("__n")).distinct().withColumn("__b", F.floor(F.col("__n") / width))
    island = F.col("__n") - F.row_number().over(Window.partitionBy(*by, "__b").orderBy("__n"))
    return numbers.withColumn("__i", island).groupBy(*by, "__b", "__i").agg(F.min("__n").alias("low"), (F.max("__n") + 1).alias("high")).select(*by, "low", "high")


def join_runs(found: DataFrame, by: list[str]) -> DataFrame:
    """Runs [low, high) of each group that overlap or touch, put together. A group's runs are one more than its gaps at least."""
    order = Window.partitionBy(*by).orderBy("low", "high")
    reach = F.max("high").over(order.rowsBetween(Window.unboundedPreceding, -1))
    begins = found.withColumn("__new", F.when(reach >= F.col("low"), 0).otherwise(1))
    numbered = begins.withColumn("__i", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*by, "__i").agg(F.min("low").alias("low"), F.max("high").alias("high")).select(*by, "low", "high")
