"""Named queries over the driver's tables, each with its SQL twin where SQL can express it."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cairn.plans import views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


class Tables:
    """The driver's tables and the views over them, as attributes."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("fx_"):
            return views.build(self, name)
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    """Registers a function of Tables as a query; sql may use the fx_ views by name."""

    def wrap(f: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            SQL[name] = with_views(sql)
        return f

    return wrap


def with_views(sql: str) -> str:
    """sql after the definitions of the views it uses."""
    used = views.closure(set(re.findall(r"\bfx_\w+", sql)))
    if not used:
        return sql.strip()
    defined = ", ".join(f"{name} AS ({views.duckdb(name)})" for name in used)
    m = re.match(r"\s*WITH\s+(RECURSIVE\s+)?", sql)
    return f"WITH {'RECURSIVE ' if m and m[1] else ''}{defined}{', ' + sql[m.end() :].strip() if m else ' ' + sql.strip()}"
