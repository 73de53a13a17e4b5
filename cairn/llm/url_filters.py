"""URL filters: a sort-merge range join of URLs with nested prefix rules.

A rule names a host and the start of a path. Written as a canonical key, labels of the host reversed and then the
path (``com.example/en/7``), it is the interval of all keys that it is a prefix of. A URL has one such key for each
of its host's ancestors, so that a rule for a host also reaches all subdomains. Rules and keys are sorted together
and swept once: a stack holds the rules whose interval is open, and as prefix intervals nest, the top of the stack is
the longest rule that fits.

Scale: only keys of hosts that some rule names are sorted; equal URLs are judged once; the keys of a host that holds
many of them are dealt out over salts, to which only that host's rules are copied.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.common import carried, materialize, unused

#: The production rules: verdict, host, start of the path.
RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]
DEFAULT_VERDICT = "allow"


def rules_table(spark: SparkSession, rules: Iterable[tuple[str, str, str]] = RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "verdict string, host string, path string")


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; else empty."""
    raw = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def reversed_host(host: Column) -> Column:
    return F.array_join(F.reverse(F.split(host, r"\.", -1)), ".")


def ancestors(host: Column, most: int) -> Column:
    """The host and its parents of at most so many labels, which come reversed: a.b.c gives c, c.b and c.b.a.

    No rule has more labels than ``most``, so that longer ones fit none, and a host of very many labels costs no more.
    """
    last = F.reverse(F.split(F.substring_index(host, ".", -most), r"\.", -1))
    return F.transform(F.sequence(F.lit(1), F.size(last)), lambda i: F.array_join(F.slice(last, 1, i), "."))


def sweep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One pass over rows sorted by (anchor, salt, path, rules first); memory holds one stack of nested rules."""
    at, stack = None, []
    for batch in batches:
        found = []
        for anchor, salt, path, is_rule, host, rule, verdict in zip(
            batch["anchor"], batch["salt"], batch["path"], batch["is_rule"], batch["host"], batch["rule"], batch["verdict"], strict=True
        ):
            if at != (anchor, salt):
                at, stack = (anchor, salt), []
            while stack and not path.startswith(stack[-1][0]):
                stack.pop()
            if is_rule:
                stack.append((path, rule, verdict))
            elif stack:
                found.append((host, path, stack[-1][1], stack[-1][2]))
        yield pd.DataFrame(found, columns=["host", "path", "rule", "verdict"])


def match_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """The longest rule for each distinct (host, path) of urls that has one: host, path, rule, verdict.

    urls has host and path, rules has verdict, host and path. A rule without path fits every path. If two rules have
    the same host and path, the smallest verdict ("allow" before "block") counts. The longest rule is the one with
    most characters in host and path together, then the longer host.
    """
    spark = urls.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranked = rules.where("host is not null and verdict is not null").select(
        reversed_host(F.lower("host")).alias("anchor"),
        F.coalesce("path", F.lit("")).alias("path"),
        F.concat(F.lower("host"), F.coalesce("path", F.lit(""))).alias("rule"),
        "verdict",
    ).groupBy("anchor", "path", "rule").agg(F.min("verdict").alias("verdict"))
    most = ranked.agg(F.max(F.size(F.split("anchor", r"\.", -1)))).first()[0] or 1
    keys = urls.select("host", "path").where("host <> ''").distinct().select("host", "path", F.explode(ancestors(F.col("host"), most)).alias("anchor"))
    keys = materialize(keys.join(ranked.select("anchor").distinct(), "anchor", "left_semi"), "url-keys")
    # At most 4n anchors hold more than a 4n-th of all keys; they are dealt out over salts.
    share = max(1, keys.count() // (4 * n))
    hot = keys.groupBy("anchor").count().where(F.col("count") > share).select("anchor", F.ceil(F.col("count") / share).cast("int").alias("salts"))
    hot = F.broadcast(hot)
    salted = keys.join(hot, "anchor", "left").select(
        "anchor", F.pmod(F.xxhash64("host", "path"), F.coalesce("salts", F.lit(1))).cast("int").alias("salt"), "path",
        F.lit(False).alias("is_rule"), "host", F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"),
    )
    copied = ranked.join(hot, "anchor", "left").select(
        "anchor", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)).alias("salt"), "path",
        F.lit(True).alias("is_rule"), F.lit("").alias("host"), "rule", "verdict",
    )
    swept = (
        salted.unionByName(copied)
        .repartition("anchor", "salt")
        .sortWithinPartitions("anchor", "salt", "path", F.col("is_rule").desc())
        .mapInPandas(sweep, "host string, path string, rule string, verdict string")
    )
    # The longer of two rules with the same length in all is the one with the shorter path.
    best = F.max(F.struct(F.length("rule").alias("all"), -F.length(F.regexp_replace("rule", "^[^/]*", "")), "rule", "verdict"))
    return swept.groupBy("host", "path").agg(best.alias("best")).select("host", "path", "best.rule", "best.verdict")


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = DEFAULT_VERDICT, url: str = "url") -> DataFrame:
    """All rows and columns of pages, with host, path, rule and verdict in place of any columns so named.

    A null URL, or one without ``://``, has an empty host and path, no rule and the default verdict. Repeated rows
    stay; an empty table gives an empty result; an empty table of rules gives the default to all.
    """
    own = carried(pages, "host", "path", "rule", "verdict")
    host, path = unused("__host", own), unused("__path", own)
    cut = pages.select(*[F.col(f"`{c}`") for c in own], host_of(F.col(f"`{url}`")).alias("host"), path_of(F.col(f"`{url}`")).alias("path"))
    found = match_rules(cut.select("host", "path"), rules).select(F.col("host").alias(host), F.col("path").alias(path), "rule", "verdict")
    given = [*[F.col(f"`{c}`") for c in own], F.col("host"), F.col("path")]
    joined = cut.where("host <> ''").join(found, (F.col("host") == F.col(host)) & (F.col("path") == F.col(path)), "left")
    judged = joined.select(*given, "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))
    # Rows without a host have no rule. They stay out of the join, in which they would be one key.
    return judged.union(cut.where("host = ''").select(*given, F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return filter_urls(pages, rules_table(spark)).select("page_id", "host", "path", "rule", "verdict")


ORACLE_SQL = r"""
WITH cut AS (
  SELECT page_id,
    CASE WHEN strpos(url, '://') > 0 THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*') ELSE '' END AS raw_host,
    CASE WHEN strpos(url, '://') > 0 THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM pages),
u AS (SELECT page_id, translate(raw_host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM cut),
rules(verdict, rule_host, rule_path) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'),
  ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
fit AS (
  SELECT page_id, arg_max(concat(rule_host, rule_path), length(rule_host) + length(rule_path)) AS rule,
    arg_max(verdict, length(rule_host) + length(rule_path)) AS verdict
  FROM u JOIN rules ON (host = rule_host OR ends_with(host, concat('.', rule_host))) AND starts_with(path, rule_path)
  GROUP BY page_id)
SELECT u.page_id, u.host, u.path, fit.rule, coalesce(fit.verdict, 'allow') AS verdict FROM u LEFT JOIN fit USING (page_id)
"""
