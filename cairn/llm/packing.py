"""Packing: optimal length buckets by dynamic programming over the global histogram of lengths.

Words are counted once and written, a few bytes for each document. One aggregation gives the histogram of lengths. A dynamic programme over it chooses the bucket boundaries that
minimise the padding of all documents together. Inside each bucket documents are numbered, and each run of
``token_budget // boundary`` of them is one batch.

Scale: the histogram has a row for each distinct length, at most the longest text's words and the square root of twice
all words. The programme's cuts grow with the length, so that it divides and conquers over them: each of few buckets takes
m log m steps for m lengths. Numbering a bucket
needs no single task: rows are numbered within shards of some thousand rows, and shards start where those before end.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.llm.common import materialize, n_words

BUCKETS = 12
TOKEN_BUDGET = 32_768
ROWS_PER_SHARD = 2_000


def ceiling(length: Column) -> Column:
    """The candidate boundary of a length: the length itself."""
    return length


def boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int = BUCKETS) -> list[int]:
    """Upper ends of at most so many buckets with the least padding, sum of count * (upper end - length).

    lengths are the candidates in ascending order. Ties go to the smaller previous boundary.
    """
    m = len(lengths)
    if not m:
        return []
    k = min(buckets, m)
    lengths, counts = lengths.astype(np.int64), counts.astype(np.int64)
    n = np.concatenate([[0], np.cumsum(counts)])
    tokens = np.concatenate([[0], np.cumsum(counts * lengths)])
    back = np.zeros((k + 1, m + 1), dtype=np.int64)
    cost = np.concatenate([[0], lengths * n[1:] - tokens[1:]])  # one bucket
    for b in range(2, k + 1):
        now = np.zeros(m + 1, dtype=np.int64)
        todo = [(b, m, b - 1, m - 1)]  # upper ends j from, to; their cuts i from, to
        while todo:
            low, high, first, last = todo.pop()
            if low > high:
                continue
            j = (low + high) // 2
            to = min(last, j - 1) + 1
            padding = lengths[j - 1] * (n[j] - n[first:to]) - (tokens[j] - tokens[first:to]) + cost[first:to]
            i = first + int(np.argmin(padding))
            now[j], back[b, j] = padding[i - first], i
            todo += [(low, j - 1, first, i), (j + 1, high, i, last)]
        cost = now
    ends, j = [], m
    for b in range(k, 0, -1):
        ends.append(int(lengths[j - 1]))
        j = int(back[b, j])
    return sorted(ends)


def histogram(lengths: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Of a table with the column ``ceiling``: a row for each distinct length."""
    rows = sorted((r["ceiling"], r["n"]) for r in lengths.groupBy("ceiling").agg(F.count("*").alias("n")).collect())
    return np.array([r[0] for r in rows], dtype=np.int64), np.array([r[1] for r in rows], dtype=np.int64)


def numbered(rows: DataFrame, group: str, order: list[str], shards: int) -> DataFrame:
    """rows with ``number``, from 0 without gaps inside each group, in the order of (shard, order)."""
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64(*order), F.lit(shards)).cast("int"))
    starts = (
        dealt.groupBy(group, "shard").agg(F.count("*").alias("size"))
        .withColumn("start", F.sum("size").over(Window.partitionBy(group).orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
        .drop("size")
    )
    inside = F.row_number().over(Window.partitionBy(group, "shard").orderBy(*order)) - 1
    return dealt.withColumn("inside", inside).join(starts, [group, "shard"]).withColumn("number", F.col("start") + F.col("inside")).drop("inside", "start", "shard")


def pack(docs: DataFrame, buckets: int = BUCKETS, token_budget: int = TOKEN_BUDGET) -> DataFrame:
    """One row for each row of docs: doc_id, n_tokens, bucket, padded_length, batch, slot, padding.

    docs has doc_id and text; a text's tokens are its words. Null and empty texts have length 0 and take a whole slot
    of padding. A text longer than token_budget is alone in its batch. Repeated rows are packed each for itself. An
    empty table gives an empty result. Batches are numbered inside their bucket.
    """
    # Rows without doc_id are told apart by where they stand, others that repeat a doc_id by their texts.
    tie = F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id()).otherwise(F.xxhash64("text"))
    sized = materialize(docs.select("doc_id", n_words(F.col("text")).alias("n_tokens"), tie.alias("tie")), "lengths")
    sized = sized.withColumn("ceiling", ceiling(F.col("n_tokens")))
    lengths, counts = histogram(sized)
    ends = boundaries(lengths, counts, buckets)
    if not ends:
        return sized.select(
            "doc_id", "n_tokens", F.lit(0).alias("bucket"), F.lit(0).cast("long").alias("padded_length"),
            F.lit(0).cast("long").alias("batch"), F.lit(0).cast("long").alias("slot"), F.lit(0).cast("long").alias("padding"),
        )
    bucket, upper = F.lit(len(ends) - 1), F.lit(ends[-1])
    for i, end in reversed(list(enumerate(ends[:-1]))):
        bucket = F.when(F.col("ceiling") <= end, F.lit(i)).otherwise(bucket)
        upper = F.when(F.col("ceiling") <= end, F.lit(end)).otherwise(upper)
    placed = sized.withColumn("bucket", bucket).withColumn("padded_length", upper.cast("long"))
    slots = F.greatest(F.lit(1), F.floor(F.lit(token_budget) / F.greatest(F.col("padded_length"), F.lit(1)))).cast("long")
    return numbered(placed, "bucket", ["doc_id", "n_tokens", "tie"], 1 + int(counts.sum()) // ROWS_PER_SHARD).select(
        "doc_id", "n_tokens", "bucket", "padded_length",
        F.floor(F.col("number") / slots).cast("long").alias("batch"), F.pmod(F.col("number"), slots).cast("long").alias("slot"),
        (F.col("padded_length") - F.col("n_tokens")).alias("padding"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE_SQL = None
