"""A corpus pipeline of five operators, from raw documents to packed batches.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
one's docs; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm import line_dedup, mixing, ngram_join, packing, quality_rules
from cairn.llm.common import materialize, release

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the production policy of the quality rules."""
    return quality_rules.keep(docs.select(*COLUMNS))


def lines_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without runs of lines that an earlier document has; a document of which no word is left goes."""
    deduped = line_dedup.dedup_lines(docs.select(*COLUMNS))
    left = deduped.where((F.col("removed_lines") == 0) | F.col("text").rlike("[^ \\x09-\\x0D]"))
    return left.withColumn("n_chars", F.when(F.col("removed_lines") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest doc_id; rows without a doc_id stay.

    A document is a doc_id and its text: another text under the same doc_id is judged by itself.
    """
    found = ngram_join.jaccard_components(docs.select("doc_id", "text"), text_hash=True)
    others = found.where("component_id <> doc_id").select("doc_id", "text_hash").distinct()
    named = docs.select(*COLUMNS, F.xxhash64("text").alias("text_hash"))
    return named.join(others, ["doc_id", "text_hash"], "left_anti").select(*COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their rate says, at most once, so that domains approach their target weights."""
    labels = mixing.domains_of(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return mixing.mix(docs.select(*COLUMNS), labels, max_rate=1.0).where("copies > 0").select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Buckets, batches and slots of all documents that are left."""
    return packing.pack(docs.select("doc_id", "text"))


STAGES = [
    ("quality_rules", rules_stage),
    ("line_dedup", lines_stage),
    ("ngram_join", jaccard_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: The classifier and the bucket boundaries are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
        release(before)  # a stage's table is read by the next one only
    return STAGES[-1][1](spark, docs, sf_dir)
