"""Quality rules: a bitmask ledger. DataFrame functions only.

Every rule is evaluated once for each document; the ledger stores the measurements and one bit for each failed rule.
Policies are versioned masks over those bits, so that a new policy, or the question what each rule costs, needs the
ledger and bit operations only, never the texts.

Scale: one pass over the texts without a shuffle. Within a text, windows are compared by 64-bit hash; only texts that
do repeat a window are sorted, so no step is worse than n log n in a text's words.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.common import let, words

WINDOW = 5
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_exclaims"]
#: The rules in bit order: name, condition of failure over the measurements. Bits keep their meaning for ever.
RULES = [
    ("too_short", "n_words < 10"),
    ("repeated_words", "100 * n_repeat_words > 20 * n_words"),
    ("symbols", "10 * n_symbols > 3 * n_words"),
    ("shouting", "10 * n_exclaims > 3 * n_words"),
    ("repeated_lines", "100 * n_dup_lines > 60 * n_lines"),
    ("word_length", "word_chars < 2 * n_words or word_chars > 25 * n_words"),
]
BIT = {name: 1 << i for i, (name, _) in enumerate(RULES)}


@dataclass(frozen=True)
class Policy:
    """A document goes if it fails a rule of ``hard``, or at least ``soft_limit`` rules of ``soft``."""

    version: str
    hard: int
    soft: int = 0
    soft_limit: int = 1


BASE = Policy("base-1", BIT["too_short"] | BIT["repeated_words"])
PRODUCTION = Policy("production-1", (1 << len(RULES)) - 1)


def repeated_words(w: Column) -> Column:
    """How many words lie in windows of WINDOW words that the array w holds twice or more."""
    starts = F.sequence(F.lit(0), F.size(w) - WINDOW)
    hashes = F.transform(starts, lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)]))

    def covered(h: Column) -> Column:
        by_hash = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        twice = let(
            by_hash,
            lambda s: F.filter(
                F.transform(
                    s,
                    lambda x, j: F.when((F.get(s, j - 1)["h"] == x["h"]) | (F.get(s, j + 1)["h"] == x["h"]), x["i"]),
                ),
                lambda i: i.isNotNull(),
            ),
        )
        # Windows cover WINDOW words each, less what the next window covers too.
        return let(
            F.array_sort(twice),
            lambda p: F.aggregate(
                F.transform(p, lambda i, j: F.least(F.lit(WINDOW), F.coalesce(F.get(p, j + 1) - i, F.lit(WINDOW)))), F.lit(0), lambda a, x: a + x
            ),
        )

    counted = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(F.lit(0)))
    return F.when(F.size(w) > WINDOW, counted).otherwise(F.lit(0))


def measures(text: Column) -> Column:
    """All measurements of a text as one struct of longs; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    of_words = let(
        words(text),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            repeated_words(w).cast("long").alias("n_repeat_words"),
        ),
    )
    of_lines = let(
        lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))
    )
    return F.struct(
        of_words.alias("w"),
        of_lines.alias("l"),
        F.size(F.regexp_extract_all(text, F.lit("[#*$%&|<>]"), F.lit(0))).cast("long").alias("n_symbols"),
        (F.length(text) - F.length(F.replace(text, F.lit("!"), F.lit("")))).cast("long").alias("n_exclaims"),
    )


def evaluated(docs: DataFrame, carried: Column) -> DataFrame:
    """A carried column, the measurements of text, and fail_bits: the one place where rules are evaluated."""
    taken = docs.select(carried, measures(F.col("text")).alias("m"))
    taken = taken.select(taken.columns[0], "m.w.n_words", "m.w.word_chars", "m.n_symbols", "m.l.n_dup_lines", "m.w.n_repeat_words", "m.l.n_lines", "m.n_exclaims")
    bits = sum((F.when(F.expr(rule), F.lit(1 << i)).otherwise(F.lit(0)) for i, (_, rule) in enumerate(RULES)), F.lit(0))
    return taken.withColumn("fail_bits", bits.cast("long"))


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, the measurements and fail_bits, one row for each row of docs (doc_id, text; other columns are ignored).

    Null, empty and blank texts have no words and fail too_short. Words are runs of characters other than space and
    tab to carriage return; a line counts if it has a word; repeated rows are judged each for itself; an empty table
    gives an empty ledger.
    """
    return evaluated(docs, F.col("doc_id"))


def failed(policy: Policy, bits: Column | None = None) -> Column:
    bits = F.col("fail_bits") if bits is None else bits
    soft = F.bit_count(bits.bitwiseAND(F.lit(policy.soft).cast("long"))) >= policy.soft_limit
    return (bits.bitwiseAND(F.lit(policy.hard).cast("long")) != 0) | (F.lit(policy.soft != 0) & soft)


def apply_policy(entries: DataFrame, policy: Policy = PRODUCTION) -> DataFrame:
    """entries of a ledger with base_failed, kept and policy."""
    base = failed(BASE)
    return entries.withColumns({"base_failed": base, "kept": ~base & ~failed(policy), "policy": F.lit(policy.version)})


def ablation(entries: DataFrame, policy: Policy = PRODUCTION) -> DataFrame:
    """For each rule of a policy: n_failed, n_only (fail no other hard rule), n_kept, n_kept_without, any_bits.

    Documents are first counted by their bits, of which there are few combinations; the rest is arithmetic on those
    counts. any_bits is the union of the bits of the documents that fail the rule: what it coincides with.
    """
    by_bits = entries.groupBy("fail_bits").agg(F.count("*").alias("n"))
    rules = F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(b).cast("long").alias("bit")) for n, b in BIT.items() if policy.hard & b]))
    hard = F.col("fail_bits").bitwiseAND(F.lit(policy.hard).cast("long"))
    has = F.col("fail_bits").bitwiseAND(F.col("r.bit")) != 0
    without = hard.bitwiseAND(F.bitwise_not(F.col("r.bit")))
    count = lambda c: F.sum(F.when(c, F.col("n")).otherwise(F.lit(0)))
    return by_bits.withColumn("r", rules).groupBy(F.col("r.rule").alias("rule")).agg(
        count(has).alias("n_failed"), count(hard == F.col("r.bit")).alias("n_only"), count(hard == 0).alias("n_kept"),
        count(without == 0).alias("n_kept_without"), F.bit_or(F.when(has, F.col("fail_bits")).otherwise(F.lit(0).cast("long"))).alias("any_bits"),
    )


def keep(docs: DataFrame, policy: Policy = PRODUCTION) -> DataFrame:
    """The rows of docs, with all their columns, that pass the policy. For a pipeline: no join, no shuffle."""
    judged = evaluated(docs, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return judged.where(~failed(BASE) & ~failed(policy)).select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = ledger(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return apply_policy(entries).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "fail_bits")


def oracle(table: str) -> str:
    """The ledger and the production policy in DuckDB SQL, over any table with doc_id (unique) and text."""
    return rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM {table}),
w AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '[ \x09-\x0D]+'), lambda x: x <> '') AS w FROM t),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS g FROM w, unnest(range(1, len(w) - 3)) u(i)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win) WHERE n > 1),
cover AS (SELECT doc_id, CAST(sum(least(5, coalesce(nxt - i, 5))) AS BIGINT) AS n_repeat_words
  FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM rep) GROUP BY doc_id),
lines AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM t),
m AS (SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
  CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(length(text) - length(replace(text, '!', '')) AS BIGINT) AS n_exclaims,
  CAST(len(l) AS BIGINT) AS n_lines, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
  coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM w JOIN lines USING (doc_id) LEFT JOIN cover USING (doc_id)),
b AS (SELECT *, CAST(CASE WHEN n_words < 10 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END
  + CASE WHEN 10 * n_symbols > 3 * n_words THEN 4 ELSE 0 END + CASE WHEN 10 * n_exclaims > 3 * n_words THEN 8 ELSE 0 END
  + CASE WHEN 100 * n_dup_lines > 60 * n_lines THEN 16 ELSE 0 END
  + CASE WHEN word_chars < 2 * n_words OR word_chars > 25 * n_words THEN 32 ELSE 0 END AS BIGINT) AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, fail_bits & 3 <> 0 AS base_failed,
  fail_bits = 0 AS kept, fail_bits FROM b
"""


ORACLE_SQL = oracle("documents")
