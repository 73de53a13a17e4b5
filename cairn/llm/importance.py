"""Resampling towards a target distribution by importance: hashed n-grams, log gains and Gumbel draws.

Features are runs of 1 to NGRAM words; a feature's bucket is the CRC-32 of its UTF-8 bytes modulo BUCKETS. Texts are
reduced to their words with one space after each, once; running CRCs of that are stored, and the CRC of any run of words
comes from two of them (``prefix_crc``), so that no feature is ever put together. Buckets are counted over the whole
corpus and the whole target. A document's weight is the mean gain of its features; with Gumbel noise from a hash of its
id added, the highest scores are a draw without replacement in proportion to the exponential of the weights.

Scale: a task sends one row for each bucket that it has met. Texts are read twice and not shuffled. Scores are integers
in a range that the logarithms bound, so that their histogram tells the score of the last document drawn; only documents
from that on are sorted, by range, and numbered by one offset for each partition.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.llm.common import carried, materialize, pieces, unused
from cairn.llm.prefix_crc import PrefixCrc
from cairn.llm.text_arrays import raw_texts

NGRAM = 1
BUCKETS = 10_000
SEED = 2024
PERCENT = 10
LEAST_WORDS = 20
ADDED = ("n_features", "weight", "score", "rank")
#: Bytes of text that are worked on at once, but for one longer text.
BLOCK_BYTES = 1 << 18

_WORD = np.zeros(256, dtype=bool)
_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def blocks(texts: list[bytes | None]) -> Iterator[list[bytes]]:
    held, size = [], 0
    for text in texts:
        text = text or b""
        if held and size + len(text) > BLOCK_BYTES:
            yield held
            held, size = [], 0
        held.append(text)
        size += len(text)
    if held:
        yield held


def buckets_of(texts: list[bytes], ngram: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The buckets of all features, in the order of texts, and the number of features and of words in each text.

    Features of a text come by length, those of one word first.
    """
    raw = np.frombuffer((b" " + b" ".join(texts) + b" ").lower(), dtype=np.uint8)  # of bytes, lower() changes A-Z only
    word = _WORD[raw]
    firsts = np.flatnonzero(word[1:] & ~word[:-1]) + 1
    bounds = np.cumsum([1, *(len(t) + 1 for t in texts)])
    counts = np.diff(np.searchsorted(firsts, bounds))
    kept = word.copy()
    kept[1:] |= word[:-1]  # a word and the separator after it
    normal = np.where(word, raw, 0x20).astype(np.uint8)[kept]
    ends = np.flatnonzero(normal == 0x20)
    starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
    running, text = PrefixCrc(normal), np.repeat(np.arange(len(texts)), counts)
    found, of = [], []
    for n in range(1, ngram + 1):
        at = np.arange(len(ends) - n + 1) if len(ends) >= n else np.zeros(0, dtype=np.int64)
        at = at[text[at] == text[at + n - 1]]
        found.append(running.spans(starts[at], ends[at + n - 1]) % np.uint32(buckets))
        of.append(text[at])
    order = np.argsort(np.concatenate(of), kind="stable") if ngram > 1 else slice(None)
    return np.concatenate(found)[order].astype(np.int64), np.bincount(np.concatenate(of), minlength=len(texts)), counts


def bucket_counts(texts: DataFrame, ngram: int, buckets: int) -> np.ndarray:
    """How many features of all texts (one column) fall into each bucket."""
    name = texts.columns[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in pieces(batches, name):
            for block in blocks(raw_texts(batch[name])):
                total += np.bincount(buckets_of(block, ngram, buckets)[0], minlength=buckets)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(total[met])], names=["bucket", "n"])

    out = np.zeros(buckets, dtype=np.int64)
    for r in texts.mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # a row for each bucket
        out[r["bucket"]] = r["n"]
    return out


def gains_of(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln of the smoothed ratio of target to source) for each bucket."""
    n, s, t = len(source), float(source.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((b + 1.0) * (s + n) / ((a + 1.0) * (t + n)))) for a, b in zip(source.tolist(), target.tolist(), strict=True)], dtype=np.int64)


def weighed(docs: DataFrame, text: str, gains: np.ndarray, ngram: int, keep: list[str], names: list[str]) -> DataFrame:
    """The columns keep of docs with the numbers of words and of features, and the floored mean gain of these."""
    sent = docs.sparkSession.sparkContext.broadcast(gains)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text):
            words, sizes, means = [], [], []
            for block in blocks(raw_texts(batch[text])):
                found, n, counts = buckets_of(block, ngram, len(sent.value))
                upto = np.concatenate([[0], np.cumsum(sent.value[found])])
                last = np.cumsum(n)
                words.append(counts)
                sizes.append(n)
                means.append((upto[last] - upto[last - n]) // np.maximum(n, 1))
            if words:
                yield pa.RecordBatch.from_arrays([*(batch[c] for c in keep), *(pa.array(np.concatenate(x).astype(np.int64)) for x in (words, sizes, means))], names=[*keep, *names])

    fields = [T.StructField(f.name, f.dataType) for f in docs.schema.fields if f.name in keep]
    return docs.select(*[F.col(f"`{c}`") for c in [*keep, text]]).mapInArrow(run, T.StructType([*fields, *(T.StructField(n, T.LongType()) for n in names)]))


def resample(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", ngram: int = NGRAM, buckets: int = BUCKETS, seed: int = SEED, percent: int = PERCENT, least_words: int = LEAST_WORDS, keep: Iterable[str] | None = None) -> DataFrame:
    """n_features, weight, score and rank, a row for each row of docs, with the columns ``keep`` of docs.

    docs and target have text; words are runs of digits, a to z (A-Z lower-cased) and characters beyond ASCII. Null and
    blank texts have no features and weight 0. Of the documents with ``least_words`` words, ``percent`` in a hundred,
    rounded down, are drawn: those with the highest scores, ties to the smaller doc_id, null ids last; equal rows have
    different ranks. rank is null for all others. A null id hashes like an empty one. An empty target or corpus counts as
    no features. keep is all columns but text if not given; columns with the names of results are replaced.
    """
    keep = carried(docs, "text", *ADDED) if keep is None else list(keep)
    text = unused("text", keep)
    words, size, weight, score, at, key = (unused(x, keep) for x in ("n_words", "n_features", "weight", "score", "at", "key"))
    source = docs.select(*[F.col(f"`{c}`") for c in keep], F.col("text").alias(text), F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit("")).alias(key), F.col(f"`{doc_id}`").alias(at))
    gains = gains_of(bucket_counts(docs.select("text"), ngram, buckets), bucket_counts(target.select("text"), ngram, buckets))
    rows = weighed(source, text, gains, ngram, [*keep, key, at], [words, size, weight])
    drawn = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key)), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((drawn + 0.5) / F.lit(4294967296.0))))
    rows = materialize(rows.withColumn(score, (F.col(weight) + noise).cast("long")), "scores")
    own = [*[F.col(f"`{c}`") for c in keep], F.col(size).alias("n_features"), F.col(weight).alias("weight"), F.col(score).alias("score")]
    long_enough = F.col(words) >= least_words
    levels = rows.where(long_enough).groupBy(score).count().collect()  # scores are from about -40,000 to 60,000
    wanted, least = percent * sum(r["count"] for r in levels) // 100, None
    left = wanted
    for r in sorted(levels, key=lambda r: -r[score]):
        if left <= 0:
            break
        least, left = r[score], left - r["count"]
    if least is None:
        return rows.select(*own, F.lit(None).cast("long").alias("rank"))
    ahead = long_enough & (F.col(score) >= least)
    row = unused("row", [*keep, words, size, weight, score, at, key])
    # Rows that are alike in all else are told apart by where they were read, so that they are no hot range.
    sorted_ = rows.where(ahead).withColumn(row, F.monotonically_increasing_id()).orderBy(F.col(score).desc(), F.col(at).asc_nulls_last(), row)
    numbered = materialize(sorted_.withColumn(row, F.monotonically_increasing_id()), "drawn")
    part = F.shiftright(F.col(row), 33)
    offsets, before = [], 0
    for r in sorted(numbered.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()):  # a row for each partition
        offsets.append((r["p"], before))
        before += r["n"]
    before_of = F.broadcast(docs.sparkSession.createDataFrame(offsets, "__part long, __before long"))
    place = (F.col("__before") + F.col(row).bitwiseAND((1 << 33) - 1) + 1).cast("long")
    ranked = numbered.join(before_of, part == F.col("__part")).select(*own, F.when(place <= wanted, place).alias("rank"))
    return ranked.union(rows.where(~ahead).select(*own, F.lit(None).cast("long")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, target = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return resample(docs.select("doc_id", "text"), target.select("text"))


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE_SQL = rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS words FROM documents),
f AS (SELECT doc_id, unnest(words) AS w FROM d),
b AS (SELECT unnest({_WORDS}) AS w FROM benchmark),
bytes AS (SELECT w, hex(encode(w)) AS x FROM (SELECT w FROM f UNION SELECT w FROM b)),
crc AS (
  SELECT w, xor(list_reduce(
    list_prepend(4294967295, list_transform(range(0, len(x) // 2), lambda i: ('0x' || substr(x, 2 * i::INTEGER + 1, 2))::BIGINT)),
    lambda c, y: list_reduce(list_prepend(xor(c, y), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda s, z: xor(s >> 1, 3988292384 * (s & 1)))), 4294967295) % 10000 AS bucket
  FROM bytes),
s AS (SELECT bucket, count(*) AS n FROM f JOIN crc USING (w) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS n FROM b JOIN crc USING (w) GROUP BY bucket),
gains AS (
  SELECT bucket, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT count(*) FROM f) + 10000)
    / ((s.n + 1)::DOUBLE * ((SELECT count(*) FROM b) + 10000))))::BIGINT AS gain
  FROM s LEFT JOIN t USING (bucket)),
weights AS (
  SELECT doc_id, count(*) AS n_features, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight
  FROM f JOIN crc USING (w) JOIN gains USING (bucket) GROUP BY doc_id),
scores AS (
  SELECT doc_id, len(words)::BIGINT AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0)
    + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM d LEFT JOIN weights USING (doc_id)),
ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place FROM scores WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score,
  CASE WHEN place <= (SELECT 10 * count(*) // 100 FROM ranked) THEN place END AS rank
FROM scores LEFT JOIN ranked USING (doc_id)
"""
