"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence matrix.

A document's row holds its distinct 5-word shingles; rows that are equal are one class. Two classes link at a Jaccard
similarity of THRESHOLD per cent. All columns are put in one order, rare ones first by a table of counts over the
whole corpus, and a row's prefix is its first columns, so many that two rows that link must share one. The shuffle
by column deals the prefixes to blocks; within a column, pairs of rows meet, and are dropped if their sizes, or what
is left of them behind that column, forbid a link. For the others the overlap of their prefixes is counted, which
bounds the whole overlap: pairs whose bound is below what their sizes ask for are discarded. For the rest the overlaps
of their rows are counted in BLOCKS blocks of columns, which are added up by pair.

Scale: only components are asked for, so that pairs inside a component are never made. Star rounds come first: in
each column, every row meets one or two hubs, which is linear in the index, and verified links join components. The
product of all pairs is made across components only, which after the stars are few; star rounds go on while it would
be large and they make it smaller. If they help no more, the product is made in slices, none of which meets many more
pairs than WORK_PER_ROW for each row of the index (more for a small index), and only its verified links are kept. Equal rows are indexed once in
each task; the order's table has a fixed size whatever the corpus. Whether a column is shared is first seen within a
task; rows that are alone in theirs ask an aggregate of the column.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.common import materialize, pieces, release
from cairn.llm.components import components
from cairn.llm.text_arrays import raw_texts, shingle_sets

WIDTH = 5
THRESHOLD = 75
#: Counters of the columns' order: 16 MB in all, in rows of CHUNK counters.
COUNTERS = 1 << 22
CHUNK = 1 << 12
#: Bits of the table of documents whose full rows are asked for: 8 MB. It only spares work; more documents than an eighth of it are joined instead.
ASKED_BITS = 1 << 26
#: Blocks of columns (a power of two) in which the overlaps of full rows are counted.
BLOCKS = 4
#: Rows of the index that a task compares before it passes them on, and classes that it remembers at once.
FLUSH_ROWS = 1 << 19
REMEMBERED = 1 << 20
#: In star rounds after the first, into how many classes (a power of two) columns fall whose hubs differ, and the noise in choosing.
STAR_CLASSES, STAR_NOISE = 4, 16
#: Star rounds go on while the product would meet more pairs than so many for each row of the index, and they help.
WORK_PER_ROW = 8
#: A small index takes up to WORK_PER_ROW times as many, until a slice has so many: a slice of few pairs is mostly the start of its jobs.
LEAST_WORK = 1 << 24
HELP = 0.8
#: Rows of two numbers that a full row counts as, where tasks are dealt.
FULL_ROW = 256
#: Rows of two numbers that are broadcast at most; more are joined.
FEW = 1 << 20


def class_key(tokens: np.ndarray) -> int:
    """A 64-bit name of a set of shingles."""
    return xxhash.xxh64_intdigest(tokens.tobytes(), len(tokens)) - (1 << 63)


def prefix_length(n, threshold: int = THRESHOLD):
    """Of n sorted columns, so many that two rows that link have one in common."""
    return n - -(-threshold * n // 100) + 1


def counter_of(tokens: np.ndarray) -> np.ndarray:
    return (tokens & np.uint64(COUNTERS - 1)).astype(np.int64)


def survey(width: int):
    """A function for mapInArrow: a row for each document, and at the end this task's counters, compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = np.zeros(COUNTERS, dtype=np.int64)
        for piece in pieces(batches, "text"):
            sets = [tokens for _, tokens in shingle_sets(raw_texts(piece["text"]), width)]
            np.add.at(counters, counter_of(np.concatenate(sets)), 1)
            none = [None] * len(sets)
            yield pa.RecordBatch.from_arrays(
                [piece["doc_id"], piece["text_hash"], pa.array([len(t) for t in sets], pa.int64()), pa.array([class_key(t) if len(t) else None for t in sets], pa.int64()), pa.array(none, pa.int32()), pa.array(none, pa.binary())],
                names=SURVEYED,
            )
        parts = [(i, pa.compress(p.tobytes(), codec="zstd", asbytes=True)) for i, p in enumerate(counters.reshape(-1, CHUNK)) if p.any()]
        none = pa.array([None] * len(parts), pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, none, none, pa.array([i for i, _ in parts], pa.int32()), pa.array([c for _, c in parts], pa.binary())], names=SURVEYED)

    return run


SURVEYED = ["doc_id", "text_hash", "n", "key", "chunk", "counts"]


def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds up rows of counters, up to the most of 31 bits; holds one row for each chunk."""
    totals: dict[int, np.ndarray] = {}
    for batch in batches:
        for chunk, counts in zip(batch["chunk"].to_pylist(), batch["counts"], strict=True):
            part = np.frombuffer(pa.decompress(counts.as_buffer(), decompressed_size=8 * CHUNK, codec="zstd"), dtype=np.int64)
            totals[chunk] = totals[chunk] + part if chunk in totals else part
    packed = [np.minimum(t, (1 << 31) - 1).astype(np.int32).tobytes() for t in totals.values()]
    yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.int32()), pa.array(packed, pa.binary())], names=["chunk", "counts"])


def order_table(surveyed: DataFrame) -> bytes:
    """The counters over all documents, COUNTERS numbers of 32 bits."""
    parts = surveyed.where("chunk is not null").select("chunk", "counts").repartition("chunk").mapInArrow(summed, "chunk int, counts binary").collect()
    table = np.zeros((COUNTERS // CHUNK, CHUNK), dtype=np.int32)
    for row in parts:
        table[row["chunk"]] = np.frombuffer(row["counts"], dtype=np.int32)
    return table.tobytes()


def prefixes(width: int, threshold: int, counters):
    """A function for mapInArrow: token, key, n, at (position from 1) for the prefix of each class that the task sees.

    Of a column's rows that a task sees together, all but one have a salt, and all are ``shared``.
    """

    def indexed(parts: list[tuple]) -> pa.RecordBatch:
        tokens = np.concatenate([t for t, _, _ in parts]).view(np.int64)
        lengths = [len(t) for t, _, _ in parts]
        keys = np.repeat(np.array([k for _, k, _ in parts]), lengths)
        _, firsts, back, counts = np.unique(tokens, return_index=True, return_inverse=True, return_counts=True)
        shared = counts[back] > 1
        salts = np.where(shared, 1 + (keys & 0xFFFF), 0)
        salts[firsts] = 0
        at = np.concatenate([np.arange(1, p + 1) for p in lengths])
        columns = [tokens, keys, np.repeat([n for _, _, n in parts], lengths), at, salts.astype(np.int32), shared]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["token", "key", "n", "at", "salt", "shared"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, seen, parts, held = np.frombuffer(counters.value, dtype=np.int32), set(), [], 0
        for piece in pieces(batches, "text"):
            for _, tokens in shingle_sets(raw_texts(piece["text"]), width):
                n = len(tokens)
                key = class_key(tokens) if n else None
                if not n or key in seen:
                    continue
                seen.add(key)
                order = np.lexsort((tokens, table[counter_of(tokens)]))
                parts.append((tokens[order[: prefix_length(n, threshold)]], key, n))
                held += len(parts[-1][0])
                if held >= FLUSH_ROWS:
                    yield indexed(parts)
                    parts, held = [], 0
            if len(seen) > REMEMBERED:
                seen = set()
        if parts:
            yield indexed(parts)

    return run


def bit_table(asked: DataFrame, slot: Column) -> bytes:
    """A bit for each slot of ASKED_BITS that a document in asked (doc_id) has; Spark counts bits from 1."""
    made = asked.select((slot + 1).alias("slot")).groupBy(F.bitmap_bucket_number("slot").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits"))
    table = bytearray(ASKED_BITS // 8)
    for row in made.collect():
        at = (row["bucket"] - 1) * 4096
        table[at : at + 4096] = row["bits"]
    return bytes(table)


def full_rows(texts: DataFrame, asked: DataFrame, width: int) -> DataFrame:
    """key, block and tokens of the documents in asked (doc_id), and perhaps of a few others that the bit table lets through."""
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(ASKED_BITS))
    few = asked.count() <= ASKED_BITS // 8
    sent = texts.sparkSession.sparkContext.broadcast(bit_table(asked, slot) if few else None)
    edges = np.arange(BLOCKS, dtype=np.uint64) << np.uint64(65 - BLOCKS.bit_length())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(sent.value, dtype=np.uint8) if few else None
        for piece in pieces(batches, "text"):
            if few:
                at = piece["slot"].to_numpy()
                piece = piece.filter(pa.array((bits[at >> 3] >> (at & 7)) & 1 != 0))
            rows = {class_key(t): t for _, t in shingle_sets(raw_texts(piece["text"]), width) if len(t)} if piece.num_rows else {}
            if not rows:
                continue
            ends = np.array([[*np.searchsorted(t, edges), len(t)] for t in rows.values()])
            sizes = np.diff(ends, axis=1).ravel()
            tokens = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(np.concatenate(list(rows.values())).view(np.int64)))
            found = pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(list(rows)), BLOCKS)), pa.array(np.tile(np.arange(BLOCKS, dtype=np.int32), len(rows))), tokens], names=["key", "block", "tokens"])
            yield found.filter(pa.array(sizes > 0))

    wanted = texts.where("doc_id is not null")
    wanted = wanted if few else wanted.join(asked.distinct(), "doc_id", "left_semi")
    return wanted.select(slot.alias("slot"), "text").mapInArrow(run, "key long, block int, tokens array<long>")


def shared_columns(index: DataFrame) -> DataFrame:
    """The rows of columns that two classes or more have in their prefixes.

    Rows that met another one in their task are in; the others ask for their column's least and largest key, which are
    aggregated before the shuffle, so that no column's rows come together in one task.
    """
    index = materialize(index, "prefixes")
    ends = index.where("salt = 0").groupBy("token").agg(F.min("key").alias("low"), F.max("key").alias("high"), F.max("shared").alias("known"))
    several = ends.where("known or low <> high").select("token")
    rows = index.where("shared").union(index.where("not shared").join(several, "token", "left_semi").select(*index.columns))
    found = materialize(rows.select("token", "key", "n", "at").distinct(), "index", rows=index.count())
    release(index)
    return found


def sizes_allow(a: Column, b: Column, threshold: int) -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * threshold


def needed(a: Column, b: Column, threshold: int) -> Column:
    """The least overlap of two rows of these sizes that link."""
    return F.ceil(threshold * (a + b) / F.lit(100 + threshold))


def rest(n: Column, threshold: int) -> Column:
    """How many columns of a row of n are behind its prefix."""
    return F.ceil(F.lit(threshold) * n / F.lit(100)) - 1


def possible(shared: Column, a: Column, b: Column, threshold: int) -> Column:
    """Whether rows of a and b columns that share so many of their prefixes can link.

    One of the prefixes ends before the other; what its row shares beyond ``shared`` is behind that prefix.
    """
    return shared + F.greatest(rest(a, threshold), rest(b, threshold)) >= needed(a, b, threshold)


def sent(rows: DataFrame) -> DataFrame:
    """A table of keys for a join, broadcast if it is small."""
    return F.broadcast(rows) if rows.count() <= FEW else rows


def keys_in(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("key")).union(pairs.select("b")).distinct()


def bounded(pairs: DataFrame, sketches: DataFrame, threshold: int) -> DataFrame:
    """Of pairs (a, b), those whose overlap in the index leaves a link possible, with their sizes na and nb."""
    sketches = sketches.join(sent(materialize(keys_in(pairs), "pair-keys", rows=2 * pairs.count())), "key", "left_semi")
    left, right = sketches.toDF("a", "na", "sa"), sketches.toDF("b", "nb", "sb")
    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "na", "nb", F.size(F.array_intersect("sa", "sb")).alias("shared"))
    return joined.where(possible(F.col("shared"), F.col("na"), F.col("nb"), threshold)).select("a", "b", "na", "nb")


def verified(pairs: DataFrame, texts: DataFrame, classes: DataFrame, width: int, threshold: int) -> DataFrame:
    """Of pairs (a, b, na, nb), those whose full rows link: their overlaps are added up over blocks of columns."""
    pairs = materialize(pairs, "pairs")
    met = pairs.count()
    keys = materialize(keys_in(pairs), "keys", rows=2 * met)
    asked = materialize(classes.join(sent(keys), "key").select(F.col("rep").alias("doc_id")), "asked")
    # Written once they are distinct, so that Spark can split the pairs of a hub in the joins.
    found = full_rows(texts, asked, width).join(sent(keys), "key", "left_semi").dropDuplicates(["key", "block"])
    rows = materialize(found, "rows", rows=FULL_ROW * keys.count())
    left, right = rows.toDF("a", "block", "ta"), rows.toDF("b", "block", "tb")
    product = pairs.join(left, "a").join(right, ["b", "block"]).select("a", "b", "na", "nb", F.size(F.array_intersect("ta", "tb")).alias("both"))
    overlaps = product.groupBy("a", "b", "na", "nb").agg(F.sum("both").alias("both"))
    links = materialize(overlaps.where(f"100 * both >= {threshold} * (na + nb - both)").select("a", "b"), "verified", rows=met)
    release(pairs, keys, asked, rows)
    return links


def labelled(index: DataFrame, links: DataFrame) -> DataFrame:
    """The index's rows with their component."""
    joined = components(links)
    named = index.join(sent(joined.withColumnRenamed("node", "key")), "key", "left").withColumn("component", F.coalesce("component", "key"))
    named = materialize(named, "labelled")
    release(joined)
    return named


def split_columns(rows: DataFrame) -> DataFrame:
    """The columns that hold two components or more: token, main (the largest), and the work of a product of all others with all."""
    counts = rows.groupBy("token", "component").agg(F.count("*").alias("size"))
    columns = counts.groupBy("token").agg(F.max_by("component", F.struct("size", "component")).alias("main"), F.sum("size").alias("n"), F.max("size").alias("top"), F.count("*").alias("parts"))
    return columns.where("parts > 1").select("token", "main", ((F.col("n") - F.col("top")) * F.col("n")).alias("work"))


def first_in_common(n: Column, at: Column, m: Column, there: Column, threshold: int) -> Column:
    """Whether rows of n and m columns can link whose first common column has these positions in them."""
    return sizes_allow(n, m, threshold) & (F.least(n - at, m - there) + 1 >= needed(n, m, threshold))


def star_pairs(rows: DataFrame, salt: int, threshold: int) -> DataFrame:
    """Each row with its column's two hubs: a central row, and any other one.

    Edited copies have columns of their own, which are rare and so come first: the row in which a column comes earliest
    is the one that is most like all others. Noise and classes vary the choice from round to round.
    """
    order, rank = F.col("key"), F.col("at")
    if salt:
        order = F.xxhash64("key", F.lit(salt), F.col("token").bitwiseAND(F.lit(STAR_CLASSES - 1).cast("long")))
        rank = rank + F.pmod(order, F.lit(STAR_NOISE))
    row = ["key", "n", "at", *(["component"] if salt else [])]
    hubs = rows.groupBy("token").agg(F.min(F.struct(rank.alias("rank"), order.alias("order"), *row)).alias("central"), F.max(F.struct(order.alias("order"), *row)).alias("other"))
    hubs = hubs.select("token", F.explode(F.array(*[F.struct(*[F.col(f"{h}.{c}").alias(c) for c in row]) for h in ("central", "other")])).alias("hub"))
    met = rows.join(hubs, "token").where(F.col("component") != F.col("hub.component") if salt else F.col("key") != F.col("hub.key"))
    met = met.where(first_in_common(F.col("n"), F.col("at"), F.col("hub.n"), F.col("hub.at"), threshold))
    return met.select(F.least("key", "hub.key").alias("a"), F.greatest("key", "hub.key").alias("b")).distinct()


def product_pairs(rows: DataFrame, columns: DataFrame, threshold: int, slices: int = 1, which: int = 0) -> DataFrame:
    """Pairs across components that a column's positions allow: the first common column of two that link does.

    Of two rows in different components one is outside the column's largest component, so those few meet all rows. Of
    them a slice is taken by hash; all slices together give all pairs.
    """
    split = rows.join(columns.select("token", "main"), "token")
    mine = (F.col("component") != F.col("main")) & (F.pmod(F.xxhash64("key", "token"), F.lit(slices)) == which)
    x = split.where(mine).select("token", F.col("key").alias("a"), F.col("n").alias("na"), F.col("at").alias("pa"), F.col("component").alias("ca"))
    y = split.select("token", F.col("key").alias("b"), F.col("n").alias("nb"), F.col("at").alias("pb"), F.col("component").alias("cb"))
    met = x.join(y, "token").where("ca <> cb").where(first_in_common(F.col("na"), F.col("pa"), F.col("nb"), F.col("pb"), threshold))
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def slices_of(work: int, n_rows: int) -> int:
    """Slices of a product of so many pairs, over an index of n_rows."""
    least = WORK_PER_ROW * max(n_rows, 1)
    return max(1, math.ceil(work / max(least, min(LEAST_WORK, WORK_PER_ROW * least))))


def jaccard_components(docs: DataFrame, width: int = WIDTH, threshold: int = THRESHOLD, text_hash: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of docs (doc_id, text; other columns are ignored).

    Words are A-Z lower-cased runs without white space. A text with fewer than ``width`` words is one shingle; null,
    empty and blank texts have none and link with nothing. component_id is the smallest doc_id reachable by links.
    text_hash adds a column so named, xxhash64 of the text, which tells rows with one doc_id and several texts apart.
    Repeated rows are equal and in one component; a row with a null doc_id has no component and links nothing. An
    empty table gives an empty result. Shingles and sets are compared by 64-bit hash.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    surveyed = materialize(texts.mapInArrow(survey(width), "doc_id long, text_hash long, n long, key long, chunk int, counts binary"), "survey")
    rows = surveyed.where("chunk is null").select("doc_id", "text_hash", "n", "key")
    counters = spark.sparkContext.broadcast(order_table(surveyed))
    classes = rows.where("n > 0 and doc_id is not null").groupBy("key").agg(F.min("doc_id").alias("rep"))
    classes = materialize(classes, "classes", rows=surveyed.count())
    index = texts.where("doc_id is not null and text is not null").mapInArrow(prefixes(width, threshold, counters), "token long, key long, n long, at long, salt int, shared boolean")
    index = shared_columns(index)
    n_rows = index.count()
    sketches = materialize(index.groupBy("key").agg(F.max("n").alias("n"), F.collect_list("token").alias("tokens")), "sketches", rows=n_rows)

    def check(pairs: DataFrame, most: int) -> DataFrame:
        pairs = materialize(pairs, "candidates", rows=most)
        verified_links = verified(bounded(pairs, sketches, threshold), texts, classes, width, threshold)
        release(pairs)
        return verified_links

    links, before = [check(star_pairs(index, 0, threshold), 2 * n_rows)], None
    for salt in itertools.count(1):
        named = labelled(index, reduce(DataFrame.union, links))
        columns = materialize(split_columns(named), "columns", rows=n_rows)
        work = columns.agg(F.sum("work")).first()[0] or 0
        slices = slices_of(work, n_rows)
        last = slices == 1 or before is not None and work > HELP * before
        most = -(-work // slices)
        links += [check(product_pairs(named, columns, threshold, slices, i), most) for i in range(slices)] if last else [check(star_pairs(named, salt, threshold), 2 * n_rows)]
        before = work
        release(named, columns)
        if last:
            break
    joined = components(reduce(DataFrame.union, links))
    named = joined.withColumnRenamed("node", "key")
    ids = classes.join(named, "key", "left").select("key", "rep", F.coalesce("component", "key").alias("component"))
    least = ids.groupBy("component").agg(F.min("rep").alias("component_id"))
    ids = materialize(ids.join(least, "component").select("key", "component_id"), "component-ids")
    release(classes, index, sketches, joined, *links)
    return rows.join(ids, "key", "left").select(
        "doc_id", *["text_hash"] * text_hash, F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE_SQL = r"""
WITH RECURSIVE t AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
  'abcdefghijklmnopqrstuvwxyz'), '[ \x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM t, unnest(range(1, greatest(2, len(w) - 3))) u(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS hits FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * hits >= 75 * (a.n + b.n - hits)),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.y, r.c FROM r JOIN e ON e.x = r.doc_id)
SELECT r.doc_id, coalesce(max(n.n), 0) AS n_shingles, min(r.c) AS component_id FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id
"""
