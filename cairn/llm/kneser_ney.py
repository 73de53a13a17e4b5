"""Quality classifier: an interpolated modified Kneser-Ney model of characters, trained on trusted text.

Training. Runs of ORDER characters of all trusted texts are counted; the counts of shorter runs are
continuation counts, the number of different characters seen before them. Counts are joined with the totals of their
contexts by groupings and joins that Spark shards by run: for each run its own discounted share, and for each context
the weight that falls to the shorter order.

Scoring. Tasks pass on the distinct runs of their texts, dealt in shards by hash and made distinct again there. These are
joined by run with the counts of one order after the other, from the shortest up: a run's probability is its own share
and its context's weight times the probability of the run without its first character. A text's score is its mean
negative log2 probability of a character; its perplexity is 2 to the power of that. A text goes if the score exceeds the
UPPER quantile of trusted texts in its language that the model was not trained on.

Scale: tasks count the runs of their texts before these are shuffled, and the joins are over the distinct runs of the
corpus, which any number of texts share. Up to BROADCAST_RUNS of them the probabilities go to all tasks. If there are more, texts are packed in
chunks, which ask the shards for their distinct runs, and the answers meet their chunks again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.chunks import CHUNK_SCHEMA, chunked, cut, edges_of, joined, rows_of
from cairn.llm.common import materialize, pieces, release
from cairn.llm.text_arrays import mixed, powers
from cairn.operators.series import running_counts

ORDER = 5
UPPER = 0.995
#: One of so many trusted texts is left out of training, for the quantiles; fewer than LEAST_TRUSTED serve for both.
FOLDS = 4
LEAST_TRUSTED = 40
#: Languages whose thresholds are broadcast at most; more are joined.
LANGUAGES = 10_000
#: The start of a text. In a text this character is read as the one after it.
START = "\x02"
BLOCK_CHARS = 1 << 20
CHUNK_BYTES = 12 << 20
#: Runs whose probabilities are broadcast at most, 12 bytes each.
BROADCAST_RUNS = 1 << 21
#: Distinct runs that a task holds, and bytes of text for each shard of runs.
HELD_RUNS = 1 << 20
BYTES_PER_SHARD = 1 << 26


def single_spaced(text: Column) -> Column:
    return F.translate(F.regexp_replace(F.coalesce(text, F.lit("")), "[ \\x09-\\x0D]+", " "), START, chr(ord(START) + 1))


def discounts(counts: DataFrame) -> dict[int, list[float]]:
    """D1, D2 and D3+ of each order, from the counts of counts, by the usual estimates; kept inside (0, count)."""
    of = {(r["k"], r["c"]): r["n"] for r in counts.where("c <= 4").groupBy("k", "c").agg(F.count("*").alias("n")).collect()}
    out = {}
    for k in range(1, ORDER + 1):
        n = [max(1, of.get((k, c), 0)) for c in range(1, 5)]
        y = n[0] / (n[0] + 2 * n[1])
        out[k] = [min(max(i + 1 - (i + 2) * y * n[i + 1] / n[i], 0.05), i + 0.95) for i in range(3)]
    return out


def counts_of(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """k, gram and c: counts of runs of ORDER characters, and continuation counts of shorter runs; and the table to release once they are read."""
    runs = texts.select(single_spaced(F.col("text")).alias("text")).mapInArrow(task_counts, "gram string, c long")
    # Written once, as all shorter runs are counted from them.
    longest = table = materialize(runs.groupBy("gram").agg(F.sum("c").alias("c")).withColumn("k", F.lit(ORDER)), "kn-runs-of-texts")
    every = table
    for k in range(ORDER - 1, 0, -1):
        table = table.groupBy(F.substring("gram", 2, k).alias("gram")).agg(F.count("*").alias("c")).withColumn("k", F.lit(k))
        every = every.unionByName(table)
    return every.select("k", "gram", "c"), longest


def shares(counts: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """k, gram and own (its discounted share); k, context and weight (what the shorter order gets); size of the alphabet."""
    d = discounts(counts)
    alphabet = counts.where("k = 1").count() + 1
    split = counts.withColumns({"context": F.expr("substring(gram, 1, k - 1)"), "kind": F.least("c", F.lit(3))})
    discount = F.element_at(F.create_map(*[x for k, v in d.items() for i in range(3) for x in (F.lit(k * 10 + i + 1), F.lit(v[i]))]), F.col("k") * 10 + F.col("kind").cast("int"))
    split = split.withColumn("d", discount)
    totals = split.groupBy("k", "context").agg(F.sum("c").alias("total"), F.sum("d").alias("freed"))
    own = split.join(totals, ["k", "context"]).select("k", "gram", ((F.col("c") - F.col("d")) / F.col("total")).alias("own"))
    weights = totals.select("k", "context", (F.col("freed") / F.col("total")).alias("weight"))
    return materialize(own, "kn-own"), materialize(weights, "kn-weights"), alphabet


def run_probabilities(asked: DataFrame, own: DataFrame, weights: DataFrame, alphabet: int) -> DataFrame:
    """gram and p (of its last character) for the distinct runs of ORDER characters in asked (gram)."""
    below = None
    for k in range(1, ORDER + 1):
        wanted = asked if k == ORDER else asked.select(F.expr(f"substring(gram, {ORDER - k + 1}, {k})").alias("gram")).distinct()
        found = wanted.join(own.where(F.col("k") == k).select("gram", "own"), "gram", "left")
        found = found.withColumn("context", F.expr(f"substring(gram, 1, {k - 1})")).join(weights.where(F.col("k") == k).select("context", "weight"), "context", "left")
        if below is None:
            found = found.withColumn("q", F.lit(1.0 / alphabet))
        else:
            found = found.withColumn("suffix", F.expr(f"substring(gram, 2, {k - 1})")).join(below.select(F.col("gram").alias("suffix"), F.col("p").alias("q")), "suffix")
        below = found.select("gram", (F.coalesce("own", F.lit(0.0)) + F.coalesce("weight", F.lit(1.0)) * F.col("q")).alias("p"))
    return below


def run_hashes(codes: np.ndarray) -> np.ndarray:
    """At each position from ORDER - 1 on, the hash of the run of characters that ends there."""
    weights = powers(ORDER + 1)[1:]
    n = len(codes) - ORDER + 1
    total = np.zeros(max(0, n), dtype=np.uint64)
    for j in range(ORDER):
        total += codes[j : j + n] * weights[j]
    return mixed(total)


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def hashes_of(runs: str) -> np.ndarray:
    """The hashes of runs that stand one after the other."""
    return run_hashes(codes_of(runs).astype(np.uint64))[::ORDER] if runs else np.zeros(0, dtype=np.uint64)


def blocks(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    """Neighbouring texts of BLOCK_CHARS together, and the first one's number; a longer text is alone."""
    first, block, size = 0, [], 0
    for i, text in enumerate(texts):
        if block and size + len(text) > BLOCK_CHARS:
            yield first, block
            first, block, size = i, [], 0
        block.append(text)
        size += len(text)
    if block:
        yield first, block


def read_blocks(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For blocks of texts: their codes, where runs end, and the number of runs in each text."""
    for _, block in blocks(texts):
        codes = codes_of("".join(START * (ORDER - 1) + t for t in block))
        lengths = np.array([len(t) for t in block])
        starts = np.cumsum(lengths + ORDER - 1) - lengths
        yield codes, np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum()), lengths


class Distinct:
    """The distinct runs of texts and their counts, in the order of their hashes."""

    def __init__(self):
        self.hashes, self.runs, self.counts = np.zeros(0, dtype=np.uint64), np.zeros((0, ORDER), dtype=np.uint32), np.zeros(0, dtype=np.int64)

    def add(self, texts: list[str]) -> None:
        for codes, ends, _ in read_blocks(texts):
            found, firsts, counts = np.unique(run_hashes(codes.astype(np.uint64))[ends - ORDER + 1], return_index=True, return_counts=True)
            own = codes[ends[firsts][:, None] + np.arange(1 - ORDER, 1)]
            self.hashes, firsts, places = np.unique(np.concatenate([self.hashes, found]), return_index=True, return_inverse=True)
            self.runs = np.concatenate([self.runs, own])[firsts]
            before, self.counts = self.counts, np.zeros(len(firsts), dtype=np.int64)
            self.counts[places[: len(before)]] = before
            self.counts[places[len(before) :]] += counts

    def counted(self) -> pa.RecordBatch:
        """gram and c."""
        text = self.runs.tobytes().decode("utf-32-le", "surrogatepass")
        return pa.RecordBatch.from_arrays([pa.array([text[i : i + ORDER] for i in range(0, len(text), ORDER)], pa.string()), pa.array(self.counts)], names=["gram", "c"])

    def rows(self, chunk: int | None, shard_bits: int) -> pa.RecordBatch:
        """chunk, shard and runs one after the other, a row for each shard."""
        shards = self.hashes >> np.uint64(64 - shard_bits)
        found = np.unique(shards)
        edges = edges_of(shards, found).tolist()
        rows = [(s, self.runs[a:b].tobytes().decode("utf-32-le", "surrogatepass")) for s, a, b in zip(found.tolist(), edges[:-1], edges[1:], strict=True)]
        return pa.RecordBatch.from_arrays(
            [pa.array([chunk] * len(rows), pa.int64()), pa.array([s for s, _ in rows], pa.int32()), pa.array([r for _, r in rows], pa.string())], names=["chunk", "shard", "runs"]
        )


def task_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow: the distinct runs of a task's texts and their counts."""
    held = Distinct()
    for piece in pieces(batches, "text"):
        held.add(piece["text"].to_pylist())
        if len(held.hashes) > HELD_RUNS:
            yield held.counted()
            held = Distinct()
    yield held.counted()


ASKED = "chunk long, shard int, runs string"


def asked_by_tasks(shard_bits: int):
    """A function for mapInArrow: the distinct runs of a task's texts, without a chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Distinct()
        for piece in pieces(batches, "text"):
            held.add(piece["text"].to_pylist())
            if len(held.hashes) > HELD_RUNS:
                yield held.rows(None, shard_bits)
                held = Distinct()
        yield held.rows(None, shard_bits)

    return run


def asked_by_chunks(shard_bits: int):
    """A function for mapInArrow: the distinct runs of each chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, docs in zip(batch["chunk"].to_pylist(), batch["docs"], strict=True):
                held = Distinct()
                held.add(rows_of(docs.as_py())["text"].to_pylist())
                yield held.rows(chunk, shard_bits)

    return run


def distinct_runs(asking: pa.Table) -> pa.Table:
    """For applyInArrow over one shard: shard, hash and gram of the runs that chunks ask for, each once."""
    known: dict[int, str] = {}
    for runs in asking["runs"].to_pylist():
        known.update(zip(hashes_of(runs).view(np.int64).tolist(), (runs[i : i + ORDER] for i in range(0, len(runs), ORDER)), strict=True))
    shard = asking["shard"][0].as_py() if asking.num_rows else 0
    return pa.table({"shard": pa.array([shard] * len(known), pa.int32()), "hash": pa.array(list(known), pa.int64()), "gram": pa.array(list(known.values()), pa.string())})


def answered(asking: pa.Table, known: pa.Table) -> pa.Table:
    """For applyInArrow over one shard: the bits of the runs of each row of asking."""
    hashes, bits = known["hash"].to_numpy().astype(np.int64).view(np.uint64), known["bits"].to_numpy().astype(np.float64)
    order = np.argsort(hashes)
    hashes, bits = hashes[order], bits[order]
    out = [bits[np.searchsorted(hashes, hashes_of(runs))].astype(np.float32).tobytes() for runs in asking["runs"].to_pylist()]
    return pa.table({"chunk": asking["chunk"], "shard": asking["shard"], "bits": pa.array(out, pa.binary())})


SCORED = "doc_id long, lang string, n_chars long, bits double"


def sums_of(texts: list[str], hashes: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Characters and bits of each text, given the bits of the runs with these hashes, sorted."""
    sizes, sums = [np.zeros(0, dtype=np.int64)], [np.zeros(0)]
    for codes, ends, lengths in read_blocks(texts):
        own, back = np.unique(run_hashes(codes.astype(np.uint64))[ends - ORDER + 1], return_inverse=True)
        total = np.concatenate([[0.0], np.cumsum(bits[np.searchsorted(hashes, own)].astype(np.float64)[back])])
        ends = np.cumsum(lengths)
        sizes.append(lengths)
        sums.append(total[ends] - total[ends - lengths])
    return np.concatenate(sizes).astype(np.int64), np.concatenate(sums)


def scored_by_tasks(model):
    """A function for mapInArrow: the sums of each text, with the bits of all runs at hand."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text"):
            sizes, sums = sums_of(piece["text"].to_pylist(), *model.value)
            yield pa.RecordBatch.from_arrays([piece["doc_id"], piece["lang"], pa.array(sizes), pa.array(sums)], names=["doc_id", "lang", "n_chars", "bits"])

    return run


def scored_by_chunks(chunk: pa.Table, answers: pa.Table) -> pa.Table:
    """For applyInArrow over one chunk and its answers: the sums of each text."""
    rows = rows_of(chunk["docs"][0].as_py())
    texts, held = rows["text"].to_pylist(), Distinct()
    held.add(texts)
    sizes, sums = sums_of(texts, held.hashes, joined(answers.sort_by("shard")["bits"], np.float32)[0])
    return pa.table({"doc_id": rows["doc_id"], "lang": rows["lang"], "n_chars": sizes, "bits": sums})


def train(docs: DataFrame, trusted: DataFrame) -> tuple[DataFrame, DataFrame, int] | None:
    """The model of all texts in docs whose doc_id is in trusted: own shares, weights and the size of its alphabet.

    Of several texts of one doc_id the one with the least hash counts.
    """
    found = docs.select("doc_id", "text").where("text is not null and text <> ''").join(trusted, "doc_id", "left_semi")
    chosen = found.groupBy("doc_id").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    counts, longest = counts_of(chosen)
    counts = materialize(counts, "kn-counts")
    model = None if counts.isEmpty() else shares(counts)
    release(counts, longest)
    return model


def perplexities(docs: DataFrame, model: tuple[DataFrame, DataFrame, int] | None) -> DataFrame:
    """doc_id, lang, n_chars and score for each row of docs; null score for texts without a character."""
    taken = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), single_spaced(F.col("text")).alias("text"))
    if model is None:
        return taken.select("doc_id", "lang", F.length("text").cast("long").alias("n_chars"), F.lit(None).cast("double").alias("score"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0  # before white space is cut, as that costs more than it tells
    shard_bits = max(4, (size // BYTES_PER_SHARD).bit_length())
    asking = taken.select("text").mapInArrow(asked_by_tasks(shard_bits), ASKED)
    runs = materialize(asking.groupBy("shard").applyInArrow(distinct_runs, "shard int, hash long, gram string"), "kn-runs")
    known = materialize(runs.join(run_probabilities(runs.select("gram"), *model), "gram").select("shard", "hash", (-F.log2("p")).alias("bits")), "kn-bits")
    if known.count() <= BROADCAST_RUNS:
        table = known.select("hash", F.col("bits").cast("float").alias("bits")).toArrow()
        hashes = table["hash"].to_numpy().astype(np.int64).view(np.uint64)
        order = np.argsort(hashes)
        sent = docs.sparkSession.sparkContext.broadcast((hashes[order], table["bits"].to_numpy().astype(np.float32)[order]))
        sums = taken.mapInArrow(scored_by_tasks(sent), SCORED)
        read = []
    else:
        chunks = materialize(taken.mapInArrow(chunked(CHUNK_BYTES), CHUNK_SCHEMA), "kn-chunks")
        asking = chunks.mapInArrow(asked_by_chunks(shard_bits), ASKED)
        answers = asking.groupBy("shard").cogroup(known.groupBy("shard")).applyInArrow(answered, "chunk long, shard int, bits binary")
        sums = chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(scored_by_chunks, SCORED)
        read = [chunks]
    scores = materialize(sums.select("doc_id", "lang", "n_chars", F.when(F.col("n_chars") > 0, F.col("bits") / F.col("n_chars")).alias("score")), "kn-scores")
    release(runs, known, *read, *model[:2])
    return scores


def quantiles(judged: DataFrame, upper: float) -> DataFrame:
    """whole, lang and cut: of judged's scores (lang, score) the least that a share ``upper`` does not exceed, exactly, in each language and over the whole."""
    groups = F.array(F.struct(F.lit(True).alias("whole"), F.lit(None).cast("string").alias("lang")), F.struct(F.lit(False).alias("whole"), F.col("lang")))
    ranked = running_counts(judged.select("score", F.explode(groups).alias("g")).select("score", "g.*"), ["whole", "lang"], "score")
    return ranked.where(F.col("upto") >= F.ceil(F.lit(upper) * F.col("n"))).groupBy("whole", "lang").agg(F.min("score").alias("cut"))


def classify(docs: DataFrame, labels: DataFrame, upper: float = UPPER) -> DataFrame:
    """doc_id, lang, n_chars, score, perplexity, threshold and kept for each row of docs (doc_id, text, lang).

    Trusted are rows that labels (doc_id, quality, toxic) calls good and not toxic; the model is trained on most of them
    and the thresholds are quantiles of the rest, or of all if they are fewer than LEAST_TRUSTED. A language without such
    texts, null among them, has the threshold of all languages together; without any trusted text all rows are kept and have no score. A
    text without characters has no score and isn't kept, unless nothing is trusted. Scores equal to the threshold are
    kept. Repeated rows are scored each; other columns are ignored.
    """
    good = labels.where("quality = 1 and toxic = 0 and doc_id is not null").select("doc_id").distinct()
    left_out = F.pmod(F.xxhash64("doc_id", F.lit(FOLDS)), F.lit(FOLDS)) == 0
    apart = good.count() >= LEAST_TRUSTED
    scores = perplexities(docs, train(docs, good.where(~left_out) if apart else good))
    judged = scores.join(good.where(left_out) if apart else good, "doc_id", "left_semi").where("score is not null")
    cuts = materialize(quantiles(judged, upper), "kn-thresholds")
    overall = cuts.where("whole").agg(F.max("cut")).first()[0]
    by_lang = cuts.where("not whole and lang is not null").select("lang", F.col("cut").alias("of_lang"))
    judged = scores.join(F.broadcast(by_lang) if by_lang.count() <= LANGUAGES else by_lang, "lang", "left")
    threshold = F.coalesce("of_lang", F.lit(overall).cast("double"))
    return judged.select(
        "doc_id", "lang", "n_chars", "score", F.pow(F.lit(2.0), F.col("score")).alias("perplexity"), threshold.alias("threshold"),
        F.when(threshold.isNull(), True).otherwise(F.coalesce(F.col("score") <= threshold, F.lit(False))).alias("kept"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


ORACLE_SQL = None
