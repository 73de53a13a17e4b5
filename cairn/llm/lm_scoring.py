"""LM scoring: a log-frequency Bloom filter of quantised n-gram counts, probed shard by shard.

Training. Tasks count the words, pairs and triples of words of their training texts, sorted by hash, and deal them in
shards, packed as arrays; a task for each shard adds them up. Words keep their exact counts. A pair's or triple's count c
is quantised to level 1 + floor(log_B c), and it enters its shard's slice of the filter once for each level up to its
own, each time as another key. A slice has as many bits as its own n-grams need.

Scoring. Texts are packed in chunks. A chunk asks each shard for the counts of its distinct n-grams and words, sorted and
packed as arrays; a task for each shard answers with levels and exact counts, and the answers meet the chunk again. A
count is read by probing level after level until one is missing; an n-gram's count is at most the smaller of its parts'.
Each order is smoothed towards the one below: p(word) = (count + 1) / (N + V + 1), a pair's (count + MU * p(word)) /
(context + MU), and a triple's (count + MU3 * p(pair)) / (context + MU3). The quantised counts are lower bounds, and of
a triple's context the upper end of its level is taken, so that probabilities add up to 1 at most, but for the filter's
false positives. A text's first token has no triple.

The most frequent HEAD words are broadcast, a fixed number, only to ask less: any number gives the same result.

Scale: shards and chunks grow in number with the tokens, not in size, and a chunk asks for an n-gram once however often
it has it. Neither the filter nor the texts pass the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.chunks import CHUNK_SCHEMA, chunked, cut, edges_of, joined, packed_parts, rows_of, unpacked
from cairn.llm.common import materialize, pieces
from cairn.llm.text_arrays import mixed, raw_texts, word_hashes

FOLDS, HELD_OUT = 7, 2
#: How much the order below weighs, in counts, for pairs and for triples.
MU, MU3 = 100.0, 10.0
LEVEL_BASE = 1.5
PROBES = 4
#: Bits of the filter for each token that it may have to hold; so many shards that slices of this density have MAX_BITS each at most.
BITS_PER_TOKEN = 8
MAX_BITS = 1 << 29
#: Bits set for each bit of a slice, repetitions included: at most about 60 % of the bits are 1.
FILL = 0.92
#: The same of the slices that are made: about 37 % of the bits are 1.
SLICE_FILL = FILL / 2
HEAD = 1 << 20
TOKENS_PER_SHARD = 1 << 20
FLUSH_TOKENS = 1 << 21
#: Bytes of text that are scored at once, but for one longer text.
CHUNK_BYTES = 8 << 20

_START, END = np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)
_FIRST, _SECOND, _LEVEL = np.uint64(0x8EBC6AF09C88C6E3), np.uint64(0x589965CC75374CC3), np.uint64(0x1D8E4E27C47D124F)
_THIRD = np.uint64(0x2545F4914F6CDD1D)
WORD, GRAM = 1, 2
#: Bits of an n-gram's key in its shard: as shards don't grow, about one n-gram in 200 shares a key with another.
KEY_BITS = 28
LOW = np.uint64((1 << KEY_BITS) - 1)


def pair_hashes(before: np.ndarray, words: np.ndarray) -> np.ndarray:
    return mixed(before * _FIRST + mixed(words) * _SECOND)


def gram_hashes(before: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the pairs that end at each token, and of the triples; a text's first token has none, and counts as a pair again."""
    pairs = pair_hashes(before, words)
    triples = mixed(np.concatenate([[np.uint64(0)], pairs[:-1]]) * _THIRD + pairs)
    return pairs, np.where(before == _START, pairs, triples)


def with_ends(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens (words and an end for each text), the token before each (a start for the first), and tokens in each text."""
    lengths = counts + 1
    ends = np.cumsum(lengths) - 1
    tokens = np.empty(len(hashes) + len(counts), dtype=np.uint64)
    inside = np.ones(len(tokens), dtype=bool)
    inside[ends] = False
    tokens[inside], tokens[ends] = hashes, END
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[np.concatenate([[0], ends[:-1] + 1])] = _START
    return tokens, before, lengths


def level_of(counts: np.ndarray) -> np.ndarray:
    return 1 + np.floor(np.log(counts) / np.log(LEVEL_BASE) + 1e-9).astype(np.int64)


def least_count(levels: np.ndarray) -> np.ndarray:
    return np.where(levels > 0, np.ceil(LEVEL_BASE ** (levels - 1.0) - 1e-9), 0.0)


def most_count(levels: np.ndarray) -> np.ndarray:
    return np.where(levels > 0, np.ceil(LEVEL_BASE**levels - 1e-9) - 1, 0.0)


def keys_of(hashes: np.ndarray, shard_bits: int) -> np.ndarray:
    """The shard and, in the low KEY_BITS bits, the n-gram's key inside it; in the order of the hashes."""
    return hashes >> np.uint64(64 - KEY_BITS - shard_bits)


def packed_keys(keys: np.ndarray, edges: np.ndarray) -> pa.Array:
    """The keys of shards that begin and end there, packed; keys are sorted."""
    return packed_parts(keys & LOW, edges)


def unpacked_keys(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All keys of a column of packed ones, and where those of each row begin, and the end."""
    parts = [unpacked(x) for x in column.to_pylist()]
    return np.concatenate([np.zeros(0, dtype=np.uint64), *parts]), np.cumsum([0, *map(len, parts)])


def first_level(levels: np.ndarray, slice_bits: int) -> int:
    """The least level to start from for n-grams of these levels to fit into a slice."""
    reaching = np.cumsum(np.bincount(levels, minlength=2)[::-1])
    fits = PROBES * np.cumsum(reaching)[::-1][1:] <= FILL * slice_bits
    return 1 + (int(np.argmax(fits)) if fits.any() else len(fits))


def bits_for(levels: np.ndarray, fill: float = SLICE_FILL) -> int:
    """The bits of a slice that holds n-grams of these levels from level 1 on: equally dense at any size."""
    return 64 + int(np.ceil(PROBES * int(levels.sum()) / fill / 8)) * 8


class Filter:
    """A Bloom filter of (n-gram, level) keys, or with ``shard`` one slice of it; firsts holds each slice's first level."""

    def __init__(self, bits: np.ndarray, shard_bits: int, slice_bits: int, shard: int | None = None, firsts: np.ndarray | None = None):
        self.bits, self.shard_bits, self.shard = bits, shard_bits, shard
        self.slice_bits = np.uint64(slice_bits)
        self.firsts = np.ones(1 << shard_bits, dtype=np.int64) if firsts is None else firsts

    def positions(self, hashes: np.ndarray, level: int | np.ndarray) -> Iterator[np.ndarray]:
        key = mixed(hashes + np.atleast_1d(level).astype(np.uint64) * _LEVEL)
        step = (key >> np.uint64(32)) | np.uint64(1)
        start = np.uint64(0)
        if self.shard is None and self.shard_bits:
            start = (hashes >> np.uint64(64 - self.shard_bits)) * self.slice_bits
        for i in range(PROBES):
            yield start + (key + np.uint64(i) * step) % self.slice_bits

    def add(self, flags: np.ndarray, hashes: np.ndarray, levels: np.ndarray, first: int = 1) -> None:
        for level in range(first, int(levels.max(initial=0)) + 1):
            for at in self.positions(hashes[levels >= level], level):
                flags[at] = True

    def has(self, hashes: np.ndarray, level: int | np.ndarray) -> np.ndarray:
        found = np.ones(len(hashes), dtype=bool)
        for at in self.positions(hashes, level):
            found &= (self.bits[at >> np.uint64(3)] >> (np.uint64(7) - (at & np.uint64(7))).astype(np.uint8)) & 1 != 0
        return found

    def levels(self, hashes: np.ndarray) -> np.ndarray:
        """The highest levels found, 0 where there is none."""
        levels, active = np.zeros(len(hashes), dtype=np.int64), np.arange(len(hashes))
        level = self.firsts[(hashes >> np.uint64(64 - self.shard_bits)).astype(np.int64)] if self.shard_bits else np.full(len(hashes), self.firsts[0])
        while len(active):
            active = active[self.has(hashes[active], level[active])]
            levels[active] = level[active]
            level[active] += 1
        return levels

    def counts(self, hashes: np.ndarray) -> np.ndarray:
        """The lower ends of the levels found, 0 where there is none."""
        return least_count(self.levels(hashes))


def counted(shard_bits: int):
    """A function for mapInArrow: kind, shard and what a task counts: words by hash, n-grams by their key in the shard."""

    def flushed(parts: dict[int, list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for kind, arrays in parts.items():
            keys, counts = np.unique(np.concatenate(arrays), return_counts=True)
            shards = (keys_of(keys, shard_bits) if kind == WORD else keys) >> np.uint64(KEY_BITS)
            found = np.unique(shards)
            edges = edges_of(shards, found)
            own = cut(keys, edges) if kind == WORD else packed_keys(keys, edges)
            yield pa.RecordBatch.from_arrays(
                [pa.array([kind] * len(found), pa.int32()), pa.array(found.astype(np.int32)), own, cut(counts.astype(np.uint32), edges)], names=["kind", "shard", "keys", "counts"]
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = {WORD: [], GRAM: []}, 0
        for piece in pieces(batches, "text"):
            for _, hashes, counts in word_hashes(raw_texts(piece["text"])):
                tokens, before, _ = with_ends(hashes, counts)
                pairs, triples = gram_hashes(before, tokens)
                parts[WORD].append(tokens)
                parts[GRAM] += [keys_of(pairs, shard_bits), keys_of(triples[before != _START], shard_bits)]
                held += len(tokens)
                if held >= FLUSH_TOKENS:
                    yield from flushed(parts)
                    parts, held = {WORD: [], GRAM: []}, 0
        if held:
            yield from flushed(parts)

    return run


def added(keys: np.ndarray, part: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and the sums of their counts."""
    counts = joined(part["counts"], np.uint32)[0].astype(np.int64)
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    firsts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[firsts], np.add.reduceat(counts, firsts)


def merged(fill: float):
    """A function for applyInArrow over one shard: exact counts of its words, and its n-grams' slice of the filter."""

    def run(group: pa.Table) -> pa.Table:
        kinds = group["kind"].to_numpy()
        of_words, of_grams = (group.filter(pa.array(kinds == kind)) for kind in (WORD, GRAM))
        words, times = added(joined(of_words["keys"], np.uint64)[0], of_words)
        keys, counts = added(unpacked_keys(of_grams["keys"])[0], of_grams)
        levels = level_of(counts)
        flags = np.zeros(bits_for(levels, fill), dtype=bool)
        Filter(flags, 0, len(flags)).add(flags, keys, levels)
        return pa.table({"shard": group["shard"][:1], "slice": pa.array([np.packbits(flags).tobytes()]), "hashes": pa.array([words.view(np.int64)]), "counts": pa.array([times])})

    return run


def train(texts: DataFrame) -> dict:
    """The model of a table with the column text: shards of filter and exact counts, head of exact counts, sizes.

    The driver gathers the head only, HEAD words at most.
    """
    size = texts.agg(F.sum(F.length("text")), F.count("*")).first()
    about = (size[0] or 0) // 5 + size[1]  # tokens, roughly; only the number of shards depends on it
    shard_bits = max((about // TOKENS_PER_SHARD).bit_length(), (BITS_PER_TOKEN * about // MAX_BITS).bit_length())
    packed = texts.mapInArrow(counted(shard_bits), "kind int, shard int, keys binary, counts binary")
    shards = materialize(packed.groupBy("shard").applyInArrow(merged(SLICE_FILL), "shard int, slice binary, hashes array<long>, counts array<long>"), "lm-shards")
    exact = shards.select(F.explode(F.arrays_zip("hashes", "counts")).alias("x")).select(F.col("x.hashes").alias("hash"), F.col("x.counts").alias("count"))
    total = exact.agg(F.sum("count"), F.count("*")).first()
    step = F.floor(F.log2("count") * 8).cast("int")
    spread = sorted(((r["step"], r["n"]) for r in exact.groupBy(step.alias("step")).agg(F.count("*").alias("n")).collect()), reverse=True)
    lowest, held = None, 0
    for at, n in spread:
        if held + n > HEAD:
            break
        lowest, held = at, held + n
    head = exact.where(step >= F.lit(lowest) if lowest is not None else F.lit(False)).toArrow()
    keys = head["hash"].to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(keys)
    return {
        "shards": shards, "shard_bits": shard_bits, "head_keys": keys[order], "head_counts": head["count"].to_numpy().astype(np.int64)[order],
        "tokens": int(total[0] or 0), "words": int(total[1]),
    }


def read_chunk(docs: bytes, head_keys: np.ndarray, head_counts: np.ndarray) -> dict:
    """A chunk's rows, tokens in each text, distinct words with the head's counts and what the head lacks, and n-grams."""
    rows = rows_of(docs)
    blocks = [(h, c) for _, h, c in word_hashes(raw_texts(rows["text"]))]
    tokens, before, lengths = with_ends(np.concatenate([h for h, _ in blocks]), np.concatenate([c for _, c in blocks]))
    words, back = np.unique(tokens, return_inverse=True)
    counts = np.zeros(len(words), dtype=np.int64)
    missing = np.ones(len(words), dtype=bool)
    if len(head_keys):
        at = np.minimum(np.searchsorted(head_keys, words), len(head_keys) - 1)
        missing = head_keys[at] != words
        counts[~missing] = head_counts[at[~missing]]
    return {"rows": rows, "lengths": lengths, "words": words, "back": back, "counts": counts, "missing": missing, "grams": np.concatenate(gram_hashes(before, tokens))}


def asked(head, shard_bits: int):
    """A function for mapInArrow: what each chunk asks of each shard, keys of distinct n-grams and hashes of distinct words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, docs in zip(batch["chunk"].to_pylist(), batch["docs"], strict=True):
                read = read_chunk(docs.as_py(), *head.value)
                grams, words = np.unique(keys_of(read["grams"], shard_bits)), read["words"][read["missing"]]
                by_gram, by_word = grams >> np.uint64(KEY_BITS), keys_of(words, shard_bits) >> np.uint64(KEY_BITS)
                found = np.union1d(by_gram, by_word)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([chunk] * len(found), pa.int64()), pa.array(found.astype(np.int32)), packed_keys(grams, edges_of(by_gram, found)), cut(words, edges_of(by_word, found))],
                    names=["chunk", "shard", "grams", "words"],
                )

    return run


def answered(asking: pa.Table, shards: pa.Table) -> pa.Table:
    """For applyInArrow over one shard: levels of the n-grams and exact counts of the words that chunks ask for, 0 if unseen."""
    grams, of_grams = unpacked_keys(asking["grams"])
    words, of_words = joined(asking["words"], np.int64)
    levels, counts = np.zeros(len(grams), dtype=np.uint8), np.zeros(len(words), dtype=np.int64)
    if shards.num_rows and asking.num_rows:
        bits = np.frombuffer(shards["slice"][0].as_py(), dtype=np.uint8)
        own = Filter(bits, 0, 8 * len(bits))
        for at in range(0, len(grams), FLUSH_TOKENS):
            levels[at : at + FLUSH_TOKENS] = own.levels(grams[at : at + FLUSH_TOKENS])
        known, times = (shards[c].combine_chunks().flatten().to_numpy() for c in ("hashes", "counts"))
        if len(known):  # in the order of the unsigned hashes
            known, words = known.view(np.uint64), words.view(np.uint64)
            at = np.minimum(np.searchsorted(known, words), len(known) - 1)
            counts = np.where(known[at] == words, times[at], 0)
    return pa.table({"chunk": asking["chunk"], "shard": asking["shard"], "levels": cut(levels, of_grams), "counts": cut(counts, of_words)})


def scored(head, tokens: int, words: int, shard_bits: int):
    """A function for applyInArrow over one chunk and the shards' answers: a row for each text."""

    def run(chunk: pa.Table, answers: pa.Table) -> pa.Table:
        read = read_chunk(chunk["docs"][0].as_py(), *head.value)
        answers = answers.sort_by("shard")
        read["counts"][read["missing"]] = joined(answers["counts"], np.int64)[0]
        levels = joined(answers["levels"], np.uint8)[0].astype(np.int64)
        c = read["counts"][read["back"]].astype(float)
        lengths = read["lengths"]
        starts = np.cumsum(lengths) - lengths
        before = lambda x: np.concatenate([[0.0], x[:-1]])
        context = before(c)
        context[starts] = read["counts"][np.searchsorted(read["words"], END)]  # texts in training
        levels = levels[np.unique(keys_of(read["grams"], shard_bits), return_inverse=True)[1]]
        pairs = np.minimum(least_count(levels[: len(c)]), np.minimum(c, context))
        p = (pairs + MU * (c + 1) / (tokens + words + 1)) / (context + MU)
        twos = before(np.minimum(most_count(levels[: len(c)]), np.minimum(c, context)))  # of the pair before
        triples = np.minimum(least_count(levels[len(c) :]), np.minimum(pairs, before(pairs)))
        triples[starts] = twos[starts] = 0
        p = (triples + MU3 * p) / (twos + MU3)
        return pa.table({
            "doc_id": read["rows"]["doc_id"], "held_out": read["rows"]["held_out"], "n_tokens": lengths.astype(np.int64), "n_known": np.add.reduceat((c > 0).astype(np.int64), starts),
            "train_tokens": np.full(len(lengths), tokens, dtype=np.int64), "base_score": np.add.reduceat(np.log10((c + 1) / (tokens + words + 1)), starts),
            "score": np.add.reduceat(np.log10(p), starts),
        })

    return run


def score(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of docs (doc_id, held_out, text)."""
    head = docs.sparkSession.sparkContext.broadcast((model["head_keys"], model["head_counts"]))
    chunks = materialize(docs.select("doc_id", "held_out", "text").mapInArrow(chunked(CHUNK_BYTES), CHUNK_SCHEMA), "lm-chunks")
    asking = chunks.mapInArrow(asked(head, model["shard_bits"]), "chunk long, shard int, grams binary, words binary")
    answers = asking.groupBy("shard").cogroup(model["shards"].groupBy("shard")).applyInArrow(answered, "chunk long, shard int, levels binary, counts binary")
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(scored(head, model["tokens"], model["words"], model["shard_bits"]), schema)


def score_held_out(docs: DataFrame) -> DataFrame:
    """Trains on the rows of docs (doc_id, text) outside the held-out fold and scores all rows.

    Held out is crc32(doc_id as text) mod FOLDS = HELD_OUT; a null doc_id is not. Null and empty texts are one end
    token. Repeated rows count and are scored each. With no training rows every count is 0. An empty table gives an
    empty result; other columns are ignored.
    """
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))
    taken = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    return score(taken, train(taken.where(~F.col("held_out")).select("text")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_held_out(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE_SQL = None
