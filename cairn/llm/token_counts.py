"""Token counts: pieces counted once for each distinct pre-token, joined to the pre-token frequencies of documents.

A pre-token is a stretch of text that no piece of the vocabulary reaches over, so that the tokenizer cuts it in the same
way wherever it stands: a word with the spaces before it, a line end, and, in stretches without spaces, whatever lies
between two neighbouring characters that no piece has side by side. These cuts are read off the vocabulary.

First the distinct pre-tokens of all texts are counted, and the tokenizer runs once for each. Then every document's
pre-token frequencies meet the numbers of pieces and are summed. The ids of a document's tokens never exist.

Scale: tasks send on their distinct pre-tokens with counts. The frequent pre-tokens, HEAD at most, go to all tasks, so
that those that a good part of the corpus has are never shuffled; a document's other pre-tokens are joined by text, which
spreads them, as none of them is frequent. Texts are read twice and not shuffled.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.llm.common import carried, materialize, pieces, unused

MODEL = "piece_bpe_32k.model"
LIMIT = 4096
#: Pre-tokens that are sent to all tasks at most, and the characters of one at most.
HEAD = 1 << 18
HEAD_CHARS = 64
#: Longer stretches without a space are cut between characters that no piece has side by side.
LONG = 48
#: Distinct pre-tokens, and their characters, that a task holds.
HELD = 1 << 19
HELD_CHARS = 1 << 23
#: The tokenizer's sign for a space. In a text it is one, too.
SPACE = "▁"
ADDED = ("n_bytes", "n_tokens", "over_limit")


class PreTokens:
    """Cuts texts into pre-tokens and counts the pieces of a pre-token, for a sentencepiece model given as bytes."""

    def __init__(self, model: bytes):
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        names = [self.library.id_to_piece(i) for i in range(len(self.library)) if not (self.library.is_control(i) or self.library.is_byte(i) or self.library.is_unknown(i))]
        self.pairs = {p for name in names for p in zip(name, name[1:], strict=False)}
        probe = "a  b ﬁ b "
        if any(y == SPACE != x for x, y in self.pairs) or any("\n" in p for p in self.pairs):
            raise ValueError("pieces of this model reach over words or lines")
        if not any(self.library.is_byte(i) for i in range(len(self.library))) or "".join(self.library.encode(probe, out_type=str)) != SPACE + probe.replace(" ", SPACE):
            raise ValueError("this model rewrites texts, or has no bytes for unknown characters")
        self.pattern = re.compile(f"[ {SPACE}]*[^ {SPACE}\n]+|[ {SPACE}]+|\n")

    def cut(self, text: str) -> list[str]:
        """The pre-tokens of a text, with the space that the tokenizer puts before it; an empty text has none."""
        found = self.pattern.findall(" " + text) if text else []
        if any(len(x) > LONG for x in found):
            found = [y for x in found for y in (self.fine(x) if len(x) > LONG else (x,))]
        return found

    def fine(self, stretch: str) -> Iterator[str]:
        signs, first = stretch.replace(" ", SPACE), 0
        for i, pair in enumerate(zip(signs, signs[1:], strict=False), 1):
            if pair not in self.pairs:
                yield stretch[first:i]
                first = i
        yield stretch[first:]

    def sizes(self, found: list[str]) -> list[int]:
        """The number of pieces of each pre-token. The tokenizer adds a space to what it gets; a line end keeps it apart."""
        own = [x[0] in (" ", SPACE) and len(x) > 1 for x in found]
        # "\n" and the space before it are two pieces more.
        got = self.library.encode([x[1:] if o else "\n" + x for x, o in zip(found, own, strict=True)], num_threads=1)
        return [len(ids) - (0 if o else 2) for ids, o in zip(got, own, strict=True)]


def _distinct(model):
    """A function for mapInArrow: pretoken and n, rows of a task's distinct pre-tokens."""

    def batch_of(held: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["pretoken", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter, held, chars = PreTokens(model.value), Counter(), 0
        for batch in pieces(batches, "text"):
            found: Counter = Counter()
            for text in batch["text"].to_pylist():
                found.update(cutter.cut(text or ""))
            chars += sum(map(len, found.keys() - held.keys()))
            held.update(found)
            if len(held) >= HELD or chars >= HELD_CHARS:
                yield batch_of(held)
                held, chars = Counter(), 0
        if held:
            yield batch_of(held)

    return run


def _sized(model):
    """A function for mapInArrow: rows of distinct pre-tokens with their number of pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = PreTokens(model.value)
        for batch in pieces(batches, "pretoken"):
            sizes = pa.array(cutter.sizes(batch["pretoken"].to_pylist()), pa.int64())
            yield pa.RecordBatch.from_arrays([batch["pretoken"], batch["n"], sizes], names=["pretoken", "n", "pieces"])

    return run


def vocabulary(docs: DataFrame, model: bytes) -> DataFrame:
    """The distinct pre-tokens of all texts: pretoken, n (times found) and pieces. docs has text."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    counted = docs.select("text").mapInArrow(_distinct(sent), "pretoken string, n long").groupBy("pretoken").agg(F.sum("n").alias("n"))
    return counted.mapInArrow(_sized(sent), "pretoken string, n long, pieces long")


def frequent(table: DataFrame, head: int) -> dict[str, int]:
    """The number of pieces of the most frequent pre-tokens, ``head`` at most, none longer than HEAD_CHARS."""
    short = table.where(F.length("pretoken") <= HEAD_CHARS).withColumn("level", F.floor(F.log2("n") * 8).cast("int"))
    left, least = head, None
    for r in sorted(short.groupBy("level").count().collect(), key=lambda r: -r["level"]):  # eight rows for each doubling of counts
        left -= r["count"]
        if left < 0:
            break
        least = r["level"]
    return {} if least is None else {r["pretoken"]: r["pieces"] for r in short.where(F.col("level") >= least).select("pretoken", "pieces").toLocalIterator()}


def count_tokens(docs: DataFrame, model: bytes, limit: int = LIMIT, head: int = HEAD, keep: Iterable[str] | None = None) -> DataFrame:
    """n_bytes, n_tokens and over_limit of every text, a row for each row of docs, with the columns ``keep`` of docs.

    docs has text; keep is all other columns if not given, and columns with these three names are replaced. Null and
    empty texts have 0 bytes and 0 tokens; a text of spaces has those that the tokenizer gives it. Repeated rows and null
    ids stay as they are; an empty table gives an empty result. Texts are whole, however long.
    """
    keep = carried(docs, "text", *ADDED) if keep is None else list(keep)
    docs = docs.select(*[F.col(f"`{c}`") for c in keep], F.col("text").alias(unused("text", keep)))
    text, row, pretoken, n, n_bytes, partial, tail = (unused(x, [*keep, "n_tokens", "over_limit"]) for x in ("text", "row", "pretoken", "n", "n_bytes", "partial", "tail"))
    table = materialize(vocabulary(docs.select(F.col(text).alias("text")), model), "pretokens")
    sc = docs.sparkSession.sparkContext
    sent, known = sc.broadcast(model), sc.broadcast(frequent(table, head))
    names = [*keep, row, n_bytes, partial, tail, pretoken, n]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter, found, number = PreTokens(sent.value), known.value, TaskContext.get().partitionId() << 33
        for batch in pieces(batches, text):
            sums, rare, rows, texts, times = [], [], [], [], []
            for i, value in enumerate(batch[text].to_pylist()):
                total, before = 0, len(rows)
                for x, many in Counter(cutter.cut(value or "")).items():
                    size = found.get(x)
                    if size is None:
                        rows.append(number + i)
                        texts.append(x)
                        times.append(many)
                    else:
                        total += size * many
                sums.append(total)
                rare.append(len(rows) > before)
            m, k = batch.num_rows, len(rows)
            size = pc.fill_null(pc.binary_length(batch[text]), 0).cast(pa.int64())
            own = [pa.array(range(number, number + m), pa.int64()), size, pa.array(sums, pa.int64()), pa.array(rare, pa.bool_()), pa.nulls(m, pa.string()), pa.nulls(m, pa.int64())]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in keep), *own], names=names)
            if k:
                others = [pa.array(rows, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.bool_()), pa.array(texts, pa.string()), pa.array(times, pa.int64())]
                yield pa.RecordBatch.from_arrays([*(pa.nulls(k, batch[c].type) for c in keep), *others], names=names)
            number += m

    fields = [T.StructField(f.name, f.dataType) for f in docs.schema.fields[:-1]]
    kinds = zip(names[len(keep) :], (T.LongType(), T.LongType(), T.LongType(), T.BooleanType(), T.StringType(), T.LongType()), strict=True)
    parts = materialize(docs.mapInArrow(run, T.StructType([*fields, *(T.StructField(a, b) for a, b in kinds)])), "token-parts")
    sums = parts.where(F.col(pretoken).isNotNull()).select(F.col(row).alias("row"), F.col(pretoken).alias("pretoken"), F.col(n).alias("times"))
    sums = sums.join(table, "pretoken").groupBy("row").agg(F.sum(F.col("times") * F.col("pieces")).alias("more"))
    own = [F.col(f"d.`{c}`").alias(c) for c in [*keep, n_bytes, partial]]
    whole = parts.alias("d").where(~F.col(f"d.{tail}")).select(*own, F.lit(0).cast("long").alias("__more"))
    rest = parts.alias("d").where(F.col(f"d.{tail}")).join(sums.alias("s"), F.col(f"d.{row}") == F.col("s.row")).select(*own, F.col("s.more"))
    both = whole.union(rest)
    both = both.toDF(*[f"c{i}" for i in range(len(both.columns))])
    total = F.col(f"c{len(keep) + 1}") + F.col(f"c{len(keep) + 2}")
    counted = [F.col(f"c{len(keep)}").alias("n_bytes"), total.alias("n_tokens"), (total > limit).alias("over_limit")]
    return both.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(keep)], *counted)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    with open(public_tokenizers.path(MODEL), "rb") as file:
        model = file.read()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return count_tokens(docs.select("doc_id", "text"), model)


ORACLE_SQL = None
