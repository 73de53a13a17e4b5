"""Line dedup: winnowing over line hashes. DataFrame functions only.

Only lines with a word count. A gram is a line and as many after it as make GRAM_WORDS words. A window is the grams
that start within WINDOW_WORDS words, and its fingerprint is the gram with the smallest hash. Windows depend on the
lines in them alone, so that each run of lines with GRAM_WORDS + WINDOW_WORDS words that occurs twice has a common
fingerprint. Each later occurrence of a fingerprint is joined with its first one, by (doc_id, position), and the match
is extended both ways along the two documents' line hashes. These runs, which have GRAM_WORDS words at least, are
deleted where they come later; as what they repeat comes earlier, the first copy of every line stays.

Scale: lines travel as hashes, a few bytes each; a fingerprint's occurrences are joined with one first occurrence, so
rows stay linear however often a line repeats, and Spark splits a hot fingerprint's join. Of the two documents' lines
only those around the anchors travel, however long the documents are; the few matches that go on beyond are extended
again with more of them. Texts move once, when the deleted positions meet them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.common import SPACE_CLASS, carried, let, materialize, unused

#: Any repeated run of 50 words, the sum of the two, is found; none of fewer words than the first is touched.
GRAM_WORDS = 35
WINDOW_WORDS = 15
#: Lines on either side of the anchors to which a match is extended at first; four times as many where it goes on beyond.
REACH = 128

BLANKS = " \t\n\x0b\x0c\r"


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def lines_of(docs: DataFrame) -> DataFrame:
    """doc (doc_id and the text's hash) and pos, h, n: positions, hashes and word counts of the lines with a word."""
    cell = lambda x, i: F.struct(
        i.alias("pos"), F.xxhash64(x).alias("h"), F.size(F.split(F.btrim(x, F.lit(BLANKS)), SPACE_CLASS + "+")).alias("n"), x.rlike("[^ \\x09-\\x0D]").alias("full")
    )
    kept = F.filter(F.transform(split_lines(F.col("text")), cell), lambda s: s["full"])
    return (
        docs.select(identity().alias("doc"), kept.alias("kept")).where(F.size("kept") > 0)
        .select("doc", F.col("kept.pos").alias("pos"), F.col("kept.h").alias("h"), F.col("kept.n").alias("n"))
        .dropDuplicates(["doc"])
    )


def identity() -> Column:
    return F.struct(F.col("doc_id").alias("doc_id"), F.xxhash64("text").alias("text"))


def span(counts: Column, least: int) -> Column:
    """How many of the first counts make a sum of ``least``, and that sum, which is smaller if all don't."""
    return F.aggregate(
        counts,
        F.struct(F.lit(0).alias("sum"), F.lit(0).alias("lines")),
        lambda a, x: F.when(a["sum"] >= least, a).otherwise(F.struct((a["sum"] + x).alias("sum"), (a["lines"] + 1).alias("lines"))),
    )


def fingerprints(lines: DataFrame, gram_words: int, window_words: int) -> DataFrame:
    """doc, at (index among the lines with a word) and gram (hash) of all grams that are the least of a window."""
    starts = F.sequence(F.lit(0), F.size("h") - 1)

    def gram(i: Column) -> Column:
        """Null past the last whole gram. As every line has a word, gram_words lines are enough to look at."""
        return let(
            span(F.slice(F.col("n"), i + 1, gram_words), gram_words),
            lambda s: F.when(s["sum"] >= gram_words, F.xxhash64(F.slice(F.col("h"), i + 1, s["lines"]))),
        )

    def least(g: Column, i: Column) -> Column:
        """Where the smallest gram of the window from i starts; the first of equal ones."""
        cells = lambda s: F.transform(F.slice(g, i + 1, s["lines"]), lambda x, k: F.when(x.isNotNull(), F.struct(x.alias("gram"), (i + k).alias("at"))))
        return let(span(F.slice(F.col("n"), i + 1, window_words), window_words), lambda s: F.array_min(cells(s))["at"])

    chosen = let(
        F.transform(starts, gram),
        lambda g: let(
            F.array_compact(F.array_distinct(F.transform(starts, lambda i: least(g, i)))),
            lambda ats: F.transform(ats, lambda at: F.struct(at.alias("at"), F.get(g, at).alias("gram"))),
        ),
    )
    return lines.select("doc", F.explode(chosen).alias("c")).select("doc", "c.at", "c.gram")


def runs(same: Column) -> Column:
    """start and end of the runs of true in ``same``."""
    starts = F.filter(F.sequence(F.lit(0), F.size(same) - 1), lambda i: F.get(same, i) & ~F.coalesce(F.get(same, i - 1), F.lit(False)))
    ends = F.filter(F.sequence(F.lit(0), F.size(same) - 1), lambda i: F.get(same, i) & ~F.coalesce(F.get(same, i + 1), F.lit(False)))
    return F.transform(F.arrays_zip(starts.alias("start"), ends.alias("end")), lambda r: F.struct(r["start"].alias("start"), r["end"].alias("end")))


def cut(array: Column, low: Column, high: Column) -> Column:
    """The items of an array from low to high, both inside it."""
    return F.slice(array, low + 1, F.greatest(high - low + 1, F.lit(0)))


def extended(seeds: DataFrame, lines: DataFrame, reach: int) -> DataFrame:
    """seeds (doc, other, shift, anchors) with the runs of equal lines around their anchors, and ``open`` if one may go on.

    As an anchor is a gram that both have, such a run has the gram's words. Only the lines from ``reach`` before the first anchor to as many after the last one are looked at. Runs are
    numbered like doc's lines with a word.
    """
    mine = lines.select("doc", F.col("h").alias("my_h"))
    theirs = lines.select(F.col("doc").alias("other"), F.col("h").alias("their_h"))
    low, high = F.greatest(F.array_min("anchors") - reach, F.lit(0), F.col("shift")), F.array_max("anchors") + reach
    near = seeds.join(mine, "doc").withColumns({"low": low, "high": F.least(high, F.size("my_h") - 1)})
    near = near.select("doc", "other", "shift", "anchors", "low", "high", cut(F.col("my_h"), F.col("low"), F.col("high")).alias("my_h"))
    both = near.join(theirs, "other").withColumn("end", F.least("high", F.size("their_h") - 1 + F.col("shift")))
    both = both.withColumn("their_h", cut(F.col("their_h"), F.col("low") - F.col("shift"), F.col("end") - F.col("shift")))
    same = F.transform(F.arrays_zip(F.slice("my_h", 1, F.size("their_h")).alias("a"), F.col("their_h").alias("b")), lambda x: x["a"] == x["b"])
    # A run without an anchor is none of this pair's business: its fingerprints have another first occurrence.
    inside = lambda r: F.exists(F.col("anchors"), lambda p: (p >= r["start"] + F.col("low")) & (p <= r["end"] + F.col("low")))
    found = both.withColumn("runs", F.filter(let(same, runs), inside))
    shifted = F.transform("runs", lambda r: F.struct((r["start"] + F.col("low")).alias("start"), (r["end"] + F.col("low")).alias("end")))
    at_edge = F.exists("runs", lambda r: ((r["start"] == 0) & (F.col("low") > F.greatest(F.lit(0), F.col("shift")))) | (r["end"] + F.col("low") == F.array_max("anchors") + reach))
    return found.select("doc", "other", "shift", "anchors", shifted.alias("runs"), at_edge.alias("open"))


def repeated_positions(lines: DataFrame, gram_words: int = GRAM_WORDS, window_words: int = WINDOW_WORDS, reach: int = REACH) -> DataFrame:
    """doc and pos: the line positions of each document that repeat an earlier run."""
    prints = materialize(fingerprints(lines, gram_words, window_words), "fingerprints")
    firsts = prints.groupBy("gram").agg(F.min(F.struct("doc", "at")).alias("first"), F.count("*").alias("copies")).where("copies > 1").drop("copies")
    later = prints.join(firsts, "gram").where(F.struct("doc", "at") > F.col("first"))
    # Anchors on one diagonal that are near each other are parts of one alignment of two documents.
    anchors = later.select("doc", F.col("first.doc").alias("other"), (F.col("at") - F.col("first.at")).alias("shift"), "at")
    done = []
    while True:
        seeds = anchors.groupBy("doc", "other", "shift", F.floor(F.col("at") / reach).alias("part")).agg(F.collect_set("at").alias("anchors")).drop("part")
        tried = materialize(extended(seeds, lines, reach), "runs")
        done.append(tried.where("not open"))
        anchors, reach = tried.where("open").select("doc", "other", "shift", F.explode("anchors").alias("at")), 4 * reach
        if anchors.isEmpty():
            break
    found = reduce(DataFrame.union, done).select("doc", F.explode("runs").alias("r"))
    spans = found.groupBy("doc").agg(F.collect_set("r").alias("runs")).join(lines.select("doc", "pos"), "doc")
    part = F.transform("runs", lambda r: cut(F.col("pos"), r["start"], r["end"]))
    return spans.select("doc", F.array_distinct(F.flatten(part)).alias("pos"))


def dedup_lines(docs: DataFrame, gram_words: int = GRAM_WORDS, window_words: int = WINDOW_WORDS) -> DataFrame:
    """docs with all their columns, text without the lines that repeat an earlier run, and ``removed_lines`` (long).

    Needs doc_id, the order of "earlier" (null first), and text. Null texts stay null, and texts that repeat nothing
    stay as they are to the last character. Lines without a word break no run and stay. A document all of whose lines
    with a word go keeps its row. Rows that repeat a doc_id and text are one document and repeat nothing by that.
    (doc_id, position) orders all lines, so there are no ties. Empty tables give empty results. A column of the input
    named removed_lines is replaced.
    """
    own = carried(docs, "removed_lines")
    ids, texts, pos, hashed = (unused(name, own) for name in ("__doc_id", "__text", "__pos", "__hash"))
    lines = materialize(lines_of(docs.select("doc_id", "text").where("text is not null")), "lines")
    gone = repeated_positions(lines, gram_words, window_words, REACH).select(
        F.col("doc.doc_id").alias(ids), F.col("doc.text").alias(texts), F.col("pos").alias(pos)
    )
    joined = docs.select(*[F.col(f"`{c}`") for c in own], F.xxhash64("text").alias(hashed))
    joined = joined.join(gone, joined["doc_id"].eqNullSafe(gone[ids]) & (joined[hashed] == gone[texts]), "left")
    kept = let(
        split_lines(F.col("text")),
        lambda x: let(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col(pos)), lambda left: F.array_join(F.transform(left, lambda i: F.get(x, i)), "\n")),
    )
    text = F.when(F.col(pos).isNull(), F.col("text")).otherwise(kept)
    removed = F.when(F.col(pos).isNull(), F.lit(0)).otherwise(F.size(pos)).cast("long")
    return joined.select(*[text.alias(c) if c == "text" else F.col(f"`{c}`") for c in own], removed.alias("removed_lines"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).select("doc_id", "text", "removed_lines")


ORACLE_SQL = None
