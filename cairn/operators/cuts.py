"""Scans whose counters are set back at each cut, without a single task for the whole order.

Where a run that starts at a row ends follows from the rows after it alone, so that each row has a successor: the row at
which the next run would start. The cuts are what is reached from the first row along successors. Blocks of rows are
contracted to one step each, from where a run enters a block to where one enters a later block; doubling those steps
reaches all blocks in a number of rounds that grows with the logarithm of their number.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.operators.series import running_sums
from cairn.sources.shared import materialize, release


def _successors(t: pa.Table, most_rows: int, most_ms: int, most_size: int, check_every: int) -> tuple[np.ndarray, int]:
    """For rows in order, all of a block and those after it, the index where a run from there ends; and the first position."""
    pos, epoch, ts, before = (t[c].to_numpy() for c in ("pos", "epoch", "ts", "before"))
    out = np.arange(len(pos)) + most_rows
    edges = np.flatnonzero(np.diff(epoch)) + 1
    for a, b in zip([0, *edges], [*edges, len(pos)], strict=True):
        at = np.arange(a, b)
        late = a + np.searchsorted(ts[a:b], ts[a:b] + most_ms, side="right")
        full = a + np.searchsorted(before[a:b], before[a:b] + most_size, side="right")
        full += -(full + pos[0]) % check_every  # the size is looked at now and then only
        out[at] = np.minimum.reduce([out[at], late, full, np.full(b - a, b)])
    return out, int(pos[0])


def cuts(rows: DataFrame, most_rows: int, most_ms: int, most_size: int, check_every: int, block_rows: int) -> DataFrame:
    """cut (the position of a run's first row) for rows of pos (from 0, without gaps), epoch, ts and before (the size of all rows before it)."""
    length = max(block_rows, most_rows)
    limits = (most_rows, most_ms, most_size, check_every)
    block = F.floor(F.col("pos") / length)
    # A run has most_rows at most, so that where it ends is in its own block or the next.
    dealt = rows.withColumn("block", F.explode(F.array(block, block - 1))).where("block >= 0")

    def of(t: pa.Table) -> tuple[int, np.ndarray, int, int]:
        t = t.sort_by("pos")
        number = t["block"][0].as_py()
        after, first = _successors(t, *limits)
        return number, after, first, int(np.searchsorted(t["pos"].to_numpy(), (number + 1) * length))

    def steps(t: pa.Table) -> pa.Table:
        """entry, exit and last (the run's start that exits) for all places where a run can enter the block."""
        number, after, first, own = of(t)
        if first != number * length:  # the block is empty: these rows are only looked ahead to from before the first one
            return pa.table({"entry": pa.array([], pa.int64()), "exit": pa.array([], pa.int64()), "last": pa.array([], pa.int64())})
        leaves, last = after.copy(), np.arange(len(after))
        for i in range(own - 1, -1, -1):
            if after[i] < own:
                leaves[i], last[i] = leaves[after[i]], last[after[i]]
        entry = np.arange(min(own, most_rows))
        return pa.table({"entry": entry + first, "exit": leaves[entry] + first, "last": last[entry] + first})

    links = materialize(dealt.groupBy("block").applyInArrow(steps, "entry long, exit long, last long"), "cut-steps")
    zero = links.where("entry = 0").select(F.col("entry").alias("pos"))
    reached, jumps = zero, links.select("entry", "exit").join(links.select(F.col("exit").alias("entry")).union(zero).distinct(), "entry", "left_semi")
    jumps = materialize(jumps, "cut-jumps")
    while not jumps.isEmpty():
        more = reached.join(jumps, F.col("pos") == F.col("entry")).select(F.col("exit").alias("pos"))
        old, reached = reached, materialize(reached.union(more).distinct(), "cut-entries")
        twice = jumps.select(F.col("entry"), F.col("exit").alias("via")).join(jumps.select(F.col("entry").alias("via"), "exit"), "via").select("entry", "exit")
        jumps_before, jumps = jumps, materialize(twice, "cut-jumps")
        release(old, jumps_before)
    # Beyond the last row there is one more, which may be in the last block.
    entries = reached.groupBy(block.alias("block")).agg(F.min("pos").alias("pos"))

    def marked(key: tuple, t: pa.Table, entered: pa.Table) -> pa.Table:
        out = []
        if t.num_rows and entered.num_rows:
            _, after, first, own = of(t)
            at = entered["pos"][0].as_py() - first
            while at < own:
                out.append(at + first)
                at = int(after[at])
        return pa.table({"cut": pa.array(out, pa.int64())})

    return dealt.groupBy("block").cogroup(entries.groupBy("block")).applyInArrow(marked, "cut long")


def rolling_cut(rows: DataFrame, epoch: str, order: list[str], ts: str, size: str, most_rows: int, most_ms: int, most_size: int, check_every: int = 1, block_rows: int = 1 << 16, cell_ms: int = 3_600_000) -> DataFrame:
    """Rows with ``file``, the position in the whole order of the first row of the file that each goes to.

    The order is by epoch and then ``order``, which must be total and begin with ts. A file ends before a row of another
    epoch, before a row with which it would have more than ``most_rows``, before a row more than ``most_ms`` after the
    file's first one, and before a row at which it already has more than ``most_size``; the size is looked at only where
    the position is a multiple of ``check_every``. All counters begin anew with each file. Null sizes count as 0.
    """
    named = rows.withColumns({"__one": F.lit(1), "__size": F.coalesce(F.col(size), F.lit(0)).cast("long")})
    cell = F.struct(F.col(epoch), F.floor(F.col(ts) / cell_ms))
    summed = running_sums(named, [epoch, *order], {"__pos": "__one", "__upto": "__size"}, cell)
    numbered = materialize(summed.withColumns({"__pos": F.col("__pos") - 1, "__upto": F.col("__upto") - F.col("__size")}).drop("__one", "__size"), "cut-rows")
    narrow = numbered.select(F.col("__pos").alias("pos"), F.col(epoch).cast("long").alias("epoch"), F.col(ts).cast("long").alias("ts"), F.col("__upto").alias("before"))
    found = materialize(cuts(narrow, most_rows, most_ms, most_size, check_every, block_rows), "cuts")
    return _with_start(numbered, found, rows.columns, max(block_rows, most_rows))


def _with_start(numbered: DataFrame, found: DataFrame, columns: list[str], length: int) -> DataFrame:
    """Each row with the last cut up to it. A run has no more rows than a block, so that it is in the row's block or the one before."""
    block = lambda c: F.floor(F.col(c) / length)
    before = found.groupBy((block("cut") + 1).alias("__b")).agg(F.max("cut").alias("__before"))
    at = numbered.withColumn("__b", block("__pos")).join(found.withColumnRenamed("cut", "__pos").withColumn("__cut", F.col("__pos")), "__pos", "left").join(before, "__b", "left")
    inside = Window.partitionBy("__b").orderBy("__pos").rowsBetween(Window.unboundedPreceding, 0)
    return at.withColumn("file", F.coalesce(F.last("__cut", ignorenulls=True).over(inside), F.col("__before"))).select(*columns, "file")
