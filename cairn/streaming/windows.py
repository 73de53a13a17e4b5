"""T5: percentiles of each label by tumbling window of event time, exact, with zeros for labels that fall silent."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


#: Parts that a label's windows are dealt over, so that a label is no task of its own.
SHARES = 16
#: Points of a run of neighbours whose counts are kept as one value.
RUN = 4096


class Percentiles(StatefulProcessor):
    """Of a label and a share, to which every so manieth window belongs: the counts of points in each open window, the label's
    first window, and the first window that has not been put out.

    A timer at a window's end, once the watermark has passed it, puts out the share's windows from there up to the watermark,
    those without a sample as zeros, so that a label is heard of in every window from its first one on. All shares
    learn of a label's first window (_combined), and so have the same timers. Counts are kept by runs of neighbouring points.
    """

    def __init__(self, label: str, width_ms: int, per_mille: tuple[int, ...], shares: int = SHARES):
        self.label, self.width, self.per_mille, self.shares = label, width_ms, per_mille, shares

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.counts = handle.getMapState("counts", "start long, run long", "points array<long>, ns array<long>")
        self.first = handle.getValueState("first", "start long")
        self.ahead = handle.getValueState("ahead", "start long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        ahead, first, parts = self.ahead.get()[0] if self.ahead.exists() else None, None, []
        for batch in rows:
            open_ = batch if ahead is None else batch[batch["start"] >= ahead]  # what belongs to a window that was put out is too late
            if len(open_):
                first = int(open_["start"].min()) if first is None else min(first, int(open_["start"].min()))
                parts.append(summed(open_.loc[open_["n"] > 0, ["start", "point", "n"]]))  # a first window without a count is for the timer alone
                if len(parts) > 1 and len(parts[-1]) * 2 > len(parts[0]):
                    parts = [summed(pd.concat(parts))]
        if first is None:
            return iter(())
        new = summed(pd.concat(parts))
        for (start, run), some in new.groupby(["start", new["point"] // RUN], sort=False):
            at = (int(start), int(run))
            if self.counts.containsKey(at):
                some = summed(pd.concat([self.frame(at[0], self.counts.getValue(at)), some]))
            self.counts.updateValue(at, (some["point"].tolist(), some["n"].tolist()))
        if not self.first.exists() or first < self.first.get()[0]:
            self.first.update((first,))
        self.handle.registerTimer(first + self.width)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        ahead = self.ahead.get()[0] if self.ahead.exists() else self.first.get()[0]
        last = passed // self.width * self.width  # the first window that is still open
        if ahead >= last:
            return
        runs: dict[int, list[int]] = {}
        for (start, run), *_ in self.counts.iterator():
            if start < last:
                runs.setdefault(start, []).append(run)
        first = ahead + (int(key[1]) - ahead // self.width) % self.shares * self.width  # of this share
        starts, found = range(first, last, self.width * self.shares), []
        for start in starts:
            held = [(start, run) for run in sorted(runs.get(start, ()))]
            values = [self.counts.getValue(at) for at in held]
            found.append(self.report([pair for points, ns in values for pair in zip(points, ns, strict=True)]))
            for at in held:
                self.counts.removeKey(at)
        self.ahead.update((last,))
        self.handle.registerTimer(last + self.width)
        if found:
            marks, sums, counts = zip(*found, strict=True)
            yield pd.DataFrame({self.label: [key[0]] * len(found), "start": list(starts), "percentiles": list(marks), "sum": sums, "count": counts})

    @staticmethod
    def frame(start: int, value: tuple[list[int], list[int]]) -> pd.DataFrame:
        return pd.DataFrame({"start": start, "point": value[0], "n": value[1]})

    def report(self, points: list[tuple[int, int]]) -> tuple[list[int], int, int]:
        """The points at floor(n * p / 1000) of all n in order, their sum and n; zeros if there are none."""
        total, marks = sum(n for _, n in points), []
        for p in self.per_mille:
            rank, mark = total * p // 1000, 0
            for point, n in points:
                if rank < n:
                    mark = point
                    break
                rank -= n
            marks.append(mark)
        return marks, sum(point * n for point, n in points), total

    def close(self) -> None:
        pass


def summed(counts: pd.DataFrame) -> pd.DataFrame:
    """start, point and n, in order, of each start and point once."""
    return counts.groupby(["start", "point"], as_index=False)["n"].sum()


def _combined(label: str, width_ms: int, shares: int):
    """A function for mapInArrow: a row with its count for each label, window and point of a batch, so that a hot label sends few.

    The window's number says which share it belongs to; a label's first window in the task goes to every share, with a
    count of 0.
    """
    names = [label, "share", "start", "point", "n"]

    def bare(rows: pa.Table, columns: list[str]) -> pa.Table:
        """These columns as fields that may be null, so that all batches have one schema."""
        return pa.table([rows[c] for c in columns], names=columns)

    def dealt(rows: pa.Table) -> list[pa.RecordBatch]:
        return bare(rows, names).combine_chunks().to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        firsts = None
        for batch in batches:
            if batch.num_rows:
                counted = pa.Table.from_batches([batch]).group_by([label, "start", "point"]).aggregate([([], "count_all")]).rename_columns([label, "start", "point", "n"])
                share = pa.array(counted["start"].to_numpy() // width_ms % shares, pa.int64())
                yield from dealt(counted.append_column("share", share))
                both = [bare(counted, [label, "start"])] + ([] if firsts is None else [bare(firsts, [label, "start"])])
                firsts = pa.concat_tables(both).group_by(label).aggregate([("start", "min")]).rename_columns([label, "start"])
        if firsts is not None:
            zeros = pa.array(np.zeros(len(firsts), np.int64))
            for share in range(shares):
                yield from dealt(firsts.append_column("share", pa.array(np.full(len(firsts), share, np.int64))).append_column("point", zeros).append_column("n", zeros))

    return run


def percentile_windows(samples: DataFrame, ts: str, label: str, point: str, per_mille: tuple[int, ...] = (500, 950, 990), width_ms: int = 60_000, late: str = "300 seconds", shares: int = SHARES) -> DataFrame:
    """Label, start (ms), percentiles, sum and count of each window that the watermark, ``late`` behind, has passed.

    Percentiles are the points at index floor(n * p / 1000) of the n in order. From a label's first window on, windows
    without a sample come as zeros. Samples of windows that were put out are dropped; null labels and points are left
    out. State is a counter for each distinct point of an open window; a label's windows are dealt over ``shares`` keys. The
    session's state store becomes RocksDB, which timers and maps need.
    """
    samples.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    kind = dict(samples.dtypes)[label]
    start = F.floor(F.unix_millis(F.col(ts)) / width_ms) * width_ms
    marked = samples.where(F.col(label).isNotNull() & F.col(point).isNotNull() & F.col(ts).isNotNull()).withWatermark(ts, late)
    taken = marked.select(F.col(label), start.cast("long").alias("start"), F.col(point).cast("long").alias("point"))
    counted = taken.mapInArrow(_combined(label, width_ms, shares), f"`{label}` {kind}, share long, start long, point long, n long")
    return counted.groupBy(label, "share").transformWithStateInPandas(Percentiles(label, width_ms, per_mille, shares), f"`{label}` {kind}, start long, percentiles array<long>, sum long, count long", "append", "EventTime")
