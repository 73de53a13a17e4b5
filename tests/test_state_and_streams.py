"""Cuts, states and streams against loops over lists."""

import base64
import json
import os
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.functions import scalars
from cairn.operators import cuts, history, paging, series
from cairn.sources import bounded, sinks
from cairn.sources.state_table import StateTable
from cairn.streaming import streams, windows


def sequential_cut(rows, most_rows, most_ms, most_size, check_every):
    """Files by one loop: where the first row of each row's file is."""
    out, start, held, begun = [], 0, 0, None
    for i, (epoch, ts, size) in enumerate(rows):
        if begun is None or epoch != begun[0] or i - start >= most_rows or ts - begun[1] > most_ms or (i % check_every == 0 and held > most_size):
            start, held, begun = i, 0, (epoch, ts)
        held += size or 0
        out.append(start)
    return out


@pytest.mark.parametrize(("limits", "block"), [((4, 10**9, 5, 1), 4), ((7, 40, 30, 3), 8), ((3, 10**9, 10**9, 1), 5), ((1000, 25, 12, 50), 1000), ((1, 0, 0, 1), 2)])
def test_files_are_cut_with_counters_set_back(spark, limits, block):
    rng = random.Random(block)
    ts = sorted(rng.randint(0, 900) for _ in range(300))
    rows = [(x // 250, x, rng.choice([None, 0, 1, 1, 5, 20])) for x in ts]
    if limits[0] == 4:
        rows[:8] = [(0, 0, s) for s in (1, 1, 5, 1, 1, 1, 1, 1)]
    rows.sort(key=lambda r: r[:2])
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id long, epoch long, ts long, size int").repartition(3)
    got = {r["id"]: r["file"] for r in cuts.rolling_cut(df, "epoch", ["ts", "id"], "ts", "size", *limits, block_rows=block, cell_ms=100).collect()}
    assert [got[i] for i in range(len(rows))] == sequential_cut(rows, *limits)


def test_no_rows_make_no_files(spark):
    none = spark.createDataFrame([], "id long, epoch long, ts long, size int")
    assert cuts.rolling_cut(none, "epoch", ["ts", "id"], "ts", "size", 3, 4, 5).collect() == []


# State tables


def size_of(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet"))


def test_a_batch_writes_the_buckets_that_it_touches(spark, tmp_path):
    schema = T.StructType.fromDDL("k long, v long")
    table = StateTable(spark, str(tmp_path), schema, F.floor(F.col("k") / 1000))
    newer = lambda old, new: new.unionByName(old.join(new, "k", "left_anti"))
    of = lambda *rows: spark.createDataFrame(rows, schema)
    assert table.read().count() == 0
    assert table.merge(0, spark.range(20_000).select(F.col("id").alias("k"), F.hash("id").cast("long").alias("v")), newer) == 20
    whole = size_of(tmp_path / "data")
    for batch in (1, 2, 2):  # the last one is tried again
        assert table.merge(batch, of((5, batch), (7 * batch, 100)), newer) == 1
    assert size_of(tmp_path / "data" / "batch=1") < whole / 10 and size_of(tmp_path / "data" / "batch=2") < whole / 10
    assert {r["k"]: r["v"] for r in table.read().where("k in (5, 7, 14)").collect()} == {5: 2, 7: 100, 14: 100}
    assert {r["k"]: r["v"] for r in table.read(1).where("k in (5, 7)").collect()} == {5: 1, 7: 100}
    assert table.read().count() == table.read(0).count() == 20_000
    assert table.merge(3, of((3_500, 0)), lambda old, new: old.limit(0)) == 1  # a bucket without rows is gone
    assert table.read().count() == 19_000 and table.versions()[0] == 2 and 3 not in table.versions()
    assert table.merge(4, of(), newer) == 0 and table.read().count() == 19_000


def test_a_table_can_become_empty(spark, tmp_path):
    table = StateTable(spark, str(tmp_path), T.StructType.fromDDL("k long"), StateTable.hashed(["k"], 4))
    table.merge(0, spark.range(3).toDF("k"), lambda old, new: new)
    table.merge(1, spark.range(3).toDF("k"), lambda old, new: old.limit(0))
    assert table.read().collect() == [] and table.versions() == {}
    table.merge(2, spark.range(2).toDF("k"), lambda old, new: old.unionByName(new))
    assert sorted(r["k"] for r in table.read().collect()) == [0, 1]


def test_files_of_a_batch_do_not_grow_with_its_buckets(spark, tmp_path):
    table = StateTable(spark, str(tmp_path), T.StructType.fromDDL("k long"), F.floor(F.col("k") / 2))
    assert table.merge(0, spark.range(-10, 20_000).toDF("k"), lambda old, new: new) == 10_005
    files = [f for _, _, names in os.walk(tmp_path / "data") for f in names if f.endswith(".parquet")]
    assert len(files) <= 64
    assert table.merge(1, spark.range(-1, 1).toDF("k"), lambda old, new: old.where("k <> 0")) == 2
    assert sorted(r["k"] for r in table.read().where("k < 3").collect()) == [*range(-10, 0), 1, 2]
    assert table.read().count() == 20_009 and table.versions()[-1] == 1 and table.versions()[-2] == 0


# Rows before, and runs


@pytest.mark.parametrize("per_octave", [1, 64])
def test_the_row_before_across_cuts(spark, per_octave):
    rng = random.Random(per_octave)
    data = [("hot", v) for v in rng.sample(range(10**6), 600)] + [("few", 3), ("few", 2**40), (None, 9), (None, 1)]
    df = spark.createDataFrame([(k, v, f"{k}{v}") for k, v in data], "k string, v long, t string").repartition(4)
    got = {(r["k"], r["v"]): r["p"]["t"] if r["p"] else None for r in series.previous_row(df, ["k"], "v", ["t"], "p", per_octave).collect()}
    want = {}
    for key in ("hot", "few", None):
        own = sorted(v for k, v in data if k == key)
        want |= {(key, v): f"{key}{b}" if b is not None else None for b, v in zip([None, *own], own, strict=False)}
    assert got == want
    log = history.change_log(df.select(F.coalesce("k", F.lit("n")).alias("object_id"), F.col("v").alias("object_version"), "t"), spark.createDataFrame([("few",)], "object_id string"), ["t"])
    assert sorted(r["operation"] for r in log.collect()) == ["INSERT"] * 2 + ["UPDATE"] * 600


def test_runs(spark):
    rng = random.Random(1)
    numbers = [(g, rng.randint(0, 300)) for g in ("a", "b") for _ in range(400)] + [("c", 7), ("c", None), ("c", 7)]
    df = spark.createDataFrame(numbers, "g string, n long")
    want = set()
    for g in ("a", "b", "c"):
        own = sorted({n for k, n in numbers if k == g and n is not None})
        starts = [n for n in own if n - 1 not in own]
        want |= {(g, s, next(n for n in range(s, 400) if n not in own)) for s in starts}
    for width in (10, 10**6):
        found = series.runs(df, ["g"], "n", width)
        assert {tuple(r) for r in series.join_runs(found, ["g"]).collect()} == want
    assert series.join_runs(spark.createDataFrame([("a", 0, 9), ("a", 2, 3), ("a", 9, 11), ("a", 12, 13)], "g string, low long, high long"), ["g"]).count() == 2


def test_watermarks_by_batch(spark, tmp_path):
    """What a stream of numbers out of order leaves as runs, whatever the batches."""
    numbers = [n for n in range(2, 90) if n not in (40, 60)]
    random.Random(2).shuffle(numbers)
    for i in range(4):
        spark.createDataFrame([("p", n) for n in numbers[i::4]] + [("late", 2 + i), ("gap", 5 + i)], "p string, n long").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    table = streams.run_state(spark, f"{tmp_path}/runs", "p", T.StringType())
    stream = spark.readStream.schema("p string, n long").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    streams.watermark_stream(stream, "p", "n", table, f"{tmp_path}/log", 2).awaitTermination()
    assert {r["p"]: r["watermark"] for r in streams.watermarks(table, "p", 2).collect()} == {"p": 40, "late": 6, "gap": 2}
    assert table.read().where("p = 'p'").count() == 3


# Windows


def test_window_percentiles_and_silent_labels(spark, tmp_path):
    """Windows of 10 s: exact ranks, zeros for a silent label, nothing for a window that is open, late samples dropped."""
    at = lambda s: f"2024-01-01 00:00:{s:02d}"
    batches = [
        [("a", at(1), p) for p in (1, 2, 3, 4)] + [("b", at(2), p) for p in (10, 20, 30, 40)] + [("a", at(31), 7)],
        [("a", at(32), 9), ("a", at(3), 999), (None, at(33), 1), ("a", None, 1), ("a", at(34), None)],
        [("b", at(55), 5)],
    ]
    for rows in batches:
        spark.createDataFrame(rows, "label string, at string, point long").withColumn("at", F.col("at").cast("timestamp")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema("label string, at timestamp, point long").parquet(f"{tmp_path}/in")
        found = windows.percentile_windows(stream, "at", "label", "point", (500, 900), 10_000, "0 seconds")
        found.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/log").trigger(availableNow=True).start().awaitTermination()
    first = 1704067200000
    got = {(r["label"], (r["start"] - first) // 10_000): (r["percentiles"], r["sum"], r["count"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    zero = ([0, 0], 0, 0)
    assert got == {
        ("a", 0): ([3, 4], 10, 4), ("b", 0): ([30, 40], 100, 4), ("a", 1): zero, ("a", 2): zero, ("b", 1): zero, ("b", 2): zero,
        ("a", 3): ([9, 9], 16, 2), ("b", 3): zero, ("a", 4): zero, ("b", 4): zero,
    }


def test_ranks():
    report = windows.Percentiles("l", 1, (1, 100, 200, 900, 999)).report
    for n in (1, 22, 500, 1000, 2000):
        marks, total, count = report([(i, 1) for i in range(n)])
        assert marks == [n * p // 1000 for p in (1, 100, 200, 900, 999)] and (total, count) == (n * (n - 1) // 2, n)
    assert report([(5, 3), (9, 1)])[0] == [5, 5, 5, 9, 9]


class Kept:
    """A state store of one key, which counts the calls for its map."""

    def __init__(self):
        self.map, self.values, self.timers, self.calls = {}, {}, set(), 0

    def called(self):
        self.calls += 1
        return self.map

    def getMapState(self, name, *schemas):
        calls = {"getValue": lambda k: self.called()[k], "updateValue": lambda k, v: self.called().update({k: v}), "containsKey": lambda k: k in self.called(), "removeKey": lambda k: self.called().pop(k), "iterator": lambda: iter(list(self.called().items()))}
        return type("Map", (), {n: staticmethod(f) for n, f in calls.items()})

    def getValueState(self, name, schema):
        calls = {"exists": lambda: name in self.values, "get": lambda: self.values[name], "update": lambda v: self.values.update({name: v})}
        return type("Value", (), {n: staticmethod(f) for n, f in calls.items()})

    def registerTimer(self, ms):
        self.timers.add(ms)


@pytest.mark.parametrize("shares", [1, 4])
def test_windows_of_a_label_are_dealt_over_shares(shares):
    """A label's windows are put out by several keys, late samples and silent windows as by one, with few calls for many points."""
    rng, width = random.Random(shares), 10
    processors, stores, got = {}, {}, {}
    for share in range(shares):
        stores[share], processors[share] = Kept(), windows.Percentiles("label", width, (500, 900), shares)
        processors[share].init(stores[share])
    combined, held, ahead, expected, seen = windows._combined("label", width, shares), {}, None, {}, set()
    for mark, latest in ((0, 95), (60, 200), (190, 450), (440, 460), (455, 455)):
        starts = [rng.randint(max(latest - 130, 0), latest) // width * width for _ in range(3000)]
        points = [rng.randint(0, 5000) for _ in starts]
        table = pa.table({"label": ["a"] * 3000, "start": pa.array(starts, pa.int64()), "point": pa.array(points, pa.int64())})
        rows = pa.Table.from_batches(list(combined(iter(table.to_batches(max_chunksize=700))))).to_pandas()
        seen |= set(rows["share"])
        for share, some in rows.groupby("share"):
            list(processors[share].handleInputRows(("a", share), iter([some.iloc[:40], some.iloc[40:]]), None))
            for _ in [t for t in stores[share].timers if t <= mark]:
                for frame in processors[share].handleExpiredTimer(("a", share), type("Now", (), {"getCurrentWatermarkInMs": lambda self, mark=mark: mark})(), None):
                    for r in frame.to_dict("records"):
                        assert got.setdefault(r["start"], (r["percentiles"], r["sum"], r["count"])) and r["start"] // width % shares == share
        for start, point in zip(starts, points, strict=True):
            if ahead is None or start >= ahead:
                held.setdefault(start, []).append(point)
        last = mark // width * width
        if (min(held) if ahead is None else ahead) < last:
            for start in range(min(held) if ahead is None else ahead, last, width):
                of = sorted(held.pop(start, []))
                expected[start] = ([of[len(of) * 500 // 1000], of[len(of) * 900 // 1000]] if of else [0, 0], sum(of), len(of))
            ahead = last
    assert got == expected and len(got) > 40 and 0 in {n for _, _, n in got.values()} and seen == set(range(shares))
    assert sum(s.calls for s in stores.values()) < 1000  # of some 12,000 samples


def test_columns_that_are_never_null_are_dealt_too():
    """All batches of a task have one schema, whatever its columns may hold, and each share gets each label's first window."""
    fields = pa.schema([pa.field("label", pa.string()), pa.field("start", pa.int64(), nullable=False), pa.field("point", pa.int64(), nullable=False)])
    batches = [pa.RecordBatch.from_arrays([pa.array(["a", "b"]), pa.array([10 * i, 50 - 10 * i], pa.int64()), pa.array([1, 1], pa.int64())], schema=fields) for i in range(1, 4)]
    rows = pa.Table.from_batches(list(windows._combined("label", 10, 4)(iter(batches)))).to_pylist()
    assert sorted((r["label"], r["start"], r["share"]) for r in rows if r["n"] == 0) == [(x, first, share) for x, first in (("a", 10), ("b", 20)) for share in range(4)]
    assert sorted((r["label"], r["start"]) for r in rows if r["n"]) == [("a", 10), ("a", 20), ("a", 30), ("b", 20), ("b", 30), ("b", 40)]


# Subscriptions


def test_a_slow_subscriber_is_dropped(spark, tmp_path):
    for i in range(4):
        spark.createDataFrame([(100 * i + k, "x") for k in range(5)], "id long, kind string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    events = spark.readStream.schema("id long, kind string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    subscriptions = spark.createDataFrame([("quick", "x"), ("slow", "x"), ("halting", "x"), ("other", "y")], "subscriber string, kind string")
    taken = lambda batch: spark.createDataFrame([("quick", 1000), ("halting", 3 * batch)], "subscriber string, taken long")
    state = streams.subscription_state(spark, f"{tmp_path}/state", T.StringType())
    streams.subscribe(events, subscriptions, ["kind"], "id", 9, taken, state, f"{tmp_path}/sent", f"{tmp_path}/log").awaitTermination()
    every = [100 * i + k for i in range(4) for k in range(5)]
    sent = {s: sorted(r["id"] for r in spark.read.parquet(f"{tmp_path}/sent").where(F.col("subscriber") == s).collect()) for s in ("quick", "slow", "halting", "other")}
    # Of nine places the slow one has none left after nine events; the halting one, which takes three a batch, has seven, five and then three.
    assert sent == {"quick": every, "slow": every[:9], "halting": every[:18], "other": []}
    assert {r["subscriber"]: (r["sent"], r["dropped"]) for r in state.read().collect()} == {"quick": (20, False), "slow": (9, True), "halting": (18, True)}


# Checkpoint files


def write_files(path, numbers):
    os.makedirs(path, exist_ok=True)
    for n in numbers:
        with open(f"{path}/{n}.json", "w") as f:
            f.write(json.dumps({"summary": {"sequence_number": n, "epoch": n // 4}, "transactions": [{"digest": f"t{n}"}]}) + "\n")


def test_bounded_reader(tmp_path):
    path, kept, pruned = f"{tmp_path}/in", f"{tmp_path}/kept", f"{tmp_path}/pruned"
    write_files(path, [*range(3, 20), *range(21, 30)])
    options = {"path": path, "start": "3", "batch": "5", "limit": "8", "pertask": "2", "progress": kept, "pruned": pruned}
    reader = bounded.Reader(options)
    assert reader.initialOffset() == {"seq": 3}
    assert [reader.latestOffset()["seq"] for _ in range(4)] == [8, 11, 11, 11]  # 3 + 8 in progress
    bounded.write_number(pruned, 9)
    assert reader.latestOffset() == {"seq": 16}
    again = bounded.Reader(options)  # after a restart
    assert again.latestOffset() == {"seq": 17} and [(p.first, p.end) for p in again.partitions({"seq": 11}, {"seq": 16})] == [(11, 13), (13, 15), (15, 16)]
    bounded.write_number(pruned, 19)
    assert [again.latestOffset()["seq"] for _ in range(2)] == [20, 20]  # 20 is missing
    write_files(path, [20])
    assert again.latestOffset() == {"seq": 25}
    assert [b.to_pydict()["file_sequence"] for b in again.read(bounded.Files(19, 22))] == [[19], [20], [21]]


def test_pipelines_delete_what_all_have_passed(spark, tmp_path):
    path, out, state = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/state"
    write_files(path, [])
    assert streams.run_pipelines(spark, path, {"none": lambda d: d}, out, f"{state}-none", start=4) == {"none": 4}
    write_files(path, range(12))
    handlers = {
        "tx": lambda d: d.select(F.explode("transactions.digest").alias("digest"), "file_sequence"),
        "epochs": lambda d: d.select("file_sequence", "summary.epoch"),
    }
    run = lambda: streams.run_pipelines(spark, path, handlers, out, state, 3, 5)
    assert run() == {"tx": 12, "epochs": 12} and os.listdir(path) == []
    write_files(path, [12, 14])
    assert run() == {"tx": 13, "epochs": 13} and os.listdir(path) == ["14.json"]
    assert sorted(r["digest"] for r in spark.read.parquet(f"{out}/tx").collect()) == sorted(f"t{n}" for n in range(13))
    assert sorted(tuple(r) for r in spark.read.parquet(f"{out}/epochs").select("file_sequence", "epoch").collect()) == [(n, n // 4) for n in range(13)]


def test_record_files_are_compressed_and_read(spark):
    from cairn.plans.registry import Tables
    from cairn.plans.stream_queries import record_files

    path = record_files(Tables(spark, "/root/testdata/sf0.001"), "packed", "seq < 3")
    reader = bounded.Reader({"path": path})
    found = [f.path for n in range(3) for f in bounded.filesystem(path)[0].get_file_info(bounded.fs.FileSelector(f"{bounded.filesystem(path)[1]}/seq={n}")) if not f.base_name.startswith((".", "_"))]
    assert len(found) == 3 and all(f.endswith(".json.gz") for f in found)
    assert [json.loads(b["value"][0].as_py())["summary"]["sequence_number"] for b in reader.read(bounded.Files(0, 3))] == [0, 1, 2]


def test_record_files_are_written_by_their_tasks(spark, tmp_path):
    """A folder and a file for each record, nothing staged for a commit, and the same files when it is tried again."""
    records = spark.range(40).select(F.struct(F.col("id").alias("sequence_number"), F.lit(None).cast("string").alias("digest")).alias("summary"), F.array().cast("array<string>").alias("transactions"), F.col("id").alias("seq"))
    found = []
    for tasks in (3, 5):
        sinks.write_record_files(records.repartition(tasks), f"file://{tmp_path}/in")
        found.append({os.path.relpath(os.path.join(d, f), tmp_path): open(os.path.join(d, f), "rb").read() for d, _, names in os.walk(f"{tmp_path}/in") for f in names})
    assert found[0] == found[1] and sorted(found[0]) == sorted(f"in/seq={n}/part-0.json.gz" for n in range(40))
    lines = [b.to_pydict() for b in bounded.Reader({"path": f"file://{tmp_path}/in"}).read(bounded.Files(0, 40))]
    assert [(x["file_sequence"], json.loads(x["value"][0])) for x in lines] == [([n], {"summary": {"sequence_number": n}, "transactions": []}) for n in range(40)]


def test_pipelines_start_each_stream_once(spark, tmp_path, monkeypatch):
    path, started = f"{tmp_path}/in", []
    write_files(path, range(9))
    monkeypatch.setattr(streams, "flatten_stream", lambda *a, f=streams.flatten_stream, **k: started.append(1) or f(*a, **k))
    handlers = {name: lambda d: d.select("file_sequence") for name in ("a", "b")}
    assert streams.run_pipelines(spark, path, handlers, f"{tmp_path}/out", f"{tmp_path}/state", 2, 3) == {"a": 9, "b": 9} and len(started) == 2


def test_pipelines_ask_for_inputs_by_number_and_for_markers_when_quiet(spark, tmp_path, monkeypatch):
    """The folder is listed for the first bound only, and markers are read at the start and the end, not in each round."""
    path, asked, bounds = f"{tmp_path}/in", [], []
    write_files(path, range(40))
    monkeypatch.setattr(streams, "_greatest", lambda *a, f=streams._greatest: asked.append(a) or f(*a))
    monkeypatch.setattr(bounded, "prune", lambda source, below, pruned, since=None, f=bounded.prune: bounds.append((since, below)) or f(source, below, pruned, since))
    handlers = {name: lambda d: d.select("file_sequence") for name in ("a", "b")}
    assert streams.run_pipelines(spark, path, handlers, f"{tmp_path}/out", f"{tmp_path}/state", 2, 3) == {"a": 40, "b": 40} and os.listdir(path) == []
    assert len(asked) <= 8 < 40 // 3 <= len(bounds) and bounds[0][0] is None
    assert [since for since, _ in bounds[1:]] == [below for _, below in bounds[:-1]] and bounds[-1][1] == 40
    for name in handlers:
        assert sorted(r["file_sequence"] for r in spark.read.parquet(f"{tmp_path}/out/{name}").collect()) == list(range(40))


def test_buckets_of_epochs_are_pruned(spark, tmp_path):
    rows = spark.range(4000).select("id", (F.col("id") * 37 % 1000).alias("checkpoint_sequence_number"), (F.col("id") * 37 % 1000 / 25).cast("long").alias("epoch"))
    sinks.write_bucketed(rows, str(tmp_path))
    found = sinks.read_bucketed(spark, str(tmp_path), "id long, checkpoint_sequence_number long, epoch long", 12, 19)
    assert sorted(r["id"] for r in found.collect()) == sorted(r["id"] for r in rows.where("epoch between 12 and 19").collect())
    assert {r["p"] for r in found.select(F.regexp_extract("_metadata.file_path", "epoch_bucket=([0-9]+)", 1).alias("p")).distinct().collect()} == {"10"}
    ranges = sorted((r["a"], r["b"]) for r in spark.read.parquet(str(tmp_path)).groupBy(F.col("_metadata.file_path")).agg(F.min("checkpoint_sequence_number").alias("a"), F.max("checkpoint_sequence_number").alias("b")).collect())
    assert all(b <= c for (_, b), (c, _) in zip(ranges, ranges[1:], strict=False))


# Orders and depths


def test_depth_of_a_long_chain_and_across_groups(spark, monkeypatch):
    solved = []
    monkeypatch.setattr(paging, "materialize", lambda df, name, f=paging.materialize: solved.append(name) or f(df, name))
    chain = spark.range(100_000).select(F.col("id").alias("tx"), F.lit(0).alias("g"))
    edges = spark.range(1, 100_000).select(F.col("id").alias("tx"), (F.col("id") - 1).alias("depends_on"))
    deep = paging.dependency_depth(chain, edges, "g")
    assert deep.agg(F.max("depth")).first()[0] == 99_999 and deep.where("depth <> tx").count() == 0 and solved.count("depths") == 1
    rng = random.Random(3)
    pairs = {(n, rng.randint(0, n - 1)) for n in range(1, 200) for _ in range(2)} | {(5, 777)}
    depth = {}
    for n in range(200):
        depth[n] = max((depth[d] + 1 for m, d in pairs if m == n and d in depth), default=0)
    for width in (1, 16, 200):
        nodes = spark.range(200).select(F.col("id").alias("tx"), F.floor(F.col("id") / width).alias("g"))
        got = paging.dependency_depth(nodes, spark.createDataFrame(sorted(pairs), "tx long, depends_on long"), "g")
        assert {r["tx"]: r["depth"] for r in got.collect()} == depth, width


def test_byte_arrays_anywhere(spark):
    rng = random.Random(8)

    def value(depth):
        kind = rng.randint(0, 9 if depth else 5)
        if kind >= 6:
            return [value(depth - 1) for _ in range(rng.randint(0, 3))] if kind < 8 else {rng.choice(["a", "[1]", 'q"', "\\"]): value(depth - 1) for _ in range(3)}
        return [None, True, rng.choice([0, 255, 256, -1, 1.5]), rng.choice(["[1,2]", '"[3]', "\\", "x", ""]), [rng.randint(0, 255) for _ in range(rng.randint(0, 40))], [rng.randint(0, 300), 7]][kind]

    def coded(v):
        if isinstance(v, list):
            if all(isinstance(x, int) and not isinstance(x, bool) and 0 <= x <= 255 for x in v):
                return base64.b64encode(bytes(v)).decode()
            return [coded(x) for x in v]
        return {k: coded(x) for k, x in v.items()} if isinstance(v, dict) else v

    values = [value(4) for _ in range(300)] + [[list(range(256)) * 40], "s" * 50_000, [[[[[1]]]]]]
    texts = [json.dumps(v, indent=rng.choice([None, 1])) for v in values]
    df = spark.createDataFrame([*enumerate(texts), (-1, None)], "i long, j string")
    got = {r["i"]: r["b"] for r in df.select("i", scalars.byte_arrays_to_base64(F.col("j")).alias("b")).collect()}
    assert got.pop(-1) is None
    assert [json.loads(got[i]) for i in range(len(values))] == [coded(v) for v in values]


def test_cut_files_share_the_folder_of_their_epoch(spark, tmp_path):
    """One file for each cut file, though it comes in several batches; written again, the files are the same."""
    rows = spark.range(1_000).select(F.col("id").alias("tx"), (F.col("id") / 400).cast("long").alias("epoch"), (F.col("id") - F.col("id") % 50).alias("file"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        for _ in range(2):
            sinks.write_cut_files(rows, f"file://{tmp_path}/cut")
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {str(p.relative_to(tmp_path / "cut")) for p in (tmp_path / "cut").rglob("*.parquet")} == {f"epoch={f // 400}/{f}.parquet" for f in range(0, 1_000, 50)}
    got = spark.read.schema("tx long, file long, epoch long").parquet(f"file://{tmp_path}/cut")
    assert sorted(map(tuple, got.select("tx", "epoch", "file").collect())) == [(i, i // 400, i - i % 50) for i in range(1_000)]
