"""Queries of sources, sinks and streams; streams run over the driver's tables until all is read."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.operators import flatten as fl
from cairn.operators import metrics as m
from cairn.operators import telemetry as tel
from cairn.operators.cuts import rolling_cut
from cairn.operators.history import fold_point, latest_version
from cairn.operators.quality import checksum_failures
from cairn.plans import views
from cairn.plans.flatten_queries import STATUS, TX, checkpoint_records
from cairn.plans.metric_queries import SEEN, SENDERS
from cairn.plans.registry import Tables, query
from cairn.sources import bounded, sinks
from cairn.sources import checkpoints as src
from cairn.sources.shared import materialize, shared_dir
from cairn.sources.state_table import StateTable
from cairn.streaming import streams as st
from cairn.streaming.windows import percentile_windows


def fresh(t: Tables, name: str) -> str:
    return f"{shared_dir(t.spark)}/cairn-{name}-{uuid.uuid4().hex[:12]}"


def event_stream(t: Tables) -> DataFrame:
    """The driver's events as a stream of files."""
    return t.spark.readStream.schema(t.events.schema).option("pathGlobFilter", "events.parquet").parquet(t.sf_dir)


def tx_stream(t: Tables) -> DataFrame:
    """The view fx_tx over the stream."""
    return t.spark.sql(views.spark_sql("fx_tx").replace("FROM events", "FROM {events}"), events=event_stream(t))


def sample_stream(t: Tables) -> DataFrame:
    """The view fx_sample over the stream."""
    return event_stream(t).select(F.col("event_type").alias("label"), F.col("ts").cast("timestamp").alias("at"), F.round(F.col("value") * 100).cast("long").alias("point"))


def parted(t: Tables, rows: DataFrame, parts: list[str], name: str) -> str:
    """A folder with a file for each condition, in this order of time."""
    path = fresh(t, name)
    for part in parts:
        rows.where(part).coalesce(1).write.mode("append").parquet(path)
    return path


def finished(frame: DataFrame, t: Tables, name: str, mode: str = "append") -> DataFrame:
    """The rows that a stream puts out until its source is read."""
    path = fresh(t, name)
    if mode == "append":
        writer = frame.writeStream.format("parquet").option("path", path)
    else:
        writer = frame.writeStream.outputMode(mode).foreachBatch(lambda df, i: df.write.mode("overwrite").parquet(f"{path}/batch={i}"))
    q = writer.option("checkpointLocation", fresh(t, "progress")).trigger(availableNow=True).start()
    q.awaitTermination()
    return t.spark.read.schema(frame.schema).option("recursiveFileLookup", "true").parquet(path)


@query("s3_resume", "SELECT tx_sequence_number, checkpoint_sequence_number AS checkpoint FROM fx_tx WHERE checkpoint_sequence_number > (SELECT max(checkpoint_sequence_number) FROM fx_tx WHERE checkpoint_sequence_number <= 400)")
def _(t):
    rows = t.fx_tx.select("tx_sequence_number", F.col("checkpoint_sequence_number").alias("checkpoint"))
    return src.resume(rows, rows.where("checkpoint <= 400"))


@query("s4_s6_parquet_by_epoch", "SELECT tx_sequence_number, sender, epoch FROM fx_tx WHERE epoch <> 4 UNION ALL SELECT tx_sequence_number, sender, epoch FROM fx_tx WHERE epoch = 4 AND sender % 2 = 0")
def _(t):
    path, rows = fresh(t, "s4"), t.fx_tx.select("tx_sequence_number", "sender", "epoch")
    sinks.write_parquet_table(rows, path)
    sinks.write_parquet_table(rows.where("epoch = 4 and sender % 2 = 0"), path, mode="overwrite")  # replaces epoch 4 alone
    return t.spark.read.schema("tx_sequence_number long, sender long, epoch long").parquet(path)


@query("s5_csv", "SELECT o_orderkey, o_orderpriority FROM orders")
def _(t):
    path = fresh(t, "s5")
    sinks.write_csv_table(t.orders.select("o_orderkey", "o_orderpriority"), path)
    return t.spark.read.schema("o_orderkey long, o_orderpriority string").option("sep", "|").csv(path)


@query("s9_max_checkpoint", "SELECT max(checkpoint_sequence_number) AS max_checkpoint FROM fx_tx")
def _(t):
    return src.max_checkpoint(t.fx_tx, "checkpoint_sequence_number")


@query("s10_load_stage", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_custkey END AS o_custkey FROM orders")
def _(t):
    path = fresh(t, "s10")
    t.orders.where("o_orderkey % 2 = 1").select("o_orderkey").write.parquet(f"{path}/a")
    t.orders.where("o_orderkey % 2 = 0").select("o_orderkey", "o_custkey").write.parquet(f"{path}/b")
    return src.load_stage(t.spark, path, ["o_orderkey", "o_custkey"])


@query("s11_epoch_buckets", "SELECT epoch - epoch % 10 AS epoch_bucket, count(*) AS n FROM fx_tx GROUP BY 1")
def _(t):
    return sinks.bucketed(t.fx_tx, cluster=["checkpoint_sequence_number"]).groupBy("epoch_bucket").agg(F.count("*").alias("n"))


@query("s11_bucketed_table", "SELECT tx_sequence_number, checkpoint_sequence_number, epoch FROM fx_tx WHERE epoch BETWEEN 8 AND 12 AND checkpoint_sequence_number >= 200")
def _(t):
    """Written in buckets of ten epochs, sorted by checkpoint, and read back for a range of both."""
    path = fresh(t, "s11")
    sinks.write_bucketed(t.fx_tx.select("tx_sequence_number", "checkpoint_sequence_number", "epoch"), path)
    return sinks.read_bucketed(t.spark, path, "tx_sequence_number long, checkpoint_sequence_number long, epoch long", 8, 12).where("checkpoint_sequence_number >= 200")


@query("s12_fanout", "SELECT DISTINCT 'tx' AS name, tx_sequence_number AS key, sender AS value FROM fx_tx UNION ALL SELECT DISTINCT 'checkpoint', checkpoint_sequence_number, epoch FROM fx_tx UNION ALL SELECT DISTINCT 'sender', sender, NULL FROM fx_tx")
def _(t):
    """Three keyed tables of one batch, row by row."""
    made = sinks.fanout(
        t.fx_tx,
        {"tx": lambda d: d.select(F.col("tx_sequence_number").alias("key"), F.col("sender").alias("value")), "checkpoint": lambda d: d.select(F.col("checkpoint_sequence_number").alias("key"), F.col("epoch").alias("value")), "sender": lambda d: d.select(F.col("sender").alias("key"), F.lit(None).cast("long").alias("value"))},
        {"tx": ["key"], "checkpoint": ["key"], "sender": ["key"]},
    )
    parts = [df.select(F.lit(name).alias("name"), "key", "value") for name, df in made.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("s13_snapshot_round_trip", "SELECT object_id, object_version, owner_id FROM (SELECT * FROM fx_object_history QUALIFY row_number() OVER (PARTITION BY object_id ORDER BY object_version DESC) = 1) WHERE object_status = 0")
def _(t):
    path = fresh(t, "s13")
    live = latest_version(t.fx_object_history).where("object_status = 0").select("object_id", "object_version", "owner_id")
    sinks.write_snapshot(live, path, 7, "object_id", 4)
    return t.spark.read.parquet(path).select("object_id", "object_version", "owner_id")


def dumped(t, part, name):
    path = fresh(t, name)
    sinks.dump_packages(part.select((F.col("p_partkey") % 50).alias("package_id"), F.col("p_size").alias("package_version"), F.col("p_name").alias("name")), path)
    return t.spark.read.schema(f"name string, package_id long, package_version {dict(part.dtypes)['p_size']}").json(path)


DUMPED = "SELECT p_partkey % 50 AS package_id, p_size AS package_version, p_name AS name FROM part"


@query("s17_dump_packages", DUMPED)
def _(t):
    return dumped(t, t.part, "s17")


@query("s18_events_to_json", "SELECT event_id AS id, concat('{\"user_id\":', user_id, ',\"event_type\":\"', event_type, '\"}') AS json FROM events")
def _(t):
    return sinks.events_to_json(t.events, "event_id", ["user_id", "event_type"])


@query("s20_commit_batch", "SELECT tx_sequence_number, CAST(1 AS BIGINT) AS batch FROM fx_tx WHERE epoch = 1")
def _(t):
    path, rows = fresh(t, "s20"), t.fx_tx.where("epoch = 1").select("tx_sequence_number")
    for _ in range(2):  # the second try finds the marker
        sinks.commit_batch({"tx": rows}, {"tx": f"{path}/tx"}, f"{path}/marker", 1)
    return t.spark.read.schema("tx_sequence_number long, batch long").parquet(f"{path}/tx")


@query("s21_epoch_of_checkpoint", "SELECT t.tx_sequence_number, e.epoch AS epoch_id FROM fx_tx t JOIN fx_epoch e ON t.checkpoint_sequence_number BETWEEN e.first_checkpoint_id AND e.last_checkpoint_id")
def _(t):
    epochs = t.fx_epoch.select(F.col("epoch").alias("epoch_id"), "first_checkpoint_id", F.when(F.col("epoch") < 29, F.col("last_checkpoint_id")).alias("last_checkpoint_id"))
    rows = t.fx_tx.select("tx_sequence_number", F.col("checkpoint_sequence_number").alias("checkpoint"))
    return sinks.epoch_of_checkpoint(rows, epochs, width=24).select("tx_sequence_number", "epoch_id")


@query("t1_flatten_stream", "SELECT 'tx' AS name, tx_sequence_number AS id FROM fx_tx UNION ALL SELECT 'failed', tx_sequence_number FROM fx_tx WHERE NOT execution_success")
def _(t):
    path = fresh(t, "t1")
    handlers = {"tx": lambda d: d.select(F.lit("tx").alias("name"), F.col("tx_sequence_number").alias("id")), "failed": lambda d: d.where("not execution_success").select(F.lit("failed").alias("name"), F.col("tx_sequence_number").alias("id"))}
    st.flatten_stream(tx_stream(t), handlers, path, fresh(t, "progress")).awaitTermination()
    read = lambda name: t.spark.read.schema("name string, id long, batch long").parquet(f"{path}/{name}").select("name", "id")
    return read("tx").unionByName(read("failed"))


@query("t2_subscription", "SELECT event_id, user_id FROM events WHERE event_type = 'click' AND user_id < 40")
def _(t):
    wanted = event_stream(t).where((F.col("event_type") == "click") & (F.col("user_id") < 40)).select("event_id", "user_id")
    return finished(wanted, t, "t2")


@query("t2_many_subscriptions", "SELECT event_id, s_suppkey AS subscriber FROM events JOIN (SELECT s_suppkey, s_suppkey % 7 AS user_id FROM supplier) USING (user_id)")
def _(t):
    table = t.supplier.select(F.col("s_suppkey").alias("subscriber"), (F.col("s_suppkey") % 7).alias("user_id"))
    return finished(st.matched_subscriptions(event_stream(t), table, ["user_id"]).select("event_id", "subscriber"), t, "t2many")


@query("t2_slow_subscribers", """WITH m AS (SELECT s_suppkey AS subscriber, s_suppkey % 3 = 0 AS slow, event_id, event_id % 3 AS batch FROM events JOIN supplier ON user_id = s_suppkey % 7),
  r AS (SELECT *, row_number() OVER (PARTITION BY subscriber, batch ORDER BY event_id) AS i, row_number() OVER (PARTITION BY subscriber ORDER BY batch, event_id) AS upto FROM m),
  d AS (SELECT subscriber, min(batch) FILTER (CASE WHEN slow THEN upto ELSE i END > 25) AS dropped FROM r GROUP BY 1)
  SELECT subscriber, event_id, dropped IS NOT NULL AS dropped FROM r JOIN d USING (subscriber) WHERE CASE WHEN slow THEN upto ELSE i END <= 25 AND (dropped IS NULL OR batch <= dropped)""")
def _(t):
    """Three batches of events; a third of the subscribers takes nothing of what it is sent and is dropped at 25, the others go on."""
    files = parted(t, t.events, ["event_id % 3 = 0", "event_id % 3 = 1", "event_id % 3 = 2"], "t2files")
    events = t.spark.readStream.schema(t.events.schema).option("maxFilesPerTrigger", 1).parquet(files).select("event_id", "user_id")
    wanted = t.supplier.select(F.col("s_suppkey").alias("subscriber"), (F.col("s_suppkey") % 7).alias("user_id"))
    taken = lambda batch: t.supplier.select(F.col("s_suppkey").alias("subscriber"), F.when(F.col("s_suppkey") % 3 == 0, 0).otherwise(1 << 40).alias("taken"))
    state, path = st.subscription_state(t.spark, fresh(t, "t2state"), wanted.schema["subscriber"].dataType), fresh(t, "t2sent")
    st.subscribe(events, wanted, ["user_id"], "event_id", 25, taken, state, path, fresh(t, "progress")).awaitTermination()
    sent = t.spark.read.schema(f"subscriber {wanted.schema['subscriber'].dataType.simpleString()}, event_id long").parquet(path)
    return sent.join(state.read().select("subscriber", "dropped"), "subscriber").select("subscriber", "event_id", "dropped")


@query("t3_watermark_stream", "SELECT event_type AS pipeline, min(user_id) + 1 AS watermark FROM (SELECT DISTINCT event_type, user_id FROM events WHERE user_id % 23 <> 22) e WHERE NOT EXISTS (SELECT 1 FROM events x WHERE x.event_type = e.event_type AND x.user_id = e.user_id + 1 AND x.user_id % 23 <> 22) GROUP BY 1")
def _(t):
    """Numbers arrive in three batches, out of order, so that runs grow together."""
    files = parted(t, t.events.where("user_id % 23 <> 22"), ["event_id % 3 = 2", "event_id % 3 = 0", "event_id % 3 = 1"], "t3files")
    done = t.spark.readStream.schema(t.events.schema).option("maxFilesPerTrigger", 1).parquet(files).select(F.col("event_type").alias("pipeline"), F.col("user_id").alias("seq"))
    table = st.run_state(t.spark, fresh(t, "t3"), "pipeline", T.StringType())
    st.watermark_stream(done, "pipeline", "seq", table, fresh(t, "progress")).awaitTermination()
    return st.watermarks(table, "pipeline")


WINDOWED = "SELECT label, ts_ms // 86400000 AS day, point FROM fx_sample"


@query("t5_percentile_windows", f"""WITH w AS ({WINDOWED}), r AS (SELECT label, day, point, row_number() OVER (PARTITION BY label, day ORDER BY point) - 1 AS i, count(*) OVER (PARTITION BY label, day) AS n FROM w)
  SELECT concat(label, '@', day) AS label, max(point) FILTER (i = n * 500 // 1000) AS p50, max(point) FILTER (i = n * 950 // 1000) AS p95, CAST(sum(point) AS BIGINT) AS sum, count(*) AS count FROM r GROUP BY label, day""")
def _(t):
    rows = t.fx_sample.select(F.concat_ws("@", "label", F.floor(F.col("ts_ms") / 86_400_000).cast("string")).alias("label"), "point")
    return tel.exact_percentiles(rows, "label", "point", (500, 950))


HOURS = """s AS (SELECT label, ts_ms // 3600000 AS hour, point FROM fx_sample), last AS (SELECT max(ts_ms - 300000) // 3600000 AS last FROM fx_sample),
  r AS (SELECT label, hour, point, row_number() OVER (PARTITION BY label, hour ORDER BY point) - 1 AS i, count(*) OVER (PARTITION BY label, hour) AS n FROM s),
  w AS (SELECT label, hour, max(point) FILTER (i = n * 500 // 1000) AS p50, max(point) FILTER (i = n * 990 // 1000) AS p99, CAST(sum(point) AS BIGINT) AS sum, count(*) AS count FROM r GROUP BY ALL),
  k AS (SELECT label, unnest(range(min(hour), (SELECT last FROM last))) AS hour FROM s GROUP BY label)"""


@query("t5_window_percentiles", f"WITH {HOURS} SELECT label, hour, coalesce(p50, 0) AS p50, coalesce(p99, 0) AS p99, coalesce(sum, 0) AS sum, coalesce(count, 0) AS count FROM k LEFT JOIN w USING (label, hour)")
def _(t):
    """Hours that the watermark has passed, exact percentiles, and zeros where a label that is known is silent."""
    found = finished(percentile_windows(sample_stream(t), "at", "label", "point", (500, 990), 3_600_000), t, "t5marks")
    return found.select("label", F.floor(F.col("start") / 3_600_000).alias("hour"), F.col("percentiles")[0].alias("p50"), F.col("percentiles")[1].alias("p99"), "sum", "count")


@query("t5_window_stream", "SELECT label, day, CAST(sum(point) AS BIGINT) AS sum, count(*) AS count FROM (SELECT label, ts_ms // 86400000 AS day, point FROM fx_sample) WHERE day < (SELECT max(ts_ms - 300000) // 86400000 FROM fx_sample) GROUP BY ALL")
def _(t):
    found = finished(percentile_windows(sample_stream(t), "at", "label", "point", width_ms=86_400_000), t, "t5").where("count > 0")
    return found.select("label", F.floor(F.col("start") / 86_400_000).alias("day"), "sum", "count")


@query("t5_zero_filled", f"WITH {HOURS} SELECT label, hour, coalesce(sum, 0) AS sum, coalesce(count, 0) AS count FROM k LEFT JOIN w USING (label, hour)")
def _(t):
    hours = t.fx_sample.groupBy("label", F.floor(F.col("ts_ms") / 3_600_000).alias("window")).agg(F.sum("point").alias("sum"), F.count("*").alias("count"))
    last = t.fx_sample.agg(F.floor((F.max("ts_ms") - 300_000) / 3_600_000))
    return st.zero_filled(hours, "label", last).withColumnRenamed("window", "hour")


@query("t6_late_samples", """WITH x AS (SELECT event_type AS label, CAST(epoch_us(ts) // 1000 AS BIGINT) AS ms, CAST(epoch_us(ts) // 86400000000 AS BIGINT) AS day, event_id % 2 AS odd, event_id % 4 <> 2 AS part FROM events),
  m AS (SELECT max(ms) FILTER (odd = 1) - 300000 AS first, max(ms) - 300000 AS last FROM x)
  SELECT label, day, count(*) FILTER (part OR (day + 1) * 86400000 > first) AS count FROM x, m WHERE (day + 1) * 86400000 <= last GROUP BY label, day, first
  HAVING count(*) FILTER (part OR (day + 1) * 86400000 > first) > 0""")
def _(t):
    """Odd events arrive first, and set the mark that the third part is held against: what belongs to closed windows is too late."""
    path = parted(t, t.events, ["event_id % 2 = 1", "event_id % 4 = 0", "event_id % 4 = 2"], "t6")
    stream = t.spark.readStream.schema(t.events.schema).option("maxFilesPerTrigger", 1).parquet(path)
    samples = stream.select(F.col("event_type").alias("label"), F.col("ts").cast("timestamp").alias("at"), F.lit(1).cast("long").alias("point"))
    found = finished(percentile_windows(samples, "at", "label", "point", width_ms=86_400_000), t, "t6out").where("count > 0")
    return found.select("label", F.floor(F.col("start") / 86_400_000).alias("day"), "count")


@query("t8_after_cursor", """WITH c AS (SELECT 'm' || i AS module, i * 700 AS cursor_tx FROM range(5) r(i)), f AS (SELECT e.module, e.tx_sequence_number AS tx, max(e.tx_sequence_number) OVER (PARTITION BY e.module) AS last
  FROM fx_event e LEFT JOIN c USING (module) WHERE cursor_tx IS NULL OR e.tx_sequence_number > cursor_tx) SELECT module, tx FROM f WHERE tx < last""")
def _(t):
    events = t.fx_event.select("module", F.col("tx_sequence_number").alias("tx"), F.col("event_sequence_number").alias("seq"))
    i = F.substring("module", 2, 9).cast("long")
    cursors = events.select("module").distinct().where(i < 5).select("module", (i * 700).alias("cursor_tx"), F.lit(0).cast("long").alias("cursor_seq"))
    return st.after_cursor(events, cursors).select("module", "tx")


SEEN_SCHEMA = "address long, first_appearance_tx long, first_appearance_time long, last_appearance_tx long, last_appearance_time long"


def seen_table(t: Tables, name: str) -> StateTable:
    return StateTable(t.spark, fresh(t, name), T.StructType.fromDDL(SEEN_SCHEMA), StateTable.hashed(["address"], 64))


def senders_seen(d: DataFrame) -> DataFrame:
    return m.first_last_seen(d, "sender", "tx_time_ms", "tx_sequence_number")


@query("t10_incremental_rollup", SEEN.format(SENDERS))
def _(t):
    table = seen_table(t, "t10")
    st.rollup_stream(tx_stream(t), senders_seen, m.merge_seen, table, fresh(t, "progress")).awaitTermination()
    return table.read()


@query("t10_rollup_of_batches", SEEN.format(SENDERS))
def _(t):
    """The same where events arrive in two batches, so that the second is merged."""
    table, files = seen_table(t, "t10"), parted(t, t.events, ["user_id % 3 = 0 and event_id % 2 = 0", "user_id % 3 <> 0 or event_id % 2 <> 0"], "t10files")
    events = t.spark.readStream.schema(t.events.schema).option("maxFilesPerTrigger", 1).parquet(files)
    tx = t.spark.sql(views.spark_sql("fx_tx").replace("FROM events", "FROM {events}"), events=events)
    st.rollup_stream(tx, senders_seen, m.merge_seen, table, fresh(t, "progress")).awaitTermination()
    return table.read()


@query("t10_written_buckets", """WITH b AS (SELECT epoch // 10 AS batch, checkpoint_sequence_number // 100 AS bucket, checkpoint_sequence_number AS c, count(*) AS n FROM fx_tx GROUP BY ALL)
  SELECT bucket, max(batch) AS version, CAST(sum(n) AS BIGINT) AS total_transaction_blocks FROM b GROUP BY 1""")
def _(t):
    """Counts by checkpoint in buckets of a hundred, a batch for each ten epochs: what a bucket's version says is the last batch that touched it."""
    schema = T.StructType.fromDDL("checkpoint_sequence_number long, total_transaction_blocks long")
    table = StateTable(t.spark, fresh(t, "t10b"), schema, F.floor(F.col("checkpoint_sequence_number") / 100))
    added = lambda old, new: old.unionByName(new).groupBy("checkpoint_sequence_number").agg(F.sum("total_transaction_blocks").alias("total_transaction_blocks"))
    last = t.fx_tx.agg(F.max("epoch")).first()[0]
    for batch in [*range(last // 10 + 1), last // 10]:  # the last one is tried twice
        new = t.fx_tx.where(F.floor(F.col("epoch") / 10) == batch).groupBy("checkpoint_sequence_number").agg(F.count("*").alias("total_transaction_blocks"))
        table.merge(batch, new, added)
    versions = table.history().where(F.col("batch") == last // 10).select("bucket", "version")
    counts = table.read().groupBy(F.floor(F.col("checkpoint_sequence_number") / 100).alias("bucket")).agg(F.sum("total_transaction_blocks").alias("total_transaction_blocks"))
    return versions.join(counts, "bucket")


@query("t10_tx_count_stream", """SELECT checkpoint_sequence_number, count(*) AS total_transaction_blocks, count_if(execution_success) AS total_successful_transaction_blocks,
  CAST(sum(CASE WHEN execution_success THEN command_count ELSE 0 END) AS BIGINT) AS total_successful_transactions FROM fx_tx GROUP BY 1""")
def _(t):
    return finished(st.incremental_counts(tx_stream(t)), t, "t10counts", "complete")


@query("t11_snapshot_policy", """SELECT epoch, CASE WHEN last_checkpoint_id > 100 + 90 THEN 100 + 60 END AS fold_to FROM fx_epoch""")
def _(t):
    return t.fx_epoch.select("epoch", fold_point(F.col("last_checkpoint_id"), 100, 30, 90).alias("fold_to"))


RUN = "run AS (SELECT seq FROM (SELECT seq, seq - row_number() OVER (ORDER BY seq) AS gap FROM (SELECT DISTINCT {} AS seq FROM {})) QUALIFY gap = first_value(gap) OVER (ORDER BY seq))"


@query("s1_checkpoint_files", f"""WITH f AS (SELECT sequence_number AS seq, epoch FROM fx_checkpoint WHERE sequence_number % 101 <> 100), {RUN.format("seq", "f")} SELECT seq, epoch FROM f WHERE seq IN (SELECT seq FROM run)""")
def _(t):
    """Files by number, read from the first one up to the first that is missing."""
    path, cps = fresh(t, "s1"), t.fx_checkpoint.where("sequence_number % 101 <> 100")
    summary = F.struct("sequence_number", "epoch", "timestamp_ms")
    cps.repartition("sequence_number").select(F.col("sequence_number").alias("seq"), summary.alias("summary")).write.partitionBy("seq").json(path)
    start = cps.agg(F.min("sequence_number")).first()[0]
    found = src.read_until_gap(src.read_checkpoint_files(t.spark, path, start), start)
    return found.select(F.col("file_sequence").alias("seq"), "summary.epoch")


@query("s7_rolling_cut", """WITH RECURSIVE o AS MATERIALIZED (SELECT row_number() OVER (ORDER BY epoch, tx_time_ms, tx_sequence_number) - 1 AS i, epoch, tx_time_ms AS ts, command_count AS size, tx_sequence_number AS tx FROM fx_tx),
  walk AS (SELECT i, epoch, ts AS first_ts, size::BIGINT AS held, i AS file, tx FROM o WHERE i = 0 UNION ALL SELECT i, epoch, CASE WHEN ends THEN ts ELSE first_ts END, CASE WHEN ends THEN size ELSE held + size END, CASE WHEN ends THEN i ELSE file END, tx
  FROM (SELECT o.i, o.epoch, o.ts, o.size, o.tx, w.first_ts, w.held, w.file, o.epoch <> w.epoch OR o.i - w.file >= 40 OR o.ts - w.first_ts > 21600000 OR (o.i % 5 = 0 AND w.held > 70) AS ends FROM walk w JOIN o ON o.i = w.i + 1))
  SELECT epoch, tx AS tx_sequence_number, file FROM walk""")
def _(t):
    """Files end at 40 rows, 6 hours or a size beyond 70, which every fifth row is held against; all three begin anew with a file."""
    cut = rolling_cut(t.fx_tx, "epoch", ["tx_time_ms", "tx_sequence_number"], "tx_time_ms", "command_count", 40, 21_600_000, 70, 5, block_rows=512)
    return cut.select("epoch", "tx_sequence_number", "file")


@query("s7_cut_files", """WITH RECURSIVE o AS MATERIALIZED (SELECT row_number() OVER (ORDER BY epoch, tx_time_ms, tx_sequence_number) - 1 AS i, epoch, tx_time_ms AS ts, command_count AS size FROM fx_tx),
  walk AS (SELECT i, epoch, ts AS first_ts, size::BIGINT AS held, i AS file FROM o WHERE i = 0 UNION ALL SELECT i, epoch, CASE WHEN ends THEN ts ELSE first_ts END, CASE WHEN ends THEN size ELSE held + size END, CASE WHEN ends THEN i ELSE file END
  FROM (SELECT o.i, o.epoch, o.ts, o.size, w.first_ts, w.held, w.file, o.epoch <> w.epoch OR o.i - w.file >= 100 OR o.ts - w.first_ts > 86400000 OR w.held > 150 AS ends FROM walk w JOIN o ON o.i = w.i + 1))
  SELECT epoch, file, count(*) AS n, CAST(max(held) AS BIGINT) AS size FROM walk GROUP BY ALL""")
def _(t):
    """The files as written, in a folder for each epoch, read back and measured."""
    path = fresh(t, "s7")
    cut = rolling_cut(t.fx_tx, "epoch", ["tx_time_ms", "tx_sequence_number"], "tx_time_ms", "command_count", 100, 86_400_000, 150, block_rows=256)
    sinks.write_cut_files(cut.select("epoch", "file", "tx_sequence_number", "command_count"), path)
    found = t.spark.read.schema("tx_sequence_number long, command_count long, epoch long, file long").parquet(path)
    return found.groupBy("epoch", "file").agg(F.count("*").alias("n"), F.sum("command_count").alias("size"))


@query("s13_manifest", "SELECT count(DISTINCT object_id) FILTER (object_status = 0) AS objects, CAST(0 AS BIGINT) AS failures FROM (SELECT * FROM fx_object_history QUALIFY row_number() OVER (PARTITION BY object_id ORDER BY object_version DESC) = 1)")
def _(t):
    """Every file of a snapshot is in its manifest, and has the manifest's digest."""
    path = fresh(t, "s13")
    live = latest_version(t.fx_object_history).where("object_status = 0").select("object_id", "object_version")
    listed = sinks.write_snapshot(live, path, 7, "object_id", 4)
    files = t.spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path)
    failures = checksum_failures(files.select(F.col("path").alias("file"), "content"), listed).agg(F.count("*").alias("failures"))
    read = t.spark.read.schema("object_id long, object_version long").option("recursiveFileLookup", "true").parquet(path)
    return read.agg(F.count("*").alias("objects")).crossJoin(failures)  # one row each


@query("s13_snapshot_versions", """WITH f AS (SELECT *, checkpoint_sequence_number // 600 AS batch, object_id // 20 AS bucket FROM fx_object_history), b AS (SELECT bucket, max(batch) AS version FROM f GROUP BY 1),
  l AS (SELECT bucket, object_id, object_version FROM (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY object_id ORDER BY object_version DESC) = 1) WHERE object_status = 0)
  SELECT bucket, version, count(*) AS objects, CAST(sum(object_version) AS BIGINT) AS versions, CAST(0 AS BIGINT) AS failures FROM l JOIN b USING (bucket) GROUP BY ALL""")
def _(t):
    """A snapshot for each 600 checkpoints from the one before; the last one's buckets, who wrote them, and their files' digests."""
    # Each batch scans the history, which is numbered once.
    history = materialize(t.fx_object_history.select("object_id", "object_version", "object_status", "checkpoint_sequence_number"), "s13-history")
    table = StateTable(t.spark, fresh(t, "s13v"), T.StructType.fromDDL("object_id long, object_version long, object_status int"), F.floor(F.col("object_id") / 20))
    last = history.agg(F.max("checkpoint_sequence_number")).first()[0] // 600
    for batch in range(last + 1):
        changed = latest_version(history.where(F.floor(F.col("checkpoint_sequence_number") / 600) == batch))
        listed = sinks.fold_snapshot_files(table, batch, changed, "object_id")
    files = t.spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(f"{table.path}/data")
    failed = checksum_failures(files.select(F.col("path").alias("file"), "content"), listed.select("file", "length", "digest").distinct()).join(listed, "file").groupBy("bucket").agg(F.count("*").alias("failures"))
    rows = table.read().groupBy(F.floor(F.col("object_id") / 20).alias("bucket")).agg(F.count("*").alias("objects"), F.sum("object_version").alias("versions"))
    whole = rows.join(listed.select("bucket", "version").distinct(), "bucket").join(failed, "bucket", "left")
    return whole.select("bucket", "version", "objects", "versions", F.coalesce("failures", F.lit(0)).cast("long").alias("failures"))


@query("a10_bucketed_upsert", SEEN.format(SENDERS))
def _(t):
    """A batch for each ten epochs, merged into the buckets of its senders."""
    table, last = seen_table(t, "a10"), t.fx_tx.agg(F.max("epoch")).first()[0] // 10
    for batch in range(last + 1):
        table.merge(batch, senders_seen(t.fx_tx.where(F.floor(F.col("epoch") / 10) == batch)), m.merge_seen)
    return table.read()


@query("t4_collectable_inputs", "SELECT sequence_number FROM fx_checkpoint WHERE sequence_number < (SELECT min(m) FROM (SELECT max(checkpoint_sequence_number) - count(*) % 7 AS m FROM fx_tx GROUP BY transaction_kind))")
def _(t):
    """Inputs below what all pipelines have passed; a kind of transaction is a pipeline."""
    progress = t.fx_tx.groupBy(F.col("transaction_kind").alias("pipeline")).agg((F.max("checkpoint_sequence_number") - F.count("*") % 7).alias("watermark"))
    return src.collectable(t.fx_checkpoint, progress, "sequence_number").select("sequence_number")


@query("t4_collected_files", "SELECT sequence_number AS seq FROM fx_checkpoint WHERE sequence_number >= (SELECT CAST(floor(max(sequence_number) / 2) AS BIGINT) FROM fx_checkpoint)")
def _(t):
    """What is left of the input files below the slowest pipeline's watermark once they are deleted."""
    path = fresh(t, "t4")
    t.fx_checkpoint.repartition("sequence_number").select(F.col("sequence_number").alias("seq"), F.struct("sequence_number", "epoch").alias("summary")).write.partitionBy("seq").json(path)
    half = t.fx_checkpoint.agg(F.floor(F.max("sequence_number") / 2).alias("watermark"))
    src.collect_inputs(path, half.union(t.fx_checkpoint.agg(F.max("sequence_number"))), fresh(t, "t4pruned"))
    return src.read_checkpoint_files(t.spark, path).select(F.col("file_sequence").alias("seq"))


def record_files(t: Tables, name: str, wanted: str = "true") -> str:
    """The nested records as compressed files, a folder for each checkpoint. A record is one row, so that none has to move again."""
    path, records = fresh(t, name), checkpoint_records(t).withColumn("seq", F.col("summary.sequence_number")).where(wanted)
    sinks.write_record_files(records, path)
    return path


@query("s2_bounded_prefetch", """WITH c AS (SELECT DISTINCT o_orderkey // 64 AS seq FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)),
  g AS (SELECT min(seq) + 1 AS gap FROM c WHERE seq <> 170 AND (seq + 1 = 170 OR seq + 1 NOT IN (SELECT seq FROM c)))
  SELECT seq, CASE WHEN seq < 50 THEN seq // 20 WHEN seq < 100 THEN 3 + (seq - 50) // 20 ELSE 6 + (seq - 100) // 20 END AS batch FROM c, g WHERE seq < gap AND seq < 240""")
def _(t):
    """Twenty files a trigger, fifty beyond what is pruned; 50 are pruned before a restart, then 190; file 170 is missing."""
    path, out, state = record_files(t, "s2", "seq <> 170"), fresh(t, "s2out"), fresh(t, "s2state")
    for below in (0, 50, 190):
        bounded.write_number(f"{state}/pruned", below)
        records = bounded.stream_bounded(t.spark, path, 0, 20, 50, f"{state}/progress", f"{state}/pruned").select("file_sequence")
        write = lambda df, i: df.write.mode("overwrite").parquet(f"{out}/batch={i}")
        st.run_to_end(records.writeStream.foreachBatch(write).option("checkpointLocation", f"{state}/log").start())
    return t.spark.read.schema("file_sequence long, batch long").parquet(out).select(F.col("file_sequence").alias("seq"), "batch")


@query("t1_checkpoint_pipelines", f"""WITH {TX}, b AS (SELECT checkpoint, CAST(sum(CAST(round(o_totalprice) AS DECIMAL(20,0))) + 2 AS DECIMAL(38,0)) AS cost FROM x GROUP BY 1)
  SELECT 'checkpoint' AS name, concat('d', checkpoint) AS id, checkpoint, CAST(cost AS VARCHAR) AS value FROM b
  UNION ALL SELECT 'transaction', transaction_digest, checkpoint, CAST(count(*) AS VARCHAR) FROM l GROUP BY ALL
  UNION ALL SELECT 'event', transaction_digest, checkpoint, concat('t', n, owner) FROM l
  UNION ALL SELECT 'object', id, checkpoint, {{STATUS}} FROM l WINDOW w AS (PARTITION BY transaction_digest, id)""".replace("{STATUS}", STATUS))
def _(t):
    """Four flatteners over the checkpoint files, each with its own progress, a hundred files a trigger and 150 beyond what all have passed."""
    path, out = record_files(t, "t1files"), fresh(t, "t1out")
    handlers = {"checkpoint": fl.flatten_checkpoint, "transaction": fl.flatten_transaction, "event": fl.flatten_event, "object": fl.flatten_object}
    st.run_pipelines(t.spark, path, handlers, out, fresh(t, "t1state"), 100, 150)
    read = lambda name, key, value: t.spark.read.parquet(f"{out}/{name}").select(F.lit(name).alias("name"), F.col(key).alias("id"), "checkpoint" if name != "checkpoint" else F.col("sequence_number").alias("checkpoint"), value.cast("string").alias("value"))
    parts = [read("checkpoint", "digest", F.col("total_gas_cost")), read("transaction", "transaction_digest", F.col("transaction_count")), read("event", "transaction_digest", F.concat("event_type", "sender")), read("object", "object_id", F.col("object_status"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query("d5_handler", "SELECT sender, count(*) AS n FROM fx_tx WHERE execution_success GROUP BY 1")
def _(t):
    """A handler that is registered by name and applied to what arrives."""
    st.handler("successes")(lambda d: d.where("execution_success").select("sender", "tx_sequence_number"))
    path = fresh(t, "d5")
    st.flatten_stream(tx_stream(t), {n: st.HANDLERS[n] for n in ("successes",)}, path, fresh(t, "progress")).awaitTermination()
    return t.spark.read.schema("sender long, tx_sequence_number long, batch long").parquet(f"{path}/successes").groupBy("sender").agg(F.count("*").alias("n"))
