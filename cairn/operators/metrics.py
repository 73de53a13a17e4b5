"""Network metrics and rollups over checkpoints, transactions, calls and addresses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.operators.series import previous, running_sums

DAY_MS = 86_400_000


def tx_count_metrics(tx: DataFrame, checkpoint: str = "checkpoint_sequence_number", success: str = "execution_success", commands: str = "command_count") -> DataFrame:
    """A1: for each checkpoint its transaction blocks, the successful ones, and the commands of the successful ones."""
    return tx.groupBy(F.col(checkpoint).alias("checkpoint_sequence_number")).agg(
        F.count("*").alias("total_transaction_blocks"),
        F.count_if(F.col(success)).alias("total_successful_transaction_blocks"),
        F.sum(F.when(F.col(success), F.col(commands)).otherwise(F.lit(0))).cast("long").alias("total_successful_transactions"),
    )


def rolling_totals(checkpoints: DataFrame, order: str, columns: dict[str, str], bucket: Column) -> DataFrame:
    """A2: totals carried from checkpoint to checkpoint; columns maps new names to counted columns."""
    return running_sums(checkpoints, [order], columns, bucket)


def tps_series(checkpoints: DataFrame, ts: str, txs: str, bucket: Column, seq: str = "sequence_number", newest_first: bool = False) -> DataFrame:
    """Throughput of each distinct timestamp against the one before (W1) or, newest first, the one after.

    ts, seq (the largest of the timestamp's checkpoints), tps; timestamps without a neighbour have no row.
    """
    equal = checkpoints.groupBy(F.col(ts).alias("ts")).agg(F.sum(txs).alias("txs"), F.max(seq).alias("seq"))
    if newest_first:
        pairs = previous(equal.withColumn("neg", -F.col("ts")), "neg", "ts", "other", -bucket)
        gap = F.col("other") - F.col("ts")
    else:
        pairs = previous(equal, "ts", "ts", "other", bucket)
        gap = F.col("ts") - F.col("other")
    return pairs.where(F.col("other").isNotNull()).select("ts", "seq", (F.col("txs").cast("double") * 1000 / gap).alias("tps"))


def real_time_tps(checkpoints: DataFrame, ts: str = "timestamp_ms", txs: str = "total_successful_transactions", seq: str = "sequence_number", newest: int = 100, legacy: bool = False) -> DataFrame:
    """W1, and with legacy W2: sequence number and throughput over the newest checkpoints, a fixed number of rows."""
    few = checkpoints.orderBy(F.desc(ts), F.desc(seq)).limit(newest)
    return tps_series(few, ts, txs, F.lit(0), seq, legacy).select(F.col("seq").alias("sequence_number"), "tps")


def epoch_peak_tps(checkpoints: DataFrame, epoch: str = "epoch", ts: str = "timestamp_ms", txs: str = "total_successful_transactions", days: int = 30) -> DataFrame:
    """The peak throughput of each epoch, and of the last ``days`` epochs up to it."""
    of = checkpoints.groupBy(F.col(ts).alias("ts")).agg(F.max(epoch).alias("epoch"))
    series = tps_series(checkpoints, ts, txs, F.floor(F.col("ts") / DAY_MS)).join(of, "ts")
    peaks = series.groupBy("epoch").agg(F.max("tps").alias("peak_tps"))
    last = Window.orderBy("epoch").rangeBetween(-(days - 1), 0)  # one row for each epoch
    return peaks.withColumn("peak_tps_30d", F.max("peak_tps").over(last))


def top_calls(calls: DataFrame, keys: list[str], epoch: str = "epoch", days: tuple[int, ...] = (3, 7, 30), last_epoch: int | None = None, k: int = 10) -> DataFrame:
    """The k most frequent keys with epoch >= last - days, for each span of days; ties by the keys.

    One aggregation serves all spans; ranking sees one row for each distinct call.
    """
    last = F.lit(last_epoch) if last_epoch is not None else F.col("__last")
    if last_epoch is None:
        calls = calls.crossJoin(F.broadcast(calls.agg(F.max(epoch).alias("__last"))))  # one row
    counts = calls.groupBy(*keys).agg(*[F.count_if(F.col(epoch) >= last - d).alias(f"d{d}") for d in days])
    spans = counts.select(*keys, F.explode(F.array(*[F.struct(F.lit(d).alias("day"), F.col(f"d{d}").alias("count")) for d in days])).alias("s"))
    flat = spans.select("s.day", *keys, "s.count").where("count > 0")
    rank = F.row_number().over(Window.partitionBy("day").orderBy(F.desc("count"), *keys))
    return flat.withColumn("rank", rank).where(F.col("rank") <= k)


def first_epoch_since(epochs: DataFrame, now_ms: int, days: int, epoch: str = "epoch", start: str = "epoch_start_timestamp") -> DataFrame:
    """One row: the first epoch that started after now - days."""
    return epochs.where(F.col(start) > now_ms - days * DAY_MS).agg(F.min(epoch).alias("first_epoch"))


def top_calls_since(calls: DataFrame, epochs: DataFrame, keys: list[str], now_ms: int, days: tuple[int, ...] = (3, 7, 30), k: int = 10, epoch: str = "epoch") -> DataFrame:
    """As A6, but the spans are wall time before now_ms, looked up in the epochs' start times."""
    out = None
    for d in days:
        bound = F.broadcast(first_epoch_since(epochs, now_ms, d))
        counts = calls.crossJoin(bound).where(F.col(epoch) >= F.col("first_epoch")).groupBy(*keys).agg(F.count("*").alias("count"))
        top = counts.orderBy(F.desc("count"), *keys).limit(k).select(F.lit(d).alias("day"), *keys, "count")
        out = top if out is None else out.unionByName(top)
    return out


def first_last_seen(rows: DataFrame, address: str, ts: str, tx: str) -> DataFrame:
    """For each address its first and last time and transaction; of equal times the lowest transaction counts."""
    return (
        rows.groupBy(F.col(address).alias("address"))
        .agg(F.min(F.struct(F.col(ts).alias("t"), F.col(tx).alias("x"))).alias("a"), F.max(F.struct(F.col(ts).alias("t"), (-F.col(tx)).alias("x"))).alias("z"))
        .select("address", F.col("a.x").alias("first_appearance_tx"), F.col("a.t").alias("first_appearance_time"), (-F.col("z.x")).alias("last_appearance_tx"), F.col("z.t").alias("last_appearance_time"))
    )


def merge_seen(stored: DataFrame, new: DataFrame) -> DataFrame:
    """A10: the stored table of first_last_seen() with a batch of new rows of the same shape."""
    both = stored.unionByName(new)
    low, high = F.struct("first_appearance_time", "first_appearance_tx"), F.struct(F.col("last_appearance_time").alias("t"), (-F.col("last_appearance_tx")).alias("x"))
    return both.groupBy("address").agg(F.min(low).alias("a"), F.max(high).alias("z")).select(
        "address", "a.first_appearance_tx", "a.first_appearance_time", (-F.col("z.x")).alias("last_appearance_tx"), F.col("z.t").alias("last_appearance_time")
    )


def address_metrics(checkpoints: DataFrame, addresses: DataFrame, active: DataFrame, seq: str = "sequence_number", epoch: str = "epoch", ts: str = "timestamp_ms") -> DataFrame:
    """For each checkpoint, addresses and active addresses seen up to it, and those last active in the 24 hours before.

    addresses and active are tables of first_last_seen(). First appearances and checkpoints are counted along one order of time.
    """
    cps = checkpoints.select(F.col(seq).alias("checkpoint"), F.col(epoch).alias("epoch"), F.col(ts).alias("ts"))
    seen = lambda table, name: table.groupBy(F.col("first_appearance_time").alias("ts")).agg(F.count("*").alias(name))
    zero = F.lit(0).cast("long")
    # An address whose last time is t counts from t on and no more after t + 24 hours.
    ended = active.groupBy(F.col("last_appearance_time").alias("t")).agg(F.count("*").alias("c"))
    none = {"checkpoint": F.lit(None).cast("long"), "epoch": F.lit(None).cast("long"), "late": F.lit(0)}
    marks = (
        seen(addresses, "a").withColumns({"b": zero, "c": zero, **none})
        .unionByName(seen(active, "b").withColumns({"a": zero, "c": zero, **none}))
        .unionByName(ended.select(F.col("t").alias("ts"), "c").withColumns({"a": zero, "b": zero, **none}))
        .unionByName(ended.select((F.col("t") + DAY_MS + 1).alias("ts"), (-F.col("c")).alias("c")).withColumns({"a": zero, "b": zero, **none}))
        .unionByName(cps.withColumns({"a": zero, "b": zero, "c": zero, "late": F.lit(1)}))
    )
    summed = running_sums(marks, ["ts", "late", "checkpoint"], {"cumulative_addresses": "a", "cumulative_active_addresses": "b", "daily_active_addresses": "c"}, F.floor(F.col("ts") / DAY_MS))
    return summed.where("late = 1").select("checkpoint", "epoch", "ts", "cumulative_addresses", "cumulative_active_addresses", "daily_active_addresses")


def last_of_epoch(metrics: DataFrame, epoch: str = "epoch", order: str = "checkpoint") -> DataFrame:
    """The row of each epoch's last checkpoint."""
    rest = [c for c in metrics.columns if c != epoch]
    return metrics.groupBy(epoch).agg(F.max_by(F.struct(*rest), order).alias("r")).select(epoch, "r.*")


def network_metrics(checkpoints: DataFrame, addresses: DataFrame, objects: DataFrame, packages: DataFrame) -> DataFrame:
    """One row of the newest throughput, the 30-day peak, exact totals and the latest epoch and checkpoint.

    addresses, objects and packages have one row for each thing counted.
    """
    peaks = epoch_peak_tps(checkpoints)
    newest = real_time_tps(checkpoints).agg(F.max_by("tps", "sequence_number").alias("current_tps"))
    out = newest.crossJoin(peaks.agg(F.max_by("peak_tps_30d", "epoch").alias("tps_30_days")))
    for table, name in ((addresses, "total_addresses"), (objects, "total_objects"), (packages, "total_packages")):
        out = out.crossJoin(table.agg(F.count("*").alias(name)))
    return out.crossJoin(checkpoints.agg(F.max("epoch").alias("current_epoch"), F.max("sequence_number").alias("current_checkpoint")))


def epoch_totals(epochs: DataFrame, latest_checkpoint: int | None = None) -> DataFrame:
    """Net inflow of storage funds (null if a part is), and checkpoints of an epoch, last - first.

    An open epoch, with a null last checkpoint, uses latest_checkpoint.
    """
    last = F.coalesce("last_checkpoint_id", F.lit(latest_checkpoint).cast("long"))
    return epochs.select("epoch", (F.col("storage_charge") - F.col("storage_rebate")).alias("net_inflow"), (last - F.col("first_checkpoint_id")).alias("total_checkpoints"))


def available_range(snapshot: DataFrame, checkpoints: DataFrame, snapshot_cp: str = "checkpoint_sequence_number", cp: str = "sequence_number") -> DataFrame:
    """(lhs, rhs), the snapshot's and the table's last checkpoint; a single distinct value v gives (0, v), none (0, 0)."""
    both = snapshot.agg(F.max(snapshot_cp).alias("v")).union(checkpoints.agg(F.max(cp).alias("v"))).where("v is not null").distinct()
    one = both.agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    zero = F.lit(0).cast("long")
    return one.select(F.when(F.col("n") == 2, F.col("low")).otherwise(zero).alias("lhs"), F.coalesce("high", zero).alias("rhs"))


def gas_summary(tx: DataFrame, by: str) -> DataFrame:
    """Storage, computation, rebate and non-refundable fee summed by epoch or checkpoint, and the net."""
    parts = ["computation_cost", "storage_cost", "storage_rebate", "non_refundable_storage_fee"]
    total = tx.groupBy(by).agg(*[F.sum(p).cast("decimal(38,0)").alias(p) for p in parts])
    return total.withColumn("net_gas", (F.col("storage_cost") + F.col("computation_cost") - F.col("storage_rebate")).cast("decimal(38,0)"))


def min_watermark(progress: DataFrame, column: str = "watermark") -> DataFrame:
    """What all pipelines have passed."""
    return progress.agg(F.min(column).alias("min_watermark"))


def table_summary(table: DataFrame, key: str, value: str) -> DataFrame:
    """Keys, bytes of keys and values, and the median and largest size of each."""
    k, v = F.octet_length(F.col(key).cast("string")), F.octet_length(F.col(value).cast("string"))
    return table.select(k.alias("k"), v.alias("v")).agg(
        F.count("*").alias("num_keys"), F.sum("k").cast("long").alias("key_bytes"), F.sum("v").cast("long").alias("value_bytes"),
        F.percentile("k", F.lit(0.5)).alias("key_size_p50"), F.max("k").cast("long").alias("key_size_max"),
        F.percentile("v", F.lit(0.5)).alias("value_size_p50"), F.max("v").cast("long").alias("value_size_max"),
    )


def epoch_refresh(checkpoints: DataFrame, calls: DataFrame, epochs: DataFrame, keys: list[str], now_ms: int) -> dict[str, DataFrame]:
    """D3: what is rebuilt when an epoch ends: the top calls by wall time and the peaks of all epochs."""
    return {"top_calls": top_calls_since(calls, epochs, keys, now_ms), "epoch_peak_tps": epoch_peak_tps(checkpoints)}
