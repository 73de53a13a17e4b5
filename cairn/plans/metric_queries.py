"""Queries of the metrics operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.operators import metrics as m
from cairn.operators.joins import range_lookup
from cairn.operators.series import previous
from cairn.plans.registry import query

TPS = """SELECT ts, CAST(txs AS DOUBLE) * 1000 / (ts - lag(ts) OVER (ORDER BY ts)) AS tps, seq FROM (SELECT timestamp_ms AS ts,
  sum(total_successful_transactions) AS txs, max(sequence_number) AS seq FROM {} GROUP BY 1)"""


@query("a1_tx_count_metrics", """SELECT checkpoint_sequence_number, count(*) AS total_transaction_blocks,
  count_if(execution_success) AS total_successful_transaction_blocks,
  CAST(sum(CASE WHEN execution_success THEN command_count ELSE 0 END) AS BIGINT) AS total_successful_transactions FROM fx_tx GROUP BY 1""")
def _(t):
    return m.tx_count_metrics(t.fx_tx)


@query("a2_rolling_totals", """SELECT sequence_number, CAST(sum(total_transactions) OVER w AS BIGINT) AS rolling_transactions,
  CAST(sum(total_transaction_blocks) OVER w AS BIGINT) AS rolling_blocks, CAST(sum(total_successful_transactions) OVER w AS BIGINT) AS rolling_successful,
  CAST(sum(total_successful_transaction_blocks) OVER w AS BIGINT) AS rolling_successful_blocks
  FROM fx_checkpoint WINDOW w AS (ORDER BY sequence_number ROWS UNBOUNDED PRECEDING)""")
def _(t):
    columns = {"rolling_transactions": "total_transactions", "rolling_blocks": "total_transaction_blocks", "rolling_successful": "total_successful_transactions", "rolling_successful_blocks": "total_successful_transaction_blocks"}
    return m.rolling_totals(t.fx_checkpoint, "sequence_number", columns, F.col("epoch")).select("sequence_number", *columns)


@query("w1_real_time_tps", f"""WITH few AS (SELECT * FROM fx_checkpoint ORDER BY timestamp_ms DESC, sequence_number DESC LIMIT 100),
  s AS ({TPS.format("few")}) SELECT seq AS sequence_number, tps FROM s WHERE tps IS NOT NULL""")
def real_time_tps(t):
    return m.real_time_tps(t.fx_checkpoint)


@query("w2_real_time_tps_legacy", """WITH few AS (SELECT * FROM fx_checkpoint ORDER BY timestamp_ms DESC, sequence_number DESC LIMIT 100),
  s AS (SELECT timestamp_ms AS ts, sum(total_successful_transactions) AS txs, max(sequence_number) AS seq FROM few GROUP BY 1),
  l AS (SELECT *, lag(ts) OVER (ORDER BY ts DESC) AS next FROM s)
  SELECT seq AS sequence_number, CAST(txs AS DOUBLE) * 1000 / (next - ts) AS tps FROM l WHERE next IS NOT NULL""")
def _(t):
    return m.real_time_tps(t.fx_checkpoint, legacy=True)


@query("a14_epoch_peak_tps", f"""WITH s AS ({TPS.format("fx_checkpoint")}), e AS (SELECT epoch, max(tps) AS peak_tps FROM s
  JOIN (SELECT timestamp_ms, max(epoch) AS epoch FROM fx_checkpoint GROUP BY 1) c ON c.timestamp_ms = s.ts WHERE tps IS NOT NULL GROUP BY epoch)
  SELECT epoch, peak_tps, max(peak_tps) OVER (ORDER BY epoch RANGE BETWEEN 29 PRECEDING AND CURRENT ROW) AS peak_tps_30d FROM e""")
def _(t):
    return m.epoch_peak_tps(t.fx_checkpoint)


@query("w13_rolling_peak_7d", f"""WITH s AS ({TPS.format("fx_checkpoint")}), e AS (SELECT epoch, max(tps) AS peak_tps FROM s
  JOIN (SELECT timestamp_ms, max(epoch) AS epoch FROM fx_checkpoint GROUP BY 1) c ON c.timestamp_ms = s.ts WHERE tps IS NOT NULL GROUP BY epoch)
  SELECT epoch, max(peak_tps) OVER (ORDER BY epoch RANGE BETWEEN 6 PRECEDING AND CURRENT ROW) AS peak_tps_7d FROM e""")
def _(t):
    return m.epoch_peak_tps(t.fx_checkpoint, days=7).select("epoch", F.col("peak_tps_30d").alias("peak_tps_7d"))


CALLS = ["move_package", "move_module", "move_function"]


@query("a6_top_calls", """WITH d(day) AS (VALUES (3), (7), (30)), c AS (SELECT day, move_package, move_module, move_function, count(*) AS count FROM fx_move_call, d
  WHERE epoch >= (SELECT max(epoch) FROM fx_move_call) - day GROUP BY ALL)
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY day ORDER BY count DESC, move_package, move_module, move_function) AS rank FROM c) WHERE rank <= 10""")
def _(t):
    return m.top_calls(t.fx_move_call, CALLS)


@query("a7_top_calls_by_time", """WITH d(day) AS (VALUES (3), (7), (30)), b AS (SELECT day, min(epoch) AS lo FROM fx_epoch, d
  WHERE epoch_start_timestamp > 1706572800000 - day * CAST(86400000 AS BIGINT) GROUP BY day),
  c AS (SELECT day, move_package, move_module, move_function, count(*) AS count FROM fx_move_call JOIN b ON epoch >= lo GROUP BY ALL)
  SELECT day, move_package, move_module, move_function, count FROM (SELECT *, row_number() OVER
  (PARTITION BY day ORDER BY count DESC, move_package, move_module, move_function) AS rank FROM c) WHERE rank <= 10""")
def _(t):
    return m.top_calls_since(t.fx_move_call, t.fx_epoch, CALLS, now_ms=1_706_572_800_000)


SEEN = """SELECT address, arg_min(tx, (t, tx)) AS first_appearance_tx, min(t) AS first_appearance_time,
  arg_max(tx, (t, -tx)) AS last_appearance_tx, max(t) AS last_appearance_time FROM ({}) GROUP BY address"""
ALL_SIDES = "SELECT sender AS address, tx_time_ms AS t, tx_sequence_number AS tx FROM fx_tx UNION ALL SELECT r.recipient, x.tx_time_ms, x.tx_sequence_number FROM fx_tx_recipient r JOIN fx_tx x USING (tx_sequence_number)"
SENDERS = "SELECT sender AS address, tx_time_ms AS t, tx_sequence_number AS tx FROM fx_tx"


def both_sides(t):
    tx = t.fx_tx.select("tx_sequence_number", "sender", "tx_time_ms")
    received = t.fx_tx_recipient.join(tx, "tx_sequence_number").select(F.col("recipient").alias("address"), "tx_time_ms", "tx_sequence_number")
    return tx.select(F.col("sender").alias("address"), "tx_time_ms", "tx_sequence_number").unionByName(received)


@query("a8_addresses_first_last_seen", SEEN.format(ALL_SIDES))
def _(t):
    return m.first_last_seen(both_sides(t), "address", "tx_time_ms", "tx_sequence_number")


@query("a9_active_addresses", SEEN.format(SENDERS))
def _(t):
    return m.first_last_seen(t.fx_tx, "sender", "tx_time_ms", "tx_sequence_number")


@query("a10_addresses_upsert", SEEN.format(SENDERS))
def _(t):
    seen = lambda rows: m.first_last_seen(rows, "sender", "tx_time_ms", "tx_sequence_number")
    return m.merge_seen(seen(t.fx_tx.where("checkpoint_sequence_number < 360")), seen(t.fx_tx.where("checkpoint_sequence_number >= 360")))


ADDRESS_METRICS = f"""a AS ({SEEN.format(ALL_SIDES)}), s AS ({SEEN.format(SENDERS)}),
  am AS (SELECT sequence_number AS checkpoint, epoch, timestamp_ms AS ts,
  (SELECT count(*) FROM a WHERE first_appearance_time <= timestamp_ms) AS cumulative_addresses,
  (SELECT count(*) FROM s WHERE first_appearance_time <= timestamp_ms) AS cumulative_active_addresses,
  (SELECT count(*) FROM s WHERE last_appearance_time <= timestamp_ms AND last_appearance_time >= timestamp_ms - 86400000) AS daily_active_addresses FROM fx_checkpoint)"""


def address_table(t):
    return m.address_metrics(t.fx_checkpoint, m.first_last_seen(both_sides(t), "address", "tx_time_ms", "tx_sequence_number"), m.first_last_seen(t.fx_tx, "sender", "tx_time_ms", "tx_sequence_number"))


@query("a11_address_metrics", f"WITH {ADDRESS_METRICS} SELECT * FROM am")
def _(t):
    return address_table(t)


@query("a12_epoch_address_metrics", f"WITH {ADDRESS_METRICS} SELECT * FROM am QUALIFY row_number() OVER (PARTITION BY epoch ORDER BY checkpoint DESC) = 1")
def _(t):
    return m.last_of_epoch(address_table(t))


@query("a13_network_metrics", f"""WITH few AS (SELECT * FROM fx_checkpoint ORDER BY timestamp_ms DESC, sequence_number DESC LIMIT 100), n AS ({TPS.format("few")}),
  s AS ({TPS.format("fx_checkpoint")}) SELECT (SELECT arg_max(tps, seq) FROM n WHERE tps IS NOT NULL) AS current_tps, (SELECT max(tps) FROM s) AS tps_30_days,
  (SELECT count(DISTINCT sender) FROM fx_tx) AS total_addresses, (SELECT count(DISTINCT object_id) FROM fx_object_history) AS total_objects,
  (SELECT count(DISTINCT move_package) FROM fx_move_call) AS total_packages, (SELECT max(epoch) FROM fx_checkpoint) AS current_epoch,
  (SELECT max(sequence_number) FROM fx_checkpoint) AS current_checkpoint""")
def _(t):
    return m.network_metrics(t.fx_checkpoint, t.fx_tx.select("sender").distinct(), t.fx_object_history.select("object_id").distinct(), t.fx_move_call.select("move_package").distinct())


FUNDS = "SELECT epoch, first_checkpoint_id, CASE WHEN epoch < 29 THEN last_checkpoint_id END AS last_checkpoint_id, epoch_total_transactions * 10 AS storage_charge, CASE WHEN epoch % 7 > 0 THEN epoch_total_transactions * 3 END AS storage_rebate FROM fx_epoch"


@query("a16_epoch_totals", f"""SELECT epoch, storage_charge - storage_rebate AS net_inflow, coalesce(last_checkpoint_id, 719) - first_checkpoint_id AS total_checkpoints FROM ({FUNDS})""")
def _(t):
    funds = t.fx_epoch.select(
        "epoch", "first_checkpoint_id", F.when(F.col("epoch") < 29, F.col("last_checkpoint_id")).alias("last_checkpoint_id"),
        (F.col("epoch_total_transactions") * 10).alias("storage_charge"), F.when(F.col("epoch") % 7 > 0, F.col("epoch_total_transactions") * 3).alias("storage_rebate"),
    )
    return m.epoch_totals(funds, latest_checkpoint=719)


@query("a37_min_watermark", "SELECT min(w) AS min_watermark FROM (SELECT event_type, max(event_id) AS w FROM events GROUP BY 1)")
def _(t):
    return m.min_watermark(t.events.groupBy("event_type").agg(F.max("event_id").alias("watermark")))


@query("a38_network_total_by_epoch", """SELECT epoch, arg_max(total, sequence_number) AS network_total_transactions FROM (SELECT epoch, sequence_number,
  CAST(sum(total_transaction_blocks) OVER (ORDER BY sequence_number) AS BIGINT) AS total FROM fx_checkpoint) GROUP BY epoch""")
def _(t):
    totals = m.rolling_totals(t.fx_checkpoint, "sequence_number", {"network_total_transactions": "total_transaction_blocks"}, F.col("epoch"))
    return m.last_of_epoch(totals.select("epoch", "sequence_number", "network_total_transactions"), order="sequence_number").drop("sequence_number")


@query("a39_available_range", """WITH v AS (SELECT max(checkpoint_sequence_number) AS v FROM fx_object_history WHERE checkpoint_sequence_number <= 1800
  UNION SELECT max(checkpoint_sequence_number) FROM fx_object_history) SELECT CASE WHEN count(*) = 2 THEN min(v) ELSE 0 END AS lhs, coalesce(max(v), 0) AS rhs FROM v""")
def _(t):
    h = t.fx_object_history
    return m.available_range(h.where("checkpoint_sequence_number <= 1800"), h, cp="checkpoint_sequence_number")


@query("a40_table_summary", """SELECT count(*) AS num_keys, CAST(sum(k) AS BIGINT) AS key_bytes, CAST(sum(v) AS BIGINT) AS value_bytes, quantile_cont(k, 0.5) AS key_size_p50,
  max(k) AS key_size_max, quantile_cont(v, 0.5) AS value_size_p50, max(v) AS value_size_max
  FROM (SELECT strlen(CAST(doc_id AS VARCHAR)) AS k, strlen(text) AS v FROM documents)""")
def _(t):
    return m.table_summary(t.documents, "doc_id", "text")


GAS = "SELECT epoch, CAST(command_count * gas_price AS DECIMAL(38,0)) AS computation_cost, CAST(gas_price * 3 AS DECIMAL(38,0)) AS storage_cost, CAST(gas_price * 2 AS DECIMAL(38,0)) AS storage_rebate, CAST(gas_price % 10 AS DECIMAL(38,0)) AS non_refundable_storage_fee FROM fx_tx"


@query("a41_gas_summary", f"""SELECT epoch, sum(computation_cost) AS computation_cost, sum(storage_cost) AS storage_cost, sum(storage_rebate) AS storage_rebate,
  sum(non_refundable_storage_fee) AS non_refundable_storage_fee, sum(storage_cost) + sum(computation_cost) - sum(storage_rebate) AS net_gas FROM ({GAS}) GROUP BY epoch""")
def _(t):
    d = lambda c: c.cast("decimal(20,0)")
    tx = t.fx_tx.select(
        "epoch", d(F.col("command_count") * F.col("gas_price")).alias("computation_cost"), d(F.col("gas_price") * 3).alias("storage_cost"),
        d(F.col("gas_price") * 2).alias("storage_rebate"), d(F.col("gas_price") % 10).alias("non_refundable_storage_fee"),
    )
    return m.gas_summary(tx, "epoch")


@query("w6_gap_check", """SELECT seq, prev FROM (SELECT o_orderkey AS seq, lag(o_orderkey) OVER (ORDER BY o_orderkey) AS prev FROM orders WHERE o_orderkey % 97 <> 5) WHERE seq - prev <> 1""")
def _(t):
    rows = t.orders.where("o_orderkey % 97 <> 5").select(F.col("o_orderkey").alias("seq"))
    return previous(rows, "seq", "seq", "prev", F.floor(F.col("seq") / 1000)).where("seq - prev <> 1")


@query("w7_chain_check", """WITH c AS (SELECT sequence_number, md5(CAST(sequence_number AS VARCHAR)) AS digest,
  CASE WHEN sequence_number % 100 = 7 THEN 'broken' ELSE md5(CAST(sequence_number - 1 AS VARCHAR)) END AS previous_digest FROM fx_checkpoint)
  SELECT sequence_number, previous_digest, expected FROM (SELECT *, lag(digest) OVER (ORDER BY sequence_number) AS expected FROM c)
  WHERE expected IS NOT NULL AND expected <> previous_digest""")
def _(t):
    digest = lambda c: F.md5(c.cast("string").cast("binary"))
    n = F.col("sequence_number")
    chain = t.fx_checkpoint.select("sequence_number", "epoch", digest(n).alias("digest"), F.when(n % 100 == 7, "broken").otherwise(digest(n - 1)).alias("previous_digest"))
    found = previous(chain, "sequence_number", "digest", "expected", F.col("epoch"))
    return found.where("expected is not null and expected <> previous_digest").select("sequence_number", "previous_digest", "expected")


@query("j6_tx_epoch", """SELECT t.tx_sequence_number, e.epoch AS epoch_id FROM fx_tx t JOIN fx_epoch e
  ON t.checkpoint_sequence_number BETWEEN e.first_checkpoint_id AND e.last_checkpoint_id""")
def _(t):
    found = range_lookup(t.fx_tx, t.fx_epoch.withColumnRenamed("epoch", "epoch_id"), "checkpoint_sequence_number", "first_checkpoint_id", "last_checkpoint_id", 24)
    return found.select("tx_sequence_number", "epoch_id")


@query("d3_epoch_refresh", f"""WITH s AS ({TPS.format("fx_checkpoint")}), e AS (SELECT epoch, max(tps) AS peak FROM s JOIN (SELECT timestamp_ms, max(epoch) AS epoch FROM fx_checkpoint GROUP BY 1) c
  ON c.timestamp_ms = s.ts WHERE tps IS NOT NULL GROUP BY epoch), d(day) AS (VALUES (3), (7), (30)), b AS (SELECT day, min(epoch) AS lo FROM fx_epoch, d
  WHERE epoch_start_timestamp > 1706572800000 - day * CAST(86400000 AS BIGINT) GROUP BY day), k AS (SELECT day, move_package, move_module, move_function, count(*) AS n FROM fx_move_call JOIN b ON epoch >= lo GROUP BY ALL)
  SELECT 'epoch_peak_tps' AS view, CAST(epoch AS BIGINT) AS key, peak AS value FROM e UNION ALL
  SELECT 'top_calls', CAST(day AS BIGINT), CAST(sum(n) AS DOUBLE) FROM (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY day ORDER BY n DESC, move_package, move_module, move_function) <= 10) GROUP BY day""")
def _(t):
    made = m.epoch_refresh(t.fx_checkpoint, t.fx_move_call, t.fx_epoch, CALLS, 1_706_572_800_000)
    peaks = made["epoch_peak_tps"].select(F.lit("epoch_peak_tps").alias("view"), F.col("epoch").cast("long").alias("key"), F.col("peak_tps").alias("value"))
    calls = made["top_calls"].groupBy("day").agg(F.sum("count").cast("double").alias("value"))
    return peaks.unionByName(calls.select(F.lit("top_calls").alias("view"), F.col("day").cast("long").alias("key"), "value"))
