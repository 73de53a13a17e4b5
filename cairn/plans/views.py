"""Ledger-shaped views over the driver's tables, in one text for both engines.

MS(c) is a timestamp's epoch milliseconds, K(props) the integer "k" of a JSON text, IDIV(a, n) integer division.
"""

from __future__ import annotations

import re

VIEWS = {
    "fx_tx": """SELECT event_id AS tx_sequence_number, IDIV(MS(ts) - 1704067200000, 3600000) AS checkpoint_sequence_number,
  IDIV(MS(ts) - 1704067200000, 86400000) AS epoch, MS(ts) AS tx_time_ms, user_id AS sender, event_type AS transaction_kind,
  (event_type <> 'error') AS execution_success, 1 + K(props) % 4 AS command_count, 1000 + K(props) AS gas_price FROM events""",
    "fx_checkpoint": """SELECT checkpoint_sequence_number AS sequence_number, max(epoch) AS epoch, max(tx_time_ms) AS timestamp_ms,
  count(*) AS total_transaction_blocks, CAST(sum(command_count) AS BIGINT) AS total_transactions,
  CAST(sum(CASE WHEN execution_success THEN 1 ELSE 0 END) AS BIGINT) AS total_successful_transaction_blocks,
  CAST(sum(CASE WHEN execution_success THEN command_count ELSE 0 END) AS BIGINT) AS total_successful_transactions
  FROM fx_tx GROUP BY checkpoint_sequence_number""",
    "fx_epoch": """SELECT epoch, min(sequence_number) AS first_checkpoint_id, max(sequence_number) AS last_checkpoint_id,
  min(timestamp_ms) AS epoch_start_timestamp, max(timestamp_ms) AS epoch_end_timestamp,
  CAST(sum(total_transaction_blocks) AS BIGINT) AS epoch_total_transactions FROM fx_checkpoint GROUP BY epoch""",
    "fx_tx_recipient": "SELECT event_id AS tx_sequence_number, (user_id * 7 + K(props)) % 150 AS recipient FROM events",
    "fx_move_call": """SELECT event_id AS transaction_sequence_number, IDIV(MS(ts) - 1704067200000, 86400000) AS epoch,
  event_type AS move_package, concat('m', CAST(K(props) % 7 AS VARCHAR(9))) AS move_module,
  concat('f', CAST(K(props) % 11 AS VARCHAR(9))) AS move_function FROM events""",
    "fx_event": """SELECT event_id AS tx_sequence_number, CAST(0 AS BIGINT) AS event_sequence_number, user_id AS sender,
  concat('0x', CAST(user_id % 5 AS VARCHAR(9))) AS package, concat('m', CAST(K(props) % 7 AS VARCHAR(9))) AS module,
  concat('0x', CAST(user_id % 5 AS VARCHAR(9)), '::m', CAST(K(props) % 3 AS VARCHAR(9)), '::', event_type) AS event_type,
  MS(ts) AS timestamp_ms, props AS parsed_json FROM events""",
    "fx_object_history": """SELECT object_id, object_version, object_status, checkpoint_sequence_number,
  CASE WHEN object_status = 0 THEN owner_type END AS owner_type, CASE WHEN object_status = 0 THEN owner_id END AS owner_id,
  CASE WHEN object_status = 0 THEN concat('0x2::coin::Coin<', coin_type, '>') END AS object_type,
  CASE WHEN object_status = 0 THEN coin_type END AS coin_type, CASE WHEN object_status = 0 THEN coin_balance END AS coin_balance
  FROM (SELECT l_partkey AS object_id,
  CAST(row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_suppkey, l_extendedprice) AS BIGINT) AS object_version,
  CASE WHEN l_linestatus = 'O' OR l_linenumber > 2 THEN 0 ELSE 1 END AS object_status,
  IDIV(MS(l_shipdate) - 788918400000, 86400000) AS checkpoint_sequence_number, CASE WHEN l_linenumber = 7 THEN 2 ELSE 1 END AS owner_type,
  l_suppkey AS owner_id, l_returnflag AS coin_type, CAST(l_quantity AS BIGINT) AS coin_balance FROM lineitem) h""",
    "fx_rate": """SELECT p.pool_id, e.epoch, CAST(1000000 AS DOUBLE) / CAST(1000000 + 300 * e.epoch + 37 * (p.pool_id % 10) * e.epoch AS DOUBLE) AS rate
  FROM (SELECT DISTINCT user_id AS pool_id FROM events) p CROSS JOIN (SELECT DISTINCT epoch FROM fx_epoch) e""",
    "fx_stake": """SELECT o_orderkey AS stake_id, o_custkey AS owner, o_orderkey % 97 AS pool_id, o_orderkey % 40 AS activation_epoch,
  CAST(floor(o_totalprice * 100) AS BIGINT) AS principal FROM orders""",
    "fx_committee": "SELECT s_suppkey AS authority, CAST(floor(abs(s_acctbal)) AS BIGINT) + 1 AS stake FROM supplier",
    "fx_vote": "SELECT DISTINCT l_partkey % 50 AS item, l_suppkey AS authority, l_returnflag AS vote FROM lineitem",
    "fx_sample": "SELECT event_type AS label, MS(ts) AS ts_ms, CAST(round(value * 100) AS BIGINT) AS point FROM events",
    "fx_run": """SELECT o_orderpriority AS setup, o_custkey % 5 AS nodes, o_orderkey % 6 AS rate, CAST(floor(o_totalprice) AS BIGINT) AS tps,
  o_custkey AS latency_ms FROM orders""",
    "fx_dep": """SELECT a.tx_sequence_number AS tx, b.tx_sequence_number AS depends_on FROM fx_tx a JOIN fx_tx b
  ON b.tx_sequence_number = a.tx_sequence_number - 1 - a.gas_price % 3 AND a.checkpoint_sequence_number = b.checkpoint_sequence_number""",
}
BASE = "region nation customer supplier part orders lineitem events".split()


def _expanded(sql: str, ms: str, k: str, idiv: str) -> str:
    sql = re.sub(r"\bK\((\w+)\)", k, sql)
    sql = re.sub(r"\bMS\((\w+)\)", ms, sql)
    return re.sub(r"\bIDIV\((.*?), (\d+)\)", idiv, sql)


def duckdb(name: str) -> str:
    return _expanded(VIEWS[name], r"CAST(epoch_us(\1) // 1000 AS BIGINT)", r"CAST(json_extract_string(\1, '$.k') AS BIGINT)", r"CAST((\1) // \2 AS BIGINT)")


def spark_sql(name: str) -> str:
    return _expanded(VIEWS[name], r"CAST(unix_micros(CAST(\1 AS TIMESTAMP)) div 1000 AS BIGINT)", r"CAST(get_json_object(\1, '$.k') AS BIGINT)", r"CAST((\1) div \2 AS BIGINT)")


def needs(name: str) -> list[str]:
    return re.findall(r"\b(?:fx_\w+|" + "|".join(BASE) + r")\b(?=\s|\)|$)", re.sub(r"'[^']*'", "", VIEWS[name]))


def closure(names: set[str]) -> list[str]:
    """The views that names need, themselves included, in an order of definition."""
    out: list[str] = []

    def visit(name: str) -> None:
        if name in VIEWS and name not in out:
            for other in needs(name):
                visit(other)
            out.append(name)

    for name in sorted(names):
        visit(name)
    return out


def build(tables, name: str):
    """A view as a DataFrame."""
    used = {n: getattr(tables, n) for n in set(needs(name))}
    text = spark_sql(name)
    for n in used:
        text = re.sub(rf"\b{n}\b(?=\s|\)|$)", "{" + n + "}", text)
    return tables.spark.sql(text, **used)
