"""Queries of consistent reads, balances and changes."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from cairn.operators import history as h
from cairn.operators import joins as j
from cairn.operators.metrics import available_range
from cairn.plans.registry import query
from cairn.sources.shared import materialize, shared_dir
from cairn.sources.state_table import StateTable

COLUMNS = "object_id, object_version, object_status, checkpoint_sequence_number, owner_type, owner_id, object_type, coin_type, coin_balance"
LATEST = "QUALIFY row_number() OVER (PARTITION BY object_id ORDER BY object_version DESC) = 1"
LHS, RHS = 1200, 2000
SNAPSHOT = f"s AS (SELECT * FROM fx_object_history WHERE checkpoint_sequence_number < {LHS + 1} {LATEST})"


def snapshot(t):
    return h.latest_version(t.fx_object_history.where(f"checkpoint_sequence_number <= {LHS}"))


def at_sql(condition: str, consistent: bool = True, tail: str = "SELECT * FROM found", drop: str = "") -> str:
    """Brute force for C1: newest match, then no newer row in the later history."""
    keep = f"""WHERE NOT EXISTS (SELECT 1 FROM fx_object_history n WHERE n.object_id = m.object_id AND n.object_version > m.object_version
  AND n.checkpoint_sequence_number > {LHS} AND n.checkpoint_sequence_number <= {RHS} {drop})""" if consistent else ""  # fmt: skip
    return f"""WITH {SNAPSHOT}, m AS (SELECT * FROM (SELECT * FROM s WHERE {condition} UNION SELECT * FROM fx_object_history
  WHERE checkpoint_sequence_number > {LHS} AND checkpoint_sequence_number <= {RHS} AND ({condition})) {LATEST}), found AS (SELECT {COLUMNS} FROM m {keep}) {tail}"""


@query("w3_latest_version", f"SELECT {COLUMNS} FROM fx_object_history {LATEST}")
def _(t):
    return h.latest_version(t.fx_object_history)


@query("w4_lowest_version", f"SELECT {COLUMNS} FROM fx_object_history QUALIFY row_number() OVER (PARTITION BY object_id ORDER BY object_version, checkpoint_sequence_number DESC) = 1")
def _(t):
    return h.lowest_version(t.fx_object_history)


@query("w10_old_owner", "SELECT object_id, object_version, owner_id, lag(owner_id) OVER (PARTITION BY object_id ORDER BY object_version) AS old_owner_id FROM fx_object_history")
def _(t):
    return h.old_owner(t.fx_object_history, ["owner_id"]).select("object_id", "object_version", "owner_id", "old_owner_id")


@query("j1_drop_superseded", """SELECT c.object_id, c.object_version FROM fx_object_history c WHERE c.checkpoint_sequence_number <= 1500 AND NOT EXISTS (SELECT 1 FROM fx_object_history n
  WHERE n.object_id = c.object_id AND n.object_version > c.object_version AND n.checkpoint_sequence_number <= 2000)""")
def _(t):
    x = t.fx_object_history.select("object_id", "object_version", "checkpoint_sequence_number")
    return h.drop_superseded(x.where("checkpoint_sequence_number <= 1500"), x.where("checkpoint_sequence_number <= 2000")).drop("checkpoint_sequence_number")


@query("j2_drop_deleted_children", """SELECT c.object_id, c.object_version FROM fx_object_history c WHERE c.object_status = 0 AND c.object_version <= 12 AND NOT EXISTS
  (SELECT 1 FROM fx_object_history n WHERE n.object_id = c.object_id AND n.object_version > c.object_version AND n.object_status = 1 AND n.object_version <= 12)""")
def _(t):
    x = t.fx_object_history.select("object_id", "object_version", "object_status")
    return h.drop_deleted_children(x.where("object_status = 0 and object_version <= 12"), x, 12).drop("object_status")


@query("c1_objects_at_consistent", at_sql("object_status = 0"))
def _(t):
    return h.objects_at(snapshot(t), t.fx_object_history, h.live(), LHS, RHS)


@query("c1_objects_at_historical", at_sql("object_status = 0", False))
def _(t):
    return h.objects_at(snapshot(t), t.fx_object_history, h.live(), LHS, RHS, consistent=False)


@query("c2_consistent_range", """SELECT min(v) AS lhs, CAST(1500 AS BIGINT) AS rhs FROM (SELECT max(checkpoint_sequence_number) AS v FROM fx_object_history WHERE checkpoint_sequence_number <= 1200
  UNION ALL SELECT max(checkpoint_sequence_number) FROM fx_object_history) HAVING 1500 BETWEEN min(v) AND max(v)""")
def _(t):
    cps = t.fx_object_history.select("checkpoint_sequence_number")
    available = available_range(cps.where(F.col("checkpoint_sequence_number") <= LHS), cps, cp="checkpoint_sequence_number")
    found = h.consistent_range(tuple(available.first()), 1500)
    return available.where(F.lit(found is not None)).select(*[F.lit(v).cast("long").alias(n) for n, v in zip(("lhs", "rhs"), found or (None, None), strict=True)])


COIN = "object_status = 0 AND coin_type = 'A' AND owner_id = 7"


@query("c3_coins_at", at_sql(COIN, tail="SELECT object_id, object_version, coin_balance FROM found"))
def _(t):
    found = h.objects_at(snapshot(t), t.fx_object_history, h.live() & (F.col("coin_type") == "A") & (F.col("owner_id") == 7), LHS, RHS)
    return found.select("object_id", "object_version", "coin_balance")


BALANCE = "CAST(sum(coin_balance) AS DECIMAL(38,0)) AS balance, count(*) AS coins"


AT_BALANCES = at_sql("object_status = 0", tail=f"SELECT owner_id, coin_type, {BALANCE} FROM found WHERE coin_type IS NOT NULL GROUP BY ALL")


@query("a4_balances_at", AT_BALANCES)
def _(t):
    return h.balances(h.objects_at(snapshot(t), t.fx_object_history, h.live(), LHS, RHS), ["owner_id"])


@query("a3_balances", f"SELECT owner_id, coin_type, {BALANCE} FROM (SELECT * FROM fx_object_history {LATEST}) WHERE object_status = 0 AND owner_type = 1 GROUP BY ALL")
def _(t):
    return h.balances(h.latest_version(t.fx_object_history).where("object_status = 0 and owner_type = 1"), ["owner_id"])


@query("a5_balance_or_zero", f"""WITH b AS (SELECT owner_id, coin_type, {BALANCE} FROM (SELECT * FROM fx_object_history {LATEST}) WHERE object_status = 0 AND owner_type = 1 GROUP BY ALL)
  SELECT s_suppkey AS owner_id, 'A' AS coin_type, coalesce(balance, 0) AS balance, coalesce(coins, 0) AS coins FROM supplier LEFT JOIN b ON owner_id = s_suppkey AND coin_type = 'A'""")
def _(t):
    found = h.balances(h.latest_version(t.fx_object_history).where("object_status = 0 and owner_type = 1"), ["owner_id"])
    keys = t.supplier.select(F.col("s_suppkey").alias("owner_id"), F.lit("A").alias("coin_type"))
    return h.balance_or_zero(keys, found, ["owner_id", "coin_type"])


AT_FIELDS = at_sql("object_status = 0 AND owner_type = 2", tail="SELECT owner_id AS parent, object_id, object_version FROM found")


@query("c4_dynamic_fields_at", AT_FIELDS)
def _(t):
    found = h.objects_at(snapshot(t), t.fx_object_history, h.live() & (F.col("owner_type") == 2), LHS, RHS)
    return found.select(F.col("owner_id").alias("parent"), "object_id", "object_version")


@query("c5_fold_snapshot", f"""WITH {SNAPSHOT} SELECT {COLUMNS} FROM (SELECT * FROM s UNION ALL SELECT * FROM fx_object_history
  WHERE checkpoint_sequence_number >= {LHS + 1} AND checkpoint_sequence_number < {LHS + 601}) {LATEST}""")
def _(t):
    return h.fold_snapshot(snapshot(t), t.fx_object_history, LHS + 1, h.snapshot_due(LHS + 902, LHS + 1))


@query("c5_incremental_fold", f"""WITH f AS (SELECT *, CASE WHEN checkpoint_sequence_number <= {LHS} THEN 0 ELSE 1 + (checkpoint_sequence_number - {LHS + 1}) // 200 END AS batch, object_id // 25 AS bucket
  FROM fx_object_history WHERE checkpoint_sequence_number < {LHS + 601}), v AS (SELECT bucket, max(batch) AS version FROM f GROUP BY 1)
  SELECT object_id, object_version, object_status, owner_id, version FROM (SELECT * FROM f {LATEST}) JOIN v USING (bucket)""")
def _(t):
    """A stored snapshot and three folds of 200 checkpoints into it, with the batch that wrote each object's bucket last."""
    # Each fold scans the history, which is numbered once.
    history = materialize(t.fx_object_history.select("object_id", "object_version", "object_status", "owner_id", "checkpoint_sequence_number"), "c5-history")
    bucket = F.floor(F.col("object_id") / 25)
    table = StateTable(t.spark, f"{shared_dir(t.spark)}/cairn-c5-{uuid.uuid4().hex[:12]}", history.schema, bucket)
    h.fold_into(table, 0, history, 0, LHS + 1)
    for i in range(3):
        h.fold_into(table, i + 1, history, LHS + 1 + 200 * i, LHS + 201 + 200 * i)
    versions = table.history().where("batch = 3").select(F.col("bucket").alias("__b"), "version")
    return table.read().withColumn("__b", bucket).join(versions, "__b").select("object_id", "object_version", "object_status", "owner_id", "version")


@query("c6_past_objects", """WITH r AS (SELECT p_partkey AS object_id, p_partkey % 40 AS object_version FROM part) SELECT r.object_id, r.object_version,
  CASE WHEN object_status IS NULL THEN 'not_exists' WHEN object_status = 1 THEN 'deleted' ELSE 'exists' END AS outcome
  FROM r LEFT JOIN fx_object_history o ON o.object_id = r.object_id AND o.object_version = r.object_version""")
def _(t):
    asked = t.part.select(F.col("p_partkey").alias("object_id"), (F.col("p_partkey") % 40).alias("object_version"))
    return h.past_objects(asked, t.fx_object_history).select("object_id", "object_version", "outcome")


@query("c7_owned_objects", f"SELECT owner_id, object_id, object_version, object_type FROM (SELECT * FROM fx_object_history {LATEST}) WHERE object_status = 0 AND owner_type = 1 AND object_type LIKE '0x2::coin::%'")
def _(t):
    found = h.latest_version(t.fx_object_history).where(h.live() & (F.col("owner_type") == 1) & F.col("object_type").startswith("0x2::coin::"))
    return found.select("owner_id", "object_id", "object_version", "object_type")


@query("c8_coins_by_owner", f"""SELECT owner_id, object_id, coin_balance FROM (SELECT * FROM (SELECT * FROM fx_object_history {LATEST}) WHERE object_status = 0 AND coin_type = 'N'
  AND object_id > 0 QUALIFY row_number() OVER (PARTITION BY owner_id ORDER BY object_id) <= 50)""")
def _(t):
    from pyspark.sql import Window

    coins = h.latest_version(t.fx_object_history).where(h.live() & (F.col("coin_type") == "N") & (F.col("object_id") > 0))
    page = coins.withColumn("r", F.row_number().over(Window.partitionBy("owner_id").orderBy("object_id"))).where("r <= 50")
    return page.select("owner_id", "object_id", "coin_balance")


@query("c9_staked_at", at_sql("object_status = 0 AND object_type = '0x2::coin::Coin<R>' AND owner_type = 1", tail="SELECT owner_id, object_id, coin_balance AS principal FROM found"))
def _(t):
    staked = h.live() & (F.col("object_type") == "0x2::coin::Coin<R>") & (F.col("owner_type") == 1)
    return h.objects_at(snapshot(t), t.fx_object_history, staked, LHS, RHS).select("owner_id", "object_id", F.col("coin_balance").alias("principal"))


@query("u1_snapshot_union_history", f"WITH {SNAPSHOT} SELECT {COLUMNS} FROM s WHERE owner_id = 5 UNION SELECT {COLUMNS} FROM fx_object_history WHERE owner_id = 5 AND checkpoint_sequence_number > 1000")
def _(t):
    mine = F.col("owner_id") == 5
    return snapshot(t).where(mine).unionByName(t.fx_object_history.where(mine & (F.col("checkpoint_sequence_number") > 1000))).distinct()


@query("s19_change_log", """SELECT object_id, object_version, owner_id, old_owner_id, operation FROM (SELECT *, lag(owner_id) OVER w AS old_owner_id,
  CASE WHEN row_number() OVER w = 1 THEN 'INSERT' ELSE 'UPDATE' END AS operation FROM fx_object_history
  WHERE object_id NOT IN (SELECT object_id FROM fx_object_history WHERE object_status = 1 AND object_version = 3) WINDOW w AS (PARTITION BY object_id ORDER BY object_version))""")
def _(t):
    gone = t.fx_object_history.where("object_status = 1 and object_version = 3").select("object_id")
    return h.change_log(t.fx_object_history, gone, ["owner_id"]).select("object_id", "object_version", "owner_id", "old_owner_id", "operation")


CHANGES = """c AS (SELECT l_orderkey AS tx, l_partkey AS object_id, CAST(l_linenumber AS BIGINT) AS version, CASE l_linenumber WHEN 1 THEN 'create' WHEN 2 THEN 'mutate'
  WHEN 3 THEN 'delete' WHEN 4 THEN 'wrap' ELSE 'unwrap' END AS kind, l_partkey % 11 = 0 AS is_package FROM lineitem),
  p AS (SELECT DISTINCT l_orderkey AS tx, l_partkey AS object_id, CAST(l_partkey % 9 AS BIGINT) AS previous_version FROM lineitem)"""


@query("p18_object_changes", f"""WITH {CHANGES} SELECT * FROM (SELECT tx, object_id, version, CASE WHEN is_package THEN CASE WHEN kind = 'create' THEN 'published' END WHEN kind = 'create' THEN 'created'
  WHEN kind = 'mutate' THEN 'mutated' WHEN kind = 'delete' THEN 'deleted' WHEN kind = 'wrap' THEN 'wrapped' END AS change,
  CASE WHEN kind = 'mutate' AND NOT is_package THEN previous_version END AS previous_version FROM c JOIN p USING (tx, object_id)) WHERE change IS NOT NULL""")
def _(t):
    li, n = t.lineitem, F.col("l_linenumber")
    kind = F.when(n == 1, "create").when(n == 2, "mutate").when(n == 3, "delete").when(n == 4, "wrap").otherwise("unwrap")
    changes = li.select(F.col("l_orderkey").alias("tx"), F.col("l_partkey").alias("object_id"), n.cast("long").alias("version"), kind.alias("kind"), (F.col("l_partkey") % 11 == 0).alias("is_package"))
    previous = li.select(F.col("l_orderkey").alias("tx"), F.col("l_partkey").alias("object_id"), (F.col("l_partkey") % 9).cast("long").alias("previous_version")).distinct()
    return h.object_changes(changes, previous)


@query("a15_balance_changes", """WITH x AS (SELECT o_orderkey AS tx, o_orderstatus <> 'P' AS success, o_custkey AS gas_owner, o_orderkey % 1000 AS net_gas FROM orders),
  s AS (SELECT l_orderkey AS tx, l_suppkey AS owner, l_returnflag AS coin_type, CASE WHEN l_linenumber % 2 = 1 THEN -1 ELSE 1 END * CAST(l_quantity AS BIGINT) AS amount
  FROM lineitem WHERE NOT (l_linenumber % 2 = 1 AND l_linenumber = 5))
  SELECT tx, owner, coin_type, CAST(sum(amount) AS DECIMAL(38,0)) AS amount FROM s WHERE tx IN (SELECT tx FROM x WHERE success) GROUP BY ALL HAVING sum(amount) <> 0
  UNION ALL SELECT tx, gas_owner, 'native', CAST(-net_gas AS DECIMAL(38,0)) FROM x WHERE NOT success""")
def _(t):
    tx = t.orders.select(F.col("o_orderkey").alias("tx"), (F.col("o_orderstatus") != "P").alias("success"), F.col("o_custkey").alias("gas_owner"), (F.col("o_orderkey") % 1000).alias("net_gas"))
    cells = t.lineitem.select(
        F.col("l_orderkey").alias("tx"), F.col("l_suppkey").alias("owner"), F.col("l_returnflag").alias("coin_type"), F.col("l_quantity").cast("long").alias("balance"),
        F.col("l_linenumber").alias("n"), (F.col("l_linenumber") == 5).alias("skipped"),
    )
    return h.balance_changes(tx, cells.where("n % 2 = 1"), cells.where("n % 2 = 0"), "native")


HASHED = "CAST(('0x' || substr(sha256(concat_ws('|', CAST(object_id AS VARCHAR), CAST(object_version AS VARCHAR))), 1, 15)) AS BIGINT)"


@query("a23_set_digest", f"SELECT checkpoint_sequence_number, CAST(sum({HASHED} * CASE WHEN object_status = 0 THEN 1 ELSE -1 END) AS DECIMAL(38,0)) AS digest, count(*) AS items FROM fx_object_history GROUP BY 1")
def _(t):
    return h.set_digest(t.fx_object_history, ["object_id", "object_version"], ["checkpoint_sequence_number"], F.when(h.live(), 1).otherwise(-1))


@query("j4_exact_version", """SELECT r.object_id, r.object_version, o.owner_id FROM (SELECT p_partkey AS object_id, 1 + p_partkey % 20 AS object_version FROM part) r JOIN fx_object_history o USING (object_id, object_version)""")
def _(t):
    refs = t.part.select(F.col("p_partkey").alias("object_id"), (1 + F.col("p_partkey") % 20).alias("object_version"))
    return j.exact_version(refs, t.fx_object_history.select("object_id", "object_version", "owner_id"), "object_id", "object_version")


@query("j5_asof_version", """SELECT r.object_id, r.at, o.checkpoint_sequence_number, o.object_version FROM (SELECT DISTINCT l_partkey AS object_id, l_orderkey % 2500 AS at FROM lineitem) r
  LEFT JOIN (SELECT object_id, checkpoint_sequence_number, max(object_version) AS object_version FROM fx_object_history GROUP BY 1, 2) o ON o.object_id = r.object_id
  AND o.checkpoint_sequence_number <= r.at QUALIFY row_number() OVER (PARTITION BY r.object_id, r.at ORDER BY o.checkpoint_sequence_number DESC NULLS LAST) = 1""")
def _(t):
    asked = t.lineitem.select(F.col("l_partkey").alias("object_id"), (F.col("l_orderkey") % 2500).alias("at")).distinct()
    versions = t.fx_object_history.groupBy("object_id", "checkpoint_sequence_number").agg(F.max("object_version").alias("object_version"))
    return j.asof_version(asked, versions, "object_id", "at", "checkpoint_sequence_number")


@query("j13_children", """SELECT s.s_suppkey AS parent, h.object_id, h.object_version FROM supplier s JOIN fx_object_history h ON h.owner_id = s.s_suppkey
  WHERE h.owner_type = 2 AND h.object_version <= 5 + s.s_suppkey % 10""")
def _(t):
    parents = t.supplier.select(F.col("s_suppkey").alias("parent"), (5 + F.col("s_suppkey") % 10).alias("bound"))
    found = j.children_of(t.fx_object_history, parents, kind=F.col("owner_type") == 2, version="object_version", bound="bound")
    return found.select("parent", "object_id", "object_version")
