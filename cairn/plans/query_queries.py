"""Queries of filters, look-ups, pages and orders."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from cairn.operators import filters as f
from cairn.operators import joins as j
from cairn.operators import paging as p
from cairn.operators.series import running_sums
from cairn.plans.history_queries import LATEST
from cairn.plans.registry import query

#: Numbers of transactions, each given once, of a task that solves dependencies: its memory is bounded at any size of the table.
PER_TASK = 50_000
LIVE = f"live AS (SELECT * FROM fx_object_history {LATEST})"


def live(t):
    from cairn.operators.history import latest_version

    return latest_version(t.fx_object_history)


@query("f1_object_filter_tree", f"""WITH {LIVE} SELECT object_id, object_version FROM live WHERE (object_type LIKE '0x2::%' AND owner_id = 7)
  OR (NOT (coin_type = 'A' OR coin_type = 'N') AND owner_id < 20)""")
def _(t):
    tree = f.match_any([
        f.match_all([f.package_is("object_type", "0x2"), f.owner_is("owner_id", 7)]),
        f.match_all([f.match_none([F.col("coin_type") == "A", F.col("coin_type") == "N"]), F.col("owner_id") < 20, f.match_all([])]),
        f.match_any([]),
    ])
    return live(t).where(tree).select("object_id", "object_version")


@query("f2_object_leaf_filters", """SELECT object_id, object_version FROM (SELECT *, lag(owner_id) OVER (PARTITION BY object_id ORDER BY object_version) AS old_owner_id FROM fx_object_history)
  WHERE (owner_id = 11 OR old_owner_id = 11) AND starts_with(object_type, '0x2::coin::') AND (object_type = '0x2::coin::Coin' OR starts_with(object_type, '0x2::coin::Coin<'))
  AND object_id IN (SELECT p_partkey FROM part WHERE p_partkey % 3 = 1)""")
def _(t):
    from cairn.operators.history import old_owner

    rows = old_owner(t.fx_object_history, ["owner_id"])
    found = rows.where(f.match_all([f.owner_is("owner_id", 11, "old_owner_id"), f.module_is("object_type", "0x2", "coin"), f.struct_is("object_type", "0x2::coin::Coin")]))
    ids = t.part.where("p_partkey % 3 = 1").select(F.col("p_partkey").alias("object_id"))
    return j.keep_by(found, ids, ["object_id"]).select("object_id", "object_version")


@query("f3_outer_recheck", f"WITH c AS (SELECT * FROM fx_object_history WHERE checkpoint_sequence_number <= 2000 {LATEST}) SELECT object_id, owner_id FROM c WHERE owner_id = 11")
def _(t):
    from cairn.operators.history import latest_version

    touched = t.fx_object_history.where("checkpoint_sequence_number <= 2000")
    return latest_version(touched).where(f.owner_is("owner_id", 11)).select("object_id", "owner_id")


@query("f4_status_exclusion", """SELECT o_orderkey, status FROM (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'deleted' WHEN 'P' THEN 'wrapped' ELSE 'created' END AS status FROM orders)
  WHERE status NOT IN ('deleted', 'wrapped', 'unwrapped_then_deleted')""")
def _(t):
    status = F.when(F.col("o_orderstatus") == "F", "deleted").when(F.col("o_orderstatus") == "P", "wrapped").otherwise("created")
    return t.orders.select("o_orderkey", status.alias("status")).where(f.not_gone("status"))


@query("f5_type_filter", """SELECT tx_sequence_number, event_type FROM fx_event WHERE (starts_with(event_type, '0x3::')) OR starts_with(event_type, '0x1::m2::')
  OR event_type = '0x2::m1::click' OR starts_with(event_type, '0x2::m1::click<')""")
def _(t):
    any_of = f.match_any([f.type_filter("event_type", s) for s in ("0x3", "0x1::m2", "0x2::m1::click")])
    return t.fx_event.where(any_of).select("tx_sequence_number", "event_type")


@query("f6_owner_filter", f"WITH {LIVE} SELECT object_id, owner_type FROM live WHERE owner_id = 9 AND owner_type IN (1, 2)")
def _(t):
    return live(t).where(f.owned_by("owner_id", "owner_type", 9)).select("object_id", "owner_type")


@query("f7_event_leaf_filters", """SELECT tx_sequence_number FROM fx_event WHERE sender % 7 = 3 AND package = '0x3' AND starts_with(event_type, '0x3::m1::')
  AND timestamp_ms >= 1704500000000 AND timestamp_ms < 1706000000000""")
def _(t):
    leaf = f.match_all([F.col("sender") % 7 == 3, F.col("package") == "0x3", f.type_filter("event_type", "0x3::m1"), f.time_range("timestamp_ms", 1_704_500_000_000, 1_706_000_000_000)])
    return t.fx_event.where(leaf).select("tx_sequence_number")


@query("f8_event_json_field", "SELECT tx_sequence_number FROM fx_event WHERE json_extract_string(parsed_json, '$.k') = '42'")
def _(t):
    return t.fx_event.where(f.json_field_is("parsed_json", "/k", 42)).select("tx_sequence_number")


@query("f9_event_combinators", """SELECT tx_sequence_number FROM fx_event WHERE (module = 'm1' AND sender < 50) OR (module = 'm2' AND json_extract_string(parsed_json, '$.k') = '9')""")
def _(t):
    either = f.match_any([f.match_all([F.col("module") == "m1", F.col("sender") < 50]), f.match_all([F.col("module") == "m2", f.json_field_is("parsed_json", "/k", 9)])])
    return t.fx_event.where(either).select("tx_sequence_number")


@query("f10_events_by_tx", """SELECT e.tx_sequence_number AS tx FROM fx_event e JOIN fx_tx t USING (tx_sequence_number) WHERE t.sender = 17 AND e.module = 'm3' AND t.checkpoint_sequence_number <= 500""")
def _(t):
    tx = t.fx_tx.select(F.col("tx_sequence_number").alias("tx"), "sender", F.col("tx_sequence_number").cast("string").alias("digest"), F.col("checkpoint_sequence_number").alias("checkpoint"))
    events = t.fx_event.select(F.col("tx_sequence_number").alias("tx"), "module", "event_type")
    return f.events_page_filter(events, tx, sender=17, module="m3", viewed_at=500).select("tx")


def tx_filter(t):
    tx = t.fx_tx.select(F.col("tx_sequence_number").alias("tx"), F.col("checkpoint_sequence_number").alias("checkpoint"), "sender", F.col("transaction_kind").alias("kind"))
    calls = t.fx_move_call.select(F.col("transaction_sequence_number").alias("tx"), F.col("move_package").alias("package"), F.col("move_module").alias("module"), F.col("move_function").alias("function"))
    objects = lambda n: t.events.select(F.col("event_id").alias("tx"), (F.col("event_id") % n).alias("object_id"))
    return f.TransactionFilter(tx, t.fx_tx_recipient.withColumnRenamed("tx_sequence_number", "tx"), calls, objects(101), objects(37))


@query("f11_transaction_filters", """SELECT 'checkpoint' AS variant, tx_sequence_number AS tx FROM fx_tx WHERE checkpoint_sequence_number = 100
  UNION ALL SELECT 'function', transaction_sequence_number FROM fx_move_call WHERE move_package = 'click' AND move_module = 'm2' AND move_function = 'f3'
  UNION ALL SELECT 'input', event_id FROM events WHERE event_id % 101 = 7 UNION ALL SELECT 'changed', event_id FROM events WHERE event_id % 37 = 5
  UNION ALL SELECT 'from', tx_sequence_number FROM fx_tx WHERE sender = 3 UNION ALL SELECT 'to', tx_sequence_number FROM fx_tx_recipient WHERE recipient = 3
  UNION ALL SELECT 'from_and_to', tx_sequence_number FROM fx_tx JOIN fx_tx_recipient USING (tx_sequence_number) WHERE sender = 3 AND recipient < 200 AND recipient = 52
  UNION ALL SELECT 'from_or_to', tx_sequence_number FROM fx_tx JOIN fx_tx_recipient USING (tx_sequence_number) WHERE sender = 3 OR recipient = 3
  UNION ALL SELECT 'kind', tx_sequence_number FROM fx_tx WHERE transaction_kind IN ('error', 'view') AND sender = 4""")
def _(t):
    s = tx_filter(t)
    parts = {
        "checkpoint": s.checkpoint(100), "function": s.move_function("click", "m2", "f3"), "input": s.input_object(7), "changed": s.changed_object(5), "from": s.from_address(3),
        "to": s.to_address(3), "from_and_to": s.from_and_to(3, 52), "from_or_to": s.from_or_to(3), "kind": s.kind_in(["error", "view"]).where("sender = 4"),
    }
    return p.union_pages([rows.select(F.lit(name).alias("variant"), "tx") for name, rows in parts.items()])


@query("f12_combined_tx_filter", """SELECT t.tx_sequence_number AS tx FROM fx_tx t JOIN fx_tx_recipient r USING (tx_sequence_number) JOIN fx_move_call c ON c.transaction_sequence_number = t.tx_sequence_number
  WHERE checkpoint_sequence_number > 100 AND checkpoint_sequence_number < 600 AND move_package = 'click' AND recipient < 150 AND recipient = 21""")
def _(t):
    return tx_filter(t).combined(function="click", after=100, before=600, recipient=21).select("tx")


@query("f13_intersected_filter", "SELECT tx_sequence_number AS tx FROM fx_tx WHERE sender = 8 AND checkpoint_sequence_number > 200 AND checkpoint_sequence_number < 500")
def _(t):
    both = f.intersect({"signer": 8, "after": 100, "before": 700}, {"after": 200, "before": 500, "kind": None})
    return tx_filter(t).combined(**both).select("tx")


@query("f14_address_relation", "SELECT 'sign' AS relation, tx_sequence_number AS tx FROM fx_tx WHERE sender = 12 UNION ALL SELECT 'recv', tx_sequence_number FROM fx_tx_recipient WHERE recipient = 12")
def _(t):
    return p.union_pages([tx_filter(t).related(12, r).select(F.lit(r).alias("relation"), "tx") for r in ("sign", "recv")])


@query("f15_multi_lookup", "SELECT tx_sequence_number, sender, tx_time_ms FROM fx_tx WHERE tx_sequence_number IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 50 = 1) OR tx_sequence_number = (SELECT max(tx_sequence_number) FROM fx_tx)")
def _(t):
    rows = t.fx_tx.select("tx_sequence_number", "sender", "tx_time_ms")
    keys = t.orders.where("o_orderkey % 50 = 1").select(F.col("o_orderkey").alias("tx_sequence_number"))
    newest = rows.agg(F.max("tx_sequence_number").alias("tx_sequence_number"))
    return j.keep_by(rows, keys.union(newest).distinct(), ["tx_sequence_number"])


@query("f16_epoch_at", """SELECT epoch, first_checkpoint_id FROM fx_epoch WHERE first_checkpoint_id <= 400 QUALIFY row_number() OVER (ORDER BY first_checkpoint_id DESC) = 1
  UNION ALL SELECT epoch, first_checkpoint_id FROM fx_epoch WHERE first_checkpoint_id <= 400 AND epoch = 3""")
def _(t):
    e = t.fx_epoch
    return f.epoch_at(e, 400).unionByName(f.epoch_at(e, 400, 3)).select("epoch", "first_checkpoint_id")


@query("f17_domain_names", r"""SELECT page_id, host, list_reverse(string_split(host, '.')) AS labels FROM (SELECT page_id, regexp_extract(url, '://([^/?#]*)', 1) AS host FROM pages)
  WHERE length(host) <= 200 AND regexp_full_match(host, '[a-z0-9]([a-z0-9-]{0,61}[a-z0-9])?(\.[a-z0-9]([a-z0-9-]{0,61}[a-z0-9])?)*')""")
def _(t):
    hosts = t.pages.select("page_id", F.regexp_extract("url", "://([^/?#]*)", 1).alias("host"))
    return hosts.where(f.valid_domain("host")).withColumn("labels", f.domain_labels("host"))


@query("f18_threshold_failures", """WITH v AS (SELECT label, avg(point) AS value FROM fx_sample GROUP BY 1), r(label, condition, threshold) AS (SELECT label, 'greater', 5000 FROM v UNION ALL SELECT label, 'less', 5010 FROM v)
  SELECT label, condition FROM v JOIN r USING (label) WHERE (condition = 'greater' AND value > threshold) OR (condition = 'less' AND value < threshold)""")
def _(t):
    values = t.fx_sample.groupBy("label").agg(F.avg("point").alias("value"))
    rules = values.select("label", F.explode(F.array(F.struct(F.lit("greater").alias("condition"), F.lit(5000).alias("threshold")), F.struct(F.lit("less").alias("condition"), F.lit(5010).alias("threshold")))).alias("r"))
    return f.failures(values, rules.select("label", "r.condition", "r.threshold"), "label").select("label", "condition")


@query("j3_semi_join", "SELECT tx_sequence_number, module FROM fx_event WHERE tx_sequence_number IN (SELECT tx_sequence_number FROM fx_tx WHERE sender = 21)")
def _(t):
    return j.keep_by(t.fx_event.select("tx_sequence_number", "module"), t.fx_tx.where("sender = 21"), ["tx_sequence_number"])


@query("j8_reconcile", """WITH a AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 50 = 3 THEN NULL ELSE o_custkey END AS v FROM orders WHERE o_orderkey % 40 <> 1), b AS (SELECT o_orderkey AS k, o_custkey AS v FROM orders WHERE o_orderkey % 30 <> 2)
  SELECT coalesce(a.k, b.k) AS k, CASE WHEN b.k IS NULL THEN 'extra' WHEN a.k IS NULL THEN 'missing' ELSE 'different' END AS status FROM a FULL JOIN b ON a.k = b.k
  WHERE a.k IS NULL OR b.k IS NULL OR a.v IS DISTINCT FROM b.v""")
def _(t):
    o = t.orders.select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("v"))
    a = o.where("k % 40 <> 1").withColumn("v", F.when(F.col("k") % 50 != 3, F.col("v")))
    return j.reconcile(a, o.where("k % 30 <> 2"), ["k"], ["v"])


@query("j9_index_validation", """WITH i AS (SELECT tx_sequence_number, sender, CASE WHEN tx_sequence_number % 500 = 4 THEN 'other' ELSE module END AS module FROM fx_event WHERE tx_sequence_number % 700 <> 9)
  SELECT coalesce(e.tx_sequence_number, i.tx_sequence_number) AS tx_sequence_number, CASE WHEN i.tx_sequence_number IS NULL THEN 'extra' ELSE 'different' END AS status
  FROM fx_event e LEFT JOIN i USING (tx_sequence_number) WHERE i.tx_sequence_number IS NULL OR i.module <> e.module""")
def _(t):
    e = t.fx_event.select("tx_sequence_number", "sender", "module")
    index = e.where("tx_sequence_number % 700 <> 9").withColumn("module", F.when(F.col("tx_sequence_number") % 500 == 4, "other").otherwise(F.col("module")))
    return j.reconcile(e, index, ["tx_sequence_number"], ["sender", "module"])


@query("j10_cross_validate", """WITH r AS (SELECT r, o_orderkey AS pos, CASE WHEN r = 2 AND o_orderkey % 600 = 5 THEN 'x' ELSE o_orderstatus END AS v FROM orders, range(3) t(r) WHERE NOT (r = 1 AND o_orderkey % 900 = 6))
  SELECT pos, count(DISTINCT r) AS present, count(DISTINCT v) AS distinct_values FROM r GROUP BY pos HAVING count(DISTINCT r) < 3 OR count(DISTINCT v) > 1""")
def _(t):
    r = t.orders.select(F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("r"), F.col("o_orderkey").alias("pos"), F.col("o_orderstatus").alias("v")).where("not (r = 1 and pos % 900 = 6)")
    return j.cross_validate(r.withColumn("v", F.when((F.col("r") == 2) & (F.col("pos") % 600 == 5), "x").otherwise(F.col("v"))), "r", "pos", "v")


@query("j14_display_join", """WITH tpl AS (SELECT p_partkey % 25 AS kind, p_partkey AS version, p_name AS template FROM part), last AS (SELECT kind, arg_max(template, version) AS template FROM tpl WHERE kind <> 4 GROUP BY 1)
  SELECT n_nationkey AS kind, n_name, template FROM nation LEFT JOIN last ON kind = n_nationkey""")
def _(t):
    templates = t.part.select((F.col("p_partkey") % 25).alias("kind"), F.col("p_partkey").alias("version"), F.col("p_name").alias("template")).where("kind <> 4")
    return j.with_display(t.nation.select(F.col("n_nationkey").cast("long").alias("kind"), "n_name"), templates, "kind", "version", "template")


@query("p20_latest_display", "SELECT p_partkey % 25 AS object_type, arg_max(p_name, p_partkey) AS template, max(p_partkey) AS version FROM part GROUP BY 1")
def _(t):
    rows = t.part.select((F.col("p_partkey") % 25).alias("object_type"), F.col("p_partkey").alias("version"), F.col("p_name").alias("template"))
    return j.latest_by(rows, "object_type", ["version"])


@query("j15_name_service", "SELECT c_custkey, c_name AS domain, s_suppkey AS address FROM customer LEFT JOIN (SELECT s_suppkey, s_suppkey * 3 AS k FROM supplier) ON k = c_custkey")
def _(t):
    names = t.customer.select("c_custkey", F.col("c_name").alias("domain"))
    registry = t.supplier.select((F.col("s_suppkey") * 3).alias("c_custkey"), F.col("s_suppkey").alias("address"))
    return j.resolve(names, registry, "c_custkey")


@query("j16_coin_metadata", """WITH m AS (SELECT l_returnflag AS coin_type, arg_min(l_partkey, (l_orderkey, l_linenumber)) AS supply FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1)
  SELECT c.coin_type, CASE WHEN c.coin_type = 'native' THEN 1000000 ELSE supply END AS supply FROM (VALUES ('A'), ('N'), ('R'), ('native')) c(coin_type) LEFT JOIN m USING (coin_type)""")
def _(t):
    coins = t.lineitem.select(F.col("l_returnflag").alias("coin_type")).distinct().union(t.region.limit(1).select(F.lit("native")))
    metadata = t.lineitem.where("l_returnflag <> 'N'").select(F.col("l_returnflag").alias("coin_type"), F.col("l_partkey").alias("supply"), "l_orderkey", "l_linenumber")
    return j.with_metadata(coins, metadata, "coin_type", ["l_orderkey", "l_linenumber"], "native", 1_000_000)


def edges_of(li):
    cell = lambda shift: li.select(F.col("l_orderkey").alias("tx"), F.col("l_partkey").alias("object_id"), (F.col("l_linenumber") - shift).alias("version"))
    return j.staged_edges(cell(0), cell(1))


EDGES = """SELECT DISTINCT w.l_orderkey AS tx, r.l_orderkey AS depends_on FROM lineitem w JOIN lineitem r ON r.l_partkey = w.l_partkey AND r.l_linenumber = w.l_linenumber - 1
  WHERE w.l_orderkey <> r.l_orderkey"""


@query("j17_staged_edges", EDGES)
def _(t):
    return edges_of(t.lineitem)


@query("l1_keyset_page", """SELECT tx_sequence_number, sender, true AS has_next FROM fx_tx WHERE tx_sequence_number < 5000 ORDER BY tx_sequence_number DESC LIMIT 50""")
def _(t):
    return p.keyset_page(t.fx_tx.select("tx_sequence_number", "sender"), ["tx_sequence_number"], p.capped_limit(0), (5000,), descending=True)


@query("l2_connection_page", """SELECT * FROM (SELECT tx_sequence_number, module, true AS has_prev, true AS has_next FROM fx_event WHERE tx_sequence_number > 100 AND tx_sequence_number < 900
  ORDER BY tx_sequence_number DESC LIMIT 20)""")
def _(t):
    return p.connection_page(t.fx_event.select("tx_sequence_number", "module"), ["tx_sequence_number"], last=20, after=(100,), before=(900,))


@query("l3_composite_cursor", """SELECT l_orderkey, l_linenumber, l_partkey, true AS has_next FROM lineitem WHERE (l_orderkey, l_linenumber) > (500, 2) ORDER BY 1, 2, 3 LIMIT 40""")
def _(t):
    """Lines with equal keys are in the order of their parts."""
    return p.keyset_page(t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey"), ["l_orderkey", "l_linenumber"], 40, (500, 2), ties=["l_partkey"])


@query("l4_consistent_cursor", "SELECT object_id, object_version, true AS has_next FROM fx_object_history WHERE checkpoint_sequence_number <= 1500 AND (object_id, object_version) > (20, 3) ORDER BY 1, 2 LIMIT 30")
def _(t):
    cursor = (1500, (20, 3))
    viewed = p.checked_view([cursor, None])
    return p.keyset_page(t.fx_object_history.where(F.col("checkpoint_sequence_number") <= viewed).select("object_id", "object_version"), ["object_id", "object_version"], 30, cursor[1])


@query("l5_limit_policy", "SELECT asked, CASE WHEN asked IS NULL OR asked = 0 OR asked > 50 THEN 50 ELSE asked END AS rows FROM (VALUES (NULL), (0), (7), (50), (1000)) v(asked)")
def _(t):
    """The rows that a page has for each limit that is asked for."""
    page = lambda n: p.keyset_page(t.fx_tx.select("tx_sequence_number"), ["tx_sequence_number"], p.capped_limit(n))
    return reduce(lambda a, b: a.union(b), [page(n).agg(F.lit(n).cast("int").alias("asked"), F.count("*").alias("rows")) for n in (None, 0, 7, 50, 1000)])


@query("l6_top_ten", "SELECT move_package, move_module, count(*) AS n FROM fx_move_call GROUP BY ALL ORDER BY n DESC, 1, 2 LIMIT 10")
def _(t):
    return t.fx_move_call.groupBy("move_package", "move_module").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "move_package", "move_module").limit(10)


@query("l7_latest_checkpoints", "SELECT sequence_number, timestamp_ms FROM fx_checkpoint ORDER BY timestamp_ms DESC, sequence_number DESC LIMIT 100")
def _(t):
    return t.fx_checkpoint.orderBy(F.desc("timestamp_ms"), F.desc("sequence_number")).limit(100).select("sequence_number", "timestamp_ms")


def positions(tx):
    from pyspark.sql import Window

    tx = tx.withColumn("price", F.when(F.col("transaction_kind") != "error", F.col("gas_price")))
    ordered = p.by_gas_price(tx, "price", ["tx_sequence_number"], "checkpoint_sequence_number")
    per = ordered.withColumn("i", F.row_number().over(Window.partitionBy("checkpoint_sequence_number").orderBy(F.coalesce(F.col("price").cast("decimal(20,0)"), F.lit(str(2**64 - 1)).cast("decimal(20,0)")).desc(), "tx_sequence_number")))
    sizes = tx.groupBy("checkpoint_sequence_number").agg(F.count("*").alias("n"))
    sizes = running_sums(sizes, ["checkpoint_sequence_number"], {"upto": "n"}, F.floor(F.col("checkpoint_sequence_number") / 1000)).withColumn("before", F.col("upto") - F.col("n"))
    return per.join(sizes, "checkpoint_sequence_number").select("tx_sequence_number", (F.col("before") + F.col("i")).alias("position"))


POSITIONS = """SELECT tx_sequence_number, row_number() OVER (ORDER BY checkpoint_sequence_number, coalesce(price, 18446744073709551615) DESC, tx_sequence_number) AS position
  FROM (SELECT *, CASE WHEN transaction_kind <> 'error' THEN CAST(gas_price AS HUGEINT) END AS price FROM fx_tx)"""


@query("l8_gas_price_order", POSITIONS)
def _(t):
    return positions(t.fx_tx)


# Digests in an order of their own: a bijection of numbers.
DIGEST = "{0} * 7919 % 1000003 + 1000003 * ({0} // 1000003)"
MANY_DEPS = "dep AS (SELECT tx, depends_on FROM fx_dep UNION SELECT a.tx_sequence_number, b.tx_sequence_number FROM fx_tx a JOIN fx_tx b ON b.tx_sequence_number = a.tx_sequence_number - 2 AND a.checkpoint_sequence_number = b.checkpoint_sequence_number)"


def digest(c: str):
    return F.col(c) * 7919 % 1000003 + 1000003 * F.floor(F.col(c) / 1000003)


def many_deps(t):
    at = t.fx_tx.select(F.col("tx_sequence_number").alias("tx"), F.col("checkpoint_sequence_number").alias("c"))
    two = at.select("tx", "c", (F.col("tx") - 2).alias("depends_on")).join(at.select(F.col("tx").alias("depends_on"), "c"), ["depends_on", "c"])
    return t.fx_dep.select("tx", "depends_on").union(two.select("tx", "depends_on")).distinct()


@query("l9_causal_order", f"""WITH RECURSIVE {MANY_DEPS}, n AS (SELECT checkpoint_sequence_number AS g, list({DIGEST.format("tx_sequence_number")} ORDER BY {DIGEST.format("tx_sequence_number")}) AS nodes FROM fx_tx GROUP BY 1),
  d AS MATERIALIZED (SELECT {DIGEST.format("tx")} AS n, list({DIGEST.format("depends_on")} ORDER BY {DIGEST.format("depends_on")} DESC) AS deps FROM dep GROUP BY 1),
  walk(g, nodes, stack, seen, done) AS (SELECT g, nodes, []::BIGINT[], []::BIGINT[], []::BIGINT[] FROM n UNION ALL
  SELECT g, nodes, CASE WHEN nxt IS NOT NULL THEN list_append(stack, nxt) ELSE stack[:-2] END, CASE WHEN nxt IS NOT NULL THEN list_append(seen, nxt) ELSE seen END, CASE WHEN nxt IS NULL THEN list_append(done, stack[-1]) ELSE done END
  FROM (SELECT w.*, list_filter(CASE WHEN len(stack) = 0 THEN nodes ELSE deps END, lambda x: NOT list_contains(seen, x))[1] AS nxt FROM walk w LEFT JOIN d ON d.n = w.stack[-1]) WHERE len(stack) > 0 OR nxt IS NOT NULL),
  f AS (SELECT g, unnest(done) AS tx, generate_subscripts(done, 1) - 1 AS position FROM walk WHERE len(done) = len(nodes))
  SELECT g AS checkpoint_sequence_number, tx, position FROM f""")
def _(t):
    """Digests that don't ascend with the dependencies, and up to two dependencies each."""
    nodes = t.fx_tx.select("checkpoint_sequence_number", digest("tx_sequence_number").alias("tx"))
    return p.causal_order(nodes, many_deps(t).select(digest("tx").alias("tx"), digest("depends_on").alias("depends_on")), "checkpoint_sequence_number")


@query("l10_dependency_depth", """WITH RECURSIVE d(tx, depth) AS (SELECT tx_sequence_number, CAST(0 AS BIGINT) FROM fx_tx UNION SELECT e.tx, d.depth + 1 FROM d JOIN fx_dep e ON e.depends_on = d.tx)
  SELECT tx, max(depth) AS depth FROM d GROUP BY tx""")
def _(t):
    return p.dependency_depth(t.fx_tx.select(F.col("tx_sequence_number").alias("tx"), "checkpoint_sequence_number"), t.fx_dep, "checkpoint_sequence_number")


@query("l10_depth_across_checkpoints", """WITH RECURSIVE e AS MATERIALIZED (SELECT tx, depends_on FROM fx_dep UNION ALL SELECT a.tx_sequence_number, b.tx_sequence_number FROM fx_tx a JOIN fx_tx b ON b.tx_sequence_number = a.tx_sequence_number - 90 - a.gas_price % 5),
  d(tx, depth) AS (SELECT tx_sequence_number, CAST(0 AS BIGINT) FROM fx_tx UNION SELECT e.tx, d.depth + 1 FROM d JOIN e ON e.depends_on = d.tx) SELECT tx, max(depth) AS depth FROM d GROUP BY tx""")
def _(t):
    """Edges that cross checkpoints, too; a task holds so many numbers of transactions, whatever a checkpoint holds."""
    nodes = t.fx_tx.select(F.col("tx_sequence_number").alias("tx"), F.floor(F.col("tx_sequence_number") / PER_TASK).alias("part"))
    far = t.fx_tx.select(F.col("tx_sequence_number").alias("tx"), (F.col("tx_sequence_number") - 90 - F.col("gas_price") % 5).alias("depends_on"))
    return p.dependency_depth(nodes, t.fx_dep.select("tx", "depends_on").union(far), "part")


@query("l11_array_page", """SELECT o_custkey, keys[3:4] AS keys, len(keys) > 0 AS has_prev, len(keys) > 4 AS has_next FROM (SELECT o_custkey, list_sort(list(o_orderkey)) AS keys FROM orders GROUP BY 1)""")
def _(t):
    return p.array_page(t.orders.groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("keys")), "keys", 2, 2)


@query("l12_key_search", "SELECT doc_id, n_chars FROM documents WHERE doc_id >= 100 AND doc_id < 250")
def _(t):
    return p.key_scan(t.documents.select("doc_id", "n_chars"), "doc_id", 100, 250)


@query("l13_numbered_page", "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 25 OFFSET 75")
def _(t):
    return p.numbered_page(t.orders.select("o_orderkey", "o_custkey"), "o_orderkey", 25, 3)


@query("l14_map_page", """WITH m AS (SELECT o_custkey, concat('k', lpad(CAST(o_orderkey % 97 AS VARCHAR), 2, '0')) AS name, min(o_orderkey) AS value FROM orders GROUP BY ALL),
  c AS (SELECT *, count(*) FILTER (name > 'k30') OVER (PARTITION BY o_custkey) AS ahead, count(*) OVER (PARTITION BY o_custkey) AS n FROM m)
  SELECT o_custkey, ahead > 3 AS has_next, n > ahead AS has_prev, name, value FROM c WHERE name > 'k30' QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY name) <= 3""")
def _(t):
    name = F.concat(F.lit("k"), F.lpad((F.col("o_orderkey") % 97).cast("string"), 2, "0"))
    cells = t.orders.groupBy("o_custkey", name.alias("name")).agg(F.min("o_orderkey").alias("value"))
    maps = cells.groupBy("o_custkey").agg(F.map_from_entries(F.collect_list(F.struct("name", "value"))).alias("modules"))
    return p.map_page(maps, "modules", 3, "k30")


@query("u3_union_changes", "SELECT 'created' AS tag, l_orderkey AS tx, l_partkey AS object_id FROM lineitem WHERE l_linenumber = 1 UNION ALL SELECT 'mutated', l_orderkey, l_partkey FROM lineitem WHERE l_linenumber > 5")
def _(t):
    part = lambda tag, cond: t.lineitem.where(cond).select(F.lit(tag).alias("tag"), F.col("l_orderkey").alias("tx"), F.col("l_partkey").alias("object_id"))
    return p.union_pages([part("created", "l_linenumber = 1"), part("mutated", "l_linenumber > 5")])


@query("u4_seen_set", "SELECT DISTINCT l_partkey AS object_id, l_suppkey AS owner FROM lineitem")
def _(t):
    return t.lineitem.select(F.col("l_partkey").alias("object_id"), F.col("l_suppkey").alias("owner")).dropDuplicates(["object_id", "owner"])
