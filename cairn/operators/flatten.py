"""Flatteners: nested checkpoint records to warehouse tables.

Input is a DataFrame of CHECKPOINT records (cairn.plans.schemas). Every function is a projection or an explode, so that
one pass over the source feeds a table, and column pruning reaches the nested fields.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Command kinds with a counter of their own.
KINDS = {"MoveCall": "move_calls", "TransferObjects": "transfers", "SplitCoins": "split_coins", "MergeCoins": "merge_coins", "Publish": "publish", "Upgrade": "upgrade"}


def _sum_of(array: Column, value) -> Column:
    return F.aggregate(array, F.lit(0).cast("long"), lambda a, x: a + value(x).cast("long"))


def flatten_checkpoint(cps: DataFrame) -> DataFrame:
    """One row for each checkpoint; gas is computation + storage - rebate."""
    tx, s, gas = F.col("transactions"), "summary", F.col("summary.gas")
    good = F.filter(tx, lambda x: x["effects"]["success"])
    return cps.select(
        f"{s}.digest", f"{s}.sequence_number", f"{s}.epoch", f"{s}.timestamp_ms", f"{s}.previous_digest", f"{s}.end_of_epoch",
        (gas["computation"] + gas["storage"] - gas["rebate"]).cast("decimal(38,0)").alias("total_gas_cost"),
        F.size(tx).cast("long").alias("total_transaction_blocks"), _sum_of(tx, lambda x: F.size(x["commands"])).alias("total_transactions"),
        F.size(good).cast("long").alias("total_successful_transaction_blocks"), _sum_of(good, lambda x: F.size(x["commands"])).alias("total_successful_transactions"),
    )


def transactions(cps: DataFrame) -> DataFrame:
    """Each transaction with its checkpoint's keys, as tx and c."""
    return cps.select("summary.sequence_number", "summary.epoch", "summary.timestamp_ms", F.explode("transactions").alias("tx"))


def _keys() -> list[Column]:
    return [F.col("tx.digest").alias("transaction_digest"), F.col("sequence_number").alias("checkpoint"), F.col("epoch"), F.col("timestamp_ms")]


def command_counts(commands: Column, is_system: Column) -> dict[str, Column]:
    """A counter for each kind and for all others; system transactions count none."""
    count = lambda test: F.when(is_system, F.lit(0)).otherwise(F.size(F.filter(commands, test))).cast("long")
    is_a = lambda kind: lambda c: c["kind"] == kind
    out = {name: count(is_a(kind)) for kind, name in KINDS.items()}
    return out | {"other_commands": count(lambda c: ~c["kind"].isin(*KINDS))}


def packages_of(commands: Column) -> Column:
    """Distinct packages in order, joined by hyphens."""
    return F.array_join(F.array_sort(F.array_distinct(F.filter(F.transform(commands, lambda c: c["package"]), lambda p: p.isNotNull()))), "-")


def effect_counts(effects: Column) -> dict[str, Column]:
    """P5: mutated includes unwrapped; deleted includes wrapped and unwrapped then deleted."""
    n = lambda name: F.coalesce(F.size(effects[name]), F.lit(0))
    return {
        "created": n("created").cast("long"), "mutated": (n("mutated") + n("unwrapped")).cast("long"),
        "deleted": (n("deleted") + n("wrapped") + n("unwrapped_then_deleted")).cast("long"),
    }


def flatten_transaction(cps: DataFrame) -> DataFrame:
    """One row for each transaction, with P3 to P5."""
    tx, system = F.col("tx"), F.col("tx.is_system")
    counts = command_counts(F.col("tx.commands"), system) | effect_counts(F.col("tx.effects"))
    return transactions(cps).select(
        *_keys(), "tx.sender", F.col("tx.kind").alias("transaction_kind"), F.col("tx.is_system").alias("is_system_txn"), F.col("tx.effects.success").alias("execution_success"),
        F.size(tx["inputs"]).cast("long").alias("input"), F.size(F.filter(tx["inputs"], lambda i: i["shared"])).cast("long").alias("shared_input"),
        F.size(tx["gas_coins"]).cast("long").alias("gas_coins"), "tx.gas_owner", "tx.gas_budget", "tx.gas_price", (tx["gas_owner"] != tx["sender"]).alias("is_sponsored_tx"),
        F.size(tx["commands"]).cast("long").alias("transaction_count"), packages_of(tx["commands"]).alias("packages"), *[c.alias(n) for n, c in counts.items()],
    )


def flatten_event(cps: DataFrame) -> DataFrame:
    """Events with their 0-based index in the transaction."""
    return transactions(cps).select(*_keys(), F.posexplode("tx.events").alias("event_index", "e")).select(
        "transaction_digest", "checkpoint", "epoch", "timestamp_ms", F.col("event_index").cast("long").alias("event_index"),
        "e.sender", "e.package", "e.module", F.col("e.type").alias("event_type"), F.col("e.json").alias("event_json"),
    )


def object_status(effects: Column, object_id: Column) -> Column:
    """Mutated, unwrapped among it, before deleted, all tombstones among it, before created; else null."""
    has = lambda *names: sum((F.coalesce(F.array_contains(effects[n], object_id), F.lit(False)).cast("int") for n in names), F.lit(0)) > 0
    return F.when(has("mutated", "unwrapped"), "Mutated").when(has("deleted", "wrapped", "unwrapped_then_deleted"), "Deleted").when(has("created"), "Created")


def input_kind(tx: Column, object_id: Column) -> Column:
    """Gas coin before shared input before input; else null."""
    shared = F.transform(F.filter(tx["inputs"], lambda i: i["shared"]), lambda i: i["object_id"])
    every = F.transform(tx["inputs"], lambda i: i["object_id"])
    return F.when(F.array_contains(tx["gas_coins"], object_id), "GasCoin").when(F.array_contains(shared, object_id), "SharedInput").when(F.array_contains(every, object_id), "Input")


def owner_columns(o: Column) -> list[Column]:
    """P10: type; address for address and object owners; the first shared version for shared objects."""
    return [
        o["owner_type"].alias("owner_type"),
        F.when(o["owner_type"].isin("AddressOwner", "ObjectOwner"), o["owner"]).alias("owner_address"),
        F.when(o["owner_type"] == "Shared", o["version"]).alias("initial_shared_version"),
    ]


def _outputs(cps: DataFrame) -> DataFrame:
    return transactions(cps).select("sequence_number", "epoch", "timestamp_ms", "tx", F.explode("tx.output_objects").alias("o"))


def flatten_object(cps: DataFrame) -> DataFrame:
    """Output objects with owner, status, coin and JSON."""
    o = F.col("o")
    return _outputs(cps).select(
        "o.object_id", "o.version", "o.digest", "o.type", *_keys()[1:], *owner_columns(o), object_status(F.col("tx.effects"), o["object_id"]).alias("object_status"),
        F.col("tx.digest").alias("previous_transaction"), "o.coin_type", "o.coin_balance", F.col("o.json").alias("object_json"),
    )


def flatten_tx_objects(cps: DataFrame) -> DataFrame:
    """Inputs and output objects of each transaction, each with kind and status; an id may come from both."""
    base = transactions(cps)
    both = F.concat(
        F.transform("tx.inputs", lambda i: F.struct(i["object_id"].alias("object_id"), i["version"].alias("version"))),
        F.transform("tx.output_objects", lambda o: F.struct(o["object_id"].alias("object_id"), o["version"].alias("version"))),
    )
    rows = base.select("sequence_number", "epoch", "timestamp_ms", "tx", F.explode(both).alias("o"))
    return rows.select("o.object_id", "o.version", *_keys(), input_kind(F.col("tx"), F.col("o.object_id")).alias("input_kind"), object_status(F.col("tx.effects"), F.col("o.object_id")).alias("object_status"))


def flatten_move_call(cps: DataFrame) -> DataFrame:
    """One row for each call."""
    calls = transactions(cps).select(*_keys(), F.explode(F.filter("tx.commands", lambda c: c["kind"] == "MoveCall")).alias("c"))
    return calls.select("transaction_digest", "checkpoint", "epoch", "timestamp_ms", "c.package", "c.module", "c.function")


def flatten_package(cps: DataFrame, originals: DataFrame | None = None) -> DataFrame:
    """Packages among output objects; originals maps package_id to original_package_id where it is known."""
    rows = _outputs(cps).where("o.is_package").select(F.col("o.object_id").alias("package_id"), *_keys(), F.col("o.version").alias("package_version"))
    return rows.withColumn("original_package_id", F.col("package_id")) if originals is None else rows.join(originals, "package_id", "left")


def flatten_dynamic_field(cps: DataFrame) -> DataFrame:
    """Fields of parents. A field that is an object refers to that object among the same transaction's outputs.

    Rows without an owner are skipped; a field whose object is not among the outputs is an error of the source, and
    has no row here: compare counts with missing_field_objects().
    """
    rows = _outputs(cps).where("o.df_kind is not null and o.owner is not null")
    base = [F.col("o.owner").alias("parent_object_id"), *_keys(), F.col("o.df_name").alias("name"), F.col("o.df_kind").alias("type")]
    own = rows.where("o.df_kind = 'DynamicField'").select(*base, "o.object_id", "o.version", "o.digest", F.col("o.type").alias("object_type"))
    match = F.filter("tx.output_objects", lambda x: x["object_id"] == F.col("o.df_object_id"))[0]
    wrapped = rows.where("o.df_kind = 'DynamicObject'").withColumn("m", match).where("m is not null")
    return own.unionByName(wrapped.select(*base, "m.object_id", "m.version", "m.digest", F.col("m.type").alias("object_type")))


def missing_field_objects(cps: DataFrame) -> DataFrame:
    """Fields of P14 whose object is not among the outputs of their transaction."""
    rows = _outputs(cps).where("o.df_kind = 'DynamicObject' and o.owner is not null")
    return rows.where(~F.exists("tx.output_objects", lambda x: x["object_id"] == F.col("o.df_object_id"))).select(*_keys(), "o.df_object_id")


def index_tables(cps: DataFrame) -> dict[str, DataFrame]:
    """Senders, recipients, input objects, changed objects (tagged) and calls, each without repeats."""
    t = transactions(cps)
    key = F.col("tx.digest").alias("tx")
    ids = lambda name: F.transform(F.col(f"tx.effects.{name}"), lambda i: F.struct(i.alias("object_id"), F.lit(name).alias("change")))
    owners = F.filter("tx.output_objects", lambda o: o["owner_type"] == "AddressOwner")
    return {
        "tx_senders": t.select(key, "tx.sender").distinct(),
        "tx_recipients": t.select(key, F.explode(F.array_distinct(F.transform(owners, lambda o: o["owner"]))).alias("recipient")),
        "tx_input_objects": t.select(key, F.explode(F.array_distinct(F.transform("tx.inputs", lambda i: i["object_id"]))).alias("object_id")),
        "tx_changed_objects": t.select(key, F.explode(F.concat(ids("created"), ids("mutated"), ids("unwrapped"))).alias("c")).select("tx", "c.object_id", "c.change").dropDuplicates(["tx", "object_id", "change"]),
        "tx_calls": t.select(key, F.explode(F.filter("tx.commands", lambda c: c["kind"] == "MoveCall")).alias("c")).select("tx", "c.package", "c.module", "c.function").distinct(),
    }


def index_rows(cps: DataFrame) -> DataFrame:
    """Senders, recipients, input objects and calls as rows of kind, tx and key without repeats, all from one pass over the checkpoints."""
    rows = lambda kind, keys: F.transform(F.array_distinct(keys), lambda k: F.struct(F.lit(kind).alias("kind"), k.alias("key")))
    owners = F.filter("tx.output_objects", lambda o: o["owner_type"] == "AddressOwner")
    calls = F.transform(F.filter("tx.commands", lambda c: c["kind"] == "MoveCall"), lambda c: F.concat_ws("::", c["package"], c["module"], c["function"]))
    every = F.concat(rows("sender", F.array("tx.sender")), rows("recipient", F.transform(owners, lambda o: o["owner"])), rows("input", F.col("tx.inputs.object_id")), rows("call", calls))
    return transactions(cps).select(F.col("tx.digest").alias("tx"), F.explode(every).alias("r")).select("r.kind", "tx", "r.key").distinct()


def from_and_to(cps: DataFrame) -> DataFrame:
    """Address rows of each transaction, recipients and sender, with the time."""
    t = transactions(cps)
    owners = F.array_distinct(F.transform(F.filter("tx.output_objects", lambda o: o["owner_type"] == "AddressOwner"), lambda o: o["owner"]))
    sides = F.concat(F.transform(owners, lambda a: F.struct(a.alias("address"), F.lit("to").alias("side"))), F.array(F.struct(F.col("tx.sender").alias("address"), F.lit("from").alias("side"))))
    return t.select(*_keys(), F.explode(sides).alias("a")).select("transaction_digest", "timestamp_ms", "a.address", "a.side")


def epoch_rows(begins: DataFrame, ends: DataFrame) -> DataFrame:
    """An epoch's row in two steps, the begin's columns and the end's, whichever is there."""
    return begins.join(ends, "epoch", "full_outer")
