"""Object versions: consistent reads of a snapshot and its history, balances, and changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.operators.series import previous_row
from cairn.sources.shared import spread
from cairn.sources.state_table import StateTable

KEY, VERSION, CHECKPOINT = "object_id", "object_version", "checkpoint_sequence_number"


def latest_version(rows: DataFrame, key: str = KEY, version: str = VERSION) -> DataFrame:
    """The newest version of each object."""
    return _one_row(rows, key, F.max_by, F.struct(version))


def _one_row(rows: DataFrame, key: str, choose, order: Column) -> DataFrame:
    """An aggregation that tasks begin before the shuffle, so that an object with very many versions is no task of its own."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(choose(F.struct(*rest), order).alias("__r")).select(*[key if c == key else F.col(f"__r.{c}").alias(c) for c in rows.columns])


def lowest_version(rows: DataFrame, key: str = KEY, version: str = VERSION, checkpoint: str = CHECKPOINT) -> DataFrame:
    """W4, the first form of the deduplication: the lowest version, of equal ones the newest checkpoint."""
    return _one_row(rows, key, F.min_by, F.struct(F.col(version), -F.col(checkpoint)))


def drop_superseded(candidates: DataFrame, newer: DataFrame, key: str = KEY, version: str = VERSION) -> DataFrame:
    """J1, and J2 with a filtered right side: candidates for which ``newer`` has no larger version.

    An aggregated maximum and an equi-join in place of a join by inequality.
    """
    top = newer.groupBy(key).agg(F.max(version).alias("__top"))
    return candidates.join(top, key, "left").where(F.col("__top").isNull() | (F.col(version) >= F.col("__top"))).drop("__top")


def drop_deleted_children(candidates: DataFrame, history: DataFrame, parent_version: int, key: str = KEY, version: str = VERSION, status: str = "object_status") -> DataFrame:
    """Only newer deletions up to the parent's version count."""
    return drop_superseded(candidates, history.where((F.col(status) == 1) & (F.col(version) <= parent_version)), key, version)


def objects_at(snapshot: DataFrame, history: DataFrame, condition: Column, lhs: int, rhs: int, consistent: bool = True, checkpoint: str = CHECKPOINT) -> DataFrame:
    """Objects that match as of checkpoint rhs, from a snapshot as of lhs and the history after it.

    The filter applies to both sides first, then the newest match of each object is kept. A consistent view drops it
    if the object has a newer version by rhs that doesn't match; a historical one keeps it.
    """
    later = history.where((F.col(checkpoint) > lhs) & (F.col(checkpoint) <= rhs))
    older = snapshot.where(F.col(checkpoint) <= rhs)
    found = latest_version(older.where(condition).unionByName(later.where(condition)))
    return drop_superseded(found, later) if consistent else found


def live(status: str = "object_status") -> Column:
    return F.col(status) == 0


def fold_snapshot(snapshot: DataFrame, history: DataFrame, start: int, end: int, checkpoint: str = CHECKPOINT) -> DataFrame:
    """The snapshot after the history of checkpoints [start, end); deletions stay as rows with their status."""
    return latest_version(snapshot.unionByName(history.where((F.col(checkpoint) >= start) & (F.col(checkpoint) < end))))


def snapshot_due(latest: int, start: int, least: int = 300, most: int = 900) -> int | None:
    """Where to fold to, start + (most - least), once latest is more than most ahead of start; else None."""
    return start + (most - least) if latest > start + most else None


def fold_point(latest: Column, start: int, least: int = 300, most: int = 900) -> Column:
    """T11 for a column of latest checkpoints: what snapshot_due() gives for each."""
    return F.when(latest > start + most, F.lit(start + (most - least)))


def consistent_range(available: tuple[int, int], viewed_at: int | None = None) -> tuple[int, int] | None:
    """The range to read at viewed_at, or None if that is not available."""
    lhs, rhs = available
    if viewed_at is None:
        return lhs, rhs
    return (lhs, viewed_at) if lhs <= viewed_at <= rhs else None


def balances(rows: DataFrame, keys: list[str], coin_type: str = "coin_type", balance: str = "coin_balance") -> DataFrame:
    """A3, A4: sum and number of coins by type, for whatever objects are given."""
    return rows.where(F.col(coin_type).isNotNull()).groupBy(*keys, coin_type).agg(F.coalesce(F.sum(F.col(balance).cast("decimal(20,0)")), F.lit(0)).cast("decimal(38,0)").alias("balance"), F.count("*").alias("coins"))


def balance_or_zero(keys: DataFrame, found: DataFrame, on: list[str]) -> DataFrame:
    """A5: a row for each key asked for, of zeros where nothing was found."""
    return keys.join(found, on, "left").withColumns({"balance": F.coalesce("balance", F.lit(0).cast("decimal(38,0)")), "coins": F.coalesce("coins", F.lit(0).cast("long"))})


def past_objects(requests: DataFrame, history: DataFrame, key: str = KEY, version: str = VERSION, status: str = "object_status") -> DataFrame:
    """Requests (key, version) with outcome exists, deleted or not_exists."""
    found = requests.join(history, [key, version], "left")
    return found.withColumn("outcome", F.when(F.col(status).isNull(), "not_exists").when(F.col(status) == 1, "deleted").otherwise("exists"))


def old_owner(rows: DataFrame, columns: list[str], key: str = KEY, version: str = VERSION) -> DataFrame:
    """Rows with each column's value in the version before, as old_<column>."""
    return _with_old(rows, columns, key, version).drop("__before")


def _with_old(rows: DataFrame, columns: list[str], key: str, version: str) -> DataFrame:
    found = previous_row(rows, [key], version, columns, "__before")
    return found.withColumns({f"old_{c}": F.col(f"__before.{c}") for c in columns})


def change_log(rows: DataFrame, deleted: DataFrame, columns: list[str], key: str = KEY, version: str = VERSION) -> DataFrame:
    """The history that a change capture keeps: inserts and updates with the owner before, without objects in deleted."""
    kept = rows.join(deleted.select(key), key, "left_anti")
    first = F.col("__before").isNull()
    return _with_old(kept, columns, key, version).withColumn("operation", F.when(first, "INSERT").otherwise("UPDATE")).drop("__before")


def fold_into(table: StateTable, batch: int, history: DataFrame, start: int, end: int, checkpoint: str = CHECKPOINT) -> int:
    """A stored snapshot after the history of checkpoints [start, end), by writing only the buckets whose objects changed; their number."""
    changed = latest_version(history.where((F.col(checkpoint) >= start) & (F.col(checkpoint) < end)))
    return table.merge(batch, changed, lambda old, new: latest_version(old.unionByName(new)))


def object_changes(changes: DataFrame, previous: DataFrame) -> DataFrame:
    """Typed changes of transactions.

    changes has tx, object_id, version, kind (create, mutate, delete, wrap, publish or others, which are dropped) and
    is_package; previous has tx, object_id and previous_version. A package counts only where it is created.
    """
    joined = changes.join(previous, ["tx", "object_id"], "left")
    kind = F.col("kind")
    change = (
        F.when(F.col("is_package"), F.when(kind == "create", "published"))
        .when(kind == "create", "created").when(kind == "mutate", "mutated").when(kind == "delete", "deleted").when(kind == "wrap", "wrapped")
    )
    return joined.withColumn("change", change).where("change is not null").select("tx", "object_id", "version", "change", F.when(F.col("change") == "mutated", F.col("previous_version")).alias("previous_version"))


def balance_changes(tx: DataFrame, inputs: DataFrame, outputs: DataFrame, native: str) -> DataFrame:
    """Tx, owner, coin_type, amount: outputs less inputs, zeros left out.

    tx has tx, success, gas_owner and net_gas; inputs and outputs have tx, owner, coin_type, balance, and inputs also
    skipped (unwrapped and then deleted). A failed transaction only costs its gas owner the net gas.

    Cells go through one exchange, by transaction, over more tasks where there are more rows: it serves join and sum.
    """
    money = lambda c: c.cast("decimal(38,0)")
    good = tx.where("success").select("tx")
    signed = inputs.where(~F.coalesce(F.col("skipped"), F.lit(False))).select("tx", "owner", "coin_type", money(-F.col("balance")).alias("amount"))
    signed = signed.unionByName(outputs.select("tx", "owner", "coin_type", money(F.col("balance")).alias("amount")))
    rows = inputs.count() + outputs.count()
    # Not a semi-join: Spark would push that below the exchange, onto fewer tasks.
    signed = spread(signed, rows, "tx").join(spread(good, rows, "tx").distinct(), "tx")
    summed = signed.groupBy("tx", "owner", "coin_type").agg(money(F.sum("amount")).alias("amount")).where("amount <> 0")
    failed = tx.where("not success").select("tx", F.col("gas_owner").alias("owner"), F.lit(native).alias("coin_type"), money(-F.col("net_gas")).alias("amount"))
    return summed.unionByName(failed)


def set_digest(rows: DataFrame, columns: list[str], by: list[str], sign: Column | None = None) -> DataFrame:
    """An order-free digest of a multiset of rows: the sum of 60-bit hashes, removals counting negative."""
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in columns])
    value = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 15), 16, 10).cast("decimal(20,0)")
    value = value if sign is None else value * sign
    return rows.groupBy(*by).agg(F.sum(value).cast("decimal(38,0)").alias("digest"), F.count("*").alias("items"))
