"""Composable filters, as Columns."""

from __future__ import annotations

import json
import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GONE = ("deleted", "wrapped", "unwrapped_then_deleted")


def match_all(filters: list[Column]) -> Column:
    """true without filters."""
    return reduce(lambda a, b: a & b, filters, F.lit(True))


def match_any(filters: list[Column]) -> Column:
    """false without filters."""
    return reduce(lambda a, b: a | b, filters) if filters else F.lit(False)


def match_none(filters: list[Column]) -> Column:
    """no filter at all without filters."""
    return ~match_any(filters) if filters else F.lit(True)


def package_is(type_column: str, package: str) -> Column:
    return F.col(type_column).startswith(f"{package}::")


def module_is(type_column: str, package: str, module: str) -> Column:
    return F.col(type_column).startswith(f"{package}::{module}::")


def struct_is(type_column: str, tag: str) -> Column:
    """a type without parameters matches all instances."""
    c = F.col(type_column)
    return c == tag if "<" in tag else (c == tag) | c.startswith(tag + "<")


def owner_is(owner: str, value, old_owner: str | None = None) -> Column:
    """now, or with old_owner before."""
    now = F.col(owner) == value
    return now if old_owner is None else now | (F.col(old_owner) == value)


def ids_in(column: str, ids: list) -> Column:
    return F.col(column).isin(ids) if ids else F.lit(False)


def not_gone(status: str) -> Column:
    """F4"""
    return ~F.col(status).isin(*GONE)


def type_filter(column: str, text: str) -> Column:
    """a package, a primitive, a module, or a struct with or without parameters; raises ValueError for anything else."""
    head, parameters = (text.split("<", 1) + [None])[:2]
    parts = head.split("::")
    if not all(parts) or len(parts) > 3 or (parameters is not None and len(parts) != 3 and head.startswith("0x")):
        raise ValueError(f"not a type, module or package: {text!r}")
    if len(parts) == 1:
        return F.col(column).startswith(f"{head}::") if head.startswith("0x") else F.col(column) == text
    if len(parts) == 2:
        return F.col(column).startswith(f"{head}::")
    return struct_is(column, text)


def owned_by(owner: str, owner_type: str, value, kinds: tuple[int, ...] = (1, 2)) -> Column:
    """address is 1, object 2."""
    return (F.col(owner) == value) & F.col(owner_type).isin(*kinds)


def time_range(column: str, start: int, end: int) -> Column:
    """[start, end); a null time is outside."""
    return F.coalesce((F.col(column) >= start) & (F.col(column) < end), F.lit(False))


def json_path(pointer: str) -> str:
    """A JSON pointer as a JSON path."""
    if pointer == "":
        return "$"
    if not pointer.startswith("/"):
        raise ValueError(f"not a JSON pointer: {pointer!r}")
    parts = [p.replace("~1", "/").replace("~0", "~") for p in pointer[1:].split("/")]
    return "$" + "".join(f"[{p}]" if re.fullmatch(r"0|[1-9]\d*", p) else f"['{p}']" for p in parts)


def json_field_is(column: str, pointer: str, value) -> Column:
    """F8: false where the field is missing."""
    wanted = value if isinstance(value, str) else json.dumps(value)
    return F.coalesce(F.get_json_object(F.col(column), json_path(pointer)) == wanted, F.lit(False))


def semi(rows: DataFrame, index: DataFrame, key: str, condition: Column, index_key: str | None = None) -> DataFrame:
    """Rows whose key has an index row with the condition."""
    return rows.join(index.where(condition).select(F.col(index_key or key).alias(key)), key, "left_semi")


def events_page_filter(events: DataFrame, tx: DataFrame, sender=None, digest=None, module: str | None = None, event_type: str | None = None, viewed_at: int | None = None) -> DataFrame:
    """all given conditions together; sender, digest and viewed_at live in tx (tx, sender, digest, checkpoint)."""
    conditions = []
    if sender is not None:
        conditions.append(F.col("sender") == sender)
    if digest is not None:
        conditions.append(F.col("digest") == digest)
    if viewed_at is not None:
        conditions.append(F.col("checkpoint") <= viewed_at)
    own = match_all(([F.col("module") == module] if module is not None else []) + ([type_filter("event_type", event_type)] if event_type is not None else []))
    out = events.where(own)
    return out.join(tx.where(match_all(conditions)).select("tx"), "tx", "left_semi") if conditions else out


class TransactionFilter:
    """The variants of a transaction filter over index tables.

    tx has tx, checkpoint, sender and kind; recipients has tx and recipient; calls has tx, package, module and function;
    inputs and changed have tx and object_id.
    """

    def __init__(self, tx: DataFrame, recipients: DataFrame, calls: DataFrame, inputs: DataFrame, changed: DataFrame):
        self.tx, self.recipients, self.calls, self.inputs, self.changed = tx, recipients, calls, inputs, changed

    def checkpoint(self, seq: int) -> DataFrame:
        return self.tx.where(F.col("checkpoint") == seq)

    def move_function(self, package: str, module: str | None = None, function: str | None = None) -> DataFrame:
        parts = [("package", package), ("module", module), ("function", function)]
        return semi(self.tx, self.calls, "tx", match_all([F.col(c) == v for c, v in parts if v is not None]))

    def input_object(self, object_id) -> DataFrame:
        return semi(self.tx, self.inputs, "tx", F.col("object_id") == object_id)

    def changed_object(self, object_id) -> DataFrame:
        return semi(self.tx, self.changed, "tx", F.col("object_id") == object_id)

    def from_address(self, address) -> DataFrame:
        return self.tx.where(F.col("sender") == address)

    def to_address(self, address) -> DataFrame:
        return semi(self.tx, self.recipients, "tx", F.col("recipient") == address)

    def from_and_to(self, sender, recipient) -> DataFrame:
        return semi(self.from_address(sender), self.recipients, "tx", F.col("recipient") == recipient)

    def from_or_to(self, address) -> DataFrame:
        got = self.recipients.where(F.col("recipient") == address).select("tx")
        return self.tx.join(got.union(self.from_address(address).select("tx")).distinct(), "tx", "left_semi")

    def kind_in(self, kinds: list[str]) -> DataFrame:
        return self.tx.where(ids_in("kind", kinds))

    def combined(self, function: str | None = None, kind: str | None = None, after: int | None = None, before: int | None = None, signer=None, recipient=None, input_object=None, changed_object=None, ids: list | None = None) -> DataFrame:
        """all given fields together; checkpoint bounds are exclusive, function has one to three parts."""
        rows = self.tx
        if after is not None:
            rows = rows.where(F.col("checkpoint") > after)
        if before is not None:
            rows = rows.where(F.col("checkpoint") < before)
        if kind is not None:
            rows = rows.where(F.col("kind") == kind)
        if signer is not None:
            rows = rows.where(F.col("sender") == signer)
        if ids is not None:
            rows = rows.where(ids_in("tx", ids))
        if function is not None:
            parts = list(zip(("package", "module", "function"), function.split("::"), strict=False))
            rows = semi(rows, self.calls, "tx", match_all([F.col(c) == v for c, v in parts]))
        if recipient is not None:
            rows = semi(rows, self.recipients, "tx", F.col("recipient") == recipient)
        if input_object is not None:
            rows = semi(rows, self.inputs, "tx", F.col("object_id") == input_object)
        if changed_object is not None:
            rows = semi(rows, self.changed, "tx", F.col("object_id") == changed_object)
        return rows

    def related(self, address, relation: str = "sign") -> DataFrame:
        """F14"""
        return self.to_address(address) if relation == "recv" else self.from_address(address)


EMPTY = object()


def intersect(a: dict, b: dict):
    """two filters as one, or EMPTY if they contradict. Fields named after_* keep the larger bound, before_* the smaller."""
    out = dict(a)
    for name, value in b.items():
        if value is None:
            continue
        if out.get(name) is None:
            out[name] = value
        elif name.startswith("after"):
            out[name] = max(out[name], value)
        elif name.startswith("before"):
            out[name] = min(out[name], value)
        elif out[name] != value:
            return EMPTY
    return out


def epoch_at(epochs: DataFrame, viewed_at: int, epoch: int | None = None) -> DataFrame:
    """F16: the epoch asked for, or else the newest, among those that began by the checkpoint viewed_at."""
    begun = epochs.where(F.col("first_checkpoint_id") <= viewed_at)
    if epoch is not None:
        return begun.where(F.col("epoch") == epoch)
    return begun.orderBy(F.desc("first_checkpoint_id")).limit(1)


def valid_domain(column: str) -> Column:
    """at most 200 characters; labels of 1 to 63 of a-z, 0-9 and hyphens, which don't stand at an end."""
    label = "[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?"
    return (F.length(column) <= 200) & F.col(column).rlike(rf"\A{label}(?:\.{label})*\z")


def domain_labels(column: str) -> Column:
    """the labels from the top level down."""
    return F.reverse(F.split(F.col(column), r"\."))


def failures(values: DataFrame, rules: DataFrame, on: str) -> DataFrame:
    """rules (on, threshold, condition: greater, equal or less) that a value meets, each a failure."""
    met = (
        F.when(F.col("condition") == "greater", F.col("value") > F.col("threshold"))
        .when(F.col("condition") == "equal", F.col("value") == F.col("threshold"))
        .when(F.col("condition") == "less", F.col("value") < F.col("threshold"))
    )
    return values.join(rules, on).where(met)
