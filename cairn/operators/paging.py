"""Keyset pages, orders and scans."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.sources.shared import materialize, release


def _past(keys: list[str], cursor: tuple, descending: bool, inclusive: bool) -> Column:
    """L3: keys after the cursor in lexicographic order, spelled out so that the scan can use the first one."""
    out = F.lit(inclusive)
    for key, value in reversed(list(zip(keys, cursor, strict=True))):
        beyond = F.col(key) < value if descending else F.col(key) > value
        out = beyond | ((F.col(key) == value) & out)
    first = F.col(keys[0]) <= cursor[0] if descending else F.col(keys[0]) >= cursor[0]
    return first & out


def order_by(keys: list[str], descending: bool) -> list[Column]:
    return [F.desc(k) if descending else F.asc(k) for k in keys]


def keyset_page(rows: DataFrame, keys: list[str], limit: int, cursor: tuple | None = None, descending: bool = False, ties: list[str] = []) -> DataFrame:  # noqa: B006
    """L1: at most limit rows past an exclusive cursor, each with has_next: whether there are more.

    Where keys are not unique, ``ties`` orders rows of equal keys, so that the page is the same each time.

    One row more than asked for is taken, so that the plan is a top-k and never a sort of the whole.
    """
    ahead = rows if cursor is None else rows.where(_past(keys, cursor, descending, False))
    order = order_by([*keys, *ties], descending)
    taken = ahead.orderBy(*order).limit(limit + 1)
    # A window over limit + 1 rows: the number of all of them is known where the last one is left out.
    whole = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return taken.withColumn("has_next", F.count("*").over(whole) > limit).orderBy(*order).limit(limit)


def connection_page(rows: DataFrame, keys: list[str], first: int | None = None, last: int | None = None, after: tuple | None = None, before: tuple | None = None) -> DataFrame:
    """L2: the first or last rows strictly between two cursors, in ascending order, with has_prev and has_next.

    The flags say whether rows lie outside the page on that side, within or beyond the cursors.
    """
    if (first is None) == (last is None):
        raise ValueError("give either first or last")
    limit, backward = (first, False) if first is not None else (last, True)
    inside = rows
    if after is not None:
        inside = inside.where(_past(keys, after, False, False))
    if before is not None:
        inside = inside.where(_past(keys, before, True, False))
    taken = inside.orderBy(*order_by(keys, backward)).limit(limit + 1)
    more = taken.agg((F.count("*") > limit).alias("more"))
    page = taken.orderBy(*order_by(keys, backward)).limit(limit)
    prev = F.col("more") if backward else F.lit(after is not None)
    nxt = F.lit(before is not None) if backward else F.col("more")
    return page.crossJoin(more).select(*rows.columns, prev.alias("has_prev"), nxt.alias("has_next")).orderBy(*order_by(keys, False))


def capped_limit(limit: int | None, default: int = 50, most: int = 50, strict: bool = False) -> int:
    """None, 0 or too many give the most; strict raises for too many."""
    if limit is None:
        return default
    if limit < 0 or (strict and limit > most):
        raise ValueError(f"limit must be from 0 to {most}: {limit}")
    return most if limit == 0 or limit > most else limit


def checked_view(cursors: list[tuple | None]) -> int | None:
    """L4: the checkpoint that all cursors (checkpoint_viewed_at, key) agree on; ValueError if they don't."""
    seen = {c[0] for c in cursors if c is not None}
    if len(seen) > 1:
        raise ValueError("cursors of different checkpoints in one page")
    return next(iter(seen), None)


def by_gas_price(tx: DataFrame, price: str, order: list[str], commit: str | None = None) -> DataFrame:
    """Highest price first, rows without a price before all, stable by order; within each commit if one is named."""
    ranked = tx.withColumn("__p", F.coalesce(F.col(price).cast("decimal(20,0)"), F.lit(str(2**64 - 1)).cast("decimal(20,0)")))
    keys = ([F.asc(commit)] if commit else []) + [F.desc("__p"), *[F.asc(o) for o in order]]
    return ranked.orderBy(*keys).drop("__p")


def _with_edges(nodes: DataFrame, edges: DataFrame, group: str, node: str, depends_on: str) -> tuple[DataFrame, DataFrame]:
    """Edges (n, d) between nodes, with the groups g of n and h of d; and the nodes as n and g, each once."""
    at = nodes.select(F.col(node).alias("n"), F.col(group).alias("g")).distinct()
    known = edges.select(F.col(node).alias("n"), F.col(depends_on).alias("d")).distinct().join(at, "n")
    return known.join(at.select(F.col("n").alias("d"), F.col("g").alias("h")), "d"), at


def causal_order(nodes: DataFrame, edges: DataFrame, group: str, node: str = "tx", depends_on: str = "depends_on") -> DataFrame:
    """A deterministic order within each group (one checkpoint's transactions, so of bounded size), from 0.

    From the smallest node that is not yet out: its dependencies that are not out come first, largest first, each
    after its own. Edges to nodes outside the group are ignored. A cycle, which no ledger has, is cut where it closes.
    """
    known, at = _with_edges(nodes, edges, group, node, depends_on)
    kinds = dict(nodes.dtypes)
    rows = at.select("g", "n", F.lit(None).cast(kinds[node]).alias("d")).union(known.where("g = h").select("g", "n", "d"))

    def sort(t: pa.Table) -> pa.Table:
        deps: dict = {}
        for n, d in zip(t["n"].to_pylist(), t["d"].to_pylist(), strict=True):
            deps.setdefault(n, []).extend([] if d is None else [d])
        for d in deps.values():
            d.sort()
        out: list = []
        seen = set()
        for start in sorted(deps):
            stack = [start] if start not in seen else []
            seen.add(start)
            while stack:
                rest = deps[stack[-1]]
                while rest and rest[-1] in seen:
                    rest.pop()
                if rest:
                    seen.add(rest[-1])
                    stack.append(rest.pop())
                else:
                    out.append(stack.pop())
        return pa.table([pa.array([t["g"][0].as_py()] * len(out), t.schema.field("g").type), pa.array(out, t.schema.field("n").type), pa.array(range(len(out)), pa.int64())], names=[group, node, "position"])

    return rows.groupBy("g").applyInArrow(sort, f"{group} {kinds[group]}, {node} {kinds[node]}, position long")


def _longest(t: pa.Table) -> pa.Table:
    """n and depth: a group's longest paths, each node from its base on; a null depth is in a cycle or behind one."""
    depth: dict = {}
    behind: dict = {}
    waits: dict = {}
    for n, d, base in zip(t["n"].to_pylist(), t["d"].to_pylist(), t["base"].to_pylist(), strict=True):
        if d is None:
            depth[n] = base
        else:
            behind.setdefault(d, []).append(n)
            waits[n] = waits.get(n, 0) + 1
    ready = [n for n in depth if n not in waits]
    for n in ready:
        for m in behind.get(n, ()):
            depth[m] = max(depth[m], depth[n] + 1)
            waits[m] -= 1
            if not waits[m]:
                ready.append(m)
    left = {n for n, w in waits.items() if w}
    return pa.table([pa.array(list(depth), t.schema.field("n").type), pa.array([None if n in left else d for n, d in depth.items()], pa.int64())], names=["n", "depth"])


def dependency_depth(nodes: DataFrame, edges: DataFrame, group: str, node: str = "tx", depends_on: str = "depends_on") -> DataFrame:
    """The longest path of dependencies below each node; nodes without any have 0. Edges to unknown nodes are ignored.

    Two levels: the paths inside a group (a checkpoint, or so many of them as a task can hold) are solved by one task; then
    rounds go over the edges that cross groups, and only groups that such an edge lengthens are solved again. Their number
    is at most that of groups along a path, whatever a group's size. A node depends on its own group and earlier ones,
    as in a ledger: an edge to a later group and a cycle are a ValueError.
    """
    known, at = _with_edges(nodes, edges, group, node, depends_on)
    kind = dict(at.dtypes)["n"]
    known, at = materialize(known, "depth-edges"), materialize(at, "depth-nodes")
    if not known.where("g < h").isEmpty():
        raise ValueError("a node depends on one of a later group")
    inside, across = known.where("g = h").select("g", "n", "d"), known.where("g > h").select("n", "d")

    def solved(some: DataFrame) -> DataFrame:
        """some has n, g and base."""
        rows = some.select("g", "n", F.lit(None).cast(kind).alias("d"), "base").union(inside.join(some.select("g").distinct(), "g", "left_semi").select("g", "n", "d", F.lit(None).cast("long")))
        found = materialize(rows.groupBy("g").applyInArrow(_longest, f"n {kind}, depth long").join(some, "n"), "depths")
        if not found.where("depth is null").isEmpty():
            raise ValueError("the dependencies have a cycle")
        return found

    depths = changed = solved(at.withColumn("base", F.lit(0).cast("long")))
    while True:
        asked = across.join(changed.select(F.col("n").alias("d"), "depth"), "d").groupBy("n").agg((F.max("depth") + 1).alias("need"))
        longer = materialize(depths.select("n", "g", "depth", "base").join(asked, "n").where("need > depth"), "longer")
        if longer.isEmpty():
            return depths.select(F.col("n").alias(node), "depth")
        touched = longer.select("g").distinct()
        based = depths.join(touched, "g", "left_semi").join(longer.select("n", "need"), "n", "left").select("n", "g", F.greatest("base", "need").alias("base"), F.col("depth").alias("before"))
        again = solved(based)
        old, changed = depths, again.where("depth > before")
        depths = materialize(old.join(touched, "g", "left_anti").select("n", "g", "base", "depth").unionByName(again.select("n", "g", "base", "depth")), "depths")
        release(old, longer)


def array_page(rows: DataFrame, array: str, start: int, limit: int) -> DataFrame:
    """Positions [start, start + limit) of an array column, with has_prev and has_next."""
    return rows.withColumns({array: F.slice(F.col(array), start + 1, limit), "has_prev": F.lit(start > 0) & (F.size(array) > 0), "has_next": F.size(array) > start + limit})


def key_scan(rows: DataFrame, key: str, start, end=None, limit: int | None = None) -> DataFrame:
    """Keys from start up to an exclusive end, or so many of them."""
    found = rows.where(F.col(key) >= start) if end is None else rows.where((F.col(key) >= start) & (F.col(key) < end))
    return found.orderBy(key) if limit is None else found.orderBy(key).limit(limit)


def numbered_page(rows: DataFrame, key: str, size: int, number: int) -> DataFrame:
    """A page by number; rows before it are skipped by a top-k, so it is meant for small numbers."""
    return rows.orderBy(key).offset(size * number).limit(size)


def map_page(rows: DataFrame, names: str, first: int, after: str | None = None) -> DataFrame:
    """The first names of a map column past an exclusive cursor, with has_prev and has_next, one row a name."""
    keys = F.array_sort(F.map_keys(names))
    ahead = keys if after is None else F.filter(keys, lambda k: k > after)
    flagged = rows.withColumns({"__k": ahead, "has_next": F.size(ahead) > first, "has_prev": F.size(keys) > F.size(ahead)})
    return flagged.withColumn("name", F.explode(F.slice("__k", 1, first))).withColumn("value", F.col(names)[F.col("name")]).drop("__k", names)


def union_pages(parts: list[DataFrame]) -> DataFrame:
    """Lists of changes put together, repeats kept."""
    return reduce(lambda a, b: a.unionByName(b), parts)
