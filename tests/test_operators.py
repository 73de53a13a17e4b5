"""Goldens, edge cases and properties of the operators."""

import random
import tempfile

import pytest
from pyspark.sql import functions as F

from cairn.functions import scalars
from cairn.operators import filters, history, joins, metrics, paging, quality, series, stake, telemetry
from cairn.plans import schemas
from cairn.sources import checkpoints, shared, sinks
from cairn.streaming import streams


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_percentile_goldens(spark):
    data = [("a", x) for x in (1, 2, 3, 4)] + [("b", x) for x in (10, 20, 30, 40)]
    out = telemetry.exact_percentiles(spark.createDataFrame(data, "label string, point long"), "label", "point", (500, 900))
    assert rows(out) == [("a", 3, 4, 10, 4), ("b", 30, 40, 100, 4)]
    assert spark.range(1).select(telemetry.percentile_rank(F.lit(22), 999)).first()[0] == 21
    assert telemetry.percentile_label(999) == "99.9"


def test_scrape_goldens(spark):
    one = spark.createDataFrame([("a", 10, 100, 2.0, 0.0)], "scraper string, timestamp_s long, count long, sum double, squared_sum double")
    assert tuple(telemetry.scrape_aggregate(one).first()) == (10, 0.02, 0.0)
    two = spark.createDataFrame([("a", 10, 100, 50.0, 75.0)], one.schema)
    assert telemetry.scrape_aggregate(two).first()["stdev_latency"] == pytest.approx((0.75 - 0.25) ** 0.5)


def test_low_scores_of_equal_stakes(spark):
    committee = spark.createDataFrame([(i, 1250) for i in range(8)], "authority long, stake long")
    scores = spark.createDataFrame([(i, 100 * i) for i in range(8)], "authority long, score long")
    for percent, n in ((0, 0), (20, 1), (33, 2), (100, 8)):
        assert stake.low_scores(committee, scores, percent).count() == n


def test_votes_ignore_repeats(spark):
    committee = spark.createDataFrame([(1, 4000), (2, 3000), (3, 3000)], "authority long, stake long")
    votes = spark.createDataFrame([(7, 1, "x"), (7, 1, "x"), (7, 2, "x"), (7, 3, "y")], "item long, authority long, vote string")
    assert rows(stake.votes(votes, committee).select("vote", "authorities", "stake", "has_quorum", "has_validity")) == [("x", 2, 7000, True, True), ("y", 1, 3000, False, False)]


def test_validator_apy_cases(spark):
    rates = spark.createDataFrame([(1, 0, 1.0), (2, 0, 1.0), (2, 1, 0.5)], "pool_id long, epoch long, rate double")
    got = {r["pool_id"]: r["apy"] for r in stake.validator_apy(rates, 0).collect()}
    assert got[1] == 0 and got[2] != got[2]


def brute_objects_at(snapshot, log, match, lhs, rhs, consistent):
    found = {}
    for r in [r for r in snapshot if match(r)] + [r for r in log if lhs < r[3] <= rhs and match(r)]:
        if r[0] not in found or found[r[0]][1] < r[1]:
            found[r[0]] = r
    if consistent:
        found = {k: r for k, r in found.items() if not any(o[0] == k and o[1] > r[1] and lhs < o[3] <= rhs for o in log)}
    return sorted(found.values())


def test_objects_at_is_brute_force(spark):
    rng = random.Random(4)
    for consistent in (True, False):
        log, version = [], {}
        for cp in range(40):
            key = rng.randrange(6)
            version[key] = version.get(key, 0) + 1
            log.append((key, version[key], rng.randrange(3), cp))
        schema = "object_id long, object_version long, owner long, checkpoint_sequence_number long"
        df, lhs, rhs = spark.createDataFrame(log, schema), 15, 33
        snap = {}
        for r in log:
            if r[3] <= lhs:
                snap[r[0]] = r
        got = history.objects_at(spark.createDataFrame(list(snap.values()), schema), df, F.col("owner") == 1, lhs, rhs, consistent)
        assert rows(got) == brute_objects_at(list(snap.values()), log, lambda r: r[2] == 1, lhs, rhs, consistent)


def test_causal_order(spark):
    nodes = spark.createDataFrame([(1, x) for x in (1, 2, 3, 4, 5)] + [(2, 9)], "cp long, tx long")
    edges = spark.createDataFrame([(1, 4), (1, 3), (3, 5), (9, 1)], "tx long, depends_on long")
    got = {r["tx"]: r["position"] for r in paging.causal_order(nodes, edges, "cp").where("cp = 1").collect()}
    assert sorted(got, key=got.get) == [4, 5, 3, 1, 2]
    assert rows(paging.causal_order(nodes.orderBy(F.desc("tx")), edges.orderBy("depends_on"), "cp")) == rows(paging.causal_order(nodes, edges, "cp"))


def test_filters(spark):
    df = spark.createDataFrame([(1, "0x2::coin::Coin<A>"), (2, "0x2::coin::Coin"), (3, "0x2::coins::X"), (4, None)], "id long, t string")
    hit = lambda c: [r[0] for r in df.where(c).orderBy("id").collect()]
    assert hit(filters.match_all([])) == [1, 2, 3, 4] and hit(filters.match_any([])) == [] and hit(filters.match_none([])) == [1, 2, 3, 4]
    assert hit(filters.type_filter("t", "0x2::coin::Coin")) == [1, 2] and hit(filters.type_filter("t", "0x2::coin")) == [1, 2] and hit(filters.type_filter("t", "0x2::coin::Coin<A>")) == [1]
    assert filters.json_path("/a/0/b~1c") == "$['a'][0]['b/c']"
    for bad in ("", "0x2::", "a::b::c::d"):
        with pytest.raises(ValueError):
            filters.type_filter("t", bad)
    assert filters.intersect({"signer": 1}, {"signer": 2}) is filters.EMPTY
    names = spark.createDataFrame([("a.b",), ("-a.b",), ("a" * 64,), ("A.b",), ("",)], "d string")
    assert [r[0] for r in names.where(filters.valid_domain("d")).collect()] == ["a.b"]


def test_pages(spark):
    df = spark.range(10)
    page = paging.keyset_page(df, ["id"], 3, (6,))
    assert [tuple(r) for r in page.collect()] == [(7, False), (8, False), (9, False)]
    assert paging.capped_limit(None) == 50 and paging.capped_limit(0) == 50 and paging.capped_limit(7) == 7
    with pytest.raises(ValueError):
        paging.capped_limit(101, most=100, strict=True)
    with pytest.raises(ValueError):
        paging.checked_view([(1, 2), (3, 4)])
    assert [tuple(r) for r in paging.connection_page(df, ["id"], first=2, after=(4,)).collect()] == [(5, True, True), (6, True, True)]


def test_dependency_depth(spark):
    nodes, edges = spark.range(5).toDF("tx"), spark.createDataFrame([(1, 0), (2, 1), (3, 0), (3, 2)], "tx long, depends_on long")
    for width in (1, 2, 5):  # nodes of a group; however they are grouped
        grouped = nodes.withColumn("g", F.floor(F.col("tx") / width))
        assert rows(paging.dependency_depth(grouped, edges, "g")) == [(0, 0), (1, 1), (2, 2), (3, 3), (4, 0)]


def test_series(spark):
    df = spark.createDataFrame([(i, i % 3) for i in range(20)], "i long, v long")
    got = series.running_sums(df, ["i"], {"s": "v"}, F.floor(F.col("i") / 7))
    assert [r["s"] for r in got.orderBy("i").collect()] == [sum(x % 3 for x in range(i + 1)) for i in range(20)]
    prev = series.previous(df.where("i <> 7 and i <> 8"), "i", "i", "p", F.floor(F.col("i") / 7))
    assert [(r["i"], r["p"]) for r in prev.orderBy("i").collect()][6:9] == [(6, 5), (9, 6), (10, 9)]


def test_set_digest_is_order_free(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (1, "x")], "i long, t string")
    digest = lambda d: history.set_digest(d, ["i", "t"], []).first()["digest"]
    assert digest(a) == digest(a.orderBy(F.desc("i")).repartition(3)) != digest(a.distinct())
    added, removed = a, a.limit(1)
    live = history.set_digest(added, ["i", "t"], []).first()["digest"] - digest(removed)
    both = added.withColumn("s", F.lit(1)).unionByName(removed.withColumn("s", F.lit(-1)))
    assert history.set_digest(both, ["i", "t"], [], F.col("s")).first()["digest"] == live


def test_balance_changes_over_many_tasks(spark, monkeypatch):
    """More rows go over more tasks, in one exchange that join and sum share; a transaction that is listed twice counts once."""
    monkeypatch.setattr(history, "spread", lambda df, rows, *keys: shared.spread(df, rows, *keys, most=10))
    tx = spark.range(100).union(spark.range(10)).selectExpr("id as tx", "id % 5 > 0 as success", "id as gas_owner", "id % 7 as net_gas")
    cells = spark.range(300).selectExpr("id % 100 as tx", "id % 3 as owner", "'A' as coin_type", "id as balance", "id % 2 = 0 as skipped")
    got = history.balance_changes(tx, cells, cells.drop("skipped"), "M")
    sums = {}
    for i in range(300):
        if i % 100 % 5 > 0:
            sums[i % 100, i % 3] = sums.get((i % 100, i % 3), 0) + (i if i % 2 == 0 else 0)
    assert {(r["tx"], r["owner"]): int(r["amount"]) for r in got.where("coin_type = 'A'").collect()} == {k: v for k, v in sums.items() if v}
    plan = got._jdf.queryExecution().toString()
    assert plan.split("== Physical Plan ==")[1].count("REPARTITION_BY_NUM") >= 2 and "LeftSemi" not in plan


def test_balance_changes_cost_gas(spark):
    tx = spark.createDataFrame([(1, True, "a", 5), (2, False, "b", 7)], "tx long, success boolean, gas_owner string, net_gas long")
    inputs = spark.createDataFrame([(1, "a", "M", 100, False), (1, "z", "M", 9, True), (2, "b", "M", 50, False)], "tx long, owner string, coin_type string, balance long, skipped boolean")
    outputs = spark.createDataFrame([(1, "a", "M", 60), (1, "c", "M", 35), (2, "b", "M", 43)], "tx long, owner string, coin_type string, balance long")
    got = history.balance_changes(tx, inputs, outputs, "M")
    assert [(r[0], r[1], int(r[3])) for r in rows(got)] == [(1, "a", -40), (1, "c", 35), (2, "b", -7)]
    assert sum(int(r["amount"]) for r in got.where("tx = 1").collect()) == -5


def test_top_calls_ties_and_empty(spark):
    schema = "p string, epoch long"
    calls = spark.createDataFrame([("b", 5), ("a", 5), ("c", 1)], schema)
    assert [r["p"] for r in metrics.top_calls(calls, ["p"], days=(3,), k=2).orderBy("rank").collect()] == ["a", "b"]
    assert metrics.top_calls(spark.createDataFrame([], schema), ["p"]).count() == 0


def test_merge_seen_equals_whole(spark):
    df = spark.createDataFrame([("a", 5, 1), ("a", 5, 0), ("b", 2, 3), ("a", 9, 4), ("b", 2, 7)], "a string, t long, x long")
    seen = lambda d: metrics.first_last_seen(d, "a", "t", "x")
    assert rows(metrics.merge_seen(seen(df.where("x % 2 = 0")), seen(df.where("x % 2 = 1")))) == rows(seen(df)) == [("a", 0, 5, 4, 9), ("b", 3, 2, 3, 2)]


def test_archive_checks(spark):
    files = spark.createDataFrame([(0, 0, 10), (1, 10, 20), (2, 21, 30)], "epoch long, start long, end long")
    assert rows(quality.manifest_breaks(files).select("epoch", "expected")) == [(2, 20)]
    assert rows(quality.missing_epochs(spark.createDataFrame([(0,), (3,)], "epoch long"))) == [(1,), (2,)]
    assert quality.missing_epochs(spark.createDataFrame([], "epoch long")).count() == 0
    done = spark.createDataFrame([(i,) for i in (0, 1, 2, 3, 4, 5, 7, 8)], "seq long")
    assert quality.contiguous_watermark(done, 0, bucket=2).first()[0] == 6
    assert quality.contiguous_watermark(done, 6, bucket=2).first()[0] == 6


def test_scalars(spark):
    assert scalars.relative_time("now-30m 10s", 10_000) == 10_000 - 1810 and scalars.relative_time("now", 5) == 5
    with pytest.raises(ValueError):
        scalars.relative_time("now-xyz", 0)
    df = spark.createDataFrame([('{"a":{"b":"x"},"l":[1]}',)], "j string")
    r = lambda t: tuple(df.select(scalars.render_template(F.lit(t), F.col("j")).alias("r")).first()["r"])
    assert r("v={a.b} \\{ok\\}") == ("v=x {ok}", None) and r("{c}")[1] and r("{l}")[1] and r("{a.b")[1]
    assert spark.range(1).select(scalars.basis_points(F.lit(15), F.lit(5000))).first()[0] == 8


def test_reconcile_nulls(spark):
    a = spark.createDataFrame([(1, None), (2, "x"), (3, "y")], "k long, v string")
    b = spark.createDataFrame([(1, None), (2, "z"), (4, "y")], "k long, v string")
    assert rows(joins.reconcile(a, b, ["k"], ["v"])) == [(2, "different"), (3, "extra"), (4, "missing")]


def test_checkpoint_files_and_stream(spark):
    where = tempfile.mkdtemp(prefix="cairn-test-")
    for seq in (0, 1, 3):
        with open(f"{where}/{seq}.json", "w") as f:
            f.write('{"summary": {"sequence_number": %d, "epoch": 0, "timestamp_ms": 1, "digest": "d"}, "transactions": [{"digest": "t%d"}]}' % (seq, seq))
    got = checkpoints.read_checkpoint_files(spark, where, start=1)
    assert sorted(r["file_sequence"] for r in got.collect()) == [1, 3]
    assert rows(checkpoints.gap_rows(got, 1)) == [(3, 1)]
    out = tempfile.mkdtemp(prefix="cairn-test-")
    handlers = {"tx": lambda d: d.select(F.explode("transactions.digest").alias("digest"))}
    streams.flatten_stream(checkpoints.stream_checkpoint_files(spark, where, max_files=1), handlers, out, f"{out}/progress").awaitTermination()
    assert sorted(r["digest"] for r in spark.read.parquet(f"{out}/tx").collect()) == ["t0", "t1", "t3"]
    assert "transactions" in schemas.CHECKPOINT


def test_commit_batch_once(spark):
    out = tempfile.mkdtemp(prefix="cairn-test-")
    write = lambda n: sinks.commit_batch({"t": spark.range(n)}, {"t": f"{out}/t"}, f"{out}/m", 3)
    assert write(2) and not write(5) and spark.read.parquet(f"{out}/t").count() == 2


def test_dependency_cycle(spark):
    import pytest

    nodes, edges = spark.range(3).toDF("tx"), spark.createDataFrame([(0, 1), (1, 2), (2, 0)], "tx long, depends_on long")
    with pytest.raises(ValueError, match="cycle"):
        paging.dependency_depth(nodes.withColumn("g", F.lit(1)), edges, "g")
    with pytest.raises(ValueError, match="later"):
        paging.dependency_depth(nodes.withColumn("g", F.col("tx")), edges, "g")


def test_buckets_of_magnitude(spark):
    df = spark.createDataFrame([("a", v) for v in (-7, -7, 0, 3, 3, 3, 900, 2**40, None)] + [(None, 5), (None, 6)], "k string, v long")
    got = {(r["k"], r["v"]): (r["c"], r["upto"], r["n"]) for r in series.running_counts(df, ["k"], "v").collect()}
    assert got == {
        ("a", None): (1, 1, 9), ("a", -7): (2, 3, 9), ("a", 0): (1, 4, 9), ("a", 3): (3, 7, 9), ("a", 900): (1, 8, 9), ("a", 2**40): (1, 9, 9), (None, 5): (1, 1, 2), (None, 6): (1, 2, 2),
    }
    numbered = series.row_numbers(spark.range(-50, 200).selectExpr("id", "id % 2 AS k"), ["k"], ["id"], "i").collect()
    for k in {r["k"] for r in numbered}:
        own = sorted((r["id"], r["i"]) for r in numbered if r["k"] == k)
        assert [i for _, i in own] == list(range(len(own)))
    floats = spark.createDataFrame([(x,) for x in (float("nan"), -0.5, 0.25, 1e300, -1e300, float("inf"), None)], "v double")
    order = [r["v"] for r in floats.orderBy(series.magnitude(F.col("v"))).collect()]
    assert order[0] is None and order[1] == -1e300 and order[-2] == float("inf") and order[-1] != order[-1]


def test_asof_across_cuts(spark):
    versions = spark.createDataFrame([(1, v, f"v{v}") for v in (3, 5, 40, 41, 99)] + [(2, 7, "w")], "k long, version long, t string")
    asked = [(k, at) for k in (1, 2, 3) for at in (0, 3, 4, 30, 41, 98, 99, 1000)]
    requests = spark.createDataFrame(asked, "k long, at long")
    want = {(1, at): max((v for v in (3, 5, 40, 41, 99) if v <= at), default=None) for _, at in asked} | {(2, at): 7 if at >= 7 else None for _, at in asked} | {(3, at): None for _, at in asked}
    for width in (1, 10, 10_000):
        got = {(r["k"], r["at"]): r["version"] for r in joins.asof_version(requests, versions, "k", "at", "version", width).collect()}
        assert got == want, width


def test_latest_version_keeps_columns(spark):
    df = spark.createDataFrame([(1, 2, None), (1, 1, "x"), (2, None, "y")], "object_id long, object_version long, t string").select("t", "object_id", "object_version")
    got = history.latest_version(df)
    assert got.columns == df.columns and [tuple(r) for r in got.orderBy("object_id").collect()] == [(None, 1, 2), ("y", 2, None)]


def test_inputs_below_the_watermark(spark, tmp_path):
    import pytest

    path = str(tmp_path / "in")
    spark.range(10).selectExpr("id AS seq", "named_struct('sequence_number', id) AS summary").write.partitionBy("seq").json(path)
    read = lambda: sorted(r["file_sequence"] for r in checkpoints.read_checkpoint_files(spark, path).collect())
    assert read() == list(range(10))
    assert checkpoints.collect_inputs(path, spark.createDataFrame([(7,), (4,)], "watermark long"), str(tmp_path / "pruned")) == 4
    assert read() == [4, 5, 6, 7, 8, 9]
    assert checkpoints.collect_inputs(path, spark.createDataFrame([], "watermark long"), str(tmp_path / "pruned")) == 0
    assert checkpoints.read_complete(checkpoints.read_checkpoint_files(spark, path), 4).count() == 6
    with pytest.raises(ValueError):
        checkpoints.read_complete(checkpoints.read_checkpoint_files(spark, path), 3)


def test_nested_records_travel_once_and_narrow(spark, tmp_path):
    from cairn.plans.flatten_queries import checkpoint_records
    from cairn.plans.registry import Tables
    from cairn.sources.shared import spread

    t = Tables(spark, "/root/testdata/sf0.001")
    plan = checkpoint_records(t)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(seq") == plan.count("Exchange ") == 1, plan
    below = plan[plan.index("Exchange ") :]
    assert "CASE WHEN" not in below and "Aggregate" not in below  # what is nested from a line is nested above the exchange
    lines = [(128, 1, 2, 9), (128, 1, 2, 10), (128, 2, 3, 11), (129, 1, 4, 1), (None, 1, 1, 1)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_suppkey long, l_partkey long").selectExpr("*", "1.5D l_quantity", "'A' l_returnflag", "'O' l_linestatus").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(128, 7), (130, 7), (None, 7)], "o_orderkey long, o_custkey long").selectExpr("*", "'1-URGENT' o_orderpriority", "'O' o_orderstatus", "10.6D o_totalprice").write.parquet(f"{tmp_path}/orders.parquet")
    (row,) = checkpoint_records(Tables(spark, str(tmp_path))).collect()
    (tx,) = row["transactions"]  # orders without lines and lines without an order are none
    assert row["summary"]["sequence_number"] == 2 and row["summary"]["gas"]["computation"] == 11
    assert [i["object_id"] for i in tx["inputs"]] == ["10", "9", "11"] and tx["effects"]["created"] == ["10", "9"]  # by the id's text
    assert spread(spark.range(10), 1_000_001, "id", most=1000).rdd.getNumPartitions() == 1001


def test_a_page_orders_lines_of_equal_keys(spark):
    from cairn.plans import catalog

    assert "ORDER BY 1, 2, 3" in catalog.SQL["l3_composite_cursor"]
    rows = spark.range(0, 1000, 1, 8).select(F.lit(501).alias("k"), F.lit(1).alias("n"), (1000 - F.col("id")).alias("part"))
    page = paging.keyset_page(rows, ["k", "n"], 5, (500, 2), ties=["part"])
    assert [r["part"] for r in page.collect()] == [1, 2, 3, 4, 5]


def test_spread_by_rows_below_the_set_partitions(spark):
    """Rows that compress to nothing still go over the tasks that their number asks for, when more partitions are set than these."""
    from cairn.sources.shared import spread

    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "50")
    try:
        dealt = spread(spark.range(2000).withColumn("same", F.lit("x")), 2000, "id", most=100)
        sizes = [r["count"] for r in dealt.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sum(sizes) == 2000 and max(sizes) < 200


def test_records_nest_only_the_lists_that_are_read(spark):
    from cairn.plans import catalog
    from cairn.plans.flatten_queries import LISTS, checkpoint_records
    from cairn.plans.registry import Tables

    t = Tables(spark, "/root/testdata/sf0.001")
    assert [f.name for f in checkpoint_records(t).schema["transactions"].dataType.elementType][-6:] == list(LISTS)
    by_digest = lambda df, name: {r["tx"]["digest"]: r["tx"][name] for r in df.select(F.explode("transactions").alias("tx")).collect()}
    every = checkpoint_records(t)
    for name in LISTS:
        assert by_digest(checkpoint_records(t, name), name) == by_digest(every, name)
    for query, unread in {"p2_flatten_transaction": "md5(", "p3_command_counts": "md5(", "p13_flatten_package": "to_json", "p7_flatten_object": "to_json"}.items():
        plan = catalog.QUERIES[query](spark, t.sf_dir)._jdf.queryExecution().optimizedPlan().toString()
        assert unread not in plan, (query, plan)


def test_a_task_of_dependencies_is_bounded_by_transactions(spark, tmp_path, monkeypatch):
    """However many transactions a checkpoint has, no task solves more than so many of them."""
    from cairn.plans import query_queries as q
    from cairn.plans.catalog import QUERIES

    many = 2 * q.PER_TASK + 7
    spark.range(many).selectExpr("id event_id", "timestamp'2024-01-01 05:00:00' ts", "1L user_id", "'a' event_type", "1.0D value", "'{\"k\": 3}' props").write.parquet(f"{tmp_path}/events.parquet")
    monkeypatch.setattr(q.p, "dependency_depth", lambda nodes, edges, group: nodes.groupBy(group).count())
    assert sorted(r["count"] for r in QUERIES["l10_depth_across_checkpoints"](spark, str(tmp_path)).collect()) == [7, q.PER_TASK, q.PER_TASK]
