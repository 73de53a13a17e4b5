"""Queries of stake, telemetry, quality and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.functions import scalars as sc
from cairn.operators import joins as j
from cairn.operators import quality as q
from cairn.operators import stake as s
from cairn.operators import telemetry as tel
from cairn.plans.registry import query

APYS = """r AS (SELECT pool_id, epoch, sqrt(rate) AS rate FROM fx_rate), n AS (SELECT *, lag(rate) OVER (PARTITION BY pool_id ORDER BY epoch DESC) AS nxt FROM r WHERE epoch >= 3),
  y AS (SELECT pool_id, epoch, pow(rate / nxt, 365.0::DOUBLE) - 1 AS apy FROM n WHERE nxt IS NOT NULL),
  k AS (SELECT * FROM y WHERE apy > 0 AND apy < 0.1 QUALIFY row_number() OVER (PARTITION BY pool_id ORDER BY epoch DESC) <= 30)"""


def slow_rates(t):
    """The rates of the view fall too fast for the yields that count; their square roots don't."""
    return t.fx_rate.withColumn("rate", F.sqrt("rate"))


@query("w8_consecutive_apys", f"WITH {APYS} SELECT pool_id, epoch, round(apy, 9) AS apy FROM k")
def _(t):
    return s.consecutive_apys(slow_rates(t), 3).withColumn("apy", F.round("apy", 9))


@query("a17_validator_apy", f"WITH {APYS} SELECT pool_id, round(coalesce(avg(apy), 'NaN'::DOUBLE), 9) AS apy, CAST(floor(avg(apy) * 10000) AS BIGINT) AS apy_bps FROM (SELECT DISTINCT pool_id FROM fx_rate) LEFT JOIN k USING (pool_id) GROUP BY 1")
def _(t):
    return s.validator_apy(slow_rates(t), 3).select("pool_id", F.round("apy", 9).alias("apy"), "apy_bps")


RATED = """a AS (SELECT st.*, coalesce(r.rate, 1.0) AS ra, coalesce(l.rate, 1.0) AS rl FROM fx_stake st LEFT JOIN fx_rate r ON r.pool_id = st.pool_id AND r.epoch = st.activation_epoch
  LEFT JOIN (SELECT pool_id, arg_max(rate, epoch) AS rate FROM fx_rate GROUP BY 1) l ON l.pool_id = st.pool_id),
  e AS (SELECT stake_id, owner, pool_id, principal, CASE WHEN activation_epoch <= 29 THEN 'Active' ELSE 'Pending' END AS status, greatest(activation_epoch - 1, 0) AS request_epoch,
  CASE WHEN activation_epoch <= 29 THEN greatest(0, CAST(floor((ra / rl - 1) * principal + 0.5) AS BIGINT)) END AS estimated_reward FROM a)"""


@query("j7_stake_rates", f"WITH {RATED} SELECT stake_id, ra AS activation_rate, rl AS latest_rate FROM a")
def _(t):
    return s.stakes_with_rates(t.fx_stake, t.fx_rate).select("stake_id", "activation_rate", "latest_rate")


@query("a18_delegated_stakes", f"WITH {RATED} SELECT * FROM e")
def _(t):
    return s.estimated_stakes(t.fx_stake, t.fx_rate, 29)


@query("a18_stakes_by_pool", f"WITH {RATED} SELECT owner, pool_id, count(*) AS stakes, string_agg(CAST(stake_id AS VARCHAR), ',' ORDER BY stake_id) AS ids, CAST(sum(principal) AS BIGINT) AS principal, CAST(coalesce(sum(estimated_reward), 0) AS BIGINT) AS reward FROM e GROUP BY 1, 2")
def _(t):
    """Each owner's stakes by pool."""
    pools = s.delegated_stakes(t.fx_stake, t.fx_rate, 29, ["owner", "pool_id"])
    total = lambda c: F.aggregate("stakes", F.lit(0).cast("long"), lambda a, x: a + F.coalesce(x[c], F.lit(0)))
    ids = F.array_join(F.transform("stakes", lambda x: x["stake_id"].cast("string")), ",")
    return pools.select("owner", "pool_id", F.size("stakes").cast("long").alias("stakes"), ids.alias("ids"), total("principal").alias("principal"), total("estimated_reward").alias("reward"))


@query("a19_sub_balances", f"""WITH {RATED} SELECT 'Stake' AS kind, CAST(coalesce(sum(principal) FILTER (status = 'Active'), 0) AS BIGINT) AS value FROM e
  UNION ALL SELECT 'PendingStake', CAST(coalesce(sum(principal) FILTER (status = 'Pending'), 0) AS BIGINT) FROM e UNION ALL SELECT 'EstimatedReward', CAST(coalesce(sum(estimated_reward), 0) AS BIGINT) FROM e""")
def _(t):
    return s.sub_balances(s.estimated_stakes(t.fx_stake, t.fx_rate, 29))


TALLY = "v AS (SELECT item, vote, count(*) AS authorities, CAST(sum(stake) AS BIGINT) AS stake FROM fx_vote JOIN fx_committee USING (authority) GROUP BY ALL), c AS (SELECT sum(stake) AS total FROM fx_committee)"


@query("a20_stake_votes", f"WITH {TALLY} SELECT item, vote, authorities, stake, stake * 10000 >= total * 6667 AS has_quorum, stake * 10000 >= total * 3334 AS has_validity FROM v, c")
def _(t):
    return s.votes(t.fx_vote, t.fx_committee)


@query("a21_plurality", f"""WITH {TALLY}, x AS (SELECT item, max(stake) AS plurality, CAST(sum(stake) AS BIGINT) AS voted FROM v WHERE vote = 'A' OR item % 2 = 0 GROUP BY 1)
  SELECT item, plurality, CAST(total - voted AS BIGINT) AS uncommitted, (total - voted + plurality) * 10000 < total * 6667 AS quorum_unreachable FROM x, c""")
def _(t):
    return s.plurality(s.votes(t.fx_vote.where("vote = 'A' or item % 2 = 0"), t.fx_committee), t.fx_committee)


@query("w9_low_scores", """WITH r AS (SELECT authority, stake, authority * 37 % 50 AS score FROM fx_committee), w AS (SELECT *, CAST(sum(stake) OVER (ORDER BY score, authority ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running_stake FROM r)
  SELECT authority, score, running_stake FROM w WHERE running_stake <= (SELECT CAST(sum(stake) AS BIGINT) * 20 // 100 FROM r)""")
def _(t):
    return s.low_scores(t.fx_committee, t.fx_committee.select("authority", (F.col("authority") * 37 % 50).alias("score")), 20)


@query("a26_exact_percentiles", """WITH r AS (SELECT label, point, row_number() OVER (PARTITION BY label ORDER BY point) - 1 AS i, count(*) OVER (PARTITION BY label) AS n FROM fx_sample)
  SELECT label, max(point) FILTER (i = n * 500 // 1000) AS p50, max(point) FILTER (i = n * 950 // 1000) AS p95, max(point) FILTER (i = n * 990 // 1000) AS p99, CAST(sum(point) AS BIGINT) AS sum, count(*) AS count FROM r GROUP BY label""")
def _(t):
    return tel.exact_percentiles(t.fx_sample, "label", "point")


@query("w12_percentile_rank", "SELECT label, count(*) * 999 // 1000 AS rank FROM fx_sample GROUP BY 1")
def _(t):
    return t.fx_sample.groupBy("label").agg(F.count("*").alias("n")).select("label", tel.percentile_rank(F.col("n"), 999).alias("rank"))


@query("a27_merged_stats", """SELECT setup, CAST(sum(tps) AS BIGINT) AS tps, quantile_cont(latency_ms, 0.5) AS p50, quantile_cont(latency_ms, 0.99) AS p99, min(latency_ms) AS min_latency, max(latency_ms) AS max_latency FROM fx_run GROUP BY 1""")
def _(t):
    out = tel.merged_stats(t.fx_run, ["setup"], "latency_ms", ["tps"], (0.5, 0.99))
    return out.select("setup", "tps", F.col("percentiles")[0].alias("p50"), F.col("percentiles")[1].alias("p99"), "min_latency", "max_latency")


@query("a28_compare_runs", """WITH m AS (SELECT nodes, CAST(round(avg(tps)) AS BIGINT) AS tps, CAST(round(avg(latency_ms)) AS BIGINT) AS latency FROM fx_run GROUP BY 1),
  o AS (SELECT 'tps' AS metric, tps AS v FROM m WHERE nodes = 1 UNION ALL SELECT 'latency', latency FROM m WHERE nodes = 1), n AS (SELECT 'tps' AS metric, tps AS v FROM m WHERE nodes = 2 UNION ALL SELECT 'latency', latency FROM m WHERE nodes = 2),
  c AS (SELECT metric, o.v AS old, n.v AS new, n.v - o.v AS diff, CASE WHEN metric = 'tps' THEN CAST(CAST(trunc((n.v - o.v) / o.v) AS BIGINT) AS DOUBLE) ELSE (n.v - o.v) / o.v END AS diff_ratio FROM o JOIN n USING (metric))
  SELECT *, CASE WHEN metric = 'tps' THEN 1 + diff_ratio ELSE 1 / (1 + diff_ratio) END AS speedup FROM c""")
def _(t):
    m = t.fx_run.groupBy("nodes").agg(F.round(F.avg("tps")).cast("long").alias("tps"), F.round(F.avg("latency_ms")).cast("long").alias("latency"))
    long = m.select("nodes", F.explode(F.array(F.struct(F.lit("tps").alias("metric"), F.col("tps").alias("value")), F.struct(F.lit("latency").alias("metric"), F.col("latency").alias("value")))).alias("x")).select("nodes", "x.*")
    return tel.compare_runs(long.where("nodes = 1"), long.where("nodes = 2"))


@query("a29_scrape_aggregate", """WITH l AS (SELECT user_id, arg_max(event_id, event_id) AS c, arg_max(CAST(floor(value) AS BIGINT), event_id) AS s, max(event_id) AS ts FROM events GROUP BY 1),
  m AS (SELECT ts, 1 + c % 50 AS count, CAST(s AS DOUBLE) AS sum, CAST(s * s AS DOUBLE) AS sq FROM l)
  SELECT CAST(floor(sum(count) / max(ts)) AS BIGINT) AS tps, round(avg(sum / count), 6) AS avg_latency, round(max(sqrt(greatest(0.0, sq / count - (sum / count) * (sum / count)))), 6) AS stdev_latency FROM m""")
def _(t):
    v = F.floor("value").cast("double")
    scrapes = t.events.select(F.col("user_id").alias("scraper"), F.col("event_id").alias("timestamp_s"), (1 + F.col("event_id") % 50).alias("count"), v.alias("sum"), (v * v).alias("squared_sum"))
    out = tel.scrape_aggregate(scrapes)
    return out.select("tps", F.round("avg_latency", 6).alias("avg_latency"), F.round("stdev_latency", 6).alias("stdev_latency"))


@query("a30_run_groups", """SELECT setup, nodes, CAST(round(avg(tps)) AS BIGINT) AS tps_mean, CAST(round(coalesce(stddev_samp(tps), 0)) AS BIGINT) AS tps_std, CAST(round(avg(latency_ms)) AS BIGINT) AS latency_ms_mean,
  CAST(round(coalesce(stddev_samp(latency_ms), 0)) AS BIGINT) AS latency_ms_std, count(*) AS runs FROM fx_run GROUP BY ALL""")
def _(t):
    return tel.run_groups(t.fx_run, ["setup", "nodes"], ["tps", "latency_ms"])


@query("a31_best_under_caps", "SELECT cap, nodes, max(tps) AS best_tps FROM fx_run, (VALUES (200), (500), (1000)) c(cap) WHERE latency_ms <= cap GROUP BY ALL")
def _(t):
    return tel.best_under_caps(t.fx_run, (200, 500, 1000), ["nodes"], "latency_ms", "tps")


@query("a32_latency_curve", """WITH p AS (SELECT setup, nodes, rate, round(avg(tps), 6) AS tps, round(avg(latency_ms), 6) AS latency FROM fx_run GROUP BY ALL)
  SELECT setup, nodes, list(tps ORDER BY rate) AS tps, list(latency ORDER BY rate) AS latency FROM p GROUP BY ALL""")
def _(t):
    c = tel.latency_curve(t.fx_run, ["setup", "nodes"], "rate", "tps", "latency_ms")
    part = lambda n: F.transform("curve", lambda p: F.round(p[n], 6))
    return c.select("setup", "nodes", part("tps").alias("tps"), part("latency").alias("latency"))


@query("a33_earliest", "SELECT o_custkey AS digest, min(o_orderkey) AS ts FROM orders GROUP BY 1")
def _(t):
    return tel.earliest(t.orders.select(F.col("o_custkey").alias("digest"), F.col("o_orderkey").alias("ts")), "digest", "ts")


@query("a34_throughput", "SELECT round(bps, 6) AS bps, round(bps / 512, 6) AS tps FROM (SELECT sum(l_quantity) / ((max(l_orderkey * 2 + l_linenumber) - min(l_orderkey)) / 1000) AS bps FROM lineitem)")
def _(t):
    rows = t.lineitem.select(F.col("l_quantity").alias("size"), F.col("l_orderkey").alias("start"), (F.col("l_orderkey") * 2 + F.col("l_linenumber")).alias("end"))
    return tel.throughput(rows, "size", "start", "end", 512).select(F.round("bps", 6).alias("bps"), F.round("tps", 6).alias("tps"))


@query("a35_log_fields", """SELECT event_type AS event, CAST(epoch_us(ts) // 1000 AS BIGINT) AS ts_ms, CAST(event_id AS VARCHAR) AS first, CASE WHEN event_type = 'click' THEN CAST(user_id AS VARCHAR) END AS second FROM events WHERE event_type IN ('click', 'view')""")
def _(t):
    line = F.concat(F.lit("["), F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("Z INFO] "), F.col("event_type"), F.lit(" B"), F.col("event_id").cast("string"), F.lit(" -> "), F.col("user_id").cast("string"))
    return tel.log_fields(t.events.select(line.alias("value")), {"click": r"click B(\d+) -> (\d+)", "view": r"view B(\d+)"})


@query("a36_range_average", "SELECT round(coalesce(avg(point), 0), 6) AS average FROM fx_sample WHERE ts_ms >= 1704067200000 AND ts_ms <= 1705067200000 AND (ts_ms - 1704067200000) % 3 = 0")
def _(t):
    return tel.range_average(t.fx_sample, "ts_ms", "point", 1_704_067_200_000, 1_705_067_200_000, 3).select(F.round("average", 6).alias("average"))


@query("j11_log_correlation", "SELECT l_partkey * 10 + l_linenumber AS sample, o_custkey + 100 - l_suppkey AS latency FROM (SELECT DISTINCT l_partkey, l_linenumber, l_suppkey, l_orderkey FROM lineitem) JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus <> 'P'")
def _(t):
    li = t.lineitem.select("l_partkey", "l_linenumber", "l_suppkey", "l_orderkey").distinct().withColumn("sample", F.concat_ws(":", "l_partkey", "l_linenumber", "l_suppkey", "l_orderkey"))
    commits = t.orders.where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("batch"), (F.col("o_custkey") + 100).alias("committed_at"))
    out = j.chain_latency(li.select("sample", F.col("l_suppkey").alias("sent_at")), li.select("sample", F.col("l_orderkey").alias("batch")), commits)
    key = F.split("sample", ":")
    return out.select((key[0].cast("long") * 10 + key[1].cast("long")).alias("sample"), "latency")


@query("j12_commit_latency", "SELECT o_orderkey AS digest, o_orderkey % 1000 + 5 - o_custkey AS latency FROM orders WHERE o_orderkey % 3 > 0")
def _(t):
    starts = t.orders.select(F.col("o_orderkey").alias("digest"), F.col("o_custkey").alias("proposed"))
    ends = t.orders.where("o_orderkey % 3 > 0").select(F.col("o_orderkey").alias("digest"), (F.col("o_orderkey") % 1000 + 5).alias("committed"))
    return j.latency(starts, ends, "digest", "proposed", "committed")


@query("a22_duplicate_summary", """WITH g AS (SELECT source, sha256(text) AS h, count(*) AS n, max(strlen(text)) AS size FROM documents GROUP BY ALL)
  SELECT CAST(sum(n) AS BIGINT) AS total_rows, CAST(sum(n - 1) AS BIGINT) AS duplicate_rows, CAST(sum(n * size) AS BIGINT) AS total_bytes, CAST(sum((n - 1) * size) AS BIGINT) AS duplicate_bytes FROM g""")
def _(t):
    return q.duplicate_summary(t.documents, "source", "text")


@query("s14_missing_epochs", "SELECT CAST(e AS BIGINT) AS epoch FROM range((SELECT max(epoch) FROM fx_epoch WHERE epoch % 4 <> 2)) r(e) WHERE e NOT IN (SELECT epoch FROM fx_epoch WHERE epoch % 4 <> 2)")
def _(t):
    return q.missing_epochs(t.fx_epoch.where("epoch % 4 <> 2"))


FILES = "SELECT epoch, first_checkpoint_id AS \"start\", last_checkpoint_id + CASE WHEN epoch % 9 = 4 THEN 2 ELSE 1 END AS \"end\" FROM fx_epoch"


@query("s15_manifest_breaks", f"""SELECT epoch, "start", expected FROM (SELECT *, coalesce(lag("end") OVER (ORDER BY "start"), 0) AS expected FROM ({FILES})) WHERE "start" <> expected""")
def _(t):
    files = t.fx_epoch.select("epoch", F.col("first_checkpoint_id").alias("start"), (F.col("last_checkpoint_id") + F.when(F.col("epoch") % 9 == 4, 2).otherwise(1)).alias("end"))
    return q.manifest_breaks(files).select("epoch", "start", "expected")


@query("s15_next_checkpoint", "SELECT min(first_checkpoint_id) AS checkpoint FROM fx_epoch WHERE epoch > 11")
def _(t):
    return q.next_checkpoint_after(t.fx_epoch, 11, "first_checkpoint_id")


@query("s16_checksum_failures", """SELECT doc_id AS file, CASE WHEN doc_id % 90 = 8 THEN 'missing' ELSE 'corrupt' END AS problem FROM documents WHERE doc_id % 90 = 8 OR doc_id % 70 = 3""")
def _(t):
    files = t.documents.where("doc_id % 90 <> 8").select(F.col("doc_id").alias("file"), F.col("text").cast("binary").alias("content"))
    manifest = t.documents.select(F.col("doc_id").alias("file"), F.when(F.col("doc_id") % 70 == 3, F.lit("0")).otherwise(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"))
    return q.checksum_failures(files, manifest)


@query("t3_contiguous_watermark", "SELECT min(o_orderkey) + 1 AS watermark FROM orders WHERE o_orderkey + 1 NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 411 <> 410) AND o_orderkey >= 5 AND o_orderkey % 411 <> 410")
def _(t):
    return q.contiguous_watermark(t.orders.where("o_orderkey % 411 <> 410").select(F.col("o_orderkey").alias("seq")), 5, bucket=100)


@query("t7_histogram_families", "SELECT event_type AS name, count(*) AS n FROM events WHERE user_id % 3 = 0 GROUP BY 1")
def _(t):
    kind = F.when(F.col("user_id") % 3 == 0, "histogram").otherwise("gauge")
    families = t.events.groupBy("user_id", F.col("event_type").alias("name"), kind.alias("type")).agg(F.count("value").alias("samples"))
    return tel.histograms_only(families).groupBy("name").agg(F.sum("samples").alias("n"))


@query("a24_upper_median", """WITH l AS (SELECT event_type AS ticker, user_id, arg_max(struct_pack(t := CAST(epoch_us(ts) // 1000 AS BIGINT), v := event_id), event_id) AS x FROM events GROUP BY ALL),
  f AS (SELECT ticker, x.t AS t, x.v AS v, max(x.t) OVER (PARTITION BY ticker) AS newest FROM l)
  SELECT ticker, count(*) AS oracles, CASE WHEN count(*) >= 20 THEN list_sort(list(v))[count(*) // 2 + 1] END AS median FROM f WHERE t > newest - 400000000 GROUP BY 1""")
def _(t):
    rows = t.events.select(F.col("event_type").alias("ticker"), "user_id", F.expr("unix_micros(CAST(ts AS TIMESTAMP)) div 1000").alias("t"), F.col("event_id").alias("v"))
    return tel.upper_median(rows, "user_id", "t", "v", ["v"], 400_000_000, 20, ["ticker"])


@query("a25_latest_values", "SELECT event_type AS ticker, user_id % 5 AS archive_key, arg_max(value, event_id) AS value, max(event_id) AS event_id FROM events GROUP BY ALL")
def _(t):
    return tel.latest_values(t.events.select(F.col("event_type").alias("ticker"), (F.col("user_id") % 5).alias("archive_key"), "value", "event_id"), "ticker", "event_id", "value", "archive_key")


@query("w11_submission_numbers", "SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS sequence FROM events")
def _(t):
    return tel.submission_numbers(t.events.select("event_id", "event_type"), "event_type", ["event_id"], few_tickers=True)


@query("w5_event_index", "SELECT l_orderkey, l_partkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS event_index FROM lineitem")
def _(t):
    out = tel.submission_numbers(t.lineitem, "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"])
    return out.select("l_orderkey", "l_partkey", "l_linenumber", F.col("sequence").alias("event_index"))


@query("x1_x2_x16_encodings", """SELECT doc_id, to_base64(encode(text)) AS b64, concat('0x', lpad(lower(to_hex(doc_id)), 64, '0')) AS address, sha256(text) AS digest FROM documents""")
def _(t):
    raw = F.col("text").cast("binary")
    b64 = F.regexp_replace(sc.base64_of(raw), "\r\n", "")
    return t.documents.select("doc_id", b64.alias("b64"), sc.canonical_address(F.concat(F.lit("0X"), F.hex("doc_id"))).alias("address"), F.sha2(raw, 256).alias("digest"))


@query("x3_bytes_to_base64", "SELECT o_orderkey, to_base64(unhex(concat(printf('%02x', o_orderkey % 256), printf('%02x', o_custkey % 256)))) AS b64 FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_orderkey, NULL FROM orders WHERE o_orderkey % 2 = 1")
def _(t):
    second = F.when(F.col("o_orderkey") % 2 == 1, 256).otherwise(F.col("o_custkey") % 256)
    json = F.concat(F.lit('{"a":{"b":['), (F.col("o_orderkey") % 256).cast("string"), F.lit(","), second.cast("string"), F.lit("]}}"))
    return t.orders.select("o_orderkey", sc.bytes_to_base64(json, "/a/b").alias("b64"))


B64 = "to_base64(unhex(concat(printf('%02x', {} % 256), printf('%02x', {} % 256))))"


@query("x3_bytes_anywhere", f"""SELECT o_orderkey, concat('{{{{"a":{{{{"b":"', {B64.format("o_orderkey", "o_custkey")}, '"}}}},"s":"[1,2] \\"[3]","n":["', {B64.format("o_custkey", "o_custkey")}, '",[300,', o_custkey % 7, ']],"e":"","m":[{{{{"x":"',
  {B64.format("o_custkey", "o_orderkey")}, '"}}}},[1,"y","', to_base64(unhex(printf('%02x', o_orderkey % 256))), '",-1,2.5,null]],"z":[["AAE="],[1,[true]]]}}}}') AS json FROM orders""".replace("{{{{", "{").replace("}}}}", "}").replace("{{", "{").replace("}}", "}"))
def _(t):
    """Arrays of bytes at any depth, inside strings, beside larger numbers, and empty ones."""
    n = lambda c: (F.col(c) % 256).cast("string")
    text = ['{"a":{"b":[', n("o_orderkey"), ", ", n("o_custkey"), ']},"s":"[1,2] \\"[3]","n":[[', n("o_custkey"), ",", n("o_custkey"), "],[300,", (F.col("o_custkey") % 7).cast("string"), ']],"e":[],"m":[{"x":[',
            n("o_custkey"), " ,", n("o_orderkey"), ']},[1,"y",[', n("o_orderkey"), '],-1,2.5,null]],"z":[[[0,1]],[1,[true]]]}']
    json = F.concat(*[F.lit(x) if isinstance(x, str) else x for x in text])
    return t.orders.select("o_orderkey", sc.byte_arrays_to_base64(json).alias("json"))


@query("x4_x5_x6_parsing", """SELECT tx_sequence_number, json_extract_string(parsed_json, '$.k') AS k, split_part(event_type, '::', 1) AS package, split_part(event_type, '::', 2) AS module, split_part(event_type, '::', 3) AS name,
  epoch_ms(timestamp_ms) AS at FROM fx_event""")
def _(t):
    tag = sc.struct_tag(F.col("event_type"))
    return t.fx_event.select("tx_sequence_number", sc.json_pointer(F.col("parsed_json"), "/k").alias("k"), tag["package"].alias("package"), tag["module"].alias("module"), tag["name"].alias("name"), sc.ms_to_timestamp(F.col("timestamp_ms")).cast("timestamp_ntz").alias("at"))


@query("x7_display_template", """SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN concat('{', o_custkey, '} by ', o_clerk) END AS text, CASE WHEN o_orderkey % 5 = 0 THEN 'missing field a.b' END AS error
  FROM (SELECT o_orderkey, o_custkey, o_orderpriority AS o_clerk FROM orders)""")
def _(t):
    nested = F.when(F.col("o_orderkey") % 5 != 0, F.struct(F.col("o_custkey").alias("b")))
    out = sc.render_template(F.lit(r"\{{a.b}\} by {c}"), F.to_json(F.struct(nested.alias("a"), F.col("o_orderpriority").alias("c"))))
    return t.orders.select("o_orderkey", out.alias("r")).select("o_orderkey", "r.text", "r.error")


@query("x8_relative_time", "SELECT event_id FROM events WHERE CAST(epoch_us(ts) // 1000000 AS BIGINT) >= (SELECT max(CAST(epoch_us(ts) // 1000000 AS BIGINT)) - 36 * 3600 - 1800 FROM events)")
def _(t):
    at = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000)
    now = t.events.agg(F.max(at)).first()[0]
    return t.events.where(at >= sc.relative_time("now-36h 30m", now)).select("event_id")


@query("x12_power_round_root", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(pow(l_discount + 1, 3), 9) AS cubed, CAST(round(l_extendedprice) AS BIGINT) AS price, round(sqrt(l_quantity), 9) AS root FROM lineitem")
def _(t):
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(sc.power(F.col("l_discount") + 1, 3), 9).alias("cubed"), sc.rounded(F.col("l_extendedprice")).alias("price"), F.round(sc.root(F.col("l_quantity")), 9).alias("root"),
    )


@query("x10_x11_x18_integers", """SELECT o_orderkey, CAST(CAST(o_orderkey AS HUGEINT) * o_custkey // 7 AS DECIMAL(38,0)) AS mul_div, greatest(o_orderkey - o_custkey * 10, 0) AS saturated, CAST((CAST(o_custkey AS HUGEINT) * 9900 + 5000) // 10000 AS DECIMAL(38,0)) AS rebate FROM orders""")
def _(t):
    return t.orders.select(
        "o_orderkey", s.mul_div(F.col("o_orderkey"), F.col("o_custkey"), F.lit(7)).alias("mul_div"), sc.saturating_sub(F.col("o_orderkey"), F.col("o_custkey") * 10).alias("saturated"),
        sc.basis_points(F.col("o_custkey"), F.lit(9900)).alias("rebate"),
    )


@query("x13_array_functions", """SELECT o_custkey, list_sort(list(DISTINCT o_orderpriority)) AS priorities, array_to_string(list_sort(list(DISTINCT o_orderpriority)), '-') AS joined, count(DISTINCT o_orderpriority) AS n FROM orders GROUP BY 1""")
def _(t):
    got = F.array_sort(F.array_distinct(F.collect_list("o_orderpriority")))
    return t.orders.groupBy("o_custkey").agg(got.alias("priorities")).select("o_custkey", "priorities", F.array_join("priorities", "-").alias("joined"), F.size("priorities").cast("long").alias("n"))


@query("x14_label_append", "SELECT event_id, 'main' AS network, event_type AS kind, 'h1' AS host FROM events")
def _(t):
    rows = t.events.select("event_id", F.create_map(F.lit("kind"), F.col("event_type"), F.lit("network"), F.lit("own")).alias("labels"))
    m = F.col("labels")
    return tel.with_labels(rows, {"network": "main", "host": "h1"}).select("event_id", m["network"].alias("network"), m["kind"].alias("kind"), m["host"].alias("host"))


@query("x15_file_names", "SELECT o_orderkey AS number, o_custkey AS epoch FROM orders")
def _(t):
    path = F.concat(F.lit("s3://b/epoch_"), F.col("o_custkey").cast("string"), F.lit("/"), F.col("o_orderkey").cast("string"), F.lit(".chk"))
    return t.orders.select(path.alias("p")).select(sc.file_number(F.col("p")).alias("number"), sc.path_epoch(F.col("p")).alias("epoch"))


@query("x17_log_time", "SELECT event_id, CAST(epoch_us(ts) // 1000 AS BIGINT) AS ts_ms FROM events")
def _(t):
    line = F.concat(F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("Z INFO started"))
    return t.events.select("event_id", sc.log_time(line).alias("ts_ms"))
