"""Telemetry, logs and benchmark runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.operators.series import row_numbers, running_counts, same_group


def percentile_rank(n: Column, per_mille) -> Column:
    """The 0-based index of a percentile in a sorted list of n."""
    return F.floor(n * per_mille / 1000).cast("long")


def percentile_label(per_mille: int) -> str:
    """999 is "99.9", 500 is "50"."""
    return f"{per_mille / 10:g}"


def exact_percentiles(samples: DataFrame, label: str, point: str, per_mille: tuple[int, ...] = (500, 950, 990), order_bits: int = 64) -> DataFrame:
    """For each label sorted[n * p / 1000] for each p, and sum and count.

    Equal points are counted first; ranks are running counts over distinct points, cut by magnitude in a hot label.
    """
    ranked = running_counts(samples, [label], point)
    hit = lambda p: F.min(F.when(F.col("upto") > F.least(percentile_rank(F.col("n"), p), F.col("n") - 1), F.col(point)))
    return ranked.groupBy(label).agg(*[hit(p).alias(f"p{percentile_label(p).replace('.', '_')}") for p in per_mille], F.sum(F.col(point) * F.col("c")).alias("sum"), F.sum("c").alias("count"))


def merged_stats(runs: DataFrame, by: list[str], latency: str, counters: list[str], percentiles: tuple[float, ...] = (0.5, 0.9, 0.99)) -> DataFrame:
    """Counters added up, and exact percentiles (between two neighbours in proportion), least and largest latency."""
    sums = runs.groupBy(*by).agg(*[F.sum(c).alias(c) for c in counters], F.min(latency).alias("min_latency"), F.max(latency).alias("max_latency"))
    ranked = running_counts(runs.where(F.col(latency).isNotNull()), by, latency)
    at = lambda rank: F.min(F.when(F.col("upto") > rank, F.col(latency))).cast("double")
    place = lambda p: (F.col("n") - 1) * p
    ends = [x for i, p in enumerate(percentiles) for x in (at(F.floor(place(p))).alias(f"__l{i}"), at(F.ceil(place(p))).alias(f"__h{i}"), F.max(place(p)).alias(f"__p{i}"))]
    low, high, pos = (lambda i, k=k: F.col(f"__{k}{i}") for k in "lhp")
    between = [F.when(low(i) == high(i), low(i)).otherwise((F.ceil(pos(i)) - pos(i)) * low(i) + (pos(i) - F.floor(pos(i))) * high(i)) for i in range(len(percentiles))]
    marks = ranked.groupBy(*by).agg(*ends).select(*by, F.array(*between).alias("percentiles"))
    out = sums.alias("x").join(marks.alias("y"), same_group("x", "y", by), "left").select("x.*", "y.percentiles")
    return out.select(*by, *counters, "percentiles", "min_latency", "max_latency")


def compare_runs(old: DataFrame, new: DataFrame, metric: str = "metric", value: str = "value", integers: tuple[str, ...] = ("tps", "error_rate")) -> DataFrame:
    """Difference, ratio and speedup of each metric, 1 + r for tps and 1 / (1 + r) for the others.

    Ratios are of the old value; those of ``integers`` are integer quotients. Null where the old value is 0.
    """
    both = old.select(metric, F.col(value).alias("old")).join(new.select(metric, F.col(value).alias("new")), metric)
    diff = F.col("new") - F.col("old")
    exact = F.when(F.col("old") != 0, diff / F.col("old"))
    ratio = F.when(F.col(metric).isin(*integers), F.when(exact >= 0, F.floor(exact)).otherwise(F.ceil(exact)).cast("double")).otherwise(exact)
    out = both.select(metric, "old", "new", diff.alias("diff"), ratio.alias("diff_ratio"))
    return out.withColumn("speedup", F.when(F.col(metric) == "tps", 1 + F.col("diff_ratio")).when(F.col("diff_ratio") != -1, 1 / (1 + F.col("diff_ratio"))))


def scrape_aggregate(scrapes: DataFrame, scraper: str = "scraper", ts: str = "timestamp_s") -> DataFrame:
    """Over the last sample of each scraper (count, sum, squared_sum): tps, average and deviation of latency, one row."""
    last = scrapes.groupBy(scraper).agg(F.max_by(F.struct(ts, "count", "sum", "squared_sum"), ts).alias("s")).select("s.*")
    mean = F.col("sum") / F.col("count")
    rows = last.where(F.col("count") > 0).select(ts, "count", mean.alias("mean"), F.sqrt(F.greatest(F.lit(0.0), F.col("squared_sum") / F.col("count") - mean * mean)).alias("dev"))
    duration = F.max(ts)
    return rows.agg(F.when(duration > 0, F.floor(F.sum("count") / duration)).otherwise(F.lit(0)).cast("long").alias("tps"), F.avg("mean").alias("avg_latency"), F.max("dev").alias("stdev_latency"))


def run_groups(runs: DataFrame, setup: list[str], values: list[str]) -> DataFrame:
    """Mean and sample deviation by setup, rounded; one run has deviation 0."""
    aggs = [x for v in values for x in (F.round(F.avg(v)).cast("long").alias(f"{v}_mean"), F.round(F.coalesce(F.stddev_samp(v), F.lit(0.0))).cast("long").alias(f"{v}_std"))]
    return runs.groupBy(*setup).agg(*aggs, F.count("*").alias("runs"))


def best_under_caps(runs: DataFrame, caps: tuple[int, ...], by: list[str], latency: str, tps: str) -> DataFrame:
    """For each cap on latency the best throughput of each number of nodes, in one aggregation."""
    best = runs.groupBy(*by).agg(*[F.max(F.when(F.col(latency) <= c, F.col(tps))).alias(f"c{c}") for c in caps])
    return best.select(*by, F.explode(F.array(*[F.struct(F.lit(c).alias("cap"), F.col(f"c{c}").alias("best_tps")) for c in caps])).alias("b")).select("b.cap", *by, "b.best_tps").where("best_tps is not null")


def latency_curve(runs: DataFrame, setup: list[str], rate: str, tps: str, latency: str) -> DataFrame:
    """(tps, latency) of a setup in the order of the rate, averaged where a rate ran more than once."""
    points = runs.groupBy(*setup, rate).agg(F.avg(tps).alias("tps"), F.avg(latency).alias("latency"))
    return points.groupBy(*setup).agg(F.transform(F.array_sort(F.collect_list(F.struct(rate, "tps", "latency"))), lambda p: F.struct(p["tps"].alias("tps"), p["latency"].alias("latency"))).alias("curve"))


def earliest(logs: DataFrame, key: str, ts: str) -> DataFrame:
    """The first time of each digest over all logs."""
    return logs.groupBy(key).agg(F.min(ts).alias(ts))


def throughput(commits: DataFrame, size: str, start: str, end: str, tx_size: int) -> DataFrame:
    """Bytes and transactions a second over the span of all commits, 0 for none."""
    seconds = (F.max(end) - F.min(start)) / 1000
    bps = F.when(seconds > 0, F.sum(size) / seconds).otherwise(F.lit(0.0))
    return commits.agg(bps.alias("bps"), (bps / tx_size).alias("tps"))


def log_fields(lines: DataFrame, patterns: dict[str, str], text: str = "value") -> DataFrame:
    """Lines that match a pattern, with its name, the leading time in milliseconds and its first two groups.

    A line is of the first pattern that matches it. Lines start with [YYYY-MM-DDTHH:MM:SS.mmmZ.
    """
    name = F.coalesce(*[F.when(F.col(text).rlike(p), n) for n, p in patterns.items()])
    stamp = F.unix_millis(F.try_to_timestamp(F.regexp_extract(text, r"\[([0-9-]+T[0-9:.]+Z)", 1)))
    group = lambda i: F.coalesce(*[F.when(F.col(text).rlike(p), F.regexp_extract(text, p, i) if _groups(p) >= i else F.lit(None).cast("string")) for p in patterns.values()])
    return lines.withColumn("event", name).where("event is not null").select("event", stamp.alias("ts_ms"), group(1).alias("first"), group(2).alias("second"))


def _groups(pattern: str) -> int:
    import re

    return re.compile(pattern).groups


def range_average(samples: DataFrame, ts: str, value: str, start: int, end: int, step: int) -> DataFrame:
    """The mean of the samples at start, start + step ... end; 0 for none."""
    hit = (F.col(ts) >= start) & (F.col(ts) <= end) & ((F.col(ts) - start) % step == 0)
    return samples.where(hit).agg(F.coalesce(F.avg(value), F.lit(0.0)).alias("average"))


def histograms_only(families: DataFrame, kind: str = "type", samples: str = "samples") -> DataFrame:
    """Histogram families with samples; samples is their number, or an array of them."""
    n = F.size(samples) if dict(families.dtypes)[samples].startswith("array") else F.col(samples)
    return families.where((F.col(kind) == "histogram") & (n > 0))


def with_labels(families: DataFrame, labels: dict[str, str], column: str = "labels") -> DataFrame:
    """Labels added to each family; an own label of the same name is replaced."""
    added = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])
    own = F.map_filter(F.coalesce(F.col(column), F.create_map().cast("map<string,string>")), lambda k, _: ~k.isin(*labels))
    return families.withColumn(column, F.map_concat(own, added))


def upper_median(values: DataFrame, oracle: str, ts: str, value: str, order: list[str], window: int, threshold: int, by: list[str]) -> DataFrame:
    """The upper median of the latest value of each oracle, of those within ``window`` of the newest; null below threshold."""
    latest = values.groupBy(*by, oracle).agg(F.max_by(F.struct(ts, value), F.struct(*order)).alias("v")).select(*by, f"v.{ts}", f"v.{value}")
    newest = latest.groupBy(*by).agg(F.max(ts).alias("__newest"))
    fresh = latest.join(newest, by).where(F.col(ts) > F.col("__newest") - window)
    ranked = running_counts(fresh.where(F.col(value).isNotNull()), by, value)
    middle = ranked.groupBy(*by).agg(F.min(F.when(F.col("upto") > F.floor(F.col("n") / 2), F.col(value))).alias("__m"))
    counted = fresh.groupBy(*by).agg(F.count("*").alias("oracles")).alias("x").join(middle.alias("y"), same_group("x", "y", by), "left").select("x.*", "y.__m")
    return counted.select(*by, "oracles", F.when(F.col("oracles") >= threshold, F.col("__m")).alias("median"))


def latest_values(submissions: DataFrame, ticker: str, seq: str, value: str, key: str | None = None) -> DataFrame:
    """The last value of each ticker, or with key of each (ticker, key) of the archive."""
    by = [ticker] + ([key] if key else [])
    return submissions.groupBy(*by).agg(F.max_by(value, seq).alias(value), F.max(seq).alias(seq))


def submission_numbers(submissions: DataFrame, ticker: str, order: list[str], few_tickers: bool = False) -> DataFrame:
    """0-based sequence numbers by ticker; of few tickers with very many submissions each if the first of order is a number."""
    if few_tickers:
        return row_numbers(submissions, [ticker], order, "sequence")
    return submissions.withColumn("sequence", F.row_number().over(Window.partitionBy(ticker).orderBy(*order)) - 1)
