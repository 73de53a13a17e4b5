"""Stake and committee analytics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.operators.series import magnitude, running_sums

QUORUM, VALIDITY, TOTAL = 6_667, 3_334, 10_000
EPOCHS_A_YEAR = 365


def consecutive_apys(rates: DataFrame, start_epoch: int, pool: str = "pool_id", epoch: str = "epoch", rate: str = "rate", newest: int = 30) -> DataFrame:
    """Yields of adjacent rates, (rate / next rate) ^ 365 - 1, from start_epoch on; those in (0, 0.1), the newest ones."""
    w = Window.partitionBy(pool).orderBy(F.desc(epoch))
    apys = rates.where(F.col(epoch) >= start_epoch).withColumn("__next", F.lag(rate).over(w)).where("__next is not null")
    apys = apys.select(pool, epoch, (F.pow(F.col(rate) / F.col("__next"), F.lit(float(EPOCHS_A_YEAR))) - 1).alias("apy")).where("apy > 0 and apy < 0.1")
    return apys.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= newest).drop("__r")


def validator_apy(rates: DataFrame, start_epoch: int, pool: str = "pool_id", epoch: str = "epoch", rate: str = "rate") -> DataFrame:
    """The mean of W8; fewer than two rates give 0, none left gives NaN; apy_bps is truncated to basis points."""
    counts = rates.where(F.col(epoch) >= start_epoch).groupBy(pool).agg(F.count("*").alias("__n"))
    means = consecutive_apys(rates, start_epoch, pool, epoch, rate).groupBy(pool).agg(F.avg("apy").alias("__m"))
    apy = F.when(F.coalesce(F.col("__n"), F.lit(0)) < 2, F.lit(0.0)).otherwise(F.coalesce("__m", F.lit(float("nan"))))
    joined = rates.select(pool).distinct().join(counts, pool, "left").join(means, pool, "left").select(pool, apy.alias("apy"))
    return joined.withColumn("apy_bps", F.when(~F.isnan("apy"), F.floor(F.col("apy") * 10_000).cast("long")))


def stakes_with_rates(stakes: DataFrame, rates: DataFrame, pool: str = "pool_id") -> DataFrame:
    """Stakes with the rate of their activation epoch and the pool's latest one; a missing rate is 1."""
    latest = rates.groupBy(pool).agg(F.max_by("rate", "epoch").alias("latest_rate"))
    at = rates.select(pool, F.col("epoch").alias("activation_epoch"), F.col("rate").alias("activation_rate"))
    one = F.lit(1.0)
    joined = stakes.join(at, [pool, "activation_epoch"], "left").join(latest, pool, "left")
    return joined.withColumns({"activation_rate": F.coalesce("activation_rate", one), "latest_rate": F.coalesce("latest_rate", one)})


def estimated_stakes(stakes: DataFrame, rates: DataFrame, current_epoch: int) -> DataFrame:
    """A18, one row a stake: status, the epoch it was asked for, and for active ones the reward, rounded half up, 0 at least."""
    joined = stakes_with_rates(stakes, rates)
    active = F.col("activation_epoch") <= current_epoch
    reward = F.greatest(F.lit(0), F.floor((F.col("activation_rate") / F.col("latest_rate") - 1) * F.col("principal") + 0.5).cast("long"))
    return joined.select(
        *[c for c in stakes.columns if c != "activation_epoch"], F.when(active, "Active").otherwise("Pending").alias("status"),
        F.greatest(F.col("activation_epoch") - 1, F.lit(0)).alias("request_epoch"), F.when(active, reward).alias("estimated_reward"),
    )


def delegated_stakes(stakes: DataFrame, rates: DataFrame, current_epoch: int, keys: list[str]) -> DataFrame:
    """An owner's stakes by pool; keys say whose, so that an array holds one owner's stakes only."""
    rows = estimated_stakes(stakes, rates, current_epoch)
    return rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("stake_id", "principal", "status", "request_epoch", "estimated_reward"))).alias("stakes"))


def sub_balances(estimated: DataFrame) -> DataFrame:
    """Sums of stake, pending stake and estimated reward; each has a row, 0 where there is none."""
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("value")) for k, v in (
        ("Stake", F.when(F.col("status") == "Active", F.col("principal"))), ("PendingStake", F.when(F.col("status") == "Pending", F.col("principal"))), ("EstimatedReward", F.col("estimated_reward")),
    )]))
    sums = estimated.select(kinds.alias("k")).groupBy("k.kind").agg(F.sum("k.value").alias("value"))
    every = estimated.sparkSession.createDataFrame([("Stake",), ("PendingStake",), ("EstimatedReward",)], "kind string")
    return every.join(sums, "kind", "left").select("kind", F.coalesce("value", F.lit(0)).cast("long").alias("value"))


def votes(votes: DataFrame, committee: DataFrame, item: str = "item", value: str = "vote", authority: str = "authority", stake: str = "stake") -> DataFrame:
    """Stake of distinct authorities for each value of an item, and whether it makes quorum or validity of 10,000."""
    total = committee.agg(F.sum(stake).alias("__total"))
    sums = votes.dropDuplicates([item, value, authority]).join(committee, authority).groupBy(item, value).agg(F.count("*").alias("authorities"), F.sum(stake).alias("stake"))
    share = F.col("stake") * TOTAL
    return sums.crossJoin(F.broadcast(total)).withColumns({"has_quorum": share >= F.col("__total") * QUORUM, "has_validity": share >= F.col("__total") * VALIDITY}).drop("__total")


def plurality(tally: DataFrame, committee: DataFrame, item: str = "item", stake: str = "stake") -> DataFrame:
    """For each item the largest stake, what has not voted, and whether quorum is out of reach. An authority votes once an item."""
    total = committee.agg(F.sum(stake).alias("total"))
    top = tally.groupBy(item).agg(F.max("stake").alias("plurality"), F.sum("stake").alias("voted")).crossJoin(F.broadcast(total))
    left = F.col("total") - F.col("voted")
    return top.select(item, "plurality", left.alias("uncommitted"), ((left + F.col("plurality")) * TOTAL < F.col("total") * QUORUM).alias("quorum_unreachable"))


def low_scores(committee: DataFrame, scores: DataFrame, percent: int, authority: str = "authority", stake: str = "stake", score: str = "score") -> DataFrame:
    """Authorities from the lowest score up while their running stake is at most percent of the total, in integers.

    Ties of scores go by authority.
    """
    rows = committee.join(scores, authority)
    total = F.broadcast(rows.agg(F.sum(stake).alias("__total")))  # one row
    return running_sums(rows, [score, authority], {"running_stake": stake}, magnitude(F.col(score))).crossJoin(total).where(F.col("running_stake") <= F.floor(F.col("__total") * percent / 100)).select(authority, score, "running_stake")


def mul_div(x: Column, y: Column, z: Column) -> Column:
    """X * y / z in wide integers, rounded down."""
    return F.floor(x.cast("decimal(19,0)") * y.cast("decimal(19,0)") / z.cast("decimal(19,0)")).cast("decimal(38,0)")
