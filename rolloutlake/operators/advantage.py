"""Advantage and return estimators over prompt groups, as window expressions.

A rollout table has one row per rollout: a group key (the prompt), an order key that makes ties and "first"
well defined, and a score. Every estimator takes and returns a DataFrame and keeps all input columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Guard of divisions by a group's standard deviation, as the estimators define it.
EPSILON = 1e-6

Estimator = Callable[..., DataFrame]
_ESTIMATORS: dict[str, Estimator] = {}


def register(name: str) -> Callable[[Estimator], Estimator]:
    """Register an estimator; another function under a taken name is an error."""

    def keep(fn: Estimator) -> Estimator:
        if _ESTIMATORS.get(name, fn) is not fn:
            raise ValueError(f"advantage estimator {name!r} is already registered")
        _ESTIMATORS[name] = fn
        return fn

    return keep


def estimator(name: str) -> Estimator:
    """The estimator of that (case-sensitive) name; ValueError when unknown."""
    if name not in _ESTIMATORS:
        raise ValueError(f"unknown advantage estimator {name!r}; known: {', '.join(sorted(_ESTIMATORS))}")
    return _ESTIMATORS[name]


def estimator_names() -> list[str]:
    return sorted(_ESTIMATORS)


def advantage(df: DataFrame, name: str, **options) -> DataFrame:
    """Dispatch to a registered estimator."""
    return estimator(name)(df, **options)


def confidence_weight(confidence: Column) -> Column:
    """exp(c - 1): 1 at full confidence."""
    return F.exp(confidence - F.lit(1.0))


def with_group_stats(df: DataFrame, group: str, **stats: Column) -> DataFrame:
    """Rows with aggregates of their group.

    Aggregates are summed up before the shuffle and joined back, so a prompt with a third of all rows is never sorted
    into one task: its rows stay where they are when the groups are few, and adaptive skew handling splits them
    otherwise. A null group is a group of its own.
    """
    sums = df.groupBy(F.col(group).alias("_key")).agg(*[c.alias(n) for n, c in stats.items()])
    return df.join(sums, F.col(group).eqNullSafe(F.col("_key"))).drop("_key")


@register("grpo")
def grpo(df: DataFrame, group="prompt_id", score="score", by_std: bool = True, confidence: str | None = None, out="advantage") -> DataFrame:
    """(score - group mean) / (sample std + 1e-6); a lone rollout has mean 0 and std 1. by_std=False keeps the difference."""
    rows = with_group_stats(df, group, _n=F.count(F.lit(1)), _mean=F.avg(score), _std=F.stddev_samp(score))
    lone = F.col("_n") == 1
    value = F.col(score) - F.when(lone, F.lit(0.0)).otherwise(F.col("_mean"))
    if by_std:
        value = value / (F.when(lone, F.lit(1.0)).otherwise(F.col("_std")) + F.lit(EPSILON))
    if confidence is not None:
        value = value * confidence_weight(F.col(confidence))
    return rows.withColumn(out, value).drop("_n", "_mean", "_std")


@register("grpo_passk")
def grpo_passk(df: DataFrame, group="prompt_id", order="rollout_idx", score="score", by_std: bool = True, out="advantage") -> DataFrame:
    """Only the best rollout gets (best - second best) [/ (sample std + 1e-6)]; groups of one are an error."""
    place = F.struct(F.col(score).alias("s"), (-F.col(order)).alias("o"))
    best = with_group_stats(df, group, _n=F.count(F.lit(1)), _std=F.stddev_samp(score), _best=F.max(place)).withColumn("_is", place == F.col("_best"))
    rows = with_group_stats(best, group, _second=F.max(F.when(~F.col("_is"), F.col(score))))
    gap = F.col("_best.s") - F.col("_second")
    if by_std:
        gap = gap / (F.col("_std") + F.lit(EPSILON))
    value = F.when(F.col("_n") < 2, F.raise_error(F.lit("pass@k advantage needs groups of two or more")).cast("double")).when(F.col("_is"), gap).otherwise(F.lit(0.0))
    return rows.withColumn(out, value).drop("_n", "_std", "_best", "_is", "_second")


@register("rloo")
def rloo(df: DataFrame, group="prompt_id", score="score", out="advantage") -> DataFrame:
    """Leave-one-out baseline: s*n/(n-1) - mean*n/(n-1); a lone rollout keeps its score."""
    rows = with_group_stats(df, group, _n=F.count(F.lit(1)), _mean=F.avg(score))
    ratio = F.col("_n") / (F.col("_n") - 1)
    return rows.withColumn(out, F.when(F.col("_n") > 1, (F.col(score) - F.col("_mean")) * ratio).otherwise(F.col(score))).drop("_n", "_mean")


@register("opo")
def opo(df: DataFrame, group="prompt_id", score="score", length="length", out="advantage") -> DataFrame:
    """Length-weighted group baseline; a lone rollout's baseline is 0."""
    rows = with_group_stats(df, group, _n=F.count(F.lit(1)), _ls=F.sum(F.col(length) * F.col(score)), _l=F.sum(length))
    return rows.withColumn(out, F.col(score) - F.when(F.col("_n") > 1, F.col("_ls") / F.col("_l")).otherwise(F.lit(0.0))).drop("_n", "_ls", "_l")


@register("remax")
def remax(df: DataFrame, sequence="prompt_id", order="rollout_idx", reward="score", baseline: str | None = None, out="advantage") -> DataFrame:
    """Reverse cumulative reward of a sequence less a baseline column (0 when none)."""
    w = Window.partitionBy(sequence).orderBy(order).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    value = F.sum(reward).over(w)
    return df.withColumn(out, value - F.col(baseline) if baseline else value)


@register("reinforce_plus_plus_baseline")
def reinforce_plus_plus_baseline(df: DataFrame, group="prompt_id", score="score", out="advantage") -> DataFrame:
    """Score less the group mean (0 for a lone rollout), whitened over the whole table.

    The table's mean and variance come from one partial aggregate; the one-row result is broadcast.
    """
    rows = with_group_stats(df, group, _n=F.count(F.lit(1)), _mean=F.avg(score))
    centred = rows.withColumn("_c", F.when(F.col("_n") > 1, F.col(score) - F.col("_mean")).otherwise(F.lit(0.0))).drop("_n", "_mean")
    stats = centred.agg(F.avg("_c").alias("_mu"), F.var_samp("_c").alias("_var"))
    return centred.crossJoin(F.broadcast(stats)).withColumn(out, (F.col("_c") - F.col("_mu")) / F.sqrt(F.col("_var") + F.lit(1e-8))).drop("_c", "_mu", "_var")


@register("sppo")
def sppo(df: DataFrame, batch="prompt_id", score="score", beta: float = 1.0, out="advantage") -> DataFrame:
    """Score less the soft mean (logsumexp(beta x) - log n) / beta of its batch; the plain mean when beta is 0."""
    if beta == 0:
        return with_group_stats(df, batch, _mean=F.avg(score)).withColumn(out, F.col(score) - F.col("_mean")).drop("_mean")
    peaked = with_group_stats(df, batch, _peak=F.max(F.col(score) * F.lit(beta)), _n=F.count(score))
    rows = with_group_stats(peaked, batch, _sum=F.sum(F.exp(F.col(score) * F.lit(beta) - F.col("_peak"))))
    soft = (F.log("_sum") + F.col("_peak") - F.log(F.col("_n").cast("double"))) / F.lit(beta)
    return rows.withColumn(out, F.col(score) - soft).drop("_peak", "_n", "_sum")
