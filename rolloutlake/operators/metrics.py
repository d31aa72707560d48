"""Validation, reward and run metrics: two-level aggregates, closed forms and bootstraps."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def best_and_worst(df: DataFrame, groups: list[str], value: str, k: int) -> DataFrame:
    """(groups, best, worst): expected maximum and minimum of k draws with replacement, in closed form. Nulls do not count.

    Equal values are counted before anything is ordered, so a hot group is as long as the number of its different values;
    both ends come from one order.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(*groups, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_m"))
    w = Window.partitionBy(*groups)
    run = counted.withColumn("_c", F.sum("_m").over(w.orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)))
    share = lambda c: F.pow(c / F.col("_n"), F.lit(k))
    rows = run.withColumn("_n", F.sum("_m").over(w.orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    below = F.col("_c") - F.col("_m")
    best = F.col("_v") * (share(F.col("_c")) - share(below))
    worst = F.col("_v") * (share(F.col("_n") - below) - share(F.col("_n") - F.col("_c")))
    return rows.groupBy(*groups).agg(F.sum(best).alias("best"), F.sum(worst).alias("worst"))


def best_at_k(df: DataFrame, group: str, value: str, k: int, worst: bool = False, out: str = "best_at_k") -> DataFrame:
    """Expected maximum (or minimum) of k draws with replacement."""
    return best_and_worst(df, [group], value, k).select(group, F.col("worst" if worst else "best").alias(out))


def k_list(n: int) -> list[int]:
    """2, 4, 8, ... below n, then n."""
    out, k = [], 2
    while k < n:
        out.append(k)
        k *= 2
    return [*out, n] if n > 1 else []


def bootstrap(values: np.ndarray, subset: int, reducers, n_bootstrap: int = 1000, seed: int = 42) -> list[tuple[float, float]]:
    """(mean, population std) of each reducer over resamples with replacement, from the legacy seeded stream."""
    if not len(values):
        raise ValueError("nothing to resample")
    rng = np.random.RandomState(seed)
    drawn = [[f(values[rng.choice(len(values), size=subset, replace=True)]) for f in reducers] for _ in range(n_bootstrap)] if len(reducers) == 1 else None
    if drawn is None:
        drawn = []
        for _ in range(n_bootstrap):
            pick = values[rng.choice(len(values), size=subset, replace=True)]
            drawn.append([f(pick) for f in reducers])
    table = np.array(drawn)
    return [(float(table[:, j].mean()), float(table[:, j].std())) for j in range(len(reducers))]


#: Most rows of a group that is resampled in one task.
MOST_RESAMPLED = 1_000_000


def bootstrap_groups(df: DataFrame, group: str, order: str, value: str, subset: int, n_bootstrap: int = 1000, seed: int = 42) -> DataFrame:
    """Bootstrap of max and min per group (the rollouts of one prompt); groups of more than MOST_RESAMPLED rows are refused."""
    kind = df.schema[group].dataType.simpleString()

    def run(key, part: pd.DataFrame) -> pd.DataFrame:
        if len(part) > MOST_RESAMPLED:
            raise ValueError("group too large to resample")
        values = part.sort_values(order)[value].to_numpy(float)
        (bm, bs), (wm, ws) = bootstrap(values, subset, (np.max, np.min), n_bootstrap, seed)
        return pd.DataFrame([(key[0], bm, bs, wm, ws)], columns=[group, "best_mean", "best_std", "worst_mean", "worst_std"])

    return df.select(group, order, value).groupBy(group).applyInPandas(run, f"{group} {kind}, best_mean double, best_std double, worst_mean double, worst_std double")


def validation_metrics(df: DataFrame, source: str, prompt: str, value: str, k: int) -> DataFrame:
    """Long table (data_source, metric, value): mean@n, population std@n, best@k and worst@k per prompt, then averaged over the prompts of a source."""
    base = df.groupBy(source, prompt).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))
    per_prompt = base.join(best_and_worst(df, [source, prompt], value, k), [source, prompt])
    wide = per_prompt.groupBy(source).agg(*[F.avg(c).alias(c) for c in ("mean", "std", "best", "worst")])
    names = {"mean": "mean@n", "std": "std@n", "best": f"best@{k}/mean", "worst": f"worst@{k}/mean"}
    pairs = F.array(*[F.struct(F.lit(label).alias("metric"), F.col(c).alias("value")) for c, label in names.items()])
    return wide.select(F.col(source).alias("data_source"), F.explode(pairs).alias("m")).select("data_source", "m.metric", "m.value")


def metric_section(variable: Column, metric: Column, n_max: int, core: str) -> Column:
    """val-core for the core variable's mean, maj and best metrics at the largest n, else val-aux."""
    headline = metric.startswith("mean") | metric.startswith("maj") | metric.startswith("best")
    return F.when((variable == core) & headline & metric.contains(f"@{n_max}"), "val-core").otherwise("val-aux")


def score_summary(df: DataFrame, *keys: str, score: str = "score", parsed: str = "parsed") -> DataFrame:
    """Mean, std (0 for one row), shares of zero and full scores, parse rate and number of rows."""
    s = F.col(score)
    return df.groupBy(*keys).agg(
        F.avg(s).alias("mean"),
        F.coalesce(F.stddev_samp(s), F.lit(0.0)).alias("std"),
        F.avg((s == 0).cast("double")).alias("frac_zero"),
        F.avg((s == 1).cast("double")).alias("frac_full"),
        F.avg(F.col(parsed).cast("double")).alias("parse_rate"),
        F.count(F.lit(1)).alias("n"),
    )


def total_and_categories(df: DataFrame, key: str, category: str, score: str) -> DataFrame:
    """Means per (key, category) and per key in one pass; the total's category is null."""
    rolled = df.groupBy(F.col(key), F.col(category)).agg(F.sum(score).alias("_s"), F.count(score).alias("_n"))
    sets = rolled.rollup(key, category).agg(F.sum("_s").alias("_s"), F.sum("_n").alias("n"), F.grouping_id().alias("level"))
    return sets.where("level < 3").select(key, category, (F.col("_s") / F.col("n")).alias("mean"), "n", "level")


def mean_of_means(df: DataFrame, outer: str, inner: str, score: str) -> DataFrame:
    """Mean over inner groups of their means, with the number of inner groups."""
    return df.groupBy(outer, inner).agg(F.avg(score).alias("_m")).groupBy(outer).agg(F.avg("_m").alias("mean"), F.count(F.lit(1)).alias("n"))


def rollout_aggregate(df: DataFrame, group: str, order: str, text: str, scores: list[str]) -> DataFrame:
    """Mean scores and the longest text (first on ties) per group."""
    return df.groupBy(group).agg(*[F.avg(c).alias(c) for c in scores], F.max_by(text, F.struct(F.length(text), -F.col(order))).alias("longest"))


def reduce_by_name(df: DataFrame, key: str, value: str) -> DataFrame:
    """Maximum for keys with "max", minimum for keys with "min", else mean."""
    k = F.col(key)
    return df.groupBy(key).agg(F.max(value).alias("_x"), F.min(value).alias("_n"), F.avg(value).alias("_m")).select(key, F.when(k.contains("max"), F.col("_x")).when(k.contains("min"), F.col("_n")).otherwise(F.col("_m")).alias("value"))


def data_metrics(df: DataFrame, score: str, value: str, returns: str, length: str, cap: int) -> DataFrame:
    """Score statistics, explained variance 1 - var(returns - value) / (var(returns) + 1e-5), lengths and clip ratio."""
    return df.agg(
        F.avg(score).alias("score_mean"), F.max(score).alias("score_max"), F.min(score).alias("score_min"),
        (1 - F.var_samp(F.col(returns) - F.col(value)) / (F.var_samp(returns) + F.lit(1e-5))).alias("vf_explained_var"),
        F.avg(length).alias("length_mean"), F.max(length).alias("length_max"), F.min(length).alias("length_min"),
        F.avg((F.col(length) == cap).cast("double")).alias("clip_ratio"),
    )


def timing_per_token(seconds: Column, tokens: Column) -> Column:
    """Milliseconds per token."""
    return seconds * 1000 / tokens


def throughput(tokens: Column, seconds: Column, devices: int) -> Column:
    return tokens / (seconds * devices)


def phase_stats(df: DataFrame, first: str, second: str, *attributes: str) -> DataFrame:
    """Min, max and mean of two phase times and the attributes of the slowest row."""
    total = F.col(first) + F.col(second)
    aggs = [f(c).alias(f"{c}_{n}") for c in (first, second) for n, f in (("min", F.min), ("max", F.max), ("mean", F.avg))]
    slow = [F.max_by(a, total).alias(f"slowest_{a}") for a in attributes]
    return df.agg(*aggs, *slow)


def mean_max_min_std(df: DataFrame, value: str) -> DataFrame:
    return df.agg(F.avg(value).alias("mean"), F.max(value).alias("max"), F.min(value).alias("min"), F.stddev_samp(value).alias("std"))


def masked_mean(df: DataFrame, value: str, mask: str) -> DataFrame:
    return df.agg((F.sum(F.col(value) * F.col(mask)) / F.sum(mask)).alias("masked_mean"))


def safe_mean(value: Column) -> Column:
    """Mean without nulls and NaN; 0 when nothing is left."""
    return F.coalesce(F.avg(F.when(~F.isnan(value), value)), F.lit(0.0))


def exploded_tokens(df: DataFrame, *columns: str) -> DataFrame:
    """One row per token of parallel arrays."""
    return df.select(F.explode(F.arrays_zip(*columns)).alias("t")).select("t.*")


def prob_diff(df: DataFrame, a: str, b: str, mask: str) -> DataFrame:
    """Max, mean and std of |exp(a) - exp(b)| over masked tokens."""
    d = F.abs(F.exp(a) - F.exp(b))
    return df.where(F.col(mask) == 1).agg(F.max(d).alias("max"), F.avg(d).alias("mean"), F.stddev_samp(d).alias("std"))


def flops(lengths: DataFrame, column: str, hidden: int, layers: int, heads: int, kv_heads: int, head_dim: int, inter: int, vocab: int) -> DataFrame:
    """Training FLOPs (in 1e12) of a dense decoder from the sums of lengths and squared lengths."""
    mlp = hidden * inter * 3
    attn = hidden * (heads * head_dim + 2 * kv_heads * head_dim + heads * head_dim)
    dense = (mlp + attn) * layers + 2 * vocab * hidden
    sums = lengths.agg(F.sum(column).cast("double").alias("_s"), F.sum(F.col(column).cast("double") * F.col(column)).alias("_q"))
    return sums.select(((6 * dense * F.col("_s") + 12.0 * head_dim * heads * layers * F.col("_q")) / 1e12).alias("tflops"))


