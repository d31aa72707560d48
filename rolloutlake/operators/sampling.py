"""Filters, samples and splits. Seeded choices use a hash of the row's key, so they do not depend on order or partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rolloutlake.operators.advantage import with_group_stats

#: Label of rows without a category.
UNCATEGORISED = "(Uncategorized)"

_SPACE = r"^\s+|\s+$"


def strip(c: Column) -> Column:
    """White space of every kind dropped at both ends."""
    return F.regexp_replace(c, _SPACE, "")


def seeded(*keys: Column, seed: int) -> Column:
    """Order key of seeded samples: 52 bits of an md5, alike on any engine that has md5."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), *[k.cast("string") for k in keys])), 1, 13), 16, 10).cast("long")


def within_length(df: DataFrame, tokens: Column, most: int) -> DataFrame:
    """Rows whose token array is no longer than ``most``."""
    return df.where(F.size(tokens) <= most)


def clean_pairs(df: DataFrame, prompt: str, response: str, least: int = 10, most: int = 2000, response_most: int = 4000) -> DataFrame:
    """Prompts of ``least`` to ``most`` characters with responses up to ``response_most``; an empty response passes."""
    size = F.length(strip(F.coalesce(F.col(prompt), F.lit(""))))
    return df.where(size.between(least, most) & (F.length(F.coalesce(F.col(response), F.lit(""))) <= response_most))


def best_response(df: DataFrame, completions: str, out: str = "best") -> DataFrame:
    """Response of the highest score in array<struct<response, overall_score>>; the first one wins ties, empty ones never win."""
    usable = F.filter(completions, lambda c: (F.length(strip(F.coalesce(c["response"], F.lit("")))) > 0) & c["overall_score"].isNotNull())
    start = F.struct(F.lit(None).cast("string").alias("response"), F.lit(float("-inf")).alias("overall_score"))
    pick = F.aggregate(usable, start, lambda best, c: F.when(c["overall_score"].cast("double") > best["overall_score"], F.struct(c["response"].alias("response"), c["overall_score"].cast("double").alias("overall_score"))).otherwise(best))
    return df.withColumn(out, pick["response"])


def required_fields(df: DataFrame, *columns: str) -> DataFrame:
    """Rows in which none of the columns is null or blank."""
    keep = F.lit(True)
    for c in columns:
        keep = keep & (F.length(strip(F.coalesce(F.col(c), F.lit("")))) > 0)
    return df.where(keep)


def of_type(df: DataFrame, column: str, value: str) -> DataFrame:
    return df.where(F.trim(column) == value)


def in_list(df: DataFrame, column: str, comma_separated: str) -> DataFrame:
    return df.where(F.trim(column).isin([x.strip() for x in comma_separated.split(",") if x.strip()]))


def category(c: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit(UNCATEGORISED))


def stratified_sample(df: DataFrame, column: str, n: int, key: str, seed: int = 42) -> DataFrame:
    """Up to n rows of every category.

    Each category's rows are first thinned in every hash range (a partial top-n that needs no whole category in one
    task), then ranked; ranges of one category hold at most 256 x n rows together.
    """
    ranked = df.withColumn("_c", category(F.col(column))).withColumn("_h", seeded(F.col(key), seed=seed)).withColumn("_r", F.pmod(F.xxhash64(key), F.lit(256)))
    few = ranked.withColumn("_k", F.row_number().over(Window.partitionBy("_c", "_r").orderBy("_h", key))).where(F.col("_k") <= n)
    return few.withColumn("_k", F.row_number().over(Window.partitionBy("_c").orderBy("_h", key))).where(F.col("_k") <= n).drop("_h", "_r", "_k").withColumnRenamed("_c", "stratum")


def uniform_sample(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """n rows without replacement: the smallest hashes (a distributed top-n)."""
    return df.withColumn("_h", seeded(F.col(key), seed=seed)).orderBy("_h", key).limit(n).drop("_h")


def _last_ranked(hashed: DataFrame, key: str, rank: int) -> tuple[int, object]:
    """(hash, key) of the row of a rank in the order of (``_h``, key): two histograms of 4,096 bins, then the rows of one fine bin."""
    part, left = hashed, rank
    for shift in (40, 28):
        bins = part.groupBy(F.shiftright("_h", shift).alias("_b")).count().collect()
        for r in sorted(bins, key=lambda r: r["_b"]):
            if left <= r["count"]:
                part = part.where(F.shiftright("_h", shift) == r["_b"])
                break
            left -= r["count"]
    last = part.select("_h", F.col(key).alias("_key")).orderBy("_h", "_key").limit(left).agg(F.max(F.struct("_h", "_key")).alias("m")).first()["m"]
    return last["_h"], last["_key"]


def ratio_split(df: DataFrame, parts: list[tuple[str, float]], key: str, seed: int = 42, out: str = "split") -> DataFrame:
    """Exact shares of a seeded shuffle. The hash and key of the last row of each part are looked up in histograms, and
    every row is labelled by comparing its own with them: no row is shuffled or ranked outside the bins of these ends."""
    n = df.count()
    hashed = df.withColumn("_h", seeded(F.col(key), seed=seed))
    at, label = 0.0, None
    for name, share in parts[:-1]:
        at += share
        end = min(n, int(n * at + 1e-9))
        if not end:
            continue
        h, last = _last_ranked(hashed.select("_h", key), key, end)
        inside = (F.col("_h") < h) | ((F.col("_h") == h) & (F.col(key) <= F.lit(last)))
        label = F.when(inside, name) if label is None else label.when(inside, name)
    label = F.lit(parts[-1][0]) if label is None else label.otherwise(parts[-1][0])
    return hashed.withColumn(out, label).drop("_h")


def distinct_top_k(df: DataFrame, group: str, text: str, order: str, k: int) -> DataFrame:
    """First k rows of different non-empty text per group in order; short groups are filled with their other rows in order."""
    t = strip(F.coalesce(F.col(text), F.lit("")))
    seen = F.row_number().over(Window.partitionBy(group, "_t").orderBy(order))
    first = F.when((F.col("_s") == 1) & (F.col("_t") != ""), 0).otherwise(1)
    ranked = df.withColumn("_t", t).withColumn("_s", seen).withColumn("_f", first)
    return ranked.withColumn("_k", F.row_number().over(Window.partitionBy(group).orderBy("_f", order))).where(F.col("_k") <= k).drop("_t", "_s", "_f", "_k")


def first_k(df: DataFrame, group: str, order: str, k: int) -> DataFrame:
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(group).orderBy(order))).where(F.col("_k") <= k).drop("_k")


def varied_groups(df: DataFrame, group: str, score: str) -> DataFrame:
    """Groups whose population standard deviation is above zero, or of a single row."""
    keep = with_group_stats(df, group, _s=F.stddev_pop(score), _n=F.count(F.lit(1)))
    return keep.where((F.col("_s") > 0) | (F.col("_n") == 1)).drop("_s", "_n")


def accuracy_band(df: DataFrame, group: str, score: str, length: str, low: float, high: float, cap: int) -> DataFrame:
    """Adds ``passes``: mean score within [low, high] and no length at the cap; passing groups come first downstream."""
    rows = with_group_stats(df, group, _m=F.avg(score), _x=F.max(length))
    return rows.withColumn("passes", F.col("_m").between(low, high) & (F.col("_x") < cap - 1)).drop("_m", "_x")


def resample_weights(df: DataFrame, score: str, method: str = "pow", power: float = 2.0, out: str = "weight") -> DataFrame:
    """Weights of a prioritised resample: |score|^p; 1 on the extremes else 0; or 0.4 on the maximum else 0.1; at least 1e-8."""
    if method == "pow":
        w = F.pow(F.abs(F.col(score)), F.lit(power))
        return df.withColumn(out, F.greatest(w, F.lit(1e-8)))
    ends = df.agg(F.min(score).alias("_lo"), F.max(score).alias("_hi"))
    rows = df.crossJoin(F.broadcast(ends))
    if method == "max_min":
        w = F.when((F.col(score) == F.col("_lo")) | (F.col(score) == F.col("_hi")), 1.0).otherwise(0.0)
    elif method == "max_random":
        w = F.when(F.col(score) == F.col("_hi"), 0.4).otherwise(0.1)
    else:
        raise ValueError(f"unknown method {method!r}")
    return rows.withColumn(out, F.greatest(w, F.lit(1e-8))).drop("_lo", "_hi")


def weighted_resample(df: DataFrame, weight: str, n: int, key: str, seed: int = 42) -> DataFrame:
    """n draws with replacement: each row's number of draws is the number of seeded points in its stretch of the cumulative weight.

    The points are one per n-th of the total weight, jittered inside it (systematic sampling), so a row's draws follow
    from its own stretch and no draw is joined with the table.
    """
    ranges = df.withColumn("_r", F.pmod(F.xxhash64(key), F.lit(512)).cast("int"))
    sums = ranges.groupBy("_r").agg(F.sum(weight).alias("_w"))
    before = F.sum("_w").over(Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sums.select("_r", F.coalesce(before, F.lit(0.0)).alias("_before"))
    total = sums.agg(F.sum("_w")).first()[0] or 1.0
    end = F.col("_before") + F.sum(weight).over(Window.partitionBy("_r").orderBy(key).rowsBetween(Window.unboundedPreceding, 0))
    jitter = (abs(hash((seed, n))) % 1000) / 1000
    count = lambda x: F.greatest(F.lit(0), F.floor(x / total * n - jitter) + 1)
    drawn = ranges.join(F.broadcast(offsets), "_r").withColumn("_e", end)
    drawn = drawn.withColumn("draws", (F.least(F.lit(n), count(F.col("_e"))) - F.least(F.lit(n), count(F.col("_e") - F.col(weight)))).cast("int"))
    return drawn.where("draws > 0").drop("_r", "_before", "_e")


def drop_metrics(df: DataFrame, column: str, patterns: list[str]) -> DataFrame:
    """Metrics in whose key no pattern is contained."""
    keep = F.lit(True)
    for p in patterns:
        keep = keep & ~F.col(column).contains(p)
    return df.where(keep)


def label_present(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.length(column) > 0)


def without(df: DataFrame, *columns: str) -> DataFrame:
    """All other columns; a column that is not there is an error."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"no such columns: {', '.join(missing)}")
    return df.drop(*columns)


def keep_with_counts(df: DataFrame, keep: Column) -> tuple[DataFrame, DataFrame]:
    """The rows where ``keep`` holds (null does not), and one row with total, kept and dropped."""
    sure = F.coalesce(keep, F.lit(False))
    counts = df.agg(F.count(F.lit(1)).alias("total"), F.count_if(sure).alias("kept"))
    return df.where(sure), counts.withColumn("dropped", F.col("total") - F.col("kept"))
