"""Balanced packing of sequences by length.

Packing is a sequential fold over (id, length) summaries of one batch; batches are packed in parallel (one group per
batch), and a batch of more than MOST_ROWS rows is refused. The rows themselves never travel: bins are joined back on the
id.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Most rows of one batch.
MOST_ROWS = 2_000_000


def padded(df: DataFrame, batch: str, key: str, length: str, k: int) -> DataFrame:
    """(batch, key, length) with items of length 0 and negative keys -1, -2, ... until each batch divides into k."""
    sizes = df.groupBy(batch).agg(F.count(F.lit(1)).alias("_n")).withColumn("_p", F.pmod(-F.col("_n"), F.lit(k)).cast("int")).where(F.col("_p") > 0)
    kind = f"array<{df.schema[key].dataType.simpleString()}>"
    extra = sizes.select(batch, F.explode(F.sequence(F.lit(-1), -F.col("_p")).cast(kind)).alias(key), F.lit(0).cast(df.schema[length].dataType).alias(length))
    return df.select(batch, key, length).unionByName(extra)


def differencing(lengths: list[int], k: int, equal_size: bool = False) -> list[list[int]]:
    """Largest differencing into k bins; with ``equal_size``, rows are grouped k at a time so that bins hold equally many."""
    n = len(lengths)
    if equal_size and n % k:
        raise ValueError(f"{n} sequences do not divide into {k} equal bins")
    order = sorted(range(n), key=lambda i: (lengths[i], i))
    starts = [order[i : i + k] for i in range(0, n, k)] if equal_size else [[i] for i in order]
    heap, count = [], 0
    for items in starts:
        bins = sorted([(lengths[i], [i]) for i in items] + [(0, [])] * (k - len(items)), key=lambda b: -b[0])
        heapq.heappush(heap, (-(bins[0][0] - bins[-1][0]), count, bins))
        count += 1
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        merged = sorted([(x[0] + y[0], x[1] + y[1]) for x, y in zip(a, reversed(b))], key=lambda b: -b[0])
        heapq.heappush(heap, (-(merged[0][0] - merged[-1][0]), count, merged))
        count += 1
    return [sorted(items) for _, items in heap[0][2]] if heap else [[] for _ in range(k)]


def greedy(lengths: list[int], k: int, equal_size: bool = False) -> list[list[int]]:
    """Every sequence, in input order, to the lightest bin; with ``equal_size`` full bins are passed over."""
    bins: list[list[int]] = [[] for _ in range(k)]
    sums, most = [0] * k, -(-len(lengths) // k) if equal_size else len(lengths)
    for i, length in enumerate(lengths):
        at = min((b for b in range(k) if len(bins[b]) < most), key=lambda b: (sums[b], b))
        bins[at].append(i)
        sums[at] += length
    return bins


def micro_batch_count(total: Column, rows: Column, max_tokens: int, least: int = 1, multiple: int = 1) -> Column:
    """min(rows, ceil(total / max)), at least ``least``, rounded up to ``multiple``."""
    n = F.greatest(F.least(rows, F.ceil(total / max_tokens)), F.lit(least))
    return (F.ceil(n / multiple) * multiple).cast("long")


def balanced(df: DataFrame, batch: str, key: str, length: str, k: int, equal_size: bool = False, method=differencing) -> DataFrame:
    """(batch, key, length, bin) for every batch."""
    bk, kk = df.schema[batch].dataType.simpleString(), df.schema[key].dataType.simpleString()

    def run(part: pd.DataFrame) -> pd.DataFrame:
        if len(part) > MOST_ROWS:
            raise ValueError("batch too large to pack")
        part = part.sort_values(key).reset_index(drop=True)
        bins = method([int(x) for x in part[length]], k, equal_size)
        at = pd.Series(0, index=part.index)
        for b, items in enumerate(bins):
            at[items] = b
        return pd.DataFrame({batch: part[batch], key: part[key], length: part[length].astype("int64"), "bin": at.astype("int32")})

    return df.select(batch, key, F.col(length).cast("long").alias(length)).groupBy(batch).applyInPandas(run, f"{batch} {bk}, {key} {kk}, {length} long, bin int")


def imbalance(df: DataFrame, bin_: str, length: str, *batch: str) -> DataFrame:
    """Smallest, largest and spread of the bins' sums."""
    sums = df.groupBy(*batch, bin_).agg(F.sum(length).alias("_s"))
    return sums.groupBy(*batch).agg(F.min("_s").alias("least"), F.max("_s").alias("most"), (F.max("_s") - F.min("_s")).alias("spread"))
