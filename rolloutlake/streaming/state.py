"""State carried between batches: adaptive coefficients, dynamic sampling, novelty against recent anchors, streams of rollouts.

The order of batches is explicit (a step column). Batch forms are folds or windows over that order; the stream forms
use Structured Streaming state with a checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def adaptive_kl(steps: DataFrame, order: str, kl: str, samples: str, start: float, target: float, horizon: float) -> DataFrame:
    """Coefficient after every step: beta *= 1 + clip(kl / target - 1, 0.2) n / horizon.

    The factor of a step does not depend on the coefficient, so the recurrence is a running product: exp of a running
    sum of logarithms over the steps (a table of one row per step).
    """
    error = F.greatest(F.least(F.col(kl) / target - 1, F.lit(0.2)), F.lit(-0.2))
    factor = F.lit(1.0) + error * F.col(samples) / horizon
    w = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return steps.withColumn("beta", F.lit(start) * F.exp(F.sum(F.log(factor)).over(w)))


def dynamic_sampling(groups: DataFrame, order: str, wanted: int, batch: str, most_batches: int | None = None) -> DataFrame:
    """Groups in arrival order until ``wanted`` are kept; later batches than ``most_batches`` are an error upstream."""
    kept = groups if most_batches is None else groups.where(F.col(batch) < most_batches)
    return kept.orderBy(order).limit(wanted)


def novelty_bonus(anchors: np.ndarray, buffer: list[np.ndarray], beta: float = 0.1, most: int = 100) -> list[float]:
    """Bonus beta x clip(1 - max cosine to the last ``most`` anchors) of each vector in order; the buffer is extended in place."""
    out = []
    for v in anchors:
        u = v / max(float(np.linalg.norm(v)), 1e-12)
        out.append(beta * float(np.clip(1 - max((float(u @ b) for b in buffer), default=-1.0), 0.0, 1.0)))
        buffer.append(u)
        del buffer[:-most]
    return out


def novelty(df: DataFrame, stream: str, order: str, vector: str, beta: float = 0.1, most: int = 100) -> DataFrame:
    """(stream, order, bonus): each anchor against the ``most`` anchors before it in its stream, by a bounded window.

    Only unit vectors of the window's rows are held, so a stream of any length needs ``most`` vectors at a time.
    """
    n = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    unit = F.transform(vector, lambda x: x.cast("double") / F.greatest(n, F.lit(1e-12)))
    w = Window.partitionBy(stream).orderBy(order).rowsBetween(-most, -1)
    before = df.select(stream, order, unit.alias("_u")).withColumn("_b", F.collect_list("_u").over(w))
    cos = F.transform("_b", lambda b: F.aggregate(F.zip_with(b, F.col("_u"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x))
    top = F.coalesce(F.array_max(cos), F.lit(-1.0))
    return before.select(stream, order, (F.greatest(F.least(1 - top, F.lit(1.0)), F.lit(0.0)) * beta).alias("bonus"))


def latest_step(df: DataFrame, step: str = "step") -> DataFrame:
    return df.agg(F.max(step).alias("latest_step"))


def should_save(remaining: Column, slowest_step: Column, save: Column, spare: float = 0.0) -> Column:
    """Whether the time left is below the longest step plus the time to save."""
    return remaining <= slowest_step + save + spare


def last_user_reply(df: DataFrame, conversation: str, turn: str, role: str, content: str) -> DataFrame:
    """Latest user message of each conversation, with "#### " put before it where it is missing."""
    last = df.where(F.col(role) == "user").groupBy(conversation).agg(F.max_by(content, turn).alias("reply"))
    return last.withColumn("reply", F.when(F.col("reply").startswith("#### "), F.col("reply")).otherwise(F.concat(F.lit("#### "), "reply")))


def stream_group_stats(stream: DataFrame, time: str, group: str, score: str, late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """Windowed group statistics of a stream of rollouts, with a watermark for late rows."""
    timed = stream.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", late)
    return timed.groupBy(F.window("_t", size), group).agg(F.count(F.lit(1)).alias("n"), F.avg(score).alias("mean"), F.stddev_samp(score).alias("std"))


def stream_novelty(stream: DataFrame, key: str, order: str, vector: str, beta: float = 0.1, most: int = 100) -> DataFrame:
    """Novelty bonus on a stream, with the last anchors of each key as state."""
    kk, ok = stream.schema[key].dataType.simpleString(), stream.schema[order].dataType.simpleString()

    def step(k, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held = [np.array(x) for x in state.get[0]] if state.exists else []
        for part in frames:
            part = part.sort_values(order)
            bonus = novelty_bonus(np.stack(part[vector].to_numpy()).astype(float), held, beta, most)
            yield pd.DataFrame({key: k[0], order: part[order], "bonus": bonus})
        state.update(([x.tolist() for x in held],))

    return stream.select(key, order, vector).groupBy(key).applyInPandasWithState(step, f"{key} {kk}, {order} {ok}, bonus double", "anchors array<array<double>>", "append", "NoTimeout")
