"""Array, mask and sequence functions over token arrays: column expressions (JVM side), and Arrow batches for running sums,
which an interpreted lambda can only say in quadratic time."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)


def masked_sum(values: Column, mask: Column) -> Column:
    return _sum(F.zip_with(values, mask, lambda v, m: v.cast("double") * m))


def masked_mean(values: Column, mask: Column) -> Column:
    """sum(v m) / (sum(m) + 1e-8)."""
    return masked_sum(values, mask) / (_sum(F.transform(mask, lambda m: m.cast("double"))) + F.lit(1e-8))


def masked_var(values: Column, mask: Column) -> Column:
    """Bessel-corrected variance over the mask; null when fewer than two positions are masked in."""
    n = _sum(F.transform(mask, lambda m: m.cast("double")))
    mean = masked_mean(values, mask)
    centred = F.zip_with(values, mask, lambda v, m: (v - mean) * (v - mean) * m)
    return F.when(n > 1, _sum(centred) / (n + F.lit(1e-8)) * n / (n - 1))


def whiten(values: Column, mean: Column, var: Column, shift_mean: bool = True) -> Column:
    """(v - mean) / sqrt(var + 1e-8), with the mean added back unless it is shifted away."""
    out = F.transform(values, lambda v: (v - mean) / F.sqrt(var + F.lit(1e-8)))
    return out if shift_mean else F.transform(out, lambda v: v + mean)


def response_mask(ids: Column, eos: int) -> Column:
    """1 up to and with the first end token; all 1 when there is none."""
    at = F.array_position(ids, F.lit(eos))
    return F.transform(ids, lambda _, i: F.when((at == 0) | (i < at), 1).otherwise(0))


def tail_mask(attention: Column, response: int) -> Column:
    return F.slice(attention, -response, response)


def position_ids(mask: Column) -> Column:
    """max(cumulative sum of the mask - 1, 0)."""

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def run(masks: pd.Series) -> pd.Series:
        return masks.map(lambda m: np.maximum(np.cumsum(m) - 1, 0).astype(np.int32), na_action="ignore")

    return run(F.transform(mask, lambda x: x.cast("int")))


def pad_to(a: Column, length: int, pad: int = 0, left: bool = False) -> Column:
    """Padded on one side; no shorter than before."""
    fill = F.array_repeat(F.lit(pad), F.greatest(F.lit(length) - F.size(a), F.lit(0)))
    return F.concat(fill, a) if left else F.concat(a, fill)


def truncate(a: Column, length: int, how: str = "right") -> Column:
    """Cut to ``length``: the right or left end, or the middle (floor half from the head, the rest from the tail)."""
    long = F.size(a) > length
    if how == "right":
        cut = F.slice(a, 1, length)
    elif how == "left":
        cut = F.slice(a, -length, length)
    elif how == "middle":
        head = length // 2
        tail = length - head
        cut = F.concat(F.slice(a, 1, head), F.slice(a, -tail, tail))
    elif how == "error":
        cut = F.raise_error(F.lit("sequence is too long")).cast("array<int>")
    else:
        raise ValueError(f"unknown truncation {how!r}")
    return F.when(long, cut).otherwise(a)


def pad_or_truncate(a: Column, length: int, pad: int = 0, left: bool = True, how: str = "left") -> Column:
    return pad_to(truncate(a, length, how), length, pad, left)


def strip_pad(ids: Column, mask: Column) -> Column:
    """Ids whose mask is 1."""
    return F.transform(F.filter(F.arrays_zip(ids.alias("i"), mask.alias("m")), lambda x: x["m"] == 1), lambda x: x["i"])


def clip(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(x, F.lit(high)), F.lit(low))


def logsumexp(logits: Column) -> Column:
    peak = F.array_max(logits)
    return F.log(_sum(F.transform(logits, lambda x: F.exp(x - peak)))) + peak


def entropy(logits: Column) -> Column:
    """logsumexp - sum(softmax x logit)."""
    z = logsumexp(logits)
    return z - _sum(F.transform(logits, lambda x: F.exp(x - z) * x))


def log_prob(logits: Column, label: Column) -> Column:
    """Log-softmax of the label (0-based)."""
    return F.element_at(logits, label + 1) - logsumexp(logits)


def gather(values: Column, label: Column) -> Column:
    return F.element_at(values, label + 1)


def temperature(logits: Column, t: float) -> Column:
    return F.transform(logits, lambda x: x / F.lit(t))


def inverse_permutation(idx: Column) -> Column:
    """inv[idx[i]] = i."""

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def run(orders: pd.Series) -> pd.Series:
        return orders.map(lambda x: np.argsort(x, kind="stable").astype(np.int32), na_action="ignore")

    return run(F.transform(idx, lambda x: x.cast("int")))


def round_up(a: Column, b: int) -> Column:
    return (F.ceil(a / F.lit(b)) * b).cast("long")


def ceil_div(a: Column, b: int) -> Column:
    return F.ceil(a / F.lit(b)).cast("long")


def score_at_last(score: Column, mask: Column, response: int) -> Column:
    """The score at the last valid position, 0 elsewhere; the last ``response`` positions are kept."""
    valid = F.aggregate(mask, F.lit(0), lambda a, m: a + m)
    return F.slice(F.transform(mask, lambda _, i: F.when(i == valid - 1, score).otherwise(F.lit(0.0))), -response, response)


def _scan_back(parts: list[pa.Array], start: int, step: Callable[..., tuple[np.ndarray, ...]]) -> pa.Array:
    """Runs ``step(state, values)`` from the last position to the first of all arrays of a batch at once; linear in the tokens.

    ``state`` has ``start`` numbers per array, the first of which is what comes out. Null arrays give null.
    """
    valid = np.logical_and.reduce([p.is_valid().to_numpy(zero_copy_only=False) for p in parts])
    firsts = [np.asarray(p.offsets).astype(np.int64)[:-1] for p in parts]
    values = [np.asarray(p.values.cast(pa.float64()).fill_null(np.nan)) for p in parts]
    n = np.where(valid, np.diff(np.asarray(parts[0].offsets)), 0).astype(np.int64)
    ends = np.concatenate([[0], np.cumsum(n)])
    out = np.zeros(ends[-1])
    order = np.argsort(-n, kind="stable")
    order, at = order[n[order] > 0], 0
    while at < len(order):
        longest = int(n[order[at]])
        rows = order[at : at + max(1, 2_000_000 // longest)]
        at += len(rows)
        places = np.arange(longest)
        inside = places < n[rows][:, None]
        mats = []
        for first, flat in zip(firsts, values):
            m = np.zeros(inside.shape)
            m[inside] = flat[(first[rows][:, None] + places)[inside]]
            mats.append(m)
        result = np.zeros(inside.shape)
        state = tuple(np.zeros(len(rows)) for _ in range(start))
        for t in range(longest - 1, -1, -1):
            new = step(state, tuple(m[:, t] for m in mats))
            result[:, t] = new[0]
            state = tuple(np.where(inside[:, t], x, 0.0) for x in new[1:])
        out[(ends[rows][:, None] + places)[inside]] = result[inside]
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(out), mask=pa.array(~valid))


def _doubles(c: Column) -> Column:
    return c.cast("array<double>")


def reverse_cumsum(rewards: Column) -> Column:
    """Suffix sums."""

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def run(r: pa.Array) -> pa.Array:
        return _scan_back([r], 1, lambda s, x: (s[0] + x[0],) * 2)

    return run(_doubles(rewards))


def discounted_returns(rewards: Column, mask: Column, gamma: float) -> Column:
    """Reverse discounted sum that starts again at 0 after masked-out tokens."""

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def run(r: pa.Array, m: pa.Array) -> pa.Array:
        def step(s, x):
            total = x[0] + gamma * s[0]
            return total, total * x[1]

        return _scan_back([r, m], 1, step)

    return run(_doubles(rewards), _doubles(mask))


def gae(rewards: Column, values: Column, gamma: float, lam: float) -> Column:
    """Advantages A_t = d_t + gamma lam A_(t+1) with d_t = r_t + gamma V_(t+1) - V_t."""

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def run(r: pa.Array, v: pa.Array) -> pa.Array:
        def step(s, x):
            a = x[0] + gamma * s[1] - x[1] + gamma * lam * s[0]
            return a, a, x[1]

        return _scan_back([r, v], 2, step)

    return run(_doubles(rewards), _doubles(values))


def kl_estimate(log_prob: Column, ref: Column, kind: str = "kl") -> Column:
    """Per-token KL estimate: the difference, its absolute, half its square, or the low-variance form clipped to 10."""
    d = log_prob - ref
    if kind in ("kl", "k1"):
        return d
    if kind == "abs":
        return F.abs(d)
    if kind in ("mse", "k2"):
        return F.lit(0.5) * d * d
    if kind in ("low_var_kl", "k3"):
        r = clip(ref - log_prob, -20.0, 20.0)
        return clip(F.exp(r) - r - 1, -10.0, 10.0)
    raise ValueError(f"unknown KL estimate {kind!r}")


def kl_rewards(scores: Column, log_probs: Column, refs: Column, mask: Column, beta: float, kind: str = "kl") -> Column:
    """score - beta x KL x mask, token by token."""
    kl = F.zip_with(log_probs, refs, lambda a, b: kl_estimate(a, b, kind))
    penal = F.zip_with(kl, mask, lambda k, m: k * m * F.lit(beta))
    return F.zip_with(scores, penal, lambda s, p: s - p)


def sft_pack(prompt: Column, response: Column, length: int) -> list[Column]:
    """input_ids and loss_mask: next-token shift, so the last prompt token counts and the last response token does not."""
    ids = F.slice(F.concat(prompt, response), 1, length)
    total = F.least(F.size(prompt) + F.size(response), F.lit(length))
    mask = F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda i: F.when((i >= F.size(prompt) - 1) & (i < total - 1), 1).otherwise(0))
    return [pad_to(ids, length).alias("input_ids"), mask.alias("loss_mask")]


def marker_bounds(ids: Column, start: int, end: int) -> Column:
    """Pairs of start and end marker positions."""
    at = lambda token: F.filter(F.transform(ids, lambda x, i: F.when(x == token, i).otherwise(-1)), lambda p: p >= 0)
    return F.arrays_zip(at(start).alias("s"), at(end).alias("e"))


def split_batches(df: DataFrame, index: str, size: int) -> DataFrame:
    return df.withColumn("batch_no", F.floor(F.col(index) / size))
