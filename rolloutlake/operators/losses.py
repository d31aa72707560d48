"""Loss-shaped aggregates over (response, token) rows: one row per token with the keys of its response.

Exploded tokens let every mode be one partial aggregation; nothing is folded in an interpreted lambda.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def aggregate_loss(df: DataFrame, sequence: str, loss: str, mask: str, mode: str = "token-mean", padded_length: int | None = None) -> DataFrame:
    """One row ``loss`` of a mode: token-mean, seq-mean-token-sum, seq-mean-token-mean or seq-mean-token-sum-norm."""
    masked = F.sum(F.col(loss) * F.col(mask))
    if mode == "token-mean":
        return df.agg((masked / (F.sum(mask) + F.lit(1e-8))).alias("loss"))
    per = df.groupBy(sequence).agg(masked.alias("_s"), F.sum(mask).alias("_m"))
    if mode == "seq-mean-token-sum":
        return per.agg(F.avg("_s").alias("loss"))
    if mode == "seq-mean-token-mean":
        return per.agg(F.avg(F.col("_s") / (F.col("_m") + F.lit(1e-8))).alias("loss"))
    if mode == "seq-mean-token-sum-norm":
        return per.agg((F.sum("_s") / F.lit(padded_length)).alias("loss"))
    raise ValueError(f"unknown loss mode {mode!r}")


def _clip(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(x, F.lit(high)), F.lit(low))


def clipped_policy(old: Column, new: Column, advantage: Column, low: float = 0.2, high: float = 0.2, c: float = 3.0) -> list[Column]:
    """Per-token loss with dual clip, and whether each clip was active."""
    ratio = F.exp(_clip(new - old, -20.0, 20.0))
    plain, bounded = -advantage * ratio, -advantage * _clip(ratio, 1 - low, 1 + high)
    upper = F.greatest(plain, bounded)
    dual = -advantage * F.lit(c)
    loss = F.when(advantage < 0, F.least(dual, upper)).otherwise(upper)
    return [loss.alias("pg_loss"), (bounded > plain).cast("double").alias("clipped"), ((upper > dual) & (advantage < 0)).cast("double").alias("clipped_lower")]


def policy_loss(df: DataFrame, old: str, new: str, advantage: str, mask: str, **clips) -> DataFrame:
    """Masked token means of the loss, clip shares and the KL estimate old - new."""
    t = df.select("*", *clipped_policy(F.col(old), F.col(new), F.col(advantage), **clips))
    m = F.col(mask)
    mean = lambda x: F.sum(x * m) / (F.sum(m) + F.lit(1e-8))
    return t.agg(mean(F.col("pg_loss")).alias("pg_loss"), mean(F.col("clipped")).alias("clip_frac"), mean(F.col(old) - F.col(new)).alias("ppo_kl"), mean(F.col("clipped_lower")).alias("clip_frac_lower"))


def sequence_ratio(df: DataFrame, sequence: str, old: str, new: str, mask: str) -> DataFrame:
    """Length-normalised sequence ratio exp(mean masked log-ratio), at most e^10."""
    m = F.col(mask)
    return df.groupBy(sequence).agg(F.exp(F.least(F.sum((F.col(new) - F.col(old)) * m) / F.greatest(F.sum(m), F.lit(1)), F.lit(10.0))).alias("_ratio"))


def gspo_loss(df: DataFrame, sequence: str, old: str, new: str, advantage: str, mask: str, low: float = 0.2, high: float = 0.2) -> DataFrame:
    """Sequence-mean of the clipped loss with the sequence ratio."""
    r = sequence_ratio(df, sequence, old, new, mask)
    per = df.groupBy(sequence).agg(F.sum(F.col(advantage) * F.col(mask)).alias("_a"), F.sum(mask).alias("_n")).join(r, sequence)
    mean_a = F.col("_a") / (F.col("_n") + F.lit(1e-8))
    return per.agg(F.avg(F.greatest(-mean_a * F.col("_ratio"), -mean_a * _clip(F.col("_ratio"), 1 - low, 1 + high))).alias("loss"))


#: Bins of a covariance histogram.
COV_BINS = 4096


def _with_cov(df: DataFrame, new: str, advantage: str, mask: str) -> tuple[DataFrame, int]:
    """Masked tokens with the covariance of advantage and log-probability (nine digits), and their number."""
    used = df.where(F.col(mask) == 1)
    stats = used.agg(F.avg(advantage).alias("_a"), F.avg(new).alias("_l"), F.count(F.lit(1)).alias("_n")).first()
    cov = (F.col(advantage) - F.lit(stats["_a"])) * (F.col(new) - F.lit(stats["_l"]))
    return used.withColumn("cov", F.round(cov, 9)), stats["_n"]


def _largest(df: DataFrame, value: str, key: str, n: int) -> DataFrame:
    """The ``n`` rows with the largest values (smallest keys on ties): a histogram tells the bin of the last one, only that bin is ranked."""
    ends = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi")).first()
    if ends["lo"] is None or n <= 0:
        return df.limit(0)
    width = (ends["hi"] - ends["lo"]) / COV_BINS or 1.0
    binned = df.withColumn("_bin", F.least(F.floor((F.col(value) - F.lit(ends["lo"])) / F.lit(width)), F.lit(COV_BINS - 1)).cast("int"))
    above, edge, left = 0, -1, 0
    for r in sorted(binned.groupBy("_bin").count().collect(), key=lambda r: -r["_bin"]):
        if above + r["count"] >= n:
            edge, left = r["_bin"], n - above
            break
        above += r["count"]
    ranked = binned.where(F.col("_bin") == edge).orderBy(F.col(value).desc(), key).limit(left)
    return binned.where(F.col("_bin") > edge).unionByName(ranked).drop("_bin")


def kl_cov_tokens(df: DataFrame, key: str, new: str, advantage: str, mask: str, share: float) -> DataFrame:
    """Masked tokens with the largest covariance of advantage and log-probability: the top ``share`` of all, one at least."""
    rows, n = _with_cov(df, new, advantage, mask)
    return _largest(rows, "cov", key, max(1, int(n * share)) if n else 0)


def clip_cov_candidates(df: DataFrame, new: str, advantage: str, mask: str, low: float, high: float) -> DataFrame:
    """Tokens whose covariance lies in (low, high): those a clip-cov step draws from."""
    return _with_cov(df, new, advantage, mask)[0].where((F.col("cov") > low) & (F.col("cov") < high))


def clip_cov_tokens(df: DataFrame, key: str, new: str, advantage: str, mask: str, low: float, high: float, share: float, seed: int = 0) -> DataFrame:
    """The tokens whose loss a clip-cov step sets to zero: of the candidates, ``share`` of all masked tokens in the order of a hash.

    The hash stands for the random draw, so the same tokens come out in every run; all candidates if there are fewer.
    """
    rows, n = _with_cov(df, new, advantage, mask)
    candidates = rows.where((F.col("cov") > low) & (F.col("cov") < high))
    draw = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), 1, 13), 16, 10).cast("double")
    return _largest(candidates.withColumn("_d", -draw), "_d", key, max(1, int(n * share)) if n else 0).drop("_d")


def value_loss(df: DataFrame, pred: str, returns: str, old: str, mask: str, clip_range: float) -> DataFrame:
    """Half the mean of the larger of the clipped and unclipped squared errors, and the share clipped."""
    bounded = F.greatest(F.least(F.col(pred), F.col(old) + F.lit(clip_range)), F.col(old) - F.lit(clip_range))
    a, b = F.pow(F.col(pred) - F.col(returns), F.lit(2.0)), F.pow(bounded - F.col(returns), F.lit(2.0))
    m = F.col(mask)
    mean = lambda x: F.sum(x * m) / (F.sum(m) + F.lit(1e-8))
    return df.agg((mean(F.greatest(a, b)) * 0.5).alias("vf_loss"), mean((b > a).cast("double")).alias("clip_frac"))


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def reward_model_ce(df: DataFrame, sequence: str, score: str, mask: str, acc: str, beta: float) -> DataFrame:
    """Binary cross entropy of sigmoid(beta x sum of scores) against accuracy."""
    per = df.groupBy(sequence).agg(F.sum(F.col(score) * F.col(mask)).alias("_q"), F.max(acc).alias("_acc"))
    p = sigmoid(F.col("_q") * F.lit(beta))
    return per.agg((-F.avg(F.col("_acc") * F.log(p) + (1 - F.col("_acc")) * F.log(1 - p))).alias("loss"))


def absolute_accuracy(df: DataFrame, sequence: str, score: str, mask: str, acc: str) -> DataFrame:
    """Share of sequences whose score sum has the sign of 2 acc - 1."""
    per = df.groupBy(sequence).agg(F.sum(F.col(score) * F.col(mask)).alias("_q"), F.max(acc).alias("_acc"))
    return per.agg(F.avg((F.signum("_q") == F.signum(2 * F.col("_acc") - 1)).cast("double")).alias("accuracy"))


def pairwise_accuracy(df: DataFrame, group: str, index: str, score: str, acc: str) -> DataFrame:
    """Per group: agreement of the signs of score and accuracy differences over pairs i < j, weighted by |difference of acc|.

    Rows of a group meet by an equi-join on the group; groups are the rollouts of one prompt. 0.5 when all accuracies agree.
    """
    one, two = df.select(group, index, score, acc), df.select(group, F.col(index).alias("_j"), F.col(score).alias("_s"), F.col(acc).alias("_a"))
    pairs = one.join(two, group).where(F.col(index) < F.col("_j"))
    weight = F.abs(F.col(acc) - F.col("_a"))
    agree = ((F.col(score) > F.col("_s")) == (F.col(acc) > F.col("_a"))).cast("double")
    return pairs.groupBy(group).agg(F.when(F.sum(weight) > 0, F.sum(weight * agree) / F.sum(weight)).otherwise(F.lit(0.5)).alias("accuracy"))


def online_dpo(policy_chosen: Column, policy_rejected: Column, ref_chosen: Column, ref_rejected: Column, beta: float, smoothing: float = 0.0, kind: str = "sigmoid") -> Column:
    """Preference loss on the difference of log-ratios: sigmoid with label smoothing, or the squared (IPO) form."""
    logits = (policy_chosen - policy_rejected) - (ref_chosen - ref_rejected)
    if kind == "sigmoid":
        return -F.log(sigmoid(logits * beta)) * (1 - smoothing) - F.log(sigmoid(-logits * beta)) * smoothing
    if kind == "ipo":
        return F.pow(logits - F.lit(1 / (2 * beta)), F.lit(2.0))
    raise ValueError(f"unknown preference loss {kind!r}")


def sequence_log_probs(df: DataFrame, sequence: str, log_prob: str, label: str, mean: bool = False, ignore: int = -100) -> DataFrame:
    """Sum or mean of log-probabilities of labels other than ``ignore``."""
    x = F.when(F.col(label) != ignore, F.col(log_prob))
    return df.groupBy(sequence).agg((F.avg(x) if mean else F.coalesce(F.sum(x), F.lit(0.0))).alias("logps"))


def sppo_loss(df: DataFrame, sequence: str, old: str, new: str, reward: str, mask: str, eta: float = 1.0) -> DataFrame:
    """Mean of (sum new - sum old - eta x reward)^2 over sequences with any valid token."""
    m = F.col(mask)
    per = df.groupBy(sequence).agg(F.sum((F.col(new) - F.col(old)) * m).alias("_d"), F.max(reward).alias("_r"), F.max(m).alias("_any"))
    return per.where("_any > 0").agg(F.avg(F.pow(F.col("_d") - F.lit(eta) * F.col("_r"), F.lit(2.0))).alias("loss"))
