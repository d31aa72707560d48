"""Votes over a prompt group: majority, entropy, unanimity, medoid-free statistics and values of the majority."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Label of a group in which no answer could be read (a fixed value instead of a random letter).
NO_LABEL = "(none)"


def majority_vote(df: DataFrame, group: str = "prompt_id", order: str = "rollout_idx", answer: str = "answer", n_choices: int = 4) -> DataFrame:
    """One row per group: label (most common answer, first seen wins ties), ratio over all rows, and vote statistics.

    The entropy is that of the read answers over log2 of ``n_choices``; more distinct answers can take it above one.
    Answers are counted by (group, answer) first, so a group of any size reaches its final row as few counts.
    """
    counted = df.groupBy(group, F.trim(answer).alias("_a")).agg(F.count(F.lit(1)).alias("_c"), F.min(order).alias("_f"))
    read = F.col("_a").isNotNull() & (F.col("_a") != "")
    votes = counted.groupBy(group).agg(
        F.max_by(F.when(read, F.col("_a")), F.when(read, F.struct("_c", -F.col("_f")))).alias("label"),
        F.coalesce(F.max(F.when(read, F.col("_c"))), F.lit(0)).alias("_top"),
        F.sum("_c").alias("n_total"),
        F.coalesce(F.sum(F.when(~read | F.col("_a").isNull(), F.col("_c"))), F.lit(0)).alias("n_unparseable"),
        F.count_if(read).alias("n_unique_answers"),
        F.coalesce(F.sum(F.when(read, F.col("_c") * F.log2("_c"))), F.lit(0.0)).alias("_clog"),
        F.coalesce(F.sum(F.when(read, F.col("_c"))), F.lit(0)).alias("_parsed"),
    )
    entropy = F.when(F.col("_parsed") > 0, (F.log2("_parsed") - F.col("_clog") / F.col("_parsed")) / F.log2(F.lit(float(n_choices)))).otherwise(F.lit(0.0))
    return votes.select(
        group, F.coalesce("label", F.lit(NO_LABEL)).alias("label"), (F.col("_top") / F.col("n_total")).alias("ratio"), "n_total", "n_unparseable", "n_unique_answers",
        entropy.alias("vote_entropy"), ((F.col("n_unique_answers") == 1) & (F.col("n_unparseable") == 0)).alias("unanimous"),
    )


def majority_value(df: DataFrame, group: str, order: str, vote: str, value: str) -> DataFrame:
    """Value of the first row that holds the most common vote of the group (first-inserted vote wins ties)."""
    counted = df.groupBy(group, vote).agg(F.count(F.lit(1)).alias("_c"), F.min(order).alias("_f"), F.min_by(value, order).alias("_v"))
    return counted.groupBy(group).agg(F.max_by("_v", F.struct("_c", -F.col("_f"))).alias("majority_value"))


def prompt_metrics(df: DataFrame, group: str, majority_reward: str, true_reward: str, label_ok: str) -> DataFrame:
    """Per prompt: label accuracy, share of equal rewards, mean rewards, and pass@n (sum of true rewards of one or more)."""
    return df.groupBy(group).agg(
        F.max(F.col(label_ok).cast("double")).alias("label_accuracy"),
        F.avg((F.abs(F.col(majority_reward) - F.col(true_reward)) < 1e-4).cast("double")).alias("reward_accuracy"),
        F.avg(majority_reward).alias("majority_reward"),
        F.avg(true_reward).alias("true_reward"),
        (F.sum(true_reward) >= 1).cast("double").alias("pass_n"),
    )


def batch_metrics(per_prompt: DataFrame) -> DataFrame:
    return per_prompt.agg(*[F.avg(c).alias(c) for c in ("label_accuracy", "reward_accuracy", "majority_reward", "true_reward", "pass_n")], F.count(F.lit(1)).alias("prompts"))


def one_label_per_prompt(df: DataFrame, group: str, label: str) -> DataFrame:
    """Groups with more than one label; empty when the batch is sound."""
    return df.groupBy(group).agg(F.count_distinct(label).alias("labels")).where("labels > 1")


def apply_label(df: DataFrame, votes: DataFrame, group: str, truth: str) -> DataFrame:
    """``truth`` becomes the voted label; the original stays in original_gt."""
    return df.withColumnRenamed(truth, "original_gt").join(votes.select(group, F.col("label").alias(truth)), group)


def restore_label(df: DataFrame, truth: str) -> DataFrame:
    return df.drop(truth).withColumnRenamed("original_gt", truth)


def zero_variance_groups(df: DataFrame, group: str, score: str) -> DataFrame:
    spread = df.groupBy(group).agg(F.stddev_pop(score).alias("_s"))
    return spread.agg(F.count_if(F.col("_s") < 1e-6).alias("flat_groups"), F.count(F.lit(1)).alias("groups"))


def win_rates(df: DataFrame, group: str, verdict: str, flipped: str) -> DataFrame:
    """Pairwise verdicts in both orders to one score per group; unread verdicts count as ties."""
    score = F.when(F.col(verdict) == "A>>B", 1.0).when(F.col(verdict) == "A>B", 0.5).when(F.col(verdict) == "B>A", -0.5).when(F.col(verdict) == "B>>A", -1.0).otherwise(0.0)
    signed = F.when(F.col(flipped), -score).otherwise(score)
    return df.groupBy(group).agg(F.avg(signed).alias("score"), F.count(F.lit(1)).alias("orders"))


def win_summary(scores: DataFrame) -> DataFrame:
    s = F.col("score")
    return scores.agg(F.count_if(s > 0).alias("wins"), F.count_if(s == 0).alias("ties"), F.count_if(s < 0).alias("losses"), (F.avg((s + 1) / 2) * 100).alias("winrate"))


def swap_orders(df: DataFrame) -> DataFrame:
    """Every pair twice: the model as A, then as B."""
    return df.withColumn("model_is_a", F.explode(F.array(F.lit(True), F.lit(False))))


def pair_preferences(df: DataFrame, index: str, score: str) -> DataFrame:
    """Adjacent rows are a pair; the higher score wins, the first row wins ties."""
    pair = Window.partitionBy("pair").orderBy(F.col(score).desc(), index)
    return df.withColumn("pair", F.floor(F.col(index) / 2)).withColumn("preferred", F.row_number().over(pair) == 1)


#: Largest number of different answers of one group that are compared with each other.
MOST_ANSWERS = 20_000


def equivalence_votes(df: DataFrame, group: str, order: str, answer: str, same: Callable[[str, str], bool]) -> DataFrame:
    """(group, representative, votes) of greedy classes: an answer joins the first class whose representative it equals.

    Copies of an answer are counted before they are gathered, so a group with very many rows is as small as the number
    of its different answers; beyond MOST_ANSWERS of these it is refused. Answers come in the order of their first
    row; null answers have no vote.
    """
    kind = df.schema[group].dataType.simpleString()
    counted = df.where(F.col(answer).isNotNull()).groupBy(group, F.col(answer).cast("string").alias("_a")).agg(F.min(order).alias("_o"), F.count(F.lit(1)).alias("_n"))

    def classes(part: pd.DataFrame) -> pd.DataFrame:
        if len(part) > MOST_ANSWERS:
            raise ValueError("too many different answers in one group")
        heads: list[str] = []
        votes: list[int] = []
        for a, n in part.sort_values("_o")[["_a", "_n"]].itertuples(index=False):
            at = next((k for k, head in enumerate(heads) if head == a or same(head, a)), None)
            if at is None:
                heads.append(a)
                votes.append(n)
            else:
                votes[at] += n
        return pd.DataFrame({group: part[group].iloc[0], "representative": heads, "votes": votes})

    return counted.groupBy(group).applyInPandas(classes, f"{group} {kind}, representative string, votes long")
