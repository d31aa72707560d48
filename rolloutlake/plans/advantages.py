"""Advantage queries: an event is a rollout, its user the prompt, its value the reward."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rolloutlake.operators import advantage as adv


def rollouts(spark: SparkSession, d: str) -> DataFrame:
    """events read as rollouts: prompt_id, rollout_idx (order), score, length, answer."""
    return spark.read.parquet(f"{d}/events.parquet").select(
        F.col("user_id").alias("prompt_id"),
        F.col("event_id").alias("rollout_idx"),
        F.col("value").alias("score"),
        (F.col("event_id") % 7 + 1).alias("length"),
        F.col("event_type").alias("answer"),
    )


R = "(SELECT user_id AS prompt_id, event_id AS rollout_idx, value AS score, event_id % 7 + 1 AS length, event_type AS answer FROM events)"


def _out(df: DataFrame) -> DataFrame:
    return df.select("prompt_id", "rollout_idx", F.round("advantage", 6).alias("advantage"))


def _adv(name: str, **options):
    return lambda spark, d: _out(adv.advantage(rollouts(spark, d), name, **options))


W = "WINDOW w AS (PARTITION BY prompt_id)"

CATALOG = {
    "adv_grpo": (
        _adv("grpo"),
        f"""SELECT prompt_id, rollout_idx, round(CASE WHEN count(*) OVER w = 1 THEN score / (1 + 1e-6)
            ELSE (score - avg(score) OVER w) / (stddev_samp(score) OVER w + 1e-6) END, 6) AS advantage FROM {R} {W}""",
    ),
    "adv_grpo_mean_only": (
        _adv("grpo", by_std=False),
        f"SELECT prompt_id, rollout_idx, round(CASE WHEN count(*) OVER w = 1 THEN score ELSE score - avg(score) OVER w END, 6) AS advantage FROM {R} {W}",
    ),
    "adv_grpo_confidence": (
        lambda s, d: _out(adv.grpo(rollouts(s, d).withColumn("conf", F.col("length") / 7.0), confidence="conf")),
        f"""SELECT prompt_id, rollout_idx, round(CASE WHEN count(*) OVER w = 1 THEN score / (1 + 1e-6)
            ELSE (score - avg(score) OVER w) / (stddev_samp(score) OVER w + 1e-6) END * exp(length / 7.0 - 1), 6) AS advantage FROM {R} {W}""",
    ),
    "adv_grpo_passk": (
        lambda s, d: _out(adv.advantage(rollouts(s, d).withColumn("n", F.count("*").over(Window.partitionBy("prompt_id"))).where("n > 1"), "grpo_passk")),
        f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY prompt_id ORDER BY score DESC, rollout_idx) AS k, count(*) OVER (PARTITION BY prompt_id) AS n,
                   stddev_samp(score) OVER (PARTITION BY prompt_id) AS sd FROM {R}),
            g AS (SELECT prompt_id, max(score) FILTER (k = 1) - max(score) FILTER (k = 2) AS gap FROM r WHERE n > 1 GROUP BY 1)
            SELECT prompt_id, rollout_idx, round(CASE WHEN k = 1 THEN gap / (sd + 1e-6) ELSE 0 END, 6) AS advantage FROM r JOIN g USING (prompt_id) WHERE n > 1""",
    ),
    "adv_rloo": (
        _adv("rloo"),
        f"""SELECT prompt_id, rollout_idx, round(CASE WHEN count(*) OVER w > 1 THEN score * count(*) OVER w / (count(*) OVER w - 1)
            - avg(score) OVER w * count(*) OVER w / (count(*) OVER w - 1) ELSE score END, 6) AS advantage FROM {R} {W}""",
    ),
    "adv_opo": (
        _adv("opo"),
        f"""SELECT prompt_id, rollout_idx, round(score - CASE WHEN count(*) OVER w > 1 THEN sum(length * score) OVER w / sum(length) OVER w ELSE 0 END, 6) AS advantage
            FROM {R} {W}""",
    ),
    "adv_remax": (
        _adv("remax"),
        f"SELECT prompt_id, rollout_idx, round(sum(score) OVER (PARTITION BY prompt_id ORDER BY rollout_idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 6) AS advantage FROM {R}",
    ),
    "adv_reinforce_pp_baseline": (
        _adv("reinforce_plus_plus_baseline"),
        f"""WITH c AS (SELECT prompt_id, rollout_idx, CASE WHEN count(*) OVER w > 1 THEN score - avg(score) OVER w ELSE 0 END AS c FROM {R} {W})
            SELECT prompt_id, rollout_idx, round((c - (SELECT avg(c) FROM c)) / sqrt((SELECT var_samp(c) FROM c) + 1e-8), 6) AS advantage FROM c""",
    ),
    "adv_sppo": (
        lambda s, d: _out(adv.sppo(rollouts(s, d).withColumn("score", F.col("score") / 100), beta=2.0)),
        f"""WITH r AS (SELECT prompt_id, rollout_idx, score / 100 AS s FROM {R})
            SELECT prompt_id, rollout_idx, round(s - (ln(sum(exp(2 * s)) OVER w) - ln(count(*) OVER w)) / 2, 6) AS advantage FROM r {W}""",
    ),
    "adv_softmean_zero": (
        lambda s, d: _out(adv.sppo(rollouts(s, d), beta=0)),
        f"SELECT prompt_id, rollout_idx, round(score - avg(score) OVER w, 6) AS advantage FROM {R} {W}",
    ),
}
