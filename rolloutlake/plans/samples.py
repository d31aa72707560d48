"""Filter, sample and split queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from rolloutlake.operators import sampling as sm


def t(name):
    return lambda s, d: s.read.parquet(f"{d}/{name}.parquet")


train, sanity, events, docs, math1 = t("train_sanity"), t("sanity"), t("events"), t("documents"), t("math_l1_ttt")

STRIP = "regexp_replace(regexp_replace(coalesce({0}, ''), '^\\s+', ''), '\\s+$', '')"
MD5 = "CAST('0x' || substr(md5('{seed}:' || {key}), 1, 13) AS BIGINT)"
H = MD5.format(seed=42, key="row_id")
HE = MD5.format(seed=42, key="event_id")


def _best(s, d):
    items = math1(s, d).where("solution IS NOT NULL").groupBy("batch", "split").agg(F.array_sort(F.collect_list(F.struct("row_id", F.col("solution").alias("response"), (F.length("solution") % 7).cast("double").alias("overall_score")))).alias("completions"))
    return sm.best_response(items, "completions").select("batch", "split", "best")


CATALOG = {
    "filter_overlong": (
        lambda s, d: sm.within_length(train(s, d), F.split("question", " "), 45).select("row_id"),
        "SELECT row_id FROM train_sanity WHERE len(string_split(question, ' ')) <= 45",
    ),
    "filter_clean_pairs": (
        lambda s, d: sm.clean_pairs(math1(s, d), "prompt", "solution", 40, 260, 150).select("row_id"),
        f"SELECT row_id FROM math_l1_ttt WHERE length({STRIP.format('prompt')}) BETWEEN 40 AND 260 AND length(coalesce(solution, '')) <= 150",
    ),
    "pick_best_response": (
        _best,
        """SELECT batch, split, arg_max(solution, struct_pack(a := length(solution) % 7, b := -row_id)) FILTER (length(trim(solution)) > 0) AS best
           FROM math_l1_ttt WHERE solution IS NOT NULL GROUP BY 1, 2""",
    ),
    "filter_required_fields": (
        lambda s, d: sm.required_fields(train(s, d), "question", "answer", "video_file").select("row_id"),
        "SELECT row_id FROM train_sanity WHERE " + " AND ".join(f"length({STRIP.format(c)}) > 0" for c in ("question", "answer", "video_file")),
    ),
    "filter_label_present": (lambda s, d: sm.label_present(sanity(s, d), "answer").select("row_id"), "SELECT row_id FROM sanity WHERE length(answer) > 0"),
    "filter_question_type": (lambda s, d: sm.of_type(train(s, d), "question_type", "Causal").select("row_id"), "SELECT row_id FROM train_sanity WHERE trim(question_type) = 'Causal'"),
    "filter_category_list": (
        lambda s, d: sm.in_list(train(s, d), "content_parent_category", "Sports, Lifestyle,Animals").select("row_id"),
        "SELECT row_id FROM train_sanity WHERE trim(content_parent_category) IN ('Sports', 'Lifestyle', 'Animals')",
    ),
    "sample_stratified": (
        lambda s, d: sm.stratified_sample(train(s, d), "content_parent_category", 5, "row_id").select("stratum", "row_id"),
        f"""SELECT stratum, row_id FROM (SELECT coalesce(nullif(trim(content_parent_category), ''), '(Uncategorized)') AS stratum, row_id,
            row_number() OVER (PARTITION BY coalesce(nullif(trim(content_parent_category), ''), '(Uncategorized)') ORDER BY {H}, row_id) AS k FROM train_sanity) WHERE k <= 5""",
    ),
    "sample_uniform": (
        lambda s, d: sm.uniform_sample(train(s, d), 200, "row_id").select("row_id"),
        f"SELECT row_id FROM train_sanity ORDER BY {H}, row_id LIMIT 200",
    ),
    "split_three_way": (
        lambda s, d: sm.ratio_split(events(s, d), [("sanity", 0.01), ("test", 0.2), ("train", 0.79)], "event_id").select("event_id", "split"),
        f"""SELECT event_id, CASE WHEN k <= floor(n * 0.01 + 1e-9) THEN 'sanity' WHEN k <= floor(n * 0.21 + 1e-9) THEN 'test' ELSE 'train' END AS split
            FROM (SELECT event_id, row_number() OVER (ORDER BY {HE}, event_id) AS k, count(*) OVER () AS n FROM events)""",
    ),
    "split_ratio": (
        lambda s, d: sm.ratio_split(events(s, d), [("train", 0.9), ("test", 0.1)], "event_id").select("event_id", "split"),
        f"""SELECT event_id, CASE WHEN k <= floor(n * 0.9 + 1e-9) THEN 'train' ELSE 'test' END AS split
            FROM (SELECT event_id, row_number() OVER (ORDER BY {HE}, event_id) AS k, count(*) OVER () AS n FROM events)""",
    ),
    "distinct_top_k": (
        lambda s, d: sm.distinct_top_k(events(s, d), "user_id", "event_type", "event_id", 8).select("user_id", "event_id"),
        """WITH a AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id, trim(event_type) ORDER BY event_id) AS s FROM events),
           b AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN s = 1 AND trim(event_type) <> '' THEN 0 ELSE 1 END, event_id) AS k FROM a)
           SELECT user_id, event_id FROM b WHERE k <= 8""",
    ),
    "first_k_per_group": (
        lambda s, d: sm.first_k(events(s, d), "user_id", "event_id", 4).select("user_id", "event_id"),
        "SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) <= 4",
    ),
    "filter_zero_variance": (
        lambda s, d: sm.varied_groups(math1(s, d).withColumn("score", F.when(F.col("solution").contains("boxed"), 1.0).otherwise(0.0)), "unique_id", "score").select("row_id"),
        """SELECT row_id FROM (SELECT row_id, stddev_pop(s) OVER (PARTITION BY unique_id) AS sd, count(*) OVER (PARTITION BY unique_id) AS n
           FROM (SELECT row_id, unique_id, CASE WHEN contains(solution, 'boxed') THEN 1.0 ELSE 0.0 END AS s FROM math_l1_ttt)) WHERE sd > 0 OR n = 1""",
    ),
    "filter_accuracy_band": (
        lambda s, d: sm.accuracy_band(events(s, d).withColumn("len", F.col("event_id") % 100), "user_id", "value", "len", 45.0, 55.0, 101).select("event_id", "passes"),
        "SELECT event_id, avg(value) OVER w BETWEEN 45 AND 55 AND max(event_id % 100) OVER w < 100 AS passes FROM events WINDOW w AS (PARTITION BY user_id)",
    ),
    "resample_weights_pow": (
        lambda s, d: sm.resample_weights(events(s, d), "value").select("event_id", F.round("weight", 4).alias("weight")),
        "SELECT event_id, round(greatest(abs(value) ** 2, 1e-8), 4) AS weight FROM events",
    ),
    "resample_weights_extremes": (
        lambda s, d: sm.resample_weights(events(s, d), "value", "max_min").groupBy("weight").agg(F.count("*").alias("n")),
        "SELECT CASE WHEN value IN ((SELECT min(value) FROM events), (SELECT max(value) FROM events)) THEN 1.0 ELSE 1e-8 END AS weight, count(*) AS n FROM events GROUP BY 1",
    ),
    "resample_weights_max": (
        lambda s, d: sm.resample_weights(events(s, d), "value", "max_random").groupBy("weight").agg(F.count("*").alias("n")),
        "SELECT CAST(CASE WHEN value = (SELECT max(value) FROM events) THEN 0.4 ELSE 0.1 END AS DOUBLE) AS weight, count(*) AS n FROM events GROUP BY 1",
    ),
    "resample_draws": (lambda s, d: sm.weighted_resample(sm.resample_weights(events(s, d), "value"), "weight", 1000, "event_id").agg(F.sum("draws").alias("draws")), "SELECT CAST(1000 AS BIGINT) AS draws"),
    "drop_columns": (
        lambda s, d: sm.without(train(s, d), "audio_file", "video_file", "source", "id", "video_id", "question_type", "content_parent_category", "content_fine_category", "split", "batch", "created_at", "ingested_at"),
        "SELECT row_id, question, answer FROM train_sanity",
    ),
    "drop_metric_patterns": (
        lambda s, d: sm.drop_metrics(events(s, d), "event_type", ["ick", "log"]).select("event_id"),
        "SELECT event_id FROM events WHERE NOT contains(event_type, 'ick') AND NOT contains(event_type, 'log')",
    ),
    "rewrite_with_drop_counts": (
        lambda s, d: sm.keep_with_counts(train(s, d), F.col("question").rlike("(?m)^D[.)]"))[1],
        "SELECT count(*) AS total, count(*) FILTER (regexp_matches(question, '(?m)^D[.)]')) AS kept, count(*) - count(*) FILTER (regexp_matches(question, '(?m)^D[.)]')) AS dropped FROM train_sanity",
    ),
}
