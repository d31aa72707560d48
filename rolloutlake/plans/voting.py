"""Vote, join and metric queries on events as rollouts and on the record tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from rolloutlake.operators import metrics as mt
from rolloutlake.operators import votes as vt
from rolloutlake.plans.advantages import R, rollouts


def t(name):
    return lambda s, d: s.read.parquet(f"{d}/{name}.parquet")


def _r(df, *columns, digits=6):
    kept = [c for c in df.columns if c not in columns]
    return df.select(*kept, *[F.round(c, digits).alias(c) for c in columns])


def _answers(s, d):
    """Rollouts whose answer is null for every seventh and a letter A to E otherwise."""
    letter = F.element_at(F.array(*[F.lit(x) for x in "ABCDE"]), (F.col("rollout_idx") % 5 + 1).cast("int"))
    return rollouts(s, d).withColumn("answer", F.when(F.col("rollout_idx") % 7 == 0, None).otherwise(letter))


A = f"(SELECT prompt_id, rollout_idx, score, CASE WHEN rollout_idx % 7 = 0 THEN NULL ELSE substr('ABCDE', CAST(rollout_idx % 5 + 1 AS INT), 1) END AS answer FROM {R})"
VOTE = f"""WITH c AS (SELECT prompt_id, answer, count(*) AS c, min(rollout_idx) AS f FROM {A} GROUP BY 1, 2),
  p AS (SELECT prompt_id, sum(c) FILTER (answer IS NOT NULL) AS parsed, sum(c) AS n_total FROM c GROUP BY 1),
  v AS (SELECT prompt_id, arg_max(answer, struct_pack(c := c, f := -f)) FILTER (answer IS NOT NULL) AS label, max(c) FILTER (answer IS NOT NULL) AS top,
        coalesce(sum(c) FILTER (answer IS NULL), 0) AS n_unparseable, count(answer) AS n_unique_answers FROM c GROUP BY 1),
  e AS (SELECT prompt_id, sum(-(c / parsed) * log2(c / parsed)) / 2 AS h FROM c JOIN p USING (prompt_id) WHERE answer IS NOT NULL GROUP BY 1),
  votes AS (SELECT prompt_id, coalesce(label, '(none)') AS label, coalesce(top, 0) / n_total AS ratio, n_total, n_unparseable, n_unique_answers, coalesce(h, 0) AS vote_entropy,
        n_unique_answers = 1 AND n_unparseable = 0 AS unanimous FROM v JOIN p USING (prompt_id) LEFT JOIN e USING (prompt_id))"""


def _verdicts(s, d):
    v = F.element_at(F.array(*[F.lit(x) for x in ("A>>B", "A>B", "A=B", "B>A", "B>>A", "?")]), (F.col("event_id") % 6 + 1).cast("int"))
    return t("events")(s, d).withColumn("verdict", v).withColumn("flipped", F.col("event_id") % 2 == 0)


VERDICTS = """(SELECT user_id, CASE WHEN event_id % 2 = 0 THEN -1 ELSE 1 END * CASE event_id % 6 WHEN 0 THEN 1.0 WHEN 1 THEN 0.5 WHEN 3 THEN -0.5 WHEN 4 THEN -1.0 ELSE 0.0 END AS sc FROM events)"""


def _rewards(s, d):
    return rollouts(s, d).withColumn("mr", (F.col("rollout_idx") % 3 == 0).cast("double")).withColumn("tr", (F.col("rollout_idx") % 5 == 0).cast("double")).withColumn("ok", F.col("prompt_id") % 2 == 0)


REWARDS = f"(SELECT *, CAST(rollout_idx % 3 = 0 AS DOUBLE) AS mr, CAST(rollout_idx % 5 = 0 AS DOUBLE) AS tr, prompt_id % 2 = 0 AS ok FROM {R})"
PER_PROMPT = f"""SELECT prompt_id, max(CAST(ok AS DOUBLE)) AS label_accuracy, avg(CAST(abs(mr - tr) < 1e-4 AS DOUBLE)) AS reward_accuracy, avg(mr) AS majority_reward,
   avg(tr) AS true_reward, CAST(sum(tr) >= 1 AS DOUBLE) AS pass_n FROM {REWARDS} GROUP BY 1"""
MEANS = ("label_accuracy", "reward_accuracy", "majority_reward", "true_reward", "pass_n")


def _judged(s, d):
    return t("math_l1_ttt")(s, d).select("batch", "split", F.when(F.col("solution").contains("boxed"), 1.0).when(F.col("solution").isNull(), 0.5).otherwise(0.0).alias("score"), F.col("solution").isNotNull().alias("parsed"))


JUDGED = "(SELECT batch, split, CASE WHEN contains(solution, 'boxed') THEN 1.0 WHEN solution IS NULL THEN 0.5 ELSE 0.0 END AS score, solution IS NOT NULL AS parsed FROM math_l1_ttt)"


def _best(k, worst):
    return lambda s, d: _r(mt.best_at_k(rollouts(s, d), "prompt_id", "score", k, worst), "best_at_k")


def _best_sql(k, worst):
    order = "DESC" if worst else "ASC"
    return f"""SELECT prompt_id, round(sum(score * (pow(i / n, {k}) - pow((i - 1) / n, {k}))), 6) AS best_at_k FROM
        (SELECT prompt_id, score, row_number() OVER (PARTITION BY prompt_id ORDER BY score {order}) AS i, count(*) OVER (PARTITION BY prompt_id) AS n FROM {R}) GROUP BY 1"""


CATALOG = {
    "vote_majority": (lambda s, d: _r(vt.majority_vote(_answers(s, d)), "ratio", "vote_entropy"), VOTE + " SELECT prompt_id, label, round(ratio, 6) AS ratio, CAST(n_total AS BIGINT) AS n_total, CAST(n_unparseable AS BIGINT) AS n_unparseable, n_unique_answers, round(vote_entropy, 6) AS vote_entropy, unanimous FROM votes"),
    "vote_majority_value": (
        lambda s, d: _r(vt.majority_value(rollouts(s, d), "prompt_id", "rollout_idx", "answer", "score"), "majority_value"),
        f"""WITH c AS (SELECT prompt_id, answer, count(*) AS c, min(rollout_idx) AS f, arg_min(score, rollout_idx) AS v FROM {R} GROUP BY 1, 2)
            SELECT prompt_id, round(arg_max(v, struct_pack(c := c, f := -f)), 6) AS majority_value FROM c GROUP BY 1""",
    ),
    "vote_apply_label": (
        lambda s, d: vt.apply_label(rollouts(s, d).withColumn("truth", F.lit("x")), vt.majority_vote(_answers(s, d)), "prompt_id", "truth").select("rollout_idx", "original_gt", "truth"),
        VOTE + f" SELECT rollout_idx, 'x' AS original_gt, label AS truth FROM {R} JOIN votes USING (prompt_id)",
    ),
    "vote_restore_label": (
        lambda s, d: vt.restore_label(vt.apply_label(rollouts(s, d).withColumn("truth", F.col("answer")), vt.majority_vote(_answers(s, d)), "prompt_id", "truth"), "truth").select("rollout_idx", "truth"),
        f"SELECT rollout_idx, answer AS truth FROM {R}",
    ),
    "vote_batch_means": (
        lambda s, d: _r(vt.majority_vote(_answers(s, d)).agg(F.avg("ratio").alias("ratio"), F.avg("vote_entropy").alias("entropy"), F.avg(F.col("unanimous").cast("double")).alias("unanimous"), F.avg("n_unique_answers").alias("unique_answers")), "ratio", "entropy", "unanimous", "unique_answers"),
        VOTE + " SELECT round(avg(ratio), 6) AS ratio, round(avg(vote_entropy), 6) AS entropy, round(avg(CAST(unanimous AS DOUBLE)), 6) AS unanimous, round(avg(n_unique_answers), 6) AS unique_answers FROM votes",
    ),
    "prompt_metrics": (lambda s, d: _r(vt.prompt_metrics(_rewards(s, d), "prompt_id", "mr", "tr", "ok"), *MEANS), f"SELECT prompt_id, {', '.join(f'round({c}, 6) AS {c}' for c in MEANS)} FROM ({PER_PROMPT})"),
    "batch_metrics": (
        lambda s, d: _r(vt.batch_metrics(vt.prompt_metrics(_rewards(s, d), "prompt_id", "mr", "tr", "ok")), *MEANS),
        f"SELECT count(*) AS prompts, {', '.join(f'round(avg({c}), 6) AS {c}' for c in MEANS)} FROM ({PER_PROMPT})",
    ),
    "vote_one_label_check": (lambda s, d: vt.one_label_per_prompt(rollouts(s, d), "prompt_id", "answer"), f"SELECT prompt_id, count(DISTINCT answer) AS labels FROM {R} GROUP BY 1 HAVING count(DISTINCT answer) > 1"),
    "zero_variance_groups": (
        lambda s, d: vt.zero_variance_groups(t("math_l1_ttt")(s, d).withColumn("sc", F.col("solution").contains("boxed").cast("double")), "unique_id", "sc"),
        "SELECT count(*) FILTER (sd < 1e-6) AS flat_groups, count(*) AS groups FROM (SELECT unique_id, stddev_pop(CAST(contains(solution, 'boxed') AS DOUBLE)) AS sd FROM math_l1_ttt GROUP BY 1)",
    ),
    "pairwise_win_rates": (lambda s, d: _r(vt.win_rates(_verdicts(s, d), "user_id", "verdict", "flipped"), "score"), f"SELECT user_id, round(avg(sc), 6) AS score, count(*) AS orders FROM {VERDICTS} GROUP BY 1"),
    "pairwise_win_summary": (
        lambda s, d: _r(vt.win_summary(vt.win_rates(_verdicts(s, d), "user_id", "verdict", "flipped")), "winrate"),
        f"SELECT count(*) FILTER (x > 0) AS wins, count(*) FILTER (x = 0) AS ties, count(*) FILTER (x < 0) AS losses, round(avg((x + 1) / 2) * 100, 6) AS winrate FROM (SELECT avg(sc) AS x FROM {VERDICTS} GROUP BY user_id)",
    ),
    "pairwise_swap_orders": (lambda s, d: vt.swap_orders(t("events")(s, d).select("event_id")), "SELECT event_id, b AS model_is_a FROM events, (VALUES (true), (false)) v(b)"),
    "pair_preferences": (
        lambda s, d: vt.pair_preferences(rollouts(s, d), "rollout_idx", "score").select("rollout_idx", "pair", "preferred"),
        f"SELECT rollout_idx, rollout_idx // 2 AS pair, row_number() OVER (PARTITION BY rollout_idx // 2 ORDER BY score DESC, rollout_idx) = 1 AS preferred FROM {R}",
    ),
    "best_at_4": (_best(4, False), _best_sql(4, False)),
    "best_at_16": (_best(16, False), _best_sql(16, False)),
    "worst_at_4": (_best(4, True), _best_sql(4, True)),
    "bootstrap_best_worst": (lambda s, d: mt.bootstrap_groups(rollouts(s, d), "prompt_id", "rollout_idx", "score", 4, 200), None),
    "validation_metrics": (
        lambda s, d: _r(mt.validation_metrics(rollouts(s, d), "answer", "prompt_id", "score", 4), "value"),
        f"""WITH g AS (SELECT answer, prompt_id, score, count(*) OVER w AS n, row_number() OVER (PARTITION BY answer, prompt_id ORDER BY score) AS i,
               row_number() OVER (PARTITION BY answer, prompt_id ORDER BY score DESC) AS j FROM {R} WINDOW w AS (PARTITION BY answer, prompt_id)),
            p AS (SELECT answer, prompt_id, avg(score) AS m, stddev_pop(score) AS s, sum(score * (pow(i / n, 4) - pow((i - 1) / n, 4))) AS b, sum(score * (pow(j / n, 4) - pow((j - 1) / n, 4))) AS w FROM g GROUP BY 1, 2),
            x AS (SELECT answer, avg(m) AS m, avg(s) AS s, avg(b) AS b, avg(w) AS w FROM p GROUP BY 1)
            SELECT answer AS data_source, 'mean@n' AS metric, round(m, 6) AS value FROM x UNION ALL SELECT answer, 'std@n', round(s, 6) FROM x
            UNION ALL SELECT answer, 'best@4/mean', round(b, 6) FROM x UNION ALL SELECT answer, 'worst@4/mean', round(w, 6) FROM x""",
    ),
    "metric_sections": (
        lambda s, d: mt.validation_metrics(rollouts(s, d), "answer", "prompt_id", "score", 4).select("data_source", "metric", mt.metric_section(F.lit("acc"), F.col("metric"), 4, "acc").alias("section")),
        f"""SELECT answer AS data_source, m AS metric, CASE WHEN m = 'best@4/mean' THEN 'val-core' ELSE 'val-aux' END AS section
            FROM (SELECT DISTINCT answer FROM {R}), (VALUES ('mean@n'), ('std@n'), ('best@4/mean'), ('worst@4/mean')) v(m)""",
    ),
    "judge_summary": (
        lambda s, d: _r(mt.score_summary(_judged(s, d), "batch"), "mean", "std", "frac_zero", "frac_full", "parse_rate"),
        f"""SELECT batch, round(avg(score), 6) AS mean, round(coalesce(stddev_samp(score), 0), 6) AS std, round(avg(CAST(score = 0 AS DOUBLE)), 6) AS frac_zero, round(avg(CAST(score = 1 AS DOUBLE)), 6) AS frac_full,
            round(avg(CAST(parsed AS DOUBLE)), 6) AS parse_rate, count(*) AS n FROM {JUDGED} GROUP BY 1""",
    ),
    "judge_rollup": (
        lambda s, d: _r(mt.total_and_categories(_judged(s, d), "batch", "split", "score"), "mean"),
        f"SELECT batch, split, round(avg(score), 6) AS mean, count(*) AS n, CAST(grouping_id(batch, split) AS BIGINT) AS level FROM {JUDGED} GROUP BY ROLLUP (batch, split) HAVING grouping_id(batch, split) < 3",
    ),
    "mean_of_means": (
        lambda s, d: _r(mt.mean_of_means(t("events")(s, d), "event_type", "user_id", "value"), "mean"),
        "SELECT event_type, round(avg(m), 6) AS mean, count(*) AS n FROM (SELECT event_type, user_id, avg(value) AS m FROM events GROUP BY 1, 2) GROUP BY 1",
    ),
    "rollout_aggregate": (
        lambda s, d: mt.rollout_aggregate(t("sanity")(s, d).withColumn("len", F.length("answer").cast("double")), "video_file", "row_id", "answer", ["len"]).select("video_file", F.round("len", 4).alias("len"), "longest"),
        "SELECT video_file, round(avg(CAST(length(answer) AS DOUBLE)), 4) AS len, arg_max(answer, struct_pack(l := length(answer), r := -row_id)) FILTER (answer IS NOT NULL) AS longest FROM sanity GROUP BY 1",
    ),
    "reduce_metrics": (
        lambda s, d: _r(mt.reduce_by_name(t("events")(s, d).select(F.concat(F.element_at(F.array(F.lit("a/max"), F.lit("b/min"), F.lit("c/mean")), (F.col("user_id") % 3 + 1).cast("int")), F.lit("_"), F.col("event_type")).alias("key"), "value"), "key", "value"), "value"),
        """SELECT key, round(CASE WHEN contains(key, 'max') THEN max(value) WHEN contains(key, 'min') THEN min(value) ELSE avg(value) END, 6) AS value
           FROM (SELECT CASE user_id % 3 WHEN 0 THEN 'a/max' WHEN 1 THEN 'b/min' ELSE 'c/mean' END || '_' || event_type AS key, value FROM events) GROUP BY key""",
    ),
    "data_metrics": (
        lambda s, d: _r(mt.data_metrics(rollouts(s, d).withColumn("ret", F.col("score") * 0.9 + F.col("length")), "score", "score", "ret", "length", 7), "score_mean", "score_max", "score_min", "vf_explained_var", "length_mean", "clip_ratio"),
        f"""SELECT round(avg(score), 6) AS score_mean, round(max(score), 6) AS score_max, round(min(score), 6) AS score_min, round(1 - var_samp(score * 0.9 + length - score) / (var_samp(score * 0.9 + length) + 1e-5), 6) AS vf_explained_var,
            round(avg(length), 6) AS length_mean, max(length) AS length_max, min(length) AS length_min, round(avg(CAST(length = 7 AS DOUBLE)), 6) AS clip_ratio FROM {R}""",
    ),
    "timing_and_throughput": (
        lambda s, d: t("lineitem")(s, d).groupBy("l_returnflag").agg(F.sum("l_quantity").alias("tok"), F.sum("l_tax").alias("sec")).select("l_returnflag", F.round(mt.timing_per_token(F.col("sec"), F.col("tok")), 6).alias("ms"), F.round(mt.throughput(F.col("tok"), F.col("sec"), 8), 4).alias("tput")),
        "SELECT l_returnflag, round(sum(l_tax) * 1000 / sum(l_quantity), 6) AS ms, round(sum(l_quantity) / (sum(l_tax) * 8), 4) AS tput FROM lineitem GROUP BY 1",
    ),
    "phase_stats": (
        lambda s, d: _r(mt.phase_stats(t("part")(s, d).withColumn("a", F.col("p_retailprice") + F.col("p_partkey") * 0.001), "a", "p_size", "p_partkey"), "a_min", "a_max", "a_mean", "p_size_mean"),
        """WITH p AS (SELECT *, p_retailprice + p_partkey * 0.001 AS a FROM part) SELECT round(min(a), 6) AS a_min, round(max(a), 6) AS a_max, round(avg(a), 6) AS a_mean,
           min(p_size) AS p_size_min, max(p_size) AS p_size_max, round(avg(p_size), 6) AS p_size_mean, arg_max(p_partkey, a + p_size) AS slowest_p_partkey FROM p""",
    ),
    "mean_max_min_std": (lambda s, d: _r(mt.mean_max_min_std(t("lineitem")(s, d), "l_extendedprice"), "mean", "max", "min", "std", digits=3), "SELECT round(avg(l_extendedprice), 3) AS mean, round(max(l_extendedprice), 3) AS max, round(min(l_extendedprice), 3) AS min, round(stddev_samp(l_extendedprice), 3) AS std FROM lineitem"),
    "masked_mean_rows": (lambda s, d: _r(mt.masked_mean(t("lineitem")(s, d).withColumn("m", (F.col("l_returnflag") == "R").cast("int")), "l_discount", "m"), "masked_mean"), "SELECT round(avg(l_discount) FILTER (l_returnflag = 'R'), 6) AS masked_mean FROM lineitem"),
    "safe_mean": (
        lambda s, d: _r(t("events")(s, d).groupBy("user_id").agg(mt.safe_mean(F.when(F.col("event_id") % 3 == 0, F.lit(float("nan"))).when(F.col("event_id") % 5 == 0, None).otherwise(F.col("value"))).alias("m")), "m"),
        "SELECT user_id, round(coalesce(avg(value) FILTER (event_id % 3 <> 0 AND event_id % 5 <> 0), 0), 6) AS m FROM events GROUP BY 1",
    ),
    "group_diagnostics": (
        lambda s, d: _r(rollouts(s, d).groupBy("prompt_id").agg(F.stddev_samp("score").alias("sd"), F.avg((F.col("score") > 50).cast("double")).alias("positive")), "sd", "positive"),
        f"SELECT prompt_id, round(stddev_samp(score), 6) AS sd, round(avg(CAST(score > 50 AS DOUBLE)), 6) AS positive FROM {R} GROUP BY 1",
    ),
    "prob_diff": (
        lambda s, d: _r(mt.prob_diff(t("lineitem")(s, d).withColumn("a", -F.col("l_discount")).withColumn("b", -F.col("l_tax")).withColumn("m", (F.col("l_linenumber") % 2)), "a", "b", "m"), "max", "mean", "std"),
        "SELECT round(max(x), 6) AS max, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS std FROM (SELECT abs(exp(-l_discount) - exp(-l_tax)) AS x FROM lineitem WHERE l_linenumber % 2 = 1)",
    ),
    "flops_dense": (
        lambda s, d: _r(mt.flops(t("lineitem")(s, d), "l_quantity", 4096, 32, 32, 32, 128, 11008, 32000), "tflops"),
        "SELECT round((6.0 * ((4096.0 * 11008 * 3 + 4096 * (4096 * 4)) * 32 + 2 * 32000 * 4096.0) * sum(l_quantity) + 12.0 * 128 * 32 * 32 * sum(l_quantity * l_quantity)) / 1e12, 6) AS tflops FROM lineitem",
    ),
    "join_three_way": (
        lambda s, d: t("orders")(s, d).select("o_custkey", "o_orderkey").join(t("customer")(s, d).select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey").join(F.broadcast(t("nation")(s, d).select(F.col("n_nationkey").alias("c_nationkey"), "n_name")), "c_nationkey").groupBy("n_name").agg(F.count("*").alias("orders")),
        "SELECT n_name, count(*) AS orders FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY 1",
    ),
}
