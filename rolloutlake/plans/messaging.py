"""Message and training-row queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from rolloutlake.operators import messages as ms
from rolloutlake.plans.tokens_plan import TOK, token_rows

C = F.col


def t(name):
    return lambda s, d: s.read.parquet(f"{d}/{name}.parquet")


train, sanity, math1, events, amc = t("train_sanity"), t("sanity"), t("math_l1_ttt"), t("events"), t("amc_ttt")


def _segments(s, d):
    rows = events(s, d).select("event_id", ms.segments(F.concat(F.lit("<image>"), "event_type", F.lit("<video><audio> tail"))).alias("g"))
    return rows.select("event_id", F.array_join(C("g.type"), ",").alias("kinds"), F.array_join(C("g.text"), "|").alias("texts"))


def _suffix(s, d):
    m = F.array(F.struct(F.lit("system").alias("role"), F.lit("s").alias("content")), F.struct(F.lit("user").alias("role"), C("prompt").alias("content")))
    return math1(s, d).select("row_id", ms.with_suffix(m, " Think.").alias("m")).select("row_id", C("m")[0]["content"].alias("a"), C("m")[1]["content"].alias("b"))


def _rows(s, d):
    out = ms.training_row(sanity(s, d).select("row_id", "prompt", "answer", "source"), C("prompt"), C("answer"), C("row_id"), C("source"))
    return out.select("row_id", C("prompt_messages")[0]["content"].alias("content"), C("reward_model.ground_truth").alias("truth"), "data_source", "index")


def _mask(s, d):
    rows = events(s, d).select("user_id", "event_id", F.when(C("event_type") == "view", "assistant").when(C("event_type") == "click", "tool").otherwise("user").alias("role"), F.sequence(F.lit(1), (C("event_id") % 4 + 1).cast("int")).alias("tok"))
    return ms.role_mask(rows, "user_id", "event_id", "role", "tok").groupBy("user_id").agg(F.sum(F.size("mask")).alias("n"), F.sum(F.aggregate("mask", F.lit(0), lambda a, x: a + x)).alias("on_tokens"))


def _search(s, d):
    rows = ms.search_rows(amc(s, d), "Find: ", C("prompt"), F.when(C("row_id") % 2 == 0, F.array("answer")).otherwise(F.array().cast("array<string>")), F.lit("none"))
    return rows.select(C("prompt")[0]["content"].alias("content"), F.array_join(C("reward_model.ground_truth.target"), ",").alias("target"))


def _scan_json(s, d):
    """The same rows through JSON lines and through Parquet."""
    from rolloutlake.sources.readers import read_any
    from rolloutlake.sources.shared import shared_path

    path = shared_path(s, "scan") + "/rows.jsonl"
    amc(s, d).select("row_id", "prompt", "answer").write.mode("overwrite").json(path)
    return read_any(s, [path, f"{d}/math_l1_ttt.parquet"]).groupBy(F.col("unique_id").isNull().alias("flat")).agg(F.count("*").alias("n"), F.count("solution").alias("solutions"))


CATALOG = {
    "msg_segments": (_segments, "SELECT event_id, 'image,text,video,audio,text' AS kinds, event_type || '| tail' AS texts FROM events"),
    "msg_media_kind": (
        lambda s, d: train(s, d).select("row_id", ms.media_kind(F.lit(None).cast("string"), C("video_file"), C("audio_file")).alias("x")),
        "SELECT row_id, CASE WHEN length(trim(coalesce(video_file, ''))) > 0 THEN 'video' WHEN length(trim(coalesce(audio_file, ''))) > 0 THEN 'audio' ELSE 'text' END AS x FROM train_sanity",
    ),
    "msg_suffix": (_suffix, "SELECT row_id, 's' AS a, prompt || ' Think.' AS b FROM math_l1_ttt"),
    "msg_training_rows": (_rows, "SELECT row_id, prompt AS content, answer AS truth, coalesce(source, 'unknown') AS data_source, row_id AS index FROM sanity"),
    "msg_role_mask": (_mask, "SELECT user_id, CAST(sum(event_id % 4 + 1) AS BIGINT) AS n, CAST(sum(CASE WHEN event_type = 'view' THEN event_id % 4 + 1 ELSE 0 END) AS BIGINT) AS on_tokens FROM events GROUP BY 1"),
    "msg_choice_rows": (
        lambda s, d: ms.choice_rows(events(s, d), C("event_type"), F.array(F.lit(" a "), C("props")), F.when(C("event_id") % 3 == 0, "").otherwise((C("event_id") % 2).cast("string"))).select("prompt", C("reward_model.ground_truth").alias("label"), C("reward_model.choices")[0].alias("first")),
        "SELECT event_type AS prompt, CAST(event_id % 2 AS INT) AS label, 'a' AS first FROM events WHERE event_id % 3 <> 0",
    ),
    "msg_search_rows": (_search, "SELECT 'Find: ' || prompt AS content, CASE WHEN row_id % 2 = 0 THEN coalesce(answer, '') ELSE 'none' END AS target FROM amc_ttt"),
    "msg_test_cases": (lambda s, d: events(s, d).select("event_id", ms.test_cases_udf(F.when(C("event_id") % 2 == 0, "[1, 2]").otherwise("gASV")).alias("x")), "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN '[1, 2]' END AS x FROM events"),
    "read_json_and_parquet": (_scan_json, "SELECT flat, count(*) AS n, count(solution) AS solutions FROM (SELECT true AS flat, NULL AS solution FROM amc_ttt UNION ALL SELECT unique_id IS NULL, solution FROM math_l1_ttt) GROUP BY 1"),
    "adv_process_rloo": (
        lambda s, d: ms.process_rloo(token_rows(s, d).withColumn("g", C("seq") % 400).withColumn("r", C("r") * 1.0137373), "g", "seq", "pos", "r", "m").select("seq", "pos", (F.round("advantage", 6) + F.lit(0.0)).alias("advantage")),
        f"""WITH t AS (SELECT * REPLACE (r * 1.0137373 AS r), seq % 400 AS g FROM {TOK}), p AS (SELECT g, seq, sum(r * m) / greatest(sum(m), 1) AS x FROM t GROUP BY 1, 2),
            b AS (SELECT seq, CASE WHEN count(*) OVER w > 1 THEN (sum(x) OVER w - x) / (count(*) OVER w - 1) ELSE 0 END AS b FROM p WINDOW w AS (PARTITION BY g))
            SELECT seq, pos, round(sum((r - b) * m) OVER (PARTITION BY seq ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 6) + 0.0 AS advantage FROM t JOIN b USING (seq)""",
    ),
    "loss_detached_contrast": (
        lambda s, d: ms.detached_contrast(events(s, d).withColumn("acc", C("event_id") % 2), "user_id", "event_id", "value", "acc", 0.05).select("event_id", F.round("loss", 5).alias("loss")),
        """WITH m AS (SELECT a.event_id, a.value AS q, a.event_id % 2 AS acc, avg(b.value) AS p FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_id % 2 <> b.event_id % 2 GROUP BY 1, 2, 3)
           SELECT event_id, round(ln(1 + exp(-(CASE WHEN acc > 0 THEN 1 ELSE -1 END) * 0.05 * (q - p))), 5) AS loss FROM m""",
    ),
}
