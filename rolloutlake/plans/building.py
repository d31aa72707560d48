"""Packing, scoring, builder, reader, writer and state queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from rolloutlake.functions import math_answers as ma
from rolloutlake.operators import balance as bl
from rolloutlake.operators import builders as bd
from rolloutlake.operators import scoring as sc
from rolloutlake.sources import readers as rd
from rolloutlake.sources import sinks as sk
from rolloutlake.sources.shared import shared_path
from rolloutlake.streaming import state as st

C = F.col


def t(name):
    return lambda s, d: s.read.parquet(f"{d}/{name}.parquet")


train, sanity, math1, docs, events, amc, orders, lineitem = (t(n) for n in ("train_sanity", "sanity", "math_l1_ttt", "documents", "events", "amc_ttt", "orders", "lineitem"))


def _packed(method, equal=False):
    """Sums of every user's bins, lightest first, beside what tells a packing: number and size of the items."""

    def run(s, d):
        rows = events(s, d).select("user_id", "event_id", (C("event_id") % 97 + 3).alias("len"))
        k = 2 if equal else 4
        if equal:
            rows = bl.padded(rows, "user_id", "event_id", "len", k)
        bins = bl.balanced(rows, "user_id", "event_id", "len", k, equal, method).groupBy("user_id", "bin").agg(F.sum("len").alias("total"), F.count("*").alias("n"))
        if equal:
            return bins.groupBy("user_id").agg(F.max("n").alias("most"), F.min("n").alias("least"), F.sum("total").alias("total"), (F.max("total") - F.min("total") <= 100).alias("balanced"))
        return bins.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("total")), lambda x: x.cast("string")), ",").alias("sums"))

    return run


#: Items in the order of their key, each to the lightest of four bins (the first of equally light ones), bin by bin.
GREEDY = """WITH RECURSIVE e AS (SELECT user_id, event_id % 97 + 3 AS len, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
  p AS (SELECT user_id, 0 AS k, [0, 0, 0, 0] AS s FROM (SELECT DISTINCT user_id FROM events)
    UNION ALL SELECT p.user_id, CAST(e.k AS INTEGER), list_transform([1, 2, 3, 4], lambda i: s[i] + CASE WHEN i = list_position(s, list_min(s)) THEN CAST(e.len AS INTEGER) ELSE 0 END) FROM p JOIN e ON e.user_id = p.user_id AND e.k = p.k + 1)
  SELECT user_id, array_to_string(list_sort(list_filter(arg_max(s, k), lambda x: x > 0)), ',') AS sums FROM p GROUP BY 1"""
EQUAL = """SELECT user_id, CAST((count(*) + 1) // 2 AS BIGINT) AS most, CAST((count(*) + 1) // 2 AS BIGINT) AS least, CAST(sum(event_id % 97 + 3) AS BIGINT) AS total, true AS balanced FROM events GROUP BY 1"""


def _imbalance(s, d):
    rows = events(s, d).select("user_id", (C("event_id") % 5).alias("bin"), (C("event_id") % 97 + 3).alias("len"))
    return bl.imbalance(rows, "bin", "len", "user_id")


def _routed(s, d):
    rows = train(s, d).select("row_id", F.when(C("row_id") % 2 == 0, "mcq").otherwise("hash").alias("data_source"), F.when(C("row_id") % 2 == 0, F.concat(F.lit("\\boxed{"), "answer", F.lit("}"))).otherwise(F.concat(F.lit("#### "), (C("row_id") % 5).cast("string"))).alias("solution"), F.when(C("row_id") % 2 == 0, "B").otherwise("3").alias("ground_truth"))
    return sc.routed(rows, {"mcq": "choice", "hash": "hash_answer"}).select("row_id", "score")


def _status(s, d):
    k = C("event_id") % 6
    out = F.when(k == 3, F.lit(None)).when(k == 4, F.lit("8")).otherwise(F.lit("7\n")).cast("string")
    rows = events(s, d).select("user_id", "event_id", sc.case_status(F.lit("7"), out, k != 0, k != 1, k == 2).alias("status"))
    return rows


STATUS = "(SELECT user_id, event_id, CASE event_id % 6 WHEN 0 THEN -4 WHEN 1 THEN -2 WHEN 2 THEN -3 WHEN 3 THEN -1 WHEN 4 THEN 0 ELSE 1 END AS status FROM events)"


def _canonical(s, d):
    rows = bd.canonical_rows(math1(s, d), "math_l1", bd.with_instruction(C("prompt"), "Answer in a box."), C("answer"), "math", C("split"), C("row_id"), answer=C("solution"))
    return rows.select("data_source", C("prompt")[0]["content"].alias("content"), "ability", C("reward_model.ground_truth").alias("truth"), C("extra_info.index").alias("idx"), C("extra_info.split").alias("split"))


def _roles(s, d):
    rows = events(s, d).select("user_id", "event_id", F.when(C("event_type") == "click", "tool").otherwise("assistant").alias("role"))
    return sc.role_islands(rows, "user_id", "event_id", "role").groupBy("user_id").agg(F.max("turn_no").alias("turns"))


def _kl(s, d):
    steps = events(s, d).groupBy((C("event_id") % 50).alias("step")).agg(F.avg(C("value") / 1000).alias("kl"), F.count("*").alias("n"))
    return st.adaptive_kl(steps, "step", "kl", "n", 0.2, 0.05, 10000.0).select("step", F.round("beta", 6).alias("beta"))


def _novelty(s, d):
    return st.novelty(t("embeddings")(s, d), "label", "vec_id", "embedding").select("vec_id", F.round("bonus", 5).alias("bonus"))


NOVELTY = """WITH e AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS k, list_transform(embedding, lambda x: CAST(x AS DOUBLE) / sqrt(list_sum(list_transform(embedding, lambda y: CAST(y AS DOUBLE) * y)))) AS e FROM embeddings),
  p AS (SELECT a.vec_id, max(list_sum(list_transform(list_zip(a.e, b.e), lambda p: p[1] * p[2]))) AS m FROM e a LEFT JOIN e b ON a.label = b.label AND b.k < a.k AND b.k >= a.k - 100 GROUP BY 1)
  SELECT vec_id, round(greatest(least(1 - coalesce(m, -1), 1), 0) * 0.1, 5) AS bonus FROM p"""


def _written(s, d):
    """Rollouts written as JSON lines by step and read back."""
    path = shared_path(s, "sink")
    sk.rollouts_by_step(events(s, d).select((C("event_id") % 4).alias("step"), "event_id", "event_type", "value"), path)
    return s.read.json(path).groupBy("step").agg(F.count("*").alias("n"), F.round(F.sum("value"), 3).alias("total"))


_LOGGED = "SELECT doc_id FROM documents ORDER BY CAST('0x' || substr(md5('42:' || doc_id), 1, 13) AS BIGINT), doc_id LIMIT 20"

#: Longest common subsequence by bits: a word's mask has a bit for each of its places in the candidate.
_W = "string_split_regex(trim(regexp_replace(lower(coalesce({0}, '')), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g')), ' ')"
ROUGE_L = f"""WITH t AS (SELECT row_id, list_filter({_W.format("prompt")}, lambda w: w <> '') AS r, list_filter({_W.format("answer")}, lambda w: w <> '') AS c FROM sanity),
  m AS (SELECT row_id, len(r) AS nr, len(c) AS nc, list_transform(r, lambda w: list_sum(list_transform(range(1, len(c) + 1), lambda i: CASE WHEN c[i] = w THEN CAST(1 AS HUGEINT) << CAST(i - 1 AS HUGEINT) ELSE CAST(0 AS HUGEINT) END))) AS masks FROM t),
  v AS (SELECT row_id, nr, nc, CASE WHEN nr = 0 OR nc = 0 THEN NULL ELSE list_reduce(list_prepend((CAST(1 AS HUGEINT) << CAST(nc AS HUGEINT)) - 1, list_transform(masks, lambda x: CAST(x AS HUGEINT))), lambda v, x: ((v + (v & x)) | (v - (v & x))) & ((CAST(1 AS HUGEINT) << CAST(nc AS HUGEINT)) - 1)) END AS v FROM m)
  SELECT row_id, round(CASE WHEN v IS NULL THEN 0 ELSE 2.0 * (nc - bit_count(v)) / (nr + nc) END, 6) AS x FROM v"""
_GRAMS = " UNION ALL ".join(f"SELECT row_id, {n} AS n, side, unnest(list_transform(range(1, len(w) - {n} + 2), lambda i: array_to_string(w[i:i + {n} - 1], ' '))) AS g FROM t" for n in (1, 2, 3, 4))
BLEU = f"""WITH s AS (SELECT row_id, list_filter(string_split_regex(coalesce(prompt, ''), '\\s+'), lambda w: w <> '') AS r, list_filter(string_split_regex(coalesce(answer, ''), '\\s+'), lambda w: w <> '') AS c FROM sanity),
  t AS (SELECT row_id, 'r' AS side, r AS w FROM s UNION ALL SELECT row_id, 'c', c FROM s), g AS (SELECT row_id, n, side, g, count(*) AS k FROM ({_GRAMS}) GROUP BY ALL),
  h AS (SELECT c.row_id, c.n, sum(least(c.k, coalesce(r.k, 0))) AS hit, sum(c.k) AS n_c FROM (FROM g WHERE side = 'c') c LEFT JOIN (FROM g WHERE side = 'r') r USING (row_id, n, g) GROUP BY 1, 2),
  p AS (SELECT row_id, CASE WHEN min(hit) = 0 THEN 0 ELSE exp(avg(ln(greatest(hit, 1) / n_c))) END AS p FROM h GROUP BY 1)
  SELECT s.row_id, round(CASE WHEN len(r) = 0 OR len(c) = 0 THEN 0 ELSE coalesce(p, 0) * CASE WHEN len(c) >= len(r) THEN 1 ELSE exp(1 - len(r) / len(c)) END END, 6) AS x FROM s LEFT JOIN p USING (row_id)"""
REPETITION = """WITH u AS (SELECT DISTINCT props AS t FROM events WHERE props IS NOT NULL), s AS (SELECT t, length(t) AS n, unnest(list_transform(range(1, length(t) + 1), lambda i: t[i:])) AS x FROM u WHERE length(t) > 1),
  l AS (SELECT t, n, x, lag(x) OVER (PARTITION BY t ORDER BY x) AS y FROM s), c AS (SELECT t, n, sum(CASE WHEN y IS NULL THEN 0 ELSE len(list_filter(range(1, least(length(x), length(y)) + 1), lambda i: x[1:i] = y[1:i])) END) AS k FROM l GROUP BY 1, 2)
  SELECT event_id, round(coalesce(2.0 * k / (n * (n + 1)), 0), 6) AS x FROM events LEFT JOIN c ON props = t"""

CATALOG = {
    "pack_differencing": (_packed(bl.differencing), None),
    "pack_greedy": (_packed(bl.greedy), GREEDY),
    "pack_equal_size": (_packed(bl.differencing, True), EQUAL),
    "pack_imbalance": (
        _imbalance,
        "SELECT user_id, CAST(min(s) AS BIGINT) AS least, CAST(max(s) AS BIGINT) AS most, CAST(max(s) - min(s) AS BIGINT) AS spread FROM (SELECT user_id, event_id % 5 AS b, sum(event_id % 97 + 3) AS s FROM events GROUP BY 1, 2) GROUP BY 1",
    ),
    "pack_micro_batches": (
        lambda s, d: events(s, d).groupBy("user_id").agg(F.sum(C("event_id") % 97 + 3).alias("t"), F.count("*").alias("r")).select("user_id", bl.micro_batch_count(C("t"), C("r"), 512, 1, 2).alias("n")),
        "SELECT user_id, CAST(ceil(greatest(least(count(*), ceil(sum(event_id % 97 + 3) / 512)), 1) / 2) * 2 AS BIGINT) AS n FROM events GROUP BY 1",
    ),
    "score_routed": (_routed, "SELECT row_id, CAST(CASE WHEN row_id % 2 = 0 THEN CASE WHEN upper(trim(answer)) = 'B' THEN 1 ELSE 0 END ELSE CASE WHEN row_id % 5 = 3 THEN 1 ELSE 0 END END AS DOUBLE) AS score FROM train_sanity"),
    "reward_last_token": (
        lambda s, d: sc.last_token_reward(events(s, d).withColumn("len", (C("event_id") % 8 + 1).cast("int")), "value", "len", 8).select("event_id", F.array_position("rewards", C("value")).cast("int").alias("pos"), F.round(F.aggregate("rewards", F.lit(0.0), lambda a, x: a + x), 4).alias("total")),
        "SELECT event_id, CAST(CASE WHEN value = 0 THEN 1 ELSE event_id % 8 + 1 END AS INT) AS pos, round(value, 4) AS total FROM events",
    ),
    "reward_overlong": (
        lambda s, d: sc.penalised_reward(events(s, d).withColumn("len", (C("event_id") % 16 + 1).cast("int")), "value", "len", 16, 4).select("event_id", F.round(F.aggregate("rewards", F.lit(0.0), lambda a, x: a + x), 4).alias("total")),
        "SELECT event_id, round(value + least(-((event_id % 16 + 1) - 12) / 4, 0), 4) AS total FROM events",
    ),
    "code_case_status": (_status, f"SELECT user_id, event_id, CAST(status AS INT) AS status FROM {STATUS}"),
    "code_after_compile_error": (lambda s, d: sc.after_compile_error(_status(s, d), "user_id", "event_id", "status").groupBy("status").agg(F.count("*").alias("n")),
        f"SELECT CAST(x AS INT) AS status, count(*) AS n FROM (SELECT CASE WHEN bool_or(status = -4) OVER (PARTITION BY user_id ORDER BY event_id) THEN -4 ELSE status END AS x FROM {STATUS}) GROUP BY 1"),
    "code_score": (lambda s, d: sc.code_score(_status(s, d), "user_id", "event_id", "status").select("user_id", F.round("score", 6).alias("score"), "all_passed"), f"SELECT user_id, round(avg(CAST(status = 1 AS DOUBLE)), 6) AS score, bool_and(status = 1) AS all_passed FROM {STATUS} GROUP BY 1"),
    "tool_improvement": (
        lambda s, d: sc.improvement_reward(events(s, d), "user_id", "event_id", "value").select("event_id", "step_reward"),
        "SELECT event_id, CAST(CASE WHEN value > coalesce(lag(value) OVER (PARTITION BY user_id ORDER BY event_id), 0) THEN 0.0 ELSE -0.05 END AS DOUBLE) AS step_reward FROM events",
    ),
    "join_role_islands": (
        _roles,
        """SELECT user_id, CAST(sum(n) AS BIGINT) AS turns FROM (SELECT user_id, CASE WHEN event_type = 'click' AND lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) = 'click' THEN 0 ELSE 1 END AS n FROM events) GROUP BY 1""",
    ),
    "join_sticky_servers": (
        lambda s, d: sc.sticky_assignment(events(s, d).select("user_id", "event_id"), "user_id", "event_id", 8).select("event_id", "server"),
        "WITH f AS (SELECT user_id, row_number() OVER (ORDER BY min(event_id)) - 1 AS k FROM events GROUP BY 1) SELECT event_id, k % 8 AS server FROM events JOIN f USING (user_id)",
    ),
    "build_canonical_rows": (_canonical, "SELECT 'math_l1' AS data_source, prompt || ' Answer in a box.' AS content, 'math' AS ability, answer AS truth, row_id AS idx, split FROM math_l1_ttt"),
    "build_preference_sft": (lambda s, d: bd.preference_sft(math1(s, d), "prompt", "solution", "answer").select("prompt", "response"), "SELECT prompt, solution AS response FROM math_l1_ttt UNION ALL SELECT prompt, answer FROM math_l1_ttt"),
    "build_preference_pairs": (lambda s, d: bd.preference_pairs(math1(s, d), "prompt", "solution", "answer"), "SELECT prompt, solution AS chosen, answer AS rejected FROM math_l1_ttt"),
    "build_conversations": (
        lambda s, d: bd.conversations(events(s, d), "user_id", "event_id", "event_type", "props").select("user_id", F.size("messages").alias("n"), C("messages")[0]["content"].alias("first")),
        "SELECT user_id, CAST(count(*) AS INT) AS n, arg_min(props, event_id) AS first FROM events GROUP BY 1",
    ),
    "build_shuffled_choices": (lambda s, d: train(s, d).select("row_id", *bd.shuffled_choices(C("row_id"), F.lit("right"), F.array(F.lit("w1"), F.lit("w2"), F.lit("w3")))).select("row_id", F.size("options").alias("n"), (F.array_position("options", "right") == F.expr("instr('ABCD', letter)")).alias("ok"), F.array_join(F.array_sort("options"), ",").alias("all")), "SELECT row_id, 4 AS n, true AS ok, 'right,w1,w2,w3' AS all FROM train_sanity"),
    "build_judge_prompt": (
        lambda s, d: sanity(s, d).select("row_id", F.md5(bd.judge_prompt(F.lit("q"), F.lit(None).cast("string"), C("id"), 7)).alias("x")),
        "SELECT row_id, md5('Question:' || chr(10) || 'q' || chr(10) || chr(10) || 'Reference:' || chr(10) || '[empty]' || chr(10) || chr(10) || 'Candidate:' || chr(10) || coalesce(nullif(left(trim(coalesce(id, '')), 7), ''), '[empty]') || chr(10) || chr(10) || 'Score (0-10):') AS x FROM sanity",
    ),
    "build_gold_answer": (lambda s, d: train(s, d).select("row_id", bd.gold_answer(C("answer"), C("source")).alias("x")), "SELECT row_id, CASE WHEN regexp_matches(trim(answer), '^[A-D]$') THEN source ELSE answer END AS x FROM train_sanity"),
    "build_gathered_responses": (lambda s, d: bd.gathered_responses(events(s, d), "user_id", "event_id", "event_type").select("user_id", F.array_join("responses", ",").alias("x")), "SELECT user_id, string_agg(event_type, ',' ORDER BY event_id) AS x FROM events GROUP BY 1"),
    "read_column_probe": (lambda s, d: train(s, d).select("row_id", rd.first_of(train(s, d), "instruction", "prompt", "question").alias("x")), "SELECT row_id, question AS x FROM train_sanity"),
    "read_lookup": (lambda s, d: rd.lookup(docs(s, d).select("doc_id", "n_chars"), t("eval_items")(s, d).select(C("item_id").alias("doc_id")), "doc_id"), "SELECT doc_id, n_chars FROM documents JOIN eval_items ON doc_id = item_id"),
    "read_planted_counts": (lambda s, d: rd.planted_counts(s, 500).select("id", "word", "letter", "n", "response"), "SELECT i AS id, w AS word, w[1] AS letter, CAST(24 - length(replace(w, w[1], '')) AS INT) AS n, '\\boxed{' || (24 - length(replace(w, w[1], ''))) || '}' AS response FROM (SELECT i, sha256('0:' || i)[1:24] AS w FROM range(500) r(i))"),
    "read_questions": (lambda s, d: rd.questions(docs(s, d).select(C("text").alias("prompt"), C("lang").alias("language"), "doc_id"), "en").select("doc_id"), "SELECT doc_id FROM documents WHERE length(trim(text)) > 0 AND lower(lang) = 'en'"),
    "sink_json_by_step": (_written, "SELECT event_id % 4 AS step, count(*) AS n, round(sum(value), 3) AS total FROM events GROUP BY 1"),
    "sink_long_metrics": (
        lambda s, d: sk.long_metrics(events(s, d).groupBy("user_id").agg(F.max("value").alias("a"), F.count("*").alias("b")), "user_id", "a", "b"),
        "SELECT user_id, 'a' AS key, max(value) AS value FROM events GROUP BY 1 UNION ALL SELECT user_id, 'b', CAST(count(*) AS DOUBLE) FROM events GROUP BY 1",
    ),
    "sink_dump_category": (lambda s, d: sk.dump_records(sanity(s, d).select("row_id", F.lower("question_type").alias("category")).where("category rlike '^[a-z ]*$'")), "SELECT row_id, array_to_string(list_transform(string_split(trim(lower(question_type)), ' '), lambda w: upper(left(w, 1)) || substr(w, 2)), ' ') AS category FROM sanity WHERE regexp_matches(lower(question_type), '^[a-z ]*$')"),
    "sink_logged_samples": (lambda s, d: sk.logged_samples(docs(s, d).select("doc_id", "text"), "doc_id", 20).select("doc_id"), _LOGGED),
    "state_adaptive_kl": (
        _kl,
        """WITH s AS (SELECT event_id % 50 AS step, avg(value / 1000) AS kl, count(*) AS n FROM events GROUP BY 1)
           SELECT step, round(0.2 * exp(sum(ln(1 + greatest(least(kl / 0.05 - 1, 0.2), -0.2) * n / 10000)) OVER (ORDER BY step)), 6) AS beta FROM s""",
    ),
    "state_dynamic_sampling": (
        lambda s, d: st.dynamic_sampling(events(s, d).groupBy("user_id").agg(F.stddev_pop("value").alias("sd"), F.min("event_id").alias("seen")).where("sd > 28"), "seen", 20, "seen").select("user_id"),
        "SELECT user_id FROM (SELECT user_id, stddev_pop(value) AS sd, min(event_id) AS seen FROM events GROUP BY 1) WHERE sd > 28 ORDER BY seen LIMIT 20",
    ),
    "state_novelty": (_novelty, NOVELTY),
    "state_latest_step": (lambda s, d: st.latest_step(events(s, d), "event_id"), "SELECT max(event_id) AS latest_step FROM events"),
    "state_should_save": (lambda s, d: events(s, d).select("event_id", st.should_save(C("value"), F.lit(30.0), F.lit(5.0), 1.0).alias("x")), "SELECT event_id, value <= 36 AS x FROM events"),
    "state_last_user_reply": (
        lambda s, d: st.last_user_reply(events(s, d).withColumn("role", F.when(C("event_type") == "view", "user").otherwise("assistant")), "user_id", "event_id", "role", "props"),
        "SELECT user_id, '#### ' || arg_max(props, event_id) AS reply FROM events WHERE event_type = 'view' GROUP BY 1",
    ),
    "math_boxed": (lambda s, d: math1(s, d).select("row_id", ma.boxed_udf("solution").alias("x")), "SELECT row_id, list_extract(regexp_extract_all(solution, '\\\\boxed\\{((?:[^{}]|\\{[^{}]*\\})*)\\}', 1), -1) AS x FROM math_l1_ttt"),
    "math_score": (
        lambda s, d: math1(s, d).select("row_id", ma.math_score_udf("solution", "answer").alias("x")),
        "SELECT row_id, CAST(coalesce(trim(replace(list_extract(regexp_extract_all(solution, '\\\\boxed\\{((?:[^{}]|\\{[^{}]*\\})*)\\}', 1), -1), ',', '')) = trim(replace(answer, ',', '')), false) AS DOUBLE) AS x FROM math_l1_ttt",
    ),
    "math_normal": (lambda s, d: math1(s, d).select("row_id", ma.normal_math_udf("answer").alias("x")), "SELECT row_id, replace(answer, ' ', '') AS x FROM math_l1_ttt"),
    "text_rouge_l": (lambda s, d: sanity(s, d).select("row_id", F.round(ma.rouge_l_udf("prompt", "answer"), 6).alias("x")), ROUGE_L),
    "text_sentence_bleu": (lambda s, d: sanity(s, d).select("row_id", F.round(ma.bleu_udf("prompt", "answer"), 6).alias("x")), BLEU),
    "text_repetition": (lambda s, d: events(s, d).select("event_id", F.round(ma.repetition_udf(C("props")), 6).alias("x")), REPETITION),
}
