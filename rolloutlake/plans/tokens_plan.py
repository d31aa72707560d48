"""Token-array queries: the lines of an order are the tokens of a response; embeddings stand in for logits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolloutlake.functions import tokens as tk
from rolloutlake.operators import losses as ls

#: Tokens: unique key (seq, pos) even where an order repeats a line number.
TOK = """(SELECT l_orderkey AS seq, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax, l_shipdate) - 1 AS pos, l_partkey AS id, l_discount AS r, l_tax AS v,
   -l_discount AS old, -l_tax AS new, l_quantity / 50 - 0.5 AS adv, CAST(l_returnflag <> 'R' AS INT) AS m FROM lineitem)"""


def token_rows(s, d) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_shipdate")
    return s.read.parquet(f"{d}/lineitem.parquet").select(
        F.col("l_orderkey").alias("seq"), (F.row_number().over(w) - 1).alias("pos"), F.col("l_partkey").alias("id"), F.col("l_discount").alias("r"), F.col("l_tax").alias("v"),
        (-F.col("l_discount")).alias("old"), (-F.col("l_tax")).alias("new"), (F.col("l_quantity") / 50 - 0.5).alias("adv"), (F.col("l_returnflag") != "R").cast("int").alias("m"),
    )


def arrays(s, d) -> DataFrame:
    g = token_rows(s, d).groupBy("seq").agg(F.array_sort(F.collect_list(F.struct("pos", "id", "r", "v", "old", "new", "adv", "m"))).alias("t"))
    return g.select("seq", *[F.col("t")[c].alias(c) for c in ("id", "r", "v", "old", "new", "adv", "m")])


def flat(df: DataFrame, column: str, digits: int = 6) -> DataFrame:
    """One row per element, so that arrays are compared element by element."""
    kind = dict(df.dtypes)[column]
    out = df.select("seq", F.posexplode(column).alias("pos", "x"))
    return out.withColumn("x", F.round("x", digits)) if "double" in kind else out


def _flat(fn, digits=6):
    return lambda s, d: flat(arrays(s, d).select("seq", fn().alias("x")), "x", digits)


def _emb(s, d):
    return s.read.parquet(f"{d}/embeddings.parquet").select("vec_id", F.col("label").cast("int").alias("label"), F.transform("embedding", lambda x: x.cast("double")).alias("z"))


C = F.col
Z = "(SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS z FROM embeddings)"
LSE = "(ln(list_sum(list_transform(z, lambda x: exp(x - list_max(z))))) + list_max(z))"
TOKSUM = f"(SELECT seq, count(*) AS n, sum(r * m) AS s, sum(m) AS sm FROM {TOK} GROUP BY 1)"

CATALOG = {
    "tok_masked_sum": (lambda s, d: arrays(s, d).select("seq", F.round(tk.masked_sum(C("r"), C("m")), 6).alias("x")), f"SELECT seq, round(sum(r * m), 6) AS x FROM {TOK} GROUP BY 1"),
    "tok_masked_mean": (lambda s, d: arrays(s, d).select("seq", F.round(tk.masked_mean(C("r"), C("m")), 6).alias("x")), f"SELECT seq, round(s / (sm + 1e-8), 6) AS x FROM {TOKSUM}"),
    "tok_masked_var": (
        lambda s, d: arrays(s, d).select("seq", F.round(tk.masked_var(C("r"), C("m")), 6).alias("x")),
        f"""SELECT seq, round(CASE WHEN sm > 1 THEN q / (sm + 1e-8) * sm / (sm - 1) END, 6) AS x FROM (SELECT t.seq, max(sm) AS sm, sum((r - s / (sm + 1e-8)) ** 2 * m) AS q FROM {TOK} t JOIN {TOKSUM} USING (seq) GROUP BY 1)""",
    ),
    "tok_whiten": (
        lambda s, d: flat(arrays(s, d).crossJoin(F.broadcast(token_rows(s, d).where("m = 1").agg(F.avg("r").alias("mu"), F.var_samp("r").alias("var")))).select("seq", tk.whiten(C("r"), C("mu"), C("var")).alias("x")), "x"),
        f"SELECT seq, pos, round((r - (SELECT avg(r) FROM {TOK} WHERE m = 1)) / sqrt((SELECT var_samp(r) FROM {TOK} WHERE m = 1) + 1e-8), 6) AS x FROM {TOK}",
    ),
    "tok_response_mask": (
        _flat(lambda: tk.response_mask(F.transform(C("id"), lambda x: x % 5), 2)),
        f"""SELECT seq, pos, CAST(pos <= coalesce((min(CASE WHEN id % 5 = 2 THEN pos END) OVER (PARTITION BY seq)), 1000000) AS INT) AS x FROM {TOK}""",
    ),
    "tok_tail_mask": (
        lambda s, d: flat(arrays(s, d).where(F.size("m") >= 2).select("seq", tk.tail_mask(C("m"), 2).alias("x")), "x"),
        f"SELECT seq, pos - n + 2 AS pos, m AS x FROM {TOK} JOIN (SELECT seq, count(*) AS n FROM {TOK} GROUP BY 1) USING (seq) WHERE n >= 2 AND pos >= n - 2",
    ),
    "tok_position_ids": (_flat(lambda: tk.position_ids(C("m"))), f"SELECT seq, pos, greatest(CAST(sum(m) OVER (PARTITION BY seq ORDER BY pos) AS INT) - 1, 0) AS x FROM {TOK}"),
    "tok_pad_right": (
        _flat(lambda: tk.pad_to(C("m"), 6, 9)),
        f"SELECT seq, pos, m AS x FROM {TOK} UNION ALL SELECT seq, p, 9 FROM (SELECT seq, count(*) AS n FROM {TOK} GROUP BY 1), range(6) r(p) WHERE p >= n",
    ),
    "tok_pad_left": (
        _flat(lambda: tk.pad_to(C("m"), 6, 9, left=True)),
        f"""WITH c AS (SELECT seq, count(*) AS n FROM {TOK} GROUP BY 1) SELECT seq, pos + greatest(6 - n, 0) AS pos, m AS x FROM {TOK} JOIN c USING (seq)
            UNION ALL SELECT seq, p, 9 FROM c, range(6) r(p) WHERE p < 6 - n""",
    ),
    "tok_truncate_left": (
        _flat(lambda: tk.truncate(C("id"), 3, "left")),
        f"SELECT seq, pos - greatest(n - 3, 0) AS pos, id AS x FROM {TOK} JOIN (SELECT seq, count(*) AS n FROM {TOK} GROUP BY 1) USING (seq) WHERE pos >= n - 3",
    ),
    "tok_truncate_middle": (
        _flat(lambda: tk.truncate(C("id"), 3, "middle")),
        f"""SELECT seq, CASE WHEN n <= 3 THEN pos WHEN pos < 1 THEN pos ELSE pos - n + 3 END AS pos, id AS x FROM {TOK} JOIN (SELECT seq, count(*) AS n FROM {TOK} GROUP BY 1) USING (seq)
            WHERE n <= 3 OR pos < 1 OR pos >= n - 2""",
    ),
    "tok_strip_pad": (
        _flat(lambda: tk.strip_pad(C("id"), C("m"))),
        f"SELECT seq, row_number() OVER (PARTITION BY seq ORDER BY pos) - 1 AS pos, id AS x FROM {TOK} WHERE m = 1",
    ),
    "tok_clip": (lambda s, d: token_rows(s, d).select("seq", "pos", F.round(tk.clip(C("adv"), -0.2, 0.3), 6).alias("x")), f"SELECT seq, pos, round(greatest(least(adv, 0.3), -0.2), 6) AS x FROM {TOK}"),
    "tok_entropy": (
        lambda s, d: _emb(s, d).select("vec_id", F.round(tk.entropy(C("z")), 6).alias("x")),
        f"SELECT vec_id, round({LSE} - list_sum(list_transform(z, lambda x: exp(x - {LSE}) * x)), 6) AS x FROM {Z}",
    ),
    "tok_log_prob": (lambda s, d: _emb(s, d).select("vec_id", F.round(tk.log_prob(C("z"), C("label")), 6).alias("x")), f"SELECT vec_id, round(z[label + 1] - {LSE}, 6) AS x FROM {Z}"),
    "tok_gather": (lambda s, d: _emb(s, d).select("vec_id", F.round(tk.gather(C("z"), C("label")), 6).alias("x")), f"SELECT vec_id, round(z[label + 1], 6) AS x FROM {Z}"),
    "tok_temperature": (lambda s, d: _emb(s, d).select("vec_id", F.round(F.array_max(tk.temperature(C("z"), 0.7)), 6).alias("x")), f"SELECT vec_id, round(list_max(z) / 0.7, 6) AS x FROM {Z}"),
    "tok_inverse_permutation": (
        lambda s, d: flat(arrays(s, d).select("seq", tk.inverse_permutation(F.reverse(F.sequence(F.lit(0), F.size("id") - 1))).alias("x")), "x"),
        f"SELECT seq, pos, CAST(count(*) OVER (PARTITION BY seq) - 1 - pos AS INT) AS x FROM {TOK}",
    ),
    "tok_round_up": (
        lambda s, d: s.read.parquet(f"{d}/events.parquet").select("event_id", tk.round_up(C("event_id"), 7).alias("up"), tk.ceil_div(C("event_id"), 7).alias("parts")),
        "SELECT event_id, (event_id + 6) // 7 * 7 AS up, (event_id + 6) // 7 AS parts FROM events",
    ),
    "tok_score_at_last": (
        lambda s, d: flat(arrays(s, d).select("seq", tk.score_at_last(F.lit(2.5), F.transform("m", lambda _: F.lit(1)), 1).alias("x")), "x"),
        f"SELECT seq, 0 AS pos, 2.5 AS x FROM {TOK} GROUP BY 1",
    ),
    "tok_reverse_cumsum": (
        _flat(lambda: tk.reverse_cumsum(C("r"))),
        f"SELECT seq, pos, round(sum(r) OVER (PARTITION BY seq ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 6) AS x FROM {TOK}",
    ),
    "adv_reinforce_pp_returns": (
        _flat(lambda: tk.discounted_returns(C("r"), F.transform("m", lambda _: F.lit(1)), 0.93171717)),
        f"SELECT a.seq, a.pos, round(sum(b.r * pow(0.93171717, b.pos - a.pos)), 6) AS x FROM {TOK} a JOIN {TOK} b ON a.seq = b.seq AND b.pos >= a.pos GROUP BY 1, 2",
    ),
    "adv_gae": (
        _flat(lambda: tk.gae(C("r"), C("v"), 0.95171717, 0.9137373)),
        f"""WITH dl AS (SELECT seq, pos, r + 0.95171717 * coalesce(lead(v) OVER w, 0) - v AS dt FROM {TOK} WINDOW w AS (PARTITION BY seq ORDER BY pos))
            SELECT a.seq, a.pos, round(sum(b.dt * pow(0.95171717 * 0.9137373, b.pos - a.pos)), 6) AS x FROM dl a JOIN dl b ON a.seq = b.seq AND b.pos >= a.pos GROUP BY 1, 2""",
    ),
    "adv_kl_k1": (lambda s, d: token_rows(s, d).select("seq", "pos", F.round(tk.kl_estimate(C("new"), C("old"), "k1"), 6).alias("x")), f"SELECT seq, pos, round(new - old, 6) AS x FROM {TOK}"),
    "adv_kl_abs": (lambda s, d: token_rows(s, d).select("seq", "pos", F.round(tk.kl_estimate(C("new"), C("old"), "abs"), 6).alias("x")), f"SELECT seq, pos, round(abs(new - old), 6) AS x FROM {TOK}"),
    "adv_kl_k2": (lambda s, d: token_rows(s, d).select("seq", "pos", F.round(tk.kl_estimate(C("new"), C("old"), "k2"), 6).alias("x")), f"SELECT seq, pos, round(0.5 * (new - old) ** 2, 6) AS x FROM {TOK}"),
    "adv_kl_k3": (lambda s, d: token_rows(s, d).select("seq", "pos", F.round(tk.kl_estimate(C("new"), C("old"), "k3"), 6).alias("x")), f"SELECT seq, pos, round(exp(old - new) - (old - new) - 1, 6) AS x FROM {TOK}"),
    "adv_kl_rewards": (_flat(lambda: tk.kl_rewards(C("r"), C("new"), C("old"), C("m"), 0.05)), f"SELECT seq, pos, round(r - 0.05 * (new - old) * m, 6) AS x FROM {TOK}"),
    "adv_token_reward_combine": (lambda s, d: token_rows(s, d).select("seq", "pos", F.round(C("r") - (C("old") - C("new")) * 0.1, 6).alias("x")), f"SELECT seq, pos, round(r - (old - new) * 0.1, 6) AS x FROM {TOK}"),
    "adv_process_norm": (
        lambda s, d: flat(arrays(s, d).select("seq", tk.reverse_cumsum(C("r")).alias("c"), "r").crossJoin(F.broadcast(arrays(s, d).agg(F.max(F.array_max(F.transform(tk.reverse_cumsum(C("r")), lambda x: F.abs(x)))).alias("top")))).select("seq", F.transform("r", lambda x: x / (F.col("top") + 1e-6)).alias("x")), "x"),
        f"""WITH c AS (SELECT seq, pos, r, sum(r) OVER (PARTITION BY seq ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS x FROM {TOK})
            SELECT seq, pos, round(r / ((SELECT max(abs(x)) FROM c) + 1e-6), 6) AS x FROM c""",
    ),
    "tok_sft_pack": (
        lambda s, d: flat(arrays(s, d).where(F.size("id") >= 2).select("seq", *tk.sft_pack(F.slice("id", 1, 1), F.expr("slice(id, 2, size(id) - 1)"), 5)).select("seq", F.col("loss_mask").alias("x")), "x"),
        f"SELECT seq, p AS pos, CAST(p < least(n, 5) - 1 AS INT) AS x FROM (SELECT seq, count(*) AS n FROM {TOK} GROUP BY 1 HAVING count(*) >= 2), range(5) r(p)",
    ),
    "tok_sft_ids": (
        lambda s, d: flat(arrays(s, d).where(F.size("id") >= 2).select("seq", *tk.sft_pack(F.slice("id", 1, 1), F.expr("slice(id, 2, size(id) - 1)"), 5)).select("seq", F.col("input_ids").cast("array<bigint>").alias("x")), "x"),
        f"SELECT seq, p AS pos, CAST(coalesce(id, 0) AS BIGINT) AS x FROM (SELECT DISTINCT seq FROM {TOK} WHERE pos = 1), range(5) r(p) LEFT JOIN (SELECT seq AS s2, pos, id FROM {TOK}) t ON t.s2 = seq AND t.pos = p",
    ),
    "tok_marker_bounds": (
        lambda s, d: arrays(s, d).select("seq", F.array_join(F.transform(tk.marker_bounds(F.transform("id", lambda x: (x % 3).cast("int")), 0, 1), lambda b: F.concat(F.coalesce(b["s"].cast("string"), F.lit("-")), F.lit(":"), F.coalesce(b["e"].cast("string"), F.lit("-")))), ",").alias("pairs")),
        f"""WITH m AS (SELECT seq, CAST(pos AS VARCHAR) AS p, id % 3 AS k, row_number() OVER (PARTITION BY seq, id % 3 ORDER BY pos) AS i FROM {TOK}),
            z AS (SELECT coalesce(a.seq, b.seq) AS seq, coalesce(a.i, b.i) AS i, coalesce(a.p, '-') || ':' || coalesce(b.p, '-') AS x FROM (FROM m WHERE k = 0) a FULL JOIN (FROM m WHERE k = 1) b ON a.seq = b.seq AND a.i = b.i)
            SELECT t.seq, coalesce(string_agg(x, ',' ORDER BY i), '') AS pairs FROM (SELECT DISTINCT seq FROM {TOK}) t LEFT JOIN z ON z.seq = t.seq GROUP BY 1""",
    ),
    "loss_token_mean": (lambda s, d: ls.aggregate_loss(token_rows(s, d), "seq", "adv", "m").select(F.round("loss", 6).alias("loss")), f"SELECT round(sum(adv * m) / (sum(m) + 1e-8), 6) AS loss FROM {TOK}"),
    "loss_seq_mean_token_sum": (lambda s, d: ls.aggregate_loss(token_rows(s, d), "seq", "adv", "m", "seq-mean-token-sum").select(F.round("loss", 6).alias("loss")), f"SELECT round(avg(x), 6) AS loss FROM (SELECT sum(adv * m) AS x FROM {TOK} GROUP BY seq)"),
    "loss_seq_mean_token_mean": (lambda s, d: ls.aggregate_loss(token_rows(s, d), "seq", "adv", "m", "seq-mean-token-mean").select(F.round("loss", 6).alias("loss")), f"SELECT round(avg(x), 6) AS loss FROM (SELECT sum(adv * m) / (sum(m) + 1e-8) AS x FROM {TOK} GROUP BY seq)"),
    "loss_seq_mean_token_sum_norm": (lambda s, d: ls.aggregate_loss(token_rows(s, d), "seq", "adv", "m", "seq-mean-token-sum-norm", 8).select(F.round("loss", 6).alias("loss")), f"SELECT round(sum(adv * m) / 8, 6) AS loss FROM {TOK}"),
    "loss_policy_dual_clip": (
        lambda s, d: ls.policy_loss(token_rows(s, d).withColumn("new", C("new") * 4), "old", "new", "adv", "m").select(*[F.round(c, 6).alias(c) for c in ("pg_loss", "clip_frac", "ppo_kl", "clip_frac_lower")]),
        f"""WITH a AS (SELECT *, exp(greatest(least(new * 4 - old, 20), -20)) AS k FROM {TOK}), b AS (SELECT *, -adv * k AS p, -adv * greatest(least(k, 1.2), 0.8) AS q FROM a),
            c AS (SELECT *, greatest(p, q) AS u FROM b), d AS (SELECT *, CASE WHEN adv < 0 THEN least(-adv * 3, u) ELSE u END AS l FROM c)
            SELECT round(sum(l * m) / (sum(m) + 1e-8), 6) AS pg_loss, round(sum(CAST(q > p AS INT) * m) / (sum(m) + 1e-8), 6) AS clip_frac, round(sum((old - new * 4) * m) / (sum(m) + 1e-8), 6) AS ppo_kl,
            round(sum(CAST(u > -adv * 3 AND adv < 0 AS INT) * m) / (sum(m) + 1e-8), 6) AS clip_frac_lower FROM d""",
    ),
    "loss_gspo": (
        lambda s, d: ls.gspo_loss(token_rows(s, d), "seq", "old", "new", "adv", "m").select(F.round("loss", 6).alias("loss")),
        f"""WITH a AS (SELECT seq, exp(least(sum((new - old) * m) / greatest(sum(m), 1), 10)) AS k, sum(adv * m) / (sum(m) + 1e-8) AS a FROM {TOK} GROUP BY 1)
            SELECT round(avg(greatest(-a * k, -a * greatest(least(k, 1.2), 0.8))), 6) AS loss FROM a""",
    ),
    "loss_kl_cov": (lambda s, d: ls.kl_cov_tokens(token_rows(s, d).withColumn("key", F.concat_ws("-", "seq", "pos")), "key", "new", "adv", "m", 0.02).agg(F.count("*").alias("n"), F.round(F.sum("cov"), 5).alias("total")),
        f"""WITH u AS (SELECT * FROM {TOK} WHERE m = 1), c AS (SELECT round((adv - (SELECT avg(adv) FROM u)) * (new - (SELECT avg(new) FROM u)), 9) AS cov FROM u)
            SELECT count(*) AS n, round(sum(cov), 5) AS total FROM (SELECT cov, row_number() OVER (ORDER BY cov DESC) AS k, count(*) OVER () AS n FROM c) WHERE k <= floor(n * 0.02)"""),
    "loss_clip_cov_candidates": (lambda s, d: ls.clip_cov_candidates(token_rows(s, d), "new", "adv", "m", 0.001, 0.01).select("seq", "pos"),
        f"WITH u AS (SELECT * FROM {TOK} WHERE m = 1), c AS (SELECT seq, CAST(pos AS INT) AS pos, round((adv - (SELECT avg(adv) FROM u)) * (new - (SELECT avg(new) FROM u)), 9) AS cov FROM u) SELECT seq, pos FROM c WHERE cov > 0.001 AND cov < 0.01"),
    "loss_value": (
        lambda s, d: ls.value_loss(token_rows(s, d), "v", "r", "adv", "m", 0.2).select(F.round("vf_loss", 6).alias("vf_loss"), F.round("clip_frac", 6).alias("clip_frac")),
        f"""WITH a AS (SELECT *, (v - r) ** 2 AS p, (greatest(least(v, adv + 0.2), adv - 0.2) - r) ** 2 AS q FROM {TOK})
            SELECT round(sum(greatest(p, q) * m) / (sum(m) + 1e-8) * 0.5, 6) AS vf_loss, round(sum(CAST(q > p AS INT) * m) / (sum(m) + 1e-8), 6) AS clip_frac FROM a""",
    ),
    "loss_reward_model_ce": (
        lambda s, d: ls.reward_model_ce(token_rows(s, d).withColumn("acc", C("seq") % 2), "seq", "adv", "m", "acc", 0.5).select(F.round("loss", 6).alias("loss")),
        f"SELECT round(-avg(a * ln(p) + (1 - a) * ln(1 - p)), 6) AS loss FROM (SELECT seq % 2 AS a, 1 / (1 + exp(-0.5 * sum(adv * m))) AS p FROM {TOK} GROUP BY seq)",
    ),
    "loss_absolute_accuracy": (
        lambda s, d: ls.absolute_accuracy(token_rows(s, d).withColumn("acc", C("seq") % 2).withColumn("sc", F.round(C("adv") * 100).cast("int")), "seq", "sc", "m", "acc").select(F.round("accuracy", 6).alias("accuracy")),
        f"SELECT round(avg(CAST(sign(q) = sign(2 * a - 1) AS DOUBLE)), 6) AS accuracy FROM (SELECT seq % 2 AS a, sum(CAST(round(adv * 100) AS INT) * m) AS q FROM {TOK} GROUP BY seq)",
    ),
    "loss_pairwise_accuracy": (
        lambda s, d: ls.pairwise_accuracy(token_rows(s, d).withColumn("acc", C("id") % 3), "seq", "pos", "adv", "acc").select("seq", F.round("accuracy", 6).alias("accuracy")),
        f"""WITH t AS (SELECT seq, pos, adv, id % 3 AS acc FROM {TOK}), p AS (SELECT a.seq, abs(a.acc - b.acc) AS w, CAST((a.adv > b.adv) = (a.acc > b.acc) AS INT) AS g FROM t a JOIN t b ON a.seq = b.seq AND a.pos < b.pos)
            SELECT seq, round(CASE WHEN sum(w) > 0 THEN sum(w * g) / sum(w) ELSE 0.5 END, 6) AS accuracy FROM p GROUP BY 1""",
    ),
    "loss_online_dpo": (
        lambda s, d: token_rows(s, d).select("seq", "pos", F.round(ls.online_dpo(C("old"), C("new"), C("r"), C("v"), 0.1, 0.05), 6).alias("sig"), F.round(ls.online_dpo(C("old"), C("new"), C("r"), C("v"), 0.5, kind="ipo"), 6).alias("ipo")),
        f"""SELECT seq, pos, round(-ln(1 / (1 + exp(-0.1 * z))) * 0.95 - ln(1 / (1 + exp(0.1 * z))) * 0.05, 6) AS sig, round((z - 1) ** 2, 6) AS ipo FROM (SELECT seq, pos, (old - new) - (r - v) AS z FROM {TOK})""",
    ),
    "loss_sequence_log_probs": (
        lambda s, d: ls.sequence_log_probs(token_rows(s, d).withColumn("label", F.when(C("m") == 1, C("id")).otherwise(-100)), "seq", "new", "label").select("seq", F.round("logps", 6).alias("logps")),
        f"SELECT seq, round(coalesce(sum(new) FILTER (m = 1), 0), 6) AS logps FROM {TOK} GROUP BY 1",
    ),
    "loss_sppo": (
        lambda s, d: ls.sppo_loss(token_rows(s, d).withColumn("rw", (C("seq") % 2).cast("double")), "seq", "old", "new", "rw", "m").select(F.round("loss", 6).alias("loss")),
        f"SELECT round(avg((x - a) ** 2), 6) AS loss FROM (SELECT seq % 2 AS a, sum((new - old) * m) AS x FROM {TOK} GROUP BY seq HAVING max(m) > 0)",
    ),
}
