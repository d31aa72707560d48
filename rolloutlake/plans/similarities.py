"""Similarity, clustering and retrieval queries; labels group embeddings as prompts group rollouts."""

from __future__ import annotations

from pyspark.sql import functions as F

from rolloutlake.operators import similarity as sim

C = F.col


def emb(s, d):
    return s.read.parquet(f"{d}/embeddings.parquet").select("vec_id", "label", "embedding")


def _r(df, *columns, digits=5):
    return df.select(*[c for c in df.columns if c not in columns], *[F.round(c, digits).alias(c) for c in columns])


DOT = "list_sum(list_transform(list_zip(a.e, b.e), lambda p: p[1] * p[2]))"
E = "(SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE) / sqrt(list_sum(list_transform(embedding, lambda y: CAST(y AS DOUBLE) * y)))) AS e FROM embeddings)"
PAIRS = f"(SELECT a.label, a.vec_id, b.vec_id AS other, {DOT} AS sim FROM {E} a JOIN {E} b ON a.label = b.label AND a.vec_id <> b.vec_id)"
BAND = f"(SELECT a.label, a.vec_id, a.vec_id % 3 AS band, b.vec_id % 3 AS band2, b.vec_id AS other, {DOT} AS sim FROM {E} a JOIN {E} b ON a.label = b.label AND a.vec_id <> b.vec_id)"


def _banded(s, d):
    return emb(s, d).withColumn("band", C("vec_id") % 3)


def _queries(s, d):
    return emb(s, d).where("vec_id % 100 = 0").select(C("vec_id").alias("q_id"), C("embedding").alias("q_vec"))


def _bm25(s, d):
    docs = s.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")
    items = s.read.parquet(f"{d}/eval_items.parquet").where("item_id % 100 = 0").select(C("item_id").alias("q_id"), C("text").alias("q_text"))
    return _r(sim.bm25(docs, items, 3).select("q_id", "doc_id", "rank", "score"), "score", digits=4)


BM25 = """WITH t AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda w: w <> '') AS w FROM documents),
  st AS (SELECT count(*) AS n, avg(len(w)) AS al FROM t),
  q AS (SELECT DISTINCT item_id AS q_id, unnest(list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda w: w <> '')) AS term FROM eval_items WHERE item_id % 100 = 0),
  p AS (SELECT doc_id, len(w) AS dl, unnest(w) AS term FROM t),
  tf AS (SELECT term, doc_id, dl, count(*) AS tf FROM p WHERE term IN (SELECT term FROM q) GROUP BY ALL),
  df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
  s AS (SELECT q_id, doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 1.9 / (tf + 0.9 * (0.6 + 0.4 * dl / al))) AS score FROM q JOIN tf USING (term) JOIN df USING (term), st GROUP BY 1, 2)
  SELECT q_id, doc_id, CAST(row_number() OVER (PARTITION BY q_id ORDER BY round(score, 6) DESC, doc_id) AS INT) AS rank, round(score, 4) AS score FROM s
  QUALIFY row_number() OVER (PARTITION BY q_id ORDER BY round(score, 6) DESC, doc_id) <= 3"""

CATALOG = {
    "sim_cosine_to_first": (
        lambda s, d: _r(emb(s, d).join(F.broadcast(emb(s, d).where("vec_id = 0").select(C("embedding").alias("z"))), F.lit(True)).select("vec_id", sim.cosine(C("embedding"), C("z")).alias("x")), "x"),
        f"SELECT a.vec_id, round({DOT}, 5) AS x FROM {E} a, (SELECT * FROM {E} WHERE vec_id = 0) b",
    ),
    "sim_group_pairs": (lambda s, d: _r(sim.group_pairs(emb(s, d), "label", "vec_id", "embedding").groupBy("label").agg(F.count("*").alias("n"), F.avg("sim").alias("m")), "m"), f"SELECT label, count(*) AS n, round(avg(sim), 5) AS m FROM {PAIRS} GROUP BY 1"),
    "vote_medoid": (
        lambda s, d: _r(sim.medoid(emb(s, d), "label", "vec_id", "embedding"), "mean_sim", "max_sim", "share_close"),
        f"""WITH m AS (SELECT label, vec_id, avg(sim) AS m, max(sim) AS x, count(*) FILTER (sim > 0.95) AS c, count(*) AS k FROM {PAIRS} GROUP BY 1, 2)
            SELECT label, arg_max(vec_id, struct_pack(m := round(m, 9), v := -vec_id)) AS medoid, round(avg(m), 5) AS mean_sim, round(max(x), 5) AS max_sim, round(sum(c) / sum(k), 5) AS share_close FROM m GROUP BY 1""",
    ),
    "reward_density": (
        lambda s, d: _r(sim.density_rewards(emb(s, d), "label", "vec_id", "embedding"), "density", "reward", digits=4),
        f"WITH r AS (SELECT label, vec_id, avg(exp((sim - 1) / 0.2)) AS dn FROM {PAIRS} GROUP BY 1, 2) SELECT label, vec_id, round(dn, 4) AS density, round(dn / max(dn) OVER (PARTITION BY label), 4) AS reward FROM r",
    ),
    "reward_anchor": (
        lambda s, d: _r(sim.anchor_rewards(emb(s, d), sim.medoid(emb(s, d), "label", "vec_id", "embedding"), "label", "vec_id", "embedding"), "reward", digits=4),
        f"""WITH m AS (SELECT label, vec_id, avg(sim) AS m FROM {PAIRS} GROUP BY 1, 2), k AS (SELECT label, arg_max(vec_id, struct_pack(m := round(m, 9), v := -vec_id)) AS vec_id FROM m GROUP BY 1)
            SELECT a.label, a.vec_id, round(({DOT} + 1) / 2, 4) AS reward FROM {E} a JOIN k ON a.label = k.label JOIN {E} b ON b.vec_id = k.vec_id""",
    ),
    "sim_grade_and_penalty": (
        lambda s, d: s.read.parquet(f"{d}/sanity.parquet").select("row_id", sim.length_penalty(C("answer"), 5).alias("x")),
        "SELECT row_id, CAST(CASE WHEN len(list_filter(string_split_regex(trim(answer), '\\s+'), lambda w: w <> '')) >= 5 THEN 1.0 ELSE 0.7 END AS DOUBLE) AS x FROM sanity",
    ),
    "sim_grade": (
        lambda s, d: _r(emb(s, d).join(emb(s, d).where("vec_id = 0").select(C("embedding").alias("z")), F.lit(True)).select("vec_id", sim.similarity_grade(C("embedding"), C("z")).alias("x")), "x"),
        f"SELECT a.vec_id, round(greatest(least({DOT}, 1), 0), 5) AS x FROM {E} a, (SELECT * FROM {E} WHERE vec_id = 0) b",
    ),
    "reward_banded_novelty": (
        lambda s, d: _r(sim.banded_rewards(_banded(s, d), "label", "vec_id", "band", "embedding"), "reward", digits=4),
        f"""WITH p AS (SELECT label, vec_id, band, avg(sim) FILTER (band = band2) AS i, max(sim) AS t FROM {BAND} GROUP BY 1, 2, 3), n AS (SELECT *, 1 - 0.5 * coalesce(i, 0) - 0.5 * t AS v FROM p),
            u AS (SELECT *, CASE WHEN max(v) OVER w - min(v) OVER w > 1e-12 THEN (v - min(v) OVER w) / (max(v) OVER w - min(v) OVER w) ELSE 0.5 END AS u, count(*) OVER w AS c FROM n WINDOW w AS (PARTITION BY label, band)),
            m AS (SELECT label, arg_max(band, struct_pack(c := c, b := -band)) AS modal FROM u GROUP BY 1)
            SELECT label, vec_id, round(CASE WHEN band = modal THEN 0.5 + 0.5 * u ELSE -1 + 0.5 * u END, 4) AS reward FROM u JOIN m USING (label)""",
    ),
    "cluster_stats": (
        lambda s, d: _r(sim.cluster_stats(_banded(s, d), "label", "vec_id", "band", "embedding"), "intra_sim", "inter_sim"),
        f"SELECT label, round(avg(sim) FILTER (band = band2), 5) AS intra_sim, round(avg(sim) FILTER (band <> band2), 5) AS inter_sim FROM {BAND} GROUP BY 1",
    ),
    "cluster_modal": (
        lambda s, d: sim.modal_cluster(_banded(s, d), "label", "vec_id", "band", "embedding"),
        f"""WITH l AS (SELECT label, vec_id, vec_id % 3 AS band, unnest(e) AS x, generate_subscripts(e, 1) AS dim FROM {E}), c AS (SELECT label, band, dim, avg(x) AS c FROM l GROUP BY 1, 2, 3),
            n AS (SELECT label, band, count(DISTINCT vec_id) AS n FROM l GROUP BY 1, 2), z AS (SELECT label, band, sqrt(sum(c * c)) AS len FROM c GROUP BY 1, 2),
            b AS (SELECT label, arg_max(band, struct_pack(n := n, l := round(len, 9), b := -band)) AS modal, max(n) AS modal_n FROM n JOIN z USING (label, band) GROUP BY 1),
            s AS (SELECT l.label, l.vec_id, sum(x * c) AS s FROM l JOIN b USING (label) JOIN c ON c.label = l.label AND c.band = b.modal AND c.dim = l.dim GROUP BY 1, 2)
            SELECT label, modal, modal_n, arg_max(vec_id, struct_pack(s := round(s, 9), v := -vec_id)) AS anchor FROM s JOIN b USING (label) GROUP BY 1, 2, 3""",
    ),
    "cluster_auto_kmeans": (lambda s, d: sim.auto_kmeans(emb(s, d), "label", "vec_id", "embedding"), None),
    "retrieve_dense": (
        lambda s, d: _r(sim.dense_top_k(emb(s, d), _queries(s, d), 5), "score", digits=4),
        f"""WITH x AS (SELECT q.vec_id AS q_id, v.vec_id, list_sum(list_transform(list_zip(q.embedding, v.embedding), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE))) AS score FROM (SELECT * FROM embeddings WHERE vec_id % 100 = 0) q, embeddings v),
            k AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY round(score, 9) DESC, vec_id) AS k FROM x) SELECT q_id, vec_id, CAST(k AS INT) AS rank, round(score, 4) AS score FROM k WHERE k <= 5""",
    ),
    "retrieve_bm25": (_bm25, BM25),
    "pool_mean": (
        lambda s, d: _r(sim.pooled(emb(s, d), "label", "vec_id", "embedding").select("label", F.posexplode("pooled").alias("dim", "x")), "x"),
        "SELECT label, CAST(dim - 1 AS INT) AS dim, round(avg(x), 5) AS x FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS dim FROM embeddings) GROUP BY 1, 2",
    ),
    "pool_first": (lambda s, d: _r(sim.pooled(emb(s, d), "label", "vec_id", "embedding", "cls").select("label", C("pooled")[0].alias("x")), "x"), "SELECT label, round(arg_min(embedding, vec_id)[1], 5) AS x FROM embeddings GROUP BY 1"),
    "encode_distinct_texts": (
        lambda s, d: _r(sim.encode_distinct(s.read.parquet(f"{d}/amc_ttt.parquet").where("prompt IS NOT NULL").select("row_id", "prompt"), "prompt", lambda t: sim.hashed_ngrams(t, "_k", "text")).select("row_id", F.posexplode("vector").alias("dim", "x")).where("x > 0"), "x", digits=6),
        """WITH g AS (SELECT DISTINCT prompt FROM amc_ttt WHERE prompt IS NOT NULL), n AS (SELECT prompt, unnest(list_transform(range(1, greatest(length(prompt) - 2, 1) + 1), lambda i: substr(lower(prompt), i, 3))) AS g FROM g),
            c AS (SELECT prompt, CAST(CAST('0x' || substr(md5(g), 1, 13) AS BIGINT) % 64 AS INT) AS dim, count(*) AS c FROM n GROUP BY 1, 2), v AS (SELECT prompt, dim, c / sqrt(sum(c * c) OVER (PARTITION BY prompt)) AS x FROM c)
            SELECT row_id, dim, round(x, 6) AS x FROM amc_ttt JOIN v USING (prompt)""",
    ),
}
