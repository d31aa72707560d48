"""Similarity within groups, medoid, density and cluster rewards, and retrieval over embeddings or an inverted index.

Vectors are array columns. The rows of a group meet as matrix products of blocks, so that a group may have any size.
Retrieval takes a stated set of queries, in blocks, against all rows.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 when either norm is 0."""
    n = norm(a) * norm(b)
    return F.when(n > 1e-12, dot(a, b) / n).otherwise(0.0)


def unit(df: DataFrame, vector: str, out: str = "unit") -> DataFrame:
    n = norm(F.col(vector))
    return df.withColumn(out, F.transform(vector, lambda x: F.when(n > 1e-12, x.cast("double") / n).otherwise(0.0)))


#: Rows of a group that meet as one matrix product; larger groups are cut into blocks of about this size.
BLOCK = 512


def _block_products(df: DataFrame, group: str, key: str, vector: str, read: Callable[..., pd.DataFrame], schema: str, band: str | None = None) -> DataFrame:
    """``read(keys, bands, other keys, other bands, similarities)`` of every pair of blocks of every group; a row's own cell is nan.

    A group of any size is cut into blocks by a hash of the key, and each pair of blocks is one task's matrix product, so
    that no task holds more than two blocks.
    """
    u = unit(df, vector).select(group, key, "unit", (F.col(band) if band else F.lit(0)).alias("_band"))
    blocks = u.groupBy(group).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("_k"))
    placed = u.join(blocks, group).withColumn("_own", F.pmod(F.xxhash64(key), F.col("_k")).cast("int")).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_k") - 1)))
    rows = placed.select(group, key, "unit", "_band", F.col("_own").alias("_i"), F.col("_other").alias("_j"), F.lit(True).alias("_left"))
    rows = rows.unionByName(placed.select(group, key, "unit", "_band", F.col("_other").alias("_i"), F.col("_own").alias("_j"), F.lit(False).alias("_left")))
    names = [c.split()[0] for c in schema.split(",")]

    def run(part: pd.DataFrame) -> pd.DataFrame:
        left, right = part[part["_left"]], part[~part["_left"]]
        if not len(left) or not len(right):
            return pd.DataFrame({n: [] for n in [group, *names]})
        sim = np.stack(left["unit"].to_numpy()) @ np.stack(right["unit"].to_numpy()).T
        a, b = left[key].to_numpy(), right[key].to_numpy()
        sim[a[:, None] == b[None, :]] = np.nan
        out = read(a, left["_band"].to_numpy(), b, right["_band"].to_numpy(), sim)
        out.insert(0, group, part[group].iloc[0])
        return out

    kind = df.schema[group].dataType.simpleString()
    return rows.groupBy(group, "_i", "_j").applyInPandas(run, f"{group} {kind}, {schema}")


def group_pairs(df: DataFrame, group: str, key: str, vector: str) -> DataFrame:
    """(group, key, other, sim) for all ordered pairs of different rows of a group."""
    kind = df.schema[key].dataType.simpleString()

    def read(a, _, b, __, sim):
        i, j = np.nonzero(~np.isnan(sim))
        return pd.DataFrame({key: a[i], "other": b[j], "sim": sim[i, j]})

    return _block_products(df, group, key, vector, read, f"{key} {kind}, other {kind}, sim double")


def pair_stats(df: DataFrame, group: str, key: str, vector: str, band: str | None = None, tau: float = 0.2) -> DataFrame:
    """(group, key) with sums over the other rows of the group: ``n``, ``total`` and ``top`` of the similarity, ``close``
    (above 0.95), ``dense`` (exp((sim - 1) / tau)), and ``n_same``, ``same``, ``n_apart``, ``apart`` within and across bands."""
    kind = df.schema[key].dataType.simpleString()

    def read(a, own, _, other, sim):
        here = ~np.isnan(sim)
        value, alike = np.where(here, sim, 0.0), own[:, None] == other[None, :]
        return pd.DataFrame({
            key: a, "n": here.sum(1), "total": value.sum(1), "top": np.where(here, sim, -np.inf).max(1), "close": (value > 0.95).sum(1), "dense": np.where(here, np.exp((value - 1) / tau), 0.0).sum(1),
            "n_same": (here & alike).sum(1), "same": np.where(alike, value, 0.0).sum(1), "n_apart": (here & ~alike).sum(1), "apart": np.where(alike, 0.0, value).sum(1),
        })

    schema = f"{key} {kind}, n long, total double, top double, close long, dense double, n_same long, same double, n_apart long, apart double"
    sums = [F.sum(c).alias(c) for c in ("n", "total", "close", "dense", "n_same", "same", "n_apart", "apart")]
    found = _block_products(df, group, key, vector, read, schema, band).groupBy(group, key).agg(F.max("top").alias("top"), *sums)
    return found.where("n > 0")


def medoid(df: DataFrame, group: str, key: str, vector: str) -> DataFrame:
    """Per group the row with the largest mean similarity to the others (smallest key on ties) and pair statistics."""
    means = pair_stats(df, group, key, vector).withColumn("m", F.col("total") / F.col("n"))
    return means.groupBy(group).agg(
        F.max_by(key, F.struct(F.round("m", 9), -F.col(key))).alias("medoid"), F.avg("m").alias("mean_sim"), F.max("top").alias("max_sim"), (F.sum("close") / F.sum("n")).alias("share_close")
    )


def density_rewards(df: DataFrame, group: str, key: str, vector: str, tau: float = 0.2) -> DataFrame:
    """Mean of exp((cos - 1) / tau) over the other rows, over the group's largest."""
    raw = pair_stats(df, group, key, vector, tau=tau).select(group, key, (F.col("dense") / F.col("n")).alias("density"))
    most = raw.groupBy(group).agg(F.max("density").alias("_m"))
    return raw.join(most, group).select(group, key, "density", (F.col("density") / F.col("_m")).alias("reward"))


def anchor_rewards(df: DataFrame, anchors: DataFrame, group: str, key: str, vector: str) -> DataFrame:
    """(cos to the group's anchor + 1) / 2; ``anchors`` has (group, medoid)."""
    chosen = df.join(anchors.select(group, F.col("medoid").alias(key)), [group, key], "left_semi").select(group, F.col(vector).alias("_a"))
    return df.join(chosen, group).select(group, key, ((cosine(F.col(vector), F.col("_a")) + 1) / 2).alias("reward"))


def similarity_grade(a: Column, b: Column) -> Column:
    return F.least(F.greatest(cosine(a, b), F.lit(0.0)), F.lit(1.0))


def length_penalty(text: Column, least: int) -> Column:
    """1 with enough words, else 0.7; off when ``least`` is 0."""
    if not least:
        return F.lit(1.0)
    words = F.size(F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != ""))
    return F.when(words >= least, 1.0).otherwise(0.7)


def kmeans_labels(vectors: np.ndarray, k: int, seed: int = 0, starts: int = 4, rounds: int = 50) -> tuple[np.ndarray, float]:
    """Labels and inertia of the best of several seeded starts."""
    rng = np.random.RandomState(seed)
    best: tuple[np.ndarray, float] = (np.zeros(len(vectors), int), float("inf"))
    for _ in range(starts):
        centres = vectors[rng.choice(len(vectors), k, replace=False)]
        labels = np.zeros(len(vectors), int)
        for _ in range(rounds):
            d = ((vectors[:, None] - centres[None]) ** 2).sum(-1)
            new = d.argmin(1)
            if (new == labels).all() and _ > 0:
                break
            labels = new
            centres = np.array([vectors[labels == j].mean(0) if (labels == j).any() else centres[j] for j in range(k)])
        inertia = float(((vectors - centres[labels]) ** 2).sum())
        if inertia < best[1] - 1e-12:
            best = (labels, inertia)
    return best


def silhouette(vectors: np.ndarray, labels: np.ndarray) -> float:
    """Mean cosine silhouette; 0 for one cluster."""
    if len(set(labels)) < 2:
        return 0.0
    d = 1 - vectors @ vectors.T
    out = []
    for i in range(len(vectors)):
        own = (labels == labels[i]) & (np.arange(len(vectors)) != i)
        if not own.any():
            out.append(0.0)
            continue
        a = d[i, own].mean()
        b = min(d[i, labels == j].mean() for j in set(labels) if j != labels[i])
        out.append((b - a) / max(a, b, 1e-12))
    return float(np.mean(out))


#: Most rows of a group that are clustered at once (its silhouette compares all pairs).
MOST_CLUSTERED = 5_000


def auto_kmeans(df: DataFrame, group: str, key: str, vector: str, most: int = 4) -> DataFrame:
    """(group, key, cluster): k from 2 to ``most`` with the best silhouette; groups of up to two rows are singletons, and
    groups of more than MOST_CLUSTERED rows are refused."""
    gk, kk = df.schema[group].dataType.simpleString(), df.schema[key].dataType.simpleString()

    def run(part: pd.DataFrame) -> pd.DataFrame:
        if len(part) > MOST_CLUSTERED:
            raise ValueError("group too large to cluster")
        part = part.sort_values(key)
        v = np.array(part["unit"].tolist(), float)
        labels = np.arange(len(v))
        if len(v) > 2:
            scored = [(silhouette(v, lab), -k, lab) for k in range(2, min(most, len(v) - 1) + 1) for lab in [kmeans_labels(v, k)[0]]]
            labels = max(scored, key=lambda x: (round(x[0], 9), x[1]))[2]
        return pd.DataFrame({group: part[group], key: part[key], "cluster": labels.astype(int)})

    return unit(df, vector).select(group, key, "unit").groupBy(group).applyInPandas(run, f"{group} {gk}, {key} {kk}, cluster int")


def modal_cluster(df: DataFrame, group: str, key: str, cluster: str, vector: str) -> DataFrame:
    """Largest cluster per group (tie: higher mean similarity to its centroid) and the row nearest its centroid."""
    u = unit(df, vector)
    long = u.select(group, key, cluster, F.posexplode("unit").alias("dim", "x"))
    centroid = long.groupBy(group, cluster, "dim").agg(F.avg("x").alias("c"))
    sizes = u.groupBy(group, cluster).agg(F.count(F.lit(1)).alias("n"))
    length = centroid.groupBy(group, cluster).agg(F.sqrt(F.sum(F.col("c") * F.col("c"))).alias("len"))
    best = sizes.join(length, [group, cluster]).groupBy(group).agg(F.max_by(cluster, F.struct("n", F.round("len", 9), -F.col(cluster))).alias("modal"), F.max("n").alias("modal_n"))
    anchor_dims = centroid.join(best.select(group, F.col("modal").alias(cluster)), [group, cluster], "left_semi").select(group, "dim", "c")
    near = long.join(anchor_dims, [group, "dim"]).groupBy(group, key).agg(F.sum(F.col("x") * F.col("c")).alias("s"))
    anchor = near.groupBy(group).agg(F.max_by(key, F.struct(F.round("s", 9), -F.col(key))).alias("anchor"))
    return best.join(anchor, group)


def binary_cluster_reward(cluster: Column, modal: Column) -> Column:
    return F.when(cluster == modal, 1.0).otherwise(0.0)


def banded_rewards(df: DataFrame, group: str, key: str, band: str, vector: str) -> DataFrame:
    """Novelty 1 - half the mean similarity within the band - half the group's maximum, scaled per band: the largest band to [0.5, 1], others to [-1, -0.5]."""
    stats = pair_stats(df, group, key, vector, band).join(df.select(group, key, band), [group, key])
    intra = F.when(F.col("n_same") > 0, F.col("same") / F.col("n_same")).otherwise(0.0)
    nov = stats.select(group, key, band, (1 - 0.5 * intra - 0.5 * F.col("top")).alias("novelty"))
    w = Window.partitionBy(group, band)
    lo, hi = F.min("novelty").over(w), F.max("novelty").over(w)
    scaled = nov.withColumn("u", F.when(hi - lo > 1e-12, (F.col("novelty") - lo) / (hi - lo)).otherwise(0.5)).withColumn("size", F.count(F.lit(1)).over(w))
    modal = scaled.groupBy(group).agg(F.max_by(band, F.struct("size", -F.col(band))).alias("modal"))
    return scaled.join(modal, group).select(group, key, F.when(F.col(band) == F.col("modal"), 0.5 + 0.5 * F.col("u")).otherwise(-1 + 0.5 * F.col("u")).alias("reward"))


def cluster_stats(df: DataFrame, group: str, key: str, band: str, vector: str) -> DataFrame:
    """Mean similarity of pairs within one band and across bands; a row is never paired with itself."""
    stats = pair_stats(df, group, key, vector, band)
    mean = lambda total, n: F.try_divide(F.sum(total), F.sum(n))
    return stats.groupBy(group).agg(mean("same", "n_same").alias("intra_sim"), mean("apart", "n_apart").alias("inter_sim"))


def dense_top_k(docs: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", query: str = "q_id", vector: str = "embedding", query_vector: str = "q_vec") -> DataFrame:
    """Top k rows by inner product for a stated query set, in blocks.

    Queries are taken in blocks of about MOST_QUERIES (counted first), each sent to the executors once. A batch of the
    corpus meets a block as matrix products of 256 queries at a time and keeps its own top k per query; only those
    reach the shuffle.
    """
    blocks = max(1, -(-queries.count() // MOST_QUERIES))
    qk, dk = queries.schema[query].dataType.simpleString(), docs.schema[key].dataType.simpleString()
    found = None
    for b in range(blocks):
        rows = queries.where(F.pmod(F.xxhash64(query), F.lit(blocks)) == b).select(query, query_vector).collect()
        part = docs.select(key, vector).mapInPandas(_block_search(docs.sparkSession, rows, k, key, query, vector), f"{query} {qk}, {key} {dk}, score double")
        found = part if found is None else found.unionByName(part)
    rank = F.row_number().over(Window.partitionBy(query).orderBy(F.round("score", 9).desc(), key))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def _block_search(spark, rows, k: int, key: str, query: str, vector: str):
    sent = spark.sparkContext.broadcast([(r[0], list(r[1])) for r in rows])

    def run(frames):
        ids = [r[0] for r in sent.value]
        q = np.array([r[1] for r in sent.value], float)
        for part in frames:
            if not len(part) or not len(ids):
                continue
            x = np.stack(part[vector].to_numpy()).astype(float)
            keys = part[key].to_numpy()
            for at in range(0, len(ids), 256):
                scores = np.round(x @ q[at : at + 256].T, 9)
                least = np.partition(scores, max(0, len(keys) - k), axis=0)[max(0, len(keys) - k)]
                for j in range(scores.shape[1]):
                    near = np.flatnonzero(scores[:, j] >= least[j])
                    order = near[np.lexsort((keys[near], -scores[near, j]))][:k]
                    yield pd.DataFrame({query: [ids[at + j]] * len(order), key: keys[order], "score": scores[order, j]})

    return run


#: Size of a block of queries (vectors of 64 floats: 5 MB).
MOST_QUERIES = 20_000


def bm25(docs: DataFrame, queries: DataFrame, k: int, key: str = "doc_id", text: str = "text", query: str = "q_id", query_text: str = "q_text", k1: float = 0.9, b: float = 0.4) -> DataFrame:
    """Top k documents per query by BM25 over an inverted index restricted to the queries' terms.

    Term counts are aggregated per document before anything is joined; the index is joined with the query terms on
    the term, so its cost follows the postings of queried terms.
    """
    tokens = lambda c: F.filter(F.split(F.lower(F.coalesce(F.col(c), F.lit(""))), r"[^a-z0-9]+"), lambda w: w != "")
    toks = docs.select(key, tokens(text).alias("_t"))
    stats = toks.agg(F.count(F.lit(1)).alias("_n"), F.avg(F.size("_t")).alias("_avg"))
    wanted = queries.select(query, F.explode(F.array_distinct(tokens(query_text))).alias("term"))
    terms = wanted.select("term").distinct()
    postings = toks.select(key, F.size("_t").alias("_len"), F.explode("_t").alias("term")).join(terms, "term", "left_semi").groupBy("term", key, "_len").agg(F.count(F.lit(1)).alias("_tf"))
    df = postings.groupBy("term").agg(F.count(F.lit(1)).alias("_df"))
    weighted = postings.join(df, "term").crossJoin(F.broadcast(stats)).select(
        "term", key,
        (F.log(1 + (F.col("_n") - F.col("_df") + 0.5) / (F.col("_df") + 0.5)) * F.col("_tf") * (k1 + 1) / (F.col("_tf") + k1 * (1 - b + b * F.col("_len") / F.col("_avg")))).alias("w"),
    )
    scores = wanted.join(weighted, "term").groupBy(query, key).agg(F.sum("w").alias("score"))
    rank = F.row_number().over(Window.partitionBy(query).orderBy(F.round("score", 6).desc(), key))
    return scores.withColumn("rank", rank).where(F.col("rank") <= k)


def pooled(df: DataFrame, group: str, order: str, vector: str, how: str = "mean") -> DataFrame:
    """Mean, first (cls) or last vector of a group."""
    if how == "mean":
        dims = df.select(group, F.posexplode(vector).alias("dim", "x")).groupBy(group, "dim").agg(F.avg("x").alias("x"))
        return dims.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda s: s["x"]).alias("pooled"))
    pick = F.min_by if how == "cls" else F.max_by
    return df.groupBy(group).agg(pick(vector, order).alias("pooled"))


def encode_distinct(df: DataFrame, text: str, encoder) -> DataFrame:
    """Encode each distinct text once (``encoder``: DataFrame with ``_k, text`` to ``_k, vector``) and join back by its sha1."""
    keyed = df.withColumn("_k", F.sha1(text))
    once = encoder(keyed.groupBy("_k").agg(F.first(text).alias("text")))
    return keyed.join(once, "_k").drop("_k")


def hashed_ngrams(df: DataFrame, key: str, text: str, dims: int = 64, n: int = 3, out: str = "vector") -> DataFrame:
    """Offline stand-in for an encoder: (key, vector) of normalised counts of hashed character n-grams."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1)))
    grams = df.select(key, F.explode(F.transform(starts, lambda i: F.substring(F.lower(text), i, F.lit(n)))).alias("_g"))
    counts = grams.groupBy(key, F.pmod(F.conv(F.substring(F.md5("_g"), 1, 13), 16, 10).cast("long"), F.lit(dims)).cast("int").alias("_d")).agg(F.count(F.lit(1)).cast("double").alias("_c"))
    maps = counts.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("_d", "_c"))).alias("_m"), F.sqrt(F.sum(F.col("_c") * F.col("_c"))).alias("_n"))
    return maps.select(key, F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda d: F.coalesce(F.col("_m")[d], F.lit(0.0)) / F.col("_n")).alias(out))
