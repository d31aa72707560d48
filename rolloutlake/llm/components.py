"""Connected components by random-mate contraction, in SQL joins over the shared folder.

Every round each vertex draws a coin by a hash of (round, vertex). A tail with a head neighbour collapses into the
smallest such neighbour, and so does a leaf whose neighbour is a head; edges are renamed, loops and repeats vanish. Rounds go on until hardly an edge is left. The
collapses of the rounds are then unwound, last round first, into one label per vertex. The last FEW edges are finished
in one task instead of in many tiny rounds. Expected rounds grow with the logarithm of the number of vertices; nothing is
collected but counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolloutlake.llm import common


def _head(column: str, round_: int) -> Column:
    """Heads: seven of eight vertices in even rounds, in which hubs draw in what hangs on them, half of them in odd ones."""
    return F.pmod(F.xxhash64(F.lit(round_), F.col(column)), F.lit(8)) < (4 if round_ % 2 else 7)


#: Edges that are finished in one task when no more are left.
FEW = 2_000


def _rest(edges: DataFrame) -> DataFrame:
    """(vertex, root) of at most FEW edges, worked out in one task: the smallest vertex of each component is its root."""
    kind = edges.schema["a"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict = {}

        def find(x):
            while parent.setdefault(x, x) != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        column = None
        for batch in batches:
            column = batch.column(0).type
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
        if parent:
            vertices = list(parent)
            yield pa.RecordBatch.from_arrays([pa.array(vertices, column), pa.array([find(v) for v in vertices], column)], names=["vertex", "root"])

    return edges.select("a", "b").coalesce(1).mapInArrow(run, f"vertex {kind}, root {kind}")


def random_mate(edges: DataFrame, max_rounds: int = 200) -> DataFrame:
    """(vertex, root) of every vertex on an edge (a, b); vertices alike within a component share their root.

    Loops, repeated edges and nulls are allowed and add nothing. ``root`` is some vertex of the component, the
    same in every run.
    """
    def clean(e: DataFrame) -> DataFrame:
        lo, hi = F.least("a", "b"), F.greatest("a", "b")
        return e.where("a <> b").select(lo.alias("a"), hi.alias("b")).distinct()

    labels = None
    told = now = common.written(clean(edges.where("a IS NOT NULL AND b IS NOT NULL")), "edges")
    rounds: list[DataFrame] = []
    while left_over := now.count():
        if left_over <= FEW:
            labels = common.written(_rest(now), "labels")
            break
        if len(rounds) >= max_rounds:
            raise RuntimeError("contraction did not end")
        k = len(rounds)
        both = now.select("a", "b").unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both.groupBy("a").agg(F.min(F.when(_head("b", k), F.col("b"))).alias("mate"), F.count("*").alias("degree"))
        # Besides tails, a vertex with one neighbour collapses into it if that is a head and the smaller one; nothing but
        # its neighbour could collapse into it, so no mate collapses in the round in which it is one.
        falls = ~_head("a", k) | ((F.col("degree") == 1) & (F.col("mate") < F.col("a")))
        collapse = common.written(near.where(F.col("mate").isNotNull() & falls).select(F.col("a").alias("vertex"), "mate"), "mates")
        rounds.append(collapse)
        left = now.join(collapse.withColumnsRenamed({"vertex": "a", "mate": "ma"}), "a", "left").select(F.coalesce("ma", "a").alias("a"), "b")
        right = left.join(collapse.withColumnsRenamed({"vertex": "b", "mate": "mb"}), "b", "left").select("a", F.coalesce("mb", "b").alias("b"))
        now = common.written(clean(right), "edges")
    # Unwind: in the last round mates are roots; in the rounds before, a mate's root is looked up.
    names = told.select(F.col("a").alias("vertex")).unionByName(told.select(F.col("b").alias("vertex"))).distinct()
    for collapse in reversed(rounds):
        if labels is None:
            labels = collapse.select("vertex", F.col("mate").alias("root"))
            continue
        later = labels.withColumnsRenamed({"vertex": "mate", "root": "later"})
        here = collapse.join(later, "mate", "left").select("vertex", F.coalesce("later", "mate").alias("root"))
        labels = common.written(labels.unionByName(here), "labels")
    if labels is None:
        return names.select("vertex", F.col("vertex").alias("root"))
    return names.join(labels, "vertex", "left").select("vertex", F.coalesce("root", "vertex").alias("root"))


def min_label(edges: DataFrame, max_rounds: int = 200) -> DataFrame:
    """(vertex, root) with root the smallest vertex of the component: alternating large-star and small-star steps.

    Each step hangs the neighbours of a vertex on the smallest of them, so depths shrink as in pointer jumping.
    Vertices have to be numbers or strings with a total order; loops, repeats and nulls add nothing.
    """
    def pairs(e: DataFrame) -> DataFrame:
        return e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()

    now = common.written(pairs(edges.where("a IS NOT NULL AND b IS NOT NULL")), "links")
    if now.count() <= FEW:
        return common.written(_rest(now), "labels")
    names = now.select(F.col("a").alias("vertex")).unionByName(now.select(F.col("b").alias("vertex"))).distinct()
    before = (-1, -1)
    for _ in range(max_rounds):
        # Large star: every larger neighbour of v is hung on v's smallest neighbour (or v itself).
        both = now.select("a", "b").unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # Small star: v and its smaller neighbours are hung on the smallest of them.
        small_least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(small_least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        now = common.written(small.unionByName(small_least.select("a", F.col("m").alias("b"))).distinct(), "links")
        told = now.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
        after = (told[0], told[1])
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("labels did not settle")
    return names.join(now.withColumnsRenamed({"a": "vertex", "b": "root"}), "vertex", "left").select("vertex", F.coalesce("root", "vertex").alias("root"))
