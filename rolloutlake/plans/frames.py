"""Batch algebra queries on events (a rollout table) with a dense index in the order of event_id."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolloutlake.operators import frame


def indexed(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    events = spark.read.parquet(f"{d}/events.parquet").select("event_id", *(columns or ("user_id", "value")))
    return frame.with_row_index(events, "event_id")


I = "(SELECT event_id, user_id, event_type, value, row_number() OVER (ORDER BY event_id) - 1 AS row_idx FROM events)"  # noqa: E741
N = "(SELECT count(*) FROM events)"


def _slice(start, stop, step):
    return lambda s, d: frame.slice_rows(indexed(s, d), start, stop, step).select("event_id", "value")


def _chunk(s, d):
    df = indexed(s, d, "value")
    n = df.count()
    even = df.where(F.col("row_idx") < n - n % 8)
    return frame.chunk(even, 8, n - n % 8).groupBy("chunk").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"), F.round(F.sum("value"), 4).alias("total"))


def _fold(s, d):
    folded = frame.fold(indexed(s, d), ["event_id", "value"], 5)
    return frame.unfold(folded.where(F.size("event_id") == 5), ["event_id", "value"]).select("row_idx", "event_id", "value")


def _concat(s, d):
    df = indexed(s, d, "value")
    return frame.concat_rows(df.where("row_idx % 2 = 0"), df.where("row_idx % 3 = 0")).groupBy("part").agg(F.count("*").alias("n"), F.sum("row_idx").alias("s"))


def _arrays(s, d):
    return s.read.parquet(f"{d}/embeddings.parquet").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("e"))


def _reordered(s, d):
    """All rows in reverse."""
    rows = indexed(s, d)
    n = rows.count()
    return frame.reorder(rows, rows.select("row_idx", (n - 1 - F.col("row_idx")).alias("new_idx"))).select("row_idx", "event_id")


CATALOG = {
    "frame_index": (lambda s, d: indexed(s, d).select("event_id", "row_idx"), f"SELECT event_id, row_idx FROM {I}"),
    "frame_select_idx": (
        lambda s, d: frame.select_indices(indexed(s, d), [5, 0, 7, 5, 99]).select("pos", "event_id", "value"),
        f"SELECT p.pos, i.event_id, i.value FROM (VALUES (0, 5), (1, 0), (2, 7), (3, 5), (4, 99)) p(pos, k) JOIN {I} i ON i.row_idx = p.k",
    ),
    "frame_select_mask": (
        lambda s, d: frame.select_mask(indexed(s, d), F.col("value") > 50).select("event_id"),
        "SELECT event_id FROM events WHERE value > 50",
    ),
    "frame_slice": (_slice(10, -10, 3), f"SELECT event_id, value FROM {I} WHERE row_idx >= 10 AND row_idx < {N} - 10 AND (row_idx - 10) % 3 = 0"),
    "frame_slice_back": (_slice(None, None, -4), f"SELECT event_id, value FROM {I} WHERE ({N} - 1 - row_idx) % 4 = 0"),
    "frame_select": (lambda s, d: s.read.parquet(f"{d}/events.parquet").select("event_id", "value"), "SELECT event_id, value FROM events"),
    "frame_pop": (lambda s, d: frame.pop_columns(indexed(s, d), "user_id", "value")[1], f"SELECT event_id, row_idx FROM {I}"),
    "frame_rename": (lambda s, d: frame.rename_columns(indexed(s, d), ["value", "user_id"], ["reward", "uid"]), f"SELECT event_id, user_id AS uid, value AS reward, row_idx FROM {I}"),
    "frame_union_columns": (
        lambda s, d: frame.union_columns(indexed(s, d), indexed(s, d, "event_type", "value").drop("event_id")).select("row_idx", "event_id", "event_type", "value"),
        f"SELECT row_idx, event_id, event_type, value FROM {I}",
    ),
    "frame_concat": (_concat, f"SELECT 0 AS part, count(*) AS n, CAST(sum(row_idx) AS BIGINT) AS s FROM {I} WHERE row_idx % 2 = 0 UNION ALL SELECT 1, count(*), CAST(sum(row_idx) AS BIGINT) FROM {I} WHERE row_idx % 3 = 0"),
    "frame_chunk": (
        _chunk,
        f"""SELECT CAST(row_idx // (({N} - {N} % 8) // 8) AS INT) AS chunk, count(*) AS n, min(event_id) AS first_id, round(sum(value), 4) AS total
            FROM {I} WHERE row_idx < {N} - {N} % 8 GROUP BY 1""",
    ),
    "frame_fixed_batches": (
        lambda s, d: frame.fixed_batches(indexed(s, d), 64).groupBy("batch_no").agg(F.count("*").alias("n"), F.max("event_id").alias("last_id")),
        f"SELECT row_idx // 64 AS batch_no, count(*) AS n, max(event_id) AS last_id FROM {I} GROUP BY 1",
    ),
    "frame_reorder": (
        _reordered,
        "SELECT row_number() OVER (ORDER BY event_id DESC) - 1 AS row_idx, event_id FROM events",
    ),
    "frame_repeat_interleave": (
        lambda s, d: frame.repeat_rows(indexed(s, d), 3).select("row_idx", "event_id", "copy"),
        f"SELECT i.row_idx * 3 + c AS row_idx, event_id, CAST(c AS INT) AS copy FROM {I} i, range(3) r(c)",
    ),
    "frame_repeat_tiled": (
        lambda s, d: frame.repeat_rows(indexed(s, d), 2, interleave=False).select("row_idx", "event_id"),
        f"SELECT c * {N} + i.row_idx AS row_idx, event_id FROM {I} i, range(2) r(c)",
    ),
    "frame_repeat_each": (
        lambda s, d: frame.repeat_each(indexed(s, d), (F.col("event_id") % 4).cast("int")).select("event_id", "copy"),
        "SELECT event_id, CAST(c + 1 AS INT) AS copy FROM events, range(3) r(c) WHERE c < event_id % 4",
    ),
    "frame_unfold_chunks": (
        lambda s, d: frame.unfold_column_chunks(_arrays(s, d), ["e"], 4).select("vec_id", "piece", "label", F.round(F.aggregate("e", F.lit(0.0), lambda a, x: a + x), 4).alias("total")),
        "SELECT vec_id, CAST(p AS INT) AS piece, label, round(list_sum(list_transform(embedding[p * 16 + 1 : p * 16 + 16], lambda x: CAST(x AS DOUBLE))), 4) AS total FROM embeddings, range(4) r(p)",
    ),
    "frame_fold_unfold": (_fold, f"SELECT row_idx, event_id, value FROM {I} WHERE row_idx < {N} - {N} % 5"),
    "frame_pad_divisor": (
        lambda s, d: frame.pad_to_divisor(indexed(s, d), 97)[0].select("row_idx", "event_id"),
        f"SELECT row_idx, event_id FROM {I} UNION ALL SELECT row_idx + {N}, event_id FROM {I} WHERE row_idx < (97 - {N} % 97) % 97",
    ),
    "frame_unpad": (lambda s, d: frame.unpad(indexed(s, d), 13).select("event_id"), f"SELECT event_id FROM {I} WHERE row_idx < {N} - 13"),
    "frame_pad_with_last": (
        lambda s, d: frame.pad_with(indexed(s, d), 5, "last").select("row_idx", "event_id"),
        f"SELECT row_idx, event_id FROM {I} UNION ALL SELECT {N} + c, event_id FROM {I}, range(5) r(c) WHERE row_idx = {N} - 1",
    ),
    "frame_mini_batches": (
        lambda s, d: frame.mini_batches(indexed(s, d), 50, 2).groupBy("epoch", "batch_no").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids")),
        f"SELECT CAST(e AS INT) AS epoch, row_idx // 50 AS batch_no, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM {I}, range(2) r(e) GROUP BY 1, 2",
    ),
    "frame_append_by_key": (
        lambda s, d: frame.append_by_key(s.read.parquet(f"{d}/events.parquet"), "user_id", "event_type", "event_id").select("user_id", F.array_join("items", ",").alias("joined")),
        "SELECT user_id, string_agg(event_type, ',' ORDER BY event_id) AS joined FROM events GROUP BY 1",
    ),
    "frame_transpose_records": (
        lambda s, d: s.read.parquet(f"{d}/events.parquet").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", "value"))).alias("r")).select("user_id", *frame.transpose_records(F.col("r"), "event_id")).select("user_id", F.array_join(F.col("event_id").cast("array<string>"), " ").alias("ids")),
        "SELECT user_id, string_agg(CAST(event_id AS VARCHAR), ' ' ORDER BY event_id) AS ids FROM events GROUP BY 1",
    ),
    "frame_size_estimate": (
        lambda s, d: frame.size_estimate(s.read.parquet(f"{d}/embeddings.parquet"), {"embedding": 4}),
        "SELECT CAST(sum(len(embedding)) * 4 AS BIGINT) AS embedding_bytes FROM embeddings",
    ),
}
