"""Writers: Parquet and JSON dumps by step, report files, one-document summaries and long metric tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def parquet_splits(df: DataFrame, path: str, split: str = "split") -> None:
    """One folder per split value."""
    df.write.mode("overwrite").partitionBy(split).parquet(path)


def rollouts_by_step(df: DataFrame, path: str, step: str = "step") -> None:
    """JSON lines of rollouts, a folder per step."""
    df.write.mode("append").partitionBy(step).json(path)


def dump_records(df: DataFrame) -> DataFrame:
    """Offline dump record with a title-cased category."""
    return df.withColumn("category", F.replace(F.initcap(F.trim("category")), F.lit("Av "), F.lit("AV ")))


def report_csv(df: DataFrame, path: str, digits: int = 4) -> None:
    rounded = [F.round(c, digits).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes]
    df.select(*rounded).write.mode("overwrite").option("header", "true").csv(path)


def summary_json(df: DataFrame, key: str, value: str) -> DataFrame:
    """One document with totals and a map from key to value; for reports of bounded size."""
    return df.agg(F.to_json(F.struct(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, value)))).alias("by_key"))).alias("json"))


def long_metrics(df: DataFrame, step: str, *metrics: str) -> DataFrame:
    """(step, key, value) rows of a wide metric table."""
    pairs = F.array(*[F.struct(F.lit(m).alias("key"), F.col(m).cast("double").alias("value")) for m in metrics])
    return df.select(step, F.explode(pairs).alias("m")).select(step, "m.key", "m.value")


def flatten_config(config: dict, sep: str = "/") -> dict:
    """Nested dictionary as one level of joined keys."""
    out: dict = {}
    for k, v in config.items():
        if isinstance(v, dict):
            out.update({f"{k}{sep}{kk}": vv for kk, vv in flatten_config(v, sep).items()})
        else:
            out[str(k)] = v
    return out


def logged_samples(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n generations in the order of a seeded md5 of their key (a distributed top-n)."""
    draw = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), 1, 13), 16, 10).cast("long")
    return df.orderBy(draw, key).limit(n)
