"""Building and checking batches: typed columns, consistency, meta data, padding into chunks, collation, random masks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rolloutlake.operators import frame

#: Largest number of items that collate puts into one row.
MOST_ITEMS = 100_000


def column_kinds(df: DataFrame) -> dict[str, str]:
    """``tensor`` (numbers and nested arrays of numbers) or ``object`` (strings, structs, maps) per column; others are refused."""

    def kind(t: T.DataType, name: str) -> str:
        while isinstance(t, T.ArrayType):
            t = t.elementType
        if isinstance(t, T.NumericType | T.BooleanType):
            return "tensor"
        if isinstance(t, T.StringType | T.StructType | T.MapType):
            return "object"
        raise TypeError(f"column {name!r} of type {t.simpleString()} cannot be part of a batch")

    return {f.name: kind(f.dataType, f.name) for f in df.schema.fields}


def from_columns(spark: SparkSession, columns: Mapping[str, Sequence[Any]], schema: str, index: str = "row_idx") -> DataFrame:
    """A batch with row index from columns held by the driver; all must have one length."""
    lengths = {name: len(values) for name, values in columns.items()}
    if len(set(lengths.values())) > 1:
        raise ValueError(f"columns differ in length: {lengths}")
    rows = [(i, *values) for i, values in enumerate(zip(*columns.values()))]
    df = spark.createDataFrame(rows, f"{index} long, {schema}")
    if df.columns[1:] != list(columns):
        raise ValueError("schema and columns differ in name or order")
    column_kinds(df)
    return df


def inconsistencies(df: DataFrame, arrays: Sequence[str], index: str = "row_idx") -> DataFrame:
    """(column, least, most, rows, missing) of array columns whose lengths differ or are missing, and of an index that is not dense.

    One aggregate over the table; an empty result means that the batch is consistent.
    """
    total = F.count(F.lit(1))
    checks = [F.struct(F.lit(c).alias("column"), F.min(F.size(c)).cast("long").alias("least"), F.max(F.size(c)).cast("long").alias("most"), total.alias("rows"), F.count_if(F.col(c).isNull()).alias("missing")) for c in arrays]
    checks.append(F.struct(F.lit(index).alias("column"), F.min(index).cast("long").alias("least"), F.max(index).cast("long").alias("most"), F.count_distinct(index).alias("rows"), F.count_if(F.col(index).isNull()).alias("missing")))
    told = df.agg(F.array(*checks).alias("_c"), total.alias("_n")).select(F.explode("_c").alias("c"), "_n").select("c.*", "_n")
    dense = (F.col("column") == index) & (F.col("rows") == F.col("_n")) & (F.coalesce("least", F.lit(0)) == 0) & (F.coalesce("most", F.lit(-1)) == F.col("_n") - 1)
    alike = (F.col("column") != index) & F.col("least").eqNullSafe(F.col("most"))
    return told.where(~((F.col("missing") == 0) & (dense | alike))).drop("_n")


def union_meta(first: Mapping[str, Any], second: Mapping[str, Any]) -> dict[str, Any]:
    """Both mappings in one; a key in both must have equal values."""
    for key in first.keys() & second.keys():
        if first[key] != second[key]:
            raise ValueError(f"meta data differ at {key!r}: {first[key]!r} and {second[key]!r}")
    return {**first, **second}


def padded_chunks(df: DataFrame, chunks: int, index: str = "row_idx", out: str = "chunk") -> tuple[DataFrame, int]:
    """Rows padded from the head until they divide, with their chunk; and the number of padded rows."""
    padded, pad = frame.pad_to_divisor(df, chunks, index)
    return frame.chunk(padded, chunks, index=index, out=out), pad


def collate(df: DataFrame, batch: str, order: str, *columns: str) -> DataFrame:
    """One row per batch with an array per column, in order, and ``n_items``; batches above MOST_ITEMS are refused, not cut."""
    n = F.count(F.lit(1))
    sizes = df.groupBy(batch).agg(n.alias("n_items"))
    checked = sizes.withColumn("n_items", F.when(F.col("n_items") <= MOST_ITEMS, F.col("n_items")).otherwise(F.raise_error(F.lit("batch too large to collate")).cast("long")))
    gathered = df.join(checked, batch).groupBy(batch, "n_items").agg(F.array_sort(F.collect_list(F.struct(order, *columns))).alias("_g"))
    return gathered.select(batch, "n_items", *[F.col("_g")[c].alias(c) for c in columns])


def random_mask(key: Column, length: int, most_valid: float = 0.8, most_left: float = 0.5, least_valid: float = 0.05, seed: int = 0) -> Column:
    """A mask of 0s and 1s: left padding, then a valid span, then right padding, of lengths drawn by a hash of the key."""
    share = lambda salt: F.pmod(F.xxhash64(key, F.lit(seed), F.lit(salt)), F.lit(1_000_003)) / 1_000_003.0
    least, most = int(length * least_valid), int(length * most_valid)
    if not 0 < least <= most:
        raise ValueError("the valid span needs at least one token and no more than its largest share")
    valid = F.floor(least + share(1) * (most - least + 1)).cast("int")
    left = F.floor(share(2) * (F.least(F.lit(int(length * most_left)), F.lit(length) - valid) + 1)).cast("int")
    return F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda i: ((i >= left) & (i < left + valid)).cast("int"))


def piecewise_tokens(whole: Column, pieces: Column) -> list[Column]:
    """(tokens, same): the pieces' tokens one after the other, and whether they equal the tokens of the whole; the pieces count."""
    flat = F.flatten(pieces)
    return [flat.alias("tokens"), F.coalesce(flat == whole, F.lit(False)).alias("same")]
