"""Batch algebra on DataFrames with an explicit row index.

Spark rows have no order, so operators that slice, chunk, pad or permute take a dense 0-based index column. It is
made once by ``with_row_index`` and kept. Nothing here sorts a whole table in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Coarse ranges of the order key, most fine ranges in each of them, and rows that a fine range is meant to hold.
RANGES, FINE, RANGE_ROWS = 2048, 2048, 20_000


def with_row_index(df: DataFrame, order: str, out: str = "row_idx", start: int = 0) -> DataFrame:
    """Dense index in the order of a numeric, unique column; rows without it are left out.

    The key's span is cut into ranges, more of them the more rows there are, so that clustered keys still fall into
    many. The ranges' row counts are cumulated inside coarse ranges and over these (at most RANGES of them), and rows
    are numbered inside their range: one shuffle by range, and no window spans the table.
    """
    told = df.agg(F.min(order).alias("lo"), F.max(order).alias("hi"), F.count(order).alias("n")).first()
    fine = max(1, min(FINE, int(told["n"] // (RANGES * RANGE_ROWS)) + 1))
    lo, hi = (told["lo"], told["hi"]) if told["n"] else (0, 0)
    place = F.floor((F.col(order) - F.lit(lo)) / F.lit(hi - lo + 1) * (RANGES * fine)).cast("int")
    cut = df.where(F.col(order).isNotNull()).withColumn("_range", place)
    sizes = cut.groupBy("_range").agg(F.count(F.lit(1)).alias("_n")).withColumn("_coarse", F.floor(F.col("_range") / fine))
    coarse = sizes.groupBy("_coarse").agg(F.sum("_n").alias("_s"))
    over = coarse.select("_coarse", F.coalesce(F.sum("_s").over(Window.orderBy("_coarse").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_o"))
    inside = F.sum("_n").over(Window.partitionBy("_coarse").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.withColumn("_w", F.coalesce(inside, F.lit(0))).join(over, "_coarse").select("_range", (F.col("_o") + F.col("_w")).alias("_before"))
    numbered = cut.join(offsets, "_range").withColumn(out, F.col("_before") + F.row_number().over(Window.partitionBy("_range").orderBy(order)) - 1 + start)
    return numbered.drop("_range", "_before")


def select_indices(df: DataFrame, indices: list[int], index: str = "row_idx") -> DataFrame:
    """Rows by index list; order (``pos``) and repeats are kept, negative indices count from the end."""
    n = df.count() if any(i < 0 for i in indices) else 0
    wanted = df.sparkSession.createDataFrame([(p, i + n if i < 0 else i) for p, i in enumerate(indices)], f"pos long, {index} long")
    return wanted.join(df, index)


def select_mask(df: DataFrame, mask: Column) -> DataFrame:
    """Rows where the mask is true (null counts as false)."""
    return df.where(mask)


def slice_rows(df: DataFrame, start: int | None = None, stop: int | None = None, step: int = 1, index: str = "row_idx") -> DataFrame:
    """Rows of a slice with Python's meaning of start, stop and step, negatives included."""
    n = df.count() if any(x is not None and x < 0 for x in (start, stop)) or step < 0 else None
    if step < 0:
        wanted = range(n)[slice(start, stop, step)]
        if not len(wanted):
            return df.limit(0)
        lo, hi = wanted[-1], wanted[0]
        return df.where((F.col(index) >= lo) & (F.col(index) <= hi) & (F.pmod(F.lit(hi) - F.col(index), F.lit(-step)) == 0))
    first = 0 if start is None else start + n if start < 0 else start
    out = df.where(F.col(index) >= max(0, first))
    if stop is not None:
        out = out.where(F.col(index) < (stop + n if stop < 0 else stop))
    return out.where(F.pmod(F.col(index) - max(0, first), F.lit(step)) == 0) if step != 1 else out


def pop_columns(df: DataFrame, *columns: str) -> tuple[DataFrame, DataFrame]:
    """(popped columns, rest); the input is left as it is."""
    return df.select(*columns), df.drop(*columns)


def rename_columns(df: DataFrame, old: list[str], new: list[str]) -> DataFrame:
    if len(old) != len(new):
        raise ValueError("old and new names differ in number")
    return df.withColumnsRenamed(dict(zip(old, new)))


def union_columns(left: DataFrame, right: DataFrame, index: str = "row_idx") -> DataFrame:
    """Row-by-row union of columns; a column in both must be equal everywhere (nulls and NaN equal themselves)."""
    shared = [c for c in right.columns if c in left.columns and c != index]
    other = right.withColumnsRenamed({c: f"_r_{c}" for c in shared})
    joined = left.join(other, index)
    for c in shared:
        same = F.col(c).eqNullSafe(F.col(f"_r_{c}"))
        joined = joined.withColumn(c, F.when(same, F.col(c)).otherwise(F.raise_error(F.lit(f"column {c} differs")).cast(left.schema[c].dataType)))
    return joined.drop(*[f"_r_{c}" for c in shared])


def concat_rows(*parts: DataFrame) -> DataFrame:
    """Rows of all parts with the ordinal of their part; all must have the columns of the first."""
    first = set(parts[0].columns)
    for p in parts[1:]:
        if set(p.columns) != first:
            raise ValueError("parts differ in columns")
    out = parts[0].withColumn("part", F.lit(0))
    for k, p in enumerate(parts[1:], 1):
        out = out.unionByName(p.withColumn("part", F.lit(k)))
    return out


def chunk(df: DataFrame, chunks: int, n: int | None = None, index: str = "row_idx", out: str = "chunk") -> DataFrame:
    """Number of the contiguous equal part of each row; the rows must divide evenly."""
    n = df.count() if n is None else n
    if n % chunks:
        raise ValueError(f"{n} rows do not divide into {chunks} equal chunks")
    return df.withColumn(out, F.floor(F.col(index) / (n // chunks)).cast("int"))


def fixed_batches(df: DataFrame, size: int, index: str = "row_idx", out: str = "batch_no") -> DataFrame:
    """Number of the fixed-size batch of each row; the last batch may be short."""
    return df.withColumn(out, F.floor(F.col(index) / size).cast("long"))


def reorder(df: DataFrame, permutation: DataFrame, index: str = "row_idx") -> DataFrame:
    """Row ``index`` becomes row ``new_idx`` of the permutation (index, new_idx), a table of its own; it must hold each index once."""
    counts = permutation.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(index).alias("a"), F.count_distinct("new_idx").alias("b"), F.min("new_idx").alias("lo"), F.max("new_idx").alias("hi"), F.min(index).alias("first"), F.max(index).alias("last")).first()
    if counts["n"] and (len({counts["n"], counts["a"], counts["b"], counts["hi"] + 1, counts["last"] + 1}) > 1 or counts["lo"] or counts["first"]):
        raise ValueError("not a permutation")
    return df.join(permutation.select(index, "new_idx"), index).drop(index).withColumnRenamed("new_idx", index)


def repeat_rows(df: DataFrame, times: int, interleave: bool = True, n: int | None = None, index: str = "row_idx") -> DataFrame:
    """Every row ``times`` times: a a b b when interleaved, a b a b when tiled; the index is made anew."""
    copies = df.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))
    if interleave:
        return copies.withColumn(index, F.col(index) * times + F.col("copy"))
    return copies.withColumn(index, F.col("copy") * (df.count() if n is None else n) + F.col(index))


def repeat_each(df: DataFrame, times: Column) -> DataFrame:
    """Row i as often as ``times`` says; rows with 0 vanish."""
    return df.withColumn("_t", times).where(F.col("_t") > 0).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("_t")))).drop("_t")


def unfold_column_chunks(df: DataFrame, columns: list[str], parts: int) -> DataFrame:
    """Arrays of ``columns`` cut into ``parts`` equal pieces, one row each (``piece``); other columns repeat."""
    rows = df.withColumn("piece", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    for c in columns:
        width = (F.size(c) / parts).cast("int")
        rows = rows.withColumn(c, F.slice(F.col(c), F.col("piece") * width + 1, width))
    return rows


def fold(df: DataFrame, columns: list[str], group_size: int, index: str = "row_idx") -> DataFrame:
    """Groups of consecutive rows as one row of arrays, in index order."""
    gathered = F.array_sort(F.collect_list(F.struct(index, *columns)))
    folded = df.groupBy(F.floor(F.col(index) / group_size).alias("fold_idx")).agg(gathered.alias("_g"))
    return folded.select("fold_idx", *[F.col("_g")[c].alias(c) for c in columns])


def unfold(df: DataFrame, columns: list[str], fold_index: str = "fold_idx", index: str = "row_idx") -> DataFrame:
    """Inverse of fold, for folds of equal size."""
    zipped = df.select(fold_index, F.size(columns[0]).alias("_k"), F.posexplode(F.arrays_zip(*columns)))
    return zipped.select((F.col(fold_index) * F.col("_k") + F.col("pos")).alias(index), *[F.col(f"col.{c}").alias(c) for c in columns])


def pad_to_divisor(df: DataFrame, divisor: int, index: str = "row_idx") -> tuple[DataFrame, int]:
    """Rows from the head, cyclically, are appended until the number divides; returns the number of padded rows."""
    n = df.count()
    pad = -n % divisor
    if not pad:
        return df, 0
    rounds = -(-pad // n)
    extra = df.where(F.col(index) < pad).withColumn("_c", F.explode(F.sequence(F.lit(1), F.lit(rounds)))).withColumn(index, F.col(index) + F.col("_c") * n)
    return df.unionByName(extra.where(F.col(index) < n + pad).drop("_c")), pad


def unpad(df: DataFrame, pad: int, index: str = "row_idx") -> DataFrame:
    """Drops the last ``pad`` rows."""
    return df if not pad else df.where(F.col(index) < df.count() - pad)


def pad_with(df: DataFrame, size: int, candidate: str = "first", index: str = "row_idx") -> DataFrame:
    """``size`` copies of the first or last row are appended."""
    n = df.count()
    source = df.where(F.col(index) == (0 if candidate == "first" else n - 1))
    extra = source.withColumn(index, F.explode(F.sequence(F.lit(n), F.lit(n + size - 1)))) if size else source.limit(0)
    return df.unionByName(extra.select(df.columns))


def mini_batches(df: DataFrame, size: int, epochs: int = 1, seed: int | None = None, key: str = "row_idx") -> DataFrame:
    """(epoch, batch_no) of each row in each epoch; with a seed, rows are ordered by a hash of (key, seed, epoch)."""
    rows = df.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    if seed is None:
        return rows.withColumn("batch_no", F.floor(F.col(key) / size))
    n = df.count()
    if n % size:
        raise ValueError("rows do not divide into mini-batches")
    # Shuffled: the place of a row in its epoch's hash order, numbered inside hash ranges as in with_row_index.
    hashed = rows.withColumn("_h", F.xxhash64(key, F.lit(seed), F.col("epoch"))).withColumn("_r", F.shiftright("_h", 53))
    sizes = hashed.groupBy("epoch", "_r").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("epoch").orderBy("_r").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("epoch", "_r", F.coalesce(before, F.lit(0)).alias("_b"))
    place = F.col("_b") + F.row_number().over(Window.partitionBy("epoch", "_r").orderBy("_h", key)) - 1
    return hashed.join(F.broadcast(offsets), ["epoch", "_r"]).withColumn("batch_no", F.floor(place / size)).drop("_h", "_r", "_b")


def transpose_records(column: Column, *fields: str) -> list[Column]:
    """array<struct> as one array per field."""
    return [column[f].alias(f) for f in fields]


def append_by_key(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """Key to the list of its values in order."""
    return df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, value))).alias("_l")).select(key, F.col("_l")[value].alias("items"))


def size_estimate(df: DataFrame, widths: dict[str, int]) -> DataFrame:
    """Bytes of array columns: elements x width."""
    return df.agg(*[F.sum(F.size(c).cast("long") * w).alias(f"{c}_bytes") for c, w in widths.items()])
