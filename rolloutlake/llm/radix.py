"""Problem 4: records that differ only in formatting, by recursive radix partitioning and per-bucket tries.

A text's canonical form drops letter case, white space, invisible characters and punctuation, and sorts option
lines without their letters. Buckets are prefixes of the canonical form. A bucket with more rows than
``bucket_rows`` is split by further characters, level by level; one that is still too large at the deepest level
(many copies of one text) is salted. Each bucket is read into one trie whose terminal nodes count the copies and
keep the smallest row id; terminals of salted buckets are merged once more by canonical form. No bucket, however
hot its text, is ever held by one task beyond ``bucket_rows`` rows in expectation.

Null and blank texts are no records here and come out nowhere. Texts with nothing left but punctuation are copies
of each other within their table (equal canonical forms). Repeated rows are copies; ties go to the smallest row
id. Whole texts of any length are used; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rolloutlake.llm import common

#: Fixed values of the problem: signs that do not count, besides every kind of white space and invisible
#: character. Quotes and backticks of every kind, dashes, the ellipsis and full-width forms.
PUNCTUATION = (
    ".,;:!?()[]"
    "…–—"
    "'\"`´‘’‚‛“”„‟′″‵‶«»‹›「」『』〝〞〟"
    "．，；：！？（）［］＂＇｀｢｣。、｡､"
)

#: Prefix lengths of the radix levels.
LEVELS = (6, 12, 24, 48, 96)

#: Up to this number oversized prefixes are broadcast (under 50 MB).
SENT = 100_000


def _class(chars: str) -> str:
    return "".join("\\" + c if c in "[]\\^-&.()?" else c for c in chars)


_DROP = rf"[\s\p{{Z}}\p{{C}}{_class(PUNCTUATION)}]+"
_LINE = r"\r\n|[\n\r\u000B\u000C\u0085  ]"
_LEAD = r"^[\s\p{Z}\p{C}]*"
#: Brackets and other signs before the letter are punctuation and do not count.
_OPTION = _LEAD + r"[(\[（［]?[\s\p{Z}\p{C}]*[A-Da-dＡ-Ｄａ-ｄ][\s\p{Z}\p{C}]*[.):．）：]"


def fold(text: Column) -> Column:
    """Letter case, white space, invisible characters and punctuation dropped."""
    return F.regexp_replace(F.lower(F.upper(text)), _DROP, "")


def canonical(text: Column) -> Column:
    """Canonical form: folded stem lines, then the sorted folded option lines after an unused separator."""
    lines = F.split(text, _LINE)
    stem = F.filter(lines, lambda x: ~x.rlike(_OPTION))
    options = F.filter(lines, lambda x: x.rlike(_OPTION))
    folded = F.array_sort(F.transform(options, lambda x: fold(F.regexp_replace(x, _OPTION, ""))))
    plain = fold(text)
    with_options = F.concat(fold(F.array_join(stem, "\n")), F.lit("\u0001"), F.array_join(folded, "\u0001"))
    return F.when(F.size(options) > 0, with_options).otherwise(plain)


def _prefix(level: int) -> Column:
    """The group and the first ``level`` characters of the canonical form."""
    return F.concat(F.col("grp"), F.lit("\u0002"), F.substring("canon", 1, level))


def buckets(rows: DataFrame, bucket_rows: int) -> DataFrame:
    """Adds ``bucket`` (a prefix, with its group), ``salt`` and ``salted`` to rows with ``grp`` and ``canon``.

    One partial aggregate counts the prefixes of the deepest level. The coarser levels are summed from those
    counts. What reaches the rows is the list of oversized prefixes, at most levels x rows / bucket_rows entries, which
    is broadcast only if it is short.
    """
    counted = rows.groupBy("grp", F.substring("canon", 1, LEVELS[-1]).alias("canon")).count()
    over = None
    for level in LEVELS:
        big = counted.groupBy(_prefix(level).alias("prefix")).agg(F.sum("count").alias("n")).where(F.col("n") > bucket_rows).select(F.lit(level).alias("level"), "prefix", "n")
        over = big if over is None else over.unionByName(big)
    over = common.written(over, "oversized")
    few = over.count() <= SENT
    out = rows.withColumn("bucket", _prefix(LEVELS[0])).withColumn("salt", F.lit(0)).withColumn("open", F.lit(True))
    for k, level in enumerate(LEVELS):
        big = over.where(F.col("level") == level).select(F.col("prefix").alias("bucket"), F.col("n"))
        out = out.join(F.broadcast(big) if few else big, "bucket", "left")
        split = F.col("open") & F.col("n").isNotNull()
        if k + 1 < len(LEVELS):
            out = out.withColumn("open", split).withColumn("bucket", F.when(split, _prefix(LEVELS[k + 1])).otherwise(F.col("bucket")))
        else:
            salts = F.ceil(F.col("n") / F.lit(bucket_rows)).cast("int")
            out = out.withColumn("salted", split).withColumn("salt", F.when(split, F.pmod(F.xxhash64("row_id"), salts).cast("int")).otherwise(F.lit(0)))
        out = out.drop("n")
    return out.drop("open")


STRIDE = 24


def _trie_runs(canons: list[str], ids: list[int]) -> tuple[list[int], list[int], list[int]]:
    """One trie over a bucket: for each row its terminal, and for each terminal its count and smallest id.

    Inner nodes are keyed by up to STRIDE characters; a terminal is stored under the empty key of its node.
    """
    root: dict = {}
    terminal_of, counts, smallest = [], [], []
    for canon, row in zip(canons, ids):
        node = root
        for at in range(0, len(canon), STRIDE):
            node = node.setdefault(canon[at : at + STRIDE], {})
        t = node.get("")
        if t is None:
            t = node[""] = len(counts)
            counts.append(0)
            smallest.append(row)
        counts[t] += 1
        if row < smallest[t]:
            smallest[t] = row
        terminal_of.append(t)
    return terminal_of, counts, smallest


def _read_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tries over rows that arrive sorted by bucket; a bucket's trie is dropped when the next one begins.

    In salted buckets a terminal's first row brings its group and canonical form along, to be merged over the salts.
    """
    held: list[tuple[list, list, list, list]] = []
    at = None

    def flush() -> pa.RecordBatch:
        ids, canons, salted, groups = ([x for part in held for x in part[k]] for k in range(4))
        term, counts, small = _trie_runs(canons, ids)
        told = [(g, c) if s and small[t] == i else (None, None) for g, c, s, t, i in zip(groups, canons, salted, term, ids)]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(ids, pa.int64()), pa.array([small[t] for t in term], pa.int64()), pa.array([counts[t] for t in term], pa.int64()),
                pa.array([g for g, _ in told], pa.string()), pa.array([c for _, c in told], pa.string()),
            ],
            names=["row_id", "first_id", "copies", "grp", "canon"],
        )

    for batch in batches:
        keys = batch.column(0).to_pylist()
        columns = [batch.column(k).to_pylist() for k in range(1, 5)]
        start = 0
        for k in range(len(keys) + 1):
            if k == len(keys) or (k and keys[k] != keys[k - 1]) or (k == 0 and at is not None and keys[0] != at):
                if k > start:
                    held.append(tuple(c[start:k] for c in columns))
                if k < len(keys) and held:
                    yield flush()
                    held = []
                start = k
        if keys:
            at = keys[-1]
    if held:
        yield flush()


def format_copies(df: DataFrame, group: str, id_col: str, text_col: str, bucket_rows: int = 20_000) -> DataFrame:
    """(row_id, first_id, copies) for every non-blank text: the smallest id among its copies and their number.

    ``group`` names a column within whose values copies are sought (a table name, a source).
    """
    rows = df.where(common.not_blank(F.col(text_col))).select(F.col(id_col).alias("row_id"), F.col(group).alias("grp"), canonical(F.col(text_col)).alias("canon"))
    rows = common.written(rows.withColumn("grp", F.coalesce("grp", F.lit(""))), "canonical")
    placed = buckets(rows, bucket_rows).withColumn("place", F.concat("bucket", F.lit("\u0003"), F.col("salt").cast("string")))
    sorted_rows = placed.select("place", "row_id", "canon", "salted", "grp").repartition("place").sortWithinPartitions("place")
    tries = common.written(sorted_rows.mapInArrow(_read_buckets, "row_id long, first_id long, copies long, grp string, canon string"), "terminals")
    # The terminals of salted buckets: merge equal canonical forms over their salts.
    terminals = tries.where("canon IS NOT NULL").select("grp", "canon", "first_id", "copies")
    if terminals.isEmpty():
        return tries.select("row_id", "first_id", "copies")
    merged = terminals.groupBy("grp", "canon").agg(F.min("first_id").alias("least"), F.sum("copies").alias("total"))
    fixed = terminals.join(merged, ["grp", "canon"]).select("first_id", "least", "total")
    return tries.join(fixed, "first_id", "left").select("row_id", F.coalesce("least", "first_id").alias("first_id"), F.coalesce("total", "copies").alias("copies"))


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = (("train_sanity", "question"), ("amc_ttt", "prompt"))
    return common.union_all(common.table(spark, sf_dir, t).select(F.lit(t).alias("grp"), "row_id", F.col(c).alias("text")) for t, c in parts)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = format_copies(_texts(spark, sf_dir), "grp", "row_id", "text")
    return found.where("row_id <> first_id").select(F.col("first_id").alias("row_a"), F.col("row_id").alias("row_b"))


def p4_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record for each set of copies with its number of copies."""
    found = format_copies(_texts(spark, sf_dir), "grp", "row_id", "text")
    return found.where("row_id = first_id").select("row_id", "copies")
