"""Scans: JSON, JSON lines and Parquet with schema adapters; listings; malformed JSON."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_any(spark: SparkSession, paths: list[str], schema: T.StructType | None = None) -> DataFrame:
    """Each file by its ending (.json as one JSON text, .jsonl as lines, else Parquet), united by column name."""
    def one(path: str) -> DataFrame:
        reader = spark.read.schema(schema) if schema is not None else spark.read
        if path.endswith(".jsonl"):
            return reader.json(path)
        return reader.json(path, multiLine=True) if path.endswith(".json") else reader.parquet(path)

    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), map(one, paths))


def unwrap(value: Column, *keys: str) -> Column:
    """A value inside nested structs or maps, by keys."""
    for k in keys:
        value = value.getField(k)
    return value


def first_of(df: DataFrame, *candidates: str) -> Column:
    """The first of the candidate columns that the table has."""
    for c in candidates:
        if c in df.columns:
            return F.col(c)
    raise ValueError(f"none of {', '.join(candidates)} is a column")


def questions(df: DataFrame, language: str | None = None, limit: int | None = None) -> DataFrame:
    """Prompts of a language, blank ones dropped; ``limit`` is the caller's wish for fewer rows."""
    out = df.where(F.length(F.trim("prompt")) > 0)
    if language is not None:
        out = out.where(F.lower("language") == language.lower())
    return out.limit(limit) if limit is not None else out


def broken_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Files of ``[...][...]`` arrays: the first object of every fragment that parses."""
    whole = spark.read.text(path, wholetext=True)
    fragments = whole.select(F.explode(F.split("value", r"\]\s*\[")).alias("f"))
    text = F.concat(F.lit("["), F.regexp_replace("f", r"^\s*\[|\]\s*$", ""), F.lit("]"))
    parsed = F.from_json(text, f"array<struct<{schema}>>", {"mode": "PERMISSIVE"})
    first = fragments.select(F.try_element_at(parsed, F.lit(1)).alias("r")).where("r IS NOT NULL").select("r.*")
    return first.dropna(how="all")


def folder_listing(spark: SparkSession, path: str) -> DataFrame:
    """(folder, qa_file, audio_file, video_file) of a folder tree; no file is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")
    folder = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    pick = lambda ending: F.max(F.when(F.col("path").endswith(ending), F.col("path")))
    return files.groupBy(folder.alias("folder")).agg(pick(".json").alias("qa_file"), pick(".wav").alias("audio_file"), pick(".mp4").alias("video_file"))


def listing_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Paths that were added or removed between two listings."""
    return after.exceptAll(before).withColumn("change", F.lit("added")).unionByName(before.exceptAll(after).withColumn("change", F.lit("removed")))


def lookup(corpus: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Corpus rows by key, never by position."""
    return ids.join(corpus, key)


def planted_counts(spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
    """Synthetic words with a planted letter count: (word, letter, prompt, response)."""
    rows = spark.range(n).select("id", F.substring(F.sha2(F.concat_ws(":", F.lit(seed), "id"), 256), 1, 24).alias("word"))
    letter = F.substring("word", 1, 1)
    made = rows.select("id", "word", letter.alias("letter"), F.regexp_count("word", letter).alias("n"))
    return made.withColumn("prompt", F.concat(F.lit("How many "), "letter", F.lit(" are there in "), "word", F.lit("?"))).withColumn("response", F.concat(F.lit("\\boxed{"), F.col("n").cast("string"), F.lit("}")))
