"""Reading, shared-folder tables and text keys used by the training-data operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL_DIRS: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of the input folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, from ``spark.checkpoint.dir``.

    A folder of our own is made only where the setting is absent and the master is local.
    """
    told = spark.conf.get("spark.checkpoint.dir", None)
    if told:
        return told
    master = spark.sparkContext.master
    if not master.startswith("local[") and master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_DIRS:
        _LOCAL_DIRS[app] = tempfile.mkdtemp(prefix="rolloutlake-")
        atexit.register(shutil.rmtree, _LOCAL_DIRS[app], ignore_errors=True)
    return "file://" + _LOCAL_DIRS[app]


def written(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` as parquet in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: A word is a longest run of letters or digits; everything else separates words.
NOT_WORD = r"[^\p{L}\p{Nd}]+"


def words(text: Column) -> Column:
    """Lower-case words of a text in order; an empty array for null or wordless texts."""
    parts = F.split(F.lower(F.coalesce(text, F.lit(""))), NOT_WORD)
    return F.filter(parts, lambda w: w != "")


def numbers_key(text: Column) -> Column:
    """The runs of digits 0-9 of a text, with repeats, order ignored, as one string."""
    return F.array_join(F.array_sort(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("[0-9]+"), F.lit(0))), " ")


def not_blank(text: Column) -> Column:
    """True for texts with a character that is neither white space nor invisible."""
    return F.coalesce(F.regexp_replace(text, r"[\p{Z}\p{C}\s]+", "") != "", F.lit(False))


def union_all(parts: Iterable[DataFrame]) -> DataFrame:
    first, *rest = list(parts)
    for df in rest:
        first = first.unionByName(df)
    return first
