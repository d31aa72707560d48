"""Problem 7: a sample that is the same in every run and keeps its records as data grows.

Consistent weighted Poisson sampling. A unit (an id with all its rows) is selected when the hash of the id, read as a
number in [0, 1), is below weight x constant. The weight of a unit is the running maximum over the deliveries seen so
far of its rows in one delivery; a store of these maxima is carried from delivery to delivery, so the inclusion
probability never falls and a selected unit stays selected.

A null or blank id makes each of its rows a unit of its own (by row id). Blanks around an id do not count. Repeated
rows count towards the weight. No order, partitioning or number of rows changes the result. Empty tables give none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rolloutlake.llm import common
from rolloutlake.llm.quotas import BITS, unit_hash

#: Share of units of weight one that is selected.
RATE = 0.1


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = (("train_sanity", "id"), ("math_l1_ttt", "unique_id"))
    rows = common.union_all(common.table(spark, sf_dir, t).select(F.lit(t).alias("source_table"), "row_id", F.trim(F.col(c)).alias("own"), "batch") for t, c in parts)
    unit = F.when(F.coalesce(F.col("own"), F.lit("")) == "", F.concat(F.lit("row:"), F.col("row_id").cast("string"))).otherwise(F.col("own"))
    return rows.select("source_table", "row_id", "batch", unit.alias("unit"))


def delivered(rows: DataFrame) -> DataFrame:
    """Store of one set of deliveries: (source_table, unit, weight); partial counts are summed before the shuffle."""
    per_batch = rows.groupBy("source_table", "unit", "batch").agg(F.count("*").alias("k"))
    return per_batch.groupBy("source_table", "unit").agg(F.max("k").alias("weight"))


def carried(store: DataFrame, rows: DataFrame) -> DataFrame:
    """The store after further deliveries: the larger weight of each unit."""
    return store.unionByName(delivered(rows)).groupBy("source_table", "unit").agg(F.max("weight").alias("weight"))


def selected(store: DataFrame, rate: float = RATE, seed: int = 7) -> DataFrame:
    """Units whose hash is below weight x rate."""
    limit = F.least(F.lit(1.0), F.col("weight") * F.lit(rate)) * F.lit(float(1 << BITS))
    return store.where(unit_hash(F.lit(seed), F.col("source_table"), F.col("unit")).cast("double") < limit)


def p7_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = units(spark, sf_dir)
    chosen = selected(delivered(rows))
    return rows.join(chosen, ["source_table", "unit"]).select("source_table", "row_id", "weight")


def p7_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each delivery: units that it newly selects, and units selected before it that are lost by it (none)."""
    per_batch = units(spark, sf_dir).groupBy("source_table", "unit", "batch").agg(F.count("*").alias("k"))
    seen = Window.partitionBy("source_table", "unit").orderBy("batch")
    running = per_batch.withColumn("weight", F.max("k").over(seen.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    limit = F.least(F.lit(1.0), F.col("weight") * F.lit(RATE)) * F.lit(float(1 << BITS))
    running = running.withColumn("now", unit_hash(F.lit(7), F.col("source_table"), F.col("unit")).cast("double") < limit)
    running = running.withColumn("before", F.coalesce(F.lag("now").over(seen), F.lit(False)))
    return running.groupBy("source_table", "batch").agg(
        F.count_if(F.col("now") & ~F.col("before")).alias("newly"), F.count_if(F.col("before") & ~F.col("now")).alias("lost")
    )


ORACLE = {
    "p7_sample": """WITH rows_ AS (
          SELECT 'train_sanity' AS source_table, row_id, batch, CASE WHEN coalesce(trim(id), '') = '' THEN 'row:' || row_id ELSE trim(id) END AS unit FROM train_sanity
          UNION ALL SELECT 'math_l1_ttt', row_id, batch, CASE WHEN coalesce(trim(unique_id), '') = '' THEN 'row:' || row_id ELSE trim(unique_id) END FROM math_l1_ttt),
        store AS (SELECT source_table, unit, max(k) AS weight FROM (SELECT source_table, unit, batch, count(*) AS k FROM rows_ GROUP BY ALL) GROUP BY ALL)
        SELECT source_table, row_id, weight FROM rows_ JOIN store USING (source_table, unit)
        WHERE CAST(CAST('0x' || substr(md5('7:' || source_table || ':' || unit), 1, 13) AS BIGINT) AS DOUBLE) < least(1.0, weight * 0.1) * 4503599627370496""",
}
