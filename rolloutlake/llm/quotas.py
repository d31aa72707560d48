"""Problem 6: a sample that meets target proportions per category.

Category spellings are equal if they differ only in letter case, white space, hyphens, underscores or ``&`` for
``and``. Each category's acceptance probability is wanted / observed with a margin; rows are accepted
independently by a hash of their id; then counts are cut exactly to what is wanted by the order of that hash. The
cut is found in a histogram of the hash, so that only the rows of one bin per category are ranked, however many rows
the category has. Categories with fewer rows than wanted are taken whole and reported.

Null and blank categories belong to no target and are never drawn. Ties of the hash are broken by the row id.
Repeated rows count as rows. Empty tables leave every target unmet whose wanted number is above zero.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rolloutlake.llm import common

#: Bits of the acceptance hash.
BITS = 52
BINS = 4096


def category_key(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), "&", "and"), r"[\s\p{Z}_-]+", "")


def unit_hash(*parts: Column) -> Column:
    """A number in [0, 2^52) from the md5 of the parts; alike on any engine with md5."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[p.cast("string") for p in parts])), 1, 13), 16, 10).cast("long")


def observed(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """Targets with ``have`` and ``wanted``; rows are (field_name, category, row_id), targets a small table."""
    keyed = rows.select("field_name", category_key(F.col("category")).alias("key"))
    have = keyed.groupBy("field_name", "key").agg(F.count("*").alias("n"))
    totals = have.groupBy("field_name").agg(F.sum("n").alias("total"))
    t = targets.withColumn("key", category_key(F.col("category")))
    joined = t.join(have, ["field_name", "key"], "left").join(totals, "field_name", "left")
    share = F.expr("CAST((coalesce(total, 0) * target_pct + 999) DIV 1000 AS BIGINT)")
    return joined.select("field_name", "category", "key", F.coalesce("n", F.lit(0)).alias("have"), F.greatest(F.col("min_rows").cast("long"), share).alias("wanted"))


def draw(rows: DataFrame, targets: DataFrame, seed: int = 17) -> DataFrame:
    """(field_name, category, row_id) of the sample."""
    return drawn(rows, common.written(observed(rows, targets), "plan"), seed)


def drawn(rows: DataFrame, plan: DataFrame, seed: int = 17, margin: float = 4.0) -> DataFrame:
    """The sample of a plan (see observed); ``margin`` is in standard deviations of the accepted number."""
    told = plan
    plan = plan.where("have > 0").withColumn("take", F.least("have", "wanted"))
    whole = 1 << BITS
    ratio = (F.col("take") + F.lit(margin) * F.sqrt(F.col("take").cast("double")) + 1) / F.col("have")
    plan = plan.withColumn("limit", F.when(F.col("have") <= F.col("wanted"), F.lit(whole)).otherwise(F.least(F.lit(whole), F.ceil(ratio * F.lit(float(whole))).cast("long"))))
    plan = common.written(plan, "quotas")
    hashed = rows.select("field_name", category_key(F.col("category")).alias("key"), "row_id", unit_hash(F.lit(seed), F.col("row_id")).alias("u"))
    joined = hashed.join(plan, ["field_name", "key"])
    accepted = joined.where("u < limit").select("field_name", "category", "row_id", "u", "take", "limit")
    bin_ = F.least(F.floor(F.col("u") / F.col("limit") * BINS), F.lit(BINS - 1)).cast("int")
    accepted = accepted.withColumn("bin", bin_)
    counts = common.written(accepted.groupBy("field_name", "category", "take", "bin").agg(F.count("*").alias("k")), "bins")
    short = counts.groupBy("field_name", "category", "take").agg(F.sum("k").alias("k")).where("k < take")
    if not short.isEmpty():
        # The margin was not enough for some category (or none of its rows was accepted): draw with a wider one.
        return drawn(rows, told, seed, margin * 4)
    along = Window.partitionBy("field_name", "category").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = counts.withColumn("before", F.coalesce(F.sum("k").over(along), F.lit(0))).where("before < take")
    kept = accepted.drop("take").join(bins, ["field_name", "category", "bin"])
    sure = kept.where("before + k <= take").select("field_name", "category", "row_id")
    edge = kept.where("before + k > take")
    rank = F.row_number().over(Window.partitionBy("field_name", "category").orderBy("u", "row_id"))
    return sure.unionByName(edge.withColumn("r", rank).where("r <= take - before").select("field_name", "category", "row_id"))


def deficits(rows: DataFrame, targets: DataFrame, seed: int = 17) -> DataFrame:
    """(field_name, category, have, wanted) of the targets that the corrected sample does not meet."""
    plan = common.written(observed(rows, targets), "plan")
    got = drawn(rows, plan, seed).groupBy("field_name", "category").agg(F.count("*").alias("got"))
    met = plan.join(got, ["field_name", "category"], "left").select("field_name", "category", F.coalesce("got", F.lit(0)).alias("have"), "wanted")
    return met.where("have < wanted")


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = (("train_sanity", ("content_parent_category", "question_type")), ("sanity", ("question_type",)))
    parts = []
    for name, columns in fields:
        t = common.table(spark, sf_dir, name)
        pairs = F.array(*[F.struct(F.lit(f"{name}.{c}").alias("field_name"), F.col(c).alias("category")) for c in columns])
        parts.append(t.select("row_id", F.explode(pairs).alias("p")).select("p.field_name", "p.category", "row_id"))
    return common.union_all(parts)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deficits(_rows(spark, sf_dir), common.table(spark, sf_dir, "sample_targets")).select("field_name", "category")


def p6_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return draw(_rows(spark, sf_dir), common.table(spark, sf_dir, "sample_targets"))


_SQL_KEY = "regexp_replace(replace(lower({0}), '&', 'and'), '[\\s_-]+', '', 'g')"
_SQL_ROWS = """rows_ AS (
  SELECT 'train_sanity.content_parent_category' AS field_name, content_parent_category AS category, row_id FROM train_sanity
  UNION ALL SELECT 'train_sanity.question_type', question_type, row_id FROM train_sanity
  UNION ALL SELECT 'sanity.question_type', question_type, row_id FROM sanity),
have_ AS (SELECT field_name, {key_c} AS key, count(*) AS n FROM rows_ GROUP BY 1, 2),
total_ AS (SELECT field_name, count(*) AS total FROM rows_ GROUP BY 1),
plan AS (
  SELECT t.field_name, t.category, {key_t} AS key, coalesce(h.n, 0) AS have,
         greatest(t.min_rows, CAST((x.total * t.target_pct + 999) // 1000 AS BIGINT)) AS wanted
  FROM sample_targets t JOIN total_ x USING (field_name) LEFT JOIN have_ h ON h.field_name = t.field_name AND h.key = {key_t})""".format(
    key_c=_SQL_KEY.format("category"), key_t=_SQL_KEY.format("t.category")
)

ORACLE = {
    "p6_found": f"WITH {_SQL_ROWS} SELECT field_name, category FROM plan WHERE have < wanted",
    "p6_sample": f"""WITH {_SQL_ROWS},
        ranked AS (SELECT p.field_name, p.category, r.row_id, p.wanted,
            row_number() OVER (PARTITION BY p.field_name, p.category ORDER BY CAST('0x' || substr(md5('17:' || r.row_id), 1, 13) AS BIGINT), r.row_id) AS k
            FROM rows_ r JOIN plan p ON p.field_name = r.field_name AND p.key = {_SQL_KEY.format('r.category')})
        SELECT field_name, category, row_id FROM ranked WHERE k <= wanted""",
}
