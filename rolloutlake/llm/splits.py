"""Problem 2: train, validation and test labels that keep every video in one split.

The spellings of a row's fields and the bare video names that they can be read as are the vertices of a graph. A
spelling is linked to its reading, or where it cannot be read to the best reading of its row; the readings of one row
are linked to each other. The links are contracted by random mate (see components), and a component's reading is the
video of all its rows, so that a row without any readable field gets it from rows that spell a field alike. The
components, with the number of their rows as weight, are cut into splits by cumulative weight.

An unreadable spelling that stands beside several names (a common file name) is no evidence and links nothing. Where
names of one component differ, its rows keep their own best reading but stay one group. Null and blank spellings give
nothing. A row that no link gives a name is its own group and gets ``video`` null.
Repeated rows count as rows. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rolloutlake.llm import common, components

PROPORTIONS = (("train", 0.8), ("validation", 0.1), ("test", 0.1))

#: Components above this share of all rows are placed one by one; there are at most 1 / LARGE of them.
LARGE = 0.002

_ID = "[A-Za-z0-9_-]{11}"
_TAIL = r"(?:_video)?(?:_\d{3,4}p)?(?:\.[A-Za-z0-9]{2,4})?"


def _last_match(path: Column, pattern: str) -> Column:
    """The capture of the last path component that matches wholly; null if none does."""
    pieces = F.split(F.trim(path), r"[/\\]+")
    hits = F.filter(F.transform(pieces, lambda p: F.regexp_extract(p, f"^{pattern}$", 1)), lambda x: x != "")
    return F.when(F.size(hits) > 0, F.element_at(hits, -1))


def video_of_id(video_id: Column) -> Column:
    """Bare name of a ``video_id``: eleven characters, perhaps after ``v=`` or before an extension."""
    found = F.regexp_extract(video_id, rf"^\s*(?:.*[?&])?(?:v=)?({_ID}){_TAIL}\s*$", 1)
    return F.when(found != "", found)


def video_of_path(path: Column) -> Column:
    return _last_match(path, f"({_ID}){_TAIL}")


def video_of_record(record_id: Column) -> Column:
    """Bare name at the front of a record id: name, question type, number."""
    found = F.regexp_extract(record_id, rf"^\s*({_ID})-[A-Za-z]+-\d+\s*$", 1)
    return F.when(found != "", found)


def clip_of_path(path: Column) -> Column:
    """Clip number of five digits or more, leading zeros kept, of a clip's path."""
    return _last_match(path, r"(\d{5,})(?:_\d{3,4}p)?(?:\s*\(\d+\))?(?:\.[A-Za-z0-9]{2,4})?")


def clip_of_record(record_id: Column) -> Column:
    found = F.regexp_extract(record_id, r"^\s*(\d{5,})_\d+\s*$", 1)
    return F.when(found != "", found)


def _readings(table: str, **fields: tuple[Column, Column]) -> Column:
    """Spellings of a row's fields that are not blank, as vertices, each with its reading (or null), best field first."""
    vertex = lambda field, spelling: F.when(F.trim(spelling) != "", F.concat(F.lit(f"{table}/{field}:"), F.trim(spelling)))
    told = [F.struct(vertex(field, spelling).alias("spelling"), name.alias("name")) for field, (spelling, name) in fields.items()]
    return F.filter(F.array(*told), lambda x: x["spelling"].isNotNull()).alias("readings")


def named_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row_id, source_table, readings): the spellings of a row's fields and the video names they are read as."""
    c = F.col
    train = common.table(spark, sf_dir, "train_sanity").select(
        "row_id", F.lit("train_sanity").alias("source_table"),
        _readings("train_sanity", video_id=(c("video_id"), video_of_id(c("video_id"))), video_file=(c("video_file"), video_of_path(c("video_file"))), id=(c("id"), video_of_record(c("id"))), audio_file=(c("audio_file"), video_of_path(F.regexp_replace("audio_file", "_audio(?=\\.)", "")))),
    )
    clips = common.table(spark, sf_dir, "sanity").select(
        "row_id", F.lit("sanity").alias("source_table"),
        _readings("sanity", video_file=(c("video_file"), clip_of_path(c("video_file"))), audio_file=(c("audio_file"), clip_of_path(c("audio_file"))), id=(c("id"), clip_of_record(c("id")))),
    )
    return train.unionByName(clips)


def links(named: DataFrame) -> DataFrame:
    """(a, b): spellings with their readings, readings of one row with each other; each link once."""
    vertex = lambda name: F.concat(F.col("source_table"), F.lit("//"), name)
    names = F.filter(F.transform("readings", lambda x: x["name"]), lambda x: x.isNotNull())
    # Rows that spell all their fields alike are one.
    tuples = named.select("source_table", "readings").distinct().withColumn("best", F.try_element_at(names, F.lit(1))).withColumn("names", F.array_distinct(names))
    tuples = common.written(tuples, "spellings")
    each = tuples.select("source_table", "best", F.explode("readings").alias("r")).select("source_table", "best", "r.spelling", "r.name")
    read = each.where("name IS NOT NULL").select(F.col("spelling").alias("a"), vertex(F.col("name")).alias("b"))
    unread = each.where("name IS NULL AND best IS NOT NULL").groupBy("spelling").agg(F.min(vertex(F.col("best"))).alias("b"), F.max(vertex(F.col("best"))).alias("other"))
    beside = unread.where("b = other").select(F.col("spelling").alias("a"), "b")
    nameless = tuples.where("best IS NULL AND size(readings) > 1").select(F.get("readings", 0)["spelling"].alias("a"), F.explode(F.slice("readings", 2, 8)).alias("r")).select("a", F.col("r.spelling").alias("b"))
    conflicts = tuples.where("size(names) > 1").select(vertex(F.col("best")).alias("a"), F.explode(F.slice("names", 2, 8)).alias("n"), "source_table").select("a", vertex(F.col("n")).alias("b"))
    common_names = unread.where("b <> other").select("spelling")
    for side in ("a", "b"):
        nameless = nameless.join(common_names.withColumnRenamed("spelling", side), side, "left_anti").select("a", "b")
    return common.union_all((read, beside, nameless, conflicts)).distinct()


def grouped_rows(named: DataFrame) -> DataFrame:
    """(row_id, source_table, video, grp): rows with the video of their component and its root.

    Rows are summed up by their spellings before anything is linked, so a video with a third of all rows is a few
    vertices with a weight.
    """
    is_name = lambda vertex: vertex.rlike("^[^/]+//")
    roots = components.random_mate(links(named))
    name = F.when(is_name(F.col("vertex")), F.regexp_replace("vertex", "^[^/]+//", ""))
    labels = roots.withColumn("name", name).where("name IS NOT NULL").groupBy("root").agg(F.min("name").alias("label"), F.max("name").alias("other"))
    named_roots = roots.join(labels, "root", "left").select("vertex", "root", F.when(F.col("label") == F.col("other"), F.col("label")).alias("label"))
    best = F.try_element_at(F.filter("readings", lambda x: x["name"].isNotNull()), F.lit(1))
    start = F.coalesce(best["spelling"], F.try_element_at("readings", F.lit(1))["spelling"])
    rows = named.select("row_id", "source_table", best["name"].alias("own"), start.alias("vertex"))
    alone = F.concat(F.lit("row:"), F.col("row_id").cast("string"))
    return rows.join(named_roots, "vertex", "left").select("row_id", "source_table", F.coalesce("label", "own").alias("video"), F.coalesce("root", alone).alias("grp"))


def cut_by_weight(weights: DataFrame, proportions=PROPORTIONS) -> DataFrame:
    """(grp, split) from (grp, weight), with the shares of the weights as near to ``proportions`` as groups allow.

    Components above LARGE of the total are placed first, largest first, where most is wanting; their number is
    bounded by 1 / LARGE, so they are handled on the driver. All others follow in hash order along the cumulative
    weight: hash ranges are summed first (at most 1,024 sums), then each range is cumulated on its own.
    """
    spark = weights.sparkSession
    total = weights.agg(F.coalesce(F.sum("weight"), F.lit(0))).first()[0]
    if not total:
        return weights.select("grp", F.lit(None).cast("string").alias("split"))
    wanted = {name: share * total for name, share in proportions}
    large = weights.where(F.col("weight") > LARGE * total).orderBy(F.col("weight").desc(), "grp").collect()
    placed = []
    for row in large:
        best = max(wanted, key=lambda s: (wanted[s] - (0 if s == proportions[0][0] else row.weight * 0.5), s))
        wanted[best] -= row.weight
        placed.append((row.grp, best))
    kind = weights.schema["grp"].dataType.simpleString()
    fixed = spark.createDataFrame(placed, f"grp {kind}, split string")
    small = weights.where(F.col("weight") <= LARGE * total).withColumn("h", F.xxhash64("grp")).withColumn("range", F.shiftright("h", 54))
    sums = small.groupBy("range").agg(F.sum("weight").alias("w"))
    before = sums.withColumn("before", F.sum("w").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1))).select("range", F.coalesce("before", F.lit(0)).alias("before"))
    along = Window.partitionBy("range").orderBy("h", "grp").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    middle = F.col("before") + F.sum("weight").over(along) - F.col("weight") / 2
    left = {s: max(0.0, wanted[s]) for s, _ in proportions}
    room, rest = sum(left.values()) or 1.0, total - sum(r.weight for r in large)
    at, label = 0.0, None
    for name, _ in proportions[:-1]:
        at += left[name] / room * rest
        label = F.when(middle <= at, name) if label is None else label.when(middle <= at, name)
    others = small.join(before, "range").select("grp", label.otherwise(proportions[-1][0]).alias("split"))
    return others.unionByName(fixed)


def assign_splits(rows: DataFrame) -> DataFrame:
    """(row_id, source_table, video, split) for the rows of grouped_rows, cut per table."""
    parts = []
    for name in ("train_sanity", "sanity"):
        own = rows.where(F.col("source_table") == name)
        labels = cut_by_weight(own.groupBy("grp").agg(F.count("*").alias("weight")))
        parts.append(own.join(labels, "grp").select("row_id", "source_table", "video", "split"))
    return common.union_all(parts)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bare video of every row."""
    return grouped_rows(named_rows(spark, sf_dir)).select("row_id", "video")


def p2_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_splits(common.written(grouped_rows(named_rows(spark, sf_dir)), "grouped"))


def p2_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and videos per table and split, and the videos that stand in two splits (none)."""
    rows = common.written(p2_splits(spark, sf_dir), "splits")
    shares = rows.groupBy("source_table", "split").agg(F.count("*").alias("n_rows"), F.count_distinct("video").alias("videos"))
    torn = rows.groupBy("source_table", "video").agg(F.count_distinct("split").alias("k")).groupBy("source_table").agg(F.sum(((F.col("k") > 1) & F.col("video").isNotNull()).cast("long")).alias("torn_videos"))
    return shares.join(torn, "source_table")
