"""Problem 5: groups of small rewrites, by circulant MinHash, parts of hot groups taken apart further, and exact similarity.

Sets whose numbers stand in no more than HOT sets are compared pair by pair. For the others two permutations give all
coordinates: a word is placed by sigma, and coordinate k of a set is the smallest value of pi, shifted circularly by k, over
the places of its words. Every set is signed with all its words, frequent ones included. A set is sent, with its words, to one group for each of
its first coordinates; two sets within the similarity agree in one with a chance of 0.7 or more. Groups too large for one task, counted before
the shuffle, take one more coordinate each time, and more bands for it (ROUTES). Where a group is large, as
the one of a word of a template is, it is taken apart by further orders of its words until its parts are small
(neartree), so sets of one template that differ otherwise are not compared, however many there are.

Words are sent as numbers of two bytes; those beyond the most frequent ones as hashes. Groups that no coordinate makes
smaller are laid out on cells of salts, so that every pair of them still meets in one. Pairs are verified by their words where they meet, and
groups of records are the connected components.

Null, blank and wordless texts link only as equal texts (wordless ones) or not at all. Copies join through their
class; repeated rows are copies. Whole texts are used; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolloutlake.llm import common, components, neartree, wordsets

#: Bands in which a set is sent to a group that takes so many coordinates: 1, 2, and so on.
ROUTES = (6, 12, 18, 27, 39, 56)
COORDINATES = ROUTES[-1] * len(ROUTES)
#: Sets whose signatures are worked out side by side.
PIECE = 128
PLACES = 1 << 20
#: Largest group that is compared pair by pair; rows from which a group takes one more coordinate, or salts.
HOT = 2000
SALT_ROWS = 150_000
#: Words that have a number of their own.
NUMBERED = (1 << 16) - 1
#: Rows from which whole groups are compared together.
TOGETHER = 20_000
#: Classes remembered by a task, so that it sends copies once; the memory is emptied when full, which changes no result.
_REMEMBERED = 100_000

_TABLES: dict[int, np.ndarray] = {}


def _pi(seed: int = 11) -> np.ndarray:
    """The circular permutation, with its head repeated behind its tail."""
    if seed not in _TABLES:
        p = np.random.RandomState(seed).permutation(PLACES).astype(np.uint32)
        _TABLES[seed] = np.concatenate([p, p[:COORDINATES]])
    return _TABLES[seed]


def signatures(places: np.ndarray, offsets: np.ndarray, count: int = COORDINATES) -> np.ndarray:
    """The first coordinates of sets: ``places`` are sigma's places of all words, ``offsets`` the start of each (non-empty) set.

    All sets of a piece take in their next word at once, largest sets first, so that the running minimum stays in the
    processor's cache.
    """
    stretches = np.lib.stride_tricks.sliding_window_view(_pi(), count)
    sizes = np.diff(np.append(offsets, len(places)))
    order = np.argsort(-sizes, kind="stable")
    out = np.empty((len(offsets), count), np.uint32)
    for at in range(0, len(order), PIECE):
        rows = order[at : at + PIECE]
        first, n = offsets[rows], sizes[rows]
        least = stretches[places[first]]
        active = len(rows)
        for k in range(1, int(n[0])):
            while n[active - 1] <= k:
                active -= 1
            np.minimum(least[:active], stretches[places[first[:active] + k]], out=least[:active])
        out[rows] = least
    return out


def _flat(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Values of lists one after the other, and where each list begins and ends."""
    offsets = np.asarray(lists.offsets).astype(np.int64)
    return np.asarray(lists.values)[offsets[0] : offsets[-1]], offsets - offsets[0]


def frequent_words(classes: DataFrame) -> np.ndarray:
    """Hashes of the words that stand in most sets, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, counts = np.unique(_flat(batch.column(0))[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(words), pa.array(counts.astype(np.int64))], names=["w", "n"])

    counts = classes.select("words").mapInArrow(run, "w long, n long").groupBy("w").agg(F.sum("n").alias("n"))
    return np.sort(np.array([r.w for r in counts.orderBy(F.desc("n"), "w").limit(NUMBERED).collect()], np.int64))


def _routes(numbers: np.ndarray, words: np.ndarray, offsets: np.ndarray, heavy: np.ndarray, least: int) -> Iterator[tuple[tuple[np.ndarray, ...], np.ndarray, int]]:
    """((set, band, key), whether the group takes one more coordinate, how many it took before) of sets, one length after the other.

    It takes one more if it is ``heavy`` or, if ``least`` is not zero, has so many of the sets at hand.
    """
    wide = len(heavy) > 0 or least > 0
    count = ROUTES[-1] if wide else ROUTES[0]
    sig = signatures(words & (PLACES - 1), offsets[:-1], count * (len(ROUTES) if wide else 1)).astype(np.uint64)
    rows, band = (x.ravel() for x in np.meshgrid(np.arange(len(numbers)), np.arange(count), indexing="ij"))
    key = neartree.mix(numbers.view(np.uint64))[rows]
    for length in range(len(ROUTES) if wide else 1):
        key = neartree.mix(key ^ neartree.mix(sig[rows, length * count + band] * np.uint64(count) + band.astype(np.uint64) + np.uint64(1)))
        told = key.view(np.int64)
        if least:
            _, which, times = np.unique(told, return_inverse=True, return_counts=True)
            on = (times >= least)[which]
        else:
            on = np.isin(told, heavy)
        yield (rows, band, told), on, length
        rows, band, key = rows[on], band[on], key[on]
        if not len(rows):
            return


def _binary(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Binary values that hold numbers of two bytes, up to the given end each."""
    offsets = np.append(0, 2 * ends).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(values.astype(np.uint16))])


_ROW = "key long, cid long, known binary, others array<long>"


def sent_rows(classes: DataFrame, crowded: np.ndarray, known: np.ndarray, heavy: dict[int, int]) -> DataFrame:
    """(key, cid, known, others) for every set (cid, nh, words) and group: the numbers of its frequent words and the hashes of the others.

    Sets whose numbers are not ``crowded`` have one group. Groups that are ``heavy`` have cells of so many salts.
    """
    many, salts = np.array(sorted(heavy), np.int64), np.array([heavy[k] for k in sorted(heavy)], np.int64)

    def cells(keys, cid):
        """Keys, and the row of each, with every row (of class ``cid``) of a heavy group in the cells of its salt."""
        times = salts[np.searchsorted(many, keys)]
        own = neartree.mix(cid.view(np.uint64)) % times.astype(np.uint64)
        at = np.repeat(np.arange(len(keys)), times)
        other = (np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)).astype(np.uint64)
        low, high = np.minimum(own[at], other), np.maximum(own[at], other)
        return neartree.mix(keys[at].view(np.uint64) ^ neartree.mix((low << np.uint64(32)) + high + np.uint64(1))).view(np.int64), at

    def groups(numbers, words, offsets, cid):
        """(keys, rows) of crowded sets."""
        for (rows, band, key), on, length in _routes(numbers, words, offsets, many, 0):
            some = ~on & (band < ROUTES[length])
            yield key[some], rows[some]
            if length == len(ROUTES) - 1 and on.any():
                keys, at = cells(key[on], cid[rows[on]])
                yield keys, rows[on][at]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            cid = np.asarray(batch.column(0))
            fresh = np.zeros(len(cid), bool)
            fresh[np.unique(cid, return_index=True)[1]] = True
            if len(seen) > _REMEMBERED:
                seen.clear()
            fresh &= np.fromiter((c not in seen for c in cid.tolist()), bool, len(cid))
            seen.update(cid[fresh].tolist())
            batch = batch.filter(pa.array(fresh))
            if not batch.num_rows:
                continue
            cid, numbers = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            flat, offsets = _flat(batch.column(2))
            spot = np.minimum(np.searchsorted(known, flat), len(known) - 1)
            inside = known[spot] == flat
            before = np.append(0, np.cumsum(inside))[offsets]
            codes = _binary(spot[inside], before[1:])
            others = pa.ListArray.from_arrays(pa.array((offsets - before).astype(np.int32)), pa.array(flat[~inside]))
            hot = np.isin(numbers, crowded)
            lone = np.flatnonzero(~hot)
            sent = [(neartree.mix(numbers[lone].view(np.uint64)).view(np.int64), lone)]
            rows = np.flatnonzero(hot)
            if len(rows):
                n = np.diff(offsets)[rows]
                ends = np.append(0, np.cumsum(n))
                words = flat[np.arange(ends[-1]) + np.repeat(offsets[rows] - ends[:-1], n)]
                sent += [(key, rows[at]) for key, at in groups(numbers[rows], words, ends, cid[rows])]
            for key, at in sent:
                take = pa.array(at)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(cid[at]), codes.take(take), others.take(take)], names=["key", "cid", "known", "others"])

    return classes.select("cid", "nh", "words").mapInArrow(run, _ROW)


def heavy_groups(classes: DataFrame, crowded: np.ndarray, total: int) -> dict[int, int]:
    """Salts of the groups that more than SALT_ROWS of ``total`` sets are sent to, of all lengths; counted before anything is shuffled."""
    share = SALT_ROWS / (4 * total)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(np.isin(np.asarray(batch.column(0)), crowded)))
            if batch.num_rows:
                flat, offsets = _flat(batch.column(1))
                none = np.zeros(0, np.int64)
                for (_, _, key), on, _ in _routes(np.asarray(batch.column(0)), flat, offsets, none, max(2, int(share * batch.num_rows))):
                    keys, counts = np.unique(key[on], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts.astype(np.int64))], names=["key", "n"])

    counts = classes.select("nh", "words").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    # At most COORDINATES times the sets, divided by SALT_ROWS, can be that many.
    return {r.key: r.n // SALT_ROWS + 1 for r in counts.where(F.col("n") > SALT_ROWS).collect()}


def _group_reader(known: int):
    """Reads rows sorted by key into the pairs within the similarity, smaller class first, of the rows of each key."""
    small = HOT

    def pairs(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        key, cid, codes, others = (pa.chunked_array([p.column(k) for p in parts]).combine_chunks() for k in range(4))
        key, cid = np.asarray(key), np.asarray(cid)
        offsets = np.frombuffer(codes.buffers()[1], np.int32)[codes.offset : codes.offset + len(codes) + 1].astype(np.int64) // 2
        data = codes.buffers()[2]
        numbered = np.frombuffer(data, np.uint16)[offsets[0] : offsets[-1]] if data is not None and len(data) else np.zeros(0, np.uint16)
        rare, ends = _flat(others)
        names, rare = np.unique(rare, return_inverse=True)
        a, b = np.diff(offsets), np.diff(ends)
        n = a + b
        flat = np.empty(int(n.sum()), np.int32)
        first = np.cumsum(n) - n
        flat[np.arange(len(numbered)) + np.repeat(first - (np.cumsum(a) - a), a)] = numbered
        flat[np.arange(len(rare)) + np.repeat(first + a - (np.cumsum(b) - b), b)] = rare + known
        i, j = neartree.near_pairs(key, neartree.Sets(flat, n, known + len(names)), small, cid)
        x, y = np.minimum(cid[i], cid[j]), np.maximum(cid[i], cid[j])
        return pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, last = [], 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.asarray(batch.column(0))
            change = np.flatnonzero(np.append(last is not None and key[0] != last, key[1:] != key[:-1]))
            if len(change) and rows + change[-1] >= TOGETHER:
                at = int(change[-1])
                yield pairs(held + [batch.slice(0, at)])
                held, rows, batch = [], 0, batch.slice(at)
            held.append(batch)
            rows += batch.num_rows
            last = key[-1]
        if held:
            yield pairs(held)

    return run


def linked(keyed: DataFrame, heads: DataFrame) -> DataFrame:
    """(vertex, root) of every class with a link: the smallest class it is linked with, also through others.

    ``keyed`` has the rows (k1, nh, words) of all classes, ``heads`` each class once (k1, nh, cid).
    """
    sets = keyed.where(F.size("words") > 0).select(F.col("k1").alias("cid"), "nh", "words")
    # At most one in HOT of all classes.
    many = heads.groupBy("nh").count().where(F.col("count") > HOT).collect()
    crowded, total = np.array([r.nh for r in many], np.int64), sum(r["count"] for r in many)
    known = frequent_words(sets)
    if not len(known):
        return heads.where("false").select(F.col("cid").alias("vertex"), F.col("cid").alias("root"))
    heavy = heavy_groups(sets, crowded, total) if total > SALT_ROWS else {}
    rows = sent_rows(sets, crowded, known, heavy).repartition("key").sortWithinPartitions("key")
    found = common.written(rows.mapInArrow(_group_reader(len(known)), "a long, b long"), "near").distinct()
    for side in ("a", "b"):
        found = found.join(heads.select(F.col("k1").alias(side), F.col("cid").alias(f"cid_{side}")), side)
    return components.min_label(found.select(F.col("cid_a").alias("a"), F.col("cid_b").alias("b")))


def similar_groups(rows: DataFrame, id_col: str = "row_id", text_col: str = "text") -> DataFrame:
    """(row_id, first_id) of every non-blank record: the smallest id of its group."""
    keyed = wordsets.word_rows(rows.select(F.col(id_col).alias("row_id"), F.col(text_col).alias("text")), "text")
    keyed = common.written(keyed, "wordrows")
    heads = keyed.groupBy("k1", "k2").agg(F.min("row_id").alias("cid"))
    members = keyed.select("row_id", "nh", "k1", "k2").join(heads, ["k1", "k2"]).select("row_id", "cid", "k1", "nh")
    members = common.written(members, "members")
    roots = linked(keyed, members.where("row_id = cid").select("k1", "nh", "cid"))
    return members.select("row_id", "cid").join(roots.withColumnsRenamed({"vertex": "cid"}), "cid", "left").select("row_id", F.coalesce("root", "cid").alias("first_id"))


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = (("train_sanity", "question"), ("sanity", "prompt"))
    return common.union_all(common.table(spark, sf_dir, t).select("row_id", F.col(c).alias("text")) for t, c in parts)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = similar_groups(_texts(spark, sf_dir))
    return found.where("row_id <> first_id").select(F.col("first_id").alias("row_a"), F.col("row_id").alias("row_b"))


def p5_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many groups there are of each size."""
    sizes = similar_groups(_texts(spark, sf_dir)).groupBy("first_id").agg(F.count("*").alias("members"))
    return sizes.groupBy("members").agg(F.count("*").alias("groups"))
