"""Problem 9: documents that hold a passage of a held-out item, by template canonicalisation.

Words are canonicalised to typed placeholders: digits to NUMBER, units of measure to UNIT, names to NAME (a word
that items write only with a capital inside a sentence, or any word items never use). Windows of twelve canonical
words are hashed and joined with the items' windows. The slot check then tells a literal passage (every slot filled
alike) from a re-parameterised one (slots filled otherwise, but consistently: one item value always stands for one
document value).

Null, empty and blank texts and texts below twelve words hold no passage. Whole texts are searched; a document is
reported once for an item however often it repeats the passage; extra columns are not read. The items are a small
table; they are sent to the executors in blocks of a checked size.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolloutlake.llm import common

WINDOW = 12

#: Units of measure and time of day that re-parameterised questions change.
UNITS = frozenset(
    "second seconds minute minutes hour hours day days week weeks month months year years metre metres meter meters "
    "kilometre kilometres kilometer kilometers centimetre centimetres mile miles step steps gram grams kilogram kilograms "
    "kg km cm mm litre litres liter liters degree degrees percent frame frames pound pounds dollar dollars euro euros".split()
)

_WORD = re.compile(r"[^\W_]+")
_SENTENCE = re.compile(r"[.!?:;\n\"“(]\s*$")

NUMBER, UNIT, NAME = 1, 2, 3
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


class Templates:
    """Word codes of the items: a literal code for each word and its canonical (template) code."""

    def __init__(self, items: list[tuple[int, str]]):
        lower_seen, inner_capital = set(), set()
        for _, text in items:
            for m in _WORD.finditer(text or ""):
                w = m.group()
                first = m.start() == 0 or _SENTENCE.search(text[max(0, m.start() - 4) : m.start()])
                if w[:1].isupper() and not first:
                    inner_capital.add(w.lower())
                elif not w[:1].isupper() or first:
                    lower_seen.add(w.lower())
        self.codes: dict[str, int] = {}
        kinds = [0, NUMBER, UNIT, NAME]
        for _, text in items:
            for w in _WORD.findall((text or "").lower()):
                if w not in self.codes:
                    self.codes[w] = len(kinds)
                    slot = NUMBER if w.isdigit() else UNIT if w in UNITS else NAME if w in inner_capital and w not in lower_seen else 0
                    kinds.append(slot or len(kinds))
        self.kinds = np.array(kinds, np.uint64)

    def literal(self, words: list[str]) -> np.ndarray:
        codes = _Codes(self.codes)
        return np.fromiter(map(codes.__getitem__, words), np.int64, len(words))


class _Codes(dict):
    def __missing__(self, word: str) -> int:
        return NUMBER if word.isdigit() else UNIT if word in UNITS else NAME


def window_hashes(kinds: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Polynomial hashes of all windows of canonical codes."""
    n = len(kinds) - window + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    spread = (kinds + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    spread ^= spread >> np.uint64(32)
    for k in range(window):
        h = h * _MULTIPLIER + spread[k : k + n]
    return h


def item_windows(items: list[tuple[int, str]], templates: Templates, window: int = WINDOW) -> list[tuple[int, int, str]]:
    """(template hash, item, words) of every window of every item."""
    out = []
    for item, text in items:
        ws = _WORD.findall((text or "").lower())
        hashes = window_hashes(templates.kinds[templates.literal(ws)], window)
        out += [(int(h.astype(np.int64)), item, " ".join(ws[k : k + window])) for k, h in enumerate(hashes)]
    return out


#: Characters of items that are sent to the executors at once (about 20 MB of windows); more items take more passes.
BLOCK_CHARS = 1_000_000


def passages(docs: DataFrame, items: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(id_col, item_col, doc_words, item_words): every pair of windows with equal templates.

    Items are split into blocks by a hash of their id, so that no more than about ``block_chars`` characters are
    collected and broadcast at once. Canonical words are those of a block.
    """
    total = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    blocks = total // block_chars + 1
    block = F.pmod(F.xxhash64(item_col), F.lit(blocks))
    return common.union_all([_passages(docs, items.where(block == k) if blocks > 1 else items, window, id_col, text_col, item_col) for k in range(blocks)])


def _passages(docs: DataFrame, items: DataFrame, window: int, id_col: str, text_col: str, item_col: str) -> DataFrame:
    spark = docs.sparkSession
    held = [(r[0], r[1]) for r in items.select(item_col, "text").collect()]
    templates = Templates(held)
    windows = item_windows(held, templates, window)
    known = np.unique(np.array([h for h, _, _ in windows], np.int64))
    sent = spark.sparkContext.broadcast((templates, known))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told, hashes = sent.value
        for batch in batches:
            ids, hs, ws = [], [], []
            texts = batch.column(1).to_pylist()
            if len(hashes):
                all_words: list[str] = []
                ends = []
                for t in texts:
                    if t:
                        all_words += _WORD.findall(t.lower())
                    all_words.append("\x00")
                    ends.append(len(all_words))
                kinds = told.kinds[told.literal(all_words)]
                kinds[np.array(ends) - 1] = 0
                h = window_hashes(kinds, window).astype(np.int64)
                at = np.searchsorted(hashes, h)
                hit = np.flatnonzero(hashes[np.minimum(at, len(hashes) - 1)] == h)
                of = np.searchsorted(np.array(ends), hit, side="right")
                doc_ids = batch.column(0).to_pylist()
                for k, d in zip(hit.tolist(), of.tolist()):
                    if k + window <= ends[d] - 1:
                        ids.append(doc_ids[d])
                        hs.append(int(h[k]))
                        ws.append(" ".join(all_words[k : k + window]))
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.column(0).type), pa.array(hs, pa.int64()), pa.array(ws, pa.string())], names=["doc", "h", "doc_words"])

    kind = docs.schema[id_col].dataType.simpleString()
    found = docs.select(id_col, text_col).mapInArrow(search, f"doc {kind}, h long, doc_words string")
    item_kind = items.schema[item_col].dataType.simpleString()
    side = spark.createDataFrame(windows, f"h long, item {item_kind}, item_words string")
    return found.join(F.broadcast(side), "h").select(F.col("doc").alias(id_col), F.col("item").alias(item_col), "doc_words", "item_words")


def literal_passages(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, item_id) where every slot of some window is filled alike."""
    return passages(docs, items, window).where("doc_words = item_words").select("doc_id", "item_id").distinct()


def reworked_passages(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, item_id, windows): windows whose slots differ, but map each item value to one document value."""
    both = passages(docs, items, window).where("doc_words <> item_words")
    pairs = F.array_distinct(F.arrays_zip(F.split("item_words", " ").alias("i"), F.split("doc_words", " ").alias("d")))
    consistent = F.size(pairs) == F.size(F.array_distinct(F.transform(pairs, lambda p: p["i"])))
    return both.where(consistent).groupBy("doc_id", "item_id").agg(F.count_distinct("item_words").alias("windows"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return literal_passages(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "eval_items"))


def p9_reworked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reworked_passages(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "eval_items"))


def p9_leaked_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items that leaked, with the number of documents that hold them."""
    found = p9_found(spark, sf_dir).groupBy("item_id").agg(F.count("*").alias("docs"))
    return common.table(spark, sf_dir, "eval_items").select("item_id", "source", "split").join(found, "item_id")
