"""Distinct word sets of records, shared by the similarity operators of problems 3 and 5.

A word is kept as its 64-bit hash. Records whose numbers and whose word set are equal form a class; similarity is
worked out between classes and spread to their records afterwards, so copies never meet each other pair by pair.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: A word is a longest run of letters or digits; texts of plain ASCII take the cheaper of the two patterns.
_ASCII_WORD = re.compile(r"[a-z0-9]+").findall
_WORD = regex.compile(r"[\p{L}\p{Nd}]+").findall
_NUMBER = re.compile(r"[0-9]+").findall
_VISIBLE = regex.compile(r"[^\p{Z}\p{C}\s]").search

#: Words remembered per batch; the memory is emptied when full, which changes no result.
_REMEMBERED = 200_000


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= _REMEMBERED:
            self.clear()
        self[word] = code = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass")) - (1 << 63)
        return code


def words_of(text: str) -> list[str]:
    """Lower-case words of a text in order."""
    low = text.lower()
    return _ASCII_WORD(low) if low.isascii() else _WORD(low)


def word_rows(rows: DataFrame, text_col: str) -> DataFrame:
    """Other columns of ``rows`` with ``nh`` (hash of the numbers), ``words`` (sorted distinct word hashes) and the class key (k1, k2).

    Null and blank texts are dropped. A text without any word is a class with its equals (the key is then made of the
    text itself).
    """
    others = [f for f in rows.schema.fields if f.name != text_col]
    added = [T.StructField("nh", T.LongType()), T.StructField("words", T.ArrayType(T.LongType())), T.StructField("k1", T.LongType()), T.StructField("k2", T.LongType())]
    names = [f.name for f in (*others, *added)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = _Hashes().__getitem__
        digest, number = xxhash.xxh3_128_digest, xxhash.xxh64_intdigest
        for batch in batches:
            keep, numbers, keys, flat, offsets = [], [], [], [], [0]
            for k, text in enumerate(batch.column(len(others)).to_pylist()):
                words = words_of(text) if text else ()
                if not words and not (text and _VISIBLE(text)):
                    continue
                told = " ".join(sorted(_NUMBER(text))).encode()
                own = sorted(set(map(code, words)))
                flat += own
                keep.append(k)
                offsets.append(len(flat))
                numbers.append(number(told) - (1 << 63))
                keys.append(digest(told + b"\x02" + (array("q", own).tobytes() if own else b"\x01" + text.strip(" ").encode("utf-8", "surrogatepass"))))
            kept = batch.take(pa.array(keep, pa.int64()))
            both = np.frombuffer(b"".join(keys), np.int64).reshape(-1, 2)
            lists = pa.ListArray.from_arrays(pa.array(np.array(offsets, np.int32)), pa.array(np.array(flat, np.int64)))
            yield pa.RecordBatch.from_arrays([*kept.columns[: len(others)], pa.array(np.array(numbers, np.int64)), lists, pa.array(both[:, 0]), pa.array(both[:, 1])], names=names)

    return rows.select(*[f.name for f in others], text_col).mapInArrow(run, T.StructType([*others, *added]))
