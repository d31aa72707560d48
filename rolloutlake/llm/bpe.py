"""Problem 8: the whole corpus as ids of a public byte-level BPE vocabulary.

The merges are compiled into a deterministic automaton over token labels, one merge gadget after the other in the order
of their ranks. All arcs of one label lead to one state, so a state is named by the label read last. The gadget of a
merge ``u v`` does three things to the automaton so far: the state after ``u`` loses its arc ``v`` (from then on ``v``,
and every label that is made of ``v`` later, cannot follow ``u``), every state with an arc ``u`` gains an arc ``uv``, and
that arc leads to a copy of the state after ``v`` as it is at that moment. What the automaton built so far makes of a
token's bytes tells the two labels that its merge joins.

The arcs of a state are thus all labels but those it lost, and the losses are the table: one sparse row a state, with
the rank at which each label was lost, put together from the gadgets when the state is first reached. A byte string has
exactly one accepted path, its BPE encoding, which is found by one left-to-right run over the table, and decoded by
emitting the labels of the arcs.

Nulls and empty texts give an empty list. Texts of any length are encoded whole, in time linear in their length.
Repeated rows are encoded alike and all kept.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Default place of the public vocabulary files; every entry point takes another path as parameter.
TOKENIZER_DIR = "/opt/tokenizers"

#: Fixed value: the pre-split pattern published with this vocabulary.
PRE_SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Words remembered per Python worker, and entries of the rows that are kept; both are emptied when full, which
#: changes no result.
REMEMBERED = 400_000
ROW_ENTRIES = 2_000_000


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to id, from a rank file (base64 token, blank, rank on each line)."""
    ranks: dict[bytes, int] = {}
    with open(path, "rb") as lines:
        for line in lines:
            if line.strip():
                token, rank = line.split()
                ranks[base64.b64decode(token)] = int(rank)
    return ranks


class MergeAutomaton:
    """Deterministic automaton of a BPE vocabulary whose ids are merge ranks."""

    def __init__(self, ranks: dict[bytes, int]):
        self.tokens = {i: t for t, i in ranks.items()}
        self.labels: dict[bytes, int] = {}
        self.prefixes: set[bytes] = set()
        #: The gadgets: for a label its two parts, and for the state after a label the labels it lost, with the rank.
        self.parts: dict[int, tuple[int, int]] = {}
        self.lost: dict[int, dict[int, int]] = {}
        self._rows: dict[int, dict[int, int]] = {}
        self._entries = 0
        for rank in sorted(self.tokens):
            token = self.tokens[rank]
            if len(token) > 1:
                made = self.path(token)
                if len(made) != 2:
                    continue  # no merge makes this token
                self._add_gadget(*made, rank)
            self.labels[token] = rank
            self.prefixes.update(token[:k] for k in range(1, len(token) + 1))

    def _add_gadget(self, u: int, v: int, rank: int) -> None:
        self.parts[rank] = (u, v)
        self.lost.setdefault(u, {})[v] = rank
        if u in self._rows:
            self._rows[u].setdefault(v, rank)

    def row(self, state: int) -> dict[int, int]:
        """Labels that the state after label ``state`` lost, each with the rank of the gadget that took it first."""
        kept = self._rows.get(state)
        if kept is None:
            kept, at, until = {}, state, None
            while True:
                for label, rank in self.lost.get(at, {}).items():
                    # The state is a copy of the state after its last part, made when its own gadget was added.
                    if until is None or rank < until:
                        kept[label] = min(rank, kept.get(label, rank))
                if at not in self.parts:
                    break
                until = at
                at = self.parts[at][1]
            if self._entries > ROW_ENTRIES:
                self._rows.clear()
                self._entries = 0
            self._rows[state] = kept
            self._entries += len(kept) + 1
        return kept

    def arc(self, state: int, label: int) -> bool:
        """Whether the state after label ``state`` has an arc ``label``."""
        row = self.row(state)
        rank = row.get(label)
        if rank is not None:
            return False
        # A label came with the arc of its first part, if the state still had that when its gadget was added.
        while label in self.parts:
            made, label = label, self.parts[label][0]
            rank = row.get(label)
            if rank is not None and rank <= made:
                return False
        return True

    def path(self, word: bytes) -> tuple[int, ...]:
        """Labels of the one accepted path of a byte string."""
        n = len(word)
        last = [-1] * (n + 1)
        labels, prefixes, arc = self.labels, self.prefixes, self.arc
        for i in range(n):
            state = last[i]
            if i and state < 0:
                continue
            for j in range(i + 1, n + 1):
                piece = word[i:j]
                if piece not in prefixes:
                    break
                if last[j] < 0:
                    label = labels.get(piece)
                    if label is not None and (i == 0 or arc(state, label)):
                        last[j] = label
        out = []
        at = n
        while at > 0:
            out.append(last[at])
            at -= len(self.tokens[last[at]])
        return tuple(reversed(out))

    def decode(self, ids) -> bytes:
        return b"".join(self.tokens[i] for i in ids)


class _Words(dict):
    """Word to ids, filled by runs of the automaton."""

    def __init__(self, automaton: MergeAutomaton):
        super().__init__()
        self.automaton = automaton

    def __missing__(self, word: str) -> tuple[int, ...]:
        ids = self.automaton.path(word.encode("utf-8", "surrogatepass"))
        if len(word) <= 64:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = ids
        return ids


class Encoder:
    """Pre-split plus automaton."""

    def __init__(self, automaton: MergeAutomaton):
        self.words = _Words(automaton)
        self.split = regex.compile(PRE_SPLIT).findall
        self.get = self.words.__getitem__

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        return list(chain.from_iterable(map(self.get, self.split(text))))


_ENCODERS: dict[int, Encoder] = {}


def encode_corpus(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = f"{TOKENIZER_DIR}/byte_bpe_50k.tiktoken") -> DataFrame:
    """(id, ids) for every row of ``df``; no shuffle, one pass over the text column.

    The vocabulary (under 1 MB) is read and compiled once on the driver; its gadgets (a few MB) are sent to the executors.
    """
    automaton = df.sparkSession.sparkContext.broadcast(MergeAutomaton(load_ranks(vocabulary)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = id(automaton.value)
        if key not in _ENCODERS:
            _ENCODERS.clear()
            _ENCODERS[key] = Encoder(automaton.value)
        encode = _ENCODERS[key].encode
        for batch in batches:
            lists = [encode(t) for t in batch.column(1).to_pylist()]
            offsets = np.zeros(len(lists) + 1, np.int32)
            np.cumsum([len(x) for x in lists], out=offsets[1:])
            flat = np.fromiter(chain.from_iterable(lists), np.int32, int(offsets[-1]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=[id_col, "ids"])

    schema = T.StructType([df.schema[id_col], T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return df.select(id_col, text_col).mapInArrow(run, schema)


def decode_corpus(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", vocabulary: str = f"{TOKENIZER_DIR}/byte_bpe_50k.tiktoken") -> DataFrame:
    """(id, text) back from ids; null lists give null, empty lists the empty text."""
    ranks = df.sparkSession.sparkContext.broadcast(load_ranks(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = {i: t for t, i in ranks.value.items()}
        for batch in batches:
            texts = [None if x is None else b"".join(map(tokens.__getitem__, x)).decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[id_col, "text"])

    return df.select(id_col, ids_col).mapInArrow(run, T.StructType([df.schema[id_col], T.StructField("text", T.StringType())]))


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_corpus(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def p8_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens and exactness of decoding per language, over all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", F.coalesce(F.lower("lang"), F.lit("und")).alias("lang"))
    ids = encode_corpus(docs)
    back = decode_corpus(ids).withColumnRenamed("text", "decoded")
    joined = docs.join(back, "doc_id")
    return joined.groupBy("lang").agg(F.count("*").alias("docs"), F.sum((F.coalesce("text", F.lit("")) == F.col("decoded")).cast("long")).alias("exact"))
