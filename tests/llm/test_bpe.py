import random

import pytest
from tokenizers import Tokenizer

from rolloutlake.llm import bpe

PLACE = bpe.TOKENIZER_DIR


@pytest.fixture(scope="module")
def public():
    t = Tokenizer.from_file(f"{PLACE}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return t


def test_ids_equal_the_public_tokenizer(public):
    rng = random.Random(5)
    texts = ["", " ", "a" * 33, "<|endoftext|>", "don't we'll  \n\n x", "​﻿\x00", "漢字かな🎉 é"]
    texts += ["".join(rng.choice("aabhe \n'stl0é漢🎉.,") for _ in range(rng.randrange(1, 300))) for _ in range(300)]
    encoder = bpe.Encoder(bpe.MergeAutomaton(bpe.load_ranks(f"{PLACE}/byte_bpe_50k.tiktoken")))
    want = [e.ids for e in public.encode_batch(texts, add_special_tokens=False)]
    assert [encoder.encode(t) for t in texts] == want


def merged(word, ranks):
    """Brute force: the first pair of least rank is merged until none is left."""
    line = [bytes([b]) for b in word]
    while True:
        options = [(ranks[line[k] + line[k + 1]], k) for k in range(len(line) - 1) if line[k] + line[k + 1] in ranks]
        if not options:
            return tuple(ranks[t] for t in line)
        _, k = min(options)
        line[k : k + 2] = [line[k] + line[k + 1]]


def test_gadgets_equal_brute_force_merges_on_random_vocabularies(monkeypatch):
    monkeypatch.setattr(bpe, "ROW_ENTRIES", 40)
    for seed in range(60):
        rng = random.Random(seed)
        letters = b"abc"[: rng.choice([1, 2, 3])]
        ranks = {bytes([b]): k for k, b in enumerate(letters)}
        while len(ranks) < 30:
            joined = rng.choice(list(ranks)) + rng.choice(list(ranks))
            if joined not in ranks and len(merged(joined, ranks)) == 2:
                ranks[joined] = len(ranks)
            elif len(letters) == 1 and len(joined) > 40:
                break
        automaton = bpe.MergeAutomaton(ranks)
        for _ in range(60):
            word = bytes(rng.choice(letters) for _ in range(rng.randrange(1, 25)))
            assert automaton.path(word) == merged(word, ranks), (seed, word)


def test_null_empty_long_repeated_and_extra_columns(spark):
    long = "word " * 40_000 + "x" * 100_000
    df = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (3, long, "c"), (3, long, "c")], "doc_id long, text string, ids string")
    out = bpe.encode_corpus(df)
    rows = out.collect()
    assert len(rows) == 4 and sorted(len(r.ids) for r in rows)[:2] == [0, 0]
    back = {r.text for r in bpe.decode_corpus(out).collect()}
    assert back == {"", long}
    assert bpe.encode_corpus(df.limit(0)).collect() == []
