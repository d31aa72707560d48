import random

from hypothesis import given, settings
from hypothesis import strategies as st

from rolloutlake.llm import radix

SCHEMA = "grp string, row_id long, text string, canon string"


def found(spark, rows, **options):
    df = spark.createDataFrame([(g, i, t, "x") for g, i, t in rows], SCHEMA)
    out = radix.format_copies(df, "grp", "row_id", "text", **options).collect()
    return {r.row_id: (r.first_id, r.copies) for r in out}


def test_case_space_punctuation_and_options(spark):
    rows = [
        ("a", 5, "What is it?\nA. The red\nB. The blue"),
        ("a", 3, "what  is\tit\n(A) the BLUE\n(B) The red!"),
        ("a", 9, "“WHAT​ is it”…\nC: The red\nD) the—blue"),
        ("a", 4, "What is it?\nA. The red\nB. The blue+"),
        ("b", 1, "What is it?\nA. The red\nB. The blue"),
        ("a", 7, None),
        ("a", 8, " ​ "),
        ("a", 10, "?!"),
        ("a", 11, "..."),
    ]
    got = found(spark, rows)
    assert got[5] == got[3] == got[9] == (3, 3)
    assert got[4] == (4, 1) and got[1] == (1, 1)
    assert 7 not in got and 8 not in got
    assert got[10] == got[11] == (10, 2)
    assert found(spark, []) == {}


def test_hot_text_is_salted_and_merged(spark):
    rng = random.Random(2)
    rows = [("a", i, rng.choice(["Same Text!", "same  text", "SAME TEXT."]) if i % 3 else f"other {i % 50}") for i in range(600)]
    rows += [("a", 1000 + i, "p" * 300 + str(i % 40)) for i in range(120)]
    got = found(spark, rows, bucket_rows=20)
    assert got == found(spark, rows, bucket_rows=100_000)
    same = [i for i in range(600) if i % 3]
    assert all(got[i] == (1, len(same)) for i in same)
    assert got[1000] == (1000, 3)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab", max_size=60), max_size=60))
def test_trie_equals_dictionary(texts):
    term, counts, small = radix._trie_runs(texts, list(range(len(texts))))
    for k, t in enumerate(texts):
        assert counts[term[k]] == texts.count(t) and small[term[k]] == texts.index(t)
