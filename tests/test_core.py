import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rolloutlake.functions import math_answers as ma
from rolloutlake.functions import text as tx
from rolloutlake.functions import tokens as tk
from rolloutlake.operators import advantage, balance, builders, frame, losses, metrics, sampling, scoring, similarity, votes
from rolloutlake.sources import readers, sinks
from rolloutlake.streaming import state


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def rollouts(spark, scores, group=1):
    return spark.createDataFrame([(group, i, float(s)) for i, s in enumerate(scores)], "prompt_id long, rollout_idx long, score double")


def values(df, column="advantage", order="rollout_idx"):
    return [r[column] for r in df.orderBy(order).collect()]


def test_grpo_rloo_opo_passk(spark):
    assert values(advantage.grpo(rollouts(spark, [1, 0, 0, 1]))) == pytest.approx([0.866024, -0.866024, -0.866024, 0.866024], abs=1e-6)
    assert values(advantage.grpo(rollouts(spark, [0.7]))) == pytest.approx([0.7 / (1 + 1e-6)])
    assert values(advantage.rloo(rollouts(spark, [1, 0, 0]))) == pytest.approx([1, -0.5, -0.5])
    assert values(advantage.rloo(rollouts(spark, [0.4]))) == [0.4]
    opo = rollouts(spark, [1, 0]).withColumn("length", F.when(F.col("rollout_idx") == 0, 3).otherwise(1))
    assert values(advantage.opo(opo)) == pytest.approx([0.25, -0.75])
    assert values(advantage.grpo_passk(rollouts(spark, [3, 1, 2]), by_std=False)) == [1, 0, 0]
    with pytest.raises(Exception, match="two or more"):
        advantage.grpo_passk(rollouts(spark, [3])).collect()


def test_registry_rules():
    with pytest.raises(ValueError, match="unknown"):
        advantage.estimator("GRPO")
    with pytest.raises(ValueError, match="already"):
        advantage.register("grpo")(lambda df: df)
    loose = scoring.Registry("x", strict=False)
    loose.register("a")(len)
    loose.register("a")(max)
    assert loose.get("a") is max
    with pytest.raises(ValueError, match="known: a"):
        loose.get("b")


def test_votes(spark):
    rows = [(1, 0, "A"), (1, 1, "B"), (1, 2, "A"), (1, 3, None), (2, 0, None), (2, 1, " "), (3, 0, "B"), (3, 1, "A")]
    df = spark.createDataFrame(rows, "prompt_id long, rollout_idx long, answer string")
    got = {r.prompt_id: r for r in votes.majority_vote(df).collect()}
    assert (got[1].label, got[1].ratio, got[1].n_unique_answers, got[1].unanimous) == ("A", 0.5, 2, False)
    assert got[1].vote_entropy == pytest.approx(0.459148, abs=1e-6)
    assert (got[2].label, got[2].ratio, got[2].vote_entropy, got[2].n_unparseable) == (votes.NO_LABEL, 0, 0, 2)
    assert got[3].label == "B"
    wins = spark.createDataFrame([(1, "A>>B", False), (1, "B>A", True)], "uid long, v string, f boolean")
    scores = votes.win_rates(wins, "uid", "v", "f")
    assert scores.first().score == 0.75 and votes.win_summary(scores).first().winrate == 87.5


def numbered(spark, n):
    return spark.createDataFrame([(i, chr(97 + i % 26)) for i in range(n)], "row_idx long, lab string")


def labels(df, order="row_idx"):
    return "".join(r.lab for r in df.orderBy(order).collect())


def test_frame_golden_cases(spark):
    abc = numbered(spark, 3)
    for divisor, want, pad in ((2, "abca", 1), (3, "abc", 0), (7, "abcabca", 4)):
        padded, k = frame.pad_to_divisor(abc, divisor)
        assert (labels(padded), k) == (want, pad) and labels(frame.unpad(padded, k)) == "abc"
    assert labels(frame.repeat_rows(abc, 2)) == "aabbcc" and labels(frame.repeat_rows(abc, 2, interleave=False)) == "abcabc"
    each = frame.repeat_each(abc, F.element_at(F.array(F.lit(3), F.lit(0), F.lit(2)), (F.col("row_idx") + 1).cast("int")))
    assert "".join(sorted(r.lab for r in each.collect())) == "aaacc"
    folded = frame.fold(frame.repeat_rows(abc, 2), ["lab"], 2)
    assert labels(frame.unfold(folded, ["lab"])) == "aabbcc"
    order = lambda *new: spark.createDataFrame(list(enumerate(new)), "row_idx long, new_idx long")
    assert labels(frame.reorder(abc, order(2, 0, 1))) == "bca"
    with pytest.raises(ValueError):
        frame.reorder(abc, order(0, 0, 1))
    with pytest.raises(ValueError):
        frame.chunk(abc, 2)
    with pytest.raises(Exception, match="differs"):
        frame.union_columns(abc, abc.withColumn("lab", F.lit("z"))).collect()


@pytest.mark.parametrize("cut", [(None, None, 1), (2, -2, 3), (-5, None, 1), (None, None, -1), (None, None, -4), (7, 2, 1), (0, 100, 2)])
def test_slices_are_pythons(spark, cut):
    df = numbered(spark, 11)
    rows = frame.slice_rows(df, *cut).collect()
    assert sorted(r.row_idx for r in rows) == sorted(range(11)[slice(*cut)])


def test_row_index_is_dense(spark):
    df = spark.createDataFrame([(x,) for x in (5, -7, 10**12, 0, 3, 10**9)], "k long")
    assert [r.row_idx for r in frame.with_row_index(df, "k").orderBy("k").collect()] == list(range(6))
    assert frame.with_row_index(df.limit(0), "k").collect() == []


def test_sampling(spark):
    df = spark.createDataFrame([(i, ["x", "y", None, " "][i % 4]) for i in range(400)], "id long, cat string")
    sample = sampling.stratified_sample(df, "cat", 7, "id").collect()
    assert sorted({r.stratum for r in sample}) == ["(Uncategorized)", "x", "y"] and len(sample) == 21
    split = {r.id: r.split for r in sampling.ratio_split(df, [("a", 0.25), ("b", 0.75)], "id").collect()}
    assert sum(v == "a" for v in split.values()) == 100
    assert split == {r.id: r.split for r in sampling.ratio_split(df.repartition(9), [("a", 0.25), ("b", 0.75)], "id").collect()}
    weighted = sampling.weighted_resample(df.withColumn("w", F.lit(1.0)), "w", 800, "id")
    assert weighted.agg(F.sum("draws")).first()[0] == 800
    flat = spark.createDataFrame([(1, 1.0), (1, 1.0), (2, 5.0), (3, 1.0), (3, 2.0)], "g long, s double")
    assert {r.g for r in sampling.varied_groups(flat, "g", "s").collect()} == {2, 3}


def test_text_golden_cases(spark):
    assert one(spark, tx.hash_answer(F.lit("#### 1,234 then #### -5"))) == "-5"
    assert one(spark, tx.qa_normal(F.lit("The  Cat, a hat!"))) == "cat hat"
    assert one(spark, tx.overlong_penalty(F.lit(90), 100, 20, 1.0)) == -0.5 and one(spark, tx.overlong_penalty(F.lit(80), 100, 20, 1.0)) == 0
    assert one(spark, tx.normal_final_answer(F.lit("x = $\\frac12$ dollars"))) == "\\frac{1}{2}"
    assert one(spark, tx.normal_final_answer(F.lit("1,234"))) == "1234"
    assert one(spark, tx.truncate_reply(F.lit("abcdef"), 4, "right")) == "(truncated)...cdef"
    assert one(spark, F.to_json(tx.option_texts(F.lit("Q?\nA. one\nB) two")))) == '{"A":"one","B":"two"}'
    assert one(spark, tx.question_stem(F.lit("Q?\nA. one\nB) two"))) == "Q?"


def test_token_golden_cases(spark):
    ids = F.array(*[F.lit(x) for x in (5, 6, 2, 7)])
    assert one(spark, tk.response_mask(ids, 2)) == [1, 1, 1, 0] and one(spark, tk.response_mask(ids, 9)) == [1, 1, 1, 1]
    mask = F.array(*[F.lit(x) for x in (0, 1, 1, 0)])
    assert one(spark, tk.position_ids(mask)) == [0, 0, 1, 1]
    assert one(spark, tk.pad_or_truncate(ids, 3)) == [6, 2, 7] and one(spark, tk.pad_or_truncate(ids, 6)) == [0, 0, 5, 6, 2, 7]
    assert one(spark, tk.inverse_permutation(F.array(F.lit(2), F.lit(0), F.lit(1)))) == [1, 2, 0]
    r = F.array(*[F.lit(float(x)) for x in (1, 0, 2)])
    assert one(spark, tk.discounted_returns(r, F.array(F.lit(1), F.lit(0), F.lit(1)), 0.5)) == [1.0, 1.0, 2.0]
    assert one(spark, tk.gae(r, F.array(F.lit(0.5), F.lit(0.5), F.lit(0.5)), 1.0, 1.0)) == [2.5, 1.5, 1.5]


def test_loss_modes(spark):
    df = spark.createDataFrame([(1, 2.0, 1), (1, 4.0, 1), (2, 6.0, 1), (2, 9.0, 0)], "s long, l double, m int")
    got = [losses.aggregate_loss(df, "s", "l", "m", mode, 4).first().loss for mode in ("token-mean", "seq-mean-token-sum", "seq-mean-token-mean", "seq-mean-token-sum-norm")]
    assert got == pytest.approx([4, 6, 4.5, 3], abs=1e-6)
    with pytest.raises(ValueError):
        losses.aggregate_loss(df, "s", "l", "m", "other")


def test_metrics(spark):
    (m, _), (b, _) = metrics.bootstrap(np.arange(1.0, 6), 3, (np.mean, np.max), 100)
    assert abs(m - 3) < 0.3 and 3.5 < b < 5
    with pytest.raises(ValueError):
        metrics.bootstrap(np.array([]), 1, (np.mean,))
    assert metrics.k_list(10) == [2, 4, 8, 10] and metrics.k_list(1) == []
    llama = lambda lengths: metrics.flops(spark.createDataFrame([(x,) for x in lengths], "n long"), "n", 4096, 32, 32, 32, 128, 11008, 32000).first().tflops
    assert llama([512, 1024, 2048]) == pytest.approx(153.555818250240) and llama([4096] * 3) == pytest.approx(575.955114393600)
    assert one(spark, metrics.throughput(F.lit(600), F.lit(2.0), 2)) == 150


def test_math_answers():
    assert ma.unboxed(ma.last_boxed("a \\boxed{1} b \\boxed{\\frac{1}{2}} c")) == "\\frac{1}{2}"
    assert ma.last_boxed("none") is None and ma.last_boxed("\\boxed{open") is None and ma.unboxed(ma.last_boxed("\\boxed 7$ x")) == "7"
    assert ma.normal_math("\\dfrac12\\text{ cm}") == ma.normal_math("1/2") == ma.normal_math("0.5") == "\\frac{1}{2}"
    assert ma.normal_math("x = \\sqrt3") == "\\sqrt{3}" and ma.math_equal_text(None, None) and not ma.math_equal_text(None, "1")
    assert ma.grade("(1, 2.0)", "(1,2)") and not ma.grade("(1,2)", "[1,2]") and not ma.grade("1/2", "2/4") and ma.grade("1,000", "1000")
    assert ma.math_score("so \\boxed{42}", "42") == 1.0
    assert ma.rouge_l("the cat sat", "the cat") == pytest.approx(0.8) and ma.rouge_l(None, "x") == 0
    assert ma.sentence_bleu("a b c d", "a b c d") == pytest.approx(1.0)
    assert ma.repetition("aaaa") == pytest.approx(0.6) and ma.repetition("abc") == 0
    assert ma.transcript_messages("hi <code>x</code><interpreter>1</interpreter> bye") == [("assistant", "hi"), ("assistant", "x"), ("tool", "1"), ("assistant", "bye")]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 500), min_size=4, max_size=40), st.integers(1, 4))
def test_packing_places_every_sequence_once(lengths, k):
    for method in (balance.differencing, balance.greedy):
        bins = method(lengths, k)
        assert sorted(i for b in bins for i in b) == list(range(len(lengths)))
    even = lengths[: len(lengths) - len(lengths) % k]
    assert {len(b) for b in balance.differencing(even, k, True)} == {len(even) // k}
    sums = [sum(lengths[i] for i in b) for b in balance.differencing(lengths, k)]
    assert max(sums) <= sum(lengths) / k + max(lengths)


def test_builders_and_scoring(spark):
    df = spark.createDataFrame([(1, "q", "c", "r")], "id long, prompt string, chosen string, rejected string")
    assert [r.response for r in builders.preference_sft(df, "prompt", "chosen", "rejected").collect()] == ["c", "r"]
    row = builders.add_extra(builders.canonical_rows(df, "s", F.col("prompt"), F.col("chosen"), "math", F.lit("train"), F.col("id"), system=F.lit("sys")), "tools", F.lit("t")).first()
    assert [m.role for m in row.prompt] == ["system", "user"] and row.extra_info.tools == "t" and row.reward_model.style == "rule"
    bad = spark.createDataFrame([("zzz", "a", "b")], "data_source string, solution string, ground_truth string")
    with pytest.raises(Exception, match="no scorer"):
        scoring.routed(bad, {"x": "boxed"}).collect()


def test_readers_and_sinks(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"q": 1}, {"q": 2}]')
    (tmp_path / "b.jsonl").write_text('{"q": 3, "r": "x"}\n')
    got = readers.read_any(spark, [str(tmp_path / "a.json"), str(tmp_path / "b.jsonl")])
    assert sorted((r.q, r.r) for r in got.collect() if r.r) == [(3, "x")] and got.count() == 3
    (tmp_path / "broken.json").write_text('[{"q": 1}, {"q": 9}][{"q": 2}] [oops]')
    assert sorted(r.q for r in readers.broken_json(spark, str(tmp_path / "broken.json"), "q int").collect()) == [1, 2]
    folder = tmp_path / "clips" / "one"
    folder.mkdir(parents=True)
    for name in ("qa.json", "x.wav"):
        (folder / name).write_text("{}")
    listed = readers.folder_listing(spark, str(tmp_path / "clips")).first()
    assert listed.qa_file.endswith("qa.json") and listed.audio_file.endswith("x.wav") and listed.video_file is None
    assert sinks.flatten_config({"a": {"b": 1, "c": {"d": 2}}, "e": 3}) == {"a/b": 1, "a/c/d": 2, "e": 3}
    sinks.report_csv(spark.createDataFrame([(1, 0.123456)], "k int, v double"), str(tmp_path / "csv"))
    assert spark.read.option("header", "true").csv(str(tmp_path / "csv")).first().v == "0.1235"


def test_state(spark):
    steps = spark.createDataFrame([(0, 0.1, 100), (1, 0.01, 100)], "step long, kl double, n long")
    got = [r.beta for r in state.adaptive_kl(steps, "step", "kl", "n", 1.0, 0.05, 1000.0).orderBy("step").collect()]
    assert got == pytest.approx([1.02, 1.02 * 0.98])
    assert state.novelty_bonus(np.array([[1.0, 0.0], [1.0, 0.0], [0.0, 1.0]]), []) == pytest.approx([0.1, 0.0, 0.1])


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([(1, i, [float(i % 2), 1.0 - i % 2], f"2025-01-01 00:{i:02d}:00") for i in range(6)], "k long, i long, v array<double>, t string")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    query = state.stream_novelty(stream, "k", "i", "v").writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start(str(tmp_path / "out"))
    query.awaitTermination()
    assert [round(r.bonus, 3) for r in spark.read.parquet(str(tmp_path / "out")).orderBy("i").collect()] == [0.1, 0.1, 0, 0, 0, 0]
    stats = state.stream_group_stats(stream, "t", "k", "i").writeStream.format("memory").queryName("stats").outputMode("complete").trigger(availableNow=True).start()
    stats.awaitTermination()
    assert spark.table("stats").first().n == 6


def test_similarity(spark):
    df = spark.createDataFrame([(1, 1, [1.0, 0.0]), (1, 2, [0.9, 0.1]), (1, 3, [0.0, 1.0]), (1, 4, [0.0, 0.0])], "g long, k long, v array<double>")
    assert similarity.medoid(df.where("k < 4"), "g", "k", "v").first().medoid == 2
    assert one(spark, similarity.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) == 0
    top = similarity.dense_top_k(df, df.where("k = 1").select(F.col("k").alias("q"), F.col("v").alias("qv")), 2, "k", "q", "v", "qv")
    assert [(r.k, r["rank"]) for r in top.orderBy("rank").collect()] == [(1, 1), (2, 2)]
    labels = {r.k: r.cluster for r in similarity.auto_kmeans(df.where("k < 4"), "g", "k", "v").collect()}
    assert labels[1] == labels[2] != labels[3]


def test_entry_point():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries()) and math.isfinite(len(entry.queries()))


def test_caption_clean_query_keeps_texts_with_odd_characters(spark, tmp_path):
    from rolloutlake.plans import registry

    texts = ["a fan", "a\u00a0fan\u200b hums", "bell\x07 rings\u2028twice", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.x for r in registry.QUERIES["text_caption_clean"](spark, str(tmp_path)).collect()}
    assert [got[k] is None for k in range(4)] == [False, False, False, True]
    assert "hums" in got[1] and "rings" in got[2] and "twice" in got[2]


def test_packing_golden_cases():
    from rolloutlake.operators import balance

    for lengths, k, want in (([5, 5, 4, 3, 3], 2, [9, 11]), ([8, 7, 6, 5, 4], 2, [14, 16]), ([1, 2, 3, 4], 4, [1, 2, 3, 4])):
        bins = balance.differencing(lengths, k)
        assert sorted(i for b in bins for i in b) == list(range(len(lengths)))
        assert sorted(sum(lengths[i] for i in b) for b in bins) == want
    equal = balance.differencing([9, 1, 8, 2, 7, 3], 3, equal_size=True)
    assert [len(b) for b in equal] == [2, 2, 2] and {sum([9, 1, 8, 2, 7, 3][i] for i in b) for b in equal} == {10}
    with pytest.raises(ValueError):
        balance.differencing([1, 2, 3], 2, equal_size=True)


def test_batches_are_checked(spark):
    from rolloutlake.operators import batches

    df = batches.from_columns(spark, {"a": [1, 2], "b": ["x", "y"]}, "a long, b string")
    assert batches.column_kinds(df) == {"row_idx": "tensor", "a": "tensor", "b": "object"}
    with pytest.raises(ValueError, match="length"):
        batches.from_columns(spark, {"a": [1, 2], "b": ["x"]}, "a long, b string")
    with pytest.raises(TypeError):
        batches.column_kinds(df.withColumn("c", F.current_date()))
    assert batches.union_meta({"a": 1}, {"a": 1, "b": 2}) == {"a": 1, "b": 2}
    with pytest.raises(ValueError, match="differ"):
        batches.union_meta({"a": 1}, {"a": 2})
    assert batches.inconsistencies(df.withColumn("v", F.array("a")), ["v"]).count() == 0
    assert {r.column for r in batches.inconsistencies(df.withColumn("v", F.when(F.col("a") == 1, F.array("a"))).where("a = 1 OR a = 2").withColumn("row_idx", F.lit(3)), ["v"]).collect()} == {"v", "row_idx"}


def test_guarded_scores_time_out_and_keep_order(spark, tmp_path):
    import time

    from rolloutlake.operators import guarded

    def slow(x):
        if x == 2:
            time.sleep(5)
        return x

    df = spark.createDataFrame([(i, float(i)) for i in range(4)], "k long, x double")
    got = {r.k: (r.score, r.error) for r in guarded.guarded_scores(df, "k", ["x"], slow, seconds=1.0).collect()}
    assert got == {0: (0.0, None), 1: (1.0, None), 2: (0.0, "timeout"), 3: (3.0, None)}
    (tmp_path / "mine.py").write_text("def score(a, extra=0):\n    return a + extra\n\ndef data(df, n):\n    return df.limit(n)\n\ndef wrong(df):\n    return 3\n")
    path = str(tmp_path / "mine.py")
    assert guarded.function_from_file(path, "score", extra=2)(1) == 3
    assert guarded.user_dataset(path, "data", df, n=2).count() == 2
    with pytest.raises(TypeError):
        guarded.user_dataset(path, "wrong", df)
    with pytest.raises(FileNotFoundError):
        guarded.function_from_file(path + "x", "score")
    with pytest.raises(AttributeError):
        guarded.function_from_file(path, "none")
    assert {"vanilla", "gspo", "clip_cov", "kl_cov", "sppo"} <= set(guarded.LOSSES.known)


def test_interactions_have_unique_names():
    from rolloutlake.operators import guarded, scoring

    kinds = scoring.Registry("interaction")
    kinds.register("echo")(lambda times=1: ("echo", times))
    assert guarded.load_interactions([{"kind": "echo", "config": {"times": 2}}, {"name": "b", "kind": "echo"}], kinds) == {"echo": ("echo", 2), "b": ("echo", 1)}
    with pytest.raises(ValueError):
        guarded.load_interactions([{"kind": "echo"}, {"kind": "echo"}], kinds)


def test_row_index_of_clustered_keys(spark, monkeypatch):
    monkeypatch.setattr(frame, "RANGE_ROWS", 0.001)
    keys = [*range(500), *(10**12 + 7 * k for k in range(300)), 5 * 10**14]
    df = spark.createDataFrame([(k,) for k in reversed(keys)] + [(None,)], "k long")
    got = {r.k: r.row_idx for r in frame.with_row_index(df, "k").collect()}
    assert got == {k: i for i, k in enumerate(sorted(keys))}
    assert frame.with_row_index(df.limit(0), "k").collect() == []


def test_scans_of_null_empty_and_uneven_arrays(spark):
    from rolloutlake.functions import tokens

    df = spark.createDataFrame([(1, [1.0, 2.0, 3.0]), (2, None), (3, []), (4, [5.0]), (5, [1.0] * 3000)], "k long, r array<double>").coalesce(1)
    got = {r.k: r.x for r in df.select("k", tokens.reverse_cumsum(F.col("r")).alias("x")).collect()}
    assert (got[1], got[2], got[3], got[4]) == ([6.0, 5.0, 3.0], None, [], [5.0]) and got[5][0] == 3000.0 and got[5][-1] == 1.0
    back = {r.k: r.x for r in df.where("k = 1").select("k", tokens.discounted_returns(F.col("r"), F.array(F.lit(1), F.lit(0), F.lit(1)), 0.5).alias("x")).collect()}
    assert back[1] == [1.0, 3.5, 3.0]
    assert {r.k: r.x for r in df.where("k IN (1, 2)").select("k", tokens.gae(F.col("r"), F.transform("r", lambda x: x * 0), 0.5, 1.0).alias("x")).collect()} == {1: [2.75, 3.5, 3.0], 2: None}
