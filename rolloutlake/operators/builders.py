"""Row-mapping dataset builders: source rows to canonical training rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolloutlake.functions import text as tx


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def canonical_rows(df: DataFrame, source: str | Column, prompt: Column, truth: Column, ability: str, split: Column, index: Column, style: str = "rule", system: Column | None = None, **extra: Column) -> DataFrame:
    """The five canonical fields: data_source, prompt[], ability, reward_model{}, extra_info{}."""
    messages = F.array(*([message("system", system)] if system is not None else []), message("user", prompt))
    info = F.struct(split.alias("split"), index.alias("index"), *[c.alias(n) for n, c in extra.items()])
    return df.select(
        (F.lit(source) if isinstance(source, str) else source).alias("data_source"), messages.alias("prompt"), F.lit(ability).alias("ability"),
        F.struct(F.lit(style).alias("style"), truth.alias("ground_truth")).alias("reward_model"), info.alias("extra_info"),
    )


def with_instruction(question: Column, instruction: str) -> Column:
    return F.concat(question, F.lit(" " + instruction))


def add_extra(df: DataFrame, name: str, value: Column) -> DataFrame:
    """One more field in extra_info (tool or interaction arguments)."""
    return df.withColumn("extra_info", F.col("extra_info").withField(name, value))


def preference_sft(df: DataFrame, prompt: str, chosen: str, rejected: str) -> DataFrame:
    """Each pair as two (prompt, response) rows."""
    return df.select(F.col(prompt).alias("prompt"), F.explode(F.array(chosen, rejected)).alias("response"))


def preference_pairs(df: DataFrame, prompt: str, chosen: str, rejected: str) -> DataFrame:
    return df.select(F.col(prompt).alias("prompt"), F.col(chosen).alias("chosen"), F.col(rejected).alias("rejected"))


def conversations(df: DataFrame, conversation: str, turn: str, role: str, content: str) -> DataFrame:
    """Turns as one array of messages in order."""
    g = df.groupBy(conversation).agg(F.array_sort(F.collect_list(F.struct(turn, F.col(role).alias("role"), F.col(content).alias("content")))).alias("_m"))
    return g.select(conversation, F.transform("_m", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("messages"))


def shuffled_choices(key: Column, right: Column, wrong: Column, seed: int = 42) -> list[Column]:
    """Options in hash order of (key, text) and the letter of the right one."""
    ranked = F.array_sort(F.transform(F.array_union(F.array(right), wrong), lambda o: F.struct(F.xxhash64(key, o, F.lit(seed)).alias("h"), o.alias("o"))))
    options = F.transform(ranked, lambda s: s["o"])
    return [options.alias("options"), F.substring(F.lit("ABCDEFGH"), F.array_position(options, right).cast("int"), F.lit(1)).alias("letter")]


def judge_prompt(question: Column, reference: Column, candidate: Column, most: int = 4000) -> Column:
    """Judge text with capped parts; empty parts read [empty]."""
    part = lambda c: F.coalesce(F.nullif(F.left(F.trim(F.coalesce(c, F.lit(""))), F.lit(most)), F.lit("")), F.lit("[empty]"))
    return F.concat(F.lit("Question:\n"), part(question), F.lit("\n\nReference:\n"), part(reference), F.lit("\n\nCandidate:\n"), part(candidate), F.lit("\n\nScore (0-10):"))


def gold_answer(answer: Column, open_answer: Column) -> Column:
    """``answer`` unless it is a bare letter A to D."""
    return F.when(F.trim(answer).rlike("^[A-D]$"), open_answer).otherwise(answer)


def gathered_responses(df: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """n samples per row as one responses array in order."""
    return df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, text))).alias("_r")).select(key, F.col("_r")[text].alias("responses"))


def media_rows(df: DataFrame, question: str, answer: str, instruction: str, images: Sequence[str] = (), videos: Sequence[str] = (), audios: Sequence[str] = ()) -> DataFrame:
    """Question rows with media: a placeholder in front of the question and an entry in the list for every medium that is there."""
    there = lambda c: F.length(F.trim(F.coalesce(F.col(c), F.lit("")))) > 0
    lists, marks = {}, []
    for kind, columns in (("image", images), ("video", videos), ("audio", audios)):
        lists[f"{kind}s"] = F.filter(F.array(*[F.when(there(c), F.col(c)) for c in columns]).cast("array<string>"), lambda x: x.isNotNull())
        marks += [F.when(there(c), f"<{kind}>").otherwise("") for c in columns]
    content = F.concat(*marks, F.col(question), F.lit(f" {instruction}"))
    return df.select(
        F.array(F.struct(F.lit("user").alias("role"), content.alias("content"))).alias("prompt"), *[v.alias(k) for k, v in lists.items()],
        F.struct(F.lit("rule").alias("style"), F.col(answer).alias("ground_truth")).alias("reward_model"),
    )


def tool_rows(df: DataFrame, question: str, solution: str, tool: str) -> DataFrame:
    """Rows for a calculator-like tool: the truth is the number behind ``####`` without commas, and the tool is created with it."""
    truth = tx.first_hash_answer(F.col(solution))
    kwargs = F.struct(F.lit(tool).alias("tool"), F.struct(truth.alias("ground_truth")).alias("create_kwargs"))
    return df.select(
        F.array(F.struct(F.lit("user").alias("role"), F.col(question).alias("content"))).alias("prompt"),
        F.struct(F.lit("rule").alias("style"), truth.alias("ground_truth")).alias("reward_model"),
        F.struct(F.lit(True).alias("need_tools_kwargs"), F.col(solution).alias("answer"), F.col(question).alias("question"), kwargs.alias("tools_kwargs")).alias("extra_info"),
    )
