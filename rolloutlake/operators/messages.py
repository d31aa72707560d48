"""Chat messages: segments, suffixes, masks by role, and training rows from flat or nested inputs."""

from __future__ import annotations

import base64
import json
import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rolloutlake.functions import tokens as tk


def segments(prompt: Column) -> Column:
    """Text and media segments of a prompt: placeholders <image>, <video> and <audio> are segments of their kind; empty ones vanish."""
    marked = F.regexp_replace(prompt, r"(<image>|<video>|<audio>)", "\u0001$1\u0001")
    parts = F.filter(F.split(marked, "\u0001"), lambda x: x != "")
    kind = lambda x: F.when(x.isin("<image>", "<video>", "<audio>"), F.translate(x, "<>", "")).otherwise(F.lit("text"))
    return F.transform(parts, lambda x: F.struct(kind(x).alias("type"), F.when(kind(x) == "text", x).alias("text")))


def media_kind(image: Column, video: Column, audio: Column) -> Column:
    """Medium of a row by precedence image, video, audio, text."""
    has = lambda c: F.length(F.trim(F.coalesce(c, F.lit("")))) > 0
    return F.when(has(image), "image").when(has(video), "video").when(has(audio), "audio").otherwise("text")


def with_suffix(messages: Column, suffix: str) -> Column:
    """Suffix on the content of the last message."""
    last = F.size(messages) - 1
    return F.transform(messages, lambda m, i: F.struct(m["role"].alias("role"), F.when(i == last, F.concat(m["content"], F.lit(suffix))).otherwise(m["content"]).alias("content")))


def training_row(df: DataFrame, question: Column, answer: Column, index: Column, source: Column | None = None) -> DataFrame:
    """reward_model, data_source and index, made where a flat table lacks them; the answer always counts as truth."""
    return df.withColumns({
        "prompt_messages": F.array(F.struct(F.lit("user").alias("role"), question.alias("content"))),
        "reward_model": F.struct(F.lit("rule").alias("style"), answer.alias("ground_truth")),
        "data_source": F.coalesce(source if source is not None else F.lit(None).cast("string"), F.lit("unknown")),
        "index": F.coalesce(index, F.lit(0)),
    })


def role_mask(df: DataFrame, conversation: str, turn: str, role: str, tokens: str) -> DataFrame:
    """(conversation, turn, mask): 1 for assistant tokens, 0 for all others; a system message after the first turn or an unknown role is an error."""
    first = F.row_number().over(Window.partitionBy(conversation).orderBy(turn)) == 1
    known = F.col(role).isin("system", "user", "assistant", "tool") & ((F.col(role) != "system") | first)
    value = F.when(~known, F.raise_error(F.lit("role out of place")).cast("int")).when(F.col(role) == "assistant", 1).otherwise(0)
    return df.select(conversation, turn, F.transform(tokens, lambda _: F.lit(0)).alias("_z"), value.alias("_v")).select(conversation, turn, F.transform("_z", lambda _: F.col("_v")).alias("mask"))


#: Most turns of a conversation that become one row.
MOST_TURNS = 100_000


def padded_conversations(df: DataFrame, conversation: str, turn: str, role: str, tokens: str, length: int, pad: int = 0) -> DataFrame:
    """One row per conversation: input_ids, attention_mask and loss_mask (1 for assistant tokens) of all turns in order, cut or padded on
    the right to ``length``, and the number of tokens before that. Conversations above MOST_TURNS turns are refused."""
    known = F.col(role).isin("system", "user", "assistant", "tool")
    mark = F.when(~known, F.raise_error(F.lit("unknown role")).cast("int")).when(F.col(role) == "assistant", 1).otherwise(0)
    turns = df.groupBy(conversation).agg(F.array_sort(F.collect_list(F.struct(F.col(turn).alias("t"), F.col(tokens).alias("ids"), mark.alias("m")))).alias("_t"), F.count(F.lit(1)).alias("_n"))
    sure = F.when(F.col("_n") <= MOST_TURNS, F.col("_t")).otherwise(F.raise_error(F.lit("conversation too long")).cast(turns.schema["_t"].dataType))
    flat = turns.select(conversation, sure.alias("_t")).select(conversation, F.flatten(F.transform("_t", lambda x: x["ids"])).alias("ids"), F.flatten(F.transform("_t", lambda x: F.transform(x["ids"], lambda _: x["m"]))).alias("m"))
    fit = lambda c, fill: tk.pad_to(F.slice(c, 1, length), length, fill)
    return flat.select(conversation, F.size("ids").alias("n_tokens"), fit(F.col("ids"), pad).alias("input_ids"), fit(F.transform("ids", lambda _: F.lit(1)), 0).alias("attention_mask"), fit(F.col("m"), 0).alias("loss_mask"))


def preference_pack(prompt: Column, chosen: Column, rejected: Column, pad: int = 0) -> list[Column]:
    """chosen_ids and rejected_ids with the prompt in front, padded on the right to the longer of the two, and their attention masks."""
    both = [F.concat(prompt, x) for x in (chosen, rejected)]
    longest = F.greatest(F.size(both[0]), F.size(both[1]))
    fill = lambda ids, value: F.concat(ids, F.array_repeat(F.lit(value), longest - F.size(ids)))
    out = []
    for name, ids in zip(("chosen", "rejected"), both):
        out += [fill(ids, pad).alias(f"{name}_ids"), fill(F.transform(ids, lambda _: F.lit(1)), 0).alias(f"{name}_mask")]
    return out


def choice_rows(df: DataFrame, context: Column, endings: Column, label: Column) -> DataFrame:
    """Rows with choices and the index of the right one; unlabelled rows are dropped."""
    return df.where(F.length(label) > 0).select(
        context.alias("prompt"), F.struct(F.lit("rule").alias("style"), F.lit("choice").alias("eval"), label.cast("int").alias("ground_truth"), F.transform(endings, lambda e: F.trim(e)).alias("choices")).alias("reward_model")
    )


def search_rows(df: DataFrame, prefix: str, question: Column, golds: Column, fallback: Column) -> DataFrame:
    """Question rows for retrieval: prefixed question, golden answers or their fallback, tool arguments with the truth."""
    targets = F.when(F.size(golds) > 0, golds).otherwise(F.array(fallback))
    return df.select(
        F.array(F.struct(F.lit("user").alias("role"), F.concat(F.lit(prefix), question).alias("content"))).alias("prompt"),
        F.struct(F.lit("rule").alias("style"), F.struct(targets.alias("target")).alias("ground_truth")).alias("reward_model"),
        F.struct(F.lit(True).alias("need_tools_kwargs"), question.alias("question"), F.struct(targets.alias("ground_truth")).alias("tools_kwargs")).alias("extra_info"),
    )


def test_cases(payload: str | None) -> str | None:
    """JSON of base64 + zlib compressed test cases, or of plain JSON; anything else is null. Nothing is unpickled."""
    if payload is None:
        return None
    for read in (lambda: payload, lambda: zlib.decompress(base64.b64decode(payload, validate=True)).decode("utf-8")):
        try:
            return json.dumps(json.loads(read()))
        except (ValueError, zlib.error):
            continue
    return None


@F.pandas_udf(T.StringType())
def test_cases_udf(payload: pd.Series) -> pd.Series:
    return payload.map(test_cases)


def process_rloo(df: DataFrame, prompt: str, sequence: str, position: str, reward: str, mask: str) -> DataFrame:
    """Token rewards less the mean reward of the prompt's other sequences, cumulated from the end of each sequence.

    Sums across rows are made in decimals of twelve digits, so that they do not depend on the order of partial sums.
    """
    exact = "decimal(28,12)"
    m = F.col(mask)
    per = df.groupBy(prompt, sequence).agg((F.sum((F.col(reward) * m).cast(exact)).cast("double") / F.greatest(F.sum(m), F.lit(1))).cast(exact).alias("_r"))
    totals = per.groupBy(prompt).agg(F.sum("_r").alias("_s"), F.count(F.lit(1)).alias("_n"))
    base = F.when(F.col("_n") > 1, (F.col("_s") - F.col("_r")).cast("double") / (F.col("_n") - 1)).otherwise(F.lit(0.0))
    joined = df.join(per.join(totals, prompt).select(prompt, sequence, base.alias("_b")), [prompt, sequence])
    end = Window.partitionBy(prompt, sequence).orderBy(F.col(position).desc()).rowsBetween(Window.unboundedPreceding, 0)
    return joined.withColumn("advantage", F.sum((F.col(reward) - F.col("_b")) * m).over(end)).drop("_b")


def detached_contrast(df: DataFrame, group: str, index: str, q: str, acc: str, beta: float) -> DataFrame:
    """Per row: mean Q of worse peers for right rows and of better peers for wrong ones, and the log-sigmoid contrast with its own Q."""
    peer = df.select(group, F.col(index).alias("_i"), F.col(q).alias("_q"), F.col(acc).alias("_a"))
    pairs = df.select(group, index, q, acc).join(peer, group).where(F.col(acc) != F.col("_a"))
    mean = pairs.groupBy(group, index, q, acc).agg(F.avg("_q").alias("peers"))
    sign = F.when(F.col(acc) > 0, 1.0).otherwise(-1.0)
    return mean.withColumn("loss", F.log1p(F.exp(-sign * beta * (F.col(q) - F.col("peers")))))
