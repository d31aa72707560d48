"""Scorers by data source, reward managers and the aggregation of code-check results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rolloutlake.functions import math_answers as ma
from rolloutlake.functions import text as tx
from rolloutlake.operators import losses as ls

Scorer = Callable[[Column, Column], Column]


class Registry:
    """Names to functions. ``strict`` refuses another function under a taken name; otherwise the last one counts."""

    def __init__(self, what: str, strict: bool = True):
        self.what, self.strict, self.known = what, strict, {}

    def register(self, name: str):
        def keep(fn):
            if self.strict and self.known.get(name, fn) is not fn:
                raise ValueError(f"{self.what} {name!r} is already registered")
            self.known[name] = fn
            return fn

        return keep

    def get(self, name: str):
        if name not in self.known:
            raise ValueError(f"unknown {self.what} {name!r}; known: {', '.join(sorted(self.known))}")
        return self.known[name]


SCORERS = Registry("scorer")
MANAGERS = Registry("reward manager")
LOSSES = Registry("policy loss", strict=False)

for _name, _loss in (("vanilla", ls.policy_loss), ("gspo", ls.gspo_loss), ("clip_cov", ls.clip_cov_tokens), ("kl_cov", ls.kl_cov_tokens), ("sppo", ls.sppo_loss)):
    LOSSES.register(_name)(_loss)


@SCORERS.register("hash_answer")
def hash_scorer(solution: Column, truth: Column) -> Column:
    return tx.match_score(tx.hash_answer(solution), truth)


@SCORERS.register("boxed")
def boxed_scorer(solution: Column, truth: Column) -> Column:
    return F.coalesce((F.trim(tx.flat_boxed(solution)) == F.trim(truth)).cast("double"), F.lit(0.0))


@SCORERS.register("choice")
def choice_scorer(solution: Column, truth: Column) -> Column:
    return tx.choice_grade(tx.choice_letter(solution), truth).cast("double")


@SCORERS.register("final_answer")
def final_scorer(solution: Column, truth: Column) -> Column:
    """Plus or minus one by the normalised last answer line of the last 300 characters."""
    return F.when(tx.normal_final_answer(tx.answer_line(tx.tail(solution, 300))) == tx.normal_final_answer(truth), 1.0).otherwise(-1.0)


@SCORERS.register("strict_box")
def strict_box_scorer(solution: Column, truth: Column) -> Column:
    """Plus or minus one by the last box of the last 100 characters, compared as text."""
    return F.when(ma.boxed_udf(tx.tail(solution, 100)) == truth, 1.0).otherwise(-1.0)


@SCORERS.register("math")
def math_scorer(solution: Column, truth: Column) -> Column:
    return ma.math_score_udf(solution, truth)


@SCORERS.register("geometry")
def geometry_scorer(solution: Column, truth: Column) -> Column:
    """0.9 for a right answer in a box and 0.1 for a reply that thinks before it boxes."""
    return 0.9 * ma.math_score_udf(solution, truth) + 0.1 * tx.think_format(solution).cast("double")


@SCORERS.register("character_count")
def count_scorer(solution: Column, truth: Column) -> Column:
    """1 if the last box holds just the truth."""
    return F.coalesce((ma.boxed_udf(solution) == truth).cast("double"), F.lit(0.0))


@SCORERS.register("question_answer")
def qa_scorer(solution: Column, truth: Column) -> Column:
    return tx.qa_score(tx.answer_tag(solution), F.array(truth), solution)


def routed(df: DataFrame, routes: dict[str, str], source: str = "data_source", solution: str = "solution", truth: str = "ground_truth", out: str = "score") -> DataFrame:
    """Scores by data source; an unknown source is an error when its row is read."""
    score = None
    for name, scorer in routes.items():
        value = SCORERS.get(scorer)(F.col(solution), F.col(truth))
        score = F.when(F.col(source) == name, value) if score is None else score.when(F.col(source) == name, value)
    return df.withColumn(out, score.otherwise(F.raise_error(F.concat(F.lit("no scorer for source "), F.coalesce(F.col(source), F.lit("null")))).cast("double")))


@MANAGERS.register("naive")
def last_token_reward(df: DataFrame, score: str, length: str, width: int, out: str = "rewards") -> DataFrame:
    """Score at the last valid token, 0 elsewhere."""
    return df.withColumn(out, F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.when(i == F.col(length) - 1, F.col(score)).otherwise(0.0)))


@MANAGERS.register("dapo")
def penalised_reward(df: DataFrame, score: str, length: str, width: int, buffer: int, factor: float = 1.0, out: str = "rewards") -> DataFrame:
    """As naive, with the overlong penalty added to the score."""
    return last_token_reward(df.withColumn("_s", F.col(score) + tx.overlong_penalty(F.col(length), width, buffer, factor)), "_s", length, width, out).drop("_s")


def case_status(expected: Column, output: Column, compiled: Column, ran: Column, timed_out: Column) -> Column:
    """1 passed, 0 wrong, -1 no result, -2 runtime error, -3 timeout, -4 compile error; a final line break does not count."""
    same = F.regexp_replace(output, r"\n$", "") == F.regexp_replace(expected, r"\n$", "")
    return F.when(~compiled, -4).when(timed_out, -3).when(~ran, -2).when(output.isNull(), -1).when(same, 1).otherwise(0)


def after_compile_error(df: DataFrame, run: str, case: str, status: str) -> DataFrame:
    """Cases after the first compile error of a run are compile errors too."""
    w = Window.partitionBy(run).orderBy(case).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(status, F.when(F.max((F.col(status) == -4).cast("int")).over(w) == 1, -4).otherwise(F.col(status)))


def code_score(df: DataFrame, run: str, case: str, status: str, continuous: bool = False, most: int = 10) -> DataFrame:
    """Share of passed cases, over the first ``most`` when continuous; else all or nothing is ``all_passed``."""
    used = df.where(F.col(case) < most) if continuous else df
    return used.groupBy(run).agg(F.avg((F.col(status) == 1).cast("double")).alias("score"), F.bool_and(F.col(status) == 1).alias("all_passed"))


def improvement_reward(df: DataFrame, instance: str, order: str, reward: str) -> DataFrame:
    """0 when a tool call improved on the call before, else -0.05."""
    w = Window.partitionBy(instance).orderBy(order)
    return df.withColumn("step_reward", F.when(F.col(reward) > F.coalesce(F.lag(reward).over(w), F.lit(0.0)), 0.0).otherwise(-0.05))


def role_islands(df: DataFrame, conversation: str, turn: str, role: str) -> DataFrame:
    """Turn numbers in which consecutive tool messages are one turn and every other message its own."""
    w = Window.partitionBy(conversation).orderBy(turn)
    new = F.when((F.col(role) == "tool") & (F.lag(role).over(w) == "tool"), 0).otherwise(1)
    return df.withColumn("_new", new).withColumn("turn_no", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def sticky_assignment(df: DataFrame, request: str, order: str, servers: int) -> DataFrame:
    """Server of each request: first sight to the least loaded (round robin), later sights to the same."""
    first = df.groupBy(request).agg(F.min(order).alias("_f"))
    # Requests are ranked in ranges of their first sight, so that no window spans the table.
    from rolloutlake.operators.frame import with_row_index

    return df.join(with_row_index(first, "_f", "_i").select(request, (F.col("_i") % servers).alias("server")), request)
