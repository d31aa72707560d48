"""Scorers that may fail, hang or live elsewhere: guarded scoring in Arrow batches, judge pools, and functions by file path.

A guarded score never stops a job: an exception, or a call beyond its time, scores 0.0 and says so in ``error``; order
and number of rows are kept. Calls are made from the executors, a few at a time.
"""

from __future__ import annotations

import importlib.util
import threading
import time
from collections.abc import Callable, Iterator
from pathlib import Path
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from rolloutlake.operators.scoring import LOSSES, MANAGERS, SCORERS, Registry

INTERACTIONS = Registry("interaction")

__all__ = ["INTERACTIONS", "LOSSES", "MANAGERS", "SCORERS", "function_from_file", "guarded_scores", "judged", "load_interactions", "load_manager", "user_dataset"]


def _called(call: Callable[..., Any], given: tuple, retries: int, wait: float) -> Any:
    for attempt in range(retries + 1):
        try:
            return call(*given)
        except Exception:
            if attempt == retries:
                raise
            time.sleep(wait * 2**attempt)


def _outcomes(call: Callable[..., Any], rows: list[tuple], seconds: float, at_once: int, retries: int, wait: float) -> list[tuple[Any, str | None]]:
    """(result, error) of every row, in order; a call that is not done in time is left behind in its thread."""
    out: list[tuple[Any, str | None]] = []

    def one(given: tuple, box: list) -> None:
        try:
            box.append((_called(call, given, retries, wait), None))
        except Exception as failed:
            box.append((None, f"{type(failed).__name__}: {failed}"[:200]))

    for start in range(0, len(rows), at_once):
        boxes: list[list] = [[] for _ in rows[start : start + at_once]]
        threads = [threading.Thread(target=one, args=(row, box), daemon=True) for row, box in zip(rows[start:], boxes)]
        for t in threads:
            t.start()
        until = time.monotonic() + seconds
        for t, box in zip(threads, boxes):
            t.join(max(0.0, until - time.monotonic()))
            out.append(box[0] if box else (None, "timeout"))
    return out


def guarded_scores(df: DataFrame, key: str, columns: list[str], score: Callable[..., Any], seconds: float = 5.0, at_once: int = 8) -> DataFrame:
    """(key, score, error): ``score`` of the columns' values; a tuple counts by its first part; failures and timeouts are 0.0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(zip(*(batch.column(k + 1).to_pylist() for k in range(len(columns)))))
            found = _outcomes(score, rows, seconds, at_once, 0, 0.0)
            values = [0.0 if e is not None or v is None else float(v[0] if isinstance(v, tuple | list) else v) for v, e in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.float64()), pa.array([e for _, e in found], pa.string())], names=[key, "score", "error"])

    schema = T.StructType([df.schema[key], T.StructField("score", T.DoubleType()), T.StructField("error", T.StringType())])
    return df.select(key, *columns).mapInArrow(run, schema)


def judged(df: DataFrame, key: str, columns: list[str], judge: Callable[..., str | None], seconds: float = 60.0, at_once: int = 32, retries: int = 3, wait: float = 0.5) -> DataFrame:
    """(key, reply, error): replies of a judge that lives elsewhere, with retries and growing waits; null where it failed.

    ``judge`` takes the columns' values and must be picklable; it opens its own connection on the executor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(zip(*(batch.column(k + 1).to_pylist() for k in range(len(columns)))))
            found = _outcomes(judge, rows, seconds, at_once, retries, wait)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([None if v is None else str(v) for v, _ in found], pa.string()), pa.array([e for _, e in found], pa.string())], names=[key, "reply", "error"])

    schema = T.StructType([df.schema[key], T.StructField("reply", T.StringType()), T.StructField("error", T.StringType())])
    return df.select(key, *columns).mapInArrow(run, schema)


def function_from_file(path: str, name: str, **fixed: Any) -> Callable[..., Any]:
    """A function of a user's Python file, with ``fixed`` keyword arguments bound; a missing file or name is an error."""
    if not Path(path).is_file():
        raise FileNotFoundError(path)
    spec = importlib.util.spec_from_file_location(f"_user_{Path(path).stem}", path)
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    if not hasattr(module, name):
        raise AttributeError(f"{path} has no {name!r}")
    found = getattr(module, name)
    return (lambda *args, **kw: found(*args, **{**fixed, **kw})) if fixed else found


def load_manager(manager: str, scorer: str | Callable[..., Any]) -> Callable[..., DataFrame]:
    """A reward manager with its scorer: takes (df, solution, truth, length, width, ...) and adds token rewards.

    ``scorer`` is a registered name or a function of two columns.
    """
    reward = MANAGERS.get(manager)
    score = SCORERS.get(scorer) if isinstance(scorer, str) else scorer

    def manage(df: DataFrame, solution: str, truth: str, length: str, width: int, **options: Any) -> DataFrame:
        return reward(df.withColumn("score", score(df[solution], df[truth])), "score", length, width, **options)

    return manage


def load_interactions(config: list[dict[str, Any]], known: Registry = INTERACTIONS) -> dict[str, Any]:
    """Name to object of a list of {name, kind, config}; the kind is a registered class, names are unique."""
    out: dict[str, Any] = {}
    for item in config:
        name = item.get("name") or item["kind"]
        if name in out:
            raise ValueError(f"interaction {name!r} is given twice")
        out[name] = known.get(item["kind"])(**item.get("config", {}))
    return out


def user_dataset(path: str, name: str, df: DataFrame, **config: Any) -> DataFrame:
    """A user's ``DataFrame -> DataFrame`` function from a file, applied; anything but a DataFrame as result is an error."""
    made = function_from_file(path, name)(df, **config)
    if not isinstance(made, DataFrame):
        raise TypeError(f"{name!r} must return a DataFrame")
    return made
