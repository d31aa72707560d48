"""Queries of the training-data operators, by name, with DuckDB SQL where the result can be said in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rolloutlake.llm import bpe, leaks, minhash, oracles, personal, poisson, quotas, radix, replies, segjoin, splits

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p3_found": segjoin.p3_found,
    "p3_report": segjoin.p3_report,
    "p5_found": minhash.p5_found,
    "p5_groups": minhash.p5_groups,
    "p10_found": personal.p10_found,
    "p10_replaced": personal.p10_replaced,
    "p1_found": replies.p1_found,
    "p1_report": replies.p1_report,
    "p6_found": quotas.p6_found,
    "p6_sample": quotas.p6_sample,
    "p7_sample": poisson.p7_sample,
    "p7_growth": poisson.p7_growth,
    "p9_found": leaks.p9_found,
    "p9_reworked": leaks.p9_reworked,
    "p9_leaked_items": leaks.p9_leaked_items,
    "p2_found": splits.p2_found,
    "p2_splits": splits.p2_splits,
    "p2_shares": splits.p2_shares,
    "p4_found": radix.p4_found,
    "p4_copies": radix.p4_copies,
    "p8_ids": bpe.p8_ids,
    "p8_round_trip": bpe.p8_round_trip,
}

ORACLE: dict[str, str] = {**quotas.ORACLE, **poisson.ORACLE, **oracles.ORACLE}
