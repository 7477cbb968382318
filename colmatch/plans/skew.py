"""Joins that stay even when one key holds a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_KEYS = 20_000


def join_counted(left: DataFrame, counted: DataFrame, key: str, n: str, rows: int) -> DataFrame:
    """Inner join of ``left`` with ``counted``: one row per key, ``n`` = the key's rows in ``left``.

    Keys with more than ``rows / HOT_KEYS`` rows (at least 1,000) are joined by
    broadcast: there can be no more than HOT_KEYS of them. Every other key has few
    rows, so the shuffled join of the rest is even.
    """
    least = max(1_000, rows // HOT_KEYS)
    hot = counted.where(F.col(n) > least)
    flagged = left.join(F.broadcast(hot), key, "left")
    often = flagged.where(F.col(n).isNotNull())
    seldom = flagged.where(F.col(n).isNull()).select(*left.columns).join(counted.where(F.col(n) <= least), key)
    return often.unionByName(seldom.select(*often.columns))
