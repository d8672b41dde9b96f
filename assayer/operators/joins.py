"""Joins on keys of which a few may hold a large part of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is frequent if more than one in SHARE of all rows have it; there are fewer than SHARE such keys.
SHARE = 1_000


def with_key(rows: DataFrame, keyed: DataFrame, key: str, n: str) -> DataFrame:
    """rows with the columns of `keyed`, which has one row for each key and in `n` how many rows have it.

    Rows of frequent keys stay in the tasks that read them and meet a broadcast of those keys; the others meet theirs by a shuffle.  keyed
    is read several times: keep it.
    """
    often = F.col(n) * SHARE > keyed.agg(F.sum(n)).first()[0]
    frequent = keyed.where(often)
    if frequent.isEmpty():
        return rows.join(keyed, key)
    rest = rows.join(F.broadcast(frequent.select(key)), key, "left_anti").join(keyed.where(~often), key)
    return rows.join(F.broadcast(frequent), key).unionByName(rest)
