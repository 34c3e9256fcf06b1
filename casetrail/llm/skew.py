"""Joins on keys of which some hold many rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: A key with this share of the rows or more is broadcast; there are 1 / HOT such keys at most.
HOT = 1 / 1000


def join_by_size(rows: DataFrame, keyed: DataFrame, keys: list[str], n: str) -> DataFrame:
    """``rows`` joined to ``keyed``, which has one row a key and the number ``n`` of its rows and is written somewhere.
    Rows of hot keys stay where they are and meet a broadcast of at most 1 / HOT rows; the others are shuffled."""
    total = keyed.agg(F.sum(n)).first()[0] or 0
    hot = F.col(n) >= total * HOT
    many = keyed.where(hot)
    rest = rows.join(F.broadcast(many.select(*keys)), keys, "left_anti").join(keyed.where(~hot), keys)
    return rows.join(F.broadcast(many), keys).unionByName(rest)
