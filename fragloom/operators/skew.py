"""Joins in which one key may hold any part of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST_HOT = 100_000  # rows that one task joins without trouble


def attach(df: DataFrame, lookup: DataFrame, key: str, rows: str, total: int, most: int | None = None, parts: int = 1000) -> DataFrame:
    """``df JOIN lookup USING (key)``, for a lookup with one row per key that also says how many rows of ``df`` have it.

    Keys with at least one in ``parts`` of all ``total`` rows, and ``LEAST_HOT`` at least, are hot; as their counts add up to
    ``total`` at most, there can't be more than ``parts`` of them, so they are broadcast and their rows stay where they are.
    All others are joined by shuffle, where no key then has more rows than that. ``most`` is the greatest count, if the caller
    knows it: where no key is hot, both sides are read once. ``lookup`` should be a written table. Null keys match nothing.
    ``rows`` is dropped.
    """
    limit = max(LEAST_HOT, -(-total // parts))
    if (total if most is None else most) < limit:
        return df.join(lookup.drop(rows), key)
    hot = F.broadcast(lookup.where(F.col(rows) >= limit).drop(rows))
    cold = lookup.where(F.col(rows) < limit).drop(rows)
    return df.join(hot, key).unionByName(df.join(hot.select(key), key, "left_anti").join(cold, key))
