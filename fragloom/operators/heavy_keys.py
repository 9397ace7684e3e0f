"""Per-key results where a few keys hold most rows: aggregate before every join and shuffle, join compact states, roll up.

Eager aggregation: with ``state(x) = (rows, sum of every measure)`` per join key and group, the join of two inputs needs no
joined row. A pair of states of one key stands for ``rows_l * rows_r`` joined rows, in which a measure of the left adds
``sum_l * rows_r`` and one of the right ``rows_l * sum_r``. The partial aggregation runs in the map tasks, so a hot key
leaves each of them as a single row, and no worker ever holds its rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pre_aggregate(df: DataFrame, by: Sequence[str], measures: Sequence[str] = (), rows: str = "rows") -> DataFrame:
    """``by``, the number of rows, and ``sum_<m>`` of each measure, null counting as 0.

    Null keys form a group of their own. An empty input gives no row.
    """
    sums = [F.coalesce(F.sum(m), F.lit(0).cast("bigint")).alias(f"sum_{m}") for m in measures]
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias(rows), *sums)


def roll_up(state: DataFrame, by: Sequence[str], rows: str = "rows") -> DataFrame:
    """States of finer groups added up to those of ``by``."""
    sums = [c for c in state.columns if c.startswith("sum_")]
    return state.groupBy(*by).agg(*[F.sum(c).alias(c) for c in (rows, *sums)])


def _same(left: str, right: str, columns: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, (F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}")) for c in columns))


def join_states(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Compact states of two inputs, ``l`` and ``r``, joined by their keys; null keys meet each other. No row of an input is joined."""
    return left.alias("l").join(right.alias("r"), _same("l", "r", on))


def join_aggregate(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    left_by: Sequence[str] = (),
    right_by: Sequence[str] = (),
    left_measures: Sequence[str] = (),
    right_measures: Sequence[str] = (),
) -> DataFrame:
    """``SELECT by, count(*) pairs, sum(l.m) left_m, sum(r.m) right_m FROM left JOIN right USING (on) GROUP BY by``, never joining rows.

    ``by`` is ``left_by + right_by``; a name that is in both comes out as ``left_<name>`` and ``right_<name>``. Join keys in
    ``left_by`` are allowed. A null join key matches nothing, as in SQL; null groups are groups; null measures count as 0; an
    empty side gives no row. Other columns of the inputs, whatever their names, are not read. Results are decimal(38,0) for
    whole numbers, so that products of large counts can't overflow a long.
    """
    wide = "decimal(38,0)"
    exact = lambda c, df, m: F.col(c).cast(wide) if dict(df.dtypes)[m] in ("tinyint", "smallint", "int", "bigint") else F.col(c)
    known = lambda df: df.where(reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in on)))
    states = join_states(pre_aggregate(known(left), list(dict.fromkeys([*on, *left_by])), left_measures), pre_aggregate(known(right), list(dict.fromkeys([*on, *right_by])), right_measures), on)
    both = set(left_by) & set(right_by)
    groups = [F.col(f"l.{c}").alias(f"left_{c}" if c in both else c) for c in left_by]
    groups += [F.col(f"r.{c}").alias(f"right_{c}" if c in both else c) for c in right_by]
    n, m = F.col("l.rows").cast(wide), F.col("r.rows").cast(wide)
    products = [(n * m).cast(wide).alias("pairs")]
    products += [(exact(f"l.sum_{c}", left, c) * m).cast(wide if dict(left.dtypes)[c] != "double" else "double").alias(f"left_{c}_sum") for c in left_measures]
    products += [(exact(f"r.sum_{c}", right, c) * n).cast(wide if dict(right.dtypes)[c] != "double" else "double").alias(f"right_{c}_sum") for c in right_measures]
    joined = states.select(*groups, *products)
    names = [c for c in joined.columns if c not in {"pairs", *(f"left_{c}_sum" for c in left_measures), *(f"right_{c}_sum" for c in right_measures)}]
    return joined.groupBy(*names).agg(*[F.sum(c).cast(joined.schema[c].dataType).alias(c) for c in joined.columns if c not in names])


def key_loads(df: DataFrame, outer: Sequence[str], key: str, measure: str) -> DataFrame:
    """(outer, key, rows, sum_<measure>, outer_rows, outer_sum): each key's state beside that of all keys of its outer group.

    This is the join of ``df`` with itself on ``outer``: one input is pre-aggregated by (outer, key), the other by outer, which
    is rolled up from the first, and the two states are joined. Rows without a key belong to no key and not to the outer group;
    null measures count as 0; a null outer value is a group.
    """
    state = pre_aggregate(df.where(F.col(key).isNotNull()), [*outer, key], [measure])
    total = roll_up(state, outer).withColumnsRenamed({"rows": "outer_rows", f"sum_{measure}": "outer_sum"})
    return join_states(state, total, outer).select("l.*", "r.outer_rows", "r.outer_sum")


def dominant_keys(df: DataFrame, outer: Sequence[str], key: str, measure: str, one_in: int = 50) -> DataFrame:
    """The loads of the keys that hold at least ``1 / one_in`` of the rows or of the summed measure of their outer group.

    A key of n of its group's N rows has n * N of the rows of the join on ``outer``, and n * n of them meet the key itself: the
    counts of the two states are multiplied, as are the sums. Products are exact.
    """
    wide = "decimal(38,0)"
    n, total = F.col("rows").cast(wide), F.col("outer_rows").cast(wide)
    r, all_r = F.col(f"sum_{measure}"), F.col("outer_sum")
    return key_loads(df, outer, key, measure).where((n * n * one_in >= n * total) | (r * one_in >= all_r))
