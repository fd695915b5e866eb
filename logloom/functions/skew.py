"""Joins and prefix sums that no hot key can slow down."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot if it holds more than one in HOT_SHARE rows. By counting there are fewer than HOT_SHARE such
#: keys whatever the data, which bounds what is broadcast.
HOT_SHARE = 1000


def total_rows(sizes: DataFrame, n_col: str):
    """The sum of ``n_col`` as a scalar subquery: one number, no cross join and no driver round trip."""
    return sizes.agg(F.coalesce(F.sum(n_col), F.lit(0))).scalar()


def join_by_size(rows: DataFrame, keys: DataFrame, on: list[str], n_col: str, total) -> DataFrame:
    """Inner-join ``rows`` with ``keys`` (one row a key, ``n_col`` = how many rows have it).

    Keys with more than ``total / HOT_SHARE`` rows, fewer than ``HOT_SHARE`` of them by counting, are
    broadcast, so the rows of a hot key stay where they are. All others go through a shuffle join whose
    largest group is below a thousandth of the rows. Null keys match nothing. ``n_col`` isn't returned.
    """
    hot = keys.filter(F.col(n_col) * HOT_SHARE > total)
    cold = keys.filter(F.col(n_col) * HOT_SHARE <= total).drop(n_col)
    few = F.broadcast(hot.select(*on))
    return rows.join(F.broadcast(hot.drop(n_col)), on).unionByName(rows.join(few, on, "left_anti").join(cold, on))
