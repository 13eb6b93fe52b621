"""``topk`` and ``bottom``: rows with the largest or smallest values of a column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _select(df: DataFrame, column: str, k: int, ties: Sequence[str], descending: bool) -> DataFrame:
    if not isinstance(k, int) or not 1 <= k <= 255:
        raise ValueError("k must be a number from 1 to 255")
    order = F.col(column).desc_nulls_last() if descending else F.col(column).asc_nulls_last()
    return df.orderBy(order, *(F.col(f"`{t}`").asc_nulls_last() for t in ties)).limit(k)  # a top-k operator: each task keeps k rows


def topk(df: DataFrame, column: str, k: int, ties: Sequence[str] = ()) -> DataFrame:
    """The ``k`` rows with the largest values, nulls last; of equal values the smallest in the columns ``ties``, else any."""
    return _select(df, column, k, ties, True)


def bottom(df: DataFrame, column: str, k: int, ties: Sequence[str] = ()) -> DataFrame:
    """The ``k`` rows with the smallest values, nulls last; of equal values the smallest in the columns ``ties``, else any."""
    return _select(df, column, k, ties, False)
