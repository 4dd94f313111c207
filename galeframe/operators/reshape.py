"""Unions by name, order, heads and set operations."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame


def union_by_time(parts: Sequence[DataFrame], time: str | None = None) -> DataFrame:
    """Rows of all parts, columns by name, absent ones missing; in time order if a time column is named."""
    whole = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return whole.orderBy(time) if time else whole


def stable_sort(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All rows in the order of keys; what ties on them follows the other columns, so the order is full."""
    return df.orderBy(*keys, *[c for c in df.columns if c not in keys])


def head(df: DataFrame, keys: Sequence[str], n: int) -> DataFrame:
    """The first n rows of the full order by keys; the limit is the operator."""
    return stable_sort(df, keys).limit(n)


def rows_only_in(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct rows of a that b lacks, columns by name."""
    return a.subtract(b.select(*a.columns))


def rows_in_both(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct rows that both have, columns by name."""
    return a.intersect(b.select(*a.columns))
