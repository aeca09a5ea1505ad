"""Sorts, limits and top-k. Every limit has a total order, so results do not vary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.numbers import clamp


def top_k(df: DataFrame, k: int, *order: Column | str) -> DataFrame:
    return df.orderBy(*order).limit(k)


def limit_clamped(df: DataFrame, wanted: int, low: int, high: int, *order: Column | str) -> DataFrame:
    return top_k(df, clamp(wanted, low, high), *order)


def rows_per_page(df: DataFrame, size: int | str) -> DataFrame:
    """One page of rows, or all of them for ``"all"``."""
    return df if size == "all" else df.limit(int(size))


def newest_n(df: DataFrame, n: int, *newest_first: Column) -> DataFrame:
    return top_k(df, n, *newest_first)


def last_days(df: DataFrame, day: str, k: int) -> DataFrame:
    """Rows of the ``k`` greatest keys of a one-row-per-key frame, ascending."""
    return df.orderBy(F.col(day).desc()).limit(k).orderBy(F.col(day).asc())
