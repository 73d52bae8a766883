"""Evaluate a derived column once before a lambda uses it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row.

    The optimizer may inline a derived column into a lambda that mentions it, where it would be computed
    again for every element. Passing it as a lambda's own variable rules that out.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def unnest(df: DataFrame, keep: list[str], array: Column, into: list[str] | None = None) -> DataFrame:
    """One row per element of ``array`` next to the ``keep`` columns; structs become columns.

    The outer form of the generator is used and its empty rows dropped afterwards: for the inner form the
    optimizer adds a ``size(array) > 0`` filter below it, which would compute a derived array twice.
    """
    rows = df.select(*keep, F.posexplode_outer(array).alias("__pos", "__item")).where("__pos IS NOT NULL")
    if into is None:
        return rows.select(*keep, "__item.*")
    if len(into) == 2:
        return rows.select(*keep, F.col("__pos").alias(into[0]), F.col("__item").alias(into[1]))
    return rows.select(*keep, F.col("__item").alias(into[0]))
