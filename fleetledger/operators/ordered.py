"""Ordered computations over keys that may be hot.

A window partitioned by a repository alone sorts the whole repository in one task. These helpers
split each key into consecutive buckets, run the window inside (key, bucket), and carry one small
row per bucket across. ``bucket`` must be non-decreasing in the sort order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

_BUCKET = "__bucket"


def _window(keys: Sequence[str], order: Sequence[Column]):
    return Window.partitionBy(*keys, _BUCKET).orderBy(*order)


def _across(keys: Sequence[str]):
    return Window.partitionBy(*keys).orderBy(_BUCKET)


def running_total_before(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], value: Column, bucket: Column, out: str
) -> DataFrame:
    """Sum of ``value`` over the rows of the same key that sort strictly before this row."""
    rows = df.withColumn(_BUCKET, bucket).withColumn("__v", value)
    before = Window.unboundedPreceding, -1
    offsets = (
        rows.groupBy(*keys, _BUCKET)
        .agg(F.sum("__v").alias("__sum"))
        .select(
            *keys,
            _BUCKET,
            F.coalesce(F.sum("__sum").over(_across(keys).rowsBetween(*before)), F.lit(0)).alias("__offset"),
        )
    )
    local = F.coalesce(F.sum("__v").over(_window(keys, order).rowsBetween(*before)), F.lit(0))
    return (
        rows.withColumn("__local", local)
        .join(offsets, [*keys, _BUCKET])
        .withColumn(out, F.col("__local") + F.col("__offset"))
        .drop("__local", "__offset", "__v", _BUCKET)
    )


def ordinal(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], bucket: Column, out: str
) -> DataFrame:
    """1-based position of each row within its key."""
    counted = running_total_before(df, keys, order, F.lit(1).cast("long"), bucket, out)
    return counted.withColumn(out, (F.col(out) + 1).cast("long"))


def carry_last(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], value: Column, bucket: Column, out: str
) -> DataFrame:
    """The latest non-null ``value`` at or before this row; null when there is none."""
    rows = df.withColumn(_BUCKET, bucket).withColumn("__v", value)
    carried = (
        rows.where(F.col("__v").isNotNull())
        .groupBy(*keys, _BUCKET)
        .agg(F.max_by("__v", F.struct(*order)).alias("__last"))
    )
    buckets = rows.select(*keys, _BUCKET).distinct().join(carried, [*keys, _BUCKET], "left")
    carry = buckets.select(
        *keys,
        _BUCKET,
        F.last("__last", ignorenulls=True)
        .over(_across(keys).rowsBetween(Window.unboundedPreceding, -1))
        .alias("__carry"),
    )
    local = F.last("__v", ignorenulls=True).over(
        _window(keys, order).rowsBetween(Window.unboundedPreceding, 0)
    )
    return (
        rows.withColumn("__local", local)
        .join(carry, [*keys, _BUCKET])
        .withColumn(out, F.coalesce("__local", "__carry"))
        .drop("__local", "__carry", "__v", _BUCKET)
    )


def next_value(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], value: Column, bucket: Column, out: str
) -> DataFrame:
    """``value`` of the row that follows this one within its key; null on the last row."""
    rows = df.withColumn(_BUCKET, bucket).withColumn("__v", F.struct(value.alias("v")))
    firsts = (
        rows.groupBy(*keys, _BUCKET)
        .agg(F.min_by("__v", F.struct(*order)).alias("__first"))
        .select(*keys, _BUCKET, F.lead("__first").over(_across(keys)).alias("__next"))
    )
    return (
        rows.withColumn("__local", F.lead("__v").over(_window(keys, order)))
        .join(firsts, [*keys, _BUCKET])
        .withColumn(out, F.coalesce("__local", "__next")["v"])
        .drop("__local", "__next", "__v", _BUCKET)
    )
