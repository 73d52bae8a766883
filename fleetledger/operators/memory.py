"""Analytics over the append-only context log."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window, functions as F

from fleetledger.operators.ordered import running_total_before

DEFAULT_THRESHOLD = 3
TOP_FILES = 5


def load_counts(log: DataFrame) -> DataFrame:
    """``repo_id, path, loads``: how many entries loaded each file."""
    loaded = log.select("repo_id", F.explode("files_loaded").alias("path"))
    return loaded.groupBy("repo_id", "path").agg(F.count("*").alias("loads"))


def last_modifications(log: DataFrame) -> DataFrame:
    modified = log.select("repo_id", "ts", F.explode("modifications").alias("path"))
    return modified.groupBy("repo_id", "path").agg(F.max("ts").alias("last_modified"))


def file_activity(log: DataFrame) -> DataFrame:
    """Loads and last modification of every file the log names, in one aggregation."""
    none = F.lit(None).cast("timestamp")
    loaded = log.select("repo_id", F.explode("files_loaded").alias("path"), none.alias("modified_at"), F.lit(1).alias("load"))
    modified = log.select(
        "repo_id", F.explode("modifications").alias("path"), F.col("ts").alias("modified_at"), F.lit(0).alias("load")
    )
    return (
        loaded.unionByName(modified)
        .groupBy("repo_id", "path")
        .agg(F.sum("load").alias("loads"), F.max("modified_at").alias("last_modified"))
    )


def top_files(log: DataFrame, n: int = TOP_FILES) -> DataFrame:
    """The ``n`` most loaded files of each repository; equal counts in path order."""
    rank = F.row_number().over(Window.partitionBy("repo_id").orderBy(F.desc("loads"), "path"))
    return load_counts(log).withColumn("rank", rank).where(F.col("rank") <= n)


def log_totals(log: DataFrame) -> DataFrame:
    """The sums and extremes that the statistics are made of; they add up batch by batch."""
    return log.groupBy("repo_id").agg(
        F.count("*").alias("total_sessions"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
        F.sum("total_tokens").alias("tokens"),
    )


def stats_of_totals(totals: DataFrame) -> DataFrame:
    return totals.select(
        "repo_id",
        "total_sessions",
        F.date_format("first_ts", "yyyy-MM-dd").alias("first_date"),
        F.date_format("last_ts", "yyyy-MM-dd").alias("last_date"),
        F.floor(F.col("tokens") / F.col("total_sessions") + 0.5).cast("long").alias("avg_tokens"),
    )


def log_stats(log: DataFrame) -> DataFrame:
    """Entries, first and last date and rounded mean tokens per repository."""
    return stats_of_totals(log_totals(log))


def passive_loads(log: DataFrame, always_include: DataFrame, threshold: int = DEFAULT_THRESHOLD) -> DataFrame:
    """Always-included files loaded at least ``threshold`` times and never modified."""
    return (
        file_activity(log)
        .where((F.col("loads") >= threshold) & F.col("last_modified").isNull())
        .join(always_include.select("repo_id", "path").distinct(), ["repo_id", "path"], "left_semi")
        .select(
            "repo_id",
            "path",
            F.col("loads").alias("session_count"),
            "last_modified",
            F.lit("remove-from-always-include").alias("suggestion"),
        )
    )


def staleness(log: DataFrame, index: DataFrame, threshold: int = DEFAULT_THRESHOLD) -> DataFrame:
    """Indexed files loaded often but never modified, and indexed files never loaded at all."""
    entries = log.groupBy("repo_id").agg(F.count("*").alias("entries"))
    seen = index.join(file_activity(log), ["repo_id", "path"], "left").join(entries, "repo_id", "left")
    loads = F.coalesce("loads", F.lit(0))
    suggestion = F.when(
        (loads >= threshold) & F.col("last_modified").isNull(),
        F.when(F.col("always_include"), "remove-from-always-include").otherwise("remove-from-index"),
    ).when((loads == 0) & (F.coalesce("entries", F.lit(0)) >= threshold), "investigate")
    return seen.select(
        "repo_id", "path", loads.alias("session_count"), suggestion.alias("suggestion")
    ).where(F.col("suggestion").isNotNull())


def recent_entries(log: DataFrame, n: int) -> DataFrame:
    newest = Window.partitionBy("repo_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return log.withColumn("recency", F.row_number().over(newest)).where(F.col("recency") <= n)


def append_new(target: DataFrame, incoming: DataFrame) -> DataFrame:
    """``incoming`` rows whose (session, timestamp) the target lacks, one per key."""
    key = ["repo_id", "session_id", "ts"]
    return incoming.dropDuplicates(key).join(target.select(*key), key, "left_anti")


def retention_cutoff(older_than: str, as_of: Column) -> Column:
    """Cutoff of a retention setting: ``<N>d``, ``<N>mo``, ``<N>y`` back from ``as_of``, or a date."""
    span = re.fullmatch(r"(\d+)(d|mo|y)", older_than.strip())
    if span is None:
        return F.to_timestamp(F.lit(older_than))
    amount = F.lit(int(span.group(1)))
    if span.group(2) == "d":
        return as_of - F.make_dt_interval(days=amount)
    months = amount if span.group(2) == "mo" else amount * 12
    return as_of - F.make_ym_interval(months=months)


def prune(log: DataFrame, older_than: str, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """Entries kept by the retention, and per repository how many were removed."""
    old = F.col("ts") < retention_cutoff(older_than, as_of)
    removed = log.groupBy("repo_id").agg(F.count_if(old).alias("removed"), F.count_if(~old).alias("kept"))
    return log.where(~old), removed


def index_quantile(samples: DataFrame, keys: list[str], value: str, q: float) -> DataFrame:
    """The sample at index ``floor(q * n)`` of the sorted samples, clamped to the last.

    Works on value counts, so a key's samples are never gathered in one place.
    """
    counts = samples.groupBy(*keys, value).agg(F.count("*").alias("n"))
    ranked = running_total_before(counts, keys, [F.col(value)], F.col("n"), F.floor(value), "before")
    totals = counts.groupBy(*keys).agg(F.sum("n").alias("total"))
    at = F.least(F.floor(F.lit(q) * F.col("total")), F.col("total") - 1)
    return (
        ranked.join(totals, keys)
        .where(F.col("before") + F.col("n") > at)
        .groupBy(*keys)
        .agg(F.min(value).alias("quantile"))
    )
