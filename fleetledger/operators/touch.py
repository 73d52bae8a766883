"""Which touched files earn an index tag, and for which chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from fleetledger.functions.paths import is_always_ignored, is_lockfile, is_path_shaped

MAX_TOUCH_TAGS = 20


def touched(committed: DataFrame, status: DataFrame, base_dirty: DataFrame, files_now: DataFrame) -> DataFrame:
    """Touched paths with the hash they have now, ``unchanged`` when equal to the one at the session's base.

    ``status`` has ``repo_id, path, code``; deletions are left out. ``files_now`` has
    ``repo_id, path, hash, change``.
    """
    key = ["repo_id", "path"]
    paths = committed.select(*key).union(status.where(~F.col("code").contains("D")).select(*key)).distinct()
    at_base = base_dirty.select(*key, F.col("hash").alias("base_hash"), F.lit(True).alias("in_base"))
    now = files_now.select(*key, F.col("hash").alias("hash_now"), "change", F.lit(True).alias("on_disk"))
    joined = paths.join(at_base, key, "left").join(now, key, "left")
    same = F.coalesce("in_base", F.lit(False)) & F.coalesce(F.col("base_hash") == F.col("hash_now"), F.lit(False))
    return joined.select(
        *key,
        same.alias("unchanged"),
        F.coalesce("on_disk", F.lit(False)).alias("exists"),
        F.coalesce("change", F.lit("blank")).alias("change"),
    )


def skip_reasons(candidates: DataFrame, excluded: DataFrame) -> DataFrame:
    """The first reason not to tag each candidate; null for survivors.

    ``candidates`` has ``repo_id, path, unchanged, exists, change, generated``.
    """
    key = ["repo_id", "path"]
    marked = candidates.join(excluded.select(*key, F.lit(True).alias("is_excluded")).distinct(), key, "left")
    path = F.col("path")
    reason = (
        F.when(F.col("unchanged"), "unchanged-since-base")
        .when(~F.col("exists") | is_always_ignored(path) | F.coalesce("is_excluded", F.lit(False)), "excluded-path")
        .when(~is_path_shaped(path), "unsafe-path")
        .when(is_lockfile(path), "lockfile")
        .when((F.col("change") == "binary") | F.col("generated"), "binary-or-generated")
        .when(F.col("change") == "blank", "whitespace-only")
    )
    return marked.withColumn("reason", reason).drop("is_excluded")


def skip_counts(reasons: DataFrame) -> DataFrame:
    return reasons.where("reason IS NOT NULL").groupBy("repo_id", "reason").agg(F.count("*").alias("n"))


def gated(reasons: DataFrame, finished: DataFrame, limit: int = MAX_TOUCH_TAGS) -> DataFrame:
    """Survivors, turned into ``too-many`` or ``chunk-done`` for repositories over the limit or finished.

    ``finished`` lists repositories whose active chunk is complete.
    """
    survivors = reasons.groupBy("repo_id").agg(F.count_if(F.col("reason").isNull()).alias("survivors"))
    done = finished.select("repo_id", F.lit(True).alias("is_done")).distinct()
    joined = reasons.join(survivors, "repo_id").join(done, "repo_id", "left")
    gate = F.when(F.col("survivors") > limit, "too-many").when(F.col("is_done"), "chunk-done")
    return joined.withColumn("reason", F.coalesce("reason", gate)).drop("survivors", "is_done")


def chunk_tags(survivors: DataFrame, active: DataFrame, references: DataFrame) -> DataFrame:
    """A tag per (surviving file, chunk): the active chunk first, then open chunks that name the file."""
    first = survivors.join(active, "repo_id").select(
        "repo_id", "path", F.col("active_chunk").alias("chunk_id"), F.lit(0).alias("rank")
    )
    named = (
        survivors.select("repo_id", "path")
        .join(references, ["repo_id", "path"])
        .join(active, "repo_id")
        .where(F.col("chunk_id") != F.col("active_chunk"))
        .select("repo_id", "path", "chunk_id", F.lit(1).alias("rank"))
    )
    return first.unionByName(named)
