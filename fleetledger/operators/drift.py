"""Recorded context compared with the files as they are now."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from fleetledger.functions.binding import unnest
from fleetledger.functions.text import content_hash, ratio, slice_lines


def manifest_drift(entries: DataFrame, units_now: DataFrame, files_now: DataFrame) -> DataFrame:
    """Drift of each hashed unit or whole-file entry: ``removed``, ``changed`` or ``moved``."""
    kept = entries.where(F.col("hash").isNotNull() & F.col("granularity").isin("unit", "file")).withColumn(
        "unit_id",
        F.when(F.col("granularity") == "unit", F.substring("ref", F.instr("ref", "#") + 1, F.length("ref"))),
    )
    unit_now = units_now.select(
        "repo_id", "path", "unit_id", F.struct("hash", "start", "end").alias("unit_now")
    )
    file_now = files_now.select("repo_id", "path", F.struct(F.col("hash")).alias("file_now"))
    units = kept.where("granularity = 'unit'").join(unit_now, ["repo_id", "path", "unit_id"], "left").withColumn(
        "drift",
        F.when(F.col("unit_now").isNull(), "removed")
        .when(F.col("unit_now.hash") != F.col("hash"), "changed")
        .when((F.col("unit_now.start") != F.col("start")) | (F.col("unit_now.end") != F.col("end")), "moved"),
    )
    whole = kept.where("granularity = 'file'").join(file_now, ["repo_id", "path"], "left").withColumn(
        "drift",
        F.when(F.col("file_now").isNull(), "removed").when(F.col("file_now.hash") != F.col("hash"), "changed"),
    )
    columns = ["repo_id", "ref", "path", "granularity", "drift"]
    return (
        units.select(*columns)
        .unionByName(whole.select(*columns))
        .where(F.col("drift").isNotNull())
        .withColumn("code", F.when(F.col("drift") == "moved", "MOVED_CONTEXT").otherwise("STALE_CONTEXT"))
    )


def freshness(indexed: DataFrame, files_now: DataFrame) -> DataFrame:
    """``current``, ``stale``, ``removed`` or ``unknown`` for each indexed file.

    Both sides carry ``hash``; only hashes are joined, never text.
    """
    now = files_now.select("repo_id", "path", F.col("hash").alias("hash_now"), F.lit(True).alias("exists"))
    return indexed.join(now, ["repo_id", "path"], "left").select(
        "repo_id",
        "path",
        F.when(F.col("exists").isNull(), "removed")
        .when(F.col("hash").isNull(), "unknown")
        .when(F.col("hash") == F.col("hash_now"), "current")
        .otherwise("stale")
        .alias("freshness"),
    )


def refresh_plan(previous: DataFrame, current: DataFrame) -> DataFrame:
    """What an incremental index refresh does with each path: ``kept``, ``reread``, ``added``, ``dropped``."""
    before = previous.select("repo_id", "path", F.col("hash").alias("hash_before"), F.lit(True).alias("was"))
    after = current.select("repo_id", "path", F.col("hash").alias("hash_now"), F.lit(True).alias("now"))
    return before.join(after, ["repo_id", "path"], "full_outer").select(
        "repo_id",
        "path",
        F.when(F.col("now").isNull(), "dropped")
        .when(F.col("was").isNull(), "added")
        .when(F.col("hash_before").eqNullSafe(F.col("hash_now")), "kept")
        .otherwise("reread")
        .alias("action"),
    )


def merge_index(previous: DataFrame, updated: DataFrame, present: DataFrame) -> DataFrame:
    """Updated rows win, untouched rows stay while their file is present."""
    key = ["repo_id", "path"]
    kept = previous.join(updated.select(*key), key, "left_anti").join(present.select(*key), key, "left_semi")
    return updated.unionByName(kept)


def stale_entries(entries: DataFrame, files_now: DataFrame) -> DataFrame:
    return entries.join(files_now.select("repo_id", "path"), ["repo_id", "path"], "left_anti")


def missing_chunk_files(entries: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunk tags, 0 aside, that no plan chunk carries."""
    tags = entries.select("repo_id", F.explode("chunk_tags").alias("chunk_id")).where("chunk_id <> 0").distinct()
    return tags.join(chunks.select("repo_id", "chunk_id"), ["repo_id", "chunk_id"], "left_anti")


def hash_fidelity(units: DataFrame, files_now: DataFrame) -> DataFrame:
    """Units whose recorded hash does not equal the hash of their line range now.

    Units are gathered per file, which the file itself bounds, so each text is shuffled once.
    """
    listed = units.groupBy("repo_id", "path").agg(
        F.collect_list(F.struct("unit_id", "start", "end", "hash")).alias("units")
    )
    joined = listed.join(files_now.select("repo_id", "path", "text"), ["repo_id", "path"], "left")
    rows = unnest(joined, ["repo_id", "path", "text"], F.col("units"))
    now = content_hash(slice_lines(F.col("text"), F.col("start"), F.col("end")))
    return rows.where(now.isNull() | (now != F.col("hash"))).select("repo_id", "path", "unit_id")


def reduction(entries: DataFrame, keys: list[str]) -> DataFrame:
    """Unit tokens over the tokens of the files they stand for, and the same for the whole manifest.

    In the manifest's total each path counts once, with the value of its last entry.
    """
    per_path = entries.groupBy(*keys, "path").agg(
        F.sum("tokens").alias("tokens"),
        F.max_by("file_tokens", "entry_no").alias("file_tokens"),
        F.sum(F.when(F.col("granularity") == "unit", F.col("tokens"))).alias("unit_tokens"),
        F.sum(F.when(F.col("granularity") == "unit", F.col("file_tokens"))).alias("unit_file_tokens"),
    )
    summed = per_path.groupBy(*keys).agg(
        F.sum("tokens").alias("tokens"),
        F.sum("file_tokens").alias("file_tokens"),
        F.coalesce(F.sum("unit_tokens"), F.lit(0)).alias("unit_tokens"),
        F.coalesce(F.sum("unit_file_tokens"), F.lit(0)).alias("unit_file_tokens"),
    )
    return summed.withColumn("unit_ratio", ratio(F.col("unit_tokens"), F.col("unit_file_tokens"))).withColumn(
        "manifest_ratio", ratio(F.col("tokens"), F.col("file_tokens"))
    )
