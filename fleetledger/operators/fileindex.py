"""Lookups and merges on file-index entries (``repo_id, path, chunk_tags, purpose``)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def by_chunk(entries: DataFrame, chunk_id) -> DataFrame:
    return entries.where(F.array_contains("chunk_tags", F.lit(chunk_id).cast("decimal(10,3)")))


def always_include(entries: DataFrame) -> DataFrame:
    return by_chunk(entries, 0)


def for_chunk(entries: DataFrame, chunk_id) -> DataFrame:
    """A chunk's entries together with the always-included ones."""
    wanted = F.array(F.lit(0).cast("decimal(10,3)"), F.lit(chunk_id).cast("decimal(10,3)"))
    return entries.where(F.arrays_overlap("chunk_tags", wanted))


def chunk_postings(entries: DataFrame) -> DataFrame:
    """``repo_id, chunk_id, path``: the files of each chunk, 0 being the always-included ones. Built once, written by
    ``sinks.write_relation`` if need be, and met by any number of lookups."""
    return entries.select("repo_id", F.explode(F.array_distinct("chunk_tags")).alias("chunk_id"), "path")


def of_chunks(postings: DataFrame, wanted: DataFrame, with_always: bool = False) -> DataFrame:
    """``repo_id, chunk_id, path`` of the wanted ``repo_id, chunk_id``, each with its repository's always-included files if
    asked for; a path is there once for each chunk."""
    key = ["repo_id", "chunk_id"]
    asked = wanted.select("repo_id", F.col("chunk_id").cast("decimal(10,3)").alias("chunk_id")).distinct()
    if not with_always:
        return postings.join(asked, key, "left_semi").select(*key, "path")
    always = F.lit(0).cast("decimal(10,3)")
    sought = asked.select("repo_id", F.col("chunk_id").alias("for_chunk"), F.explode(F.array_distinct(F.array("chunk_id", always))).alias("chunk_id"))
    return postings.join(sought, key).select("repo_id", F.col("for_chunk").alias("chunk_id"), "path").distinct()


def upsert(entries: DataFrame, incoming: DataFrame, keep_purpose: bool = False) -> DataFrame:
    """Entries with the incoming tags merged in; adding replaces the purpose, tagging keeps it."""
    key = ["repo_id", "path"]
    old = entries.select(*key, F.col("chunk_tags").alias("old_tags"), F.col("purpose").alias("old_purpose"))
    new = incoming.select(*key, F.col("chunk_tags").alias("new_tags"), F.col("purpose").alias("new_purpose"))
    none = F.array().cast("array<decimal(10,3)>")
    tags = F.array_union(F.coalesce("old_tags", none), F.coalesce("new_tags", none))
    first, second = ("old_purpose", "new_purpose") if keep_purpose else ("new_purpose", "old_purpose")
    return old.join(new, key, "full_outer").select(
        *key, F.sort_array(tags).alias("chunk_tags"), F.coalesce(first, second).alias("purpose")
    )
