"""Replay scoring: what each prompt declared against what the following session changed."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from fleetledger.functions.binding import unnest
from fleetledger.functions.paths import is_scorable
from fleetledger.functions.refs import declared_files
from fleetledger.functions.text import ratio
from fleetledger.operators.ordered import carry_last, next_value

# Commits of one repository handled by one task of an ordered window.
COMMITS_PER_BUCKET = 50_000


def _bucket():
    return F.floor(F.col("ordinal") / COMMITS_PER_BUCKET)


def boundary_intervals(commits: DataFrame) -> DataFrame:
    """Each boundary with the boundary that superseded it; the newest runs to HEAD (null)."""
    found = commits.where("is_boundary").select("repo_id", "ordinal", "sha")
    paired = next_value(
        found, ["repo_id"], [F.col("ordinal")], F.struct("ordinal", "sha"), _bucket(), "following"
    )
    return paired.select(
        "repo_id",
        "ordinal",
        "sha",
        F.col("following.ordinal").alias("next_ordinal"),
        F.col("following.sha").alias("next_sha"),
    )


def newest_boundaries(commits: DataFrame, limit: int = 10) -> DataFrame:
    """The ``limit`` newest boundaries of each repository, newest first."""
    newest = Window.partitionBy("repo_id").orderBy(F.desc("ordinal"))
    return (
        commits.where("is_boundary")
        .select("repo_id", "ordinal", "sha")
        .withColumn("recency", F.row_number().over(newest))
        .where(F.col("recency") <= limit)
    )


def prompt_declarations(commits: DataFrame, prompts: DataFrame) -> DataFrame:
    """``repo_id, boundary, path``: scorable paths each boundary's prompt declares."""
    written = commits.where("is_boundary").select("repo_id", "sha", F.col("ordinal").alias("boundary"))
    declared = unnest(
        written.join(prompts, ["repo_id", "sha"]),
        ["repo_id", "boundary"],
        declared_files(F.col("text")),
        ["path"],
    )
    return declared.where(is_scorable(F.col("path")))


def net_changes(commits: DataFrame, changes: DataFrame) -> DataFrame:
    """``repo_id, boundary, path``: paths whose blob differs between a boundary and the next one.

    A file changed and changed back inside the interval is not a change. Work before the first
    boundary only sets the starting state.
    """
    marks = commits.where("is_boundary").select(
        "repo_id", "ordinal", F.lit(None).cast("string").alias("path"), F.lit(None).cast("string").alias("blob")
    )
    timeline = marks.withColumn("mark", F.col("ordinal")).unionByName(
        changes.select("repo_id", "ordinal", "path", "blob").withColumn("mark", F.lit(None).cast("long"))
    )
    placed = carry_last(timeline, ["repo_id"], [F.col("ordinal")], F.col("mark"), _bucket(), "boundary")
    left_behind = (
        placed.where(F.col("path").isNotNull())
        .groupBy("repo_id", "path", "boundary")
        .agg(F.max_by("blob", "ordinal").alias("blob"))
    )
    # One row per interval a path was written in: small even for the busiest file.
    history = Window.partitionBy("repo_id", "path").orderBy(F.asc_nulls_first("boundary"))
    return (
        left_behind.withColumn("blob_before", F.lag("blob").over(history))
        .where(F.col("boundary").isNotNull() & ~F.col("blob").eqNullSafe(F.col("blob_before")))
        .select("repo_id", "boundary", "path")
    )


def replay_outcomes(commits: DataFrame, prompts: DataFrame, changes: DataFrame) -> DataFrame:
    """One row per (boundary, path): ``hit``, ``missed`` or ``unused``."""
    declared = prompt_declarations(commits, prompts).withColumn("is_declared", F.lit(True))
    touched = (
        net_changes(commits, changes).where(is_scorable(F.col("path"))).withColumn("is_declared", F.lit(False))
    )
    return (
        declared.unionByName(touched)
        .groupBy("repo_id", "boundary", "path")
        .agg(F.bool_or("is_declared").alias("is_declared"), F.bool_or(~F.col("is_declared")).alias("is_touched"))
        .withColumn(
            "outcome",
            F.when(F.col("is_declared") & F.col("is_touched"), "hit")
            .when(F.col("is_touched"), "missed")
            .otherwise("unused"),
        )
    )


def replay_scores(commits: DataFrame, prompts: DataFrame, changes: DataFrame) -> DataFrame:
    """Counts, precision and recall of every boundary that has a prompt."""
    outcomes = replay_outcomes(commits, prompts, changes)
    with_prompt = commits.where("is_boundary").join(prompts.select("repo_id", "sha"), ["repo_id", "sha"])
    empty = with_prompt.select(
        "repo_id", F.col("ordinal").alias("boundary"), F.lit(None).cast("string").alias("outcome"), "sha"
    )
    counted = (
        outcomes.select("repo_id", "boundary", "outcome", F.lit(None).cast("string").alias("sha"))
        .unionByName(empty)
        .groupBy("repo_id", "boundary")
        .agg(
            F.max("sha").alias("sha"),
            F.count_if(F.col("outcome").isin("hit", "unused")).alias("declared"),
            F.count_if(F.col("outcome").isin("hit", "missed")).alias("touched"),
            F.count_if(F.col("outcome") == "hit").alias("hits"),
            F.count_if(F.col("outcome") == "missed").alias("missed"),
            F.count_if(F.col("outcome") == "unused").alias("unused"),
        )
        .where(F.col("sha").isNotNull())
    )
    return counted.withColumn("precision", ratio(F.col("hits"), F.col("declared"))).withColumn(
        "recall", ratio(F.col("hits"), F.col("touched"))
    )


def replay_report(scores: DataFrame, commits: DataFrame) -> DataFrame:
    """Per repository: mean precision and recall over the boundaries that have one, and the waste ratio."""
    found = commits.groupBy("repo_id").agg(F.count_if("is_boundary").alias("boundaries_found"))
    summed = scores.groupBy("repo_id").agg(
        F.avg("precision").alias("mean_precision"),
        F.avg("recall").alias("mean_recall"),
        ratio(F.sum("unused"), F.sum("declared")).alias("waste_ratio"),
        F.count("*").alias("boundaries_scored"),
    )
    return (
        found.join(summed, "repo_id", "left")
        .withColumn("boundaries_scored", F.coalesce("boundaries_scored", F.lit(0)))
        .withColumn(
            "unavailable_reason",
            F.when(F.col("boundaries_found") == 0, F.lit("no prompt is tracked in this repository's history")),
        )
    )
