"""Claims of a session checked against what history and the working tree show."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

SEVERITIES = ("error", "warning", "info")


def top_paths(paths: DataFrame, keys: list[str], shown: int = 5) -> DataFrame:
    """``a, b, +N more`` per key: at most ``shown`` paths of a key are ever gathered."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("path"))
    first = paths.withColumn("rank", rank).where(F.col("rank") <= shown)
    listed = first.groupBy(*keys).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "path"))), lambda p: p["path"]), ", ").alias("shown")
    )
    counted = paths.groupBy(*keys).agg(F.count("*").alias("n"))
    more = F.when(F.col("n") > shown, F.concat(F.lit(", +"), (F.col("n") - shown).cast("string"), F.lit(" more")))
    return counted.join(listed, keys).select(
        *keys, "n", F.concat("shown", F.coalesce(more, F.lit(""))).alias("listed")
    )


def recent_changes(changes: DataFrame, commits: DataFrame, lookback: int = 20) -> DataFrame:
    """Distinct paths written by the ``lookback`` newest commits of each repository."""
    newest = Window.partitionBy("repo_id").orderBy(F.desc("ordinal"))
    recent = (
        commits.select("repo_id", "ordinal")
        .withColumn("recency", F.row_number().over(newest))
        .where(F.col("recency") <= lookback)
        .groupBy("repo_id")
        .agg(F.min("ordinal").alias("oldest"))
    )
    return (
        changes.join(recent, "repo_id")
        .where(F.col("ordinal") >= F.col("oldest"))
        .select("repo_id", "path")
        .distinct()
    )


def evidence(dirty: DataFrame, recent: DataFrame) -> DataFrame:
    return dirty.select("repo_id", "path").union(recent.select("repo_id", "path")).distinct()


def unbacked_files(claimed: DataFrame, evidenced: DataFrame) -> DataFrame:
    """Claimed worked files with neither a commit nor a working-tree change behind them."""
    return claimed.select("repo_id", "path").distinct().join(evidenced, ["repo_id", "path"], "left_anti")


def unindexed_changes(dirty: DataFrame, index: DataFrame) -> DataFrame:
    """Changed files the index has never heard of; dot-paths are excused."""
    candidates = dirty.select("repo_id", "path").distinct().where(~F.col("path").startswith("."))
    return candidates.join(index.select("repo_id", "path"), ["repo_id", "path"], "left_anti")


def done_without_evidence(done: DataFrame, evidenced: DataFrame) -> DataFrame:
    """Repositories with done tasks and no evidence at all. ``done`` has ``repo_id, done``."""
    return done.where("done > 0").join(evidenced.select("repo_id").distinct(), "repo_id", "left_anti")


def uncommitted_session(dirty: DataFrame) -> DataFrame:
    return dirty.where(F.col("path").startswith(".session/")).select("repo_id", "path").distinct()


def finding(rows: DataFrame, severity: str, code: str, fixable: bool = False) -> DataFrame:
    """``repo_id, message`` rows in the shared findings schema."""
    return rows.select(
        "repo_id",
        F.lit(severity).alias("severity"),
        F.lit(code).alias("code"),
        "message",
        F.lit(fixable).alias("fixable"),
    )


def verify_findings(
    claimed: DataFrame, dirty: DataFrame, recent: DataFrame, index: DataFrame, done: DataFrame
) -> DataFrame:
    """All history-backed checks of a session, one row per repository and failed check."""
    seen = evidence(dirty, recent)

    def listing(paths: DataFrame, text: str) -> DataFrame:
        summed = top_paths(paths, ["repo_id"])
        return summed.withColumn("message", F.concat(F.col("n").cast("string"), F.lit(text), "listed"))

    unbacked = listing(
        unbacked_files(claimed, seen), " last worked files have no commit or working-tree change behind them: "
    )
    unindexed = listing(unindexed_changes(dirty, index), " modified files are absent from the file index: ")
    empty = done_without_evidence(done, seen).withColumn(
        "message", F.concat(F.col("done").cast("string"), F.lit(" tasks are marked done without any change behind them"))
    )
    session = listing(uncommitted_session(dirty), " session files have uncommitted changes: ")
    return (
        finding(unbacked, "warning", "UNBACKED_WORKED_FILE")
        .unionByName(finding(unindexed, "warning", "UNINDEXED_CHANGE"))
        .unionByName(finding(empty, "error", "DONE_WITHOUT_EVIDENCE"))
        .unionByName(finding(session, "info", "UNCOMMITTED_SESSION"))
    )


def severity_tally(findings: DataFrame) -> DataFrame:
    """Counts per severity and whether a repository is healthy: no error and no warning."""
    counted = findings.groupBy("repo_id").agg(
        *[F.count_if(F.col("severity") == s).alias(f"{s}s") for s in SEVERITIES]
    )
    return counted.withColumn("healthy", (F.col("errors") == 0) & (F.col("warnings") == 0))


def committed_by(commits: DataFrame, changes: DataFrame, base: DataFrame, email: str) -> DataFrame:
    """Files an author committed after each repository's base, merges left out."""
    mine = (
        commits.join(base, "repo_id", "left")
        .where(
            (F.col("ordinal") > F.coalesce("base_ordinal", F.lit(-1)))
            & ~F.col("is_merge")
            & (F.lower("author_email") == email.lower())
        )
        .select("repo_id", "ordinal")
    )
    return changes.join(mine, ["repo_id", "ordinal"], "left_semi").select("repo_id", "path").distinct()
