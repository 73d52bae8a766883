"""The health audit: each rule a DataFrame of findings, unioned and tallied per repository."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from fleetledger.operators.evidence import finding

MAX_INDEX_ENTRIES = 500
MAX_ALWAYS_INCLUDE = 4
STALE_DAYS = 7
MAX_PROMPT_CHARS = 12_000


def _say(rows: DataFrame, *parts) -> DataFrame:
    return rows.withColumn("message", F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts]))


def invalid_sources(rows: DataFrame, code: str, what: str) -> DataFrame:
    """An error per repository whose state or index could not be read; ``rows`` has ``repo_id, error``, null where all
    is well."""
    broken = rows.where("error IS NOT NULL").select("repo_id").distinct()
    return finding(_say(broken, f"{what} is unreadable or malformed"), "error", code)


def missing_plans(states: DataFrame, chunks: DataFrame) -> DataFrame:
    wanted = states.select("repo_id", F.col("active_chunk").alias("chunk_id"))
    gone = wanted.join(chunks.select("repo_id", "chunk_id"), ["repo_id", "chunk_id"], "left_anti")
    text = F.col("chunk_id").cast("string")
    return finding(_say(gone, "active chunk ", text, " has no plan file"), "error", "PLAN_MISSING")


def stale_entries(stale: DataFrame) -> DataFrame:
    counted = stale.groupBy("repo_id").agg(F.count("*").cast("string").alias("n"))
    return finding(
        _say(counted, F.col("n"), " index entries point to files that no longer exist"), "warning", "STALE_INDEX_ENTRIES", True
    )


def missing_chunk_files(missing: DataFrame) -> DataFrame:
    counted = missing.groupBy("repo_id").agg(F.count("*").cast("string").alias("n"))
    return finding(_say(counted, F.col("n"), " tagged chunks have no plan file"), "warning", "MISSING_CHUNK_FILES")


def index_size(entries: DataFrame) -> DataFrame:
    """Large indexes and overlong always-include lists, from one aggregation."""
    counted = entries.groupBy("repo_id").agg(F.count("*").alias("n"), F.count_if("always_include").alias("always"))
    large = counted.where(F.col("n") > MAX_INDEX_ENTRIES)
    creeping = counted.where(F.col("always") > MAX_ALWAYS_INCLUDE)
    return finding(
        _say(large, "index has ", F.col("n").cast("string"), " entries"), "info", "FILE_INDEX_LARGE"
    ).unionByName(
        finding(
            _say(creeping, "always-include list has ", F.col("always").cast("string"), " files"),
            "warning",
            "ALWAYS_INCLUDE_CREEP",
        )
    )


def over_budget(budgets: DataFrame, cap: int) -> DataFrame:
    over = budgets.where("over_budget")
    text = F.col("capped_tokens").cast("string")
    return finding(_say(over, "context budget exceeded: ~", text, f" / {cap} tokens"), "warning", "BUDGET_EXCEEDED")


def finished_chunks(active: DataFrame, complete: DataFrame) -> DataFrame:
    """``active`` has ``repo_id, chunk_id``; ``complete`` lists finished chunks."""
    done = active.join(complete.select("chunk_id"), "chunk_id", "left_semi")
    return finding(_say(done, "all tasks in the active chunk are done"), "info", "ALL_TASKS_DONE")


def prompt_sizes(repos: DataFrame, sizes: DataFrame) -> DataFrame:
    """Missing and overlong prompts. ``repos`` has ``repo_id, max_lines``; ``sizes`` has ``repo_id, lines, chars``."""
    joined = repos.join(sizes, "repo_id", "left")
    missing = finding(_say(joined.where("lines IS NULL"), "the prompt does not exist"), "warning", "PROMPT_MISSING")
    lines = joined.where("lines > max_lines")
    chars = joined.where(F.col("chars") > MAX_PROMPT_CHARS)
    return (
        missing.unionByName(finding(_say(lines, "prompt has ", F.col("lines").cast("string"), " lines"), "warning", "PROMPT_TOO_LONG"))
        .unionByName(finding(_say(chars, "prompt has ", F.col("chars").cast("string"), " characters"), "warning", "PROMPT_TOO_LONG"))
    )


def days_since(updated, as_of):
    """Whole days from an update to ``as_of``; null for an unreadable date, which skips the check."""
    seconds = F.unix_timestamp(as_of) - F.unix_timestamp(updated)
    return F.floor(seconds / 86_400).cast("long")


def stale_sessions(states: DataFrame, as_of) -> DataFrame:
    aged = states.withColumn("days", days_since(F.col("last_updated"), as_of)).where(F.col("days") > STALE_DAYS)
    return finding(_say(aged, "session not updated in ", F.col("days").cast("string"), " days"), "info", "SESSION_STALE")


def stale_code_index(freshness: DataFrame) -> DataFrame:
    behind = freshness.where(F.col("freshness").isin("stale", "removed")).groupBy("repo_id").agg(
        F.count("*").cast("string").alias("n")
    )
    return finding(_say(behind, "code index is behind ", F.col("n"), " files"), "warning", "AI_INDEX_STALE")


#: Rules that need a readable file index.
INDEX_CODES = (
    "STALE_INDEX_ENTRIES",
    "MISSING_CHUNK_FILES",
    "FILE_INDEX_LARGE",
    "ALWAYS_INCLUDE_CREEP",
    "BUDGET_EXCEEDED",
    "ALL_TASKS_DONE",
)


def deciding(code: str) -> set[str]:
    """The codes whose findings decide which findings of ``code`` an audit keeps, its own included: an audit of these
    rules alone has the same findings of it."""
    return {code, "SESSION_STATE_INVALID"} | ({"FILE_INDEX_INVALID"} if code in INDEX_CODES else set())


def audit(*rules: DataFrame) -> DataFrame:
    """All findings. A repository whose session state is unreadable keeps only that finding; one whose file index is
    invalid keeps no finding that the index would have been needed for."""
    every = reduce(DataFrame.unionByName, rules)
    repository = Window.partitionBy("repo_id")  # a few findings each
    only = F.max(F.when(F.col("code") == "SESSION_STATE_INVALID", F.col("code"))).over(repository)
    unindexed = F.max(F.col("code") == "FILE_INDEX_INVALID").over(repository)
    marked = every.withColumn("__only", only).withColumn("__unindexed", unindexed)
    alone = F.col("__only").isNull() | (F.col("code") == F.col("__only"))
    return marked.where(alone & ~(F.col("__unindexed") & F.col("code").isin(*INDEX_CODES))).drop("__only", "__unindexed")
