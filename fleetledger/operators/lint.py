"""Lint rules over context files. ``files`` has ``repo_id, path, text``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fleetledger.functions.binding import let, unnest
from fleetledger.functions.paths import normalize_path
from fleetledger.functions.refs import AT_MENTION
from fleetledger.functions.text import lines_of, normalize_line

BLOCK_LINES = 3
MIN_BLOCK_CHARS = 30
# Join keys the files of one block are spread over when they meet its summary.
SALTS = 16
# Hedging patterns in priority order, with the advice each one gets.
SOFT_LANGUAGE = (
    (r"(?i)\bmaybe\b", 'Replace "maybe" with a definitive statement or remove'),
    (r"(?i)\bpossibly\b", 'Replace "possibly" with a definitive statement or remove'),
    (r"(?i)\bperhaps\b", 'Replace "perhaps" with a definitive statement or remove'),
    (r"(?i)\byou (?:might|could|should) (?:want to|try to|consider)\b", "Use imperative form instead"),
    (r"(?i)\bconsider (?:using|adding|trying)\b", "Use imperative form instead"),
    (r"(?i)\bmight be (?:a good idea|worth)\b", "Use imperative form instead"),
    (r"(?i)\bif (?:you want|needed)\b", "Use definitive requirement language"),
    (r"(?i)\boptionally\b", 'Replace "optionally" with explicit conditionality'),
)


def _shingles(text: Column) -> Column:
    lines = F.filter(F.transform(lines_of(text), normalize_line), lambda l: l != "")

    def blocks(kept: Column) -> Column:
        starts = F.when(
            F.size(kept) >= BLOCK_LINES, F.sequence(F.lit(0), F.size(kept) - BLOCK_LINES)
        ).otherwise(F.array().cast("array<int>"))
        return F.transform(
            starts, lambda i: F.concat_ws("\n", F.get(kept, i), F.get(kept, i + 1), F.get(kept, i + 2))
        )

    return let(lines, blocks)


def shingles(files: DataFrame) -> DataFrame:
    """``repo_id, path, pos, block``: every run of three non-blank normalized lines."""
    return unnest(files, ["repo_id", "path"], _shingles(F.col("text")), ["pos", "block"])


def duplicate_blocks(files: DataFrame) -> DataFrame:
    """Every file that shares a block with another, next to the block's first file.

    One row per (block, further file) rather than one per pair of files: the group of a block shared by
    n files is n - 1 rows, and any pair is two rows of the same ``block_id``. Blocks equal in their first
    40 characters are told apart by ``block_id``; ``preview`` is the block's first line, cut for display.
    """
    long_enough = shingles(files).where(F.length("block") >= MIN_BLOCK_CHARS)
    held = long_enough.select("repo_id", "path", F.sha2("block", 256).alias("block_id"), _preview().alias("preview"))
    held = held.groupBy("repo_id", "block_id", "path").agg(F.first("preview").alias("preview"))
    shared = (
        held.groupBy("repo_id", "block_id")
        .agg(F.min("path").alias("first_path"), F.count("*").alias("files"))
        .where("files > 1")
    )
    # A block may sit in very many files: its summary is replicated over salts, its files spread over them.
    summaries = shared.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    spread = held.withColumn("salt", F.pmod(F.xxhash64("path"), F.lit(SALTS)).cast("int"))
    return (
        spread.join(summaries, ["repo_id", "block_id", "salt"])
        .where(F.col("path") != F.col("first_path"))
        .select("repo_id", "block_id", "first_path", "path", "files", "preview")
    )


def _preview() -> Column:
    first_line = F.substring_index("block", "\n", 1)
    return F.when(F.length(first_line) > 60, F.concat(F.substring(first_line, 1, 60), F.lit("…"))).otherwise(
        first_line
    )


def file_lines(files: DataFrame) -> DataFrame:
    """``repo_id, path, line, content`` with 1-based line numbers."""
    rows = unnest(files, ["repo_id", "path"], lines_of(F.col("text")), ["pos", "content"])
    return rows.select("repo_id", "path", (F.col("pos") + 1).alias("line"), "content")


def soft_language(files: DataFrame) -> DataFrame:
    """The first hedging pattern, in priority order, of each line that has one."""
    found = F.when(F.lit(False), F.lit(None).cast("string"))
    advice = F.when(F.lit(False), F.lit(None).cast("string"))
    for pattern, suggestion in SOFT_LANGUAGE:
        found = found.when(F.col("content").rlike(pattern), F.regexp_extract("content", pattern, 0))
        advice = advice.when(F.col("content").rlike(pattern), F.lit(suggestion))
    any_pattern = "|".join(pattern for pattern, _ in SOFT_LANGUAGE)
    return (
        file_lines(files)
        .where(F.col("content").rlike(any_pattern))
        .select("repo_id", "path", "line", found.alias("phrase"), advice.alias("suggestion"))
    )


def at_mentions(files: DataFrame) -> DataFrame:
    """``repo_id, path, line, mention``: every ``@path.ext`` in the text, repeats kept."""
    lines = file_lines(files).where(F.col("content").contains("@"))
    return unnest(
        lines, ["repo_id", "path", "line"], F.regexp_extract_all("content", F.lit(AT_MENTION), 1), ["mention"]
    )


def dead_references(files: DataFrame, inventory: DataFrame) -> DataFrame:
    """Mentions of paths that no file or directory of the repository has."""
    existing = inventory.select("repo_id", F.col("path").alias("target")).distinct()
    named = at_mentions(files).withColumn("target", normalize_path(F.col("mention")))
    return named.join(existing, ["repo_id", "target"], "left_anti").drop("target")
