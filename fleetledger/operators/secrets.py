"""Secret scans of text tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from fleetledger.functions import secrets as sc
from fleetledger.functions.binding import unnest
from fleetledger.operators.lint import file_lines


def secret_findings(files: DataFrame, patterns=sc.PATTERNS) -> DataFrame:
    """``repo_id, path, line, pattern, redacted``: every secret of every line."""
    whole = files.where(sc.any_secret(F.col("text"), patterns))
    suspicious = file_lines(whole).where(sc.any_secret(F.col("content"), patterns))
    found = unnest(suspicious, ["repo_id", "path", "line"], sc.findings(F.col("content"), patterns))
    return found.select("repo_id", "path", "line", "pattern", sc.mask(F.col("secret")).alias("redacted"))


def redacted(files: DataFrame, patterns=sc.PATTERNS) -> DataFrame:
    """Files with their secrets masked and the patterns that were hit."""
    return files.withColumn("patterns", sc.patterns_hit(F.col("text"), patterns)).withColumn(
        "text", sc.redact(F.col("text"), patterns)
    )


def guard_verdicts(
    files: DataFrame, strict: bool = False, bypass: str = sc.DEFAULT_BYPASS, patterns=sc.PATTERNS
) -> DataFrame:
    """Whether each text may be written. A bypass marker skips the scan; strict mode blocks any hit."""
    counts = F.size(sc.findings(F.col("text"), patterns))
    bypassed = F.col("text").contains(bypass)
    hits = F.when(~bypassed & sc.any_secret(F.col("text"), patterns), counts).otherwise(0)
    return files.withColumn("bypassed", bypassed).withColumn("hits", hits).withColumn(
        "allowed", F.col("bypassed") | (F.col("hits") == 0) | F.lit(not strict)
    )


def guard_summary(findings: DataFrame, keys: list[str]) -> DataFrame:
    """``n secrets detected (patterns)`` per key, patterns in order of first appearance.

    At most one entry per pattern is gathered for a key.
    """
    per_pattern = findings.groupBy(*keys, "pattern").agg(F.count("*").alias("n"), F.min("line").alias("first_line"))
    ordered = F.array_sort(F.collect_list(F.struct("first_line", "pattern")))
    listed = F.array_join(F.transform(ordered, lambda p: p["pattern"]), ", ")
    return per_pattern.groupBy(*keys).agg(F.sum("n").alias("secrets"), listed.alias("patterns")).select(
        *keys,
        "secrets",
        F.concat(
            F.col("secrets").cast("string"),
            F.when(F.col("secrets") == 1, " secret").otherwise(" secrets"),
            F.lit(" detected ("),
            "patterns",
            F.lit(")"),
        ).alias("summary"),
    )
