"""Secret patterns, redaction and the write guard's verdict."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Built-in patterns, as (name, expression). None crosses the end of a line, so that scans by line and by text
# find the same.
PATTERNS: tuple[tuple[str, str], ...] = (
    ("AWS Access Key", r"\bAKIA[0-9A-Z]{16}\b"),
    ("AWS Secret Key", r"(?i)\baws_secret_access_key[ \t]*[=:][ \t]*[A-Za-z0-9/+=]{40}"),
    ("GitHub PAT (classic)", r"\bghp_[A-Za-z0-9]{36}\b"),
    ("GitHub PAT (fine-grained)", r"\bgithub_pat_[A-Za-z0-9_]{22,}\b"),
    ("GitHub OAuth Token", r"\bgho_[A-Za-z0-9]{36}\b"),
    ("npm Token", r"\bnpm_[A-Za-z0-9]{36}\b"),
    ("Model Provider Key", r"\bsk-[A-Za-z0-9_-]{20,}"),
    ("Private Key Header", r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----"),
    ("Generic API Key", r"(?i)\bapi[_-]?key[ \t]*[=:][ \t]*['\x22]?[A-Za-z0-9_-]{16,}"),
    ("Generic Secret", r"(?i)\b(?:secret|token|password)[ \t]*[=:][ \t]*['\x22]?[A-Za-z0-9_-]{16,}"),
)
VISIBLE_CHARS = 4
DEFAULT_BYPASS = "<!-- secrets:allow -->"


def mask(secret: Column) -> Column:
    """First four characters, the rest as asterisks."""
    hidden = F.greatest(F.length(secret) - VISIBLE_CHARS, F.lit(0))
    return F.concat(F.substring(secret, 1, VISIBLE_CHARS), F.repeat(F.lit("*"), hidden))


def findings(text: Column, patterns=PATTERNS) -> Column:
    """``array<struct<pattern, secret>>`` of every match in a text, pattern by pattern."""

    def named(name: str, expression: str) -> Column:
        found = F.regexp_extract_all(text, F.lit(f"({expression})"), 1)
        return F.transform(found, lambda s: F.struct(F.lit(name).alias("pattern"), s.alias("secret")))

    return F.concat(*[named(name, expression) for name, expression in patterns])


def _any_of(patterns) -> str:
    return "|".join(f"(?:{expression})" for _, expression in patterns)


def any_secret(text: Column, patterns=PATTERNS) -> Column:
    """A cheap test, one pass over the text, that lets texts without secrets skip the extraction."""
    return text.rlike(_any_of(patterns))


def patterns_hit(text: Column, patterns=PATTERNS) -> Column:
    return F.array_compact(F.array(*[F.when(text.rlike(e), F.lit(name)) for name, e in patterns]))


def redact(text: Column, patterns=PATTERNS) -> Column:
    """The text with every secret's tail replaced by asterisks of the same length."""
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(f"({_any_of(patterns)})"), 1))
    return F.aggregate(found, text, lambda clean, secret: F.replace(clean, secret, mask(secret)))
