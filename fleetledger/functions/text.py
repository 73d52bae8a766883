"""Token estimates, hashes, trims and predicates on whole texts (column in, column out)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed value: the characters ECMAScript's String.trim removes.
WHITESPACE = r"\s\x0B\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
WHITESPACE_CHARS = " \t\n\x0b\x0c\r\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + (
    "\u2028\u2029\u202f\u205f\u3000\ufeff"
)
BYTES_PER_TOKEN = 4
HASH_HEX_CHARS = 16
BINARY_PROBE_BYTES = 8000


def token_estimate(text: Column) -> Column:
    """Tokens of a text: UTF-8 bytes over four, rounded up."""
    return F.ceil(F.octet_length(text) / BYTES_PER_TOKEN).cast("long")


def token_estimate_from_size(size_bytes: Column) -> Column:
    return F.ceil(size_bytes / BYTES_PER_TOKEN).cast("long")


def content_hash(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, HASH_HEX_CHARS)


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def slice_lines(text: Column, start: Column, end: Column) -> Column:
    """Lines ``start``..``end`` (1-based, inclusive) of a text, clipped to its length."""
    return F.array_join(F.slice(lines_of(text), start, F.greatest(end - start + 1, F.lit(0))), "\n")


def trim(text: Column) -> Column:
    """Trim all Unicode whitespace, not only spaces."""
    return F.btrim(text, F.lit(WHITESPACE_CHARS))


def trim_end(text: Column) -> Column:
    return F.rtrim(text, F.lit(WHITESPACE_CHARS))


def normalize_line(line: Column) -> Column:
    """Form in which lines are compared for duplication."""
    return F.lower(trim(line))


def has_control_char(text: Column) -> Column:
    return text.rlike(r"[\x00-\x1f\x7f]")


def content_kind(text: Column) -> Column:
    """``binary`` on a NUL in the probed bytes, ``blank`` on whitespace only, else ``changed``."""
    probe = F.decode(F.substring(F.encode(text, "UTF-8"), 1, BINARY_PROBE_BYTES), "ISO-8859-1")
    return (
        F.when(probe.contains("\x00"), "binary")
        .when(F.length(trim(text)) == 0, "blank")
        .otherwise("changed")
    )


def ratio(numerator: Column, denominator: Column) -> Column:
    """Quotient, null on an empty denominator."""
    return F.when(denominator != 0, numerator / denominator)


def capped_list(items: Column, shown: int = 5) -> Column:
    """``a, b, +N more`` from an array of strings."""
    rest = F.size(items) - shown
    return F.concat(
        F.array_join(F.slice(items, 1, shown), ", "),
        F.when(rest > 0, F.concat(F.lit(", +"), rest.cast("string"), F.lit(" more"))).otherwise(""),
    )
