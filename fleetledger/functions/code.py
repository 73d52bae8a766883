"""Text jobs on source files: doc comments, signatures, component scripts, import specifiers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from fleetledger.functions.binding import let
from fleetledger.functions.text import WHITESPACE, lines_of, trim

# Annotation syntax and limits.
ANNOTATION = r"^@ai-([a-z][a-z-]*)\b[ \t]*(.*)$"
TAG_SLUG = r"^[a-z0-9][a-z0-9._-]{0,39}$"
MAX_SUMMARY_CHARS = 200
MAX_SIGNATURE_CHARS = 200
FORBIDDEN_KEYS = ("__proto__", "constructor", "prototype")
# Kinds a code unit may have.
UNIT_KINDS = ("function", "class", "method", "variable", "type", "interface", "enum")
# Java has no ID_Start / ID_Continue classes; letters, digits and combining marks stand in for them.
UNIT_ID = (
    r"^[\p{IsAlphabetic}_$][\p{IsAlphabetic}\p{IsDigit}\p{M}_$\x{200C}\x{200D}]*"
    r"(?:\.#?[\p{IsAlphabetic}\p{IsDigit}\p{M}_$\x{200C}\x{200D}-]+)?(?:~\d+)?$"
)
# Extensions an import may be written with, and suffixes tried in order.
SPECIFIER_EXTENSIONS = {".js": ".ts", ".jsx": ".tsx", ".mjs": ".mts", ".cjs": ".cts"}
SPECIFIER_SUFFIXES = (
    ".ts",
    ".tsx",
    ".mts",
    ".js",
    ".jsx",
    ".mjs",
    "/index.ts",
    "/index.tsx",
    "/index.js",
)
SCRIPT_BODY = r"(?is)<script(?=[\s>])[^>]*>(.*?)(?:</script|\z)"


def _comment_lines(comment: Column) -> Column:
    return F.transform(lines_of(comment), lambda l: trim(F.regexp_replace(l, r"^\s*\*+\s?", "")))


def first_sentence(comment: Column) -> Column:
    """First non-empty line of a doc comment that is not a tag."""
    kept = F.filter(_comment_lines(comment), lambda l: (l != "") & ~l.startswith("@"))
    return F.coalesce(F.get(kept, 0), F.lit(""))


def signature(source: Column) -> Column:
    """Header of a declaration: up to its first brace or semicolon, whitespace squeezed, cut at the cap."""
    window = F.substring(source, 1, MAX_SIGNATURE_CHARS + 50)
    header = F.regexp_replace(trim(F.regexp_extract(window, r"(?s)^([^{;]*)", 1)), rf"[{WHITESPACE}]+", " ")
    return F.when(
        F.length(header) > MAX_SIGNATURE_CHARS,
        F.concat(F.substring(header, 1, MAX_SIGNATURE_CHARS), F.lit("…")),
    ).otherwise(header)


def annotations(comment: Column) -> Column:
    """``struct<surface, summary, layer_hint, tags>``; for each field the first valid line wins."""
    lines = F.filter(
        F.transform(
            _comment_lines(comment),
            lambda l: F.struct(
                F.regexp_extract(l, ANNOTATION, 1).alias("key"),
                trim(F.regexp_extract(l, ANNOTATION, 2)).alias("value"),
            ),
        ),
        lambda a: a["key"] != "",
    )

    return let(lines, _fields)


def _fields(lines: Column) -> Column:
    def first(keys: tuple[str, ...], value) -> Column:
        found = F.transform(F.filter(lines, lambda a: a["key"].isin(*keys)), lambda a: value(a["value"]))
        return F.get(F.filter(found, lambda v: v.isNotNull()), 0)

    def surface(v: Column) -> Column:
        return F.when(F.lower(v).isin("public", "private"), F.lower(v))

    def summary(v: Column) -> Column:
        clean = trim(F.regexp_replace(F.regexp_replace(v, r"[\x00-\x1f\x7f]", " "), r"\s+", " "))
        return F.when(clean != "", F.substring(clean, 1, MAX_SUMMARY_CHARS))

    def layer(v: Column) -> Column:
        return F.when(v.isin("0", "1", "2"), v.try_cast("int"))

    tags = F.transform(
        F.filter(lines, lambda a: a["key"] == "tag"),
        lambda a: F.regexp_extract(a["value"], rf"^([^{WHITESPACE}]*)", 1),
    )
    slugs = F.filter(tags, lambda t: t.rlike(TAG_SLUG) & ~t.isin(*FORBIDDEN_KEYS))
    return F.struct(
        first(("surface",), surface).alias("surface"),
        first(("summary",), summary).alias("summary"),
        first(("layer-hint", "layer-default"), layer).alias("layer_hint"),
        F.array_sort(F.array_distinct(slugs)).alias("tags"),
    )


def script_bodies(source: Column) -> Column:
    """Bodies of a component's script elements, in order; an unclosed one runs to the end."""
    return F.regexp_extract_all(source, F.lit(SCRIPT_BODY), 1)


def script_program(source: Column) -> Column:
    """The component with everything but its scripts blanked, so line numbers and columns stay put."""
    pieces = F.split(source, r"(?i)(?=<script[\s>])", -1)

    def keep(piece: Column) -> Column:
        tag = F.regexp_extract(piece, r"(?is)^(<script(?=[\s>])[^>]*>)", 1)
        body = F.regexp_extract(piece, r"(?is)^<script(?=[\s>])[^>]*>(.*?)(?:</script|\z)", 1)
        rest = F.substring(piece, F.length(tag) + F.length(body) + 1, F.length(piece))
        return F.when(tag == "", _blank(piece)).otherwise(F.concat(_blank(tag), body, _blank(rest)))

    return F.array_join(F.transform(pieces, keep), "")


def _blank(text: Column) -> Column:
    return F.regexp_replace(text, r"[^\n]", " ")


def specifier_candidates(base: Column) -> Column:
    """Paths an import of ``base`` may mean, in the order they are tried."""
    mapped = F.when(F.lit(False), F.lit(None).cast("string"))
    for written, source in SPECIFIER_EXTENSIONS.items():
        mapped = mapped.when(base.endswith(written), F.concat(F.substring(base, F.lit(1), F.length(base) - len(written)), F.lit(source)))
    plain = F.array(mapped, base, *[F.concat(base, F.lit(s)) for s in SPECIFIER_SUFFIXES])
    return F.filter(plain, lambda c: c.isNotNull())


def is_unit_id(text: Column) -> Column:
    return text.rlike(UNIT_ID)


def unit_ref(ref: Column) -> Column:
    """``struct<path, unit_id>`` of ``path#id[:start-end]``; null when it is not a unit reference."""
    bare = F.regexp_replace(trim(ref), r":\d+-\d+$", "")
    at = F.instr(bare, "#")
    parsed = F.struct(
        F.substring(bare, F.lit(1), at - 1).alias("path"),
        F.substring(bare, at + 1, F.length(bare)).alias("unit_id"),
    )
    return F.when((at > 1) & (at < F.length(bare)), parsed)
