"""Markdown structure as array columns.

A file is one row, so its fence state and its sections are computed inside the row: no shuffle of
line text, and time linear in the length of the file.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from fleetledger.functions.binding import let
from fleetledger.functions.text import WHITESPACE, trim, trim_end

# Line shapes.
HEADING = r"^(#{1,6})\s+(.+)$"
FENCE = r"^(?:```|~~~)"
RULE = r"^(?:-{3,}|\*{3,}|_{3,})$"
TASK_TODO = r"^[-*]\s+\[ \]\s+(.+)$"
TASK_DONE = r"^[-*]\s+\[[xX]\]\s+(.+)$"
TASK_IN_PROGRESS = r"^[-*]\s+\[-\]\s+(.+)$"
EST_SESSIONS = r"(?i)est\.?\s*sessions?:\s*(\d+)"
# Nouns that may precede a section number.
POSITION_NOUNS = ("chunk", "phase", "step", "milestone", "part", "stage", "sprint")
POSITION = r"(?i)^(?:(" + "|".join(POSITION_NOUNS) + r")\s+)?(\d+(?:\.\d+)?)\b"
LIST_MARKERS = r"^(?:[-*+]\s+|\d+[.)]\s+|>\s?)+"
BOUNDARY_H2 = r"^## \s*(.+)$"
BOUNDARY_H1 = r"^# \s*(.+)$"
BOUNDARY_H3 = r"^###+ \s*(.+)$"
BOUNDARY_RULE = r"^(?:---+|\*\*\*+|___+)\s*$"
MIN_CHUNK_ID = 1

_BLANK = "[" + WHITESPACE.replace(r"\s", r" \t\x0C\r") + "]*"
_BEFORE_FENCE = rf"(?md)(?=^{_BLANK}(?:```|~~~))"


def scan_lines(text: Column) -> Column:
    """``array<struct<pos, raw, trimmed, in_fence>>``; a fence delimiter counts as inside.

    The text is cut before every delimiter, so the n-th piece alternates outside and inside.
    """
    cut = F.struct(
        F.split(text, _BEFORE_FENCE, -1).alias("pieces"),
        trim(F.substring_index(text, "\n", 1)).rlike(FENCE).cast("int").alias("opens"),
    )
    return let(cut, lambda c: _scan_pieces(c["pieces"], c["opens"]))


def _scan_pieces(pieces: Column, opens: Column) -> Column:
    def lines(piece: Column, i: Column) -> Column:
        fences_before = i + opens
        last = i == F.size(pieces) - 1
        body = F.when(last, piece).otherwise(F.regexp_replace(piece, r"\n\z", ""))
        return F.transform(
            F.split(body, "\n", -1),
            lambda raw, j: F.struct(
                raw.alias("raw"),
                ((fences_before % 2 == 1) | ((j == 0) & (fences_before > 0))).alias("in_fence"),
            ),
        )

    return F.transform(
        F.flatten(F.transform(pieces, lines)),
        lambda line, pos: F.struct(
            pos.alias("pos"),
            line["raw"].alias("raw"),
            trim(line["raw"]).alias("trimmed"),
            line["in_fence"].alias("in_fence"),
        ),
    )


def heading_depth(trimmed: Column) -> Column:
    """1 to 6 for a heading line, 0 otherwise."""
    return F.length(F.regexp_extract(trimmed, HEADING, 1))


def heading_text(trimmed: Column) -> Column:
    return trim(F.regexp_extract(trimmed, HEADING, 2))


def unfenced_depth(line: Column) -> Column:
    return F.when(line["in_fence"], 0).otherwise(heading_depth(line["trimmed"]))


def sections(lines: Column, split_depth: Column) -> Column:
    """Sections of a scanned file: a heading owns the lines up to the next one at or above the depth.

    Both arguments are used inside lambdas: pass stored columns or variables bound with ``let``.
    """
    starts = F.filter(
        F.transform(lines, lambda line, i: F.struct(i.alias("i"), unfenced_depth(line).alias("depth"))),
        lambda s: (s["depth"] > 0) & (s["depth"] <= split_depth),
    )

    def section(start: Column, n: Column, all_starts: Column) -> Column:
        following = F.coalesce(F.get(all_starts, n + 1)["i"], F.size(lines))
        return F.struct(
            heading_text(F.get(lines, start["i"])["trimmed"]).alias("heading"),
            (start["i"] + 1).alias("line"),
            start["depth"].alias("depth"),
            F.slice(lines, start["i"] + 2, following - start["i"] - 1).alias("body"),
        )

    return let(starts, lambda found: F.transform(found, lambda s, n: section(s, n, found)))


def position_noun(heading: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(heading, POSITION, 1)), F.lit(""))


def position_value(heading: Column) -> Column:
    return F.nullif(F.regexp_extract(heading, POSITION, 2), F.lit("")).try_cast("decimal(10,3)")


def position_title(heading: Column) -> Column:
    """Heading text after its declared number, or the whole heading when nothing follows."""
    matched = F.length(F.regexp_extract(heading, POSITION, 0))
    rest = F.regexp_replace(
        F.substring(heading, matched + 1, F.length(heading)), r"^\s*[—–\-:.]?\s*", ""
    )
    return F.when(
        matched > 0, F.coalesce(F.nullif(trim(rest), F.lit("")), trim(heading))
    )


def task_status(trimmed: Column) -> Column:
    """``done``, ``in-progress`` or ``todo`` for a checkbox line; null otherwise."""
    return (
        F.when(trimmed.rlike(TASK_DONE), "done")
        .when(trimmed.rlike(TASK_IN_PROGRESS), "in-progress")
        .when(trimmed.rlike(TASK_TODO), "todo")
    )


def task_text(trimmed: Column) -> Column:
    return trim(F.regexp_extract(trimmed, r"^[-*]\s+\[[ xX-]\]\s+(.+)$", 1))


def est_sessions(trimmed: Column) -> Column:
    value = F.nullif(F.regexp_extract(trimmed, EST_SESSIONS, 1), F.lit("")).try_cast("int")
    return F.when(value >= 1, value)


def dependencies(trimmed: Column, nouns: Column) -> Column:
    """Chunk ids of a ``depends on:`` line; a noun before the ids must be ``chunk`` or one of ``nouns``."""
    pattern = rf"(?i)depends\s+on:\s*(?:({'|'.join(POSITION_NOUNS)})s?\s+)?([\d.,\s]+)"
    noun = F.lower(F.regexp_extract(trimmed, pattern, 1))
    ids = F.transform(
        F.split(F.regexp_extract(trimmed, pattern, 2), ",", -1),
        lambda s: F.nullif(F.regexp_extract(trim(s), r"^(\d+(?:\.\d*)?|\.\d+)", 1), F.lit("")).try_cast(
            "decimal(10,3)"
        ),
    )
    usable = noun.isin("", "chunk") | F.array_contains(nouns, noun)
    return F.when(usable, F.filter(ids, lambda v: v >= MIN_CHUNK_ID)).otherwise(
        F.array().cast("array<decimal(10,3)>")
    )


def boundary_confidence(trimmed: Column) -> Column:
    return (
        F.when(trimmed.rlike(BOUNDARY_H2), 1.0)
        .when(trimmed.rlike(BOUNDARY_H1), 0.7)
        .when(trimmed.rlike(BOUNDARY_RULE), 0.5)
        .when(trimmed.rlike(BOUNDARY_H3), 0.3)
    )


def boundary_heading(trimmed: Column) -> Column:
    return F.when(trimmed.rlike(BOUNDARY_RULE), "").otherwise(
        F.regexp_extract(trimmed, r"^#+ \s*(.+)$", 1)
    )


def prose(lines: Column) -> Column:
    """Running text of a scanned section: fences, tables and rules dropped, list markers stripped."""
    kept = F.filter(
        lines,
        lambda l: ~l["in_fence"]
        & (l["trimmed"] != "")
        & ~l["trimmed"].startswith("|")
        & ~l["trimmed"].rlike(RULE),
    )
    bare = F.transform(kept, lambda l: F.regexp_replace(l["trimmed"], LIST_MARKERS, ""))
    return trim(F.regexp_replace(F.array_join(F.filter(bare, lambda t: t != ""), " "), r"\s+", " "))


def without_trailing_space(lines: Column) -> Column:
    return F.transform(lines, lambda l: trim_end(l["raw"]))


# Fixed value: alternatives one word may expand to where a caller asks for a limit.
MAX_EXPANSIONS = 64


def expand_braces(word: Column, limit: int | None = None) -> Column:
    """``a.{ts,js}`` as both words, leftmost group first; at most ``limit`` of them if one is given."""
    opens = F.length(word) - F.length(F.replace(word, F.lit("{"), F.lit("")))

    def one_round(acc: Column, _: Column) -> Column:
        expanded = F.flatten(F.transform(acc, _expand_first_group))
        return expanded if limit is None else F.slice(expanded, 1, limit)

    rounds = F.when(opens > 0, F.sequence(F.lit(1), opens)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(rounds, F.array(word), one_round)


def _expand_first_group(word: Column) -> Column:
    group = F.regexp_extract(word, r"(\{[^{}]*\})", 1)
    at = F.instr(word, group)
    head = F.substring(word, F.lit(1), at - 1)
    tail = F.substring(word, at + F.length(group), F.length(word))
    inner = F.substring(group, F.lit(2), F.length(group) - 2)
    return F.when(group == "", F.array(word)).otherwise(
        F.transform(F.split(inner, ",", -1), lambda alt: F.concat(head, alt, tail))
    )


def file_refs(lines: Column, max_expansions: int | None = None) -> Column:
    """Distinct files the lines of a section name, tasks and globs left out."""
    from fleetledger.functions.paths import word_to_file_path

    kept = F.filter(lines, lambda l: l["in_fence"] | task_status(l["trimmed"]).isNull())

    def words(line: Column) -> Column:
        spans = F.transform(
            F.regexp_extract_all(line["trimmed"], F.lit("`([^`]+)`"), 1), lambda s: F.split(s, r"\s+", -1)
        )
        outside = F.split(F.regexp_replace(line["trimmed"], "`([^`]+)`", " "), r"\s+", -1)
        return F.when(line["in_fence"], F.split(line["trimmed"], r"\s+", -1)).otherwise(
            F.concat(F.flatten(spans), F.filter(outside, lambda w: w.contains("/")))
        )

    candidates = F.filter(
        F.flatten(F.transform(kept, words)), lambda w: (w != "") & ~w.rlike("[*?]")
    )
    paths = F.transform(F.flatten(F.transform(candidates, lambda w: expand_braces(w, max_expansions))), word_to_file_path)
    return F.array_distinct(F.filter(paths, lambda p: p.isNotNull()))


# The length at which a brief is shown shortened, and the line that says so.
MAX_BRIEF_CHARS = 6000
SHORTENED = "_(shortened — the full section is in the original plan)_"


def without_empty_headings(lines: Column) -> Column:
    """Drop headings that own no content before the next heading at their depth or above.

    Each line is coded as one character (heading depth, blank, content), so the test for a heading
    is one anchored match on the codes after it.
    """
    codes = F.array_join(
        F.transform(
            lines,
            lambda l: F.when(unfenced_depth(l) > 0, unfenced_depth(l).cast("string"))
            .when(l["trimmed"] == "", "b")
            .otherwise("c"),
        ),
        "",
    )

    def has_content(codes: Column, line: Column, i: Column) -> Column:
        after = F.substring(codes, i + 2, F.length(codes))
        depth = unfenced_depth(line)
        test = F.when(depth == 0, F.lit(True))
        for level in range(1, 7):
            deeper = "".join(str(d) for d in range(level + 1, 7))
            test = test.when(depth == level, after.rlike(f"^[b{deeper}]*c"))
        return test

    return let(codes, lambda bound: F.filter(lines, lambda line, i: has_content(bound, line, i)))


def brief(lines: Column, max_chars: int | None = None) -> Column:
    """A section's text without its tasks and empty headings, whole or cut at a line; null when nothing is left."""
    kept = F.filter(lines, lambda l: l["in_fence"] | task_status(l["trimmed"]).isNull())
    joined = let(kept, lambda k: F.array_join(without_trailing_space(without_empty_headings(k)), "\n"))
    text = trim(F.regexp_replace(joined, r"\n{3,}", "\n\n"))
    rule = rf"{_BLANK}(?:-{{3,}}|\*{{3,}}|_{{3,}}){_BLANK}"
    text = F.regexp_replace(text, rf"\A(?:{rule}(?:\n|\z))+", "")
    return let(trim(F.regexp_replace(text, rf"(?:(?:\n|\A){rule})+\z", "")), lambda t: _capped_brief(t, max_chars))


def _capped_brief(text: Column, max_chars: int | None) -> Column:
    if max_chars is None:
        return F.nullif(text, F.lit(""))
    room = max_chars - len(SHORTENED) - 2
    head = F.substring(text, F.lit(1), F.lit(room + 1))
    cut = F.length(head) - F.instr(F.reverse(head), "\n")
    kept_chars = F.when(F.instr(head, "\n") > 1, cut).otherwise(room)
    capped = F.concat(trim_end(F.substring(text, F.lit(1), kept_chars)), F.lit("\n\n" + SHORTENED))
    return F.when(text != "", F.when(F.length(text) <= max_chars, text).otherwise(capped))


def managed_block(text: Column, start: str, end: str) -> tuple[Column, Column]:
    """(user, managed) parts of a text; a block that is never closed runs to the end."""
    block = rf"(?s){_literal(start)}(.*?)(?:{_literal(end)}|\z)"
    return F.regexp_replace(text, block, ""), F.array_join(F.regexp_extract_all(text, F.lit(block), 1), "")


def _literal(text: str) -> str:
    return r"\Q" + text + r"\E"
