"""References inside prompts and task texts."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from fleetledger.functions.binding import let
from fleetledger.functions.text import lines_of, trim

# The line prefixes under which a prompt lists files, most specific first.
LEGACY_LOAD_PREFIX = "Files to load:"
FOCUS_PREFIX = "Focus (read_unit):"
LOAD_FULL_PREFIX = "Load full:"
SUMMARIES_PREFIX = "Summaries (read_file_layer for detail):"
PLAN_PREFIX = "Plan:"
LOAD_PREFIX = "Load:"
FILE_LOAD_PREFIXES = (
    LEGACY_LOAD_PREFIX,
    FOCUS_PREFIX,
    LOAD_FULL_PREFIX,
    SUMMARIES_PREFIX,
    PLAN_PREFIX,
    LOAD_PREFIX,
)
# Fixed value: layer annotation after a path.
LAYER_SUFFIX = "·L\\d+$"
# How a name appears in a task text.
MENTION = r"`([^`]+)`|([A-Za-z_$][\w$]*(?:\.[A-Za-z_$#][\w$]*)*)"
QUALIFIED = r"^[A-Za-z_$#][\w$#]*(?:\.[A-Za-z_$#][\w$#]*)?$"
AT_MENTION = r"@([\w./-]+\.\w+)"
UNIT_REF = r"^(.+?)#(.+):(\d+)-(\d+)$"


def normalize_ref(raw: Column) -> Column:
    """The bare path of one listed reference; null for summaries and prose."""

    def bare(ref: Column) -> Column:
        path = F.regexp_replace(F.substring_index(ref, " (", 1), "^@", "")
        path = trim(F.regexp_replace(F.regexp_replace(path, "^`|`$", ""), LAYER_SUFFIX, ""))
        usable = (ref != "") & ~ref.startswith("+") & (ref != "(none)")
        return F.when(usable, F.substring_index(path, "#", 1))

    path = let(trim(raw), bare)
    return let(path, lambda r: F.when(r.contains("/") | r.contains("."), r))


def normalize_ref_loose(raw: Column) -> Column:
    """The evaluation's variant: prose is kept, only the empty string and ``+N more`` are dropped."""
    ref = F.substring_index(
        trim(F.regexp_replace(F.regexp_replace(trim(raw), LAYER_SUFFIX, ""), "^@", "")), "#", 1
    )
    return let(ref, lambda r: F.when((r != "") & ~r.rlike(r"^\+\d+ more$"), r))


def _prefix_of(line: Column) -> Column:
    found = F.when(F.lit(False), F.lit(None).cast("string"))
    for prefix in FILE_LOAD_PREFIXES:
        found = found.when(line.startswith(prefix), F.lit(prefix))
    return found


def _listed_parts(prompt: Column) -> Column:
    """What follows the load prefix of each load line, split at commas; empty and ``(none)`` lists dropped."""
    lines = F.transform(lines_of(prompt), trim)
    prefixed = F.filter(
        F.transform(lines, lambda l: F.struct(l.alias("line"), _prefix_of(l).alias("prefix"))),
        lambda p: p["prefix"].isNotNull(),
    )
    rests = F.transform(prefixed, lambda p: trim(F.substring(p["line"], F.length(p["prefix"]) + 1, F.length(p["line"]))))
    return F.flatten(F.transform(F.filter(rests, lambda r: ~r.isin("", "(none)")), lambda r: F.split(r, ",", -1)))


def declared_files(prompt: Column) -> Column:
    """Distinct paths a prompt tells the next session to load, in order of first appearance."""
    return F.array_distinct(F.array_compact(F.transform(_listed_parts(prompt), normalize_ref)))


def declared_refs_loose(prompt: Column) -> Column:
    """Every listed reference under the evaluation's rules, repeats kept."""
    return F.array_compact(F.transform(_listed_parts(prompt), normalize_ref_loose))


def is_code_shaped(name: Column) -> Column:
    """A dot, a capital after the first letter, or one of ``_ $ digit``."""
    return name.contains(".") | name.rlike(".[A-Z]") | name.rlike(r"[_$\d]")


def mentions(text: Column) -> Column:
    """Names a task text mentions: any name in backticks, and bare names that look like code."""
    whole = F.regexp_extract_all(text, F.lit(f"({MENTION})"), 1)

    def name(m: Column) -> Column:
        quoted = F.regexp_replace(trim(F.regexp_replace(m, "^`|`$", "")), r"\(.*\)$", "")
        return F.when(m.startswith("`"), F.when(quoted.rlike(QUALIFIED), quoted)).otherwise(
            F.when(is_code_shaped(m), m)
        )

    return F.filter(F.transform(whole, name), lambda n: n.isNotNull())


def focus_ref(ref: Column) -> Column:
    """``path#id:start-end`` as a struct; null when malformed."""
    parsed = F.struct(
        F.regexp_extract(ref, UNIT_REF, 1).alias("path"),
        F.regexp_extract(ref, UNIT_REF, 2).alias("unit_id"),
        F.regexp_extract(ref, UNIT_REF, 3).try_cast("int").alias("start"),
        F.regexp_extract(ref, UNIT_REF, 4).try_cast("int").alias("end"),
    )
    return F.when(ref.rlike(UNIT_REF), parsed)
