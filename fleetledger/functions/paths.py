"""Predicates and projections on repository-relative paths."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from fleetledger.functions.binding import let

# Directories never walked.
ALWAYS_IGNORED_DIRS = ("node_modules", ".git", "dist", "build", ".session")
# Generated dependency locks.
LOCKFILE_NAMES = (
    "pnpm-lock.yaml",
    "package-lock.json",
    "npm-shrinkwrap.json",
    "yarn.lock",
    "bun.lockb",
    "bun.lock",
    "deno.lock",
    "Cargo.lock",
    "go.sum",
    "poetry.lock",
    "Pipfile.lock",
    "uv.lock",
    "pdm.lock",
    "Gemfile.lock",
    "composer.lock",
    "mix.lock",
    "pubspec.lock",
    "Podfile.lock",
    "packages.lock.json",
    "flake.lock",
)
# Prefixes that are bookkeeping rather than work.
UNSCORED_PREFIXES = (".session/", "docs/", "CHANGELOG.md")
# Fixed value: characters a bare path may hold.
PATH_SHAPED = r"^[A-Za-z0-9._\-+@/]+$"
# Segments that are never a legitimate path part.
DANGEROUS_SEGMENTS = ("__proto__", "constructor", "prototype")
# Fixed value: characters of a path token inside running text.
PATH_TOKEN = r"[A-Za-z0-9_.\-/]+"
# Fixed value: last segment of a word that names a file.
FILE_SEGMENT = r"^[^.]+(\.[^.]+)*\.[A-Za-z][A-Za-z0-9]{0,9}$"
# Basename -> purpose of well-known files.
PURPOSE_BY_NAME = {
    "package.json": "Package manifest",
    "tsconfig.json": "TypeScript config",
    "tsconfig.build.json": "Build-only TypeScript config",
    "tsup.config.ts": "Build config",
    "vitest.config.ts": "Test config",
    "biome.json": "Linter/formatter config",
    ".npmrc": "npm/pnpm settings",
    ".nvmrc": "Node version",
    ".gitignore": "Git ignore rules",
    "README.md": "Documentation",
    "CHANGELOG.md": "Change log",
    "LICENSE": "License file",
}


def segments(path: Column) -> Column:
    """Path parts without the empty and ``.`` ones."""
    return F.filter(F.split(path, "/", -1), lambda s: (s != "") & (s != "."))


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def dirname(path: Column) -> Column:
    """Parent directory, ``.`` for a top-level file."""
    return F.when(path.contains("/"), F.regexp_replace(path, r"/[^/]*$", "")).otherwise(F.lit("."))


def extname(path: Column) -> Column:
    """Extension with its dot; a leading dot alone is not an extension."""
    return F.regexp_extract(basename(path), r"^.+?(\.[^.]*)$", 1)


def is_always_ignored(path: Column) -> Column:
    return F.arrays_overlap(F.split(path, r"[\\/]", -1), F.array(*map(F.lit, ALWAYS_IGNORED_DIRS)))


def matches_ignore_pattern(path: Column, pattern: Column) -> Column:
    """One ignore pattern against one path; negated patterns never match."""
    directory = F.substring(pattern, F.lit(1), F.length(pattern) - 1)
    any_depth = F.substring(pattern, F.lit(4), F.length(pattern))
    return (
        F.when(pattern.startswith("!"), F.lit(False))
        .when(
            pattern.endswith("/"),
            path.startswith(F.concat(directory, F.lit("/")))
            | F.contains(path, F.concat(F.lit("/"), directory, F.lit("/")))
            | (path == directory),
        )
        .when(pattern.startswith("*."), F.endswith(path, F.substring(pattern, F.lit(2), F.length(pattern))))
        .when(
            pattern.startswith("**/*."),
            F.endswith(path, F.substring(pattern, F.lit(5), F.length(pattern))),
        )
        .when(
            pattern.startswith("**/"),
            (path == any_depth) | F.endswith(path, F.concat(F.lit("/"), any_depth)),
        )
        .otherwise(F.array_contains(F.split(path, "/", -1), pattern))
    )


def depth(path: Column) -> Column:
    return F.size(F.split(path, "/", -1))


def has_allowed_extension(path: Column, extensions: Sequence[str]) -> Column:
    return F.lit(True) if not extensions else extname(path).isin(*extensions)


def is_scorable(path: Column) -> Column:
    unscored = F.lit(False)
    for prefix in UNSCORED_PREFIXES:
        unscored = unscored | path.startswith(prefix)
    return ~unscored


def is_path_shaped(text: Column) -> Column:
    return text.rlike(PATH_SHAPED)


def leaves_root(path: Column) -> Column:
    """Absolute, drive-lettered, or with more ``..`` than parents at some point."""
    unix = F.regexp_replace(path, r"\\", "/")
    lowest = F.aggregate(
        F.split(unix, "/", -1),
        F.struct(F.lit(0).alias("depth"), F.lit(0).alias("low")),
        lambda acc, part: F.struct(
            _step(acc["depth"], part).alias("depth"),
            F.least(acc["low"], _step(acc["depth"], part)).alias("low"),
        ),
        lambda acc: acc["low"],
    )
    return unix.startswith("/") | unix.rlike(r"^[A-Za-z]:") | (lowest < 0)


def _step(level: Column, part: Column) -> Column:
    return F.when(part.isin("", "."), level).when(part == "..", level - 1).otherwise(level + 1)


def unsafe_reason(path: Column) -> Column:
    """Why a path must not be resolved inside a project; null when it is safe."""
    parts = F.split(path, "/", -1)
    return (
        F.when(path.contains("\x00"), "null-byte")
        .when(path.startswith("/"), "absolute")
        .when(F.arrays_overlap(parts, F.array(*map(F.lit, DANGEROUS_SEGMENTS))), "dangerous-segment")
        .when(leaves_root_posix(path), "outside-root")
    )


def leaves_root_posix(path: Column) -> Column:
    """As :func:`leaves_root`, with the backslash an ordinary character."""
    lowest = F.aggregate(
        F.split(path, "/", -1),
        F.struct(F.lit(0).alias("depth"), F.lit(0).alias("low")),
        lambda acc, part: F.struct(
            _step(acc["depth"], part).alias("depth"),
            F.least(acc["low"], _step(acc["depth"], part)).alias("low"),
        ),
        lambda acc: acc["low"],
    )
    return lowest < 0


def is_escaping_ref(ref: Column) -> Column:
    return (
        ref.startswith("/") | ref.rlike(r"^[A-Za-z]:") | F.array_contains(F.split(ref, "/", -1), "..")
    )


def is_lockfile(path: Column) -> Column:
    return basename(path).isin(*LOCKFILE_NAMES)


def is_plan_file(path: Column) -> Column:
    return path.rlike(r"^(docs[/\\])?(?i:PLAN(_\d+)?\.md)$")


def infer_purpose(path: Column) -> Column:
    """A one-line purpose from the file's name alone; the first rule that applies wins."""
    base, ext, parent = basename(path), extname(path), dirname(path)
    rule = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, purpose in PURPOSE_BY_NAME.items():
        rule = rule.when(base == name, purpose)
    return (
        rule.when(
            base.rlike(r"\.(test|spec)\.ts$"),
            F.concat(F.lit("Tests for "), F.regexp_replace(base, r"\.(test|spec)\.ts$", "")),
        )
        .when(
            base.isin("index.ts", "index.tsx"),
            F.concat(F.when(parent == ".", F.lit("Root")).otherwise(parent), F.lit(" entry point")),
        )
        .when(ext.isin(".ts", ".tsx"), F.concat(_without_first(base, ext), F.lit(" module")))
        .when(ext == ".md", "Documentation")
        .when(ext.isin(".json", ".yml", ".yaml"), "Configuration")
        .otherwise("Project file")
    )


def _without_first(text: Column, part: Column) -> Column:
    at = F.instr(text, part)
    return F.concat(F.substring(text, F.lit(1), at - 1), F.substring(text, at + F.length(part), F.length(text)))


def path_tokens(text: Column) -> Column:
    """Every path-like token of a text, as an array of its segments."""
    raw = F.regexp_extract_all(text, F.lit(f"({PATH_TOKEN})"), 1)
    return F.filter(
        F.transform(raw, lambda t: segments(F.regexp_replace(t, r"\.+$", ""))), lambda s: F.size(s) > 0
    )


def normalize_path(path: Column) -> Column:
    """Collapse ``.``, ``..`` and doubled slashes of a relative path."""
    parts = F.aggregate(
        F.split(path, "/", -1),
        F.array().cast("array<string>"),
        lambda acc, part: F.when(part.isin("", "."), acc)
        .when(
            (part == "..") & (F.size(acc) > 0) & (F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit("..")) != ".."),
            F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))),
        )
        .otherwise(F.concat(acc, F.array(part))),
    )
    return F.array_join(parts, "/")


def word_to_file_path(word: Column) -> Column:
    """The path a word names once its punctuation is trimmed; null when it names none."""
    bare = F.regexp_replace(word, r"""^[("'\[<]+|[)"'\]>.,;:!]+$""", "")
    both = F.struct(bare.alias("bare"), normalize_path(bare).alias("norm"))
    return let(both, lambda w: F.when(_names_file(w["bare"], w["norm"]), w["norm"]))


def _names_file(bare: Column, norm: Column) -> Column:
    return (
        (bare != "")
        & ~F.contains(bare, F.lit("\\"))
        & ~bare.startswith("/")
        & (norm != "..")
        & ~norm.startswith("../")
        & ~bare.endswith("/")
        & basename(norm).rlike(FILE_SEGMENT)
    )
