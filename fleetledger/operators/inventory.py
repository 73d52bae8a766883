"""File inventories: ignore rules, walks, project and workspace markers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from fleetledger.functions.paths import (
    depth,
    dirname,
    has_allowed_extension,
    is_always_ignored,
    matches_ignore_pattern,
)
from fleetledger.functions.text import lines_of, trim

# Files worth naming when a repository is first seen.
NOTABLE_FILES = (
    "PLAN.md",
    "docs/PLAN.md",
    "CLAUDE.md",
    "AGENTS.md",
    "package.json",
    ".git",
    ".session",
)
# Markers of each tool, project and workspace type, strongest first.
TOOL_MARKERS = (
    ("claude", ("CLAUDE.md", ".claude")),
    ("opencode", ("AGENTS.md", "opencode.json")),
    ("cursor", (".cursor", ".cursor/rules")),
    ("windsurf", (".windsurfrules", ".windsurf")),
)
PROJECT_MARKERS = (
    ("vite", ("vite.config.ts", "vite.config.js")),
    ("next", ("next.config.ts", "next.config.js", "next.config.mjs")),
    ("node", ("package.json",)),
)
WORKSPACE_MARKERS = (
    ("pnpm", ("pnpm-workspace.yaml",)),
    ("nx", ("nx.json",)),
    ("turborepo", ("turbo.json", "turbo.config.js", "turbo.config.ts")),
)


def ignore_patterns(ignore_files: DataFrame) -> DataFrame:
    """One row per repository with its usable patterns in file order."""
    usable = F.filter(
        F.transform(lines_of(F.col("text")), trim), lambda l: (l != "") & ~l.startswith("#")
    )
    return ignore_files.select("repo_id", usable.alias("patterns"))


def without_ignored(paths: DataFrame, patterns: DataFrame) -> DataFrame:
    """Paths no pattern of their repository matches.

    Patterns arrive as one array per repository, so the join adds no rows whatever a repository's size.
    """
    hit = F.exists(F.col("patterns"), lambda p: matches_ignore_pattern(F.col("path"), p))
    return (
        paths.join(patterns, "repo_id", "left")
        .where(~F.coalesce(hit, F.lit(False)))
        .drop("patterns")
    )


def walk(
    paths: DataFrame, patterns: DataFrame, max_depth: int | None = None, extensions: Sequence[str] = ()
) -> DataFrame:
    """The files a walk of each repository would list."""
    path = F.col("path")
    cheap = paths.where(~is_always_ignored(path) & has_allowed_extension(path, extensions))
    if max_depth is not None:
        cheap = cheap.where(depth(path) <= max_depth)
    return without_ignored(cheap, patterns)


def _first_marker(markers, otherwise: str):
    choice = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, present in markers:
        choice = choice.when(F.bool_or(_present(present)), name)
    return choice.otherwise(otherwise)


def _present(markers: Sequence[str]):
    """A marker is present as a file or as a directory above some file."""
    path = F.col("path")
    found = path.isin(*markers)
    for marker in markers:
        found = found | path.startswith(marker + "/")
    return found


def project_types(files: DataFrame) -> DataFrame:
    """Tool, project and workspace type of each repository from the markers present in it."""
    workspace = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, present in WORKSPACE_MARKERS:
        workspace = workspace.when(F.bool_or(_present(present)), name)
    return files.groupBy("repo_id").agg(
        _first_marker(TOOL_MARKERS, "unknown").alias("tool"),
        _first_marker(PROJECT_MARKERS, "unknown").alias("project_type"),
        workspace.otherwise("none").alias("workspace_type"),
        F.bool_or(_present((".session",))).alias("has_session"),
    )


def present_markers(files: DataFrame, markers: Sequence[str] = NOTABLE_FILES) -> DataFrame:
    """``repo_id, marker`` for every notable file a repository has."""
    listed = F.array(*[F.when(_present((m,)), F.lit(m)) for m in markers])
    return (
        files.select("repo_id", F.explode(F.array_compact(listed)).alias("marker")).distinct()
    )


def workspace_patterns(manifests: DataFrame) -> DataFrame:
    """``repo_id, pattern, pattern_no, excluded`` from the ``packages:`` list of a workspace file."""
    line = F.regexp_replace(F.col("line"), r"\s+$", "")
    opens = line.rlike(r"^packages\s*:")
    item = line.rlike(r"^\s+-\s")
    closes = (line != "") & ~line.rlike(r"^\s") & ~line.startswith("#")
    lines = manifests.select(
        "repo_id", F.posexplode(lines_of(F.col("text"))).alias("pos", "line")
    ).select(
        "repo_id",
        "pos",
        line.alias("line"),
        item.alias("item"),
        F.when(opens, True).when(closes & ~item, False).alias("mark"),
    )
    # One manifest per repository: the window is bounded by that one file.
    within = F.last("mark", ignorenulls=True).over(
        Window.partitionBy("repo_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    )
    value = trim(F.regexp_replace(F.col("line"), r"^\s+-\s+", ""))
    bare = F.when(value.rlike(r"""^'.*'$|^".*"$"""), F.substring(value, F.lit(2), F.length(value) - 2)).otherwise(value)
    return (
        lines.withColumn("inside", within)
        .where(F.col("inside") & F.col("item"))
        .select("repo_id", F.col("pos").alias("pattern_no"), bare.alias("value"))
        .select(
            "repo_id",
            "pattern_no",
            F.regexp_replace("value", "^!", "").alias("pattern"),
            F.col("value").startswith("!").alias("excluded"),
        )
    )


def package_json_workspaces(manifests: DataFrame) -> DataFrame:
    """``repo_id, pattern, pattern_no, excluded`` from ``workspaces`` of a package manifest."""
    direct = F.from_json(F.get_json_object("text", "$.workspaces"), "array<string>")
    nested = F.from_json(F.get_json_object("text", "$.workspaces.packages"), "array<string>")
    return manifests.select(
        "repo_id", F.posexplode(F.coalesce(nested, direct)).alias("pattern_no", "pattern")
    ).select("repo_id", "pattern_no", "pattern", F.lit(False).alias("excluded"))


def workspace_packages(patterns: DataFrame, files: DataFrame) -> DataFrame:
    """Packages the patterns name: ``dir/*`` lists its subdirectories, excludes win, first pattern wins."""
    dirs = directories(files)
    literal = ~F.col("pattern").rlike(r"[*?]")
    star = F.col("pattern").rlike(r"^(?:[^*?]*/)?\*$")
    parent = F.regexp_replace("pattern", r"/?\*$", "")
    exact = patterns.where(literal).join(
        dirs.select("repo_id", F.col("directory").alias("pattern")), ["repo_id", "pattern"]
    ).select("repo_id", "pattern_no", "excluded", F.col("pattern").alias("directory"))
    listed = patterns.where(star).select("repo_id", "pattern_no", "excluded", parent.alias("parent"))
    children = dirs.where(~F.element_at(F.split("directory", "/"), -1).startswith(".")).select(
        "repo_id",
        "directory",
        F.when(F.col("directory").contains("/"), dirname(F.col("directory"))).otherwise("").alias("parent"),
    )
    expanded = exact.unionByName(
        listed.join(children, ["repo_id", "parent"]).select("repo_id", "pattern_no", "excluded", "directory")
    )
    return (
        expanded.groupBy("repo_id", "directory")
        .agg(
            F.bool_or("excluded").alias("is_excluded"),
            F.min(F.when(~F.col("excluded"), F.col("pattern_no"))).alias("pattern_no"),
        )
        .where(~F.col("is_excluded") & F.col("pattern_no").isNotNull())
        .drop("is_excluded")
    )


def directories(files: DataFrame) -> DataFrame:
    """Every directory, at any depth, that holds a file."""
    parts = F.split("path", "/")
    ancestors = F.transform(
        F.when(F.size(parts) > 1, F.sequence(F.lit(1), F.size(parts) - 1)).otherwise(
            F.array().cast("array<int>")
        ),
        lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"),
    )
    return files.select("repo_id", F.explode(ancestors).alias("directory")).distinct()


def package_names(packages: DataFrame, manifests: DataFrame) -> DataFrame:
    """Packages with the name their own manifest declares, null without one."""
    named = manifests.select(
        "repo_id", dirname(F.col("path")).alias("directory"), F.get_json_object("text", "$.name").alias("name")
    )
    return packages.join(named, ["repo_id", "directory"], "left")
