"""Token budgets: directory sizes, file costs, cap verdicts, trims and savings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from fleetledger.functions.binding import unnest
from fleetledger.functions.paths import basename, dirname, is_lockfile, is_plan_file, leaves_root
from fleetledger.functions.text import ratio, token_estimate_from_size
from fleetledger.operators.ordered import ordinal, running_total_before

DEFAULT_BUDGET = 4000
DEFAULT_FILE_TOKENS = 50


def group_by_directory(files: DataFrame) -> DataFrame:
    """Files and bytes per directory."""
    return files.groupBy("repo_id", dirname(F.col("path")).alias("directory")).agg(
        F.count("*").alias("files"), F.sum("size_bytes").alias("total_size_bytes")
    )


def with_measured_costs(entries: DataFrame, files: DataFrame) -> DataFrame:
    """Index entries lacking a cost get the size estimate of their file; others are left alone."""
    sizes = files.select("repo_id", "path", "size_bytes")
    measured = F.when(~leaves_root(F.col("path")), token_estimate_from_size(F.col("size_bytes")))
    return (
        entries.join(sizes, ["repo_id", "path"], "left")
        .withColumn("token_cost", F.coalesce("token_cost", measured))
        .drop("size_bytes")
    )


def budget_items(owners: DataFrame, entries: DataFrame) -> DataFrame:
    """One row per budgeted component of each owner: state, plan chunk, context files, always-included.

    ``owners`` has ``repo_id, owner, state_tokens, chunk_tokens``; ``entries`` has
    ``repo_id, owner, path, role, token_cost``. A path listed twice in a role is charged once.
    """
    fixed = owners.select(
        "repo_id",
        "owner",
        F.explode(
            F.array(
                F.struct(F.lit("session-state").alias("component"), F.col("state_tokens").alias("tokens")),
                F.struct(F.lit("plan-chunk").alias("component"), F.col("chunk_tokens").alias("tokens")),
            )
        ).alias("item"),
    ).select("repo_id", "owner", "item.component", F.lit(None).cast("string").alias("path"), "item.tokens")
    charged = (
        entries.groupBy("repo_id", "owner", "role", "path")
        .agg(F.max(F.coalesce("token_cost", F.lit(DEFAULT_FILE_TOKENS))).cast("long").alias("tokens"))
        .select("repo_id", "owner", F.col("role").alias("component"), "path", "tokens")
    )
    return fixed.unionByName(charged)


def budgets(items: DataFrame, cap: int = DEFAULT_BUDGET) -> DataFrame:
    """Totals per owner and whether the part that counts against the cap exceeds it.

    Always-included files are part of the total but not of the capped amount.
    """

    def part(component: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("component") == component, F.col("tokens"))), F.lit(0)).cast("long")

    summed = items.groupBy("repo_id", "owner").agg(
        part("session-state").alias("session_state"),
        part("plan-chunk").alias("plan_chunk"),
        part("context-files").alias("context_files"),
        part("always-include").alias("always_include"),
        F.sum("tokens").alias("total_tokens"),
    )
    return judge(summed, cap)


def judge(summed: DataFrame, cap: int = DEFAULT_BUDGET) -> DataFrame:
    return summed.withColumn("capped_tokens", F.col("total_tokens") - F.col("always_include")).withColumn(
        "over_budget", F.col("capped_tokens") > cap
    )


def breakdown(items: DataFrame) -> DataFrame:
    """Tokens and integer share at three levels: file, component, and everything."""
    rolled = items.groupingSets(
        [["repo_id", "owner", "component", "path"], ["repo_id", "owner", "component"], ["repo_id", "owner"]],
        "repo_id",
        "owner",
        "component",
        "path",
    ).agg(
        F.sum("tokens").alias("tokens"),
        F.when(F.grouping("component") == 1, "total")
        .when(F.grouping("path") == 1, "component")
        .otherwise("file")
        .alias("level"),
    )
    totals = items.groupBy("repo_id", "owner").agg(F.sum("tokens").alias("total"))
    share = F.floor(F.col("tokens") * 100 / F.col("total") + 0.5).cast("long")
    return (
        rolled.join(totals, ["repo_id", "owner"])
        .withColumn("percent", F.when(F.col("total") > 0, share))
        .drop("total")
    )


def greedy_exclusions(candidates: DataFrame, target: int, base_tokens: Column | None = None) -> DataFrame:
    """Files to exclude, largest first, while what remains is still above ``target``.

    ``candidates`` has ``repo_id, path, tokens, already_excluded``. The running total is taken over
    token-size buckets, so a repository's files are not sorted in one task.
    """
    open_ones = candidates.where(~F.col("already_excluded"))
    totals = open_ones.groupBy("repo_id").agg(
        (F.sum("tokens") + (F.lit(0) if base_tokens is None else F.max(base_tokens))).alias("current_total")
    )
    ranked = running_total_before(
        open_ones, ["repo_id"], [F.desc("tokens"), F.col("path")], F.col("tokens"), -F.col("tokens"), "freed_before"
    )
    return (
        ranked.join(totals, "repo_id")
        .where(F.col("current_total") - F.col("freed_before") > target)
        .select("repo_id", "path", "tokens", "freed_before")
    )


def candidates_by_size(files: DataFrame) -> DataFrame:
    """Trim candidates in order of size; ``position`` is 1 for the largest of a repository."""
    costed = files.select("repo_id", "path", token_estimate_from_size(F.col("size_bytes")).alias("tokens"))
    return ordinal(costed, ["repo_id"], [F.desc("tokens"), F.col("path")], -F.col("tokens"), "position")


def file_cap(files: DataFrame, max_files: int) -> DataFrame:
    """The first ``max_files`` paths of each repository in path order."""
    first = F.row_number().over(Window.partitionBy("repo_id").orderBy("path"))
    return files.withColumn("position", first).where(F.col("position") <= max_files)


def baseline(files: DataFrame) -> DataFrame:
    """Tokens and count of every repository's files, lockfiles and session files left out."""
    return _relevant(files).groupBy("repo_id").agg(
        F.sum(token_estimate_from_size(F.col("size_bytes"))).alias("total_tokens"),
        F.count("*").alias("file_count"),
    )


def largest_files(files: DataFrame, n: int = 10) -> DataFrame:
    tokens = token_estimate_from_size(F.col("size_bytes"))
    rank = F.row_number().over(Window.partitionBy("repo_id").orderBy(F.desc("tokens"), "path"))
    costed = _relevant(files).select("repo_id", "path", tokens.alias("tokens"))
    return costed.withColumn("rank", rank).where(F.col("rank") <= n)


def _relevant(files: DataFrame) -> DataFrame:
    path = F.col("path")
    return files.where(~is_lockfile(path) & ~path.rlike(r"[/\\]\.session[/\\]"))


def savings(compared: DataFrame) -> DataFrame:
    """Tokens saved by handing over ``with_tokens`` instead of ``without_tokens``.

    A hand-over naming no files compressed nothing, so it has no ratio.
    """
    applicable = F.col("with_file_count") > 0
    saved = F.col("without_tokens") - F.col("with_tokens")
    percent = F.when(
        applicable, F.coalesce(ratio(saved * 100, F.col("without_tokens")), F.lit(0.0))
    ).otherwise(0.0)
    times = F.coalesce(ratio(F.col("without_tokens"), F.col("with_tokens")), F.lit(0.0))
    return compared.withColumns(
        {
            "tokens_saved": saved,
            "percent_saved": percent,
            "ratio": F.when(applicable, F.concat(F.format_string("%.1f", times), F.lit("×"))).otherwise("n/a"),
            "applicable": applicable,
        }
    )


def mean_savings(saved: DataFrame) -> DataFrame:
    """Mean percentage saved over the targets to which it applies."""
    return saved.agg(
        F.avg(F.when(F.col("applicable"), F.col("percent_saved"))).alias("mean_percent_saved"),
        F.count_if("applicable").alias("applicable_targets"),
        F.count("*").alias("targets"),
    )


# Keyword in a task -> directories it implies.
KEYWORD_DIRECTORIES = (
    (r"middleware", ("middleware",)),
    (r"\broutes?\b", ("routes",)),
    (r"controllers?", ("controllers",)),
    (r"\bmodels?\b", ("models",)),
    (r"\butils?\b", ("utils",)),
    (r"\btests?\b|unit test|integration test", ("tests", "__tests__")),
    (r"\bconfig\b", ("config",)),
    (r"\bshared\b", ("shared",)),
    (r"\bauth\b|\bjwt\b", ("middleware", "auth")),
    (r"\blogger\b|logging", ("logger",)),
    (r"validat", ("validation", "validators")),
)
# Root files most sessions read.
STANDARD_FILES = (
    "readme.md",
    "package.json",
    "tsconfig.json",
    "tsconfig.base.json",
    "pnpm-workspace.yaml",
    ".npmrc",
    ".nvmrc",
)


def implied_directories(tasks: DataFrame) -> DataFrame:
    """``repo_id, segment``: directories the open tasks of a repository imply."""
    text = F.lower("text")
    named = [F.when(text.rlike(p), F.array(*map(F.lit, d))) for p, d in KEYWORD_DIRECTORIES]
    packages = F.regexp_extract_all(text, F.lit(r"packages/([\w-]+)"), 1)
    implied = F.concat(F.flatten(F.array_compact(F.array(*named))), packages)
    return unnest(tasks, ["repo_id"], implied, ["segment"]).distinct()


def developer_patterns(files: DataFrame, tasks: DataFrame) -> DataFrame:
    """Tokens and files of four ways to load a project, each containing the one before it.

    A repository's implied directories arrive as one array: they come from a fixed vocabulary and its
    package names.
    """
    implied = implied_directories(tasks).groupBy("repo_id").agg(F.collect_set("segment").alias("segments"))
    path = F.col("path")
    plan = is_plan_file(path)
    standard = plan | ((dirname(path) == ".") & F.lower(basename(path)).isin(*STANDARD_FILES))
    parts = F.transform(F.split(path, r"[/\\]", -1), F.lower)
    scoped = standard | F.coalesce(F.arrays_overlap(parts, F.col("segments")), F.lit(False))
    tokens = token_estimate_from_size(F.col("size_bytes"))
    sets = (("plan_only", plan), ("standard_context", standard), ("task_scoped", scoped), ("whole_project", F.lit(True)))
    measured = []
    for name, member in sets:
        measured.append(F.coalesce(F.sum(F.when(member, tokens)), F.lit(0)).alias(f"{name}_tokens"))
        measured.append(F.count_if(member).alias(f"{name}_files"))
    return _relevant(files).join(implied, "repo_id", "left").groupBy("repo_id").agg(*measured)
