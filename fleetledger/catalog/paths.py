"""Queries for path predicates and inventories."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetledger.catalog.registry import query
from fleetledger.catalog.relations import K, RELATIONS, WS, sql, trim
from fleetledger.functions import paths as p
from fleetledger.functions import text as t
from fleetledger.functions.binding import unnest
from fleetledger.operators import inventory
from fleetledger.sources import bindings as b

RELATIONS["raw_paths"] = (
    (),
    f"""SELECT repo_id, event_id, {b.RAW_PATH_SQL} AS path, {b.RAW_WORD_SQL} AS word FROM (
          SELECT 'repo-' || user_id AS repo_id, event_id, {K} AS k, CAST(user_id AS VARCHAR) AS n FROM events)""",
)
RELATIONS["ignore_lines"] = (
    (),
    f"""SELECT repo_id, pos, line FROM (
          SELECT repo_id, unnest(range(len(parts))) AS pos, {trim('unnest(parts)')} AS line FROM (
            SELECT 'repo-' || c_custkey AS repo_id, string_split({b.IGNORE_FILE_SQL}, chr(10)) AS parts FROM customer))
        WHERE line <> '' AND NOT starts_with(line, '#')""",
)
RELATIONS["ignored"] = (
    ("raw_paths", "ignore_lines"),
    """SELECT DISTINCT r.event_id FROM raw_paths r JOIN ignore_lines i ON r.repo_id = i.repo_id
       WHERE NOT starts_with(line, '!') AND CASE
         WHEN ends_with(line, '/') THEN contains('/' || path || '/', '/' || line)
         WHEN starts_with(line, '*.') THEN ends_with(path, substr(line, 2))
         WHEN starts_with(line, '**/*.') THEN ends_with(path, substr(line, 5))
         WHEN starts_with(line, '**/') THEN ends_with('/' || path, substr(line, 3))
         ELSE list_contains(string_split(path, '/'), line) END""",
)
_BASE = "regexp_extract(path, '([^/]*)$', 1)"
_EXT = f"regexp_extract({_BASE}, '^.+?(\\.[^.]*)$', 1)"
_DIR = "CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '.' END"


def dips(path: str) -> str:
    """SQL: some prefix of the path holds more ``..`` than real segments."""
    return f"""len(list_filter(range(1, len(string_split({path}, '/')) + 1), lambda n:
        len(list_filter(string_split({path}, '/')[1:n], lambda s: s = '..'))
        > len(list_filter(string_split({path}, '/')[1:n], lambda s: s NOT IN ('', '.', '..'))))) > 0"""


def _paths(spark, sf):
    return b.raw_paths(spark, sf).select("event_id", "path")


def _flag(name, column, oracle):
    """Register a predicate over every path as ``event_id, path, matches``."""

    @query(name, sql(f"SELECT event_id, path, {oracle} AS matches FROM raw_paths", "raw_paths"))
    def run(spark, sf):
        return _paths(spark, sf).withColumn("matches", column(F.col("path")))


_flag(
    "p1_always_ignored",
    p.is_always_ignored,
    r"regexp_matches(path, '(^|[\\/])(node_modules|\.git|dist|build|\.session)([\\/]|$)')",
)
_flag("p3_within_depth", lambda c: p.depth(c) <= 2, "length(path) - length(replace(path, '/', '')) <= 1")
_flag(
    "p4_allowed_extension",
    lambda c: p.has_allowed_extension(c, (".ts", ".md")),
    f"{_EXT} IN ('.ts', '.md')",
)
_flag(
    "p5_scorable",
    p.is_scorable,
    "NOT (path LIKE '.session/%' OR path LIKE 'docs/%' OR path LIKE 'CHANGELOG.md%')",
)
_flag("p6_path_shaped", p.is_path_shaped, r"regexp_full_match(path, '[A-Za-z0-9._\-+@/]+')")
_flag(
    "p7_leaves_root",
    p.leaves_root,
    f"""starts_with(replace(path, chr(92), '/'), '/') OR regexp_matches(path, '^[A-Za-z]:')
        OR {dips("replace(path, chr(92), '/')")}""",
)
_flag(
    "p9_escaping_reference",
    p.is_escaping_ref,
    "starts_with(path, '/') OR regexp_matches(path, '^[A-Za-z]:') OR list_contains(string_split(path, '/'), '..')",
)
_flag(
    "p10_lockfile",
    p.is_lockfile,
    f"{_BASE} IN ({', '.join(repr(n) for n in p.LOCKFILE_NAMES)})",
)
_flag(
    "p11_plan_file",
    p.is_plan_file,
    r"regexp_full_match(path, '(docs[/\\])?([Pp][Ll][Aa][Nn])(_\d+)?\.[Mm][Dd]')",
)


@query(
    "p2_ignore_patterns",
    sql("SELECT event_id, path FROM raw_paths ANTI JOIN ignored USING (event_id)", "ignored"),
)
def not_ignored(spark, sf):
    patterns = inventory.ignore_patterns(b.ignore_files(spark, sf))
    return inventory.without_ignored(b.raw_paths(spark, sf), patterns).select("event_id", "path")


@query(
    "s22_ignore_file_patterns",
    sql("SELECT repo_id, string_agg(line, ' ' ORDER BY pos) AS patterns FROM ignore_lines GROUP BY repo_id",
        "ignore_lines"),
)
def ignore_file_patterns(spark, sf):
    listed = inventory.ignore_patterns(b.ignore_files(spark, sf))
    return listed.select("repo_id", F.array_join("patterns", " ").alias("patterns"))


@query(
    "s1_walk",
    sql(
        rf"""SELECT event_id, path FROM raw_paths ANTI JOIN ignored USING (event_id)
             WHERE NOT regexp_matches(path, '(^|[\\/])(node_modules|\.git|dist|build|\.session)([\\/]|$)')
               AND {_EXT} IN ('.ts', '.md', '.log') AND length(path) - length(replace(path, '/', '')) < 3""",
        "ignored",
    ),
)
def walk(spark, sf):
    patterns = inventory.ignore_patterns(b.ignore_files(spark, sf))
    listed = inventory.walk(b.raw_paths(spark, sf), patterns, max_depth=3, extensions=(".ts", ".md", ".log"))
    return listed.select("event_id", "path")


@query(
    "p8_unsafe_reason",
    sql(
        f"""SELECT event_id, path, CASE WHEN starts_with(path, '/') THEN 'absolute'
              WHEN list_has_any(string_split(path, '/'), ['__proto__', 'constructor', 'prototype'])
                THEN 'dangerous-segment'
              WHEN {dips('path')} THEN 'outside-root' END AS reason FROM raw_paths""",
        "raw_paths",
    ),
)
def unsafe_reason(spark, sf):
    return _paths(spark, sf).withColumn("reason", p.unsafe_reason(F.col("path")))


_NAMES = " ".join(f"WHEN {_BASE} = '{name}' THEN '{purpose}'" for name, purpose in p.PURPOSE_BY_NAME.items())


@query(
    "p19_inferred_purpose",
    sql(
        rf"""SELECT event_id, path, CASE {_NAMES}
              WHEN regexp_matches({_BASE}, '\.(test|spec)\.ts$')
                THEN 'Tests for ' || regexp_replace({_BASE}, '\.(test|spec)\.ts$', '')
              WHEN {_BASE} IN ('index.ts', 'index.tsx')
                THEN (CASE WHEN contains(path, '/') THEN {_DIR} ELSE 'Root' END) || ' entry point'
              WHEN {_EXT} = '.ts' THEN regexp_replace({_BASE}, '\.ts', '') || ' module'
              WHEN {_EXT} = '.tsx' THEN regexp_replace({_BASE}, '\.tsx', '') || ' module'
              WHEN {_EXT} = '.md' THEN 'Documentation'
              WHEN {_EXT} IN ('.json', '.yml', '.yaml') THEN 'Configuration' ELSE 'Project file' END AS purpose
            FROM raw_paths""",
        "raw_paths",
    ),
)
def inferred_purpose(spark, sf):
    return _paths(spark, sf).withColumn("purpose", p.infer_purpose(F.col("path")))


@query(
    "sc8_path_tokens",
    sql(
        r"""SELECT path, pos, list_aggregate(list_filter(string_split(regexp_replace(token, '\.+$', ''), '/'),
                    lambda s: s NOT IN ('', '.')), 'string_agg', '|') AS segments
            FROM (SELECT path, pos, unnest(regexp_extract_all(line, '[A-Za-z0-9_.\-/]+')) AS token FROM plain_lines)
            WHERE len(list_filter(string_split(regexp_replace(token, '\.+$', ''), '/'),
                    lambda s: s NOT IN ('', '.'))) > 0""",
        "plain_lines",
    ),
)
def path_tokens(spark, sf):
    lines = unnest(b.files(spark, sf), ["path"], t.lines_of(F.col("text")), ["pos", "line"])
    tokens = unnest(lines, ["path", "pos"], p.path_tokens(F.col("line")), ["s"])
    return tokens.select("path", "pos", F.array_join("s", "|").alias("segments"))


RELATIONS["bare_words"] = (
    ("raw_paths",),
    r"""SELECT event_id, word, regexp_replace(word, '^[("''\[<]+|[)"''\]>.,;:!]+$', '', 'g') AS bare FROM raw_paths""",
)


@query(
    "sc16_word_to_path",
    sql(
        rf"""SELECT event_id, word, CASE WHEN bare <> '' AND NOT starts_with(bare, '/') AND NOT ends_with(bare, '/')
               AND NOT ({dips('bare')}) AND regexp_full_match(regexp_extract(norm, '([^/]*)$', 1),
                 '[^.]+(\.[^.]+)*\.[A-Za-z][A-Za-z0-9]{{0,9}}') THEN norm END AS file
            FROM (SELECT *, regexp_replace(regexp_replace(regexp_replace(bare, '/+', '/', 'g'), '^\./', ''),
                    '[^/.]+/\.\./', '') AS norm FROM bare_words)""",
        "bare_words",
    ),
)
def word_to_path(spark, sf):
    return b.raw_paths(spark, sf).select("event_id", "word", p.word_to_file_path(F.col("word")).alias("file"))


@query(
    "p29_project_types",
    sql(
        r"""SELECT repo_id, 'unknown' AS tool,
                   CASE WHEN bool_or(path = 'package.json') THEN 'node' ELSE 'unknown' END AS project_type,
                   'none' AS workspace_type, bool_or(starts_with(path, '.session/')) AS has_session
            FROM raw_paths GROUP BY repo_id""",
        "raw_paths",
    ),
)
def project_types(spark, sf):
    return inventory.project_types(b.raw_paths(spark, sf))


@query(
    "p30_present_markers",
    sql(
        """SELECT DISTINCT repo_id, CASE WHEN path LIKE '.session/%' THEN '.session' ELSE path END AS marker
           FROM raw_paths WHERE path LIKE '.session/%' OR path IN ('README.md', '.npmrc', 'pnpm-lock.yaml')""",
        "raw_paths",
    ),
)
def present_markers(spark, sf):
    markers = ("README.md", ".npmrc", "pnpm-lock.yaml", ".session", "CLAUDE.md")
    return inventory.present_markers(b.raw_paths(spark, sf), markers)
