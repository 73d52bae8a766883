"""Queries over Markdown plans and over chunks and tasks."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetledger.catalog.registry import query
from fleetledger.catalog.relations import RELATIONS, WS, sql, trim
from fleetledger.functions import markdown as md
from fleetledger.functions.binding import unnest
from fleetledger.operators import plans
from fleetledger.sources import bindings as b

_POSITION = r"'(?i)^(?:(chunk|phase|step|milestone|part|stage|sprint)\s+)?(\d+(?:\.\d+)?)\b'"
_STATUS = r"""CASE WHEN regexp_matches(trimmed, '^[-*]\s+\[[xX]\]\s+.+$') THEN 'done'
  WHEN regexp_matches(trimmed, '^[-*]\s+\[-\]\s+.+$') THEN 'in-progress'
  WHEN regexp_matches(trimmed, '^[-*]\s+\[ \]\s+.+$') THEN 'todo' END"""
_TITLE = trim(r"regexp_extract(trimmed, '^(#{1,6})\s+(.+)$', 2)")
RELATIONS["md_titles"] = (("md_heads",), f"SELECT *, {_TITLE} AS title FROM md_heads WHERE depth > 0")
RELATIONS["census"] = (
    ("md_titles",),
    f"""SELECT repo_id, path, depth, count(*) AS headings,
               count_if(regexp_matches(title, {_POSITION})) AS declaring FROM md_titles GROUP BY ALL""",
)
RELATIONS["split"] = (
    ("census",),
    """SELECT repo_id, path, CASE WHEN max(declaring) > 0 THEN arg_max(depth, declaring * 10 - depth)
         WHEN max(headings) > 1 THEN min(CASE WHEN headings > 1 THEN depth END) ELSE min(depth) END AS split_depth
       FROM (SELECT *, max(declaring) OVER (PARTITION BY path) AS top FROM census) GROUP BY repo_id, path""",
)
RELATIONS["placed"] = (
    ("md_heads", "split"),
    f"""SELECT *, {_STATUS} AS status, max(CASE WHEN starts THEN pos END) OVER (PARTITION BY path ORDER BY pos
               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section_pos
        FROM (SELECT h.*, s.split_depth, h.depth BETWEEN 1 AND s.split_depth AS starts
              FROM md_heads h JOIN split s USING (repo_id, path))""",
)
RELATIONS["secs"] = (
    ("placed", "md_titles"),
    f"""SELECT *, max(CASE WHEN at_split THEN declared_value END) OVER (PARTITION BY path) IS NOT NULL AS declared_mode
        FROM (SELECT p.repo_id, p.path, p.section_pos, any_value(t.title) AS heading,
                any_value(t.depth) = any_value(p.split_depth) AS at_split,
                TRY_CAST(nullif(regexp_extract(any_value(t.title), {_POSITION}, 2), '') AS DECIMAL(10, 3))
                  AS declared_value,
                count_if(p.status IS NOT NULL AND p.pos > p.section_pos) AS tasks,
                count_if(p.pos > p.section_pos) AS body_lines
              FROM placed p JOIN md_titles t ON t.path = p.path AND t.pos = p.section_pos GROUP BY ALL)""",
)
RELATIONS["kept"] = (
    ("secs",),
    """SELECT *, row_number() OVER (PARTITION BY path ORDER BY section_pos) AS ordinal FROM secs
       WHERE at_split AND CASE WHEN declared_value IS NULL THEN NOT declared_mode ELSE declared_value >= 1 END""",
)


@query(
    "w1_fence_state",
    sql("SELECT repo_id, path, CAST(pos AS INTEGER) AS pos, in_fence, md5(raw) AS digest FROM md_scan", "md_scan"),
)
def fence_state(spark, sf):
    lines = plans.line_states(b.markdown_files(spark, sf))
    return lines.select("repo_id", "path", "pos", "in_fence", F.md5("raw").alias("digest"))


@query(
    "sc9_headings",
    sql("SELECT path, pos + 1 AS line, depth, title FROM md_titles", "md_titles"),
)
def headings(spark, sf):
    lines = plans.line_states(b.markdown_files(spark, sf)).withColumn(
        "depth", F.when(F.col("in_fence"), 0).otherwise(md.heading_depth(F.col("trimmed")))
    )
    return lines.where("depth > 0").select(
        "path", (F.col("pos") + 1).alias("line"), "depth", md.heading_text(F.col("trimmed")).alias("title")
    )


@query(
    "sc10_declared_position",
    sql(
        rf"""SELECT path, pos + 1 AS line, nullif(lower(regexp_extract(title, {_POSITION}, 1)), '') AS noun,
                    TRY_CAST(nullif(regexp_extract(title, {_POSITION}, 2), '') AS DECIMAL(10, 3)) AS number,
                    CASE WHEN regexp_matches(title, {_POSITION}) THEN coalesce(nullif({trim(
                      "regexp_replace(substr(title, length(regexp_extract(title, " + _POSITION + r", 0)) + 1), '^\s*[—–\-:.]?\s*', '')")}, ''),
                      title) END AS declared_title FROM md_titles""",
        "md_titles",
    ),
)
def declared_position(spark, sf):
    heads = headings(spark, sf)
    title = F.col("title")
    return heads.select(
        "path",
        "line",
        md.position_noun(title).alias("noun"),
        md.position_value(title).alias("number"),
        md.position_title(title).alias("declared_title"),
    )


@query(
    "sc11_task_lines",
    sql(
        rf"""SELECT path, pos + 1 AS line, {_STATUS} AS status,
                    {trim(r"regexp_extract(trimmed, '^[-*]\s+\[[ xX-]\]\s+(.+)$', 1)")} AS text
             FROM md_trim WHERE ({_STATUS}) IS NOT NULL""",
        "md_trim",
    ),
)
def task_lines(spark, sf):
    lines = plans.line_states(b.markdown_files(spark, sf))
    status = md.task_status(F.col("trimmed"))
    return lines.where(status.isNotNull()).select(
        "path", (F.col("pos") + 1).alias("line"), status.alias("status"), md.task_text(F.col("trimmed")).alias("text")
    )


@query(
    "sc12_est_sessions",
    sql(
        r"""SELECT path, pos + 1 AS line, CAST(regexp_extract(trimmed, '(?i)est\.?\s*sessions?:\s*(\d+)', 1) AS INTEGER)
              AS sessions FROM md_trim WHERE regexp_matches(trimmed, '(?i)est\.?\s*sessions?:\s*0*[1-9]')""",
        "md_trim",
    ),
)
def est_sessions(spark, sf):
    lines = plans.line_states(b.markdown_files(spark, sf)).withColumn("sessions", md.est_sessions(F.col("trimmed")))
    return lines.where("sessions IS NOT NULL").select("path", (F.col("pos") + 1).alias("line"), "sessions")


@query(
    "sc13_dependencies",
    sql(
        r"""SELECT path, pos + 1 AS line, TRY_CAST(trim(unnest(string_split(regexp_extract(trimmed,
                '(?i)depends\s+on:\s*(?:chunks?\s+)?([\d.,\s]+)', 1), ','))) AS DECIMAL(10, 3)) AS depends_on
            FROM md_trim WHERE regexp_matches(trimmed, '(?i)depends\s+on:\s*(?:chunks?\s+)?\d')""",
        "md_trim",
    ),
)
def dependencies(spark, sf):
    lines = plans.line_states(b.markdown_files(spark, sf)).withColumn("line", F.col("pos") + 1)
    deps = md.dependencies(F.col("trimmed"), F.array().cast("array<string>"))
    return unnest(lines, ["path", "line"], deps, ["depends_on"])


@query(
    "sc14_boundary_confidence",
    sql(
        r"""SELECT path, pos + 1 AS line, CASE WHEN regexp_matches(trimmed, '^## ') THEN 1.0
              WHEN regexp_matches(trimmed, '^# ') THEN 0.7 WHEN regexp_matches(trimmed, '^---+$') THEN 0.5
              ELSE 0.3 END::DOUBLE AS confidence
            FROM md_trim WHERE regexp_matches(trimmed, '^(#+ \s*.+|---+)$')""",
        "md_trim",
    ),
)
def boundary_confidence(spark, sf):
    lines = plans.line_states(b.markdown_files(spark, sf)).withColumn(
        "confidence", md.boundary_confidence(F.col("trimmed"))
    )
    return lines.where("confidence IS NOT NULL").select("path", (F.col("pos") + 1).alias("line"), "confidence")


@query(
    "w13_boundary_ordinal",
    sql(
        r"""SELECT path, pos + 1 AS line, CASE WHEN regexp_matches(trimmed, '^---') THEN ''
                     ELSE regexp_extract(trimmed, '^#+ \s*(.+)$', 1) END AS heading,
                   row_number() OVER (PARTITION BY path ORDER BY pos) AS suggested_chunk_id
            FROM md_trim WHERE regexp_matches(trimmed, '^(#+ \s*.+|---+)$')""",
        "md_trim",
    ),
)
def boundary_ordinal(spark, sf):
    return plans.boundary_lines(b.markdown_files(spark, sf)).select("path", "line", "heading", "suggested_chunk_id")


@query("a22_depth_census", sql("SELECT * FROM census", "census"))
def depth_census(spark, sf):
    return plans.depth_census(b.markdown_files(spark, sf))


@query("a23_split_depth", sql("SELECT * FROM split", "split"))
def split_depth(spark, sf):
    return plans.split_depths(b.markdown_files(spark, sf))


@query(
    "w2_sections",
    sql(
        """SELECT repo_id, path, heading, section_pos + 1 AS line, at_split AS at_split_depth, declared_value,
                  body_lines FROM secs""",
        "secs",
    ),
)
def sections(spark, sf):
    return plans.section_rows(b.markdown_files(spark, sf)).select(
        "repo_id", "path", "heading", "line", "at_split_depth", "declared_value", F.size("body").alias("body_lines")
    )


@query(
    "w14_chunk_ordinal",
    sql(
        """SELECT repo_id, path, section_pos + 1 AS line, ordinal,
                  coalesce(declared_value, CAST(ordinal AS DECIMAL(10, 3))) AS chunk_id, tasks FROM kept""",
        "kept",
    ),
)
def chunk_ordinal(spark, sf):
    return plans.heading_chunks(b.markdown_files(spark, sf)).select(
        "repo_id", "path", "line", "ordinal", "chunk_id", F.size("tasks").alias("tasks")
    )


RELATIONS["excl"] = (
    ("secs",),
    """SELECT repo_id, path, heading, section_pos + 1 AS line, tasks AS task_count,
              CASE WHEN at_split AND declared_value < 1 THEN 'unrepresentable-id' ELSE 'no-position-declared' END AS reason
       FROM secs WHERE (NOT at_split AND tasks > 0) OR (at_split AND declared_mode AND declared_value IS NULL)
          OR (at_split AND declared_value < 1)""",
)


@query("a25_excluded_sections", sql("SELECT * FROM excl", "excl"))
def excluded_sections(spark, sf):
    return plans.excluded_sections(b.markdown_files(spark, sf))


RELATIONS["formats"] = (
    ("md_scan", "census", "split"),
    f"""SELECT *, CASE WHEN greatest(headings, task_list) < 0.3 THEN 'none' WHEN headings >= task_list THEN 'headings'
                    ELSE 'task-list' END AS format
        FROM (SELECT f.repo_id, f.path, CAST(CASE WHEN s.path IS NULL THEN 0 WHEN c.declaring > 0 THEN 0.95
                     WHEN c.headings > 1 THEN 0.6 WHEN f.tasks > 0 THEN 0.4 ELSE 0 END AS DOUBLE) AS headings,
                     CAST(CASE WHEN s.path IS NULL AND f.tasks > 0 THEN 0.5 ELSE 0 END AS DOUBLE) AS task_list
              FROM (SELECT repo_id, path, count_if(NOT in_fence AND ({_STATUS}) IS NOT NULL) AS tasks
                    FROM md_scan GROUP BY ALL) f
              LEFT JOIN split s USING (repo_id, path)
              LEFT JOIN census c ON c.path = s.path AND c.depth = s.split_depth)""",
)


@query("a24_format_confidence", sql("SELECT * FROM formats", "formats"))
def format_confidence(spark, sf):
    return plans.format_detection(b.markdown_files(spark, sf))


@query(
    "a25_plan_check",
    sql(
        """SELECT *, chunks > 0 AND empty_chunks = 0 AND lost_tasks = 0 AS ok FROM (
             SELECT f.repo_id, f.path, f.format, coalesce(k.n, 0) AS chunks, coalesce(k.empty, 0) AS empty_chunks,
                    CASE WHEN f.format = 'none' THEN 0 ELSE coalesce(e.lost, 0) END AS lost_tasks
             FROM formats f
             LEFT JOIN (SELECT path, count(*) AS n, count_if(tasks = 0) AS empty FROM kept GROUP BY 1) k
               ON k.path = f.path AND f.format <> 'none'
             LEFT JOIN (SELECT path, sum(task_count) AS lost FROM excl GROUP BY 1) e ON e.path = f.path)""",
        "formats",
        "kept",
        "excl",
    ),
)
def plan_check(spark, sf):
    return plans.plan_check(b.markdown_files(spark, sf))


@query(
    "s4_plan_chunks",
    sql(
        """SELECT k.path, k.ordinal, list_aggregate(list(p.status ORDER BY p.pos) FILTER (p.status IS NOT NULL),
                    'string_agg', ',') AS statuses
           FROM kept k JOIN placed p ON p.path = k.path AND p.section_pos = k.section_pos GROUP BY ALL""",
        "kept",
    ),
)
def plan_chunks(spark, sf):
    chunks = plans.heading_chunks(b.markdown_files(spark, sf))
    statuses = F.array_join(F.transform("tasks", lambda t: t["status"]), ",")
    return chunks.select("path", "ordinal", F.nullif(statuses, F.lit("")).alias("statuses"))


@query("sc17_section_file_refs")
def section_file_refs(spark, sf):
    chunks = plans.heading_chunks(b.markdown_files(spark, sf))
    return unnest(chunks, ["path", "ordinal"], F.col("files"), ["file"])


@query("sc18_section_brief")
def section_brief(spark, sf):
    chunks = plans.heading_chunks(b.markdown_files(spark, sf))
    return chunks.select("path", "ordinal", "brief")


@query(
    "sc24_section_prose",
    sql(
        rf"""SELECT path, section_pos + 1 AS line, {trim(r"regexp_replace(string_agg(bare, ' ' ORDER BY pos), '\s+', ' ', 'g')")} AS prose
             FROM (SELECT *, regexp_replace(trimmed, '^(?:[-*+]\s+|\d+[.)]\s+|>\s?)+', '') AS bare FROM placed
                   WHERE pos > section_pos AND NOT in_fence AND trimmed <> '' AND NOT starts_with(trimmed, '|')
                     AND NOT regexp_matches(trimmed, '^(?:-{{3,}}|\*{{3,}}|_{{3,}})$'))
             WHERE bare <> '' GROUP BY ALL""",
        "placed",
    ),
)
def section_prose(spark, sf):
    rows = plans.section_rows(b.markdown_files(spark, sf))
    return rows.select("path", "line", md.prose(F.col("body")).alias("prose")).where("prose <> ''")


# Chunks and tasks -----------------------------------------------------------


@query(
    "p18_complete_chunks",
    sql("SELECT chunk_id FROM tasks GROUP BY 1 HAVING bool_and(status = 'done')", "tasks"),
)
def complete_chunks(spark, sf):
    return plans.complete_chunks(b.tasks(spark, sf))


@query(
    "a14_task_counts",
    sql(
        """SELECT chunk_id, count(*) AS total, count_if(status = 'done') AS done,
                  count_if(status = 'in-progress') AS in_progress, count_if(status = 'todo') AS todo,
                  CAST(floor(count_if(status = 'done') * 100 / count(*) + 0.5) AS BIGINT) AS percent_complete
           FROM tasks GROUP BY 1""",
        "tasks",
    ),
)
def task_counts(spark, sf):
    return plans.task_counts(b.tasks(spark, sf))


@query(
    "w8_pending_order",
    sql(
        """SELECT chunk_id, task_no, status, row_number() OVER (PARTITION BY chunk_id
             ORDER BY CASE WHEN task_no = coalesce(wip, first) THEN 0 ELSE 1 END, task_no) AS position
           FROM (SELECT *, min(CASE WHEN status = 'in-progress' THEN task_no END) OVER (PARTITION BY chunk_id) AS wip,
                        min(task_no) OVER (PARTITION BY chunk_id) AS first FROM tasks WHERE status <> 'done')""",
        "tasks",
    ),
)
def pending_order(spark, sf):
    return plans.pending_order(b.tasks(spark, sf)).select("chunk_id", "task_no", "status", "position")


@query(
    "j29_merged_task_status",
    sql(
        """SELECT t.chunk_id, t.task_no, CASE WHEN r.rank > (CASE t.status WHEN 'done' THEN 2 WHEN 'in-progress' THEN 1
                     ELSE 0 END) THEN r.status ELSE t.status END AS status
           FROM tasks t LEFT JOIN (SELECT chunk_id, text, max(CASE s WHEN 'done' THEN 2 ELSE 0 END) AS rank,
                    CASE WHEN bool_or(s = 'done') THEN 'done' ELSE 'todo' END AS status
              FROM (SELECT l_orderkey AS chunk_id, CASE WHEN l_returnflag = 'A' THEN 'done' ELSE 'todo' END AS s,
                      'Update `Part' || l_partkey || '` in s' || l_suppkey || '.ts, then p' || l_partkey || '/s'
                        || l_suppkey || '.ts.' AS text FROM lineitem) GROUP BY 1, 2) r USING (chunk_id, text)""",
        "tasks",
    ),
)
def merged_task_status(spark, sf):
    tasks = b.tasks(spark, sf)
    recorded = b.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("chunk_id"),
        F.concat(F.lit("Update `Part"), "l_partkey", F.lit("` in s"), "l_suppkey", F.lit(".ts, then p"), "l_partkey",
                 F.lit("/s"), "l_suppkey", F.lit(".ts.")).alias("text"),
        F.when(F.col("l_returnflag") == "A", "done").otherwise("todo").alias("status"),
        F.col("l_shipdate").alias("completed_at"),
        F.col("l_linenumber").alias("task_no"),
    )
    return plans.merged_task_status(tasks, recorded).select("chunk_id", "task_no", "status")


@query(
    "j37_dangling_dependencies",
    sql(
        """SELECT repo_id, chunk_id, missing FROM (SELECT repo_id, chunk_id, unnest(depends_on) AS missing FROM chunks) w
           WHERE NOT EXISTS (SELECT 1 FROM chunks c WHERE c.repo_id = w.repo_id AND c.chunk_id = w.missing)""",
        "chunks",
    ),
)
def dangling_dependencies(spark, sf):
    return plans.dangling_dependencies(b.chunks(spark, sf))


@query(
    "p17_representable_chunks",
    sql("SELECT repo_id, chunk_id, chunk_id >= 1 AS representable FROM chunks", "chunks"),
)
def representable_chunks(spark, sf):
    return b.chunks(spark, sf).select("repo_id", "chunk_id", (F.col("chunk_id") >= md.MIN_CHUNK_ID).alias("representable"))


@query(
    "w11_next_chunk",
    sql("SELECT repo_id, chunk_id, lead(chunk_id) OVER (PARTITION BY repo_id ORDER BY chunk_id) AS next_chunk_id FROM chunks",
        "chunks"),
)
def next_chunk(spark, sf):
    return plans.next_chunks(b.chunks(spark, sf))


def _starts(spark, sf):
    """Each repository starts at the chunk of its latest order date, the largest id on a tie."""
    return b.chunks(spark, sf).groupBy("repo_id").agg(
        F.max_by("chunk_id", F.struct("last_updated", "chunk_id")).alias("start_id")
    )


@query(
    "w12_start_chunk",
    sql(
        """SELECT c.repo_id, s.start_id AS active_id, c.chunk_id AS completed_id FROM chunks c JOIN (
             SELECT repo_id, arg_max(chunk_id, (last_updated, chunk_id)) AS start_id FROM chunks GROUP BY 1) s USING (repo_id)
           WHERE c.chunk_id < s.start_id""",
        "chunks",
    ),
)
def start_chunk(spark, sf):
    return plans.start_at(b.chunks(spark, sf), _starts(spark, sf))


@query(
    "a27_completed_range",
    """SELECT repo_id, n, first, last, last - first = n - 1 AS consecutive,
              CASE WHEN n = 1 THEN 'Chunk ' || first || ' done.' WHEN last - first = n - 1
                   THEN 'Chunks ' || first || '-' || last || ' done.' ELSE 'Chunks ' || listed || ' done.' END AS summary
       FROM (SELECT 'cust-' || o_custkey AS repo_id, count(*) AS n, min(o_orderkey) AS first, max(o_orderkey) AS last,
               string_agg(o_orderkey::VARCHAR, ', ' ORDER BY o_orderkey) AS listed
             FROM orders GROUP BY 1)""",
)
def completed_range(spark, sf):
    done = b.table(spark, sf, "orders").select(
        F.concat(F.lit("cust-"), "o_custkey").alias("repo_id"), F.col("o_orderkey").alias("chunk_id")
    )
    return plans.completed_range(done)
