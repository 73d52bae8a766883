"""Queries over the context log."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetledger.catalog.registry import query
from fleetledger.catalog.relations import sql
from fleetledger.operators import memory
from fleetledger.sources import bindings as b

AS_OF = "2024-02-15 00:00:00"
_ACTIVITY = """act AS (SELECT i.repo_id, i.path, i.always_include, coalesce(l.n, 0) AS n, m.last_modified
  FROM log_index i LEFT JOIN loads l USING (repo_id, path) LEFT JOIN mods m USING (repo_id, path))"""


@query(
    "a2_log_stats",
    sql(
        """SELECT repo_id, count(*) AS total_sessions, strftime(min(ts), '%Y-%m-%d') AS first_date,
                  strftime(max(ts), '%Y-%m-%d') AS last_date,
                  CAST(floor(sum(total_tokens) / count(*) + 0.5) AS BIGINT) AS avg_tokens
           FROM context_log GROUP BY repo_id""",
        "context_log",
    ),
)
def log_stats(spark, sf):
    return memory.log_stats(b.context_log(spark, sf))


@query(
    "a3_file_activity",
    sql(
        """SELECT repo_id, path, coalesce(n, 0) AS loads, strftime(last_modified, '%Y-%m-%d %H:%M:%S') AS last_modified
           FROM loads FULL OUTER JOIN mods USING (repo_id, path)""",
        "loads",
        "mods",
    ),
)
def file_activity(spark, sf):
    activity = memory.file_activity(b.context_log(spark, sf))
    return activity.withColumn("last_modified", F.date_format("last_modified", "yyyy-MM-dd HH:mm:ss"))


@query(
    "a4_passive_loads",
    sql(
        """SELECT repo_id, path, n AS session_count, 'remove-from-always-include' AS suggestion
           FROM (SELECT i.*, l.n FROM log_index i JOIN loads l USING (repo_id, path)
                 ANTI JOIN mods USING (repo_id, path)) WHERE always_include AND n >= 3""",
        "log_index",
        "loads",
        "mods",
    ),
)
def passive_loads(spark, sf):
    always = b.log_index(spark, sf).where("always_include")
    return memory.passive_loads(b.context_log(spark, sf), always).drop("last_modified")


@query(
    "a5_staleness",
    sql(
        """SELECT * FROM (SELECT i.repo_id, i.path, coalesce(l.n, 0) AS session_count,
             CASE WHEN l.n >= 3 AND m.path IS NULL AND i.always_include THEN 'remove-from-always-include'
                  WHEN l.n >= 3 AND m.path IS NULL THEN 'remove-from-index'
                  WHEN l.n IS NULL AND (SELECT count(*) FROM context_log c WHERE c.repo_id = i.repo_id) >= 3
                    THEN 'investigate' END AS suggestion
           FROM log_index i LEFT JOIN loads l USING (repo_id, path) LEFT JOIN mods m USING (repo_id, path))
           WHERE suggestion IS NOT NULL""",
        "log_index",
        "loads",
        "mods",
    ),
)
def staleness(spark, sf):
    return memory.staleness(b.context_log(spark, sf), b.log_index(spark, sf))


@query(
    "l1_top_files",
    sql(
        """SELECT repo_id, path, n AS loads, CAST(rank AS INTEGER) AS rank FROM (
             SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY n DESC, path) AS rank FROM loads)
           WHERE rank <= 5""",
        "loads",
    ),
)
def top_files(spark, sf):
    return memory.top_files(b.context_log(spark, sf))


@query(
    "w16_recent_entries",
    sql(
        """SELECT repo_id, event_id, CAST(recency AS INTEGER) AS recency FROM (
             SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY ts DESC, event_id DESC) AS recency
             FROM context_log) WHERE recency <= 10""",
        "context_log",
    ),
)
def recent_entries(spark, sf):
    recent = memory.recent_entries(b.context_log(spark, sf), 10)
    return recent.select("repo_id", "event_id", "recency")


@query(
    "k3_idempotent_append",
    sql(
        """SELECT DISTINCT repo_id, session_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts FROM context_log c
           WHERE NOT EXISTS (SELECT 1 FROM context_log o WHERE o.repo_id = c.repo_id
             AND o.session_id = c.session_id AND o.ts = c.ts AND o.total_tokens < 20)""",
        "context_log",
    ),
)
def idempotent_append(spark, sf):
    log = b.context_log(spark, sf)
    fresh = memory.append_new(log.where("total_tokens < 20"), log)
    return fresh.select("repo_id", "session_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"))


@query(
    "k7_prune_counts",
    sql(
        f"""SELECT repo_id, count_if(ts < TIMESTAMP '{AS_OF}' - INTERVAL 1 MONTH) AS removed,
                   count_if(ts >= TIMESTAMP '{AS_OF}' - INTERVAL 1 MONTH) AS kept
            FROM context_log GROUP BY repo_id""",
        "context_log",
    ),
)
def prune_counts(spark, sf):
    _, removed = memory.prune(b.context_log(spark, sf), "1mo", F.to_timestamp(F.lit(AS_OF)))
    return removed


@query(
    "k7_prune_kept",
    sql(
        f"SELECT repo_id, event_id FROM context_log WHERE ts >= TIMESTAMP '{AS_OF}' - INTERVAL 20 DAY",
        "context_log",
    ),
)
def prune_kept(spark, sf):
    kept, _ = memory.prune(b.context_log(spark, sf), "20d", F.to_timestamp(F.lit(AS_OF)))
    return kept.select("repo_id", "event_id")


@query(
    "a21_index_quantile",
    """SELECT event_type, list_sort(list(value))[CAST(least(floor(0.9 * count(*)), count(*) - 1) AS BIGINT) + 1]
         AS quantile FROM events GROUP BY event_type""",
)
def index_quantile(spark, sf):
    return memory.index_quantile(b.table(spark, sf, "events"), ["event_type"], "value", 0.9)
