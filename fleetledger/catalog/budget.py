"""Queries over file sizes and budgets."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetledger.catalog.history import rounded
from fleetledger.catalog.registry import query
from fleetledger.catalog.relations import RELATIONS, sql
from fleetledger.operators import budget
from fleetledger.functions.text import token_estimate_from_size
from fleetledger.sources import bindings as b

TOKENS = "CAST(ceil(size_bytes / 4) AS BIGINT)"

RELATIONS["costed"] = (("files",), f"SELECT repo_id, path, {TOKENS} AS tokens FROM files")
# Every repository's files under an owner: English files are always included, German ones lack a cost.
RELATIONS["entries"] = (
    ("files",),
    f"""SELECT repo_id, 'chunk-1' AS owner, path, lang,
               CASE WHEN lang = 'en' THEN 'always-include' ELSE 'context-files' END AS role,
               CASE WHEN lang = 'de' THEN NULL ELSE {TOKENS} END AS token_cost FROM files""",
)
RELATIONS["items"] = (
    ("entries",),
    """SELECT repo_id, owner, role AS component, path, CAST(coalesce(token_cost, 50) AS BIGINT) AS tokens FROM entries
       UNION ALL SELECT DISTINCT repo_id, owner, 'session-state', CAST(NULL AS VARCHAR), 120 FROM entries
       UNION ALL SELECT DISTINCT repo_id, owner, 'plan-chunk', CAST(NULL AS VARCHAR), 300 FROM entries""",
)
RELATIONS["totals"] = (
    ("items",),
    """SELECT repo_id, owner, sum(CASE WHEN component = 'session-state' THEN tokens ELSE 0 END) AS session_state,
              sum(CASE WHEN component = 'plan-chunk' THEN tokens ELSE 0 END) AS plan_chunk,
              sum(CASE WHEN component = 'context-files' THEN tokens ELSE 0 END) AS context_files,
              sum(CASE WHEN component = 'always-include' THEN tokens ELSE 0 END) AS always_include,
              sum(tokens) AS total_tokens FROM items GROUP BY ALL""",
)


def entries(spark, sf):
    lang = F.element_at(F.split("path", "/"), 2)
    return b.files(spark, sf).select(
        "repo_id",
        F.lit("chunk-1").alias("owner"),
        "path",
        F.when(lang == "en", "always-include").otherwise("context-files").alias("role"),
        F.when(lang != "de", token_estimate_from_size(F.col("size_bytes"))).alias("token_cost"),
    )


def items(spark, sf):
    listed = entries(spark, sf)
    owners = (
        listed.select("repo_id", "owner")
        .distinct()
        .withColumn("state_tokens", F.lit(120).cast("long"))
        .withColumn("chunk_tokens", F.lit(300).cast("long"))
    )
    return budget.budget_items(owners, listed)


@query(
    "a6_directory_sizes",
    sql(
        """SELECT repo_id, 'docs/' || lang AS directory, count(*) AS files, sum(size_bytes) AS total_size_bytes
           FROM files GROUP BY ALL""",
        "files",
    ),
)
def directory_sizes(spark, sf):
    return budget.group_by_directory(b.files(spark, sf))


@query("a8_flat_budget", sql("SELECT * FROM totals", "totals"))
def flat_budget(spark, sf):
    return budget.budgets(items(spark, sf)).drop("capped_tokens", "over_budget")


@query(
    "a10_cap_verdict",
    sql(
        """SELECT repo_id, owner, total_tokens, total_tokens - always_include AS capped_tokens,
                  total_tokens - always_include > 4000 AS over_budget FROM totals""",
        "totals",
    ),
)
def cap_verdict(spark, sf):
    judged = budget.budgets(items(spark, sf))
    return judged.select("repo_id", "owner", "total_tokens", "capped_tokens", "over_budget")


@query(
    "a11_budget_breakdown",
    sql(
        """SELECT i.repo_id, i.owner, i.component, i.path, i.tokens, i.level,
                  CAST(floor(i.tokens * 100.0 / t.total_tokens + 0.5) AS BIGINT) AS percent
           FROM (SELECT repo_id, owner, component, path, sum(tokens) AS tokens, 'file' AS level FROM items GROUP BY ALL
                 UNION ALL SELECT repo_id, owner, component, NULL, sum(tokens), 'component' FROM items
                   GROUP BY repo_id, owner, component
                 UNION ALL SELECT repo_id, owner, NULL, NULL, sum(tokens), 'total' FROM items GROUP BY repo_id, owner) i
           JOIN totals t USING (repo_id, owner)""",
        "totals",
    ),
)
def budget_breakdown(spark, sf):
    return budget.breakdown(items(spark, sf))


@query(
    "a12_measured_costs",
    sql(f"SELECT repo_id, owner, path, role, {TOKENS} AS token_cost FROM entries JOIN files USING (repo_id, path)",
        "entries"),
)
def measured_costs(spark, sf):
    return budget.with_measured_costs(entries(spark, sf), b.files(spark, sf))


@query(
    "w5_greedy_trim",
    sql(
        """SELECT repo_id, path, tokens, freed_before FROM (
             SELECT *, sum(tokens) OVER (PARTITION BY repo_id) AS total,
                    coalesce(sum(tokens) OVER (PARTITION BY repo_id ORDER BY tokens DESC, path
                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS freed_before FROM costed)
           WHERE total - freed_before > 4000""",
        "costed",
    ),
)
def greedy_trim(spark, sf):
    costed = b.files(spark, sf).select(
        "repo_id", "path", token_estimate_from_size(F.col("size_bytes")).alias("tokens")
    )
    return budget.greedy_exclusions(costed.withColumn("already_excluded", F.lit(False)), 4000)


@query(
    "l3_candidates_by_size",
    sql(
        """SELECT repo_id, path, tokens, row_number() OVER (PARTITION BY repo_id ORDER BY tokens DESC, path) AS position
           FROM costed""",
        "costed",
    ),
)
def candidates_by_size(spark, sf):
    return budget.candidates_by_size(b.files(spark, sf))


@query(
    "l5_file_cap",
    sql(
        """SELECT repo_id, path, CAST(position AS INTEGER) AS position FROM (
             SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY path) AS position FROM files)
           WHERE position <= 20""",
        "files",
    ),
)
def file_cap(spark, sf):
    return budget.file_cap(b.files(spark, sf).select("repo_id", "path"), 20)


@query(
    "a20_baseline",
    sql("SELECT repo_id, sum(tokens) AS total_tokens, count(*) AS file_count FROM costed GROUP BY repo_id", "costed"),
)
def baseline(spark, sf):
    return budget.baseline(b.files(spark, sf))


@query(
    "l2_largest_files",
    sql(
        """SELECT repo_id, path, tokens, CAST(rank AS INTEGER) AS rank FROM (
             SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY tokens DESC, path) AS rank FROM costed)
           WHERE rank <= 10""",
        "costed",
    ),
)
def largest_files(spark, sf):
    return budget.largest_files(b.files(spark, sf))


RELATIONS["saved"] = (
    ("files",),
    f"""SELECT repo_id, without_tokens, with_tokens, with_file_count, without_tokens - with_tokens AS tokens_saved,
               CASE WHEN with_file_count > 0 THEN (without_tokens - with_tokens) * 100.0 / without_tokens ELSE 0.0 END
                 AS percent_saved,
               CASE WHEN with_file_count > 0 THEN
                 printf('%.1f', CASE WHEN with_tokens > 0 THEN without_tokens / with_tokens ELSE 0 END) || '×'
                 ELSE 'n/a' END AS ratio, with_file_count > 0 AS applicable
        FROM (SELECT repo_id, sum({TOKENS}) AS without_tokens,
                     coalesce(sum(CASE WHEN lang = 'es' THEN {TOKENS} END), 0) AS with_tokens,
                     count_if(lang = 'es') AS with_file_count FROM files GROUP BY repo_id)""",
)


def compared(spark, sf):
    tokens = token_estimate_from_size(F.col("size_bytes"))
    handed_over = F.col("path").startswith("docs/es/")
    return b.files(spark, sf).groupBy("repo_id").agg(
        F.sum(tokens).alias("without_tokens"),
        F.coalesce(F.sum(F.when(handed_over, tokens)), F.lit(0)).alias("with_tokens"),
        F.count_if(handed_over).alias("with_file_count"),
    )


@query(
    "a18_savings",
    sql("SELECT * REPLACE (round(percent_saved, 6) AS percent_saved) FROM saved", "saved"),
)
def savings(spark, sf):
    return rounded(budget.savings(compared(spark, sf)), "percent_saved")


@query(
    "a19_mean_savings",
    sql(
        """SELECT round(avg(CASE WHEN applicable THEN percent_saved END), 6) AS mean_percent_saved,
                  count_if(applicable) AS applicable_targets, count(*) AS targets FROM saved""",
        "saved",
    ),
)
def mean_savings(spark, sf):
    return rounded(budget.mean_savings(budget.savings(compared(spark, sf))), "mean_percent_saved")
