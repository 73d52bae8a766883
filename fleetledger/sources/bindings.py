"""The analytics relations, read off the generic test tables.

Each function maps whole tables to one relation of ``schemas.py``; nothing is sampled or filtered away.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _doc_path() -> Column:
    return F.concat(F.lit("docs/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``repo_id, path, text, size_bytes``: one document is one file, its source is the repository."""
    return table(spark, sf_dir, "documents").select(
        F.col("source").alias("repo_id"),
        _doc_path().alias("path"),
        "text",
        F.octet_length("text").cast("long").alias("size_bytes"),
    )


def files_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``path, text`` of :func:`files` and ``lang``, the language a file is in; both may be unknown."""
    return table(spark, sf_dir, "documents").select(_doc_path().alias("path"), "text", "lang")


def files_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A later snapshot of :func:`files`: some files moved to an archive, some revised."""
    text = F.when(F.col("n_chars") % 5 == 0, F.concat("text", F.lit("\n\nrevised"))).otherwise(F.col("text"))
    path = F.when(
        F.col("n_chars") % 7 == 0,
        F.concat(F.lit("archive/"), F.col("doc_id").cast("string"), F.lit(".md")),
    ).otherwise(_doc_path())
    return table(spark, sf_dir, "documents").select(
        F.col("source").alias("repo_id"),
        path.alias("path"),
        text.alias("text"),
        F.octet_length(text).cast("long").alias("size_bytes"),
    )


def markdown_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """:func:`files` with headings, fences, tasks, mentions, hedges and keys planted by line position."""

    def planted(line: Column, pos: Column) -> Column:
        number = pos.cast("string")
        return (
            F.when(
                pos % 7 == 0,
                F.when(
                    pos % 3 == 0,
                    F.concat(F.lit("## Phase "), F.floor(pos / 7).cast("string"), F.lit(": "), line),
                )
                .when(pos % 3 == 1, F.concat(F.lit("### "), line))
                .otherwise(F.concat(F.lit("# "), line)),
            )
            .when(pos % 13 == 6, F.lit("  ```ts"))
            .when(pos % 11 == 3, F.concat(F.lit("- [ ] "), line))
            .when(pos % 11 == 5, F.concat(F.lit("- [x] "), line))
            .when(pos % 11 == 9, F.concat(F.lit("* [-] "), line))
            .when(
                pos % 5 == 2,
                F.concat(line, F.lit(" @docs/en/"), (F.col("doc_id") + pos).cast("string"), F.lit(".md")),
            )
            .when(pos % 9 == 4, F.concat(F.lit("maybe "), line))
            .when(pos % 17 == 1, F.concat(line, F.lit(" AKIA"), F.upper(F.substring(F.sha2(line, 256), 1, 16))))
            .when(pos % 19 == 8, F.concat(F.lit("> Depends on: Chunks 1, "), number))
            .when(pos % 23 == 10, F.concat(F.lit("> Est. sessions: "), number))
            .when(pos % 29 == 15, F.lit("---"))
            .otherwise(line)
        )

    text = F.array_join(F.transform(F.split("text", "\n", -1), planted), "\n")
    return table(spark, sf_dir, "documents").select(
        F.col("source").alias("repo_id"), _doc_path().alias("path"), "doc_id", text.alias("text")
    )


def _k() -> Column:
    return F.get_json_object("props", "$.k").cast("int")


def _src(number: Column) -> Column:
    return F.concat(F.lit("src/f"), number.cast("string"), F.lit(".ts"))


def context_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One log entry per event: views and clicks load files, purchases modify one."""
    none = F.array().cast("array<string>")
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("repo-"), F.floor(F.col("user_id") / 7).cast("string")).alias("repo_id"),
        F.concat(F.col("user_id").cast("string"), F.lit("-"), F.date_format("ts", "yyyy-MM-dd")).alias(
            "session_id"
        ),
        F.col("ts").cast("timestamp").alias("ts"),
        (F.col("user_id") % 9 + 1).cast("decimal(10,3)").alias("active_chunk"),
        F.when(F.col("event_type").isin("view", "click"), F.array(_src(_k()), _src((_k() * 3) % 40)))
        .otherwise(none)
        .alias("files_loaded"),
        F.when(F.col("event_type") == "purchase", F.array(_src(_k()))).otherwise(none).alias("modifications"),
        F.round("value").cast("long").alias("total_tokens"),
        "event_id",
    )


def log_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indexed paths of the log's repositories: the files errors and signups mention."""
    mentioned = table(spark, sf_dir, "events").where(F.col("event_type").isin("error", "signup"))
    return mentioned.select(
        F.concat(F.lit("repo-"), F.floor(F.col("user_id") / 7).cast("string")).alias("repo_id"),
        _src(_k()).alias("path"),
        (_k() % 10 == 0).alias("always_include"),
    ).distinct()


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One commit per event; signups write the prompt and are the session boundaries."""
    return table(spark, sf_dir, "events").select(
        _history_repo(),
        F.col("event_id").alias("ordinal"),
        F.concat(F.lit("c"), F.col("event_id").cast("string")).alias("sha"),
        F.col("ts").alias("commit_ts"),
        (F.col("event_type") == "signup").alias("is_boundary"),
    )


def _history_repo() -> Column:
    return F.concat(F.lit("repo-"), F.col("user_id").cast("string")).alias("repo_id")


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prompt text each boundary commit wrote."""
    text = F.concat(
        F.lit("Session prompt\n  Load: "),
        _src(_k() % 10),
        F.lit(", @"),
        _src(F.floor(_k() / 10)),
        F.lit("·L1, docs/guide.md, +2 more\nPlan: .session/PLAN_1.md\nFocus (read_unit): "),
        _src((_k() * 7) % 10),
        F.lit("#run:1-9\nNote: see src/none.ts"),
    )
    boundary = table(spark, sf_dir, "events").where(F.col("event_type") == "signup")
    return boundary.select(
        _history_repo(),
        F.concat(F.lit("c"), F.col("event_id").cast("string")).alias("sha"),
        text.alias("text"),
    )


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files written by purchase and error commits, with the blob they left behind."""
    path = F.when(_k() % 11 == 0, F.lit("docs/notes.md")).otherwise(_src(_k() % 10))
    changed = table(spark, sf_dir, "events").where(F.col("event_type").isin("purchase", "error"))
    return changed.select(
        _history_repo(),
        F.col("event_id").alias("ordinal"),
        path.alias("path"),
        F.concat(F.lit("b"), (F.floor("value") % 3).cast("string")).alias("blob"),
    )


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One plan chunk per order; the customer segment of keys is the repository."""
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("repo-"), (F.col("o_custkey") % 20).cast("string")).alias("repo_id"),
        F.col("o_orderkey").alias("chunk_id"),
        F.concat(F.lit("Order for "), F.col("o_custkey").cast("string")).alias("title"),
        F.array(F.col("o_orderkey") - 1, F.col("o_orderkey") + F.col("o_custkey")).alias("depends_on"),
        F.col("o_orderstatus").alias("state"),
        F.col("o_orderdate").alias("last_updated"),
        F.ceil(F.col("o_totalprice") / 100).cast("long").alias("brief_tokens"),
    )


def _line_status() -> Column:
    return (
        F.when(F.col("l_linestatus") == "F", "done")
        .when(F.col("l_returnflag") == "N", "todo")
        .otherwise("in-progress")
    )


def _task_no() -> Column:
    return (
        F.col("l_linenumber").cast("long") * 1_000_000_000_000
        + F.col("l_partkey") * 1_000_000
        + F.col("l_suppkey")
    ).alias("task_no")


def _task_text() -> Column:
    return F.concat(
        F.lit("Update `Part"),
        F.col("l_partkey").cast("string"),
        F.lit("` in s"),
        F.col("l_suppkey").cast("string"),
        F.lit(".ts, then p"),
        F.col("l_partkey").cast("string"),
        F.lit("/s"),
        F.col("l_suppkey").cast("string"),
        F.lit(".ts."),
    ).alias("text")


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One task per order line; ``task_no`` orders the tasks of a chunk."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("chunk_id"),
        _task_no(),
        _task_text(),
        _line_status().alias("status"),
        F.ceil("l_extendedprice").cast("long").alias("tokens"),
        F.concat(
            F.lit("src/p"),
            F.col("l_partkey").cast("string"),
            F.lit("/s"),
            F.col("l_suppkey").cast("string"),
            F.lit(".ts"),
        ).alias("path"),
    )


def gathered_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``l_orderkey, lines``: the lines of each order, with the status of their tasks.

    What is read of them afterwards doesn't reach below their gathering, so that all units, imports and tasks of a query
    read one shuffle of the lines, which holds numbers and no text made of them.
    """
    columns = ("l_linenumber", "l_suppkey", "l_partkey", "l_quantity", "status")
    lines = table(spark, sf_dir, "lineitem").where("l_orderkey IS NOT NULL").withColumn("status", _line_status())
    gathered = lines.select("l_orderkey", *columns).repartition("l_orderkey").groupBy("l_orderkey")
    return gathered.agg(F.collect_list(F.struct(*columns)).alias("lines"))


def orders_with_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``repo_id, l_orderkey, lines``: each order that has lines, its priority being the repository."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderpriority").alias("repo_id"))
    return gathered_lines(spark, sf_dir).join(orders, "l_orderkey")


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of :func:`orders_with_lines`, one row each."""
    return orders_with_lines(spark, sf_dir).select("repo_id", "l_orderkey", F.inline("lines"))


def ordered_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``repo_id, chunk_id, task_no, text, status, l_suppkey`` of :func:`tasks`, by the priority of their order."""
    lines = order_lines(spark, sf_dir)
    return lines.select("repo_id", F.col("l_orderkey").alias("chunk_id"), _task_no(), _task_text(), "status", "l_suppkey")


def gathered_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``chunk_id, text, status`` of :func:`tasks`, read off the gathered lines."""
    lines = gathered_lines(spark, sf_dir).select("l_orderkey", F.inline("lines"))
    return lines.select(F.col("l_orderkey").alias("chunk_id"), _task_text(), "status")


# A path per event, covering the shapes a repository and its users produce. Valid in both dialects.
RAW_PATH_SQL = """CASE k % 26
  WHEN 0 THEN concat('src/app', n, '.ts') WHEN 1 THEN concat('node_modules/p', n, '/index.js')
  WHEN 2 THEN 'dist/out.js' WHEN 3 THEN concat('../outside/x', n, '.ts') WHEN 4 THEN '/etc/passwd'
  WHEN 5 THEN concat('C:/win/x', n, '.ts') WHEN 6 THEN 'a/../../b.ts' WHEN 7 THEN concat('a/b/../c', n, '.ts')
  WHEN 8 THEN 'src/__proto__/x.ts' WHEN 9 THEN 'pnpm-lock.yaml' WHEN 10 THEN concat('pkg', n, '/Cargo.lock')
  WHEN 11 THEN concat('docs/PLAN_', n, '.md') WHEN 12 THEN 'plan.MD' WHEN 13 THEN 'src/index.ts'
  WHEN 14 THEN 'index.tsx' WHEN 15 THEN concat('lib/util', n, '.test.ts') WHEN 16 THEN 'README.md'
  WHEN 17 THEN '.npmrc' WHEN 18 THEN concat('conf/app', n, '.yaml') WHEN 19 THEN concat('odd name (', n, ').ts')
  WHEN 20 THEN concat('src', chr(92), 'win', chr(92), 'x.ts') WHEN 21 THEN 'packages/core/tsconfig.json'
  WHEN 22 THEN '.session/STATE.md' WHEN 23 THEN concat('logs/deep/er/x', n, '.log')
  WHEN 24 THEN concat('a.ts/b', n, '.tsx.ts') ELSE concat('build/k', n, '/') END"""

# A word per event, as it may stand in prose around a file name.
RAW_WORD_SQL = """CASE k % 13
  WHEN 0 THEN concat('(src/a', n, '.ts),') WHEN 1 THEN concat('`lib/x.', n, '`') WHEN 2 THEN './pkg//y.go.'
  WHEN 3 THEN concat('../up', n, '.ts') WHEN 4 THEN 'a/b/../c.py' WHEN 5 THEN '/abs/z.ts' WHEN 6 THEN 'plainword'
  WHEN 7 THEN concat('[docs/d', n, '.md]!') WHEN 8 THEN '...' WHEN 9 THEN 'x/../../y.ts'
  WHEN 10 THEN 'v1.2.3' WHEN 11 THEN concat('dir', n, '/') ELSE concat('"q', n, '.test.tsx";') END"""


def raw_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``repo_id, event_id, path, word``: user-supplied paths and words, one of each per event."""
    numbered = table(spark, sf_dir, "events").select(
        _history_repo(), "event_id", F.get_json_object("props", "$.k").alias("k_text"), F.col("user_id").cast("string").alias("n")
    )

    def of_k(case: str) -> Column:
        # bound before the branches use it, or the optimizer reads the JSON again in each of them
        return F.expr(f"transform(array(CAST(k_text AS INT)), k -> {case})[0]")

    return numbered.select("repo_id", "event_id", of_k(RAW_PATH_SQL).alias("path"), of_k(RAW_WORD_SQL).alias("word"))


IGNORE_FILE_SQL = """concat('# ignore', chr(10), '  dist/ ', chr(10), chr(10), '*.log', chr(10), '!keep.log', chr(10),
  '**/*.yaml', chr(10), '**/index.ts', chr(10), CASE WHEN c_nationkey % 2 = 0 THEN 'logs' ELSE 'a.ts' END)"""


def ignore_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One ignore file per repository."""
    return table(spark, sf_dir, "customer").select(
        F.concat(F.lit("repo-"), F.col("c_custkey").cast("string")).alias("repo_id"),
        F.expr(IGNORE_FILE_SQL).alias("text"),
    )
