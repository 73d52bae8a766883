"""Plans written as Markdown: sections, chunks, tasks, and the checks on them.

``files`` has ``repo_id, path, text``. A plan is one row until its chunks are exploded, so reading
plans moves no data between tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from fleetledger.functions import markdown as md
from fleetledger.functions.binding import let, unnest
from fleetledger.operators.ordered import next_value

MIN_CONFIDENCE = 0.3
SINGLE_CHUNK_TITLE = "Tasks"
STATUS_RANK = {"todo": 0, "in-progress": 1, "done": 2}


def scanned(files: DataFrame) -> DataFrame:
    """Files with their scanned ``lines`` and the ``heads`` (depth, declares a position) outside fences."""
    with_lines = files.withColumn("lines", md.scan_lines(F.col("text")))
    found = F.filter(F.col("lines"), lambda l: md.unfenced_depth(l) > 0)
    return with_lines.withColumn(
        "heads",
        F.transform(
            found,
            lambda l: F.struct(
                md.heading_depth(l["trimmed"]).alias("depth"),
                md.position_value(md.heading_text(l["trimmed"])).isNotNull().alias("declares"),
            ),
        ),
    )


def line_states(files: DataFrame) -> DataFrame:
    """``repo_id, path, pos, raw, trimmed, in_fence``, one row per line."""
    return unnest(files, ["repo_id", "path"], md.scan_lines(F.col("text")))


def depth_census(files: DataFrame) -> DataFrame:
    """Headings, and headings that declare a position, per depth of each file."""
    heads = unnest(scanned(files), ["repo_id", "path"], F.col("heads"))
    return heads.groupBy("repo_id", "path", "depth").agg(
        F.count("*").alias("headings"), F.count_if("declares").alias("declaring")
    )


def _split_depth(heads: Column) -> Column:
    """Most declaring depth, the shallowest on a tie; else the first with two headings; else the first."""

    def census(depth: int) -> Column:
        at_depth = F.filter(heads, lambda h: h["depth"] == depth)
        return F.struct(
            F.lit(depth).alias("depth"),
            F.size(at_depth).alias("headings"),
            F.size(F.filter(at_depth, lambda h: h["declares"])).alias("declaring"),
        )

    per_depth = F.array(*[census(d) for d in range(1, 7)])

    def choose(used: Column) -> Column:
        ranked = F.transform(used, lambda c: F.struct(c["declaring"].alias("n"), (-c["depth"]).alias("d")))
        repeated = F.get(F.filter(used, lambda c: c["headings"] > 1), 0)["depth"]
        fallback = F.coalesce(repeated, F.get(used, 0)["depth"])
        return let(F.array_max(ranked), lambda best: F.when(best["n"] > 0, -best["d"]).otherwise(fallback))

    return let(F.filter(per_depth, lambda c: c["headings"] > 0), choose)


def split_depths(files: DataFrame) -> DataFrame:
    return scanned(files).select("repo_id", "path", _split_depth(F.col("heads")).alias("split_depth"))


def _enriched(section: Column, split_depth: Column) -> Column:
    return F.struct(
        section["heading"].alias("heading"),
        section["line"].alias("line"),
        (section["depth"] == split_depth).alias("at_split_depth"),
        md.position_value(section["heading"]).alias("declared_value"),
        md.position_title(section["heading"]).alias("declared_title"),
        md.position_noun(section["heading"]).alias("noun"),
        section["body"].alias("body"),
    )


def _sectioned(files: DataFrame) -> DataFrame:
    """One row per file with ``plan``: its ``sections``, ``declared_mode`` and the ``nouns`` it numbers by."""

    def plan(sections: Column) -> Column:
        at_split = F.filter(sections, lambda s: s["at_split_depth"])
        return F.struct(
            sections.alias("sections"),
            F.exists(at_split, lambda s: s["declared_value"].isNotNull()).alias("declared_mode"),
            F.array_compact(F.transform(at_split, lambda s: s["noun"])).alias("nouns"),
        )

    def cut(lines: Column, depth: Column) -> Column:
        return F.transform(md.sections(lines, depth), lambda s: _enriched(s, depth))

    whole = F.struct("lines", _split_depth(F.col("heads")).alias("depth"))
    return scanned(files).withColumn("plan", let(let(whole, lambda w: cut(w["lines"], w["depth"])), plan))


def section_rows(files: DataFrame) -> DataFrame:
    """``repo_id, path, heading, line, at_split_depth, declared_value, body``, one row per section."""
    return unnest(_sectioned(files), ["repo_id", "path"], F.col("plan.sections")).drop("noun", "declared_title")


def _task_count(body: Column) -> Column:
    return F.size(F.filter(body, lambda l: md.task_status(l["trimmed"]).isNotNull()))


def _kept(section: Column, declared_mode: Column) -> Column:
    value = section["declared_value"]
    return section["at_split_depth"] & F.when(value.isNull(), ~declared_mode).otherwise(value >= md.MIN_CHUNK_ID)


def _tasks(lines: Column) -> Column:
    found = F.filter(lines, lambda l: md.task_status(l["trimmed"]).isNotNull())
    return F.transform(
        found,
        lambda l: F.struct(md.task_text(l["trimmed"]).alias("text"), md.task_status(l["trimmed"]).alias("status")),
    )


def _plan_fields(body: Column, nouns: Column) -> dict[str, Column]:
    other = F.filter(body, lambda l: md.task_status(l["trimmed"]).isNull())
    deps = F.filter(
        F.transform(other, lambda l: md.dependencies(l["trimmed"], nouns)), lambda d: F.size(d) > 0
    )
    sessions = F.filter(F.transform(other, lambda l: md.est_sessions(l["trimmed"])), lambda n: n.isNotNull())
    return {
        "depends_on": F.coalesce(F.get(deps, 0), F.array().cast("array<decimal(10,3)>")),
        "est_sessions": F.get(sessions, 0),
        "tasks": _tasks(body),
        "files": md.file_refs(body),
        "brief": md.brief(body),
    }


def heading_chunks(files: DataFrame) -> DataFrame:
    """Chunks of plans cut at their split depth. A declared number wins over the running ordinal."""

    def numbered(plan: Column) -> Column:
        kept = F.filter(plan["sections"], lambda s: _kept(s, plan["declared_mode"]))
        return F.transform(
            kept,
            lambda s, i: F.struct(
                (i + 1).alias("ordinal"),
                F.coalesce(s["declared_value"], (i + 1).cast("decimal(10,3)")).alias("chunk_id"),
                F.coalesce(s["declared_title"], s["heading"]).alias("title"),
                s["line"].alias("line"),
                s["body"].alias("body"),
                plan["nouns"].alias("nouns"),
            ),
        )

    exploded = unnest(_sectioned(files), ["repo_id", "path"], let(F.col("plan"), numbered))
    return exploded.withColumns(_plan_fields(F.col("body"), F.col("nouns"))).drop("body", "nouns")


def excluded_sections(files: DataFrame) -> DataFrame:
    """Sections that become no chunk, with the reason and the tasks they hold."""
    plan = _sectioned(files).select("repo_id", "path", "plan.declared_mode", "plan.sections")
    rows = unnest(plan, ["repo_id", "path", "declared_mode"], F.col("sections"))
    undeclared = F.col("at_split_depth") & F.col("declared_mode") & F.col("declared_value").isNull()
    below_one = F.col("at_split_depth") & (F.col("declared_value") < md.MIN_CHUNK_ID)
    return (
        rows.withColumn("task_count", _task_count(F.col("body")))
        .withColumn(
            "reason",
            F.when(~F.col("at_split_depth") & (F.col("task_count") > 0), "no-position-declared")
            .when(undeclared, "no-position-declared")
            .when(below_one, "unrepresentable-id"),
        )
        .where(F.col("reason").isNotNull())
        .select("repo_id", "path", "heading", "line", "task_count", "reason")
    )


def format_confidences(files: DataFrame) -> DataFrame:
    """``files`` with ``confidences``, a struct of the confidence of each built-in format: ``headings`` and ``task_list``."""

    def confidences(facts: Column) -> Column:
        heads, depth, tasks = facts["heads"], facts["depth"], facts["tasks"]
        at_split = F.filter(heads, lambda h: h["depth"] == depth)
        headings = (
            F.when(F.size(heads) == 0, 0.0)
            .when(F.exists(at_split, lambda h: h["declares"]), 0.95)
            .when(F.size(at_split) > 1, 0.6)
            .when(tasks > 0, 0.4)
            .otherwise(0.0)
        )
        task_list = F.when((F.size(heads) == 0) & (tasks > 0), 0.5).otherwise(0.0)
        return F.struct(headings.alias("headings"), task_list.alias("task_list"))

    tasks = F.size(F.filter("lines", lambda l: ~l["in_fence"] & md.task_status(l["trimmed"]).isNotNull()))
    facts = F.struct("heads", _split_depth(F.col("heads")).alias("depth"), tasks.alias("tasks"))
    return scanned(files).select(*files.columns, let(facts, confidences).alias("confidences"))


def format_detection(files: DataFrame) -> DataFrame:
    """Confidence of each plan format and the winner; ``none`` below the floor."""
    scored = format_confidences(files).select("repo_id", "path", "confidences.headings", "confidences.task_list")
    return scored.withColumn(
        "format",
        F.when(F.greatest("headings", "task_list") < MIN_CONFIDENCE, "none")
        .when(F.col("headings") >= F.col("task_list"), "headings")
        .otherwise("task-list"),
    )


def task_list_chunks(files: DataFrame) -> DataFrame:
    """The single chunk of each plan that has tasks and no headings."""
    lines = F.col("lines")
    listed = scanned(files).where(F.size("heads") == 0)
    unfenced = F.filter(lines, lambda l: ~l["in_fence"])
    return listed.select(
        "repo_id",
        "path",
        F.lit(1).cast("decimal(10,3)").alias("chunk_id"),
        F.lit(SINGLE_CHUNK_TITLE).alias("title"),
        _tasks(unfenced).alias("tasks"),
        md.file_refs(lines).alias("files"),
        md.brief(lines).alias("brief"),
    ).where(F.size("tasks") > 0)


def plan_check(files: DataFrame) -> DataFrame:
    """Whether each plan can be worked: it has chunks, none is empty, and no excluded section holds tasks."""
    key = ["repo_id", "path"]
    made = (
        heading_chunks(files).select(*key, F.size("tasks").alias("n"))
        .unionByName(task_list_chunks(files).select(*key, F.size("tasks").alias("n")))
        .groupBy(*key)
        .agg(F.count("*").alias("chunks"), F.count_if(F.col("n") == 0).alias("empty_chunks"))
    )
    lost = excluded_sections(files).groupBy(*key).agg(F.sum("task_count").alias("lost_tasks"))
    checked = format_detection(files).select(*key, "format").join(made, key, "left").join(lost, key, "left")
    usable = F.col("format") != "none"
    chunks = F.when(usable, F.coalesce("chunks", F.lit(0))).otherwise(0)
    return checked.select(
        *key,
        "format",
        chunks.alias("chunks"),
        F.when(usable, F.coalesce("empty_chunks", F.lit(0))).otherwise(0).alias("empty_chunks"),
        F.when(usable, F.coalesce("lost_tasks", F.lit(0))).otherwise(0).alias("lost_tasks"),
    ).withColumn("ok", (F.col("chunks") > 0) & (F.col("empty_chunks") == 0) & (F.col("lost_tasks") == 0))


def boundary_lines(files: DataFrame) -> DataFrame:
    """Lines that may start a chunk, with confidence and running number; front matter is skipped."""

    def classified(line: Column) -> Column:
        return F.struct(
            (line["pos"] + 1).alias("line"),
            md.boundary_heading(line["trimmed"]).alias("heading"),
            md.boundary_confidence(line["trimmed"]).alias("confidence"),
        )


    def found(lines: Column) -> Column:
        rule = F.get(F.filter(lines, lambda l: (l["pos"] > 0) & (l["trimmed"] == "---")), 0)["pos"]
        matter_end = F.when(F.get(lines, 0)["trimmed"] == "---", F.coalesce(rule, F.lit(-1))).otherwise(-1)
        body = let(matter_end, lambda end: F.filter(lines, lambda l: l["pos"] > end))
        return F.filter(F.transform(body, classified), lambda c: c["confidence"].isNotNull())

    rows = unnest(files, ["repo_id", "path"], let(md.scan_lines(F.col("text")), found), ["i", "b"])
    return rows.select(
        "repo_id", "path", "b.line", "b.heading", "b.confidence", (F.col("i") + 1).alias("suggested_chunk_id")
    )


def dangling_dependencies(chunks: DataFrame, keys: tuple[str, ...] = ("repo_id",)) -> DataFrame:
    """Dependencies on chunk ids the plan does not define, one row each."""
    wanted = chunks.select(*keys, "chunk_id", F.explode("depends_on").alias("missing"))
    defined = chunks.select(*keys, F.col("chunk_id").alias("missing")).distinct()
    return wanted.join(defined, [*keys, "missing"], "left_anti")


def merged_task_status(tasks: DataFrame, recorded: DataFrame) -> DataFrame:
    """Plan tasks with the further-along of their own and the recorded status for the same text."""

    def rank(status: str) -> Column:
        return F.when(F.col(status) == "done", 2).when(F.col(status) == "in-progress", 1).otherwise(0)

    furthest = recorded.groupBy("chunk_id", "text").agg(
        F.max_by(F.struct("status", "completed_at"), F.struct(rank("status"), -F.col("task_no"))).alias("other")
    )
    joined = tasks.join(furthest, ["chunk_id", "text"], "left")
    ahead = F.coalesce(rank("other.status") > rank("status"), F.lit(False)) & F.col("other").isNotNull()
    return joined.select(
        "chunk_id",
        "task_no",
        "text",
        F.when(ahead, F.col("other.status")).otherwise(F.col("status")).alias("status"),
        F.when(ahead, F.col("other.completed_at")).alias("completed_at"),
    )


def task_counts(tasks: DataFrame) -> DataFrame:
    status = F.col("status")
    counted = tasks.groupBy("chunk_id").agg(
        F.count("*").alias("total"),
        F.count_if(status == "done").alias("done"),
        F.count_if(status == "in-progress").alias("in_progress"),
        F.count_if(status == "todo").alias("todo"),
    )
    return counted.withColumn(
        "percent_complete", F.floor(F.col("done") * 100 / F.col("total") + 0.5).cast("long")
    )


def complete_chunks(tasks: DataFrame) -> DataFrame:
    """Chunks that have tasks and all of them done."""
    return (
        tasks.groupBy("chunk_id").agg(F.bool_and(F.col("status") == "done").alias("complete")).where("complete")
    ).select("chunk_id")


def pending_order(tasks: DataFrame) -> DataFrame:
    """Unfinished tasks of each chunk, the current one first.

    Current is the first task in progress, or else the first to do; the rest keep plan order.
    """
    pending = tasks.where(F.col("status").isin("todo", "in-progress"))
    current = pending.groupBy("chunk_id").agg(
        F.coalesce(F.min(F.when(F.col("status") == "in-progress", F.col("task_no"))), F.min("task_no")).alias("current")
    )
    order = Window.partitionBy("chunk_id").orderBy(F.col("task_no") != F.col("current"), "task_no")
    return (
        pending.join(current, "chunk_id")
        .withColumn("position", F.row_number().over(order))
        .drop("current")
    )


def next_chunks(chunks: DataFrame, ids_per_bucket: int = 50_000) -> DataFrame:
    """Each chunk with the smallest larger chunk id of its repository."""
    bucket = F.floor(F.col("chunk_id") / ids_per_bucket)
    ids = chunks.select("repo_id", "chunk_id").distinct()
    return next_value(ids, ["repo_id"], [F.col("chunk_id")], F.col("chunk_id"), bucket, "next_chunk_id")


def start_at(chunks: DataFrame, starts: DataFrame) -> DataFrame:
    """Chunks finished before each repository's starting chunk, one row each.

    ``starts`` has ``repo_id, start_id`` (null for the first chunk); unknown ids select nothing.
    """
    first = chunks.groupBy("repo_id").agg(F.min("chunk_id").alias("first_id"))
    begun = starts.join(first, "repo_id").select(
        "repo_id", F.coalesce("start_id", "first_id").alias("active_id")
    )
    known = begun.join(
        chunks.select("repo_id", F.col("chunk_id").alias("active_id")).distinct(), ["repo_id", "active_id"], "left_semi"
    )
    return chunks.join(known, "repo_id").where(F.col("chunk_id") < F.col("active_id")).select(
        "repo_id", "active_id", F.col("chunk_id").alias("completed_id")
    )


def completed_range(completed: DataFrame) -> DataFrame:
    """Text naming the finished chunks of each repository: ``a-b`` when they are consecutive, else listed.

    Fractional ids are truncated first, so 2 and 2.5 both read as 2. ``completed`` is one row per chunk; the list is as
    long as one repository's plan.
    """
    keys = F.col("chunk_id").cast("long")
    summed = completed.groupBy("repo_id").agg(
        F.count("*").alias("n"),
        F.min(keys).alias("first"),
        F.max(keys).alias("last"),
        _listed(keys).alias("listed"),
    )
    consecutive = F.col("last") - F.col("first") == F.col("n") - 1
    text = (
        F.when(F.col("n") == 1, F.concat(F.lit("Chunk "), F.col("first").cast("string")))
        .when(consecutive, F.concat(F.lit("Chunks "), F.col("first").cast("string"), F.lit("-"), F.col("last").cast("string")))
        .otherwise(F.concat(F.lit("Chunks "), F.col("listed")))
    )
    return summed.select(
        "repo_id", "n", "first", "last", consecutive.alias("consecutive"), F.concat(text, F.lit(" done.")).alias("summary")
    )


def _listed(ids: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(ids)), lambda i: i.cast("string")), ", ")


def completed_list(completed: DataFrame, keys: list[str]) -> DataFrame:
    """Listed form of :func:`completed_range`, for keys whose finished chunks fit one prompt line."""
    text = _listed(F.col("chunk_id").cast("long"))
    return completed.groupBy(*keys).agg(F.concat(F.lit("Chunks "), text, F.lit(" done.")).alias("summary"))
