"""Ingest of session artifacts: one text per row in, relation rows out.

Every reader takes a DataFrame with the key columns named in ``keys`` and a ``text`` column, from
``trees.read_texts`` or any table. A text is parsed inside its row, so nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from fleetledger.functions.binding import let, unnest
from fleetledger.functions.paths import leaves_root
from fleetledger.functions.refs import declared_refs_loose, normalize_ref_loose
from fleetledger.functions.text import lines_of, trim

ENTRY_SCHEMA = T.ArrayType(
    T.StructType(
        [
            T.StructField("session_id", T.StringType()),
            T.StructField("timestamp", T.StringType()),
            T.StructField("active_chunk", T.DecimalType(10, 3)),
            T.StructField("files_loaded", T.ArrayType(T.StringType())),
            T.StructField("total_tokens", T.LongType()),
            T.StructField("modifications", T.ArrayType(T.StringType())),
        ]
    )
)
MANIFEST_SCHEMA = (
    "version INT, generated_at STRING, active_chunk DECIMAL(10,3), prompt_hash STRING, entries ARRAY<STRUCT<"
    "ref STRING, path STRING, granularity STRING, tokens BIGINT, file_tokens BIGINT, hash STRING, start INT, "
    "`end` INT, reason STRING, task STRING, listed BOOLEAN, evidence STRING>>, "
    "totals STRUCT<tokens: BIGINT, file_tokens: BIGINT>"
)
MANIFEST_KEYS = ("version", "generated_at", "active_chunk", "prompt_hash", "entries", "totals")
TRIM_SCHEMA = "exclusions ARRAY<STRUCT<filepath STRING, excluded_at STRING, reason STRING>>"


def _unquoted(value: Column) -> Column:
    quoted = value.rlike(r"""^(".*"|'.*')$""")
    return F.when(quoted, F.substring(value, F.lit(2), F.length(value) - 2)).otherwise(value)


def _scalar(text: Column, key: str) -> Column:
    found = F.regexp_extract(text, rf"(?m)^{key}:[ \t]*(\S.*?)[ \t]*$", 1)
    return F.nullif(_unquoted(found), F.lit(""))


def _items(text: Column, key: str) -> Column:
    block = F.regexp_extract(text, rf"(?m)^{key}:[ \t]*\n((?:[ \t]+- .*(?:\n|\z))+)", 1)
    return F.transform(F.regexp_extract_all(block, F.lit(r"(?m)^[ \t]+- (.*)$"), 1), lambda v: _unquoted(trim(v)))


def session_states(texts: DataFrame, keys: list[str]) -> DataFrame:
    """Session state from its front matter; ``error`` names the first required field that is missing."""
    matter = F.regexp_extract("text", r"(?s)\A---\n(.*?)\n---", 1)
    pairs = F.regexp_extract(F.col("matter"), r"""(?m)^completed_chunks:[ \t]*\n((?:[ \t]+"?[\d.]+"?: .*(?:\n|\z))+)""", 1)
    entries = F.transform(
        F.regexp_extract_all(pairs, F.lit(r"(?m)^[ \t]+(.*)$"), 1),
        lambda p: F.struct(
            _unquoted(F.substring_index(p, ":", 1)).alias("key"),
            _unquoted(trim(F.substring(p, F.instr(p, ":") + 1, F.length(p)))).alias("value"),
        ),
    )
    m = F.col("matter")
    parsed = texts.withColumn("matter", matter).select(
        *keys,
        _scalar(m, "active_chunk").try_cast("decimal(10,3)").alias("active_chunk"),
        _scalar(m, "session_id").alias("session_id"),
        _scalar(m, "last_updated").alias("last_updated"),
        _items(m, "notes").alias("notes"),
        _items(m, "last_worked_files").alias("last_worked_files"),
        F.map_from_entries(entries).alias("completed_chunks"),
        F.coalesce(_scalar(m, "max_prompt_lines").try_cast("int"), F.lit(20)).alias("max_prompt_lines"),
    )
    return parsed.withColumn(
        "error",
        F.when(F.col("active_chunk").isNull(), "active_chunk: Required")
        .when(F.col("session_id").isNull(), "session_id: Required")
        .when(F.col("last_updated").isNull(), "last_updated: Required"),
    )


#: Why a table line of a file index gives no row. Only malformed lines make the index invalid.
MALFORMED, OUTSIDE, CLOSED = "fewer than two columns", "path leaves the root", "section names no chunk"


def index_lines(texts: DataFrame, keys: list[str]) -> DataFrame:
    """Every table line of a file index, parsed once: ``keys, path, purpose, tag, position, line, reason``.

    A level-two heading opens its chunk's section, or closes the current one when it names no chunk. ``reason`` is null
    for a row and says of any other line why it gives none; ``position`` is the section and the line in it. A writer that
    partitions by ``reason IS NULL`` sends rows and rejected lines to their own folders in the same pass.
    """
    heading = F.regexp_extract(F.col("section"), r"(?md)\A[ \t]*##[ \t]+(.*)$", 1)
    chunk = F.regexp_extract(heading, r"^Chunk\s+(\d+(?:\.\d+)?)(?:\s|$)", 1)
    tag = F.when(heading.rlike(r"^Always\s+Include\s*$"), F.lit("0")).otherwise(F.nullif(chunk, F.lit("")))
    sections = unnest(texts, keys, F.split("text", r"(?md)(?=^[ \t]*##[ \t]+\S)", -1), ["section_no", "section"])
    tagged = sections.select(*keys, "section_no", tag.try_cast("decimal(10,3)").alias("tag"), "section")
    lines = unnest(tagged, [*keys, "section_no", "tag"], lines_of(F.col("section")), ["line_no", "line"])
    line = trim(F.col("line"))
    meta = line.rlike(r"^\|\s*-+\s*\|\s*-+\s*\|$|^\|\s*File\s*\|\s*Purpose\s*\|$")
    cells = F.filter(F.transform(F.split(line, r"\|", -1), trim), lambda c: c != "")
    reason = (
        F.when(F.col("tag").isNull(), CLOSED).when(F.col("purpose").isNull(), MALFORMED).when(leaves_root(F.col("path")), OUTSIDE)
    )
    return (
        lines.where(line.startswith("|") & ~meta)
        .withColumn("cells", cells)
        .select(
            *keys,
            F.get("cells", F.lit(0)).alias("path"),
            F.get("cells", F.lit(1)).alias("purpose"),
            "tag",
            F.struct("section_no", "line_no").alias("position"),
            "line",
        )
        .withColumn("reason", reason)
    )


def index_rows(texts: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, path, purpose, tag, position`` of a file index's table rows."""
    return index_lines(texts, keys).where("reason IS NULL").drop("line", "reason")


def rejected_lines(texts: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, position, line, reason`` of the table lines that give no row."""
    return index_lines(texts, keys).where("reason IS NOT NULL").select(*keys, "position", "line", "reason")


def invalid_indexes(rejected: DataFrame, keys: list[str]) -> DataFrame:
    """The first malformed line of each index that has one, as ``keys, error``."""
    first = F.min(F.struct("position.section_no", "position.line_no", "line")).alias("first")
    worst = rejected.where(F.col("reason") == MALFORMED).groupBy(*keys).agg(first)
    return worst.select(*keys, F.concat(F.lit(f"{MALFORMED}: "), F.trim("first.line")).alias("error"))


def index_entries(texts: DataFrame, keys: list[str]) -> DataFrame:
    """One entry per path of a file index: first purpose, distinct tags in order."""
    return index_rows(texts, keys).groupBy(*keys, "path").agg(
        F.min_by("purpose", "position").alias("purpose"), F.sort_array(F.collect_set("tag")).alias("chunk_tags")
    )


def code_index_units(texts: DataFrame, keys: list[str]) -> DataFrame:
    """Units of a code index written by indentation: 2 file, 4 section, 6 unit id, 8 field."""

    def blocks(text: Column, indent: int) -> Column:
        pieces = F.split(text, rf"(?md)(?=^ {{{indent}}}\S)", -1)
        return F.filter(pieces, lambda p: p.rlike(rf"^ {{{indent}}}\S"))

    def key(block: Column) -> Column:
        line = trim(F.substring_index(block, "\n", 1))
        return _unquoted(F.regexp_extract(line, r"""^("(?:[^"\\]|\\.)*"|[^:]+):""", 1))

    def field(name: str) -> Column:
        return F.nullif(_unquoted(F.regexp_extract("unit", rf"(?m)^ {{8}}{name}: (.*)$", 1)), F.lit(""))

    files = unnest(texts, keys, blocks(F.col("text"), 2), ["file"]).withColumn("path", key(F.col("file")))
    sections = unnest(files, [*keys, "path"], blocks(F.col("file"), 4), ["section"])
    units = unnest(
        sections.where(F.col("section").rlike(r"^ {4}units:[ \t]*(\n|$)")),
        [*keys, "path"],
        blocks(F.col("section"), 6),
        ["unit"],
    )
    names = ("kind", "start", "end", "tokens", "hash", "exported", "refs")
    return units.select(*keys, "path", key(F.col("unit")).alias("unit_id"), *[field(n).alias(n) for n in names])


def manifests(texts: DataFrame, keys: list[str]) -> DataFrame:
    """Parsed manifests with the reason a row must be quarantined, null for good ones."""
    parsed = texts.withColumn("m", F.from_json("text", MANIFEST_SCHEMA)).withColumn(
        "extra", F.array_except(F.json_object_keys("text"), F.array(*map(F.lit, MANIFEST_KEYS)))
    )
    error = (
        F.when(F.col("extra").isNull() | F.col("m").isNull(), "not valid JSON")
        .when(F.size("extra") > 0, F.concat(F.lit("unknown key "), F.get("extra", F.lit(0))))
        .when(F.col("m.version").isNull() | F.col("m.entries").isNull(), "missing field")
    )
    return parsed.select(*keys, "m.*", error.alias("error"))


def log_entries(texts: DataFrame, keys: list[str]) -> DataFrame:
    """Context-log entries written as ``entries: [...]``, a bare array, or an object with ``entries``."""
    body = trim(F.col("text"))
    listed = F.regexp_extract(body, r"(?ms)^entries:\s*(\[.*\])$", 1)
    array = (
        F.when(listed != "", listed)
        .when(body.startswith("{"), F.get_json_object(body, "$.entries"))
        .when(body.startswith("["), body)
    )
    return unnest(texts, keys, F.from_json(array, ENTRY_SCHEMA))


def trim_overrides(texts: DataFrame, keys: list[str]) -> DataFrame:
    return unnest(texts, keys, F.from_json("text", TRIM_SCHEMA)["exclusions"])


def rule_globs(texts: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, description, glob_no, glob`` from a rule file's front matter: an inline array or one scalar."""
    matter = F.regexp_extract("text", r"(?s)\A---\n?(.*?)\n---", 1)
    value = F.regexp_extract("matter", r"(?m)^[ \t]*globs[ \t]*:[ \t]*(.*?)[ \t]*$", 1)
    inside = F.regexp_extract(F.col("value"), r"(?s)^\[(.*)\]", 1)
    many = F.filter(F.transform(F.split(inside, ",", -1), lambda g: _unquoted(trim(g))), lambda g: g != "")
    globs = F.when(F.col("value").startswith("["), many).when(F.col("value") != "", F.array(_unquoted(F.col("value"))))
    described = F.regexp_extract("matter", r"(?m)^[ \t]*description[ \t]*:[ \t]*(.*?)[ \t]*$", 1)
    parsed = texts.withColumn("matter", matter).withColumn("value", value).withColumn("description", _unquoted(described))
    return unnest(parsed, [*keys, "description"], globs, ["glob_no", "glob"])


def glob_regex(pattern: Column) -> Column:
    """Anchored expression of a glob with ``**``, ``*`` and ``?``."""
    escaped = F.regexp_replace(F.replace(pattern, F.lit("\\"), F.lit("/")), r"[.+^${}()|\[\]]", r"\\$0")
    marked = F.replace(escaped, F.lit("/**/"), F.lit("\x01"))
    marked = F.regexp_replace(marked, r"^\*\*/", "\x02")
    marked = F.regexp_replace(marked, r"/\*\*$", "\x03")
    marked = F.replace(marked, F.lit("**"), F.lit("\x04"))
    plain = F.replace(F.replace(marked, F.lit("*"), F.lit("[^/]*")), F.lit("?"), F.lit("[^/]"))
    for mark, expression in (("\x01", "/(?:.*/)?"), ("\x02", "(?:.*/)?"), ("\x03", "/.*"), ("\x04", ".*")):
        plain = F.replace(plain, F.lit(mark), F.lit(expression))
    return F.concat(F.lit("^"), plain, F.lit("$"))


def _glob_anchor(glob: Column) -> tuple[Column, Column]:
    """What every path that a glob matches has in common with it: the folders before the first wildcard, and the basename
    if it has none, else the extension after the last one."""
    plain = F.replace(glob, F.lit("\\"), F.lit("/"))
    folders = F.regexp_extract(plain, r"^((?:[^*?/]*/)*)", 1)
    last = F.regexp_extract(plain, r"([^/]*)$", 1)
    extension = F.regexp_extract(last, r"[*?][^*?]*?(\.[^.*?]+)$", 1)
    return folders, F.when(last.rlike(r"[*?]") | (last == ""), extension).otherwise(F.concat(F.lit("/"), last))


def glob_imports(globs: DataFrame, files: DataFrame, entries: DataFrame) -> DataFrame:
    """Files a repository's globs match that its index lacks, with the first glob that matched.

    A file meets only globs that share its folders up to their first wildcard and its basename or extension: an equi-join
    on what the paths have in common, which spreads a repository over as many tasks as it has such keys. What meets is
    tested in the order of the expressions, so that each is compiled once a task and not once a row.
    """
    folders, tail = _glob_anchor(F.col("glob"))
    anchored = globs.select(
        "repo_id", "glob_no", "glob", glob_regex(F.col("glob")).alias("regex"), folders.alias("folders"), tail.alias("tail")
    )
    fresh = files.select("repo_id", "path").distinct().join(entries.select("repo_id", "path"), ["repo_id", "path"], "left_anti")
    parts = F.split("path", "/", -1)
    above = let(
        parts,
        lambda p: F.transform(
            F.sequence(F.lit(0), F.size(p) - 1), lambda n: F.array_join(F.concat(F.slice(p, F.lit(1), n), F.array(F.lit(""))), "/")
        ),
    )
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    tails = F.array_distinct(F.array(F.lit(""), F.concat(F.lit("/"), name), F.regexp_extract(name, r"(\.[^.]+)$", 1)))
    keyed = fresh.withColumn("tails", tails).select("repo_id", "path", F.explode(above).alias("folders"), "tails")
    keyed = keyed.select("repo_id", "path", "folders", F.explode("tails").alias("tail"))
    met = keyed.join(anchored, ["repo_id", "folders", "tail"]).sortWithinPartitions("regex")
    hits = met.where(F.regexp_substr("path", F.col("regex")).isNotNull())
    return hits.groupBy("repo_id", "path").agg(F.min_by("glob", "glob_no").alias("glob"))


def frontmatter_errors(texts: DataFrame, keys: list[str], required: dict[str, str]) -> DataFrame:
    """``field: message`` errors of a front matter; ``required`` maps a field to the expression it must match."""
    matter = F.regexp_extract("text", r"(?s)\A---\n(.*?)\n---", 1)
    checks = []
    for name, expression in required.items():
        value = _scalar(F.col("matter"), name)
        checks.append(
            F.when(value.isNull(), F.lit(f"{name}: Required")).when(~value.rlike(expression), F.lit(f"{name}: Invalid"))
        )
    return texts.withColumn("matter", matter).select(*keys, F.array_compact(F.array(*checks)).alias("errors"))


def plan_file_ids(paths: DataFrame) -> DataFrame:
    """Files named ``PLAN_<n>.md`` with their chunk id, other files left out."""
    chunk = F.nullif(F.regexp_extract("path", r"(?:^|/)PLAN_(\d+(?:\.\d+)?)\.md$", 1), F.lit(""))
    return paths.withColumn("chunk_id", chunk.try_cast("decimal(10,3)")).where("chunk_id IS NOT NULL")


def eval_records(texts: DataFrame, keys: list[str]) -> DataFrame:
    """One row per arm of every run of an evaluation report."""
    schema = (
        "version STRING, rows ARRAY<STRUCT<target STRING, ablation STRING, arms ARRAY<STRUCT<arm STRING, turns INT, "
        "inputTokens BIGINT, outputTokens BIGINT, testsPassed BOOLEAN>>>>"
    )
    runs = unnest(texts, keys, F.from_json("text", schema)["rows"])
    arms = unnest(runs, [*keys, "target", "ablation"], F.col("arms"))
    return arms.select(
        *keys, "target", "ablation", "arm", "turns", F.col("inputTokens").alias("input_tokens"),
        F.col("outputTokens").alias("output_tokens"), F.col("testsPassed").alias("tests_passed"),
    )


# Version-control exports ----------------------------------------------------


def commit_lines(lines: DataFrame, keys: list[str]) -> DataFrame:
    """``sha, date, subject`` from ``sha date subject`` lines; lines without two spaces are dropped."""
    pattern = r"^([^ ]*) ([^ ]*) (.*)$"
    return lines.where(F.col("line").rlike(pattern)).select(
        *keys, *[F.regexp_extract("line", pattern, i + 1).alias(n) for i, n in enumerate(("sha", "date", "subject"))]
    )


#: A status record: two letters, a space and a path. A rename or copy takes the record after it along.
_STATUS_RECORD = r"(?s)((?=[RC]|[^\x00][RC])[^\x00]{4,}(?:\x00[^\x00]*)?|[^\x00]+)(?:\x00|\z)"


def status_records(exports: DataFrame, keys: list[str]) -> DataFrame:
    """``code, path, from_path`` of NUL-separated status output; a rename takes the record after it.

    One scan of the text takes out the records, each with the one it takes along, so the work is linear in the text.
    """
    found = F.regexp_extract_all(F.regexp_replace("text", "\x00$", ""), F.lit(_STATUS_RECORD), 1)
    parts = F.transform(found, lambda r: F.split(r, "\x00", 2))
    entries = F.transform(
        F.filter(parts, lambda p: F.length(p[0]) >= 4),
        lambda p: F.struct(
            F.substring(p[0], 1, 2).alias("code"),
            F.substring(p[0], F.lit(4), F.length(p[0])).alias("path"),
            F.get(p, 1).alias("from_path"),
        ),
    )
    return unnest(exports, keys, entries)


def dirty_paths(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Paths of short status lines; of ``old -> new`` the new one."""
    path = trim(F.substring("line", F.lit(4), F.length("line")))
    return lines.where(F.length("line") > 3).select(
        *keys, F.when(path.contains(" -> "), F.regexp_extract(path, " -> (.*)$", 1)).otherwise(path).alias("path")
    ).where("path <> ''")


def numstat_kinds(records: DataFrame, keys: list[str]) -> DataFrame:
    """``binary``, ``blank`` or ``changed`` from added / deleted / path records."""
    pattern = r"(?s)^(-|\d+)\t(-|\d+)\t(.*)$"
    added, deleted = F.regexp_extract("line", pattern, 1), F.regexp_extract("line", pattern, 2)
    kind = F.when(added == "-", "binary").when((added == "0") & (deleted == "0"), "blank").otherwise("changed")
    return records.where(F.col("line").rlike(pattern)).select(
        *keys, F.regexp_extract("line", pattern, 3).alias("path"), kind.alias("kind")
    )


def set_attributes(exports: DataFrame, keys: list[str]) -> DataFrame:
    """Paths whose attribute is set, from NUL-separated (path, attribute, value) triples."""

    def triples(records: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(records)), lambda i: (i % 3 == 0) & (i + 2 < F.size(records)))
        return F.transform(
            starts, lambda i: F.struct(F.get(records, i).alias("path"), F.get(records, i + 2).alias("value"))
        )

    records = F.split(F.regexp_replace("text", "\x00$", ""), "\x00", -1)
    rows = unnest(exports, keys, let(records, triples))
    return rows.where(F.col("value").isin("set", "true")).select(*keys, "path").distinct()


def diagnostics(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct ``file(line,col): code`` of compiler output."""
    found = F.regexp_extract("line", r"^(.+?\(\d+,\d+\)): error (TS\d+):", 1)
    code = F.regexp_extract("line", r"^(.+?\(\d+,\d+\)): error (TS\d+):", 2)
    return lines.select(*keys, F.concat(found, F.lit(": "), code).alias("diagnostic")).where(
        "diagnostic <> ': '"
    ).distinct()


# Declared references of an evaluation run ------------------------------------


def adapter_refs(texts: DataFrame, keys: list[str]) -> DataFrame:
    """Files an adapter document lists in backticks under its first "files to load" heading."""
    block = F.regexp_extract("text", r"(?im)^[ \t]*#.*files to load.*\n((?:(?![ \t]*#).*(?:\n|\z))*)", 1)
    listed = F.regexp_extract_all(block, F.lit(r"(?m)^[ \t]*[-*]\s+`([^`]+)`[ \t]*$"), 1)
    return unnest(texts, keys, F.transform(listed, normalize_ref_loose), ["ref"])


def index_refs(texts: DataFrame, keys: list[str]) -> DataFrame:
    """First cell of every table row of a file index, headers and rules left out."""
    lines = unnest(texts, keys, lines_of(F.col("text")), ["n", "line"])
    line = trim(F.col("line"))
    first = trim(F.get(F.split(line, r"\|", -1), F.lit(1)))
    cells = lines.where(line.startswith("|")).select(*keys, first.alias("cell"))
    return cells.where(~F.col("cell").isin("", "File") & ~F.col("cell").rlike("^-+$")).select(
        *keys, normalize_ref_loose(F.col("cell")).alias("ref")
    )


def all_declared(prompts: DataFrame, adapters: DataFrame, indexes: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct references a run's prompt, adapter document and file index declare between them."""
    from_prompts = unnest(prompts, keys, declared_refs_loose(F.col("text")), ["ref"])
    every = from_prompts.unionByName(adapter_refs(adapters, keys)).unionByName(index_refs(indexes, keys))
    return every.where("ref IS NOT NULL").distinct()
