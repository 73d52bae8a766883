"""Queries over touch tagging, prompts and evaluation records."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetledger.catalog.evidence import claimed, dirty, hashed, indexed
from fleetledger.catalog.history import rounded
from fleetledger.catalog.paths import _paths  # noqa: F401
from fleetledger.catalog.registry import query
from fleetledger.catalog.relations import K, RELATIONS, sql, src
from fleetledger.functions import refs
from fleetledger.functions.binding import unnest
from fleetledger.functions.paths import word_to_file_path  # noqa: F401
from fleetledger.operators import evals, prompts, touch
from fleetledger.sources import bindings as b

# Touch tagging --------------------------------------------------------------

RELATIONS["touched_paths"] = (
    ("raw_paths",),
    """SELECT DISTINCT r.repo_id, r.path FROM raw_paths r JOIN events e USING (event_id)
       WHERE e.event_type IN ('purchase', 'error') AND NOT (e.event_type = 'error' AND e.user_id % 4 = 0)""",
)
RELATIONS["touch"] = (
    ("touched_paths", "raw_paths"),
    r"""SELECT t.repo_id, t.path, CASE WHEN d.path IS NOT NULL AND NOT regexp_matches(t.path, '[0-9]') THEN 'unchanged-since-base'
          WHEN v.path IS NULL OR regexp_matches(t.path, '(^|[\\/])(node_modules|\.git|dist|build|\.session)([\\/]|$)')
            OR t.path = 'README.md' THEN 'excluded-path'
          WHEN NOT regexp_full_match(t.path, '[A-Za-z0-9._\-+@/]+') THEN 'unsafe-path'
          WHEN regexp_matches(t.path, '(^|/)(pnpm-lock\.yaml|Cargo\.lock)$') THEN 'lockfile'
          WHEN t.path LIKE '%.log' THEN 'binary-or-generated' WHEN t.path LIKE '%.yaml' THEN 'whitespace-only' END AS reason
        FROM touched_paths t
        LEFT JOIN (SELECT DISTINCT repo_id, path FROM raw_paths JOIN events USING (event_id) WHERE event_type = 'view') v USING (repo_id, path)
        LEFT JOIN (SELECT DISTINCT repo_id, path FROM raw_paths JOIN events USING (event_id) WHERE event_type = 'click') d USING (repo_id, path)""",
)


def _typed_paths(spark, sf, *types):
    events = b.table(spark, sf, "events").where(F.col("event_type").isin(*types)).select("event_id", "event_type", "user_id")
    return b.raw_paths(spark, sf).join(events, "event_id")


def touch_reasons(spark, sf):
    committed = _typed_paths(spark, sf, "purchase")
    status = _typed_paths(spark, sf, "error").withColumn("code", F.when(F.col("user_id") % 4 == 0, " D").otherwise(" M"))
    has_digit = F.col("path").rlike("[0-9]")
    on_disk = _typed_paths(spark, sf, "view").select("repo_id", "path").distinct()
    base = _typed_paths(spark, sf, "click").select("repo_id", "path").distinct()
    # Files clicked but not viewed are unreadable now; they count as unchanged through an equal recorded hash.
    known = on_disk.union(base).distinct().withColumn("hash", F.when(has_digit, "new").otherwise("old"))
    changes = F.when(F.col("path").endswith(".log"), "binary").when(F.col("path").endswith(".yaml"), "blank").otherwise("changed")
    found = touch.touched(committed, status, base.withColumn("hash", F.lit("old")), known.withColumn("change", changes))
    exists = on_disk.withColumn("viewed", F.lit(True))
    seen = found.join(exists, ["repo_id", "path"], "left").withColumn("exists", F.coalesce("viewed", F.lit(False)))
    excluded = known.where("path = 'README.md'")
    return touch.skip_reasons(seen.drop("viewed").withColumn("generated", F.lit(False)), excluded)


@query("p27_skip_reasons", sql("SELECT * FROM touch", "touch"))
def skip_reasons(spark, sf):
    return touch_reasons(spark, sf).select("repo_id", "path", "reason")


@query("j26_touched_files", sql("SELECT repo_id, path FROM touched_paths", "touched_paths"))
def touched_files(spark, sf):
    return touch_reasons(spark, sf).select("repo_id", "path")


@query("a26_skip_counts", sql("SELECT repo_id, reason, count(*) AS n FROM touch WHERE reason IS NOT NULL GROUP BY ALL", "touch"))
def skip_counts(spark, sf):
    return touch.skip_counts(touch_reasons(spark, sf))


RELATIONS["gated"] = (
    ("touch",),
    """SELECT repo_id, path, coalesce(reason, CASE WHEN n > 3 THEN 'too-many' WHEN CAST(substr(repo_id, 6) AS INTEGER) % 6 = 0 THEN 'chunk-done' END) AS reason
       FROM (SELECT *, count_if(reason IS NULL) OVER (PARTITION BY repo_id) AS n FROM touch)""",
)


@query(
    "j27_chunk_assignment",
    sql(
        """SELECT g.repo_id, g.path, unnest([7, 8]) AS chunk_id, unnest([0, 1]) AS rank FROM gated g WHERE reason IS NULL AND path LIKE 'src/%'
           UNION ALL SELECT g.repo_id, g.path, 7, 0 FROM gated g WHERE reason IS NULL AND path NOT LIKE 'src/%'""",
        "gated",
    ),
)
def chunk_assignment(spark, sf):
    reasons = touch_reasons(spark, sf)
    repos = reasons.select("repo_id").distinct()
    finished = repos.where("CAST(substring(repo_id, 6) AS INT) % 6 = 0")
    survivors = touch.gated(reasons, finished, limit=3).where("reason IS NULL")
    active = repos.withColumn("active_chunk", F.lit(7))
    named = reasons.where("path LIKE 'src/%'").select("repo_id", "path", F.explode(F.array(F.lit(7), F.lit(8))).alias("chunk_id"))
    return touch.chunk_tags(survivors, active, named)


@query("u9_exclusion_set", sql("SELECT * FROM claimed UNION SELECT * FROM indexed", "claimed", "indexed"))
def exclusion_set(spark, sf):
    return claimed(spark, sf).union(indexed(spark, sf)).distinct()


@query(
    "u4_load_order",
    sql(
        """SELECT repo_id, path, CAST(min(rank) AS INTEGER) AS rank FROM (SELECT *, 0 AS rank FROM indexed UNION ALL SELECT *, 1 FROM claimed) GROUP BY ALL""",
        "claimed",
        "indexed",
    ),
)
def load_order(spark, sf):
    return prompts.load_order(indexed(spark, sf), claimed(spark, sf))


@query("j30_trim_exclusions", sql("SELECT * FROM claimed ANTI JOIN indexed USING (repo_id, path)", "claimed", "indexed"))
def trim_exclusions(spark, sf):
    return prompts.without_excluded(claimed(spark, sf), indexed(spark, sf))


@query("j34_stale_references", sql("SELECT * FROM claimed SEMI JOIN dirty USING (repo_id, path)", "claimed", "dirty"))
def stale_references(spark, sf):
    return claimed(spark, sf).join(dirty(spark, sf), ["repo_id", "path"], "left_semi")


@query("j35_new_diagnostics", sql("SELECT * FROM dirty EXCEPT SELECT * FROM claimed", "claimed", "dirty"))
def new_diagnostics(spark, sf):
    return evals.new_rows(claimed(spark, sf), dirty(spark, sf), ["repo_id", "path"])


@query(
    "j31_grounding",
    sql(
        """SELECT c.repo_id, count(*) AS declared, count_if(i.path IS NULL) AS missing,
                  round((count(*) - count_if(i.path IS NULL)) / count(*), 6) AS grounded_ratio
           FROM claimed c LEFT JOIN indexed i USING (repo_id, path) GROUP BY 1""",
        "claimed",
        "indexed",
    ),
)
def grounding(spark, sf):
    return rounded(evals.grounding(claimed(spark, sf), indexed(spark, sf), ["repo_id"]), "grounded_ratio")


@query(
    "j33_recall",
    sql(
        """SELECT repo_id, total, hit, round(CASE WHEN total > 0 THEN hit / total END, 6) AS recall, total > 0 AND hit = 0 AS failed
           FROM (SELECT c.repo_id, count(i.path) AS total, count_if(i.path IS NOT NULL AND d.path IS NOT NULL) AS hit
                 FROM claimed c LEFT JOIN indexed i USING (repo_id, path) LEFT JOIN dirty d USING (repo_id, path) GROUP BY 1)""",
        "claimed",
        "indexed",
        "dirty",
    ),
)
def recall(spark, sf):
    return rounded(evals.recall(claimed(spark, sf), dirty(spark, sf), indexed(spark, sf), ["repo_id"]), "recall")


@query(
    "u8_set_equality",
    sql(
        """SELECT coalesce(c.repo_id, i.repo_id) AS repo_id, bool_and(c.path IS NOT NULL AND i.path IS NOT NULL) AS same
           FROM claimed c FULL OUTER JOIN indexed i ON c.repo_id = i.repo_id AND c.path = i.path GROUP BY 1""",
        "claimed",
        "indexed",
    ),
)
def set_equality(spark, sf):
    sides = claimed(spark, sf).withColumn("side", F.lit(1)).unionByName(indexed(spark, sf).withColumn("side", F.lit(2)))
    per_path = sides.groupBy("repo_id", "path").agg(F.sum("side").alias("s"))
    return per_path.groupBy("repo_id").agg(F.bool_and(F.col("s") == 3).alias("same"))


@query(
    "j42_manifest_agreement",
    sql(
        """SELECT repo_id, same AS same_units, true AS same_prompt FROM (
             SELECT coalesce(c.repo_id, i.repo_id) AS repo_id, bool_and(c.path IS NOT NULL AND i.path IS NOT NULL) AS same
             FROM claimed c FULL OUTER JOIN indexed i ON c.repo_id = i.repo_id AND c.path = i.path GROUP BY 1)""",
        "claimed",
        "indexed",
    ),
)
def manifest_agreement(spark, sf):
    def side(paths):
        return paths.select("repo_id", F.sha2("repo_id", 256).alias("prompt_hash"), F.col("path").alias("unit_ref"))

    return evals.agreement(side(claimed(spark, sf)), side(indexed(spark, sf)))


# Prompts --------------------------------------------------------------------

# A prompt per conversation turn: the turn's words listed under a load prefix.
_PROMPT = """'Project: p' || chr(10) || CASE WHEN turn % 2 = 0 THEN 'Load: ' ELSE 'Plan: ' END
  || replace(replace(text, chr(10), ' '), ' ', ', src/') || ', (none), +3 more, @lib/x.ts·L1, lib/x.ts (layer 1), `a.ts`, u.ts#f:1-2'
  || CASE WHEN role = 'user' THEN chr(10) || 'Resume: now' ELSE '' END"""
RELATIONS["conv_prompts"] = ((), f"SELECT conv_id, turn, {_PROMPT} AS text FROM conversations")
RELATIONS["prompt_refs"] = (
    (),
    r"""SELECT conv_id, turn, CASE WHEN strpos(t, ' (') > 0 THEN split_part(t, ' (', 1) ELSE t END AS ref FROM (
          SELECT conv_id, turn, unnest(list_concat(string_split(replace(replace(text, chr(10), ' '), ' ', ', src/'), ','),
            ['lib/x.ts', 'lib/x.ts', 'a.ts', 'u.ts'])) AS t FROM conversations)""",
)


def conv_prompts(spark, sf):
    flat = F.replace(F.replace("text", F.lit("\n"), F.lit(" ")), F.lit(" "), F.lit(", src/"))
    text = F.concat(
        F.lit("Project: p\n"),
        F.when(F.col("turn") % 2 == 0, "Load: ").otherwise("Plan: "),
        flat,
        F.lit(", (none), +3 more, @lib/x.ts·L1, lib/x.ts (layer 1), `a.ts`, u.ts#f:1-2"),
        F.when(F.col("role") == "user", "\nResume: now").otherwise(""),
    )
    return b.table(spark, sf, "conversations").select("conv_id", "turn", text.alias("text"))


@query(
    "sc6_declared_files",
    sql(
        r"""SELECT DISTINCT conv_id, turn, path FROM (SELECT conv_id, turn, regexp_replace(regexp_replace(trim(ref), '^@', ''), '^`|`$', '', 'g') AS path
            FROM prompt_refs) WHERE (contains(path, '/') OR contains(path, '.')) AND path NOT LIKE '+%'""",
        "prompt_refs",
    ),
)
def declared_files(spark, sf):
    return prompts.declared(conv_prompts(spark, sf), ["conv_id", "turn"]).select("conv_id", "turn", "path")


@query(
    "sc5_normalized_refs",
    sql(
        r"""SELECT event_id, path, CASE WHEN contains(cut, '/') OR contains(cut, '.') THEN cut END AS ref
            FROM (SELECT *, split_part(path, ' (', 1) AS cut FROM raw_paths)""",
        "raw_paths",
    ),
)
def normalized_refs(spark, sf):
    listed = b.raw_paths(spark, sf)
    decorated = F.concat(F.lit(" @"), "path", F.lit("·L2 "))
    return listed.select("event_id", "path", refs.normalize_ref(decorated).alias("ref"))


@query(
    "u7_duplicate_refs",
    sql(
        r"""SELECT conv_id, turn, ref, count(*) AS times FROM (
              SELECT conv_id, turn, trim(unnest(string_split(replace(replace(text, chr(10), ' '), ' ', ', src/'), ','))) AS ref FROM conversations)
            WHERE ref <> '' GROUP BY ALL HAVING count(*) > 1""",
    ),
)
def duplicate_refs(spark, sf):
    return prompts.duplicate_refs(conv_prompts(spark, sf), ["conv_id", "turn"])


@query(
    "sc30_prompt_size",
    sql(
        "SELECT conv_id, turn, len(list_filter(string_split(text, chr(10)), lambda l: l <> '')) AS lines, length(text) AS chars FROM conversations"
    ),
)
def prompt_size(spark, sf):
    return prompts.size_of(b.table(spark, sf, "conversations"), ["conv_id", "turn"])


@query(
    "p26_prompt_validity",
    sql(
        """SELECT conv_id, turn, concat_ws('; ', CASE WHEN length(text) > 12000 THEN 'Character count ' || length(text) ||
              ' exceeds maximum of 12000 characters' END, 'Missing required field: "Active chunk:"',
              CASE WHEN NOT contains(text, 'Resume: now') THEN 'Missing required field: "Resume:"' END) AS errors FROM conv_prompts""",
        "conv_prompts",
    ),
)
def prompt_validity(spark, sf):
    checked = prompts.validation_errors(conv_prompts(spark, sf), ["conv_id", "turn"])
    return checked.select("conv_id", "turn", F.array_join("errors", "; ").alias("errors"))


RELATIONS["notes"] = (
    (),
    """SELECT conv_id AS repo_id, turn AS position, CASE WHEN turn % 5 = 0 THEN 'Session initialized on 2024-01-0' || (turn % 9 + 1)
          WHEN role = 'user' THEN text WHEN turn % 2 = 0 THEN '[memory] ' || text ELSE 'Quoted from ' || text END AS note FROM conversations""",
)


def notes(spark, sf):
    note = (
        F.when(F.col("turn") % 5 == 0, F.concat(F.lit("Session initialized on 2024-01-0"), (F.col("turn") % 9 + 1).cast("string")))
        .when(F.col("role") == "user", F.col("text"))
        .when(F.col("turn") % 2 == 0, F.concat(F.lit("[memory] "), "text"))
        .otherwise(F.concat(F.lit("Quoted from "), "text"))
    )
    return b.table(spark, sf, "conversations").select(
        F.col("conv_id").alias("repo_id"), F.col("turn").alias("position"), note.alias("note")
    )


@query(
    "w7_selected_notes",
    sql(
        """SELECT repo_id, position, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY repo_id
             ORDER BY (note LIKE 'Quoted from %' OR note LIKE '[memory] %'), position DESC) AS rank
           FROM notes WHERE note NOT LIKE 'Session initialized on %') WHERE rank <= 2""",
        "notes",
    ),
)
def selected_notes(spark, sf):
    return prompts.selected_notes(notes(spark, sf), 2).select("repo_id", "position", "rank")


@query(
    "p16_note_kinds",
    sql(
        """SELECT repo_id, position, note LIKE 'Session initialized on %' AS progress,
                  note LIKE 'Quoted from %' OR note LIKE '[memory] %' AS derived FROM notes""",
        "notes",
    ),
)
def note_kinds(spark, sf):
    note = F.col("note")
    return notes(spark, sf).select(
        "repo_id", "position", prompts.is_progress_note(note).alias("progress"), prompts.is_derived_note(note).alias("derived")
    )


@query(
    "w10_trimmed_lines",
    sql(
        """SELECT path, CASE WHEN len(l) <= 6 THEN md5(array_to_string(l, chr(10))) ELSE
             md5(array_to_string(l[1:5], chr(10)) || chr(10) || '[' || (len(l) - 5) || ' more lines trimmed]') END AS digest
           FROM (SELECT path, string_split(text, chr(10)) AS l FROM files)""",
        "files",
    ),
)
def trimmed_lines(spark, sf):
    cut = prompts.trimmed_lines(b.files(spark, sf), ["path"], 6)
    return cut.select("path", F.md5("text").alias("digest"))


@query(
    "w9_fitted_list",
    sql(
        """SELECT conv_id, turn, CASE WHEN shown = 0 THEN '' ELSE array_to_string(w[1:shown], ', ') END
             || CASE WHEN len(w) > shown THEN ', +' || (len(w) - shown) || ' more' ELSE '' END AS listed
           FROM (SELECT conv_id, turn, w, coalesce(min(n) FILTER (NOT fits) - 1, len(w)) AS shown FROM (
             SELECT conv_id, turn, w, n, sum(length(w[n])) OVER (PARTITION BY conv_id, turn ORDER BY n) + 2 * (n - 1)
                 + CASE WHEN len(w) - n > 0 THEN length(', +' || (len(w) - n) || ' more') ELSE 0 END <= 200 AS fits
             FROM (SELECT conv_id, turn, w, unnest(range(1, len(w) + 1)) AS n FROM (
               SELECT conv_id, turn, string_split(replace(text, chr(10), ' '), ' ') AS w FROM conversations)))
           GROUP BY conv_id, turn, w)"""
    ),
)
def fitted_list(spark, sf):
    words = b.table(spark, sf, "conversations").select("conv_id", "turn", F.split(F.replace("text", F.lit("\n"), F.lit(" ")), " ", -1).alias("w"))
    return words.select("conv_id", "turn", prompts.fitted_list(F.col("w"), 200).alias("listed"))


# Evaluation -----------------------------------------------------------------

RELATIONS["runs"] = (
    (),
    """SELECT l_partkey AS task, CASE WHEN l_suppkey % 2 = 0 THEN 'bootstrap' ELSE 'control' END AS arm,
              l_linestatus = 'F' AS passed, l_extendedprice AS tokens FROM lineitem""",
)

def runs(spark, sf):
    return b.table(spark, sf, "lineitem").select(
        F.col("l_partkey").alias("task"),
        F.when(F.col("l_suppkey") % 2 == 0, "bootstrap").otherwise("control").alias("arm"),
        (F.col("l_linestatus") == "F").alias("passed"),
        F.col("l_extendedprice").alias("tokens"),
    )


@query(
    "j40_paired_arms",
    sql(
        """SELECT task, max(CASE WHEN arm = 'bootstrap' THEN tokens END) AS bootstrap, max(CASE WHEN arm = 'control' THEN tokens END) AS control
           FROM runs GROUP BY 1""",
        "runs",
    ),
)
def paired_arms(spark, sf):
    return evals.paired_arms(runs(spark, sf), ["task"], "tokens")


@query(
    "a29_paired_efficiency",
    sql(
        """SELECT count(*) AS pairs, round(avg(x / y), 6) AS mean_ratio, round(median(x / y), 6) AS median_ratio, round(min(x / y), 6) AS min_ratio,
                  round(max(x / y), 6) AS max_ratio, count_if(x <= y) AS wins
           FROM (SELECT task, max(CASE WHEN arm = 'bootstrap' THEN tokens END) AS x, max(CASE WHEN arm = 'control' THEN tokens END) AS y
                 FROM runs GROUP BY 1) WHERE x IS NOT NULL AND y IS NOT NULL""",
        "runs",
    ),
)
def paired_efficiency(spark, sf):
    return rounded(
        evals.paired_efficiency(paired_arms(spark, sf)), "mean_ratio", "median_ratio", "min_ratio", "max_ratio"
    )


@query(
    "a30_arm_effects",
    sql(
        """SELECT round(avg(d), 6) AS pass_rate_difference, round(exp(avg(g)), 6) AS geometric_mean_ratio FROM (
             SELECT task, avg(passed::INT) FILTER (arm = 'bootstrap') - avg(passed::INT) FILTER (arm = 'control') AS d,
                    avg(ln(tokens)) FILTER (arm = 'bootstrap') - avg(ln(tokens)) FILTER (arm = 'control') AS g FROM runs GROUP BY 1)""",
        "runs",
    ),
)
def arm_effects(spark, sf):
    return rounded(evals.arm_effects(runs(spark, sf)), "pass_rate_difference", "geometric_mean_ratio")


@query(
    "a31_variance_split",
    sql(
        """SELECT arm, round(sqrt(sum(v * (n - 1)) / sum(CASE WHEN v IS NOT NULL THEN n - 1 END)), 6) AS within, round(stddev_samp(m), 6) AS between
           FROM (SELECT arm, task, count(*) AS n, var_samp(ln(tokens)) AS v, avg(ln(tokens)) AS m FROM runs GROUP BY ALL) GROUP BY 1""",
        "runs",
    ),
)
def variance_split(spark, sf):
    return rounded(evals.variance_split(runs(spark, sf)), "within", "between")


@query("a33_bootstrap_interval")
def bootstrap_interval(spark, sf):
    """5,000 draws over all tasks. Seeded numpy generators draw them, which SQL can't: the tests compare with a plain one."""
    return rounded(evals.bootstrap_interval(runs(spark, sf), draws=5000, seed=7), "estimate", "lo", "hi")


#: Tasks that judge pairs.
VERDICT_TASKS = 512


@query(
    "j39_pairwise_verdicts",
    """SELECT pair_id, dimension, CASE WHEN ab = ba AND ab <> 'tie' THEN ab END AS winner, ab = ba AS order_stable,
              CASE WHEN ab = ba THEN 'm' || dimension ELSE 'none' END AS margin
       FROM (SELECT l_orderkey AS pair_id, l_partkey AS dimension,
               CASE l_suppkey % 3 WHEN 0 THEN 'tie' WHEN 1 THEN 'A' ELSE 'B' END AS ab,
               CASE l_suppkey % 4 WHEN 0 THEN 'tie' WHEN 1 THEN 'B' ELSE 'A' END AS ba
             FROM (SELECT l_orderkey, l_partkey, max(l_suppkey) AS l_suppkey FROM lineitem GROUP BY ALL))""",
)
def pairwise_verdicts(spark, sf):
    # a stated number of partitions, which adaptive execution does not join: verdicts meet in rows much wider than the keys
    keys = ["l_orderkey", "l_partkey"]
    dealt = b.table(spark, sf, "lineitem").select(*keys, "l_suppkey").repartition(VERDICT_TASKS, *keys)
    lines = dealt.groupBy(*keys).agg(F.max("l_suppkey").alias("s"))

    def shown(ordering, modulus, first, second):
        call = F.when(F.col("s") % modulus == 0, "tie").when(F.col("s") % modulus == 1, "first").otherwise("second")
        return F.struct(F.lit(ordering).alias("ordering"), F.lit(first).alias("first_arm"), F.lit(second).alias("second_arm"), call.alias("winner"))

    both = lines.select(
        F.col("l_orderkey").alias("pair_id"), F.col("l_partkey").alias("dimension"),
        F.explode(F.array(shown(0, 3, "A", "B"), shown(1, 4, "B", "A"))).alias("shown"),
    )
    return evals.pairwise_verdicts(both.select("pair_id", "dimension", "shown.*", F.concat(F.lit("m"), "dimension").alias("margin")))


@query(
    "j41_marker_occurrences",
    sql(
        """SELECT path, line, item_id AS marker_id, CAST(start AS INTEGER) AS start, false AS attributed FROM (
             SELECT path, line, item_id, marker, content, unnest(range(1, length(content) - length(marker) + 2)) AS start FROM (
               SELECT l.path, l.pos + 1 AS line, m.item_id, m.marker, l.line AS content FROM plain_lines l
               JOIN (SELECT item_id, text AS marker FROM benchmark) m ON contains(l.line, m.marker)))
           WHERE substr(content, start, length(marker)) = marker""",
        "plain_lines",
    ),
)
def marker_occurrences(spark, sf):
    markers = b.table(spark, sf, "benchmark").select(
        F.col("item_id").alias("marker_id"), F.col("text").alias("marker")
    )
    return evals.marker_occurrences(b.files(spark, sf), markers, ["path"])
