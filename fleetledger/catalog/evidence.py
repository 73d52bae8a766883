"""Queries for session verification, drift and index audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetledger.catalog.history import rounded
from fleetledger.catalog.registry import query
from fleetledger.catalog.relations import K, RELATIONS, sql, src
from fleetledger.functions.text import content_hash
from fleetledger.operators import drift, evidence
from fleetledger.sources import bindings as b

RELATIONS["dirty"] = (
    ("hist",),
    f"""SELECT DISTINCT repo_id, CASE WHEN k % 5 = 0 THEN '.session/STATE' || k || '.md' WHEN k % 5 = 1 THEN '.env'
          ELSE {src('k % 50')} END AS path FROM hist WHERE event_type = 'error'""",
)
RELATIONS["claimed"] = (("hist",), f"SELECT DISTINCT repo_id, {src('k % 50')} AS path FROM hist WHERE event_type = 'click'")
RELATIONS["indexed"] = (("hist",), f"SELECT DISTINCT repo_id, {src('k % 50')} AS path FROM hist WHERE event_type = 'signup'")
RELATIONS["recent"] = (
    ("changes", "hist"),
    """SELECT DISTINCT c.repo_id, c.path FROM changes c JOIN (SELECT repo_id, min(ordinal) AS oldest FROM (
         SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY ordinal DESC) AS r FROM hist) WHERE r <= 20
         GROUP BY 1) o USING (repo_id) WHERE c.ordinal >= o.oldest""",
)
RELATIONS["seen"] = (("dirty", "recent"), "SELECT * FROM dirty UNION SELECT * FROM recent")
RELATIONS["unbacked"] = (("claimed", "seen"), "SELECT * FROM claimed ANTI JOIN seen USING (repo_id, path)")
RELATIONS["unindexed"] = (
    ("dirty", "indexed"),
    "SELECT * FROM (SELECT * FROM dirty WHERE path NOT LIKE '.%') ANTI JOIN indexed USING (repo_id, path)",
)
RELATIONS["done_tasks"] = ((), "SELECT 'repo-' || c_custkey AS repo_id, c_nationkey AS done FROM customer")


def _listing(relation: str, text: str) -> str:
    return f"""SELECT repo_id, count(*) || '{text}' || string_agg(path, ', ' ORDER BY path) FILTER (r <= 5)
                 || CASE WHEN count(*) > 5 THEN ', +' || (count(*) - 5) || ' more' ELSE '' END AS message
               FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY path) AS r FROM {relation}) GROUP BY 1"""


RELATIONS["verified"] = (
    ("unbacked", "unindexed", "done_tasks", "seen", "dirty"),
    f"""SELECT repo_id, 'warning' AS severity, 'UNBACKED_WORKED_FILE' AS code, message FROM ({_listing(
          'unbacked', ' last worked files have no commit or working-tree change behind them: ')})
        UNION ALL SELECT repo_id, 'warning', 'UNINDEXED_CHANGE', message FROM ({_listing(
          'unindexed', ' modified files are absent from the file index: ')})
        UNION ALL SELECT repo_id, 'info', 'UNCOMMITTED_SESSION', message FROM ({_listing(
          "(SELECT * FROM dirty WHERE path LIKE '.session/%')", ' session files have uncommitted changes: ')})
        UNION ALL SELECT repo_id, 'error', 'DONE_WITHOUT_EVIDENCE',
          done || ' tasks are marked done without any change behind them'
        FROM done_tasks WHERE done > 0 AND repo_id NOT IN (SELECT repo_id FROM seen)""",
)


def _event_paths(spark, sf, event_type, path):
    events = b.table(spark, sf, "events").where(F.col("event_type") == event_type)
    return events.select(F.concat(F.lit("repo-"), F.col("user_id").cast("string")).alias("repo_id"), path.alias("path")).distinct()


def _k():
    return F.get_json_object("props", "$.k").cast("int")


def _src(number):
    return F.concat(F.lit("src/f"), number.cast("string"), F.lit(".ts"))


def dirty(spark, sf):
    path = (
        F.when(_k() % 5 == 0, F.concat(F.lit(".session/STATE"), _k().cast("string"), F.lit(".md")))
        .when(_k() % 5 == 1, ".env")
        .otherwise(_src(_k() % 50))
    )
    return _event_paths(spark, sf, "error", path)


def claimed(spark, sf):
    return _event_paths(spark, sf, "click", _src(_k() % 50))


def indexed(spark, sf):
    return _event_paths(spark, sf, "signup", _src(_k() % 50))


def recent(spark, sf):
    return evidence.recent_changes(b.changes(spark, sf), b.commits(spark, sf), 20)


def done_tasks(spark, sf):
    return b.table(spark, sf, "customer").select(
        F.concat(F.lit("repo-"), F.col("c_custkey").cast("string")).alias("repo_id"),
        F.col("c_nationkey").alias("done"),
    )


@query("w18_recent_changes", sql("SELECT * FROM recent", "recent"))
def recent_changes(spark, sf):
    return recent(spark, sf)


@query("u1_evidence", sql("SELECT * FROM seen", "seen"))
def evidence_union(spark, sf):
    return evidence.evidence(dirty(spark, sf), recent(spark, sf))


@query("j3_unbacked_files", sql("SELECT * FROM unbacked", "unbacked"))
def unbacked_files(spark, sf):
    return evidence.unbacked_files(claimed(spark, sf), evidence_union(spark, sf))


@query("j4_unindexed_changes", sql("SELECT * FROM unindexed", "unindexed"))
def unindexed_changes(spark, sf):
    return evidence.unindexed_changes(dirty(spark, sf), indexed(spark, sf))


@query(
    "j5_done_without_evidence",
    sql("SELECT * FROM done_tasks WHERE done > 0 AND repo_id NOT IN (SELECT repo_id FROM seen)", "done_tasks", "seen"),
)
def done_without_evidence(spark, sf):
    return evidence.done_without_evidence(done_tasks(spark, sf), evidence_union(spark, sf))


@query("j6_uncommitted_session", sql("SELECT * FROM dirty WHERE path LIKE '.session/%'", "dirty"))
def uncommitted_session(spark, sf):
    return evidence.uncommitted_session(dirty(spark, sf))


def verify_findings(spark, sf):
    return evidence.verify_findings(
        claimed(spark, sf), dirty(spark, sf), recent(spark, sf), indexed(spark, sf), done_tasks(spark, sf)
    )


@query("l4_verify_findings", sql("SELECT * FROM verified", "verified"))
def verify(spark, sf):
    return verify_findings(spark, sf).drop("fixable")


@query(
    "a15_severity_tally",
    sql(
        """SELECT repo_id, count_if(severity = 'error') AS errors, count_if(severity = 'warning') AS warnings,
                  count_if(severity = 'info') AS infos, count_if(severity <> 'info') = 0 AS healthy
           FROM verified GROUP BY 1""",
        "verified",
    ),
)
def severity_tally(spark, sf):
    return evidence.severity_tally(verify_findings(spark, sf))


@query(
    "s17_committed_by",
    sql(
        f"""SELECT DISTINCT c.repo_id, c.path FROM changes c JOIN hist h USING (repo_id, ordinal)
            LEFT JOIN (SELECT repo_id, min(ordinal) AS base FROM boundaries GROUP BY 1) b ON b.repo_id = c.repo_id
            WHERE c.ordinal > coalesce(b.base, -1) AND h.k % 7 <> 0 AND h.k % 3 = 1""",
        "changes",
        "boundaries",
    ),
)
def committed_by(spark, sf):
    authored = b.table(spark, sf, "events").select(
        F.concat(F.lit("repo-"), F.col("user_id").cast("string")).alias("repo_id"),
        F.col("event_id").alias("ordinal"),
        (_k() % 7 == 0).alias("is_merge"),
        F.concat(F.lit("Dev"), (_k() % 3).cast("string"), F.lit("@Example.org")).alias("author_email"),
        (F.col("event_type") == "signup").alias("is_boundary"),
    )
    base = authored.where("is_boundary").groupBy("repo_id").agg(F.min("ordinal").alias("base_ordinal"))
    return evidence.committed_by(authored, b.changes(spark, sf), base, "dev1@example.ORG")


# Drift ----------------------------------------------------------------------

RELATIONS["hashed"] = (("files",), "SELECT repo_id, path, substr(sha256(text), 1, 16) AS hash FROM files")
RELATIONS["hashed_next"] = (("files_next",), "SELECT repo_id, path, substr(sha256(text), 1, 16) AS hash FROM files_next")


def hashed(files):
    return files.select("repo_id", "path", content_hash(F.col("text")).alias("hash"))


@query(
    "j8_freshness",
    sql(
        """SELECT h.repo_id, h.path, CASE WHEN n.path IS NULL THEN 'removed' WHEN h.path LIKE 'docs/de/%' THEN 'unknown'
                  WHEN h.hash = n.hash THEN 'current' ELSE 'stale' END AS freshness
           FROM hashed h LEFT JOIN hashed_next n USING (repo_id, path)""",
        "hashed",
        "hashed_next",
    ),
)
def freshness(spark, sf):
    recorded = hashed(b.files(spark, sf)).withColumn(
        "hash", F.when(~F.col("path").startswith("docs/de/"), F.col("hash"))
    )
    return drift.freshness(recorded, hashed(b.files_next(spark, sf)))


@query(
    "j9_refresh_plan",
    sql(
        """SELECT repo_id, path, CASE WHEN n.hash IS NULL THEN 'dropped' WHEN h.hash IS NULL THEN 'added'
                  WHEN h.hash = n.hash THEN 'kept' ELSE 'reread' END AS action
           FROM hashed h FULL OUTER JOIN hashed_next n USING (repo_id, path)""",
        "hashed",
        "hashed_next",
    ),
)
def refresh_plan(spark, sf):
    return drift.refresh_plan(hashed(b.files(spark, sf)), hashed(b.files_next(spark, sf)))


@query(
    "j43_changed_test_files",
    sql(
        """SELECT repo_id, path FROM hashed h FULL OUTER JOIN hashed_next n USING (repo_id, path)
           WHERE h.hash IS DISTINCT FROM n.hash""",
        "hashed",
        "hashed_next",
    ),
)
def changed_test_files(spark, sf):
    plan = drift.refresh_plan(hashed(b.files(spark, sf)), hashed(b.files_next(spark, sf)))
    return plan.where("action <> 'kept'").select("repo_id", "path")


@query(
    "u5_merged_index",
    sql(
        """SELECT repo_id, path, n.hash FROM hashed_next n""",
        "hashed_next",
    ),
)
def merged_index(spark, sf):
    before, after = hashed(b.files(spark, sf)), hashed(b.files_next(spark, sf))
    plan = drift.refresh_plan(before, after)
    updated = after.join(plan.where("action IN ('added', 'reread')"), ["repo_id", "path"], "left_semi")
    return drift.merge_index(before, updated, after)


# Units of a document are its lines 1-2 and 3-4.
RELATIONS["doc_units"] = (
    ("files", "files_next"),
    """SELECT repo_id, path, unit_id, start, "end", substr(sha256(coalesce(string_agg(line, chr(10) ORDER BY n)
              FILTER (n BETWEEN start AND "end"), '')), 1, 16) AS hash, is_next
       FROM (SELECT *, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS n
             FROM (SELECT repo_id, path, text, false AS is_next FROM files
                   UNION ALL SELECT repo_id, path, text, true FROM files_next)),
            (VALUES ('head', 1, 2), ('next', 3, 4)) u(unit_id, start, "end") GROUP BY ALL""",
)


def doc_units(files):
    spans = F.array(
        F.struct(F.lit("head").alias("unit_id"), F.lit(1).alias("start"), F.lit(2).alias("end")),
        F.struct(F.lit("next").alias("unit_id"), F.lit(3).alias("start"), F.lit(4).alias("end")),
    )
    from fleetledger.functions.text import slice_lines

    listed = files.select("repo_id", "path", "text", F.inline(spans))
    return listed.select(
        "repo_id", "path", "unit_id", "start", "end",
        content_hash(slice_lines(F.col("text"), F.col("start"), F.col("end"))).alias("hash"),
    )


@query(
    "a16_hash_fidelity",
    sql(
        """SELECT a.repo_id, a.path, a.unit_id FROM (SELECT * FROM doc_units WHERE NOT is_next) a
           LEFT JOIN (SELECT * FROM doc_units WHERE is_next) n USING (repo_id, path, unit_id)
           WHERE a.hash IS DISTINCT FROM n.hash""",
        "doc_units",
    ),
)
def hash_fidelity(spark, sf):
    return drift.hash_fidelity(doc_units(b.files(spark, sf)), b.files_next(spark, sf))


@query(
    "j7_manifest_drift",
    sql(
        """SELECT repo_id, ref, path, granularity, drift, CASE WHEN drift = 'moved' THEN 'MOVED_CONTEXT' ELSE 'STALE_CONTEXT' END AS code
           FROM (SELECT a.repo_id, a.path || '#' || a.unit_id AS ref, a.path, 'unit' AS granularity,
                   CASE WHEN n.path IS NULL THEN 'removed' WHEN n.hash <> a.hash THEN 'changed'
                        WHEN a.unit_id = 'next' AND a.path LIKE 'docs/en/%' THEN 'moved' END AS drift
                 FROM (SELECT * FROM doc_units WHERE NOT is_next) a
                 LEFT JOIN (SELECT * FROM doc_units WHERE is_next) n USING (repo_id, path, unit_id)
                 UNION ALL SELECT h.repo_id, h.path, h.path, 'file', CASE WHEN n.hash IS NULL THEN 'removed'
                   WHEN n.hash <> h.hash THEN 'changed' END FROM hashed h LEFT JOIN hashed_next n USING (repo_id, path))
           WHERE drift IS NOT NULL""",
        "doc_units",
        "hashed",
        "hashed_next",
    ),
)
def manifest_drift(spark, sf):
    units = doc_units(b.files(spark, sf)).select(
        "repo_id", "path", F.concat("path", F.lit("#"), "unit_id").alias("ref"), F.lit("unit").alias("granularity"),
        "hash", "start", "end",
    )
    whole = hashed(b.files(spark, sf)).select(
        "repo_id", "path", F.col("path").alias("ref"), F.lit("file").alias("granularity"), "hash",
        F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("end"),
    )
    shifted = F.when((F.col("unit_id") == "next") & F.col("path").startswith("docs/en/"), 1).otherwise(0)
    now = doc_units(b.files_next(spark, sf)).withColumn("start", F.col("start") + shifted)
    return drift.manifest_drift(units.unionByName(whole), now, hashed(b.files_next(spark, sf)))


# A manifest per order: one entry per line, the even line numbers being units.
RELATIONS["manifest"] = (
    (),
    """SELECT l_orderkey AS manifest_id, 'src/p' || l_partkey || '.ts' AS path,
              CAST(l_linenumber AS BIGINT) * 1000000000000 + CAST(round(l_extendedprice * 100) AS BIGINT) AS entry_no,
              CASE WHEN l_linenumber % 2 = 0 THEN 'unit' ELSE 'file' END AS granularity,
              CAST(l_quantity AS BIGINT) AS tokens, CAST(ceil(l_extendedprice / 100) AS BIGINT) AS file_tokens FROM lineitem""",
)


def manifest_entries(spark, sf):
    return b.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("manifest_id"),
        F.concat(F.lit("src/p"), F.col("l_partkey").cast("string"), F.lit(".ts")).alias("path"),
        (
            F.col("l_linenumber").cast("long") * 1_000_000_000_000 + F.round(F.col("l_extendedprice") * 100).cast("long")
        ).alias("entry_no"),
        F.when(F.col("l_linenumber") % 2 == 0, "unit").otherwise("file").alias("granularity"),
        F.col("l_quantity").cast("long").alias("tokens"),
        F.ceil(F.col("l_extendedprice") / 100).cast("long").alias("file_tokens"),
    )


RELATIONS["reduced"] = (
    ("manifest",),
    """SELECT m.manifest_id, sum(m.tokens) AS tokens, any_value(f.file_tokens) AS file_tokens,
              sum(CASE WHEN granularity = 'unit' THEN m.tokens ELSE 0 END) AS unit_tokens,
              sum(CASE WHEN granularity = 'unit' THEN m.file_tokens ELSE 0 END) AS unit_file_tokens
       FROM manifest m JOIN (SELECT manifest_id, sum(t) AS file_tokens FROM (
         SELECT manifest_id, path, arg_max(file_tokens, entry_no) AS t FROM manifest GROUP BY ALL) GROUP BY 1) f USING (manifest_id)
       GROUP BY 1""",
)


@query("a13_manifest_totals", sql("SELECT manifest_id, tokens, file_tokens FROM reduced", "reduced"))
def manifest_totals(spark, sf):
    return drift.reduction(manifest_entries(spark, sf), ["manifest_id"]).select("manifest_id", "tokens", "file_tokens")


@query(
    "a17_reduction",
    sql(
        """SELECT manifest_id, unit_tokens, unit_file_tokens,
                  round(CASE WHEN unit_file_tokens > 0 THEN unit_tokens / unit_file_tokens END, 6) AS unit_ratio,
                  round(tokens / file_tokens, 6) AS manifest_ratio FROM reduced""",
        "reduced",
    ),
)
def reduction(spark, sf):
    reduced = drift.reduction(manifest_entries(spark, sf), ["manifest_id"]).drop("tokens", "file_tokens")
    return rounded(reduced, "unit_ratio", "manifest_ratio")


@query(
    "j10_stale_entries",
    sql("SELECT repo_id, path FROM hashed ANTI JOIN hashed_next USING (repo_id, path)", "hashed", "hashed_next"),
)
def stale_entries(spark, sf):
    return drift.stale_entries(b.files(spark, sf).select("repo_id", "path"), b.files_next(spark, sf))


@query(
    "j10_missing_chunk_files",
    sql(
        """SELECT DISTINCT repo_id, chunk_id FROM (SELECT repo_id, unnest(depends_on) AS chunk_id FROM chunks) t
           WHERE chunk_id <> 0 AND NOT EXISTS (SELECT 1 FROM chunks c WHERE c.repo_id = t.repo_id AND c.chunk_id = t.chunk_id)""",
        "chunks",
    ),
)
def missing_chunk_files(spark, sf):
    chunks = b.chunks(spark, sf)
    tagged = chunks.select("repo_id", F.col("depends_on").alias("chunk_tags"))
    return drift.missing_chunk_files(tagged, chunks)
