"""Queries for lint rules, secrets and text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetledger.catalog.registry import query
from fleetledger.catalog.relations import RELATIONS, WS, sql, trim
from fleetledger.functions import code, markdown as md
from fleetledger.functions import secrets as sc
from fleetledger.functions import text as t
from fleetledger.functions.binding import unnest
from fleetledger.functions.paths import is_path_shaped
from fleetledger.operators import lint, secrets
from fleetledger.sources import bindings as b

RELATIONS["norm"] = (
    ("plain_lines",),
    f"""SELECT *, lead(line, 1) OVER w AS second, lead(line, 2) OVER w AS third,
               row_number() OVER w - 1 AS n FROM (
          SELECT repo_id, path, pos, lower({trim('line')}) AS line FROM plain_lines) WHERE line <> ''
        WINDOW w AS (PARTITION BY path ORDER BY pos)""",
)
RELATIONS["blocks"] = (
    ("norm",),
    """SELECT repo_id, path, n, line || chr(10) || second || chr(10) || third AS block FROM norm
       WHERE third IS NOT NULL""",
)


@query(
    "w3_shingles",
    sql("SELECT repo_id, path, CAST(n AS INTEGER) AS pos, md5(block) AS digest FROM blocks", "blocks"),
)
def shingles(spark, sf):
    return lint.shingles(b.files(spark, sf)).select("repo_id", "path", "pos", F.md5("block").alias("digest"))


@query(
    "j12_duplicate_blocks",
    sql(
        """SELECT h.repo_id, h.block_id, g.first_path, h.path, g.files,
                  CASE WHEN length(h.first) > 60 THEN substr(h.first, 1, 60) || '…' ELSE h.first END AS preview
           FROM (SELECT DISTINCT repo_id, path, sha256(block) AS block_id, split_part(block, chr(10), 1) AS first
                 FROM blocks WHERE length(block) >= 30) h
           JOIN (SELECT repo_id, sha256(block) AS block_id, min(path) AS first_path, count(DISTINCT path) AS files
                 FROM blocks WHERE length(block) >= 30 GROUP BY ALL HAVING count(DISTINCT path) > 1) g
             USING (repo_id, block_id) WHERE h.path <> g.first_path""",
        "blocks",
    ),
)
def duplicate_blocks(spark, sf):
    return lint.duplicate_blocks(b.files(spark, sf))


@query(
    "w15_soft_language",
    sql(
        r"""SELECT repo_id, path, pos + 1 AS line, 'maybe' AS phrase,
                   'Replace "maybe" with a definitive statement or remove' AS suggestion
            FROM md_lines WHERE regexp_matches(raw, '(?i)\bmaybe\b')""",
        "md_lines",
    ),
)
def soft_language(spark, sf):
    return lint.soft_language(b.markdown_files(spark, sf))


@query(
    "sc19_soft_patterns",
    """SELECT conv_id, turn, CASE WHEN turn % 4 = 0 THEN 'You should consider' WHEN turn % 4 = 1 THEN 'possibly'
          WHEN turn % 4 = 2 THEN 'might be worth' ELSE 'if needed' END AS phrase FROM conversations""",
)
def soft_patterns(spark, sf):
    turn = F.col("turn") % 4
    hedged = (
        F.when(turn == 0, "You should consider ")
        .when(turn == 1, "x if needed, possibly ")
        .when(turn == 2, "it might be worth optionally ")
        .otherwise("if needed ")
    )
    flat = F.regexp_replace("text", "\n", " ")
    notes = b.table(spark, sf, "conversations").select(
        F.col("conv_id").alias("repo_id"), F.col("turn").alias("path"), F.concat(hedged, flat).alias("text")
    )
    found = lint.soft_language(notes)
    return found.select(F.col("repo_id").alias("conv_id"), F.col("path").alias("turn"), "phrase")


@query(
    "j11_dead_references",
    sql(
        r"""SELECT repo_id, path, line, mention FROM (
              SELECT repo_id, path, pos + 1 AS line, unnest(regexp_extract_all(raw, '@([\w./-]+\.\w+)', 1)) AS mention
              FROM md_lines) m WHERE NOT EXISTS (
                SELECT 1 FROM files f WHERE f.repo_id = m.repo_id AND f.path = m.mention)""",
        "md_lines",
        "files",
    ),
)
def dead_references(spark, sf):
    return lint.dead_references(b.markdown_files(spark, sf), b.files(spark, sf))


RELATIONS["keys"] = (
    ("md_lines",),
    " UNION ALL ".join(
        f"""SELECT repo_id, path, pos + 1 AS line, '{name}' AS pattern, unnest(regexp_extract_all(raw, '{expression.replace("'", "''")}'))
            AS secret FROM md_lines"""
        for name, expression in sc.PATTERNS
    ),
)


@query(
    "sec1_secret_findings",
    sql(
        """SELECT repo_id, path, line, pattern, substr(secret, 1, 4) || repeat('*', length(secret) - 4) AS redacted
           FROM keys""",
        "keys",
    ),
)
def secret_findings(spark, sf):
    return secrets.secret_findings(b.markdown_files(spark, sf))


EMAIL = (("E-mail address", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"),)


@query(
    "sec1_custom_pattern",
    sql(
        r"""SELECT repo_id, path, line, 'E-mail address' AS pattern,
                   substr(secret, 1, 4) || repeat('*', greatest(length(secret) - 4, 0)) AS redacted
            FROM (SELECT repo_id, path, pos + 1 AS line,
                    unnest(regexp_extract_all(line, '\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b')) AS secret
                  FROM plain_lines)""",
        "plain_lines",
    ),
)
def custom_pattern(spark, sf):
    return secrets.secret_findings(b.files(spark, sf), EMAIL)


@query(
    "sec2_redacted_texts",
    sql(
        """SELECT f.path, coalesce(k.patterns, '') AS patterns, coalesce(k.n, 0) AS masked_chars
           FROM files f LEFT JOIN (SELECT path, string_agg(DISTINCT pattern, ', ' ORDER BY pattern) AS patterns,
             sum(length(secret) - 4) AS n FROM keys GROUP BY 1) k USING (path)""",
        "files",
        "keys",
    ),
)
def redacted_texts(spark, sf):
    plain = b.markdown_files(spark, sf).withColumn("before", _stars(F.col("text")))
    clean = secrets.redacted(plain)
    return clean.select(
        "path",
        F.array_join(F.array_sort("patterns"), ", ").alias("patterns"),
        (_stars(F.col("text")) - F.col("before")).alias("masked_chars"),
    )


def _stars(text):
    return F.length(text) - F.length(F.replace(text, F.lit("*"), F.lit("")))


@query(
    "sec3_guard_verdicts",
    sql(
        """SELECT f.path, f.text_has, coalesce(k.hits, 0) AS hits, f.text_has OR coalesce(k.hits, 0) = 0 AS allowed
           FROM (SELECT path, false AS text_has FROM files) f
           LEFT JOIN (SELECT path, count(*) AS hits FROM keys GROUP BY 1) k USING (path)""",
        "files",
        "keys",
    ),
)
def guard_verdicts(spark, sf):
    judged = secrets.guard_verdicts(b.markdown_files(spark, sf), strict=True)
    return judged.select("path", F.col("bypassed").alias("text_has"), "hits", "allowed")


@query(
    "a28_guard_summary",
    sql(
        """SELECT repo_id, path, sum(n) AS secrets, sum(n) || CASE WHEN sum(n) = 1 THEN ' secret' ELSE ' secrets' END
                  || ' detected (' || string_agg(pattern, ', ' ORDER BY line, pattern) || ')' AS summary
           FROM (SELECT repo_id, path, pattern, count(*) AS n, min(line) AS line FROM keys GROUP BY ALL) GROUP BY ALL""",
        "keys",
    ),
)
def guard_summary(spark, sf):
    return secrets.guard_summary(secrets.secret_findings(b.markdown_files(spark, sf)), ["repo_id", "path"])


# Text functions -------------------------------------------------------------


@query(
    "sc1_token_estimate",
    sql("SELECT path, CAST(ceil(octet_length(encode(text)) / 4) AS BIGINT) AS tokens FROM files", "files"),
)
def token_estimate(spark, sf):
    return b.files(spark, sf).select("path", t.token_estimate(F.col("text")).alias("tokens"))


@query("sc2_token_estimate_from_size", sql("SELECT path, CAST(ceil(size_bytes / 4) AS BIGINT) AS tokens FROM files", "files"))
def token_estimate_from_size(spark, sf):
    return b.files(spark, sf).select("path", t.token_estimate_from_size(F.col("size_bytes")).alias("tokens"))


@query("sc3_content_hash", sql("SELECT path, substr(sha256(text), 1, 16) AS hash FROM files", "files"))
def content_hash(spark, sf):
    return b.files(spark, sf).select("path", t.content_hash(F.col("text")).alias("hash"))


@query("s2_whole_text_read", sql("SELECT path, text FROM files", "files"))
def whole_text_read(spark, sf):
    return b.files(spark, sf).select("path", "text")


@query(
    "sc4_line_slice",
    sql(
        "SELECT path, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (pos BETWEEN 1 AND 4), '') AS part FROM plain_lines GROUP BY 1",
        "plain_lines",
    ),
)
def line_slice(spark, sf):
    return b.files(spark, sf).select("path", t.slice_lines(F.col("text"), F.lit(2), F.lit(5)).alias("part"))


@query(
    "sc37_normalized_line",
    sql(f"SELECT path, pos + 1 AS line, md5(lower({trim('line')})) AS digest FROM plain_lines", "plain_lines"),
)
def normalized_line(spark, sf):
    lines = lint.file_lines(b.files(spark, sf))
    return lines.select("path", "line", F.md5(t.normalize_line(F.col("content"))).alias("digest"))


@query("p12_control_chars", sql(r"SELECT path, regexp_matches(text, '[\x00-\x1f\x7f]') AS has_control FROM files", "files"))
def control_chars(spark, sf):
    return b.files(spark, sf).select("path", t.has_control_char(F.col("text")).alias("has_control"))


@query(
    "p13_content_kind",
    sql(
        f"SELECT path, pos + 1 AS line, CASE WHEN {trim('line')} = '' THEN 'blank' ELSE 'changed' END AS kind FROM plain_lines",
        "plain_lines",
    ),
)
def content_kind(spark, sf):
    lines = lint.file_lines(b.files(spark, sf))
    return lines.select("path", "line", t.content_kind(F.col("content")).alias("kind"))


RELATIONS["words"] = (
    ("plain_lines",),
    r"SELECT path, pos + 1 AS line, unnest(string_split_regex(line, '\s+')) AS word FROM plain_lines",
)


def _words(spark, sf):
    lines = lint.file_lines(b.files(spark, sf))
    return unnest(lines, ["path", "line"], F.split("content", r"\s+", -1), ["word"])


@query(
    "p6_path_shaped_words",
    sql(r"SELECT path, line, count_if(regexp_full_match(word, '[A-Za-z0-9._\-+@/]+')) AS shaped FROM words GROUP BY ALL", "words"),
)
def path_shaped_words(spark, sf):
    return _words(spark, sf).groupBy("path", "line").agg(F.count_if(is_path_shaped(F.col("word"))).alias("shaped"))


@query(
    "p14_code_shaped_words",
    sql(
        r"""SELECT path, line, count_if(contains(word, '.') OR regexp_matches(word, '.[A-Z]')
                     OR regexp_matches(word, '[_$\d]')) AS shaped FROM words GROUP BY ALL""",
        "words",
    ),
)
def code_shaped_words(spark, sf):
    from fleetledger.functions.refs import is_code_shaped

    return _words(spark, sf).groupBy("path", "line").agg(F.count_if(is_code_shaped(F.col("word"))).alias("shaped"))


@query(
    "p15_unit_ids",
    r"""SELECT p_partkey, regexp_full_match(replace(p_name, ' ', '.'), '[A-Za-z_$][A-Za-z0-9_$]*(\.#?[A-Za-z0-9_$-]+)?(~\d+)?')
               AS dotted, regexp_full_match(p_name, '[A-Za-z_$][A-Za-z0-9_$]*') AS plain FROM part""",
)
def unit_ids(spark, sf):
    parts = b.table(spark, sf, "part")
    return parts.select(
        "p_partkey",
        code.is_unit_id(F.regexp_replace("p_name", " ", ".")).alias("dotted"),
        code.is_unit_id(F.col("p_name")).alias("plain"),
    )


@query(
    "sc23_script_bodies",
    """SELECT page_id, CAST(nth AS INTEGER) AS nth, body FROM (
         SELECT page_id, unnest(range(len(found))) AS nth, unnest(found) AS body FROM (
           SELECT page_id, regexp_extract_all(html, '(?is)<script(?:\\s[^>]*)?>(.*?)(?:</script|$)', 1) AS found FROM pages))""".replace("\\\\", "\\"),
)
def script_bodies(spark, sf):
    return unnest(b.table(spark, sf, "pages"), ["page_id"], code.script_bodies(F.col("html")), ["nth", "body"])


@query(
    "sc23_script_program",
    """SELECT page_id, length(html) AS chars, length(html) - length(replace(html, chr(10), '')) AS newlines FROM pages""",
)
def script_program(spark, sf):
    program = code.script_program(F.col("html"))
    return b.table(spark, sf, "pages").select(
        "page_id",
        F.length(program).alias("chars"),
        (F.length(program) - F.length(F.replace(program, F.lit("\n"), F.lit("")))).alias("newlines"),
    )


# A doc comment per document: its lines behind stars, with annotations planted by position.
_COMMENT_SQL = """' * @ai-' || CASE pos % 6 WHEN 0 THEN 'summary ' || line WHEN 1 THEN 'surface Public' WHEN 2 THEN 'tag a' || pos || ' rest'
  WHEN 3 THEN 'layer-hint ' || (pos % 4) WHEN 4 THEN 'tag Bad_Tag' ELSE 'other x' END"""
RELATIONS["comment_lines"] = (
    ("plain_lines",),
    f"SELECT path, pos, line, CASE WHEN pos % 2 = 0 THEN ' * ' || line ELSE ({_COMMENT_SQL}) END AS text FROM plain_lines",
)


def _comments(spark, sf):
    def planted(line, pos):
        p = pos.cast("string")
        tag = (
            F.when(pos % 6 == 1, "surface Public")
            .when(pos % 6 == 3, F.concat(F.lit("layer-hint "), (pos % 4).cast("string")))
            .otherwise("other x")
        )
        return F.when(pos % 2 == 0, F.concat(F.lit(" * "), line)).otherwise(F.concat(F.lit(" * @ai-"), tag))

    return b.files(spark, sf).select("path", F.array_join(F.transform(t.lines_of(F.col("text")), planted), "\n").alias("comment"))


@query(
    "sc20_first_sentence",
    sql(
        rf"""SELECT path, coalesce(arg_min(bare, pos) FILTER (bare <> '' AND NOT starts_with(bare, '@')), '') AS sentence
             FROM (SELECT path, pos, {trim(r"regexp_replace(text, '^\s*\*+\s?', '')")} AS bare FROM comment_lines) GROUP BY 1""",
        "comment_lines",
    ),
)
def first_sentence(spark, sf):
    return _comments(spark, sf).select("path", code.first_sentence(F.col("comment")).alias("sentence"))


@query(
    "sc22_annotations",
    sql(
        """SELECT path, CASE WHEN count_if(pos % 6 = 1) > 0 THEN 'public' END AS surface,
                  arg_min(pos % 4, pos) FILTER (pos % 6 = 3 AND pos % 4 < 3) AS layer_hint
           FROM comment_lines GROUP BY 1""",
        "comment_lines",
    ),
)
def annotations(spark, sf):
    parsed = _comments(spark, sf).select("path", code.annotations(F.col("comment")).alias("a"))
    return parsed.select("path", "a.surface", "a.layer_hint")


@query(
    "sc21_signature",
    sql(
        rf"""SELECT path, CASE WHEN length(header) > 200 THEN substr(header, 1, 200) || '…' ELSE header END AS signature
             FROM (SELECT path, regexp_replace({trim("regexp_extract(substr(replace(text, '. ', '; '), 1, 250), '^([^{;]*)', 1)")},
                     '[{WS}]+', ' ', 'g') AS header FROM files)""",
        "files",
    ),
)
def signature(spark, sf):
    return b.files(spark, sf).select("path", code.signature(F.replace("text", F.lit(". "), F.lit("; "))).alias("signature"))


@query(
    "sc25_managed_block",
    sql(
        r"""SELECT path, md5(regexp_replace(text, '(?s)en(.*?)(?:er|\z)', '', 'g')) AS user_part,
               md5(array_to_string(regexp_extract_all(text, '(?s)en(.*?)(?:er|\z)', 1), '')) AS managed_part FROM files""",
        "files",
    ),
)
def managed_block(spark, sf):
    # "en" and "er" stand in for the markers, so that every document holds many blocks.
    user, managed = md.managed_block(F.col("text"), "en", "er")
    return b.files(spark, sf).select("path", F.md5(user).alias("user_part"), F.md5(managed).alias("managed_part"))
