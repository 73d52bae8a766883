"""The relations of ``sources.bindings`` as SQL, for the oracles."""

from __future__ import annotations

K = "CAST(json_extract_string(props, '$.k') AS INTEGER)"
DOC_PATH = "'docs/' || lang || '/' || CAST(doc_id AS VARCHAR) || '.md'"
# Fixed value: the characters a full trim removes, in RE2 syntax.
WS = r"\s\x0B\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"


def trim(expr: str) -> str:
    return f"regexp_replace({expr}, '^[{WS}]+|[{WS}]+$', '', 'g')"


def src(number: str) -> str:
    return f"('src/f' || CAST({number} AS VARCHAR) || '.ts')"


RELATIONS: dict[str, tuple[tuple[str, ...], str]] = {
    "files": (
        (),
        f"""SELECT source AS repo_id, {DOC_PATH} AS path, text, doc_id, lang,
                   CAST(octet_length(encode(text)) AS BIGINT) AS size_bytes FROM documents""",
    ),
    "files_next": (
        (),
        f"""SELECT *, CAST(octet_length(encode(text)) AS BIGINT) AS size_bytes FROM (
              SELECT source AS repo_id,
                CASE WHEN n_chars % 7 = 0 THEN 'archive/' || CAST(doc_id AS VARCHAR) || '.md'
                     ELSE {DOC_PATH} END AS path,
                CASE WHEN n_chars % 5 = 0 THEN text || chr(10) || chr(10) || 'revised' ELSE text END AS text
              FROM documents)""",
    ),
    "plain_lines": (
        (),
        f"""SELECT repo_id, path, doc_id, unnest(range(len(parts))) AS pos, unnest(parts) AS line FROM (
              SELECT source AS repo_id, {DOC_PATH} AS path, doc_id, string_split(text, chr(10)) AS parts
              FROM documents)""",
    ),
    "md_lines": (
        ("plain_lines",),
        """SELECT repo_id, path, doc_id, pos, CASE
             WHEN pos % 7 = 0 AND pos % 3 = 0 THEN '## Phase ' || CAST(pos // 7 AS VARCHAR) || ': ' || line
             WHEN pos % 7 = 0 AND pos % 3 = 1 THEN '### ' || line
             WHEN pos % 7 = 0 THEN '# ' || line
             WHEN pos % 13 = 6 THEN '  ```ts'
             WHEN pos % 11 = 3 THEN '- [ ] ' || line
             WHEN pos % 11 = 5 THEN '- [x] ' || line
             WHEN pos % 11 = 9 THEN '* [-] ' || line
             WHEN pos % 5 = 2 THEN line || ' @docs/en/' || CAST(doc_id + pos AS VARCHAR) || '.md'
             WHEN pos % 9 = 4 THEN 'maybe ' || line
             WHEN pos % 17 = 1 THEN line || ' AKIA' || upper(substr(sha256(line), 1, 16))
             WHEN pos % 19 = 8 THEN '> Depends on: Chunks 1, ' || CAST(pos AS VARCHAR)
             WHEN pos % 23 = 10 THEN '> Est. sessions: ' || CAST(pos AS VARCHAR)
             WHEN pos % 29 = 15 THEN '---'
             ELSE line END AS raw FROM plain_lines""",
    ),
    "md_trim": (("md_lines",), f"SELECT *, {trim('raw')} AS trimmed FROM md_lines"),
    "md_scan": (
        ("md_trim",),
        """SELECT *, is_fence OR before % 2 = 1 AS in_fence FROM (
             SELECT *, coalesce(sum(CAST(is_fence AS INTEGER)) OVER (
                 PARTITION BY path ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
             FROM (SELECT *, regexp_matches(trimmed, '^(```|~~~)') AS is_fence FROM md_trim))""",
    ),
    "md_heads": (
        ("md_scan",),
        r"""SELECT *, CASE WHEN in_fence THEN 0
                   ELSE length(regexp_extract(trimmed, '^(#{1,6})\s+(.+)$', 1)) END AS depth FROM md_scan""",
    ),
    "context_log": (
        (),
        f"""SELECT 'repo-' || CAST(user_id // 7 AS VARCHAR) AS repo_id,
                   CAST(user_id AS VARCHAR) || '-' || strftime(ts, '%Y-%m-%d') AS session_id, ts, event_id,
                   CASE WHEN event_type IN ('view', 'click')
                        THEN [{src(K)}, {src('(' + K + ' * 3) % 40')}] ELSE [] END AS files_loaded,
                   CASE WHEN event_type = 'purchase' THEN [{src(K)}] ELSE [] END AS modifications,
                   CAST(round(value) AS BIGINT) AS total_tokens FROM events""",
    ),
    "log_index": (
        (),
        f"""SELECT DISTINCT 'repo-' || CAST(user_id // 7 AS VARCHAR) AS repo_id, {src(K)} AS path,
                   {K} % 10 = 0 AS always_include FROM events WHERE event_type IN ('error', 'signup')""",
    ),
    "loads": (
        ("context_log",),
        """SELECT repo_id, path, count(*) AS n FROM (
             SELECT repo_id, unnest(files_loaded) AS path FROM context_log) GROUP BY ALL""",
    ),
    "mods": (
        ("context_log",),
        """SELECT repo_id, path, max(ts) AS last_modified FROM (
             SELECT repo_id, ts, unnest(modifications) AS path FROM context_log) GROUP BY ALL""",
    ),
    "hist": (
        (),
        f"""SELECT 'repo-' || CAST(user_id AS VARCHAR) AS repo_id, event_id AS ordinal,
                   'c' || CAST(event_id AS VARCHAR) AS sha, ts, event_type, value, {K} AS k FROM events""",
    ),
    "boundaries": (
        ("hist",),
        """SELECT repo_id, ordinal, sha, lead(ordinal) OVER (PARTITION BY repo_id ORDER BY ordinal) AS next_ordinal,
                  lead(sha) OVER (PARTITION BY repo_id ORDER BY ordinal) AS next_sha, k
           FROM hist WHERE event_type = 'signup'""",
    ),
    "declared": (
        ("boundaries",),
        f"""SELECT DISTINCT repo_id, ordinal, path FROM (
              SELECT repo_id, ordinal, {src('k % 10')} AS path FROM boundaries
              UNION ALL SELECT repo_id, ordinal, {src('k // 10')} FROM boundaries
              UNION ALL SELECT repo_id, ordinal, {src('(k * 7) % 10')} FROM boundaries)""",
    ),
    "changes": (
        ("hist",),
        f"""SELECT repo_id, ordinal, CASE WHEN k % 11 = 0 THEN 'docs/notes.md' ELSE {src('k % 10')} END AS path,
                   'b' || CAST(CAST(floor(value) AS BIGINT) % 3 AS VARCHAR) AS blob
            FROM hist WHERE event_type IN ('purchase', 'error')""",
    ),
    "touched": (("net_changed",), "SELECT * FROM net_changed WHERE path NOT LIKE 'docs/%'"),
    "net_changed": (
        ("boundaries", "changes"),
        """SELECT b.repo_id, b.ordinal, p.path FROM boundaries b
           JOIN (SELECT DISTINCT repo_id, path FROM changes) p ON p.repo_id = b.repo_id
           WHERE (SELECT arg_max(c.blob, c.ordinal) FROM changes c
                  WHERE c.repo_id = b.repo_id AND c.path = p.path AND c.ordinal <= b.ordinal)
             IS DISTINCT FROM
                 (SELECT arg_max(c.blob, c.ordinal) FROM changes c
                  WHERE c.repo_id = b.repo_id AND c.path = p.path
                    AND (b.next_ordinal IS NULL OR c.ordinal <= b.next_ordinal))""",
    ),
    "outcomes": (
        ("declared", "touched"),
        """SELECT coalesce(d.repo_id, t.repo_id) AS repo_id, coalesce(d.ordinal, t.ordinal) AS ordinal,
                  coalesce(d.path, t.path) AS path, d.path IS NOT NULL AS is_declared, t.path IS NOT NULL AS is_touched
           FROM declared d FULL OUTER JOIN touched t
             ON d.repo_id = t.repo_id AND d.ordinal = t.ordinal AND d.path = t.path""",
    ),
    "scores": (
        ("boundaries", "outcomes"),
        """SELECT b.repo_id, b.sha, b.ordinal, count_if(o.is_declared) AS declared,
                  count_if(o.is_touched) AS touched, count_if(o.is_declared AND o.is_touched) AS hits,
                  count_if(o.is_touched AND NOT o.is_declared) AS missed,
                  count_if(o.is_declared AND NOT o.is_touched) AS unused
           FROM boundaries b LEFT JOIN outcomes o ON o.repo_id = b.repo_id AND o.ordinal = b.ordinal
           GROUP BY b.repo_id, b.sha, b.ordinal""",
    ),
    "chunks": (
        (),
        """SELECT 'repo-' || CAST(o_custkey % 20 AS VARCHAR) AS repo_id, o_orderkey AS chunk_id,
                  'Order for ' || CAST(o_custkey AS VARCHAR) AS title,
                  [o_orderkey - 1, o_orderkey + o_custkey] AS depends_on, o_orderstatus AS state,
                  o_orderdate AS last_updated, CAST(ceil(o_totalprice / 100) AS BIGINT) AS brief_tokens FROM orders""",
    ),
    "tasks": (
        (),
        """SELECT l_orderkey AS chunk_id,
                  CAST(l_linenumber AS BIGINT) * 1000000000000 + l_partkey * 1000000 + l_suppkey AS task_no,
                  'Update `Part' || l_partkey || '` in s' || l_suppkey || '.ts, then p' || l_partkey || '/s'
                    || l_suppkey || '.ts.' AS text,
                  CASE WHEN l_linestatus = 'F' THEN 'done' WHEN l_returnflag = 'N' THEN 'todo'
                       ELSE 'in-progress' END AS status,
                  CAST(ceil(l_extendedprice) AS BIGINT) AS tokens,
                  'src/p' || l_partkey || '/s' || l_suppkey || '.ts' AS path,
                  l_partkey AS partkey, l_suppkey AS suppkey FROM lineitem""",
    ),
}


def sql(body: str, *uses: str) -> str:
    """``body`` behind the WITH clause of every relation it uses, dependencies first."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        for dep in RELATIONS[name][0]:
            visit(dep)
        if name not in ordered:
            ordered.append(name)

    for use in uses:
        visit(use)
    if not ordered:
        return body
    ctes = ",\n".join(f"{name} AS ({RELATIONS[name][1]})" for name in ordered)
    return f"WITH {ctes}\n{body}"
