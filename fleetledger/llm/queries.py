"""The named queries of this folder, and the SQL that checks those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetledger.llm.centroids import cluster
from fleetledger.llm.common import Workspace, table
from fleetledger.llm.fingerprint import fingerprints
from fleetledger.llm.html import extract
from fleetledger.llm.langid import identify
from fleetledger.llm.lexical import search
from fleetledger.llm.minhash import near_duplicates
from fleetledger.llm.mixing import mix_to_targets
from fleetledger.llm.packing import pack
from fleetledger.llm.pieces import encode_texts
from fleetledger.llm.pii import TRIAL_KEY, with_pseudonyms
from fleetledger.llm.quality import judge
from fleetledger.llm.sharding import rewritten
from fleetledger.llm.toxicity import classify

def vocabulary() -> str:
    """The vocabulary file that the packing queries read ids from."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def pieces_model() -> str:
    """The merge-type vocabulary file that the encoding query reads."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


Query = Callable[[SparkSession, str], DataFrame]


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"), Workspace(spark))
    return found.select("doc_id", "n_shingles", "component_id", "kept")


QUERIES: dict[str, Query] = {"op1_minhash_dedup": op1_minhash_dedup}
ORACLES: dict[str, str] = {
    "op1_minhash_dedup": r"""
        WITH RECURSIVE texts AS (
          SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                   'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        shingles AS (
          SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS shingle
          FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM texts WHERE len(w) > 0)),
        sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1),
        links AS (
          SELECT x.doc_id AS u, y.doc_id AS v FROM shingles x JOIN shingles y ON x.shingle = y.shingle AND x.doc_id < y.doc_id
          JOIN sizes a ON a.doc_id = x.doc_id JOIN sizes b ON b.doc_id = y.doc_id
          GROUP BY x.doc_id, y.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
        reached AS (
          SELECT doc_id AS node, doc_id AS root FROM documents
          UNION SELECT l.v, r.root FROM reached r JOIN (SELECT u, v FROM links UNION ALL SELECT v, u FROM links) l ON l.u = r.node)
        SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, r.component_id, d.doc_id = r.component_id AS kept
        FROM documents d LEFT JOIN sizes s USING (doc_id)
        JOIN (SELECT node AS doc_id, min(root) AS component_id FROM reached GROUP BY 1) r USING (doc_id)
    """
}


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"), Workspace(spark))


QUERIES["op4_language_id"] = op4_language_id


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), Workspace(spark))


QUERIES["op9_quality_rules"] = op9_quality_rules


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), Workspace(spark))


QUERIES["op2_toxicity"] = op2_toxicity


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_to_targets(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), Workspace(spark))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), Workspace(spark), vocabulary())


QUERIES |= {"op3_mix_sources": op3_mix_sources, "op10_packing": op10_packing}


def op5_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rewritten(table(spark, sf_dir, "documents"), Workspace(spark))


QUERIES["op5_resharding"] = op5_resharding


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"), Workspace(spark))


QUERIES["op8_fingerprints"] = op8_fingerprints


def op6_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return with_pseudonyms(docs, TRIAL_KEY)


QUERIES["op6_pii_pseudonyms"] = op6_pii_pseudonyms


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


QUERIES["op7_html_text"] = op7_html_text


def op13_piece_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = encode_texts(table(spark, sf_dir, "documents"), pieces_model())
    return found.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


QUERIES["op13_piece_encoding"] = op13_piece_encoding


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = cluster(table(spark, sf_dir, "embeddings"), Workspace(spark))
    return found


def _centroid_sql(rounds: int = 10) -> str:
    """The assignments and means of each round, written out one after the other."""
    parts = [
        """WITH kept AS MATERIALIZED (
          SELECT row_number() OVER () AS r, vec_id, embedding FROM embeddings
          WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: isfinite(x))) = 64),
        x AS MATERIALIZED (
          SELECT r, generate_subscripts(embedding, 1) AS d, floor(1024 * unnest(embedding)::DOUBLE)::BIGINT AS v FROM kept),
        c0 AS MATERIALIZED (
          SELECT c, d, v FROM x JOIN (
            SELECT r, row_number() OVER (ORDER BY sha256('3:' || vec_id), r) - 1 AS c FROM kept QUALIFY c < 8) USING (r))"""
    ]
    for i in range(rounds + 1):
        parts.append(
            f"""a{i} AS MATERIALIZED (
          SELECT r, min(distance * 8 + c) % 8 AS c, min(distance * 8 + c) // 8 AS distance FROM (
            SELECT r, c, sum((x.v - m.v) * (x.v - m.v))::BIGINT AS distance FROM x JOIN c{i} m USING (d) GROUP BY r, c)
          GROUP BY r)"""
        )
        if i < rounds:
            parts.append(
                f"""c{i + 1} AS MATERIALIZED (
          SELECT c, d, coalesce(n.v, o.v) AS v FROM c{i} o LEFT JOIN (
            SELECT c, d, (s - ((s % n) + n) % n) // n AS v FROM (
              SELECT c, d, sum(v)::BIGINT AS s, count(*) AS n FROM a{i} JOIN x USING (r) GROUP BY c, d)) n USING (c, d))"""
            )
    return (
        ",\n        ".join(parts)
        + f"""
        SELECT vec_id, c::INTEGER AS cluster, distance::BIGINT AS distance,
          sum(distance) OVER (PARTITION BY c)::BIGINT AS cluster_inertia, sum(distance) OVER ()::BIGINT AS inertia, centroid_sha256
        FROM a{rounds} JOIN kept USING (r)
        JOIN (SELECT c, sha256(string_agg(v::BIGINT::VARCHAR, ',' ORDER BY d)) AS centroid_sha256 FROM c{rounds} GROUP BY c) USING (c)"""
    )


QUERIES["op11_centroids"] = op11_centroids
ORACLES["op11_centroids"] = _centroid_sql()


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), Workspace(spark))


QUERIES["op12_lexical_search"] = op12_lexical_search
ORACLES["op12_lexical_search"] = r"""
    WITH held AS (
      SELECT row_number() OVER () AS d, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
    asked AS (
      SELECT item, item_id, term, count(*) AS times FROM (
        SELECT row_number() OVER () AS item, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
          'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark)
      GROUP BY ALL),
    lengths AS (SELECT d, doc_id, count(*) AS n FROM held GROUP BY ALL),
    size AS (SELECT count(*) AS docs, sum(n)::BIGINT AS total FROM lengths),
    found AS (SELECT d, term, count(*) AS tf FROM held WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
    weights AS (
      SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
      FROM found, size GROUP BY term, docs),
    scored AS (
      SELECT item, item_id, doc_id, d,
        sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // total))))::BIGINT AS score
      FROM asked JOIN found USING (term) JOIN weights USING (term) JOIN lengths USING (d), size
      GROUP BY ALL),
    ranked AS (
      SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST, d) AS rank FROM scored WHERE score > 0)
    SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""
