"""Queries over commit history: replay scoring and evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetledger.catalog.registry import query
from fleetledger.catalog.relations import sql
from fleetledger.operators import replay
from fleetledger.sources import bindings as b


def _replay_inputs(spark, sf):
    return b.commits(spark, sf), b.prompts(spark, sf), b.changes(spark, sf)


def rounded(df, *names):
    for name in names:
        df = df.withColumn(name, F.round(name, 6))
    return df


@query(
    "j1_replay_scores",
    sql(
        """SELECT repo_id, sha, declared, touched, hits, missed, unused,
                  round(CASE WHEN declared > 0 THEN hits / declared END, 6) AS precision,
                  round(CASE WHEN touched > 0 THEN hits / touched END, 6) AS recall FROM scores""",
        "scores",
    ),
)
def replay_scores(spark, sf):
    return rounded(replay.replay_scores(*_replay_inputs(spark, sf)).drop("boundary"), "precision", "recall")


@query(
    "j1_replay_outcomes",
    sql(
        """SELECT repo_id, ordinal AS boundary, path, CASE WHEN is_declared AND is_touched THEN 'hit'
                  WHEN is_touched THEN 'missed' ELSE 'unused' END AS outcome FROM outcomes""",
        "outcomes",
    ),
)
def replay_outcomes(spark, sf):
    outcomes = replay.replay_outcomes(*_replay_inputs(spark, sf))
    return outcomes.select("repo_id", "boundary", "path", "outcome")


@query(
    "a1_replay_report",
    sql(
        """SELECT h.repo_id, round(s.mp, 6) AS mean_precision, round(s.mr, 6) AS mean_recall,
                  round(s.waste, 6) AS waste_ratio, h.found AS boundaries_found,
                  coalesce(s.n, 0) AS boundaries_scored,
                  CASE WHEN h.found = 0 THEN 'no prompt is tracked in this repository''s history' END
                    AS unavailable_reason
           FROM (SELECT repo_id, count_if(event_type = 'signup') AS found FROM hist GROUP BY 1) h
           LEFT JOIN (SELECT repo_id, avg(CASE WHEN declared > 0 THEN hits / declared END) AS mp,
                             avg(CASE WHEN touched > 0 THEN hits / touched END) AS mr,
                             CASE WHEN sum(declared) > 0 THEN sum(unused) / sum(declared) END AS waste,
                             count(*) AS n FROM scores GROUP BY 1) s USING (repo_id)""",
        "hist",
        "scores",
    ),
)
def replay_report(spark, sf):
    commits, prompts, changes = _replay_inputs(spark, sf)
    report = replay.replay_report(replay.replay_scores(commits, prompts, changes), commits)
    return rounded(report, "mean_precision", "mean_recall", "waste_ratio")


@query(
    "j2_boundary_intervals",
    sql("SELECT repo_id, ordinal, sha, next_ordinal, next_sha FROM boundaries", "boundaries"),
)
def boundary_intervals(spark, sf):
    return replay.boundary_intervals(b.commits(spark, sf))


@query(
    "l6_newest_boundaries",
    sql(
        """SELECT repo_id, ordinal, sha, recency FROM (
             SELECT *, CAST(row_number() OVER (PARTITION BY repo_id ORDER BY ordinal DESC) AS INTEGER) AS recency
             FROM boundaries) WHERE recency <= 10""",
        "boundaries",
    ),
)
def newest_boundaries(spark, sf):
    return replay.newest_boundaries(b.commits(spark, sf), limit=10)


@query(
    "s12_net_changes",
    sql("SELECT repo_id, ordinal AS boundary, path FROM net_changed", "net_changed"),
)
def net_changes(spark, sf):
    return replay.net_changes(b.commits(spark, sf), b.changes(spark, sf))
