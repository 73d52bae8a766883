"""Trees of files, the two-output index parser and what the health audit leaves out."""

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from fleetledger.operators import health
from fleetledger.sources import artifacts, sinks, trees

FILES = {
    "a.md": "top",
    "src/b c.ts": "é" * 3,
    "src/50%+x.ts": "",
    "src/deep/er/d.ts": "one\ntwo\n",
    "node_modules/x/y.js": "no",
    "src/deep/node_modules/z.js": "no",
    ".git/HEAD": "ref",
}


@pytest.fixture
def root(spark, tmp_path):
    at = f"file://{tmp_path}/tree"
    rows = [*FILES.items(), ("null.txt", None)]
    assert trees.write_tree(spark.createDataFrame(rows, "path string, text string").repartition(3), at) == len(rows)
    return at


def ignored(path):
    return "node_modules/" in path or ".git/" in path


def test_listing_prunes_ignored_folders_at_any_depth(spark, root, tmp_path, monkeypatch):
    listed = {r.path: r.size_bytes for r in trees.list_tree(spark, root, f"file://{tmp_path}/levels").collect()}
    assert listed == {p: len(t.encode()) for p, t in FILES.items() if not ignored(p)} | {"null.txt": 0}
    entered = {r.path for r in spark.read.parquet(f"file://{tmp_path}/levels").where("is_dir").collect()}
    assert not any(ignored(p + "/") for p in entered)


def test_listing_without_rules_equals_spark_listing(spark, root, tmp_path):
    listed = trees.list_tree(spark, root, f"file://{tmp_path}/levels", ignored=())
    shown = [tuple(r) for r in listed.collect() if r.size_bytes and not r.path.startswith(".")]
    assert sorted(shown) == sorted(map(tuple, trees.read_inventory(spark, root).collect()))


def test_listing_stops_at_a_depth(spark, root, tmp_path):
    listed = trees.list_tree(spark, root, f"file://{tmp_path}/levels", max_depth=2)
    assert {r.path for r in listed.collect()} == {"a.md", "null.txt", "src/b c.ts", "src/50%+x.ts"}
    assert trees.list_tree(spark, f"{root}/nowhere", f"file://{tmp_path}/none").count() == 0


def test_full_inventory_is_not_cut_into_tasks_of_few_files(spark):
    """Spark's file source makes a partition of 32 small files; the listing must not grow its tasks like that."""
    sf = "/root/testdata/sf0.001"
    listed = queries()["s1_full_inventory"](spark, sf)
    files = listed.count()
    assert files > 300 and listed.rdd.getNumPartitions() < files / 32
    assert listed.where("path LIKE '%node_modules%'").count() > 0 and listed.select("path").distinct().count() == files


def test_whole_texts_come_back(spark, root):
    texts = {r.path: r.text for r in trees.read_texts(spark, root).collect()}
    assert {p: t for p, t in texts.items() if t} == {
        p: t for p, t in FILES.items() if t and not p.startswith(".")
    }
    assert {r.path for r in trees.read_texts(spark, root, "*.ts").collect()} <= {p for p in FILES if p.endswith(".ts")}


def test_listed_files_are_read_whole(spark, root, tmp_path, monkeypatch):
    monkeypatch.setattr(trees, "READ_FILES", 2)
    listed = trees.list_tree(spark, root, f"file://{tmp_path}/levels", ignored=())
    texts = trees.read_listed(listed, root)
    assert sorted((r.path, r.text) for r in texts.collect()) == sorted([*FILES.items(), ("null.txt", "")])
    assert texts.rdd.getNumPartitions() == 1 + 8 // 2


def test_read_tree_is_not_cut_into_tasks_of_few_files(spark):
    read = queries()["s2_read_tree"](spark, "/root/testdata/sf0.001")
    files = read.count()
    assert files > 300 and read.rdd.getNumPartitions() < files / 32


def test_inventory_reads_no_content(spark, root):
    plan = trees.read_inventory(spark, root)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<path:string,length:bigint>" in plan


INDEX = """# Index
| before.ts | no section |
## Chunk 2
| File | Purpose |
|---|---|
| a.ts | first |
|  |
| lonely |
| ../up.ts | out |
## Design notes
| b.ts | closed |
## Always Include
| c.md | doc | more |"""


def test_rejected_lines_say_why(spark):
    texts = spark.createDataFrame([("r", INDEX), ("fine", "## Chunk 1\n| a | b |"), ("none", "")], "repo_id string, text string")
    rejected = artifacts.rejected_lines(texts, ["repo_id"]).orderBy("position").collect()
    assert [(r.line.strip(), r.reason) for r in rejected] == [
        ("| before.ts | no section |", artifacts.CLOSED),
        ("|  |", artifacts.MALFORMED),
        ("| lonely |", artifacts.MALFORMED),
        ("| ../up.ts | out |", artifacts.OUTSIDE),
        ("| b.ts | closed |", artifacts.CLOSED),
    ]
    rows = artifacts.index_rows(texts, ["repo_id"]).collect()
    assert {(r.repo_id, r.path) for r in rows} == {("r", "a.ts"), ("r", "c.md"), ("fine", "a")}
    invalid = artifacts.invalid_indexes(artifacts.rejected_lines(texts, ["repo_id"]), ["repo_id"]).collect()
    assert [(r.repo_id, r.error) for r in invalid] == [("r", "fewer than two columns: |  |")]


def test_each_side_of_a_parted_write_is_read_alone(spark, tmp_path):
    rows = spark.range(10)
    path = f"file://{tmp_path}/parted"
    sinks.write_parted(rows, F.col("id") > 6, "big", path)
    assert sorted(r.id for r in sinks.read_parted(spark, path, "big", True).collect()) == [7, 8, 9]
    small = sinks.read_parted(spark, path, "big", False)
    assert small.count() == 7 and "PartitionFilters: [isnotnull(big" in small._jdf.queryExecution().executedPlan().toString()


def test_broken_sources_leave_out_what_needs_them(spark):
    found = spark.createDataFrame(
        [
            (repo, "warning", code, "m", False)
            for repo, codes in {
                "state": ("SESSION_STATE_INVALID", "FILE_INDEX_INVALID", "FILE_INDEX_LARGE", "SESSION_STALE"),
                "index": ("FILE_INDEX_INVALID", *health.INDEX_CODES, "PLAN_MISSING", "PROMPT_MISSING", "SESSION_STALE"),
                "fine": ("BUDGET_EXCEEDED", "SESSION_STALE"),
            }.items()
            for code in codes
        ],
        "repo_id string, severity string, code string, message string, fixable boolean",
    )
    kept = {}
    for r in health.audit(found.where("code < 'M'"), found.where("code >= 'M'")).collect():
        kept.setdefault(r.repo_id, set()).add(r.code)
    assert kept == {
        "state": {"SESSION_STATE_INVALID"},
        "index": {"FILE_INDEX_INVALID", "PLAN_MISSING", "PROMPT_MISSING", "SESSION_STALE"},
        "fine": {"BUDGET_EXCEEDED", "SESSION_STALE"},
    }


def test_one_code_is_audited_by_the_rules_that_decide_on_it(spark):
    """The findings of a code are those of the whole audit, without the tables of the other rules."""
    sf = "/root/testdata/sf0.001"
    whole = queries()["h_health_audit"](spark, sf).collect()
    codes = {r.code for r in whole}
    # h5 reads other tables than the audit does
    named = {n: q(spark, sf) for n, q in queries().items() if n[0] == "h" and n[:3] != "h5_" and n.partition("_")[2].upper() in codes}
    assert len(named) > 5
    for name, found in named.items():
        code = name.partition("_")[2].upper()
        assert sorted(r.repo_id for r in found.collect()) == sorted(r.repo_id for r in whole if r.code == code)
    for name in ("h1_session_state_invalid", "h11_session_stale"):
        plan = queries()[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Relation [") <= 2


def test_pages_lie_whole_in_few_files(spark, tmp_path):
    rows = spark.range(20_000).select(F.concat(F.lit("r"), F.col("id") % 2).alias("repo_id"), "id", F.floor(F.col("id") / 20).alias("page"))
    path = f"file://{tmp_path}/pages"
    sinks.write_pages(rows.repartition(5), path)
    read = spark.read.parquet(path)
    assert read.count() == 20_000 and len(read.inputFiles()) < 50
    assert read.groupBy("repo_id", "page").agg(F.countDistinct("_metadata.file_path").alias("files")).where("files > 1").count() == 0
