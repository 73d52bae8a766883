"""What the large joins shuffle, and that they still find the same."""

import itertools
import json

from pyspark.sql import functions as F

from __spark_entry__ import queries
from fleetledger.operators import prompts, references, units

SF = "/root/testdata/sf0.001"


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_mentions_come_once_and_are_not_shuffled(spark):
    paths = ["x.ts", "a/x.ts", "b/a/x.ts", "c/x.ts", "b//x.ts", "d/y.ts", "a/x.ts", "./z.ts"]
    tokens = ["x.ts", "a/x.ts", "q/b/a/x.ts", "e/x.ts", "y.ts", "r/d/y.ts", "w/z.ts", "v/z.ts"]
    texts = [(i, " ".join(t)) for i, t in enumerate(itertools.chain(itertools.combinations(tokens, 2), itertools.combinations(tokens, 3)))]
    rows = spark.createDataFrame([("r", i, t) for i, t in texts], "repo_id string, chunk_id int, text string")
    files = spark.createDataFrame([("r", p) for p in paths], "repo_id string, path string")
    got = references.mentions(rows, files, ["chunk_id"])

    def parts(path):
        return [s for s in path.split("/") if s not in ("", ".")]

    def named(token, path):
        t, p = parts(token), parts(path)
        n = min(len(t), len(p))
        return t[-n:] == p[-n:]

    want = sorted({(i, p) for i, t in texts for p in paths if any(named(w, p) for w in t.split())})
    assert sorted((r.chunk_id, r.path) for r in got.collect()) == want
    top = got._jdf.queryExecution().optimizedPlan().toString().lstrip()
    assert top.startswith("Union")


def test_repeated_units_keep_one_declaration(spark):
    schema = "repo_id string, path string, unit_id string, start int, refs int"
    declared = [("r", "a.ts", "run", 1, 0), ("r", "a.ts", "run~2", 9, 3), ("r", "b.ts", "Kit.run", 2, 0), ("r", "c.ts", "one", 4, None)]
    importers = spark.createDataFrame([("r", "b.ts", "Kit.run", 2)], "repo_id string, path string, base_id string, importers long")
    chosen = units.unit_choices(spark.createDataFrame(declared, schema), importers)
    got = {(r.name, r.path, r.start): (r.declarations, r.evidenced, r.chosen, r.evidence) for r in chosen.collect()}
    assert got == {
        ("run", "a.ts", 1): (2, 2, True, "referenced 3× in its file"),
        ("run", "a.ts", 9): (2, 2, True, "referenced 3× in its file"),
        ("run", "b.ts", 2): (2, 2, True, "imported by 2 files"),
        ("Kit.run", "b.ts", 2): (1, 1, True, None),
        ("one", "c.ts", 4): (1, 0, True, None),
    }
    names = spark.createDataFrame([("r", 7, 1, 0, "run")], "repo_id string, chunk_id int, task_no int, mention_no int, name string")
    focus = units.focused_units(names, chosen).orderBy("position").collect()
    assert [(f.position, f.path, f.unit_id) for f in focus] == [(1, "a.ts", "run"), (2, "a.ts", "run~2"), (3, "b.ts", "Kit.run")]


def test_units_layers_and_files_are_shuffled_seldom(spark):
    most = {"j18_importer_evidence": 8, "j19_declaration_choice": 15, "j16_layer_escalation": 34, "j13_referenced_files": 11}
    assert {n: m for n in most if (m := exchanges(queries()[n](spark, SF))) > most[n]} == {}


def test_candidates_of_imports_are_tried_once_a_base(spark):
    """A thousand files import one module: the candidates that meet the inventory are those of one base."""
    imported = spark.createDataFrame([("r", f"src/f{i}.ts", "./util") for i in range(1000)] * 2, "repo_id string, path string, specifier string")
    files = spark.createDataFrame([("r", "src/util/index.ts"), ("r", "src/util.js")], "repo_id string, path string")
    got = units.resolved_imports(imported, files)
    assert sorted(tuple(r) for r in got.collect()) == sorted(("r", f"src/f{i}.ts", "./util", "src/util.js") for i in range(1000))
    plan = got._jdf.queryExecution().optimizedPlan().toString().splitlines()
    below = plan[next(i for i, line in enumerate(plan) if "Generate" in line) :]
    assert any("Aggregate" in line and "path" not in line.split("],")[0] for line in below)


def test_declared_units_are_dealt_once(spark):
    most = {"j19_declaration_choice": 12, "j28_manifest_entries": 34, "j28_full_entries": 38}
    assert {n: m for n in most if (m := exchanges(queries()[n](spark, SF))) > most[n]} == {}


def test_lines_are_shuffled_once(spark):
    for name in ("j16_layer_escalation", "w6_focused_units", "k5_manifest_documents"):
        df = queries()[name](spark, SF)
        df.collect()
        final = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
        assert final.count("FileScan parquet [l_") == 1, name


def test_plan_tags_read_the_lines_in_one_shuffle(spark):
    df = queries()["j15_plan_tags"](spark, SF)
    df.collect()
    final = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert final.count("FileScan parquet [l_") == 1


def test_tails_meet_files_without_their_token(spark):
    texts = spark.createDataFrame([("r", 1, "see a/b/x.ts"), ("r", 2, "y.ts and q/y.ts")], "repo_id string, chunk_id int, text string")
    files = spark.createDataFrame([("r", "b/x.ts"), ("r", "c/y.ts")], "repo_id string, path string")
    found = references.referenced_files(texts, files)
    assert sorted(tuple(r) for r in found.collect()) == [("r", "b/x.ts", 1), ("r", "c/y.ts", 2)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "length(token" in plan[plan.index("Join Inner") :]


def test_hashes_are_made_where_entries_have_met(spark):
    made = queries()["k5_manifest_documents"](spark, SF)
    plan = made._jdf.queryExecution().executedPlan().toString()
    # below the gathering no hash of a path or of a focused unit is made, only those that renders show
    assert "md5(cast(coalesce" in plan and "md5(cast(path" not in plan


def test_units_bring_ids_that_do_not_begin_with_their_base(spark):
    schema = "repo_id string, path string, unit_id string, base_id string, start int, refs int"
    declared = [("r", "a.ts", "own", "Kit.run", 1, 2), ("r", "a.ts", "Kit.run~2", "Kit.run", 5, None), ("r", "b.ts", "run", "run", 3, 0)]
    importers = spark.createDataFrame([], "repo_id string, path string, base_id string, importers long")
    chosen = units.unit_choices(spark.createDataFrame(declared, schema), importers)
    got = sorted((r.name, r.path, r.base_id, r.unit_id, r.declarations, r.evidenced, r.chosen, r.evidence) for r in chosen.collect() if r.start != 5)
    assert got == [
        ("Kit.run", "a.ts", "Kit.run", "own", 1, 1, True, None),
        ("run", "a.ts", "Kit.run", "own", 2, 1, True, "referenced 2× in its file"),
        ("run", "b.ts", "run", "run", 2, 1, False, None),
    ]
    plan = chosen._jdf.queryExecution().optimizedPlan().toString()
    assert "substring(unit_id" in plan[plan.index("Window") :]


def test_manifests_are_gathered_from_flat_rows(spark):
    schema = ("repo_id string, chunk_id int, position int, ref string, path string, granularity string, tokens long, file_tokens long,"
              " hash string, start long, end long, reason string, task string, evidence string, listed boolean")
    rows = [
        ("r", 1, None, "b.ts", "b.ts", "file", 5, 9, None, None, None, "chunk", None, None, True),
        ("r", 1, 2, "a.ts#z", "a.ts", "unit", 2, 7, "h", 1, 2, "task", "4", None, False),
        ("r", 1, 1, "elsewhere", "a.ts", "unit", 1, 7, None, None, None, "task", None, None, False),
    ]
    asked = spark.createDataFrame([("r", 1, "t"), ("r", 2, "u")], "repo_id string, chunk_id int, text string")
    made = prompts.manifest_documents(spark.createDataFrame(rows, schema), asked, F.lit("now"))
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "partial_collect_list" in plan
    gather = plan[: plan.index("partial_collect_list")]
    # what gathers lies above every exchange of the entries
    assert gather.count("Exchange") <= 1
    got = {r.chunk_id: json.loads(r.manifest) for r in made.collect()}
    assert [e["ref"] for e in got[1]["entries"]] == ["elsewhere", "a.ts#z", "b.ts"]
    assert got[1]["totals"] == {"file_tokens": 16, "tokens": 8}
    assert got[2]["entries"] == [] and got[2]["generated_at"] == "now" and list(got[2]) == sorted(got[2])


def test_verdicts_are_judged_in_many_tasks_from_one_scan(spark):
    plan = queries()["j39_pairwise_verdicts"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1 and plan.count("Exchange") == 1
    assert "REPARTITION_BY_NUM" in plan
