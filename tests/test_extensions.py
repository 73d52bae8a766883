"""Custom plan sources beside the built-in ones."""

import pytest

from fleetledger.plans import extensions

TEXTS = {
    "declared": "## Chunk 1: One\n- [ ] a\n## Chunk 2: Two\n- [ ] b",
    "plain": "## One\ntext\n## Two\ntext",
    "tasks": "- [ ] a\n- [x] b",
    "prose": "nothing here",
    "rst": "nothing here .. step:: one",
    "empty": "",
}


def registry(**confidence):
    found = extensions.PlanSources()
    for name, value in confidence.items():
        found.register(name, lambda text, value=value: value, lambda text: [(1, "whole")])
    return found


@pytest.fixture
def files(spark):
    rows = [("r", name, text) for name, text in TEXTS.items()] + [("r", "null", None)]
    return spark.createDataFrame(rows, "repo_id string, path string, text string")


def formats(source, files):
    return {r.path: r.format for r in source.ranked(files).collect()}


def test_one_argmax_over_built_in_and_custom_sources(files):
    none = {"prose": "none", "rst": "none", "empty": "none", "null": "none"}
    assert formats(registry(), files) == {"declared": "headings", "plain": "headings", "tasks": "task-list"} | none
    middling = formats(registry(own=0.55), files)
    assert middling["declared"] == "headings" and middling["plain"] == "headings" and middling["tasks"] == "own"
    assert middling["prose"] == "own"
    assert set(formats(registry(own=0.99), files).values()) == {"own"}
    assert formats(registry(own=0.29), files) == formats(registry(), files)


def test_ties_go_to_the_first_registered(files):
    assert formats(registry(own=0.95), files)["declared"] == "headings"
    assert formats(registry(b=0.9, a=0.9), files)["prose"] == "b"
    ranking = registry(b=0.9, a=0.9).ranked(files).where("path = 'tasks'").first().ranking
    assert [(r.name, r.confidence) for r in ranking] == [("b", 0.9), ("a", 0.9), ("task-list", 0.5), ("headings", 0.0)]


def test_the_winner_parses(files):
    found = extensions.PlanSources()
    found.register("steps", lambda t: 0.7 if ".. step::" in t else float("nan"), lambda t: [(2.5, t.split(":: ")[1])])
    got = sorted((r.path, r.source, r.chunk_id, r.title) for r in found.chunks(files).collect())
    assert got == [
        ("declared", "headings", 1.0, "One"),
        ("declared", "headings", 2.0, "Two"),
        ("plain", "headings", 1.0, "One"),
        ("plain", "headings", 2.0, "Two"),
        ("rst", "steps", 2.5, "one"),
        ("tasks", "task-list", 1.0, got[-1][3]),
    ]


def test_names_are_checked():
    found = registry(own=0.5)
    for name in ("headings", "own", "Upper", "a b"):
        with pytest.raises(ValueError):
            found.register(name, lambda t: 0.0, lambda t: [])
    assert found.unregister("own") and not found.unregister("own")


def test_texts_become_python_one_at_a_time_and_rows_leave_in_blocks(spark):
    registry = extensions.PlanSources()
    registry.register("every-line", lambda text: 0.99, lambda text: ((n, line) for n, line in enumerate(text.split("\n"))))
    n = extensions.BLOCK_ROWS + 7
    files = spark.createDataFrame([("r", "a.md", "\n".join(map(str, range(n)))), ("r", "b.md", ""), ("r", "c.md", None)], "repo_id string, path string, text string")
    found = registry.chunks(files)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "MapInPandas" not in plan
    rows = found.collect()
    assert sorted(int(r.title) for r in rows if r.path == "a.md") == list(range(n))
    assert [(r.path, r.chunk_id, r.title) for r in rows if r.path != "a.md"] == [("b.md", 0.0, ""), ("c.md", 0.0, "")]
