"""Globs by their anchors, status records in one scan, posting lookups."""

import random
import re
import time

from pyspark.sql import functions as F

from fleetledger.operators import fileindex, units
from fleetledger.sources import artifacts, bindings


def plain_regex(glob):
    """The glob's meaning, character by character."""
    g, out, i = glob.replace("\\", "/"), "", 0
    while i < len(g):
        if g.startswith("/**/", i):
            out, i = out + "/(?:.*/)?", i + 4
        elif i == 0 and g.startswith("**/"):
            out, i = out + "(?:.*/)?", 3
        elif g.startswith("/**", i) and i + 3 == len(g):
            out, i = out + "/.*", i + 3
        elif g.startswith("**", i):
            out, i = out + ".*", i + 2
        elif g[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif g[i] == "?":
            out, i = out + "[^/]", i + 1
        else:
            out, i = out + re.escape(g[i]), i + 1
    return re.compile(out)


GLOBS = [
    "src/**/*.ts", "**/PLAN_*.md", "logs/**", "*.d.ts", "src/a.ts", "**/b?.js", "a/**/b/*.x", "/abs/*.c", "**", "*",
    "src/*/deep/**", "x**y/z.ts", "**name", "src\\win\\*.ts", "a.b/*", "*.", "dir/", "?", "**/Makefile", "s?c/**/t*.t?",
]
PARTS = ["src", "a", "b", "deep", "logs", "a.b", "win", "x1y", "dir", "name"]
NAMES = ["a.ts", "b1.js", "z.ts", "PLAN_2.md", "q.d.ts", "Makefile", "t1.tx", "k.x", "name", "x.", ".hid", "f.c"]


def test_globs_match_what_their_expressions_do(spark):
    rng = random.Random(1)
    paths = {"/".join([*rng.choices(PARTS, k=rng.randint(0, 4)), rng.choice(NAMES)]) for _ in range(1500)}
    paths |= {"/abs/f.c", "/f.c", "a", "x", "src//a.ts", "x1y/z.ts", "xa/by/z.ts"}
    globs = spark.createDataFrame([("r", i, g) for i, g in enumerate(GLOBS) if g not in ("**", "*")], "repo_id string, glob_no int, glob string")
    files = spark.createDataFrame([("r", p) for p in paths], "repo_id string, path string")
    got = {r.path: r.glob for r in artifacts.glob_imports(globs, files, files.limit(0)).collect()}
    compiled = [(g, plain_regex(g)) for g in GLOBS if g not in ("**", "*")]
    assert got == {p: g for p in paths if (g := next((g for g, x in compiled if x.fullmatch(p)), None))}


def test_globs_of_everything_and_indexed_files(spark):
    files = spark.createDataFrame([("r", "a/b.ts"), ("r", "c"), ("s", "a/b.ts")], "repo_id string, path string")
    globs = spark.createDataFrame([("r", 1, "*"), ("r", 2, "**")], "repo_id string, glob_no int, glob string")
    indexed = spark.createDataFrame([("r", "zzz")], "repo_id string, path string")
    got = {(r.repo_id, r.path): r.glob for r in artifacts.glob_imports(globs, files, indexed).collect()}
    assert got == {("r", "a/b.ts"): "**", ("r", "c"): "*"}
    assert artifacts.glob_imports(globs, files, files).count() == 0


def test_a_thousand_globs_meet_few_of_a_hundred_thousand_files(spark):
    globs = spark.range(1000).select(F.lit("r").alias("repo_id"), F.col("id").alias("glob_no"), F.concat(F.lit("m"), "id", F.lit("/**/*.ts")).alias("glob"))
    files = spark.range(100_000).select(F.lit("r").alias("repo_id"), F.concat(F.lit("m"), F.col("id") % 2000, F.lit("/x/f"), "id", F.lit(".ts")).alias("path"))
    start = time.time()
    assert artifacts.glob_imports(globs, files, files.limit(0)).count() == 50_000
    assert time.time() - start < 60


def plain_records(text):
    records = re.sub("\0$", "", text).split("\0")
    out, i = [], 0
    while i < len(records):
        r = records[i]
        i += 1
        if len(r) < 4:
            continue
        entry = [r[:2], r[3:], None]
        if "R" in r[:2] or "C" in r[:2]:
            if i < len(records):
                entry[2] = records[i]
            i += 1
        out.append(tuple(entry))
    return out


def test_status_records_in_one_scan(spark):
    rng = random.Random(2)
    texts = ["", "\0", "R  a.ts", "R  a.ts\0", "C  a\0\0?? x y\0", " M a\nb.ts\0"]
    for _ in range(200):
        pieces = [rng.choice([" M ", "R  ", " C ", "?? ", "RM ", "", "x", "AB"]) + rng.choice(["", "f.ts", "a b", "R  q"]) for _ in range(rng.randint(0, 9))]
        texts.append("\0".join(pieces) + rng.choice(["", "\0"]))
    frame = spark.createDataFrame(list(enumerate(texts)), "n int, text string")
    got = {}
    for r in artifacts.status_records(frame, ["n"]).collect():
        got.setdefault(r.n, []).append((r.code, r.path, r.from_path))
    for n, text in enumerate(texts):
        assert sorted(got.get(n, []), key=str) == sorted(plain_records(text), key=str), repr(text)


def test_a_hundred_thousand_status_records_take_seconds(spark):
    text = "".join(f" M src/f{i}.ts\0R  new{i}\0old{i}\0" for i in range(50_000))
    start = time.time()
    assert artifacts.status_records(spark.createDataFrame([(1, text)], "n int, text string"), ["n"]).count() == 100_000
    assert time.time() - start < 30


def test_chunk_lookups_add_always_included_files_once(spark):
    entries = spark.createDataFrame(
        [("r", "both", [0, 2]), ("r", "two", [2, 2]), ("r", "always", [0]), ("s", "other", [2]), ("r", "none", [])],
        "repo_id string, path string, chunk_tags array<int>",
    ).withColumn("chunk_tags", F.col("chunk_tags").cast("array<decimal(10,3)>"))
    postings = fileindex.chunk_postings(entries)
    wanted = spark.createDataFrame([("r", 2), ("r", 2), ("r", 0), ("q", 2)], "repo_id string, chunk_id int")
    plain = sorted((int(r.chunk_id), r.path) for r in fileindex.of_chunks(postings, wanted).collect())
    assert plain == [(0, "always"), (0, "both"), (2, "both"), (2, "two")]
    more = sorted((int(r.chunk_id), r.path) for r in fileindex.of_chunks(postings, wanted, True).collect())
    assert more == [(0, "always"), (0, "both"), (2, "always"), (2, "both"), (2, "two")]


def test_tags_are_looked_up_on_any_export(spark):
    exports = spark.createDataFrame(
        [("r", "a", ["x"]), ("r", "a", ["x", "y"]), ("r", "b", []), ("s", "a", ["y"])], "repo_id string, path string, tags array<string>"
    )
    files = spark.createDataFrame([("r", "a", 1), ("r", "b", 2), ("s", "a", 3)], "repo_id string, path string, layer int")
    tags = spark.createDataFrame([("r", "x"), ("r", "y"), ("r", "y"), ("s", "x")], "repo_id string, tag string")
    got = sorted((r.repo_id, r.tag, r.path, r.layer) for r in units.files_by_tag(files, units.tag_postings(exports), tags).collect())
    assert got == [("r", "x", "a", 1), ("r", "y", "a", 1)]


def test_filters_on_raw_paths_read_the_json_once(spark):
    """A filter that the optimizer pushes below the path must not read the number again in every branch that compares it."""
    paths = bindings.raw_paths(spark, "/root/testdata/sf0.001")
    for column in ("path", "word"):
        plan = paths.where(F.length(column) > 3).select(column)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("get_json_object") <= 2
