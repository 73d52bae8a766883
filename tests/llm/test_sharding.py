"""The files of a resharding."""

from fleetledger.llm import queries, sharding
from fleetledger.llm.common import Workspace
from tests.llm.util import AWKWARD, SF, documents

COLUMNS = ("doc_id", "size", "text_crc32", "law", "old_shard", "shard", "slot", "grown_shard")


def rows(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=repr)


def test_the_query_writes_the_affected_files_and_reads_them(spark, monkeypatch):
    made = []
    monkeypatch.setattr(queries, "Workspace", lambda s: made.append(Workspace(s)) or made[-1])
    found = queries.op5_resharding(spark, SF)
    placed = sharding.reshard(spark.read.parquet(f"{SF}/documents.parquet"), Workspace(spark))
    assert rows(found) == rows(placed)
    files = spark.read.parquet(f"{made[0].folder}/shards")
    touched = {s for r in placed.where("shard <> old_shard").collect() for s in (r.shard, r.old_shard)}
    assert touched and {r.shard for r in files.select("shard").distinct().collect()} == touched
    assert files.count() == sum(r.shard in touched for r in placed.collect())


def test_awkward_rows_have_their_places_in_files(spark):
    many = [*AWKWARD, *[(None, f"t{i % 3}", "en") for i in range(30)], *[(9, "same", "en")] * 20, (9, "other", "en"), (0, "t1", "en")]
    docs = documents(spark, many)
    assert rows(sharding.rewritten(docs, Workspace(spark))) == rows(sharding.reshard(docs, Workspace(spark)))
    assert sharding.rewritten(documents(spark, []), Workspace(spark)).count() == 0
