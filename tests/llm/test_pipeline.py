from collections import Counter

import corpus_pipeline
from fleetledger.llm.common import Workspace
from tests.llm.util import AWKWARD, SF, documents


def test_stages_hand_on_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    work = Workspace(spark)
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = work.save(stage(spark, docs, SF), name)
        assert docs.columns == columns
        seen[name] = Counter(r.doc_id for r in docs.select("doc_id").collect())
    assert set(seen["near_dedup"]) <= set(seen["quality_rules"]) and max(seen["near_dedup"].values()) == 1
    assert seen["personal_data"] == seen["near_dedup"]
    assert set(seen["mixing"]) <= set(seen["personal_data"])
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert Counter(r.doc_id for r in packed.where("start = 0").select("doc_id").collect()) == seen["mixing"]


def test_awkward_rows_pass_every_stage(spark):
    long = "a document of twenty different words that each of the rules lets pass since nothing in it is said more than once"
    rows = [*AWKWARD, (20, long + " or so", "en"), (20, long + " or so", "en"), (21, long.upper() + " OR SO", "en"), (None, long + " q r s t", None)]
    for rows in (rows, []):
        docs = documents(spark, rows)
        for name, stage in corpus_pipeline.STAGES:
            docs = Workspace(spark).save(stage(spark, docs, SF), name)
        assert docs.count() >= 0
