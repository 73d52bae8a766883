"""From documents to packed sequences: quality rules, near duplicates, personal data, mixing, packing.

STAGES lists the stages in order. Each takes (spark, docs, sf_dir), docs being what its predecessor kept, and all but
the last return the columns of docs. run() applies them to the documents of sf_dir, each stage's result written and read
again, so that a stage starts from storage. No stage can be told in SQL: ORACLE_SQL is None."""

from __future__ import annotations

import os
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetledger.llm.common import Workspace, decided, table
from fleetledger.llm.minhash import near_duplicates
from fleetledger.llm.mixing import mix_to_targets
from fleetledger.llm.packing import pack
from fleetledger.llm.pii import TRIAL_KEY, with_pseudonyms
from fleetledger.llm.quality import judge
from fleetledger.llm.queries import vocabulary

#: Similarity of word shingles from which documents are near duplicates.
SIMILARITY = Fraction(80, 100)
#: Environment variable with the secret that pseudonyms are made with.
KEY_VARIABLE = "PSEUDONYM_KEY"

ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. Rows of equal id and text are decided alike."""
    work = Workspace(spark)
    verdicts = judge(docs, table(spark, sf_dir, "labels"), work).groupBy("doc_id", "text_hash")
    kept = work.save(verdicts.agg(F.max("kept").alias("judged")), "verdicts").where("judged").drop("judged")
    return decided(docs, kept).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the least id of each component, once. Components without any id keep each distinct text."""
    work = Workspace(spark)
    found = near_duplicates(docs, work, SIMILARITY).where(F.col("kept") | F.col("component_id").isNull())
    kept = work.save(found.groupBy("doc_id", "text_hash").agg(F.count("*").alias("__times")), "kept")
    rows = decided(docs, kept)
    # a row that is there once, as nearly all are, need not be compared with others
    first = rows.where("__times = 1").select(docs.columns)
    again = rows.where("__times > 1").select(docs.columns).dropDuplicates(["doc_id", "text"])
    return first.union(again)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with pseudonyms in place of personal data; n_chars follows the text."""
    key = os.environ.get(KEY_VARIABLE, "").encode() or TRIAL_KEY
    rows = with_pseudonyms(docs, key).select(docs.columns)
    length = F.char_length("text").cast(docs.schema["n_chars"].dataType)
    return rows.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), length))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their rates say, so that expected tokens of each domain meet the targets."""
    work = Workspace(spark)
    mixed = mix_to_targets(docs, table(spark, sf_dir, "labels"), work).groupBy("doc_id", "text_hash")
    copies = work.save(mixed.agg(F.first("copies").alias("__copies")), "copies").where("__copies > 0")
    rows = decided(docs, copies).withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies"))))
    return rows.select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of token ids, one piece of a document each."""
    return pack(docs, Workspace(spark), vocabulary())


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("personal_data", personal_data),
    ("mixing", mixing),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = Workspace(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = work.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
