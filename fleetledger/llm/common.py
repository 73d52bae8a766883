"""Shared helpers: the work folder, written intermediate tables, input columns and text batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that one step of a Python worker handles at once; a longer text is handled alone.
SLICE_BYTES = 2_000_000


def work_folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share: below spark.checkpoint.dir. Only a local session, where all
    share one machine, may leave the setting out."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="llm-")
    return f"{base.rstrip('/')}/llm-{uuid.uuid4().hex}"


class Workspace:
    """Written tables of one run. Each is read back from storage, so a lost executor costs a reread, not a rerun."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.folder = work_folder(spark)
        self.count = 0

    def save(self, df: DataFrame, name: str) -> DataFrame:
        self.count += 1
        path = f"{self.folder}/{self.count:02d}-{name}"
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))


def text_hash() -> Column:
    """With the id, what tells rows apart when a decision goes back to them."""
    return F.xxhash64(text_or_empty(F.col("text"))).alias("text_hash")


def decided(docs: DataFrame, decisions: DataFrame) -> DataFrame:
    """docs (doc_id, text, ...) with the columns of decisions (doc_id, text_hash, ..., a row per id and text) for the
    rows that have one; null ids match."""
    keyed = decisions.withColumnsRenamed({"doc_id": "__decided_id", "text_hash": "__decided_hash"})
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__decided_id")) & (text_hash() == F.col("__decided_hash"))
    return docs.join(keyed, same).drop("__decided_id", "__decided_hash")


def with_labels(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that have labels, joined on doc_id. The texts are shuffled once whatever the sizes: labels grow
    with the corpus, so a plan that broadcasts them while they are few would tell nothing of one where they are many."""
    return docs.join(labels.hint("shuffle_hash"), "doc_id")


def crc_of_id(doc_id: Column) -> Column:
    """crc32 of the id as text; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def text_slices(
    batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES
) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each holds about limit bytes of text, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for row, size in enumerate(sizes.tolist()):
            if row > start and held + size > limit:
                yield batch.slice(start, row - start)
                start, held = row, 0
            held += size
        yield batch.slice(start)
