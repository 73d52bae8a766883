"""Running aggregates published as snapshots and deltas.

An update-mode query emits, per batch, the keys whose aggregates changed. Each batch's rows are a delta under the batch's
id. Every ``every`` batches the deltas so far are merged into a snapshot, and a new generation of deltas begins:

    snapshot=G/               latest aggregate of every key after the first G * every batches
    since=G/batch=N/          what batch N changed, for the batches of generation G
    generations/generation=G  written last, once snapshot and first delta of G are complete

Reading costs the newest complete snapshot and fewer than ``every`` deltas, however many batches there have been. Each
write is keyed by the batch's id and follows from batches already committed, so a batch run again after a failure at
any point writes the same rows again over its own; a reader never sees a generation before it is complete.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

EVERY = 20


def _latest(states: DataFrame, keys: list[str]) -> DataFrame:
    """The row of the last batch for each key, with that batch."""
    values = [c for c in states.columns if c not in keys]
    newest = F.max_by(F.struct(*values), "batch").alias("newest")
    return states.groupBy(*keys).agg(newest).select(*keys, "newest.*")


def _generation_state(spark: SparkSession, path: str, generation: int, keys: list[str]) -> DataFrame:
    """Latest rows as of the snapshot of a generation and its deltas."""
    states = spark.read.parquet(f"{path}/since={generation}")
    if generation:
        states = states.unionByName(spark.read.parquet(f"{path}/snapshot={generation}"))
    return _latest(states, keys)


def write_batch(batch: DataFrame, batch_id: int, path: str, keys: list[str], every: int = EVERY) -> None:
    """Publish one batch: the snapshot first where it opens a generation, then the delta, then the generation's mark."""
    spark = batch.sparkSession
    generation, opens = divmod(batch_id, every)
    if generation and not opens:
        before = _generation_state(spark, path, generation - 1, keys)
        before.write.mode("overwrite").parquet(f"{path}/snapshot={generation}")
    batch.write.mode("overwrite").parquet(f"{path}/since={generation}/batch={batch_id}")
    if not opens:
        spark.range(1).write.mode("overwrite").parquet(f"{path}/generations/generation={generation}")


def publish(running: DataFrame, keys: list[str], path: str, checkpoint: str, every: int = EVERY) -> StreamingQuery:
    """Publish a streaming aggregate over ``keys``. :func:`current` reads its rows so far."""
    writer = running.writeStream.outputMode("update").foreachBatch(
        lambda batch, batch_id: write_batch(batch, batch_id, path, keys, every)
    )
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The aggregates as of the last batch that changed each key."""
    newest = spark.read.parquet(f"{path}/generations").agg(F.max("generation")).first()[0]
    return _generation_state(spark, path, newest, keys).drop("batch")
