"""Streaming jobs over the context-log feed and over arriving text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from fleetledger.operators.memory import log_totals, stats_of_totals
from fleetledger.operators.secrets import guard_verdicts
from fleetledger.streaming import published

FILE_KEYS, REPO_KEYS = ["repo_id", "path"], ["repo_id"]


def deduplicated(stream: DataFrame, delay: str = "7 days") -> DataFrame:
    """Log entries once per (session, timestamp). ``delay`` must cover the feed's replay window."""
    return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["repo_id", "session_id", "ts"])


def append_log(stream: DataFrame, path: str, checkpoint: str, delay: str = "7 days") -> StreamingQuery:
    writer = deduplicated(stream, delay).writeStream.format("parquet").option("path", path)
    return writer.option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def load_counts(stream: DataFrame) -> DataFrame:
    """Running loads and last modification per file."""
    none = F.lit(None).cast("timestamp")
    uses = F.concat(
        F.transform("files_loaded", lambda p: F.struct(p.alias("path"), F.lit(1).alias("load"), none.alias("at"))),
        F.transform("modifications", lambda p: F.struct(p.alias("path"), F.lit(0).alias("load"), F.col("ts").alias("at"))),
    )
    return (
        stream.select("repo_id", F.inline(uses))
        .groupBy("repo_id", "path")
        .agg(F.sum("load").alias("loads"), F.max("at").alias("last_modified"))
    )


def maintain_counts(stream: DataFrame, path: str, checkpoint: str, every: int = published.EVERY) -> StreamingQuery:
    """Publish the running counts per file; :func:`current_counts` reads them."""
    return published.publish(load_counts(stream), FILE_KEYS, path, checkpoint, every)


def current_counts(spark: SparkSession, path: str) -> DataFrame:
    """``repo_id, path, loads, last_modified`` as of the last batch that changed each file's counts."""
    return published.current(spark, path, FILE_KEYS)


def maintain_stats(stream: DataFrame, path: str, checkpoint: str, every: int = published.EVERY) -> StreamingQuery:
    """Publish the running totals per repository; :func:`current_stats` reads the statistics they give."""
    return published.publish(log_totals(stream), REPO_KEYS, path, checkpoint, every)


def current_stats(spark: SparkSession, path: str) -> DataFrame:
    """Entries, first and last date and rounded mean tokens per repository, as of the last batch."""
    return stats_of_totals(published.current(spark, path, REPO_KEYS))


def retained(stream: DataFrame, cutoff: str) -> DataFrame:
    """Entries no older than a retention cutoff."""
    return stream.where(F.col("ts") >= F.to_timestamp(F.lit(cutoff)))


def append_retained(stream: DataFrame, cutoff: str, path: str, checkpoint: str) -> StreamingQuery:
    writer = retained(stream, cutoff).writeStream.format("parquet").option("path", path)
    return writer.option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def guard_texts(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Scan arriving texts; those with secrets go to the quarantine, the folders ``allowed=false``.

    Each batch is scanned and written once, under its own id, so a batch run again after a failure replaces itself.
    """

    def split(batch: DataFrame, batch_id: int) -> None:
        judged = guard_verdicts(batch, strict=True)
        judged.write.mode("overwrite").partitionBy("allowed").parquet(f"{path}/batch={batch_id}")

    return (
        stream.writeStream.foreachBatch(split)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def guarded_texts(spark: SparkSession, path: str, allowed: bool) -> DataFrame:
    """The texts that passed, or those in quarantine."""
    texts = spark.read.parquet(path).withColumn("allowed", F.col("allowed").cast("boolean"))
    return texts.where(F.col("allowed") == allowed).drop("batch")
