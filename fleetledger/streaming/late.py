"""Late rows as a side output of an event-time watermark.

Spark's own watermark drops late rows inside stateful operators. Here each batch is written once, its rows parted into
those on time and those late, so that nothing is lost and late rows can be counted, repaired or replayed.

A batch's watermark is the greatest event time of all earlier batches less the delay, as in Spark. That greatest time
is carried from batch to batch as one row under the batch's id. A batch run again after a failure reads its
predecessor's row, parts its rows the same way and writes over its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

_HIGH = "high_us long"


def _high(spark: SparkSession, path: str, batch_id: int) -> int | None:
    """The greatest event time of the batches up to this one, in microseconds; null while there is none."""
    if batch_id < 0:
        return None
    return spark.read.schema(_HIGH).parquet(f"{path}/high/batch={batch_id}").first()[0]


def part_batch(batch: DataFrame, batch_id: int, path: str, time: str, delay: str) -> None:
    """Write one batch parted by ``late``, then the greatest event time so far."""
    spark = batch.sparkSession
    high = _high(spark, path, batch_id - 1)
    watermark = F.timestamp_micros(F.lit(high)) - F.expr(f"INTERVAL {delay}")
    seen = Observation()
    parted = batch.withColumn("late", F.coalesce(F.col(time) < watermark, F.lit(False)))
    parted = parted.observe(seen, F.max(F.unix_micros(time)).alias("high"))
    parted.write.mode("overwrite").partitionBy("late").parquet(f"{path}/rows/batch={batch_id}")
    newest = max((h for h in (high, seen.get["high"]) if h is not None), default=None)
    spark.createDataFrame([(newest,)], _HIGH).write.mode("overwrite").parquet(f"{path}/high/batch={batch_id}")


def split_late(stream: DataFrame, path: str, checkpoint: str, time: str = "ts", delay: str = "7 days") -> StreamingQuery:
    """Append a stream to ``path``, late rows apart. A row whose time is null is on time."""
    writer = stream.writeStream.foreachBatch(lambda batch, batch_id: part_batch(batch, batch_id, path, time, delay))
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def rows_so_far(spark: SparkSession, path: str) -> DataFrame:
    """All rows with ``late`` and the ``batch`` they came in; a filter on either prunes folders."""
    return spark.read.parquet(f"{path}/rows").withColumn("late", F.col("late").cast("boolean"))


def on_time(spark: SparkSession, path: str) -> DataFrame:
    return rows_so_far(spark, path).where("NOT late").drop("late", "batch")


def late(spark: SparkSession, path: str) -> DataFrame:
    return rows_so_far(spark, path).where("late").drop("late", "batch")
