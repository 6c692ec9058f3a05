"""Message rows taken in as a stream, with a watermark table that makes replays harmless."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lorewell.operators.transcripts import normal_role


def message_stream(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """New Parquet files of a folder as a stream with a known schema."""
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", 1).parquet(path)


def first_deliveries(stream: DataFrame, late: str = "2 days") -> DataFrame:
    """Drops repeated deliveries that arrive within ``late`` of the newest message."""
    return stream.withWatermark("ingested_at", late).dropDuplicatesWithinWatermark(["session_id", "seq"])


def activity(stream: DataFrame, width: str = "1 hour", late: str = "2 days") -> DataFrame:
    """(window, role, n): messages per hour and role, closed once the watermark has passed."""
    rows = stream.withWatermark("ingested_at", late)
    return rows.groupBy(F.window("ingested_at", width), normal_role(F.col("role")).alias("role")).agg(F.count("*").alias("n"))


def run(stream: DataFrame, on_batch: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Takes what is available in micro-batches. A batch that failed is given again under its number, so ``on_batch`` should write by number."""
    return stream.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
