"""The same ingest as a stream: exactly-once files, bounded lateness, versions by micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..contracts import RAW_EVENTS
from ..functions.scoring import millis_date
from ..operators.ingest import KEY, normalise


def raw_stream(spark: SparkSession, path: str, files_a_batch: int | None = None) -> DataFrame:
    """New Parquet files of raw events."""
    reader = spark.readStream.schema(RAW_EVENTS)
    if files_a_batch:
        reader = reader.option("maxFilesPerTrigger", files_a_batch)
    return reader.parquet(path)


def clean_stream(raw: DataFrame, lateness: str = "7 days") -> DataFrame:
    """Valid events once each: repeats are dropped across batches while the later copy arrives within the
    lateness, after which the state of a key goes. Rows later than that are dropped."""
    events = normalise(raw).withColumn("event_time", F.timestamp_millis("timestamp"))
    return events.withWatermark("event_time", lateness).dropDuplicatesWithinWatermark(KEY).withColumn("event_date", millis_date(F.col("timestamp")))


def sessions(events: DataFrame, gap: str = "30 minutes", lateness: str = "1 day") -> DataFrame:
    """Session windows of each user: start, end, events. A gap of exactly `gap` stays in one session."""
    timed = events if "event_time" in events.columns else events.withColumn("event_time", F.timestamp_millis("timestamp"))
    window = F.session_window("event_time", gap)
    return timed.withWatermark("event_time", lateness).groupBy("user_id", window.alias("w")).agg(F.count("*").alias("events")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")


def write_bronze_stream(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Process what is there and stop; run again for what came since."""
    return events.drop("event_time").writeStream.format("parquet").partitionBy("event_date").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)


def publish_versions(events: DataFrame, checkpoint: str, publish: Callable[[DataFrame, str], None]) -> StreamingQuery:
    """Call publish(batch, version) for each micro-batch, once per batch id: a version that exists already is
    the same batch again, and publish must leave it."""

    def each(batch: DataFrame, batch_id: int) -> None:
        if not batch.isEmpty():
            publish(batch, f"batch-{batch_id:08d}")

    return events.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
