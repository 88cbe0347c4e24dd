"""Streams of raw documents into the index, and metrics of event streams (extensions beyond parity)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quarry import schemas
from quarry.plans import ingest
from quarry.plans.store import IndexStore


def raw_documents(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """New Parquet files of raw documents in a folder."""
    return spark.readStream.schema(schemas.RAW_DOCUMENTS).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def once(stream: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Each (source, item, revision) once within the delay."""
    return stream.withWatermark("fetched_at", delay).dropDuplicatesWithinWatermark(["source_id", "item_id", "source_revision"])


def index_stream(stream: DataFrame, store: IndexStore, descriptor: dict, checkpoint: str, gate=ingest.default_gate) -> StreamingQuery:
    """Each micro-batch is one candidate run, activated if the gate lets it pass. A batch that is repeated finds its documents unchanged."""

    def stage(batch: DataFrame, _: int) -> None:
        if batch.isEmpty():
            return
        run = ingest.run(batch.sparkSession, store, descriptor, batch)
        ingest.activate(store, run, gate)

    return stream.writeStream.foreachBatch(stage).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _timed(events: DataFrame) -> DataFrame:
    """A stream's event time has to be an instant."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")) if events.isStreaming else events


def windowed(events: DataFrame, width: str = "1 hour", delay: str = "10 minutes", kind: str = "event_type") -> DataFrame:
    """Counts and mean value by tumbling window and kind; late events within the delay still count."""
    return _timed(events).withWatermark("ts", delay).groupBy(F.window("ts", width), kind).agg(F.count("*").alias("n"), F.avg("value").alias("mean_value")).select(F.col("window.start").alias("window_start"), kind, "n", "mean_value")


def sessions(events: DataFrame, gap: str = "30 minutes", delay: str = "10 minutes", key: str = "user_id") -> DataFrame:
    """Sessions of a key: begin, end, events."""
    return _timed(events).withWatermark("ts", delay).groupBy(F.session_window("ts", gap), key).agg(F.count("*").alias("n")).select(key, F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "n")
