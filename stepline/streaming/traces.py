"""The trace operators' live forms, for Structured Streaming.

Each takes a streaming DataFrame (or a static one) and returns one.  Watermarks bound the
state; what comes later than that goes to a batch job, see ``lateness``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT_SCHEMA = "capture_id long, ingest_seq long, ts timestamp, type string, elem_key string, value string, record_id string, state map<string,string>"


def stream_captures(spark: SparkSession, path: str, schema: str = EVENT_SCHEMA, files_per_batch: int = 1000) -> DataFrame:
    """Appended JSON lines below ``path``, one row an event."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(path)


def stream_live_counts(events: DataFrame, length: str = "10 minutes", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Events, network events and errors by capture and window, tumbling or sliding."""
    span = F.window("ts", length, slide) if slide else F.window("ts", length)
    counted = events.withWatermark("ts", late).groupBy("capture_id", span.alias("w"))
    return counted.agg(F.count("*").alias("n_events"), F.count_if(F.col("type") == "network").alias("n_network"), F.count_if(F.col("type") == "error").alias("n_errors")).select("capture_id", F.col("w.start").alias("window_start"), "n_events", "n_network", "n_errors")


def stream_debounce(events: DataFrame, gap: str = "250 milliseconds", late: str = "10 seconds") -> DataFrame:
    """The last value of each burst of input events on an element."""
    held = events.filter("type = 'input'").withWatermark("ts", late)
    burst = held.groupBy("capture_id", "elem_key", F.session_window("ts", gap).alias("w"))
    return burst.agg(F.max_by("value", F.struct("ts", "ingest_seq")).alias("value"), F.max("ts").alias("ts"), F.count("*").alias("n_events")).select("capture_id", "elem_key", "ts", "value", "n_events")


def stream_correlate(actions: DataFrame, effects: DataFrame, window: str = "5 seconds", late: str = "10 seconds", outer: bool = False) -> DataFrame:
    """Effects of a capture from an action's time on, up to a window later; with ``outer``, also actions without any."""
    a = actions.withWatermark("ts", late).select("capture_id", F.col("step_id").alias("step"), F.col("ts").alias("step_ts"))
    e = effects.withWatermark("ts", late).select(F.col("capture_id").alias("effect_capture"), F.col("ts").alias("effect_ts"), "layer", F.col("step_id").alias("names_step"))
    on = F.expr(f"capture_id = effect_capture AND effect_ts >= step_ts AND effect_ts <= step_ts + INTERVAL {window}")
    joined = a.join(e, on, "left_outer" if outer else "inner")
    return joined.withColumn("confidence", F.when(F.col("names_step") == F.col("step"), "HIGH").when(F.col("effect_ts").isNotNull(), "TEMPORAL")).drop("effect_capture")


def stream_dedupe(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """One event for each stamp of a capture."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["capture_id", "ingest_seq"])
