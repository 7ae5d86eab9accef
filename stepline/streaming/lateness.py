"""Events that come too late for a stream, set apart and taken up afterwards.

A watermark drops what comes late; late is not wrong.  So batches are split first: what is behind the watermark goes to a
folder of its own, the rest to the stream's.  Both are written once for each batch, over what a repeat of it has left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def route(events: DataFrame, late_ms: int, out: str, checkpoint: str, ts: str = "ts"):
    """Starts a query that writes each batch of ``events`` to ``out``/on_time and ``out``/late, by batch.

    As in Spark, the watermark of a batch is the latest time of the batches before, less ``late_ms``.  The latest time is
    written with each batch, so a repeated batch is split as it was the first time.  Events without a time are on time.
    """

    def split(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        latest = spark.read.parquet(f"{out}/latest/batch={n - 1}").first()[0] if n else None
        own = batch.agg(F.max(F.unix_millis(ts))).first()[0]
        highest = max((x for x in (latest, own) if x is not None), default=None)
        spark.createDataFrame([(highest,)], "latest long").write.mode("overwrite").parquet(f"{out}/latest/batch={n}")
        behind = F.lit(False) if latest is None else F.coalesce(F.unix_millis(ts) < latest - late_ms, F.lit(False))
        batch.filter(~behind).write.mode("overwrite").parquet(f"{out}/on_time/batch={n}")
        batch.filter(behind).write.mode("overwrite").parquet(f"{out}/late/batch={n}")

    return events.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(split).start()


def routed(spark: SparkSession, out: str, side: str) -> DataFrame:
    """What has gone to a side (on_time or late) so far, with its batch."""
    return spark.read.parquet(f"{out}/{side}")


def reconcile(actions: DataFrame, late: DataFrame) -> DataFrame:
    """(capture_id, step, event_no, confidence): late effects that name a step of their capture, as ASSERTED, once each."""
    steps = actions.select("capture_id", F.col("step_id").alias("step")).distinct()
    named = late.filter("step_id is not null").select("capture_id", F.col("step_id").alias("step"), "event_no").distinct()
    return named.join(steps, ["capture_id", "step"]).withColumn("confidence", F.lit("ASSERTED"))
