"""Integrity checks of captures as they grow: each finding once, whatever batches bring and however often one is repeated."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepline.operators import integrity


def stream_validate(lines: DataFrame, out: str, checkpoint: str, signals: list[str], fields: list[str], domain: str, order: str = "line"):
    """Starts a query that checks each batch of ``lines`` (see ``integrity.summaries``) and writes its findings and its captures' summaries below ``out``.

    A batch has folders of its own, written over if it is repeated; so a restart adds nothing twice.  A batch costs
    what it brings; of captures that it does not touch nothing is read or written.  Lines of a capture must come in their order.
    """

    def check(batch: DataFrame, n: int) -> None:
        batch = batch.cache()
        found = integrity.event_findings(batch.filter("not rejected"), signals, fields, domain)
        found.write.mode("overwrite").parquet(f"{out}/findings/part={n}")
        integrity.summaries(batch, F.lit(n).cast("long"), domain, order=order).drop("part").write.mode("overwrite").parquet(f"{out}/summaries/part={n}")
        batch.unpersist()

    return lines.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(check).start()


def validated(spark: SparkSession, out: str, manifests: DataFrame, captures: DataFrame, most_loss: float = 0.5) -> DataFrame:
    """All findings of what has been checked so far."""
    whole = integrity.merged(spark.read.parquet(f"{out}/summaries"))
    found = spark.read.parquet(f"{out}/findings").drop("part")
    return integrity.settled(found, whole).unionByName(integrity.capture_findings(whole, manifests, captures, most_loss=most_loss))
