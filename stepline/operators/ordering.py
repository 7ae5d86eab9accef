"""Trusted order of a capture's events.

Events that the recorder stamped come in the order of their stamps.  Their clock may step
back, so its running maximum serves as an anchor, and an event without a stamp goes after all
stamped events whose anchor is not later than its own time.  Where no event is stamped, time
and then the page's own sequence decide.

As anchors never decrease, (anchor or time, stamped first, rank) sorts to that very order:
no search and no join, two windows over one exchange on the capture.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def order_events(events: DataFrame, keys: list[str] = ["capture_id"], stamp: str = "ingest_seq", t: str = "t", seq: str = "seq", pos: str = "pos", out: str = "ordinal") -> DataFrame:
    """Adds ``out``: the place of each event in its capture, from 1.  Null times go first."""
    stamped = F.col(stamp).isNotNull()
    upto_here = Window.partitionBy(*keys).orderBy(F.col(stamp).asc_nulls_last(), F.col(pos)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    anchored = events.withColumn("_z", F.when(stamped, F.max(F.when(stamped, F.col(t))).over(upto_here)).otherwise(F.col(t)))
    in_order = Window.partitionBy(*keys).orderBy(
        F.col("_z").asc_nulls_first(),
        (~stamped).asc(),
        F.col(stamp).asc_nulls_last(),
        F.col(seq).asc_nulls_first(),
        F.col(pos),
    )
    return anchored.withColumn(out, F.row_number().over(in_order)).drop("_z")


def step_order(actions: DataFrame, keys: list[str] = ["capture_id"], sequence: str = "sequence") -> DataFrame:
    """Actions sorted for the steps that walk through them."""
    return actions.orderBy(*keys, sequence)


def running_max_clock(events: DataFrame, keys: list[str] = ["capture_id"], order: str = "pos", t: str = "t", out: str = "clock") -> DataFrame:
    """Adds a clock that never steps back."""
    return events.withColumn(out, F.max(t).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)))
