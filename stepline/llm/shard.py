"""Sharding by global prefix sums of byte sizes.

Rows are range-sorted by the given columns; each partition's running sum of sizes plus
the totals of the partitions before it gives each row's place in the whole.  Cuts at
equal targets of bytes make contiguous shards: a row goes to the shard in which the middle
of its bytes lies.  So a shard differs from its target by at most half a row at either end.

The range-sorted rows are written once to the shared folder, since partition totals and
rows must come from the same cut into ranges, whatever is recomputed.  The totals are one
row for each partition.

Cases: a null text has no bytes and still takes up ``OVERHEAD``; ties in the order are
broken by the row's place in the input, so a value that many rows share is still dealt to
several tasks; repeated rows each get a slot; an empty table gives an empty table, and
with fewer rows than shards some shards stay empty; columns of the input come through, those
named size, shard or slot as in_size, in_shard and in_slot.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stepline.llm.common import cut

#: Bytes that each row takes up besides its text.
OVERHEAD = 8


def text_bytes(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + OVERHEAD).cast("long")


def _running(batches):
    """Adds to each row (its size in the first column) the bytes and the rows before it in its partition."""
    size = rows = 0
    for batch in batches:
        sizes = np.asarray(batch.column(0)).astype(np.int64)
        ends = np.cumsum(sizes) + size
        columns = [*batch.columns, pa.array(ends - sizes), pa.array(np.arange(rows, rows + len(sizes)))]
        size, rows = int(ends[-1]) if len(ends) else size, rows + len(sizes)
        yield pa.record_batch(columns, names=[*batch.schema.names, "inside", "row"])


def unclashing(names: list[str], taken: tuple) -> list[str]:
    """The names, those that are ``taken`` with as many ``in_`` before them as it takes."""
    out = []
    for name in names:
        x = name
        while x in taken or (x != name and (x in names or x in out)):
            x = f"in_{x}"
        out.append(x)
    return out


def assign_shards(rows: DataFrame, size: Column, order: list, n_shards: int) -> DataFrame:
    """The rows with size, shard (0 to n_shards - 1) and slot (place within the shard, from 0).

    Columns of ``rows`` that have one of these three names get ``in_`` before theirs; all else
    is worked on beside the rows, so no other name can clash.
    """
    by = [f"o{k}" for k in range(len(order))]
    keys = [(F.col(x) if isinstance(x, str) else x).alias(k) for k, x in zip(by, order)]
    packed = rows.select(size.alias("size"), F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("it"), *keys, F.monotonically_increasing_id().alias("tie"))
    ranged = packed.repartitionByRange(*by, "tie").sortWithinPartitions(*by, "tie").select("size", "it", F.spark_partition_id().alias("part"))
    ranged = cut(ranged.mapInArrow(_running, T.StructType([*ranged.schema.fields, T.StructField("inside", T.LongType()), T.StructField("row", T.LongType())])))
    totals = ranged.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("part", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("start"), F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("first"), F.sum("bytes").over(Window.partitionBy()).alias("all"))
    # a row for each partition of the rows: bounded by the number of tasks, whatever they hold
    placed = ranged.join(F.broadcast(totals), "part").withColumn("start", F.col("start") + F.col("inside")).withColumn("place", F.col("first") + F.col("row"))
    # the middle of the row, in half bytes, so that all is in whole numbers
    placed = placed.withColumn("shard", F.least(F.expr(f"(2 * start + size) * {n_shards} div (2 * all)").cast("int"), F.lit(n_shards - 1)))
    # a row for each shard
    first = placed.groupBy("shard").agg(F.min("place").alias("shard_first"))
    slot = (F.col("place") - F.col("shard_first")).alias("slot")
    names = unclashing(rows.columns, ("size", "shard", "slot"))
    return placed.join(F.broadcast(first), "shard").select(*[F.col(f"it.`{c}`").alias(n) for c, n in zip(rows.columns, names)], "size", "shard", slot)
