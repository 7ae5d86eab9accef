"""Ordering and coalescing of captures of any length: sequence rules as scans over chunks.

The window forms (``ordering.order_events``, ``reduce.coalesce_inputs``) hold a capture in one task.  Here rows are range-sorted
by capture and order, which deals a long capture to many tasks; each chunk does what it can by itself and leaves a row of
what the next one must know (a maximum, a count, the element last typed into).  Those rows, one for each capture and chunk,
are scanned in turn, and what they give is carried into the chunks.  Results are those of the window forms, however rows are
cut into chunks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepline.sources.shared import cut

KEYS = ["capture_id"]
#: monotonically_increasing_id() has the partition above these bits.
PLACE_BITS = 33


def _same(names: list[str], prefix: str = "_of_") -> Column:
    on = F.lit(True)
    for k in names:
        on = on & F.col(k).eqNullSafe(F.col(prefix + k))
    return on


def _aside(df: DataFrame, names: list[str], prefix: str = "_of_") -> DataFrame:
    for k in names:
        df = df.withColumnRenamed(k, prefix + k)
    return df


def _carried(rows: DataFrame, carry: DataFrame, by: list[str]) -> DataFrame:
    """``rows`` with the columns of ``carry``, which has a row for each capture and chunk."""
    joined = rows.join(_aside(carry, by), _same(by), "left")
    return joined.drop(*[f"_of_{k}" for k in by])


def chunks(rows: DataFrame, keys: list[str], order: list[Column], n_chunks: int | None = None) -> DataFrame:
    """``rows`` range-sorted by keys and order, with _chunk (a task's stretch of them) and _at (ascends with the order); written, so both stay as they are."""
    by = [F.col(k) for k in keys] + order
    ranged = rows.repartitionByRange(n_chunks, *by) if n_chunks else rows.repartitionByRange(*by)
    placed = ranged.sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id())
    return cut(placed.withColumn("_chunk", F.shiftright("_at", PLACE_BITS)))


def _numbered(chunked: DataFrame, keys: list[str], out: str) -> DataFrame:
    """Adds the place of each row in its capture, from 1: its place in the chunk and the rows of the chunks before."""
    spans = chunked.groupBy(*keys, "_chunk").agg(F.min("_at").alias("_chunk_first"), F.count("*").alias("_chunk_rows"))
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select(*keys, "_chunk", "_chunk_first", F.coalesce(F.sum("_chunk_rows").over(before), F.lit(0)).alias("_chunk_before"))
    placed = _carried(chunked, spans, [*keys, "_chunk"])
    return placed.withColumn(out, (F.col("_at") - F.col("_chunk_first") + F.col("_chunk_before") + 1).cast("int")).drop("_chunk_first", "_chunk_before")


def order_events(events: DataFrame, keys: list[str] = KEYS, stamp: str = "ingest_seq", t: str = "t", seq: str = "seq", pos: str = "pos", out: str = "ordinal", n_chunks: int | None = None) -> DataFrame:
    """As ``ordering.order_events``: adds ``out``, the place of each event in its capture, from 1."""
    stamped = F.col(stamp).isNotNull()
    own = chunks(events.filter(stamped), keys, [F.col(stamp), F.col(pos)], n_chunks)
    highest = own.groupBy(*keys, "_chunk").agg(F.max(t).alias("_highest"))
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    highest = highest.select(*keys, "_chunk", F.max("_highest").over(before).alias("_highest"))
    upto = Window.partitionBy(*keys, "_chunk").orderBy("_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    anchored = _carried(own.withColumn("_here", F.max(t).over(upto)), highest, [*keys, "_chunk"]).withColumn("_z", F.greatest("_here", "_highest"))
    both = anchored.select(*events.columns, "_z").unionByName(events.filter(~stamped).withColumn("_z", F.col(t)))
    order = [F.col("_z").asc_nulls_first(), (~stamped).asc(), F.col(stamp).asc_nulls_last(), F.col(seq).asc_nulls_first(), F.col(pos).asc()]
    return _numbered(chunks(both, keys, order, n_chunks), keys, out).drop("_z", "_at", "_chunk")


def _since_break(marks: DataFrame, keys: list[str], value: Column, total: bool) -> DataFrame:
    """Of chunks' tails (has_break, value of what follows the chunk's last break): what holds where each chunk begins.

    A chunk without a break adds to what was before; one with a break begins anew.
    """
    w = Window.partitionBy(*keys).orderBy("_chunk")
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    grouped = marks.withColumn("_g", F.sum(F.col("has_break").cast("int")).over(upto))
    within = Window.partitionBy(*keys, "_g").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    after = grouped.withColumn("_after", F.sum(value).over(within) if total else F.last(value, ignorenulls=True).over(within))
    return after.withColumn("_carry", F.lag("_after").over(w)).drop("_g", "_after")


def coalesce_inputs(events: DataFrame, keys: list[str] = KEYS, order: str = "ordinal", key: str = "elem_key", n_chunks: int | None = None) -> DataFrame:
    """As ``reduce.coalesce_inputs``: runs of typing become their last event, clicks that only focused go; adds ``ordinal_2``.  Typing and clicks have a ``key``."""
    c, by = F.col, [*keys, "_chunk"]
    is_run = F.coalesce(c("type").isin("input", "change"), F.lit(False))
    is_held = F.coalesce((c("type") == "click") & F.lower("tag").isin("input", "textarea"), F.lit(False))
    kind = F.when(is_run, 1).when(is_held, 2).otherwise(0)
    rows = chunks(events.withColumn("_kind", kind), keys, [c(order)], n_chunks)
    upto = Window.partitionBy(*by).orderBy("_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = rows.withColumn("_part", F.sum((c("_kind") == 0).cast("int")).over(upto))
    in_part = Window.partitionBy(*by, "_part").orderBy("_at")
    typed = F.when(c("_kind") == 1, c(key))
    local = local.withColumn("_last", F.last(typed, ignorenulls=True).over(in_part.rowsBetween(Window.unboundedPreceding, -1)))
    # where a chunk begins: breaks before it, and the element typed into since the last one
    tails = local.groupBy(*by).agg(F.max("_part").alias("n_breaks"), F.max_by(typed, F.when(typed.isNotNull(), F.struct("_part", "_at"))).alias("tail"), F.max(F.when(typed.isNotNull(), c("_part"))).alias("tail_part"))
    tails = tails.withColumn("has_break", c("n_breaks") > 0).withColumn("tail", F.when(c("tail_part") == c("n_breaks"), c("tail")))
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carry = _since_break(tails, keys, c("tail"), total=False).select(*by, F.coalesce(F.sum("n_breaks").over(before), F.lit(0)).alias("_segs"), c("_carry").alias("_key"))
    known = _carried(local, carry, by)
    last_key = F.coalesce("_last", F.when(c("_part") == 0, c("_key")))
    starts = F.coalesce((c("_kind") == 1) & (last_key.isNull() | (last_key != c(key))), F.lit(False))
    known = cut(known.withColumn("_start", starts).withColumn("_seg", c("_segs") + c("_part")).drop("_segs", "_key", "_last"))
    # how many runs have begun since the last break
    n_starts = known.groupBy(*by, "_part").agg(F.count_if("_start").alias("n"))
    of_chunk = n_starts.groupBy(*by).agg(F.max("_part").alias("n_breaks"), F.max_by("n", "_part").alias("tail"))
    carry = _since_break(of_chunk.withColumn("has_break", c("n_breaks") > 0), keys, c("tail"), total=True).select(*by, F.coalesce("_carry", F.lit(0)).alias("_begun"))
    here = F.sum(c("_start").cast("int")).over(in_part.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    indexed = _carried(known.withColumn("_here", here), carry, by).withColumn("_idx", c("_here") + F.when(c("_part") == 0, c("_begun")).otherwise(0)).drop("_here", "_begun", "_part")
    indexed = cut(indexed)
    # a run, or the clicks held on one element before a run, is known by these; counted in tasks first, whatever its size
    group = [*keys, "_seg", "_idx", "_kind", key]
    ends = indexed.filter("_kind > 0").groupBy(*group).agg(F.max(order).alias("_last"), F.min(order).alias("_first"))
    begun = indexed.filter("_start").select(*keys, "_seg", (c("_idx") - 1).alias("_idx"), c(key).alias("_next"))
    ends = _carried(ends, begun, [*keys, "_seg", "_idx"])
    ends = ends.filter((c("_kind") == 1) | c("_next").isNull() | (c("_next") != c(key)))
    ends = ends.select(*keys, c("_last").alias(order), F.when(c("_kind") == 2, c("_first")).otherwise(c("_last")).alias("_first"))
    kept = indexed.filter("_kind > 0").join(_aside(ends, [*keys, order]), _same([*keys, order])).drop(*[f"_of_{k}" for k in [*keys, order]])
    both = indexed.filter("_kind = 0").withColumn("_first", c(order)).unionByName(kept)
    place = [c("_seg"), F.when(c("_kind") == 0, -1).otherwise(c("_idx")), c("_kind"), c("_first")]
    numbered = _numbered(chunks(both.drop("_at", "_chunk"), keys, place, n_chunks), keys, "ordinal_2")
    return numbered.drop("_kind", "_start", "_seg", "_idx", "_first", "_at", "_chunk")
