"""Noise reduction on ordered event sequences.

All operators partition by capture and sort by one order column, so Spark plans one
exchange and one sort for a chain of them.  The phases run as coalesce_inputs,
drop_bubbling, drop_scroll, synth_navigate, drop_keydown.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS = ["capture_id"]
#: Elements that can be acted upon, and types that make a control of any element.
INTERACTIVE_TAGS = ("button", "a", "input", "select", "textarea")
INTERACTIVE_TYPES = ("button", "submit", "reset")
MODIFIERS = r"(?i)(ctrl|control|alt|meta|cmd|shift)\s*\+"


def _over(keys, order) -> Window:
    return Window.partitionBy(*keys).orderBy(*order)


def is_interactive(tag: Column, elem_type: Column, aria_label: Column | None = None) -> Column:
    found = F.lower(F.coalesce(tag, F.lit(""))).isin(*INTERACTIVE_TAGS) | F.coalesce(elem_type, F.lit("")).isin(*INTERACTIVE_TYPES)
    return found if aria_label is None else found | (F.coalesce(aria_label, F.lit("")) != "")


def coalesce_inputs(events: DataFrame, keys=KEYS, order: str = "ordinal", key: str = "elem_key") -> DataFrame:
    """Runs of input and change events on one element become their last event.

    A click on an input or textarea is held: if the next run is on that element it was the
    click that focused it and goes, else it stays, before that run; held clicks on one
    element before the same run are one, at the place of the first with the row of the last.
    Anything else breaks the sequence.  Adds ``ordinal_2``, the place in the new order.
    """
    w = _over(keys, [order])
    is_run = F.col("type").isin("input", "change")
    is_held = (F.col("type") == "click") & F.lower("tag").isin("input", "textarea")
    broken = events.withColumn("_run", is_run).withColumn("_held", is_held)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    broken = broken.withColumn("_break", ~F.col("_run") & ~F.col("_held")).withColumn("_seg", F.sum(F.col("_break").cast("int")).over(upto))
    in_seg = _over([*keys, "_seg"], [order])
    upto_seg = in_seg.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before_seg = in_seg.rowsBetween(Window.unboundedPreceding, -1)
    last_key = F.last(F.when(F.col("_run"), F.col(key)), ignorenulls=True).over(before_seg)
    # a break has its own segment number and comes first in it, so it never looks like a run
    starts = F.col("_run") & (last_key.isNull() | (last_key != F.col(key)))
    broken = broken.withColumn("_start", starts).withColumn("_idx", F.sum(F.col("_start").cast("int")).over(upto_seg))
    after = in_seg.rowsBetween(1, Window.unboundedFollowing)
    next_key = F.first(F.when(F.col("_start"), F.col(key)), ignorenulls=True).over(after)
    broken = broken.withColumn("_next", next_key)
    group = [*keys, "_seg", "_idx", "_kind", key]
    kind = F.when(F.col("_break"), 0).when(F.col("_run"), 1).otherwise(2)
    broken = broken.withColumn("_kind", kind)
    within = Window.partitionBy(*group)
    is_last = F.col(order) == F.max(order).over(within)
    first = F.when(F.col("_kind") == 2, F.min(order).over(within)).otherwise(F.col(order))
    kept = broken.withColumn("_last", is_last).withColumn("_first", first)
    kept = kept.filter((F.col("_kind") == 0) | (F.col("_last") & ((F.col("_kind") == 1) | F.col("_next").isNull() | (F.col("_next") != F.col(key)))))
    place = _over(keys, ["_seg", F.when(F.col("_kind") == 0, -1).otherwise(F.col("_idx")), "_kind", "_first"])
    return kept.withColumn("ordinal_2", F.row_number().over(place)).drop("_run", "_held", "_break", "_seg", "_start", "_idx", "_next", "_kind", "_last", "_first")


def drop_bubbling(events: DataFrame, keys=KEYS, order: str = "ordinal", t: str = "t", within_ms: int = 150, flag: str | None = None) -> DataFrame:
    """Drops a click on a plain element if the next event is a click on a control soon after: one click seen twice."""
    w = _over(keys, [order])
    control = is_interactive(F.col("tag"), F.col("elem_type"))
    echo = (F.col("type") == "click") & ~control & (F.lead("type").over(w) == "click") & F.lead(control).over(w) & ((F.lead(t).over(w) - F.col(t)).between(0, within_ms))
    return _drop(events, F.coalesce(echo, F.lit(False)), flag)


def drop_scroll(events: DataFrame, keys=KEYS, order: str = "ordinal", flag: str | None = None) -> DataFrame:
    """Keeps a scroll only if another kind of event follows; a capture of one event is left alone."""
    w = _over(keys, [order])
    following = F.lead("type").over(w)
    alone = F.count("*").over(Window.partitionBy(*keys)) < 2
    idle = (F.col("type") == "scroll") & (following.isNull() | (following == "scroll")) & ~alone
    return _drop(events, idle, flag)


def drop_keydown(events: DataFrame, flag: str | None = None) -> DataFrame:
    """Keeps key presses only if they are combinations with a modifier."""
    return _drop(events, (F.col("type") == "keydown") & ~F.coalesce(F.col("value").rlike(MODIFIERS), F.lit(False)), flag)


def _drop(events, condition, flag):
    marked = events.withColumn("_drop", condition)
    return marked.filter("not _drop").drop("_drop") if flag is None else marked.withColumnRenamed("_drop", flag)


def synth_navigate(events: DataFrame, keys=KEYS, order: str = "ordinal", t: str = "t", url: str = "url") -> DataFrame:
    """Puts a navigate event, one millisecond after the event before, in front of each event whose URL differs from that one's.  Adds ``synthetic``."""
    w = _over(keys, [order])
    before, before_t = F.lag(url).over(w), F.lag(t).over(w)
    moved = events.withColumn("_moved", F.coalesce((before != F.col(url)) & (F.coalesce(F.col(url), F.lit("")) != ""), F.lit(False))).withColumn("_at", before_t + 1)
    both = moved.withColumn("synthetic", F.explode(F.when(F.col("_moved"), F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(False)))))
    made = F.col("synthetic")
    kept = {*keys, order, url}
    changed = {c: F.when(made, F.lit(None)).otherwise(F.col(c)).alias(c) for c in events.columns if c not in kept}
    changed["type"] = F.when(made, F.lit("navigate")).otherwise(F.col("type")).alias("type")
    changed[t] = F.when(made, F.col("_at")).otherwise(F.col(t)).alias(t)
    return both.select(*[changed.get(c, F.col(c)) for c in events.columns], "synthetic")


def debounce(events: DataFrame, gap_ms: int = 250, keys=KEYS, order: str = "ordinal", t: str = "t", key: str = "elem_key") -> DataFrame:
    """Of input events on one element that follow each other within ``gap_ms``, the last; others pass."""
    w = _over([*keys, key, F.col("type") == "input"], [t, order])
    held = (F.col("type") == "input") & (F.lead(t).over(w) - F.col(t) <= gap_ms)
    return _drop(events, F.coalesce(held, F.lit(False)), None)


def reduce(events: DataFrame, keys=KEYS, within_ms: int = 150) -> DataFrame:
    """All phases in turn, on events with ``ordinal``; the result's order is (ordinal, synthetic first)."""
    out = coalesce_inputs(events, keys).drop("ordinal").withColumnRenamed("ordinal_2", "ordinal")
    out = drop_scroll(drop_bubbling(out, keys, within_ms=within_ms), keys)
    return drop_keydown(synth_navigate(out, keys))


def reduction_report(events: DataFrame, keys=KEYS, within_ms: int = 150) -> DataFrame:
    """One row a capture: events before and after, and how many each phase dropped or made."""
    counted = events.withColumn("_n_raw", F.count("*").over(Window.partitionBy(*keys)))
    merged = coalesce_inputs(counted, keys).drop("ordinal").withColumnRenamed("ordinal_2", "ordinal")
    # one chain for all counts: what a phase drops stays with a mark, and the next ones look at rows of equal marks only
    bubbled = drop_bubbling(merged, keys, within_ms=within_ms, flag="_bubbled")
    scrolled = drop_scroll(bubbled, [*keys, "_bubbled"], flag="_scrolled")
    moved = drop_keydown(synth_navigate(scrolled, [*keys, "_bubbled", "_scrolled"]), flag="_pressed")
    made, kept = F.col("synthetic"), ~F.col("_bubbled") & ~F.col("_scrolled")
    counts = {
        "n_merged": ~made,
        "n_bubbled": ~made & ~F.col("_bubbled"),
        "n_scrolled": ~made & kept,
        "n_navigate": made & kept,
        "n_moved": kept,
        "n_out": kept & ~F.col("_pressed"),
    }
    found = moved.groupBy(*keys).agg(F.max("_n_raw").alias("n_raw"), *[F.count_if(c).alias(name) for name, c in counts.items()])
    n = F.col
    return found.select(
        *keys,
        "n_raw",
        n("n_out").alias("n_out"),
        (F.col("n_raw") - n("n_merged")).alias("n_coalesced"),
        (n("n_merged") - n("n_bubbled")).alias("n_bubbling"),
        (n("n_bubbled") - n("n_scrolled")).alias("n_scroll"),
        (n("n_moved") - n("n_out")).alias("n_keydown"),
        n("n_navigate").alias("n_navigate"),
    )
