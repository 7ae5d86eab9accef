"""Mixing sources to target weights, along a time-varying curriculum.  DataFrame functions only.

1.  Each source gets a target: its weight's share of all words times ``share``, at most
    ``most`` times its own size; what is cut off is shared again by weight.  (Water
    filling: with sources in order of cap over weight, a prefix is at its cap and the
    rest gets weight times one level.)
2.  A source's weight changes over training time t in [0, 1].  Its schedule is a list of
    knots, linear in between, scaled so that its integral over [0, 1] is the target: then
    the integral up to t is the words due by t.
3.  A source's documents queue up in the order of a hash, and the queue starts again when it is
    through.  A document takes up a stretch of its source's words in each round; its
    position is the time when the cumulative demand reaches the middle of that stretch.
    Inverting the demand means finding the segment between two knots and solving a quadratic equation.
4.  A document is taken once for each of its positions.  What is not due by the end of
    training has none; nor has a document without words.

How it runs.  Words are counted once; ids and sizes are written, and only they are shuffled.
Queue places are prefix sums in two steps, over hash buckets within each source and then
within each bucket, so a source with a third of all rows is dealt to as many tasks as others; the
join back is by source and bucket, too.  The bucket is a hash of id and text, so rows without an id
or with the same one are dealt like others.

Cases: a null text has size 0; documents of size 0 are taken 0 words, in no copies; null
is a source of its own, the last; rows that are the same in id and text queue up one after the other, which of
them comes first makes no difference to the rows returned; a source of size 0 has target
0; an empty table gives an empty table; other columns are left alone.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepline.llm.common import cut, word_count

#: Weights of sources in their order, repeating.
WEIGHTS = (5, 2, 1)
#: Hash buckets of a source.
BUCKETS = 1024
#: Relative weight at training times, by the source's weight: what weighs most comes early and what weighs least late.
SCHEDULES = {5: ((0.0, 1.5), (0.5, 1.0), (1.0, 0.5)), 2: ((0.0, 1.0), (1.0, 1.0)), 1: ((0.0, 0.5), (0.5, 1.0), (1.0, 1.5))}


def order_hash(doc_id: Column, text: Column) -> Column:
    """First 32 bits of an MD5 of the id and the text: the same in any engine."""
    as_bytes = lambda c: F.coalesce(c.cast("string"), F.lit("")).cast("binary")
    both = F.concat_ws(":", doc_id.cast("string"), F.md5(as_bytes(text)))
    return F.conv(F.substring(F.md5(as_bytes(both)), 1, 8), 16, 10).cast("long")


def targets(sources: DataFrame, weights=WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Adds weight and target to (key, source_size), one row a source; sources count in the order of their keys."""
    place = Window.orderBy(F.col("key"))
    n = F.row_number().over(place) - 1
    weighed = sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (n % len(weights) + 1).cast("int")))
    by_ratio = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("key"))
    below = by_ratio.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    everything = Window.partitionBy()
    level = (F.col("due") - F.col("capped")) / F.col("weight_above")
    return (
        weighed.withColumn("due", F.sum("source_size").over(everything) * share)
        .withColumn("capped", F.sum("source_size").over(below) * most - F.col("source_size") * most)
        .withColumn("weight_above", F.sum("weight").over(everything) - F.sum("weight").over(below) + F.col("weight"))
        # the level if all sources before this one are at their cap: right for the first source that stays below its own
        .withColumn("fits", level * F.col("weight") <= F.col("source_size") * most)
        .withColumn("level", F.min(F.when(F.col("fits"), F.struct(F.col("source_size") / F.col("weight"), level.alias("level")))).over(everything)["level"])
        .withColumn("target", F.least(F.col("source_size") * most, F.coalesce(F.col("level") * F.col("weight"), F.col("source_size") * most)))
        .select("key", "source_size", "weight", "target")
    )


def _segments(knots) -> list[tuple[float, float, float, float, float]]:
    """(share before, share, from, to, slope ...) of each linear piece, the whole integral being 1."""
    area = [(t2 - t1) * (w1 + w2) / 2 for (t1, w1), (t2, w2) in zip(knots, knots[1:])]
    whole, before, out = sum(area), 0.0, []
    for a, (t1, w1), (t2, w2) in zip(area, knots, knots[1:]):
        out.append((before, t1, t2, w1 / whole, w2 / whole))
        before += a / whole
    return out


def when_due(demand: Column, knots) -> Column:
    """The time at which the share ``demand`` of a source's words is due, its schedule's integral inverted; null beyond 1."""
    out = None
    for before, t1, t2, w1, w2 in reversed(_segments(knots)):
        rest = F.greatest(demand - before, F.lit(0.0))
        slope = (w2 - w1) / (t2 - t1)
        # w1 * x + slope / 2 * x^2 = rest, in the form that has no cancellation
        root = F.sqrt(F.greatest(F.lit(w1 * w1) + rest * (2 * slope), F.lit(0.0)))
        x = F.when(root + w1 > 0, rest * 2 / (root + w1)).otherwise(0.0)
        time = F.least(F.lit(t1) + x, F.lit(t2))
        out = time if out is None else F.when(demand < last, time).otherwise(out)
        last = before
    return F.when(demand <= 1, out)


def position(place: Column, schedules=SCHEDULES) -> Column:
    """Training time of the queue place ``place``, by the columns weight and target; null if it is not due at all."""
    demand, out = F.when(F.col("target") > 0, place / F.col("target")), F.lit(None).cast("double")
    for weight, knots in schedules.items():
        out = F.when(F.col("weight") == weight, when_due(demand, knots)).otherwise(out)
    # a weight without a schedule stays as it is all the time
    return F.when(F.col("weight").isin(*schedules), out).otherwise(F.when(demand <= 1, demand))


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights=WEIGHTS, schedules=SCHEDULES, share: float = 1.5, most: float = 2.0, buckets: int = BUCKETS, keep: list[str] = ()) -> DataFrame:
    """One row a document: doc_id, source, size, source_size, weight, target, positions (training
    times of its copies, in order), copies, taken, first_position.

    ``keep``: columns to carry along, as ``keep_`` and their name.
    """
    at = order_hash(F.col(id_col), F.col(text_col))
    # sorts like the source by code point, null last, and is never null: one exchange by (key, bucket) serves the join and the window
    key = F.coalesce(F.concat(F.lit("+"), F.col(source_col)), F.lit("-"))
    sized = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), key.alias("key"), word_count(F.col(text_col)).alias("size"), at.alias("at"), (at % buckets).alias("bucket"), *[F.col(c).alias(f"keep_{c}") for c in keep])
    if not keep:
        # ids and sizes only; kept texts are read twice rather than written
        sized = cut(sized)
    by_bucket = sized.groupBy("key", "bucket").agg(F.sum("size").alias("bucket_size"))
    aims = targets(by_bucket.groupBy("key").agg(F.sum("bucket_size").alias("source_size")), weights, share, most)
    earlier = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = by_bucket.select("key", "bucket", F.coalesce(F.sum("bucket_size").over(earlier), F.lit(0)).alias("bucket_start")).join(aims, "key")
    joined = sized.join(starts, ["key", "bucket"])
    before = Window.partitionBy("key", "bucket").orderBy("at", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = joined.withColumn("middle", F.col("bucket_start") + F.coalesce(F.sum("size").over(before), F.lit(0)) + F.col("size") / 2)
    rounds = F.array(*[position(F.col("middle") + n * F.col("source_size"), schedules) for n in range(math.ceil(most))])
    placed = placed.withColumn("positions", F.when(F.col("size") > 0, F.filter(rounds, lambda x: x.isNotNull())).otherwise(F.array().cast("array<double>")))
    copies = F.size("positions").cast("long")
    return placed.select(
        "doc_id",
        "source",
        "size",
        "source_size",
        "weight",
        "target",
        "positions",
        copies.alias("copies"),
        (copies * F.col("size")).alias("taken"),
        F.get("positions", F.lit(0)).alias("first_position"),
        *[F.col(f"keep_{c}") for c in keep],
    )


def by_position(mixed: DataFrame) -> DataFrame:
    """The documents of :func:`mix`, range-sorted by the position of their first copy; those that are not taken come last."""
    return mixed.orderBy(F.col("first_position").asc_nulls_last(), "doc_id")


def training_order(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """The kept ``columns`` of :func:`mix`, each row as often as it is taken, range-sorted by training position."""
    copies = mixed.select("*", F.posexplode("positions").alias("copy", "position"))
    return copies.orderBy("position", "doc_id", "copy").select(*[F.col(f"keep_{c}").alias(c) for c in columns])
