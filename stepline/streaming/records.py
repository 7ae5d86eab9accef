"""Differences between a record's states as they come in, out of order.

``stream_record_diff`` takes each batch's records together, without Python; ``live_record_diff`` keeps and calls each record by itself
and needs the RocksDB state store (``with_rocksdb``).
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE = "us long, tie long, names array<string>, texts array<string>"
OUT = "capture_id long, record_id string, us long, tie long, changed string"


@contextmanager
def with_rocksdb(spark: SparkSession):
    """Streams started within keep their state in RocksDB."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


def changes(states: list[tuple], last: tuple | None, keep_us: int) -> tuple[list[tuple], tuple | None]:
    """(us, tie, changed) of each of the sorted states (us, tie, names, texts) that is not empty, and the last of them."""
    out = []
    for us, tie, names, texts in states:
        if not len(names):
            continue
        known = dict(zip(last[2], last[3])) if last is not None and us - last[0] <= keep_us else {}
        changed = sorted(k for k, v in zip(names, texts) if k not in known or known[k] != v)
        out.append((us, tie, ",".join(changed)))
        last = (us, tie, list(names), list(texts))
    return out, last


class RecordDiff(StatefulProcessor):
    """Holds a record's states until the watermark has passed them, then tells their differences in order of time and tie.

    A record's last state is forgotten ``keep_us`` after its time.
    """

    def __init__(self, keep_us: int):
        self.keep_us = keep_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", STATE)
        self.waiting = handle.getListState("waiting", STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        came = [(int(us), int(tie), list(names), list(texts)) for frame in rows for us, tie, names, texts in zip(frame["us"], frame["tie"], frame["names"], frame["texts"])]
        if came:
            self.waiting.appendList(came)
            self._wake(came)
        return iter(())

    def _wake(self, states) -> None:
        """A timer for the first of the states; when it expires, those that are not due get the next."""
        self.handle.registerTimer(-(-min(x[0] for x in states) // 1000))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # all that the watermark has passed is told at once
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()) * 1000
        held = [tuple(x) for x in self.waiting.get()] if self.waiting.exists() else []
        due = sorted(x for x in held if x[0] <= now)
        last = tuple(self.last.get()) if self.last.exists() else None
        if due:
            found, last = changes(due, last, self.keep_us)
            left = [x for x in held if x[0] > now]
            if left:
                self.waiting.put(left)
                self._wake(left)
            else:
                self.waiting.clear()
            if last is not None:
                self.last.update(last)
                self.handle.registerTimer(-(-(last[0] + self.keep_us + 1) // 1000))
            if found:
                us, tie, changed = zip(*found)
                yield pd.DataFrame({"capture_id": [key[0]] * len(us), "record_id": pd.Series([key[1]] * len(us), dtype=object), "us": us, "tie": tie, "changed": pd.Series(changed, dtype=object)})
        elif last is not None and now > last[0] + self.keep_us:
            self.last.clear()

    def close(self) -> None:
        pass


def _states(events: DataFrame, *more: str) -> DataFrame:
    """States with a time, capture and record; names and texts are empty where the state is."""
    state = F.coalesce("state", F.create_map().cast("map<string,string>"))
    whole = events.filter("ts is not null and capture_id is not null and record_id is not null")
    return whole.select("capture_id", "record_id", *more, F.unix_micros("ts").alias("us"), F.coalesce("ingest_seq", F.lit(0)).cast("long").alias("tie"), F.map_keys(state).alias("names"), F.map_values(state).alias("texts"))


def live_record_diff(events: DataFrame, late: str = "10 minutes", keep_days: float = 365) -> DataFrame:
    """What ``stream_record_diff`` writes, as a streaming DataFrame whose state is Spark's.

    A batch costs some milliseconds for each record that it touches or tells, and nothing for the others.
    """
    flat = _states(events, "ts").withWatermark("ts", late)
    told = flat.groupBy("capture_id", "record_id").transformWithStateInPandas(RecordDiff(int(keep_days * 86_400_000_000)), OUT, "Append", "EventTime")
    return told.select("capture_id", "record_id", F.timestamp_micros("us").alias("ts"), F.col("tie").alias("ingest_seq"), "changed")


def stream_record_diff(events: DataFrame, late_ms: int, keep_days: float, out: str, checkpoint: str):
    """Starts a query that writes (capture_id, record_id, ts, ingest_seq, changed), by batch: for each state of a record that is not
    empty, the fields that differ from the last such state.

    ``events``: capture_id, record_id, ts, ingest_seq (decides between equal times) and state (map); a streaming DataFrame.  States come
    out once the watermark (the latest time so far, less ``late_ms``) has passed them, whatever the order they came in; what comes behind it is
    dropped (see ``lateness``).  A state more than ``keep_days`` after the last counts as a first one.  States without a time, capture or record are left out.

    A batch is one sort by record of what it brings, the states that wait and the last one of each record.  These are written anew
    with each batch, over those of two batches before; so a repeated batch starts from the same states and writes the same.
    """
    keep, late = int(keep_days * 86_400_000_000), int(late_ms) * 1000
    record = Window.partitionBy("capture_id", "record_id").orderBy("us", "tie", "names", "texts")

    def tell(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        came = _states(batch)
        before, after = (f"{out}/kept/{k % 2}" for k in (n - 1, n))
        passed = spark.read.parquet(f"{before}/latest").first()[0] if n else None
        latest = max((x for x in (passed, came.agg(F.max("us")).first()[0]) if x is not None), default=None)
        spark.range(1).select(F.lit(latest).cast("long").alias("latest")).write.mode("overwrite").parquet(f"{after}/latest")
        held = came.filter(F.size("names") > 0).withColumn("told", F.lit(False))
        if passed is not None:
            held = held.filter(F.col("us") > passed - late)
        if n:
            held = held.unionByName(spark.read.schema(held.schema).parquet(f"{before}/states"))
        due = F.lit(False) if latest is None else F.col("us") <= latest - late
        placed = held.withColumns({"due": due, "_last": F.lag(F.struct("us", "names", "texts")).over(record), "_more": F.lead(due).over(record)})

        known = F.when(F.col("us") - F.col("_last.us") <= keep, F.map_from_arrays("_last.names", "_last.texts"))
        same = lambda k, i: F.coalesce(F.map_contains_key("_known", k) & F.col("_known")[k].eqNullSafe(F.col("texts")[i]), F.lit(False))
        changed = F.array_join(F.array_sort(F.filter("names", lambda k, i: ~same(k, i))), ",")
        last = F.col("due") & ~F.coalesce("_more", F.lit(False)) & (F.lit(False) if latest is None else F.col("us") + keep >= latest - late)
        new = F.col("due") & ~F.col("told")
        placed = placed.withColumn("_known", known).select(*held.columns, "due", new.alias("new"), F.when(new, changed).alias("changed"), (~F.col("due") | last).alias("kept")).persist()

        told = placed.filter("new").select("capture_id", "record_id", F.timestamp_micros("us").alias("ts"), F.col("tie").alias("ingest_seq"), "changed")
        told.write.mode("overwrite").parquet(f"{out}/told/batch={n}")
        placed.filter("kept").select(*held.drop("told").columns, F.col("due").alias("told")).write.mode("overwrite").parquet(f"{after}/states")
        placed.unpersist()

    return events.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(tell).start()


def differences(spark: SparkSession, out: str) -> DataFrame:
    """What ``stream_record_diff`` has told so far, with its batch."""
    return spark.read.parquet(f"{out}/told")
