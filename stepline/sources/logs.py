"""Event logs in CSV files, and how many of their rows could not be read."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from stepline.operators.records import log_events

#: Columns of a log, the first filled one counts; the share of rows lost from which on a warning tells of it.
TIMES, IDS, STATUSES, TYPES = ["TIMESTAMP", "EVENT_DATE"], ["REQUEST_ID", "TRANSACTION_ID"], ["SUCCESS", "STATUS"], ["EVENT_TYPE", "OPERATION"]
MOST_LOST = 0.3


def read_event_log(spark: SparkSession, path: str, event_type: str | None = None) -> tuple[DataFrame, Observation]:
    """Telemetry of the CSV log files below ``path``, which share a header, and the counts of rows read and skipped.

    Rows without a time that can be read are skipped.  They are counted by the scan that makes the events, so the counts are there once the
    first action on them has ended, say a write (one that reads them twice, as a sort does, counts twice).  ``event_type``: of the whole log, for rows that name none; it decides the layer where it is given.
    """
    raw = spark.read.option("header", True).option("escape", '"').csv(path)
    known = [c for names in (TIMES, IDS, STATUSES, TYPES) for c in names]
    rows = raw.withColumns({c: F.lit(None).cast("string") for c in known if c not in raw.columns})
    counts = Observation()
    whole = log_events(rows, TIMES, IDS, STATUSES, TYPES, event_type)
    whole = whole.withColumns({"status": F.coalesce("status", F.lit("unknown")), "event_name": F.coalesce("event_name", F.lit("UnknownEvent"))})
    seen = whole.observe(counts, F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("event_time").isNull()).alias("n_skipped"))
    return seen.filter("event_time is not null"), counts


def warnings(counts: Observation) -> list[str]:
    """What to say of the rows that were skipped."""
    found = counts.get
    n, skipped = found.get("n_rows", 0), found.get("n_skipped", 0)
    out = [f"Skipped {skipped} malformed rows"] if skipped else []
    if n and skipped / n > MOST_LOST:
        out.append(f"WARNING: {skipped}/{n} rows lost to parse errors (>30%)")
    return out
