"""Sinks: specifications and bundles by capture, and rounds that are never overwritten."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepline.functions.redaction import redact_session_ids


def write_spec(specs: DataFrame, path: str) -> None:
    specs.write.mode("overwrite").json(path)


def write_bundle(actions: DataFrame, path: str, by: str = "capture_date") -> None:
    """Actions as Parquet, in a folder by date: there are too many captures for a folder each."""
    actions.write.mode("overwrite").partitionBy(by).parquet(path)


def write_round(rows: DataFrame, path: str, round_number: int, json_columns: list[str] = ()) -> None:
    """Appends one round to the audit trail; an existing round is refused before any work, and session ids go."""
    target = f"{path.rstrip('/')}/round_number={round_number}"
    jvm = rows.sparkSession._jvm
    where = jvm.org.apache.hadoop.fs.Path(target)
    if where.getFileSystem(rows.sparkSession._jsc.hadoopConfiguration()).exists(where):
        raise FileExistsError(f"round {round_number} is there already: {target}")
    clean = rows.withColumns({c: redact_session_ids(F.col(c)) for c in json_columns})
    clean.write.mode("errorifexists").parquet(target)
