"""Helpers shared by the training-data operators."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepline.sources.shared import cut, fresh_path, shared_dir  # noqa: F401

#: A word: code points that are none of space and U+0009 to U+000D.  ``bytes.split()``
#: without arguments cuts UTF-8 at exactly these bytes, so Python tasks use that.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_bytes(column) -> list:
    """The UTF-8 bytes of an Arrow string column; null becomes empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def as_text(column) -> list:
    """The strings of an Arrow column; null becomes empty."""
    return [x or "" for x in column.to_pylist()]


def word_count(column):
    """Number of words of a string column (null: 0), natively."""
    return F.coalesce(F.regexp_count(column, F.lit(WORD)), F.lit(0)).cast("long")
