"""Sources of one's own: any DataFrame that keeps a contract takes the place of a reader.

A contract is a schema: columns that must be there, with their types; a whole number may be narrower than asked, other columns may
be beside them, and a struct must have the contract's fields.  What breaks it is told by name before anything is read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Contracts of what readers give.
ACTIONS = "capture_id string, step_id string, sequence bigint, timestamp_ms bigint, action_type string, target string, value string"
TELEMETRY = "capture_id string, step_id string, event_time timestamp, layer string, event_name string, status string, payload map<string,string>, transaction_id string"
SNAPSHOTS = "capture_id string, step_id string, event_time timestamp, object_api_name string, record_id string, before map<string,string>, after map<string,string>, changed_fields array<string>"
_WHOLE = {"tinyint": 1, "smallint": 2, "int": 3, "bigint": 4}


class ContractError(ValueError):
    """A source does not keep its contract; says which columns, and how."""


def _schema(contract: str | T.StructType) -> T.StructType:
    return T._parse_datatype_string(contract) if isinstance(contract, str) else contract


def broken(have: T.DataType, want: T.DataType, name: str = "") -> list[str]:
    """What of ``have`` is not as ``want`` asks, by name."""
    if isinstance(want, T.StructType):
        if not isinstance(have, T.StructType):
            return [f"{name} is {have.simpleString()}, not {want.simpleString()}"]
        found, there = [], {f.name: f.dataType for f in have}
        for f in want:
            inner = f"{name}.{f.name}" if name else f.name
            found += broken(there[f.name], f.dataType, inner) if f.name in there else [f"{inner} is missing"]
        return found
    if isinstance(want, T.ArrayType) and isinstance(have, T.ArrayType):
        return broken(have.elementType, want.elementType, f"{name}[]")
    if isinstance(want, T.MapType) and isinstance(have, T.MapType):
        return broken(have.keyType, want.keyType, f"{name}.key") + broken(have.valueType, want.valueType, f"{name}.value")
    a, b = have.simpleString(), want.simpleString()
    fits = a == b or (a in _WHOLE and b in _WHOLE and _WHOLE[a] <= _WHOLE[b]) or {a, b} == {"timestamp", "timestamp_ntz"}
    return [] if fits else [f"{name} is {a}, not {b}"]


def checked(df: DataFrame, contract: str | T.StructType) -> DataFrame:
    """The contract's columns of ``df``, in its types; raises ContractError where it is broken.  Reads no row."""
    want = _schema(contract)
    if found := broken(df.schema, want):
        raise ContractError("; ".join(found))
    return df.to(want)


def read(spark: SparkSession, source: str, path: str, contract: str | T.StructType, **options) -> DataFrame:
    """A source of any format that Spark has, checked before rows are read.

    Formats with types of their own (parquet, orc, avro) are held against the contract; for lines of text, which have none, the contract is the
    schema, columns that no line has are null, and a line that does not keep it fails the read.
    """
    typed = source in ("parquet", "orc", "avro")
    reader = spark.read.format(source).options(**options)
    if typed:
        return checked(reader.load(path), contract)
    return reader.schema(_schema(contract)).option("mode", "FAILFAST").load(path)
