"""Sources: capture lines, manifests, network files, specifications; rejects instead of failures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

KNOWN_TYPES = ("click", "input", "change", "navigate", "scroll", "keydown", "submit")
VERSION = 1
ELEMENT = "struct<tag:string,type:string,name:string,id:string,classes:array<string>,aria_label:string,text:string,is_in_modal:boolean,modal_label:string,shadow_depth:int>"
SELECTORS = "struct<test_id:string,aria:string,role_name:struct<role:variant,name:string>,label_for:string,sf_field:string,css_path:string,text:string,xpath:string,selector_confidence:double,selector_fallback:string>"
LINE = (
    f"v int, seq int, t bigint, type string, url string, frame_path array<string>, selectors {SELECTORS}, element {ELEMENT}, value string, value_redacted boolean, "
    "sf struct<object:string,record_id:string,page_type:string,app:string>, _ingest_seq bigint, _ingest_t bigint, _frame_url string, _page_index int, _bad string"
)


def capture_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line_no, line) of capture files, without byte order marks and blank lines.

    Files are read in splits, as many tasks as their bytes need.  Within a split lines come in their order, and a table with a row for
    each split says how many lines are before it in its file; so lines get their numbers without being shuffled.
    """
    split = ["path", "start"]
    raw = spark.read.option("lineSep", "\n").text(path)
    placed = raw.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("_at"), F.col("value").alias("line"))
    before = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    splits = placed.groupBy(*split).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    splits = splits.select(*split, "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    numbered = placed.join(splits, split).withColumn("line_no", (F.col("_at") - F.col("_first") + F.col("_before") + 1).cast("int"))
    return numbered.select("path", "line_no", F.when(F.col("line_no") == 1, F.regexp_replace("line", "^\uFEFF", "")).otherwise(F.col("line")).alias("line")).filter(F.trim("line") != "")


def pack_lines(lines: DataFrame, path: str, order: list[str]) -> None:
    """Writes ``lines`` (capture_id, line and the ``order`` columns) as few files of many captures: a file for each task, not for each capture.

    A capture's lines are in one file, one after another, each behind its capture's id (none: empty) and a tab.
    """
    text = F.concat(F.coalesce(F.col("capture_id").cast("string"), F.lit("")), F.lit("\t"), F.coalesce("line", F.lit("")))
    lines.repartition("capture_id").sortWithinPartitions("capture_id", *order).select(text.alias("value")).write.option("maxRecordsPerFile", 0).text(path)


def packed_lines(spark: SparkSession, path: str) -> DataFrame:
    """(capture_id, line_no, line) of files that ``pack_lines`` has written, without blank lines; ``capture_id`` is text.

    A line's number is its place in the file less that of its capture's first line.
    """
    parts = F.split("line", "\t", 2)
    placed = capture_lines(spark, path).select(parts[0].alias("capture_id"), F.col("line_no").alias("_at"), parts[1].alias("line"))
    first = placed.groupBy("capture_id").agg(F.min("_at").alias("_first"))
    return placed.filter(F.trim("line") != "").join(first, "capture_id").select("capture_id", (F.col("_at") - F.col("_first") + 1).alias("line_no"), "line")


def marked_lines(lines: DataFrame, line: str = "line") -> DataFrame:
    """The lines with ``_e``, what they hold, and ``reason``, why they are rejected (null: they are events)."""
    parsed = lines.withColumn("_e", F.from_json(line, LINE, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    whole = F.ltrim(F.col(line)).startswith("{") & F.col("_e._bad").isNull()
    kind = F.schema_of_variant(F.try_parse_json(F.col(line)))
    why = F.when(kind.isNull(), "bad_json").when(~kind.startswith("OBJECT"), "not_an_object").otherwise("schema")
    role = F.schema_of_variant("_e.selectors.role_name.role")
    malformed = F.col("_e.t").isNull() | F.col("_e.type").isNull() | F.coalesce(~role.isin("STRING", "VOID"), F.lit(False))
    return parsed.withColumn("reason", F.when(~F.coalesce(whole, F.lit(False)), why).when(malformed, "schema"))


def parse_lines(lines: DataFrame, line: str = "line") -> tuple[DataFrame, DataFrame]:
    """Events and rejects (with ``reason``) of capture lines; other columns come along.

    A line is rejected if it is no JSON, no object, or has a field of another type than the
    schema's; a role that is a number is malformed, one that is null is fine.  A line is parsed once, a reject once more to tell why.
    """
    marked = marked_lines(lines, line)
    keep = [c for c in lines.columns if c != line]
    fields = [x.split()[0] for x in ("v seq t type url frame_path selectors element value value_redacted sf _ingest_seq _ingest_t _frame_url _page_index").split(" ")]
    name = F.col("_e.selectors.role_name")
    named = F.when(name.isNotNull(), F.struct(F.try_variant_get(name["role"], "$", "string").alias("role"), name["name"].alias("name")))
    selectors = F.when(F.col("_e.selectors").isNotNull(), F.col("_e.selectors").withField("role_name", named)).alias("selectors")
    events = marked.filter("reason is null").select(*keep, *[selectors if f == "selectors" else F.col(f"_e.{f}").alias(f.lstrip("_")) for f in fields]).withColumn("known_type", F.col("type").isin(*KNOWN_TYPES))
    return events, marked.filter("reason is not null").select(*keep, "reason")


def version_gate(events: DataFrame) -> DataFrame:
    """Adds ``version_note``: assumed, old, fatal (a version from the future rejects the file) or null."""
    v = F.col("v")
    return events.withColumn("version_note", F.when(v.isNull(), "assumed").when(v > VERSION, "fatal").when(v < 1, "old"))


def pair_manifest(captures: DataFrame, manifests: DataFrame, suffix: str = ".jsonl") -> DataFrame:
    """Each capture with its manifest, by ``name.manifest.json`` or else ``name.jsonl.manifest.json``; absent and corrupt differ.

    ``captures``: path.  ``manifests``: path, corrupt and further columns.
    """
    stem = F.regexp_replace("path", suffix.replace(".", r"\.") + "$", "")
    first = captures.withColumn("_a", F.concat(stem, F.lit(".manifest.json"))).withColumn("_b", F.concat("path", F.lit(".manifest.json")))
    more = [c for c in manifests.columns if c != "path"]
    a = manifests.select(F.col("path").alias("_a"), F.struct("path", *more).alias("_ma"))
    b = manifests.select(F.col("path").alias("_b"), F.struct("path", *more).alias("_mb"))
    joined = first.join(a, "_a", "left").join(b, "_b", "left").withColumn("_m", F.coalesce("_ma", "_mb"))
    status = F.when(F.col("_m").isNull(), "absent").when(F.col("_m.corrupt"), "corrupt").otherwise("found")
    return joined.select(*captures.columns, status.alias("manifest_status"), *[F.col(f"_m.{c}").alias(f"manifest_{c}") for c in more if c != "corrupt"])


def network_events(rows: DataFrame, patterns: list[str], url: str = "url") -> DataFrame:
    """Network events whose URL matches any of the patterns."""
    return rows.filter(F.col(url).rlike("|".join(f"(?:{p})" for p in patterns)))


def read_network(spark: SparkSession, path: str, patterns: list[str]) -> DataFrame:
    return network_events(spark.read.schema("t long, url string, method string, status int, resource_type string").json(path), patterns)


def clock_ms(value: Column) -> Column:
    """Milliseconds of a time that may be ISO text, or a count of nanoseconds or milliseconds."""
    n = F.try_to_number(value, F.lit("9999999999999999999")).cast("long")
    return F.when(value.rlike("^[0-9]{16,}$"), F.call_function("div", n, F.lit(1_000_000))).when(value.rlike("^[0-9]+$"), n).otherwise(F.unix_millis(F.try_to_timestamp(value)))


def latest_capture(files: DataFrame, keys: list[str], path: str = "path", mtime: str = "mtime") -> DataFrame:
    """The newest file of each key; of equally new ones that with the last name."""
    return files.groupBy(*keys).agg(F.max_by(path, F.struct(mtime, path)).alias(path))


def track_records(text: Column) -> Column:
    """``Object:Id`` as a struct; null where there is no colon."""
    parts = F.split(text, ":", 2)
    return F.when(F.size(parts) == 2, F.struct(F.trim(parts[0]).alias("object"), F.trim(parts[1]).alias("record_id")))


def read_specs(spark: SparkSession, path: str) -> DataFrame:
    """Specification files, with defaults for what they leave out."""
    entity = "struct<name:string,object_api_name:string,field_api_name:string,evidence:array<struct<source:string,detail:string>>>"
    raw = spark.read.schema(f"capture_id string, intent string, confidence double, objects_touched array<string>, entities array<{entity}>, orchestration_steps array<string>, guardrails array<string>, failure_handling array<string>, unknowns array<string>, evidence array<struct<source:string,detail:string>>, extraction_source string, telemetry_source string").option("multiLine", True).json(path)
    lists = [f.name for f in raw.schema if f.dataType.typeName() == "array"]
    empty = {c: F.coalesce(c, F.array().cast(raw.schema[c].dataType)) for c in lists}
    return raw.withColumns(empty | {"confidence": F.coalesce("confidence", F.lit(0.0)), "intent": F.coalesce("intent", F.lit(""))})
