"""Backend records: event logs, field histories, snapshots, differences over time."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS = ["capture_id"]
#: History rows that say that a record was touched, not what was changed.
HISTORY_NOISE = ("created", "feedEvent", "locked", "unlocked")
#: The step of an observation that no step claims, and kinds of actions that write.
UNATTRIBUTED = "unattributed-org-observation"
WRITES = ("submit", "input", "select")
#: Fields that the system itself writes.
SYSTEM_FIELDS = ("Id", "CreatedDate", "CreatedById", "LastModifiedDate", "LastModifiedById", "SystemModstamp", "IsDeleted", "LastViewedDate", "LastReferencedDate")


def telemetry_layer(event_type: Column) -> Column:
    """The layer of a backend event, by parts of its type; asynchronous work is told before the code it runs."""
    t = F.upper(F.coalesce(event_type, F.lit("")))
    has = lambda *parts: reduce(Column.__or__, [t.contains(p) for p in parts])
    return (
        F.when(has("BULK", "ASYNC"), "async")
        .when(has("APEX"), "apex")
        .when(t.isin("API", "URI", "RESTAPI"), "network")
        .when(has("VALIDATION"), "validation")
        .when(has("FLOW"), "flow")
        .when(has("LIGHTNING", "AURAACTION"), "ui")
        .when(has("WAVE", "REPORT"), "data")
        .when(has("CALLOUT", "EXTERNALCROSSORG"), "integration")
        .otherwise("network")
    )


def status_normalise(raw: Column) -> Column:
    low = F.lower(F.trim(raw))
    return F.when(low.isin("1", "true"), "success").when(low.isin("0", "false"), "error").otherwise(low)


def log_events(rows: DataFrame, time_columns: list[str], id_columns: list[str], status_columns: list[str], type_columns: list[str], event_type: str | None = None) -> DataFrame:
    """Log rows as telemetry; event_time is null where no time can be read.

    The first filled column of each list counts; all others that are filled become the payload.  ``event_type`` names rows that name no
    type, and where it is given decides the layer of all.
    """
    filled = lambda names: [F.nullif(F.trim(F.col(c).cast("string")), F.lit("")) for c in names]
    first = lambda names: F.coalesce(*filled(names))
    used = {*time_columns, *id_columns, *status_columns, *type_columns}
    rest = [c for c in rows.columns if c not in used]
    payload = F.map_filter(F.create_map(*[x for c in rest for x in (F.lit(c), F.col(c).cast("string"))]), lambda k, v: F.coalesce(v, F.lit("")) != "") if rest else F.create_map().cast("map<string,string>")
    kind = first(type_columns) if event_type is None else F.coalesce(*filled(type_columns), F.lit(event_type))
    layer = telemetry_layer(first(type_columns) if event_type is None else F.lit(event_type))
    return rows.select(F.try_to_timestamp(first(time_columns)).alias("event_time"), first(id_columns).alias("transaction_id"), status_normalise(first(status_columns)).alias("status"), kind.alias("event_name"), layer.alias("layer"), payload.alias("payload"))


def event_log(rows: DataFrame, time_columns: list[str], id_columns: list[str], status_columns: list[str], type_columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """Log rows as telemetry (see ``log_events``), and the rows without a readable time."""
    made = log_events(rows, time_columns, id_columns, status_columns, type_columns)
    return made.filter("event_time is not null"), made.filter("event_time is null")


def history_events(history: DataFrame, noise=HISTORY_NOISE, step: str = UNATTRIBUTED) -> DataFrame:
    """Field changes as data telemetry that belongs to no step yet; rows that are no change and rows without a time go."""
    kept = history.filter(~F.col("field").isin(*noise) & F.col("t").isNotNull())
    return kept.select("capture_id", F.lit(step).alias("step_id"), "t", F.lit("data").alias("layer"), F.concat("field", F.lit(" changed")).alias("event_name"), "record_id", "field", "old_value", "new_value")


def history_snapshots(history: DataFrame, noise=HISTORY_NOISE, keys=KEYS) -> DataFrame:
    """One snapshot for each record and time: fields before and after; of several changes of a field the last."""
    kept = history.filter(~F.col("field").isin(*noise) & F.col("t").isNotNull())
    last = kept.groupBy(*keys, "record_id", "t", "field").agg(F.max_by(F.struct("old_value", "new_value"), "row_no").alias("_v"))
    entries = F.array_sort(F.collect_list(F.struct("field", F.col("_v.old_value").alias("old"), F.col("_v.new_value").alias("new"))))
    got = last.groupBy(*keys, "record_id", "t").agg(entries.alias("_e"))
    pairs = lambda name: F.map_from_entries(F.transform("_e", lambda e: F.struct(e["field"], e[name])))
    return got.select(*keys, "record_id", "t", F.transform("_e", lambda e: e["field"]).alias("changed_fields"), pairs("old").alias("before"), pairs("new").alias("after"))


def record_diff(states: DataFrame, state: str, keys: list[str], order: list[str]) -> DataFrame:
    """Fields whose value differs from the record's last state that was not empty."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = F.last(F.when(F.size(state) > 0, F.col(state)), ignorenulls=True).over(w)
    seen = states.withColumn("_before", before)
    changed = F.map_filter(state, lambda k, v: ~F.coalesce(F.element_at("_before", k), F.lit("\0")).eqNullSafe(F.coalesce(v, F.lit("\0"))))
    return seen.withColumn("changed", F.array_sort(F.map_keys(F.when(F.col("_before").isNotNull(), changed).otherwise(F.col(state))))).drop("_before")


def objects_touched(snapshots: DataFrame, object_col: str, order: str, keys=KEYS) -> DataFrame:
    """Distinct objects in the order in which they are first seen."""
    first = snapshots.groupBy(*keys, object_col).agg(F.min(order).alias("_o"))
    return first.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_o", F.col(object_col).alias("name")))), lambda x: x["name"]), ",").alias("objects"))


def changed_fields(snapshots: DataFrame, keys=KEYS, order: list[str] = ["t", "record_id"], noise=SYSTEM_FIELDS) -> DataFrame:
    """Distinct changed fields of a capture in the order of their first change, without the system's."""
    rows = snapshots.select(*keys, F.struct(*order).alias("_o"), F.posexplode("changed_fields").alias("_i", "field")).filter(~F.col("field").isin(*noise))
    first = rows.groupBy(*keys, "field").agg(F.min(F.struct("_o", "_i")).alias("_first"))
    return first.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_first", "field"))), lambda x: x["field"]), ",").alias("fields"))


def failed_log_signal(logs: DataFrame, keys: list[str], order: list[str], last: int = 5) -> DataFrame:
    """Whether any of the last logs ended otherwise than well."""
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    recent = logs.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= last)
    return recent.groupBy(*keys).agg(F.max(~F.lower("status").isin("success", "completed")).alias("failed"), F.count("*").alias("n_logs"))


def ui_error_code(text: Column) -> Column:
    """Code of an interface error, from its exception's class and text; null if there was none."""
    low = F.lower(text)
    has = lambda *parts: reduce(Column.__or__, [low.contains(p) for p in parts])
    return (
        F.when(text.isNull(), None)
        .when(has("timeout"), "TIMEOUT")
        .when(has("detached", "stale"), "STALE_REFERENCE")
        .when(has("no locator matched", "strict mode violation"), "ELEMENT_NOT_FOUND")
        .when(has("target closed", "page closed"), "TARGET_CLOSED")
        .when(has("navigation"), "TRANSIENT_NAVIGATION")
        .otherwise("UI_RUNTIME_ERROR")
    )


def derive_intent(captures: DataFrame, snapshots: DataFrame, order: list[str], keys=KEYS) -> DataFrame:
    """What a capture did: verb, first object and the first three changed fields, repeated ones once.

    ``captures``: keys and has_writes, one row each.  ``snapshots``: object_name, before,
    changed_fields and the ``order`` columns.  Confidence goes down with the evidence: fields of one
    object, of several, an object alone, writes alone, nothing.
    """
    place = F.struct(*order)
    objects = snapshots.groupBy(*keys).agg(F.min_by("object_name", place).alias("_object"), F.count_distinct("object_name").alias("_n"), F.max(F.coalesce(F.size("before"), F.lit(0)) <= 0).alias("_created"))
    business = F.filter("changed_fields", lambda f: ~f.isin(*SYSTEM_FIELDS))
    changes = snapshots.select(*keys, *order, F.posexplode(business).alias("_i", "_field"))
    first = changes.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order, "_i"))).filter("_k <= 3")
    fields = first.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_k", "_field"))).alias("_f"))
    joined = captures.join(objects, keys, "left").join(fields, keys, "left")
    named = F.array_join(F.array_distinct(F.transform("_f", lambda x: x["_field"])), ", ")
    observed = F.col("_object").isNotNull()
    changed = observed & F.col("_f").isNotNull()
    writes = F.coalesce("has_writes", F.lit(False))
    text = (
        F.when(changed, F.concat(F.when(F.col("_created"), "Create ").otherwise("Update "), "_object", F.lit(" ("), named, F.lit(")")))
        .when(observed, F.concat(F.lit("Interact with "), "_object", F.lit(" via guided process")))
        .when(writes, F.lit("Complete a data-entry process (target object unresolved)"))
        .otherwise(F.lit("UNRESOLVED: recording did not demonstrate a completed business action"))
    )
    confidence = F.when(changed & (F.col("_n") == 1), 0.7).when(changed, 0.5).when(observed, 0.4).when(writes, 0.2).otherwise(0.05)
    return joined.select(*keys, text.alias("intent"), confidence.alias("confidence"))
