"""Events to actions: a projection of column expressions and one window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS = ["capture_id"]
#: Labels of controls that submit.
SUBMIT_LABELS = ("save", "submit", "next", "finish", "create", "update", "apply", "confirm")


def _text(c: Column) -> Column:
    return F.lower(F.trim(F.coalesce(c, F.lit(""))))


def _combobox(classes: Column | None) -> Column:
    return F.lit(False) if classes is None else F.coalesce(F.exists(classes, lambda c: F.lower(c).contains("combobox")), F.lit(False))


def action_type(kind: Column, tag: Column, elem_type: Column, aria_label: Column, text: Column, classes: Column | None = None) -> Column:
    label = F.coalesce(F.nullif(_text(aria_label), F.lit("")), _text(text))
    submits = (_text(tag).isin("button", "input") & (_text(elem_type) == "submit")) | label.isin(*SUBMIT_LABELS)
    return (
        F.when(kind == "click", F.when(submits, "submit").otherwise("click"))
        .when(kind.isin("input", "change"), F.when((_text(tag) == "select") | _combobox(classes), "select").otherwise("input"))
        .when(kind == "navigate", "navigate")
        .when(kind == "scroll", "scroll")
        .when(kind == "keydown", "hotkey")
        .otherwise("click")
    )


def target_prefix(tag: Column, elem_type: Column, classes: Column | None = None) -> Column:
    t, kind = F.lower(F.coalesce(tag, F.lit(""))), F.coalesce(elem_type, F.lit(""))
    return (
        F.when((t == "button") | ((t == "input") & kind.isin("button", "submit")), "button:")
        .when(t.isin("input", "textarea", "select"), "input:")
        .when(t == "a", "link:")
        .when(_combobox(classes), "input:")
        .otherwise("text:")
    )


def target_label(aria_label: Column, text: Column, name: Column, elem_id: Column) -> Column:
    """The first that is not blank; null if all are."""
    return F.coalesce(*[F.nullif(F.trim(F.coalesce(c, F.lit(""))), F.lit("")) for c in (aria_label, text, name, elem_id)])


def target(tag: Column, elem_type: Column, label: Column, seq: Column, classes: Column | None = None) -> Column:
    return F.concat(target_prefix(tag, elem_type, classes), F.coalesce(label, F.concat(F.coalesce(tag, F.lit("")), F.lit("#"), seq.cast("string"))))


def infer_intent(kind: Column, field: Column, value: Column, sensitive: Column) -> Column:
    return F.when(kind.isin("input", "select"), F.when(sensitive, F.concat(F.lit("Set "), field, F.lit(" (redacted)"))).when(value.isNotNull(), F.concat(F.lit("Set "), field, F.lit(" to "), value))).when(kind == "submit", F.lit("Submit form"))


def relative_time(events: DataFrame, keys=KEYS, order: str = "ordinal", t: str = "t", out: str = "timestamp_ms") -> DataFrame:
    """Time since the capture's first event."""
    return events.withColumn(out, F.col(t) - F.first(t).over(Window.partitionBy(*keys).orderBy(order)))


def to_actions(events: DataFrame, keys=KEYS, order: str = "ordinal", t: str = "t") -> DataFrame:
    """Numbered actions with type, target, relative time, intent and warnings."""
    w = Window.partitionBy(*keys).orderBy(order)
    n = F.row_number().over(w)
    kind = action_type(F.col("type"), F.col("tag"), F.col("elem_type"), F.lit(None).cast("string"), F.col("label"))
    label = target_label(F.lit(None).cast("string"), F.col("label"), F.col("elem_name"), F.col("elem_key"))
    hidden = F.col("value_redacted") | (F.coalesce(F.col("elem_type"), F.lit("")) == "password")
    named = events.select(
        *keys,
        n.alias("sequence"),
        F.format_string("step-%03d", n).alias("step_id"),
        (F.col(t) - F.first(t).over(w)).alias("timestamp_ms"),
        kind.alias("action_type"),
        target(F.col("tag"), F.col("elem_type"), label, F.col("seq")).alias("target"),
        label.isNull().alias("weak_target"),
        hidden.alias("sensitive"),
        F.when(~hidden, F.col("value")).alias("value"),
        F.coalesce(label, F.lit("field")).alias("_field"),
    )
    return named.withColumn("inferred_intent", infer_intent(F.col("action_type"), F.col("_field"), F.col("value"), F.col("sensitive"))).drop("_field")


def to_evidence(events: DataFrame, keys=KEYS, order: str = "ordinal", t: str = "t") -> DataFrame:
    """The absolute time and page of each action, by evidence id."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    return events.select(*keys, F.format_string("ev-%03d", n).alias("evidence_id"), F.format_string("step-%03d", n).alias("step_id"), F.col(t).alias("captured_ms"), "url")


def wall_clock(actions: DataFrame, evidence: DataFrame, keys=KEYS) -> DataFrame:
    """Adds ``absolute_ms``, from the first evidence of each step; the relative time where there is none."""
    first = evidence.groupBy(*keys, "step_id").agg(F.min_by("captured_ms", "evidence_id").alias("_at"))
    return actions.join(first, [*keys, "step_id"], "left").withColumn("absolute_ms", F.coalesce("_at", "timestamp_ms")).drop("_at")


def evidence_join(actions: DataFrame, evidence: DataFrame, keys=KEYS, ids: str = "evidence_ids") -> DataFrame:
    """Each action with the evidence that it names, in the order of its list; actions that name none stay."""
    named = actions.select("*", F.posexplode_outer(ids).alias("evidence_pos", "evidence_id"))
    return named.join(evidence.drop("step_id"), [*keys, "evidence_id"], "left")


def recording_id(events: DataFrame, keys=KEYS, order: str = "ordinal", first: int = 100, manifest_id: str | None = None) -> DataFrame:
    """``rec-`` and a digest of a capture's first events; the manifest's id if there is one."""
    head = events.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).filter(F.col("_n") <= first)
    row = F.struct("_n", F.concat_ws("|", F.col("type"), F.col("t").cast("string"), F.coalesce("elem_key", F.lit("")), F.coalesce("url", F.lit(""))).alias("_line"))
    own = [F.max(manifest_id).alias("_own")] if manifest_id else []
    got = head.groupBy(*keys).agg(F.array_sort(F.collect_list(row)).alias("_rows"), *own)
    digest = F.concat(F.lit("rec-"), F.substring(F.sha2(F.array_join(F.transform("_rows", lambda r: r["_line"]), "\n"), 256), 1, 16))
    return got.select(*keys, (F.coalesce("_own", digest) if manifest_id else digest).alias("recording_id"))
