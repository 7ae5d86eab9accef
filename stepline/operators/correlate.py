"""Actions and what the backend did after them: a forward interval join, and its rollups.

An effect belongs to a step if it comes at the step's time or up to a window later (both ends
included), or if it names the step.  In time and named is HIGH, in time alone TEMPORAL, named
alone ASSERTED.  Where several effects of one group (layer, or object and record) fall into a
step's window, the nearest stays and is AMBIGUOUS.

Physically the two conditions are two equi joins whose results are merged: one by capture and
time bucket (as long as the window, so a window meets two), one by capture and step id.  A
single join on either condition would compare all pairs of a capture.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepline.operators.records import ui_error_code

KEYS = ["capture_id"]
WINDOW_MS = 5_000
#: Layers whose errors explain a failure, and codes that are the interface's own.
EXPLAINING = ("validation", "flow", "apex", "network", "integration")
INTERFACE_CODES = ("ELEMENT_NOT_FOUND", "TIMEOUT")


def correlate(actions: DataFrame, effects: DataFrame, window_ms: int = WINDOW_MS, keys=KEYS, back_tolerance_ms: int = 0, effect_id: str = "event_no") -> DataFrame:
    """(keys, sequence, step_id, step_t, effect columns, delta_ms, confidence), one row a match.

    ``actions``: sequence, step_id, t.  ``effects``: t, step_id and ``effect_id``.
    """
    steps = actions.select(*keys, "sequence", "step_id", F.col("t").alias("step_t"))
    named = effects.withColumnRenamed("step_id", "_names").withColumnRenamed("t", "effect_t")
    width = window_ms + back_tolerance_ms + 1
    first = F.floor((F.col("step_t") - back_tolerance_ms) / width)
    bucketed = steps.withColumn("_bucket", F.explode(F.array(first, first + 1)))
    in_time = (
        bucketed.join(named.withColumn("_bucket", F.floor(F.col("effect_t") / width)), [*keys, "_bucket"])
        .filter(F.col("effect_t").between(F.col("step_t") - back_tolerance_ms, F.col("step_t") + window_ms))
        .drop("_bucket")
        .withColumn("confidence", F.when(F.col("_names") == F.col("step_id"), "HIGH").otherwise("TEMPORAL"))
    )
    by_name = named.filter(F.col("_names").isNotNull()).withColumn("step_id", F.col("_names"))
    asserted = (
        steps.join(by_name, [*keys, "step_id"])
        .filter(~F.col("effect_t").between(F.col("step_t") - back_tolerance_ms, F.col("step_t") + window_ms))
        .withColumn("confidence", F.lit("ASSERTED"))
    )
    both = in_time.unionByName(asserted)
    return both.withColumn("delta_ms", F.col("effect_t") - F.col("step_t")).drop("_names")


def resolve_ambiguity(matches: DataFrame, group: list[str], keys=KEYS, effect_id: str = "event_no") -> DataFrame:
    """Where more than one match of a step and group is in time, only the nearest of all the group's matches stays, as AMBIGUOUS."""
    of = [*keys, "sequence", *group]
    n = F.count_if(F.col("confidence").isin("HIGH", "TEMPORAL")).over(Window.partitionBy(*of))
    nearest = F.row_number().over(Window.partitionBy(*of).orderBy(F.abs("delta_ms"), effect_id))
    marked = matches.withColumn("_n", n).withColumn("_nearest", nearest)
    kept = marked.filter((F.col("_n") <= 1) | (F.col("_nearest") == 1))
    return kept.withColumn("confidence", F.when(F.col("_n") > 1, "AMBIGUOUS").otherwise(F.col("confidence"))).drop("_n", "_nearest")


def confidence_rank(confidence: Column) -> Column:
    return F.when(confidence == "HIGH", 0).when(confidence == "TEMPORAL", 1).when(confidence == "AMBIGUOUS", 2).otherwise(3)


def correlation_order(matches: DataFrame, keys=KEYS, effect_id: str = "event_no") -> DataFrame:
    """Adds ``place``: the match's place among its step's, by confidence and then time."""
    w = Window.partitionBy(*keys, "sequence").orderBy(confidence_rank(F.col("confidence")), "effect_t", effect_id)
    return matches.withColumn("place", F.row_number().over(w))


def triggered_layers(matches: DataFrame, by: list[str]) -> DataFrame:
    return matches.groupBy(*by).agg(F.array_join(F.array_sort(F.collect_set("layer")), ",").alias("layers"))


def latest_attempt(attempts: DataFrame, keys=KEYS) -> DataFrame:
    columns = [c for c in attempts.columns if c not in (*keys, "step_id")]
    ordered = ["attempt_no", *[c for c in columns if c != "attempt_no"]]
    return attempts.groupBy(*keys, "step_id").agg(F.max(F.struct(*ordered)).alias("_last")).select(*keys, "step_id", "_last.*")


def replay_join(actions: DataFrame, attempts: DataFrame, keys=KEYS) -> DataFrame:
    """Each action with its last attempt; actions never tried stay."""
    return actions.join(latest_attempt(attempts, keys), [*keys, "step_id"], "left")


def retry_chain(attempts: DataFrame, keys=KEYS, base_ms: int = 500) -> DataFrame:
    """Attempts up to the first success or failure that is not retried, each with the wait before the next."""
    w = Window.partitionBy(*keys, "step_id").orderBy("attempt_no")
    ended = F.coalesce(F.max((F.col("status") != "retried").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    wait = F.when((F.col("status") == "retried") & F.lead("attempt_no").over(w).isNotNull(), (F.lit(base_ms) * F.pow(F.lit(2), F.col("attempt_no") - 1)).cast("long"))
    return attempts.withColumn("_ended", ended).withColumn("backoff_ms", wait).filter("_ended = 0").drop("_ended")


def is_error(status: Column) -> Column:
    return F.lower(F.coalesce(status, F.lit(""))) == "error"


def failure_layer(status: Column, error_code: Column, matches: Column) -> Column:
    """Why a step failed, if its last attempt did: the interface's own codes first, else the first error
    of a layer that explains one, among the correlated events (``matches``: structs with layer and status, in order)."""
    errors = F.filter(matches, lambda m: is_error(m["status"]) & m["layer"].isin(*EXPLAINING))
    layer = F.get(F.transform(errors, lambda m: m["layer"]), F.lit(0))
    of_interface = F.coalesce(error_code.startswith("UI_") | error_code.isin(*INTERFACE_CODES), F.lit(False))
    cause = F.when(of_interface, F.lit("ui")).when(layer == "network", "integration").otherwise(F.coalesce(layer, F.lit("unknown")))
    return F.when(status.isin("failed", "retried"), cause)


def artifact_paths(message: Column) -> dict[str, Column]:
    take = lambda name: F.nullif(F.trim(F.regexp_extract(F.coalesce(message, F.lit("")), rf"{name}=([^;]+)", 1)), F.lit(""))
    return {"screenshot": take("screenshot"), "network_trace": take("network_trace")}


def step_analysis(actions: DataFrame, matches: DataFrame, attempts: DataFrame, keys=KEYS) -> DataFrame:
    """One row a step: its last status, layers, matches by confidence, failure and artifacts."""
    ordered = correlation_order(matches, keys)
    rolled = ordered.groupBy(*keys, "sequence").agg(
        F.array_sort(F.collect_list(F.struct("place", "layer", "status", "confidence"))).alias("_m"),
        F.array_join(F.array_sort(F.collect_set("layer")), ",").alias("layers"),
        F.count("*").alias("n_matches"),
        F.count_if(F.col("confidence") == "HIGH").alias("n_high"),
        F.count_if(F.col("confidence") == "AMBIGUOUS").alias("n_ambiguous"),
    )
    last = latest_attempt(attempts, keys)
    joined = actions.select(*keys, "sequence", "step_id").join(rolled, [*keys, "sequence"], "left").join(last, [*keys, "step_id"], "left")
    paths = artifact_paths(F.col("message"))
    return joined.select(
        *keys,
        "sequence",
        "step_id",
        "status",
        F.coalesce("layers", F.lit("")).alias("layers"),
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_matches", "n_high", "n_ambiguous")],
        failure_layer(F.col("status"), ui_error_code(F.col("error")), F.coalesce("_m", F.array().cast("array<struct<place:int,layer:string,status:string,confidence:string>>"))).alias("failure"),
        paths["screenshot"].alias("screenshot"),
        paths["network_trace"].alias("network_trace"),
    )
