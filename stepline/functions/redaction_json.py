"""Redaction of JSON of any depth, level by level.

A document is taken apart a level at a time: an object's or array's children become rows, texts among them are scrubbed, values of
sensitive keys replaced, and containers wait for the next level.  Then levels are put together again from the deepest one up.  A level is
written before the next is made, so plans stay small, and there are as many rounds as the deepest document has levels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepline.functions.redaction import Policy, is_sensitive_field, redact_text, replacement
from stepline.sources.shared import cut, spread


def _json_text(text: Column) -> Column:
    """A text as a JSON string."""
    whole = F.to_json(F.struct(text.alias("x")))
    return F.substring(whole, F.lit(6), F.length(whole) - 6)


def _children(level: DataFrame, policy: Policy) -> DataFrame:
    """Children of containers (_row, _path, _value): their place, key, kind (object, array or leaf), and a leaf's JSON; null for a value that goes."""
    spark = level.sparkSession
    parent = F.schema_of_variant("_value").startswith("OBJECT")
    exploded = level.select("_row", "_path", "_value", parent.alias("_in_object")).lateralJoin(spark.tvf.variant_explode(F.col("_value").outer()).toDF("pos", "key", "child"))
    # each is used many times, and made once
    exploded = exploded.withColumns({"_kind": F.schema_of_variant("child"), "_text": F.try_variant_get("child", "$", "string"), "_hidden": F.col("_in_object") & is_sensitive_field(F.col("key"))})
    kind, text, hidden = F.col("_kind"), F.col("_text"), F.col("_hidden")
    is_object, is_array = kind.startswith("OBJECT"), kind.startswith("ARRAY")
    masked = F.when(kind == "STRING", replacement(text, "sensitive_field", policy)).otherwise("[REDACTED:sensitive_field]")
    leaf = F.when(kind == "STRING", _json_text(redact_text(text, policy))).otherwise(F.to_json("child"))
    # an array within an array is kept as it is
    waits = ~hidden & (is_object | (is_array & F.col("_in_object")))
    # the value null
    nothing = F.col("child").isNull() | (kind == "VOID")
    return exploded.select(
        "_row",
        F.col("_path").alias("_parent"),
        F.concat("_path", F.array("pos")).alias("_path"),
        "pos",
        F.when(F.col("_in_object"), F.col("key")).alias("key"),
        F.when(nothing | ~waits, "leaf").when(is_object, "object").otherwise("array").alias("kind"),
        F.when(hidden & F.lit(policy.mode == "drop"), F.lit(None)).when(hidden, _json_text(masked)).when(nothing, "null").when(waits, F.lit(None)).otherwise(leaf).alias("json"),
        (hidden & F.lit(policy.mode == "drop")).alias("dropped"),
        F.when(waits, F.col("child")).alias("_value"),
    ).filter("not dropped")


def _together(children: DataFrame) -> DataFrame:
    """(_row, _path, _inner): what is between the brackets of each container."""
    entry = F.when(F.col("key").isNotNull(), F.concat(_json_text(F.col("key")), F.lit(":"), "json")).otherwise(F.col("json"))
    inner = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", entry.alias("e")))), lambda x: x["e"]), ",")
    return children.groupBy("_row", F.col("_parent").alias("_path")).agg(inner.alias("_inner"))


def _closed(containers: DataFrame, inner: DataFrame, kind: Column) -> DataFrame:
    put = inner.select(F.col("_row").alias("_r"), F.col("_path").alias("_p"), "_inner")
    joined = containers.join(put, (F.col("_row") == F.col("_r")) & (F.col("_path") == F.col("_p")), "left")
    within = F.coalesce("_inner", F.lit(""))
    built = F.when(kind == "object", F.concat(F.lit("{"), within, F.lit("}"))).when(kind == "array", F.concat(F.lit("["), within, F.lit("]")))
    return joined.withColumn("json", F.coalesce(built, F.col("json"))).drop("_r", "_p", "_inner")


def redact_json(df: DataFrame, column: str, policy: Policy = Policy()) -> DataFrame:
    """The rows with the JSON objects in ``column`` scrubbed at every depth; keys come out in order.

    Values of sensitive keys are masked, hashed or dropped whole, other texts scrubbed, numbers and such kept.  What is no JSON object is scrubbed
    as plain text.  Nulls stay.
    """
    # a document costs far more than its bytes tell
    parsed = spread(df).withColumn("_row", F.monotonically_increasing_id()).withColumn("_value", F.try_parse_json(F.col(column)))
    numbered = cut(parsed.withColumn("_value", F.when(F.schema_of_variant("_value").startswith("OBJECT"), F.col("_value"))))
    top = numbered.filter("_value is not null").select("_row", F.array().cast("array<int>").alias("_path"), "_value")
    levels, frontier = [], top
    while True:
        children = cut(_children(frontier, policy).select("_row", "_parent", "_path", "pos", "key", "kind", "json", "_value"))
        levels.append(children.drop("_value"))
        frontier = children.filter("kind <> 'leaf'").select("_row", "_path", "_value")
        if not frontier.limit(1).count():
            break
    built = levels[-1]
    for level in reversed(levels[:-1]):
        built = cut(_closed(level, _together(built), F.col("kind")))
    whole = _closed(top.select("_row", "_path", F.lit(None).cast("string").alias("json")), _together(built), F.lit("object")).select(F.col("_row").alias("_r"), F.col("json").alias("_json"))
    joined = numbered.join(whole, F.col("_row") == F.col("_r"), "left")
    return joined.withColumn(column, F.when(F.col("_r").isNotNull(), F.col("_json")).otherwise(redact_text(F.col(column), policy))).select(*df.columns)
