"""Names from labels: tokens, their dialects, and unique names within a group."""

from __future__ import annotations

import keyword

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepline.functions.values import let

LIMIT = 74
#: Names that are taken, beside the keywords of Python, and what is put after a name that is one of them.
RESERVED = ("escalation", "off_topic", "ambiguous_question", "system", "config", "variables", "language", "start_agent", "subagent", "utils", *[k.lower() for k in keyword.kwlist])


def tokenize(label: Column) -> Column:
    """Words of a label: cut at what is no letter or digit, then where lower meets upper case and where an acronym ends."""
    bare = F.regexp_replace(F.coalesce(label, F.lit("")), r"^\s*UNRESOLVED:\s*", "")
    cut = F.regexp_replace(bare, "[^A-Za-z0-9]+", " ")
    cut = F.regexp_replace(cut, "([a-z0-9])([A-Z])", "$1 $2")
    cut = F.regexp_replace(cut, "([A-Z]+)([A-Z][a-z])", "$1 $2")
    return F.filter(F.split(cut, " "), lambda w: w != "")


def truncate_tokens(tokens: Column, limit: int = LIMIT, separator: int = 1) -> Column:
    """The first tokens that fit ``limit`` with a separator's length between them; a first one that is too long is cut."""
    start = F.struct(F.lit(-separator).alias("n"), F.array().cast("array<string>").alias("kept"))
    # once a token does not fit, the length stays beyond the limit, so none after it does
    longer = lambda acc, w: acc["n"] + separator + F.length(w)
    step = lambda acc, w: F.struct(longer(acc, w).alias("n"), F.when(longer(acc, w) <= limit, F.concat(acc["kept"], F.array(w))).otherwise(acc["kept"]).alias("kept"))
    first = lambda words: F.array(F.substring(F.get(words, F.lit(0)), 1, limit))
    shorter = lambda words: let(F.aggregate(words, start, step, lambda acc: acc["kept"]), lambda kept: F.when(F.size(kept) == 0, first(words)).otherwise(kept))
    return let(tokens, lambda words: F.when(F.length(F.array_join(words, "_" * separator)) <= limit, words).otherwise(shorter(words)))


def is_reserved(label: Column) -> Column:
    return F.lower(F.array_join(tokenize(label), "_")).isin(*RESERVED)


def escape_reserved(tokens: Column) -> Column:
    """A token more for a name that is taken; before truncation, which then keeps it."""
    return let(tokens, lambda words: F.when(F.lower(F.array_join(words, "_")).isin(*RESERVED), F.concat(words, F.array(F.lit("topic")))).otherwise(words))


def snake_case(label: Column, limit: int = LIMIT) -> Column:
    return F.lower(F.array_join(truncate_tokens(escape_reserved(tokenize(label)), limit), "_"))


def topic_api_name(label: Column, limit: int = LIMIT) -> Column:
    words = F.transform(truncate_tokens(escape_reserved(tokenize(label)), limit), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, LIMIT)))
    return F.array_join(words, "_")


def camel_name(label: Column) -> Column:
    """lowerCamel of a label or an API name, whose suffix ``__c`` goes."""
    words = tokenize(F.regexp_replace(label, "__c$", ""))
    cased = F.transform(words, lambda w, i: F.when(i == 0, F.lower(w)).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 200)))))
    return F.array_join(cased, "")


def prefixed_name(prefix: str, label: Column, limit: int = LIMIT) -> Column:
    if len(prefix) >= limit:
        raise ValueError(f"the prefix takes up all {limit} characters")
    return F.concat(F.lit(prefix), snake_case(label, limit - len(prefix)))


def names_agree(topic: Column, subagent: Column) -> Column:
    return snake_case(topic) == subagent


def _cluster(key: Column, limit: int) -> Column:
    """The same for all names that could become each other by a number at their end, cut to ``limit`` or not."""
    return F.regexp_replace(F.substring(key, 1, limit - 8), "(_[0-9]*)+$", "")


def _with_number(name: Column, n: Column, limit: int) -> Column:
    suffix = F.concat(F.lit("_"), n.cast("string"))
    return F.when(n == 1, name).otherwise(F.concat(F.substring(name, F.lit(1), F.lit(limit) - F.length(suffix)), suffix))


def dedupe_names(df: DataFrame, group: list[str], order: str, name: str, limit: int = LIMIT) -> DataFrame:
    """Adds ``unique_name``: unique in its group whatever the case, not reserved and at most ``limit`` long, by ``_2``, ``_3`` ... in order; null for null.

    Equal names are numbered by a window.  Only where a number leads to another of the group's names does it matter which numbers
    are free: such names alone, and those that could become them, go through Python, a set of them at a time.
    """
    key = F.lower(name)
    taken = is_reserved(F.col(name)) | (F.length(name) > limit)
    keyed = df.withColumns({"_key": key, "_cluster": _cluster(key, limit), "_taken": F.coalesce(taken, F.lit(False))})
    keys = [*group, "_cluster"]
    names = keyed.filter(F.col("_key").isNotNull()).groupBy(*keys, "_key").agg(F.count("*").alias("_n"), F.max("_taken").alias("_taken"))
    shape = names.groupBy(*keys).agg(F.count("*").alias("_names"), F.max((F.col("_n") > 1) | F.col("_taken")).alias("_numbers"))
    mixed = shape.filter("_names > 1 and _numbers").select(*[F.col(k).alias(f"_of_{k}") for k in keys])
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_of_{k}"))
    n = F.row_number().over(Window.partitionBy(*group, "_key").orderBy(order)) + F.col("_taken").cast("int")
    plain = keyed.join(mixed, on, "left_anti").withColumn("unique_name", _with_number(F.col(name), n, limit)).drop("_key", "_cluster", "_taken")

    def number(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order)
        used: set[str] = set()
        following: dict[str, int] = {}
        out = []
        for x, is_taken in zip(rows[name], rows["_taken"]):
            low = x.lower()
            # numbers below the one last given to this name are used up
            n = following.get(low, 2 if is_taken else 1)
            while (made := x if n == 1 else f"{x[: limit - len(str(n)) - 1]}_{n}").lower() in used:
                n += 1
            following[low] = n + 1
            used.add(made.lower())
            out.append(made)
        return rows.drop(columns=["_key", "_cluster", "_taken"]).assign(unique_name=out)

    schema = ", ".join(f"`{c}` {t}" for c, t in [*df.dtypes, ("unique_name", "string")])
    return plain.unionByName(keyed.join(mixed, on, "left_semi").groupBy(*keys).applyInPandas(number, schema))
