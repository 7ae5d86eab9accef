"""Refinement of specifications without new evidence, round by round until each is through.

A round scores the specifications that are still running, stops those that have passed, fallen
back, stalled or run out of rounds, and improves the rest.  All captures go through a round
together; those that have stopped leave, so each round is smaller than the one before, and what is written after each
round keeps plans as small as one round's, however many there are.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepline.functions.values import let
from stepline.operators.prompts import refused_reason
from stepline.operators.rounds import pick_best
from stepline.operators.specs import POINTS, score_spec
from stepline.sources.shared import cut

KEYS = ["capture_id"]
MOST_ROUNDS, EPSILON, STALLS = 5, 2, 2
#: Words that go from an intent, phrases of guardrails that take a name, and what is said of a change.
VAGUE_TERMS = ("various", "some", "etc.", "as needed", "possibly", "might")
NOTHING_DONE = (
    "No offline improvements applied. The spec already has concrete intent, distinct steps, object-specific guardrails, and camelCase entity names. "
    "Meaningful improvement requires use_cli=True (LLM refinement with org context) or re-recording with more complete data."
)
UNKNOWNS_DROPPED = "WARNING: score improved but unknowns decreased — verify this is honest refinement (filling gaps with evidence) and not gaming the metric by deleting caveats."
FIELDS_NAMED = 3


def _once(lines: Column) -> Column:
    """The first of the lines that are equal but for case and spaces."""
    key = lambda s: F.trim(F.regexp_replace(F.lower(s), r"\s+", " "))
    return let(F.transform(lines, key), lambda keys: F.filter(lines, lambda s, i: F.array_position(keys, F.get(keys, i)) == i + 1))


def _tightened(intent: Column) -> Column:
    for term in VAGUE_TERMS:
        quoted = term.replace(".", r"\.")
        intent = F.regexp_replace(intent, rf"(?i)\b{quoted}\b", "")
    return F.trim(F.regexp_replace(intent, r"\s+", " "))


def _named(rail: Column, thing: Column, fields: Column) -> Column:
    """A guardrail with the object or the fields that it is about; of several phrases the last one counts."""
    low = F.lower(rail)
    swap = lambda verb: F.replace(F.replace(rail, F.lit(f"{verb.capitalize()} input"), F.concat(F.lit(f"{verb.capitalize()} "), thing, F.lit(" fields"))), F.lit(f"{verb} input"), F.concat(F.lit(f"{verb} "), thing, F.lit(" fields")))
    asks = F.contains(low, F.lit("require confirmation")) & ~F.contains(low, F.lit("before writing")) & (fields != "") & ~F.contains(rail, fields)
    confirmed = F.concat(F.regexp_replace(rail, r"\.+$", ""), F.lit(" before writing: "), fields, F.lit("."))
    return F.when(asks, confirmed).when(F.contains(low, F.lit("check input")), swap("check")).when(F.contains(low, F.lit("validate input")), swap("validate")).otherwise(rail)


def offline_improve(specs: DataFrame) -> DataFrame:
    """The specifications improved, with ``improvement``: what was done.

    Vague words go from the intent, names of entities begin small, repeated steps and guardrails go, generic
    guardrails name the object or the fields.  Nothing is added that is not there, no unknown goes and confidence stays.
    """
    c = F.col
    started = lambda n: n.rlike("^[A-Z][a-z]")
    small = lambda e: F.when(started(e["name"]), F.concat(F.lower(F.substring(e["name"], 1, 1)), F.substring(e["name"], F.lit(2), F.length(e["name"])))).otherwise(e["name"])
    thing = F.get("objects_touched", F.lit(0))
    fields = F.array_join(F.slice(F.transform(F.filter("entities", lambda e: F.coalesce(e["field_api_name"], F.lit("")) != ""), lambda e: e["field_api_name"]), 1, FIELDS_NAMED), ", ")
    new = {
        "intent": _tightened(c("intent")),
        "entities": F.transform("entities", lambda e: e.withField("name", small(e))),
        "orchestration_steps": _once(c("orchestration_steps")),
        "_rails": _once(c("guardrails")),
    }
    done = specs.withColumns({f"_new_{k}": v for k, v in new.items()}).withColumn("_thing", thing).withColumn("_fields", fields)
    done = done.withColumn("_new_guardrails", F.when(c("_thing").isNotNull(), F.transform("_new__rails", lambda r: _named(r, c("_thing"), c("_fields")))).otherwise(c("_new__rails")))
    n_names = F.size(F.filter("entities", lambda e: F.coalesce(started(e["name"]), F.lit(False))))
    n_steps, n_rails = F.size("orchestration_steps") - F.size("_new_orchestration_steps"), F.size("guardrails") - F.size("_new__rails")
    n_named = _count_named(c("_new__rails"), c("_new_guardrails"), c("_fields"))
    told = lambda n, *text: F.when(n > 0, F.concat(F.lit(text[0]), n.cast("string"), F.lit(text[1])))
    parts = F.array(
        F.when(~c("_new_intent").eqNullSafe(c("intent")), F.lit("removed vague terms from intent")),
        told(n_names, "normalized ", " entity name(s) to camelCase"),
        told(n_steps, "deduplicated ", " orchestration step(s)"),
        told(n_rails, "deduplicated ", " guardrail(s)"),
        told(n_named, "expanded ", " generic guardrail(s) to name specific objects/fields"),
    )
    parts = F.filter(parts, lambda x: x.isNotNull())
    said = F.when(F.size(parts) > 0, F.concat(F.lit("Applied "), F.size(parts).cast("string"), F.lit(" offline improvement(s): "), F.array_join(parts, "; "))).otherwise(NOTHING_DONE)
    changed = ("intent", "entities", "orchestration_steps", "guardrails")
    out = done.withColumn("improvement", said).withColumns({k: c(f"_new_{k}") for k in changed})
    return out.select(*[x for x in specs.columns if x != "improvement"], "improvement")


def _count_named(before: Column, after: Column, fields: Column) -> Column:
    """How many phrases of guardrails have been named; one that holds two phrases counts for both."""
    pairs = F.arrays_zip(before.alias("a"), after.alias("b"))
    phrases = lambda x: sum((F.contains(F.lower(x["a"]), F.lit(p)).cast("int") for p in ("validate input", "check input")), F.lit(0))
    asks = lambda x: (F.contains(F.lower(x["a"]), F.lit("require confirmation")) & F.contains(x["b"], F.lit(" before writing: "))).cast("int")
    return F.aggregate(F.filter(pairs, lambda x: x["a"] != x["b"]), F.lit(0), lambda n, x: n + F.greatest(phrases(x) + asks(x), F.lit(1)))


def versions(specs: DataFrame, keys=KEYS, most_rounds: int = MOST_ROUNDS, epsilon: int = EPSILON) -> DataFrame:
    """All versions of each specification: version, the scored specification, improvement (what led to it), note, stop_reason (of the last one; else null).

    Stops, in this order: passed without blockers; a lower score than before; changes below ``epsilon`` twice
    running; ``most_rounds``.  A specification that no agent may be made of (``prompts.refused_reason``) stops as insufficient
    evidence; if that is so from the beginning, its only row has version 0.
    """
    if most_rounds < 1:
        raise ValueError(f"most_rounds must be at least 1, not {most_rounds}")
    c = F.col
    refusal = refused_reason(c("intent"), c("confidence"), c("objects_touched"))
    # what a round hands on: the specification, the score and unknowns of the version before, and how often it has stalled
    running = specs.withColumns({"improvement": F.lit(None).cast("string"), "_before": F.lit(None).cast("int"), "_unknowns": F.lit(None).cast("int"), "_stalls": F.lit(0)})
    rounds = []
    for version in range(1, most_rounds + 1):
        scored = score_spec(running).withColumn("_refused", refusal)
        delta = c("total") - c("_before")
        stalls = F.when(F.abs(delta) < epsilon, c("_stalls") + 1).otherwise(0)
        reason = (
            F.when(c("_refused").isNotNull(), "insufficient evidence")
            .when(c("passed"), "passed")
            .when(delta < 0, "regression")
            .when(stalls >= STALLS, "converged")
            .when(F.lit(version == most_rounds), "max_rounds")
        )
        dropped = (delta > 0) & (F.size("unknowns") < c("_unknowns"))
        stepped = scored.withColumns({"version": F.lit(version), "_stalls": stalls, "stop_reason": reason, "note": F.when(dropped, UNKNOWNS_DROPPED)})
        # written, so that the next round neither repeats this one nor carries its plan
        stepped = cut(stepped)
        rounds.append(stepped)
        if version == most_rounds:
            break
        left = stepped.filter("stop_reason is null")
        if not left.limit(1).count():
            break
        state = left.select(*specs.columns, c("total").alias("_before"), F.size("unknowns").alias("_unknowns"), "_stalls")
        running = offline_improve(state)
    out = reduce(DataFrame.unionByName, rounds)
    return out.withColumn("version", F.when(c("_refused").isNotNull(), c("version") - 1).otherwise(c("version"))).drop("_before", "_unknowns", "_stalls")


def refine(specs: DataFrame, keys=KEYS, most_rounds: int = MOST_ROUNDS, epsilon: int = EPSILON) -> DataFrame:
    """The best version of each specification, with rounds_run, converged, stop_reason and regressions.

    Without blockers goes before the score, then the earlier version; one that is refused from the beginning has version 0.
    regressions: the dimensions in which the last version is below the first.
    """
    c = F.col
    all_ = versions(specs, keys, most_rounds, epsilon)
    told = Window.partitionBy(*keys)
    worst = lambda d: F.when(F.max_by(d, "version").over(told) < F.min_by(d, "version").over(told), F.lit(d))
    marked = all_.withColumns(
        {
            "rounds_run": F.count_if(c("_refused").isNull()).over(told).cast("int"),
            "_reason": F.max("stop_reason").over(told),
            "regressions": F.filter(F.array(*[worst(d) for d in POINTS]), lambda x: x.isNotNull()),
            "_blocked": (F.size("blockers") > 0) | c("_refused").isNotNull(),
            # a refused version is no candidate beside one that is not
            "_score": F.when(c("_refused").isNull(), c("total")).otherwise(-1),
        }
    )
    best = pick_best(marked, keys, "version", "_score", "_blocked")
    return best.withColumn("stop_reason", c("_reason")).withColumn("converged", c("_reason") == "converged").drop("_reason", "_blocked", "_score", "_refused")
