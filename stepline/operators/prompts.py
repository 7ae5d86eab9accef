"""What an agent is told, made of its specification: role, topic, instructions, utterances to try it with.

Expressions within a row of a specification (see ``specs``); only ``utterances`` makes rows.
Nothing is made up: what was not observed is marked as such, or refused.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepline.functions.naming import topic_api_name
from stepline.functions.values import let

KEYS = ["capture_id"]
LEAST_CONFIDENCE = 0.4
MOST_COLLECTED = 5
#: Sentences and marks of what is told.
UNRESOLVED = "UNRESOLVED:"
NO_ROLE = "[NEEDS EVIDENCE: role could not be derived — intent is unresolved]"
NO_TOPIC = "[NEEDS EVIDENCE: topic could not be derived — intent is unresolved]"
NO_TOPIC_NAME = "Unresolved_Topic"
NO_INTENT = "[NEEDS EVIDENCE: no intent observed]"
NO_STEPS = ("[NEEDS EVIDENCE: No orchestration steps observed in the recording.]", "Add instructions for how to process this request.")
NOT_OBSERVED = "[NEEDS EVIDENCE: The following was not observed in the recording:]"
CONFIRM = "Confirm before writing, and report the result."
ROLE = ("You are an agent that ", ". You work with ", " and help users complete this process conversationally.")
#: Blockers whose full message names guardrails.
GUARDRAIL_BLOCKERS = ("padding", "no guardrail", "filler", "names nothing observed", "near-duplicate guardrails")
CLAUSES = {
    "guardrail": "enforce field-level security and require user confirmation before writes",
    "failure": "surface errors clearly and never auto-correct user input",
    "vague": "be precise about which fields and objects you act on",
    "steps": "clearly describe the step-by-step orchestration",
}


def _lines(*parts: Column) -> Column:
    return F.array_join(F.flatten(F.array(*parts)), "\n")


def _section(title: str, lines: Column, mark: str, show: Column | None = None) -> Column:
    """A title and its lines; nothing where there are none."""
    shown = F.concat(F.array(F.lit(title)), F.transform(lines, lambda s: F.concat(F.lit(mark), s)))
    some = F.size(lines) > 0
    return F.when(some if show is None else some & show, shown).otherwise(F.array().cast("array<string>"))


def refused_reason(intent: Column, confidence: Column, objects: Column) -> Column:
    """Why no agent is made of the specification; null if one may be."""
    reasons = F.array(
        F.when(intent.startswith(UNRESOLVED), F.lit("intent unresolved")),
        F.when(F.coalesce(confidence, F.lit(0.0)) < LEAST_CONFIDENCE, F.lit("confidence too low")),
        F.when(F.coalesce(F.size(objects), F.lit(0)) <= 0, F.lit("no object")),
    )
    return F.nullif(F.array_join(reasons, ", "), F.lit(""))


def role_text(intent: Column, entities: Column) -> Column:
    """The intent, what to collect (of the first fields, each once and sorted), and to confirm."""
    named = F.transform(F.filter(entities, lambda e: F.coalesce(e["field_api_name"], F.lit("")) != ""), lambda e: e["name"])
    collected = F.array_sort(F.array_distinct(F.slice(named, 1, MOST_COLLECTED)))
    collect = F.when(F.size(collected) > 0, F.concat(F.lit("Collect: "), F.array_join(collected, ", "), F.lit(".")))
    return F.when(intent.startswith(UNRESOLVED), NO_ROLE).otherwise(F.concat_ws(" ", intent, collect, F.lit(CONFIRM)))


def topic_name(intent: Column) -> Column:
    return let(topic_api_name(intent), lambda name: F.when(name == "", NO_TOPIC_NAME).otherwise(name))


def topic_description(intent: Column, steps: Column, rails: Column, failures: Column) -> Column:
    """One topic for one recorded process: steps, guardrails, and failures where some were observed."""
    observed = ~F.get(failures, F.lit(0)).startswith("No failures")
    text = _lines(_section("Process:", steps, "- "), _section("\nGuardrails:", rails, "- "), _section("\nError handling:", failures, "- ", observed))
    return F.when(intent.startswith(UNRESOLVED), NO_TOPIC).otherwise(text)


def topic_instructions(entities: Column, steps: Column, rails: Column, failures: Column, unknowns: Column) -> Column:
    """Numbered steps, what is needed, constraints, failures and what was not observed, as lines."""
    numbered = F.concat(F.array(F.lit("Follow these steps:")), F.transform(steps, lambda s, i: F.concat((i + 1).cast("string"), F.lit(". "), s)))
    needed = F.concat(F.lit("Required entities: "), F.array_join(F.transform(entities, lambda e: e["name"]), ", "))
    return _lines(
        F.when(F.size(steps) > 0, numbered).otherwise(F.array(*map(F.lit, NO_STEPS))),
        F.when(F.size(entities) > 0, F.array(needed)).otherwise(F.array().cast("array<string>")),
        _section("\nConstraints:", rails, "  - "),
        _section("\nError handling:", failures, "  - "),
        _section("\n" + NOT_OBSERVED, unknowns, "  - "),
    )


def agent_texts(specs: DataFrame) -> DataFrame:
    """Adds refused_reason, role, topic, topic_description and instructions."""
    c = F.col
    return specs.withColumns(
        {
            "refused_reason": refused_reason(c("intent"), c("confidence"), c("objects_touched")),
            "role": role_text(c("intent"), c("entities")),
            "topic": topic_name(c("intent")),
            "topic_description": topic_description(c("intent"), c("orchestration_steps"), c("guardrails"), c("failure_handling")),
            "instructions": topic_instructions(c("entities"), c("orchestration_steps"), c("guardrails"), c("failure_handling"), c("unknowns")),
        }
    )


# -- utterances -----------------------------------------------------------------------------------


def request_base(intent: Column) -> Column:
    """The intent without what stands in brackets at its end; null if nothing is left."""
    return let(F.trim(F.regexp_replace(intent, r"\s*\([^)]*\)\s*$", "")), lambda text: F.nullif(text, F.lit("")))


def _once(names: Column) -> Column:
    """The first of the names that are equal whatever their case; empty ones go."""
    filled = F.filter(names, lambda n: F.trim(n) != "")
    first = lambda texts, keys: F.filter(texts, lambda n, i: F.array_position(keys, F.get(keys, i)) == i + 1)
    return let(filled, lambda texts: let(F.transform(texts, lambda n: F.lower(F.trim(n))), lambda keys: first(texts, keys)))


def _places(names: Column) -> Column:
    return F.array_join(F.transform(F.filter(names, lambda n: n != "recordId"), lambda n: F.concat(F.lit("{"), n, F.lit("}"))), " ")


def _request(base: Column, names: Column) -> Column:
    return F.trim(F.concat(base, F.lit(" "), _places(names)))


def request_texts(specs: DataFrame) -> DataFrame:
    """Adds _phrase and _invalid (the request, and one with an invalid value) and _omitted (array of entity and utterance: the request without each entity)."""
    text, entities, filled, once = (F.col(c) for c in ("_base", "entities", "_filled", "_names"))
    named = specs.withColumns({"_base": request_base(F.col("intent")), "_filled": F.filter(F.transform(entities, lambda e: e["name"]), lambda n: F.trim(n) != "")})
    named = named.withColumn("_names", _once(filled))
    first = F.get(F.filter(entities, lambda e: F.trim(e["name"]) != ""), F.lit(0))
    field = F.get(F.filter(once, lambda n: n != "recordId"), F.lit(0))
    thing = F.lower(F.coalesce(F.nullif(first["object_api_name"], F.lit("")), F.lit("record")))
    update = F.concat(F.lit("Update the "), field, F.lit(" on "), thing, F.lit(" {recordId} to {"), field, F.lit("}"))
    phrase = F.when(F.array_contains(once, "recordId") & F.contains(F.lower(text), F.lit("update")) & field.isNotNull(), update).otherwise(_request(text, once))
    invalid = F.concat(F.coalesce(text, F.lit(NO_INTENT)), F.when(text.isNotNull() & F.array_contains(filled, "recordId"), F.lit(" {recordId} with an invalid value that will fail validation")).otherwise(" with an invalid value"))
    told = lambda utterance: F.coalesce(utterance, F.lit(NO_INTENT))
    omitted = F.transform(F.filter(entities, lambda e: F.trim(e["name"]) != ""), lambda e: F.struct(e.alias("entity"), told(_request(text, _once(F.filter(filled, lambda m: m != e["name"])))).alias("utterance")))
    return named.withColumns({"_phrase": told(F.when(text.isNotNull(), phrase)), "_invalid": invalid, "_omitted": omitted}).drop("_base", "_filled", "_names")


def utterances(specs: DataFrame, keys=KEYS) -> DataFrame:
    """Rows of case_no, kind, entity and utterance: the request, the request without each entity, one with an invalid value."""
    nobody = F.lit(None).cast("string")
    case = lambda kind, entity, utterance: F.struct(F.lit(kind).alias("kind"), entity.alias("entity"), utterance.alias("utterance"))
    omitted = F.transform("_omitted", lambda o: case("omit", o["entity"]["name"], o["utterance"]))
    cases = F.concat(F.array(case("phrase", nobody, F.col("_phrase"))), omitted, F.array(case("invalid", nobody, F.col("_invalid"))))
    # not exploded as outer, rows would be filtered by the size of the array first, which makes it twice more
    return request_texts(specs).select(*keys, F.posexplode_outer(cases).alias("case_no", "_c")).filter("case_no is not null").select(*keys, "case_no", "_c.*")


# -- refinement -----------------------------------------------------------------------------------


def refined_role(scored: DataFrame) -> DataFrame:
    """Adds ``refined_role``: the role with a clause for each blocker and recommendation that names something to say (see ``specs.score_spec``).

    A clause stands as often as it is called for, blockers' first.
    """
    c = F.col
    thing = F.coalesce(F.get("objects_touched", F.lit(0)), F.lit("business records"))
    base = F.concat(F.lit(ROLE[0]), F.lower("intent"), F.lit(ROLE[1]), thing, F.lit(ROLE[2]))
    holds = lambda text, *words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(F.lower(text), w))
    of_blocker = lambda b: F.array(F.when(b.isin(*GUARDRAIL_BLOCKERS), F.lit(CLAUSES["guardrail"])))
    of_advice = lambda r: F.array(
        F.when(holds(r, "failure", "error"), F.lit(CLAUSES["failure"])),
        F.when(holds(r, "specific", "vague"), F.lit(CLAUSES["vague"])),
        F.when(holds(r, "orchestration"), F.lit(CLAUSES["steps"])),
    )
    told = F.array_join(F.flatten(F.concat(F.transform("blockers", of_blocker), F.transform("recommendations", of_advice))), "; ")
    sentence = F.when(told != "", F.concat(F.lit(" "), F.upper(F.substring(told, 1, 1)), F.lower(F.substring(told, F.lit(2), F.length(told))), F.lit("."))).otherwise("")
    return scored.withColumn("refined_role", F.concat(base, sentence)).select(*scored.columns, c("refined_role"))
