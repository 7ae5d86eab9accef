"""Test cases derived from specifications, in two shapes.

A case stands for something that was observed: the process itself, each resolved entity when it is left out, a
guardrail, a failure.  What was not observed is told as a gap and gets no case.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepline.operators.prompts import request_texts, topic_name

KEYS = ["capture_id"]
LEGACY, SCORED = "legacy", "scored"
#: Sentences of cases, and what measures them.
WEATHER = "What is the weather today?"
OUTCOMES = {"confirmation": "Requests explicit user confirmation before writing.", "scope": "Refuses the request as out of scope."}
EVIDENCE = {
    LEGACY: {"entity": " observed in data delta.", "confirmation": "Guardrail: 'Require explicit user confirmation before writing' observed in spec.", "scope": "Guardrail: 'Scope the agent to the objects listed' observed in spec."},
    SCORED: {"entity": " observed.", "confirmation": "Guardrail observed in spec.", "scope": "Scope guardrail observed in spec."},
}
GAPS = {
    LEGACY: {"happy": "expectedActions left empty: action API names were not observed. Re-run with action telemetry enabled or manually fill from deployed agent metadata.", "failure": "No failure test cases emitted. Record a failing run to observe validation/permission/async errors."},
    SCORED: {"happy": "action_sequence_match scorer omitted: action API names were not observed.", "failure": "No failure test cases emitted. Record a failing run to observe errors."},
}
UNTESTED = ("(no failure case generated)", "failure path gap", "spec.failure_handling indicates error paths are UNTESTED.")
METRICS = ("coherence", "completeness", "conciseness", "output_latency_milliseconds")


def derive_cases(specs: DataFrame, shape: str = LEGACY, keys=KEYS) -> DataFrame:
    """Rows of case_no, purpose, utterance, topic, outcome, evidence and gap.  A row without an outcome is a gap alone."""
    c, none = F.col, F.lit(None).cast("string")

    def case(purpose, utterance, topic, outcome, evidence, gap=none):
        named = {"purpose": purpose, "utterance": utterance, "topic": topic, "outcome": outcome, "evidence": evidence, "gap": gap}
        return F.struct(*[(F.lit(v) if isinstance(v, str) else v).cast("string").alias(k) for k, v in named.items()])

    topic, said = c("_topic"), EVIDENCE[shape]
    named = lambda e, field: F.coalesce(e[field], F.lit("")) != ""
    resolved = F.filter("_omitted", lambda o: named(o["entity"], "object_api_name") & named(o["entity"], "field_api_name"))
    of_entity = lambda o: case("entity collection", o["utterance"], topic, F.concat(F.lit("Asks the user to provide the "), o["entity"]["name"], F.lit(".")), F.concat(F.lit("Entity "), o["entity"]["name"], F.lit(" ("), o["entity"]["object_api_name"], F.lit("."), o["entity"]["field_api_name"], F.lit(")" + said["entity"])))
    holds = lambda word: F.exists("guardrails", lambda g: F.contains(F.lower(g), F.lit(word)))
    seen = F.filter("failure_handling", lambda f: F.contains(F.lower(f), F.lit("failure during recording")))
    layer = lambda f: F.lower(F.coalesce(F.nullif(F.regexp_extract(f, r"(?i)Observed\s+(\w+)\s+failure", 1), F.lit("")), F.lit("unknown")))
    of_failure = lambda f: case(F.concat(F.lit("failure path: "), layer(f), F.lit(" error")), c("_invalid"), topic, F.concat(F.lit("Returns the "), layer(f), F.lit(" error message without retrying.")), f)
    untested = F.exists("failure_handling", lambda f: F.contains(f, F.lit("UNTESTED")))
    gap = F.array(case(UNTESTED[1], UNTESTED[0], none, none, UNTESTED[2], GAPS[shape]["failure"]))
    done = F.concat(F.lit("Confirms the "), F.lower("intent"), F.lit(" completed successfully."))
    cases = F.concat(
        F.array(case("happy path", c("_phrase"), topic, done, F.concat(F.lit("Derived from intent: "), "intent"), GAPS[shape]["happy"])),
        F.transform(resolved, of_entity),
        F.array(
            F.when(holds("confirmation"), case("guardrail: confirmation-before-write", c("_phrase"), topic, OUTCOMES["confirmation"], said["confirmation"])),
            F.when(holds("scope"), case("guardrail: scope", WEATHER, none, OUTCOMES["scope"], said["scope"])),
        ),
        F.when(F.coalesce(untested, F.lit(False)), gap).otherwise(F.transform(seen, of_failure)),
    )
    # not exploded as outer, rows would be filtered by the size of the array first, which makes it twice more
    named = request_texts(specs).withColumn("_topic", topic_name(c("intent")))
    made = named.select(*keys, F.posexplode_outer(F.filter(cases, lambda x: x.isNotNull())).alias("case_no", "_c"))
    return made.filter("case_no is not null").select(*keys, "case_no", "_c.*")


def legacy_tests(cases: DataFrame, keys=KEYS) -> DataFrame:
    """(keys, case_no, test) of the cases: utterance, expectedTopic, expectedActions, expectedOutcome and metrics.  Actions are never made up."""
    test = F.struct("utterance", F.col("topic").alias("expectedTopic"), F.array().cast("array<string>").alias("expectedActions"), F.col("outcome").alias("expectedOutcome"), F.array(*map(F.lit, METRICS)).alias("metrics"))
    return cases.filter("outcome is not null").select(*keys, "case_no", test.alias("test"))


def scored_tests(cases: DataFrame, keys=KEYS) -> DataFrame:
    """(keys, case_no, test) of the cases: inputs, and scorers with what they expect."""
    scorer = lambda name, expected: F.struct(F.lit(name).alias("name"), expected.cast("string").alias("expected"))
    happy, none = F.col("purpose") == "happy path", F.lit(None)
    scorers = F.array(
        F.when(F.col("topic").isNotNull(), scorer("topic_sequence_match", F.col("topic"))),
        scorer("bot_response_rating", F.col("outcome")),
        F.when(happy, scorer("completeness", none)),
        F.when(happy, scorer("coherence", none)),
    )
    test = F.struct(F.array(F.struct("utterance")).alias("inputs"), F.filter(scorers, lambda x: x.isNotNull()).alias("scorers"))
    return cases.filter("outcome is not null").select(*keys, "case_no", test.alias("test"))
