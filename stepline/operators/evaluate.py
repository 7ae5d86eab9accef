"""Evaluation verdicts: cases, outcomes, findings, and what they may change in a specification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS = ["capture_id"]
#: The source of feedback that counts as real, and the highest confidence that feedback leaves.
REAL_SOURCES = ("run-eval",)
CEILING = 0.70
LIVE_EVIDENCE = "live-agent-eval"
NO_CASES = "Stage 5 produced no test-case results, so no claim in this spec has been checked against a live agent."


def parse_results(raw: DataFrame, text: str = "body", keys=KEYS) -> tuple[DataFrame, DataFrame]:
    """Cases and outcomes of evaluation JSON, with or without the ``result`` envelope.

    A verdict is a pass only if it is JSON ``true``, and one that is neither true nor false is none; the
    first output of a kind counts.  A case's topic and utterance are the first ones told; without a topic, it is what the
    topic's assertion has found.
    """
    # a variant keeps the type: the text "true" is no verdict
    evaluation = "struct<type:string,id:string,score:double,is_pass:variant,actual_value:string,expected_value:string,error_message:string>"
    tests = f"array<struct<id:string,status:string,evaluations:array<{evaluation}>,outputs:array<struct<type:string,session_id:string,response:string,topic:string,utterance:string>>>>"
    parsed = raw.select(*keys, F.from_json(text, f"result struct<tests:{tests}>, tests {tests}").alias("_j"))
    cases = parsed.select(*keys, F.posexplode_outer(F.coalesce("_j.result.tests", "_j.tests")).alias("case_no", "_t")).filter("_t is not null")
    first = lambda kind, field: F.get(F.transform(F.filter("_t.outputs", lambda o: (o["type"] == kind) & o[field].isNotNull()), lambda o: o[field]), F.lit(0))
    told = lambda field: F.get(F.transform(F.filter("_t.outputs", lambda o: F.coalesce(o[field], F.lit("")) != ""), lambda o: o[field]), F.lit(0))
    asserted = F.get(F.transform(F.filter("_t.evaluations", lambda e: F.coalesce(e["type"], F.lit("")).contains("topic") & e["actual_value"].isNotNull()), lambda e: e["actual_value"]), F.lit(0))
    flat = cases.select(*keys, "case_no", F.col("_t.id").alias("case_id"), F.col("_t.status").alias("status"), first("session", "session_id").alias("session_id"), first("response", "response").alias("response"), F.coalesce(told("topic"), asserted).alias("topic"), told("utterance").alias("utterance"), "_t")
    outcomes = flat.select(*keys, "case_no", F.posexplode("_t.evaluations").alias("outcome_no", "_e"))
    outcomes = outcomes.select(*keys, "case_no", "outcome_no", F.col("_e.id").alias("evaluator"), F.when(F.schema_of_variant("_e.is_pass") == "BOOLEAN", F.try_variant_get("_e.is_pass", "$", "boolean")).alias("is_pass"), F.col("_e.score").alias("score"), F.col("_e.actual_value").alias("actual"), F.col("_e.expected_value").alias("expected"))
    return flat.drop("_t"), outcomes


def case_passed(outcomes: DataFrame, by: list[str]) -> DataFrame:
    """A case passes if it has outcomes and all of them pass; no verdict is not a pass."""
    n_pass = F.count_if(F.col("is_pass"))
    return outcomes.groupBy(*by).agg(F.count("*").alias("n_outcomes"), n_pass.alias("n_passed"), F.count_if(F.col("is_pass").isNull()).alias("n_no_verdict"), ((F.count("*") > 0) & (n_pass == F.count("*"))).alias("passed"))


def status_rollup(outcomes: DataFrame, keys=KEYS, case: str = "case_id") -> DataFrame:
    """Cases passed of cases, and evaluations passed of evaluations: two grains, two denominators."""
    cases = case_passed(outcomes, [*keys, case])
    return cases.groupBy(*keys).agg(F.count("*").alias("n_cases"), F.count_if("passed").alias("n_cases_passed"), F.sum("n_outcomes").alias("n_evaluations"), F.sum("n_passed").alias("n_evaluations_passed"))


def feedback_is_real(source: Column, n_cases: Column) -> Column:
    """A source that isn't known is not real, nor is feedback without cases."""
    return F.coalesce(source.isin(*REAL_SOURCES), F.lit(False)) & (F.coalesce(n_cases, F.lit(0)) > 0)


def feedback_findings(outcomes: DataFrame) -> DataFrame:
    verdict = F.when(F.col("is_pass").isNull(), "NO VERDICT").when(F.col("is_pass"), "PASS").otherwise("FAIL")
    return outcomes.withColumn("finding", verdict)


def _quoted(text: Column) -> Column:
    """A text in quotes: double ones if it holds a single one and no double one."""
    plain = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    double = F.contains(text, F.lit("'")) & ~F.contains(text, F.lit('"'))
    return F.when(double, F.concat(F.lit('"'), plain, F.lit('"'))).otherwise(F.concat(F.lit("'"), F.replace(plain, F.lit("'"), F.lit("\\'")), F.lit("'")))


def case_results(cases: DataFrame, outcomes: DataFrame, keys=KEYS) -> DataFrame:
    """One row a capture: how many cases there are and have passed, the first that failed, and where a topic was another than expected.

    ``cases``: case_no, case_id.  ``outcomes``: case_no, outcome_no, kind, is_pass, expected, actual.  Outcomes are put together by case,
    cases by capture; of failed cases five ids are kept.
    """
    wrong = ~F.coalesce(F.col("is_pass"), F.lit(False)) & F.contains(F.coalesce("kind", F.lit("")), F.lit("topic")) & (F.coalesce("expected", F.lit("")) != "") & (F.coalesce("actual", F.lit("")) != "")
    of_case = outcomes.groupBy(*keys, "case_no").agg(F.min(F.coalesce("is_pass", F.lit(False))).alias("_all"), F.array_sort(F.collect_list(F.when(wrong, F.struct("outcome_no", "expected", "actual")))).alias("_wrong"))
    joined = cases.select(*keys, "case_no", "case_id").join(of_case, [*keys, "case_no"], "left")
    passed, failed = F.coalesce("_all", F.lit(False)), F.col("_all").isNotNull() & ~F.col("_all")
    gathered = joined.groupBy(*keys).agg(
        F.count("*").alias("n_cases"),
        F.count_if(passed).alias("n_passed"),
        F.count_if(failed).alias("n_live_failures"),
        F.slice(F.array_sort(F.collect_list(F.when(failed, F.struct("case_no", "case_id")))), 1, 5).alias("_failed"),
        F.array_sort(F.collect_list(F.when(F.size("_wrong") > 0, F.struct("case_no", "case_id", "_wrong")))).alias("_routes"),
    )
    mismatches = F.flatten(F.transform("_routes", lambda r: F.transform(r["_wrong"], lambda w: F.struct(r["case_id"].alias("case_id"), w["expected"].alias("expected"), w["actual"].alias("actual")))))
    return gathered.select(*keys, "n_cases", "n_passed", "n_live_failures", F.transform("_failed", lambda f: f["case_id"]).alias("failed_ids"), mismatches.alias("mismatches"))


def apply_feedback(specs: DataFrame, feedback: DataFrame, cases: DataFrame, outcomes: DataFrame, keys=KEYS) -> DataFrame:
    """The specifications with what their cases have shown, as added observations, and ``notes`` of what was added.

    ``feedback``: source, subject_name and org_alias of each capture's run.  Without cases, or from a source that is not real, the only
    addition is an unknown.  Nothing is taken away and confidence never rises; a specification whose confidence is
    above the ceiling is left as it is, with ``refused``.
    """
    c = F.col
    none = F.array().cast("array<string>")
    joined = specs.join(feedback.select(*keys, F.col("source").alias("_source"), F.col("subject_name").alias("_subject"), F.col("org_alias").alias("_org")), keys, "left").join(case_results(cases, outcomes, keys), keys, "left")
    subject = F.coalesce("_subject", F.lit("(unnamed agent)"))
    n, passed, failures = (F.coalesce(c(x), F.lit(0)) for x in ("n_cases", "n_passed", "n_live_failures"))
    real = feedback_is_real(c("_source"), n)
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    only = lambda condition, value: F.when(condition, F.array(value)).otherwise(none)
    routes = F.coalesce("mismatches", F.array().cast("array<struct<case_id:string,expected:string,actual:string>>"))
    routed = F.transform(routes, lambda m: text("Live agent ", subject, " routed ", m["case_id"], " to topic ", _quoted(m["actual"]), ", not the derived ", _quoted(m["expected"]), ". Either the derived topic does not exist on this agent, or this agent is not the right subject for the recorded process. Unresolved."))
    actual = F.transform(routes, lambda m: m["actual"])
    targets = F.filter(routes, lambda m, i: F.array_position(actual, m["actual"]) == i + 1)
    observed = F.transform(targets, lambda m: text("[observed routing] Live agent ", subject, " routed to topic ", _quoted(m["actual"]), " (derived spec expected ", _quoted(m["expected"]), "). This is the routing target the live agent actually selected; update the spec's intent or topic name to match if this agent is the correct subject."))
    ran = text("Ran ", n, " emitted test case(s) against live agent ", subject, " in org ", F.coalesce(F.nullif(c("_org"), F.lit("")), F.lit("(unspecified)")), " via sf agent test run-eval (legacy dialect): ", passed, " passed, ", n - passed, " failed.")
    all_passed = text("All ", passed, " emitted test case(s) passed against live agent ", subject, ".")
    more = F.when(failures > 5, text(" (+", failures - 5, " more)")).otherwise("")
    failed = text("Observed live-agent failure during stage-5 evaluation against ", subject, ": ", failures, " of ", n, " case(s) did not meet the derived expectation (", F.array_join("failed_ids", ", "), more, ").")
    entry = lambda detail: F.struct(F.lit(LIVE_EVIDENCE).alias("source"), detail.alias("detail"))
    no_entry = F.array().cast("array<struct<source:string,detail:string>>")
    evidence = F.concat(F.array(entry(ran)), F.when((passed > 0) & (passed == n), F.array(entry(all_passed))).otherwise(no_entry))
    refused = real & (c("confidence") > CEILING)
    unknown = F.when(n == 0, F.array(F.lit(NO_CASES))).when(~real, F.array(text("Stage 5 feedback for ", subject, " came from source ", _quoted(F.coalesce("_source", F.lit("None"))), ", which is not a live org. This spec remains UNVALIDATED against any real agent."))).otherwise(routed)
    notes = (
        F.when(n == 0, F.array(F.lit("no cases in feedback; recorded as an unknown")))
        .when(~real, F.array(text("synthetic feedback (", F.coalesce("_source", F.lit("None")), ") recorded as unvalidated")))
        .otherwise(
            F.concat(
                F.array(text("recorded live-eval evidence: ", passed, " passed / ", n - passed, " failed against ", subject)),
                only(F.size(routes) > 0, text("recorded ", F.size(routes), " topic mismatch(es) as unknowns")),
                only(F.size(targets) > 0, text("appended ", F.size(targets), " observed routing target(s) to orchestration_steps")),
                only(failures > 0, text("recorded ", failures, " live failure(s) in failure_handling")),
            )
        )
    )
    kept = lambda old, new, empty: F.when(refused, F.coalesce(old, empty)).otherwise(F.concat(F.coalesce(old, empty), new))
    out = joined.withColumns(
        {
            "unknowns": kept(c("unknowns"), unknown, none),
            "evidence": kept(c("evidence"), F.when(real, evidence).otherwise(no_entry), no_entry),
            "orchestration_steps": kept(c("orchestration_steps"), F.when(real, observed).otherwise(none), none),
            "failure_handling": kept(c("failure_handling"), only(real & (failures > 0), failed), none),
            "notes": F.when(refused, none).otherwise(notes),
            "refused": F.when(refused, f"confidence is above {CEILING}"),
        }
    )
    return out.select(*specs.columns, "notes", "refused")


def eval_round(rounds: DataFrame, keys=KEYS, order: str = "version", score: str = "score", passed: str = "passed") -> DataFrame:
    """Each round's score before and after, a note where it rose on a failing round, and whether it can be trusted."""
    w = Window.partitionBy(*keys).orderBy(order)
    before = F.lag(score).over(w)
    rose = F.coalesce(F.col(score) > before, F.lit(False))
    return rounds.withColumn("before", before).withColumn("rose_on_failure", rose & ~F.col(passed)).withColumn("trustworthy", F.col(passed) | ~rose)


def name_integrity(references: DataFrame, names: DataFrame, ref: str, name: str, keys=KEYS) -> DataFrame:
    """References to names that are not there."""
    return references.join(names.select(*keys, F.col(name).alias(ref)).distinct(), [*keys, ref], "left_anti")
