"""Queries of scores, refinement and test cases of specifications, with SQL.

Orders stand for drafts of specifications.  Each part of a draft is a good one, or, where the order's key
leaves a certain rest, one of the ways in which it can be bad; so bands, blockers, improvements and reasons to stop
all occur, alone and together.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from stepline.operators import cases, evaluate, prompts, refinement, score, specs
from stepline.plans.bindings import read
from stepline.plans.trace_queries import query
from stepline.sources.shared import spread


class Spark:
    null = "CAST(NULL AS STRING)"
    text = staticmethod(lambda x: f"CAST({x} AS STRING)")
    array = staticmethod(lambda *x: f"array({', '.join(x)})" if x else "CAST(array() AS ARRAY<STRING>)")
    struct = staticmethod(lambda **x: "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in x.items()) + ")")
    none = "CAST(array() AS ARRAY<STRUCT<name: STRING, object_api_name: STRING, field_api_name: STRING, evidence: ARRAY<STRUCT<source: STRING, detail: STRING>>>>)"
    no_trail = "CAST(array() AS ARRAY<STRUCT<source: STRING, detail: STRING>>)"


class Duck:
    null = "CAST(NULL AS VARCHAR)"
    text = staticmethod(lambda x: f"CAST({x} AS VARCHAR)")
    array = staticmethod(lambda *x: f"[{', '.join(x)}]" if x else "CAST([] AS VARCHAR[])")
    struct = staticmethod(lambda **x: "{" + ", ".join(f"'{k}': {v}" for k, v in x.items()) + "}")
    none = "CAST([] AS STRUCT(name VARCHAR, object_api_name VARCHAR, field_api_name VARCHAR, evidence STRUCT(source VARCHAR, detail VARCHAR)[])[])"
    no_trail = "CAST([] AS STRUCT(source VARCHAR, detail VARCHAR)[])"


def draft(d) -> str:
    """The SELECT that makes drafts of orders, in the words of either engine."""
    quoted = lambda *texts: d.array(*[f"'{t}'" for t in texts])
    told = lambda source, detail: d.array(d.struct(source=f"'{source}'", detail=f"concat('{detail} ', {d.text('o_orderkey')})"))

    def entity(name, thing, field, source, detail):
        named = lambda x: f"'{x}'" if x else d.null
        return d.struct(name=f"'{name}'", object_api_name=named(thing), field_api_name=named(field), evidence=told(source, detail))

    record = entity("recordId", "Case", "Id", "inference", "a Case record must be identified")
    status, priority = ("Case", "Status", "data-delta", "Case.Status changed in order"), ("Case", "Priority", "ui-action", "input on input:Priority in order")
    stub = d.struct(name="'origin'", object_api_name="'Case'", field_api_name="'Origin'", evidence=d.array(d.struct(source="'data-delta'", detail="'x'")))

    def by(rest, good, *bad):
        return f"CASE o_orderkey % {rest} " + " ".join(f"WHEN {k} THEN {b}" for k, b in enumerate(bad)) + f" ELSE {good} END"

    intents = ["UNRESOLVED: nothing was seen", "  ", "Complete a data-entry process", "Do something vague", "Update various Case Status fields as needed and possibly more", "Some Case Status", "Update Case UNRESOLVED: Status"]
    steps = [
        (),
        ("Step 1", "Action 2"),
        ("Load the target Case record", "load  the TARGET Case record", "Write Status of the Case"),
        ("Resolve the Case Status now", "Resolve the Case Status here"),
        [f"Resolve the Case {k}" for k in range(10)],
        ["Resolve the Case again"] * 7,
        ("aa", "bb", "cc dd"),
        ("Fill the generic placeholder of the Case", "Write Status of the Case record"),
        ("do the whole thing as it was", "then go back to the start"),
    ]
    rails = [
        (),
        ("Enforce field-level security on Case Status", "enforce field-level  security on case status"),
        ("Validate input before saving Case Status", "Scope the agent to the Case object"),
        ("Require confirmation of the user...", "Always check input of the Case first", "Check input and require confirmation of it"),
        ("Please handle Status input safely", "Please handle Status input safely."),
        ("Guardrail 1", "Rule"),
        [f"Enforce security on Case {k}" for k in range(9)],
        ("TODO write a guardrail about Status",),
        ("always be careful with it all",),
    ]
    unresolved = [entity(f"n{k}", None, None, "ui-action", "input on the same thing in order") for k in range(7)]
    return f"""SELECT o_orderkey AS capture_id, {by(16, "'Update Case status and priority'", *[f"'{x}'" for x in intents], d.null)} AS intent,
  CASE o_orderkey % 5 WHEN 0 THEN 0.95 WHEN 1 THEN 0.5 ELSE 0.7 END - CASE WHEN o_orderkey % 29 = 3 THEN 0.4 ELSE 0.0 END AS confidence,
  {by(13, quoted("Case"), d.array())} AS objects_touched,
  {by(8, d.array(entity("status", *status), entity("priority", *priority), record), d.array(*[entity(f"n{k}", *status) for k in range(5)]), d.array(stub, record), d.array(*unresolved), d.none, d.array(record), d.array(entity("Status", *status), entity("PRiority", *priority), stub), d.array(entity("status", "Case", "Status", "ui-action", "input on input:Status in order"), record))} AS entities,
  {by(27, quoted("Resolve and load the target Case record", "input on input:Status -> writes Status (backend: data)", "Return a confirmation that names the record"), *[quoted(*s) for s in steps])} AS orchestration_steps,
  {by(25, quoted("Enforce field-level security on Case for the user", "Require explicit user confirmation before writing: Status"), *[quoted(*r) for r in rails])} AS guardrails,
  {by(7, quoted("Observed validation failure during recording: bad value"), quoted(specs.UNTESTED), d.array())} AS failure_handling,
  {by(4, d.array(), quoted("who may do it"))} AS unknowns,
  {by(31, told("extraction", "3 action(s) in recording, order"), d.no_trail)} AS evidence,
  {by(9, "'dom-capture'", d.null, "'synthetic'")} AS extraction_source, {by(9, "'live-org'", d.null)} AS telemetry_source
FROM {{orders}}"""


def drafts(spark, d):
    # a draft is made of the key alone, and what is done with it costs far more than reading it
    return spark.sql(draft(Spark), orders=spread(read(spark, d, "orders").select("o_orderkey")))


# -- SQL of the score ---------------------------------------------------------------------------

_listed = lambda texts: "[" + ", ".join("'" + t.replace("'", "''") + "'" for t in texts) + "]"
_norm = lambda s: rf"trim(regexp_replace(lower({s}), '\s+', ' ', 'g'))"
_bare = lambda s: f"array_to_string([w FOR w IN regexp_split_to_array(lower({s}), '[^0-9a-z]+') IF w <> '' AND NOT regexp_full_match(w, '[0-9]+')], ' ')"
_signed = lambda s: f"list_sort(list_distinct([w FOR w IN regexp_split_to_array(lower({s}), '[^a-z0-9]+') IF w <> '' AND NOT list_contains({_listed(score.STOPWORDS)}, w)]))"
_any = lambda text, terms: f"len([m FOR m IN {_listed(terms)} IF contains({text}, m)]) > 0"


def _lists_sql(c: str) -> str:
    """Of a list of lines: how many differ, how many with numbers left out, whether padded, whether said twice."""
    return f"""len(list_distinct([{_norm("s")} FOR s IN {c} IF {_norm("s")} <> ''])) AS n_{c}, len(list_distinct([{_bare("s")} FOR s IN {c} IF {_bare("s")} <> ''])) AS b_{c},
  [x FOR x IN [{_signed("s")} FOR s IN list_distinct([trim(s) FOR s IN {c}])] IF len(x) >= 2] AS g_{c}"""


def score_sql(source: str, out: str) -> str:
    """CTEs from drafts in ``source`` to ``out``, which has dimensions, total, blockers, passed, band, display and recommendations beside them."""
    fill = lambda s: rf"(length(trim({s})) < 12 OR len(regexp_split_to_array(trim({s}), '\s+')) < 3)"
    named = "(coalesce(e.object_api_name, '') <> '' OR coalesce(e.field_api_name, '') <> '')"
    has = lambda kind: f"len([v FOR v IN e.evidence IF v.source = '{kind}' AND length(trim(v.detail)) >= 12]) > 0"
    pads = lambda c: f"((len({c}) > 5 AND len({c}) / greatest(n_{c}, 1) > 3) OR (len({c}) > 8 AND len({c}) / greatest(b_{c}, 1) > 3))"
    hollow = "\n".join(f", CASE WHEN {d} <= {p * 0.1} THEN 'hollow {d}' END" for d, p in specs.POINTS.items() if d not in ("testability", "provenance"))
    weak = " + ".join(f"({d} <= {p * 0.5})::INT" for d, p in specs.POINTS.items() if d != "provenance")
    return f"""{out}_a AS (SELECT *, [e FOR e IN entities IF NOT (e.name = 'recordId' AND coalesce(e.field_api_name, '') = 'Id')] AS seen, list_concat(orchestration_steps, guardrails) AS lines,
  {_lists_sql("orchestration_steps")}, {_lists_sql("guardrails")}, coalesce(trim(intent), '') = '' AS blank,
  len([f FOR f IN failure_handling IF contains(f, 'Observed ') AND contains(f, ' failure during recording:')]) > 0 AS failed,
  concat_ws(chr(10), intent, array_to_string(list_concat(orchestration_steps, guardrails, failure_handling, unknowns, objects_touched), chr(10)), CAST(entities AS VARCHAR), CAST(evidence AS VARCHAR)) AS told FROM {source}),
{out}_b AS (SELECT *, len([e FOR e IN seen IF {has("data-delta")}]) AS n_delta, len([e FOR e IN seen IF NOT {has("data-delta")} AND {has("ui-action")}]) AS n_ui,
  [coalesce(e.object_api_name, '?') || '.' || coalesce(e.field_api_name, '?') FOR e IN seen IF {named}] AS claims, [e FOR e IN seen IF NOT {named}] AS vain,
  {_any("told", score.MARKERS)} OR (blank AND len(entities) + len(lines) + len(failure_handling) = 0) AS marked, len([s FOR s IN lines IF {fill("s")}]) AS n_fill,
  [lower(x) FOR x IN list_concat([e.field_api_name FOR e IN entities IF e.field_api_name <> 'Id'], [e.name FOR e IN entities IF e.name <> 'recordId']) IF length(x) >= 4] AS names,
  extraction_source = ANY({_listed(score.REAL_EXTRACTION)}) AND telemetry_source = ANY({_listed(score.REAL_TELEMETRY)}) AS real FROM {out}_a),
{out}_c AS (SELECT *, coalesce(list_max(map_values(list_histogram(claims))), 0) > 3 OR (len(vain) > 3 AND len(list_distinct(flatten([[v.detail FOR v IN e.evidence] FOR e IN vain]))) * 3 < len(flatten([[v.detail FOR v IN e.evidence] FOR e IN vain]))) AS heaped,
  len(objects_touched) = 0 OR len(entities) = 0 AS gaps FROM {out}_b),
{out}_d AS (SELECT *,
  CASE WHEN len(seen) = 0 THEN 0 ELSE floor(floor((CASE WHEN n_delta > 0 THEN 0.5 WHEN n_ui > 0 THEN 0.35 ELSE 0 END + least((n_delta + n_ui) * 0.25, 0.5)) * 30) * CASE WHEN heaped THEN 0.2 ELSE 1 END) END::INT AS grounding,
  CASE WHEN len(objects_touched) > 0 THEN 3 ELSE 0 END + CASE WHEN len(entities) > 0 THEN 3 ELSE 0 END + CASE WHEN n_orchestration_steps > 1 AND NOT {pads("orchestration_steps")} THEN 3 ELSE 0 END
    + CASE WHEN n_guardrails = 0 OR {pads("guardrails")} THEN 0 WHEN n_guardrails < len(guardrails) THEN 1 ELSE 3 END + CASE WHEN len(failure_handling) > 0 THEN 3 ELSE 0 END AS completeness,
  CASE WHEN confidence >= 0.7 AND gaps THEN 0 WHEN confidence < 0.7 AND len(unknowns) > 0 THEN 20 WHEN gaps THEN 10 WHEN confidence > 0.7 THEN 20 - least(10, round_even((confidence - 0.7)::DOUBLE / 0.3::DOUBLE * 10, 0)::INT) ELSE 20 END AS honesty,
  CASE WHEN blank THEN 0 ELSE greatest(0, 10 - CASE WHEN contains(intent, 'UNRESOLVED') THEN 3 WHEN intent IN ({_listed(specs.GENERIC_INTENTS)[1:-1]}) THEN 2
    WHEN len(regexp_extract_all(intent, '\\S+')) <= 2 OR {_any("lower(intent)", specs.VAGUE)} OR len(regexp_extract_all(intent, '\\S+')) > 6 THEN 5 ELSE 0 END
    - coalesce(list_sum([CASE WHEN regexp_matches(lower(trim(s)), '^(step|action|task|item)(\\s+\\d+)?$') THEN 3 WHEN {_any("lower(s)", specs.GENERIC_STEP_TERMS)} THEN 1 ELSE 0 END FOR s IN orchestration_steps]), 0)
    - coalesce(list_sum([CASE WHEN regexp_matches(lower(trim(s)), '^(guardrail|rule|check|validation)(\\s+\\d+)?$') THEN 3 WHEN {_any("lower(s)", specs.GENERIC_GUARDRAILS)} THEN 2 ELSE 0 END FOR s IN guardrails]), 0) - 2 * n_fill) END::INT AS specificity,
  CASE WHEN len([e FOR e IN entities IF {named}]) > 0 THEN 5 ELSE 0 END + CASE WHEN failed THEN 5 ELSE 0 END AS testability,
  CASE WHEN marked THEN 0 ELSE 10 END AS placeholders, CASE WHEN coalesce(real, false) THEN 5 ELSE 0 END AS provenance FROM {out}_c),
{out}_e AS (SELECT *, ({" + ".join(specs.POINTS)})::INT AS total, [x FOR x IN [CASE WHEN heaped THEN 'padded entities' END, CASE WHEN {pads("orchestration_steps")} OR {pads("guardrails")} THEN 'padding' END,
  CASE WHEN len(objects_touched) = 0 THEN 'no object' END, CASE WHEN len(entities) = 0 THEN 'no entity' END, CASE WHEN len(guardrails) = 0 THEN 'no guardrail' END, CASE WHEN starts_with(intent, 'UNRESOLVED:') THEN 'unresolved' END,
  CASE WHEN marked THEN 'placeholder' END, CASE WHEN coalesce(extraction_source, telemetry_source) IS NOT NULL AND NOT coalesce(real, false) THEN 'provenance' END, CASE WHEN n_fill > 0.4 * len(lines) THEN 'filler' END, CASE WHEN {weak} >= 2 THEN 'threshold surfing' END,
  CASE WHEN coalesce(len(evidence), 0) = 0 THEN 'empty trail' END, CASE WHEN len(names) > 0 AND len([n FOR n IN names IF contains(lower(array_to_string(lines, ' ')), n)]) = 0 THEN 'names nothing observed' END,
  CASE WHEN len(list_distinct(g_orchestration_steps)) < len(g_orchestration_steps) THEN 'near-duplicate steps' END, CASE WHEN len(list_distinct(g_guardrails)) < len(g_guardrails) THEN 'near-duplicate guardrails' END
  {hollow}] IF x IS NOT NULL] AS blockers,
  [x FOR x IN [CASE WHEN grounding < 15 THEN '{specs.ADVICE["grounding"]}' END, CASE WHEN len(objects_touched) = 0 THEN '{specs.ADVICE["object"]}' END, CASE WHEN starts_with(intent, 'UNRESOLVED:') THEN '{specs.ADVICE["intent"]}' END, CASE WHEN NOT failed THEN '{specs.ADVICE["failure"]}' END] IF x IS NOT NULL] AS recommendations FROM {out}_d),
{out} AS (SELECT *, total >= 75 AND len(blockers) = 0 AS passed, CASE WHEN len(blockers) > 0 THEN 'low' WHEN total >= 75 THEN 'high' WHEN total >= 60 THEN 'moderate' ELSE 'low' END AS band,
  CASE WHEN len(blockers) > 0 THEN least(total, 59) ELSE total END AS display FROM {out}_e)"""


DRAFTS = "WITH d1 AS (" + draft(Duck).replace("{orders}", "orders") + "),\n"
SCORE = ", ".join(specs.POINTS)


@query(DRAFTS + score_sql("d1", "s") + f"SELECT capture_id, {SCORE}, total, array_to_string(blockers, ',') AS blockers, passed, band, display, array_to_string(recommendations, '|') AS recommendations FROM s")
def score_spec(spark, d):
    scored = specs.score_spec(drafts(spark, d))
    return scored.select("capture_id", *specs.POINTS, "total", F.array_join("blockers", ",").alias("blockers"), "passed", "band", "display", F.array_join("recommendations", "|").alias("recommendations"))


# -- SQL of the refinement ----------------------------------------------------------------------


def improve_sql(source: str, out: str) -> str:
    once = lambda c: f"[{c}[i] FOR i IN range(1, len({c}) + 1) IF list_position([{_norm('s')} FOR s IN {c}], {_norm(f'{c}[i]')}) = i]"
    plain = "intent"
    for term in refinement.VAGUE_TERMS:
        plain = f"regexp_replace({plain}, '\\b{term.replace('.', chr(92) + '.')}\\b', '', 'gi')"
    swap = lambda verb: f"replace(replace(r, '{verb.capitalize()} input', '{verb.capitalize()} ' || objects_touched[1] || ' fields'), '{verb} input', '{verb} ' || objects_touched[1] || ' fields')"
    ask = "contains(lower(r), 'require confirmation') AND NOT contains(lower(r), 'before writing') AND fields <> '' AND NOT contains(r, fields)"
    rails = f"""CASE WHEN len(objects_touched) = 0 THEN rails ELSE [CASE WHEN {ask} THEN rtrim(r, '.') || ' before writing: ' || fields || '.' WHEN contains(lower(r), 'check input') THEN {swap("check")} WHEN contains(lower(r), 'validate input') THEN {swap("validate")} ELSE r END FOR r IN rails] END"""
    small = "CASE WHEN regexp_matches(e.name, '^[A-Z][a-z]') THEN lower(e.name[1]) || e.name[2:] ELSE e.name END"
    made = "{'name': " + small + ", 'object_api_name': e.object_api_name, 'field_api_name': e.field_api_name, 'evidence': e.evidence}"
    return f"""{out}_a AS (SELECT *, {once("guardrails")} AS rails, array_to_string([e.field_api_name FOR e IN entities IF coalesce(e.field_api_name, '') <> ''][1:3], ', ') AS fields FROM {source}),
{out} AS (SELECT capture_id, trim(regexp_replace({plain}, '\\s+', ' ', 'g')) AS intent, confidence, objects_touched, CASE WHEN len(entities) = 0 THEN entities ELSE [{made} FOR e IN entities] END AS entities, {once("orchestration_steps")} AS orchestration_steps, {rails} AS guardrails,
  failure_handling, unknowns, evidence, extraction_source, telemetry_source FROM {out}_a)"""


def refine_sql() -> str:
    """Every draft is taken through all rounds; where each would have stopped is told afterwards."""
    out = []
    for k in range(1, refinement.MOST_ROUNDS + 1):
        if k > 1:
            out.append(improve_sql(f"d{k - 1}", f"d{k}"))
        out.append(score_sql(f"d{k}", f"s{k}"))
    rows = " UNION ALL ".join(f"SELECT capture_id, {k} AS version, total, passed, len(blockers) > 0 AS blocked, {SCORE}, coalesce(starts_with(intent, 'UNRESOLVED:'), false) OR coalesce(confidence, 0) < 0.4 OR len(objects_touched) = 0 AS refused FROM s{k}" for k in range(1, refinement.MOST_ROUNDS + 1))
    worse = ", ".join(f"CASE WHEN arg_max({d}, version) < arg_min({d}, version) THEN '{d}' END" for d in specs.POINTS)
    return f"""{DRAFTS}{", ".join(out)},
v AS ({rows}),
m AS (SELECT *, total - lag(total) OVER w AS delta FROM v WINDOW w AS (PARTITION BY capture_id ORDER BY version)),
z AS (SELECT *, CASE WHEN refused THEN 'insufficient evidence' WHEN passed THEN 'passed' WHEN delta < 0 THEN 'regression' WHEN abs(delta) < 2 AND abs(lag(delta) OVER w) < 2 THEN 'converged' WHEN version = 5 THEN 'max_rounds' END AS reason FROM m WINDOW w AS (PARTITION BY capture_id ORDER BY version)),
stop AS (SELECT capture_id, min(version) AS stopped, arg_min(reason, version) AS stop_reason FROM z WHERE reason IS NOT NULL GROUP BY capture_id),
ran AS (SELECT v.*, stop_reason, stopped FROM v JOIN stop USING (capture_id) WHERE version <= stopped),
best AS (SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY refused, blocked, total DESC, version) AS k FROM ran),
all_ AS (SELECT capture_id, count(*) FILTER (NOT refused) AS rounds_run, concat_ws(',', {worse}) AS regressions FROM ran GROUP BY capture_id)
SELECT capture_id, CASE WHEN refused THEN 0 ELSE version END AS version, total, passed, stop_reason, stop_reason = 'converged' AS converged, rounds_run, regressions FROM best JOIN all_ USING (capture_id) WHERE k = 1"""


@query(refine_sql())
def refine(spark, d):
    best = refinement.refine(drafts(spark, d))
    return best.select("capture_id", "version", "total", "passed", "stop_reason", "converged", "rounds_run", F.array_join("regressions", ",").alias("regressions"))


ROLE_SQL = f"""SELECT capture_id, base || CASE WHEN told = '' THEN '' ELSE ' ' || upper(told[1]) || lower(told[2:]) || '.' END AS refined_role FROM (
  SELECT capture_id, '{prompts.ROLE[0]}' || lower(intent) || '{prompts.ROLE[1]}' || coalesce(objects_touched[1], 'business records') || '{prompts.ROLE[2]}' AS base,
    array_to_string(list_concat(['{prompts.CLAUSES["guardrail"]}' FOR b IN blockers IF b IN ({_listed(prompts.GUARDRAIL_BLOCKERS)[1:-1]})], ['{prompts.CLAUSES["failure"]}' FOR r IN recommendations IF contains(r, 'failing variant')]), '; ') AS told FROM s)"""


@query(DRAFTS + score_sql("d1", "s") + ROLE_SQL)
def refined_role(spark, d):
    return prompts.refined_role(specs.score_spec(drafts(spark, d))).select("capture_id", "refined_role")


# -- test cases and what they show ------------------------------------------------------------------

_once = lambda c: f"[{c}[i] FOR i IN range(1, len({c}) + 1) IF list_position([lower(trim(x)) FOR x IN {c}], lower(trim({c}[i]))) = i]"
_asked = lambda names: f"trim(base || ' ' || array_to_string(['{{' || x || '}}' FOR x IN {names} IF x <> 'recordId'], ' '))"
#: Names of the drafts' entities are never blank.
CASES = rf"""c0 AS (SELECT *, nullif(trim(regexp_replace(intent, '\s*\([^)]*\)\s*$', '')), '') AS base, [e.name FOR e IN entities] AS every FROM d1),
c1 AS (SELECT *, {_once("every")} AS once, ['_' || upper(w[1]) || w[2:] FOR w IN regexp_split_to_array(regexp_replace(regexp_replace(coalesce(intent, ''), '^\s*UNRESOLVED:\s*', ''), '[^A-Za-z0-9]+', ' ', 'g'), ' ') IF w <> ''] AS words FROM c0),
c2 AS (SELECT *, CASE WHEN len(words) = 0 THEN 'Unresolved_Topic' ELSE array_to_string(words, '')[2:] END AS topic, [x FOR x IN once IF x <> 'recordId'][1] AS field,
  CASE WHEN base IS NULL THEN '{prompts.NO_INTENT}' ELSE base END || CASE WHEN base IS NOT NULL AND list_contains(every, 'recordId') THEN ' {{recordId}} with an invalid value that will fail validation' ELSE ' with an invalid value' END AS invalid FROM c1),
c3 AS (SELECT *, CASE WHEN base IS NULL THEN '{prompts.NO_INTENT}' WHEN list_contains(once, 'recordId') AND contains(lower(base), 'update') AND field IS NOT NULL THEN 'Update the ' || field || ' on ' || lower(coalesce(nullif(entities[1].object_api_name, ''), 'record')) || ' {{recordId}} to {{' || field || '}}' ELSE {_asked("once")} END AS phrase FROM c2),
omits AS (SELECT *, unnest(entities) AS e, generate_subscripts(entities, 1) AS i FROM c3),
fails AS (SELECT *, unnest(failure_handling) AS f, generate_subscripts(failure_handling, 1) AS i FROM c3),
made AS (
  SELECT capture_id, 0 AS part, 0 AS i, 'happy path' AS purpose, phrase AS utterance, topic, 'Confirms the ' || lower(intent) || ' completed successfully.' AS outcome FROM c3
  UNION ALL SELECT capture_id, 1, i, 'entity collection', CASE WHEN base IS NULL THEN '{prompts.NO_INTENT}' ELSE {_asked(_once("[x FOR x IN every IF x <> e.name]"))} END, topic, 'Asks the user to provide the ' || e.name || '.' FROM omits WHERE coalesce(e.object_api_name, '') <> '' AND coalesce(e.field_api_name, '') <> ''
  UNION ALL SELECT capture_id, 2, 0, 'guardrail: confirmation-before-write', phrase, topic, '{{confirmation}}' FROM c3 WHERE len([g FOR g IN guardrails IF contains(lower(g), 'confirmation')]) > 0
  UNION ALL SELECT capture_id, 3, 0, 'guardrail: scope', 'What is the weather today?', NULL, '{{scope}}' FROM c3 WHERE len([g FOR g IN guardrails IF contains(lower(g), 'scope')]) > 0
  UNION ALL SELECT capture_id, 4, 0, 'failure path gap', '(no failure case generated)', NULL, NULL FROM c3 WHERE len([f FOR f IN failure_handling IF contains(f, 'UNTESTED')]) > 0
  UNION ALL SELECT capture_id, 5, i, 'failure path: ' || lower(regexp_extract(f, 'Observed (\w+) failure', 1)) || ' error', invalid, topic, 'Returns the ' || lower(regexp_extract(f, 'Observed (\w+) failure', 1)) || ' error message without retrying.' FROM fails WHERE contains(lower(f), 'failure during recording') AND len([f FOR f IN failure_handling IF contains(f, 'UNTESTED')]) = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY part, i) - 1 AS case_no FROM made)
""".replace("{confirmation}", cases.OUTCOMES["confirmation"]).replace("{scope}", cases.OUTCOMES["scope"])


@query(DRAFTS + CASES + "SELECT capture_id, case_no, purpose, utterance, topic, outcome FROM k")
def derive_test_cases(spark, d):
    return cases.derive_cases(drafts(spark, d)).select("capture_id", "case_no", "purpose", "utterance", "topic", "outcome")


@query(DRAFTS + CASES + """SELECT capture_id, case_no, concat_ws(';', CASE WHEN topic IS NOT NULL THEN 'topic_sequence_match=' || topic END, 'bot_response_rating' || coalesce('=' || outcome, ''), CASE WHEN purpose = 'happy path' THEN 'completeness;coherence' END) AS scorers
FROM k WHERE outcome IS NOT NULL""")
def scored_test_cases(spark, d):
    made = cases.scored_tests(cases.derive_cases(drafts(spark, d), cases.SCORED))
    shown = F.transform("test.scorers", lambda s: F.concat(s["name"], F.coalesce(F.concat(F.lit("="), s["expected"]), F.lit(""))))
    return made.select("capture_id", "case_no", F.array_join(shown, ";").alias("scorers"))


#: Line items are test cases that were run, their columns what evaluators said: a topic that may be another, and a rating.
FED = f"""r AS (SELECT l_orderkey AS capture_id, l_linenumber AS case_no, 'case ' || l_linenumber AS case_id, l_returnflag = 'N' AS on_topic, CASE WHEN l_linestatus = 'O' THEN l_quantity > 5 END AS rated, 'Topic ' || l_returnflag AS actual FROM (SELECT l_orderkey, l_linenumber, min(l_returnflag) AS l_returnflag, min(l_linestatus) AS l_linestatus, min(l_quantity) AS l_quantity FROM lineitem GROUP BY ALL) WHERE l_orderkey % 10 <> 7 AND l_linenumber <> 7),
src AS (SELECT d1.*, CASE capture_id % 9 WHEN 3 THEN 'injected-runner' WHEN 4 THEN NULL ELSE 'run-eval' END AS source, CASE WHEN capture_id % 5 <> 0 THEN 'Agent''s ' || capture_id % 3 END AS subject_name, CASE WHEN capture_id % 2 = 0 THEN 'org' END AS org_alias FROM d1),
o AS (SELECT capture_id, case_no, case_id, on_topic AND coalesce(rated, false) AS ok, CASE WHEN NOT on_topic THEN actual END AS actual FROM r WHERE case_no <> 6),
n AS (SELECT r.capture_id, count(*) AS n, count(*) FILTER (coalesce(ok, false)) AS p, count(*) FILTER (NOT ok) AS f, list(r.case_id ORDER BY r.case_no) FILTER (NOT ok) AS ids, list(o.case_id ORDER BY r.case_no) FILTER (o.actual IS NOT NULL) AS routed, list(o.actual ORDER BY r.case_no) FILTER (o.actual IS NOT NULL) AS actuals FROM r LEFT JOIN o ON r.capture_id = o.capture_id AND r.case_no = o.case_no GROUP BY 1),
j AS (SELECT src.*, coalesce(n, 0) AS n, coalesce(p, 0) AS p, coalesce(f, 0) AS f, coalesce(ids, []) AS ids, coalesce(routed, []) AS routed, coalesce(actuals, []) AS actuals, coalesce(source = 'run-eval' AND n > 0, false) AS is_real, coalesce(subject_name, '(unnamed agent)') AS subject FROM src LEFT JOIN n USING (capture_id)),
q AS (SELECT *, is_real AND confidence > 0.7 AS stop FROM j)
"""


@query(DRAFTS + FED + f"""SELECT capture_id, confidence::DOUBLE AS confidence, len(unknowns) AS n_before, array_to_string(list_concat(unknowns, CASE WHEN stop THEN [] WHEN n = 0 THEN ['{evaluate.NO_CASES}']
  WHEN NOT is_real THEN ['Stage 5 feedback for ' || subject || ' came from source ' || chr(39) || coalesce(source, 'None') || chr(39) || ', which is not a live org. This spec remains UNVALIDATED against any real agent.']
  ELSE ['Live agent ' || subject || ' routed ' || routed[i] || ' to topic ' || chr(39) || actuals[i] || chr(39) || ', not the derived ''Topic N''. Either the derived topic does not exist on this agent, or this agent is not the right subject for the recorded process. Unresolved.' FOR i IN range(1, len(routed) + 1)] END), '|') AS unknowns,
  array_to_string(list_concat([x.source || ': ' || x.detail FOR x IN evidence], CASE WHEN NOT is_real OR stop THEN [] ELSE ['live-agent-eval: Ran ' || n || ' emitted test case(s) against live agent ' || subject || ' in org ' || coalesce(org_alias, '(unspecified)') || ' via sf agent test run-eval (legacy dialect): ' || p || ' passed, ' || (n - p) || ' failed.'] END,
    CASE WHEN is_real AND NOT stop AND p = n THEN ['live-agent-eval: All ' || p || ' emitted test case(s) passed against live agent ' || subject || '.'] ELSE [] END), '|') AS evidence,
  array_to_string(CASE WHEN NOT is_real OR stop THEN orchestration_steps ELSE list_concat(orchestration_steps, ['[observed routing] Live agent ' || subject || ' routed to topic ' || chr(39) || actuals[i] || chr(39) || ' (derived spec expected ''Topic N''). This is the routing target the live agent actually selected; update the spec''s intent or topic name to match if this agent is the correct subject.' FOR i IN range(1, len(actuals) + 1) IF list_position(actuals, actuals[i]) = i]) END, '|') AS steps,
  array_to_string(CASE WHEN NOT is_real OR stop OR f = 0 THEN failure_handling ELSE list_append(failure_handling, 'Observed live-agent failure during stage-5 evaluation against ' || subject || ': ' || f || ' of ' || n || ' case(s) did not meet the derived expectation (' || array_to_string(ids[1:5], ', ') || CASE WHEN f > 5 THEN ' (+' || (f - 5) || ' more)' ELSE '' END || ').') END, '|') AS failures,
  CASE WHEN stop THEN 'confidence is above 0.7' END AS refused, CASE WHEN stop THEN 0 WHEN NOT is_real THEN 1 ELSE 1 + (len(routed) > 0)::INT * 2 + (f > 0)::INT END AS n_notes FROM q""")
def apply_feedback(spark, d):
    made = drafts(spark, d)
    key = F.col("capture_id")
    feedback = made.select("capture_id", F.when(key % 9 == 3, "injected-runner").when(key % 9 != 4, "run-eval").alias("source"), F.when(key % 5 != 0, F.concat(F.lit("Agent's "), (key % 3).cast("string"))).alias("subject_name"), F.when(key % 2 == 0, "org").alias("org_alias"))
    items = read(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(*[F.min(c).alias(c) for c in ("l_returnflag", "l_linestatus", "l_quantity")])
    run = items.filter("l_orderkey % 10 <> 7 and l_linenumber <> 7").select(F.col("l_orderkey").alias("capture_id"), F.col("l_linenumber").alias("case_no"), F.concat(F.lit("case "), F.col("l_linenumber").cast("string")).alias("case_id"), "l_returnflag", "l_linestatus", "l_quantity")
    said = lambda kind, ok, expected, actual: F.struct(F.lit(kind).alias("kind"), ok.alias("is_pass"), expected.cast("string").alias("expected"), actual.cast("string").alias("actual"))
    topic = said("expected_topic", F.col("l_returnflag") == "N", F.lit("Topic N"), F.concat(F.lit("Topic "), "l_returnflag"))
    rating = said("rating", F.when(F.col("l_linestatus") == "O", F.col("l_quantity") > 5), F.lit(None), F.lit(None))
    outcomes = run.filter("case_no <> 6").select("capture_id", "case_no", F.posexplode(F.array(topic, rating)).alias("outcome_no", "_o")).select("capture_id", "case_no", "outcome_no", "_o.*")
    found = evaluate.apply_feedback(made, feedback, run, outcomes)
    lines = lambda c: F.array_join(c, "|")
    return found.select("capture_id", F.col("confidence").cast("double").alias("confidence"), F.when(key % 4 == 0, 1).otherwise(0).alias("n_before"), lines("unknowns").alias("unknowns"), lines(F.transform("evidence", lambda e: F.concat(e["source"], F.lit(": "), e["detail"]))).alias("evidence"), lines("orchestration_steps").alias("steps"), lines("failure_handling").alias("failures"), "refused", F.size("notes").alias("n_notes"))
