"""Specifications: derived from what was recorded, and scored.

A specification is one row a capture, with arrays; deriving groups each of its parts by
capture once, scoring is expressions within the row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepline.functions.naming import camel_name
from stepline.functions.values import let
from stepline.operators.records import SYSTEM_FIELDS
from stepline.operators.score import MARKERS, band, content_signature, honesty, provenance

KEYS = ["capture_id"]
EVIDENCE = "array<struct<source:string,detail:string>>"
#: Points by dimension, and limits of the gate.
POINTS = {"grounding": 30, "completeness": 15, "honesty": 20, "specificity": 10, "testability": 10, "placeholders": 10, "provenance": 5}
PASSING, DISPLAY_CAP, DETAIL_CHARS, FILLER_CHARS, FILLER_WORDS, FILLER_SHARE = 75, 59, 12, 12, 3, 0.4
GENERIC_INTENTS = ("Complete a data-entry process", "Interact with guided process")
VAGUE = ("generic", "action", "something", "vague")
GENERIC_STEP_TERMS = ("generic", "placeholder", "lorem ipsum")
GENERIC_GUARDRAILS = ("validate input", "check input", "verify input", "validate data", "ensure valid")
#: Sentences of a specification; pairs stand around a name.
SENTENCES = {
    "header": ("Resolve and load the target ", " record; confirm the caller may act on it."),
    "flow": "Invoke the equivalent Flow rather than reproducing its logic in the agent.",
    "end": "Return a confirmation that names the record and the fields changed.",
    "security": ("Enforce object- and field-level security on ", " for the running user; never widen access beyond the recorded profile."),
    "validation": "Validation rules fired during this process: surface field-level errors verbatim instead of retrying blindly.",
    "confirm": ("Require explicit user confirmation before writing: ", "."),
    "async": "Async work was triggered; do not report success until the async job completes.",
    "scope": "Scope the agent to the objects listed above; refuse unrelated requests.",
    "no correction": "On validation error, return the offending field and message; do not auto-correct.",
    "failure": ("Observed ", " failure during recording: "),
    "no detail": "no detail captured",
}
#: What to record anew, by what the score found wanting.
ADVICE = {
    "grounding": "Re-record with --track-record ObjectApiName:RecordId to capture field deltas, which anchor entities to observed data rather than inference.",
    "object": "Re-record with --track-record ObjectApiName:RecordId so the spec can name concrete targets.",
    "intent": "Recording did not demonstrate a completed business action; record a full end-to-end flow.",
    "failure": "Record a failing variant (validation error, auth failure, etc.) to exercise error paths, which makes the spec testable under failure.",
}
UNTESTED = "No failures were observed in this run, so error paths are UNTESTED. Record a failing variant before relying on this spec."


def _around(sentence: str, name: Column) -> Column:
    before, after = SENTENCES[sentence]
    return F.concat(F.lit(before), name, F.lit(after))


# -- derivation ---------------------------------------------------------------------------------


def entities(changes: DataFrame, actions: DataFrame, keys=KEYS) -> DataFrame:
    """One row an entity: name, object and field, evidence in order, and whether any of its matches was ambiguous.

    ``changes``: sequence, place, object_name, field, confidence.  A field's first change
    counts as its evidence; the first object also yields the ``recordId`` that acting on it
    needs.  What a user typed or chose adds evidence to the entity of that name, or makes one.
    """
    order = F.struct("sequence", "place")
    business = changes.filter(~F.col("field").isin(*SYSTEM_FIELDS))
    fields = business.groupBy(*keys, "object_name", "field").agg(F.min(order).alias("_o"), F.min_by("confidence", order).alias("_c"), F.max((F.col("confidence") == "AMBIGUOUS").cast("int")).alias("_a"))
    observed = F.col("_c").isin("HIGH", "TEMPORAL")
    detail = F.concat("object_name", F.lit("."), "field", F.when(observed, " changed at ").otherwise(" inferred at "), F.col("_o.sequence").cast("string"))
    found = fields.select(*keys, camel_name(F.col("field")).alias("name"), "object_name", "field", F.col("_o"), F.when(observed, "data-delta").otherwise("inference").alias("source"), detail.alias("detail"), (F.col("_a") == 1).alias("ambiguous"), F.lit(0).alias("_kind"))
    first = changes.groupBy(*keys).agg(F.min_by("object_name", order).alias("object_name"), F.min(order).alias("_o"))
    record = first.select(*keys, F.lit("recordId").alias("name"), "object_name", F.lit("Id").alias("field"), "_o", F.lit("inference").alias("source"), F.concat(F.lit("a "), "object_name", F.lit(" record must be identified to act on it")).alias("detail"), F.lit(False).alias("ambiguous"), F.lit(1).alias("_kind"))
    fields_and_record = found.unionByName(record).withColumn("evidence", F.array(F.struct("source", "detail")))
    latest = Window.partitionBy(*keys, "name").orderBy(F.col("_kind").desc(), F.col("_o").desc(), F.col("object_name").desc())
    ranked = fields_and_record.withColumn("_n", F.row_number().over(latest)).select(*keys, "name", "object_name", "field", "evidence", "ambiguous", "_n")
    typed = actions.filter(F.col("action_type").isin("input", "select"))
    detail = F.concat("action_type", F.lit(" on "), "target", F.lit(" at step "), F.col("sequence").cast("string"))
    inputs = typed.groupBy(*keys, camel_name(F.element_at(F.split("target", ":"), -1)).alias("name")).agg(F.array_sort(F.collect_list(F.struct("sequence", detail.alias("detail")))).alias("_u"))
    inputs = inputs.select(*keys, "name", F.transform("_u", lambda u: F.struct(F.lit("ui-action").alias("source"), u["detail"].alias("detail"))).alias("_ui"))
    # of several entities of one name, the last takes up what was typed
    none = F.array().cast(EVIDENCE)
    last = ranked.filter("_n = 1").join(inputs, [*keys, "name"], "full").withColumn("evidence", F.concat(F.coalesce("evidence", none), F.coalesce("_ui", none))).withColumn("ambiguous", F.coalesce("ambiguous", F.lit(False))).drop("_ui", "_n")
    rows = last.unionByName(ranked.filter("_n > 1").drop("_n"))
    return rows.withColumnRenamed("object_name", "object_api_name").withColumnRenamed("field", "field_api_name")


def orchestration_steps(actions: DataFrame, steps: DataFrame, objects: DataFrame, keys=KEYS) -> DataFrame:
    """A header, a line for each step with what it writes and the layers behind it, a line on flows, and a closing line.

    ``steps``: sequence, layers and fields (sorted arrays, empty for none).  ``objects``: first_object.
    """
    joined = actions.join(steps, [*keys, "sequence"], "left")
    writes = F.when(F.size("fields") > 0, F.concat(F.lit(" -> writes "), F.array_join("fields", ", "))).otherwise("")
    layers = F.when(F.size("layers") > 0, F.concat(F.lit(" (backend: "), F.array_join("layers", ", "), F.lit(")"))).otherwise("")
    line = F.concat("action_type", F.lit(" on "), "target", writes, layers)
    rolled = joined.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("sequence", line.alias("line")))).alias("_l"), F.max(F.array_contains("layers", "flow")).alias("_flow"))
    with_first = rolled.join(objects, keys, "left")
    optional = lambda c, text: F.when(c, F.array(text)).otherwise(F.array().cast("array<string>"))
    header = _around("header", F.col("first_object"))
    lines = F.concat(
        optional(F.col("first_object").isNotNull(), header),
        F.transform("_l", lambda x: x["line"]),
        optional(F.coalesce("_flow", F.lit(False)), F.lit(SENTENCES["flow"])),
        F.array(F.lit(SENTENCES["end"])),
    )
    return with_first.select(*keys, lines.alias("orchestration_steps"))


def guardrails(first_object: Column, layers: Column, writes: Column) -> Column:
    """``layers`` and ``writes``: arrays of all the capture's layers and written fields."""
    rules = [
        F.when(first_object.isNotNull(), _around("security", first_object)),
        F.when(F.array_contains(layers, "validation"), F.lit(SENTENCES["validation"])),
        F.when(F.size(writes) > 0, _around("confirm", F.array_join(F.array_distinct(writes), ", "))),
        F.when(F.array_contains(layers, "async"), F.lit(SENTENCES["async"])),
        F.lit(SENTENCES["scope"]),
    ]
    return F.filter(F.array(*rules), lambda x: x.isNotNull())


def failure_handling(failures: DataFrame, captures: DataFrame, keys=KEYS) -> DataFrame:
    """One line for each layer that failed, with its first reason; UNTESTED if none did.  ``failures``: sequence, layer, reason."""
    first = failures.groupBy(*keys, "layer").agg(F.min_by("reason", F.when(F.col("reason").isNotNull(), F.col("sequence"))).alias("_r"))
    line = F.concat(_around("failure", F.col("layer")), F.coalesce("_r", F.lit(SENTENCES["no detail"])))
    rolled = first.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("layer", line.alias("line")))), lambda x: x["line"]).alias("_l"), F.max(F.col("layer") == "validation").alias("_v"))
    extra = F.when(F.col("_v"), F.array(F.lit(SENTENCES["no correction"]))).otherwise(F.array().cast("array<string>"))
    return captures.join(rolled, keys, "left").select(*keys, F.when(F.col("_l").isNull(), F.array(F.lit(UNTESTED))).otherwise(F.concat("_l", extra)).alias("failure_handling"))


def unknowns(n_redacted: Column, ambiguous: Column, has_object: Column, n_entities: Column, n_telemetry: Column, most: int = 5) -> Column:
    """What the capture leaves open.  ``ambiguous``: array of field keys."""
    shown = F.transform(F.slice(ambiguous, 1, most), lambda k: F.concat(F.lit("Ambiguous correlation: "), k))
    rules = [
        F.when(n_redacted > 0, F.concat(n_redacted.cast("string"), F.lit(" values were redacted"))),
        F.when(F.size(ambiguous) > most, F.concat((F.size(ambiguous) - most).cast("string"), F.lit(" more ambiguous fields"))),
        F.when(~has_object, F.lit("No object was observed")),
        F.when(n_entities == 0, F.lit("No entities were derived")),
        F.when(n_telemetry == 0, F.lit("No telemetry was observed")),
    ]
    return F.concat(shown, F.filter(F.array(*rules), lambda x: x.isNotNull()))


def evidence_trail(layers: Column, n_actions: Column, objects: Column) -> Column:
    """What the run itself showed: layers, number of actions, objects; ``layers`` and ``objects`` sorted arrays, null for none."""
    entry = lambda source, detail: F.struct(F.lit(source).alias("source"), detail.alias("detail"))
    listed = lambda text, names: F.concat(F.lit(text), F.array_join(names, ", "))
    trail = F.array(
        F.when(F.size(layers) > 0, entry("telemetry", listed("backend layers observed: ", layers))),
        entry("extraction", F.concat(F.coalesce(n_actions, F.lit(0)).cast("string"), F.lit(" action(s) in recording"))),
        F.when(F.size(objects) > 0, entry("data-delta", listed("objects mutated: ", objects))),
    )
    return F.filter(trail, lambda x: x.isNotNull())


# -- score --------------------------------------------------------------------------------------


def _text(c: Column) -> Column:
    return F.trim(F.coalesce(c, F.lit("")))


def _observed(spec_entities: Column) -> Column:
    """Entities but for the record id that every specification must have."""
    return F.filter(spec_entities, lambda e: ~((F.coalesce(e["name"], F.lit("")) == "recordId") & (F.coalesce(e["field_api_name"], F.lit("")) == "Id")))


def padded_entities(observed: Column) -> Column:
    """Of observed entities, more than three claims pile up on one field, or entities without object and field tell the same details over three times on average."""
    named = lambda e, c: F.coalesce(e[c], F.lit("")) != ""
    resolved = F.filter(observed, lambda e: named(e, "object_api_name") | named(e, "field_api_name"))
    keys = F.transform(resolved, lambda e: F.concat(F.coalesce(e["object_api_name"], F.lit("?")), F.lit("."), F.coalesce(e["field_api_name"], F.lit("?"))))
    # in order, a key that is there more than three times is the third after itself
    claimed = let(F.sort_array(keys), lambda k: F.size(F.filter(k, lambda x, i: F.coalesce(x == F.get(k, i + 3), F.lit(False)))) > 0)
    unresolved = F.filter(observed, lambda e: ~(named(e, "object_api_name") | named(e, "field_api_name")))
    details = F.filter(F.flatten(F.transform(unresolved, lambda e: F.coalesce(F.transform(e["evidence"], lambda v: v["detail"]), F.array().cast("array<string>")))), lambda d: d.isNotNull())
    same = let(details, lambda d: (F.size(F.array_distinct(d)) * 3 < F.size(d)) & (F.size(d) > 3))
    return claimed | ((F.size(unresolved) > 3) & same)


def grounding(observed: Column, padded: Column) -> Column:
    """0 to 30, of observed entities and whether they are padded: the best kind of evidence sets a floor, each grounded entity adds a quarter up to a half; claims that pile up on one field leave a fifth."""
    has = lambda e, source: F.coalesce(F.exists(e["evidence"], lambda v: (v["source"] == source) & (F.length(_text(v["detail"])) >= DETAIL_CHARS)), F.lit(False))
    n_delta = F.size(F.filter(observed, lambda e: has(e, "data-delta")))
    n_ui = F.size(F.filter(observed, lambda e: ~has(e, "data-delta") & has(e, "ui-action")))
    share = F.when(n_delta > 0, 0.5).when(n_ui > 0, 0.35).otherwise(0.0) + F.least((n_delta + n_ui) * 0.25, F.lit(0.5))
    base = F.floor(F.round(share * POINTS["grounding"], 6))
    score = F.when(padded, F.floor(base * 0.2)).otherwise(base)
    return F.when(F.size(observed) > 0, F.least(score, F.lit(POINTS["grounding"]))).otherwise(0).cast("int")


def _distinct(lines: Column, strip_digits: bool = False) -> Column:
    if strip_digits:
        words = lambda s: F.filter(F.split(F.lower(s), "[^0-9a-z]+"), lambda w: (w != "") & ~w.rlike("^[0-9]+$"))
        plain = F.transform(lines, lambda s: F.array_join(words(s), " "))
    else:
        plain = F.transform(lines, lambda s: F.trim(F.regexp_replace(F.lower(s), r"\s+", " ")))
    return F.array_distinct(F.filter(plain, lambda s: s != ""))


def _padded(lines: Column, n_distinct: Column) -> Column:
    n = F.size(lines)
    ratio = lambda different: n / F.greatest(different, F.lit(1))
    return ((n > 5) & (ratio(n_distinct) > 3)) | ((n > 8) & (ratio(F.size(_distinct(lines, True))) > 3))


def completeness(objects: Column, spec_entities: Column, n_steps: Column, padded_steps: Column, rails: Column, n_rails: Column, padded_rails: Column, failures: Column) -> Column:
    """0 to 15, of the sections and how many of their lines differ: three points for each section that says something; padded ones keep none, repeated guardrails one."""
    parts = [
        F.when(F.size(objects) > 0, 3).otherwise(0),
        F.when(F.size(spec_entities) > 0, 3).otherwise(0),
        F.when(n_steps > 1, F.when(padded_steps, 0).otherwise(3)).otherwise(0),
        F.when(n_rails > 0, F.when(padded_rails, 0).when(n_rails < F.size(rails), 1).otherwise(3)).otherwise(0),
        F.when(F.size(failures) > 0, 3).otherwise(0),
    ]
    return sum(parts, F.lit(0))


def is_filler(text: Column) -> Column:
    """Too short, or with fewer than ``FILLER_WORDS`` words: fewer gaps than would part so many."""
    gaps = r"\s" + r"\S+\s" * (FILLER_WORDS - 2)
    return (F.length(_text(text)) < FILLER_CHARS) | ~_text(text).rlike(gaps)


def _holds(text: Column, terms) -> Column:
    return reduce(Column.__or__, [F.contains(text, F.lit(t)) for t in terms])


def specificity(intent: Column, steps: Column, rails: Column, n_filler: Column) -> Column:
    """0 to 10: none without an intent, less for a vague or stuffed one, for empty steps and guardrails, and for lines that instruct nothing."""
    words = F.size(F.filter(F.split(_text(intent), r"\s+"), lambda w: w != ""))
    vague = _holds(F.lower(intent), VAGUE)
    of_intent = F.when(intent.contains("UNRESOLVED"), 3).when(intent.isin(*GENERIC_INTENTS), 2).when((words <= 2) | vague, 5).when(words > 6, 5).otherwise(0)
    of_step = lambda s: F.when(F.trim(s).rlike(r"^(step|action|task|item)(\s+\d+)?$"), 3).when(_holds(s, GENERIC_STEP_TERMS), 1).otherwise(0)
    of_rail = lambda s: F.when(F.trim(s).rlike(r"^(guardrail|rule|check|validation)(\s+\d+)?$"), 3).when(_holds(s, GENERIC_GUARDRAILS), 2).otherwise(0)
    total = lambda array, f: F.aggregate(F.transform(array, F.lower), F.lit(0), lambda acc, s: acc + f(s))
    left = F.greatest(F.lit(POINTS["specificity"]) - of_intent - total(steps, of_step) - total(rails, of_rail) - 2 * n_filler, F.lit(0))
    return F.when(_text(intent) == "", 0).otherwise(left)


def failure_observed(failures: Column) -> Column:
    return F.coalesce(F.exists(failures, lambda f: f.contains("Observed ") & f.contains(" failure during recording:")), F.lit(False))


def testability(spec_entities: Column, failures: Column) -> Column:
    explicit = F.exists(spec_entities, lambda e: (F.coalesce(e["object_api_name"], F.lit("")) != "") | (F.coalesce(e["field_api_name"], F.lit("")) != ""))
    return F.when(F.coalesce(explicit, F.lit(False)), 5).otherwise(0) + F.when(failure_observed(failures), 5).otherwise(0)


def all_text(with_intent: Column, lists: list[Column], spec_entities: Column, trail: Column) -> Column:
    """Every text in a specification, a line each."""
    none = F.array().cast("array<string>")
    of_evidence = lambda e: F.flatten(F.transform(F.coalesce(e, F.array().cast(EVIDENCE)), lambda v: F.array(v["source"], v["detail"])))
    of_entity = lambda e: F.concat(F.array(e["name"], e["object_api_name"], e["field_api_name"]), of_evidence(e["evidence"]))
    return F.array_join(F.concat(F.array(with_intent), *[F.coalesce(x, none) for x in lists], F.flatten(F.transform(spec_entities, of_entity)), of_evidence(trail)), "\n")


def names_nothing(spec_entities: Column, lines: Column) -> Column:
    """There are names of four letters or more of what was observed, and no line holds one."""
    told = F.lower(F.array_join(lines, " "))
    fields = F.transform(F.filter(spec_entities, lambda e: e["field_api_name"] != "Id"), lambda e: e["field_api_name"])
    names = F.transform(F.filter(spec_entities, lambda e: e["name"] != "recordId"), lambda e: e["name"])
    long = F.filter(F.concat(fields, names), lambda n: F.length(n) >= 4)
    return let(told, lambda text: let(long, lambda names: (F.size(names) > 0) & ~F.exists(names, lambda n: F.contains(text, F.lower(n)))))


def says_twice(lines: Column) -> Column:
    """Different lines have the same content words."""
    signed = F.filter(F.transform(F.array_distinct(F.transform(lines, lambda s: F.trim(s))), lambda s: content_signature(s)), lambda x: x.isNotNull())
    return let(signed, lambda s: F.size(F.array_distinct(s)) < F.size(s))


def score_spec(specs: DataFrame) -> DataFrame:
    """Adds a column for each dimension, total, blockers, passed, band, display and recommendations.

    ``specs``: intent, confidence, objects_touched, entities, orchestration_steps, guardrails,
    failure_handling, unknowns, evidence (the run's trail), extraction_source, telemetry_source.
    """
    c = F.col
    text = all_text(c("intent"), [c("orchestration_steps"), c("guardrails"), c("failure_handling"), c("unknowns"), c("objects_touched")], c("entities"), c("evidence"))
    lines = F.concat("orchestration_steps", "guardrails")
    # what several dimensions or blockers take comes first, so that it is made once
    read = specs.withColumns({"_text": text, "_seen": _observed(c("entities")), "_n_steps": F.size(_distinct(c("orchestration_steps"))), "_n_rails": F.size(_distinct(c("guardrails"))), "_n_filler": F.size(F.filter(lines, is_filler))})
    empty = (_text(c("intent")) == "") & sum((F.size(x) for x in ("entities", "orchestration_steps", "guardrails", "failure_handling")), F.lit(0)).eqNullSafe(0)
    source = provenance(c("extraction_source"), c("telemetry_source"))
    read = read.withColumns(
        {
            "_marked": _holds(c("_text"), MARKERS) | empty,
            "_heaped": padded_entities(c("_seen")),
            "_padded_steps": _padded(c("orchestration_steps"), c("_n_steps")),
            "_padded_rails": _padded(c("guardrails"), c("_n_rails")),
        }
    )
    scored = read.withColumns(
        {
            "grounding": grounding(c("_seen"), c("_heaped")),
            "completeness": completeness(c("objects_touched"), c("entities"), c("_n_steps"), c("_padded_steps"), c("guardrails"), c("_n_rails"), c("_padded_rails"), c("failure_handling")),
            "honesty": honesty(c("confidence"), F.size("unknowns"), (F.size("objects_touched") == 0) | (F.size("entities") == 0)),
            "specificity": specificity(c("intent"), c("orchestration_steps"), c("guardrails"), c("_n_filler")),
            "testability": testability(c("entities"), c("failure_handling")),
            "placeholders": F.when(c("_marked"), 0).otherwise(POINTS["placeholders"]),
            "provenance": source["score"],
        }
    )
    hollow = lambda d: c(d) <= POINTS[d] * 0.1
    weak = sum(((c(d) <= POINTS[d] * 0.5).cast("int") for d in POINTS if d != "provenance"), F.lit(0))
    filler = c("_n_filler") / F.greatest(F.size("orchestration_steps") + F.size("guardrails"), F.lit(1))
    rules = {
        "padded entities": c("_heaped"),
        "padding": c("_padded_steps") | c("_padded_rails"),
        "no object": F.size("objects_touched") == 0,
        "no entity": F.size("entities") == 0,
        "no guardrail": F.size("guardrails") == 0,
        "unresolved": c("intent").startswith("UNRESOLVED:"),
        "placeholder": c("_marked"),
        "provenance": source["blocked"],
        "filler": filler > FILLER_SHARE,
        "threshold surfing": weak >= 2,
        "empty trail": F.coalesce(F.size("evidence"), F.lit(0)) <= 0,
        "names nothing observed": names_nothing(c("entities"), lines),
        "near-duplicate steps": says_twice(c("orchestration_steps")),
        "near-duplicate guardrails": says_twice(c("guardrails")),
    } | {f"hollow {d}": hollow(d) for d in POINTS if d not in ("testability", "provenance")}
    blockers = F.filter(F.array(*[F.when(F.coalesce(x, F.lit(False)), F.lit(name)) for name, x in rules.items()]), lambda x: x.isNotNull())
    wanting = {"grounding": c("grounding") < POINTS["grounding"] * 0.5, "object": F.size("objects_touched") == 0, "intent": c("intent").startswith("UNRESOLVED:"), "failure": ~failure_observed(c("failure_handling"))}
    total = scored.withColumn("total", sum((c(d) for d in POINTS), F.lit(0)).cast("int")).withColumn("blockers", blockers).drop("_text", "_seen", "_n_steps", "_n_rails", "_n_filler", "_marked", "_heaped", "_padded_steps", "_padded_rails")
    return total.withColumns(
        {
            "passed": (c("total") >= PASSING) & (F.size("blockers") == 0),
            "band": F.when(F.size("blockers") > 0, "low").otherwise(band(c("total"))),
            "display": F.when(F.size("blockers") > 0, F.least("total", F.lit(DISPLAY_CAP))).otherwise(c("total")),
            "recommendations": F.filter(F.array(*[F.when(F.coalesce(hit, F.lit(False)), F.lit(ADVICE[k])) for k, hit in wanting.items()]), lambda x: x.isNotNull()),
        }
    )


# -- runs ----------------------------------------------------------------------------------------


def run_summary(counts: list[DataFrame], keys=KEYS) -> DataFrame:
    """One row a run, from one-row-a-run frames."""
    out = counts[0]
    for df in counts[1:]:
        out = out.join(df, keys, "left")
    return out


def first_objects(changes: DataFrame, keys=KEYS) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy("sequence", "place")
    return changes.withColumn("_n", F.row_number().over(w)).filter("_n = 1").select(*keys, F.col("object_name").alias("first_object"))
