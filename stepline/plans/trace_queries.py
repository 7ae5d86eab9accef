"""Queries of the trace operators over the driver's tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from stepline.functions import naming, redaction
from stepline.operators import actions, chunked, correlate, evaluate, integrity, ordering, prompts, quality, records, reduce, rounds, score, selectors, specs
from stepline.plans import bindings
from stepline.plans.bindings import duck, read
from stepline.plans.registry import ORACLES, QUERIES

HOUR = 3_600_000
#: The tables' events are hours apart, so windows are.
WINDOW = 6 * HOUR
ECHO = 12 * HOUR


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def frame(name):
    return lambda spark, d: bindings.spark_frame(spark, d, name)


capture, action, telemetry, history, log, verdict, round_, attempt = map(frame, ("capture", "action", "telemetry", "history", "log", "verdict", "round", "attempt"))

# -- correlation ------------------------------------------------------------------------------

MATCH = f"""WITH {duck("action", "telemetry")},
m AS (SELECT a.capture_id, a.sequence, a.step_id, a.t AS step_t, e.event_no, e.layer, e.status, e.t AS effect_t, e.t - a.t AS delta_ms,
  CASE WHEN e.t BETWEEN a.t AND a.t + {WINDOW} THEN CASE WHEN e.step_id = a.step_id THEN 'HIGH' ELSE 'TEMPORAL' END ELSE 'ASSERTED' END AS confidence
  FROM action a JOIN telemetry e ON a.capture_id = e.capture_id AND (e.t BETWEEN a.t AND a.t + {WINDOW} OR e.step_id = a.step_id)),
r AS (SELECT *, sum(CASE WHEN confidence IN ('HIGH', 'TEMPORAL') THEN 1 ELSE 0 END) OVER (PARTITION BY capture_id, sequence, layer) AS n,
  row_number() OVER (PARTITION BY capture_id, sequence, layer ORDER BY abs(delta_ms), event_no) AS k FROM m),
f AS (SELECT capture_id, sequence, step_id, step_t, event_no, layer, status, effect_t, delta_ms, CASE WHEN n > 1 THEN 'AMBIGUOUS' ELSE confidence END AS confidence FROM r WHERE n <= 1 OR k = 1),
o AS (SELECT *, row_number() OVER (PARTITION BY capture_id, sequence ORDER BY CASE confidence WHEN 'HIGH' THEN 0 WHEN 'TEMPORAL' THEN 1 WHEN 'AMBIGUOUS' THEN 2 ELSE 3 END, effect_t, event_no) AS place FROM f)
"""


def matches(spark, d):
    return correlate.correlate(action(spark, d), telemetry(spark, d), WINDOW)


def resolved(spark, d):
    return correlate.resolve_ambiguity(matches(spark, d), ["layer"])


@query(MATCH + """SELECT a.capture_id, a.sequence, coalesce(x.layers, '') AS layers, coalesce(x.n, 0) AS n_matches, coalesce(x.h, 0) AS n_high, coalesce(x.b, 0) AS n_ambiguous
FROM action a LEFT JOIN (SELECT capture_id, sequence, string_agg(DISTINCT layer, ',' ORDER BY layer) AS layers, count(*) AS n, count(*) FILTER (confidence = 'HIGH') AS h, count(*) FILTER (confidence = 'AMBIGUOUS') AS b FROM f GROUP BY ALL) x
ON a.capture_id = x.capture_id AND a.sequence = x.sequence""")
def flagship_step_rollup(spark, d):
    rolled = resolved(spark, d).groupBy("capture_id", "sequence").agg(
        F.array_join(F.array_sort(F.collect_set("layer")), ",").alias("layers"), F.count("*").alias("n"), F.count_if(F.col("confidence") == "HIGH").alias("h"), F.count_if(F.col("confidence") == "AMBIGUOUS").alias("b")
    )
    zero = lambda c, name: F.coalesce(F.col(c), F.lit(0)).alias(name)
    return action(spark, d).join(rolled, ["capture_id", "sequence"], "left").select("capture_id", "sequence", F.coalesce("layers", F.lit("")).alias("layers"), zero("n", "n_matches"), zero("h", "n_high"), zero("b", "n_ambiguous"))


@query(MATCH + "SELECT capture_id, sequence, event_no, delta_ms, confidence FROM m")
def correlate_events(spark, d):
    return matches(spark, d).select("capture_id", "sequence", "event_no", "delta_ms", "confidence")


@query(MATCH + "SELECT capture_id, sequence, event_no, layer, delta_ms, confidence FROM f")
def resolve_ambiguity(spark, d):
    return resolved(spark, d).select("capture_id", "sequence", "event_no", "layer", "delta_ms", "confidence")


@query(MATCH + "SELECT capture_id, sequence, event_no, place FROM o")
def correlation_order(spark, d):
    return correlate.correlation_order(resolved(spark, d)).select("capture_id", "sequence", "event_no", "place")


@query(MATCH + "SELECT capture_id, string_agg(DISTINCT layer, ',' ORDER BY layer) AS layers FROM f GROUP BY capture_id")
def triggered_layers(spark, d):
    return correlate.triggered_layers(resolved(spark, d), ["capture_id"])


LATEST = f"""WITH {duck("attempt")}, z AS (SELECT *, row_number() OVER (PARTITION BY capture_id, step_id ORDER BY attempt_no DESC) AS n FROM attempt)"""


@query(LATEST + " SELECT capture_id, step_id, attempt_no, status FROM z WHERE n = 1")
def latest_attempt(spark, d):
    return correlate.latest_attempt(attempt(spark, d)).select("capture_id", "step_id", "attempt_no", "status")


@query(LATEST + r""" SELECT capture_id, step_id, nullif(regexp_extract(message, 'screenshot=([^;]+)', 1), '') AS screenshot, nullif(regexp_extract(message, 'network_trace=([^;]+)', 1), '') AS network_trace FROM z WHERE n = 1""")
def artifact_paths(spark, d):
    last = correlate.latest_attempt(attempt(spark, d))
    return last.select("capture_id", "step_id", *[c.alias(k) for k, c in correlate.artifact_paths(F.col("message")).items()])


@query(f"""WITH {duck("attempt")},
e AS (SELECT *, coalesce(max(CASE WHEN status <> 'retried' THEN 1 ELSE 0 END) OVER (PARTITION BY capture_id, step_id ORDER BY attempt_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ended,
  lead(attempt_no) OVER (PARTITION BY capture_id, step_id ORDER BY attempt_no) AS nxt FROM attempt)
SELECT capture_id, step_id, attempt_no, status, CASE WHEN status = 'retried' AND nxt IS NOT NULL THEN CAST(500 * pow(2, attempt_no - 1) AS BIGINT) END AS backoff_ms FROM e WHERE ended = 0""")
def retry_chain(spark, d):
    return correlate.retry_chain(attempt(spark, d)).select("capture_id", "step_id", "attempt_no", "status", "backoff_ms")


@query(f"""WITH {duck("action", "attempt")}, acts AS (SELECT capture_id % 50 AS capture_id, CAST(sequence % 200 AS VARCHAR) AS step_id, min(sequence) AS sequence FROM action GROUP BY ALL),
z AS (SELECT *, row_number() OVER (PARTITION BY capture_id, step_id ORDER BY attempt_no DESC) AS n FROM attempt)
SELECT a.capture_id, a.step_id, a.sequence, z.status, z.attempt_no FROM acts a LEFT JOIN z ON a.capture_id = z.capture_id AND a.step_id = z.step_id AND z.n = 1""")
def replay_join(spark, d):
    acts = action(spark, d).groupBy((F.col("capture_id") % 50).alias("capture_id"), (F.col("sequence") % 200).cast("string").alias("step_id")).agg(F.min("sequence").alias("sequence"))
    return correlate.replay_join(acts, attempt(spark, d)).select("capture_id", "step_id", "sequence", "status", "attempt_no")


@query(MATCH.replace("\nm AS", f"\n{duck('attempt')},\nm AS", 1) + r""",
k AS (SELECT capture_id, step_id, attempt_no, status, message, error, row_number() OVER (PARTITION BY capture_id, step_id ORDER BY attempt_no DESC) AS n FROM attempt),
x AS (SELECT capture_id, sequence, string_agg(DISTINCT layer, ',' ORDER BY layer) AS layers, count(*) AS n_matches, count(*) FILTER (confidence = 'HIGH') AS n_high, count(*) FILTER (confidence = 'AMBIGUOUS') AS n_ambiguous,
  arg_min(layer, place) FILTER (status = 'error' AND layer IN ('validation', 'flow', 'apex', 'network', 'integration')) AS bad FROM o GROUP BY ALL)
SELECT a.capture_id, a.sequence, a.step_id, k.status, coalesce(x.layers, '') AS layers, coalesce(x.n_matches, 0) AS n_matches, coalesce(x.n_high, 0) AS n_high, coalesce(x.n_ambiguous, 0) AS n_ambiguous,
  CASE WHEN k.status IN ('failed', 'retried') THEN CASE WHEN k.error IN ('TimeoutError', 'no locator matched: #save', 'boom') THEN 'ui' WHEN x.bad = 'network' THEN 'integration' ELSE coalesce(x.bad, 'unknown') END END AS failure,
  nullif(regexp_extract(k.message, 'screenshot=([^;]+)', 1), '') AS screenshot, nullif(regexp_extract(k.message, 'network_trace=([^;]+)', 1), '') AS network_trace
FROM action a LEFT JOIN x ON a.capture_id = x.capture_id AND a.sequence = x.sequence LEFT JOIN k ON k.n = 1 AND k.capture_id = a.capture_id % 50 AND k.step_id = CAST(a.sequence % 200 AS VARCHAR)""")
def step_analysis(spark, d):
    # attempts are keyed by other ids than the events' steps: give them to the steps that they stand for
    acts = action(spark, d)
    link = acts.select("capture_id", "step_id", (F.col("capture_id") % 50).alias("_c"), (F.col("sequence") % 200).cast("string").alias("_s"))
    tries = attempt(spark, d).withColumnRenamed("capture_id", "_c").withColumnRenamed("step_id", "_s").join(link, ["_c", "_s"]).drop("_c", "_s")
    return correlate.step_analysis(acts, resolved(spark, d), tries)


# -- order and noise --------------------------------------------------------------------------

ORDERED = f"""WITH {duck("capture")},
st AS (SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY ingest_seq, pos) AS rk, max(t) OVER (PARTITION BY capture_id ORDER BY ingest_seq, pos ROWS UNBOUNDED PRECEDING) AS anchor FROM capture WHERE ingest_seq IS NOT NULL),
slots AS (SELECT u.capture_id, u.pos, count(s.pos) AS slot FROM capture u LEFT JOIN st s ON s.capture_id = u.capture_id AND s.anchor <= u.t WHERE u.ingest_seq IS NULL GROUP BY ALL),
keyed AS (SELECT c.*, coalesce(st.rk - 1, slots.slot) AS slot, CASE WHEN st.rk IS NULL THEN 0 ELSE 1 END AS own FROM capture c LEFT JOIN st ON st.capture_id = c.capture_id AND st.pos = c.pos LEFT JOIN slots ON slots.capture_id = c.capture_id AND slots.pos = c.pos),
ordered AS (SELECT * EXCLUDE (slot, own), row_number() OVER (PARTITION BY capture_id ORDER BY slot, own, t, seq) AS ordinal FROM keyed)
"""


def ordered(spark, d):
    return ordering.order_events(capture(spark, d))


@query(ORDERED + "SELECT capture_id, pos, ordinal FROM ordered")
def order_events(spark, d):
    return ordered(spark, d).select("capture_id", "pos", "ordinal")


@query(f"WITH {duck('capture')} SELECT capture_id, pos, max(t) OVER (PARTITION BY capture_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS clock FROM capture")
def running_max_clock(spark, d):
    return ordering.running_max_clock(capture(spark, d)).select("capture_id", "pos", "clock")


CONTROL = "(tag IN ('button', 'a', 'input', 'select', 'textarea') OR coalesce(elem_type, '') IN ('button', 'submit', 'reset'))"
MERGED = ORDERED + """, a1 AS (SELECT *, type IN ('input', 'change') AS is_run, type = 'click' AND tag IN ('input', 'textarea') AS is_held FROM ordered),
a2 AS (SELECT *, sum(CASE WHEN is_run OR is_held THEN 0 ELSE 1 END) OVER (PARTITION BY capture_id ORDER BY ordinal ROWS UNBOUNDED PRECEDING) AS seg FROM a1),
runs AS (SELECT capture_id, seg, ordinal, elem_key, lag(elem_key) OVER (PARTITION BY capture_id, seg ORDER BY ordinal) AS before FROM a2 WHERE is_run),
starts AS (SELECT * FROM runs WHERE before IS NULL OR before <> elem_key),
a3 AS (SELECT a.*, (SELECT count(*) FROM starts s WHERE s.capture_id = a.capture_id AND s.seg = a.seg AND s.ordinal <= a.ordinal) AS idx,
  (SELECT arg_min(s.elem_key, s.ordinal) FROM starts s WHERE s.capture_id = a.capture_id AND s.seg = a.seg AND s.ordinal > a.ordinal) AS nxt FROM a2 a),
a4 AS (SELECT *, CASE WHEN is_run THEN 1 WHEN is_held THEN 2 ELSE 0 END AS kind FROM a3),
a5 AS (SELECT *, max(ordinal) OVER w AS lst, CASE WHEN kind = 2 THEN min(ordinal) OVER w ELSE ordinal END AS fst FROM a4 WINDOW w AS (PARTITION BY capture_id, seg, idx, kind, elem_key)),
merged AS (SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY seg, CASE WHEN kind = 0 THEN -1 ELSE idx END, kind, fst) AS o2 FROM a5 WHERE kind = 0 OR (ordinal = lst AND (kind = 1 OR nxt IS NULL OR nxt <> elem_key)))
"""


@query(MERGED + "SELECT capture_id, pos, o2 AS ordinal_2 FROM merged")
def coalesce_inputs(spark, d):
    return reduce.coalesce_inputs(ordered(spark, d)).select("capture_id", "pos", "ordinal_2")


def _one(sql: str) -> str:
    """The SQL with all users' events in one capture."""
    return sql.replace("SELECT user_id AS capture_id, event_id AS pos", "SELECT CAST(0 AS BIGINT) AS capture_id, event_id AS pos")


def giant(spark, d):
    """All users' events as one capture, too long for a task."""
    return capture(spark, d).withColumn("capture_id", F.lit(0).cast("long"))


@query(_one(ORDERED) + "SELECT capture_id, pos, ordinal FROM ordered")
def order_events_in_chunks(spark, d):
    return chunked.order_events(giant(spark, d)).select("capture_id", "pos", "ordinal")


@query(_one(MERGED) + "SELECT capture_id, pos, o2 AS ordinal_2 FROM merged")
def coalesce_inputs_in_chunks(spark, d):
    return chunked.coalesce_inputs(chunked.order_events(giant(spark, d))).select("capture_id", "pos", "ordinal_2")


BUBBLED = MERGED + f""", b1 AS (SELECT *, lead(type) OVER w AS ltype, lead({CONTROL}) OVER w AS lcontrol, lead(t) OVER w - t AS gap FROM merged WINDOW w AS (PARTITION BY capture_id ORDER BY o2)),
bubbled AS (SELECT * EXCLUDE (ltype, lcontrol, gap) FROM b1 WHERE NOT coalesce(type = 'click' AND NOT {CONTROL} AND ltype = 'click' AND lcontrol AND gap BETWEEN 0 AND {ECHO}, false)),
c1 AS (SELECT *, lead(type) OVER (PARTITION BY capture_id ORDER BY o2) AS ltype, count(*) OVER (PARTITION BY capture_id) AS cnt FROM bubbled),
scrolled AS (SELECT * EXCLUDE (ltype, cnt) FROM c1 WHERE NOT (type = 'scroll' AND (ltype IS NULL OR ltype = 'scroll') AND cnt >= 2)),
d1 AS (SELECT *, lag(url) OVER w AS burl, lag(t) OVER w AS bt FROM scrolled WINDOW w AS (PARTITION BY capture_id ORDER BY o2)),
moved AS (SELECT capture_id, o2, type, t, value, false AS synthetic, url FROM d1 UNION ALL SELECT capture_id, o2, 'navigate', bt + 1, NULL, true, url FROM d1 WHERE burl <> url AND url <> ''),
out AS (SELECT * FROM moved WHERE NOT (type = 'keydown' AND NOT coalesce(regexp_matches(value, '(?i)(ctrl|control|alt|meta|cmd|shift)\\s*\\+'), false)))
"""


def merged(spark, d):
    return reduce.coalesce_inputs(ordered(spark, d)).drop("ordinal").withColumnRenamed("ordinal_2", "ordinal")


@query(BUBBLED + "SELECT capture_id, pos FROM bubbled")
def drop_bubbling(spark, d):
    return reduce.drop_bubbling(merged(spark, d), within_ms=ECHO).select("capture_id", "pos")


@query(BUBBLED + "SELECT capture_id, pos FROM scrolled")
def drop_scroll(spark, d):
    return reduce.drop_scroll(reduce.drop_bubbling(merged(spark, d), within_ms=ECHO)).select("capture_id", "pos")


@query(BUBBLED + "SELECT capture_id, o2 AS ordinal, type, t, synthetic FROM moved")
def synth_navigate(spark, d):
    return reduce.synth_navigate(reduce.drop_scroll(reduce.drop_bubbling(merged(spark, d), within_ms=ECHO))).select("capture_id", "ordinal", "type", "t", "synthetic")


@query(BUBBLED + "SELECT capture_id, o2 AS ordinal, type, t, synthetic FROM out")
def reduce_noise(spark, d):
    return reduce.reduce(ordered(spark, d), within_ms=ECHO).select("capture_id", "ordinal", "type", "t", "synthetic")


@query(BUBBLED + """SELECT r.capture_id, r.n AS n_raw, coalesce(o.n, 0) AS n_out, r.n - coalesce(m.n, 0) AS n_coalesced, coalesce(m.n, 0) - coalesce(b.n, 0) AS n_bubbling, coalesce(b.n, 0) - coalesce(s.n, 0) AS n_scroll, coalesce(v.n, 0) - coalesce(o.n, 0) AS n_keydown, coalesce(v.k, 0) AS n_navigate
FROM (SELECT capture_id, count(*) AS n FROM ordered GROUP BY 1) r LEFT JOIN (SELECT capture_id, count(*) AS n FROM merged GROUP BY 1) m USING (capture_id) LEFT JOIN (SELECT capture_id, count(*) AS n FROM bubbled GROUP BY 1) b USING (capture_id)
LEFT JOIN (SELECT capture_id, count(*) AS n FROM scrolled GROUP BY 1) s USING (capture_id) LEFT JOIN (SELECT capture_id, count(*) AS n, count(*) FILTER (synthetic) AS k FROM moved GROUP BY 1) v USING (capture_id) LEFT JOIN (SELECT capture_id, count(*) AS n FROM out GROUP BY 1) o USING (capture_id)""")
def reduction_report(spark, d):
    return reduce.reduction_report(ordered(spark, d), within_ms=ECHO)


@query(f"""WITH {duck("capture")}, l AS (SELECT *, lead(t) OVER (PARTITION BY capture_id, elem_key, type = 'input' ORDER BY t, pos) - t AS gap FROM capture) SELECT capture_id, pos FROM l WHERE NOT coalesce(type = 'input' AND gap <= {24 * HOUR}, false)""")
def debounce(spark, d):
    return reduce.debounce(capture(spark, d), 24 * HOUR, order="pos").select("capture_id", "pos")


# -- actions and selectors ----------------------------------------------------------------------

KIND = """CASE type WHEN 'click' THEN CASE WHEN (tag IN ('button', 'input') AND elem_type = 'submit') OR lower(trim(coalesce(label, ''))) IN ('save', 'submit', 'next', 'finish', 'create', 'update', 'apply', 'confirm') THEN 'submit' ELSE 'click' END
  WHEN 'input' THEN 'input' WHEN 'change' THEN 'input' WHEN 'navigate' THEN 'navigate' WHEN 'scroll' THEN 'scroll' WHEN 'keydown' THEN 'hotkey' ELSE 'click' END"""
ACTED = ORDERED + f""", acted AS (SELECT capture_id, row_number() OVER w AS sequence, 'step-' || lpad(CAST(row_number() OVER w AS VARCHAR), CAST(greatest(3, length(CAST(row_number() OVER w AS VARCHAR))) AS INT), '0') AS step_id, t - first_value(t) OVER w AS timestamp_ms, t,
  {KIND} AS action_type,
  CASE WHEN tag = 'button' OR (tag = 'input' AND elem_type IN ('button', 'submit')) THEN 'button:' WHEN tag IN ('input', 'textarea', 'select') THEN 'input:' WHEN tag = 'a' THEN 'link:' ELSE 'text:' END
    || coalesce(nullif(trim(label), ''), nullif(trim(elem_name), ''), nullif(trim(elem_key), ''), tag || '#' || CAST(seq AS VARCHAR)) AS target,
  value_redacted OR coalesce(elem_type, '') = 'password' AS sensitive, CASE WHEN NOT (value_redacted OR coalesce(elem_type, '') = 'password') THEN value END AS value,
  coalesce(nullif(trim(label), ''), nullif(trim(elem_name), ''), nullif(trim(elem_key), ''), 'field') AS field, url
  FROM ordered WINDOW w AS (PARTITION BY capture_id ORDER BY ordinal))
"""


@query(ACTED + """SELECT capture_id, sequence, step_id, timestamp_ms, action_type, target, sensitive, value,
  CASE WHEN action_type IN ('input', 'select') THEN CASE WHEN sensitive THEN 'Set ' || field || ' (redacted)' WHEN value IS NOT NULL THEN 'Set ' || field || ' to ' || value END WHEN action_type = 'submit' THEN 'Submit form' END AS inferred_intent FROM acted""")
def to_actions(spark, d):
    return actions.to_actions(ordered(spark, d)).drop("weak_target")


@query(ACTED + "SELECT capture_id, sequence, t AS absolute_ms, timestamp_ms FROM acted")
def wall_clock(spark, d):
    events = ordered(spark, d)
    return actions.wall_clock(actions.to_actions(events), actions.to_evidence(events)).select("capture_id", "sequence", "absolute_ms", "timestamp_ms")


@query(ORDERED + """SELECT capture_id, 'rec-' || substr(sha256(string_agg(concat_ws('|', type, CAST(t AS VARCHAR), elem_key, url), chr(10) ORDER BY ordinal)), 1, 16) AS recording_id FROM ordered WHERE ordinal <= 100 GROUP BY capture_id""")
def recording_id(spark, d):
    return actions.recording_id(ordered(spark, d))


@query(f"WITH {duck('capture')} SELECT {KIND} AS action_type, tag, count(*) AS n FROM capture GROUP BY ALL")
def action_types(spark, d):
    kind = actions.action_type(F.col("type"), F.col("tag"), F.col("elem_type"), F.lit(None).cast("string"), F.col("label"))
    return capture(spark, d).groupBy(kind.alias("action_type"), "tag").agg(F.count("*").alias("n"))


def _signals():
    c, null = F.col, F.lit(None).cast("string")
    css = F.concat(F.lit("div >>> "), F.repeat(F.lit("ul li "), (c("k") % 4).cast("int")), F.when(c("k") % 2 == 0, "li:nth-child(2) ").otherwise(""), c("tag"))
    return {
        "test_id": F.when(c("k") % 8 == 0, c("elem_key")),
        "role": F.when(c("k") % 5 == 1, F.lit("button")),
        "role_name": c("label"),
        "aria": F.when(c("k") % 6 == 1, c("label")),
        "label_for": null,
        "sf_field": F.when(c("k") % 7 == 3, c("elem_name")),
        "text": c("label"),
        "css_path": css,
        "xpath": null,
        "elem_id": F.concat(F.lit("input-"), c("k").cast("string")),
    }


CANDIDATES = f"""WITH {duck("capture")}, p AS (SELECT *, replace(concat('div >>> ', repeat('ul li ', CAST(k % 4 AS INT)), CASE WHEN k % 2 = 0 THEN 'li:nth-child(2) ' ELSE '' END, tag), ' >>> ', ' ') AS css FROM capture),
q AS (SELECT capture_id, pos, unnest([
  {{'tier': 1, 'less': -0.95::DOUBLE, 'n': 0, 's': CASE WHEN k % 8 = 0 THEN elem_key END}},
  {{'tier': 2, 'less': -0.95::DOUBLE, 'n': 1, 's': CASE WHEN k % 5 = 1 THEN CASE WHEN coalesce(label, '') <> '' THEN 'role=button[name="' || label || '"]' ELSE 'role=button' END END}},
  {{'tier': 3, 'less': -0.85::DOUBLE, 'n': 2, 's': CASE WHEN k % 6 = 1 THEN label END}},
  {{'tier': 5, 'less': -0.80::DOUBLE, 'n': 4, 's': CASE WHEN k % 7 = 3 THEN '[data-field="' || elem_name || '"]' END}},
  {{'tier': 5, 'less': -0.80::DOUBLE, 'n': 5, 's': CASE WHEN k % 7 = 3 THEN '[field-name="' || elem_name || '"]' END}},
  {{'tier': 5, 'less': -0.80::DOUBLE, 'n': 6, 's': CASE WHEN k % 7 = 3 THEN '[name="' || elem_name || '"]' END}},
  {{'tier': 6, 'less': -0.60::DOUBLE, 'n': 7, 's': 'text="' || nullif(trim(label), '') || '"'}},
  {{'tier': 7, 'less': -round(0.35 - CASE WHEN length(css) - length(replace(css, ' ', '')) > 4 THEN 0.05 ELSE 0 END - CASE WHEN contains(css, 'nth-child') THEN 0.05 ELSE 0 END - 0.10, 2)::DOUBLE, 'n': 8, 's': css}}]) AS c FROM p),
ranked AS (SELECT capture_id, pos, c.tier AS tier, -c.less AS confidence, c.s AS selector, row_number() OVER (PARTITION BY capture_id, pos ORDER BY c.tier, c.less, c.n) - 1 AS rank FROM q WHERE coalesce(c.s, '') <> '')
"""


@query(CANDIDATES + "SELECT capture_id, pos, rank, tier, round(confidence, 2) AS confidence, selector FROM ranked")
def selector_explain(spark, d):
    ranked = capture(spark, d).withColumn("ranked", selectors.rank_selectors(_signals()))
    return selectors.selector_explain(ranked, "ranked", ["capture_id", "pos"]).select("capture_id", "pos", "rank", "tier", F.round("confidence", 2).alias("confidence"), "selector")


@query(CANDIDATES + "SELECT capture_id, CASE WHEN tier <= 2 THEN 'strong' WHEN tier <= 5 THEN 'moderate' ELSE 'weak' END AS health, count(*) AS n FROM ranked WHERE rank = 0 GROUP BY ALL")
def selector_health(spark, d):
    ranked = capture(spark, d).withColumn("ranked", selectors.rank_selectors(_signals()))
    return selectors.health_distribution(ranked, "ranked").withColumnRenamed("count", "n")


@query(CANDIDATES + "SELECT capture_id, pos, selector AS best FROM ranked WHERE rank = 0")
def best_selector(spark, d):
    return capture(spark, d).select("capture_id", "pos", selectors.best_selector(selectors.rank_selectors(_signals())).alias("best"))


# -- integrity --------------------------------------------------------------------------------

SIGNAL = """CASE k % 13 WHEN 0 THEN 'user_password' WHEN 1 THEN 'Card Number' WHEN 2 THEN 'shipping_pin' WHEN 3 THEN 'spinner' WHEN 4 THEN 'Social-Security' ELSE coalesce(elem_name, '') END"""
HIT = """CASE name WHEN 'user_password' THEN 'password' WHEN 'Card Number' THEN 'card_number' WHEN 'shipping_pin' THEN 'pin' WHEN 'Social-Security' THEN 'social_security' END"""


def signed(spark, d):
    return capture(spark, d).withColumn("name", F.expr(SIGNAL))


@query(f"WITH {duck('capture')}, s AS (SELECT *, {SIGNAL} AS name FROM capture) SELECT capture_id, pos, {HIT} AS pattern FROM s WHERE {HIT} IS NOT NULL")
def sensitive_identity(spark, d):
    return signed(spark, d).select("capture_id", "pos", quality.sensitive_pattern(F.col("name")).alias("pattern")).filter("pattern is not null")


#: Lines that could not be read: most of every tenth capture's, a few of others', none of the rest.
REJECTED = "CASE WHEN capture_id % 10 = 0 THEN k % 5 <> 1 WHEN capture_id % 10 < 5 THEN k % 5 = 0 ELSE false END"
#: Identity signals besides the name, and texts that may tell of the organisation.
LABEL = "CASE WHEN k % 37 = 5 THEN 'Passport no' ELSE label END"
ELEMENT = "CASE WHEN k % 41 = 7 THEN 'x-api_key' ELSE elem_key END"
NOTE = "CASE k WHEN 77 THEN 'see https://other.example.test/x' WHEN 78 THEN 'mail bob@corp.example.test' WHEN 79 THEN 'id 0015g00000AbCdEFG' WHEN 80 THEN 'see https://APP.example.test/y' END"
TITLE = "CASE k WHEN 83 THEN 'Ann (ann@org.example.test)' WHEN 84 THEN 'http://app.example.test and http://b.app.example.test' END"
#: Where a line stands in its capture: its time and number.
PLACE = "t * 1000000 + pos"
_hit = lambda name, text, hit: f"CASE WHEN {text} THEN ' {name}~{hit}' ELSE '' END"

FINDINGS = f"""WITH {duck("capture")}, l AS (SELECT *, {REJECTED} AS rejected, {PLACE} AS line, {SIGNAL} AS name FROM capture), g AS (SELECT * FROM l WHERE NOT rejected),
mono AS (SELECT capture_id, line, ingest_seq, lag(ingest_seq) OVER (PARTITION BY capture_id ORDER BY line) AS b FROM g WHERE ingest_seq IS NOT NULL),
n AS (SELECT capture_id, count(*) FILTER (NOT rejected) AS n_events, count(*) FILTER (rejected) AS n_rejects, CASE WHEN capture_id % 4 <> 0 THEN greatest(capture_id % 90 - count(*) FILTER (NOT rejected), 0) END AS gap FROM l GROUP BY capture_id),
findings AS (SELECT capture_id, 'redaction_leak' AS "check", 'SECURITY CRITICAL' AS severity, CAST(pos AS VARCHAR) AS detail FROM g WHERE value_redacted AND value IS NOT NULL
UNION ALL SELECT * FROM (SELECT capture_id, 'sensitive_identity', 'SECURITY CRITICAL', CAST(pos AS VARCHAR) || CASE WHEN elem_type = 'password' THEN ' element.type=password' ELSE '' END || CASE WHEN {HIT} IS NOT NULL THEN ' name~' || {HIT} ELSE '' END
  || {_hit("label", "k % 37 = 5", "passport")} || {_hit("elem_key", "k % 41 = 7", "api_key")} AS detail FROM g WHERE value IS NOT NULL) WHERE contains(detail, ' ')
UNION ALL SELECT capture_id, 'broken_clock', 'CRITICAL', CAST(count(*) AS VARCHAR) FROM g GROUP BY capture_id HAVING count(*) > 1 AND min(t) = max(t)
UNION ALL SELECT capture_id, 'monotonic', 'CRITICAL', CAST(min(line) AS VARCHAR) FROM mono WHERE ingest_seq <= b GROUP BY capture_id
UNION ALL SELECT c_custkey, 'empty', 'CRITICAL', 'no events' FROM customer WHERE c_custkey NOT IN (SELECT capture_id FROM g)
UNION ALL SELECT capture_id, 'manifest_count', 'CRITICAL', 'claimed ' || CAST(capture_id % 90 AS VARCHAR) || ', found ' || CAST(n_events AS VARCHAR) FROM n WHERE capture_id % 4 <> 0 AND n_events <> capture_id % 90
UNION ALL SELECT capture_id, 'sink_errors', 'CRITICAL', '2' FROM n WHERE capture_id % 4 <> 0 AND capture_id % 6 = 1
UNION ALL SELECT * FROM (SELECT capture_id, 'data_loss', CASE WHEN n_events = 0 OR n_rejects >= 0.5 * (n_events + n_rejects) THEN 'DATA LOSS' WHEN n_rejects > 0 OR coalesce(gap, 0) > 0 THEN 'EVIDENCE INCOMPLETE' END AS severity, CAST(n_rejects AS VARCHAR) || ' ' || coalesce(CAST(gap AS VARCHAR), 'unknown') FROM n) WHERE severity IS NOT NULL
UNION ALL SELECT capture_id, 'frame_url', 'WARNING', CAST(pos AS VARCHAR) FROM g WHERE k % 17 = 0 AND k % 34 <> 0
UNION ALL SELECT capture_id, 'org_leak', 'CRITICAL', CAST(pos AS VARCHAR) || CASE k WHEN 77 THEN ' note url' WHEN 78 THEN ' note username' WHEN 79 THEN ' note record_id' WHEN 83 THEN ' title username' ELSE ' title url' END FROM g WHERE k IN (77, 78, 79, 83, 84))
"""


def trace_lines(spark, d):
    made = {"rejected": REJECTED, "line": PLACE, "name": SIGNAL, "label": LABEL, "elem_key": ELEMENT, "note": NOTE, "title": TITLE, "frame_path": "CASE WHEN k % 17 = 0 THEN array('frame') ELSE array() END", "frame_url": "CASE WHEN k % 34 = 0 THEN url END"}
    return capture(spark, d).withColumns({k: F.expr(v) for k, v in made.items()})


def trace_manifests(spark, d):
    claimed = {"event_count": "capture_id % 90", "sink_errors": "CASE WHEN capture_id % 6 = 1 THEN 2 ELSE 0 END"}
    return capture(spark, d).select("capture_id").distinct().filter("capture_id % 4 <> 0").withColumns({k: F.expr(v) for k, v in claimed.items()})


def trace_captures(spark, d):
    return read(spark, d, "customer").select(F.col("c_custkey").alias("capture_id"))


#: What the checks look at, and how long a part of a capture is (30 days, in PLACE).
SIGNALS, TEXTS, DOMAIN, PART = ["name", "label", "elem_key"], ["note", "title"], "example.test", 30 * 86_400_000 * 1_000_000


def findings(spark, d):
    return integrity.validate(trace_lines(spark, d), trace_manifests(spark, d), trace_captures(spark, d), SIGNALS, TEXTS, DOMAIN, part_lines=PART)


@query(FINDINGS + 'SELECT capture_id, "check", severity, detail FROM findings')
def validate_trace(spark, d):
    return findings(spark, d)


@query(FINDINGS + """SELECT capture_id, count(*) FILTER (severity = 'SECURITY CRITICAL') AS n_security_critical, count(*) FILTER (severity = 'DATA LOSS') AS n_data_loss, count(*) FILTER (severity = 'CRITICAL') AS n_critical,
  count(*) FILTER (severity = 'EVIDENCE INCOMPLETE') AS n_evidence_incomplete, count(*) FILTER (severity = 'WARNING') AS n_warning, bool_or(severity IN ('SECURITY CRITICAL', 'DATA LOSS')) AS rejected FROM findings GROUP BY capture_id""")
def severity_counts(spark, d):
    return quality.severity_counts(findings(spark, d))


@query(FINDINGS + "SELECT capture_id, pos FROM capture c WHERE NOT EXISTS (SELECT 1 FROM findings f WHERE f.capture_id = c.capture_id AND f.severity IN ('SECURITY CRITICAL', 'DATA LOSS'))")
def fatal_gate(spark, d):
    return quality.fatal_gate(capture(spark, d), findings(spark, d)).select("capture_id", "pos")


STATS = f"""WITH {duck("capture")}, n AS (SELECT capture_id, count(*) FILTER (k % 5 <> 0) AS n_events, count(*) FILTER (k % 5 = 0) AS n_rejects FROM capture GROUP BY capture_id),
stats AS (SELECT capture_id, n_events, n_rejects, n_events + n_rejects AS n_lines, CASE WHEN n_events + n_rejects > 0 THEN n_rejects::DOUBLE / (n_events + n_rejects) ELSE 0 END AS loss_ratio,
  CASE WHEN capture_id % 4 <> 0 THEN capture_id % 90 END AS event_count, CASE WHEN capture_id % 4 <> 0 THEN greatest(capture_id % 90 - n_events, 0) END AS gap FROM n)
"""


def stats(spark, d):
    events = capture(spark, d)
    manifests = events.select("capture_id").distinct().filter("capture_id % 4 <> 0").withColumn("event_count", F.col("capture_id") % 90)
    return quality.manifest_gap(quality.loss_stats(events.filter("k % 5 <> 0"), events.filter("k % 5 = 0")), manifests)


@query(STATS + "SELECT capture_id, n_events, n_rejects, n_lines, round(loss_ratio, 6) AS loss_ratio, gap FROM stats")
def loss_stats(spark, d):
    return stats(spark, d).select("capture_id", "n_events", "n_rejects", "n_lines", F.round("loss_ratio", 6).alias("loss_ratio"), "gap")


@query(STATS + """SELECT * FROM (SELECT capture_id, 'data_loss' AS "check", CASE WHEN n_events = 0 OR loss_ratio >= 0.2 THEN 'DATA LOSS' WHEN n_rejects > 0 OR coalesce(gap, 0) > 0 THEN 'EVIDENCE INCOMPLETE' END AS severity, CAST(n_rejects AS VARCHAR) || ' ' || coalesce(CAST(gap AS VARCHAR), 'unknown') AS detail FROM stats) WHERE severity IS NOT NULL""")
def data_loss(spark, d):
    return quality.check_data_loss(stats(spark, d), most=0.2)


@query(STATS + "SELECT capture_id, n_rejects = 0 AND coalesce(gap, 0) = 0 AS complete FROM stats")
def evidence_completeness(spark, d):
    return quality.evidence_completeness(stats(spark, d)).select("capture_id", "complete")


@query(f"WITH {duck('capture')}, s AS (SELECT *, {SIGNAL} AS name FROM capture) SELECT capture_id, count(*) FILTER (value_redacted) AS n_redacted, count(*) FILTER (value IS NOT NULL AND (coalesce(elem_type = 'password', false) OR {HIT} IS NOT NULL OR value_redacted)) AS n_suspect FROM s GROUP BY capture_id")
def redaction_audit(spark, d):
    return quality.redaction_audit(signed(spark, d), ["name"])


@query("""SELECT s_suppkey % 25 AS surface, count(l.l_orderkey) AS n_rows, CASE WHEN s_suppkey % 25 % 7 = 0 THEN 'FAILED' WHEN s_suppkey % 25 % 5 = 0 THEN 'UNAVAILABLE' WHEN count(l.l_orderkey) > 0 THEN 'OBSERVED' ELSE 'EMPTY' END AS status,
  (CASE WHEN s_suppkey % 25 % 7 = 0 THEN 'FAILED' WHEN s_suppkey % 25 % 5 = 0 THEN 'UNAVAILABLE' WHEN count(l.l_orderkey) > 0 THEN 'OBSERVED' ELSE 'EMPTY' END) = 'OBSERVED' AS is_evidence
FROM (SELECT DISTINCT s_suppkey % 25 AS s_suppkey FROM supplier) LEFT JOIN lineitem l ON l.l_suppkey = s_suppkey GROUP BY s_suppkey""")
def source_coverage(spark, d):
    surfaces = read(spark, d, "supplier").select((F.col("s_suppkey") % 25).alias("surface")).distinct().withColumn("failed", F.col("surface") % 7 == 0).withColumn("available", F.col("surface") % 5 != 0)
    return quality.source_coverage(surfaces, read(spark, d, "lineitem").select(F.col("l_suppkey").alias("surface")))


@query("SELECT s_suppkey, regexp_replace(lower(s_name), '[^a-z0-9]', '', 'g') AS bare, contains(regexp_replace(lower(s_name), '[^a-z0-9]', '', 'g'), 'supplier00000000') OR contains(regexp_replace(lower(s_name), '[^a-z0-9]', '', 'g'), '7') AS denied FROM supplier")
def deny_list(spark, d):
    return read(spark, d, "supplier").select("s_suppkey", F.regexp_replace(F.lower("s_name"), "[^a-z0-9]", "").alias("bare"), redaction.deny_list_hit(F.col("s_name"), ["supplier00000000", "7"]).alias("denied"))


@query(r"""SELECT page_id, CASE WHEN regexp_matches(html, '(?i)\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.example\.com\b') THEN 'username'
  WHEN len(list_filter(regexp_extract_all(lower(html || ' ' || url), 'https?://([a-z0-9.\-]+\.example\.com)', 1), lambda x: x <> 'blog.example.com')) > 0 THEN 'url' END AS leak FROM pages""")
def org_leak(spark, d):
    pages = read(spark, d, "pages")
    return pages.select("page_id", quality.org_leak(F.concat_ws(" ", "html", "url"), F.lit("blog.example.com"), "example.com", ("QQQ",)).alias("leak"))


@query(f"WITH {duck('log')} SELECT capture_id, CASE WHEN count(*) FILTER (status = 'x') > 0 THEN 'AVAILABLE' WHEN 800000000000 - max(t) < 25 * {HOUR} THEN 'EMPTY_RECENT' ELSE 'EMPTY_STALE' END AS availability FROM (SELECT capture_id, t, CASE WHEN quantity > 48 AND capture_id % 3 = 0 THEN 'x' END AS status FROM log) GROUP BY capture_id")
def log_availability(spark, d):
    found = log(spark, d).groupBy("capture_id").agg(F.count_if((F.col("quantity") > 48) & (F.col("capture_id") % 3 == 0)).alias("n"), F.max("t").alias("end"))
    return found.select("capture_id", quality.log_availability(F.col("n"), F.col("end"), F.lit(800_000_000_000)).alias("availability"))


@query(f"""WITH {duck("capture", "telemetry")}, runs AS (SELECT DISTINCT capture_id, CASE WHEN capture_id % 3 = 0 THEN 'mock' ELSE 'live' END AS mode, CASE WHEN capture_id % 5 = 0 THEN 'mock' ELSE 'capture' END AS ext FROM capture),
o AS (SELECT capture_id, count(*) AS n FROM telemetry GROUP BY 1),
p AS (SELECT r.capture_id, r.ext, CASE WHEN mode = 'live' THEN CASE WHEN coalesce(n, 0) > 0 THEN 'live' ELSE 'unavailable' END ELSE mode END AS telemetry_source FROM runs r LEFT JOIN o USING (capture_id))
SELECT capture_id, telemetry_source, concat_ws(',', CASE WHEN ext = 'mock' THEN 'extraction' END, CASE WHEN telemetry_source = 'mock' THEN 'telemetry' END) AS simulated FROM p""")
def resolve_provenance(spark, d):
    events = capture(spark, d)
    runs = events.select("capture_id").distinct().withColumn("telemetry_mode", F.when(F.col("capture_id") % 3 == 0, "mock").otherwise("live")).withColumn("extraction_source", F.when(F.col("capture_id") % 5 == 0, "mock").otherwise("capture"))
    return quality.resolve_provenance(runs, telemetry(spark, d))


# -- redaction --------------------------------------------------------------------------------

LUHN = """list_sum([CASE WHEN (length(x) - i) % 2 = 1 THEN CASE WHEN CAST(x[i] AS INT) * 2 > 9 THEN CAST(x[i] AS INT) * 2 - 9 ELSE CAST(x[i] AS INT) * 2 END ELSE CAST(x[i] AS INT) END for i in range(1, length(x) + 1)]) % 10 = 0"""
CARDS = rf"""list_filter(list_transform(regexp_extract_all(text, '\b[0-9\s-]{{13,23}}\b'), lambda y: regexp_replace(y, '[\s-]', '', 'g')), lambda x: length(x) BETWEEN 13 AND 19 AND {LUHN})"""
IDS = r"""list_filter(regexp_extract_all(text, '[\p{L}\p{N}\p{M}_]+'), lambda x: regexp_full_match(x, '[A-Za-z0-9]{15}') OR regexp_full_match(x, '[A-Za-z0-9]{18}') AND upper(x[16:18]) = list_aggregate([('ABCDEFGHIJKLMNOPQRSTUVWXYZ012345')[1 + list_sum([CASE WHEN x[5 * p + i + 1] BETWEEN 'A' AND 'Z' THEN 1 << i ELSE 0 END for i in range(0, 5)])::INT] for p in range(0, 3)], 'string_agg', ''))"""
SSNS = r"""list_filter(regexp_extract_all(text, '\b[0-8][0-9]{2}-[0-9]{2}-[0-9]{4}\b'), lambda x: x[1:3] NOT IN ('000', '666') AND x[5:6] <> '00' AND x[8:11] <> '0000')"""
#: Headers of tokens are of one block of base64 each or longer; those of the tables decode to text.
JWTS = r"""list_filter(regexp_extract_all(text, '\beyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\b'), lambda x: contains(CAST(from_base64(rpad(translate(split_part(x, '.', 1), '-_', '+/'), CAST(4 * ceil(length(split_part(x, '.', 1)) / 4) AS INT), '=')) AS VARCHAR), '"alg"'))"""
CATEGORIES = rf"""SELECT doc_id, unnest([CASE WHEN regexp_matches(text, '\b00D[A-Za-z0-9]{{12,15}}![A-Za-z0-9._-]+\b') THEN 'sf_session_token' END, CASE WHEN len({JWTS}) > 0 THEN 'jwt' END,
  CASE WHEN regexp_matches(text, '-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]+-----END [A-Z ]*PRIVATE KEY-----') THEN 'private_key' END, CASE WHEN regexp_matches(text, '\b(?:AKIA|ASIA)[A-Z0-9]{{16}}\b') THEN 'aws_key' END,
  CASE WHEN regexp_matches(text, '\bgh[pousr]_[A-Za-z0-9]{{36,}}\b') THEN 'github_token' END, CASE WHEN regexp_matches(text, '\bxox[baprs]-[A-Za-z0-9-]+\b') THEN 'slack_token' END, CASE WHEN regexp_matches(text, '\bBearer\s+[A-Za-z0-9._-]{{20,}}\b') THEN 'bearer_token' END,
  CASE WHEN len({CARDS}) > 0 THEN 'credit_card' END, CASE WHEN len({SSNS}) > 0 THEN 'ssn' END, CASE WHEN regexp_matches(text, '\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{{2,}}\b') THEN 'email' END,
  CASE WHEN regexp_matches(text, '\b(\+?1[-.\s]?)?\(?\d{{3}}\)?[-.\s]?\d{{3}}[-.\s]?\d{{4}}\b') THEN 'phone' END, CASE WHEN len({IDS}) > 0 THEN 'sf_record_id' END]) AS category FROM documents"""


@query(f"SELECT doc_id, category FROM ({CATEGORIES}) WHERE category IS NOT NULL")
def secret_categories(spark, d):
    return read(spark, d, "documents").select("doc_id", F.explode(redaction.text_categories(F.col("text"))).alias("category"))


@query()
def redact_text(spark, d):
    return read(spark, d, "documents").select("doc_id", F.md5(redaction.redact_text(F.col("text"))).alias("digest"))


@query(r"""SELECT page_id, regexp_replace(url, '(?i)([?&#])(ref|page)=([^&#\s]+)', '\1\2=[REDACTED:url_credential]', 'g') AS url, regexp_matches(url, '(?i)[?&#](?:ref|page)=[^&#\s]+') AS hit FROM pages""")
def redact_url(spark, d):
    return read(spark, d, "pages").select("page_id", redaction.redact_url(F.col("url"), ("ref", "page")).alias("url"), redaction.url_has_credential(F.col("url"), ("ref", "page")).alias("hit"))


@query(f"SELECT category, count(*) AS n FROM ({CATEGORIES}) WHERE category IS NOT NULL GROUP BY category")
def redaction_report(spark, d):
    found = read(spark, d, "documents").withColumn("c", redaction.text_categories(F.col("text")))
    return redaction.redaction_report(found, "c")


@query(rf"""SELECT c_custkey, regexp_matches(field, '(?i)pass(?:word)?|secret|token|card[_\s-]?number|\bpin\b') AS sensitive, CASE WHEN regexp_matches(field, '(?i)pass(?:word)?|secret|token|card[_\s-]?number|\bpin\b') THEN '[REDACTED:sensitive_field]' ELSE c_name END AS value
FROM (SELECT *, CASE c_custkey % 6 WHEN 0 THEN 'user_password' WHEN 1 THEN 'Card Number' WHEN 2 THEN 'the pin code' WHEN 3 THEN 'spinach' WHEN 4 THEN 'Company' ELSE 'api-token' END AS field FROM customer)""")
def redact_value(spark, d):
    rows = read(spark, d, "customer").withColumn("field", F.expr("CASE c_custkey % 6 WHEN 0 THEN 'user_password' WHEN 1 THEN 'Card Number' WHEN 2 THEN 'the pin code' WHEN 3 THEN 'spinach' WHEN 4 THEN 'Company' ELSE 'api-token' END"))
    return rows.select("c_custkey", redaction.is_sensitive_field(F.col("field")).alias("sensitive"), redaction.redact_value(F.col("c_name"), F.col("field")).alias("value"))


# -- backend records ----------------------------------------------------------------------------

LAYER = """CASE WHEN contains(upper(event_type), 'BULK') OR contains(upper(event_type), 'ASYNC') THEN 'async' WHEN contains(upper(event_type), 'APEX') THEN 'apex' WHEN upper(event_type) IN ('API', 'URI', 'RESTAPI') THEN 'network'
  WHEN contains(upper(event_type), 'VALIDATION') THEN 'validation' WHEN contains(upper(event_type), 'FLOW') THEN 'flow' WHEN contains(upper(event_type), 'LIGHTNING') THEN 'ui' ELSE 'network' END"""
STATUS = "CASE WHEN lower(trim(raw_status)) IN ('1', 'true') THEN 'success' WHEN lower(trim(raw_status)) IN ('0', 'false') THEN 'error' ELSE lower(trim(raw_status)) END"


@query(f"WITH {duck('log')} SELECT capture_id, {LAYER} AS layer, {STATUS} AS status, count(*) AS n, sum(quantity) AS quantity FROM log GROUP BY ALL")
def telemetry_layers(spark, d):
    return log(spark, d).groupBy("capture_id", records.telemetry_layer(F.col("event_type")).alias("layer"), records.status_normalise(F.col("raw_status")).alias("status")).agg(F.count("*").alias("n"), F.sum("quantity").alias("quantity"))


@query(f"""WITH {duck('log')}, r AS (SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY t DESC, request_id DESC, line_no DESC) AS n FROM log)
SELECT capture_id, bool_or({STATUS} NOT IN ('success', 'completed')) AS failed, count(*) AS n_logs FROM r WHERE n <= 5 GROUP BY capture_id""")
def failed_log_signal(spark, d):
    return records.failed_log_signal(log(spark, d).withColumn("status", records.status_normalise(F.col("raw_status"))), ["capture_id"], ["t", "request_id", "line_no"])


SNAP = f"""WITH {duck("history")}, kept AS (SELECT * FROM history WHERE field NOT IN ('created', 'feedEvent', 'locked', 'unlocked') AND t IS NOT NULL),
lst AS (SELECT capture_id, record_id, t, field, arg_max(struct_pack(o := old_value, n := new_value), row_no) AS v FROM kept GROUP BY ALL)
"""


@query(SNAP + "SELECT capture_id, record_id, t, string_agg(field, ',' ORDER BY field) AS fields, string_agg(field || '=' || coalesce(v.o, '~') || '>' || coalesce(v.n, '~'), ';' ORDER BY field) AS change FROM lst GROUP BY ALL")
def history_snapshots(spark, d):
    snaps = records.history_snapshots(history(spark, d))
    change = F.array_join(F.transform("changed_fields", lambda f: F.concat(f, F.lit("="), F.coalesce(F.element_at("before", f), F.lit("~")), F.lit(">"), F.coalesce(F.element_at("after", f), F.lit("~")))), ";")
    return snaps.select("capture_id", "record_id", "t", F.array_join("changed_fields", ",").alias("fields"), change.alias("change"))


@query(f"WITH {duck('history')} SELECT capture_id, record_id, t, field || ' changed' AS event_name, old_value, new_value FROM history WHERE field NOT IN ('created', 'feedEvent', 'locked', 'unlocked') AND t IS NOT NULL")
def history_events(spark, d):
    return records.history_events(history(spark, d)).select("capture_id", "record_id", "t", "event_name", "old_value", "new_value")


@query(SNAP + """, rws AS (SELECT DISTINCT capture_id, t, record_id, field FROM lst WHERE field NOT IN ('LastModifiedDate', 'IsDeleted')), f AS (SELECT capture_id, field, min((t, record_id)) AS o FROM rws GROUP BY ALL)
SELECT capture_id, string_agg(field, ',' ORDER BY o, field) AS fields FROM f GROUP BY capture_id""")
def changed_fields(spark, d):
    return records.changed_fields(records.history_snapshots(history(spark, d)))


@query(f"WITH {duck('history')}, f AS (SELECT capture_id, record_id, min(t) AS t FROM history GROUP BY ALL) SELECT capture_id, string_agg(record_id, ',' ORDER BY t, record_id) AS objects FROM f GROUP BY capture_id")
def objects_touched(spark, d):
    return records.objects_touched(history(spark, d), "record_id", "t")


@query("""WITH o AS (SELECT o_custkey, o_orderkey, o_orderdate, CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE o_orderstatus END AS s, CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE o_orderpriority END AS p, o_orderkey % 6 <> 0 AS filled FROM orders),
b AS (SELECT *, last_value(CASE WHEN filled THEN struct_pack(s := s, p := p) END IGNORE NULLS) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM o)
SELECT o_custkey, o_orderkey, concat_ws(',', CASE WHEN filled AND (prev IS NULL OR prev.p <> p) THEN 'priority' END, CASE WHEN filled AND (prev IS NULL OR prev.s <> s) THEN 'status' END) AS changed FROM b""")
def record_diff(spark, d):
    filled = F.create_map(F.lit("status"), F.col("o_orderstatus"), F.lit("priority"), F.col("o_orderpriority"))
    states = read(spark, d, "orders").withColumn("state", F.when(F.col("o_orderkey") % 6 != 0, filled).otherwise(F.create_map().cast("map<string,string>")))
    return records.record_diff(states, "state", ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", F.array_join("changed", ",").alias("changed"))


@query(f"WITH {duck('attempt')} SELECT CASE error WHEN 'TimeoutError' THEN 'TIMEOUT' WHEN 'no locator matched: #save' THEN 'ELEMENT_NOT_FOUND' WHEN 'Target closed' THEN 'TARGET_CLOSED' WHEN 'element is detached' THEN 'STALE_REFERENCE' WHEN 'navigation interrupted' THEN 'TRANSIENT_NAVIGATION' WHEN 'boom' THEN 'UI_RUNTIME_ERROR' END AS code, count(*) AS n FROM attempt GROUP BY ALL")
def ui_error_codes(spark, d):
    return attempt(spark, d).groupBy(records.ui_error_code(F.col("error")).alias("code")).agg(F.count("*").alias("n"))


@query(f"""WITH {duck("history", "capture")}, kept AS (SELECT * FROM history WHERE field NOT IN ('created', 'feedEvent', 'locked', 'unlocked') AND t IS NOT NULL),
lst AS (SELECT capture_id, object_name, record_id, t, field, arg_max(struct_pack(o := old_value), row_no) AS v FROM kept GROUP BY ALL),
sn AS (SELECT capture_id, object_name, record_id, t, count(v.o) = 0 AS none FROM lst GROUP BY ALL),
ob AS (SELECT capture_id, arg_min(object_name, (t, record_id)) AS ob, count(DISTINCT object_name) AS n, bool_or(none) AS created FROM sn GROUP BY 1),
fl AS (SELECT capture_id, field, row_number() OVER (PARTITION BY capture_id ORDER BY t, record_id, field) AS k FROM lst WHERE field NOT IN ('LastModifiedDate', 'IsDeleted')),
fs AS (SELECT capture_id, string_agg(field, ', ' ORDER BY k) AS fields FROM (SELECT capture_id, field, min(k) AS k FROM fl WHERE k <= 3 GROUP BY ALL) GROUP BY 1),
cp AS (SELECT capture_id, bool_or(type IN ('submit', 'input', 'select')) AS writes FROM capture GROUP BY 1)
SELECT cp.capture_id,
  CASE WHEN fields IS NOT NULL THEN CASE WHEN created THEN 'Create ' ELSE 'Update ' END || ob || ' (' || fields || ')' WHEN ob IS NOT NULL THEN 'Interact with ' || ob || ' via guided process'
    WHEN writes THEN 'Complete a data-entry process (target object unresolved)' ELSE 'UNRESOLVED: recording did not demonstrate a completed business action' END AS intent,
  CASE WHEN fields IS NOT NULL AND n = 1 THEN 0.7::DOUBLE WHEN fields IS NOT NULL THEN 0.5 WHEN ob IS NOT NULL THEN 0.4 WHEN writes THEN 0.2 ELSE 0.05 END AS confidence
FROM cp LEFT JOIN ob USING (capture_id) LEFT JOIN fs USING (capture_id)""")
def derive_intent(spark, d):
    # a history knows no record without fields: a state without values stands for one that was not there
    snaps = records.history_snapshots(history(spark, d), keys=["capture_id", "object_name"]).withColumn("before", F.map_filter("before", lambda k, v: v.isNotNull()))
    captures = capture(spark, d).groupBy("capture_id").agg(F.max(F.col("type").isin(*records.WRITES)).alias("has_writes"))
    return records.derive_intent(captures, snaps, ["t", "record_id"])


# -- names --------------------------------------------------------------------------------------

TOKENS = r"list_filter(string_split(regexp_replace(regexp_replace(regexp_replace(p_name || ' ' || p_brand, '[^A-Za-z0-9]+', ' ', 'g'), '([a-z0-9])([A-Z])', '\1 \2', 'g'), '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g'), ' '), lambda w: w <> '')"


@query(f"SELECT p_partkey, lower(array_to_string({TOKENS}, '_')) AS snake, array_to_string(list_transform({TOKENS}, lambda w: upper(w[1]) || w[2:]), '_') AS topic, array_to_string(list_transform({TOKENS}, lambda w, i: CASE WHEN i = 1 THEN lower(w) ELSE upper(w[1]) || lower(w[2:]) END), '') AS camel, 'x_' || lower(array_to_string({TOKENS}, '_')) AS prefixed FROM part")
def names(spark, d):
    label = F.concat_ws(" ", "p_name", "p_brand")
    return read(spark, d, "part").select("p_partkey", naming.snake_case(label).alias("snake"), naming.topic_api_name(label).alias("topic"), naming.camel_name(label).alias("camel"), naming.prefixed_name("x_", label).alias("prefixed"))


PART_NAME = "CASE WHEN p_partkey % 11 = 0 THEN 'System' WHEN p_partkey % 13 = 0 THEN concat(repeat('long', 20), '_', lower(split_part(p_type, ' ', 1))) ELSE lower(split_part(p_type, ' ', 1)) END"


@query(f"""WITH n AS (SELECT p_partkey, p_size, {PART_NAME} AS name FROM part), k AS (SELECT *, row_number() OVER (PARTITION BY p_size, lower(name) ORDER BY p_partkey) + CASE WHEN name = 'System' OR length(name) > 74 THEN 1 ELSE 0 END AS i FROM n WHERE p_partkey % 13 <> 0 OR p_partkey % 11 = 0)
SELECT p_partkey, name || CASE WHEN i > 1 THEN '_' || CAST(i AS VARCHAR) ELSE '' END AS unique_name FROM k
UNION ALL SELECT p_partkey, name[1:73 - length(CAST(i AS VARCHAR))] || '_' || CAST(i AS VARCHAR) FROM (SELECT *, row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) + 1 AS i FROM n WHERE p_partkey % 13 = 0 AND p_partkey % 11 <> 0)""")
def dedupe_names(spark, d):
    """Names that are taken, too long or equal; long ones that differ behind the limit share their numbers."""
    named = read(spark, d, "part").select("p_partkey", "p_size", F.expr(PART_NAME).alias("name"))
    return naming.dedupe_names(named, ["p_size"], "p_partkey", "name").select("p_partkey", "unique_name")


# -- rounds and verdicts ------------------------------------------------------------------------

W = "OVER (PARTITION BY capture_id ORDER BY version)"
ROUNDS = f"WITH {duck('round')} "


@query(ROUNDS + f"SELECT capture_id, version, score - lag(score) {W} AS delta, coalesce(score = lag(score) {W} AND score = lag(score, 2) {W}, false) AS plateau FROM round")
def round_plateau(spark, d):
    return rounds.round_plateau(rounds.compare_scores(round_(spark, d))).select("capture_id", "version", "delta", "plateau")


@query(ROUNDS + f""", b AS (SELECT *, max(score) OVER (PARTITION BY capture_id ORDER BY version ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM round), i AS (SELECT *, sum(CASE WHEN best IS NULL OR score > best THEN 1 ELSE 0 END) OVER (PARTITION BY capture_id ORDER BY version ROWS UNBOUNDED PRECEDING) AS isl FROM b)
SELECT capture_id, version, row_number() OVER (PARTITION BY capture_id, isl ORDER BY version) - 1 AS streak, row_number() OVER (PARTITION BY capture_id, isl ORDER BY version) - 1 >= 3 AS stuck FROM i""")
def no_improvement_streak(spark, d):
    return rounds.no_improvement_streak(round_(spark, d)).select("capture_id", "version", "streak", "stuck")


STALL = ROUNDS + f", dd AS (SELECT *, score - lag(score) {W} AS dl FROM round), s AS (SELECT *, coalesce(abs(dl) < 5 AND abs(lag(dl) {W}) < 5, false) AS stall, coalesce(dl < 0, false) AS regression, row_number() {W} AS n, max(version) OVER (PARTITION BY capture_id) AS lastv FROM dd)"


@query(STALL + " SELECT capture_id, version, stall, regression FROM s")
def convergence_stall(spark, d):
    return rounds.convergence_stall(round_(spark, d)).select("capture_id", "version", "stall", "regression")


@query(STALL + ", r AS (SELECT *, CASE WHEN score >= 75 AND NOT blocked THEN 'passed' WHEN regression THEN 'regression' WHEN stall THEN 'converged' WHEN n >= 5 OR version = lastv THEN 'max_rounds' END AS reason FROM s) SELECT capture_id, arg_min(reason, version) AS reason, min(version) AS stopped_at FROM r WHERE reason IS NOT NULL GROUP BY capture_id")
def stop_reason(spark, d):
    return rounds.stop_reason(round_(spark, d))


BEST = "row_number() OVER (PARTITION BY capture_id ORDER BY blocked, score DESC, version)"


@query(ROUNDS + f"SELECT capture_id, version, score FROM (SELECT *, {BEST} AS n FROM round) WHERE n = 1")
def pick_best(spark, d):
    return rounds.pick_best(round_(spark, d)).select("capture_id", "version", "score")


@query(ROUNDS + f"SELECT capture_id, version, coalesce(score > lag(score) {W} AND n_unknowns < lag(n_unknowns) {W}, false) AS suspicious FROM round")
def unknowns_dropped_guard(spark, d):
    return rounds.unknowns_dropped_guard(round_(spark, d)).select("capture_id", "version", "suspicious")


@query(ROUNDS + f"SELECT capture_id, version, score, score - lag(score) {W} AS delta, max(score) OVER (PARTITION BY capture_id ORDER BY version ROWS UNBOUNDED PRECEDING) AS best_so_far, {BEST} = 1 AS is_best FROM round")
def iteration_report(spark, d):
    return rounds.iteration_report(round_(spark, d)).select("capture_id", "version", "score", "delta", "best_so_far", "is_best")


#: Some rounds are gone: their versions are missing from the numbering.
LOST = "(version + capture_id) % 5 = 2"


@query(ROUNDS + f"SELECT capture_id, version, step FROM (SELECT capture_id, version, version - lag(version) {W} AS step FROM round WHERE NOT ({LOST})) WHERE step <> 1")
def version_check(spark, d):
    return rounds.version_check(round_(spark, d).filter(f"not ({LOST})"))


@query(ROUNDS + f"SELECT capture_id, version, lag(score) {W} AS before, coalesce(score > lag(score) {W}, false) AND score < 75 AS rose_on_failure, score >= 75 OR NOT coalesce(score > lag(score) {W}, false) AS trustworthy FROM round")
def eval_round(spark, d):
    return evaluate.eval_round(round_(spark, d).withColumn("passed", F.col("score") >= 75)).select("capture_id", "version", "before", "rose_on_failure", "trustworthy")


@query(f"WITH {duck('verdict')} SELECT capture_id, case_id, count(*) AS n_outcomes, count(*) FILTER (is_pass) AS n_passed, count(*) FILTER (is_pass IS NULL) AS n_no_verdict, count(*) FILTER (is_pass) = count(*) AS passed FROM verdict GROUP BY ALL")
def case_passed(spark, d):
    return evaluate.case_passed(verdict(spark, d), ["capture_id", "case_id"])


@query(f"WITH {duck('verdict')}, c AS (SELECT capture_id, case_id, count(*) AS n, count(*) FILTER (is_pass) AS p FROM verdict GROUP BY ALL) SELECT capture_id, count(*) AS n_cases, count(*) FILTER (n = p) AS n_cases_passed, CAST(sum(n) AS BIGINT) AS n_evaluations, CAST(sum(p) AS BIGINT) AS n_evaluations_passed FROM c GROUP BY capture_id")
def status_rollup(spark, d):
    return evaluate.status_rollup(verdict(spark, d))


@query(f"WITH {duck('verdict')} SELECT evaluator, CASE WHEN is_pass IS NULL THEN 'NO VERDICT' WHEN is_pass THEN 'PASS' ELSE 'FAIL' END AS finding, count(*) AS n FROM verdict GROUP BY ALL")
def feedback_findings(spark, d):
    return evaluate.feedback_findings(verdict(spark, d)).groupBy("evaluator", "finding").agg(F.count("*").alias("n"))


@query("SELECT n_nationkey, n_regionkey FROM nation WHERE n_regionkey NOT IN (SELECT r_regionkey FROM region WHERE r_regionkey % 2 = 0)")
def name_integrity(spark, d):
    names_there = read(spark, d, "region").filter("r_regionkey % 2 = 0")
    return evaluate.name_integrity(read(spark, d, "nation"), names_there, "n_regionkey", "r_regionkey", []).select("n_nationkey", "n_regionkey")


# -- gate ---------------------------------------------------------------------------------------

SIGNATURE = "list_sort(list_distinct(list_filter(regexp_split_to_array(lower(coalesce(line, '')), '[^a-z0-9]+'), lambda w: w <> '' AND w NOT IN ('a', 'an', 'the', 'this', 'that', 'these', 'those', 'is', 'are', 'was', 'were', 'be', 'been', 'being', 'and', 'or', 'but', 'for', 'to', 'of', 'on', 'in', 'at', 'by', 'with', 'from', 'as', 'so', 'if', 'then', 'than', 'now', 'here', 'there', 'again', 'also', 'just', 'very', 'really', 'please', 'kindly', 'safely', 'it', 'its', 'we', 'you', 'they', 'do', 'does', 'did', 'done', 'will', 'would', 'should', 'could', 'may', 'might', 'can'))))"


@query(f"""WITH l AS (SELECT source, unnest(string_split(text, chr(10))) AS line FROM documents), s AS (SELECT source, line, {SIGNATURE} AS sg FROM l)
SELECT source, array_to_string(sg, ' ') AS signature, count(DISTINCT trim(line)) AS n_texts, count(*) AS n_rows FROM s WHERE len(sg) >= 2 GROUP BY ALL HAVING count(DISTINCT trim(line)) > 1""")
def near_duplicate_lines(spark, d):
    lines = read(spark, d, "documents").select("source", F.explode(F.split("text", "\n")).alias("line"))
    return score.near_duplicates(lines, "line", ["source"])


@query(f"SELECT doc_id, array_to_string(list_filter({list(score.MARKERS)}, lambda m: contains(coalesce(text, ''), m)), ',') AS markers FROM documents")
def placeholder_scan(spark, d):
    return read(spark, d, "documents").select("doc_id", F.array_join(score.placeholder_scan(F.col("text")), ",").alias("markers"))


GATED = """WITH g AS (SELECT o_orderkey, CASE WHEN o_totalprice > 100000 THEN 40 ELSE 0 END + CASE WHEN o_orderstatus = 'F' THEN 25 ELSE 0 END + CASE WHEN o_orderkey % 2 = 0 THEN 35 ELSE 0 END AS score, o_orderkey % 7 = 0 AS blocked FROM orders)"""


@query(GATED + " SELECT o_orderkey, score, score >= 75 AND NOT blocked AS passed, CASE WHEN score >= 75 THEN 'high' WHEN score >= 60 THEN 'moderate' ELSE 'low' END AS band, CASE WHEN blocked THEN least(score, 59) ELSE score END AS display FROM g")
def weighted_gate(spark, d):
    flags = {"price": (F.col("o_totalprice") > 100000, 40), "status": (F.col("o_orderstatus") == "F", 25), "even": (F.col("o_orderkey") % 2 == 0, 35)}
    scored = read(spark, d, "orders").withColumn("score", score.weighted_gate(flags))
    gates = score.gate(F.col("score"), F.when(F.col("o_orderkey") % 7 == 0, 1).otherwise(0))
    return scored.select("o_orderkey", "score", *[c.alias(k) for k, c in gates.items()])


@query("""WITH c AS (SELECT l_orderkey, l_linenumber, l_discount * 10 AS c, CAST(round(l_tax * 100) AS INT) % 3 = 0 AS gaps, l_linenumber % 2 AS unk FROM lineitem)
SELECT l_orderkey, l_linenumber, CAST(CASE WHEN gaps AND cc >= 0.7 THEN 0 WHEN cc < 0.7 AND unk > 0 THEN 20 WHEN gaps THEN 10 WHEN cc > 0.7 THEN 20 - least(round_even((cc - 0.7) / (1.0::DOUBLE - 0.7) * 10, 0), 10) ELSE 20 END AS INT) AS score FROM (SELECT *, greatest(least(c, 1.0), 0.0) AS cc FROM c)""")
def honesty(spark, d):
    rows = read(spark, d, "lineitem")
    return rows.select("l_orderkey", "l_linenumber", score.honesty(F.col("l_discount") * 10, F.col("l_linenumber") % 2, F.round(F.col("l_tax") * 100).cast("int") % 3 == 0).alias("score"))


@query("""SELECT o_orderkey, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderstatus = 'F' THEN 5 ELSE 0 END AS score, NOT (o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderstatus = 'F') AND NOT (o_orderpriority = '5-LOW' AND o_orderstatus = 'P') AS blocked FROM orders""")
def provenance(spark, d):
    extraction = F.when(F.col("o_orderpriority") == "1-URGENT", "dom-capture").when(F.col("o_orderpriority") == "2-HIGH", "cv").when(F.col("o_orderpriority") == "5-LOW", None).otherwise("capture")
    source = F.when(F.col("o_orderstatus") == "F", "live-org").when(F.col("o_orderstatus") == "P", None).otherwise("mock")
    told = score.provenance(extraction, source)
    return read(spark, d, "orders").select("o_orderkey", told["score"].alias("score"), told["blocked"].alias("blocked"))


@query("SELECT l_orderkey, l_linenumber, l_shipmode_source = 'run-eval' AND l_quantity > 0 AS is_real FROM (SELECT *, CASE l_returnflag WHEN 'R' THEN 'run-eval' WHEN 'A' THEN 'sandbox' END AS l_shipmode_source FROM lineitem) WHERE l_returnflag <> 'N' UNION ALL SELECT l_orderkey, l_linenumber, false FROM lineitem WHERE l_returnflag = 'N'")
def feedback_is_real(spark, d):
    source = F.when(F.col("l_returnflag") == "R", "run-eval").when(F.col("l_returnflag") == "A", "sandbox")
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", evaluate.feedback_is_real(source, F.col("l_quantity")).alias("is_real"))


@query("SELECT p_partkey, lower(split_part(p_type, ' ', 1)) IN ('standard', 'small') AS reserved FROM part")
def reserved_names(spark, d):
    # part types stand for names, two of them for taken ones
    kind = F.lower(F.split_part("p_type", F.lit(" "), F.lit(1)))
    label = F.when(kind == "standard", "Off Topic").when(kind == "small", "startAgent").otherwise(F.concat(F.lit("class "), kind))
    return read(spark, d, "part").select("p_partkey", naming.is_reserved(label).alias("reserved"))


@query("SELECT l_suppkey AS capture_id, l_returnflag AS object_name, l_linestatus AS field_name, count(*) AS n_claims, count(DISTINCT l_partkey) AS n_details, count(*) > 3 AS padding FROM lineitem GROUP BY ALL")
def field_claim_counts(spark, d):
    rows = read(spark, d, "lineitem").select(F.col("l_suppkey").alias("capture_id"), F.col("l_returnflag").alias("object_name"), F.col("l_linestatus").alias("field_name"), F.col("l_partkey").alias("detail"))
    return score.field_claim_counts(rows)


# -- specifications -------------------------------------------------------------------------------

CHANGES = MATCH.replace("\nm AS", f"\n{duck('capture')},\nm AS", 1) + """, ch AS (SELECT capture_id, sequence, place, 'Obj' || CAST(event_no % 3 AS VARCHAR) AS object_name, layer AS field, confidence FROM o),
acts AS (SELECT capture_id, pos AS sequence, CASE WHEN type IN ('input', 'change') THEN 'input' ELSE type END AS action_type, 'input:' || CASE WHEN k % 2 = 0 THEN 'Flow' ELSE 'other_' || CAST(k % 3 AS VARCHAR) END AS target FROM capture)
"""


def changes(spark, d):
    placed = correlate.correlation_order(resolved(spark, d))
    return placed.select("capture_id", "sequence", "place", F.concat(F.lit("Obj"), (F.col("event_no") % 3).cast("string")).alias("object_name"), F.col("layer").alias("field"), "confidence")


def acts(spark, d):
    target = F.concat(F.lit("input:"), F.when(F.col("k") % 2 == 0, "Flow").otherwise(F.concat(F.lit("other_"), (F.col("k") % 3).cast("string"))))
    return capture(spark, d).select("capture_id", F.col("pos").alias("sequence"), F.when(F.col("type").isin("input", "change"), "input").otherwise(F.col("type")).alias("action_type"), target.alias("target"))


@query(CHANGES + """, fl AS (SELECT capture_id, object_name, field, min((sequence, place)) AS o, arg_min(confidence, (sequence, place)) AS c, bool_or(confidence = 'AMBIGUOUS') AS ambiguous FROM ch GROUP BY ALL),
en AS (SELECT capture_id, field AS name, object_name, field, o, CASE WHEN c IN ('HIGH', 'TEMPORAL') THEN 'data-delta' ELSE 'inference' END AS source, ambiguous, 0 AS kind FROM fl
  UNION ALL SELECT capture_id, 'recordId', arg_min(object_name, (sequence, place)), 'Id', min((sequence, place)), 'inference', false, 1 FROM ch GROUP BY capture_id),
rk AS (SELECT *, row_number() OVER (PARTITION BY capture_id, name ORDER BY kind DESC, o DESC, object_name DESC) AS n FROM en),
ui AS (SELECT capture_id, CASE target WHEN 'input:Flow' THEN 'flow' ELSE 'other' || right(target, 1) END AS name, count(*) AS u FROM acts WHERE action_type = 'input' GROUP BY ALL)
SELECT coalesce(r.capture_id, u.capture_id) AS capture_id, coalesce(r.name, u.name) AS name, r.object_name AS object_api_name, r.field AS field_api_name, r.source AS first_source, CASE WHEN r.name IS NULL THEN 0 ELSE 1 END + coalesce(u.u, 0) AS n_evidence, coalesce(r.ambiguous, false) AS ambiguous
FROM rk r FULL JOIN ui u ON r.capture_id = u.capture_id AND r.name = u.name AND r.n = 1""")
def derive_entities(spark, d):
    found = specs.entities(changes(spark, d), acts(spark, d))
    first = F.get("evidence", F.lit(0))["source"]
    return found.select("capture_id", "name", "object_api_name", "field_api_name", F.when(first != "ui-action", first).alias("first_source"), F.size("evidence").alias("n_evidence"), "ambiguous")


@query(CHANGES + """, st AS (SELECT capture_id, sequence, string_agg(DISTINCT layer, ', ' ORDER BY layer) AS layers, bool_or(layer = 'flow') AS flow FROM o GROUP BY ALL),
fo AS (SELECT capture_id, arg_min(object_name, (sequence, place)) AS ob FROM ch GROUP BY 1),
ln AS (SELECT a.capture_id, string_agg('act on ' || a.step_id || CASE WHEN st.layers IS NOT NULL THEN ' -> writes ' || st.layers || ' (backend: ' || st.layers || ')' ELSE '' END, chr(10) ORDER BY a.sequence) AS body, coalesce(bool_or(st.flow), false) AS flow FROM action a LEFT JOIN st ON st.capture_id = a.capture_id AND st.sequence = a.sequence GROUP BY 1)
SELECT ln.capture_id, CASE WHEN ob IS NOT NULL THEN 'Resolve and load the target ' || ob || ' record; confirm the caller may act on it.' || chr(10) ELSE '' END || body || CASE WHEN flow THEN chr(10) || 'Invoke the equivalent Flow rather than reproducing its logic in the agent.' ELSE '' END || chr(10) || 'Return a confirmation that names the record and the fields changed.' AS steps
FROM ln LEFT JOIN fo USING (capture_id)""")
def orchestration_steps(spark, d):
    found = changes(spark, d)
    rolled = found.groupBy("capture_id", "sequence").agg(F.array_sort(F.collect_set("field")).alias("layers")).withColumn("fields", F.col("layers"))
    done = action(spark, d).select("capture_id", "sequence", F.lit("act").alias("action_type"), F.col("step_id").alias("target"))
    made = specs.orchestration_steps(done, rolled, specs.first_objects(found))
    return made.select("capture_id", F.array_join("orchestration_steps", "\n").alias("steps"))


@query(MATCH + """, bad AS (SELECT capture_id, layer, arg_min(CASE WHEN event_no % 3 <> 0 THEN 'event ' || CAST(event_no AS VARCHAR) END, CASE WHEN event_no % 3 <> 0 THEN event_no END) AS reason FROM o WHERE status = 'error' GROUP BY ALL),
rl AS (SELECT capture_id, string_agg('Observed ' || layer || ' failure during recording: ' || coalesce(reason, 'no detail captured'), chr(10) ORDER BY layer) || CASE WHEN bool_or(layer = 'validation') THEN chr(10) || 'On validation error, return the offending field and message; do not auto-correct.' ELSE '' END AS lines FROM bad GROUP BY 1)
SELECT c.capture_id, coalesce(rl.lines, 'No failures were observed in this run, so error paths are UNTESTED. Record a failing variant before relying on this spec.') AS failure_handling FROM (SELECT DISTINCT capture_id FROM action) c LEFT JOIN rl USING (capture_id)""")
def failure_handling(spark, d):
    bad = resolved(spark, d).filter("status = 'error'").select("capture_id", F.col("event_no").alias("sequence"), "layer", F.when(F.col("event_no") % 3 != 0, F.concat(F.lit("event "), F.col("event_no").cast("string"))).alias("reason"))
    made = specs.failure_handling(bad, action(spark, d).select("capture_id").distinct())
    return made.select("capture_id", F.array_join("failure_handling", "\n").alias("failure_handling"))


def spec_frame(spark, d):
    found, done = changes(spark, d), acts(spark, d)
    captures = done.select("capture_id").distinct()
    entities = specs.entities(found, done).groupBy("capture_id").agg(F.array_sort(F.collect_list(F.struct("name", "object_api_name", "field_api_name", "evidence"))).alias("entities"), F.count_if("ambiguous").alias("n_ambiguous"))
    rolled = found.groupBy("capture_id", "sequence").agg(F.array_sort(F.collect_set("field")).alias("layers")).withColumn("fields", F.col("layers"))
    first = specs.first_objects(found)
    steps = specs.orchestration_steps(action(spark, d).select("capture_id", "sequence", F.lit("act").alias("action_type"), F.col("step_id").alias("target")), rolled, first)
    layers = found.groupBy("capture_id").agg(F.array_sort(F.collect_set("field")).alias("_layers"), F.array_sort(F.collect_set("object_name")).alias("_objects"))
    counted = action(spark, d).groupBy("capture_id").agg(F.count("*").alias("_n"))
    bad = resolved(spark, d).filter("status = 'error'").select("capture_id", F.col("event_no").alias("sequence"), "layer", F.lit("seen").alias("reason"))
    failures = specs.failure_handling(bad, captures)
    none = F.array().cast("array<string>")
    joined = captures.join(entities, "capture_id", "left").join(steps, "capture_id", "left").join(first, "capture_id", "left").join(layers, "capture_id", "left").join(failures, "capture_id", "left").join(counted, "capture_id", "left")
    return joined.select(
        "capture_id",
        F.concat(F.lit("Update "), F.coalesce("first_object", F.lit("UNRESOLVED:")), F.lit(" record fields")).alias("intent"),
        F.when(F.col("first_object").isNotNull(), 0.7).otherwise(0.05).alias("confidence"),
        F.when(F.col("first_object").isNotNull(), F.array("first_object")).otherwise(none).alias("objects_touched"),
        F.coalesce("entities", F.array().cast("array<struct<name:string,object_api_name:string,field_api_name:string,evidence:array<struct<source:string,detail:string>>>>")).alias("entities"),
        F.coalesce("orchestration_steps", none).alias("orchestration_steps"),
        specs.guardrails(F.col("first_object"), F.coalesce("_layers", none), F.coalesce("_layers", none)).alias("guardrails"),
        "failure_handling",
        specs.unknowns(F.lit(0), none, F.col("first_object").isNotNull(), F.size(F.coalesce("entities", F.array().cast("array<struct<name:string,object_api_name:string,field_api_name:string,evidence:array<struct<source:string,detail:string>>>>"))), F.size(F.coalesce("_layers", none))).alias("unknowns"),
        specs.evidence_trail(F.col("_layers"), F.col("_n"), F.col("_objects")).alias("evidence"),
        F.lit("dom-capture").alias("extraction_source"),
        F.when(F.col("first_object").isNotNull(), "live-org").otherwise("unavailable").alias("telemetry_source"),
    )


@query()
def score_derived_spec(spark, d):
    return specs.score_spec(spec_frame(spark, d)).select("capture_id", *specs.POINTS, "total", F.array_join("blockers", ",").alias("blockers"), "passed", "band", "display")


@query(CHANGES + """SELECT a.capture_id, concat_ws(chr(10), 'telemetry: backend layers observed: ' || l, 'extraction: ' || n || ' action(s) in recording', 'data-delta: objects mutated: ' || ob) AS trail
FROM (SELECT capture_id, count(*) AS n FROM action GROUP BY 1) a LEFT JOIN (SELECT capture_id, string_agg(DISTINCT field, ', ' ORDER BY field) AS l, string_agg(DISTINCT object_name, ', ' ORDER BY object_name) AS ob FROM ch GROUP BY 1) USING (capture_id)""")
def evidence_trail(spark, d):
    seen = changes(spark, d).groupBy("capture_id").agg(F.array_sort(F.collect_set("field")).alias("layers"), F.array_sort(F.collect_set("object_name")).alias("objects"))
    counted = action(spark, d).groupBy("capture_id").agg(F.count("*").alias("n"))
    trail = specs.evidence_trail(F.col("layers"), F.col("n"), F.col("objects"))
    return counted.join(seen, "capture_id", "left").select("capture_id", F.array_join(F.transform(trail, lambda x: F.concat(x["source"], F.lit(": "), x["detail"])), "\n").alias("trail"))


# -- what an agent is told --------------------------------------------------------------------------

BRIEF = """WITH en AS (SELECT l_orderkey AS capture_id, list(struct_pack(name := name, field := nullif(field, '')) ORDER BY ln, name, field) AS entities FROM (SELECT l_orderkey, l_linenumber AS ln,
  CASE WHEN l_linenumber = 1 THEN 'recordId' WHEN l_quantity > 25 THEN 'F' ELSE 'f' END || CASE WHEN l_linenumber = 1 THEN '' ELSE 'ield' || CAST(l_linenumber % 3 AS VARCHAR) END AS name, CASE WHEN l_returnflag = 'N' THEN '' ELSE 'Field' || CAST(l_linenumber AS VARCHAR) END AS field FROM lineitem) GROUP BY 1),
b AS (SELECT o_orderkey AS capture_id, CASE WHEN o_orderkey % 7 = 0 THEN 'UNRESOLVED: ' || o_orderpriority WHEN o_orderkey % 13 = 0 THEN '(' || o_orderstatus || ')' ELSE CASE WHEN o_orderkey % 3 = 0 THEN 'Close ' ELSE 'Update ' END || o_orderpriority || ' (' || o_orderstatus || ')' END AS intent,
  (o_orderkey % 10) / 10.0 AS confidence, CASE WHEN o_orderkey % 4 <> 0 THEN ['Order'] ELSE [] END AS objects_touched, coalesce(entities, []) AS entities,
  CASE WHEN o_orderkey % 5 = 0 THEN [] ELSE ['open ' || o_orderpriority, 'save ' || o_orderstatus] END AS steps, CASE WHEN o_orderkey % 6 = 0 THEN [] ELSE ['ask before ' || o_orderstatus] END AS rails,
  CASE WHEN o_orderkey % 2 = 0 THEN ['No failures were observed'] ELSE ['Observed flow failure'] END AS failures, CASE WHEN o_orderkey % 8 = 0 THEN ['who may do it'] ELSE [] END AS unknowns
  FROM orders LEFT JOIN en ON en.capture_id = o_orderkey)
"""


def brief(spark, d):
    """Orders as specifications, their line items as entities."""
    line = F.col("l_linenumber").cast("string")
    name = F.when(F.col("l_linenumber") == 1, "recordId").otherwise(F.concat(F.when(F.col("l_quantity") > 25, "F").otherwise("f"), F.lit("ield"), (F.col("l_linenumber") % 3).cast("string")))
    field = F.when(F.col("l_returnflag") == "N", "").otherwise(F.concat(F.lit("Field"), line))
    found = read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(F.struct(F.col("l_linenumber").alias("ln"), name.alias("name"), field.alias("field")))).alias("e"))
    entities = F.transform(F.coalesce("e", F.array().cast("array<struct<ln:int,name:string,field:string>>")), lambda x: F.struct(x["name"].alias("name"), F.lit("Order").alias("object_api_name"), F.nullif(x["field"], F.lit("")).alias("field_api_name")))
    key, texts = F.col("o_orderkey"), lambda c, *lines: F.when(c, F.array(*lines)).otherwise(F.array().cast("array<string>"))
    ended = F.concat(F.lit("("), "o_orderstatus", F.lit(")"))
    asked = F.concat(F.when(key % 3 == 0, "Close ").otherwise("Update "), "o_orderpriority", F.lit(" "), ended)
    return read(spark, d, "orders").join(found, "o_orderkey", "left").select(
        key.alias("capture_id"),
        F.when(key % 7 == 0, F.concat(F.lit("UNRESOLVED: "), "o_orderpriority")).when(key % 13 == 0, ended).otherwise(asked).alias("intent"),
        ((key % 10) / 10.0).alias("confidence"),
        texts(key % 4 != 0, F.lit("Order")).alias("objects_touched"),
        entities.alias("entities"),
        texts(key % 5 != 0, F.concat(F.lit("open "), "o_orderpriority"), F.concat(F.lit("save "), "o_orderstatus")).alias("orchestration_steps"),
        texts(key % 6 != 0, F.concat(F.lit("ask before "), "o_orderstatus")).alias("guardrails"),
        F.array(F.when(key % 2 == 0, "No failures were observed").otherwise("Observed flow failure")).alias("failure_handling"),
        texts(key % 8 == 0, F.lit("who may do it")).alias("unknowns"),
    )


@query(BRIEF + """, t AS (SELECT *, list_sort(list_distinct(list_transform(list_filter(entities, lambda e: e.field IS NOT NULL)[1:5], lambda e: e.name))) AS collected FROM b)
SELECT capture_id, nullif(concat_ws(', ', CASE WHEN intent LIKE 'UNRESOLVED:%' THEN 'intent unresolved' END, CASE WHEN confidence < 0.4 THEN 'confidence too low' END, CASE WHEN len(objects_touched) = 0 THEN 'no object' END), '') AS refused_reason,
CASE WHEN intent LIKE 'UNRESOLVED:%' THEN '[NEEDS EVIDENCE: role could not be derived — intent is unresolved]' ELSE intent || CASE WHEN len(collected) > 0 THEN ' Collect: ' || array_to_string(collected, ', ') || '.' ELSE '' END || ' Confirm before writing, and report the result.' END AS role,
CASE WHEN intent LIKE 'UNRESOLVED:%' THEN '[NEEDS EVIDENCE: topic could not be derived — intent is unresolved]' ELSE
  concat_ws(chr(10), CASE WHEN len(steps) > 0 THEN 'Process:' || chr(10) || '- ' || array_to_string(steps, chr(10) || '- ') END, CASE WHEN len(rails) > 0 THEN chr(10) || 'Guardrails:' || chr(10) || '- ' || array_to_string(rails, chr(10) || '- ') END, CASE WHEN failures[1] NOT LIKE 'No failures%' THEN chr(10) || 'Error handling:' || chr(10) || '- ' || failures[1] END) END AS topic_description,
concat_ws(chr(10), CASE WHEN len(steps) > 0 THEN 'Follow these steps:' || chr(10) || '1. ' || steps[1] || chr(10) || '2. ' || steps[2] ELSE '[NEEDS EVIDENCE: No orchestration steps observed in the recording.]' || chr(10) || 'Add instructions for how to process this request.' END,
  CASE WHEN len(entities) > 0 THEN 'Required entities: ' || array_to_string(list_transform(entities, lambda e: e.name), ', ') END, CASE WHEN len(rails) > 0 THEN chr(10) || 'Constraints:' || chr(10) || '  - ' || rails[1] END, chr(10) || 'Error handling:' || chr(10) || '  - ' || failures[1],
  CASE WHEN len(unknowns) > 0 THEN chr(10) || '[NEEDS EVIDENCE: The following was not observed in the recording:]' || chr(10) || '  - ' || unknowns[1] END) AS instructions FROM t""")
def agent_texts(spark, d):
    return prompts.agent_texts(brief(spark, d)).select("capture_id", "refused_reason", "role", "topic_description", "instructions")


@query(BRIEF + """, e AS (SELECT capture_id, nullif(trim(regexp_replace(intent, '\\s*\\([^)]*\\)\\s*$', '')), '') AS base, unnest(entities).name AS name, generate_subscripts(entities, 1) AS i FROM b),
u AS (SELECT capture_id, any_value(base) AS base, min(i) AS i, lower(name) AS key, arg_min(name, i) AS name FROM e GROUP BY capture_id, lower(name)),
ph AS (SELECT b.capture_id, nullif(trim(regexp_replace(b.intent, '\\s*\\([^)]*\\)\\s*$', '')), '') AS base, string_agg('{' || u.name || '}', ' ' ORDER BY u.i) FILTER (u.name <> 'recordId') AS places, arg_min(u.name, u.i) FILTER (u.name <> 'recordId') AS field, coalesce(bool_or(u.name = 'recordId'), false) AS has FROM b LEFT JOIN u ON u.capture_id = b.capture_id GROUP BY ALL),
om AS (SELECT e.capture_id, e.i, e.name, o.name AS other, o.i AS pl, row_number() OVER (PARTITION BY e.capture_id, e.i, lower(o.name) ORDER BY o.i) AS k FROM e LEFT JOIN e o ON o.capture_id = e.capture_id AND o.name <> e.name),
ot AS (SELECT capture_id, i, name, string_agg('{' || other || '}', ' ' ORDER BY pl) FILTER (other <> 'recordId' AND k = 1) AS places FROM om GROUP BY ALL)
SELECT capture_id, 'phrase' AS kind, NULL AS entity, CASE WHEN base IS NULL THEN '[NEEDS EVIDENCE: no intent observed]' WHEN has AND contains(lower(base), 'update') AND field IS NOT NULL THEN 'Update the ' || field || ' on order {recordId} to {' || field || '}' ELSE trim(base || ' ' || coalesce(places, '')) END AS utterance FROM ph
UNION ALL SELECT ot.capture_id, 'omit', ot.name, CASE WHEN ph.base IS NULL THEN '[NEEDS EVIDENCE: no intent observed]' ELSE trim(ph.base || ' ' || coalesce(ot.places, '')) END FROM ot JOIN ph USING (capture_id)
UNION ALL SELECT capture_id, 'invalid', NULL, coalesce(base, '[NEEDS EVIDENCE: no intent observed]') || CASE WHEN has AND base IS NOT NULL THEN ' {recordId} with an invalid value that will fail validation' ELSE ' with an invalid value' END FROM ph""")
def utterances(spark, d):
    return prompts.utterances(brief(spark, d)).drop("case_no")


@query("""WITH r AS (SELECT *, o_orderkey % 11 <> 0 AS spec, o_totalprice > 50000 AS passed, o_orderkey % 9 = 0 AS padding, o_orderpriority = '5-LOW' AS todo FROM orders),
g AS (SELECT *, CASE WHEN o_orderkey % 3 <> 0 THEN 10 ELSE 0 END + CASE WHEN o_orderstatus <> 'P' THEN 15 ELSE 0 END + 15 + CASE WHEN o_orderkey % 10 <> 0 THEN 15 ELSE 0 END + 10 + CASE WHEN todo THEN 0 ELSE 20 END + CASE WHEN spec AND passed AND NOT padding THEN 15 ELSE 0 END AS s,
  concat_ws(',', CASE WHEN o_orderkey % 17 = 0 THEN 'critical issue' END, CASE WHEN todo THEN 'placeholder' END, CASE WHEN NOT spec THEN 'no specification' WHEN padding THEN 'padding' WHEN NOT passed THEN 'specification not passed' END) AS blocking FROM r)
SELECT o_orderkey AS capture_id, s AS gate_score, CASE WHEN s >= 85 THEN 'high' WHEN s >= 60 THEN 'medium' ELSE 'low' END AS gate_band, s >= 85 AND blocking = '' AS gate_passed, blocking FROM g""")
def run_gate(spark, d):
    rows, key = read(spark, d, "orders").withColumn("capture_id", F.col("o_orderkey")), F.col("o_orderkey")
    facts = {"preflight_ok": key % 3 != 0, "execution_ok": F.col("o_orderstatus") != "P", "telemetry_ok": F.lit(True), "artifacts_ok": key % 10 != 0, "negative_tests_ok": F.lit(True), "critical_issue": key % 17 == 0, "output": F.when(F.col("o_orderpriority") == "5-LOW", "TODO").otherwise(F.col("o_orderpriority"))}
    scored = rows.filter(key % 11 != 0).select("capture_id", (F.col("o_totalprice") > 50000).alias("passed"), F.when(key % 9 == 0, F.array(F.lit("padding"))).otherwise(F.array().cast("array<string>")).alias("blockers"))
    gated = score.run_gate(rows.select("capture_id", *[c.alias(k) for k, c in facts.items()]), scored)
    return gated.withColumn("blocking", F.array_join("blocking", ","))
