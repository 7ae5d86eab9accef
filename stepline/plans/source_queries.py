"""Queries of the sources and of the streams, over lines and files that Spark derives from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepline.functions import redaction, redaction_json
from stepline.operators import evaluate, records
from stepline.plans import bindings
from stepline.plans.bindings import duck, read
from stepline.plans.trace_queries import DOMAIN, FINDINGS, HOUR, SIGNALS, TEXTS, capture, query, trace_captures, trace_lines, trace_manifests
from stepline.sources import captures, logs
from stepline.sources.shared import cut, fresh_path
from stepline.streaming import lateness, traces, validation
from stepline.streaming import records as stream_records

#: Of every few events one is a line that can't be read, each in its own way.
LINE = """CASE WHEN k % 13 = 0 THEN concat('{"v": 1, "t": ', CAST(t AS STRING), ', "type": "cl') WHEN k % 17 = 0 THEN '[1, 2]' WHEN k % 19 = 0 THEN '   '
  WHEN k % 23 = 0 THEN concat('{"v": 1, "t": "soon", "type": "click"}') WHEN k % 29 = 0 THEN concat('{"v": 1, "t": ', CAST(t AS STRING), ', "type": "click", "selectors": {"role_name": {"role": 123, "name": "x"}}}')
  ELSE concat('{"v": ', CASE WHEN k % 7 = 1 THEN '2' WHEN k % 7 = 2 THEN '0' WHEN k % 7 = 3 THEN 'null' ELSE '1' END, ', "seq": ', CAST(pos AS STRING), ', "t": ', CAST(t AS STRING), ', "type": "', CASE WHEN k % 11 = 0 THEN 'hover' ELSE type END, '", "_ingest_seq": ', coalesce(CAST(ingest_seq AS STRING), 'null'), ', "selectors": {"role_name": {"role": null, "name": "x"}}}') END"""
REASON = "CASE WHEN k % 13 = 0 THEN 'bad_json' WHEN k % 17 = 0 THEN 'not_an_object' WHEN k % 19 = 0 THEN 'blank' WHEN k % 23 = 0 OR k % 29 = 0 THEN 'schema' END"
LINES = f"WITH {duck('capture')}, lines AS (SELECT *, {REASON} AS reason FROM capture)"


def lines(spark, d):
    return capture(spark, d).select("capture_id", "pos", F.expr(LINE).alias("line")).filter(F.trim("line") != "")


@query(LINES + " SELECT capture_id, reason, count(*) AS n FROM lines WHERE coalesce(reason, '') <> 'blank' AND reason IS NOT NULL GROUP BY ALL")
def read_capture_rejects(spark, d):
    return captures.parse_lines(lines(spark, d))[1].groupBy("capture_id", "reason").agg(F.count("*").alias("n"))


@query(LINES + " SELECT capture_id, pos, t, CASE WHEN k % 11 = 0 THEN 'hover' ELSE type END AS type, ingest_seq, k % 11 <> 0 AS known_type FROM lines WHERE reason IS NULL")
def read_capture(spark, d):
    return captures.parse_lines(lines(spark, d))[0].select("capture_id", "pos", "t", "type", "ingest_seq", "known_type")


@query(LINES + """ SELECT capture_id, row_number() OVER (PARTITION BY capture_id ORDER BY pos) AS line_no, coalesce(reason, 'event') AS kind FROM lines QUALIFY coalesce(reason, '') <> 'blank'""")
def read_capture_files(spark, d):
    """Captures written as files, blank lines too, and read again in splits of Spark's size.

    Files and tasks are as many as the bytes need: a file for each capture costs far more time than its lines.
    """
    path = fresh_path(spark, "captures")
    captures.pack_lines(capture(spark, d).select("capture_id", "pos", F.expr(LINE).alias("line")), path, ["pos"])
    # one pass over the lines tells events and rejects
    told = captures.marked_lines(captures.packed_lines(spark, path))
    return told.select(F.expr("try_cast(capture_id AS BIGINT)").alias("capture_id"), "line_no", F.coalesce("reason", F.lit("event")).alias("kind"))


@query(LINES + " SELECT CASE k % 7 WHEN 1 THEN 'fatal' WHEN 2 THEN 'old' WHEN 3 THEN 'assumed' END AS version_note, count(*) AS n FROM lines WHERE reason IS NULL GROUP BY 1")
def version_gate(spark, d):
    return captures.version_gate(captures.parse_lines(lines(spark, d))[0]).groupBy("version_note").agg(F.count("*").alias("n"))


@query("""SELECT '/c/' || CAST(s_suppkey AS VARCHAR) || '.jsonl' AS path, CASE WHEN s_suppkey % 4 = 0 THEN 'absent' WHEN s_suppkey % 5 = 0 AND s_suppkey % 4 <> 0 THEN 'corrupt' ELSE 'found' END AS manifest_status,
  CASE WHEN s_suppkey % 4 <> 0 THEN s_suppkey * CASE WHEN s_suppkey % 4 IN (1, 3) THEN 1 ELSE 10 END END AS manifest_event_count FROM supplier""")
def pair_manifest(spark, d):
    s = read(spark, d, "supplier")
    name = lambda end: F.concat(F.lit("/c/"), F.col("s_suppkey").cast("string"), F.lit(end))
    files = s.select(name(".jsonl").alias("path"))
    corrupt = (F.col("s_suppkey") % 5 == 0).alias("corrupt")
    plain = s.filter("s_suppkey % 4 in (1, 3)").select(name(".manifest.json").alias("path"), corrupt, F.col("s_suppkey").alias("event_count"))
    longer = s.filter("s_suppkey % 4 in (2, 3)").select(name(".jsonl.manifest.json").alias("path"), corrupt, (F.col("s_suppkey") * 10).alias("event_count"))
    return captures.pair_manifest(files, plain.union(longer))


@query("SELECT page_id, url FROM pages WHERE regexp_matches(url, '(?:/fr/)|(?:blog)')")
def network_events(spark, d):
    return captures.network_events(read(spark, d, "pages").select("page_id", "url"), ["/fr/", "blog"])


@query("SELECT event_id, epoch_us(ts) // 1000 AS ms FROM events")
def clock_units(spark, d):
    ms = F.unix_millis("ts")
    text = F.when(F.col("event_id") % 2 == 0, F.concat(ms.cast("string"), F.lit("000000"))).when(F.col("event_id") % 4 == 1, ms.cast("string")).otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSXXX"))
    return read(spark, d, "events").select("event_id", captures.clock_ms(text).alias("ms"))


@query("SELECT o_custkey, arg_max(CAST(o_orderkey AS VARCHAR), (o_orderdate, CAST(o_orderkey AS VARCHAR))) AS path FROM orders GROUP BY o_custkey")
def latest_capture(spark, d):
    files = read(spark, d, "orders").select("o_custkey", F.col("o_orderkey").cast("string").alias("path"), F.col("o_orderdate").alias("mtime"))
    return captures.latest_capture(files, ["o_custkey"])


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 <> 0 THEN c_mktsegment END AS object, CASE WHEN c_custkey % 3 <> 0 THEN c_name END AS record_id FROM customer")
def track_records(spark, d):
    text = F.when(F.col("c_custkey") % 3 != 0, F.concat_ws(":", "c_mktsegment", "c_name")).otherwise(F.col("c_name"))
    return read(spark, d, "customer").withColumn("r", captures.track_records(text)).select("c_custkey", F.col("r.object").alias("object"), F.col("r.record_id").alias("record_id"))


@query("""SELECT l_orderkey, l_linenumber, 'L' || CAST(l_orderkey AS VARCHAR) AS transaction_id, CASE WHEN l_returnflag = 'R' THEN 'error' WHEN l_returnflag = 'A' THEN 'success' ELSE lower(l_linestatus) END AS status,
  CASE WHEN l_linenumber % 2 = 0 THEN 1 ELSE 2 END AS n_payload FROM lineitem WHERE l_linenumber % 5 <> 0""")
def event_log(spark, d):
    rows = read(spark, d, "lineitem").select(
        F.when(F.col("l_linenumber") % 5 == 0, F.lit("never")).when(F.col("l_linenumber") % 2 == 0, F.date_format("l_shipdate", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")).alias("TIMESTAMP"),
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("EVENT_DATE"),
        F.concat(F.lit("L"), F.col("l_orderkey").cast("string")).alias("REQUEST_ID"),
        F.expr("CASE l_returnflag WHEN 'R' THEN '0' WHEN 'A' THEN '1' ELSE '' END").alias("SUCCESS"),
        F.col("l_linestatus").alias("STATUS"),
        F.lit("ApexExecution").alias("EVENT_TYPE"),
        F.concat_ws("/", "l_orderkey", "l_linenumber").alias("line"),
        F.when(F.col("l_linenumber") % 2 == 1, "odd").otherwise("").alias("oddity"),
    )
    good, _ = records.event_log(rows, ["TIMESTAMP", "EVENT_DATE"], ["REQUEST_ID"], ["SUCCESS", "STATUS"], ["EVENT_TYPE"])
    at = F.split(F.element_at("payload", "line"), "/")
    return good.select(at[0].cast("long").alias("l_orderkey"), at[1].cast("int").alias("l_linenumber"), "transaction_id", "status", F.size("payload").alias("n_payload"))


RESULTS = """concat(CASE WHEN doc_id % 2 = 0 THEN '{"result": ' ELSE '' END, '{"tests": [{"id": "c', CAST(doc_id AS STRING), '", "status": "done", "evaluations": [{"type": "q", "id": "quality", "is_pass": ', CASE WHEN quality = 1 THEN 'true' ELSE 'false' END, ', "score": 0.5}, {"type": "t", "id": "toxic", "is_pass": ', CASE WHEN toxic = 0 THEN 'true' ELSE 'null' END, '}], "outputs": [{"type": "response", "response": "r1"}, {"type": "session", "session_id": "s"}, {"type": "response", "response": "r2"}]}]}', CASE WHEN doc_id % 2 = 0 THEN '}' ELSE '' END)"""


@query("""SELECT doc_id, 'c' || CAST(doc_id AS VARCHAR) AS case_id, 's' AS session_id, 'r1' AS response FROM labels""")
def eval_cases(spark, d):
    raw = read(spark, d, "labels").select("doc_id", F.expr(RESULTS).alias("body"))
    return evaluate.parse_results(raw, keys=["doc_id"])[0].select("doc_id", "case_id", "session_id", "response")


@query("SELECT doc_id, 'quality' AS evaluator, quality = 1 AS is_pass FROM labels UNION ALL SELECT doc_id, 'toxic', CASE WHEN toxic = 0 THEN true END FROM labels")
def eval_outcomes(spark, d):
    raw = read(spark, d, "labels").select("doc_id", F.expr(RESULTS).alias("body"))
    return evaluate.parse_results(raw, keys=["doc_id"])[1].select("doc_id", "evaluator", "is_pass")


@query("""SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN '{"session_id": "[REDACTED]", "url": "https://x/?sid=[REDACTED]&a=1"}' ELSE '{"name": "' || c_name || '"}' END AS body FROM customer""")
def redact_session_ids(spark, d):
    body = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit('{"session_id": "'), F.col("c_name"), F.lit('", "url": "https://x/?sid='), F.col("c_custkey").cast("string"), F.lit('&a=1"}'))).otherwise(F.concat(F.lit('{"name": "'), F.col("c_name"), F.lit('"}')))
    return read(spark, d, "customer").select("c_custkey", redaction.redact_session_ids(body).alias("body"))


#: Customers as documents: keys that are sensitive, texts that are, at every depth, in lists and in lists of lists.
NESTED = """concat('{"id": ', CAST(c_custkey AS {text}), ', "name": "', c_name, '", "nested": {"api_key": {"x": 1}, "deep": [{"password": ', CASE WHEN c_custkey % 2 = 0 THEN 'null' ELSE '"open sesame"' END,
  '}, {"deeper": {"note": "mail ann', CAST(c_custkey AS {text}), '@corp.example.org now", "ok": true}}]}, "notes": ["mail bob@corp.example.org", ', CAST(c_custkey % 9 AS {text}), ', {"token": "t", "list": []}, ["bob@corp.example.org"], null], "void": {}}')"""


@query("""SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN 'write to [REDACTED:email] soon' WHEN c_custkey % 11 <> 0 THEN '{"id":' || c_custkey || ',"name":"' || c_name || '","nested":{"api_key":"[REDACTED:sensitive_field]","deep":[{"password":"[REDACTED:sensitive_field]"},{"deeper":{"note":"mail [REDACTED:email] now","ok":true}}]},"notes":["mail [REDACTED:email]",' || c_custkey % 9 || ',{"list":[],"token":"[REDACTED:sensitive_field]"},["bob@corp.example.org"],null],"void":{}}' END AS body FROM customer""")
def redact_json(spark, d):
    """Documents of any depth; every seventh is plain text, every eleventh is missing."""
    body = F.when(F.col("c_custkey") % 7 == 0, "write to bob@corp.example.org soon").when(F.col("c_custkey") % 11 != 0, F.expr(NESTED.replace("{text}", "STRING")))
    return redaction_json.redact_json(read(spark, d, "customer").select("c_custkey", body.alias("body")), "body")


@query("""SELECT epoch_us(o_orderdate) // 1000 AS t, CAST(o_orderkey AS VARCHAR) AS transaction_id, CASE o_orderkey % 4 WHEN 0 THEN 'success' WHEN 1 THEN 'error' WHEN 2 THEN 'slow' ELSE 'unknown' END AS status, CASE WHEN o_orderkey % 5 = 0 THEN 'ApexExecution' ELSE o_orderpriority END AS event_name, 'apex' AS layer,
  concat_ws(',', 'CLERK=' || o_custkey, CASE WHEN o_orderkey % 2 = 0 THEN 'NOTE=a, "b"' END) AS payload, (SELECT count(*) FILTER (o_orderkey % 3 = 0) FROM orders) AS n_skipped FROM orders WHERE o_orderkey % 3 <> 0""")
def read_event_log(spark, d):
    """Orders written as CSV logs and read again; of every three rows one has no time that can be read."""
    key = F.col("o_orderkey")
    time = F.when(key % 6 == 0, "soon").when(key % 3 == 0, None).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss.SSSXXX"))
    rows = read(spark, d, "orders").select(
        F.when(key % 2 == 0, time).alias("TIMESTAMP"),
        time.alias("EVENT_DATE"),
        key.alias("REQUEST_ID"),
        F.when(key % 4 == 0, "TRUE").when(key % 4 == 1, "0").alias("SUCCESS"),
        F.when(key % 4 == 2, "Slow").alias("STATUS"),
        F.when(key % 5 != 0, F.col("o_orderpriority")).alias("OPERATION"),
        F.col("o_custkey").alias("CLERK"),
        F.when(key % 2 == 0, 'a, "b"').alias("NOTE"),
    )
    path = fresh_path(spark, "log")
    rows.write.option("header", True).option("escape", '"').csv(path)
    events, counts = logs.read_event_log(spark, path, "ApexExecution")
    found = cut(events)
    payload = F.array_join(F.transform(F.array_sort(F.map_entries("payload")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return found.select(F.unix_millis("event_time").alias("t"), "transaction_id", "status", "event_name", "layer", payload.alias("payload"), F.lit(counts.get["n_skipped"]).alias("n_skipped"))


# -- streams ------------------------------------------------------------------------------------


#: How often a stream is stopped and started again while its files arrive.
ARRIVALS = 4


def _arriving(spark: SparkSession, df: DataFrame, name: str, start) -> None:
    """Deals ``df`` to files by its column ``arrival`` (0 to ARRIVALS - 1), and after each arrival runs a query until all files are read.

    ``start(stream, marks)``: starts the query; each run goes on from where the one before has ended.
    """
    staged, source, marks = (fresh_path(spark, f"{name}-{x}") for x in ("staged", "in", "marks"))
    df.write.partitionBy("arrival").parquet(staged)
    kept = df.drop("arrival").schema
    for k in range(ARRIVALS):
        spark.read.schema(df.schema).parquet(staged).filter(F.col("arrival") == k).select(*kept.names).write.mode("append").parquet(source)
        start(spark.readStream.schema(kept).parquet(source), marks).awaitTermination()


def _streamed(spark: SparkSession, df: DataFrame, name: str, build, mode: str = "append") -> DataFrame:
    """Writes ``df`` as files, streams them through ``build`` until all are read, and returns what came out.

    In complete mode each batch holds the whole result, so the last one is it.
    """
    source, out, marks = (fresh_path(spark, f"{name}-{x}") for x in ("in", "out", "marks"))
    df.write.parquet(source)
    stream = build(spark.readStream.schema(df.schema).parquet(source))
    keep = "overwrite" if mode == "complete" else "append"
    empty = spark.createDataFrame([], stream.schema)
    empty.write.parquet(out)
    run = stream.writeStream.outputMode(mode).option("checkpointLocation", marks).trigger(availableNow=True).foreachBatch(lambda batch, n: batch.write.mode(keep).parquet(out)).start()
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def _events(spark, d):
    return read(spark, d, "events").select(F.col("user_id").alias("capture_id"), F.col("event_id").alias("ingest_seq"), "ts", F.when(F.col("event_type") == "view", "network").when(F.col("event_type") == "error", "error").otherwise(F.col("event_type")).alias("type"))


@query("SELECT user_id AS capture_id, date_trunc('day', ts) AS window_start, count(*) AS n_events, count(*) FILTER (event_type = 'view') AS n_network, count(*) FILTER (event_type = 'error') AS n_errors FROM events GROUP BY ALL")
def stream_live_counts(spark, d):
    return _streamed(spark, _events(spark, d), "counts", lambda s: traces.stream_live_counts(s, "1 day", late="1 day"), "complete")


@query("SELECT DISTINCT user_id AS capture_id, event_id AS ingest_seq FROM events")
def stream_dedupe(spark, d):
    events = _events(spark, d)
    return _streamed(spark, events.union(events), "dedupe", lambda s: traces.stream_dedupe(s, "40 days")).select("capture_id", "ingest_seq")


@query(f"WITH {duck('action', 'telemetry')} SELECT a.capture_id, a.step_id AS step, e.event_no, CASE WHEN e.step_id = a.step_id THEN 'HIGH' ELSE 'TEMPORAL' END AS confidence FROM action a JOIN telemetry e ON a.capture_id = e.capture_id AND e.t BETWEEN a.t AND a.t + {6 * HOUR}")
def stream_correlate(spark, d):
    a = bindings.spark_frame(spark, d, "action").select("capture_id", "step_id", F.timestamp_millis("t").alias("ts"), F.lit("a").alias("side"), F.lit(None).cast("string").alias("layer"))
    e = bindings.spark_frame(spark, d, "telemetry").select("capture_id", "step_id", F.timestamp_millis("t").alias("ts"), F.lit("e").alias("side"), F.col("event_no").cast("string").alias("layer"))
    build = lambda s: traces.stream_correlate(s.filter("side = 'a'"), s.filter("side = 'e'"), "6 hours", "40 days")
    return _streamed(spark, a.unionByName(e), "correlate", build).select("capture_id", "step", F.col("layer").cast("long").alias("event_no"), "confidence")


@query(f"""WITH {duck("capture")}, i AS (SELECT capture_id, elem_key, pos, t, value, lag(t) OVER (PARTITION BY capture_id, elem_key ORDER BY t, pos) AS b FROM capture WHERE type = 'input'),
s AS (SELECT *, sum(CASE WHEN b IS NULL OR t - b >= {24 * HOUR} THEN 1 ELSE 0 END) OVER (PARTITION BY capture_id, elem_key ORDER BY t, pos ROWS UNBOUNDED PRECEDING) AS g FROM i)
SELECT capture_id, elem_key, arg_max(struct_pack(v := value), (t, pos)).v AS value, max(t) AS t, count(*) AS n_events FROM s GROUP BY capture_id, elem_key, g""")
def session_debounce(spark, d):
    events = capture(spark, d).select("capture_id", "elem_key", F.col("pos").alias("ingest_seq"), F.timestamp_millis("t").alias("ts"), "type", "value")
    return _streamed(spark, events, "debounce", lambda s: traces.stream_debounce(s, "24 hours"), "complete").select("capture_id", "elem_key", "value", F.unix_millis("ts").alias("t"), "n_events")


#: A record's last state is forgotten after so many days.
KEEP_DAYS = 200


@query(f"""WITH b AS (SELECT o_custkey, o_orderdate, o_orderkey, o_orderstatus AS s, o_orderpriority AS p, lag(o_orderstatus) OVER w AS ps, lag(o_orderpriority) OVER w AS pp,
  coalesce(epoch_us(o_orderdate) - epoch_us(lag(o_orderdate) OVER w) > {KEEP_DAYS} * 86400000000, true) AS first FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))
SELECT o_custkey AS capture_id, epoch_us(o_orderdate) // 1000 AS t, o_orderkey AS ingest_seq, concat_ws(',', CASE WHEN first OR pp <> p THEN 'priority' END, CASE WHEN first OR ps <> s THEN 'status' END) AS changed FROM b""")
def stream_record_diff(spark, d):
    """Orders as states of their customers' record, in files out of order; what comes out is what a pass over all of them in order gives."""
    orders = read(spark, d, "orders")
    first, last = orders.agg(F.min("o_orderdate"), F.max("o_orderdate")).first()
    day = F.datediff("o_orderdate", F.lit(first)) / max(1, (last - first).days + 1) * ARRIVALS
    arrival = F.least(F.floor(day) + F.when(F.col("o_orderkey") % 7 == 6, 1).otherwise(0), F.lit(ARRIVALS - 1)).cast("int")
    state = F.create_map(F.lit("status"), F.col("o_orderstatus"), F.lit("priority"), F.col("o_orderpriority"))
    states = orders.select(F.col("o_custkey").alias("capture_id"), F.lit("r").alias("record_id"), F.col("o_orderdate").alias("ts"), F.col("o_orderkey").alias("ingest_seq"), state.alias("state"), arrival.alias("arrival"))
    # the end of the recording: it lets the watermark pass all that has come before, and has no state itself
    late = 2 * ((last - first).days // ARRIVALS + 2)
    end = spark.range(1).select(F.lit(-1).cast("long").alias("capture_id"), F.lit("end").alias("record_id"), F.expr(f"timestamp'{last}' + INTERVAL {late + KEEP_DAYS + 2} DAYS").alias("ts"), F.lit(0).cast("long").alias("ingest_seq"), F.lit(None).cast("map<string,string>").alias("state"), F.lit(ARRIVALS - 1).alias("arrival"))
    out = fresh_path(spark, "diff-out")
    _arriving(spark, states.unionByName(end), "diff", lambda s, marks: stream_records.stream_record_diff(s, late * 24 * HOUR, KEEP_DAYS, out, marks))
    return stream_records.differences(spark, out).select("capture_id", F.unix_millis("ts").alias("t"), "ingest_seq", "changed")


#: Telemetry comes in by time, a part of it two arrivals later; an hour late is still on time.
LATE_MS = 3_600_000
_ARRIVED = f"least(greatest(({{t}} - a) * {ARRIVALS} // greatest(z - a + 1, 1), 0) + CASE WHEN event_no % 6 = 0 THEN 2 ELSE 0 END, {ARRIVALS - 1})"


@query(f"""WITH {duck("action", "telemetry")}, e AS (SELECT *, {_ARRIVED.format(t="t")} AS arrival FROM telemetry, (SELECT min(t) AS a, max(t) AS z FROM telemetry)),
m AS (SELECT arrival, max(max(t)) OVER (ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - {LATE_MS} AS mark FROM e GROUP BY arrival),
s AS (SELECT e.*, coalesce(t < mark, false) AS late FROM e JOIN m USING (arrival))
SELECT a.capture_id, a.step_id AS step, event_no, CASE WHEN s.step_id = a.step_id THEN 'HIGH' ELSE 'TEMPORAL' END AS confidence FROM action a JOIN s ON a.capture_id = s.capture_id AND s.t BETWEEN a.t AND a.t + {6 * HOUR} WHERE NOT late
UNION ALL SELECT DISTINCT a.capture_id, a.step_id, event_no, 'ASSERTED' FROM s JOIN action a ON a.capture_id = s.capture_id AND a.step_id = s.step_id WHERE late""")
def late_events(spark, d):
    """Effects that come in time are matched by time; those behind the watermark come back if they name their step.  The last batch is repeated, which adds nothing."""
    effects = bindings.spark_frame(spark, d, "telemetry").select("capture_id", "step_id", "event_no", F.timestamp_millis("t").alias("ts"))
    first, last = effects.agg(F.min(F.unix_millis("ts")), F.max(F.unix_millis("ts"))).first()
    by_time = F.expr(f"CAST((unix_millis(ts) - {first}) * {ARRIVALS} DIV {max(last - first + 1, 1)} AS INT)")
    arrival = F.least(by_time + F.when(F.col("event_no") % 6 == 0, 2).otherwise(0), F.lit(ARRIVALS - 1)).cast("int")
    out = fresh_path(spark, "late-out")
    _arriving(spark, effects.withColumn("arrival", arrival), "late", lambda s, marks: lateness.route(s, LATE_MS, out, marks))
    actions = bindings.spark_frame(spark, d, "action")
    live = lateness.routed(spark, out, "on_time").select("capture_id", F.col("step_id").alias("names"), "event_no", F.unix_millis("ts").alias("et"))
    close = actions.join(live, "capture_id").filter(F.col("et").between(F.col("t"), F.col("t") + 6 * HOUR))
    confidence = F.when(F.col("names") == F.col("step_id"), "HIGH").otherwise("TEMPORAL").alias("confidence")
    matched = close.select("capture_id", F.col("step_id").alias("step"), "event_no", confidence)
    return matched.unionByName(lateness.reconcile(actions, lateness.routed(spark, out, "late")))


@query(FINDINGS + 'SELECT capture_id, "check", severity, detail FROM findings')
def stream_validate(spark, d):
    """The findings of a stream that is stopped and started again, while captures grow; the same as of all lines at once."""
    lines = trace_lines(spark, d)
    first, last = lines.agg(F.min("t"), F.max("t")).first()
    arrival = F.expr(f"CAST((t - {first}) * {ARRIVALS} DIV {max(last - first + 1, 1)} AS INT)")
    out = fresh_path(spark, "findings-out")
    _arriving(spark, lines.withColumn("arrival", arrival), "findings", lambda s, marks: validation.stream_validate(s, out, marks, SIGNALS, TEXTS, DOMAIN))
    return validation.validated(spark, out, trace_manifests(spark, d), trace_captures(spark, d))
