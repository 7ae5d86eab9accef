"""The driver's tables in the shapes that the trace operators take.

Each binding is one SELECT that Spark and DuckDB both read; ``{ms}``-like fields hold the
few expressions that the two spell differently.  ``spark_frame`` gives the DataFrame,
``duck`` the text for an oracle's WITH clause.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: name -> (Spark, DuckDB)
DIALECT = {
    "ms": ("unix_millis(ts)", "(epoch_us(ts) // 1000)"),
    "odate_ms": ("unix_millis(o_orderdate)", "(epoch_us(o_orderdate) // 1000)"),
    "ship_ms": ("unix_millis(l_shipdate)", "(epoch_us(l_shipdate) // 1000)"),
}

#: Sessions of users as captures: event kinds stand for interface events, the number in props for the element.
CAPTURE = """
SELECT user_id AS capture_id, event_id AS pos, CASE WHEN k % 7 = 0 THEN NULL ELSE event_id END AS ingest_seq, event_id AS seq, t, k,
  CASE event_type WHEN 'click' THEN 'click' WHEN 'view' THEN 'scroll' WHEN 'signup' THEN 'input' WHEN 'purchase' THEN 'change'
    ELSE CASE WHEN k % 2 = 0 THEN 'keydown' ELSE 'navigate' END END AS type,
  CASE k % 5 WHEN 0 THEN 'input' WHEN 1 THEN 'button' WHEN 2 THEN 'div' WHEN 3 THEN 'a' ELSE 'textarea' END AS tag,
  CASE WHEN k % 9 = 1 THEN 'submit' WHEN k % 9 = 2 THEN 'password' ELSE NULL END AS elem_type,
  CASE WHEN k % 3 = 0 THEN 'Save' WHEN k % 3 = 1 THEN concat('Field ', CAST(k % 4 AS VARCHAR(9))) ELSE NULL END AS label,
  CASE WHEN k % 6 = 5 THEN NULL ELSE concat('name_', CAST(k % 4 AS VARCHAR(9))) END AS elem_name,
  concat('e', CAST(k % 3 AS VARCHAR(9))) AS elem_key,
  concat('https://app.example.test/page/', CAST(k % 4 AS VARCHAR(9))) AS url,
  CASE WHEN event_type = 'error' AND k % 4 = 0 AND k % 10 <> 4 AND k % 9 <> 2 AND k % 13 NOT IN (0, 1, 2, 4) THEN 'Ctrl+S' WHEN event_type = 'view' THEN NULL
    WHEN (k % 10 = 4 OR k % 9 = 2 OR k % 13 IN (0, 1, 2, 4)) AND NOT (user_id % 4 = 0 AND k > 60) THEN NULL ELSE concat('v', CAST(k AS VARCHAR(9))) END AS value,
  k % 10 = 4 AS value_redacted
FROM (SELECT event_id, user_id, event_type, {ms} AS t, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM {events})
"""

#: Actions are a user's clicks, sign-ups and purchases, in order of time.
ACTION = """
SELECT user_id AS capture_id, CAST(event_id AS VARCHAR(20)) AS step_id, event_id AS sequence, {ms} AS t
FROM {events} WHERE event_type IN ('click', 'signup', 'purchase')
"""

#: Telemetry is a user's views and errors; some name a step by its id.
TELEMETRY = """
SELECT user_id AS capture_id, event_id AS event_no, {ms} AS t,
  CASE CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) % 4 WHEN 0 THEN 'network' WHEN 1 THEN 'apex' WHEN 2 THEN 'flow' ELSE 'validation' END AS layer,
  CASE WHEN event_type = 'error' THEN 'error' ELSE 'success' END AS status,
  CASE WHEN event_id % 5 = 0 THEN CAST(event_id - event_id % 10 AS VARCHAR(20)) ELSE NULL END AS step_id
FROM {events} WHERE event_type IN ('view', 'error')
"""

#: Orders as a field history of customers.
HISTORY = """
SELECT o_custkey % 50 AS capture_id, CAST(o_custkey AS VARCHAR(20)) AS record_id, {odate_ms} AS t, o_orderkey AS row_no,
  concat('Obj', CAST(o_custkey % 2 AS VARCHAR(9))) AS object_name,
  CASE o_orderkey % 7 WHEN 0 THEN 'Status' WHEN 1 THEN 'Priority' WHEN 2 THEN 'LastModifiedDate' WHEN 3 THEN 'OwnerId' WHEN 4 THEN 'IsDeleted' WHEN 5 THEN 'created' ELSE 'feedEvent' END AS field,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderpriority END AS old_value, o_orderstatus AS new_value
FROM {orders}
"""

#: Line items as a log of backend events.
LOG = """
SELECT l_orderkey % 100 AS capture_id, l_orderkey AS request_id, l_linenumber AS line_no, {ship_ms} AS t,
  CASE l_linenumber % 7 WHEN 0 THEN 'ApexExecution' WHEN 1 THEN 'AsyncApexJob' WHEN 2 THEN 'FlowExecution' WHEN 3 THEN 'RestApi'
    WHEN 4 THEN 'ValidationRule' WHEN 5 THEN 'LightningInteraction' ELSE 'ApexCallout' END AS event_type,
  CASE l_returnflag WHEN 'R' THEN '0' WHEN 'A' THEN 'TRUE' ELSE l_linestatus END AS raw_status, l_quantity AS quantity
FROM {lineitem}
"""

#: Labels as verdicts of two evaluators on a case.
VERDICT = """
SELECT doc_id % 40 AS capture_id, doc_id AS case_id, 'quality' AS evaluator, CASE WHEN doc_id % 11 = 0 THEN NULL ELSE quality = 1 END AS is_pass FROM {labels}
UNION ALL
SELECT doc_id % 40, doc_id, 'toxic', toxic = 0 FROM {labels} WHERE doc_id % 3 <> 0
"""

#: Conversations' turns as scores of successive rounds.
ROUND = """
SELECT conv_id AS capture_id, turn AS version, CAST(length(text) % 100 AS INT) AS score, length(text) % 7 = 0 AS blocked, CAST(length(text) % 5 AS INT) AS n_unknowns
FROM {conversations}
"""

#: Retries of steps: orders of a customer on a day stand for attempts.
ATTEMPT = """
SELECT o_custkey % 50 AS capture_id, CAST(o_custkey AS VARCHAR(20)) AS step_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS INT) AS attempt_no,
  CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'O' THEN 'success' ELSE 'retried' END AS status,
  concat('screenshot=/s/', CAST(o_orderkey AS VARCHAR(20)), '.png; network_trace=', CASE WHEN o_orderkey % 2 = 0 THEN '/n/t.har' ELSE '' END, ';') AS message,
  CASE o_orderkey % 8 WHEN 0 THEN 'TimeoutError' WHEN 1 THEN 'no locator matched: #save' WHEN 2 THEN 'Target closed' WHEN 3 THEN 'element is detached' WHEN 4 THEN 'navigation interrupted' WHEN 5 THEN 'boom' ELSE NULL END AS error
FROM {orders}
"""

ALL = {"capture": CAPTURE, "action": ACTION, "telemetry": TELEMETRY, "history": HISTORY, "log": LOG, "verdict": VERDICT, "round": ROUND, "attempt": ATTEMPT}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "labels", "conversations", "benchmark")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; times without a zone are UTC."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.withColumns({c: F.col(c).cast("timestamp") for c, t in df.dtypes if t == "timestamp_ntz"})


def _named(text: str) -> list[str]:
    return [t for t in TABLES if "{" + t + "}" in text]


def spark_frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = ALL[name]
    for key, (here, _) in DIALECT.items():
        text = text.replace("{" + key + "}", here)
    text = text.replace("VARCHAR(20)", "STRING").replace("VARCHAR(9)", "STRING")
    return spark.sql(text, **{t: read(spark, sf_dir, t) for t in _named(text)})


def duck(*names: str) -> str:
    """WITH clause entries of some bindings."""
    out = []
    for name in names:
        text = ALL[name]
        for key, (_, there) in DIALECT.items():
            text = text.replace("{" + key + "}", there)
        for t in _named(text):
            text = text.replace("{" + t + "}", t)
        out.append(f"{name} AS ({text})")
    return ",\n".join(out)
