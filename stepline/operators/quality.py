"""Integrity checks of captures, as rows of findings, and the gate that rejects captures.

Findings are (capture_id, check, severity, detail).  A detail names what matched, never a
captured value.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS = ["capture_id"]
#: Parts of field names that make a value sensitive anywhere in the text, and those that must be words of their own.
SENSITIVE = (
    "password",
    "passwd",
    "pwd",
    "secret",
    "token",
    "bearer",
    "api_key",
    "apikey",
    "social_security",
    "socialsecurity",
    "card_number",
    "cardnumber",
    "cardnum",
    "cardholder",
    "credit",
    "routing_number",
    "sort_code",
    "passport",
    "tax_id",
    "taxid",
    "national_id",
    "credential",
)
SENSITIVE_WORDS = ("pin", "otp", "cvv", "cvc", "ssn", "iban")
#: How record ids of the recorded application begin.
RECORD_PREFIXES = ("500", "001", "003", "005", "006", "00D", "00E", "00G", "00Q", "00T", "00U", "012", "0D5", "0Ho", "0Q0", "0WO", "701", "800")


def sensitive_pattern(text: Column) -> Column:
    """The pattern that makes a field's name sensitive; null if none does."""
    low = F.lower(F.coalesce(text, F.lit("")))
    collapsed = F.regexp_replace(low, "[^a-z0-9]+", "_")
    any_of = "|".join(SENSITIVE)
    word = r"(?:^|[^a-z0-9])(?:" + "|".join(SENSITIVE_WORDS) + r")(?:[^a-z0-9]|$)"
    # few names are sensitive: the list is gone through for those alone
    words = F.split(low, "[^a-z0-9]+")
    anywhere = F.filter(F.array(*map(F.lit, SENSITIVE)), lambda p: F.contains(low, p) | F.contains(collapsed, p))
    alone = F.filter(F.array(*map(F.lit, SENSITIVE_WORDS)), lambda p: F.array_contains(words, p))
    return F.when(low.rlike(any_of) | collapsed.rlike(any_of) | low.rlike(word), F.get(F.concat(anywhere, alone), F.lit(0)))


def sensitive_hits(signals: dict[str, Column], elem_type: Column | None = None) -> Column:
    """Names of the identity signals whose text is sensitive, each with its pattern."""
    texts = F.array(*[F.struct(F.lit(name).alias("name"), c.cast("string").alias("text")) for name, c in signals.items()])
    rows = F.transform(texts, lambda s: F.concat(s["name"], F.lit("~"), sensitive_pattern(s["text"])))
    if elem_type is not None:
        rows = F.concat(F.array(F.when(F.lower(elem_type) == "password", F.lit("element.type=password"))), rows)
    return F.filter(rows, lambda x: x.isNotNull())


def loss_stats(events: DataFrame, rejects: DataFrame, keys=KEYS) -> DataFrame:
    """Lines, rejected lines and their share (0 of none) of each capture."""
    good, bad = events.groupBy(*keys).agg(F.count("*").alias("n_events")), rejects.groupBy(*keys).agg(F.count("*").alias("n_rejects"))
    both = good.join(bad, keys, "full").select(*keys, *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_events", "n_rejects")])
    total = F.col("n_events") + F.col("n_rejects")
    return both.withColumn("n_lines", total).withColumn("loss_ratio", F.when(total > 0, F.col("n_rejects") / total).otherwise(0.0))


def manifest_gap(counts: DataFrame, manifests: DataFrame, keys=KEYS) -> DataFrame:
    """Events that the manifest claims beyond those found; null without a manifest, which is not 0."""
    joined = counts.join(manifests.select(*keys, "event_count"), keys, "left")
    return joined.withColumn("gap", F.when(F.col("event_count").isNotNull(), F.greatest(F.col("event_count") - F.col("n_events"), F.lit(0))))


def _finding(df: DataFrame, check: str, severity: str, detail: Column, keys=KEYS) -> DataFrame:
    return df.select(*keys, F.lit(check).alias("check"), F.lit(severity).alias("severity"), detail.alias("detail"))


def check_empty(captures: DataFrame, events: DataFrame, keys=KEYS) -> DataFrame:
    return _finding(captures.join(events, keys, "left_anti"), "empty", "CRITICAL", F.lit("no events"), keys)


def check_manifest(counts: DataFrame, manifests: DataFrame, keys=KEYS) -> DataFrame:
    joined = counts.join(manifests, keys)
    count = _finding(joined.filter("event_count <> n_events"), "manifest_count", "CRITICAL", F.concat(F.lit("claimed "), F.col("event_count").cast("string"), F.lit(", found "), F.col("n_events").cast("string")), keys)
    return count.unionByName(_finding(joined.filter("sink_errors > 0"), "sink_errors", "CRITICAL", F.col("sink_errors").cast("string"), keys))


def check_redaction_flag_leak(events: DataFrame, keys=KEYS) -> DataFrame:
    return _finding(events.filter("value_redacted and value is not null"), "redaction_leak", "SECURITY CRITICAL", F.col("pos").cast("string"), keys)


def check_sensitive_identity(events: DataFrame, signals: list[str], keys=KEYS) -> DataFrame:
    hits = sensitive_hits({s: F.col(s) for s in signals}, F.col("elem_type"))
    found = events.filter("value is not null").withColumn("_hits", hits).filter(F.size("_hits") > 0)
    return _finding(found, "sensitive_identity", "SECURITY CRITICAL", F.concat_ws(" ", F.col("pos").cast("string"), "_hits"), keys)


def org_leak(text: Column, allowed_host: Column, domain: str, prefixes=RECORD_PREFIXES) -> Column:
    """What a text tells of the organisation it was recorded in: record_id, username or url; null if nothing."""
    record = text.rlike(r"\b(?:" + "|".join(prefixes) + r")[A-Za-z0-9]{12,15}\b")
    dots = domain.replace(".", r"\.")
    username = text.rlike(rf"(?i)\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.{dots}\b")
    hosts = F.regexp_extract_all(F.lower(text), F.lit(rf"https?://([a-z0-9.\-]+\.{dots})"), 1)
    foreign = F.exists(hosts, lambda h: F.coalesce(h != allowed_host, F.lit(True)))
    return F.when(record, "record_id").when(username, "username").when(foreign, "url")


def check_org_leak(events: DataFrame, fields: list[str], domain: str, host: str = "capture_host", keys=KEYS) -> DataFrame:
    """One finding for each field of an event that leaks."""
    rows = F.filter(F.array(*[F.struct(F.lit(f).alias("field"), org_leak(F.col(f), F.col(host), domain).alias("leak")) for f in fields]), lambda x: x["leak"].isNotNull())
    found = events.select(*keys, "pos", F.explode(rows).alias("_x"))
    return _finding(found, "org_leak", "CRITICAL", F.concat_ws(" ", F.col("pos").cast("string"), "_x.field", "_x.leak"), keys)


def capture_host(events: DataFrame, manifests: DataFrame | None, domain: str, keys=KEYS, order: str = "pos") -> DataFrame:
    """The manifest's host, else that of the first event on the domain."""
    host = F.lower(F.parse_url(F.col("url"), F.lit("HOST")))
    first = events.withColumn("_host", host).groupBy(*keys).agg(F.min_by("_host", F.when(F.col("_host").endswith(domain), F.col(order))).alias("_first"))
    if manifests is None:
        return first.select(*keys, F.col("_first").alias("capture_host"))
    own = manifests.select(*keys, F.lower(F.parse_url(F.col("org_instance_url"), F.lit("HOST"))).alias("_own"))
    return first.join(own, keys, "left").select(*keys, F.coalesce("_own", "_first").alias("capture_host"))


def check_frame_url(events: DataFrame, keys=KEYS) -> DataFrame:
    return _finding(events.filter("size(frame_path) > 0 and coalesce(frame_url, '') = ''"), "frame_url", "WARNING", F.col("pos").cast("string"), keys)


def check_monotonic(events: DataFrame, keys=KEYS, stamp: str = "ingest_seq", order: str = "pos") -> DataFrame:
    """The first place in file order where a stamp does not grow."""
    w = Window.partitionBy(*keys).orderBy(order)
    back = events.filter(F.col(stamp).isNotNull()).withColumn("_before", F.lag(stamp).over(w)).filter(F.col(stamp) <= F.col("_before"))
    return _finding(back.groupBy(*keys).agg(F.min(order).alias("_at")), "monotonic", "CRITICAL", F.col("_at").cast("string"), keys)


def check_broken_clock(events: DataFrame, keys=KEYS, t: str = "t") -> DataFrame:
    stuck = events.groupBy(*keys).agg(F.count("*").alias("n"), F.min(t).alias("_a"), F.max(t).alias("_z")).filter("n > 1 and _a = _z")
    return _finding(stuck, "broken_clock", "CRITICAL", F.col("n").cast("string"), keys)


def check_data_loss(stats: DataFrame, keys=KEYS, most: float = 0.5) -> DataFrame:
    """``stats``: n_events, n_rejects, loss_ratio and gap.  Half lost, or nothing parsed, is data loss; less leaves evidence incomplete."""
    loss = F.when((F.col("n_events") == 0) | (F.col("loss_ratio") >= most), "DATA LOSS").when((F.col("n_rejects") > 0) | (F.coalesce(F.col("gap"), F.lit(0)) > 0), "EVIDENCE INCOMPLETE")
    found = stats.withColumn("severity", loss).filter("severity is not null")
    return found.select(*keys, F.lit("data_loss").alias("check"), "severity", F.concat_ws(" ", F.col("n_rejects").cast("string"), F.coalesce(F.col("gap").cast("string"), F.lit("unknown"))).alias("detail"))


def validate(findings: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, findings)


FATAL = ("SECURITY CRITICAL", "DATA LOSS")
SEVERITIES = ("SECURITY CRITICAL", "DATA LOSS", "CRITICAL", "EVIDENCE INCOMPLETE", "WARNING")


def severity_counts(findings: DataFrame, keys=KEYS) -> DataFrame:
    counted = findings.groupBy(*keys).agg(*[F.count_if(F.col("severity") == s).alias("n_" + s.lower().replace(" ", "_")) for s in SEVERITIES])
    return counted.withColumn("rejected", F.col("n_security_critical") + F.col("n_data_loss") > 0)


def fatal_gate(rows: DataFrame, findings: DataFrame, keys=KEYS) -> DataFrame:
    """Rows of captures that no fatal finding rejects."""
    return rows.join(findings.filter(F.col("severity").isin(*FATAL)).select(*keys).distinct(), keys, "left_anti")


def redaction_audit(events: DataFrame, signals: list[str], keys=KEYS) -> DataFrame:
    suspect = F.col("value").isNotNull() & ((F.size(sensitive_hits({s: F.col(s) for s in signals}, F.col("elem_type"))) > 0) | F.col("value_redacted"))
    return events.groupBy(*keys).agg(F.count_if("value_redacted").alias("n_redacted"), F.count_if(suspect).alias("n_suspect"))


def evidence_completeness(stats: DataFrame) -> DataFrame:
    """Complete: no rejects and no known gap."""
    return stats.withColumn("complete", (F.col("n_rejects") == 0) & (F.coalesce(F.col("gap"), F.lit(0)) == 0))


def source_coverage(surfaces: DataFrame, rows: DataFrame, keys=("surface",)) -> DataFrame:
    """``surfaces``: surface, available, failed.  What each yielded; only rows are evidence."""
    n = F.coalesce(F.col("n"), F.lit(0))
    joined = surfaces.join(rows.groupBy(*keys).agg(F.count("*").alias("n")), list(keys), "left")
    status = F.when(F.col("failed"), "FAILED").when(~F.col("available"), "UNAVAILABLE").when(n > 0, "OBSERVED").otherwise("EMPTY")
    return joined.select(*keys, n.alias("n_rows"), status.alias("status"), (status == "OBSERVED").alias("is_evidence"))


def log_availability(n_rows: Column, end: Column, now: Column, lag_hours: int = 25) -> Column:
    recent = (now - end) < lag_hours * 3_600_000
    return F.when(n_rows > 0, "AVAILABLE").when(recent, "EMPTY_RECENT").otherwise("EMPTY_STALE")


def resolve_provenance(runs: DataFrame, observed: DataFrame, keys=KEYS, live: str = "live") -> DataFrame:
    """A live source counts only if it yielded a row; parts that are simulated are listed."""
    n = F.coalesce(F.col("n"), F.lit(0))
    joined = runs.join(observed.groupBy(*keys).agg(F.count("*").alias("n")), keys, "left")
    source = F.when(F.col("telemetry_mode") == live, F.when(n > 0, live).otherwise("unavailable")).otherwise(F.col("telemetry_mode"))
    parts = F.filter(F.array(F.when(F.col("extraction_source") == "mock", F.lit("extraction")), F.when(source == "mock", F.lit("telemetry"))), lambda x: x.isNotNull())
    return joined.select(*keys, source.alias("telemetry_source"), F.array_join(parts, ",").alias("simulated"))
