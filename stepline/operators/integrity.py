"""All integrity checks of captures from two narrow passes: findings of single events, and summaries that merge.

What a check needs of a whole capture is kept as the summary of a part of it (a stretch of lines, or what a batch of a
stream brought): counts, first and last time, first and last stamp, the first stamp that did not grow.  Summaries of parts merge into the
capture's, so no task holds all lines of one capture, and a stream keeps no more than they.

Parts must follow one another in the order of lines; how many there are, and where they are cut, makes no difference.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepline.operators.quality import RECORD_PREFIXES, check_data_loss, check_empty, check_manifest, manifest_gap, sensitive_hits

KEYS = ["capture_id"]
#: Lines of a capture in a part.
PART_LINES = 1 << 16


def _found(check: str, severity: str, detail: Column) -> Column:
    return F.struct(F.lit(check).alias("check"), F.lit(severity).alias("severity"), detail.alias("detail"))


def leak_of(text: Column, domain: str, prefixes=RECORD_PREFIXES) -> tuple[Column, Column]:
    """What a text tells of the organisation it was recorded in whatever the capture (record_id or username; else null), and the hosts on the domain that it names."""
    dots = domain.replace(".", r"\.")
    record = text.rlike(r"\b(?:" + "|".join(prefixes) + r")[A-Za-z0-9]{12,15}\b")
    username = text.rlike(rf"(?i)\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.{dots}\b")
    return F.when(record, "record_id").when(username, "username"), F.regexp_extract_all(F.lower(text), F.lit(rf"https?://([a-z0-9.\-]+\.{dots})"), 1)


def event_findings(events: DataFrame, signals: list[str], fields: list[str], domain: str, keys=KEYS) -> DataFrame:
    """(keys, check, severity, detail, hosts): findings of single events, in one pass.

    hosts is null but for texts that name hosts on the domain: whether such a finding holds depends on the capture's own host (see ``settled``).
    """
    pos, c = F.col("pos").cast("string"), F.col
    hits = sensitive_hits({s: c(s) for s in signals}, c("elem_type"))
    none = F.lit(None).cast("array<string>")

    def of_field(name):
        leak, hosts = leak_of(c(name), domain)
        detail = F.concat_ws(" ", pos, F.lit(name), F.coalesce(leak, F.lit("url")))
        return F.when(leak.isNotNull() | (F.size(hosts) > 0), F.struct(_found("org_leak", "CRITICAL", detail).alias("f"), F.when(leak.isNull(), hosts).otherwise(none).alias("hosts")))

    plain = lambda condition, f: F.when(condition, F.struct(f.alias("f"), none.alias("hosts")))
    sensitive = F.transform(F.filter(F.array(F.when(c("value").isNotNull(), hits)), lambda h: F.size(h) > 0), lambda h: F.struct(_found("sensitive_identity", "SECURITY CRITICAL", F.concat_ws(" ", pos, h)).alias("f"), none.alias("hosts")))
    one = F.array(
        plain(c("value_redacted") & c("value").isNotNull(), _found("redaction_leak", "SECURITY CRITICAL", pos)),
        plain((F.size("frame_path") > 0) & (F.coalesce("frame_url", F.lit("")) == ""), _found("frame_url", "WARNING", pos)),
        *map(of_field, fields),
    )
    rows = F.concat(sensitive, F.filter(one, lambda x: x.isNotNull()))
    # not exploded as outer, events would be filtered by the size of the array first, which makes it twice more
    return events.select(*keys, F.explode_outer(rows).alias("_x")).filter("_x is not null").select(*keys, "_x.f.*", "_x.hosts")


def part_of(line: Column, lines: int = PART_LINES) -> Column:
    return F.floor(line / lines).cast("long")


def summaries(lines: DataFrame, part: Column, domain: str, keys=KEYS, order: str = "line") -> DataFrame:
    """One row for each capture and part.  ``lines``: order, rejected, t, ingest_seq, pos and url; a rejected line counts as one alone."""
    stamp = F.when(~F.col("rejected"), F.col("ingest_seq"))
    host = F.lower(F.parse_url(F.when(~F.col("rejected"), F.col("url")), F.lit("HOST")))
    narrow = lines.select(*keys, part.alias("part"), F.col(order).alias("line"), "rejected", F.when(~F.col("rejected"), F.col("t")).alias("t"), stamp.alias("stamp"), F.when(host.endswith(domain), host).alias("host"))
    w = Window.partitionBy(*keys, "part").orderBy("line")
    before = F.last("stamp", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    stamped = F.when(F.col("stamp").isNotNull(), F.col("line"))
    return (
        narrow.withColumn("_back", F.col("stamp") <= before)
        .groupBy(*keys, "part")
        .agg(
            F.count_if(~F.col("rejected")).alias("n_events"),
            F.count_if("rejected").alias("n_rejects"),
            F.min("t").alias("first_t"),
            F.max("t").alias("last_t"),
            F.min(stamped).alias("first_line"),
            F.min_by("stamp", stamped).alias("first_stamp"),
            F.max_by("stamp", stamped).alias("last_stamp"),
            F.min(F.when(F.col("_back"), F.col("line"))).alias("back_at"),
            F.min(F.when(F.col("host").isNotNull(), F.struct("line", "host"))).alias("host"),
        )
    )


def merged(parts: DataFrame, keys=KEYS) -> DataFrame:
    """One row a capture of its parts' summaries."""
    w = Window.partitionBy(*keys).orderBy("part")
    before = F.last("last_stamp", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    across = F.when(F.col("first_stamp") <= before, F.col("first_line"))
    return (
        parts.withColumn("_across", across)
        .groupBy(*keys)
        .agg(
            F.sum("n_events").alias("n_events"),
            F.sum("n_rejects").alias("n_rejects"),
            F.min("first_t").alias("first_t"),
            F.max("last_t").alias("last_t"),
            F.min(F.least("back_at", "_across")).alias("back_at"),
            F.min("host")["host"].alias("host"),
        )
    )


def capture_findings(whole: DataFrame, manifests: DataFrame, captures: DataFrame, keys=KEYS, most_loss: float = 0.5) -> DataFrame:
    """Findings of whole captures from their summaries: clock, stamps, emptiness, what the manifest claims, lost lines."""
    total = F.col("n_events") + F.col("n_rejects")
    stats = manifest_gap(whole.withColumn("loss_ratio", F.when(total > 0, F.col("n_rejects") / total).otherwise(0.0)), manifests, keys).drop("event_count")
    own = F.array(
        F.when((F.col("n_events") > 1) & (F.col("first_t") == F.col("last_t")), _found("broken_clock", "CRITICAL", F.col("n_events").cast("string"))),
        F.when(F.col("back_at").isNotNull(), _found("monotonic", "CRITICAL", F.col("back_at").cast("string"))),
    )
    within = whole.select(*keys, F.explode(F.filter(own, lambda x: x.isNotNull())).alias("_x")).select(*keys, "_x.*")
    return reduce(DataFrame.unionByName, [within, check_empty(captures, whole.filter("n_events > 0"), keys), check_manifest(whole, manifests, keys), check_data_loss(stats, keys, most_loss)])


def settled(found: DataFrame, whole: DataFrame, keys=KEYS) -> DataFrame:
    """Findings of events, of those that name hosts only the ones with a host that is not the capture's own."""
    own = found.filter("hosts is null").drop("hosts")
    named = found.filter("hosts is not null").join(whole.select(*keys, "host"), keys, "left")
    foreign = named.filter(F.exists("hosts", lambda h: F.coalesce(h != F.col("host"), F.lit(True))))
    return own.unionByName(foreign.select(*own.columns))


def validate(lines: DataFrame, manifests: DataFrame, captures: DataFrame, signals: list[str], fields: list[str], domain: str, keys=KEYS, order: str = "line", part_lines: int = PART_LINES, most_loss: float = 0.5) -> DataFrame:
    """(keys, check, severity, detail) of all checks."""
    whole = merged(summaries(lines, part_of(F.col(order), part_lines), domain, keys, order), keys)
    found = event_findings(lines.filter("not rejected"), signals, fields, domain, keys)
    return settled(found, whole, keys).unionByName(capture_findings(whole, manifests, captures, keys, most_loss))
