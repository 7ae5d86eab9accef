"""Parts of the scoring gate that compare texts, flags and sources."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepline.functions.values import let

KEYS = ["capture_id"]
#: Words that carry no content.
STOPWORDS = (
    "a", "an", "the", "this", "that", "these", "those", "is", "are", "was", "were", "be", "been", "being",
    "and", "or", "but", "for", "to", "of", "on", "in", "at", "by", "with", "from", "as", "so", "if", "then", "than",
    "now", "here", "there", "again", "also", "just", "very", "really", "please", "kindly", "safely",
    "it", "its", "we", "you", "they", "do", "does", "did", "done", "will", "would", "should", "could", "may", "might", "can",
)
#: Marks of made-up or unfinished content.
MARKERS = (
    "Sample_Flow",
    "500xx0000012345AAA",
    "Update case status from UI workflow",
    "UNRESOLVED:",
    "TODO",
    "FIXME",
    "Lorem ipsum",
    "[NEEDS EVIDENCE",
    "Heuristic extraction in use",
    "Baseline extraction. Replace with CV pipeline",
    "Commit the current form",
)
#: Sources that are real, and the confidence that deriving a specification reaches at most.
REAL_EXTRACTION, REAL_TELEMETRY = ("dom-capture", "cv"), ("live-org",)
MOST_CONFIDENCE = 0.7
PASSING, MODERATE, DISPLAY_CAP = 75, 60, 59


def content_signature(text: Column, stopwords=STOPWORDS) -> Column:
    """The sorted set of a text's content words; null if there are fewer than two."""
    words = F.array_distinct(F.filter(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), 0), lambda w: ~w.isin(*stopwords)))
    return let(words, lambda found: F.when(F.size(found) >= 2, F.array_join(F.sort_array(found), " ")))


def near_duplicates(lines: DataFrame, text: str, keys=KEYS) -> DataFrame:
    """Different texts of a capture with the same content words: groups by signature, so no pairs are compared.

    What is shuffled are signatures' hashes and texts' hashes, once for each text of a task.
    """
    bare = F.trim(F.col(text))
    signed = lines.select(*keys, content_signature(F.col(text)).alias("signature"), F.xxhash64(bare).alias("_text")).filter("signature is not null")
    texts = signed.groupBy(*keys, "signature", "_text").agg(F.count("*").alias("_n"))
    return texts.groupBy(*keys, "signature").agg(F.count("*").alias("n_texts"), F.sum("_n").alias("n_rows")).filter("n_texts > 1")


def placeholder_scan(text: Column, markers=MARKERS) -> Column:
    """Markers that stand in a text, as they are written."""
    return F.filter(F.array(*map(F.lit, markers)), lambda m: F.contains(F.coalesce(text, F.lit("")), m))


def weighted_gate(flags: dict[str, tuple[Column, int]]) -> Column:
    """Sum of the weights of the flags that hold; null flags do not."""
    return reduce(Column.__add__, [F.when(F.coalesce(flag, F.lit(False)), weight).otherwise(0) for flag, weight in flags.values()])


def band(score: Column) -> Column:
    return F.when(score >= PASSING, "high").when(score >= MODERATE, "moderate").otherwise("low")


def gate(score: Column, n_blockers: Column) -> dict[str, Column]:
    """passed, band and the score to display, which blockers cap."""
    return {"passed": (score >= PASSING) & (n_blockers == 0), "band": band(score), "display": F.when(n_blockers > 0, F.least(score, F.lit(DISPLAY_CAP))).otherwise(score)}


#: Weights of the facts of a run, and the limits of its gate.
RUN_WEIGHTS = {"preflight_ok": 10, "execution_ok": 15, "telemetry_ok": 15, "artifacts_ok": 15, "negative_tests_ok": 10, "evidence_is_real_ok": 20, "spec_derived_ok": 15}
RUN_PASSING, RUN_MODERATE = 85, 60
TOLD_FACTS = ("preflight_ok", "execution_ok", "telemetry_ok", "artifacts_ok", "negative_tests_ok")


def run_gate(runs: DataFrame, scored: DataFrame, keys=KEYS) -> DataFrame:
    """One row a run: gate_score, gate_band, gate_passed and what blocks it.

    ``runs``: the facts that a run tells of itself, critical_issue and output (its text).
    ``scored``: passed and blockers of its specification.  A run passes only if its specification
    does; one without a specification does not.
    """
    specs = scored.select(*keys, F.col("passed").alias("_passed"), F.col("blockers").alias("_blockers"))
    found = runs.join(specs, keys, "left").withColumn("_marks", placeholder_scan(F.col("output")))
    ok = F.coalesce(F.col("_passed"), F.lit(False)) & (F.coalesce(F.size("_blockers"), F.lit(0)) <= 0)
    facts = {name: F.col(name) for name in TOLD_FACTS} | {"evidence_is_real_ok": F.size("_marks") == 0, "spec_derived_ok": ok}
    points = weighted_gate({name: (flag, RUN_WEIGHTS[name]) for name, flag in facts.items()})
    of_spec = F.when(F.col("_passed").isNull(), F.array(F.lit("no specification"))).when(ok, F.array().cast("array<string>")).when(F.size("_blockers") > 0, F.col("_blockers")).otherwise(F.array(F.lit("specification not passed")))
    of_run = F.array(F.when(F.coalesce("critical_issue", F.lit(False)), F.lit("critical issue")), F.when(F.size("_marks") > 0, F.lit("placeholder")))
    blocking = F.concat(F.filter(of_run, lambda x: x.isNotNull()), of_spec)
    gated = found.select(*keys, points.alias("gate_score"), blocking.alias("blocking"))
    name = F.when(F.col("gate_score") >= RUN_PASSING, "high").when(F.col("gate_score") >= RUN_MODERATE, "medium").otherwise("low")
    return gated.withColumns({"gate_band": name, "gate_passed": (F.col("gate_score") >= RUN_PASSING) & (F.size("blocking") == 0)})


def honesty(confidence: Column, n_unknowns: Column, has_gaps: Column) -> Column:
    """0 to 20.  High confidence over gaps is worth nothing; low confidence that says what is unknown is worth all.

    ``has_gaps``: no object or no entity.  Without gaps, confidence beyond what deriving can reach costs up to half.
    """
    c = F.when(confidence.isNull() | F.isnan(confidence) | (F.abs(confidence) == float("inf")), 0.0).otherwise(F.greatest(F.least(confidence, F.lit(1.0)), F.lit(0.0)))
    over = F.least(F.bround((c - MOST_CONFIDENCE) / (1.0 - MOST_CONFIDENCE) * 10), F.lit(10.0))
    return (
        F.when((c >= MOST_CONFIDENCE) & has_gaps, 0)
        .when((c < MOST_CONFIDENCE) & (n_unknowns > 0), 20)
        .when(has_gaps, 10)
        .otherwise(20 - F.when(c > MOST_CONFIDENCE, over).otherwise(0.0))
        .cast("int")
    )


def provenance(extraction: Column, telemetry: Column) -> dict[str, Column]:
    """5 if both sources are known to be real; 0 without a blocker if neither is told; else 0 with one."""
    real = F.coalesce(extraction.isin(*REAL_EXTRACTION), F.lit(False)) & F.coalesce(telemetry.isin(*REAL_TELEMETRY), F.lit(False))
    told = extraction.isNotNull() | telemetry.isNotNull()
    return {"score": F.when(real, 5).otherwise(0), "blocked": told & ~real}


def field_claim_counts(entities: DataFrame, keys=KEYS, most: int = 3) -> DataFrame:
    """Claims by object and field, padded if there are more than ``most``."""
    return entities.groupBy(*keys, "object_name", "field_name").agg(F.count("*").alias("n_claims"), F.count_distinct("detail").alias("n_details")).withColumn("padding", F.col("n_claims") > most)
