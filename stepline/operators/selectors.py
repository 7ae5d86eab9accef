"""Ranking of an element's selectors: array expressions within the row, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Confidence by tier (1 test id, 2 role and name, 3 aria label, 4 label, 5 field, 6 text, 7 CSS path, 8 XPath).
CONFIDENCE = (0.95, 0.95, 0.85, 0.85, 0.80, 0.60, 0.35, 0.35)
#: Class names that a framework makes, names with a hash, ids that are counted.
FRAMEWORK_CLASS = r"\b(slds-[a-z_-]+|lwc-[a-z0-9_-]+|uiBlock[A-Za-z]+)\b"
HASHED = r"[a-z]+-[0-9a-f]{6,}"
COUNTED_ID = r"^(input|combobox-button|textarea|select)-[0-9]+$"


def tier_confidence(tier: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, CONFIDENCE)), F.greatest(F.least(tier, F.lit(8)), F.lit(1)).cast("int"))


def css_selector(css_path: Column) -> Column:
    """Shadow boundaries become descendants."""
    return F.replace(css_path, F.lit(" >>> "), F.lit(" "))


def css_confidence(css_path: Column, elem_id: Column) -> Column:
    """Tier 7's confidence less what makes the path brittle, rounded to hundredths."""
    s = css_selector(css_path)
    depth = F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit("")))
    less = lambda when, by: F.when(when, F.lit(by)).otherwise(0.0)
    total = (
        F.lit(CONFIDENCE[6])
        - less(depth > 4, 0.05)
        - less(s.contains("nth-child") | s.contains("nth-of-type"), 0.05)
        - less(s.rlike(FRAMEWORK_CLASS), 0.05)
        - less(s.rlike(HASHED), 0.05)
        - less(F.coalesce(elem_id, F.lit("")).rlike(COUNTED_ID), 0.10)
    )
    return F.round(F.greatest(F.least(total, F.lit(1.0)), F.lit(0.0)), 2)


def quoted(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))


def role_selector(role: Column, name: Column) -> Column:
    return F.when(F.coalesce(role, F.lit("")) != "", F.when(F.coalesce(name, F.lit("")) != "", F.concat(F.lit("role="), role, F.lit('[name="'), quoted(name), F.lit('"]'))).otherwise(F.concat(F.lit("role="), role)))


def candidates(c: dict[str, Column]) -> Column:
    """Array of (tier, rank, confidence, kind, selector), nulls and blanks left out.

    ``c``: columns test_id, role, role_name, aria, label_for, sf_field, text, css_path, xpath, elem_id.
    """
    made = [
        (1, "test_id", c["test_id"], None),
        (2, "role_name", role_selector(c["role"], c["role_name"]), None),
        (3, "aria", c["aria"], None),
        (4, "label_for", c["label_for"], None),
        (5, "sf_field", F.concat(F.lit('[data-field="'), quoted(c["sf_field"]), F.lit('"]')), None),
        (5, "sf_field", F.concat(F.lit('[field-name="'), quoted(c["sf_field"]), F.lit('"]')), None),
        (5, "sf_field", F.concat(F.lit('[name="'), quoted(c["sf_field"]), F.lit('"]')), None),
        (6, "text", F.concat(F.lit('text="'), quoted(F.nullif(F.trim(c["text"]), F.lit(""))), F.lit('"')), None),
        (7, "css", css_selector(c["css_path"]), css_confidence(c["css_path"], c["elem_id"])),
        (8, "xpath", F.concat(F.lit("xpath="), F.nullif(c["xpath"], F.lit(""))), None),
    ]
    rows = [
        F.when(
            F.coalesce(s, F.lit("")) != "",
            F.struct(F.lit(t).alias("tier"), (-(tier_confidence(F.lit(t)) if x is None else x)).alias("less"), F.lit(n).alias("place"), F.lit(kind).alias("kind"), s.alias("selector")),
        )
        for n, (t, kind, s, x) in enumerate(made)
    ]
    return F.filter(F.array(*rows), lambda x: x.isNotNull())


def rank_selectors(c: dict[str, Column]) -> Column:
    """Best first; of equal strings the best; never empty: ``body`` as tier 8 if there is nothing else."""
    def once(found):
        names = F.transform(found, lambda y: y["selector"])
        # one field of a lambda's variable, so that names are made once and not for each candidate
        kept = F.get(F.transform(F.array(F.struct(found.alias("found"), names.alias("names"))), lambda z: F.filter(z["found"], lambda x, i: F.array_position(z["names"], x["selector"]) == i + 1)), F.lit(0))
        return F.transform(kept, lambda x: F.struct(x["tier"].alias("tier"), (-x["less"]).alias("confidence"), x["kind"].alias("kind"), x["selector"].alias("selector")))

    ranked = F.get(F.transform(F.array(F.array_sort(candidates(c))), once), F.lit(0))
    fallback = F.array(F.struct(F.lit(8).alias("tier"), F.lit(CONFIDENCE[7]).alias("confidence"), F.lit("fallback").alias("kind"), F.lit("body").alias("selector")))
    return F.get(F.transform(F.array(ranked), lambda r: F.when(F.size(r) > 0, r).otherwise(fallback)), F.lit(0))


def best_selector(ranked: Column) -> Column:
    return F.element_at(ranked, 1)["selector"]


def selector_list(ranked: Column) -> Column:
    return F.transform(ranked, lambda x: x["selector"])


def selector_health(tier: Column) -> Column:
    return F.when(tier <= 2, "strong").when(tier <= 5, "moderate").otherwise("weak")


def health_distribution(df: DataFrame, ranked: str, keys=("capture_id",)) -> DataFrame:
    return df.withColumn("health", selector_health(F.element_at(ranked, 1)["tier"])).groupBy(*keys, "health").count()


def selector_explain(df: DataFrame, ranked: str, keep: list[str]) -> DataFrame:
    """One row for each candidate, with its rank."""
    return df.select(*keep, F.posexplode(ranked).alias("rank", "_c")).select(*keep, "rank", "_c.*")
