"""Secret and personal data in columns: tests, in-text replacement, maps, URLs, reports.

All are built-in expressions.  Matches of each kind are extracted with their places, checked
where a format is not enough (card numbers, record ids, tokens with a header), and replaced by
place in one go.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names of fields that hold secrets.
SENSITIVE_FIELDS = (
    r"pass(?:word)?",
    r"passwd",
    r"secret",
    r"token",
    r"bearer",
    r"ssn",
    r"social[_\s-]?security",
    r"credit[_\s-]?card",
    r"card[_\s-]?number",
    r"cardnum",
    r"cvv",
    r"cvc",
    r"\bpin\b",
    r"auth",
    r"api[_\s-]?key",
    r"apikey",
    r"private[_\s-]?key",
    r"routing",
    r"account[_\s-]?number",
    r"iban",
    r"swift",
    r"sort[_\s-]?code",
    r"tax[_\s-]?id",
    r"ein",
    r"nin",
    r"licen[cs]e",
    r"passport",
)
#: Forms of secrets.
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"
SSN = r"\b(?!000|666|9\d{2})([0-8]\d{2})-(?!00)(\d{2})-(?!0000)(\d{4})\b"
PHONE = r"\b(\+?1[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b"
SESSION_TOKEN = r"\b00D[A-Za-z0-9]{12,15}![A-Za-z0-9._-]+\b"
JWT = r"\beyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\b"
PRIVATE_KEY = r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]+-----END [A-Z ]*PRIVATE KEY-----"
AWS_KEY = r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b"
GITHUB_TOKEN = r"\bgh[pousr]_[A-Za-z0-9]{36,}\b"
SLACK_TOKEN = r"\bxox[baprs]-[A-Za-z0-9-]+\b"
BEARER = r"\bBearer\s+[A-Za-z0-9._-]{20,}\b"
CARD = r"\b[\d\s-]{13,23}\b"
RECORD_ID = r"\b[A-Za-z0-9]{15}(?:[A-Za-z0-9]{3})?\b"
#: URL parameters that carry credentials.
URL_PARAMS = ("sid", "access_token", "refresh_token", "id_token", "code", "session", "sessionid", "session_id", "sid_client", "assertion", "client_secret", "apikey", "api_key", "signature", "sig", "token", "auth", "password", "pw")
#: The alphabet of a record id's check characters.
CHECK_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ012345"


@dataclass(frozen=True)
class Policy:
    """``mode``: mask, hash or drop.  Text is scrubbed of the gated kinds only where asked."""

    mode: str = "mask"
    salt: str = ""
    emails: bool = True
    phones: bool = True
    record_ids: bool = True


def is_sensitive_field(name: Column, aria_label: Column | None = None, elem_type: Column | None = None) -> Column:
    pattern = "(?i)" + "|".join(f"(?:{p})" for p in SENSITIVE_FIELDS)
    hit = F.coalesce(name, F.lit("")).rlike(pattern)
    if aria_label is not None:
        hit = hit | F.coalesce(aria_label, F.lit("")).rlike(pattern)
    return hit if elem_type is None else hit | (F.lower(F.coalesce(elem_type, F.lit(""))) == "password")


def digits(text: Column) -> Column:
    return F.regexp_replace(text, r"[\s-]", "")


def is_card(candidate: Column) -> Column:
    """13 to 19 digits whose check digit is right."""
    d = digits(candidate)
    return F.coalesce(d.rlike(r"^\d{13,19}$") & F.call_function("luhn_check", d), F.lit(False))


def is_jwt(token: Column) -> Column:
    """The first part decodes to JSON with an ``alg``."""
    head = F.translate(F.split_part(token, F.lit("."), F.lit(1)), "-_", "+/")
    padded = F.concat(head, F.repeat(F.lit("="), ((F.lit(4) - F.length(head) % 4) % 4).cast("int")))
    text = F.call_function("try_validate_utf8", F.try_to_binary(padded, F.lit("base64")).cast("string"))
    return F.coalesce(F.array_contains(F.json_object_keys(text), "alg"), F.lit(False))


def record_id_valid(value: Column) -> Column:
    """15 letters and digits; or 18, whose last three say which of the others are capitals."""
    alphabet = F.lit(CHECK_ALPHABET)

    def check(part: int) -> Column:
        bits = sum((F.when(F.substring(value, part * 5 + i + 1, 1).rlike("[A-Z]"), 1 << i).otherwise(0) for i in range(5)), F.lit(0))
        return F.substring(alphabet, bits + 1, F.lit(1))

    whole = value.rlike("^[A-Za-z0-9]{15}$")
    checked = value.rlike("^[A-Za-z0-9]{18}$") & (F.upper(F.substring(value, 16, 3)) == F.concat(check(0), check(1), check(2)))
    return F.coalesce(whole | checked, F.lit(False))


def secret_category(value: Column) -> Column:
    """The first kind of secret that a value holds; null if none."""
    jwts = F.filter(F.regexp_extract_all(value, F.lit(f"({JWT})"), 1), is_jwt)
    cards = F.filter(F.regexp_extract_all(value, F.lit(f"({CARD})"), 1), is_card)
    return (
        F.when(value.rlike(SESSION_TOKEN), "sf_session_token")
        .when(F.size(jwts) > 0, "jwt")
        .when(value.rlike(PRIVATE_KEY), "private_key")
        .when(value.rlike(AWS_KEY), "aws_key")
        .when(value.rlike(GITHUB_TOKEN), "github_token")
        .when(value.rlike(SLACK_TOKEN), "slack_token")
        .when(value.rlike(BEARER), "bearer_token")
        .when(F.size(cards) > 0, "credit_card")
        .when(value.rlike(SSN), "ssn")
    )


def hmac_sha256(text: Column, key: str) -> Column:
    """HMAC of the UTF-8 text, in hex: two nested digests over padded keys."""
    import hashlib

    raw = key.encode()
    raw = (hashlib.sha256(raw).digest() if len(raw) > 64 else raw).ljust(64, b"\0")
    inner, outer = (F.lit(bytearray(b ^ x for b in raw)) for x in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.encode(text, "utf-8")), 256))), 256)


def replacement(value: Column, category: str | Column, policy: Policy) -> Column:
    category = F.lit(category) if isinstance(category, str) else category
    if policy.mode == "drop":
        return F.lit("")
    if policy.mode == "hash":
        return F.concat(F.lit("[HASH:"), category, F.lit(":"), F.substring(hmac_sha256(value, policy.salt), 1, 12), F.lit("]"))
    return F.concat(F.lit("[REDACTED:"), category, F.lit("]"))


def redact_value(value: Column, field: Column, elem_type: Column | None = None, policy: Policy = Policy()) -> Column:
    """The whole value is replaced if its field or its form says so; the field comes first."""
    by_field = replacement(value, "sensitive_field", policy)
    category = secret_category(value)
    return F.when(value.isNull(), None).when(is_sensitive_field(field, None, elem_type), by_field).when(category.isNotNull(), replacement(value, category, policy)).otherwise(value)


@dataclass(frozen=True)
class Kind:
    """``hint``: what every match holds, so that texts without it skip the pattern."""

    category: str
    pattern: str
    hint: str
    check: Callable[[Column], Column] | None = None


def _kinds(policy: Policy) -> list[Kind]:
    """In the order of precedence among matches that start at one place."""
    kinds = [
        Kind("sf_session_token", SESSION_TOKEN, "00D"),
        Kind("jwt", JWT, "eyJ", is_jwt),
        Kind("private_key", PRIVATE_KEY, "PRIVATE KEY"),
        Kind("aws_key", AWS_KEY, "A"),
        Kind("github_token", GITHUB_TOKEN, "gh"),
        Kind("slack_token", SLACK_TOKEN, "xox"),
        Kind("bearer_token", BEARER, "Bearer"),
        Kind("credit_card", CARD, "", is_card),
        Kind("ssn", SSN, "-"),
    ]
    if policy.emails:
        kinds.append(Kind("email", EMAIL, "@"))
    if policy.phones:
        kinds.append(Kind("phone", PHONE, ""))
    if policy.record_ids:
        kinds.append(Kind("sf_record_id", RECORD_ID, "", record_id_valid))
    return kinds


SPAN = "struct<start:int,rank:int,size:int,value:string,category:string>"


def _found(text: Column, kind: Kind) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({kind.pattern})"), 1)


def _spans(text: Column, kind: Kind, rank: int) -> Column:
    """Matches of one kind with their places: the text between them has the lengths that places are sums of."""
    none = F.array().cast(f"array<{SPAN}>")
    between = F.arrays_zip(F.split(text, kind.pattern).alias("gap"), _found(text, kind).alias("value"))

    def step(acc, x):
        start = acc["at"] + F.length(x["gap"])
        span = F.struct(start.alias("start"), F.lit(rank).alias("rank"), F.length(x["value"]).alias("size"), x["value"].alias("value"), F.lit(kind.category).alias("category"))
        return F.struct((start + F.coalesce(F.length(x["value"]), F.lit(0))).alias("at"), F.when(x["value"].isNull(), acc["spans"]).otherwise(F.concat(acc["spans"], F.array(span))).alias("spans"))

    spans = F.aggregate(between, F.struct(F.lit(0).alias("at"), none.alias("spans")), step, lambda acc: acc["spans"])
    spans = spans if kind.check is None else F.filter(spans, lambda x: kind.check(x["value"]))
    return F.when(F.contains(text, F.lit(kind.hint)) & text.rlike(kind.pattern), spans).otherwise(none)


def text_categories(text: Column, policy: Policy = Policy()) -> Column:
    """All categories that the text holds, in the order of precedence, matches inside others included."""

    def holds(kind):
        hit = text.rlike(kind.pattern) if kind.check is None else F.exists(_found(text, kind), kind.check)
        return F.when(F.contains(text, F.lit(kind.hint)) & hit, F.lit(kind.category))

    return F.when(text.isNull(), F.array().cast("array<string>")).otherwise(F.filter(F.array(*map(holds, _kinds(policy))), lambda x: x.isNotNull()))


def redact_text(text: Column, policy: Policy = Policy()) -> Column:
    """The text with what it holds replaced by place: of matches that overlap, the leftmost, then the kind of precedence.

    Each kind is looked for in the text as it was, so nothing that was put in is matched and an
    equal string elsewhere stays.  A card is hashed by its digits; a record id keeps its prefix.
    """

    def put(span):
        value = F.when(span["category"] == "credit_card", digits(span["value"])).otherwise(span["value"])
        kept = F.when((span["category"] == "sf_record_id") & F.lit(policy.mode != "drop"), F.substring(span["value"], 1, 3)).otherwise("")
        return F.concat(kept, replacement(value, span["category"], policy))

    def leftmost(acc, x):
        return F.when(x["start"] >= acc["end"], F.struct((x["start"] + x["size"]).alias("end"), F.concat(acc["spans"], F.array(F.struct(acc["end"].alias("after"), x.alias("span")))).alias("spans"))).otherwise(acc)

    def whole(t):
        spans = F.array_sort(F.concat(*[_spans(t, kind, i) for i, kind in enumerate(_kinds(policy))]))
        first = F.struct(F.lit(0).alias("end"), F.array().cast(f"array<struct<after:int,span:{SPAN}>>").alias("spans"))

        def written(acc):
            parts = F.transform(acc["spans"], lambda x: F.concat(F.substring(t, x["after"] + 1, x["span"]["start"] - x["after"]), put(x["span"])))
            return F.concat(F.array_join(parts, ""), F.substring(t, acc["end"] + 1, F.length(t)))

        return F.aggregate(spans, first, leftmost, written)

    # bound to a lambda's variable, so that the text is made once
    return F.when(text.isNotNull(), F.get(F.transform(F.array(text), whole), F.lit(0)))


def redact_map(values: Column, policy: Policy = Policy()) -> Column:
    """Values of sensitive keys are masked, or dropped in drop mode; other values are scrubbed as text."""
    kept = F.map_filter(values, lambda k, v: ~is_sensitive_field(k)) if policy.mode == "drop" else values
    return F.transform_values(kept, lambda k, v: F.when(v.isNotNull() & is_sensitive_field(k), replacement(v, "sensitive_field", policy)).otherwise(redact_text(v, policy)))


def redact_url(url: Column, params=URL_PARAMS) -> Column:
    """Values of credential parameters are masked, their names kept."""
    return F.regexp_replace(url, r"(?i)([?&#])(" + "|".join(params) + r")=([^&#\s]+)", "$1$2=[REDACTED:url_credential]")


def url_has_credential(url: Column, params=URL_PARAMS) -> Column:
    return F.coalesce(url.rlike(r"(?i)[?&#](?:" + "|".join(params) + r")=[^&#\s]+"), F.lit(False))


def redact_session_ids(text: Column) -> Column:
    """In JSON text: values of session and authorization keys, and ``sid=`` in URLs."""
    keyed = F.regexp_replace(text, r'("(?:session_id|sessionId|Authorization)"\s*:\s*")(?:[^"\\]|\\.)*(")', "$1[REDACTED]$2")
    return F.regexp_replace(keyed, r"(?i)([?&]sid=)[^&#\s\"]+", "$1[REDACTED]")


def redact_columns(df: DataFrame, texts: list[str] = (), urls: list[str] = (), maps: list[str] = (), policy: Policy = Policy()) -> DataFrame:
    """Each named column scrubbed; ids, object names and field names are not named and stay."""
    out = {c: redact_text(F.col(c), policy) for c in texts} | {c: redact_url(F.col(c)) for c in urls} | {c: redact_map(F.col(c), policy) for c in maps}
    return df.withColumns(out)


def redaction_report(df: DataFrame, categories: str, keys: list[str] = ()) -> DataFrame:
    """Rows by category."""
    return df.select(*keys, F.explode(categories).alias("category")).groupBy(*keys, "category").agg(F.count("*").alias("n"))


def deny_list_hit(text: Column, tokens: list[str]) -> Column:
    """The text without all but letters and digits holds one of the tokens; an empty text holds none."""
    bare = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]", "")
    return F.exists(F.array(*[F.lit(t) for t in tokens]), lambda t: (t != "") & F.contains(bare, t)) if tokens else F.lit(False)
