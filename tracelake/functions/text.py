"""String columns: name prefixes, redaction rules, PII counts, truncation, sensitive keys."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Redaction rules, applied in this order.
MASK_RULES: list[tuple[str, str]] = [
    (r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b", "[EMAIL_REDACTED]"),
    (r"\b(?:\d{4}[ -]?){3}\d{4}\b", "[CARD_REDACTED]"),
    (r"\b\d{3}-\d{2}-\d{4}\b", "[SSN_REDACTED]"),
    (r"(?i)\b(?:sk-[a-zA-Z0-9_-]{20,}|bearer\s+[a-zA-Z0-9._~+/-]{15,}=*)\b", "[KEY_REDACTED]"),
    (r"\b(?:\+?\d{1,3}[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b", "[PHONE_REDACTED]"),
]

# Key names whose whole value is redacted.
SENSITIVE_KEYS: list[str] = [
    "password", "passwd", "secret", "token", "access_token", "api_key", "apikey",
    "authorization", "cookie", "set-cookie", "private_key", "client_secret",
    "refresh_token", "ssn", "session", "session_id",
]

# Request headers never stored.
PRIVATE_HEADERS: list[str] = ["authorization", "cookie", "set-cookie", "x-api-key"]

REDACTED = "[REDACTED]"
MAX_TEXT = 10_000
MAX_ITEMS = 100
MAX_DEPTH = 8


def mask_rules(extra: Iterable[tuple[str, str]] = ()) -> list[tuple[str, str]]:
    """The standard rules followed by the caller's own (Java regex syntax)."""
    return MASK_RULES + list(extra)


def sensitive_keys(extra: Iterable[str] = ()) -> list[str]:
    return sorted(set(SENSITIVE_KEYS) | {key.lower() for key in extra})


def _unicode(pattern: str) -> str:
    # Word boundaries, digits and blanks follow Unicode, not only ASCII.
    return "(?U)" + pattern


def mask_text(col: Column, rules: list[tuple[str, str]] | None = None) -> Column:
    for pattern, placeholder in MASK_RULES if rules is None else rules:
        col = F.regexp_replace(col, _unicode(pattern), placeholder)
    return col


# What a text must contain for a standard rule to match at all; spares most texts the costly search.
_NEEDS: dict[str, str] = {
    "[EMAIL_REDACTED]": "contains({0}, '@')",
    "[CARD_REDACTED]": "rlike({0}, r'(?U)\\d{{4}}')",
    "[SSN_REDACTED]": "rlike({0}, r'(?U)\\d{{3}}-\\d{{2}}-')",
    "[KEY_REDACTED]": "rlike({0}, '(?i)sk-|bearer')",
    "[PHONE_REDACTED]": "rlike({0}, r'(?U)\\d{{4}}')",
}


def _worth_trying(column: str, rule: tuple[str, str]) -> Column:
    return F.expr(_NEEDS[rule[1]].format(f"`{column}`")) if rule in MASK_RULES else F.lit(True)


def mask_column(df: DataFrame, column: str, rules: list[tuple[str, str]] | None = None) -> DataFrame:
    """``mask_text`` on a column, rule by rule, skipping rules that cannot match a text."""
    for rule in MASK_RULES if rules is None else rules:
        replaced = F.regexp_replace(column, _unicode(rule[0]), rule[1])
        df = df.withColumn(column, F.when(_worth_trying(column, rule), replaced).otherwise(F.col(column)))
    return df


def count_matches(df: DataFrame, column: str, rules: list[tuple[str, str]] | None = None) -> DataFrame:
    """Adds one count per rule of what masking would redact, rule after rule."""
    names = []
    df = df.withColumn("_text", F.col(column))
    for rule in MASK_RULES if rules is None else rules:
        pattern, placeholder = rule
        name = "n_" + placeholder.strip("[]").lower().removesuffix("_redacted")
        found = F.regexp_count("_text", F.lit(_unicode(pattern))).cast("bigint")
        df = df.withColumn(name, F.when(_worth_trying("_text", rule), found).otherwise(F.lit(0).cast("bigint")))
        masked = F.regexp_replace("_text", _unicode(pattern), placeholder)
        df = df.withColumn("_text", F.when(F.col(name) > 0, masked).otherwise(F.col("_text")))
        names.append(name)
    return df.drop("_text")


def is_sensitive_key(key: Column, keys: list[str] | None = None) -> Column:
    keys = SENSITIVE_KEYS if keys is None else keys
    name = F.trim(F.lower(key), F.lit(" \t\n\r\x0b\x0c"))
    parts = F.split(name, r"[_\-.]+")
    return name.isin(keys) | F.arrays_overlap(parts, F.array(*[F.lit(k) for k in keys]))


def trimmed(expr: str) -> str:
    return f"trim(BOTH ' \\t\\n\\r\\u000b\\u000c' FROM {expr})"


def strip_call_prefix(name: str) -> str:
    """SQL for a span name without its model-call prefixes."""
    return f"replace(replace({name}, 'LLM: ', ''), 'Chat: ', '')"


def strip_tool_prefix(name: str) -> str:
    return trimmed(f"replace({name}, 'Tool: ', '')")


def truncate_text(col: Column, limit: int = MAX_TEXT) -> Column:
    left_out = (F.length(col) - F.lit(limit)).cast("string")
    return F.when(
        F.length(col) > limit,
        F.concat(F.left(col, F.lit(limit)), F.lit("... <Truncated: "), left_out, F.lit(" chars omitted>")),
    ).otherwise(col)


def truncate_list(col: Column, limit: int = MAX_ITEMS) -> Column:
    """Cap an array of strings, ending with a marker that tells how many were left out."""
    marker = F.concat(
        F.lit("<Truncated: "),
        (F.size(col) - F.lit(limit)).cast("string"),
        F.lit(" items omitted for trace efficiency>"),
    )
    return F.when(F.size(col) > limit, F.concat(F.slice(col, 1, limit), F.array(marker))).otherwise(col)
