"""Redaction jobs over whole traces and spans, and PII reports over text columns."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.functions.documents import mask_document, mask_document_lists
from tracelake.functions.text import (
    count_matches,
    is_sensitive_key,
    mask_column,
    mask_rules,
    mask_text,
    sensitive_keys,
)
from tracelake.operators.listing import scrub_headers
from tracelake.schema import FREE_SPAN_FIELDS

REDACTED_TRACE_FIELDS = ["input", "output", "error", "metadata"]


def pii_report(df: DataFrame, column: str, rules: list[tuple[str, str]] | None = None) -> DataFrame:
    """Each row with the number of matches per rule that masking would redact."""
    return count_matches(df, column, rules)


def redact_texts(df: DataFrame, columns: Iterable[str], extra_rules: Iterable[tuple[str, str]] = ()) -> DataFrame:
    rules = mask_rules(extra_rules)
    for name in columns:
        df = mask_column(df, name, rules)
    return df


def redact_map(df: DataFrame, column: str, extra_rules=(), extra_keys=()) -> DataFrame:
    """A map of texts: whole values under sensitive keys, matches in all others."""
    rules, keys = mask_rules(extra_rules), sensitive_keys(extra_keys)
    masked = F.transform_values(
        column, lambda k, v: F.when(is_sensitive_key(k, keys), "[REDACTED]").otherwise(mask_text(v, rules))
    )
    return df.withColumn(column, masked)


def mask_spans(spans: DataFrame, extra_rules=(), extra_keys=()) -> DataFrame:
    """Span rows with every free-form document redacted."""
    fields = [name for name in FREE_SPAN_FIELDS if name in spans.columns]
    return spans.withColumns({name: mask_document(F.col(name), extra_rules, extra_keys) for name in fields})


def mask_traces(traces: DataFrame, extra_rules=(), extra_keys=()) -> DataFrame:
    """Traces, also with nested spans, with every free-form document redacted and no credential headers."""
    fields = [name for name in REDACTED_TRACE_FIELDS if name in traces.columns]
    masked = traces.withColumns({name: mask_document(F.col(name), extra_rules, extra_keys) for name in fields})
    if "spans" in traces.columns:
        members = traces.schema["spans"].dataType.elementType.names
        free = [name for name in FREE_SPAN_FIELDS if name in members]
        hidden = [f"_masked_{name}" for name in free]
        lists = {h: mask_document_lists(F.col(f"spans.{n}"), extra_rules, extra_keys) for h, n in zip(hidden, free)}
        masked = masked.withColumns(lists)
        rebuilt = F.transform("spans", lambda s, i: F.struct(*[F.get(F.col(f"_masked_{n}"), i).alias(n) if n in free else s[n].alias(n) for n in members]))
        masked = masked.withColumn("spans", F.when(F.col("spans").isNotNull(), rebuilt)).drop(*hidden)
    return scrub_headers(masked) if "http" in traces.columns else masked
