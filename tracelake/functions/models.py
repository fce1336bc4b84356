"""Model names as SQL expressions: which one a call used and its normal form."""

from __future__ import annotations

from tracelake.functions.documents import json_text
from tracelake.functions.text import strip_call_prefix, trimmed


def normal_name(model: str) -> str:
    """'unknown' for nothing; else trimmed, lower case, without provider path or tag, '_' as '-'."""
    name = f"substring_index(substring_index(lower({trimmed(model)}), '/', -1), ':', 1)"
    return f"if({model} is null or {model} = '', 'unknown', replace({name}, '_', '-'))"


def span_model(usage_model: str, metadata_model: str, span_name: str) -> str:
    """First non-empty of the model in usage, the model in metadata, the span name without prefix."""
    return f"coalesce(nullif({usage_model}, ''), nullif({metadata_model}, ''), {strip_call_prefix(span_name)})"


def resolve_model_name(llm_output: str, invocation_params: str, metadata: str, serialized: str, default: str) -> str:
    """Ordered lookup over the JSON texts a model call carries, ending with a default."""
    places = [
        (llm_output, "model_name"),
        (llm_output, "model"),
        (invocation_params, "model_name"),
        (invocation_params, "model"),
        (metadata, "ls_model_name"),
        (metadata, "model"),
        (serialized, "name"),
    ]
    return f"coalesce({', '.join(json_text(text, key) for text, key in places)}, {default})"
