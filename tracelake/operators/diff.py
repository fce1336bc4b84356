"""What a node changed: top-level differences between its input and its output state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.functions.documents import mask_document

CHANGE = "struct<key:string,action:string,old:string,new:string,appended_count:bigint,items:string>"


def _change(key: Column, action: str, old=None, new=None, count=None, items=None) -> Column:
    def or_null(value: Column | None, kind: str) -> Column:
        return F.lit(None).cast(kind) if value is None else value.cast(kind)

    return F.struct(
        key.alias("key"),
        F.lit(action).alias("action"),
        or_null(old, "string").alias("old"),
        or_null(new, "string").alias("new"),
        or_null(count, "bigint").alias("appended_count"),
        or_null(items, "string").alias("items"),
    )


def state_changes(before: Column, after: Column) -> Column:
    """Array of changes between two maps of JSON texts; keys missing afterwards are not reported.

    A list that grew counts as appended: how many, and the tail.
    """

    def one(entry: Column) -> Column:
        key, new = entry["key"], entry["value"]
        old = F.try_element_at(before, key)
        old_items = F.try_variant_get(F.try_parse_json(old), "$", "array<variant>")
        new_items = F.try_variant_get(F.try_parse_json(new), "$", "array<variant>")
        grown = F.size(new_items) - F.size(old_items)
        tail = F.transform(F.slice(new_items, F.size(old_items) + 1, F.greatest(grown, F.lit(0))), lambda v: F.to_json(v))
        items = F.concat(F.lit("["), F.array_join(tail, ","), F.lit("]"))
        return (
            F.when(old.isNull(), _change(key, "added", new=new))
            .when(old == new, F.lit(None).cast(CHANGE))
            .when(F.coalesce(grown, F.lit(0)) > 0, _change(key, "appended", count=grown, items=items))
            .otherwise(_change(key, "modified", old=old, new=new))
        )

    return F.filter(F.transform(F.map_entries(after), one), lambda change: change.isNotNull())


def _members(document: Column) -> Column:
    fields = F.try_variant_get(F.try_parse_json(document), "$", "map<string,variant>")
    return F.transform_values(fields, lambda _, value: F.to_json(value))


def state_diff(spans: DataFrame, mask: bool = False) -> DataFrame:
    """(trace_id, span_id, key, action, old, new, appended_count, items) of node spans.

    Both states of a span sit in its row, so nothing is shuffled. With ``mask`` states are redacted
    first and two values hidden by the same placeholder count as equal.
    """
    nodes = spans.filter((F.col("span_type") == "node") & F.col("inputs").isNotNull() & F.col("outputs").isNotNull())
    before, after = F.col("inputs"), F.col("outputs")
    if mask:
        before, after = mask_document(before), mask_document(after)
    states = nodes.select("trace_id", F.col("id").alias("span_id"), before.alias("_in"), after.alias("_out"))
    states = states.withColumns({"_before": _members(F.col("_in")), "_after": _members(F.col("_out"))})
    objects = F.col("_before").isNotNull() & F.col("_after").isNotNull()
    old, new = F.to_json(F.try_parse_json("_in")), F.to_json(F.try_parse_json("_out"))
    replaced = F.when(old != new, F.array(_change(F.lit("_state_"), "replaced", old=old, new=new)))
    changes = F.when(objects, state_changes(F.col("_before"), F.col("_after"))).otherwise(replaced)
    return states.select("trace_id", "span_id", F.explode(changes).alias("change")).select("trace_id", "span_id", "change.*")
