"""Evaluation verdicts: union of the records in trace metadata and those on eval spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.functions.documents import canonical_json


def metadata_evals(metadata: str) -> str:
    """SQL: eval records of a trace as canonical JSON texts; an empty array if there are none."""
    records = f"try_variant_get(try_parse_json({metadata}), '$.evals', 'array<variant>')"
    return f"coalesce(transform({records}, record -> to_json(record)), cast(array() as array<string>))"


def record_passed(record: str) -> str:
    """SQL: a record without a verdict counts as passed; null, zero and empty verdicts do not."""
    verdict = f"to_json(try_variant_get(try_parse_json({record}), '$.passed', 'variant'))"
    return f"""coalesce({verdict} not in ('false', 'null', '0', '0.0', '""', '[]', '{{}}'), true)"""


def eval_figures(listed: str, recorded: str, bare: str, bare_failed: str) -> tuple[str, str]:
    """SQL for eval_count and eval_status from metadata records, distinct span records, and how many
    eval spans carry no record and how many of those failed. Records listed twice in metadata count
    twice.
    """
    extra = f"array_except({recorded}, {listed})"
    count = f"cast(size({listed}) + size({extra}) + {bare} as bigint)"
    passed = f"forall(concat({listed}, {extra}), record -> {record_passed('record')}) and {bare_failed} = 0"
    return count, f"case when {count} = 0 then null when {passed} then 'passed' else 'failed' end"


def eval_rollup(traces: DataFrame, spans: DataFrame) -> DataFrame:
    """Per trace: eval_count, and passed / failed / null.

    Everything is counted, so no trace is gathered into one place: the rows of a record in one trace collapse by grouping, as
    many as the metadata lists, else one, and the few that are left are added up. Spans and traces are read once each for it.
    """
    listed = traces.select(F.col("id").alias("trace_id"), F.explode(F.expr(metadata_evals("metadata"))).alias("record"))
    eval_spans = spans.filter(F.col("span_type") == "eval").select(
        "trace_id", F.expr(f"nullif({canonical_json('eval')}, '')").alias("record"), (F.col("status") == "completed").alias("passed")
    )
    both = listed.select("*", F.lit(True).alias("passed"), F.lit(1).alias("listed")).unionByName(eval_spans.withColumn("listed", F.lit(0)))
    each = both.groupBy("trace_id", "record").agg(F.sum("listed").alias("listed"), F.count("*").alias("n"), F.bool_and("passed").alias("passed"))
    bare = F.col("record").isNull()
    judged = each.select(
        "trace_id",
        F.when(bare, F.col("n")).otherwise(F.greatest("listed", F.lit(1))).alias("n"),
        F.when(bare, F.col("passed")).otherwise(F.expr(record_passed("record"))).alias("passed"),
    )
    counted = judged.groupBy("trace_id").agg(F.sum("n").alias("n"), F.bool_and("passed").alias("all_passed"))
    joined = traces.select(F.col("id").alias("trace_id")).join(counted, "trace_id", "left")
    return joined.select(
        F.col("trace_id").alias("id"),
        F.coalesce("n", F.lit(0)).alias("eval_count"),
        F.when(F.col("all_passed"), "passed").when(~F.col("all_passed"), "failed").alias("eval_status"),
    )


def append_evals(traces: DataFrame, evals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Record evaluations (trace_id, name, score, passed, reason, timestamp).

    Returns traces with the records added to ``metadata.evals`` and the eval spans to append, one per
    record, failed where the evaluation did not pass.
    """
    reason = F.to_json(F.struct("name", "passed", "reason", "score", "timestamp"), {"ignoreNullFields": "false"})
    known = evals.join(traces.select(F.col("id").alias("trace_id")), "trace_id", "left_semi")
    records = known.withColumn("record", F.to_json(F.parse_json(reason)))
    added = records.groupBy("trace_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("timestamp", "record"))), lambda x: x["record"]).alias("_added")
    )
    joined = traces.join(added.withColumnRenamed("trace_id", "id"), "id", "left")
    fields = F.coalesce(
        F.try_variant_get(F.try_parse_json("metadata"), "$", "map<string,variant>"),
        F.from_json(F.lit("{}"), "map<string,variant>"),
    )
    texts = F.transform_values(fields, lambda _, v: F.to_json(v))
    listed = F.concat(F.lit("["), F.array_join(F.concat(F.expr(metadata_evals("metadata")), F.col("_added")), ","), F.lit("]"))
    merged = F.map_concat(F.map_filter(texts, lambda k, _: k != "evals"), F.create_map(F.lit("evals"), listed))
    metadata = F.when(F.col("_added").isNull(), F.col("metadata")).otherwise(map_to_json(merged))
    verdict = F.to_json(F.struct("passed", "reason", "score"), {"ignoreNullFields": "false"})
    spans = records.select(
        "trace_id",
        F.concat(F.lit("span_"), F.left(F.sha2(F.concat_ws("|", "trace_id", "record"), 256), F.lit(12))).alias("id"),
        F.concat(F.lit("Eval: "), "name").alias("name"),
        F.lit("eval").alias("span_type"),
        F.when(F.col("passed"), "completed").otherwise("failed").alias("status"),
        F.col("timestamp").alias("start_time"),
        F.col("timestamp").alias("end_time"),
        F.lit(0.0).alias("duration_ms"),
        verdict.alias("inputs"),
        verdict.alias("outputs"),
        F.col("record").alias("eval"),
    )
    return joined.withColumn("metadata", metadata).drop("_added"), spans


def map_to_json(texts: Column) -> Column:
    """A map of JSON texts as one key-sorted JSON object."""
    pairs = F.array_sort(F.map_entries(texts))
    # A key becomes a JSON string by serialising it inside a one-field object.
    members = F.transform(
        pairs,
        lambda e: F.concat(F.regexp_extract(F.to_json(F.struct(e["key"].alias("k"))), r"(?s)^\{\"k\":(.*)\}$", 1), F.lit(":"), e["value"]),
    )
    return F.concat(F.lit("{"), F.array_join(members, ","), F.lit("}"))
