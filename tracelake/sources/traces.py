"""Reading, checking, completing and writing trace documents."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.functions.numbers import parse_iso
from tracelake.operators.metrics import default_environment
from tracelake.operators.pricing import RateCard
from tracelake.schema import (
    FREE_SPAN_FIELDS,
    FREE_TRACE_FIELDS,
    LATE_ROW_COLUMNS,
    RAW_TRACE,
    SPAN_TYPES,
    STATUSES,
)


def read_traces(spark: SparkSession, path: str | list[str], multi_line: bool = False) -> DataFrame:
    """Trace documents as written, one per line, or with ``multi_line`` one file per document or list.

    Lines that are no JSON come back in ``_corrupt_record``.
    """
    reader = spark.read.schema(RAW_TRACE).option("mode", "PERMISSIVE").option("multiLine", multi_line)
    return reader.option("columnNameOfCorruptRecord", "_corrupt_record").json(path)


def reject_reason(df: DataFrame) -> Column:
    """Why a document cannot be stored; null if it can."""

    def outside(value: Column, domain: list[str]) -> Column:
        return value.isNotNull() & ~value.isin(domain)

    def unreadable(time: Column) -> Column:
        return (F.coalesce(time, F.lit("")) != "") & parse_iso(time).isNull()

    def bad_span(span: Column) -> Column:
        return (
            span.isNull() | span["id"].isNull() | span["trace_id"].isNull() | span["name"].isNull()
            | outside(span["span_type"], SPAN_TYPES) | outside(span["status"], STATUSES)
        )

    col = F.col
    http = col("http")
    corrupt = col("_corrupt_record").isNotNull() if "_corrupt_record" in df.columns else F.lit(False)
    return (
        F.when(corrupt, "not JSON")
        .when(col("id").isNull(), "no id")
        .when(col("name").isNull(), "no name")
        .when(outside(col("status"), STATUSES), "unknown status")
        .when(
            http.isNotNull() & (http["method"].isNull() | http["path"].isNull() | http["url"].isNull()),
            "incomplete http",
        )
        .when(F.exists("spans", bad_span), "invalid span")
        .when(unreadable(col("start_time")) | unreadable(col("end_time")), "unreadable time")
    )


def split_valid(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents that can be stored, the others with ``reject_reason``)."""
    judged = df.withColumn("reject_reason", reject_reason(df))
    valid = judged.filter(F.col("reject_reason").isNull()).drop("reject_reason", "_corrupt_record")
    return valid, judged.filter(F.col("reject_reason").isNotNull())


def _default(value: Column, default: str) -> Column:
    return F.coalesce(value, F.lit(default))


def apply_defaults(df: DataFrame, now: datetime | Column | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """Raw documents to typed ones: defaults filled in, times parsed, free-form fields as JSON text.

    Columns to ``keep`` follow as they are.
    """
    moment = F.current_timestamp() if now is None else now if isinstance(now, Column) else F.lit(now).cast("timestamp")

    def text(value: Column, default: str | None = None) -> Column:
        if default is None:
            return F.to_json(value)
        # asked of the value, not of its text, which would be written twice
        return F.when(F.is_variant_null(value), default).otherwise(F.coalesce(F.to_json(value), F.lit(default)))

    def span(item: Column) -> Column:
        free = {name: text(item[name], "{}" if name == "metadata" else None) for name in FREE_SPAN_FIELDS}
        return F.struct(
            *[item[n].alias(n) for n in ("id", "trace_id", "parent_id", "name")],
            _default(item["span_type"], "custom").alias("span_type"),
            _default(item["status"], "running").alias("status"),
            F.coalesce(parse_iso(item["start_time"]), moment).alias("start_time"),
            parse_iso(item["end_time"]).alias("end_time"),
            item["duration_ms"].alias("duration_ms"),
            *[c.alias(n) for n, c in free.items()],
        )

    free = {name: text(F.col(name), "{}" if name == "metadata" else None) for name in FREE_TRACE_FIELDS}
    return df.select(
        "id", "name",
        _default(F.col("status"), "running").alias("status"),
        F.expr(default_environment("environment")).alias("environment"),
        "project",
        F.coalesce(parse_iso(F.col("start_time")), moment).alias("start_time"),
        parse_iso(F.col("end_time")).alias("end_time"),
        "duration_ms", "http",
        *[c.alias(n) for n, c in free.items()],
        F.coalesce(F.transform("spans", span), F.transform(F.from_json(F.lit("[]"), df.select("spans").schema["spans"].dataType), span)).alias("spans"),
        "graph_topology", *keep,
    )


def from_stored_rows(rows: DataFrame, column: str = "data_json", now: datetime | None = None) -> DataFrame:
    """Typed documents from a stored table that keeps each whole document as JSON text."""
    valid, _ = split_valid(parse_documents(rows, column))
    return apply_defaults(valid, now)


def parse_documents(rows: DataFrame, column: str) -> DataFrame:
    """Documents held as JSON text in a column, in the form ``read_traces`` gives them.

    Going through ``inline`` keeps the optimizer from parsing the text once per field.
    """
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}
    return rows.select(F.inline(F.array(F.from_json(F.col(column), RAW_TRACE, options))))


def get_traces(traces: DataFrame, ids: Sequence[str] | DataFrame) -> DataFrame:
    """Traces with the given ids, a list or a frame; ids not stored give no row."""
    if not isinstance(ids, DataFrame):
        ids = traces.sparkSession.createDataFrame([(i,) for i in ids], "id string")
    return traces.join(ids.select("id").distinct(), "id", "left_semi")


def export_documents(traces: DataFrame) -> DataFrame:
    """Typed documents as one JSON text each, free-form fields as real JSON again."""
    return traces.select(document_text(traces.columns).alias("value"))


def document_text(columns: Sequence[str]) -> Column:
    """The JSON text of typed documents with these columns."""

    def free(source: Column, names: list[str]) -> list[Column]:
        # the commonest text is parsed once for all
        empty = F.parse_json(F.lit("{}"))
        return [F.when(source[n] == "{}", empty).otherwise(F.try_parse_json(source[n])).alias(n) for n in names]

    plain_span = ["id", "trace_id", "parent_id", "name", "span_type", "status", "start_time", "end_time", "duration_ms"]
    spans = F.transform(
        "spans", lambda s: F.struct(*[s[n].alias(n) for n in plain_span], *free(s, FREE_SPAN_FIELDS))
    )
    plain = [c for c in columns if c not in (*FREE_TRACE_FIELDS, "spans")]
    document = F.struct(*plain, *[F.try_parse_json(n).alias(n) for n in FREE_TRACE_FIELDS], spans.alias("spans"))
    return F.to_json(document, {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"})


def export_traces(traces: DataFrame, ids: Sequence[str] | DataFrame | None, path: str, compression: str = "none") -> None:
    chosen = traces if ids is None else get_traces(traces, ids)
    export_documents(chosen).write.mode("overwrite").option("compression", compression).text(path)


def align_schema(rows: DataFrame) -> DataFrame:
    """Adds columns introduced later, with the value old rows take, and fills their gaps."""
    for name, (kind, default) in LATE_ROW_COLUMNS.items():
        fallback = F.lit(default).cast(kind)
        if name not in rows.columns:
            rows = rows.withColumn(name, fallback)
        elif default is not None:
            rows = rows.withColumn(name, F.coalesce(name, fallback))
    return rows


def rate_rows(spark: SparkSession, path: str) -> DataFrame:
    """Prices from a JSON object of models: [prompt, completion], or an object naming the two.

    Columns model, prompt_rate, completion_rate; members of another shape are skipped.
    """
    whole = spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("doc"))
    return rate_rows_from(whole, "doc")


def rate_rows_from(df: DataFrame, column: str) -> DataFrame:
    members = df.select(F.try_variant_get(column, "$", "map<string,variant>").alias("_members"))
    each = members.select(F.explode("_members").alias("model", "rates"))
    rate = "decimal(12,6)"
    pair = F.try_variant_get("rates", "$", "array<variant>")
    fields = F.try_variant_get("rates", "$", "map<string,variant>")

    def first_set(*names: str) -> Column:
        found = [F.nullif(F.try_variant_get("rates", f"$.{n}", rate), F.lit(0)) for n in names]
        return F.coalesce(*found, F.lit(0).cast(rate))

    def item(i: int) -> Column:
        return F.try_variant_get("rates", f"$[{i}]", rate)

    is_pair = pair.isNotNull() & (F.size(pair) >= 2)
    shaped = each.filter(is_pair | fields.isNotNull())
    return shaped.select(
        "model",
        F.when(is_pair, item(0)).otherwise(first_set("prompt", "input", "prompt_per_million")).alias("prompt_rate"),
        F.when(is_pair, item(1)).otherwise(first_set("completion", "output", "completion_per_million")).alias("completion_rate"),
    )


def load_rate_card(spark: SparkSession, source: str | dict, base: RateCard | None = None) -> tuple[RateCard, int]:
    """(rate card with the prices of a file or dict on top of ``base``, number of prices loaded)."""
    import json

    if isinstance(source, dict):
        whole = spark.range(1).select(F.try_parse_json(F.lit(json.dumps(source))).alias("doc"))
        rows = rate_rows_from(whole, "doc")
    else:
        rows = rate_rows(spark, source)
    loaded = rows.collect()  # one price list, already held as one document
    card = base or RateCard()
    for row in loaded:
        card = card.with_model(row["model"], row["prompt_rate"], row["completion_rate"])
    return card, len(loaded)
