"""Live time series: figures per minute that add up, kept current by a stream of trace rows.

A micro-batch adds one segment: per minute, environment, project and duration how many traces, how many failed, their cost and
tokens; and per model its calls. Sums of segments are figures again, so a percentile stays exact, late rows count, and full
levels are merged (``versions``), which bounds the folders. The batch's number is committed with its segment, so a batch
that runs again changes nothing. A row with ``sign`` -1 takes a former one back.

Ranges are taken in whole minutes: from the minute of the start up to that of the end.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tracelake.functions.numbers import cents, half_up, pct
from tracelake.operators.analytics import Grid, bucket_of, filled_series, resolve_window
from tracelake.operators.listing import same_text
from tracelake.operators.order_stats import ceil_rank, order_statistic
from tracelake.sources import versions

_KEYS = ("minute", "environment", "project", "duration", "model")
_SUMS = ("n", "errors", "cost", "tokens")
_SCHEMA = (
    "minute timestamp, environment string, project string, duration decimal(18,2), model string, "
    "n bigint, errors bigint, cost decimal(28,6), tokens bigint"
)


def minute_figures(rows: DataFrame) -> DataFrame:
    """The figures of some trace rows; columns that are missing count as null, a missing ``sign`` as 1."""
    kinds = {"environment": "string", "project": "string", "status": "string", "has_error": "boolean", "duration_ms": "double", "estimated_cost": "decimal(18,6)", "total_tokens": "bigint", "model_counts": "map<string,bigint>", "sign": "int"}
    told = {name: (F.col(name) if name in rows.columns else F.lit(None)).cast(kind) for name, kind in kinds.items()}
    failed = F.coalesce(F.col("has_error"), F.lit(False)) | F.coalesce(F.col("status") == "failed", F.lit(False))
    flat = rows.select("start_time", *[c.alias(n) for n, c in told.items()]).select(
        F.date_trunc("minute", "start_time").alias("minute"), "environment", "project",
        F.col("duration_ms").cast("decimal(18,2)").alias("duration"), "model_counts", failed.cast("int").alias("failed"),
        F.coalesce("estimated_cost", F.lit(0)).alias("cost"), F.coalesce("total_tokens", F.lit(0)).alias("tokens"),
        F.coalesce("sign", F.lit(1)).alias("sign"),
    )
    whole = flat.select(
        "minute", "environment", "project", "duration", F.lit(None).cast("string").alias("model"), F.col("sign").cast("bigint").alias("n"),
        (F.col("failed") * F.col("sign")).cast("bigint").alias("errors"), (F.col("cost") * F.col("sign")).cast("decimal(28,6)").alias("cost"),
        (F.col("tokens") * F.col("sign")).alias("tokens"),
    )
    calls = flat.select("minute", "environment", "project", "sign", F.explode("model_counts").alias("model", "calls")).select(
        "minute", "environment", "project", F.lit(None).cast("decimal(18,2)").alias("duration"), "model", (F.col("calls") * F.col("sign")).alias("n"),
        F.lit(0).cast("bigint").alias("errors"), F.lit(0).cast("decimal(28,6)").alias("cost"), F.lit(0).cast("bigint").alias("tokens"),
    )
    return _summed(whole.unionByName(calls))


def _summed(figures: DataFrame) -> DataFrame:
    """Figures added up by their keys, what has come to nothing left out."""
    kinds = dict(part.rsplit(" ", 1) for part in _SCHEMA.replace("decimal(28,6)", "decimal(28;6)").split(", "))
    sums = [F.sum(name).cast(kinds[name].replace(";", ",")).alias(name) for name in _SUMS]
    extra = [F.max("version").alias("version"), F.first("bucket").alias("bucket"), F.lit(False).alias("gone")] if "version" in figures.columns else []
    summed = figures.groupBy(*_KEYS).agg(*sums, *extra)
    return summed.filter("n <> 0 or errors <> 0 or cost <> 0 or tokens <> 0")


def live_series(rows: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Keep the figures under ``path`` up to date with a stream of trace rows (start_time and what else is known)."""

    def add(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        version = versions.current(spark, path) or {"number": 0, "buckets": 1, "figures": [], "batch": -1, "replaced": []}
        if batch_id <= version["batch"]:
            return
        version = {**version, "number": version["number"] + 1, "batch": batch_id}
        segment = versions.write_segment(minute_figures(batch).withColumn("gone", F.lit(False)), path, "figures", version, key="minute")
        kept, replaced = versions.merged(spark, path, "figures", [*version["figures"], segment], _SCHEMA, version, _summed, "minute")
        versions.commit(spark, path, {**version, "figures": kept}, replaced)

    writer = rows.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def stored_figures(spark: SparkSession, path: str) -> DataFrame:
    """All figures of the segments; those of a key may lie in several."""
    version = versions.current(spark, path)
    return versions.entries(spark, path, "figures", version["figures"] if version else [], _SCHEMA).select(*_KEYS, *_SUMS)


def _in_range(figures: DataFrame, grid: Grid, environment: str | None, project: str | None) -> DataFrame:
    first = F.date_trunc("minute", F.lit(grid.start).cast("timestamp"))
    found = figures.filter((F.col("minute") >= first) & (F.col("minute") < F.lit(grid.end).cast("timestamp")))
    for name, value in {"environment": environment, "project": project}.items():
        if value:
            found = found.filter(same_text(F.col(name), value))
    return found.withColumn("bucket", F.greatest(bucket_of(F.col("minute"), grid), F.lit(0)))


def series(
    spark: SparkSession,
    path: str,
    window: str | None = "24h",
    environment: str | None = None,
    project: str | None = None,
    start: datetime | None = None,
    end: datetime | None = None,
    as_of: datetime | None = None,
) -> DataFrame:
    """What ``timeseries`` gives, from the live figures."""
    grid = resolve_window(window, start, end, as_of)
    placed = _in_range(stored_figures(spark, path).filter("model is null"), grid, environment, project)
    timed = F.when(F.col("duration").isNotNull(), F.col("n"))
    sums = placed.groupBy("bucket").agg(
        F.sum("n").alias("_count"), F.sum("errors").alias("_errors"), F.sum(timed).alias("_timed"),
        F.sum(cents(F.col("duration")) * timed).alias("_cents"), F.sum("cost").alias("_cost"), F.sum("tokens").alias("_tokens"),
    )
    p95 = order_statistic(placed.select("bucket", "duration", "n"), ["bucket"], "duration", ceil_rank, "_p95", weight="n")
    return filled_series(spark, grid, sums.join(p95, "bucket", "left")).orderBy("bucket")


def series_models(
    spark: SparkSession,
    path: str,
    window: str | None = "24h",
    environment: str | None = None,
    project: str | None = None,
    start: datetime | None = None,
    end: datetime | None = None,
    as_of: datetime | None = None,
) -> DataFrame:
    """What ``timeseries_models`` gives, from the live figures."""
    grid = resolve_window(window, start, end, as_of)
    placed = _in_range(stored_figures(spark, path).filter("model is not null"), grid, environment, project)
    return placed.groupBy("bucket", "model").agg(F.sum("n").alias("calls")).filter("calls <> 0").orderBy("bucket", "model")


def tumbling(figures: DataFrame, width: str = "1 hour") -> DataFrame:
    """Tumbling buckets of whole minutes over figures: counts, errors, duration."""
    start = F.window("minute", width)["start"]
    placed = figures.filter("model is null").select(start.alias("bucket_start"), "duration", "errors", "n")
    timed = F.when(F.col("duration").isNotNull(), F.col("n"))
    sums = placed.groupBy("bucket_start").agg(
        F.sum("n").alias("trace_count"),
        F.sum("errors").alias("error_count"),
        F.coalesce(F.sum(timed), F.lit(0)).alias("_timed"),
        F.coalesce(F.sum(cents(F.col("duration")) * timed), F.lit(0)).alias("_cents"),
    )
    p95 = order_statistic(placed, ["bucket_start"], "duration", ceil_rank, "_p95", weight="n")
    average = half_up(F.col("_cents"), F.col("_timed") * 100, 2)
    return sums.join(p95, "bucket_start", "left").select(
        "bucket_start", "trace_count", "error_count",
        pct(F.col("error_count"), F.col("trace_count")).alias("error_rate"),
        average.alias("avg_duration_ms"),
        F.greatest(F.coalesce(F.col("_p95").cast("double"), F.lit(0.0)), average).alias("p95_duration_ms"),
    )
