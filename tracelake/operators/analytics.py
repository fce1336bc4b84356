"""KPIs, time series and per-node figures over trace rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracelake.functions.numbers import bucket_label, cents, half_up, pct
from tracelake.operators.listing import filter_traces, recent
from tracelake.operators.order_stats import ceil_rank, floor_rank, order_statistic, order_statistic_with
from tracelake.session import stored

# Window tokens; any other token means a day.
WINDOWS = {
    "15m": timedelta(minutes=15),
    "1h": timedelta(hours=1),
    "24h": timedelta(hours=24),
    "7d": timedelta(days=7),
    "30d": timedelta(days=30),
}
# Fixed values: (longest range in seconds, number of buckets, bucket width in seconds).
GRIDS = [(900, 15, 60), (3600, 12, 300), (86400, 24, 3600), (604800, 14, 43200)]
WIDEST_GRID = (30, 86400)


def _zero(column: Column, kind: str = "bigint") -> Column:
    return F.coalesce(column, F.lit(0)).cast(kind)


def _errors() -> Column:
    return F.sum(F.when(F.col("has_error") | (F.col("status") == "failed"), 1))


def _added(aggregate: Column) -> tuple[Column, Callable[[Column], Column]]:
    """An aggregate whose values add up."""
    return aggregate, F.sum


def _kpi_sums() -> dict[str, tuple[Column, Callable[[Column], Column]]]:
    return {
        "total_traces": _added(F.count("*")),
        "completed_traces": _added(F.sum(F.when(F.col("status") == "completed", 1))),
        "failed_traces": _added(_errors()),
        "_timed": _added(F.count("duration_ms")),
        "_cents": _added(F.sum(cents(F.col("duration_ms")))),
        "total_tokens": _added(F.sum("total_tokens")),
        "total_llm_calls": _added(F.sum("llm_calls")),
        "total_cost": _added(F.sum("estimated_cost")),
    }


def _kpis(totals: DataFrame) -> list[Column]:
    def zero(name: str) -> Column:
        return _zero(F.col(name)).alias(name)

    return [
        zero("total_traces"), zero("completed_traces"), zero("failed_traces"),
        pct(_zero(F.col("completed_traces")), _zero(F.col("total_traces"))).alias("success_rate"),
        half_up(_zero(F.col("_cents")), _zero(F.col("_timed")) * 100, 2).alias("avg_duration_ms"),
        zero("total_tokens"), zero("total_llm_calls"), _zero(F.col("total_cost"), "decimal(28,6)").cast("double").alias("total_cost"),
    ]


def kpi_stats(rows: DataFrame) -> DataFrame:
    """One row of totals, success rate, average duration, tokens and cost; zeros for no traces."""
    totals = rows.agg(*[one.alias(n) for n, (one, _) in _kpi_sums().items()])
    return totals.select(*_kpis(totals))


def kpi_p95(rows: DataFrame) -> DataFrame:
    """The duration at index floor(0.95 (n - 1)), 0.0 if no trace has a duration."""
    durations = rows.select(F.col("duration_ms").cast("decimal(18,2)").alias("_duration"))
    found = order_statistic(durations, [], "_duration", floor_rank, "_p95")
    return found.agg(_zero(F.max("_p95"), "double").alias("p95_duration_ms"))


def kpi_board(rows: DataFrame, matching: Column | None = None) -> DataFrame:
    """``kpi_stats`` and ``kpi_p95`` in one row, and how many rows hold ``matching``, from two passes over the rows."""
    kept = rows.select(
        "status", "has_error", "duration_ms", "total_tokens", "llm_calls", "estimated_cost",
        F.col("duration_ms").cast("decimal(18,2)").alias("_duration"), (F.lit(True) if matching is None else F.coalesce(matching, F.lit(False))).alias("_hit"),
    )
    sums = {**_kpi_sums(), "matching": _added(F.count_if("_hit"))}
    found = order_statistic_with(kept, [], "_duration", floor_rank, "_p95", sums)
    # no row at all gives a row of nulls, which are zeros
    return found.select(*_kpis(found), _zero(F.col("_p95"), "double").alias("p95_duration_ms"), _zero(F.col("matching")).alias("matching"))


def node_execution_totals(rows: DataFrame, n: int | None = None) -> DataFrame:
    """Executions per node over all traces, or over the n newest."""
    counted = recent(rows.filter(F.col("node_counts").isNotNull()), n).select(F.explode("node_counts").alias("node_name", "n"))
    return counted.groupBy("node_name").agg(F.sum("n").alias("executions"))


@dataclass(frozen=True)
class Grid:
    start: datetime
    end: datetime
    buckets: int
    width: int


def resolve_window(
    window: str | None = "24h", start: datetime | None = None, end: datetime | None = None, as_of: datetime | None = None
) -> Grid:
    """Range and buckets of a time series. ``as_of`` is the moment tokens count back from."""
    if as_of is None:
        raise ValueError("as_of is required")
    begin = start or as_of - WINDOWS.get((window or "24h").lower(), WINDOWS["24h"])
    finish = end or as_of
    seconds = max(60, int((finish - begin).total_seconds()))
    for longest, buckets, width in GRIDS:
        if seconds <= longest:
            return Grid(begin, finish, buckets, width)
    least, width = WIDEST_GRID  # longer ranges take as many buckets as they need
    return Grid(begin, finish, max(least, -(-seconds // width)), width)


def in_grid(rows: DataFrame, grid: Grid, environment: str | None, project: str | None) -> DataFrame:
    return filter_traces(rows, environment=environment, project=project, from_time=grid.start, to_time=grid.end)


def bucket_of(time: Column, grid: Grid) -> Column:
    """Bucket of a time in the range; the moment that ends the last bucket belongs to it."""
    past = F.unix_micros(time) - F.unix_micros(F.lit(grid.start).cast("timestamp"))
    return F.least(F.call_function("div", past, F.lit(grid.width * 1_000_000).cast("bigint")), F.lit(grid.buckets - 1))


def zero_fill(spark: SparkSession, grid: Grid, figures: DataFrame) -> DataFrame:
    """Every bucket of the grid with its start and label, joined to its figures or nulls."""
    start = F.timestamp_micros(
        F.unix_micros(F.lit(grid.start).cast("timestamp")) + F.col("bucket") * F.lit(grid.width * 1_000_000)
    )
    every = spark.range(grid.buckets).select(F.col("id").alias("bucket")).withColumn("bucket_start", start)
    return every.withColumn("label", bucket_label(F.col("bucket_start"))).join(figures, "bucket", "left")


def timeseries(
    rows: DataFrame,
    window: str | None = "24h",
    environment: str | None = None,
    project: str | None = None,
    start: datetime | None = None,
    end: datetime | None = None,
    as_of: datetime | None = None,
) -> DataFrame:
    """One row per bucket: requests, errors, latency, cost, tokens."""
    grid = resolve_window(window, start, end, as_of)
    return _bucket_figures(in_grid(rows, grid, environment, project), grid).orderBy("bucket")


def timeseries_total(rows: DataFrame, grid: Grid, environment: str | None = None, project: str | None = None) -> int:
    """All traces in range; the buckets of the range add up to it."""
    return in_grid(rows, grid, environment, project).count()


def _bucket_figures(matching: DataFrame, grid: Grid) -> DataFrame:
    """Figures of every bucket of the grid."""
    placed = matching.withColumn("bucket", bucket_of(F.col("start_time"), grid))
    placed = placed.select(
        "bucket", "status", "has_error", F.col("duration_ms").cast("decimal(18,2)").alias("duration"),
        "estimated_cost", "total_tokens",
    )
    sums = {
        "_count": _added(F.count("*")),
        "_errors": _added(_errors()),
        "_timed": _added(F.count("duration")),
        "_cents": _added(F.sum(cents(F.col("duration")))),
        "_cost": _added(F.sum("estimated_cost")),
        "_tokens": _added(F.sum("total_tokens")),
    }
    return filled_series(matching.sparkSession, grid, order_statistic_with(placed, ["bucket"], "duration", ceil_rank, "_p95", sums))


def filled_series(spark: SparkSession, grid: Grid, figures: DataFrame) -> DataFrame:
    """The rows of a series from the sums and the percentile of the buckets that have any."""
    filled = zero_fill(spark, grid, figures)
    count, errors = _zero(F.col("_count")), _zero(F.col("_errors"))
    average = half_up(_zero(F.col("_cents")), _zero(F.col("_timed")) * 100, 2)
    return filled.select(
        "bucket", "bucket_start", "label",
        count.alias("trace_count"),
        F.greatest(count - errors, F.lit(0)).alias("success_count"),
        errors.alias("error_count"),
        pct(errors, count).alias("error_rate"),
        average.alias("avg_duration_ms"),
        F.greatest(_zero(F.col("_p95"), "double"), average).alias("p95_duration_ms"),
        F.round(_zero(F.col("_cost"), "decimal(28,6)"), 4).cast("double").alias("total_cost"),
        _zero(F.col("_tokens")).alias("total_tokens"),
    )


def timeseries_models(
    rows: DataFrame,
    window: str | None = "24h",
    environment: str | None = None,
    project: str | None = None,
    start: datetime | None = None,
    end: datetime | None = None,
    as_of: datetime | None = None,
) -> DataFrame:
    """Calls per bucket and model."""
    grid = resolve_window(window, start, end, as_of)
    placed = in_grid(rows, grid, environment, project).select(
        bucket_of(F.col("start_time"), grid).alias("bucket"), F.explode("model_counts").alias("model", "n")
    )
    return placed.groupBy("bucket", "model").agg(F.sum("n").alias("calls")).orderBy("bucket", "model")


def node_analytics(
    rows: DataFrame,
    window: str | None = None,
    environment: str | None = None,
    project: str | None = None,
    as_of: datetime | None = None,
    n: int | None = None,
) -> DataFrame:
    """Per node over all matching traces, or the n newest: how often it ran, failed and how long it took."""
    begin = resolve_window(window, as_of=as_of).start if window else None
    chosen = recent(filter_traces(rows, environment=environment, project=project, from_time=begin), n)
    # read twice below, and what rows are derived from is not
    chosen = stored(chosen.select("node_metrics"), "node-runs")
    # a trace tells its runs, each of its nodes once, and itself, under no name
    none = F.lit(None).cast("string")

    def fact(name: Column, status: Column, duration: Column, kind: str) -> Column:
        return F.struct(name.alias("node_name"), status.alias("status"), duration.cast("decimal(18,2)").alias("duration"), F.lit(kind).alias("kind"))

    ran = F.transform("node_metrics", lambda run: fact(run["name"], run["status"], run["duration_ms"], "run"))
    held = F.transform(F.array_distinct(F.transform("node_metrics", lambda run: run["name"])), lambda name: fact(name, none, none, "node"))
    facts = chosen.select(F.explode(F.concat(F.coalesce(F.concat(ran, held), F.slice(F.array(fact(none, none, none, "")), 1, 0)), F.array(fact(none, none, none, "trace")))).alias("f")).select("f.*")
    facts = facts.filter((F.col("kind") == "trace") | (F.col("node_name") != ""))
    sums = {
        "executions": _added(F.count_if(F.col("kind") == "run")),
        "traces_executed": _added(F.count_if(F.col("kind") == "node")),
        "_traces": _added(F.count_if(F.col("kind") == "trace")),
        "error_count": _added(F.sum(F.when(F.col("status") == "failed", 1))),
        "_timed": _added(F.count("duration")),
        "_cents": _added(F.sum(cents(F.col("duration")))),
        "_least": (F.min("duration"), F.min),
        "_most": (F.max("duration"), F.max),
    }
    figures = order_statistic_with(facts, ["node_name"], "duration", floor_rank, "_p95", sums)
    whole = F.max("_traces").over(Window.partitionBy())  # one row per node
    ranked = figures.withColumn("_whole", whole).filter(F.col("node_name").isNotNull()).select(
        "node_name", "executions", "traces_executed",
        pct(F.col("traces_executed"), F.col("_whole")).alias("frequency_pct"),
        _zero(F.col("error_count")).alias("error_count"),
        pct(_zero(F.col("error_count")), F.col("executions")).alias("error_rate"),
        half_up(_zero(F.col("_cents")), _zero(F.col("_timed")) * 100, 2).alias("avg_duration_ms"),
        *[_zero(F.col(f"_{c}"), "double").alias(f"{alias}_duration_ms")
          for c, alias in (("p95", "p95"), ("least", "min"), ("most", "max"))],
    )
    return rank_nodes(ranked)


def rank_nodes(nodes: DataFrame) -> DataFrame:
    return nodes.orderBy(F.col("frequency_pct").desc(), "node_name")
