"""Times the headline queries and prints one JSON line.

The trace rows are derived and stored once, as a deployment would; the analytics then read the table.
"""

from __future__ import annotations

import json
import os
import tempfile
import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.operators import analytics, diff, listing, metrics, pricing, privacy, spans
from tracelake.plans.dashboard import store_stats
from tracelake.session import build_session, scratch_path
from tracelake.sources import driver_tables as src
from tracelake.sources import store
from tracelake.sources import traces as documents
from tracelake.streaming import live

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
REPEATS = 2


def run(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def timed(work: Callable[[], None], repeats: int = REPEATS) -> float:
    best = float("inf")
    for _ in range(repeats):
        start = time.perf_counter()
        work()
        best = min(best, time.perf_counter() - start)
    return round(best, 3)


def main() -> None:
    spark = build_session(
        "tracelake-bench",
        f"local[{CPUS}]",
        **{
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.sql.shuffle.partitions": CPUS,
            "spark.driver.memory": "16g",
            "spark.checkpoint.dir": tempfile.mkdtemp(prefix="tracelake-bench-"),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    table, inbox = scratch_path(spark, "rows"), scratch_path(spark, "inbox")

    def stored(df: DataFrame, label: str) -> DataFrame:
        """Sample frame as a table of several files, the way traces and spans lie in a deployment."""
        path = scratch_path(spark, label)
        df.repartition(int(CPUS)).write.parquet(path)
        return spark.read.parquet(path)

    begun = time.perf_counter()
    traces = stored(src.traces(spark, SF_DIR), "traces")
    span_rows = stored(src.spans(spark, SF_DIR), "spans")
    text = stored(src.table(spark, SF_DIR, "documents"), "documents")
    documents.export_traces(src.documents(spark, SF_DIR), None, inbox)
    prepared = round(time.perf_counter() - begun, 3)

    def series(rows: DataFrame) -> DataFrame:
        return analytics.timeseries(rows, "30d", as_of=src.AS_OF)

    def page(rows: DataFrame) -> None:
        shown, _ = listing.list_traces(rows, 50, 100, status="failed", search="wf_3")
        run(shown)

    times: dict[str, float] = {
        "trace_rows": timed(lambda: run(metrics.trace_rows(traces, span_rows))),
        "llm_metrics": timed(lambda: run(metrics.llm_metrics(span_rows))),
        "price_spans": timed(lambda: run(pricing.price_spans(span_rows))),
        "detect_tool_loops": timed(lambda: run(metrics.detect_tool_loops(span_rows))),
        "state_diff": timed(lambda: run(diff.state_diff(span_rows))),
        "span_tree": timed(lambda: run(spans.span_tree(span_rows))),
        "mask_text": timed(lambda: run(privacy.redact_texts(text, ["text"]))),
        "pii_report": timed(lambda: run(privacy.pii_report(text, "text"))),
        "write_trace_rows": timed(lambda: store.write_trace_rows(metrics.trace_rows(traces, span_rows), table, period="year"), 1),
    }
    rows = store.read_trace_rows(spark, table)
    times |= {
        "kpi_stats": timed(lambda: run(store_stats(rows))),
        "timeseries_30d": timed(lambda: run(series(rows))),
        "node_analytics_recent": timed(lambda: run(analytics.node_analytics(rows, n=500))),
        "node_analytics_all": timed(lambda: run(analytics.node_analytics(rows))),
        "list_traces": timed(lambda: page(rows)),
        "node_execution_totals": timed(lambda: run(analytics.node_execution_totals(rows))),
    }

    # One trace in a hundred comes again, into the filled table.
    again = rows.filter(F.pmod(F.xxhash64("id"), F.lit(100)) == 0).drop("start_date")
    times["upsert_second_batch"] = timed(lambda: store.upsert_into(table, again), 1)
    in_series = series(store.read_trace_rows(spark, table)).agg(F.sum("trace_count")).first()[0]

    def ingest() -> None:
        target, checkpoint = scratch_path(spark, "ingested"), scratch_path(spark, "checkpoint")
        live.stream_ingest(live.trace_stream(spark, inbox), target, checkpoint, period="year").awaitTermination()

    times["stream_ingest"] = timed(ingest, 1)
    print(json.dumps({"metric": "total_query_time", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(SF_DIR), "preparation": prepared, "timeseries_30d_rows": in_series}))
    spark.stop()


if __name__ == "__main__":
    main()
