import json
from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tracelake.operators import analytics, evals, listing, metrics, spans
from tracelake.plans import registry
from tracelake.plans.dashboard import dashboard
from tracelake.schema import TRACE, USAGE

START = datetime(2026, 1, 1, 12)


def canonical(value):
    return json.dumps(value, sort_keys=True, separators=(",", ":"))


def span(n, kind="custom", name="s", status="completed", duration=None, inputs=None, outputs=None, meta=None, trace="t1", parent=None):
    def text(value):
        return None if value is None else canonical(value)

    return (f"{trace}-{n}", trace, parent, name, kind, status, START + timedelta(seconds=n), None, duration, text(inputs), text(outputs), None, None, canonical(meta or {}))


def trace(id="t1", status="completed", spans=(), duration=None, meta=None, error=None, env="production", project=None, name="wf", start=START, path=None):
    http = ("GET", path, "http://h" + path, 200, None, {}, {}) if path else None
    return (id, name, status, env, project, start, None, duration, http, None, None, error, canonical(meta or {}), list(spans), None)


def frame(spark, *traces):
    return spark.createDataFrame(list(traces), TRACE)


def usage(**kw):
    return {"usage": kw}


def both(spark, *traces):
    """The row computed from nested documents and from span rows must be the same."""
    docs = frame(spark, *traces)
    nested = metrics.trace_rows(docs).orderBy("id").collect()
    flat = metrics.trace_rows(docs, spans.spans_of(docs)).orderBy("id").collect()
    assert nested == flat
    return nested


def test_tokens_calls_and_cost(spark):
    [row] = both(
        spark,
        trace(
            spans=[
                span(0, "node", "n"),
                span(1, "llm", "LLM: gpt-4o", meta=usage(prompt_tokens=1000, completion_tokens=500, total_tokens=1500)),
                span(2, "llm", "Chat: claude-3-5-haiku", meta=usage(prompt_tokens=10000, completion_tokens=2000, total_tokens=0)),
            ]
        ),
    )
    assert (row["total_tokens"], row["llm_calls"], row["estimated_cost"]) == (13500, 2, Decimal("0.0235"))
    assert row["model_counts"] == {"gpt-4o": 1, "claude-3-5-haiku": 1}
    assert row["node_counts"] == {"n": 1} and row["total_spans"] == 3


def test_stored_cost_is_kept_and_model_recorded(spark):
    [row] = both(
        spark,
        trace(spans=[span(0, "llm", "Chat: x", meta=usage(model="GPT_4o", prompt_tokens=1, completion_tokens=1, total_tokens=2, total_cost=0.5))]),
    )
    assert row["estimated_cost"] == Decimal("0.5") and row["model_counts"] == {"GPT_4o": 1}


def test_call_without_tokens(spark):
    [row] = both(spark, trace(spans=[span(0, "llm", "LLM: Some_Model", meta={})]))
    assert row["model_counts"] == {"Some_Model": 1} and row["estimated_cost"] == 0 and row["llm_calls"] == 1


def test_cached_tokens_from_details(spark):
    meta = usage(prompt_tokens=10000, completion_tokens=1000, total_tokens=11000, prompt_tokens_details={"cached_tokens": 8000})
    [row] = both(spark, trace(spans=[span(0, "llm", "LLM: gpt-6-astra", meta=meta)]))
    assert row["estimated_cost"] == Decimal("0.078")


@pytest.mark.parametrize(
    "inputs,loops",
    [([1, 2, 3], False), ([1, 2, 3, 4, 5], True), ([1, 1, 1], True), ([1, 1, 2, 2], True), ([1, 1], False), ([1, 1, 2], False)],
)
def test_tool_loops(spark, inputs, loops):
    tools = [span(i, "tool", "Tool: search ", inputs={"q": q, "a": 0}) for i, q in enumerate(inputs)]
    [row] = both(spark, trace(spans=tools))
    assert row["has_tool_loop"] is loops
    found = metrics.detect_tool_loops(spans.spans_of(frame(spark, trace(spans=tools)))).collect()
    assert [(r["tool_loop_tool"], r["tool_loop_count"]) for r in found] == ([("search", len(inputs))] if loops else [])


def test_equal_inputs_in_other_key_order_are_the_same(spark):
    tools = [span(i, "tool", "Tool: t", inputs=v) for i, v in enumerate([{"a": 1, "b": 2}, {"b": 2, "a": 1}, {"a": 1, "b": 2}])]
    assert both(spark, trace(spans=tools))[0]["has_tool_loop"]


def test_status_and_error(spark):
    rows = both(
        spark,
        trace("a", spans=[span(0, status="failed", trace="a")]),
        trace("b", "running", spans=[span(0, status="failed", trace="b")]),
        trace("c", error='{"type":"E"}'),
        trace("d", error="{}"),
        trace("e"),
    )
    assert [(r["status"], r["has_error"]) for r in rows] == [
        ("failed", True), ("running", True), ("completed", True), ("completed", False), ("completed", False)
    ]


def test_evals(spark):
    record = {"name": "e", "passed": True, "score": 1.0}
    rows = both(
        spark,
        trace("a", meta={"evals": [record, record]}, spans=[span(0, "eval", meta={"eval": record}, trace="a")]),
        trace("b", spans=[span(0, "eval", meta={"eval": {"name": "x", "passed": False}}, trace="b")]),
        trace("c", spans=[span(0, "eval", trace="c"), span(1, "eval", trace="c", status="failed")]),
        trace("d", meta={"evals": [{"name": "no verdict"}]}),
        trace("e", meta={"evals": [{"passed": None}]}),
        trace("f", meta={"evals": "none"}),
    )
    got = [(r["eval_count"], r["eval_status"]) for r in rows]
    assert got == [(2, "passed"), (1, "failed"), (2, "failed"), (1, "passed"), (1, "failed"), (0, None)]
    docs = frame(spark, trace("a", meta={"evals": [record, record]}, spans=[span(0, "eval", meta={"eval": record}, trace="a")]))
    assert [tuple(r) for r in evals.eval_rollup(docs, spans.spans_of(docs)).collect()] == [("a", 2, "passed")]


def test_append_evals(spark):
    docs = frame(spark, trace("a", meta={"k": 1, "evals": [{"name": "old"}]}), trace("b"))
    new = spark.createDataFrame(
        [("a", "x", 0.9, True, None, START), ("a", "y", 0.1, False, "bad", START + timedelta(seconds=1)), ("zz", "x", 1.0, True, None, START)],
        "trace_id string, name string, score double, passed boolean, reason string, timestamp timestamp",
    )
    t, eval_spans = evals.append_evals(docs, new)
    meta = {r["id"]: json.loads(r["metadata"]) for r in t.collect()}
    assert [e["name"] for e in meta["a"]["evals"]] == ["old", "x", "y"] and meta["a"]["k"] == 1 and meta["b"] == {}
    assert sorted((r["name"], r["status"]) for r in eval_spans.collect()) == [("Eval: x", "completed"), ("Eval: y", "failed")]


def test_span_cap(spark):
    docs = frame(spark, trace(spans=[span(i) for i in range(12)]))
    kept, report = spans.cap_spans(spans.spans_of(docs), 5)
    assert kept.count() == 5
    assert tuple(report.first()) == ("t1", 5, 7, True)


def rows_for(spark, n=12):
    return metrics.trace_rows(
        frame(spark, *[trace(f"t{i:02}", "failed" if i % 2 else "completed", duration=float(i + 1), start=START + timedelta(minutes=i)) for i in range(n)])
    )


def test_kpis(spark):
    row = analytics.kpi_stats(rows_for(spark)).first()
    assert (row["total_traces"], row["completed_traces"], row["failed_traces"]) == (12, 6, 6)
    assert row["success_rate"] == 50.0 and row["avg_duration_ms"] == 6.5


def test_p95_of_one_to_hundred(spark):
    docs = frame(spark, *[trace(f"t{i}", duration=float(i)) for i in range(1, 101)])
    assert analytics.kpi_p95(metrics.trace_rows(docs)).first()[0] == 95.0
    assert analytics.kpi_p95(metrics.trace_rows(docs).limit(0)).first()[0] == 0.0


def test_paging_past_the_end_keeps_the_total(spark):
    rows = rows_for(spark)
    for offset, expected in ((0, 5), (10, 2), (50, 0)):
        page, total = listing.list_traces(rows, 5, offset)
        assert (page.count(), total) == (expected, 12)
    assert [r["id"] for r in listing.list_traces(rows, 2)[0].collect()] == ["t11", "t10"]


def test_page_bounds():
    assert listing.page_bounds(10, 3, 4) == (10, 30)
    for bad in ((0, 0, None), (501, 0, None), (5, -1, None), (5, 0, 0)):
        with pytest.raises(ValueError):
            listing.page_bounds(*bad)


def test_search_is_literal(spark):
    docs = frame(spark, *[trace(str(i), name=n) for i, n in enumerate(["rate 50% ok", "rate 500", "my_custom_node", "myxcustomynode"])])
    rows = metrics.trace_rows(docs)
    assert [r["id"] for r in listing.filter_traces(rows, search="50%").collect()] == ["0"]
    assert [r["id"] for r in listing.filter_traces(rows, search="MY_CUSTOM").collect()] == ["2"]


def test_filters(spark):
    docs = frame(
        spark,
        trace("a", env="Prod", project="P", start=START),
        trace("b", env="dev", start=START + timedelta(days=1)),
        trace("c", env="", start=START + timedelta(days=2), path="/api/x"),
    )
    rows = metrics.trace_rows(docs)

    def ids(**kw):
        return sorted(r["id"] for r in listing.filter_traces(rows, **kw).collect())

    assert ids(environment="PROD") == ["a"] and ids(project="p") == ["a"] and ids(environment="production") == ["c"]
    assert ids(from_time="2026-01-02T12:00:00Z", to_time="2026-01-03T12:00:00+00:00") == ["b", "c"]
    assert ids(search="API") == ["c"] and ids(environment="", status=None) == ["a", "b", "c"]


def test_windows():
    as_of = datetime(2026, 1, 2)
    for token, buckets, width in (("15m", 15, 60), ("1h", 12, 300), ("24h", 24, 3600), ("7d", 14, 43200), ("30d", 30, 86400), ("6h", 24, 3600)):
        grid = analytics.resolve_window(token, as_of=as_of)
        assert (grid.buckets, grid.width) == (buckets, width)
    assert analytics.resolve_window("1h", start=as_of - timedelta(days=90), as_of=as_of).buckets == 90


def test_timeseries(spark):
    def call(model):
        return [span(0, "llm", f"Chat: {model}", meta=usage(prompt_tokens=10, completion_tokens=10, total_tokens=20))]

    docs = frame(
        spark,
        trace("a", spans=call("gpt-4o"), duration=100.0, start=START - timedelta(hours=2)),
        trace("b", "failed", spans=call("gpt-4o-mini"), duration=200.0, start=START - timedelta(hours=1)),
        trace("edge", start=START),
    )
    rows = metrics.trace_rows(docs)
    buckets = analytics.timeseries(rows, "24h", as_of=START).collect()
    assert len(buckets) == 24 and sum(b["trace_count"] for b in buckets) == 3 and sum(b["error_count"] for b in buckets) == 1
    assert buckets[22]["label"] == "10:00" and buckets[22]["p95_duration_ms"] == 100.0
    models = {(r["bucket"], r["model"]): r["calls"] for r in analytics.timeseries_models(rows, "24h", as_of=START).collect()}
    assert models == {(22, "gpt-4o"): 1, (23, "gpt-4o-mini"): 1}
    # The trace right at the end belongs to the last bucket.
    assert analytics.timeseries_total(rows, analytics.resolve_window("24h", as_of=START)) == 3


def test_node_analytics(spark):
    docs = frame(
        spark,
        trace("a", spans=[span(0, "node", "retrieve", duration=100.0, trace="a"), span(1, "node", "generate", duration=400.0, trace="a")]),
        trace("b", spans=[span(0, "node", "retrieve", "failed", 200.0, trace="b")]),
    )
    first, second = analytics.node_analytics(metrics.trace_rows(docs)).collect()
    assert (first["node_name"], first["frequency_pct"], first["error_rate"], first["avg_duration_ms"]) == ("retrieve", 100.0, 50.0, 150.0)
    assert (second["node_name"], second["frequency_pct"], second["p95_duration_ms"]) == ("generate", 50.0, 400.0)
    assert analytics.node_analytics(metrics.trace_rows(docs).limit(0)).count() == 0


def test_dashboard(spark):
    board = dashboard(rows_for(spark), limit=5, page=2, status="failed")
    assert board.total_count == 6 and not board.has_more and board.page.count() == 1
    assert board.stats.first()["total_traces"] == 12
    assert dashboard(rows_for(spark), limit=5).has_more


def test_buckets_and_total_add_up(spark):
    rows = rows_for(spark)
    inside = sum(b["trace_count"] for b in analytics.timeseries(rows, "15m", as_of=START + timedelta(minutes=10)).collect())
    total = analytics.timeseries_total(rows, analytics.resolve_window("15m", as_of=START + timedelta(minutes=10)))
    assert total == inside == 11


def test_same_result_for_any_partitioning(spark):
    docs = frame(spark, *[trace(f"t{i}", spans=[span(j, "node", f"n{j % 3}", trace=f"t{i}") for j in range(7)]) for i in range(9)])
    flat = spans.spans_of(docs)
    one = metrics.trace_rows(docs, flat.coalesce(1)).orderBy("id").collect()
    many = metrics.trace_rows(docs.repartition(5), flat.repartition(7, "id")).orderBy("id").collect()
    assert one == many


def test_order_statistic_of_many_groups(spark):
    from pyspark.sql import functions as F

    from tracelake.operators import order_stats

    rows = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 11)).alias("k"),
        ((F.col("id") * 7919 % 1009 - 300) / 7).cast("decimal(18,2)").alias("v"),
    )
    expected = {}
    for row in rows.collect():
        expected.setdefault(row["k"], []).append(row["v"])
    expected = {k: sorted(v)[95 * (len(v) - 1) // 100] for k, v in expected.items()}
    got = order_stats.order_statistic(rows, ["k"], "v", order_stats.floor_rank, "p")
    assert {r["k"]: r["p"] for r in got.collect()} == expected


def test_deep_pages_and_cursors(spark, monkeypatch):
    from datetime import timedelta

    from tracelake.operators import listing

    times = [None, *[START + timedelta(days=400 * (i % 3), seconds=(i * 37) % 90) for i in range(400)]]
    rows = spark.createDataFrame([(f"t{i}", t) for i, t in enumerate(times)], "id string, start_time timestamp")
    order = [r["id"] for r in listing.newest_first(rows).collect()]
    monkeypatch.setattr(listing, "SHALLOW", 5)
    for offset in (0, 5, 6, 100, 133, 134, 260, 391, 399, 400, 401, 900):
        assert [r["id"] for r in listing.newest_page(rows, 10, offset).collect()] == order[offset : offset + 10]
    monkeypatch.setattr(listing, "trace_summaries", lambda page: page)
    seen, after = [], None
    while len(seen) < 395:
        page, after = listing.page_after(rows, after, 50)
        seen += [r["id"] for r in listing.newest_first(page).collect()]
        if after is None:
            break
    assert seen == order[: len(seen)] and len(seen) >= 399


def test_large_traces_are_aggregated_to_the_same_row(spark, monkeypatch):
    from tracelake.sources import driver_tables

    sf = "/root/testdata/sf0.001"
    traces, flat = driver_tables.traces(spark, sf), driver_tables.spans(spark, sf)
    evals = F.when((F.col("span_type") == "eval") & (F.col("pos") % 2 == 1), F.lit('{"name":"n","passed":true}'))
    flat = flat.withColumn("eval", evals)
    shown = lambda rows: sorted(repr(tuple(sorted(v.items()) if isinstance(v, dict) else v for v in r)) for r in rows.collect())
    whole = shown(metrics.trace_rows(traces, flat))
    monkeypatch.setattr(metrics, "LARGE", 3)
    assert shown(metrics.trace_rows(traces, flat)) == whole


def test_parse_iso_query_keeps_microseconds(spark, tmp_path):
    rows = [(k, datetime(2024, 1, 2, 3, 4, 5, 678901)) for k in range(4)]
    spark.createDataFrame(rows, "event_id long, ts timestamp").write.parquet(f"{tmp_path}/events.parquet")
    got = {r.event_id: r["at"] for r in registry.QUERIES["parse_iso"](spark, str(tmp_path)).collect()}
    assert got == {0: "2024-01-02 03:04:05.678901", 1: "2024-01-02 03:04:05.678901", 2: "2024-01-02 03:04:05.678901", 3: None}


def test_lean_rows_carry_only_what_the_row_takes_of_a_call(spark):
    span = "'t' as trace_id, 0 as pos, 's' as id, 'llm' as span_type, 'LLM: gpt-4o' as name, 'completed' as status, 1d as duration_ms, '' as inputs, "
    lean = metrics._lean(spark.range(1).selectExpr(*(span + f"cast(null as {USAGE}) as usage").split(", ", 8)[:8], f"cast(null as {USAGE}) as usage", "'' as model", "cast(null as string) as eval"), None)
    assert lean.select("call.*").columns == ["model", "total_tokens", "total_cost"]


def test_eval_rollup_groups_records_once(spark):
    """Records on spans and in metadata meet by one grouping, not by a join of spans that are made twice."""
    listed = '{"evals":[{"name":"q","passed":true},{"passed":true,"name":"q"},null]}'
    docs = spark.createDataFrame([("a", listed), ("b", "{}"), ("c", "{}"), ("d", '{"evals":[null]}'), ("e", None)], "id string, metadata string")
    held = [
        ("a", "eval", '{"passed":true,"name":"q"}', "failed"), ("a", "eval", '{"name":"z","passed":false}', "completed"),
        ("a", "eval", '{"passed":false,"name":"z"}', "completed"), ("a", "tool", '{"name":"y"}', "failed"),
        ("b", "eval", None, "completed"), ("b", "eval", "", "failed"), ("c", "eval", None, None), (None, "eval", None, "failed"),
    ]
    got = evals.eval_rollup(docs, spark.createDataFrame(held, "trace_id string, span_type string, eval string, status string"))
    assert sorted(map(tuple, got.collect())) == [("a", 4, "failed"), ("b", 2, "failed"), ("c", 1, None), ("d", 1, "passed"), ("e", 0, None)]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1
