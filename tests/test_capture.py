import json
from collections import Counter, deque
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tracelake.functions.models import resolve_model_name
from tracelake.operators import analytics, capture, listing, rate
from tracelake.schema import EVENT
from tracelake.sources import versions
from tracelake.streaming import live, series, throttle

START = datetime(2026, 1, 1)


def event(seq, run, phase="start", kind="chain", parent=None, name=None, serialized=None, metadata=None, params=None, inputs=None, outputs=None, llm_output=None, error=None, trace="t"):
    def text(value):
        return None if value is None else json.dumps(value)

    return (
        seq, START + timedelta(seconds=seq), trace, run, parent, kind, phase, name, text(serialized), None, text(metadata), text(params),
        text(inputs), text(outputs), text(llm_output), *(error or (None, None, None)),
    )


def events(spark, *rows):
    return spark.createDataFrame(list(rows), EVENT)


NODE_TAG = capture.NODE_KEY


def invoice_run(spark):
    """A mail is sorted by a model, then booked by a tool inside a second step; one end has no start."""
    answer = {"generations": [{"text": "invoice", "message": {"usage_metadata": {"input_tokens": 210, "output_tokens": 8, "total_tokens": 218}}}]}
    return events(
        spark,
        event(0, "flow", serialized={"name": "Mailroom"}, inputs={"mail": "please pay"}),
        event(2, "sort", parent="flow", metadata={NODE_TAG: "sort_mail"}, inputs={"mail": "please pay"}),
        event(3, "ask", kind="chat", parent="sort", params={"model": "gpt-4o"}, inputs=[{"type": "human", "content": "what is it"}]),
        event(6, "ask", "end", "chat", outputs=answer),
        event(7, "sort", "end", outputs={"class": "invoice"}),
        event(8, "book", parent="flow", metadata={NODE_TAG: "book_it"}, inputs={"class": "invoice"}),
        event(9, "ledger", kind="tool", parent="book", serialized={"name": "ledger"}, inputs="add 12"),
        event(11, "ledger", "end", "tool", outputs="row 5"),
        event(12, "book", "end", outputs={"row": 5, "class": "invoice"}),
        event(13, "nobody", "end", outputs={}),
        event(15, "flow", "end", outputs={"booked": True}),
    )


def test_spans_of_a_run(spark):
    got = {r["id"]: r for r in capture.assemble_spans(invoice_run(spark)).collect()}
    shape = {i: (r["name"], r["span_type"], r["parent_id"], r["pos"]) for i, r in got.items()}
    assert shape == {
        "flow": ("Mailroom", "workflow", None, 0), "sort": ("sort_mail", "node", "flow", 1), "ask": ("Chat: gpt-4o", "llm", "sort", 2),
        "book": ("book_it", "node", "flow", 3), "ledger": ("Tool: ledger", "tool", "book", 4),
    }
    assert got["ask"]["usage"]["total_tokens"] == 218 and got["ask"]["total_cost"] > 0
    assert [json.loads(got["ledger"][c]) for c in ("inputs", "outputs")] == [{"input": "add 12"}, {"output": "row 5"}]
    assert got["flow"]["duration_ms"] == 15000.0 and {r["status"] for r in got.values()} == {"completed"}


def test_state_updates(spark):
    kept, _ = capture.node_state_updates(invoice_run(spark))
    assert [(r["node"], json.loads(r["update"])) for r in kept.orderBy("n").collect()] == [("sort_mail", {"class": "invoice"}), ("book_it", {"row": 5, "class": "invoice"})]
    many = [event(i, f"r{i}", metadata={NODE_TAG: "n"}) for i in range(9)] + [event(40 + i, f"r{i}", "end", outputs={"k": i * i}) for i in range(9)]
    kept, report = capture.node_state_updates(events(spark, *many), 4)
    assert [json.loads(r["update"])["k"] for r in kept.orderBy("n").collect()] == [0, 1, 4, 9]
    assert report.first()["truncated"]


def test_trace_io(spark):
    row = capture.trace_io(capture.assemble_spans(invoice_run(spark))).first()
    assert json.loads(row["input"]) == {"mail": "please pay"} and json.loads(row["output"]) == {"booked": True} and row["error"] is None


def test_rows_of_events(spark):
    life = [("t", 0, START, "start", "mail run", None, None, None), ("t", 1, START + timedelta(seconds=16), "finish", None, "completed", None, None)]
    life = spark.createDataFrame(life, "trace_id string, seq bigint, ts timestamp, phase string, name string, status string, output string, error string")
    spans = capture.assemble_spans(invoice_run(spark))
    whole = capture.traces_of_events(life, invoice_run(spark), spans).first()
    told = json.loads(whole["metadata"])["node_state_updates"]
    assert [(u["node"], u["update"]) for u in told] == [("sort_mail", {"class": "invoice"}), ("book_it", {"row": 5, "class": "invoice"})]
    assert json.loads(whole["output"]) == {"booked": True}
    row = capture.rows_of_events(life, invoice_run(spark)).first()
    assert (row["total_spans"], row["llm_calls"], row["total_tokens"], row["status"]) == (5, 1, 218, "completed") and row["estimated_cost"] > 0


def test_inner_executions_alternate(spark):
    tag = {NODE_TAG: "n"}
    runs = [event(0, "root", name="flow"), event(1, "r1", parent="root", metadata=tag)]
    runs += [event(i, f"r{i}", parent=f"r{i - 1}", metadata=tag) for i in range(2, 8)]
    runs += [event(20, "p", parent="root", name="n"), event(21, "q", parent="p", metadata=tag), event(22, "q2", parent="q", metadata=tag), event(30, "other", parent="gone", name="z")]
    got = {r["run_id"]: (r["span_type"], r["span_name"]) for r in capture.classify_runs(events(spark, *runs)).collect()}
    for i in range(1, 8):
        assert got[f"r{i}"] == (("node", "n") if i % 2 else ("custom", "n:exec"))
    assert got["root"] == ("workflow", "flow") and got["p"] == ("custom", "n")
    assert got["q"] == ("custom", "n:exec") and got["q2"] == ("node", "n") and got["other"] == ("workflow", "z")


def test_default_names(spark):
    got = {
        r["run_id"]: r["span_name"]
        for r in capture._classified(
            events(spark, event(0, "a"), event(1, "b", serialized={"id": 1}), event(2, "c", kind="llm"), event(3, "d", kind="chat"), event(4, "e", kind="tool"), event(5, "f", kind="llm", serialized={"name": "ser"}))
        ).collect()
    }
    assert got == {"a": "chain", "b": "workflow", "c": "LLM: llm", "d": "Chat: chat_model", "e": "Tool: tool", "f": "LLM: ser"}


def test_errors(spark):
    boom = ("ValueError", "boom", "trace")
    log = events(
        spark, event(0, "a", inputs={}), event(1, "b", kind="llm", parent="a"), event(2, "c", kind="tool", parent="a"),
        event(3, "b", "error", "llm", error=boom), event(4, "c", "error", "tool", error=boom), event(5, "a", "error", error=boom), event(6, "d", kind="custom", name="mine"),
    )
    got = {r["id"]: r for r in capture.assemble_spans(log).collect()}
    assert [got[i]["status"] for i in "abcd"] == ["failed", "failed", "failed", "running"]
    assert json.loads(got["a"]["error"]) == {"type": "ValueError", "message": "boom", "traceback": "trace"}
    assert capture.error_records(log).count() == 3
    assert json.loads(capture.trace_io(capture.assemble_spans(log)).first()["error"])["message"] == "boom"


def test_usage_shapes(spark):
    cases = [
        ({"token_usage": {"total_tokens": 9, "prompt_tokens": 4, "completion_tokens": 5}}, None, (9, 4, 5)),
        ({"usage": {"input_tokens": 4, "output_tokens": 5}}, None, (0, 4, 5)),
        ({"token_usage": "none", "usage": {"prompt_tokens": 1}}, None, (0, 1, 0)),
        ({}, [{"message": {"response_metadata": {"usage": {"input_tokens": 2, "completion_tokens": 3}}}}], (5, 2, 3)),
        (None, [{}, {"message": {"usage_metadata": {"input_tokens": 1, "output_tokens": 1}, "response_metadata": {"token_usage": {"prompt_tokens": 9}}}}], (2, 1, 1)),
        (None, [{"text": "x"}], None),
    ]
    rows = [(i, json.dumps(o) if o is not None else None, json.dumps({"generations": g}) if g else None) for i, (o, g, _) in enumerate(cases)]
    frame = spark.createDataFrame(rows, "i int, o string, g string").selectExpr("i", f"{capture.normalize_usage('o', 'g')} as u")
    got = {r["i"]: r["u"] and tuple(r["u"]) for r in frame.collect()}
    assert got == {i: want for i, (_, _, want) in enumerate(cases)}


def test_model_precedence(spark):
    sources = ['{"model_name":"out"}', '{"model":"par"}', '{"ls_model_name":"met"}', '{"name":"ser"}']
    for n in range(5):
        args = [f"'{s}'" if i >= n else "cast(null as string)" for i, s in enumerate(sources)]
        got = spark.range(1).selectExpr(resolve_model_name(*args, "'def'")).first()[0]
        assert got == ["out", "par", "met", "ser", "def"][n]


def test_second_finish_changes_outcome_only(spark):
    def e(seq, phase, status=None, output=None, error=None, name=None):
        return ("t", seq, START + timedelta(seconds=seq), phase, name, status, output, error)

    schema = "trace_id string, seq long, ts timestamp, phase string, name string, status string, output string, error string"
    log = spark.createDataFrame([e(0, "start", name="wf"), e(2, "finish", "completed", "1"), e(9, "finish", "failed", None, "E"), e(11, "finish", "running", "2")], schema)
    row = capture.assemble_traces(log).first()
    assert (row["status"], row["duration_ms"], row["output"], row["error"]) == ("failed", 2000.0, "2", "E")
    running = capture.assemble_traces(log.filter("seq = 0")).first()
    assert (running["status"], running["end_time"], running["duration_ms"]) == ("running", None, None)


def test_merge_metadata(spark):
    traces = spark.createDataFrame([("a", '{"x":1,"keep":[1]}'), ("b", "{}")], "id string, metadata string")
    updates = spark.createDataFrame([("a", 1, '{"x":2,"y":"q\\"uote"}'), ("a", 2, '{"y":{"z":null}}')], "trace_id string, seq int, update string")
    got = {r["id"]: json.loads(r["metadata"]) for r in capture.merge_metadata(traces, updates).collect()}
    assert got == {"a": {"x": 2, "y": {"z": None}, "keep": [1]}, "b": {}}


def test_messages(spark):
    schema = "m array<array<struct<type:string,content:string,name:string,tool_calls:string,additional_kwargs:string,response_metadata:string>>>"
    frame = spark.createDataFrame([([[("human", "hi", "", "[]", "{}", None)], [("ai", "yo", "bot", '[{"n":1}]', "{}", None)]],)], schema)
    got = frame.select(capture.flatten_messages(F.col("m"))).first()[0]
    assert [tuple(m) for m in got] == [("human", "hi", None, None, None, None), ("ai", "yo", "bot", '[{"n":1}]', None, None)]


def test_headers_paths_sampling_tags(spark):
    schema = "id string, name string, environment string, project string, http struct<method:string,path:string,headers:map<string,string>>"
    t = spark.createDataFrame([("a", None, None, "", ("GET", "/docs/x", {"Cookie": "c", "Accept": "*"})), ("b", "n", "dev", "p", None)], schema)
    assert [r["http"] and r["http"]["headers"] for r in listing.scrub_headers(t).orderBy("id").collect()] == [{"Accept": "*"}, None]
    assert [r["id"] for r in listing.exclude_paths(t).collect()] == ["b"]
    many = spark.range(4000).selectExpr("cast(id as string) as id")
    assert listing.sample_traces(many, 1.0).count() == 4000 and listing.sample_traces(many, 0.0).count() == 0
    assert 800 < listing.sample_traces(many, 0.25, 3).count() < 1200
    tagged = {r["id"]: (r["name"], r["environment"], r["project"]) for r in listing.tag_traces(t).collect()}
    assert tagged == {"a": ("GET /docs/x", "production", None), "b": ("n", "dev", "p")}
    forced = listing.tag_traces(t, "qa", "x", "run").filter("id = 'b'").first()
    assert (forced["name"], forced["environment"], forced["project"]) == ("run", "qa", "x")


def verdicts(requests, limit):
    """Brute force, one request after another."""
    history, out = {}, {}
    for rid, client, t in sorted(requests, key=lambda r: (r[2], r[0])):
        recent = history.setdefault(client, deque())
        while recent and recent[0] <= t - timedelta(seconds=60):
            recent.popleft()
        out[rid] = len(recent) >= limit
        if not out[rid]:
            recent.append(t)
    return out


def sample_requests():
    rows = []
    for i in range(600):
        client = "hot" if i % 3 else f"c{i % 7}"
        rows.append((f"{i:04}", client, START + timedelta(seconds=(i * 37) % 1500, milliseconds=500 * (i % 2))))
    return rows + [(f"z{i}", "burst", START + timedelta(seconds=60 * i)) for i in range(6)]


def test_rate_violations_match_brute_force(spark):
    rows = sample_requests()
    frame = spark.createDataFrame(rows, "request_id string, client string, ts timestamp")
    for limit in (1, 2, 5, 12):
        got = {r["request_id"]: r["rejected"] for r in rate.rate_violations(frame, limit).collect()}
        assert got == verdicts(rows, limit)
    assert not any(r["rejected"] for r in rate.rate_violations(frame, 0).collect())


def test_live_rate_over_batches(spark, tmp_path):
    rows = sorted(sample_requests(), key=lambda r: (r[2], r[0]))
    late = [r for i, r in enumerate(rows) if i % 11 == 5]  # come last, in the midst of what was judged
    inbox, schema = str(tmp_path / "in"), "request_id string, client string, ts timestamp"
    for part in ([r for r in rows[:300] if r not in late], [r for r in rows[300:] if r not in late], late):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(inbox)
        stream = spark.readStream.schema(schema).parquet(inbox)
        throttle.live_rate(stream, 2, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = {r["request_id"]: r["rejected"] for r in throttle.live_verdicts(spark, str(tmp_path / "out")).collect()}
    assert got == verdicts(rows, 2)
    since = START + timedelta(seconds=700)
    some = {r["request_id"]: r["rejected"] for r in throttle.live_verdicts(spark, str(tmp_path / "out"), since).collect()}
    assert some == {i: got[i] for i, _, t in rows if t >= since}


def test_one_endless_client_is_spread_and_folded_by_instants(spark):
    """Forty requests a second for hours: instants are folded, and the requests' verdicts lie in many tasks."""
    hot = spark.range(200_000).selectExpr("lpad(id, 7, '0') as request_id", "'hot' as client", "timestamp_micros(1767225600000000 + id div 10 * 250000) as ts")
    judged = rate.rate_violations(hot, 25).select("*", F.spark_partition_id().alias("task"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    got = judged.groupBy("task").agg(F.count("*").alias("n"), F.count_if(~F.col("rejected")).alias("accepted")).collect()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    # 25 at the start of every minute: the first three instants, then nothing until they expire
    assert sum(r["accepted"] for r in got) == 25 * -(-200_000 // 2400) and len([r for r in got if r["n"] > 1000]) > 1


def test_stretches_end_where_nothing_counts(spark):
    at = lambda s: START + timedelta(seconds=s)
    rows = [(f"{k}-{i}", "c", at(60 * k + (0 if k % 2 else 59) + 0.01 * i)) for k in range(8) for i in range(4)]
    frame = spark.createDataFrame(rows, "request_id string, client string, ts timestamp")
    assert rate.busy_minutes(frame, 3).select("episode").distinct().count() == 4
    assert {r["request_id"]: r["rejected"] for r in rate.rate_violations(frame, 3).collect()} == verdicts(rows, 3)

def test_rate_screen_counts_late_requests(spark, tmp_path):
    inbox, out, schema = str(tmp_path / "in"), str(tmp_path / "out"), "client string, ts timestamp"
    at = lambda *seconds: [START + timedelta(seconds=s) for s in seconds]
    days = 5 * 86400
    # the newest first; then a busy minute days behind it, part of which has come before
    files = [[("a", t) for t in at(days, days + 9, 3)], [("b", t) for t in at(days + 1)], [("a", t) for t in at(1, 12, 12, 59)] + [("b", t) for t in at(0, 70)]]
    for part in files:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(inbox)
        live.rate_screen(spark.readStream.schema(schema).parquet(inbox), out, str(tmp_path / "cp")).awaitTermination()
    seen = Counter((c, int(t.timestamp()) // 10 * 10 - 10 * k) for part in files for c, t in part for k in range(6))
    got = {(r.client, int(r.minute_start.timestamp())): r.requests for r in live.screened(spark.read.parquet(out), 2).collect()}
    assert got == {k: n for k, n in seen.items() if n > 2} and max(got.values()) == 5


def test_client_key(spark):
    frame = spark.createDataFrame([(" 1.2.3.4 , 5.6.7.8", "p"), (None, "p"), (None, None)], "f string, p string")
    assert [r[0] for r in frame.select(rate.client_of(F.col("f"), F.col("p"))).collect()] == ["1.2.3.4", "p", "unknown"]


def test_live_figures_do_not_depend_on_batches(spark, tmp_path):
    rows = [(START + timedelta(minutes=7 * i), float(i * i % 97) if i % 5 else None, i % 4 == 0, {"m": i % 3} if i % 2 else None) for i in range(60)]
    schema = "start_time timestamp, duration_ms double, has_error boolean, model_counts map<string,bigint>"
    results = []
    for name, files in (("one", 1), ("many", 11)):
        inbox, out = str(tmp_path / f"in-{name}"), str(tmp_path / f"out-{name}")
        for i in range(files):
            spark.createDataFrame(rows[i::files], schema).coalesce(1).write.mode("append").parquet(inbox)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(inbox)
        series.live_series(stream, out, str(tmp_path / f"cp-{name}")).awaitTermination()
        results.append(sorted(map(tuple, series.tumbling(series.stored_figures(spark, out)).collect())))
        span = {"start": START, "end": START + timedelta(hours=7), "as_of": START}
        flat = spark.createDataFrame(rows, schema).withColumns({"status": F.lit("completed"), "estimated_cost": F.lit(None).cast("decimal(18,6)"), "total_tokens": F.lit(None).cast("bigint"), "environment": F.lit("e"), "project": F.lit("p")})
        assert series.series(spark, out, **span).collect() == analytics.timeseries(flat, **span).collect()
        calls = analytics.timeseries_models(flat, **span).filter("calls <> 0")
        assert series.series_models(spark, out, **span).collect() == calls.collect()
    assert results[0] == results[1] and sum(r[1] for r in results[0]) == 60
    assert len(list((tmp_path / "out-many" / "figures").iterdir())) == 2 and len(list((tmp_path / "out-many" / "figures" / "level=0").iterdir())) <= 2 * versions.FAN


def _reads(df):
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return sum("LogicalRDD" in line and "traceback" in line for line in plan.splitlines())


def test_events_are_read_once_when_spans_are_placed(spark):
    log = invoice_run(spark).localCheckpoint()
    assert _reads(capture.assemble_spans(log)) == 1
    assert capture.assemble_spans(log).select("trace_id", "id", "pos").distinct().count() == capture.assemble_spans(log).count()


def test_rows_read_stored_spans(spark):
    log = invoice_run(spark).localCheckpoint()
    told = log.selectExpr("trace_id", "seq", "ts", "phase", "name", "outputs as status", "outputs as output", "outputs as error").filter("seq = 0").localCheckpoint()
    assert _reads(capture.rows_of_events(told, log)) == 1  # for the state updates
