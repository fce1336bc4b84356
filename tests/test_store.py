import json
import re
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tests.test_metrics import START, frame, span, trace
from tracelake.operators import metrics, spans
from tracelake.operators.ranking import row_numbers
from tracelake.plans import registry
from tracelake.schema import ROW
from tracelake.sources import store, versions
from tracelake.sources import traces as src
from tracelake.streaming import live


def write_lines(folder, *lines):
    folder.mkdir(exist_ok=True)
    target = folder / f"part-{len(list(folder.iterdir()))}.json"
    target.write_text("\n".join(line if isinstance(line, str) else json.dumps(line) for line in lines))
    return str(folder)


def doc(id="a", **kw):
    return {"id": id, "name": "wf", "start_time": "2026-01-01T12:00:00Z", **kw}


def test_read_check_and_complete(spark, tmp_path):
    good = doc("good", metadata={"b": 1, "a": {"y": 1, "x": 2}}, input="text", spans=[{"id": "s", "trace_id": "good", "name": "n"}])
    path = write_lines(
        tmp_path / "in", good, doc("plain"), "{broken", {"name": "no id"}, {"id": "x"}, doc("bad", status="odd"),
        doc("span", spans=[{"id": "s", "name": "n"}]), doc("kind", spans=[{"id": "s", "trace_id": "k", "name": "n", "span_type": "robot"}]),
        doc("http", http={"method": "GET"}),
    )
    valid, rejected = src.split_valid(src.read_traces(spark, path))
    reasons = sorted(r["reject_reason"] for r in rejected.collect())
    assert reasons == ["incomplete http", "invalid span", "invalid span", "no id", "no name", "not JSON", "unknown status"]
    rows = {r["id"]: r for r in src.apply_defaults(valid, START).collect()}
    assert set(rows) == {"good", "plain"}
    first = rows["good"]
    assert (first["status"], first["environment"], first["start_time"]) == ("running", "production", datetime(2026, 1, 1, 12))
    assert first["metadata"] == '{"a":{"x":2,"y":1},"b":1}' and first["input"] == '"text"'
    inner = first["spans"][0]
    assert (inner["span_type"], inner["status"], inner["start_time"], inner["metadata"]) == ("custom", "running", START, "{}")
    assert rows["plain"]["spans"] == [] and rows["plain"]["metadata"] == "{}"


def test_json_lists(spark, tmp_path):
    path = write_lines(tmp_path / "list", json.dumps([doc("a"), doc("b")], indent=1))
    assert src.read_traces(spark, path, multi_line=True).count() == 2


def test_export_and_back(spark, tmp_path):
    docs = frame(spark, trace("a", meta={"k": [1, "x"]}, spans=[span(0, "tool", inputs={"q": 1}, trace="a")]), trace("b"))
    out = str(tmp_path / "out")
    src.export_traces(docs, ["a", "missing"], out)
    valid, rejected = src.split_valid(src.read_traces(spark, out))
    assert rejected.count() == 0
    assert src.apply_defaults(valid).collect() == docs.filter("id = 'a'").collect()
    stored = spark.read.text(out).withColumnRenamed("value", "data_json")
    assert src.from_stored_rows(stored).collect() == docs.filter("id = 'a'").collect()


def test_lookup_and_erase(spark):
    docs = frame(spark, trace("a"), trace("b"), trace("c"))
    assert [r["id"] for r in src.get_traces(docs, ["b", "zz"]).collect()] == ["b"]
    rest, report = store.erase_traces(docs, ["a", "c", "zz"])
    assert [r["id"] for r in rest.collect()] == ["b"] and report.first()[0] == 2
    assert store.clear(docs).count() == 0 and store.clear(docs).schema == docs.schema


def test_upsert_is_idempotent_and_last_wins(spark):
    old = spark.createDataFrame([("a", 1, "running"), ("b", 2, "running")], "id string, ingest_seq int, status string")
    new = spark.createDataFrame([("a", 3, "completed"), ("a", 4, "failed"), ("c", 5, "running")], old.schema)
    once = store.upsert_traces(old, new)
    assert sorted(tuple(r) for r in once.collect()) == [("a", 4, "failed"), ("b", 2, "running"), ("c", 5, "running")]
    assert sorted(store.upsert_traces(once, new).collect()) == sorted(once.collect())


def test_retention(spark):
    writes = spark.createDataFrame([(f"t{i}", i, "old") for i in range(10)] + [("t2", 50, "new"), ("t8", 60, "new")], "id string, ingest_seq int, v string")
    kept = store.retain_newest(writes, 3).collect()
    assert sorted(tuple(r) for r in kept) == [("t7", 7, "old"), ("t8", 60, "new"), ("t9", 9, "old")]
    assert store.retain_newest(writes, 0).count() == 0 and store.retain_newest(writes, 100).count() == 10


def test_stored_table(spark, tmp_path):
    path = str(tmp_path / "table")
    rows = metrics.trace_rows(frame(spark, trace("a"), trace("b", start=START + timedelta(days=1)), trace("c")))
    store.upsert_into(path, rows)
    moved = rows.filter("id = 'b'").withColumn("start_time", F.lit(START + timedelta(days=40))).withColumn("status", F.lit("failed"))
    for _ in range(2):  # the same change twice
        store.upsert_into(path, moved)
        table = {r["id"]: r for r in store.read_trace_rows(spark, path).collect()}
        assert set(table) == {"a", "b", "c"} and str(table["b"]["start_date"]) == "2026-02-10" and table["b"]["status"] == "failed"
    assert store.erase_from(spark, path, spark.createDataFrame([("b",), ("x",)], "id string")) == 1
    assert sorted(r["id"] for r in store.read_trace_rows(spark, path).collect()) == ["a", "c"]


def test_odd_environment_names(spark, tmp_path):
    path = str(tmp_path / "odd")
    rows = metrics.trace_rows(frame(spark, trace("a", env="007"), trace("b", env="eu/west=1"), trace("c", env="007")))
    store.upsert_into(path, rows)
    assert {r["id"]: r["environment"] for r in store.read_trace_rows(spark, path).collect()} == {"a": "007", "b": "eu/west=1", "c": "007"}
    store.upsert_into(path, rows.filter("id = 'b'").withColumn("environment", F.lit("qa")))
    assert store.erase_from(spark, path, spark.createDataFrame([("c",)], "id string")) == 1
    assert {r["id"]: r["environment"] for r in store.read_trace_rows(spark, path).collect()} == {"a": "007", "b": "qa"}


def test_rank_among_many_values_is_refined(spark, monkeypatch):
    from tracelake.operators import order_stats

    writes = spark.range(20_000).selectExpr("concat('t', id) as id", "1000000000000 + id * 7919 % 20011 * 1000 as ingest_seq")
    want = sorted(r["ingest_seq"] for r in writes.collect())[-123:]
    for few, parts in ((10, 16), (100, 4096), (100_000, 4096)):
        monkeypatch.setattr(order_stats, "FEW", few)
        monkeypatch.setattr(order_stats, "PARTS", parts)
        assert sorted(r["ingest_seq"] for r in store.retain_newest(writes, 123).collect()) == want
        same = writes.withColumn("ingest_seq", F.lit(7))
        assert store.retain_newest(same, 5).count() == 20_000


def ids_of(spark, path):
    return sorted(r["id"] for r in store.read_trace_rows(spark, path).collect())


def test_versions_of_a_table(spark, tmp_path):
    path = str(tmp_path / "table")
    rows = metrics.trace_rows(frame(spark, *[trace(f"t{i}", start=START + timedelta(days=i)) for i in range(6)]))
    store.write_trace_rows(rows, path)
    before = store.read_trace_rows(spark, path)
    store.upsert_into(path, rows.filter("id = 't1'").withColumn("start_time", F.lit(START + timedelta(days=4))))
    # a reader of the version before still sees it whole; the new one has the trace once
    assert sorted(r["id"] for r in before.collect()) == ids_of(spark, path) == [f"t{i}" for i in range(6)]
    # a lost job leaves folders that nobody names
    (tmp_path / "table" / "rows" / "v=9-lost" / "start_date=2026-01-01" / "environment=x").mkdir(parents=True)
    assert ids_of(spark, path) == [f"t{i}" for i in range(6)]
    # rows of partitions that are written anew are gone, and known to be
    store.write_trace_rows(rows.filter("id = 't4'"), path)
    assert ids_of(spark, path) == ["t0", "t2", "t3", "t4", "t5"]
    assert store.erase_from(spark, path, spark.createDataFrame([("t1",), ("t5",)], "id string")) == 1
    try:
        store.upsert_into(path, rows.unionByName(rows))
        raise AssertionError
    except ValueError:
        assert ids_of(spark, path) == ["t0", "t2", "t3", "t4"]
    with_lost = versions.current(spark, path)
    try:
        versions.commit(spark, path, {**with_lost}, [])
        raise AssertionError
    except RuntimeError:
        assert versions.current(spark, path) == with_lost
    store.clear_table(spark, path)
    assert ids_of(spark, path) == []


def test_changes_read_their_partitions_and_buckets_only(spark, tmp_path):
    path = str(tmp_path / "table")
    rows = metrics.trace_rows(frame(spark, *[trace(f"t{i}", start=START + timedelta(days=i)) for i in range(9)]))
    store.write_trace_rows(rows, path)
    old = {folder: name for name, folder in versions.current(spark, path)["rows"]}
    store.upsert_into(path, rows.filter("id = 't3'").withColumn("name", F.lit("new")))
    now = {folder: name for name, folder in versions.current(spark, path)["rows"]}
    assert [f for f in now if now[f] != old[f]] == ["start_date=2026-01-04/environment=production"]
    named = spark.createDataFrame([("t3",)], "id string")
    places = store._places(spark, path, versions.current(spark, path), named)
    assert re.search(r"PartitionFilters: \[[^\]]*bucket#", places._jdf.queryExecution().toString())
    assert [str(r.start_date) for r in places.collect()] == ["2026-01-04"]


def test_many_changes_leave_few_segments(spark, tmp_path):
    path = str(tmp_path / "table")
    docs = frame(spark, *[trace(f"t{i}") for i in range(4)])
    text = src.document_text(docs.columns)
    for k in range(2 * versions.FAN + 3):
        now = metrics.trace_rows(docs.withColumns({"name": F.lit(f"n{k}"), "value": text}).filter(F.col("id") != f"t{k % 4}"), keep=["value"])
        store.upsert_into(path, now.withColumn("value", F.lit(f"doc {k}")), buckets=2)
        if k == 5:
            assert store.erase_from(spark, path, spark.createDataFrame([("t3",)], "id string")) == 1
    version = versions.current(spark, path)
    assert len(version["ids"]) <= versions.FAN + 2 and len(version["documents"]) <= versions.FAN + 2
    last = 2 * versions.FAN + 2
    want = {f"t{i}": f"doc {max(k for k in range(last + 1) if k % 4 != i)}" for i in range(4)}
    assert {r.id: r.value for r in store.stored_documents(spark, path).collect()} == want
    assert {r.id: r.value for r in store.stored_documents(spark, path, ["t2", "zz"]).collect()} == {"t2": want["t2"]}
    assert len(list((tmp_path / "table" / "rows").iterdir())) <= 4 and len(list((tmp_path / "table" / "_versions").glob("0*"))) == 2


def test_stored_documents_follow_the_stream(spark, tmp_path):
    inbox, table, checkpoint = tmp_path / "inbox", str(tmp_path / "t"), str(tmp_path / "c")
    steps = [{"id": f"s{k}", "trace_id": "a", "name": f"step {k}", "parent_id": "s0" if k else None, "start_time": f"2026-01-01T12:00:0{k}Z", "metadata": {"n": 1.5}} for k in range(3)]
    write_lines(inbox, doc("a", input={"q": 1}), doc("b"))
    live.stream_ingest(live.trace_stream(spark, str(inbox)), table, checkpoint).awaitTermination()
    write_lines(inbox, doc("a", status="completed", spans=steps), doc("c"))
    live.stream_ingest(live.trace_stream(spark, str(inbox)), table, checkpoint).awaitTermination()
    whole = store.get_stored_traces(spark, table, ["a", "nothing"]).collect()
    assert [(r.id, r.status, len(r.spans)) for r in whole] == [("a", "completed", 3)]
    fall = sorted((r.id, r.offset_ms, r.depth) for r in store.stored_waterfall(spark, table, ["a"]).collect())
    assert fall == [("s0", 0.0, 0), ("s1", 1000.0, 1), ("s2", 2000.0, 1)]
    out = str(tmp_path / "export")
    store.export_stored(spark, table, None, out)
    assert sorted(json.loads(r.value)["id"] for r in spark.read.text(out).collect()) == ["a", "b", "c"]
    store.erase_from(spark, table, spark.createDataFrame([("a",)], "id string"))
    assert store.get_stored_traces(spark, table, ["a"]).count() == 0 and ids_of(spark, table) == ["b", "c"]


def test_align_schema(spark):
    aged = spark.createDataFrame([("a", None)], "id string, environment string")
    row = src.align_schema(aged).first()
    assert (row["environment"], row["eval_count"], row["has_tool_loop"], row["project"]) == ("production", 0, False, None)


def test_stream_ingest(spark, tmp_path):
    inbox, table, checkpoint = tmp_path / "inbox", str(tmp_path / "t"), str(tmp_path / "c")
    call = {"id": "s", "trace_id": "a", "name": "LLM: gpt-4o", "span_type": "llm", "metadata": {"usage": {"prompt_tokens": 1000, "completion_tokens": 500, "total_tokens": 1500}}}
    write_lines(inbox, doc("a"), doc("b"), "{broken")
    live.stream_ingest(live.trace_stream(spark, str(inbox)), table, checkpoint).awaitTermination()
    write_lines(inbox, doc("a", status="completed", spans=[call]), doc("c"))
    live.stream_ingest(live.trace_stream(spark, str(inbox)), table, checkpoint).awaitTermination()
    got = {r["id"]: r for r in store.read_trace_rows(spark, table).collect()}
    assert set(got) == {"a", "b", "c"}
    assert got["a"]["status"] == "completed" and float(got["a"]["estimated_cost"]) == 0.0075


def test_span_tree(spark):
    def s(id, parent, name="n"):
        return ("t", id, parent, name)

    rows = [
        s("root", None, "root"), s("a", "root", "branch_a"), s("b", "root", "branch_b"), s("ta", "a", "Tool: a"), s("tb", "b", "Tool: b"),
        s("lost", "nowhere"), s("under", "lost"), s("x", "y"), s("y", "x"), s("z", "x"),
    ] + [s(f"c{i}", f"c{i - 1}" if i else "root") for i in range(20)]
    frame_ = spark.createDataFrame(rows, "trace_id string, id string, parent_id string, name string")
    got = {r["id"]: r for r in spans.span_tree(frame_).collect()}
    assert got["ta"]["path"] == ["root", "branch_a", "Tool: a"] and got["tb"]["root_id"] == "root"
    assert got["c19"]["depth"] == 20 and got["root"]["children"] == 3
    assert got["lost"]["is_orphan"] and got["lost"]["depth"] == 0 and got["under"]["root_id"] == "lost" and not got["under"]["is_orphan"]
    assert [got[i]["depth"] for i in "xyz"] == [None, None, None]
    assert len(got) == len(rows)
    # numbered in one piece or climbed, the result is the same
    climbed = {r["id"]: r for r in spans._climbed_tree(frame_).select(*spans.span_tree(frame_).columns).collect()}
    assert climbed == got
    held = {r["id"]: r for r in spans.span_intervals(frame_).collect()}
    below = {i: sum(held[j]["enter"] > r["enter"] and held[j]["enter"] <= r["leave"] for j in held if held[j]["enter"]) for i, r in held.items() if r["enter"]}
    assert below == {i: r["leave"] - r["enter"] for i, r in held.items() if r["enter"]} and below["root"] == 24 and below["c0"] == 19


def test_large_traces_are_climbed(spark, monkeypatch):
    rows = [("big", f"s{i}", f"s{i // 2}" if i else None, "n") for i in range(1, 40)] + [("small", "a", None, "n"), ("small", "b", "a", "m")]
    frame_ = spark.createDataFrame([(t, i, None if p == i else p, n) for t, i, p, n in rows], "trace_id string, id string, parent_id string, name string")
    whole = sorted(map(repr, spans.span_tree(frame_).collect()))
    monkeypatch.setattr(spans, "LARGE", 10)
    assert sorted(map(repr, spans.span_tree(frame_).collect())) == whole


def test_with_parent_of_unknown_run(spark):
    frame_ = spark.createDataFrame([("t", "a", None, "A", "node"), ("t", "b", "a", "B", "tool"), ("t", "c", "gone", "C", "tool")], "trace_id string, id string, parent_id string, name string, span_type string")
    got = {r["id"]: (r["parent_id"], r["parent_name"]) for r in spans.with_parent(frame_).collect()}
    assert got == {"a": (None, None), "b": ("a", "A"), "c": (None, None)}


def test_row_numbers_of_hot_groups(spark):
    rows = spark.range(2000).selectExpr("if(id % 3 = 0, 'hot', concat('k', id % 50)) as k", "cast(id * 7919 % 1000 as int) as v", "id")
    plain = row_numbers(rows, "k", ["v", "id"], [], "n")
    sliced = row_numbers(rows, "k", ["v", "id"], ["v div 100", "v"], "n")
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, sliced.collect()))


def test_topology_terminals(spark):
    graph = ([("classify", "classify"), ("fast", "fast"), ("END", "END")], [("classify", "fast", True, "f"), ("classify", "slow", True, None)])
    docs = frame(spark, trace("a")).withColumn("graph_topology", F.lit(None).cast("string")).drop("graph_topology")
    graphs = spark.createDataFrame([("a", graph), ("b", None)], "id string, graph_topology struct<nodes:array<struct<id:string,name:string>>,edges:array<struct<source:string,target:string,conditional:boolean,data:string>>>")
    nodes = [r["id"] for r in spans.topology_nodes(docs.join(graphs, "id", "right")).orderBy("trace_id", "pos").collect()]
    assert nodes == ["__start__", "classify", "fast", "END"]
    edges = spans.topology_edges(graphs).collect()
    assert [(r["conditional"], r["label"]) for r in edges] == [(True, "f"), (True, None)]


def test_export_of_stored_traces_can_be_packed(spark, tmp_path):
    plain, packed = str(tmp_path / "plain"), str(tmp_path / "packed")
    docs = spark.createDataFrame([("a", "flow")], "id string, name string").withColumn("spans", F.expr("cast(array() as array<struct<id:string,trace_id:string,parent_id:string,name:string,span_type:string,status:string,start_time:timestamp,end_time:timestamp,duration_ms:double,inputs:string,outputs:string,state_diff:string,error:string,metadata:string>>)"))
    docs = docs.withColumns({name: F.lit(None).cast("string") for name in ("input", "output", "error", "metadata")})
    src.export_traces(docs, None, plain)
    src.export_traces(docs, None, packed, "gzip")
    assert {p.suffix for p in (tmp_path / "packed").glob("part-*")} == {".gz"}
    assert spark.read.text(packed).collect() == spark.read.text(plain).collect()


def test_trees_of_many_traces_in_a_batch(spark):
    """Against a walk by parents: several traces in a batch, ids that occur in each, and spans without a name."""
    rows = [(f"t{t}", f"s{i}", f"s{(i * 7 + t) % i}" if i else None, None if i % 5 == 4 else f"n{t}-{i}") for t in range(40) for i in range(t % 9 + 1)]
    held = {(t, i): (p, n) for t, i, p, n in rows}

    def path(t, i):
        parent, name = held[t, i]
        return [*(path(t, parent) if parent else []), name]

    got = {(r.trace_id, r.id): r for r in spans.span_tree(spark.createDataFrame(rows, "trace_id string, id string, parent_id string, name string").coalesce(1)).collect()}
    assert got.keys() == held.keys()
    for (t, i), r in got.items():
        assert (r.path, r.depth, r.root_id) == (path(t, i), len(path(t, i)) - 1, "s0")
        assert r.children == sum(x == t and p == i for (x, _), (p, _) in held.items()) and not r.is_orphan


def test_json_null_and_empty_metadata_take_the_default(spark):
    """Absent, null and empty metadata come back as '{}' after a round trip; other values and other fields stay as they are."""
    texts = ["{}", "null", None, '{"a":null}', "[]", '""', "0", "not JSON"]
    lines = ['{"id":"%d","name":"n","spans":[]%s}' % (k, "" if t is None else f',"metadata":{t},"input":{t}') for k, t in enumerate(texts[:-1])]
    raw = src.parse_documents(spark.createDataFrame([(x,) for x in lines], "value string"), "value")
    typed = src.apply_defaults(raw, START)
    got = {int(r.id): (r.metadata, r.input) for r in typed.collect()}
    assert got == {0: ("{}", "{}"), 1: ("{}", got[1][1]), 2: ("{}", None), 3: ('{"a":null}', '{"a":null}'), 4: ("[]", "[]"), 5: ('""', '""'), 6: ("0", "0")}
    again = src.apply_defaults(src.parse_documents(src.export_documents(typed), "value"), START)
    assert {int(r.id): r.metadata for r in again.collect()} == {k: m for k, (m, _) in got.items()}


def test_tables_by_period_derive_their_rows_once(spark, monkeypatch):
    from tracelake.plans import registry

    made = []
    monkeypatch.setattr(registry, "rows_of", lambda spark, sf: made.append(sf) or spark.createDataFrame([], ROW))
    found = registry._over_periods(spark, "sample", lambda rows: rows.agg(F.count("*").alias("n")), "month", "year")
    assert sorted((r.period, r.n) for r in found.collect()) == [("month", 0), ("year", 0)]
    assert made == ["sample"]


def test_node_figures_read_their_rows_once(spark, tmp_path, monkeypatch):
    """Both passes go over the runs of nodes alone, not over what rows are derived from."""
    from tracelake.operators import analytics

    path, seen = str(tmp_path / "rows"), []
    blank = [None] * len(spark.createDataFrame([], ROW).columns)
    spark.createDataFrame([blank], ROW).write.parquet(path)
    real = analytics.order_statistic_with
    monkeypatch.setattr(analytics, "order_statistic_with", lambda facts, *rest: seen.extend(facts.inputFiles()) or real(facts, *rest))
    assert analytics.node_analytics(spark.read.schema(ROW).parquet(path)).collect() == []
    assert seen and not [name for name in seen if path in name]


def test_rows_dealt_by_id_are_stored_without_another_shuffle(spark, tmp_path):
    rows = spark.range(400).selectExpr("cast(id as string) as id", "concat('{', id, '}') as value", "false as gone").repartition(4, "id")
    path = str(tmp_path / "t")
    for dealt, files in ((False, 1), (True, 4)):
        segment = versions.write_segment(rows, path, "documents", {"number": 1, "buckets": 1}, dealt=dealt)
        kept = versions.entries(spark, path, "documents", [segment], "id string, value string")
        assert len(kept.inputFiles()) == files and kept.distinct().count() == 400


def test_read_traces_reads_packed_files(spark, monkeypatch):
    typed = src.apply_defaults(src.parse_documents(spark.createDataFrame([(json.dumps(doc()),)], "value string"), "value"))
    monkeypatch.setattr(registry.src, "documents", lambda *_: typed)
    read = registry.QUERIES["read_traces"](spark, "")
    assert [r["id"] for r in read.collect()] == ["a"] and all(f.endswith(".gz") for f in read.inputFiles())


def test_a_stored_waterfall_parses_its_documents_once(spark, tmp_path):
    told = [{"id": f"s{k}", "trace_id": "a", "name": f"n{k}", "parent_id": f"s{k - 1}" if k else None, "start_time": f"2026-01-01T12:00:0{k}Z", "duration_ms": 5.0} for k in range(3)]
    source = write_lines(tmp_path / "in", doc(spans=told), doc("b"), doc("c", spans=[told[0] | {"trace_id": "c"}]))
    live.stream_ingest(live.trace_stream(spark, source), str(tmp_path / "t"), str(tmp_path / "cp")).awaitTermination()
    found = store.get_stored_traces(spark, str(tmp_path / "t"))
    got = store.stored_waterfall(spark, str(tmp_path / "t"))
    assert "from_json" not in got._jdf.queryExecution().toString()
    assert sorted(got.collect()) == sorted(spans.span_waterfall(found, spans.spans_of(found)).select(*got.columns).collect())
    assert [(r.trace_id, r.id, r.offset_ms, r.depth) for r in sorted(got.collect())] == [("a", f"s{k}", 1000.0 * k, k) for k in range(3)] + [("c", "s0", 0.0, 0)]
