"""Queries over the sample tables, one per operator, each with its SQL twin where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime
from functools import reduce
from time import sleep as time_passes

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelake.functions import documents as docs
from tracelake.functions import models, numbers, text
from tracelake.operators import analytics, capture, diff, evals, listing, metrics, pricing, privacy, rate, spans
from tracelake.plans import dashboard, oracle
from tracelake.plans.oracle import CALLS, ROWS, SPANS, SUMMARY, TRACES, cents, half_up, pct, time
from tracelake.session import scratch_path
from tracelake.sources import driver_tables as src
from tracelake.sources import store, versions
from tracelake.sources import traces as trace_source
from tracelake.streaming import assembly, live, series, throttle

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
AS_OF = src.AS_OF


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(build: Query) -> Query:
        QUERIES[name] = lambda spark, sf_dir: shown(build(spark, sf_dir))
        if sql is not None:
            SQL[name] = sql
        return build

    return register


def shown(df: DataFrame) -> DataFrame:
    """Plain columns for comparing: decimals as doubles, ints as bigints, times and collections as text."""

    def plain(field: T.StructField) -> Column:
        col, kind = F.col(f"`{field.name}`"), field.dataType
        if isinstance(kind, T.DecimalType):
            col = col.cast("double")
        elif isinstance(kind, (T.IntegerType, T.ShortType)):
            col = col.cast("bigint")
        elif isinstance(kind, T.TimestampType):
            col = F.date_format(col, "yyyy-MM-dd HH:mm:ss.SSSSSS")
        elif isinstance(kind, T.DateType):
            col = col.cast("string")
        elif isinstance(kind, T.MapType):
            entries = F.transform(F.array_sort(F.map_entries(col)), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
            col = F.array_join(entries, ",")
        elif isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StringType):
            col = F.array_join(col, "|")
        return col.alias(field.name)

    return df.select(*[plain(f) for f in df.schema])


def rows_of(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.trace_rows(src.traces(spark, sf), src.spans(spark, sf))


def raw_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Documents the way they arrive: as JSON text parsed with the reading schema."""
    lines = trace_source.export_documents(src.documents(spark, sf))
    return trace_source.parse_documents(lines, "value")


def with_sql(*ctes: str, select: str) -> str:
    return "WITH " + ", ".join(ctes) + " " + select


# --- sources and sinks ----------------------------------------------------------------------------


@query(
    "read_traces",
    with_sql(TRACES, SPANS, select=f"""
    SELECT t.id, t.name, t.status, coalesce(t.environment, 'production') AS environment, {time('t.start_time')} AS start_time,
           count(s.id) AS n_spans, count(*) FILTER (WHERE s.span_type = 'llm') AS n_llm
    FROM t LEFT JOIN s ON s.trace_id = t.id GROUP BY ALL"""),
)
def _(spark, sf):
    path = scratch_path(spark, "documents")
    trace_source.export_traces(src.documents(spark, sf), None, path, compression="gzip")
    valid, _ = trace_source.split_valid(trace_source.read_traces(spark, path))
    typed = trace_source.apply_defaults(valid, AS_OF)
    n_llm = F.size(F.filter("spans", lambda s: s["span_type"] == "llm"))
    return typed.select("id", "name", "status", "environment", "start_time", F.size("spans").alias("n_spans"), n_llm.alias("n_llm"))


_BROKEN = """CASE WHEN o_orderkey % 11 = 0 THEN 'no id' WHEN o_orderkey % 11 = 1 THEN 'no name' WHEN o_orderkey % 11 = 2 THEN 'unknown status'
 WHEN o_orderkey % 11 = 3 THEN 'incomplete http' WHEN o_orderkey % 11 = 4 AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)
 THEN 'invalid span' ELSE 'valid' END"""


@query("split_valid", f"SELECT {_BROKEN} AS outcome, count(*) AS n FROM orders GROUP BY ALL")
def _(spark, sf):
    key = F.col("id").cast("bigint") % 11
    raw = raw_documents(spark, sf).withColumn("_key", key)
    broken = raw.withColumns(
        {
            "id": F.when(F.col("_key") != 0, F.col("id")),
            "name": F.when(F.col("_key") != 1, F.col("name")),
            "status": F.when(F.col("_key") == 2, "done").otherwise(F.col("status")),
            "http": F.when(F.col("_key") == 3, F.col("http").withField("url", F.lit(None).cast("string"))).otherwise(F.col("http")),
            "spans": F.when(
                F.col("_key") == 4, F.transform("spans", lambda s: s.withField("span_type", F.lit("robot")))
            ).otherwise(F.col("spans")),
        }
    )
    valid, rejected = trace_source.split_valid(broken)
    outcomes = valid.select(F.lit("valid").alias("outcome")).unionByName(rejected.select(F.col("reject_reason").alias("outcome")))
    return outcomes.groupBy("outcome").agg(F.count("*").alias("n"))


@query(
    "apply_defaults",
    with_sql(TRACES, select=f"""
    SELECT id, CASE WHEN o_orderkey % 3 = 0 THEN 'running' ELSE status END AS status, coalesce(environment, 'production') AS environment,
           CASE WHEN o_orderkey % 4 = 0 THEN '2001-08-02 00:00:00.000000' ELSE {time('start_time')} END AS start_time FROM t"""),
)
def _(spark, sf):
    key = F.col("id").cast("bigint")
    raw = raw_documents(spark, sf).withColumns(
        {"status": F.when(key % 3 != 0, F.col("status")), "start_time": F.when(key % 4 != 0, F.col("start_time"))}
    )
    return trace_source.apply_defaults(raw, AS_OF).select("id", "status", "environment", "start_time")


def _versions(spark, sf):
    """Trace rows with an update for some: those whose key divides by 3 come again as completed."""
    first = src.traces(spark, sf).select("id", "name", "status", "start_time", F.col("id").cast("bigint").alias("ingest_seq"))
    again = first.filter(F.col("ingest_seq") % 3 == 0).withColumns(
        {"status": F.lit("completed"), "ingest_seq": F.col("ingest_seq") + 1_000_000_000}
    )
    return first, again


@query("upsert_traces", with_sql(TRACES, select="SELECT id, name, CASE WHEN o_orderkey % 3 = 0 THEN 'completed' ELSE status END AS status FROM t"))
def _(spark, sf):
    first, again = _versions(spark, sf)
    return store.upsert_traces(first, again).select("id", "name", "status")


@query("append_traces", with_sql(TRACES, select="""
    SELECT status, count(*) AS n FROM (SELECT status FROM t UNION ALL SELECT 'completed' FROM t WHERE o_orderkey % 3 = 0) GROUP BY ALL"""))  # fmt: skip
def _(spark, sf):
    return store.append_traces(*_versions(spark, sf)).groupBy("status").agg(F.count("*").alias("n"))


@query("write_trace_rows", with_sql(ROWS, select=f"SELECT {SUMMARY}, CAST(date_trunc('year', start_time) AS DATE)::VARCHAR AS start_date FROM r"))
def _(spark, sf):
    path = scratch_path(spark, "rows")
    store.write_trace_rows(rows_of(spark, sf), path, period="year")
    rows = store.read_trace_rows(spark, path)
    return listing.trace_summaries(rows).join(rows.select("id", "start_date"), "id")


@query("upsert_into", with_sql(ROWS, select=f"""
    SELECT id, CASE WHEN o_orderkey % 5 = 0 THEN 'moved' ELSE name END AS name,
           {time("CASE WHEN o_orderkey % 5 = 0 THEN start_time + INTERVAL 400 DAY ELSE start_time END")} AS start_time, total_tokens FROM r"""))  # fmt: skip
def _(spark, sf):
    path = scratch_path(spark, "upserted")
    rows = rows_of(spark, sf)
    store.upsert_into(path, rows, period="year")
    moved = rows.filter(F.col("id").cast("bigint") % 5 == 0).withColumns(
        {"name": F.lit("moved"), "start_time": F.expr("start_time + interval 400 days")}
    )
    store.upsert_into(path, moved, period="year")
    return store.read_trace_rows(spark, path).select("id", "name", "start_time", "total_tokens")


@query("from_stored_rows", with_sql(TRACES, SPANS, select="""
    SELECT t.id, t.status, t.duration_ms, count(s.id) AS n_spans, CAST(coalesce(sum(s.pos), 0) AS BIGINT) AS sum_pos
    FROM t LEFT JOIN s ON s.trace_id = t.id GROUP BY ALL"""))  # fmt: skip
def _(spark, sf):
    stored = trace_source.export_documents(src.documents(spark, sf)).withColumnRenamed("value", "data_json")
    typed = trace_source.from_stored_rows(stored, now=AS_OF)
    n = F.size("spans")
    return typed.select("id", "status", "duration_ms", n.alias("n_spans"), F.expr("size(spans) * (size(spans) - 1) div 2").alias("sum_pos"))


@query("get_traces", with_sql(TRACES, select="SELECT id, name, status FROM t WHERE id IN (SELECT CAST(c_custkey * 3 AS VARCHAR) FROM customer)"))
def _(spark, sf):
    ids = src.table(spark, sf, "customer").select((F.col("c_custkey") * 3).cast("string").alias("id"))
    return trace_source.get_traces(src.traces(spark, sf), ids).select("id", "name", "status")


@query("export_traces", with_sql(TRACES, SPANS, select="""
    SELECT t.id, t.name, count(s.id) AS n_spans, min(CASE WHEN s.pos = 0 THEN s.id END) AS first_span
    FROM t LEFT JOIN s ON s.trace_id = t.id WHERE t.id IN (SELECT CAST(c_custkey AS VARCHAR) FROM customer) GROUP BY ALL"""))  # fmt: skip
def _(spark, sf):
    path = scratch_path(spark, "export")
    ids = src.table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("id"))
    trace_source.export_traces(src.documents(spark, sf), ids, path)
    doc = F.parse_json("value")
    lines = spark.read.text(path).select(doc.alias("d"))
    return lines.select(
        F.variant_get("d", "$.id", "string").alias("id"), F.variant_get("d", "$.name", "string").alias("name"),
        F.coalesce(F.size(F.try_variant_get("d", "$.spans", "array<variant>")), F.lit(0)).alias("n_spans"),
        F.try_variant_get("d", "$.spans[0].id", "string").alias("first_span"),
    )


@query("erase_traces", with_sql(TRACES, select="""
    SELECT status, count(*) AS n FROM t WHERE id NOT IN (SELECT CAST(c_custkey * 2 AS VARCHAR) FROM customer) GROUP BY ALL
    UNION ALL SELECT 'erased', count(*) FROM t WHERE id IN (SELECT CAST(c_custkey * 2 AS VARCHAR) FROM customer)"""))  # fmt: skip
def _(spark, sf):
    ids = src.table(spark, sf, "customer").select((F.col("c_custkey") * 2).cast("string").alias("id"))
    rest, report = store.erase_traces(src.traces(spark, sf), ids)
    kept = rest.groupBy("status").agg(F.count("*").alias("n"))
    return kept.unionByName(report.select(F.lit("erased").alias("status"), F.col("erased").alias("n")))


@query("retain_newest", with_sql(TRACES, select="""
    SELECT id, CASE WHEN o_orderkey % 3 = 0 THEN 'completed' ELSE status END AS status FROM t ORDER BY o_orderkey DESC LIMIT 1000"""))  # fmt: skip
def _(spark, sf):
    return store.retain_newest(store.append_traces(*_versions(spark, sf)), 1000).select("id", "status")


@query("overlay_rate_card", "WITH " + oracle._card() + """,
    own AS (SELECT 'gpt-' || CAST(s_suppkey % 10 AS VARCHAR) AS model, CAST(max(s_suppkey) AS DECIMAL(12,6)) AS p FROM supplier GROUP BY ALL)
    SELECT coalesce(own.model, card.model) AS model, CASE WHEN own.model IS NULL THEN 'default' ELSE 'custom' END AS source,
           CAST(coalesce(own.p, card.p) AS DOUBLE) AS prompt_rate, CAST(coalesce(own.p, card.c) AS DOUBLE) AS completion_rate,
           CAST(card.k AS DOUBLE) AS cached_rate FROM card FULL JOIN own ON own.model = card.model""")  # fmt: skip
def _(spark, sf):
    return pricing.overlay_rate_card(pricing.rate_card(spark), _own_card(spark, sf, 10))


def _own_card(spark, sf, groups):
    key = F.concat(F.lit("gpt-"), (F.col("s_suppkey") % groups).cast("string"))
    price = F.max("s_suppkey").cast("decimal(12,6)")
    grouped = src.table(spark, sf, "supplier").groupBy(key.alias("model")).agg(price.alias("prompt_rate"), F.min("s_suppkey").cast("int").alias("seq"))
    return grouped.select(
        F.lit("custom").alias("source"), "seq", "model", "prompt_rate", F.col("prompt_rate").alias("completion_rate"),
        F.lit(None).cast("decimal(12,6)").alias("cached_rate"),
    )


@query("spans_of", with_sql(SPANS, select="SELECT trace_id, id, parent_id, pos, name, span_type, status, CASE WHEN span_type = 'llm' THEN prompt END AS prompt_tokens FROM s"))
def _(spark, sf):
    flat = spans.spans_of(src.documents(spark, sf))
    return flat.select("trace_id", "id", "parent_id", "pos", "name", "span_type", "status", F.col("usage.prompt_tokens").alias("prompt_tokens"))


@query("nest_spans", with_sql(SPANS, select="SELECT trace_id, string_agg(id, '|' ORDER BY pos) AS ids FROM s GROUP BY ALL"))
def _(spark, sf):
    nested = spans.nest_spans(src.spans(spark, sf), ["id", "name"])
    return nested.select("trace_id", F.transform("spans", lambda s: s["id"]).alias("ids"))


@query("align_schema", with_sql(TRACES, select="SELECT coalesce(environment, 'production') AS environment, CAST(0 AS BIGINT) AS eval_count, FALSE AS has_tool_loop, count(*) AS n FROM t GROUP BY ALL"))
def _(spark, sf):
    aged = src.traces(spark, sf).select("id", "name", "status", "environment")
    return trace_source.align_schema(aged).groupBy("environment", "eval_count", "has_tool_loop").agg(F.count("*").alias("n"))


# --- the stored row -------------------------------------------------------------------------------

_TRACE_ROWS_SQL = with_sql(ROWS, """
ncs AS (SELECT trace_id, string_agg(node_name || '=' || CAST(executions AS VARCHAR), ',' ORDER BY node_name) AS v FROM nc GROUP BY ALL),
mcs AS (SELECT trace_id, string_agg(model || '=' || CAST(calls AS VARCHAR), ',' ORDER BY model) AS v FROM mc GROUP BY ALL),
nms AS (SELECT trace_id, string_agg(name || ':' || CAST(""" + cents("duration_ms") + """ AS VARCHAR) || ':' || status, '|' ORDER BY pos) AS v
        FROM s WHERE span_type = 'node' GROUP BY ALL)""", select=f"""
SELECT {SUMMARY}, coalesce(ncs.v, '') AS node_counts, coalesce(mcs.v, '') AS model_counts, coalesce(nms.v, '') AS node_metrics
FROM r LEFT JOIN ncs ON ncs.trace_id = id LEFT JOIN mcs ON mcs.trace_id = id LEFT JOIN nms ON nms.trace_id = id""")  # fmt: skip


def _runs_as_text(rows: DataFrame) -> DataFrame:
    text_of = F.transform(
        "node_metrics",
        lambda n: F.concat(n["name"], F.lit(":"), numbers.cents(n["duration_ms"]).cast("string"), F.lit(":"), n["status"]),
    )
    return rows.withColumn("node_metrics", text_of)


@query("trace_rows", _TRACE_ROWS_SQL)
def _(spark, sf):
    return _runs_as_text(rows_of(spark, sf))


@query("trace_rows_of_documents", _TRACE_ROWS_SQL)
def _(spark, sf):
    return _runs_as_text(metrics.trace_rows(src.documents(spark, sf)))


@query("trace_summaries", with_sql(ROWS, select=f"SELECT {SUMMARY} FROM r"))
def _(spark, sf):
    return listing.trace_summaries(rows_of(spark, sf))


@query("flatten_http", with_sql(TRACES, select="SELECT id, 'POST' AS http_method, http_path, CAST(http_status_code AS BIGINT) AS http_status_code FROM t"))
def _(spark, sf):
    return metrics.flatten_http(src.traces(spark, sf))


@query("scrub_headers", "SELECT CAST(o_orderkey AS VARCHAR) AS id, 'X-Priority=' || o_orderpriority AS headers FROM orders")
def _(spark, sf):
    orders = src.table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("id"), "o_orderpriority")
    with_headers = orders.select(
        "id", F.expr("named_struct('headers', map('Authorization', 'Bearer x', 'X-API-Key', 'k', 'X-Priority', o_orderpriority, 'Set-Cookie', 'c'))").alias("http")
    )
    return listing.scrub_headers(with_headers).select("id", F.col("http.headers").alias("headers"))


# --- filters --------------------------------------------------------------------------------------


def _filter_query(name: str, where: str, **filters) -> None:
    @query(name, with_sql(ROWS, select=f"SELECT {SUMMARY} FROM r WHERE {where}"))
    def _(spark, sf):
        return listing.trace_summaries(listing.filter_traces(rows_of(spark, sf), **filters))


_filter_query("filter_traces", "status = 'failed' AND environment = 'staging' AND project = 'proj_2' AND start_time >= TIMESTAMP '1997-01-01' AND contains(name, 'wf_')",
              status="Failed", environment="STAGING", project="proj_2", from_time="1997-01-01T00:00:00Z", search="WF_")
_filter_query("filter_by_status", "status = 'completed'", status="COMPLETED")
_filter_query("filter_by_environment", "environment = 'production'", environment="Production")
_filter_query("filter_by_project", "project = 'proj_1'", project="PROJ_1")
_filter_query("filter_by_time", "start_time >= TIMESTAMP '1998-03-01' AND start_time <= TIMESTAMP '1998-06-01 12:00:00'",
              from_time="1998-03-01T00:00:00+00:00", to_time="1998-06-01T12:00:00Z")
_filter_query("filter_by_eval_status", "eval_status = 'passed'", eval_status="Passed")
_filter_query("search_traces", "contains(name, 'f_3') OR contains(http_path, 'f_3') OR contains(id, 'f_3') OR coalesce(contains(project, 'f_3'), FALSE)", search="F_3")


@query("exclude_paths", with_sql(TRACES, select="SELECT id, http_path FROM t WHERE NOT starts_with(http_path, '/api/wf_1') AND NOT starts_with(http_path, '/api/wf_4')"))
def _(spark, sf):
    return listing.exclude_paths(src.traces(spark, sf), ["/api/wf_1", "/api/wf_4"]).select("id", F.col("http.path").alias("http_path"))


@query("sample_traces", with_sql(TRACES, select="SELECT id, name FROM t WHERE CAST('0x' || left(md5('7:' || id), 12) AS BIGINT) % 1000000 < 250000"))
def _(spark, sf):
    return listing.sample_traces(src.traces(spark, sf), 0.25, seed=7).select("id", "name")


@query("spans_of_type", with_sql(SPANS, select="SELECT trace_id, id, name FROM s WHERE span_type = 'tool'"))
def _(spark, sf):
    return spans.spans_of_type(src.spans(spark, sf), "tool").select("trace_id", "id", "name")


@query("status_from_http", with_sql(TRACES, select="SELECT id, CASE WHEN http_status_code >= 500 THEN 'failed' ELSE 'completed' END AS status FROM t"))
def _(spark, sf):
    return src.traces(spark, sf).select("id", listing.status_from_http(F.col("http.status_code")).alias("status"))


# --- joins ----------------------------------------------------------------------------------------


@query("with_parent", with_sql(SPANS, select="""
    SELECT s.trace_id, s.id, p.id AS parent_id, p.name AS parent_name, p.span_type AS parent_type
    FROM s LEFT JOIN s p ON p.trace_id = s.trace_id AND p.id = s.parent_id"""))  # fmt: skip
def _(spark, sf):
    return spans.with_parent(src.spans(spark, sf)).select("trace_id", "id", "parent_id", "parent_name", "parent_type")


def _model_names(spark, sf):
    """Model names of many shapes out of the part table."""
    part = src.table(spark, sf, "part")
    return part.select(F.expr(_MODEL_NAME).alias("model"))


_MODEL_NAME = """CASE p_partkey % 8 WHEN 0 THEN 'openai/gpt-' || CAST(p_size AS STRING) WHEN 1 THEN 'gpt_4o-' || CAST(p_partkey AS STRING)
 WHEN 2 THEN 'x-claude-3-opus-' || CAST(p_size AS STRING) WHEN 3 THEN 'My-' || p_brand WHEN 4 THEN 'realtime-mini-' || CAST(p_size AS STRING)
 WHEN 5 THEN ' O1-' || CAST(p_size AS STRING) || ':latest' WHEN 6 THEN 'models/gemini-1.5-pro-' || CAST(p_size AS STRING)
 ELSE 'ft:gpt-4o:' || CAST(p_partkey AS STRING) END"""
_PART_MODELS = "SELECT " + _MODEL_NAME.replace("STRING", "VARCHAR") + " AS model FROM part"
_RATE_COLUMNS = "CAST(p AS DOUBLE) AS prompt_rate, CAST(c AS DOUBLE) AS completion_rate, CAST(k AS DOUBLE) AS cached_rate"


@query("price_models", "WITH " + oracle.rates(_PART_MODELS) + f" SELECT model, {_RATE_COLUMNS} FROM rate")
def _(spark, sf):
    return pricing.price_models(_model_names(spark, sf))


@query("price_models_own_card", "WITH " + oracle.rates(_PART_MODELS) + """,
    own AS (SELECT 'gpt-' || CAST(s_suppkey % 40 AS VARCHAR) AS key, CAST(max(s_suppkey) AS DECIMAL(12,6)) AS p, min(s_suppkey) AS seq FROM supplier GROUP BY ALL),
    ex AS (SELECT key AS n, p FROM own),
    near AS (SELECT n, arg_min(own.p, own.seq) AS p FROM (SELECT DISTINCT n FROM nm WHERE n NOT IN ('unknown', '')) JOIN own ON starts_with(n, key) OR starts_with(key, n) GROUP BY n),
    fin AS (SELECT r.model, ex.p AS xp, CASE WHEN card.model IS NULL THEN near.p END AS np, r.p, r.c, r.k FROM rate r LEFT JOIN ex USING (n)
            LEFT JOIN near USING (n) LEFT JOIN card ON card.model = r.n)
    SELECT model, CAST(coalesce(xp, np, p) AS DOUBLE) AS prompt_rate, CAST(coalesce(xp, np, c) AS DOUBLE) AS completion_rate,
           CAST(k AS DOUBLE) AS cached_rate FROM fin""")  # fmt: skip
def _(spark, sf):
    return pricing.price_models(_model_names(spark, sf), _own_card(spark, sf, 40))


_TREE = """
, tree AS (
  WITH RECURSIVE w AS (
    SELECT trace_id, id, id AS root_id, CAST(0 AS BIGINT) AS depth, name AS path, [id] AS ids FROM s WHERE parent_id IS NULL
    UNION ALL
    SELECT s.trace_id, s.id, w.root_id, w.depth + 1, w.path || '|' || s.name, list_append(w.ids, s.id) FROM s JOIN w ON s.trace_id = w.trace_id AND s.parent_id = w.id
  ) SELECT * FROM w
)"""


@query("span_tree", "WITH " + SPANS + _TREE + """
    , kids AS (SELECT trace_id, parent_id AS id, count(*) AS n FROM s WHERE parent_id IS NOT NULL GROUP BY ALL)
    SELECT tree.trace_id, tree.id, root_id, depth, path, coalesce(kids.n, 0) AS children, FALSE AS is_orphan
    FROM tree LEFT JOIN kids ON kids.trace_id = tree.trace_id AND kids.id = tree.id""")  # fmt: skip
def _(spark, sf):
    return spans.span_tree(src.spans(spark, sf))


@query("span_intervals", "WITH " + SPANS + _TREE + """
    , below AS (SELECT a.trace_id, a.id, count(b.id) AS n FROM tree a LEFT JOIN tree b ON b.trace_id = a.trace_id AND b.id <> a.id AND list_contains(b.ids, a.id) GROUP BY ALL)
    SELECT tree.trace_id, tree.id, depth, n AS below FROM tree JOIN below USING (trace_id, id)""")
def _(spark, sf):
    held = spans.span_intervals(src.spans(spark, sf))
    return held.select("trace_id", "id", "depth", (F.col("leave") - F.col("enter")).alias("below"))


@query("span_waterfall", "WITH " + SPANS + _TREE + """
    SELECT s.trace_id, s.id, s.name, CAST(s.pos * 1000 AS DOUBLE) AS offset_ms, s.duration_ms, tree.depth
    FROM s JOIN tree ON tree.trace_id = s.trace_id AND tree.id = s.id""")  # fmt: skip
def _(spark, sf):
    return spans.span_waterfall(src.traces(spark, sf), src.timed_spans(spark, sf))


# --- aggregations per trace -----------------------------------------------------------------------

_COSTS = ", ".join(f"CAST(sum({c}) AS DOUBLE) AS {c}" for c in ("total_cost", "prompt_cost", "completion_cost"))


@query("llm_metrics", with_sql(CALLS, select=f"""
    SELECT trace_id, count(*) AS llm_calls, CAST(sum(total) AS BIGINT) AS total_tokens, CAST(sum(prompt) AS BIGINT) AS prompt_tokens,
           CAST(sum(completion) AS BIGINT) AS completion_tokens, {_COSTS} FROM calls GROUP BY trace_id"""))  # fmt: skip
def _(spark, sf):
    return metrics.llm_metrics(src.spans(spark, sf))


@query("model_usage", with_sql(CALLS, select="""
    SELECT trace_id, model, count(*) AS calls, CAST(sum(prompt) AS BIGINT) AS prompt_tokens, CAST(sum(completion) AS BIGINT) AS completion_tokens,
           CAST(sum(total) AS BIGINT) AS total_tokens, CAST(sum(total_cost) AS DOUBLE) AS total_cost FROM calls GROUP BY ALL"""))  # fmt: skip
def _(spark, sf):
    return metrics.model_usage(src.spans(spark, sf))


@query("estimated_cost", with_sql(CALLS, select="SELECT trace_id, CAST(sum(total_cost) AS DOUBLE) AS estimated_cost FROM calls GROUP BY ALL"))
def _(spark, sf):
    return metrics.estimated_cost(src.spans(spark, sf))


_OWN_CALLS = CALLS.replace("rate AS (SELECT nm.model, nm.n, card.p, card.c, ck.k FROM", """own AS (
      SELECT 'totally-unknown' AS model, CAST(max(s_suppkey) AS DECIMAL(12,6)) AS p, CAST(min(s_suppkey) AS DECIMAL(12,6)) AS c FROM supplier
      UNION ALL SELECT 'gpt-4o-mini', CAST(count(*) AS DECIMAL(12,6)), CAST(1.5 AS DECIMAL(12,6)) FROM supplier),
    rate AS (SELECT nm.model, nm.n, coalesce(own.p, card.p) AS p, coalesce(own.c, card.c) AS c, ck.k FROM""").replace(
    "card.model = coalesce(pre.key, fb.key))", "card.model = coalesce(pre.key, fb.key) LEFT JOIN own ON own.model = nm.n)")


@query("load_rate_card", with_sql(_OWN_CALLS, select="""
    SELECT trace_id, CAST(sum(total_cost) AS DOUBLE) AS estimated_cost, count(*) FILTER (WHERE is_estimated) AS priced, 2 AS loaded FROM calls GROUP BY trace_id"""))  # fmt: skip
def _(spark, sf):
    """A price list as a file: a pair, an object, and a member that is neither; its prices are inlined into the lookup."""
    path = scratch_path(spark, "price-list")
    found = src.table(spark, sf, "supplier").agg(F.max("s_suppkey").alias("most"), F.min("s_suppkey").alias("least"), F.count("*").alias("n"))
    text = F.format_string('{"totally-unknown": [%s, %s], "gpt-4o-mini": {"prompt": %s, "completion": 1.5}, "broken": 7}', F.col("most").cast("string"), F.col("least").cast("string"), F.col("n").cast("string"))
    found.select(text.alias("value")).coalesce(1).write.text(path)
    card, n = trace_source.load_rate_card(spark, path)
    priced = pricing.price_spans(src.spans(spark, sf), card)
    sums = priced.groupBy("trace_id").agg(F.sum("call.total_cost").alias("estimated_cost"), F.count_if(F.col("call.is_estimated")).alias("priced"))
    return sums.withColumn("loaded", F.lit(n).cast("bigint"))


@query("rollup_status", with_sql(ROWS, select="SELECT id, status FROM r"))
def _(spark, sf):
    return metrics.rollup_status(src.traces(spark, sf), src.spans(spark, sf)).select("id", "status")


@query("has_error", with_sql(ROWS, select="SELECT id, has_error FROM r"))
def _(spark, sf):
    return metrics.has_error(src.traces(spark, sf), src.spans(spark, sf))


@query("tool_calls", with_sql(SPANS, oracle.LOOPS, select="""
    SELECT trace_id, tool, CAST(calls AS BIGINT) AS calls, distinct_inputs, first_pos,
           calls >= 5 OR (calls >= 3 AND calls - distinct_inputs >= 2) AS loops FROM tool"""))  # fmt: skip
def _(spark, sf):
    return metrics.tool_calls(src.spans(spark, sf))


@query("detect_tool_loops", with_sql(SPANS, oracle.LOOPS, select="SELECT trace_id, tool_loop_tool, CAST(tool_loop_count AS BIGINT) AS tool_loop_count FROM lp"))
def _(spark, sf):
    return metrics.detect_tool_loops(src.spans(spark, sf))


@query("eval_rollup", with_sql(ROWS, select="SELECT id, eval_count, eval_status FROM r"))
def _(spark, sf):
    return evals.eval_rollup(src.traces(spark, sf), src.spans(spark, sf))


def _recorded(spark, sf):
    """Traces listing evals in metadata and eval spans carrying records, some of them the same."""
    record = F.expr("concat('{\"name\":\"q\",\"passed\":', if(cast(id as bigint) % 4 = 0, 'false', 'true'), '}')")
    listed = F.concat(F.lit('{"evals":['), record, F.lit(","), record, F.lit("]}"))
    t = src.traces(spark, sf).withColumn("metadata", F.when(F.col("id").cast("bigint") % 3 == 0, listed).otherwise("{}"))
    on_span = F.expr(
        "case when pos % 3 = 0 then null when pos % 3 = 1 then concat('{\"name\":\"q\",\"passed\":', if(cast(trace_id as bigint) % 4 = 0, 'false', 'true'), '}') "
        "else '{\"passed\":true,\"name\":\"z\"}' end"
    )
    s = src.spans(spark, sf).withColumn("eval", F.when(F.col("span_type") == "eval", on_span))
    return t, s


@query("union_evals", with_sql(TRACES, SPANS, """
    meta AS (SELECT id AS trace_id, 'q' AS rec, o_orderkey % 4 <> 0 AS passed FROM t, range(2) WHERE o_orderkey % 3 = 0),
    ev AS (SELECT trace_id, CASE pos % 3 WHEN 0 THEN NULL WHEN 1 THEN 'q' ELSE 'z' END AS rec,
                  CASE pos % 3 WHEN 0 THEN status = 'completed' WHEN 1 THEN CAST(trace_id AS BIGINT) % 4 <> 0 ELSE TRUE END AS passed
           FROM s WHERE span_type = 'eval'),
    onspan AS (SELECT DISTINCT trace_id, rec, passed FROM ev WHERE rec IS NOT NULL AND NOT (rec = 'q' AND CAST(trace_id AS BIGINT) % 3 = 0)),
    alle AS (SELECT * FROM meta UNION ALL SELECT * FROM onspan UNION ALL SELECT * FROM ev WHERE rec IS NULL),
    g AS (SELECT trace_id, count(*) AS n, bool_and(passed) AS ok FROM alle GROUP BY ALL)""", select="""
    SELECT t.id, coalesce(n, 0) AS eval_count, CASE WHEN ok THEN 'passed' WHEN NOT ok THEN 'failed' END AS eval_status FROM t LEFT JOIN g ON g.trace_id = t.id"""))  # fmt: skip
def _(spark, sf):
    return evals.eval_rollup(*_recorded(spark, sf))


SQL["union_evals_in_rows"] = SQL["union_evals"]
QUERIES["union_evals_in_rows"] = lambda spark, sf: shown(
    metrics.trace_rows(*_recorded(spark, sf)).select("id", "eval_count", "eval_status")
)


@query("node_counts", with_sql(SPANS, select="SELECT trace_id, name AS node_name, count(*) AS executions FROM s WHERE span_type = 'node' GROUP BY ALL"))
def _(spark, sf):
    return metrics.node_counts(src.spans(spark, sf))


@query("node_metrics", with_sql(SPANS, select="SELECT trace_id, string_agg(name || ':' || CAST(" + cents("duration_ms") + " AS VARCHAR) || ':' || status, '|' ORDER BY pos) AS node_metrics FROM s WHERE span_type = 'node' GROUP BY ALL"))
def _(spark, sf):
    return _runs_as_text(metrics.node_metrics(src.spans(spark, sf)))


@query("model_counts", with_sql(CALLS, select="SELECT trace_id, model, count(*) AS calls FROM calls GROUP BY ALL"))
def _(spark, sf):
    return metrics.model_counts(src.spans(spark, sf))


# --- KPIs, time series, nodes ---------------------------------------------------------------------

_KPI = f"""count(*) AS total_traces, count(*) FILTER (WHERE status = 'completed') AS completed_traces,
    count(*) FILTER (WHERE status = 'failed' OR has_error) AS failed_traces,
    {pct("count(*) FILTER (WHERE status = 'completed')", "count(*)")} AS success_rate,
    {half_up(f"coalesce(sum({cents('duration_ms')}), 0)", "count(duration_ms) * 100", 2)} AS avg_duration_ms,
    CAST(coalesce(sum(total_tokens), 0) AS BIGINT) AS total_tokens, CAST(coalesce(sum(llm_calls), 0) AS BIGINT) AS total_llm_calls,
    CAST(coalesce(sum(cost), 0) AS DOUBLE) AS total_cost"""
_P95 = "(SELECT CAST(d AS DOUBLE) FROM (SELECT CAST(duration_ms AS DECIMAL(18,2)) AS d, row_number() OVER (ORDER BY duration_ms) - 1 AS k, count(*) OVER () AS n FROM r WHERE duration_ms IS NOT NULL) WHERE k = (95 * (n - 1)) // 100)"


@query("kpi_stats", with_sql(ROWS, select=f"SELECT {_KPI} FROM r"))
def _(spark, sf):
    return analytics.kpi_stats(rows_of(spark, sf))


@query("kpi_stats_of_nothing", with_sql(ROWS, select=f"SELECT {_KPI} FROM r WHERE status = 'no such'"))
def _(spark, sf):
    return analytics.kpi_stats(listing.filter_traces(rows_of(spark, sf), status="no such"))


@query("kpi_p95", with_sql(ROWS, select=f"SELECT {_P95} AS p95_duration_ms"))
def _(spark, sf):
    return analytics.kpi_p95(rows_of(spark, sf))


@query("store_stats", with_sql(ROWS, select=f"SELECT {_KPI}, {_P95} AS p95_duration_ms FROM r"))
def _(spark, sf):
    return dashboard.store_stats(rows_of(spark, sf))


@query("node_execution_totals", with_sql(ROWS, select="""
    SELECT node_name, CAST(sum(executions) AS BIGINT) AS executions FROM nc
    JOIN (SELECT id FROM r ORDER BY start_time DESC, id LIMIT 100) ON id = trace_id GROUP BY ALL"""))  # fmt: skip
def _(spark, sf):
    return analytics.node_execution_totals(rows_of(spark, sf), 100)


@query("node_execution_totals_all", with_sql(ROWS, select="SELECT node_name, CAST(sum(executions) AS BIGINT) AS executions FROM nc GROUP BY ALL"))
def _(spark, sf):
    return analytics.node_execution_totals(rows_of(spark, sf))


def _series_sql(start: str, end: str, buckets: int, width: int, where: str = "TRUE") -> str:
    return with_sql(ROWS, f"""
    m AS (SELECT *, least(CAST(epoch_us(start_time - {start}) // {width * 1_000_000} AS BIGINT), {buckets} - 1) AS bucket FROM
          (SELECT r.*, start_time AS st FROM r) WHERE start_time >= {start} AND start_time <= {end} AND {where}),
    g AS (SELECT bucket, count(*) AS n, count(*) FILTER (WHERE has_error OR status = 'failed') AS e, count(duration_ms) AS timed,
                 sum({cents('duration_ms')}) AS c, sum(cost) AS cost, sum(total_tokens) AS tok,
                 quantile_disc(CAST(duration_ms AS DECIMAL(18,2)), 0.95) AS p95 FROM m GROUP BY ALL),
    b AS (SELECT range AS bucket, {start} + to_seconds(range * {width}) AS bucket_start FROM range({buckets})),
    z AS (SELECT b.*, coalesce(n, 0) AS n, coalesce(e, 0) AS e, {half_up('coalesce(c, 0)', 'coalesce(timed, 0) * 100', 2)} AS avg_ms,
                 coalesce(CAST(p95 AS DOUBLE), 0.0) AS p95, coalesce(cost, 0) AS cost, coalesce(tok, 0) AS tok FROM b LEFT JOIN g USING (bucket))""",
    select=f"""
    SELECT bucket, {time('bucket_start')} AS bucket_start, strftime(bucket_start, '%H:%M') AS label, n AS trace_count, greatest(n - e, 0) AS success_count,
           e AS error_count, {pct('e', 'n')} AS error_rate, avg_ms AS avg_duration_ms, greatest(p95, avg_ms) AS p95_duration_ms,
           CAST(round(CAST(cost AS DECIMAL(28,6)), 4) AS DOUBLE) AS total_cost, CAST(tok AS BIGINT) AS total_tokens FROM z""")  # fmt: skip


_INTERVALS = {"24h": ("INTERVAL 24 HOUR", 24, 3600), "7d": ("INTERVAL 7 DAY", 14, 43200), "30d": ("INTERVAL 30 DAY", 30, 86400)}
for _token, (_interval, _n, _width) in _INTERVALS.items():

    @query(f"timeseries_{_token}", _series_sql(f"({oracle.AS_OF} - {_interval})", oracle.AS_OF, _n, _width))
    def _(spark, sf, token=_token):
        return analytics.timeseries(rows_of(spark, sf), token, as_of=AS_OF)


def _stored(spark: SparkSession, rows: DataFrame, period: str) -> DataFrame:
    path = scratch_path(spark, f"rows-by-{period}")
    store.write_trace_rows(rows, path, period=period)
    return store.read_trace_rows(spark, path)


def _over_periods(spark: SparkSession, sf: str, figures: Callable[[DataFrame], DataFrame], *periods: str) -> DataFrame:
    """The same figures from tables partitioned by each period; rows are derived for the first one and stored again for the others."""
    rows, parts = rows_of(spark, sf), []
    for period in periods:
        rows = _stored(spark, rows, period)
        parts.append(figures(rows).withColumn("period", F.lit(period)))
    return reduce(DataFrame.unionByName, parts)


def _each_period(sql: str, *periods: str) -> str:
    return f"SELECT * FROM ({sql}) x, (VALUES {', '.join(f'({chr(39)}{p}{chr(39)})' for p in periods)}) p(period)"


@query("timeseries_stored", _each_period(_series_sql(f"({oracle.AS_OF} - INTERVAL 30 DAY)", oracle.AS_OF, 30, 86400), "month", "year"))
def _(spark, sf):
    return _over_periods(spark, sf, lambda rows: analytics.timeseries(rows, "30d", as_of=AS_OF), "month", "year")


_RANGE = (datetime(1995, 3, 7, 5), datetime(1995, 6, 20, 17))


@query("filter_by_time_stored", _each_period(with_sql(ROWS, select=f"SELECT count(*) AS n, min(id) AS first_id, max(id) AS last_id FROM r WHERE start_time >= TIMESTAMP '{_RANGE[0]}' AND start_time <= TIMESTAMP '{_RANGE[1]}'"), "month", "year"))
def _(spark, sf):
    def found(rows: DataFrame) -> DataFrame:
        chosen = listing.filter_traces(rows, from_time=_RANGE[0], to_time=_RANGE[1])
        return chosen.agg(F.count("*").alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))

    return _over_periods(spark, sf, found, "month", "year")


def _days(start: datetime, end: datetime) -> int:
    return max(30, -(-int((end - start).total_seconds()) // 86400))


@query("timeseries", _series_sql("TIMESTAMP '1995-01-01'", oracle.AS_OF, _days(datetime(1995, 1, 1), AS_OF), 86400, "environment = 'production'"))
def _(spark, sf):
    return analytics.timeseries(rows_of(spark, sf), environment="production", start=datetime(1995, 1, 1), end=AS_OF, as_of=AS_OF)


@query("zero_fill", _series_sql("TIMESTAMP '1998-01-01'", "TIMESTAMP '2002-01-01'", _days(datetime(1998, 1, 1), datetime(2002, 1, 1)), 86400))
def _(spark, sf):
    """Days before and after the last trace of the sample: filled buckets and empty ones."""
    return analytics.timeseries(rows_of(spark, sf), start=datetime(1998, 1, 1), end=datetime(2002, 1, 1), as_of=AS_OF)


@query("timeseries_models", with_sql(ROWS, select="""
    SELECT least(CAST(epoch_us(start_time - TIMESTAMP '1995-01-01') // 86400000000 AS BIGINT), """ + str(_days(datetime(1995, 1, 1), AS_OF) - 1) + """) AS bucket,
      model, CAST(sum(calls) AS BIGINT) AS calls
    FROM r JOIN mc ON mc.trace_id = id WHERE start_time >= TIMESTAMP '1995-01-01' AND start_time <= """ + oracle.AS_OF + """ GROUP BY ALL"""))  # fmt: skip
def _(spark, sf):
    return analytics.timeseries_models(rows_of(spark, sf), start=datetime(1995, 1, 1), end=AS_OF, as_of=AS_OF)


@query("timeseries_total", with_sql(ROWS, select=f"SELECT count(*) AS total_traces FROM r WHERE start_time >= {oracle.AS_OF} - INTERVAL 30 DAY AND start_time <= {oracle.AS_OF}"))
def _(spark, sf):
    grid = analytics.resolve_window("30d", as_of=AS_OF)
    total = analytics.timeseries_total(rows_of(spark, sf), grid)
    return spark.range(1).select(F.lit(total).cast("bigint").alias("total_traces"))


def _nodes_sql(chosen: str) -> str:
    return with_sql(ROWS, f"""
    ch AS ({chosen}), tot AS (SELECT count(*) AS n FROM ch),
    run AS (SELECT s.trace_id, s.name, s.status, CAST(s.duration_ms AS DECIMAL(18,2)) AS d FROM s JOIN ch ON ch.id = s.trace_id WHERE span_type = 'node'),
    rk AS (SELECT name, d, row_number() OVER (PARTITION BY name ORDER BY d) - 1 AS k, count(*) OVER (PARTITION BY name) AS n FROM run),
    p AS (SELECT name, min(d) AS p95 FROM rk WHERE k = (95 * (n - 1)) // 100 GROUP BY name),
    g AS (SELECT name, count(*) AS x, count(DISTINCT trace_id) AS tr, count(*) FILTER (WHERE status = 'failed') AS e,
                 sum(CAST(d * 100 AS BIGINT)) AS c, min(d) AS lo, max(d) AS hi FROM run GROUP BY name)""", select=f"""
    SELECT g.name AS node_name, x AS executions, tr AS traces_executed, {pct('tr', 'tot.n')} AS frequency_pct, e AS error_count, {pct('e', 'x')} AS error_rate,
           {half_up('c', 'x * 100', 2)} AS avg_duration_ms, CAST(p95 AS DOUBLE) AS p95_duration_ms, CAST(lo AS DOUBLE) AS min_duration_ms,
           CAST(hi AS DOUBLE) AS max_duration_ms FROM g JOIN p USING (name), tot""")  # fmt: skip


@query("node_analytics", _nodes_sql("SELECT id FROM r"))
def _(spark, sf):
    return analytics.node_analytics(rows_of(spark, sf))


@query("node_analytics_recent", _nodes_sql("SELECT id FROM r ORDER BY start_time DESC, id LIMIT 500"))
def _(spark, sf):
    return analytics.node_analytics(rows_of(spark, sf), n=500)


@query("timeseries_long", with_sql(ROWS, select="""
    SELECT (SELECT count(*) FROM r WHERE start_time >= TIMESTAMP '1992-01-01' AND start_time <= """ + oracle.AS_OF + """) AS in_range,
      (SELECT count(*) FROM r WHERE start_time >= TIMESTAMP '1992-01-01' AND start_time <= """ + oracle.AS_OF + """) AS in_buckets"""))  # fmt: skip
def _(spark, sf):
    rows, start = rows_of(spark, sf), datetime(1992, 1, 1)
    placed = analytics.timeseries(rows, start=start, end=AS_OF, as_of=AS_OF).agg(F.sum("trace_count").alias("in_buckets"))
    total = analytics.timeseries_total(rows, analytics.resolve_window(start=start, end=AS_OF, as_of=AS_OF))
    return placed.select(F.lit(total).cast("bigint").alias("in_range"), "in_buckets")


@query("node_analytics_all", _nodes_sql("SELECT id FROM r"))
def _(spark, sf):
    return analytics.node_analytics(rows_of(spark, sf), n=None)


@query("node_analytics_window", _nodes_sql(f"SELECT id FROM r WHERE start_time >= {oracle.AS_OF} - INTERVAL 30 DAY AND environment = 'staging' "))
def _(spark, sf):
    return analytics.node_analytics(rows_of(spark, sf), "30d", environment="staging", as_of=AS_OF)


@query("node_analytics_stored", _each_period(_nodes_sql(f"SELECT id FROM r WHERE start_time >= {oracle.AS_OF} - INTERVAL 30 DAY"), "month", "year"))
def _(spark, sf):
    return _over_periods(spark, sf, lambda rows: analytics.node_analytics(rows, "30d", as_of=AS_OF), "month", "year")


@query("distinct_nodes", with_sql(SPANS, select="SELECT trace_id, count(DISTINCT name) AS nodes FROM s WHERE span_type = 'node' GROUP BY ALL"))
def _(spark, sf):
    return metrics.node_counts(src.spans(spark, sf)).groupBy("trace_id").agg(F.count("*").alias("nodes"))


# --- pages, limits, order -------------------------------------------------------------------------


@query("count_traces", with_sql(ROWS, select="SELECT count(*) AS n FROM r WHERE status = 'failed' AND project = 'proj_3'"))
def _(spark, sf):
    n = listing.count_traces(rows_of(spark, sf), status="failed", project="proj_3")
    return spark.range(1).select(F.lit(n).cast("bigint").alias("n"))


@query("with_full_count", with_sql(TRACES, select="SELECT id, count(*) OVER () AS total_count FROM t"))
def _(spark, sf):
    return listing.with_full_count(src.traces(spark, sf)).select("id", "total_count")


@query("list_traces", with_sql(ROWS, select=f"""
    SELECT {SUMMARY}, (SELECT count(*) FROM r WHERE status = 'failed') AS total_count FROM
    (SELECT * FROM r WHERE status = 'failed' ORDER BY r.start_time DESC, r.id LIMIT 50 OFFSET 100)"""))  # fmt: skip
def _(spark, sf):
    page, total = listing.list_traces(rows_of(spark, sf), 50, 100, status="failed")
    return page.withColumn("total_count", F.lit(total).cast("bigint"))


@query("deep_page", with_sql(ROWS, select=f"""
    SELECT {SUMMARY}, (SELECT count(*) FROM r) AS total_count FROM (SELECT * FROM r ORDER BY r.start_time DESC, r.id LIMIT 500 OFFSET 1200)"""))  # fmt: skip
def _(spark, sf):
    path = scratch_path(spark, "deep-pages")
    store.write_trace_rows(rows_of(spark, sf), path, period="month")
    page, total = listing.list_traces(store.read_trace_rows(spark, path), 500, 1200)
    return page.withColumn("total_count", F.lit(total).cast("bigint"))


@query("cursor_pages", with_sql(ROWS, select=f"""
    SELECT {SUMMARY}, (row_number() OVER (ORDER BY r.start_time DESC, r.id) - 1) // 200 AS page FROM r WHERE status = 'failed' ORDER BY r.start_time DESC, r.id LIMIT 600"""))  # fmt: skip
def _(spark, sf):
    path = scratch_path(spark, "cursor-pages")
    store.write_trace_rows(rows_of(spark, sf), path, period="month")
    rows, after, pages = store.read_trace_rows(spark, path), None, []
    for number in range(3):
        page, after = listing.page_after(rows, after, 200, status="failed")
        pages.append(page.withColumn("page", F.lit(number).cast("bigint")))
        if after is None:
            break
    return reduce(DataFrame.unionByName, pages)


@query("page_bounds", with_sql(ROWS, select=f"""
    SELECT {SUMMARY}, (row_number() OVER (ORDER BY r.start_time DESC, r.id) - 1) // 40 + 1 AS page FROM r WHERE environment = 'staging' ORDER BY r.start_time DESC, r.id LIMIT 120"""))  # fmt: skip
def _(spark, sf):
    """Pages by number."""
    rows = rows_of(spark, sf)
    pages = [listing.list_traces(rows, *listing.page_bounds(40, page=n), environment="staging")[0].withColumn("page", F.lit(n).cast("bigint")) for n in (1, 2, 3)]
    return reduce(DataFrame.unionByName, pages)


_WINDOWS = [("15m", 900, 15, 60), ("1h", 3600, 12, 300), ("24h", 86400, 24, 3600), ("7d", 604800, 14, 43200), ("30d", 2592000, 30, 86400), ("often", 86400, 24, 3600)]


@query("resolve_window", with_sql(TRACES, select=f"""
    SELECT w.token, w.buckets, w.width, count(t.id) AS n FROM (VALUES {", ".join(map(str, _WINDOWS))}) w(token, seconds, buckets, width)
    LEFT JOIN t ON t.start_time >= {oracle.AS_OF} - to_seconds(CAST(seconds AS BIGINT)) AND t.start_time <= {oracle.AS_OF} GROUP BY ALL"""))  # fmt: skip
def _(spark, sf):
    """Grid of every window token, and how many traces its range holds."""
    found = src.traces(spark, sf)
    parts = []
    for token, *_ in _WINDOWS:
        grid = analytics.resolve_window(token, as_of=AS_OF)
        n = analytics.in_grid(found, grid, None, None).agg(F.count("*").alias("n"))
        parts.append(n.select(F.lit(token).alias("token"), F.lit(grid.buckets).alias("buckets"), F.lit(grid.width).alias("width"), "n"))
    return reduce(DataFrame.unionByName, parts)


@query("recent", with_sql(TRACES, select="SELECT id FROM t ORDER BY start_time DESC, id LIMIT 500"))
def _(spark, sf):
    return listing.recent(src.traces(spark, sf), 500).select("id")


@query("dashboard", with_sql(ROWS, select=f"""
    SELECT k.*, p.page_ids, CAST(f.n AS BIGINT) AS total_count, 60 < f.n AS has_more,
      (SELECT string_agg(node_name || '=' || n, '|' ORDER BY node_name) FROM (SELECT node_name, CAST(sum(executions) AS BIGINT) AS n FROM nc GROUP BY ALL)) AS nodes FROM (SELECT {_KPI}, {_P95} AS p95_duration_ms FROM r) k,
    (SELECT string_agg(id, '|' ORDER BY start_time DESC, id) AS page_ids FROM
      (SELECT id, start_time FROM r WHERE environment = 'staging' ORDER BY start_time DESC, id LIMIT 20 OFFSET 40)) p,
    (SELECT count(*) AS n FROM r WHERE environment = 'staging') f"""))  # fmt: skip
def _(spark, sf):
    return _board(rows_of(spark, sf))


def _board(rows: DataFrame) -> DataFrame:
    board = dashboard.dashboard(rows, limit=20, page=3, environment="staging")
    ordered = F.reverse(F.array_sort(F.collect_list(F.struct(F.unix_micros("start_time"), (-F.col("id").cast("bigint")).alias("k"), "id"))))
    # At most one page of ids; ids of the sample are numbers, but ties are ordered as text.
    page = board.page.agg(ordered.alias("page")).select(F.transform("page", lambda p: p["id"]).alias("page_ids"), F.lit(1).alias("k"))
    runs = F.transform(F.array_sort(F.collect_list(F.struct("node_name", "executions"))), lambda r: F.concat_ws("=", r["node_name"], r["executions"].cast("string")))
    nodes = board.nodes.agg(runs.alias("nodes")).withColumn("k", F.lit(1))  # one entry per node name
    stats = board.stats.withColumn("k", F.lit(1))
    return stats.join(page, "k").join(nodes, "k").drop("k").withColumns(
        {"total_count": F.lit(board.total_count).cast("bigint"), "has_more": F.lit(board.has_more)}
    )


@query("dashboard_stored", f"{SQL['dashboard']}")
def _(spark, sf):
    return _board(_stored(spark, rows_of(spark, sf), "month"))


@query("rank_nodes", "SELECT node_name, frequency_pct FROM (" + _nodes_sql("SELECT id FROM r") + ") ORDER BY frequency_pct DESC, node_name LIMIT 3")
def _(spark, sf):
    return analytics.node_analytics(rows_of(spark, sf), n=None).limit(3).select("node_name", "frequency_pct")


@query("cap_spans", with_sql(SPANS, select="""
    SELECT trace_id, count(*) FILTER (WHERE pos < 5) AS kept, CAST(least(count(*), 5) AS BIGINT) AS kept_spans_count, CAST(greatest(count(*) - 5, 0) AS BIGINT) AS dropped_spans_count,
           count(*) > 5 AS spans_truncated FROM s GROUP BY ALL"""))  # fmt: skip
def _(spark, sf):
    kept, report = spans.cap_spans(src.spans(spark, sf), 5)
    return kept.groupBy("trace_id").agg(F.count("*").alias("kept")).join(report, "trace_id")


@query("span_order", with_sql(SPANS, select="SELECT trace_id, id, pos FROM s"))
def _(spark, sf):
    return spans.span_order(src.timed_spans(spark, sf).drop("pos")).select("trace_id", "id", "pos")


_VERDICTS = """
    WITH RECURSIVE q AS (SELECT CAST(event_id AS VARCHAR) AS request_id, CAST(user_id AS VARCHAR) AS client, epoch_us(ts) // 500 AS us,
      row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 500, CAST(event_id AS VARCHAR)) AS k FROM events),
    w AS (SELECT request_id, client, us, k, [us] AS accepted, FALSE AS rejected FROM q WHERE k = 1
      UNION ALL
      SELECT request_id, client, us, k, CASE WHEN len(f) < 3 THEN list_append(f, us) ELSE f END, len(f) >= 3
      FROM (SELECT q.*, list_filter(w.accepted, lambda x: x > q.us - 60000000) AS f FROM w JOIN q ON q.client = w.client AND q.k = w.k + 1))
    SELECT request_id, client, strftime(make_timestamp(us), '%Y-%m-%d %H:%M:%S.%f') AS ts, rejected FROM w"""


@query("rate_violations", _VERDICTS)
def _(spark, sf):
    return rate.rate_violations(_dense_requests(spark, sf), 3)


def _dense_requests(spark, sf):
    """Requests with the clock running 500 times slower, so that minutes hold several of a client."""
    r = src.requests(spark, sf)
    return r.withColumn("ts", F.timestamp_micros(F.call_function("div", F.unix_micros("ts"), F.lit(500))))


@query("rate_screen_batch", """
    WITH q AS (SELECT CAST(user_id AS VARCHAR) AS client, epoch_us(ts) // 500 AS us FROM events),
    c AS (SELECT a.client, a.us, count(*) AS seen FROM q a JOIN q b ON a.client = b.client AND b.us > a.us - 60000000 AND b.us <= a.us GROUP BY a.client, a.us)
    SELECT DISTINCT client, us // 60000000 AS slot FROM c WHERE seen > 3""")  # fmt: skip
def _(spark, sf):
    return rate.busy_minutes(_dense_requests(spark, sf), 3).select("client", "slot")


# --- scalar functions -----------------------------------------------------------------------------


@query("strip_prefix", with_sql(SPANS, select="SELECT id, replace(replace(name, 'LLM: ', ''), 'Chat: ', '') AS model_name, trim(replace(name, 'Tool: ', '')) AS tool_name FROM s"))
def _(spark, sf):
    return src.spans(spark, sf).selectExpr(
        "id", f"{text.strip_call_prefix('name')} as model_name", f"{text.strip_tool_prefix('name')} as tool_name"
    )


@query("resolve_span_model", with_sql(SPANS, select="""
    SELECT id, CASE WHEN pos % 3 = 0 THEN 'u' WHEN pos % 3 = 1 THEN 'm' ELSE raw_model END AS model FROM s WHERE span_type = 'llm'"""))  # fmt: skip
def _(spark, sf):
    calls = src.spans(spark, sf).filter("span_type = 'llm'")
    calls = calls.selectExpr("id", "name", "case pos % 3 when 0 then 'u' when 1 then '' end as u", "if(pos % 3 <> 2, 'm', '') as m")
    return calls.selectExpr("id", f"{models.span_model('u', 'm', 'name')} as model")


@query("normalize_model_name", f"SELECT DISTINCT model, {oracle.normal('model')} AS normal FROM ({_PART_MODELS})")
def _(spark, sf):
    return _model_names(spark, sf).distinct().selectExpr("model", f"{models.normal_name('model')} as normal")


_CALL_COLUMNS = "is_estimated, " + ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in ("prompt_cost", "completion_cost", "total_cost"))


@query("call_cost", with_sql(CALLS, select=f"SELECT id, {_CALL_COLUMNS} FROM calls"))
def _(spark, sf):
    calls = src.spans(spark, sf).filter("span_type = 'llm'").select(
        "id", F.expr(text.strip_call_prefix("name")).alias("model"), "usage.prompt_tokens", "usage.completion_tokens", "usage.cached_tokens"
    )
    return pricing.call_cost(calls).select("id", "is_estimated", "prompt_cost", "completion_cost", "total_cost")


@query("usage_of", with_sql(CALLS, select=f"SELECT id, model, prompt AS prompt_tokens, completion AS completion_tokens, total AS total_tokens, cached AS cached_tokens, {_CALL_COLUMNS} FROM calls"))
def _(spark, sf):
    return pricing.price_spans(src.spans(spark, sf)).select("id", "call.*")


@query("normalize_usage", with_sql(SPANS, select="""
    SELECT id, CASE WHEN l_suppkey % 2 = 1 THEN prompt + completion ELSE 0 END AS total_tokens, prompt AS prompt_tokens, completion AS completion_tokens
    FROM s WHERE span_type = 'llm' AND status = 'completed'"""))  # fmt: skip
def _(spark, sf):
    ends = src.span_events(spark, sf).filter("phase = 'end' and kind in ('llm', 'chat')")
    usage = capture.normalize_usage("llm_output", "outputs")
    return ends.selectExpr("run_id as id", f"{usage} as u").select("id", "u.*")


@query("resolve_model_name", with_sql(SPANS, select="""
    SELECT id, CASE pos % 5 WHEN 0 THEN 'out' WHEN 1 THEN 'par' WHEN 2 THEN 'met' WHEN 3 THEN 'ser' ELSE 'def' END AS model FROM s"""))  # fmt: skip
def _(spark, sf):
    def at(n: int, value: str) -> str:
        return f"if(pos % 5 <= {n}, '{value}', null)"

    name = models.resolve_model_name(
        at(0, '{"model":"out"}'), at(1, '{"model_name":"","model":"par"}'), at(2, '{"ls_model_name":"met","model":"x"}'),
        at(3, '{"name":"ser"}'), "'def'",
    )
    return src.spans(spark, sf).selectExpr("id", f"{name} as model")


@query("duration_ms", "SELECT l_orderkey, l_linenumber, l_partkey, CAST(epoch_us(l_shipdate - o_orderdate) AS DOUBLE) / 1000 AS ms FROM lineitem JOIN orders ON o_orderkey = l_orderkey")
def _(spark, sf):
    o, li = src.table(spark, sf, "orders"), src.table(spark, sf, "lineitem")
    start, end = F.col("o_orderdate").cast("timestamp"), F.col("l_shipdate").cast("timestamp")
    return li.join(o, li.l_orderkey == o.o_orderkey).select("l_orderkey", "l_linenumber", "l_partkey", numbers.duration_ms(start, end).alias("ms"))


@query("parse_iso", f"SELECT event_id, CASE WHEN event_id % 4 < 3 THEN {time('ts')} END AS at FROM events")
def _(spark, sf):
    """Whole instants, to the microsecond, written with a Z, with an offset and with neither, and text that is no time."""
    iso = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    key = F.col("event_id") % 4
    written = F.when(key == 0, F.concat(iso, F.lit("Z"))).when(key == 1, F.concat(iso, F.lit("+00:00"))).when(key == 2, iso).otherwise("soon")
    return src.table(spark, sf, "events").select("event_id", numbers.parse_iso(written).alias("at"))


@query("bucket_label", "SELECT event_id, strftime(ts, '%H:%M') AS label FROM events")
def _(spark, sf):
    return src.table(spark, sf, "events").select("event_id", numbers.bucket_label(F.col("ts")).alias("label"))


@query("pct", f"SELECT user_id, {pct('count(*) FILTER (WHERE event_type = $$error$$)', 'count(*)')} AS error_rate, {pct('count(*)', '0')} AS nothing FROM events GROUP BY ALL")
def _(spark, sf):
    g = src.table(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("e"))
    return g.select("user_id", numbers.pct(F.col("e"), F.col("n")).alias("error_rate"), numbers.pct(F.col("n"), F.lit(0)).alias("nothing"))


@query("mask_text", f"SELECT doc_id, {oracle.masked('text')} AS text FROM documents")
def _(spark, sf):
    return privacy.redact_texts(src.table(spark, sf, "documents").select("doc_id", "text"), ["text"])


_DEEP = "repeat('[', 5000) || '{0}x {1}{0}' || repeat(']', 5000)"


@query("mask_documents_nested", with_sql(TRACES, SPANS, select=r"""
    SELECT s.trace_id, s.pos, '{"password":"[REDACTED]","m":"to [EMAIL_REDACTED]","n":' || s.pos || '.50}' AS inputs,
      md5(CASE CAST(s.trace_id AS BIGINT) % 5 WHEN 0 THEN '{"text":"no [SSN_REDACTED]"}' WHEN 1 THEN """ + _DEEP.format('"', "[EMAIL_REDACTED]") + r"""
        WHEN 2 THEN '"{\"mail\": \"[EMAIL_REDACTED]\", \"password\":\"[REDACTED]\""' WHEN 3 THEN '"{\"api_key\":\"[REDACTED]\", \"b\": [1.10"'
        ELSE repeat('{"n":', 3000) || '{"password":"[REDACTED]","x":12345678901234567890123.5}' || repeat('}', 3000) END) AS input FROM s JOIN t ON t.id = s.trace_id"""))  # fmt: skip
def _(spark, sf):
    """Hits in every nested span; inputs that are plain, nested thousands deep, and broken in several ways; numbers as written."""
    docs = src.documents(spark, sf)
    sent = F.transform("spans", lambda s, i: s.withField("inputs", F.concat(F.lit('{"password":"p","m":"to a'), i.cast("string"), F.lit('@b.com","n":'), i.cast("string"), F.lit(".50}"))))
    case = F.col("id").cast("bigint") % 5
    deep = F.expr("""concat(repeat('{"n":', 3000), '{"password":{"inner":["hunter2"]},"x":12345678901234567890123.5}', repeat('}', 3000))""")
    text = F.when(case == 0, F.lit('{"text":"no 123-45-6789"}')).when(case == 1, F.expr(_DEEP.format('"', "a@b.com"))).when(case == 2, F.lit('{"mail": "a@b.com", "password": "p'))
    text = text.when(case == 3, F.lit('{"api_key": ["sk1", {"k": "sk2"}], "b": [1.10')).otherwise(deep)
    masked = privacy.mask_traces(docs.withColumns({"spans": sent, "input": text}))
    return masked.select(F.col("id").alias("trace_id"), F.md5("input").alias("input"), F.posexplode("spans").alias("pos", "s")).select("trace_id", "pos", "input", "s.inputs")


@query("mask_conversations", f"SELECT conv_id, turn, role, {oracle.masked('text')} AS text FROM conversations")
def _(spark, sf):
    return privacy.redact_texts(src.table(spark, sf, "conversations").select("conv_id", "turn", "role", "text"), ["text"])


@query("pii_report", f"SELECT doc_id, {oracle.find_counts('text')} FROM documents")
def _(spark, sf):
    return privacy.pii_report(src.table(spark, sf, "documents"), "text").drop("text", "lang", "source", "n_chars")


@query("is_sensitive_key", "SELECT doc_id, source || '.' || lang AS key, FALSE AS plain, TRUE AS secret FROM documents")
def _(spark, sf):
    key = F.concat_ws(".", "source", "lang")
    return src.table(spark, sf, "documents").select(
        "doc_id", key.alias("key"), text.is_sensitive_key(key).alias("plain"),
        text.is_sensitive_key(F.concat(F.lit(" My-TOKEN."), key)).alias("secret"),
    )


@query("mask_document", """SELECT doc_id, '{"n":{"api_key":"[REDACTED]","t":' || CAST(to_json(""" + oracle.masked("text") + """) AS VARCHAR) || '}}' AS doc FROM documents""")
def _(spark, sf):
    doc = F.to_json(F.struct(F.struct(F.col("lang").alias("api_key"), F.col("text").alias("t")).alias("n")))
    return src.table(spark, sf, "documents").select("doc_id", docs.mask_document(doc).alias("doc"))


@query("mask_own_rules", """SELECT doc_id, '{"lang":"[REDACTED]","t":' || CAST(to_json(regexp_replace(""" + oracle.masked("(text || ' ward 17-' || doc_id)") + """, 'ward 17-[0-9]+', '[WARD]', 'g')) AS VARCHAR) || '}' AS doc FROM documents""")
def _(spark, sf):
    """A rule and a key of one's own beside the standard ones."""
    doc = F.to_json(F.struct("lang", F.concat("text", F.lit(" ward 17-"), F.col("doc_id").cast("string")).alias("t")))
    return src.table(spark, sf, "documents").select("doc_id", docs.mask_document(doc, [(r"ward 17-[0-9]+", "[WARD]")], ["LANG"]).alias("doc"))


@query("truncate_text", "SELECT doc_id, CASE WHEN length(text) > 10000 THEN left(text, 10000) || '... <Truncated: ' || CAST(length(text) - 10000 AS VARCHAR) || ' chars omitted>' ELSE text END AS text FROM documents")
def _(spark, sf):
    return src.table(spark, sf, "documents").select("doc_id", text.truncate_text(F.col("text")).alias("text"))


@query("truncate_list", """SELECT doc_id, len(string_split(text, ' ')) AS words, CASE WHEN len(string_split(text, ' ')) > 100
    THEN array_to_string(string_split(text, ' ')[1:100], ' ') || ' <Truncated: ' || CAST(len(string_split(text, ' ')) - 100 AS VARCHAR) || ' items omitted for trace efficiency>'
    ELSE text END AS kept FROM documents""")  # fmt: skip
def _(spark, sf):
    words = F.split("text", " ", -1)
    kept = F.array_join(text.truncate_list(words), " ")
    return src.table(spark, sf, "documents").select("doc_id", F.size(words).alias("words"), kept.alias("kept"))


_SHORT = "CASE WHEN length({0}) > 10000 THEN left({0}, 10000) || '... <Truncated: ' || CAST(length({0}) - 10000 AS VARCHAR) || ' chars omitted>' ELSE {0} END"
_WORDS = "list_transform(string_split(text, ' ')[1:100], lambda w: " + _SHORT.format("w") + ")"


@query("truncate_document", f"""SELECT doc_id, '{{"text":' || CAST(to_json({_SHORT.format('text')}) AS VARCHAR) || ',"words":' || CAST(to_json(
    CASE WHEN len(string_split(text, ' ')) > 100 THEN list_append({_WORDS}, '<Truncated: ' || CAST(len(string_split(text, ' ')) - 100 AS VARCHAR)
    || ' items omitted for trace efficiency>') ELSE {_WORDS} END) AS VARCHAR) || '}}' AS doc FROM documents""")  # fmt: skip
def _(spark, sf):
    doc = F.to_json(F.struct(F.split("text", " ", -1).alias("words"), F.col("text").alias("text")))
    return src.table(spark, sf, "documents").select("doc_id", docs.truncate_document(doc).alias("doc"))


@query("mask_spans", with_sql(SPANS, select="""
    SELECT id, '{"to":"[EMAIL_REDACTED]","session_token":"[REDACTED]","k":[' || pos || ',"[SSN_REDACTED]"]}' AS inputs, outputs FROM s"""))
def _(spark, sf):
    sent = F.concat(F.lit('{"to":"x'), F.col("pos").cast("string"), F.lit('@b.com","session_token":{"a":1},"k":['), F.col("pos").cast("string"), F.lit(',"123-45-6789"]}'))
    return privacy.mask_spans(src.spans(spark, sf).withColumn("inputs", sent)).select("id", "inputs", "outputs")


@query("mask_traces", with_sql(TRACES, select="SELECT id, error, '{\"session\":\"[REDACTED]\"}' AS metadata FROM t"))
def _(spark, sf):
    t = src.traces(spark, sf).withColumn("metadata", F.to_json(F.struct(F.col("name").alias("session"))))
    return privacy.mask_traces(t).select("id", "error", "metadata")


@query("redact_map", "SELECT doc_id, 'body=' || " + oracle.masked("text") + " || ',session_id=[REDACTED]' AS fields FROM documents")
def _(spark, sf):
    d = src.table(spark, sf, "documents").select("doc_id", F.create_map(F.lit("body"), "text", F.lit("session_id"), "source").alias("fields"))
    return privacy.redact_map(d, "fields")


_DIFF = with_sql(SPANS, select="""
    SELECT trace_id, id AS span_id, CASE l_suppkey % 4 WHEN 1 THEN 'a' WHEN 2 THEN 'items' ELSE 'b' END AS key,
           CASE l_suppkey % 4 WHEN 1 THEN 'modified' WHEN 2 THEN 'appended' ELSE 'added' END AS action,
           CASE WHEN l_suppkey % 4 = 1 THEN CAST(q AS VARCHAR) END AS old,
           CASE l_suppkey % 4 WHEN 1 THEN CAST(q + 1 AS VARCHAR) WHEN 3 THEN '1' END AS new,
           CASE WHEN l_suppkey % 4 = 2 THEN CAST(1 AS BIGINT) END AS appended_count, CASE WHEN l_suppkey % 4 = 2 THEN '[2]' END AS items
    FROM s WHERE span_type = 'node' AND l_suppkey % 4 <> 0""")


@query("state_diff", _DIFF)
def _(spark, sf):
    return diff.state_diff(src.spans(spark, sf))


@query("state_diff_masked", _DIFF)
def _(spark, sf):
    """Every node's mail address changes; masked, the old and the new one are the same."""
    mailed = {n: F.expr(f"""concat(left({n}, length({n}) - 1), ',"mail":"{n}@b.co"}}')""") for n in ("inputs", "outputs")}
    return diff.state_diff(src.spans(spark, sf).withColumns(mailed), mask=True)


@query("canonical_json", "SELECT event_id, '{\"a\":' || CAST(event_id AS VARCHAR) || ',\"b\":' || replace(props, ' ', '') || '}' AS doc FROM events")
def _(spark, sf):
    written = F.concat(F.lit('{ "b" : '), F.col("props"), F.lit(', "a": '), F.col("event_id").cast("string"), F.lit("}"))
    return src.table(spark, sf, "events").select("event_id", written.alias("w")).selectExpr("event_id", f"{docs.canonical_json('w')} as doc")


@query("json_counts", "SELECT user_id, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS k FROM events WHERE event_id % 10 <> 0 GROUP BY ALL")
def _(spark, sf):
    written = F.when(F.col("event_id") % 10 == 0, "{broken").otherwise(F.col("props"))
    e = src.table(spark, sf, "events").select("user_id", F.explode(docs.json_counts(written)).alias("key", "n"))
    return e.groupBy("user_id").agg(F.sum("n").alias("k"))


@query("flatten_messages", "SELECT conv_id, turn, role AS type, text AS content, CASE WHEN role = 'user' THEN 'u' END AS name FROM conversations")
def _(spark, sf):
    message = F.struct(
        F.col("role").alias("type"), F.col("text").alias("content"), F.when(F.col("role") == "user", "u").otherwise("").alias("name"),
        F.lit("[]").alias("tool_calls"), F.lit("{}").alias("additional_kwargs"), F.lit(None).cast("string").alias("response_metadata"),
    )
    c = src.table(spark, sf, "conversations").select("conv_id", "turn", F.array(F.array(message)).alias("messages"))
    flat = c.select("conv_id", "turn", F.explode(capture.flatten_messages(F.col("messages"))).alias("m"))
    return flat.select("conv_id", "turn", "m.type", "m.content", "m.name")


# --- capture --------------------------------------------------------------------------------------

_NAMED = SPANS + """
, named AS (
  WITH RECURSIVE w AS (
    SELECT trace_id, id, seq, span_type, name, name AS final_name, FALSE AS exec FROM s WHERE seq = 1
    UNION ALL
    SELECT s.trace_id, s.id, s.seq, s.span_type, s.name, CASE WHEN s.span_type = 'node' AND w.final_name = s.name THEN s.name || ':exec' ELSE s.name END,
           s.span_type = 'node' AND w.final_name = s.name FROM s JOIN w ON w.trace_id = s.trace_id AND w.id = s.parent_id
  ) SELECT * FROM w
)"""


@query("classify_runs", "WITH " + _NAMED + """
    SELECT s.trace_id, s.id AS run_id, s.parent_id, CASE WHEN exec THEN 'custom' ELSE s.span_type END AS span_type, final_name AS span_name
    FROM named JOIN s ON s.id = named.id WHERE s.span_type IN ('workflow', 'node')""")  # fmt: skip
def _(spark, sf):
    return capture.classify_runs(src.span_events(spark, sf))


@query("name_calls", with_sql(SPANS, select="SELECT trace_id, id AS run_id, name AS span_name FROM s WHERE span_type IN ('llm', 'tool')"))
def _(spark, sf):
    return capture.name_calls(src.span_events(spark, sf))


_UNCACHED = ("CASE WHEN l_discount >= 0.05 THEN CAST(l_quantity * 100 AS BIGINT) // 2 ELSE 0 END AS cached", "0 AS cached")
_ENDS = CALLS[len(SPANS):] + """, ends AS (
  SELECT calls.*, CASE WHEN l_suppkey % 2 = 1 THEN calls.prompt + calls.completion ELSE 0 END AS event_total
  FROM calls JOIN s USING (id) WHERE s.status = 'completed')"""


@query("price_llm_events", "WITH " + SPANS.replace(*_UNCACHED) + _ENDS + """
    SELECT trace_id, id AS run_id, model, event_total AS total_tokens, prompt AS prompt_tokens, completion AS completion_tokens,
           CAST(prompt_cost AS DOUBLE) AS prompt_cost, CAST(completion_cost AS DOUBLE) AS completion_cost, CAST(total_cost AS DOUBLE) AS total_cost FROM ends""")  # fmt: skip
def _(spark, sf):
    return capture.price_llm_events(src.span_events(spark, sf))


@query("error_records", with_sql(SPANS, select="""
    SELECT trace_id, id AS run_id, 'failed' AS status, '{"message":"bad value","traceback":"line 1","type":"ValueError"}' AS error FROM s WHERE status = 'failed'"""))  # fmt: skip
def _(spark, sf):
    return capture.error_records(src.span_events(spark, sf))


_ASSEMBLED = "WITH " + _NAMED.replace(*_UNCACHED) + _ENDS + """
    SELECT s.trace_id, s.id, s.parent_id, named.final_name AS name, CASE WHEN exec OR s.span_type = 'eval' THEN 'custom' ELSE s.span_type END AS span_type,
           s.status, CAST((2000 - 2 * s.pos) * 1000 AS DOUBLE) AS duration_ms, CAST(ends.total_cost AS DOUBLE) AS total_cost
    FROM s JOIN named ON named.id = s.id LEFT JOIN ends ON ends.id = s.id"""


@query("assemble_spans", _ASSEMBLED)
def _(spark, sf):
    whole = capture.assemble_spans(src.span_events(spark, sf))
    return whole.select("trace_id", "id", "parent_id", "name", "span_type", "status", "duration_ms", "total_cost")


@query("rows_of_events", with_sql(TRACES, "asm AS (" + _ASSEMBLED + ")", """
    g AS (SELECT trace_id, count(*) AS n, count(total_cost) AS priced, CAST(sum(CAST(total_cost AS DECIMAL(18,6))) AS DOUBLE) AS cost, bool_or(status = 'failed') AS bad,
            bool_or(span_type = 'workflow' AND status = 'failed') AS broken FROM asm GROUP BY ALL)""", select="""
    SELECT t.id, coalesce(n, 0) AS total_spans, coalesce(cost, 0.0) AS estimated_cost, coalesce(bad, FALSE) OR t.error IS NOT NULL AS has_error,
      CASE WHEN t.status <> 'running' AND o_orderkey % 10 = 0 THEN 'failed' WHEN t.status = 'completed' AND bad THEN 'failed' ELSE t.status END AS status
    FROM t LEFT JOIN g ON g.trace_id = t.id"""))  # fmt: skip
def _(spark, sf):
    rows = capture.rows_of_events(src.trace_events(spark, sf), src.span_events(spark, sf))
    return rows.select("id", "total_spans", F.col("estimated_cost").cast("double").alias("estimated_cost"), "has_error", "status")


@query("custom_spans", with_sql(SPANS, select="SELECT trace_id, id, name, 'custom' AS span_type, status FROM s WHERE span_type = 'eval'"))
def _(spark, sf):
    return capture.custom_spans(src.span_events(spark, sf)).select("trace_id", "id", "name", "span_type", "status")


@query("trace_io", with_sql(SPANS, select="""
    SELECT trace_id, '{}' AS input, CASE WHEN status = 'completed' THEN '{}' END AS output,
           CASE WHEN status = 'failed' THEN '{"message":"bad value","traceback":"line 1","type":"ValueError"}' END AS error FROM s WHERE span_type = 'workflow'"""))  # fmt: skip
def _(spark, sf):
    return capture.trace_io(capture.assemble_spans(src.span_events(spark, sf)))


_UPDATES = with_sql(SPANS, "u AS (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY pos DESC) AS n FROM s WHERE span_type = 'node' AND status = 'completed')",
                    select="SELECT trace_id, n, name AS node, outputs AS update FROM u WHERE n <= 2")


@query("node_state_updates", _UPDATES)
def _(spark, sf):
    kept, _ = capture.node_state_updates(src.span_events(spark, sf), 2)
    return kept.select("trace_id", "n", "node", "update")


@query("assemble_traces", with_sql(TRACES, select=f"""
    SELECT id, name, CASE WHEN status <> 'running' AND o_orderkey % 10 = 0 THEN 'failed' ELSE status END AS status, {time('start_time')} AS start_time, {time('end_time')} AS end_time,
           CASE WHEN status <> 'running' THEN 1000.0::DOUBLE END AS duration_ms,
           CASE WHEN status = 'running' THEN NULL WHEN o_orderkey % 5 = 0 THEN '{{"n":2}}' ELSE '{{"n":1}}' END AS output, error FROM t"""))  # fmt: skip
def _(spark, sf):
    return capture.assemble_traces(src.trace_events(spark, sf))


@query("topology_nodes", with_sql(TRACES, """x AS (SELECT id, CAST(o_custkey % 6 % 4 AS BIGINT) AS last FROM t)""", select="""
    SELECT id AS trace_id, i AS pos, CASE WHEN i = 0 THEN '__start__' WHEN i = last + 2 THEN '__end__' ELSE 'node_' || CAST(i - 1 AS VARCHAR) END AS id
    FROM (SELECT id, last, unnest(range(0, last + 3)) AS i FROM x)"""))  # fmt: skip
def _(spark, sf):
    t = src.traces(spark, sf).withColumn("graph_topology", src.topology())
    return spans.topology_nodes(t).select("trace_id", "pos", "id")


@query("topology_edges", with_sql(TRACES, """x AS (SELECT id, CAST(o_custkey % 6 % 4 AS BIGINT) AS last FROM t)""", select="""
    SELECT id AS trace_id, i AS pos, 'node_' || CAST(i AS VARCHAR) AS source, CASE WHEN i = last THEN '__end__' ELSE 'node_' || CAST(i + 1 AS VARCHAR) END AS target,
           i = last AS conditional, CASE WHEN i = last THEN 'done' END AS label FROM (SELECT id, last, unnest(range(0, last + 1)) AS i FROM x)"""))  # fmt: skip
def _(spark, sf):
    t = src.traces(spark, sf).withColumn("graph_topology", src.topology())
    return spans.topology_edges(t)


@query("tag_traces", with_sql(TRACES, select="""
    SELECT id, CASE WHEN o_orderkey % 2 = 0 THEN 'POST ' || http_path ELSE name END AS name, coalesce(environment, 'production') AS environment, coalesce(project, '') AS project FROM t"""))  # fmt: skip
def _(spark, sf):
    unnamed = src.traces(spark, sf).withColumn("name", F.when(F.col("id").cast("bigint") % 2 != 0, F.col("name")))
    return listing.tag_traces(unnamed).select("id", "name", "environment", F.coalesce("project", F.lit("")).alias("project"))


@query("append_evals", with_sql(TRACES, """
    e AS (SELECT CAST(doc_id AS VARCHAR) AS id, quality, toxic FROM labels)""", select="""
    SELECT t.id, CASE WHEN e.id IS NULL THEN 0 ELSE 1 END AS eval_count, CASE WHEN toxic = 0 THEN 'passed' WHEN toxic = 1 THEN 'failed' END AS eval_status,
           CASE WHEN toxic = 0 THEN 'completed' WHEN toxic = 1 THEN 'failed' END AS span_status FROM t LEFT JOIN e USING (id)"""))  # fmt: skip
def _(spark, sf):
    labels = src.table(spark, sf, "labels").select(
        F.col("doc_id").cast("string").alias("trace_id"), F.lit("quality").alias("name"), F.col("quality").cast("double").alias("score"),
        (F.col("toxic") == 0).alias("passed"), F.lit(None).cast("string").alias("reason"), F.lit(AS_OF).cast("timestamp").alias("timestamp"),
    )
    t, eval_spans = evals.append_evals(src.traces(spark, sf), labels)
    verdicts = evals.eval_rollup(t, eval_spans)
    status = eval_spans.select(F.col("trace_id").alias("id"), F.col("status").alias("span_status"))
    return verdicts.join(status, "id", "left")


@query("merge_metadata", with_sql(TRACES, select="""
    SELECT t.id, CASE WHEN n IS NULL THEN '{}' ELSE '{"last":' || CAST(n AS VARCHAR) || ',"seen":true}' END AS metadata
    FROM t LEFT JOIN (SELECT CAST(l_orderkey AS VARCHAR) AS id, max(l_linenumber) AS n FROM lineitem GROUP BY ALL) USING (id)"""))  # fmt: skip
def _(spark, sf):
    updates = src.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("trace_id"), F.col("l_linenumber").alias("seq"),
        F.concat(F.lit('{"seen":true,"last":'), F.col("l_linenumber").cast("string"), F.lit("}")).alias("update"),
    )
    return capture.merge_metadata(src.traces(spark, sf), updates).select("id", "metadata")


# --- streams --------------------------------------------------------------------------------------


def _event_files(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """One sample table as a stream of files."""
    schema = src.table(spark, sf, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf)


def _run_into(stream: DataFrame, spark: SparkSession, label: str, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there now and return what it wrote."""
    path = scratch_path(spark, label)
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True)
    if mode == "append":
        writer.format("parquet").start(f"{path}/out").awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{path}/out")

    def put(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/out/batch={batch_id}")

    writer.foreachBatch(put).start().awaitTermination()
    return spark.read.schema(stream.schema).option("recursiveFileLookup", "true").parquet(f"{path}/out")


def _arrive(docs: DataFrame, inbox: str) -> None:
    """Documents as new files of an inbox, packed as such files travel, written by all tasks."""
    trace_source.export_documents(docs).write.mode("append").option("compression", "gzip").text(inbox)
    time_passes(1.1)  # a file's time tells which came later, in some stores only by the second


def _take_in(spark: SparkSession, inbox: str, table: str, checkpoint: str) -> None:
    """One micro-batch with all that has come since the last one."""
    stream = live.trace_stream(spark, inbox, max_files=1_000_000)
    live.stream_ingest(stream, table, checkpoint, period="year").awaitTermination()


@query("stream_ingest", with_sql(ROWS, select=f"SELECT {SUMMARY} FROM r"))
def _(spark, sf):
    inbox, table = scratch_path(spark, "inbox"), scratch_path(spark, "ingested")
    docs = src.documents(spark, sf)
    # Older versions come first, some in larger files than the ones that count; broken lines are mixed in.
    third = F.col("id").cast("bigint") % 3
    older = docs.filter(third != 0).withColumns({"name": F.lit("old"), "status": F.lit("running")})
    _arrive(older.withColumn("input", F.when(third == 1, F.repeat(F.lit("1"), 9000))), inbox)
    broken = src.table(spark, sf, "orders").select(F.lit('{"id": "x", "na').alias("value"))
    broken.write.mode("append").option("compression", "gzip").text(inbox)
    _arrive(docs, inbox)
    _take_in(spark, inbox, table, scratch_path(spark, "checkpoint"))
    versions.delete(spark, inbox)
    return listing.trace_summaries(store.read_trace_rows(spark, table))


def _shuffled_files(spark: SparkSession, rows: DataFrame, label: str, key: str, files: int = 4) -> DataFrame:
    """Rows as a stream of ``files`` micro-batches, dealt by a hash, so that what belongs together comes in any order.

    They are worked out once, and every task writes a file; a micro-batch takes its share of the files.
    """
    path = scratch_path(spark, label)
    each = -(-spark.sparkContext.defaultParallelism // files)
    rows.repartition(files * each, *key.split(", ")).write.parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", each).parquet(path)


def _streamed_spans(spark: SparkSession, sf: str) -> DataFrame:
    """What the stream of spans gives out; the sample's events lie years apart and come in any order."""
    events = _shuffled_files(spark, src.span_events(spark, sf), "span-events", "run_id, phase")
    return _run_into(assembly.stream_spans(events, delay="4000 days"), spark, "spans")


def _ingested(spark: SparkSession, sf: str, label: str) -> str:
    """A table kept by a stream of two micro-batches, the first of which holds old versions of half the documents."""
    inbox, table = scratch_path(spark, f"{label}-inbox"), scratch_path(spark, f"{label}-table")
    docs = src.documents(spark, sf)
    odd = F.col("id").cast("bigint") % 2 == 1
    early = docs.filter(~odd).unionByName(docs.filter(odd).withColumns({"name": F.lit("old"), "spans": F.expr("slice(spans, 1, 0)")}))
    checkpoint = scratch_path(spark, "checkpoint")
    for part in (early, docs.filter(odd)):
        _arrive(part, inbox)
        _take_in(spark, inbox, table, checkpoint)
    versions.delete(spark, inbox)
    return table


@query("get_stored_trace", with_sql(TRACES, SPANS, select=f"""
    SELECT t.id, t.name, t.status, {time('t.start_time')} AS start_time, count(s.id) AS n_spans, string_agg(s.id, '|' ORDER BY s.pos) AS span_ids
    FROM t LEFT JOIN s ON s.trace_id = t.id WHERE t.id IN (SELECT CAST(c_custkey * 3 AS VARCHAR) FROM customer) GROUP BY ALL"""))  # fmt: skip
def _(spark, sf):
    ids = src.table(spark, sf, "customer").select((F.col("c_custkey") * 3).cast("string").alias("id"))
    found = store.get_stored_traces(spark, _ingested(spark, sf, "lookup"), ids)
    listed = F.array_join(F.transform("spans", lambda s: s["id"]), "|")
    return found.select("id", "name", "status", "start_time", F.size("spans").alias("n_spans"), F.nullif(listed, F.lit("")).alias("span_ids"))


@query("export_stored", with_sql(TRACES, SPANS, select="""
    SELECT t.id, t.name, count(s.id) AS n_spans, CAST(sum(CAST(s.duration_ms AS DECIMAL(18,2))) AS DOUBLE) AS spent FROM t LEFT JOIN s ON s.trace_id = t.id GROUP BY ALL"""))  # fmt: skip
def _(spark, sf):
    out = scratch_path(spark, "stored-export")
    store.export_stored(spark, _ingested(spark, sf, "export"), None, out, compression="gzip")
    back = trace_source.apply_defaults(trace_source.split_valid(trace_source.read_traces(spark, out))[0])
    spent = F.aggregate(F.transform("spans", lambda s: s["duration_ms"].cast("decimal(28,2)")), F.lit(0).cast("decimal(28,2)"), lambda a, b: (a + b).cast("decimal(28,2)"))
    return back.select("id", "name", F.size("spans").alias("n_spans"), F.when(F.size("spans") > 0, spent).alias("spent"))


@query("waterfall_stored", "WITH " + SPANS + _TREE + """
    SELECT trace_id, id, pos * 1000.0::DOUBLE AS offset_ms, duration_ms, depth FROM s JOIN tree USING (trace_id, id)""")
def _(spark, sf):
    return store.stored_waterfall(spark, _ingested(spark, sf, "waterfall")).select("trace_id", "id", "offset_ms", "duration_ms", "depth")


@query("erase_from", with_sql(ROWS, select="""
    SELECT 'left' AS what, count(*) AS n, CAST(sum(total_tokens) AS BIGINT) AS tokens FROM r WHERE o_orderkey % 4 <> 0 OR o_orderkey % 3 = 1
    UNION ALL SELECT 'erased', count(*), 0 FROM r WHERE o_orderkey % 4 = 0 AND o_orderkey % 3 <> 1
    UNION ALL SELECT 'erased again', 0, 0 UNION ALL SELECT 'cleared', 0, 0"""))  # fmt: skip
def _(spark, sf):
    """Erase a quarter of the table, put a third of the erased back, and clear a copy."""
    path = scratch_path(spark, "erased")
    rows = rows_of(spark, sf)
    key = F.col("id").cast("bigint")
    store.upsert_into(path, rows, period="year")
    ids = rows.filter(key % 4 == 0).select("id")
    n = store.erase_from(spark, path, ids)
    again = store.erase_from(spark, path, ids)
    back = rows.filter((key % 4 == 0) & (key % 3 == 1))
    store.upsert_into(path, back)
    whole = store.read_trace_rows(spark, path).agg(F.count("*").alias("n"), F.sum("total_tokens").alias("tokens")).first()
    store.clear_table(spark, path)
    cleared = store.read_trace_rows(spark, path).count()
    told = [("left", whole["n"], whole["tokens"]), ("erased", n - back.count(), 0), ("erased again", again, 0), ("cleared", cleared, 0)]
    return spark.createDataFrame(told, "what string, n long, tokens long")


@query("stream_spans", _ASSEMBLED.replace("CAST(ends.total_cost AS DOUBLE) AS total_cost", "CAST(ends.total_cost AS DOUBLE) AS total_cost, s.pos, ends.model AS model"))
def _(spark, sf):
    whole = capture.placed_spans(_streamed_spans(spark, sf)).withColumn("model", F.when(F.col("total_cost").isNotNull(), F.col("model")))
    return whole.select("trace_id", "id", "parent_id", "name", "span_type", "status", "duration_ms", "total_cost", F.col("pos").cast("bigint").alias("pos"), "model")


@query("stream_traces", with_sql(TRACES, SPANS, select=f"""
    SELECT t.id, t.name, CASE WHEN t.status <> 'running' AND o_orderkey % 10 = 0 THEN 'failed' ELSE t.status END AS status, {time('t.start_time')} AS start_time, {time('t.end_time')} AS end_time,
           CASE WHEN t.status <> 'running' THEN 1000.0::DOUBLE END AS duration_ms, CASE WHEN s.id IS NOT NULL THEN '{{}}' END AS input,
           CASE WHEN t.status = 'running' THEN CASE WHEN s.status = 'completed' THEN '{{}}' END WHEN o_orderkey % 5 = 0 THEN '{{"n":2}}' ELSE '{{"n":1}}' END AS output,
           coalesce(error, CASE WHEN s.status = 'failed' THEN '{{"message":"bad value","traceback":"line 1","type":"ValueError"}}' END) AS error
    FROM t LEFT JOIN s ON s.trace_id = t.id AND s.span_type = 'workflow'"""))  # fmt: skip
def _(spark, sf):
    """The stored spans are themselves read as a stream, beside starts and finishes that come in any order."""
    spans_out = _streamed_spans(spark, sf)
    flows = _shuffled_files(spark, spans_out, "stored-spans", "id", 2)
    life = _shuffled_files(spark, src.trace_events(spark, sf), "trace-events", "trace_id, seq", 3)
    stream = assembly.stream_traces(life, flows, delay="4000 days", idle="4000 days")
    return assembly.latest_traces(_run_into(stream, spark, "traces"))


@query("late_documents", with_sql(ROWS, select=f"SELECT {SUMMARY} FROM r"))
def _(spark, sf):
    """Three micro-batches into the table: each brings documents of all times, older versions of some first, so most come late."""
    inbox, table = scratch_path(spark, "late-inbox"), scratch_path(spark, "late-table")
    docs = src.documents(spark, sf)
    part = F.col("id").cast("bigint") % 3
    running = docs.withColumns({"name": F.lit("old"), "status": F.lit("running"), "start_time": F.expr("start_time + interval 90 days")})
    checkpoint = scratch_path(spark, "checkpoint")
    for batch in range(3):
        now = docs.filter(part == batch)
        if batch < 2:  # of those that come finally in the next batch
            now = now.unionByName(running.filter(part == batch + 1))
        _arrive(now, inbox)
        _take_in(spark, inbox, table, checkpoint)
    versions.delete(spark, inbox)
    return listing.trace_summaries(store.read_trace_rows(spark, table))


@query("live_timeseries", f"""
    WITH e AS (SELECT time_bucket(INTERVAL 1 DAY, ts) AS b, CAST(value AS DECIMAL(18,2)) AS d, event_type = 'error' AS err FROM events),
    g AS (SELECT b, count(*) AS n, count(*) FILTER (WHERE err) AS x, {half_up("sum(CAST(d * 100 AS BIGINT))", "count(*) * 100", 2)} AS avg_ms,
                 CAST(quantile_disc(d, 0.95) AS DOUBLE) AS p95 FROM e GROUP BY b)
    SELECT {time('b')} AS bucket_start, n AS trace_count, x AS error_count, {pct('x', 'n')} AS error_rate, avg_ms AS avg_duration_ms,
           greatest(p95, avg_ms) AS p95_duration_ms FROM g""")  # fmt: skip
def _(spark, sf):
    path = scratch_path(spark, "live-figures")
    stream = _event_files(spark, sf, "events").select(
        F.col("ts").cast("timestamp").alias("start_time"), F.col("value").alias("duration_ms"), (F.col("event_type") == "error").alias("has_error")
    )
    series.live_series(stream, path, scratch_path(spark, "checkpoint")).awaitTermination()
    return series.tumbling(series.stored_figures(spark, path), "1 day")


def _live_rows(spark: SparkSession, sf: str) -> str:
    """Figures kept by a stream of trace rows in ten late batches, more than a level holds; some rows come with a wrong
    figure first, which is taken back later."""
    path, inbox = scratch_path(spark, "live-series"), scratch_path(spark, "row-batches")
    rows = rows_of(spark, sf).select("id", "start_time", "status", "has_error", "duration_ms", "estimated_cost", "total_tokens", "environment", "project", "model_counts")
    rows = rows.withColumn("sign", F.lit(1))
    wrong = rows.filter(F.col("id").cast("bigint") % 7 == 3).withColumns({"duration_ms": F.lit(1.25), "total_tokens": F.lit(999).cast("bigint")})
    dealt = rows.withColumn("_file", F.expr("pmod(xxhash64(id), 10)")).unionByName(wrong.withColumn("_file", F.lit(0)))
    dealt = dealt.unionByName(wrong.withColumns({"_file": F.lit(9), "sign": F.lit(-1)}))
    # worked out once and written by all tasks; each batch is a run over what has come since the last
    dealt.write.partitionBy("_file").parquet(f"{inbox}-dealt")
    checkpoint = scratch_path(spark, "checkpoint")
    for part in range(10):
        spark.read.schema(rows.schema).parquet(f"{inbox}-dealt/_file={part}").write.mode("append").parquet(inbox)
        stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1_000_000).parquet(inbox)
        series.live_series(stream, path, checkpoint).awaitTermination()
    return path


@query("live_series", SQL["timeseries"])
def _(spark, sf):
    return series.series(spark, _live_rows(spark, sf), environment="production", start=datetime(1995, 1, 1), end=AS_OF, as_of=AS_OF)


@query("live_series_models", SQL["timeseries_models"])
def _(spark, sf):
    return series.series_models(spark, _live_rows(spark, sf), start=datetime(1995, 1, 1), end=AS_OF, as_of=AS_OF)


@query("rate_screen", """
    WITH q AS (SELECT CAST(user_id AS VARCHAR) AS client, epoch_us(ts) // 500 AS us FROM events),
    w AS (SELECT client, (us // 10000000 - k) * 10 AS start FROM q, range(6) t(k))
    SELECT client, strftime(to_timestamp(start) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S.%f') AS minute_start, count(*) AS requests
    FROM w GROUP BY ALL HAVING count(*) > 3""")  # fmt: skip
def _(spark, sf):
    """Each file is a batch and holds requests of all times, so those of the later ones come late."""
    inbox, path = scratch_path(spark, "late-requests"), scratch_path(spark, "screen")
    requests = src.table(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("client"),
        F.timestamp_micros(F.call_function("div", F.unix_micros(F.col("ts").cast("timestamp")), F.lit(500))).alias("ts"),
        F.pmod("event_id", F.lit(3)).alias("_part"),
    )
    for part in range(3):
        requests.filter(F.col("_part") == part).drop("_part").coalesce(1).write.mode("append").parquet(inbox)
    stream = spark.readStream.schema("client string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(inbox)
    live.rate_screen(stream, path, scratch_path(spark, "checkpoint")).awaitTermination()
    return live.screened(spark.read.parquet(path), 3)


@query("live_rate", _VERDICTS)
def _(spark, sf):
    """Three batches, each with requests of all times, so those of the later ones come late and change what was judged."""
    path = scratch_path(spark, "live-rate")
    stream = _shuffled_files(spark, _dense_requests(spark, sf), "late-requests", "request_id", 3)
    throttle.live_rate(stream, 3, path, scratch_path(spark, "checkpoint")).awaitTermination()
    return throttle.live_verdicts(spark, path)


def _shuffled_days(spark: SparkSession, sf: str) -> DataFrame:
    """Events in three files that go back in time from one to the next, each event in two of them."""
    path = scratch_path(spark, "days-backwards")
    events = src.table(spark, sf, "events").withColumn("_part", F.pmod(F.col("event_id"), F.lit(3)))
    for part in (2, 1, 0):
        late = F.expr(f"ts - interval {2 - part} months").alias("ts")
        rows = events.filter(F.col("_part").isin(part, (part + 1) % 3)).select("event_id", late, "user_id")
        rows.coalesce(1).write.mode("append").parquet(path)
        time_passes(1.1)
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 1).parquet(path)


@query("dedup_late_events", "SELECT event_id, user_id, 1 AS n FROM events")
def _(spark, sf):
    """Late first copies over three batches survive, replays do not."""
    kept = _run_into(live.dedup_events(_shuffled_days(spark, sf), ["event_id"]), spark, "late-first")
    return kept.groupBy("event_id", "user_id").agg(F.count("*").alias("n"))


@query("dedup_events", f"SELECT event_id, {time('ts')} AS ts, user_id FROM events")
def _(spark, sf):
    path = scratch_path(spark, "replayed")
    once = src.table(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id")
    once.unionByName(once).write.parquet(path)
    stream = spark.readStream.schema(once.schema).parquet(path)
    return _run_into(live.dedup_events(stream, ["event_id"]), spark, "deduplicated")
