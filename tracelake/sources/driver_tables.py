"""Traces, spans, span events and requests derived from the sample tables by fixed formulas."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.operators.capture import NODE_KEY
from tracelake.operators.ranking import row_numbers
from tracelake.schema import USAGE

AS_OF = datetime(2001, 8, 2)
MODELS = [
    "openai/gpt-4o", "gpt_4o_mini", "claude-3-5-haiku", "gpt-4o-2024-08-06",
    "models/gemini-1.5-pro", "llama-3.1-8b:latest", "gpt-5.7-preview", "totally-unknown",
]
SPAN_ORDER = [
    "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_shipdate",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One trace per order, without spans."""
    orders = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey", "o_custkey", "o_orderstatus as s", "o_totalprice", "cast(o_orderdate as timestamp) as day",
        "concat('wf_', cast(o_custkey % 6 as string)) as flow",
    )
    return orders.selectExpr(
        "cast(o_orderkey as string) as id",
        "flow as name",
        "case s when 'O' then 'running' when 'F' then 'failed' else 'completed' end as status",
        "case when o_orderkey % 50 = 0 then null when o_custkey % 3 = 0 then 'production' "
        "when o_custkey % 3 = 1 then 'staging' else 'development' end as environment",
        "if(o_custkey % 7 = 0, null, concat('proj_', cast(o_custkey % 5 as string))) as project",
        "timestamp_micros(unix_micros(day) + (o_orderkey * 7919) % 86400 * 1000000) as start_time",
        "if(s = 'O', null, timestamp_micros(unix_micros(day) + ((o_orderkey * 7919) % 86400 + 1) * 1000000)) as end_time",
        "if(s = 'O', null, o_totalprice) as duration_ms",
        "named_struct('method', 'POST', 'path', concat('/api/', flow), 'url', concat('http://host/api/', flow), "
        "'status_code', case s when 'F' then 500 when 'O' then null else 200 end, 'client_ip', cast(null as string), "
        "'headers', cast(null as map<string,string>), 'query_params', cast(null as map<string,string>)) as http",
        "cast(null as string) as input",
        "cast(null as string) as output",
        """if(s = 'F' and o_orderkey % 2 = 0, '{"type":"E"}', null) as error""",
        "'{}' as metadata",
    )


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One span per line item, ordered inside its order, which has a handful of them."""
    line = table(spark, sf_dir, "lineitem").selectExpr("cast(l_orderkey as string) as trace_id", "l_returnflag", *SPAN_ORDER)
    models = ", ".join(f"'{m}'" for m in MODELS)
    typed = row_numbers(line, "trace_id", SPAN_ORDER, [], "seq").selectExpr(
        "*", "cast(l_quantity * 100 as bigint) as prompt", "l_partkey % 500 as completion",
        "cast(cast(l_quantity as int) as string) as q",
    ).selectExpr(
        "*", f"element_at(array({models}), cast(l_suppkey % 8 as int) + 1) as called",
        "case when seq = 1 then 'workflow' when l_partkey % 10 <= 3 then 'llm' when l_partkey % 10 <= 6 then 'tool' "
        "when l_partkey % 10 <= 8 then 'node' else 'eval' end as span_type",
    )
    same = """concat('{"a":', q, ',"items":[1]}')"""
    return typed.selectExpr(
        "trace_id",
        "concat(trace_id, '-', cast(seq as string)) as id",
        "if(seq > 1, concat(trace_id, '-', cast(seq div 2 as string)), null) as parent_id",
        "seq - 1 as pos",
        """case span_type when 'workflow' then 'workflow'
           when 'llm' then concat(if(l_suppkey % 2 = 1, 'Chat: ', 'LLM: '), called)
           when 'tool' then concat('Tool: tool_', cast(l_partkey % 2 as string))
           when 'node' then concat('node_', cast(l_suppkey % 8 as string))
           else concat('Eval: eval_', cast(l_suppkey % 3 as string)) end as name""",
        "span_type",
        "if(l_returnflag = 'R' and (l_partkey % 4 = 0 or l_partkey % 10 = 9), 'failed', 'completed') as status",
        "l_extendedprice as duration_ms",
        f"""case span_type when 'tool' then concat('{{"q":', cast(l_suppkey % 2 as string), '}}') when 'node' then {same} end as inputs""",
        f"""if(span_type = 'node', case l_suppkey % 4 when 0 then {same}
            when 1 then concat('{{"a":', cast(cast(q as int) + 1 as string), ',"items":[1]}}')
            when 2 then concat('{{"a":', q, ',"items":[1,2]}}') else concat('{{"a":', q, ',"b":1}}') end, null) as outputs""",
        "'{}' as metadata",
        f"""if(span_type = 'llm', cast(named_struct('model', null, 'prompt_tokens', prompt, 'completion_tokens', completion,
            'total_tokens', if(l_linenumber % 5 = 0, 0L, prompt + completion), 'cached_tokens', if(l_discount >= 0.05, prompt div 2, 0L),
            'prompt_tokens_details', null, 'prompt_cost', null, 'completion_cost', null, 'total_cost', null) as {USAGE}), null) as usage""",
        "cast(null as string) as model",
        "cast(null as string) as eval",
    )


def timed_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans with their start, one second apart inside a trace."""
    begun = traces(spark, sf_dir).selectExpr("id as trace_id", "start_time as _begun")
    start = "timestamp_micros(unix_micros(_begun) + pos * 1000000) as start_time"
    return spans(spark, sf_dir).join(begun, "trace_id").selectExpr("*", start).drop("_begun")


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as requests, the user being the client."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").cast("string").alias("request_id"),
        F.col("user_id").cast("string").alias("client"),
        F.col("ts").cast("timestamp").alias("ts"),
    )


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed trace documents: traces with their spans nested and usage inside span metadata."""
    tokens = ", ".join(f"'{n}', usage.{n}" for n in ("prompt_tokens", "completion_tokens", "total_tokens", "cached_tokens"))
    usage = f"to_json(named_struct('usage', named_struct({tokens})))"
    packed = spans(spark, sf_dir).selectExpr(
        "trace_id as id",
        f"""named_struct('pos', pos, 'id', id, 'parent_id', parent_id, 'name', name, 'span_type', span_type, 'status', status,
            'duration_ms', duration_ms, 'inputs', inputs, 'outputs', outputs,
            'metadata', if(span_type = 'llm', {usage}, '{{}}')) as span""",
    )
    nested = packed.groupBy("id").agg(F.expr("sort_array(collect_list(span)) as spans"))
    # times follow from the trace's, so its row is joined once, to the whole list
    second = "timestamp_micros(unix_micros(start_time) + (x.pos + {0}) * 1000000)"
    timed = F.expr(
        f"""transform(spans, x -> named_struct('id', x.id, 'trace_id', id, 'parent_id', x.parent_id, 'name', x.name, 'span_type', x.span_type,
            'status', x.status, 'start_time', {second.format(0)}, 'end_time', {second.format(1)}, 'duration_ms', x.duration_ms, 'inputs', x.inputs,
            'outputs', x.outputs, 'state_diff', cast(null as string), 'error', cast(null as string), 'metadata', x.metadata))"""
    )
    return traces(spark, sf_dir).join(nested, "id", "left").withColumn("spans", timed).withColumn("graph_topology", topology())


def topology():
    """A graph per trace: a chain of one to four nodes, the last edge conditional."""
    last = "cast(right(name, 1) as int) % 4"
    return F.expr(
        f"""named_struct(
          'nodes', transform(sequence(0, {last}), i -> named_struct('id', concat('node_', i), 'name', concat('node_', i))),
          'edges', transform(sequence(0, {last}), i -> named_struct('source', concat('node_', i),
             'target', if(i = {last}, '__end__', concat('node_', i + 1)), 'conditional', i = {last}, 'data', if(i = {last}, 'done', null))))"""
    )


def span_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Start and end (or error) events of every span; spans close in reverse order."""
    kind = (
        "case when span_type in ('workflow', 'node') then 'chain' when span_type = 'tool' then 'tool' "
        "when span_type = 'eval' then 'custom' when name like 'Chat: %' then 'chat' else 'llm' end"
    )
    # both events of a span come from one row, so that the spans are made once
    both = timed_spans(spark, sf_dir).selectExpr("*", f"{kind} as kind", "explode(array(true, false)) as begins")
    return both.selectExpr(
        "if(begins, cast(pos as bigint), cast(1000000 - pos as bigint)) as seq",
        "if(begins, start_time, timestamp_micros(unix_micros(start_time) + (2000 - pos * 2) * 1000000L)) as ts",
        "trace_id", "id as run_id", "if(begins, parent_id, null) as parent_run_id", "kind",
        "case when begins then 'start' when status = 'failed' then 'error' else 'end' end as phase",
        "if(begins and kind = 'custom', name, null) as name",
        """case when not begins then null when span_type = 'workflow' then '{"name":"workflow"}'
           when kind = 'tool' then concat('{"name":"', replace(name, 'Tool: ', ''), '"}') end as serialized""",
        "cast(null as array<string>) as tags",
        f"""case when not begins then null when span_type = 'node' then concat('{{"{NODE_KEY}":"', name, '"}}') else '{{}}' end as metadata""",
        """if(begins and span_type = 'llm', concat('{"model":"', regexp_replace(name, '^(LLM|Chat): ', ''), '"}'), null) as invocation_params""",
        "if(begins, coalesce(inputs, '{}'), null) as inputs",
        """case when begins then null when kind = 'chat' then concat('{"generations":[{"text":"t","message":{"usage_metadata":{"input_tokens":',
           usage.prompt_tokens, ',"output_tokens":', usage.completion_tokens, '}}}]}') else coalesce(outputs, '{}') end as outputs""",
        """if(not begins and kind = 'llm', concat('{"token_usage":{"prompt_tokens":', usage.prompt_tokens, ',"completion_tokens":',
           usage.completion_tokens, '}}'), null) as llm_output""",
        *[f"if(not begins and status = 'failed', '{said}', null) as {n}" for n, said in (("error_type", "ValueError"), ("error_message", "bad value"), ("traceback", "line 1"))],
    )


def trace_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Life of each trace: start, a finish unless still running, and for some a second finish."""
    t = traces(spark, sf_dir).selectExpr("*", "cast(null as string) as none")
    done = t.filter("status <> 'running'")
    start = t.selectExpr("id as trace_id", "0L as seq", "start_time as ts", "'start' as phase", "name", "none as status", "none as output", "none as error")
    finish = done.selectExpr("id", "1L", "end_time", "'finish'", "none", "status", """'{"n":1}'""", "error")
    again = done.filter("cast(id as bigint) % 5 = 0").selectExpr(
        "id", "2L", "end_time + interval 1 hour", "'finish'", "none", "if(cast(id as bigint) % 10 = 0, 'failed', 'running')",
        """'{"n":2}'""", "none",
    )
    return start.union(finish).union(again)
