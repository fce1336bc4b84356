"""Figures per trace: tokens, cost, models, nodes, errors, tool loops, and the stored row.

Each figure alone is an aggregation over span rows that combines before it shuffles, so a trace
holding a large share of all spans does no harm. ``trace_rows`` needs all of them: it gathers what the
row is made of from the spans of a trace and derives the row from that array in steps that are linear
in it but for sorting. Traces of more than ``LARGE`` spans are aggregated instead, by trace and
slice, tool call or name first, so only their node runs ever meet in one row. Documents that arrive
with their spans nested take the same path as small traces with no shuffle at all.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.functions.documents import canonical_json
from tracelake.functions.text import strip_tool_prefix
from tracelake.operators.evals import eval_figures, metadata_evals
from tracelake.operators.pricing import COST, RateCard, add_fields, price_spans, usage_of, usage_steps
from tracelake.operators.spans import nest_spans
from tracelake.schema import USAGE

DEFAULT_ENVIRONMENT = "production"
LOOP_CALLS = 5
LOOP_REPEATS = 2
#: Spans of a trace that are gathered in one row; those of larger traces are aggregated in slices of this many.
LARGE = 100_000


def llm_metrics(spans: DataFrame, own: RateCard | None = None) -> DataFrame:
    """Per trace: model calls, token sums, cost sums."""
    call = F.col("call")
    sums = [F.sum(call[n]).cast("bigint").alias(n) for n in ("total_tokens", "prompt_tokens", "completion_tokens")]
    costs = [F.sum(call[n]).cast(COST).alias(n) for n in ("total_cost", "prompt_cost", "completion_cost")]
    return price_spans(spans, own).groupBy("trace_id").agg(F.count("*").alias("llm_calls"), *sums, *costs)


def estimated_cost(spans: DataFrame, own: RateCard | None = None) -> DataFrame:
    priced = price_spans(spans, own)
    return priced.groupBy("trace_id").agg(F.sum("call.total_cost").cast(COST).alias("estimated_cost"))


def model_usage(spans: DataFrame, own: RateCard | None = None) -> DataFrame:
    """Per trace and model: calls, tokens, cost."""
    call = F.col("call")
    return (
        price_spans(spans, own)
        .groupBy("trace_id", call["model"].alias("model"))
        .agg(
            F.count("*").alias("calls"),
            F.sum(call["prompt_tokens"]).alias("prompt_tokens"),
            F.sum(call["completion_tokens"]).alias("completion_tokens"),
            F.sum(call["total_tokens"]).alias("total_tokens"),
            F.sum(call["total_cost"]).cast(COST).alias("total_cost"),
        )
    )


def model_counts(spans: DataFrame, own: RateCard | None = None) -> DataFrame:
    return model_usage(spans, own).select("trace_id", "model", "calls")


def node_counts(spans: DataFrame) -> DataFrame:
    """Per trace and node: executions."""
    nodes = spans.filter((F.col("span_type") == "node") & (F.col("name") != ""))
    return nodes.groupBy("trace_id", F.col("name").alias("node_name")).agg(F.count("*").alias("executions"))


def node_metrics(spans: DataFrame) -> DataFrame:
    """Per trace: its node executions in order as an array of (name, duration_ms, status)."""
    nodes = spans.filter((F.col("span_type") == "node") & (F.col("name") != ""))
    nested = nest_spans(nodes, ["name", "duration_ms", "status"])
    return nested.withColumnRenamed("spans", "node_metrics")


def _failed_traces(spans: DataFrame) -> DataFrame:
    return spans.filter(F.col("status") == "failed").select("trace_id").distinct().withColumn("_failed", F.lit(True))


def rolled_status(status: str, any_failed: str) -> str:
    return f"if({status} = 'completed' and {any_failed}, 'failed', {status})"


def rollup_status(traces: DataFrame, spans: DataFrame) -> DataFrame:
    """Traces with the status they end up with: a completed one holding a failed span has failed."""
    failed = _failed_traces(spans).withColumnRenamed("trace_id", "id")
    joined = traces.join(failed, "id", "left")
    status = rolled_status("status", "coalesce(_failed, false)")
    return joined.withColumn("status", F.expr(status)).drop("_failed")


def is_error(error: str) -> str:
    """SQL: an error record is there and is not an empty one."""
    return f"coalesce({error} not in ('', 'null', '{{}}'), false)"


def default_environment(environment: str) -> str:
    return f"coalesce(nullif({environment}, ''), '{DEFAULT_ENVIRONMENT}')"


def has_error(traces: DataFrame, spans: DataFrame) -> DataFrame:
    failed = _failed_traces(spans).withColumnRenamed("trace_id", "id")
    flag = f"coalesce(_failed, false) or {is_error('error')}"
    return traces.join(failed, "id", "left").selectExpr("id", f"{flag} as has_error")


def _loops(calls: str, distinct_inputs: str) -> str:
    return f"({calls} >= {LOOP_CALLS} or ({calls} >= 3 and {calls} - {distinct_inputs} >= {LOOP_REPEATS}))"


def tool_calls(spans: DataFrame) -> DataFrame:
    """Per trace and tool: calls, distinct inputs, first position, and whether it loops."""
    tools = spans.filter("span_type = 'tool'").selectExpr(
        "trace_id", "pos", f"{strip_tool_prefix('name')} as tool", f"{canonical_json('inputs')} as input"
    )
    per_input = tools.groupBy("trace_id", "tool", "input").agg(F.count("*").alias("n"), F.min("pos").alias("pos"))
    per_tool = per_input.groupBy("trace_id", "tool").agg(
        F.sum("n").alias("calls"), F.count("*").alias("distinct_inputs"), F.min("pos").alias("first_pos")
    )
    return per_tool.withColumn("loops", F.expr(_loops("calls", "distinct_inputs")))


def detect_tool_loops(spans: DataFrame) -> DataFrame:
    """Per looping trace: the looping tool seen first and how often it was called."""
    looping = tool_calls(spans).filter("loops")
    first = F.min_by(F.struct("tool", "calls"), F.col("first_pos"))
    return looping.groupBy("trace_id").agg(first.alias("first")).select(
        "trace_id", F.col("first.tool").alias("tool_loop_tool"), F.col("first.calls").alias("tool_loop_count")
    )


# --- the stored row -------------------------------------------------------------------------------

#: What the row takes from a priced call.
CALL_FACTS = ["model", "total_tokens", "total_cost"]
_LEAN = ["span_type", "name", "status", "duration_ms", "call", "input", "eval"]
_TOOL_NAME = "if({0}span_type = 'tool', " + strip_tool_prefix("{0}name") + ", {0}name)"


def _lean(spans: DataFrame, own: RateCard | None) -> DataFrame:
    """Span rows reduced to what the stored row needs."""
    return usage_of(spans, own).selectExpr(
        "trace_id",
        "pos",
        "span_type",
        _TOOL_NAME.format("") + " as name",
        "status",
        "duration_ms",
        f"if(span_type = 'llm', struct({', '.join(f'call.{n} as {n}' for n in CALL_FACTS)}), null) as call",
        f"if(span_type = 'tool', {canonical_json('inputs')}, null) as input",
        f"if(span_type = 'eval', nullif({canonical_json('eval')}, ''), null) as eval",
    )


def _lean_nested(traces: DataFrame, own: RateCard | None) -> DataFrame:
    """Typed documents with ``spans`` reduced the same way, row by row, and their priced ``_calls``."""
    told = "if(span.span_type in ('llm', 'eval'), try_parse_json(span.metadata), null)"
    lean = f"""transform(spans, span -> named_struct(
        'span_type', span.span_type, 'name', {_TOOL_NAME.format('span.')}, 'status', span.status, 'duration_ms', span.duration_ms,
        'meta', {told}, 'input', if(span.span_type = 'tool', {canonical_json('span.inputs')}, null)))"""
    facts = """transform(filter(spans, s -> s.span_type = 'llm'), s -> named_struct('span_type', s.span_type, 'name', s.name,
        'usage', try_variant_get(s.meta, '$.usage', '{}'), 'model', try_variant_get(s.meta, '$.model', 'string')))""".format(USAGE)
    calls, _ = add_fields(facts, ["span_type", "name", "usage", "model"], usage_steps(own), CALL_FACTS)
    judged = """transform(spans, s -> named_struct('span_type', s.span_type, 'name', s.name, 'status', s.status,
        'duration_ms', s.duration_ms, 'input', s.input,
        'eval', if(s.span_type = 'eval', to_json(try_variant_get(s.meta, '$.eval', 'variant')), null)))"""
    reduced = traces.withColumn("spans", F.expr(lean)).withColumn("_calls", F.expr(calls))
    return reduced.withColumn("spans", F.expr(judged))


def _total(items: str, field: str, kind: str) -> str:
    return f"aggregate({items}, cast(0 as {kind}), (total, item) -> cast(total + item.{field} as {kind}))"


def _starts(items: str) -> str:
    """SQL: where each run of equal items of a sorted array begins."""
    places = f"if(size({items}) > 0, sequence(0, size({items}) - 1), slice(array(0), 1, 0))"
    return f"filter({places}, i -> i = 0 or not (get({items}, i) <=> get({items}, i - 1)))"


def _run_lengths(items: str, starts: str) -> str:
    """SQL: the length of each run of a sorted array."""
    return f"transform({starts}, (at, k) -> cast(coalesce(get({starts}, k + 1), size({items})) - at as bigint))"


def _counts(items: str, starts: str) -> str:
    """SQL for a map of each item of a sorted array to how often it occurs."""
    return f"map_from_arrays(transform({starts}, at -> get({items}, at)), {_run_lengths(items, starts)})"


def trace_rows(
    traces: DataFrame,
    spans: DataFrame | None = None,
    own: RateCard | None = None,
    keep: Sequence[str] = (),
) -> DataFrame:
    """The derived fact row of every trace, followed by the columns to ``keep``.

    ``traces`` either carries its spans nested (``spans`` array) or comes with a frame of span rows.
    """
    if spans is None:
        return _rows_of_arrays(_lean_nested(traces, own), keep)
    lean = _lean(spans, own)
    # counted without their places, which may take a sort to find; most inputs have none, and then nothing else is done
    large = spans.groupBy(F.col("trace_id").alias("id")).agg(F.count("*").alias("_n")).filter(F.col("_n") > LARGE).select("id")
    if large.isEmpty():
        return _rows_of_arrays(_gathered(traces, lean), keep)
    some = _rows_of_arrays(_gathered(traces.join(large, "id", "left_anti"), lean.join(large, F.col("trace_id") == F.col("id"), "left_anti")), keep)
    return some.unionByName(_rows_of_slices(traces.join(large, "id", "left_semi"), lean.join(large, F.col("trace_id") == F.col("id"), "left_semi"), keep))


def _gathered(traces: DataFrame, lean: DataFrame) -> DataFrame:
    nested = nest_spans(lean, _LEAN).withColumnRenamed("trace_id", "id")
    packed = traces.drop("spans").join(nested, "id", "left")
    return packed.withColumn("_calls", F.expr("transform(filter(spans, s -> s.span_type = 'llm'), s -> s.call)"))


def _rows_of_slices(traces: DataFrame, lean: DataFrame, keep: Sequence[str]) -> DataFrame:
    """``trace_rows`` of large traces, from aggregates that combine before they meet."""

    def counted(rows: DataFrame, name: str, into: str) -> DataFrame:
        each = rows.groupBy("trace_id", F.expr(name).alias("_name")).agg(F.count("*").alias("_n"))
        entries = F.array_sort(F.collect_list(F.struct("_name", "_n")))
        return each.groupBy("trace_id").agg(F.map_from_entries(entries).alias(into))

    nodes = lean.filter("span_type = 'node' and name <> ''")
    tools = lean.filter("span_type = 'tool'").groupBy("trace_id", "name", "input").agg(F.count("*").alias("n"))
    tools = tools.groupBy("trace_id", "name").agg(F.sum("n").alias("calls"), F.count("*").alias("inputs"))
    loops = tools.groupBy("trace_id").agg(F.max(F.expr(_loops("calls", "inputs"))).alias("_loop"))
    totals = lean.groupBy("trace_id").agg(
        F.count("*").alias("_spans"),
        F.max(F.expr("status <=> 'failed'")).alias("_failed"),
        F.count("call").alias("_n_calls"),
        F.sum("call.total_tokens").alias("_tokens"),
        F.sum("call.total_cost").cast(COST).alias("_cost"),
        F.count_if(F.expr("span_type = 'eval' and eval is null")).cast("int").alias("_n_bare"),
        F.count_if(F.expr("span_type = 'eval' and eval is null and status <> 'completed'")).cast("int").alias("_n_bare_failed"),
        F.array_sort(F.collect_set(F.when(F.col("span_type") == "eval", F.col("eval")))).alias("_recorded"),
    )
    runs = nodes.groupBy("trace_id", F.expr(f"pos div {LARGE}").alias("_slice")).agg(
        F.array_sort(F.collect_list(F.struct("pos", F.struct("name", "duration_ms", "status").alias("run")))).alias("_part")
    )
    parts = F.array_sort(F.collect_list(F.struct("_slice", "_part")))
    runs = runs.groupBy("trace_id").agg(F.transform(F.flatten(F.transform(parts, lambda p: p["_part"])), lambda r: r["run"]).alias("_runs"))
    found = totals
    for more in (counted(nodes, "name", "_nodes"), counted(lean.filter("call is not null"), "call.model", "_models"), loops, runs):
        found = found.join(more, "trace_id", "left")
    whole = traces.drop("spans").join(found.withColumnRenamed("trace_id", "id"), "id").withColumn("_listed", F.expr(metadata_evals("metadata")))
    eval_count, eval_status = eval_figures("_listed", "_recorded", "_n_bare", "_n_bare_failed")
    none = "map_from_arrays(slice(array(''), 1, 0), slice(array(0L), 1, 0))"
    return whole.selectExpr(
        "id",
        "name",
        f"{rolled_status('status', '_failed')} as status",
        "start_time",
        "end_time",
        "duration_ms",
        *HTTP_COLUMNS,
        "_spans as total_spans",
        "cast(coalesce(_tokens, 0) as bigint) as total_tokens",
        "_n_calls as llm_calls",
        f"coalesce(_cost, cast(0 as {COST})) as estimated_cost",
        f"(_failed or {is_error('error')}) as has_error",
        f"{default_environment('environment')} as environment",
        "project",
        f"coalesce(_nodes, {none}) as node_counts",
        f"{eval_status} as eval_status",
        f"{eval_count} as eval_count",
        "coalesce(_loop, false) as has_tool_loop",
        f"coalesce(_models, {none}) as model_counts",
        "coalesce(_runs, transform(slice(array(0), 1, 0), i -> named_struct('name', '', 'duration_ms', 0d, 'status', ''))) as node_metrics",
        *keep,
    )


def _rows_of_arrays(packed: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Fact rows of traces that carry what is needed of their spans as an array."""
    split = packed.withColumn("_calls", F.expr("coalesce(_calls, slice(array(_calls[0]), 1, 0))")).withColumn("spans", F.expr("coalesce(spans, slice(array(spans[0]), 1, 0))")).selectExpr(
        "*",
        "filter(spans, s -> s.span_type = 'node' and s.name <> '') as _nodes",
        "filter(spans, s -> s.span_type = 'tool') as _tools",
        "filter(spans, s -> s.span_type = 'eval') as _evals",
        "exists(spans, s -> s.status = 'failed') as _failed",
        f"{metadata_evals('metadata')} as _listed",
    )
    named = split.selectExpr(
        "*",
        "array_sort(transform(_calls, c -> c.model)) as _models",
        "array_sort(transform(_nodes, s -> s.name)) as _node_names",
        "array_sort(transform(_tools, s -> struct(s.name as name, s.input as input))) as _tool_calls",
        "filter(_evals, s -> s.eval is null) as _bare",
        "array_distinct(filter(transform(_evals, s -> s.eval), record -> record is not null)) as _recorded",
    )
    # equal calls of a tool lie together, and so do all calls of it
    named = named.selectExpr(
        "*",
        "array_distinct(_tool_calls) as _tool_inputs",
        "transform(_tool_calls, c -> c.name) as _tool_names",
    ).selectExpr(
        "*",
        "transform(_tool_inputs, c -> c.name) as _input_names",
        f"{_starts('_models')} as _model_starts",
        f"{_starts('_node_names')} as _node_starts",
        f"{_starts('_tool_names')} as _tool_starts",
    ).selectExpr("*", f"{_starts('_input_names')} as _input_starts")
    lengths = f"{_run_lengths('_tool_names', '_tool_starts')}, {_run_lengths('_input_names', '_input_starts')}"
    loops = f"zip_with({lengths}, (calls, inputs) -> {_loops('calls', 'inputs')})"
    bare_failed = "size(filter(_bare, s -> s.status <> 'completed'))"
    eval_count, eval_status = eval_figures("_listed", "_recorded", "size(_bare)", bare_failed)
    return named.selectExpr(
        "id",
        "name",
        f"{rolled_status('status', '_failed')} as status",
        "start_time",
        "end_time",
        "duration_ms",
        *HTTP_COLUMNS,
        "cast(size(spans) as bigint) as total_spans",
        f"{_total('_calls', 'total_tokens', 'bigint')} as total_tokens",
        "cast(size(_calls) as bigint) as llm_calls",
        f"{_total('_calls', 'total_cost', COST)} as estimated_cost",
        f"(_failed or {is_error('error')}) as has_error",
        f"{default_environment('environment')} as environment",
        "project",
        f"{_counts('_node_names', '_node_starts')} as node_counts",
        f"{eval_status} as eval_status",
        f"{eval_count} as eval_count",
        f"exists({loops}, hit -> hit) as has_tool_loop",
        f"{_counts('_models', '_model_starts')} as model_counts",
        "transform(_nodes, s -> struct(s.name, s.duration_ms, s.status)) as node_metrics",
        *keep,
    )


# Method, path and status code of the request, null where there was none.
HTTP_COLUMNS = ["http.method as http_method", "http.path as http_path", "http.status_code as http_status_code"]


def flatten_http(traces: DataFrame) -> DataFrame:
    return traces.selectExpr("id", *HTTP_COLUMNS)
