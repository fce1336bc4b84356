"""From the event log of a running workflow to spans and traces.

Every run of a chain, model or tool reports a start and later an end or an error, numbered by
``seq`` inside its trace.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.functions.documents import json_text
from tracelake.functions.models import normal_name, resolve_model_name
from tracelake.functions.numbers import duration_ms
from tracelake.operators.evals import map_to_json
from tracelake.operators.pricing import RateCard, add_columns, call_cost_steps, rate_steps
from tracelake.operators.metrics import trace_rows
from tracelake.operators.ranking import row_numbers
from tracelake.operators.spans import MAX_SPANS, climb
from tracelake.schema import HTTP, USAGE
from tracelake.session import stored


# Fixed value: the metadata key under which a run tells its graph node.
NODE_KEY = "langgraph_node"


def _node(metadata: str) -> Column:
    return F.expr(json_text(metadata, NODE_KEY))


def _model_at_start(start: str = "") -> str:
    """SQL: the model a call names when it starts."""
    default = f"if({start}kind = 'chat', 'chat_model', 'llm')"
    return resolve_model_name(
        "cast(null as string)", f"{start}invocation_params", f"{start}metadata", f"{start}serialized", default
    )


def call_name() -> Column:
    """Span name of a model or tool start; the given name for anything else."""
    return F.expr(
        f"""case kind when 'llm' then concat('LLM: ', {_model_at_start()}) when 'chat' then concat('Chat: ', {_model_at_start()})
        when 'tool' then concat('Tool: ', coalesce({json_text('serialized', 'name')}, 'tool')) else name end"""
    )


def name_calls(events: DataFrame) -> DataFrame:
    """(trace_id, run_id, span_name) of model and tool starts."""
    starts = events.filter((F.col("phase") == "start") & F.col("kind").isin("llm", "chat", "tool"))
    return starts.select("trace_id", "run_id", call_name().alias("span_name"))


def classify_runs(events: DataFrame) -> DataFrame:
    """(trace_id, run_id, parent_id, span_type, span_name) of chain starts.

    A run tagged with a graph node is that node, unless its parent already bears the node's name;
    then it is the node's inner execution. Inside such an execution the next tagged run is a node
    again, so along a chain of runs with the same tag the two alternate.
    """
    return _classified(events).filter(F.col("kind") == "chain").drop("kind")


def start_labels() -> list[Column]:
    """Of a start event: the graph node a chain run is tagged with, and the name of a run that has no such tag."""
    is_chain = F.col("kind") == "chain"
    bare = "serialized is null or serialized in ('{}', 'null')"
    plain = F.expr(f"coalesce(nullif(name, ''), if({bare}, 'chain', {json_text('serialized', 'name')}), 'workflow')")
    return [F.when(is_chain, _node("metadata")).alias("node"), F.when(is_chain, plain).otherwise(call_name()).alias("plain")]


def type_and_name(inner: Column) -> list[Column]:
    """span_type and span_name from kind, node, plain and parent_id; ``inner``: the run is its node's inner execution."""
    kind, tagged = F.col("kind"), F.col("node").isNotNull()
    span_type = (
        F.when(kind.isin("llm", "chat"), "llm")
        .when(kind == "tool", "tool")
        .when(kind != "chain", "custom")
        .when(tagged & ~inner, "node")
        .when(tagged, "custom")
        .when(F.col("parent_id").isNull(), "workflow")
        .otherwise("custom")
    )
    span_name = (
        F.when(tagged & inner, F.concat("node", F.lit(":exec"))).when(tagged, F.col("node")).otherwise(F.col("plain"))
    )
    return [span_type.alias("span_type"), span_name.alias("span_name")]


def _starts(events: DataFrame) -> DataFrame:
    """What is needed of the starts of runs to type, name and place them; none of their payload."""
    return stored(events.filter(F.col("phase") == "start").select("trace_id", "run_id", "parent_run_id", "kind", "seq", *start_labels()), "starts")


def _classified(events: DataFrame) -> DataFrame:
    """``classify_runs`` for starts of every kind; carries none of their payload."""
    return _judged(_starts(events)).drop("seq")


def _judged(starts: DataFrame) -> DataFrame:
    parents = starts.select(
        "trace_id",
        F.col("run_id").alias("parent_run_id"),
        F.col("run_id").alias("parent_id"),
        F.col("node").alias("parent_node"),
        F.when(F.col("node").isNull(), F.col("plain")).alias("parent_plain"),
    )
    tagged = F.col("node").isNotNull()
    linked = starts.join(parents, ["trace_id", "parent_run_id"], "left").withColumns(
        {
            "under_same": tagged & F.coalesce(F.col("parent_node") == F.col("node"), F.lit(False)),
            "under_named": tagged & F.coalesce(F.col("parent_plain") == F.col("node"), F.lit(False)),
        }
    )
    # stored once: it is read for the rows and for the few that must be counted
    linked = stored(linked.drop("parent_run_id", "parent_node", "parent_plain"), "linked")
    # Only runs of the same tag below one another need to be counted upwards.
    same = linked.filter("under_same")
    heads = same.select("trace_id", F.col("parent_id").alias("run_id")).distinct()
    tops = linked.filter(~F.col("under_same")).join(heads, ["trace_id", "run_id"], "left_semi")
    run = F.col("run_id")
    links = same.select("trace_id", run.alias("id"), F.col("parent_id").alias("up"), run.alias("label")).unionByName(
        tops.select("trace_id", run.alias("id"), F.lit(None).cast("string").alias("up"), run.alias("label"))
    )
    first = tops.select("trace_id", run.alias("top"), F.col("under_named").cast("int").alias("first"))
    odd = (F.col("depth") + F.col("first")) % 2 == 1
    parity = climb(links).join(first, ["trace_id", "top"]).select("trace_id", F.col("id").alias("run_id"), odd.alias("odd"))
    tags = linked.filter(tagged).join(parity, ["trace_id", "run_id"], "left")
    judged = tags.unionByName(linked.filter(~tagged).withColumn("odd", F.lit(None).cast("boolean")))
    return judged.select("trace_id", "run_id", "parent_id", "kind", "seq", *type_and_name(F.coalesce("odd", "under_named")))


def _counts(tokens: str, total_default: str | None) -> str:
    """SQL: token counts of one provider object (a variant); null if there is no such object."""

    def number(name: str) -> str:
        return f"try_variant_get({tokens}, '$.{name}', 'bigint')"

    def either(first: str, second: str) -> str:
        return f"coalesce(nullif({number(first)}, 0L), {number(second)}, 0L)"

    prompt, completion = either("prompt_tokens", "input_tokens"), either("completion_tokens", "output_tokens")
    total = f"coalesce({number('total_tokens')}, {total_default or f'{prompt} + {completion}'})"
    counts = f"named_struct('total_tokens', {total}, 'prompt_tokens', {prompt}, 'completion_tokens', {completion})"
    return f"if(try_variant_get({tokens}, '$', 'map<string,variant>') is null, null, {counts})"


def normalize_usage(llm_output: str, outputs: str) -> str:
    """SQL: token counts of a finished call, whichever shape the provider used; null if it gave none.

    The call's own output comes first, then the first generation whose message carries usage.
    """

    def part(source: str, path: str) -> str:
        return f"try_variant_get({source}, '$.{path}', 'variant')"

    own = [_counts(part(f"try_parse_json({llm_output})", key), "0L") for key in ("token_usage", "usage")]
    generations = f"try_variant_get(try_parse_json({outputs}), '$.generations', 'array<variant>')"
    paths = ["usage_metadata", "response_metadata.token_usage", "response_metadata.usage"]
    of_message = ", ".join(_counts(part("generation", f"message.{path}"), None) for path in paths)
    found = f"filter(transform({generations}, generation -> coalesce({of_message})), counts -> counts is not null)"
    return f"coalesce({', '.join(own)}, try_element_at({found}, 1))"


def price_llm_events(events: DataFrame, own: RateCard | None = None) -> DataFrame:
    """(trace_id, run_id, model, tokens and costs) of finished model calls.

    Calls without usage keep their model name as it is and cost nothing.
    """
    calls = pair_events(events.filter(F.col("kind").isin("llm", "chat")))
    priced = price_pairs(calls, own).filter(F.col("end.phase") == "end")
    return priced.select("trace_id", "run_id", *CALL_COLUMNS)


CALL_COLUMNS = [
    "model", "total_tokens", "prompt_tokens", "completion_tokens", "prompt_cost", "completion_cost", "total_cost",
]


def price_pairs(pairs: DataFrame, own: RateCard | None = None) -> DataFrame:
    """Paired events with model, tokens and costs of those that are finished model calls."""
    finished = "start.kind in ('llm', 'chat') and end.phase = 'end'"
    told = f"{json_text('end.llm_output', 'model_name')}, {json_text('end.llm_output', 'model')}"
    named = pairs.withColumns(
        {
            "model": F.expr(f"if({finished}, coalesce({told}, {_model_at_start('start.')}), null)"),
            "_tokens": F.expr(f"if({finished}, {normalize_usage('end.llm_output', 'end.outputs')}, null)"),
        }
    )
    counts = {n: f"_tokens.{n}" for n in ("total_tokens", "prompt_tokens", "completion_tokens")}
    flat = named.withColumns({**{n: F.expr(sql) for n, sql in counts.items()}, "cached_tokens": F.expr("0L")})
    priced = add_columns(flat, rate_steps(own) + call_cost_steps())
    used = "_tokens is not null"
    costs = [f"if({used}, {n}, null) as {n}" for n in ("prompt_cost", "completion_cost", "total_cost")]
    return priced.selectExpr(*pairs.columns, f"if({used}, {normal_name('model')}, model) as model", *counts, *costs)


def error_record(error_type: Column, message: Column, traceback: Column) -> Column:
    return F.to_json(F.struct(message.alias("message"), traceback.alias("traceback"), error_type.alias("type")))


def error_records(events: DataFrame) -> DataFrame:
    """(trace_id, run_id, status, error) of runs that ended in an error."""
    failed = events.filter(F.col("phase") == "error")
    record = error_record(F.col("error_type"), F.col("error_message"), F.col("traceback"))
    return failed.select("trace_id", "run_id", F.lit("failed").alias("status"), record.alias("error"))


def _wrapped(name: str, value: Column) -> Column:
    return F.concat(F.lit('{"' + name + '":'), F.coalesce(value, F.lit("null")), F.lit("}"))


# What is kept of the event that starts a run and of the one that ends it.
START_FIELDS = ["seq", "ts", "parent_run_id", "kind", "name", "serialized", "tags", "metadata", "invocation_params", "inputs"]
END_FIELDS = ["seq", "ts", "phase", "outputs", "llm_output", "metadata", "error_type", "error_message", "traceback"]


def pair_events(events: DataFrame) -> DataFrame:
    """One row per started run with its last end or error, from one aggregation.

    Works on streams as well. Runs that end without having started are dropped.
    """
    start, end = F.struct(*START_FIELDS), F.struct(*END_FIELDS)
    begins = F.col("phase") == "start"
    pairs = events.groupBy("trace_id", "run_id").agg(
        F.min_by(F.when(begins, start), F.when(begins, F.col("seq"))).alias("start"),
        F.max_by(F.when(~begins, end), F.when(~begins, F.col("seq"))).alias("end"),
    )
    return pairs.filter(F.col("start").isNotNull())


def merged_metadata(first: Column, later: Column) -> Column:
    """Two JSON objects as one; keys of the later one win."""

    def members(text: Column) -> Column:
        none = F.from_json(F.lit("{}"), "map<string,string>")
        fields = F.try_variant_get(F.try_parse_json(text), "$", "map<string,variant>")
        return F.coalesce(F.transform_values(fields, lambda _, v: F.to_json(v)), none)

    newer = members(later)
    older = F.map_filter(members(first), lambda key, _: ~F.map_contains_key(newer, key))
    return map_to_json(F.map_concat(older, newer))


def _tagged(metadata: Column, tags: Column) -> Column:
    """Metadata with the tags of the run, if it has any."""
    told = F.concat(F.lit('{"tags":'), F.to_json(tags), F.lit("}"))
    return F.when(F.size(tags) > 0, merged_metadata(metadata, told)).otherwise(metadata)


def close_spans(pairs: DataFrame, more: Sequence[str] = ()) -> DataFrame:
    """Paired events as span rows, before parents and chain names are known."""
    ended = F.col("end").isNotNull()
    failed = F.col("end.phase") == "error"
    kind = F.col("start.kind")
    inputs, outputs = F.col("start.inputs"), F.col("end.outputs")
    return pairs.select(
        "trace_id",
        F.col("run_id").alias("id"),
        F.col("start.parent_run_id").alias("parent_run_id"),
        kind.alias("kind"),
        F.col("start.seq").alias("seq"),
        F.when(~ended, "running").when(failed, "failed").otherwise("completed").alias("status"),
        F.col("start.ts").alias("start_time"),
        F.col("end.ts").alias("end_time"),
        F.when(ended, duration_ms(F.col("start.ts"), F.col("end.ts"))).alias("duration_ms"),
        F.when(kind == "tool", _wrapped("input", inputs)).when(kind == "llm", _wrapped("prompts", inputs))
        .when(kind == "chat", _wrapped("messages", inputs)).otherwise(inputs).alias("inputs"),
        F.when(ended & ~failed, F.when(kind == "tool", _wrapped("output", outputs)).otherwise(outputs)).alias("outputs"),
        F.when(failed, error_record(F.col("end.error_type"), F.col("end.error_message"), F.col("end.traceback"))).alias("error"),
        merged_metadata(_tagged(F.col("start.metadata"), F.col("start.tags")), F.col("end.metadata")).alias("metadata"),
        *more,
    )


def assemble_spans(events: DataFrame, own: RateCard | None = None) -> DataFrame:
    """Span rows from start, end and error events: typed, named, parented, with usage and cost.

    Payloads are shuffled once, to pair the events of a run; names, parents and places are worked out on the
    start events alone and joined to the pairs where those already lie.
    """
    spans = close_spans(price_pairs(pair_events(events), own), CALL_COLUMNS)
    starts = _starts(events)
    placed = row_numbers(_judged(starts), "trace_id", ["seq", "run_id"], ["seq div 1000"], "_n", counted=starts)
    named = placed.select(
        "trace_id", F.col("run_id").alias("id"), "parent_id", F.col("span_name").alias("name"), "span_type", (F.col("_n") - 1).alias("pos")
    )
    return span_facts(spans.join(named, ["trace_id", "id"]).drop("parent_run_id", "kind"))


def placed_spans(spans: DataFrame) -> DataFrame:
    """Adds ``pos``, the place of each span in its trace by the order in which they started."""
    placed = row_numbers(spans, "trace_id", ["seq", "id"], ["seq div 1000"], "_n")
    return placed.withColumn("pos", F.col("_n") - 1).drop("_n")


def span_facts(spans: DataFrame) -> DataFrame:
    """Adds usage as the provider gave it and the eval record, span by span."""
    counts = ", ".join(f"'{n}', {n}" for n in ("prompt_tokens", "completion_tokens", "total_tokens"))
    usage = f"""if(total_tokens is null, null, cast(named_struct('model', model, {counts}, 'cached_tokens', 0L, 'prompt_tokens_details', null,
        'prompt_cost', null, 'completion_cost', null, 'total_cost', null) as {USAGE}))"""
    record = F.to_json(F.try_variant_get(F.try_parse_json("metadata"), "$.eval", "variant"))
    return spans.withColumns({"usage": F.expr(usage), "eval": record})


def state_updates_as_metadata(events: DataFrame, max_updates: int = MAX_SPANS) -> DataFrame:
    """(trace_id, metadata): the node state updates of a trace in order, and whether there were more."""
    one = F.to_json(F.struct("node", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("timestamp"), F.try_parse_json("update").alias("update")))
    # at most max_updates of a trace
    kept = F.col("n") <= max_updates
    listed = _updates(events).groupBy("trace_id").agg(
        F.array_sort(F.collect_list(F.when(kept, F.struct("n", one.alias("text"))))).alias("all"), (F.max("n") > max_updates).alias("truncated")
    )
    text = F.concat(F.lit('{"node_state_updates":['), F.array_join(F.col("all.text"), ","), F.lit("]"), F.when(F.col("truncated"), ',"node_state_updates_truncated":true}').otherwise("}"))
    return listed.select("trace_id", text.alias("metadata"))


def traces_of_events(trace_events: DataFrame, events: DataFrame, spans: DataFrame) -> DataFrame:
    """Assembled traces with input, output and error of their workflow and their state updates in metadata.

    What a trace says itself goes before what its workflow span says.
    """
    io = trace_io(spans).withColumnsRenamed({"trace_id": "id", "output": "_output", "error": "_error"})
    told = state_updates_as_metadata(events).withColumnRenamed("trace_id", "id")
    whole = assemble_traces(trace_events).join(io, "id", "left").join(told, "id", "left")
    none = F.lit(None).cast("string")
    return whole.withColumns(
        {
            "output": F.coalesce("output", "_output"),
            "error": F.coalesce("error", "_error"),
            "metadata": F.coalesce("metadata", F.lit("{}")),
            "environment": none,
            "project": none,
            "http": F.lit(None).cast(HTTP),
        }
    ).drop("_output", "_error")


# What is stored of an assembled span for the row of its trace.
SPAN_FACTS = ["trace_id", "pos", "seq", "span_type", "name", "status", "end_time", "duration_ms", "inputs", "outputs", "error", "usage", "model", "eval"]


def rows_of_events(trace_events: DataFrame, events: DataFrame, own: RateCard | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """From the event log to the stored row of every trace: spans assembled, priced and rolled up."""
    whole = assemble_spans(events, own)
    # stored once, with the payload that goes into a row: a workflow's input, output and error, and a tool's input
    flow, tool = F.col("span_type") == "workflow", F.col("span_type") == "tool"
    needed = {"inputs": F.when(flow | tool, F.col("inputs")), "outputs": F.when(flow, F.col("outputs")), "error": F.when(flow, F.col("error"))}
    spans = stored(whole.select(*SPAN_FACTS).withColumns(needed), "assembled")
    return trace_rows(traces_of_events(trace_events, events, spans), spans, own, keep=keep)


def custom_spans(events: DataFrame) -> DataFrame:
    """Spans a program opened itself: completed when they end, failed with the exception otherwise."""
    own = events.filter(F.col("kind") == "custom")
    names = own.filter(F.col("phase") == "start").select("trace_id", F.col("run_id").alias("id"), "name")
    return close_spans(pair_events(own)).join(names, ["trace_id", "id"]).withColumn("span_type", F.lit("custom"))


def trace_io(spans: DataFrame) -> DataFrame:
    """Per trace: input of its first workflow span, output of the first one to finish, first error."""
    flows = spans.filter(F.col("span_type") == "workflow")

    def first(value: str, condition: Column, order: str) -> Column:
        usable = condition & F.col(value).isNotNull()
        return F.min_by(F.when(usable, F.col(value)), F.when(usable, F.struct(order, "seq")))

    status = F.col("status")
    return flows.groupBy("trace_id").agg(
        first("inputs", F.lit(True), "seq").alias("input"),
        first("outputs", status == "completed", "end_time").alias("output"),
        first("error", status == "failed", "end_time").alias("error"),
    )


def node_state_updates(events: DataFrame, max_updates: int = MAX_SPANS) -> tuple[DataFrame, DataFrame]:
    """((trace_id, n, node, update, ts) in order, capped; per trace how many and whether truncated).

    Covers chain runs tagged with a node that ended with an object.
    """
    updates = _updates(events)
    kept = updates.filter(F.col("n") <= max_updates)
    report = updates.groupBy("trace_id").agg(F.count("*").alias("updates")).withColumn(
        "truncated", F.col("updates") > max_updates
    )
    return kept.select("trace_id", "n", "node", "update", "ts"), report


def _updates(events: DataFrame) -> DataFrame:
    """(trace_id, n, node, update, ts) of all state updates; the tag and the ends of a run meet by one shuffle of chain events."""
    starts = F.col("phase") == "start"
    is_object = F.try_variant_get(F.try_parse_json("outputs"), "$", "map<string,variant>").isNotNull()
    tag = F.when(starts, _node("metadata"))
    chains = events.filter((F.col("kind") == "chain") & (starts | ((F.col("phase") == "end") & is_object))).select(
        "trace_id", "run_id", "seq", "ts", "phase", F.when(~starts, F.col("outputs")).alias("update"), tag.alias("_tag")
    )
    run = Window.partitionBy("trace_id", "run_id")
    tagged = chains.withColumn("node", F.max("_tag").over(run)).filter((F.col("phase") == "end") & F.col("node").isNotNull())
    return tagged.withColumn("n", F.row_number().over(Window.partitionBy("trace_id").orderBy("seq")))


def assemble_traces(trace_events: DataFrame) -> DataFrame:
    """Traces from (trace_id, seq, ts, phase start|finish, name, status, output, error).

    The first finish fixes the end. A later one may only change the status (not back to running),
    the output and the error.
    """
    begins = F.col("phase") == "start"

    def last(value: Column, condition: Column) -> Column:
        usable = condition & value.isNotNull()
        return F.max_by(F.when(usable, value), F.when(usable, F.col("seq")))

    grouped = trace_events.groupBy("trace_id").agg(
        F.min_by(F.when(begins, F.struct("ts", "name")), F.when(begins, F.col("seq"))).alias("start"),
        F.min_by(F.when(~begins, F.col("ts")), F.when(~begins, F.col("seq"))).alias("end_time"),
        last(F.col("status"), ~begins & (F.col("status") != "running")).alias("status"),
        last(F.col("output"), ~begins).alias("output"),
        last(F.col("error"), ~begins).alias("error"),
    )
    return grouped.filter(F.col("start").isNotNull()).select(
        F.col("trace_id").alias("id"), "start.name", F.coalesce("status", F.lit("running")).alias("status"),
        F.col("start.ts").alias("start_time"), "end_time",
        F.when(F.col("end_time").isNotNull(), duration_ms(F.col("start.ts"), F.col("end_time"))).alias("duration_ms"),
        "output", "error",
    )


def flatten_messages(messages: Column) -> Column:
    """Nested lists of chat messages as one list; empty optional fields become null."""

    def plain(message: Column) -> Column:
        def filled(name: str) -> Column:
            value = message[name]
            return F.when(~value.isin("", "[]", "{}", "null"), value).alias(name)

        optional = [filled(n) for n in ("name", "tool_calls", "additional_kwargs", "response_metadata")]
        return F.struct(message["type"].alias("type"), message["content"].alias("content"), *optional)

    return F.transform(F.flatten(messages), plain)


def merge_metadata(traces: DataFrame, updates: DataFrame) -> DataFrame:
    """Apply (trace_id, seq, update) JSON objects to trace metadata in order; later keys win."""
    fields = F.try_variant_get(F.try_parse_json("update"), "$", "map<string,variant>")
    texts = F.transform_values(fields, lambda _, value: F.to_json(value))
    each = updates.select("trace_id", "seq", F.explode(texts).alias("key", "value"))
    last = each.groupBy("trace_id", "key").agg(F.max_by("value", "seq").alias("value"))
    merged = last.groupBy(F.col("trace_id").alias("id")).agg(
        map_to_json(F.map_from_entries(F.collect_list(F.struct("key", "value")))).alias("_update")
    )
    joined = traces.join(merged, "id", "left")
    metadata = F.when(F.col("_update").isNull(), F.col("metadata")).otherwise(
        merged_metadata(F.col("metadata"), F.col("_update"))
    )
    return joined.withColumn("metadata", metadata).drop("_update")
