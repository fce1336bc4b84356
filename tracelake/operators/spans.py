"""Span rows: flattening, order, limits, parents, trees, waterfalls and graph topology."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.operators.ranking import row_numbers
from tracelake.schema import USAGE
from tracelake.session import cut_lineage, stored

MAX_SPANS = 1000


def _metadata(span: Column) -> Column:
    return F.try_parse_json(span["metadata"])


def spans_of(traces: DataFrame) -> DataFrame:
    """One row per span of typed trace documents, with its ordinal and its typed usage."""
    flat = traces.select(F.col("id").alias("_trace"), F.posexplode("spans").alias("pos", "span"))
    flat = flat.withColumn("_meta", _metadata(F.col("span")))
    return flat.select(
        F.col("_trace").alias("trace_id"),
        "span.id", "span.parent_id", "pos", "span.name", "span.span_type", "span.status",
        "span.start_time", "span.end_time", "span.duration_ms", "span.inputs", "span.outputs",
        "span.state_diff", "span.error", "span.metadata",
        F.try_variant_get("_meta", "$.usage", USAGE).alias("usage"),
        F.try_variant_get("_meta", "$.model", "string").alias("model"),
        F.to_json(F.try_variant_get("_meta", "$.eval", "variant")).alias("eval"),
    )


def nest_spans(spans: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """(trace_id, spans): all spans in order as one array; ``cap_spans`` first where a limit is wanted."""
    fields = fields or [c for c in spans.columns if c not in ("trace_id", "pos")]
    packed = F.array_sort(F.collect_list(F.struct("pos", F.struct(*fields).alias("span"))))
    return spans.groupBy("trace_id").agg(F.transform(packed, lambda x: x["span"]).alias("spans"))


def spans_of_type(spans: DataFrame, span_type: str) -> DataFrame:
    return spans.filter(F.col("span_type") == span_type)


def span_order(spans: DataFrame) -> DataFrame:
    """Ordinal of each span in its trace by start, then id, numbered slice by slice."""
    slices = ["date_trunc('second', start_time)", "start_time", "substr(id, 1, 4)"]
    numbered = row_numbers(spans, "trace_id", ["start_time", "id"], slices, "_n")
    return numbered.withColumn("pos", F.col("_n") - 1).drop("_n")


def cap_spans(spans: DataFrame, max_spans: int = MAX_SPANS) -> tuple[DataFrame, DataFrame]:
    """(kept spans, per-trace report of what was dropped); ``pos`` is the start order.

    ``pos`` is already a rank, so the cap is a filter, and the report is a plain count.
    """
    kept = spans.filter(F.col("pos") < max_spans)
    report = spans.groupBy("trace_id").agg(F.count("*").alias("n")).select(
        "trace_id",
        F.least("n", F.lit(max_spans)).cast("bigint").alias("kept_spans_count"),
        F.greatest(F.col("n") - max_spans, F.lit(0)).cast("bigint").alias("dropped_spans_count"),
        (F.col("n") > max_spans).alias("spans_truncated"),
    )
    return kept, report


def with_parent(spans: DataFrame) -> DataFrame:
    """Adds parent_name and parent_type; a parent that is not in the trace becomes null.

    A parent may have very many children; AQE splits such a key, since the parent side is unique: of spans that share an
    id the first one counts.
    """
    first = F.min(F.struct("pos", "name", "span_type")).alias("_first") if "pos" in spans.columns else F.min(F.struct("name", "span_type")).alias("_first")
    parents = spans.groupBy("trace_id", F.col("id").alias("parent_id")).agg(first).select(
        "trace_id",
        "parent_id",
        F.col("_first.name").alias("parent_name"),
        F.col("_first.span_type").alias("parent_type"),
        F.lit(True).alias("_known"),
    )
    joined = spans.join(parents, ["trace_id", "parent_id"], "left")
    return joined.withColumn("parent_id", F.when(F.col("_known"), F.col("parent_id"))).drop("_known")


def climb(links: DataFrame) -> DataFrame:
    """Follow (trace_id, id) -> up to the top by doubling the reach of every row each round.

    ``links`` holds trace_id, id, up (null at a top) and label. Returns trace_id, id, top, depth and
    path (labels from the top down). A chain of depth d takes log2(d) rounds; members of a cycle
    never reach a top and come back with a null depth.
    """
    state = links.select(
        "trace_id", "id", "up", F.col("id").alias("top"), F.lit(0).cast("bigint").alias("depth"),
        F.array("label").alias("path"),
    )
    state = cut_lineage(state)
    while True:
        open_rows = state.filter(F.col("up").isNotNull())
        still = open_rows.count()
        if not still:
            break
        above = state.select(
            "trace_id",
            F.col("id").alias("up"),
            F.col("up").alias("_up"),
            F.col("top").alias("_top"),
            F.col("depth").alias("_depth"),
            F.col("path").alias("_path"),
        )
        step = open_rows.join(above, ["trace_id", "up"]).select(
            "trace_id", "id", F.col("_up").alias("up"), F.col("_top").alias("top"),
            (F.col("depth") + F.col("_depth") + 1).alias("depth"),
            F.concat("_path", "path").alias("path"),
        )
        state = cut_lineage(state.filter(F.col("up").isNull()).unionByName(step))
        # Every round closes at least one row unless all that is left hangs on a cycle.
        if state.filter(F.col("up").isNotNull()).count() == still:
            break
    done = F.col("up").isNull()
    return state.select(
        "trace_id", "id", F.when(done, F.col("top")).alias("top"),
        F.when(done, F.col("depth")).alias("depth"), F.when(done, F.col("path")).alias("path"),
    )


#: Spans of a trace up to which its tree is numbered in one piece; larger ones are climbed by doubling.
LARGE = 200_000
_INTERVALS = (
    "trace_id string, id string, enter bigint, leave bigint, depth bigint, root_id string, children bigint, is_orphan boolean"
)


def _numbered(paths: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Walks each trace of a batch from its roots down, numbering spans as it enters and leaves them."""
    names = [part.split(" ")[0] for part in _INTERVALS.split(", ")]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # spans of the whole batch by column: places in it stand for spans, and names are only looked up at the end
            sizes = batch.column(1).value_lengths().to_numpy(zero_copy_only=False)
            flat = batch.column(1).flatten()
            ids, parents = flat.field("id").to_pylist(), flat.field("parent_id").to_pylist()
            enter, leave, depth, root = ([None] * len(ids) for _ in range(4))
            children, orphan = [0] * len(ids), [False] * len(ids)
            way: list[list[int] | None] = [None] * len(ids)
            end = 0
            for size in sizes.tolist():
                begin, end = end, end + size
                first: dict[str, int] = {}
                below: dict[str, list[int]] = {}
                for k in range(begin, end):
                    first.setdefault(ids[k], k)
                    if parents[k] is not None:
                        below.setdefault(parents[k], []).append(k)
                clock, stack = 0, []
                for k in range(end - 1, begin - 1, -1):
                    children[k] = len(below.get(ids[k], ()))
                    orphan[k] = parents[k] is not None and parents[k] not in first
                    if parents[k] is None or orphan[k]:
                        stack.append((k, 0, k, -1))
                while stack:
                    k, deep, top, above = stack.pop()
                    if k < 0:  # all below have been numbered
                        leave[~k] = clock
                        continue
                    clock += 1
                    enter[k], depth[k], root[k] = clock, deep, top
                    if paths:
                        way[k] = [*way[above], k] if above >= 0 else [k]
                    # of spans that share an id the first one is the parent
                    if children[k] and first[ids[k]] == k:
                        stack.append((~k, 0, 0, -1))
                        stack += [(c, deep + 1, top, k) for c in reversed(below[ids[k]])]
                    else:
                        leave[k] = clock
            columns = [
                batch.column(0).take(pa.array(np.repeat(np.arange(len(batch)), sizes))), flat.field("id"), pa.array(enter, pa.int64()),
                pa.array(leave, pa.int64()), pa.array(depth, pa.int64()), flat.field("id").take(pa.array(root, pa.int64())),
                pa.array(children, pa.int64()), pa.array(orphan, pa.bool_()),
            ]
            if paths:
                ways = pa.array(way, pa.list_(pa.int64()))
                columns.append(pa.ListArray.from_arrays(ways.offsets, flat.field("name").take(ways.values), mask=ways.is_null()))
            yield pa.RecordBatch.from_arrays(columns, [*names, *(["path"] if paths else [])])

    return walk


def span_intervals(spans: DataFrame, paths: bool = False) -> DataFrame:
    """Per span: when a walk through its trace enters and leaves it, depth, root, number of children, whether its parent is missing.

    A span lies below another of its trace if it is entered after and not later than that one is left: leave - enter
    spans lie below it. One shuffle brings a trace's ids together. Members of a cycle have no numbers.
    """
    one = F.struct("id", "parent_id", *(["name"] if paths else []))
    nested = spans.groupBy("trace_id").agg(F.collect_list(one).alias("spans"))
    return nested.mapInArrow(_numbered(paths), _INTERVALS + (", path array<string>" if paths else ""))


def span_tree(spans: DataFrame, paths: bool = True) -> DataFrame:
    """Per span: root, depth, path of names (if wanted), number of children, and whether its parent is missing.

    Traces of more than ``LARGE`` spans are not held in one piece: their spans climb to the top by doubling.
    """
    columns = ["trace_id", "id", "root_id", "depth", *(["path"] if paths else []), "children", "is_orphan"]
    sizes = spans.groupBy("trace_id").agg(F.count("*").alias("_size"))
    large = sizes.filter(F.col("_size") > LARGE).select("trace_id")
    if large.isEmpty():
        return span_intervals(spans, paths).select(*columns)
    climbed = _climbed_tree(spans.join(large, "trace_id", "left_semi")).select(*columns)
    return span_intervals(spans.join(large, "trace_id", "left_anti"), paths).select(*columns).unionByName(climbed)


def _climbed_tree(spans: DataFrame) -> DataFrame:
    """``span_tree`` of traces of any size. Only spans that have children are climbed; the many leaves below them are joined once."""
    spans = cut_lineage(spans.select("trace_id", "id", "parent_id", "name"))
    children = spans.filter(F.col("parent_id").isNotNull()).groupBy("trace_id", F.col("parent_id").alias("id")).agg(
        F.count("*").alias("children")
    )
    counted = spans.join(children, ["trace_id", "id"], "left")
    inner = counted.filter(F.col("children") > 0)
    inner = inner.dropDuplicates(["trace_id", "id"])  # spans may share an id; one of them is the parent
    known = inner.select("trace_id", F.col("id").alias("parent_id"), F.col("id").alias("up"))
    links = inner.join(known, ["trace_id", "parent_id"], "left").select(
        "trace_id", "id", "up", F.col("name").alias("label")
    )
    above = climb(links).select(
        "trace_id", F.col("id").alias("parent_id"), "top", F.col("depth").alias("above"), "path", F.lit(True).alias("found")
    )
    joined = counted.join(above, ["trace_id", "parent_id"], "left")
    found = F.col("found").isNotNull()
    return joined.select(
        "trace_id",
        "id",
        F.when(found, F.col("top")).otherwise(F.col("id")).alias("root_id"),
        F.when(found, F.col("above") + 1).otherwise(F.lit(0)).alias("depth"),
        F.when(found, F.concat("path", F.array("name"))).otherwise(F.array("name")).alias("path"),
        F.coalesce("children", F.lit(0)).alias("children"),
        (F.col("parent_id").isNotNull() & ~found).alias("is_orphan"),
    )


def span_waterfall(traces: DataFrame, spans: DataFrame) -> DataFrame:
    """Per span: offset from the start of its trace in ms, duration and depth."""
    begun = traces.select(F.col("id").alias("trace_id"), F.col("start_time").alias("_begun"))
    return _waterfall(spans, spans.join(begun, "trace_id"))


def _waterfall(spans: DataFrame, begun: DataFrame) -> DataFrame:
    """``span_waterfall`` of spans and of the same spans with the start of their trace."""
    depth = span_tree(spans, paths=False).select("trace_id", "id", "depth")
    offset = (F.unix_micros("start_time") - F.unix_micros("_begun")).cast("double") / F.lit(1000.0)
    return begun.select("trace_id", "id", "name", offset.alias("offset_ms"), "duration_ms").join(depth, ["trace_id", "id"])


def nested_waterfall(traces: DataFrame) -> DataFrame:
    """``span_waterfall`` of typed documents with ids of their own.

    They are read once, for a few words per span that are stored: of rows parsed from text the planner may expect far fewer
    bytes than there are, and broadcast them through the driver.
    """
    each = traces.select(F.col("id").alias("trace_id"), F.col("start_time").alias("_begun"), F.explode("spans").alias("span"))
    few = ["span.id", "span.parent_id", "span.name", "span.start_time", "span.duration_ms"]
    rows = stored(each.select("trace_id", "_begun", *few), "waterfall")
    return _waterfall(rows, rows)


def topology_nodes(traces: DataFrame) -> DataFrame:
    """Nodes of each trace's graph in order, always with a start first and an end last if missing."""
    nodes = F.col("graph_topology.nodes")

    def terminal(name: str) -> Column:
        return F.struct(F.lit(name).alias("id"), F.lit(name).alias("name"))

    def lacks(*names: str) -> Column:
        return ~F.exists(nodes, lambda node: node["id"].isin(*names))

    none = F.slice(nodes, 1, 0)
    first = F.when(lacks("__start__", "START"), F.array(terminal("__start__"))).otherwise(none)
    last = F.when(lacks("__end__", "END"), F.array(terminal("__end__"))).otherwise(none)
    full = traces.filter(nodes.isNotNull()).select(
        F.col("id").alias("trace_id"), F.posexplode(F.concat(first, nodes, last)).alias("pos", "node")
    )
    return full.select("trace_id", "pos", "node.id", "node.name")


def topology_edges(traces: DataFrame) -> DataFrame:
    edges = traces.select(F.col("id").alias("trace_id"), F.posexplode("graph_topology.edges").alias("pos", "edge"))
    return edges.select(
        "trace_id", "pos", "edge.source", "edge.target",
        F.coalesce("edge.conditional", F.lit(False)).alias("conditional"), F.col("edge.data").alias("label"),
    )
