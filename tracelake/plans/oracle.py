"""Reference SQL for the registered queries, over the sample tables.

Each text builds the same traces, spans and prices from the tables and computes one result from
them with plain SQL.
"""

from __future__ import annotations

from tracelake.functions.rates import CACHED_RATES, FAMILIES, MODEL_RATES
from tracelake.functions.text import MASK_RULES

AS_OF = "TIMESTAMP '2001-08-02 00:00:00'"

TRACES = """
t AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS id,
         'wf_' || CAST(o_custkey % 6 AS VARCHAR) AS name,
         CASE o_orderstatus WHEN 'O' THEN 'running' WHEN 'F' THEN 'failed' ELSE 'completed' END AS status,
         CASE WHEN o_orderkey % 50 = 0 THEN NULL WHEN o_custkey % 3 = 0 THEN 'production'
              WHEN o_custkey % 3 = 1 THEN 'staging' ELSE 'development' END AS environment,
         CASE WHEN o_custkey % 7 <> 0 THEN 'proj_' || CAST(o_custkey % 5 AS VARCHAR) END AS project,
         o_orderdate + to_seconds((o_orderkey * 7919) % 86400) AS start_time,
         CASE WHEN o_orderstatus <> 'O' THEN o_orderdate + to_seconds((o_orderkey * 7919) % 86400 + 1) END AS end_time,
         CASE WHEN o_orderstatus <> 'O' THEN o_totalprice END AS duration_ms,
         '/api/wf_' || CAST(o_custkey % 6 AS VARCHAR) AS http_path,
         CASE o_orderstatus WHEN 'F' THEN 500 WHEN 'O' THEN NULL ELSE 200 END AS http_status_code,
         CASE WHEN o_orderstatus = 'F' AND o_orderkey % 2 = 0 THEN '{"type":"E"}' END AS error,
         o_orderkey, o_custkey
  FROM orders
)"""

SPANS = """
l AS (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey,
           l_quantity, l_extendedprice, l_discount, l_shipdate) AS seq
  FROM lineitem
), lk AS (
  SELECT *, CASE WHEN seq = 1 THEN 'workflow' WHEN l_partkey % 10 <= 3 THEN 'llm' WHEN l_partkey % 10 <= 6 THEN 'tool'
                 WHEN l_partkey % 10 <= 8 THEN 'node' ELSE 'eval' END AS span_type,
         list_extract(['openai/gpt-4o', 'gpt_4o_mini', 'claude-3-5-haiku', 'gpt-4o-2024-08-06', 'models/gemini-1.5-pro',
           'llama-3.1-8b:latest', 'gpt-5.7-preview', 'totally-unknown'], CAST(l_suppkey % 8 + 1 AS BIGINT)) AS raw_model,
         CAST(l_quantity AS INTEGER) AS q
  FROM l
), s AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS trace_id,
         CAST(l_orderkey AS VARCHAR) || '-' || CAST(seq AS VARCHAR) AS id,
         CASE WHEN seq > 1 THEN CAST(l_orderkey AS VARCHAR) || '-' || CAST(seq // 2 AS VARCHAR) END AS parent_id,
         CAST(seq - 1 AS BIGINT) AS pos, span_type, raw_model,
         CASE span_type WHEN 'workflow' THEN 'workflow'
              WHEN 'llm' THEN (CASE WHEN l_suppkey % 2 = 1 THEN 'Chat: ' ELSE 'LLM: ' END) || raw_model
              WHEN 'tool' THEN 'Tool: tool_' || CAST(l_partkey % 2 AS VARCHAR)
              WHEN 'node' THEN 'node_' || CAST(l_suppkey % 8 AS VARCHAR)
              ELSE 'Eval: eval_' || CAST(l_suppkey % 3 AS VARCHAR) END AS name,
         CASE WHEN l_returnflag = 'R' AND (l_partkey % 4 = 0 OR l_partkey % 10 = 9) THEN 'failed' ELSE 'completed' END AS status,
         l_extendedprice AS duration_ms,
         CASE WHEN span_type = 'tool' THEN '{"q":' || CAST(l_suppkey % 2 AS VARCHAR) || '}'
              WHEN span_type = 'node' THEN '{"a":' || CAST(q AS VARCHAR) || ',"items":[1]}' END AS inputs,
         CASE WHEN span_type = 'node' THEN CASE l_suppkey % 4
              WHEN 0 THEN '{"a":' || CAST(q AS VARCHAR) || ',"items":[1]}'
              WHEN 1 THEN '{"a":' || CAST(q + 1 AS VARCHAR) || ',"items":[1]}'
              WHEN 2 THEN '{"a":' || CAST(q AS VARCHAR) || ',"items":[1,2]}'
              ELSE '{"a":' || CAST(q AS VARCHAR) || ',"b":1}' END END AS outputs,
         CAST(l_quantity * 100 AS BIGINT) AS prompt, l_partkey % 500 AS completion,
         CASE WHEN l_discount >= 0.05 THEN CAST(l_quantity * 100 AS BIGINT) // 2 ELSE 0 END AS cached,
         CASE WHEN l_linenumber % 5 = 0 THEN 0 ELSE CAST(l_quantity * 100 AS BIGINT) + l_partkey % 500 END AS given,
         l_suppkey, q, seq
  FROM lk
)"""


def _card() -> str:
    rows = ", ".join(
        f"('{m}', CAST('{p}' AS DECIMAL(12,6)), CAST('{c}' AS DECIMAL(12,6)), "
        f"CAST({repr(CACHED_RATES[m]) if m in CACHED_RATES else 'NULL'} AS DECIMAL(12,6)))"
        for m, (p, c) in MODEL_RATES.items()
    )
    return f"card(model, p, c, k) AS (VALUES {rows})"


def _families() -> str:
    rows = ", ".join(
        f"({i}, '{words[0]}', '{words[1] if len(words) > 1 else ''}', '{model}')" for i, (words, model) in enumerate(FAMILIES)
    )
    return f"fam(i, w1, w2, model) AS (VALUES {rows})"


def normal(col: str) -> str:
    return (
        f"CASE WHEN {col} IS NULL OR {col} = '' THEN 'unknown' ELSE "
        f"replace(split_part(list_extract(string_split(lower(trim({col})), '/'), -1), ':', 1), '_', '-') END"
    )


def rates(models: str) -> str:
    """CTE ``rate``(model, n, p, c, k) for the models of a query."""
    return f"""
{_card()}, {_families()},
nm AS (SELECT DISTINCT model, {normal('model')} AS n FROM ({models})),
pre AS (SELECT n, arg_max(card.model, length(card.model)) AS key FROM (SELECT DISTINCT n FROM nm WHERE n <> 'unknown')
        JOIN card ON starts_with(n, card.model) GROUP BY n),
fb AS (SELECT n, arg_min(fam.model, fam.i) AS key FROM (SELECT DISTINCT n FROM nm WHERE n <> 'unknown')
       JOIN fam ON contains(n, w1) AND contains(n, w2) GROUP BY n),
ck AS (SELECT n, arg_max(card.k, length(card.model)) AS k FROM (SELECT DISTINCT n FROM nm WHERE n <> 'unknown')
       JOIN card ON card.k IS NOT NULL AND starts_with(n, card.model) GROUP BY n),
rate AS (SELECT nm.model, nm.n, card.p, card.c, ck.k FROM nm LEFT JOIN pre USING (n) LEFT JOIN fb USING (n)
         LEFT JOIN ck USING (n) LEFT JOIN card ON card.model = coalesce(pre.key, fb.key))"""


CALLS = (
    SPANS
    + ", "
    + rates("SELECT DISTINCT raw_model AS model FROM lk WHERE span_type = 'llm'")
    + """,
cs AS (
  SELECT s.trace_id, s.id, s.pos, r.n AS model, r.p IS NOT NULL AS is_estimated, prompt, completion, cached,
         CASE WHEN given = 0 THEN prompt + completion ELSE given END AS total,
         coalesce(CASE WHEN cached > 0 AND r.k IS NOT NULL
              THEN CAST(greatest(prompt - cached, 0) AS DECIMAL(12,0)) * r.p + CAST(cached AS DECIMAL(12,0)) * r.k
              ELSE CAST(prompt AS DECIMAL(12,0)) * r.p END, 0) AS pin,
         coalesce(CAST(completion AS DECIMAL(12,0)) * r.c, 0) AS pout
  FROM s JOIN rate r ON r.model = s.raw_model WHERE span_type = 'llm'
), calls AS (
  SELECT trace_id, id, pos, model, is_estimated, prompt, completion, cached, total,
         CAST(round(CAST(pin AS DECIMAL(24,6)) * CAST(0.000001 AS DECIMAL(7,6)), 6) AS DECIMAL(18,6)) AS prompt_cost,
         CAST(round(CAST(pout AS DECIMAL(24,6)) * CAST(0.000001 AS DECIMAL(7,6)), 6) AS DECIMAL(18,6)) AS completion_cost,
         CAST(round(CAST(pin + pout AS DECIMAL(24,6)) * CAST(0.000001 AS DECIMAL(7,6)), 6) AS DECIMAL(18,6)) AS total_cost
  FROM cs
)"""
)

LOOPS = """
ti AS (SELECT trace_id, replace(name, 'Tool: ', '') AS tool, inputs, count(*) AS n, min(pos) AS pos FROM s
       WHERE span_type = 'tool' GROUP BY ALL),
tool AS (SELECT trace_id, tool, sum(n) AS calls, count(*) AS distinct_inputs, min(pos) AS first_pos FROM ti GROUP BY ALL),
lp AS (SELECT trace_id, arg_min(tool, first_pos) AS tool_loop_tool, arg_min(calls, first_pos) AS tool_loop_count FROM tool
       WHERE calls >= 5 OR (calls >= 3 AND calls - distinct_inputs >= 2) GROUP BY trace_id)"""

# One row per trace with everything the analytics need; maps and lists stay in their own CTEs.
ROWS = (
    TRACES
    + ", "
    + CALLS
    + ", "
    + LOOPS
    + """,
tc AS (SELECT trace_id, count(*) AS llm_calls, CAST(sum(total) AS BIGINT) AS total_tokens, CAST(sum(prompt) AS BIGINT) AS prompt_tokens,
              CAST(sum(completion) AS BIGINT) AS completion_tokens, sum(total_cost) AS total_cost,
              sum(prompt_cost) AS prompt_cost, sum(completion_cost) AS completion_cost FROM calls GROUP BY trace_id),
ts AS (SELECT trace_id, count(*) AS total_spans, bool_or(status = 'failed') AS failed,
              count(*) FILTER (WHERE span_type = 'eval') AS eval_count,
              bool_and(status = 'completed') FILTER (WHERE span_type = 'eval') AS all_passed FROM s GROUP BY trace_id),
nc AS (SELECT trace_id, name AS node_name, count(*) AS executions, count(*) FILTER (WHERE status = 'failed') AS failed
       FROM s WHERE span_type = 'node' GROUP BY ALL),
mc AS (SELECT trace_id, model, count(*) AS calls FROM calls GROUP BY ALL),
r AS (
  SELECT t.id, t.name, CASE WHEN t.status = 'completed' AND coalesce(ts.failed, FALSE) THEN 'failed' ELSE t.status END AS status,
         t.start_time, t.end_time, t.duration_ms, 'POST' AS http_method, t.http_path, CAST(t.http_status_code AS BIGINT) AS http_status_code,
         coalesce(ts.total_spans, 0) AS total_spans, coalesce(tc.total_tokens, 0) AS total_tokens,
         coalesce(tc.llm_calls, 0) AS llm_calls, CAST(coalesce(tc.total_cost, 0) AS DECIMAL(18,6)) AS cost,
         coalesce(ts.failed, FALSE) OR t.error IS NOT NULL AS has_error,
         coalesce(t.environment, 'production') AS environment, t.project,
         CASE WHEN coalesce(ts.eval_count, 0) > 0 THEN CASE WHEN all_passed THEN 'passed' ELSE 'failed' END END AS eval_status,
         coalesce(ts.eval_count, 0) AS eval_count, lp.trace_id IS NOT NULL AS has_tool_loop, t.o_orderkey, t.o_custkey
  FROM t LEFT JOIN tc ON tc.trace_id = t.id LEFT JOIN ts ON ts.trace_id = t.id LEFT JOIN lp ON lp.trace_id = t.id
)"""
)

TIME = "strftime({}, '%Y-%m-%d %H:%M:%S.%f')"


def time(col: str) -> str:
    return TIME.format(col)


def cents(col: str) -> str:
    return f"CAST(CAST({col} AS DECIMAL(18,2)) * 100 AS BIGINT)"


def half_up(num: str, den: str, scale: int) -> str:
    f = 10**scale
    return (
        f"coalesce(CAST((CAST({num} AS HUGEINT) * {2 * f} + CAST({den} AS HUGEINT)) // nullif(CAST({den} AS HUGEINT) * 2, 0) AS DOUBLE)"
        f" / CAST({f} AS DOUBLE), 0.0)"
    )


def pct(part: str, whole: str) -> str:
    return half_up(f"({part}) * 100", f"({whole})", 1)


def masked(col: str) -> str:
    for pattern, placeholder in MASK_RULES:
        quoted = pattern.replace("'", "''")
        col = f"regexp_replace({col}, '{quoted}', '{placeholder}', 'g')"
    return col


def find_counts(col: str) -> str:
    parts = []
    for pattern, placeholder in MASK_RULES:
        quoted = pattern.replace("'", "''")
        tag = placeholder.strip("[]").lower().removesuffix("_redacted")
        parts.append(f"len(regexp_extract_all({col}, '{quoted}')) AS n_{tag}")
        col = f"regexp_replace({col}, '{quoted}', '{placeholder}', 'g')"
    return ", ".join(parts)


SUMMARY = (
    "id, name, status, environment, project, " + time("start_time") + " AS start_time, " + time("end_time") + " AS end_time, duration_ms, "
    "http_method, http_path, http_status_code, total_spans, total_tokens, llm_calls, CAST(cost AS DOUBLE) AS estimated_cost, has_error, "
    "eval_status, eval_count, has_tool_loop"
)
