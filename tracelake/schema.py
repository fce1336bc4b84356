"""Column layouts of traces, spans, span events and requests.

Documents are read with VARIANT for every free-form field. Inside the library those fields are
canonical JSON text (sorted keys), because text can be grouped, joined and compared.
"""

from __future__ import annotations

SPAN_TYPES = ["workflow", "node", "llm", "tool", "http", "custom", "eval"]
STATUSES = ["running", "completed", "failed"]

HTTP = (
    "struct<method:string,path:string,url:string,status_code:int,client_ip:string,"
    "headers:map<string,string>,query_params:map<string,string>>"
)
TOPOLOGY = (
    "struct<nodes:array<struct<id:string,name:string>>,"
    "edges:array<struct<source:string,target:string,conditional:boolean,data:string>>>"
)
MONEY = "decimal(18,6)"
USAGE = (
    "struct<model:string,prompt_tokens:bigint,completion_tokens:bigint,total_tokens:bigint,"
    "cached_tokens:bigint,prompt_tokens_details:struct<cached_tokens:bigint>,"
    f"prompt_cost:{MONEY},completion_cost:{MONEY},total_cost:{MONEY}>"
)


def _span(free: str, time: str) -> str:
    return (
        f"struct<id:string,trace_id:string,parent_id:string,name:string,span_type:string,"
        f"status:string,start_time:{time},end_time:{time},duration_ms:double,"
        f"inputs:{free},outputs:{free},state_diff:{free},error:{free},metadata:{free}>"
    )


def _trace(free: str, time: str) -> str:
    return (
        "id string, name string, status string, environment string, project string, "
        f"start_time {time}, end_time {time}, duration_ms double, http {HTTP}, "
        f"input {free}, output {free}, error {free}, metadata {free}, "
        f"spans array<{_span(free, time)}>, graph_topology {TOPOLOGY}"
    )


RAW_TRACE = _trace("variant", "string") + ", _corrupt_record string"
TRACE = _trace("string", "timestamp")
SPAN = _span("string", "timestamp")
FREE_TRACE_FIELDS = ["input", "output", "error", "metadata"]
FREE_SPAN_FIELDS = ["inputs", "outputs", "state_diff", "error", "metadata"]

EVENT = (
    "seq bigint, ts timestamp, trace_id string, run_id string, parent_run_id string, kind string, "
    "phase string, name string, serialized string, tags array<string>, metadata string, "
    "invocation_params string, inputs string, outputs string, llm_output string, "
    "error_type string, error_message string, traceback string"
)
REQUEST = "request_id string, client string, ts timestamp"

ROW = (
    "id string, name string, status string, start_time timestamp, end_time timestamp, duration_ms double, "
    "http_method string, http_path string, http_status_code int, total_spans bigint, total_tokens bigint, "
    f"llm_calls bigint, estimated_cost {MONEY}, has_error boolean, project string, node_counts map<string,bigint>, "
    "eval_status string, eval_count bigint, has_tool_loop boolean, model_counts map<string,bigint>, "
    "node_metrics array<struct<name:string,duration_ms:double,status:string>>, start_date date, environment string"
)

# Columns added to stored tables after their first release, with the value old rows take.
LATE_ROW_COLUMNS = {
    "estimated_cost": (MONEY, 0),
    "environment": ("string", "production"),
    "project": ("string", None),
    "node_counts": ("map<string,bigint>", None),
    "eval_status": ("string", None),
    "eval_count": ("bigint", 0),
    "has_tool_loop": ("boolean", False),
    "model_counts": ("map<string,bigint>", None),
    "node_metrics": ("array<struct<name:string,duration_ms:double,status:string>>", None),
}
