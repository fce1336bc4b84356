"""Filters over trace rows, summaries, newest-first pages and counts."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.functions.numbers import parse_iso
from tracelake.functions.text import PRIVATE_HEADERS
from tracelake.operators.metrics import default_environment

PAGE_LIMIT = 500
DEFAULT_LIMIT = 50
SEARCHED = ["name", "http_path", "id", "project"]
# Request paths that are never traced.
UNTRACED_PATHS = ["/observe", "/favicon.ico", "/docs", "/openapi.json"]

SUMMARY = {
    "total_spans": 0,
    "total_tokens": 0,
    "llm_calls": 0,
    "estimated_cost": 0,
    "has_error": False,
    "eval_count": 0,
    "has_tool_loop": False,
}


def same_text(column: Column, value: str) -> Column:
    return F.lower(column) == F.lower(F.lit(value))


def instant(value: datetime | str) -> Column:
    return parse_iso(F.lit(value)) if isinstance(value, str) else F.lit(value).cast("timestamp")


def in_time_range(column: Column, start: datetime | str | None, end: datetime | str | None) -> Column:
    """Both ends inclusive; an open end is no condition. Bare comparisons, so they reach the scan."""
    condition = F.lit(True)
    if start:
        condition = condition & (column >= instant(start))
    if end:
        condition = condition & (column <= instant(end))
    return condition


def matches_search(term: str) -> Column:
    """The term occurs literally, in any case, in the name, path, id or project."""
    hit = F.lit(False)
    for name in SEARCHED:
        hit = hit | F.coalesce(F.contains(F.lower(F.col(name)), F.lower(F.lit(term))), F.lit(False))
    return hit


def filter_traces(rows: DataFrame, **filters: object) -> DataFrame:
    """The rows that ``matches`` describes; its keywords are the filters.

    On a stored table a time range also names the dates, so whole partitions are skipped.
    """
    condition = matches(rows, **filters)
    return rows if condition is None else rows.filter(condition)


def matches(
    rows: DataFrame,
    status: str | None = None,
    search: str | None = None,
    environment: str | None = None,
    project: str | None = None,
    from_time: datetime | str | None = None,
    to_time: datetime | str | None = None,
    eval_status: str | None = None,
) -> Column | None:
    """All given conditions must hold; an empty argument is no condition, and no condition at all is null.

    ``start_date`` is the first day of the period its metadata names; without that, of a year at most.
    """
    found: list[Column] = []
    # Statuses are stored in lower case, so a bare comparison can reach the scan.
    for name, value in {"status": status, "eval_status": eval_status}.items():
        if value:
            found.append(F.col(name) == value.lower())
    for name, value in {"environment": environment, "project": project}.items():
        if value:
            found.append(same_text(F.col(name), value))
    if from_time or to_time:
        found.append(in_time_range(F.col("start_time"), from_time, to_time))
        if "start_date" in rows.columns:
            period = rows.schema["start_date"].metadata.get("period", "year")
            if from_time:
                found.append(F.col("start_date") >= F.to_date(F.date_trunc(period, instant(from_time))))
            if to_time:
                found.append(F.col("start_date") <= F.to_date(instant(to_time)))
    if search:
        found.append(matches_search(search))
    return reduce(lambda a, b: a & b, found) if found else None


def newest_first(rows: DataFrame) -> DataFrame:
    return rows.orderBy(F.col("start_time").desc(), F.col("id"))


def recent(rows: DataFrame, n: int | None) -> DataFrame:
    """The n newest traces, or all of them for None."""
    return rows if n is None else newest_first(rows).limit(n)


def page_bounds(limit: int = DEFAULT_LIMIT, offset: int = 0, page: int | None = None) -> tuple[int, int]:
    """(limit, offset); a page number takes the place of the offset."""
    if not 1 <= limit <= PAGE_LIMIT:
        raise ValueError(f"limit must be in 1..{PAGE_LIMIT}")
    if offset < 0 or (page is not None and page < 1):
        raise ValueError("offset must not be negative and pages start at 1")
    return limit, offset if page is None else (page - 1) * limit


def trace_summaries(rows: DataFrame) -> DataFrame:
    """The columns of a list view, with nulls replaced."""
    filled = {name: F.coalesce(F.col(name), F.lit(value).cast(rows.schema[name].dataType)) for name, value in SUMMARY.items()}
    return rows.select(
        "id", "name", "status", F.expr(default_environment("environment")).alias("environment"), "project",
        "start_time", "end_time", "duration_ms", "http_method", "http_path", "http_status_code",
        *[filled[n].alias(n) for n in ("total_spans", "total_tokens", "llm_calls", "estimated_cost", "has_error")],
        "eval_status",
        *[filled[n].alias(n) for n in ("eval_count", "has_tool_loop")],
    )


def count_traces(rows: DataFrame, **filters: object) -> int:
    return filter_traces(rows, **filters).count()


def with_full_count(rows: DataFrame) -> DataFrame:
    """Every row with the number of all rows, counted once beforehand."""
    return rows.withColumn("total_count", F.lit(rows.count()).cast("bigint"))


# Offsets up to this are reached by keeping that many newest rows; beyond, newer rows are counted and left out.
SHALLOW = 1000
_MOMENTS = ("year", "day", "minute", "second")


def newest_page(rows: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """``limit`` rows after the ``offset`` newest ones, newest first.

    For deep pages rows are counted by year, then by day of the year the page starts in, and on down to the second.
    What is newer is left out by a bound on the time, which also reaches the scan, and so is what is older than the page.
    """
    bounds = {}
    for moment in _MOMENTS if offset > SHALLOW else ():
        counted = rows.groupBy(F.date_trunc(moment, "start_time").alias("at")).agg(F.count("*").alias("n"))
        # one row for each year, day of a year, minute of a day or second of a minute
        places = counted.filter("at is not null").orderBy(F.col("at").desc()).collect()
        passed, first, last = 0, None, None
        for place in places:
            if first is None and passed + place["n"] > offset:
                first, offset, passed = place["at"], offset - passed, 0
            passed += place["n"]
            if first is not None and passed >= offset + limit:
                last = place["at"]
                break
        if first is None:
            break
        # the page may go on beyond the place it starts in
        lower = F.lit(last) if last is not None else None
        upper = F.lit(first) + F.expr(f"interval 1 {moment}")
        if lower is not None:
            rows = rows.filter((F.col("start_time") < upper) & (F.col("start_time") >= lower))
        else:  # rows without a start come last
            rows = rows.filter((F.col("start_time") < upper) | F.col("start_time").isNull())
        if "start_date" in rows.columns:
            period = rows.schema["start_date"].metadata.get("period", "year")
            rows = rows.filter(F.col("start_date") <= F.to_date(F.lit(first) + F.expr(f"interval 1 {moment}")))
            if lower is not None:
                rows = rows.filter(F.col("start_date") >= F.to_date(F.date_trunc(period, lower)))
        if offset <= SHALLOW:
            break
    return newest_first(rows).offset(offset).limit(limit)


def page_after(
    rows: DataFrame, after: tuple[datetime, str] | None = None, limit: int = DEFAULT_LIMIT, **filters: object
) -> tuple[DataFrame, tuple[datetime, str] | None]:
    """(page of summaries that follow ``after``, newest first; where the next page follows, null at the end).

    ``after`` is start and id of the last trace seen. It is a bound on the stored time, so pages however deep cost what
    the first one does, and traces that come meanwhile do not shift them.
    """
    limit, _ = page_bounds(limit)
    matching = filter_traces(rows, **filters)
    if after is not None:
        at = instant(after[0])
        matching = filter_traces(matching, to_time=after[0])  # names the dates, too
        matching = matching.filter((F.col("start_time") < at) | ((F.col("start_time") == at) & (F.col("id") > F.lit(after[1]))))
    page = newest_first(matching).limit(limit)
    seen = page.select("start_time", "id").collect()  # one page
    end = (seen[-1]["start_time"], seen[-1]["id"]) if len(seen) == limit else None
    return trace_summaries(page), end


def list_traces(rows: DataFrame, limit: int = DEFAULT_LIMIT, offset: int = 0, **filters: object) -> tuple[DataFrame, int]:
    """(page of summaries, newest first; number of all matches)."""
    limit, offset = page_bounds(limit, offset)
    matching = filter_traces(rows, **filters)
    return trace_summaries(newest_page(matching, limit, offset)), matching.count()


def exclude_paths(traces: DataFrame, prefixes: Sequence[str] = UNTRACED_PATHS) -> DataFrame:
    """Drop traces whose request path starts with one of the prefixes."""
    hit = F.lit(False)
    for prefix in prefixes:
        hit = hit | F.startswith(F.col("http.path"), F.lit(prefix))
    return traces.filter(~F.coalesce(hit, F.lit(False)))


def sample_traces(traces: DataFrame, rate: float, seed: int = 0) -> DataFrame:
    """Keep a share of whole traces, chosen by a hash of the id so that reruns agree."""
    share = round(rate * 1_000_000)
    draw = f"cast(conv(left(md5(concat('{int(seed)}:', id)), 12), 16, 10) as bigint) % 1000000"
    return traces.filter(f"{draw} < {share}")


def scrub_headers(traces: DataFrame) -> DataFrame:
    """Drop credential headers from the request."""
    kept = F.map_filter("http.headers", lambda key, _: ~F.lower(key).isin(PRIVATE_HEADERS))
    return traces.withColumn("http", F.when(F.col("http").isNotNull(), F.col("http").withField("headers", kept)))


def status_from_http(code: Column, unhandled: Column | None = None) -> Column:
    """Server errors and unhandled exceptions are failures."""
    failed = code >= 500
    if unhandled is not None:
        failed = failed | unhandled
    return F.when(failed, "failed").otherwise("completed")


def tag_traces(
    traces: DataFrame, environment: str | None = None, project: str | None = None, name: str | None = None
) -> DataFrame:
    """Set environment, project and run name; unnamed request traces are called method and path."""
    none = F.lit(None).cast("string")
    env = F.lit(environment) if environment else none
    request = F.concat("http.method", F.lit(" "), F.col("http.path"))
    empty = F.lit("")
    return traces.withColumns(
        {
            "environment": F.coalesce(env, F.expr(default_environment("environment"))),
            "project": F.coalesce(F.lit(project) if project else none, F.nullif("project", empty)),
            "name": F.coalesce(F.lit(name) if name else none, F.nullif("name", empty), request, F.lit("workflow")),
        }
    )
