"""One call for a whole overview: KPIs of the store and a page of matching traces."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from tracelake.operators.analytics import kpi_board, node_execution_totals
from tracelake.operators.listing import DEFAULT_LIMIT, filter_traces, matches, newest_page, page_bounds, trace_summaries
from tracelake.session import cut_lineage


@dataclass(frozen=True)
class Dashboard:
    stats: DataFrame
    nodes: DataFrame
    page: DataFrame
    total_count: int
    has_more: bool


def store_stats(rows: DataFrame) -> DataFrame:
    """All KPIs in one row."""
    return kpi_board(rows).drop("matching")


def dashboard(
    rows: DataFrame, limit: int = DEFAULT_LIMIT, offset: int = 0, page: int | None = None, n: int | None = None, **filters: object
) -> Dashboard:
    """KPIs ignore the filters; the page and its total obey them. The total is counted on the way of the KPIs."""
    limit, offset = page_bounds(limit, offset, page)
    board = cut_lineage(kpi_board(rows, matches(rows, **filters)))
    total = board.first()["matching"]
    shown = trace_summaries(newest_page(filter_traces(rows, **filters), limit, offset))
    on_page = max(0, min(limit, total - offset))
    return Dashboard(board.drop("matching"), node_execution_totals(rows, n), shown, total, offset + on_page < total)
