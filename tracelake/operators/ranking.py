"""Row numbers inside groups, also when one group holds a large share of all rows.

A window ranks a group in one task, so groups are ranked in slices: rows of a slice are numbered
together, and a slice starts after the number of rows in the slices before it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

def row_numbers(df: DataFrame, key: str, order: Sequence[str], slices: Sequence[str], name: str, counted: DataFrame | None = None) -> DataFrame:
    """Adds the 1-based row number in the group of ``key`` by ``order``.

    ``slices`` are SQL expressions that never decrease along ``order`` and cut a group into parts of
    manageable size. Only the number of slices of a group meets in one task, and each is one row there.
    Without slices a group is ranked as a whole. ``counted`` is a frame of the same keys and slices that is cheaper to
    count than ``df``, where there is one.
    """
    if not slices:
        return df.selectExpr("*", f"row_number() over (partition by {key} order by {', '.join(order)}) as {name}")
    cut = df.selectExpr("*", *[f"{sql} as _slice{i}" for i, sql in enumerate(slices)])
    parts = [f"_slice{i}" for i in range(len(slices))]
    sized = cut if counted is None else counted.selectExpr(key, *[f"{sql} as _slice{i}" for i, sql in enumerate(slices)])
    sizes = sized.groupBy(key, *parts).agg(F.count("*").alias("_n"))
    before = f"coalesce(sum(_n) over (partition by {key} order by {', '.join(parts)} rows between unbounded preceding and 1 preceding), 0L)"
    offsets = sizes.selectExpr(key, *parts, f"{before} as _before")
    inside = f"row_number() over (partition by {key}, {', '.join(parts)} order by {', '.join(order)})"
    ranked = cut.selectExpr("*", f"{inside} as _inside").alias("c")
    same = F.lit(True)
    for column in [key, *parts]:
        same = same & F.col(f"c.{column}").eqNullSafe(F.col(f"o.{column}"))
    joined = ranked.join(offsets.alias("o"), same)
    return joined.selectExpr(*[f"c.`{c}`" for c in df.columns], f"cast(_before + _inside as int) as {name}")
