"""Exact order statistics without sorting or shuffling all values.

A first pass counts values in coarse logarithmic buckets per group, which finds the bucket holding
the wanted rank; a second pass looks at the values of that bucket only. Both count equal values
together before anything is shuffled, so neither a popular group nor a popular value ends up in one
place.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from tracelake.session import cut_lineage

STEPS_PER_OCTAVE = 256


def _bucket(value: Column) -> Column:
    size = F.floor(F.log2(F.greatest(F.abs(value), F.lit(1e-300))) * F.lit(STEPS_PER_OCTAVE))
    offset = F.lit(1000 * STEPS_PER_OCTAVE)
    return F.when(value > 0, size + offset).when(value < 0, -(size + offset)).otherwise(F.lit(0)).cast("int")


def floor_rank(n: Column) -> Column:
    """0-based index floor(0.95 (n - 1))."""
    return F.call_function("div", (n - 1) * 95, F.lit(100))


def ceil_rank(n: Column) -> Column:
    """0-based index ceil(0.95 n) - 1."""
    return F.call_function("div", n * 95 + 99, F.lit(100)) - 1


def order_statistic(
    df: DataFrame,
    keys: list[str],
    value: str,
    rank: Callable[[Column], Column],
    name: str,
    weight: str | None = None,
) -> DataFrame:
    """Per group of ``keys``: the value at 0-based ``rank(n)`` among its n non-null values.

    ``weight`` names a column telling how many values a row stands for. Values are counted before they
    meet the target of their group, and how they meet is left to the optimizer.
    """
    summary = _summary(df, keys, value, rank, {}, weight)
    return _resolved(df, summary.filter("_bucket is not null"), keys, value, name, weight).select(*keys, name)


def order_statistic_with(
    df: DataFrame, keys: list[str], value: str, rank: Callable[[Column], Column], name: str, sums: dict[str, Column]
) -> DataFrame:
    """``order_statistic`` of every group, together with aggregates that add up (sums, counts, minima and maxima by their name).

    ``sums`` maps a name to (aggregate of the rows, aggregate of such aggregates). They ride on the pass that finds the
    coarse buckets, so all of it takes two passes over the rows; what lies between them is one row per group and is cut off.
    A group without any value keeps its sums.
    """
    summary = cut_lineage(_summary(df, keys, value, rank, sums, None))
    found = _resolved(df, summary.filter("_bucket is not null"), keys, value, name, None)
    if not keys:
        return summary.select(*sums, F.lit(1).alias("_k")).join(found.select(name, F.lit(1).alias("_k")), "_k", "left").drop("_k")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"s.{k}").eqNullSafe(F.col(f"f.{k}"))
    joined = summary.select(*keys, *sums).alias("s").join(found.alias("f"), same, "left")
    return joined.select(*[F.col(f"s.{c}").alias(c) for c in (*keys, *sums)], F.col(f"f.{name}").alias(name))


def _summary(df: DataFrame, keys: list[str], value: str, rank: Callable[[Column], Column], sums: dict, weight: str | None) -> DataFrame:
    """One row per group: its sums, and the coarse bucket with the wanted rank and how much of the rank lies in it."""
    groups = [F.col(k) for k in keys]
    present = F.col(value).isNotNull()
    amount = F.sum(F.when(present, F.col(weight))) if weight else F.count(value)
    rows = df if sums else df.filter(present)
    coarse = rows.withColumn("_bucket", F.when(present, _bucket(F.col(value)))).groupBy(*keys, "_bucket").agg(
        F.coalesce(amount, F.lit(0)).alias("_in_bucket"), *[one.alias(n) for n, (one, _) in sums.items()]
    )
    # At most a few thousand buckets per group reach these windows.
    whole = Window.partitionBy(*groups)
    upto = whole.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = coarse.withColumns(
        {"_upto": F.sum("_in_bucket").over(upto), "_rank": rank(F.sum("_in_bucket").over(whole))}
    )
    hit = (F.col("_rank") < F.col("_upto")) & (F.col("_rank") >= F.col("_upto") - F.col("_in_bucket")) & F.col("_bucket").isNotNull()
    target = F.struct("_bucket", (F.col("_rank") - (F.col("_upto") - F.col("_in_bucket"))).alias("_rest"), F.col("_in_bucket").alias("_size"))
    one = ranked.groupBy(*keys).agg(F.max(F.when(hit, target)).alias("_target"), *[again(F.col(n)).alias(n) for n, (_, again) in sums.items()])
    return one.select(*keys, *sums, "_target._bucket", "_target._rest", "_target._size")


def _resolved(df: DataFrame, target: DataFrame, keys: list[str], value: str, name: str, weight: str | None) -> DataFrame:
    """The value itself, from the values of the wanted bucket only."""
    amount = F.sum(weight) if weight else F.count("*")
    values = df.filter(F.col(value).isNotNull()).withColumn("_bucket", _bucket(F.col(value)))
    if not keys:
        return _of_all(values, target.first(), value, name, amount)
    counted = values.groupBy(*keys, "_bucket", value).agg(amount.alias("_n"))
    inside = counted.join(target.select(*keys, "_bucket", "_rest"), [*keys, "_bucket"])
    running = Window.partitionBy(*[F.col(k) for k in keys]).orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reached = inside.withColumn("_upto", F.sum("_n").over(running)).filter(F.col("_upto") > F.col("_rest"))
    return reached.groupBy(*keys).agg(F.min(value).alias(name))


#: Values of one bucket that may be ranked in one place, and parts that a larger bucket is cut into.
FEW, PARTS = 100_000, 4096


def _of_all(values: DataFrame, target: Row | None, value: str, name: str, amount: Column) -> DataFrame:
    """The value of the wanted rank among all rows. A bucket of many values is cut into equal ranges, again and again, until
    the range with the rank holds few; each cut is one pass that tells at most ``PARTS`` counts."""
    if target is None:
        return values.select(F.col(value).alias(name)).limit(0)
    inside, rest, size = values.filter(F.col("_bucket") == target["_bucket"]), target["_rest"], target["_size"]
    number = F.col(value).cast("double")
    while size > FEW:
        ends = inside.agg(F.min(number).alias("lo"), F.max(number).alias("hi")).first()
        if ends["lo"] == ends["hi"]:
            break
        part = F.least(F.floor((number - ends["lo"]) * F.lit(PARTS / (ends["hi"] - ends["lo"]))), F.lit(PARTS - 1))
        for row in inside.groupBy(part.alias("part")).agg(amount.alias("n")).orderBy("part").collect():
            if rest < row["n"]:
                inside, size = inside.filter(part == row["part"]), row["n"]
                break
            rest -= row["n"]
    counted = inside.groupBy(value).agg(amount.alias("_n"))
    running = Window.orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reached = counted.withColumn("_upto", F.sum("_n").over(running)).filter(F.col("_upto") > F.lit(rest))
    return reached.agg(F.min(value).alias(name))
