"""Exact ratios and time arithmetic; nothing here rounds a binary float."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(numerator: Column, denominator: Column, scale: int) -> Column:
    """numerator / denominator rounded half up to ``scale`` digits, by whole-number division.

    Both are whole numbers, the denominator not negative; a zero denominator gives 0.
    """
    wide_n = F.abs(numerator).cast("decimal(30,0)") * F.lit(2 * 10**scale)
    wide_d = denominator.cast("decimal(20,0)")
    quotient = F.call_function("div", wide_n + wide_d, F.nullif(wide_d * F.lit(2), F.lit(0)))
    signed = F.when(numerator < 0, -quotient).otherwise(quotient)
    return F.coalesce(signed.cast("double") / F.lit(float(10**scale)), F.lit(0.0))


def pct(part: Column, whole: Column) -> Column:
    """Share in percent with one decimal, 0 when the whole is 0."""
    return half_up(part * F.lit(100), whole, 1)


def cents(value: Column) -> Column:
    """A two-decimal amount as a whole number of hundredths."""
    return (value.cast("decimal(18,2)") * F.lit(100)).cast("bigint")


def parse_iso(text: Column) -> Column:
    """ISO-8601 text to an instant; ``Z`` and offsets accepted, anything unreadable gives null."""
    return text.try_cast("timestamp")


def duration_ms(start: Column, end: Column) -> Column:
    """Milliseconds between two instants with two decimals; 0.0 if either is missing."""
    micros = (F.unix_micros(end) - F.unix_micros(start)).cast("decimal(20,0)")
    return F.coalesce(F.round(micros / F.lit(1000), 2).cast("double"), F.lit(0.0))


def bucket_label(start: Column) -> Column:
    return F.date_format(start, "HH:mm")
