"""Scalar helpers: Oracle-compatible semantics expressed with built-in,
codegen-able Spark expressions (no Python UDFs).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"


def round2(c: Column, out: str = MONEY) -> Column:
    """Exact ROUND(x, 2), half away from zero, on a fixed-point value.

    The value is first pinned to 10 decimal places so that a quotient that
    arrived as a double (binary noise) and one that arrived as an exact
    decimal round identically; then rounded in decimal arithmetic.
    """
    return F.round(c.cast("decimal(38,10)"), 2).cast(out)


def safe_div(num: Column, den: Column) -> Column:
    """x / y that yields NULL instead of raising on a zero divisor."""
    return num / F.nullif(den, F.lit(0))


def hhmm_minutes(c: Column) -> Column:
    """'HH:MM' -> minutes after midnight (TO_NUMBER(SUBSTR(..))): malformed
    text raises under ANSI casts, like the reference."""
    return F.substring(c, 1, 2).cast("int") * 60 + F.substring(c, 4, 2).cast("int")


def trunc_day(c: Column) -> Column:
    """Oracle TRUNC(date): the calendar day, independent of session zone."""
    return F.to_date(c)


def seconds_between(start: Column, end: Column) -> Column:
    """DATE - DATE as whole seconds (the interval emitted as a number)."""
    return F.timestamp_diff("SECOND", start, end)
