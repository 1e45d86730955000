"""Column helpers for rates, rounding and time arithmetic. Everything stays a Catalyst expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def round_half_up(value: Column, digits: int = 2) -> Column:
    """Round a double on its decimal form, so 0.285 gives 0.29 in every engine."""
    return F.round(value.cast("decimal(28,8)"), digits).cast("double")


def rate_pct(part: Column, whole: Column) -> Column:
    """100 * part / whole with two digits; NULL for an empty whole."""
    return round_half_up(F.try_divide(part.cast("double"), whole.cast("double")) * 100.0)


def count_rows() -> Column:
    return F.count(F.lit(1))


def count_where(condition: Column) -> Column:
    return F.count_if(condition)


def micros(ts: Column | str) -> Column:
    """Microseconds since 1970 of a zone-less timestamp (its wall clock read as UTC)."""
    return F.unix_micros(as_column(ts).cast("timestamp"))


def seconds_between(later: Column, earlier: Column) -> Column:
    """Elapsed seconds between two zone-less timestamps."""
    return (micros(later) - micros(earlier)) / F.lit(1_000_000.0)


def time_key(ts: Column | str) -> Column:
    """yyyymmddHHMM as a BIGINT: the value needs 38 bits."""
    ts = as_column(ts)
    return (
        F.year(ts).cast("long") * 100_000_000 + F.month(ts) * 1_000_000 + F.day(ts) * 10_000
        + F.hour(ts) * 100 + F.minute(ts)
    )


def iso_weekday(ts: Column | str) -> Column:
    """Monday = 1 .. Sunday = 7."""
    return F.weekday(as_column(ts)) + 1


def flag(condition: Column) -> Column:
    return condition.cast("int")
