"""Number and label text."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

MISSING = "NA"
LINE_BREAK = "<br>"


def shown(value: Column) -> Column:
    """Text of a value; a missing one is printed, never skipped."""
    return F.coalesce(value.cast("string"), F.lit(MISSING))


def significant(value: Column, digits: int, thousands: bool = False) -> Column:
    """Fixed notation with at most ``digits`` significant digits, no trailing zeros."""
    magnitude = F.floor(F.log10(F.nullif(F.abs(value), F.lit(0))))
    decimals = F.greatest(F.lit(digits - 1) - F.coalesce(magnitude, F.lit(0)), F.lit(0))
    whole = F.lit("#,##0" if thousands else "0")
    fraction = F.when(decimals > 0, F.concat(F.lit("."), F.repeat(F.lit("#"), decimals.cast("int"))))
    pattern = F.concat(whole, F.coalesce(fraction, F.lit("")))
    return F.call_function("format_number", value, pattern)


def plain_number(value: Column) -> Column:
    return significant(value.cast("double"), 15)


def money(value: Column) -> Column:
    return significant(value.cast("double"), 7, thousands=True)


def two_decimals(value: Column) -> Column:
    return F.call_function("format_number", F.round(value.cast("double"), 2), F.lit("0.00"))


def decimals_needed(value: Column, digits: int) -> Column:
    """Decimals that a number shows with ``digits`` significant digits and no trailing zeros."""
    size = F.abs(value.cast("double"))
    places = F.lit(digits - 1) - F.floor(F.log10(F.nullif(size, F.lit(0.0))))
    scaled = F.round(size * F.pow(F.lit(10.0), places)).cast("long")
    ends = [F.when(scaled % 10**k == 0, 1).otherwise(0) for k in range(1, digits + 1)]
    needed = places - sum(ends[1:], ends[0])
    return F.coalesce(F.greatest(needed, F.lit(0)), F.lit(0)).cast("int")


def with_decimals(value: Column, decimals: Column) -> Column:
    """Fixed notation with the same number of decimals in every row."""
    fraction = F.when(decimals > 0, F.concat(F.lit("."), F.repeat(F.lit("0"), decimals)))
    pattern = F.concat(F.lit("0"), F.coalesce(fraction, F.lit("")))
    return F.call_function("format_number", value.cast("double"), pattern)


def aligned(value: Column, digits: int) -> Column:
    """Numbers of a column as one text column: as many decimals as the one that needs most has for
    ``digits`` significant digits. For a table of few rows: its rows are compared in one place."""
    most = F.max(decimals_needed(value, digits)).over(Window.partitionBy(F.lit(0)))
    return with_decimals(value, most)


def hover_line(caption: str, value: Column) -> Column:
    """``caption`` ends in its own blank; the value follows after one more."""
    return F.concat(F.lit(caption + " "), shown(value))


def hover(*lines: Column) -> Column:
    return F.concat_ws(LINE_BREAK, *lines)
