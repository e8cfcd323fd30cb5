"""Date parsing and date arithmetic on zone-free timestamps."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NTZ = "timestamp_ntz"

# The readable part of a month/day/year text; whatever follows it is ignored.
DATE_TEXT = r"^ *(\d{1,2}/ *\d{1,2}/ *\d{1,4})"


def parsed_day(text: Column) -> Column:
    """The day that a text starts with as month/day/year; NULL where it is no date."""
    return F.try_to_date(F.regexp_replace(F.regexp_extract(text, DATE_TEXT, 1), " ", ""), "M/d/y")


def wall_clock(df: DataFrame, name: str) -> Column:
    """``df[name]`` as a zone-free timestamp.

    Text is read as month/day/year and gives NULL when it is no date. Typed columns are cast; an
    instant (``timestamp``) is taken at the session time zone.
    """
    column, kind = F.col(name), df.schema[name].dataType
    if isinstance(kind, T.TimestampNTZType):
        return column
    if isinstance(kind, T.StringType):
        return parsed_day(column).cast(NTZ)
    return column.cast(NTZ)


def as_date(value: dt.date | str | Column | None) -> Column:
    """A pull date given as date, ISO text or column; today when none is given."""
    if value is None:
        return F.current_date()
    if isinstance(value, Column):
        return value.cast("date")
    return F.lit(value).cast("date")


def whole_days(start: Column, end: Column) -> Column:
    """Full 24-hour days between two zone-free timestamps, cut toward zero also when negative."""
    return F.extract(F.lit("DAY"), end - start).cast("long")


def days_pending(
    nov: Column,
    term: Column,
    pull: Column,
    *,
    utc_pull: bool = False,
    always_to_pull: bool = False,
) -> Column:
    """Days from violation notice to termination or, for open cases, to the pull date.

    ``utc_pull`` takes the pull date as UTC midnight against notices at UTC-5 midnight, which
    moves open cases five hours. ``always_to_pull`` counts to the pull date for closed cases too.
    """
    open_from = nov + F.expr("INTERVAL '5' HOUR") if utc_pull else nov
    to_pull = whole_days(open_from, pull.cast(NTZ))
    if always_to_pull:
        return to_pull
    return F.when(term.isNull(), to_pull).otherwise(whole_days(nov, term))


def year_earlier(day: Column) -> Column:
    """Twelve months back; 29 February becomes 28 February."""
    return F.add_months(day, -12)


def start_of_year(day: Column) -> Column:
    return F.trunc(day, "YEAR")


def start_of_last_year(day: Column) -> Column:
    return F.trunc(year_earlier(day), "YEAR")


def within(column: Column, first: Column, last: Column) -> Column:
    """Closed range test; a timestamp on the last day counts only at midnight."""
    return column.between(first.cast(NTZ), last.cast(NTZ))


def short_date(day: Column) -> Column:
    return F.date_format(day, "MM/dd/yy")
