"""From raw case rows to the prepared case table."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseflow import domain
from caseflow.functions.categories import program_group
from caseflow.functions.dates import as_date, days_pending, wall_clock
from caseflow.operators.joins import lookup
from caseflow.operators.rows import move_first


def add_facility(raw: DataFrame, facilities: DataFrame, salt: int = 1) -> DataFrame:
    """Facility name in front, facility key gone. A case without key takes the name of a facility
    without key; a facility listed twice doubles its cases (see ``duplicate_keys``)."""
    names = facilities.select("efc_id", "facility_name")
    named = lookup(raw, names, "facility_id", "efc_id", salt=salt)
    return move_first(named, "facility_name", drop=["facility_id"])


def parse_dates(cases: DataFrame) -> DataFrame:
    return cases.withColumns({c: wall_clock(cases, c) for c in domain.DATE_COLUMNS})


def prepare_cases(
    raw: DataFrame,
    facilities: DataFrame | None,
    pull_date: dt.date | str | Column | None = None,
    *,
    utc_pull: bool = False,
    always_to_pull: bool = False,
    groups: Mapping[str, Sequence[str]] = domain.PROGRAM_GROUPS,
    salt: int = 1,
    keep: Sequence[str] = (),
) -> DataFrame:
    """The prepared case table. ``facilities`` is None when ``raw`` names its facility already.
    ``keep`` adds further columns of ``raw`` at the end.

    Rows without facility name or case number are dropped next to the join, which lets Spark turn
    the outer join into an inner one.
    """
    named = raw if facilities is None else add_facility(raw, facilities, salt)
    complete = named.filter(F.col("facility_name").isNotNull() & F.col("ea_number").isNotNull())
    pull = as_date(pull_date)
    return (
        parse_dates(complete)
        .withColumn("program", program_group(F.col("program_name"), groups))
        .withColumn("pull_date", pull)
        .withColumn(
            "days_pending",
            days_pending(
                F.col("nov_date"),
                F.col("term_date"),
                pull,
                utc_pull=utc_pull,
                always_to_pull=always_to_pull,
            ),
        )
        .select(*domain.CASES_COLUMNS, *keep)
    )


def prepare_extract(
    extract: DataFrame, pull_date: dt.date | str | Column | None = None, **settings
) -> DataFrame:
    """Cases of a file extract: facility named already, construction stormwater kept apart, days
    always counted to the pull date."""
    settings = {"always_to_pull": True, "groups": domain.EXTRACT_PROGRAM_GROUPS, **settings}
    return prepare_cases(extract, None, pull_date, **settings)
