"""The case cube: all counts and penalty sums a dashboard needs, in one small table.

Its size follows the number of regions, programs and statuses, not the number of cases. Every
counting plan takes it in place of the case table, so a page of panels costs one pass.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseflow.functions.categories import over_year, program_group, under_year
from caseflow.functions.dates import NTZ, as_date, days_pending, wall_clock, year_earlier
from caseflow.operators.joins import lookup
from caseflow.operators.measures import total_or_zero

DIMENSIONS = (
    "pull_date",
    "facility_region",
    "program",
    "status_code",
    "over_year",
    "under_year",
    "recent_term",
)


def _flagged(cases: DataFrame) -> DataFrame:
    recent = F.col("term_date") >= year_earlier(F.col("pull_date")).cast(NTZ)
    return cases.withColumns(
        {
            "over_year": over_year(cases),
            "under_year": under_year(cases),
            "recent_term": F.coalesce(recent, F.lit(False)),
        }
    )


def build_cube(cases: DataFrame) -> DataFrame:
    """Cube of prepared cases."""
    return _flagged(cases).groupBy(*DIMENSIONS).agg(
        F.count(F.lit(1)).alias("case_count"),
        total_or_zero(F.col("cash_civil_charge")).alias("cash_total"),
    )


def build_cube_early(
    raw: DataFrame, facilities: DataFrame, pull_date: dt.date | str | Column | None = None
) -> DataFrame:
    """The same cube from raw rows, for a facility table too large to broadcast.

    Cases are summed per facility before the join and facilities reduced to the number of their
    named rows, so neither the wide rows nor a hot facility cross the network: every task sends
    one row per facility and combination.
    """
    pull = as_date(pull_date)
    dated = raw.filter(F.col("ea_number").isNotNull()).withColumns(
        {
            "nov_date": wall_clock(raw, "nov_date"),
            "term_date": wall_clock(raw, "term_date"),
            "program": program_group(F.col("program_name")),
            "pull_date": pull,
        }
    )
    aged = dated.withColumn("days_pending", days_pending(F.col("nov_date"), F.col("term_date"), pull))
    by_facility = _flagged(aged).groupBy("facility_id", *DIMENSIONS).agg(
        F.count(F.lit(1)).alias("n"), total_or_zero(F.col("cash_civil_charge")).alias("cash")
    )
    named = (
        facilities.filter(F.col("facility_name").isNotNull())
        .groupBy("efc_id")
        .agg(F.count(F.lit(1)).alias("times"))
    )
    return (
        lookup(by_facility, named, "facility_id", "efc_id", "inner")
        .groupBy(*DIMENSIONS)
        .agg(
            F.sum(F.col("n") * F.col("times")).alias("case_count"),
            F.sum(F.col("cash") * F.col("times")).alias("cash_total"),
        )
    )
