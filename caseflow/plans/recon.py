"""Year-to-date cases and the comparison of two pulls."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseflow.functions.dates import as_date, short_date, start_of_last_year, start_of_year, within
from caseflow.operators.joins import in_other
from caseflow.operators.rows import distinct_values
from caseflow.plans.prepare import prepare_cases
from caseflow.sources.views import issued_between, touched_between


def year_to_date(cases: DataFrame) -> DataFrame:
    """Prepared cases noticed between 1 January of the pull year and the pull date."""
    pull = F.col("pull_date")
    return cases.filter(within(F.col("nov_date"), start_of_year(pull), pull))


def prepare_year_to_date(
    raw: DataFrame, facilities: DataFrame, pull_date: dt.date | str | None = None, **settings
) -> DataFrame:
    """The same from raw rows, with the date filter ahead of the join so that the source applies it."""
    pull = as_date(pull_date)
    issued = issued_between(raw, start_of_year(pull), pull)
    return prepare_cases(issued, facilities, pull, **settings)


def prepare_touched(
    raw: DataFrame, facilities: DataFrame, pull_date: dt.date | str | None = None, **settings
) -> DataFrame:
    """Cases executed, noticed or terminated since the start of the year before the pull."""
    pull = as_date(pull_date)
    return prepare_cases(touched_between(raw, start_of_last_year(pull), pull), facilities, pull, **settings)


def reconcile_cases(cases: DataFrame, other_pull: DataFrame, salt: int = 1) -> DataFrame:
    """Cases whose number also occurs in another pull."""
    return in_other(cases, other_pull, "ea_number", salt)


def reconcile_stored(cases: DataFrame, other_pull: DataFrame) -> DataFrame:
    """``reconcile_cases`` of two pulls read with ``store.read_pull``: they meet where they lie.

    Both are dealt out by case number already, so known numbers join by plain equality and no row
    moves. Cases without a number stay if the other pull has one without, which one row tells.
    """
    key = F.col("ea_number")
    known = cases.filter(key.isNotNull()).join(other_pull.select("ea_number"), "ea_number", "left_semi")
    any_lost = other_pull.filter(key.isNull()).agg(F.count(F.lit(1)).alias("n")).scalar() > 0
    return known.select(*cases.columns).unionAll(cases.filter(key.isNull() & any_lost))


def pull_date_banner(cases: DataFrame) -> DataFrame:
    """The pull dates present, as the notice in the page header."""
    day = short_date(F.col("pull_date"))
    return distinct_values(cases, "pull_date").withColumn(
        "banner", F.concat(F.lit("Dashboard Data Pulled On: "), day)
    )
