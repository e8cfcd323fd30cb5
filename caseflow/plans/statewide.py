"""Statewide panels, by region or by program, on cases or on the case cube."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caseflow import domain
from caseflow.functions.categories import has_status, over_year, terminated_lately
from caseflow.operators.measures import (
    case_count,
    case_count_where,
    cash_total,
    null_if_zero,
)
from caseflow.operators.rows import first_row_per, for_pulls, pull_keys, template_row, with_group_value

REGION, PROGRAM = "facility_region", "program"
COUNT_NAMES = {REGION: "region_total", PROGRAM: "program_total"}
CASH_NAMES = {REGION: "regional_total", PROGRAM: "program_total"}


def pending_by(
    cases: DataFrame,
    key: str,
    statuses: Sequence[str] = domain.PENDING,
    include_template: bool = True,
    pulls: Sequence[dt.date | str] | None = None,
) -> DataFrame:
    """Pending cases per key in two age buckets; an empty bucket is NULL.

    The template is one more row without key, kept in the result. It shares its total with the
    cases that have no key. Only the aggregated rows pass the window. With ``pulls`` the pull date
    is part of the key, and each pull has a template row.
    """
    keys = [key, *pull_keys(pulls)]
    over = over_year(cases)
    counted = (
        cases.filter(has_status(statuses))
        .groupBy(*keys)
        .agg(
            null_if_zero(case_count_where(cases, ~over)).alias("active_lt_365"),
            null_if_zero(case_count_where(cases, over)).alias("active_gt_365"),
        )
    )
    both = F.coalesce("active_lt_365", F.lit(0)) + F.coalesce("active_gt_365", F.lit(0))
    if not include_template:
        return counted.withColumn("total_pending", both)
    template = for_pulls(template_row(counted), pulls)
    return counted.unionByName(template).withColumn("total_pending", F.sum(both).over(Window.partitionBy(*keys)))


def count_by(
    cases: DataFrame,
    key: str,
    statuses: Sequence[str] | None = None,
    lately: bool = False,
    pulls: Sequence[dt.date | str] | None = None,
) -> DataFrame:
    """Cases per key: all, of some statuses, or terminated in the last twelve months."""
    if lately:
        cases = cases.filter(terminated_lately(cases))
    elif statuses is not None:
        cases = cases.filter(has_status(statuses))
    return cases.groupBy(*pull_keys(pulls), key).agg(case_count(cases).alias(COUNT_NAMES[key]))


def pending_by_region(cases: DataFrame, **settings) -> DataFrame:
    return pending_by(cases, REGION, **settings)


def pending_by_program(cases: DataFrame, **settings) -> DataFrame:
    return pending_by(cases, PROGRAM, **settings)


def monitored_by_region(cases: DataFrame, **settings) -> DataFrame:
    return count_by(cases, REGION, domain.EFFECTIVE, **settings)


def monitored_by_program(cases: DataFrame, **settings) -> DataFrame:
    return count_by(cases, PROGRAM, domain.EFFECTIVE, **settings)


def actions_by_region(
    cases: DataFrame, statuses: Sequence[str] | None = domain.EFFECTIVE, **settings
) -> DataFrame:
    """Enforcement actions; ``statuses=None`` counts cases of every status."""
    return count_by(cases, REGION, statuses, **settings)


def actions_by_program(
    cases: DataFrame, statuses: Sequence[str] | None = domain.EFFECTIVE, **settings
) -> DataFrame:
    return count_by(cases, PROGRAM, statuses, **settings)


def terminated_by_region(cases: DataFrame, **settings) -> DataFrame:
    return count_by(cases, REGION, lately=True, **settings)


def terminated_by_program(cases: DataFrame, **settings) -> DataFrame:
    return count_by(cases, PROGRAM, lately=True, **settings)


def cash_by(
    cases: DataFrame, key: str, pulls: Sequence[dt.date | str] | None = None
) -> DataFrame:
    """Penalty total per key, straight from an aggregate."""
    return cases.groupBy(*pull_keys(pulls), key).agg(cash_total(cases).alias(CASH_NAMES[key]))


def cash_by_region(cases: DataFrame, **settings) -> DataFrame:
    return cash_by(cases, REGION, **settings)


def cash_by_program(cases: DataFrame, **settings) -> DataFrame:
    return cash_by(cases, PROGRAM, **settings)


def cash_drill_region(cases: DataFrame, selections: Sequence[str] = ()) -> DataFrame:
    """Penalties of the selected regions by program; nothing selected gives the regional totals.

    One row per program and region, each with the program's total over the whole selection. A
    selected name that is no region matches nothing.
    """
    if not selections:
        return cash_by_region(cases)
    chosen = cases.filter(F.col(REGION).isin(*selections))
    pairs = chosen.groupBy(PROGRAM, REGION).agg(cash_total(chosen).alias("pair_total"))
    total = F.sum("pair_total").over(Window.partitionBy(PROGRAM))
    return pairs.select(PROGRAM, REGION, total.alias("program_total"))


def cash_drill_program(cases: DataFrame, selections: Sequence[str] = ()) -> DataFrame:
    """Penalties of the selected programs by region; nothing selected gives the program totals."""
    if not selections:
        return cash_by_program(cases)
    return cash_by_region(cases.filter(F.col(PROGRAM).isin(*selections)))


def with_cash_total(cases: DataFrame, key: str, totals: DataFrame | None = None) -> DataFrame:
    """Every case with the penalty total of its region or program. ``totals`` may be ``cash_by`` of
    a stored cube."""
    return with_group_value(cases, key, CASH_NAMES[key], cash_total(cases), totals)


def cash_drill_rows(
    cases: DataFrame, selections: Sequence[str], order: str = "ea_number"
) -> DataFrame:
    """The drill-down with a whole case per program and region: the first by case number, or by
    ``order``."""
    chosen = cases.filter(F.col(REGION).isin(*selections))
    pair_total = cash_total(chosen).alias("pair_total")
    first = first_row_per(chosen, [PROGRAM, REGION], order, pair_total)
    total = F.sum("pair_total").over(Window.partitionBy(PROGRAM))
    return first.withColumn("program_total", total).drop("pair_total")
