"""Staffing: case capacity, referral rates and the deficits between them."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseflow import domain
from caseflow.functions import text
from caseflow.functions.categories import deficit_color, has_status, position_class
from caseflow.operators.joins import lookup
from caseflow.operators.measures import case_count, strict_total
from caseflow.operators.rows import for_pulls, in_region, pull_keys


def capacity_by_region(org_chart: DataFrame) -> DataFrame:
    """Capacity per region; NULL when a position of the region has none."""
    return org_chart.groupBy("region").agg(strict_total(F.col("capacity")).alias("region_capacity"))


def _pending_by_region(
    cases: DataFrame, statuses: Sequence[str], pulls: Sequence[dt.date | str] | None
) -> DataFrame:
    pending = cases.filter(has_status(statuses))
    return pending.groupBy(*pull_keys(pulls), "facility_region").agg(case_count(cases).alias("pending_total"))


def _fte(capacity: Column, load: Column) -> Column:
    return (capacity - load) / F.lit(float(domain.CASES_PER_FTE))


def fte_deficit_by_region(
    cases: DataFrame,
    org_chart: DataFrame,
    referral_rates: DataFrame,
    statuses: Sequence[str] = domain.PENDING,
    all_regions: bool = False,
    pulls: Sequence[dt.date | str] | None = None,
) -> DataFrame:
    """Capacity against referrals and against pending cases, in full-time positions.

    Only regions with a pending case appear; ``all_regions`` lists those of the staffing chart
    instead, with 0 pending where there is none. With ``pulls`` so for each pull.
    """
    pending = _pending_by_region(cases, statuses, pulls)
    capacity = capacity_by_region(org_chart)
    if all_regions:
        chart = for_pulls(capacity.withColumnRenamed("region", "facility_region"), pulls)
        at = F.struct(*pull_keys(pulls), "facility_region")
        counts = pending.select(at.alias("at"), "pending_total")
        joined = lookup(chart.withColumn("at", at), counts, "at", "at").select(
            *pull_keys(pulls),
            "facility_region",
            F.coalesce("pending_total", F.lit(0)).alias("pending_total"),
            "region_capacity",
        )
    else:
        joined = lookup(pending, capacity, "facility_region", "region")
    rated = lookup(joined, referral_rates, "facility_region", "region")
    current = _fte(F.col("region_capacity"), F.col("pending_total"))
    return rated.select(
        *pull_keys(pulls),
        "facility_region",
        "pending_total",
        "region_capacity",
        "referral_rate",
        _fte(F.col("region_capacity"), F.col("referral_rate")).alias("referral_fte_deficit"),
        current.alias("current_fte_deficit"),
        deficit_color(current).alias("current_fte_deficit_color"),
    )


def region_capacity_fte(
    cases: DataFrame,
    org_chart: DataFrame,
    referral_rates: DataFrame,
    region: str | None = None,
    statuses: Sequence[str] = domain.PENDING,
    pulls: Sequence[dt.date | str] | None = None,
) -> DataFrame:
    """Capacity box of a region, or of every region with staff or pending cases: figures, printed
    figures, colours and the two equations. No staff is capacity 0, no pending case is 0. With
    ``pulls`` so for each pull."""
    keys = [*pull_keys(pulls), "region"]
    staff = in_region(org_chart, region, "region").groupBy("region").agg(
        strict_total(F.col("capacity")).alias("staffed"), F.lit(True).alias("has_staff")
    )
    pending = _pending_by_region(in_region(cases, region), statuses, pulls)
    staff = for_pulls(staff, pulls)
    known = staff.join(pending.withColumnRenamed("facility_region", "region"), keys, "full")
    if region is None:
        known = known.filter(F.col("region").isNotNull())
    else:
        asked = cases.sparkSession.range(0, 1, 1, 1).select(F.lit(region).alias("region"))
        known = for_pulls(asked, pulls).join(known, keys, "left")
    figures = known.join(in_region(referral_rates, region, "region"), "region", "left").select(
        *keys,
        F.when(F.col("has_staff"), F.col("staffed")).otherwise(0).alias("capacity"),
        F.coalesce("pending_total", F.lit(0)).alias("pending_total"),
        "referral_rate",
    )
    figures = figures.withColumns(
        {
            "referral_deficit": _fte(F.col("capacity"), F.col("referral_rate")),
            "current_deficit": _fte(F.col("capacity"), F.col("pending_total")),
        }
    )
    capacity, rate = text.shown(F.col("capacity")), text.shown(text.plain_number(F.col("referral_rate")))
    referral, current = (
        text.shown(text.two_decimals(F.col(c))) for c in ("referral_deficit", "current_deficit")
    )
    per = F.lit(f")/ {domain.CASES_PER_FTE}= ")
    return figures.withColumns(
        {
            "capacity_text": F.concat(F.lit("Regional Case Capacity: "), capacity),
            "referral_text": F.concat(F.lit("Average Referral Rate: "), rate),
            "referral_deficit_text": F.concat(F.lit("Referral FTE Deficit: "), referral),
            "current_deficit_text": F.concat(F.lit("Current FTE Deficit: "), current),
            "referral_deficit_color": deficit_color(F.round("referral_deficit", 2)),
            "current_deficit_color": deficit_color(F.round("current_deficit", 2)),
            "referral_equation": F.concat(
                F.lit("Referral Deficit Eq. ("), capacity, F.lit("-"), rate, per, referral
            ),
            "current_equation": F.concat(
                F.lit("Current Deficit Eq. ("),
                capacity,
                F.lit("- "),
                F.col("pending_total").cast("string"),
                per,
                current,
            ),
        }
    )


def region_roster(org_chart: DataFrame, region: str | None = None) -> DataFrame:
    """Positions with the box they are shown in and the two lines of the box."""
    return in_region(org_chart, region, "region").select(
        "region",
        "position",
        "position_number",
        "capacity",
        position_class(F.col("position")).alias("class"),
        F.concat(text.shown(F.col("position")), F.lit("- "), text.shown(F.col("position_number"))).alias(
            "title"
        ),
        F.concat(F.lit("Capacity: "), text.shown(F.col("capacity"))).alias("subtitle"),
    )
