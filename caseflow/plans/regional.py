"""Regional tables. ``region=None`` gives all regions in one pass, with the region as first column."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caseflow import domain
from caseflow.functions.categories import (
    age_bucket,
    has_status,
    over_year,
    terminated_lately,
    under_year,
)
from caseflow.operators.measures import case_count, case_count_where, null_if_zero
from caseflow.operators.reshape import to_long, to_map, to_wide
from caseflow.operators.rows import (
    columns_between,
    first_row_per,
    for_pulls,
    group_keys,
    in_region,
    pull_keys,
    with_group_value,
)
from caseflow.session import cut_lineage

BUCKETS = ("active_lt_365", "active_gt_365")


def _detail_columns(cases: DataFrame) -> list[str]:
    return columns_between(cases, "facility_name", "comments")


def pending_cases(
    cases: DataFrame, region: str | None = None, statuses: Sequence[str] = domain.PENDING
) -> DataFrame:
    """Pending rows with their age bucket."""
    pending = in_region(cases, region).filter(has_status(statuses))
    return pending.withColumn("pending_status", age_bucket(pending))


def region_pending_detail(
    cases: DataFrame,
    region: str | None = None,
    statuses: Sequence[str] = domain.PENDING,
    keep: Sequence[str] = (),
) -> DataFrame:
    """The fifteen source columns of pending rows: filter and projection, no shuffle. ``keep`` adds
    further columns at the end."""
    rows = in_region(cases, region).filter(has_status(statuses))
    return rows.select(*_detail_columns(cases), *keep)


def region_terminated_detail(
    cases: DataFrame, region: str | None = None, keep: Sequence[str] = ()
) -> DataFrame:
    """Program and source columns of rows terminated in the last twelve months."""
    rows = in_region(cases, region).filter(terminated_lately(cases))
    return rows.select("program", *_detail_columns(cases), *keep)


def region_monitored_detail(
    cases: DataFrame, region: str | None = None, keep: Sequence[str] = ()
) -> DataFrame:
    rows = in_region(cases, region).filter(has_status(domain.EFFECTIVE))
    return rows.select("program", *_detail_columns(cases), *keep)


def with_program_total(rows: DataFrame, totals: DataFrame | None = None) -> DataFrame:
    """Detail rows, each with the number of rows of its program. ``totals`` may be the panel of these
    rows by program, from a stored cube."""
    return with_group_value(rows, "program", "program_total", F.count(F.lit(1)), totals)


def with_region_total(rows: DataFrame, totals: DataFrame | None = None) -> DataFrame:
    """Detail rows, each with the number of rows of its region."""
    return with_group_value(rows, "facility_region", "region_total", F.count(F.lit(1)), totals)


def _pending_counts(
    cases: DataFrame,
    region: str | None,
    statuses: Sequence[str],
    pulls: Sequence[dt.date | str] | None = None,
) -> DataFrame:
    over = over_year(cases)
    pending = in_region(cases, region).filter(has_status(statuses))
    return pending.groupBy("facility_region", "program", *pull_keys(pulls)).agg(
        case_count(cases).alias("program_total"),
        null_if_zero(case_count_where(cases, ~over)).alias("active_lt_365"),
        null_if_zero(case_count_where(cases, over)).alias("active_gt_365"),
    )


def region_pending_by_program(
    cases: DataFrame,
    region: str | None = None,
    statuses: Sequence[str] = domain.PENDING,
    fill_cells: bool = False,
    pulls: Sequence[dt.date | str] | None = None,
) -> DataFrame:
    """Pending per program with both buckets. A bucket no program of the region has is 0, other
    empty cells are NULL; ``fill_cells`` makes those 0 too. The window sees aggregated rows only.
    With ``pulls`` the pull date leads, and a bucket counts as missing within its own pull."""
    counts = _pending_counts(cases, region, statuses, pulls)
    if fill_cells:
        filled = counts.fillna(0, subset=[*BUCKETS])
    else:
        of_region = Window.partitionBy(*pull_keys(pulls), "facility_region")
        none_at_all = {b: F.max(b).over(of_region).isNull() for b in BUCKETS}
        filled = counts.withColumns(
            {b: F.when(none_at_all[b], F.lit(0)).otherwise(F.col(b)) for b in BUCKETS}
        )
    return filled.select(*pull_keys(pulls), *group_keys(region, "program"), "program_total", *BUCKETS)


def region_terminated_by_program(
    cases: DataFrame, region: str | None = None, pulls: Sequence[dt.date | str] | None = None
) -> DataFrame:
    rows = in_region(cases, region).filter(terminated_lately(cases))
    return rows.groupBy(*pull_keys(pulls), *group_keys(region, "program")).agg(case_count(cases).alias("program_total"))


def region_monitored_by_program(
    cases: DataFrame, region: str | None = None, pulls: Sequence[dt.date | str] | None = None
) -> DataFrame:
    rows = in_region(cases, region).filter(has_status(domain.EFFECTIVE))
    return rows.groupBy(*pull_keys(pulls), *group_keys(region, "program")).agg(case_count(cases).alias("program_total"))


def region_workload_summary(
    cases: DataFrame,
    region: str | None = None,
    statuses: Sequence[str] = domain.PENDING,
    pulls: Sequence[dt.date | str] | None = None,
) -> DataFrame:
    """The five workload counters in one aggregate; one row for a given region, also when empty.
    With ``pulls`` so for each pull."""
    pending = has_status(statuses)
    measures = [
        case_count_where(cases, pending).alias("pending"),
        case_count_where(cases, pending & over_year(cases)).alias("pending_over"),
        case_count_where(cases, pending & under_year(cases)).alias("pending_under"),
        case_count_where(cases, has_status(domain.EFFECTIVE)).alias("monitored"),
        case_count_where(cases, terminated_lately(cases)).alias("terminated"),
    ]
    rows = in_region(cases, region)
    if region is None:
        return rows.groupBy(*pull_keys(pulls), "facility_region").agg(*measures)
    if not pulls:
        return rows.agg(*measures)
    asked = for_pulls(cases.sparkSession.range(0, 1, 1, 1), pulls).select("pull_date")
    return asked.join(rows.groupBy("pull_date").agg(*measures), "pull_date", "left").fillna(0)


def workload_sentences(summary: DataFrame) -> DataFrame:
    """The counters as the sentences of the workload box."""
    captions = {
        "pending": "Pending Cases: ",
        "pending_over": "Pending Cases > 365 days: ",
        "pending_under": "Pending Cases < 365 days: ",
        "monitored": "Monitored Cases: ",
        "terminated": "Terminated Cases: ",
    }
    return summary.withColumns(
        {name: F.concat(F.lit(said), F.col(name).cast("string")) for name, said in captions.items()}
    )


def pending_transposed(
    cases: DataFrame,
    region: str | None = None,
    programs: Sequence[str] | None = None,
    statuses: Sequence[str] = domain.PENDING,
    as_map: bool = False,
) -> DataFrame:
    """Pending counts on their side: a row per bucket and for the total, a column per program.

    A bucket without any case has no row. Without ``programs`` the columns are the programs found:
    Spark looks for them first, in the counts kept at the checkpoint folder if the session has one.
    With ``programs`` the columns are those, whatever is found; all others are summed in
    ``domain.REST_OF_PROGRAMS`` and the whole row in ``domain.ALL_PROGRAMS``, so no case is lost.

    ``as_map`` puts the programs found into one column ``programs``, a map from program to count, and
    the whole row in ``all_programs``: no job while the plan is built, however many programs there are.
    """
    counts = _pending_counts(cases, region, statuses)
    if as_map:
        cells = to_long(counts, ["facility_region", "program"], "pending_status", "total")
        rows = group_keys(region, "pending_status")
        wide = to_map(cells.filter(F.col("total").isNotNull()), rows, "program", "total", "programs")
        whole = F.aggregate(F.map_values("programs"), F.lit(0).cast("long"), lambda a, x: a + x)
        return wide.withColumn("all_programs", whole)
    if programs is None:
        counts = cut_lineage(counts)
    cells = to_long(counts, ["facility_region", "program"], "pending_status", "total")
    cells = cells.filter(F.col("total").isNotNull())
    rows = group_keys(region, "pending_status")
    if programs is None:
        return to_wide(cells, rows, "program", "total")
    rest = domain.REST_OF_PROGRAMS
    listed = F.when(F.col("program").isin(*programs), F.col("program")).otherwise(rest)
    wide = to_wide(cells.withColumn("program", listed), rows, "program", "total", [*programs, rest])
    whole = sum((F.coalesce(F.col(f"`{c}`"), F.lit(0)) for c in [*programs, rest]), F.lit(0))
    return wide.withColumn(domain.ALL_PROGRAMS, whole.cast("long"))


def monitored_representative(cases: DataFrame, order: str = "ea_number") -> DataFrame:
    """One monitored case per region, the first by case number, with the region's count. With
    ``files.PLACE`` as ``order`` it is the first one of the extract."""
    monitored = cases.filter(has_status(domain.EFFECTIVE))
    count = F.count(F.lit(1)).alias("program_total")
    return first_row_per(monitored, "facility_region", order, count)
