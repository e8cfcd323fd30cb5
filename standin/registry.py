"""Every query of the engine over the stand-in case view, by name."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseflow import domain
from caseflow.plans import charts, cube, export, pulls, recon, regional, staffing, statewide
from caseflow.session import checkpoint_folder
from caseflow.sources import store
from standin.tables import EARLIER_PULL, PULL_DATE, CaseTables

REGION = "ASIA"
REGIONS = ["ASIA", "EUROPE", "NOWHERE"]
PROGRAM_SELECTION = ["Air", "Waste"]

Query = Callable[[SparkSession, str], DataFrame]


def _rounded(df: DataFrame, digits: int, *names: str) -> DataFrame:
    """Money and ratios at a fixed number of digits, so that the order of summation cannot show."""
    return df.withColumns({n: F.round(n, digits) for n in names})


def _portable(df: DataFrame) -> DataFrame:
    """Dates as ISO text, which every engine prints alike."""
    days = [name for name, kind in df.dtypes if kind == "date"]
    return df.withColumns({d: F.col(d).cast("string") for d in days}) if days else df


def _on_cases(plan: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, folder: _portable(plan(CaseTables(spark, folder).cases()))


def _on_tables(plan: Callable[[CaseTables], DataFrame]) -> Query:
    return lambda spark, folder: _portable(plan(CaseTables(spark, folder)))


def _staffed(plan: Callable[..., DataFrame], **settings) -> Callable[[CaseTables], DataFrame]:
    return lambda t: plan(t.cases(), t.org_chart(), t.referral_rates(), **settings)


def _fte(t: CaseTables, **settings) -> DataFrame:
    return _staffed(staffing.fte_deficit_by_region, **settings)(t)


def _fte_rounded(t: CaseTables, **settings) -> DataFrame:
    return _rounded(_fte(t, **settings), 4, "referral_fte_deficit", "current_fte_deficit")


def _reconciled(t: CaseTables) -> DataFrame:
    """This year's cases that the earlier pull's table of touched cases has too."""
    earlier = recon.prepare_touched(t.raw_cases(), t.facilities(), EARLIER_PULL)
    return recon.reconcile_cases(recon.year_to_date(t.cases()), earlier)


def _reconciled_stored(t: CaseTables) -> DataFrame:
    """The same from two stored pulls that are dealt out by case number."""
    spark = t.spark
    shared = checkpoint_folder(spark) or spark.conf.get("spark.sql.warehouse.dir")
    folder, buckets = f"{shared}/pulls-{uuid.uuid4().hex}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    earlier = recon.prepare_touched(t.raw_cases(), t.facilities(), EARLIER_PULL)
    store.write_pull(recon.year_to_date(t.cases()), folder, PULL_DATE, buckets)
    store.write_pull(earlier, folder, EARLIER_PULL, buckets)
    one, other = (store.read_pull(spark, folder, date, buckets) for date in (PULL_DATE, EARLIER_PULL))
    return recon.reconcile_stored(one, other)


def _transposed_cells(cases: DataFrame) -> DataFrame:
    """The cells of the transposed table whose programs are not known beforehand."""
    wide = regional.pending_transposed(cases, as_map=True)
    cells = F.explode("programs").alias("program", "total")
    return wide.select("facility_region", "pending_status", "all_programs", cells)


def _both_pulls(plan: Callable[[DataFrame], DataFrame]) -> Callable[[CaseTables], DataFrame]:
    return lambda t: pulls.by_pull(t.cases_of_pulls(PULL_DATE, EARLIER_PULL), plan, [PULL_DATE, EARLIER_PULL])


def _with_stored_totals(key: str) -> Callable[[DataFrame], DataFrame]:
    """Rows with the totals of a cube, which a deployment reads from where it published it."""
    return lambda c: statewide.with_cash_total(c, key, statewide.cash_by(cube.build_cube(c), key))


def _transposed(cases: DataFrame, region: str | None) -> DataFrame:
    wide = regional.pending_transposed(cases, region, domain.PROGRAMS)
    names = [*domain.PROGRAMS, domain.REST_OF_PROGRAMS, domain.ALL_PROGRAMS]
    return wide.withColumnsRenamed({p: p.lower().replace("/", "_") for p in names})


def _chart(panel: str, plan: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    return lambda cases: charts.chart_series(plan(cases), panel)


QUERIES: dict[str, Query] = {
    # preparation
    "cases_prepared": _on_tables(lambda t: t.cases()),
    "cases_prepared_utc_pull": _on_tables(lambda t: t.cases(utc_pull=True)),
    "cases_prepared_as_extract": _on_tables(
        lambda t: t.cases(always_to_pull=True, groups=domain.EXTRACT_PROGRAM_GROUPS)
    ),
    "cases_touched_since_last_year": _on_tables(
        lambda t: recon.prepare_touched(t.raw_cases(), t.facilities(), PULL_DATE)
    ),
    "cases_year_to_date": _on_cases(recon.year_to_date),
    "cases_year_to_date_at_source": _on_tables(
        lambda t: recon.prepare_year_to_date(t.raw_cases(), t.facilities(), PULL_DATE)
    ),
    "reconcile_cases": _on_tables(_reconciled),
    "reconcile_stored_pulls": _on_tables(_reconciled_stored),
    "pull_date_banner": _on_cases(recon.pull_date_banner),
    "cases_prepared_from_view": _on_tables(lambda t: t.cases_from_views()),
    # several pulls
    "pending_by_region_two_pulls": _on_tables(_both_pulls(statewide.pending_by_region)),
    "region_workload_two_pulls": _on_tables(_both_pulls(regional.region_workload_summary)),
    "pull_date_banner_two_pulls": _on_tables(
        lambda t: recon.pull_date_banner(t.cases_of_pulls(PULL_DATE, EARLIER_PULL))
    ),
    # statewide panels
    "pending_by_region": _on_cases(statewide.pending_by_region),
    "pending_by_program": _on_cases(statewide.pending_by_program),
    "pending_by_region_two_statuses": _on_cases(
        lambda c: statewide.pending_by_region(
            c, statuses=domain.PENDING_TWO, include_template=False
        )
    ),
    "monitored_by_region": _on_cases(statewide.monitored_by_region),
    "monitored_by_program": _on_cases(statewide.monitored_by_program),
    "actions_by_region": _on_cases(statewide.actions_by_region),
    "actions_by_program": _on_cases(statewide.actions_by_program),
    "actions_by_region_all": _on_cases(lambda c: statewide.actions_by_region(c, None)),
    "actions_by_program_all": _on_cases(lambda c: statewide.actions_by_program(c, None)),
    "terminated_by_region": _on_cases(statewide.terminated_by_region),
    "terminated_by_program": _on_cases(statewide.terminated_by_program),
    "cash_by_region": _on_cases(
        lambda c: _rounded(statewide.cash_by_region(c), 2, "regional_total")
    ),
    "cash_by_program": _on_cases(
        lambda c: _rounded(statewide.cash_by_program(c), 2, "program_total")
    ),
    "cash_drill_region": _on_cases(
        lambda c: _rounded(statewide.cash_drill_region(c, REGIONS), 2, "program_total")
    ),
    "cash_drill_program": _on_cases(
        lambda c: _rounded(statewide.cash_drill_program(c, PROGRAM_SELECTION), 2, "regional_total")
    ),
    "cash_drill_rows": _on_cases(
        lambda c: _rounded(statewide.cash_drill_rows(c, REGIONS), 2, "program_total")
    ),
    "cases_with_regional_cash": _on_cases(
        lambda c: _rounded(statewide.with_cash_total(c, statewide.REGION), 2, "regional_total")
    ),
    "cases_with_program_cash": _on_cases(
        lambda c: _rounded(statewide.with_cash_total(c, statewide.PROGRAM), 2, "program_total")
    ),
    "cases_with_stored_program_cash": _on_cases(
        lambda c: _rounded(_with_stored_totals(statewide.PROGRAM)(c), 2, "program_total")
    ),
    # staffing
    "capacity_by_region": _on_tables(lambda t: staffing.capacity_by_region(t.org_chart())),
    "fte_deficit_by_region": _on_tables(_fte_rounded),
    "fte_deficit_all_regions": _on_tables(lambda t: _fte_rounded(t, all_regions=True)),
    "region_capacity_fte": _on_tables(
        lambda t: _rounded(
            _staffed(staffing.region_capacity_fte)(t), 2, "referral_deficit", "current_deficit"
        )
    ),
    "region_roster": _on_tables(lambda t: staffing.region_roster(t.org_chart())),
    # regional tables
    "region_pending_detail": _on_cases(regional.region_pending_detail),
    "region_pending_detail_one": _on_cases(lambda c: regional.region_pending_detail(c, REGION)),
    "region_terminated_detail": _on_cases(regional.region_terminated_detail),
    "region_monitored_detail": _on_cases(regional.region_monitored_detail),
    "monitored_with_program_total": _on_cases(
        lambda c: regional.with_program_total(regional.region_monitored_detail(c))
    ),
    "monitored_with_region_total": _on_cases(
        lambda c: regional.with_region_total(regional.region_monitored_detail(c))
    ),
    "pending_with_age_bucket": _on_cases(regional.pending_cases),
    "region_pending_by_program": _on_cases(regional.region_pending_by_program),
    "region_pending_by_program_one": _on_cases(
        lambda c: regional.region_pending_by_program(c, REGION)
    ),
    "region_terminated_by_program": _on_cases(regional.region_terminated_by_program),
    "region_monitored_by_program": _on_cases(regional.region_monitored_by_program),
    "region_workload_summary": _on_cases(regional.region_workload_summary),
    "region_workload_summary_one": _on_cases(
        lambda c: regional.region_workload_summary(c, REGION)
    ),
    "region_workload_sentences": _on_cases(
        lambda c: regional.workload_sentences(regional.region_workload_summary(c))
    ),
    "pending_transposed": _on_cases(lambda c: _transposed(c, None)),
    "pending_transposed_cells": _on_cases(_transposed_cells),
    "pending_transposed_one": _on_cases(lambda c: _transposed(c, REGION)),
    "monitored_representative": _on_cases(regional.monitored_representative),
    # the cube, and a page from it
    "case_cube": _on_cases(lambda c: _rounded(cube.build_cube(c), 2, "cash_total")),
    "case_cube_early": _on_tables(
        lambda t: _rounded(
            cube.build_cube_early(t.raw_cases(), t.facilities(), PULL_DATE), 2, "cash_total"
        )
    ),
    "statewide_page": _on_cases(lambda c: _rounded(charts.statewide_page(c), 2, "y")),
    "regional_pages": _on_cases(lambda c: _rounded(charts.regional_pages(c), 2, "y")),
    "statewide_page_early": _on_tables(
        lambda t: _rounded(
            charts.statewide_page(
                cube.build_cube_early(t.raw_cases(), t.facilities(), PULL_DATE)
            ),
            2,
            "y",
        )
    ),
    # chart data
    "chart_pending_by_region": _on_cases(_chart("pending_by_region", statewide.pending_by_region)),
    "chart_region_pending_by_program": _on_cases(
        _chart("region_pending_by_program", lambda c: regional.region_pending_by_program(c, REGION))
    ),
    "chart_monitored_by_program": _on_cases(
        _chart("monitored_by_program", statewide.monitored_by_program)
    ),
    "chart_cash_drill_region": _on_cases(
        _chart(
            "cash_drill_region",
            lambda c: _rounded(statewide.cash_drill_region(c, REGIONS), 2, "program_total"),
        )
    ),
    "chart_cash_by_region": _on_cases(
        _chart(
            "cash_by_region",
            lambda c: _rounded(statewide.cash_by_region(c), 2, "regional_total"),
        )
    ),
    "chart_cash_by_program": _on_cases(
        _chart(
            "cash_by_program",
            lambda c: _rounded(statewide.cash_by_program(c), 2, "program_total"),
        )
    ),
    "chart_referral_fte_deficit": _on_tables(
        lambda t: _rounded(charts.chart_series(_fte(t), "referral_fte_deficit"), 4, "y")
    ),
    "chart_current_fte_deficit": _on_tables(
        lambda t: _rounded(charts.chart_series(_fte(t), "current_fte_deficit"), 4, "y")
    ),
    **{
        f"chart_{name}": _on_cases(_chart(name, getattr(statewide, name)))
        for name in (
            "pending_by_program",
            "monitored_by_region",
            "actions_by_region",
            "actions_by_program",
            "terminated_by_region",
            "terminated_by_program",
        )
    },
    "chart_cash_drill_program": _on_cases(
        _chart(
            "cash_drill_program",
            lambda c: _rounded(
                statewide.cash_drill_program(c, PROGRAM_SELECTION), 2, "regional_total"
            ),
        )
    ),
    "chart_fte_deficits_stacked": _on_tables(
        lambda t: _rounded(charts.chart_series(_fte_rounded(t), "fte_deficits_stacked"), 4, "y")
    ),
    "chart_region_terminated_by_program": _on_cases(
        _chart(
            "region_terminated_by_program",
            lambda c: regional.region_terminated_by_program(c, REGION),
        )
    ),
    "chart_region_monitored_by_program": _on_cases(
        _chart(
            "region_monitored_by_program",
            lambda c: regional.region_monitored_by_program(c, REGION),
        )
    ),
    "chart_region_monitored_bar_labels": _on_cases(
        _chart(
            "region_monitored_bar_labels",
            lambda c: regional.region_monitored_by_program(c, REGION),
        )
    ),
    "chart_monitored_representative": _on_cases(
        _chart("monitored_representative", regional.monitored_representative)
    ),
    # export
    "export_pending": _on_cases(lambda c: export.export_rows(c, "pending")),
    "export_terminated": _on_cases(lambda c: export.export_rows(c, "terminated")),
    "export_monitored": _on_cases(lambda c: export.export_rows(c, "monitored")),
}
