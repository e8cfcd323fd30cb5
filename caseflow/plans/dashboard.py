"""Everything the dashboard shows, from one pass over the cases."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseflow.operators.rows import distinct_values, for_pulls, in_key_order, of_pulls
from caseflow.plans import charts, recon, regional, staffing, statewide
from caseflow.plans.cube import build_cube
from caseflow.plans.export import DETAIL, export_detail
from caseflow.session import cut_lineage


def dashboard_tables(
    counted: DataFrame,
    org_chart: DataFrame,
    referral_rates: DataFrame,
    pulls: Sequence[dt.date | str] | None = None,
) -> dict[str, DataFrame]:
    """Every statewide panel, every regional table for all regions, and the staffing tables.

    ``counted`` is the case table or, to pay for one pass only, a stored cube. With ``pulls`` every
    table has a ``pull_date`` and the figures of each pull.
    """
    staff, of = (org_chart, referral_rates), {"pulls": pulls}
    panels = {name: getattr(statewide, name)(counted, **of) for name in charts.STATEWIDE_PAGE}
    return panels | {
        "region_pending_by_program": regional.region_pending_by_program(counted, **of),
        "region_terminated_by_program": regional.region_terminated_by_program(counted, **of),
        "region_monitored_by_program": regional.region_monitored_by_program(counted, **of),
        "region_workload_summary": regional.region_workload_summary(counted, **of),
        "region_capacity_fte": staffing.region_capacity_fte(counted, *staff, **of),
        "region_roster": for_pulls(staffing.region_roster(org_chart), pulls),
        "fte_deficit_by_region": staffing.fte_deficit_by_region(counted, *staff, **of),
        "pull_date_banner": recon.pull_date_banner(counted),
    }


def publish(
    cases: DataFrame,
    org_chart: DataFrame,
    referral_rates: DataFrame,
    folder: str,
    exports: bool = False,
) -> None:
    """Write the cube and every dashboard table below ``folder``, which all executors must reach.

    The cube is written first and read back, so each further table is a job over a few hundred
    rows. Every table has one ``pull=`` directory for each pull in ``cases``, with that pull's own
    figures in key order; those of other pulls stay. ``exports`` adds the CSV files of case detail,
    one pass over the cases for each kind.
    """
    spark, cube_path = cases.sparkSession, f"{folder}/case_cube"
    cube = cut_lineage(build_cube(cases)).withColumn("pull", F.col("pull_date"))
    written = cube.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    written.partitionBy("pull").parquet(cube_path)
    pulls = [pull for (pull,) in distinct_values(cube, "pull").collect()]
    if pulls:
        counted = of_pulls(spark.read.parquet(cube_path).drop("pull"), pulls)
        for name, table in dashboard_tables(counted, org_chart, referral_rates, pulls).items():
            placed = table.withColumn("pull", F.col("pull_date"))
            placed = placed if name == "pull_date_banner" else placed.drop("pull_date")
            ordered = in_key_order(placed, "pull", placed.columns[0])
            writer = ordered.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            writer.partitionBy("pull").parquet(f"{folder}/{name}")
    if exports:
        for kind in DETAIL:
            export_detail(cases, kind, f"{folder}/exports")
