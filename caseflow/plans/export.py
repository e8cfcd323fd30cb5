"""CSV export of case detail and display labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseflow import domain
from caseflow.plans.regional import (
    region_monitored_detail,
    region_pending_detail,
    region_terminated_detail,
)
from caseflow.sources.store import write_csv

DETAIL = {
    "pending": region_pending_detail,
    "terminated": region_terminated_detail,
    "monitored": region_monitored_detail,
}


def with_labels(rows: DataFrame) -> DataFrame:
    """Display labels as column names."""
    return rows.select(*[F.col(c).alias(domain.DISPLAY_LABELS.get(c, c)) for c in rows.columns])


def export_name(kind: str, region: Column, pull_date: Column) -> Column:
    """File name of an export, by kind, region and pull date."""
    stem = F.concat_ws("_", region, pull_date.cast("string"))
    return F.concat(F.lit(domain.EXPORT_PREFIXES[kind]), stem, F.lit(".csv"))


def export_rows(cases: DataFrame, kind: str, region: str | None = None) -> DataFrame:
    """Detail rows, each with the name of the file it belongs to. A case without region is in no
    regional export."""
    name = export_name(kind, F.col("facility_region"), F.col("pull_date"))
    placed = cases.filter(F.col("facility_region").isNotNull()).withColumn("export_file", name)
    return DETAIL[kind](placed, region, keep=["export_file"])


def export_detail(cases: DataFrame, kind: str, folder: str, region: str | None = None) -> None:
    """Write detail as CSV below ``folder``, one file per region and pull date under the name users
    know it by, or numbered parts of a region that is too large for one task. Files of other regions
    and pulls stay; a failed export leaves everything as it was."""
    write_csv(with_labels(export_rows(cases, kind, region)), f"{folder}/{kind}", "export_file")
