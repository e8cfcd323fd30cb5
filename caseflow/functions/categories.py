"""Classifications of a case, written so that they work on case rows and on the case cube alike."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseflow import domain
from caseflow.functions.dates import NTZ, year_earlier


def program_group(name: Column, groups: Mapping[str, Sequence[str]] = domain.PROGRAM_GROUPS) -> Column:
    """Reporting program of a source program name."""
    chain = F.when(name.isNull(), domain.NO_PROGRAM)
    for group, members in groups.items():
        chain = chain.when(name.isin(*members), group)
    return chain.otherwise(name)


def _flag_or(df: DataFrame, flag: str, condition: Column) -> Column:
    return F.col(flag) if flag in df.columns else F.coalesce(condition, F.lit(False))


def over_year(df: DataFrame) -> Column:
    """At least 365 days pending; an unknown age is not over."""
    return _flag_or(df, "over_year", F.col("days_pending") >= domain.YEAR_DAYS)


def under_year(df: DataFrame) -> Column:
    """At most 365 days pending. Day 365 is in both counters, an unknown age in neither."""
    return _flag_or(df, "under_year", F.col("days_pending") <= domain.YEAR_DAYS)


def age_bucket(df: DataFrame) -> Column:
    """Two buckets covering every pending case; an unknown age falls in the lower one."""
    return F.when(over_year(df), domain.OVER_YEAR).otherwise(domain.UNDER_YEAR)


def terminated_lately(df: DataFrame) -> Column:
    """Terminated no earlier than twelve months before the pull date, that day included."""
    cutoff = year_earlier(F.col("pull_date")).cast(NTZ)
    recent = F.col("recent_term") if "recent_term" in df.columns else F.col("term_date") >= cutoff
    return has_status(domain.TERMINATED) & recent


def has_status(statuses: Sequence[str]) -> Column:
    return F.col("status_code").isin(*statuses)


def position_class(position: Column) -> Column:
    """Box a position is shown in; positions in neither list stay visible as ``unlisted``."""
    return (
        F.when(position.isin(*domain.MANAGER_POSITIONS), "manager")
        .when(position.isin(*domain.SPECIALIST_POSITIONS), "specialist")
        .otherwise("unlisted")
    )


def deficit_color(deficit: Column) -> Column:
    return F.when(deficit < 0, domain.DEFICIT_COLOR).when(deficit >= 0, domain.SURPLUS_COLOR)


def deficit_series(deficit: Column) -> Column:
    return F.when(deficit < 0, "< 0").when(deficit >= 0, "> 0")
