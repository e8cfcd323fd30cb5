"""Counts and sums that give the same figures on case rows and on the case cube.

A cube row stands for ``case_count`` cases, a case row for one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_cube(df: DataFrame) -> bool:
    return "case_count" in df.columns


def case_count(df: DataFrame) -> Column:
    """Number of cases; 0 over no rows."""
    if is_cube(df):
        return F.coalesce(F.sum("case_count"), F.lit(0).cast("long"))
    return F.count(F.lit(1))


def case_count_where(df: DataFrame, condition: Column) -> Column:
    if is_cube(df):
        return F.coalesce(F.sum(F.when(condition, F.col("case_count"))), F.lit(0).cast("long"))
    return F.count_if(condition)


def cash_total(df: DataFrame) -> Column:
    """Penalty total; missing charges add nothing and no charge at all is 0."""
    return total_or_zero(F.col("cash_total" if is_cube(df) else "cash_civil_charge"))


def total_or_zero(value: Column) -> Column:
    return F.coalesce(F.sum(value), F.lit(0))


def strict_total(value: Column) -> Column:
    """Sum that is NULL as soon as one value is missing."""
    return F.when(F.count(value) == F.count(F.lit(1)), F.sum(value))


def null_if_zero(count: Column) -> Column:
    return F.nullif(count, F.lit(0))
