"""Choosing and arranging rows and columns."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseflow.functions.dates import as_date
from caseflow.operators.joins import lookup


def columns_between(df: DataFrame, first: str, last: str) -> list[str]:
    """Names from ``first`` to ``last`` in table order, both included."""
    names = df.columns
    return names[names.index(first) : names.index(last) + 1]


def move_first(df: DataFrame, name: str, drop: Sequence[str] = ()) -> DataFrame:
    return df.select(name, *[c for c in df.columns if c != name and c not in drop])


def in_region(df: DataFrame, region: str | None, column: str = "facility_region") -> DataFrame:
    """Rows of one region, or all rows when ``region`` is None."""
    return df if region is None else df.filter(F.col(column) == region)


def group_keys(region: str | None, *keys: str) -> list[str]:
    """Grouping keys of a regional table: the region leads when all regions are wanted."""
    return [*keys] if region is not None else ["facility_region", *keys]


def pull_keys(pulls: Sequence[dt.date | str] | None) -> list[str]:
    """The leading grouping key where a table is wanted for several pulls."""
    return ["pull_date"] if pulls else []


def of_pulls(df: DataFrame, pulls: Sequence[dt.date | str] | None) -> DataFrame:
    """Rows of the given pulls, in one reading; all rows without any."""
    return df.filter(F.col("pull_date").isin(*map(as_date, pulls))) if pulls else df


def for_pulls(df: DataFrame, pulls: Sequence[dt.date | str] | None) -> DataFrame:
    """Every row once for each of the pulls, as ``pull_date``."""
    return df.withColumn("pull_date", F.explode(F.array(*map(as_date, pulls)))) if pulls else df


def first_row_per(
    df: DataFrame, keys: str | Sequence[str], order: str, *aggregates: Column
) -> DataFrame:
    """One whole row per key, the lowest by ``order`` and then by the other columns in turn, with
    ``aggregates`` of its group. Rows without ``order`` come last.

    The lowest ``order`` and the aggregates need a few narrow columns; the wide rows are read a
    second time and only those of the winners are kept. Ties are settled among the few rows left.
    """
    keys = [keys] if isinstance(keys, str) else [*keys]
    rest = [c for c in df.columns if c not in (*keys, order)]
    groups = df.groupBy(*keys).agg(F.min(order).alias("_lowest"), *aggregates)
    added = [c for c in groups.columns if c not in (*keys, "_lowest")]
    wins = [F.col(f"r.{a}").eqNullSafe(F.col(f"g.{b}")) for a, b in zip([*keys, order], [*keys, "_lowest"])]
    first = df.alias("r").join(groups.alias("g"), wins).select("r.*", *[f"g.{c}" for c in added])
    picked = first.groupBy(*keys, order, *added).agg(F.min(F.struct(*rest)).alias("_row"))
    columns = [F.col(c) if c in (*keys, order) else F.col("_row")[c].alias(c) for c in df.columns]
    return picked.select(*columns, *added)


def with_group_value(
    df: DataFrame, key: str, name: str, value: Column, totals: DataFrame | None = None
) -> DataFrame:
    """Every row with an aggregate of its group: aggregated first, then joined back, so no group
    has to sit in one task.

    ``totals`` has the values already (key and ``name``), best read from a stored table, whose size
    Spark knows. Without it they are computed in a second reading, and Spark chooses the join at run
    time by the size they turn out to have.
    """
    of_groups = df.groupBy(key).agg(value.alias(name)) if totals is None else totals.select(key, name)
    return lookup(df, of_groups, key, key)


def has_value(df: DataFrame, name: str) -> bool:
    """Whether any row has a value in the column; stops at the first one found."""
    return not df.filter(F.col(name).isNotNull()).isEmpty()


def distinct_values(df: DataFrame, name: str) -> DataFrame:
    return df.select(name).distinct()


def in_key_order(df: DataFrame, *keys: str, collation: str | None = None) -> DataFrame:
    """Presentation order: ascending keys, missing ones last.

    Text is ordered by code point unless a collation is named: capitals before small letters, accents
    behind both. ``UNICODE`` orders as dictionaries do, ``de`` or another locale as that language does.
    """
    text = {f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)}
    by = [F.collate(k, collation) if collation and k in text else F.col(k) for k in keys]
    return df.orderBy(*[k.asc_nulls_last() for k in by])


def template_row(df: DataFrame) -> DataFrame:
    """One row of missing values with the columns of ``df``."""
    blanks = [F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema.fields]
    return df.sparkSession.range(0, 1, 1, 1).select(*blanks)
