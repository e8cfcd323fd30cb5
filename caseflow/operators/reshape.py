"""Long to wide and back, on aggregated tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseflow.functions.text import MISSING


def to_long(df: DataFrame, ids: Sequence[str], names_to: str, values_to: str) -> DataFrame:
    """All columns but ``ids`` as (name, value) rows; missing values stay."""
    measures = [c for c in df.columns if c not in ids]
    return df.unpivot([*ids], measures, names_to, values_to)


def to_wide(
    df: DataFrame,
    ids: Sequence[str],
    names_from: str,
    values_from: str,
    names: Sequence[str] | None = None,
) -> DataFrame:
    """One column per value of ``names_from`` with the sum of its cells; a missing one is NULL.

    With ``names`` only those get a column: whoever lists them says where the others go. Without,
    Spark reads the distinct values first and refuses more than ``spark.sql.pivotMaxValues``."""
    grouped = df.groupBy(*ids)
    pivoted = grouped.pivot(names_from, [*names]) if names else grouped.pivot(names_from)
    return pivoted.agg(F.sum(values_from))


def to_map(
    df: DataFrame, ids: Sequence[str], names_from: str, values_from: str, to: str
) -> DataFrame:
    """One map column from each value of ``names_from`` to the sum of its cells.

    Nothing has to be known beforehand and no number of names is too many. A missing name is the text
    ``MISSING``, and added to one that is called so.
    """
    name = F.coalesce(names_from, F.lit(MISSING))
    sums = df.groupBy(*ids, name.alias("_name")).agg(F.sum(values_from).alias("_sum"))
    entries = F.array_sort(F.collect_list(F.struct("_name", "_sum")))
    return sums.groupBy(*ids).agg(F.map_from_entries(entries).alias(to))
