"""Figures of several pulls side by side."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame

from caseflow.operators.rows import of_pulls

Plan = Callable[..., DataFrame]


def by_pull(cases: DataFrame, plan: Plan, pull_dates: Sequence[dt.date | str]) -> DataFrame:
    """``plan`` on each of the pulls in ``cases`` (rows or a cube), told apart by ``pull_date``.

    A plan on its own counts all it is given, and would add the pulls up. With ``pulls`` it has the
    pull date as its leading key: one reading and one aggregation, however many pulls, with template
    rows, zero-filled buckets and totals of each pull's own. Of stored cases only the partitions of
    these pulls are read. A pull that is listed twice counts once.
    """
    if not pull_dates:
        raise ValueError("no pull date given")
    dates = [*dict.fromkeys(pull_dates)]
    return plan(of_pulls(cases, dates), pulls=dates)
