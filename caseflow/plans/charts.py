"""Panels as chart data: (panel, x, series, y, label), one row per bar."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseflow import domain
from caseflow.functions import text
from caseflow.functions.categories import (
    age_bucket,
    deficit_series,
    has_status,
    terminated_lately,
)
from caseflow.operators.measures import is_cube, total_or_zero
from caseflow.plans.cube import build_cube

Show = Callable[[Column], Column]


@dataclass(frozen=True)
class Line:
    """One line of a hover label: caption, column, and how the value is printed."""

    caption: str
    column: str
    show: Show = lambda value: value


@dataclass(frozen=True)
class Bars:
    """One series of bars: its name (text, or derived from the height), height and label."""

    name: str | Show
    height: str
    lines: tuple[Line, ...]


@dataclass(frozen=True)
class Panel:
    title: str
    x: str
    bars: tuple[Bars, ...]


@dataclass(frozen=True)
class _Share:
    """The part of a page a case counts for: panel, place, series, whether it belongs there."""

    panel: str
    x: str
    series: Column
    belongs: Column
    measure: str = "case_count"


def _aligned(value: Column) -> Column:
    return text.aligned(value, 2)


# --- fixed values: captions and trace names -------------------------------------------------
_REGION = Line("Region Name: ", "facility_region")
_PROGRAM = Line("Program Name: ", "program")
_SHORT_REGION = Line("Region: ", "facility_region")
_PROGRAM_COUNT = Line("Program Total: ", "program_total")
_REGION_COUNT = Line("Region Total: ", "region_total")
_PROGRAM_CASH = Line("Program Total: $", "program_total", text.money)
_REGION_CASH = Line("Regional Total: $", "regional_total", text.money)
_BUCKETS = ((domain.UNDER_YEAR, "active_lt_365"), (domain.OVER_YEAR, "active_gt_365"))


def _bucket_bars(key: Line, total: Line, caption: str | None = None) -> tuple[Bars, ...]:
    return tuple(
        Bars(name, column, (key, Line(caption or f"{name}: ", column), total))
        for name, column in _BUCKETS
    )


def _deficit(title: str, caption: str, column: str) -> Panel:
    lines = (_SHORT_REGION, Line(f"{caption}: ", column, _aligned))
    return Panel(title, "facility_region", (Bars(deficit_series, column, lines),))


def _by_region(title: str) -> Panel:
    return Panel(
        title,
        "facility_region",
        (Bars("Program Total", "region_total", (_REGION, _REGION_COUNT)),),
    )


def _by_program(title: str) -> Panel:
    return Panel(
        title, "program", (Bars("Program Total", "program_total", (_PROGRAM, _PROGRAM_COUNT)),)
    )


PANELS = {
    "pending_by_region": Panel(
        "Cases Pending By Region",
        "facility_region",
        _bucket_bars(_REGION, Line("Regional Total: ", "total_pending")),
    ),
    "pending_by_program": Panel(
        "Cases Pending By Media",
        "program",
        _bucket_bars(_PROGRAM, Line("Program Total: ", "total_pending")),
    ),
    "monitored_by_region": _by_region("Cases Monitored By Region"),
    "monitored_by_program": _by_program("Cases Monitored By Media"),
    "actions_by_region": _by_region("Enforcement Actions By Region"),
    "actions_by_program": _by_program("Enforcement Actions By Media"),
    "terminated_by_region": _by_region("Cases Terminated (In The Last 12 Months) By Region"),
    "terminated_by_program": _by_program("Cases Terminated (In The Last 12 Months) By Media"),
    "cash_by_region": Panel(
        "Cash Civil Charges By Region",
        "facility_region",
        (Bars("Regional Total", "regional_total", (_REGION, _REGION_CASH)),),
    ),
    "cash_by_program": Panel(
        "Cash Civil Charges By Media",
        "program",
        (Bars("Program Total", "program_total", (_PROGRAM, _PROGRAM_CASH)),),
    ),
    "cash_drill_region": Panel(
        "Cash Civil Charges By Region",
        "program",
        (Bars("Regional Total", "program_total", (_REGION, _PROGRAM, _PROGRAM_CASH)),),
    ),
    "cash_drill_program": Panel(
        "Cash Civil Charges By Media",
        "facility_region",
        (
            Bars(
                "Program Total",
                "regional_total",
                (_REGION, Line("Program Total: $", "regional_total", text.money)),
            ),
        ),
    ),
    "referral_fte_deficit": _deficit(
        "Referral Rate FTE Deficit by Region", "Referral FTE Deficit", "referral_fte_deficit"
    ),
    "current_fte_deficit": _deficit(
        "Current FTE Deficit by Region", "Current FTE Deficit", "current_fte_deficit"
    ),
    "fte_deficits_stacked": Panel(
        "FTE Deficits by Region",
        "facility_region",
        tuple(
            Bars(name, column, (_SHORT_REGION, Line(f"{name}: ", column, text.plain_number)))
            for name, column in (
                ("Referral FTE Deficit", "referral_fte_deficit"),
                ("Current FTE Deficit", "current_fte_deficit"),
            )
        ),
    ),
    "region_pending_by_program": Panel(
        "Cases Pending", "program", _bucket_bars(_PROGRAM, _PROGRAM_COUNT, "Category Count: ")
    ),
    "region_terminated_by_program": _by_program("Cases Terminated"),
    "region_monitored_by_program": _by_program("Cases Monitored"),
    "region_monitored_bar_labels": Panel(
        "Cases Monitored", "program", (Bars("Program Total", "program_total", (_PROGRAM,)),)
    ),
    "monitored_representative": Panel(
        "Cases Monitored",
        "facility_region",
        (Bars("Program Total", "program_total", (_SHORT_REGION, _PROGRAM_COUNT)),),
    ),
}
STATEWIDE_PAGE = (
    "pending_by_region",
    "pending_by_program",
    "monitored_by_region",
    "monitored_by_program",
    "actions_by_region",
    "actions_by_program",
    "cash_by_region",
    "cash_by_program",
    "terminated_by_region",
    "terminated_by_program",
)


def chart_series(table: DataFrame, panel: str) -> DataFrame:
    """Bars of a panel from its table. Each row is unfolded in place; only labels whose decimals
    depend on the other bars bring the rows of the table together."""
    spec = PANELS[panel]
    shown = {n: n.show(F.col(n.column)) for b in spec.bars for n in b.lines}
    texts = {n: f"_text{i}" for i, n in enumerate(shown)}
    table = table.withColumns({texts[n]: text.shown(value) for n, value in shown.items()})
    bars = [
        F.struct(
            (b.name(F.col(b.height)) if callable(b.name) else F.lit(b.name)).alias("series"),
            F.col(b.height).cast("double").alias("y"),
            text.hover(*[text.hover_line(n.caption, F.col(texts[n])) for n in b.lines]).alias("label"),
        )
        for b in spec.bars
    ]
    unfolded = table.select(F.lit(panel).alias("panel"), F.col(spec.x).alias("x"), F.inline(F.array(*bars)))
    return unfolded.select("panel", "x", "series", "y", "label")


def _dealt(cube: DataFrame, shares: list[_Share], ids: Sequence[str] = ()) -> DataFrame:
    """Every cube row dealt out to the bars it counts for, then summed per bar."""
    bars = [
        F.struct(
            F.lit(s.panel).alias("panel"),
            F.col(s.x).alias("x"),
            s.series.alias("series"),
            F.col(s.measure).cast("double").alias("value"),
            F.coalesce(s.belongs, F.lit(False)).alias("belongs"),
        )
        for s in shares
    ]
    dealt = cube.select(*ids, F.inline(F.array(*bars))).filter("belongs")
    bar_height = total_or_zero(F.col("value")).alias("y")
    return dealt.groupBy(*ids, "panel", "x", "series").agg(bar_height)


def _first_name(panel: str) -> Column:
    return F.lit(PANELS[panel].bars[0].name)


def statewide_page(cases: DataFrame) -> DataFrame:
    """The bar heights of all ten statewide panels in one pass: (panel, x, series, y).

    Cases are summed to the cube first, so the unfolding handles a handful of rows. A bar without
    cases has no row.
    """
    cube = cases if is_cube(cases) else build_cube(cases)
    shares = []
    for x, whose in (("facility_region", "region"), ("program", "program")):
        for what, belongs, measure in (
            ("pending", has_status(domain.PENDING), "case_count"),
            ("monitored", has_status(domain.EFFECTIVE), "case_count"),
            ("actions", has_status(domain.EFFECTIVE), "case_count"),
            ("terminated", terminated_lately(cube), "case_count"),
            ("cash", F.lit(True), "cash_total"),
        ):
            panel = f"{what}_by_{whose}"
            series = age_bucket(cube) if what == "pending" else _first_name(panel)
            shares.append(_Share(panel, x, series, belongs, measure))
    return _dealt(cube, shares)


def regional_pages(cases: DataFrame) -> DataFrame:
    """The bar heights of the three panels of every regional page, in one pass:
    (facility_region, panel, x, series, y). Cases without region are on no page."""
    cube = cases if is_cube(cases) else build_cube(cases)
    shares = []
    for what, belongs in (
        ("pending", has_status(domain.PENDING)),
        ("terminated", terminated_lately(cube)),
        ("monitored", has_status(domain.EFFECTIVE)),
    ):
        panel = f"region_{what}_by_program"
        series = age_bucket(cube) if what == "pending" else _first_name(panel)
        shares.append(_Share(panel, "program", series, belongs))
    placed = cube.filter(F.col("facility_region").isNotNull())
    return _dealt(placed, shares, ["facility_region"])
