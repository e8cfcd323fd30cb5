"""The eleven cases through every plan."""

import golden
import pytest
from pyspark.sql import functions as F

from caseflow import domain
from caseflow.operators import rows as row_operators
from caseflow.operators.joins import lookup
from caseflow.plans import charts, cube, export, recon, regional, staffing, statewide
from caseflow.plans.prepare import prepare_cases
from caseflow.plans.pulls import by_pull
from caseflow.plans.statewide import pending_by


@pytest.fixture(scope="module")
def cases(spark):
    prepared = prepare_cases(golden.raw(spark), golden.facilities(spark), golden.PULL_DATE)
    return prepared.cache()


@pytest.fixture(scope="module", params=["cases", "cube"])
def counted(request, cases):
    """Counting plans take the case table or the cube."""
    return cases if request.param == "cases" else cube.build_cube(cases)


def rows(df, digits=None):
    found = (tuple(round(v, digits) if digits and isinstance(v, float) else v for v in r) for r in df.collect())
    return sorted(found, key=repr)


def expect(df, wanted, digits=None):
    assert rows(df, digits) == sorted(wanted, key=repr)


def test_prepared(cases):
    assert tuple(cases.columns) == domain.CASES_COLUMNS and len(cases.columns) == 18
    found = {r.ea_number: (r.facility_name, r.program, r.days_pending) for r in cases.collect()}
    assert found == {
        "EA1": ("Acme", "Waste", 365),
        "EA2": ("Acme", "VWP", 1),
        "EA3": ("Beta", "Other", None),
        "EA4": ("Beta", "AST/UST", 468),
        "EA5": ("Beta", "AST/UST", 467),
        "EA9": ("Ghost", "Other", 44),
        "EA10": ("Acme", "Air", None),
        "EA11": ("Acme", "VPDES", 0),
    }


def test_utc_pull_moves_open_cases_only(spark):
    shifted = prepare_cases(
        golden.raw(spark), golden.facilities(spark), golden.PULL_DATE, utc_pull=True
    )
    days = {r.ea_number: r.days_pending for r in shifted.collect()}
    assert (days["EA1"], days["EA2"], days["EA4"], days["EA11"]) == (364, 0, 468, 0)


def test_always_to_pull(spark):
    open_ended = prepare_cases(
        golden.raw(spark), golden.facilities(spark), golden.PULL_DATE, always_to_pull=True
    )
    days = {r.ea_number: r.days_pending for r in open_ended.collect()}
    assert (days["EA1"], days["EA4"], days["EA5"]) == (365, 834, 834)


def test_salted_join_gives_the_same_cases(spark, cases):
    salted = prepare_cases(golden.raw(spark), golden.facilities(spark), golden.PULL_DATE, salt=4)
    assert rows(salted) == rows(cases)


def test_early_cube_equals_cube(spark, cases):
    early = cube.build_cube_early(golden.raw(spark), golden.facilities(spark), golden.PULL_DATE)
    columns = [*cube.DIMENSIONS, "case_count", "cash_total"]
    assert rows(early.select(*columns)) == rows(cube.build_cube(cases).select(*columns))


def test_facility_listed_twice_doubles_its_cases(spark, cases):
    twice = golden.facilities(spark).union(golden.facilities(spark))
    early = cube.build_cube_early(golden.raw(spark), twice, golden.PULL_DATE)
    late = cube.build_cube(prepare_cases(golden.raw(spark), twice, golden.PULL_DATE))
    assert rows(early) == rows(late)
    assert early.agg(F.sum("case_count")).first()[0] == 2 * cases.count()


def test_pending_by_region(counted):
    expect(
        statewide.pending_by_region(counted),
        [("PRO", 2, 1, 3), (None, 1, None, 1), (None, None, None, 1)],
    )


def test_pending_by_program(counted):
    expect(
        statewide.pending_by_program(counted),
        [
            ("Other", 1, None, 1),
            ("VPDES", 1, None, 1),
            ("VWP", 1, None, 1),
            ("Waste", None, 1, 1),
            (None, None, None, 0),
        ],
    )


def test_pending_two_statuses_without_template(counted):
    got = pending_by(counted, "facility_region", domain.PENDING_TWO, include_template=False)
    expect(got, [("PRO", 1, 1, 2), (None, 1, None, 1)])


def test_counts(counted):
    expect(statewide.monitored_by_region(counted), [("PRO", 1), ("TRO", 1)])
    expect(statewide.monitored_by_program(counted), [("Air", 1), ("Other", 1)])
    expect(statewide.actions_by_region(counted), [("PRO", 1), ("TRO", 1)])
    every = [("BRRO", 2), ("PRO", 4), ("TRO", 1), (None, 1)]
    expect(statewide.actions_by_region(counted, None), every)
    expect(statewide.terminated_by_region(counted), [("BRRO", 1)])
    expect(statewide.terminated_by_program(counted), [("AST/UST", 1)])


def test_cash(counted):
    expect(
        statewide.cash_by_region(counted),
        [("BRRO", 750.0), ("PRO", 1075.5), ("TRO", 0.0), (None, 0.0)],
    )
    expect(
        statewide.cash_by_program(counted),
        [
            ("AST/UST", 750.0),
            ("Air", 75.5),
            ("Other", 0.0),
            ("VPDES", 0.0),
            ("VWP", 0.0),
            ("Waste", 1000.0),
        ],
    )


def test_cash_drill(counted):
    pro = [("Air", "PRO", 75.5), ("Other", "PRO", 0.0), ("VWP", "PRO", 0.0), ("Waste", "PRO", 1000.0)]
    expect(statewide.cash_drill_region(counted, ["PRO"]), pro)
    expect(
        statewide.cash_drill_region(counted, ["PRO", "TRO", "Waste"]), [*pro, ("Other", "TRO", 0.0)]
    )
    assert rows(statewide.cash_drill_region(counted)) == rows(statewide.cash_by_region(counted))
    expect(
        statewide.cash_drill_program(counted, ["AST/UST", "Air"]), [("BRRO", 750.0), ("PRO", 75.5)]
    )


def test_drilled_total_spans_the_selection(spark):
    many = spark.createDataFrame(
        [("PRO", "Air", 1.0), ("PRO", "Air", 2.0), ("TRO", "Air", 4.0), ("VRO", "Air", 8.0)],
        "facility_region string, program string, cash_civil_charge double",
    )
    expect(
        statewide.cash_drill_region(many, ["PRO", "TRO"]), [("Air", "PRO", 7.0), ("Air", "TRO", 7.0)]
    )


def test_fte(spark, counted):
    inputs = counted, golden.org_chart(spark), golden.referral_rates(spark)
    expect(
        staffing.fte_deficit_by_region(*inputs),
        [
            ("PRO", 3, 42, 50.0, -0.5333, 2.6, "#1E90FF"),
            (None, 1, None, None, None, None, None),
        ],
        digits=4,
    )
    expect(
        staffing.fte_deficit_by_region(*inputs, all_regions=True),
        [
            ("NRO", 0, None, None, None, None, None),
            ("PRO", 3, 42, 50.0, -0.5333, 2.6, "#1E90FF"),
            ("TRO", 0, 20, 17.5, 0.1667, 1.3333, "#1E90FF"),
        ],
        digits=4,
    )


def test_one_missing_capacity_makes_the_sum_missing(spark):
    chart = spark.createDataFrame([("A", "x", "1", 8), ("A", "y", "2", None), ("B", "z", "3", 5)], domain.ORG_CHART_SCHEMA)
    expect(staffing.capacity_by_region(chart), [("A", None), ("B", 5)])


def test_capacity_box(spark, counted):
    inputs = counted, golden.org_chart(spark), golden.referral_rates(spark)
    pro = staffing.region_capacity_fte(*inputs, region="PRO").collect()
    assert len(pro) == 1
    box = pro[0].asDict()
    assert (box["capacity"], box["pending_total"], box["referral_rate"]) == (42, 3, 50.0)
    assert box["capacity_text"] == "Regional Case Capacity: 42"
    assert box["referral_text"] == "Average Referral Rate: 50"
    assert box["referral_deficit_text"] == "Referral FTE Deficit: -0.53"
    assert box["current_deficit_text"] == "Current FTE Deficit: 2.60"
    assert box["referral_deficit_color"] == "#ff5733"
    assert box["current_deficit_color"] == "#1E90FF"
    assert box["referral_equation"] == "Referral Deficit Eq. (42-50)/ 15= -0.53"
    assert box["current_equation"] == "Current Deficit Eq. (42- 3)/ 15= 2.60"
    nobody = staffing.region_capacity_fte(*inputs, region="BRRO").first()
    assert (nobody.capacity, nobody.pending_total, nobody.current_deficit) == (0, 0, 0.0)
    everywhere = staffing.region_capacity_fte(*inputs)
    assert sorted(r.region for r in everywhere.collect()) == ["NRO", "PRO", "TRO"]


def test_roster(spark):
    roster = staffing.region_roster(golden.org_chart(spark), "TRO")
    classes = {r["class"]: r["count"] for r in roster.groupBy("class").count().collect()}
    assert classes == {"manager": 1, "specialist": 1, "unlisted": 1}
    vacant = roster.filter(F.col("class") == "unlisted").first()
    assert (vacant.title, vacant.subtitle) == ("Director/Vacant- T-3", "Capacity: 7")


def test_regional_detail(cases):
    pending = regional.region_pending_detail(cases, "PRO")
    assert len(pending.columns) == 15 and pending.columns[0] == "facility_name"
    assert sorted(r.ea_number for r in pending.collect()) == ["EA1", "EA2", "EA3"]
    terminated = regional.region_terminated_detail(cases, "BRRO")
    assert terminated.columns[:2] == ["program", "facility_name"] and len(terminated.columns) == 16
    assert [r.ea_number for r in terminated.collect()] == ["EA4"]
    assert [r.ea_number for r in regional.region_monitored_detail(cases, "TRO").collect()] == ["EA9"]
    assert regional.region_monitored_detail(cases).count() == 2


def test_pending_rows_carry_their_bucket(cases):
    buckets = {r.ea_number: r.pending_status for r in regional.pending_cases(cases, "PRO").collect()}
    assert buckets == {"EA1": "Active > 365", "EA2": "Active < 365", "EA3": "Active < 365"}


def test_program_total_on_every_row(cases):
    counted = regional.with_program_total(cases)
    found = {r.ea_number: r.program_total for r in counted.collect()}
    assert found["EA4"] == 2 and found["EA3"] == 2 and found["EA1"] == 1
    assert counted.count() == cases.count()


def test_regional_programs(counted):
    expect(
        regional.region_pending_by_program(counted, "PRO"),
        [("Other", 1, 1, None), ("VWP", 1, 1, None), ("Waste", 1, None, 1)],
    )
    filled = regional.region_pending_by_program(counted, "PRO", fill_cells=True)
    expect(filled, [("Other", 1, 1, 0), ("VWP", 1, 1, 0), ("Waste", 1, 0, 1)])
    everywhere = regional.region_pending_by_program(counted)
    assert (None, "VPDES", 1, 1, 0) in rows(everywhere), "a bucket no program has is 0"
    expect(regional.region_terminated_by_program(counted, "BRRO"), [("AST/UST", 1)])
    expect(regional.region_monitored_by_program(counted, "TRO"), [("Other", 1)])
    expect(regional.region_monitored_by_program(counted), [("PRO", "Air", 1), ("TRO", "Other", 1)])


def test_workload(counted):
    expect(regional.region_workload_summary(counted, "PRO"), [(3, 1, 2, 1, 0)])
    expect(regional.region_workload_summary(counted, "SWRO"), [(0, 0, 0, 0, 0)])
    expect(
        regional.region_workload_summary(counted),
        [("BRRO", 0, 0, 0, 0, 1), ("PRO", 3, 1, 2, 1, 0), ("TRO", 0, 0, 0, 1, 0), (None, 1, 0, 1, 0, 0)],
    )
    said = regional.workload_sentences(regional.region_workload_summary(counted, "PRO")).first()
    assert said.pending_over == "Pending Cases > 365 days: 1"
    assert said.terminated == "Terminated Cases: 0"


def test_transposed(counted):
    wide = regional.pending_transposed(counted, "PRO")
    assert wide.columns == ["pending_status", "Other", "VWP", "Waste"]
    expect(
        wide,
        [("active_lt_365", 1, 1, None), ("active_gt_365", None, None, 1), ("program_total", 1, 1, 1)],
    )
    young = regional.pending_transposed(
        counted.filter(F.col("program") != "Waste"), "PRO", ["Other", "VWP"]
    )
    assert young.columns == ["pending_status", "Other", "VWP", "Rest", "All"]
    expect(young, [("active_lt_365", 1, 1, None, 2), ("program_total", 1, 1, None, 2)])
    some = regional.pending_transposed(counted, "PRO", ["Other", "Air"])
    expect(
        some,
        [("active_lt_365", 1, None, 1, 2), ("active_gt_365", None, None, 1, 1), ("program_total", 1, None, 2, 3)],
    )


def test_transposed_sum_is_the_pending_count(counted):
    pending = regional.region_workload_summary(counted).agg(F.sum("pending")).first()[0]
    for programs in ([], ["Air"], ["Nowhere"], list(domain.PROGRAMS)):
        wide = regional.pending_transposed(counted, None, programs)
        total = wide.filter("pending_status = 'program_total'").agg(F.sum(domain.ALL_PROGRAMS)).first()[0]
        assert total == pending


def test_representative(cases):
    got = regional.monitored_representative(cases)
    assert got.columns == [*domain.CASES_COLUMNS, "program_total"]
    found = {(r.facility_region, r.ea_number, r.program_total) for r in got.collect()}
    assert found == {("PRO", "EA10", 1), ("TRO", "EA9", 1)}


def test_year_to_date_and_reconciliation(spark, cases):
    this_year = recon.year_to_date(cases)
    assert sorted(r.ea_number for r in this_year.collect()) == ["EA11", "EA2", "EA9"]
    at_source = recon.prepare_year_to_date(
        golden.raw(spark), golden.facilities(spark), golden.PULL_DATE
    )
    assert rows(at_source) == rows(this_year)
    other = cases.filter(F.col("ea_number").isin("EA2", "EA2", "EA4"))
    same = recon.reconcile_cases(this_year, other.union(other))
    assert [r.ea_number for r in same.collect()] == ["EA2"]
    assert rows(recon.reconcile_cases(this_year, other, salt=3)) == rows(same)


def test_banner(cases):
    banner = recon.pull_date_banner(cases).collect()
    assert [r.banner for r in banner] == ["Dashboard Data Pulled On: 04/14/20"]


def test_chart_labels(cases):
    bars = charts.chart_series(statewide.pending_by_region(cases), "pending_by_region")
    found = {(r.x, r.series): (r.y, r.label) for r in bars.filter("x = 'PRO'").collect()}
    assert found == {
        ("PRO", "Active < 365"): (
            2.0,
            "Region Name:  PRO<br>Active < 365:  2<br>Regional Total:  3",
        ),
        ("PRO", "Active > 365"): (
            1.0,
            "Region Name:  PRO<br>Active > 365:  1<br>Regional Total:  3",
        ),
    }
    blank = bars.filter("x IS NULL AND y IS NULL AND series = 'Active > 365'").first()
    assert blank.label == "Region Name:  NA<br>Active > 365:  NA<br>Regional Total:  1"
    cash = charts.chart_series(statewide.cash_by_region(cases), "cash_by_region")
    labels = {r.x: r.label for r in cash.collect()}
    assert labels["PRO"] == "Region Name:  PRO<br>Regional Total: $ 1,075.5"
    assert labels["TRO"] == "Region Name:  TRO<br>Regional Total: $ 0"


def test_every_panel_has_chart_data(spark, cases):
    inputs = cases, golden.org_chart(spark), golden.referral_rates(spark)
    fte = staffing.fte_deficit_by_region(*inputs)
    tables = {
        "cash_drill_region": statewide.cash_drill_region(cases, ["PRO"]),
        "cash_drill_program": statewide.cash_drill_program(cases, ["Air"]),
        "referral_fte_deficit": fte,
        "current_fte_deficit": fte,
        "fte_deficits_stacked": fte,
        "region_pending_by_program": regional.region_pending_by_program(cases, "PRO"),
        "region_terminated_by_program": regional.region_terminated_by_program(cases, "BRRO"),
        "region_monitored_by_program": regional.region_monitored_by_program(cases, "PRO"),
        "region_monitored_bar_labels": regional.region_monitored_by_program(cases, "PRO"),
        "monitored_representative": regional.monitored_representative(cases),
        **{name: getattr(statewide, name)(cases) for name in charts.STATEWIDE_PAGE},
    }
    assert set(tables) == set(charts.PANELS)
    shown = {name: charts.chart_series(t, name).collect() for name, t in tables.items()}
    assert all(shown.values())
    deficit = {r.x: (r.series, r.label) for r in shown["referral_fte_deficit"]}
    assert deficit["PRO"] == ("< 0", "Region:  PRO<br>Referral FTE Deficit:  -0.53")
    assert {r.label for r in shown["current_fte_deficit"]} == {"Region:  PRO<br>Current FTE Deficit:  2.6", "Region:  NA<br>Current FTE Deficit:  NA"}
    assert deficit[None] == (None, "Region:  NA<br>Referral FTE Deficit:  NA")
    stacked = {r.series: r.label for r in shown["fte_deficits_stacked"] if r.x == "PRO"}
    assert stacked["Referral FTE Deficit"].endswith("Referral FTE Deficit:  -0.533333333333333")
    assert shown["region_monitored_bar_labels"][0].label == "Program Name:  Air"


@pytest.mark.parametrize(
    ("values", "wanted"),
    [
        ([-1.533, 12.345, 0.0347], ["-1.533", "12.345", "0.035"]),
        ([0.5, 20.0], ["0.5", "20.0"]),
        ([3.0, -4.0, None], ["3", "-4", "NA"]),
        ([9.96, 11.2], ["10", "11"]),
        ([0.0996], ["0.1"]),
        ([123.456, 0.0], ["123", "0"]),
        ([None], ["NA"]),
    ],
)
def test_deficit_labels_share_their_decimals(spark, values, wanted):
    """Two significant digits, with as many decimals as the number that needs most."""
    table = spark.createDataFrame(
        [(f"R{i}", v) for i, v in enumerate(values)], "facility_region string, referral_fte_deficit double"
    )
    got = charts.chart_series(table, "referral_fte_deficit").orderBy("x").collect()
    assert [r.label.split("  ")[-1] for r in got] == wanted


def test_pulls_are_told_apart(spark, cases):
    earlier = prepare_cases(golden.raw(spark), golden.facilities(spark), "2019-06-01")
    both = cases.unionByName(earlier)
    dates = [golden.PULL_DATE, "2019-06-01"]
    for counted in (both, cube.build_cube(both)):
        for plan in (statewide.pending_by_region, regional.region_workload_summary, statewide.cash_by_program):
            found = by_pull(counted, plan, dates)
            for date, single in zip(dates, (cases, earlier)):
                own = found.filter(F.col("pull_date") == date).drop("pull_date")
                assert rows(own) == rows(plan(single))
    with pytest.raises(ValueError):
        by_pull(both, statewide.pending_by_region, [])


def test_statewide_page_equals_its_panels(counted, cases):
    page = {(r.panel, r.x, r.series): r.y for r in charts.statewide_page(counted).collect()}
    single = {}
    for name in charts.STATEWIDE_PAGE:
        for r in charts.chart_series(getattr(statewide, name)(cases), name).collect():
            if r.y is not None:
                single[(r.panel, r.x, r.series)] = r.y
    assert page == single


def test_export_rows(cases):
    named = export.export_rows(cases, "pending")
    assert {r.export_file for r in named.collect()} == {"pendingConsent_PRO_2020-04-14.csv"}
    one = export.export_rows(cases, "terminated", "BRRO")
    assert one.columns[0] == "program" and one.first().export_file == "terminatedConsent_BRRO_2020-04-14.csv"


def test_presentation_order(cases):
    ordered = row_operators.in_key_order(statewide.cash_by_region(cases), "facility_region")
    assert [r.facility_region for r in ordered.collect()] == ["BRRO", "PRO", "TRO", None]


def test_small_row_operators(cases):
    assert row_operators.columns_between(cases, "nov_date", "term_date") == [
        "nov_date",
        "executed_date",
        "term_date",
    ]
    assert row_operators.has_value(cases, "program")
    assert not row_operators.has_value(cases, "executed_date")
    regions = row_operators.distinct_values(cases, "facility_region").collect()
    assert {r.facility_region for r in regions} == {"BRRO", "PRO", "TRO", None}
    moved = row_operators.move_first(cases, "program", drop=["comments"])
    assert moved.columns[0] == "program" and "comments" not in moved.columns
    with_regions = regional.with_region_total(cases).collect()
    assert {r.ea_number: r.region_total for r in with_regions}["EA11"] == 1


def test_only_safe_joins_are_salted(cases):
    other = cases.select("ea_number", "program")
    for how in ("right", "full"):
        with pytest.raises(ValueError):
            lookup(cases, other, "ea_number", "ea_number", how, salt=2)
    gone = lookup(cases, other.limit(0), "ea_number", "ea_number", "left_anti", salt=2)
    assert gone.count() == cases.count()


def test_decimal_money_stays_exact(spark):
    cents = spark.range(100_000).selectExpr(
        "'PRO' AS facility_region", "'Air' AS program", "cast(0.1 AS decimal(18,2)) AS cash_civil_charge"
    )
    total = statewide.cash_by_region(cents).first().regional_total
    assert str(total) == "10000.00"
    bar = charts.chart_series(statewide.cash_by_region(cents), "cash_by_region").first()
    assert bar.label == "Region Name:  PRO<br>Regional Total: $ 10,000"


def test_several_pulls_are_one_reading(spark, cases):
    both = cases.unionByName(prepare_cases(golden.raw(spark), golden.facilities(spark), "2019-06-01"))
    staff = golden.org_chart(spark), golden.referral_rates(spark)
    plans = [getattr(statewide, name) for name in charts.STATEWIDE_PAGE]
    plans += [regional.region_pending_by_program, regional.region_terminated_by_program, regional.region_monitored_by_program]
    plans += [lambda c, **s: regional.region_workload_summary(c, "PRO", **s), lambda c, **s: regional.region_pending_by_program(c, "PRO", **s)]
    for staffed in (staffing.fte_deficit_by_region, staffing.region_capacity_fte):
        plans += [lambda c, f=staffed, **s: f(c, *staff, **s)]
    plans += [lambda c, **s: staffing.fte_deficit_by_region(c, *staff, all_regions=True, **s), lambda c, **s: staffing.region_capacity_fte(c, *staff, "BRRO", **s)]
    dates = [golden.PULL_DATE, "2019-06-01", "2000-01-01"]
    for plan in plans:
        found = by_pull(both, plan, dates)
        for date in dates:  # of the last pull there is no case
            own = both.filter(F.col("pull_date") == F.lit(date).cast("date"))
            assert rows(found.filter(F.col("pull_date") == F.lit(date).cast("date")).drop("pull_date")) == rows(plan(own)), date


def test_another_pull_adds_no_scan(spark, tmp_path):
    cases = prepare_cases(golden.raw(spark), golden.facilities(spark), golden.PULL_DATE)
    cases.write.partitionBy("pull_date").parquet(f"{tmp_path}/cases")
    stored = spark.read.parquet(f"{tmp_path}/cases")
    for plan in (statewide.pending_by_region, regional.region_workload_summary):
        scans = [
            by_pull(stored, plan, dates)._jdf.queryExecution().executedPlan().toString().count("FileScan parquet")
            for dates in ([golden.PULL_DATE], [golden.PULL_DATE, "2019-06-01"], [golden.PULL_DATE, "2019-06-01", "2018-06-01"])
        ]
        assert scans == [1, 1, 1]


def test_order_under_a_locale(spark):
    names = ["PReP", "Other", "other", "Öl", "VPA", "PrEP", "Zebra", "apple", None]
    df = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "program string, n int")
    shown = lambda *a, **s: [r.program for r in row_operators.in_key_order(df, *a, **s).collect()]
    assert shown("program") == ["Other", "PReP", "PrEP", "VPA", "Zebra", "apple", "other", "Öl", None]
    assert shown("program", collation="UNICODE") == ["apple", "Öl", "other", "Other", "PrEP", "PReP", "VPA", "Zebra", None]
    assert shown("program", collation="sv") == ["apple", "other", "Other", "PrEP", "PReP", "VPA", "Zebra", "Öl", None]
    assert [r.n for r in row_operators.in_key_order(df, "n", collation="UNICODE").collect()] == [*range(9)]


def test_programs_not_known_beforehand(spark, cases, counted):
    found = {r.pending_status: (r.programs, r.all_programs) for r in regional.pending_transposed(counted, "PRO", as_map=True).collect()}
    wide = {r.pending_status: r.asDict() for r in regional.pending_transposed(counted, "PRO").collect()}
    for status, (programs, whole) in found.items():
        listed = {k: v for k, v in wide[status].items() if k != "pending_status" and v is not None}
        assert programs == listed and whole == sum(listed.values())
    assert set(found) == set(wide)
    many = spark.range(20_000).selectExpr("concat('P', id) AS program", "'PRO' AS facility_region", "'Pending' AS status_code", "id % 800 AS days_pending")
    many = many.unionByName(many.limit(3).withColumn("program", F.lit(None).cast("string")))
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
    plan = regional.pending_transposed(many, as_map=True)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) == jobs
    total = plan.where("pending_status = 'program_total'").first()
    assert len(total.programs) == 20_001 and total.programs["NA"] == 3 and total.all_programs == 20_003
