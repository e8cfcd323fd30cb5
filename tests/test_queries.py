"""Every registered query against its SQL twin, and figures checked by hand."""

import os

import pytest
from compare import duck, duck_bag, spark_bag
from pyspark.sql import functions as F

import __spark_entry__ as contract
from caseflow.plans import cube, regional, staffing, statewide
from standin import oracle, registry
from standin.tables import CaseTables

FOLDER = os.environ.get("CASEFLOW_TEST_DATA", "/root/testdata/sf0.01")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def connection():
    return duck(FOLDER)


@pytest.fixture(scope="module")
def cases(spark):
    return CaseTables(spark, FOLDER).cases().cache()


def test_each_query_has_a_twin():
    assert set(registry.QUERIES) == set(oracle.oracle_sql())
    assert set(registry.QUERIES) <= set(contract.queries()) and set(oracle.oracle_sql()) <= set(contract.oracle_sql())


@pytest.mark.parametrize("name", registry.QUERIES)
def test_query(spark, connection, name):
    columns, found = spark_bag(contract.queries()[name](spark, FOLDER))
    wanted_columns, wanted = duck_bag(connection, contract.oracle_sql()[name])
    assert columns == wanted_columns
    assert found == wanted
    assert found


def test_entry(spark):
    assert contract.entry(spark).columns == [
        "facility_region",
        "active_lt_365",
        "active_gt_365",
        "total_pending",
    ]


def test_checked_figures(cases):
    row = cases.agg(
        F.count("*"), F.count("days_pending"), F.count("facility_region"), F.count("term_date"),
        F.round(F.sum("cash_civil_charge"), 2), F.min("days_pending"), F.max("days_pending"),
        F.count_if(F.col("days_pending") == 365),
    ).first()
    assert tuple(row) == (14707, 14427, 14537, 4762, 2760557450.56, -2263, 2478, 9)
    asia = regional.region_workload_summary(cases, "ASIA").first()
    assert tuple(asia) == (982, 821, 143, 992, 477)


def test_invariants(cases):
    pending = regional.pending_cases(cases)
    by_region = statewide.pending_by_region(cases, include_template=False)
    by_program = statewide.pending_by_program(cases, include_template=False)
    total = pending.count()
    for table in (by_region, by_program):
        sums = table.agg(F.sum("total_pending"), F.sum("active_lt_365"), F.sum("active_gt_365")).first()
        assert sums[0] == total == sums[1] + sums[2]
    work = regional.region_workload_summary(cases).agg(
        *[F.sum(c) for c in ("pending", "pending_over", "pending_under")]
    ).first()
    on_the_day = pending.filter("days_pending = 365").count()
    unknown = pending.filter("days_pending IS NULL").count()
    assert work[1] + work[2] - on_the_day + unknown == work[0] == total
    region_cash = statewide.cash_by_region(cases).agg(F.sum("regional_total")).first()[0]
    program_cash = statewide.cash_by_program(cases).agg(F.sum("program_total")).first()[0]
    assert region_cash == pytest.approx(program_cash)


def test_counting_plans_agree_on_the_cube(spark, cases):
    tables = CaseTables(spark, FOLDER)
    small = cube.build_cube(cases).cache()
    plans = [
        statewide.pending_by_region,
        statewide.pending_by_program,
        statewide.monitored_by_region,
        statewide.terminated_by_program,
        regional.region_pending_by_program,
        regional.region_terminated_by_program,
        regional.region_workload_summary,
        lambda c: statewide.actions_by_program(c, None),
        lambda c: regional.pending_transposed(c, "ASIA"),
        lambda c: staffing.fte_deficit_by_region(c, tables.org_chart(), tables.referral_rates()),
        lambda c: staffing.region_capacity_fte(c, tables.org_chart(), tables.referral_rates()),
    ]
    for plan in plans:
        assert spark_bag(plan(small)) == spark_bag(plan(cases))
    for drill in (
        lambda c: statewide.cash_drill_region(c, ["ASIA", "EUROPE"]),
        lambda c: statewide.cash_drill_program(c, ["Air"]),
    ):
        a, b = (sorted(map(tuple, drill(t).collect()), key=repr) for t in (small, cases))
        assert [r[:-1] for r in a] == [r[:-1] for r in b]
        assert [r[-1] for r in a] == pytest.approx([r[-1] for r in b])
