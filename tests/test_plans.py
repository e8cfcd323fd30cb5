"""What the physical plans may and may not contain."""

import os
import re

import pytest

import __spark_entry__ as contract
from caseflow.plans import cube, statewide
from standin import registry
from standin.tables import CaseTables

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def logical(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def depth(line):
    return len(re.match(r"[\s:+\-|]*", line).group())


def windows_over_rows(plan):
    """Window nodes with no aggregate of case rows underneath."""
    lines = plan.splitlines()
    bad = []
    for i, line in enumerate(lines):
        if not re.match(r"[\s:+\-|]*Window ", line):
            continue
        below = []
        for under in lines[i + 1 :]:
            if depth(under) <= depth(line):
                break
            below.append(under)
        if not any(re.match(r"[\s:+\-|]*Aggregate \[(facility_region|program)", b) for b in below):
            bad.append(line)
    return bad


@pytest.mark.parametrize("name", registry.QUERIES)
def test_plan_shape(spark, name):
    df = contract.queries()[name](spark, FOLDER)
    shape, tree = logical(df), physical(df)
    for banned in ("Python", "Pandas", "CartesianProduct", "BroadcastNestedLoopJoin", "CollectLimit"):
        assert banned not in tree, banned
    assert "Join Cross" not in shape and "GlobalLimit" not in shape
    assert windows_over_rows(shape) == []


def test_detail_needs_no_shuffle_of_its_own(spark):
    """Beyond the view's own joins: a filter and a projection."""
    whole = physical(contract.queries()["cases_prepared"](spark, FOLDER)).count("Exchange")
    detail = physical(contract.queries()["region_pending_detail"](spark, FOLDER)).count("Exchange")
    assert detail <= whole


def test_only_needed_columns_and_tables_are_read(spark):
    tree = physical(contract.queries()["monitored_by_region"](spark, FOLDER))
    assert "l_shipdate" not in tree, "ship dates play no part in a count of monitored cases"
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint,o_orderstatus:string>" in tree


def test_outer_join_to_facilities_becomes_inner(spark):
    shape = logical(CaseTables(spark, FOLDER).cases())
    assert re.search(r"Join Inner, \(.*<=>", shape)


def test_page_reads_each_case_once(spark):
    tree = physical(contract.queries()["statewide_page"](spark, FOLDER))
    assert tree.count("orders.parquet") == 1 and tree.count("lineitem.parquet") == 1


def test_nothing_is_broadcast_by_hint(spark):
    """With Spark's own threshold off, no side is broadcast."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name, query in registry.QUERIES.items():
            assert "BroadcastHashJoin" not in physical(query(spark, FOLDER)), name
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def jobs_of(spark, work):
    """What ``work`` returns and how many jobs it started."""
    group = "counted-jobs"
    spark.sparkContext.setJobGroup(group, group)
    try:
        out = work()
        return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


@pytest.mark.parametrize("name", ("cases_with_program_cash", "cases_with_regional_cash", "monitored_with_program_total", "monitored_with_region_total"))
def test_rows_with_totals_read_twice_and_start_nothing(spark, name):
    df, jobs = jobs_of(spark, lambda: contract.queries()[name](spark, FOLDER))
    assert jobs == 0
    assert physical(df).count("orders.parquet") == 2


def test_stored_totals_leave_the_rows_where_they_are(spark, tmp_path):
    rows = CaseTables(spark, FOLDER).cases()
    cube.build_cube(rows).write.parquet(f"{tmp_path}/cube")
    totals = statewide.cash_by_program(spark.read.parquet(f"{tmp_path}/cube"))
    totals.write.parquet(f"{tmp_path}/totals")
    exchanges = physical(rows).count("Exchange hashpartitioning")
    with_totals = statewide.with_cash_total(rows, "program", spark.read.parquet(f"{tmp_path}/totals"))
    tree = physical(with_totals)
    assert tree.count("Exchange hashpartitioning") == exchanges and tree.count("orders.parquet") == 1


def test_first_rows_are_found_on_narrow_columns(spark):
    """No sort of whole rows stands under the aggregate that finds the winners."""
    tree = physical(contract.queries()["monitored_representative"](spark, FOLDER))
    narrow = [line for line in tree.splitlines() if "partial_min(ea_number" in line]
    assert narrow and all("comments" not in line for line in narrow)
    drilled = physical(contract.queries()["cash_drill_rows"](spark, FOLDER))
    assert drilled.count("o_orderpriority") and drilled.count("orders.parquet") == 2
    wide = [line for line in drilled.splitlines() if "orders.parquet" in line and "o_orderpriority" in line]
    assert len(wide) == 1
