"""A third of all rows on one key: results stay whole and no task gets them all."""

import pytest
from pyspark.sql import functions as F

from caseflow import domain
from caseflow.operators.joins import in_other, lookup
from caseflow.operators.rows import first_row_per, with_group_value
from caseflow.plans import cube, recon
from caseflow.plans.prepare import prepare_cases

ROWS, FACILITIES = 120_000, 5_000


@pytest.fixture(scope="module", autouse=True)
def shuffled_joins(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.fixture(scope="module")
def raw(spark):
    """Every third case sits at facility 7, every ninth has no facility and shares one number."""
    columns = {
        "facility_id": "if(id % 3 = 0, 7, if(id % 9 = 1, NULL, id % 5000))",
        "ea_number": "if(id % 9 = 1, 'EA-hot', concat('EA', id))",
        "facility_region": "if(id % 3 = 0, 'PRO', element_at(array('TRO', 'VRO', NULL), cast(id % 3 as int) + 1))",
        "case_manager": "'m'",
        "registration_number": "'r'",
        "program_name": "element_at(array('Air', 'UST', 'Solid Waste', NULL), cast(id % 4 as int) + 1)",
        "permit_number": "'p'",
        "nov_number": "'n'",
        "nov_date": "timestamp_ntz'2018-01-01 00:00:00' + make_dt_interval(cast(id % 900 as int))",
        "executed_date": "cast(NULL as timestamp_ntz)",
        "term_date": "if(id % 5 = 0, timestamp_ntz'2019-06-01 00:00:00', NULL)",
        "cash_civil_charge": "if(id % 2 = 0, cast(id % 100 as double), NULL)",
        "action_code": "'a'",
        "status_code": "element_at(array('Terminated', 'Pending', 'Effective', 'Pending APA', 'Closed'), cast(id % 5 as int) + 1)",
        "comments": "'c'",
    }
    rows = spark.range(0, ROWS, 1, 16).selectExpr(*[f"{v} AS {k}" for k, v in columns.items()])
    assert rows.columns == list(domain.CASE_COLUMNS)
    return rows.cache()


@pytest.fixture(scope="module")
def facilities(spark):
    named = spark.range(FACILITIES).selectExpr("id AS efc_id", "concat('F', id) AS facility_name")
    return named.union(spark.sql("SELECT cast(NULL AS bigint), 'Nameless site'"))


def table(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_all_ways_to_the_cube_agree(raw, facilities):
    plain = cube.build_cube(prepare_cases(raw, facilities, "2020-04-14"))
    salted = cube.build_cube(prepare_cases(raw, facilities, "2020-04-14", salt=8))
    early = cube.build_cube_early(raw, facilities, "2020-04-14")
    wanted = table(plain)
    assert sum(r[-2] for r in wanted) == ROWS
    assert table(salted) == wanted and table(early) == wanted


def _largest_task(df):
    sizes = df.groupBy(F.spark_partition_id()).count()
    return sizes.agg(F.max("count")).first()[0]


def test_salt_splits_the_hot_facility(spark, raw, facilities):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        plain = lookup(raw, facilities, "facility_id", "efc_id")
        salted = lookup(raw, facilities, "facility_id", "efc_id", salt=8)
        assert _largest_task(plain) > ROWS / 3
        assert _largest_task(salted) < ROWS / 4
        assert salted.count() == plain.count() == ROWS
        assert salted.columns == plain.columns
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


@pytest.fixture
def eager_splitting(spark):
    """Let a few kilobytes count as a large partition."""
    settings = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64KB",
    }
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def _final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_run_time_splitting_of_the_hot_facility(raw, facilities, eager_splitting):
    """Without a salt Spark splits the partition itself once it counts as large."""
    joined = lookup(raw, facilities, "facility_id", "efc_id")
    assert joined.filter("facility_name IS NOT NULL").count() == ROWS
    assert "skew=true" in _final_plan(joined.select("facility_name", "comments"))


def test_run_time_splitting_of_a_hot_case_number(raw, eager_splitting):
    """The distinct keys are shuffled once more for the join, which lets Spark split the other side."""
    hot = raw.withColumn("ea_number", F.expr("if(facility_id = 7, 'EA-hot', ea_number)"))
    same = recon.reconcile_cases(hot, hot.filter("facility_id = 7")).select("ea_number", "nov_date")
    assert "skew=true" in _final_plan(same)
    assert same.count() == hot.filter("ea_number = 'EA-hot'").count() > ROWS / 3


def test_early_cube_sends_little_of_the_hot_facility(raw, facilities):
    """Per facility and combination one row leaves a task, whatever the number of its cases."""
    hot = raw.filter("facility_id = 7")
    combinations = cube.build_cube(prepare_cases(hot, facilities, "2020-04-14")).count()
    assert combinations < 200 < hot.count() / 100


def test_group_value_and_first_row(raw):
    from collections import Counter

    rows = raw.select("facility_region", "ea_number", "status_code", "program_name").collect()
    counts = Counter(r.facility_region for r in rows)
    totals = raw.groupBy("facility_region").agg(F.count(F.lit(1)).alias("n"))
    for given in (None, totals):
        counted = with_group_value(raw, "facility_region", "n", F.count(F.lit(1)), given)
        found = counted.groupBy("facility_region", "n").count().collect()
        assert {r.facility_region: (r.n, r["count"]) for r in found} == {
            k: (v, v) for k, v in counts.items()
        }
    lowest = {}
    for r in rows:
        lowest[r.facility_region] = min(lowest.get(r.facility_region, "~"), r.ea_number)
    count = F.count(F.lit(1)).alias("n")
    first = first_row_per(raw, "facility_region", "ea_number", count).collect()
    assert {r.facility_region: r.ea_number for r in first} == lowest
    assert {r.facility_region: r.n for r in first} == counts


def test_salt_works_after_a_shuffle_on_the_hot_key(spark, raw, facilities):
    """The left side comes dealt out by the key; the salt looks at the other columns."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        dealt = raw.repartition(8, "facility_id")
        assert _largest_task(dealt) > ROWS / 3
        salted = lookup(dealt, facilities, "facility_id", "efc_id", salt=32)
        assert _largest_task(salted) < ROWS / 4
        assert salted.count() == ROWS
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_plain_equality_keeps_a_side_where_it_is(raw, facilities):
    tree = lambda df: df._jdf.queryExecution().executedPlan().toString()
    dealt = raw.filter("facility_id IS NOT NULL").repartition("facility_id")
    named = facilities.filter("efc_id IS NOT NULL")
    bare = lookup(dealt, named, "facility_id", "efc_id", missing_match=False)
    assert tree(bare).count("Exchange hashpartitioning(facility_id") == 1 and "coalesce(facility_id" not in tree(bare)
    safe = lookup(dealt, named, "facility_id", "efc_id")
    assert "coalesce(facility_id" in tree(safe)
    assert table(bare.select("facility_name", "ea_number")) == table(safe.select("facility_name", "ea_number"))
    declared = raw.sparkSession.range(5).withColumnRenamed("id", "efc_id").withColumn("facility_name", F.lit("x"))
    assert "coalesce(facility_id" not in tree(lookup(dealt, declared, "facility_id", "efc_id"))


def test_hot_case_number_in_a_semi_join(raw):
    wanted = raw.filter("status_code = 'Effective'")
    keys = {r.ea_number for r in wanted.select("ea_number").collect()}
    brute = sum(r.ea_number in keys for r in raw.select("ea_number").collect())
    assert in_other(raw, wanted, "ea_number").count() == brute
    assert recon.reconcile_cases(raw, wanted, salt=6).count() == brute
