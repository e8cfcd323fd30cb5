"""From source views to stored cases, cube, pages and exports, as a deployment would run it."""

import os

import golden

from caseflow import domain
from caseflow.plans import charts, cube, dashboard, export, regional, staffing, statewide
from caseflow.plans.prepare import prepare_cases
from caseflow.session import cut_lineage
from caseflow.sources import store, views


def bag(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_whole_flow(spark, tmp_path):
    source = f"{tmp_path}/views"
    case_names = {n: s for n, (s, _) in domain.CASE_COLUMNS.items()}
    golden.raw(spark).withColumnsRenamed(case_names).write.parquet(f"{source}/{domain.CASES_VIEW}")
    facility_names = {n: s for n, (s, _) in domain.FACILITY_COLUMNS.items()}
    golden.facilities(spark).withColumnsRenamed(facility_names).write.parquet(
        f"{source}/{domain.FACILITIES_VIEW}"
    )

    raw = views.select_cases(views.read_view_parquet(spark, source, domain.CASES_VIEW))
    facilities = views.select_facilities(views.read_view_parquet(spark, source, domain.FACILITIES_VIEW))
    prepared = prepare_cases(raw, facilities, golden.PULL_DATE)
    store.write_cases(prepared, f"{tmp_path}/cases")
    cases = store.read_cases(spark, f"{tmp_path}/cases", golden.PULL_DATE)
    assert bag(cases) == bag(prepared) and cases.dtypes == prepared.dtypes

    small = cut_lineage(cube.build_cube(cases))
    for panel in charts.STATEWIDE_PAGE:
        plan = getattr(statewide, panel)
        assert bag(plan(small)) == bag(plan(cases)), panel
    assert bag(charts.statewide_page(small)) == bag(charts.statewide_page(cases))
    assert bag(charts.regional_pages(small)) == bag(charts.regional_pages(cases))
    box = staffing.region_capacity_fte(
        small, golden.org_chart(spark), golden.referral_rates(spark), "PRO"
    ).first()
    assert (box.capacity, box.pending_total) == (42, 3)
    assert [r.ea_number for r in regional.monitored_representative(cases).collect()] != []

    staff = golden.org_chart(spark), golden.referral_rates(spark)
    dashboard.publish(cases, *staff, f"{tmp_path}/out", exports=True)
    direct = dashboard.dashboard_tables(cases, *staff)
    for name, table in direct.items():
        published = spark.read.parquet(f"{tmp_path}/out/{name}/pull={golden.PULL_DATE}")
        assert bag(published) == bag(table) and published.columns == table.columns, name
    exports = f"{tmp_path}/out/exports"
    written = {f for kind in export.DETAIL for f in os.listdir(f"{exports}/{kind}")}
    assert written == {
        "pendingConsent_PRO_2020-04-14.csv",
        "terminatedConsent_BRRO_2020-04-14.csv",
        "monitoredConsent_PRO_2020-04-14.csv",
        "monitoredConsent_TRO_2020-04-14.csv",
    }


def test_each_pull_is_published_with_its_own_figures(spark, tmp_path):
    staff = golden.org_chart(spark), golden.referral_rates(spark)
    made = {
        date: prepare_cases(golden.raw(spark), golden.facilities(spark), date)
        for date in (golden.PULL_DATE, "2019-06-01")
    }
    for pull in made.values():
        store.write_cases(pull, f"{tmp_path}/cases")
    assert bag(store.read_cases(spark, f"{tmp_path}/cases")) == bag(made[golden.PULL_DATE])
    dashboard.publish(store.read_all_pulls(spark, f"{tmp_path}/cases"), *staff, f"{tmp_path}/both")
    for pull in made.values():  # one after the other, the later one must leave the earlier alone
        dashboard.publish(pull, *staff, f"{tmp_path}/apart")
    for date, cases in made.items():
        for name, table in dashboard.dashboard_tables(cases, *staff).items():
            for out in ("both", "apart"):
                published = spark.read.parquet(f"{tmp_path}/{out}/{name}/pull={date}")
                assert bag(published) == bag(table), (name, date, out)
    stored = spark.read.parquet(f"{tmp_path}/apart/case_cube")
    assert {str(r.pull_date) for r in stored.select("pull_date").distinct().collect()} == set(made)
