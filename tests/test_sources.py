"""Readers, the stored case table, and CSV export."""

import contextlib
import csv
import os
import uuid

import golden
import pytest
from pyspark.sql import functions as F

from caseflow import domain
from caseflow.operators.joins import duplicate_keys
from caseflow.plans import export, recon, regional
from caseflow.plans.prepare import prepare_cases, prepare_extract
from caseflow.session import cut_lineage
from caseflow.sources import files, store, views
from caseflow.sources.named_csv import NamedCsv


@pytest.fixture(scope="module")
def cases(spark):
    return prepare_cases(golden.raw(spark), golden.facilities(spark), golden.PULL_DATE).cache()


def test_jdbc_options_split_the_scan():
    options = views.jdbc_options(
        "jdbc:x", domain.CASES_VIEW, split_on="Enc_Id", bounds=(1, 900), partitions=9, user="u"
    )
    assert options["dbtable"] == "enf.Enf_enforcement_Cases_View"
    assert (options["partitionColumn"], options["numPartitions"]) == ("Enc_Id", "9")
    assert (options["lowerBound"], options["upperBound"], options["user"]) == ("1", "900", "u")
    assert "partitionColumn" not in views.jdbc_options("jdbc:x", domain.FACILITIES_VIEW, None)
    with pytest.raises(ValueError):
        views.jdbc_options("jdbc:x", domain.CASES_VIEW, split_on="Enc_Id")


def test_a_database_as_a_catalogue():
    settings = views.jdbc_catalogue("enforcement", "jdbc:x", driver="some.Driver", user="u")
    at = "spark.sql.catalog.enforcement"
    assert settings[at].endswith("v2.jdbc.JDBCTableCatalog")
    assert (settings[f"{at}.url"], settings[f"{at}.driver"], settings[f"{at}.user"]) == ("jdbc:x", "some.Driver", "u")
    assert {settings[f"{at}.{p}"] for p in ("pushDownPredicate", "pushDownAggregate", "pushDownLimit")} == {"true"}
    assert "driver" not in " ".join(views.jdbc_catalogue("c", "jdbc:x"))


@pytest.mark.parametrize("keys", [[5, 1, 9, 9, 9, 9, 2, 7, None, 9], [None, None], [3], [], ["b", "a'c", "d", None, "a'c"]])
def test_every_row_is_in_one_share(spark, keys):
    kind = "string" if any(isinstance(k, str) for k in keys) else "long"
    rows = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], f"k {kind}, i long")
    known = rows.where("k IS NOT NULL").selectExpr("k", "ntile(4) OVER (ORDER BY k) AS share")
    lows = [r.low for r in known.groupBy("share").agg(F.min("k").alias("low")).collect()]
    predicates = views.split_predicates("k", lows)
    found = [r.i for p in predicates for r in rows.where(p).collect()]
    assert sorted(found) == [*range(len(keys))]
    assert 1 <= len(predicates) <= 4
    asked = views.quantile_query("v", "k", 4)
    assert "NTILE(4) OVER (ORDER BY k)" in asked and "FROM enf.v WHERE k IS NOT NULL" in asked


@contextlib.contextmanager
def database(spark):
    """A namespace of the test's own, gone afterwards."""
    name = f"enf_{uuid.uuid4().hex}"
    spark.sql(f"CREATE DATABASE {name}")
    try:
        yield name
    finally:
        spark.sql(f"DROP DATABASE {name} CASCADE")


def test_views_from_parquet_and_catalogue(spark, tmp_path):
    source = golden.raw(spark).withColumnsRenamed({n: s for n, (s, _) in domain.CASE_COLUMNS.items()})
    source.withColumn("unused", F.lit(1)).write.parquet(f"{tmp_path}/{domain.CASES_VIEW}")
    view = views.read_view_parquet(spark, str(tmp_path), domain.CASES_VIEW)
    raw = views.select_cases(view)
    assert raw.columns == list(domain.CASE_COLUMNS) and raw.count() == 11
    plan = raw.select("ea_number")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<Enc_Ea_Number:string>" in plan
    named = golden.facilities(spark).toDF("Efc_Id", "Efc_Facility_Name")
    with database(spark) as own:
        named.write.saveAsTable(f"{own}.{domain.FACILITIES_VIEW}")
        spark.range(1).write.saveAsTable(f"{own}.something_else")
        spark.range(1).createOrReplaceTempView(domain.CASES_VIEW)
        try:  # a session's views are no views of the namespace
            found = views.available_views(spark, own)
            assert [r.view for r in found.collect()] == [domain.FACILITIES_VIEW.lower()]
            here = [r.view for r in views.available_views(spark).collect()]
            assert domain.CASES_VIEW.lower() in here
        finally:
            spark.catalog.dropTempView(domain.CASES_VIEW)
        facilities = views.select_facilities(views.read_view_table(spark, domain.FACILITIES_VIEW, own))
        assert facilities.columns == ["efc_id", "facility_name"]
        assert prepare_cases(raw, facilities, golden.PULL_DATE).count() == 8


@pytest.mark.parametrize("view", domain.VIEWS)
def test_every_view_loads_whole(spark, tmp_path, view):
    spark.range(3).write.parquet(f"{tmp_path}/{view}")
    assert views.read_view_parquet(spark, f"{tmp_path}/", view).count() == 3


def test_range_filters_on_text_and_typed_dates(spark):
    raw = golden.raw(spark)
    typed = raw.withColumns(
        {c: F.try_to_date(c, "M/d/yyyy").cast("timestamp_ntz") for c in domain.DATE_COLUMNS}
    )
    for source in (raw, typed):
        issued = views.issued_between(source, "2020-01-01", "2020-04-14").collect()
        assert sorted(r.ea_number or "" for r in issued) == ["", "EA11", "EA2", "EA6", "EA7", "EA9"]
        touched = views.touched_between(source, "2019-04-14", "2019-04-15").collect()
        assert sorted(r.ea_number for r in touched) == ["EA1", "EA4"]


def test_range_filter_reaches_the_file(spark, tmp_path):
    typed = golden.raw(spark).withColumns(
        {c: F.try_to_date(c, "M/d/yyyy").cast("timestamp_ntz") for c in domain.DATE_COLUMNS}
    )
    typed.write.parquet(f"{tmp_path}/raw")
    stored = spark.read.parquet(f"{tmp_path}/raw")
    plan = views.issued_between(stored, "2020-01-01", "2020-04-14")._jdf.queryExecution()
    pushed = plan.executedPlan().toString().split("PushedFilters:")[1]
    assert "GreaterThanOrEqual(nov_date" in pushed and "LessThanOrEqual(nov_date" in pushed


def test_csv_dimensions(spark, tmp_path):
    chart = tmp_path / "chart.csv"
    chart.write_text("Region,Position,Position number,Capacity\nPRO,Manager,P1,8\nCO, Director/Vacant ,P2,NA\n")
    got = files.read_org_chart(spark, str(chart))
    assert got.schema == domain.ORG_CHART_SCHEMA
    assert sorted(map(tuple, got.collect())) == [("CO", "Director/Vacant", "P2", None), ("PRO", "Manager", "P1", 8)]
    rates = tmp_path / "rates.csv"
    rates.write_text('Region,"Referral Rate"\nPRO,60\nTRO,n/a\n')
    got = files.read_referral_rates(spark, str(rates))
    assert sorted(map(tuple, got.collect())) == [("PRO", 60.0), ("TRO", None)]


def _extract_header():
    return [v for k, v in domain.DISPLAY_LABELS.items() if k not in ("program", "pull_date", "days_pending")]


def test_case_extract(spark, tmp_path):
    path = tmp_path / "extract.csv"
    header = _extract_header()[::-1]
    base = dict.fromkeys(header, "")
    lines = [
        base | {"Facility Name": "Acme", "EA Number": "EA1", "NOV Date": "4/15/2019", "Term Date": "05/01/2019",
                "Program Name": "Const. Storm.", "Cash Civil Charge": "1000.5",
                "Comments": 'two\nlines, "quoted"'},
        base | {"Facility Name": "Beta", "EA Number": "NA", "NOV Date": "4/15/2019"},
        base | {"Facility Name": "Beta", "EA Number": "EA2", "Cash Civil Charge": "unknown"},
    ]
    with path.open("w", newline="") as out:
        writer = csv.DictWriter(out, header)
        writer.writeheader()
        writer.writerows(lines)
    cases = prepare_extract(files.read_case_extract(spark, str(path), multiline=True), golden.PULL_DATE)
    assert tuple(cases.columns) == domain.CASES_COLUMNS
    found = {r.ea_number: r for r in cases.collect()}
    assert set(found) == {"EA1", "EA2"}
    assert (found["EA1"].program, found["EA1"].days_pending) == ("Const. Storm.", 365)
    assert found["EA1"].comments == 'two\nlines, "quoted"'
    assert found["EA1"].cash_civil_charge == 1000.5 and found["EA2"].cash_civil_charge is None


def test_what_could_not_be_read_is_told(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Region,Position,Position number,Capacity\nPRO,Manager,P1,8\nPRO,Manager,P2,eight\nTRO,Manager\nCO,Manager,P3,NA\n")
    (tmp_path / "b.csv").write_text("Region,Position,Position number,Capacity\nCO,Manager,P4,4,and more\nCO,Manager,P5,\nCO,Manager,P6,1e99\n")
    parsed = files.parse_org_chart(spark, str(tmp_path))
    assert parsed.rows.schema == domain.ORG_CHART_SCHEMA
    assert sorted(map(tuple, parsed.rows.collect()), key=repr) == sorted(map(tuple, files.read_org_chart(spark, str(tmp_path)).collect()), key=repr)
    assert [r.capacity for r in parsed.rows.where("position_number = 'P4'").collect()] == [4]
    found = sorted((r.file.rsplit("/", 1)[1], r.record, r.field or "", r.text, r.reason) for r in parsed.rejects.collect())
    assert found == [
        ("a.csv", 2, "Capacity", "eight", "no int"),
        ("a.csv", 3, "", "TRO,Manager", "another number of fields"),
        ("b.csv", 1, "", "CO,Manager,P4,4,and more", "another number of fields"),
        ("b.csv", 3, "Capacity", "1e99", "no int"),
    ]
    assert "Scan ExistingRDD" in parsed.rejects._jdf.queryExecution().executedPlan().toString()
    empty = tmp_path / "none" / "c.csv"
    empty.parent.mkdir()
    empty.write_text("Region,Position,Position number,Capacity\n")
    none = files.parse_org_chart(spark, str(empty))
    assert none.rows.count() == none.rejects.count() == 0


def test_records_are_numbered_across_blocks(spark, tmp_path):
    lines = [f"R{i},{i if i % 500 else 'many'}" for i in range(1, 4001)]
    (tmp_path / "rates.csv").write_text("Region,Referral Rate\n" + "\n".join(lines) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        parsed = files.parse_referral_rates(spark, str(tmp_path / "rates.csv"))
        assert parsed.rows.rdd.getNumPartitions() > 3
        assert sorted(r.record for r in parsed.rejects.collect()) == [500 * k for k in range(1, 9)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_the_first_row_follows_the_files(spark, tmp_path):
    """The first case of a region as the files have it, however they are split."""
    header = _extract_header()
    for name, numbers in (("a.csv", range(300, 200, -1)), ("b.csv", range(1, 50))):
        with (tmp_path / name).open("w", newline="") as out:
            writer = csv.DictWriter(out, header)
            writer.writeheader()
            for i in numbers:
                writer.writerow(dict.fromkeys(header, "") | {"Facility Name": "Acme", "EA Number": f"EA{i:03}", "Facility Region": "PRO" if i % 3 else "TRO", "Status Code": "Effective"})
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    found = []
    for size in ("2k", "64m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            extract = files.read_case_extract(spark, str(tmp_path), multiline=False, place=True)
            cases = prepare_extract(extract, golden.PULL_DATE, keep=[files.PLACE])
            first = regional.monitored_representative(cases, files.PLACE)
            found.append(sorted((r.facility_region, r.ea_number, r.program_total) for r in first.collect()))
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert found[0] == found[1] == [("PRO", "EA299", 99), ("TRO", "EA300", 50)]
    by_number = regional.monitored_representative(cases.drop(files.PLACE))
    assert sorted(r.ea_number for r in by_number.collect()) == ["EA001", "EA003"]


def test_extract_rejects_dates_and_charges(spark, tmp_path):
    header = _extract_header()
    with (tmp_path / "x.csv").open("w", newline="") as out:
        writer = csv.DictWriter(out, header)
        writer.writeheader()
        writer.writerow(dict.fromkeys(header, "") | {"NOV Date": "13/45/2019", "Cash Civil Charge": "unknown", "Term Date": " "})
        writer.writerow(dict.fromkeys(header, "") | {"NOV Date": "4/5/2019 and later", "Cash Civil Charge": "7"})
    parsed = files.parse_case_extract(spark, str(tmp_path / "x.csv"), multiline=True)
    found = sorted((r.record, r.field, r.text, r.reason) for r in parsed.rejects.collect())
    assert found == [(1, "Cash Civil Charge", "unknown", "no double"), (1, "NOV Date", "13/45/2019", "no date")]


def test_store_replaces_its_own_pull_only(spark, cases, tmp_path):
    path = f"{tmp_path}/cases"
    earlier = cases.withColumn("pull_date", F.lit("2020-03-31").cast("date"))
    store.write_cases(earlier, path)
    store.write_cases(cases, path)
    store.write_cases(cases.filter("ea_number <> 'EA1'"), path)
    back = store.read_all_pulls(spark, path)
    assert tuple(back.columns) == domain.CASES_COLUMNS
    assert {str(r.pull_date): r["count"] for r in back.groupBy("pull_date").count().collect()} == {
        "2020-03-31": 8,
        "2020-04-14": 7,
    }
    newest = store.read_cases(spark, path)
    assert {str(r.pull_date) for r in newest.collect()} == {golden.PULL_DATE} and newest.count() == 7
    plan = newest.select("ea_number")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(pull_date" in plan and "ReadSchema: struct<>" in plan
    one = store.read_cases(spark, path, golden.PULL_DATE)
    assert "PartitionFilters: [isnotnull(pull_date" in one._jdf.queryExecution().executedPlan().toString()
    assert one.count() == 7
    regional = one.filter("facility_region = 'PRO'")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(facility_region,PRO)" in regional.split("PushedFilters:")[1]


def _written(folder):
    """Rows by file name; nothing but files may be there."""
    out = {}
    for name in os.listdir(folder):
        with open(os.path.join(folder, name), newline="") as f:
            out[name] = list(csv.DictReader(f))
    return out


def test_export_writes_one_file_per_region(spark, cases, tmp_path):
    export.export_detail(cases, "monitored", str(tmp_path))
    found = _written(tmp_path / "monitored")
    assert set(found) == {"monitoredConsent_PRO_2020-04-14.csv", "monitoredConsent_TRO_2020-04-14.csv"}
    (row,) = found["monitoredConsent_PRO_2020-04-14.csv"]
    assert list(row) == ["Program", *_extract_header()]
    assert (row["Program"], row["EA Number"], row["Facility Region"]) == ("Air", "EA10", "PRO")
    assert row["Comments"] == 'said "no", twice' and row["NOV Date"] == ""
    export.export_detail(cases, "pending", str(tmp_path), region="PRO")
    (rows,) = _written(tmp_path / "pending").values()
    assert sorted(r["EA Number"] for r in rows) == ["EA1", "EA2", "EA3"]
    (first,) = [r for r in rows if r["EA Number"] == "EA1"]
    assert first["NOV Date"].startswith("2019-04-15") and float(first["Cash Civil Charge"]) == 1000.0


def test_exports_of_regions_and_pulls_live_side_by_side(spark, cases, tmp_path):
    folder = str(tmp_path)
    two = cases.withColumn("facility_region", F.when(F.col("ea_number") == "EA2", "TRO").otherwise(F.col("facility_region")))
    later = two.withColumn("pull_date", F.lit("2020-05-14").cast("date"))
    export.export_detail(two, "pending", folder, "PRO")
    export.export_detail(two, "pending", folder, "TRO")
    export.export_detail(later, "pending", folder)
    export.export_detail(two.filter("ea_number <> 'EA3'"), "pending", folder, "PRO")
    found = {k: sorted(r["EA Number"] for r in v) for k, v in _written(tmp_path / "pending").items()}
    assert found == {
        "pendingConsent_PRO_2020-04-14.csv": ["EA1"],
        "pendingConsent_TRO_2020-04-14.csv": ["EA2"],
        "pendingConsent_PRO_2020-05-14.csv": ["EA1", "EA3"],
        "pendingConsent_TRO_2020-05-14.csv": ["EA2"],
    }


def test_a_large_export_has_numbered_parts(spark, tmp_path):
    """Parts replace a single file of the name and the other way round."""
    lines = spark.range(9000).selectExpr("if(id < 8000, 'a.csv', 'b.csv') AS file", "concat(id, ',x') AS line", "id")
    spark.dataSource.register(NamedCsv)

    def write(df):
        df.select("file", "line").write.format("named_csv").mode("append").options(path=str(tmp_path), header="n,t").save()

    write(lines.coalesce(1))
    assert set(os.listdir(tmp_path)) == {"a.csv", "b.csv"}
    write(lines.where("id < 8000").repartition(3, "id"))
    assert set(os.listdir(tmp_path)) == {"a-1.csv", "a-2.csv", "a-3.csv", "b.csv"}
    found = _written(tmp_path)
    assert sorted(int(r["n"]) for k in range(1, 4) for r in found[f"a-{k}.csv"]) == [*range(8000)]
    write(lines.where("id < 8000").repartition(2, "id"))
    assert set(os.listdir(tmp_path)) == {"a-1.csv", "a-2.csv", "b.csv"}
    write(lines.where("id < 8000").coalesce(1))
    assert set(os.listdir(tmp_path)) == {"a.csv", "b.csv"}


def test_a_failed_export_leaves_everything_as_it_was(spark, tmp_path):
    spark.dataSource.register(NamedCsv)
    good = spark.createDataFrame([("a.csv", "1")], "file string, line string")
    good.write.format("named_csv").mode("append").options(path=str(tmp_path), header="n").save()
    bad = spark.range(0, 40, 1, 4).selectExpr("if(id = 39, 'b/c.csv', 'a.csv') AS file", "cast(id AS string) AS line")
    with pytest.raises(Exception, match="slash"):
        bad.write.format("named_csv").mode("append").options(path=str(tmp_path), header="n").save()
    assert os.listdir(tmp_path) == ["a.csv"] and (tmp_path / "a.csv").read_text() == "n\n1\n"


def _exchanges(plan):
    return [line.strip() for line in plan.splitlines() if "Exchange" in line]


def test_stored_pulls_meet_without_a_shuffle(spark, cases, tmp_path):
    lost = cases.limit(1).withColumn("ea_number", F.lit(None).cast("string"))
    later = cases.unionByName(lost)
    earlier = cases.where("ea_number IN ('EA1', 'EA4')").unionByName(cases.where("ea_number = 'EA1'")).unionByName(lost)
    earlier = earlier.withColumn("pull_date", F.lit("2020-03-31").cast("date"))
    path, before = str(tmp_path), {t.name for t in spark.catalog.listTables()}
    store.write_pull(later, path, golden.PULL_DATE, 4)
    store.write_pull(later.limit(2), path, "2020-03-31", 4)  # no such rows: an empty pull
    store.write_pull(earlier, path, "2020-03-31", 4)
    one, other = store.read_pull(spark, path, golden.PULL_DATE, 4), store.read_pull(spark, path, "2020-03-31", 4)
    assert {t.name for t in spark.catalog.listTables()} == before
    assert one.columns == list(domain.CASES_COLUMNS) and one.count() == 9
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for pulls too large to broadcast
    try:
        known = one.where("ea_number IS NOT NULL").join(other.select("ea_number"), "ea_number", "left_semi")
        plan = known._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and not _exchanges(plan)
        found = recon.reconcile_stored(one, other)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and all("SinglePartition" in x for x in _exchanges(plan))
        rows = sorted(map(tuple, found.collect()), key=repr)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    assert rows == sorted(map(tuple, recon.reconcile_cases(later, earlier).collect()), key=repr)
    assert sorted((r[1] or "") for r in rows) == ["", "EA1", "EA4"]
    without = recon.reconcile_stored(one, other.where("ea_number IS NOT NULL"))
    assert sorted(r.ea_number for r in without.collect()) == ["EA1", "EA4"]
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        store.read_pull(spark, path, golden.PULL_DATE, 8)


def test_lineage_is_cut_in_the_shared_folder(spark, cases):
    folder = spark.sparkContext.getCheckpointDir()
    cut = cut_lineage(cases.groupBy("program").count())
    assert spark.sparkContext.getCheckpointDir() == folder
    assert "Scan ExistingRDD" in cut._jdf.queryExecution().executedPlan().toString()
    assert cut.count() == 6


def test_without_a_shared_folder_nothing_is_written(spark, cases, monkeypatch):
    monkeypatch.setattr("caseflow.session.checkpoint_folder", lambda spark: None)
    assert cut_lineage(cases) is cases


def test_duplicate_facilities_are_found(spark):
    doubled = golden.facilities(spark).union(golden.facilities(spark).limit(1))
    assert [r["rows"] for r in duplicate_keys(doubled, "efc_id").collect()] == [2]
