"""Cases, facilities and staffing derived from the star-schema tables.

An order stands for a case, a customer for its facility, a supplier for a position. The modulus
expressions blank out single values or choose a category, so that missing keys, names, numbers,
regions, statuses, dates, charges and capacities occur, one facility has no key, and one program is
in no list; every row of every table stays in the view.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseflow import domain
from caseflow.plans.prepare import prepare_cases
from caseflow.sources import views

PULL_DATE = "2001-08-01"
EARLIER_PULL = "2001-03-01"

_SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey long, c_name string, c_nationkey int",
    "supplier": "s_suppkey long, s_name string, s_nationkey int",
    "orders": """o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double,
        o_orderdate timestamp_ntz, o_orderpriority string""",
    "lineitem": "l_orderkey long, l_shipdate timestamp_ntz",
}

_CASE_EXPRESSIONS = (
    "if(o_custkey % 83 <> 0, o_custkey, NULL) AS facility_id",
    "if(o_orderkey % 101 <> 0, concat('EA-', o_orderkey), NULL) AS ea_number",
    "if(o_custkey % 89 <> 0, r_name, NULL) AS facility_region",
    "concat('MGR-', o_custkey % 20) AS case_manager",
    "concat('REG-', o_custkey) AS registration_number",
    """element_at(array('Air', 'VPDES', 'Solid Waste', 'Hazardous Waste', 'VWPP', 'PReP', 'VPA',
        'Multimedia', 'Oil Spill', 'Other', 'Groundwater', 'Const. Storm.', 'UST', 'AST', 'Biosolids',
        NULL), cast(o_orderkey % 16 AS int) + 1) AS program_name""",
    "concat('PMT-', o_orderkey % 1000) AS permit_number",
    "concat('NOV-', o_orderkey) AS nov_number",
    "if(o_orderkey % 53 <> 0, o_orderdate, NULL) AS nov_date",
    "first_ship AS executed_date",
    "if(o_orderstatus = 'F', last_ship, NULL) AS term_date",
    "if(o_orderkey % 4 <> 0, o_totalprice, NULL) AS cash_civil_charge",
    "o_orderpriority AS action_code",
    """CASE if(o_orderkey % 59 <> 0, o_orderstatus, '-') WHEN 'F' THEN 'Terminated'
        WHEN 'P' THEN 'Effective' WHEN '-' THEN NULL
        ELSE element_at(array('Pending', 'Pending Consent', 'Pending APA'),
        cast(o_orderkey % 3 AS int) + 1) END AS status_code""",
    "concat('comment ', o_orderkey) AS comments",
)
_ORG_EXPRESSIONS = (
    "if(s_suppkey % 71 <> 0, r_name, NULL) AS region",
    """element_at(array('Manager', 'Manager/Vacant', 'Program Coordinator', 'Director/Vacant',
        'Enforcement Specialist', 'Enforcement Specialist/Vacant',
        'Administrative and Staff Assistant', 'Administrative and Staff Assistant/Vacant'),
        cast(s_suppkey % 8 AS int) + 1) AS position""",
    "concat('P', s_suppkey) AS position_number",
    """if(s_suppkey % 67 <> 0, element_at(array(8, 8, 8, 8, 15, 15, 0, 4),
        cast(s_suppkey % 8 AS int) + 1), NULL) AS capacity""",
)


@dataclass(frozen=True)
class CaseTables:
    """The engine's inputs over one data folder; every frame is lazy."""

    spark: SparkSession
    folder: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.schema(_SCHEMAS[name]).parquet(f"{self.folder}/{name}.parquet")

    def facilities(self) -> DataFrame:
        return self.table("customer").selectExpr(
            "if(c_custkey <> 83, c_custkey, NULL) AS efc_id",
            "if(c_custkey % 97 <> 0, c_name, NULL) AS facility_name",
        )

    def nation_regions(self) -> DataFrame:
        regions = self.table("region")
        return self.table("nation").join(regions, F.expr("r_regionkey = n_regionkey"), "left")

    def raw_cases(self) -> DataFrame:
        shipped = (
            self.table("lineitem")
            .groupBy("l_orderkey")
            .agg(F.min("l_shipdate").alias("first_ship"), F.max("l_shipdate").alias("last_ship"))
        )
        return (
            self.table("orders")
            .join(shipped, F.expr("l_orderkey = o_orderkey"), "left")
            .join(self.table("customer"), F.expr("c_custkey = o_custkey"), "left")
            .join(self.nation_regions(), F.expr("n_nationkey = c_nationkey"), "left")
            .selectExpr(*_CASE_EXPRESSIONS)
        )

    def cases(self, **settings) -> DataFrame:
        return prepare_cases(self.raw_cases(), self.facilities(), PULL_DATE, **settings)

    def org_chart(self) -> DataFrame:
        """A supplier whose nation is missing stays, without a region."""
        same = F.expr("n_nationkey = s_nationkey")
        return self.table("supplier").join(self.nation_regions(), same, "left").selectExpr(*_ORG_EXPRESSIONS)

    def referral_rates(self) -> DataFrame:
        """The rate of the region with key 4 is missing."""
        rate = "if(r_regionkey <> 4, cast(20.5 + 13 * r_regionkey AS double), NULL) AS referral_rate"
        return self.table("region").selectExpr("r_name AS region", rate)

    def cases_of_pulls(self, *pull_dates: str) -> DataFrame:
        """The same orders as several pulls, each with the ages of its own day, in one reading."""
        pulls = F.explode(F.array(*[F.lit(d).cast("date") for d in pull_dates]))
        raw = self.raw_cases().withColumn("pull", pulls)
        return prepare_cases(raw, self.facilities(), F.col("pull"))

    def source_views(self) -> dict[str, DataFrame]:
        """The case and facility views as the source has them: source column names in another order,
        and dates as month/day/year text, padded or not, with blank and impossible ones."""
        raw = self.raw_cases()
        order = F.col("nov_number")
        odd = F.substring(order, -1, 1).isin("1", "3", "5", "7", "9")
        texts = {
            c: F.when(odd, F.date_format(c, "M/d/yyyy")).otherwise(F.date_format(c, "MM/dd/yyyy"))
            for c in domain.DATE_COLUMNS
        }
        texts["nov_date"] = F.when(order.endswith("77"), "13/45/2001").otherwise(texts["nov_date"])
        texts["term_date"] = F.coalesce(texts["term_date"], F.when(odd, F.lit(" ")))
        view = raw.withColumns(texts).withColumn("unused", F.lit(1))
        view = view.withColumnsRenamed({n: s for n, (s, _) in domain.CASE_COLUMNS.items()})
        named = self.facilities().withColumnsRenamed({n: s for n, (s, _) in domain.FACILITY_COLUMNS.items()})
        return {domain.CASES_VIEW: view.select(*view.columns[::-1]), domain.FACILITIES_VIEW: named}

    def cases_from_views(self) -> DataFrame:
        """Prepared cases by way of the session's catalogue, which is left as it was: the views have
        names of their own in each call and go when they are resolved."""
        found = {}
        for view, frame in self.source_views().items():
            name = f"{view}_{uuid.uuid4().hex}"
            frame.createTempView(name)
            try:
                found[view] = views.read_view_table(self.spark, name)
            finally:
                self.spark.catalog.dropTempView(name)
        raw = views.select_cases(found[domain.CASES_VIEW])
        facilities = views.select_facilities(found[domain.FACILITIES_VIEW])
        return prepare_cases(raw, facilities, PULL_DATE)
