"""The registered queries as SQL over the star-schema tables, in DuckDB's dialect."""

from __future__ import annotations

from standin.tables import EARLIER_PULL, PULL_DATE

REGION = "'ASIA'"
REGIONS = "'ASIA','EUROPE','NOWHERE'"
PROGRAM_SELECTION = "'Air','Waste'"
PENDING = "status_code IN ('Pending','Pending Consent','Pending APA')"
LATELY = "status_code = 'Terminated' AND term_date >= pull_date - INTERVAL 12 MONTH"

_VIEWS = f"""
facilities AS (
  SELECT CASE WHEN c_custkey = 83 THEN NULL ELSE c_custkey END AS efc_id, CASE WHEN c_custkey % 97 = 0 THEN NULL ELSE c_name END AS facility_name FROM customer),
raw_cases AS (
  SELECT CASE WHEN o_custkey % 83 = 0 THEN NULL ELSE o_custkey END AS facility_id,
    CASE WHEN o_orderkey % 101 = 0 THEN NULL ELSE concat('EA-', CAST(o_orderkey AS STRING)) END AS ea_number,
    CASE WHEN o_custkey % 89 = 0 THEN NULL ELSE r_name END AS facility_region,
    concat('MGR-', CAST(o_custkey % 20 AS STRING)) AS case_manager,
    concat('REG-', CAST(o_custkey AS STRING)) AS registration_number,
    CASE o_orderkey % 16 WHEN 0 THEN 'Air' WHEN 1 THEN 'VPDES' WHEN 2 THEN 'Solid Waste' WHEN 3 THEN 'Hazardous Waste'
      WHEN 4 THEN 'VWPP' WHEN 5 THEN 'PReP' WHEN 6 THEN 'VPA' WHEN 7 THEN 'Multimedia' WHEN 8 THEN 'Oil Spill'
      WHEN 9 THEN 'Other' WHEN 10 THEN 'Groundwater' WHEN 11 THEN 'Const. Storm.' WHEN 12 THEN 'UST' WHEN 13 THEN 'AST' WHEN 14 THEN 'Biosolids' END AS program_name,
    concat('PMT-', CAST(o_orderkey % 1000 AS STRING)) AS permit_number,
    concat('NOV-', CAST(o_orderkey AS STRING)) AS nov_number,
    CASE WHEN o_orderkey % 53 = 0 THEN NULL ELSE o_orderdate END AS nov_date,
    first_ship AS executed_date,
    CASE WHEN o_orderstatus = 'F' THEN last_ship END AS term_date,
    CASE WHEN o_orderkey % 4 <> 0 THEN o_totalprice END AS cash_civil_charge,
    o_orderpriority AS action_code,
    CASE WHEN o_orderkey % 59 = 0 THEN NULL WHEN o_orderstatus = 'F' THEN 'Terminated' WHEN o_orderstatus = 'P' THEN 'Effective'
      WHEN o_orderkey % 3 = 0 THEN 'Pending' WHEN o_orderkey % 3 = 1 THEN 'Pending Consent' ELSE 'Pending APA' END AS status_code,
    concat('comment ', CAST(o_orderkey AS STRING)) AS comments
  FROM orders
  LEFT JOIN (SELECT l_orderkey, min(l_shipdate) AS first_ship, max(l_shipdate) AS last_ship FROM lineitem GROUP BY l_orderkey) s ON l_orderkey = o_orderkey
  LEFT JOIN customer ON c_custkey = o_custkey
  LEFT JOIN nation ON n_nationkey = c_nationkey
  LEFT JOIN region ON r_regionkey = n_regionkey),
cases AS (
  SELECT f.facility_name, r.ea_number, r.facility_region, r.case_manager, r.registration_number, r.program_name, r.permit_number,
    r.nov_number, r.nov_date, r.executed_date, r.term_date, r.cash_civil_charge, r.action_code, r.status_code, r.comments,
    CASE WHEN program_name IN ('Solid Waste','Hazardous Waste') THEN 'Waste'
      WHEN program_name = 'VWPP' THEN 'VWP'
      WHEN program_name IS NULL OR program_name IN ('PReP','VPA','Multimedia','Oil Spill','Other','Groundwater','Const. Storm.') THEN 'Other'
      WHEN program_name IN ('UST','AST') THEN 'AST/UST' ELSE program_name END AS program,
    DATE '{PULL_DATE}' AS pull_date,
    date_sub('day', nov_date, coalesce(term_date, TIMESTAMP '{PULL_DATE} 00:00:00')) AS days_pending
  FROM raw_cases r LEFT JOIN facilities f ON f.efc_id IS NOT DISTINCT FROM r.facility_id
  WHERE f.facility_name IS NOT NULL AND r.ea_number IS NOT NULL),
org_chart AS (
  SELECT CASE WHEN s_suppkey % 71 = 0 THEN NULL ELSE r_name END AS region,
    CASE s_suppkey % 8 WHEN 0 THEN 'Manager' WHEN 1 THEN 'Manager/Vacant' WHEN 2 THEN 'Program Coordinator' WHEN 3 THEN 'Director/Vacant'
      WHEN 4 THEN 'Enforcement Specialist' WHEN 5 THEN 'Enforcement Specialist/Vacant' WHEN 6 THEN 'Administrative and Staff Assistant'
      ELSE 'Administrative and Staff Assistant/Vacant' END AS position,
    concat('P', CAST(s_suppkey AS STRING)) AS position_number,
    CAST(CASE WHEN s_suppkey % 67 = 0 THEN NULL ELSE CASE s_suppkey % 8 WHEN 4 THEN 15 WHEN 5 THEN 15 WHEN 6 THEN 0 WHEN 7 THEN 4 ELSE 8 END END AS INT) AS capacity
  FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey LEFT JOIN region ON r_regionkey = n_regionkey),
referral_rates AS (
  SELECT r_name AS region, CASE WHEN r_regionkey <> 4 THEN CAST(20.5 + 13 * r_regionkey AS DOUBLE) END AS referral_rate FROM region)
"""

_DETAIL = """facility_name, ea_number, facility_region, case_manager, registration_number, program_name, permit_number,
  nov_number, nov_date, executed_date, term_date, cash_civil_charge, action_code, status_code, comments"""
_PULLED = "CAST(pull_date AS STRING) AS pull_date"
_CASES = f"{_DETAIL}, program, {_PULLED}, days_pending"


def _pending_by(key: str, statuses: str = PENDING, template: bool = True) -> str:
    blank = f"""UNION ALL SELECT CAST(NULL AS STRING) AS {key}, CAST(NULL AS BIGINT), CAST(NULL AS BIGINT)"""
    return f"""
w AS (SELECT {key}, CAST(nullif(sum(CASE WHEN days_pending >= 365 THEN 0 ELSE 1 END), 0) AS BIGINT) AS active_lt_365,
    CAST(nullif(sum(CASE WHEN days_pending >= 365 THEN 1 ELSE 0 END), 0) AS BIGINT) AS active_gt_365
  FROM cases WHERE {statuses} GROUP BY {key}),
u AS (SELECT * FROM w {blank if template else ""})
SELECT {key}, active_lt_365, active_gt_365,
  CAST(sum(coalesce(active_lt_365, 0) + coalesce(active_gt_365, 0)) OVER (PARTITION BY {key}) AS BIGINT) AS total_pending FROM u"""


def _count_by(key: str, condition: str = "TRUE") -> str:
    name = {"facility_region": "region_total", "program": "program_total"}[key]
    return f"SELECT {key}, count(*) AS {name} FROM cases WHERE {condition} GROUP BY {key}"


def _cash_by(key: str, condition: str = "TRUE") -> str:
    name = {"facility_region": "regional_total", "program": "program_total"}[key]
    return (
        f"SELECT {key}, round(coalesce(sum(cash_civil_charge), 0), 2) AS {name} "
        f"FROM cases WHERE {condition} GROUP BY {key}"
    )


def _by_program_of_region(condition: str, where: str = "TRUE") -> str:
    return f"""SELECT facility_region, program, count(*) AS program_total FROM cases
WHERE {condition} AND {where} GROUP BY facility_region, program"""


def _pending_counts(region: str | None) -> str:
    where = f"AND facility_region = {region}" if region else ""
    lead = "" if region else "facility_region, "
    return f"""
p AS (SELECT facility_region, program, CASE WHEN days_pending >= 365 THEN 1 ELSE 0 END AS g FROM cases WHERE {PENDING} {where}),
w AS (SELECT facility_region, program, count(*) AS program_total, CAST(nullif(sum(1 - g), 0) AS BIGINT) AS lt,
    CAST(nullif(sum(g), 0) AS BIGINT) AS gt FROM p GROUP BY facility_region, program)
SELECT {lead}program, program_total,
  CASE WHEN max(lt) OVER (PARTITION BY facility_region) IS NULL THEN 0 ELSE lt END AS active_lt_365,
  CASE WHEN max(gt) OVER (PARTITION BY facility_region) IS NULL THEN 0 ELSE gt END AS active_gt_365 FROM w"""


def _transposed(region: str | None) -> str:
    where = f"AND facility_region = {region}" if region else ""
    lead = "" if region else "facility_region, "
    columns = ",\n  ".join(
        f"CAST(nullif(sum(CASE WHEN program = '{p}' THEN 1 ELSE 0 END), 0) AS BIGINT) AS {n}"
        for p, n in (
            ("Air", "air"),
            ("AST/UST", "ast_ust"),
            ("Other", "other"),
            ("VPDES", "vpdes"),
            ("VWP", "vwp"),
            ("Waste", "waste"),
        )
    )
    columns += """,
  CAST(nullif(sum(CASE WHEN program NOT IN ('Air','AST/UST','Other','VPDES','VWP','Waste') THEN 1 ELSE 0 END), 0) AS BIGINT) AS rest,
  count(*) AS "all\""""
    return f"""
p AS (SELECT facility_region, program, CASE WHEN days_pending >= 365 THEN 'active_gt_365' ELSE 'active_lt_365' END AS b
  FROM cases WHERE {PENDING} {where}),
u AS (SELECT facility_region, program, b FROM p UNION ALL SELECT facility_region, program, 'program_total' AS b FROM p)
SELECT {lead}b AS pending_status, {columns} FROM u GROUP BY {lead}b"""


_WORKLOAD = f"""CAST(sum(CASE WHEN {PENDING} THEN 1 ELSE 0 END) AS BIGINT) AS pending,
  CAST(sum(CASE WHEN {PENDING} AND days_pending >= 365 THEN 1 ELSE 0 END) AS BIGINT) AS pending_over,
  CAST(sum(CASE WHEN {PENDING} AND days_pending <= 365 THEN 1 ELSE 0 END) AS BIGINT) AS pending_under,
  CAST(sum(CASE WHEN status_code = 'Effective' THEN 1 ELSE 0 END) AS BIGINT) AS monitored,
  CAST(sum(CASE WHEN {LATELY} THEN 1 ELSE 0 END) AS BIGINT) AS terminated"""

_FTE = """round((region_capacity - referral_rate) / 15.0, 4) AS referral_fte_deficit,
  round(CAST(region_capacity - pending_total AS DOUBLE) / 15.0, 4) AS current_fte_deficit,
  CASE WHEN region_capacity - pending_total < 0 THEN '#ff5733' WHEN region_capacity - pending_total >= 0 THEN '#1E90FF' END AS current_fte_deficit_color"""

_STAFF = f"""
p AS (SELECT facility_region, count(*) AS n FROM cases WHERE {PENDING} GROUP BY facility_region),
o AS (SELECT region, CAST(CASE WHEN count(capacity) = count(*) THEN sum(capacity) END AS BIGINT) AS region_capacity
  FROM org_chart GROUP BY region)"""

_CUBE_SELECT = f"""{_PULLED}, facility_region, program, status_code,
  coalesce(days_pending >= 365, FALSE) AS over_year, coalesce(days_pending <= 365, FALSE) AS under_year,
  coalesce(term_date >= pull_date - INTERVAL 12 MONTH, FALSE) AS recent_term"""
_CUBE = f"""SELECT {_CUBE_SELECT}, count(*) AS case_count, round(coalesce(sum(cash_civil_charge), 0), 2) AS cash_total
FROM cases GROUP BY ALL"""


def _page_panels(key: str, whose: str) -> str:
    bucket = "CASE WHEN days_pending >= 365 THEN 'Active > 365' ELSE 'Active < 365' END"
    trace = "Regional Total" if whose == "region" else "Program Total"

    def counted(panel: str, condition: str, series: str = "'Program Total'") -> str:
        return (
            f"SELECT '{panel}_by_{whose}' AS panel, {key} AS x, {series} AS series, "
            f"CAST(count(*) AS DOUBLE) AS y FROM cases WHERE {condition} GROUP BY ALL"
        )

    return " UNION ALL ".join(
        [
            counted("pending", PENDING, bucket),
            counted("monitored", "status_code = 'Effective'"),
            counted("actions", "status_code = 'Effective'"),
            counted("terminated", LATELY),
            f"SELECT 'cash_by_{whose}' AS panel, {key} AS x, '{trace}' AS series, "
            f"round(coalesce(sum(cash_civil_charge), 0), 2) AS y FROM cases GROUP BY ALL",
        ]
    )


_PAGE = f"{_page_panels('facility_region', 'region')} UNION ALL {_page_panels('program', 'program')}"


def _bucket_bars(panel: str, key: str, captions: tuple[str, str, str, str], total: str, body: str) -> str:
    """Both age buckets of a pending table; captions of key, lower bucket, upper bucket, total."""
    first, lower, upper, last = captions

    def bars(series: str, column: str, caption: str) -> str:
        return f"""SELECT '{panel}' AS panel, {key} AS x, '{series}' AS series, CAST({column} AS DOUBLE) AS y,
  '{first}:  ' || coalesce({key}, 'NA') || '<br>{caption}:  ' || coalesce(CAST({column} AS STRING), 'NA')
  || '<br>{last}:  ' || CAST({total} AS STRING) AS label FROM t"""

    ctes, select = body.strip().rsplit("\nSELECT", 1)
    return (
        f"{ctes},\nt AS (SELECT{select})\n"
        + bars("Active < 365", "active_lt_365", lower)
        + "\nUNION ALL\n"
        + bars("Active > 365", "active_gt_365", upper)
    )


def _grouped_digits(x: str) -> str:
    """Seven significant digits with thousands separators."""
    cases = " ".join(
        f"WHEN abs({x}) >= {10 ** e} THEN rtrim(rtrim(format('{{:,.{6 - e}f}}', {x}), '0'), '.')"
        for e in range(5, 0, -1)
    )
    return f"CASE WHEN abs({x}) >= 1000000 THEN format('{{:,.0f}}', {x}) {cases} ELSE rtrim(rtrim(format('{{:,.6f}}', {x}), '0'), '.') END"


def _cash_bars(panel: str, key: str, caption: str, trace: str) -> str:
    return f"""
t AS (SELECT {key} AS x, round(coalesce(sum(cash_civil_charge), 0), 2) AS y FROM cases GROUP BY {key})
SELECT '{panel}' AS panel, x, '{trace}' AS series, y,
  '{caption}:  ' || coalesce(x, 'NA') || '<br>{trace}: $ ' || {_grouped_digits("y")} AS label FROM t"""


def _two_digits(x: str, most: str) -> str:
    """``x`` with ``most`` decimals."""
    cases = " ".join(f"WHEN {d} THEN format('{{:.{d}f}}', {x})" for d in range(0, 9))
    return f"CASE {most} {cases} END"


def _decimals(x: str) -> str:
    """Decimals of two significant digits without trailing zeros, found by trying them in turn."""
    lead = f"abs({x})"
    two = " ".join(
        f"WHEN {lead} >= {10.0 ** -e} THEN CASE WHEN round({lead}, {e + 1}) = round({lead}, {e}) AND {e} > 0 "
        f"AND round({lead}, {e + 1}) = round({lead}, {e - 1 if e else 0}) THEN {max(e - 1, 0)} "
        f"WHEN round({lead}, {e + 1}) = round({lead}, {e}) THEN {e} ELSE {e + 1} END"
        for e in range(0, 7)
    )
    return f"CASE WHEN {x} IS NULL OR {x} = 0 THEN 0 WHEN {lead} >= 10 THEN 0 {two} ELSE 0 END"


def _fte_bars(panel: str, caption: str, expression: str) -> str:
    return f"""{_STAFF},
t AS (SELECT p.facility_region AS x, {expression} AS y
  FROM p LEFT JOIN o ON o.region IS NOT DISTINCT FROM p.facility_region
  LEFT JOIN referral_rates r ON r.region IS NOT DISTINCT FROM p.facility_region),
m AS (SELECT max({_decimals("y")}) AS most FROM t)
SELECT '{panel}' AS panel, x, CASE WHEN y < 0 THEN '< 0' WHEN y >= 0 THEN '> 0' END AS series, round(y, 4) AS y,
  'Region:  ' || coalesce(x, 'NA') || '<br>{caption}:  ' || coalesce({_two_digits("y", "most")}, 'NA') AS label FROM t, m"""


def _export(kind: str, prefix: str, condition: str) -> str:
    lead = "" if kind == "pending" else "program, "
    return f"""SELECT {lead}{_DETAIL}, '{prefix}' || facility_region || '_' || CAST(pull_date AS STRING) || '.csv' AS export_file
FROM cases WHERE facility_region IS NOT NULL AND {condition}"""


_YTD = "nov_date BETWEEN date_trunc('YEAR', pull_date) AND pull_date"
_SINCE = "BETWEEN TIMESTAMP '2000-01-01 00:00:00' AND TIMESTAMP '2001-08-01 00:00:00'"

_EARLIER = f"BETWEEN TIMESTAMP '2000-01-01 00:00:00' AND TIMESTAMP '{EARLIER_PULL} 00:00:00'"


def _two_pulls(body: str) -> str:
    """A question asked of each pull by itself: ``cases`` is the later one."""
    ctes, select = (body.strip().rsplit("\nSELECT", 1) + [""])[:2] if "\nSELECT" in body.strip() else ("", body.strip()[6:])
    earlier = f"""earlier AS (SELECT * REPLACE (DATE '{EARLIER_PULL}' AS pull_date,
    date_sub('day', nov_date, coalesce(term_date, TIMESTAMP '{EARLIER_PULL} 00:00:00')) AS days_pending) FROM cases)"""

    def asked(of: str, date: str) -> str:
        inner = f"WITH {ctes} SELECT{select}" if ctes else f"SELECT{select}"
        return f"SELECT *, '{date}' AS pull_date FROM ({inner.replace('FROM cases', f'FROM {of}')})"

    return f"{earlier}\n" + asked("cases", PULL_DATE) + "\nUNION ALL\n" + asked("earlier", EARLIER_PULL)


def _count_bars(panel: str, key: str, caption: str, trace: str, condition: str = "TRUE") -> str:
    return f"""
t AS (SELECT {key} AS x, count(*) AS n FROM cases WHERE {condition} GROUP BY {key})
SELECT '{panel}' AS panel, x, 'Program Total' AS series, CAST(n AS DOUBLE) AS y,
  '{caption}:  ' || coalesce(x, 'NA') || '<br>{trace}:  ' || n AS label FROM t"""


_BODIES = {
    "cases_prepared": f"SELECT {_CASES} FROM cases",
    "cases_prepared_utc_pull": f"""SELECT {_DETAIL}, program, {_PULLED},
  CASE WHEN term_date IS NULL THEN date_sub('day', nov_date + INTERVAL 5 HOUR, CAST(pull_date AS TIMESTAMP)) ELSE days_pending END AS days_pending
FROM cases""",
    "cases_prepared_as_extract": f"""SELECT {_DETAIL},
  CASE WHEN program_name = 'Const. Storm.' THEN program_name ELSE program END AS program, {_PULLED},
  date_sub('day', nov_date, CAST(pull_date AS TIMESTAMP)) AS days_pending FROM cases""",
    "cases_touched_since_last_year": f"""SELECT {_CASES} FROM cases
WHERE executed_date {_SINCE} OR nov_date {_SINCE} OR term_date {_SINCE}""",
    "cases_year_to_date": f"SELECT {_CASES} FROM cases WHERE {_YTD}",
    "cases_year_to_date_at_source": f"SELECT {_CASES} FROM cases WHERE {_YTD}",
    "reconcile_cases": f"""SELECT {_CASES} FROM cases y WHERE {_YTD}
  AND EXISTS (SELECT 1 FROM cases o WHERE o.ea_number = y.ea_number
    AND (o.executed_date {_EARLIER} OR o.nov_date {_EARLIER} OR o.term_date {_EARLIER}))""",
    "reconcile_stored_pulls": f"""SELECT {_CASES} FROM cases y WHERE {_YTD}
  AND EXISTS (SELECT 1 FROM cases o WHERE o.ea_number = y.ea_number
    AND (o.executed_date {_EARLIER} OR o.nov_date {_EARLIER} OR o.term_date {_EARLIER}))""",
    "cases_prepared_from_view": f"""SELECT {_DETAIL.replace(" nov_date,", " CASE WHEN nov_number LIKE '%77' THEN NULL ELSE nov_date END AS nov_date,")},
  program, {_PULLED}, CASE WHEN nov_number LIKE '%77' THEN NULL ELSE days_pending END AS days_pending FROM cases""",
    "pending_by_region_two_pulls": _two_pulls(_pending_by("facility_region")),
    "region_workload_two_pulls": _two_pulls(f"SELECT facility_region, {_WORKLOAD} FROM cases GROUP BY facility_region"),
    "pull_date_banner_two_pulls": f"""SELECT * FROM (VALUES
  ('{PULL_DATE}', 'Dashboard Data Pulled On: 08/01/01'), ('{EARLIER_PULL}', 'Dashboard Data Pulled On: 03/01/01')) v(pull_date, banner)
WHERE EXISTS (SELECT 1 FROM cases)""",
    "pull_date_banner": f"""SELECT DISTINCT {_PULLED}, 'Dashboard Data Pulled On: ' || strftime(cases.pull_date, '%m/%d/%y') AS banner FROM cases""",
    "pending_by_region": _pending_by("facility_region"),
    "pending_by_program": _pending_by("program"),
    "pending_by_region_two_statuses": _pending_by(
        "facility_region", "status_code IN ('Pending','Pending Consent')", template=False
    ),
    "monitored_by_region": _count_by("facility_region", "status_code = 'Effective'"),
    "monitored_by_program": _count_by("program", "status_code = 'Effective'"),
    "actions_by_region": _count_by("facility_region", "status_code = 'Effective'"),
    "actions_by_program": _count_by("program", "status_code = 'Effective'"),
    "actions_by_region_all": _count_by("facility_region"),
    "actions_by_program_all": _count_by("program"),
    "terminated_by_region": _count_by("facility_region", LATELY),
    "terminated_by_program": _count_by("program", LATELY),
    "cash_by_region": _cash_by("facility_region"),
    "cash_by_program": _cash_by("program"),
    "cash_drill_region": f"""
s AS (SELECT * FROM cases WHERE facility_region IN ({REGIONS})),
t AS (SELECT program, round(coalesce(sum(cash_civil_charge), 0), 2) AS program_total FROM s GROUP BY program)
SELECT DISTINCT s.program, s.facility_region, t.program_total FROM s JOIN t ON s.program = t.program""",
    "cash_drill_program": _cash_by("facility_region", f"program IN ({PROGRAM_SELECTION})"),
    "cash_drill_rows": f"""
s AS (SELECT * FROM cases WHERE facility_region IN ({REGIONS})),
t AS (SELECT program, round(coalesce(sum(cash_civil_charge), 0), 2) AS program_total FROM s GROUP BY program)
SELECT {_CASES.replace(" program, ", " r.program, ")}, program_total
FROM (SELECT *, row_number() OVER (PARTITION BY program, facility_region ORDER BY ea_number) AS rn FROM s) r
JOIN t ON t.program = r.program WHERE rn = 1""",
    "cases_with_regional_cash": f"""SELECT {_CASES},
  round(coalesce(sum(cash_civil_charge) OVER (PARTITION BY facility_region), 0), 2) AS regional_total FROM cases""",
    "cases_with_program_cash": f"""SELECT {_CASES},
  round(coalesce(sum(cash_civil_charge) OVER (PARTITION BY program), 0), 2) AS program_total FROM cases""",
    "cases_with_stored_program_cash": f"""SELECT {_CASES},
  round(coalesce(sum(cash_civil_charge) OVER (PARTITION BY program), 0), 2) AS program_total FROM cases""",
    "capacity_by_region": """SELECT region, CAST(CASE WHEN count(capacity) = count(*) THEN sum(capacity) END AS BIGINT) AS region_capacity
FROM org_chart GROUP BY region""",
    "fte_deficit_by_region": f"""{_STAFF}
SELECT facility_region, n AS pending_total, region_capacity, referral_rate, {_FTE.replace("pending_total", "n")}
FROM p LEFT JOIN o ON o.region IS NOT DISTINCT FROM p.facility_region
LEFT JOIN referral_rates r ON r.region IS NOT DISTINCT FROM p.facility_region""",
    "fte_deficit_all_regions": f"""{_STAFF},
j AS (SELECT o.region AS facility_region, coalesce(n, 0) AS pending_total, region_capacity
  FROM o LEFT JOIN p ON o.region IS NOT DISTINCT FROM p.facility_region)
SELECT j.facility_region, pending_total, region_capacity, referral_rate, {_FTE}
FROM j LEFT JOIN referral_rates r ON r.region IS NOT DISTINCT FROM j.facility_region""",
    "region_pending_detail": f"SELECT {_DETAIL} FROM cases WHERE {PENDING}",
    "region_pending_detail_one": f"SELECT {_DETAIL} FROM cases WHERE facility_region = {REGION} AND {PENDING}",
    "region_terminated_detail": f"SELECT program, {_DETAIL} FROM cases WHERE {LATELY}",
    "region_monitored_detail": f"SELECT program, {_DETAIL} FROM cases WHERE status_code = 'Effective'",
    "monitored_with_program_total": f"""SELECT program, {_DETAIL}, count(*) OVER (PARTITION BY program) AS program_total
FROM cases WHERE status_code = 'Effective'""",
    "monitored_with_region_total": f"""SELECT program, {_DETAIL}, count(*) OVER (PARTITION BY facility_region) AS region_total
FROM cases WHERE status_code = 'Effective'""",
    "pending_with_age_bucket": f"""SELECT {_CASES}, CASE WHEN days_pending >= 365 THEN 'Active > 365' ELSE 'Active < 365' END AS pending_status
FROM cases WHERE {PENDING}""",
    "region_pending_by_program": _pending_counts(None),
    "region_pending_by_program_one": _pending_counts(REGION),
    "region_terminated_by_program": _by_program_of_region(LATELY),
    "region_monitored_by_program": _by_program_of_region("status_code = 'Effective'"),
    "region_workload_summary": f"SELECT facility_region, {_WORKLOAD} FROM cases GROUP BY facility_region",
    "region_workload_summary_one": f"SELECT {_WORKLOAD} FROM cases WHERE facility_region = {REGION}",
    "region_workload_sentences": f"""
w AS (SELECT facility_region, {_WORKLOAD} FROM cases GROUP BY facility_region)
SELECT facility_region, 'Pending Cases: ' || pending AS pending, 'Pending Cases > 365 days: ' || pending_over AS pending_over,
  'Pending Cases < 365 days: ' || pending_under AS pending_under, 'Monitored Cases: ' || monitored AS monitored,
  'Terminated Cases: ' || terminated AS terminated FROM w""",
    "region_capacity_fte": f"""{_STAFF},
f AS (SELECT region, o.region_capacity AS capacity, coalesce(CAST(o.region_capacity AS STRING), 'NA') AS kt, coalesce(n, 0) AS pending_total, referral_rate,
    round((o.region_capacity - referral_rate) / 15.0, 2) AS referral_deficit,
    round(CAST(o.region_capacity - coalesce(n, 0) AS DOUBLE) / 15.0, 2) AS current_deficit
  FROM o LEFT JOIN p ON p.facility_region = region LEFT JOIN referral_rates USING (region) WHERE region IS NOT NULL),
s AS (SELECT *, coalesce(format('{{:.2f}}', referral_deficit), 'NA') AS rt, coalesce(format('{{:.2f}}', current_deficit), 'NA') AS ct,
  coalesce(format('{{:g}}', referral_rate), 'NA') AS rr FROM f)
SELECT region, capacity, pending_total, referral_rate, referral_deficit, current_deficit,
  'Regional Case Capacity: ' || kt AS capacity_text, 'Average Referral Rate: ' || rr AS referral_text,
  'Referral FTE Deficit: ' || rt AS referral_deficit_text, 'Current FTE Deficit: ' || ct AS current_deficit_text,
  CASE WHEN referral_deficit < 0 THEN '#ff5733' WHEN referral_deficit >= 0 THEN '#1E90FF' END AS referral_deficit_color,
  CASE WHEN current_deficit < 0 THEN '#ff5733' WHEN current_deficit >= 0 THEN '#1E90FF' END AS current_deficit_color,
  'Referral Deficit Eq. (' || kt || '-' || rr || ')/ 15= ' || rt AS referral_equation,
  'Current Deficit Eq. (' || kt || '- ' || pending_total || ')/ 15= ' || ct AS current_equation FROM s""",
    "region_roster": """SELECT region, position, position_number, capacity,
  CASE WHEN position IN ('Manager','Manager/Vacant','Director','Program Coordinator','Team Leader/Vacant') THEN 'manager'
    WHEN position IN ('Enforcement Specialist','Enforcement Specialist/Vacant','Administrative and Staff Assistant','Administrative and Staff Assistant/Vacant') THEN 'specialist'
    ELSE 'unlisted' END AS class,
  position || '- ' || position_number AS title, 'Capacity: ' || coalesce(CAST(capacity AS STRING), 'NA') AS subtitle FROM org_chart""",
    "pending_transposed": _transposed(None),
    "pending_transposed_cells": f"""
p AS (SELECT facility_region, program, CASE WHEN days_pending >= 365 THEN 'active_gt_365' ELSE 'active_lt_365' END AS b FROM cases WHERE {PENDING}),
u AS (SELECT facility_region, program, b FROM p UNION ALL SELECT facility_region, program, 'program_total' AS b FROM p)
SELECT facility_region, b AS pending_status, coalesce(program, 'NA') AS program, count(*) AS total,
  CAST(sum(count(*)) OVER (PARTITION BY facility_region, b) AS BIGINT) AS all_programs FROM u GROUP BY facility_region, program, b""",
    "pending_transposed_one": _transposed(REGION),
    "monitored_representative": f"""SELECT {_CASES}, program_total FROM (
  SELECT c.*, count(*) OVER (PARTITION BY facility_region) AS program_total,
    row_number() OVER (PARTITION BY facility_region ORDER BY ea_number) AS rn
  FROM cases c WHERE status_code = 'Effective') x WHERE rn = 1""",
    "case_cube": _CUBE,
    "case_cube_early": _CUBE,
    "statewide_page": _PAGE,
    "statewide_page_early": _PAGE,
    "regional_pages": f"""
b AS (SELECT facility_region, 'region_pending_by_program' AS panel, program AS x,
    CASE WHEN days_pending >= 365 THEN 'Active > 365' ELSE 'Active < 365' END AS series FROM cases WHERE {PENDING}
  UNION ALL SELECT facility_region, 'region_terminated_by_program', program, 'Program Total' FROM cases WHERE {LATELY}
  UNION ALL SELECT facility_region, 'region_monitored_by_program', program, 'Program Total' FROM cases WHERE status_code = 'Effective')
SELECT facility_region, panel, x, series, CAST(count(*) AS DOUBLE) AS y FROM b
WHERE facility_region IS NOT NULL GROUP BY facility_region, panel, x, series""",
    "chart_pending_by_region": _bucket_bars(
        "pending_by_region",
        "facility_region",
        ("Region Name", "Active < 365", "Active > 365", "Regional Total"),
        "total_pending",
        _pending_by("facility_region"),
    ),
    "chart_region_pending_by_program": _bucket_bars(
        "region_pending_by_program",
        "program",
        ("Program Name", "Category Count", "Category Count", "Program Total"),
        "program_total",
        _pending_counts(REGION),
    ),
    "chart_monitored_by_program": """
t AS (SELECT program AS x, count(*) AS n FROM cases WHERE status_code = 'Effective' GROUP BY program)
SELECT 'monitored_by_program' AS panel, x, 'Program Total' AS series, CAST(n AS DOUBLE) AS y,
  'Program Name:  ' || coalesce(x, 'NA') || '<br>Program Total:  ' || n AS label FROM t""",
    "chart_pending_by_program": _bucket_bars(
        "pending_by_program",
        "program",
        ("Program Name", "Active < 365", "Active > 365", "Program Total"),
        "total_pending",
        _pending_by("program"),
    ),
    "chart_monitored_by_region": _count_bars(
        "monitored_by_region", "facility_region", "Region Name", "Region Total", "status_code = 'Effective'"
    ),
    "chart_actions_by_region": _count_bars(
        "actions_by_region", "facility_region", "Region Name", "Region Total", "status_code = 'Effective'"
    ),
    "chart_actions_by_program": _count_bars(
        "actions_by_program", "program", "Program Name", "Program Total", "status_code = 'Effective'"
    ),
    "chart_terminated_by_region": _count_bars(
        "terminated_by_region", "facility_region", "Region Name", "Region Total", LATELY
    ),
    "chart_terminated_by_program": _count_bars(
        "terminated_by_program", "program", "Program Name", "Program Total", LATELY
    ),
    "chart_region_terminated_by_program": _count_bars(
        "region_terminated_by_program", "program", "Program Name", "Program Total", f"facility_region = {REGION} AND {LATELY}"
    ),
    "chart_region_monitored_by_program": _count_bars(
        "region_monitored_by_program", "program", "Program Name", "Program Total",
        f"facility_region = {REGION} AND status_code = 'Effective'",
    ),
    "chart_region_monitored_bar_labels": f"""
t AS (SELECT program AS x, count(*) AS n FROM cases WHERE facility_region = {REGION} AND status_code = 'Effective' GROUP BY program)
SELECT 'region_monitored_bar_labels' AS panel, x, 'Program Total' AS series, CAST(n AS DOUBLE) AS y,
  'Program Name:  ' || coalesce(x, 'NA') AS label FROM t""",
    "chart_monitored_representative": """
t AS (SELECT facility_region AS x, count(*) AS n FROM cases WHERE status_code = 'Effective' GROUP BY facility_region)
SELECT 'monitored_representative' AS panel, x, 'Program Total' AS series, CAST(n AS DOUBLE) AS y,
  'Region:  ' || coalesce(x, 'NA') || '<br>Program Total:  ' || n AS label FROM t""",
    "chart_cash_drill_program": f"""
t AS (SELECT facility_region AS x, round(coalesce(sum(cash_civil_charge), 0), 2) AS y FROM cases
  WHERE program IN ({PROGRAM_SELECTION}) GROUP BY facility_region)
SELECT 'cash_drill_program' AS panel, x, 'Program Total' AS series, y,
  'Region Name:  ' || coalesce(x, 'NA') || '<br>Program Total: $ ' || {_grouped_digits("y")} AS label FROM t""",
    "chart_fte_deficits_stacked": f"""{_STAFF},
t AS (SELECT p.facility_region AS x, round((region_capacity - referral_rate) / 15.0, 4) AS a,
    round(CAST(region_capacity - n AS DOUBLE) / 15.0, 4) AS b
  FROM p LEFT JOIN o ON o.region IS NOT DISTINCT FROM p.facility_region
  LEFT JOIN referral_rates r ON r.region IS NOT DISTINCT FROM p.facility_region),
u AS (SELECT x, 'Referral FTE Deficit' AS series, a AS y FROM t UNION ALL SELECT x, 'Current FTE Deficit', b FROM t)
SELECT 'fte_deficits_stacked' AS panel, x, series, y, 'Region:  ' || coalesce(x, 'NA') || '<br>' || series || ':  '
  || coalesce(rtrim(rtrim(format('{{:.4f}}', y), '0'), '.'), 'NA') AS label FROM u""",
    "chart_cash_drill_region": f"""
s AS (SELECT * FROM cases WHERE facility_region IN ({REGIONS})),
t AS (SELECT program AS x, round(coalesce(sum(cash_civil_charge), 0), 2) AS y FROM s GROUP BY program)
SELECT DISTINCT 'cash_drill_region' AS panel, x, 'Regional Total' AS series, y,
  'Region Name:  ' || facility_region || '<br>Program Name:  ' || x || '<br>Program Total: $ ' || {_grouped_digits("y")} AS label
FROM t JOIN s ON s.program = x""",
    "chart_cash_by_region": _cash_bars(
        "cash_by_region", "facility_region", "Region Name", "Regional Total"
    ),
    "chart_cash_by_program": _cash_bars("cash_by_program", "program", "Program Name", "Program Total"),
    "chart_referral_fte_deficit": _fte_bars(
        "referral_fte_deficit", "Referral FTE Deficit", "(region_capacity - referral_rate) / 15.0"
    ),
    "chart_current_fte_deficit": _fte_bars(
        "current_fte_deficit",
        "Current FTE Deficit",
        "CAST(region_capacity - n AS DOUBLE) / 15.0",
    ),
    "export_pending": _export("pending", "pendingConsent_", PENDING),
    "export_terminated": _export("terminated", "terminatedConsent_", LATELY),
    "export_monitored": _export("monitored", "monitoredConsent_", "status_code = 'Effective'"),
}


def _whole(body: str) -> str:
    body = body.strip()
    joint = "" if body.upper().startswith("SELECT") else ","
    return f"WITH {_VIEWS.strip()}{joint}\n{body}"


def oracle_sql() -> dict[str, str]:
    return {name: _whole(body) for name, body in _BODIES.items()}
