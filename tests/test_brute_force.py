"""Random cases through the plans and through plain Python loops."""

import datetime as dt
import random
from collections import Counter, defaultdict

import pytest

from caseflow import domain
from caseflow.plans import charts, cube, recon, regional, staffing, statewide
from caseflow.plans.prepare import prepare_cases

PULL = dt.date(2020, 2, 29)
STATUSES = [*domain.PENDING, "Effective", "Terminated", "Closed", None]
NAMES = ["Solid Waste", "VWPP", "UST", "Air", "Const. Storm.", "Brand New", None]
GROUPS = {
    "Solid Waste": "Waste",
    "VWPP": "VWP",
    "UST": "AST/UST",
    "Const. Storm.": "Other",
    None: "Other",
}


def text_date(draw):
    if draw.random() < 0.15:
        return draw.choice([None, "", "00/10/2019", "2/30/2019", "unknown"])
    day = PULL - dt.timedelta(days=draw.randrange(-30, 900))
    return f"{day.month}/{day.day}/{day.year}"


def parsed(text):
    try:
        return dt.datetime.strptime(text or "", "%m/%d/%Y").date()
    except ValueError:
        return None


def draw_rows(seed, n):
    draw = random.Random(seed)
    return [
        {
            "facility_id": draw.choice([1, 1, 1, 2, 3, 4, 5, None]),
            "ea_number": draw.choice([None, f"EA{i}", f"EA{i}", "EA-shared"]),
            "facility_region": draw.choice(["PRO", "PRO", "TRO", "CO", None]),
            "case_manager": "m",
            "registration_number": None,
            "program_name": draw.choice(NAMES),
            "permit_number": "p",
            "nov_number": str(i),
            "nov_date": text_date(draw),
            "executed_date": None,
            "term_date": draw.choice([None, text_date(draw)]),
            "cash_civil_charge": draw.choice([None, None, float(draw.randrange(0, 500))]),
            "action_code": "a",
            "status_code": draw.choice(STATUSES),
            "comments": None,
        }
        for i in range(n)
    ]


FACILITIES = [(1, "One"), (2, "Two"), (2, "Two again"), (3, None), (None, "Ghost"), (7, "Idle")]


def brute_cases(rows):
    out = []
    for r in rows:
        for key, name in FACILITIES:
            if key != r["facility_id"] or name is None or r["ea_number"] is None:
                continue
            notice, term = parsed(r["nov_date"]), parsed(r["term_date"])
            end = term or PULL
            out.append(
                r
                | {
                    "facility_name": name,
                    "program": GROUPS.get(r["program_name"], r["program_name"]),
                    "nov": notice,
                    "term": term,
                    "days": None if notice is None else (end - notice).days,
                }
            )
    return out


def is_pending(c):
    return c["status_code"] in domain.PENDING


def is_over(c):
    return c["days"] is not None and c["days"] >= 365


def is_recent(c):
    return c["status_code"] == "Terminated" and c["term"] is not None and c["term"] >= dt.date(2019, 2, 28)


@pytest.fixture(scope="module", params=[1, 2])
def world(request, spark):
    rows = draw_rows(request.param, 1500)
    names = [f.name for f in domain.RAW_CASES_SCHEMA.fields]
    raw = spark.createDataFrame([tuple(r[n] for n in names) for r in rows], domain.RAW_CASES_SCHEMA)
    facilities = spark.createDataFrame(FACILITIES, domain.FACILITIES_SCHEMA)
    prepared = prepare_cases(raw, facilities, PULL.isoformat()).cache()
    early = cube.build_cube_early(raw, facilities, PULL.isoformat()).cache()
    return brute_cases(rows), prepared, early


def bag(df):
    return Counter(tuple(r) for r in df.collect())


def test_cases(world):
    brute, cases, early = world
    fields = ("facility_name", "ea_number", "program", "status_code", "days", "nov_number")
    wanted = Counter(tuple(c[f] for f in fields) for c in brute)
    got = cases.select("facility_name", "ea_number", "program", "status_code", "days_pending", "nov_number")
    assert bag(got) == wanted
    assert early.groupBy().sum("case_count").first()[0] == len(brute)


@pytest.mark.parametrize("key", ["facility_region", "program"])
def test_panels(world, key):
    brute, cases, early = world
    pending = [c for c in brute if is_pending(c)]
    over = Counter(c[key] for c in pending if is_over(c))
    under = Counter(c[key] for c in pending if not is_over(c))
    both = over + under
    wanted = Counter({(k, under[k] or None, over[k] or None, both[k]): 1 for k in both})
    wanted[(None, None, None, both[None])] += 1
    cash = defaultdict(float)
    for c in brute:
        cash[c[key]] += c["cash_civil_charge"] or 0
    for table in (cases, early):
        assert bag(statewide.pending_by(table, key)) == wanted
        assert bag(statewide.count_by(table, key)) == Counter(Counter(c[key] for c in brute).items())
        lately = Counter(c[key] for c in brute if is_recent(c))
        assert bag(statewide.count_by(table, key, lately=True)) == Counter(lately.items())
        assert bag(statewide.cash_by(table, key)) == Counter(cash.items())


def test_drill_down(world):
    brute, cases, early = world
    chosen = [c for c in brute if c["facility_region"] in ("PRO", "TRO")]
    totals = defaultdict(float)
    for c in chosen:
        totals[c["program"]] += c["cash_civil_charge"] or 0
    pairs = {(c["program"], c["facility_region"]) for c in chosen}
    wanted = Counter((p, r, totals[p]) for p, r in pairs)
    for table in (cases, early):
        assert bag(statewide.cash_drill_region(table, ["PRO", "TRO", "gone"])) == wanted
    rows = statewide.cash_drill_rows(cases, ["PRO", "TRO"])
    assert bag(rows.select("program", "facility_region", "program_total")) == wanted
    lowest = defaultdict(lambda: "~")
    for c in chosen:
        place = (c["program"], c["facility_region"])
        lowest[place] = min(lowest[place], c["ea_number"])
    got = {(r.program, r.facility_region): r.ea_number for r in rows.collect()}
    assert got == dict(lowest)


def test_regional(world):
    brute, cases, early = world
    for region in ("PRO", "CO"):
        mine = [c for c in brute if c["facility_region"] == region]
        pending = [c for c in mine if is_pending(c)]
        under_year = [c for c in pending if c["days"] is not None and c["days"] <= 365]
        counters = (
            len(pending),
            sum(map(is_over, pending)),
            len(under_year),
            sum(c["status_code"] == "Effective" for c in mine),
            sum(map(is_recent, mine)),
        )
        lt = Counter(c["program"] for c in pending if not is_over(c))
        gt = Counter(c["program"] for c in pending if is_over(c))
        by_program = Counter(
            {(p, lt[p] + gt[p], lt[p] or (None if lt else 0), gt[p] or (None if gt else 0)): 1 for p in lt + gt}
        )
        for table in (cases, early):
            assert tuple(regional.region_workload_summary(table, region).first()) == counters
            assert bag(regional.region_pending_by_program(table, region)) == by_program
        assert regional.region_terminated_detail(cases, region).count() == counters[4]
        assert regional.region_monitored_detail(cases, region).count() == counters[3]


def test_pages(world):
    brute, cases, early = world
    wanted = Counter()
    for c in brute:
        if c["facility_region"] is None:
            continue
        bucket = "Active > 365" if is_over(c) else "Active < 365"
        for what, belongs, series in (
            ("pending", is_pending(c), bucket),
            ("terminated", is_recent(c), "Program Total"),
            ("monitored", c["status_code"] == "Effective", "Program Total"),
        ):
            if belongs:
                wanted[(c["facility_region"], f"region_{what}_by_program", c["program"], series)] += 1
    for table in (cases, early):
        got = {tuple(r)[:-1]: r.y for r in charts.regional_pages(table).collect()}
        assert got == wanted


def test_deficits_follow_the_numbers(spark, world):
    brute, cases, early = world
    chart = spark.createDataFrame(
        [("PRO", "Manager", "1", 8), ("PRO", "x", "2", 1), ("VRO", "y", "3", 5), (None, "z", "4", 2)],
        domain.ORG_CHART_SCHEMA,
    )
    rates = spark.createDataFrame([("PRO", 6.0), ("CO", 3.0)], domain.REFERRAL_RATES_SCHEMA)
    pending = Counter(c["facility_region"] for c in brute if is_pending(c))
    capacity, rate = {"PRO": 9, "VRO": 5, None: 2}, {"PRO": 6.0, "CO": 3.0}
    for table in (cases, early):
        found = {
            r.facility_region: (r.pending_total, r.region_capacity, r.referral_rate, r.current_fte_deficit)
            for r in staffing.fte_deficit_by_region(table, chart, rates).collect()
        }
        assert found == {
            k: (n, capacity.get(k), rate.get(k), (capacity[k] - n) / 15 if k in capacity else None)
            for k, n in pending.items()
        }


def test_reconciliation(world):
    brute, cases, _ = world
    this_year = [c for c in brute if c["nov"] and dt.date(2020, 1, 1) <= c["nov"] <= PULL]
    other = {c["ea_number"] for c in brute if c["status_code"] == "Closed"}
    wanted = Counter(c["ea_number"] for c in this_year if c["ea_number"] in other)
    closed = cases.filter("status_code = 'Closed'")
    got = recon.reconcile_cases(recon.year_to_date(cases), closed)
    assert Counter(r.ea_number for r in got.collect()) == wanted
