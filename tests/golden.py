"""Eleven cases, one per corner of the semantics, with a fixed pull date."""

from caseflow import domain

PULL_DATE = "2020-04-14"

# facility, case number, region, program, notice, termination, charge, status
_CASES = [
    (1, "EA1", "PRO", "Solid Waste", "04/15/2019", None, 1000.0, "Pending"),
    (1, "EA2", "PRO", "VWPP", "04/13/2020", None, None, "Pending APA"),
    (2, "EA3", "PRO", None, None, None, None, "Pending Consent"),
    (2, "EA4", "BRRO", "UST", "01/01/2018", "04/14/2019", 500.0, "Terminated"),
    (2, "EA5", "BRRO", "AST", "01/01/2018", "04/13/2019", 250.0, "Terminated"),
    (3, "EA6", "TRO", "Air", "01/01/2020", None, 10.0, "Effective"),
    (9, "EA7", "TRO", "Air", "01/01/2020", None, 10.0, "Effective"),
    (1, None, "TRO", "Air", "01/01/2020", None, 10.0, "Effective"),
    (None, "EA9", "TRO", "Const. Storm.", "03/01/2020", None, None, "Effective"),
    (1, "EA10", "PRO", "Air", "13/45/2019", None, 75.5, "Effective"),
    (1, "EA11", None, "VPDES", "04/14/2020", None, None, "Pending"),
]
_FACILITIES = [(1, "Acme"), (2, "Beta"), (3, None), (None, "Ghost")]
# region, position, number, capacity: what each row is for
ORG_CHART = [
    ("PRO", "Team Leader/Vacant", "T-1", 12),  # a manager, in a region with pending cases and a rate
    ("PRO", "Enforcement Specialist", "T-2", 30),  # a specialist
    ("TRO", "Director/Vacant", "T-3", 7),  # in neither list
    ("TRO", "Manager", "T-4", 9),  # a region with a rate and no pending case
    ("TRO", "Administrative and Staff Assistant/Vacant", "T-5", 4),
    ("NRO", "Program Coordinator", "T-6", None),  # a missing capacity
    ("NRO", "Enforcement Specialist/Vacant", "T-7", 15),  # a region without cases and without a rate
]  # BRRO has cases and no staff
REFERRAL_RATES = [("PRO", 50.0), ("TRO", 17.5)]


def raw_rows():
    blanks = {"case_manager": "M", "registration_number": "R", "permit_number": "P"}
    names = [f.name for f in domain.RAW_CASES_SCHEMA.fields]
    for facility, number, region, program, notice, term, charge, status in _CASES:
        row = blanks | {
            "facility_id": facility,
            "ea_number": number,
            "facility_region": region,
            "program_name": program,
            "nov_number": f"N{number}",
            "nov_date": notice,
            "executed_date": None,
            "term_date": term,
            "cash_civil_charge": charge,
            "action_code": "A",
            "status_code": status,
            "comments": 'said "no", twice',
        }
        yield tuple(row[n] for n in names)


def raw(spark):
    return spark.createDataFrame(list(raw_rows()), domain.RAW_CASES_SCHEMA)


def facilities(spark):
    return spark.createDataFrame(_FACILITIES, domain.FACILITIES_SCHEMA)


def org_chart(spark):
    return spark.createDataFrame(ORG_CHART, domain.ORG_CHART_SCHEMA)


def referral_rates(spark):
    return spark.createDataFrame(REFERRAL_RATES, domain.REFERRAL_RATES_SCHEMA)
