"""Names, lists and schemas of the enforcement-case domain.

Everything here is a fixed value: source names, vocabulary and wording that a result must carry
exactly. Logic lives elsewhere.
"""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values: source views -------------------------------------------------------------
VIEW_SCHEMA = "enf"
CASES_VIEW = "Enf_enforcement_Cases_View"
FACILITIES_VIEW = "Enf_Facilities_View"
ADMIN_PROCEEDINGS_VIEW = "Enf_Admin_Proceed_View"
DOCUMENTS_VIEW = "Enf_ECM_Docs_View"
RESPONSIBLE_PARTIES_VIEW = "Enf_Respon_Parties_View"
SETTLEMENTS_VIEW = "Enf_Settle_Details_View"
VIEWS = (
    ADMIN_PROCEEDINGS_VIEW,
    DOCUMENTS_VIEW,
    CASES_VIEW,
    FACILITIES_VIEW,
    RESPONSIBLE_PARTIES_VIEW,
    SETTLEMENTS_VIEW,
)

# --- fixed values: engine column -> (source column, display label) --------------------------
CASE_COLUMNS = {
    "facility_id": ("Enc_Enf_Facility_Id", None),
    "ea_number": ("Enc_Ea_Number", "EA Number"),
    "facility_region": ("EFC_REGION", "Facility Region"),
    "case_manager": ("Enf_Case_Mgr", "Case Manager"),
    "registration_number": ("Enc_Reg_Fac_Num", "Registration Number"),
    "program_name": ("Program_Name", "Program Name"),
    "permit_number": ("Enc_Pmt_Pc_Num", "Permit Number"),
    "nov_number": ("Enc_Nov_Number", "NOV Number"),
    "nov_date": ("Enc_Nov_Date", "NOV Date"),
    "executed_date": ("Enc_Executed_Date", "Executed Date"),
    "term_date": ("Enc_Terminated_Date", "Term Date"),
    "cash_civil_charge": ("ECC_CASH_CIVIL_CHARGE", "Cash Civil Charge"),
    "action_code": ("EAC_DESCRIPTION", "Action Code"),
    "status_code": ("Status_Code_Desc", "Status Code"),
    "comments": ("Enc_Status_Comments", "Comments"),
}
FACILITY_COLUMNS = {
    "efc_id": ("Efc_Id", None),
    "facility_name": ("Efc_Facility_Name", "Facility Name"),
}
DISPLAY_LABELS = {
    "facility_name": "Facility Name",
    **{name: label for name, (_, label) in CASE_COLUMNS.items() if label},
    "program": "Program",
    "pull_date": "pullDate",
    "days_pending": "Days Pending",
}
DATE_COLUMNS = ("nov_date", "executed_date", "term_date")

# --- fixed values: vocabulary ---------------------------------------------------------------
REGIONS = ("BRRO", "CO", "NRO", "PRO", "SWRO", "TRO", "VRO")
PROGRAMS = ("Air", "AST/UST", "Other", "VPDES", "VWP", "Waste")
PENDING = ("Pending", "Pending Consent", "Pending APA")
PENDING_TWO = ("Pending", "Pending Consent")
EFFECTIVE = ("Effective",)
TERMINATED = ("Terminated",)

# Program groups; a program in no group keeps its own name, a missing one counts as "Other".
PROGRAM_GROUPS = {
    "Waste": ("Solid Waste", "Hazardous Waste"),
    "VWP": ("VWPP",),
    "Other": ("PReP", "VPA", "Multimedia", "Oil Spill", "Other", "Groundwater", "Const. Storm."),
    "AST/UST": ("UST", "AST"),
}
# The file extract of earlier pulls leaves construction stormwater as a program of its own.
EXTRACT_PROGRAM_GROUPS = {
    **PROGRAM_GROUPS,
    "Other": ("PReP", "VPA", "Multimedia", "Oil Spill", "Other", "Groundwater"),
}
NO_PROGRAM = "Other"

# Columns of the transposed table beside the listed programs.
REST_OF_PROGRAMS = "Rest"
ALL_PROGRAMS = "All"

YEAR_DAYS = 365
UNDER_YEAR = "Active < 365"
OVER_YEAR = "Active > 365"

MANAGER_POSITIONS = (
    "Manager",
    "Manager/Vacant",
    "Director",
    "Program Coordinator",
    "Team Leader/Vacant",
)
SPECIALIST_POSITIONS = (
    "Enforcement Specialist",
    "Enforcement Specialist/Vacant",
    "Administrative and Staff Assistant",
    "Administrative and Staff Assistant/Vacant",
)

CASES_PER_FTE = 15
DEFICIT_COLOR = "#ff5733"
SURPLUS_COLOR = "#1E90FF"

EXPORT_PREFIXES = {
    "pending": "pendingConsent_",
    "terminated": "terminatedConsent_",
    "monitored": "monitoredConsent_",
}

# --- schemas --------------------------------------------------------------------------------
RAW_CASES_SCHEMA = T.StructType(
    [
        T.StructField(
            name,
            T.LongType()
            if name == "facility_id"
            else T.DoubleType()
            if name == "cash_civil_charge"
            else T.StringType(),
        )
        for name in CASE_COLUMNS
    ]
)
FACILITIES_SCHEMA = T.StructType(
    [T.StructField("efc_id", T.LongType()), T.StructField("facility_name", T.StringType())]
)
ORG_CHART_SCHEMA = T.StructType(
    [
        T.StructField("region", T.StringType()),
        T.StructField("position", T.StringType()),
        T.StructField("position_number", T.StringType()),
        T.StructField("capacity", T.IntegerType()),
    ]
)
REFERRAL_RATES_SCHEMA = T.StructType(
    [T.StructField("region", T.StringType()), T.StructField("referral_rate", T.DoubleType())]
)
CASES_COLUMNS = (
    "facility_name",
    *[name for name in CASE_COLUMNS if name != "facility_id"],
    "program",
    "pull_date",
    "days_pending",
)
