"""Names, labels, formats and lookup tables that outputs must reproduce exactly."""

from __future__ import annotations

# ---------------------------------------------------------------------------
# Expected input files, archive members and required columns.
# ---------------------------------------------------------------------------
SOURCE_TYPE_BY_FILE = {
    "beneficiary_2019.csv": "beneficiary",
    "beneficiary_2020.csv": "beneficiary",
    "beneficiary_2021.csv": "beneficiary",
    "beneficiary_2022.csv": "beneficiary",
    "beneficiary_2023.csv": "beneficiary",
    "inpatient.csv": "inpatient",
    "carrier.zip": "carrier",
    "outpatient.zip": "outpatient",
}
ARCHIVE_MEMBER = {"carrier.zip": "carrier.csv", "outpatient.zip": "outpatient.csv"}
REQUIRED_COLUMNS = {
    "beneficiary": ["BENE_ID"],
    "carrier": ["BENE_ID", "CLM_ID", "HCPCS_CD"],
    "outpatient": ["BENE_ID", "CLM_ID", "HCPCS_CD"],
    "inpatient": ["BENE_ID", "CLM_ID"],
}

# ---------------------------------------------------------------------------
# Source column -> standard column, per source type.
# ---------------------------------------------------------------------------
COLUMN_NAMES = {
    "beneficiary": {
        "BENE_ID": "bene_id",
        "BENE_BIRTH_DT": "birth_date",
        "AGE_AT_END_REF_YR": "age_at_end_of_year",
        "SEX_IDENT_CD": "sex_code",
        "BENE_RACE_CD": "race_code",
    },
    "carrier": {
        "CLM_ID": "claim_id",
        "BENE_ID": "bene_id",
        "CLM_FROM_DT": "claim_from_date",
        "CLM_THRU_DT": "claim_thru_date",
        "RFR_PHYSN_NPI": "referring_provider_npi",
        "PRF_PHYSN_NPI": "rendering_provider_npi",
        "ORG_NPI_NUM": "organization_npi",
        "LINE_PLACE_OF_SRVC_CD": "place_of_service_code",
        "HCPCS_CD": "hcpcs_code",
        "LINE_ICD_DGNS_CD": "line_diagnosis_code",
        "LINE_SBMTD_CHRG_AMT": "line_submitted_charge",
        "LINE_ALOWD_CHRG_AMT": "line_allowed_charge",
        "LINE_PRVDR_PMT_AMT": "line_provider_payment",
    },
    "outpatient": {
        "CLM_ID": "claim_id",
        "BENE_ID": "bene_id",
        "CLM_FROM_DT": "claim_from_date",
        "CLM_THRU_DT": "claim_thru_date",
        "PRVDR_NUM": "facility_provider_id",
        "ORG_NPI_NUM": "organization_npi",
        "AT_PHYSN_NPI": "attending_provider_npi",
        "OP_PHYSN_NPI": "operating_provider_npi",
        "OT_PHYSN_NPI": "other_provider_npi",
        "RNDRNG_PHYSN_NPI": "rendering_provider_npi",
        "REV_CNTR": "revenue_center_code",
        "HCPCS_CD": "hcpcs_code",
        "REV_CNTR_RATE_AMT": "revenue_center_rate",
        "REV_CNTR_PRVDR_PMT_AMT": "revenue_center_provider_payment",
        "REV_CNTR_BENE_PMT_AMT": "revenue_center_beneficiary_payment",
        "REV_CNTR_TOT_CHRG_AMT": "revenue_center_total_charge",
    },
    "inpatient": {
        "CLM_ID": "claim_id",
        "BENE_ID": "bene_id",
        "CLM_FROM_DT": "claim_from_date",
        "CLM_THRU_DT": "claim_thru_date",
        "PRVDR_NUM": "facility_provider_id",
        "ORG_NPI_NUM": "organization_npi",
        "AT_PHYSN_NPI": "attending_provider_npi",
        "OP_PHYSN_NPI": "operating_provider_npi",
        "OT_PHYSN_NPI": "other_provider_npi",
        "REV_CNTR": "revenue_center_code",
        "HCPCS_CD": "hcpcs_code",
    },
}
# Numbered column families.
NUMBERED_FAMILIES = {"ICD_DGNS_CD": "diagnosis_code_", "ICD_PRCDR_CD": "icd10_pcs_procedure_code_"}

# ---------------------------------------------------------------------------
# Types by standard column name or suffix.
# ---------------------------------------------------------------------------
DATE_NAMES = ["birth_date", "claim_from_date", "claim_thru_date"]
DATE_SUFFIX = "_dt"
NUMBER_NAMES = [
    "age_at_end_of_year",
    "line_submitted_charge",
    "line_allowed_charge",
    "line_provider_payment",
    "revenue_center_rate",
    "revenue_center_provider_payment",
    "revenue_center_beneficiary_payment",
    "revenue_center_total_charge",
]
NUMBER_SUFFIXES = ["_amt", "_cnt", "_qty"]

# ---------------------------------------------------------------------------
# Provider identifier columns in order of preference, with the identifier type.
# ---------------------------------------------------------------------------
PROVIDER_COLUMNS = {
    "carrier": [
        ("rendering_provider_npi", "NPI"),
        ("organization_npi", "NPI"),
    ],
    "outpatient": [
        ("rendering_provider_npi", "NPI"),
        ("attending_provider_npi", "NPI"),
        ("organization_npi", "NPI"),
        ("facility_provider_id", "CMS_PROVIDER_NUMBER"),
    ],
    "inpatient": [
        ("attending_provider_npi", "NPI"),
        ("operating_provider_npi", "NPI"),
        ("organization_npi", "NPI"),
        ("facility_provider_id", "CMS_PROVIDER_NUMBER"),
    ],
}
CODE_SYSTEM = "HCPCS/CPT"

# Scope labels carried as columns.
ALLOWED_SCOPE = "Carrier line allowed amounts only"
RATE_BASIS = "Claims per beneficiary observed for this provider and procedure"
PLACE_SCOPE = "Carrier claims only"

# Texts read as "no code" and texts read as missing by the whole-file reader.
NULL_CODE_TOKENS = ["nan", "none"]
MISSING_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

# ---------------------------------------------------------------------------
# Provenance of the public claim files.
# ---------------------------------------------------------------------------
SOURCE_LABEL = "CMS Synthetic Medicare claims"
COLLECTION_URL = "https://data.cms.gov/collection/synthetic-medicare-enrollment-fee-for-service-claims-and-prescription-drug-event"
SOURCE_URL_BY_FILE = {
    "beneficiary_2019.csv": "https://data.cms.gov/sites/default/files/2023-04/7f65254b-174e-4460-aa49-6759ea8397af/beneficiary_2019.csv",
    "beneficiary_2020.csv": "https://data.cms.gov/sites/default/files/2023-04/74b86018-5148-45bb-87f7-c551eda070d8/beneficiary_2020.csv",
    "beneficiary_2021.csv": "https://data.cms.gov/sites/default/files/2023-04/98832739-88bd-4243-87fe-ee12b8542baf/beneficiary_2021.csv",
    "beneficiary_2022.csv": "https://data.cms.gov/sites/default/files/2023-04/831cfb41-3a7a-4ce0-b02f-04d27df56b31/beneficiary_2022.csv",
    "beneficiary_2023.csv": "https://data.cms.gov/sites/default/files/2023-04/18fe0f5d-4126-432f-b12b-2569db9bdefa/beneficiary_2023.csv",
    "inpatient.csv": "https://data.cms.gov/sites/default/files/2023-04/67157de9-d962-4af0-bf0e-3578b3afec58/inpatient.csv",
    "carrier.zip": "https://data.cms.gov/sites/default/files/2023-04/b6fe03a8-82e2-49b7-a9fe-9eb68c8ac4d0/Carrier.zip",
    "outpatient.zip": "https://data.cms.gov/sites/default/files/2023-04/c3d8a962-c6b8-4a59-adb5-f0495cc81fda/Outpatient.zip",
}
CODEBOOK_URL = {
    "beneficiary": "https://www2.ccwdata.org/documents/10280/19022436/codebook-mbsf-abcd.pdf",
    "carrier": "https://www2.ccwdata.org/documents/10280/19022436/codebook-ffs-claims.pdf",
    "inpatient": "https://www2.ccwdata.org/documents/10280/19022436/codebook-ffs-claims.pdf",
    "outpatient": "https://www2.ccwdata.org/documents/10280/19022436/codebook-ffs-claims.pdf",
}

# Dictionary descriptions by standard column name without its number.
COLUMN_DESCRIPTIONS = {
    "bene_id": "CMS synthetic beneficiary identifier; preserved as text.",
    "claim_id": "CMS claim identifier; preserved as text.",
    "hcpcs_code": "HCPCS code reported on a claim line; preserved as text.",
    "claim_from_date": "CMS claim start date parsed from the source date field.",
    "claim_thru_date": "CMS claim end date parsed from the source date field.",
    "birth_date": "Beneficiary birth date parsed from the source date field.",
    "age_at_end_of_year": "Age at the end of the beneficiary reference year.",
    "icd10_pcs_procedure_code": "Numbered ICD-10-PCS procedure code from the source claim.",
    "diagnosis_code": "Numbered diagnosis code from the source claim.",
}
DEFAULT_DESCRIPTION = "Source field retained; consult the CMS data dictionary for its definition."

# ---------------------------------------------------------------------------
# Coverage archives, policy pages and relationship labels.
# ---------------------------------------------------------------------------
COVERAGE_ARCHIVES = {
    "LCD": ("current_lcd.zip", "current_lcd_csv.zip"),
    "Article": ("current_article.zip", "current_article_csv.zip"),
    "NCD": ("ncd.zip", "ncd_csv.zip"),
}
# policy type -> page, id parameter, version parameter
POLICY_LINKS = {
    "LCD": ("https://www.cms.gov/medicare-coverage-database/view/lcd.aspx", "lcdid", "ver"),
    "Article": ("https://www.cms.gov/medicare-coverage-database/view/article.aspx", "articleid", "ver"),
    "NCD": ("https://www.cms.gov/medicare-coverage-database/view/ncd.aspx", "ncdid", "ncdver"),
}
POLICY_CODE_SYSTEM = "CPT/HCPCS"
CODE_LISTED = "HCPCS/CPT code listed in current {policy_type} code table"
DIAGNOSIS_COVERED = "supports medical necessity per Article code table"
DIAGNOSIS_NONCOVERED = "does not support medical necessity per Article code table"
NCD_RELATED = "NCD listed as related to this {policy_type}"
PLACEHOLDER_NCD_IDS = ["0", ""]

# Policy index service paths and labels.
POLICY_INDEX_HOST = "https://api.coverage.cms.gov"
POLICY_INDEX_PATHS = {
    "NCD": "/v1/reports/national-coverage-ncd/",
    "LCD": "/v1/reports/local-coverage-final-lcds/",
    "Article": "/v1/reports/local-coverage-articles/",
}
INDEX_RELATIONSHIP = "Not checked: policy code tables are not loaded"
NATIONAL = "National"

# Header names that mark code columns in description files.
PROCEDURE_FILE_CODE_HEADERS = ["hcpc", "hcpcs", "hcpcs code", "hcpcs_cd"]
CPT_FILE_CODE_HEADERS = ["cpt", "hcpcs", "hcpcs code", "hcpcs_cd", "procedure_code", "code"]

# ---------------------------------------------------------------------------
# Wording of the evidence texts.
# ---------------------------------------------------------------------------
PROMPT_RULES = (
    "You are explaining healthcare claims analytics.\n"
    "Use only the evidence supplied below.\n"
    "Do not infer medical necessity.\n"
    "Do not make unsupported claims about fraud or improper billing.\n"
    "Distinguish observed data from interpretation.\n"
    "Separate observed facts from uncertainty.\n"
    "Do not infer a coverage decision.\n\n"
)
NO_DESCRIPTION = "No description available in the local references."
NO_COVERAGE_ROWS = "No local CMS coverage relationship rows were available."
NO_COVERAGE_TEXT = (
    "No direct local coverage relationship was identified for this code in the current evidence set."
)
COVERAGE_CAVEAT = (
    "in the local CMS files; this is evidence for a policy relationship, not a final coverage determination."
)
EXPLANATION_CLOSING = (
    "This explanation is an evidence-based summary only. It does not state that the service is medically "
    "necessary, inappropriate, or improperly billed, and it is not a coverage determination."
)
LIMITATIONS = (
    "This explanation is evidence-based and intentionally is not a coverage determination. "
    "It does not infer medical necessity, fraud, or improper billing. It is a decision-support summary, "
    "not a final adjudication."
)
EXPLANATION_MODEL = "evidence-fallback"
ANOMALY_NOTE = "Peer percentile and anomaly score are evidence-only prioritization signals."
NO_PROVIDER_NOTE = "No provider-specific comparison was selected."
DETAIL_METRICS = [
    "Provider ID",
    "Procedure code",
    "Claim count",
    "Beneficiary count",
    "Procedure rate",
    "Peer median",
    "Peer 90th percentile",
    "Peer 95th percentile",
    "Peer percentile",
]
